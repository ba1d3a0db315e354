"""Main-text extraction by consensus of a host's pages.

First pass: every page's containers are scored by the share of the page's clean text they hold and by how little else they hold; the best few
cast their scores as votes for their generalised path (tags and classes from the body down, digits masked, positions dropped). Votes are
summed by host and path, and each host's winner joins its pages. Second pass: pages are read again and the text of the elements at the
winning path is returned; pages without that path use their own best container, and pages without any use their whole body.

Boilerplate is told in two degrees. Menus, footers, asides, controls, hidden elements and reader comments are never text of the article. Page
headers, forms and elements whose class, id or role names an advert, a notice, a sidebar or the like are left out unless they hold most of what
remains of the page: then they are the page's frame. A class names such a thing as a whole (`cookie-notice`, `sidebar-left`), not by a part
of it (`notice-board`, `with-sidebar`). If nothing else is left on a page, the text of the second degree is returned rather than none.

Defined results: null and empty pages have empty texts; a null url is a host of its own; a tag cut off by the end of the page is no text;
ties between paths fall to the longer, then the first by code point; repeated rows are extracted alike and vote each; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.session import cut

VOTES_A_PAGE, MIN_SHARE = 3, 0.4
#: Winners are broadcast up to this many hosts; above, pages and winners meet in a shuffled join.
BROADCAST_HOSTS = 100_000

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|svg|iframe)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
# fixed values: element names of HTML by how they are read
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav aside footer button select menu textarea".split())
HEADS = frozenset("article main h1 h2 h3".split())
FRAMES = frozenset("form dialog fieldset".split())
CLOSED_BY = {"p": frozenset(("p",)), "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",))}
BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
NEVER_WORDS = frozenset("menu navbar navigation nav breadcrumb breadcrumbs pagination pager comment comments commentlist respond reply replies disqus footer contentinfo".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup "
    "share sharing social sidebar widget widgets related recommended recommendations login search toolbar skip alert complementary outbrain taboola teaser header masthead".split()
)
# what may stand beside such a word in a class name without changing what it names
BESIDE = frozenset("site page main global top bottom left right upper lower primary secondary box block list bar container wrapper wrap section area inner outer item items link links form buttons button column col panel slot unit zone thread title text message body bg sticky fixed mobile desktop js is id the of to my us posts articles stories news".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def degree(names: str) -> int:
    """0 if a class, id or role names nothing to leave out, 1 if it names boilerplate, 2 if it can never be text of the article."""
    worst = 0
    for token in re.sub(r"[0-9]+", "", names).split():
        words = [w for w in re.split(r"[^a-z]+", token) if w]
        if words and all(w in NOISE or w in NEVER_WORDS or w in BESIDE for w in words):
            worst = max(worst, 2 if any(w in NEVER_WORDS for w in words) else int(any(w in NOISE for w in words)))
    return worst


class Page:
    """The page's text blocks in order and its containers as ranges of blocks, each with its degree of boilerplate: 0, 1 or 2."""

    def __init__(self, html: str):
        self.blocks: list[list] = []  # text, characters in links, degree (the node, while reading)
        self.nodes: list[list] = [["", 0, -1, 0]]  # path, first block, block after the last, degree
        self.parents = [0]
        stack: list[tuple[str, int]] = [("", 0)]
        pieces: list[str] = []
        links = depth = 0

        def flush() -> None:
            nonlocal links
            if pieces:
                if text := " ".join("".join(pieces).split()):
                    self.blocks.append([text, min(links, len(text)), stack[-1][1]])
                pieces.clear()
            links = 0

        def pop(to: int) -> None:
            while len(stack) > to:
                self.nodes[stack.pop()[1]][2] = len(self.blocks)

        def add(raw: str) -> None:
            nonlocal links
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if depth:
                links += len(text.strip())

        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                add(html[at : m.start()])
            at = m.end()
            name = m[3] or m[6]
            if not name:
                continue
            name, closing = name.lower(), bool(m[2] or m[5])
            if name in INLINE:
                if name == "a":
                    depth = max(0, depth - 1) if closing else 1
                elif name == "br":
                    pieces.append(" ")
                continue
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        pop(k)
                        break
                continue
            if name in ("html", "body") and any(t == name for t, _ in stack):
                continue
            if name == "body" and stack[-1][0] == "head":
                pop(len(stack) - 1)
            depth = 0
            ends = CLOSED_BY.get(name, ("p",) if name in BREAKS_P else ())
            while len(stack) > 1 and stack[-1][0] in ends:
                pop(len(stack) - 1)
            if name in VOID:
                continue
            label, noise = self._label(name, m[4] or m[7] or "", stack)
            parent = self.nodes[stack[-1][1]]
            self.nodes.append([f"{parent[0]}>{label}" if parent[0] else label, len(self.blocks), -1, noise])
            self.parents.append(stack[-1][1])
            stack.append((name, len(self.nodes) - 1))
        if at < len(html):
            add(html[at:])
        flush()
        pop(0)
        self._settle()

    def _settle(self) -> None:
        """Degrees reach down to what an element holds; a frame, of degree 1 but with most of what can be text in elements of its own, has none."""
        worst, inside = [0] * len(self.nodes), [0] * len(self.nodes)  # inside: 1 if it holds elements, 2 if a heading, an article or the like
        for k in range(len(self.nodes) - 1, 0, -1):
            name = self.nodes[k][0].rpartition(">")[2].partition(".")[0]
            inside[self.parents[k]] = max(inside[self.parents[k]], inside[k], 2 if name in HEADS else 1)
        for k in range(1, len(self.nodes)):
            worst[k] = max(worst[self.parents[k]], self.nodes[k][3] // 2 * 2)
        held = [0]
        for text, links, node in self.blocks:
            held.append(held[-1] + (0 if worst[node] == 2 or 2 * links > len(text) else len(text)))
        for k, node in enumerate(self.nodes):
            share = held[node[2]] - held[node[1]]
            if node[3] == 1 and inside[k] and (2 * share > held[-1] if inside[k] == 2 else 5 * share > 4 * held[-1]):
                node[3] = 0
            if k:
                node[3] = max(node[3], self.nodes[self.parents[k]][3])
        for block in self.blocks:
            block[2] = self.nodes[block[2]][3]
        if self.blocks and not any(block[2] == 0 for block in self.blocks):  # nothing else on the page
            for part in (*self.nodes, *self.blocks):
                part[-1] = part[-1] // 2 * 2

    def _label(self, name: str, attributes: str, stack: list[tuple[str, int]]) -> tuple[str, int]:
        label, noise = name, 2 if name in NEVER else int(name in FRAMES or name == "header" and not any(t in ("article", "main") for t, _ in stack))
        if attributes.strip():
            named = []
            for a in ATTRIBUTE.finditer(attributes):
                kind, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if kind == "class" and value:
                    label = f"{name}.{re.sub(r'[0-9]+', '#', value.split()[0])}" if value.split() else name
                if kind == "hidden" and a.group().lower() == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and HIDDEN.search(value):
                    noise = 2
                if kind in ("class", "id", "role"):
                    named.append(value)
            if name not in ("body", "html", "main"):
                noise = max(noise, degree(" ".join(named)))
        return label, noise

    def candidates(self) -> list[tuple[float, str, int]]:
        """(score, path, node) of containers, best first."""
        clean, every = [0], [0]
        for text, links, noise in self.blocks:
            clean.append(clean[-1] + (0 if noise or 2 * links > len(text) else len(text)))
            every.append(every[-1] + len(text))
        total, out = clean[-1], []
        if not total:
            return []
        for k, (path, first, last, noise) in enumerate(self.nodes):
            name = path.rpartition(">")[2].partition(".")[0]
            held = clean[last] - clean[first]
            if k and not noise and held >= MIN_SHARE * total and name not in ("p", "html", "h1", "h2", "h3", "li", "span"):
                score = held / total * held / (every[last] - every[first]) + (0.15 if name == "article" else 0.05 if name == "main" else 0) + 0.002 * path.count(">")
                out.append((score, path, k))
        return sorted(out, key=lambda c: (-c[0], -len(c[1]), c[1], c[2]))

    def text_at(self, path: str | None) -> str:
        nodes = [n for n in self.nodes if path and n[0] == path and not n[3]]
        if not any(not self.blocks[b][2] for _, first, last, _ in nodes for b in range(first, last)):
            best = self.candidates()
            nodes = [self.nodes[best[0][2]]] if best else [self.nodes[0]]
        picked, after = [], 0
        for _, first, last, _ in nodes:  # nested elements of one path are read once
            picked += [self.blocks[b][0] for b in range(max(first, after), last) if not self.blocks[b][2]]
            after = max(after, last)
        return "\n".join(picked)


def host_of(url):
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes): every host's winning path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, text in zip(batch.column(0), batch.column(1), strict=True):
                for score, path, _ in Page(text.as_py() or "").candidates()[:VOTES_A_PAGE]:
                    hosts.append(host.as_py())
                    paths.append(path)
                    scores.append(round(score * 1e6))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "score"])

    votes = pages.select(host_of(F.col(url)).alias("host"), html).mapInArrow(run, "host string, path string, score long").groupBy("host", "path").agg(F.sum("score").alias("votes"))
    best = F.max_by(F.struct("path", "votes"), F.struct("votes", F.length("path"), "path")).alias("best")
    return votes.groupBy("host").agg(best).select("host", "best.path", "best.votes")


def extracted(pages: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, path, text, n_chars for every page."""
    winners = cut(host_paths(pages, url, html)).select(F.col("host").alias("_host"), "path")
    few = winners.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    rows = rows.join(F.broadcast(winners) if few else winners, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "path")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h.as_py() or "").text_at(p.as_py()) for h, p in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "path", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, path string, text string, n_chars long")
