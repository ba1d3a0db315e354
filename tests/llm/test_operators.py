"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import html
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from compare_oracle import TABLES, plain
from strataline.llm import backoff_lm, bm25, chat, host_rules, html_consensus, knn_quality, langid, mixing, oracle, packing, queries, simhash
from strataline.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, key string, bucket long, host_rate double"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls anywhere, empty and blank texts, repeated rows, equal ids, one very long text and columns named like the operators' own."""
    long = " ".join(f"w{k % 997} the" for k in range(20000))
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "The cat sat on the mat. " * 12, "en", "b"), (4, "The cat sat on the mat. " * 12, "en", "b"), (4, "other text of the same id", "en", "b")]
    rows += [(None, "no id here but words", "en", "a"), (5, long, "en", "a"), (6, "THE CAT SAT ON THE MAT. " * 12, "de", "b"), (7, "one", "fr", "c"), (8, "***!!! ### 123", None, None), (9, "ünïcödé straße 文字", "de", "c")]
    return spark.createDataFrame([(*r, 0, 99, 1.5, "k", 7, 0.5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, sf):
    return table(spark, sf, "labels")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- SQL -------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    res = db.sql(oracle.oracle_sql()[name])
    order = [res.columns.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[i]) for i in order) for r in res.fetchall()), key=repr)


# ---- SimHash ---------------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text, shingle=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, k):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= k:
                up[find(i)] = find(j)
    group = collections.defaultdict(list)
    for i in range(len(fps)):
        group[find(i)].append(i)
    return {i: min((ids[m] for m in g if ids[m] is not None), default=None) for g in group.values() for i in g}


def test_simhash(odd, none, spark, sf):
    for df in (odd, table(spark, sf, "documents")):
        rows = texts(df)
        fps = [slow_fingerprint(t) for _, t in rows]
        want = components(fps, [i for i, _ in rows], 4)
        expected = collections.Counter((rows[k][0], fps[k], want[k]) for k in range(len(rows)))
        got = simhash.near_duplicates(df).collect()
        assert collections.Counter((r.id, r.fp % (1 << 64), r.component_id) for r in got) == expected
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_hot_buckets(spark):
    """One dense group beyond the cell size: every deal and the final grid must keep all links."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62)
    codes = {int(base)} | {int(base) ^ sum(1 << int(b) for b in rng.choice(24, 3, replace=False)) for _ in range(500)} | {int(x) for x in rng.integers(0, 1 << 62, 300)}
    codes = sorted(codes)
    edges = simhash.links(spark.createDataFrame([(c,) for c in codes], "fp long"), 4, cell=16).collect()
    up = {c: c for c in codes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    want = components(codes, codes, 4)
    of = {c: want[k] for k, c in enumerate(codes)}
    for e in edges:
        assert of[e.src] == of[e.dst]
        up[find(e.src)] = find(e.dst)
    groups = collections.defaultdict(set)
    for c in codes:
        groups[find(c)].add(c)
    assert sorted(min(g) for g in groups.values()) == sorted(set(want.values()))


def test_similar_documents(spark, odd, none):
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    edit = lambda n, s: " ".join(f"x{s}{k}" if k in set(np.random.default_rng(s).choice(400, n, replace=False).tolist()) else w for k, w in enumerate(base))
    rows = [(k, edit(4, k)) for k in range(40)] + [(100 + k, " ".join(f"v{x}" for x in rng.integers(0, 10**6, 300))) for k in range(40)] + [(200, edit(200, 77))]
    got = {r.id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(40)} == {0} and got[200] == 200 and all(got[100 + k] == 100 + k for k in range(40))
    assert simhash.similar_documents(odd).count() == odd.count() and simhash.similar_documents(none).count() == 0


def test_similar_documents_is_exact_on_pairs(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(300):
        own, tail = ([f"w{x}" for x in rng.integers(0, 10**9, n)] for n in (400, int(rng.integers(20, 80))))
        texts_ = (" ".join(own), " ".join(own[: len(own) - len(tail)] + tail))
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(396)} for t in texts_)
        rows += [(2 * k, texts_[0]), (2 * k + 1, texts_[1])]
        want[2 * k], want[2 * k + 1] = 2 * k, 2 * k + (len(a & b) < 0.8 * len(a | b))
    apart = sum(want[k] == k for k in range(1, 600, 2))
    got = {r.id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 50 < apart < 280 and got == want


def test_similar_documents_beyond_the_centre(spark):
    """Codes of one bucket that aren't alike to its smallest code still meet, in cells too."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 10**9, 300)]
    rows, sets = [], {}
    for k in range(60):
        tail = [f"t{k // 2}x{x}" for x in range(90)]
        rows.append((k, " ".join(base + tail + ([f"one{k}"] if k % 2 else []))))
        words = rows[-1][1].split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    want = {k: min(j for j in range(60) if len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])) for k in range(60)}
    assert want == {k: k - k % 2 for k in range(60)}
    for cell in (4, simhash.CELL):
        got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell).collect()
        assert {r.id: r.component_id for r in got} == want


# ---- BM25 ------------------------------------------------------------------------------------------------------------------------


def test_bm25_on_odd_rows(odd, none):
    got = bm25.search(odd, odd, shard_docs=3, query_block=2).collect()
    rows = [(i, bm25.words_of(t)) for i, t in texts(odd)]
    average, n = sum(len(w) for _, w in rows) / len(rows), len(rows)
    df = collections.Counter(w for _, own in rows for w in set(own))
    asked = collections.defaultdict(collections.Counter)
    for i, own in rows:
        if i is not None:
            asked[i].update(own)
    for q, words in asked.items():
        scores = []
        for i, own in rows:
            tf = collections.Counter(own)
            v = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(own) / average)) for w, c in words.items() if tf[w])
            if v > 0:
                scores.append((-round(v, 9), i is None, i))
        mine = [(r.doc_id, r.place, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.place)]
        want = sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:10]
        assert [(i, p) for i, p, _ in mine] == [(i, k + 1) for k, (_, _, i) in enumerate(want)]
        assert [v for _, _, v in mine] == pytest.approx([-v for v, _, _ in want], abs=2e-8)
    assert bm25.search(none, none).count() == 0


def test_bm25_blocks_and_ties(monkeypatch):
    """A shard in small blocks against plain scores: pruned blocks lose nothing, equal scores fall to the smaller id."""
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 8)
    monkeypatch.setattr(bm25, "QUERIES_AT_ONCE", 7)
    rng = np.random.default_rng(1)
    vocabulary = [f"v{k}".encode() for k in range(300)]
    corpus = [[vocabulary[min(299, int(x))] for x in rng.zipf(1.4, int(rng.integers(0, 60)))] for _ in range(150)]
    corpus += corpus[:40]
    shard, average = bm25.Builder(), sum(map(len, corpus)) / len(corpus)
    for i, own in enumerate(corpus):
        shard.add(1000 - i, own)
    unpacked = bm25.Shard(shard.packed().to_struct_array()[0], average)
    weights = {h: float(w) for h, w in zip((xxhash.xxh64_intdigest(v) for v in vocabulary), rng.random(300) * 9, strict=True)}
    asked = [sorted({xxhash.xxh64_intdigest(w) for w in own}) for own in corpus if own]
    ends = np.cumsum([len(a) for a in asked])
    hashes = np.array([h for a in asked for h in a], np.uint64)
    found = {q: (docs, scores) for q, docs, scores in unpacked.top(ends - [len(a) for a in asked], ends, hashes, np.array([weights[int(h)] for h in hashes]), 5)}
    for q, own in enumerate(asked):
        want = []
        for i, words in enumerate(corpus):
            tf = collections.Counter(xxhash.xxh64_intdigest(w) for w in words)
            v = sum(weights[h] * tf[h] * 2.2 / (tf[h] + 1.2 * (0.25 + 0.75 * len(words) / average)) for h in own if tf[h])
            want += [(-round(v, 9), 1000 - i)] if v > 0 else []
        docs, scores = found[q]
        assert unpacked.ids[docs].tolist() == [i for _, i in sorted(want)[:5]] and scores.tolist() == pytest.approx([-v for v, _ in sorted(want)[:5]])


def test_bm25_counts_beyond_16_bits(spark):
    """Frequencies above 65,535 are whole: the SQL's formula without a cap, in a text of 300,000 equal words."""
    df = spark.createDataFrame([(1, "a " * 300_000), (2, "a b"), (3, "c d")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in bm25.search(df, df.where("doc_id = 2")).collect()}
    average, tf = 300_004 / 3, 300_000
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    assert got[1] == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tf / average)), abs=1e-8)


def test_bm25_floors_and_close_scores(monkeypatch):
    """Documents below a query's floor are left out, those at it stay, and scores closer than single precision tells apart are in their exact order."""
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 16)
    rng = np.random.default_rng(2)
    corpus = [[f"v{int(x)}".encode() for x in rng.integers(0, 40, 30)] for _ in range(64)]
    shard, h = bm25.Builder(), sorted(xxhash.xxh64_intdigest(f"v{k}".encode()) for k in range(40))
    for i, own in enumerate(corpus):
        shard.add(i, own)
    unpacked, weights = bm25.Shard(shard.packed().to_struct_array()[0], 30.0), 5 + 1e-9 * rng.permutation(40) * 100
    counts = [collections.Counter(xxhash.xxh64_intdigest(w) for w in own) for own in corpus]
    want = sorted((-round(sum(v * tf[x] * 2.2 / (tf[x] + 1.2) for x, v in zip(h, weights, strict=True) if tf[x]), 9), i) for i, tf in enumerate(counts))
    hashes, asked = np.array(h, np.uint64), (np.array([0]), np.array([40]))
    ((_, docs, scores),) = unpacked.top(*asked, hashes, weights, 20)
    assert len({np.float32(x) for x, _ in want[:20]}) < len({x for x, _ in want[:20]}) and unpacked.ids[docs].tolist() == [i for _, i in want[:20]]
    ((_, docs, scores),) = unpacked.top(*asked, hashes, weights, 20, floors=np.array([-want[4][0]]))
    assert scores.min() >= -want[4][0] * (1 - 1e-4) and 5 <= len(docs) < 20 and unpacked.ids[docs[:5]].tolist() == [i for _, i in want[:5]]
    assert list(unpacked.top(*asked, hashes, weights, 20, floors=np.array([1e6]))) == []


def test_bm25_waves_lose_nothing(spark, monkeypatch):
    """Searched in many waves with several blocks of queries, or all at once: the same rows."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{min(200, int(x))}" for x in rng.zipf(1.3, int(rng.integers(1, 50)))) for _ in range(160)]
    docs = spark.createDataFrame([*enumerate(texts), *((500 + i, t) for i, t in enumerate(texts[:30]))], "doc_id long, text string")
    once = bm25.search(docs.coalesce(1), docs).orderBy("query_id", "place").collect()
    monkeypatch.setattr(bm25, "FIRST", 1)
    monkeypatch.setattr(bm25, "WAVE", 2.0)
    monkeypatch.setattr(bm25, "BLOCKS_AT_ONCE", 2)
    waves = bm25.search(docs.repartition(9), docs, shard_docs=8, query_block=70).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.doc_id, r.place) for r in waves] == [(r.query_id, r.doc_id, r.place) for r in once]
    assert [r.score for r in waves] == pytest.approx([r.score for r in once], abs=2e-9)


# ---- chat ------------------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, None, None, "??"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (1, 2, "bob", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, size int")
    out = chat.rotated(df).collect()
    assert {(r.conv_id, r.perspective) for r in out} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    whole = {(r.conv_id, r.perspective): r for r in chat.assembled(chat.rotated(df)).collect()}
    ann = whole[1, "ann"]
    assert ann.text == "<|im_start|>user name=unknown\n??<|im_end|>\n<|im_start|>system\ns<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n" + 2 * "<|im_start|>user name=bob\n<|im_end|>\n"
    assert [ann.text[s["from"] : s["to"]] for s in ann.loss] == ["hi<|im_end|>"]
    assert chat.rotated(df.where("conv_id = 99")).count() == 0


# ---- mixing ----------------------------------------------------------------------------------------------------------------------


def water(sizes, weights=(5, 2, 1), ratio=1.5):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, budget, out = set(names), ratio * sum(sizes.values()), {}
    while left:
        total = sum(w[s] for s in left)
        over = [s for s in left if budget * w[s] / total >= 2 * sizes[s]]
        if not over:
            return out | {s: budget * w[s] / total for s in left}
        for s in over:
            out[s] = 2.0 * sizes[s]
        budget -= sum(out[s] for s in over)
        left -= set(over)
    return out


def test_mixing(odd, none, spark, sf):
    for df in (odd, table(spark, sf, "documents")):
        rows = mixing.mixed(df, slot_words=64).collect()
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += r.size
        want = water(dict(sizes))
        taken = collections.Counter()
        for r in rows:
            assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 1 for s in want)
        assert collections.Counter((r.doc_id, r.size) for r in rows) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t in texts(df))
        again = mixing.mixed(df.repartition(5), slot_words=64).collect()
        assert collections.Counter((r.doc_id, r.size, r.taken) for r in again) == collections.Counter((r.doc_id, r.size, r.taken) for r in rows)
    assert mixing.mixed(none).count() == 0


def test_schedule_covers_each_slot_and_text_output(odd):
    placed, slots = mixing.laid_out(odd, slot_words=64)
    per_slot = {r.slot: r.n for r in mixing.schedule(placed, slots).groupBy("slot").agg(F.sum("length").alias("n")).collect()}
    assert set(per_slot) == {r.slot for r in slots.collect()}
    clash = odd.withColumnsRenamed({"size": "slot", "key": "row", "bucket": "part"})
    assert mixing.sampled(clash, slot_words=64).columns == clash.columns
    out = mixing.sampled(odd, slot_words=64)
    assert out.columns == odd.columns
    words = sum(len(WORD.findall(r.text)) for r in out.select("text").collect())
    assert words == mixing.mixed(odd, slot_words=64).agg(F.sum("taken")).first()[0]


def test_any_run_of_slots_is_near_the_weights(spark):
    """The low-discrepancy property: sources' words in a prefix of the mix follow the targets, and the sample is written in that order."""
    rows = [(k, " ".join(["w"] * 40), f"s{k % 3}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, slots = mixing.laid_out(df, slot_words=256)
    words = mixing.schedule(placed, slots).groupBy("slot", "source").agg(F.sum("length").alias("n")).collect()
    target = {r.source: r.target for r in mixing.mixed(df, slot_words=256).collect()}
    total, last = sum(target.values()), max(r.slot for r in words)
    for cut_at in (last // 7, last // 3, last // 2):
        some = collections.Counter()
        for r in words:
            some[r.source] += r.n * (r.slot <= cut_at)
        assert all(abs(some[s] / sum(some.values()) - target[s] / total) < 0.03 for s in target)
    parts = collections.defaultdict(collections.Counter)  # the sample lies in partitions by runs of slots: each holds the sources near their weights
    for r in mixing.sampled(df, slot_words=256).groupBy(F.spark_partition_id().alias("p"), "source").count().collect():
        parts[r.p][r.source] += r["count"]
    assert all(abs(n[s] / sum(n.values()) - target[s] / total) < 0.1 for n in parts.values() for s in target)


# ---- packing ---------------------------------------------------------------------------------------------------------------------


def test_packing(odd, none, spark, sf):
    encode = packing.encoder(packing.default_tokenizer()[0])
    for df in (odd, table(spark, sf, "documents")):
        rows = packing.packed(df).collect()
        ids = collections.defaultdict(list)
        for i, t in texts(df):
            ids[i].append(np.append(encode(t or ""), 0).astype("<u4"))
        whole = collections.Counter()
        for r in rows:
            assert 0 < r.length <= 1024
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
            whole[r.doc_id] += r.length
        assert whole == {i: sum(map(len, xs)) for i, xs in ids.items()}
        sequences = collections.defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 1024
        assert len(sequences) <= -(-sum(whole.values()) // 1016) + 2
    assert packing.packed(none).count() == 0


def test_both_tokenizers_agree():
    fast, slow = packing.encoder(*packing.default_tokenizer()), packing.encoder(packing.default_tokenizer()[0])
    for t in ("Hello  world's 12\n\n x", "straße  déjà\tvu ½ ª²", "文字 mixed", "a<|endoftext|>b", "", "!" * 300, "   x"):
        assert fast(t).tolist() == slow(t).tolist()


def test_bins_for_skewed_lengths():
    rng = np.random.default_rng(3)
    many = [{700: 1000}, {1: 5, 1023: 2}, {600: 10, 424: 3}, {}, {k: 3 for k in range(1, 1024)}, {int(k): int(n) for k, n in zip(rng.integers(513, 1024, 80), rng.integers(1, 9, 80), strict=True)}, {511: 40, 513: 39, 5: 2}]
    for histogram in many:
        uses, bins = packing.plan_bins(dict(histogram))
        pieces, load = collections.defaultdict(list), collections.defaultdict(list)
        for tail, a, b, start, length, copies, nth, offset, first_bin in uses:
            for rank in range(a, b):
                j = nth + rank - a
                pieces[tail, rank].append((start, length))
                load[first_bin + j // copies].append((offset + j % copies * length, length))
        assert set(pieces) == {(k, r) for k, n in histogram.items() for r in range(n)}
        for line, end in [(x, k) for (k, _), x in pieces.items()] + [(x, None) for x in load.values()]:
            at = 0
            for start, length in sorted(line):
                assert start == at and length > 0
                at += length
            assert at == end if end else at <= 1024
        assert set(load) == set(range(bins))
        # padding beyond the slack is left only where nothing longer than it was left to cut
        assert sum(1024 - sum(n for _, n in x) > packing.MAX_SLACK for x in load.values()) <= 2


# ---- host rules ------------------------------------------------------------------------------------------------------------------


def test_host_rules(odd, none):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in host_rules.judge(odd).collect())
    want = collections.Counter()
    for i, t in texts(odd):
        t = t or ""
        w = WORD.findall(t)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        twice, covered, seen, dup = collections.Counter(grams), set(), set(), 0
        for k, g in enumerate(grams):
            covered |= {k, k + 1, k + 2} if twice[g] > 1 else set()
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert got == want
    kept = host_rules.judge(odd, keep_rows=True)
    assert {"text", "size", "kept"} <= set(kept.columns) and kept.count() == odd.count()
    assert host_rules.judge(none).count() == 0


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(k, good if k % 10 == 0 else "short", "bad") for k in range(300)] + [(1000 + k, good if k % 20 else "short", f"h{k % 9}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = host_rules.judge(df).collect()
    db = duckdb.connect()
    db.register("documents", df.toPandas())
    sql = db.sql(oracle.OP6)  # the registered query's SQL, where a host is rejected
    at = [sql.columns.index(c) for c in ("doc_id", "base_failed", "kept")]
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in out) == sorted(tuple(r[i] for i in at) for r in sql.fetchall())
    assert not any(r.kept for r in out if r.source == "bad") and all(r.kept != r.base_failed for r in out if r.source != "bad")


# ---- HTML ------------------------------------------------------------------------------------------------------------------------


def test_html(spark, sf, none):
    pages = table(spark, sf, "pages")
    got = {r.page_id: r.text for r in html_consensus.extracted(pages, broadcast_hosts=1).collect()}  # by the shuffled join
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", c)).split()) for c in re.split(r"</?(?:p|h1)>", m[1])]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_html_boilerplate_and_odd_pages(spark):
    page = (
        "<html><head><title>T</title></head><body><header class='site-header'>Head</header><div id=cookie-notice>We use cookies</div><div class='menu'><a href=/>Home</a></div>"
        "<main><article class='post-12'><h1>Title &amp; more</h1><p>First   para\n with <a href=x>a link</a> and &lt;tags&gt;.<p>Second&nbsp;para<form><input value=a>Send</form><script>var a='<p>no</p>'</script>"
        "<aside>Aside</aside><div class='ad'>Buy</div><ul><li>One<li>Two</ul></article><section class='comments'><p>A comment that is very long and goes on and on, longer than the article itself by some way.</p></section></main>"
        "<div class=sidebar>Side</div><footer>Foot</footer>"
    )
    open_head = "<html><head><title>No</title><meta charset=utf-8><body><article><header><h1>H</h1></header><figure><figcaption>Caption</figcaption></figure><table><tr><td>a<td>b</table></article>"
    rows = [(6, "http://d.example", open_head), (1, "http://a.example/1", page), (2, None, None), (3, "http://a.example/2", ""), (4, "http://b.example", "plain words only"), (5, "http://c.example", "<p>cut <b>off</b> &amp; in <a hre"), (1, "http://a.example/1", page)]
    out = html_consensus.extracted(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == 7 and got[6] == "H\nCaption\na\nb" and got[1] == "Title & more\nFirst para with a link and <tags>.\nSecond para\nOne\nTwo"
    assert got[2] == got[3] == "" and got[4] == "plain words only" and got[5] == "cut off & in"
    assert all(r.n_chars == len(r.text) for r in out)


PROSE = " ".join(f"Sentence {k} of the article says something plain." for k in range(12))


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f'<div class="layout with-sidebar"><div class="entry"><p>{PROSE}</p></div><div class="sidebar">Side words</div></div>', PROSE),
        (f'<form id="aspnetForm"><div class="menu"><a href="/">Home</a></div><div><p>{PROSE}</p><input name="q"></div></form>', PROSE),
        (f'<article><p>{PROSE}</p><p class="notice-board">On the board.</p><div class="search-tips">Tips.</div><div class="share-price">Price 12.</div></article>', f"{PROSE}\nOn the board.\nTips.\nPrice 12."),
        (f"<article><p>{PROSE}</p><math><mi>x</mi><mo>=</mo><mn>1</mn></math><object>Fallback</object></article>", f"{PROSE}\nx=1\nFallback"),
        (f'<div class="ad-container"><div class="content"><p>{PROSE}</p></div></div><div class="ad-box">Buy now</div>', PROSE),
        (f'<div class="page"><header><h1>Head</h1></header><div class="post"><p>{PROSE}</p></div><div id="comments"><p>{PROSE} {PROSE} {PROSE}</p></div><div style="display:none">No</div></div>', PROSE),
        ('<div class="notice"><p>Only a notice.</p></div><nav>Menu</nav>', "Only a notice."),
        ("<nav>Menu</nav><script>x</script>", ""),
    ],
)
def test_html_keeps_the_article_in_any_frame(body, want):
    page = html_consensus.Page(f"<html><body>{body}</body></html>")
    best = page.candidates()
    got = page.text_at(best[0][1] if best else None)
    assert got.replace("x\n=\n1", "x=1") == want


# ---- classifiers -----------------------------------------------------------------------------------------------------------------


def test_quality(spark, odd, none, labels):
    sf = "/root/testdata/sf0.01"
    docs, known = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = knn_quality.scored(docs, known).join(known, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)
    for r in got:
        assert (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert knn_quality.scored(odd, known).count() == odd.count()
    assert {r.score for r in knn_quality.scored(odd, labels.limit(0)).collect()} == {0.5}
    kept = knn_quality.scored(odd, known, keep=True)
    assert kept.columns == [*odd.columns, "_score"] and knn_quality.scored(none, known).count() == 0


def test_votes_are_exact_neighbours():
    rng = np.random.default_rng(0)
    x = rng.random((50, knn_quality.WIDTH)).astype(np.float32)
    v = knn_quality.Voter(x, rng.integers(0, 2, 50))
    q = rng.random((5, knn_quality.WIDTH)).astype(np.float32)
    p = q @ v.projection
    cos = (p / np.linalg.norm(p, axis=1, keepdims=True)) @ v.vectors.T
    for row, s in zip(cos, v.score(q), strict=True):
        near = np.argsort(-row)[: knn_quality.NEIGHBOURS]
        w = np.exp(knn_quality.SHARPNESS * (row[near] - row[near].max()))
        assert s == pytest.approx((w * v.labels[near]).sum() / w.sum(), abs=1e-5)


def test_tied_neighbours_all_vote():
    x = np.zeros((40, knn_quality.WIDTH), np.float32)
    x[:, :3] = np.random.default_rng(1).random((40, 3))
    x[10:] = x[10]  # thirty equal rows, more than the neighbours asked for
    labels = np.arange(40) % 2
    v = knn_quality.Voter(x.copy(), labels, rank=3)
    assert v.score(x[10:11])[0] == pytest.approx(labels[10:].mean(), abs=1e-3)


def test_repeated_ids_keep_the_samples_bound(spark, labels):
    rows = [(1, f"text {k}", "en") for k in range(500)] + [(k, f"word{k} more", "de") for k in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([(k % 40, k % 2) for k in range(400)], "doc_id long, quality int")
    assert 0 < len(knn_quality.fit(df, known, sample=20).labels) <= 20
    x = langid.fit(df)
    assert x is not None and x.langs == ["de", "en"]
    assert knn_quality.scored(df, known).count() == langid.predicted(df).count() == len(rows)


def test_more_languages_than_any_list():
    """Every language of the sample can be predicted, and predictions are plain pairwise votes on the same machines."""
    rng = np.random.default_rng(4)
    langs = [f"l{k:03d}" for k in range(12)] + ["en", "de", "fr", "es"]
    centre = {g: np.abs(rng.standard_normal(langid.WIDTH)).astype(np.float32) for g in langs}
    y = [g for g in langs for _ in range(6)]
    x = np.stack([c / np.linalg.norm(c) for c in (centre[g] + 0.1 * rng.random(langid.WIDTH).astype(np.float32) for g in y)])
    tree = langid.Tree(x, y)
    names, scores = tree.predict(x)
    assert names == y and ((scores >= 0) & (scores <= 1)).all()
    sigmoid = lambda m: 1 / (1 + math.exp(-max(-30, min(30, 4 * m))))
    for row, name, score in zip(x[::5], names[::5], scores[::5], strict=True):
        margin = {m: float(row @ tree.weights[:, k] + tree.biases[k]) for k, m in enumerate(tree.machines)}

        def shares(level, n):
            p = [math.prod([sigmoid(v) if i == c else 1 - sigmoid(v) for (at, i, j), v in margin.items() if at == level and c in (i, j)]) for c in range(n)]
            return [v / sum(p) for v in p]

        families = shares(-1, len(tree.families))
        f = families.index(max(families))
        own = shares(f, len(tree.families[f]))
        assert name == tree.families[f][own.index(max(own))] and score == pytest.approx(families[f] * max(own), abs=1e-4)


def test_language(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in got)
    out = {(r.doc_id, r.lang_pred) for r in langid.predicted(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und")} <= out and not {(5, "und"), (9, "und")} & out
    assert langid.predicted(none).count() == 0
    assert {r.lang_pred for r in langid.predicted(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- language model --------------------------------------------------------------------------------------------------------------


def test_backoff_on_odd_rows_and_small_chunks(odd, none):
    got = collections.Counter((r.doc_id, r.n_words, r.n_backoff, round(r.log_score, 3)) for r in backoff_lm.scored(odd, chunk_words=50, bucket_chars=500).collect())
    rows = [(i, WORD.findall(t or "")) for i, t in texts(odd)]
    one, two = collections.Counter(w for _, own in rows for w in own), collections.Counter(p for _, own in rows for p in zip(own, own[1:], strict=False))
    total, want = sum(one.values()), collections.Counter()
    for i, own in rows:
        score, alone = 0.0, 0
        for k, w in enumerate(own):
            if k and two[own[k - 1], w] >= 2:
                score += math.log(two[own[k - 1], w] / one[own[k - 1]])
            else:
                score += (math.log(0.4) if k else 0) + math.log(one[w] / total)
                alone += 1
        want[i, len(own), alone, round(score, 3)] += 1
    assert got == want
    assert backoff_lm.scored(none).count() == 0
