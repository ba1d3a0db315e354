"""Kernels that run once a group (a structure, a point set, an image, a pair) inside applyInPandas."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def framed(columns: dict[str, object]) -> pd.DataFrame:
    """A group's result. One without rows has no columns either: Arrow can't make a column of texts of an empty list."""
    out = pd.DataFrame(columns)
    return out if len(out) else pd.DataFrame()


# ---- triangulations --------------------------------------------------------------------------------------------------------------


def _spheres(p: np.ndarray, simplices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of simplices' circumspheres; flat ones get an infinite radius."""
    a = p[simplices[:, 0]]
    m = p[simplices[:, 1:]] - a[:, None, :]
    with np.errstate(all="ignore"):
        flat = np.abs(np.linalg.det(m)) < 1e-12
        m[flat] = np.eye(p.shape[1])
        c = np.linalg.solve(m, ((m * m).sum(axis=2) / 2)[..., None])[..., 0]
    r = (c * c).sum(axis=1)
    r[flat] = np.inf
    return a + c, r


def delaunay(points: np.ndarray) -> np.ndarray:
    """Simplices of the Delaunay triangulation in two or three dimensions, by insertion in input order.

    Repeated points are left out; fewer than dimension + 1 distinct points have none. Points are shifted by nothing: degenerate sets give one
    of their triangulations.
    """
    points = np.asarray(points, float)
    _, first = np.unique(points, axis=0, return_index=True)
    first = np.sort(first)
    n, dim = len(first), points.shape[1]
    if n < dim + 1:
        return np.zeros((0, dim + 1), int)
    own = points[first]
    mid, span = own.mean(axis=0), max(1e-9, np.ptp(own, axis=0).max())
    outer = mid + span * 1e3 * np.vstack([np.full(dim, -1.0), np.eye(dim) * (dim + 1) - 1.0])
    p = np.vstack([own, outer])
    simplices = np.array([list(range(n, n + dim + 1))])
    centres, radii = _spheres(p, simplices)
    for k in range(n):
        gap = ((centres - p[k]) ** 2).sum(axis=1)
        bad = gap < radii * (1 + 1e-12)
        faces: dict[tuple, int] = {}
        for s in simplices[bad].tolist():
            for f in combinations(sorted(s), dim):
                faces[f] = faces.get(f, 0) + 1
        new = np.array([[*f, k] for f, times in faces.items() if times == 1], int).reshape(-1, dim + 1)
        c, r = _spheres(p, new)
        solid = np.isfinite(r)
        simplices = np.vstack([simplices[~bad], new[solid]])
        centres, radii = np.vstack([centres[~bad], c[solid]]), np.append(radii[~bad], r[solid])
    return first[simplices[(simplices < n).all(axis=1)]]


def simplex_edges(simplices: np.ndarray) -> np.ndarray:
    if not len(simplices):
        return np.zeros((0, 2), int)
    pairs = np.vstack([simplices[:, list(c)] for c in combinations(range(simplices.shape[1]), 2)])
    return np.unique(np.sort(pairs, axis=1), axis=0)


def hull_facets(points: np.ndarray) -> np.ndarray:
    """Facets of a three-dimensional convex hull, outward orientation, by adding one point after the other: the facets it sees give way to those over their rim.

    Points within rounding of the hull are no corners; sets in one plane have no facets.
    """
    p = np.asarray(points, float)
    if len(p) < 4:
        return np.zeros((0, 3), int)
    eps = 1e-12 * max(1e-300, np.ptp(p, axis=0).max())
    first = int(np.argmin(p[:, 0]))
    second = int(np.argmax(((p - p[first]) ** 2).sum(axis=1)))
    along = p[second] - p[first]
    off = np.linalg.norm(np.cross(p - p[first], along), axis=1)
    third = int(np.argmax(off))
    normal = np.cross(along, p[third] - p[first])
    height = (p - p[first]) @ normal
    fourth = int(np.argmax(np.abs(height)))
    if off[third] <= eps * np.linalg.norm(along) or abs(height[fourth]) <= eps * np.linalg.norm(normal):
        return np.zeros((0, 3), int)
    start = [first, second, third, fourth]
    inside = p[start].mean(axis=0)

    def planes(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
        n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
        d = (n * p[f[:, 0]]).sum(axis=1)
        turned = n @ inside > d
        f = np.where(turned[:, None], f[:, [0, 2, 1]], f)
        return f, np.where(turned[:, None], -n, n), np.where(turned, -d, d)

    facets, normals, offsets = planes(np.array(list(combinations(start, 3))))
    for k in range(len(p)):
        seen = normals @ p[k] - offsets > eps
        if k in start or not seen.any():
            continue
        sides = {(int(f[i]), int(f[i - 2])) for f in facets[seen] for i in range(3)}
        rim = [(a, b) for a, b in sides if (b, a) not in sides]
        f, n, d = planes(np.array([(a, b, k) for a, b in sorted(rim)]))
        facets, normals, offsets = np.vstack([facets[~seen], f]), np.vstack([normals[~seen], n]), np.append(offsets[~seen], d)
    return facets


def surface_facets(points: np.ndarray, tets: np.ndarray) -> np.ndarray:
    """Faces of one tetrahedron alone, oriented outwards."""
    owner: dict[tuple, list] = {}
    for t in tets.tolist():
        for k in range(4):
            owner.setdefault(tuple(sorted(t[:k] + t[k + 1 :])), []).append(t[k])
    out = []
    for f, apex in sorted(owner.items()):
        if len(apex) == 1:
            a, b, c = (points[i] for i in f)
            side = np.dot(np.cross(b - a, c - a), points[apex[0]] - a)
            out.append([f[0], f[2], f[1]] if side > 0 else list(f))
    return np.array(out, int).reshape(-1, 3)


def carved(points: np.ndarray, max_radius: float) -> np.ndarray:
    """Tetrahedra left after exposed ones with a larger circumsphere are peeled off until nothing changes."""
    tets = delaunay(points)
    if not len(tets):
        return tets
    large = _spheres(points, tets)[1] > max_radius * max_radius
    alive = np.ones(len(tets), bool)
    faces = [[tuple(sorted(t[:k] + t[k + 1 :])) for k in range(4)] for t in tets.tolist()]
    while True:
        count: dict[tuple, int] = {}
        for i in np.flatnonzero(alive):
            for f in faces[i]:
                count[f] = count.get(f, 0) + 1
        peel = [i for i in np.flatnonzero(alive & large) if any(count[f] == 1 for f in faces[i])]
        if not peel:
            return tets[alive]
        alive[peel] = False


def triangulated(points: DataFrame, group: str, coords: tuple[str, ...] = ("x", "y", "z"), max_edge: float = float("inf")) -> DataFrame:
    """(group, a, b, distance): edges of each group's Delaunay triangulation shorter than a cutoff, by the points' ids."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        p, ids = pdf[list(coords)].to_numpy(float), pdf["id"].to_numpy()
        e = simplex_edges(delaunay(p))
        d = np.sqrt(((p[e[:, 0]] - p[e[:, 1]]) ** 2).sum(axis=1))
        keep = d < max_edge
        return framed({group: [pdf[group].iloc[0]] * int(keep.sum()), "a": ids[e[keep, 0]], "b": ids[e[keep, 1]], "distance": d[keep]})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return points.select(group, "id", *coords).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, a {kinds['id']}, b {kinds['id']}, distance double")


def surfaces(points: DataFrame, group: str, max_radius: float = float("inf")) -> DataFrame:
    """(group, a, b, c): outward facets of each group's carved surface; an infinite radius gives the convex hull."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        p, ids = pdf[["x", "y", "z"]].to_numpy(float), pdf["id"].to_numpy()
        f = hull_facets(p) if np.isinf(max_radius) else surface_facets(p, carved(p, max_radius))
        return framed({group: [pdf[group].iloc[0]] * len(f), "a": ids[f[:, 0]], "b": ids[f[:, 1]], "c": ids[f[:, 2]]})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return points.select(group, "id", "x", "y", "z").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, a {kinds['id']}, b {kinds['id']}, c {kinds['id']}")


# ---- rasters ---------------------------------------------------------------------------------------------------------------------


def labelled(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Component numbers from 1 in scan order, 0 outside."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    shifts = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    up = np.arange(h * w + 1)
    for dy, dx in shifts:
        a = label[: h - dy, max(0, -dx) : w - max(0, dx)]
        b = label[dy:, max(0, dx) : w - max(0, -dx)]
        both = (a > 0) & (b > 0)
        for x, y in zip(a[both].tolist(), b[both].tolist(), strict=True):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            while up[y] != y:
                up[y] = up[up[y]]
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
    while (up != up[up]).any():
        up = up[up]
    root = up[label]
    kinds = np.unique(root[root > 0])
    return np.where(root > 0, np.searchsorted(kinds, root) + 1, 0)


def shifted_max(a: np.ndarray, offsets: list[tuple[int, int]], fill=0) -> np.ndarray:
    h, w = a.shape
    r = max(max(abs(y), abs(x)) for y, x in offsets)
    padded = np.pad(a, r, constant_values=fill)
    return np.max([padded[r + y : r + y + h, r + x : r + x + w] for y, x in offsets], axis=0)


def disc(r: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if y * y + x * x <= r * r]


def square(r: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1)]


def dilated(m: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return shifted_max(m.astype(bool), offsets, False)


def eroded(m: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return ~shifted_max(~m.astype(bool), offsets, False)


def opened(m, offsets):
    return dilated(eroded(m, offsets), offsets)


def closed(m, offsets):
    return eroded(dilated(m, offsets), offsets)


def gradient(m, offsets):
    return dilated(m, offsets) & ~eroded(m, offsets)


def filled_holes(mask: np.ndarray, smaller_than: float = float("inf")) -> np.ndarray:
    """The mask with holes (background that doesn't touch the border) of less than an area filled."""
    holes = labelled(~mask.astype(bool), diagonal=False)
    edge = np.unique(np.concatenate([holes[0], holes[-1], holes[:, 0], holes[:, -1]]))
    area = np.bincount(holes.ravel())
    fill = np.ones(len(area), bool)
    fill[edge] = False
    fill[0] = False
    return mask.astype(bool) | (fill & (area < smaller_than))[holes]


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of every foreground pixel to the nearest background one, exactly: columns first, then lower envelopes by rows."""
    h, w = mask.shape
    far = float(h + w) * 2
    g = np.where(mask, far, 0.0)
    for y in range(1, h):
        g[y] = np.minimum(g[y], g[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        g[y] = np.minimum(g[y], g[y + 1] + 1)
    x = np.arange(w)
    return np.sqrt(((x[None, :] - x[:, None]) ** 2 + (g * g)[:, None, :]).min(axis=2))


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    r = int(np.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    blur = lambda v: np.convolve(np.pad(v, r, mode="edge"), k, mode="valid")
    return np.apply_along_axis(blur, 0, np.apply_along_axis(blur, 1, a.astype(float)))


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Thinning to lines one pixel wide, in two alternating passes until nothing changes."""
    m = np.pad(mask.astype(np.uint8), 1)
    while True:
        before = m.copy()
        for odd in (0, 1):
            n = [m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:], m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]]
            count = sum(x.astype(int) for x in n)
            turns = sum(((n[k] == 0) & (n[(k + 1) % 8] == 1)).astype(int) for k in range(8))
            one, two = (n[0] * n[2] * n[4], n[2] * n[4] * n[6]) if not odd else (n[0] * n[2] * n[6], n[0] * n[4] * n[6])
            drop = (m[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & (one == 0) & (two == 0)
            m[1:-1, 1:-1][drop] = 0
        if (m == before).all():
            return m[1:-1, 1:-1].astype(bool)


def ray_hits(mask: np.ndarray, starts: np.ndarray, angles: int = 48, reach: int = 50) -> np.ndarray:
    """Whether, from each start, some ray and its opposite both meet the mask within reach."""
    h, w = mask.shape
    turn = np.arange(angles) * 2 * np.pi / angles
    r = np.arange(1, reach + 1)
    y = np.rint(starts[:, 0, None, None] + np.sin(turn)[None, :, None] * r).astype(int)
    x = np.rint(starts[:, 1, None, None] + np.cos(turn)[None, :, None] * r).astype(int)
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    hit = (inside & mask[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]).any(axis=2)
    return (hit & np.roll(hit, angles // 2, axis=1)).any(axis=1)


def disc_density(mask: np.ndarray, r: int) -> np.ndarray:
    """Share of foreground in the disc around every pixel; beyond the border is background."""
    offsets = disc(r)
    padded = np.pad(mask.astype(float), r)
    h, w = mask.shape
    return sum(padded[r + y : r + y + h, r + x : r + x + w] for y, x in offsets) / len(offsets)


def components_of(mask: np.ndarray, diagonal: bool = True) -> pd.DataFrame:
    """(label, area, cy, cx, filled): components with area, centroid and the area inside their outer contour."""
    label = labelled(mask, diagonal)
    y, x = np.nonzero(label)
    frame = pd.DataFrame({"label": label[y, x], "y": y, "x": x})
    box = frame.groupby("label").agg(area=("y", "size"), cy=("y", "mean"), cx=("x", "mean"), y0=("y", "min"), y1=("y", "max"), x0=("x", "min"), x1=("x", "max")).reset_index()

    def filled(k: int, y0: int, y1: int, x0: int, x1: int, area: int) -> int:
        if y1 - y0 < 2 or x1 - x0 < 2:
            return area
        return int(filled_holes(np.pad(label[y0 : y1 + 1, x0 : x1 + 1] == k, 1)).sum())

    box["filled"] = [filled(*r) for r in box[["label", "y0", "y1", "x0", "x1", "area"]].itertuples(index=False)]
    return box[["label", "area", "cy", "cx", "filled"]]


def per_image(pixels: DataFrame, kernel, schema: str, image: str = "image_id") -> DataFrame:
    """`kernel(array, image_id) -> DataFrame` on every image of a pixel table (image_id, y, x, v); missing pixels are 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), pdf["v"].to_numpy().dtype)
        a[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf["v"].to_numpy()
        return kernel(a, pdf[image].iloc[0])

    return pixels.groupBy(image).applyInPandas(run, schema)


def mask_rows(mask: np.ndarray, image) -> pd.DataFrame:
    y, x = np.nonzero(mask)
    return pd.DataFrame({"image_id": [image] * len(y), "y": y.astype("int32"), "x": x.astype("int32")})


# ---- alignments ------------------------------------------------------------------------------------------------------------------


def global_alignment(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1) -> tuple[str, str, int]:
    """One best global alignment with linear gaps; on ties the diagonal comes first, then a gap in b."""
    n, m = len(a), len(b)
    s = np.zeros((n + 1, m + 1), np.int64)
    s[:, 0], s[0] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    steps = gap * np.arange(m + 1)
    for i in range(1, n + 1):
        same = np.fromiter((match if a[i - 1] == ch else mismatch for ch in b), np.int64, m)
        row = s[i].copy()
        row[1:] = np.maximum(s[i - 1, :-1] + same, s[i - 1, 1:] + gap)
        s[i] = np.maximum.accumulate(row - steps) + steps  # gaps in a run along the row
    left, right, i, j = [], [], n, m
    while i or j:
        if i and j and s[i, j] == s[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            left.append(a[i])
            right.append(b[j])
        elif i and s[i, j] == s[i - 1, j] + gap:
            i -= 1
            left.append(a[i])
            right.append("-")
        else:
            j -= 1
            left.append("-")
            right.append(b[j])
    return "".join(reversed(left)), "".join(reversed(right)), int(s[n, m])


def aligned_pairs(pairs: DataFrame, a: str, b: str, align=global_alignment) -> DataFrame:
    """`pairs` with aligned1, aligned2 and score; `align` is the place for an external aligner."""

    def run(batches):
        for pdf in batches:
            got = [align(x or "", y or "") for x, y in zip(pdf[a], pdf[b], strict=True)]
            yield pdf.assign(aligned1=[g[0] for g in got], aligned2=[g[1] for g in got], score=[g[2] for g in got])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(run, f"{schema}, aligned1 string, aligned2 string, score long")


def external(rows: DataFrame, schema: str, tool) -> DataFrame:
    """Rows through a plugged-in tool: `tool(DataFrame) -> DataFrame`, a batch at a time (structural aligners, searches, pocket finders)."""

    def run(batches):
        for pdf in batches:
            yield tool(pdf)

    return rows.mapInPandas(run, schema)


def only_one(**inputs):
    """(name, value) of the one input that is given; tools that read a file, a list file or a list take exactly one of them."""
    given = [(k, v) for k, v in inputs.items() if v is not None]
    if len(given) != 1:
        raise ValueError(f"exactly one of {', '.join(inputs)} must be given")
    return given[0]


def stale(spark, source: str, index: str) -> bool:
    """Whether a search index must be built again: it isn't there, or its source has changed since, by Spark's own file system."""
    at = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, index)]
    fs = [p.getFileSystem(spark._jsc.hadoopConfiguration()) for p in at]
    return not fs[1].exists(at[1]) or fs[0].getFileStatus(at[0]).getModificationTime() > fs[1].getFileStatus(at[1]).getModificationTime()
