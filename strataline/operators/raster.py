"""Raster operators on pixel tables (image_id, y, x, v): what needs no whole image is relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.operators import kernels as K


def thresholded(pixels: DataFrame, above: float) -> DataFrame:
    """Pixels strictly above; only the lower bound acts."""
    return pixels.where(F.col("v") > above)


def neighbourhood(pixels: DataFrame, offsets: list[tuple[int, int]], agg: Column) -> DataFrame:
    """(image_id, y, x, v): an aggregate of `v` over every pixel's neighbourhood."""
    o = F.explode(F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in offsets]))
    spread = pixels.withColumn("o", o).select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "v")
    return spread.groupBy("image_id", "y", "x").agg(agg.alias("v")).join(pixels.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi")


def overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """(image_id, n1, n2, both, fraction1, fraction2) of two masks; empty masks have fraction 0."""
    keys = ["image_id", "y", "x"]
    marks = one.select(*keys, F.lit(1).alias("m1"), F.lit(0).alias("m2")).union(two.select(*keys, F.lit(0), F.lit(1)))
    cells = marks.groupBy(*keys).agg(F.max("m1").alias("m1"), F.max("m2").alias("m2"))
    n = cells.groupBy("image_id").agg(F.sum("m1").alias("n1"), F.sum("m2").alias("n2"), F.sum(F.col("m1") * F.col("m2")).alias("both"))
    share = lambda c: F.when(F.col(c) > 0, F.col("both") / F.col(c)).otherwise(0.0)
    return n.withColumns({"fraction1": share("n1"), "fraction2": share("n2")})


def contrast_stretched(pixels: DataFrame) -> DataFrame:
    """v scaled to 0..255 over each image's range; a flat image is 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return pixels.withColumn("v", F.when(hi > lo, (F.col("v") - lo) * 255.0 / (hi - lo)).otherwise(0.0))


def components(pixels: DataFrame, above: float, diagonal: bool = True) -> DataFrame:
    """(image_id, label, area, cy, cx, filled) of the components above a threshold."""

    def run(a, image):
        return K.components_of(a > above, diagonal).assign(image_id=image)[["image_id", "label", "area", "cy", "cx", "filled"]]

    return K.per_image(pixels, run, f"image_id {dict(pixels.dtypes)['image_id']}, label long, area long, cy double, cx double, filled long")


def split_components(pixels: DataFrame, low: float, mid: float, min_area: int, max_area: int) -> DataFrame:
    """(image_id, area, cy, cx): components above `low` of min <= area < max, and in place of larger ones their parts above `mid`."""

    def run(a, image):
        import pandas as pd

        label = K.labelled(a > low)
        first = K.components_of(a > low)
        keep = first[(first["area"] >= min_area) & (first["area"] < max_area)]
        parts = [keep]
        for k in first[first["area"] >= max_area]["label"]:
            inner = K.components_of((label == k) & (a > mid))
            parts.append(inner[(inner["area"] >= min_area) & (inner["area"] < max_area)])
        return pd.concat(parts).assign(image_id=image)[["image_id", "area", "cy", "cx"]]

    return K.per_image(pixels, run, f"image_id {dict(pixels.dtypes)['image_id']}, area long, cy double, cx double")


def morphology(pixels: DataFrame, above: float, operation: str, radius: int = 1) -> DataFrame:
    """The pixels of a mask after erode, dilate, open, close, gradient, skeleton or fill."""
    plain = {"erode": K.eroded, "dilate": K.dilated, "open": K.opened, "close": K.closed, "gradient": K.gradient}

    def run(a, image):
        m = a > above
        out = plain[operation](m, K.square(radius)) if operation in plain else K.skeleton(m) if operation == "skeleton" else K.filled_holes(m, radius)
        return K.mask_rows(out, image)

    return K.per_image(pixels, run, f"image_id {dict(pixels.dtypes)['image_id']}, y int, x int")


def component_class(reachable: Column, area: Column, distance: Column, bridge_area: int = 200, bridge_mm: float = 2.0, projection_mm: float = 20.0) -> Column:
    """struct(kind, score): bridge between large blobs, far projection, or protrusion."""
    bridge = F.struct(F.lit("bridge").alias("kind"), (10.0 * (reachable - 1) + distance / 2 * (reachable - 1)).alias("score"))
    projection = F.struct(F.lit("projection").alias("kind"), (0.5 * distance / 5).alias("score"))
    return F.when((reachable >= 2) & (area >= bridge_area) & (distance > bridge_mm), bridge).when(distance > projection_mm, projection).otherwise(F.struct(F.lit("protrusion").alias("kind"), F.lit(0.05).alias("score")))


def label_table(pixels: DataFrame, above: float, up_to: float = float("inf"), diagonal: bool = True) -> DataFrame:
    """(image_id, y, x, label, area) of the pixels in (above, up_to], by connected component of an image."""

    def run(a, image):
        label = K.labelled((a > above) & (a <= up_to), diagonal)
        return K.mask_rows(label > 0, image).assign(label=label[label > 0])

    rows = K.per_image(pixels, run, f"image_id {dict(pixels.dtypes)['image_id']}, y int, x int, label long")
    areas = rows.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area"))
    return rows.join(areas, ["image_id", "label"]).select("image_id", "y", "x", "label", "area")


def contacts(one: DataFrame, two: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(image_id, label, other, other_area): components of `one` and `two` (label tables) with a pixel of the other at some offset."""
    o = F.explode(F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in offsets]))
    spread = one.withColumn("o", o).select("image_id", "label", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    other = two.select("image_id", "y", "x", F.col("label").alias("other"), F.col("area").alias("other_area"))
    return spread.join(other, ["image_id", "y", "x"]).select("image_id", "label", "other", "other_area").distinct()


def attached_interfaces(interface: DataFrame, solid: DataFrame, *, touch: int = 1, large: int, min_attached: float, max_ratio: float = 1.0) -> DataFrame:
    """(image_id, label, area, attached, attached_large, ratio, kept): interface components and the solid ones within `touch` pixels.

    A component is kept if a solid one of at least `large` pixels touches it, or if those that touch it have `min_attached` pixels together and
    it is at most `max_ratio` times as large as they are. Without any, attached is 0 and the ratio null.
    """
    met = contacts(interface, solid, [o for o in K.square(touch) if o != (0, 0)])
    sums = met.groupBy("image_id", "label").agg(F.sum("other_area").alias("attached"), F.sum(F.when(F.col("other_area") >= large, F.col("other_area")).otherwise(0)).alias("attached_large"))
    rows = interface.select("image_id", "label", "area").distinct().join(sums, ["image_id", "label"], "left").na.fill(0, ["attached", "attached_large"])
    rows = rows.withColumn("ratio", F.when(F.col("attached") > 0, F.col("area") / F.col("attached")))
    kept = (F.col("attached_large") > 0) | ((F.col("attached") >= min_attached) & (F.coalesce(F.col("ratio"), F.lit(0.0)) <= max_ratio))
    return rows.withColumn("kept", kept)


def classified_components(far: DataFrame, solid: DataFrame, *, reach: int = 10, large: int = 200, unit: float = 1.0, **rule) -> DataFrame:
    """(image_id, label, area, reachable, distance, kind, score): far components by the large solid ones a disc of `reach` around them meets.

    distance is that of the component's pixel farthest from those, times `unit`; 0 if there is none.
    """
    big = solid.where(F.col("area") >= large)
    met = contacts(far, big, K.disc(reach)).select("image_id", "label", "other")
    inside = far.select("image_id", "label", F.col("y").alias("fy"), F.col("x").alias("fx")).join(met, ["image_id", "label"])
    pairs = inside.join(big.select("image_id", F.col("label").alias("other"), "y", "x"), ["image_id", "other"])
    squared = (F.col("fy") - F.col("y")) * (F.col("fy") - F.col("y")) + (F.col("fx") - F.col("x")) * (F.col("fx") - F.col("x"))
    nearest = pairs.groupBy("image_id", "label", "fy", "fx").agg(F.min(squared).alias("_d"))
    reachable = met.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("reachable"))
    farthest = nearest.groupBy("image_id", "label").agg((F.sqrt(F.max("_d")) * unit).alias("distance"))
    rows = far.select("image_id", "label", "area").distinct().join(reachable, ["image_id", "label"], "left").join(farthest, ["image_id", "label"], "left").na.fill(0, ["reachable", "distance"])
    c = component_class(F.col("reachable"), F.col("area"), F.col("distance"), **rule)
    return rows.withColumn("_c", c).select("image_id", "label", "area", "reachable", "distance", "_c.kind", "_c.score")


def closing_radii(pixels: DataFrame, above: float, share: float = 0.4, least: int = 2, most: int = 20) -> DataFrame:
    """(image_id, radius): a share of the median distance of the mask's pixels from what is outside it, whole and held to least..most."""

    def run(a, image):
        import numpy as np
        import pandas as pd

        d = K.distance_transform(a > above)
        d = d[d > 0]
        return pd.DataFrame({"image_id": [image], "radius": [max(least, min(round(share * float(np.median(d))), most)) if len(d) else least]})

    return K.per_image(pixels, run, f"image_id {dict(pixels.dtypes)['image_id']}, radius int")


def overlaid(one: DataFrame, two: DataFrame, share: float = 0.5) -> DataFrame:
    """(image_id, y, x, v): both images stretched and mixed; where only one has a pixel, the other counts as 0."""
    a, b = contrast_stretched(one), contrast_stretched(two).withColumnRenamed("v", "_w")
    v = share * F.coalesce("v", F.lit(0.0)) + (1 - share) * F.coalesce("_w", F.lit(0.0))
    return a.join(b, ["image_id", "y", "x"], "full").select("image_id", "y", "x", v.alias("v"))
