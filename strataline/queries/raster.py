"""Raster queries: embeddings are an image, a row a vector, its numbers the pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import kernels as K
from strataline.operators import raster as R
from strataline.queries import query
from strataline.session import table

PIX = "pix AS (SELECT CAST(vec_id // 100 AS BIGINT) AS image_id, CAST(vec_id % 100 AS INT) AS y, CAST(x - 1 AS INT) AS x, floor(CAST(embedding[x] AS DOUBLE) * 1000) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS x))"


def pixels(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return e.select(F.floor(F.col("vec_id") / 100).alias("image_id"), (F.col("vec_id") % 100).cast("int").alias("y"), "x", F.floor(F.col("e").cast("double") * 1000).cast("double").alias("v"))


@query(f"WITH {PIX} SELECT image_id, count(*) AS n FROM pix WHERE v > 100 GROUP BY image_id")
def img01_threshold(spark, d):
    return R.thresholded(pixels(spark, d), 100).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PIX} SELECT a.image_id, a.y, a.x, max(b.v) AS v FROM pix a JOIN pix b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL")
def img06_dilated_values(spark, d):
    return R.neighbourhood(pixels(spark, d), K.square(1), F.max("v"))


@query(f"""WITH {PIX}, c AS (SELECT image_id, count(*) FILTER (v > 50) AS n1, count(*) FILTER (v < 100) AS n2, count(*) FILTER (v > 50 AND v < 100) AS "both" FROM pix GROUP BY 1)
SELECT *, CASE WHEN n1 > 0 THEN "both" / n1 ELSE 0.0 END AS fraction1, CASE WHEN n2 > 0 THEN "both" / n2 ELSE 0.0 END AS fraction2 FROM c""")
def img11_agg24_jn21_overlap(spark, d):
    p = pixels(spark, d)
    return R.overlap(p.where("v > 50"), p.where("v < 100"))


@query(f"WITH {PIX} SELECT image_id, count(*) FILTER (v > 50 AND NOT v > 100) AS minus, count(*) FILTER (v > 50 OR v < -50) AS either FROM pix GROUP BY 1")
def set08_mask_algebra(spark, d):
    v = F.col("v")
    return pixels(spark, d).groupBy("image_id").agg(F.count_if((v > 50) & ~(v > 100)).alias("minus"), F.count_if((v > 50) | (v < -50)).alias("either"))


@query(f"WITH {PIX} SELECT image_id, y, x, CASE WHEN max(v) OVER w > min(v) OVER w THEN round((v - min(v) OVER w) * 255.0 / (max(v) OVER w - min(v) OVER w), 6) ELSE 0.0 END AS v FROM pix WINDOW w AS (PARTITION BY image_id)")
def img13_contrast(spark, d):
    return R.contrast_stretched(pixels(spark, d)).withColumn("v", F.round("v", 6))


@query(f"WITH {PIX}, d AS (SELECT a.image_id, a.y, a.x, sum(CASE WHEN b.v > 0 THEN 1 ELSE 0 END) / 13 AS v FROM pix a JOIN pix b ON a.image_id = b.image_id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4 GROUP BY 1, 2, 3) SELECT image_id, count(*) AS far FROM d WHERE v <= 0.25 GROUP BY 1")
def img09_far_pixels(spark, d):
    density = R.neighbourhood(pixels(spark, d), K.disc(2), F.sum(F.when(F.col("v") > 0, 1).otherwise(0)) / 13)
    return density.where("v <= 0.25").groupBy("image_id").agg(F.count(F.lit(1)).alias("far"))


@query(f"""WITH {PIX}, c AS (SELECT image_id, y, x, y % 4 AS n, y * 10 + x AS area, x * 1.0 AS dist FROM pix) SELECT image_id, y, x, CASE WHEN n >= 2 AND area >= 200 AND dist > 2 THEN 'bridge' WHEN dist > 20 THEN 'projection' ELSE 'protrusion' END AS kind,
CASE WHEN n >= 2 AND area >= 200 AND dist > 2 THEN 10.0 * (n - 1) + dist / 2 * (n - 1) WHEN dist > 20 THEN 0.5 * dist / 5 ELSE 0.05 END AS score FROM c""")
def img10_cls05_component_class(spark, d):
    p = pixels(spark, d)
    c = R.component_class(F.col("y") % 4, F.col("y") * 10 + F.col("x"), F.col("x").cast("double"))
    return p.select("image_id", "y", "x", c.alias("c")).select("image_id", "y", "x", "c.kind", "c.score")


def _pairs_sql(low):
    return f"""WITH RECURSIVE {PIX}, m AS (SELECT image_id, y, x, y * 64 + x AS id FROM pix WHERE v > {low}), e AS (SELECT a.image_id, a.id AS a, b.id AS b FROM m a JOIN m b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r(image_id, node, root) AS (SELECT image_id, a, a FROM e UNION SELECT e.image_id, e.b, r.root FROM r JOIN e ON e.image_id = r.image_id AND e.a = r.node), l AS (SELECT image_id, node, min(root) AS root FROM r GROUP BY 1, 2)
SELECT image_id, root, count(*) AS area, round(avg(node // 64), 6) AS cy, round(avg(node % 64), 6) AS cx FROM l GROUP BY 1, 2"""


@query(f"SELECT image_id, area, cy, cx FROM ({_pairs_sql(150)})")
def img02_components(spark, d):
    return R.components(pixels(spark, d), 150).select("image_id", "area", F.round("cy", 6).alias("cy"), F.round("cx", 6).alias("cx"))


@query()
def img03_split_components(spark, d):
    return R.split_components(pixels(spark, d), 80, 160, 2, 200)


@query()
def img04_contour_areas(spark, d):
    return R.components(pixels(spark, d), 120).select("image_id", "label", "area", "filled")


@query()
def img05_filled_holes(spark, d):
    return R.morphology(pixels(spark, d), 60, "fill", 6)


@query()
def img06_opened(spark, d):
    return R.morphology(pixels(spark, d), 20, "open")


@query()
def img06_skeleton(spark, d):
    return R.morphology(pixels(spark, d), 40, "skeleton")


@query()
def img07_distance_transform(spark, d):
    def run(a, image):
        t = K.distance_transform(a > 0)
        out = K.mask_rows(t > 0, image)
        return out.assign(distance=t[t > 0])

    return K.per_image(pixels(spark, d), run, "image_id long, y int, x int, distance double")


@query()
def img08_ray_pairs(spark, d):
    import numpy as np

    def run(a, image):
        out = K.mask_rows(a < -100, image)
        return out.assign(bridged=K.ray_hits(a > 150, np.column_stack([out["y"], out["x"]]), 48, 12))

    return K.per_image(pixels(spark, d), run, "image_id long, y int, x int, bridged boolean")


@query()
def img12_jn20_attached_interfaces(spark, d):
    p = pixels(spark, d)
    return R.attached_interfaces(R.label_table(p, 60, 150), R.label_table(p, 150), large=20, min_attached=4)


@query()
def img10_cls05_classified_components(spark, d):
    p = pixels(spark, d)
    return R.classified_components(R.label_table(p, 60, 150), R.label_table(p, 150), reach=6, large=12, unit=0.5, bridge_area=20, projection_mm=3.0)


@query()
def img13_closing_radii(spark, d):
    return R.closing_radii(pixels(spark, d), -100)


@query(f"""WITH {PIX}, s AS (SELECT image_id, y, x, v, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) * 255.0 / (max(v) OVER w - min(v) OVER w) ELSE 0.0 END AS a FROM pix WINDOW w AS (PARTITION BY image_id)),
m AS (SELECT image_id, y, x, CASE WHEN max(-v) OVER w > min(-v) OVER w THEN (-v - min(-v) OVER w) * 255.0 / (max(-v) OVER w - min(-v) OVER w) ELSE 0.0 END AS b FROM pix WINDOW w AS (PARTITION BY image_id))
SELECT image_id, y, x, round(0.25 * a + 0.75 * b, 6) AS v FROM s JOIN m USING (image_id, y, x)""")
def img13_overlay(spark, d):
    p = pixels(spark, d)
    return R.overlaid(p, p.withColumn("v", -F.col("v")), 0.25).withColumn("v", F.round("v", 6))
