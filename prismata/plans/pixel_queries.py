"""Queries over pixels: crops of images made smaller, and JPEG files written by tasks and decoded again.

A vector of ``embeddings`` gives each image its values; sizes differ from row to row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import geometry as G
from ..sources import images as IM
from ..sources import manifest as M
from .image_queries import folder
from .schedule_queries import SEED, draw_sql
from .vector_queries import E, rows

ENTRIES: dict = {}


def entry(name, sql):
    def add(f):
        ENTRIES[name] = (f, sql)
        return f

    return add


def _images(spark, sf_dir):
    """Images of one channel, from 16 to 24 pixels high and 18 to 22 wide."""
    k = F.col("vec_id")
    held = rows(spark, sf_dir).select("vec_id", F.transform("v", G.to_byte).alias("b"), (16 + k % 9).cast("int").alias("h"), (18 + k % 5).cast("int").alias("w"))
    cells = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda c: F.get("b", ((F.floor(c / F.col("w")) * 3 + c % F.col("w") * 7) % 64).cast("int")))
    return held.select("vec_id", "h", "w", cells.alias("pixels"))


def _shrunk_sql(target, side, top, left):
    """The images in SQL, resampled pass by pass with taps computed there, and a crop."""
    def step(k, kind, new):
        height, width = new
        return f"""z{k} AS (SELECT *, {height} AS nh, {width} AS nw FROM y{k - 1}),
t{k} AS MATERIALIZED ({_taps_sql(f'(SELECT w AS size, nw AS new FROM z{k} UNION SELECT h, nh FROM z{k})', kind)}),
a{k} AS (SELECT vec_id, y, o AS x, floor(least(255, greatest(0, round(sum(weight * p), 9))) + 0.5) AS p FROM p{k - 1} JOIN z{k} USING (vec_id) JOIN t{k} ON size = w AND new = nw AND i = x GROUP BY ALL),
p{k} AS MATERIALIZED (SELECT vec_id, o AS y, x, floor(least(255, greatest(0, round(sum(weight * p), 9))) + 0.5) AS p FROM a{k} JOIN z{k} USING (vec_id) JOIN t{k} ON size = h AND new = nh AND i = y GROUP BY ALL),
y{k} AS (SELECT vec_id, target, nh AS h, nw AS w FROM z{k})"""

    halved = ("CASE WHEN least(h, w) >= 2 * target THEN h // 2 ELSE h END", "CASE WHEN least(h, w) >= 2 * target THEN w // 2 ELSE w END")
    final = ("round_even(h * (target / least(h, w)), 0)::BIGINT", "round_even(w * (target / least(h, w)), 0)::BIGINT")
    value = "floor(greatest(0.0, least(255.0, (v[(y * 3 + x * 7) % 64 + 1] * 0.5 + 0.5) * 255)))"
    steps = ",\n".join(step(k, "box" if k < 4 else "cubic", halved if k < 4 else final) for k in range(1, 5))
    return f"""{E}, y0 AS (SELECT vec_id, {target} AS target, 16 + vec_id % 9 AS h, 18 + vec_id % 5 AS w FROM e),
p0 AS (SELECT vec_id, y, x, {value} AS p FROM (SELECT vec_id, v, w, y, unnest(range(w)) AS x FROM (SELECT e.vec_id, v, w, unnest(range(h)) AS y FROM e JOIN y0 USING (vec_id)))),
{steps},
c AS (SELECT *, {top} AS top, {left} AS lft FROM y4)
SELECT vec_id, target::INT AS target, h::INT AS height, w::INT AS width, list(p::INT ORDER BY y, x) AS pixels FROM c JOIN p4 USING (vec_id) WHERE y >= top AND y < top + {side} AND x >= lft AND x < lft + {side} GROUP BY ALL"""


def _taps_sql(sizes, kind):
    width = 1 if kind == "box" else 4
    kernel = "(d > -0.5 AND d <= 0.5)::INT" if kind == "box" else "CASE WHEN abs(d) < 1 THEN 1.5 * abs(d) ** 3 - 2.5 * d ** 2 + 1 WHEN abs(d) < 2 THEN -0.5 * abs(d) ** 3 + 2.5 * d ** 2 - 4 * abs(d) + 2 ELSE 0 END"
    return f"""SELECT size, new, o, i, k / sum(k) OVER (PARTITION BY size, new, o) AS weight FROM (SELECT *, {kernel} AS k FROM (SELECT size, new, o, i, ((2 * i + 1) * new - (2 * o + 1) * size) / (2.0::DOUBLE * greatest(size, new)) AS d FROM
(SELECT *, unnest(range(size)) AS i FROM (SELECT size, new, unnest(range(new)) AS o FROM {sizes}))
WHERE i < ((2 * o + 1) * size + {width} * greatest(size, new) + new) // (2 * new) AND (i + 1) * 2 * new > (2 * o + 1) * size - {width} * greatest(size, new) + new))"""


@entry("g2_cropped_pixels", _shrunk_sql("3", 3, "(h - 3) // 2", "(w - 3) // 2"))
def g2(spark, sf_dir):
    """The centre of each image after halvings by boxes and a cubic kernel."""
    at = G.center_crop(F.col("w").cast("long"), F.col("h").cast("long"), 3)
    held = _images(spark, sf_dir).withColumns({"target": F.lit(3), **at})
    return _cropped(held, 3)


@entry("g1_cropped_pixels", _shrunk_sql(f"4 + floor({draw_sql(chr(39) + 'target' + chr(39), 'vec_id')} * 5)::BIGINT", 4,
                                        f"floor({draw_sql(chr(39) + 'y' + chr(39), 'vec_id')} * (h - 4 + 1))::BIGINT", f"floor({draw_sql(chr(39) + 'x' + chr(39), 'vec_id')} * (w - 4 + 1))::BIGINT"))
def g1(spark, sf_dir):
    """A place drawn in each image shrunk to a drawn size (G1)."""
    found = G.random_crop(F.col("w").cast("long"), F.col("h").cast("long"), 4, 0.5, 1.0, SEED, "vec_id")
    return _cropped(_images(spark, sf_dir).withColumns(found), 4)


def _cropped(held, side):
    pixels = P.shrunk_crop(F.col("h"), F.col("w"), F.col("pixels"), F.col("target").cast("int"), F.col("crop_y").cast("int"), F.col("crop_x").cast("int"), side)
    return held.select("vec_id", F.col("target").cast("int").alias("target"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), pixels.alias("pixels"))


def _colours(grey):
    return F.flatten(F.transform(grey, lambda p: F.array(p, 255 - p, F.floor(p / 2).cast("int"))))


def _jpeg_round_trip(spark, held, name):
    """``path, h, w, pixels`` written as JPEG files by tasks, and decoded: sizes, and whether the peak signal-to-noise ratio is above 30."""
    root = folder(spark, name)
    IM.write_files(IM.jpeg_encoded(held, "h", "w", "pixels"), root)
    found = IM.decoded(spark, root, ".jpg").select(M.base_name(F.col("path")).alias("path"), "height", "width", F.col("pixels").alias("other"))
    both = held.join(found, "path")
    error = F.aggregate(F.zip_with("pixels", "other", lambda a, b: (a - b) * (a - b)), F.lit(0), lambda s, x: s + x) / F.size("pixels")
    return both.select(F.col("path").alias("name"), "height", "width", (10 * F.log10(65025 / F.greatest(error, F.lit(1e-9))) > 30).alias("close"))


@entry("k1_jpeg_results", "SELECT lpad(vec_id::VARCHAR, 6, '0') || '_result.jpg' AS name, 32 AS height, 32 AS width, true AS close FROM embeddings")
def k1(spark, sf_dir):
    """Reconstructions of 32 x 32 pixels as JPEG files (K1)."""
    grey = P.resized(F.lit(8), F.lit(8), F.transform("v", G.to_byte), F.lit(32), F.lit(32))
    held = rows(spark, sf_dir).select(F.concat(F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit("_result.jpg")).alias("path"), F.lit(32).alias("h"), F.lit(32).alias("w"), grey.alias("grey"))
    return _jpeg_round_trip(spark, held.select("path", "h", "w", _colours("grey").alias("pixels")), "jpeg-results")


@entry("k2_jpeg_original_size", "SELECT lpad(vec_id::VARCHAR, 6, '0') || '.jpg' AS name, (24 + vec_id % 13)::INT AS height, (21 + vec_id % 17)::INT AS width, true AS close FROM embeddings")
def k2(spark, sf_dir):
    """Reconstructions brought back to the size of the original, each its own, as JPEG files (K2)."""
    k = F.col("vec_id")
    held = rows(spark, sf_dir).select("v", F.concat(F.lpad(k.cast("string"), 6, "0"), F.lit(".jpg")).alias("path"), (24 + k % 13).cast("int").alias("h"), (21 + k % 17).cast("int").alias("w"))
    grey = P.resized(F.lit(8), F.lit(8), F.transform("v", G.to_byte), F.col("h"), F.col("w"))
    return _jpeg_round_trip(spark, held.withColumn("grey", grey).select("path", "h", "w", _colours("grey").alias("pixels")), "jpeg-originals")
