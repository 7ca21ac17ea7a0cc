"""Queries over images: files written and scanned, random geometry, similarity, batches and losses.

A vector of ``embeddings`` stands for an image of 8 x 8 values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import chains as C
from ..functions import draws as D
from ..functions import images as I
from ..functions import schedules as S
from ..functions import vectors as V
from ..operators import checkpoints as K
from ..operators import geometry as G
from ..operators import ledger as L
from ..operators import ordered as O
from ..operators import quantize as Q
from ..operators import shard as H
from ..operators import tiles
from ..operators.dealt import checkpoint_folder
from ..sources import images as IM
from ..sources import manifest as M
from .dataset_queries import TENSORS, table, tensors
from .schedule_queries import GRID, SEED, draw_sql, grid, normal_sql, steps
from .vector_queries import E, MSE, r6, rows

ENTRIES: dict = {}


def entry(name, sql):
    def add(f):
        ENTRIES[name] = (f, sql)
        return f

    return add


def folder(spark, name):
    """A new folder below the checkpoint folder, as a URI."""
    checkpoint_folder(spark)
    found = spark.sparkContext.getCheckpointDir()
    return f"{found if '://' in found or found.startswith('file:') else 'file://' + found}/{name}-{uuid.uuid4().hex[:8]}"


# ---- files

BYTE = "floor(greatest(0.0, least(255.0, (v[k + 1] * 0.5 + 0.5) * 255)))::INT"
NAMED = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), f AS (SELECT vec_id, label, v, 'c' || lpad(label::VARCHAR, 2, '0') AS class, lpad(vec_id::VARCHAR, 6, '0') AS stem FROM e)"


def _pictures(spark, sf_dir):
    """Each vector as an 8 x 8 picture: red its value, green the opposite, blue half of it."""
    px = F.transform("v", G.to_byte)
    return rows(spark, sf_dir).select("vec_id", "label", F.concat(F.lit("c"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("class"), F.lpad(F.col("vec_id").cast("string"), 6, "0").alias("stem"),
                                      F.flatten(F.transform(px, lambda p: F.array(p, 255 - p, F.floor(p / 2).cast("int")))).alias("pixels"))


def _written(spark, pictures, path, name):
    root = folder(spark, name)
    held = pictures.select(path.alias("path"), F.lit(8).alias("h"), F.lit(8).alias("w"), "pixels")
    IM.write_files(IM.encoded(held, "h", "w", "pixels"), root)
    return root


@entry("s1_class_folder", NAMED + " SELECT stem || '.png' AS name, class, (dense_rank() OVER (ORDER BY class) - 1)::INT AS label, row_number() OVER (ORDER BY class, stem) - 1 AS position FROM f")
def s1(spark, sf_dir):
    """Image files in class folders: labels by the order of class names (S1), positions by the order of paths (O2)."""
    p = _pictures(spark, sf_dir)
    root = _written(spark, p, F.concat(F.lit("train/"), "class", F.lit("/"), "stem", F.lit(".png")), "class-folder")
    found = H.numbered(M.class_folder(spark, root, "train"), ["path"], "position")
    return found.select(M.base_name(F.col("path")).alias("name"), "class", "label", "position")


@entry("s2_image_paths", NAMED + " SELECT class || '/' || stem || '.png' AS path FROM f")
def s2(spark, sf_dir):
    """The same scan without labels."""
    root = _written(spark, _pictures(spark, sf_dir), F.concat(F.lit("val/"), "class", F.lit("/"), "stem", F.lit(".png")), "image-paths")
    return M.files(spark, f"{root}/val").select(F.concat_ws("/", "parent", "name").alias("path"))


SETS = ["d0", "d1", "d2"]
SET_SQL = NAMED + ", s AS (SELECT 'd' || (label % 3) AS dataset, vec_id, stem || CASE WHEN vec_id % 7 = 0 THEN '.png' WHEN vec_id % 2 = 1 THEN '_edit.jpg' ELSE '.jpg' END AS name, 'a picture of class ' || class AS caption FROM f)"


def _sets(spark, sf_dir, name):
    """Three data sets with captions; some files are of another kind, some the edited form of others."""
    v = F.col("vec_id")
    end = F.when(v % 7 == 0, ".png").when(v % 2 == 1, "_edit.jpg").otherwise(".jpg")
    stem = F.lpad(F.floor(v / 2).cast("string"), 6, "0") if name == "pairs" else F.col("stem")
    p = _pictures(spark, sf_dir).withColumns({"dataset": F.concat(F.lit("d"), (F.floor(v / 2) % 3 if name == "pairs" else F.col("label") % 3).cast("string")), "name": F.concat(stem, end)})
    root = _written(spark, p, F.concat("dataset", F.lit("/train/"), "name"), name)
    caption = F.map_from_entries(F.collect_list(F.struct("name", F.struct(F.concat(F.lit("a picture of class "), "class").alias("web_caption")))))
    held = p.groupBy("dataset", F.expr("vec_id div 1000").alias("part")).agg(F.to_json(caption).cast("binary").alias("content"))  # a thousand captions a file at most
    IM.write_files(held.select(F.concat("dataset", F.lit("/"), "dataset", F.lit("_train.json/"), F.col("part").cast("string"), F.lit(".json")).alias("path"), "content"), root)
    return root


@entry("s3_captioned_sets", SET_SQL + " SELECT dataset, name, caption FROM s WHERE ends_with(name, '.jpg')")
def s3(spark, sf_dir):
    """Images of several data sets with their captions."""
    return IM.captioned_sets(spark, _sets(spark, sf_dir, "captioned"), SETS, "train")


@entry("s4_edit_pairs", NAMED + """, s AS (SELECT 'd' || (vec_id // 2 % 3) AS dataset, lpad((vec_id // 2)::VARCHAR, 6, '0') || CASE WHEN vec_id % 7 = 0 THEN '.png' WHEN vec_id % 2 = 1 THEN '_edit.jpg' ELSE '.jpg' END AS name, 'a picture of class ' || class AS caption FROM f)
SELECT a.dataset, a.name AS source, b.name AS edited, a.caption FROM s a JOIN s b ON a.dataset = b.dataset AND b.name = replace(a.name, '.jpg', '_edit.jpg') WHERE ends_with(a.name, '.jpg') AND NOT ends_with(a.name, '_edit.jpg')""")
def s4(spark, sf_dir):
    """Sources with an edited sibling, of several data sets."""
    return IM.edited_sets(spark, _sets(spark, sf_dir, "pairs"), SETS, "train")


@entry("s6_flat_listing", NAMED + ", j AS (SELECT stem || '_' || class AS prefix, stem || '_' || class || CASE WHEN vec_id % 5 = 0 THEN '.png' ELSE '.v1.jpg' END AS name FROM f) SELECT prefix, name, row_number() OVER (ORDER BY name) - 1 AS position FROM j WHERE ends_with(name, '.jpg')")
def s6(spark, sf_dir):
    """The .jpg files of one folder, sorted, with the name up to the first dot."""
    end = F.when(F.col("vec_id") % 5 == 0, ".png").otherwise(".v1.jpg")
    root = _written(spark, _pictures(spark, sf_dir), F.concat("stem", F.lit("_"), "class", end), "flat")
    found = H.numbered(M.files(spark, root, ".jpg").select("name"), ["name"], "position")
    return found.select(M.prefix(F.col("name")).alias("prefix"), "name", "position")


@entry("s7_decoded_images", NAMED + f" SELECT stem || '.png' AS name, 8 AS height, 8 AS width, list_reduce(list_transform(range(64), lambda k: [{BYTE}, 255 - {BYTE}, {BYTE} // 2]), lambda a, b: list_concat(a, b)) AS pixels FROM f")
def s7(spark, sf_dir):
    """Pictures written as files (K1, K2) and decoded again, red first."""
    root = _written(spark, _pictures(spark, sf_dir), F.concat("stem", F.lit(".png")), "decoded")
    found = IM.decoded(spark, root, ".png")
    return found.select(M.base_name(F.col("path")).alias("name"), "height", "width", "pixels")


@entry("k5_log_lines", "SELECT event_type || ':' || count(*) AS line FROM events GROUP BY event_type UNION ALL SELECT 'total:' || count(*) FROM events")
def k5(spark, sf_dir):
    """Lines appended to a log of text files, twice, and read back."""
    root = folder(spark, "log")
    e = table(spark, sf_dir, "events")
    by = e.groupBy("event_type").agg(F.concat_ws(":", F.col("event_type"), F.count(F.lit(1)).cast("string")).alias("line")).select("line")
    for lines in (by, e.agg(F.concat(F.lit("total:"), F.count(F.lit(1)).cast("string")).alias("line"))):
        lines.write.mode("append").text(root)
    return spark.read.text(root).withColumnRenamed("value", "line")


@entry("k6_weight_table", TENSORS + " SELECT name, shape, data FROM t")
def k6(spark, sf_dir):
    """Converted weights saved as a table, and read back."""
    root = folder(spark, "weights")
    tensors(spark, sf_dir)[0].select("name", "shape", "data").write.parquet(root)
    return spark.read.parquet(root)


@entry("o4_preview", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def o4(spark, sf_dir):
    """The first ten rows: a preview, whose limit is its purpose."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").orderBy("doc_id").limit(10)


# ---- checkpoints and runs


@entry("k3_checkpoint_files", """WITH n AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS loss FROM events),
l AS (SELECT run, max(epoch) AS last FROM n GROUP BY run), b AS (SELECT run, epoch, loss FROM n WHERE loss < 1e9 QUALIFY row_number() OVER (PARTITION BY run ORDER BY loss, epoch) = 1)
SELECT run, printf('epoch_%d_model.pth', epoch) AS file, epoch::INT AS epoch FROM n JOIN l USING (run) WHERE epoch % 5 = 0 OR epoch = last
UNION ALL SELECT run, printf('total_loss%.3f.pth', loss), epoch::INT FROM b UNION ALL SELECT run, 'latest.pth', last::INT FROM l""")
def k3(spark, sf_dir):
    """Numbered, best and latest files of each run, the best renamed at the end (K3)."""
    e = O.accumulation(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("loss")), "run", ["ts", "event_id"], 1)
    return K.checkpoint_files(e.select("run", F.col("iter").alias("epoch"), "loss"), "run", "epoch", "loss", 5)


@entry("p5_zero_losses", """WITH g AS (SELECT event_id // 4 AS step, CASE WHEN event_id % 23 = 0 THEN 0.0 WHEN event_id % 41 = 0 THEN 'NaN'::DOUBLE ELSE value END AS loss FROM events)
SELECT step, sum((loss = 0)::INT)::BIGINT AS zeros, sum((isnan(loss) OR isinf(loss))::INT)::BIGINT AS broken, sum((loss = 0 OR isnan(loss) OR isinf(loss))::INT) > 0 AS skipped FROM g GROUP BY step""")
def p5(spark, sf_dir):
    """A step goes if a rank's loss is exactly zero or not finite (P5)."""
    i = F.col("event_id")
    loss = F.when(i % 23 == 0, 0.0).when(i % 41 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    g = table(spark, sf_dir, "events").select(F.expr("event_id div 4").alias("step"), (loss == 0).alias("zero"), (F.isnan(loss) | (F.abs(loss) == V.INF)).alias("broken"))
    return g.groupBy("step").agg(F.count_if("zero").alias("zeros"), F.count_if("broken").alias("broken"), F.bool_or(F.col("zero") | F.col("broken")).alias("skipped"))


@entry("b5_worker_seeds", f"SELECT o_orderkey, epoch, rank, worker, floor({draw_sql('epoch', 'rank', 'worker')} * 2147483648)::BIGINT AS seed FROM (SELECT o_orderkey, o_orderkey % 20 AS epoch, o_custkey % 8 AS rank, o_orderkey // 20 % 8 AS worker FROM orders)")
def b5(spark, sf_dir):
    """The seed of the loader worker that reads each row: by digest, so the same in every run."""
    n = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 20).alias("epoch"), (F.col("o_custkey") % 8).alias("rank"), F.expr("o_orderkey div 20 % 8").alias("worker"))
    return n.select("o_orderkey", "epoch", "rank", "worker", F.floor(D.uniform(SEED, "epoch", "rank", "worker") * 2147483648).alias("seed"))


@entry("x10_elapsed_hours", "SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9::DOUBLE, 6) + 0.0 AS hours FROM events GROUP BY user_id")
def x10(spark, sf_dir):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(r6((us(F.max("ts")) - us(F.min("ts"))) / F.lit(3.6e9)).alias("hours"))


# ---- random geometry

_T = f"(64 + floor({draw_sql(chr(39) + 'target' + chr(39), 'w', 'h')} * 17))::BIGINT"


@entry("g1_random_crop", GRID + f""", t AS (SELECT k, w, h, {_T} AS target FROM g), n AS (SELECT *, len(list_filter(range(1, 31), lambda i: floor(least(w, h) / pow(2, i - 1)) >= 2 * target)) AS n FROM t),
s AS (SELECT *, floor(w / pow(2, n)) AS a, floor(h / pow(2, n)) AS b FROM n), r AS (SELECT k, w, h, target, n, round_even(a * (target / least(a, b)), 0)::BIGINT AS rw, round_even(b * (target / least(a, b)), 0)::BIGINT AS rh FROM s)
SELECT k, w, h, target, n::INT AS halvings, rw AS width, rh AS height, floor({draw_sql("'x'", 'w', 'h')} * (rw - 64 + 1))::BIGINT AS crop_x, floor({draw_sql("'y'", 'w', 'h')} * (rh - 64 + 1))::BIGINT AS crop_y FROM r""")
def g1(spark, sf_dir):
    """A target size drawn between side and side / 0.8, halvings, the resized size and a corner drawn inside (G1)."""
    found = G.random_crop(F.col("w"), F.col("h"), 64, 0.8, 1.0, SEED, "w", "h")
    return grid(spark, sf_dir).select("k", "w", "h", *[c.alias(k) for k, c in found.items()])


@entry("g4_random_pad", E + f""", o AS (SELECT vec_id, v, floor({draw_sql("'top'", 'vec_id')} * 5)::BIGINT AS top, floor({draw_sql("'left'", 'vec_id')} * 5)::BIGINT AS left_ FROM e)
SELECT vec_id, top, left_, list_transform(range(144), lambda k: CASE WHEN k // 12 - top BETWEEN 0 AND 7 AND k % 12 - left_ BETWEEN 0 AND 7 THEN v[(k // 12 - top) * 8 + k % 12 - left_ + 1] ELSE 0.0 END) AS padded FROM o""")
def g4(spark, sf_dir):
    """An 8 x 8 image at a drawn place of a black 12 x 12 square."""
    o = rows(spark, sf_dir).select("vec_id", "v", *[D.whole(F.lit(0), F.lit(4), SEED, F.lit(k), "vec_id").alias(n) for k, n in (("top", "top"), ("left", "left_"))])
    return o.select("vec_id", "top", "left_", I.pasted(F.col("v"), 8, 8, F.col("top"), F.col("left_"), 12).alias("padded"))


@entry("g6_random_flip", E + f""" SELECT vec_id, {draw_sql("'flip'", 'vec_id')} < 0.5 AS flipped, CASE WHEN {draw_sql("'flip'", 'vec_id')} < 0.5 THEN list_transform(range(64), lambda k: v[k // 8 * 8 + 7 - k % 8 + 1]) ELSE v END AS v FROM e""")
def g6(spark, sf_dir):
    """Rows of pixels in reverse for a drawn half of the images."""
    flip = D.uniform(SEED, F.lit("flip"), "vec_id") < 0.5
    return rows(spark, sf_dir).select("vec_id", flip.alias("flipped"), F.when(flip, I.flipped(F.col("v"), 8, 8)).otherwise(F.col("v")).alias("v"))


@entry("g9_dtype_bridge", E + " SELECT vec_id, list_transform(v, lambda x: ((trunc(x * 300)::BIGINT % 256 + 256) % 256)::INT) AS wrapped, list_transform(v, lambda x: greatest(0, least(255, trunc(x * 300)))::INT) AS clamped FROM e")
def g9(spark, sf_dir):
    """To bytes with wrap-around, as a bare cast does, and clamped."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))
    return rows(spark, sf_dir).select("vec_id", F.transform("v", lambda x: I.to_byte_wrapped(x * 300)).alias("wrapped"), F.transform("v", lambda x: F.floor(clamp(x * 300)).cast("int")).alias("clamped"))


@entry("l1_gaussian_sample", E + f", z AS (SELECT vec_id, k, v[k + 1] AS mean, exp(0.5 * least(20.0, greatest(-30.0, v[k + 33]))) AS std, {normal_sql('vec_id', 'k')} AS z FROM (SELECT vec_id, v, unnest(range(32)) AS k FROM e)) SELECT vec_id, list(round(mean + std * z, 6) + 0.0 ORDER BY k) AS sample FROM z GROUP BY vec_id")
def l1(spark, sf_dir):
    """A sample of each diagonal Gaussian: mean plus standard deviation times a seeded draw (L1)."""
    std = lambda k: F.exp(0.5 * F.least(F.lit(20.0), F.greatest(F.lit(-30.0), F.get("v", k + 32))))
    sample = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: r6(F.get("v", k) + std(k) * D.normal(SEED, F.col("vec_id"), k)))
    return rows(spark, sf_dir).select("vec_id", sample.alias("sample"))


@entry("s11_mock_edits", f"""WITH n AS (SELECT c_custkey AS id, 1 + floor({draw_sql("'refs'", 'c_custkey')} * 3)::BIGINT AS refs FROM customer),
p AS (SELECT id, refs, k, round({normal_sql('id', 'k')}, 6) + 0.0 AS z FROM (SELECT id, refs, unnest(range(0, 12 * (refs + 1))) AS k FROM n))
SELECT id, refs, 'change the style ' || id AS text, list(z ORDER BY k) FILTER (WHERE k < 12) AS target, list(z ORDER BY k) FILTER (WHERE k >= 12) AS sources FROM p GROUP BY id, refs""")
def s11(spark, sf_dir):
    """A mock edit for each row: a target of 3 x 2 x 2 normal draws and one to three sources of that size."""
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), D.whole(F.lit(1), F.lit(3), SEED, F.lit("refs"), "c_custkey").alias("refs"))
    last = (12 * (F.col("refs") + 1) - 1).cast("int")
    return n.select("id", "refs", F.concat(F.lit("change the style "), F.col("id").cast("string")).alias("text"), _normals(F.lit(0), F.lit(11)).alias("target"), _normals(F.lit(12), last).alias("sources"))


def _normals(first, last):
    return F.transform(F.sequence(first, last), lambda k: r6(D.normal(SEED, F.col("id"), k)))


@entry("s11_mock_texts", f"""WITH p AS (SELECT s_suppkey AS id, s_name AS text, unnest(range(0, 27)) AS k FROM supplier)
SELECT id, 'a picture of ' || text AS text, list(round({normal_sql('id', 'k')}, 6) + 0.0 ORDER BY k) AS image FROM p GROUP BY id, text""")
def s11_texts(spark, sf_dir):
    """A mock text and image for each row, the image 3 x 3 x 3 normal draws."""
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("a picture of "), "s_name").alias("text"))
    return n.select("id", "text", _normals(F.lit(0), F.lit(26)).alias("image"))


_CUBIC = "CASE WHEN {d} <= 1 THEN 1.25 * {d} ** 3 - 2.25 * {d} ** 2 + 1 WHEN {d} < 2 THEN -0.75 * {d} ** 3 + 3.75 * {d} ** 2 - 6 * {d} + 3 ELSE 0 END"


def _cubic_sql(source, size, new, channels, first):
    """Cubic interpolation in SQL of a square grid in the vectors of ``source``, whose values begin after ``first``."""
    d = [f"abs({c} - floor({c}) + 1 - {k})" for c, k in (("sy", "i"), ("sx", "j"))]
    return f"""o AS (SELECT vec_id, v, y, x, c, (y + 0.5::DOUBLE) * {size} / {new} - 0.5 AS sy, (x + 0.5::DOUBLE) * {size} / {new} - 0.5 AS sx FROM {source}, (SELECT unnest(range({new})) AS y), (SELECT unnest(range({new})) AS x), (SELECT unnest(range({channels})) AS c)),
q AS (SELECT vec_id, y, x, c, {_CUBIC.format(d=d[0])} AS wy, {_CUBIC.format(d=d[1])} AS wx, v[((least({size - 1}, greatest(0, floor(sy) - 1 + i)) * {size} + least({size - 1}, greatest(0, floor(sx) - 1 + j))) * {channels} + c)::INT + 1 + {first}] AS p
FROM o, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)), g AS (SELECT vec_id, y, x, c, round(sum(wy * wx * p), 6) + 0.0 AS p FROM q GROUP BY ALL), r AS (SELECT vec_id, list(p ORDER BY y, x, c) AS grid FROM g GROUP BY vec_id)"""


@entry("g14_resized", E + ", " + _cubic_sql("e", 8, 12, 1, 0) + " SELECT vec_id, grid AS v FROM r")
def g14(spark, sf_dir):
    """Each 8 x 8 image at 12 x 12, by cubic interpolation."""
    return rows(spark, sf_dir).select("vec_id", F.transform(I.resized(F.col("v"), 8, 8, 12, 12), r6).alias("v"))


@entry("g15_resized_positions", E + ", " + _cubic_sql("e", 3, 5, 4, 28) + " SELECT vec_id, list_concat(list_transform(v[1:28], lambda x: round(x, 6) + 0.0), grid) AS v FROM r JOIN e USING (vec_id)")
def g15(spark, sf_dir):
    """Position embeddings of seven class tokens and a 3 x 3 grid of four planes, for a 5 x 5 grid."""
    return rows(spark, sf_dir).select("vec_id", F.transform(I.resized_positions(F.col("v"), 7, 3, 5, 4), r6).alias("v"))


# ---- similarity, losses, batches

_AB = E + """, p AS (SELECT vec_id, list_transform(v, lambda x: greatest(0.0, least(1.0, x * 0.5 + 0.5))) AS a FROM e), q AS (SELECT vec_id, a, list_reverse(a) AS b FROM p),
x AS (SELECT vec_id, i, j, a[(i + y) * 8 + j + z + 1] AS a, b[(i + y) * 8 + j + z + 1] AS b FROM q, (SELECT unnest(range(2)) AS i), (SELECT unnest(range(2)) AS j), (SELECT unnest(range(7)) AS y), (SELECT unnest(range(7)) AS z)),
m AS (SELECT vec_id, i, j, avg(a) AS ua, avg(b) AS ub, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS vab FROM x GROUP BY ALL),
s AS (SELECT vec_id, avg((2 * ua * ub + 1e-4) * (2 * vab + 9e-4) / ((ua * ua + ub * ub + 1e-4) * (va + vb + 9e-4))) AS ssim FROM m GROUP BY vec_id)"""


def _similar(spark, sf_dir):
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x * 0.5 + 0.5))
    q = rows(spark, sf_dir).select("vec_id", F.transform("v", clamp).alias("a")).withColumn("b", F.reverse("a"))
    return q.select("vec_id", I.ssim(8, 8)("a", "b").alias("ssim"), V.psnr(V.mse(F.col("a"), F.col("b"))).alias("psnr"))


@entry("g12_ssim", _AB + " SELECT vec_id, round(ssim, 6) + 0.0 AS ssim FROM s")
def g12(spark, sf_dir):
    """Structural similarity of each 8 x 8 image and its reverse, windows of 7 x 7."""
    return _similar(spark, sf_dir).select("vec_id", r6(F.col("ssim")).alias("ssim"))


@entry("a6_mean_metrics", _AB + f", n AS (SELECT vec_id, {MSE.format(a='a', b='b')} AS mse FROM q) SELECT count(*) AS n, round(avg(ssim), 6) + 0.0 AS ssim, round(avg(CASE WHEN mse = 0 THEN 'Infinity'::DOUBLE ELSE 10 * log10(1 / mse) END), 6) + 0.0 AS psnr FROM s JOIN n USING (vec_id)")
def a6(spark, sf_dir):
    """Means of both metrics over all images."""
    return _similar(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ssim")).alias("ssim"), r6(F.avg("psnr")).alias("psnr"))


@entry("a11b_global_kl", E + " SELECT round(0.5 * avg(v[k + 1] * v[k + 1] + exp(v[k + 33]) - 1 - v[k + 33]), 6) + 0.0 AS kl FROM (SELECT v, unnest(range(32)) AS k FROM e)")
def a11b(spark, sf_dir):
    """The mean over all elements of all samples, without a clamp."""
    term = V.total(F.zip_with(F.slice("v", 1, 32), F.slice("v", 33, 32), lambda m, s: m * m + F.exp(s) - 1 - s))
    return rows(spark, sf_dir).agg(r6(0.5 * F.sum(term) / (F.count(F.lit(1)) * 32)).alias("kl"))


@entry("a19_running_statistics", """WITH RECURSIVE c AS (SELECT vec_id // 50 AS batch, k // 16 AS channel, embedding[k + 1]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS k FROM embeddings)),
s AS (SELECT channel, batch, avg(x) AS mean, var_samp(x) AS var FROM c GROUP BY channel, batch),
r AS (SELECT DISTINCT channel, -1::BIGINT AS batch, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS var FROM s UNION ALL SELECT s.channel, s.batch, 0.9 * r.mean + 0.1 * s.mean, 0.9 * r.var + 0.1 * s.var FROM r JOIN s ON s.channel = r.channel AND s.batch = r.batch + 1)
SELECT channel, batch + 1 AS updates, round(mean, 6) + 0.0 AS running_mean, round(var, 6) + 0.0 AS running_var FROM r QUALIFY row_number() OVER (PARTITION BY channel ORDER BY batch DESC) = 1""")
def a19(spark, sf_dir):
    """Running statistics over all batches of 50 (A19): each update weighs 0.1, and all before it 0.9 more often."""
    c = rows(spark, sf_dir).select(F.expr("vec_id div 50").alias("batch"), F.posexplode("v").alias("k", "x"))
    s = c.groupBy(F.expr("cast(k div 16 as long)").alias("channel"), "batch").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("var"))
    total = O.running_statistics(s, "channel", "batch")
    return total.select("channel", "updates", r6(F.col("running_mean")).alias("running_mean"), r6(F.col("running_var")).alias("running_var"))


@entry("b9_ragged_collate", "SELECT user_id // 4 AS batch, list(event_id ORDER BY event_id) AS ids, list(range(0, event_id % 3 + 1) ORDER BY event_id) AS sources FROM events GROUP BY 1")
def b9(spark, sf_dir):
    """Batches whose rows hold one to three references each, kept as they are."""
    e = table(spark, sf_dir, "events").select(F.expr("user_id div 4").alias("batch"), "event_id", F.col("event_id").alias("ids"), F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3).alias("sources"))
    return C.collated(e, "batch", ["event_id"], ["ids", "sources"])


AXES = (16, 24, 24)


@entry("d6_axis_embedding", "WITH p AS (SELECT id, axis, dim, pos, unnest(range(dim // 2)) AS k FROM (SELECT id, unnest([{'axis': 0, 'dim': 16, 'pos': label % 3}, {'axis': 1, 'dim': 24, 'pos': id // 3 % 16}, {'axis': 2, 'dim': 24, 'pos': id // 48}], recursive := true) FROM (SELECT vec_id AS id, label FROM embeddings))) SELECT id, list(round(cos(pos * pow(10000.0, -2.0 * k / dim)), 6) + 0.0 ORDER BY axis, k) AS c, list(round(sin(pos * pow(10000.0, -2.0 * k / dim)), 6) + 0.0 ORDER BY axis, k) AS s FROM p GROUP BY id")
def d6(spark, sf_dir):
    """Rotary angles of each row at a place on three axes of 16, 24 and 24 dimensions, one after another."""
    at = (F.col("label") % 3, F.expr("id div 3 % 16"), F.expr("id div 48"))
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label").select("id", V.axis_angles(at, AXES, 10000.0).alias("a"))
    return a.select("id", F.transform("a", lambda x: r6(F.cos(x))).alias("c"), F.transform("a", lambda x: r6(F.sin(x))).alias("s"))


@entry("f8_start_index", "WITH t AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS k FROM events), s AS (SELECT run, k, (1000 - k // 3 * 40)::DOUBLE AS timestep FROM t) SELECT run, timestep, CASE WHEN count(*) > 1 THEN list(k ORDER BY k)[2] ELSE min(k) END AS start FROM s GROUP BY run, timestep")
def f8(spark, sf_dir):
    """Where the schedule of each run is entered at a time step: at its second place, if it has several (F8)."""
    t = steps(spark, sf_dir).select("run", F.col("epoch").alias("k"), (1000 - F.expr("epoch div 3") * 40).cast("double").alias("timestep"))
    return t.groupBy("run", "timestep").agg(S.start_index(F.col("k")).alias("start"))


@entry("q8_decoded_codes", "SELECT vec_id, i AS code, [((i % 7) - 3) / 3.0::DOUBLE, ((i // 7 % 5) - 2) / 2.0::DOUBLE, ((i // 35 % 5) - 2) / 2.0::DOUBLE, ((i // 175 % 5) - 2) / 2.0::DOUBLE, ((i // 875 % 5) - 2) / 2.0::DOUBLE] AS z FROM (SELECT vec_id, vec_id * 7919 % 4375 AS i FROM embeddings)")
def q8(spark, sf_dir):
    """The code vector of an index of the smallest level set in each row (Q8)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 7919 % 4375).alias("code"))
    return e.select("vec_id", "code", Q.fsq_codes(F.col("code"), Q.FSQ_LEVELS["4K"]).alias("z"))


@entry("u1_loss_registry", E + f""", r AS (SELECT vec_id, v, list_reverse(v) AS w FROM e), d AS (SELECT vec_id, v, w, list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2])) AS d FROM r)
SELECT vec_id, 'l1' AS loss, round(list_avg(d), 6) + 0.0 AS value FROM d UNION ALL SELECT vec_id, 'l2', round({MSE.format(a='v', b='w')}, 6) + 0.0 FROM d
UNION ALL SELECT vec_id, 'smooth_l1', round(list_avg(list_transform(d, lambda x: CASE WHEN x < 1 THEN 0.5 * x * x ELSE x - 0.5 END)), 6) + 0.0 FROM d
UNION ALL SELECT vec_id, 'cosine', round(1 - list_cosine_similarity(v, w), 6) + 0.0 FROM d""")
def u1(spark, sf_dir):
    """Losses called by name."""
    names = ["l1", "l2", "smooth_l1", "cosine"]
    pairs = F.array(*[F.struct(F.lit(n).alias("loss"), r6(C.loss(n, F.col("v"), F.reverse("v"))).alias("value")) for n in names])
    return rows(spark, sf_dir).select("vec_id", F.explode(pairs).alias("x")).select("vec_id", "x.loss", "x.value")


@entry("u2_transform_chain", E + f""", f AS (SELECT vec_id, CASE WHEN {draw_sql("'flip'", 'vec_id')} < 0.5 THEN list_transform(range(64), lambda k: v[k // 8 * 8 + 7 - k % 8 + 1]) ELSE v END AS v FROM e),
c AS (SELECT vec_id, list_transform(range(36), lambda k: v[(1 + k // 6) * 8 + 1 + k % 6 + 1]) AS v FROM f) SELECT vec_id, list_transform(v, lambda x: round((x / 255.0::DOUBLE - 0.5) / 0.5, 6) + 0.0) AS v FROM c""")
def u2(spark, sf_dir):
    """A chain of transforms in one plan: a drawn flip, a centre crop of 6 x 6, normalisation."""
    flip = D.uniform(SEED, F.lit("flip"), "vec_id") < 0.5
    run = C.chain(C.on("v", lambda v: F.when(flip, I.flipped(v, 8, 8)).otherwise(v)), C.on("v", lambda v: I.cropped(v, 8, F.lit(1), F.lit(1), 6)),
                  C.on("v", lambda v: F.transform(v, lambda x: r6(G.to_unit(x)))))
    return run(rows(spark, sf_dir)).select("vec_id", "v")


@entry("j7_large_codebook", E + """, u AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM e),
d AS (SELECT a.vec_id, b.vec_id AS code, round(2 - 2 * list_inner_product(a.v, b.v), 9) + 0.0 AS dist FROM u a, u b WHERE b.vec_id % 2 = 1)
SELECT vec_id, code, dist FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1""")
def j7(spark, sf_dir):
    """The nearest code among half of all vectors, tile by tile (J7 for a codebook of any size)."""
    e, v = table(spark, sf_dir, "embeddings"), V.l2_normalize(V.doubles(F.col("embedding")))
    book = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("code"), v.alias("vec"))
    near = tiles.nearest_code(e, book, ["vec_id"], v, tile=512).select("vec_id", "code", "dist")
    lowest = e.where("vec_id % 2 = 1").agg(F.min("vec_id").alias("code")).where("code IS NOT NULL")
    bare = e.where("embedding IS NULL").join(F.broadcast(lowest), how="inner")  # equally far from all codes
    return near.unionByName(bare.select("vec_id", "code", F.lit(None).cast("double").alias("dist")))


@entry("j9_long_attention", E + """, t AS (SELECT vec_id, vec_id // 1000 AS sequence, v FROM e), s AS (SELECT a.vec_id, b.v AS bv, exp(list_inner_product(a.v, b.v) / 8) AS w FROM t a JOIN t b USING (sequence))
SELECT vec_id, round(sum(w * bv[1]) / sum(w), 6) + 0.0 AS y0, round(sum(w * bv[64]) / sum(w), 6) + 0.0 AS y63 FROM s GROUP BY vec_id""")
def j9_long(spark, sf_dir):
    """Attention over sequences of a thousand tokens in blocks, merged about their greatest scores."""
    t = rows(spark, sf_dir).select(F.expr("vec_id div 1000").alias("sequence"), "vec_id", F.col("v").alias("q"), F.col("v").alias("k"), "v")
    y = tiles.attention(t, "sequence", "vec_id", scale=1 / 8)
    return y.select(F.col("position").alias("vec_id"), r6(F.get("y", 0)).alias("y0"), r6(F.get("y", 63)).alias("y63"))


@entry("j5_compare_shapes", TENSORS + """ SELECT t.name, CASE WHEN m.name IS NULL THEN 'missing' WHEN t.shape <> m.shape THEN 'shape' WHEN t.data = m.data THEN 'equal' ELSE 'different' END AS verdict FROM t LEFT JOIN m ON t.name = m.name""")
def j5(spark, sf_dir):
    """Tensors compared by their shapes, not only by how many numbers they hold."""
    t, m = tensors(spark, sf_dir)
    return L.compare(t, m, shape="shape").select("name", "verdict")


CODES = 65536
MSE_BY_RANK = E + """ SELECT rank::INT AS rank, count(*) AS n, round(avg(list_sum(list_transform(list_zip(v, list_reverse(v)), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(v)), 6) + 0.0 AS mse FROM e, (SELECT unnest(range(4)) AS rank) GROUP BY rank"""


@entry("a3_usage_bitmaps", f"SELECT label, count(DISTINCT code) AS used, count(DISTINCT code) / {CODES}.0::DOUBLE AS usage FROM (SELECT label, (vec_id % 300 * 7919) % {CODES} AS code FROM embeddings) GROUP BY label")
def a3_bitmaps(spark, sf_dir):
    """Usage of a codebook of 65536 by label, from bitmaps of batches that are merged."""
    k = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select("label", F.expr("vec_id div 100").alias("batch"), (k % 300 * 7919 % CODES).alias("code"))
    return Q.merged_usage(Q.usage_bitmaps(e, "label", "batch"), CODES, "label")


@entry("a4_rank_usage_bitmaps", f"""WITH c AS (SELECT vec_id % 4 AS rank, (vec_id * 31 % 1009) * 61 % {CODES} AS code FROM embeddings)
SELECT (SELECT count(DISTINCT code) / {CODES}.0::DOUBLE FROM c) AS union_usage, (SELECT round(avg(u), 12) + 0.0 FROM (SELECT count(DISTINCT code) / {CODES}.0::DOUBLE AS u FROM c GROUP BY rank)) AS mean_usage""")
def a4_bitmaps(spark, sf_dir):
    """The usage of all ranks together and the mean of each rank's own, from the same bitmaps (A4)."""
    k = F.col("vec_id")
    bitmaps = Q.usage_bitmaps(table(spark, sf_dir, "embeddings").select((k % 4).alias("rank"), (k * 31 % 1009 * 61 % CODES).alias("code")), "rank")
    own = Q.merged_usage(bitmaps, CODES, "rank").agg((F.round(F.avg("usage"), 12) + 0.0).alias("mean_usage"))
    return Q.merged_usage(bitmaps, CODES).select(F.col("usage").alias("union_usage")).join(own)


@entry("b4_replicated_evaluation", MSE_BY_RANK)
def b4(spark, sf_dir):
    """What each of four ranks has when all evaluate everything and nothing is reduced: one evaluation, a row for each rank."""
    return H.replicated(rows(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(V.mse(F.col("v"), F.reverse("v")))).alias("mse")), 4)
