"""Queries over ``embeddings``: quantization, metrics, losses, latents and transformer arithmetic.

The tables hold no images: a vector stands for a latent or an image of
4 x 4 x 4 values, the first 16 vectors for a codebook, a reversed vector for a
target or noise.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import schedules as S
from ..functions import vectors as V
from ..operators import quantize as Q

ENTRIES: dict = {}
K = 16


def entry(name: str, sql: str | None):
    def add(f):
        ENTRIES[name] = (f, sql)
        return f

    return add


def r6(c):
    return F.round(c, 6) + 0.0


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def unit(e: DataFrame) -> DataFrame:
    return e.withColumn("v", V.l2_normalize(F.col("v")))


def codebook(e: DataFrame) -> DataFrame:
    return unit(e.where(F.col("vec_id") < K)).select(F.col("vec_id").alias("code"), F.col("v").alias("vec"))


E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
U = E + """, u AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM e),
cb AS (SELECT vec_id AS code, v AS vec FROM u WHERE vec_id < 16),
d AS (SELECT u.vec_id, u.label, u.v, cb.code, cb.vec, round(2 - 2 * list_inner_product(u.v, cb.vec), 9) + 0.0 AS dist FROM u, cb),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1)"""
MSE = "(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len({a}))"


def nearest(spark, sf_dir):
    e = rows(spark, sf_dir).where(V.all_finite(F.col("v")))
    return Q.nearest_code(unit(e), codebook(e)), codebook(e)


@entry("e2_codebook_evaluation", U + f""", m AS (SELECT code, {MSE.format(a="v", b="vec")} AS mse FROM n)
SELECT count(*) AS n_rows, round(avg(mse), 6) + 0.0 AS mean_mse,
       round(avg(CASE WHEN mse = 0 THEN NULL ELSE 10 * log10(1 / mse) END), 6) + 0.0 AS mean_psnr,
       count(*) FILTER (WHERE mse = 0) AS n_exact, count(DISTINCT code) / 16.0::DOUBLE AS usage FROM m""")
def e2_codebook_evaluation(spark, sf_dir):
    """Scan, drop what is not finite, quantize, look up, measure, average; exact rows are counted apart."""
    near, book = nearest(spark, sf_dir)
    m = Q.lookup(near, book).withColumn("mse", V.mse(F.col("v"), F.col("quantized")))
    psnr = V.psnr(F.col("mse"))
    return m.agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.avg("mse")).alias("mean_mse"),
        r6(F.avg(F.when(psnr < V.INF, psnr))).alias("mean_psnr"),
        F.count_if(psnr == V.INF).alias("n_exact"), (F.count_distinct("code") / 16.0).alias("usage"),
    )


@entry("j7_nearest_code", U + " SELECT vec_id, code, dist FROM n")
def j7(spark, sf_dir):
    return nearest(spark, sf_dir)[0].select("vec_id", "code", "dist")


@entry("j8_codebook_lookup", U + " SELECT vec_id, code, list_transform(vec, lambda x: round(x, 6) + 0.0) AS quantized FROM n")
def j8(spark, sf_dir):
    near, book = nearest(spark, sf_dir)
    return Q.lookup(near, book).select("vec_id", "code", F.transform("quantized", r6).alias("quantized"))


@entry("a3_usage_by_label", U + " SELECT label, count(DISTINCT code) AS used, count(DISTINCT code) / 16.0::DOUBLE AS usage FROM n GROUP BY label")
def a3(spark, sf_dir):
    return Q.usage(nearest(spark, sf_dir)[0], K, "label")


@entry("a4_mean_rank_usage", U + """, r AS (SELECT vec_id % 4 AS rank, count(DISTINCT code) / 16.0::DOUBLE AS usage FROM n GROUP BY 1)
SELECT round(avg(usage), 9) + 0.0 AS mean_usage FROM r""")
def a4(spark, sf_dir):
    near = nearest(spark, sf_dir)[0].withColumn("rank", F.col("vec_id") % 4)
    return Q.mean_rank_usage(near, K, "rank").select((F.round("mean_usage", 9) + 0.0).alias("mean_usage"))


@entry("a13_vq_losses", U + f""", m AS (SELECT {MSE.format(a="v", b="vec")} AS mse FROM n)
SELECT round(avg(mse), 6) + 0.0 AS vq_loss, round(0.25 * avg(mse), 6) + 0.0 AS commit_loss FROM m""")
def a13(spark, sf_dir):
    near, book = nearest(spark, sf_dir)
    m = F.avg(V.mse(F.col("v"), F.col("quantized")))
    return Q.lookup(near, book).agg(r6(m).alias("vq_loss"), r6(0.25 * m).alias("commit_loss"))


@entry("a12_entropy_loss", U + """, s AS (SELECT vec_id, code, exp((-dist - max(-dist) OVER w) / 0.01) AS e, (-dist - max(-dist) OVER w) / 0.01 AS z FROM d WINDOW w AS (PARTITION BY vec_id)),
p AS (SELECT vec_id, code, e / sum(e) OVER w AS p, z - ln(sum(e) OVER w) AS lp FROM s WINDOW w AS (PARTITION BY vec_id)),
a AS (SELECT code, avg(p) AS q FROM p GROUP BY code)
SELECT round((SELECT -sum(p * lp) / count(DISTINCT vec_id) FROM p) - (SELECT -sum(q * ln(q + 1e-5)) FROM a), 6) + 0.0 AS entropy_loss""")
def a12(spark, sf_dir):
    """Mean entropy of the rows' distributions over codes, less the entropy of their mean; both sums come from one pass."""
    e = rows(spark, sf_dir)
    d = Q.with_codebook(unit(e), codebook(e)).select(F.transform(Q.distances(F.col("v")), lambda x: -x["dist"]).alias("a"))
    p = d.select(F.posexplode(F.arrays_zip(V.softmax(F.col("a"), 0.01).alias("p"), V.log_softmax(F.col("a"), 0.01).alias("lp"))).alias("code", "x"))
    per_code = p.groupBy("code").agg(F.avg("x.p").alias("q"), F.sum(-F.col("x.p") * F.col("x.lp")).alias("own"), F.count(F.lit(1)).alias("n"))
    sample = F.sum("own") / F.max("n")
    return per_code.agg(r6(sample + F.sum(F.col("q") * F.ln(F.col("q") + 1e-5))).alias("entropy_loss"))


def _fsq_sql(levels):
    base = Q.fsq_basis(levels)
    import math
    parts = []
    for i, n in enumerate(levels):
        half, off = (n - 1) * (1 - 1e-3) / 2, 0.5 if n % 2 == 0 else 0.0
        parts.append(f"(round_even(tanh(v[{i + 1}] * 10 + {math.tan(off / half)!r}) * {half!r} - {off}, 0)::INT + {n // 2}) * {base[i]}")
    return " + ".join(parts)


for _name, _levels in Q.FSQ_LEVELS.items():
    @entry(f"q4_fsq_index_{_name.lower()}", E + f" SELECT vec_id, {_fsq_sql(_levels)} AS code FROM e")
    def fsq(spark, sf_dir, levels=_levels):
        return rows(spark, sf_dir).select("vec_id", Q.fsq_index(F.col("v"), levels, 10.0).alias("code"))

    @entry(f"a3_fsq_usage_{_name.lower()}", E + f", c AS (SELECT {_fsq_sql(_levels)} AS code FROM e) SELECT count(DISTINCT code) AS used, count(DISTINCT code) / {float(__import__('math').prod(_levels))}::DOUBLE AS usage FROM c")
    def fsq_usage(spark, sf_dir, levels=_levels):
        import math
        return Q.usage(rows(spark, sf_dir).select(Q.fsq_index(F.col("v"), levels, 10.0).alias("code")), math.prod(levels))


@entry("q5_fsq_presets", """SELECT vec_id, preset, dim, level, basis, (vec_id * 7919 % size // basis % level)::INT AS digit FROM embeddings, (VALUES
('4K', 4375, 0, 7, 1), ('4K', 4375, 1, 5, 7), ('4K', 4375, 2, 5, 35), ('4K', 4375, 3, 5, 175), ('4K', 4375, 4, 5, 875),
('16K', 15360, 0, 8, 1), ('16K', 15360, 1, 8, 8), ('16K', 15360, 2, 8, 64), ('16K', 15360, 3, 6, 512), ('16K', 15360, 4, 5, 3072),
('64K', 64000, 0, 8, 1), ('64K', 64000, 1, 8, 8), ('64K', 64000, 2, 8, 64), ('64K', 64000, 3, 5, 512), ('64K', 64000, 4, 5, 2560), ('64K', 64000, 5, 5, 12800)) t(preset, size, dim, level, basis)""")
def q5(spark, sf_dir):
    """The digits of an index of each row in each level set, with level and basis of each dimension (Q1, Q5)."""
    held = F.array(*[F.struct(F.lit(k).alias("preset"), F.lit(math.prod(v)).alias("size"), F.lit(i).alias("dim"), F.lit(n).alias("level"), F.lit(b).alias("basis"))
                     for k, v in Q.FSQ_LEVELS.items() for i, (n, b) in enumerate(zip(v, Q.fsq_basis(v), strict=True))])
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.explode(held).alias("t")).select("vec_id", "t.*")
    return e.select("vec_id", "preset", "dim", "level", "basis", F.expr("cast(vec_id * 7919 % size div basis % level as int)").alias("digit"))


@entry("q9_vq_presets", """SELECT vec_id, preset, codebook_size, stride, ((256 + vec_id % 33 * 16) // stride * ((256 + vec_id % 33 * 16) // stride))::BIGINT AS tokens, round(log2(codebook_size) * 3, 6) + 0.0 AS bits FROM embeddings, (VALUES ('VQ_8_4096', 4096, 8), ('VQ_8_16384', 16384, 8), ('VQ_8_65536', 65536, 8),
('VQ_16_4096', 4096, 16), ('VQ_16_16384', 16384, 16), ('VQ_16_65536', 65536, 16)) t(preset, codebook_size, stride)""")
def q9(spark, sf_dir):
    """The tokens that an image of each row's size has under each preset, and the bits of three of them (Q9)."""
    held = F.array(*[F.struct(F.lit(k).alias("preset"), F.lit(n).alias("codebook_size"), F.lit(s).alias("stride")) for k, (n, s) in Q.VQ_PRESETS.items()])
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.explode(held).alias("t")).select("vec_id", "t.*")
    side = F.expr("(256 + vec_id % 33 * 16) div stride")
    return e.select("vec_id", "preset", "codebook_size", "stride", (side * side).alias("tokens"), r6(F.log2("codebook_size") * 3).alias("bits"))


@entry("a9_hinge_by_label", E + """ SELECT label, round(0.5 * (avg(greatest(0, 1 - v[1])) + avg(greatest(0, 1 + v[2]))), 6) + 0.0 AS d_loss,
round(-avg(v[2]), 6) + 0.0 AS g_loss FROM e GROUP BY label""")
def a9(spark, sf_dir):
    """Hinge loss of the discriminator (A9) and adversarial loss of the generator (A10)."""
    real, fake = F.get("v", 0), F.get("v", 1)
    return rows(spark, sf_dir).groupBy("label").agg(
        r6(0.5 * (F.avg(F.greatest(F.lit(0.0), 1 - real)) + F.avg(F.greatest(F.lit(0.0), 1 + fake)))).alias("d_loss"), r6(-F.avg(fake)).alias("g_loss"))


KL = "list_sum(list_transform(range(1, 33), lambda i: 0.5 * (v[i] * v[i] + exp({lv}) - 1 - {lv})))"
CLAMPED = "least(20.0, greatest(-30.0, v[i + 32]))"


@entry("a11_kl", E + f" SELECT vec_id, round({KL.format(lv=CLAMPED)}, 6) + 0.0 AS kl_sum, round({KL.format(lv='v[i + 32]')} / 32, 6) + 0.0 AS kl_mean FROM e")
def a11(spark, sf_dir):
    """KL per sample: summed with clamped log variance (A11), and the mean without a clamp."""
    mean, lv = F.slice("v", 1, 32), F.slice("v", 33, 32)
    term = lambda clamp: V.total(F.zip_with(mean, lv, lambda m, s: 0.5 * (m * m + F.exp(clamp(s)) - 1 - clamp(s))))
    return rows(spark, sf_dir).select("vec_id", r6(term(lambda s: F.least(F.lit(20.0), F.greatest(F.lit(-30.0), s)))).alias("kl_sum"), r6(term(lambda s: s) / 32).alias("kl_mean"))


REV = E + ", r AS (SELECT vec_id, label, v, list_reverse(v) AS w FROM e)"


@entry("a7_pixel_losses", REV + f""" SELECT vec_id, round(list_sum(list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2]))) / len(v), 6) + 0.0 AS l1,
round({MSE.format(a="v", b="w")}, 6) + 0.0 AS mse, round(CASE WHEN {MSE.format(a="v", b="w")} = 0 THEN 'Infinity'::DOUBLE ELSE 10 * log10(1 / {MSE.format(a="v", b="w")}) END, 6) + 0.0 AS psnr FROM r""")
def a7(spark, sf_dir):
    """Mean absolute and squared differences (A7) and the peak signal-to-noise ratio."""
    v, w = F.col("v"), F.reverse("v")
    return rows(spark, sf_dir).select("vec_id", r6(V.l1(v, w)).alias("l1"), r6(V.mse(v, w)).alias("mse"), r6(V.psnr(V.mse(v, w))).alias("psnr"))


@entry("a8_elementwise_losses", REV + """ SELECT vec_id, list_transform(list_zip(v, w), lambda p: round(abs(p[1] - p[2]), 6) + 0.0) AS l1,
list_transform(list_zip(v, w), lambda p: round((p[1] - p[2]) * (p[1] - p[2]), 6) + 0.0) AS l2 FROM r""")
def a8(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", F.zip_with("v", F.reverse("v"), lambda a, b: r6(F.abs(a - b))).alias("l1"), F.zip_with("v", F.reverse("v"), lambda a, b: r6((a - b) * (a - b))).alias("l2"))


@entry("a14_nll", REV + """ SELECT round(sum(list_sum(list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2]) / exp(0.5) + 0.5))) / count(DISTINCT vec_id), 6) + 0.0 AS nll FROM r""")
def a14(spark, sf_dir):
    per = V.total(F.zip_with("v", F.reverse("v"), lambda a, b: F.abs(a - b) / F.exp(F.lit(0.5)) + 0.5))
    return rows(spark, sf_dir).agg(r6(F.sum(per) / F.count_distinct("vec_id")).alias("nll"))


@entry("a15_adaptive_weight", REV + """ SELECT vec_id, round(greatest(0, least(1e4, sqrt(list_inner_product(v, v)) / (sqrt(list_inner_product(w[1:32], w[1:32])) + 1e-4))) * 0.5, 6) + 0.0 AS weight FROM r""")
def a15(spark, sf_dir):
    g = V.l2_norm(F.col("v")) / (V.l2_norm(F.slice(F.reverse("v"), 1, 32)) + 1e-4)
    return rows(spark, sf_dir).select("vec_id", r6(F.greatest(F.lit(0.0), F.least(F.lit(1e4), g)) * 0.5).alias("weight"))


@entry("a16_flow_loss", REV + f""", s AS (SELECT vec_id, (vec_id % 99 + 1) / 100.0::DOUBLE AS sigma, {MSE.format(a="list_transform(list_zip(w, v), lambda p: p[1] - p[2])", b="v")} AS loss FROM r)
SELECT round(avg(loss), 6) + 0.0 AS plain, round(avg(loss / (sigma + 1e-6)), 6) + 0.0 AS inverse,
round(avg(loss * least((1 - sigma) / (sigma + 1e-6), 5.0) / ((1 - sigma) / (sigma + 1e-6))), 6) + 0.0 AS min_snr FROM s""")
def a16(spark, sf_dir):
    """Flow-matching loss under the three weightings (A16, F2, F3); the vector stands for the model's output."""
    sigma = (F.col("vec_id") % 99 + 1) / F.lit(100.0)
    loss = V.mse(S.velocity(F.col("v"), F.reverse("v")), F.col("v"))
    return rows(spark, sf_dir).agg(*[r6(F.avg(loss * S.loss_weight(k, sigma))).alias(n) for k, n in (("none", "plain"), ("inverse", "inverse"), ("min_snr", "min_snr"))])


@entry("a17_channel_norm", E + " SELECT vec_id, list_transform(v, lambda x: round(x / (sqrt(list_inner_product(v, v)) + 1e-10), 6) + 0.0) AS v FROM e")
def a17(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", F.transform(V.channel_normalize(F.col("v")), r6).alias("v"))


@entry("l2_latent_affine", E + " SELECT vec_id, list_transform(v, lambda x: round(0.3611 * (x - 0.1159), 6) + 0.0) AS z, list_transform(v, lambda x: round(0.3611 * (x - 0.1159) / 0.3611 + 0.1159, 6) + 0.0) AS back FROM e")
def l2(spark, sf_dir):
    z = F.transform("v", lambda x: 0.3611 * (x - 0.1159))
    return rows(spark, sf_dir).select("vec_id", F.transform(z, r6).alias("z"), F.transform(z, lambda x: r6(x / 0.3611 + 0.1159)).alias("back"))


@entry("l1_gaussian_mode", E + " SELECT vec_id, list_transform(v[1:32], lambda x: round(x, 6) + 0.0) AS mode, list_transform(v[33:64], lambda x: round(exp(0.5 * x), 6) + 0.0) AS std FROM e")
def l1(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", F.transform(F.slice("v", 1, 32), r6).alias("mode"), F.transform(F.slice("v", 33, 32), lambda x: r6(F.exp(0.5 * x))).alias("std"))


@entry("l3_patch_pack", E + """, c AS (SELECT vec_id, v, unnest(range(64)) AS k FROM e)
SELECT vec_id, (k // 16 * 4 + k // 4 % 4 % 2 * 2 + k % 4 % 2)::INT AS channel, (k // 4 % 4 // 2)::INT AS i, (k % 4 // 2)::INT AS j, v[k + 1] AS value FROM c""")
def l3(spark, sf_dir):
    packed = rows(spark, sf_dir).select("vec_id", F.posexplode(V.patch_pack(F.col("v"), 4, 4, 4)).alias("k", "value"))
    return packed.select("vec_id", F.expr("cast(k div 4 as int)").alias("channel"), F.expr("cast(k % 4 div 2 as int)").alias("i"), F.expr("k % 2").alias("j"), "value")


@entry("l3_pack_round_trip", E + " SELECT vec_id, v FROM e")
def l3_back(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", V.patch_unpack(V.patch_pack(F.col("v"), 4, 4, 4), 4, 4, 4).alias("v"))


BN = E + """, c AS (SELECT vec_id, k // 16 AS channel, v[k + 1] AS x FROM (SELECT vec_id, v, unnest(range(64)) AS k FROM e)),
s AS (SELECT channel, avg(x) AS mean, var_pop(x) AS var, var_samp(x) AS var_run FROM c GROUP BY channel)"""


def _cells(spark, sf_dir):
    c = rows(spark, sf_dir).select("vec_id", F.posexplode("v").alias("k", "x"))
    return c.withColumn("channel", F.expr("cast(k div 16 as long)"))


def _stats(cells):
    return cells.groupBy("channel").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.var_samp("x").alias("var_run"))


@entry("a19_batch_statistics", BN + " SELECT channel, round(mean, 6) + 0.0 AS mean, round(var, 6) + 0.0 AS var, round(0.1 * mean, 6) + 0.0 AS running_mean, round(0.9 + 0.1 * var_run, 6) + 0.0 AS running_var FROM s")
def a19(spark, sf_dir):
    """Batch statistics, and running ones after one update with momentum 0.1 from mean 0 and variance 1."""
    s = _stats(_cells(spark, sf_dir))
    return s.select("channel", r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"), r6(0.1 * F.col("mean")).alias("running_mean"), r6(0.9 + 0.1 * F.col("var_run")).alias("running_var"))


@entry("l4_batch_norm", BN + " SELECT vec_id, channel, round(sum((x - mean) / sqrt(var + 1e-4)), 5) + 0.0 AS z_sum, round(max(abs(((x - mean) / sqrt(var + 1e-4)) * sqrt(var + 1e-4) + mean - x)), 6) + 0.0 AS off FROM c JOIN s USING (channel) GROUP BY vec_id, channel")
def l4(spark, sf_dir):
    """Normalised by channel, and how far the inverse is off."""
    cells = _cells(spark, sf_dir)
    z = (F.col("x") - F.col("mean")) / F.sqrt(F.col("var") + 1e-4)
    back = z * F.sqrt(F.col("var") + 1e-4) + F.col("mean")
    return cells.join(F.broadcast(_stats(cells)), "channel").groupBy("vec_id", "channel").agg((F.round(F.sum(z), 5) + 0.0).alias("z_sum"), r6(F.max(F.abs(back - F.col("x")))).alias("off"))  # one row a channel


@entry("d1_rms_norm", E + " SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v) / len(v) + 1e-6), 6) + 0.0) AS v FROM e")
def d1(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", F.transform(V.rms_norm(F.col("v")), r6).alias("v"))


@entry("d3_silu_gate", E + " SELECT vec_id, list_transform(range(1, 33), lambda i: round(v[i] / (1 + exp(-v[i])) * v[i + 32], 6) + 0.0) AS g FROM e")
def d3(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", F.zip_with(F.slice("v", 1, 32), F.slice("v", 33, 32), lambda x, y: r6(V.silu_gate(x, y))).alias("g"))


@entry("d4_modulation", E + " SELECT vec_id, list_transform(range(1, 17), lambda i: round((1 + v[i + 16]) * v[i] + v[i + 32], 6) + 0.0) AS m, list_transform(range(1, 17), lambda i: round(v[i + 48] * v[i], 6) + 0.0) AS gated FROM e")
def d4(spark, sf_dir):
    part = lambda k: F.slice("v", 1 + 16 * k, 16)
    m = F.zip_with(F.zip_with(part(0), part(1), lambda x, s: (1 + s) * x), part(2), lambda x, h: r6(x + h))
    return rows(spark, sf_dir).select("vec_id", m.alias("m"), F.zip_with(part(3), part(0), lambda g, x: r6(g * x)).alias("gated"))


@entry("d5_rope", E + """, p AS (SELECT vec_id, v, unnest(range(32)) AS k FROM e), a AS (SELECT vec_id, k, v[2 * k + 1] AS x0, v[2 * k + 2] AS x1, (vec_id % 64) * pow(10000.0, -2.0 * k / 64) AS t FROM p)
SELECT vec_id, k::INT AS k, round(cos(t) * x0 - sin(t) * x1, 5) + 0.0 AS y0, round(sin(t) * x0 + cos(t) * x1, 5) + 0.0 AS y1 FROM a""")
def d5(spark, sf_dir):
    p = rows(spark, sf_dir).select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k"))
    y0, y1 = V.rotate_pair(F.expr("v[2 * k]"), F.expr("v[2 * k + 1]"), V.rope_angle(F.col("vec_id") % 64, F.col("k"), 64, 10000.0))
    return p.select("vec_id", "k", (F.round(y0, 5) + 0.0).alias("y0"), (F.round(y1, 5) + 0.0).alias("y1"))


@entry("j9_attention", E + """, t AS (SELECT vec_id, vec_id // 64 AS sequence, v FROM e), s AS (SELECT a.vec_id, b.v AS bv, exp(list_inner_product(a.v, b.v) / 8) AS w FROM t a JOIN t b USING (sequence))
SELECT vec_id, round(sum(w * bv[1]) / sum(w), 6) + 0.0 AS y0, round(sum(w * bv[2]) / sum(w), 6) + 0.0 AS y1 FROM s GROUP BY vec_id""")
def j9(spark, sf_dir):
    """All rows are tokens, 64 ids a sequence; the join grows with the table only."""
    return _attention(rows(spark, sf_dir).withColumn("sequence", F.expr("vec_id div 64")), "sequence")


def _attention(tokens, *group):
    """Softmax-weighted sums over the tokens of a group."""
    s = tokens.select("vec_id", *group, F.col("v").alias("q")).join(tokens.select(*group, F.col("v").alias("kv")), list(group))
    w = F.exp(V.dot(F.col("q"), F.col("kv")) / 8)
    return s.groupBy("vec_id").agg(*[r6(F.sum(w * F.get("kv", i)) / F.sum(w)).alias(f"y{i}") for i in (0, 1)])


@entry("j9_image_attention", E + """, t AS (SELECT vec_id, label, vec_id // 256 AS image, v FROM e), s AS (SELECT a.vec_id, b.v AS bv, exp(list_inner_product(a.v, b.v) / 8) AS w FROM t a JOIN t b USING (label, image))
SELECT vec_id, round(sum(w * bv[1]) / sum(w), 6) + 0.0 AS y0, round(sum(w * bv[2]) / sum(w), 6) + 0.0 AS y1 FROM s GROUP BY vec_id""")
def j9_image(spark, sf_dir):
    """All rows are tokens; those of one label among 256 ids are an image, so the join grows with the table only."""
    return _attention(rows(spark, sf_dir).withColumn("image", F.expr("vec_id div 256")), "label", "image")


@entry("p3_finite_batches", """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 97 = 5 THEN list_append(list_transform(embedding, lambda x: x::DOUBLE), 'NaN'::DOUBLE) ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS v FROM embeddings),
b AS (SELECT vec_id, vec_id // 8 AS batch, bool_or(list_aggregate(list_transform(v, lambda x: isnan(x) OR isinf(x)), 'bool_or')) OVER (PARTITION BY vec_id // 8) AS bad FROM e)
SELECT batch, count(*) AS n FROM b WHERE NOT bad GROUP BY batch""")
def p3(spark, sf_dir):
    """A batch with any value that is not finite goes as a whole; some are put in, the table has none."""
    e = rows(spark, sf_dir).withColumn("v", F.when(F.col("vec_id") % 97 == 5, F.array_append("v", F.lit(float("nan")))).otherwise(F.col("v")))
    b = e.withColumn("batch", F.expr("vec_id div 8")).withColumn("bad", F.bool_or(~V.all_finite(F.col("v"))).over(Window.partitionBy("batch")))
    return b.where("not bad").groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@entry("f1_noised_latents", REV + ", t AS (SELECT vec_id, v, w, (vec_id % 101) / 100.0::DOUBLE AS t FROM r) SELECT vec_id, list_transform(list_zip(v, w), lambda p: round((1 - t) * p[1] + t * p[2], 6) + 0.0) AS z, list_transform(list_zip(v, w), lambda p: round(p[2] - p[1], 6) + 0.0) AS target FROM t")
def f1(spark, sf_dir):
    t = (F.col("vec_id") % 101) / F.lit(100.0)
    e = rows(spark, sf_dir).withColumn("w", F.reverse("v"))
    return e.select("vec_id", F.transform(S.add_noise(F.col("v"), F.col("w"), t), r6).alias("z"), F.transform(S.velocity(F.col("v"), F.col("w")), r6).alias("target"))


@entry("f9_guidance", REV + " SELECT vec_id, list_transform(list_zip(v, w), lambda p: round(p[1] + 4.0 * (p[2] - p[1]), 6) + 0.0) AS g FROM r")
def f9(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", F.transform(S.guided(F.col("v"), F.reverse("v"), 4.0), r6).alias("g"))


@entry("f8_euler", E + """ SELECT vec_id, list_transform(v, lambda x: round(x * 0.9 * 0.9 * 0.9 * 0.9, 6) + 0.0) AS x FROM e""")
def f8(spark, sf_dir):
    """Four Euler steps of 0.1 in sigma along a velocity that equals the sample."""
    sigmas = F.array(*[F.lit(round(1 - 0.1 * k, 1)) for k in range(5)])
    steps = F.zip_with(F.slice(sigmas, 1, 4), F.slice(sigmas, 2, 4), lambda a, b: b - a)
    x = F.aggregate(steps, F.col("v"), lambda x, d: F.transform(x, lambda y: y + d * y))
    return rows(spark, sf_dir).select("vec_id", F.transform(x, r6).alias("x"))


@entry("g10_to_bytes", E + " SELECT vec_id, list_transform(v, lambda x: floor(greatest(0.0, least(255.0, (x * 0.5 + 0.5) * 255)))::INT) AS px, list_transform(v, lambda x: round((x / 255.0::DOUBLE - 0.5) / 0.5, 6) + 0.0) AS unit FROM e")
def g10(spark, sf_dir):
    """Back to bytes (G10) and to normalised values."""
    from ..operators import geometry as G

    return rows(spark, sf_dir).select("vec_id", F.transform("v", G.to_byte).alias("px"), F.transform("v", lambda x: r6(G.to_unit(x))).alias("unit"))


@entry("b7_channels_first", E + " SELECT vec_id, list_transform(range(64), lambda k: v[(k % 16) * 4 + k // 16 + 1]) AS chw FROM e")
def b7(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", V.channels_first(F.col("v"), 4, 4, 4).alias("chw"))


@entry("b8_pad_and_crop", E + " SELECT vec_id, list_transform(range(81), lambda k: CASE WHEN k // 9 < 8 AND k % 9 < 8 THEN v[k // 9 * 8 + k % 9 + 1] ELSE 0.0 END) AS padded, v AS cropped FROM e")
def b8(spark, sf_dir):
    """Padded at the bottom and right (B8), and the padding cut away again."""
    from ..operators import shard

    e = rows(spark, sf_dir).withColumn("padded", shard.pad_to_square(F.col("v"), F.lit(8), F.lit(8), 9))
    return e.select("vec_id", "padded", shard.crop(F.col("padded"), F.lit(8), F.lit(8), 9).alias("cropped"))


@entry("p9_token_slices", E + " SELECT vec_id, v[1:24] AS target, v[25:64] AS rest, list_concat(v[1:24], v[25:64]) AS joined FROM e")
def p9(spark, sf_dir):
    """The first tokens (P9), those after them (P10), and both joined again."""
    e = rows(spark, sf_dir)
    a, b = F.slice("v", 1, 24), F.slice("v", 25, 40)
    return e.select("vec_id", a.alias("target"), b.alias("rest"), F.concat(a, b).alias("joined"))
