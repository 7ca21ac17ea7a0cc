"""Queries over schedules, positions and image sizes, applied to rows of the tables.

Events are the steps of training runs, one run for each user; documents have
sequence lengths, vectors are images at positions, and parts have sizes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws as D
from ..functions import schedules as S
from ..functions import vectors as V
from ..operators import geometry as G
from ..operators import ordered as O

ENTRIES: dict = {}
SEED = 17


def entry(name, sql):
    def add(f):
        ENTRIES[name] = (f, sql)
        return f

    return add


def r9(c):
    return F.round(c, 9) + 0.0


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draw_sql(*key):
    """A draw of ``functions.draws`` in SQL."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(map(str, (SEED, *key)))})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def normal_sql(*key):
    return f"(sqrt(-2 * ln(1 - {draw_sql(chr(39) + 'r' + chr(39), *key)})) * cos(2 * pi() * {draw_sql(chr(39) + 'a' + chr(39), *key)}))"


STEPS = "WITH e AS (SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, count(*) OVER (PARTITION BY user_id) + 3 AS epochs FROM events), x AS (SELECT *, epoch::DOUBLE AS x, epochs::DOUBLE AS n FROM e)"


def steps(spark, sf_dir):
    """The epochs of each run in order, with the number that its schedule is laid out for."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", "event_id")
    counts = e.groupBy("run").agg((F.count(F.lit(1)) + 3).alias("epochs"))
    return O.accumulation(e, "run", ["ts", "event_id"], 1).withColumnRenamed("iter", "epoch").join(counts, "run").select("run", "event_id", "epoch", "epochs")


@entry("lr_schedules", STEPS + """ SELECT run, event_id, epoch::INT AS epoch,
round(CASE WHEN x < 2 THEN x / 2 * 1e-1 ELSE 1e-1 * pow(0.1, (x >= 6)::INT + (x >= 12)::INT) END, 9) + 0.0 AS multi_step,
round(CASE WHEN x < 2 THEN x / 2 * 1e-1 ELSE 0.5 * (1e-1 - 5e-3) * (cos(pi() * (x - 2) / (n - 2)) + 1) + 5e-3 END, 9) + 0.0 AS cosine,
round(CASE WHEN x < 2 THEN x / 2 * 1e-1 ELSE pow(1 - (x - 2) / (n - 2), 0.9) * (1e-1 - 5e-3) + 5e-3 END, 9) + 0.0 AS poly,
round(0.5 * (2e-2 - 1e-4) * (cos(pi() * x / n) + 1) + 1e-4, 9) + 0.0 AS second_model FROM x""")
def lr(spark, sf_dir):
    """Rates at each epoch of a run: warm-up (LR1) followed by steps (LR2), cosine (LR3) or polynomial (LR4); a second model's own (LR6)."""
    s = steps(spark, sf_dir)
    e, n = F.col("epoch").cast("double"), F.col("epochs").cast("double")
    return s.select("run", "event_id", "epoch", r9(S.multi_step(e, 0.1, [6, 12], 0.1, 2)).alias("multi_step"), r9(S.cosine(e, 0.1, n, 5e-3, 2)).alias("cosine"),
                    r9(S.poly(e, 0.1, n, 5e-3, 0.9, 2)).alias("poly"), r9(S.cosine(e, 2e-2, n, 1e-4)).alias("second_model"))


@entry("lr5_matrix_scale", "SELECT p_partkey, p_size AS rows_, p_partkey % 97 + 1 AS cols, round(0.2 * sqrt(greatest(p_size, p_partkey % 97 + 1)::DOUBLE), 9) + 0.0 AS scale FROM part")
def lr5(spark, sf_dir):
    """The factor of each matrix parameter by its sizes (LR5)."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("rows_"), (F.col("p_partkey") % 97 + 1).alias("cols"))
    return p.withColumn("scale", r9(S.matrix_scale(F.col("rows_"), F.col("cols"))))


SHIFT = "(n * ((1.15::DOUBLE - 0.5) / (4096 - 256)) + (0.5::DOUBLE - ((1.15::DOUBLE - 0.5) / (4096 - 256)) * 256))"


@entry("f5_shift", f"SELECT doc_id, n, round({SHIFT}, 12) + 0.0 AS mu FROM (SELECT doc_id, n_chars AS n FROM documents)")
def f5(spark, sf_dir):
    """The shift of each sequence by its length."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"), (F.round(S.shift_of_length(F.col("n_chars")), 12) + 0.0).alias("mu"))


@entry("f7_sigma_table", f"""WITH g AS (SELECT doc_id, least(greatest(n_chars, 256), 4096) AS n, k, 1 - k / 20.0::DOUBLE AS t FROM documents, (SELECT unnest(range(21)) AS k)), m AS (SELECT *, {SHIFT} AS mu FROM g)
SELECT doc_id, k::INT AS k, round(CASE WHEN k = 20 THEN 0.0 ELSE exp(mu) / (exp(mu) + (1 / t - 1)) END, 9) + 0.0 AS sigma, round(3.0 * t / (1 + 2.0 * t), 9) + 0.0 AS static_sigma,
round(CASE WHEN k = 20 THEN 0.0 ELSE 1000 * exp(mu) / (exp(mu) + (1 / t - 1)) END, 6) + 0.0 AS timestep FROM m""")
def f7(spark, sf_dir):
    """The sigmas of a sampler of 20 steps for each sequence, by dynamic (F6, F7, F10) and static shift, and timesteps."""
    n = F.least(F.greatest(F.col("n_chars"), F.lit(256)), F.lit(4096))
    g = table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    t = F.when(F.col("k") == 20, F.lit(0.0)).otherwise(1 - F.col("k") / 20.0)
    s = S.time_shift(t, S.shift_of_length(F.col("n")))
    return g.select("doc_id", "k", r9(s).alias("sigma"), r9(S.static_shift(t, 3.0)).alias("static_sigma"), (F.round(1000 * s, 6) + 0.0).alias("timestep"))


@entry("f3_loss_weights", """WITH s AS (SELECT event_id, event_id % 101 AS k, event_id % 101 / 100.0::DOUBLE AS sigma FROM events)
SELECT event_id, round(1 / (sigma + 1e-6), 6) + 0.0 AS inverse, CASE WHEN k = 100 THEN NULL ELSE round(least((1 - sigma) / (sigma + 1e-6), 5.0) / ((1 - sigma) / (sigma + 1e-6)), 9) + 0.0 END AS min_snr FROM s""")
def f3(spark, sf_dir):
    """The weights of each step's loss by its sigma."""
    s = F.col("event_id") % 101 / 100.0
    w = S.loss_weight("min_snr", s)
    return table(spark, sf_dir, "events").select("event_id", (F.round(S.loss_weight("inverse", s), 6) + 0.0).alias("inverse"), F.when(~F.isnan(w), r9(w)).alias("min_snr"))


@entry("f4_logit_normal", "SELECT vec_id, round(greatest(1e-5, least(1 - 1e-5, 1 / (1 + exp(-(embedding[1]::DOUBLE * 10))))), 9) + 0.0 AS t FROM embeddings")
def f4(spark, sf_dir):
    """Timesteps from given draws."""
    return table(spark, sf_dir, "embeddings").select("vec_id", r9(S.logit_normal(F.get("embedding", 0).cast("double") * 10)).alias("t"))


@entry("f4_seeded_draws", f"""WITH d AS (SELECT event_id, {draw_sql("'u'", 'event_id')} AS u, {normal_sql("'z'", 'event_id')} AS z FROM events)
SELECT event_id, round(u, 9) + 0.0 AS u, round(z, 6) + 0.0 AS z, round(greatest(1e-5, least(1 - 1e-5, 1 / (1 + exp(-z)))), 6) + 0.0 AS t, u < 0.5 AS flip, floor(u * 65)::BIGINT AS crop_x FROM d""")
def f4_draws(spark, sf_dir):
    """The draws of each training step (F4, B6): uniform and normal, a time step, a flip and a place, by seed and step alone."""
    d = table(spark, sf_dir, "events").select("event_id", D.uniform(SEED, F.lit("u"), "event_id").alias("u"), D.normal(SEED, F.lit("z"), "event_id").alias("z"))
    return d.select("event_id", r9(F.col("u")).alias("u"), (F.round("z", 6) + 0.0).alias("z"), (F.round(S.logit_normal(F.col("z")), 6) + 0.0).alias("t"), (F.col("u") < 0.5).alias("flip"),
                    F.floor(F.col("u") * (320 - 256 + 1)).alias("crop_x"))


@entry("d7_timestep_embedding", """WITH g AS (SELECT event_id, event_id % 500 / 500.0::DOUBLE AS t FROM events)
SELECT event_id, list_transform(range(33), lambda k: round(CASE WHEN k = 32 THEN 0.0 WHEN k < 16 THEN cos(1000 * t * exp(-ln(10000.0::DOUBLE) * (k % 16) / 16)) ELSE sin(1000 * t * exp(-ln(10000.0::DOUBLE) * (k % 16) / 16)) END, 6) + 0.0) AS x FROM g""")
def d7(spark, sf_dir):
    """The embedding of each step's time, of an odd number of dimensions."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 500 / 500.0).alias("t"))
    return e.select("event_id", F.transform(V.timestep_embedding(F.col("t"), 33), lambda x: F.round(x, 6) + 0.0).alias("x"))


@entry("d8_position_ids", """SELECT vec_id, ref, pos, CASE WHEN ref = 0 THEN pos // 8 ELSE pos // 8 + ref * 8 + 10 END AS h, pos % 8 AS w FROM (SELECT vec_id, label % 3 AS ref, unnest(range(64))::INT AS pos FROM embeddings)""")
def d8(spark, sf_dir):
    """Row and column of each token of each image; reference images start below the target, with a gap."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("ref"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    h = F.expr("pos div 8").cast("int")
    return p.select("vec_id", "ref", "pos", F.when(F.col("ref") == 0, h).otherwise(h + F.col("ref") * 8 + 10).alias("h"), (F.col("pos") % 8).alias("w"))


GRID = "WITH g AS (SELECT p_partkey AS k, (p_partkey * 97 % 3881 + 33)::BIGINT AS w, (p_partkey * 83 % 3259 + p_size + 31)::BIGINT AS h FROM part)"
_R32 = "CASE WHEN round_even({x} / 32, 0) > 0 THEN (round_even({x} / 32, 0) * 32)::BIGINT END"


def grid(spark, sf_dir):
    """Each part as an image, by its width and height."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), (k * 97 % 3881 + 33).alias("w"), (k * 83 % 3259 + F.col("p_size") + 31).alias("h"))


@entry("g3_longest_side", GRID + f" SELECT k, w, h, {_R32.format(x='(w * 256 / greatest(w, h)::DOUBLE)')} AS new_w, {_R32.format(x='(h * 256 / greatest(w, h)::DOUBLE)')} AS new_h FROM g")
def g3(spark, sf_dir):
    a, b = G.longest_side(F.col("w"), F.col("h"), 256)
    return grid(spark, sf_dir).select("k", "w", "h", a.alias("new_w"), b.alias("new_h"))


@entry("g5_megapixels", ", ".join([GRID, "m AS (SELECT k, w, h, u, w * h / u::DOUBLE AS mp FROM g, (SELECT unnest([1000000, 4000000]) AS u))", "s AS (SELECT k, w, h, u, CASE WHEN mp < 0.5 THEN sqrt(0.5 / mp) WHEN mp > 2 THEN sqrt(2.0 / mp) ELSE 1.0 END AS s FROM m)"]) + f" SELECT k, w, h, u, {_R32.format(x='(w * s)')} AS new_w, {_R32.format(x='(h * s)')} AS new_h FROM s")
def g5(spark, sf_dir):
    parts = []
    for u in (1_000_000, 4_000_000):
        a, b = G.megapixels(F.col("w"), F.col("h"), unit=u)
        parts.append(grid(spark, sf_dir).select("k", "w", "h", F.lit(u).alias("u"), a.alias("new_w"), b.alias("new_h")))
    return parts[0].unionByName(parts[1])


@entry("g2_center_crop", GRID + """, n AS (SELECT k, w, h, len(list_filter(range(1, 31), lambda i: floor(least(w, h) / pow(2, i - 1)) >= 128)) AS n FROM g),
s AS (SELECT k, w, h, n, floor(w / pow(2, n)) AS a, floor(h / pow(2, n)) AS b FROM n), r AS (SELECT k, w, h, n, round_even(a * (64 / least(a, b)), 0)::BIGINT AS rw, round_even(b * (64 / least(a, b)), 0)::BIGINT AS rh FROM s)
SELECT k, w, h, n::INT AS halvings, rw AS width, rh AS height, floor((rw - 64) / 2)::BIGINT AS crop_x, floor((rh - 64) / 2)::BIGINT AS crop_y FROM r""")
def g2(spark, sf_dir):
    """Halvings, resized size and corner of a centre crop (G2); G1 draws its size and corner at random."""
    return grid(spark, sf_dir).select("k", "w", "h", *[c.alias(k) for k, c in G.center_crop(F.col("w"), F.col("h"), 64).items()])


@entry("g7_shorter_side", GRID + " SELECT k, w, h, round_even(w * 256 / least(w, h)::DOUBLE, 0)::BIGINT AS new_w, round_even(h * 256 / least(w, h)::DOUBLE, 0)::BIGINT AS new_h FROM g")
def g7(spark, sf_dir):
    a, b = G.shorter_side(F.col("w"), F.col("h"), 256)
    return grid(spark, sf_dir).select("k", "w", "h", a.alias("new_w"), b.alias("new_h"))


@entry("x7_version_pattern", """WITH v AS (SELECT p_partkey, (1 + p_partkey % 13) || '.' || p_size || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.' || p_partkey % 7 ELSE '.3+cu118' END AS version FROM part)
SELECT p_partkey, version, split_part(version, '.', 1) = '2' AND p_partkey % 3 > 0 AS ok FROM v""")
def x7(spark, sf_dir):
    """Versions that begin with a release of the second generation."""
    k = F.col("p_partkey")
    end = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("."), (k % 7).cast("string"))).otherwise(".3+cu118")
    v = table(spark, sf_dir, "part").select(k, F.concat((1 + k % 13).cast("string"), F.lit("."), F.col("p_size").cast("string"), end).alias("version"))
    return v.select("p_partkey", "version", F.col("version").rlike(r"^2\.\d+\.\d+").alias("ok"))
