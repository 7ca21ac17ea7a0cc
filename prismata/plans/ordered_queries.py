"""Queries over ``events`` and ``lineitem``: meters, moving averages, steps and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O

ENTRIES: dict = {}
ORDER = ["ts", "event_id"]


def entry(name, sql):
    def add(f):
        ENTRIES[name] = (f, sql)
        return f

    return add


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


W = "(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@entry("w2_running_mean", f"SELECT event_id, sum(value::DECIMAL(18,2)) OVER {W}::DOUBLE / count(value) OVER {W} AS running_mean FROM events")
def w2(spark, sf_dir):
    """Running average of a meter."""
    return O.running_mean(events(spark, sf_dir), "value", "user_id", ORDER).select("event_id", "running_mean")


@entry("a1_weighted_mean", "SELECT l_returnflag, l_linestatus, sum((l_extendedprice::DECIMAL(18,2)) * (l_quantity::DECIMAL(18,2)))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS mean FROM lineitem GROUP BY 1, 2")
def a1(spark, sf_dir):
    d = lambda c: F.col(c).cast("decimal(18,2)")
    total = F.sum((d("l_extendedprice") * d("l_quantity")).cast("decimal(28,4)")).cast("double")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus").agg((total / F.sum(d("l_quantity")).cast("double")).alias("mean"))


@entry("a2_mean_of_rank_means", "WITH r AS (SELECT event_type, user_id % 8 AS rank, sum(value::DECIMAL(18,2))::DOUBLE / count(value) AS m FROM events GROUP BY 1, 2) SELECT event_type, round(avg(m), 6) + 0.0 AS mean FROM r GROUP BY 1")
def a2(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("rank", F.col("user_id") % 8)
    m = e.groupBy("event_type", "rank").agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value")).alias("m"))
    return m.groupBy("event_type").agg((F.round(F.avg("m"), 6) + 0.0).alias("mean"))


@entry("w3_best_so_far", "SELECT event_id, value < coalesce(min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e9) AS is_best FROM events")
def w3(spark, sf_dir):
    """Best-so-far flags (W3), the rule for keeping the best checkpoint (K3)."""
    return O.best_so_far(events(spark, sf_dir), "value", "user_id", ORDER).select("event_id", "is_best")


@entry("w4_cumulative_usage", f"""WITH f AS (SELECT *, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)::INT AS fresh FROM events)
SELECT event_id, (sum(fresh) OVER {W})::BIGINT AS used, (sum(fresh) OVER {W}) / 8.0::DOUBLE AS usage FROM f""")
def w4(spark, sf_dir):
    return O.cumulative_usage(events(spark, sf_dir), "event_type", "user_id", ORDER, 8).select("event_id", "used", "usage")


@entry("w5_moving_average", """WITH RECURSIVE h AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, value AS start, 0.9 * (1 - exp(-k / 20.0::DOUBLE)) * value + (1 - 0.9 * (1 - exp(-k / 20.0::DOUBLE))) * value AS ema FROM h WHERE k = 1
UNION ALL SELECT h.user_id, h.k, r.start, 0.9 * (1 - exp(-h.k / 20.0::DOUBLE)) * r.ema + (1 - 0.9 * (1 - exp(-h.k / 20.0::DOUBLE))) * h.value FROM r JOIN h ON h.user_id = r.user_id AND h.k = r.k + 1)
SELECT user_id, k::INT AS updates, round(ema, 6) + 0.0 AS ema FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def w5(spark, sf_dir):
    ema = O.moving_average(events(spark, sf_dir), "value", "user_id", ORDER, 0.9, 20.0)
    return ema.select("user_id", "updates", (F.round("ema", 6) + 0.0).alias("ema"))


@entry("w6_accumulation", "WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS iter FROM events) SELECT event_id, iter, ceil(iter / 4.0)::BIGINT AS step, iter % 4 = 0 AS acts, iter % 20 = 0 AS prints, iter % 16 = 0 OR iter = 1 AS saves FROM n")
def w6(spark, sf_dir):
    """Accumulated steps (W6), what is printed (W7) and what is saved (K4)."""
    n = O.accumulation(events(spark, sf_dir), "user_id", ORDER, 4)
    return n.select("event_id", "iter", "step", "acts", (F.col("iter") % 20 == 0).alias("prints"), ((F.col("iter") % 16 == 0) | (F.col("iter") == 1)).alias("saves"))


@entry("w8_fractional_epoch", "WITH n AS (SELECT event_id, user_id % 10 + 1 AS epoch, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id % 10) AS c FROM events) SELECT event_id, round(k / c::DOUBLE + epoch - 1, 9) + 0.0 AS progress FROM n")
def w8(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("epoch", F.col("user_id") % 10 + 1)
    return O.fractional_epoch(e, "epoch", ORDER).select("event_id", (F.round("progress", 9) + 0.0).alias("progress"))


@entry("k3_checkpoints", "WITH e AS (SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, count(*) OVER (PARTITION BY user_id) AS last FROM events) SELECT run, event_id, epoch::INT AS epoch, epoch % 5 = 0 OR epoch = last AS saved, lpad(epoch::VARCHAR, greatest(3, len(epoch::VARCHAR))::INT, '0') AS tag FROM e")
def k3(spark, sf_dir):
    """Which epochs of each run are saved, and their padded numbers."""
    e = F.col("epoch")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run"), "ts", "event_id")
    last = rows.groupBy("run").agg(F.count(F.lit(1)).alias("last"))
    found = O.accumulation(rows, "run", ["ts", "event_id"], 5).withColumnRenamed("iter", "epoch").join(last, "run")
    text = e.cast("string")
    return found.select("run", "event_id", "epoch", (F.col("acts") | (e == F.col("last"))).alias("saved"), F.lpad(text, F.greatest(F.lit(3), F.length(text)), "0").alias("tag"))


@entry("p4_skipped_steps", """WITH g AS (SELECT event_id, event_id // 4 AS step, value, (value < 1)::INT AS flag FROM events), s AS (SELECT *, sum(flag) OVER (PARTITION BY step) AS bad FROM g)
SELECT step, count(*) AS n, round(sum(value::DECIMAL(18,2))::DOUBLE, 2) + 0.0 AS total FROM s WHERE bad = 0 GROUP BY step""")
def p4(spark, sf_dir):
    """A step goes if any of its four ranks raised a flag."""
    g = events(spark, sf_dir).select(F.expr("event_id div 4").alias("step"), "value", (F.col("value") < 1).cast("int").alias("flag"))
    s = g.groupBy("step").agg(F.sum("flag").alias("bad"), F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return s.where("bad = 0").select("step", "n", (F.round("total", 2) + 0.0).alias("total"))


@entry("p8_gated_loss", "SELECT event_id, CASE WHEN user_id % 10 >= 5 THEN 1.0 ELSE 0.0 END * CASE WHEN event_id % 50 = 0 THEN 'NaN'::DOUBLE ELSE value END AS loss FROM events")
def p8(spark, sf_dir):
    """A loss before its start is multiplied by 0, so NaN stays NaN."""
    gate = F.when(F.col("user_id") % 10 >= 5, 1.0).otherwise(0.0)
    return events(spark, sf_dir).select("event_id", (gate * F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).alias("loss"))


@entry("a20_total_loss", "SELECT event_id, value + value * 0.25 AS total, value + value * 0.5 + 1.0 AS total_of_map FROM events")
def a20(spark, sf_dir):
    m = F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.col("value") * 0.5, F.lit("c"), F.lit(1.0))
    return events(spark, sf_dir).select("event_id", (F.col("value") + F.col("value") * 0.25).alias("total"), F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x).alias("total_of_map"))


@entry("x9_json_field", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def x9(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@entry("p11_config_echo", """WITH m AS (SELECT event_id, unnest(['kind_' || event_type, 'user_' || (user_id % 5), '__doc__', 'model', 'value']) AS k FROM events)
SELECT event_id, string_agg(k, ',' ORDER BY k) AS keys FROM m WHERE NOT starts_with(k, '__') AND k <> 'model' GROUP BY event_id""")
def p11(spark, sf_dir):
    """The keys of each row's map but for excluded ones and those with double underscores."""
    v = F.col("value")
    m = F.create_map(F.concat(F.lit("kind_"), "event_type"), v, F.concat(F.lit("user_"), (F.col("user_id") % 5).cast("string")), v, F.lit("__doc__"), v, F.lit("model"), v, F.lit("value"), v)
    kept = F.map_filter(m, lambda k, v: ~F.startswith(k, F.lit("__")) & ~k.isin("model"))
    return events(spark, sf_dir).select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"))
