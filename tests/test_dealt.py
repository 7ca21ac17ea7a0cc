"""Row numbers and running aggregates over ranges, on tables with columns beside the order."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismata.operators import ordered, shard


def test_row_numbers_with_a_payload_are_those_of_a_window(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    got = shard.numbered(rows, order, ranges=48)
    want = rows.withColumn("rn", F.row_number().over(Window.orderBy(*order)) - 1)
    assert got.columns == [*rows.columns, "rn"]
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    assert got.agg(F.min("rn"), F.max("rn"), F.count_distinct("rn")).first() == (0, rows.count() - 1, rows.count())


def test_row_numbers_with_ties_and_clashing_names(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.lit(0).alias("_p"), F.lit(0).alias("_n"), F.lit(1).alias("_part"))
    got = shard.numbered(rows, ["k"])
    assert sorted(r["rn"] for r in got.collect()) == list(range(1000))
    assert got.groupBy("k").agg(F.min("rn").alias("a")).orderBy("k").collect()[1]["a"] == 334


@pytest.mark.parametrize(("n", "ranks"), [(103, 7), (2, 7), (7, 7), (0, 3)])
def test_shards_with_a_payload(spark, n, ranks):
    rows = spark.range(n).select("id", (F.col("id") * 2).alias("twice"))
    got = shard.shards(rows, ["id"], ranks)
    counts = {r["count"] for r in got.groupBy("rank").count().collect()}
    assert counts == ({-(-n // ranks)} if n else set())
    assert got.where("twice <> 2 * id").isEmpty() and got.select("id").distinct().count() == n


def test_one_group_over_many_ranges(spark):
    """All rows of one group, in other ranges than those of a single window."""
    rows = spark.range(0, 5000, 1, 8).select((F.col("id") % 7 == 0).alias("g"), F.expr("(id * 7919) % 5000").alias("t"), F.expr("cast(id % 91 as double)").alias("v"), "id")
    w = Window.partitionBy("g").orderBy("t")
    want = rows.select("id", (F.sum(F.col("v").cast("decimal(18,2)")).over(w).cast("double") / F.count("v").over(w)).alias("m"),
                       (F.col("v") < F.coalesce(F.min("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1e9))).alias("b"), F.row_number().over(w).alias("i"))
    got = ordered.running_mean(rows, "v", "g", ["t"]).select("id", "running_mean")
    best = ordered.best_so_far(rows, "v", "g", ["t"]).select("id", "is_best")
    place = ordered.accumulation(rows, "g", ["t"], 4).select("id", "iter")
    assert got.exceptAll(want.select("id", "m")).isEmpty()
    assert best.exceptAll(want.select("id", "b")).isEmpty() and best.where("is_best").count() >= 2
    assert place.exceptAll(want.select("id", "i")).isEmpty()
    used = ordered.cumulative_usage(rows, "v", "g", ["t"], 91).groupBy("g").agg(F.max("used").alias("u"))
    assert {r["g"]: r["u"] for r in used.collect()} == {True: 13, False: 78}  # 91 is 7 times 13


def test_moving_average_over_ranges_is_the_plain_recurrence(spark):
    values = [((k * 37) % 101) / 7.0 for k in range(3000)]
    rows = spark.createDataFrame([(k % 2 == 0 or k > 1000, k, v) for k, v in enumerate(values)], "g boolean, t int, v double")
    got = {r["g"]: (r["updates"], r["ema"]) for r in ordered.moving_average(rows, "v", "g", ["t"], 0.99, 50.0).collect()}
    for g in (True, False):
        own = [v for k, v in enumerate(values) if (k % 2 == 0 or k > 1000) == g]
        ema = own[0]
        for k, v in enumerate(own, 1):
            d = ordered.ramped_decay(k, 0.99, 50.0)
            ema = ema * d + (1 - d) * v
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(ema, rel=1e-12)


def test_running_statistics_with_gaps_between_batches(spark):
    stats = [(c, b, 1.0 * b + c, 2.0 + b) for c in (0, 1) for b in (7, 3, 20, 4)]
    df = spark.createDataFrame(stats, "channel int, batch int, mean double, var double")
    got = {r["channel"]: tuple(r)[1:] for r in ordered.running_statistics(df, "channel", "batch", 0.25).collect()}
    for c in (0, 1):
        mean, var = 0.0, 1.0
        for b in (3, 4, 7, 20):
            mean, var = 0.75 * mean + 0.25 * (b + c), 0.75 * var + 0.25 * (2 + b)
        assert got[c] == (4, pytest.approx(mean), pytest.approx(var))
    with pytest.raises(Exception, match="without some"):
        ordered.running_statistics(df.where("channel = 0 or batch > 3"), "channel", "batch").collect()


def test_usage_from_bitmaps_is_that_of_the_codes(spark):
    from prismata.operators import quantize as Q

    rows = spark.range(0, 9000, 1, 5).select((F.col("id") % 3).alias("rank"), (F.col("id") * 104729 % 65536).alias("code")).unionByName(spark.createDataFrame([(0, None), (0, 0), (1, 65535)], "rank long, code long"))
    bitmaps = Q.usage_bitmaps(rows, "rank")
    want = {r["rank"]: r["n"] for r in rows.groupBy("rank").agg(F.count_distinct("code").alias("n")).collect()}
    assert {r["rank"]: r["used"] for r in Q.merged_usage(bitmaps, 65536, "rank").collect()} == want
    assert Q.merged_usage(bitmaps, 65536).first()["used"] == rows.select("code").where("code is not null").distinct().count()
    assert bitmaps.count() <= 3 * 3 and Q.merged_usage(bitmaps.where("false"), 9, "rank").count() == 0
