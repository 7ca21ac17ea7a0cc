"""Streams over files against their batch twins."""

from pyspark.sql import functions as F

from prismata.streaming import running


def test_meter_and_usage(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k, build in enumerate((lambda d: running.streaming_meter(d, "value", "event_type"), lambda d: running.streaming_usage(d, "event_type", 8, "user_id"))):
        query = build(stream).writeStream.format("memory").queryName(f"s{k}").outputMode("complete").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert sorted(map(tuple, spark.table(f"s{k}").collect())) == sorted(map(tuple, build(events).collect()))


def test_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    rows = running.windowed_meter(events, "ts", "value", "1 day", "1 hour")
    assert rows.agg(F.sum("n")).first()[0] == events.count()


def _events_in_files(spark, sf, root):
    """Events in order over three files, as a stream's source gets them one after another."""
    from pyspark.sql.window import Window

    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    third = F.ntile(3).over(Window.orderBy("ts", "event_id"))
    parts = events.withColumn("third", third).cache()
    for k in (1, 2, 3):
        parts.where(f"third = {k}").drop("third").repartition(1).write.parquet(f"{root}/part{k}")
    return events


def _run(spark, build, source, out, checkpoint, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)


def test_stateful_streams_go_on_after_a_restart(spark, sf, tmp_path):
    """Two files, a stop, a third file: the rows are those of the batch forms."""
    from prismata.operators import ordered
    from prismata.streaming import stateful

    stateful.use_state_store(spark)
    order = ["ts", "event_id"]
    all_files = tmp_path / "all"
    events = _events_in_files(spark, sf, all_files)
    forms = {
        "best": (lambda d: stateful.best_so_far(d, "value", "user_id", order), lambda: ordered.best_so_far(events, "value", "user_id", order), ["event_id", "is_best"]),
        "usage": (lambda d: stateful.cumulative_usage(d, "event_type", "user_id", order, 8), lambda: ordered.cumulative_usage(events, "event_type", "user_id", order, 8), ["event_id", "used", "usage"]),
    }
    for name, (build, batch, columns) in forms.items():
        source = tmp_path / f"in-{name}"
        source.mkdir()
        for k in (1, 2):
            (all_files / f"part{k}").rename(source / f"part{k}")
        where = str(tmp_path / f"out-{name}"), str(tmp_path / f"check-{name}")
        _run(spark, build, source, *where, events.schema)
        before = spark.read.parquet(where[0]).count()
        (all_files / "part3").rename(source / "part3")
        _run(spark, build, source, *where, events.schema)
        got = spark.read.parquet(where[0])
        assert 0 < before < got.count() == events.count()
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, batch().select(columns).collect()))
        for k in (1, 2, 3):
            (source / f"part{k}").rename(all_files / f"part{k}")


def test_a_moving_average_goes_on_after_a_restart(spark, sf, tmp_path):
    from prismata.operators import ordered
    from prismata.streaming import stateful

    stateful.use_state_store(spark)
    events = _events_in_files(spark, sf, tmp_path / "all")
    source, where = tmp_path / "in", (str(tmp_path / "out"), str(tmp_path / "check"))
    source.mkdir()
    for k in (1, 2, 3):
        (tmp_path / "all" / f"part{k}").rename(source / f"part{k}")
        _run(spark, lambda d: stateful.moving_average(d, "value", "user_id", ["ts", "event_id"], 0.9, 20.0), source, *where, events.schema)
    got = spark.read.parquet(where[0]).groupBy("user_id").agg(F.max(F.struct("updates", "ema")).alias("last"), F.count(F.lit(1)).alias("n"))
    want = {r["user_id"]: (r["updates"], r["ema"]) for r in ordered.moving_average(events, "value", "user_id", ["ts", "event_id"], 0.9, 20.0).collect()}
    for r in got.collect():
        updates, ema = want.pop(r["user_id"])
        assert r["n"] == r["last"]["updates"] == updates and abs(r["last"]["ema"] - ema) < 1e-9
    assert not want
