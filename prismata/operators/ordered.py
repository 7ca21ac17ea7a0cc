"""Computations along an order: meters, best so far, usage so far, moving averages, accumulation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dealt import dealt, fresh, running
from .shard import numbered


def _listed(group: str | list[str]) -> list[str]:
    return [group] if isinstance(group, str) else group


def _added(a: Column, b: Column) -> Column:
    return a + b


def running_mean(rows: DataFrame, value: str, group: str | list[str], order: list[str], scale: int = 2) -> DataFrame:
    """Sums exactly, as decimals, and divides once."""
    total, n = fresh(rows, "total", "n")
    held = F.col(value).cast(f"decimal(18,{scale})")
    found = running(rows, _listed(group), order, {total: (held, F.sum, _added), n: (F.col(value).isNotNull().cast("long"), F.sum, _added)})
    mean = F.when(F.col(n) > 0, F.col(total).cast("double") / F.col(n))
    return found.withColumn("running_mean", mean).drop(total, n)


def best_so_far(rows: DataFrame, loss: str, group: str | list[str], order: list[str], initial: float = 1e9) -> DataFrame:
    """Whether a row is strictly below all before it, and below ``initial``."""
    (low,) = fresh(rows, "low")
    found = running(rows, _listed(group), order, {low: (F.col(loss), F.min, F.least)}, before=True)
    return found.withColumn("is_best", F.col(loss) < F.coalesce(low, F.lit(initial))).drop(low)


def cumulative_usage(rows: DataFrame, code: str, group: str | list[str], order: list[str], size: int) -> DataFrame:
    """Share of ``size`` codes seen up to each row, from the first row of each code; ``order`` tells all rows of a group apart."""
    group = _listed(group)
    (new,) = fresh(rows, "new")
    first = rows.groupBy(*group, code).agg(F.min(F.struct(*order)).alias(new)).select(*group, code, *[F.col(f"{new}.{c}").alias(c) for c in order], F.lit(1).alias(new))
    flagged = rows.join(first, [*group, code, *order], "left").withColumn(new, F.coalesce(new, F.lit(0)))
    found = running(flagged, group, order, {"used": (F.col(new), F.sum, _added)})
    return found.withColumn("usage", F.col("used") / F.lit(float(size))).select(*rows.columns, "used", "usage")


def moving_average(rows: DataFrame, value: str, group: str | list[str], order: list[str], decay: float = 0.9999, tau: float = 2000.0) -> DataFrame:
    """The moving average of each group with a decay that ramps up, started at its first value.

    Each step maps the average to ``a * average + b``. The steps of one range of
    a group are put together to one such map, by sums: ``a`` is the product of
    the steps' factors, and each step adds to ``b`` its share times the factors of
    those after it. The maps of all ranges are applied in turn, so that no row
    holds a group's history, or a range's.
    """
    group = _listed(group)
    part, nth, k, base, rest, own = fresh(rows, "part", "nth", "k", "base", "rest", "own")
    d = dealt(rows.select(*group, *order, F.col(value).cast("double").alias(value)), [*group, *order], part, nth)
    counts = d.groupBy(*group, part).agg(F.count(F.lit(1)).alias(k), F.min(nth).alias(base))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, part, (F.coalesce(F.sum(k).over(earlier), F.lit(0)) - F.col(base) + 1).alias(base))
    steps = d.join(counts, [*group, part]).withColumn(k, F.col(base) + F.col(nth))

    factor = decay * (1 - F.exp(-F.col(k) / F.lit(tau)))
    later = Window.partitionBy(*group, part).orderBy(F.col(k).desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn(own, F.ln(factor)).withColumn(rest, F.coalesce(F.sum(own).over(later), F.lit(0.0)))
    maps = steps.groupBy(*group, part).agg(
        F.min(F.struct(k, value))[value].alias("v"), F.count(F.lit(1)).cast("int").alias("n"), F.exp(F.sum(own)).alias("a"),
        F.sum((1 - F.exp(own)) * F.col(value) * F.exp(rest)).alias("b"))
    held = maps.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(part, "v", "n", "a", "b"))).alias("h"))  # a row for each range
    ema = F.aggregate("h", F.get("h", 0)["v"], lambda acc, x: acc * x["a"] + x["b"])
    return held.select(*group, F.aggregate("h", F.lit(0), lambda acc, x: acc + x["n"]).alias("updates"), ema.alias("ema"))


def running_statistics(stats: DataFrame, key: str, batch: str, momentum: float = 0.1) -> DataFrame:
    """``key, updates, running_mean, running_var`` from ``mean, var`` of each key's batches.

    They start at 0 and 1; each batch, in order, weighs ``momentum`` and all
    before it less by as much. Batch numbers may have gaps: a batch counts by its
    place among those of the whole table, and each key has all of them.
    """
    (place,) = fresh(stats, "place")
    places = numbered(stats.select(batch).distinct(), [batch], place)
    n = places.agg((F.max(place) + 1).alias("updates"))
    s = stats.join(places, batch).join(F.broadcast(n))  # one row
    weight = momentum * F.pow(F.lit(1 - momentum), F.col("updates") - 1 - F.col(place))
    total = s.groupBy(key, "updates").agg(F.sum(weight * F.col("mean")).alias("m"), F.sum(weight * F.col("var")).alias("v"), F.count(F.lit(1)).alias("k"))
    whole = F.when(F.col("k") == F.col("updates"), F.col("v")).otherwise(F.raise_error(F.lit("a key without some of the batches")).cast("double"))
    return total.select(key, "updates", F.col("m").alias("running_mean"), (F.pow(F.lit(1 - momentum), F.col("updates")) + whole).alias("running_var"))


def accumulation(rows: DataFrame, group: str | list[str], order: list[str], every: int) -> DataFrame:
    """Position, step of the optimiser, and whether a row completes a step."""
    found = running(rows, _listed(group), order, {"iter": (F.lit(1), F.sum, _added)})
    n = F.col("iter").cast("int")
    return found.withColumn("iter", n).withColumn("step", F.ceil(n / F.lit(every)).cast("long")).withColumn("acts", n % every == 0)


def fractional_epoch(rows: DataFrame, epoch: str, order: list[str]) -> DataFrame:
    """The epochs done at each row, with its place in its own as a fraction."""
    n, total = fresh(rows, "n", "total")
    found = running(rows, [epoch], order, {n: (F.lit(1), F.sum, _added)})
    counts = rows.groupBy(epoch).agg(F.count(F.lit(1)).alias(total))
    return found.join(counts, epoch).withColumn("progress", F.col(n) / F.col(total) + F.col(epoch) - 1).select(*rows.columns, "progress")


def class_index(rows: DataFrame, name: str) -> DataFrame:
    """``name, label``: contiguous labels in name order, over the distinct names only."""
    return rows.select(name).distinct().withColumn("label", (F.dense_rank().over(Window.orderBy(name)) - 1).cast("int"))


def ramped_decay(k: int, decay: float = 0.9999, tau: float = 2000.0) -> float:
    return decay * (1 - math.exp(-k / tau))
