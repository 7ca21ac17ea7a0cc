"""Tables dealt out by ranges of an order, for computations along that order.

A window over a whole table or over a group that holds a third of all rows
would run in one task. Here rows are dealt by range and sorted within each
range, once, and kept in the checkpoint folder; each range is then computed by
itself, and what earlier ranges carry over to it is found from one row of each.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SETTING = "spark.checkpoint.dir"
#: ``monotonically_increasing_id`` has the partition above these bits and the row below.
ROW_BITS = 33


def checkpoint_folder(spark: SparkSession) -> None:
    """See that checkpoints have a folder: the session's, or for a local session without one a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    found = spark.conf.get(SETTING, None)
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError(f"{SETTING} is not set: name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="prismata-checkpoints-")
    context.setCheckpointDir(found)


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and kept in the checkpoint folder, where the loss of an executor does not reach them."""
    checkpoint_folder(rows.sparkSession)
    return rows.checkpoint()


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Column names that ``rows`` does not have."""
    end = uuid.uuid4().hex[:8]
    return [f"_{name}_{end}" for name in names]


def dealt(rows: DataFrame, order: list[str], part: str, nth: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with the number of their range in ``part`` and their place in it, from 0, in ``nth``.

    Ranges follow each other in the order. Without a number of ranges there are
    as many as ``spark.sql.shuffle.partitions`` says, or fewer where adaptive
    execution joins small ones. Rows that are equal in the order stand in any
    sequence, but in one range and in the same sequence for all readers.
    """
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    return stored(ranged.withColumns({part: F.shiftright(at, ROW_BITS), nth: at.bitwiseAND(F.lit((1 << ROW_BITS) - 1))}))


def running(rows: DataFrame, group: list[str], order: list[str], folds: dict[str, tuple[Column, Callable[[Column], Column], Callable[[Column, Column], Column]]],
            before: bool = False) -> DataFrame:
    """``rows`` with running aggregates within each group, up to each row or, with ``before``, up to the one before it.

    ``folds`` has for each new column the value, the aggregate function (one
    that takes partial results as values, such as ``sum`` or ``min``) and how
    two results are put together. A group of any size is spread over ranges; what
    it carries from one to the next is sent to the rows, so that only the
    windows within ranges exchange them again.
    """
    part, nth, *held = fresh(rows, "part", "nth", *folds)
    values = dict(zip(held, folds.values(), strict=True))
    d = dealt(rows.withColumns({c: v for c, (v, _, _) in values.items()}), [*group, *order], part, nth)
    keys = F.struct(*group)
    ends = d.groupBy(part).agg(F.min_by(keys, nth).alias("a"), F.max_by(keys, nth).alias("b")).select(F.explode(F.array_distinct(F.array("a", "b"))).alias("g"))
    spread = ends.groupBy("g").count().where("count > 1").select(*[F.col("g").getField(g).alias(f"{g}{part}") for g in group])  # no more than ranges
    same = [F.col(g).eqNullSafe(F.col(f"{g}{part}")) for g in group]
    totals = d.join(F.broadcast(spread), same).groupBy(*group, part).agg(*[f(c).alias(c) for c, (_, f, _) in values.items()])
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(g).alias(f"{g}{part}") for g in group], F.col(part).alias(f"{part}c"), *[f(c).over(earlier).alias(f"{c}c") for c, (_, f, _) in values.items()])
    joined = d.join(F.broadcast(stored(carried)), [*same, F.col(part) == F.col(f"{part}c")], "left")  # no more than two rows a range
    own = Window.partitionBy(*group, part).orderBy(nth).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    out = joined.select(*rows.columns, *[f(c).over(own).alias(c) for c, (_, f, _) in values.items()], *[f"{c}c" for c in values])
    both = lambda a, b, put: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(put(a, b))
    return out.select(*rows.columns, *[both(F.col(f"{c}c"), F.col(c), put).alias(name) for name, (c, (_, _, put)) in zip(folds, values.items(), strict=True)])
