"""Named losses and transforms, and chains of transforms on rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V

#: Losses of a prediction and a target, both arrays, by name.
LOSSES: dict[str, Callable[[Column, Column], Column]] = {
    "l1": V.l1,
    "l2": V.mse,
    "psnr": lambda a, b: V.psnr(V.mse(a, b)),
    "smooth_l1": lambda a, b: V.mean(F.zip_with(a, b, lambda x, y: F.when(F.abs(x - y) < 1, 0.5 * (x - y) * (x - y)).otherwise(F.abs(x - y) - 0.5))),
    "cosine": lambda a, b: 1 - V.dot(V.l2_normalize(a), V.l2_normalize(b)),
}

Step = Callable[[DataFrame], DataFrame]


def loss(name: str, prediction: Column, target: Column) -> Column:
    if name not in LOSSES:
        raise KeyError(f"no loss {name!r}; there are {', '.join(sorted(LOSSES))}")
    return LOSSES[name](prediction, target)


def chain(*steps: Step) -> Step:
    """One step that takes the steps in turn; Spark sees a single plan."""
    def run(rows: DataFrame) -> DataFrame:
        for step in steps:
            rows = step(rows)
        return rows

    return run


def on(column: str, f: Callable[[Column], Column]) -> Step:
    """A step that replaces one column."""
    return lambda rows: rows.withColumn(column, f(F.col(column)))


def collated(rows: DataFrame, batch: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row per batch with an array for each field, in order; fields of rows may be arrays of different lengths."""
    held = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("held")))).alias("rows"))
    return held.select(batch, *[F.col(f"rows.held.{f}").alias(f) for f in fields])
