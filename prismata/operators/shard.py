"""Sharding, batching and padding by explicit row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import permuted
from .dealt import dealt, fresh


def _numbered(rows: DataFrame, order: list[str], name: str, ranges: int | None) -> tuple[DataFrame, int]:
    part, nth, base = fresh(rows, "part", "nth", "base")
    d = dealt(rows, order, part, nth, ranges)
    counts = d.groupBy(part).agg(F.count(F.lit(1)).alias(base))
    total = counts.agg(F.sum(base)).first()[0] or 0
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(part, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))  # a row for each range
    return d.join(bases, part).withColumn(name, F.col(base) + F.col(nth)).select(*rows.columns, name), total


def numbered(rows: DataFrame, order: list[str], name: str = "rn", ranges: int | None = None) -> DataFrame:
    """Row numbers from 0 over the whole table without a single-partition window.

    Rows are dealt by range and counted within each range, and each range starts
    where the ones before it end; only the counts of ranges meet in one place.
    The dealt rows are kept, so that counts and numbers are those of the same
    ranges. Rows equal in the order are numbered in any sequence.
    """
    return _numbered(rows, order, name, ranges)[0]


def shards(rows: DataFrame, order: list[str], ranks: int, total: int | None = None, seed: int | None = None, epoch: int = 0) -> DataFrame:
    """``rank, slot`` of each row, round robin, padded from the start so that all ranks have as many.

    With a seed, the numbers of the rows are permuted, for each epoch anew, and
    the rows are dealt out by their order only once. The padding is fewer rows
    than ranks; a table of fewer rows than ranks is repeated.
    """
    rn, again = fresh(rows, "rn", "again")
    n, found = _numbered(rows, order, rn, None)
    total = found if total is None else total
    if seed is not None:
        n = n.withColumn(rn, permuted(F.col(rn), found, seed, epoch))
    missing = -total % ranks
    if total:
        times = F.floor((F.lit(missing - 1) - F.col(rn)) / F.lit(total)) + 1  # of each row in the padding
        n = n.withColumn(again, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(times, F.lit(0)))))
        n = n.withColumn(rn, F.col(rn) + F.col(again) * total)
    return n.withColumns({"rank": F.col(rn) % ranks, "slot": F.floor(F.col(rn) / ranks)}).select(*rows.columns, "rank", "slot")


def batches(rows: DataFrame, order: list[str], size: int, drop_last: bool) -> DataFrame:
    """``rn`` and ``batch_id`` of each row; with ``drop_last``, without a last batch that is not full."""
    n, total = _numbered(rows, order, "rn", None)
    n = n.withColumn("batch_id", F.expr(f"rn div {size}"))
    return n.where(F.col("batch_id") < F.lit(total // size)) if drop_last else n


def replicated(result: DataFrame, ranks: int) -> DataFrame:
    """``result`` once for each rank, as ranks have it that all work on everything; it is computed once."""
    return result.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))


def per_rank_batch(total: int, ranks: int) -> int:
    if total % ranks:
        raise ValueError(f"a batch of {total} does not divide over {ranks} ranks")
    return total // ranks


def pad_to_square(v: Column, height: Column, width: Column, side: int, fill: float = 0.0) -> Column:
    """A ``height x width`` grid at the top left of a ``side x side`` one, both flattened."""
    cells = F.sequence(F.lit(0), F.lit(side * side - 1))

    def cell(k: Column) -> Column:
        i, j = F.floor(k / side), k % side
        return F.when((i < height) & (j < width), F.get(v, (i * width + j).cast("int"))).otherwise(F.lit(fill))

    return F.transform(cells, cell)


def crop(v: Column, height: Column, width: Column, side: int) -> Column:
    """The inverse of ``pad_to_square``."""
    return F.filter(v, lambda x, k: (F.floor(k / side) < height) & (k % side < width))
