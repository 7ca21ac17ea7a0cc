"""Column names, and joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with so many rows, and with one in ``HOT_KEYS`` of all rows, is joined
#: by broadcast; there are at most ``HOT_KEYS`` such keys, whatever the table.
HOT_ROWS, HOT_KEYS = 1000, 50_000
#: The bitmap of ``likely`` has ``2**LIKELY_BITS`` bits, whatever the table: some megabytes once broadcast.
LIKELY_BITS = 24


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before those that ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], copies: str, total: int, spread: str) -> DataFrame:
    """``rows`` with a struct ``found`` of the ``values`` that ``table`` has for their ``keys``.

    ``copies`` is the column of ``table`` with the number of rows that have the
    key, and ``total`` that of all rows. Hot keys are broadcast to the rows; a
    row that has its value so looks for none in the join that follows, where it
    goes by its column ``spread``. All keys are compared null-safe.
    """
    hot = table.where(F.col(copies) >= max(HOT_ROWS, -(-total // HOT_KEYS))).select(*keys, F.struct(*values).alias("_hot"))
    on = lambda name: [F.col(f"_r.{k}").eqNullSafe(F.col(f"{name}.{k}")) for k in keys]
    some = rows.alias("_r").join(F.broadcast(hot).alias("_h"), on("_h"), "left").select("_r.*", "_h._hot")
    # the last key says whether a row still looks for its value
    cold = table.select(*keys, F.lit(0).cast("long").alias("_open"), F.struct(*values).alias("_cold"))
    some = some.withColumn("_open", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spread).bitwiseOR(F.lit(1).cast("long"))))
    full = some.alias("_r").join(cold.alias("_c"), [*on("_c"), F.col("_r._open") == F.col("_c._open")], "left")
    return full.select("_r.*", "_c._cold").withColumn("found", F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_open")


def likely(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key``, not null, ``table`` does not have.

    All rows whose key is there stay, so a join after it finds what it would
    have found, but has few others to exchange. The bitmap of hashes that is
    broadcast has a fixed size; with more keys in ``table`` more rows stay.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << LIKELY_BITS))
    marks = table.select(F.shiftright(place, 6).alias("_word"), place.bitwiseAND(F.lit(63)).cast("int").alias("_bit"))
    words = marks.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    found = rows.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(words), "_word")
    return found.where(F.getbit("_bits", place.bitwiseAND(F.lit(63)).cast("int")) == 1).select(*rows.columns)
