"""Vector and finite scalar quantization, and codebook usage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Level sets by name, and (codebook size, stride) of the vector codebooks.
FSQ_LEVELS = {"4K": [7, 5, 5, 5, 5], "16K": [8, 8, 8, 6, 5], "64K": [8, 8, 8, 5, 5, 5]}
VQ_PRESETS = {"VQ_8_4096": (4096, 8), "VQ_8_16384": (16384, 8), "VQ_8_65536": (65536, 8),
              "VQ_16_4096": (4096, 16), "VQ_16_16384": (16384, 16), "VQ_16_65536": (65536, 16)}
#: The array form of a codebook goes to every row as one value; codebooks of any size are for ``tiles.nearest_code``.
ARRAY_LIMIT = 1 << 18


def fsq_basis(levels: list[int]) -> list[int]:
    return [math.prod(levels[:i]) for i in range(len(levels))]


def fsq_bound(z: Column, level: int, eps: float = 1e-3) -> Column:
    half = (level - 1) * (1 - eps) / 2
    offset = 0.5 if level % 2 == 0 else 0.0
    return F.tanh(z + math.tan(offset / half)) * half - offset


def fsq_digit(z: Column, level: int) -> Column:
    """The rounded code of one dimension, from 0 to ``level - 1``; ties go to the even number."""
    return F.rint(fsq_bound(z, level)).cast("int") + level // 2


def fsq_index(v: Column, levels: list[int], scale: float = 1.0) -> Column:
    parts = (fsq_digit(F.get(v, i) * scale, n) * b for i, (n, b) in enumerate(zip(levels, fsq_basis(levels), strict=True)))
    return sum(parts, F.lit(0))


def fsq_codes(index: Column, levels: list[int]) -> Column:
    """The normalised code vector of an index."""
    return F.array(*[(F.floor(index / b).cast("int") % n - n // 2) / float(n // 2) for n, b in zip(levels, fsq_basis(levels), strict=True)])


def with_codebook(rows: DataFrame, codebook: DataFrame) -> DataFrame:
    """``rows`` with the codebook ``(code, vec)`` as one array, ordered by code.

    The codebook is one row after aggregation, so joining it copies a value and
    makes no pairs; its size is checked.
    """
    size = codebook.agg(F.sum(F.size("vec"))).first()[0] or 0
    if size > ARRAY_LIMIT:
        raise ValueError(f"a codebook of {size} numbers; use tiles.nearest_code")
    whole = codebook.agg(F.array_sort(F.collect_list(F.struct("code", "vec"))).alias("codebook"))
    return rows.join(F.broadcast(whole), how="inner")


def distances(v: Column) -> Column:
    """Squared distances of a unit vector to the unit vectors of the column ``codebook``, as ``(dist, code)``."""
    return F.transform("codebook", lambda c: F.struct((F.round(2 - 2 * V.dot(v, c["vec"]), 9) + 0.0).alias("dist"), c["code"].alias("code")))


def nearest_code(rows: DataFrame, codebook: DataFrame, vec: str = "v") -> DataFrame:
    """Adds ``code, dist``; of equal distances the lower code wins."""
    found = with_codebook(rows, codebook).withColumn("_near", F.array_min(distances(F.col(vec))))
    return found.select(*[F.col(c) for c in rows.columns], F.col("_near.code").alias("code"), F.col("_near.dist").alias("dist"))


def nearest_code_arrow(rows: DataFrame, codebook: DataFrame, vec: str = "v", most: int = 1 << 24) -> DataFrame:
    """The same by matrix products over Arrow batches, for a codebook of a fixed size that tasks may hold; others are for ``tiles.nearest_code``."""
    import numpy as np
    import pandas as pd

    size = codebook.agg(F.sum(F.size("vec"))).first()[0] or 0
    if size > most:
        raise ValueError(f"a codebook of {size} numbers exceeds {most}")
    held = codebook.orderBy("code").toPandas()
    codes, table = held["code"].to_numpy(), np.stack(held["vec"].to_numpy()).astype(np.float64)

    def work(batches):
        for pdf in batches:
            if len(pdf):
                d = np.round(2 - 2 * np.stack(pdf[vec].to_numpy()) @ table.T, 9) + 0.0
                best = d.argmin(1)
                yield pdf.assign(code=codes[best], dist=d[np.arange(len(pdf)), best])
            else:
                yield pdf.assign(code=pd.Series(dtype="int64"), dist=pd.Series(dtype="float64"))

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(work, f"{kinds}, code {dict(codebook.dtypes)['code']}, dist double")


def lookup(rows: DataFrame, codebook: DataFrame, code: str = "code") -> DataFrame:
    return rows.join(codebook.select(F.col("code").alias(code), F.col("vec").alias("quantized")), code)


def usage(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """Share of the codebook that occurs."""
    used = F.count_distinct("code")
    return (rows.groupBy(*by) if by else rows).agg(used.alias("used"), (used / F.lit(float(size))).alias("usage"))


def mean_rank_usage(rows: DataFrame, size: int, rank: str) -> DataFrame:
    """Mean over ranks of each rank's own usage; no more than the usage of the union."""
    return usage(rows, size, rank).agg(F.avg("usage").alias("mean_usage"))


def usage_bitmaps(rows: DataFrame, *by: str) -> DataFrame:
    """``by, bucket, bits``: which codes occur, one bit each, 32768 codes a row.

    Such tables can be stored, and those of several batches or ranks be merged,
    without the codes themselves.
    """
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col("code"))).alias("bits")
    return rows.where("code is not null").groupBy(*by, F.bitmap_bucket_number(F.col("code")).alias("bucket")).agg(bits)


def merged_usage(bitmaps: DataFrame, size: int, *by: str) -> DataFrame:
    """``by, used, usage`` of the union of bitmaps with the same ``by``."""
    whole = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("used"))
    return (whole.groupBy(*by) if by else whole).agg(F.sum("used").alias("used"), (F.sum("used") / F.lit(float(size))).alias("usage"))
