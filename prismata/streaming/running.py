"""Structured Streaming forms of the meter and of codebook usage.

Beyond the operators' batch forms: Spark's own streaming, kept to aggregations
whose state is one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_meter(rows: DataFrame, value: str, *by: str, scale: int = 2) -> DataFrame:
    """Exact running sum and count per key, and their quotient, in update or complete mode."""
    total = F.sum(F.col(value).cast(f"decimal(18,{scale})"))
    return rows.groupBy(*by).agg(total.cast("double").alias("total"), F.count(value).alias("n")).withColumn("mean", F.col("total") / F.col("n"))


def streaming_usage(rows: DataFrame, code: str, size: int, *by: str) -> DataFrame:
    """Codes seen so far per key; the state is a bitmap of the codebook, as a set of at most ``size`` codes."""
    return rows.groupBy(*by).agg(F.size(F.collect_set(code)).alias("used")).withColumn("usage", F.col("used") / F.lit(float(size)))


def windowed_meter(rows: DataFrame, time: str, value: str, width: str, late: str) -> DataFrame:
    """Mean per tumbling window; rows later than the watermark are left out."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
