"""Which checkpoint files a training run leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint_files(epochs: DataFrame, run: str, epoch: str, loss: str, every: int, initial: float = 1e9) -> DataFrame:
    """``run, file, epoch`` of each file at the end of each run.

    A numbered file of every ``every``-th epoch and of the last; the best one,
    that of the first epoch with the lowest loss, named by that loss, unless no
    loss is below ``initial``; and the latest.
    """
    e, value = F.col(epoch), F.col(loss)
    ends = epochs.groupBy(run).agg(F.max(epoch).alias("last"), F.min(F.when(value < initial, F.struct(value.alias("loss"), e.alias("epoch")))).alias("best"))
    numbered = epochs.join(ends, run).where((e % every == 0) | (e == F.col("last"))).select(run, F.format_string("epoch_%d_model.pth", e.cast("long")).alias("file"), e.alias("epoch"))
    best = ends.where("best is not null").select(run, F.format_string("total_loss%.3f.pth", "best.loss").alias("file"), F.col("best.epoch").alias("epoch"))
    return numbered.unionByName(best).unionByName(ends.select(run, F.lit("latest.pth").alias("file"), F.col("last").alias("epoch")))
