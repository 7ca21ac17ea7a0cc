"""Checkpoints as tables: selection, comparison, renaming and grouping of named tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def loadable(saved: DataFrame, model: DataFrame, excluded: list[str]) -> DataFrame:
    """Tensors of ``saved (name, shape)`` that the model has by name and shape and no excluded part names."""
    clean = saved
    for part in excluded:
        clean = clean.where(~F.contains("name", F.lit(part)))
    return clean.join(model.select("name", "shape"), ["name", "shape"], "left_semi")


def missing(saved: DataFrame, model: DataFrame) -> DataFrame:
    return model.join(saved.select("name"), "name", "left_anti")


def compare(left: DataFrame, right: DataFrame, shape: str | None = None) -> DataFrame:
    """``name, verdict, max_diff`` of each tensor of ``left (name, data)`` against ``right``.

    Shapes are those of the column ``shape``; without one, the numbers of values.
    """
    other = right.select("name", F.col("data").alias("other"), *([F.col(shape).alias("other_shape")] if shape else []))
    diff = F.array_max(F.zip_with("data", "other", lambda a, b: F.abs(a - b)))
    same = F.col(shape) == F.col("other_shape") if shape else F.size("data") == F.size("other")
    return left.join(other, "name", "left").select(
        "name",
        F.when(F.col("other").isNull(), "missing").when(~same, "shape").when(F.col("data") == F.col("other"), "equal").otherwise("different").alias("verdict"),
        F.when(same, diff).alias("max_diff"),
    )


def parameter_group(name: Column, ndim: Column, trainable: Column, plain: list[str]) -> Column:
    """``decay`` for matrices whose name has none of the ``plain`` parts, else ``no_decay``; NULL if frozen."""
    named = F.lit(False)
    for part in plain:
        named = named | F.contains(name, F.lit(part))
    return F.when(trainable, F.when((ndim >= 2) & ~named, "decay").otherwise("no_decay"))


def grouped_parameters(rows: DataFrame, decay: str, rate: str, name: str) -> DataFrame:
    """The names of each pair of settings, sorted."""
    return rows.groupBy(decay, rate).agg(F.array_sort(F.collect_list(name)).alias("names"), F.count(F.lit(1)).alias("n"))


#: Parts of autoencoder tensor names and what they become, in this order.
RENAMES = [
    ("mid_block.resnets.0.", "mid.block_1."),
    ("mid_block.resnets.1.", "mid.block_2."),
    ("mid_block.attentions.0.group_norm", "mid.attn_1.norm"),
    ("mid_block.attentions.0.to_q", "mid.attn_1.q"),
    ("mid_block.attentions.0.to_k", "mid.attn_1.k"),
    ("mid_block.attentions.0.to_v", "mid.attn_1.v"),
    ("mid_block.attentions.0.to_out.0", "mid.attn_1.proj_out"),
    ("conv_norm_out", "norm_out"),
    ("conv_shortcut", "nin_shortcut"),
    (".resnets.", ".block."),
    ("downsamplers.0.", "downsample."),
    ("upsamplers.0.", "upsample."),
]
UP_STAGES = 4


def renamed(name: Column, quant_under_coders: bool = True) -> Column:
    """The tensor name in the other layout; upward stages are counted from the other end."""
    out = name
    for old, new in RENAMES:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.replace(out, F.lit("encoder.down_blocks."), F.lit("encoder.down."))
    parts = F.split(out, r"\.")
    stage = F.try_element_at(parts, F.lit(3)).try_cast("int")
    rest = F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), ".")
    out = F.when(F.startswith(out, F.lit("decoder.up_blocks.")), F.concat(F.lit("decoder.up."), (UP_STAGES - 1 - stage).cast("string"), F.lit("."), rest)).otherwise(out)
    if quant_under_coders:
        out = F.when(F.startswith(out, F.lit("quant_conv.")), F.concat(F.lit("encoder."), out)).when(
            F.startswith(out, F.lit("post_quant_conv.")), F.concat(F.lit("decoder."), out)).otherwise(out)
    return out


def as_convolution(name: Column, shape: Column) -> Column:
    """The shape of attention matrices as 1 x 1 convolutions."""
    attention = F.contains(name, F.lit(".attentions.")) & F.endswith(name, F.lit(".weight")) & (F.size(shape) == 2)
    return F.when(attention, F.concat(shape, F.array(F.lit(1), F.lit(1)))).otherwise(shape)


def parameter_count(shape: Column) -> Column:
    return F.aggregate(shape.cast("array<bigint>"), F.lit(1).cast("bigint"), lambda a, x: a * x)
