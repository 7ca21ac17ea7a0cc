"""Queries over checkpoint files, which tasks write from rows of the tables and the data source reads by ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tensors as T
from .image_queries import folder
from .vector_queries import rows

ENTRIES: dict = {}


def entry(name, sql):
    def add(f):
        ENTRIES[name] = (f, sql)
        return f

    return add


#: Bytes of a piece and of a task's range, small enough that the vectors of the tables are cut.
PIECE, RANGE = 128, 4096
_FILE = "lpad((vec_id // 100)::VARCHAR, 6, '0') || '{end}' AS file, 'layer.' || label || '.v' || vec_id || '.weight' AS name"
_KIND = "CASE vec_id % 3 WHEN 0 THEN 'F32' WHEN 1 THEN 'F64' ELSE 'I32' END AS dtype"


def _sql(end):
    return f"""WITH e AS (SELECT vec_id, {_FILE.format(end=end)}, {_KIND}, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT *, unnest(range(0, 64, CASE dtype WHEN 'F64' THEN 16 ELSE 32 END)) AS start, CASE dtype WHEN 'F64' THEN 16 ELSE 32 END AS n FROM e)
SELECT file, name, dtype, [8, 8]::BIGINT[] AS shape, start, CASE WHEN dtype <> 'I32' THEN v[start + 1:start + n] END AS data,
CASE WHEN dtype = 'I32' THEN list_transform(v[start + 1:start + n], lambda x: floor(x * 1000)::BIGINT) END AS whole FROM p"""


def _checkpoints(spark, sf_dir, layout, end):
    """Each vector as a tensor of 8 x 8 numbers, a hundred in a file; written by tasks, then read."""
    k = F.col("vec_id")
    dtype = F.when(k % 3 == 0, "F32").when(k % 3 == 1, "F64").otherwise("I32")
    file = F.concat(F.lpad(F.floor(k / 100).cast("string"), 6, "0"), F.lit(end))
    name = F.concat_ws(".", F.lit("layer"), F.col("label").cast("string"), F.concat(F.lit("v"), k.cast("string")), F.lit("weight"))
    data = F.when(dtype == "I32", F.transform("v", lambda x: F.floor(x * 1000).cast("double"))).otherwise(F.col("v"))
    held = rows(spark, sf_dir).select(file.alias("file"), name.alias("name"), dtype.alias("dtype"), F.array(F.lit(8), F.lit(8)).cast("array<bigint>").alias("shape"), data.alias("data"))
    root = folder(spark, layout)
    T.write(held, root, layout)
    return T.read(spark, root, rangeBytes=RANGE, pieceBytes=PIECE).select("file", "name", "dtype", "shape", "start", "data", "whole")


@entry("s9_safetensors", _sql(".safetensors"))
def s9(spark, sf_dir):
    """Tensors of safetensors files, read by byte ranges."""
    return _checkpoints(spark, sf_dir, "safetensors", ".safetensors")


@entry("s10_zipped_pickles", _sql(".pth"))
def s10(spark, sf_dir):
    """Tensors of zipped pickles, whose op codes are read and never run."""
    return _checkpoints(spark, sf_dir, "pickle", ".pth")
