"""Image files: written by tasks, listed, and decoded by Spark's own image source."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import manifest as M


def png(height: int, width: int, rgb: bytes) -> bytes:
    """An image of 8-bit RGB pixels as a PNG file, its rows unfiltered."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    row = 3 * width
    lines = b"".join(b"\0" + rgb[k * row : (k + 1) * row] for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def encoded(rows: DataFrame, height: str, width: str, pixels: str) -> DataFrame:
    """``path, content`` from ``path``, two sizes and pixels ``h w c`` of whole numbers from 0 to 255, as PNG files."""
    ship(rows.sparkSession)

    @F.pandas_udf("binary")
    def png_of(h: pd.Series, w: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([png(int(a), int(b), bytes(x.tolist())) for a, b, x in zip(h, w, v, strict=True)], dtype="object")

    return rows.select("path", png_of(height, width, pixels).alias("content"))


def jpeg_encoded(rows: DataFrame, height: str, width: str, pixels: str, quality: int = 95, halved_colour: bool = True) -> DataFrame:
    """The same as JPEG files, of one or three channels."""
    from ..functions.jpeg import encoded as jpeg
    from ..functions.pixels import image

    ship(rows.sparkSession)

    @F.pandas_udf("binary")
    def jpeg_of(h: pd.Series, w: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([jpeg(image(x, int(a), int(b)), quality, halved_colour) for a, b, x in zip(h, w, v, strict=True)], dtype="object")

    return rows.select("path", jpeg_of(height, width, pixels).alias("content"))


def write_files(rows: DataFrame, root: str) -> int:
    """Write ``content`` to ``root/path`` of each row; gives the number of files.

    Each task writes its own rows, to any file system that Arrow knows. A task
    that runs twice writes the same files again.
    """
    def work(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        n = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                full = f"{base}/{path}"
                system.create_dir(full.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(full) as out:
                    out.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.select("path", "content").mapInArrow(work, "n long").agg(F.sum("n")).first()[0] or 0


def decoded(spark: SparkSession, root: str, suffix: str | None = None) -> DataFrame:
    """``path, height, width, pixels`` (``h w c`` in the order red, green, blue) of the images below ``root``.

    The source gives blue first; files that are no images are left out.
    """
    @F.pandas_udf("array<int>")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for x, n in zip(data, channels, strict=True):
            v = np.frombuffer(x, np.uint8).reshape(-1, int(n)).astype(np.int32)
            out.append((np.repeat(v, 3, 1) if n == 1 else v[:, 2::-1]).ravel())
        return pd.Series(out, dtype="object")

    reader = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    image = reader.load(root).select("image.*")
    return image.select(F.col("origin").alias("path"), "height", "width", rgb("data", "nChannels").alias("pixels"))


def captioned_sets(spark: SparkSession, root: str, names: list[str], split: str) -> DataFrame:
    """``dataset, name, caption`` of the ``.jpg`` files of several data sets, each with its captions in ``root/name/name_split.json``.

    A file without a caption, or a name in two sets, is an error.
    """
    sets = {}
    for name in names:
        images = M.files(spark, f"{root}/{name}/{split}", ".jpg").select("name")
        sets[name] = M.strict_captions(images, M.captions(spark, f"{root}/{name}/{name}_{split}.json"))
    return M.joined_sets(sets).select("dataset", "name", "caption")


def edited_sets(spark: SparkSession, root: str, names: list[str], split: str) -> DataFrame:
    """``dataset, source, edited, caption`` of the pairs of several data sets; captions are those of the sources."""
    whole = None
    for name in names:
        pairs = M.edit_pairs(M.files(spark, f"{root}/{name}/{split}", ".jpg").select("name"))
        held = M.captions(spark, f"{root}/{name}/{name}_{split}.json").withColumnRenamed("name", "source")
        one = pairs.join(held, "source").select(F.lit(name).alias("dataset"), "source", "edited", "caption")
        whole = one if whole is None else whole.unionByName(one)
    return whole


