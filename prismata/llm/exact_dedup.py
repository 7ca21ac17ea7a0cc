"""Exact deduplication by an extendible-hash index on shared files.

Built from DataFrame functions only. The index is a set of files in the shared
folder:

* *entries*: one row for each different normalised text. Equal texts are
  combined on the map side first and compared byte by byte by the aggregation,
  which has the text itself as key beside its hash; a group of copies of any
  size therefore crosses the shuffle as one row for each map task.
* *directory*: ``2**depth`` slots addressed by the leading bits of the hash.
  It starts as one bucket. A bucket with more than ``capacity`` entries is
  split on its next bit, and where such a bucket is as deep as the directory,
  the directory doubles. A bucket that need not split keeps its smaller local
  depth and is named by several slots. The directory is a table like any other
  and may grow beyond what can be broadcast.
* *buckets*: the entries dealt by key range to owner tasks, sorted by hash.
  Different texts with one hash form a chain and are told apart by digest.

Each document then finds its bucket through the directory and its entry through
the bucket's chain. Entries with many copies are sent to the documents instead,
so that a group of copies does not meet in the task that owns its bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import looked_up
from .storage import discard, materialize

#: Entries that a bucket holds before it is split.
BUCKET_CAPACITY = 50_000
#: Bits beyond the expected depth by which entries are counted, for buckets that hash unevenly.
SPARE_BITS = 4


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _slot(h, depth: int):
    """The leading ``depth`` bits of a 64-bit hash."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(h, 64 - depth)


def build_directory(entries: DataFrame, n_entries: int, capacity: int = BUCKET_CAPACITY) -> tuple[DataFrame, int]:
    """The directory ``(slot, bucket, local_depth)`` over ``entries.h`` and its depth.

    Each round splits the buckets that are overfull, after doubling the
    directory if one of them is as deep as it. Only the largest size and the
    largest depth of an overfull bucket reach the driver. Entries are counted by
    leading bits once, and again by more bits should these not do; entries that
    share all 64 bits stay together as one chain.
    """
    spark = entries.sparkSession
    bits = min(64, SPARE_BITS + (math.ceil(math.log2(n_entries / capacity)) if n_entries > capacity else 0))

    def counted(bits: int) -> DataFrame:
        return materialize(entries.groupBy(_slot(F.col("h"), bits).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "exact-cells")

    cells, depth = counted(bits), 0
    directory = materialize(spark.range(1).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("local_depth")), "exact-directory")
    while True:
        held = cells.select(F.shiftrightunsigned("cell", bits - depth).alias("slot") if depth else F.lit(0).cast("long").alias("slot"), "n")
        sizes = held.join(directory, "slot").groupBy("bucket", "local_depth").agg(F.sum("n").alias("size"))
        over = sizes.where(F.col("size") > capacity).where("local_depth < 64")
        deepest = over.agg(F.max("local_depth")).first()[0]
        if deepest is None:
            return directory, depth
        stale = [directory]
        if deepest == bits:
            bits = min(64, 2 * bits)
            stale.append(cells)
            cells = counted(bits)
        grown = directory
        if deepest == depth:
            grown = directory.select(
                F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1)).alias("slot"), (F.col("bucket") * 2).alias("bucket"), "local_depth"
            )
            depth += 1
            over = over.withColumn("bucket", F.col("bucket") * 2)
        split = F.col("full") & F.expr(f"shiftright(slot, {depth - 1} - local_depth) % 2 = 1")
        grown = grown.join(over.select("bucket", F.lit(True).alias("full")), "bucket", "left").select(
            "slot",
            F.when(split, F.expr(f"bucket + shiftleft(1L, {depth - 1} - local_depth)")).otherwise(F.col("bucket")).alias("bucket"),
            F.when(F.col("full"), F.col("local_depth") + 1).otherwise(F.col("local_depth")).alias("local_depth"),
        )
        grown = materialize(grown, "exact-directory")
        discard(*stale)
        directory = grown


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """One row per row of ``docs``: which of its equal texts stays.

    Columns: ``doc_id, keep_id, group_size, kept, text_sha256, bucket,
    bucket_depth, chain``. Texts are equal when identical after each run of
    ASCII white space became one space. The smallest id of a group stays.

    Null texts count as empty; texts of any length are compared whole. Null ids
    never stay unless all ids of their group are null (then ``keep_id`` is null
    and all rows are kept). Rows that repeat the id that stays are kept too.
    Other columns are ignored, whatever their names. An empty table gives an
    empty result.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn(
        "h", F.xxhash64("norm")
    )
    entries = materialize(
        keyed.groupBy("h", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", "group_size"),
        "exact-entries",
    )
    directory, depth = build_directory(entries, entries.count(), capacity)
    chain = Window.partitionBy("bucket", "h").orderBy("keep_id", "digest")
    buckets = materialize(
        entries.withColumn("slot", _slot(F.col("h"), depth))
        .join(directory, "slot")
        .repartitionByRange("bucket", "h")
        .withColumn("chain", F.row_number().over(chain))
        .select("bucket", "local_depth", "h", "chain", "digest", "keep_id", "group_size"),
        "exact-buckets",
    )
    n = entries.agg(F.sum("group_size")).first()[0] or 0
    discard(entries)
    probes = keyed.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("digest"))
    probes = probes.withColumn("slot", _slot(F.col("h"), depth)).join(directory.select("slot", "bucket"), "slot").drop("slot")
    found = looked_up(probes, buckets, ["bucket", "h", "digest"], ["local_depth", "chain", "keep_id", "group_size"], "group_size", n, "doc_id")
    return found.select(
        "doc_id", "found.keep_id", "found.group_size",
        F.col("doc_id").eqNullSafe(F.col("found.keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "bucket", F.col("found.local_depth").alias("bucket_depth"), "found.chain",
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
"""
