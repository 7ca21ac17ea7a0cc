"""Token counts through a digest cache.

The cache is a table of ``(content_digest, tokenizer_digest, n_tokens)`` files.
Documents are joined to it by the digest of their normalised content and the
digest of the tokenizer's version. Of the contents it lacks, one document each
is encoded and its count appended; all documents then get their counts from the
cache.

Normalised content has each run of ASCII white space made one space and none at
the ends; the tokenizers served here drop white space before anything else, so
equal digests have equal counts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import blocks, map_arrow
from .columns import looked_up
from .exact_dedup import normalised
from .storage import materialize, new_path
from .word_bpe import Encoder

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _digest(text):
    return F.unhex(F.sha2(F.trim(normalised(text)), 256))


def _encode(path: str):
    def work(batches):
        encoder = Encoder.at(path)
        for rows, data, offsets in blocks(batches):
            counts = encoder.counts(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("content_digest")), pa.array(counts, pa.int64())],
                ["content_digest", "n_tokens"],
            )

    return work


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` and ``cached`` for each row of ``docs``.

    ``cache_path`` is a folder all executors share; without one, the cache is
    empty at the start and kept in the shared folder. ``cached`` tells whether
    the count was there before this call. Null texts count as empty, with no
    tokens; texts of any length are counted whole. Rows with equal or null ids
    keep their own counts. Other columns are ignored, whatever their names. An
    empty table gives an empty result and appends nothing.
    """
    spark = docs.sparkSession
    cache_path = cache_path or new_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def cache() -> DataFrame:
        held = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
        return held.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may append one content

    text = F.col(text_col)
    keyed = materialize(
        docs.select(F.col(id_col).alias("doc_id"), _digest(text).alias("content_digest"),
                    F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes")),
        "token-keys",
    )
    known = materialize(cache().select("content_digest", F.lit(True).alias("cached")), "token-known")
    contents = materialize(
        keyed.groupBy("content_digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .join(known, "content_digest", "left").withColumn("cached", F.coalesce("cached", F.lit(False))), "token-contents"
    )
    misses = contents.where("not cached").select("content_digest", "rep")
    chosen = (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", _digest(F.col("text")))
        .join(misses, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("content_digest")))
        .select("text", "content_digest")
    )
    fresh = map_arrow(chosen, _encode(tokenizer_path), "content_digest binary, n_tokens long").dropDuplicates(["content_digest"])  # rows may repeat the id
    fresh.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache_path)
    counted = cache().join(contents, "content_digest").select("content_digest", "copies", "n_tokens", "cached")
    found = looked_up(keyed, counted, ["content_digest"], ["n_tokens", "cached"], "copies", keyed.count(), "doc_id")
    return found.select("doc_id", "n_bytes", "found.n_tokens", (F.col("found.n_tokens") > limit).alias("over_limit"), "found.cached")
