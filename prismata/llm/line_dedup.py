r"""Line deduplication by range-partitioned hashes.

Built from DataFrame functions only. Lines travel as 128-bit hashes, never as
text, and once: they are dealt by range of their hash and sorted within each
range by hash, document and position, and a stream over a range compares each
line with the first of its key. A key that a large share of all lines have is
seen in a sample and not dealt: its first document is a minimum that tasks take
of their own lines before anything is exchanged, and is sent to the lines where
they are. There are no more such keys than ``HOT_KEYS``. What comes back is a
compressed keep bitmap per document: 64-bit words of dropped positions, with
words that drop nothing left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import fresh
from .storage import discard, materialize

#: Keys shorter than this many code points are never dropped.
MIN_KEY = 10
#: One line in ``SAMPLE`` is looked at for hot keys, those with ``HOT_SAMPLES`` or more there; at most ``HOT_KEYS`` are taken, the most frequent.
SAMPLE, HOT_SAMPLES, HOT_KEYS = 64, 16, 50_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(text: Column) -> Column:
    """Tells apart rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """``(doc_id, row_key, bitmap, n_dropped)`` for the documents that lose lines.

    ``bitmap`` is an array of ``(word, bits)``: bit b of word w is set when line
    ``64 * w + b`` is dropped. A null id counts as the largest id; rows with one
    id count as one document. An empty table gives an empty result.
    """
    text = F.col(text_col)
    lines = materialize(
        docs.select(F.col(id_col).alias("doc_id"), _row_key(text).alias("row_key"), F.posexplode(_lines(text)).alias("pos", "line"))
        .select("doc_id", "row_key", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_key)
        .select("doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")),
        "line-hashes",
    )
    key = ["h1", "h2"]
    order = [F.col("doc_id").asc_nulls_last(), F.col("pos").asc()]
    # a key's sample tells whether it is dealt with the others, not what becomes of it
    hot = lines.where(F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SAMPLE)) == 0).groupBy(*key).count().where(F.col("count") >= HOT_SAMPLES)
    hot = F.broadcast(materialize(hot.orderBy(F.col("count").desc(), *key).limit(HOT_KEYS).select(*key), "line-hot-keys"))
    ranged = lines.join(hot, key, "left_anti").repartitionByRange(*key)
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    stream = Window.partitionBy(*key).orderBy(*order)
    found = ranged.withColumn("first", F.first(first).over(stream))
    held = lines.join(hot, key)
    earliest = F.broadcast(materialize(held.groupBy(*key).agg(F.min(first).alias("first")), "line-hot-firsts"))  # a row for each hot key
    found = found.unionByName(held.join(earliest, key))
    dropped = found.where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    words = dropped.groupBy("doc_id", "row_key", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    return words.groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bitmap"),
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
    )


def _dropped_positions(bitmap: Column) -> Column:
    return F.flatten(
        F.transform(
            bitmap,
            lambda w: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["bits"], b) == 1),
                lambda b: w["word"] * 64 + b,
            ),
        )
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """``docs`` with the kept lines as text, and ``n_lines, n_dropped`` added.

    A line's key is the line stripped of ASCII white space at both ends, A-Z in
    lower case. Keys of at least ``min_key`` code points found in two documents
    or more lose all lines except in the smallest id that holds them. A null or
    empty text is one empty line and stays one, as an empty text. Texts of any
    length are split whole. Rows that repeat an id are one document and keep
    their lines from each other. Columns of ``docs`` named ``n_lines`` or
    ``n_dropped`` are replaced; all others are kept, whatever their names. An
    empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped")
    own, at, key, bitmap, gone = fresh(docs, "row_key", "bitmap_id", "bitmap_key", "bitmap", "lines_gone")
    bitmaps = materialize(keep_bitmaps(docs, id_col, text_col, min_key), "line-bitmaps").toDF(at, key, bitmap, gone)
    text = F.col(text_col)
    held = docs.withColumn(own, _row_key(text)).join(bitmaps, F.col(id_col).eqNullSafe(F.col(at)) & (F.col(own) == F.col(key)), "left")
    lines = _lines(text)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), _dropped_positions(F.col(bitmap)))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return held.select(
        *[F.when(F.col(bitmap).isNull(), F.coalesce(text, F.lit(""))).otherwise(kept).alias(text_col) if c == text_col else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, pos, lines[pos] AS line,
         translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM d)
), f AS (
  SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k
), m AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id <> f.first_doc, false) AS gone FROM l LEFT JOIN f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
