"""How the sources of a language diverge in their terms, counted behind a sketch.

Each task counts the terms of its rows by language and source, so that what
leaves it is a table of counts, not of occurrences. From these, a count-min
sketch of document frequencies is made: each task adds its counts to four
slots a term, counters stop at the threshold, and the sketches of all tasks are
added slot by slot in tasks that own blocks of slots. A sketch never
underestimates, so a term whose estimate is below the threshold can't be kept,
and its counts are not shuffled. What is left is counted exactly.

Pairs of sources are joined sparsely, on terms that both have. Any other term
has the count 0 in one of them or both; what these add to a pair's value depends
on the count alone, so it is summed over counts and not over terms.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrowtext import map_arrow
from .storage import discard, materialize

#: Documents of a language that a kept term is in, at least; terms listed for each group.
LEAST, TOP = 10, 10
#: Slots in a row of the sketch, a power of two, rows, and slots in a block. A slot is one byte, so the whole sketch has 16 MB.
SLOTS, ROWS, BLOCK = 1 << 22, 4, 1 << 12
#: Entries that a task holds before it gives them out.
HELD = 400_000
#: Sources in a block of the pair join: a term that all sources have is dealt over pairs of blocks.
SOURCES = 256

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, A-Z in lower case."""
    return text.encode().translate(_LETTERS).split()


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents, by task; a null term marks a group that is there."""
    names = ["lang", "source", "term", "n", "docs"]

    def given(groups):
        for (lang, source), (n, d) in groups.items():
            keys = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(keys) + 1), pa.string()), pa.array([source] * (len(keys) + 1), pa.string()), pa.array([None, *keys], pa.binary()).cast(pa.string()),
                 pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(d.__getitem__, keys)], pa.int64())], names)

    def work(batches):
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0
        for rows in batches:
            for text, lang, source in zip(*[c.to_pylist() for c in rows.columns], strict=True):
                n, d = groups.setdefault((lang or "", source or ""), (Counter(), Counter()))
                found, before = terms(text or ""), len(n)
                n.update(found)
                d.update(set(found))
                held += len(n) - before
                if held > HELD:
                    yield from given(groups)
                    groups, held = {}, 0
        yield from given(groups)

    return map_arrow(docs.select(text_col, lang_col, source_col), work, "lang string, source string, term string, n long, docs long")


def _places(h: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each hash in each row of the sketch, over all rows."""
    h = h.view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((a + np.uint64(r) * b) % np.uint64(slots)).astype(np.int64) + r * slots for r in range(ROWS)])


def sketch(table: DataFrame, least: int = LEAST, slots: int = SLOTS) -> bytes:
    """Count-min counters, up to ``least``, of the column ``docs`` by the hash in column ``h``.

    Tasks give their counters that are not 0 in blocks; tasks that own blocks
    add these as they come, and only the sketch itself, whose size is fixed,
    reaches the driver.
    """
    block = min(BLOCK, slots)

    def own(batches):
        seen = np.zeros(ROWS * slots, np.uint8)
        for rows in batches:
            at, n = _places(rows.column(0).to_numpy(), slots), np.minimum(rows.column(1).to_numpy(), least)
            for r in range(ROWS):
                place, where = np.unique(at[r], return_inverse=True)
                seen[place] = np.minimum(seen[place] + np.bincount(where, n), least)
        filled = np.flatnonzero(seen)
        cuts = np.flatnonzero(np.diff(filled // block)) + 1
        for k in range(0, len(cuts) + 1, 256):
            ends = [0, *cuts.tolist(), len(filled)][k : k + 257]
            parts = [filled[a:b] for a, b in zip(ends, ends[1:], strict=False) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(p[0]) // block for p in parts], pa.int32()), pa.array([(p % block).astype(np.uint16).tobytes() for p in parts], pa.binary()),
                 pa.array([seen[p].tobytes() for p in parts], pa.binary())], ["block", "places", "counters"])

    def added(batches):
        held: dict[int, np.ndarray] = {}
        for rows in batches:
            for b, places, counters in zip(*[c.to_pylist() for c in rows.columns], strict=True):
                total, at = held.setdefault(b, np.zeros(block, np.uint8)), np.frombuffer(places, np.uint16)
                total[at] = np.minimum(total[at].astype(np.int64) + np.frombuffer(counters, np.uint8), least)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["block", "counters"])

    owned = map_arrow(map_arrow(table.select("h", "docs"), own, "block int, places binary, counters binary").repartition("block"), added, "block int, counters binary")
    out = np.zeros(ROWS * slots, np.uint8)
    for batch in owned.toArrow().to_batches():
        for b, counters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out[b * block : (b + 1) * block] = np.frombuffer(counters, np.uint8)
    return out.tobytes()


def possible(table: DataFrame, counters: bytes, least: int = LEAST) -> DataFrame:
    """The rows whose hash ``h`` has an estimate of ``least`` or more.

    The sketch goes to them as one row with a bit for each slot, half a megabyte
    for each million of slots.
    """
    slots = len(counters) // ROWS
    bits = np.packbits(np.frombuffer(counters, np.uint8) >= least, bitorder="little").view("<i8")
    held = table.sparkSession.createDataFrame(pa.table({"_bits": pa.array([bits], pa.list_(pa.int64()))}))
    low, high = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1).cast("long"))
    seen = F.lit(True)
    for r in range(ROWS):
        at = (low + r * high).bitwiseAND(F.lit(slots - 1).cast("long")) + r * slots
        seen = seen & (F.getbit(F.get("_bits", F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
    return table.join(F.broadcast(held)).where(seen).drop("_bits")


def share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 (n + 2) / (total + 2 kept))``, exactly."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * whole(n + 2), whole(total + 2 * kept))


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))`` of whole numbers."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, slots: int = SLOTS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far sources are apart, and the terms that mark each.

    Null texts, languages and sources count as empty ones. A language keeps the
    terms that ``least`` of its rows have; repeated rows count each. Part
    ``pair`` has all other sources of the language, ``term`` the ``top`` kept
    terms whose share is greater in the group than in the language. Texts of any
    length are read whole. A group without terms has pairs, of value 0 where its
    language keeps no term. Other columns are not read. An empty table gives an
    empty result.
    """
    rows = materialize(counted(docs, text_col, lang_col, source_col), "term-counts")
    listed = rows.where("term is not null").withColumn("h", F.xxhash64("lang", "term"))
    counters = sketch(listed, least, slots)
    exact = possible(listed, counters, least).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    exact = materialize(exact, "term-survivors")
    words = exact.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    counts = materialize(exact.drop("docs").join(words, ["lang", "term"]), "kept-counts")
    groups = rows.where("term is null").select("lang", "source").distinct()
    langs = words.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    none = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept")))
    groups = materialize(groups.withColumn("none", none), "source-groups")
    discard(rows, exact)

    held = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    marks = held.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    marks = marks.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    pairs = _pairs(groups, held).withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(marks)


def _pairs(groups: DataFrame, held: DataFrame) -> DataFrame:
    """The value of each source and each other one of its language, which are the rows of the result."""
    side = lambda df, name, *columns: df.select("lang", *[F.col(c).alias(f"{name}_{c}") for c in columns])
    one, other = side(groups, "a", "source", "none", "kept"), side(groups, "b", "source", "none")
    both = one.join(other, "lang").where("a_source <> b_source")
    flat = gap(F.col("a_none"), F.col("b_none"))

    by_count = held.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    alone = side(by_count, "a", "source", "p", "terms").join(side(groups, "b", "source", "none"), "lang").where("a_source <> b_source")
    alone = alone.join(side(groups, "a", "source", "none"), ["lang", "a_source"])
    alone = alone.groupBy("lang", "a_source", "b_source").agg(F.sum((gap(F.col("a_p"), F.col("b_none")) - flat) * F.col("a_terms")).alias("part"))
    turned = alone.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), "part")

    blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / SOURCES)).cast("int")
    dealt = held.join(held.groupBy("lang", "term").agg(blocks.alias("blocks")), ["lang", "term"]).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = side(dealt.withColumn("a_block", F.col("block")).withColumn("b_block", every), "a", "source", "p", "none", "term", "a_block", "b_block")
    right = side(dealt.withColumn("b_block", F.col("block")).withColumn("a_block", every), "b", "source", "p", "none", "term", "a_block", "b_block")
    on = [left[c] == right[d] for c, d in (("lang", "lang"), ("a_term", "b_term"), ("a_a_block", "b_a_block"), ("a_b_block", "b_b_block"))]
    shared = left.join(right, [*on, F.col("a_source") < F.col("b_source")]).select(left["lang"], "a_source", "a_p", "a_none", "b_source", "b_p", "b_none")
    more = gap(F.col("a_p"), F.col("b_p")) - gap(F.col("a_p"), F.col("b_none")) - gap(F.col("a_none"), F.col("b_p")) + flat
    shared = shared.groupBy("lang", "a_source", "b_source").agg(F.sum(more).alias("part"))
    again = shared.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), "part")
    extra = alone.unionByName(turned).unionByName(shared).unionByName(again).groupBy("lang", "a_source", "b_source").agg(F.sum("part").alias("extra"))
    found = both.join(extra, ["lang", "a_source", "b_source"], "left")
    value = F.coalesce(flat * F.col("a_kept"), F.lit(0)) + F.coalesce("extra", F.lit(0))
    return found.select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), value.cast("long").alias("value"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id, coalesce(text, '') AS text FROM documents
), o AS MATERIALIZED (
  SELECT lang, source, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS MATERIALIZED (
  SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL
), l AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), t AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, lang_n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS q
  FROM t JOIN l USING (lang)
), w AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.a = a.source AND s.b = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM w QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10
"""
