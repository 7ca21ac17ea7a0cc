"""Substring deduplication by hashing lines, and as an addition parts of lines.

The units are lines, normalised (A-Z in lower case, white space between words as
one space). Their digests are grouped over all documents, and the earliest line
by document and position is kept. The others are duplicates: from ``MIN_CHARS``
characters on, their range of the original text is removed (spans of the kind
``line``).

Passages that stand inside other lines have no line of their own. For these,
lines are also cut into parts where the words say so: before a word whose hash
is the smallest within ``REACH`` words on both sides, whatever line these are
on. The cuts move with the text, so a passage has the same parts wherever it
stands, but for its first and last. Parts are grouped like lines, and where
repeated parts, or parts in removed lines, follow each other and have
``MIN_WORDS`` words or more together, those that no removed line has are removed
as well (spans of the kind ``part``).

Passages of over 50 words that repeat are found wherever they stand: at most
``2 * REACH`` words at either end can fall into units that differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import blank, blocks, distinct, map_arrow
from .columns import fresh

#: A cut needs the smallest hash within so many words to the left and right.
REACH = 4
#: Repeated words in a row that are removed.
MIN_WORDS = 25
#: Characters of a normalised line from which it is a unit, as in ``line_dedup``.
MIN_CHARS = 10
#: Added to the numbers of lines, to tell them from those of parts.
LINE = 1 << 30

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def units(data: np.ndarray, offsets: np.ndarray, reach: int = REACH):
    """Text, first byte, end byte, words and digest of every part of all texts, in order; the same of every line, with the
    characters of its normalised form last."""
    none = np.zeros(0, np.int64)
    nothing = none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    if not len(data):
        return nothing, (*nothing, none)
    space = blank(data)
    mark = ~space
    mark[1:] &= space[:-1]
    full = offsets[1:] > offsets[:-1]
    begins = offsets[:-1][full]
    mark[begins] = ~space[begins]
    starts = np.flatnonzero(mark)
    if not len(starts):
        return nothing, (*nothing, none)
    stop = space.copy()
    stop[1:] &= ~space[:-1]
    stop[begins] = False
    ends = np.flatnonzero(np.append(stop, False) | np.isin(np.arange(len(data) + 1), offsets[1:][full & ~space[offsets[1:] - 1]]))
    held = ~space
    at = np.concatenate([[0], np.cumsum(held)])
    index, words = distinct(_LOWER[data[held]], np.append(at[starts], at[-1]))
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[index]
    text = np.searchsorted(offsets, starts, "right") - 1
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    line_first = np.ones(len(starts), bool)
    line_first[1:] = (newline[starts[1:]] != newline[starts[:-1]]) | (text[1:] != text[:-1])
    # the smallest hash in the window of words around each word; windows end with the text, not with the line
    place = np.arange(len(w)) + reach * (1 + np.cumsum(np.insert(text[1:] != text[:-1], 0, False)))
    spread = np.full(place[-1] + reach + 1, np.iinfo(np.uint64).max, np.uint64)
    spread[place] = w
    anchor = w == np.lib.stride_tricks.sliding_window_view(spread, 2 * reach + 1).min(1)[place - reach]
    chars = np.concatenate([[0], np.cumsum(held & (data & 0xC0 != 0x80))])

    def grouped(first: np.ndarray, salt: int):
        """The units that begin at the words ``first``."""
        last = np.append(first[1:], len(w)) - 1
        with np.errstate(over="ignore"):
            place = np.arange(len(w)) - np.repeat(first, last - first + 1)
            powers = _mixed(place.astype(np.uint64) + _MIX)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(w * _MIX + powers), dtype=np.uint64)])
            other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(w + powers * _MIX), dtype=np.uint64)])
            h1 = _mixed((sums[last + 1] - sums[first]) ^ np.uint64(salt))
            h2 = _mixed(other[last + 1] - other[first])
        return text[first], starts[first], ends[last], last - first + 1, h1, h2

    lines = grouped(np.flatnonzero(line_first), LINE)
    return grouped(np.flatnonzero(line_first | anchor), 0), (*lines, chars[lines[2]] - chars[lines[1]] + lines[3] - 1)


def kept_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH,
               min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, row_key, kept``: the numbers of the units of each text that no earlier unit equals.

    Parts are counted from 0, lines from ``LINE``; lines under ``min_chars`` are left out.

    Earlier is by id, then position; a null id counts as the largest. A text all
    of whose units are repeated has no row. Each digest keeps one unit, so the
    earliest is found by an aggregation that combines before its shuffle: a
    digest that all documents share is one row of each task.
    """
    def work(batches):
        for rows, data, offsets in blocks(batches):
            parts, lines = units(data, offsets, reach)
            long = lines[6] >= min_chars
            nth = [np.arange(len(t)) - np.searchsorted(t, t) for t in (parts[0], lines[0])]
            nth = np.concatenate([nth[0], nth[1][long] + LINE])
            text, h1, h2 = (np.concatenate([parts[k], lines[k][long]]) for k in (0, 4, 5))
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("doc_id")).take(take), rows.column(rows.schema.get_field_index("row_key")).take(take),
                 pa.array(nth, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                ["doc_id", "row_key", "nth", "h1", "h2"],
            )

    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = map_arrow(texts, work, f"doc_id {kind}, row_key long, nth int, h1 long, h2 long")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_key", "nth")
    first = found.groupBy("h1", "h2").agg(F.min(rank).alias("first")).select("first.doc_id", "first.row_key", "first.nth")
    return first.groupBy("doc_id", "row_key").agg(F.collect_list("nth").alias("kept"))


def repeated_runs(fresh: np.ndarray, text: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last unit of the runs of units that are not ``fresh``, within one text and of ``min_words`` words or more."""
    again = np.flatnonzero(~fresh)
    if not len(again):
        return again, again
    begin = np.append(0, np.flatnonzero((np.diff(again) > 1) | (np.diff(text[again]) > 0)) + 1)
    long = np.add.reduceat(words[again], begin) >= min_words
    return again[begin][long], again[np.append(begin[1:], len(again)) - 1][long]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, reach: int = REACH,
                     min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated passages removed and ``removed_spans`` added.

    ``removed_spans`` is ``array<(start, end, kind)>`` in code points of the
    original text, in order; units that follow each other are one span. Null
    texts stay null, and texts of any length are read whole. Of equal units the
    one with the smallest id is kept, then the first in its text; a null id
    counts as the largest. Rows that repeat an id with another text are told
    apart by their text; rows that repeat id and text are one document and stay
    or go alike. A column named ``removed_spans`` is replaced; all others are
    kept, whatever their names. An empty table gives an empty result.

    The units are cut again where the spans are made: their places need not
    travel with their digests.
    """
    docs = docs.drop("removed_spans")
    names, kinds = docs.columns, dict(docs.dtypes)
    own, at, key, kept = fresh(docs, "row_key", "unit_id", "unit_key", "units_kept")
    units_of = kept_units(docs, id_col, text_col, reach, min_chars).toDF(at, key, kept)
    held = docs.withColumn(own, F.xxhash64(F.coalesce(text_col, F.lit("")))).join(
        units_of, F.col(id_col).eqNullSafe(F.col(at)) & (F.col(own) == F.col(key)), "left"
    ).drop(at, own, key)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def work(batches):
        for rows, data, offsets in blocks(batches, text_col):
            (text, a, b, n, _, _), (of, line_a, _, _, _, _, length) = units(data, offsets, reach)
            numbers = rows.column(rows.schema.get_field_index(kept))
            counts = pc.fill_null(pc.list_value_length(numbers), 0).to_numpy(zero_copy_only=False)
            number, row = numbers.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(rows.num_rows), counts)
            is_line = number >= LINE
            fresh, fresh_line = np.zeros(len(text), bool), length < min_chars
            fresh[number[~is_line] + np.searchsorted(text, row[~is_line])] = True
            fresh_line[number[is_line] - LINE + np.searchsorted(of, row[is_line])] = True
            in_line = ~fresh_line[np.searchsorted(line_a, a, "right") - 1] if len(a) else fresh
            stays = ~in_line
            for i, j in zip(*repeated_runs(fresh & stays, text, n, min_words), strict=True):
                stays[i : j + 1] = False
            kind = np.where(in_line, 1, np.where(stays, 0, 2))
            runs = sorted((i, j, name) for k, name in ((1, "line"), (2, "part")) for i, j in zip(*repeated_runs(kind != k, text, n, 0), strict=True))
            column = rows.column(rows.schema.get_field_index(text_col))
            texts = column.to_pylist()
            removed: list[list] = [[] for _ in texts]
            parts: dict[int, list] = {}
            for first, last, name in runs:
                i, start, end = int(text[first]), int(a[first]), int(b[last])
                own = parts.setdefault(i, [int(offsets[i]), 0])  # the byte and the code point reached, then what stays
                before, gone = data[own[0] : start].tobytes().decode(), data[start:end].tobytes().decode()
                own.append(before)
                removed[i].append({"start": own[1] + len(before), "end": own[1] + len(before) + len(gone), "kind": name})
                own[:2] = end, own[1] + len(before) + len(gone)
            for i, (end, _, *stay) in parts.items():
                texts[i] = "".join([*stay, data[end : offsets[i + 1]].tobytes().decode()])
            columns = [pa.array(texts, pa.string()) if c == text_col else rows.column(rows.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, span)], [*names, "removed_spans"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", removed_spans array<struct<start:long,end:long,kind:string>>"
    return map_arrow(held, work, schema)


#: The spans of kind ``line`` alone, as ``dedup_substrings`` gives them where no run of parts is long enough.
LINES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base,
        ltrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS cut, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS own FROM l),
u AS (SELECT doc_id, pos, base + length(line) - length(cut) AS a, base + length(line) - length(cut) + length(own) AS b,
        regexp_replace(translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09\x0B\x0C\x0D]+', ' ', 'g') AS key FROM o WHERE own <> ''),
g AS (SELECT *, length(key) >= 10 AND row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1 AS gone FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, gone ORDER BY pos) AS run FROM g),
s AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM r WHERE gone GROUP BY doc_id, run),
k AS (SELECT s.doc_id, s.a, s.b, substring(text, coalesce(lag(b) OVER w, 0) + 1, s.a - coalesce(lag(b) OVER w, 0)) AS before FROM s JOIN d USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.a))
SELECT d.doc_id, count(k.a) AS n_removed, coalesce(sum(k.b - k.a), 0)::BIGINT AS removed_chars, coalesce(string_agg(k.a || ':' || k.b, ',' ORDER BY k.a), '') AS spans,
       sha256(coalesce(string_agg(k.before, '' ORDER BY k.a), '') || substring(any_value(d.text), coalesce(max(k.b), 0) + 1)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""
