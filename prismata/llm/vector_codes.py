"""Vectors compressed to a code for each part, by Lloyd's rounds with Elkan's bounds.

Components become integers, vectors are cut into equal parts, and each part
position has a codebook of its own. In each round every part goes to its nearest
entry, and entries move to the means of their parts. All distances that decide
anything are exact integers.

Between rounds each row keeps, for every part, an upper bound of the distance to
its entry and one lower bound for each entry. When entries move, bounds are
shifted by how far they moved. An entry is left out where its lower bound, or
half its distance from the part's own entry, is strictly above the upper bound;
it is strictly farther then, so that ties are never decided by a bound. What is
left is computed in integers, and of equal distances the lower entry wins.

Bounds are kept in 16 bits, rounded to their safe side. One task handles a batch
of rows at a time, and a round's result is a table in the shared folder: rows,
and one further row for each task with its sums by entry. These are added up by
an aggregation, of which as many numbers reach the driver as the codebooks have.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrowtext import map_arrow
from .columns import looked_up
from .storage import discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond this, once scaled, have squares that 64 bits could not add up.
LARGEST = 1 << 26
#: Relative room left on the safe side of every computed bound.
ROOM = 1e-14


def _up(x):
    return x * (1 + ROOM)


def _down(x):
    return x * (1 - ROOM)


def packed_up(x: np.ndarray) -> np.ndarray:
    """The upper 16 bits of numbers of 32 bits that are no smaller than ``x``."""
    f = x.astype(np.float32)
    f = np.where(f < x, np.nextafter(f, np.float32(np.inf)), f)
    return ((f.view(np.uint32).astype(np.uint64) + 0xFFFF) >> 16).astype(np.int16)


def packed_down(x: np.ndarray) -> np.ndarray:
    """The upper 16 bits of numbers of 32 bits that are no larger than ``x``."""
    f = x.astype(np.float32)
    f = np.where(f > x, np.nextafter(f, np.float32(0)), f)
    return (f.view(np.uint32) >> 16).astype(np.int16)


def unpacked(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint32) << 16).view(np.float32).astype(np.float64)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(-1)


def assign(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry, upper bound and lower bounds of each part of ``x``, from all distances."""
    d = np.stack([squares(x, e) for e in entries], 1)
    code = d.argmin(1)
    root = np.sqrt(d.astype(np.float64))
    return code, _up(root[np.arange(len(x)), code]), _down(root)


def reassign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries moved from ``old``, and the number of distances that were computed."""
    moved = _up(np.sqrt(squares(old, entries).astype(np.float64)))
    upper = _up(upper + moved[code])
    lower = np.maximum(_down(lower - moved), 0)
    apart = _down(np.sqrt(squares(entries[:, None], entries[None]).astype(np.float64)) / 2)
    some = np.flatnonzero(_open(code, upper, lower, apart).any(1))
    n = len(some)
    if not n:
        return code, upper, lower, 0
    code, at = code.copy(), np.arange(n)
    own, xs = code[some], x[some]
    d = np.full((n, len(entries)), np.iinfo(np.int64).max)
    d[at, own] = squares(xs, entries[own])
    tight = np.sqrt(d[at, own].astype(np.float64))
    upper[some], lower[some, own] = _up(tight), _down(tight)
    r, j = np.nonzero(_open(own, upper[some], lower[some], apart))
    d[r, j] = squares(xs[r], entries[j])
    lower[some[r], j] = _down(np.sqrt(d[r, j].astype(np.float64)))
    code[some] = d.argmin(1)
    upper[some] = _up(np.sqrt(d.min(1).astype(np.float64)))
    return code, upper, lower, n + len(r)


def _open(code: np.ndarray, upper: np.ndarray, lower: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which entries, but a part's own, no bound rules out."""
    left = (lower <= upper[:, None]) & (apart[code] <= upper[:, None])
    left[np.arange(len(code)), code] = False
    return left


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, k = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(x).ravel(), kind))


def _finite(column: pa.Array) -> np.ndarray:
    """Which rows have a vector without null or non-finite components."""
    column = column.cast(pa.list_(pa.float64()))
    bad = ~np.isfinite(column.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False))
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    below = np.concatenate([[0], np.cumsum(bad)])
    return (below[ends] == below[ends - sizes]) & column.is_valid().to_numpy(zero_copy_only=False)


def _integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors without bad components: which have ``dim`` numbers within ``LARGEST``, and these as integers."""
    fits = pc.list_value_length(column).to_numpy(zero_copy_only=False) == dim
    x = np.floor(column.filter(pa.array(fits)).cast(pa.list_(pa.float64())).flatten().to_numpy(zero_copy_only=False) * scale).reshape(int(fits.sum()), dim)
    small = (np.abs(x) <= LARGEST).all(1)
    fits[np.flatnonzero(fits)[~small]] = False
    return fits, x[small].astype(np.int64)


def _starts(rows: DataFrame, entries: int, scale: int) -> np.ndarray | None:
    """The vectors of the smallest ids as integers; those of the length that the smallest id's has.

    Each task gives its own smallest ones of each length.
    """
    def work(batches):
        held: dict[int, list] = {}
        for rows in batches:
            ids, column = rows.column(0), rows.column(1)
            finite = np.flatnonzero(_finite(column))
            late = ids.is_null().to_numpy(zero_copy_only=False)[finite]
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)[finite]
            sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)[finite]
            order = np.lexsort((number, late))
            for size in np.unique(sizes).tolist():
                own = held.setdefault(size, [])
                for k in order[sizes[order] == size].tolist():
                    key = (bool(late[k]), int(number[k]))
                    if len(own) >= entries and key > own[-1][0]:
                        break
                    v = [float(np.floor(y * scale)) for y in column[int(finite[k])].as_py()]
                    if max(map(abs, v), default=0) <= LARGEST:
                        own.append((key, v))
                        own.sort()
                        del own[entries:]
        found = [t for own in held.values() for t in own]
        yield pa.RecordBatch.from_arrays([pa.array([None if late else k for (late, k), _ in found], pa.int64()), pa.array([v for _, v in found], pa.list_(pa.float64()))], ["k", "v"])

    first = materialize(map_arrow(rows.select("vec_id", "vector"), work, "k long, v array<double>"), "vector-starts")
    order = [F.col("k").asc_nulls_last(), F.col("v")]
    one = first.orderBy(*order).limit(1).collect()
    if not one:
        return None
    top = first.where(F.size("v") == len(one[0]["v"])).orderBy(*order).limit(entries).collect()
    discard(first)
    return np.array([r["v"] for r in top]).reshape(len(top), len(one[0]["v"])).astype(np.int64)


_STATE = "vec_id long, label {label}, vector array<int>, code array<tinyint>, upper array<smallint>, lower array<smallint>, sums array<bigint>"


def _state(rows: pa.RecordBatch, names: list[str], good: np.ndarray, x=None, code=None, upper=None, lower=None) -> pa.RecordBatch:
    """Rows of a round's table; those that have no code carry nulls."""
    place = np.full(len(good), -1)
    place[good] = np.arange(int(good.sum()))
    take = pa.array(place, mask=~good)
    columns = [_lists(x, pa.int32()), _lists(code, pa.int8()), _lists(upper, pa.int16()), _lists(lower, pa.int16())]
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *[c.take(take) for c in columns], pa.nulls(len(good), pa.list_(pa.int64()))], names)


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    held = column.drop_null()
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), width)


def _round(table: DataFrame, book: np.ndarray, old: np.ndarray | None, dim: int, scale: int, label: str) -> DataFrame:
    """One round's assignment: the rows with their bounds, and a row of sums for each task."""
    parts, k, width = book.shape
    names = ["vec_id", "label", "vector", "code", "upper", "lower", "sums"]
    kinds = [pa.int64(), to_arrow_type(table.schema["label"].dataType), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.int16()), pa.list_(pa.int16())]

    def work(batches):
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for rows in batches:
            if old is None:
                rows = rows.filter(pa.array(_finite(rows.column(2))))
                good, x = _integers(rows.column(2), dim, scale)
            else:
                good, x = rows.column(2).is_valid().to_numpy(zero_copy_only=False), _numbers(rows.column(2), dim).astype(np.int64)
            n = len(x)
            cut = x.reshape(n, parts, width)
            code, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts, k))
            if old is not None:
                was = _numbers(rows.column(3), parts).astype(np.int64)
                up, low = unpacked(_numbers(rows.column(4), parts)), unpacked(_numbers(rows.column(5), parts * k)).reshape(n, parts, k)
            for p in range(parts):
                xs = np.ascontiguousarray(cut[:, p])
                if old is None:
                    code[:, p], upper[:, p], lower[:, p] = assign(xs, book[p])
                else:
                    code[:, p], upper[:, p], lower[:, p], _ = reassign(xs, was[:, p], up[:, p], low[:, p], old[p], book[p])
                counts[p] += np.bincount(code[:, p], minlength=k)
                np.add.at(sums[p], code[:, p], xs)
            yield _state(rows, names, good, x, code, packed_up(upper), packed_down(lower.reshape(n, parts * k)))
        total = np.concatenate([counts[:, :, None], sums], 2).ravel()
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in kinds], pa.array([total], pa.list_(pa.int64()))], names)

    return map_arrow(table, work, _STATE.format(label=label))


def _moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The entries at the means of their parts, rounded down; those without parts stay."""
    places = state.where("sums is not null").select(F.posexplode("sums").alias("at", "n"))
    rows = places.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).where("n <> 0").collect()
    parts, k, width = book.shape
    total = np.zeros(parts * k * (width + 1), object)
    for r in rows:
        total[r["at"]] = int(r["n"])
    total = total.reshape(parts, k, width + 1)
    new = book.copy()
    for p, e in np.argwhere(total[:, :, 0] > 0):
        new[p, e] = [s // total[p, e, 0] for s in total[p, e, 1:]]
    return new


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error, label_error)`` of the rows with a vector, and the codebooks.

    ``code`` is an array with the entry of each part, ``error`` the squared
    distances from these, and ``label_error`` the errors of all rows with the
    same label, nulls together. Codebooks start at the vectors of the smallest
    ids, as many as there are up to ``entries``; a null id comes last, and of
    equal ids the smaller vector is first. Repeated rows each have a result.

    Rows whose vector is null or holds null or non-finite components are left
    out. Vectors of another length than that of the smallest id, and those with
    a component that is beyond ``LARGEST`` once scaled, take no part: their code
    and error are null. A length that doesn't divide into ``parts`` is an error.
    Other columns are not read, whatever their names. An empty table gives an
    empty result, and codebooks without entries.
    """
    spark = rows.sparkSession
    table = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    label = dict(table.dtypes)["label"]
    first = _starts(table, entries, scale)
    if first is None:
        return spark.createDataFrame([], f"vec_id long, label {label}, code array<int>, error long, label_error long"), np.zeros((parts, 0, 0), np.int64)
    dim = first.shape[1]
    if dim % parts:
        raise ValueError(f"vectors of {dim} numbers don't divide into {parts} parts")
    book, old, state = np.ascontiguousarray(first.reshape(len(first), parts, dim // parts).transpose(1, 0, 2)), None, None
    for _ in range(rounds):
        source = table if state is None else state.where("sums is null")
        held = materialize(_round(source, book, old, dim, scale, label), "vector-round")
        if state is not None:
            discard(state)
        state, old, book = held, book, _moved(held, book)
    final = _round(table if state is None else state.where("sums is null"), book, old, dim, scale, label).where("sums is null")
    coded = materialize(_errors(final.select("vec_id", "label", "vector", "code"), book, label), "vector-codes")
    if state is not None:
        discard(state)
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("copies"))
    sums = materialize(sums, "vector-labels")
    found = looked_up(coded.withColumn("_spread", F.xxhash64("vec_id", "code")), sums, ["label"], ["label_error"], "copies", coded.count(), "_spread")
    return found.select("vec_id", "label", "code", "error", F.col("found.label_error").alias("label_error")), book


def _errors(rows: DataFrame, book: np.ndarray, label: str) -> DataFrame:
    """``vec_id, label, code, error`` by exact distances."""
    parts, k, width = book.shape

    def work(batches):
        for rows in batches:
            good = rows.column(2).is_valid().to_numpy(zero_copy_only=False)
            x = _numbers(rows.column(2), parts * width).astype(np.int64).reshape(-1, parts, width) if good.any() else np.zeros((0, parts, width), np.int64)
            code = _numbers(rows.column(3), parts).astype(np.int64)
            error = np.zeros(len(x), np.int64)
            for p in range(parts):
                error += squares(x[:, p], book[p][code[:, p]])
            place = np.full(len(good), -1)
            place[good] = np.arange(len(x))
            take = pa.array(place, mask=~good)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), _lists(code, pa.int32()).take(take), pa.array(error).take(take)], ["vec_id", "label", "code", "error"])

    return map_arrow(rows, work, f"vec_id long, label {label}, code array<int>, error long")


def digest(book: np.ndarray) -> str:
    """Of all entries' numbers by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    near = lambda c: f"""SELECT vec_id, part, min({{'d': list_sum(list_transform(list_zip(x, e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 'k': k}}) AS m
 FROM v JOIN {c} USING (part) GROUP BY vec_id, part"""  # noqa: E731
    steps = [f"""WITH w AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"v AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS x FROM w, (SELECT unnest(range({parts})) AS part))",
             f"c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x AS e FROM v QUALIFY k < {entries})"]
    for r in range(rounds):
        steps += [f"a{r} AS MATERIALIZED ({near(f'c{r}')})",
                  f"s{r} AS (SELECT part, m.k AS k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id, part), (SELECT unnest(range(1, (SELECT max(len(x)) FROM v) + 1)) AS i) GROUP BY ALL)",
                  f"u{r} AS (SELECT part, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{r} GROUP BY ALL)",
                  f"c{r + 1} AS MATERIALIZED (SELECT part, k, coalesce(u{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN u{r} USING (part, k))"]
    return ",\n".join([*steps, f"z AS MATERIALIZED ({near(f'c{rounds}')})",
                       "o AS (SELECT vec_id, string_agg(printf('%02x', m.k), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM z GROUP BY vec_id)",
                       "f AS (SELECT part, k, i, e[i] AS y FROM (SELECT part, k, e, unnest(range(1, len(e) + 1)) AS i FROM c%d))" % rounds]) + """
SELECT o.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, k, i)) FROM f) AS codebooks_sha256
FROM o JOIN w USING (vec_id)"""


SQL = _sql()
