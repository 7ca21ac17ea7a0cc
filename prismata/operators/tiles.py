"""Products of two tables in tiles: nearest codes in a codebook of any size, attention over sequences of any length.

Of a codebook, tiles are kept once and go past blocks of rows that tasks hold, so
that a row has its result when the last tile is by. Of attention, both sides are
cut into tiles of bounded size, and rows of a pair of tiles meet in one task,
sorted so that one tile comes first. A task holds that tile as a matrix and the
other side as it streams, and gives one partial result a row; these are merged by
key. Neither a table nor a tile goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from ..shipping import ship
from .dealt import fresh, stored
from .shard import numbered

#: Codes of a tile, tokens of a block, and rows of one matrix product.
CODES, TOKENS, ROWS = 4096, 256, 1024
#: Components, of 8 bytes each: of a tile or a block of rows at most, twice those a task has; and the fewest for which a task is begun.
BLOCK, LEAST = 1 << 20, 1 << 14


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _runs(batches: Iterator[pa.RecordBatch], cell: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of one cell and one kind each, with whether a new cell begins there."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (*cell, "kind")]
        ends = np.flatnonzero(np.logical_or.reduce([p[1:] != p[:-1] for p in parts])) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
            here = tuple(p[a] for p in parts[:-1])
            yield here != last, batch.slice(a, b - a)
            last = here


def _met(first: DataFrame, second: DataFrame, cell: list[str], work) -> DataFrame:
    """Rows of both tables by cell, those of ``first`` before those of ``second``, through ``work``; its schema comes with it."""
    ship(first.sparkSession)
    both = first.withColumn("kind", F.lit(0)).unionByName(second.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    function, schema = work
    return both.repartition(*cell).sortWithinPartitions(*cell, "kind").mapInArrow(function, schema)


def _blocks(rows: DataFrame, name: str, vec: str, most: int, numbers: int) -> DataFrame:
    """``rows`` of each partition in their order, packed: ``block`` counts a partition's blocks from 0, ``names`` and ``matrix`` hold what is in one.

    A block has at most ``most`` rows and some ``numbers`` components.
    """
    ship(rows.sparkSession)
    given = rows.select(F.col(name).alias("name"), F.col(vec).alias("vec"))

    def packed(number, slices):
        table = pa.Table.from_batches(slices).combine_chunks()
        names, vectors = (table.column(c).combine_chunks() for c in ("name", "vec"))
        if pc.min(pc.list_value_length(vectors)) != pc.max(pc.list_value_length(vectors)):
            raise ValueError("vectors of several lengths")
        lists = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), lists, pa.array([_matrix(vectors).tobytes()], pa.binary())], ["block", "names", "matrix"])

    def work(batches):
        number, slices, n, room = 0, [], 0, None
        for batch in batches:
            if room is None and batch.num_rows:
                room = max(1, min(most, numbers // max(1, len(batch.column(1)[0]))))
            while batch.num_rows:
                some = batch.slice(0, room - n)
                batch = batch.slice(some.num_rows)
                slices.append(some)
                n += some.num_rows
                if n == room:
                    yield packed(number, slices)
                    number, slices, n = number + 1, [], 0
        if n:
            yield packed(number, slices)

    kind = given.schema["name"]
    schema = StructType([StructField("block", IntegerType()), StructField("names", ArrayType(kind.dataType, kind.nullable)), StructField("matrix", BinaryType())])
    return given.mapInArrow(work, schema)


class _Nearest:
    """The nearest codes so far of one block of rows."""

    def __init__(self, names: pa.Array, x: np.ndarray, kind: pa.DataType):
        self.names, self.x, n = names, x, len(x)
        with np.errstate(all="ignore"):
            self.short, self.length = x.astype(np.float32), np.sqrt((x * x).sum(1))
        self.dist, self.rank, self.codes = np.full(n, np.nan), np.full(n, np.inf), pa.nulls(n, kind)

    def meet(self, codes: pa.Array, y: np.ndarray, short: np.ndarray, length: float) -> None:
        """Products in 32 bits tell which rows may have a code of this tile that is as near as theirs; distances that decide have 64."""
        with np.errstate(all="ignore"):
            product = self.length * length
            room = np.where(product < 1e30, product * (y.shape[1] + 16) * 2.0**-23, np.inf)  # twice what rounding adds up to; beyond, 32 bits may overflow
            least = 1 - self.rank / 2 - room - 1e-9  # distances have 9 digits
            for k in range(0, len(self.x), ROWS):
                top = (self.short[k : k + ROWS] @ short.T).max(1)
                own = k + np.flatnonzero(~(top < least[k : k + ROWS]))
                if not len(own):
                    continue
                d = np.round(2 - 2 * self.x[own] @ y.T, 9) + 0.0
                rank = np.where(np.isnan(d), np.inf, d)  # no number is farther than any
                best = rank.argmin(1)
                d, rank = (v[np.arange(len(own)), best] for v in (d, rank))
                better = rank < self.rank[own]
                tied = np.flatnonzero(rank == self.rank[own])
                if len(tied):
                    lower = pc.less(codes.take(pa.array(best[tied])), self.codes.take(pa.array(own[tied])))
                    better[tied] = lower.fill_null(True).to_numpy(zero_copy_only=False)  # null: no code so far
                own, best = own[better], best[better]
                self.dist[own], self.rank[own] = d[better], rank[better]
                at = np.arange(len(self.x))
                at[own] = len(at) + np.arange(len(own))
                self.codes = pa.concat_arrays([self.codes, codes.take(pa.array(best))]).take(pa.array(at))


def nearest_code(rows: DataFrame, codebook: DataFrame, key: list[str], vec: str | Column = "v", tile: int = CODES) -> DataFrame:
    """``key, code, dist`` of each row: the nearest code by squared distance of unit vectors, of equal ones the lower.

    The codebook ``(code, vec)`` may have any size; codes are numbers, strings or
    times. ``key`` tells rows apart; rows with the same key have one result, of
    the nearest of them. Nothing is copied for a tile of the codebook: it is kept
    once, in the checkpoint folder, and each task holds a block of rows and reads
    it tile by tile, so what is exchanged and kept grows with both tables, not
    with their product. ``vec`` is computed after rows are exchanged. A null
    vector has no result and is no code, and no codebook gives none at all.
    """
    spark = rows.sparkSession
    (held,) = fresh(rows, "held")
    vector = F.col(vec) if isinstance(vec, str) else vec
    numbers = rows.where(vector.isNotNull()).agg(F.sum(F.size(vector))).first()[0] or 0
    parts = max(numbers * 2 // BLOCK, min(spark.sparkContext.defaultParallelism, numbers // LEAST)) + 1
    named = rows.repartition(parts, *key).where(vector.isNotNull()).select(F.struct(*key).alias(held), vector.alias("vec"))
    book = codebook.where(F.col("vec").isNotNull()).select("code", "vec").sortWithinPartitions("code")
    kept = stored(_blocks(book, "code", "vec", tile, BLOCK)).toDF("tile", "codes", "book")
    own = _blocks(named, held, "vec", BLOCK, BLOCK)
    # each task has one partition of rows in memory, and all tiles go past it: a block with its rows at the first tile of a partition, else its number only
    kinds = F.explode(F.array(F.lit(True), F.lit(False))).alias("whole")
    own = own.select("block", kinds, "names", "matrix").select("block", "whole", *[F.when(F.col("whole"), F.col(c)).alias(c) for c in ("names", "matrix")])
    met = kept.coalesce(1).join(own.hint("shuffle_replicate_nl"), F.when(F.col("whole"), F.col("tile") == 0).otherwise(F.col("tile") > 0))
    first = F.col("block") == 0  # a tile is sent with the first block only
    pairs = met.select("block", F.when(first, F.col("codes")).alias("codes"), F.when(first, F.col("book")).alias("book"), "names", "matrix")

    def matrix(column, k, n):
        return np.frombuffer(column[k].as_buffer(), np.float64).reshape(n, -1)

    def work(batches):
        found, tile = {}, None
        for batch in batches:
            block, codes, book, names, x = batch.columns
            for k in range(batch.num_rows):
                if codes[k].is_valid:
                    values = codes[k].values
                    y = matrix(book, k, len(values))
                    with np.errstate(all="ignore"):
                        tile = (values, y, y.astype(np.float32), np.sqrt((y * y).sum(1)).max())
                number = block[k].as_py()
                if number not in found:
                    own = names[k].values
                    found[number] = _Nearest(own.take(pa.array(np.arange(len(own)))), matrix(x, k, len(own)).copy(), tile[0].type)  # copies, for batches to be freed
                found[number].meet(*tile)
        for one in found.values():
            yield pa.RecordBatch.from_arrays([one.names, one.codes, pa.array(one.dist)], [held, "code", "dist"])

    schema = StructType([named.schema[held], book.schema["code"], StructField("dist", DoubleType())])
    best = pairs.mapInArrow(work, schema).groupBy(held).agg(F.min(F.struct("dist", "code")).alias("near"))
    return best.select(f"{held}.*", F.col("near.code").alias("code"), F.col("near.dist").alias("dist"))


def attention(tokens: DataFrame, sequence: str, position: str, query: str = "q", keyed: str = "k", value: str = "v", scale: float = 1.0, block: int = TOKENS) -> DataFrame:
    """``sequence, position, y``: of each token the values of its sequence, weighted by the softmax of ``scale`` times query times key.

    A sequence is cut into blocks by position, and each pair of blocks gives for
    its queries the greatest score, the sum of weights about it and the weighted
    sum of values; these are merged one after another, each brought to the
    greater of the two scores. A sequence that holds a third of all tokens is
    spread over the square of its blocks. Positions tell the tokens of a
    sequence apart; a token without query, key or value is left out.
    """
    held = tokens.where(F.col(query).isNotNull() & F.col(keyed).isNotNull() & F.col(value).isNotNull())
    held = held.select(F.col(sequence).alias("sequence"), F.col(position).alias("position"), F.col(query).alias("q"), F.col(keyed).alias("k"), F.col(value).alias("v"))
    places = numbered(held, ["sequence", "position"], "place")
    ends = places.groupBy("sequence").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n"))
    dealt = places.join(ends, "sequence").select("sequence", "position", "q", "k", "v", F.expr(f"(place - low) div {block}").cast("int").alias("own"), F.expr(f"cast((n - 1) div {block} as int)").alias("last"))
    every = F.explode(F.sequence(F.lit(0), F.col("last")))
    keys = dealt.select("sequence", F.col("own").alias("kb"), F.struct("k", "v").alias("pair"), every.alias("qb"))
    queries = dealt.select("sequence", F.col("own").alias("qb"), "position", "q", every.alias("kb"))
    cell = ["sequence_hash", "qb", "kb"]
    both = [df.withColumn("sequence_hash", F.xxhash64("sequence")) for df in (keys, queries)]

    def partial(batches):
        parts: dict = {}
        for new, rows in _runs(batches, cell):
            at = rows.schema.get_field_index
            names = rows.column(at("sequence")).to_pylist()
            if new:
                parts = {}
            if rows.column(at("kind"))[0].as_py() == 0:
                pair = rows.column(at("pair"))
                k, v = _matrix(pair.field(0)), _matrix(pair.field(1))
                for name in dict.fromkeys(names):  # more than one only where hashes of sequences meet
                    own = np.array([n == name for n in names])
                    parts.setdefault(name, []).append((k[own], v[own]))
                continue
            q = _matrix(rows.column(at("q")))
            for name in dict.fromkeys(names):
                own = np.flatnonzero([n == name for n in names])
                k, v = (np.concatenate(p) for p in zip(*parts[name], strict=True))
                for i in range(0, len(own), ROWS):
                    some = own[i : i + ROWS]
                    scores = scale * (q[some] @ k.T)
                    top = scores.max(1)
                    w = np.exp(scores - top[:, None])
                    taken = rows.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [taken.column(at("sequence")), taken.column(at("position")), pa.array(top), pa.array(w.sum(1)), pa.array(list(w @ v), pa.list_(pa.float64()))], ["sequence", "position", "top", "total", "y"])

    kind = dealt.schema
    numbers = StructField("y", ArrayType(DoubleType()))
    schema = StructType([kind["sequence"], kind["position"], StructField("top", DoubleType()), StructField("total", DoubleType()), numbers])
    found = _met(both[0], both[1], cell, (partial, schema))

    def merged(batches):
        last, state = None, None
        done: list = []

        def given():
            names, at, y = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names, types[0]), pa.array(at, types[1]), pa.array(y, pa.list_(pa.float64()))], ["sequence", "position", "y"])

        types = None
        for batch in batches:
            types = types or [batch.schema.field(0).type, batch.schema.field(1).type]
            for name, at, top, total, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                y = np.array(y)
                if (name, at) == last:
                    high = max(state[0], top)
                    a, b = np.exp(state[0] - high), np.exp(top - high)
                    state = (high, state[1] * a + total * b, state[2] * a + y * b)
                    continue
                if last is not None:
                    done.append((*last, (state[2] / state[1]).tolist()))
                    if len(done) >= ROWS:
                        yield given()
                        done = []
                last, state = (name, at), (top, total, y)
        if last is not None:
            done.append((*last, (state[2] / state[1]).tolist()))
            yield given()

    out = StructType([kind["sequence"], kind["position"], numbers])
    return found.repartition("sequence", "position").sortWithinPartitions("sequence", "position", "top", "total").mapInArrow(merged, out)
