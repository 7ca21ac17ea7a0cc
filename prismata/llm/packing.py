"""Best-fit packing of tokenised documents into sequences, by bin completion.

Piece lengths are whole numbers up to the sequence length, so a table of any
size has at most that many different lengths. The search works on the counts
of the lengths, which is of fixed size, and gives *patterns*: fillings of a
sequence with the number of times each is used. Pieces then find their place by
their rank among the pieces of their length. Only the counts reach the driver,
and only the patterns go back, as a table that the pieces are joined with.

The search is a branch and bound. The first incumbent is best-fit decreasing;
others are best fits about bins of two to six pieces that were evened out before.
If these use more sequences than the lower bound, the search takes the longest
piece left, enumerates the undominated fillings of the room beside it, and goes
on with each in turn; a branch ends when the waste so far shows that it cannot
beat the incumbent.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrowtext import blocks, map_arrow
from .storage import materialize
from .word_bpe import Encoder

CAPACITY = 4096
#: Steps of the enumeration for one longest piece, and of the whole search. A
#: search that reaches neither is complete; one that does keeps its incumbent,
#: and ``Packing.bound`` tells how far that can be from the least number.
FILL_NODES = 500
SEARCH_NODES = 300_000
#: Pieces that are evened out at once, the rounds of that, and the most pieces of a bin it is tried for.
BALANCED, EVEN_ROUNDS, MOST_EVEN = 20_000, 40, 6
#: Ranks of one length that are joined with the patterns in one group.
RANK_BLOCK = 1 << 10

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, times), ...), repeats


class Packing(NamedTuple):
    """Patterns, their number of sequences, a number below which none can be, and whether the search ended by itself."""

    patterns: list[Pattern]
    sequences: int
    bound: int
    complete: bool


def best_fit_decreasing(counts: dict[int, int], capacity: int, begun: list[Pattern] | None = None) -> list[Pattern]:
    """Longest first, each into the fullest bin that takes it, bins ``begun`` included; equal bins are handled together."""
    bins: dict[int, Counter] = {}  # room left -> contents -> number of bins

    def put(room: int, contents: tuple, n: int) -> None:
        bins.setdefault(room, Counter())[contents] += n

    for contents, n in begun or []:
        put(capacity - sum(k * t for k, t in contents), contents, n)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                times = min(left, capacity // length)
                n = left // times
                put(capacity - times * length, ((length, times),), n)
                left -= n * times
                continue
            contents, n = next(iter(bins[room].items()))
            times = min(left, room // length)
            used = min(n, left // times)
            bins[room][contents] -= used
            if not bins[room][contents]:
                del bins[room][contents]
                if not bins[room]:
                    del bins[room]
            put(room - times * length, (*contents, (length, times)), used)
            left -= used * times
    return [(contents, n) for held in bins.values() for contents, n in held.items()]


def even(x: np.ndarray, k: int, capacity: int) -> np.ndarray:
    """As many bins of ``k`` pieces as ``x`` has pieces for, a row each, with sums as equal as can be.

    One piece of every bin at a time, the longest go to the bins whose others are
    shortest, until no sum is beyond the capacity or nothing changes.
    """
    t = len(x) // k
    table = np.stack([x[j * t : (j + 1) * t][:: -1 if j % 2 else 1] for j in range(k)], 1)
    for _ in range(EVEN_ROUNDS):
        before = table.sum(1)
        if before.max(initial=0) <= capacity:
            break
        for j in range(k):
            rest = table.sum(1) - table[:, j]
            table[np.argsort(-rest, kind="stable"), j] = np.sort(table[:, j])
        if (table.sum(1) == before).all():
            break
    return table


def balanced(counts: dict[int, int], capacity: int, most: int) -> list[Pattern]:
    """Bins of ``most`` pieces first, of the shortest, as many as even sums allow, then of one piece less; what is short fills their rooms.

    Pieces of which ``most + 1`` fit in a bin are short, and go to the rooms by
    best fit. Best fit alone puts long pieces together, and leaves no room for
    as many bins of three or four as there can be. Of very many pieces, the
    counts are divided first, so that patterns stay few; the rest goes the same
    way.
    """
    large = {k: n for k, n in counts.items() if n and k * (most + 1) > capacity}
    made: Counter = Counter()
    left = large
    while left:
        share = -(-sum(left.values()) // BALANCED)
        x = np.repeat(np.array(sorted(left)), [left[k] // share for k in sorted(left)])
        for k in range(most, 0, -1):
            below = np.concatenate([[0], np.cumsum(x)])
            low, high, table = 0, len(x) // k, None
            while low < high:  # the most bins whose sums fit
                t = (low + high + 1) // 2
                found = even(x[: k * t], k, capacity) if below[k * t] <= t * capacity else None
                if found is not None and found.sum(1).max() <= capacity:
                    low, table = t, found
                else:
                    high = t - 1
            if table is not None:
                for row in table.tolist():
                    made[tuple(sorted(Counter(row).items(), reverse=True))] += share
                x = x[k * low :]
        left = {k: n % share for k, n in left.items() if n % share}
    return best_fit_decreasing({k: n for k, n in counts.items() if n and k not in large}, capacity, list(made.items()))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: by the total, by pieces of which k fit at most, and by pieces over half a bin.

    The last is the bound of Martello and Toth: beside pieces over ``capacity - a``
    nothing of length ``a`` fits, so the pieces from ``a`` to half a bin go
    beside the other large ones or into new bins.
    """
    n = np.zeros(capacity + 1, np.int64)
    for length, times in counts.items():
        n[length] = times
    size = n * np.arange(capacity + 1)
    below, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(size)])  # of lengths under i
    bound = int(-(-total[-1] // capacity))
    for k in range(1, capacity + 1):
        bound = max(bound, int(-(-(below[-1] - below[capacity // (k + 1) + 1]) // k)))
    half = capacity // 2 + 1
    a = np.arange(1, half)
    large = below[-1] - below[capacity - a + 1]
    middle = below[capacity - a + 1] - below[half]
    room = middle * capacity - (total[capacity - a + 1] - total[half])
    over = np.maximum(0, -(-(total[half] - total[a] - room) // capacity))
    return max(bound, int((large + middle + over).max(initial=0)))


def dominated(filling: dict[int, int], waste: int, counts: dict[int, int], ascending: list[int]) -> bool:
    """Whether a length left over could stand for one piece or two of the filling, or beside them, and fill it better.

    ``ascending`` are the lengths of ``counts``. The pieces put out fit wherever
    that length would have gone, so some best packing has the other filling.
    """
    def left_over(low: int, high: int) -> bool:
        at = bisect_left(ascending, low)
        while at < len(ascending) and ascending[at] <= high:
            if counts[ascending[at]] > filling.get(ascending[at], 0):
                return True
            at += 1
        return False

    lengths = list(filling)
    for i, a in enumerate(lengths):
        if waste and left_over(a + 1, a + waste):
            return True
        for b in lengths[i:]:
            if (a != b or filling[a] > 1) and left_over(a + b, a + b + waste):
                return True
    return left_over(1, waste)


def fillings(room: int, counts: dict[int, int], most_waste: int, nodes: int = FILL_NODES) -> tuple[list[dict[int, int]], int, bool]:
    """Undominated ways to fill ``room`` with at most ``most_waste`` left, fullest first; the steps taken; whether these are all.

    A depth-first enumeration over pairs of a length and its times, longest and
    most first, with its own stack. It takes ``nodes`` steps at most.
    """
    ascending = sorted(k for k, v in counts.items() if v and k <= room)
    lengths = ascending[::-1]
    negative = [-k for k in lengths]  # for bisection: lengths from the first that fits on
    rest = [0, *accumulate(k * counts[k] for k in ascending)][::-1]  # of all lengths from the i-th on
    found: list[tuple[int, int, dict[int, int]]] = []

    def steps(at: int, left: int) -> Iterator[tuple[int, int]]:
        for i in range(max(at, bisect_left(negative, -left)), len(lengths)):
            if rest[i] < left - most_waste:  # what is shorter cannot fill enough
                return
            for times in range(min(counts[lengths[i]], left // lengths[i]), 0, -1):
                yield i, times

    chosen: list[tuple[int, int]] = []
    stack, rooms, taken = [steps(0, room)], [room], 0
    if room <= most_waste and not lengths:
        found.append((room, 0, {}))
    while stack and taken <= nodes:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            rooms.pop()
            if chosen:
                chosen.pop()
            continue
        taken += 1
        i, times = step
        left = rooms[-1] - times * lengths[i]
        if left <= most_waste:
            filling = {lengths[j]: t for j, t in (*chosen, step)}
            if not dominated(filling, left, counts, ascending):
                found.append((left, sum(filling.values()), filling))
        chosen.append(step)
        stack.append(steps(i + 1, left))
        rooms.append(left)
    found.sort(key=lambda x: x[:2])
    return [f for _, _, f in found], taken, not stack


def search(counts: dict[int, int], capacity: int, allowed: int, budget: int, fill_nodes: int) -> tuple[list[Pattern] | None, int, bool]:
    """A packing that wastes at most ``allowed``, the budget left, and whether the search was complete.

    Depth first with an explicit stack; what is left is one table that each
    step changes and its end restores. Where many equal longest pieces are left,
    a filling is first used as often as it can be, then once.
    """
    left, total, waste = dict(counts), sum(k * v for k, v in counts.items()), 0
    made: list[tuple[dict[int, int], int, int]] = []
    stack: list[list[tuple[dict[int, int], int, int]]] = []
    whole = True

    def put(step: tuple[dict[int, int], int, int], sign: int) -> None:
        nonlocal total, waste
        times, n, lost = step
        for k, t in times.items():
            left[k] -= sign * n * t
        total -= sign * n * (capacity - lost)
        waste += sign * n * lost

    def options() -> list[tuple[dict[int, int], int, int]]:
        nonlocal budget, whole
        longest = max(k for k, v in left.items() if v)
        left[longest] -= 1
        if total <= capacity:  # the last bin: all that is left, whatever its waste
            ways = [{k: v for k, v in left.items() if v}]
        else:
            ways, taken, all_ = fillings(capacity - longest, left, allowed - waste, min(fill_nodes, budget))
            budget -= taken
            whole &= all_
        left[longest] += 1
        out = []
        for way in ways:
            times = {**way, longest: way.get(longest, 0) + 1}
            n = min(left[k] // t for k, t in times.items())
            lost = capacity - sum(k * t for k, t in times.items())
            if lost and total > capacity:
                n = min(n, (allowed - waste) // lost)
            out += [(times, m, lost) for m in dict.fromkeys((n, 1)) if m >= 1]
        return out[::-1]

    stack.append(options() if total else [])
    while stack and budget > 0:
        if not stack[-1]:
            stack.pop()
            if made:
                put(made.pop(), -1)
            continue
        step = stack[-1].pop()
        budget -= 1
        put(step, 1)
        made.append(step)
        if not total:
            return [(tuple(sorted(times.items(), reverse=True)), n) for times, n, _ in made], budget, whole
        stack.append(options() if waste <= allowed else [])
    return None, budget, whole and budget > 0


def solve(counts: dict[int, int], capacity: int = CAPACITY, search_nodes: int = SEARCH_NODES, fill_nodes: int = FILL_NODES) -> Packing:
    """Patterns that use each length as often as it occurs, with as few sequences as the search finds."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError("a length lies outside 1 to the capacity")
    total = sum(k * v for k, v in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    n_best = sum(n for _, n in best)
    for most in range(2, MOST_EVEN + 1):
        if n_best > bound:
            found = balanced(counts, capacity, most)
            if sum(n for _, n in found) < n_best:
                best, n_best = found, sum(n for _, n in found)
    complete = True
    while n_best > bound:
        found, search_nodes, complete = search(counts, capacity, (n_best - 1) * capacity - total, search_nodes, fill_nodes)
        if found is None:
            break
        best, n_best = found, sum(n for _, n in found)
    return Packing(best, n_best, n_best if complete else bound, complete)


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    return solve(counts, capacity).patterns


def placements(patterns: list[Pattern]) -> np.ndarray:
    """Rows ``(length, first rank, rank after the last, times, first sequence, offset)`` by length and rank.

    The piece with rank r of its length stands, by the row whose ranks it is
    among, in sequence ``sequence + (r - first) // times`` at ``offset + (r -
    first) % times * length``. There are as many rows as the patterns have
    lengths, however often these are used.
    """
    rows, used, sequence = [], Counter(), 0
    for contents, n in patterns:
        offset = 0
        for length, times in contents:
            first = used[length]
            used[length] += times * n
            rows.append((length, first, used[length], times, sequence, offset))
            offset += length * times
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' ids, each ended by ``end_id``, cut into pieces of at most ``capacity``.

    ``part`` and ``nth`` number the pieces of each length within a task.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def work(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = Encoder.at(tokenizer_path)
        seen = np.zeros(capacity + 1, np.int64)
        for rows, data, offsets in blocks(batches):
            ids, at = encoder.ids(data, offsets)
            n = np.diff(at) + 1
            of = np.repeat(np.arange(rows.num_rows), -(-n // capacity))
            piece = np.arange(len(of)) - np.searchsorted(of, of)
            start = piece * capacity
            length = np.minimum(capacity, n[of] - start)
            closed = np.zeros(int(n.sum()), "<u4")
            begin = np.cumsum(n) - n
            closed[begin + n - 1] = end_id
            mask = np.ones(len(closed), bool)
            mask[begin + n - 1] = False
            closed[mask] = ids
            view = memoryview(closed).cast("B")
            a = (begin[of] + start) * 4
            crc = [zlib.crc32(view[i : i + 4 * k]) for i, k in zip(a.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            nth = np.empty(len(of), np.int64)
            nth[order] = seen[ranked] + np.arange(len(of)) - np.searchsorted(ranked, ranked)
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("doc_id")).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(of), part), pa.int32()), pa.array(nth, pa.int64())],
                names,
            )

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work,
                     f"doc_id {dict(docs.dtypes)[id_col]}, {PIECE_SCHEMA}")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and ``n_sequences, least_sequences``.

    The last two are the same in all rows: the sequences used, and a number
    that no packing can go below; if they are equal, the packing is the best.

    A null or empty text is the end id alone. A text of any length is cut into
    pieces, and no id is lost. Rows with equal or null ids are packed each for
    itself. Which of two pieces of one length takes which place is not defined.
    An empty table gives an empty result. Columns of ``docs`` other than the two
    named are ignored, whatever their names.
    """
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pack-pieces")
    sizes = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    packing = solve(counts, capacity)
    names = ["length", "first", "end", "times", "sequence", "at"]
    places = placements(packing.patterns)
    places = spark.createDataFrame(pa.table([pa.array(places[:, k]) for k in range(len(names))], names))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("nth")
    held = ["doc_id", "piece", "start", "ids_crc32"]
    ranked = pieces.join(bases, ["part", "length"]).select(
        "length", F.floor(rank / RANK_BLOCK).alias("block"), rank.alias("rank"), F.struct(*held).alias("held")
    )
    blocks_of = F.sequence(F.floor(F.col("first") / RANK_BLOCK), F.floor((F.col("end") - 1) / RANK_BLOCK))
    marks = places.select("length", F.explode(blocks_of).alias("block"), F.col("first").alias("rank"), F.struct("first", "times", "sequence", "at").alias("place"))
    upto = Window.partitionBy("length", "block").orderBy("rank", F.col("held").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marks.unionByName(ranked, allowMissingColumns=True).withColumn("place", F.last("place", True).over(upto)).where("held is not null")
    more = F.col("rank") - F.col("place.first")
    return placed.select(
        "held.doc_id", "held.piece", "held.start", "length", "held.ids_crc32",
        (F.col("place.sequence") + F.floor(more / F.col("place.times"))).alias("sequence_id"),
        (F.col("place.at") + more % F.col("place.times") * F.col("length")).alias("offset"),
        F.lit(packing.sequences).cast("long").alias("n_sequences"), F.lit(packing.bound).cast("long").alias("least_sequences"),
    )
