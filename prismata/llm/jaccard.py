"""Exact n-gram Jaccard self-join with set-relation skipping.

Documents are sets of word shingles, held as sorted 64-bit hashes. Equal sets
form a class, named by a digest of the set; only classes are joined.

*Index lists by position.* All shingles have one order, rarest first by a sketch
of their frequencies over all documents, so that passages which many documents
share come last. Sets that link have a shingle in common among the first few of
both (their prefixes). A list of the index holds the sets with one shingle in
their prefix, each with the shingle's position and its size. If a shingle is the
first that two sets share, all shingles before it are differences: sets whose
positions add up to more differences than a link allows need not be looked at.
Lists of more than ``BLOCK`` sets are cut in blocks by component, position and
set, and a block skips all blocks beyond the positions and sizes that it can
link with, and those of its own component. Block pairs are also what long lists
are dealt out by.

*Answers from answers.* Of each list, the set with the most companions in all
its lists is the head, and the others are first compared with heads only. This
leaves a computed answer for every set: its difference from a very similar one.
Further answers are derived from these. Sets that link with the same head are
in one component, and blocks within a component are skipped. Two sets whose
differences from one head are ``d`` and ``e`` differ in ``|d - e|`` to ``d + e``
shingles, which decides most pairs without the sets; parity bitmaps decide more.
What is left is compared in two rounds: first the closest pair for each set and
component, then, unless the components have met, all others.

All comparisons are exact, on the 64-bit hashes of the shingles of whole texts.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import blank, blocks, distinct, give_back, map_arrow
from .columns import likely, looked_up
from .components import components
from .storage import discard, materialize

SHINGLE = 3
#: Links have ``DEN * intersection >= NUM * union``.
NUM, DEN = 90, 100
#: Counters of the frequency sketch, whatever the table, and of one of its rows.
SKETCH_BITS, CHUNK_BITS = 20, 16
#: Steps of frequency per factor of two, up to 255 in all.
LEVELS = 8
#: Rows of a block, about, and of a part of a list that is put together in one task.
BLOCK, PART = 512, 4096
#: Rows of a list among which each pair's positions are looked at beforehand, and rows of one that a task holds until its end.
SEEN, WAIT = 64, 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _ODD[3]
        x = (x ^ (x >> np.uint64(29))) * _ODD[1]
        return x ^ (x >> np.uint64(32))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles.

    Words are runs of other than ASCII white space, A-Z in lower case. A text of
    fewer than ``width`` words has its whole sequence as its only shingle, one
    without words none.
    """
    none = np.zeros(0, np.uint64)
    if not len(data):
        return [none] * (len(offsets) - 1)
    space = blank(data)
    held = ~space
    mark = held.copy()
    mark[1:] &= space[:-1]
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    mark[begins] = held[begins]
    ends = np.concatenate([[0], np.cumsum(held)])[offsets]
    first = np.flatnonzero(mark[held])
    if not len(first):
        return [none] * (len(offsets) - 1)
    index, words = distinct(_LOWER[data[held]], np.append(first, int(held.sum())))
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[index]
    at = np.searchsorted(first, ends)
    with np.errstate(over="ignore"):
        rolled = np.full(max(0, len(w) - width + 1), width, np.uint64)
        for k in range(width):
            rolled = mixed(rolled * _ODD[0] + w[k : len(w) - width + 1 + k])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.insert(s[1:] != s[:-1], 0, True)])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            with np.errstate(over="ignore"):
                for x in w[a:b]:
                    h = mixed(h * _ODD[0] + x)
            out.append(h)
        else:
            out.append(none)
    return out


def most_different(total: int, num: int = NUM, den: int = DEN) -> int:
    """The most shingles in which two linked sets with ``total`` elements together can differ."""
    return total * (den - num) // (den + num)


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    """How many of the first shingles of a set one of those is among that it shares with any set it links with.

    0 for a set that links with equal sets only.
    """
    if not most_different(n + n * den // num, num, den):
        return 0
    return n - -(-n * num // den) + 1


class Order:
    """The order of shingles: by level of frequency, then by hash."""

    def __init__(self, counts: np.ndarray):
        self.levels = np.minimum(255, np.round(LEVELS * np.log2(1 + counts.astype(np.float64)))).astype(np.uint8)
        # a counter is shared by other shingles: only what goes far beyond the mean is a frequency
        expected = np.exp2(np.arange(256) / LEVELS) - 8 * counts.mean() if len(counts) else np.zeros(256)
        self.parts = np.maximum(1, np.ceil(expected / PART)).astype(np.uint64)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """A number for each shingle that sorts as the order does; its top byte is the level."""
        level = self.levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
        return level << np.uint64(56) | mixed(s) >> np.uint64(8)


def parity_bits(s: np.ndarray) -> np.ndarray:
    """A bitmap of at least twice as many bits as elements, each element flipping one.

    Two sets differ in no fewer elements than their bitmaps in bits. Halves of a
    bitmap, combined by exclusive or, are the bitmap of half the size.
    """
    n = 64
    while n < 2 * len(s):
        n *= 2
    counts = np.bincount((mixed(s) % np.uint64(n)).astype(np.int64), minlength=n) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little")


def set_name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, id, bits`` of each row: its set's size, name and bitmap; and, with ``chunk``, parts of the frequency sketch."""
    def work(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for rows, data, offsets in blocks(batches):
            found = shingle_sets(data, offsets, width)
            flat = np.concatenate(found)
            counts += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("doc_id")), pa.array(map(len, found), pa.int64()),
                 pa.array([set_name(s) if len(s) else None for s in found], pa.int64()),
                 pa.array([parity_bits(s).tobytes() if len(s) else None for s in found], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names
            )
        for k, part in enumerate(counts.reshape(-1, 1 << CHUNK_BITS)):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [*[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names
                )

    names = ["doc_id", "n", "id", "bits", "chunk", "counts"]
    return map_arrow(docs, work, "doc_id long, n long, id long, bits binary, chunk int, counts binary")


def _order(sets: DataFrame) -> Order:
    """The order by the counts of all documents; ``2**SKETCH_BITS`` counters reach the driver."""
    def work(batches):
        held: dict[int, np.ndarray] = {}
        for rows in batches:
            for k, x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(x, np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["chunk", "counts"])

    parts = sets.where("chunk is not null").select("chunk", "counts").repartition("chunk")
    counts = np.zeros(1 << SKETCH_BITS, np.uint64)
    for r in map_arrow(parts, work, "chunk int, counts binary").toLocalIterator():
        at = r["chunk"] << CHUNK_BITS
        counts[at : at + (1 << CHUNK_BITS)] += np.frombuffer(r["counts"], np.uint64)
    return Order(counts)


def with_partner(lists: np.ndarray, n: np.ndarray, pos: np.ndarray, num: int, den: int, seen: int = SEEN) -> np.ndarray:
    """Which rows have another in their list that sizes and positions allow a link with.

    Rows are sorted by list and size. In a list of over ``seen`` rows, those
    with one near in size are taken as well, whatever the positions.
    """
    size = np.bincount(lists)[lists]
    same = lists[1:] == lists[:-1]
    close = same & (n[:-1] * den >= n[1:] * num) & (size[1:] > seen)  # by size, the next is the likeliest partner
    found = np.append(close, False) | np.insert(close, 0, False) if len(n) else np.zeros(0, bool)
    at = np.flatnonzero((size > 1) & (size <= seen))
    for d in range(1, seen):
        at = at[at + d < len(n)]
        at = at[lists[at + d] == lists[at]]
        if not len(at):
            break
        x, y = at, at + d
        ok = (n[x] * den >= n[y] * num) & ((pos[x] + pos[y]) * (den + num) <= (n[x] + n[y]) * (den - num))
        found[x[ok]] = found[y[ok]] = True
    return found


def _lists(docs: DataFrame, order: Order, width: int, num: int, den: int) -> DataFrame:
    """``key, id, n, pos`` of the sets that have another in a list that sizes and positions allow a link with.

    In lists of over ``SEEN`` sets, some stay that have none.

    A list that the sketch says may be long is put together in parts, by the
    names of its sets; a part is kept whole.
    """
    def entries(batches):
        for rows, data, offsets in blocks(batches):
            done: set[int] = set()
            keys, names, n, pos = [], [], [], []
            for s in shingle_sets(data, offsets, width):
                k = prefix_length(len(s), num, den) if len(s) else 0
                name = set_name(s) if k else 0
                if not k or name in done:
                    continue
                done.add(name)
                own = order.keys(s)
                own = np.sort(np.partition(own, k - 1)[:k] if k < len(own) else own)
                keys.append(own)
                names.append(np.full(k, name))
                n.append(np.full(k, len(s), np.int32))
                pos.append(np.arange(k, dtype=np.int32))
            if not keys:
                continue
            key, name = np.concatenate(keys), np.concatenate(names)
            parts = order.parts[(key >> np.uint64(56)).astype(np.int64)]
            part = (mixed(name.view(np.uint64)) % parts).astype(np.int32)
            part[parts == 1] = -1  # a whole list
            for a in range(0, len(key), 500_000):
                own = slice(a, a + 500_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[own].view(np.int64)), pa.array(part[own]), pa.array(name[own]), pa.array(np.concatenate(n)[own]), pa.array(np.concatenate(pos)[own])],
                    ["key", "part", "id", "n", "pos"],
                )

    def shared(batches):
        held, over = None, None  # rows of a list that may go on, and a list of which some rows went out before its end
        for rows in chain(batches, [None]):
            if rows is not None:
                new = [rows.column(c).to_numpy() for c in range(5)]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if not held or not len(held[0]):
                continue
            fresh = np.insert((held[0][1:] != held[0][:-1]) | (held[2][1:] != held[2][:-1]), 0, True)  # copies of a set stand together
            key, part, _, n, pos = held = [x[fresh] for x in held]
            first = np.insert((key[1:] != key[:-1]) | (part[1:] != part[:-1]), 0, True)
            kept = with_partner(np.cumsum(first), n.astype(np.int64), pos.astype(np.int64), num, den, SEEN) | (part >= 0)
            if over:
                kept |= (key == over[0]) & (part == over[1])
            cut = int(np.flatnonzero(first)[-1]) if rows is not None else len(key)
            if len(key) - cut > WAIT:
                over, cut = (key[-1], part[-1]), len(key) - 1
                kept |= (key == over[0]) & (part == over[1])
            kept = kept[:cut]
            yield pa.RecordBatch.from_arrays([pa.array(x[:cut][kept]) for x in (key, *held[2:])], ["key", "id", "n", "pos"])
            held = [x[cut:] for x in held]

    rows = map_arrow(docs, entries, "key long, part int, id long, n int, pos int")
    return map_arrow(rows.repartition("key", "part").sortWithinPartitions("key", "part", "n", "id"), shared, "key long, id long, n int, pos int")


def _may_link(a: str, b: str, num: int, den: int) -> str:
    """Whether sizes and positions allow a link of two rows of a list."""
    low, high = f"least({a}.n, {b}.n)", f"greatest({a}.n, {b}.n)"
    return f"{low} * {den}L >= {high} * {num}L and ({a}.pos + {b}.pos) * {den + num}L <= ({a}.n + {b}.n) * {den - num}L"


def _head_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: each set with the heads of its lists.

    A list has a head for each span of sizes: sets are paired with that of their
    own and of the next smaller ones.
    """
    lists = lists.withColumn("span", F.expr(f"cast(floor(ln(n) / ln({den / num!r})) as int)"))
    total = lists.count()
    k = lists.groupBy("key", "span").agg(F.count(F.lit(1)).alias("k"))
    weight = looked_up(lists, k, ["key", "span"], ["k"], "k", total, "id").groupBy("id").agg(F.sum("found.k").alias("weight"))
    heads = lists.join(weight, "id").groupBy("key", "span").agg(F.max(F.struct("weight", "id", "n", "pos")).alias("top"))
    asked = lists.withColumn("span", F.explode(F.array(F.col("span"), F.col("span") - 1)))
    asks = asked.groupBy("key", "span").agg(F.count(F.lit(1)).alias("asks"))
    heads = materialize(heads.join(asks, ["key", "span"]).select("key", "span", "asks", "top.id", "top.n", "top.pos"), "jaccard-heads")
    pairs = looked_up(asked, heads, ["key", "span"], ["id", "n", "pos"], "asks", 2 * total, "id").alias("x")
    pairs = pairs.where(f"x.found is not null and x.id <> found.id and {_may_link('x', 'found', num, den)}")
    return pairs.select(F.col("x.id").alias("a"), F.col("found.id").alias("b")).distinct()


def _near(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` of the pairs that the bitmaps do not prove to differ in too many shingles."""
    def work(batches):
        for rows in batches:
            n = rows.column(2).to_numpy() + rows.column(4).to_numpy()
            off = []
            for x, y in zip(rows.column(3).to_pylist(), rows.column(5).to_pylist(), strict=True):
                x, y = _folded([x], min(len(x), len(y))), _folded([y], min(len(x), len(y)))
                off.append(int(np.bitwise_count(x ^ y).sum()))
            ok = pa.array(np.array(off, np.int64) <= n * (den - num) // (den + num))
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(ok), rows.column(1).filter(ok)], ["a", "b"])

    side = lambda k: classes.select(F.col("id").alias(k), F.col("n").alias(f"{k}n"), F.col("bits").alias(f"{k}bits"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "an", "abits", "bn", "bbits")
    return map_arrow(both, work, "a long, b long")


def _sets_of(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``id, shingles`` of the sets ``wanted (doc_id, id)``, out of the text of that document.

    Other texts stay where they are, but for the few that ``likely`` leaves.
    """
    def sets(batches):
        for rows, data, offsets in blocks(batches):
            want = rows.column(rows.schema.get_field_index("id")).to_numpy()
            found = [(i, s) for i, s in zip(want.tolist(), shingle_sets(data, offsets, width), strict=True) if len(s) and set_name(s) == i]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["id", "shingles"],
            )

    own = likely(docs.where("text is not null"), wanted, "doc_id").join(wanted, "doc_id").dropDuplicates(["doc_id", "id", "text"])  # rows may repeat
    return map_arrow(own, sets, "id long, shingles binary")


def _compare(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """``a, b, common, total`` of each pair, from the shingles of the two texts."""
    def count(batches):
        for rows in batches:
            found = []
            for x, y in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                found.append((common, len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array([c for c, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())],
                ["a", "b", "common", "total"],
            )

    x, y = (held.select(F.col("id").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    both = pairs.join(x.join(pairs.select("a").distinct(), "a", "left_semi"), "a").join(y.join(pairs.select("b").distinct(), "b", "left_semi"), "b")
    return map_arrow(both.select("a", "b", "x", "y"), count, "a long, b long, common long, total long")


def _folded(bits: list[bytes], least: int) -> np.ndarray:
    """Bitmaps as rows of one size, that of the shortest."""
    table = np.empty((len(bits), least), np.uint8)
    for i, b in enumerate(bits):
        x = np.frombuffer(b, np.uint8)
        while len(x) > least:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        table[i] = x
    return table.view(np.uint64)


def linked_candidates(left: dict, right: dict, same: bool, num: int, den: int, closest: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of two blocks of a list that nothing known rules out, by their names, and how many ``closest`` left out.

    Blocks have arrays ``id, root, n, pos, ref, diff`` and a list ``bits``, by
    position; ``ref`` is a set compared with before, and ``diff`` the difference
    from it. ``same`` tells that both are one block.
    """
    least = min(map(len, (*left["bits"], *right["bits"])))
    ours, theirs = _folded(left["bits"], least), _folded(right["bits"], least)
    a_out, b_out, left_out = [], [], 0
    for i in range(len(left["id"])):
        low = np.minimum(right["n"], left["n"][i])
        total = right["n"] + left["n"][i]
        most = total * (den - num) // (den + num)
        fit = (right["root"] != left["root"][i]) & (low * den >= (total - low) * num) & (right["pos"] + left["pos"][i] <= most)
        fit &= ~((right["ref"] == left["ref"][i]) & (np.abs(right["diff"] - left["diff"][i]) > most))
        if same:
            fit[: i + 1] = False
        fit = np.flatnonzero(fit)
        if not len(fit):
            continue
        off = np.bitwise_count(theirs[fit] ^ ours[i]).sum(1, dtype=np.int64)
        ok = off <= most[fit]
        fit, off = fit[ok], off[ok]
        if closest and len(fit) > 1:
            order = np.argsort(off, kind="stable")
            _, one = np.unique(right["root"][fit[order]], return_index=True)
            left_out += len(fit) - len(one)
            fit = fit[order[one]]
        a_out.append(np.minimum(right["id"][fit], left["id"][i]))
        b_out.append(np.maximum(right["id"][fit], left["id"][i]))
    none = np.zeros(0, np.int64)
    return (np.concatenate(a_out), np.concatenate(b_out), left_out) if a_out else (none, none, 0)


def _cross_pairs(lists: DataFrame, roots: DataFrame, answers: DataFrame, classes: DataFrame, num: int, den: int, closest: bool) -> DataFrame:
    """``a, b`` of one list in different components that positions, sizes, known answers and bitmaps do not rule out.

    With ``closest``, only the closest partner of a set in each other component;
    ``left_out`` is then above 0 where there were others.
    """
    rooted = lists.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k"), F.max("pos").alias("last")).where("lo <> hi")
    rows = rooted.join(open_.select("key", "k", "last"), "key")
    # a list of up to BLOCK sets is one block; a longer one is cut by component, and beyond 16 such groups by position and set
    parts = F.ceil(F.col("k") / BLOCK)
    groups = F.least(parts, F.lit(16))
    more = F.ceil(F.sqrt(parts / groups))
    place = F.pmod(F.xxhash64("root"), groups) * more + F.floor(F.col("pos") * more / (F.col("last") + 1))
    rows = rows.withColumn("block", (place * more + F.pmod(F.xxhash64("id"), more)).cast("long")).drop("k", "last")
    edge = rows.groupBy("key", "block").agg(F.min("pos").alias("pos"), F.min("n").alias("least"), F.max("n").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    x, y = edge.alias("x"), edge.alias("y")
    linked = x.join(y, "key").where(
        f"x.block <= y.block and not (x.lo = x.hi and y.lo = y.hi and x.lo = y.lo) and (x.pos + y.pos) * {den + num}L <= (x.n + y.n) * {den - num}L "
        f"and x.n * {den}L >= y.least * {num}L and y.n * {den}L >= x.least * {num}L"
    ).select("key", F.col("x.block").alias("left"), F.col("y.block").alias("right"))
    sides = linked.select("key", "left", "right", F.explode(F.when(F.col("left") == F.col("right"), F.array("left")).otherwise(F.array("left", "right"))).alias("block"))
    nearest = answers.groupBy(F.col("a").alias("id")).agg(F.min(F.struct((F.col("total") - F.col("common")).alias("diff"), F.col("b").alias("ref"))).alias("known"))
    full = rows.join(sides, ["key", "block"]).join(nearest, "id", "left").join(classes.select("id", "bits"), "id")
    full = full.select("key", "left", "right", "block", "id", "root", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"),
                       F.coalesce("known.ref", "id").alias("ref"), F.coalesce("known.diff", F.lit(0)).alias("diff"), "bits")

    def work(batches):
        names = ["id", "root", "n", "pos", "ref", "diff"]
        group, sides = None, {}

        def pairs():
            if not sides:
                return
            _, left, right = group
            blocks_ = {k: {c: np.concatenate([h[c] for h in v]) for c in names} | {"bits": [b for h in v for b in h["bits"]]} for k, v in sides.items()}
            if left in blocks_ and right in blocks_:
                a, b, more = linked_candidates(blocks_[left], blocks_[right], left == right, num, den, closest)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), more))], ["a", "b", "left_out"])

        for rows in batches:
            if not rows.num_rows:
                continue
            by = np.stack([rows.column(c).to_numpy() for c in range(4)], 1)
            cuts = np.concatenate([[0], np.flatnonzero((by[1:] != by[:-1]).any(1)) + 1, [len(by)]]).tolist()
            columns = {c: rows.column(4 + k).to_numpy() for k, c in enumerate(names)}
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = tuple(by[a, :3].tolist())
                if own != group:
                    yield from pairs()
                    group, sides = own, {}
                part = {c: v[a:b] for c, v in columns.items()} | {"bits": rows.column(10).slice(a, b - a).to_pylist()}
                sides.setdefault(int(by[a, 3]), []).append(part)
        yield from pairs()

    ordered = full.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "block")
    return map_arrow(ordered, work, "a long, b long, left_out long").groupBy("a", "b").agg(F.max("left_out").alias("left_out"))


def jaccard_components(docs: DataFrame, width: int = SHINGLE, num: int = NUM, den: int = DEN,
                       id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Components of the documents by links of Jaccard similarity ``num / den`` or more, and compared pairs.

    The first table has ``doc_id, n_shingles, class_id, component_id`` for each row:
    ``class_id`` is the smallest id with the same set, ``component_id`` the
    smallest id reachable by links. The second has ``a, b, common, total`` for the
    compared pairs of sets that link, by the smallest ids that have them; it
    connects each component but leaves out pairs that are already connected, so
    it is a spanning part of all links and gives no number of links of a document.

    Ids are whole numbers; rows with one id are one document, linked by what any
    of them links to, whatever the order of the rows. Null or empty texts have
    no shingles and link with nothing. Texts of any length are read whole. Rows
    with a null id have a null class and component. Columns other than the two
    named are ignored. An empty table gives two empty results.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = materialize(_sets(texts, width), "jaccard-sets")
    sets = found.where("chunk is null").select("doc_id", "n", "id")
    named = found.where("n > 0 and doc_id is not null")
    classes = named.groupBy("id").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "jaccard-classes")
    lists = materialize(_lists(texts, _order(found), width, num, den), "jaccard-lists")
    give_back()
    # an id with texts of several classes joins these
    first = named.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a <> last").select("doc_id", "a")
    shared = materialize(named.join(first, "doc_id").select("a", F.col("id").alias("b")).where("a <> b").distinct(), "jaccard-shared-ids")

    link = f"common * {den} >= total * {num}"
    compared: list[DataFrame] = []

    def compare(pairs: DataFrame) -> None:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = materialize(classes.join(ids, "id", "left_semi").select(F.col("rep").alias("doc_id"), "id"), "jaccard-wanted")
        held = materialize(_sets_of(wanted, texts, width), "jaccard-compared-sets")
        compared.append(materialize(_compare(pairs, held), "jaccard-compared"))
        discard(held, wanted)

    def linked() -> DataFrame:
        links = shared
        for more in compared:
            links = links.unionByName(more.where(link).select("a", "b"))
        return components(links)

    compare(materialize(_near(_head_pairs(lists, num, den), classes, num, den), "jaccard-head-pairs"))
    roots = linked()
    for closest in (True, False):
        done = compared[0].select("a", "b")
        for more in compared[1:]:
            done = done.unionByName(more.select("a", "b"))
        done = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        cross = materialize(_cross_pairs(lists, roots, compared[0], classes, num, den, closest), "jaccard-cross")
        pairs = materialize(cross.select("a", "b").join(done, ["a", "b"], "left_anti"), "jaccard-cross-pairs")
        if not pairs.isEmpty():
            compare(pairs)
            discard(roots)
            roots = linked()
        if not cross.agg(F.max("left_out")).first()[0]:
            break
    discard(lists)

    links = compared[0].where(link)
    for more in compared[1:]:
        links = links.unionByName(more.where(link))
    rep = lambda k: classes.select(F.col("id").alias(k), F.col("rep").alias(f"{k}_rep"))
    links = links.join(rep("a"), "a").join(rep("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"), "common", "total")

    # a component, and a class, may hold a third of all classes or documents
    rooted = materialize(classes.join(roots, "id").select("id", "root", "rep", "copies"), "jaccard-rooted")
    lowest = rooted.groupBy("root").agg(F.min("rep").alias("lowest"), F.count(F.lit(1)).alias("members"))
    known = looked_up(rooted, lowest, ["root"], ["lowest"], "members", rooted.count(), "id").select("id", F.col("found.lowest").alias("lowest"))
    known = materialize(classes.join(known, "id", "left").select("id", "rep", F.coalesce("lowest", "rep").alias("lowest"), "copies"), "jaccard-known")
    out = looked_up(sets.withColumn("_row", F.xxhash64("doc_id")), known, ["id"], ["rep", "lowest"], "copies", sets.count(), "_row")
    out = out.select("doc_id", "n", "found.rep", "found.lowest")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("rep").alias("class_id"), own("lowest").alias("component_id")), links
