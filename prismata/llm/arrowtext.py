"""Text columns as flat byte arrays, for operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship

#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1_000_000


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on and serves later stages, as others beside it do."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``, with this package on the executors and each worker's memory given back at the end of a task."""
    def tidy(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    ship(df.sparkSession)
    return df.mapInArrow(tidy, schema)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``BLOCK_BYTES`` of text, each with its bytes and the n + 1 offsets of its texts.

    A null text is empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + BLOCK_BYTES, "right")) - 1
            stop = min(batch.num_rows, max(stop, start + 1))
            own = offsets[start : stop + 1]
            yield batch.slice(start, stop - start), data[own[0] : own[-1]], own - own[0]
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def blank(data: np.ndarray) -> np.ndarray:
    return _BLANK[data]


def segments(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cut texts before each run of ASCII white space.

    Gives the starts of the segments, with the end of the data last, and for
    each text the index of its first segment, with the number of segments last.
    Texts marked in ``whole`` are left uncut.
    """
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    space = blank(data)
    mark = np.zeros(len(data), bool)
    mark[1:] = space[1:] & ~space[:-1]
    if whole is not None:
        for i in np.flatnonzero(whole):
            mark[offsets[i] : offsets[i + 1]] = False
    mark[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(mark)
    return np.append(starts, len(data)), np.searchsorted(starts, offsets)


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The index of each segment's value, and the values."""
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).dictionary_encode()
    return column.indices.to_numpy(zero_copy_only=False), column.dictionary.to_pylist()


def gather(flat_values: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The concatenation of the ragged rows ``index`` of ``flat_values``."""
    first = np.cumsum(lengths) - lengths
    n = lengths[index]
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    return flat_values[np.arange(total) + np.repeat(first[index] - (end - n), n)]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def cut_ids(rows: list[list[int]]) -> list[bytes]:
    """Each row of ids as little-endian unsigned 32-bit numbers."""
    flat = np.fromiter(chain.from_iterable(rows), "<u4").tobytes()
    at = [0, *accumulate(map(len, rows))]
    return [flat[4 * a : 4 * b] for a, b in pairwise(at)]


class Memo:
    """Values of byte strings seen before, in two generations.

    When keys and values of the younger one take ``most`` bytes it becomes the
    older, and what was older is forgotten unless it was asked for since.
    Values are byte strings as well.
    """

    #: Bytes that a key and its value take in the dictionary beside their own, about.
    ENTRY = 160

    def __init__(self, compute: Callable[[list[bytes]], list[bytes]], most: int = 40_000_000, longest: int = 64):
        self.compute, self.most, self.longest = compute, most, longest
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.taken = 0

    def __call__(self, keys: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        if not missing:
            return found
        if self.taken > self.most:
            self.known, self.older, self.taken = {}, self.known, 0
        fresh, again = [], {}
        for i in missing:
            value = self.older.get(keys[i])
            if value is None:
                fresh.append(i)
            else:
                found[i] = again[keys[i]] = value
        if fresh:
            named = [keys[i] for i in fresh]
            values = self.compute(named)
            for i, value in zip(fresh, values, strict=True):
                found[i] = value
            again.update((k, v) for k, v in zip(named, values, strict=True) if len(k) <= self.longest)
        self.known.update(again)
        self.taken += sum(map(len, again)) + sum(map(len, again.values())) + self.ENTRY * len(again)
        return found
