"""Token ids of whole texts by a tokenizer file, piece by piece.

The tokenizer splits a text before its merges, so the ids of a text are the ids
of its pieces in turn. Pieces recur; each worker remembers the ids of those it
has seen and gives only new ones to the library. White-space separated chunks
of plain Latin characters are cut here as the tokenizer's own split cuts them;
any other chunk (other scripts, apostrophes, special strings) goes whole to the
library.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .arrowtext import Memo, blank, cut_ids, distinct, gather, segments, sums

#: Fixed value: the split pattern that the cuts below agree with.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LETTER, _DIGIT, _OTHER = 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CONTROL = np.zeros(256, bool)
_CONTROL[[*range(9), *range(14, 32), 127]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_loaded: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        steps = [x.get("pattern", {}).get("Regex") for x in (held.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        lowers = any(x.get("type") == "Lowercase" for x in (held.get("normalizer") or {}).get("normalizers", []))
        #: Cutting is only done for the split that it was written for.
        self.cuts = steps[:1] == [_SPLIT] and lowers
        self.memo = Memo(self._encode)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _encode(self, keys: list[bytes]) -> list[bytes]:
        found = [x.ids for x in self.library.encode_batch_fast([x.decode() for x in keys], add_special_tokens=False)]
        return cut_ids(found)

    def _cut(self, data: np.ndarray, offsets: np.ndarray):
        """The text without white space, the starts of its pieces, and each text's first piece."""
        starts, _ = segments(data, offsets)
        space = blank(data)
        after = np.append(data[1:], 0)
        before = np.insert(data[:-1], 0, 0)
        lead = (data == 0xC3) & (after != 0x97) & (after != 0xB7)  # À to ÿ without the signs × and ÷
        pair = (before == 0xC3) & (data != 0x97) & (data != 0xB7) & (data >= 0x80)
        odd = ((data >= 0x80) & ~lead & ~pair) | _CONTROL[data] | (data == 39) | ((data == 60) & (after == 124))
        whole = np.zeros(len(starts) - 1, bool)
        whole[np.searchsorted(starts, np.flatnonzero(odd), "right") - 1] = True
        if not self.cuts:
            whole[:] = True
        free = ~np.repeat(whole, np.diff(starts))
        lower = np.where(free, _LOWER[data], data)
        lower[free & pair & (data <= 0x9E)] += 0x20
        kind = np.where(space, 0, _CLASS[data])
        mark = np.zeros(len(data), bool)
        mark[1:] = free[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        mark[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        mark[starts[:-1]] = True
        mark[1:] |= space[:-1]  # a mark on white space moves to the next byte that stays
        held = ~space
        ends = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])[offsets]
        first = np.flatnonzero(mark[held])
        return lower[held], np.append(first, ends[-1]), np.searchsorted(first, ends)

    def _found(self, data, offsets):
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), []
        text, starts, first = self._cut(data, offsets)
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), []
        index, keys = distinct(text, starts)
        held = self.memo(keys)
        return index, np.fromiter(map(len, held), np.int64, len(held)) // 4, first, held

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of ids of each text."""
        index, n, first, _ = self._found(data, offsets)
        return sums(n[index], first)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts in them."""
        index, n, first, held = self._found(data, offsets)
        ids = gather(np.frombuffer(b"".join(held), "<u4"), n, index)
        return ids, np.concatenate([[0], np.cumsum(n[index])]).astype(np.int64)[first]
