"""Byte-level BPE over Arrow batches with the tokenizers library.

A rank file lists byte strings in the order in which they merge. The library
works on characters, so each byte is written as one printable character (the
byte-level alphabet), and each rank becomes the merges of all pairs of ranked
parts that make its bytes. Texts are cut before runs of white space, where the
split pattern always cuts as well; each worker remembers the ids of the
segments it has seen.

Decoding reverses the byte table. A character whose bytes lie in several tokens
is put together before it is read as UTF-8; ``offsets`` give such a token the
characters that any of its bytes belong to.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Memo, blocks, cut_ids, distinct, gather, map_arrow, segments

#: White space beyond ASCII; a text that has any is not cut.
_WIDE_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_loaded: dict[tuple[str, str], Codec] = {}


def byte_characters() -> list[str]:
    """The character for each byte: itself where it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, extra = [], 256
    for b in range(256):
        table.append(chr(b) if b in prints else chr(extra))
        extra += b not in prints
    return table


class Codec:
    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        to_char = byte_characters()
        spell = {token: "".join(map(to_char.__getitem__, token)) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            pairs = ((token[:i], token[i:]) for i in range(1, len(token)))
            merges += [(spell[a], spell[b]) for a, b in pairs if a in ranks and b in ranks]
        model = models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length_of = np.array([len(t) for t in self.bytes_of], np.int64)
        self.memo = Memo(self._encode)

    @classmethod
    def at(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = cls(path, pattern)
        return _loaded[path, pattern]

    def _encode(self, keys: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([k.decode() for k in keys], add_special_tokens=False)
        return cut_ids([x.ids for x in found])

    def encode(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts in them."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        starts, first = segments(data, offsets, whole)
        index, keys = distinct(data, starts)
        held = self.memo(keys)
        n = np.fromiter(map(len, held), np.int64, len(held)) // 4
        ids = gather(np.frombuffer(b"".join(held), "<u4"), n, index)
        return ids, np.concatenate([[0], np.cumsum(n[index])]).astype(np.int64)[first]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last of each token, in code points."""
        ends = np.cumsum(self.length_of[ids])
        text = np.frombuffer(self.decode(ids), np.uint8)
        char = np.cumsum((text & 0xC0) != 0x80)  # the number, from 1, of each byte's character
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return char[ends - self.length_of[ids]] - 1, char[ends - 1]


def _whole(rows: pa.RecordBatch) -> np.ndarray:
    text = rows.column(rows.schema.get_field_index("text"))
    return pc.fill_null(pc.match_substring_regex(text, _WIDE_SPACE), False).to_numpy(zero_copy_only=False)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_offsets: bool = False, with_decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit, as binary) for each row of ``docs``.

    With ``with_offsets``, also ``starts`` and ``ends``: the code points of each
    token. With ``with_decoded``, also ``decoded``: what ``decode`` makes of the
    ids, in the same pass and by the same workers. Null texts count as empty and give no ids; ids of rows may repeat or
    be null; other columns are ignored.
    """
    def work(batches):
        codec = Codec.at(ranks_path, pattern)
        for rows, data, offsets in blocks(batches):
            ids, at = codec.encode(data, offsets, _whole(rows))
            own = [ids[at[i] : at[i + 1]] for i in range(rows.num_rows)]
            columns = [rows.column(rows.schema.get_field_index("doc_id")), pa.array([x.tobytes() for x in own], pa.binary())]
            if with_offsets:
                spans = [codec.offsets(x) for x in own]
                columns += [pa.array([s[k] for s in spans], pa.list_(pa.int64())) for k in (0, 1)]
            if with_decoded:
                columns.append(pa.array([codec.decode(x) for x in own], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "ids", *["starts", "ends"] * with_offsets, *["decoded"] * with_decoded]
    schema = (f"doc_id {dict(docs.dtypes)[id_col]}, ids binary" + ", starts array<long>, ends array<long>" * with_offsets
              + ", decoded binary" * with_decoded)
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` from ``doc_id, ids``; ``decoded`` is the bytes of the text.

    A null ``ids`` gives empty bytes.
    """
    def work(batches):
        codec = Codec.at(ranks_path, pattern)
        for rows in batches:
            ids = rows.column(rows.schema.get_field_index("ids"))
            text = [codec.decode(np.frombuffer(x or b"", "<u4")) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("doc_id")), ids, pa.array(text, pa.binary())], ["doc_id", "ids", "decoded"]
            )

    return map_arrow(encoded, work, f"doc_id {dict(encoded.dtypes)['doc_id']}, ids binary, decoded binary")
