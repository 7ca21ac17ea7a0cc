"""Media columns in ISO media containers.

``write_movie`` stores a payload as one track of raw 8-bit frames;
``read_tracks`` walks the nested boxes of a container, decodes the sample tables
of each track and gives codec, duration and the byte ranges of samples and key
frames. Reading touches the boxes only; the payload is not decoded. A container
that cannot be read is a row with an error, not the end of the job.

The layout is that of ISO/IEC 14496-12: ``ftyp``, ``mdat``, then ``moov`` with
``mvhd`` and a ``trak`` down to its ``stbl``. Times are zero, so equal payloads
give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import blocks, map_arrow

#: A frame of 24 x 24 samples of 8 bits.
SIDE = 24
FRAME = SIDE * SIDE
PAD = b"\xff"
TIMESCALE = 25
FRAMES_PER_CHUNK = 8
#: Every so many frames, from the first on, is marked as a key frame.
KEY_EVERY = 12

#: The boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def frames_of(text: bytes) -> bytes:
    """The text padded to whole frames, one at least."""
    n = max(1, -(-len(text) // FRAME)) * FRAME
    return text + PAD * (n - len(text))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 2**32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_movie(payload: bytes) -> bytes:
    """A container with ``payload``, a positive multiple of ``FRAME`` bytes, as its only track."""
    n = len(payload) // FRAME
    if not n or n * FRAME != len(payload):
        raise ValueError("the payload is not a positive number of whole frames")
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    mdat = _box(b"mdat", payload)
    first = len(ftyp) + len(mdat) - len(payload)
    chunks = first + np.arange(0, n, FRAMES_PER_CHUNK, dtype=np.int64) * FRAME
    rest = n % FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] if n >= FRAMES_PER_CHUNK else []
    if rest:
        runs.append((len(chunks), rest, 1))
    keys = np.arange(1, n + 1, KEY_EVERY)
    wide = int(chunks[-1]) >= 2**32
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32),
        struct.pack(">Hh", 8, -1),
    )
    stbl = _box(
        b"stbl",
        _full(b"stsd", 0, struct.pack(">I", 1), entry),
        _full(b"stts", 0, struct.pack(">III", 1, n, 1)),
        _full(b"stss", 0, struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        _full(b"stsc", 0, struct.pack(">I", len(runs)), np.array(runs, ">u4").tobytes()),
        _full(b"stsz", 0, struct.pack(">II", FRAME, n)),
        _full(b"co64" if wide else b"stco", 0, struct.pack(">I", len(chunks)), chunks.astype(">u8" if wide else ">u4").tobytes()),
    )
    minf = _box(
        b"minf", _full(b"vmhd", 1, bytes(8)), _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1))), stbl
    )
    mdia = _box(
        b"mdia",
        _full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)),
        _full(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"frames\0"),
        minf,
    )
    tkhd = _full(
        b"tkhd", 3, struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">4H", 0, 0, 0, 0), _MATRIX,
        struct.pack(">II", SIDE << 16, SIDE << 16),
    )
    mvhd = _full(
        b"mvhd", 0, struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2)
    )
    return ftyp + mdat + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def walk(data: memoryview, start: int = 0, stop: int | None = None, path: tuple = ()):
    """``(path, first byte, one past the last)`` of the body of every box, outer ones first."""
    stop = len(data) if stop is None else stop
    while start + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        end = stop if size == 0 else start + size
        if end > stop or end < body:
            raise ValueError(f"the box {kind!r} at {start} does not fit")
        yield (*path, kind), body, end
        if kind in CONTAINERS:
            yield from walk(data, body, end, (*path, kind))
        start = end


def _table(data, at: int, dtype: str, width: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + 4)
    return np.frombuffer(data, dtype, n * width, at + 8).astype(np.int64).reshape(n, width)


#: The boxes that a track with samples must have.
NEEDED = (b"stsd", b"stts", b"stsc", b"stsz", b"mdhd")


def read_tracks(data: bytes) -> list[dict]:
    """Codec, duration, sample and key-frame byte ranges of each track, in the container's order.

    Keys: ``handler, codec, timescale, duration, n_samples, starts, sizes, keys``
    (``starts`` and ``sizes`` by sample; ``keys`` are sample indices from 0;
    without a ``stss`` box all samples are key frames). What does not fit the
    format, and movie fragments, whose samples have no such tables, is a ValueError.
    """
    view, held = memoryview(data), []
    try:
        for path, a, _ in walk(view):
            if path[-1] == b"trak":
                held.append({})
            elif path[-1] == b"moof":
                raise ValueError("the container has movie fragments")
            elif b"trak" in path:
                held[-1].setdefault(path[-1], a)
        return [_track(view, boxes) for boxes in held]
    except (struct.error, IndexError) as e:
        raise ValueError(f"a box ends too early: {e}") from e


def _track(view: memoryview, held: dict[bytes, int]) -> dict:
    lacking = [k for k in NEEDED if k not in held] or ([b"stco"] if not held.keys() & {b"stco", b"co64"} else [])
    if lacking:
        raise ValueError(f"a track has no box {lacking[0].decode()!r}")
    (uniform, n) = struct.unpack_from(">II", view, held[b"stsz"] + 4)
    wide = b"co64" in held
    chunks = _table(view, held[b"co64" if wide else b"stco"], ">u8" if wide else ">u4")[:, 0]
    runs = _table(view, held[b"stsc"], ">u4", 3)
    if n > len(view):
        raise ValueError(f"{n} samples in {len(view)} bytes")
    sizes = np.full(n, uniform, np.int64) if uniform else np.frombuffer(view, ">u4", n, held[b"stsz"] + 12).astype(np.int64)
    length = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if (length < 0).any() or (runs[:, 1] > len(view)).any():
        raise ValueError("the chunk table is out of order")
    per_chunk = np.repeat(runs[:, 1], length)
    if per_chunk.sum() < n:
        raise ValueError("the chunks hold fewer samples than there are")
    chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)[:n]
    before = np.cumsum(sizes) - sizes
    opens = np.cumsum(per_chunk) - per_chunk
    starts = chunks[chunk] + before - before[np.minimum(opens[chunk], max(n - 1, 0))] if n else np.zeros(0, np.int64)
    stts = _table(view, held[b"stts"], ">u4", 2)
    long = view[held[b"mdhd"]] == 1
    (timescale,) = struct.unpack_from(">I", view, held[b"mdhd"] + (20 if long else 12))
    keys = _table(view, held[b"stss"], ">u4")[:, 0] - 1 if b"stss" in held else np.arange(n)
    if ((keys < 0) | (keys >= n)).any() or (starts < 0).any() or (starts + sizes > len(view)).any() or not timescale:
        raise ValueError("a table points outside the container")
    return {
        "handler": bytes(view[held[b"hdlr"] + 8 : held[b"hdlr"] + 12]).decode("latin-1") if b"hdlr" in held else None,
        "codec": bytes(view[held[b"stsd"] + 12 : held[b"stsd"] + 16]).decode("latin-1").strip(),
        "timescale": timescale, "duration": int((stts[:, 0] * stts[:, 1]).sum()), "n_samples": n,
        "starts": starts, "sizes": sizes, "keys": keys,
    }


def read_track(data: bytes) -> dict:
    """The first track of pictures, or else the first one."""
    tracks = read_tracks(data)
    if not tracks:
        raise ValueError("the container has no track")
    return next((t for t in tracks if t["handler"] == "vide"), tracks[0])


def payload_of(data: bytes, track: dict) -> bytes:
    """The bytes of all samples in order; adjoining ones are taken in one piece."""
    starts, ends = track["starts"], track["starts"] + track["sizes"]
    if not len(starts):
        return b""
    cut = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    view = memoryview(data)
    return b"".join(view[a:b] for a, b in zip(starts[np.append(0, cut)], ends[np.append(cut - 1, len(ends) - 1)], strict=True))


def feature_of(track: dict) -> str:
    """Codec, duration, samples, key frames, and a digest of the key frames' byte ranges."""
    keys = track["keys"]
    ranges = np.stack([track["starts"][keys], track["sizes"][keys]], 1).astype("<i8").tobytes()
    return f"{track['codec']};{track['duration']}/{track['timescale']};{track['n_samples']};{len(keys)};{zlib.crc32(ranges):08x}"


def _stored(batches):
    """``doc_id, n_bytes, media`` from ``doc_id, text``, a bounded amount of text at a time."""
    for rows, data, offsets in blocks(batches):
        text = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [rows.column(rows.schema.get_field_index("doc_id")), pa.array(map(len, text), pa.int64()),
             pa.array([write_movie(frames_of(x)) for x in text], pa.binary())],
            ["doc_id", "n_bytes", "media"],
        )


MEDIA_SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, codec string, duration_s double, key_ranges array<struct<start:long,length:long>>, error string"
)
_NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "key_ranges", "error"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
          pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string()]


def _probed(n_bytes: int | None, data: bytes | None) -> tuple:
    if data is None:
        return (n_bytes, *[None] * 10)
    digest = hashlib.sha256(data).hexdigest()
    try:
        track = read_track(data)
    except ValueError as e:
        return (n_bytes, None, None, None, len(data), digest, None, None, None, None, str(e))
    payload, keys = payload_of(data, track), track["keys"]
    ranges = [{"start": a, "length": b} for a, b in zip(track["starts"][keys].tolist(), track["sizes"][keys].tolist(), strict=True)]
    return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), digest, feature_of(track), track["codec"],
            track["duration"] / track["timescale"], ranges, None)


def _read(batches):
    for rows in batches:
        column = lambda name: rows.column(rows.schema.get_field_index(name))  # noqa: B023, E731
        found = [_probed(n, x) for n, x in zip(column("n_bytes").to_pylist(), column("media").to_pylist(), strict=True)]
        values = zip(*found, strict=True) if found else [[]] * len(_TYPES)
        yield pa.RecordBatch.from_arrays([column("doc_id"), *[pa.array(v, t) for v, t in zip(values, _TYPES, strict=True)]], ["doc_id", *_NAMES])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text stored as a container.

    A null or empty text becomes one frame of padding; a text of any length is
    stored whole. Equal texts give equal containers, and repeated rows each
    their own. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), _stored,
                     f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, media binary")


def probe(media: DataFrame) -> DataFrame:
    """What the containers of ``media_column``, or others in its columns, hold, by their boxes.

    A null container gives nulls. One that cannot be read gives its size and
    digest, and in ``error`` what is wrong with it.
    """
    return map_arrow(media.select("doc_id", "n_bytes", "media"), _read, f"doc_id {dict(media.dtypes)['doc_id']}, {MEDIA_SCHEMA}")


def stored_and_probed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``probe`` of ``media_column``, in one pass: the containers stay in the worker that wrote them."""
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), lambda batches: _read(_stored(batches)),
                     f"doc_id {dict(docs.dtypes)[id_col]}, {MEDIA_SCHEMA}")
