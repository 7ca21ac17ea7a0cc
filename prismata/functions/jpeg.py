"""Baseline JPEG encoding in numpy, with Huffman codes made for each image.

Colours become brightness and two colour differences, 8 x 8 blocks are
transformed by cosines and divided by the quantisation table of the quality, and
coefficients go out in zig-zag order as runs of zeros and values. All symbols of
an image are made at once as arrays, and its code tables from their counts.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: The quantisation tables of the standard's annex, for brightness and for colour, in rows.
BRIGHTNESS = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
COLOUR = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]
#: The longest code, and a symbol beyond all bytes that takes the code of ones, which no other may have.
LONGEST, NO_SYMBOL = 16, 256

_k = np.arange(8)
_COSINES = np.sqrt(np.where(_k[:, None] == 0, 1 / 8, 2 / 8)) * np.cos((2 * _k[None] + 1) * _k[:, None] * np.pi / 16)
#: Diagonals of the block in turn, every second one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def quantisation(quality: int) -> tuple[np.ndarray, np.ndarray]:
    """Both tables for a quality from 1 to 100."""
    if not 1 <= quality <= 100:
        raise ValueError(f"a quality of {quality}")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return tuple(np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (BRIGHTNESS, COLOUR))


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of a Huffman code of at most ``LONGEST`` bits, without the code of ones only."""
    counts = dict(counts)
    while True:
        heap = [(0.0, NO_SYMBOL, [NO_SYMBOL])] + [(float(n), s, [s]) for s, n in counts.items()]
        heapq.heapify(heap)
        lengths = dict.fromkeys([NO_SYMBOL, *counts], 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths.values()) <= LONGEST:
            del lengths[NO_SYMBOL]
            return lengths
        counts = {s: n // 2 + 1 for s, n in counts.items()}


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length by symbol, and the table as a file has it: how many codes of each length, and their symbols."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, held, size = 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    for i, s in enumerate(order):
        if i:
            code = (code + 1) << (lengths[s] - lengths[order[i - 1]])
        held[s], size[s] = code, lengths[s]
    numbers = [sum(n == k for n in lengths.values()) for k in range(1, LONGEST + 1)]
    return held, size, bytes(numbers) + bytes(order)


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the absolute values."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The value's bits after its symbol; negative ones are one less than their last bits."""
    return np.where(v < 0, v + (np.int64(1) << size) - 1, v)


def _blocks(plane: np.ndarray) -> np.ndarray:
    """8 x 8 blocks ``rows, columns, 8, 8`` of a plane."""
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)


def _coefficients(blocks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients in zig-zag order."""
    c = _COSINES @ (blocks - 128.0) @ _COSINES.T
    return np.rint(c.reshape(*blocks.shape[:-2], 64) / table)[..., ZIGZAG].astype(np.int64)


def _packed(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Numbers of so many bits each, one after another, filled up with ones; a zero byte after each byte of ones."""
    total = int(lengths.sum())
    owner = np.repeat(np.arange(len(values)), lengths)
    within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bits = (values[owner] >> (lengths[owner] - 1 - within)) & 1
    data = np.packbits(np.concatenate([bits, np.ones(-total % 8, np.int64)]).astype(np.uint8))
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def encoded(x: np.ndarray, quality: int = 95, halved_colour: bool = True) -> bytes:
    """An image ``h w c`` of bytes with one or three channels as a JPEG file.

    With ``halved_colour`` the colour differences have half the height and width.
    """
    h, w, channels = x.shape
    if channels not in (1, 3) or not (0 < h < 65536 and 0 < w < 65536):
        raise ValueError(f"an image of {h} x {w} with {channels} channels")
    tables = quantisation(quality)
    unit = 16 if channels == 3 and halved_colour else 8
    padded = np.pad(x.astype(np.float64), ((0, -h % unit), (0, -w % unit), (0, 0)), "edge")
    if channels == 1:
        planes = [padded[..., 0]]
    else:
        r, g, b = np.moveaxis(padded, 2, 0)
        bright = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [bright, 128 + (b - bright) / 1.772, 128 + (r - bright) / 1.402]
        if halved_colour:
            planes[1:] = [p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3)) for p in planes[1:]]

    coefficients, kinds = [], []
    for k, p in enumerate(planes):
        c = _coefficients(_blocks(p), tables[min(k, 1)])
        n = unit // 8 if k == 0 else 1
        rows, columns = c.shape[0] // n, c.shape[1] // n
        c = c.reshape(rows, n, columns, n, 64).swapaxes(1, 2).reshape(rows * columns, n * n, 64)
        flat = c.reshape(-1, 64)
        flat[:, 0] = np.diff(flat[:, 0], prepend=0)
        coefficients.append(c)
        kinds.append(np.full(c.shape[:2], min(k, 1)))
    blocks, kind = np.concatenate(coefficients, 1).reshape(-1, 64), np.concatenate(kinds, 1).ravel()

    # symbols: where they stand (block, place, part), which they are, and the bits after them
    n = len(blocks)
    first = _size(blocks[:, 0])
    r, c = np.nonzero(blocks[:, 1:])
    before = np.where(np.concatenate([[True], r[1:] != r[:-1]]), -1, np.concatenate([[0], c[:-1]])) if len(r) else c
    runs, v = c - before - 1, blocks[r, c + 1]
    size = _size(v)
    long = np.repeat(np.arange(len(r)), runs // 16)  # runs of sixteen zeros
    last = np.zeros(n, np.int64)
    last[r] = c + 1  # the greatest comes last
    short = np.flatnonzero(last < 63)  # an end of block
    parts = [  # block, place, symbol, bits after it, their number
        (np.arange(n), np.zeros(n, np.int64), first, _extra(blocks[:, 0], first), first),
        (r[long], 2 * c[long] + 1, np.full(len(long), 0xF0), np.zeros(len(long), np.int64), np.zeros(len(long), np.int64)),
        (r, 2 * c + 2, (runs % 16 << 4) | size, _extra(v, size), size),
        (short, np.full(len(short), 1000), np.zeros(len(short), np.int64), np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)),
    ]
    block, place, symbol, extra, bits = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((place, block))
    block, place, symbol, extra, bits = (p[order] for p in (block, place, symbol, extra, bits))
    which = 2 * kind[block] + (place > 0)
    code, length, listed = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), {}
    for t in range(4 if channels == 3 else 2):
        own = which == t
        found, counts = np.unique(symbol[own], return_counts=True)
        held, sizes, table = _codes(code_lengths(dict(zip(found.tolist(), counts.tolist(), strict=True))) if len(found) else {0: 1})
        code[own], length[own], listed[t] = held[symbol[own]], sizes[symbol[own]], table
    data = _packed((code << bits) | extra, length + bits)

    def segment(mark: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body

    tables_used = tables[: 2 if channels == 3 else 1]
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
    out += b"".join(segment(0xDB, bytes([k]) + bytes(t[ZIGZAG].tolist())) for k, t in enumerate(tables_used))
    frame = [bytes([k + 1, (unit // 8) * 17 if k == 0 else 17, min(k, 1)]) for k in range(channels)]
    out += segment(0xC0, struct.pack(">BHHB", 8, h, w, channels) + b"".join(frame))
    out += b"".join(segment(0xC4, bytes([(t % 2) * 16 + t // 2]) + table) for t, table in listed.items())
    out += segment(0xDA, bytes([channels]) + b"".join(bytes([k + 1, min(k, 1) * 17]) for k in range(channels)) + b"\x00\x3f\x00")
    return out + data + b"\xff\xd9"
