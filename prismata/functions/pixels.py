"""Pixels resampled with smoothing: halved by boxes, made smaller by cubic kernels, and cropped.

Each output pixel is a weighted mean of the input pixels within the kernel's
support, which grows with the scale, so that no input pixel is skipped. Rows of
pixels are resampled first, then columns, with a rounding to bytes after each.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Parameter of the cubic kernel.
CUBIC = -0.5


def box(d: np.ndarray) -> np.ndarray:
    return ((d > -0.5) & (d <= 0.5)).astype(np.float64)


def cubic(d: np.ndarray, a: float = CUBIC) -> np.ndarray:
    d = np.abs(d)
    return np.where(d < 1, ((a + 2) * d - (a + 3)) * d * d + 1, np.where(d < 2, (((d - 5) * d + 8) * d - 4) * a, 0.0))


#: Kernels by name, with their width.
KERNELS = {"box": (box, 1), "cubic": (cubic, 4)}


@functools.lru_cache(maxsize=4096)
def taps(size: int, new: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``new`` places, where its input pixels are and their weights, which add up to 1."""
    kernel, width = KERNELS[kind]
    place = (2 * np.arange(new)[:, None] + 1) * size  # of each centre, in halves of 1 / new of a pixel
    reach = width * max(size, new)
    first = np.maximum((place - reach + new) // (2 * new), 0)
    last = np.minimum((place + reach + new) // (2 * new), size)
    at = first + np.arange((last - first).max())
    # whole numbers up to the division, so that what lies on an edge of the kernel is not a matter of rounding
    weight = np.where(at < last, kernel(((2 * at + 1) * new - place) / (2 * max(size, new))), 0.0)
    return np.minimum(at, size - 1), weight / weight.sum(1, keepdims=True)


def _along(x: np.ndarray, new: int, kind: str) -> np.ndarray:
    """The first axis resampled, in bytes."""
    at, weight = taps(len(x), new, kind)
    out = np.zeros((new, *x.shape[1:]))
    for k in range(at.shape[1]):
        out += weight[:, k].reshape(-1, *[1] * (x.ndim - 1)) * x[at[:, k]]
    # nine digits first, so that halves don't depend on the order of the additions
    return np.floor(np.clip(np.round(out, 9), 0, 255) + 0.5).clip(0, 255).astype(np.uint8)


def resampled(x: np.ndarray, height: int, width: int, kind: str = "cubic") -> np.ndarray:
    """An image ``h w c`` of bytes at another size."""
    wide = np.swapaxes(_along(np.swapaxes(x, 0, 1), width, kind), 0, 1) if width != x.shape[1] else x
    return _along(wide, height, kind) if height != x.shape[0] else wide


def shrunk(x: np.ndarray, target: int) -> np.ndarray:
    """Halved by boxes while the shorter side is twice the target or more, then resampled so that this side is the target."""
    while min(x.shape[:2]) >= 2 * target:
        x = resampled(x, x.shape[0] // 2, x.shape[1] // 2, "box")
    scale = target / min(x.shape[:2])
    return resampled(x, round(x.shape[0] * scale), round(x.shape[1] * scale))


def image(pixels, height: int, width: int) -> np.ndarray:
    return np.asarray(pixels, np.uint8).reshape(height, width, -1)


@F.pandas_udf(ArrayType(IntegerType()))
def _shrunk_crop(height: pd.Series, width: pd.Series, pixels: pd.Series, target: pd.Series, top: pd.Series, left: pd.Series, side: pd.Series) -> pd.Series:
    out = []
    for h, w, v, t, y, x, s in zip(height, width, pixels, target, top, left, side, strict=True):
        if v is None or any(k is None or k != k for k in (h, w, t, y, x)):
            out.append(None)
            continue
        small = shrunk(image(v, int(h), int(w)), int(t))
        y, x, s = int(y), int(x), int(s)
        if min(y, x) < 0 or y + s > small.shape[0] or x + s > small.shape[1]:
            raise ValueError(f"a crop of {s} at {y}, {x} of an image of {small.shape[0]} x {small.shape[1]}")
        out.append(small[y : y + s, x : x + s].ravel().astype(np.int32))
    return pd.Series(out, dtype="object")


def shrunk_crop(height: Column, width: Column, pixels: Column, target: Column, top: Column, left: Column, side: int) -> Column:
    """The square of ``side`` at ``top, left`` of the image ``h w c`` shrunk to a shorter side of ``target``; null where anything is null.

    A corner from which the square does not fit is an error.
    """
    return _shrunk_crop(height, width, pixels, target, top, left, F.lit(side))


@F.pandas_udf(ArrayType(IntegerType()))
def _resized(height: pd.Series, width: pd.Series, pixels: pd.Series, new_height: pd.Series, new_width: pd.Series) -> pd.Series:
    out = []
    for h, w, v, nh, nw in zip(height, width, pixels, new_height, new_width, strict=True):
        bad = v is None or any(k is None or k != k for k in (h, w, nh, nw))
        out.append(None if bad else resampled(image(v, int(h), int(w)), int(nh), int(nw)).ravel().astype(np.int32))
    return pd.Series(out, dtype="object")


def resized(height: Column, width: Column, pixels: Column, new_height: Column, new_width: Column) -> Column:
    """The image ``h w c`` of bytes at another size, of each row its own, by cubic kernels; null where anything is null."""
    return _resized(height, width, pixels, new_height, new_width)
