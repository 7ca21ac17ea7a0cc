"""Images as flat arrays ``h w c``: flips, crops, pads and structural similarity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Side of the window of structural similarity, and its two constants.
WINDOW, K1, K2 = 7, 0.01, 0.03


def flipped(v: Column, height: int, width: int, channels: int = 1) -> Column:
    """Each row of pixels in reverse."""
    row = width * channels
    source = F.transform(F.sequence(F.lit(0), F.lit(height * row - 1)), lambda k: (F.floor(k / row) * row + (width - 1 - F.floor(k % row / channels)) * channels + k % channels).cast("int"))
    return F.transform(source, lambda k: F.get(v, k))


def cropped(v: Column, width: Column | int, top: Column, left: Column, side: int) -> Column:
    """The square of ``side`` whose corner is ``top, left``, of an image of one channel."""
    cells = F.sequence(F.lit(0), F.lit(side * side - 1))
    return F.transform(cells, lambda k: F.get(v, ((top + F.floor(k / side)) * width + left + k % side).cast("int")))


def pasted(v: Column, height: int, width: int, top: Column, left: Column, side: int, fill: float = 0.0) -> Column:
    """The image of one channel on a square of ``fill``, its corner at ``top, left``; what lies beyond is cut."""
    cells = F.sequence(F.lit(0), F.lit(side * side - 1))

    def cell(k: Column) -> Column:
        i, j = F.floor(k / side) - top, k % side - left
        inside = (i >= 0) & (i < height) & (j >= 0) & (j < width)
        return F.when(inside, F.get(v, (i * width + j).cast("int"))).otherwise(F.lit(fill))

    return F.transform(cells, cell)


def cubic_taps(size: int, new: int, a: float = -0.75) -> tuple[list[list[int]], list[list[float]]]:
    """For each place of the new size, the four places it is made of, cut to the old size, and their weights.

    Cubic convolution with parameter ``a``, about pixel centres, without
    smoothing where the image shrinks.
    """
    def weight(d: float) -> float:
        if d <= 1:
            return ((a + 2) * d - (a + 3)) * d * d + 1
        return (((d - 5) * d + 8) * d - 4) * a if d < 2 else 0.0

    at = [(k + 0.5) * size / new - 0.5 for k in range(new)]
    low = [math.floor(x) - 1 for x in at]
    return ([[min(size - 1, max(0, b + i)) for i in range(4)] for b in low], [[weight(abs(x - b - i)) for i in range(4)] for x, b in zip(at, low, strict=True)])


def resized(v: Column, height: int, width: int, new_height: int, new_width: int, channels: int = 1) -> Column:
    """The image at another size, by cubic interpolation of rows, then of columns."""
    def along(v: Column, taps, count: int, place, source) -> Column:
        """``count`` values, each of four of ``v``; ``place`` and ``source`` say which taps, and where these are."""
        places, weights = (F.array(*[F.array(*map(F.lit, t)) for t in side]) for side in taps)

        def value(k: Column) -> Column:
            four = F.sequence(F.lit(0), F.lit(3))
            return F.aggregate(four, F.lit(0.0), lambda s, i: s + F.get(F.get(weights, place(k)), i) * F.get(v, source(k, F.get(F.get(places, place(k)), i))))

        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), value)

    row, new_row = width * channels, new_width * channels
    tall = along(v, cubic_taps(height, new_height), new_height * row, lambda k: F.floor(k / row).cast("int"), lambda k, y: (y * row + k % row).cast("int"))
    wide = lambda t: along(t, cubic_taps(width, new_width), new_height * new_row, lambda k: F.floor(k % new_row / channels).cast("int"),
                           lambda k, x: (F.floor(k / new_row) * row + x * channels + k % channels).cast("int"))
    return F.get(F.transform(F.array(tall), wide), 0)


def resized_positions(v: Column, kept: int, grid: int, new: int, planes: int) -> Column:
    """Position embeddings of ``kept`` class tokens and a square grid: the former as they are, the grid at another size."""
    head = kept * planes
    return F.concat(F.slice(v, 1, head), resized(F.slice(v, head + 1, grid * grid * planes), grid, grid, new, new, planes))


def to_byte_wrapped(x: Column) -> Column:
    """Cut off to a whole number and wrapped to 0..255, as a cast to an unsigned byte does."""
    return F.pmod(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)), F.lit(256)).cast("int")


def ssim(height: int, width: int, channels: int = 1, data_range: float = 1.0):
    """A function of two columns of images: their mean structural similarity.

    Uniform windows that lie inside the image, variances of samples; the mean of
    each channel's mean. It works on Arrow batches, by sums over rectangles.
    """
    n = WINDOW * WINDOW
    c1, c2 = (K1 * data_range) ** 2, (K2 * data_range) ** 2
    if min(height, width) < WINDOW:
        raise ValueError(f"an image of {height} x {width} has no window of {WINDOW}")

    def sums(x):
        s = np.pad(x.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0), (0, 0)))
        return (s[:, WINDOW:, WINDOW:] - s[:, :-WINDOW, WINDOW:] - s[:, WINDOW:, :-WINDOW] + s[:, :-WINDOW, :-WINDOW]) / n

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (np.stack(s.to_numpy()).astype(np.float64).reshape(-1, height, width, channels) for s in (a, b))
        ux, uy = sums(x), sums(y)
        vx, vy, vxy = ((sums(p) - q) * n / (n - 1) for p, q in ((x * x, ux * ux), (y * y, uy * uy), (x * y, ux * uy)))
        s = (2 * ux * uy + c1) * (2 * vxy + c2) / ((ux * ux + uy * uy + c1) * (vx + vy + c2))
        return pd.Series(s.mean((1, 2)).mean(1))

    return similarity
