"""Integer geometry of resizing and cropping."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import draws as D


def _rounded(x: Column) -> Column:
    """Rounded to the nearest whole number, ties to the even one."""
    return F.rint(x).cast("long")


def to_multiple(x: Column, of: int = 32) -> Column:
    """The nearest multiple; NULL where that is 0, which no image can have."""
    n = _rounded(x / of) * of
    return F.when(n > 0, n)


def longest_side(w: Column, h: Column, side: int) -> tuple[Column, Column]:
    top = F.greatest(w, h)
    return to_multiple(w * side / top), to_multiple(h * side / top)


def megapixels(w: Column, h: Column, low: float = 0.5, high: float = 2.0, unit: int = 1_000_000) -> tuple[Column, Column]:
    mp = w * h / F.lit(float(unit))
    scale = F.when(mp < low, F.sqrt(low / mp)).when(mp > high, F.sqrt(high / mp)).otherwise(F.lit(1.0))
    return to_multiple(w * scale), to_multiple(h * scale)


def _resized(w: Column, h: Column, target: Column) -> tuple[Column, Column, Column]:
    """Halvings while the shorter side is twice the target or more, and the size after resizing that side to the target."""
    least = F.least(w, h)
    n = F.aggregate(F.sequence(F.lit(0), F.lit(30)), F.lit(0), lambda a, k: F.when(F.floor(least / F.pow(F.lit(2), a)) >= 2 * target, a + 1).otherwise(a))
    hw, hh = F.floor(w / F.pow(F.lit(2), n)), F.floor(h / F.pow(F.lit(2), n))
    scale = target / F.least(hw, hh)
    return n, _rounded(hw * scale), _rounded(hh * scale)


def random_crop(w: Column, h: Column, side: int, low: float, high: float, seed: int, *key: str) -> dict[str, Column]:
    """Drawn target size, halvings, resized size and drawn corner of a crop of ``side`` that keeps ``low`` to ``high`` of a side."""
    target = D.whole(F.lit(math.ceil(side / high)), F.lit(math.ceil(side / low)), seed, F.lit("target"), *key)
    n, rw, rh = _resized(w, h, target)
    return {"target": target, "halvings": n, "width": rw, "height": rh,
            "crop_x": D.whole(F.lit(0), rw - side, seed, F.lit("x"), *key), "crop_y": D.whole(F.lit(0), rh - side, seed, F.lit("y"), *key)}


def center_crop(w: Column, h: Column, side: int) -> dict[str, Column]:
    """Halvings, resized size and crop corner of a centre crop of ``side``."""
    n, rw, rh = _resized(w, h, F.lit(side))
    return {"halvings": n, "width": rw, "height": rh, "crop_x": F.floor((rw - side) / 2), "crop_y": F.floor((rh - side) / 2)}


def shorter_side(w: Column, h: Column, side: int) -> tuple[Column, Column]:
    least = F.least(w, h)
    return _rounded(w * side / least), _rounded(h * side / least)


def to_unit(x: Column, mean: float = 0.5, std: float = 0.5) -> Column:
    return (x / 255.0 - mean) / std


def to_byte(x: Column) -> Column:
    """Back from [-1, 1] to 0..255, clamped and cut off."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x * 0.5 + 0.5) * 255))).cast("int")
