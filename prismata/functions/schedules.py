"""Learning-rate and flow-matching schedules as column expressions.

Spark raises on division by zero, so each limit is a CASE of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup(epoch: Column, base: float, warm: float, after: Column) -> Column:
    return F.when(epoch < warm, epoch / warm * base).otherwise(after) if warm > 0 else after


def multi_step(epoch: Column, base: float, milestones: list[int], gamma: float, warm: float = 0) -> Column:
    passed = sum((F.when(epoch >= m, 1).otherwise(0) for m in milestones), F.lit(0))
    return warmup(epoch, base, warm, base * F.pow(F.lit(gamma), passed))


def cosine(epoch: Column, base: float, epochs: float, least: float, warm: float = 0) -> Column:
    done = (epoch - warm) / (epochs - warm)
    return warmup(epoch, base, warm, 0.5 * (base - least) * (F.cos(math.pi * done) + 1) + least)


def poly(epoch: Column, base: float, epochs: float, least: float, power: float, warm: float = 0) -> Column:
    done = (epoch - warm) / (epochs - warm)
    return warmup(epoch, base, warm, F.pow(1 - done, F.lit(power)) * (base - least) + least)


def matrix_scale(rows: Column, cols: Column) -> Column:
    """Step-size factor of a matrix parameter in an orthogonalising optimiser."""
    return 0.2 * F.sqrt(F.greatest(rows, cols).cast("double"))


def add_noise(x: Column, noise: Column, t: Column) -> Column:
    return F.zip_with(x, noise, lambda a, e: (1 - t) * a + t * e)


def velocity(x: Column, noise: Column) -> Column:
    return F.zip_with(x, noise, lambda a, e: e - a)


def loss_weight(kind: str, sigma: Column) -> Column:
    """Weights of the flow-matching loss; ``min_snr`` is NaN where the signal is 0."""
    if kind == "none":
        return F.lit(1.0)
    if kind == "inverse":
        return 1 / (sigma + 1e-6)
    snr = (1 - sigma) / (sigma + 1e-6)
    return F.when(sigma == 1, F.lit(float("nan"))).otherwise(F.least(snr, F.lit(5.0)) / F.when(sigma != 1, snr))


def logit_normal(normal: Column, mean: float = 0.0, std: float = 1.0, edge: float = 1e-5) -> Column:
    return F.greatest(F.lit(edge), F.least(F.lit(1 - edge), 1 / (1 + F.exp(-(mean + std * normal)))))


def shift_of_length(length: Column, short: float = 256, long: float = 4096, low: float = 0.5, high: float = 1.15) -> Column:
    slope = (high - low) / (long - short)
    return length * slope + (low - slope * short)


def time_shift(t: Column, mu: Column, sigma: float = 1.0) -> Column:
    inner = F.when(t > 0, F.pow(1 / F.when(t > 0, t) - 1, F.lit(sigma)))
    return F.when(t == 0, F.lit(0.0)).otherwise(F.exp(mu) / (F.exp(mu) + inner))


def static_shift(t: Column, shift: float) -> Column:
    return shift * t / (1 + (shift - 1) * t)


def guided(unconditional: Column, conditional: Column, scale: float) -> Column:
    if scale <= 1:
        return conditional
    return F.zip_with(unconditional, conditional, lambda u, c: u + scale * (c - u))


def start_index(place: Column) -> Column:
    """An aggregate: the second of several places, or the only one."""
    held = F.array_sort(F.collect_list(place))
    return F.coalesce(F.get(held, 1), F.get(held, 0))
