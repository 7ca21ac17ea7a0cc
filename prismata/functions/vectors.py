"""Column expressions over arrays of doubles.

Folds within a row keep the order of the elements, so results do not depend on
partitioning. Nothing here needs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, total(v) / F.size(v))


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    return let(F.greatest(l2_norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x / n))


def channel_normalize(v: Column, eps: float = 1e-10) -> Column:
    """Norm over the elements with ``eps`` added to the norm itself."""
    return let(l2_norm(v) + eps, lambda n: F.transform(v, lambda x: x / n))


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    return let(F.sqrt(dot(v, v) / F.size(v) + eps), lambda n: F.transform(v, lambda x: x / n))


def all_finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == INF))


def softmax(v: Column, temperature: float = 1.0) -> Column:
    def shares(e: Column) -> Column:
        return let(total(e), lambda s: F.transform(e, lambda x: x / s))

    return let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp((x - top) / temperature)), shares))


def log_softmax(v: Column, temperature: float = 1.0) -> Column:
    def shifted(z: Column) -> Column:
        return let(F.ln(total(F.transform(z, lambda x: F.exp(x)))), lambda s: F.transform(z, lambda x: x - s))

    return let(F.array_max(v), lambda top: let(F.transform(v, lambda x: (x - top) / temperature), shifted))


def silu_gate(x: Column, y: Column) -> Column:
    return x / (1 + F.exp(-x)) * y


def rotate_pair(x0: Column, x1: Column, angle: Column) -> tuple[Column, Column]:
    """A pair turned by an angle, as rotary position embeddings do."""
    return F.cos(angle) * x0 - F.sin(angle) * x1, F.sin(angle) * x0 + F.cos(angle) * x1


def rope_angle(position: Column, pair: Column, dim: int, theta: float) -> Column:
    return position * F.pow(F.lit(float(theta)), -2.0 * pair / dim)


def axis_angles(positions: tuple[Column, ...], dims: tuple[int, ...], theta: float) -> Column:
    """The angles of several axes, each with its own number of dimensions, one after another."""
    def of(position: Column, dim: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), lambda k: rope_angle(position, k, dim, theta))

    return F.concat(*map(of, positions, dims))


def modulate(x: Column, scale: Column, shift: Column) -> Column:
    return (1 + scale) * x + shift


def mse(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def psnr(error: Column, data_range: float = 1.0) -> Column:
    """Infinity, not an error, where nothing differs."""
    return F.when(error == 0, F.lit(INF)).otherwise(10 * F.log10(data_range * data_range / error))


def patch_pack(v: Column, channels: int, height: int, width: int, p: int = 2) -> Column:
    """``c (i p) (j q)`` flattened, as ``(c p q) i j`` flattened."""
    h, w = height // p, width // p
    src = [
        (c * height + i * p + a) * width + j * p + b
        for c in range(channels) for a in range(p) for b in range(p) for i in range(h) for j in range(w)
    ]
    return F.transform(F.array(*[F.lit(k) for k in src]), lambda k: F.get(v, k))


def patch_unpack(v: Column, channels: int, height: int, width: int, p: int = 2) -> Column:
    """The inverse of ``patch_pack``."""
    h, w = height // p, width // p
    src = [
        (((c * p + y % p) * p + x % p) * h + y // p) * w + x // p
        for c in range(channels) for y in range(height) for x in range(width)
    ]
    return F.transform(F.array(*[F.lit(k) for k in src]), lambda k: F.get(v, k))


def channels_first(v: Column, height: int, width: int, channels: int) -> Column:
    """``h w c`` flattened, as ``c h w`` flattened."""
    src = [(i * width + j) * channels + c for c in range(channels) for i in range(height) for j in range(width)]
    return F.transform(F.array(*[F.lit(k) for k in src]), lambda k: F.get(v, k))


def timestep_embedding(t: Column, dim: int, scale: float = 1000.0, max_period: float = 10000.0) -> Column:
    """Cosines, then sines, of ``scale * t`` at falling frequencies; a zero more where ``dim`` is odd."""
    half = dim // 2
    angles = F.transform(
        F.sequence(F.lit(0), F.lit(half - 1)), lambda k: scale * t * F.exp(-F.ln(F.lit(max_period)) * k / half)
    )
    parts = [F.transform(angles, lambda a: F.cos(a)), F.transform(angles, lambda a: F.sin(a))]
    return F.concat(*parts, *([F.array(F.lit(0.0))] if dim % 2 else []))
