"""Random draws that depend on a seed and a row's key alone.

``rand`` depends on how rows are dealt out; a draw here is a digest of seed and
key, so it is the same on any cluster, after any repartitioning and after the
loss of an executor, and SQL can compute it too.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that make a draw: 52 bits, as a double holds.
DIGITS = 13
#: Rounds of a permutation.
ROUNDS = 24


def uniform(seed: int, *key: Column | str) -> Column:
    """From 0 up to, but without, 1."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint") / F.lit(float(16**DIGITS))


def whole(low: Column, high: Column, seed: int, *key: Column | str) -> Column:
    """A whole number from ``low`` to ``high``, both included."""
    return (low + F.floor(uniform(seed, *key) * (high - low + 1))).cast("long")


def normal(seed: int, *key: Column | str) -> Column:
    """Of mean 0 and variance 1, from two uniform draws."""
    radius = F.sqrt(-2 * F.ln(1 - uniform(seed, F.lit("r"), *key)))
    return radius * F.cos(2 * math.pi * uniform(seed, F.lit("a"), *key))


def permuted(n: Column, total: int, seed: int, *key: int | str) -> Column:
    """The place of ``n`` in a permutation of the numbers below ``total``, by seed and key.

    Each round pairs every number with another, by a sum drawn for the round, and
    a bit drawn for the pair says whether the two change places. So the whole is
    one to one for any ``total``, no row needs any other, and nothing is sorted.
    """
    name = ":".join(map(str, (seed, *key)))
    sums = [int(hashlib.md5(f"{name}:{i}".encode()).hexdigest()[:DIGITS], 16) % total for i in range(ROUNDS)] if total else []
    if not sums:
        return n.cast("long")
    rounds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).cast("long").alias("k")) for i, k in enumerate(sums)])

    def swapped(x: Column, r: Column) -> Column:
        other = F.pmod(r["k"] - x, F.lit(total).cast("long"))
        digest = F.md5(F.concat_ws(":", F.lit(name), r["i"].cast("string"), F.greatest(x, other).cast("string")))
        return F.when(F.substring(digest, 1, 1) >= "8", other).otherwise(x)

    return F.aggregate(rounds, n.cast("long"), swapped)
