"""Column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low, high) -> Column:
    """Limit ``x`` to [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as double, NULL where ``b`` is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def percent_text(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def order_hash(seed: int, key: Column) -> Column:
    """A pseudo-random order key, the same on every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}_"), key.cast("string")))


def hash_uniform(seed: int, *parts: Column) -> Column:
    """A reproducible number in [0, 1): the first 52 bits of an md5."""
    text = F.concat(F.lit(f"{seed}"), *[p for part in parts for p in (F.lit("_"), part.cast("string"))])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return bits / float(1 << 52)


def yeo_johnson(x: Column, lam: float) -> Column:
    """Yeo-Johnson transform of ``x`` for a fixed exponent."""
    x = x.cast("double")
    if abs(lam) < 1e-12:
        upper = F.log1p(x)
    else:
        upper = (F.pow(x + 1, F.lit(lam)) - 1) / lam
    if abs(lam - 2) < 1e-12:
        lower = -F.log1p(-x)
    else:
        lower = -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, upper).when(x < 0, lower)
