"""Repeatable draws: uniform numbers from the md5 of seed, key and purpose.

The same key always gets the same number, whatever the partitions, and SQL engines
with md5 get it too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, purpose: str, *key: Column | str) -> Column:
    """In [0, 1)."""
    parts = [F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key], F.lit(purpose)]
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def whole(u: Column, low: int | Column, high: int | Column) -> Column:
    """Whole number between ``low`` and ``high``, both possible."""
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return (low + F.floor(u * (high - low + 1).cast("double"))).cast("int")


def real(u: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + u * F.lit(float(high) - float(low))


def happens(u: Column, probability: float) -> Column:
    """True with the probability given."""
    return u < F.lit(float(probability))


def normal(u1: Column, u2: Column, std: Column | float = 1.0) -> Column:
    """Box-Muller from two uniform numbers."""
    std = F.lit(float(std)) if isinstance(std, (int, float)) else std
    return F.sqrt(-2 * F.log(1 - u1)) * F.cos(F.lit(2 * math.pi) * u2) * std
