"""Repeatable pseudo-random numbers from row identity.

They depend on the row's own values and a seed, not on partitioning or on which
attempt of a task runs, so a lost executor cannot change a result."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed, *parts) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def uniform(seed, *parts) -> Column:
    """In [0, 1), from 52 bits."""
    return F.conv(F.substring(digest(seed, *parts), 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def normal(seed, *parts) -> Column:
    """Standard normal by the Box-Muller rule."""
    u, v = uniform(f"{seed}a", *parts), uniform(f"{seed}b", *parts)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * pi * v)
