"""A value that an expression uses many times, computed once per row.

Spark computes what stands inside a lambda again for every element of the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value); inside, the value is a variable of the row."""
    return F.transform(F.array(value), use)[0]
