"""Ranks and exact quantiles inside groups of any size.

A window over a whole group would put a hot group into one task.  Here equal values are
folded first, then one range-partitioned sort spreads the values of all groups over all
tasks, and running totals (functions/totals.py) give every value the number of rows
before it.  NaN is the largest value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.totals import running_totals


def value_ranks(df: DataFrame, by: list[str], value: str, count: str | None = None) -> DataFrame:
    """Per distinct value of a group: ``n`` rows, ``below`` rows with a smaller
    value, ``total`` rows of the group.  Null values are left out.  ``count`` names a
    column with the number of rows that a row stands for."""
    rows = F.sum(count) if count else F.count(F.lit(1))
    vals = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(rows.alias("n"))
    ranked = running_totals(vals, by, [F.col(value)], {"below": F.col("n")})
    # a row per group, from the totals after each value
    whole = ranked.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.max(F.col("below") + F.col("n")).alias("total"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return ranked.join(whole, same).select(*by, value, "n", "below", "total")


def row_positions(df: DataFrame, by: list[str], value: str, tie: str, name: str = "position") -> DataFrame:
    """1-based position of every row by (value, tie); ``tie`` differs between rows of
    equal value."""
    return running_totals(df, by, [F.col(value), F.col(tie)], {name: F.lit(1)}).withColumn(name, F.col(name) + 1)


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, with count, min and max."""
    r = value_ranks(df, by, value)
    aggs = [F.max("total").alias("n_values")]
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
    out = r.groupBy(*by).agg(*aggs)
    for name, p in probs.items():
        h = (F.col("n_values") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out = out.withColumn(name, lo + (hi - lo) * (h - F.floor(h)))
    return out.select(*by, "n_values", *probs)
