"""Alignment and joins of keyed series, and small reshaping helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import frames as W
from tickloom.operators.bars import resample_week_start

# A table is broadcast only after a count has shown that it has at most this
# many rows; anything larger takes a shuffle join.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when it is proven to hold at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def align_second_series(df: DataFrame, second: DataFrame) -> DataFrame:
    """Left join of ``(ts, vix)`` or ``(key, ts, vix)`` by exact date.

    An unkeyed series has one row per calendar day after the grouping below, so
    its size is bounded by the calendar; Spark still chooses the join by its
    own size estimate, and no hint forces a broadcast."""
    on = ["key", "ts"] if "key" in second.columns else ["ts"]
    one = second.groupBy(*on).agg(F.max("vix").alias("vix"))
    return df.join(one, on, "left")


def weekly_to_daily(bars: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Bring weekly columns down to days with a delay of one week.

    Weekly values are shifted by one week, matched to the day that equals the
    week's Monday label, and left null elsewhere; ``ffill`` then carries the last
    matched value on.  A week whose Monday has no bar therefore never matches."""
    from tickloom.plans.registry import build

    # one exchange by key for the weeks, the match and the windows that follow: a join by key
    # and day would deal the days out by both, and the windows by key again
    days = bars.repartition("key")
    weeks = build(resample_week_start(days), sorted(set(wanted.values())))
    late = weeks.select("key", "ts", F.struct(F.col("ts").alias("_week"), *[W.lag(src).alias(name) for name, src in wanted.items()]).alias("_late"))
    late = late.filter(F.col("key").isNotNull() & F.col("ts").isNotNull()).withColumn("_day", F.lit(False))
    both = days.withColumns({"_late": F.lit(None).cast(late.schema["_late"].dataType), "_day": F.lit(True)}).unionByName(late, allowMissingColumns=True)
    # the latest week that has begun; the day takes it if it is the week's Monday
    last = F.last("_late", ignorenulls=True).over(Window.partitionBy("key").orderBy("ts", "_day").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_late", last).filter("_day")
    return both.select(*bars.columns, *[F.when(F.col("_late._week") == F.col("ts"), F.col("_late")[name]).alias(name) for name in wanted])


def asof_weekly_to_daily(bars: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The as-of variant: every day sees the week before its own."""
    from tickloom.plans.registry import build

    weeks = build(resample_week_start(bars), sorted(set(wanted.values())))
    late = weeks.select("key", F.col("ts").alias("_week"),
                        *[W.lag(src).alias(name) for name, src in wanted.items()])
    return bars.withColumn("_week", F.date_trunc("week", "ts").cast("date")) \
        .join(late, ["key", "_week"], "left").drop("_week")


def assert_unique(df: DataFrame, on: list[str], what: str = "table") -> DataFrame:
    """The same rows, or an error when a join key repeats."""
    dup = df.groupBy(*on).count().filter("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"{what} has duplicate {', '.join(on)}: {dup[0].asDict()}")
    return df


def duplicate_keys(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def overlap(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Join keys that both tables hold."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_semi")


def assert_overlap(left: DataFrame, right: DataFrame, on: list[str]) -> None:
    if left.join(right, on, "left_semi").isEmpty():
        raise ValueError("the two tables have no common " + ", ".join(on))


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str],
                    check: bool = True) -> DataFrame:
    """Inner join that refuses duplicate keys and an empty overlap."""
    if check:
        assert_unique(left, on, "left table")
        assert_unique(right, on, "right table")
        assert_overlap(left, right, on)
    return left.join(right, on, "inner")


def drop_incomplete(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns is not None else None)


def fill_gaps(df: DataFrame, columns: list[str], back: bool = False) -> DataFrame:
    """Forward fill per key; ``back`` then fills the head with later values."""
    df = df.withColumns({c: W.ffill(c) for c in columns})
    return df.withColumns({c: W.bfill(c) for c in columns}) if back else df


def pivot_first(df: DataFrame, index: list[str], column: str, names: list, value: str) -> DataFrame:
    """One column per listed name; the names are given, so no pass finds them."""
    return df.groupBy(*index).pivot(column, names).agg(F.first(value, ignorenulls=True))


def pivot_count(df: DataFrame, index: list[str], column: str, names: list) -> DataFrame:
    return df.groupBy(*index).pivot(column, names).agg(F.count(F.lit(1))).fillna(0)


def panel(bars: DataFrame, use_returns: bool = True, exogenous: Iterable[str] = (),
          start: Column | None = None, end: Column | None = None,
          threshold: float = 0.01) -> DataFrame:
    """``unique_id, ds, y`` and whether the next day's high gains ``threshold``.

    The first row of a key has no return and the last no next day; both go."""
    df = bars.select("*", W.lag("close").alias("_prev"), W.lead("high").alias("next_high"))
    y = (W.ratio("close", "_prev") - 1) if use_returns else F.col("close")
    df = df.filter(F.col("_prev").isNotNull() & F.col("next_high").isNotNull())
    out = df.select(F.col("key").alias("unique_id"), F.col("ts").alias("ds"), y.alias("y"),
                    (F.col("next_high") >= F.col("close") * (1 + threshold)).cast("int")
                    .alias("threshold_target"), *exogenous)
    if start is not None:
        out = out.filter(F.col("ds") >= start)
    if end is not None:
        out = out.filter(F.col("ds") < end)
    return out


def union_rows(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
