"""Bars: from raw rows to one OHLCV row per key and day, and coarser bars.

All reductions here are ``groupBy`` aggregates whose buffers have a fixed size
(min, max, sum, min_by, max_by), so Spark combines them map-side and a key that
owns a third of the raw rows still sends one small row per task and bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("ts", T.DateType()),
    T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType())])

# number of days per bin, by time-scale name; weekly bins end on Friday
TIMESCALES = {"2d": 2, "3d": 3, "5d": 5, "weekly": "FRI"}


def timescale(name: str):
    """Bin width for a case-insensitive time-scale name."""
    try:
        return TIMESCALES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown timescale {name!r}; known: {sorted(TIMESCALES)}") from None


def bars_from_rows(rows: DataFrame, *, key: Column, ts: Column, order: Column,
                   open_: Column, high: Column, low: Column, close: Column,
                   volume: Column) -> DataFrame:
    """One bar per key and day; ``order`` ranks the rows inside the day."""
    r = rows.select(key.alias("key"), F.to_date(ts).alias("ts"), order.alias("_o"),
                    open_.alias("_op"), high.alias("_hi"), low.alias("_lo"),
                    close.alias("_cl"), volume.alias("_vo"))
    return r.groupBy("key", "ts").agg(
        F.min_by("_op", "_o").alias("open"), F.max("_hi").alias("high"),
        F.min("_lo").alias("low"), F.max_by("_cl", "_o").alias("close"),
        F.sum("_vo").cast("long").alias("volume"))


def normalise_bars(raw: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Select, rename and cast to the bar schema, with dates cut to midnight.

    Bars with a missing key, date or price, NaN included, raise when the table is
    read: the rule travels with the plan and needs no extra pass."""
    names = names or {}
    df = raw.select([
        (F.to_date(F.col(names.get(f.name, f.name))) if f.name == "ts"
         else F.col(names.get(f.name, f.name)).cast(f.dataType)).alias(f.name)
        for f in BAR_SCHEMA])
    for c in ("open", "high", "low", "close"):
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    for c in ("key", "ts", "open", "high", "low", "close"):
        df = df.withColumn(c, F.coalesce(c, F.raise_error(
            F.lit(f"bar without {c}")).cast(BAR_SCHEMA[c].dataType)))
    return df


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def _merge(df: DataFrame, by: list) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"))


def resample(bars: DataFrame, scale: str) -> DataFrame:
    """Coarser bars, labelled by the last day of their bin (right/right).

    Day bins are counted from each key's first date; weekly bins end on the
    Friday on or after the date.  Bins without a bar do not appear."""
    width = timescale(scale)
    if isinstance(width, str):
        label = F.next_day(F.date_sub("ts", 1), width)
        return _merge(bars.withColumn("_label", label), ["key", "_label"]) \
            .withColumnRenamed("_label", "ts")
    # the first date is one small row per key: a map-side combined aggregate
    first = bars.groupBy("key").agg(F.min("ts").alias("_first"))
    binned = bars.join(first, "key") \
        .withColumn("_bin", F.ceil(F.datediff("ts", "_first") / F.lit(width)).cast("int"))
    return _merge(binned, ["key", "_first", "_bin"]) \
        .withColumn("ts", F.date_add("_first", F.col("_bin") * width)) \
        .select("key", "ts", "open", "high", "low", "close", "volume")


def resample_week_start(bars: DataFrame) -> DataFrame:
    """Weekly bars labelled by their Monday (left/left)."""
    return _merge(bars.withColumn("_label", F.date_trunc("week", "ts").cast("date")),
                  ["key", "_label"]).withColumnRenamed("_label", "ts")
