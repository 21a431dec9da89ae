"""Views of the given tables that the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.bars import bars_from_rows


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def daily_bars(spark: SparkSession, sf: str, key: str = "l_suppkey") -> DataFrame:
    """Bars of a lineitem key.  The list price is 100 + sqrt(price per unit); a
    line opens at it and closes after discount and tax."""
    rows = table(spark, sf, "lineitem")
    listed = F.lit(100.0) + F.sqrt(F.col("l_extendedprice") / F.col("l_quantity"))
    paid = listed * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return bars_from_rows(
        rows, key=F.col(key), ts=F.col("l_shipdate"), order=order, open_=listed,
        high=F.greatest(listed, paid), low=F.least(listed, paid), close=paid,
        volume=F.col("l_quantity"))


def second_series(spark: SparkSession, sf: str) -> DataFrame:
    """``(ts, vix)``: mean order value of a day."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("ts")).agg(
        (F.avg("o_totalprice") / 12500).alias("vix"))


def index_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Volatility-index bars, one series per order priority."""
    o = table(spark, sf, "orders")
    v = F.col("o_totalprice") / 12500
    return o.groupBy(F.col("o_orderpriority").alias("key"),
                     F.to_date("o_orderdate").alias("ts")).agg(
        F.min_by(v, "o_orderkey").alias("open"), F.max(v).alias("high"), F.min(v).alias("low"),
        F.avg(v).alias("close"), F.count(F.lit(1)).alias("volume"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, whole numbers to long, dates to text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif kind in ("int", "smallint", "tinyint", "bigint"):
            c = c.cast("long")
        elif kind == "date":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``run_id, sample_id, prob, label, actual_return``: every line is one
    prediction of "returned"; seven runs of uneven size."""
    li = table(spark, sf, "lineitem")
    h = ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31) % 997) / 996.0
    label = (F.col("l_returnflag") == "R").cast("int")
    return li.select(
        F.concat(F.lit("run_"), F.col("l_linenumber").cast("string")).alias("run_id"),
        F.col("l_orderkey").alias("sample_id"),
        F.round(0.05 + 0.7 * h + 0.2 * label, 3).alias("prob"), label.alias("label"),
        (F.col("l_tax") - F.col("l_discount")).alias("actual_return"))


def quality_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents scored by their length, against their quality label."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    n = F.col("n_chars")
    return d.select(F.lit("length").alias("run_id"), F.col("doc_id").alias("sample_id"),
                    F.round(n / (n + 1000.0), 4).alias("prob"), F.col("quality").alias("label"))
