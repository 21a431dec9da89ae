"""Parquet bars in and out, and where a job may write intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.bars import normalise_bars


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  Only a local session without one gets a
    temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="tickloom-")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/tickloom-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_bars(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Bars with dates cut to midnight.  Order is a matter of the windows, so
    nothing is sorted here."""
    return normalise_bars(spark.read.parquet(path), names)


def write_bars(bars: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Parquet, partitioned by a hash bucket of the key.  All rows of a key share
    a bucket; a bucket is one shuffle partition, sorted for tight row groups."""
    b = F.pmod(F.hash("key"), F.lit(buckets))
    bars.withColumn("bucket", b).repartition("bucket").sortWithinPartitions("key", "ts") \
        .write.mode(mode).partitionBy("bucket").parquet(path)


def read_bucketed_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """CSV without nested columns: those named and any that CSV cannot hold."""
    nested = [c for c, t in df.dtypes if t.startswith(("map", "struct", "array"))]
    df.drop(*drop, *nested).write.mode(mode).option("header", True).csv(path)
