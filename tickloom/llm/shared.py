"""Tables between jobs, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
#: Size of a key map: one megabyte, whatever the table.
KEY_BITS = 1 << 23
BITMAP_BITS = 32768


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows where the session has Spark's default of 10,000:
    whole texts are wide, and a worker and its executor hold a batch several times."""
    if spark.conf.get(BATCHES) == "10000":
        spark.conf.set(BATCHES, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the
    session names none, as in tests on one machine."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read again: later jobs neither
    compute it anew nor lose it with an executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b): root is the smallest
    node that can be reached.

    Alternating large and small stars: each step replaces the edges of a node by
    edges to the smallest neighbour, found by an aggregate, so a hub's neighbours
    never meet in one task.  Ends when a step changes nothing."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def star(edges: DataFrame, both: bool) -> DataFrame:
        seen = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
        least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        if both:
            # large star: every larger neighbour of a goes to a's least neighbour
            out = seen.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            # small star: the smaller neighbours of a, and a, go to the least of them
            joined = edges.join(least, "a")
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
                least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        edges = stored(star(star(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(tops).groupBy("node").agg(
        F.min("root").alias("root"))


def bit_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(KEY_BITS))


def key_bits(keys: DataFrame, key: str) -> bytes:
    """A map with one of KEY_BITS bits set for the hash of each key.  Where there are
    more keys than bits it lets more rows through, never fewer."""
    got = keys.select((bit_of(key) + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = bytearray(KEY_BITS // 8)
    for r in got:
        out[(r.k - 1) * BITMAP_BITS // 8:r.k * BITMAP_BITS // 8] = r.bits
    return bytes(out)


def bits_at(bits: bytes, at: pa.Array) -> np.ndarray:
    at = at.to_numpy(zero_copy_only=False)
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def rows_with_bits(df: DataFrame, key: str, bits: bytes) -> DataFrame:
    """The rows whose key may be in the map."""
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = bits_at(bits, batch.column(batch.num_columns - 1))
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(held))

    return df.withColumn("__at", bit_of(key)).mapInArrow(chosen, df.schema)
