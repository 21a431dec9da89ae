"""Sharding by proportional stratified interleaving.

Rows get a rank in the seeded order of their source; sorted by fractional rank
(2 rank + 1) / (2 rows of the source), every stretch of the order holds each source in
proportion, and it is cut into shards whose row counts are at most one apart.  Ranks
are exact and come from bucket totals, so no source and no table meets in one task.

Ties in fractional rank go by source (null last), then by hash, doc_id, CRC and size.
Null text has 8 bytes; a null source is a source of its own; a null doc_id is placed by
size and CRC; repeated rows (equal doc_id and text)
are placed each, by a hash of the number of the repeat, so that copies spread.
Fewer rows than shards: the last shards are empty.  Empty table: no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.ranks import BUCKETS, bucket_of, running, seeded

SHARDS = 24
SEED = 29
ROW_BYTES = 8
#: So many repeats of a row are made from one array.
REPEATS = 4096


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """rows with h and its bucket b.  The first of equal rows has the hash of its
    doc_id, the k-th one that of doc_id and k.  Only counts are grouped, so rows that
    are repeated without bound do not meet in a window."""
    names = rows.columns
    same = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("times"))
    part = F.explode(F.expr(f"sequence(0L, (times - 1) div {REPEATS})"))
    each = same.select(*names, "times", part.alias("part")).select(
        *names, F.explode(F.expr(f"sequence(part * {REPEATS} + 1, least(times, (part + 1) * {REPEATS}))")).alias("k"))
    nameless = F.concat_ws("-", F.lit(""), "size", "text_crc32")
    again = F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), nameless), F.when(F.col("k") > 1, F.col("k").cast("string")))
    return each.withColumn("key", again).withColumn("h", seeded(seed, "key")).drop("key", "k").withColumn("b", bucket_of("h"))


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot of every row."""
    rows = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
                       F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    rows = _placed(rows, seed)
    one = F.lit(1).cast("long")
    rows = running(rows, ["source"], "b", ["h", "doc_id", "text_crc32", "size"], one, "rank")
    part = (F.col("rank") * 2 + 1).cast("double") / (F.col("rank_all") * 2).cast("double")
    rows = rows.withColumn("part", part).withColumn("b", F.least(F.floor(F.col("part") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    rows = rows.withColumn("all_rows", F.lit(0))
    rows = running(rows, ["all_rows"], "b", ["part", F.col("source").asc_nulls_last(), "h", "doc_id", "text_crc32", "size"], one, "at")
    each, more = F.expr(f"at_all div {shards}"), F.expr(f"at_all % {shards}")
    edge = more * (each + 1)
    first = F.col("at") < edge
    late = F.col("at") - edge
    size = F.greatest(each, F.lit(1).cast("long"))
    return rows.select(
        "doc_id", "source", "size", "text_crc32",
        F.when(first, F.floor(F.col("at") / (each + 1))).otherwise(more + F.floor(late / size)).cast("int").alias("shard"),
        F.when(first, F.col("at") % (each + 1)).otherwise(late % size).alias("slot"))
