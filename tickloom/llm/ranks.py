"""Seeded order of rows, and exact running totals without one big window.

A row's hash is the first 60 bits of an MD5 of seed and doc_id; a row without doc_id
has that of its content, so such rows are spread as others are.  Rows are dealt into
BUCKETS ranges of the hash; totals per bucket are a small aggregate, and only the
rows of one bucket meet in a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
HASH_BITS = 60


def _bits(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def content_mark(text: str = "text") -> Column:
    """60 bits of a text, which order rows that share a doc_id."""
    return _bits(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def seeded(seed: int, key: str = "doc_id", content: Column | None = None) -> Column:
    """The hash of a row by its key, or by `content` where that is null."""
    other = F.lit("-") if content is None else F.concat(F.lit("-"), content.cast("string"))
    return _bits(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), other))))


def bucket_of(hashed: str) -> Column:
    return F.expr(f"cast({hashed} div {(1 << HASH_BITS) // BUCKETS} as int)")


def running(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, name: str,
            facts: DataFrame | None = None) -> DataFrame:
    """df with `name`: the sum of value over the rows of the group that come before
    (buckets first, then `order`), and `name`_all: the sum over the whole group.
    `facts`, one row per group, joins the bucket totals, so its columns reach the rows
    of a hot group by many buckets."""
    df = df.withColumn("__v", value)
    cells = df.groupBy(*group, bucket).agg(F.sum("__v").alias("__s"))
    whole = Window.partitionBy(*group)
    cells = cells.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(bucket).alias("__bucket"),
                         (F.sum("__s").over(whole.orderBy(bucket)) - F.col("__s")).alias("__base"),
                         F.sum("__s").over(whole).alias(f"{name}_all"))
    if facts is not None:
        keys = [(f"__{g}", f"__fact_{g}") for g in group]
        facts = facts.withColumnsRenamed({g: f"__fact_{g}" for g in group})
        match = F.lit(True)
        for a, b in keys:
            match = match & cells[a].eqNullSafe(facts[b])
        cells = cells.join(facts, match).drop(*[b for _, b in keys])
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__r", F.sum("__v").over(within) - F.col("__v"))
    same = df[bucket] == cells["__bucket"]
    for g in group:
        same = same & df[g].eqNullSafe(cells[f"__{g}"])
    return df.join(cells, same).withColumn(name, F.col("__base") + F.col("__r")).drop(
        "__v", "__r", "__base", "__bucket", *[f"__{g}" for g in group])
