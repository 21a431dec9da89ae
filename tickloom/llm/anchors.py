"""Word shingles of texts and where they meet a table of reference texts, by Spark's
own functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
#: Reference shingles up to which their table is broadcast; a larger one is shuffled.
BROADCAST_SHINGLES = 500_000
SEPARATORS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_shingles(df: DataFrame, text: Column, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """keep, n_words and `shingles`: the hash of the words from each position on."""
    split = F.split(F.trim(F.coalesce(text, F.lit(""))), SEPARATORS)
    words = df.select(*keep, F.filter(split, lambda w: w != "").alias("__w"))
    n = F.size("__w")
    hashes = F.transform(F.sequence(F.lit(1), n - (shingle - 1)), lambda i: F.xxhash64(F.slice("__w", i, shingle)))
    return words.select(*keep, n.alias("n_words"),
                        F.when(n >= shingle, hashes).otherwise(F.array().cast("array<bigint>")).alias("shingles"))


def small(df: DataFrame, limit: int = BROADCAST_SHINGLES) -> bool:
    return df.limit(limit + 1).count() <= limit


def hits(docs: DataFrame, references: DataFrame, text: Column, key: str = "doc_id") -> DataFrame:
    """(key, pos, and the columns of references) for every shingle of a text that equals
    `hash` of a reference row."""
    # the outer form: Spark adds a filter on the array's size below the other, and would
    # split the text again for each element there
    found = with_shingles(docs.filter(F.col(key).isNotNull()), text, [key]).select(
        key, F.posexplode_outer("shingles").alias("pos", "hash")).filter("hash is not null")
    return found.join(F.broadcast(references) if small(references) else references, "hash")
