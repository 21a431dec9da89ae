"""Benchmark decontamination with SimHash over item-sized windows.

Words are lower-cased (A-Z) and split at ASCII white space.  An item of n words is
compared with windows of n words, each a bag of its 5-word shingles.  The similarity
weighs a shingle by its count: sum of the smaller counts over sum of the larger.

1. A window can only be similar if it shares a shingle with an item.  Every shingle of
   every text is looked up; each meeting at a position gives all windows of the item's
   size that hold the position (moved inside the text at its ends), as ranges of starts
   of at most one item's size.
2. These windows and the items get 64-bit SimHash fingerprints.
3. The fingerprints are cut into RADIUS + 1 blocks; two that differ in at most RADIUS
   bits agree in a block, so a join on (item size, block, value) finds all of them.
4. Candidates within the radius are verified by exact similarity.

At similarity 0.75 the expected distance is 11 bits of 64 with a deviation of 3, so a
radius of 20 leaves about one pair in a thousand behind at the very threshold.

Null or short text (under 5 words): no match; items with under 5 words match nothing.
Repeated items are reported each; repeated documents once (by doc_id, a key).  A null
doc_id matches nothing.  Empty tables: no rows.  Other columns are not touched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.anchors import LOWER, SHINGLE, UPPER, hits, small, with_shingles

SIMILARITY = 0.75
RADIUS = 20
BITS = 64


def _text() -> Column:
    return F.translate("text", UPPER, LOWER)


def fingerprint(bag: Column) -> Column:
    """SimHash: bit b is set where more than half of the hashes have it."""
    none = F.lit(0).cast("long")

    def bit(b: int) -> Column:
        having = F.aggregate(bag, none, lambda s, h: s + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("long")))
        return F.when(2 * having > F.size(bag), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(none)

    return reduce(Column.bitwiseOR, [bit(b) for b in range(BITS)])


def blocks(mark: str) -> Column:
    """(block, value) of each of the RADIUS + 1 parts of a fingerprint."""
    count = RADIUS + 1
    edges = [BITS * i // count for i in range(count + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(mark, lo).bitwiseAND(
        F.lit((1 << (hi - lo)) - 1)).alias("value")) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])


def counted(bag: Column) -> Column:
    """A bag as a set: each hash with the number of its occurrence."""
    ordered = F.array_sort(bag)
    return F.transform(ordered, lambda h, i: F.xxhash64(h, i - F.call_function("array_position", ordered, h).cast("int")))


def matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, start): the best window of each pair at or above
    the similarity, the first of equals."""
    item = with_shingles(items.filter("item_id is not null"), _text(), ["item_id"]).filter(f"n_words >= {SHINGLE}")
    marks = item.select("item_id", F.col("n_words").alias("size"), counted(F.col("shingles")).alias("held"),
                        fingerprint(F.col("shingles")).alias("mark"))
    spread = item.select(F.col("n_words").alias("size"), F.explode_outer("shingles").alias("hash")).distinct()
    size, pos, k = F.col("size"), F.col("pos"), F.col("k")
    first = F.greatest(pos - (size - SHINGLE), F.lit(0))
    met = hits(docs, spread, _text()).select("doc_id", "size", "pos", F.explode(F.array(
        F.floor(first / size).cast("int"), F.floor(pos / size).cast("int"))).alias("k"))
    ranges = met.groupBy("doc_id", "size", "k").agg(
        F.min(F.greatest(first, k * size)).alias("lo"), F.max(F.least(pos, k * size + size - 1)).alias("hi"))
    wanted = ranges.groupBy("doc_id").agg(F.collect_set(F.struct("size", "lo", "hi")).alias("windows"))
    texts = docs.select("doc_id", "text").join(wanted, "doc_id")
    cut = with_shingles(texts, _text(), ["doc_id", "windows"])
    last = F.greatest(F.col("n_words") - F.col("w.size"), F.lit(0))
    cut = cut.select("doc_id", "n_words", "shingles", F.explode("windows").alias("w")).select(
        "doc_id", "shingles", F.col("w.size").alias("size"), F.least("w.lo", last).alias("lo"), F.least("w.hi", last).alias("hi"))
    cut = cut.select("doc_id", "size", "lo", F.slice("shingles", F.col("lo") + 1, F.col("hi") - F.col("lo") + size - (SHINGLE - 1))
                     .alias("part"), F.explode(F.sequence("lo", "hi")).alias("start"))
    cut = cut.select("doc_id", "size", "start", F.slice("part", F.col("start") - F.col("lo") + 1, size - (SHINGLE - 1)).alias("bag")
                     ).dropDuplicates(["doc_id", "size", "start"])
    cut = cut.select("doc_id", "size", "start", counted(F.col("bag")).alias("words"), fingerprint(F.col("bag")).alias("mark"))
    left = cut.select("doc_id", "size", "start", "words", "mark", F.inline(blocks("mark")))
    right = marks.select("item_id", "size", "held", F.col("mark").alias("item_mark"), F.inline(blocks("mark")))
    both = F.size(F.array_intersect("words", "held"))
    like = both.cast("double") / (F.size("words") + F.size("held") - both).cast("double")
    pairs = (left.join(F.broadcast(right) if small(right) else right, ["size", "block", "value"])
             .filter(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= RADIUS))
    return (pairs.withColumn("similarity", like).filter(F.col("similarity") >= similarity)
            .groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
            .select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start")))


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that match no item."""
    found = matches(docs, items, similarity).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["leaked_id"], "left_anti")
