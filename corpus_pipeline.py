"""The corpus pipeline: five stages, each a table in the shared folder.

    from corpus_pipeline import run
    run(spark, "/path/of/tables")

Quality rules drop documents that they reject; of each group of near copies the one
with the smallest doc_id stays; documents that hold a benchmark item go; sources are
mixed to their target weights, which repeats documents of sources in demand and leaves
out what a source has too much of; rows are shuffled within their source by a seeded
hash, in which every repeat of a document has its own place, and dealt to 24 shards in
proportion to the sources (the order of the curriculum is not kept).

Every stage works on all rows its predecessor kept.  Null and empty texts go with the
quality rules; empty tables stay empty; further columns of documents are carried along
to the last stage, which returns the shard and slot of every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import curriculum, decontaminate, ngram_join, quality, shards
from tickloom.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.fit(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.take_whole(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shards.assign(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("target_mix", target_mix),
    ("sharding", sharding),
]

#: The ratio of byte n-grams and the component search have no SQL form; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
