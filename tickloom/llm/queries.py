"""The registered queries of this subpackage, with DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    brown, curriculum, decontaminate, importance, infill, licenses, main_text, ngram_join, oracles, packing, quality, shards,
    substring, toxicity)
from tickloom.llm.shared import stored
from tickloom.llm.words import word_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark, sf_dir):
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op2_curriculum_mix(spark, sf_dir):
    docs = stored(_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words")))
    return curriculum.plan(docs, size=F.col("words")).select("doc_id", "mix.*").select(
        "doc_id", "size", "source_size", "target", "taken", F.size("passes").cast("long").alias("copies"),
        F.round(F.array_min(F.transform("passes", lambda p: p["position"])), 6).alias("first_position"))


def op3_ngram_jaccard(spark, sf_dir):
    return ngram_join.link(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_brown_lm(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model, words = brown.fit(docs.filter(~brown.held_out()))
    return brown.score(docs, model, words)


def op5_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.notices(spark)).select(
        "doc_id", "template_id", "license", F.round("containment", 6).alias("containment"), "first_word")


def op6_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"))).select(
        "doc_id", "held_out", "score", "predicted")


def op7_decontamination(spark, sf_dir):
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start")


def op8_substring_dedup(spark, sf_dir):
    return substring.remove(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op9_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.measure(docs, quality.fit(docs, _table(spark, sf_dir, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("ratio", 9).alias("ratio"))


def op10_stratified_shards(spark, sf_dir):
    return shards.assign(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op11_fill_in_middle(spark, sf_dir):
    docs = infill.rearrange(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(text):
        return F.sha2(F.encode(text, "utf-8"), 256)

    return docs.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", digest(F.col("fim.output")).alias("output_sha256"),
        digest(infill.restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"))


def op12_importance_resampling(spark, sf_dir):
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"]).select(
        "doc_id", "importance.*")


def op13_cutting_stock_packing(spark, sf_dir):
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"]).select("doc_id", "piece.*")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_html_extraction, op2_curriculum_mix, op3_ngram_jaccard, op4_brown_lm, op5_license_scan, op6_toxicity, op7_decontamination, op8_substring_dedup,
        op9_quality_rules, op10_stratified_shards, op11_fill_in_middle, op12_importance_resampling, op13_cutting_stock_packing,
        pipeline)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
