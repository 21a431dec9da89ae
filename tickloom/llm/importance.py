"""Resampling documents towards the distribution of a target set.

Lower-cased words and their n-grams fall into hash buckets; a bucket's gain is the log
ratio of its smoothed share in the target to that in the corpus, in whole thousandths;
a document weighs the sum of its gains, and the documents with the largest weight plus
Gumbel noise are a draw without replacement in proportion to exp(weight).

The hash is CRC-32, taken for all n-grams of a slice of rows at once (`span_crc`).  Bucket
counts are totals per task, then per bucket; the driver holds one number a bucket.  Ranks
come from running totals over range partitions.

Null text: no words.  A document without features weighs 0.  Documents with fewer than
`least_words` words are scored but never drawn.  Null doc_id: hashed as `null`, last among
ties; rows that share score and doc_id go by a hash of the text.  Empty documents: no
rows.  Empty target: t and T are 0.  A column of the input named `importance` gives way."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.totals import running_totals
from tickloom.llm.shared import small_batches, stored
from tickloom.llm.span_crc import span_crcs
from tickloom.llm.words import row_sums, text_bytes, text_slices

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

#: Bytes that belong to a word once A-Z is lower case: digits, a-z, all beyond ASCII.
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Every byte, A-Z lowered.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SPACE = np.uint8(32)


def _features(text: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram, and the number of words of each row."""
    raw, edges = text_bytes(text)
    data = LOWER[raw]
    held = IN_WORD[data]
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    # words end where rows do
    inner = edges[1:-1]
    inner = inner[(inner > 0) & (inner < len(held))]
    first[inner] = held[inner]
    last[inner - 1] = held[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(edges, starts, side="right") - 1
    n_words = np.bincount(row, minlength=len(edges) - 1)
    if longest > 1:
        # the words again, one space between them: an n-gram is then one span
        size = ends - starts + 1
        at = np.cumsum(size) - size
        joined = np.full(int(size.sum()), SPACE, np.uint8)
        for_word = np.repeat(starts - at, size)
        source = np.arange(len(joined)) + for_word
        inside = source < np.repeat(ends, size)
        joined[inside] = data[source[inside]]
        data, starts, ends = joined, at, at + size - 1
    rows, found = [], []
    for n in range(1, longest + 1):
        k = max(0, len(starts) - n + 1)
        good = row[:k] == row[n - 1:]
        rows.append(row[:k][good])
        found.append(span_crcs(data, starts[:k][good], ends[n - 1:][good]) % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), n_words


def bucket_counts(df: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """The number of features of all texts in each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                total += np.bincount(_features(part.column("text"), longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    small_batches(df.sparkSession)
    texts = df.select(F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of every bucket, one added to each count."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(seed: int) -> Column:
    """Gumbel noise in whole thousandths, from a hash of seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(F.encode(name, "utf-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all where none are named) with n_words, n_features, weight and
    a hash of the text, in a struct `importance`."""
    small_batches(docs.sparkSession)
    docs = docs.drop("importance")
    names = docs.columns if keep is None else keep
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "tie")])
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("importance", kind)])
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__t"):
                row, bucket, n_words = _features(part.column("__t"), longest, buckets)
                n = np.bincount(row, minlength=part.num_rows)
                order = np.argsort(row, kind="stable")
                ends = np.cumsum(n)
                weight = row_sums(gain[bucket[order]], ends - n, ends)
                found = pa.StructArray.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in (n_words, n, weight)] + [part.column("__tie")], names=kind.names)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(names))], found], names=[*names, "importance"])

    return docs.select(*names, F.coalesce("text", F.lit("")).alias("__t"), F.xxhash64("text").alias("__tie")).mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`, doc_id among them) with `importance`: n_features,
    weight, score and rank, null for documents that are not drawn."""
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows = weigh(docs, gain, longest, keep)
    names = rows.columns[:-1]
    rows = stored(rows.withColumn("__score", F.col("importance.weight") + noise(seed)))
    able = F.col("importance.n_words") >= least_words
    drawn = rows.filter(able).count() * percent // 100
    order = [F.col("__score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__tie")]
    ranked = running_totals(rows.filter(able).withColumn("__tie", F.col("importance.tie")), [], order, {"__at": F.lit(1)})
    rank = F.when(F.col("__at") < drawn, F.col("__at") + 1)

    def shaped(df: DataFrame, rank: Column) -> DataFrame:
        return df.select(*names, F.struct(F.col("importance.n_features").alias("n_features"), F.col("importance.weight").alias("weight"),
                                          F.col("__score").alias("score"), rank.cast("long").alias("rank")).alias("importance"))

    return shaped(ranked, rank).unionAll(shaped(rows.filter(~able), F.lit(None)))
