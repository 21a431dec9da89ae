"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed byte n-grams: one of trusted
documents (labelled good), one of the whole corpus.  Its sum over a text, divided
by the number of n-grams, decides: a text at or above the threshold stays.  Corpus
counts cover every document; the trusted side is fitted on at most `trusted_rows`
labelled rows, those whose hashes of doc_id come first.  The ratio of an n-gram is
held as a whole number of millionths, so sums do not depend on the order of rows.

Null or empty text: no words, all counts 0, base_failed, not kept.  Null doc_id:
scored like any other.  Repeated rows: each is scored.  No labels: the ratio is 0
everywhere, and the base rules alone decide.  Other columns are left as they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import small_batches
from tickloom.llm.words import Slice, row_sums, text_bytes, text_slices, window_hashes, word_slices

ORDER = 3
BUCKETS = 1 << 16
SCALE = 1_000_000
#: Pseudo-counts by which an n-gram's trusted count is drawn towards the corpus.
PRIOR = 5.0
TRUSTED_ROWS = 20_000
THRESHOLD = -0.2
SYMBOLS = "#*$%&|<>"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram at each byte."""
    n = max(len(data) - ORDER + 1, 0)
    key = np.zeros(n, np.uint32)
    for i in range(ORDER):
        key = (key << np.uint32(8)) | data[i:n + i]
    with np.errstate(over="ignore"):
        key *= np.uint32(0x9E3779B1)
    return key >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _grams(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets by byte, and where the n-grams of each row begin and end."""
    data, ends = text_bytes(pc.fill_null(rows.column("text"), ""))
    return gram_buckets(data), np.minimum(ends[:-1], max(len(data) - ORDER + 1, 0)), np.maximum(
        np.minimum(ends[:-1], max(len(data) - ORDER + 1, 0)), ends[1:] - ORDER + 1)


def fit(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> np.ndarray:
    """The ratio of each bucket in millionths: BUCKETS numbers, whatever the table."""
    small_batches(docs.sparkSession)
    trusted = [r[0] for r in labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
               .orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows).collect()]
    known = np.sort(np.array(trusted, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for rows in text_slices(batch):
                grams, starts, ends = _grams(rows)
                ids = pc.fill_null(rows.column("doc_id"), 0).to_numpy(zero_copy_only=False)
                good = np.isin(ids, known) & rows.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                step = np.zeros((2, len(grams) + 1), np.int64)
                for line, chosen in ((0, np.ones(len(good), bool)), (1, good)):
                    np.add.at(step[line], starts[chosen], 1)
                    np.add.at(step[line], ends[chosen], -1)
                    inside = np.cumsum(step[line])[:-1] > 0
                    seen[line] += np.bincount(grams[inside], minlength=BUCKETS)
        used = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[0, used]), pa.array(seen[1, used])],
                                         ["bucket", "corpus", "trusted"])

    rows = (docs.select("doc_id", "text").mapInArrow(count, "bucket int, corpus long, trusted long")
            .groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted")).collect())
    corpus, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        corpus[r.bucket], good[r.bucket] = r.corpus, r.trusted
    expected = corpus * (good.sum() / max(corpus.sum(), 1))
    return np.round(np.log((good + PRIOR) / (expected + PRIOR)) * SCALE).astype(np.int64)


def base_counts(part: Slice) -> dict[str, np.ndarray]:
    """The counts of the base rules, one of each per row."""
    text = pc.fill_null(part.rows.column("text"), "")
    data, ends = text_bytes(text)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))
    n = len(text)
    lines = pc.split_pattern(text, "\n")
    flat = lines.flatten()
    full = pc.not_equal(pc.ascii_trim_whitespace(flat), "").to_numpy(zero_copy_only=False)
    line_row = np.repeat(np.arange(n), np.diff(np.asarray(lines.offsets, np.int64)))[full]
    code = flat.filter(pa.array(full)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.unique(line_row * (len(flat) + 1) + code) // (len(flat) + 1)
    hashes = window_hashes(part.flat(), 5)
    row = part.row_of[:len(hashes)]
    at = np.flatnonzero(np.arange(len(hashes)) + 5 <= part.starts[1:][row])
    order = at[np.lexsort((hashes[at], row[at]))]
    same = (row[order][1:] == row[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(len(part.codes) + 1, np.int64)
    step[:len(hashes)][order[twice]] += 1
    cover = np.cumsum(step)
    cover[5:] -= cover[:-5].copy()
    n_words = np.diff(part.starts)
    repeated = row_sums(cover[:-1] > 0, part.starts[:-1], part.starts[1:])
    return {"n_words": n_words,
            "word_chars": row_sums(((data & 0xC0) != 0x80) & ~space, ends[:-1], ends[1:]),
            "n_symbols": row_sums(symbol, ends[:-1], ends[1:]),
            "n_dup_lines": np.bincount(line_row, minlength=n)[:n] - np.bincount(distinct, minlength=n)[:n],
            "n_repeat_words": repeated,
            "base_failed": (n_words < 10) | (100 * repeated > 20 * n_words)}


def _verdicts(part: Slice, ratio: np.ndarray, threshold: float):
    counts = base_counts(part)
    grams, starts, ends = _grams(part.rows)
    total, n = row_sums(ratio[grams], starts, ends), ends - starts
    score = total / (np.maximum(n, 1) * SCALE)
    return counts, n, score, ~counts["base_failed"] & (total >= round(threshold * SCALE) * n)


def measure(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, n_grams and the ratio per n-gram."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in word_slices(batches):
            counts, n, value, kept = _verdicts(part, ratio, threshold)
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("doc_id"), *(pa.array(c) for c in counts.values()), pa.array(kept),
                 pa.array(n), pa.array(value)], ["doc_id", *counts, "kept", "n_grams", "ratio"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, {FIELDS}, kept boolean, n_grams long, ratio double")


def keep(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in word_slices(batches):
            yield part.rows.filter(pa.array(_verdicts(part, ratio, threshold)[3]))

    return docs.mapInArrow(chosen, docs.schema)
