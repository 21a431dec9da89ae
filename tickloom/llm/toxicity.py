"""Toxicity of texts after a noisy-channel restoration of disguised words.

1. A trigram model of characters is counted over the words of all documents.
2. Words that mix letters with signs, repeat letters, or are written letter by letter
   are restored under that model (see deobfuscate).
3. A lexicon and the weights of a logistic score are fitted on labelled rows outside
   the held-out third: at most SAMPLE rows, those whose doc_id hashes come first.  A
   word, or the beginning of words, enters if it stands in at least SHARE of the toxic
   texts and much more often there than elsewhere; near copies (texts with the same
   least shingle hash) count once.
4. Every text is scored by the lexicon words that it holds, restored or plain, and by
   their number among its words.

Labels, lang, source and doc_id are no inputs of a score.  Null or blank text: the
score of a text without lexicon words.  Null doc_id: not used for fitting.  A doc_id
with two labels counts as toxic if one says so.  No labels or one class only: a
constant score.  Repeated rows are scored each; empty table: no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.brown import held_out
from tickloom.llm.deobfuscate import SYMBOLS, Restorer, cores, count_symbols, disguised, single, trigram_logs
from tickloom.llm.shared import small_batches
from tickloom.llm.words import Slice, window_hashes, word_slices

SAMPLE = 20_000
LEXICON = 256
SHARE = 0.02
#: Least log of the ratio of a word's frequencies in toxic and other texts.
LIFT = 1.5
#: Lengths of the beginnings of words that may enter the lexicon.
STEMS = (5, 7)
RIDGE = 0.05
THRESHOLD = 0.7
#: Shortest run of single characters that is read as a word written apart.
APART = 3


def character_model(docs: DataFrame) -> np.ndarray:
    """Trigram logs over all documents: SYMBOLS ** 3 numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((SYMBOLS, SYMBOLS, SYMBOLS))
        for part in word_slices(batches, lower=True):
            seen += count_symbols(cores(part.words), np.bincount(part.codes, minlength=len(part.words)))
        flat = seen.ravel().astype(np.int64)
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(flat[used])], ["cell", "n"])

    got = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS ** 3)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    return trigram_logs(counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS))


def restored_words(part: Slice, restore: Restorer) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of the restored words of each row: plain ones once per row."""
    core = cores(part.words)
    odd = disguised(core)
    times = np.unique(part.row_of * max(len(core), 1) + part.codes)
    row, code = times // max(len(core), 1), times % max(len(core), 1)
    plain = ~odd[code]
    rows, words = [row[plain]], [core.take(pa.array(code[plain]))]
    found_rows, found_words = [], []
    texts = core.filter(pa.array(odd)).to_pylist()
    back = np.cumsum(odd) - 1
    answers = [restore(w) for w in texts]
    for r, c in zip(row[~plain].tolist(), code[~plain].tolist()):
        for w in answers[back[c]]:
            found_rows.append(r)
            found_words.append(w)
    alone = single(core)[part.codes]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], alone.astype(np.int8), [0]))))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        cuts = part.starts[(part.starts > a) & (part.starts < b)].tolist()
        for x, y in zip([a, *cuts], [*cuts, b]):
            if y - x >= APART:
                at = part.codes[x:y]
                run = np.ones(len(at), bool)
                run[3:] = (at[3:] != at[2:-1]) | (at[3:] != at[1:-2]) | (at[3:] != at[:-3])
                text = "".join(core.take(pa.array(at[run])).to_pylist())
                for w in restore(text, True):
                    found_rows.append(int(np.searchsorted(part.starts, x, "right") - 1))
                    found_words.append(w)
    rows.append(np.array(found_rows, np.int64))
    words.append(pa.array(found_words, pa.string()))
    return np.concatenate(rows), pa.concat_arrays([w.cast(pa.string()) for w in words])


def _entries(words: pa.Array) -> list[pa.Array]:
    """The lexicon entries that each word could be: itself, and its beginnings."""
    long = [pc.greater_equal(pc.utf8_length(words), n) for n in STEMS]
    return [words, *(pc.if_else(is_long, pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, n), "^", ""),
                                pa.scalar(None, pa.string())) for n, is_long in zip(STEMS, long))]


def _lookup(part: Slice, restore: Restorer, lexicon: pa.Array) -> np.ndarray:
    """Per row: the distinct words of each lexicon entry, those of any, all words."""
    row, words = restored_words(part, restore)
    out = np.zeros((part.rows.num_rows, len(lexicon) + 2), np.int32)
    some = np.zeros(len(row), bool)
    for entry in _entries(words):
        at = pc.index_in(entry, lexicon, skip_nulls=True)
        good = at.is_valid().to_numpy(zero_copy_only=False)
        np.add.at(out, (row[good], pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[good]), 1)
        some |= good
    np.add.at(out, (row[some], len(lexicon)), 1)
    out[:, -1] = np.diff(part.starts)
    return out


@dataclass
class Model:
    logs: np.ndarray
    lexicon: list[str]
    weights: np.ndarray

    def scores(self, hits: np.ndarray) -> np.ndarray:
        x = _features(hits)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _features(hits: np.ndarray) -> np.ndarray:
    total, words = hits[:, -2].astype(float), hits[:, -1].astype(float)
    return np.column_stack([np.ones(len(hits)), np.log1p(total), np.log1p(200 * total / np.maximum(words, 20)),
                            np.log1p(hits[:, :-2])])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is free."""
    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ridge = np.full(len(w), RIDGE)
    ridge[0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    small_batches(docs.sparkSession)
    logs = character_model(docs)
    chosen = (labels.filter("doc_id is not null and toxic is not null").filter(~held_out(3, 1))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow())
    ids = chosen["doc_id"].to_numpy().astype(np.int64)
    order = np.argsort(ids)
    ids, marks = ids[order], chosen["toxic"].to_numpy()[order].astype(np.int64)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pc.fill_null(batch.column("doc_id").cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, held), max(len(ids) - 1, 0))
            good = (ids[at] == held) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(held), bool)
            mark = marks[at[good]] if len(ids) else np.zeros(0, np.int64)
            rows = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), pa.array(mark, pa.int64())],
                                             ["doc_id", "text", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(labelled, f"doc_id {kind}, text string, toxic long")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(logs)
        for part in word_slices(batches, lower=True):
            flat = part.flat()
            grams = window_hashes(flat, 5)
            mark = np.zeros(part.rows.num_rows, np.int64)
            for r, (a, b) in enumerate(zip(part.starts[:-1], part.starts[1:])):
                mine = grams[a:b - 4] if b - a >= 5 else flat[a:b]
                mark[r] = mine.min().view(np.int64) if len(mine) else 0
            row, words = restored_words(part, restore)
            for entry in _entries(words):
                yield pa.RecordBatch.from_arrays(
                    [entry, part.rows.column("toxic").take(pa.array(row)), pa.array(mark[row])], ["word", "toxic", "mark"])

    total = rows.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total.n or not total.t or total.t == total.n:
        rate = ((total.t or 0) + 0.5) / ((total.n or 0) + 1)
        return Model(logs, [], np.array([np.log(rate / (1 - rate)), 0.0, 0.0]))
    counted = rows.mapInArrow(spread, "word string, toxic long, mark long").distinct()
    texts = counted.groupBy("toxic").agg(F.count_distinct("mark").alias("n"))
    sizes = {r.toxic: r.n for r in texts.collect()}
    bad, fine = sizes.get(1, 0), sizes.get(0, 0)
    top = (counted.filter("word <> '' and word <> '^'").groupBy("word").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .filter(F.col("t") >= max(5.0, SHARE * bad))
        .withColumn("lift", F.log((F.col("t") + 0.5) / (bad + 1.0)) - F.log((F.col("c") + 0.5) / (fine + 1.0)))
        .filter(F.col("lift") >= LIFT).orderBy(F.desc("t"), "word").limit(LEXICON))
    lexicon = sorted(r.word for r in top.collect())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, table = Restorer(logs), pa.array(lexicon, pa.string())
        for part in word_slices(batches, lower=True):
            hits = _lookup(part, restore, table)
            yield pa.RecordBatch.from_arrays([part.rows.column("toxic"), pa.array([h.tobytes() for h in hits], pa.binary())],
                                             ["toxic", "hits"])

    seen = rows.mapInArrow(found, "toxic long, hits binary").toArrow()
    hits = np.array([np.frombuffer(b, np.int32) for b in seen["hits"].to_pylist()]).reshape(len(seen), len(lexicon) + 2)
    return Model(logs, lexicon, _logistic(_features(hits), seen["toxic"].to_numpy().astype(float)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, words (the lexicon words found) of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, table = Restorer(model.logs), pa.array(model.lexicon, pa.string())
        for part in word_slices(batches, lower=True):
            hits = _lookup(part, restore, table)
            value = np.round(model.scores(hits), 9)
            words = [[model.lexicon[i] for i in np.flatnonzero(h[:-2])] for h in hits]
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("doc_id"), part.rows.column("held_out"), pa.array(value),
                 pa.array((value >= threshold).astype(np.int32)), pa.array(words, pa.list_(pa.string()))],
                ["doc_id", "held_out", "score", "predicted", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out(3, 1).alias("held_out")).mapInArrow(
        work, f"doc_id {kind}, held_out boolean, score double, predicted int, words array<string>")
