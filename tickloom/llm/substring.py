"""Removal of word windows that also start somewhere else.

A window of WINDOW consecutive words of one text goes if its word sequence starts at
any other place, in the same text or another; all words that such windows cover are
removed, of every occurrence.

1. The windows of a text are cut into segments: neighbouring windows whose least word
   n-gram hash is that of the same n-gram.  Equal windows have the same least n-gram, so
   they stand in segments with the same key, and a key that occurs once needs no more.
2. Equal segments are folded; all windows of a segment that occurs twice are repeated.
3. Segments that share their key with another one are dealt to shards by key.  A shard
   builds an FM-index of its distinct segments; the segments that occur once are
   streamed through it by backward search, and windows whose interval holds two or more
   suffixes are repeated.
4. A key with more than KEY_SEGMENTS distinct segments does not go to one shard: its
   windows are counted by their hashes (128 bits), which gives the same answer.  They
   stand in blocks of neighbours; only blocks that share words with another one, and are
   not equal to one, are taken apart.

Null or blank text: no words, nothing removed, the hash of the empty string.  Texts
under 35 words are never touched.  Repeated rows are occurrences of their own.  Null
doc_id and other columns do not matter; empty table: no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.fm_index import SEPARATOR, FMIndex, repeated_windows
from tickloom.llm.shared import bit_of, bits_at, key_bits, rows_with_bits, stored
from tickloom.llm.words import MULTIPLIER, Slice, mix, text_slices, window_hashes, word_slices

WINDOW = 35
GRAM = 8
SHARD_SEGMENTS = 8000
KEY_SEGMENTS = 1000


def _powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def stretch_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words from each start to its end, of any length."""
    factor = int(MULTIPLIER)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat) * _powers(len(flat), factor), dtype=np.uint64)))
        shift = _powers(len(flat) + 1, pow(factor, -1, 1 << 64))[starts]
        return mix((total[ends] - total[starts]) * shift + (ends - starts).astype(np.uint64))


def segments(part: Slice, window: int, gram: int):
    """(row, first window, windows, key, hash of the words) of each segment; positions
    count from the start of the slice."""
    flat, starts = part.flat(), part.starts
    n = len(flat) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = window_hashes(flat, gram)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    least = np.empty(n, np.int64)
    for at in range(0, n, 1 << 15):
        least[at:at + (1 << 15)] = views[at:at + (1 << 15)].argmin(1)
    row = part.row_of[:n]
    good = np.flatnonzero(np.arange(n) + window <= starts[1:][row])
    if not len(good):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    least = least[good] + good
    new = np.ones(len(good), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[good][1:] != row[good][:-1])
    at = np.flatnonzero(new)
    first = good[at]
    count = np.diff(np.append(at, len(good)))
    return row[first], first, count, grams[least[at]], stretch_hashes(flat, first, first + count + window - 1)


def _cut(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in word_slices(batches):
            row, first, count, key, words = segments(part, window, gram)
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("row_key").take(pa.array(row)), pa.array((first - part.starts[row]).astype(np.int32)),
                 pa.array(count.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(words.view(np.int64))],
                ["row_key", "first", "windows", "key", "words"])

    return docs.mapInArrow(work, "row_key long, first int, windows int, key long, words long")


def _contents(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted segments (row_key, first, windows, key, n) as hashes."""
    lists = wanted.groupBy("row_key").agg(F.collect_list(F.struct("first", "windows", "key", "n")).alias("parts"))
    texts = rows_with_bits(docs, "row_key", key_bits(wanted, "row_key")).join(lists, "row_key").dropDuplicates(["row_key"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in word_slices(batches):
            flat = part.flat()
            lists = part.rows.column("parts")
            items = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets, np.int64)))
            first = items.field("first").to_numpy() + part.starts[row]
            held = [flat[a:a + n + window - 1].tobytes() for a, n in zip(first, items.field("windows").to_numpy())]
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("row_key").take(pa.array(row)), items.field("first"), items.field("windows"),
                 items.field("key"), items.field("n"), pa.array(held, pa.binary())],
                ["row_key", "first", "windows", "key", "n", "held"])

    return texts.select("row_key", "text", "parts").mapInArrow(
        work, "row_key long, first int, windows int, key long, n long, held binary")


def _indexed(parts: DataFrame, shards: int, window: int) -> DataFrame:
    """(row_key, first, windows) of repeated windows found by the FM-index of a shard."""
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "row_key", "first"], ignore_index=True)
        lengths = (frame["windows"] + window - 1).to_numpy()
        flat = np.frombuffer(b"".join(frame["held"]), np.uint64)
        code = np.unique(flat, return_inverse=True)[1] + SEPARATOR + 1
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        symbols = np.full(int((lengths + 1).sum()), SEPARATOR, np.int64)
        symbols[np.repeat(starts, lengths) + np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = code
        query = np.flatnonzero(frame["n"].to_numpy() == 1)
        index = FMIndex(symbols, int(lengths.max()))
        hits = np.sort(repeated_windows(index, symbols, starts[query], (starts + lengths)[query], window))
        own = np.searchsorted(starts, hits, "right") - 1
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:] != hits[:-1] + 1) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        return pd.DataFrame({"row_key": frame["row_key"].to_numpy()[own[at]],
                             "first": (frame["first"].to_numpy()[own[at]] + hits[at] - starts[own[at]]).astype(np.int32),
                             "windows": np.diff(np.append(at, len(hits))).astype(np.int32)})

    return parts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(
        search, "row_key long, first int, windows int")


def _blocks(parts: DataFrame, window: int, gram: int) -> DataFrame:
    """The windows of segments in blocks of neighbours, as (row_key, n, first, windows, block,
    c1, c2, hashes): the block counts from the n-gram that gives the key, c1 and c2 are hashes
    of the words that all windows of a whole block share, hashes has those of each window.

    Equal windows hold their n-gram at the same place, so they stand in equal blocks with
    equal shared words."""
    places = window - gram + 1
    size = max(1, places // 4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            count = batch.column("windows").to_numpy().astype(np.int64)
            flat = np.frombuffer(b"".join(batch.column("held").to_pylist()), np.uint64)
            starts = np.cumsum(count + window - 1) - (count + window - 1)
            place = np.lib.stride_tricks.sliding_window_view(window_hashes(flat, gram), places)[starts].argmin(1)
            own = np.repeat(np.arange(len(count)), count)
            offset = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            block = (place[own] - offset) // size
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (block[1:] != block[:-1])
            at = np.flatnonzero(new)
            seg, block = own[at], block[at]
            shared = starts[seg] + place[seg] - block * size
            several, one = [[window_hashes(words, n).view(np.int64) for words in (flat, mix(flat))]
                            for n in (window, window - size + 1)]
            each = pa.StructArray.from_arrays([pa.array(h[starts[own] + offset]) for h in several], ["h1", "h2"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key").take(pa.array(seg)), batch.column("n").take(pa.array(seg)),
                 pa.array((batch.column("first").to_numpy()[seg] + offset[at]).astype(np.int32)),
                 pa.array(np.diff(np.append(at, len(own))).astype(np.int32)), pa.array(block.astype(np.int32)),
                 *[pa.array(h[shared]) for h in one],
                 pa.ListArray.from_arrays(pa.array(np.append(at, len(own)).astype(np.int32)), each)],
                ["row_key", "n", "first", "windows", "block", "c1", "c2", "hashes"])

    return parts.select("row_key", "first", "windows", "n", "held").mapInArrow(
        cut, "row_key long, n long, first int, windows int, block int, c1 long, c2 long, hashes array<struct<h1:long,h2:long>>")


def _counted(parts: DataFrame, window: int, gram: int) -> DataFrame:
    """The same for segments of keys with very many of them, by counting hashes.

    A block whose shared words stand in no other segment has no repeated window; all windows
    of a block that occurs twice are repeated.  Only those of the others are counted."""
    same = ["block", "c1", "c2"]
    blocks = stored(_blocks(parts, window, gram))
    folded = blocks.groupBy(*same, "hashes").agg(F.sum("n").alias("k"), F.min(F.struct("row_key", "first")).alias("one"))
    kinds = folded.groupBy(*same).agg(F.count(F.lit(1)).alias("d"), F.max("k").alias("most")).filter("d > 1 or most > 1")
    folded = stored(folded.join(kinds, same))
    whole = blocks.filter("n = 1").join(folded.filter("k > 1").select(*same, "hashes"), [*same, "hashes"], "left_semi").select(
        "row_key", "first", "windows")
    rows = folded.filter("d > 1").select("k", "one.*", F.posexplode("hashes").alias("i", "h")).select(
        "k", "row_key", (F.col("first") + F.col("i")).alias("first"), "h.h1", "h.h2")
    several = rows.groupBy("h1", "h2").agg(F.sum("k").alias("sum")).filter("sum > 1").select("h1", "h2")
    return whole.unionAll(rows.filter("k = 1").join(several, ["h1", "h2"], "left_semi").select(
        "row_key", "first", F.lit(1).alias("windows")))


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(row_key, first, windows): runs of repeated windows of each row of (row_key, text)."""
    cut = _cut(docs, window, gram)
    keys = cut.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key")
    several = stored(cut.join(keys, "key"))
    folded = stored(several.groupBy("key", "words").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row_key", "first", "windows")).alias("one")))
    whole = several.join(folded.filter("n > 1").select("key", "words"), ["key", "words"], "left_semi").select(
        "row_key", "first", "windows")
    crowds = folded.groupBy("key").agg(F.count(F.lit(1)).alias("d")).filter("d > 1")
    wanted = stored(folded.join(crowds, "key").select("key", "n", "d", "one.*"))
    size = wanted.count()
    if not size:
        return whole
    parts = _contents(docs, wanted.drop("d"), window)
    large = wanted.filter(f"d > {KEY_SEGMENTS}").select("key").distinct()
    parts = stored(parts.join(large.withColumn("large", F.lit(True)), "key", "left"))
    few = _indexed(parts.filter("large is null"), -(-size // SHARD_SEGMENTS), window)
    many = _counted(parts.filter("large"), window, gram)
    return whole.unionAll(few).unionAll(many)


def _finish(docs: DataFrame, window: int, kind: str, without: bytes | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept of rows (doc_id, text, runs, at), those that the
    key map `without` names left out."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if without is not None:
                batch = batch.filter(pa.array(~bits_at(without, batch.column("at"))))
            for rows in text_slices(batch):
                n_words, removed, kept = [], [], []
                for text, runs in zip(rows.column("text"), rows.column("runs")):
                    words = (text.as_py() or "").encode().split()
                    n_words.append(len(words))
                    if runs.is_valid:
                        first = runs.values.field("first").to_numpy()
                        step = np.zeros(len(words) + 1, np.int64)
                        np.add.at(step, first, 1)
                        np.add.at(step, first + runs.values.field("windows").to_numpy() + window - 1, -1)
                        words = [words[j] for j in np.flatnonzero(np.cumsum(step)[:-1] == 0)]
                    removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.mapInArrow(work, f"doc_id {kind}, n_words long, n_removed long, kept string")


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    runs = stored(repeated(rows.select("row_key", "text"), window, gram).groupBy("row_key").agg(
        F.collect_set(F.struct("first", "windows")).alias("runs")))
    bits = key_bits(runs, "row_key")
    none = F.lit(None).cast("array<struct<first:int,windows:int>>")
    touched = rows_with_bits(rows, "row_key", bits).join(runs, "row_key", "left").select("doc_id", "text", "runs")
    rest = rows.select("doc_id", "text", none.alias("runs"), bit_of("row_key").alias("at"))
    return _finish(touched, window, kind).unionAll(_finish(rest, window, kind, bits))
