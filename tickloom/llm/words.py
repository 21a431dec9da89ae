"""Words, word hashes and word windows of whole texts.

A word is a longest run of `[^\\x20\\x09-\\x0D]` (only ASCII white space splits).
The Python side works on Arrow batches, cut into slices of bounded text size, so
one worker holds a few megabytes whatever the table or the longest text is.  A
null text has no words.  Hashes have 64 bits and depend on the words alone, so a
repeated task gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text bytes that one slice holds, one longer text excepted.
SLICE_BYTES = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Slice:
    """Rows of a batch with their words: word i of row r is
    `words[codes[starts[r] + i]]`; `hashes` belongs to `words`."""

    rows: pa.RecordBatch
    codes: np.ndarray
    starts: np.ndarray
    words: pa.Array
    hashes: np.ndarray

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def flat(self) -> np.ndarray:
        """The hash of every word in order."""
        return self.hashes[self.codes] if len(self.codes) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts have `most` bytes together, or one longer row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def word_slices(batches: Iterator[pa.RecordBatch], column: str = "text", lower: bool = False) -> Iterator[Slice]:
    for batch in batches:
        for rows in text_slices(batch, column):
            text = pc.fill_null(rows.column(column), "")
            if lower:
                text = pc.ascii_lower(text)
            lists = pc.ascii_split_whitespace(text)
            flat = lists.flatten()
            full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            ends = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
            starts = np.concatenate(([0], np.cumsum(full)))[ends]
            coded = flat.filter(pa.array(full)).dictionary_encode()
            words = coded.dictionary
            hashes = (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
                      if len(words) else np.zeros(0, np.uint64))
            yield Slice(rows, coded.indices.to_numpy(zero_copy_only=False), starts, words, hashes)


def window_hashes(flat: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions of the
    array, and positions that run over the end of a row, are not to be used."""
    if len(flat) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(flat) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * MULTIPLIER + flat[i:len(flat) - n + 1 + i]
    return mix(out)


def shingle_sets(part: Slice, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-word shingles, ordered by row and hash.  A row
    with fewer words has one shingle, its whole sequence; one without words none."""
    flat, starts = part.flat(), part.starts
    lengths = np.diff(starts)
    hashes = window_hashes(flat, n)
    at = np.arange(len(hashes))
    row = part.row_of[: len(hashes)]
    good = at + n <= starts[1:][row] if len(hashes) else np.zeros(0, bool)
    rows, values = [row[good]], [hashes[good]]
    for r in np.flatnonzero((lengths > 0) & (lengths < n)):
        words = flat[starts[r]:starts[r + 1]]
        rows.append(np.array([r]))
        values.append(window_hashes(words, len(words)) ^ np.uint64(len(words)))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[first], value[first]


def word_array(text: Column, lower: bool = False) -> Column:
    """The words of a text as an array, by Spark's own functions."""
    text = F.coalesce(text, F.lit(""))
    if lower:
        text = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the offsets of the rows in them."""
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[ends[0]:ends[-1]], ends - ends[0]


def row_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of integer values between positions, one per row."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return total[ends] - total[starts]
