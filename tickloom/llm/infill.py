"""Fill-in-the-middle: texts rearranged so that a model learns to fill a gap.

Every text of n code points is cut twice, at places that follow from its doc_id, and
written as prefix, suffix, middle (psm) or suffix, prefix, middle (spm) with a sentinel
before each part; some texts stay plain.  Cuts are ranks of code points, texts are
UTF-8 bytes: a piecewise-linear index of all code point boundaries of a slice of rows
(`rank_index`) gives the byte of each cut exactly.

Null text: the empty text.  Empty texts and texts that hold a sentinel stay plain.  Null
doc_id: hashed as `null`.  Rows with equal doc_id and text get equal results; nothing is
ordered or dropped.  Empty table: no rows.  A column of the input named `fim` gives way,
all others are kept.  A slice of rows has about a megabyte of text, one longer text
excepted, whose index takes a byte per code point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.rank_index import ERROR, RankIndex
from tickloom.llm.shared import small_batches
from tickloom.llm.words import text_bytes, text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
SEED = 1
RATE, SPM = 90, 20

FIM = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType())])


def numbers(seed: int) -> list[Column]:
    """Four whole numbers of 32 bits per row: groups of the SHA-256 of seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    digest = F.sha2(F.encode(name, "utf-8"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _cut(text: pa.Array, h: np.ndarray, rate: int, spm_share: int, error: int) -> pa.Array:
    data, edges = text_bytes(text)
    index = RankIndex.fit(data, error)
    first = index.rank_of(edges)
    n = np.diff(first)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    at_low, at_high = index.offsets(first[:-1] + low), index.offsets(first[:-1] + high)
    plain = (n == 0) | (h[2] % 100 >= rate)
    for mark in SENTINELS:
        plain |= pc.match_substring(text, mark).to_numpy(zero_copy_only=False)
    spm = ~plain & (h[3] % 100 < spm_share)
    held = data.tobytes()
    marks = [m.encode() for m in SENTINELS]
    out = []
    for a, b, c, d, kept, turned in zip(edges[:-1], at_low, at_high, edges[1:], plain, spm):
        if kept:
            out.append(held[a:d])
        elif turned:
            out.append(b"".join((marks[1], held[c:d], marks[0], held[a:b], marks[2], held[b:c])))
        else:
            out.append(b"".join((marks[0], held[a:b], marks[1], held[c:d], marks[2], held[b:c])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return pa.StructArray.from_arrays(
        [pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain),
         pa.array(out, pa.binary()).cast(pa.string())], names=FIM.names)


def rearrange(docs: DataFrame, rate: int = RATE, spm_share: int = SPM, seed: int = SEED, error: int = ERROR) -> DataFrame:
    """docs with one more column, `fim`: n, form, prefix_chars, middle_chars and the
    output text.  rate percent of the texts are rearranged, of these spm_share percent
    as suffix, prefix, middle."""
    small_batches(docs.sparkSession)
    docs = docs.drop("fim")
    names = docs.columns
    rows = docs.select(*names, F.coalesce("text", F.lit("")).alias("__t"), *[c.alias(f"__{i}") for i, c in enumerate(numbers(seed))])
    schema = T.StructType([*docs.schema.fields, T.StructField("fim", FIM)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__t"):
                h = [part.column(f"__{i}").to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
                fim = _cut(part.column("__t"), h, rate, spm_share, error)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(len(names))], fim], names=[*names, "fim"])

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: the parts between the sentinels, in the text's order."""
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    body = F.substr(head, F.lit(len(PREFIX) + 1))
    a, b = F.substring_index(body, SUFFIX, 1), F.substring_index(body, SUFFIX, -1)
    c, d = F.substring_index(body, PREFIX, -1), F.substring_index(body, PREFIX, 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, middle, b)).otherwise(F.concat(c, middle, d))
