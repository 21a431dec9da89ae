"""Packing documents into training sequences by cutting stock.

A document's tokens, one end token included, are cut into full sequences and a rest.
The histogram of the rests goes to a cutting-stock program (`cutting_stock`), whose
rounded patterns say how many rests of each length share a sequence.  Documents are
ranked within the length of their rest; a rank alone gives pattern, sequence and offset,
by arithmetic on a plan that has one row for each pattern and length, so no document is
ever looked up on the driver.  What rounding leaves over is cut to fill the gaps that
patterns have, then whole sequences; if that is not enough to fill the gaps, the most
wasteful sequences are broken up for it.  The last tokens go to sequences of powers of
two, which need no padding.  Gaps under `least_cut` tokens are left as padding.

Texts are tokenised once; ids are kept in the shared folder for the documents whose rest
is cut.  Null text: the empty text, one end token.  Null and repeated doc_ids: rows are
told apart by their place in the tokenised table, not by doc_id.  Empty table: no rows.
Columns of the input that are not kept are dropped; one named like a column of the
result gives way."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.functions.totals import running_totals
from tickloom.llm import cutting_stock
from tickloom.llm.shared import small_batches, stored
from tickloom.llm.token_ids import Ids
from tickloom.llm.words import text_slices

LENGTH = 2048
END = 1
LEAST_CUT = 16
#: Text bytes that are tokenised at a time: more repeats of a word than in a smaller slice.
TOKEN_SLICE = 3_000_000

PIECE = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                      T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
                      T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def tokenised(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but text where none are named) with a struct `tokens`: row,
    a number of its own for each row; n; the CRC-32 of each piece of `length` ids and of
    the rest; and the ids as little-endian 32-bit numbers.  Stored, so that it is made once."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("text", "tokens")] if keep is None else keep
    kind = T.StructType([T.StructField("row", T.LongType()), T.StructField("n", T.LongType()),
                         T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType())])
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("tokens", kind)])
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(path)
        for batch in batches:
            for part in text_slices(batch, "__t", TOKEN_SLICE):
                flat, ends = ids.of(part.column("__t"))
                n, crcs, held = [], [], []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    own = np.append(flat[a:b], np.uint32(end)).astype("<u4").tobytes()
                    n.append(len(own) // 4)
                    crcs.append([zlib.crc32(own[i:i + 4 * length]) for i in range(0, len(own), 4 * length)])
                    held.append(own)
                tokens = pa.StructArray.from_arrays(
                    [part.column("__row"), pa.array(n, pa.int64()), pa.array(crcs, out_schema.field("tokens").type[2].type), pa.array(held, pa.binary())],
                    fields=list(out_schema.field("tokens").type))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(names))], tokens], schema=out_schema)

    rows = docs.select(*names, F.coalesce("text", F.lit("")).alias("__t"), F.monotonically_increasing_id().alias("__row"))
    return stored(rows.mapInArrow(run, schema))


@dataclass
class Plan:
    """Where ranks go.  For a rest of length s: ranks below `solid[s]` stay whole; entry
    i of `first_rank[s]` starts the ranks of one pattern, with the pattern's first
    sequence, pieces of that length a sequence and first offset.  Later ranks are one
    stream, `stream[s]` first; region i of the stream starts at `at[i]` and is dealt in
    pieces of `width[i]` to sequences from `sequence[i]` on, at `offset[i]`."""

    length: int
    full_base: np.ndarray
    solid: np.ndarray
    stream: np.ndarray
    first_rank: list[np.ndarray]
    first_sequence: list[np.ndarray]
    times: list[np.ndarray]
    first_offset: list[np.ndarray]
    at: np.ndarray
    width: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    padding: int


def plan(length: int, counts: dict[int, int], fulls: dict[int, int], least_cut: int = LEAST_CUT) -> Plan:
    """The plan for counts[s] rests of length s (0: none) and fulls[s] whole sequences
    of the documents with such a rest."""
    rests = {s: n for s, n in counts.items() if s}
    groups = cutting_stock.whole(cutting_stock.solve(length, rests), rests, length, least_cut)
    filled = [[p, k, sum(s * n for s, n in p.items())] for p, k in groups]
    filled.sort(key=lambda g: (-g[2], sorted(g[0].items())))

    def gap(g) -> int:
        room = length - g[2]
        return room if room >= least_cut and g[2] & (g[2] - 1) else 0

    loose = sum(s * n for s, n in rests.items()) - sum(k * f for _, k, f in filled)
    wanted = sum(k * gap(g) for g in filled for k in [g[1]])
    for g in reversed(filled):
        if wanted <= loose:
            break
        broken = min(g[1], -(-(wanted - loose) // (g[2] + gap(g)))) if gap(g) else 0
        g[1] -= broken
        loose += broken * g[2]
        wanted -= broken * gap(g)
    filled = [g for g in filled if g[1]]

    top = length
    full_base, sequence = np.zeros(top, np.int64), 0
    for s in sorted(fulls):
        full_base[s] = sequence
        sequence += fulls[s]
    solid, entries = np.zeros(top, np.int64), [[] for _ in range(top)]
    regions, place, padding = [], 0, 0
    for g in filled:
        p, k, f = g
        offset = 0
        for s in sorted(p, reverse=True):
            entries[s].append((solid[s], sequence, p[s], offset))
            solid[s] += k * p[s]
            offset += s * p[s]
        width = gap(g)
        if width:
            regions.append((place, width, sequence, f))
            place += k * width
        elif f & (f - 1):
            padding += k * (length - f)
        sequence += k
    left = loose - place
    if left < 0:
        # the last gap that is filled: what follows stays open
        padding -= left
    if left >= length:
        regions.append((place, length, sequence, 0))
        sequence += left // length
        place += left // length * length
    for power in reversed(range(length.bit_length())):
        if left > 0 and left % length >> power & 1:
            regions.append((place, 1 << power, sequence, 0))
            place += 1 << power
            sequence += 1
    stream, at = np.zeros(top, np.int64), 0
    for s in sorted(rests):
        stream[s] = at
        at += (rests[s] - int(solid[s])) * s

    def column(i: int) -> list[np.ndarray]:
        return [np.array([e[i] for e in x], np.int64) for x in entries]

    def region(i: int) -> np.ndarray:
        return np.array([r[i] for r in regions], np.int64)

    return Plan(length, full_base, solid, stream, column(0), column(1), column(2), column(3),
                region(0), region(1), region(2), region(3), padding)


def _pieces(p: Plan, n: int, at: int, fulls: int, crcs: list) -> list[tuple]:
    """(start, length, crc or None, sequence, offset) of the pieces of one document."""
    length, s = p.length, n % p.length
    out = [(i * length, length, crcs[i], int(p.full_base[s]) + fulls + i, 0) for i in range(n // length)]
    begin = n - s
    if not s:
        return out
    if at < p.solid[s]:
        i = int(np.searchsorted(p.first_rank[s], at, side="right")) - 1
        j, times = at - int(p.first_rank[s][i]), int(p.times[s][i])
        out.append((begin, s, crcs[-1], int(p.first_sequence[s][i]) + j // times, int(p.first_offset[s][i]) + j % times * s))
        return out
    x = int(p.stream[s]) + (at - int(p.solid[s])) * s
    i = int(np.searchsorted(p.at, x, side="right")) - 1
    while s:
        while i + 1 < len(p.at) and x >= p.at[i + 1]:
            i += 1
        into, width = x - int(p.at[i]), int(p.width[i])
        inside = into % width
        take = min(s, width - inside)
        out.append((begin, take, None, int(p.sequence[i]) + into // width, int(p.offset[i]) + inside))
        begin, x, s = begin + take, x + take, s - take
    return out


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, least_cut: int = LEAST_CUT,
         keep: list[str] | None = None) -> DataFrame:
    """One row per piece: the kept columns and start, length, ids_crc32, doc_tokens,
    sequence_id and offset, in a struct `piece`."""
    held = tokenised(docs, path, length, end, keep)
    names = [c for c in held.columns if c not in ("tokens", "piece")]
    rest, full = F.col("tokens.n") % length, F.floor(F.col("tokens.n") / length)
    narrow = held.select(*names, F.col("tokens.row").alias("__row"), F.col("tokens.n").alias("__n"),
                         F.col("tokens.crcs").alias("__crcs"), rest.cast("int").alias("__rest"))
    sizes = held.groupBy(rest.alias("rest")).agg(F.count(F.lit(1)).alias("n"), F.sum(full).alias("fulls")).collect()
    made = plan(length, {r.rest: r.n for r in sizes}, {r.rest: r.fulls for r in sizes}, least_cut)

    ranked = stored(running_totals(narrow, ["__rest"], [F.col("__row")], {
        "__at": F.lit(1), "__fulls": F.floor(F.col("__n") / length)}))
    schema = T.StructType([*narrow.select(*names).schema.fields, T.StructField("__row", T.LongType()), T.StructField("piece", PIECE)])
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(c).to_pylist() for c in ("__n", "__at", "__fulls", "__crcs", "__row")}
            row, found = [], []
            for i, (n, rank, fulls, crcs) in enumerate(zip(at["__n"], at["__at"], at["__fulls"], at["__crcs"])):
                for start, size, crc, sequence, offset in _pieces(made, n, rank, fulls, crcs):
                    row.append(i)
                    found.append((start, size, crc, n, sequence, offset))
            columns = list(zip(*found)) if found else [()] * len(PIECE)
            piece = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(out_schema.field("piece").type))
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(row) for c in names], batch.column("__row").take(row), piece], schema=out_schema)

    pieces = ranked.mapInArrow(run, schema)
    cut = F.col("piece.ids_crc32").isNull()
    if not len(made.at):
        return pieces.drop("__row")
    pieces = stored(pieces)
    # ids of the documents whose rest is cut: the later rows of each length
    late = [(s, int(r)) for s, r in ranked.join(
        F.broadcast(docs.sparkSession.createDataFrame([(s, int(made.solid[s])) for s in range(1, length)], "__rest int, __solid long")),
        "__rest").filter("__at = __solid").select("__rest", "__row").collect()]
    first = docs.sparkSession.createDataFrame(late, "__rest int, __first long")
    ids = held.withColumn("__rest", rest.cast("int")).join(F.broadcast(first), "__rest").filter(F.col("tokens.row") >= F.col("__first")) \
        .select(F.col("tokens.row").alias("__row"), F.col("tokens.ids").alias("__ids"))
    part = F.expr("substring(__ids, cast(piece.start * 4 + 1 as int), cast(piece.length * 4 as int))")
    mended = pieces.filter(cut).join(ids, "__row").withColumn("piece", F.col("piece").withField("ids_crc32", F.crc32(part)))
    return pieces.filter(~cut).drop("__row").unionByName(mended.select(*names, "piece"))
