"""Jaccard self-join on word n-grams by rare-first prefix filtering.

Two texts link when 4 * |A and B| >= 3 * |A or B| over their sets of distinct
5-word shingles (production values; both are parameters).

1. Texts with equal sets become one node, named by the least doc_id.
2. Shingles get one global order, rare first: by the count of the hash bucket that
   a shingle falls into (counted over all texts), then by hash.  Any such order gives
   whole results; the counts only keep frequent shingles out of the prefixes.
3. A set x links only with sets y of 0.75 to 4/3 of its size.  Let y be the smaller:
   with the overlap o that the sizes ask for, a shingle stands in the first
   n(x) - o + 1 of x and in the first n(y) - o + 1 of y.  So x is looked up by its
   first n - ceil(3/4 n) + 1 shingles, y is listed under its first
   n - ceil(6/7 n) + 1, and both meet on (shingle, size band): a shingle far back in x
   is looked up only in the bands of sizes that could still link.  Postings of shingles
   that only one node has go.
4. A pair that meets is a candidate if its lengths and the positions of the shingle
   allow the overlap, and if the sizes of the parts of the two sets do (the suffix
   filter: the hash range cut at 15 pivots).
5. Rounds of stars compare each node with one listed node per shingle and band, first
   the one with the fewest rare shingles before it, and join what links into
   components, while that halves what is left: the meetings of nodes in different
   components.  Crowds, the cells whose meetings grow by the square, have rounds of their
   own with several centres each.  All that is left is verified then, so no component is
   missed, and a group of near copies costs no pairs by the square.

A document whose text is null or blank has an empty set and links with nothing.
Rows with a null doc_id get component null.  Rows that share a doc_id share a
component, and each of their texts keeps its links: where a doc_id has several sets, texts
are named by hashes for the search, and the components of a doc_id's texts are joined
afterwards.  Other columns are ignored by `link` and kept by `keep_one`."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import components, key_bits, rows_with_bits, stored
from tickloom.llm.words import Slice, mix, shingle_sets, word_slices

#: The similarity as a fraction.
ABOVE, BELOW = 3, 4
SKETCH = 1 << 22
BLOCK = 1 << 14
FIRST = ["doc_id", "n", "mark1", "mark2", "block", "whole", "held"]
PARTS = 16
#: Ratio of the sizes at the ends of a size band.
BAND = 1.15
#: Another star round is only worth its jobs while more meetings than this many per
#: posting are left.
LEFT_PER_POSTING = 16
#: A crowd is a (token, band) with more meetings than this many per posting; its nodes meet
#: STARS centres a round.
CROWD, STARS = 4, 8


def _row_starts(row: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(n + 1))


def _bounds(part: Slice):
    row, value = shingle_sets(part)
    return row, value, _row_starts(row, part.rows.num_rows)


def first_pass(docs: DataFrame) -> DataFrame:
    """Rows of two kinds from one reading of the texts: (doc_id, n, mark1, mark2), the
    size and the fingerprint of each document's set; and (block, whole, held), each
    task's counts of shingles per hash bucket.

    Counts come in blocks of BLOCK buckets, whole where most buckets are in use and as
    (bucket, count) where few are; a task's count stops at 65,535."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SKETCH, np.int32)
        for part in word_slices(batches, lower=True):
            _, value, at = _bounds(part)
            bucket, n = np.unique((value % np.uint64(SKETCH)).astype(np.int32), return_counts=True)
            seen[bucket] += n.astype(np.int32)
            sums = []
            with np.errstate(over="ignore"):
                for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64)))
                    sums.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
            rows = len(at) - 1
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("doc_id"), pa.array(np.diff(at)), *sums, pa.nulls(rows, pa.int32()),
                 pa.nulls(rows, pa.bool_()), pa.nulls(rows, pa.binary())], FIRST)
        for block in range(SKETCH // BLOCK):
            some = np.minimum(seen[block * BLOCK:(block + 1) * BLOCK], 65535).astype(np.uint16)
            used = np.flatnonzero(some)
            if len(used):
                whole = 2 * len(used) > BLOCK
                held = some.tobytes() if whole else np.concatenate((used.astype(np.uint16), some[used])).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([block], pa.int32()), pa.array([whole]),
                     pa.array([held], pa.binary())], FIRST)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, n long, mark1 long, mark2 long, block int, whole boolean, held binary")


def levels_of(counts: DataFrame) -> np.ndarray:
    """The level of each hash bucket from (block, whole, held): 8 times the binary
    logarithm of its count.  SKETCH bytes, whatever the table."""
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, whole, held in zip(*(batch.column(c) for c in ("block", "whole", "held"))):
                into = seen.setdefault(block.as_py(), np.zeros(BLOCK, np.int64))
                values = np.frombuffer(held.as_py(), np.uint16)
                if whole.as_py():
                    into += values
                else:
                    into[values[:len(values) // 2]] += values[len(values) // 2:]
        for block, n in seen.items():
            level = np.minimum(np.round(8 * np.log2(np.maximum(n, 1))), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())],
                                             ["block", "level"])

    got = counts.repartition("block").mapInArrow(total, "block int, level binary").toArrow()
    levels = np.zeros(SKETCH, np.uint8)
    for block, level in zip(got["block"].to_pylist(), got["level"].to_pylist()):
        levels[block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(level, np.uint8)
    return levels


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (n * ABOVE + BELOW - 1) // BELOW + (n > 0)


def prefixes(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """One row per document: size of its set, sizes of the set's parts, and the shingles
    of its prefix in order."""
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in word_slices(batches, lower=True):
            row, value, at = _bounds(part)
            n = np.diff(at)
            order = np.lexsort((value, levels[(value % np.uint64(SKETCH)).astype(np.int64)], row))
            take = prefix_length(n)
            first = (np.arange(len(row)) - at[row]) < take[row]
            cells = np.bincount(row * PARTS + (value >> np.uint64(60)).astype(np.int64),
                                minlength=len(n) * PARTS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("doc_id"), pa.array(n),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * PARTS, pa.int32()), pa.array(cells)),
                 pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))), pa.int32()),
                                          pa.array(value[order][first].view(np.int64)))],
                ["doc_id", "n", "parts", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        heads, "doc_id long, n long, parts array<int>, prefix array<long>")


def _overlap_needed(n: str, m: str):
    total = BELOW + ABOVE
    return F.expr(f"({ABOVE} * ({n} + {m}) + {total - 1}) div {total}")


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, each verified once on whole texts."""
    side = nodes.select("node", "n", "parts")
    least = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    pairs = (pairs.join(side.toDF("a", "na", "pa"), "a").join(side.toDF("b", "nb", "pb"), "b")
             .filter(least >= _overlap_needed("na", "nb")).select("a", "b"))
    pairs = stored(pairs)
    need = key_bits(pairs.select("a").unionAll(pairs.select("b")), "a")
    texts = rows_with_bits(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), "text"),
                           "node", need).groupBy("node").agg(F.min("text").alias("text"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                one = pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([rows.column("x"), rows.column("y")])], ["text"])
                sets = {}
                base = 0
                for part in word_slices(iter([one]), lower=True):
                    row, value, ends = _bounds(part)
                    for i in range(part.rows.num_rows):
                        sets[base + i] = value[ends[i]:ends[i + 1]]
                    base += part.rows.num_rows
                good = np.zeros(rows.num_rows, bool)
                for i in range(rows.num_rows):
                    x, y = sets[i], sets[rows.num_rows + i]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[i] = BELOW * both >= ABOVE * (len(x) + len(y) - both) and both > 0
                yield rows.select(["a", "b"]).filter(pa.array(good))

    return (pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
            .mapInArrow(linked, "a long, b long").distinct())


def _band(size: str):
    return F.expr(f"cast(floor(ln({size}) / {log(BAND)!r}) as int)")


def _sides(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (token, node, n, i, root) as lookups (x, once per band of sizes that it
    may link with) and as lists (y).  Both hold the largest size of the other that their
    position allows."""
    most = F.expr("(4 * n - 7 * i) div 3")
    lookups = (postings.withColumn("most", most).withColumn("low", F.expr("(3 * n + 3) div 4"))
               .withColumn("high", F.least("n", "most")).filter("high >= low")
               .select("token", F.explode_outer(F.sequence(_band("low"), _band("high"))).alias("band"), F.col("node").alias("x"),
                       F.col("n").alias("nx"), F.col("i").alias("ix"), F.col("most").alias("mx"), F.col("root").alias("rx")))
    lists = postings.withColumn("most", most).filter("most >= n").select(
        "token", _band("n").alias("band"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("i").alias("iy"),
        F.col("most").alias("my"), F.col("root").alias("ry"))
    return lookups, lists


def _meet(lookups: DataFrame, lists: DataFrame) -> DataFrame:
    """The candidates: meetings that the length and positional filters allow."""
    room = F.least("ix", "iy") + 1 + F.least(F.expr("nx - ix - 1"), F.expr("ny - iy - 1"))
    return (lookups.join(lists, ["token", "band"])
            .filter(f"rx <> ry and x <> y and ny <= nx and nx <= my and ny <= mx and {BELOW} * ny >= {ABOVE} * nx")
            .filter(room >= _overlap_needed("nx", "ny"))
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())


def _star(postings: DataFrame, turn: int, stars: int = 1) -> DataFrame:
    """Each lookup with one listed node: in the first turn the one with the fewest
    shingles before, later one of a component that changes with the turn; or with those
    of several turns."""
    lookups, lists = _sides(postings)
    first = F.lit(0) if turn == 0 else F.xxhash64("turn", "ry")
    turns = F.lit(turn) if stars == 1 else F.explode(F.sequence(F.lit(turn), F.lit(turn + stars - 1)))
    key = ["token", "band"] + (["turn"] if stars > 1 else [])
    centre = lists.withColumn("turn", turns).groupBy(*key).agg(F.min(F.struct(
        first.alias("k"), "iy", F.xxhash64("y").alias("h"), "y", "ny", "my", "ry")).alias("c")).select("token", "band", "c.*").drop("k", "h")
    return _meet(lookups, centre if stars == 1 else centre.distinct())


def _cells(postings: DataFrame) -> DataFrame:
    """token, band, left, size, top: the meetings between different components, the postings
    and the largest component of each (token, band) that has such meetings."""
    lookups, lists = _sides(postings)
    key = ["token", "band"]
    cells = (lookups.select(*key, F.col("rx").alias("root"), F.lit(1).alias("p"), F.lit(0).alias("q"))
             .unionAll(lists.select(*key, F.col("ry").alias("root"), F.lit(0).alias("p"), F.lit(1).alias("q")))
             .groupBy(*key, "root").agg(F.sum("p").alias("p"), F.sum("q").alias("q")))
    number = F.col("p").cast("double") * F.col("q")
    return stored(cells.groupBy(*key).agg(
        (F.sum("p").cast("double") * F.sum("q") - F.sum(number)).alias("left"), F.sum(F.col("p") + F.col("q")).alias("size"),
        F.max(F.struct((F.col("p") + F.col("q")).alias("k"), "root")).alias("top")).filter("left > 0").select(
        *key, "left", "size", F.col("top.root").alias("top")))


def _meetings(cells: DataFrame) -> int:
    return int(cells.agg(F.sum("left")).first()[0] or 0)


def _rest(postings: DataFrame, cells: DataFrame) -> DataFrame:
    """The candidates among the meetings between different components.  The largest
    component of a (token, band) stands on one side of a join only; `cells` may be of
    earlier roots, for any component may be that one."""
    lookups, lists = _sides(postings)
    key = ["token", "band"]
    x, y = lookups.join(cells.select(*key, "top"), key), lists.join(cells.select(*key, "top"), key)
    minor = _meet(x.filter("rx <> top").drop("top"), y.drop("top"))
    major = _meet(x.filter("rx = top").drop("top"), y.filter("ry <> top").drop("top"))
    return minor.unionAll(major).distinct()


class _Search:
    """The links found so far and the components that they make."""

    def __init__(self, postings: DataFrame, known: DataFrame):
        self.postings, self.known = postings, known
        self.edges, self.roots = None, None

    def rooted(self, rows: DataFrame, column: str = "node") -> DataFrame:
        """rows with the component of a column's node as `root`."""
        if self.roots is None:
            return rows.withColumn("root", F.col(column))
        found = self.roots.select(F.col("node").alias(column), "root")
        return rows.join(found, column, "left").withColumn("root", F.coalesce("root", column))

    def add(self, pairs: DataFrame, docs: DataFrame) -> None:
        found = stored(_verify(pairs, docs, self.known))
        if not found.isEmpty():
            self.edges = found if self.edges is None else self.edges.unionAll(found)
            self.roots = stored(components(self.edges))

    def crowds(self, tokens: DataFrame, docs: DataFrame, turn: int) -> int:
        """Rounds of several stars on the postings of these tokens only, while they halve
        the meetings; how many are left."""
        few = stored(self.postings.join(tokens, "token", "left_semi"))
        size = few.count()
        texts = stored(rows_with_bits(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                                      "doc_id", key_bits(few.select("node"), "node")))
        before = float("inf")
        while True:
            marked = stored(self.rooted(few))
            left = _meetings(_cells(marked))
            if left <= size or 2 * left > before:
                return left
            self.add(_star(marked, turn, STARS), texts)
            before, turn = left, turn + STARS


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and node: the least doc_id with
    the same set."""
    first = stored(first_pass(docs))
    mark = F.struct("mark1", "mark2", "n")
    several = first.filter("block is null and doc_id is not null").groupBy("doc_id").agg(
        F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high")
    return _linked(docs, first) if several.isEmpty() else _linked_by_text(docs)


def _linked_by_text(docs: DataFrame) -> DataFrame:
    """`link` where a doc_id may have several texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = rows.filter("doc_id is not null").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("t")).distinct()
    salt = 0
    while True:  # until no two texts share a name, as good as always at once
        name = F.xxhash64(F.lit(salt), "doc_id", "t")
        n, names = kinds.agg(F.count(F.lit(1)), F.count_distinct(name)).first()
        if n == names:
            break
        salt += 1
    named = rows.withColumn("t", F.md5(F.coalesce("text", F.lit("")))).select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), name).alias("own"), "text")
    alone = named.select(F.col("own").alias("doc_id"), "text")
    got = stored(_linked(alone, stored(first_pass(alone))))
    each = got.filter("doc_id is not null").dropDuplicates(["doc_id"]).withColumnsRenamed(
        {"doc_id": "own", "component_id": "part", "node": "same"})
    each = stored(named.select("doc_id", "own").join(each, "own"))
    least = each.groupBy("doc_id").agg(F.min("part").alias("b"))
    roots = components(each.select("doc_id", F.col("part").alias("a")).join(least, "doc_id").select("a", "b")).toDF("part", "root")
    each = each.join(roots, "part", "left").withColumn("root", F.coalesce("root", "part"))
    whole = each.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    equal = each.filter("same is not null").groupBy("same").agg(F.min("doc_id").alias("node"))
    out = each.join(whole, "root").join(equal, "same", "left").select("doc_id", "n_shingles", "component_id", "node")
    none = F.lit(None).cast("long")
    return out.unionByName(got.filter("doc_id is null").select(
        "doc_id", "n_shingles", none.alias("component_id"), none.alias("node")))


def _linked(docs: DataFrame, first: DataFrame) -> DataFrame:
    """`link` of documents whose doc_id tells their sets apart, after the first pass."""
    marks = first.filter("block is null").select("doc_id", "n", "mark1", "mark2")
    classes = stored(marks.filter("doc_id is not null and n > 0").groupBy("mark1", "mark2", "n").agg(
        F.min("doc_id").alias("node")))
    levels = levels_of(first.filter("block is not null").select("block", "whole", "held"))
    nodes = (prefixes(docs, levels).withColumnRenamed("doc_id", "node")
             .join(classes.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    spread = nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("i", "token"))
    listed = F.max(F.expr("(4 * n - 7 * i) div 3 >= n"))
    several = spread.groupBy("token").agg(F.count(F.lit(1)).alias("k"), listed.alias("listed")).filter(
        "k > 1 and listed").select("token")
    postings = stored(spread.join(several, "token").select("token", "node", "n", "i"))
    size = postings.count()
    roots = None
    if size:
        known = stored(nodes.select("node", F.col("n").cast("int").alias("n"), "parts").join(
            postings.select("node"), "node", "left_semi"))
        search = _Search(postings, known)
        pairs, turn, last, before = _star(search.rooted(postings), 0), 0, False, float("inf")
        while True:
            search.add(pairs, docs)
            if last:
                break
            cells = _cells(search.rooted(postings))
            left = _meetings(cells)
            tokens = stored(cells.filter(F.col("left") > float(CROWD) * F.col("size")).select("token").distinct())
            if not tokens.isEmpty():
                left -= _meetings(cells.join(tokens, "token", "left_semi"))
                left += search.crowds(tokens, docs, 1 + turn * (STARS + 1) * 64)
                cells = search.rooted(cells.withColumnRenamed("top", "was"), "was").withColumnRenamed("root", "top")
            if not left:
                break
            last = left <= LEFT_PER_POSTING * size or 2 * left > before
            before, turn = left, turn + 1
            marked = search.rooted(postings)
            pairs = _rest(marked, cells) if last else _star(marked, turn)
        roots = search.roots
    out = marks.join(classes, ["mark1", "mark2", "n"], "left")
    out = out.join(roots, "node", "left") if roots is not None else out.withColumn("root", F.lit(None).cast("long"))
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node", "doc_id")).alias("component_id"),
                      "node")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without those whose component holds a smaller doc_id.  Repeated
    rows and rows with a null doc_id stay."""
    gone = link(docs).filter("doc_id > component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
