"""Mutual information with a class label by nearest neighbours.

For a row whose k-th nearest row of its own class is r away, let m be the number of rows
of any class nearer than r (the row itself included).  Where r is 0, as among rows that
were filled with a mean, m counts the rows of the same value and k those of its class.
Then the information is psi(N) + mean psi(k) - mean psi(rows of the class) - mean psi(m),
not below 0.  No histogram, and no value of the feature is compared with more than its
neighbours in sorted order.

Values are taken in whole steps of the feature's range, so distances are exact and do not
depend on the order of additions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.totals import running_totals
from tickloom.sources.tables import stored

#: Steps in the range of a feature.
STEPS = 1 << 40
#: Distinct values of a feature and class that meet in one block or window.
BLOCK = 1 << 16
#: Values of a block that are counted together.
CELL = 256


def digamma(n: Column) -> Column:
    """Of whole numbers from 1, to 1e-9: six steps of the recurrence, then the series."""
    z = n.cast("double") + 6
    series = F.ln(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * z * z * z * z) - 1 / (252 * z * z * z * z * z * z)
    return series - sum((1 / (n.cast("double") + i) for i in range(6)), F.lit(0.0))


def _psi(n: np.ndarray) -> np.ndarray:
    """``digamma`` of an array."""
    n = n.astype(float)
    z = n + 6
    series = np.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * z * z * z * z) - 1 / (252 * z * z * z * z * z * z)
    return series - sum(1 / (n + i) for i in range(6))


def _stepped(ends: list[tuple]):
    """Batches of label, of_class and the features' columns, as ``f, g, label, of_class, c``: the
    rows of a value, in steps above the feature's least one.  A value that many rows of a batch
    share is one row.  `ends` has the mean, the least and the largest value of each feature."""
    def run(batches):
        for batch in batches:
            label, of_class = batch.column(0), batch.column(1)
            for f, (mean, low, high) in enumerate(ends):
                g = np.zeros(batch.num_rows, np.int64)
                if mean is not None and high > low:
                    x = batch.column(f + 2).to_numpy(zero_copy_only=False).astype(float)
                    x = np.where(np.isnan(x), mean, x)
                    g = np.floor((x - low) / (high - low) * STEPS + 0.5).astype(np.int64)
                t = pa.table({"g": g, "label": label, "of_class": of_class}).group_by(["g", "label", "of_class"], use_threads=False).aggregate([([], "count_all")])
                t = t.combine_chunks()
                yield from pa.table({"f": np.full(t.num_rows, f, np.int32), "g": t["g"], "label": t["label"], "of_class": t["of_class"], "c": t["count_all"]}).to_batches()

    return run


def _values(df: DataFrame, columns: list[str], target: str) -> tuple[DataFrame, int]:
    """f, g, label, of_class, c for the rows of classes of more than one row, sorted by feature
    and value over all partitions, and the number of those rows.  Missing values (null, NaN,
    infinite) are the feature's mean."""
    def known(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

    label = F.col(target).cast("string")
    names = [f"x{i}" for i in range(len(columns))]
    rows = df.filter(label.isNotNull()).select(label.alias("label"), *[known(c).alias(x) for c, x in zip(columns, names)])
    # a class of one row has no neighbours
    classes = stored(rows.groupBy("label").agg(F.count(F.lit(1)).alias("of_class"), *[
        e for x in names for e in (F.sum(x).alias(f"s{x}"), F.count(x).alias(f"n{x}"), F.min(x).alias(f"l{x}"), F.max(x).alias(f"h{x}"))]).filter("of_class > 1"))
    # one row
    whole = classes.agg(F.sum("of_class").alias("n"), *[
        e for x in names for e in ((F.sum(f"s{x}") / F.when(F.sum(f"n{x}") > 0, F.sum(f"n{x}"))).alias(f"m{x}"), F.min(f"l{x}").alias(f"l{x}"), F.max(f"h{x}").alias(f"h{x}"))]).first()
    ends = [tuple(whole[f"{e}{x}"] for e in "mlh") for x in names]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.join(classes.select("label", "of_class"), "label").select("label", "of_class", *names).mapInArrow(
        _stepped(ends), "f int, g long, label string, of_class long, c long")
    return values.repartitionByRange(n, "f", "g").sortWithinPartitions("f", "g", "label"), whole["n"] or 0


def _within(g: np.ndarray, c: np.ndarray, wanted: np.ndarray, near: list[tuple], far: int) -> np.ndarray:
    """The least distance within which a value has the wanted number of other rows of its class;
    `near` has values and rows of its neighbours, `far` where there is none."""
    sides = [(np.where(there, np.abs(v - g), far), rows) for v, rows, there in near]
    sides.append((np.zeros(len(g), np.int64), c - 1))
    r = np.full(len(g), far)
    for d, _ in sides:
        rows = sum(np.where((e <= d) & (e < far), m, 0) for e, m in sides)
        r = np.where((rows >= wanted) & (d < far), np.minimum(r, d), r)
    return r


FAR = np.iinfo(np.int64).max
MEASURED = "f int, g long, label string, of_class long, c long, cell long, use int, s double"


def _measured(k: int, block: int):
    """Sorted values, by blocks: ``s``, once a block, is the sum over the values whose neighbours
    and whose rows within their distance all lie in the block.  ``use`` is 2 for the others, 1
    for values that those may need, the ends of the classes in the block included."""
    def told(t: pa.Table, part: int, cell: int) -> pa.RecordBatch:
        t = t.combine_chunks()
        g, lab = t["g"].to_numpy(), t["label"].combine_chunks().dictionary_encode()
        code = lab.indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (code[1:] != code[:-1])])
        c, of_class = np.add.reduceat(t["c"].to_numpy(), starts), t["of_class"].to_numpy()[starts]
        g, code = g[starts], code[starts]
        order = np.lexsort((g, code))
        v, l, rows, n = g[order], code[order], c[order], len(order)
        wanted = np.minimum(k, of_class - 1)
        at, near = np.arange(n), []
        for i in range(1, k + 1):
            for j in (at - i, at + i):
                inside = (j >= 0) & (j < n)
                j = np.where(inside, j, 0)
                near.append((v[j], rows[j], inside & (l[j] == l)))
        r = _within(v, rows, wanted[order], near, FAR)
        ready = (r < FAR) & (r <= v - g[0]) & (r <= g[-1] - v)
        width, before = np.maximum(np.where(ready, r, 0) - 1, 0), np.r_[0, np.cumsum(c)]
        m = before[np.searchsorted(g, v + width, "right")] - before[np.searchsorted(g, v - width, "left")]
        sums = rows * (_psi(np.where(r == 0, rows, wanted[order])) - _psi(of_class[order]) - _psi(m))
        use, beside = np.zeros(n, np.int32), ~ready
        first = np.flatnonzero(np.r_[True, l[1:] != l[:-1]])
        last = np.r_[first[1:], n] - 1
        needed = np.concatenate([j for i in range(k) for j in (np.minimum(first + i, last), np.maximum(last - i, first))])
        use[needed] = 1
        for j in range(1, k + 1):
            use[:-j][beside[j:] & (l[j:] == l[:-j])] = 1
            use[j:][beside[:-j] & (l[j:] == l[:-j])] = 1
        use[beside] = 2
        back = np.empty(n, np.int32)
        back[order] = use
        s = np.full(n, np.nan)
        s[0] = sums[ready].sum()
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, t["f"][0].as_py(), np.int32)), pa.array(g), lab.dictionary.take(pa.array(code)), pa.array(of_class), pa.array(c),
                                           pa.array((part << 32) + cell + at // CELL), pa.array(back), pa.array(s, from_pandas=True)], names=[x.split()[0] for x in MEASURED.split(", ")])

    def run(batches):
        part, cell, held = TaskContext.get().partitionId(), 0, None

        def cut(t: pa.Table):
            nonlocal cell
            f = t["f"].to_numpy()
            edges = np.r_[0, np.flatnonzero(f[1:] != f[:-1]) + 1, len(f)]
            for a, b in zip(edges[:-1], edges[1:]):
                out = told(t.slice(a, b - a), part, cell)
                cell += -(-out.num_rows // CELL)
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows >= block:
                # rows of the last value wait
                f, g = held["f"].to_numpy(), held["g"].to_numpy()
                edges = np.flatnonzero((f[1:] != f[:-1]) | (g[1:] != g[:-1]))
                if len(edges):
                    yield from cut(held.slice(0, edges[-1] + 1))
                    held = held.slice(edges[-1] + 1)
        if held is not None:
            yield from cut(held)

    return run


def _radii(values: DataFrame, k: int, block: int) -> DataFrame:
    """f, label, g, c and r, the distance to the k-th nearest row of the class, of the values
    whose ``use`` is 2.

    A value's neighbours are at most k places away in the order of its class, so blocks of
    that order are windows of their own, each with k values of the blocks beside it."""
    placed = running_totals(values.select("f", "label", "g", "c", "of_class", "use"), ["f", "label"], [F.col("g")], {"at": F.lit(1)})
    home = F.col("at").cast("long")
    near = F.array_distinct(F.transform(F.array(home, F.greatest(home - k, F.lit(0).cast("long")), home + k),
                                        lambda p: F.floor(p / block)))
    rows = placed.withColumn("block", F.explode(near))
    w = Window.partitionBy("f", "label", "block").orderBy("at")
    beside = [side(c, i).over(w).alias(f"{c}{at}") for i in range(1, k + 1)
              for at, side in ((-i, F.lag), (i, F.lead)) for c in ("g", "c")]
    rows = rows.select("*", *beside).filter((F.col("block") == F.floor(F.col("at") / block)) & (F.col("use") == 2))
    rows = rows.withColumn("k", F.least(F.lit(k).cast("long"), F.col("of_class") - 1))
    near = [f"{c}{at}" for i in range(1, k + 1) for at in (-i, i) for c in ("g", "c")]
    told = rows.select("f", "label", "g", "c", "k", "of_class", *near)
    return told.mapInArrow(_reach(k), "f int, label string, g long, c long, r long, k long, of_class long")


def _reach(k: int):
    """The least distance within which a value has k more rows, among its 2 k neighbours."""
    def run(batches):
        for batch in batches:
            def of(name, missing=0):
                return batch.column(name).fill_null(missing).to_numpy(zero_copy_only=False)

            near = [(of(f"g{at}"), of(f"c{at}"), batch.column(f"g{at}").is_valid().to_numpy(zero_copy_only=False))
                    for i in range(1, k + 1) for at in (-i, i)]
            r = _within(of("g"), of("c"), of("k"), near, FAR)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("f", "label", "g", "c")], pa.array(r, mask=r == FAR),
                                              batch.column("k"), batch.column("of_class")], names=["f", "label", "g", "c", "r", "k", "of_class"])

    return run


def _across(values: DataFrame, k: int, block: int) -> DataFrame:
    """f, s: the sums over the values that their blocks leave open.  Rows within a distance are
    counted by one running total over cells and questions, and in the cell of a question."""
    points = stored(_radii(values.filter("use > 0"), k, block))
    width = F.greatest(F.col("r") - 1, F.lit(0).cast("long"))
    none = F.lit(0).cast("long")
    ask = F.inline(F.array(F.struct((F.col("g") - width).alias("v"), F.lit(0).alias("kind")),
                           F.struct((F.col("g") + width).alias("v"), F.lit(2).alias("kind"))))
    cells = values.groupBy("f", "cell").agg(F.max("g").alias("v"), F.sum("c").alias("n")).select(
        "f", "v", F.lit(1).alias("kind"), "n", F.lit(None).cast("string").alias("label"), none.alias("g"), "cell")
    events = cells.unionAll(points.select("f", ask, none.alias("n"), "label", "g", none.alias("cell")).select(*cells.columns))
    # of equal values, the question for smaller ones, the cell's last one, the question for all of them
    told = running_totals(events, ["f"], [F.col("v"), F.col("kind"), F.col("cell")], {"before": F.col("n"), "nth": F.when(F.col("kind") == 1, 1)})
    asked = told.filter("kind <> 1").select("f", "label", "g", "v", "kind", "before", "nth")
    inside = asked.join(told.filter("kind = 1").select("f", "nth", "cell"), ["f", "nth"]).join(
        values.select("f", "cell", F.col("g").alias("value"), "c"), ["f", "cell"]).filter("value < v or (kind = 2 and value = v)")
    counts = asked.select("f", "label", "g", "kind", "before").unionAll(inside.select("f", "label", "g", "kind", F.col("c").alias("before")))
    within = counts.groupBy("f", "label", "g").agg(F.sum(F.when(F.col("kind") == 2, F.col("before")).otherwise(-F.col("before"))).alias("m"))
    same = F.when(F.col("r") == 0, F.col("c")).otherwise(F.col("k"))
    return points.join(within, ["f", "label", "g"]).groupBy("f").agg(
        F.sum(F.col("c") * (digamma(same) - digamma(F.col("of_class")) - digamma(F.col("m")))).alias("s"))


def neighbour_information(df: DataFrame, columns: list[str], target: str, neighbours: int = 3,
                          block: int = BLOCK) -> DataFrame:
    """feature, mutual_information in nats, for every column of `columns`.

    Equal values are folded, so a value that holds most rows costs one row.  Rows without
    a label, and classes of one row, are left out; missing values count as the mean.  A
    constant or empty column has 0.  No rows: no features.

    Values move once, sorted by feature over all partitions, and are stored.  A block of that
    order finds distances and counts of nearly all its values by itself; those that may reach
    beyond it, and rare classes, are found across blocks.  `df` is read three times."""
    sorted_values, total = _values(df, columns, target)
    values = stored(sorted_values.mapInArrow(_measured(neighbours, block), MEASURED))
    sums = values.filter("s is not null").select("f", "s").unionAll(_across(values, neighbours, block)).groupBy("f").agg(F.sum("s").alias("s"))
    n = F.lit(max(total, 1)).cast("long")
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(names[F.col("f")].alias("feature"), F.greatest(digamma(n) + F.col("s") / n, F.lit(0.0)).alias("mutual_information"))
