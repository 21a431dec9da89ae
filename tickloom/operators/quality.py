"""Feature quality: correlation, information, redundancy, grades and curation.

Wide feature tables are unpivoted to ``(feature, x, y)``, so every statistic is a
distributed aggregate whatever the number of rows; ranks come from one range-partitioned
sort (``ranked_pairs``), shared by the statistics that need them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.totals import running_totals
from tickloom.sources.tables import stored

# fixed grade limits: (pass, marginal)
LIMITS = {"target_correlation": (0.02, 0.01), "mutual_information": (0.001, 0.0005),
          "max_redundancy": (0.90, 0.95), "temporal_stability_cv": (0.5, 0.8),
          "precision_drop": (0.002, 0.001)}
LOWER_IS_BETTER = ("max_redundancy", "temporal_stability_cv")

# fixed keyword table, in the order in which it is searched
CATEGORY_KEYWORDS = {
    "moving_averages": ["sma", "ema", "wma", "tema", "kama", "hma", "vwma", "ma_"],
    "oscillators": ["rsi", "stoch", "cci", "mfi", "williams", "cmo", "roc"],
    "momentum": ["macd", "roc_", "momentum", "ppo", "trix"],
    "volatility": ["atr", "bb_", "volatility", "keltner", "vol_", "std_"],
    "volume": ["volume", "obv", "ad_", "cmf", "vwap"],
    "trend": ["adx", "aroon", "trend", "psar"],
    "risk_metrics": ["sharpe", "sortino", "max_drawdown", "var_"],
    "support_resistance": ["pivot", "support", "resistance", "fib", "donchian"],
    "entropy_regime": ["entropy", "regime", "permutation"],
    "calendar": ["day_of_week", "is_monday", "is_friday", "month", "quarter"],
    "candle": ["candle", "body", "wick", "doji", "range_vs"],
}
# fixed minimum of features per category; 1 where none is given
CATEGORY_MINIMUMS = {"moving_averages": 5, "oscillators": 4, "momentum": 3, "volatility": 3, "volume": 3,
                     "trend": 2, "risk_metrics": 2, "support_resistance": 2}


def unpivot(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``feature, x, y`` for the complete pairs."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(F.col(target).cast("double").alias("y"), F.inline(pairs)).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull()).select("feature", "x", "y")


def target_correlation(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Pearson correlation per feature, 0 under ten pairs or without variation."""
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    c = F.covar_pop("x", "y") / F.when(spread > 0, spread)
    return unpivot(df, columns, target).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 10, F.coalesce(c, F.lit(0.0)))
        .otherwise(0.0).alias("correlation"))


def _folded(batches):
    """Batches of the features' columns and y, as rows f, x, y, n: a value that many rows of a
    batch share is one row, so a value that holds most rows meets no single task."""
    for batch in batches:
        y = batch.column(batch.num_columns - 1)
        for f in range(batch.num_columns - 1):
            t = pa.table({"x": batch.column(f), "y": y}).drop_null()
            t = t.group_by(["x", "y"], use_threads=False).aggregate([([], "count_all")])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.num_rows, f, np.int32)), *[
                pa.array(t.column(c).to_numpy() + zero) for c, zero in (("x", 0.0), ("y", 0.0), ("count_all", 0))]], names=["f", "x", "y", "n"])


def _placed(batches):
    """Rows in the order of f and x, as f, y, n with the rows of smaller x in this partition,
    the rows of the same x, and the partition.  Rows of the last x wait for the next batch."""
    part, held, feature, seen = TaskContext.get().partitionId(), None, -1, 0

    def told(f, x, y, n, starts):
        nonlocal feature, seen
        ties = np.add.reduceat(n, starts)
        at = np.cumsum(ties) - ties
        new = np.r_[f[starts[0]] != feature, f[starts[1:]] != f[starts[:-1]]]
        at = at - np.maximum.accumulate(np.where(new, at, 0)) + np.where(np.cumsum(new) == 0, seen, 0)
        feature, seen = f[-1], at[-1] + ties[-1]
        size = np.diff(np.r_[starts, len(f)])
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (
            f, y, n, np.repeat(at, size), np.repeat(ties, size), np.full(len(f), part, np.int32))], names=["f", "y", "n", "below", "ties", "part"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held:
            rows = [np.concatenate(c) for c in zip(held, rows)]
        f, x = rows[:2]
        same = (f[1:] == f[:-1]) & ((x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1])))
        starts = np.r_[0, np.flatnonzero(~same) + 1]
        held = [c[starts[-1]:] for c in rows]
        if starts[-1]:
            yield told(*[c[:starts[-1]] for c in rows], starts[:-1])
    if held:
        yield told(*held, np.array([0]))


def ranked_pairs(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``feature, y, n, below, ties, total`` for the complete pairs of every feature: n rows
    whose x has ``below`` smaller ones and ``ties`` equal ones among ``total``.

    One range-partitioned sort of the folded values, stored once.  A partition hands on one
    row per feature, which tells the others how many rows are before them."""
    known = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(target).cast("double").alias("y"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = known.mapInArrow(_folded, "f int, x double, y double, n long").repartitionByRange(n, "f", "x").sortWithinPartitions("f", "x")
    local = stored(rows.mapInArrow(_placed, "f int, y double, n long, below long, ties long, part int"))
    by = Window.partitionBy("f")
    size = F.sum("rows").over(by.orderBy("part")) - F.col("rows")
    # one row per partition and feature that it holds: features and partitions are in one order
    parts = local.groupBy("f", "part").agg(F.sum("n").alias("rows")).select(
        "f", "part", size.alias("before"), F.sum("rows").over(by).alias("total"))
    names = F.array(*[F.lit(c) for c in columns])
    return local.join(F.broadcast(parts), ["f", "part"]).select(
        names[F.col("f")].alias("feature"), "y", "n", (F.col("below") + F.col("before")).alias("below"), "ties", "total")


def _added(batches):
    """Batches of f, y, n and the rank of x, as ``f, y, n, sx, sxx``: rows, ranks and squares of a
    value of y, which is one row however many rows of the batch have it."""
    for batch in batches:
        n, rx = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
        t = pa.table({"f": batch.column(0), "y": pa.array(batch.column(1).to_numpy(zero_copy_only=False) + 0.0), "n": batch.column(2), "sx": n * rx, "sxx": n * rx * rx})
        t = t.group_by(["f", "y"], use_threads=False).aggregate([("n", "sum"), ("sx", "sum"), ("sxx", "sum")])
        yield from pa.table([t[c].combine_chunks() for c in ("f", "y", "n_sum", "sx_sum", "sxx_sum")], names=["f", "y", "n", "sx", "sxx"]).to_batches()


RANKS = ("rows", "sx", "sxx", "sy", "syy", "sxy")


def _ranked_in_part(batches):
    """Rows in the order of f and y, as one row per feature: sums over the ranks of x and over the
    ranks of y that the rows have in this partition.  The rows of the last y wait for the next batch."""
    part, sums, held = TaskContext.get().partitionId(), {}, None

    def told(f, y, n, sx, sxx):
        starts = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | ~((y[1:] == y[:-1]) | (np.isnan(y[1:]) & np.isnan(y[:-1])))])
        f, (n, sx, sxx) = f[starts], (np.add.reduceat(v, starts) for v in (n, sx, sxx))
        for feature in np.unique(f):
            rows, x, xx = (v[f == feature] for v in (n, sx, sxx))
            had = sums.setdefault(feature, [0, 0.0, 0.0, 0.0, 0.0, 0.0])
            ry = had[0] + np.cumsum(rows) - rows + (rows + 1) / 2.0
            for i, v in enumerate((rows, x, xx, rows * ry, rows * ry * ry, x * ry)):
                had[i] += v.sum()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = rows if held is None else [np.concatenate(c) for c in zip(held, rows)]
        f, y = rows[:2]
        last = np.flatnonzero((f != f[-1]) | ~((y == y[-1]) | (np.isnan(y) & np.isnan(y[-1]))))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            told(*[c[:cut] for c in rows])
        held = [c[cut:] for c in rows]
    if held is not None:
        told(*held)
    for f, (rows, *rest) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([int(f)], pa.int32()), pa.array([part], pa.int32()), pa.array([int(rows)], pa.int64()),
                                          *[pa.array([float(v)]) for v in rest]], names=["f", "part", *RANKS])


def rank_correlation(df: DataFrame, columns: list[str], target: str, ranked: DataFrame | None = None) -> DataFrame:
    """Spearman correlation with average ranks on ties.

    Ranks of x come from ``ranked_pairs``, or from `ranked` where a caller has them, and are
    added up per value of y.  One range-partitioned sort by y follows; a partition needs no more
    than its own sums, since all its ranks of y grow alike by the rows of the partitions before."""
    ranked = ranked_pairs(df, columns, target) if ranked is None else ranked
    spark = ranked.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature")).cast("int") - 1
    rx = F.col("below") + (F.col("ties") + 1) / 2.0
    by_y = ranked.select(place.alias("f"), "y", "n", rx.alias("rx")).mapInArrow(_added, "f int, y double, n long, sx double, sxx double")
    parts = by_y.repartitionByRange(n, "f", "y").sortWithinPartitions("f", "y").mapInArrow(
        _ranked_in_part, "f int, part int, rows long, " + ", ".join(f"{c} double" for c in RANKS[1:]))
    # one row per partition and feature that it holds
    b = F.coalesce(F.sum("rows").over(Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = parts.select("f", "rows", "sx", "sxx", (F.col("sy") + b * F.col("rows")).alias("sy"), (F.col("sxy") + b * F.col("sx")).alias("sxy"),
                     (F.col("syy") + 2.0 * b * F.col("sy") + 1.0 * b * b * F.col("rows")).alias("syy"))
    n = F.sum("rows")
    mx, my = F.sum("sx") / n, F.sum("sy") / n
    cov = F.sum("sxy") / n - mx * my
    vx = F.sum("sxx") / n - mx * mx
    vy = F.sum("syy") / n - my * my
    both = F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))
    rho = F.coalesce(cov / F.sqrt(F.when(both > 0, both)), F.lit(0.0))
    names = F.array(*[F.lit(c) for c in columns])
    return j.groupBy("f").agg(n.alias("n"), F.when(n >= 10, rho).otherwise(0.0).alias("correlation")).select(
        names[F.col("f")].alias("feature"), "n", "correlation")


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10, ranked: DataFrame | None = None) -> DataFrame:
    """Mutual information in nats with the target, over equal-count bins of x.

    A value's bin follows from the number of smaller values (``ranked_pairs``, or `ranked`
    where a caller has them), so equal values share a bin.  The neighbour estimate is in
    operators/information.py."""
    ranked = ranked_pairs(df, columns, target) if ranked is None else ranked
    c = ranked.groupBy("feature", F.floor(F.col("below") * bins / F.col("total")).alias("bin"), "y").agg(F.sum("n").alias("n"))
    c = stored(c)
    by_bin = c.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_y = c.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = by_y.groupBy("feature").agg(F.sum("ny").alias("nt"))
    j = c.join(by_bin, ["feature", "bin"]).join(by_y, ["feature", "y"]).join(total, "feature")
    p = F.col("n") / F.col("nt")
    return j.groupBy("feature").agg(
        F.sum(p * F.ln(F.col("n") * F.col("nt") / (F.col("nb") * F.col("ny")))).alias("mutual_information"))


#: Rows whose products are summed at a time.
SLICE = 4096


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per two columns, over the rows where both are known: ``n`` and the sums ``sx, sy,
    sxx, syy, sxy``, each column counted from a value of its own near its median.

    One pass: a task adds up the products of all column pairs for its rows and gives one
    row a pair, which a shuffle by pair adds up."""
    known = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    # one row with a value per column
    near = known.agg(*[F.percentile_approx(F.col(c), 0.5, 100).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([0.0 if v is None else v for v in near])
    k = len(columns)

    def run(batches):
        n, s, q, p = np.zeros((4, k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns], axis=1)
                have = ~np.isnan(x)
                x, m = np.where(have, x - centre, 0.0), have.astype(float)
                n += np.einsum("ra,rb->ab", m, m)
                s += np.einsum("ra,rb->ab", x, m)
                q += np.einsum("ra,rb->ab", x * x, m)
                p += np.einsum("ra,rb->ab", x, x)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (
            i.astype(np.int32), j.astype(np.int32), n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j])], names=["i", "j", *MOMENTS])

    rows = known.mapInArrow(
        run, "i int, j int, " + ", ".join(f"{m} double" for m in MOMENTS))
    return rows.groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS])


MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def redundancy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Absolute Pearson correlation of every two features, long form, each over the rows
    where both are known.  A feature that does not vary there has no correlation."""
    n = F.when(F.col("n") > 0, F.col("n"))

    def spread(squares: str, total: str) -> Column:
        v = F.col(squares) - F.col(total) * F.col(total) / n
        return F.when(v > 1e-12 * F.col(squares), v)

    both = F.sqrt(spread("sxx", "sx")) * F.sqrt(spread("syy", "sy"))
    r = F.abs((F.col("sxy") - F.col("sx") * F.col("sy") / n) / both)
    m = pair_moments(df, columns).select("i", "j", F.when(r > 1, 1.0).otherwise(r).alias("correlation"))
    names = F.array(*[F.lit(c) for c in columns])
    sides = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    each = m.withColumn("e", F.explode(F.when(F.col("i") == F.col("j"), F.slice(sides, 1, 1)).otherwise(sides)))
    return each.select(names[F.col("e.a")].alias("feature"), names[F.col("e.b")].alias("other"), "correlation")


def max_redundancy(matrix: DataFrame) -> DataFrame:
    """Largest correlation with another feature, and that feature."""
    return matrix.filter("feature <> other").groupBy("feature").agg(
        F.max("correlation").alias("max_redundancy"),
        F.max_by("other", F.struct("correlation", "other")).alias("most_similar"))


def scaled_01(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min-max scaled copies ``{c}_01``; a constant column becomes 0.5."""
    # the extremes are one row
    ends = df.agg(*[e for c in columns for e in (F.min(c).alias(f"_{c}_lo"), F.max(c).alias(f"_{c}_hi"))])
    out = df.join(F.broadcast(ends))
    for c in columns:
        lo, hi = F.col(f"_{c}_lo"), F.col(f"_{c}_hi")
        out = out.withColumn(f"{c}_01", F.when(hi == lo, 0.5).otherwise(
            (F.col(c) - lo) / F.when(hi != lo, hi - lo)))
    return out.select(*df.columns, *[f"{c}_01" for c in columns])


def combined_scores(metrics: DataFrame) -> DataFrame:
    """Weighted score of a feature from its scaled metrics; with a precision
    drop .40/.30/.20/.10, without .45/.35/.20."""
    m = metrics.withColumn("_corr", F.abs("target_correlation"))
    names = ["_corr", "mutual_information", "max_redundancy"]
    with_drop = "precision_drop" in metrics.columns
    m = scaled_01(m, names + (["precision_drop"] if with_drop else []))
    corr, mi, calm = F.col("_corr_01"), F.col("mutual_information_01"), 1 - F.col("max_redundancy_01")
    score = 0.40 * F.col("precision_drop_01") + 0.30 * corr + 0.20 * mi + 0.10 * calm if with_drop \
        else 0.45 * corr + 0.35 * mi + 0.20 * calm
    return m.select(*metrics.columns, score.alias("combined_score"))


def metrics_table(df: DataFrame, columns: list[str], target: str, information=mutual_information) -> DataFrame:
    """Target correlation (ranks), mutual information and redundancy per feature;
    `information` is the estimate, by bins or operators/information.py by neighbours."""
    # computed once: four passes read the columns
    df = stored(df.select(*dict.fromkeys([*columns, target])))
    ranked = ranked_pairs(df, columns, target)
    told = information(df, columns, target, ranked=ranked) if information is mutual_information else information(df, columns, target)
    # one row per column of the table
    c = stored(rank_correlation(df, columns, target, ranked).select("feature", F.col("correlation").alias("target_correlation"))
               .join(told, "feature").join(max_redundancy(redundancy(df, columns)).select("feature", "max_redundancy"), "feature"))
    return c


def importance_report(df: DataFrame, columns: list[str], target: str, information=mutual_information) -> DataFrame:
    return combined_scores(metrics_table(df, columns, target, information)).orderBy(F.col("combined_score").desc(), "feature")


# --- model based ---------------------------------------------------------------------

#: Rounds of a shuffle of positions, and the modulus of its coins.
ROUNDS, PRIME = 24, 2_147_483_647
KEYS = "array<struct<mirror:long,a:long,b:long>>"


def shuffle_keys(seed, run: str, n: int) -> list[tuple[int, int, int]]:
    """The keys of a run's rounds: a mirror position and the two numbers of its coin."""
    digests = (hashlib.md5(f"{seed}:{run}:{i}".encode()).hexdigest() for i in range(ROUNDS))
    return [(int(d[:12], 16) % n, int(d[12:22], 16) % PRIME, int(d[22:], 16) % PRIME) for d in digests]


def shuffled(position: Column, n: int, keys: Column) -> Column:
    """A bijection of 0..n-1.  Each round pairs every position with its mirror image and
    swaps the pair if a coin of the larger of the two says so."""
    def step(p: Column, key: Column) -> Column:
        other = F.pmod(key["mirror"] - p, F.lit(n))
        x = (F.greatest(p, other) % PRIME * key["a"] + key["b"]) % PRIME
        x = (x * x + key["b"]) % PRIME
        return F.when(F.shiftright(x, 16) % 2 == 1, other).otherwise(p)

    return F.aggregate(keys, position.cast("long"), step)


def _modulo(x: np.ndarray) -> np.ndarray:
    """x % PRIME of numbers from 0 on; the prime is a power of two less one."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def shuffled_places(position: np.ndarray, n: int, keys: list[tuple[int, int, int]]) -> np.ndarray:
    """The same bijection for the positions of a batch.  A round undoes itself, so the keys
    in reverse order lead back."""
    out = np.empty(len(position), np.int64)
    for at in range(0, len(position), SLICE):
        p = position[at:at + SLICE].astype(np.int64)
        for mirror, a, b in keys:
            other = mirror - p
            other += n * (other < 0)
            x = _modulo(_modulo(np.maximum(p, other)) * a + b)
            x = _modulo(x * x + b)
            p = np.where((x >> 16) & 1, other, p)
        out[at:at + SLICE] = p
    return out


#: Positions that are filled together, and rows that are dealt out together.
BLOCK, DEALT = 1 << 16, 1 << 18
#: Scores of a run that are ranked together.
RANKED = 1 << 19
#: The bits of a missing value; a NaN has others.
MISSING = 0x7FF8000000000001


def _packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: those of the exponents take next to nothing."""
    return pa.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    got = pa.decompress(data, decompressed_size=8 * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(got, np.uint8).reshape(8, size).T).view(np.int64).ravel()


def _dealt(n: int, runs: list[tuple[int, list]]):
    """Rows in the order of their positions, as ``block, start, rows, size, data``: the values
    that ``rows`` positions from ``start`` on give to a block, run after run in the order of the
    positions.  A run is the number of its column and its keys.  The places need not be told:
    the block finds who gives to it."""
    blocks = -(-n // BLOCK)
    kind = np.uint16 if blocks <= 1 << 16 else np.int64

    def told(start: int, columns: list[np.ndarray]):
        at = np.arange(start, start + len(columns[0]))
        dealt = []
        for i, keys in runs:
            to = (shuffled_places(at, n, keys) // BLOCK).astype(kind)
            dealt.append((columns[i][np.argsort(to, kind="stable")], np.r_[0, np.cumsum(np.bincount(to, minlength=blocks))]))
        out = []
        for b in range(blocks):
            values = np.concatenate([v[e[b]:e[b + 1]] for v, e in dealt])
            if len(values):
                out.append((b, start, len(at), len(values), _packed(values)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 4, pa.binary()))], names=["block", "start", "rows", "size", "data"])

    def run(batches):
        start, held = 0, []
        for batch in batches:
            at, columns = batch.column(0).to_numpy(zero_copy_only=False), []
            for column in batch.columns[1:]:
                x = column.to_numpy(zero_copy_only=False).astype(float)
                bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
                columns.append(np.where(column.is_null().to_numpy(zero_copy_only=False), MISSING, bits))
            for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                if not len(rows):
                    continue
                have = sum(len(h[0]) for h in held)
                if held and (at[rows[0]] != start + have or have >= DEALT):
                    yield told(start, [np.concatenate(c) for c in zip(*held)])
                    held = []
                start = start if held else int(at[rows[0]])
                held.append([c[rows[0]:rows[-1] + 1] for c in columns])
        if held:
            yield told(start, [np.concatenate(c) for c in zip(*held)])

    return run


def _given(n: int, runs: list[tuple[int, list]]):
    """The rows of a block with ``_given``, the value that every run gives to a row."""
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        at, told = rows.column("_at").to_numpy(), told.sort_by("start")
        starts = told.column("start").to_numpy()
        ends = starts + told.column("rows").to_numpy()
        data = [_unpacked(d, s) for d, s in zip(told.column("data").to_pylist(), told.column("size").to_pylist())]
        used, out = np.zeros(len(data), np.int64), np.empty((len(at), len(runs)), np.int64)
        for r, (_, keys) in enumerate(runs):
            giver = shuffled_places(at, n, keys[::-1])
            order = np.argsort(giver)
            got = np.searchsorted(giver, ends, sorter=order) - np.searchsorted(giver, starts, sorter=order)
            out[order, r] = np.concatenate([d[u:u + g] for d, u, g in zip(data, used, got)])
            used += got
        values = pa.array(out.view(float).ravel(), pa.float64(), mask=(out == MISSING).ravel())
        return rows.drop_columns(["_block"]).append_column("_given", pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(runs), pa.int32()), values))

    return run


def permutation_importance(model, df: DataFrame, columns: list[str], row_id: list[str], target: str,
                           metric: str = "precision", repeats: int = 5, seed: int = 42, in_order: bool = False) -> DataFrame:
    """Mean drop of the metric when one feature is shuffled over all rows.

    `model` is a fitted model with a probability column, or a function of a table that
    gives the column of the probability.  Rows get one position by their identity; a
    keyed bijection of the positions says which row gives its value to which, for every
    feature and repeat.  Only those values move, packed by blocks of positions, in one
    exchange for all runs; the rows move once for their positions, not at all if the caller has
    them `in_order` of `row_id` over all partitions, and once by blocks."""
    from pyspark.ml.functions import vector_to_array

    from tickloom.operators import evaluate as E

    if metric not in ("precision", "auc"):
        raise ValueError("metric must be precision or auc")

    def scored(rows: DataFrame, by: str) -> DataFrame:
        if callable(getattr(model, "transform", None)):
            rows, prob = model.transform(rows), vector_to_array("probability")[1]
        else:
            prob = model(rows)
        return rows.select(F.col(by).alias("run_id"), F.col(target).alias("label"), prob.alias("prob"))

    placed = running_totals(df, [], [] if in_order else [F.col(i) for i in row_id], {"_at": F.lit(1)})
    n = placed.count()
    runs = [(i, shuffle_keys(seed, f"{c}:{k}", n)) for i, c in enumerate(columns) for k in range(repeats)] if n else []
    before = scored(placed.withColumn("_run", F.lit("all")), "_run")
    parts = -(-n // RANKED)
    # one row; the scores of the runs are about as the first ones
    cuts = before.agg(F.percentile_approx("prob", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if metric == "auc" and parts > 1 else []

    def score(p: DataFrame) -> DataFrame:
        if metric == "auc":
            return E.roc_auc(p, cuts or []).select("run_id", F.col("auc").alias("score"))
        return E.with_rates(E.confusion(p)).select("run_id", F.col("precision").alias("score"))

    told = placed.select("_at", *[F.col(c).cast("double") for c in columns]).mapInArrow(
        _dealt(n, runs), "block long, start long, rows long, size long, data binary")
    blocks = placed.withColumn("_block", F.floor(F.col("_at") / BLOCK))
    given = blocks.groupBy("_block").cogroup(told.groupBy("block")).applyInArrow(
        _given(n, runs), T.StructType([*placed.schema.fields, T.StructField("_given", T.ArrayType(T.DoubleType()))]))
    rows = given.select(*placed.columns, F.posexplode("_given").alias("_r", "_x")).withColumns({"_run": F.col("_r"), **{
        c: F.when(F.floor(F.col("_r") / repeats) == i, F.col("_x")).otherwise(F.col(c)) for i, c in enumerate(columns)}})
    baseline = score(before).select(F.col("score").alias("baseline"))
    got = score(scored(rows, "_run")).join(F.broadcast(baseline))       # one row
    names = F.array(*[F.lit(c) for c in columns])
    return got.groupBy(names[F.floor(F.col("run_id") / repeats).cast("int")].alias("feature")).agg(
        F.avg(F.col("baseline") - F.col("score")).alias("importance"))


def stability(importances: DataFrame) -> DataFrame:
    """Mean, sample sigma and their ratio per feature over seeds; a zero mean
    counts as 1."""
    m = F.avg("importance")
    return importances.groupBy("feature").agg(
        m.alias("mean_importance"), F.stddev_samp("importance").alias("std_importance"),
        (F.stddev_samp("importance") / F.when(m != 0, m).otherwise(1.0)).alias("cv_importance"))


def boosted_baseline(df: DataFrame, columns: list[str], target: str, train: Column, trees: int = 20,
                     depth: int = 4, seed: int = 42) -> DataFrame:
    """Gradient-boosted trees fitted on the training rows: AUC and prediction
    range on the rest."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tickloom.operators import evaluate as E

    data = VectorAssembler(inputCols=columns, outputCol="features").transform(df.dropna(subset=[*columns, target]))
    data = data.withColumn("label", F.col(target).cast("double"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed).fit(data.filter(train))
    p = model.transform(data.filter(~train)).select(
        F.lit(target).alias("run_id"), vector_to_array("probability")[1].alias("prob"),
        F.col("label").cast("int").alias("label"))
    return E.detailed(p)


# --- grades -----------------------------------------------------------------------------

def grade(metric: str) -> Column:
    good, fair = LIMITS[metric]
    x = F.col(metric)
    if metric == "target_correlation":
        x = F.abs(x)
    if metric in LOWER_IS_BETTER:
        return F.when(x < good, "pass").when(x < fair, "marginal").otherwise("fail")
    return F.when(x >= good, "pass").when(x >= fair, "marginal").otherwise("fail")


def _worst(grades: list[Column]) -> Column:
    any_of = F.array(*grades)
    return F.when(F.array_contains(any_of, "fail"), "fail").when(
        F.array_contains(any_of, "marginal"), "marginal").otherwise("pass")


def assess(metrics: DataFrame) -> DataFrame:
    """A grade per metric and the worst of them."""
    have = [m for m in LIMITS if m in metrics.columns]
    out = metrics.withColumns({f"{m}_grade": grade(m) for m in have})
    return out.withColumn("overall_verdict", _worst([F.col(f"{m}_grade") for m in have]))


def with_verdict_at_least(assessed: DataFrame, verdict: str = "pass") -> DataFrame:
    order = F.create_map(*[F.lit(v) for v in ("fail", 0, "marginal", 1, "pass", 2)])
    return assessed.filter(order[F.col("overall_verdict")] >= order[F.lit(verdict)])


def quality_report(assessed: DataFrame) -> DataFrame:
    v = F.col("overall_verdict")
    return assessed.agg(
        F.count(F.lit(1)).alias("total_features"), F.count_if(v == "pass").alias("pass_count"),
        F.count_if(v == "marginal").alias("marginal_count"), F.count_if(v == "fail").alias("fail_count"),
        F.coalesce(F.avg((v == "pass").cast("double")), F.lit(0.0)).alias("pass_rate"))


# --- curation -----------------------------------------------------------------------------

def category(name: str = "feature") -> Column:
    """First category with a keyword inside the name."""
    low = F.lower(F.col(name))
    out = None
    for cat, words in CATEGORY_KEYWORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, cat) if out is None else out.when(hit, cat)
    return out.otherwise("other")


def removal_round(scores: DataFrame, fraction: float = 0.1, score: str = "combined_score") -> DataFrame:
    """``removed`` for the worst max(1, floor(n * fraction)) features, while a
    category keeps its minimum.  The table has one row per column of a feature
    table, so its ranks fit one task."""
    least = F.lit(1)
    for cat, k in CATEGORY_MINIMUMS.items():
        least = F.when(F.col("category") == cat, k).otherwise(least)
    by_cat, whole = Window.partitionBy("category"), Window.partitionBy(F.lit(0))
    d = scores.withColumn("category", category())
    d = d.select("*", F.row_number().over(by_cat.orderBy(score, "feature")).alias("_r"),
                 F.count(F.lit(1)).over(by_cat).alias("_n"), F.count(F.lit(1)).over(whole).alias("_all"),
                 least.alias("_least"))
    d = d.withColumn("_may_go", F.col("_r") <= F.col("_n") - F.col("_least"))
    order = whole.orderBy(F.col("_may_go").desc(), score, "feature")
    d = d.withColumn("_o", F.row_number().over(order))
    quota = F.greatest(F.lit(1), F.floor(F.col("_all") * fraction))
    return d.withColumn("removed", F.col("_may_go") & (F.col("_o") <= quota)).select(
        *scores.columns, "category", "removed")


# fixed limits of the ratio to the baseline: (maintain, warning)
KEEP = {"precision": (0.95, 0.90), "recall": (0.90, 0.80), "auc": (0.95, 0.90)}
RANGE_KEEP = (0.10, 0.05)


def validate_reduction(runs: DataFrame) -> DataFrame:
    """Results against the baseline columns ``base_*``: maintain, warning or
    abort per metric, the worst of them, and the next removal step."""
    def band(x, limits):
        return F.when(x >= limits[0], "maintain").when(x >= limits[1], "warning").otherwise("abort")

    out, names = runs, []
    for m, limits in KEEP.items():
        base = F.col(f"base_{m}")
        r = F.col(m) / F.when(base != 0, base)
        out = out.withColumns({
            f"{m}_ratio": F.coalesce(F.when(base > 0, r), F.lit(1.0)),
            f"{m}_result": F.when(base == 0, F.when(F.col(m) >= 0, "maintain").otherwise("warning"))
            .otherwise(band(r, limits))})
        names.append(F.col(f"{m}_result"))
    out = out.withColumn("pred_range_result", band(F.col("pred_range"), RANGE_KEEP))
    results = F.array(*names, F.col("pred_range_result"))
    overall = F.when(F.array_contains(results, "abort"), "abort").when(
        F.array_contains(results, "warning"), "warning").otherwise("maintain")
    out = out.withColumn("overall_result", overall)
    return out.withColumns({
        "continue": F.col("overall_result") != "abort",
        "next_fraction": F.when(F.col("overall_result") == "maintain", 0.10).when(
            F.col("overall_result") == "warning", 0.05).otherwise(0.0)})


def feature_check(df: DataFrame, feature: str, target: str, existing: list[str], warm_up: int = 252) -> DataFrame:
    """Nulls after the warm-up rows, infinities, constancy, signal and redundancy
    of one feature, each with a verdict, and the worst of them."""
    from tickloom.functions import frames as W

    d = df.withColumn("_pos", W.row_index())
    x = F.col(feature)
    basic = d.agg(
        F.count_if(x.isNull() & (F.col("_pos") > warm_up)).alias("null_after_warm_up"),
        F.count_if(F.abs(x) == float("inf")).alias("inf_count"),
        F.min(x).alias("min_value"), F.max(x).alias("max_value"))
    metrics = metrics_table(df, [feature, *existing], target).filter(F.col("feature") == feature)
    out = basic.join(F.broadcast(assess(metrics)))         # one row each
    data = F.when((F.col("null_after_warm_up") == 0) & (F.col("inf_count") == 0)
                  & (F.col("min_value") < F.col("max_value")), "pass").otherwise("fail")
    signal = _worst([F.col("target_correlation_grade"), F.col("mutual_information_grade")])
    return out.drop("overall_verdict").withColumns({
        "data_verdict": data, "signal_verdict": signal,
        "verdict": _worst([data, signal, F.col("max_redundancy_grade")])})
