"""Sample augmentation, difficulty and market regimes.

A sample is an array of values (``x``) with an id; randomness comes from hashes
of that id, so a repeated task draws the same numbers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import frames as W
from tickloom.functions.binding import bound
from tickloom.functions.hashing import digest, normal, uniform
from tickloom.functions.ranking import quantiles
from tickloom.sources.tables import stored

ID = ("key", "ts")


def _ids() -> list[Column]:
    return [F.col(c) for c in ID]


# --- augmentation ------------------------------------------------------------------

def jitter(df: DataFrame, std: float = 0.01, prob: float = 0.5, seed: int = 42) -> DataFrame:
    """Normal noise on every value of a chosen sample."""
    chosen = uniform(f"{seed}j", *_ids()) <= prob
    noisy = F.transform("x", lambda v, i: v + std * normal(seed, *_ids(), i))
    return df.withColumn("x", F.when(chosen, noisy).otherwise(F.col("x")))


def scale(df: DataFrame, scale_range: float = 0.1, prob: float = 0.5, seed: int = 42) -> DataFrame:
    """One factor within 1 +- ``scale_range`` for a chosen sample."""
    chosen = uniform(f"{seed}s", *_ids()) <= prob
    factor = 1 + (uniform(seed, *_ids()) * 2 - 1) * scale_range
    scaled = bound(factor, lambda f: F.transform("x", lambda v: v * f))
    return df.withColumn("x", F.when(chosen, scaled).otherwise(F.col("x")))


def scale_features(df: DataFrame, columns: list[str], scale_range: float = 0.1, prob: float = 0.5,
                   seed: int = 42) -> DataFrame:
    """As ``scale``, with an own factor for each of several array columns."""
    chosen = uniform(f"{seed}s", *_ids()) <= prob

    def one(c):
        factor = 1 + (uniform(f"{seed}{c}", *_ids()) * 2 - 1) * scale_range
        return F.when(chosen, bound(factor, lambda f: F.transform(c, lambda v: v * f))).otherwise(F.col(c))
    return df.withColumns({c: one(c) for c in columns})


def mixup(df: DataFrame, alpha: float = 0.2, prob: float = 0.5, seed: int = 42) -> DataFrame:
    """Blend each sample of a key with the one that a shuffle of the key's samples
    puts in its place; one weight, Beta(alpha, alpha), per key."""
    @F.pandas_udf("double")
    def beta(h: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(int(v[:15], 16)).beta(alpha, alpha) for v in h])

    weights = df.select("key").distinct().withColumn("_lam", F.when(
        uniform(f"{seed}m", F.col("key")) <= prob,
        beta(digest(seed, F.col("key"))) if alpha > 0 else F.lit(1.0)).otherwise(1.0))
    own = Window.partitionBy("key").orderBy("ts")
    mixed = Window.partitionBy("key").orderBy(digest(seed, *_ids()))
    left = df.withColumn("_r", F.row_number().over(own))
    right = df.select("key", F.col("x").alias("_x2"), F.col("label").alias("_y2"),
                      F.row_number().over(mixed).alias("_r"))
    j = left.join(right, ["key", "_r"]).join(weights, "key")
    lam = F.col("_lam")
    return j.select("key", "ts", F.zip_with("x", "_x2", lambda a, b: lam * a + (1 - lam) * b).alias("x"),
                    (lam * F.col("label") + (1 - lam) * F.col("_y2")).alias("label"), lam.alias("lam"))


def time_warp(df: DataFrame, length: int, warp: float = 0.1, knots: int = 4, prob: float = 0.5,
              seed: int = 42) -> DataFrame:
    """Read a chosen sample at displaced times, with linear interpolation.

    Inner knots move by up to ``warp``; the time between knots is stretched."""
    grid = [i / (knots + 1) for i in range(knots + 2)]
    moved = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), grid[k]
             + (uniform(f"{seed}k{k}", *_ids()) * 2 - 1) * warp)) for k in range(1, knots + 1)]
    path = F.concat(F.array(F.lit(0.0)), F.array_sort(F.array(*moved)), F.array(F.lit(1.0)))

    steps = []
    for i in range(length):
        t = i / float(max(length - 1, 1))
        k = min(int(t * (knots + 1)), knots)
        steps.append(F.struct(F.lit(k + 1).alias("k"), F.lit(t * (knots + 1) - k).alias("share")))

    def times(p):
        return F.transform(F.array(*steps), lambda s: (
            F.element_at(p, s["k"]) * (1 - s["share"]) + F.element_at(p, s["k"] + 1) * s["share"]) * (length - 1))

    def read(at):
        def between(low):
            w = at - low
            return F.element_at("x", low + 1) * (1 - w) + F.element_at("x", F.least(F.lit(length - 1), low + 1) + 1) * w
        return bound(F.greatest(F.lit(0), F.least(F.lit(length - 1), F.floor(at).cast("int"))), between)
    chosen = uniform(f"{seed}w", *_ids()) <= prob
    # the times are bound before they are read: one path and one time per position
    warped = bound(bound(path, times), lambda ats: F.transform(ats, read))
    return df.withColumn("x", F.when(chosen, warped).otherwise(F.col("x")))


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df
    return run


# --- difficulty ---------------------------------------------------------------------

def _window_returns(close: str, context: int, absolute: bool):
    """Mean-free spread of the context's own returns: the first row of a context
    has no return inside it."""
    prev = W.lag(close)
    base = F.abs(prev) if absolute else prev
    return (F.col(close) - prev) / (base + 1e-8), W.frame(-context + 2)


def volatility_difficulty(bars: DataFrame, context: int, close: str = "close") -> DataFrame:
    """Population sigma of the returns inside each full context."""
    r, w = _window_returns(close, context, False)
    d = bars.select("key", "ts", r.alias("_r"), W.row_index().alias("_n"))
    return d.select("key", "ts", "_n", F.stddev_pop("_r").over(w).alias("difficulty")) \
        .filter(F.col("_n") >= context).drop("_n")


def confidence_difficulty(prob: str = "prob") -> Column:
    return 1 - F.greatest(F.col(prob), 1 - F.col(prob))


def loss_difficulty(prob: str = "prob", label: str = "label") -> Column:
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col(prob)))
    return -(F.col(label) * F.ln(p) + (1 - F.col(label)) * F.ln(1 - p))


def curriculum(scored: DataFrame, epoch: int, initial: float = 0.3, growth: float = 0.1, seed: int = 42,
               hardest: bool = False) -> DataFrame:
    """The easiest (or hardest) share of each key's samples, in hash order.

    The share is initial + epoch * growth, at most 1, at least one sample."""
    share = min(1.0, initial + epoch * growth)
    by_key = Window.partitionBy("key")
    d = F.col("difficulty").desc() if hardest else F.col("difficulty").asc()
    r = scored.select("*", F.row_number().over(by_key.orderBy(d, "ts")).alias("_rank"),
                      F.count(F.lit(1)).over(by_key).alias("_n"))
    kept = r.filter(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share)))
    order = F.row_number().over(by_key.orderBy(digest(seed + epoch, *_ids())))
    return kept.select(*scored.columns, order.alias("position"))


# --- regimes -------------------------------------------------------------------------

def volatility_regime(bars: DataFrame, context: int, low: float = 0.01, high: float = 0.02) -> DataFrame:
    r, w = _window_returns("close", context, True)
    d = bars.select("key", "ts", r.alias("_r"), W.row_index().alias("_n"))
    v = F.stddev_pop("_r").over(w)
    d = d.select("key", "ts", "_n", v.alias("volatility")).filter(F.col("_n") >= context).drop("_n")
    return d.withColumn("regime", F.when(F.col("volatility") < low, 0).when(
        F.col("volatility") < high, 1).otherwise(2))


def trend_regime_sma(bars: DataFrame, short: int = 10, long: int = 30, band: float = 0.02) -> DataFrame:
    """2 up, 0 down, 1 flat or too short a context."""
    d = bars.select("key", "ts", W.mean("close", short).alias("_s"), W.mean("close", long).alias("_l"))
    gap = (F.col("_s") - F.col("_l")) / (F.col("_l") + 1e-8)
    return d.select("key", "ts", gap.alias("gap"), F.when(gap > band, 2).when(gap < -band, 0)
                    .otherwise(1).alias("regime"))


def trend_regime_adx(bars: DataFrame, context: int = 30, long: int = 30, threshold: float = 25.0) -> DataFrame:
    """Share of one-sided movement inside the context against a threshold."""
    r, w = _window_returns("close", context, True)
    d = bars.select("key", "ts", r.alias("_r"), W.row_index().alias("_n"))
    up = F.coalesce(F.sum(F.when(F.col("_r") > 0, F.col("_r"))).over(w), F.lit(0.0))
    down = F.coalesce(F.abs(F.sum(F.when(F.col("_r") < 0, F.col("_r"))).over(w)), F.lit(0.0))
    d = d.select("key", "ts", "_n", up.alias("_up"), down.alias("_down")).filter(F.col("_n") >= context)
    total = F.col("_up") + F.col("_down")
    strength = F.when(total >= 1e-8, F.abs(F.col("_up") - F.col("_down")) / F.when(total != 0, total) * 100)
    regime = F.when(F.lit(context < long) | strength.isNull() | (strength < threshold), 1) \
        .when(F.col("_up") > F.col("_down"), 2).otherwise(0)
    return d.select("key", "ts", strength.alias("strength"), regime.alias("regime"))


def cluster_features(bars: DataFrame, context: int, column: str = "close") -> DataFrame:
    """Mean, population sigma and slope of the context."""
    w = W.frame(-context + 1)
    d = bars.select("key", "ts", F.col(column).alias("_x"), W.row_index().alias("_n"))
    return d.select("key", "ts", "_n", F.avg("_x").over(w).alias("mean"), F.stddev_pop("_x").over(w).alias("sd"),
                    F.regr_slope("_x", F.col("_n").cast("double")).over(w).alias("slope")) \
        .filter(F.col("_n") >= context).drop("_n")


def _nearest(centres: list[tuple[float, ...]], names: tuple[str, ...]) -> Column:
    """The index of the nearest centre; of equal distances the first."""
    each = [F.struct(sum((F.pow(F.col(n) - float(v), 2) for n, v in zip(names, c)), F.lit(0.0)).alias("d"), F.lit(i).alias("i"))
            for i, c in enumerate(centres)]
    return F.least(*each)["i"]


def cluster_regime(features: DataFrame, k: int = 3, rounds: int = 20) -> DataFrame:
    """k-means over mean, sigma and slope; regimes are numbered by mean.

    Deterministic: the first centres have the k middle quantiles of the mean and the
    average sigma and slope; a round is one aggregate, which gives the driver k centres,
    and rounds end when none moves.  A centre without rows stays where it is."""
    names = ("mean", "sd", "slope")
    rows = stored(features)
    known = rows.dropna(subset=list(names))
    probs = {f"p{i}": (2 * i + 1) / (2 * k) for i in range(k)}
    start = quantiles(known, [], "mean", probs).first()
    if start is None or start["p0"] is None:
        return rows.withColumn("regime", F.lit(None).cast("int"))
    rest = known.agg(F.avg("sd").alias("sd"), F.avg("slope").alias("slope")).first()
    centres = [(start[f"p{i}"], rest["sd"], rest["slope"]) for i in range(k)]
    for _ in range(rounds):
        got = known.groupBy(_nearest(centres, names).alias("c")).agg(*[F.avg(n).alias(n) for n in names]).collect()
        moved = list(centres)
        for r in got:
            moved[r["c"]] = tuple(r[n] for n in names)
        if moved == centres:
            break
        centres = moved
    centres.sort()
    complete = F.col("mean").isNotNull() & F.col("sd").isNotNull() & F.col("slope").isNotNull()
    return rows.withColumn("regime", F.when(complete, _nearest(centres, names)))


def regime_weights(regimes: DataFrame, weights: dict[int, float]) -> DataFrame:
    """A weight per regime, 1 where none is given."""
    if not weights:
        return regimes.withColumn("weight", F.lit(1.0))
    table = F.create_map(*[F.lit(v) for pair in weights.items() for v in (pair[0], float(pair[1]))])
    return regimes.withColumn("weight", F.coalesce(table[F.col("regime")], F.lit(1.0)))
