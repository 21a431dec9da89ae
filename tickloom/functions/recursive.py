"""Recursions over time, one Arrow task call per key.

Recurrences whose state depends on their own previous value live here:
exponential and Wilder averages, the adaptive average, the trailing-stop state machine.
Statistics of long windows (functions/rolling.py) run in the same pass; short ones are
window expressions.  A key is one
row per day (see frames.py), so a call holds a few thousand rows.

Two seeding families are kept apart.  ``ewm`` starts at the first value.  The
``ema``/``wilder`` family starts at the plain mean of its first n values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.functions.rolling import ROLLING


def _first_valid(x: np.ndarray) -> int:
    ok = ~np.isnan(x)
    return int(ok.argmax()) if ok.any() else len(x)


def _smooth(x: np.ndarray, alpha: float, at: int, seed: float) -> np.ndarray:
    """y[at] = seed, then y += alpha * (x - y)."""
    out = np.full(len(x), np.nan)
    if at < len(x):
        tail = x[at:].copy()
        tail[0] = seed
        out[at:] = pd.Series(tail).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return out


def ema(x, n, at=None):
    """Mean-seeded exponential average; ``at`` moves the seed to a later row."""
    s = _first_valid(x) + n - 1 if at is None else at
    return _smooth(x, 2.0 / (n + 1), s, x[s - n + 1:s + 1].mean() if s < len(x) else 0.0)


def ewm(x, span, min_periods=1):
    return pd.Series(x).ewm(span=span, adjust=False, min_periods=min_periods).mean().to_numpy()


def wilder(x, n):
    s = _first_valid(x) + n - 1
    return _smooth(x, 1.0 / n, s, x[s - n + 1:s + 1].mean() if s < len(x) else 0.0)


def decayed_sum(x, n):
    """s = s - s/n + x, started with the sum of the first n-1 values."""
    s = _first_valid(x) + n - 2
    return n * _smooth(x, 1.0 / n, s, x[s - n + 2:s + 1].sum() / n if s < len(x) else 0.0)


def directional_index(plus, minus, tr, n):
    """Wilder average of 100*|DI+ - DI-|/(DI+ + DI-) from the smoothed sums."""
    p, m, t = decayed_sum(plus, n), decayed_sum(minus, n), decayed_sum(tr, n)
    out = np.full(len(p), np.nan)
    start = _first_valid(t) + 1
    if start + n > len(p):
        return out
    both = p + m
    usable = (both > 0) & (t > 0)
    dx = np.divide(100 * np.abs(p - m), both, out=np.zeros(len(p)), where=usable)
    # a bar without movement keeps the average as it was
    keep = np.flatnonzero(usable[start + n:]) + start + n
    seed = dx[start:start + n].mean()
    vals = _smooth(np.concatenate([[seed], dx[keep]]), 1.0 / n, 0, seed)
    out[start + n - 1] = seed
    out[keep] = vals[1:]
    out[start + n - 1:] = pd.Series(out[start + n - 1:]).ffill().to_numpy()
    return out


def adaptive(x, n):
    """Efficiency-ratio weighted average with fast 2/(2+1) and slow 2/(30+1)."""
    out = np.full(len(x), np.nan)
    if len(x) <= n:
        return out
    move = x[n:] - x[:-n]
    path = np.convolve(np.abs(np.diff(x)), np.ones(n), "valid")
    er = np.where((path <= move) | (path == 0), 1.0, np.abs(move) / np.where(path == 0, 1, path))
    weight = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
    y = x[n - 1]
    for i, (w, v) in enumerate(zip(weight.tolist(), x[n:].tolist())):
        y += (v - y) * w
        out[n + i] = y
    return out


def trailing_stop(close, upper, lower, at, bearish_start):
    """Band-following stop line; returns (line, side).

    ``bearish_start`` starts on the upper band and compares with the moved
    band; otherwise it starts on the lower band and compares with the line."""
    n = len(close)
    line, side = np.full(n, np.nan), np.full(n, np.nan)
    if at >= n:
        return line, side
    s, d = (upper[at], -1.0) if bearish_start else (lower[at], 1.0)
    line[at], side[at] = s, d
    bars = zip(close[at + 1:].tolist(), upper[at + 1:].tolist(), lower[at + 1:].tolist())
    for i, (c, u, lo) in enumerate(bars, at + 1):
        if not bearish_start:
            s, d = (max(lo, s), 1.0) if c > s else (min(u, s), -1.0)
        elif d > 0:
            s = max(lo, s)
            if c < s:
                s, d = u, -1.0
        else:
            s = min(u, s)
            if c > s:
                s, d = lo, 1.0
        line[i], side[i] = s, d
    return line, side


def stop_line(close, upper, lower, at, bearish_start=False):
    return trailing_stop(close, upper, lower, at, bearish_start)[0]


def stop_side(close, upper, lower, at, bearish_start=False):
    return trailing_stop(close, upper, lower, at, bearish_start)[1]


def double_stochastic(x, n, span):
    """Stochastic of x, smoothed, twice; a flat or short window counts as 50."""
    s = pd.Series(x)
    for _ in range(2):
        lo, width = s.rolling(n).min(), s.rolling(n).max() - s.rolling(n).min()
        s = ((s - lo) / width.where(width != 0) * 100).fillna(50)
        s = s.ewm(span=span, adjust=False).mean()
    return s.clip(0, 100).to_numpy()


def difference(x, y):
    return x - y


def band(mid, size, width):
    return mid + width * size


def strength(gain, loss):
    both = gain + loss
    return np.where(both == 0, 0.0, 100 * gain / np.where(both == 0, 1.0, both))


def where_known(x, y):
    return np.where(np.isnan(y), np.nan, x)


def compound(x, start):
    return start * np.cumprod(1.0 + np.nan_to_num(x))


KERNELS = {f.__name__: f for f in (
    ema, ewm, wilder, decayed_sum, directional_index, adaptive, stop_line, stop_side,
    double_stochastic, difference, band, strength,
    where_known, compound)} | ROLLING


def scan(df: DataFrame, steps: list[tuple[str, str, tuple, dict]]) -> DataFrame:
    """Append the recursive columns ``(name, kernel, inputs, parameters)``.

    Later steps may read earlier ones.  All of them run in one grouped pass, so
    the stage costs one shuffle by key however many columns it adds."""
    fields = [T.StructField(name, T.DoubleType()) for name, *_ in steps]
    schema = T.StructType(df.schema.fields + fields)

    def per_key(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        known: dict[str, np.ndarray] = {}

        def column(name):
            if name not in known:
                col = table.column(name)
                known[name] = col.to_numpy().astype(float)
            return known[name]

        for name, kernel, inputs, params in steps:
            with np.errstate(all="ignore"):
                known[name] = KERNELS[kernel](*[column(i) for i in inputs], **params)
            table = table.append_column(
                name, pa.array(known[name], type=pa.float64(), from_pandas=True))
        return table

    return df.groupBy("key").applyInArrow(per_key, schema)
