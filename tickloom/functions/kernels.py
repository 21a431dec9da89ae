"""Whole-window kernels: one array per row in, one number per row out.

Rows are independent, so these run as Arrow batches wherever the rows already
are; no grouping and no shuffle is added.  Each kernel works on the matrix of a
batch's windows at once.  A window is an array from a bounded frame, 5 to 40
values long."""

from __future__ import annotations

from math import factorial, log

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _rowwise(fn, col: Column) -> Column:
    """Apply a matrix kernel to an array column; null windows stay null."""
    def run(s: pd.Series) -> pd.Series:
        out = np.full(len(s), np.nan)
        known = s.notna().to_numpy()
        if known.any():
            with np.errstate(all="ignore"):
                out[known] = fn(np.stack(s[known].to_numpy()))
        out[~np.isfinite(out)] = np.nan
        return pd.Series(out)
    return F.nullif(F.pandas_udf(run, "double")(col), F.lit(float("nan")))


def _embed(x, m):
    """All runs of m neighbours: (rows, n-m+1, m)."""
    return np.lib.stride_tricks.sliding_window_view(x, m, axis=1)


def _entropy_of(p):
    return -(p * np.log(np.where(p > 0, p, 1.0))).sum(axis=1)


def _line_slope(t, y):
    """Least-squares slope of every row of y on the common abscissa t."""
    d = t - t.mean()
    return (y * d).sum(axis=-1) / (d * d).sum()


def permutation(order):
    def fn(x):
        rank = _embed(x, order).argsort(axis=2, kind="stable")
        code = np.sort((rank * order ** np.arange(order)).sum(axis=2), axis=1)
        total = code.shape[1]
        # a run of equal codes is one pattern; weigh each member by its run length
        same = (code[:, :, None] == code[:, None, :]).sum(axis=2)
        return -(np.log(same / total)).sum(axis=1) / total / log(factorial(order)) + 0.0
    return fn


def _pair_distance(x, m, templates):
    """Largest coordinate difference between every two templates."""
    e = _embed(x, m)[:, :templates]
    return np.abs(e[:, :, None, :] - e[:, None, :, :]).max(axis=3)


def _matches(x, m, templates, tol):
    d = _pair_distance(x, m, templates)
    return ((d < tol[:, None, None]).sum(axis=(1, 2)) - templates) / 2


def sample_entropy(m=2, r=0.2):
    """Matches of length m+1 are counted over one template less than length m;
    a flat window or a missing match gives 0."""
    def fn(x):
        n, sd = x.shape[1], x.std(axis=1)
        b = _matches(x, m, n - m, r * sd)
        a = _matches(x, m + 1, n - m - 1, r * sd)
        ok = (sd > 0) & (a > 0) & (b > 0)
        return np.where(ok, -np.log(np.where(ok, a, 1) / np.where(ok, b, 1)) + 0.0, 0.0)
    return fn


def sample_entropy_standard(m=2, r=0.2):
    """Both lengths over the same n-m templates; no match leaves it unknown."""
    def fn(x):
        n, sd = x.shape[1], x.std(axis=1)
        b, a = _matches(x, m, n - m, r * sd), _matches(x, m + 1, n - m, r * sd)
        return -np.log(a / b) + 0.0
    return fn


def approximate_entropy(m=2, r=0.2, floor=True):
    def fn(x):
        n, sd = x.shape[1], x.std(axis=1)

        def phi(k):
            near = _pair_distance(x, k, n - k + 1) <= (r * sd)[:, None, None]
            return np.log(near.mean(axis=2)).mean(axis=1)
        out = phi(m) - phi(m + 1)
        return np.where(sd > 0, np.maximum(out, 0.0) if floor else out, 0.0)
    return fn


def spectral_entropy(x):
    power = np.abs(np.fft.fft(x, axis=1))[:, 1:x.shape[1] // 2 + 1] ** 2
    total = power.sum(axis=1)
    p = np.maximum(power / np.where(total == 0, 1, total)[:, None], 1e-10)
    return np.where(total == 0, 0.5, -(p * np.log(p)).sum(axis=1) / log(power.shape[1]))


def curve_length_dimension(k_max, by_steps, clip):
    """Higuchi's dimension: slope of log curve length against log(1/k).

    ``by_steps`` divides each curve by its own number of steps."""
    def fn(x):
        n = x.shape[1]
        lengths = []
        for k in range(1, k_max + 1):
            curves = []
            for start in range(k):
                part = x[:, start::k]
                steps = part.shape[1] - 1
                if steps:
                    curves.append(np.abs(np.diff(part, axis=1)).sum(axis=1)
                                  * (n - 1) / (k * steps * k))
            lengths.append(np.sum(curves, axis=0) / k)
        y = np.stack(lengths, axis=1)
        t = -np.log(np.arange(1, k_max + 1))
        flat = (y <= 0).any(axis=1)
        slope = _line_slope(t, np.log(np.where(y > 0, y, 1.0)))
        if clip:
            return np.where(flat, 1.5, np.clip(slope, 1, 2))
        return np.where(flat, np.nan, slope)
    return fn


def katz(x):
    """log10(steps) / (log10(steps) + log10(extent / path))."""
    path = np.abs(np.diff(x, axis=1)).sum(axis=1)
    extent = np.abs(x - x[:, :1]).max(axis=1)
    steps = np.log10(x.shape[1] - 1)
    return steps / (steps + np.log10(extent / path))


def petrosian(x):
    n = x.shape[1]
    turns = np.diff(np.signbit(np.diff(x, axis=1)).astype(int), axis=1) != 0
    return np.log10(n) / (np.log10(n) + np.log10(n / (n + 0.4 * turns.sum(axis=1))))


def _detrended(seg):
    """Residuals of every segment from its own straight line."""
    t = np.arange(seg.shape[-1])
    d = t - t.mean()
    centred = seg - seg.mean(axis=-1, keepdims=True)
    return centred - _line_slope(t, seg)[..., None] * d


def dfa_exponent(x):
    """Detrended fluctuation: mean residual size of half-overlapping boxes of 4
    to 9 steps of the walk, slope of its logarithm on the box size."""
    walk = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1)
    sizes = np.arange(4, 10)
    size_mean = []
    for s in sizes:
        boxes = _embed(walk, s)[:, 0:walk.shape[1] - s:s // 2]
        size_mean.append(np.sqrt((_detrended(boxes) ** 2).mean(axis=2)).mean(axis=1))
    alpha = _line_slope(np.log(sizes), np.log(np.stack(size_mean, axis=1)))
    return np.where(alpha > 0, alpha, np.nan)


def crossover_scale(x):
    """Middle one of the segment lengths 4, 6, 8 when all leave a residual."""
    usable = np.ones(len(x), bool)
    for s in (4, 6, 8):
        seg = x[:, :x.shape[1] // s * s].reshape(len(x), -1, s)
        usable &= _detrended(seg).var(axis=2).mean(axis=1) > 0
    return np.where(usable, 6.0, np.nan)


def rescaled_range(x):
    """log(range of the centred walk / sample spread) / log(n), within 0..1."""
    walk = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1)
    r, s = walk.max(axis=1) - walk.min(axis=1), x.std(axis=1, ddof=1)
    h = np.log(r / s) / log(x.shape[1])
    return np.where((s > 0) & (r > 0), np.clip(h, 0, 1), np.nan)


def apply(kernel, col: Column) -> Column:
    return _rowwise(kernel, col)
