"""Statistics of trailing windows, over the whole series of a key at once.

These run inside the grouped Arrow pass of ``recursive.scan`` and hold a few arrays of a
key's length, never an array per row.  A window of n rows is known once its n rows all
have values; ``shift`` moves it to end so many rows before the current one.

Means and spreads are merged from moments (count, mean, squared deviations) of block
parts: rows are cut into blocks of n, a window is the tail of one block and the head of
the next, and both grow by one row at a time.  So the cost does not grow with n, and an
old value of another size, or a missing one, leaves with its row.

Ranks and matches compare the series with itself, moved by one lag at a time: a lag is a
diagonal of the matrix of all pairs in a window, and each row's window adds its part."""

from __future__ import annotations

from math import factorial, log

import numpy as np

#: Blocks from which on block parts are cheaper than the windows themselves.
MANY = 64
#: Rows from which on a mean or spread is taken here and not by a window frame.
LONG = 50


def _ready(x: np.ndarray, n: int) -> np.ndarray:
    """Whether the n rows that end here all have values."""
    count = np.concatenate((np.zeros(1, np.int64), np.cumsum(~np.isnan(x))))
    out = np.zeros(len(x), bool)
    if len(x) >= n:
        out[n - 1:] = count[n:] - count[:-n] == n
    return out


def _moved(y: np.ndarray, shift: int) -> np.ndarray:
    if not shift:
        return y
    out = np.full(len(y), np.nan)
    out[shift:] = y[:-shift]
    return out


def _parts(blocks: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, mean, squared deviations) of the used ones among the first 1, 2, ... rows
    of every block."""
    out = np.zeros((3, *blocks.shape))
    c, m, d = np.zeros((3, len(blocks)))
    for k in range(blocks.shape[1]):
        use = used[:, k]
        c = c + use
        step = np.where(use, blocks[:, k] - m, 0.0)
        m = m + step / np.maximum(c, 1)
        d = d + np.where(use, step * (blocks[:, k] - m), 0.0)
        out[0, :, k], out[1, :, k], out[2, :, k] = c, m, d
    return tuple(out)


def moments(x: np.ndarray, n: int, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and squared deviations of the used values (all, where none are named)
    among the n rows that end at each row; zeros and NaN before the n-th row."""
    used = ~np.isnan(x) if used is None else used & ~np.isnan(x)
    count, mean, dev = np.zeros(len(x)), np.full(len(x), np.nan), np.full(len(x), np.nan)
    if len(x) < n:
        return count, mean, dev
    if len(x) < MANY * n:
        w, u = (np.lib.stride_tricks.sliding_window_view(a, n) for a in (np.where(used, x, 0.0), used))
        step = max(1, (1 << 20) // n)
        for i in range(0, len(w), step):
            part, use = w[i:i + step], u[i:i + step]
            rows = slice(n - 1 + i, n - 1 + i + len(part))
            count[rows] = use.sum(axis=1)
            mean[rows] = part.sum(axis=1) / np.maximum(count[rows], 1)
            dev[rows] = (np.where(use, part - mean[rows, None], 0.0) ** 2).sum(axis=1)
        return count, mean, dev
    more = -len(x) % n
    blocks = np.concatenate((np.where(used, x, 0.0), np.zeros(more))).reshape(-1, n)
    use = np.concatenate((used, np.zeros(more, bool))).reshape(-1, n)
    head = [a.reshape(-1) for a in _parts(blocks, use)]
    tail = [a[:, ::-1].reshape(-1) for a in _parts(blocks[:, ::-1], use[:, ::-1])]
    at = np.arange(n - 1, len(x))
    whole = at % n == n - 1                           # the window is a block
    (ca, ma, da), (cb, mb, db) = ([p[at - n + 1] for p in tail], [p[at] for p in head])
    ca = np.where(whole, 0, ca)
    both, gap = np.maximum(ca + cb, 1), mb - ma
    count[at] = ca + cb
    mean[at] = np.where(ca == 0, mb, np.where(cb == 0, ma, ma + gap * cb / both))
    dev[at] = np.where(ca == 0, 0, da) + db + gap * gap * ca * cb / both
    return count, mean, dev


def rolling_mean(x, n):
    return np.where(_ready(x, n), moments(x, n)[1], np.nan)


def rolling_sd(x, n):
    """Sample deviation."""
    return np.where(_ready(x, n), np.sqrt(moments(x, n)[2] / (n - 1)), np.nan)


def rolling_loss_sd(x, n):
    """Sample deviation of the negative values; unknown with fewer than two."""
    count, _, dev = moments(x, n, x < 0)
    return np.where(_ready(x, n) & (count > 1), np.sqrt(dev / np.maximum(count - 1, 1)), np.nan)


def rolling_weighted(x, n):
    """Mean with weights 1 to n, the last row heaviest.  With the plain sums of the rows
    of head and tail, the weighted sum of a block part grows by one product a row."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    if len(x) < MANY * n:
        w = np.lib.stride_tricks.sliding_window_view(x, n)
        out[n - 1:] = (w * np.arange(1, n + 1)).sum(axis=1) / (n * (n + 1) / 2)
        return np.where(_ready(x, n), out, np.nan)
    rows = -(-len(x) // n) * n
    blocks = np.concatenate((x, np.full(rows - len(x), np.nan))).reshape(-1, n)
    place = np.arange(n)
    head, head_at = (np.cumsum(a, axis=1).reshape(-1) for a in (blocks, blocks * place))
    back = blocks[:, ::-1]
    tail, tail_at = (np.cumsum(a, axis=1)[:, ::-1].reshape(-1) for a in (back, back * place[::-1]))
    at = np.arange(n - 1, len(x))
    k = at % n + 1
    before = np.maximum(at - n + 1, 0)
    # a row at place p of the tail weighs p - (first place) + 1, one of the head p + n - k + 1
    of_tail = tail_at[before] + (1 - k) * tail[before]
    of_head = head_at[at] + (n - k + 1) * head[at]
    out[at] = np.where(k == n, of_head, of_tail + of_head) / (n * (n + 1) / 2)
    return np.where(_ready(x, n), out, np.nan)


# --- order -----------------------------------------------------------------------------

def _counted(x, n, holds) -> np.ndarray:
    """How many of the n - 1 rows before a row stand in the relation to it."""
    count = np.zeros(len(x))
    for k in range(1, n):
        count[k:] += holds(x[:-k], x[k:])
    return count


def rolling_rank_at_or_above(x, n):
    """Share of the n values that are at or above the current one."""
    return np.where(_ready(x, n), (1 + _counted(x, n, np.greater_equal)) / n, np.nan)


def rolling_rank_at_or_below(x, n):
    return np.where(_ready(x, n), (1 + _counted(x, n, np.less_equal)) / n, np.nan)


def rolling_rank_below(x, n):
    """Share of the other n - 1 values that lie below the current one."""
    return np.where(_ready(x, n), _counted(x, n, np.less) / (n - 1), np.nan)


def _sorted_windows(x, n):
    """Sorted windows, a bounded slice of rows at a time: (first row, matrix)."""
    w = np.lib.stride_tricks.sliding_window_view(x, n)
    step = max(1, (1 << 20) // n)
    for i in range(0, len(w), step):
        yield n - 1 + i, np.sort(w[i:i + step], axis=1)


def _at_share(w, p):
    h = p * (w.shape[1] - 1)
    lo, hi = int(np.floor(h)), int(np.ceil(h))
    return w[:, lo] + (w[:, hi] - w[:, lo]) * (h - lo)


def rolling_quantile(x, n, p):
    """Linear-interpolated quantile."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        for i, w in _sorted_windows(x, n):
            out[i:i + len(w)] = _at_share(w, p)
    return np.where(_ready(x, n), out, np.nan)


def rolling_tail_mean(x, n, p):
    """Mean of the values at or below the quantile."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        for i, w in _sorted_windows(x, n):
            low = w <= _at_share(w, p)[:, None]
            out[i:i + len(w)] = (w * low).sum(axis=1) / low.sum(axis=1)
    return np.where(_ready(x, n), out, np.nan)


# --- entropies ---------------------------------------------------------------------------

def _codes(x, order):
    """The order pattern of the rows from each on, as one number."""
    w = np.lib.stride_tricks.sliding_window_view(x, order)
    return (w.argsort(axis=1, kind="stable") * order ** np.arange(order)).sum(axis=1)


def rolling_permutation(x, n, order, shift=0):
    """Permutation entropy: every position of a window weighs the run of its pattern."""
    out, total = np.full(len(x), np.nan), n - order + 1
    if len(x) >= n:
        code, rows = _codes(x, order), len(x) - n + 1
        same = np.ones((total, rows))
        for i in range(total):
            for j in range(i + 1, total):
                hit = code[i:i + rows] == code[j:j + rows]
                same[i] += hit
                same[j] += hit
        out[n - 1:] = -np.log(same / total).sum(axis=0) / total / log(factorial(order)) + 0.0
    return _moved(np.where(_ready(x, n), out, np.nan), shift)


def _diagonals(x, m, most):
    """For every lag the largest difference of m neighbours to those a lag later."""
    out = {}
    for lag in range(1, most + 1):
        gap = np.abs(x[lag:] - x[:-lag])
        d = gap[:len(gap) - m + 1].copy()
        for k in range(1, m):
            np.maximum(d, gap[k:len(gap) - m + 1 + k], out=d)
        out[lag] = d
    return out


def _spread(x, n):
    return np.sqrt(moments(x, n)[2][n - 1:] / n)


def _matches(x, m, templates, tolerance):
    """Pairs of templates of a window that lie within its tolerance."""
    rows, count = len(tolerance), np.zeros(len(tolerance))
    for lag, d in _diagonals(x, m, templates - 1).items():
        for i in range(templates - lag):
            count += d[i:i + rows] < tolerance
    return count


def rolling_sample_entropy(x, n, m=2, r=0.2, shift=0, standard=False):
    """Matches of length m + 1 against those of length m.  By default the longer ones are
    counted over one template less and a flat window or a missing match gives 0;
    `standard` counts both over the same templates and leaves no match unknown, a flat window 0."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        sd = _spread(x, n)
        b = _matches(x, m, n - m, r * sd)
        a = _matches(x, m + 1, n - m if standard else n - m - 1, r * sd)
        if standard:
            out[n - 1:] = np.where(sd > 0, -np.log(a / b) + 0.0, 0.0)
        else:
            ok = (sd > 0) & (a > 0) & (b > 0)
            out[n - 1:] = np.where(ok, -np.log(np.where(ok, a, 1) / np.where(ok, b, 1)) + 0.0, 0.0)
        out[~np.isfinite(out)] = np.nan
    return _moved(np.where(_ready(x, n), out, np.nan), shift)


def rolling_approximate_entropy(x, n, m=2, r=0.2, floor=True, shift=0):
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        sd, rows = _spread(x, n), len(x) - n + 1

        def phi(k):
            templates = n - k + 1
            near = np.ones((templates, rows))
            for lag, d in _diagonals(x, k, templates - 1).items():
                for i in range(templates - lag):
                    hit = d[i:i + rows] <= r * sd
                    near[i] += hit
                    near[i + lag] += hit
            return np.log(near / templates).mean(axis=0)

        got = phi(m) - phi(m + 1)
        out[n - 1:] = np.where(sd > 0, np.maximum(got, 0.0) if floor else got, 0.0)
    return _moved(np.where(_ready(x, n), out, np.nan), shift)


# --- small steps between two statistics -----------------------------------------------------

def percent_of(x, y):
    """x in percent of y, unknown where y is 0."""
    return np.where(y == 0, np.nan, x / np.where(y == 0, 1.0, y)) * 100


ROLLING = {f.__name__: f for f in (
    rolling_mean, rolling_sd, rolling_loss_sd, rolling_weighted, rolling_rank_at_or_above, rolling_rank_at_or_below, rolling_rank_below,
    rolling_quantile, rolling_tail_mean, rolling_permutation, rolling_sample_entropy, rolling_approximate_entropy, percent_of)}
