"""Rolling statistics against plain windows, on both paths."""

import numpy as np
import pytest

from tickloom.functions import kernels as K
from tickloom.functions import rolling as R


def windows(x, n):
    return np.lib.stride_tricks.sliding_window_view(x, n)


def series(n, seed=1):
    rng = np.random.default_rng(seed)
    x = 100 + np.cumsum(rng.normal(0, 1, n))
    x[n // 2] = np.nan
    return x


@pytest.mark.parametrize("rows", [3, 300, 5000])
@pytest.mark.parametrize("n", [5, 20, 60])
def test_moments_of_windows(rows, n):
    x = series(rows)
    full = np.full(rows, np.nan)
    want = {k: full.copy() for k in ("mean", "sd", "weighted", "loss")}
    y = x - 100
    if rows >= n:
        w, z = windows(x, n), windows(y, n)
        whole = ~np.isnan(w).any(axis=1)
        want["mean"][n - 1:] = np.where(whole, w.mean(axis=1), np.nan)
        want["sd"][n - 1:] = np.where(whole, w.std(axis=1, ddof=1), np.nan)
        want["weighted"][n - 1:] = np.where(whole, (w * np.arange(1, n + 1)).sum(axis=1) / (n * (n + 1) / 2), np.nan)
        for i, row in enumerate(z):
            if whole[i] and (row < 0).sum() > 1:
                want["loss"][n - 1 + i] = row[row < 0].std(ddof=1)
    for name, got in (("mean", R.rolling_mean(x, n)), ("sd", R.rolling_sd(x, n)), ("weighted", R.rolling_weighted(x, n)), ("loss", R.rolling_loss_sd(y, n))):
        assert np.allclose(got, want[name], rtol=1e-10, atol=1e-12, equal_nan=True), name


def test_a_huge_value_leaves_with_its_row():
    x = np.random.default_rng(3).normal(0, 1, 20_000)
    y = x.copy()
    y[777] = 1e14
    clean, dirty = R.rolling_sd(x, 50), R.rolling_sd(y, 50)
    away = np.ones(len(x), bool)
    away[777:827] = False
    assert np.array_equal(clean[away], dirty[away], equal_nan=True)
    assert np.array_equal(R.rolling_mean(x, 50)[away], R.rolling_mean(y, 50)[away], equal_nan=True)


def test_order_statistics():
    x = np.round(series(400), 1)
    n, w = 30, windows(np.round(series(400), 1), 30)
    ok = ~np.isnan(w).any(axis=1)
    for got, want in ((R.rolling_rank_at_or_above(x, n), (w >= w[:, -1:]).mean(axis=1)), (R.rolling_rank_at_or_below(x, n), (w <= w[:, -1:]).mean(axis=1)),
                      (R.rolling_rank_below(x, n), (w < w[:, -1:]).sum(axis=1) / (n - 1)), (R.rolling_quantile(x, n, 0.05), np.quantile(w, 0.05, axis=1))):
        assert np.allclose(got[n - 1:], np.where(ok, want, np.nan), equal_nan=True) and np.isnan(got[:n - 1]).all()
    low = [row[row <= np.quantile(row, 0.1)].mean() for row in w]
    assert np.allclose(R.rolling_tail_mean(x, n, 0.1)[n - 1:], np.where(ok, low, np.nan), equal_nan=True)


@pytest.mark.parametrize("n", [5, 12, 20])
def test_entropies_against_the_matrix_of_pairs(n):
    x = np.round(series(300), 0)
    x[40:70] = 7.0                                    # flat windows and ties
    w = windows(x, n)
    ok = ~np.isnan(w).any(axis=1)

    def all_pairs(kernel):
        out = np.full(len(x), np.nan)
        with np.errstate(all="ignore"):
            got = kernel(w)
        out[n - 1:] = np.where(ok & np.isfinite(got), got, np.nan)
        return np.concatenate(([np.nan], out[:-1]))
    with np.errstate(all="ignore"):
        for got, want in ((R.rolling_permutation(x, n, 3, shift=1), all_pairs(K.permutation(3))),
                          (R.rolling_sample_entropy(x, n, shift=1), all_pairs(K.sample_entropy())),
                          (R.rolling_sample_entropy(x, n, shift=1, standard=True), all_pairs(K.sample_entropy_standard())),
                          (R.rolling_approximate_entropy(x, n, shift=1), all_pairs(K.approximate_entropy())),
                          (R.rolling_approximate_entropy(x, n, floor=False, shift=1), all_pairs(K.approximate_entropy(floor=False)))):
            assert np.allclose(got, want, rtol=1e-9, atol=1e-12, equal_nan=True)
