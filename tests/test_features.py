"""Indicator columns: seeds by hand, guards, and no look into the future."""

import numpy as np
import pandas as pd
import pytest

from tickloom.functions import kernels as K
from tickloom.functions import recursive as R
from tickloom.operators.validate import lookahead_check
from tickloom.plans.features import TIERS, feature_table, tier_columns
from tickloom.plans.registry import build, is_lookahead


def table(bars, names, **kw):
    return feature_table(bars, names, warm_up="keep", **kw).orderBy("ts").toPandas()


def test_tier_sizes():
    assert {k: len(v) for k, v in TIERS.items()} == {
        "a20": 20, "a50": 50, "a100": 100, "a200": 206, "a500": 483, "vix": 8}
    assert len(set(TIERS["a500"])) == 483


def test_unknown_tier():
    with pytest.raises(ValueError, match="unknown tier"):
        tier_columns("a1")


def test_lookahead_columns_are_excluded_by_default(spark):
    assert set(TIERS["a500"]) - set(tier_columns("a500")) == {"entropy_leading_vol", "vol_leading_entropy"}
    assert is_lookahead("entropy_leading_vol") and not is_lookahead("entropy_vol_divergence")


def test_full_window_guard(make_bars):
    got = table(make_bars(range(1, 16)), ["sma_12"])["sma_12"]
    assert got[:11].isna().all() and got[11] == 6.5 and got[14] == 9.5


def test_ema_starts_with_the_mean_of_its_span():
    got = R.ema(np.array([1.0, 2, 3, 4, 5]), 3)
    assert np.isnan(got[:2]).all() and got[2:].tolist() == [2.0, 3.0, 4.0]


def test_ema_of_ema_starts_after_both_warm_ups():
    x = np.arange(1.0, 12.0)
    twice = R.ema(R.ema(x, 3), 3)
    assert np.isnan(twice[:4]).all() and twice[4] == pytest.approx(3.0)


def test_wilder_average_by_hand():
    x = np.array([np.nan, 1.0, 2.0, 3.0, 6.0])
    got = R.wilder(x, 3)
    assert got[3] == 2.0 and got[4] == pytest.approx((2 * 2 + 6) / 3)


def test_decayed_sum_by_hand():
    # starts with the sum of the first n-1 values, then s - s/n + x
    got = R.decayed_sum(np.array([np.nan, 1.0, 2.0, 4.0, 8.0]), 3)
    assert got[2] == pytest.approx(3.0) and got[3] == pytest.approx(3 - 1 + 4)


def test_rsi_of_a_rising_series_is_100(make_bars):
    got = table(make_bars(range(100, 130)), ["rsi_daily"])["rsi_daily"]
    assert got[:14].isna().all() and (got[14:] == 100).all()


def test_adaptive_average_follows_a_straight_line_fast():
    x = np.arange(10.0, 40.0)
    got = R.adaptive(x, 10)
    # full efficiency: weight (2/3)^2 from the previous price on
    assert np.isnan(got[:10]).all() and got[10] == pytest.approx(19 + (20 - 19) * (2 / 3) ** 2)


def test_trailing_stop_flips():
    close = np.array([10.0, 10, 14, 14, 5])
    up, lo = close + 2, close - 2
    line, side = R.trailing_stop(close, up, lo, 0, True)
    assert side.tolist() == [-1, -1, 1, 1, -1] and line[2] == 12 and line[4] == 7


def test_recursive_columns_against_loops(make_bars, walk):
    got = table(make_bars(walk), ["macd_line", "macd_signal", "ema_12", "dema_9", "atr_14", "adx_14"])
    c = np.array(walk)

    def ema(x, n, at=None):
        at = n - 1 if at is None else at
        out = [np.nan] * len(x)
        out[at] = np.mean(x[at - n + 1:at + 1])
        for i in range(at + 1, len(x)):
            out[i] = out[i - 1] + 2 / (n + 1) * (x[i] - out[i - 1])
        return np.array(out)
    np.testing.assert_allclose(got["ema_12"], ema(c, 12), rtol=1e-10)
    raw = ema(c, 12, 25) - ema(c, 26, 25)
    sig = ema(raw, 9, 33)
    np.testing.assert_allclose(got["macd_signal"], sig, rtol=1e-9)
    assert got["macd_line"].first_valid_index() == 33
    e = ema(c, 9)
    np.testing.assert_allclose(got["dema_9"], 2 * e - ema(e, 9, 16), rtol=1e-10)
    assert got["atr_14"].first_valid_index() == 14 and got["adx_14"].first_valid_index() == 27


def test_long_frames_match_pandas(make_bars, walk):
    got = table(make_bars(walk), ["sma_200", "sharpe_252d", "pct_from_52w_high", "days_since_52wk_high"])
    s = pd.Series(walk)
    np.testing.assert_allclose(got["sma_200"], s.rolling(200).mean(), rtol=1e-12)
    r = s.pct_change() * 100
    want = (r.rolling(252).mean() / r.rolling(252).std() * np.sqrt(252)).fillna(0)
    np.testing.assert_allclose(got["sharpe_252d"], want, rtol=1e-8, atol=1e-12)
    high = (s + 1).rolling(252).max()
    np.testing.assert_allclose(got["pct_from_52w_high"], (s - high) / high * 100, rtol=1e-12)
    age = s.rolling(252).apply(lambda x: len(x) - 1 - int(np.argmax(x)), raw=True).fillna(0)
    assert got["days_since_52wk_high"].tolist() == age.astype(int).tolist()


def test_flat_prices_hit_the_guards(make_bars):
    got = table(make_bars([100.0] * 70, spread=0.0), [
        "sharpe_20d", "buying_pressure_ratio", "demarker_value", "zscore_from_20d_mean", "donchian_position"]).iloc[-1]
    assert got["sharpe_20d"] == 0 and got["buying_pressure_ratio"] == 0.5 and got["demarker_value"] == 0.5
    assert pd.isna(got["zscore_from_20d_mean"]) and got["donchian_position"] == 0.5


def test_streak_and_signed_recency(make_bars):
    got = table(make_bars([1, 2, 3, 2, 1, 2]), ["consecutive_up_days", "consecutive_down_days"])
    assert got["consecutive_up_days"].tolist() == [0, 1, 2, 0, 0, 1]
    assert got["consecutive_down_days"].tolist() == [0, 0, 0, 1, 2, 0]


def test_no_lookahead_in_any_tier(make_bars, walk):
    names = tier_columns("a200")
    bars = make_bars(walk)
    vix = bars.selectExpr("ts", "close / 5 as vix")
    cut = bars.orderBy("ts").collect()[300]["ts"].isoformat()
    out = lookahead_check(bars, lambda b: build(b, names, vix), names, [cut], 1e-6).toPandas()
    assert out.loc[~out["passed"], "column"].tolist() == []


def test_lookahead_is_found_where_it_exists(make_bars, walk):
    bars = make_bars(walk)
    cut = bars.orderBy("ts").collect()[250]["ts"].isoformat()
    out = lookahead_check(bars, lambda b: build(b, ["entropy_leading_vol"]), ["entropy_leading_vol"], [cut]).collect()
    assert not out[0]["passed"]


# --- window kernels on small arrays, against plain loops ---------------------------------

def windows(n=20, rows=6, seed=1):
    return np.random.default_rng(seed).normal(100, 5, (rows, n))


def test_permutation_entropy_by_hand():
    assert K.permutation(3)(np.array([[1.0, 2, 3, 4, 5]]))[0] == pytest.approx(0.0)
    # patterns up-up, up-down once each: ln 2 / ln 6
    assert K.permutation(3)(np.array([[1.0, 2, 3, 1]]))[0] == pytest.approx(np.log(2) / np.log(6))


def test_sample_entropy_against_loops():
    x = windows()

    def count(w, m, tol):
        t = [w[i:i + m] for i in range(len(w) - m)]
        return sum(np.max(np.abs(t[i] - t[j])) < tol for i in range(len(t)) for j in range(i + 1, len(t)))
    for w, got in zip(x, K.sample_entropy()(x)):
        b, a = count(w, 2, 0.2 * w.std()), count(w, 3, 0.2 * w.std())
        assert got == pytest.approx(-np.log(a / b) if a and b else 0.0)


def test_approximate_entropy_against_loops():
    x = windows()

    def phi(w, m, tol):
        t = [w[i:i + m] for i in range(len(w) - m + 1)]
        return np.mean([np.log(np.mean([np.max(np.abs(a - b)) <= tol for b in t])) for a in t])
    for w, got in zip(x, K.approximate_entropy()(x)):
        assert got == pytest.approx(max(0, phi(w, 2, 0.2 * w.std()) - phi(w, 3, 0.2 * w.std())))


def test_spectral_entropy_of_one_tone_is_zero():
    x = np.sin(2 * np.pi * 3 * np.arange(20) / 20)[None, :]
    assert K.spectral_entropy(x)[0] == pytest.approx(0.0, abs=1e-6)


def test_dimensions_of_a_straight_line():
    x = np.arange(40.0)[None, :]
    assert K.curve_length_dimension(5, True, True)(x)[0] == pytest.approx(1.0)
    assert K.katz(x)[0] == pytest.approx(1.0)
    assert K.petrosian(x)[0] == pytest.approx(1.0)
    assert np.isnan(K.crossover_scale(np.zeros((1, 40)))[0])


def test_weekly_match_of_odd_rows_equals_the_join(spark):
    """Rows that come twice, null keys and days, weeks without a Monday; one exchange of the days, where a join took another one."""
    import datetime as dt

    from pyspark.sql import functions as F

    from tickloom.functions import frames as W
    from tickloom.operators.align import weekly_to_daily
    from tickloom.operators.bars import BAR_SCHEMA, resample_week_start
    rows = []
    for key in ("A", "B", None):
        for i in range(120):
            day = dt.date(2024, 1, 1) + dt.timedelta(i)
            if key == "B" and i % 21 == 0 or i % 17 == 5:
                continue
            rows += [(key, day, 10.0 + i % 13, 11.0 + i % 13, 9.0, 10.0 + i % 7, 100 + i)] * (2 if i % 14 == 0 else 1)
    rows.append(("A", None, 1.0, 2.0, 0.5, 1.5, 7))
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    weeks = feature_table(resample_week_start(bars), ["sma_5"], warm_up="keep")
    late = weeks.select("key", "ts", W.lag("sma_5").alias("wk"))
    got = weekly_to_daily(bars, {"wk": "sma_5"})
    want = bars.join(late, ["key", "ts"], "left").select(*bars.columns, "wk")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.filter("wk is not null").count() > 20
    plan = feature_table(bars, ["sma_12", "rsi_daily", "rsi_weekly"], warm_up="keep")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and not any("hashpartitioning" in line and "ts#" in line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines())


def test_windows_come_before_the_recursive_pass(spark, make_bars, walk):
    """Nothing after the pass needs the rows by key again."""
    bars = make_bars(walk)
    table = feature_table(bars, ["sma_12", "rsi_daily", "macd_line", "days_above_sma_9"], warm_up="keep")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1
    apart = [feature_table(bars, [n], warm_up="keep") for n in ("sma_12", "rsi_daily", "macd_line", "days_above_sma_9")]
    want = apart[0]
    for d in apart[1:]:
        want = want.join(d, ["key", "ts"])
    assert sorted(map(str, table.collect())) == sorted(map(str, want.select(*table.columns).collect()))
