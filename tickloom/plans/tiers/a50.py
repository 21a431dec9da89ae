"""Tier a50: 30 more columns."""

from math import sqrt

from pyspark.sql import functions as F

from tickloom.functions.frames import (
    cum_sum, ffill, lag, mean, nearest_of, nz, or_else, pct, ratio, sd)
from tickloom.plans.registry import group, step

YEAR = sqrt(252)


@group("F014")
def returns():
    return {f"return_{n}d": (lambda n: lambda c: pct(c.close, lag(c.close, n)))(n)
            for n in (1, 5, 21, 63, 252)}


@group("F015")
def gap_and_intraday():
    return {"overnight_gap": lambda c: pct(c.open, c._prev_close),
            "open_to_close_pct": lambda c: pct(c.close, c.open)}


@group("F016")
def rsi_derivatives():
    return {"rsi_slope": lambda c: c._rsi_14 - lag(c._rsi_14, 5),
            "rsi_extreme_dist": lambda c: nearest_of(c._rsi_14, 30, 70)}


@group("F017")
def ma_derivatives():
    return {"price_pct_from_sma_50": lambda c: pct(c.close, c._sma_50),
            "price_pct_from_sma_200": lambda c: pct(c.close, c._sma_200),
            "sma_50_200_proximity": lambda c: pct(c._sma_50, c._sma_200)}


@group("F018")
def volatility():
    return {"atr_pct": lambda c: c._atr_14 / nz(c.close) * 100,
            "atr_pct_slope": lambda c: c.atr_pct - lag(c.atr_pct, 5),
            "bb_width": lambda c: (c._bb_upper - c._bb_lower) / nz(c._bb_mid) * 100}


@group("F019")
def volume():
    return {"_vol_mean_20": lambda c: mean(c.volume, 20),
            "_vol_sd_20": lambda c: sd(c.volume, 20),
            "volume_ratio_20d": lambda c: ratio(c.volume, c._vol_mean_20),
            "macd_histogram": lambda c: c._macd_hist}


@group("F020")
def risk():
    d = {"_ret_capped": lambda c: F.least(c._ret, F.lit(0.0) + 0 * c._ret)}
    d |= {"_ret_mean_20": lambda c: mean(c._ret, 20), "_ret_sd_20": lambda c: sd(c._ret, 20),
          "_capped_sd_20": lambda c: sd(c._ret_capped, 20), "_ret_mean_60": step("rolling_mean", "_ret", n=60),
          "_ret_sd_60": step("rolling_sd", "_ret", n=60), "_capped_sd_60": step("rolling_sd", "_ret_capped", n=60)}
    for n in (20, 60):
        for name, spread in (("sharpe", "_ret_sd"), ("sortino", "_capped_sd")):
            d[f"{name}_{n}d"] = (lambda n, s: lambda c: or_else(ratio(c[f"_ret_mean_{n}"], c[f"{s}_{n}"]) * YEAR, 0.0))(n, spread)
    return d


@group("F021")
def klinger():
    """Signal line of the volume force; the measure accumulates within a trend
    and restarts from the previous bar's range when the trend turns."""
    return {
        "_kvo_sum": lambda c: c.high + c.low + c.close,
        "_kvo_trend": lambda c: F.when(c._kvo_sum > lag(c._kvo_sum), 1).otherwise(-1),
        "_kvo_turn": lambda c: F.coalesce(c._kvo_trend != lag(c._kvo_trend), F.lit(False)),
        "_kvo_total": lambda c: cum_sum(c._range),
        "_kvo_range_before": lambda c: or_else(lag(c._range), 0.0),
        # what had accumulated before the row ahead of the latest turn
        "_kvo_offset": lambda c: or_else(ffill(F.when(
            c._kvo_turn, c._kvo_total - c._range - c._kvo_range_before)), 0.0),
        "_kvo_measure": lambda c: c._kvo_total - c._kvo_offset,
        "_kvo_force": lambda c: c.volume * c._kvo_trend * 100 * F.abs(
            2 * c._range / F.when(F.abs(c._kvo_measure) < 1e-9, 1.0).otherwise(c._kvo_measure) - 1),
        "_kvo_fast": step("ewm", "_kvo_force", span=34),
        "_kvo_slow": step("ewm", "_kvo_force", span=55),
        "_kvo": step("difference", "_kvo_fast", "_kvo_slow"),
        "kvo_signal": step("ewm", "_kvo", span=13),
    }


@group("F022")
def qqe():
    return {"_rsi_line": step("strength", "_avg_gain_14", "_avg_loss_14"),
            "qqe_fast": step("ewm", "_rsi_line", span=5),
            "qqe_slow": step("ewm", "_rsi_line", span=14),
            "qqe_fast_slow_spread": lambda c: c.qqe_fast - c.qqe_slow}


@group("F023")
def schaff():
    return {"_stc_start": step("ema", "_macd_raw_23_50", n=10),
            "_stc_line": step("where_known", "_macd_raw_23_50", "_stc_start"),
            "stc_value": step("double_stochastic", "_stc_line", n=10, span=3),
            "stc_from_50": lambda c: c.stc_value - 50}


@group("F025")
def volatility_premium():
    d = {f"_rv_{n}": (lambda n: lambda c: sd(c._log_ret, n) * YEAR * 100)(n) for n in (5, 10, 21)}
    d |= {"vrp_10d": lambda c: c.vix - c._rv_10,
          "vrp_21d": lambda c: c.vix - c._rv_21,
          "implied_vs_realized_ratio": lambda c: or_else(ratio(c.vix, c._rv_21), 1.0)}
    return d
