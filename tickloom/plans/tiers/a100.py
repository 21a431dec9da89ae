"""Tier a100: 50 more columns."""

from math import log

from pyspark.sql import functions as F

from tickloom.functions.frames import (
    cum_sum, high, is_full, lag, latest_extreme, low, mean, nearest_of, nz, or_else,
    over_full_rows, over_rows, pct, ratio, sd, sign, since_start, total, values)
from tickloom.plans.registry import group, step
from tickloom.plans.tiers.a50 import YEAR


def slope(name, k=5):
    return lambda c: c[name] - lag(c[name], k)


@group("F027")
def accelerations():
    return {"return_1d_acceleration": slope("return_1d", 1),
            "return_5d_acceleration": slope("return_5d", 1)}


@group("F028")
def smoothed_oscillator_derivatives():
    return {"qqe_slope": slope("qqe_fast"),
            "qqe_extreme_dist": lambda c: nearest_of(c.qqe_fast, 20, 80),
            "stc_slope": slope("stc_value"),
            "stc_extreme_dist": lambda c: nearest_of(c.stc_value, 25, 75)}


def _mean_deviation(arr, n):
    """Mean absolute deviation of an array from its own mean."""
    m = F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / n
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + F.abs(v - m)) / n


@group("F029")
def standard_oscillators():
    return {
        "_de_max": lambda c: F.greatest(c._up_move, F.lit(0.0) + 0 * c._up_move),
        "_de_min": lambda c: F.greatest(c._down_move, F.lit(0.0) + 0 * c._down_move),
        "demarker_value": lambda c: or_else(ratio(
            mean(c._de_max, 14), mean(c._de_max, 14) + mean(c._de_min, 14)), 0.5),
        "demarker_from_half": lambda c: c.demarker_value - 0.5,
        "_fast_k_14": lambda c: _raw_k(c, 14),
        "_slow_k_14": lambda c: mean(c._fast_k_14, 3),
        "stoch_d_14": lambda c: mean(c._slow_k_14, 3),
        "stoch_k_14": lambda c: F.when(c.stoch_d_14.isNotNull(), c._slow_k_14),
        "stoch_extreme_dist": lambda c: nearest_of(c.stoch_k_14, 20, 80),
        "_typical": lambda c: (c.high + c.low + c.close) / 3,
        "_typical_14": lambda c: values(c._typical, 14),
        "_typical_mad": lambda c: _mean_deviation(c._typical_14, 14),
        "cci_14": lambda c: F.when(c._typical_mad.isNotNull(), or_else(ratio(
            c._typical - mean(c._typical, 14), 0.015 * c._typical_mad), 0.0)),
        "_typical_step": lambda c: c._typical - lag(c._typical),
        "_money_in": lambda c: F.when(c._typical_step > 0, c._typical * c.volume)
        .when(c._typical_step.isNotNull(), 0.0),
        "_money_out": lambda c: F.when(c._typical_step < 0, c._typical * c.volume)
        .when(c._typical_step.isNotNull(), 0.0),
        "mfi_14": lambda c: _money_flow(c),
        "williams_r_14": lambda c: _williams(c),
    }


def _raw_k(c, n):
    lo, hi = low(c.low, n), high(c.high, n)
    return F.when(hi == lo, 0.0).otherwise((c.close - lo) / (hi - lo) * 100)


def _money_flow(c):
    inn, out = total(c._money_in, 14), total(c._money_out, 14)
    return F.when(inn + out < 1.0, 0.0).otherwise(100 * inn / (inn + out))


def _williams(c):
    lo, hi = low(c.low, 14), high(c.high, 14)
    return F.when(hi == lo, 0.0).otherwise((hi - c.close) / (hi - lo) * -100)


@group("F030")
def premium_extensions():
    return {"vrp_5d": lambda c: c.vix - c._rv_5, "vrp_slope": slope("vrp_5d", 1)}


def _sortino(c, n):
    """Mean over the spread of the losing days alone."""
    losses = F.when(c._ret_pct < 0, c._ret_pct)
    spread = F.when(is_full(c._ret_pct, n), over_rows(F.stddev_samp(losses), n))
    return or_else(ratio(mean(c._ret_pct, n), spread) * YEAR, 0.0)


@group("F031")
def extended_risk():
    return {
        "_ret_pct": lambda c: c._ret * 100,
        "_sharpe_20": lambda c: or_else(ratio(mean(c._ret_pct, 20), sd(c._ret_pct, 20)) * YEAR, 0.0),
        "_sortino_20": lambda c: _sortino(c, 20),
        "_mean_252": step("rolling_mean", "_ret_pct", n=252),
        "_sd_252": step("rolling_sd", "_ret_pct", n=252),
        "_loss_sd_252": step("rolling_loss_sd", "_ret_pct", n=252),
        "sharpe_252d": lambda c: or_else(ratio(c._mean_252, c._sd_252) * YEAR, 0.0),
        "sortino_252d": lambda c: or_else(ratio(c._mean_252, c._loss_sd_252) * YEAR, 0.0),
        "sharpe_slope_20d": slope("_sharpe_20", 1),
        "sortino_slope_20d": slope("_sortino_20", 1),
    }


@group("F032")
def value_at_risk():
    return {
        "var_95": step("rolling_quantile", "_ret_pct", n=20, p=0.05),
        "var_99": step("rolling_quantile", "_ret_pct", n=20, p=0.01),
        "cvar_95": step("rolling_tail_mean", "_ret_pct", n=20, p=0.05),
    }


@group("F033")
def ma_extensions():
    return {"sma_9_50_proximity": lambda c: pct(c._sma_9, c._sma_50),
            "sma_50_slope": slope("_sma_50"), "sma_200_slope": slope("_sma_200"),
            "ema_12": lambda c: c._ema_12, "ema_26": lambda c: c._ema_26}


@group("F034")
def rows_since_cross():
    """Rows since the price changed sides; a touch is no cross, and 0 until the
    average exists.  Rows before the first cross count from the series start."""
    d = {}
    for n in (50, 200):
        d[f"_side_{n}"] = (lambda n: lambda c: sign(c.close - c[f"_sma_{n}"]))(n)
        # an unknown side differs from any known one, as in a NaN comparison
        d[f"_crossed_{n}"] = (lambda n: lambda c: (
            (or_else(c[f"_side_{n}"], 9) != 0) & (or_else(lag(c[f"_side_{n}"]), 9) != 0)
            & (c[f"_side_{n}"].isNull() | lag(c[f"_side_{n}"]).isNull()
               | (c[f"_side_{n}"] != lag(c[f"_side_{n}"])))))(n)
        d[f"days_since_sma_{n}_cross"] = (lambda n: lambda c: F.when(
            c[f"_sma_{n}"].isNull(), 0).otherwise(since_start(c[f"_crossed_{n}"]) - 1))(n)
    return d


@group("F035")
def advanced_volatility():
    return {
        "_atr_percent": step("percent_of", "_atr_14", "close"),
        "_atr_rank_60": step("rolling_rank_at_or_above", "_atr_percent", n=60),
        "_bb_width_rank_60": step("rolling_rank_at_or_above", "bb_width", n=60),
        "atr_pct_percentile_60d": lambda c: 100 * c._atr_rank_60,
        "bb_width_percentile_60d": lambda c: 100 * c._bb_width_rank_60,
        "_log_range_sq": lambda c: F.pow(F.ln(c.high / nz(c.low)), 2),
        "parkinson_volatility": lambda c: F.sqrt(
            mean(c._log_range_sq, 20) / (4 * log(2)) * 252) * 100,
        "_gk": lambda c: 0.5 * c._log_range_sq
        - (2 * log(2) - 1) * F.pow(F.ln(c.close / nz(c.open)), 2),
        "_gk_mean": lambda c: mean(c._gk, 20),
        "garman_klass_volatility": lambda c: F.sqrt(
            F.when(c._gk_mean < 0, 0.0).otherwise(c._gk_mean) * 252) * 100,
        "_rv_short": lambda c: sd(c._ret_pct, 5) * YEAR,
        "vol_of_vol": lambda c: sd(c._rv_short, 20),
    }


def aroon(c, n, highest):
    """100 minus the age of the extreme of the last n+1 rows, in percent of n."""
    x = c.high if highest else c.low
    return F.when(c._rn > n, 100 * (n - (c._rn - latest_extreme(x, n + 1, highest))) / F.lit(float(n)))


@group("F036")
def trend():
    return {
        "adx_slope": slope("_adx"),
        "di_spread": lambda c: c._di_plus - c._di_minus,
        "_aroon_up_25": lambda c: aroon(c, 25, True),
        "_aroon_down_25": lambda c: aroon(c, 25, False),
        "aroon_oscillator": lambda c: c._aroon_up_25 - c._aroon_down_25,
        "_mid": lambda c: (c.high + c.low) / 2,
        "_stop_upper_10": step("band", "_mid", "_atr_10", width=3.0),
        "_stop_lower_10": step("band", "_mid", "_atr_10", width=-3.0),
        "_stop_10": step("stop_line", "close", "_stop_upper_10", "_stop_lower_10",
                         at=10, bearish_start=True),
        "supertrend_direction": step("stop_side", "close", "_stop_upper_10", "_stop_lower_10",
                                     at=10, bearish_start=True),
        "price_pct_from_supertrend": lambda c: pct(c.close, c._stop_10),
    }


def _scaled(name):
    """A running total over the size of its own 20-row mean."""
    return lambda c: or_else(ratio(c[name], F.abs(mean(c[name], 20))), 0.0)


@group("F037")
def volume_lines():
    return {
        "_obv_change": slope("obv"),
        "obv_slope": lambda c: or_else(ratio(c._obv_change, sd(c._obv_change, 20)), 0.0),
        "_vpt": lambda c: F.when(c._ret.isNotNull(), cum_sum(c.volume * c._ret)),
        "volume_price_trend": _scaled("_vpt"),
        "_force": lambda c: c.volume * c._range * sign(c._typical_step),
        "_force_fast": step("ewm", "_force", span=34),
        "_force_slow": step("ewm", "_force", span=55),
        "_force_line": step("difference", "_force_fast", "_force_slow"),
        "_force_signal": step("ewm", "_force_line", span=13),
        "_force_hist": lambda c: c._force_line - c._force_signal,
        "kvo_histogram": lambda c: or_else(ratio(c._force_hist, sd(c._force_hist, 20)), 0.0),
        "accumulation_dist": _scaled("_ad"),
        "buying_pressure_ratio": lambda c: or_else(ratio(c.close - c.low, c._range), 0.5),
    }


@group("F038")
def expectancy():
    def wins(c):
        return over_full_rows(F.count_if(c._ret_pct > 0), 20) / F.lit(20.0)

    def part(c, cond):
        return or_else(over_full_rows(F.avg(F.when(cond, c._ret_pct)), 20), 0.0)

    return {
        "win_rate_20d": lambda c: F.when(c._full_ret_20, wins(c)),
        "_full_ret_20": lambda c: is_full(c._ret_pct, 20),
        "expectancy_20d": lambda c: F.when(
            c._full_ret_20, c.win_rate_20d * part(c, c._ret_pct > 0)
            - (1 - c.win_rate_20d) * F.abs(part(c, c._ret_pct < 0))),
    }


@group("F039")
def support_resistance():
    return {
        "fib_range_position": lambda c: F.when(
            low(c.low, 44).isNotNull(),
            or_else(ratio(c.close - low(c.low, 44), high(c.high, 44) - low(c.low, 44)), 0.5)),
        "prior_high_20d_dist": lambda c: pct(c.close, high(c.high, 20)),
        "prior_low_20d_dist": lambda c: pct(c.close, low(c.low, 20)),
    }
