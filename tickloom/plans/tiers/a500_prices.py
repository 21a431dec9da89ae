"""Tier a500, averages, volatility, volume, trend and range groups."""

from pyspark.sql import functions as F

from tickloom.functions.frames import (
    clip, flag, frame, high, is_full, lag, latest_extreme, low, mean, nz, or_else, over_full_rows,
    pair_corr, pct, rank_below, ratio, sd, sign, since_start, streak, total, truth, variance)
from tickloom.plans.registry import group, step
from tickloom.plans.tiers.a100 import slope
from tickloom.plans.tiers.a200 import above_below, cross
from tickloom.plans.tiers.a50 import YEAR


@group("F066")
def more_sma():
    return {f"sma_{n}": (lambda n: lambda c: c[f"_sma_{n}"] + 0.0)(n) for n in (5, 14, 21, 63)}


@group("F067")
def more_ema():
    return {f"ema_{n}": (lambda n: lambda c: c[f"_ema_{n}"] + 0.0)(n) for n in (5, 9, 50, 100, 200)}


@group("F068")
def ma_slopes():
    return ({f"sma_{n}_slope": slope(f"_sma_{n}") for n in (5, 21, 63)}
            | {f"ema_{n}_slope": slope(f"_ema_{n}") for n in (9, 50, 100)})


@group("F069")
def ma_distance():
    return {f"price_pct_from_{m}": (lambda m: lambda c: pct(c.close, c[f"_{m}"]))(m)
            for m in ("sma_5", "sma_21", "ema_9", "ema_50", "ema_100")}


@group("F070")
def ma_proximity():
    return {name: (lambda a, b: lambda c: pct(c[a], c[b]))(a, b) for name, a, b in (
        ("sma_5_21_proximity", "_sma_5", "_sma_21"), ("sma_21_50_proximity", "_sma_21", "_sma_50"),
        ("sma_63_200_proximity", "_sma_63", "_sma_200"),
        ("ema_9_50_proximity", "_ema_9", "_ema_50"))}


@group("F073")
def more_durations():
    return (above_below("ema_9", "_ema_9") | above_below("ema_50", "_ema_50")
            | above_below("sma_21", "_sma_21") | above_below("sma_63", "_sma_63"))


@group("F074")
def more_crosses():
    return {"days_since_ema_9_50_cross": cross("_ema_9", "_ema_50"),
            "days_since_ema_50_200_cross": cross("_ema_50", "_ema_200"),
            "days_since_sma_5_21_cross": cross("_sma_5", "_sma_21"),
            "days_since_sma_21_63_cross": cross("_sma_21", "_sma_63"),
            "days_since_ema_9_sma_50_cross": cross("_ema_9", "_sma_50")}


@group("F075")
def ma_acceleration():
    return {f"{m}_acceleration": slope(f"{m}_slope") for m in ("ema_9", "ema_50", "sma_21", "sma_63")}


@group("F076")
def short_oscillators():
    return {
        "rsi_5": lambda c: c._rsi_5 + 0.0, "rsi_21": lambda c: c._rsi_21 + 0.0,
        "_fast_k_5": lambda c: F.when(high(c.high, 5) == low(c.low, 5), 0.0).otherwise(
            (c.close - low(c.low, 5)) / nz(high(c.high, 5) - low(c.low, 5)) * 100),
        "stoch_d_5": lambda c: mean(c._fast_k_5, 3),
        "stoch_k_5": lambda c: F.when(c.stoch_d_5.isNotNull(), c._fast_k_5),
    }


@group("F077")
def oscillator_derivatives():
    return {"rsi_5_slope": slope("_rsi_5"), "rsi_21_slope": slope("_rsi_21"),
            "stoch_k_5_slope": slope("stoch_k_5"),
            "rsi_5_21_spread": lambda c: c._rsi_5 - c._rsi_21}


@group("F078")
def atr_extended():
    return {"atr_5": lambda c: c._atr_5 + 0.0, "atr_21": lambda c: c._atr_21 + 0.0,
            "atr_5_pct": lambda c: c._atr_5 / nz(c.close) * 100,
            "atr_21_pct": lambda c: c._atr_21 / nz(c.close) * 100}


@group("F079")
def atr_dynamics():
    return {"atr_5_21_ratio": lambda c: ratio(c._atr_5, c._atr_21),
            "atr_expansion_5d": lambda c: ratio(c._atr_14, lag(c._atr_14, 5)),
            "atr_acceleration": slope("atr_pct_slope"),
            "atr_percentile_20d": lambda c: rank_below(c._atr_14, 20)}


@group("F080")
def true_range():
    return {"tr_pct": lambda c: c._tr / nz(c.close) * 100,
            "_tr_mean": lambda c: mean(c.tr_pct, 20),
            "tr_pct_zscore_20d": lambda c: ratio(c.tr_pct - c._tr_mean, sd(c.tr_pct, 20)),
            "consecutive_high_vol_days": lambda c: streak(c.tr_pct > c._tr_mean * 1.5)}


@group("F081")
def volatility_estimators():
    return {
        "_rs": lambda c: F.ln(c.high / nz(c.open)) * F.ln(c.high / nz(c.close))
        + F.ln(c.low / nz(c.open)) * F.ln(c.low / nz(c.close)),
        "_rs_mean": lambda c: mean(c._rs, 20),
        "rogers_satchell_volatility": lambda c: F.sqrt(
            F.when(c._rs_mean < 0, 0.0).otherwise(c._rs_mean)) * YEAR,
        "_yz": lambda c: variance(F.ln(c.open / nz(c._prev_close)), 20)
        + 0.34 * variance(F.ln(c.close / nz(c.open)), 20) + (1 - 0.34) * c._rs_mean,
        "yang_zhang_volatility": lambda c: F.sqrt(F.when(c._yz < 0, 0.0).otherwise(c._yz)) * YEAR,
        "historical_volatility_10d": lambda c: sd(c._log_ret, 10) * YEAR,
    }


@group("F082")
def band_dynamics():
    return {"bb_width_slope": slope("bb_width"),
            "bb_width_acceleration": slope("bb_width_slope"),
            "bb_width_percentile_20d": lambda c: rank_below(c.bb_width, 20),
            "price_bb_band_position": lambda c: ratio(c.close - c._bb_lower,
                                                      c._bb_upper - c._bb_lower)}


@group("F083")
def keltner():
    return {"kc_width": lambda c: 3.0 * c._atr_10 / nz(c._ema_20) * 100,
            "kc_position": lambda c: ratio(c.close - (c._ema_20 - 1.5 * c._atr_10),
                                           3.0 * c._atr_10),
            "bb_kc_ratio": lambda c: ratio(c.bb_width, c.kc_width)}


@group("F084")
def volatility_regime():
    return {"vol_regime_change_intensity": lambda c: pct(c._atr_5, c._atr_21),
            "_abs_ret": lambda c: F.abs(c._ret),
            "_abs_ret_before": lambda c: lag(c._abs_ret),
            "vol_clustering_score": lambda c: F.when(
                is_full(c._abs_ret, 20),
                pair_corr(c._abs_ret, c._abs_ret_before, 19))}


@group("F085")
def volume_vectors():
    return {"volume_trend_3d": lambda c: ratio(c.volume - lag(c.volume, 3), c._vol_sd_20),
            "volume_ma_ratio_5_20": lambda c: ratio(mean(c.volume, 5), c._vol_mean_20),
            "consecutive_decreasing_vol": lambda c: streak(c.volume < c._prev_volume),
            "volume_acceleration": slope("volume_trend_3d", 3)}


@group("F086")
def vwap():
    return {"pct_from_vwap_20": lambda c: pct(c.close, c.vwap_20),
            "vwap_slope_5d": slope("vwap_20"),
            "vwap_pct_change_1d": lambda c: pct(c.vwap_20, lag(c.vwap_20)),
            "_close_slope": lambda c: c.close - lag(c.close, 5),
            "vwap_price_divergence": lambda c: flag(sign(c._close_slope) != sign(c.vwap_slope_5d)),
            "price_vwap_cross_recency": cross("close", "vwap_20")}


@group("F087")
def volume_indicators():
    return {
        "cmf_20": lambda c: ratio(total(c._flow, 20), total(c.volume, 20)),
        "_bar_mid": lambda c: (c.high + c.low) / 2,
        # distance over (volume in millions / range); flat bars are unknown
        "_ease": lambda c: (c._bar_mid - lag(c._bar_mid)) / nz(c.volume / 1e6 / nz(c._range)),
        "emv_14": step("ewm", "_ease", span=14),
        "_down_volume_ret": lambda c: F.when(c.volume < c._prev_volume, c._ret).otherwise(0.0),
        "_up_volume_ret": lambda c: F.when(c.volume > c._prev_volume, c._ret).otherwise(0.0),
        "_nvi": step("compound", "_down_volume_ret", start=1000.0),
        "_nvi_mean": step("ewm", "_nvi", span=255, min_periods=255),
        "nvi_signal": lambda c: flag(c._nvi > c._nvi_mean),
        "_pvi": step("compound", "_up_volume_ret", start=1000.0),
        "_pvi_mean": step("ewm", "_pvi", span=255, min_periods=255),
        "pvi_signal": lambda c: flag(c._pvi > c._pvi_mean),
        "vpt_slope": slope("_vpt"),
    }


@group("F088")
def volume_price():
    return {
        "_vol_score": lambda c: ratio(c.volume - c._vol_mean_20, c._vol_sd_20),
        "_ret_score": lambda c: ratio(c._ret - mean(c._ret, 20), sd(c._ret, 20)),
        "volume_spike_price_flat": lambda c: flag((c._vol_score > 2) & (F.abs(c._ret_score) < 0.5)),
        "volume_price_spike_both": lambda c: flag((c._vol_score > 2) & (F.abs(c._ret_score) > 2)),
        "_vol_up": lambda c: flag(c.volume > c._prev_volume),
        "sequential_vol_buildup_3d": lambda c: (
            c._vol_up + or_else(lag(c._vol_up, 1), 0) + or_else(lag(c._vol_up, 2), 0)) / 3.0,
        "vol_breakout_confirmation": lambda c: flag(
            (c.close > high(c.close, 20, -1)) & (c.volume > c._vol_mean_20 * 1.5)),
    }


@group("F089")
def volume_regime():
    def side_mean(c, cond):
        n = F.count_if(cond).over(frame(-19))
        return F.sum(F.when(cond, c.volume).otherwise(0)).over(frame(-19)) / nz(n)

    return {
        "volume_percentile_20d": lambda c: rank_below(c.volume, 20),
        "volume_zscore_20d": lambda c: c._vol_score + 0.0,
        "_vol_up_mean": lambda c: F.when(c._rn >= 20, side_mean(c, truth(c._ret >= 0))),
        "_vol_down_mean": lambda c: F.when(c._rn >= 20, side_mean(c, truth(c._ret < 0))),
        "avg_vol_up_vs_down_days": lambda c: or_else(ratio(c._vol_up_mean, c._vol_down_mean), 1.0),
        "volume_trend_strength": lambda c: or_else(pair_corr(c.volume, c._abs_ret, 20), 0.0),
    }


@group("F090")
def adx_extended():
    return {"plus_di_14": lambda c: c._di_plus + 0.0, "minus_di_14": lambda c: c._di_minus + 0.0,
            "adx_14_slope": slope("_adx"), "adx_acceleration": slope("adx_14_slope"),
            "di_cross_recency": cross("_di_plus", "_di_minus")}


@group("F091")
def trend_exhaustion():
    def sum20(x):
        return over_full_rows(F.sum(x), 20)

    def part(c, up):
        return F.when(truth(c._ret > 0) if up else truth(c._ret < 0),
                      F.abs(c._ret_pct)).otherwise(0.0)

    return {
        "_up_sum": lambda c: sum20(part(c, True)), "_down_sum": lambda c: sum20(part(c, False)),
        "_up_count": lambda c: sum20(flag(c._ret > 0)),
        "_down_count": lambda c: sum20(flag(c._ret < 0)),
        "avg_up_day_magnitude": lambda c: or_else(ratio(c._up_sum, c._up_count), 0.0),
        "avg_down_day_magnitude": lambda c: or_else(ratio(c._down_sum, c._down_count), 0.0),
        "up_down_magnitude_ratio": lambda c: or_else(
            ratio(c.avg_up_day_magnitude, c.avg_down_day_magnitude), 1.0),
        "_move_streak": lambda c: F.greatest(streak(c._ret > 0), streak(c._ret < 0)),
        "trend_persistence_20d": lambda c: over_full_rows(F.max(c._move_streak), 20),
        "up_vs_down_momentum": lambda c: or_else(ratio(c._up_sum, c._down_sum), 1.0),
        "directional_bias_strength": lambda c: F.abs(c._up_count / F.lit(20.0) - 0.5) * 2,
    }


@group("F092")
def trend_regime():
    def aligned(c):
        di = sign(c._di_plus - c._di_minus)
        return ((di > 0) & (c.price_trend_direction == 1)) \
            | ((di < 0) & (c.price_trend_direction == -1)) \
            | ((di == 0) & (c.price_trend_direction == 0))

    return {
        # an unknown ADX falls through to the top band
        "adx_regime": lambda c: F.when(c._adx < 20, 0).when(c._adx <= 25, 1).otherwise(2),
        "_sma_50_change": lambda c: (c._sma_50 - lag(c._sma_50, 5)) / nz(c._sma_50) * 100,
        "price_trend_direction": lambda c: F.when(c._sma_50_change > 0.5, 1)
        .when(c._sma_50_change < -0.5, -1).otherwise(0),
        "trend_alignment_score": lambda c: flag(aligned(c)),
        "_adx_regime_starts": lambda c: (
            c._adx.isNull() | lag(c._adx).isNull() | (c.adx_regime != lag(c.adx_regime))),
        "trend_regime_duration": lambda c: since_start(c._adx_regime_starts),
        "trend_strength_vs_vol": lambda c: or_else(ratio(c._adx, c.atr_pct * 10), 0.0),
    }


@group("F093")
def trend_channel():
    """Least-squares line through the last 20 closes, on the row index."""
    def line(agg):
        return lambda c: F.when(c._rn >= 20, agg(c.close, c._rn.cast("double")).over(frame(-19)))

    return {
        "_fit_slope": line(F.regr_slope), "_fit_r2": line(F.regr_r2),
        "linreg_slope_20d": lambda c: c._fit_slope * 252 / nz(c.close) * 100,
        "linreg_r_squared_20d": lambda c: F.when(sd(c.close, 20) == 0, 1.0).otherwise(c._fit_r2),
        # the line's value at the newest row: mean + slope * half the window
        "price_linreg_deviation": lambda c: (
            c.close - (c._sma_20 + c._fit_slope * 9.5)) / nz(c.close) * 100,
        "channel_width_linreg_20d": lambda c: 2 * c._bb_sigma * F.sqrt(
            F.greatest(1 - c.linreg_r_squared_20d, F.lit(0.0) * c._bb_sigma)) / nz(c.close) * 100,
    }


@group("F094")
def aroon_extended():
    return {"aroon_up_25": lambda c: c._aroon_up_25 + 0.0,
            "aroon_down_25": lambda c: c._aroon_down_25 + 0.0,
            "aroon_trend_strength": lambda c: F.abs(c._aroon_up_25 - c._aroon_down_25) / 100}


@group("F095")
def range_position():
    def place(c, lo, hi):
        return or_else(clip(ratio(c.close - lo, hi - lo), 0, 1), 0.5)

    d = {f"range_position_{n}d": (lambda n: lambda c: place(c, low(c.low, n), high(c.high, n)))(n)
         for n in (20, 50)}
    d["range_position_252d"] = lambda c: place(c, c._low_252, c._high_252)
    d["range_width_20d_pct"] = lambda c: (high(c.high, 20) - low(c.low, 20)) / nz(c.close) * 100
    return d


@group("F096")
def distance_from_extremes():
    return {"pct_from_20d_high": lambda c: pct(c.close, high(c.high, 20)),
            "pct_from_20d_low": lambda c: pct(c.close, low(c.low, 20)),
            "pct_from_52w_high": lambda c: pct(c.close, c._high_252),
            "pct_from_52w_low": lambda c: pct(c.close, c._low_252)}


@group("F097")
def recency_of_extremes():
    def age(n, highest):
        return lambda c: F.when(c._rn >= n, c._rn - latest_extreme(
            c.high if highest else c.low, n, highest)).otherwise(0)

    return {f"days_since_{n}d_{side}": age(n, side == "high")
            for n in (20, 50) for side in ("high", "low")}


@group("F098")
def breakout():
    return {
        "_high_before": lambda c: high(c.high, 20, -1), "_low_before": lambda c: low(c.low, 20, -1),
        "breakout_20d": lambda c: flag(c.close > c._high_before),
        "breakdown_20d": lambda c: flag(c.close < c._low_before),
        "breakout_strength_20d": lambda c: F.when(
            truth(c.close > c._high_before), ratio(c.close - c._high_before, c._atr_14)).otherwise(0.0),
        "consecutive_new_highs_20d": lambda c: streak(c.close > c._high_before),
    }


@group("F099")
def range_dynamics():
    return {
        "_span_10": lambda c: high(c.high, 10) - low(c.low, 10),
        "_span_20": lambda c: high(c.high, 20) - low(c.low, 20),
        "_span_50": lambda c: high(c.high, 50) - low(c.low, 50),
        "_span_10_before": lambda c: lag(c._span_10),
        "range_expansion_10d": lambda c: or_else(ratio(c._span_10, lag(c._span_10, 10)), 1.0),
        "range_contraction_score": lambda c: streak(c._span_10 < c._span_10_before),
        "high_low_range_ratio": lambda c: or_else(ratio(c._span_20, c._span_50), 1.0),
        "_low_20": lambda c: low(c.low, 20),
        "_near_low": lambda c: flag(F.abs(c.close - c._low_20) <= c._low_20 * 0.005),
        "support_test_count_20d": lambda c: over_full_rows(F.sum(c._near_low), 20),
    }


# the retracement levels, in the order in which ties are decided
FIBONACCI = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)


@group("F100")
def fibonacci():
    def nearest(p):
        best = F.array_min(F.array(*[F.struct(F.abs(F.lit(v) - p).alias("d"), F.lit(v).alias("v"))
                                     for v in FIBONACCI]))
        return best["v"]

    return {
        "_fib_position": lambda c: or_else(ratio(c.close - c._low_20, c._span_20), 0.5),
        "fib_retracement_level": lambda c: nearest(c._fib_position),
        "distance_to_fib_50": lambda c: or_else(ratio(
            c.close - (c._low_20 + 0.5 * c._span_20), c._span_20), 0.0),
    }
