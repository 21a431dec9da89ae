"""Tier a200: 106 more columns."""

from math import isqrt

from pyspark.sql import functions as F

from tickloom.functions.frames import (
    clip, flag, high, lag, low, mean, nz, or_else, over_full_rows, over_rows, pct,
    rank_at_or_below, ratio, sd, side_streak, since_start, streak, total)
from tickloom.functions.rolling import LONG
from tickloom.plans.registry import group, step
from tickloom.plans.tiers.a100 import slope


def weighted(c, x, n):
    """Linearly weighted mean, newest value heaviest, from two window sums."""
    return (total(x * c._rn, n) - (c._rn - n) * total(x, n)) / (n * (n + 1) / 2)


@group("F041")
def triple_ema():
    return {f"tema_{n}": (lambda n: lambda c: 3 * c[f"_ema_{n}"] - 3 * c[f"_ema2_{n}"]
                          + c[f"_ema3_{n}"])(n) for n in (9, 20, 50, 100)}


@group("F042")
def weighted_ma():
    return {f"wma_{n}": step("rolling_weighted", "close", n=n) if n >= LONG else (lambda n: lambda c: weighted(c, c.close, n))(n)
            for n in (10, 20, 50, 200)}


@group("F043")
def adaptive_ma():
    return {f"kama_{n}": step("adaptive", "close", n=n) for n in (10, 20, 50)}


@group("F044")
def hull():
    d = {}
    for n in (9, 21, 50):
        d[f"_hull_{n}"] = (lambda n: lambda c: 2 * weighted(c, c.close, n // 2)
                           - weighted(c, c.close, n))(n)
        d[f"hma_{n}"] = (lambda n: lambda c: weighted(c, c[f"_hull_{n}"], isqrt(n)))(n)
    return d


@group("F045")
def volume_weighted():
    return {f"vwma_{n}": (lambda n: lambda c: F.when(total(c.volume, n) == 0, c.close).otherwise(
        total(c.close * c.volume, n) / nz(total(c.volume, n))))(n) for n in (10, 20, 50)}


@group("F046")
def derived_ma():
    return {"tema_20_slope": slope("tema_20"),
            "price_pct_from_tema_50": lambda c: pct(c.close, c.tema_50),
            "price_pct_from_kama_20": lambda c: pct(c.close, c.kama_20)}


def above_below(label, ma):
    return {f"days_above_{label}": lambda c: streak(c.close >= c[ma]),
            f"days_below_{label}": lambda c: streak(c.close < c[ma])}


@group("F048")
def duration_counters():
    return (above_below("sma_9", "_sma_9") | above_below("sma_50", "_sma_50")
            | above_below("sma_200", "_sma_200") | above_below("tema_20", "tema_20")
            | above_below("kama_20", "kama_20") | above_below("vwma_20", "vwma_20"))


def cross(a, b):
    return lambda c: side_streak(c[a], c[b])


@group("F050")
def cross_recency():
    return {"days_since_sma_9_50_cross": cross("_sma_9", "_sma_50"),
            "days_since_sma_50_200_cross": cross("_sma_50", "_sma_200"),
            "days_since_tema_sma_50_cross": cross("tema_20", "_sma_50"),
            "days_since_kama_sma_50_cross": cross("kama_20", "_sma_50"),
            "days_since_sma_9_200_cross": cross("_sma_9", "_sma_200")}


@group("F051")
def proximity():
    return {"tema_20_sma_50_proximity": lambda c: pct(c.tema_20, c._sma_50),
            "kama_20_sma_50_proximity": lambda c: pct(c.kama_20, c._sma_50),
            "sma_9_200_proximity": lambda c: pct(c._sma_9, c._sma_200)}


@group("F052")
def bands():
    return {
        "pct_from_upper_band": lambda c: pct(c.close, c._bb_upper),
        "pct_from_lower_band": lambda c: pct(c.close, c._bb_lower),
        "days_above_upper_band": lambda c: streak(c.close > c._bb_upper),
        "days_below_lower_band": lambda c: streak(c.close < c._bb_lower),
        "_kc_upper": lambda c: c._ema_20 + 1.5 * c._atr_20,
        "_kc_lower": lambda c: c._ema_20 - 1.5 * c._atr_20,
        "_squeeze": lambda c: (c._bb_upper < c._kc_upper) & (c._bb_lower > c._kc_lower),
        "bb_squeeze_indicator": lambda c: flag(c._squeeze),
        "bb_squeeze_duration": lambda c: streak(c._squeeze),
    }


@group("F053")
def rsi_duration():
    return {"rsi_distance_from_50": lambda c: c._rsi_14 - 50,
            "days_rsi_overbought": lambda c: streak(c._rsi_14 > 70),
            "days_rsi_oversold": lambda c: streak(c._rsi_14 < 30),
            "_rsi_strength_14": step("strength", "_avg_gain_14", "_avg_loss_14"),
            "rsi_percentile_60d": step("rolling_rank_at_or_below", "_rsi_strength_14", n=60)}


@group("F054")
def mean_reversion():
    return {
        "zscore_from_20d_mean": lambda c: ratio(c.close - c._sma_20, sd(c.close, 20)),
        "_close_sd_50": step("rolling_sd", "close", n=50),
        "zscore_from_50d_mean": lambda c: ratio(c.close - c._sma_50, c._close_sd_50),
        "percentile_in_52wk_range": lambda c: ratio(
            c.close - c._close_low_252, c._close_high_252 - c._close_low_252),
        "distance_from_52wk_high_pct": lambda c: pct(c.close, c._close_high_252),
        "days_since_52wk_high": lambda c: or_else(c._rn - F.abs(c._high_row_252["r"]), 0),
        "days_since_52wk_low": lambda c: or_else(c._rn - c._low_row_252["r"], 0),
    }


@group("F055")
def consecutive():
    return {
        "consecutive_up_days": lambda c: streak(c.close > c._prev_close),
        "consecutive_down_days": lambda c: streak(c.close < c._prev_close),
        "up_days_ratio_20d": lambda c: over_full_rows(
            F.avg(flag(c.close > c._prev_close).cast("double")), 20),
        "_range_mean_5": lambda c: mean(c._range, 5),
        "range_compression_5d": lambda c: ratio(c._range_mean_5, lag(c._range_mean_5, 15)),
    }


@group("F056")
def macd_extensions():
    return {
        "macd_signal": lambda c: c._macd_signal + 0.0,
        "macd_histogram_slope": slope("_macd_hist"),
        "days_since_macd_cross_signal": cross("_macd", "_macd_signal"),
        "macd_signal_proximity": lambda c: c._macd_hist / F.when(
            F.abs(c._macd_signal) > 0.0001, F.abs(c._macd_signal)).otherwise(1.0) * 100,
    }


def z_score(x, n):
    """Deviation in sample sigmas, with 1 instead of a zero sigma."""
    s = sd(x, n)
    return (x - mean(x, n)) / F.when(s > 0, s).otherwise(1.0)


@group("F057")
def volume_dynamics():
    return {
        "_vol_z": lambda c: z_score(c.volume, 20),
        "_ret_z": lambda c: z_score(c._ret_pct, 20),
        "volume_trend_5d": slope("_vol_z"),
        "consecutive_volume_increase": lambda c: streak(c.volume > c._prev_volume),
        "volume_price_confluence": lambda c: c._vol_z * c._ret_z,
        "_busy_ret": lambda c: F.when(c.volume > 1.5 * c._vol_mean_20, c._ret_pct),
        "high_volume_direction_bias": lambda c: or_else(over_rows(F.avg(c._busy_ret), 20), 0.0),
    }


def _weekdays_before(day):
    """Monday-to-Friday days before ``day``, counted from a fixed Monday."""
    n = F.datediff(day, F.lit("1900-01-01"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def _business_month_end(day):
    last = F.last_day(day)
    return F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0)))


def _days_to_month_end(ts):
    this = _business_month_end(ts)
    end = F.when(ts <= this, this).otherwise(_business_month_end(F.add_months(ts, 1)))
    return F.greatest(_weekdays_before(F.date_add(end, 1)) - _weekdays_before(ts) - 1, F.lit(0))


@group("F058")
def calendar():
    return {"trading_day_of_week": lambda c: F.weekday(c.ts),
            "is_monday": lambda c: flag(F.weekday(c.ts) == 0),
            "is_friday": lambda c: flag(F.weekday(c.ts) == 4),
            "days_to_month_end": lambda c: _days_to_month_end(c.ts),
            "month_of_year": lambda c: F.month(c.ts),
            "is_quarter_end_month": lambda c: flag(F.month(c.ts) % 3 == 0)}


def _share(x, c, flat):
    return F.when(c._range > 0, clip(x / nz(c._range), 0, 1)).otherwise(flat)


@group("F059")
def candle():
    return {
        "_body": lambda c: F.abs(c.close - c.open),
        "_body_top": lambda c: F.greatest(c.open, c.close),
        "_body_bottom": lambda c: F.least(c.open, c.close),
        "_upper_wick": lambda c: c.high - c._body_top,
        "_lower_wick": lambda c: c._body_bottom - c.low,
        "candle_body_pct": lambda c: c._body / nz(c.open) * 100,
        "body_to_range_ratio": lambda c: _share(c._body, c, 0.5),
        "upper_wick_pct": lambda c: _share(c._upper_wick, c, 0.0),
        "lower_wick_pct": lambda c: _share(c._lower_wick, c, 0.0),
        "doji_indicator": lambda c: flag(c.body_to_range_ratio < 0.1),
        # before 20 rows exist the divisor is 1
        "_range_mean_20": lambda c: mean(c._range, 20),
        "range_vs_avg_range": lambda c: c._range / F.when(
            c._range_mean_20 > 0, c._range_mean_20).otherwise(1.0),
    }


def _mid_range(c, n):
    return (high(c.high, n) + low(c.low, n)) / 2


@group("F060")
def ichimoku():
    return {
        "tenkan_sen": lambda c: _mid_range(c, 9),
        "kijun_sen": lambda c: _mid_range(c, 26),
        "senkou_span_a": lambda c: (c.tenkan_sen + c.kijun_sen) / 2,
        "senkou_span_b": lambda c: _mid_range(c, 52),
        "price_vs_cloud": lambda c: F.when(c.senkou_span_b.isNull(), 0)
        .when(c.close > F.greatest(c.senkou_span_a, c.senkou_span_b), 1)
        .when(c.close < F.least(c.senkou_span_a, c.senkou_span_b), -1).otherwise(0),
        "cloud_thickness_pct": lambda c: (c.senkou_span_a - c.senkou_span_b) / nz(c.close) * 100,
    }


@group("F061")
def donchian():
    return {
        "donchian_upper_20": lambda c: high(c.high, 20),
        "donchian_lower_20": lambda c: low(c.low, 20),
        "_channel": lambda c: c.donchian_upper_20 - c.donchian_lower_20,
        "donchian_position": lambda c: F.when(c._channel > 0, clip(
            (c.close - c.donchian_lower_20) / nz(c._channel), 0, 1)).otherwise(0.5),
        "donchian_width_pct": lambda c: c._channel / nz(c.close) * 100,
        "pct_to_donchian_breakout": lambda c: F.when(
            c.close >= (c.donchian_upper_20 + c.donchian_lower_20) / 2,
            (c.donchian_upper_20 - c.close) / nz(c.close) * 100).otherwise(
            -(c.close - c.donchian_lower_20) / nz(c.close) * 100),
    }


@group("F062")
def divergence():
    return {
        "_price_rank": lambda c: rank_at_or_below(c.close, 20),
        "price_rsi_divergence": lambda c: c._price_rank - rank_at_or_below(c._rsi_14, 20),
        "price_obv_divergence": lambda c: c._price_rank - rank_at_or_below(c.obv, 20),
        "divergence_magnitude": lambda c: F.when(c.price_rsi_divergence.isNotNull(), F.greatest(
            F.abs(c.price_rsi_divergence), F.abs(c.price_obv_divergence))),
        "divergence_streak": lambda c: streak(c.divergence_magnitude > 0.2),
    }


def changed(name):
    """True where a state differs from the row before; the first row counts."""
    return lambda c: ~c[name].eqNullSafe(lag(c[name]))


@group("F064")
def entropy_regime():
    d = {f"permutation_entropy_order{m}": step("rolling_permutation", "close", n=20, order=m) for m in (3, 4, 5)}
    d |= {
        "entropy_trend_5d": slope("permutation_entropy_order4"),
        "atr_regime_pct_60d": step("rolling_rank_at_or_below", "_atr_percent", n=60),
        "atr_regime_rolling_q": lambda c: c.atr_regime_pct_60d + 0.0,
        "trend_strength_pct_60d": step("rolling_rank_at_or_below", "_adx", n=60),
        "trend_strength_rolling_q": lambda c: c.trend_strength_pct_60d + 0.0,
        "vol_regime_state": lambda c: F.when(c.atr_regime_pct_60d > 0.7, 1)
        .when(c.atr_regime_pct_60d < 0.3, -1).otherwise(0),
        "_vol_state_changed": changed("vol_regime_state"),
        "regime_consistency": lambda c: since_start(c._vol_state_changed),
        "regime_transition_prob": lambda c: over_full_rows(
            F.avg(c._vol_state_changed.cast("double")), 20),
    }
    return d
