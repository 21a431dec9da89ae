"""Tier a20 (20 columns), the volatility-index tier (8), and shared intermediates."""

from pyspark.sql import functions as F

from tickloom.functions.frames import (
    block, block_extreme, cum_sum, ffill, frame_extreme, high, is_full, lag, low, mean, nz,
    or_else, pct, rank_below, ratio, sd, sd_pop, sign, total)
from tickloom.functions.rolling import LONG
from tickloom.plans.registry import group, step, weekly


@group("base")
def base():
    """Per-row quantities that many groups read."""
    d = {
        "_prev_close": lambda c: lag(c.close),
        "_ret": lambda c: c.close / nz(c._prev_close) - 1,
        "_log_ret": lambda c: F.ln(c.close / nz(c._prev_close)),
        "_prev_high": lambda c: lag(c.high),
        "_prev_low": lambda c: lag(c.low),
        "_prev_open": lambda c: lag(c.open),
        "_prev_volume": lambda c: lag(c.volume),
        "_range": lambda c: c.high - c.low,
        # null on the first row, like every column that reads the previous close
        "_tr": lambda c: F.when(c._prev_close.isNotNull(), F.greatest(
            c.high - c.low, F.abs(c.high - c._prev_close), F.abs(c.low - c._prev_close))),
        "_gain": lambda c: F.when(c.close >= c._prev_close, c.close - c._prev_close)
        .when(c.close < c._prev_close, 0.0),
        "_loss": lambda c: F.when(c.close < c._prev_close, c._prev_close - c.close)
        .when(c.close >= c._prev_close, 0.0),
        "_up_move": lambda c: c.high - c._prev_high,
        "_down_move": lambda c: c._prev_low - c.low,
        "_dm_plus": lambda c: F.when((c._up_move > 0) & (c._up_move > c._down_move), c._up_move)
        .when(c._up_move.isNotNull(), 0.0),
        "_dm_minus": lambda c: F.when((c._down_move > 0) & (c._down_move > c._up_move),
                                      c._down_move).when(c._down_move.isNotNull(), 0.0),
        # close location inside the bar times volume, 0 on a flat bar
        "_flow": lambda c: or_else(ratio((c.close - c.low) - (c.high - c.close), c._range), 0.0)
        * c.volume,
        "_ad": lambda c: cum_sum(c._flow),
        "obv": lambda c: cum_sum(F.when(c._prev_close.isNull(), c.volume.cast("double"))
                                 .otherwise(sign(c.close - c._prev_close) * c.volume)),
        "_bb_mid": lambda c: mean(c.close, 20),
        "_bb_sigma": lambda c: sd_pop(c.close, 20),
        "_bb_upper": lambda c: c._bb_mid + 2 * c._bb_sigma,
        "_bb_lower": lambda c: c._bb_mid - 2 * c._bb_sigma,
    }
    for n in (5, 14, 21):
        d[f"_avg_gain_{n}"] = step("wilder", "_gain", n=n)
        d[f"_avg_loss_{n}"] = step("wilder", "_loss", n=n)
        d[f"_rsi_{n}"] = (lambda n: lambda c: 100 * or_else(ratio(
            c[f"_avg_gain_{n}"], c[f"_avg_gain_{n}"] + c[f"_avg_loss_{n}"]), 0.0)
            + 0 * c[f"_avg_gain_{n}"])(n)
    for n in (4, 5, 10, 14, 20, 21):
        d[f"_atr_{n}"] = step("wilder", "_tr", n=n)
    for n in (5, 9, 10, 12, 20, 25, 26, 50, 90, 100, 200):
        d[f"_ema_{n}"] = step("ema", "close", n=n)
        d[f"_ema2_{n}"] = step("ema", f"_ema_{n}", n=n)
        d[f"_ema3_{n}"] = step("ema", f"_ema2_{n}", n=n)
    for n in (4, 5, 9, 12, 14, 20, 21, 50, 63, 100, 200):
        d[f"_sma_{n}"] = step("rolling_mean", "close", n=n) if n >= LONG else (lambda n: lambda c: mean(c.close, n))(n)
    # both averages of a MACD are seeded where the slow one starts
    for fast, slow in ((12, 26), (23, 50)):
        d[f"_macd_fast_{fast}"] = step("ema", "close", n=fast, at=slow - 1)
        d[f"_macd_slow_{slow}"] = step("ema", "close", n=slow, at=slow - 1)
        d[f"_macd_raw_{fast}_{slow}"] = step(
            "difference", f"_macd_fast_{fast}", f"_macd_slow_{slow}")
    d["_macd_signal"] = step("ema", "_macd_raw_12_26", n=9)
    d["_macd"] = lambda c: F.when(c._macd_signal.isNotNull(), c._macd_raw_12_26)
    d["_macd_hist"] = lambda c: c._macd - c._macd_signal
    d["_dm_plus_14"] = step("decayed_sum", "_dm_plus", n=14)
    d["_dm_minus_14"] = step("decayed_sum", "_dm_minus", n=14)
    d["_tr_14"] = step("decayed_sum", "_tr", n=14)
    d["_adx"] = step("directional_index", "_dm_plus", "_dm_minus", "_tr", n=14)
    # the sums start one row before the first published value
    for side in ("plus", "minus"):
        d[f"_di_{side}"] = (lambda s: lambda c: F.when(
            lag(c._tr_14).isNotNull(), 100 * or_else(ratio(c[f"_dm_{s}_14"], c._tr_14), 0.0)))(side)
    return d


@group("base")
def yearly_extremes():
    """Highest and lowest close, high and low of 252 rows, and their earliest row."""
    n = 252
    d = {"_block_252": lambda c: block(n),
         "_close_row": lambda c: F.struct(c.close.alias("v"), (-c._rn).alias("r")),
         "_close_row_low": lambda c: F.struct(c.close.alias("v"), c._rn.alias("r"))}
    for x, src, highest in (("close_high", "close", True), ("close_low", "close", False),
                            ("high", "high", True), ("low", "low", False),
                            ("high_row", "_close_row", True), ("low_row", "_close_row_low", False)):
        d[f"_{x}_252_head"] = (lambda s, h: lambda c: (
            c._block_252, block_extreme(c[s], n, h, False))[1])(src, highest)
        d[f"_{x}_252_tail"] = (lambda s, h: lambda c: (
            c._block_252, block_extreme(c[s], n, h, True))[1])(src, highest)
        d[f"_{x}_252"] = (lambda x, h: lambda c: frame_extreme(
            c[f"_{x}_252_head"], c[f"_{x}_252_tail"], n, h))(x, highest)
    return d


def stochastic(x, n):
    """Position of x in its own n-row range, 0..100, 0 on a flat window."""
    lo, hi = low(x, n), high(x, n)
    return F.when(hi == lo, 0.0).otherwise((x - lo) / (hi - lo) * 100)


@group("F002")
def moving_averages():
    d = {f"dema_{n}": (lambda n: lambda c: 2 * c[f"_ema_{n}"] - c[f"_ema2_{n}"])(n)
         for n in (9, 10, 20, 25, 90)}
    d |= {f"sma_{n}": (lambda n: lambda c: c[f"_sma_{n}"])(n) for n in (12, 50, 100, 200)}
    return d


def _stoch_rsi(c):
    # published once its 3-row companion average exists, two rows later
    return F.when(is_full(c._rsi_14, 7), stochastic(c._rsi_14, 5))


@group("F003")
def oscillators():
    return {"rsi_daily": lambda c: c._rsi_14, "stochrsi_daily": _stoch_rsi}


@group("F005")
def weekly_oscillators():
    return {
        "_week_rsi": weekly("rsi_daily"), "_week_stochrsi": weekly("stochrsi_daily"),
        "rsi_weekly": lambda c: ffill(c._week_rsi),
        "stochrsi_weekly": lambda c: ffill(c._week_stochrsi),
    }


@group("F006")
def other_indicators():
    return {
        "macd_line": lambda c: c._macd,
        "_ad_fast": step("ewm", "_ad", span=3),
        "_ad_slow": step("ewm", "_ad", span=10),
        "adosc": lambda c: F.when(c._rn >= 10, c._ad_fast - c._ad_slow),
        "atr_14": lambda c: c._atr_14,
        "adx_14": lambda c: c._adx,
        "bb_percent_b": lambda c: ratio(c.close - c._bb_lower, c._bb_upper - c._bb_lower),
        "vwap_20": lambda c: ratio(total(c.close * c.volume, 20), total(c.volume, 20)),
    }


@group("F013")
def volatility_index():
    """The second series as the bars' ``close``; rows without the percentile go."""
    return {
        "vix_close": lambda c: c.close + 0.0,
        "vix_sma_10": lambda c: mean(c.close, 10),
        "vix_sma_20": lambda c: mean(c.close, 20),
        "vix_percentile_60d": lambda c: 100 * rank_below(c.close, 60),
        "vix_zscore_20d": lambda c: or_else(ratio(c.close - mean(c.close, 20), sd(c.close, 20)), 0.0),
        "vix_regime": lambda c: F.when(c.close < 15, 0).when(c.close >= 25, 2).otherwise(1),
        "vix_change_1d": lambda c: pct(c.close, lag(c.close, 1)),
        "vix_change_5d": lambda c: pct(c.close, lag(c.close, 5)),
    }
