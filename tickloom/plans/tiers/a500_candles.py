"""Tier a500, candle and pattern groups.  Flags are 0/1, unknown counts as 0."""

from pyspark.sql import functions as F

from tickloom.functions.frames import (
    clip, flag, lag, mean, or_else, over_rows, sign, streak)
from tickloom.plans.registry import group

EPS = 1e-8


@group("F101")
def engulfing():
    def covers(c):
        return (c._body_bottom <= lag(c._body_bottom)) & (c._body_top >= lag(c._body_top))

    return {
        "_signed_body": lambda c: c.close - c.open,
        "_prev_body": lambda c: lag(c._signed_body),
        "_covers": lambda c: covers(c),
        "bullish_engulfing": lambda c: flag(c._covers & (c._signed_body > 0) & (c._prev_body < 0)),
        "bearish_engulfing": lambda c: flag(c._covers & (c._signed_body < 0) & (c._prev_body > 0)),
        "engulfing_score": lambda c: or_else(
            clip(c._body / (F.abs(c._prev_body) + EPS), 0, 5), 0.0),
        "consecutive_engulfing_count": lambda c: streak(
            (c.bullish_engulfing == 1) | (c.bearish_engulfing == 1)),
    }


@group("F102")
def wick_rejection():
    return {
        "hammer_indicator": lambda c: flag(
            (c._lower_wick >= 2 * c._body) & (c._upper_wick <= 0.3 * c._body)),
        "shooting_star_indicator": lambda c: flag(
            (c._upper_wick >= 2 * c._body) & (c._lower_wick <= 0.3 * c._body)),
        "hammer_score": lambda c: clip(c._lower_wick / (c._body + EPS), 0, 10),
        "shooting_star_score": lambda c: clip(c._upper_wick / (c._body + EPS), 0, 10),
        "wick_rejection_score": lambda c: F.greatest(c.hammer_score, c.shooting_star_score)
        * sign(c.hammer_score - c.shooting_star_score),
    }


@group("F103")
def gaps():
    def filled(c):
        return ((c._gap > 0) & (c.low <= c._prev_close)) | ((c._gap < 0) & (c.high >= c._prev_close))

    return {
        "_gap": lambda c: c.open - c._prev_close,
        "_gap_pct": lambda c: c._gap / (c._prev_close + EPS) * 100,
        "gap_size_pct": lambda c: or_else(c._gap_pct, 0.0),
        # the first row has no gap and counts as down
        "gap_direction": lambda c: F.when(c._gap_pct > 0.1, 1).when(
            c._gap_pct >= -0.1, 0).otherwise(-1),
        "gap_filled_today": lambda c: flag(filled(c)),
        "_gap_retraced": lambda c: F.when(c._gap > 0, F.least(c.open - c.low, c._gap)).when(
            c._gap < 0, F.least(c.high - c.open, -c._gap)).otherwise(0.0),
        "gap_fill_pct": lambda c: or_else(
            clip(F.abs(c._gap_retraced) / (F.abs(c._gap) + EPS) * 100, 0, 100), 0.0),
        "significant_gap": lambda c: flag(F.abs(c._gap_pct) > 0.5),
    }


@group("F104")
def inside_outside():
    return {"_inside": lambda c: (c.high <= c._prev_high) & (c.low >= c._prev_low),
            "_outside": lambda c: (c.high > c._prev_high) & (c.low < c._prev_low),
            "inside_day": lambda c: flag(c._inside), "outside_day": lambda c: flag(c._outside),
            "consecutive_inside_days": lambda c: streak(c._inside),
            "consecutive_outside_days": lambda c: streak(c._outside)}


@group("F105")
def range_extremes():
    return {"_range_mean_10": lambda c: mean(c._range, 10),
            "_narrow": lambda c: c._range < 0.5 * c._range_mean_10,
            "narrow_range_day": lambda c: flag(c._narrow),
            "wide_range_day": lambda c: flag(c._range > 2.0 * c._range_mean_10),
            "narrow_range_score": lambda c: or_else(
                clip(c._range_mean_10 / (c._range + EPS), 0, 10), 0.0),
            "consecutive_narrow_days": lambda c: streak(c._narrow)}


def one_sided(cond, c):
    """Run length of rows that meet ``cond`` and share the body's direction."""
    return streak(cond & (c._signed_body > 0)) + streak(cond & (c._signed_body < 0))


@group("F106")
def trend_days():
    return {
        "_body_share": lambda c: c._body / (c._range + EPS),
        "_trend_day": lambda c: (c._body_share > 0.7) & (c._body / (c.open + EPS) * 100 > 0.5),
        "trend_day_indicator": lambda c: flag(c._trend_day),
        "trend_day_direction": lambda c: F.when(c._trend_day, sign(c._signed_body)).otherwise(0),
        "consecutive_trend_days": lambda c: one_sided(c._trend_day, c),
    }


@group("F107")
def doji():
    return {
        "_doji": lambda c: c._body_share < 0.1,
        "doji_strict_indicator": lambda c: flag(c._doji),
        "doji_score": lambda c: clip(1 - c._body_share, 0, 1),
        "doji_type": lambda c: F.when(c._doji & (c._upper_wick > 2 * c._lower_wick + EPS), -1).when(
            c._doji & (c._lower_wick > 2 * c._upper_wick + EPS), 1).otherwise(0),
        "consecutive_doji_count": lambda c: streak(c._doji),
        "_move_run": lambda c: streak(c.close > c._prev_close) + streak(c.close < c._prev_close),
        "doji_after_trend": lambda c: flag(c._doji & (lag(c._move_run) >= 3)),
    }


@group("F108")
def marubozu():
    return {
        "_marubozu": lambda c: (c._upper_wick + c._lower_wick) / (c._range + EPS) < 0.1,
        "marubozu_indicator": lambda c: flag(c._marubozu),
        "marubozu_direction": lambda c: F.when(c._marubozu, sign(c._signed_body)).otherwise(0),
        "marubozu_strength": lambda c: clip(c._body_share, 0, 1),
        "consecutive_strong_candles": lambda c: one_sided(c._body_share > 0.7, c),
    }


@group("F109")
def spinning_top():
    def extreme(c):
        return (c.high >= over_rows(F.max(c.high), 20) * 0.98) \
            | (c.low <= over_rows(F.min(c.low), 20) * 1.02)

    return {
        "_spinning": lambda c: (c._body_share < 0.3) & (c._upper_wick > c._body)
        & (c._lower_wick > c._body),
        "spinning_top_indicator": lambda c: flag(c._spinning),
        "spinning_top_score": lambda c: clip(
            (c._upper_wick + c._lower_wick) / (c._body + EPS), 0, 10),
        "indecision_streak": lambda c: streak(c._spinning | c._doji),
        "indecision_at_extreme": lambda c: flag(c._spinning & extreme(c)),
    }


@group("F110")
def reversal():
    def last_three(name):
        return lambda c: flag(c[name] & lag(c[name], 1) & lag(c[name], 2))

    def star(first, now, side):
        return lambda c: flag(
            (sign(lag(c._signed_body, 2)) == first) & (lag(c._body_share, 1) < 0.3)
            & (sign(c._signed_body) == now)
            & ((c.close - (lag(c.open, 2) + lag(c.close, 2)) / 2) * side > 0))

    def contained(c):
        return (c._body_top <= lag(c._body_top)) & (c._body_bottom >= lag(c._body_bottom))

    return {
        "morning_star_indicator": star(-1, 1, 1),
        "evening_star_indicator": star(1, -1, -1),
        "_firm_up": lambda c: (c.close > c.open) & (c._upper_wick / (c._range + EPS) < 0.3),
        "_firm_down": lambda c: (c.close < c.open) & (c._lower_wick / (c._range + EPS) < 0.3),
        "three_white_soldiers": last_three("_firm_up"),
        "three_black_crows": last_three("_firm_down"),
        "_contained": contained,
        "harami_indicator": lambda c: F.when(
            c._contained & (c._prev_body < 0) & (c._signed_body > 0), 1).when(
            c._contained & (c._prev_body > 0) & (c._signed_body < 0), -1).otherwise(0),
    }


@group("F111")
def continuation():
    def match(c, x):
        return F.abs(c[x] - lag(c[x])) / (lag(c[x]) + EPS) < 0.001

    return {
        "_prev_mid": lambda c: (c._prev_open + c._prev_close) / 2,
        "piercing_line": lambda c: flag(
            (c._prev_body < 0) & (c._signed_body > 0) & (c.close > c._prev_mid)),
        "dark_cloud_cover": lambda c: flag(
            (c._prev_body > 0) & (c._signed_body < 0) & (c.close < c._prev_mid)),
        "tweezer_bottom": lambda c: flag(
            match(c, "low") & (lag(c.close, 2) > lag(c.close, 1))
            & (lag(c.close, 3) > lag(c.close, 2))),
        "tweezer_top": lambda c: flag(
            match(c, "high") & (lag(c.close, 2) < lag(c.close, 1))
            & (lag(c.close, 3) < lag(c.close, 2))),
    }


@group("F112")
def pattern_context():
    def count(name, n):
        return lambda c: over_rows(F.sum(c[name]), n)

    return {
        "_bullish": lambda c: c.morning_star_indicator + c.three_white_soldiers
        + flag(c.harami_indicator == 1),
        "_bearish": lambda c: c.evening_star_indicator + c.three_black_crows
        + flag(c.harami_indicator == -1),
        "_patterns": lambda c: c._bullish + c._bearish,
        "reversal_pattern_count_5d": count("_patterns", 5),
        "pattern_alignment_score": lambda c: sign(
            over_rows(F.sum(c._bullish), 5) - over_rows(F.sum(c._bearish), 5)),
        "pattern_cluster_indicator": lambda c: flag(over_rows(F.sum(c._patterns), 3) >= 2),
    }
