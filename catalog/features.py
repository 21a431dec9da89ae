"""Registered feature queries: one per indicator group."""

from __future__ import annotations

from catalog.inputs import daily_bars, index_bars, rounded, second_series
from tickloom.plans.features import feature_table
from tickloom.plans.registry import GROUPS


def _needs_vix(gid: str) -> bool:
    return gid in ("F025", "F030")


def _group_query(gid: str, names: list[str]):
    def run(spark, sf):
        vix = second_series(spark, sf) if _needs_vix(gid) else None
        return rounded(feature_table(daily_bars(spark, sf), names, vix, warm_up="keep"),
                       DIGITS.get(gid, 6))
    return run


def queries() -> dict:
    out = {}
    for gid, names in GROUPS.items():
        if gid == "F013":
            out["F013_volatility_index"] = lambda spark, sf: rounded(
                feature_table(index_bars(spark, sf), "vix"), DIGITS["F013"])
        elif gid != "base":
            title = TITLES[gid]
            out[f"{gid}_{title}"] = _group_query(gid, names + (["obv"] if gid == "F006" else []))
    return out


# groups with large or averaged values are compared to fewer digits
DIGITS = {"F013": 4, "F036": 3, "F044": 4, "F056": 1, "F087": 1, "F135": 3}

TITLES = {
    "F013": "volatility_index",
    "F002": "moving_averages", "F003": "oscillators", "F005": "weekly_oscillators",
    "F006": "other_indicators", "F014": "returns", "F015": "gap_and_intraday",
    "F016": "rsi_derivatives", "F017": "ma_derivatives", "F018": "volatility", "F019": "volume",
    "F020": "risk", "F021": "klinger", "F022": "qqe", "F023": "schaff",
    "F025": "volatility_premium", "F027": "accelerations", "F028": "smoothed_derivatives",
    "F029": "standard_oscillators", "F030": "premium_extensions", "F031": "extended_risk",
    "F032": "value_at_risk", "F033": "ma_extensions", "F034": "rows_since_cross",
    "F035": "advanced_volatility", "F036": "trend", "F037": "volume_lines", "F038": "expectancy",
    "F039": "support_resistance", "F041": "triple_ema", "F042": "weighted_ma",
    "F043": "adaptive_ma", "F044": "hull", "F045": "volume_weighted", "F046": "derived_ma",
    "F048": "duration_counters", "F050": "cross_recency", "F051": "proximity", "F052": "bands",
    "F053": "rsi_duration", "F054": "mean_reversion", "F055": "consecutive",
    "F056": "macd_extensions", "F057": "volume_dynamics", "F058": "calendar", "F059": "candle",
    "F060": "ichimoku", "F061": "donchian", "F062": "divergence", "F064": "entropy_regime",
    "F066": "more_sma", "F067": "more_ema", "F068": "ma_slopes", "F069": "ma_distance",
    "F070": "ma_proximity", "F073": "more_durations", "F074": "more_crosses",
    "F075": "ma_acceleration", "F076": "short_oscillators", "F077": "oscillator_derivatives",
    "F078": "atr_extended", "F079": "atr_dynamics", "F080": "true_range",
    "F081": "volatility_estimators", "F082": "band_dynamics", "F083": "keltner",
    "F084": "volatility_regime", "F085": "volume_vectors", "F086": "vwap",
    "F087": "volume_indicators", "F088": "volume_price", "F089": "volume_regime",
    "F090": "adx_extended", "F091": "trend_exhaustion", "F092": "trend_regime",
    "F093": "trend_channel", "F094": "aroon_extended", "F095": "range_position",
    "F096": "distance_from_extremes", "F097": "recency_of_extremes", "F098": "breakout",
    "F099": "range_dynamics", "F100": "fibonacci", "F101": "engulfing", "F102": "wick_rejection",
    "F103": "gaps", "F104": "inside_outside", "F105": "range_extremes", "F106": "trend_days",
    "F107": "doji", "F108": "marubozu", "F109": "spinning_top", "F110": "reversal",
    "F111": "continuation", "F112": "pattern_context", "F114": "weekly_average",
    "F115": "weekly_rsi", "F116": "weekly_bands", "F117": "alignment", "F121": "entropies",
    "F122": "complexity", "F125": "approximate_entropy", "F126": "spectral",
    "F127": "multiscale", "F128": "entropy_and_volatility", "F129": "entropy_dynamics",
    "F130": "fractals", "F131": "fluctuation", "F132": "hurst", "F133": "long_entropies",
    "F134": "short_aroon", "F135": "squeeze", "F136": "cycle",
}
