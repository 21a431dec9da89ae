"""Tier a500, weekly context, entropy, fractal and regime groups.

Kernel windows of this tier end at the row before the current one."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import kernels as K
from tickloom.functions.frames import (
    clip, ffill, frame, high, is_full, lag, lead, low, nz, pair_corr, quantile, range_share,
    ratio, running, sd, sign, since_start, streak, truth, values)
from tickloom.plans.registry import group, step, weekly
from tickloom.plans.tiers.a100 import aroon, slope
from tickloom.plans.tiers.a200 import changed


def _with_20_weeks(name):
    """Null for a series that has fewer than 20 weeks in all."""
    return lambda c: F.when(F.count(F.lit(1)).over(Window.partitionBy("key")) >= 20, c[name])


def bring_down(**pairs):
    """Weekly column -> daily column, delayed by a week and carried forward."""
    d = {}
    for daily, source in pairs.items():
        d[f"_w_{daily}"] = _with_20_weeks(source)
        d[f"_wk_{daily}"] = weekly(f"_w_{daily}")
        d[f"_d_{daily}"] = (lambda n: lambda c: ffill(c[f"_wk_{n}"]))(daily)
    return d


@group("F114")
def weekly_average():
    return {
        "_sma_20_change": lambda c: ratio(c._sma_20 - lag(c._sma_20, 5), lag(c._sma_20, 5)),
        "_sma_20_change_step": slope("_sma_20_change", 1),
        **bring_down(ma="_sma_20", ma_slope="_sma_20_change", ma_accel="_sma_20_change_step"),
        "weekly_ma_slope": lambda c: c._d_ma_slope + 0.0,
        "weekly_ma_slope_acceleration": lambda c: c._d_ma_accel + 0.0,
        "price_pct_from_weekly_ma": lambda c: ratio(c.close - c._d_ma, c._d_ma),
    }


@group("F115")
def weekly_rsi():
    return {
        "_rsi_14_change": slope("_rsi_14"), "_rsi_14_change_step": slope("_rsi_14_change", 1),
        **bring_down(rsi_slope="_rsi_14_change", rsi_accel="_rsi_14_change_step"),
        "weekly_rsi_slope": lambda c: c._d_rsi_slope + 0.0,
        "weekly_rsi_slope_acceleration": lambda c: c._d_rsi_accel + 0.0,
    }


@group("F116")
def weekly_bands():
    return {
        "_bb_ratio": lambda c: (c._bb_upper - c._bb_lower) / nz(c._bb_mid),
        "_bb_ratio_change": slope("_bb_ratio"),
        **bring_down(bb_position="bb_percent_b", bb_width="_bb_ratio",
                     bb_width_slope="_bb_ratio_change"),
        "weekly_bb_position": lambda c: c._d_bb_position + 0.0,
        "weekly_bb_width": lambda c: c._d_bb_width + 0.0,
        "weekly_bb_width_slope": lambda c: c._d_bb_width_slope + 0.0,
    }


@group("F117")
def alignment():
    return {
        "_trend_4": lambda c: sign(c._sma_4 - lag(c._sma_4)),
        "_atr_share_4": lambda c: c._atr_4 / nz(c.close),
        "_atr_place_4": lambda c: range_share(c._atr_share_4, 12),
        "_atr_share": lambda c: c._atr_14 / nz(c.close),
        "_atr_place": lambda c: range_share(c._atr_share, 60),
        "_trend_20": lambda c: sign(c._sma_20 - lag(c._sma_20, 5)),
        **bring_down(trend="_trend_4", rsi="_rsi_14", vol="_atr_place_4"),
        "trend_alignment_daily_weekly": lambda c: F.when(
            (c._trend_20 > 0) & (c._d_trend > 0), 1).when(
            (c._trend_20 < 0) & (c._d_trend < 0), -1).otherwise(0),
        "rsi_alignment_daily_weekly": lambda c: c._rsi_14 - c._d_rsi,
        "vol_alignment_daily_weekly": lambda c: c._atr_place - c._d_vol,
    }


def regime3(x):
    """-1, 0, 1 below, between and above 0.33 and 0.67; null stays null."""
    return F.when(x < 0.33, -1).when(x > 0.67, 1).when(x.isNotNull(), 0)


@group("F121")
def entropies():
    return {
        "_before_20": lambda c: values(c.close, 20, -1),
        "_pe": step("rolling_permutation", "close", n=20, order=4, shift=1),
        "permutation_entropy_slope": slope("_pe"),
        "permutation_entropy_acceleration": slope("permutation_entropy_slope"),
        "sample_entropy_20d": step("rolling_sample_entropy", "close", n=20, shift=1),
        "sample_entropy_slope": slope("sample_entropy_20d"),
        "sample_entropy_acceleration": slope("sample_entropy_slope"),
        "entropy_percentile_60d": lambda c: range_share(c._pe, 60),
        "_vol_20": lambda c: sd(c._ret, 20),
        "_vol_20_scaled": lambda c: ratio(c._vol_20, high(c._vol_20, 60)),
        "entropy_vol_ratio": lambda c: clip(ratio(c._pe, c._vol_20_scaled), 0, 10),
        "entropy_regime_score": lambda c: (c.entropy_percentile_60d - 0.5) * 2,
    }


@group("F122")
def complexity():
    def auto(k):
        return lambda c: F.when(is_full(c._ret, 20),
                                pair_corr(c._ret, c[f"_ret_before_{k}"], 20 - k))

    return {
        # a 20-row window leaves no second scale, so the exponent is constant
        "hurst_exponent_20d": lambda c: F.when(c._rn > 20, 0.5),
        "hurst_exponent_slope": slope("hurst_exponent_20d"),
        "_ret_before_1": lambda c: lag(c._ret, 1), "_ret_before_5": lambda c: lag(c._ret, 5),
        "autocorr_lag1": auto(1), "autocorr_lag5": auto(5),
        "autocorr_partial_lag1": lambda c: c.autocorr_lag1 + 0.0,
        "fractal_dimension_20d": lambda c: K.apply(
            K.curve_length_dimension(5, True, True), c._before_20),
    }


@group("F125")
def approximate_entropy():
    return {
        "approx_entropy_20d": step("rolling_approximate_entropy", "close", n=20, shift=1),
        "approx_entropy_slope": slope("approx_entropy_20d"),
        "approx_entropy_percentile_60d": lambda c: range_share(c.approx_entropy_20d, 60),
        "approx_entropy_regime": lambda c: regime3(c.approx_entropy_percentile_60d),
    }


@group("F126")
def spectral():
    return {
        "spectral_entropy_20d": lambda c: K.apply(K.spectral_entropy, c._before_20),
        "spectral_entropy_slope": slope("spectral_entropy_20d"),
        "spectral_entropy_percentile_60d": lambda c: range_share(c.spectral_entropy_20d, 60),
        "_atr_share_scaled": lambda c: ratio(c._atr_share, high(c._atr_share, 60)),
        "spectral_vs_volatility_ratio": lambda c: clip(
            ratio(c.spectral_entropy_20d, c._atr_share_scaled), 0, 10),
        "spectral_entropy_regime": lambda c: regime3(c.spectral_entropy_percentile_60d),
    }


@group("F127")
def multiscale():
    def spread(c):
        # population spread of the scales that exist; at least two are needed
        xs = [c.entropy_scale_5d, c.entropy_scale_10d, c._pe]
        n = sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int"))
        zero = [F.coalesce(x, F.lit(0.0)) for x in xs]
        m = (zero[0] + zero[1] + zero[2]) / nz(n)
        dev = [F.coalesce((x - m) * (x - m), F.lit(0.0)) for x in xs]
        return F.when(n >= 2, F.sqrt((dev[0] + dev[1] + dev[2]) / n))

    return {
        "entropy_scale_5d": step("rolling_permutation", "close", n=5, order=3, shift=1),
        "entropy_scale_10d": step("rolling_permutation", "close", n=10, order=3, shift=1),
        "entropy_scale_ratio_5_20": lambda c: clip(ratio(c.entropy_scale_5d, c._pe), 0.1, 10),
        "entropy_scale_ratio_10_20": lambda c: clip(ratio(c.entropy_scale_10d, c._pe), 0.1, 10),
        "entropy_scale_consistency": spread,
    }


@group("F128")
def entropy_and_volatility():
    return {
        "entropy_vol_divergence": lambda c: c.entropy_percentile_60d - c._atr_place,
        "entropy_vol_correlation_20d": lambda c: pair_corr(c._pe, c._atr_share, 20),
        "_entropy_regime": lambda c: regime3(c.entropy_percentile_60d),
        "_vol_regime": lambda c: regime3(c._atr_place),
        "entropy_vol_regime_match": lambda c: (c._entropy_regime == c._vol_regime).cast("double"),
        "hidden_instability_score": lambda c: c.entropy_percentile_60d * (1 - c._atr_place),
        "_pe_change": slope("_pe"), "_atr_share_change": slope("_atr_share"),
    }


@group("F128", lookahead=True)
def entropy_lead():
    """These two read five rows ahead, as the columns they stand for do."""
    return {
        "_atr_share_next": lambda c: lead(c._atr_share_change, 5),
        "_pe_next": lambda c: lead(c._pe_change, 5),
        "entropy_leading_vol": lambda c: pair_corr(c._pe_change, c._atr_share_next, 20),
        "vol_leading_entropy": lambda c: pair_corr(c._atr_share_change, c._pe_next, 20),
    }


@group("F129")
def entropy_dynamics():
    return {
        "_entropy_regime_starts": changed("_entropy_regime"),
        "entropy_regime_duration": lambda c: F.when(
            c._entropy_regime.isNotNull(), since_start(c._entropy_regime_starts).cast("double")),
        "_entropy_regime_moved": lambda c: (
            c._entropy_regime != lag(c._entropy_regime)).cast("double"),
        "entropy_regime_change_count_20d": lambda c: F.when(
            is_full(c._entropy_regime_moved, 20),
            F.sum(c._entropy_regime_moved).over(frame(-19))),
        "perm_entropy_trend_5d": slope("_pe"),
        "perm_entropy_acceleration_5d": slope("perm_entropy_trend_5d"),
        "_pe_spread": lambda c: sd(c._pe, 20),
        "entropy_stability_score": lambda c: clip(
            1 - ratio(c._pe_spread, high(c._pe_spread, 60)), 0, 1),
    }


@group("F130")
def fractals():
    return {
        "katz_fd_20d": lambda c: K.apply(K.katz, c._before_20),
        "katz_fd_slope": slope("katz_fd_20d"),
        "petrosian_fd_20d": lambda c: K.apply(K.petrosian, c._before_20),
        "petrosian_fd_slope": slope("petrosian_fd_20d"),
        "_before_40": lambda c: values(c.close, 40, -1),
        "_higuchi_40": lambda c: K.apply(K.curve_length_dimension(10, True, False), c._before_40),
        "fd_diversity_ratio": lambda c: ratio(c._higuchi_40, c.katz_fd_20d),
        "_fd_mean": lambda c: (c.katz_fd_20d + c.petrosian_fd_20d) / 2,
        "fd_regime_score": lambda c: 2 * range_share(c._fd_mean, 60) - 1,
    }


@group("F131")
def fluctuation():
    return {
        "dfa_alpha_20d": lambda c: K.apply(K.dfa_exponent, c._before_40),
        "dfa_alpha_slope": slope("dfa_alpha_20d"),
        "dfa_crossover_scale": lambda c: K.apply(K.crossover_scale, c._before_40),
        "dfa_trend_strength": lambda c: F.abs(c.dfa_alpha_20d - 0.5),
    }


@group("F132")
def hurst():
    return {
        "_before_30": lambda c: values(c.close, 30, -1),
        "hurst_rs_30d": lambda c: K.apply(K.rescaled_range, c._before_30),
        "hurst_rs_slope": slope("hurst_rs_30d"),
        "hurst_regime": lambda c: F.when(c.hurst_rs_30d < 0.4, 0.0).when(
            c.hurst_rs_30d < 0.5, 1.0).when(c.hurst_rs_30d < 0.6, 2.0).when(
            c.hurst_rs_30d.isNotNull(), 3.0),
        "_span_14": lambda c: high(c.close, 14) - low(c.close, 14),
        "hurst_vs_volatility": lambda c: c.hurst_rs_30d / (
            range_share(c._span_14, 50, eps=1e-10) + 0.1),
        # a null row neither counts nor ends a run
        "_hurst_known": lambda c: F.count(c.hurst_regime).over(running()),
        "_hurst_filled": lambda c: ffill(c.hurst_regime),
        "_hurst_prev": lambda c: lag(c._hurst_filled),
        "_hurst_start": lambda c: F.max(F.when(
            c.hurst_regime.isNotNull() & ~c.hurst_regime.eqNullSafe(c._hurst_prev),
            c._hurst_known)).over(running()),
        "days_in_hurst_regime": lambda c: F.when(
            c.hurst_regime.isNotNull(), (c._hurst_known - c._hurst_start + 1).cast("double")),
        "hurst_regime_transition_prob": lambda c: clip(
            range_share(c._vol_20, 50, eps=1e-10), 0, 1),
    }


@group("F133")
def long_entropies():
    return {
        "sample_entropy_30d": step("rolling_sample_entropy", "close", n=30, shift=1, standard=True),
        "approximate_entropy_30d": step("rolling_approximate_entropy", "close", n=30, floor=False, shift=1),
        "entropy_atr_ratio": lambda c: c.sample_entropy_30d / (c._atr_share + 1e-10),
        "_se_low": lambda c: quantile(c.sample_entropy_30d, 50, 0.3),
        "_se_high": lambda c: quantile(c.sample_entropy_30d, 50, 0.7),
        "entropy_regime": lambda c: F.when(c.sample_entropy_30d <= c._se_low, 0.0).when(
            c.sample_entropy_30d <= c._se_high, 1.0).when(
            c.sample_entropy_30d > c._se_high, 2.0),
        "entropy_change_10d": slope("sample_entropy_30d", 10),
    }


@group("F134")
def short_aroon():
    def middle(x):
        return (x >= 30) & (x <= 70)

    return {
        "aroon_up_14": lambda c: aroon(c, 14, True),
        "aroon_down_14": lambda c: aroon(c, 14, False),
        "aroon_oscillator_14": lambda c: c.aroon_up_14 - c.aroon_down_14,
        "_aroon_cross": lambda c: F.when(
            (lag(c.aroon_oscillator_14) <= 0) & (c.aroon_oscillator_14 > 0), 1).when(
            (lag(c.aroon_oscillator_14) >= 0) & (c.aroon_oscillator_14 < 0), -1),
        "aroon_crossover_recency": lambda c: signed_age(c, "_aroon_cross"),
        "aroon_consolidation": lambda c: (
            middle(c.aroon_up_14) & middle(c.aroon_down_14)).cast("double"),
    }


def signed_age(c, event):
    """Rows since the latest event with the event's sign; null before the first."""
    age = since_start(c[event].isNotNull()) - 1
    return (ffill(c[event]) * age).cast("double")


@group("F135")
def squeeze():
    return {
        "squeeze_on_14": lambda c: c._squeeze.cast("double"),
        "squeeze_duration_14": lambda c: F.when(
            c.squeeze_on_14.isNotNull(), streak(c.squeeze_on_14 == 1).cast("double")),
        "_squeeze_fire": lambda c: F.when(
            (lag(c.squeeze_on_14) == 1) & (c.squeeze_on_14 == 0),
            F.when(c.close - lag(c.close, 14) > 0, 1).otherwise(-1)),
        "squeeze_fire_recency": lambda c: signed_age(c, "_squeeze_fire"),
        "_stop_upper_14": step("band", "_mid", "_atr_14", width=3.0),
        "_stop_lower_14": step("band", "_mid", "_atr_14", width=-3.0),
        "_stop_side_14": step("stop_side", "close", "_stop_upper_14", "_stop_lower_14", at=14),
        "_stop_flip": lambda c: F.when(
            c._stop_side_14 != lag(c._stop_side_14), c._stop_side_14),
        "supertrend_flip_recency_14": lambda c: signed_age(c, "_stop_flip"),
        "_stop_upper_20": step("band", "_mid", "_atr_20", width=3.0),
        "_stop_lower_20": step("band", "_mid", "_atr_20", width=-3.0),
        "_stop_20": step("stop_line", "close", "_stop_upper_20", "_stop_lower_20", at=20),
        "pct_from_supertrend_20": lambda c: ratio(c.close - c._stop_20, c._stop_20) * 100,
        "supertrend_slope": slope("_stop_20"),
    }


@group("F136")
def cycle():
    def score(*parts):
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return clip(out, 0, 1)

    return {
        "_gain_20": lambda c: c.close / lag(c.close, 20) - 1,
        "_busy": lambda c: clip(c.volume / (c._vol_mean_20 + 1e-10), 0.5, 2) / 2,
        "_place_20": lambda c: (c.close - low(c.close, 20))
        / (high(c.close, 20) - low(c.close, 20) + 1e-10),
        "_vol_place": lambda c: range_share(c._vol_20, 50, eps=1e-10),
        "_push": lambda c: clip(c._gain_20, -0.2, 0.2) / 0.2,
        "accumulation_score": lambda c: score(
            (1 - c._place_20) * 0.4, c._busy * 0.3, (1 - c._vol_place) * 0.3),
        "markup_score": lambda c: score(
            truth(c._gain_20 > 0).cast("double") * 0.3, c._push * 0.3, c._busy * 0.2,
            c._place_20 * 0.2),
        "distribution_score": lambda c: score(
            c._place_20 * 0.4, c._busy * 0.3, c._vol_place * 0.3),
        "markdown_score": lambda c: score(
            truth(c._gain_20 < 0).cast("double") * 0.3, -c._push * 0.3, c._busy * 0.2,
            (1 - c._place_20) * 0.2),
        # greatest skips unknown scores; the first of equal scores wins
        "cycle_phase_confidence": lambda c: F.greatest(
            c.accumulation_score, c.markup_score, c.distribution_score, c.markdown_score),
        "cycle_phase": lambda c: F.when(c.accumulation_score == c.cycle_phase_confidence, 0.0)
        .when(c.markup_score == c.cycle_phase_confidence, 1.0)
        .when(c.distribution_score == c.cycle_phase_confidence, 2.0)
        .when(c.markdown_score == c.cycle_phase_confidence, 3.0),
    }
