"""Registered queries: evaluation and calibration of prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import daily_bars, predictions, quality_predictions, rounded
from tickloom.functions import frames as W
from tickloom.functions.hashing import uniform
from tickloom.operators import evaluate as E
from tickloom.operators import labels
from tickloom.operators.isotonic import isotonic_fit


def _scored_bars(spark, sf):
    b = daily_bars(spark, sf)
    return b.select("key", "ts", "close", W.lead("high").alias("next_high"),
                    F.round(uniform(7, "key", "ts"), 4).alias("prob"), labels.high_label(1, 0.01).alias("label"))


def queries() -> dict:
    def on(fn, source=predictions, digits=6):
        return lambda spark, sf: rounded(fn(source(spark, sf)), digits)

    q = {
        "E01_confusion": on(E.confusion),
        "E02_rates": on(lambda p: E.with_rates(E.confusion(p, 0.6))),
        "E03_roc_auc": on(E.roc_auc),
        "E03_roc_auc_quality": on(E.roc_auc, quality_predictions),
        "E04_detailed": on(E.detailed),
        "E05_threshold_sweep": on(E.threshold_sweep),
        "E06_precision_recall": on(lambda p: E.precision_recall(p).drop("n_neg", "n_pos")),
        "E06_precision_recall_summary": on(E.precision_recall_summary),
        "E07_forecast_metrics": on(lambda p: E.forecast_metrics(p, 0.5)),
        "E08_baseline_comparison": on(lambda p: E.baseline_comparison(E.roc_auc(p)).drop("n_pos", "n_neg")),
        "E09_calibration_error": on(E.calibration_error),
        "E10_reliability": on(E.reliability),
        "E11_platt": on(E.platt, quality_predictions, 3),
        "E12_isotonic": on(E.isotonic, quality_predictions),
        "E12_isotonic_runs": on(E.isotonic),
        "E12_isotonic_blocks": on(isotonic_fit),
        "E13_temperature": on(E.temperature),
        "E13_temperature_applied": on(lambda p: E.apply_temperature(p, E.temperature(p)), quality_predictions, 5),
        "E14_bce": on(lambda p: E.losses(p, bce=E.bce(), weighted_bce=E.bce(3.0))),
        "E15_soft_auc": on(E.soft_auc, digits=8),
        "E15_soft_auc_steep": on(lambda p: E.soft_auc(p, gamma=10.0), digits=8),
        "E16_blended_loss": on(E.blended_loss),
        "E18_trade_summary": lambda spark, sf: rounded(E.trade_summary(E.trades(_scored_bars(spark, sf)))),
        "E17_trades": lambda spark, sf: rounded(E.trades(_scored_bars(spark, sf))),
        "E19_ensemble": on(E.ensemble),
        "E20_smoothed_bce": on(lambda p: E.losses(p, loss=E.smoothed_bce())),
        "E21_focal": on(lambda p: E.losses(p, loss=E.focal())),
        "E22_mild_focal": on(lambda p: E.losses(p, loss=E.mild_focal())),
        "E23_asymmetric_focal": on(lambda p: E.losses(p, loss=E.asymmetric_focal())),
        "E24_entropy_bce": on(lambda p: E.losses(p, loss=E.entropy_bce())),
        "E25_variance_bce": on(lambda p: E.losses(p, loss=E.variance_bce())),
        "E26_separation": on(E.separation),
    }
    return q
