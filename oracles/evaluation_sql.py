"""DuckDB queries for evaluation and calibration."""

from __future__ import annotations

from oracles.base import P, Q, rnd
from oracles.series_sql import QUALITY, prediction_sql, u

PRED = prediction_sql()
CLIP = "greatest(1e-7, least(1 - 1e-7, prob))"


def counts(threshold, op=">="):
    return (f"count(*) FILTER (WHERE prob {op} {threshold} AND label = 1) AS tp, count(*) FILTER (WHERE prob {op} {threshold} AND label = 0) AS fp, "
            f"count(*) FILTER (WHERE NOT prob {op} {threshold} AND label = 1) AS fn, count(*) FILTER (WHERE NOT prob {op} {threshold} AND label = 0) AS tn")


def rates(src):
    """Adds rates to tp, fp, fn, tn."""
    return (f"SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (SELECT *, "
            f"coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, "
            f"coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM ({src}))")


def auc(src):
    """Rank-sum form: mean rank over ties."""
    return (f"SELECT run_id, sum(label) AS n_pos, count(*) - sum(label) AS n_neg, (sum(CASE WHEN label = 1 THEN r END) - "
            f"sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc FROM ("
            f"SELECT *, rank() OVER (PARTITION BY run_id ORDER BY prob) + (count(*) OVER (PARTITION BY run_id, prob) - 1) / 2.0 AS r "
            f"FROM ({src})) GROUP BY run_id")


def out(src, cols, ints=(), keys=("run_id",), digits=6):
    parts = list(keys) + [f"{rnd(c, digits)} AS {c}" for c in cols.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in (ints.split() if ints else ())]
    return f"SELECT {', '.join(parts)} FROM ({src})"


def loss(expr):
    return out(f"SELECT run_id, {expr} AS loss FROM (SELECT *, {CLIP} AS p FROM ({PRED})) GROUP BY run_id", "loss")


def newton(src, steps=8):
    """Temperature per run from unrolled Newton steps on 1/T."""
    ctes = [f"d AS MATERIALIZED (SELECT run_id, label, ln({CLIP} / (1 - {CLIP})) AS z FROM ({src}))",
            "s0 AS (SELECT DISTINCT run_id, 1.0::DOUBLE AS b FROM d)"]
    for i in range(steps):
        ctes.append(
            f"s{i + 1} AS MATERIALIZED (SELECT run_id, greatest(0.1, least(100.0, b - coalesce(sum((s - label) * z) / nullif(sum(s * (1 - s) * z * z), 0), 0))) AS b "
            f"FROM (SELECT d.run_id, b, label, z, 1 / (1 + exp(-b * z)) AS s FROM d JOIN s{i} ON s{i}.run_id = d.run_id) GROUP BY run_id, b)")
    return f"WITH {', '.join(ctes)} SELECT run_id, 1 / b AS temperature FROM s{steps}"


def soft(gamma):
    """All pairs of distinct scores, weighted by their counts."""
    g = f"SELECT run_id, prob, sum(label) AS pos, count(*) - sum(label) AS neg FROM ({PRED}) GROUP BY 1, 2"
    return (f"SELECT a.run_id, sum(a.neg * b.pos / (1 + exp(-{gamma} * (a.prob - b.prob)))) / sum(a.neg * b.pos) AS soft_auc "
            f"FROM ({g}) a JOIN ({g}) b ON a.run_id = b.run_id WHERE a.neg > 0 AND b.pos > 0 GROUP BY a.run_id")


def isotonic(src):
    """Max-min formula over the distinct scores of a run: the largest, over starts at or
    before a score, of the least mean from that start to an end at or after it."""
    g = f"SELECT run_id, prob, count(*) AS n, sum(label) AS pos FROM ({src}) GROUP BY 1, 2"
    c = f"SELECT *, sum(n) OVER w AS cw, sum(pos) OVER w AS cs FROM ({g}) WINDOW w AS (PARTITION BY run_id ORDER BY prob)"
    pairs = (f"SELECT a.run_id, a.prob AS a, b.prob AS b, (b.cs - a.cs + a.pos)::DOUBLE / (b.cw - a.cw + a.n)::DOUBLE AS m "
             f"FROM c a JOIN c b ON a.run_id = b.run_id AND a.prob <= b.prob")
    least = f"SELECT run_id, a, b, min(m) OVER (PARTITION BY run_id, a ORDER BY b DESC) AS m FROM ({pairs})"
    return f"WITH c AS MATERIALIZED ({c}) SELECT run_id, b AS prob, max(m) AS fitted FROM ({least}) GROUP BY 1, 2"


def curve():
    return (f"SELECT run_id, prob, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY run_id) AS n_pos "
            f"FROM (SELECT run_id, prob, sum(label) AS pos, count(*) - sum(label) AS neg FROM ({PRED}) GROUP BY 1, 2) "
            f"WINDOW w AS (PARTITION BY run_id ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)")


def oracle_sql() -> dict[str, str]:
    o = {}
    o["E01_confusion"] = f"SELECT run_id, {counts(0.5)} FROM ({PRED}) GROUP BY run_id"
    o["E02_rates"] = out(rates(f"SELECT run_id, {counts(0.6)} FROM ({PRED}) GROUP BY run_id"), "accuracy precision recall f1", "tp fp fn tn")
    o["E03_roc_auc"] = out(auc(PRED), "auc", "n_pos n_neg")
    o["E03_roc_auc_quality"] = out(auc(QUALITY), "auc", "n_pos n_neg")
    det = rates(f"SELECT run_id, {counts(0.5)}, min(prob) AS pred_min, max(prob) AS pred_max, count(*) AS n_samples FROM ({PRED}) GROUP BY run_id")
    o["E04_detailed"] = out(f"SELECT d.*, a.auc FROM ({det}) d JOIN ({auc(PRED)}) a ON a.run_id = d.run_id",
                            "accuracy precision recall f1 pred_min pred_max auc", "tp fp fn tn n_samples")
    ts = ", ".join(f"{0.10 + 0.05 * i:.2f}" for i in range(17))
    sweep = (f"SELECT run_id, t AS threshold, {counts('t')} FROM ({PRED}), (SELECT CAST(unnest([{ts}]) AS DOUBLE) AS t) GROUP BY run_id, t")
    o["E05_threshold_sweep"] = out(f"SELECT *, tp + fp AS n_positive_preds FROM ({rates(sweep)})",
                                   "threshold accuracy precision recall f1", "tp fp fn tn n_positive_preds")
    pr = f"SELECT *, tp / (tp + fp) AS precision, tp / n_pos AS recall FROM ({curve()})"
    o["E06_precision_recall"] = out(pr, "prob precision recall", "pos neg tp fp")
    # the curve from low to high score with its closing point
    pts = (f"SELECT run_id, prob, precision, recall FROM ({pr}) UNION ALL SELECT DISTINCT run_id, 2.0, 1.0, 0.0 FROM ({PRED})")
    lead = (f"SELECT *, lead(precision) OVER w AS p1, lead(recall) OVER w AS r1 FROM ({pts}) WINDOW w AS (PARTITION BY run_id ORDER BY prob)")
    best = ", ".join(f"arg_min(precision, (abs(recall - {r}), prob)) AS precision_at_recall_{int(r * 100)}, "
                     f"arg_min(recall, (abs(recall - {r}), prob)) AS actual_recall_{int(r * 100)}" for r in (0.1, 0.2, 0.3, 0.4, 0.5))
    best = best.replace("(abs(", "{'d': abs(").replace(", prob))", ", 'p': prob})")
    o["E06_precision_recall_summary"] = out(
        f"SELECT run_id, sum((recall - r1) * (precision + p1) / 2) AS auc_pr, {best} FROM ({lead}) GROUP BY run_id",
        "auc_pr " + " ".join(f"precision_at_recall_{n} actual_recall_{n}" for n in (10, 20, 30, 40, 50)))
    fc = rates(f"SELECT run_id, {counts(0.5, '>')}, avg(pow(prob - actual_return, 2)) AS mse, avg(abs(prob - actual_return)) AS mae, "
               f"avg(CASE WHEN (prob > 0) = (actual_return > 0) THEN 1.0 ELSE 0.0 END) AS direction_accuracy FROM ({PRED}) GROUP BY run_id")
    o["E07_forecast_metrics"] = out(fc, "mse mae direction_accuracy accuracy precision recall f1", "tp fp fn tn")
    o["E08_baseline_comparison"] = (f"SELECT run_id, {rnd('auc')} AS auc, {rnd('auc - 0.718')} AS delta_auc, {rnd('(auc - 0.718) / 0.718 * 100')} AS improvement_pct, "
                                    f"auc >= 0.7 AS meets_threshold, auc > 0.718 AS beats_baseline, "
                                    f"CASE WHEN auc IS NULL THEN 'FAILED' WHEN auc >= 0.74 THEN 'BEAT' WHEN auc >= 0.7 THEN 'VIABLE' ELSE 'WORSE' END AS status FROM ({auc(PRED)})")
    edge = "list_sum(list_transform(range(1, 10), lambda i: CASE WHEN prob >= i * 0.1::DOUBLE THEN 1 ELSE 0 END))"
    bins = f"SELECT run_id, CAST({edge} AS INT) AS bin, count(*) AS n, avg(label) AS accuracy, avg(prob) AS confidence FROM ({PRED}) GROUP BY 1, 2"
    o["E09_calibration_error"] = out(f"SELECT run_id, sum(n * abs(accuracy - confidence)) / sum(n) AS ece FROM ({bins}) GROUP BY run_id", "ece")
    o["E10_reliability"] = out(
        f"SELECT f.run_id, f.bin, f.bin / 10 AS lower, (f.bin + 1) / 10 AS upper, coalesce(b.n, 0) AS n, coalesce(b.accuracy, 0) AS accuracy, "
        f"coalesce(b.confidence, (f.bin + 0.5) / 10) AS confidence FROM (SELECT DISTINCT run_id, g.i AS bin FROM ({PRED}), range(0, 10) g(i)) f "
        f"LEFT JOIN ({bins}) b ON b.run_id = f.run_id AND b.bin = f.bin", "lower upper accuracy confidence", "bin n")
    for name, src, more in (("E12_isotonic", QUALITY, ""), ("E12_isotonic_runs", PRED, " actual_return")):
        o[name] = out(f"SELECT q.*, i.fitted AS calibrated FROM ({src}) q JOIN ({isotonic(src)}) i ON i.run_id = q.run_id AND i.prob = q.prob",
                      "prob calibrated" + more, "sample_id label")
    o["E12_isotonic_blocks"] = out(
        f"SELECT p.run_id, min(p.prob) AS low, max(p.prob) AS high, count(*) AS n, any_value(fitted) AS value "
        f"FROM ({PRED}) p JOIN ({isotonic(PRED)}) i ON i.run_id = p.run_id AND i.prob = p.prob GROUP BY p.run_id, fitted", "low high value", "n")
    o["E13_temperature"] = out(newton(PRED), "temperature")
    z = f"ln({CLIP} / (1 - {CLIP}))"
    o["E13_temperature_applied"] = out(
        f"SELECT q.*, t.temperature, 1 / (1 + exp(-{z} / t.temperature)) AS calibrated FROM ({QUALITY}) q JOIN ({newton(QUALITY)}) t ON t.run_id = q.run_id",
        "prob temperature calibrated", "sample_id label", digits=5)
    o["E14_bce"] = out(f"SELECT run_id, -avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) AS bce, "
                       f"-avg(CASE WHEN label = 1 THEN 3 * ln(p) ELSE ln(1 - p) END) AS weighted_bce FROM (SELECT *, {CLIP} AS p FROM ({PRED})) GROUP BY run_id",
                       "bce weighted_bce")
    o["E15_soft_auc"] = out(soft(2.0), "soft_auc", digits=8)
    o["E15_soft_auc_steep"] = out(soft(10.0), "soft_auc", digits=8)
    b = f"SELECT run_id, -avg(CASE WHEN label = 1 THEN ln({CLIP}) ELSE ln(1 - {CLIP}) END) AS bce FROM ({PRED}) GROUP BY run_id"
    o["E16_blended_loss"] = out(f"SELECT b.run_id, 0.5 * bce + 0.5 * soft_auc AS blended FROM ({b}) b JOIN ({soft(2.0)}) s ON s.run_id = b.run_id", "blended")
    w = f"lead(high) OVER ({P})"
    q = Q().add(nh=w).add(prob=f"round({u(chr(39) + '7' + chr(39), 'CAST(key AS VARCHAR)', 'CAST(ts AS VARCHAR)')}, 4)",
                          label="CASE WHEN nh IS NOT NULL THEN CASE WHEN nh >= close * 1.01 THEN 1 ELSE 0 END END")
    q.raw("SELECT *, CASE WHEN label = 1 THEN 'WIN' ELSE 'LOSS' END AS result FROM {t} WHERE prob >= 0.3 AND nh IS NOT NULL")
    o["E17_trades"] = q.out({"prob": "prob", "close": "close", "next_high": "nh", "target_price": "close * 1.01"}, "label",
                            keys="key, CAST(ts AS VARCHAR) AS ts, result")
    o["E18_trade_summary"] = (f"WITH RECURSIVE {', '.join(q.ctes)} SELECT count(*) AS trades, count(*) FILTER (WHERE label = 1) AS wins, "
                              f"count(*) FILTER (WHERE label = 0) AS losses FROM {q.cur}")
    o["E19_ensemble"] = out(f"SELECT sample_id, avg(prob) AS prob, count(*) AS n_models FROM ({PRED}) GROUP BY 1", "prob", "n_models", keys=("sample_id",))
    o["E20_smoothed_bce"] = loss("-avg(CASE WHEN label = 1 THEN 0.9 * ln(p) + 0.1 * ln(1 - p) ELSE 0.1 * ln(p) + 0.9 * ln(1 - p) END)")
    focal = "-avg(CASE WHEN label = 1 THEN {a} * pow(1 - p, {g}) * ln(p) ELSE (1 - {a}) * pow(p, {g}) * ln(1 - p) END)"
    o["E21_focal"] = loss(focal.format(a=0.25, g=2.0))
    o["E22_mild_focal"] = loss(focal.format(a=0.5, g=0.75))
    o["E23_asymmetric_focal"] = loss("-avg(CASE WHEN label = 1 THEN 0.5 * (1 - p) * ln(p) ELSE 0.5 * p * p * ln(1 - p) END)")
    o["E24_entropy_bce"] = loss("avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END + 0.1 * (p * ln(p) + (1 - p) * ln(1 - p)))")
    o["E25_variance_bce"] = loss("avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END) - 0.5 * coalesce(var_samp(prob), 0)")
    sep = f"SELECT run_id, avg(prob) FILTER (WHERE label = 1) AS pos_mean, avg(prob) FILTER (WHERE label = 0) AS neg_mean, max(prob) - min(prob) AS pred_range, stddev_pop(prob) AS pred_std FROM ({PRED}) GROUP BY run_id"
    o["E26_separation"] = out(f"SELECT s.*, pos_mean - neg_mean AS class_sep, a.auc FROM ({sep}) s JOIN ({auc(PRED)}) a ON a.run_id = s.run_id",
                              "pos_mean neg_mean pred_range pred_std class_sep auc")
    return o
