"""DuckDB queries for trial analytics and recorded runs."""

from __future__ import annotations

from oracles.base import BARS, rnd

BUDGET = "['2M', '20M', '200M', '2B', '20B'][CAST(o_orderpriority[1] AS INT)]"
BUDGETS = ["2M", "20M", "200M", "2B", "20B"]
PARAMS = ("d_model", "n_layers", "n_heads", "d_ff_ratio", "learning_rate", "dropout", "weight_decay")
TRIALS = f"""SELECT 'phase6a_' || {BUDGET} || '_h' || CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '3' ELSE '5' END || '_t' AS study,
  {BUDGET} AS budget, k AS trial_number, CASE WHEN k % 11 = 0 THEN 'PRUNED' ELSE 'COMPLETE' END AS state,
  CASE WHEN k % 97 = 0 THEN 100e0 ELSE round(2e-1 + (c * 31 + k * 17) % 1000 / 2000e0, 4) END AS val_loss,
  CASE WHEN k % 53 <> 0 THEN round(48e-2 + (c * 7 + k * 13) % 450 / 1000e0, 3) END AS auc,
  (k * 29 + c) % 101 / 100e0 AS precision, CASE WHEN k % 7 = 0 THEN 0e0 ELSE (k * 37 + c * 3) % 101 / 100e0 END AS recall,
  round(k * 3 % 60 / 100e0, 2) AS pred_min, round(k * 3 % 60 / 100e0 + (c * 5 + k) % 45 / 100e0, 2) AS pred_max,
  [64, 128, 256, 512][c % 4 + 1] AS d_model, [2, 4, 8][k % 3 + 1] AS n_layers, [2, 4, 8, 16][(c + k) % 4 + 1] AS n_heads,
  [2, 4][(k // 5) % 2 + 1] AS d_ff_ratio, [1e-4, 5e-4, 1e-3][(c // 4) % 3 + 1] AS learning_rate, [1e-1, 2e-1, 3e-1][(k // 3) % 3 + 1] AS dropout,
  [1e-5, 1e-4, 1e-3][(c // 3) % 3 + 1] AS weight_decay, o_orderstatus AS phase, CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'success' END AS status,
  k % 50 AS seed, CASE WHEN c % 2 = 0 THEN 'bce' ELSE 'weighted' END AS loss, ['a100', 'a200', 'a500'][k % 3 + 1] AS tier,
  CASE WHEN k % 4 <> 0 THEN [16, 32, 64][c % 3 + 1] END AS d_embed, [60, 80, 120][(k // 7) % 3 + 1] AS context_length,
  c * 1000 + k AS n_params, k AS exp_id, 4 AS epochs_config FROM (SELECT *, o_orderkey AS k, o_custkey AS c FROM orders)"""
DONE = f"SELECT * FROM ({TRIALS}) WHERE state = 'COMPLETE'"
CURVES = f"""SELECT t.*, x.v, x.tl FROM ({TRIALS}) t JOIN (SELECT l_orderkey, list(round(l_discount + l_tax, 4) ORDER BY l_linenumber, l_partkey, l_suppkey) AS v,
  list(l_tax ORDER BY l_linenumber, l_partkey, l_suppkey) AS tl FROM lineitem GROUP BY 1) x ON x.l_orderkey = t.trial_number"""
EXPERIMENTS = f"SELECT phase AS experiment, budget, val_loss AS best_value, CAST(n_params AS DOUBLE) AS params FROM ({TRIALS})"


def out(src, keys="", doubles="", ints="", digits=6):
    parts = keys.split() + [f"{rnd(c, digits)} AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    return f"SELECT {', '.join(parts)} FROM ({src})"


def long(params, src=TRIALS, extra=""):
    return " UNION ALL ".join(f"SELECT *, '{p}' AS param, CAST({p} AS DOUBLE) AS value FROM ({src}) {extra}" for p in params)


def oracle_sql() -> dict[str, str]:
    o = {}
    o["T01_best_epoch"] = out(f"SELECT trial_number, list_position(v, list_min(v)) - 1 AS best_epoch, list_min(v) AS best_val_loss, tl[len(tl)] AS last_train_loss FROM ({CURVES})",
                              "", "best_val_loss last_train_loss", "trial_number best_epoch")
    o["T02_early_stop"] = f"SELECT trial_number, len(v) AS epochs_trained, len(v) < 4 AS early_stopped, val_loss >= 10 AS diverged FROM ({CURVES})"
    o["T03_ranked"] = (f"SELECT study, trial_number, val_loss, r AS rank_in_study, r = 1 AS is_best_in_study FROM (SELECT *, row_number() OVER "
                       f"(PARTITION BY study ORDER BY val_loss, trial_number) AS r FROM ({TRIALS}))")
    o["T04_diverged"] = f"SELECT count(DISTINCT study) AS n_studies, count(*) AS n_trials, count(*) FILTER (WHERE val_loss >= 10) AS n_diverged FROM ({TRIALS})"
    o["T04_diverged_trials"] = f"SELECT study, trial_number, val_loss FROM ({TRIALS}) WHERE val_loss >= 10"
    o["T05_best_per_experiment"] = out(f"SELECT experiment, arg_min(budget, {{'a': best_value, 'b': budget}}) AS best_budget, max(best_value) / min(best_value) AS scaling_factor "
                                       f"FROM ({EXPERIMENTS}) GROUP BY 1", "experiment best_budget", "scaling_factor")
    o["T06_experiment_summary"] = f"SELECT count(DISTINCT experiment) AS n_experiments, count(*) AS n_runs FROM ({EXPERIMENTS})"
    o["T07_power_law"] = out(
        f"SELECT *, CASE WHEN alpha > 0.15 THEN 'strong' WHEN alpha > 0.08 THEN 'moderate' ELSE 'weak' END AS scaling, (1 - pow(10e0, -alpha)) * 100 AS gain_per_decade_pct FROM ("
        f"SELECT experiment, -regr_slope(ln(best_value), ln(params)) AS alpha, exp(regr_intercept(ln(best_value), ln(params))) AS coefficient, "
        f"regr_r2(ln(best_value), ln(params)) AS r_squared, count(*) AS n_points FROM ({EXPERIMENTS}) WHERE params > 0 GROUP BY 1)",
        "experiment scaling", "alpha coefficient r_squared gain_per_decade_pct", "n_points")
    q3 = ", ".join(f"quantile_cont({{x}}, {p}) AS {n}" for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)))
    o["T08_loss_distribution"] = out(
        f"SELECT study, count(*) AS n_total, count(*) FILTER (WHERE state = 'COMPLETE') AS n_completed, min(val_loss) AS min, max(val_loss) AS max, avg(val_loss) AS mean, "
        f"stddev_pop(val_loss) AS std, {q3.format(x='val_loss')} FROM ({TRIALS}) GROUP BY 1", "study", "min max mean std q25 median q75", "n_total n_completed")
    grp = "count(*) AS n_trials, avg(val_loss) AS mean_val_loss, min(val_loss) AS min_val_loss, stddev_pop(val_loss) AS std_val_loss"
    o["T09_grouped_losses"] = out(f"SELECT d_model, {grp} FROM ({TRIALS}) GROUP BY 1", "", "mean_val_loss min_val_loss std_val_loss", "d_model n_trials")
    o["T09_top_configs"] = out(f"SELECT d_model, n_layers, {grp} FROM ({TRIALS}) GROUP BY 1, 2 ORDER BY mean_val_loss, d_model, n_layers LIMIT 10", "",
                               "mean_val_loss min_val_loss std_val_loss", "d_model n_layers n_trials")
    o["T10_parameter_sensitivity"] = out(
        f"SELECT *, CASE WHEN correlation > 0.1 THEN 'lower is better' WHEN correlation < -0.1 THEN 'higher is better' ELSE 'weak effect' END AS reading FROM ("
        f"SELECT param, count(*) AS n, corr(value, val_loss) AS correlation FROM ({long(['learning_rate', 'dropout', 'weight_decay', 'n_heads'])}) GROUP BY 1 HAVING count(*) >= 5)",
        "param reading", "correlation", "n")
    known = f"SELECT * FROM ({TRIALS}) WHERE auc IS NOT NULL"
    o["T11_variance_importance"] = out(
        f"SELECT param, sum(n * pow(gm - m, 2)) / sum(n) / any_value(tv) AS importance FROM (SELECT param, value, count(*) AS n, avg(auc) AS gm FROM ({long(PARAMS, known)}) GROUP BY 1, 2), "
        f"(SELECT var_samp(auc) AS tv, avg(auc) AS m FROM ({known})) GROUP BY 1", "param", "importance", digits=8)
    o["T12_trends"] = out(
        f"SELECT *, CASE WHEN n_values < 2 THEN 'insufficient_data' WHEN abs(last_mean - first_mean) < 0.01 THEN 'flat' WHEN last_mean > first_mean THEN 'increasing' ELSE 'decreasing' END AS trend FROM ("
        f"SELECT param, count(*) AS n_values, arg_min(m, value) AS first_mean, arg_max(m, value) AS last_mean, max(m) AS best_mean, min(m) AS worst_mean, "
        f"arg_max(value, {{'m': m, 'v': -value}}) AS best_value, arg_min(value, {{'m': m, 'v': value}}) AS worst_value FROM (SELECT param, value, avg(auc) AS m FROM ({long(PARAMS)}) GROUP BY 1, 2) GROUP BY 1)",
        "param trend", "first_mean last_mean best_mean worst_mean best_value worst_value", "n_values")
    o["T13_run_collapse"] = out(
        f"SELECT *, avg_pred_max - avg_pred_min AS avg_pred_range, (avg_pred_max - avg_pred_min < 0.2 OR zero_recall_trials > n * 0.3) AS detected, avg_pred_max < 0.7 AS low_max, avg_pred_min > 0.4 AS high_min FROM ("
        f"SELECT study, avg(pred_min) AS avg_pred_min, avg(pred_max) AS avg_pred_max, avg(recall) AS avg_recall, count(*) FILTER (WHERE recall = 0) AS zero_recall_trials, count(recall) AS n FROM ({TRIALS}) GROUP BY 1)",
        "study detected low_max high_min", "avg_pred_min avg_pred_max avg_recall avg_pred_range", "zero_recall_trials")
    ct = "CASE WHEN pred_max - pred_min < 0.1 THEN 'narrow_range' WHEN pred_min > 0.5 THEN 'all_high' WHEN pred_max < 0.5 THEN 'all_low' END"
    o["T14_trial_collapse"] = out(f"SELECT trial_number, pred_max - pred_min AS range_width, {ct} AS collapse_type FROM ({TRIALS})", "collapse_type", "range_width", "trial_number")
    o["T15_metric_distributions"] = out(
        f"SELECT param AS metric, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, {q3.format(x='v')} FROM (SELECT param, coalesce(value, 0) AS v FROM ({long(['auc', 'precision', 'recall'])})) GROUP BY 1",
        "metric", "mean std min max q25 median q75")
    o["T16_parameter_correlations"] = out(f"SELECT param, coalesce(corr(value, coalesce(auc, 0)), 0) AS correlation FROM ({long(PARAMS, DONE)}) GROUP BY 1", "param", "correlation")
    o["T16_category_means"] = out(f"SELECT tier, avg(coalesce(auc, 0)) AS mean_auc, count(*) AS n FROM ({DONE}) GROUP BY 1", "tier", "mean_auc", "n")
    rules = {"high_recall_low_precision": "recall > 0.95 AND precision < 0.25",
             "degenerate_auc": "abs(coalesce(auc, 0) - 0.5) < 0.02", "below_baseline": "coalesce(auc, 0) < 0.55"}
    perfect = {"accuracy": "trial_number % 101 = 100", "precision": "precision = 1", "recall": "recall = 1",
               "f1": "2 * precision * recall / nullif(precision + recall, 0) = 1"}
    cnt = ", ".join([*(f"count(*) FILTER (WHERE {r}) AS {n}" for n, r in rules.items()),
                     " + ".join(f"count(*) FILTER (WHERE {r})" for r in perfect.values()) + " AS perfect_metrics"])
    o["T17_suspicious_counts"] = out(
        f"SELECT *, CASE n_issues WHEN 0 THEN 'VALID' WHEN 1 THEN 'PARTIAL' ELSE 'QUESTIONABLE' END AS validity FROM (SELECT *, CAST(collapse_rate > 0.3 AS INT) + CAST(high_recall_low_precision > n_trials * 0.5 AS INT) + "
        f"CAST(best_auc < 0.55 AS INT) AS n_issues FROM (SELECT study, count(*) AS n_trials, max(coalesce(auc, 0)) AS best_auc, avg(CASE WHEN {ct} IS NOT NULL THEN 1e0 ELSE 0 END) AS collapse_rate, {cnt} FROM ({TRIALS}) GROUP BY 1))",
        "study validity", "best_auc collapse_rate", "n_trials n_issues perfect_metrics " + " ".join(rules))
    o["T17_suspicious_trials"] = " UNION ALL ".join(f"SELECT study, trial_number, coalesce(auc, 0) AS auc, '{n}' AS suspicion, {m} AS metric FROM ({TRIALS}) WHERE {r}"
        for n, m, r in [*((n, "NULL::VARCHAR", r) for n, r in rules.items()), *(("perfect_metrics", f"'{m}'", r) for m, r in perfect.items())])
    o["T18_value_frequencies"] = out(f"SELECT study, param, value, count(*) AS n FROM ({long(['d_model', 'n_layers', 'n_heads', 'dropout'], DONE)}) GROUP BY 1, 2, 3", "study param", "value", "n")
    cfg = f"SELECT study, d_model, n_layers, n_heads, dropout, count(*) AS n, min(val_loss) AS best_value FROM ({DONE}) GROUP BY 1, 2, 3, 4, 5"
    o["T19_repeated_configurations"] = out(f"SELECT * FROM ({cfg}) WHERE n > 1", "study", "best_value", "n")
    o["T19_wasted_trials"] = out(f"SELECT study, sum(n) AS n_trials, count(*) AS unique_configs, count(*) FILTER (WHERE n > 1) AS repeated_configs, sum(n - 1) AS wasted_trials FROM ({cfg}) GROUP BY 1",
                                 "study", "", "n_trials unique_configs repeated_configs wasted_trials")
    grid = "SELECT * FROM (SELECT unnest([64, 128, 256, 512]) AS d_model), (SELECT unnest([2, 4, 8, 16]) AS n_layers), (SELECT unnest([2, 4, 8, 32]) AS n_heads)"
    gaps = f"{grid} EXCEPT SELECT d_model, n_layers, n_heads FROM ({DONE})"
    o["T20_coverage_gaps"] = out(gaps, "", "", "d_model n_layers n_heads")
    o["T20_coverage_gaps_heads"] = out(f"SELECT * FROM ({gaps}) WHERE d_model % n_heads = 0", "", "", "d_model n_layers n_heads")
    o["T20_coverage_summary"] = f"SELECT CAST(64 AS BIGINT) AS total_possible, count(*) AS tested, round(100 * count(*) / 64, 1) AS coverage_pct FROM (SELECT DISTINCT d_model, n_layers, n_heads FROM ({DONE}))"
    o["T21_shape_patterns"] = out(f"SELECT study, corr(d_model * d_ff_ratio, auc) AS width_auc, corr(n_layers, auc) AS depth_auc, corr(d_model * d_ff_ratio / n_layers, auc) AS ratio_auc FROM ({DONE}) GROUP BY 1",
                                  "study", "width_auc depth_auc ratio_auc")
    o["T21_top_trials"] = f"SELECT trial_number, study, auc, CAST(d_model AS BIGINT) AS d_model, CAST(n_layers AS BIGINT) AS n_layers, CAST(d_ff_ratio AS BIGINT) AS d_ff_ratio FROM ({DONE}) ORDER BY auc DESC NULLS LAST, trial_number LIMIT 5"
    o["T22_training_impact"] = out(f"SELECT param, value, avg(auc) AS mean_auc, coalesce(stddev_samp(auc), 0) AS std_auc, count(*) AS n FROM ({long(['learning_rate', 'dropout', 'weight_decay'], DONE)}) GROUP BY 1, 2",
                                   "param", "value mean_auc std_auc", "n")
    o["T23_converged"] = out(
        f"SELECT study, n_completed, spread, n_completed >= 20 AND spread <= 0.02 AS converged FROM (SELECT study, max(n) AS n_completed, max(val_loss) FILTER (WHERE r <= 5) - min(val_loss) AS spread FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY study ORDER BY val_loss) AS r, count(*) OVER (PARTITION BY study) AS n FROM ({DONE})) GROUP BY 1)", "study converged", "spread", "n_completed")
    base = f"SELECT tier, arg_min(precision, exp_id) AS bp, arg_min(recall, exp_id) AS br, arg_min_null(auc, exp_id) AS ba, arg_min(n_params, exp_id) AS bn FROM ({TRIALS}) WHERE d_embed IS NULL GROUP BY 1"

    def d(expr):
        return f"CASE WHEN d_embed IS NULL THEN 0 ELSE {expr} END"
    o["T24_deltas"] = out(
        f"SELECT t.*, {d('precision - bp')} AS delta_precision, {d('(precision - bp) / nullif(bp, 0) * 100')} AS delta_precision_pct, {d('recall - br')} AS delta_recall, {d('auc - ba')} AS delta_auc, "
        f"{d('(bn - n_params) / nullif(bn, 0) * 100')} AS params_reduction_pct FROM ({TRIALS}) t JOIN ({base}) b ON b.tier = t.tier",
        "tier", "precision recall auc delta_precision delta_precision_pct delta_recall delta_auc params_reduction_pct", "exp_id d_embed n_params")
    o["T25_comparison_table"] = out(f"SELECT *, list_position(['a200', 'a100', 'a500'], tier) - 1 AS tier_order FROM ({TRIALS})", "tier", "auc", "exp_id d_embed tier_order")
    ctx = f"SELECT tier, arg_max(context_length, {{'a': auc, 'c': -context_length}}) AS best_context, max(auc) AS best_auc, max(auc) FILTER (WHERE context_length = 80) AS baseline_auc FROM ({TRIALS}) WHERE auc IS NOT NULL GROUP BY 1"
    o["T26_context_comparison"] = out(f"SELECT *, (best_auc - baseline_auc) / baseline_auc * 100 AS improvement_pct, (SELECT bool_and(best_context = 80) FROM ({ctx})) AS all_at_baseline FROM ({ctx})",
                                      "tier all_at_baseline", "best_auc baseline_auc improvement_pct", "best_context")
    by = ", ".join(f"arg_max({s}, {{'a': {m}, 'b': -trial_number}}) AS {s}_by_{m}" for m in ("auc", "precision", "recall") for s in ("dropout", "learning_rate"))
    o["T27_sweep_summary"] = out(
        f"SELECT a.tier, total, completed, best_auc, best_precision, best_recall, {', '.join(f'{s}_by_{m}' for m in ('auc', 'precision', 'recall') for s in ('dropout', 'learning_rate'))} FROM "
        f"(SELECT tier, count(*) AS total, count(auc) AS completed FROM ({TRIALS}) GROUP BY 1) a JOIN (SELECT tier, max(auc) AS best_auc, max(precision) AS best_precision, max(recall) AS best_recall, {by} FROM ({known}) GROUP BY 1) b ON a.tier = b.tier",
        "tier", "best_auc best_precision best_recall " + " ".join(f"{s}_by_{m}" for m in ("auc", "precision", "recall") for s in ("dropout", "learning_rate")), "total completed")
    o["T28_success_rate"] = out(f"SELECT phase, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS succeeded, avg(CASE WHEN status = 'success' THEN 1e0 ELSE 0 END) AS success_rate FROM ({TRIALS}) GROUP BY 1",
                                "phase", "success_rate", "total succeeded")
    o["T29_attach_architecture"] = out(TRIALS, "", "auc", "trial_number d_model n_layers")
    o["T30_paired_seeds"] = out(
        f"SELECT avg(a) AS mean_a, stddev_samp(a) AS std_a, avg(b) AS mean_b, stddev_samp(b) AS std_b, avg(b - a) AS mean_diff, stddev_pop(b - a) AS std_diff, count(b - a) AS n_pairs FROM ("
        f"SELECT seed, avg(auc) FILTER (WHERE loss = 'bce') AS a, avg(auc) FILTER (WHERE loss = 'weighted') AS b FROM ({TRIALS}) GROUP BY 1)", "", "mean_a std_a mean_b std_b mean_diff std_diff", "n_pairs")
    o["T31_best_per_budget"] = out(
        f"SELECT *, coalesce(best_auc > previous_auc, false) AS improves FROM (SELECT budget, best_auc, trial_number, lag(best_auc) OVER (ORDER BY list_position({BUDGETS}, budget)) AS previous_auc FROM ("
        f"SELECT budget, max(auc) AS best_auc, arg_max(trial_number, {{'a': auc, 'b': -trial_number}}) AS trial_number FROM ({known}) GROUP BY 1))", "budget improves", "best_auc previous_auc", "trial_number")
    o["T31_budget_matrix"] = "SELECT CAST(d_model AS BIGINT) AS d_model, " + ", ".join(f"round(max(auc) FILTER (WHERE budget = '{b}'), 6) AS \"{b}\"" for b in BUDGETS) + f" FROM ({TRIALS}) GROUP BY 1"

    # --- sources ------------------------------------------------------------------------------
    o["S01_S03_parquet_bars"] = out(f"SELECT CAST(key AS VARCHAR) AS key, CAST(ts AS VARCHAR) AS ts, open, high, low, close, volume FROM ({BARS})", "key ts", "open high low close", "volume")
    o["S04_trial_json"] = out(f"SELECT study, budget, 'h' || substr(study, strpos(study, '_h') + 2, 1) AS horizon, trial_number, val_loss, d_model, 1 AS arch_idx, 100 AS epochs_config, len(v) AS epochs, "
                              f"list_position(v, list_min(v)) - 1 AS best_epoch FROM ({CURVES})", "study horizon", "val_loss", "trial_number d_model arch_idx epochs_config epochs best_epoch").replace(
        "SELECT study, horizon,", "SELECT study, CASE WHEN budget IN ('2M', '20M', '200M', '2B', '20B') THEN budget END AS budget, horizon,", 1)
    o["S05_best_results"] = out(f"SELECT phase AS experiment, budget, count(*) AS n, min(val_loss) AS best_value, CAST(max(d_model) AS DOUBLE) AS widest FROM ({TRIALS}) WHERE phase = 'F' AND trial_number % 13 <> 0 GROUP BY 1, 2",
                                "experiment budget", "best_value widest", "n")
    o["S06_training_results"] = out(f"SELECT phase AS experiment, budget, status, count(*) AS n, avg(val_loss) AS val_loss FROM ({TRIALS}) GROUP BY 1, 2, 3", "experiment budget status", "val_loss", "n")
    o["S07_run_log"] = out(f"SELECT study AS experiment, phase, status, val_loss, dropout, d_model, n_params AS param_count, NULL AS error_message FROM ({TRIALS})",
                           "experiment phase status error_message", "val_loss dropout", "d_model param_count")
    o["S08_training_log"] = out(f"SELECT budget AS experiment, trial_number, val_loss, trial_number % 7 AS arch_idx, d_model, n_heads, n_params AS param_count, learning_rate AS lr, 4 AS epochs, dropout FROM ({DONE})",
                                "experiment", "val_loss lr dropout", "trial_number arch_idx d_model n_heads param_count epochs")
    o["S08_experiment_status"] = f"SELECT DISTINCT budget AS experiment, 'PASSED' AS status FROM ({DONE})"
    o["S09_csv_export"] = out(TRIALS, "study", "val_loss auc", "trial_number")
    o["S10_patched_params"] = out(f"SELECT trial_number, CAST(d_model AS DOUBLE) AS d_model, dropout FROM ({TRIALS})", "", "d_model dropout", "trial_number")
    return o
