"""Registered queries: trial analytics and recorded-run sources.

Every order is one trial; its lines are the epochs of its learning curve."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import daily_bars, rounded, table
from tickloom.operators import trials as T
from tickloom.sources import runs, tables

SPACE = {"d_model": [64, 128, 256, 512], "n_layers": [2, 4, 8, 16], "n_heads": [2, 4, 8, 32]}
TRAINING = ["learning_rate", "dropout", "weight_decay"]
BUDGETS = ["2M", "20M", "200M", "2B", "20B"]


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def trial_table(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    budget = _pick(BUDGETS, rank - 1)
    horizon = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 3).otherwise(5)
    pred_min = (k * 3 % 60) / 100.0
    d = o.select(
        F.concat(F.lit("phase6a_"), budget, F.lit("_h"), horizon.cast("string"), F.lit("_t")).alias("study"),
        budget.alias("budget"), k.alias("trial_number"),
        F.when(k % 11 == 0, "PRUNED").otherwise("COMPLETE").alias("state"),
        F.when(k % 97 == 0, 100.0).otherwise(F.round(0.2 + (c * 31 + k * 17) % 1000 / 2000.0, 4)).alias("val_loss"),
        F.when(k % 53 != 0, F.round(0.48 + (c * 7 + k * 13) % 450 / 1000.0, 3)).alias("auc"),
        ((k * 29 + c) % 101 / 100.0).alias("precision"),
        F.when(k % 7 == 0, 0.0).otherwise((k * 37 + c * 3) % 101 / 100.0).alias("recall"),
        F.round(pred_min, 2).alias("pred_min"), F.round(pred_min + (c * 5 + k) % 45 / 100.0, 2).alias("pred_max"),
        _pick([64, 128, 256, 512], c % 4).alias("d_model"), _pick([2, 4, 8], k % 3).alias("n_layers"),
        _pick([2, 4, 8, 16], (c + k) % 4).alias("n_heads"), _pick([2, 4], F.floor(k / 5) % 2).alias("d_ff_ratio"),
        _pick([1e-4, 5e-4, 1e-3], F.floor(c / 4) % 3).alias("learning_rate"),
        _pick([0.1, 0.2, 0.3], F.floor(k / 3) % 3).alias("dropout"),
        _pick([1e-5, 1e-4, 1e-3], F.floor(c / 3) % 3).alias("weight_decay"),
        F.col("o_orderstatus").alias("phase"), F.when(k % 5 == 0, "failed").otherwise("success").alias("status"),
        (k % 50).alias("seed"), F.when(c % 2 == 0, "bce").otherwise("weighted").alias("loss"),
        _pick(["a100", "a200", "a500"], k % 3).alias("tier"), F.when(k % 4 != 0, _pick([16, 32, 64], c % 3)).alias("d_embed"),
        _pick([60, 80, 120], F.floor(k / 7) % 3).alias("context_length"), (c * 1000 + k).alias("n_params"),
        k.alias("exp_id"), F.lit(4).alias("epochs_config"))
    return d.withColumn("params", F.create_map(*[x for p in ("d_model", "n_layers", "n_heads", "dropout") for x in (
        F.lit(p), F.col(p).cast("double"))]))


def curves(spark: SparkSession, sf: str) -> DataFrame:
    """Trials with the learning curve of their lines (at most a few per order)."""
    li = table(spark, sf, "lineitem")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey",
                    F.round(F.col("l_discount") + F.col("l_tax"), 4).alias("v"), F.col("l_tax").alias("t"))
    per = li.groupBy(F.col("l_orderkey").alias("trial_number")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    curve = F.transform("l", lambda e, i: F.struct(i.cast("int").alias("epoch"), e["t"].alias("train_loss"), e["v"].alias("val_loss")))
    return trial_table(spark, sf).join(per.select("trial_number", curve.alias("learning_curve")), "trial_number")


def _experiments(spark, sf):
    t = trial_table(spark, sf)
    return t.select(F.col("phase").alias("experiment"), "budget", F.col("val_loss").alias("best_value"),
                    F.col("n_params").cast("double").alias("params"))


def _folder(spark, name):
    """A folder of its own for every call, so that a repeated query starts afresh."""
    return os.path.join(tables.shared_folder(spark), f"tickloom-{name}-{uuid.uuid4().hex[:12]}")


def _four_metrics(trials: DataFrame) -> DataFrame:
    """Trials with accuracy and F1, too."""
    p, r = F.col("precision"), F.col("recall")
    return trials.withColumns({"accuracy": F.col("trial_number") % 101 / 100.0, "f1": F.try_divide(2 * p * r, p + r)})


def queries() -> dict:
    q = {}

    def reg(name, digits=6):
        def put(fn):
            q[name] = lambda spark, sf: rounded(fn(spark, sf), digits)
            return fn
        return put

    def on(name, fn, digits=6):
        q[name] = lambda spark, sf: rounded(fn(trial_table(spark, sf)), digits)

    @reg("T01_best_epoch")
    def _(spark, sf):
        return T.curve_summary(curves(spark, sf)).select("trial_number", "best_epoch", "best_val_loss", "last_train_loss")

    @reg("T02_early_stop")
    def _(spark, sf):
        return T.curve_summary(curves(spark, sf)).select("trial_number", "epochs_trained", "early_stopped", "diverged")

    on("T03_ranked", lambda t: T.ranked(t).select("study", "trial_number", "val_loss", "rank_in_study", "is_best_in_study"))
    on("T04_diverged", T.diverged_counts)
    on("T04_diverged_trials", lambda t: t.filter(F.col("val_loss") >= T.DIVERGED).select("study", "trial_number", "val_loss"))
    q["T05_best_per_experiment"] = lambda spark, sf: rounded(T.best_per_experiment(_experiments(spark, sf)))
    q["T06_experiment_summary"] = lambda spark, sf: rounded(T.experiment_summary(_experiments(spark, sf)))
    q["T07_power_law"] = lambda spark, sf: rounded(T.power_law(_experiments(spark, sf).filter("params > 0")))
    on("T08_loss_distribution", T.loss_distribution)
    on("T09_grouped_losses", lambda t: T.grouped_losses(t, ["d_model"]))
    on("T09_top_configs", lambda t: T.grouped_losses(t, ["d_model", "n_layers"], top=10))
    on("T10_parameter_sensitivity", lambda t: T.parameter_sensitivity(t, [*TRAINING, "n_heads"]))
    on("T11_variance_importance", lambda t: T.variance_importance(t.filter("auc is not null"), list(T.PARAMS)), 8)
    on("T12_trends", lambda t: T.trends(t, list(T.PARAMS)))
    on("T13_run_collapse", T.run_collapse)
    on("T14_trial_collapse", lambda t: T.trial_collapse(t).select("trial_number", "range_width", "collapse_type"))
    on("T15_metric_distributions", lambda t: T.metric_distributions(t, ["auc", "precision", "recall"]))
    on("T16_parameter_correlations", lambda t: T.parameter_correlations(t, list(T.PARAMS)))
    on("T16_category_means", lambda t: T.category_means(t, "tier"))
    on("T17_suspicious_counts", lambda t: T.suspicious_counts(_four_metrics(t)))
    on("T17_suspicious_trials", lambda t: T.suspicious_trials(_four_metrics(t)))
    on("T18_value_frequencies", T.value_frequencies)
    on("T19_repeated_configurations", lambda t: T.repeated_configurations(t).select("study", "n", "best_value"))
    on("T19_wasted_trials", T.wasted_trials)
    on("T20_coverage_gaps", lambda t: T.coverage_gaps(t, SPACE))
    on("T20_coverage_gaps_heads", lambda t: T.coverage_gaps(t, SPACE, heads=True))
    on("T20_coverage_summary", lambda t: T.coverage_summary(t, SPACE))
    on("T21_shape_patterns", T.shape_patterns)
    on("T21_top_trials", T.top_trials)
    on("T22_training_impact", lambda t: T.training_impact(t, TRAINING))
    on("T23_converged", T.converged)
    on("T24_deltas", lambda t: T.deltas_to_baseline(t.select("exp_id", "tier", "d_embed", "precision", "recall", "auc", "n_params")))
    on("T25_comparison_table", lambda t: T.comparison_table(t.select("exp_id", "tier", "d_embed", "auc"), ["a200", "a100", "a500"]))
    on("T26_context_comparison", T.context_comparison)
    on("T27_sweep_summary", lambda t: T.sweep_summary(t, "tier", ["dropout", "learning_rate"]))
    on("T28_success_rate", T.success_rate)

    @reg("T29_attach_architecture")
    def _(spark, sf):
        t = trial_table(spark, sf)
        gaps = t.select("trial_number", "auc", *[F.when(F.col("trial_number") % 3 != 0, F.col(c)).alias(c) for c in ("d_model", "n_layers")])
        return T.attach_architecture(gaps, t, ["d_model", "n_layers"])

    on("T30_paired_seeds", lambda t: T.paired_seeds(t, "bce", "weighted"))
    on("T31_best_per_budget", lambda t: T.best_per_budget(t.filter("auc is not null"), BUDGETS))
    on("T31_budget_matrix", lambda t: T.budget_matrix(t, "d_model", BUDGETS))

    # --- sources: write what the tables hold in the recorded formats, read it back -------------
    @reg("S01_S03_parquet_bars")
    def _(spark, sf):
        path = _folder(spark, "bars")
        tables.write_bars(daily_bars(spark, sf).withColumn("key", F.col("key").cast("string")), path)
        return tables.read_bucketed_bars(spark, path)

    @reg("S04_trial_json")
    def _(spark, sf):
        t = curves(spark, sf)
        path = _folder(spark, "hpo")
        out = t.select(
            F.concat("study", F.lit("/trials")).alias("study"), "trial_number", F.col("val_loss").alias("value"), "params", "state",
            F.struct("d_model", "n_layers", "n_heads", (F.col("d_model") * F.col("d_ff_ratio")).alias("d_ff"),
                     F.col("n_params").alias("param_count")).alias("architecture"),
            F.struct(F.lit(1).alias("arch_idx"), "learning_curve").alias("user_attrs"))
        # one folder level per study, one JSON record per line
        studies = [r[0] for r in out.select("study").distinct().collect()]
        for s in studies:
            out.filter(F.col("study") == s).drop("study").write.mode("overwrite").json(os.path.join(path, s))
        raw = runs.read_trials(spark, path, multi_line=False)
        return raw.select("study", "budget", "horizon", "trial_number", "val_loss", "d_model", "arch_idx", "epochs_config",
                          F.size("learning_curve").alias("epochs"), T.best_epoch()["epoch"].alias("best_epoch"))

    @reg("S05_best_results")
    def _(spark, sf):
        t = trial_table(spark, sf)
        good = F.to_json(F.struct(F.col("phase").alias("experiment"), "budget", F.col("params").alias("best_params"),
                                  F.col("val_loss").alias("best_value"), F.lit(1).alias("n_trials_completed"), F.col("study").alias("study_name")))
        # every thirteenth record is cut off in the middle
        text = F.when(F.col("trial_number") % 13 == 0, F.substring(good, 1, 40)).otherwise(good)
        path = _folder(spark, "best")
        t.select(text.alias("value")).write.mode("overwrite").text(path)
        return runs.read_best_results(spark, path, "F").groupBy("experiment", "budget").agg(
            F.count(F.lit(1)).alias("n"), F.min("best_value").alias("best_value"),
            F.max(F.element_at("best_params", "d_model")).alias("widest"))

    @reg("S06_training_results")
    def _(spark, sf):
        t = trial_table(spark, sf).select(F.col("phase").alias("experiment"), "budget", "status", "val_loss",
                                          F.col("seed").cast("double").alias("duration_seconds"))
        path = _folder(spark, "results")
        for b in BUDGETS:
            t.filter(F.col("budget") == b).write.mode("overwrite").json(os.path.join(path, "x", b))
        return runs.read_training_results(spark, path).groupBy("experiment", "budget", "status").agg(
            F.count(F.lit(1)).alias("n"), F.avg("val_loss").alias("val_loss"))

    @reg("S07_run_log")
    def _(spark, sf):
        t = trial_table(spark, sf)
        path = _folder(spark, "log")
        for phase in ("F", "O", "P"):
            runs.append_log(t.filter(F.col("phase") == phase).select(
                F.col("study").alias("experiment"), "phase", "budget", "status", "val_loss", F.col("params").alias("hyperparameters"),
                "d_model", "n_layers", F.col("n_params").alias("param_count")), path, phase)
            # a second try of the same batch changes nothing
            runs.append_log(t.filter(F.col("phase") == phase).select(F.col("study").alias("experiment"), "phase"), path, phase)
        return runs.read_log(spark, path).select(
            "experiment", "phase", "status", "val_loss", F.element_at("hyperparameters", "dropout").alias("dropout"),
            "d_model", "param_count", "error_message")

    def log_lines(spark, sf):
        """A training log: per budget a header, then start and finish lines."""
        t = trial_table(spark, sf).filter("state = 'COMPLETE'")
        stamp = F.lit("[I 2025-12-30 19:33:09,101] ")
        start = F.concat(stamp, F.format_string(
            "Trial %d: arch_idx=%d, d_model=%d, n_layers=%d, n_heads=%d, params=%s, lr=%s, epochs=%d, batch_size=32",
            "trial_number", F.col("trial_number") % 7, "d_model", "n_layers", "n_heads", F.format_number("n_params", 0),
            F.lower(F.col("learning_rate").cast("string")), "epochs_config"))
        done = F.concat(stamp, F.format_string("Trial %d finished with value: %s and parameters: {'dropout': %s, 'd_model': %d}",
                                               "trial_number", F.col("val_loss").cast("string"), F.col("dropout").cast("string"), "d_model"))
        head = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("/12] Starting: hpo_"), F.col("budget"), F.lit("_threshold_1pct.py"))
        foot = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("/12] PASSED: hpo_"), F.col("budget"), F.lit("_threshold_1pct.py"))
        i = F.array_position(F.array(*[F.lit(b) for b in BUDGETS]), F.col("budget"))
        t = t.withColumn("i", i)
        heads = t.select("i", "budget").distinct()
        return heads.select("i", F.lit(-1).alias("n"), head.alias("value")).unionByName(
            t.select("i", (F.col("trial_number") * 2).alias("n"), start.alias("value"))).unionByName(
            t.select("i", (F.col("trial_number") * 2 + 1).alias("n"), done.alias("value"))).unionByName(
            heads.select("i", F.lit(1 << 60).alias("n"), foot.alias("value")))

    def written_log(spark, sf):
        path = _folder(spark, "logs")
        log_lines(spark, sf).repartitionByRange("i").sortWithinPartitions("i", "n").select("value").write.mode("overwrite").text(path)
        return runs.read_training_log(spark, path)

    @reg("S08_training_log")
    def _(spark, sf):
        return runs.parse_training_log(written_log(spark, sf)).select(
            "experiment", "trial_number", "val_loss", "arch_idx", "d_model", "n_heads", "param_count", "lr", "epochs",
            F.element_at("params", "dropout").alias("dropout"))

    @reg("S08_experiment_status")
    def _(spark, sf):
        return runs.experiment_status(written_log(spark, sf))

    @reg("S09_csv_export")
    def _(spark, sf):
        path = _folder(spark, "csv")
        tables.write_csv(trial_table(spark, sf).select("trial_number", "study", "val_loss", "auc", "params"), path)
        return spark.read.schema("trial_number long, study string, val_loss double, auc double").option("header", True).csv(path)

    @reg("S10_patched_params")
    def _(spark, sf):
        t = trial_table(spark, sf)
        empty = F.when(F.col("trial_number") % 2 == 0, F.col("params"))
        j = runs.patch_params(t.select("trial_number", empty.alias("params")), t, ["d_model", "dropout"])
        return j.select("trial_number", F.element_at("params", "d_model").alias("d_model"), F.element_at("params", "dropout").alias("dropout"))

    return q
