"""Analysis of recorded search trials and experiment runs.

Trial tables have one row per trial; a learning curve is an array of
``struct<epoch, train_loss, val_loss>`` inside the row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.ranking import quantiles, row_positions, value_ranks
from tickloom.operators.align import broadcast_if_small

PARAMS = ("d_model", "n_layers", "n_heads", "d_ff_ratio", "learning_rate", "dropout", "weight_decay")
DIVERGED = 10.0


def completed(trials: DataFrame, state: str = "COMPLETE") -> DataFrame:
    return trials.filter(F.col("state") == state)


def _unpivot(df: DataFrame, columns: list[str], keep: list[str], name: str = "param") -> DataFrame:
    """Long form: one row per row and column."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def _corr(x: str, y: str) -> Column:
    """Pearson correlation; null when a side does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(px) * F.stddev_pop(py)
    return F.covar_pop(px, py) / F.when(spread > 0, spread)


# --- single trials ---------------------------------------------------------------

def best_epoch(curve: str = "learning_curve") -> Column:
    """``struct<val_loss, pos, epoch>`` of the lowest validation loss, first on ties."""
    keyed = F.transform(curve, lambda e, i: F.struct(
        e["val_loss"].alias("val_loss"), i.alias("pos"), e["epoch"].alias("epoch")))
    return F.array_min(keyed)


def curve_summary(trials: DataFrame) -> DataFrame:
    """Best epoch, its loss, the last train loss, and whether the run stopped
    early or diverged."""
    n = F.size("learning_curve")
    b = best_epoch()
    return trials.withColumns({
        "best_epoch": b["epoch"], "best_val_loss": b["val_loss"], "epochs_trained": n,
        "last_train_loss": F.when(n > 0, F.element_at("learning_curve", -1)["train_loss"]),
        "early_stopped": n < F.col("epochs_config"),
        "diverged": F.col("val_loss") >= DIVERGED})


def ranked(trials: DataFrame, study: str = "study") -> DataFrame:
    """Rank by validation loss inside the study; equal losses by trial number."""
    return row_positions(trials, [study], "val_loss", "trial_number", "rank_in_study").withColumn(
        "is_best_in_study", F.col("rank_in_study") == 1)


def diverged_counts(trials: DataFrame) -> DataFrame:
    return trials.agg(F.countDistinct("study").alias("n_studies"), F.count(F.lit(1)).alias("n_trials"),
                      F.count_if(F.col("val_loss") >= DIVERGED).alias("n_diverged"))


# --- experiments ------------------------------------------------------------------

def best_per_experiment(results: DataFrame) -> DataFrame:
    """Budget of the lowest value, and the factor between highest and lowest."""
    lo = F.min("best_value")
    return results.groupBy("experiment").agg(
        F.min_by("budget", F.struct("best_value", "budget")).alias("best_budget"),
        F.when(lo > 0, F.max("best_value") / F.when(lo > 0, lo)).alias("scaling_factor"))


def experiment_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.countDistinct("experiment").alias("n_experiments"), F.count(F.lit(1)).alias("n_runs"))


def power_law(points: DataFrame, by: str = "experiment", x: str = "params", y: str = "best_value") -> DataFrame:
    """y = a * x^-alpha by least squares on logarithms, with R squared.

    A value that is not positive, or a group with a single point, raises."""
    bad = F.count_if((F.col(x) <= 0) | (F.col(y) <= 0)) > 0
    lx = F.ln(F.when(F.col(x) > 0, F.col(x)))
    ly = F.ln(F.when(F.col(y) > 0, F.col(y)))
    fit = points.groupBy(by).agg(
        F.regr_slope(ly, lx).alias("_s"), F.regr_intercept(ly, lx).alias("_i"),
        F.var_pop(ly).alias("_v"), F.regr_r2(ly, lx).alias("_r2"), F.count(F.lit(1)).alias("n_points"),
        bad.alias("_bad"))
    checked = F.when(F.col("_bad"), F.raise_error(F.lit("power law needs positive values")).cast("double")) \
        .when(F.col("n_points") < 2, F.raise_error(F.lit("power law needs two points")).cast("double")) \
        .otherwise(-F.col("_s"))
    a = F.col("alpha")
    return fit.withColumn("alpha", checked).select(
        by, "alpha", F.exp("_i").alias("coefficient"),
        F.when(F.col("_v") == 0, 1.0).otherwise(F.col("_r2")).alias("r_squared"), "n_points",
        F.when(a > 0.15, "strong").when(a > 0.08, "moderate").otherwise("weak").alias("scaling"),
        ((1 - F.pow(F.lit(10.0), -a)) * 100).alias("gain_per_decade_pct"))


# --- summaries over trials -------------------------------------------------------------

def loss_distribution(trials: DataFrame, by: str = "study") -> DataFrame:
    basic = trials.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("state") == "COMPLETE").alias("n_completed"),
        F.min("val_loss").alias("min"), F.max("val_loss").alias("max"), F.avg("val_loss").alias("mean"),
        F.stddev_pop("val_loss").alias("std"))
    q = quantiles(trials, [by], "val_loss", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return basic.join(q.drop("n_values"), by)


def grouped_losses(trials: DataFrame, by: list[str], top: int | None = None) -> DataFrame:
    """Count, mean, min and population spread per value, best mean first."""
    out = trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trials"), F.avg("val_loss").alias("mean_val_loss"),
        F.min("val_loss").alias("min_val_loss"), F.stddev_pop("val_loss").alias("std_val_loss")) \
        .orderBy("mean_val_loss", *by)
    return out.limit(top) if top else out


def parameter_sensitivity(trials: DataFrame, params: list[str]) -> DataFrame:
    """Correlation with the loss for parameters with at least five values."""
    c = _unpivot(trials, params, ["val_loss"]).filter("value is not null").groupBy("param").agg(
        F.count(F.lit(1)).alias("n"), _corr("value", "val_loss").alias("correlation")).filter("n >= 5")
    r = F.col("correlation")
    return c.withColumn("reading", F.when(r > 0.1, "lower is better").when(
        r < -0.1, "higher is better").otherwise("weak effect"))


def variance_importance(trials: DataFrame, params: list[str], target: str = "auc") -> DataFrame:
    """Variance between the means of a parameter's values over the total variance."""
    long = _unpivot(trials, params, [target])
    total = trials.agg(F.var_samp(target).alias("_tv"), F.avg(target).alias("_m"))
    groups = long.groupBy("param", "value").agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("gm"))
    # the totals are one row
    gap = F.col("gm") - F.col("_m")
    return groups.join(F.broadcast(total)).groupBy("param").agg(
        (F.sum(F.col("n") * gap * gap) / F.sum("n") / F.nullif(F.first("_tv"), F.lit(0.0))).alias("importance"))


def trends(trials: DataFrame, params: list[str], target: str = "auc") -> DataFrame:
    """Direction from the lowest to the highest value of a parameter."""
    g = _unpivot(trials, params, [target]).groupBy("param", "value").agg(F.avg(target).alias("m"))
    s = g.groupBy("param").agg(
        F.count(F.lit(1)).alias("n_values"), F.min_by("m", "value").alias("first_mean"),
        F.max_by("m", "value").alias("last_mean"), F.max("m").alias("best_mean"),
        F.max_by("value", F.struct(F.col("m"), -F.col("value"))).alias("best_value"),
        F.min_by("value", F.struct("m", "value")).alias("worst_value"), F.min("m").alias("worst_mean"))
    gap = F.col("last_mean") - F.col("first_mean")
    return s.withColumn("trend", F.when(F.col("n_values") < 2, "insufficient_data").when(
        F.abs(gap) < 0.01, "flat").when(gap > 0, "increasing").otherwise("decreasing"))


def run_collapse(trials: DataFrame, by: str = "study") -> DataFrame:
    """A run collapsed when its mean range is under 0.2 or over 30% of its
    trials recall nothing."""
    both = F.col("pred_min").isNotNull() & F.col("pred_max").isNotNull()
    s = trials.groupBy(by).agg(
        F.avg(F.when(both, F.col("pred_min"))).alias("avg_pred_min"),
        F.avg(F.when(both, F.col("pred_max"))).alias("avg_pred_max"),
        F.avg("recall").alias("avg_recall"), F.count_if(F.col("recall") == 0).alias("zero_recall_trials"),
        F.count("recall").alias("n_recall"))
    rng = F.col("avg_pred_max") - F.col("avg_pred_min")
    return s.withColumns({
        "avg_pred_range": rng,
        "detected": F.coalesce(rng < 0.2, F.lit(False))
        | (F.col("zero_recall_trials") > F.col("n_recall") * 0.3),
        "low_max": F.coalesce(F.col("avg_pred_max") < 0.7, F.lit(False)),
        "high_min": F.coalesce(F.col("avg_pred_min") > 0.4, F.lit(False))}).drop("n_recall")


def collapse_type(low: str = "pred_min", high: str = "pred_max") -> Column:
    return F.when(F.col(high) - F.col(low) < 0.1, "narrow_range").when(
        F.col(low) > 0.5, "all_high").when(F.col(high) < 0.5, "all_low")


def trial_collapse(trials: DataFrame) -> DataFrame:
    return trials.withColumns({"range_width": F.col("pred_max") - F.col("pred_min"),
                               "collapse_type": collapse_type()})


def metric_distributions(trials: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, population sigma and quartiles per metric; missing counts as 0."""
    long = _unpivot(trials.fillna(0.0, subset=metrics), metrics, [], "metric")
    basic = long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = quantiles(long, ["metric"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return basic.join(q.drop("n_values"), "metric")


def parameter_correlations(trials: DataFrame, params: list[str], target: str = "auc") -> DataFrame:
    """Correlation with the target over completed trials, strongest first."""
    c = _unpivot(completed(trials).fillna(0.0, subset=[target]), params, [target]).groupBy("param").agg(
        F.coalesce(_corr("value", target), F.lit(0.0)).alias("correlation"))
    return c.orderBy(F.abs("correlation").desc(), "param")


def category_means(trials: DataFrame, column: str, target: str = "auc") -> DataFrame:
    return completed(trials).fillna(0.0, subset=[target]).groupBy(column).agg(
        F.avg(target).alias("mean_auc"), F.count(F.lit(1)).alias("n"))


# fixed rules
SUSPICIOUS = {
    "high_recall_low_precision": "recall > 0.95 and precision < 0.25",
    "degenerate_auc": "abs(auc - 0.5) < 0.02",
    "below_baseline": "auc < 0.55",
}


#: Metrics that are suspicious at exactly 1.
PERFECT = ("accuracy", "precision", "recall", "f1")


def _perfect(trials: DataFrame) -> Column:
    """The names of a trial's perfect metrics, among those that the table has."""
    found = [F.when(F.col(m) == 1.0, F.lit(m)) for m in PERFECT if m in trials.columns]
    return F.filter(F.array(F.lit(None).cast("string"), *found), lambda m: m.isNotNull())


def suspicious_counts(trials: DataFrame, by: str = "study") -> DataFrame:
    """Counts per suspicion, the collapse rate, and a verdict: no issue is VALID,
    one PARTIAL, more QUESTIONABLE.  Every perfect metric of a trial counts."""
    t = trials.fillna(0.0, subset=["auc", "recall", "precision"])
    s = t.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_trials"), F.max("auc").alias("best_auc"),
        F.avg(collapse_type().isNotNull().cast("double")).alias("collapse_rate"),
        F.sum(F.size(_perfect(t))).alias("perfect_metrics"),
        *[F.count_if(F.expr(rule)).alias(name) for name, rule in SUSPICIOUS.items()])
    issues = reduce(lambda a, b: a + b, [c.cast("int") for c in (
        F.col("collapse_rate") > 0.3, F.col("high_recall_low_precision") > F.col("n_trials") * 0.5,
        F.col("best_auc") < 0.55)])
    return s.withColumn("n_issues", issues).withColumn("validity", F.when(
        F.col("n_issues") == 0, "VALID").when(F.col("n_issues") == 1, "PARTIAL").otherwise("QUESTIONABLE"))


def suspicious_trials(trials: DataFrame) -> DataFrame:
    """One row per trial and suspicion, and one per perfect metric with its name."""
    t = trials.fillna(0.0, subset=["auc", "recall", "precision"])
    none = F.lit(None).cast("string")
    rules = F.filter(F.array(*[F.when(F.expr(rule), F.struct(F.lit(name).alias("suspicion"), none.alias("metric")))
                               for name, rule in SUSPICIOUS.items()]), lambda v: v.isNotNull())
    perfect = F.transform(_perfect(t), lambda m: F.struct(F.lit("perfect_metrics").alias("suspicion"), m.alias("metric")))
    return t.select("study", "trial_number", "auc", F.inline(F.concat(rules, perfect)))


# --- coverage ----------------------------------------------------------------------------

def value_frequencies(trials: DataFrame) -> DataFrame:
    """How often each value of each parameter was tried, from the params map."""
    return completed(trials).select("study", F.explode("params").alias("param", "value")).groupBy(
        "study", "param", "value").agg(F.count(F.lit(1)).alias("n"))


def canonical(params: str = "params") -> Column:
    """A map as text with its keys in order."""
    entries = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


def repeated_configurations(trials: DataFrame) -> DataFrame:
    return completed(trials).groupBy("study", canonical().alias("config")).agg(
        F.count(F.lit(1)).alias("n"), F.min("val_loss").alias("best_value")).filter("n > 1")


def wasted_trials(trials: DataFrame) -> DataFrame:
    c = completed(trials).groupBy("study", canonical().alias("config")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("study").agg(
        F.sum("n").alias("n_trials"), F.count(F.lit(1)).alias("unique_configs"),
        F.count_if(F.col("n") > 1).alias("repeated_configs"), F.sum(F.col("n") - 1).alias("wasted_trials"))


def _grid(trials: DataFrame, space: dict[str, list]) -> DataFrame:
    """All combinations of the listed values: their number is the product of the
    list lengths, whatever the size of the trial table."""
    grid = trials.sparkSession.range(1).select(F.lit(0).alias("_z"))
    for c, values in space.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(c))
    return grid.drop("_z")


def coverage_gaps(trials: DataFrame, space: dict[str, list], heads: bool = False) -> DataFrame:
    """Untried combinations; ``heads`` keeps widths that the heads divide."""
    grid = _grid(trials, space)
    if heads:
        grid = grid.filter(F.col("d_model") % F.col("n_heads") == 0)
    tried = completed(trials).select(*space).distinct()
    return grid.join(broadcast_if_small(tried), list(space), "left_anti")


def coverage_summary(trials: DataFrame, space: dict[str, list]) -> DataFrame:
    total = 1
    for v in space.values():
        total *= len(v)
    tried = completed(trials).select(*space).distinct()
    return tried.agg(F.count(F.lit(1)).alias("tested")).select(
        F.lit(total).alias("total_possible"), "tested", F.round(100 * F.col("tested") / total, 1).alias("coverage_pct"))


def shape_patterns(trials: DataFrame, by: str = "study") -> DataFrame:
    """Correlation of width, depth and their ratio with the target."""
    width = F.col("d_model") * F.col("d_ff_ratio")
    t = completed(trials).withColumns({
        "width": width.cast("double"), "depth": F.col("n_layers").cast("double"),
        "ratio": F.when(F.col("n_layers") > 0, width / F.col("n_layers")).otherwise(0.0)})
    return t.groupBy(by).agg(*[_corr(c, "auc").alias(f"{c}_auc") for c in ("width", "depth", "ratio")])


def top_trials(trials: DataFrame, n: int = 5) -> DataFrame:
    """The best trials of the whole table; a top-n keeps n rows per task."""
    t = completed(trials)
    return t.select("trial_number", "study", "auc", "d_model", "n_layers", "d_ff_ratio").orderBy(
        F.col("auc").desc(), "trial_number").limit(n)


def training_impact(trials: DataFrame, params: list[str]) -> DataFrame:
    return _unpivot(completed(trials), params, ["auc"]).filter("value is not null").groupBy("param", "value").agg(
        F.avg("auc").alias("mean_auc"), F.coalesce(F.stddev_samp("auc"), F.lit(0.0)).alias("std_auc"),
        F.count(F.lit(1)).alias("n"))


def converged(trials: DataFrame, top: int = 5, threshold: float = 0.02, min_trials: int = 20,
              by: str = "study") -> DataFrame:
    """Whether the spread of the ``top`` lowest losses is at most ``threshold``."""
    t = completed(trials)
    r = value_ranks(t, [by], "val_loss")
    low = r.filter(F.col("below") < top).groupBy(by).agg(
        (F.max("val_loss") - F.min("val_loss")).alias("spread"), F.max("total").alias("n_losses"))
    n = t.groupBy(by).agg(F.count(F.lit(1)).alias("n_completed"))
    ok = (F.col("n_completed") >= min_trials) & (F.col("n_losses") >= top) & (F.col("spread") <= threshold)
    return n.join(low, by, "left").select(by, "n_completed", "spread", F.coalesce(ok, F.lit(False)).alias("converged"))


# --- comparisons -----------------------------------------------------------------------------

def deltas_to_baseline(results: DataFrame) -> DataFrame:
    """Differences to the row of the same tier without an embedding size; a tier
    without such a row does not appear."""
    base = results.filter("d_embed is null").groupBy("tier").agg(*[
        F.min_by(c, "exp_id").alias(f"_{c}") for c in ("precision", "recall", "auc", "n_params")])
    j = results.join(base, "tier")
    own = F.col("d_embed").isNull()

    def delta(c):
        return F.when(own, 0.0).otherwise(F.col(c) - F.col(f"_{c}"))
    pct = F.when(own, 0.0).otherwise((F.col("precision") - F.col("_precision")) / F.nullif("_precision", F.lit(0.0)) * 100)
    saved = F.when(own, 0.0).otherwise((F.col("_n_params") - F.col("n_params")) / F.nullif("_n_params", F.lit(0)) * 100)
    return j.select(*results.columns, delta("precision").alias("delta_precision"), pct.alias("delta_precision_pct"),
                    delta("recall").alias("delta_recall"), delta("auc").alias("delta_auc"),
                    saved.alias("params_reduction_pct"))


def comparison_table(results: DataFrame, order: list[str]) -> DataFrame:
    """Sorted by a given tier order, then by embedding size, baseline first."""
    place = F.coalesce(*[F.when(F.col("tier") == t, i) for i, t in enumerate(order)], F.lit(len(order)))
    return results.withColumn("tier_order", place).orderBy("tier_order", F.coalesce("d_embed", F.lit(-1)), "exp_id")


def context_comparison(results: DataFrame, baseline: int = 80) -> DataFrame:
    """Best context per tier, its gain over the baseline context, and whether
    all tiers agree on the baseline."""
    at = F.max(F.when(F.col("context_length") == baseline, F.col("auc")))
    t = results.groupBy("tier").agg(
        F.max_by("context_length", F.struct(F.col("auc"), -F.col("context_length"))).alias("best_context"),
        F.max("auc").alias("best_auc"), at.alias("baseline_auc"))
    t = t.withColumn("improvement_pct", F.when(
        F.col("baseline_auc") > 0, (F.col("best_auc") - F.col("baseline_auc")) / F.nullif("baseline_auc", F.lit(0.0)) * 100))
    agree = t.agg(F.every(F.col("best_context") == baseline).alias("all_at_baseline"))
    return t.join(F.broadcast(agree))      # one row


def sweep_summary(results: DataFrame, by: str, setting: list[str]) -> DataFrame:
    """Settings of the best trial by three metrics; equal scores go to the lower
    trial number."""
    ok = F.col("auc").isNotNull()
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("completed")]
    for m in ("auc", "precision", "recall"):
        score = F.struct(F.when(ok, F.coalesce(F.col(m), F.lit(0.0))), -F.col("trial_number"))
        for s in setting:
            aggs.append(F.max_by(s, score).alias(f"{s}_by_{m}"))
        aggs.append(F.max(F.when(ok, F.coalesce(F.col(m), F.lit(0.0)))).alias(f"best_{m}"))
    return results.groupBy(by).agg(*aggs)


def success_rate(log: DataFrame) -> DataFrame:
    return log.groupBy("phase").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("succeeded"),
        F.avg((F.col("status") == "success").cast("double")).alias("success_rate"))


def attach_architecture(listed: DataFrame, detail: DataFrame, columns: list[str],
                        on: tuple[str, ...] = ("trial_number",)) -> DataFrame:
    """Fill missing architecture columns from the per-trial records."""
    d = detail.select(*on, *[F.col(c).alias(f"_{c}") for c in columns])
    return listed.join(d, list(on), "left").withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).select(*listed.columns)


def paired_seeds(results: DataFrame, a: str, b: str, metric: str = "auc") -> DataFrame:
    """Mean and sample sigma per loss, and the paired difference per seed."""
    one = results.groupBy("seed").agg(
        F.avg(F.when(F.col("loss") == a, F.col(metric))).alias("a"),
        F.avg(F.when(F.col("loss") == b, F.col(metric))).alias("b"))
    d = F.col("b") - F.col("a")
    return one.agg(F.avg("a").alias("mean_a"), F.stddev_samp("a").alias("std_a"), F.avg("b").alias("mean_b"),
                   F.stddev_samp("b").alias("std_b"), F.avg(d).alias("mean_diff"), F.stddev_pop(d).alias("std_diff"),
                   F.count(d).alias("n_pairs"))


def best_per_budget(results: DataFrame, order: list[str]) -> DataFrame:
    """Best score per budget in the given order, against the budget before."""
    place = F.coalesce(*[F.when(F.col("budget") == b, i) for i, b in enumerate(order)])
    g = results.groupBy("budget").agg(F.max("auc").alias("best_auc"), F.max_by("trial_number", F.struct(
        F.col("auc"), -F.col("trial_number"))).alias("trial_number"))
    # one row per budget name
    w = Window.partitionBy(F.lit(0)).orderBy("_p")
    g = g.withColumn("_p", place).filter("_p is not null")
    return g.withColumn("previous_auc", F.lag("best_auc").over(w)).withColumn(
        "improves", F.coalesce(F.col("best_auc") > F.col("previous_auc"), F.lit(False))).drop("_p")


def budget_matrix(results: DataFrame, config: str, budgets: list[str]) -> DataFrame:
    return results.groupBy(config).pivot("budget", budgets).agg(F.max("auc"))
