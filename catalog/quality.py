"""Registered queries: feature quality, curation, table validation and registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.inputs import daily_bars, predictions, rounded, table
from tickloom.functions import frames as W
from tickloom.operators import evaluate as E
from tickloom.operators import labels, quality as Q, validate as V
from tickloom.operators.information import neighbour_information
from tickloom.plans.features import feature_table
from tickloom.sources.tables import stored

COLS = ["ret", "gap", "body", "span", "volume", "dist"]


def rows(spark, sf, in_order: bool = False) -> DataFrame:
    """Six simple features per bar and whether the next high gains 5%.  With `in_order` keys are
    dealt out by range, so the partitions are in the order of key and day, as their rows are."""
    b = daily_bars(spark, sf)
    if in_order:
        b = b.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "ts")
    prev = W.lag("close")
    return b.select(
        "key", "ts", (F.col("close") / prev - 1).alias("ret"), (F.col("open") / prev - 1).alias("gap"),
        (F.col("close") / F.col("open") - 1).alias("body"), (F.col("high") / F.col("low") - 1).alias("span"),
        F.col("volume").cast("double").alias("volume"), (F.col("close") / W.mean("close", 5) - 1).alias("dist"),
        labels.high_label(1, 0.05).alias("y")).dropna()


def gaps(spark, sf) -> DataFrame:
    """The same with values missing in other rows of each column."""
    return rows(spark, sf).withColumns({c: F.when(F.col("key") % (i + 3) != 0, F.col(c)) for i, c in enumerate(COLS)})


def feature_metrics(spark, sf) -> DataFrame:
    """A metrics table with a stability and a drop column."""
    m = Q.metrics_table(rows(spark, sf), COLS, "y")
    return m.withColumns({"temporal_stability_cv": F.col("max_redundancy"),
                          "precision_drop": F.col("mutual_information") / 10})


def named_metrics(spark, sf) -> DataFrame:
    """The metrics under feature names of several categories."""
    tail = F.explode(F.array(*[F.lit(t) for t in ("rsi", "sma", "volume", "fib", "plain")]))
    m = Q.combined_scores(Q.metrics_table(rows(spark, sf), COLS, "y"))
    m = m.withColumn("t", tail).withColumn("feature", F.concat_ws("_", "t", "feature"))
    return m.select("feature", F.round(F.col("combined_score") + F.length("t") / 100, 6).alias("combined_score"))


def _by_part(spark, sf) -> DataFrame:
    """Correlation per feature and third of the keys, as importances per seed."""
    r = rows(spark, sf)
    parts = [Q.target_correlation(r.filter(F.col("key") % 3 == k), COLS, "y").withColumn("seed", F.lit(k)) for k in range(3)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumnRenamed("correlation", "importance")


def _reduction_runs(spark, sf) -> DataFrame:
    """Every run of the predictions against run_1."""
    d = E.detailed(predictions(spark, sf)).select(
        "run_id", "precision", "recall", "auc", (F.col("pred_max") - F.col("pred_min")).alias("pred_range"))
    base = d.filter("run_id = 'run_1'").select(*[F.col(c).alias(f"base_{c}") for c in ("precision", "recall", "auc")])
    return d.join(F.broadcast(base))          # one row


def _stored(spark, sf) -> DataFrame:
    """A stored feature table with a few wrong values."""
    f = feature_table(daily_bars(spark, sf), ["sma_12", "return_1d"], warm_up="keep")
    wrong = F.when((F.col("key") == 7) & (F.dayofmonth("ts") == 1), F.col("sma_12") + 0.5).otherwise(F.col("sma_12"))
    return f.withColumn("sma_12", wrong)


def _model(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    r = stored(rows(spark, sf))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=COLS, outputCol="features"),
                            LogisticRegression(labelCol="y", maxIter=20)])
    return r, pipe.fit(r)


#: A logistic model with given weights.
WEIGHTS = {"ret": -2.0, "gap": 1.5, "body": 1.0, "span": 8.0, "dist": -3.0}


def fixed_logit(df: DataFrame):
    z = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(-0.2))
    return F.round(1 / (1 + F.exp(-z)), 9)


LIMITS = {"rsi_daily": (0, 100), "stoch_k_14": (0, 100), "williams_r_14": (-100, 0), "bb_percent_b": (-0.1, 1.1)}
RULES = {"positive_atr": "atr_14 > 0", "percent_b_plausible": "bb_percent_b between -2 and 2",
         "rsi_bounded": "rsi_daily between 0 and 100"}
IMPLY = {"overbought": ("rsi_distance_from_50 > 20", "days_rsi_overbought > 0"),
         "oversold": ("rsi_distance_from_50 < -20", "days_rsi_oversold > 0"),
         "up_move": ("consecutive_up_days > 1", "return_1d > 0")}
SHARES = {"return_1d_mean": ("avg(return_1d)", -5.0, 5.0), "up_share": ("avg(cast(return_1d > 0 as double))", 0.3, 0.7)}
EVENTS = {"year_1998": ("1998-01-01", "1998-12-31", "cast(return_1d > 0 as double)", 0.3, 0.7),
          "spring_2000": ("2000-03-01", "2000-05-31", "return_1d", -1.0, 1.0)}


def queries() -> dict:
    q = {}

    def reg(name, digits=6):
        def put(fn):
            q[name] = lambda spark, sf: rounded(fn(spark, sf), digits)
            return fn
        return put

    def feats(spark, sf, names):
        return feature_table(daily_bars(spark, sf), names, warm_up="keep")

    reg("Q01_target_correlation")(lambda s, sf: Q.target_correlation(rows(s, sf), COLS, "y"))
    reg("Q02_rank_correlation")(lambda s, sf: Q.rank_correlation(rows(s, sf), COLS, "y"))
    reg("Q02_rank_correlation_returns")(lambda s, sf: Q.rank_correlation(rows(s, sf), COLS[1:], "ret"))
    reg("Q03_mutual_information")(lambda s, sf: Q.mutual_information(rows(s, sf), COLS, "y"))
    reg("Q04_redundancy")(lambda s, sf: Q.redundancy(rows(s, sf), COLS))
    reg("Q05_max_redundancy")(lambda s, sf: Q.max_redundancy(Q.redundancy(rows(s, sf), COLS)))
    reg("Q03_neighbour_information")(lambda s, sf: neighbour_information(stored(rows(s, sf).select(*COLS, "y")), COLS, "y"))
    reg("Q03_neighbour_information_gaps", 5)(lambda s, sf: neighbour_information(stored(gaps(s, sf).select(*COLS, "y")), COLS, "y"))
    reg("Q04_redundancy_gaps")(lambda s, sf: Q.redundancy(gaps(s, sf), COLS))
    reg("Q06_scaled")(lambda s, sf: Q.scaled_01(Q.target_correlation(rows(s, sf), COLS, "y"), ["correlation", "n"]))
    reg("Q07_combined_scores", 5)(lambda s, sf: Q.combined_scores(Q.metrics_table(rows(s, sf), COLS, "y")))
    reg("Q07_combined_scores_with_drop", 5)(lambda s, sf: Q.combined_scores(feature_metrics(s, sf)).select("feature", "combined_score"))
    reg("Q08_importance_report", 5)(lambda s, sf: Q.importance_report(rows(s, sf), COLS, "y"))

    @reg("Q09_permutation_importance")
    def _(spark, sf):
        r, model = _model(spark, sf)
        return Q.permutation_importance(model, r, COLS, ["key", "ts"], "y", "auc")

    reg("Q08_importance_report_neighbours", 5)(lambda s, sf: Q.importance_report(rows(s, sf), COLS, "y", neighbour_information))
    for metric in ("auc", "precision"):
        reg(f"Q09_permutation_{metric}")(lambda s, sf, m=metric: Q.permutation_importance(
            fixed_logit, rows(s, sf, in_order=True), COLS, ["key", "ts"], "y", m, repeats=3, in_order=True))
    reg("Q10_stability")(lambda s, sf: Q.stability(_by_part(s, sf)))
    reg("Q11_grades")(lambda s, sf: Q.assess(feature_metrics(s, sf)).select(
        "feature", *[f"{m}_grade" for m in Q.LIMITS]))
    reg("Q12_verdicts")(lambda s, sf: Q.assess(feature_metrics(s, sf)).select("feature", "overall_verdict"))
    reg("Q12_filtered")(lambda s, sf: Q.with_verdict_at_least(Q.assess(feature_metrics(s, sf)), "marginal").select("feature"))
    reg("Q12_report")(lambda s, sf: Q.quality_report(Q.assess(feature_metrics(s, sf))))
    reg("Q13_categories")(lambda s, sf: named_metrics(s, sf).select("feature", Q.category().alias("category")))
    reg("Q14_removal_round")(lambda s, sf: Q.removal_round(named_metrics(s, sf), 0.4).select("feature", "category", "removed"))
    reg("Q15_reduction_validation")(lambda s, sf: Q.validate_reduction(_reduction_runs(s, sf)).drop("base_precision", "base_recall", "base_auc"))
    reg("Q16_feature_check", 5)(lambda s, sf: Q.feature_check(rows(s, sf), "dist", "y", ["ret", "gap", "body"]))
    reg("Q17_boosted_baseline", 3)(lambda s, sf: Q.boosted_baseline(
        rows(s, sf), COLS, "y", F.col("ts") < F.lit("2000-01-01").cast("date")))

    # --- validation --------------------------------------------------------------------
    reg("V01_columns")(lambda s, sf: V.columns_check(
        feats(s, sf, ["sma_12", "return_1d"]), ["key", "ts", "sma_12", "return_5d"]))
    reg("V02_nulls_and_infinities")(lambda s, sf: V.nulls_and_infinities(
        feats(s, sf, ["sma_12", "return_252d", "rsi_daily"]), ["sma_12", "return_252d", "rsi_daily"]))
    reg("V03_order")(lambda s, sf: V.order_check(
        table(s, sf, "orders").withColumn("day", F.to_date("o_orderdate")), "o_orderpriority", "o_orderkey", "day", 1000))
    reg("V04_bounds", 4)(lambda s, sf: V.bounds_check(feats(s, sf, list(LIMITS)), LIMITS, 1e-6))
    reg("V05_rules")(lambda s, sf: V.rules_check(feats(s, sf, ["atr_14", "bb_percent_b", "rsi_daily"]), RULES))
    reg("V06_recompute")(lambda s, sf: V.recompute_check(
        _stored(s, sf), feats(s, sf, ["sma_12", "return_1d"]), ["key", "ts"], ["sma_12", "return_1d"]))
    names = ["sma_12", "rsi_daily", "macd_line", "days_above_sma_9", "rsi_weekly"]
    reg("V07_lookahead", 4)(lambda s, sf: V.lookahead_check(
        stored(daily_bars(s, sf)), lambda b: feature_table(b, names, warm_up="keep"), names,
        ["1998-06-30", "1999-12-31", "2001-03-15"]))
    reg("V07_lookahead_found")(lambda s, sf: V.lookahead_check(
        daily_bars(s, sf), lambda b: b.select("key", "ts", W.lead("close").alias("peek"), F.col("close")),
        ["peek", "close"], ["1998-06-30", "1999-12-31"]))
    reg("V08_implications")(lambda s, sf: V.implications_check(
        feats(s, sf, ["rsi_distance_from_50", "days_rsi_overbought", "days_rsi_oversold", "consecutive_up_days", "return_1d"]), IMPLY))
    reg("V09_distributions", 4)(lambda s, sf: V.distribution_check(feats(s, sf, ["return_1d"]), SHARES))
    reg("V10_events", 4)(lambda s, sf: V.event_check(feats(s, sf, ["return_1d"]), EVENTS))
    reg("V11_audit_rows")(lambda s, sf: V.audit_rows(daily_bars(s, sf), ["1997-03-03", "2000-07-04"], ["close", "volume"]))

    def report_rows(s, sf):
        names = ["rsi_daily", "stoch_k_14", "williams_r_14", "bb_percent_b", "atr_14", "return_1d"]
        f = stored(feats(s, sf, names).select(names))       # three checks read it
        return V.report({"bounds": V.bounds_check(f, LIMITS, 1e-6), "rules": V.rules_check(f, RULES),
                         "shares": V.distribution_check(f, SHARES)})
    reg("V12_report")(report_rows)
    reg("V12_report_summary")(lambda s, sf: V.report_summary(report_rows(s, sf)))
    reg("V13_profile", 4)(lambda s, sf: V.profile(daily_bars(s, sf), ["open", "close", "volume"]))
    reg("V13_date_range")(lambda s, sf: V.date_range(daily_bars(s, sf)))

    def registry(s, sf):
        """Three datasets, one of them registered twice and one since changed."""
        o, c, v = (table(s, sf, t) for t in ("orders", "customer", "supplier"))
        keep = ["o_orderkey", "o_custkey", "o_orderstatus"]
        entries = [
            V.registry_entry(o.select(*keep).filter("o_orderkey % 2 = 0"), "orders", "/data/orders", 1, "raw", "2025-01-01"),
            V.registry_entry(o.select(*keep), "orders", "/data/orders", 2, "raw", "2025-02-01"),
            V.registry_entry(c.select("c_custkey", "c_name"), "customer", "/data/customer", 1, "raw", "2025-01-01"),
            V.registry_entry(v.select("s_suppkey", "s_name"), "supplier", "/data/supplier", 1, "raw", "2025-01-01", ["orders"])]
        out = entries[0]
        for e in entries[1:]:
            out = out.unionByName(e)
        now = V.fingerprint(o.select(*keep)).withColumn("path", F.lit("/data/orders")).unionByName(
            V.fingerprint(c.select("c_custkey", "c_mktsegment")).withColumn("path", F.lit("/data/customer")))
        return out, now
    keyed = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    moved = "CASE WHEN o_orderkey % 997 = 0 THEN o_custkey + 1 ELSE o_custkey END"
    reg("V14_leaves")(lambda s, sf: V.content_leaves(table(s, sf, "orders").select(*keyed), ["o_orderkey"]))
    reg("V14_root")(lambda s, sf: V.content_root(V.content_leaves(table(s, sf, "orders").select(*keyed), ["o_orderkey"])))
    reg("V14_changed_buckets")(lambda s, sf: V.changed_buckets(
        V.content_leaves(table(s, sf, "orders").select(*keyed), ["o_orderkey"]),
        V.content_leaves(table(s, sf, "orders").withColumn("o_custkey", F.expr(moved)).select(*keyed), ["o_orderkey"])))
    reg("V14_registry")(lambda s, sf: registry(s, sf)[0].drop("sources"))
    reg("V14_latest")(lambda s, sf: V.latest_entries(registry(s, sf)[0]).drop("sources"))
    reg("V14_verify")(lambda s, sf: V.verify(*registry(s, sf)))
    return q
