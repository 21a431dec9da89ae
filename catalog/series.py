"""Registered queries: resampling, alignment, labels, splits, samples, regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import daily_bars, rounded, second_series, table
from tickloom.functions import frames as W
from tickloom.functions.long_scan import scan_long
from tickloom.operators import align, bars, labels, samples
from tickloom.plans.features import feature_table
from tickloom.sources.tables import stored


def _bars(spark, sf):
    return daily_bars(spark, sf)


def _raw_names(spark, sf):
    """Bars under foreign names and types, as a raw file would hold them."""
    b = _bars(spark, sf)
    return b.select(F.col("key").cast("string").alias("Ticker"), F.col("ts").cast("timestamp").alias("Date"),
                    F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
                    F.col("close").alias("Close"), F.col("volume").cast("double").alias("Volume"))


RAW = {"key": "Ticker", "ts": "Date", "open": "Open", "high": "High", "low": "Low", "close": "Close",
       "volume": "Volume"}


def _features(spark, sf, bars=None):
    return feature_table(_bars(spark, sf) if bars is None else bars, ["sma_12", "return_1d"], warm_up="drop")


def _sample_rows(spark, sf, context=5):
    """Contexts of 5 closes with a label."""
    s = labels.samples(_bars(spark, sf), ["close"], context, 1, 0.01)
    return s.select("key", "ts", F.transform("x", lambda v: v["close"]).alias("x"), "label")


def _spread(df, extra=()):
    """One row per sample and position.  The outer form, since from the other Spark derives
    a filter on the array and computes the array three times."""
    out = df.select("key", "ts", *extra, F.posexplode_outer("x").alias("pos", "value"))
    return rounded(out.filter(F.col("pos").isNotNull()))


def _second_with_gaps(spark, sf):
    return align.align_second_series(_bars(spark, sf), second_series(spark, sf)).select("key", "ts", "vix")


def queries() -> dict:
    q = {}

    def reg(name):
        def put(fn):
            q[name] = fn
            return fn
        return put

    @reg("SCAN_long_series")
    def _(spark, sf):
        """Averages over every line, one series per return flag: a key holds up to half of the rows."""
        paid = (F.lit(100.0) + F.sqrt(F.col("l_extendedprice") / F.col("l_quantity"))) * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
        ticks = table(spark, sf, "lineitem").select(
            F.col("l_returnflag").alias("key"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", paid.alias("price"))
        out = scan_long(ticks, [
            ("e1", "ema", ("price",), {"n": 9}), ("e2", "ema", ("e1",), {"n": 9}), ("e3", "ema", ("e2",), {"n": 9}),
            ("before", "previous", ("price",), {"n": 1}), ("move", "difference", ("price", "before"), {}),
            ("up", "rise", ("move",), {}), ("down", "fall", ("move",), {}),
            ("gain", "wilder", ("up",), {"n": 7}), ("loss", "wilder", ("down",), {"n": 7}), ("strength", "strength", ("gain", "loss"), {})],
            order=("ts", "l_orderkey", "l_linenumber", "l_partkey"))
        return rounded(out.select("key", F.col("ts").cast("string").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", "price",
                                  F.col("e1").alias("average"), (3 * F.col("e1") - 3 * F.col("e2") + F.col("e3")).alias("triple"), "strength"))

    @reg("F001_bars")
    def _(spark, sf):
        return rounded(_bars(spark, sf))

    @reg("F001_bars_hot_key")
    def _(spark, sf):
        """Three keys that each own a third of the lines."""
        return rounded(daily_bars(spark, sf, "l_returnflag"))

    @reg("S02_normalised_bars")
    def _(spark, sf):
        return rounded(bars.normalise_bars(_raw_names(spark, sf), RAW))

    @reg("S02_null_counts")
    def _(spark, sf):
        return rounded(bars.null_counts(_second_with_gaps(spark, sf), ["key", "ts", "vix"]))

    for scale in ("2d", "3d", "5d", "weekly"):
        q[f"R0{2 if scale == 'weekly' else 1}_resample_{scale}"] = (
            lambda s: lambda spark, sf: rounded(bars.resample(_bars(spark, sf), s)))(scale)

    @reg("R03_timescale_names")
    def _(spark, sf):
        # names are case-insensitive: the same bars as 5d
        return rounded(bars.resample(_bars(spark, sf), "5D").groupBy("key").agg(
            F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume")))

    @reg("R04_week_start")
    def _(spark, sf):
        return rounded(bars.resample_week_start(_bars(spark, sf)))

    @reg("R05_weekly_to_daily")
    def _(spark, sf):
        d = align.weekly_to_daily(_bars(spark, sf), {"wk_sma": "sma_5", "wk_ret": "return_1d"})
        return rounded(d.select("key", "ts", W.ffill("wk_sma").alias("weekly_sma_5"),
                                W.ffill("wk_ret").alias("weekly_return")))

    @reg("R05_weekly_asof")
    def _(spark, sf):
        d = align.asof_weekly_to_daily(_bars(spark, sf), {"weekly_sma_5": "sma_5"})
        return rounded(d.select("key", "ts", "weekly_sma_5"))

    @reg("R06_second_series")
    def _(spark, sf):
        return rounded(_second_with_gaps(spark, sf), 4)

    @reg("R07_join_one_to_one")
    def _(spark, sf):
        j = align.join_one_to_one(_bars(spark, sf).select("key", "ts", "close"), _features(spark, sf),
                                  ["key", "ts"])
        return rounded(j)

    @reg("R07_duplicate_keys")
    def _(spark, sf):
        li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.to_date("l_shipdate").alias("ts"))
        return rounded(align.duplicate_keys(li, ["key", "ts"]))

    @reg("R08_overlap")
    def _(spark, sf):
        return rounded(align.overlap(_bars(spark, sf), second_series(spark, sf), ["ts"]))

    @reg("R09_tier_join")
    def _(spark, sf):
        return rounded(feature_table(_bars(spark, sf), ["sma_12", "sma_50", "return_5d", "obv"]))

    @reg("R10_aligned_labels")
    def _(spark, sf):
        lab = labels.threshold_labels(_bars(spark, sf), (1, 5), (0.01,))
        return rounded(labels.align_labels(lab, _features(spark, sf)))

    @reg("R11_fill_gaps")
    def _(spark, sf):
        return rounded(align.fill_gaps(_second_with_gaps(spark, sf), ["vix"]), 4)

    @reg("R11_fill_gaps_back")
    def _(spark, sf):
        return rounded(align.fill_gaps(_second_with_gaps(spark, sf), ["vix"], back=True), 4)

    @reg("R12_pivot_count")
    def _(spark, sf):
        o = table(spark, sf, "orders")
        return rounded(align.pivot_count(o, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"]))

    @reg("R12_pivot_first")
    def _(spark, sf):
        o = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
            F.max("o_totalprice").alias("top"))
        return rounded(align.pivot_first(o, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "top"))

    @reg("R13_panel")
    def _(spark, sf):
        return rounded(align.panel(_bars(spark, sf), exogenous=["volume"], start=F.lit("1996-01-01").cast("date"),
                                   end=F.lit("2000-01-01").cast("date")))

    @reg("R13_panel_prices")
    def _(spark, sf):
        return rounded(align.panel(_bars(spark, sf), use_returns=False))

    @reg("R14_union_rows")
    def _(spark, sf):
        a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
        b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
        return rounded(align.union_rows(a, b))

    # --- labels ------------------------------------------------------------------
    @reg("D01_future_max")
    def _(spark, sf):
        return rounded(_bars(spark, sf).select("key", "ts", *[
            labels.future_max("close", h).alias(f"future_max_h{h}") for h in (1, 2, 3, 5)]))

    @reg("D02_threshold_labels")
    def _(spark, sf):
        return rounded(labels.threshold_labels(_bars(spark, sf)))

    @reg("D03_high_label")
    def _(spark, sf):
        b = _bars(spark, sf).withColumns({"high": labels.required("high"), "close": labels.required("close")})
        return rounded(b.select("key", "ts", labels.high_label(3, 0.05).alias("by_high"),
                                labels.high_label(3, 0.05, use_high=False).alias("by_close")))

    @reg("D04_next_return_label")
    def _(spark, sf):
        return rounded(_bars(spark, sf).select("key", "ts", labels.next_return_label(0.01).alias("target")))

    @reg("D05_normalisation_fit")
    def _(spark, sf):
        b = _bars(spark, sf).withColumn("pos", labels.row_number())
        return rounded(labels.normalisation(b, ["close", "volume"], F.col("pos") < 300))

    @reg("D06_normalised")
    def _(spark, sf):
        b = _bars(spark, sf).withColumn("volume", F.col("volume").cast("double"))
        return rounded(labels.normalise_by_first_rows(b, ["close", "volume"], 300).select(
            "key", "ts", "close", "volume"))

    @reg("D07_population_normalised")
    def _(spark, sf):
        b = _bars(spark, sf).select("key", "ts", "close", F.lit(3.0).alias("flat"))
        return rounded(labels.normalise_before(b, ["close", "flat"], "2000-01-01"))

    @reg("D08_instance_normalised")
    def _(spark, sf):
        s = _sample_rows(spark, sf)
        return _spread(s.withColumn("x", labels.instance_normalise(F.col("x"))))

    @reg("D08_instance_denormalised")
    def _(spark, sf):
        """Predictions a tenth above the normalised values, in units of the sample."""
        s = _sample_rows(spark, sf)
        m, sd = labels.instance_statistics(F.col("x"))
        s = s.withColumn("z", F.transform(labels.instance_normalise(F.col("x"), scale=2.0, shift=0.5), lambda v: v + 0.1))
        return _spread(s.withColumn("x", labels.instance_denormalise(F.col("z"), m, sd, scale=2.0, shift=0.5)).drop("z"))

    def split_out(df):
        return rounded(df.select("key", "ts", "start", "split"))

    @reg("D09_chunk_split")
    def _(spark, sf):
        return split_out(labels.chunk_split(_bars(spark, sf), 15, 5, mode="contiguous"))

    @reg("D10_chunk_split_scattered")
    def _(spark, sf):
        return split_out(labels.chunk_split(_bars(spark, sf), 15, 5))

    @reg("D11_train_starts")
    def _(spark, sf):
        s = labels.chunk_split(_bars(spark, sf), 30, 5, 0.2, 0.1, "contiguous").filter("split = 'train'")
        return split_out(s)

    @reg("D12_train_subset")
    def _(spark, sf):
        s = labels.chunk_split(_bars(spark, sf), 15, 5, mode="contiguous")
        return split_out(labels.subset_of_train(s, 0.3))

    @reg("D13_date_split")
    def _(spark, sf):
        return split_out(labels.date_split(_bars(spark, sf), 15, 5, "1999-01-01", "2000-07-01"))

    @reg("D14_prediction_dates")
    def _(spark, sf):
        return rounded(labels.prediction_date_filter(_bars(spark, sf), 15, 5, "2000-07-01").select(
            "key", "ts", "start", "prediction_ts"))

    @reg("D15_target_date_split")
    def _(spark, sf):
        return split_out(labels.target_date_split(_bars(spark, sf), 15, "1999-01-01", "2000-07-01"))

    @reg("D16_samples")
    def _(spark, sf):
        return _spread(_sample_rows(spark, sf), ["label"])

    @reg("D17_sample_counts")
    def _(spark, sf):
        return rounded(labels.sample_counts(_bars(spark, sf), 80, 5))

    @reg("D18_feature_columns")
    def _(spark, sf):
        """The numeric columns that discovery finds, with their mean."""
        f = _features(spark, sf).withColumn("note", F.lit("text"))
        cols = labels.numeric_columns(f)
        stack = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in cols]))
        return rounded(f.select(stack.alias("s")).groupBy("s.name").agg(F.avg("s.v").alias("mean"),
                                                                         F.count("s.v").alias("n")), 4)

    @reg("D19_patches")
    def _(spark, sf):
        s = labels.samples(_bars(spark, sf), ["close"], 10, 1, 0.01)
        p = labels.patches(F.transform("x", lambda v: v["close"]), 4, 2, 10)
        rows = s.select("key", "ts", F.posexplode(p).alias("patch", "v"))
        return rounded(rows.select("key", "ts", "patch", F.size("v").alias("length"),
                                   F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last")))

    @reg("D20_combined_dataset")
    def _(spark, sf):
        b = stored(_bars(spark, sf))
        lab = labels.threshold_labels(b, (1,), (0.01,))
        v = second_series(spark, sf)
        return rounded(labels.combined_dataset(b, _features(spark, sf, b), lab, v), 4)

    @reg("D21_split_statistics")
    def _(spark, sf):
        s = labels.chunk_split(_bars(spark, sf).withColumn("label", labels.high_label(5, 0.2)), 15, 5, mode="contiguous")
        return rounded(labels.split_statistics(s))

    # --- samples --------------------------------------------------------------------
    @reg("G01_jitter")
    def _(spark, sf):
        return _spread(samples.jitter(_sample_rows(spark, sf), std=0.5))

    @reg("G02_scale")
    def _(spark, sf):
        return _spread(samples.scale(_sample_rows(spark, sf)))

    @reg("G02_scale_features")
    def _(spark, sf):
        """Two features of a sample, each with its own factor, added up."""
        s = _sample_rows(spark, sf).withColumn("z", F.transform("x", lambda v: v * 2))
        s = samples.scale_features(s, ["x", "z"])
        return _spread(s.withColumn("x", F.zip_with("x", "z", lambda a, b: a + b)).drop("z"))

    @reg("G03_mixup")
    def _(spark, sf):
        return _spread(samples.mixup(_sample_rows(spark, sf)), ["label", "lam"])

    @reg("G04_time_warp")
    def _(spark, sf):
        return _spread(samples.time_warp(_sample_rows(spark, sf), 5))

    @reg("G05_compose")
    def _(spark, sf):
        both = samples.compose(lambda d: samples.scale(d, prob=1.0), lambda d: samples.jitter(d, 0.1, prob=1.0))
        return _spread(both(_sample_rows(spark, sf)))

    @reg("G06_volatility_difficulty")
    def _(spark, sf):
        return rounded(samples.volatility_difficulty(_bars(spark, sf), 20))

    @reg("G07_confidence_difficulty")
    def _(spark, sf):
        from catalog.inputs import quality_predictions
        return rounded(quality_predictions(spark, sf).select(
            "sample_id", samples.confidence_difficulty().alias("difficulty")))

    @reg("G08_loss_difficulty")
    def _(spark, sf):
        from catalog.inputs import quality_predictions
        return rounded(quality_predictions(spark, sf).select(
            "sample_id", samples.loss_difficulty().alias("difficulty")))

    def curriculum(hardest):
        def run(spark, sf):
            s = samples.volatility_difficulty(_bars(spark, sf), 20)
            return rounded(samples.curriculum(s, 2, hardest=hardest))
        return run
    q["G09_curriculum"] = curriculum(False)
    q["G10_anti_curriculum"] = curriculum(True)

    @reg("G11_volatility_regime")
    def _(spark, sf):
        return rounded(samples.volatility_regime(_bars(spark, sf), 20, 0.35, 0.40))

    @reg("G12_trend_regime_sma")
    def _(spark, sf):
        return rounded(samples.trend_regime_sma(_bars(spark, sf)))

    @reg("G13_trend_regime_adx")
    def _(spark, sf):
        return rounded(samples.trend_regime_adx(_bars(spark, sf)))

    @reg("G14_cluster_regime")
    def _(spark, sf):
        f = samples.cluster_features(_bars(spark, sf), 20)
        return rounded(samples.cluster_regime(f), 4)

    @reg("G14_cluster_features")
    def _(spark, sf):
        return rounded(samples.cluster_features(_bars(spark, sf), 20))

    @reg("G15_regime_weights")
    def _(spark, sf):
        r = samples.trend_regime_sma(_bars(spark, sf))
        return rounded(samples.regime_weights(r, {0: 2.0, 2: 0.5}))

    return q
