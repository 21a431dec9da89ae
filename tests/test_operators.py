"""Operators against hand results and brute force, with one key or run that
holds a third of all rows or more."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.hashing import normal, uniform
from tickloom.functions.ranking import quantiles, row_positions, value_ranks
from conftest import TESTDATA  # noqa: E402
from tickloom.operators import align, bars as B, evaluate as E, labels as L, quality as Q, samples as G, trials as T


@pytest.fixture(scope="module")
def pred(spark):
    rng = np.random.default_rng(3)
    rows = []
    for run, n in (("hot", 900), ("b", 200), ("c", 40)):
        y = rng.integers(0, 2, n)
        p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
        rows += [(run, i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))]
    rows += [("one_class", i, 0.5, 1) for i in range(5)]
    return spark.createDataFrame(rows, "run_id string, sample_id long, prob double, label int")


def brute_pairs(pdf, fn):
    pos, neg = pdf[pdf.label == 1].prob.to_numpy(), pdf[pdf.label == 0].prob.to_numpy()
    return np.mean(fn(pos[:, None], neg[None, :]))


@pytest.mark.parametrize("cuts", [[], [0.5], [-2.0, 0.2, 0.37, 0.4, 0.41, 0.9]])
def test_auc_in_pieces_is_the_same(spark, pred, cuts, monkeypatch):
    """Between any cuts, with scores packed from 50 rows at a time, below 0 and missing, and a run without a name."""
    monkeypatch.setattr(E, "PACKED", 50)
    odd = [("odd", i, (i % 7 - 3) / 5 if i % 9 else None, i % 2 if i % 11 else None) for i in range(200)]
    more = spark.createDataFrame(odd + [(None, i, i % 13 / 13, i % 3 % 2) for i in range(90)], pred.schema)
    rows = pred.unionByName(more).repartition(6)
    want, got = (sorted(map(tuple, d.collect()), key=str) for d in (E.roc_auc(rows), E.roc_auc(rows, cuts)))
    assert E.roc_auc(rows).schema == E.roc_auc(rows, cuts).schema
    assert [w[:3] for w in want] == [g[:3] for g in got]
    assert [w[3] for w in want] == pytest.approx([g[3] for g in got], abs=1e-12)
    assert E.roc_auc(rows.limit(0), cuts).count() == 0


def test_auc_with_ties(pred):
    got = {r["run_id"]: r["auc"] for r in E.roc_auc(pred).collect()}
    pdf = pred.toPandas()
    for run in ("hot", "b", "c"):
        want = brute_pairs(pdf[pdf.run_id == run], lambda p, n: (p > n) + 0.5 * (p == n))
        assert got[run] == pytest.approx(want, abs=1e-12)
    assert got["one_class"] is None


@pytest.mark.parametrize("gamma", [0.5, 2.0, 8.0])
def test_soft_auc_equals_all_pairs(pred, gamma):
    got = {r["run_id"]: r["soft_auc"] for r in E.soft_auc(pred, gamma).collect()}
    pdf = pred.toPandas()
    for run in ("hot", "b", "c"):
        want = brute_pairs(pdf[pdf.run_id == run], lambda p, n: 1 / (1 + np.exp(-gamma * (n - p))))
        assert got[run] == pytest.approx(want, abs=1e-10)
    assert got["one_class"] == 0.5


def test_calibration_keeps_order_and_range(pred):
    one = pred.filter("run_id = 'hot'")
    iso = E.isotonic(one).orderBy("prob").toPandas()["calibrated"].to_numpy()
    assert (np.diff(iso) >= -1e-12).all() and 0 <= iso.min() and iso.max() <= 1
    platt = E.platt(one).orderBy("prob").toPandas()["calibrated"].to_numpy()
    assert (np.diff(platt) >= -1e-12).all()


def test_temperature_minimises_the_loss(pred):
    t = {r["run_id"]: r["temperature"] for r in E.temperature(pred.filter("run_id <> 'one_class'")).collect()}
    pdf = pred.toPandas()
    p = pdf[pdf.run_id == "hot"]
    z = np.log(np.clip(p.prob, 1e-7, 1 - 1e-7) / (1 - np.clip(p.prob, 1e-7, 1 - 1e-7)))

    def nll(temp):
        s = 1 / (1 + np.exp(-z / temp))
        return -np.mean(p.label * np.log(s) + (1 - p.label) * np.log(1 - s))
    grid = np.linspace(0.05, 10, 4000)
    assert nll(t["hot"]) <= min(map(nll, grid)) + 1e-9


def test_ranks_and_quantiles_in_a_hot_group(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v), i) for i, v in enumerate(np.round(rng.normal(0, 3, 2000), 1))]
    rows += [("hot", 7.0, 5000 + i) for i in range(1000)] + [("x", float(i), i) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, v double, t long")
    pdf = df.toPandas().sort_values(["g", "v", "t"])
    pdf["want"] = pdf.groupby("g").cumcount() + 1
    got = row_positions(df, ["g"], "v", "t").toPandas().sort_values(["g", "v", "t"])
    assert got["position"].tolist() == pdf["want"].tolist()
    q = {r["g"]: r for r in quantiles(df, ["g"], "v", {"q": 0.3, "m": 0.5}).collect()}
    for g in ("hot", "x"):
        v = pdf[pdf.g == g].v
        assert q[g]["q"] == pytest.approx(v.quantile(0.3)) and q[g]["m"] == pytest.approx(v.median())
    assert value_ranks(df, ["g"], "v").agg(F.sum("n")).first()[0] == 3009


def test_rank_correlation_matches_pandas(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 1, 400), 1)
    y = np.round(x + rng.normal(0, 1, 400), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = Q.rank_correlation(df, ["x"], "y").first()["correlation"]
    assert got == pytest.approx(df.toPandas().corr(method="spearman").iloc[0, 1])


def test_label_golden(make_bars):
    bars = make_bars([100, 101, 102, 103, 104])
    got = L.threshold_labels(bars, (2,), (0.01, 0.05)).orderBy("ts").collect()
    assert [r["label_h2_t1pct"] for r in got] == [1, 1, 1] and [r["label_h2_t5pct"] for r in got] == [0, 0, 0]


def test_threshold_crossing_counts_equality(make_bars):
    bars = make_bars([100.0, 101.0, 100.0])
    got = L.threshold_labels(bars, (1,), (0.01,)).orderBy("ts").collect()
    assert [r["label_h1_t1pct"] for r in got] == [1, 0]


def test_train_samples_never_touch_val_or_test(make_bars, walk):
    for mode in ("contiguous", "scattered"):
        s = L.chunk_split(make_bars(walk), 10, 2, mode=mode).orderBy("ts").toPandas()
        blocked = set()
        for start in s[s.split.isin(["val", "test"])].start:
            blocked |= set(range(start, start + 12))
        train = s[s.split == "train"].start
        assert len(train) and all(not blocked & set(range(t, t + 12)) for t in train)
        assert len(s[s.split == "val"]) == int(27 * 0.15) and len(s[s.split == "test"]) == int(27 * 0.15)


def test_too_short_series_raises(make_bars):
    with pytest.raises(Exception, match="too few rows"):
        L.chunk_split(make_bars(range(1, 20)), 10, 2).collect()
    with pytest.raises(Exception, match="too small"):
        L.date_split(make_bars(range(1, 40)), 10, 2, "2024-01-03", "2024-02-01").collect()


def test_missing_price_raises(spark):
    raw = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0, 2.0, 0.5, None, 5)], B.BAR_SCHEMA)
    with pytest.raises(Exception, match="bar without close"):
        B.normalise_bars(raw).collect()


def test_resample_labels(make_bars):
    bars = make_bars(range(100, 120), start=dt.date(2024, 1, 2))
    week = B.resample(bars, "Weekly").orderBy("ts").collect()
    assert week[0]["ts"] == dt.date(2024, 1, 5) and week[0]["open"] == 100 and week[0]["close"] == 103
    two = B.resample(bars, "2d").orderBy("ts").collect()
    assert two[0]["ts"] == dt.date(2024, 1, 2) and two[1]["ts"] == dt.date(2024, 1, 4) and two[1]["close"] == 102
    with pytest.raises(ValueError, match="unknown timescale"):
        B.timescale("4d")


def test_one_to_one_join_refuses_duplicates(make_bars):
    bars = make_bars([1, 2, 3])
    with pytest.raises(ValueError, match="duplicate"):
        align.join_one_to_one(bars, bars.unionByName(bars).select("key", "ts"), ["key", "ts"])
    with pytest.raises(ValueError, match="no common"):
        align.join_one_to_one(bars, bars.select(F.lit("Z").alias("key"), "ts"), ["key", "ts"])


def test_hash_numbers_do_not_depend_on_partitioning(spark):
    ids = spark.range(4000).select(F.col("id"))
    a = ids.repartition(1).select("id", uniform(1, "id").alias("u"), normal(1, "id").alias("z")).orderBy("id").toPandas()
    b = ids.repartition(7).select("id", uniform(1, "id").alias("u"), normal(1, "id").alias("z")).orderBy("id").toPandas()
    assert a.equals(b) and abs(a.u.mean() - 0.5) < 0.02 and abs(a.z.std() - 1) < 0.05 and abs(a.z.mean()) < 0.06


def test_mixup_blends_pairs_of_the_same_key(make_bars, walk):
    s = L.samples(make_bars(walk[:60]), ["close"], 5, 1, 0.01).select(
        "key", "ts", F.transform("x", lambda v: v["close"]).alias("x"), "label")
    rows = G.mixup(s, alpha=0.4, prob=1.0).collect()
    lam = rows[0]["lam"]
    assert len(rows) == s.count() and 0 <= lam <= 1
    assert sum(sum(r["x"]) for r in rows) == pytest.approx(sum(sum(r["x"]) for r in s.collect()))
    assert G.mixup(s, alpha=0.4, prob=0.0).filter("lam <> 1").count() == 0


def test_cluster_regime_numbers_follow_the_mean(spark):
    rows = [("k", dt.date(2024, 1, 1) + dt.timedelta(i), float(10 * (i % 3)), 1.0, 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, ts date, mean double, sd double, slope double")
    got = G.cluster_regime(df).select("mean", "regime").distinct().orderBy("mean").collect()
    assert [r["regime"] for r in got] == [0, 1, 2]


def test_power_law_recovers_its_parameters(spark):
    pts = [("e", x, 1.5 * x ** -0.1) for x in (2e6, 2e7, 2e8, 2e9)]
    df = spark.createDataFrame(pts, "experiment string, params double, best_value double")
    r = T.power_law(df).first()
    assert r["alpha"] == pytest.approx(0.1) and r["coefficient"] == pytest.approx(1.5) and r["r_squared"] == pytest.approx(1)
    with pytest.raises(Exception, match="positive"):
        T.power_law(df.withColumn("best_value", F.lit(0.0))).collect()


def test_best_epoch_takes_the_first_of_equal_losses(spark):
    df = spark.createDataFrame([([(0, 0.5, 0.4), (1, 0.4, 0.3), (2, 0.3, 0.3)],), ([],)],
                               "learning_curve array<struct<epoch:int,train_loss:double,val_loss:double>>")
    got = df.select(T.best_epoch()["epoch"].alias("e")).collect()
    assert [r["e"] for r in got] == [1, None]


def test_removal_keeps_category_minimums(spark):
    rows = [(f"sma_{i}", i / 100) for i in range(6)] + [("plain", 0.001), ("rsi_1", 0.9)]
    df = spark.createDataFrame(rows, "feature string, combined_score double")
    gone = {r["feature"] for r in Q.removal_round(df, 0.9).filter("removed").collect()}
    assert gone == {"sma_0"}


def test_split_without_a_train_chunk(make_bars):
    with pytest.raises(Exception, match="no chunk is left for training"):
        L.chunk_split(make_bars(range(1, 62)), 10, 2, 0.9, 0.05).collect()
    for mode in ("contiguous", "scattered"):
        split = {r.split for r in L.chunk_split(make_bars(range(1, 62)), 10, 2, 0.2, 0.2, mode).collect()}
        assert {"train", "val", "test"} <= split


@pytest.mark.parametrize("name, call, most", [("G04_time_warp", "md5(", 5), ("G05_compose", "md5(", 5), ("D08_instance_normalised", "aggregate(", 3),
                                              ("D08_instance_denormalised", "aggregate(", 6)])
def test_sample_expressions_are_not_repeated(spark, name, call, most):
    from catalog import series
    plan = series.queries()[name](spark, TESTDATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(call) <= most


def test_time_warp_reads_between_the_values(spark):
    df = spark.createDataFrame([("a", i, [float(v * v) for v in range(6)]) for i in range(40)], "key string, ts long, x array<double>")
    still = G.time_warp(df, 6, warp=0.0, prob=1.0).collect()
    assert all(r.x == pytest.approx([v * v for v in range(6)]) for r in still)
    assert [r.x for r in G.time_warp(df, 6, prob=0.0).collect()] == [r.x for r in df.collect()]
    for r in G.time_warp(df, 6, prob=1.0).collect():
        assert r.x[0] == 0 and r.x[-1] == 25 and r.x == sorted(r.x)


def test_instance_statistics_of_short_samples(spark):
    df = spark.createDataFrame([([1.0, 2.0, 6.0],), ([],), (None,), ([1.0, None],)], "x array<double>")
    m, sd = L.instance_statistics(F.col("x"))
    got = df.select(m.alias("m"), sd.alias("sd"), L.instance_normalise(F.col("x")).alias("z")).collect()
    assert got[0].m == 3 and got[0].sd == pytest.approx(7 ** 0.5) and sum(got[0].z) == pytest.approx(0)
    assert got[1].z == [] and got[2].z is None and got[3].z == [None, None]
