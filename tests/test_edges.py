"""Zero prices, NaN, values of very different size, duplicate keys."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions.ranking import value_ranks
from tickloom.operators import evaluate as E
from tickloom.operators import labels
from tickloom.operators.bars import normalise_bars
from tickloom.operators.validate import fingerprint, lookahead_check
from tickloom.plans.features import feature_table, tier_columns


@pytest.mark.parametrize("tier", ["a100", "a200"])
def test_columns_on_zero_price_flat_bars_and_no_volume(make_bars, walk, tier):
    closes, volume = [*walk], [1000 + i for i in range(len(walk))]
    closes[120], closes[121:126], volume[130:160] = 0.0, [50.0] * 5, [0] * 30
    bars = make_bars(closes, volume=volume)
    flat = (F.dayofmonth("ts") % 7 == 0) | (F.col("close") == 0)
    bars = bars.withColumns({c: F.when(flat, F.col("close")).otherwise(F.col(c)) for c in ("open", "high", "low")})
    vix = bars.select("ts", F.lit(15.0).alias("vix"))
    rows = feature_table(bars, tier_columns(tier), vix, warm_up="keep").collect()
    assert len(rows) == len(closes)


def test_next_return_on_zero_price(make_bars):
    got = make_bars([1, 0, 2, 3]).select("ts", labels.next_return_label(0.1).alias("y")).orderBy("ts").collect()
    assert [r.y for r in got] == [0, 0, 1, 0]


def test_one_huge_value_leaves_later_means_right(make_bars):
    bars = make_bars([1e13] + [1.003] * 80)
    got = feature_table(bars, ["sma_12", "sma_50"], warm_up="keep").orderBy("ts").collect()
    assert got[-1].sma_50 == pytest.approx(1.003, abs=1e-12) == got[-1].sma_12


def test_nan_price_is_a_missing_price(make_bars):
    bars = make_bars([1, 2, 3]).withColumn("low", F.when(F.col("close") == 2, F.lit(float("nan"))).otherwise(F.col("low")))
    with pytest.raises(Exception, match="bar without low"):
        normalise_bars(bars).collect()


def test_ranks_of_large_and_mixed_values(spark):
    values = [float(v) for v in (*range(10 ** 9, 2 * 10 ** 9, 10 ** 6), *range(10 ** 11, 10 ** 11 + 500), 0, -1e300, 1e-300, -3, -3.5)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.below for r in value_ranks(df, [], "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_temperature_of_a_separable_run(spark):
    rows = [("sep", 0.4, 0), ("sep", 0.6, 1), ("inv", 0.4, 1), ("inv", 0.6, 0), ("one", 0.7, 1), ("one", 0.3, 1), ("one", 0.3, 0), ("one", 0.3, 0)]
    got = {r.run_id: r.temperature for r in E.temperature(spark.createDataFrame(rows, "run_id string, prob double, label int")).collect()}
    assert got["sep"] == pytest.approx(0.01) and got["inv"] == pytest.approx(10.0)
    assert 0.01 < got["one"] < 10


def test_platt_is_fitted_per_run(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = []
    for run, slope, base in (("a", 6.0, -3.0), ("b", -4.0, 1.0)):
        p = rng.random(400)
        y = rng.random(400) < 1 / (1 + np.exp(-(slope * p + base)))
        rows += [(run, float(x), int(v)) for x, v in zip(p, y)]
    rows += [("one", 0.2, 1), ("one", 0.9, 1)]
    got = E.platt(spark.createDataFrame(rows, "run_id string, prob double, label int")).toPandas()
    for run in ("a", "b"):
        g = got[got.run_id == run]
        # at the minimum the residuals sum to 0, and against the score to minus the ridge's pull
        w = np.polyfit(g.prob, np.log(g.calibrated / (1 - g.calibrated)), 1)[0]
        assert abs((g.calibrated - g.label).sum()) < 1e-5
        assert abs(((g.calibrated - g.label) * g.prob).sum() + w) < 1e-5
    assert (got[got.run_id == "one"].calibrated > 0.99).all()


def test_soft_auc_outside_the_unit_range(spark):
    rows = [("r", -0.5, 0), ("r", 1.7, 1)]
    got = E.soft_auc(spark.createDataFrame(rows, "run_id string, prob double, label int")).collect()
    assert len(got) == 1


def test_fingerprint_tells_values_apart(spark):
    sums = [fingerprint(spark.createDataFrame(rows, "a string, b string")).first().checksum
            for rows in ([("a|b", "c")], [("a", "b|c")], [("~", "c")], [(None, "c")], [("1:a", "")], [("1", "a")])]
    assert len(set(sums)) == len(sums)


def test_lookahead_with_a_bar_in_the_key(make_bars):
    bars = make_bars(range(1, 40), key="A|B")
    got = lookahead_check(bars, lambda b: feature_table(b, ["sma_12"], warm_up="keep"), ["sma_12"], ["2024-02-10"])
    assert all(r.passed and r.unmatched == 0 for r in got.collect())


def test_combined_dataset_refuses_duplicates(make_bars):
    bars = make_bars(range(1, 30))
    features = feature_table(bars, ["sma_12"], warm_up="keep")
    marks = bars.select("key", "ts", F.lit(1).alias("y"))
    vix = bars.select("ts", F.lit(1.0).alias("vix"))
    assert labels.combined_dataset(bars, features, marks, vix).count() == 18
    for bad in ((marks.union(marks), vix), (marks, vix.union(vix)), (marks.filter("ts < '1990-01-01'"), vix)):
        with pytest.raises(ValueError, match="duplicate|no common"):
            labels.combined_dataset(bars, features, *bad)
