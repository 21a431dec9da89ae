import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import quality as Q
from tickloom.operators.information import STEPS, digamma, neighbour_information


def psi(n):
    n = np.asarray(n, float)
    z, out = n + 10, -sum(1 / (n + i) for i in range(10))
    return out + np.log(z) - 1 / (2 * z) - 1 / (12 * z ** 2) + 1 / (120 * z ** 4) - 1 / (252 * z ** 6)


def brute(x, y, k=3):
    x, y = np.array(x, float), np.array(y)
    keep = np.array([(y == v).sum() > 1 for v in y])
    x, y = x[keep], y[keep]
    x = np.where(np.isnan(x), np.nanmean(x), x)
    span = x.max() - x.min()
    g = np.floor((x - x.min()) / span * STEPS + 0.5).astype(np.int64) if span > 0 else np.zeros(len(x), np.int64)
    total = 0.0
    for i in range(len(g)):
        d = np.abs(g - g[i])
        mine = np.sort(d[y == y[i]])          # the first is the row itself
        kk = min(k, len(mine) - 1)
        r = mine[kk]
        m = (d < r).sum() if r > 0 else (d == 0).sum()
        kk = kk if r > 0 else (mine == 0).sum()
        total += psi(kk) - psi(len(mine)) - psi(m)
    return max(0.0, psi(len(g)) + total / len(g))


def test_equals_brute_force_with_nulls(spark):
    r = np.random.default_rng(3)
    n = 10_000
    y = r.integers(0, 2, n)
    cols = {"a": y + r.normal(size=n), "b": r.normal(size=n), "c": np.round(y * 0.5 + r.normal(size=n), 1)}
    for name in ("a", "c"):
        cols[name][r.random(n) < 0.2] = np.nan
    rows = [(int(y[i]), *(None if np.isnan(v[i]) else float(v[i]) for v in cols.values())) for i in range(n)]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double").repartition(7)
    got = {x.feature: x.mutual_information for x in neighbour_information(df, list(cols), "y", block=500).collect()}
    for name, x in cols.items():
        assert got[name] == pytest.approx(brute(x, y), abs=1e-7)
    assert got["a"] > 0.05 > got["b"]


def test_odd_inputs(spark):
    rows = [("u", 1.0, None, 5.0), ("u", 2.0, None, 5.0), ("u", float("nan"), None, 5.0), ("v", 9.0, None, 5.0), ("v", 9.5, None, 5.0),
            ("only", 100.0, None, 5.0), (None, 3.0, None, 5.0)]
    df = spark.createDataFrame(rows, "y string, a double, empty double, same double")
    got = {x.feature: x.mutual_information for x in neighbour_information(df, ["a", "empty", "same"], "y").collect()}
    assert got["a"] == pytest.approx(brute([1, 2, np.nan, 9, 9.5], ["u", "u", "u", "v", "v"]), abs=1e-9)
    assert got["empty"] == got["same"] == 0
    assert neighbour_information(df.limit(0), ["a"], "y").count() == 0


def test_digamma(spark):
    got = spark.range(1, 200).select("id", digamma(F.col("id")).alias("p")).collect()
    assert np.allclose([r.p for r in got], psi([r.id for r in got]), atol=1e-8)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_shuffled_positions_are_a_bijection(spark, n):
    runs = spark.createDataFrame([(str(k), Q.shuffle_keys(5, f"c:{k}", n)) for k in range(3)], f"run string, keys {Q.KEYS}")
    df = spark.range(n).join(runs).select("run", "id", Q.shuffled(F.col("id"), n, F.col("keys")).alias("to"))
    got = {}
    for r in df.collect():
        got.setdefault(r.run, {})[r.id] = r.to
    for places in got.values():
        assert sorted(places.values()) == list(range(n))
    if n == 1000:
        assert got["0"] != got["1"] and sum(k == v for k, v in got["0"].items()) < 10
        assert abs(np.corrcoef(list(got["0"]), list(got["0"].values()))[0, 1]) < 0.15


def test_importance_of_a_used_and_an_unused_column(spark):
    rows = [(i, (i * 37 % 101) / 101, (i * 53 % 97) / 97) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("y", (F.col("a") > 0.5).cast("int"))
    for metric in ("auc", "precision"):
        got = {r.feature: r.importance for r in Q.permutation_importance(
            lambda d: F.col("a"), df, ["a", "b"], ["id"], "y", metric, repeats=3).collect()}
        assert got["b"] == 0 and 0.4 < got["a"] < 0.6


def test_places_of_a_batch_are_those_of_the_expression(spark):
    n, keys = 1009, Q.shuffle_keys(7, "c:0", 1009)
    one = spark.createDataFrame([(keys,)], f"keys {Q.KEYS}")
    want = spark.range(n).join(one).orderBy("id").select(Q.shuffled(F.col("id"), n, F.col("keys")).alias("to")).collect()
    assert Q.shuffled_places(np.arange(n), n, keys).tolist() == [r.to for r in want]


def test_metrics_compute_the_table_once(spark, tmp_path):
    """Every pass over the rows would append to the file again."""
    import pandas as pd
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": np.round(rng.normal(0, 1, 900), 1), "b": np.where(np.arange(900) % 3 > 0, 0.0, rng.normal(0, 1, 900)),
                        "c": rng.normal(0, 1, 900)})
    pdf["y"] = (pdf.a + rng.normal(0, 1, 900) > 0).astype(int)
    log = str(tmp_path / "passes")

    def counted(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write(f"{b.num_rows}\n")
            yield b

    df = spark.createDataFrame(pdf).coalesce(1)
    once = df.mapInArrow(counted, df.schema)
    got = {r.feature: r for r in Q.metrics_table(once, ["a", "b", "c"], "y").collect()}
    with open(log) as f:
        assert sum(map(int, f)) == 900
    for c in "abc":
        assert got[c].target_correlation == pytest.approx(pdf[c].rank().corr(pdf.y.rank()))


def test_ranked_pairs_of_ties_nulls_and_partitions(spark):
    rows = [("x" if i % 50 == 0 else None, float(i % 7) if i % 5 else None, 1.0, float(i % 4)) for i in range(3000)]
    rows += [("x", float("nan"), -0.0 if i % 2 else 0.0, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "t string, a double, b double, y double").repartition(5)
    got = Q.ranked_pairs(df, ["a", "b"], "y").groupBy("feature", "below", "ties", "total").agg(F.sum("n").alias("n")).orderBy("feature", "below").collect()
    pdf = df.toPandas()
    for c in "ab":
        have = [(r.below, r.ties, r.n) for r in got if r.feature == c]
        kept = [r[1 if c == "a" else 2] for r in rows if r[1 if c == "a" else 2] is not None]
        counts = sorted({"nan" if v != v else v + 0.0 for v in kept}, key=lambda v: (v == "nan", 0 if v == "nan" else v))
        size = [sum((v != v) if u == "nan" else v == u for v in kept) for u in counts]
        assert have == [(sum(size[:i]), s, s) for i, s in enumerate(size)]
        assert {r.total for r in got if r.feature == c} == {len(kept)}
    assert len(pdf) == 3030
    assert Q.ranked_pairs(df.limit(0), ["a"], "y").count() == 0


def test_values_of_all_runs_reach_the_rows_of_the_bijection(spark, monkeypatch):
    """Blocks of 64 rows and pieces of 100, with nulls and NaNs; every row scores the value that it is given."""
    monkeypatch.setattr(Q, "BLOCK", 64)
    monkeypatch.setattr(Q, "DEALT", 100)
    monkeypatch.setattr(Q, "RANKED", 150)
    n, seen = 777, []
    x = [None if i % 50 == 3 else float("nan") if i % 50 == 4 else i / n for i in range(n)]
    df = spark.createDataFrame([(i, x[i], i * 31 % 97 / 97, i % 3 % 2) for i in range(n)], "id long, a double, b double, y int").repartition(5)

    def model(rows):
        seen.append(rows)
        return F.coalesce(F.nanvl("a", F.lit(2.0)), F.lit(3.0)) / 4

    got = {r.feature: r.importance for r in Q.permutation_importance(model, df, ["a", "b"], ["id"], "y", "auc", repeats=2, seed=9).collect()}
    rows = {(r._run, r.id): r for r in next(d for d in seen if "_r" in d.columns).collect()}
    assert len(rows) == 4 * n
    p = lambda v: (3.0 if v is None else 2.0 if v != v else v) / 4      # noqa: E731

    def area(a):
        up, down = ([p(v) for i, v in enumerate(a) if (i % 3 % 2 == 1) == side] for side in (True, False))
        return sum((u > d) + (u == d) / 2 for u in up for d in down) / len(up) / len(down)

    drops = []
    for k in range(2):
        to = Q.shuffled_places(np.arange(n), n, Q.shuffle_keys(9, f"a:{k}", n))
        after = [None] * n
        for i in range(n):
            after[to[i]] = x[i]
        assert [str(rows[k, i].a) for i in range(n)] == [str(v) for v in after]
        drops.append(area(x) - area(after))
    assert got["a"] == pytest.approx(np.mean(drops)) and got["b"] == 0


def test_permuted_values_move_packed(spark, tmp_path):
    """One exchange of a row per piece and block, not of a row per run and row, and no exchange of scores a row each."""
    import json
    rows = [(i, (i * 37 % 101) / 101, (i * 53 % 97) / 97) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("y", (F.col("a") > 0.5).cast("int"))
    plan = Q.permutation_importance(lambda d: F.col("a") + F.col("b") / 7, df, ["a", "b"], ["id"], "y", "auc", repeats=3)._jdf.queryExecution()
    plan.executedPlan().execute().count()
    text = plan.executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in text and "data#" in text
    assert "hashpartitioning(_at" not in text and "hashpartitioning(run_id" in text and "prob#" not in "".join(
        line for line in text.splitlines() if "hashpartitioning" in line)


@pytest.mark.parametrize("block", [40, 700, 100_000])
def test_rare_classes_and_ties_across_blocks(spark, block, monkeypatch):
    """Blocks smaller than a cell's ties; a class of three rows far apart, one of two, ties of several classes."""
    from tickloom.operators import information as I
    monkeypatch.setattr(I, "CELL", 16)
    r = np.random.default_rng(8)
    n = 4000
    y = np.where(np.arange(n) % 1000 == 7, "rare", np.where(np.arange(n) % 1999 == 5, "two", r.choice(["u", "v", "w"], n)))
    cols = {"a": np.round(r.normal(size=n) + (y == "u"), 2), "b": r.normal(size=n), "c": r.integers(0, 3, n).astype(float)}
    df = spark.createDataFrame([(str(y[i]), *(float(v[i]) for v in cols.values())) for i in range(n)], "y string, a double, b double, c double").repartition(5)
    got = {x.feature: x.mutual_information for x in neighbour_information(df, list(cols), "y", block=block).collect()}
    for name, x in cols.items():
        assert got[name] == pytest.approx(brute(x, y), abs=1e-7)


def test_only_values_at_the_edges_of_blocks_are_counted_across(spark, monkeypatch):
    """Running totals, which sort their rows once more, got every value and two questions for each."""
    from tickloom.operators import information as I
    counted = []
    plain = I.running_totals
    monkeypatch.setattr(I, "running_totals", lambda df, *a, **b: (counted.append(df.count()), plain(df, *a, **b))[1])
    r = np.random.default_rng(4)
    y = r.integers(0, 2, 20_000)
    df = spark.createDataFrame([(int(v), float(x)) for v, x in zip(y, y + r.normal(size=len(y)))], "y int, a double")
    got = neighbour_information(df, ["a"], "y").first()
    assert sum(counted) < 2000 and got.mutual_information > 0.05


def test_rank_correlation_moves_ranks_once(spark, monkeypatch):
    """Ties, nulls, NaN and many different y, over partitions; ranks were moved by y, moved again in order and stored."""
    import pandas as pd
    monkeypatch.setattr(Q, "running_totals", lambda *a, **b: pytest.fail("rows in the order of y are stored"))
    r = np.random.default_rng(11)
    n = 5000
    pdf = pd.DataFrame({"a": np.round(r.normal(size=n), 1), "b": r.normal(size=n), "c": np.where(r.random(n) < 0.9, 0.0, r.normal(size=n))})
    pdf["y"] = pdf.b + r.normal(size=n)
    pdf["z"] = (pdf.a > 0) * 1.0
    pdf.loc[r.random(n) < 0.1, "a"] = None
    pdf.loc[r.random(n) < 0.1, "y"] = None
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in row) for row in pdf.itertuples(index=False)],
                               "a double, b double, c double, y double, z double").repartition(6)
    for target in ("y", "z"):
        got = {x.feature: (x.n, x.correlation) for x in Q.rank_correlation(df, ["a", "b", "c"], target).collect()}
        for c in "abc":
            kept = pdf[[c, target]].dropna()
            assert got[c] == (len(kept), pytest.approx(kept[c].rank().corr(kept[target].rank()), abs=1e-12))
    nan = spark.createDataFrame([(float(i % 7), float("nan") if i % 5 == 0 else float(i)) for i in range(100)], "a double, y double")
    top = pd.Series([1e9 if i % 5 == 0 else float(i) for i in range(100)])
    want = pd.Series([i % 7 for i in range(100)]).rank().corr(top.rank())
    assert Q.rank_correlation(nan, ["a"], "y").first().correlation == pytest.approx(want, abs=1e-12)
    assert Q.rank_correlation(df.limit(0), ["a"], "y").count() == 0


def test_rows_in_order_keep_their_positions(spark, tmp_path):
    """Keys dealt out by range: the windows need no other exchange, and positions are those of a sort by key and day."""
    import datetime as dt

    from catalog.quality import COLS, fixed_logit, rows
    lines = [(i, i % 11, None if i % 13 == 0 else i % 7, i % 4, 1.0 + i % 5, 900.0 + i * 37 % 1000, i % 3 / 100, i % 2 / 100, "R", "F",
              dt.datetime(1998, 1, 1) + dt.timedelta(i // 8)) for i in range(2000)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    plain, ordered = rows(spark, str(tmp_path)), rows(spark, str(tmp_path), in_order=True)
    assert [tuple(r) for r in ordered.collect()] == [tuple(r) for r in plain.orderBy("key", "ts").collect()]
    assert "hashpartitioning(key" in plain._jdf.queryExecution().executedPlan().toString()
    assert ordered._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 2
    want, got = ({r.feature: r.importance for r in Q.permutation_importance(fixed_logit, d, COLS, ["key", "ts"], "y", "precision", 2, in_order=o).collect()}
                 for d, o in ((plain, False), (ordered, True)))
    assert want == pytest.approx(got, abs=1e-12) and any(want.values())
