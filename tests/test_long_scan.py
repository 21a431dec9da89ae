"""Chunked recursions against the pass per key, and running totals against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.long_scan import scan_long
from tickloom.functions.recursive import scan
from tickloom.functions.totals import running_totals
from tickloom.plans.features import feature_table

STEPS = [
    ("e1", "ema", ("x",), {"n": 12}), ("e2", "ema", ("e1",), {"n": 12}), ("e3", "ema", ("e2",), {"n": 12}),
    ("ea", "ema", ("x",), {"n": 5, "at": 21}), ("en", "ema", ("xn",), {"n": 20}), ("w", "wilder", ("xn",), {"n": 14}), ("ew", "ewm", ("xn",), {"span": 9}),
    ("ewp", "ewm", ("xn",), {"span": 9, "min_periods": 7}), ("ds", "decayed_sum", ("tr",), {"n": 14}),
    ("adx", "directional_index", ("pl", "mi", "tr"), {"n": 14}), ("ka", "adaptive", ("x",), {"n": 10}),
    ("co", "compound", ("r",), {"start": 100.0}), ("df", "difference", ("e1", "w"), {}), ("ed", "ewm", ("df",), {"span": 5})]


def series(key, n, lead=0, holes=0.0, seed=2):
    rng = np.random.default_rng(seed)
    x = 100 + np.cumsum(rng.normal(0, 1, n))
    xn = x.copy()
    xn[:lead] = np.nan
    xn[rng.random(n) < holes] = np.nan
    pl, mi, tr = np.maximum(rng.normal(0, 1, n), 0), np.maximum(rng.normal(0, 1, n), 0), rng.random(n)
    still = rng.random(n) < 0.1
    pl[still] = mi[still] = 0
    for a in (pl, mi, tr):
        a[0] = np.nan
    return pd.DataFrame({"key": key, "ts": np.arange(n), "x": x, "xn": xn, "pl": pl, "mi": mi, "tr": tr, "r": rng.normal(0, 0.01, n)})


def same(a, b, names):
    a, b = (t.sort_values(["key", "ts"]).reset_index(drop=True) for t in (a, b))
    assert len(a) == len(b)
    for n in names:
        u, v = a[n].to_numpy(float), b[n].to_numpy(float)
        assert (np.isnan(u) == np.isnan(v)).all(), n
        assert np.allclose(u, v, rtol=1e-9, atol=1e-9, equal_nan=True), n


@pytest.mark.parametrize("chunk", [31, 100, 5000])
def test_chunks_equal_the_pass_per_key(spark, chunk):
    pdf = pd.concat([series("a", 1000, 0, 0.05), series("b", 777, 130, 0.02), series("c", 3), series("d", 205, 99),
                     series("e", 400, 399), series("f", 60, 60)])
    df = spark.createDataFrame(pdf)
    same(scan(df, STEPS).toPandas(), scan_long(df, STEPS, chunk=chunk).toPandas(), [s[0] for s in STEPS])


def test_a_million_rows_of_one_key(spark):
    """20 chunks, each a group of its own."""
    pdf = series("hot", 1_000_000, 0, 0.01)[["key", "ts", "x", "xn"]]
    df = spark.createDataFrame(pdf).repartition(8)
    steps = [s for s in STEPS if s[0] in ("e1", "e2", "en", "w", "ka")]
    got = scan_long(df, steps).select("key", "ts", *[s[0] for s in steps]).toPandas()
    from tickloom.functions.recursive import KERNELS
    have = {"x": pdf.x.to_numpy(), "xn": pdf.xn.to_numpy()}
    for name, kernel, inputs, params in steps:
        have[name] = KERNELS[kernel](*[have[i] for i in inputs], **params)
    same(pd.DataFrame({"key": "hot", "ts": pdf.ts, **{s[0]: have[s[0]] for s in steps}}), got, [s[0] for s in steps])


def test_small_and_refused(spark):
    df = spark.createDataFrame(series("a", 40))
    assert scan_long(df.limit(0), STEPS, chunk=50).count() == 0
    with pytest.raises(ValueError, match="no composable map"):
        scan_long(df, [("s", "stop_line", ("x", "x", "x"), {"at": 3})])
    with pytest.raises(ValueError, match="a chunk needs"):
        scan_long(df, STEPS, chunk=20)


def test_features_in_chunks(spark, make_bars, walk):
    bars = make_bars(walk, "A").unionByName(make_bars(walk[:90], "B"))
    names = ["macd_line", "atr_14", "adx_14", "rsi_daily", "dema_9"]
    same(feature_table(bars, names, warm_up="keep").toPandas(), feature_table(bars, names, warm_up="keep", chunk_rows=64).toPandas(), names)


def test_running_totals_of_hot_and_null_groups(spark):
    rng = np.random.default_rng(1)
    n = 20_000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 300, n).astype(str)),
                        "x": rng.integers(0, 1000, n), "i": np.arange(n), "n": rng.integers(0, 9, n)})
    pdf.loc[rng.random(n) < 0.02, "g"] = None
    df = spark.createDataFrame(pdf)
    got = running_totals(df, ["g"], [F.col("x").desc(), F.col("i")], {"at": F.lit(1), "s": F.col("n")}, 13).toPandas()
    want = pdf.sort_values(["x", "i"], ascending=[False, True])
    want["g"] = want.g.fillna("null")
    want["at"], want["s"] = want.groupby("g").cumcount(), want.groupby("g").n.cumsum() - want.n
    a, b = want.sort_values("i"), got.sort_values("i")
    assert a["at"].tolist() == b["at"].tolist() and a["s"].tolist() == b["s"].tolist()
    whole = running_totals(df, [], [F.col("i")], {"at": F.lit(1)}, 5).toPandas()
    assert (whole["at"] == whole["i"]).all()
    assert running_totals(df.limit(0), ["g"], [F.col("i")], {"at": F.lit(1)}).count() == 0


def test_rounds_store_a_row_per_chunk(spark, monkeypatch):
    """Every round stored all rows with all columns again."""
    from tickloom.functions import long_scan
    plain, kept = long_scan.stored, []
    monkeypatch.setattr(long_scan, "stored", lambda df: kept.append(plain(df)) or kept[-1])
    df = spark.createDataFrame(pd.concat([series("a", 1000, 0, 0.05), series(None, 300)]))
    got = scan_long(df, STEPS, chunk=100)
    assert got.count() == 1300 and len(kept) >= 3
    assert all(k.columns == ["key", "__chunk", "start"] and k.count() == 13 for k in kept)
