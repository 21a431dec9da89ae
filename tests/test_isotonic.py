"""Isotonic calibration per run against pooling in plain Python."""

import numpy as np
import pandas as pd
import pytest

from tickloom.operators.isotonic import isotonic, isotonic_apply, isotonic_fit


def pooled(prob, label):
    """(low, high, rows, value) of the blocks of one run."""
    g = pd.DataFrame({"p": prob, "y": label}).groupby("p").y.agg(["size", "sum"]).reset_index()
    blocks = []
    for p, n, s in g.itertuples(index=False):
        blocks.append([p, p, n, s])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return [(a, b, int(n), int(s) / int(n)) for a, b, n, s in blocks]


def runs(seed, sizes):
    rng = np.random.default_rng(seed)
    out = []
    for k, (n, digits, kind) in enumerate(sizes):
        p = np.round(rng.random(n), digits)
        if kind == "rising":
            y = rng.random(n) < p
        elif kind == "falling":
            y = rng.random(n) < 1 - p
        elif kind == "steps":
            y = p > 0.5
        elif kind == "saw":
            y = rng.random(n) < np.where(p < 0.5, 0.4 + p / 2, p / 2)
        else:
            y = np.full(n, int(kind))
        out.append(pd.DataFrame({"run_id": f"r{k}", "prob": p, "label": y.astype(int)}))
    return out


KINDS = [(10, 1, "rising"), (10, 3, "falling"), (900, 3, "saw"), (1500, 2, "rising"), (700, 3, "steps"), (400, 3, "0"), (400, 3, "1"), (1, 1, "1")]


@pytest.mark.parametrize("most", [3, 60, 100_000])
def test_blocks_of_every_run(spark, most):
    parts = runs(most, KINDS)
    got = isotonic_fit(spark.createDataFrame(pd.concat(parts)), most).toPandas()
    for part in parts:
        own = got[got.run_id == part.run_id.iloc[0]].sort_values("low")
        want = pooled(part.prob, part.label)
        # levels that meet at a cut may come as two blocks of one value
        merged = []
        for low, high, n, value in own[["low", "high", "n", "value"]].itertuples(index=False):
            if merged and merged[-1][3] == value:
                merged[-1] = (merged[-1][0], high, merged[-1][2] + n, value)
            else:
                merged.append((low, high, int(n), value))
        assert [tuple(m) for m in merged] == want


def test_a_million_scores_in_pieces(spark):
    part = runs(4, [(1_000_000, 7, "saw")])[0]
    got = isotonic_fit(spark.createDataFrame(part), 20_000).toPandas().sort_values("low")
    want = pooled(part.prob, part.label)
    assert np.allclose(got.value.to_numpy(), [w[3] for w in want]) and got.n.tolist() == [w[2] for w in want]


def test_applied_between_and_beyond(spark):
    fit = spark.createDataFrame(pd.DataFrame({
        "run_id": ["a"] * 6 + ["b"] * 2, "prob": [0.1, 0.2, 0.4, 0.5, 0.8, 0.9, 0.3, 0.6], "label": [0, 0, 1, 0, 1, 1, 1, 0]}))
    blocks = isotonic_fit(fit)
    new = spark.createDataFrame(
        [("a", x) for x in (0.0, 0.1, 0.3, 0.45, 0.65, 0.8, 2.0, None, float("nan"))] + [("b", 0.5), ("none", 0.5)], "run_id string, prob double")
    got = sorted(((r.run_id, str(r.prob)), r.calibrated) for r in isotonic_apply(blocks, new).collect())
    want = {("a", "0.0"): 0.0, ("a", "0.1"): 0.0, ("a", "0.3"): 0.25, ("a", "0.45"): 0.5, ("a", "0.65"): 0.75, ("a", "0.8"): 1.0,
            ("a", "2.0"): 1.0, ("a", "None"): None, ("a", "nan"): None, ("b", "0.5"): 0.5, ("none", "0.5"): None}
    assert dict(got).keys() == want.keys()
    for k, v in got:
        assert v == (None if want[k] is None else pytest.approx(want[k]))


def test_rows_and_columns_are_kept(spark):
    rows = spark.createDataFrame([("a", 0.5, 1, "x"), ("a", 0.5, 0, "y"), ("a", None, 1, "z"), (None, 0.1, 1, "w"), ("a", 0.2, None, "v")],
                                 "run_id string, prob double, label int, more string")
    got = {r.more: r.calibrated for r in isotonic(rows).collect()}
    assert got == {"x": 0.5, "y": 0.5, "z": None, "w": None, "v": 0.5}
    assert isotonic(rows.limit(0)).count() == 0
