"""Evaluation of prediction tables ``(run_id, prob, label)``.

Every metric is grouped by ``run_id``.  A run may hold any share of the rows:
counts, sums and moments combine map-side, and whatever needs an order works on
distinct scores through a two-step digit split of the score, so no window or
task ever holds a whole run."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.isotonic import isotonic  # noqa: F401  (part of the calibration interface)
from tickloom.sources.tables import stored

RUN, PROB, LABEL = "run_id", "prob", "label"
EPS = 1e-7
SWEEP = tuple(round(0.10 + 0.05 * i, 2) for i in range(17))
GRID = 1 << 16


def _div(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))


def _confusion(threshold, strict: bool = False) -> dict[str, Column]:
    hit = F.col(PROB) > threshold if strict else F.col(PROB) >= threshold
    pos = F.col(LABEL) == 1
    return {"tp": F.count_if(hit & pos), "fp": F.count_if(hit & ~pos),
            "fn": F.count_if(~hit & pos), "tn": F.count_if(~hit & ~pos)}


def confusion(pred: DataFrame, threshold: float = 0.5, by: str = RUN) -> DataFrame:
    return pred.groupBy(by).agg(*[c.alias(n) for n, c in _confusion(F.lit(threshold)).items()])


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from tp, fp, fn, tn; empty -> 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    df = counts.withColumns({
        "accuracy": _div(tp + tn, tp + fp + fn + tn),
        "precision": _div(tp, tp + fp), "recall": _div(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", _div(2 * p * r, p + r))


def threshold_sweep(pred: DataFrame, thresholds=SWEEP) -> DataFrame:
    """Counts and rates per run and threshold.

    One pass: each threshold is a set of aggregates, unpivoted afterwards, so
    the prediction rows are not multiplied by the number of thresholds."""
    rows = pred.groupBy(RUN).agg(*[
        F.struct(F.lit(float(t)).alias("threshold"),
                 *[c.alias(n) for n, c in _confusion(F.lit(float(t))).items()]).alias(f"t{i}")
        for i, t in enumerate(thresholds)])
    out = rows.select(RUN, F.inline(F.array(*[f"t{i}" for i in range(len(thresholds))])))
    return with_rates(out).withColumn("n_positive_preds", F.col("tp") + F.col("fp"))


# --- order statistics without a whole run in one place --------------------------------

def score_counts(pred: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score, with the score's two leading
    base-65536 digits.  Multiplying by a power of two is exact."""
    high = F.floor(F.col(PROB) * GRID)
    return pred.groupBy(RUN, PROB).agg(
        F.sum(F.col(LABEL).cast("long")).alias("pos"),
        F.sum(1 - F.col(LABEL).cast("long")).alias("neg")) \
        .withColumn("_d1", high) \
        .withColumn("_d2", F.floor((F.col(PROB) * GRID - high) * GRID))


def _before(cols: list[str], order: str, descending: bool = False):
    key = F.col(order).desc() if descending else F.col(order)
    return Window.partitionBy(*cols).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)


def _levels(counts: DataFrame):
    """The same counts per score, per second digit and per first digit."""
    mid = counts.groupBy(RUN, "_d1", "_d2").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    top = mid.groupBy(RUN, "_d1").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return [(counts, [RUN, "_d1", "_d2"], PROB), (mid, [RUN, "_d1"], "_d2"), (top, [RUN], "_d1")]


#: Rows whose scores a task packs together.
PACKED = 1 << 20


def _scores_packed(cuts: np.ndarray):
    """Scores, labels and runs, as ``run_id, piece, size, data``: the different scores of a run
    between two cuts, in order, with their positives and negatives.  A score that many rows
    share is one entry, so one that holds most rows meets no single task."""
    def told(rows: pa.Table):
        code = pc.dictionary_encode(rows.column(0).combine_chunks(), null_encoding="encode")
        prob, label = rows.column(1).to_numpy() + 0.0, rows.column(2)
        bits = np.where(np.isnan(prob), np.nan, prob).view(np.int64)
        key = np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits)
        key[rows.column(1).is_null().to_numpy()] = np.iinfo(np.int64).min
        known, pos = label.is_valid().to_numpy(), pc.fill_null(label, 0).to_numpy()
        run = code.indices.to_numpy()
        order = np.lexsort((key, run))
        run, key, pos, neg = run[order], key[order], pos[order], (known * 1 - pos)[order]
        piece = np.searchsorted(cuts, key, "right")
        new = np.r_[True, (run[1:] != run[:-1]) | (key[1:] != key[:-1])]
        starts = np.flatnonzero(new)
        run, key, piece = run[starts], key[starts], piece[starts]
        pos, neg = np.add.reduceat(pos, starts), np.add.reduceat(neg, starts)
        edges = np.r_[0, np.flatnonzero((run[1:] != run[:-1]) | (piece[1:] != piece[:-1])) + 1, len(run)]
        data, head = [], edges[:-1]
        for a, b in zip(edges[:-1], edges[1:]):
            cells = np.concatenate((key[a:a + 1], np.diff(key[a:b]), pos[a:b], neg[a:b])).astype(np.int64)
            data.append(pa.compress(cells.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(run[head])), pa.array(piece[head].astype(np.int64)),
                                           pa.array(np.diff(edges).astype(np.int64)), pa.array(data, pa.binary())], names=[RUN, "piece", "size", "data"])

    def run(batches):
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                yield told(pa.Table.from_batches(held))
                held = []
        if held:
            yield told(pa.Table.from_batches(held))

    return run


def _won(table: pa.Table) -> pa.Table:
    """Of a run's scores between two cuts: positives, negatives, and pairs won among them."""
    cells = []
    for data, size in zip(table.column("data").to_pylist(), table.column("size").to_pylist()):
        got = pa.decompress(data, decompressed_size=24 * size, codec="zstd", asbytes=True)
        got = np.ascontiguousarray(np.frombuffer(got, np.uint8).reshape(8, 3 * size).T).view(np.int64).reshape(3, size)
        cells.append(np.stack((np.cumsum(got[0]), got[1], got[2])))
    key, pos, neg = np.concatenate(cells, axis=1)
    order = np.argsort(key, kind="stable")
    key, pos, neg = key[order], pos[order], neg[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    pos, neg = np.add.reduceat(pos, starts), np.add.reduceat(neg, starts)
    won = float((pos * (np.cumsum(neg) - neg + 0.5 * neg)).sum())
    return table.slice(0, 1).select([RUN, "piece"]).append_column("pos", pa.array([int(pos.sum())])).append_column(
        "neg", pa.array([int(neg.sum())])).append_column("won", pa.array([won]))


def _auc_in_pieces(pred: DataFrame, cuts: list[float]) -> DataFrame:
    """Pairs are counted between the pieces of a run and inside each one."""
    bits = (np.array(sorted({*cuts}), float) + 0.0).view(np.int64)
    kind = pred.schema[RUN].dataType.simpleString()
    rows = pred.select(RUN, F.col(PROB).cast("double"), F.col(LABEL).cast("long"))
    packed = rows.mapInArrow(_scores_packed(np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits)), f"{RUN} {kind}, piece long, size long, data binary")
    parts = packed.groupBy(RUN, "piece").applyInArrow(_won, f"{RUN} {kind}, piece long, pos long, neg long, won double")
    below = F.coalesce(F.sum("neg").over(_before([RUN], "piece")), F.lit(0))      # a row per run and piece
    return parts.select(RUN, "pos", "neg", (F.col("won") + F.col("pos").cast("double") * below).alias("won"))


def roc_auc(pred: DataFrame, cuts: list[float] | None = None) -> DataFrame:
    """Exact tie-aware area under the ROC curve; null for a one-class run.

    Pairs (positive above negative) are counted once at the level where the two
    scores part: first digit, second digit, or score.  `cuts`, for runs of many different
    scores, are scores that part the rows of a run into pieces that a task can hold; the
    scores then move once, packed.  The result is the same whatever they are."""
    if cuts is not None:
        return _area(_auc_in_pieces(pred, cuts))
    parts = []
    for i, (df, group, order) in enumerate(_levels(score_counts(pred))):
        below = F.coalesce(F.sum("neg").over(_before(group, order)), F.lit(0))
        ties = 0.5 * F.col("neg") if i == 0 else F.lit(0.0)
        won = F.col("pos") * (below + ties)
        mine = F.col("pos") if i == 0 else F.lit(0)
        theirs = F.col("neg") if i == 0 else F.lit(0)
        parts.append(df.select(RUN, won.cast("double").alias("won"), mine.cast("long").alias("pos"),
                               theirs.cast("long").alias("neg")))
    return _area(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _area(rows: DataFrame) -> DataFrame:
    s = rows.groupBy(RUN).agg(F.sum("won").alias("won"), F.sum("pos").alias("n_pos"),
                              F.sum("neg").alias("n_neg"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return s.select(RUN, "n_pos", "n_neg",
                    F.when(pairs > 0, F.col("won") / F.when(pairs > 0, pairs)).alias("auc"))


def cumulative_counts(pred: DataFrame) -> DataFrame:
    """Per distinct score: positives (tp) and negatives (fp) at or above it, and
    the run's totals."""
    counts = score_counts(pred)
    (_, _, _), (mid, _, _), (top, _, _) = _levels(counts)

    def add_above(df, group, order, name):
        w = _before(group, order, descending=True)
        return df.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{name}")
                                for c in ("pos", "neg")])
    whole = Window.partitionBy(RUN)
    t = add_above(top, [RUN], "_d1", "t").select(
        RUN, "_d1", "pos_t", "neg_t", F.sum("pos").over(whole).alias("n_pos"),
        F.sum("neg").over(whole).alias("n_neg"))
    m = add_above(mid, [RUN, "_d1"], "_d2", "m").select(RUN, "_d1", "_d2", "pos_m", "neg_m")
    s = add_above(counts, [RUN, "_d1", "_d2"], PROB, "s")
    df = s.join(m, [RUN, "_d1", "_d2"]).join(t, [RUN, "_d1"])
    return df.select(
        RUN, PROB, "pos", "neg", "n_pos", "n_neg",
        (F.col("pos_t") + F.col("pos_m") + F.col("pos_s") + F.col("pos")).alias("tp"),
        (F.col("neg_t") + F.col("neg_m") + F.col("neg_s") + F.col("neg")).alias("fp"))


def precision_recall(pred: DataFrame) -> DataFrame:
    """One point per distinct score, from the cumulative counts."""
    c = cumulative_counts(pred)
    return c.filter("n_pos > 0").withColumns({
        "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
        "recall": F.col("tp") / F.col("n_pos")})


def precision_recall_summary(pred: DataFrame, levels=(0.1, 0.2, 0.3, 0.4, 0.5)) -> DataFrame:
    """Trapezoid area (positive) and precision at the recall nearest to each level.

    The curve ends in the point (precision 1, recall 0).  A point's neighbour
    above follows from its own counts, so no row needs the next one.  Of equally
    near recalls the lowest score counts."""
    c = precision_recall(pred)
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    p0 = F.when(tp0 + fp0 > 0, tp0 / F.when(tp0 + fp0 > 0, tp0 + fp0)).otherwise(1.0)
    area = (F.col("recall") - tp0 / F.col("n_pos")) * (F.col("precision") + p0) / 2
    aggs = [F.sum(area).alias("auc_pr")]
    for r in levels:
        near = F.struct(F.abs(F.col("recall") - r).alias("d"), F.col(PROB))
        best = F.min_by(F.struct("precision", "recall", F.abs(F.col("recall") - r).alias("d")), near)
        aggs.append(best.alias(f"_b{int(r * 100)}"))
    out = c.groupBy(RUN).agg(*aggs)
    for r in levels:
        n = int(r * 100)
        b = F.col(f"_b{n}")
        end = b["d"] > r          # the end point (1, 0) is strictly nearer
        out = out.withColumns({
            f"precision_at_recall_{n}": F.when(end, 1.0).otherwise(b["precision"]),
            f"actual_recall_{n}": F.when(end, 0.0).otherwise(b["recall"])}).drop(f"_b{n}")
    return out


def detailed(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, rates, AUC and the range of the predictions."""
    c = pred.groupBy(RUN).agg(
        *[e.alias(n) for n, e in _confusion(F.lit(threshold)).items()],
        F.min(PROB).alias("pred_min"), F.max(PROB).alias("pred_max"),
        F.count(F.lit(1)).alias("n_samples"))
    return with_rates(c).join(roc_auc(pred).select(RUN, "auc"), RUN)


def forecast_metrics(pred: DataFrame, threshold: float = 0.01, classification: bool = False,
                     actual: str = "actual_return") -> DataFrame:
    """Errors of predicted returns (``prob``) and of their sign, with the rates
    of ``prob > threshold`` against the label."""
    cut = 0.5 if classification else threshold
    up = F.col(PROB) > (0.5 if classification else 0.0)
    err = F.col(PROB) - F.col(actual)
    c = pred.groupBy(RUN).agg(
        *[e.alias(n) for n, e in _confusion(F.lit(cut), strict=True).items()],
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.avg((up == (F.col(actual) > 0)).cast("double")).alias("direction_accuracy"))
    return with_rates(c)


def baseline_comparison(scores: DataFrame, auc: str = "auc", baseline: float = 0.718) -> DataFrame:
    a = F.col(auc)
    return scores.withColumns({
        "delta_auc": a - baseline,
        "improvement_pct": (a - baseline) / baseline * 100,
        "meets_threshold": F.coalesce(a >= 0.70, F.lit(False)),
        "beats_baseline": F.coalesce(a > baseline, F.lit(False)),
        "status": F.when(a.isNull(), "FAILED").when(a >= 0.74, "BEAT").when(a >= 0.70, "VIABLE")
        .otherwise("WORSE")})


# --- calibration ---------------------------------------------------------------------

def _bin(n: int) -> Column:
    """Number of inner edges i * (1/n) at or below the score; the last bin is closed."""
    step = 1.0 / n
    return sum((F.when(F.col(PROB) >= i * step, 1).otherwise(0) for i in range(1, n)), F.lit(0))


def _bins(pred: DataFrame, n: int) -> DataFrame:
    return pred.groupBy(RUN, _bin(n).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(LABEL).alias("accuracy"), F.avg(PROB).alias("confidence"))


def calibration_error(pred: DataFrame, n: int = 10) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return _bins(pred, n).groupBy(RUN).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def reliability(pred: DataFrame, n: int = 10) -> DataFrame:
    """One row per run and bin; an empty bin has accuracy 0 and its midpoint."""
    b = _bins(pred, n)
    frame = b.select(RUN).distinct().select(
        RUN, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return frame.join(b, [RUN, "bin"], "left").select(
        RUN, "bin", (F.col("bin") / n).alias("lower"), ((F.col("bin") + 1) / n).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce("confidence", (F.col("bin") + 0.5) / n).alias("confidence"))


def platt(pred: DataFrame, tolerance: float = 1e-9, most_steps: int = 100) -> DataFrame:
    """Logistic regression on the score per run, with unit ridge on the slope.

    Newton steps for all runs at once, one aggregate over the distinct scores each,
    until none moves more than the tolerance; a run of one class ends at an intercept
    of 30 or -30.  A step is at most 5, so no run overshoots."""
    c = score_counts(pred).select(RUN, F.col(PROB).alias("x"), "pos", (F.col("pos") + F.col("neg")).alias("n"))
    state = c.select(RUN).distinct().select(RUN, F.lit(0.0).alias("w"), F.lit(0.0).alias("b"))
    for _ in range(most_steps):
        s = 1 / (1 + F.exp(-(F.col("w") * F.col("x") + F.col("b"))))
        d, v = F.col("n") * s - F.col("pos"), F.col("n") * s * (1 - s)
        sums = c.join(state, RUN).groupBy(RUN, "w", "b").agg(
            (F.sum(d * F.col("x")) + F.col("w")).alias("gw"), F.sum(d).alias("gb"),
            (F.sum(v * F.col("x") * F.col("x")) + 1).alias("hw"), F.sum(v * F.col("x")).alias("hx"),
            F.greatest(F.sum(v), F.lit(1e-12)).alias("hb"))
        det = F.col("hw") * F.col("hb") - F.col("hx") * F.col("hx")
        step_w = (F.col("hb") * F.col("gw") - F.col("hx") * F.col("gb")) / F.when(det > 0, det)
        step_b = (F.col("hw") * F.col("gb") - F.col("hx") * F.col("gw")) / F.when(det > 0, det)
        moved = sums.withColumns({"sw": F.coalesce(step_w, F.lit(0.0)), "sb": F.coalesce(step_b, F.lit(0.0))})
        cut = F.least(F.lit(1.0), 5 / F.greatest(F.abs("sw"), F.abs("sb"), F.lit(1e-12)))
        moved = moved.select(RUN, (F.col("w") - F.col("sw") * cut).alias("w"), F.greatest(F.lit(-30.0), F.least(
            F.lit(30.0), F.col("b") - F.col("sb") * cut)).alias("b"), F.col("w").alias("w0"), F.col("b").alias("b0"))
        moved = stored(moved)
        state = moved.select(RUN, "w", "b")
        far = moved.agg(F.max(F.greatest(F.abs(F.col("w") - F.col("w0")), F.abs(F.col("b") - F.col("b0"))))).first()[0]
        if far is None or far < tolerance:
            break
    z = F.col("_w") * F.col(PROB) + F.col("_b")
    fitted = state.toDF(RUN, "_w", "_b")
    return pred.join(fitted, RUN).withColumn("calibrated", 1 / (1 + F.exp(-z))).select(*pred.columns, "calibrated")


def _logit() -> Column:
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(PROB)))
    return F.ln(p / (1 - p))


def temperature(pred: DataFrame, low: float = 0.01, high: float = 10.0, cuts: int = 32, passes: int = 7) -> DataFrame:
    """Temperature per run that minimises the log loss.

    The loss is convex in b = 1/T, so its slope in b changes sign once.  Each pass
    takes the slope at cuts - 1 points of the bracket in one aggregate over the distinct
    scores and keeps the part where it changes; after the passes the bracket is
    cuts ** -passes of the range (3e-9), on any data.  A slope of one sign ends at the
    bound, so a separable run gets the lowest temperature."""
    c = score_counts(pred).select(RUN, "pos", "neg", _logit().alias("z"))
    least, most = 1 / high, 1 / low
    state = c.select(RUN).distinct().withColumn("lo", F.lit(least)).withColumn("hi", F.lit(most))
    b, z = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("k") / cuts), F.col("z")
    for _ in range(passes):
        slopes = F.sum(((F.col("pos") + F.col("neg")) / (1 + F.exp(-b * z)) - F.col("pos")) * z)
        points = state.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(cuts - 1))))
        part = c.join(points, RUN).groupBy(RUN, "lo", "hi", "k").agg(slopes.alias("g")).groupBy(RUN, "lo", "hi").agg(
            F.count_if(F.col("g") < 0).alias("part"))
        width = (F.col("hi") - F.col("lo")) / cuts
        state = part.select(RUN, (F.col("lo") + width * F.col("part")).alias("lo"),
                            (F.col("lo") + width * (F.col("part") + 1)).alias("hi"))
    near = 1e-6 * most
    best = F.when(F.col("hi") >= most - near, F.lit(most)).when(F.col("lo") <= least + 1e-7, F.lit(least)).otherwise(
        (F.col("lo") + F.col("hi")) / 2)
    return state.select(RUN, (1 / best).alias("temperature"))


def apply_temperature(pred: DataFrame, temps: DataFrame) -> DataFrame:
    z = 1 / (1 + F.exp(-_logit() / F.col("temperature")))
    return pred.join(temps, RUN).withColumn("calibrated", z)


# --- losses as scores of a table --------------------------------------------------------

def _p() -> Column:
    return F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(PROB)))


def _bce() -> Column:
    y = F.col(LABEL)
    return -(y * F.ln(_p()) + (1 - y) * F.ln(1 - _p()))


def bce(pos_weight: float = 1.0) -> Column:
    y = F.col(LABEL)
    return F.avg(-(pos_weight * y * F.ln(_p()) + (1 - y) * F.ln(1 - _p())))


def smoothed_bce(epsilon: float = 0.1) -> Column:
    if not 0 <= epsilon <= 1:
        raise ValueError("epsilon must lie in [0, 1]")
    y = F.col(LABEL) * (1 - epsilon) + (1 - F.col(LABEL)) * epsilon
    return F.avg(-(y * F.ln(_p()) + (1 - y) * F.ln(1 - _p())))


def focal(gamma: float = 2.0, alpha: float = 0.25) -> Column:
    pos = F.col(LABEL) == 1
    pt = F.when(pos, _p()).otherwise(1 - _p())
    weight = F.when(pos, alpha).otherwise(1 - alpha)
    return F.avg(-weight * F.pow(1 - pt, F.lit(gamma)) * F.ln(pt))


def mild_focal(gamma: float = 0.75, alpha: float = 0.5) -> Column:
    return focal(gamma, alpha)


def asymmetric_focal(gamma_pos: float = 1.0, gamma_neg: float = 2.0, alpha: float = 0.5) -> Column:
    pos = -alpha * F.pow(1 - _p(), F.lit(gamma_pos)) * F.ln(_p())
    neg = -(1 - alpha) * F.pow(_p(), F.lit(gamma_neg)) * F.ln(1 - _p())
    return F.avg(F.when(F.col(LABEL) == 1, pos).otherwise(neg))


def entropy_bce(weight: float = 0.1) -> Column:
    h = -(_p() * F.ln(_p()) + (1 - _p()) * F.ln(1 - _p()))
    return F.avg(_bce() - weight * h)


def variance_bce(weight: float = 0.5) -> Column:
    return F.avg(_bce()) - weight * F.coalesce(F.var_samp(PROB), F.lit(0.0))


def losses(pred: DataFrame, **named: Column) -> DataFrame:
    """Any of the scores above, all in one pass."""
    return pred.groupBy(RUN).agg(*[c.alias(n) for n, c in named.items()])


def _sigmoid_series(gamma: float, cells: int, degree: int) -> list[list[float]]:
    """Per cell offset, weights w[j*(degree+1)+i] of (neg^j * pos^i) in a polynomial
    for sigmoid(gamma * (neg - pos)); neg and pos count from their cell centres."""
    width = 1.0 / cells
    out = []
    for off in range(-(cells - 1), cells):
        poly = np.polynomial.Chebyshev.interpolate(
            lambda t: 1 / (1 + np.exp(-gamma * (off * width + t))), degree, domain=[-width, width])
        c = poly.convert(kind=np.polynomial.Polynomial).coef
        c = np.concatenate([c, np.zeros(degree + 1 - len(c))])
        out.append([float(c[i + j] * comb(i + j, j) * (-1) ** i) if i + j <= degree else 0.0
                    for j in range(degree + 1) for i in range(degree + 1)])
    return out


def soft_auc(pred: DataFrame, gamma: float = 2.0, degree: int = 24) -> DataFrame:
    """Mean sigmoid(gamma * (negative - positive)) over all pairs; 0.5 without pairs.

    Scores outside 0..1 count as 0 or 1.  No pair is formed.  The sigmoid of a difference is a polynomial to within
    1e-12 on a cell of width 2/gamma, so the mean follows from power sums per run
    and cell: one aggregate over the rows, then ``cells``^2 products per run."""
    cells = max(1, int(np.ceil(gamma / 2)))
    score = F.greatest(F.least(F.col(PROB), F.lit(1.0)), F.lit(0.0))
    cell = F.least(F.floor(score * cells), F.lit(cells - 1)).cast("int")
    u = score - (cell + 0.5) / cells
    base = pred.select(RUN, cell.alias("cell"), u.alias("u"), F.col(LABEL).alias("y"))

    def moments(side):
        return F.array(*[F.sum(F.when(F.col("y") == side, F.pow("u", F.lit(k)))) for k in range(degree + 1)])
    m = base.groupBy(RUN, "cell").agg(
        moments(0).alias("neg"), moments(1).alias("pos"),
        F.count_if(F.col("y") == 0).alias("n_neg"), F.count_if(F.col("y") == 1).alias("n_pos"))
    neg = m.filter("n_neg > 0").select(RUN, F.col("cell").alias("c0"), "neg", "n_neg")
    pos = m.filter("n_pos > 0").select(RUN, F.col("cell").alias("c1"), "pos", "n_pos")
    table = F.lit(_sigmoid_series(gamma, cells, degree))
    w = F.element_at(table, F.col("c0") - F.col("c1") + cells)
    outer = F.flatten(F.transform("neg", lambda a: F.transform("pos", lambda b: a * b)))
    total = F.aggregate(F.zip_with(outer, w, lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v)
    got = neg.join(pos, RUN).groupBy(RUN).agg(
        (F.sum(total) / F.sum(F.col("n_neg").cast("double") * F.col("n_pos"))).alias("soft_auc"))
    return pred.select(RUN).distinct().join(got, RUN, "left").withColumn(
        "soft_auc", F.coalesce("soft_auc", F.lit(0.5)))


def blended_loss(pred: DataFrame, alpha: float = 0.5, gamma: float = 2.0) -> DataFrame:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    return losses(pred, bce=bce()).join(soft_auc(pred, gamma), RUN).select(
        RUN, (alpha * F.col("bce") + (1 - alpha) * F.col("soft_auc")).alias("blended"))


def separation(pred: DataFrame) -> DataFrame:
    """Class means, their gap, range and spread of the predictions."""
    pos = F.col(LABEL) == 1
    c = pred.groupBy(RUN).agg(
        F.avg(F.when(pos, F.col(PROB))).alias("pos_mean"),
        F.avg(F.when(~pos, F.col(PROB))).alias("neg_mean"),
        (F.max(PROB) - F.min(PROB)).alias("pred_range"), F.stddev_pop(PROB).alias("pred_std"))
    return c.withColumn("class_sep", F.col("pos_mean") - F.col("neg_mean")) \
        .join(roc_auc(pred).select(RUN, F.coalesce("auc", F.lit(0.5)).alias("auc")), RUN)


def ensemble(pred: DataFrame, sample: str = "sample_id") -> DataFrame:
    return pred.groupBy(sample).agg(F.avg(PROB).alias(PROB), F.count(F.lit(1)).alias("n_models"))


def trades(scored_bars: DataFrame, threshold: float = 0.30, gain: float = 0.01) -> DataFrame:
    """Bars whose score reaches the threshold, with the next high and the result.

    ``scored_bars`` holds ``key, ts, close, next_high, prob, label``."""
    return scored_bars.filter((F.col(PROB) >= threshold) & F.col("next_high").isNotNull()).select(
        "key", "ts", PROB, "close", "next_high", (F.col("close") * (1 + gain)).alias("target_price"),
        LABEL, F.when(F.col(LABEL) == 1, "WIN").otherwise("LOSS").alias("result"))


def trade_summary(t: DataFrame) -> DataFrame:
    return t.agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("result") == "WIN").alias("wins"),
                 F.count_if(F.col("result") == "LOSS").alias("losses"))
