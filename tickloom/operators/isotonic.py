"""Isotonic calibration per run, for runs of any size.

The fit of a run is the slope of the greatest convex minorant of its cumulative sums:
with the distinct scores in order, W counts rows and S labels up to a score.  For any
level t the scores fitted below t are those before the least S - t W, which is a plain
aggregate; so a run is split exactly, without pooling anything, into pieces whose fitted
values share their first base-16 digits.  Pieces are split digit by digit, all runs at
once, until each has at most `most` scores or is one level as a whole (its minorant is
a straight line); then violators are pooled inside each piece, pieces side by side.

Labels are 0 or 1, so all sums and comparisons are whole numbers and exact.  Rows with a
null or NaN score, a null label or a null run do not take part in the fit; a null or NaN
score is calibrated to null, and so is every score of a run that has no fit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.totals import running_totals
from tickloom.sources.tables import stored

RUN, PROB, LABEL = "run_id", "prob", "label"
#: Distinct scores that one task pools.
MOST = 100_000
DIGITS, BASE = 15, 16
WHOLE = "decimal(38,0)"


def _points(pred: DataFrame) -> DataFrame:
    """One row per distinct score of a run: rows n and labels pos there, rows w and
    labels s before it, and the piece that it is in."""
    known = pred.filter(F.col(RUN).isNotNull() & F.col(PROB).isNotNull() & ~F.isnan(F.col(PROB).cast("double")) & F.col(LABEL).isNotNull())
    folded = known.groupBy(RUN, F.col(PROB).cast("double").alias(PROB)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(LABEL).cast("long")).alias("pos"))
    return running_totals(folded, [RUN], [F.col(PROB)], {"w": F.col("n"), "s": F.col("pos")}).withColumns(
        {"piece": F.lit(0).cast("long"), "level": F.lit(False)})


def _split(points: DataFrame, large: DataFrame, digit: int) -> DataFrame:
    """The points of the large pieces with one more digit of their fitted value; pieces
    that are one level as a whole are marked."""
    scale = BASE ** (digit + 1)
    rows = points.join(large, [RUN, "piece"])
    end_w, end_s = (F.col("w") + F.col("n")).cast(WHOLE), (F.col("s") + F.col("pos")).cast(WHOLE)

    def height(j: int, w: Column, s: Column) -> Column:
        return F.lit(str(scale)).cast(WHOLE) * s - (F.col("piece").cast(WHOLE) * BASE + j) * w

    # the least height over the points of a piece, its first point included
    lows = [F.min(F.struct(height(j, end_w, end_s).alias("h"), (F.col("w") + F.col("n")).alias("at"))).alias(f"low_{j}")
            for j in range(1, BASE)]
    span_w, span_s = F.col("w1") - F.col("w0"), F.col("s1") - F.col("s0")
    dip = F.min(span_w.cast(WHOLE) * (end_s - F.col("s0")) - span_s.cast(WHOLE) * (end_w - F.col("w0")))
    found = rows.groupBy(RUN, "piece", "w0", "s0").agg(*lows, dip.alias("dip"))
    cuts = [F.when(height(j, F.col("w0").cast(WHOLE), F.col("s0").cast(WHOLE)) <= F.col(f"low_{j}.h"), F.col("w0"))
            .otherwise(F.col(f"low_{j}.at")) for j in range(1, BASE)]
    found = found.select(RUN, "piece", (F.col("dip") >= 0).alias("flat"), F.array(*cuts).alias("cuts"))
    place = F.size(F.filter("cuts", lambda c: c <= F.col("w")))
    return points.join(found, [RUN, "piece"], "left").withColumns({
        "level": F.col("level") | F.coalesce("flat", F.lit(False)),
        "piece": F.when(F.col("level") | F.col("flat"), F.col("piece")).otherwise(
            F.col("piece") * BASE + F.coalesce(place, F.lit(0)))}).drop("flat", "cuts")


def _pool(table: pa.Table) -> pa.Table:
    """The blocks of one piece: adjacent violators pooled, from left to right."""
    table = table.sort_by("w")
    run, probs = table.column(RUN)[0], table.column(PROB).to_pylist()
    blocks: list[list] = []
    for i, (n, pos) in enumerate(zip(table.column("n").to_pylist(), table.column("pos").to_pylist())):
        blocks.append([i, i, n, pos])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return pa.table({
        RUN: pa.array([run.as_py()] * len(blocks), run.type), "low": [probs[b[0]] for b in blocks], "high": [probs[b[1]] for b in blocks],
        "n": pa.array([b[2] for b in blocks], pa.int64()), "value": [b[3] / b[2] for b in blocks]})


def isotonic_fit(pred: DataFrame, most: int = MOST) -> DataFrame:
    """Blocks of each run: ``low`` and ``high`` score, ``n`` rows, fitted ``value``."""
    points = stored(_points(pred))
    for digit in range(DIGITS + 1):
        sizes = points.filter(~F.col("level")).groupBy(RUN, "piece").agg(
            F.count(F.lit(1)).alias("scores"), F.min("w").alias("w0"), F.max(F.col("w") + F.col("n")).alias("w1"),
            F.min("s").alias("s0"), F.max(F.col("s") + F.col("pos")).alias("s1"))
        large = stored(sizes.filter(F.col("scores") > most).drop("scores"))
        if large.isEmpty():
            break
        if digit == DIGITS:
            # equal to the last of 60 binary digits
            points = points.join(large.select(RUN, "piece", F.lit(True).alias("same")), [RUN, "piece"], "left") \
                .withColumn("level", F.col("level") | F.coalesce("same", F.lit(False))).drop("same")
            break
        points = stored(_split(points, large, digit))
    schema = f"{RUN} {points.schema[RUN].dataType.simpleString()}, low double, high double, n long, value double"
    pooled = points.filter(~F.col("level")).select(RUN, "piece", PROB, "n", "pos", "w").groupBy(RUN, "piece").applyInArrow(_pool, schema)
    levels = points.filter("level").groupBy(RUN, "piece").agg(
        F.min(PROB).alias("low"), F.max(PROB).alias("high"), F.sum("n").alias("n"),
        (F.sum("pos").cast("double") / F.sum("n").cast("double")).alias("value")).drop("piece")
    return pooled.unionByName(levels)


def isotonic_apply(blocks: DataFrame, pred: DataFrame) -> DataFrame:
    """pred with ``calibrated``: the value of the block that holds the score, between two
    blocks the straight line between their ends, beyond the first and last their value.

    Scores and block ends are ranked in one order; a score's place tells the ends on
    both sides, so nothing is searched and no run is held by one task."""
    ends = blocks.select(RUN, F.explode(F.array(
        F.struct(F.col("low").alias("x"), "value", F.lit(0).alias("side")),
        F.struct(F.col("high").alias("x"), "value", F.lit(1).alias("side")))).alias("e")).select(RUN, "e.*")
    rows = pred.drop("calibrated").withColumn("__id", F.monotonically_increasing_id())
    names = rows.columns
    # a low end stands before equal scores, a high end after them
    marked = rows.withColumns({"__x": F.when(~F.isnan(F.col(PROB).cast("double")), F.col(PROB).cast("double")),
                               "__kind": F.lit(1), "__value": F.lit(None).cast("double")})
    knots = ends.select(RUN, F.col("x").alias("__x"), (F.col("side") * 2).alias("__kind"), F.col("value").alias("__value"))
    both = stored(running_totals(
        marked.unionByName(knots, allowMissingColumns=True), [RUN], [F.col("__x"), F.col("__kind"), F.col("__id")],
        {"__at": (F.col("__kind") != 1).cast("long")}))
    knots = both.filter("__kind <> 1")
    left = knots.select(RUN, (F.col("__at") + 1).alias("__at"), F.struct(F.col("__x").alias("x"), F.col("__value").alias("v")).alias("__l"))
    right = knots.select(RUN, "__at", F.struct(F.col("__x").alias("x"), F.col("__value").alias("v")).alias("__r"))
    out = both.filter("__kind = 1").join(left, [RUN, "__at"], "left").join(right, [RUN, "__at"], "left")
    width = F.col("__r.x") - F.col("__l.x")
    between = F.col("__l.v") + (F.col("__r.v") - F.col("__l.v")) * (F.col("__x") - F.col("__l.x")) / F.when(width > 0, width)
    value = F.when(F.col("__x").isNull(), F.lit(None)).when(F.col("__l.v") == F.col("__r.v"), F.col("__l.v")).otherwise(
        F.coalesce(between, F.col("__l.v"), F.col("__r.v")))
    return out.select(*[c for c in names if c != "__id"], value.alias("calibrated"))


def isotonic(pred: DataFrame, most: int = MOST) -> DataFrame:
    """pred with ``calibrated``, each run fitted on its own rows."""
    return isotonic_apply(isotonic_fit(pred, most), pred)
