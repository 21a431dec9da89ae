"""Labels, normalisation, splits and training samples of keyed series.

Row positions are counted from 0 inside a key.  A sample starts at a row, reads
``context`` rows and is labelled from the next ``horizon`` rows."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import frames as W
from tickloom.functions.binding import bound
from tickloom.functions.hashing import digest
from tickloom.operators.align import assert_overlap, assert_unique, drop_incomplete, join_one_to_one

PRICE_COLUMNS = ("key", "ts", "open", "high", "low", "close", "volume")
# columns that are never normalised: they already live on a fixed scale
BOUNDED = ("rsi_daily", "rsi_weekly", "stochrsi_daily", "stochrsi_weekly", "adx_14", "bb_percent_b")
_NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)


# --- labels ---------------------------------------------------------------------

def future_max(x, horizon: int) -> Column:
    """Maximum over the next ``horizon`` rows, null when fewer follow."""
    w = W.frame(1, horizon)
    return F.when(F.count(W._col(x)).over(w) == horizon, F.max(W._col(x)).over(w))


def label_name(horizon: int, threshold: float) -> str:
    return f"label_h{horizon}_t{round(threshold * 100)}pct"


def threshold_labels(bars: DataFrame, horizons: Iterable[int] = (1, 2, 3, 5),
                     thresholds: Iterable[float] = (0.01, 0.02, 0.05)) -> DataFrame:
    """``future_max_h{H}`` and ``label_h{H}_t{T}pct`` from later closes; rows
    without a full future are dropped."""
    horizons, thresholds = list(horizons), list(thresholds)
    df = bars.select("key", "ts", "close", *[
        future_max("close", h).alias(f"future_max_h{h}") for h in horizons])
    labels = [(F.col(f"future_max_h{h}") >= F.col("close") * (1 + t)).cast("int").alias(label_name(h, t))
              for h in horizons for t in thresholds]
    return drop_incomplete(df.select("*", *labels).drop("close"))


def align_labels(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Labels of the dates that the feature table holds."""
    return drop_incomplete(labels.join(features.select("key", "ts"), ["key", "ts"], "left_semi"))


def required(name: str) -> Column:
    """The column, or an error when a value is missing."""
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"{name} contains nulls")).cast("double"))


def high_label(horizon: int, threshold: float, use_high: bool = True) -> Column:
    """1 when a later high (or close) reaches the close plus ``threshold``."""
    top = future_max("high" if use_high else "close", horizon)
    return F.when(top.isNotNull(), (top >= F.col("close") * (1 + threshold)).cast("int"))


def next_return_label(threshold: float) -> Column:
    """1 when the next close gains more than ``threshold``; the last row is 0."""
    return W.flag(W.ratio(W.lead("close"), "close") - 1 > threshold)


# --- normalisation -----------------------------------------------------------------

def numeric_columns(df: DataFrame, exclude: Iterable[str] = PRICE_COLUMNS) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _NUMERIC) and f.name not in set(exclude)]


def feature_columns(df: DataFrame, wanted: list[str] | None = None) -> list[str]:
    """Checked list of feature columns, or every numeric one that is no price."""
    if wanted is not None:
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            raise ValueError(f"feature columns not found: {missing}")
        wrong = [c for c in wanted if not isinstance(df.schema[c].dataType, _NUMERIC)]
        if wrong:
            raise ValueError(f"feature columns must be numeric: {wrong}")
        return wanted
    found = numeric_columns(df)
    skipped = [c for c in df.columns if c not in found and c not in PRICE_COLUMNS]
    if skipped:
        warnings.warn(f"skipped non-numeric columns: {skipped}")
    if not found:
        raise ValueError("no numeric feature columns")
    return found


def normalisation(df: DataFrame, columns: list[str], train: Column, population: bool = False) -> DataFrame:
    """Mean and spread per key over the training rows, in one aggregate."""
    sd = F.stddev_pop if population else F.stddev_samp
    aggs = []
    for c in columns:
        if c not in BOUNDED:
            x = F.when(train, F.col(c))
            spread = F.coalesce(sd(x), F.lit(0.0))
            if population:
                spread = F.when(spread < 1e-8, 1.0).otherwise(spread)
            aggs += [F.avg(x).alias(f"{c}__mean"), spread.alias(f"{c}__sd")]
    return df.groupBy("key").agg(*aggs)


def normalise(df: DataFrame, params: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    """(x - mean) / (sd + epsilon) for every column that ``params`` describes.

    ``params`` has one row per key, so the join moves by key like the table."""
    cols = [c[:-6] for c in params.columns if c.endswith("__mean")]
    out = df.join(params, "key", "left")
    scaled = {c: (F.col(c) - F.col(f"{c}__mean")) / (F.col(f"{c}__sd") + epsilon) for c in cols}
    return out.withColumns(scaled).select(*df.columns)


def row_number() -> Column:
    """Position inside the key, from 0."""
    return W.row_index() - 1


def normalise_by_first_rows(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """Fit on the first ``rows`` rows of each key, apply to all."""
    d = df.withColumn("_pos", row_number())
    return normalise(d, normalisation(d, columns, F.col("_pos") < rows)).drop("_pos")


def normalise_before(df: DataFrame, columns: list[str], day: str) -> DataFrame:
    """Population z-score fitted on the rows before ``day``; a spread under 1e-8
    counts as 1."""
    params = normalisation(df, columns, F.col("ts") < F.lit(day).cast("date"), population=True)
    return normalise(df, params, epsilon=0.0)


def instance_statistics(values: Column) -> tuple[Column, Column]:
    """Mean and sigma of a sample array; null for an empty one."""
    n = F.when(F.size(values) > 0, F.size(values))
    m = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    return m, bound(m, lambda mean: F.sqrt(F.aggregate(
        values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / (n - 1)))


def instance_normalise(values: Column, eps: float = 1e-5, scale: float = 1.0, shift: float = 0.0) -> Column:
    """Every value of a sample array by the sample's own mean and sigma."""
    m, sd = instance_statistics(values)
    return bound(F.struct(m.alias("m"), sd.alias("sd")), lambda s: F.transform(
        values, lambda v: (v - s["m"]) / (s["sd"] + eps) * scale + shift))


def instance_denormalise(scaled: Column, mean: Column, sd: Column, eps: float = 1e-5,
                         scale: float = 1.0, shift: float = 0.0) -> Column:
    """Normalised values, such as predictions, back in the units of their sample."""
    return bound(F.struct(mean.alias("m"), sd.alias("sd")), lambda s: F.transform(
        scaled, lambda v: (v - shift) / scale * (s["sd"] + eps) + s["m"]))


# --- splits -------------------------------------------------------------------------

def _rows_in_key() -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy("key"))


def chunk_split(df: DataFrame, context: int, horizon: int, val_ratio: float = 0.15,
                test_ratio: float = 0.15, mode: str = "scattered", seed: int = 42) -> DataFrame:
    """``split`` of the sample that starts at each row: train, val, test or null.

    A key's rows are cut into chunks of ``context + horizon``.  Val and test
    samples are whole chunks, the last ones (contiguous) or drawn by a hash
    (scattered).  A key with under five chunks of rows, or with no chunk left for
    training, is an error.  A train sample may start anywhere as long as none of its rows
    belongs to a val or test chunk."""
    if mode not in ("contiguous", "scattered"):
        raise ValueError("mode must be contiguous or scattered")
    if val_ratio + test_ratio >= 1:
        raise ValueError("val_ratio + test_ratio must be below 1")
    size = context + horizon
    d = df.select("*", row_number().alias("_pos"), _rows_in_key().alias("_n"))
    d = d.withColumn("_chunk", F.floor(F.col("_pos") / size)) \
        .withColumn("_chunks", F.floor(F.col("_n") / size))
    n_val = F.greatest(F.lit(1), F.floor(F.col("_chunks") * val_ratio))
    n_test = F.greatest(F.lit(1), F.floor(F.col("_chunks") * test_ratio))
    enough = F.when(F.col("_n") >= 5 * size, F.col("_chunks")).otherwise(
        F.raise_error(F.concat(F.lit("too few rows for a split in key "), F.col("key"))).cast("long"))
    enough = F.when((F.col("_n") < 5 * size) | (F.col("_chunks") > n_val + n_test), enough).otherwise(
        F.raise_error(F.concat(F.lit("no chunk is left for training in key "), F.col("key"))).cast("long"))
    d = d.withColumn("_chunks", enough)
    if mode == "contiguous":
        place = F.col("_chunks") - 1 - F.col("_chunk")           # 0 for the last chunk
        part = F.when(place < n_test, "test").when(place < n_test + n_val, "val")
    else:
        # order chunks by a hash: rank the first row of each chunk
        order = digest(seed, "key", F.col("_chunk"))
        lead = F.when((F.col("_pos") % size == 0) & (F.col("_chunk") < F.col("_chunks")), order)
        d = d.withColumn("_order", lead)
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("_order").asc_nulls_last())) - 1
        d = d.withColumn("_rank", F.when(F.col("_order").isNotNull(), rank))
        d = d.withColumn("_place", F.max("_rank").over(Window.partitionBy("key", "_chunk")))
        part = F.when(F.col("_place") < n_val, "val").when(F.col("_place") < n_val + n_test, "test")
    d = d.withColumn("_part", F.when(F.col("_chunk") < F.col("_chunks"), part))
    ahead = F.max(F.col("_part").isNotNull()).over(W.frame(0, size - 1))
    starts_chunk = F.col("_pos") % size == 0
    fits = F.col("_pos") + size <= F.col("_n")
    split = F.when(F.col("_part").isNotNull(), F.when(starts_chunk, F.col("_part"))) \
        .when(fits & ~ahead, "train")
    return d.select(*df.columns, F.col("_pos").alias("start"), split.alias("split"))


def subset_of_train(split: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """max(1, floor(n * fraction)) train samples per key, drawn without
    replacement by hash order."""
    train = split.filter("split = 'train'")
    w = Window.partitionBy("key")
    ranked = train.select("*", F.count(F.lit(1)).over(w).alias("_n"), F.row_number().over(
        w.orderBy(digest(seed, "key", F.col("start")))).alias("_r"))
    keep = F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))
    return ranked.filter(F.col("_r") <= keep).drop("_n", "_r")


def date_split(df: DataFrame, context: int, horizon: int, val_start: str, test_start: str,
               check: bool = True) -> DataFrame:
    """Samples whose whole span lies before ``val_start``, between it and
    ``test_start``, or after.  A boundary moves to the key's next bar; a region
    shorter than a sample raises unless ``check`` is off (then it stays empty)."""
    size = context + horizon
    whole = Window.partitionBy("key")
    d = df.select("*", row_number().alias("_pos"), F.count(F.lit(1)).over(whole).alias("_n"))

    def boundary(day):
        return F.min(F.when(F.col("ts") >= F.lit(day).cast("date"), F.col("_pos"))).over(whole)
    d = d.select("*", F.coalesce(boundary(val_start), F.col("_n")).alias("_v"),
                 F.coalesce(boundary(test_start), F.col("_n")).alias("_t"))
    if check:
        short = F.least(F.col("_v"), F.col("_t") - F.col("_v"), F.col("_n") - F.col("_t")) < size
        d = d.withColumn("_n", F.when(short, F.raise_error(F.concat(
            F.lit("a region is too small for a sample in key "), F.col("key"))).cast("long"))
            .otherwise(F.col("_n")))
    p = F.col("_pos")
    split = F.when(p + size <= F.col("_v"), "train") \
        .when((p >= F.col("_v")) & (p + size <= F.col("_t")), "val") \
        .when((p >= F.col("_t")) & (p + size <= F.col("_n")), "test")
    return d.select(*df.columns, p.alias("start"), split.alias("split"))


def prediction_date_filter(df: DataFrame, context: int, horizon: int, test_start: str) -> DataFrame:
    """Sample starts whose last context row lies on or after ``test_start``."""
    d = df.select("*", row_number().alias("start"), W.lead("ts", context - 1).alias("prediction_ts"),
                  W.lead("ts", context + horizon - 1).alias("_end"))
    return d.filter((F.col("prediction_ts") >= F.lit(test_start).cast("date"))
                    & F.col("_end").isNotNull()).drop("_end")


def target_date_split(df: DataFrame, context: int, val_start: str, test_start: str) -> DataFrame:
    """Sample of the ``context`` rows before each row, split by the row's date."""
    ts = F.col("ts")
    split = F.when(ts < F.lit(val_start).cast("date"), "train") \
        .when(ts < F.lit(test_start).cast("date"), "val").otherwise("test")
    return df.select("*", row_number().alias("_pos")).filter(F.col("_pos") >= context) \
        .select(*df.columns, (F.col("_pos") - context).alias("start"), split.alias("split"))


# --- samples ------------------------------------------------------------------------

def samples(df: DataFrame, columns: list[str], context: int, horizon: int, threshold: float,
            use_high: bool = True) -> DataFrame:
    """One row per sample: its context as an array of structs, and its label.

    ``ts`` is the last context row.  The array comes from a bounded frame."""
    w = W.frame(-context + 1)
    d = df.select("key", "ts", F.collect_list(F.struct(*columns)).over(w).alias("x"),
                  high_label(horizon, threshold, use_high).alias("label"), row_number().alias("_pos"))
    return d.filter((F.col("_pos") >= context - 1) & F.col("label").isNotNull()).select(
        "key", (F.col("_pos") - context + 1).alias("start"), "ts", "x", "label")


def sample_counts(df: DataFrame, context: int, horizon: int) -> DataFrame:
    """Samples per key; an error for a key that has none."""
    n = F.count(F.lit(1)) - context - horizon + 1
    return df.groupBy("key").agg(n.alias("n")).withColumn("n_samples", F.when(
        F.col("n") >= 1, F.col("n")).otherwise(F.raise_error(F.concat(
            F.lit("sequence too short in key "), F.col("key"))).cast("long"))).drop("n")


def patches(values: Column, length: int, stride: int, context: int) -> Column:
    """Overlapping slices of a sample array."""
    starts = F.sequence(F.lit(1), F.lit(context - length + 1), F.lit(stride))
    return F.transform(starts, lambda s: F.slice(values, s, length))


def combined_dataset(bars: DataFrame, features: DataFrame, labels: DataFrame | None = None,
                     vix: DataFrame | None = None, check: bool = True) -> DataFrame:
    """Bars, features, volatility columns and labels joined one to one, without
    incomplete rows."""
    out = join_one_to_one(bars, features, ["key", "ts"], check)
    if vix is not None:
        # one row per date stands beside every key: unique on its own side
        if check:
            assert_unique(vix, ["ts"], "second series")
            assert_overlap(out, vix, ["ts"])
        out = out.join(vix, ["ts"], "inner")
    if labels is not None:
        out = join_one_to_one(out, labels, ["key", "ts"], check)
    return drop_incomplete(out)


def split_statistics(split: DataFrame, label: str = "label") -> DataFrame:
    return split.filter(F.col("split").isNotNull()).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.avg(F.col(label).cast("double")).alias("positive_ratio"))
