"""Checks and profiles of tables.  Each returns rows, so a report is a union."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.ranking import quantiles
from tickloom.sources.tables import stored

_NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def _per_column(df: DataFrame, columns: list[str], **cells: Callable[[str], Column]) -> DataFrame:
    """One aggregate pass; ``cells`` build an aggregate from a column name."""
    row = df.agg(*[F.struct(F.lit(c).alias("column"), *[fn(c).alias(k) for k, fn in cells.items()]).alias(f"c{i}")
                   for i, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))


def columns_check(df: DataFrame, expected: list[str]) -> DataFrame:
    """Every expected or present column: whether it is expected, present, and
    how many values it holds."""
    have = _per_column(df, df.columns, values=lambda c: F.count(F.col(c)))
    want = df.sparkSession.createDataFrame([(c,) for c in expected], "column string")
    j = want.withColumn("expected", F.lit(True)).join(
        F.broadcast(have.withColumn("present", F.lit(True))), "column", "full")    # one row per column
    return j.select("column", F.coalesce("expected", F.lit(False)).alias("expected"),
                    F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("values", F.lit(0)).alias("values"))


def nulls_and_infinities(df: DataFrame, columns: list[str]) -> DataFrame:
    return _per_column(df, columns, nulls=lambda c: F.count_if(F.col(c).isNull()),
                       infinities=lambda c: F.count_if(F.abs(F.col(c).cast("double")) == float("inf")))


def order_check(df: DataFrame, by: str, sequence: str, ts: str, block: int = 1 << 16) -> DataFrame:
    """Rows that lie before their predecessor in the stored sequence, and dates
    that repeat, per key.

    The sequence is cut into blocks; only neighbouring block ends are compared
    across blocks, so a long key is spread over many tasks."""
    d = df.withColumn("_b", F.floor(F.col(sequence) / block))
    inner = Window.partitionBy(by, "_b").orderBy(sequence)
    inside = d.select(by, "_b", sequence, ts, (F.col(ts) < F.lag(ts).over(inner)).alias("_back"))
    ends = inside.groupBy(by, "_b").agg(
        F.count_if("_back").alias("v"), F.min_by(ts, sequence).alias("first"), F.max_by(ts, sequence).alias("last"))
    across = F.col("first") < F.lag("last").over(Window.partitionBy(by).orderBy("_b"))
    order = ends.select(by, (F.col("v") + F.coalesce(across, F.lit(False)).cast("int")).alias("v")) \
        .groupBy(by).agg(F.sum("v").alias("order_violations"))
    dup = df.groupBy(by, ts).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(
        F.sum(F.col("n") - 1).alias("repeated"), F.sum("n").alias("rows"))
    return order.join(dup, by)


def bounds_check(df: DataFrame, limits: dict[str, tuple[float, float]], tolerance: float = 0.0) -> DataFrame:
    def outside(c):
        lo, hi = limits[c]
        return F.count_if((F.col(c) < lo - tolerance) | (F.col(c) > hi + tolerance))
    out = _per_column(df, list(limits), actual_min=lambda c: F.min(F.col(c).cast("double")),
                      actual_max=lambda c: F.max(F.col(c).cast("double")), violations=outside)
    return out.withColumn("passed", F.col("violations") == 0)


def rules_check(df: DataFrame, rules: dict[str, str], tolerance: float = 0.0) -> DataFrame:
    """Named SQL conditions that every row must meet; unknown is no violation."""
    row = df.agg(*[F.struct(F.lit(n).alias("rule"), F.count_if(~F.expr(r)).alias("violations"),
                            F.count(F.expr(r)).alias("tested")).alias(f"r{i}")
                   for i, (n, r) in enumerate(rules.items())])
    out = row.select(F.inline(F.array(*[f"r{i}" for i in range(len(rules))])))
    return out.withColumn("passed", F.col("violations") <= F.col("tested") * tolerance)


def implications_check(df: DataFrame, rules: dict[str, tuple[str, str]], tolerance: float = 0.01) -> DataFrame:
    """``when -> then`` rules; up to ``tolerance`` of the tested rows may fail."""
    row = df.agg(*[F.struct(F.lit(n).alias("rule"), F.count_if(F.expr(a)).alias("tested"),
                            F.count_if(F.expr(a) & ~F.coalesce(F.expr(b), F.lit(False))).alias("violations")).alias(f"r{i}")
                   for i, (n, (a, b)) in enumerate(rules.items())])
    out = row.select(F.inline(F.array(*[f"r{i}" for i in range(len(rules))])))
    return out.withColumn("passed", F.col("violations") <= F.col("tested") * tolerance)


def recompute_check(stored: DataFrame, recomputed: DataFrame, on: list[str], columns: list[str],
                    tolerance: float = 1e-6) -> DataFrame:
    """Largest difference per column, rows on one side only, and mismatched nulls."""
    a = stored.select(*on, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns], F.lit(1).alias("_a"))
    b = recomputed.select(*on, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns], F.lit(1).alias("_b"))
    j = a.join(b, on, "full")
    out = _per_column(
        j, columns, max_diff=lambda c: F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))),
        compared=lambda c: F.count(F.col(f"a_{c}") - F.col(f"b_{c}")),
        null_mismatch=lambda c: F.count_if(F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull()),
        unmatched=lambda c: F.count_if(F.col("_a").isNull() | F.col("_b").isNull()))
    ok = (F.coalesce("max_diff", F.lit(0.0)) <= tolerance) & (F.col("null_mismatch") == 0)
    return out.withColumn("passed", ok)


def lookahead_check(bars: DataFrame, compute: Callable[[DataFrame], DataFrame], columns: list[str],
                    cuts: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Recompute on the rows up to each cut date and compare at the key's last
    row.  Every cut becomes a series of its own, so all cuts are one pass."""
    dates = F.explode(F.array(*[F.lit(c).cast("date") for c in cuts]))
    short = bars.withColumn("_cut", dates).filter(F.col("ts") <= F.col("_cut"))
    short = short.withColumn("key", F.concat_ws("|", F.col("key").cast("string"), F.col("_cut").cast("string"))).drop("_cut")
    last = short.groupBy("key").agg(F.max("ts").alias("ts"))
    # few of the rows can be last ones: those whose day is the last one of any key and cut
    last = stored(last)

    def of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """The rows with a key and day of `wanted`."""
        days = F.broadcast(last.select("ts").distinct())         # one row per calendar day
        return rows.join(days, "ts", "left_semi").join(wanted, ["key", "ts"], "left_semi")

    cut = of(compute(short), last)
    cut = cut.withColumn("key", F.regexp_replace("key", r"\|[^|]*$", ""))
    full = compute(bars).withColumn("key", F.col("key").cast("string"))
    # two cuts may end on the same row; it is compared once
    # and read twice: one row per key and cut
    cut = stored(cut.dropDuplicates(["key", "ts"]))
    full = of(full, cut.select("key", "ts"))
    return recompute_check(full, cut, ["key", "ts"], columns, tolerance)


def distribution_check(df: DataFrame, expected: dict[str, tuple[str, float, float]]) -> DataFrame:
    """Named aggregate expressions that must lie strictly inside a range."""
    row = df.agg(*[F.struct(F.lit(n).alias("check"), F.expr(e).cast("double").alias("value"),
                            F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high")).alias(f"r{i}")
                   for i, (n, (e, lo, hi)) in enumerate(expected.items())])
    out = row.select(F.inline(F.array(*[f"r{i}" for i in range(len(expected))])))
    return out.withColumn("passed", F.coalesce((F.col("value") > F.col("low")) & (F.col("value") < F.col("high")), F.lit(False)))


def event_check(df: DataFrame, events: dict[str, tuple[str, str, str, float, float]]) -> DataFrame:
    """Aggregates over date ranges: ``name -> (first, last, expression, low, high)``.

    The expression is an average over the rows of the range."""
    inside = {}
    for n, (first, last, expr, lo, hi) in events.items():
        hit = F.col("ts").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        inside[n] = (hit, F.expr(expr).cast("double"), lo, hi)
    row = df.agg(*[F.struct(F.lit(n).alias("event"), F.count_if(h).alias("rows"), F.avg(F.when(h, e)).alias("value"),
                            F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high")).alias(f"r{i}")
                   for i, (n, (h, e, lo, hi)) in enumerate(inside.items())])
    out = row.select(F.inline(F.array(*[f"r{i}" for i in range(len(events))])))
    return out.withColumn("passed", F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)))


def audit_rows(df: DataFrame, dates: list[str], columns: list[str]) -> DataFrame:
    """Per key and date the row of that date or the nearest one (the earlier of two)."""
    aggs = []
    for i, d in enumerate(dates):
        gap = F.abs(F.datediff("ts", F.lit(d).cast("date")))
        aggs.append(F.struct(F.lit(d).alias("audit_date"), F.min_by(
            F.struct("ts", *columns), F.struct(gap.alias("g"), F.col("ts"))).alias("row")).alias(f"r{i}"))
    out = df.groupBy("key").agg(*aggs)
    return out.select("key", F.inline(F.array(*[f"r{i}" for i in range(len(dates))]))).select("key", "audit_date", "row.*")


def report(checks: dict[str, DataFrame], name: dict[str, str] | None = None) -> DataFrame:
    """Check tables with a ``passed`` column as one: chunk, check, passed."""
    parts = []
    for chunk, df in checks.items():
        label = (name or {}).get(chunk) or df.columns[0]
        parts.append(df.select(F.lit(chunk).alias("chunk"), F.col(label).cast("string").alias("check"), "passed"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Type, count, nulls, mean, sigma, extremes and quartiles per column."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, _NUMERIC)]
    kinds = dict(df.dtypes)
    basic = _per_column(
        df, columns, kind=lambda c: F.lit(kinds[c]), count=lambda c: F.count(F.col(c)),
        nulls=lambda c: F.count_if(F.col(c).isNull()), mean=lambda c: F.avg(F.col(c).cast("double")),
        std=lambda c: F.stddev_samp(F.col(c).cast("double")), min=lambda c: F.min(F.col(c).cast("double")),
        max=lambda c: F.max(F.col(c).cast("double")))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    q = quantiles(df.select(F.inline(pairs)), ["column"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return basic.join(q.drop("n_values"), "column", "left")


def date_range(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                  F.countDistinct(ts).alias("dates"))


# --- content registry --------------------------------------------------------------------

BUCKETS = 256
WORDS = 4


def _line(columns: list[str]) -> Column:
    # a value is led by its length, so no two rows give one line
    return F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("~"))
                      for v in (F.col(c).cast("string") for c in columns)])


def _word(text: Column, i: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")


def _sums(columns: list[str]) -> Column:
    """Sums of the four 32-bit words of all rows' 128-bit hashes, as text."""
    return F.concat_ws("-", *[F.coalesce(F.sum(_word(_line(columns), i)), F.lit(0)).cast("string") for i in range(WORDS)])


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free checksum from 128-bit hashes of the rows."""
    return df.agg(F.count(F.lit(1)).alias("rows"), _sums(df.columns).alias("checksum"))


def content_leaves(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The leaves of a hash tree: rows and a digest of the content per bucket of the key.
    A change moves the digests of the buckets of the rows it touches, and no others."""
    bucket = (_word(_line(keys), 0) % buckets).cast("int")
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), _sums(df.columns).alias("_s")).select(
        "bucket", "rows", F.md5(F.concat_ws("/", "bucket", "rows", "_s")).alias("leaf"))


def content_root(leaves: DataFrame) -> DataFrame:
    """Rows and one digest over the leaves in bucket order (at most one row a bucket)."""
    in_order = F.array_sort(F.collect_list(F.struct("bucket", "leaf")))
    return leaves.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                      F.md5(F.concat_ws("", F.transform(in_order, lambda x: x["leaf"]))).alias("root"))


def changed_buckets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Buckets that differ between two sets of leaves: added, missing or changed."""
    a, b = before.toDF("bucket", "rows_before", "_a"), after.toDF("bucket", "rows_after", "_b")
    problem = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "missing").otherwise("changed")
    return a.join(b, "bucket", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        "bucket", "rows_before", "rows_after", problem.alias("problem"))


def registry_entry(df: DataFrame, dataset: str, path: str, version: int, tier: str, registered_at: str,
                   sources: list[str] = ()) -> DataFrame:
    return fingerprint(df).select(
        F.lit(dataset).alias("dataset"), F.lit(path).alias("path"), "rows", "checksum", F.lit(version).alias("version"),
        F.lit(tier).alias("tier"), F.lit(registered_at).alias("registered_at"),
        F.array(*[F.lit(s) for s in sources]).cast("array<string>").alias("sources"))


def latest_entries(registry: DataFrame) -> DataFrame:
    """The newest entry per path; of equal times the first version."""
    newest = F.max_by(F.struct(*registry.columns), F.struct(F.col("registered_at"), -F.col("version")))
    return registry.groupBy(F.col("path").alias("_p")).agg(newest.alias("e")).select("e.*")


def verify(registry: DataFrame, actual: DataFrame) -> DataFrame:
    """Latest entries whose path is missing or whose content changed.

    ``actual`` has ``path, rows, checksum`` of what exists now."""
    now = actual.select("path", F.col("rows").alias("_rows"), F.col("checksum").alias("_sum"))
    j = latest_entries(registry).join(now, "path", "left")
    problem = F.when(F.col("_sum").isNull(), "missing").when(
        (F.col("_sum") != F.col("checksum")) | (F.col("_rows") != F.col("rows")), "changed")
    return j.select("dataset", "path", problem.alias("problem")).filter("problem is not null")
