"""Window-frame vocabulary shared by every operator.

A series is a set of rows with one ``key`` and one row per calendar day
(``ts`` is a DATE), so a key never holds more rows than there are days in its
history: 366 a year, whatever the size of the raw table.  That bound is what
makes ``partitionBy(key)`` safe here; raw ticks, which have no such bound, are
reduced with partial aggregation before any window sees them (operators/bars.py).

Missing data is SQL null.  A trailing window of ``n`` rows yields null until it
holds ``n`` non-null values, and flags treat an unknown comparison as false.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

KEY, TS, ROW = "key", "ts", "_rn"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@lru_cache(maxsize=512)
def _spec(_context, start: int | None, end: int | None):
    # specs are handles into the JVM: one per context and frame is enough
    w = Window.partitionBy(KEY).orderBy(TS)
    return w if start is None else w.rowsBetween(start, end)


def ordered():
    return _spec(SparkContext._active_spark_context, None, None)


def frame(start: int, end: int = 0):
    return _spec(SparkContext._active_spark_context, start, end)


def running():
    return frame(Window.unboundedPreceding, Window.currentRow)


# While a plan collects, every window call becomes a named column of its own and
# equal calls share it.  Spark computes each occurrence of a window expression
# separately, so an expression that reads one frame three times would pay thrice.
class SharedWindows:
    """Window calls of one plan: text -> (column name, call)."""

    def __init__(self):
        self.calls: dict[str, tuple[str, Column]] = {}
        self.used: set[str] = set()

    def column(self, call: Column) -> Column:
        name, _ = self.calls.setdefault(call._jc.toString(), (f"_w{len(self.calls)}", call))
        self.used.add(name)
        return F.col(name)

    @contextmanager
    def collecting(self):
        """Names used inside the block are added to the yielded set."""
        global _shared
        outer, _shared, self.used = _shared, self, set()
        try:
            yield self.used
        finally:
            _shared = outer

    def named(self, names) -> list[Column]:
        return [call.alias(n) for n, call in self.calls.values() if n in names]


_shared: SharedWindows | None = None


def over(agg: Column, spec) -> Column:
    call = agg.over(spec)
    return call if _shared is None else _shared.column(call)


def row_index() -> Column:
    return F.row_number().over(ordered())


# --- lookups -----------------------------------------------------------------

def lag(x, k: int = 1) -> Column:
    return over(F.lag(_col(x), k), ordered())


def lead(x, k: int = 1) -> Column:
    return over(F.lead(_col(x), k), ordered())


# --- full trailing windows -----------------------------------------------------
#
# Sums, means and spreads are aggregates of the frame itself at every length: a
# difference of running sums would carry an old value of another size, or a NaN,
# into every later row.  Counts are whole numbers, so theirs is exact and costs
# the same for any length.

def is_full(x, n: int, end: int = 0) -> Column:
    """Whether the frame holds n known values."""
    upto = over(F.count(_col(x)), frame(Window.unboundedPreceding, end))
    before = over(F.count(_col(x)), frame(Window.unboundedPreceding, end - n))
    return upto - F.coalesce(before, F.lit(0)) == n


def _full(agg: Column, x, n: int, end: int = 0) -> Column:
    return F.when(is_full(x, n, end), over(agg, frame(end - n + 1, end)))


def mean(x, n: int, end: int = 0) -> Column:
    return _full(F.avg(_col(x)), x, n, end)


def total(x, n: int) -> Column:
    return _full(F.sum(_col(x)), x, n)


def low(x, n: int, end: int = 0) -> Column:
    return _full(F.min(_col(x)), x, n, end)


def high(x, n: int, end: int = 0) -> Column:
    return _full(F.max(_col(x)), x, n, end)


def sd(x, n: int) -> Column:
    return _full(F.stddev_samp(_col(x)), x, n)


def sd_pop(x, n: int) -> Column:
    return _full(F.stddev_pop(_col(x)), x, n)


def variance(x, n: int) -> Column:
    return _full(F.var_samp(_col(x)), x, n)


def quantile(x, n: int, p: float) -> Column:
    return _full(F.percentile(_col(x), F.lit(p)), x, n)


def values(x, n: int, end: int = 0) -> Column:
    """Array of the frame's values in time order, null until it is full."""
    return _full(F.collect_list(_col(x)), x, n, end)


def over_rows(agg: Column, n: int, end: int = 0) -> Column:
    """Aggregate over up to ``n`` rows, without the full-window guard."""
    return over(agg, frame(end - n + 1, end))


def over_full_rows(agg: Column, n: int) -> Column:
    """Aggregate over exactly ``n`` rows; nulls inside the frame are allowed."""
    return F.when(F.col(ROW) >= n, over(agg, frame(-n + 1)))


def pair_corr(x, y, n: int) -> Column:
    """Pearson correlation of the window's pairs; null unless all n are complete
    and both sides vary."""
    x, y = _col(x), _col(y)
    w = frame(-n + 1)
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    # corr() itself fails on a flat frame, so the quotient is guarded by hand
    spread = over(F.stddev_pop(px), w) * over(F.stddev_pop(py), w)
    return F.when(is_full(px, n), over(F.covar_pop(px, py), w) / nz(spread))


# --- the five "percentile" rules, kept apart on purpose -------------------------

def rank_below(x, n: int) -> Column:
    """Share of the other n-1 values that lie strictly below the current one."""
    x = _col(x)
    return F.size(F.filter(values(x, n), lambda v: v < x)) / F.lit(n - 1.0)


def rank_at_or_above(x, n: int) -> Column:
    """Share of all n values that are at or above the current one."""
    x = _col(x)
    return F.size(F.filter(values(x, n), lambda v: v >= x)) / F.lit(float(n))


def rank_at_or_below(x, n: int) -> Column:
    """Share of all n values that are at or below the current one."""
    x = _col(x)
    return F.size(F.filter(values(x, n), lambda v: v <= x)) / F.lit(float(n))


def range_share(x, n: int, flat: float | None = 0.5, eps: float = 0.0) -> Column:
    """(x - min) / (max - min); ``flat`` replaces a zero range, or ``eps`` widens it."""
    x = _col(x)
    lo, hi = low(x, n), high(x, n)
    if eps:
        return (x - lo) / (hi - lo + eps)
    return F.when(hi == lo, F.lit(flat)).otherwise((x - lo) / nz(hi - lo))


# --- runs ------------------------------------------------------------------------

def truth(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    return truth(cond).cast("int")


def streak(cond) -> Column:
    """Length of the run of true rows that ends here, 0 on a false row.

    The run starts after the last false row, so one running max is enough."""
    cond = truth(_col(cond))
    last_false = F.coalesce(over(F.max(F.when(~cond, F.col(ROW))), running()), F.lit(0))
    return F.when(cond, F.col(ROW) - last_false).otherwise(0)


def since_start(starts) -> Column:
    """Rows since the latest row where ``starts`` holds, counting that row as 1."""
    return F.col(ROW) - over(F.max(F.when(truth(_col(starts)), F.col(ROW))), running()) + 1


def side_streak(upper, lower) -> Column:
    """Rows spent on the present side of ``lower``, negative when below it."""
    upper, lower = _col(upper), _col(lower)
    return streak(upper >= lower) - streak(upper < lower)


def cum_sum(x) -> Column:
    return over(F.sum(_col(x)), running())


def ffill(x) -> Column:
    return over(F.last(_col(x), ignorenulls=True), running())


def bfill(x) -> Column:
    w = frame(Window.currentRow, Window.unboundedFollowing)
    return over(F.first(_col(x), ignorenulls=True), w)


def latest_extreme(x, n: int, highest: bool, latest: bool = True) -> Column:
    """Row index of the extreme value of the last n rows; ties go to the latest
    (or the earliest) row."""
    x = _col(x)
    by_value = x if highest else -x
    by_row = F.col(ROW) if latest else -F.col(ROW)
    best = over(F.max(F.struct(by_value.alias("v"), by_row.alias("r"))), frame(-n + 1))
    return F.abs(best["r"])


# --- extremes of long frames ---------------------------------------------------------
#
# Rows are cut into blocks of n.  A frame of n rows is the tail of one block and
# the head of the next, so its extreme is that of two running extremes, whatever n.

def block(n: int) -> Column:
    return F.floor((F.col(ROW) - 1) / n)


def block_extreme(x, n: int, highest: bool, tail: bool) -> Column:
    """Running extreme of the block's head up to this row, or of its tail from here."""
    w = Window.partitionBy(KEY, F.col(f"_block_{n}")).orderBy(TS)
    w = w.rowsBetween(Window.currentRow, Window.unboundedFollowing) if tail \
        else w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return over((F.max if highest else F.min)(_col(x)), w)


def frame_extreme(head, tail, n: int, highest: bool) -> Column:
    """Extreme of the last n rows from the columns of ``block_extreme``."""
    pick = F.greatest if highest else F.least
    return F.when(F.col(ROW) >= n, pick(_col(head), lag(tail, n - 1)))


# --- arithmetic --------------------------------------------------------------------

def nz(x) -> Column:
    """Null instead of zero, for divisors."""
    x = _col(x)
    return F.when(x != 0, x)


def ratio(a, b) -> Column:
    return _col(a) / nz(b)


def pct(a, b) -> Column:
    """Distance of a from b in percent of b."""
    a, b = _col(a), _col(b)
    return (a - b) / nz(b) * 100


def or_else(x, default) -> Column:
    return F.coalesce(_col(x), F.lit(default))


def clip(x, lo: float, hi: float) -> Column:
    x = _col(x)
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def nearest_of(x, a: float, b: float) -> Column:
    """Distance to the closer of two levels."""
    x = _col(x)
    return F.least(F.abs(x - a), F.abs(x - b))


def sign(x) -> Column:
    x = _col(x)
    return F.when(x > 0, 1).when(x < 0, -1).when(x == 0, 0)
