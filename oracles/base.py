"""Small text builder for the DuckDB comparison queries.

A query is a chain of CTEs; ``add`` appends computed columns, ``rec`` appends
columns defined by a recurrence over rows, written as a recursive CTE."""

from __future__ import annotations

LISTED = "(100.0 + sqrt(l_extendedprice / l_quantity))"
PAID = f"{LISTED} * (1 - l_discount) * (1 + l_tax)"


def bars(key="l_suppkey"):
    return f"""SELECT {key} AS key, CAST(l_shipdate AS DATE) AS ts,
      arg_min(li, o) AS open, max(greatest(li, pa)) AS high, min(least(li, pa)) AS low,
      arg_max(pa, o) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
      FROM (SELECT *, {LISTED} AS li, {PAID} AS pa,
            {{'a': l_orderkey, 'b': l_linenumber, 'c': l_suppkey, 'd': l_partkey}} AS o
            FROM lineitem) GROUP BY ALL"""


BARS = bars()
VIX = """SELECT CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) / 12500 AS vix
      FROM orders GROUP BY 1"""
WEEKS = f"""SELECT key, CAST(date_trunc('week', ts) AS DATE) AS ts, arg_min(open, ts) AS open,
      max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
      CAST(sum(volume) AS BIGINT) AS volume FROM ({BARS}) GROUP BY 1, 2"""

P = "PARTITION BY key ORDER BY ts"


def ov(n, end=0):
    last = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"OVER ({P} ROWS BETWEEN {n - 1 - end} PRECEDING AND {last})"


RUN = f"OVER ({P} ROWS UNBOUNDED PRECEDING)"


def agg(fn, x, n, end=0):
    """Aggregate of a full window of n known values."""
    return f"(CASE WHEN count({x}) {ov(n, end)} = {n} THEN {fn} {ov(n, end)} END)"


def av(x, n, end=0):
    return agg(f"avg({x})", x, n, end)


def su(x, n):
    return agg(f"sum({x})", x, n)


def mi(x, n, end=0):
    return agg(f"min({x})", x, n, end)


def ma(x, n, end=0):
    return agg(f"max({x})", x, n, end)


def sd(x, n):
    return agg(f"stddev_samp({x})", x, n)


def sp(x, n):
    return agg(f"stddev_pop({x})", x, n)


def ls(x, n, end=0):
    return agg(f"list({x})", x, n, end)


def lg(x, k=1):
    return f"lag({x}, {k}) OVER ({P})"


def ld(x, k=1):
    return f"lead({x}, {k}) OVER ({P})"


def div(a, b):
    return f"(({a}) / nullif({b}, 0))"


def pct(a, b):
    return f"((({a}) - ({b})) / nullif({b}, 0) * 100)"


def nn(x, d):
    return f"coalesce({x}, {d})"


def fl(cond):
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def clip(x, a, b):
    return f"(CASE WHEN ({x}) < {a} THEN {float(a)} WHEN ({x}) > {b} THEN {float(b)} ELSE ({x}) END)"


class Q:
    def __init__(self, base=BARS, digits=6):
        self.digits = digits
        self.ctes = [f"raw AS ({base})",
                     f"t0 AS MATERIALIZED (SELECT *, row_number() OVER ({P}) AS rn FROM raw)"]
        self.n = 0

    @property
    def cur(self):
        return f"t{self.n}"

    def add(self, **cols):
        body = ", ".join(f"{x} AS {c}" for c, x in cols.items())
        prev = self.cur
        self.n += 1
        self.ctes.append(f"t{self.n} AS (SELECT *, {body} FROM {prev})")
        return self

    def raw(self, sql):
        """A CTE from a template in which {t} is the previous one."""
        sql = sql.replace("{t}", self.cur)
        self.n += 1
        self.ctes.append(f"t{self.n} AS MATERIALIZED ({sql})")
        return self

    def rec(self, **cols):
        """name=(first, next): ``p`` is the row before, ``n`` the row itself."""
        self.raw("SELECT * FROM {t}")
        src, r = self.cur, f"r{self.n}"
        first = ", ".join(f"CAST({a} AS DOUBLE) AS {c}" for c, (a, _) in cols.items())
        then = ", ".join(f"CAST({b} AS DOUBLE)" for _, b in cols.values())
        self.ctes.append(
            f"{r} AS (SELECT n.key, n.rn, {first} FROM {src} n WHERE n.rn = 1 UNION ALL "
            f"SELECT n.key, n.rn, {then} FROM {r} p JOIN {src} n "
            f"ON n.key = p.key AND n.rn = p.rn + 1)")
        self.n += 1
        take = ", ".join(f"{r}.{c}" for c in cols)
        self.ctes.append(f"t{self.n} AS MATERIALIZED (SELECT {src}.*, {take} FROM {src} "
                         f"JOIN {r} ON {r}.key = {src}.key AND {r}.rn = {src}.rn)")
        return self

    def streak(self, **conds):
        """Length of the run of rows that meet a condition, row by row."""
        pre = {f"c_{k}": fl(x) for k, x in conds.items()}
        self.add(**pre)
        return self.rec(**{k: (f"n.c_{k}", f"CASE WHEN n.c_{k} = 1 THEN p.{k} + 1 ELSE 0 END")
                           for k in conds})

    def sides(self, **pairs):
        """Signed rows since a pair changed sides; 0 where either is unknown."""
        self.add(**{f"b_{k}": f"CASE WHEN ({a}) >= ({b}) THEN 1 WHEN ({a}) < ({b}) THEN -1 ELSE 0 END"
                    for k, (a, b) in pairs.items()})
        return self.rec(**{k: (f"n.b_{k}", f"CASE WHEN n.b_{k} = 0 THEN 0 "
                               f"WHEN n.b_{k} * p.{k} > 0 THEN p.{k} + n.b_{k} ELSE n.b_{k} END")
                           for k in pairs})

    # common recursive columns ------------------------------------------------
    def ema(self, x="close", at=None, **spans):
        """name=span; seeded with the mean of the span's values at row ``at``."""
        self.add(**{f"s_{c}": f"avg({x}) {ov(n)}" for c, n in spans.items()})
        cols = {}
        for c, n in spans.items():
            start = at or n
            cols[c] = (f"CASE WHEN {start} = 1 THEN n.s_{c} END",
                       f"CASE WHEN n.rn < {start} THEN NULL WHEN n.rn = {start} THEN n.s_{c} "
                       f"ELSE p.{c} + 2.0 / ({n} + 1) * (n.{x} - p.{c}) END")
        return self.rec(**cols)

    def ewm(self, x, **spans):
        return self.rec(**{c: (f"n.{x}", f"coalesce(p.{c} + 2.0 / ({n} + 1) * (n.{x} - p.{c}), n.{x})")
                           for c, n in spans.items()})

    def wild(self, x, **spans):
        """Wilder average of a column that starts at row 2."""
        self.add(**{f"s_{c}": f"avg({x}) {ov(n)}" for c, n in spans.items()})
        return self.rec(**{c: ("NULL", f"CASE WHEN n.rn <= {n} THEN NULL WHEN n.rn = {n} + 1 "
                               f"THEN n.s_{c} ELSE (p.{c} * ({n} - 1) + n.{x}) / {n} END")
                           for c, n in spans.items()})

    def pc(self):
        if not hasattr(self, "_pc"):
            self._pc = True
            self.add(pc=lg("close"))
            self.add(ret="close / pc - 1", lret="ln(close / pc)",
                     tr="CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), "
                        "abs(low - pc)) END", ph=lg("high"), pl=lg("low"), po=lg("open"),
                     pv=lg("volume"))
            self.add(up="high - ph", dn="pl - low",
                     gain="CASE WHEN pc IS NULL THEN NULL WHEN close > pc THEN close - pc ELSE 0 END",
                     loss="CASE WHEN pc IS NULL THEN NULL WHEN close < pc THEN pc - close ELSE 0 END")
        return self

    def atr(self, *spans):
        return self.pc().wild("tr", **{f"atr{n}": n for n in spans})

    def rsi(self, *spans):
        self.pc()
        for n in spans:
            self.wild("gain", **{f"g{n}": n}).wild("loss", **{f"l{n}": n})
        return self.add(**{f"rsi{n}": f"CASE WHEN g{n} + l{n} = 0 THEN 0 ELSE 100 * g{n} / (g{n} + l{n}) END"
                           for n in spans})

    def bb(self):
        return self.add(mid=av("close", 20), sig=sp("close", 20)).add(
            bu="mid + 2 * sig", bl="mid - 2 * sig")

    def macd(self, fast=12, slow=26, sig=9):
        self.ema(at=slow, mf=fast, ms=slow)
        self.add(mraw="mf - ms")
        self.ema("mraw", at=slow + sig - 1, msig=sig)
        return self.add(macd="CASE WHEN msig IS NOT NULL THEN mraw END",
                        hist="CASE WHEN msig IS NOT NULL THEN mraw - msig END")

    def dm(self):
        self.pc().add(
            dp="CASE WHEN up IS NULL THEN NULL WHEN up > dn AND up > 0 THEN up ELSE 0 END",
            dmn="CASE WHEN up IS NULL THEN NULL WHEN dn > up AND dn > 0 THEN dn ELSE 0 END")
        self.add(**{f"i_{c}": f"sum({x}) {RUN}" for c, x in (("sp", "dp"), ("sm", "dmn"), ("st", "tr"))})
        self.rec(**{c: ("NULL", f"CASE WHEN n.rn < 14 THEN NULL WHEN n.rn = 14 THEN n.i_{c} "
                        f"ELSE p.{c} - p.{c} / 14 + n.{x} END")
                    for c, x in (("sp", "dp"), ("sm", "dmn"), ("st", "tr"))})
        return self.add(
            pdi="CASE WHEN rn > 14 THEN CASE WHEN st = 0 THEN 0 ELSE 100 * sp / st END END",
            mdi="CASE WHEN rn > 14 THEN CASE WHEN st = 0 THEN 0 ELSE 100 * sm / st END END")

    def adx(self):
        self.dm().add(dx="CASE WHEN rn > 14 AND st > 0 AND sp + sm > 0 "
                         "THEN 100 * abs(sp - sm) / (sp + sm) END")
        self.add(dx0="CASE WHEN rn > 14 THEN coalesce(dx, 0) END")
        self.add(dxm=f"avg(dx0) {ov(14)}")
        return self.rec(adx=("NULL", "CASE WHEN n.rn < 28 THEN NULL WHEN n.rn = 28 THEN n.dxm "
                             "WHEN n.dx IS NULL THEN p.adx ELSE (p.adx * 13 + n.dx) / 14 END"))

    # output --------------------------------------------------------------------
    def out(self, cols, ints=(), keys="key, CAST(ts AS VARCHAR) AS ts", where=""):
        """``cols``: doubles, ``ints``: whole numbers; names, or name -> expression."""
        parts = [keys]
        for c in _items(cols):
            parts.append(f"{rnd(c[1], self.digits)} AS {c[0]}")
        for c in _items(ints):
            parts.append(f"CAST({c[1]} AS BIGINT) AS {c[0]}")
        return (f"WITH RECURSIVE {', '.join(self.ctes)} SELECT {', '.join(parts)} "
                f"FROM {self.cur} {where}")


def rnd(x, digits=6):
    return f"(CASE WHEN round({x}, {digits}) = 0 THEN 0.0 ELSE round({x}, {digits}) END)"


def _items(cols):
    if isinstance(cols, dict):
        return list(cols.items())
    if isinstance(cols, str):
        cols = cols.split()
    return [(c, c) for c in cols]
