"""DuckDB queries for the indicator groups.

Written from the indicator definitions, not from the Spark code: recurrences are
recursive CTEs over rows, streaks count row by row, and window kernels are list
expressions."""

from __future__ import annotations

from catalog.features import DIGITS, TITLES
from oracles.base import (
    P, RUN, VIX, WEEKS, Q, agg, av, clip, div, fl, ld, lg, ls, ma, mi, nn, ov, pct, sd, sp,
    su)

YEAR = "sqrt(252)"


def wma(x, n):
    terms = " + ".join(f"{n - k} * lag({x}, {k}) OVER ({P})" for k in range(n))
    return f"(({terms}) / {n * (n + 1) / 2})"


def wma_list(x, n):
    """Weighted mean of a full list of values, oldest first."""
    return (f"(CASE WHEN count({x}) {ov(n)} = {n} THEN list_sum(list_transform("
            f"list({x}) {ov(n)}, lambda v, i: v * i)) / {n * (n + 1) / 2} END)")


def below(x, n):
    return f"(len(list_filter({ls(x, n)}, lambda v: v < {x})) / {n - 1}.0)"


def at_or_above(x, n):
    return f"(len(list_filter({ls(x, n)}, lambda v: v >= {x})) / {n}.0)"


def at_or_below(x, n):
    return f"(len(list_filter({ls(x, n)}, lambda v: v <= {x})) / {n}.0)"


def place(x, n, eps=None):
    if eps:
        return f"((({x}) - {mi(x, n)}) / ({ma(x, n)} - {mi(x, n)} + {eps}))"
    return (f"(CASE WHEN {ma(x, n)} = {mi(x, n)} THEN 0.5 ELSE "
            f"(({x}) - {mi(x, n)}) / ({ma(x, n)} - {mi(x, n)}) END)")


def stoch(c, lo, hi):
    return f"(CASE WHEN {hi} = {lo} THEN 0 ELSE 100 * ({c} - {lo}) / ({hi} - {lo}) END)"


def slope(x, k=5):
    return f"({x} - {lg(x, k)})"


def corr(x, y, n):
    px, py = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    return (f"(CASE WHEN count({px}) {ov(n)} = {n} AND max({px}) {ov(n)} > min({px}) {ov(n)} "
            f"AND max({py}) {ov(n)} > min({py}) {ov(n)} THEN corr({x}, {y}) {ov(n)} END)")


def dema(q, *spans):
    q.ema(**{f"e{n}": n for n in spans})
    for n in spans:
        q.ema(f"e{n}", at=2 * n - 1, **{f"ee{n}": n})
    return q


def tema(q, *spans):
    dema(q, *spans)
    for n in spans:
        q.ema(f"ee{n}", at=3 * n - 2, **{f"eee{n}": n})
    return q.add(**{f"tema{n}": f"3 * e{n} - 3 * ee{n} + eee{n}" for n in spans})


def kama(q, *spans):
    for n in spans:
        q.add(**{f"d{n}": f"close - {lg('close', n)}", f"v{n}": f"abs(close - {lg('close')})"})
        q.add(**{f"pa{n}": f"sum(v{n}) {ov(n)}", f"y{n}": lg("close")})
        er = f"CASE WHEN pa{n} <= d{n} OR pa{n} = 0 THEN 1.0 ELSE abs(d{n}) / pa{n} END"
        q.add(**{f"w{n}": f"pow(({er}) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2)"})
        q.rec(**{f"kama{n}": ("NULL", f"CASE WHEN n.rn <= {n} THEN NULL WHEN n.rn = {n} + 1 THEN "
                              f"n.y{n} + (n.close - n.y{n}) * n.w{n} ELSE "
                              f"p.kama{n} + (n.close - p.kama{n}) * n.w{n} END")})
    return q


def sma(q, *spans):
    return q.add(**{f"sma{n}": av("close", n) for n in spans})


def vwap(q):
    return q.add(vwap=div(su("close * volume", 20), su("volume", 20)))


def stop(q, name, atr, at, bearish):
    q.add(**{f"{name}u": f"(high + low) / 2 + 3.0 * {atr}", f"{name}l": f"(high + low) / 2 - 3.0 * {atr}"})
    u, lo, s, d = f"n.{name}u", f"n.{name}l", f"p.{name}", f"p.{name}d"
    if bearish:
        line = (f"CASE WHEN {d} = 1 THEN CASE WHEN n.close >= greatest({lo}, {s}) THEN greatest({lo}, {s}) "
                f"ELSE {u} END ELSE CASE WHEN n.close <= least({u}, {s}) THEN least({u}, {s}) ELSE {lo} END END")
        side = (f"CASE WHEN {d} = 1 THEN CASE WHEN n.close >= greatest({lo}, {s}) THEN 1 ELSE -1 END "
                f"ELSE CASE WHEN n.close <= least({u}, {s}) THEN -1 ELSE 1 END END")
        first, fside = u, -1
    else:
        line = f"CASE WHEN n.close > {s} THEN greatest({lo}, {s}) ELSE least({u}, {s}) END"
        side = f"CASE WHEN n.close > {s} THEN 1 ELSE -1 END"
        first, fside = lo, 1
    row = at + 1
    return q.rec(**{name: ("NULL", f"CASE WHEN n.rn < {row} THEN NULL WHEN n.rn = {row} THEN {first} ELSE {line} END"),
                    f"{name}d": ("NULL", f"CASE WHEN n.rn < {row} THEN NULL WHEN n.rn = {row} THEN {fside} ELSE {side} END")})


def stc(q):
    q.macd(23, 50, 10)
    x = "macd"
    for k in (1, 2):
        lo, hi = mi(x, 10), ma(x, 10)
        q.add(**{f"st{k}": f"coalesce(({x} - {lo}) / nullif({hi} - {lo}, 0) * 100, 50)"})
        q.ewm(f"st{k}", **{f"sm{k}": 3})
        x = f"sm{k}"
    return q.add(stc="greatest(0.0, least(100.0, sm2))")


def aroon(q, n):
    hi = f"list(high) {ov(n + 1)}"
    lo = f"list(low) {ov(n + 1)}"
    # position of the latest extreme, counted from the newest row
    return q.add(hs=hi, los=lo).add(
        au=f"CASE WHEN rn > {n} THEN 100.0 * ({n} - (list_position(list_reverse(hs), list_max(hs)) - 1)) / {n} END",
        ad=f"CASE WHEN rn > {n} THEN 100.0 * ({n} - (list_position(list_reverse(los), list_min(los)) - 1)) / {n} END")


def signed_age(q, name, event):
    """Rows since the latest event, with its sign; null before the first."""
    q.add(**{f"e_{name}": event})
    q.rec(**{f"k_{name}": (f"n.e_{name}", f"coalesce(n.e_{name}, p.k_{name})"),
             f"a_{name}": (f"CASE WHEN n.e_{name} IS NOT NULL THEN 0 END",
                           f"CASE WHEN n.e_{name} IS NOT NULL THEN 0 ELSE p.a_{name} + 1 END")})
    return q.add(**{name: f"k_{name} * a_{name}"})


def vix(q):
    return q.raw(f"SELECT t.*, x.vix FROM {{t}} t LEFT JOIN ({VIX}) x ON x.ts = t.ts")


def weekly(q, w, **cols):
    """Columns of the weekly chain ``w``, one week late, matched to the day that
    is the week's Monday and carried forward."""
    late = ", ".join(f"lag({x}) OVER ({P}) AS {c}" for c, x in cols.items())
    sub = f"WITH RECURSIVE {', '.join(w.ctes)} SELECT key, ts, {late} FROM {w.cur}"
    q.raw(f"SELECT t.*, {', '.join('w.' + c + ' AS m_' + c for c in cols)} FROM {{t}} t "
          f"LEFT JOIN ({sub}) w ON w.key = t.key AND w.ts = t.ts")
    return q.add(**{c: f"last_value(m_{c} IGNORE NULLS) {RUN}" for c in cols})


def enough(w, *cols):
    return w.add(**{f"x_{c}": f"CASE WHEN count(*) OVER (PARTITION BY key) >= 20 THEN {c} END"
                    for c in cols})


def perm(a, n, m):
    """Permutation entropy of a list: a pattern is the set of pair orders."""
    pairs = [(i, j) for i in range(m) for j in range(i + 1, m)]
    code = " + ".join(f"CASE WHEN {a}[i + {x}] <= {a}[i + {y}] THEN {2 ** k} ELSE 0 END"
                      for k, (x, y) in enumerate(pairs))
    fact = 1
    for k in range(2, m + 1):
        fact *= k
    return (f"(CASE WHEN {a} IS NOT NULL THEN list_aggregate(list_transform(range(1, {n - m + 2}), "
            f"lambda i: {code}), 'entropy') * ln(2.0) / ln({fact}.0) END)")


def dist(a, i, j, m):
    """Largest coordinate difference of the templates at i and j."""
    return "greatest(" + ", ".join(f"abs({a}[{i} + {k}] - {a}[{j} + {k}])" for k in range(m)) + ")"


def pairs_within(a, templates, m, tol):
    pairs = str([[i, j] for i in range(1, templates + 1) for j in range(i + 1, templates + 1)])
    return f"len(list_filter({pairs}, lambda q: {dist(a, 'q[1]', 'q[2]', m)} < {tol}))"


def approximate(a, n, tol):
    def phi(m):
        t = n - m + 1
        near = f"len(list_filter(range(1, {t + 1}), lambda j: {dist(a, 'i', 'j', m)} <= {tol}))"
        return f"list_avg(list_transform(range(1, {t + 1}), lambda i: ln({near} / {t}.0)))"
    return f"({phi(2)} - {phi(3)})"


def spread(a):
    return f"list_aggregate({a}, 'stddev_pop')"


def before(q, name, n):
    return q.add(**{name: ls("close", n, -1)})


def higuchi(q, a, n, kmax, name):
    """Slope of log curve length on log(1/k), curves summed per k."""
    lens = {}
    for k in range(1, kmax + 1):
        curves = []
        for m in range(1, k + 1):
            idx = list(range(m, n + 1, k))
            if len(idx) < 2:
                continue
            path = " + ".join(f"abs({a}[{x + k}] - {a}[{x}])" for x in idx[:-1])
            curves.append(f"({path}) * {(n - 1)}.0 / ({k} * {len(idx) - 1} * {k})")
        lens[f"{name}{k}"] = f"({' + '.join(curves)}) / {k}"
    q.add(**lens)
    ks = range(1, kmax + 1)
    flat = " OR ".join(f"{name}{k} <= 0" for k in ks)
    xs = [f"(-ln({k}.0))" for k in ks]
    ys = [f"ln({name}{k})" for k in ks]
    sx, sy = " + ".join(xs), " + ".join(ys)
    sxy, sxx = " + ".join(f"{x} * {y}" for x, y in zip(xs, ys)), " + ".join(f"{x} * {x}" for x in xs)
    n_ = kmax
    val = f"({n_} * ({sxy}) - ({sx}) * ({sy})) / ({n_} * ({sxx}) - ({sx}) * ({sx}))"
    return q.add(**{f"{name}_flat": f"({flat})"}).add(
        **{f"{name}_s": f"CASE WHEN {name}_flat THEN NULL ELSE {val} END"})


def candles(q):
    q.pc().add(body="close - open", size="abs(close - open)", rg="high - low",
               top="greatest(open, close)", bot="least(open, close)")
    return q.add(uw="high - top", lw="bot - low", share="size / (rg + 1e-8)", pb=lg("body"))


def volume_stats(q):
    return q.pc().add(vm=av("volume", 20), vs=sd("volume", 20))


def reversal(q):
    candles(q).add(b2=lg("body", 2), s1=lg("share"), mid2=f"({lg('open', 2)} + {lg('close', 2)}) / 2",
                   fu=fl("close > open AND uw / (rg + 1e-8) < 0.3"),
                   fd=fl("close < open AND lw / (rg + 1e-8) < 0.3"),
                   inside=f"(top <= {lg('top')} AND bot >= {lg('bot')})")
    return q.add(
        morning_star_indicator=fl("b2 < 0 AND s1 < 0.3 AND body > 0 AND close > mid2"),
        evening_star_indicator=fl("b2 > 0 AND s1 < 0.3 AND body < 0 AND close < mid2"),
        three_white_soldiers=fl(f"fu + {lg('fu')} + {lg('fu', 2)} = 3"),
        three_black_crows=fl(f"fd + {lg('fd')} + {lg('fd', 2)} = 3"),
        harami_indicator="CASE WHEN inside AND pb < 0 AND body > 0 THEN 1 "
                         "WHEN inside AND pb > 0 AND body < 0 THEN -1 ELSE 0 END")


def entropy_core(q):
    before(q, "a", 20)
    return q.add(pe=perm("a", 20, 4))


def oracle_sql() -> dict[str, str]:
    o = {}

    # --- a20 ---------------------------------------------------------------------
    q = sma(dema(Q(), 9, 10, 20, 25, 90), 12, 50, 100, 200)
    o["F002"] = q.out({**{f"dema_{n}": f"2 * e{n} - ee{n}" for n in (9, 10, 20, 25, 90)},
                       **{f"sma_{n}": f"sma{n}" for n in (12, 50, 100, 200)}})

    def day_osc(q):
        q.rsi(14)
        k = stoch("rsi14", mi("rsi14", 5), ma("rsi14", 5))
        return q.add(srsi=f"CASE WHEN rn >= 21 THEN {k} END")
    o["F003"] = day_osc(Q()).out({"rsi_daily": "rsi14", "stochrsi_daily": "srsi"})
    o["F005"] = weekly(Q(), day_osc(Q(WEEKS)), wr="rsi14", wsr="srsi").out(
        {"rsi_weekly": "wr", "stochrsi_weekly": "wsr"})

    q = vwap(Q().macd().atr(14).adx().bb())
    q.add(mv="CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END",
          ob="CASE WHEN pc IS NULL OR close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END")
    q.rec(ad=("n.mv", "p.ad + n.mv"), obv=("n.ob", "p.obv + n.ob"))
    q.ewm("ad", af=3).ewm("ad", asl=10)
    o["F006"] = q.out({"macd_line": "macd", "adosc": "CASE WHEN rn >= 10 THEN af - asl END",
                       "atr_14": "atr14", "adx_14": "adx",
                       "bb_percent_b": div("close - bl", "bu - bl"), "vwap_20": "vwap", "obv": "obv"})

    idx = """SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS ts,
             avg(o_totalprice / 12500) AS close FROM orders GROUP BY 1, 2"""
    o["F013"] = Q(idx, DIGITS["F013"]).add(pr=below("close", 60)).out(
        {"vix_close": "close", "vix_sma_10": av("close", 10), "vix_sma_20": av("close", 20),
         "vix_percentile_60d": "100 * pr",
         "vix_zscore_20d": nn(div(f"close - {av('close', 20)}", sd("close", 20)), 0),
         "vix_change_1d": pct("close", lg("close")), "vix_change_5d": pct("close", lg("close", 5))},
        {"vix_regime": "CASE WHEN close < 15 THEN 0 WHEN close < 25 THEN 1 ELSE 2 END"},
        where="QUALIFY pr IS NOT NULL")

    # --- a50 ---------------------------------------------------------------------
    o["F014"] = Q().out({f"return_{n}d": pct("close", lg("close", n)) for n in (1, 5, 21, 63, 252)})
    o["F015"] = Q().pc().out({"overnight_gap": pct("open", "pc"),
                              "open_to_close_pct": pct("close", "open")})
    o["F016"] = Q().rsi(14).out({"rsi_slope": slope("rsi14"),
                                 "rsi_extreme_dist": "least(abs(rsi14 - 30), abs(rsi14 - 70))"})
    o["F017"] = sma(Q(), 50, 200).out({"price_pct_from_sma_50": pct("close", "sma50"),
                                       "price_pct_from_sma_200": pct("close", "sma200"),
                                       "sma_50_200_proximity": pct("sma50", "sma200")})
    o["F018"] = Q().atr(14).bb().add(ap="atr14 / close * 100").out(
        {"atr_pct": "ap", "atr_pct_slope": slope("ap"), "bb_width": "(bu - bl) / mid * 100"})
    o["F019"] = Q().macd().out({"volume_ratio_20d": div("volume", av("volume", 20)),
                                "macd_histogram": "hist"})
    q = Q().pc().add(dr="CASE WHEN ret > 0 THEN 0 ELSE ret END")
    o["F020"] = q.out({f"{k}_{n}d": nn(f"{div(av('ret', n), sd(x, n))} * {YEAR}", 0)
                       for n in (20, 60) for k, x in (("sharpe", "ret"), ("sortino", "dr"))})
    q = Q().add(hlc="high + low + close", dm="high - low")
    q.add(tr1=f"CASE WHEN hlc > {lg('hlc')} THEN 1 ELSE -1 END", pdm=lg("dm"))
    q.rec(cm=("n.dm", "CASE WHEN n.tr1 = p.tr0 THEN p.cm + n.dm ELSE n.pdm + n.dm END"),
          tr0=("n.tr1", "n.tr1"))
    q.add(vf="volume * abs(2 * (dm / CASE WHEN cm = 0 THEN 1 ELSE cm END) - 1) * tr1 * 100")
    q.ewm("vf", k1=34, k2=55).add(kvo="k1 - k2").ewm("kvo", ks=13)
    o["F021"] = q.out({"kvo_signal": "ks"})
    q = Q().rsi(14)
    for c, n in (("qf", 5), ("qs", 14)):
        q.rec(**{c: ("n.rsi14", f"coalesce(p.{c} + 2.0 / {n + 1} * (n.rsi14 - p.{c}), n.rsi14)")})
    o["F022"] = q.out({"qqe_fast": "qf", "qqe_slow": "qs", "qqe_fast_slow_spread": "qf - qs"})
    o["F023"] = stc(Q()).out({"stc_value": "stc", "stc_from_50": "stc - 50"})

    def rv(n):
        return f"({sd('lret', n)} * {YEAR} * 100)"
    o["F025"] = vix(Q().pc()).add(r10=rv(10), r21=rv(21)).out(
        {"vrp_10d": "vix - r10", "vrp_21d": "vix - r21",
         "implied_vs_realized_ratio": nn(div("vix", "r21"), 1.0)})

    # --- a100 --------------------------------------------------------------------
    o["F027"] = Q().add(r1=pct("close", lg("close")), r5=pct("close", lg("close", 5))).out(
        {"return_1d_acceleration": slope("r1", 1), "return_5d_acceleration": slope("r5", 1)})
    q = Q().rsi(14).rec(qf=("n.rsi14", "coalesce(p.qf + 2.0 / 6 * (n.rsi14 - p.qf), n.rsi14)"))
    o["F028"] = stc(q).out(
        {"qqe_slope": slope("qf"), "qqe_extreme_dist": "least(abs(qf - 20), abs(qf - 80))",
         "stc_slope": slope("stc"), "stc_extreme_dist": "least(abs(stc - 25), abs(stc - 75))"})
    q = Q().pc().add(dx="greatest(up, 0 * up)", dnn="greatest(dn, 0 * dn)", tp="(high + low + close) / 3",
                     fk=stoch("close", mi("low", 14), ma("high", 14)))
    q.add(sx=av("dx", 14), sn=av("dnn", 14), sk=av("fk", 3), tl=ls("tp", 14), tm=av("tp", 14), ptp=lg("tp"))
    q.add(sdd=av("sk", 3), mad="list_avg(list_transform(tl, lambda v: abs(v - tm)))",
          pf="CASE WHEN tp > ptp THEN tp * volume WHEN ptp IS NOT NULL THEN 0 END",
          nf="CASE WHEN tp < ptp THEN tp * volume WHEN ptp IS NOT NULL THEN 0 END")
    q.add(pf14=su("pf", 14), nf14=su("nf", 14), dmk=nn(div("sx", "sx + sn"), 0.5),
          k14="CASE WHEN sdd IS NOT NULL THEN sk END")
    o["F029"] = q.out(
        {"demarker_value": "dmk", "demarker_from_half": "dmk - 0.5", "stoch_k_14": "k14",
         "stoch_d_14": "sdd", "stoch_extreme_dist": "least(abs(k14 - 20), abs(k14 - 80))",
         "cci_14": "CASE WHEN tl IS NULL THEN NULL WHEN mad = 0 THEN 0 ELSE (tp - tm) / (0.015 * mad) END",
         "mfi_14": "CASE WHEN pf14 + nf14 < 1 THEN 0 ELSE 100 * pf14 / (pf14 + nf14) END",
         "williams_r_14": f"CASE WHEN {ma('high', 14)} = {mi('low', 14)} THEN 0 ELSE "
                          f"-100 * ({ma('high', 14)} - close) / ({ma('high', 14)} - {mi('low', 14)}) END"})
    o["F030"] = vix(Q().pc()).add(v5=f"vix - {rv(5)}").out({"vrp_5d": "v5", "vrp_slope": slope("v5", 1)})

    def sharpe(n):
        return nn(f"{div(av('rp', n), sd('rp', n))} * {YEAR}", 0)

    def sortino(n):
        return nn(f"{div(av('rp', n), f'stddev_samp(CASE WHEN rp < 0 THEN rp END) {ov(n)}')} * {YEAR}", 0)
    q = Q().pc().add(rp="ret * 100").add(s20=sharpe(20), t20=sortino(20))
    o["F031"] = q.out({"sharpe_252d": sharpe(252), "sortino_252d": sortino(252),
                       "sharpe_slope_20d": slope("s20", 1), "sortino_slope_20d": slope("t20", 1)})
    q = Q().pc().add(rp="ret * 100").add(l20=ls("rp", 20)).add(
        v95="list_aggregate(l20, 'quantile_cont', 0.05)", v99="list_aggregate(l20, 'quantile_cont', 0.01)")
    o["F032"] = q.out({"var_95": "v95", "var_99": "v99",
                       "cvar_95": "list_avg(list_filter(l20, lambda v: v <= v95))"})
    o["F033"] = sma(Q().ema(ema12=12, ema26=26), 9, 50, 200).out(
        {"sma_9_50_proximity": pct("sma9", "sma50"), "sma_50_slope": slope("sma50"),
         "sma_200_slope": slope("sma200"), "ema_12": "ema12", "ema_26": "ema26"})
    q = sma(Q(), 50, 200)
    for n in (50, 200):
        q.add(**{f"p{n}": f"CASE WHEN sma{n} IS NULL THEN 9 ELSE sign(close - sma{n}) END"})
        # an unknown side differs from any side, itself included
        q.add(**{f"x{n}": f"(p{n} <> 0 AND coalesce({lg(f'p{n}')}, 9) <> 0 AND (p{n} = 9 OR "
                          f"coalesce({lg(f'p{n}')}, 9) = 9 OR p{n} <> {lg(f'p{n}')}))"})
        q.rec(**{f"d{n}": ("0", f"CASE WHEN n.x{n} THEN 0 ELSE p.d{n} + 1 END")})
    o["F034"] = q.out({}, {f"days_since_sma_{n}_cross": f"CASE WHEN sma{n} IS NULL THEN 0 ELSE d{n} END"
                           for n in (50, 200)})
    q = Q().atr(14).bb().add(ap="atr14 / close * 100", bw="(bu - bl) / mid * 100", hl="pow(ln(high / low), 2)",
                             co="pow(ln(close / open), 2)", rp="ret * 100")
    q.add(gk="0.5 * hl - (2 * ln(2) - 1) * co", r5=f"{sd('rp', 5)} * {YEAR}").add(gm=av("gk", 20))
    o["F035"] = q.out(
        {"atr_pct_percentile_60d": f"100 * {at_or_above('ap', 60)}",
         "bb_width_percentile_60d": f"100 * {at_or_above('bw', 60)}",
         "parkinson_volatility": f"sqrt({av('hl', 20)} / (4 * ln(2)) * 252) * 100",
         "garman_klass_volatility": "sqrt(greatest(gm, 0 * gm) * 252) * 100",
         "vol_of_vol": sd("r5", 20)})
    q = stop(aroon(Q(digits=DIGITS["F036"]).adx().wild("tr", atr10=10), 25), "sl", "atr10", 10, True)
    o["F036"] = q.out({"adx_slope": slope("adx"), "di_spread": "pdi - mdi", "aroon_oscillator": "au - ad",
                       "price_pct_from_supertrend": pct("close", "sl"), "supertrend_direction": "sld"})
    q = Q().pc().add(
        mv="CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END",
        ob="CASE WHEN pc IS NULL OR close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END",
        tp="(high + low + close) / 3", vr="volume * ret")
    q.rec(ad=("n.mv", "p.ad + n.mv"), obv=("n.ob", "p.obv + n.ob"),
          vpt=("NULL", "coalesce(p.vpt, 0) + n.vr"))
    q.add(oc=slope("obv"), f=f"volume * (high - low) * sign(tp - {lg('tp')})")
    q.ewm("f", f1=34, f2=55).add(fk="f1 - f2").ewm("fk", fs=13).add(fh="fk - fs")
    o["F037"] = q.out(
        {"obv_slope": nn(div("oc", sd("oc", 20)), 0),
         "volume_price_trend": nn(div("vpt", f"abs({av('vpt', 20)})"), 0),
         "kvo_histogram": nn(div("fh", sd("fh", 20)), 0),
         "accumulation_dist": nn(div("ad", f"abs({av('ad', 20)})"), 0),
         "buying_pressure_ratio": nn(div("close - low", "high - low"), 0.5)})
    q = Q().pc().add(rp="ret * 100").add(l20=ls("rp", 20)).add(
        w="list_filter(l20, lambda v: v > 0)", lo="list_filter(l20, lambda v: v < 0)")
    o["F038"] = q.out({"win_rate_20d": "len(w) / 20.0",
                       "expectancy_20d": "len(w) / 20.0 * coalesce(list_avg(w), 0) "
                       "- (1 - len(w) / 20.0) * abs(coalesce(list_avg(lo), 0)) + 0 * len(l20)"})
    q = Q().add(h44=ma("high", 44), l44=mi("low", 44))
    o["F039"] = q.out({"fib_range_position": f"CASE WHEN h44 = l44 THEN 0.5 ELSE {div('close - l44', 'h44 - l44')} END",
                       "prior_high_20d_dist": pct("close", ma("high", 20)),
                       "prior_low_20d_dist": pct("close", mi("low", 20))})

    # --- a200 --------------------------------------------------------------------
    o["F041"] = tema(Q(), 9, 20, 50, 100).out({f"tema_{n}": f"tema{n}" for n in (9, 20, 50, 100)})
    o["F042"] = Q().add(**{f"w{n}": wma_list("close", n) for n in (10, 20, 50, 200)}).out(
        {f"wma_{n}": f"w{n}" for n in (10, 20, 50, 200)})
    o["F043"] = kama(Q(), 10, 20, 50).out({f"kama_{n}": f"kama{n}" for n in (10, 20, 50)})
    q = Q(digits=DIGITS["F044"])
    for n, root in ((9, 3), (21, 4), (50, 7)):
        q.add(**{f"h{n}": f"2 * {wma('close', n // 2)} - {wma('close', n)}"}).add(
            **{f"hma{n}": wma(f"h{n}", root)})
    o["F044"] = q.out({f"hma_{n}": f"hma{n}" for n in (9, 21, 50)})
    o["F045"] = Q().out({f"vwma_{n}": f"CASE WHEN {su('volume', n)} = 0 THEN close ELSE "
                         f"{su('close * volume', n)} / {su('volume', n)} END" for n in (10, 20, 50)})
    o["F046"] = kama(tema(Q(), 20, 50), 20).out(
        {"tema_20_slope": slope("tema20"), "price_pct_from_tema_50": pct("close", "tema50"),
         "price_pct_from_kama_20": pct("close", "kama20")})

    def above_below(q, **mas):
        q.streak(**{f"{s}_{k}": f"close {op} {m}" for k, m in mas.items()
                    for s, op in (("up", ">="), ("down", "<"))})
        return q.out({}, {f"days_{w}_{k}": f"{s}_{k}" for k in mas
                          for s, w in (("up", "above"), ("down", "below"))})
    q = vwap(kama(tema(sma(Q(), 9, 50, 200), 20), 20))
    o["F048"] = above_below(q, sma_9="sma9", sma_50="sma50", sma_200="sma200", tema_20="tema20",
                            kama_20="kama20", vwma_20="vwap")
    q = kama(tema(sma(Q(), 9, 50, 200), 20), 20)
    pairs = {"sma_9_50": ("sma9", "sma50"), "sma_50_200": ("sma50", "sma200"),
             "tema_sma_50": ("tema20", "sma50"), "kama_sma_50": ("kama20", "sma50"),
             "sma_9_200": ("sma9", "sma200")}
    o["F050"] = q.sides(**pairs).out({}, {f"days_since_{k}_cross": k for k in pairs})
    o["F051"] = kama(tema(sma(Q(), 9, 50, 200), 20), 20).out(
        {"tema_20_sma_50_proximity": pct("tema20", "sma50"),
         "kama_20_sma_50_proximity": pct("kama20", "sma50"), "sma_9_200_proximity": pct("sma9", "sma200")})
    q = Q().bb().ema(ema20=20).atr(20)
    q.add(sq="bu < ema20 + 1.5 * atr20 AND bl > ema20 - 1.5 * atr20")
    q.streak(hi="close > bu", lo="close < bl", sd="sq")
    o["F052"] = q.out({"pct_from_upper_band": pct("close", "bu"), "pct_from_lower_band": pct("close", "bl")},
                      {"days_above_upper_band": "hi", "days_below_lower_band": "lo",
                       "bb_squeeze_indicator": fl("sq"), "bb_squeeze_duration": "sd"})
    o["F053"] = Q().rsi(14).streak(ob="rsi14 > 70", os="rsi14 < 30").out(
        {"rsi_distance_from_50": "rsi14 - 50", "rsi_percentile_60d": at_or_below("rsi14", 60)},
        {"days_rsi_overbought": "ob", "days_rsi_oversold": "os"})
    q = sma(Q(), 20, 50).add(h=ma("close", 252), l=mi("close", 252), a=ls("close", 252))
    o["F054"] = q.out(
        {"zscore_from_20d_mean": div("close - sma20", sd("close", 20)),
         "zscore_from_50d_mean": div("close - sma50", sd("close", 50)),
         "percentile_in_52wk_range": div("close - l", "h - l"), "distance_from_52wk_high_pct": pct("close", "h")},
        {"days_since_52wk_high": "coalesce(252 - list_position(a, list_max(a)), 0)",
         "days_since_52wk_low": "coalesce(252 - list_position(a, list_min(a)), 0)"})
    q = Q().pc().add(r5=av("high - low", 5), u=fl("close > pc")).streak(us="close > pc", ds="close < pc")
    o["F055"] = q.out({"up_days_ratio_20d": av("u", 20), "range_compression_5d": div("r5", lg("r5", 15))},
                      {"consecutive_up_days": "us", "consecutive_down_days": "ds"})
    q = Q(digits=DIGITS["F056"]).macd().sides(x=("macd", "msig"))
    o["F056"] = q.out({"macd_signal": "msig", "macd_histogram_slope": slope("hist"),
                       "macd_signal_proximity": "hist / CASE WHEN abs(msig) > 0.0001 THEN abs(msig) ELSE 1 END * 100"},
                      {"days_since_macd_cross_signal": "x"})

    def z(x):
        return f"(({x} - {av(x, 20)}) / CASE WHEN {sd(x, 20)} > 0 THEN {sd(x, 20)} ELSE 1 END)"
    q = volume_stats(Q()).add(rp="ret * 100").add(vz=z("volume"), rz=z("rp"),
                                                  hb="CASE WHEN volume > 1.5 * vm THEN rp END")
    q.streak(vi="volume > pv")
    o["F057"] = q.out({"volume_trend_5d": slope("vz"), "volume_price_confluence": "vz * rz",
                       "high_volume_direction_bias": nn(f"avg(hb) {ov(20)}", 0)},
                      {"consecutive_volume_increase": "vi"})
    # business days by listing the calendar
    q = Q().add(dow="CAST(isodow(ts) AS INT) - 1").raw(
        "SELECT t.*, list_filter(list_transform(range(0, 40), lambda i: t.ts + CAST(i AS INT)), "
        "lambda d: isodow(d) <= 5) AS wd FROM {t} t")
    # the first weekday from ts on whose next weekday falls into another month
    q.add(k="list_position(list_transform(range(1, len(wd)), lambda i: month(wd[i]) <> month(wd[i + 1])), true)")
    o["F058"] = q.out({}, {"trading_day_of_week": "dow", "is_monday": fl("dow = 0"), "is_friday": fl("dow = 4"),
                           "days_to_month_end": "k - 1", "month_of_year": "month(ts)",
                           "is_quarter_end_month": fl("month(ts) IN (3, 6, 9, 12)")})

    def share(x, flat):
        return f"CASE WHEN rg > 0 THEN {clip(div(x, 'rg'), 0, 1)} ELSE {flat} END"
    q = candles(Q()).add(br=share("size", 0.5), ar=av("rg", 20))
    o["F059"] = q.out({"candle_body_pct": "size / open * 100", "body_to_range_ratio": "br",
                       "upper_wick_pct": share("uw", 0.0), "lower_wick_pct": share("lw", 0.0),
                       "range_vs_avg_range": "rg / CASE WHEN ar > 0 THEN ar ELSE 1 END"},
                      {"doji_indicator": fl("br < 0.1")})

    def midr(n):
        return f"(({ma('high', n)} + {mi('low', n)}) / 2)"
    q = Q().add(t9=midr(9), k26=midr(26), sb=midr(52)).add(sa="(t9 + k26) / 2")
    o["F060"] = q.out({"tenkan_sen": "t9", "kijun_sen": "k26", "senkou_span_a": "sa", "senkou_span_b": "sb",
                       "cloud_thickness_pct": "(sa - sb) / close * 100"},
                      {"price_vs_cloud": "CASE WHEN close > sa AND close > sb THEN 1 "
                                         "WHEN close < sa AND close < sb THEN -1 ELSE 0 END"})
    q = Q().add(u=ma("high", 20), l=mi("low", 20))
    o["F061"] = q.out(
        {"donchian_upper_20": "u", "donchian_lower_20": "l",
         "donchian_position": f"CASE WHEN u > l THEN {clip(div('close - l', 'u - l'), 0, 1)} ELSE 0.5 END",
         "donchian_width_pct": "(u - l) / close * 100",
         "pct_to_donchian_breakout": "CASE WHEN close >= (u + l) / 2 THEN (u - close) / close * 100 "
                                     "ELSE (l - close) / close * 100 END"})
    q = Q().rsi(14).add(ob="CASE WHEN pc IS NULL THEN 0 ELSE volume * sign(close - pc) END")
    q.add(obv=f"sum(ob) {RUN}").add(pp=at_or_below("close", 20), rr=at_or_below("rsi14", 20),
                                    oo=at_or_below("obv", 20))
    q.add(d1="pp - rr", d2="pp - oo").add(mg="CASE WHEN d1 IS NOT NULL THEN greatest(abs(d1), abs(d2)) END")
    o["F062"] = q.streak(dv="mg > 0.2").out(
        {"price_rsi_divergence": "d1", "price_obv_divergence": "d2", "divergence_magnitude": "mg"},
        {"divergence_streak": "dv"})
    q = Q().atr(14).adx().add(ap="atr14 / close * 100", a=ls("close", 20))
    q.add(ar=at_or_below("ap", 60), dr=at_or_below("adx", 60), **{f"pe{m}": perm("a", 20, m) for m in (3, 4, 5)})
    q.add(vs="CASE WHEN ar > 0.7 THEN 1 WHEN ar < 0.3 THEN -1 ELSE 0 END")
    q.add(ch=f"CASE WHEN {lg('vs')} IS NULL OR vs <> {lg('vs')} THEN 1 ELSE 0 END")
    q.rec(rc=("1", "CASE WHEN n.ch = 1 THEN 1 ELSE p.rc + 1 END"))
    o["F064"] = q.out({**{f"permutation_entropy_order{m}": f"pe{m}" for m in (3, 4, 5)},
                       "entropy_trend_5d": slope("pe4"), "atr_regime_pct_60d": "ar", "atr_regime_rolling_q": "ar",
                       "trend_strength_pct_60d": "dr", "trend_strength_rolling_q": "dr",
                       "regime_transition_prob": av("ch", 20)},
                      {"vol_regime_state": "vs", "regime_consistency": "rc"})

    # --- a500: averages ----------------------------------------------------------
    o["F066"] = sma(Q(), 5, 14, 21, 63).out({f"sma_{n}": f"sma{n}" for n in (5, 14, 21, 63)})
    o["F067"] = Q().ema(**{f"ema{n}": n for n in (5, 9, 50, 100, 200)}).out(
        {f"ema_{n}": f"ema{n}" for n in (5, 9, 50, 100, 200)})
    q = sma(Q().ema(ema9=9, ema50=50, ema100=100), 5, 21, 63)
    o["F068"] = q.out({**{f"sma_{n}_slope": slope(f"sma{n}") for n in (5, 21, 63)},
                       **{f"ema_{n}_slope": slope(f"ema{n}") for n in (9, 50, 100)}})
    q = sma(Q().ema(ema9=9, ema50=50, ema100=100), 5, 21)
    o["F069"] = q.out({f"price_pct_from_{k}_{n}": pct("close", f"{k}{n}") for k, n in
                       (("sma", 5), ("sma", 21), ("ema", 9), ("ema", 50), ("ema", 100))})
    q = sma(Q().ema(ema9=9, ema50=50), 5, 21, 50, 63, 200)
    o["F070"] = q.out({"sma_5_21_proximity": pct("sma5", "sma21"), "sma_21_50_proximity": pct("sma21", "sma50"),
                       "sma_63_200_proximity": pct("sma63", "sma200"), "ema_9_50_proximity": pct("ema9", "ema50")})
    o["F073"] = above_below(sma(Q().ema(ema9=9, ema50=50), 21, 63), ema_9="ema9", ema_50="ema50",
                            sma_21="sma21", sma_63="sma63")
    q = sma(Q().ema(ema9=9, ema50=50, ema200=200), 5, 21, 50, 63)
    pairs = {"ema_9_50": ("ema9", "ema50"), "ema_50_200": ("ema50", "ema200"), "sma_5_21": ("sma5", "sma21"),
             "sma_21_63": ("sma21", "sma63"), "ema_9_sma_50": ("ema9", "sma50")}
    o["F074"] = q.sides(**pairs).out({}, {f"days_since_{k}_cross": k for k in pairs})
    q = sma(Q().ema(ema9=9, ema50=50), 21, 63)
    o["F075"] = q.out({f"{k}_{n}_acceleration": f"{k}{n} - 2 * {lg(f'{k}{n}', 5)} + {lg(f'{k}{n}', 10)}"
                       for k, n in (("ema", 9), ("ema", 50), ("sma", 21), ("sma", 63))})

    def fast5(q):
        return q.add(fk5=stoch("close", mi("low", 5), ma("high", 5))).add(d5=av("fk5", 3)).add(
            k5="CASE WHEN d5 IS NOT NULL THEN fk5 END")
    o["F076"] = fast5(Q().rsi(5, 21)).out({"rsi_5": "rsi5", "rsi_21": "rsi21", "stoch_k_5": "k5", "stoch_d_5": "d5"})
    o["F077"] = fast5(Q().rsi(5, 21)).out(
        {"rsi_5_slope": slope("rsi5"), "rsi_21_slope": slope("rsi21"), "stoch_k_5_slope": slope("k5"),
         "rsi_5_21_spread": "rsi5 - rsi21"})

    # --- a500: volatility ----------------------------------------------------------
    o["F078"] = Q().atr(5, 21).out({"atr_5": "atr5", "atr_21": "atr21", "atr_5_pct": "atr5 / close * 100",
                                    "atr_21_pct": "atr21 / close * 100"})
    q = Q().atr(5, 14, 21).add(ap="atr14 / close * 100").add(aps=slope("ap"))
    o["F079"] = q.out({"atr_5_21_ratio": div("atr5", "atr21"), "atr_expansion_5d": div("atr14", lg("atr14", 5)),
                       "atr_acceleration": slope("aps"), "atr_percentile_20d": below("atr14", 20)})
    q = Q().pc().add(tp="tr / close * 100").add(tm=av("tp", 20)).streak(hv="tp > tm * 1.5")
    o["F080"] = q.out({"tr_pct": "tp", "tr_pct_zscore_20d": div("tp - tm", sd("tp", 20))},
                      {"consecutive_high_vol_days": "hv"})
    q = Q().pc().add(rs="(ln(high) - ln(open)) * (ln(high) - ln(close)) + (ln(low) - ln(open)) * (ln(low) - ln(close))",
                     ov="ln(open) - ln(pc)", oc="ln(close) - ln(open)")
    q.add(rm=av("rs", 20), v1=agg("var_samp(ov)", "ov", 20), v2=agg("var_samp(oc)", "oc", 20))
    o["F081"] = q.out({"rogers_satchell_volatility": f"sqrt(greatest(rm, 0 * rm)) * {YEAR}",
                       "yang_zhang_volatility": f"sqrt(greatest(v1 + 0.34 * v2 + 0.66 * rm, 0 * v1)) * {YEAR}",
                       "historical_volatility_10d": f"{sd('lret', 10)} * {YEAR}"})
    q = Q().bb().add(bw="(bu - bl) / mid * 100").add(bs=slope("bw"))
    o["F082"] = q.out({"bb_width_slope": "bs", "bb_width_acceleration": slope("bs"),
                       "bb_width_percentile_20d": below("bw", 20), "price_bb_band_position": div("close - bl", "bu - bl")})
    q = Q().bb().ema(ema20=20).atr(10).add(ku="ema20 + 1.5 * atr10", kl="ema20 - 1.5 * atr10")
    q.add(kw="(ku - kl) / ema20 * 100")
    o["F083"] = q.out({"kc_width": "kw", "kc_position": div("close - kl", "ku - kl"),
                       "bb_kc_ratio": div("(bu - bl) / mid * 100", "kw")})
    q = Q().atr(5, 21).add(ab="abs(ret)").add(abl=lg("ab"))
    o["F084"] = q.out({"vol_regime_change_intensity": pct("atr5", "atr21"),
                       "vol_clustering_score": f"CASE WHEN count(ab) {ov(20)} = 20 THEN {corr('ab', 'abl', 19)} END"})

    # --- a500: volume ----------------------------------------------------------------
    q = volume_stats(Q()).add(vt=div(f"volume - {lg('volume', 3)}", "vs")).streak(dv="volume < pv")
    o["F085"] = q.out({"volume_trend_3d": "vt", "volume_ma_ratio_5_20": div(av("volume", 5), "vm"),
                       "volume_acceleration": slope("vt", 3)}, {"consecutive_decreasing_vol": "dv"})
    q = vwap(Q()).add(vsl=slope("vwap"), cs=slope("close")).sides(x=("close", "vwap"))
    o["F086"] = q.out({"pct_from_vwap_20": pct("close", "vwap"), "vwap_slope_5d": "vsl",
                       "vwap_pct_change_1d": pct("vwap", lg("vwap"))},
                      {"vwap_price_divergence": fl("sign(cs) <> sign(vsl)"), "price_vwap_cross_recency": "x"})
    q = Q(digits=DIGITS["F087"]).pc().add(
        mv="CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END",
        md="(high + low) / 2", vr="volume * ret")
    q.add(em=f"(md - {lg('md')}) / nullif(volume / 1000000.0 / nullif(high - low, 0), 0)")
    # the weight of the kept average decays over unknown rows
    a = "(2.0 / 15)"
    q.rec(ev=("n.em", f"CASE WHEN n.em IS NULL THEN p.ev WHEN p.ev IS NULL THEN n.em ELSE "
              f"(p.ew * (1 - {a}) * p.ev + {a} * n.em) / (p.ew * (1 - {a}) + {a}) END"),
          ew=("1", f"CASE WHEN n.em IS NULL AND p.ev IS NOT NULL THEN p.ew * (1 - {a}) ELSE 1 END"),
          nvi=("1000", "p.nvi * (1 + CASE WHEN n.volume < n.pv THEN n.ret ELSE 0 END)"),
          pvi=("1000", "p.pvi * (1 + CASE WHEN n.volume > n.pv THEN n.ret ELSE 0 END)"),
          vpt=("NULL", "coalesce(p.vpt, 0) + n.vr"))
    q.ewm("nvi", ne=255).ewm("pvi", pe=255)
    o["F087"] = q.out({"cmf_20": div(su("mv", 20), su("volume", 20)), "emv_14": "ev", "vpt_slope": slope("vpt")},
                      {"nvi_signal": fl("rn >= 255 AND nvi > ne"), "pvi_signal": fl("rn >= 255 AND pvi > pe")})
    q = volume_stats(Q()).add(vz=div("volume - vm", "vs"), rz=div(f"ret - {av('ret', 20)}", sd("ret", 20)),
                              vu=fl("volume > pv"), h20=ma("close", 20))
    o["F088"] = q.out({"sequential_vol_buildup_3d": f"(vu + coalesce({lg('vu')}, 0) + coalesce({lg('vu', 2)}, 0)) / 3.0"},
                      {"volume_spike_price_flat": fl("vz > 2 AND abs(rz) < 0.5"),
                       "volume_price_spike_both": fl("vz > 2 AND abs(rz) > 2"),
                       "vol_breakout_confirmation": fl(f"close > {lg('h20')} AND volume > vm * 1.5")})
    q = volume_stats(Q()).add(ab="abs(ret)")
    q.add(um=f"CASE WHEN rn >= 20 THEN avg(volume) FILTER (WHERE ret >= 0) {ov(20)} END",
          dm=f"CASE WHEN rn >= 20 THEN avg(volume) FILTER (WHERE ret < 0) {ov(20)} END")
    o["F089"] = q.out({"volume_percentile_20d": below("volume", 20), "volume_zscore_20d": div("volume - vm", "vs"),
                       "avg_vol_up_vs_down_days": nn(div("um", "dm"), 1.0),
                       "volume_trend_strength": nn(corr("volume", "ab", 20), 0.0)})

    # --- a500: trend and range -----------------------------------------------------------
    q = Q().adx().add(xs=slope("adx")).sides(x=("pdi", "mdi"))
    o["F090"] = q.out({"plus_di_14": "pdi", "minus_di_14": "mdi", "adx_14_slope": "xs", "adx_acceleration": slope("xs")},
                      {"di_cross_recency": "x"})
    q = Q().pc().add(rp="ret * 100").add(
        us="CASE WHEN rp > 0 THEN rp ELSE 0 END", ds="CASE WHEN rp < 0 THEN -rp ELSE 0 END",
        uc=fl("rp > 0"), dc=fl("rp < 0")).streak(u="rp > 0", d="rp < 0")
    q.add(us20=su("us", 20), ds20=su("ds", 20), uc20=su("uc", 20), dc20=su("dc", 20), mx="greatest(u, d)")
    q.add(au=nn(div("us20", "uc20"), 0.0), ad=nn(div("ds20", "dc20"), 0.0))
    o["F091"] = q.out({"avg_up_day_magnitude": "au", "avg_down_day_magnitude": "ad",
                       "up_down_magnitude_ratio": nn(div("au", "ad"), 1.0),
                       "up_vs_down_momentum": nn(div("us20", "ds20"), 1.0),
                       "directional_bias_strength": "abs(uc20 / 20.0 - 0.5) * 2"},
                      {"trend_persistence_20d": ma("mx", 20)})
    q = sma(Q().atr(14).adx(), 50).add(
        ar="CASE WHEN adx < 20 THEN 0 WHEN adx <= 25 THEN 1 ELSE 2 END",
        sch=f"(sma50 - {lg('sma50', 5)}) / sma50 * 100")
    q.add(ptd="CASE WHEN sch > 0.5 THEN 1 WHEN sch < -0.5 THEN -1 ELSE 0 END")
    q.rec(du=("1", "CASE WHEN n.adx IS NULL OR p.ax IS NULL OR n.ar <> p.arp THEN 1 ELSE p.du + 1 END"),
          ax=("n.adx", "n.adx"), arp=("n.ar", "n.ar"))
    o["F092"] = q.out({"trend_strength_vs_vol": nn(div("adx", "atr14 / close * 1000"), 0.0)},
                      {"adx_regime": "ar", "price_trend_direction": "ptd",
                       "trend_alignment_score": fl("sign(pdi - mdi) = ptd"), "trend_regime_duration": "du"})
    w = ov(20)
    q = Q().add(sl=f"regr_slope(close, rn) {w}", ic=f"regr_intercept(close, rn) {w}", r2=f"regr_r2(close, rn) {w}",
                s0=sp("close", 20))
    q.add(r="CASE WHEN s0 = 0 THEN 1 ELSE r2 END")
    o["F093"] = q.out(
        {"linreg_slope_20d": "CASE WHEN rn >= 20 THEN sl * 252 / close * 100 END",
         "linreg_r_squared_20d": "CASE WHEN rn >= 20 THEN r END",
         "price_linreg_deviation": "CASE WHEN rn >= 20 THEN (close - (ic + sl * rn)) / close * 100 END",
         "channel_width_linreg_20d": "2 * s0 * sqrt(greatest(1 - r, 0)) / close * 100"})
    o["F094"] = aroon(Q(), 25).out({"aroon_up_25": "au", "aroon_down_25": "ad", "aroon_trend_strength": "abs(au - ad) / 100"})
    o["F095"] = Q().out({**{f"range_position_{n}d": nn(clip(div(f"close - {mi('low', n)}", f"{ma('high', n)} - {mi('low', n)}"), 0, 1), 0.5)
                            for n in (20, 50, 252)},
                         "range_width_20d_pct": f"({ma('high', 20)} - {mi('low', 20)}) / close * 100"})
    o["F096"] = Q().out({"pct_from_20d_high": pct("close", ma("high", 20)), "pct_from_20d_low": pct("close", mi("low", 20)),
                         "pct_from_52w_high": pct("close", ma("high", 252)), "pct_from_52w_low": pct("close", mi("low", 252))})
    q = Q().add(**{f"{s}{n}": ls(c, n) for n in (20, 50) for s, c in (("h", "high"), ("l", "low"))})
    o["F097"] = q.out({}, {f"days_since_{n}d_{c}": f"coalesce(list_position(list_reverse({s}{n}), list_{f}({s}{n})) - 1, 0)"
                           for n in (20, 50) for s, c, f in (("h", "high", "max"), ("l", "low", "min"))})
    q = Q().atr(14).add(h=ma("high", 20), l=mi("low", 20)).add(hp=lg("h"), lp=lg("l")).streak(nh="close > hp")
    o["F098"] = q.out({"breakout_strength_20d": f"CASE WHEN close > hp THEN {div('close - hp', 'atr14')} ELSE 0 END"},
                      {"breakout_20d": fl("close > hp"), "breakdown_20d": fl("close < lp"),
                       "consecutive_new_highs_20d": "nh"})
    q = Q().add(r10=f"{ma('high', 10)} - {mi('low', 10)}", r20=f"{ma('high', 20)} - {mi('low', 20)}",
                r50=f"{ma('high', 50)} - {mi('low', 50)}", l20=mi("low", 20))
    q.add(pr=lg("r10"), ns=fl("abs(close - l20) <= l20 * 0.005")).streak(cs="r10 < pr")
    o["F099"] = q.out({"range_expansion_10d": nn(div("r10", lg("r10", 10)), 1.0), "high_low_range_ratio": nn(div("r20", "r50"), 1.0)},
                      {"range_contraction_score": "cs", "support_test_count_20d": su("ns", 20)})
    q = Q().add(h=ma("high", 20), l=mi("low", 20)).add(ps=nn(div("close - l", "h - l"), 0.5))
    q.add(ds="list_transform([0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0], lambda v: abs(v - ps))")
    o["F100"] = q.out({"fib_retracement_level": "([0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0])[list_position(ds, list_min(ds))]",
                       "distance_to_fib_50": nn(div("close - (l + 0.5 * (h - l))", "h - l"), 0.0)})

    # --- a500: candles ---------------------------------------------------------------------
    q = candles(Q()).add(eg=f"bot <= {lg('bot')} AND top >= {lg('top')}")
    q.add(be=fl("eg AND body > 0 AND pb < 0"), se=fl("eg AND body < 0 AND pb > 0")).streak(ce="be = 1 OR se = 1")
    o["F101"] = q.out({"engulfing_score": nn(clip("size / (abs(pb) + 1e-8)", 0, 5), 0.0)},
                      {"bullish_engulfing": "be", "bearish_engulfing": "se", "consecutive_engulfing_count": "ce"})
    q = candles(Q()).add(hs=clip("lw / (size + 1e-8)", 0, 10), ss=clip("uw / (size + 1e-8)", 0, 10))
    o["F102"] = q.out({"hammer_score": "hs", "shooting_star_score": "ss",
                       "wick_rejection_score": "CASE WHEN hs > ss THEN hs WHEN ss > hs THEN -ss ELSE 0 END"},
                      {"hammer_indicator": fl("lw >= 2 * size AND uw <= 0.3 * size"),
                       "shooting_star_indicator": fl("uw >= 2 * size AND lw <= 0.3 * size")})
    q = Q().pc().add(g="open - pc", gp="(open - pc) / (pc + 1e-8) * 100")
    fill = "CASE WHEN g > 0 THEN least(open - low, g) WHEN g < 0 THEN least(high - open, abs(g)) ELSE 0 END"
    o["F103"] = q.out({"gap_size_pct": nn("gp", 0.0), "gap_fill_pct": nn(clip(f"abs({fill}) / (abs(g) + 1e-8) * 100", 0, 100), 0.0)},
                      {"gap_direction": "CASE WHEN gp IS NULL OR gp < -0.1 THEN -1 WHEN gp > 0.1 THEN 1 ELSE 0 END",
                       "gap_filled_today": fl("(open > pc AND low <= pc) OR (open < pc AND high >= pc)"),
                       "significant_gap": fl("abs(gp) > 0.5")})
    q = Q().pc().streak(ci="high <= ph AND low >= pl", co="high > ph AND low < pl")
    o["F104"] = q.out({}, {"inside_day": fl("high <= ph AND low >= pl"), "outside_day": fl("high > ph AND low < pl"),
                           "consecutive_inside_days": "ci", "consecutive_outside_days": "co"})
    q = candles(Q()).add(ar=av("rg", 10)).streak(cn="rg < 0.5 * ar")
    o["F105"] = q.out({"narrow_range_score": nn(clip("ar / (rg + 1e-8)", 0, 10), 0.0)},
                      {"narrow_range_day": fl("rg < 0.5 * ar"), "wide_range_day": fl("rg > 2.0 * ar"),
                       "consecutive_narrow_days": "cn"})

    def directed(q, cond):
        q.add(dr=f"CASE WHEN {cond} AND body > 0 THEN 1 WHEN {cond} AND body < 0 THEN -1 ELSE 0 END")
        return q.rec(ct=("abs(n.dr)", "CASE WHEN n.dr = 0 THEN 0 WHEN n.dr = p.dp THEN p.ct + 1 ELSE 1 END"),
                     dp=("n.dr", "n.dr"))
    td = "(share > 0.7 AND size / (open + 1e-8) * 100 > 0.5)"
    o["F106"] = directed(candles(Q()), td).out({}, {"trend_day_indicator": fl(td), "trend_day_direction": "dr",
                                                    "consecutive_trend_days": "ct"})
    q = candles(Q()).add(dj="share < 0.1", dd="CASE WHEN close > pc THEN 1 WHEN close < pc THEN -1 ELSE 0 END")
    q.streak(cd="dj").rec(tc=("0", "CASE WHEN n.dd = 0 THEN 0 WHEN n.dd = p.td THEN p.tc + 1 ELSE 1 END"), td=("0", "n.dd"))
    o["F107"] = q.out({"doji_score": clip("1 - share", 0, 1)},
                      {"doji_strict_indicator": fl("dj"), "consecutive_doji_count": "cd",
                       "doji_type": "CASE WHEN dj AND uw > 2 * lw + 1e-8 THEN -1 WHEN dj AND lw > 2 * uw + 1e-8 THEN 1 ELSE 0 END",
                       "doji_after_trend": fl(f"dj AND {lg('tc')} >= 3")})
    mz = "((uw + lw) / (rg + 1e-8) < 0.1)"
    o["F108"] = directed(candles(Q()), "share > 0.7").out(
        {"marubozu_strength": clip("share", 0, 1)},
        {"marubozu_indicator": fl(mz), "marubozu_direction": f"CASE WHEN {mz} THEN sign(body) ELSE 0 END",
         "consecutive_strong_candles": "ct"})
    q = candles(Q()).add(st="share < 0.3 AND uw > size AND lw > size").streak(si="st OR share < 0.1")
    o["F109"] = q.out({"spinning_top_score": clip("(uw + lw) / (size + 1e-8)", 0, 10)},
                      {"spinning_top_indicator": fl("st"), "indecision_streak": "si",
                       "indecision_at_extreme": fl(f"st AND (high >= max(high) {ov(20)} * 0.98 OR low <= min(low) {ov(20)} * 1.02)")})
    names = "morning_star_indicator evening_star_indicator three_white_soldiers three_black_crows harami_indicator"
    o["F110"] = reversal(Q()).out({}, names)
    q = candles(Q()).add(pm="(po + pc) / 2", c2=lg("close", 2), c3=lg("close", 3))
    o["F111"] = q.out({}, {"piercing_line": fl("pb < 0 AND body > 0 AND close > pm"),
                           "dark_cloud_cover": fl("pb > 0 AND body < 0 AND close < pm"),
                           "tweezer_bottom": fl("abs(low - pl) / (pl + 1e-8) < 0.001 AND c2 > pc AND c3 > c2"),
                           "tweezer_top": fl("abs(high - ph) / (ph + 1e-8) < 0.001 AND c2 < pc AND c3 < c2")})
    q = reversal(Q()).add(bu=f"morning_star_indicator + three_white_soldiers + {fl('harami_indicator = 1')}",
                          be=f"evening_star_indicator + three_black_crows + {fl('harami_indicator = -1')}")
    o["F112"] = q.out({}, {"reversal_pattern_count_5d": f"sum(bu + be) {ov(5)}",
                           "pattern_alignment_score": f"sign(sum(bu) {ov(5)} - sum(be) {ov(5)})",
                           "pattern_cluster_indicator": fl(f"sum(bu + be) {ov(3)} >= 2")})

    # --- a500: weekly context ---------------------------------------------------------------
    w = sma(Q(WEEKS), 20).add(ws=div(f"sma20 - {lg('sma20', 5)}", lg("sma20", 5))).add(wa=slope("ws", 1))
    enough(w, "sma20", "ws", "wa")
    o["F114"] = weekly(Q(), w, wm="x_sma20", wsl="x_ws", wac="x_wa").out(
        {"weekly_ma_slope": "wsl", "weekly_ma_slope_acceleration": "wac", "price_pct_from_weekly_ma": div("close - wm", "wm")})
    w = Q(WEEKS).rsi(14).add(rs=slope("rsi14")).add(ra=slope("rs", 1))
    enough(w, "rs", "ra")
    o["F115"] = weekly(Q(), w, wsl="x_rs", wac="x_ra").out({"weekly_rsi_slope": "wsl", "weekly_rsi_slope_acceleration": "wac"})
    w = Q(WEEKS).bb().add(bp=div("close - bl", "bu - bl"), bw="(bu - bl) / mid").add(bs=slope("bw"))
    enough(w, "bp", "bw", "bs")
    o["F116"] = weekly(Q(), w, p="x_bp", wi="x_bw", s="x_bs").out(
        {"weekly_bb_position": "p", "weekly_bb_width": "wi", "weekly_bb_width_slope": "s"})
    w = sma(Q(WEEKS).rsi(14).atr(4), 4).add(td=f"sign(sma4 - {lg('sma4')})", ap="atr4 / close").add(vp=place("ap", 12))
    enough(w, "td", "rsi14", "vp")
    q = weekly(sma(Q().rsi(14).atr(14), 20).add(ap="atr14 / close"), w, wt="x_td", wr="x_rsi14", wv="x_vp")
    q.add(dt=f"sign(sma20 - {lg('sma20', 5)})", dv=place("ap", 60))
    o["F117"] = q.out({"rsi_alignment_daily_weekly": "rsi14 - wr", "vol_alignment_daily_weekly": "dv - wv"},
                      {"trend_alignment_daily_weekly": "CASE WHEN dt > 0 AND wt > 0 THEN 1 WHEN dt < 0 AND wt < 0 THEN -1 ELSE 0 END"})

    # --- a500: entropy and fractals -----------------------------------------------------------
    q = entropy_core(Q().pc()).add(tol=f"0.2 * {spread('a')}")
    q.add(mb=pairs_within("a", 18, 2, "tol"), mc=pairs_within("a", 17, 3, "tol"), v=sd("ret", 20))
    q.add(se="CASE WHEN a IS NULL THEN NULL WHEN mb = 0 OR mc = 0 THEN 0 ELSE -ln(CAST(mc AS DOUBLE) / mb) END",
          pp=place("pe", 60), vn=div("v", ma("v", 60))).add(s1=slope("pe"), s2=slope("se"))
    o["F121"] = q.out({"permutation_entropy_slope": "s1", "permutation_entropy_acceleration": slope("s1"),
                       "sample_entropy_20d": "se", "sample_entropy_slope": "s2", "sample_entropy_acceleration": slope("s2"),
                       "entropy_percentile_60d": "pp", "entropy_vol_ratio": clip(div("pe", "vn"), 0, 10),
                       "entropy_regime_score": "(pp - 0.5) * 2"})
    q = before(Q().pc(), "a", 20).add(h="CASE WHEN rn > 20 THEN 0.5 END", rl1=lg("ret"), rl5=lg("ret", 5))
    q.add(c1=f"CASE WHEN count(ret) {ov(20)} = 20 THEN {corr('ret', 'rl1', 19)} END",
          c5=f"CASE WHEN count(ret) {ov(20)} = 20 THEN {corr('ret', 'rl5', 15)} END")
    higuchi(q, "a", 20, 5, "k")
    o["F122"] = q.out({"hurst_exponent_20d": "h", "hurst_exponent_slope": slope("h"), "autocorr_lag1": "c1",
                       "autocorr_lag5": "c5", "autocorr_partial_lag1": "c1",
                       "fractal_dimension_20d": "CASE WHEN k_flat THEN 1.5 ELSE greatest(1.0, least(2.0, k_s)) + 0 * k_s END"})

    def regime(x):
        return f"CASE WHEN {x} < 0.33 THEN -1 WHEN {x} > 0.67 THEN 1 WHEN {x} IS NOT NULL THEN 0 END"
    q = before(Q(), "a", 20).add(tol=f"0.2 * {spread('a')}")
    q.add(ae=f"CASE WHEN tol = 0 THEN 0 WHEN a IS NOT NULL THEN greatest(0.0, {approximate('a', 20, 'tol')}) END")
    q.raw("SELECT * FROM {t}").add(ap=place("ae", 60))
    o["F125"] = q.out({"approx_entropy_20d": "ae", "approx_entropy_slope": slope("ae"), "approx_entropy_percentile_60d": "ap"},
                      {"approx_entropy_regime": regime("ap")})
    q = before(Q().atr(14), "a", 20)
    for k in range(1, 11):
        co = " + ".join(f"a[{i + 1}] * cos(2 * pi() * {k * i} / 20)" for i in range(20))
        si = " + ".join(f"a[{i + 1}] * sin(2 * pi() * {k * i} / 20)" for i in range(20))
        q.add(**{f"p{k}": f"pow({co}, 2) + pow({si}, 2)"})
    q.raw("SELECT * FROM {t}")
    tot = " + ".join(f"p{k}" for k in range(1, 11))
    q.add(tot=tot)
    ent = " + ".join(f"greatest(p{k} / tot, 1e-10) * ln(greatest(p{k} / tot, 1e-10))" for k in range(1, 11))
    q.add(sp=f"CASE WHEN tot = 0 THEN 0.5 WHEN tot > 0 THEN -({ent}) / ln(10.0) END", asr="atr14 / close")
    q.add(spp=place("sp", 60), an=div("asr", ma("asr", 60)))
    o["F126"] = q.out({"spectral_entropy_20d": "sp", "spectral_entropy_slope": slope("sp"), "spectral_entropy_percentile_60d": "spp",
                       "spectral_vs_volatility_ratio": clip(div("sp", "an"), 0, 10)}, {"spectral_entropy_regime": regime("spp")})
    q = entropy_core(Q()).add(a5=ls("close", 5, -1), a10=ls("close", 10, -1)).add(p5=perm("a5", 5, 3), p10=perm("a10", 10, 3))
    lst = "list_filter([p5, p10, pe], lambda v: v IS NOT NULL)"
    o["F127"] = q.out({"entropy_scale_5d": "p5", "entropy_scale_10d": "p10",
                       "entropy_scale_ratio_5_20": clip(div("p5", "pe"), 0.1, 10),
                       "entropy_scale_ratio_10_20": clip(div("p10", "pe"), 0.1, 10),
                       "entropy_scale_consistency": f"CASE WHEN len({lst}) >= 2 THEN list_aggregate({lst}, 'stddev_pop') END"})
    q = entropy_core(Q().atr(14)).add(asr="atr14 / close").add(pp=place("pe", 60), vp=place("asr", 60), pc5=slope("pe"), ac5=slope("asr"))
    q.add(an=ld("ac5", 5), pn=ld("pc5", 5), er=regime("pp"), vr=regime("vp"))
    o["F128"] = q.out({"entropy_vol_divergence": "pp - vp", "entropy_vol_correlation_20d": corr("pe", "asr", 20),
                       "entropy_vol_regime_match": "CAST(er = vr AS DOUBLE)", "hidden_instability_score": "pp * (1 - vp)",
                       "entropy_leading_vol": corr("pc5", "an", 20), "vol_leading_entropy": corr("ac5", "pn", 20)})
    q = entropy_core(Q()).add(pp=place("pe", 60)).add(er=regime("pp"))
    q.add(ch=f"CAST(er <> {lg('er')} AS DOUBLE)", s=sd("pe", 20), t5=slope("pe"))
    q.rec(du=("CASE WHEN n.er IS NOT NULL THEN 1 END", "CASE WHEN n.er IS NULL THEN NULL WHEN n.er = p.ep THEN p.du + 1 ELSE 1 END"),
          ep=("n.er", "n.er"))
    o["F129"] = q.out({"entropy_regime_duration": "du", "entropy_regime_change_count_20d": su("ch", 20),
                       "perm_entropy_trend_5d": "t5", "perm_entropy_acceleration_5d": slope("t5"),
                       "entropy_stability_score": clip(f"1 - {div('s', ma('s', 60))}", 0, 1)})
    q = before(before(Q(), "a", 20), "b", 40)
    q.add(pa="list_sum(list_transform(range(1, 20), lambda i: abs(a[i + 1] - a[i])))",
          ex="list_max(list_transform(a, lambda v: abs(v - a[1])))",
          tn="len(list_filter(range(1, 19), lambda i: (a[i + 1] - a[i] < 0) <> (a[i + 2] - a[i + 1] < 0)))")
    higuchi(q, "b", 40, 10, "k")
    q.raw("SELECT * FROM {t}")
    q.add(kf="log10(19) / (log10(19) + log10(ex / nullif(pa, 0)))",
          pf="CASE WHEN a IS NOT NULL THEN log10(20) / (log10(20) + log10(20 / (20 + 0.4 * tn))) END")
    q.add(fm="(kf + pf) / 2")
    o["F130"] = q.out({"katz_fd_20d": "kf", "katz_fd_slope": slope("kf"), "petrosian_fd_20d": "pf",
                       "petrosian_fd_slope": slope("pf"), "fd_diversity_ratio": div("k_s", "kf"),
                       "fd_regime_score": f"2 * {place('fm', 60)} - 1"})
    q = before(Q(), "b", 40)
    q.raw("""SELECT t.*, d.alpha FROM {t} t LEFT JOIN (
      WITH w AS (SELECT key, rn, list_transform(range(1, 41), lambda i: list_sum(list_transform(b[:i], lambda v: v - list_avg(b)))) AS wk
                 FROM {t} WHERE b IS NOT NULL),
      boxes AS (SELECT key, rn, s, st, unnest(range(0, s)) AS x, wk FROM (
                 SELECT key, rn, wk, s, unnest(range(0, 40 - s, CAST(floor(s / 2) AS BIGINT))) AS st
                 FROM w, (SELECT unnest([4, 5, 6, 7, 8, 9]) AS s))),
      res AS (SELECT key, rn, s, st, sqrt(greatest(regr_syy(wk[st + x + 1], x) - pow(regr_sxy(wk[st + x + 1], x), 2)
                 / regr_sxx(wk[st + x + 1], x), 0) / s) AS f FROM boxes GROUP BY key, rn, s, st),
      fl AS (SELECT key, rn, s, avg(f) AS f FROM res GROUP BY key, rn, s)
      SELECT key, rn, regr_slope(ln(f), ln(s)) AS alpha FROM fl WHERE f > 0 GROUP BY key, rn) d
      ON d.key = t.key AND d.rn = t.rn""")
    q.add(al="CASE WHEN alpha > 0 THEN alpha END")
    o["F131"] = q.out({"dfa_alpha_20d": "al", "dfa_alpha_slope": slope("al"), "dfa_trend_strength": "abs(al - 0.5)",
                       "dfa_crossover_scale": "CASE WHEN b IS NOT NULL AND list_max(b) > list_min(b) THEN 6.0 END"})
    q = before(Q().pc(), "b", 30).add(m="list_avg(b)", ss="list_aggregate(b, 'stddev_samp')")
    q.add(wk="list_transform(range(1, 31), lambda i: list_sum(list_transform(b[:i], lambda v: v - m)))",
          sp14=f"{ma('close', 14)} - {mi('close', 14)}", v=sd("ret", 20))
    q.add(rr="list_max(wk) - list_min(wk)")
    q.add(h="CASE WHEN ss > 0 AND rr > 0 THEN greatest(0.0, least(1.0, ln(rr / ss) / ln(30.0))) END")
    q.add(hr="CASE WHEN h < 0.4 THEN 0 WHEN h < 0.5 THEN 1 WHEN h < 0.6 THEN 2 WHEN h IS NOT NULL THEN 3 END")
    q.rec(cn=("CASE WHEN n.hr IS NOT NULL THEN 1 ELSE 0 END",
              "CASE WHEN n.hr IS NULL THEN p.cn WHEN n.hr = p.hp THEN p.cn + 1 ELSE 1 END"), hp=("n.hr", "coalesce(n.hr, p.hp)"))
    o["F132"] = q.out({"hurst_rs_30d": "h", "hurst_rs_slope": slope("h"), "hurst_regime": "CAST(hr AS DOUBLE)",
                       "hurst_vs_volatility": f"h / ({place('sp14', 50, 1e-10)} + 0.1)",
                       "days_in_hurst_regime": "CASE WHEN hr IS NOT NULL THEN cn END",
                       "hurst_regime_transition_prob": clip(place("v", 50, 1e-10), 0, 1)})
    q = before(Q().atr(14), "b", 30).add(tol=f"0.2 * {spread('b')}")
    q.add(mb=pairs_within("b", 28, 2, "tol"), mc=pairs_within("b", 28, 3, "tol"),
          ae=f"CASE WHEN tol > 0 THEN {approximate('b', 30, 'tol')} WHEN tol = 0 THEN 0 END")
    q.raw("SELECT * FROM {t}").add(se="CASE WHEN mb > 0 AND mc > 0 THEN -ln(CAST(mc AS DOUBLE) / mb) END")
    q.add(q3=agg("quantile_cont(se, 0.3)", "se", 50), q7=agg("quantile_cont(se, 0.7)", "se", 50))
    o["F133"] = q.out({"sample_entropy_30d": "se", "approximate_entropy_30d": "ae", "entropy_atr_ratio": "se / (atr14 / close + 1e-10)",
                       "entropy_regime": "CASE WHEN se <= q3 THEN 0.0 WHEN se <= q7 THEN 1.0 WHEN se > q7 THEN 2.0 END",
                       "entropy_change_10d": slope("se", 10)})
    q = aroon(Q(), 14).add(os="au - ad")
    q.add(po=lg("os"))
    signed_age(q, "cr", "CASE WHEN po <= 0 AND os > 0 THEN 1 WHEN po >= 0 AND os < 0 THEN -1 END")
    o["F134"] = q.out({"aroon_up_14": "au", "aroon_down_14": "ad", "aroon_oscillator_14": "os", "aroon_crossover_recency": "cr",
                       "aroon_consolidation": "CASE WHEN au IS NOT NULL THEN CAST(au BETWEEN 30 AND 70 AND ad BETWEEN 30 AND 70 AS DOUBLE) END"})
    q = Q(digits=DIGITS["F135"]).bb().ema(ema20=20).atr(14, 20)
    q.add(sq="CAST(bl > ema20 - 1.5 * atr20 AND bu < ema20 + 1.5 * atr20 AS DOUBLE)", mom=slope("close", 14)).add(ps=lg("sq"))
    q.streak(sdu="sq = 1")
    signed_age(q, "fr", "CASE WHEN ps = 1 AND sq = 0 THEN CASE WHEN mom > 0 THEN 1 ELSE -1 END END")
    stop(q, "s14", "atr14", 14, False)
    q.add(pd=lg("s14d"))
    signed_age(q, "fl", "CASE WHEN s14d <> pd THEN s14d END")
    stop(q, "s20", "atr20", 20, False)
    o["F135"] = q.out({"squeeze_on_14": "sq", "squeeze_duration_14": "CASE WHEN sq IS NOT NULL THEN sdu END",
                       "squeeze_fire_recency": "fr", "supertrend_flip_recency_14": "fl",
                       "pct_from_supertrend_20": pct("close", "s20"), "supertrend_slope": slope("s20")})
    q = volume_stats(Q()).add(m=f"close / {lg('close', 20)} - 1", vr=clip("volume / (vm + 1e-10)", 0.5, 2), v=sd("ret", 20),
                              pp=f"(close - {mi('close', 20)}) / ({ma('close', 20)} - {mi('close', 20)} + 1e-10)")
    q.add(vp=place("v", 50, 1e-10), pu=clip("m", -0.2, 0.2), pm=fl("m > 0"), nm=fl("m < 0"))
    q.add(s0=clip("(1 - pp) * 0.4 + vr / 2 * 0.3 + (1 - vp) * 0.3", 0, 1),
          s1=clip("pm * 0.3 + pu / 0.2 * 0.3 + vr / 2 * 0.2 + pp * 0.2", 0, 1),
          s2=clip("pp * 0.4 + vr / 2 * 0.3 + vp * 0.3", 0, 1),
          s3=clip("nm * 0.3 + -pu / 0.2 * 0.3 + vr / 2 * 0.2 + (1 - pp) * 0.2", 0, 1))
    q.add(mx="greatest(s0, s1, s2, s3)")
    o["F136"] = q.out({"accumulation_score": "s0", "markup_score": "s1", "distribution_score": "s2", "markdown_score": "s3",
                       "cycle_phase": "CASE WHEN s0 = mx THEN 0.0 WHEN s1 = mx THEN 1.0 WHEN s2 = mx THEN 2.0 WHEN s3 = mx THEN 3.0 END",
                       "cycle_phase_confidence": "mx"})

    return {f"{g}_{TITLES[g]}": s for g, s in o.items()}
