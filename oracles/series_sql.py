"""DuckDB queries for resampling, labels, splits, samples and regimes."""

from __future__ import annotations

from oracles.base import BARS, P, RUN, VIX, WEEKS, Q, av, fl, ld, lg, ov, pct, rnd, sp

TSV = "CAST(ts AS VARCHAR) AS ts"


def u(*parts):
    """The hash-based uniform number."""
    s = "concat_ws(':', " + ", ".join(parts) + ")"
    return f"(CAST('0x' || substr(md5({s}), 1, 13) AS BIGINT) / pow(2.0, 52))"


def normal(seed, *parts):
    return f"(sqrt(-2 * ln(1 - {u(f'{seed!r}'[:-1] + 'a' + chr(39), *parts)})) * cos(2 * pi() * {u(f'{seed!r}'[:-1] + 'b' + chr(39), *parts)}))"


ID = ("CAST(key AS VARCHAR)", "CAST(ts AS VARCHAR)")
OHLCV = {"open": "open", "high": "high", "low": "low", "close": "close"}


def merged(label, src):
    return (f"SELECT key, {label} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, "
            f"arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM ({src}) GROUP BY 1, 2")


def simple(sql, cols, ints=(), keys="key, " + TSV, digits=6):
    parts = [keys] if keys else []
    parts += [f"{rnd(c, digits)} AS {c}" for c in cols]
    parts += [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
    return f"SELECT {', '.join(parts)} FROM ({sql})"


def samples5(q, context=5, horizon=1, thr=0.01):
    """Contexts as lists with a label from the next highs."""
    q.add(fh=f"CASE WHEN count(high) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING) = {horizon} "
             f"THEN max(high) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING) END",
          x=f"list(close) {ov(context)}")
    return q.raw(f"SELECT key, ts, rn, x, CASE WHEN fh >= close * {1 + thr} THEN 1 ELSE 0 END AS label "
                 f"FROM {{t}} WHERE rn >= {context} AND fh IS NOT NULL")


def exploded(q, value="x[i + 1]", extra="", context=5):
    return (f"WITH RECURSIVE {', '.join(q.ctes)} SELECT key, {TSV}, {extra} CAST(i AS BIGINT) AS pos, "
            f"{rnd(value)} AS value FROM {q.cur}, range(0, {context}) g(i)")


def chunk(context, horizon, val, test, scattered=False):
    size = context + horizon
    q = Q().add(pos="rn - 1", n="count(*) OVER (PARTITION BY key)")
    q.add(ch=f"pos // {size}", nc=f"n // {size}").add(
        nv=f"greatest(1, CAST(floor(nc * {val}) AS BIGINT))", nt=f"greatest(1, CAST(floor(nc * {test}) AS BIGINT))")
    if scattered:
        h = "md5(concat_ws(':', '42', CAST(key AS VARCHAR), CAST(ch AS VARCHAR)))"
        q.raw(f"SELECT t.*, r.rk FROM {{t}} t LEFT JOIN (SELECT key, ch, row_number() OVER (PARTITION BY key "
              f"ORDER BY h) - 1 AS rk FROM (SELECT DISTINCT key, ch, {h} AS h FROM {{t}} WHERE ch < nc)) r "
              f"ON r.key = t.key AND r.ch = t.ch")
        q.add(part="CASE WHEN rk < nv THEN 'val' WHEN rk < nv + nt THEN 'test' END")
    else:
        q.add(part="CASE WHEN ch >= nc THEN NULL WHEN ch >= nc - nt THEN 'test' WHEN ch >= nc - nt - nv THEN 'val' END")
    # a train start is free when no row of its span is blocked
    q.add(blk="sum(CASE WHEN part IS NOT NULL THEN 1 ELSE 0 END) " + RUN)
    q.add(ahead=f"lead(blk, {size - 1}) OVER ({P}) - blk + CASE WHEN part IS NOT NULL THEN 1 ELSE 0 END")
    return q.add(split=f"CASE WHEN part IS NOT NULL THEN CASE WHEN pos % {size} = 0 THEN part END "
                       f"WHEN pos + {size} <= n AND ahead = 0 THEN 'train' END")


def returns_in_context(q, absolute=False):
    base = "abs(pc)" if absolute else "pc"
    return q.add(pc=lg("close")).add(r=f"(close - pc) / ({base} + 1e-8)")


def prediction_sql():
    h = "((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 997) / 996.0"
    y = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"
    return (f"SELECT 'run_' || l_linenumber AS run_id, l_orderkey AS sample_id, "
            f"round(0.05::DOUBLE + 0.7::DOUBLE * ({h})::DOUBLE + 0.2::DOUBLE * {y}, 3) AS prob, {y} AS label, "
            f"l_tax - l_discount AS actual_return FROM lineitem")


QUALITY = """SELECT 'length' AS run_id, d.doc_id AS sample_id, round(n_chars / (n_chars + 1000.0::DOUBLE), 4) AS prob,
  quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""


def seeded_average(src, x, y, alpha, n, reach):
    """Adds y: the average with weight alpha, seeded with the mean of the first n values.
    Beyond `reach` rows a weight is under 1e-17."""
    first = f"SELECT *, min(CASE WHEN {x} IS NOT NULL THEN rn END) OVER (PARTITION BY key) + {n - 1} AS s_{y} FROM {src}"
    seed = f"SELECT *, avg(CASE WHEN rn <= s_{y} THEN {x} END) OVER (PARTITION BY key) AS m_{y} FROM ({first})"
    fed = f"SELECT *, CASE WHEN rn = s_{y} THEN m_{y} / {alpha} WHEN rn > s_{y} THEN {x} END AS v_{y} FROM ({seed})"
    held = f"list(v_{y}) OVER (PARTITION BY key ORDER BY rn ROWS BETWEEN {reach - 1} PRECEDING AND CURRENT ROW)"
    weights = f"(SELECT list({alpha} * pow(1 - {alpha}, {reach - 1} - k) ORDER BY k) FROM range({reach}) r(k))"
    return (f"SELECT * EXCLUDE (l_{y}, s_{y}, m_{y}, v_{y}), CASE WHEN rn >= s_{y} THEN list_inner_product(l_{y}, list_slice({weights}, {reach} - len(l_{y}) + 1, {reach})) END AS {y} "
            f"FROM (SELECT * EXCLUDE v_{y}, v_{y}, list_filter({held}, lambda e: e IS NOT NULL) AS l_{y} FROM ({fed}))")


def long_series() -> str:
    """Averages of every line's price, one series per return flag."""
    from oracles.base import PAID

    ctes = [f"t0 AS (SELECT l_returnflag AS key, CAST(l_shipdate AS VARCHAR) AS ts, l_orderkey, l_linenumber, l_partkey, {PAID} AS price, "
            "row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem)",
            "t1 AS (SELECT *, price - lag(price) OVER (PARTITION BY key ORDER BY rn) AS d FROM t0)",
            "t2 AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS down FROM t1)"]
    for i, (x, y, n, alpha, reach) in enumerate((
            ("price", "e1", 9, "0.2::DOUBLE", 180), ("e1", "e2", 9, "0.2::DOUBLE", 180), ("e2", "e3", 9, "0.2::DOUBLE", 180),
            ("up", "gain", 7, "(1 / 7.0::DOUBLE)", 270), ("down", "loss", 7, "(1 / 7.0::DOUBLE)", 270)), 3):
        ctes.append(f"t{i} AS MATERIALIZED ({seeded_average(f't{i - 1}', x, y, alpha, n, reach)})")
    cols = {"price": "price", "average": "e1", "triple": "3 * e1 - 3 * e2 + e3", "strength": "CASE WHEN gain + loss = 0 THEN 0 ELSE 100 * gain / (gain + loss) END"}
    return f"WITH {', '.join(ctes)} SELECT key, ts, l_orderkey, l_linenumber, l_partkey, {', '.join(f'{rnd(e)} AS {c}' for c, e in cols.items())} FROM t7"


def oracle_sql() -> dict[str, str]:
    o = {"SCAN_long_series": long_series()}
    o["F001_bars"] = simple(BARS, OHLCV, ["volume"])
    from oracles.base import bars as bars_of
    o["F001_bars_hot_key"] = simple(bars_of("l_returnflag"), OHLCV, ["volume"])
    o["S02_normalised_bars"] = simple(BARS, OHLCV, ["volume"], keys="CAST(key AS VARCHAR) AS key, " + TSV)
    o["S02_null_counts"] = (f"SELECT count(*) AS rows, count(*) - count(key) AS null_key, count(*) - count(b.ts) AS null_ts, "
                            f"count(*) - count(vix) AS null_vix FROM ({BARS}) b LEFT JOIN ({VIX}) v ON v.ts = b.ts")
    for n in (2, 3, 5):
        src = f"SELECT b.*, min(ts) OVER (PARTITION BY key) AS f FROM ({BARS}) b"
        bins = f"SELECT *, f + CAST({n} * CAST(ceil((ts - f) / {n}.0) AS INT) AS INT) AS bin FROM ({src})"
        o[f"R01_resample_{n}d"] = simple(merged("bin", bins), OHLCV, ["volume"])
    fri = f"SELECT *, ts + CAST((12 - isodow(ts)) % 7 AS INT) AS bin FROM ({BARS})"
    o["R02_resample_weekly"] = simple(merged("bin", fri), OHLCV, ["volume"])
    o["R03_timescale_names"] = (f"SELECT key, count(DISTINCT (ts - f + 4) // 5) AS bars, CAST(sum(volume) AS BIGINT) AS volume "
                                f"FROM (SELECT b.*, min(ts) OVER (PARTITION BY key) AS f FROM ({BARS}) b) GROUP BY key")
    o["R04_week_start"] = simple(WEEKS, OHLCV, ["volume"])
    w = Q(WEEKS).add(s5=av("close", 5), r1=pct("close", lg("close")))
    late = f"WITH RECURSIVE {', '.join(w.ctes)} SELECT key, ts, {lg('s5')} AS s5, {lg('r1')} AS r1 FROM {w.cur}"
    o["R05_weekly_to_daily"] = Q().raw(
        f"SELECT t.*, w.s5, w.r1 FROM {{t}} t LEFT JOIN ({late}) w ON w.key = t.key AND w.ts = t.ts").out(
        {"weekly_sma_5": f"last_value(s5 IGNORE NULLS) {RUN}", "weekly_return": f"last_value(r1 IGNORE NULLS) {RUN}"})
    o["R05_weekly_asof"] = Q().raw(
        f"SELECT t.*, w.s5 FROM {{t}} t LEFT JOIN ({late}) w ON w.key = t.key "
        f"AND w.ts = CAST(date_trunc('week', t.ts) AS DATE)").out({"weekly_sma_5": "s5"})
    second = f"SELECT b.*, v.vix FROM ({BARS}) b LEFT JOIN ({VIX}) v ON v.ts = b.ts"
    o["R06_second_series"] = simple(second, ["vix"], digits=4)
    o["R07_join_one_to_one"] = Q().add(s=av("close", 12), r=pct("close", lg("close"))).out(
        {"close": "close", "sma_12": "s", "return_1d": "r"}, where="WHERE s IS NOT NULL AND r IS NOT NULL")
    o["R07_duplicate_keys"] = ("SELECT l_suppkey AS key, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ts, count(*) AS n "
                               "FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
    o["R08_overlap"] = (f"SELECT CAST(ts AS VARCHAR) AS ts FROM (SELECT ts FROM ({BARS}) INTERSECT SELECT ts FROM ({VIX}))")
    q = Q().add(a=av("close", 12), b=av("close", 50), r=pct("close", lg("close", 5)), pc=lg("close"))
    q.add(ob=f"sum(CASE WHEN pc IS NULL OR close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) {RUN}")
    o["R09_tier_join"] = q.out({"sma_12": "a", "sma_50": "b", "return_5d": "r", "obv": "ob"}, where="WHERE b IS NOT NULL AND r IS NOT NULL")

    def fm(x, h):
        w = f"OVER ({P} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        return f"(CASE WHEN count({x}) {w} = {h} THEN max({x}) {w} END)"
    q = Q().add(m1=fm("close", 1), m5=fm("close", 5), s=av("close", 12))
    o["R10_aligned_labels"] = q.out({"future_max_h1": "m1", "future_max_h5": "m5"},
                                    {"label_h1_t1pct": "m1 >= close * 1.01", "label_h5_t1pct": "m5 >= close * 1.01"},
                                    where="WHERE m5 IS NOT NULL AND s IS NOT NULL")
    o["R11_fill_gaps"] = Q(second, 4).out({"vix": f"last_value(vix IGNORE NULLS) {RUN}"})
    o["R11_fill_gaps_back"] = Q(second, 4).add(f=f"last_value(vix IGNORE NULLS) {RUN}").out(
        {"vix": f"coalesce(f, first_value(f IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"})
    o["R12_pivot_count"] = ("SELECT o_orderpriority, " + ", ".join(
        f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders GROUP BY 1")
    o["R12_pivot_first"] = ("SELECT o_orderpriority, " + ", ".join(
        f"round(max(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 6) AS {s}" for s in "FOP") + " FROM orders GROUP BY 1")
    q = Q().add(pc=lg("close"), nh=ld("high"))
    o["R13_panel"] = q.out({"y": "close / pc - 1"}, {"threshold_target": fl("nh >= close * 1.01"), "volume": "volume"},
                           keys="key AS unique_id, CAST(ts AS VARCHAR) AS ds",
                           where="WHERE pc IS NOT NULL AND nh IS NOT NULL AND ts >= '1996-01-01' AND ts < '2000-01-01'")
    o["R13_panel_prices"] = Q().add(pc=lg("close"), nh=ld("high")).out(
        {"y": "close"}, {"threshold_target": fl("nh >= close * 1.01")}, keys="key AS unique_id, CAST(ts AS VARCHAR) AS ds",
        where="WHERE pc IS NOT NULL AND nh IS NOT NULL")
    o["R14_union_rows"] = ("SELECT o_orderkey AS id, round(o_totalprice, 6) AS value, NULL AS name FROM orders UNION ALL "
                           "SELECT s_suppkey, NULL, s_name FROM supplier")

    # --- labels and splits ---------------------------------------------------------------
    o["D01_future_max"] = Q().out({f"future_max_h{h}": fm("close", h) for h in (1, 2, 3, 5)})
    q = Q().add(**{f"m{h}": fm("close", h) for h in (1, 2, 3, 5)})
    o["D02_threshold_labels"] = q.out(
        {f"future_max_h{h}": f"m{h}" for h in (1, 2, 3, 5)},
        {f"label_h{h}_t{t}pct": f"m{h} >= close * {1 + t / 100}" for h in (1, 2, 3, 5) for t in (1, 2, 5)},
        where="WHERE m5 IS NOT NULL")
    o["D03_high_label"] = Q().add(h=fm("high", 3), c=fm("close", 3)).out(
        {}, {"by_high": "h >= close * 1.05", "by_close": "c >= close * 1.05"})
    o["D04_next_return_label"] = Q().add(nc=ld("close")).out({}, {"target": fl("nc / close - 1 > 0.01")})
    q = Q().raw("SELECT key, " + ", ".join(f"avg({c}) FILTER (WHERE rn <= 300) AS {c}__mean, "
                f"coalesce(stddev_samp({c}) FILTER (WHERE rn <= 300), 0) AS {c}__sd" for c in ("close", "volume"))
                + " FROM {t} GROUP BY key")
    o["D05_normalisation_fit"] = q.out("close__mean close__sd volume__mean volume__sd", keys="key")
    q = Q().raw("SELECT t.*, " + ", ".join(f"avg({c}) FILTER (WHERE rn <= 300) OVER (PARTITION BY key) AS m_{c}, "
                f"stddev_samp({c}) FILTER (WHERE rn <= 300) OVER (PARTITION BY key) AS s_{c}" for c in ("close", "volume"))
                + " FROM {t} t")
    o["D06_normalised"] = q.out({c: f"({c} - m_{c}) / (s_{c} + 1e-8)" for c in ("close", "volume")})
    q = Q().raw("SELECT t.*, avg(close) FILTER (WHERE ts < '2000-01-01') OVER (PARTITION BY key) AS m, "
                "stddev_pop(close) FILTER (WHERE ts < '2000-01-01') OVER (PARTITION BY key) AS s FROM {t} t")
    o["D07_population_normalised"] = q.out({"close": "(close - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END", "flat": "0.0"})
    o["D08_instance_normalised"] = exploded(
        samples5(Q()), "(x[i + 1] - list_avg(x)) / (list_aggregate(x, 'stddev_samp') + 1e-5)")

    o["D08_instance_denormalised"] = exploded(samples5(Q()), "x[i + 1] + 0.05 * (list_aggregate(x, 'stddev_samp') + 1e-5)")

    def split_out(q, where=""):
        return q.out({}, {"start": "rn - 1"}, keys="key, CAST(ts AS VARCHAR) AS ts, split", where=where)
    o["D09_chunk_split"] = split_out(chunk(15, 5, 0.15, 0.15))
    o["D10_chunk_split_scattered"] = split_out(chunk(15, 5, 0.15, 0.15, True))
    o["D11_train_starts"] = split_out(chunk(30, 5, 0.2, 0.1), "WHERE split = 'train'")
    h = "md5(concat_ws(':', '42', CAST(key AS VARCHAR), CAST(rn - 1 AS VARCHAR)))"
    q = chunk(15, 5, 0.15, 0.15).raw("SELECT * FROM {t} WHERE split = 'train'")
    q.add(k=f"row_number() OVER (PARTITION BY key ORDER BY {h})", m="count(*) OVER (PARTITION BY key)")
    o["D12_train_subset"] = split_out(q, "WHERE k <= greatest(1, floor(m * 0.3))")
    q = Q().add(n="count(*) OVER (PARTITION BY key)", v="count(*) FILTER (WHERE ts < '1999-01-01') OVER (PARTITION BY key)",
                t="count(*) FILTER (WHERE ts < '2000-07-01') OVER (PARTITION BY key)")
    o["D13_date_split"] = split_out(q.add(
        split="CASE WHEN rn + 19 <= v THEN 'train' WHEN rn > v AND rn + 19 <= t THEN 'val' WHEN rn > t AND rn + 19 <= n THEN 'test' END"))
    q = Q().add(pt=ld("ts", 14), e=ld("ts", 19))
    o["D14_prediction_dates"] = q.out({}, {"start": "rn - 1"}, keys="key, CAST(ts AS VARCHAR) AS ts, CAST(pt AS VARCHAR) AS prediction_ts",
                                      where="WHERE pt >= '2000-07-01' AND e IS NOT NULL")
    q = Q().add(split="CASE WHEN ts < '1999-01-01' THEN 'train' WHEN ts < '2000-07-01' THEN 'val' ELSE 'test' END")
    o["D15_target_date_split"] = q.out({}, {"start": "rn - 16"}, keys="key, CAST(ts AS VARCHAR) AS ts, split", where="WHERE rn > 15")
    o["D16_samples"] = exploded(samples5(Q()), extra="CAST(label AS BIGINT) AS label,")
    o["D17_sample_counts"] = f"SELECT key, count(*) - 84 AS n_samples FROM ({BARS}) GROUP BY key"
    q = Q().add(s=av("close", 12), r=pct("close", lg("close"))).raw("SELECT * FROM {t} WHERE s IS NOT NULL")
    body = f"WITH RECURSIVE {', '.join(q.ctes)} "
    o["D18_feature_columns"] = body + (f"SELECT 'sma_12' AS name, {rnd('avg(s)', 4)} AS mean, count(s) AS n FROM {q.cur} UNION ALL "
                                       f"SELECT 'return_1d', {rnd('avg(r)', 4)}, count(r) FROM {q.cur}")
    q = samples5(Q(), 10)
    o["D19_patches"] = (f"WITH RECURSIVE {', '.join(q.ctes)} SELECT key, {TSV}, CAST(i AS BIGINT) AS patch, CAST(4 AS BIGINT) AS length, "
                        f"round(x[2 * i + 1], 6) AS first, round(x[2 * i + 4], 6) AS last FROM {q.cur}, range(0, 4) g(i)")
    q = Q(second, 4).add(s=av("close", 12), r=pct("close", lg("close")), m=fm("close", 1))
    o["D20_combined_dataset"] = q.out(
        {**OHLCV, "sma_12": "s", "return_1d": "r", "vix": "vix", "future_max_h1": "m"},
        {"volume": "volume", "label_h1_t1pct": "m >= close * 1.01"},
        where="WHERE s IS NOT NULL AND m IS NOT NULL AND vix IS NOT NULL")
    q = chunk(15, 5, 0.15, 0.15).add(m=fm("high", 5)).add(y="CASE WHEN m IS NOT NULL THEN CAST(m >= close * 1.2 AS DOUBLE) END")
    q.raw("SELECT split, count(*) AS n_samples, min(ts) AS first_ts, max(ts) AS last_ts, avg(y) AS positive_ratio "
          "FROM {t} WHERE split IS NOT NULL GROUP BY split")
    o["D21_split_statistics"] = q.out("positive_ratio", "n_samples",
                                      keys="split, CAST(first_ts AS VARCHAR) AS first_ts, CAST(last_ts AS VARCHAR) AS last_ts")

    # --- samples and regimes --------------------------------------------------------------
    pos = "CAST(i AS VARCHAR)"
    chosen = u("'42j'", *ID)
    o["G01_jitter"] = exploded(samples5(Q()), f"x[i + 1] + CASE WHEN {chosen} <= 0.5 THEN 0.5 * {normal('42', *ID, pos)} ELSE 0 END")
    factor = f"(1 + ({u(chr(39) + '42' + chr(39), *ID)} * 2 - 1) * 0.1)"
    sc = u("'42s'", *ID)
    o["G02_scale"] = exploded(samples5(Q()), f"x[i + 1] * CASE WHEN {sc} <= 0.5 THEN {factor} ELSE 1 END")
    own = [f"CASE WHEN {sc} <= 0.5 THEN 1 + ({u(repr('42' + c), *ID)} * 2 - 1) * 0.1 ELSE 1 END" for c in "xz"]
    o["G02_scale_features"] = exploded(samples5(Q()), f"x[i + 1] * ({own[0]}) + 2 * x[i + 1] * ({own[1]})")
    # warped time: sorted inner knots, linear between knots and between values
    q = samples5(Q())
    knots = ", ".join(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {k} / 5.0::DOUBLE + ({u(repr('42k' + str(k)), *ID)} * 2 - 1) * 0.1))" for k in range(1, 5))
    q.add(path=f"[0.0] || list_sort([{knots}]) || [1.0]", ch=f"{u(repr('42w'), *ID)} <= 0.5")
    q.raw("SELECT *, least(4, CAST(floor(i / 4.0::DOUBLE * 5) AS INT)) AS k FROM {t}, range(0, 5) g(i)")
    q.add(sh="i / 4.0::DOUBLE * 5 - k").add(at_="(path[k + 1] * (1 - sh) + path[k + 2] * sh) * 4")
    q.add(lo="greatest(0, least(4, CAST(floor(at_) AS INT)))")
    o["G04_time_warp"] = (f"WITH RECURSIVE {', '.join(q.ctes)} SELECT key, {TSV}, CAST(i AS BIGINT) AS pos, "
                          f"{rnd('CASE WHEN ch THEN x[lo + 1] * (1 - (at_ - lo)) + x[least(4, lo + 1) + 1] * (at_ - lo) ELSE x[i + 1] END')} AS value FROM {q.cur}")
    o["G05_compose"] = exploded(samples5(Q()), f"x[i + 1] * {factor} + 0.1 * {normal('42', *ID, pos)}")
    q = returns_in_context(Q()).add(d=f"stddev_pop(r) {ov(19)}")
    o["G06_volatility_difficulty"] = q.out({"difficulty": "d"}, where="WHERE rn >= 20")
    o["G07_confidence_difficulty"] = f"SELECT sample_id, {rnd('1 - greatest(prob, 1 - prob)')} AS difficulty FROM ({QUALITY})"
    p = "greatest(1e-7, least(1 - 1e-7, prob))"
    o["G08_loss_difficulty"] = f"SELECT sample_id, {rnd(f'CASE WHEN label = 1 THEN -ln({p}) ELSE -ln(1 - {p}) END')} AS difficulty FROM ({QUALITY})"
    for name, way in (("G09_curriculum", "ASC"), ("G10_anti_curriculum", "DESC")):
        q = returns_in_context(Q()).add(d=f"stddev_pop(r) {ov(19)}").raw("SELECT * FROM {t} WHERE rn >= 20")
        q.add(rk=f"row_number() OVER (PARTITION BY key ORDER BY d {way}, ts)", n="count(*) OVER (PARTITION BY key)")
        q.raw("SELECT * FROM {t} WHERE rk <= greatest(1, floor(n * 0.5))")
        q.add(position=f"row_number() OVER (PARTITION BY key ORDER BY md5(concat_ws(':', '44', {', '.join(ID)})))")
        o[name] = q.out({"difficulty": "d"}, "position")
    q = returns_in_context(Q(), True).add(v=f"stddev_pop(r) {ov(19)}")
    o["G11_volatility_regime"] = q.out({"volatility": "v"}, {"regime": "CASE WHEN v < 0.35 THEN 0 WHEN v < 0.40 THEN 1 ELSE 2 END"},
                                       where="WHERE rn >= 20")
    gap = f"({av('close', 10)} - {av('close', 30)}) / ({av('close', 30)} + 1e-8)"
    reg = "CASE WHEN g > 0.02 THEN 2 WHEN g < -0.02 THEN 0 ELSE 1 END"
    o["G12_trend_regime_sma"] = Q().add(g=gap).out({"gap": "g"}, {"regime": reg})
    q = returns_in_context(Q(), True).add(up=f"coalesce(sum(r) FILTER (WHERE r > 0) {ov(29)}, 0)",
                                          dn=f"coalesce(-sum(r) FILTER (WHERE r < 0) {ov(29)}, 0)")
    q.add(s="CASE WHEN up + dn >= 1e-8 THEN abs(up - dn) / (up + dn) * 100 END")
    o["G13_trend_regime_adx"] = q.out({"strength": "s"}, {"regime": "CASE WHEN s IS NULL OR s < 25 THEN 1 WHEN up > dn THEN 2 ELSE 0 END"},
                                      where="WHERE rn >= 30")
    o["G14_cluster_features"] = Q().add(m=av("close", 20), s=sp("close", 20), k=f"regr_slope(close, rn) {ov(20)}").out(
        {"mean": "m", "sd": "s", "slope": "k"}, where="WHERE rn >= 20")
    q = Q().add(mean=av("close", 20), sd=sp("close", 20), slope=f"regr_slope(close, rn) {ov(20)}")
    near = "SELECT key, ts, f.mean, f.sd, f.slope, arg_min(i, {{'d': pow(f.mean - c.mean, 2) + pow(f.sd - c.sd, 2) + pow(f.slope - c.slope, 2), 'i': i}}) AS i FROM f, c{0} c GROUP BY ALL"
    ctes = [*q.ctes, f"f AS MATERIALIZED (SELECT key, ts, mean, sd, slope FROM {q.cur} WHERE rn >= 20)",
            "c0 AS MATERIALIZED (SELECT i, quantile_cont(mean, 0.5 / 3) AS mean, avg(sd) AS sd, avg(slope) AS slope FROM f, (SELECT 0 AS i) GROUP BY i "
            "UNION ALL SELECT 1, quantile_cont(mean, 0.5), avg(sd), avg(slope) FROM f UNION ALL SELECT 2, quantile_cont(mean, 2.5 / 3), avg(sd), avg(slope) FROM f)"]
    for r in range(20):
        ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.i, coalesce(m.mean, c.mean) AS mean, coalesce(m.sd, c.sd) AS sd, coalesce(m.slope, c.slope) AS slope FROM c{r} c "
                    f"LEFT JOIN (SELECT i, avg(mean) AS mean, avg(sd) AS sd, avg(slope) AS slope FROM ({near.format(r)}) GROUP BY i) m ON m.i = c.i)")
    ctes.append("c21 AS (SELECT row_number() OVER (ORDER BY mean) - 1 AS i, mean, sd, slope FROM c20)")
    o["G14_cluster_regime"] = (f"WITH RECURSIVE {', '.join(ctes)} SELECT key, CAST(ts AS VARCHAR) AS ts, {rnd('mean', 4)} AS mean, {rnd('sd', 4)} AS sd, "
                               f"{rnd('slope', 4)} AS slope, CAST(i AS BIGINT) AS regime FROM ({near.format(21)})")
    o["G15_regime_weights"] = Q().add(g=gap).add(rg=reg).out(
        {"gap": "g", "weight": "CASE rg WHEN 0 THEN 2.0 WHEN 2 THEN 0.5 ELSE 1.0 END"}, {"regime": "rg"})
    return o
