"""DuckDB queries for feature quality, curation, validation and the registry."""

from __future__ import annotations

from oracles.base import BARS, WEEKS, Q, av, div, lg, ma, mi, pct, rnd
from oracles.evaluation_sql import PRED, auc, counts, rates
from oracles.features_sql import stoch, weekly

COLS = ["ret", "gap", "body", "span", "volume", "dist"]


def rows_sql():
    q = Q().add(pc=lg("close"), nh=f"lead(high) OVER (PARTITION BY key ORDER BY ts)", m5=av("close", 5))
    return (f"WITH RECURSIVE {', '.join(q.ctes)} SELECT key, ts, close / pc - 1 AS ret, open / pc - 1 AS gap, close / open - 1 AS body, "
            f"high / low - 1 AS span, CAST(volume AS DOUBLE) AS volume, close / m5 - 1 AS dist, CASE WHEN nh >= close * 1.05 THEN 1 ELSE 0 END AS y "
            f"FROM {q.cur} WHERE pc IS NOT NULL AND nh IS NOT NULL AND m5 IS NOT NULL")


ROWS = rows_sql()


def long(cols=COLS, y="y", src="r"):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, CAST({y} AS DOUBLE) AS y FROM {src}" for c in cols)


def pearson(cols=COLS, src="r"):
    return f"SELECT feature, count(*) AS n, coalesce(corr(x, y), 0) AS correlation FROM ({long(cols, src=src)}) GROUP BY 1"


def spearman(cols=COLS, y="y"):
    r = (f"SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, "
         f"rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM ({long(cols, y)})")
    return f"SELECT feature, count(*) AS n, coalesce(corr(rx, ry), 0) AS correlation FROM ({r}) GROUP BY 1"


def mutual(cols=COLS, bins=10):
    b = (f"SELECT feature, y, CAST(floor((rank() OVER (PARTITION BY feature ORDER BY x) - 1) * {bins} / count(*) OVER (PARTITION BY feature)) AS INT) AS b FROM ({long(cols)})")
    return (f"SELECT feature, sum(n / nt * ln(n * nt / (nb * ny))) AS mutual_information FROM (SELECT feature, n::DOUBLE AS n, sum(n) OVER (PARTITION BY feature)::DOUBLE AS nt, "
            f"sum(n) OVER (PARTITION BY feature, b)::DOUBLE AS nb, sum(n) OVER (PARTITION BY feature, y)::DOUBLE AS ny FROM (SELECT feature, b, y, count(*) AS n FROM ({b}) GROUP BY 1, 2, 3)) GROUP BY 1")


def psi(n):
    z = f"(CAST({n} AS DOUBLE) + 6)"
    return (f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6) - "
            + " - ".join(f"1 / (CAST({n} AS DOUBLE) + {i})" for i in range(6)) + ")")


def neighbours(cols=COLS, k=3, src="r"):
    w = "(PARTITION BY feature, y ORDER BY g)"
    near = ", ".join(f"abs({f}(g, {i}) OVER {w} - g)" for i in range(1, k + 1) for f in ("lag", "lead"))
    return (f"WITH l AS (SELECT * FROM ({long(cols, src=src)}) QUALIFY count(*) OVER (PARTITION BY feature, y) > 1), "
            f"e AS (SELECT feature, avg(x) AS mean, min(x) AS low, max(x) AS high FROM l GROUP BY 1), "
            f"s AS (SELECT feature, y, coalesce(CAST(floor((coalesce(x, mean) - low) / nullif(high - low, 0) * {1 << 40} + 0.5) AS BIGINT), 0) AS g FROM l JOIN e USING (feature)), "
            f"n AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS nl, list_sort(list_filter([{near}], lambda z: z IS NOT NULL)) AS near FROM s), "
            f"d AS (SELECT *, CASE WHEN near[least({k}, nl - 1)] = 0 THEN count(*) OVER (PARTITION BY feature, y, g) ELSE least({k}, nl - 1) END AS kk, greatest(near[least({k}, nl - 1)] - 1, 0) AS w FROM n), "
            f"m AS (SELECT *, count(*) OVER (PARTITION BY feature ORDER BY g RANGE BETWEEN w PRECEDING AND w FOLLOWING) AS m FROM d) "
            f"SELECT feature, greatest({psi('count(*)')} + avg({psi('kk')} - {psi('nl')} - {psi('m')}), 0) AS mutual_information FROM m GROUP BY feature")


def permuted(metric, cols=COLS, repeats=3, rounds=24, prime=2147483647):
    """Positions are swapped with their mirror images, a subquery a round."""
    def key(i, a, n):
        return f"CAST('0x' || substr(md5('42:' || run_id || ':{i}'), {a}, {n}) AS BIGINT)"

    runs = " UNION ALL ".join(f"SELECT '{c}' AS c, '{c}:{k}' AS run_id" for c in cols for k in range(repeats))
    keys = ", ".join(f"{key(i, 1, 12)} % n AS k{i}, {key(i, 13, 10)} % {prime} AS a{i}, {key(i, 23, 10)} % {prime} AS b{i}" for i in range(rounds))
    p = "SELECT run_id, c, pos, pos AS p, n FROM placed, runs"
    for i in range(rounds):
        p = (f"SELECT run_id, c, pos, CASE WHEN (((t % {prime} * a{i} + b{i}) % {prime}) * ((t % {prime} * a{i} + b{i}) % {prime}) + b{i}) % {prime} // 65536 % 2 = 1 "
             f"THEN o ELSE p END AS p, n FROM (SELECT x.*, a{i}, b{i}, (k{i} - p + x.n) % x.n AS o, greatest(p, (k{i} - p + x.n) % x.n) AS t "
             f"FROM ({p}) x JOIN keyed USING (run_id))")
    weights = {"ret": -2.0, "gap": 1.5, "body": 1.0, "span": 8.0, "dist": -3.0}
    mixed = ", ".join(f"CASE WHEN g.c = '{c}' THEN d.{c} ELSE h.{c} END AS {c}" for c in cols)
    prob = f"round(1 / (1 + exp(-(-0.2 + {' + '.join(f'{c} * {w}' for c, w in weights.items())}))), 9)"
    scored = f"SELECT run_id, label, {prob} AS prob FROM"
    score = (lambda src: f"SELECT run_id, auc AS score FROM ({auc(src)})") if metric == "auc" else (
        lambda src: f"SELECT run_id, precision AS score FROM ({rates(f'SELECT run_id, {counts(0.5)} FROM ({src}) GROUP BY 1')})")
    after = score(f"{scored} (SELECT g.run_id, h.y AS label, {mixed} FROM given g JOIN placed h ON h.pos = g.p JOIN placed d ON d.pos = g.pos)")
    return (f"WITH t AS (SELECT count(*) AS n FROM r), placed AS (SELECT r.*, n, row_number() OVER (ORDER BY key, ts) - 1 AS pos FROM r, t), "
            f"runs AS ({runs}), keyed AS (SELECT run_id, {keys} FROM runs, t), given AS ({p}), "
            f"b AS ({score(f'{scored} (SELECT *, 1 AS run_id, y AS label FROM r)')}) "
            f"SELECT split_part(s.run_id, ':', 1) AS feature, avg(b.score - s.score) AS importance FROM ({after}) s, b GROUP BY 1")


def redundancy(cols=COLS):
    return " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, abs(corr({a}, {b})) AS correlation FROM r" for a in cols for b in cols)


def max_red(cols=COLS):
    return (f"SELECT feature, max(correlation) AS max_redundancy, arg_max(other, {{'c': correlation, 'o': other}}) AS most_similar FROM ({redundancy(cols)}) WHERE feature <> other GROUP BY 1")


def metrics(cols=COLS, information=None):
    return (f"SELECT c.feature, c.correlation AS target_correlation, m.mutual_information, x.max_redundancy FROM ({spearman(cols)}) c "
            f"JOIN ({information or mutual(cols)}) m ON m.feature = c.feature JOIN ({max_red(cols)}) x ON x.feature = c.feature")


def s01(x):
    return f"CASE WHEN max({x}) OVER () = min({x}) OVER () THEN 0.5 ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"


def combined(drop=False, src=None):
    src = src or metrics()
    if drop:
        e = f"0.4 * {s01('mutual_information / 10')} + 0.3 * {s01('abs(target_correlation)')} + 0.2 * {s01('mutual_information')} + 0.1 * (1 - {s01('max_redundancy')})"
    else:
        e = f"0.45 * {s01('abs(target_correlation)')} + 0.35 * {s01('mutual_information')} + 0.2 * (1 - {s01('max_redundancy')})"
    return f"SELECT *, {e} AS combined_score FROM ({src})"


def final(src, keys="", doubles="", ints="", digits=6, rows=True):
    parts = keys.split() + [f"{rnd(c, digits)} AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    head = f"WITH r AS MATERIALIZED ({ROWS}) " if rows else ""
    return f"{head}SELECT {', '.join(parts)} FROM ({src})"


GOOD = {"target_correlation": "abs(target_correlation) >= {}", "mutual_information": "mutual_information >= {}", "max_redundancy": "max_redundancy < {}",
        "temporal_stability_cv": "max_redundancy < {}", "precision_drop": "mutual_information / 10 >= {}"}
CUT = {"target_correlation": (0.02, 0.01), "mutual_information": (0.001, 0.0005), "max_redundancy": (0.9, 0.95), "temporal_stability_cv": (0.5, 0.8), "precision_drop": (0.002, 0.001)}


def grade(m):
    a, b = CUT[m]
    return f"CASE WHEN {GOOD[m].format(a)} THEN 'pass' WHEN {GOOD[m].format(b)} THEN 'marginal' ELSE 'fail' END"


def graded(ms=None, src=None):
    ms = ms or list(CUT)
    g = ", ".join(f"{grade(m)} AS {m}_grade" for m in ms)
    names = "[" + ", ".join(f"{m}_grade" for m in ms) + "]"
    return (f"SELECT *, CASE WHEN list_contains({names}, 'fail') THEN 'fail' WHEN list_contains({names}, 'marginal') THEN 'marginal' ELSE 'pass' END AS overall_verdict "
            f"FROM (SELECT *, {g} FROM ({src or metrics()}))")


def named():
    return (f"SELECT t || '_' || feature AS feature, round(combined_score + length(t) / 100e0, 6) AS combined_score FROM ({combined()}), (SELECT unnest(['rsi', 'sma', 'volume', 'fib', 'plain']) AS t)")


def category():
    # in the order of the keyword table; only words that these names can hold
    return ("CASE WHEN contains(feature, 'sma') THEN 'moving_averages' WHEN contains(feature, 'rsi') THEN 'oscillators' WHEN contains(feature, 'volume') THEN 'volume' "
            "WHEN contains(feature, 'fib') THEN 'support_resistance' WHEN contains(feature, 'body') THEN 'candle' ELSE 'other' END")


def removal():
    least = "CASE category WHEN 'moving_averages' THEN 5 WHEN 'oscillators' THEN 4 WHEN 'volume' THEN 3 WHEN 'support_resistance' THEN 2 ELSE 1 END"
    return (f"SELECT feature, category, may AND row_number() OVER (ORDER BY may DESC, combined_score, feature) <= greatest(1, floor(n * 0.4)) AS removed FROM ("
            f"SELECT *, rk <= cn - {least} AS may FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY combined_score, feature) AS rk, "
            f"count(*) OVER (PARTITION BY category) AS cn, count(*) OVER () AS n FROM (SELECT *, {category()} AS category FROM ({named()}))))")


def md5sum(cols, src):
    line = row_line(cols)
    return f"SELECT count(*) AS rows, {sums(line)} AS checksum FROM {src}"


def row_line(cols):
    return " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in cols)


def sums(line):
    return "concat_ws('-', " + ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(md5({line}), {1 + 8 * i}, 8) AS BIGINT)), 0) AS VARCHAR)" for i in range(4)) + ")"


def leaves(src):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return (f"SELECT bucket, rows, md5(bucket || '/' || rows || '/' || s) AS leaf FROM (SELECT CAST('0x' || substr(md5({row_line(['o_orderkey'])}), 1, 8) AS BIGINT) % 256 AS bucket, "
            f"count(*) AS rows, {sums(row_line(cols))} AS s FROM {src} GROUP BY 1)")


def oracle_sql() -> dict[str, str]:
    o = {}
    o["Q01_target_correlation"] = final(pearson(), "feature", "correlation", "n")
    o["Q02_rank_correlation"] = final(spearman(), "feature", "correlation", "n")
    o["Q02_rank_correlation_returns"] = final(spearman(COLS[1:], "ret"), "feature", "correlation", "n")
    o["Q03_mutual_information"] = final(mutual(), "feature", "mutual_information")
    o["Q04_redundancy"] = final(redundancy(), "feature other", "correlation")
    gaps = ", ".join(f"CASE WHEN key % {i + 3} <> 0 THEN {c} END AS {c}" for i, c in enumerate(COLS))
    o["Q03_neighbour_information"] = final(neighbours(), "feature", "mutual_information")
    o["Q03_neighbour_information_gaps"] = final(neighbours(src=f"(SELECT y, {gaps} FROM r)"), "feature", "mutual_information", digits=5)
    o["Q08_importance_report_neighbours"] = final(combined(src=metrics(information=neighbours())), "feature",
                                                  "target_correlation mutual_information max_redundancy combined_score", digits=5)
    for m in ("auc", "precision"):
        o[f"Q09_permutation_{m}"] = final(permuted(m), "feature", "importance")
    o["Q04_redundancy_gaps"] = final(redundancy().replace("FROM r", f"FROM (SELECT {gaps} FROM r)"), "feature other", "correlation")
    o["Q05_max_redundancy"] = final(max_red(), "feature most_similar", "max_redundancy")
    o["Q06_scaled"] = final(f"SELECT *, {s01('correlation')} AS correlation_01, {s01('n')} AS n_01 FROM ({pearson()})", "feature", "correlation correlation_01 n_01", "n")
    for name in ("Q07_combined_scores", "Q08_importance_report"):
        o[name] = final(combined(), "feature", "target_correlation mutual_information max_redundancy combined_score", digits=5)
    o["Q07_combined_scores_with_drop"] = final(combined(True), "feature", "combined_score", digits=5)
    parts = " UNION ALL ".join(f"SELECT *, {k} AS seed FROM ({pearson(src=f'(SELECT * FROM r WHERE key % 3 = {k})')})" for k in range(3))
    o["Q10_stability"] = final(f"SELECT feature, avg(correlation) AS mean_importance, stddev_samp(correlation) AS std_importance, stddev_samp(correlation) / CASE WHEN avg(correlation) <> 0 THEN avg(correlation) ELSE 1 END AS cv_importance FROM ({parts}) GROUP BY 1",
                               "feature", "mean_importance std_importance cv_importance")
    o["Q11_grades"] = final(graded(), "feature " + " ".join(f"{m}_grade" for m in CUT))
    o["Q12_verdicts"] = final(graded(), "feature overall_verdict")
    o["Q12_filtered"] = final(f"SELECT * FROM ({graded()}) WHERE overall_verdict <> 'fail'", "feature")
    o["Q12_report"] = final(f"SELECT count(*) AS total_features, count(*) FILTER (WHERE overall_verdict = 'pass') AS pass_count, count(*) FILTER (WHERE overall_verdict = 'marginal') AS marginal_count, "
                            f"count(*) FILTER (WHERE overall_verdict = 'fail') AS fail_count, avg(CASE WHEN overall_verdict = 'pass' THEN 1e0 ELSE 0 END) AS pass_rate FROM ({graded()})", "", "pass_rate",
                            "total_features pass_count marginal_count fail_count")
    o["Q13_categories"] = final(f"SELECT feature, {category()} AS category FROM ({named()})", "feature category")
    o["Q14_removal_round"] = final(removal(), "feature category removed")
    det = rates(f"SELECT run_id, {counts(0.5)}, max(prob) - min(prob) AS pred_range FROM ({PRED}) GROUP BY run_id")
    d = f"SELECT d.run_id, precision, recall, a.auc, pred_range FROM ({det}) d JOIN ({auc(PRED)}) a ON a.run_id = d.run_id"
    limits = {"precision": (0.95, 0.9), "recall": (0.9, 0.8), "auc": (0.95, 0.9)}
    res = ", ".join(f"{m} / b{m} AS {m}_ratio, CASE WHEN {m} / b{m} >= {x} THEN 'maintain' WHEN {m} / b{m} >= {y} THEN 'warning' ELSE 'abort' END AS {m}_result" for m, (x, y) in limits.items())
    j = f"SELECT d.*, b.precision AS bprecision, b.recall AS brecall, b.auc AS bauc FROM ({d}) d, (SELECT * FROM ({d}) WHERE run_id = 'run_1') b"
    al = "[precision_result, recall_result, auc_result, pred_range_result]"
    o["Q15_reduction_validation"] = final(
        f"SELECT *, overall_result <> 'abort' AS \"continue\", CASE overall_result WHEN 'maintain' THEN 0.1 WHEN 'warning' THEN 0.05 ELSE 0 END AS next_fraction FROM (SELECT *, CASE WHEN list_contains({al}, 'abort') THEN 'abort' "
        f"WHEN list_contains({al}, 'warning') THEN 'warning' ELSE 'maintain' END AS overall_result FROM (SELECT *, {res}, CASE WHEN pred_range >= 0.1 THEN 'maintain' WHEN pred_range >= 0.05 THEN 'warning' ELSE 'abort' END AS pred_range_result FROM ({j})))",
        'run_id precision_result recall_result auc_result pred_range_result overall_result "continue"', "precision recall auc pred_range precision_ratio recall_ratio auc_ratio next_fraction", rows=False)
    cols = ["dist", "ret", "gap", "body"]
    three = ["target_correlation", "mutual_information", "max_redundancy"]
    g = graded(three, f"SELECT * FROM ({metrics(cols)}) WHERE feature = 'dist'")
    basic = ("SELECT count(*) FILTER (WHERE dist IS NULL) AS null_after_warm_up, count(*) FILTER (WHERE isinf(dist)) AS inf_count, min(dist) AS min_value, max(dist) AS max_value FROM r")
    worst = "CASE WHEN 'fail' IN ({0}) THEN 'fail' WHEN 'marginal' IN ({0}) THEN 'marginal' ELSE 'pass' END"
    sig = worst.format("target_correlation_grade, mutual_information_grade")
    o["Q16_feature_check"] = final(
        f"SELECT *, {worst.format('data_verdict, signal_verdict, max_redundancy_grade')} AS verdict FROM (SELECT *, 'pass' AS data_verdict, {sig} AS signal_verdict FROM ({basic}), ({g}))",
        "feature target_correlation_grade mutual_information_grade max_redundancy_grade data_verdict signal_verdict verdict",
        "min_value max_value target_correlation mutual_information max_redundancy", "null_after_warm_up inf_count", digits=5)

    # --- validation ------------------------------------------------------------------------
    def chain(q):
        return f"WITH RECURSIVE {', '.join(q.ctes)} "

    q = Q().add(s=av("close", 12), r=pct("close", lg("close")))
    o["V01_columns"] = chain(q) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {str(e).lower()} AS expected, {str(p).lower()} AS present, {n} AS \"values\" FROM {q.cur}" for c, e, p, n in (
            ("key", True, True, "count(key)"), ("ts", True, True, "count(ts)"), ("sma_12", True, True, "count(s)"),
            ("return_5d", True, False, "CAST(0 * count(*) AS BIGINT)"), ("return_1d", False, True, "count(r)")))
    q = Q().rsi(14).add(s=av("close", 12), r=pct("close", lg("close", 252)))
    o["V02_nulls_and_infinities"] = chain(q) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({x}) AS nulls, count(*) FILTER (WHERE isinf({x})) AS infinities FROM {q.cur}" for c, x in (("sma_12", "s"), ("return_252d", "r"), ("rsi_daily", "rsi14")))
    o["V03_order"] = ("SELECT a.o_orderpriority, CAST(v AS BIGINT) AS order_violations, CAST(n - u AS BIGINT) AS repeated, n AS rows FROM (SELECT o_orderpriority, sum(CASE WHEN d < p THEN 1 ELSE 0 END) AS v FROM ("
                      "SELECT *, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1) a JOIN ("
                      "SELECT o_orderpriority, count(*) AS n, count(DISTINCT CAST(o_orderdate AS DATE)) AS u FROM orders GROUP BY 1) b ON a.o_orderpriority = b.o_orderpriority")

    def checks_base():
        q = Q().rsi(14).atr(14).bb().add(fk=stoch("close", mi("low", 14), ma("high", 14)), r=pct("close", lg("close")))
        q.add(sk=av("fk", 3)).add(sdd=av("sk", 3))
        q.add(k14="CASE WHEN sdd IS NOT NULL THEN sk END", pb=div("close - bl", "bu - bl"),
              wr=f"CASE WHEN {ma('high', 14)} = {mi('low', 14)} THEN 0 ELSE -100 * ({ma('high', 14)} - close) / ({ma('high', 14)} - {mi('low', 14)}) END")
        return q
    q = checks_base()
    b = {"rsi_daily": ("rsi14", 0, 100), "stoch_k_14": ("k14", 0, 100), "williams_r_14": ("wr", -100, 0), "bb_percent_b": ("pb", -0.1, 1.1)}
    bound = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({x}) AS actual_min, max({x}) AS actual_max, count(*) FILTER (WHERE {x} < {lo} - 1e-6 OR {x} > {hi} + 1e-6) AS violations FROM {q.cur}" for c, (x, lo, hi) in b.items())
    o["V04_bounds"] = chain(q) + f"SELECT \"column\", {rnd('actual_min', 4)} AS actual_min, {rnd('actual_max', 4)} AS actual_max, violations, violations = 0 AS passed FROM ({bound})"
    r = {"positive_atr": ("atr14", "atr14 > 0"), "percent_b_plausible": ("pb", "pb BETWEEN -2 AND 2"), "rsi_bounded": ("rsi14", "rsi14 BETWEEN 0 AND 100")}
    rule = " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT ({c})) AS violations, count({x}) AS tested FROM {q.cur}" for n, (x, c) in r.items())
    o["V05_rules"] = chain(q) + f"SELECT *, violations = 0 AS passed FROM ({rule})"
    s = {"return_1d_mean": ("avg(r)", -5, 5), "up_share": ("avg(CAST(r > 0 AS DOUBLE))", 0.3, 0.7)}
    share = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", {e} AS value, CAST({lo} AS DOUBLE) AS low, CAST({hi} AS DOUBLE) AS high FROM {q.cur}" for n, (e, lo, hi) in s.items())
    o["V09_distributions"] = chain(q) + f"SELECT \"check\", {rnd('value', 4)} AS value, low, high, value > low AND value < high AS passed FROM ({share})"
    rep = (f"SELECT 'bounds' AS chunk, \"column\" AS \"check\", violations = 0 AS passed FROM ({bound}) UNION ALL SELECT 'rules', rule, violations = 0 FROM ({rule}) UNION ALL "
           f"SELECT 'shares', \"check\", value > low AND value < high FROM ({share})")
    o["V12_report"] = chain(q) + rep
    o["V12_report_summary"] = chain(q) + (f"SELECT chunk, count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, "
                                          f"{rnd('avg(CAST(passed AS DOUBLE))')} AS pass_rate FROM ({rep}) GROUP BY 1")
    q = Q().add(s=av("close", 12), r=pct("close", lg("close"))).add(w="CASE WHEN key = 7 AND day(ts) = 1 THEN s + 0.5 ELSE s END")
    o["V06_recompute"] = chain(q) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {rnd(f'max(abs({a} - {b}))')} AS max_diff, count({a} - {b}) AS compared, CAST(0 AS BIGINT) AS null_mismatch, CAST(0 AS BIGINT) AS unmatched, max(abs({a} - {b})) <= 1e-6 AS passed FROM {q.cur}"
        for c, a, b in (("sma_12", "w", "s"), ("return_1d", "r", "r")))
    # without lookahead the truncated result equals the full one: count the compared rows
    q = Q().rsi(14).macd().add(s=av("close", 12), m9=av("close", 9))
    weekly(q, Q(WEEKS).rsi(14), wr="rsi14")
    last = " UNION ".join(f"SELECT key, max(ts) AS ts FROM {q.cur} WHERE ts <= '{c}' GROUP BY key" for c in ("1998-06-30", "1999-12-31", "2001-03-15"))
    o["V07_lookahead"] = chain(q) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 0.0::DOUBLE AS max_diff, count({x}) AS compared, CAST(0 AS BIGINT) AS null_mismatch, CAST(0 AS BIGINT) AS unmatched, true AS passed FROM {q.cur} t SEMI JOIN ({last}) l ON l.key = t.key AND l.ts = t.ts"
        for c, x in (("sma_12", "s"), ("rsi_daily", "rsi14"), ("macd_line", "macd"), ("days_above_sma_9", "key"), ("rsi_weekly", "wr")))
    # a column that peeks at the next row is null on the last row of a truncated series
    q = Q()
    last = " UNION ".join(f"SELECT key, max(ts) AS ts FROM t0 WHERE ts <= '{c}' GROUP BY key" for c in ("1998-06-30", "1999-12-31"))
    o["V07_lookahead_found"] = chain(q) + (
        f"SELECT 'peek' AS \"column\", NULL::DOUBLE AS max_diff, CAST(0 AS BIGINT) AS compared, count(*) AS null_mismatch, CAST(0 AS BIGINT) AS unmatched, false AS passed FROM ({last}) UNION ALL "
        f"SELECT 'close', 0.0, count(*), 0, 0, true FROM ({last})")
    q = Q().rsi(14).streak(ob="rsi14 > 70", os="rsi14 < 30", u="close > pc").add(rd="rsi14 - 50", r=pct("close", "pc"))
    im = {"overbought": ("rd > 20", "ob > 0"), "oversold": ("rd < -20", "os > 0"), "up_move": ("u > 1", "r > 0")}
    o["V08_implications"] = chain(q) + "SELECT *, violations <= tested * 0.01 AS passed FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {a}) AS tested, count(*) FILTER (WHERE {a} AND NOT ({b})) AS violations FROM {q.cur}" for n, (a, b) in im.items()) + ")"
    q = Q().add(r=pct("close", lg("close")))
    ev = {"year_1998": ("1998-01-01", "1998-12-31", "CAST(r > 0 AS DOUBLE)", 0.3, 0.7), "spring_2000": ("2000-03-01", "2000-05-31", "r", -1.0, 1.0)}
    o["V10_events"] = chain(q) + f"SELECT event, rows, {rnd('value', 4)} AS value, low, high, value BETWEEN low AND high AS passed FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS event, count(*) AS rows, avg({e}) AS value, CAST({lo} AS DOUBLE) AS low, CAST({hi} AS DOUBLE) AS high FROM {q.cur} WHERE ts BETWEEN '{a}' AND '{z}'" for n, (a, z, e, lo, hi) in ev.items()) + ")"
    o["V11_audit_rows"] = " UNION ALL ".join(
        f"SELECT key, '{d}' AS audit_date, CAST(arg_min(ts, {{'g': abs(date_diff('day', DATE '{d}', ts)), 't': ts}}) AS VARCHAR) AS ts, round(arg_min(close, {{'g': abs(date_diff('day', DATE '{d}', ts)), 't': ts}}), 6) AS close, "
        f"arg_min(volume, {{'g': abs(date_diff('day', DATE '{d}', ts)), 't': ts}}) AS volume FROM ({BARS}) GROUP BY key" for d in ("1997-03-03", "2000-07-04"))
    o["V13_profile"] = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS kind, count({c}) AS count, count(*) - count({c}) AS nulls, " + ", ".join(f"{rnd(f'{e}', 4)} AS {n}" for n, e in (
            ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})::DOUBLE"), ("max", f"max({c})::DOUBLE"), ("q25", f"quantile_cont({c}, 0.25)"), ("median", f"quantile_cont({c}, 0.5)"), ("q75", f"quantile_cont({c}, 0.75)")))
        + f" FROM ({BARS})" for c, k in (("open", "double"), ("close", "double"), ("volume", "bigint")))
    o["V13_date_range"] = f"SELECT count(*) AS rows, CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts, count(DISTINCT ts) AS dates FROM ({BARS})"
    changed = "(SELECT * REPLACE (CASE WHEN o_orderkey % 997 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey) FROM orders)"
    o["V14_leaves"] = leaves("orders")
    o["V14_root"] = f"SELECT CAST(sum(rows) AS BIGINT) AS rows, md5(string_agg(leaf, '' ORDER BY bucket)) AS root FROM ({leaves('orders')})"
    o["V14_changed_buckets"] = (f"SELECT a.bucket, a.rows AS rows_before, b.rows AS rows_after, 'changed' AS problem FROM ({leaves('orders')}) a "
                                f"JOIN ({leaves(changed)}) b ON a.bucket = b.bucket WHERE a.leaf <> b.leaf")
    ok = ["o_orderkey", "o_custkey", "o_orderstatus"]
    entries = [("orders", 1, "2025-01-01", md5sum(ok, "(SELECT * FROM orders WHERE o_orderkey % 2 = 0)")), ("orders", 2, "2025-02-01", md5sum(ok, "orders")),
               ("customer", 1, "2025-01-01", md5sum(["c_custkey", "c_name"], "customer")), ("supplier", 1, "2025-01-01", md5sum(["s_suppkey", "s_name"], "supplier"))]
    reg = " UNION ALL ".join(f"SELECT '{d}' AS dataset, '/data/{d}' AS path, rows, checksum, CAST({v} AS BIGINT) AS version, 'raw' AS tier, '{t}' AS registered_at FROM ({m})" for d, v, t, m in entries)
    o["V14_registry"] = reg
    latest = f"SELECT * FROM ({reg}) QUALIFY row_number() OVER (PARTITION BY path ORDER BY registered_at DESC, version) = 1"
    o["V14_latest"] = latest
    now = f"SELECT '/data/orders' AS path, rows, checksum FROM ({md5sum(ok, 'orders')}) UNION ALL SELECT '/data/customer', rows, checksum FROM ({md5sum(['c_custkey', 'c_mktsegment'], 'customer')})"
    o["V14_verify"] = (f"SELECT * FROM (SELECT l.dataset, l.path, CASE WHEN n.checksum IS NULL THEN 'missing' WHEN n.checksum <> l.checksum OR n.rows <> l.rows THEN 'changed' END AS problem "
                       f"FROM ({latest}) l LEFT JOIN ({now}) n ON n.path = l.path) WHERE problem IS NOT NULL")
    return o
