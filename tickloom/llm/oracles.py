"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return WORDS.format(text=f"coalesce({text}, '')")


def mix() -> str:
    def at(done: float, start: float, first: float, bend: float, whole: float) -> str:
        left = f"greatest(share * {whole} - {done}, 0.0)"
        return f"least({start} + 2.0 * {left} / ({first} + sqrt(greatest({first * first} + {4 * bend} * {left}, 0.0))), 1.0)"

    position = (f"CASE turn WHEN 0 THEN {at(0.0, 0.0, 1.5, -0.5, 1.0)} WHEN 1 THEN {at(0.0, 0.0, 1.0, 0.0, 1.0)} "
                f"ELSE CASE WHEN share * 0.875 >= 0.25 THEN {at(0.25, 0.5, 0.5, 1.5, 0.875)} "
                f"ELSE {at(0.0, 0.0, 0.5, 0.0, 0.875)} END END")
    return f"""
WITH sized AS (SELECT doc_id, source, CAST(len({_words("text")}) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS mark FROM documents),
whole AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
turned AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) AS turn FROM whole),
weighted AS (SELECT *, [5, 2, 1][turn + 1] AS weight, 3 * source_size AS cap,
  CAST(3 * source_size AS DOUBLE) / CAST([5, 2, 1][turn + 1] AS DOUBLE) AS ratio FROM turned),
ordered AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place FROM weighted),
levels AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS DOUBLE) / CAST(sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM ordered),
chosen AS (SELECT place AS first_place, level AS first_level FROM levels WHERE level <= ratio ORDER BY place LIMIT 1),
goal AS (SELECT source, source_size, turn, CASE WHEN place < first_place THEN CAST(cap AS DOUBLE) ELSE first_level * CAST(weight AS DOUBLE) END AS target
  FROM levels LEFT JOIN chosen ON true),
hashed AS (SELECT *, CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-' || mark)), 1, 15) AS BIGINT) AS h FROM sized),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM hashed),
passes AS (SELECT p.doc_id, p.size, g.source_size, g.target, g.turn, floor(g.target + 0.5) AS words, k, k * g.source_size + p.c AS start
  FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)),
cut AS (SELECT *, greatest(least(words - start, size), 0) AS taken FROM passes),
shared AS (SELECT *, (CAST(start AS DOUBLE) + CAST(taken AS DOUBLE) / 2) / CAST(words AS DOUBLE) AS share FROM cut)
SELECT doc_id, size, source_size, target, CAST(sum(taken) AS BIGINT) AS taken, CAST(count(*) FILTER (taken > 0) AS BIGINT) AS copies,
  round(min(CASE WHEN taken > 0 THEN {position} END), 6) AS first_position
FROM shared GROUP BY doc_id, size, source_size, target"""


def join() -> str:
    return f"""
WITH RECURSIVE split AS (SELECT doc_id, {_words(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
  WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM split)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM reach r LEFT JOIN sizes z ON z.doc_id = r.doc_id GROUP BY r.doc_id"""


def substring() -> str:
    return f"""
WITH split AS (SELECT doc_id, {_words("text")} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)),
repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM windows SEMI JOIN repeated USING (s)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)"""


def infill() -> str:
    return """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS hex FROM documents),
u AS (
  SELECT doc_id, body, length(body) AS n, CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN n = 0 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, substr(body, 1, lo) AS pre, substr(body, lo + 1, hi - lo) AS mid, substr(body, hi + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"op2_curriculum_mix": mix(), "op3_ngram_jaccard": join(), "op8_substring_dedup": substring(),
            "op11_fill_in_middle": infill()}
