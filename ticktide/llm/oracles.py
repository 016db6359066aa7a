"""DuckDB SQL for the queries that SQL can express; written apart from the operators, from the contracts."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Groups of documents, with the sets' width and the table as parameters: (rows_cte, width).
NEAR = r"""
WITH RECURSIVE src AS MATERIALIZED ({source}),
w AS MATERIALIZED (SELECT doc_id, """ + _WORDS.format(_LOWER.format("coalesce(text, '')")) + r""" AS w FROM src),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+{width}-1], ' ') FOR i IN range(1, len(w) - {width} + 2)]) END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS g FROM s),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, CASE WHEN l.a = r.b THEN l.b ELSE l.a END FROM reach r JOIN links l ON l.a = r.b OR l.b = r.b),
groups AS MATERIALIZED (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
"""

SQL: dict[str, str] = {}

SQL["op1_near_dedup"] = NEAR.format(source="SELECT doc_id, text FROM documents", width=2) + """
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN groups USING (doc_id)
"""

_SIGNS = "[#*$%&|<>]"
_BUCKET = "CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END"
#: Metric: part, whole, units of slack.
_METRICS = {"symbols": ("n_symbols", "word_chars", 2), "upper": ("n_upper", "word_chars", 2), "dup_lines": ("n_dup_lines", "n_lines", 2), "repeats": ("n_repeat_words", "n_words", 16), "echoes": ("n_echoes", "n_words", 2)}

#: Metrics and verdicts; ends in the relation judged.
RULES = (
    r"""
WITH w AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS t, """
    + _WORDS.format("coalesce(text, '')")
    + r""" AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM d) GROUP BY doc_id),
c AS MATERIALIZED (SELECT w.doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(t) - length(regexp_replace(t, '"""
    + _SIGNS
    + r"""', '', 'g')) AS n_symbols, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  CASE WHEN len(w) < 2 THEN 0 ELSE len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) END AS n_echoes FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
m AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbols, CASE WHEN word_chars > 0 THEN n_upper * 1000 // word_chars ELSE 0 END AS upper,
  CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats,
  CASE WHEN n_words > 0 THEN n_echoes * 1000 // n_words ELSE 0 END AS echoes FROM c),
v AS (SELECT lang, source, metric, v FROM ("""
    + " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {k} AS v FROM m WHERE NOT base_failed" for k in _METRICS)
    + r""")),
b AS MATERIALIZED (SELECT lang, source, metric, """
    + _BUCKET
    + r""" AS v FROM v),
u AS (SELECT *, count(*) OVER (PARTITION BY lang, source, metric) AS t, count(*) OVER (PARTITION BY lang, source, metric ORDER BY v) AS k FROM b),
h AS (SELECT *, min(v) FILTER (2 * k >= t) OVER (PARTITION BY lang, source, metric) AS mid FROM u),
g0 AS MATERIALIZED (SELECT lang, source, metric, any_value(t)::BIGINT AS t, (1000 * (any_value(t) * any_value(mid) + 8 * sum(greatest(v - mid, 0))))::BIGINT AS a FROM h GROUP BY lang, source, metric),
g1 AS (SELECT lang, metric, sum(t)::BIGINT AS t, sum(a)::BIGINT AS a FROM g0 GROUP BY lang, metric),
g2 AS (SELECT metric, sum(t)::BIGINT AS t, sum(a)::BIGINT AS a FROM g1 GROUP BY metric),
z AS (SELECT g0.lang, g0.source, g0.metric, (g0.a + 100 * ((g1.a + 100 * (g2.a // g2.t)) // (g1.t + 100))) // (g0.t + 100) AS cut
  FROM g0 JOIN g1 ON g1.lang IS NOT DISTINCT FROM g0.lang AND g1.metric = g0.metric JOIN g2 ON g2.metric = g0.metric),
cut AS (SELECT lang, source, """
    + ", ".join(f"max(cut) FILTER (metric = '{k}') AS x_{k}" for k in _METRICS)
    + r""" FROM z GROUP BY lang, source),
judged AS MATERIALIZED (SELECT m.*, NOT base_failed AND """
    + " AND ".join(f"coalesce(1000000 * ({a} - {slack}) <= x_{k} * {b}, true)" for k, (a, b, slack) in _METRICS.items())
    + r""" AS kept FROM m LEFT JOIN cut ON cut.lang IS NOT DISTINCT FROM m.lang AND cut.source IS NOT DISTINCT FROM m.source)
"""
)

SQL["op7_quality_rules"] = RULES + "SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept FROM judged"

_ITEM_WORD = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op9_decontaminate"] = (
    r"""
WITH i AS MATERIALIZED (SELECT item_id, """ + _ITEM_WORD.format(_LOWER.format("coalesce(text, '')")) + r""" AS w FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS MATERIALIZED (SELECT doc_id, """ + _ITEM_WORD.format(_LOWER.format("coalesce(text, '')")) + r""" AS w FROM documents),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT doc_id, item_id, dw.n, k FROM dw JOIN iw ON iw.n = dw.n AND iw.g = dw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
)
