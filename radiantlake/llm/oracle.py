"""DuckDB SQL for the corpus queries that SQL can express.

Missing: page extraction, disguised personal data, tokenizers, seeded XXH64
(fingerprints, rendezvous scores), components of links, packing, template slots and
match positions. Tests hold those against plain versions."""

from .quality import MAX_HOST_RATE
from .queries import URL_RULES

_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)

OP5 = rf"""
WITH rules(h, p, action) AS (VALUES {_RULES}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT DISTINCT host, path FROM s),
f AS (SELECT d.host, d.path, h || p AS rule, action, row_number() OVER (PARTITION BY d.host, d.path ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM d JOIN rules ON (d.host = h OR ends_with(d.host, '.' || h)) AND starts_with(d.path, p))
SELECT page_id, s.host, s.path, rule, coalesce(action, 'allow') AS verdict FROM s LEFT JOIN f ON f.host = s.host AND f.path = s.path AND f.k = 1
"""

OP7 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: {{'i': i, 'w': words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]}})) AS x FROM w),
g AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.w) AS n FROM t),
c AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
a AS (SELECT w.doc_id, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
  FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a),
f AS (SELECT *, base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 35 * n_lines OR 2 * n_capitals > word_chars AS doc_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (doc_failed) AS failed FROM f GROUP BY source),
m AS (SELECT sum(failed) / sum(n) AS mean, greatest(0, var_pop(failed / n) - sum(failed) / sum(n) * (1 - sum(failed) / sum(n)) * avg(1 / n)) AS between_hosts FROM h),
p AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(1e6, greatest(2, mean * (1 - mean) / between_hosts - 1)) ELSE 1e6 END AS weight FROM m),
v AS (SELECT source, (failed + mean * weight) / (n + weight) > {MAX_HOST_RATE} AS host_failed FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (doc_failed OR host_failed) AS kept FROM f LEFT JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

ORACLE_SQL: dict[str, str] = {"op5_url_filter": OP5, "op7_quality": OP7}
