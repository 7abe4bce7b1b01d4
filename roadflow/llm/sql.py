"""DuckDB twins of the registered queries that SQL can express on whole tables.

The other operators rest on hashes, byte-level BPE, floating-point training or
iterations that DuckDB has no counterpart for; they are tested against brute
force instead.
"""

from __future__ import annotations

from . import urls

_URL = f"""
WITH parts AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
toks AS (
  SELECT *, list_distinct(list_filter(list_concat(
      list_transform(string_split(host, '.'), lambda x: 'h:' || x),
      list_transform(regexp_split_to_array(lower(path), '[^\\p{{L}}\\p{{N}}]+'), lambda x: 'p:' || regexp_replace(x, '^[0-9]+$', '0'))),
    lambda x: length(x) > 2)) AS tokens
  FROM parts),
known AS (SELECT doc_id, min(quality) = 0 AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT row_number() OVER () AS b, t.tokens, k.bad FROM toks t JOIN known k ON t.page_id = k.doc_id),
base AS (SELECT count(*) FILTER (bad) / count(*)::DOUBLE AS p FROM labelled),
items AS (SELECT b, bad, unnest(tokens) AS t FROM labelled),
sets AS (
  SELECT b, bad, [t] AS s FROM items
  UNION ALL SELECT x.b, x.bad, [x.t, y.t] FROM items x JOIN items y ON x.b = y.b AND x.t < y.t
  UNION ALL SELECT x.b, x.bad, [x.t, y.t, z.t] FROM items x JOIN items y ON x.b = y.b AND x.t < y.t JOIN items z ON x.b = z.b AND y.t < z.t),
rules AS (
  SELECT s, count(*) FILTER (bad) / count(*)::DOUBLE AS confidence FROM sets GROUP BY s
  HAVING count(*) FILTER (bad) >= ceil(greatest({urls.MIN_SUPPORT}::DOUBLE, {urls.MIN_ROWS}.0::DOUBLE / (SELECT count(*) FROM labelled)) * (SELECT count(*) FROM labelled))
     AND count(*) FILTER (bad) / count(*)::DOUBLE >= (SELECT least({urls.MIN_CONFIDENCE}::DOUBLE, {urls.MIN_LIFT}::DOUBLE * p) FROM base)
     AND 2 * (count(*) FILTER (bad) * ln(count(*) FILTER (bad) / count(*)::DOUBLE / (SELECT p FROM base))
       + coalesce(count(*) FILTER (NOT bad) * ln(nullif(count(*) FILTER (NOT bad), 0) / count(*)::DOUBLE / (SELECT 1 - p FROM base)), 0)) >= {urls.MIN_EVIDENCE}),
least AS (
  SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules q WHERE len(q.s) < len(r.s) AND list_has_all(r.s, q.s))),
hits AS (SELECT t.page_id, t.url, max(confidence) AS confidence FROM (SELECT DISTINCT page_id, url, tokens FROM toks) t JOIN least r ON list_has_all(t.tokens, r.s) GROUP BY ALL),
fits AS (
  SELECT p.page_id, p.url, p.host, p.path, h.confidence,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id AND p.url = h.url)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  confidence
FROM fits
"""

_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9::DOUBLE),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(low.component_id, e.vec_id) AS component_id, coalesce(low.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN low ON e.vec_id = low.x LEFT JOIN n ON e.vec_id = n.x
"""

#: Lines within one edit share a half, so the comparison is an equality join on halves.
_LINES = """
WITH occ AS (
  SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
long AS (SELECT * FROM occ WHERE length(line) >= 20),
cls AS (SELECT line, min((doc_id, line_no)) AS first, length(line) AS n FROM long GROUP BY line),
keys AS (
  SELECT line, first, m, unnest(['a' || line[:(m - 1) // 2], 'z' || right(line, (m - 1) // 2)]) AS k FROM (SELECT *, unnest([n, n + 1]) AS m FROM cls)),
beaten AS (SELECT DISTINCT a.line FROM keys a JOIN keys b ON a.m = b.m AND a.k = b.k AND b.first < a.first AND levenshtein(a.line, b.line) <= 1),
gone AS (
  SELECT o.doc_id, o.line_no FROM long o JOIN cls c ON o.line = c.line
  WHERE c.first <> (o.doc_id, o.line_no) OR EXISTS (SELECT 1 FROM beaten b WHERE b.line = o.line)),
per AS (SELECT doc_id, count(*) AS n_removed, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10))) AS n_lines, coalesce(p.n_removed, 0) AS n_removed, coalesce(p.removed, '') AS removed
FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id
"""

_LM = """
WITH w AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS w FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+'), lambda x: lower(x)) AS ws FROM documents)),
g AS (SELECT doc_id, p, w, lag(w) OVER o AS c, lag(w, 2) OVER o AS d FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
total AS (SELECT count(*) AS n FROM w), size AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
uo AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY doc_id, w), u AS (SELECT w, sum(n) AS n FROM uo GROUP BY w),
bo AS (SELECT doc_id, c, w, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY doc_id, c, w), b AS (SELECT c, w, sum(n) AS n FROM bo GROUP BY c, w),
t_o AS (SELECT doc_id, d, c, w, count(*) AS n FROM g WHERE d IS NOT NULL GROUP BY doc_id, d, c, w), t AS (SELECT d, c, w, sum(n) AS n FROM t_o GROUP BY d, c, w),
us AS (SELECT doc_id, w, u.n - uo.n AS n FROM uo JOIN u USING (w)), bs AS (SELECT doc_id, c, w, b.n - bo.n AS n FROM bo JOIN b USING (c, w)),
ts AS (SELECT doc_id, d, c, w, t.n - t_o.n AS n FROM t_o JOIN t USING (d, c, w)),
x AS (
  SELECT g.doc_id, g.c, g.d, us.n AS nu, bs.n AS nb, uc.n AS nc, ts.n AS nt, bc.n AS nd, greatest(1, total.n - size.n)::DOUBLE AS rest
  FROM g JOIN total ON true JOIN size USING (doc_id) JOIN us ON g.doc_id = us.doc_id AND g.w = us.w
  LEFT JOIN bs ON g.doc_id = bs.doc_id AND g.c = bs.c AND g.w = bs.w LEFT JOIN us uc ON g.doc_id = uc.doc_id AND g.c = uc.w
  LEFT JOIN ts ON g.doc_id = ts.doc_id AND g.d = ts.d AND g.c = ts.c AND g.w = ts.w LEFT JOIN bs bc ON g.doc_id = bc.doc_id AND g.d = bc.c AND g.c = bc.w),
s1 AS (SELECT *, CASE WHEN nu > 0 THEN nu / rest ELSE 0.4::DOUBLE / rest END AS a FROM x),
s2 AS (SELECT *, CASE WHEN c IS NULL THEN a WHEN nb > 0 THEN nb / nc::DOUBLE ELSE 0.4::DOUBLE * a END AS e FROM s1),
s AS (SELECT doc_id, sum(ln(CASE WHEN d IS NULL THEN e WHEN nt > 0 THEN nt / nd::DOUBLE ELSE 0.4::DOUBLE * e END)) AS t, count(*) AS n FROM s2 GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_words, round(coalesce(s.t, 0.0::DOUBLE), 6) AS log_score, round(s.t / s.n, 9) AS mean_log_score
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": _URL, "op6_embedding_near_dedup": _EMBEDDINGS, "op8_lm_scoring": _LM, "op9_line_dedup": _LINES}
