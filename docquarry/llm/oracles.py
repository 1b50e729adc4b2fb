"""SQL of the corpus queries that SQL can express, for DuckDB."""

OP2_QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT r, i, concat_ws(chr(31), w, lead(w, 1) OVER o, lead(w, 2) OVER o) AS g, lead(w, 2) OVER o AS last FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g WHERE last IS NOT NULL) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: length(x) > 1 AND NOT regexp_matches(x, '\p{Ll}') AND regexp_matches(x, '\p{Lu}'))) AS upper_words, len(ls) AS lines, len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS bare
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN n_repeat_words * 100 > n_words * 50 THEN 2 ELSE 0 END + CASE WHEN n_symbols * 100 > n_words * 10 THEN 4 ELSE 0 END
    + CASE WHEN upper_words * 100 > n_words * 50 THEN 8 ELSE 0 END + CASE WHEN bare * 100 > n_words * 30 THEN 16 ELSE 0 END + CASE WHEN n_dup_lines * 100 > lines * 50 THEN 32 ELSE 0 END
    + CASE WHEN word_chars > n_words * 20 OR word_chars < n_words * 2 THEN 64 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

OP6_MTREE = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, vec_id, list_transform(e, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM v),
s AS (SELECT q.r AS query, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM x q JOIN x c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

OP11_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce((SELECT sum(c) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + v.v)::HUGEINT AS p
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)::HUGEINT) // (first(n) + first(v))::HUGEINT AS q FROM (SELECT c.lang, c.term, c.c, v.v, (SELECT sum(c) FROM c y WHERE y.lang = c.lang) AS n FROM c JOIN v USING (lang)) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 200
"""

OP12_URL_FILTERS = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT s.*, l.bad FROM s LEFT JOIN l ON l.doc_id = TRY_CAST(regexp_extract(s.path, '/([0-9]{1,18})([/.]|\z)', 1) AS BIGINT)),
b AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\.?$', '') AS bare, count(bad) AS n, count(*) FILTER (WHERE bad) AS k FROM o GROUP BY host),
x AS (SELECT *, CASE WHEN regexp_matches(bare, '^[0-9.]*$|:') THEN '' WHEN array_to_string(string_split(bare, '.')[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in') THEN array_to_string(string_split(bare, '.')[-2:], '.') ELSE string_split(bare, '.')[-1] END AS suffix FROM b),
h AS (SELECT *, CASE WHEN suffix = '' THEN bare WHEN contains(suffix, '.') THEN array_to_string(string_split(bare, '.')[-3:], '.') ELSE array_to_string(string_split(bare, '.')[-2:], '.') END AS domain FROM x),
root AS (SELECT (sum(k) + 1.0::DOUBLE) / (sum(n) + 2) AS m FROM h),
s1 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM h GROUP BY suffix),
r1 AS (SELECT round(1 / least(greatest(CASE WHEN sum((n - 1) * m * (1 - m)) <> 0 THEN sum(n * (k / n - m) ** 2 - m * (1 - m)) / sum((n - 1) * m * (1 - m)) ELSE 0.5 END, 0.001), 0.5) - 1, 6) AS t FROM s1, root WHERE n > 0),
m1 AS (SELECT suffix, (k + t * m) / (n + t) AS m FROM s1, root, r1),
s2 AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM h GROUP BY domain, suffix),
r2 AS (SELECT round(1 / least(greatest(CASE WHEN sum((n - 1) * m * (1 - m)) <> 0 THEN sum(n * (k / n - m) ** 2 - m * (1 - m)) / sum((n - 1) * m * (1 - m)) ELSE 0.5 END, 0.001), 0.5) - 1, 6) AS t FROM s2 JOIN m1 USING (suffix) WHERE n > 0),
m2 AS (SELECT domain, suffix, (k + t * m) / (n + t) AS m FROM s2 JOIN m1 USING (suffix), r2),
r3 AS (SELECT round(1 / least(greatest(CASE WHEN sum((n - 1) * m * (1 - m)) <> 0 THEN sum(n * (k / n - m) ** 2 - m * (1 - m)) / sum((n - 1) * m * (1 - m)) ELSE 0.5 END, 0.001), 0.5) - 1, 6) AS t FROM h JOIN m2 USING (domain, suffix) WHERE n > 0),
m3 AS (SELECT host, (k + t * m) / (n + t) AS m, n + t AS w FROM h JOIN m2 USING (domain, suffix), r3),
rules AS (SELECT rule, verdict, regexp_extract(rule, '^([^/]*)', 1) AS rhost, regexp_extract(rule, '^[^/]*(.*)$', 1) AS rpath FROM (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')) AS v(rule, verdict)),
f AS (SELECT s.*, (SELECT max((length(rule), verdict, rule)) FROM rules WHERE (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)) AS best FROM s)
SELECT page_id, f.host, path, best[3] AS rule, coalesce(best[2], CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (w + 1)) > 0.25 THEN 'block' ELSE 'allow' END) AS verdict FROM f JOIN m3 USING (host)
"""

ORACLES = {"op2_quality_rules": OP2_QUALITY_RULES, "op6_mtree": OP6_MTREE, "op11_divergence": OP11_DIVERGENCE, "op12_url_filters": OP12_URL_FILTERS}
