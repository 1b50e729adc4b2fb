"""Text, hashing, structure and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import structure
from ..sources import files, registry
from .base import query

TOK = "regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')"


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, sha1(list_aggregate(t, 'string_agg', ' ')) AS digest FROM (SELECT doc_id, {TOK} AS t FROM documents)")
def str_tokens(spark, table):
    t = text.tokens(F.col("text"))
    return table("documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.when(F.size("t") > 0, F.sha1(F.array_join("t", " ").cast("binary"))).alias("digest"))


@query(r"SELECT fingerprint, min(doc_id) AS doc_id, count(*)::BIGINT AS n FROM (SELECT doc_id, sha1(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS fingerprint FROM documents) GROUP BY fingerprint")
def str_fingerprint_dedup(spark, table):
    return table("documents").groupBy(text.fingerprint(F.col("text")).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(r"""SELECT page_id, name, regexp_replace(regexp_replace(lower(name), '\.(pdf|docx|doc|xlsx|xls|csv|tsv|pptx|ppt|html|htm|txt|md|json)$', ''), '[^a-z0-9]+', '', 'g') AS key
FROM (SELECT page_id, regexp_extract(trim(url), '([^/]*)/*$', 1) AS name FROM pages)""")
def str_doc_key(spark, table):
    return table("pages").select("page_id", text.basename(F.col("url")).alias("name"), text.document_key(F.col("url")).alias("key"))


@query(r"SELECT doc_id, list_aggregate(list_sort(list_distinct(regexp_extract_all(text, '(?:19|20)\d{2}'))), 'string_agg', ',') AS years FROM documents WHERE regexp_matches(text, '(?:19|20)\d{2}')")
def str_years(spark, table):
    d = table("documents").where(F.col("text").rlike(r"(?:19|20)\d{2}"))
    return d.select("doc_id", F.array_join(F.transform(text.years_in(F.col("text")), lambda y: y.cast("string")), ",").alias("years"))


@query(r"""SELECT doc_id, CASE WHEN length(t) <= 320 THEN t ELSE rtrim(substr(t, 1, 317)) || '...' END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def str_excerpt(spark, table):
    return table("documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


CITED = [
    (1, "First [S1], then [S02] and again [S1]; [S10] last."), (2, "None here."), (3, "[S0] is no citation, [S3] is; [D1S2] is another kind."), (4, None), (5, "[s4]  [S4] and [S7] [S8]"),
]
_CITED_SQL = "(VALUES " + ", ".join(f"({i}, {'NULL' if t is None else chr(39) + t + chr(39)})" for i, t in CITED) + ") v(id, t)"


@query(rf"""WITH c AS (SELECT id, t, list_transform(regexp_extract_all(t, '\[\s*[Ss]0*([1-9]\d*)\s*\]', 1), lambda n: 'S' || n) AS l FROM {_CITED_SQL}),
p AS (SELECT id, unnest(l) AS s, unnest(range(len(l))) AS i FROM c), o AS (SELECT id, s, min(i) AS i FROM p GROUP BY id, s)
SELECT c.id::INTEGER AS id, coalesce((SELECT string_agg(s, ' ' ORDER BY i) FROM o WHERE o.id = c.id), CASE WHEN t IS NULL THEN NULL ELSE '' END) AS cited,
  (SELECT string_agg(s, ' ' ORDER BY i) FROM o WHERE o.id = c.id AND s NOT IN ('S1', 'S3', 'S4')) AS invalid FROM c""")
def str_citations(spark, table):
    d = spark.createDataFrame(CITED, "id int, t string").withColumn("l", text.citations(F.col("t")))
    ok = F.array(*map(F.lit, ("S1", "S3", "S4")))
    bad = F.array_except("l", ok)
    return d.select("id", F.array_join("l", " ").alias("cited"), F.nullif(F.array_join(bad, " "), F.lit("")).alias("invalid"))


SECRET_ROWS = [
    (1, "Authorization: Basic abc"), (2, "see https://joe:pw1@host/x"), (3, "password=hunter2, next"), (4, "sent Bearer abcdef123456 ok"), (5, r"C:\Users\me\file.txt here"),
    (6, "tok eyJhbGci.eyJzdWIi.c2lnbmF0 end"), (7, "plain text, nothing to hide"), (8, "api_key: k-123; done"), (9, "see /home/me/x.txt, /etc/hosts and /usr/lib/ but not a/b/c or 12/03/2024 or /single"), (10, "passphrase=x y credentials: (abc)"),
]
_R = "t"
for _p, _by in text.SECRETS:
    _R = "regexp_replace({}, '{}', '{}', 'g')".format(_R, _p.replace("'", "''"), _by.replace("$1", "\\1"))
_SECRET_SQL = " UNION ALL ".join(f"SELECT {i}::BIGINT AS id, '{t}' AS t" for i, t in SECRET_ROWS)


@query(f"WITH r AS ({_SECRET_SQL} UNION ALL SELECT 1000 + doc_id, text FROM documents), x AS (SELECT id, t, {_R} AS clean FROM r) SELECT id, sha1(clean) AS digest, clean <> t AS changed FROM x")
def str_redact(spark, table):
    rows = spark.createDataFrame(SECRET_ROWS, "id long, t string").unionByName(table("documents").select((F.col("doc_id") + 1000).alias("id"), F.col("text").alias("t")))
    return rows.withColumn("clean", text.redact(F.col("t"))).select("id", F.sha1(F.col("clean").cast("binary")).alias("digest"), (F.col("clean") != F.col("t")).alias("changed"))


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(text.GENERIC_TOKENS))
_WEAK = f"(length(x) < 3 OR x IN ({_STOP}) OR regexp_matches(x, '^[0-9]+$') OR (length(x) >= 8 AND (regexp_matches(x, '^[0-9a-f]+$') OR (regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-z]')))))"


def useful_sql(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(strip_accents(lower(regexp_replace({c}, '(?i)\\.[a-z0-9]{{1,5}}$', ''))), '[a-z0-9]+'), lambda x: NOT {_WEAK})))"


@query(f"SELECT p_partkey, list_aggregate(u, 'string_agg', ' ') AS tokens, CASE WHEN len(u) >= 2 THEN list_aggregate(list_transform(u, lambda x: x[1]), 'string_agg', '') ELSE '' END AS acronym FROM (SELECT p_partkey, {useful_sql('p_name')} AS u FROM part)")
def str_acronym(spark, table):
    u = table("part").select("p_partkey", text.useful_tokens(F.col("p_name")).alias("u"))
    return u.select("p_partkey", F.when(F.size("u") > 0, F.array_join("u", " ")).alias("tokens"), text.acronym(F.col("u")).alias("acronym"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b)
SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS body FROM c""")
def html_text(spark, table):
    return table("pages").select("page_id", files.html_text(F.col("html")).alias("body"))


_CELLS = r"list_transform(string_split(regexp_replace(regexp_replace(trim(line), '^\|', ''), '\|$', ''), '|'), lambda x: trim(x))"
_RUNS = rf"""l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line, unnest(range(len(string_split_regex(text, '\r\n|\r|\n')))) AS pos FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM l WHERE trim(line) <> ''),
c AS (SELECT *, {_CELLS} AS cells FROM n),
t AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM c WHERE contains(line, '|') AND len(cells) >= 2 AND len(list_filter(cells, lambda x: x <> '')) > 0),
s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS size FROM t),
runs AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY island) AS "table", row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS row, rtrim(line) AS line FROM s WHERE size >= 2)"""


@query(f'WITH {_RUNS} SELECT doc_id, "table"::BIGINT AS "table", row::BIGINT AS row, line FROM runs')
def table_lines(spark, table):
    return structure.table_runs(structure.lines(table("documents")))


@query(f"""WITH {_RUNS}, body AS (SELECT doc_id, "table", row - 2 AS b, line FROM runs WHERE row > 1), size AS (SELECT doc_id, "table", count(*) AS n FROM body GROUP BY ALL),
w AS (SELECT doc_id, "table", n, unnest(range(0, greatest(ceil((n - 12) / 10.0), 0)::BIGINT + 1)) AS win FROM size),
g AS (SELECT w.doc_id, w."table", win, min(b) + 2 AS first_row, max(b) + 2 AS last_row, string_agg(line, chr(10) ORDER BY b) AS rows FROM w JOIN body ON body.doc_id = w.doc_id AND body."table" = w."table" AND b >= win * 10 AND b < win * 10 + 12 GROUP BY ALL)
SELECT g.doc_id, g."table"::BIGINT AS "table", win::BIGINT AS "window", first_row::BIGINT AS first_row, last_row::BIGINT AS last_row, line || chr(10) || rows AS text FROM g JOIN runs ON runs.doc_id = g.doc_id AND runs."table" = g."table" AND runs.row = 1""")
def table_windows(spark, table):
    return structure.table_windows(structure.table_runs(structure.lines(table("documents"))))


_BULLET = r"^\s*(?:[-*•·–—o]|\(?[0-9]{1,3}[.)]|[a-zA-Z][.)])\s+\S"


@query(rf"""WITH g AS (SELECT doc_id, unnest(a) AS grp, unnest(range(len(a))) AS gi FROM (SELECT doc_id, regexp_split_to_array(text, '(?:\r?\n[ \t]*){{2,}}') AS a FROM documents WHERE text <> '')),
l AS (SELECT doc_id, gi, unnest(a) AS line, unnest(range(len(a))) AS li FROM (SELECT doc_id, gi, regexp_split_to_array(grp, '\r\n|\r|\n') AS a FROM g)),
n AS (SELECT doc_id, gi, li, regexp_replace(line, '\s+$', '') AS line, {_CELLS} AS cells FROM l WHERE regexp_matches(line, '\S')),
t AS (SELECT *, contains(line, '|') AND len(cells) >= 2 AND len(list_filter(cells, lambda x: x <> '')) > 0 AS tab, regexp_matches(line, '{_BULLET}') AS bullet FROM n),
c AS (SELECT *, CASE WHEN tab IS DISTINCT FROM lag(tab) OVER (PARTITION BY doc_id, gi ORDER BY li) THEN 1 ELSE 0 END AS new FROM t), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, gi ORDER BY li) AS run FROM c),
b AS (SELECT doc_id, gi, run, any_value(tab) AS tab, count(*) AS n, count(*) FILTER (bullet) AS bullets, string_agg(line, chr(10) ORDER BY li) AS text FROM r GROUP BY ALL),
k AS (SELECT *, CASE WHEN tab AND n >= 2 THEN 'table' WHEN n = 1 AND length(trim(text)) <= 120 AND (trim(text) LIKE '#%' OR NOT (contains(text, '|') OR bullets > 0 OR regexp_matches(trim(text), '[.;,!?]$'))) THEN 'title' WHEN n >= 2 AND bullets >= greatest(2, n // 2) THEN 'list' ELSE 'paragraph' END AS kind FROM b)
SELECT doc_id, row_number() OVER w::BIGINT AS pos, kind, last_value(CASE WHEN kind = 'title' THEN trim(regexp_replace(trim(text), '^#+', '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY gi, run ROWS UNBOUNDED PRECEDING) AS section, sha1(text) AS digest FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY gi, run)""")
def text_blocks(spark, table):
    """Blocks of every document: groups between blank lines, parted into tables, lists, titles and paragraphs, with the section that they stand in."""
    return structure.blocks(table("documents")).select("doc_id", "pos", "kind", "section", F.sha1(F.col("text").cast("binary")).alias("digest"))


@query()
def structure_chunks(spark, table):
    return structure.chunks(table("documents"))


@query("""SELECT doc_id, sha256(text) AS hash, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (position(h[17:17] IN '0123456789abcdef') - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id
FROM (SELECT doc_id, text, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || ':0')) AS h FROM documents)""")
def hash_uuid5(spark, table):
    return table("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), registry.point_id(F.col("doc_id").cast("string"), F.lit("0")).alias("point_id"))


@query("""WITH a AS (SELECT doc_id, lang AS hash, quality::VARCHAR AS signature FROM documents JOIN labels USING (doc_id)), b AS (SELECT doc_id, lang AS hash, CASE WHEN n_chars > 1000 THEN '1' ELSE '0' END AS signature FROM documents)
SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.doc_id IS NULL THEN 'new' WHEN a.hash IS NOT DISTINCT FROM b.hash AND a.signature IS NOT DISTINCT FROM b.signature THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b USING (doc_id)""")
def registry_diff(spark, table):
    d = table("documents")
    old = d.join(table("labels"), "doc_id").select("doc_id", F.col("lang").alias("hash"), F.col("quality").cast("string").alias("signature"))
    new = d.select("doc_id", F.col("lang").alias("hash"), F.when(F.col("n_chars") > 1000, "1").otherwise("0").alias("signature"))
    return registry.difference(old, new, "doc_id")


@query("""WITH d AS (SELECT documents.*, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT count(*) AS n FROM d),
f AS (SELECT 'lang' AS field, count(nullif(trim(lang), '')) AS filled FROM d UNION ALL SELECT 'source', count(nullif(trim(source), '')) FROM d UNION ALL SELECT 'quality', count(quality) FROM d UNION ALL SELECT 'toxic', count(toxic) FROM d)
SELECT field, n, filled, round(100.0 * filled / greatest(n, 1), 1)::DOUBLE AS rate FROM f, n""")
def fill_rate(spark, table):
    return registry.fill_rates(table("documents").join(table("labels"), "doc_id", "left"), ["lang", "source", "quality", "toxic"])


NUMBERS = ["4 500,00 €", "4.500,00", "4,500.00", "(1 250,5)", "12,34,567", "1,234,567", "0,125", "0.5", "1,234", "12.5", "-7", "1e3", "n/a", "", None, "abc", "1.234567", "total: 3 units", "−42", "1'234"]
NUMBER_VALUES = [4500.0, 4500.0, 4500.0, -1250.5, 1234567.0, 1234567.0, 0.125, 0.5, 1234.0, 12.5, -7.0, 1000.0, None, None, None, None, 1.234567, 3.0, -42.0, 1234.0]


@query("SELECT id::INTEGER AS id, v::DOUBLE AS value, (CASE WHEN v = floor(v) THEN v END)::BIGINT AS whole FROM (VALUES " + ", ".join(f"({i}, {'NULL' if v is None else v})" for i, v in enumerate(NUMBER_VALUES)) + ") t(id, v)")
def norm_number(spark, table):
    d = spark.createDataFrame(list(enumerate(NUMBERS)), "id int, t string")
    return d.select("id", values.number(F.col("t")).alias("value"), values.integer(F.col("t")).alias("whole"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS iso, o_orderdate::DATE AS local, o_orderdate::DATE AS named, NULL::DATE AS partial FROM orders""")
def norm_date(spark, table):
    d = F.col("o_orderdate")
    months = F.array(*map(F.lit, ("janvier", "fév", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")))
    month = F.element_at(F.transform(months, lambda m: F.when(m == "fév", "février").otherwise(m)), F.month(d))
    forms = table("orders").select("o_orderkey", F.date_format(d, "yyyy-MM-dd HH:mm:ss").alias("a"), F.date_format(d, "dd/MM/yyyy").alias("b"), F.concat_ws(" ", F.dayofmonth(d), month, F.year(d)).alias("c"), F.date_format(d, "MM/yyyy").alias("e"))
    return forms.select("o_orderkey", values.date(F.col("a")).alias("iso"), values.date(F.col("b")).alias("local"), values.date(F.col("c")).alias("named"), values.date(F.col("e")).alias("partial"))


@query("""SELECT conv_id, turn, CASE WHEN k IN ('1', 'true', 'vrai', 'vraie', 'oui', 'yes', 'y', 'on') THEN true WHEN k IN ('0', 'false', 'faux', 'fausse', 'non', 'no', 'n', 'off') THEN false END AS value
FROM (SELECT conv_id, turn, trim(strip_accents(lower(CASE role WHEN 'user' THEN ' OUI ' WHEN 'assistant' THEN 'No' ELSE text END))) AS k FROM conversations)""")
def norm_bool(spark, table):
    word = F.when(F.col("role") == "user", " OUI ").when(F.col("role") == "assistant", "No").otherwise(F.col("text"))
    return table("conversations").select("conv_id", "turn", values.boolean(word).alias("value"))
