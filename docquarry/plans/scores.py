"""Queries of sources, checks, scoring and reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, text, values
from ..operators import attributes, entities, filters, scoring, structure
from ..sources import corpora, datasets, files, pdf, uploads
from .base import query
from .texts import TOK

_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '[-_]+', ' ', 'g'), '[^\p{L}\p{M}\p{N}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha1({_PLAIN}) AS digest, length({_PLAIN})::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def normal_texts(spark, table):
    """Texts under the default normalisation: no accents, case, joiners or punctuation."""
    t = table("documents").where("text is not null").select("doc_id", text.normal_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.sha1(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n"))


@query("""WITH t AS (SELECT o_orderkey AS id, 'D' || o_orderkey % 3 || 'S' || o_custkey % 5 AS c FROM orders), l AS (SELECT id, c, CASE WHEN c = 'D1S2' THEN [c] ELSE [c, 'D1S2'] END AS cs FROM t)
SELECT id, array_to_string(list_filter(cs, lambda x: x IN ('D1S2', 'D0S1', 'D2S4')), ' ') AS valid, array_to_string(list_filter(cs, lambda x: x NOT IN ('D1S2', 'D0S1', 'D2S4')), ' ') AS invalid,
  CASE WHEN c IN ('D1S2', 'D0S1', 'D2S4') THEN 'see [' || c || '] and [D1S2].' ELSE 'see and [D1S2].' END AS kept FROM l""")
def document_citations(spark, table):
    """Citations of several documents, split by what is allowed, and the text without the others."""
    t = F.concat(F.lit("see [D"), (F.col("o_orderkey") % 3).cast("string"), F.lit("S"), (F.col("o_custkey") % 5).cast("string"), F.lit("] and [D1S2]."))
    ok = F.array(*map(F.lit, ("D1S2", "D0S1", "D2S4")))
    d = table("orders").select(F.col("o_orderkey").alias("id"), t.alias("t")).withColumn("s", text.split_citations(text.document_citations(F.col("t")), ok))
    return d.select("id", F.array_join("s.valid", " ").alias("valid"), F.array_join("s.invalid", " ").alias("invalid"), text.keep_document_citations(F.col("t"), ok).alias("kept"))


@query("SELECT p_partkey, p_type || ' / ' || p_brand AS keywords FROM part")
def keyword_sets(spark, table):
    """Keywords that differ in case, accents or white space count once, in their first spelling."""
    words = F.array("p_type", F.lower("p_type"), F.concat(F.lit("  "), "p_type", F.lit(" ")), "p_brand", F.lit(" "), F.upper("p_brand"))
    return table("part").select("p_partkey", F.array_join(text.keywords(words), " / ").alias("keywords"))


@query("SELECT o_orderkey, 2::BIGINT AS n, round(o_totalprice, 2) AS price, o_custkey::DOUBLE AS customer, round(round(o_totalprice, 2) * 100)::BIGINT AS cents FROM orders")
def numbers_in_answers(spark, table):
    """Numbers inside answers, citations left out, thousands parted; the price also as an exact decimal."""
    price = F.format_number(F.round("o_totalprice", 2), 2)
    t = F.concat(F.lit("[S4] The order of "), price, F.lit(" euros by customer "), F.col("o_custkey").cast("string"), F.lit(" [D1S2]."))
    d = table("orders").select("o_orderkey", t.alias("t"), price.alias("p")).withColumn("ns", values.numbers_in(F.col("t")))
    return d.select("o_orderkey", F.size("ns").cast("long").alias("n"), F.get("ns", F.lit(0)).alias("price"), F.get("ns", F.lit(1)).alias("customer"), (values.decimal(F.col("p")) * 100).cast("long").alias("cents"))


@query("SELECT p_partkey, p_size % 3 = 0 AS separator FROM part")
def separator_rows(spark, table):
    line = F.when(F.col("p_size") % 3 == 0, "|---|:--:|--:|").when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" | --"))).otherwise("-- no table")
    return table("part").select("p_partkey", structure.is_separator(line).alias("separator"))


@query("SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN 'before' || chr(10) || 'after ' || p_brand ELSE 'before' || chr(10) || p_name || ' ' || p_brand || chr(10) || 'after ' || p_brand END AS body FROM part")
def lines_without_tables(spark, table):
    """A page's text loses the lines that its tables hold, whatever bars and white space part their cells."""
    page = F.concat(F.lit("before\n"), "p_name", F.lit(" "), "p_brand", F.lit("\nafter "), "p_brand")
    row = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Head | Er\n"), F.upper("p_name"), F.lit("  |  "), "p_brand")).otherwise("Head | Er")
    return table("part").select("p_partkey", structure.without_table_lines(page, F.array(row)).alias("body"))


@query("""SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE 1 END::INTEGER AS page,
CASE p_partkey % 6 WHEN 0 THEN 'name | brand' || chr(10) || p_name || ', big | ' || p_brand WHEN 1 THEN p_name WHEN 2 THEN 'café | ' || p_brand WHEN 3 THEN p_name || ' & co' || chr(10) || 'é' WHEN 4 THEN 'a' || chr(65533) || p_brand END AS text,
CASE WHEN p_partkey % 6 = 5 THEN 'unsupported' END AS error FROM part""")
def file_pages(spark, table):
    """Pages of small files: quoted cells with separators, Latin-1, bad bytes, entities, hidden scripts, unknown kinds."""
    k = F.col("p_partkey") % 6
    kind = F.when(k.isin(0, 2), "csv").when(k.isin(1, 4), "txt").when(k == 3, "html").otherwise("xyz")
    csv = F.concat(F.lit('name,brand\r\n"'), "p_name", F.lit(', big",  '), "p_brand", F.lit(" \r\n,\r\n"))
    html = F.concat(F.lit("<html><script>no()</script><p>"), "p_name", F.lit(" &amp; co</p>\n<p> &eacute; </p>"))
    raw = (
        F.when(k == 0, F.encode(csv, "UTF-8")).when(k == 1, F.encode(F.concat(F.lit("  "), "p_name", F.lit(" \n")), "UTF-8")).when(k == 2, F.encode(F.concat(F.lit("café,"), "p_brand"), "ISO-8859-1"))
        .when(k == 3, F.encode(html, "UTF-8")).when(k == 4, F.concat(F.unhex(F.lit("61FF")), F.encode("p_brand", "UTF-8"))).otherwise(F.encode("p_name", "UTF-8"))
    )
    made = table("part").select(F.col("p_partkey").cast("string").alias("path"), kind.alias("extension"), raw.alias("content"))
    return files.pages(made).drop("warning")


@query("""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, regexp_replace(text, '[^ -~' || chr(10) || 'à-ÿ]', '', 'g') AS text FROM conversations),
l AS (SELECT conv_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '') AS ls FROM t), n AS (SELECT conv_id, sum(len(array_to_string(ls, chr(10)))) AS n, max(len(ls)) AS most FROM l GROUP BY 1)
SELECT conv_id::VARCHAR AS path, page::INTEGER AS page, array_to_string(ls, chr(10)) AS text, NULL::VARCHAR AS error, CASE WHEN n < 100 THEN 'little_text' END AS warning FROM l JOIN n USING (conv_id) WHERE len(ls) > 0
UNION ALL SELECT conv_id::VARCHAR, NULL, NULL, 'needs_recognition', 'little_text' FROM n WHERE most = 0""")
def pdf_pages(spark, table):
    """Conversations as PDF files, a page a turn, read again: pages in the order of the tree, codes through the font's map, objects in streams. Characters beyond Latin are left out before."""
    plain = F.regexp_replace("text", "[^ -~\nà-ÿ]", "")
    turns = table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.split(plain, "\n").alias("lines")))).alias("turns"))

    def run(batches):
        for b in batches:
            made = [pdf.write([t["lines"] for t in turns_]) for turns_ in b.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id").cast(pa.string()), pa.array(["pdf"] * len(made)), pa.array(made, pa.binary())], ["path", "extension", "content"])

    return files.pages(turns.mapInArrow(run, "path string, extension string, content binary"))


@query("""SELECT o_orderkey AS request, CASE WHEN o_orderkey % 2 = 0 THEN 'search' END AS capability, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey || ',x' || o_custkey ELSE o_orderpriority || ',c' || o_custkey END AS documents, 3::BIGINT AS source_count, CASE WHEN o_orderstatus = 'O' THEN 'no_evidence' END AS refusal_code,
CASE WHEN o_orderstatus = 'P' THEN 'agent' END AS error_category, CASE WHEN o_orderstatus = 'P' THEN 'model' END AS error_code, CASE WHEN o_orderstatus = 'P' THEN 'order ' || o_orderkey || ' in [PATH]' END AS error_message FROM orders""")
def response_attributes(spark, table):
    """What events say of responses: documents resolved or else of the sources, codes of refusals and errors, messages without folders; read back from the JSON that leaves."""
    key, state, who = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    status = F.when(state == "F", "answered").when(state == "O", "refused").otherwise("error")
    clerk, none = F.concat(F.lit("c"), who), F.lit(None).cast("string")
    resolved = F.when(key % 3 == 0, F.array(clerk, none, F.concat(F.lit("x"), who), clerk, F.lit("")))
    sources, code = F.array("o_orderpriority", clerk, clerk), F.when(state == "O", "no_evidence").otherwise("model")
    made = attributes.agent(status, F.when(key % 2 == 0, "search").otherwise(""), resolved, sources, F.array(F.lit("S1")), code, F.concat(F.lit("order "), key.cast("string"), F.lit(" in /var/spool/orders")))
    kept = F.from_json(attributes.serialized("agent", made), "capability string, documents array<string>, source_count long, refusal_code string, error_category string, error_code string, error_message string")
    d = table("orders").select(key.alias("request"), kept.alias("a"))
    return d.select("request", "a.capability", F.array_join("a.documents", ",").alias("documents"), "a.source_count", "a.refusal_code", "a.error_category", "a.error_code", "a.error_message")


_UPLOAD = "SELECT o_custkey AS batch, o_orderkey AS pos, CASE o_orderkey % 7 WHEN 0 THEN 'a/../b.txt' WHEN 1 THEN '/abs.txt' WHEN 2 THEN 'x.exe' ELSE 'f' || o_orderkey || '.TXT' END AS path, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 1000 END AS length FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 > 2"


@query(f"""WITH f AS ({_UPLOAD}), s AS (SELECT *, sum(length) OVER (PARTITION BY batch ORDER BY pos) AS upto, count(*) OVER (PARTITION BY batch) AS n, row_number() OVER (PARTITION BY batch, lower(path) ORDER BY pos) AS seen FROM f),
e AS (SELECT batch, pos, path, CASE WHEN contains(path, '..') THEN 'parent' WHEN path LIKE '/%' THEN 'absolute' WHEN path LIKE '%.exe' THEN 'extension' WHEN length <= 0 THEN 'empty_file' WHEN length > 900 THEN 'too_large' WHEN seen > 1 THEN 'repeated' WHEN n > 12 THEN 'too_many_files' WHEN upto > 4000 THEN 'too_many_bytes' END AS error FROM s)
SELECT batch, pos, path, error, count(error) OVER (PARTITION BY batch) = 0 AS accepted FROM e""")
def upload_batches(spark, table):
    """Uploads of each customer, checked as a whole: one bad file refuses the batch."""
    k = F.col("o_orderkey")
    o = table("orders").where((k % 3 == 0) | (k % 7 > 2))
    path = F.when(k % 7 == 0, "a/../b.txt").when(k % 7 == 1, "/abs.txt").when(k % 7 == 2, "x.exe").otherwise(F.concat(F.lit("f"), k.cast("string"), F.lit(".TXT")))
    made = o.select(F.col("o_custkey").alias("batch"), k.alias("pos"), path.alias("path"), F.when(k % 11 == 0, 0).otherwise(k % 1000).alias("length"))
    return uploads.check_batch(made, max_bytes=900, most=12, total=4000)


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'ftp://example.org/a.pdf' WHEN 1 THEN 'http://10.0.0.' || page_id % 200 || '/b.txt' WHEN 2 THEN 'https://LocalHost:8080/c.md' WHEN 3 THEN 'https://me:pw@Example.org:81/x/My%20File.PDF?q=1#p' WHEN 4 THEN 'http://[::1]/d.html' ELSE 'https://example.org/' END AS url FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'example.org' WHEN 1 THEN '10.0.0.' || page_id % 200 WHEN 2 THEN 'localhost' WHEN 3 THEN 'example.org' WHEN 4 THEN '::1' ELSE 'example.org' END AS host, CASE page_id % 6 WHEN 0 THEN 'scheme' WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE 'address' END AS error,
CASE page_id % 6 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.txt' WHEN 2 THEN 'c.md' WHEN 3 THEN 'My File.PDF' WHEN 4 THEN 'd.html' END AS name, CASE WHEN page_id % 6 = 5 THEN 'no_name' END AS name_error FROM u""")
def url_checks(spark, table):
    k = F.col("page_id") % 6
    url = F.when(k == 0, "ftp://example.org/a.pdf").when(k == 1, F.concat(F.lit("http://10.0.0."), (F.col("page_id") % 200).cast("string"), F.lit("/b.txt"))).when(k == 2, "https://LocalHost:8080/c.md").when(k == 3, "https://me:pw@Example.org:81/x/My%20File.PDF?q=1#p").when(k == 4, "http://[::1]/d.html").otherwise("https://example.org/")
    d = table("pages").select("page_id", url.alias("url"))
    return d.select("page_id", uploads.url_host(F.col("url")).alias("host"), uploads.url_error(F.col("url")).alias("error"), uploads.url_file(F.col("url"))["name"].alias("name"), uploads.url_file(F.col("url"))["error"].alias("name_error"))


@query("""WITH q AS (SELECT p_partkey AS file, unnest([1, 2]) AS i, p_name, p_size FROM part)
SELECT file, CASE WHEN p_size % 3 = 2 THEN i WHEN p_size % 3 = 1 THEN i ELSE i END::BIGINT AS pos, CASE i WHEN 1 THEN 'What is ' || p_name || '?' ELSE 'And why?' END AS question, CASE WHEN i = 1 AND p_size % 3 < 2 THEN p_name END AS expected_answer, CASE WHEN i = 2 AND p_size % 3 < 2 THEN 'a.pdf' END AS expected_document FROM q""")
def question_entries(spark, table):
    """Question files of three kinds: a JSON array, JSON lines, plain lines."""
    first = F.concat(F.lit('{"question": "What is '), "p_name", F.lit('?", "attendu": "'), "p_name", F.lit('"}'))
    second = F.lit('{"query": " And why? ", "document": "a.pdf", "attendu": ""}')
    value = (
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" ["), first, F.lit(","), second, F.lit(', {"other": 1}]'))).when(F.col("p_size") % 3 == 1, F.concat(first, F.lit("\n\n"), second))
        .otherwise(F.concat(F.lit("What is "), "p_name", F.lit("?\n# note\n\n And why? \n")))
    )
    return datasets.questions(table("part").select(F.col("p_partkey").alias("file"), value.alias("value")))


@query("""WITH c AS (SELECT event_id % 900 AS id, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE props END AS query, upper(event_type) AS expected_intent, CASE WHEN event_id % 17 <> 0 THEN 'x' END AS category FROM events),
n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM c), m AS (SELECT *, concat_ws(', ', CASE WHEN query = ' ' THEN 'query' END, CASE WHEN category IS NULL THEN 'category' END) AS missing FROM n)
SELECT DISTINCT id, CASE WHEN missing <> '' THEN 'missing ' || missing WHEN expected_intent NOT IN ('VIEW', 'CLICK', 'SIGNUP') THEN 'unknown_intent' ELSE 'repeated_id' END AS error FROM m WHERE missing <> '' OR expected_intent NOT IN ('VIEW', 'CLICK', 'SIGNUP') OR n > 1""")
def routing_case_checks(spark, table):
    e = F.col("event_id")
    cases = table("events").select((e % 900).alias("id"), F.when(e % 13 == 0, " ").otherwise(F.col("props")).alias("query"), F.upper("event_type").alias("expected_intent"), F.when(e % 17 != 0, "x").alias("category"), F.lit("en").alias("language"), F.lit("").alias("notes"))
    return datasets.check_routing(cases, ("VIEW", "CLICK", "SIGNUP"))


@query("""WITH q AS (SELECT p_partkey AS qid, CASE WHEN p_size > 45 THEN 'zz' ELSE p_type END AS title, CASE WHEN p_size < 5 THEN [] ELSE [p_brand] END AS evidence FROM part),
j AS (SELECT q.qid, len(q.evidence) AS ne, d.p_partkey AS doc_id, CASE WHEN d.p_partkey IS NOT NULL AND (len(q.evidence) = 0 OR d.p_brand = q.evidence[1]) THEN d.p_partkey END AS fit FROM q LEFT JOIN part d ON d.p_type = q.title),
g AS (SELECT qid, count(doc_id) AS n, count(fit) AS f, min(fit) AS doc_id, max(ne) AS ne FROM j GROUP BY qid), r AS (SELECT *, CASE WHEN n = 0 THEN 'unknown_title' WHEN ne = 0 THEN 'no_evidence' WHEN f = 0 THEN 'evidence_not_found' WHEN f > 1 THEN 'ambiguous' ELSE 'linked' END AS reason FROM g)
SELECT qid, CASE WHEN reason = 'linked' THEN doc_id END AS doc_id, reason FROM r""")
def gold_links(spark, table):
    """Questions to documents by title, settled by which document's sections hold the evidence."""
    p = table("part")
    asked = p.select(F.col("p_partkey").alias("qid"), F.when(F.col("p_size") > 45, "zz").otherwise(F.col("p_type")).alias("title"), F.when(F.col("p_size") < 5, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("evidence"))
    return datasets.link(asked, p.select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("title"), F.array("p_brand", "p_name").alias("sections")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS n, (count(*) FILTER ({c} IS NULL))::BIGINT AS nulls, {e}::BIGINT AS empty FROM documents" for c, e in (("doc_id", "0"), ("text", "(count(*) FILTER (trim(text) = ''))"), ("lang", "(count(*) FILTER (trim(lang) = ''))"), ("source", "(count(*) FILTER (trim(source) = ''))"), ("n_chars", "0"))))
def data_audit(spark, table):
    return datasets.audit(table("documents").select("doc_id", "text", "lang", "source", "n_chars")).select("column", "n", "nulls", "empty")


_RUNS = "SELECT 'c' || o_custkey % 40 AS corpus_id, o_orderkey AS run, o_orderkey % 4 AS found, (o_orderkey % 4) * (o_custkey % 3) // 2 AS failed FROM orders WHERE o_custkey % 40 < 30"


@query(f"""WITH c AS (SELECT 'c' || c_custkey % 40 AS corpus_id, min(c_name) AS name FROM customer GROUP BY 1), p AS (SELECT 'c' || l_suppkey % 25 AS corpus_id, l_orderkey AS doc_id FROM lineitem),
n AS (SELECT corpus_id, count(DISTINCT doc_id) AS nd, count(*) AS np FROM p GROUP BY 1), r AS ({_RUNS}), l AS (SELECT corpus_id, run, CASE WHEN found > 0 AND failed >= found THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'succeeded' END AS s FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY run DESC) AS k FROM r) WHERE k = 1)
SELECT c.corpus_id, name, coalesce(nd, 0)::BIGINT AS n_documents, coalesce(np, 0)::BIGINT AS n_points, run AS last_run, CASE WHEN s = 'failed' THEN 'failed' WHEN coalesce(np, 0) = 0 THEN 'empty' WHEN s = 'partial' THEN 'partial' ELSE 'ready' END AS status FROM c LEFT JOIN n USING (corpus_id) LEFT JOIN l USING (corpus_id)""")
def corpus_summaries(spark, table):
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    listed = table("customer").groupBy(name(F.col("c_custkey") % 40).alias("corpus_id")).agg(F.min("c_name").alias("name"))
    points = table("lineitem").select(name(F.col("l_suppkey") % 25).alias("corpus_id"), F.col("l_orderkey").alias("doc_id"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    runs = table("orders").where(c % 40 < 30).select(name(c % 40).alias("corpus_id"), k.alias("run"), (k % 4).alias("found"), F.floor((k % 4) * (c % 3) / 2).alias("failed"))
    return corpora.summaries(listed, points, runs)


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'documents' WHEN n_nationkey % 5 = 1 THEN NULL ELSE 'documents__c-' || n_nationkey END AS collection FROM nation")
def collection_names(spark, table):
    k = F.col("n_nationkey")
    c = F.when(k == 0, "default").when(k % 5 == 1, F.concat(F.lit("No Id "), k.cast("string"))).otherwise(F.concat(F.lit("c-"), k.cast("string")))
    return table("nation").select("n_nationkey", corpora.collection_name(c).alias("collection"))


_REG = "SELECT p_brand AS field, p_type AS canonical, list_sort(list_distinct(list(p_name))) AS alias, count(*) AS frequency FROM part GROUP BY ALL"


@query(f"WITH r AS ({_REG}), s AS (SELECT field, count(*)::BIGINT AS canonicals, sum(len(alias) + 1)::BIGINT AS variants, sum(frequency)::BIGINT AS occurrences FROM r GROUP BY 1), w AS (SELECT field, list_sort(list(canonical)) AS names FROM r WHERE frequency < 3 GROUP BY 1) SELECT s.*, coalesce(array_to_string(names, ','), '') AS rare FROM s LEFT JOIN w USING (field)")
def registry_statistics(spark, table):
    """A registry of names: canonical ones, variants, occurrences, and those seen fewer than three times."""
    r = table("part").groupBy(F.col("p_brand").alias("field"), F.col("p_type").alias("canonical")).agg(F.array_sort(F.collect_set("p_name")).alias("alias"), F.count("*").alias("frequency"))
    return entities.statistics(r).join(entities.rare(r), "field", "left").select("field", "canonicals", "variants", "occurrences", F.coalesce(F.array_join("names", ","), F.lit("")).alias("rare"))


@query("""WITH r AS (SELECT 'nation' AS field, n_name AS canonical, CASE WHEN n_nationkey % 4 = 0 THEN ['old ' || n_name] ELSE [] END AS alias, n_nationkey::BIGINT AS frequency FROM nation),
b AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS value, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), n AS (SELECT n_name AS canonical, count(*) AS n, max(CASE WHEN value <> n_name THEN value END) AS more FROM b GROUP BY 1)
SELECT field, canonical, array_to_string(list_sort(list_distinct(list_concat(alias, CASE WHEN more IS NULL THEN [] ELSE [more] END))), ',') AS alias, (frequency + coalesce(n, 0))::BIGINT AS frequency FROM r LEFT JOIN n USING (canonical)""")
def registry_update(spark, table):
    """The registry of nations after a batch: spellings met by likeness become aliases, frequencies grow."""
    nation = table("nation")
    k = F.col("n_nationkey")
    reg = nation.select(F.lit("nation").alias("field"), F.col("n_name").alias("canonical"), F.when(k % 4 == 0, F.array(F.concat(F.lit("old "), "n_name"))).otherwise(F.array().cast("array<string>")).alias("alias"), k.cast("long").alias("frequency"))
    b = table("customer").join(F.broadcast(nation), F.col("c_nationkey") == k).select(F.lit("nation").alias("field"), F.when(F.col("c_custkey") % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("value"), F.col("n_name").alias("canonical"))
    resolved = b.distinct().withColumn("phase", F.when(F.col("value") == F.col("canonical"), "exact").otherwise("letters"))
    return entities.update(reg, b.select("field", "value"), resolved).select("field", "canonical", F.array_join("alias", ",").alias("alias"), "frequency")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20.5 AND l_shipdate >= DATE '1994-02-01' AND l_returnflag IN ('R', 'A')")
def typed_filter(spark, table):
    """Criteria as users write them, read by the declared types of a profile."""
    profile = filters.Profile({"l_quantity": "number", "l_shipdate": "date", "l_returnflag": "text"}, frozenset({"l_quantity", "l_shipdate", "l_returnflag"}))
    criteria = filters.normalize(spark, {"l_quantity": {"gte": "10", "lt": "20,5"}, "l_shipdate": {"gte": "01/02/1994"}, "l_returnflag": ["R", "A", " "], "page": None}, profile)
    return filters.select(table("lineitem"), criteria, profile).select("l_orderkey", "l_linenumber")


_CASE = "SELECT doc_id AS id, doc_id % 6 AS kind, quality = 1 AS good, toxic = 1 AS bad, n_chars > 800 AS long, lang = 'de' AS german, doc_id % 7 AS seven, (doc_id % 10) / 10.0::DOUBLE AS g FROM documents JOIN labels USING (doc_id)"


@query(f"""WITH c AS ({_CASE}), v AS (SELECT id, CASE
  WHEN seven = 0 THEN ['TECHNICAL_ERROR', 'TECHNICAL_FAILURE'] WHEN seven = 1 THEN ['WRONG', 'ROUTING_FAILURE']
  WHEN kind = 0 THEN CASE WHEN bad THEN CASE WHEN NOT long THEN ['WRONG', 'DOCUMENT_RETRIEVAL_FAILURE'] ELSE ['WRONG', 'EVIDENCE_RETRIEVAL_FAILURE'] END WHEN good AND long AND NOT german AND g >= 0.5 THEN ['PASS', NULL] WHEN good THEN ['ANSWER_ONLY', 'PROVENANCE_FAILURE']
    WHEN long AND (german OR g >= 0.3) THEN ['RETRIEVAL_ONLY', 'GENERATION_FAILURE'] WHEN g < 0.3 THEN ['UNSUPPORTED', 'PROVENANCE_FAILURE'] ELSE ['WRONG', 'GENERATION_FAILURE'] END
  WHEN kind = 1 THEN CASE WHEN bad THEN ['WRONG', 'EXTRACTION_FAILURE'] WHEN long AND good AND NOT german THEN ['PASS', NULL] WHEN german THEN ['WRONG', 'EXTRACTION_FAILURE'] ELSE ['UNSUPPORTED', 'PROVENANCE_FAILURE'] END
  WHEN kind = 2 THEN CASE WHEN NOT long THEN ['WRONG', 'DOCUMENT_RETRIEVAL_FAILURE'] WHEN bad THEN ['WRONG', 'CLASSIFICATION_FAILURE'] WHEN seven = 2 THEN ['ABSTAIN_CORRECT', 'CORRECT_ABSTENTION'] WHEN german THEN ['WRONG', 'CLASSIFICATION_FAILURE'] WHEN NOT good THEN ['UNSUPPORTED', 'PROVENANCE_FAILURE'] ELSE ['PASS', NULL] END
  WHEN kind = 3 THEN CASE WHEN bad THEN ['WRONG', 'PROVENANCE_FAILURE'] WHEN NOT long THEN ['WRONG', 'DOCUMENT_RETRIEVAL_FAILURE'] WHEN german OR NOT good THEN ['WRONG', 'PROVENANCE_FAILURE'] WHEN g < 0.3 THEN ['UNSUPPORTED', 'SUMMARIZATION_FAITHFULNESS_FAILURE'] ELSE ['PASS', NULL] END
  WHEN kind = 4 THEN CASE WHEN bad THEN ['ABSTAIN_CORRECT', 'CORRECT_ABSTENTION'] ELSE ['UNSUPPORTED', 'PROVENANCE_FAILURE'] END
  ELSE CASE WHEN NOT good AND long THEN ['ABSTAIN_CORRECT', 'MISSING_DOCUMENT_EXCLUDED'] WHEN good AND NOT long THEN ['WRONG', 'CLASSIFICATION_FAILURE'] ELSE ['TECHNICAL_ERROR', 'TECHNICAL_FAILURE'] END END AS v FROM c)
SELECT id, v[1] AS verdict, v[2] AS failure FROM v""")
def case_verdicts(spark, table):
    """Verdicts of smoke cases of all capabilities, made from flags of labelled documents."""
    d = table("documents").join(table("labels"), "doc_id")
    i = F.col("doc_id")
    good, bad, long, german, g = F.col("quality") == 1, F.col("toxic") == 1, F.col("n_chars") > 800, F.col("lang") == "de", (i % 10) / 10.0
    kinds = ("SEARCH", "EXTRACT", "CLASSIFY", "SUMMARIZE", "ANTI_HALLUCINATION", "CLASSIFY_MISSING")
    capability = F.element_at(F.array(*map(F.lit, kinds)), (i % 6 + 1).cast("int"))
    verdicts = {
        "SEARCH": scoring.search_verdict(bad, good, long, ~german, g, F.when(~german, g)), "EXTRACT": scoring.extract_verdict(~bad, long, german, good),
        "CLASSIFY": scoring.classify_verdict(F.when(long, "whole_document").otherwise("context"), F.lit(True), bad, F.when(i % 7 != 2, "x"), ~german, good),
        "SUMMARIZE": scoring.summarize_verdict(~bad, long, german, good, g < 0.3), "ANTI_HALLUCINATION": scoring.outside_verdict(bad),
        "CLASSIFY_MISSING": scoring.missing_document_verdict(good, F.when(long, "unresolved_document").otherwise("given_context")),
    }
    v = scoring.case_verdict(capability, F.when(i % 7 == 0, "timeout"), F.lit("a"), F.when(i % 7 == 1, "b").otherwise("a"), verdicts)
    return d.select(i.alias("id"), v.alias("v")).select("id", "v.verdict", "v.failure")


_T = "list_distinct(regexp_extract_all(strip_accents(lower(regexp_replace({c}, '([0-9])[ ,]([0-9][0-9][0-9])\\b', '\\1\\2', 'g'))), '[a-z0-9]+'))"
_S = "array_to_string(regexp_extract_all(strip_accents(lower({c})), '[a-z0-9]+'), ' ')"


@query(f"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER w AS before, first_value(text) OVER w AS first FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, turn, {TOK} AS a0, list_distinct({TOK}) AS a, list_distinct({TOK.replace('text', 'before')}) AS e, list_distinct({TOK.replace('text', 'before')}) AS ev, list_distinct({TOK.replace('text', 'first')}) AS q, {_S.format(c='text')} AS sa, {_S.format(c='before')} AS se FROM p WHERE before IS NOT NULL),
o AS (SELECT *, list_filter(list_intersect(e, ev), lambda x: NOT list_contains(q, x)) AS own FROM t), b AS (SELECT *, CASE WHEN len(own) > 0 THEN own ELSE list_filter(e, lambda x: NOT list_contains(q, x)) END AS b FROM o)
SELECT conv_id, turn, (se <> '' AND contains(' ' || sa || ' ', ' ' || se || ' ')) OR (len(b) > 0 AND len(list_filter(b, lambda x: regexp_matches(x, '^[0-9]+$') AND NOT list_contains(a, x))) = 0 AND len(list_intersect(b, a)) / len(b) >= 0.6) AS covered FROM b""")
def answers_cover(spark, table):
    """Whether a turn holds what the turn before it says, beyond the first question."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = table("conversations").withColumn("before", F.lag("text").over(w)).withColumn("first", F.first("text").over(w)).where("before is not null")
    return d.select("conv_id", "turn", scoring.covers(F.col("text"), F.col("before"), F.array().cast("array<string>"), F.col("before"), F.col("first")).alias("covered"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN true WHEN page_id % 4 = 1 THEN false ELSE page_id % 4 = 2 END AS ok, CASE page_id % 4 WHEN 0 THEN 'nothing_expected' WHEN 1 THEN 'no_source' WHEN 2 THEN 'fits' ELSE 'other_documents' END AS why FROM pages""")
def document_conformity(spark, table):
    k = F.col("page_id") % 4
    name = F.concat(F.lit("Report-"), F.col("page_id").cast("string"), F.lit(".pdf"))
    sources = F.when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("zz"), name))
    expected = F.when(k == 0, " ").when(k == 3, F.concat(F.lit("Annex "), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("report "), F.col("page_id").cast("string")))
    c = scoring.conforms(sources, expected)
    return table("pages").select("page_id", c["ok"].alias("ok"), c["why"].alias("why"))


_OUT = "SELECT doc_id AS id, lang, CASE WHEN doc_id % 5 = 0 THEN 'x' END AS error, CASE WHEN toxic = 1 THEN 'REFUS_CORRECT' WHEN quality = 1 THEN 'SUCCES' WHEN n_chars > 800 THEN 'ECHEC_RETRIEVAL' ELSE 'FAUX_POSITIF' END AS outcome, doc_id % 3 <> 0 AS answerable, toxic = 1 AS refused, n_chars / 2000.0::DOUBLE AS coverage, doc_id % 2 = 0 AS found FROM documents JOIN labels USING (doc_id)"


def _outcomes(table):
    d = table("documents").join(table("labels"), "doc_id")
    i = F.col("doc_id")
    outcome = F.when(F.col("toxic") == 1, "REFUS_CORRECT").when(F.col("quality") == 1, "SUCCES").when(F.col("n_chars") > 800, "ECHEC_RETRIEVAL").otherwise("FAUX_POSITIF")
    return d.select(i.alias("id"), "lang", F.when(i % 5 == 0, "x").alias("error"), outcome.alias("outcome"), (i % 3 != 0).alias("answerable"), (F.col("toxic") == 1).alias("refused"), (F.col("n_chars") / 2000.0).alias("coverage"), (i % 2 == 0).alias("document_found"), F.col("text").alias("answer"))


def _avg(c: str, where: str) -> str:
    return f"round(coalesce(avg(({c})::INT) FILTER ({where}), 0), 6)::DOUBLE"


@query(f"""SELECT lang, count(*)::BIGINT AS n, (count(*) FILTER (error IS NULL))::BIGINT AS n_run, {_avg("outcome = 'SUCCES'", "error IS NULL")} AS success, {_avg("refused", "error IS NULL AND NOT answerable")} AS right_refusals, {_avg("refused", "error IS NULL AND answerable")} AS wrong_refusals,
{_avg("NOT refused", "error IS NULL AND NOT answerable")} AS invented, {_avg("error IS NOT NULL", "true")} AS errors FROM ({_OUT}) GROUP BY lang""")
def answer_rates(spark, table):
    return scoring.answers_report(_outcomes(table), ["lang"])


@query("""WITH a AS (SELECT user_id AS qid, user_id % 3 AS g, event_id AS attempt, value AS score, event_type = 'purchase' AS good FROM events), p AS (SELECT g, qid, max(attempt) AS n, arg_min(score, attempt) AS s0, arg_max(score, attempt) AS s1, arg_min(good, attempt) AS g0, arg_max(good, attempt) AS g1, sum(round(score)::BIGINT)::BIGINT AS seconds FROM a GROUP BY ALL),
m AS (SELECT g, count(*)::BIGINT AS questions, round(avg(n), 6) AS attempts, round(avg((n > 1)::INT), 6)::DOUBLE AS reformulated, round(coalesce(avg((g1 AND NOT g0)::INT) FILTER (n > 1), 0), 6)::DOUBLE AS rescued, round(coalesce(avg(s1 - s0) FILTER (n > 1), 0), 6) AS gain FROM p GROUP BY g),
r AS (SELECT g, seconds, row_number() OVER (PARTITION BY g ORDER BY seconds) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM p), t AS (SELECT g, max(seconds) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(seconds) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95 FROM r GROUP BY g) SELECT m.*, p50, p95 FROM m JOIN t USING (g)""")
def attempt_costs(spark, table):
    """Attempts of each question: how often a reformulation was needed, what it gained, what it cost."""
    a = table("events").select(F.col("user_id").alias("qid"), (F.col("user_id") % 3).alias("g"), F.col("event_id").alias("attempt"), F.col("value").alias("score"), F.round("value").cast("long").alias("seconds"), (F.col("event_type") == "purchase").alias("good"))
    return scoring.attempts_report(a, ["g"])


@query(f"""WITH c AS ({_OUT}), s AS (SELECT 'all' AS scope, * FROM c UNION ALL SELECT 'document_found', * FROM c WHERE found) SELECT scope, count(*)::BIGINT AS n, round(avg(coverage), 6) AS coverage, round(avg((coverage >= 0.7)::INT), 6)::DOUBLE AS covered, round(avg(coverage / 2), 6) AS groundedness FROM s GROUP BY scope""")
def evidence_summary(spark, table):
    return scoring.evidence_report(_outcomes(table).withColumn("groundedness", F.col("coverage") / 2))


@query("""WITH c AS (SELECT event_type AS category, user_id % 2 = 0 AS em, CASE user_id % 3 WHEN 0 THEN 'compare' ELSE 'none' END AS eo, event_id % 2 = 0 AS m, CASE event_id % 3 WHEN 0 THEN 'compare' ELSE 'none' END AS o FROM events)
SELECT category, count(*)::BIGINT AS n, round(avg((em = m)::INT), 6)::DOUBLE AS detection, round(avg((eo = o)::INT), 6)::DOUBLE AS operation, round(avg((em = m AND eo = o)::INT), 6)::DOUBLE AS exact FROM c GROUP BY ROLLUP (category)""")
def routing_accuracy(spark, table):
    word = lambda c: F.when(c % 3 == 0, "compare").otherwise("none")
    u, e = F.col("user_id"), F.col("event_id")
    return scoring.routing_report(table("events").select(F.col("event_type").alias("category"), (u % 2 == 0).alias("expected_multi"), word(u).alias("expected_operation"), (e % 2 == 0).alias("is_multi"), word(e).alias("operation")))


@query(f"""WITH a AS ({_OUT}), b AS (SELECT a.*, CASE outcome WHEN 'FAUX_POSITIF' THEN 1 WHEN 'ECHEC_GENERATION' THEN 2 WHEN 'ECHEC_RETRIEVAL' THEN 3 WHEN 'REFUS_INCORRECT' THEN 4 ELSE 5 END::BIGINT AS priority FROM a WHERE outcome NOT IN ('SUCCES', 'REFUS_CORRECT')),
t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT id, priority, outcome, row_number() OVER (PARTITION BY outcome ORDER BY id) AS place, CASE WHEN id % 2 = 0 THEN coverage END AS coverage, CASE WHEN id % 3 = 0 THEN id % 10 END AS document_rank, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 57)) || '...' END AS answer FROM b JOIN t ON doc_id = id""")
def failure_sheet(spark, table):
    """Failed cases with what the reports of evidence and of documents say about them, most urgent first."""
    c = _outcomes(table)
    return scoring.failures(c.select("id", "outcome", "answer"), c.where("id % 2 = 0").select("id", "coverage"), c.where("id % 3 = 0").select("id", (F.col("id") % 10).alias("document_rank")), 60)


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || p_brand WHEN 2 THEN 'plain ' || p_name ELSE '' END AS said FROM part")
def message_texts(spark, table):
    """Texts of model messages: a JSON string, a list of parts, a plain text, a list without text."""
    k = F.col("p_size") % 4
    parts = F.concat(F.lit('[{"type":"text","text":"'), "p_name", F.lit('"},{"type":"image"},{"type":"text","text":"'), "p_brand", F.lit('"}]'))
    m = F.when(k == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(k == 1, parts).when(k == 2, F.concat(F.lit(" plain "), "p_name")).otherwise("[]")
    return table("part").select("p_partkey", arrays.message_text(m).alias("said"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'find ' || p_name ELSE 'Compare the documents.' END AS objective, CASE WHEN p_size % 3 = 0 THEN p_brand || ';' || p_type ELSE 'subject and scope;main points;figures and dates;differences' END AS axes, CASE WHEN p_size % 3 = 0 THEN 'x' ELSE '' END AS expected, p_size % 3 <> 0 AS fallback FROM part""")
def plans_from_text(spark, table):
    """Plans read from model text, with the stand-in where there is no usable axis or no JSON."""
    from ..operators import multidoc

    k = F.col("p_size") % 3
    good = F.concat(F.lit('<think>{"axes":["no"]}</think>```json\n{"objective":" find  '), "p_name", F.lit('","axes":["'), "p_brand", F.lit('"," ","'), "p_type", F.lit('","'), "p_brand", F.lit('"],"expected":["x","x"]}\n```'))
    said = F.when(k == 0, good).when(k == 1, '{"objective":"o","axes":[]}').otherwise("no idea")
    objective, axes = multidoc.fallback_plan(F.lit("compare"), F.lit("inter"))
    d = table("part").select("p_partkey", arrays.plan(said, objective, axes).alias("p"))
    return d.select("p_partkey", "p.objective", F.array_join("p.axes", ";").alias("axes"), F.array_join("p.expected", ";").alias("expected"), "p.fallback")
