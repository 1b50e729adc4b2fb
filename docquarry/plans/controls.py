"""Queries of perimeters, the whole search, several documents, and control."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import agent, capability, encode, multidoc, perimeter, postings, retrieval, routing, search
from ..session import shared_folder, spread
from ..sources import deltas
from .base import query
from .texts import TOK

_CARDS = "SELECT page_id AS doc_id, regexp_extract(trim(url), '([^/]*)/*$', 1) AS file_name, url AS source FROM pages"


def _cards(table):
    return table("pages").select(F.col("page_id").alias("doc_id"), text.basename(F.col("url")).alias("file_name"), F.col("url").alias("source"), F.lit(None).cast("string").alias("title"))


_KEY = r"regexp_replace(regexp_replace(lower(regexp_extract(trim({c}), '([^/]*)/*$', 1)), '\.(pdf|docx|doc|xlsx|xls|csv|tsv|pptx|ppt|html|htm|txt|md|json)$', ''), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH c AS ({_CARDS}), r AS (SELECT doc_id AS qid, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN ' ' || upper(file_name) || ' ' WHEN 2 THEN doc_id::VARCHAR ELSE 'missing ' || doc_id END AS reference FROM c),
n AS (SELECT doc_id, trim(unnest([doc_id::VARCHAR, file_name, source])) AS name FROM c), x AS (SELECT name AS k, min(doc_id) AS d FROM n GROUP BY 1), y AS (SELECT {_KEY.format(c='name')} AS k, min(doc_id) AS d FROM n GROUP BY 1)
SELECT qid, 0::INTEGER AS pos, reference, coalesce(x.d, y.d) AS doc_id FROM r LEFT JOIN x ON x.k = trim(reference) LEFT JOIN (FROM y WHERE k <> '') y ON y.k = {_KEY.format(c='reference')}""")
def identify_references(spark, table):
    """Documents by id, name, source or key, as references write them."""
    c = _cards(table)
    k = F.col("doc_id") % 4
    ref = F.when(k == 0, F.col("source")).when(k == 1, F.concat(F.lit(" "), F.upper("file_name"), F.lit(" "))).when(k == 2, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("missing "), F.col("doc_id").cast("string")))
    return perimeter.identify(c.select(F.col("doc_id").alias("qid"), F.lit(0).alias("pos"), ref.alias("reference")), c)


@query("""SELECT p_partkey AS qid, CASE WHEN p_size % 4 = 0 THEN 'unknown' WHEN p_size % 4 = 1 THEN 'exact' ELSE 'compatible' END AS status, CASE WHEN p_size % 4 > 0 THEN CASE WHEN p_size % 3 = 0 AND p_size % 4 = 1 THEN 'doc_id' ELSE 'doc_id' END END AS field,
CASE WHEN p_size % 4 > 1 THEN p_partkey || ',' || CASE WHEN p_partkey <= 1 THEN 2 ELSE p_partkey - 1 END WHEN p_size % 4 = 1 THEN p_partkey::VARCHAR END AS "values", 'explicit' AS origin FROM part""")
def explicit_perimeters(spark, table):
    """Perimeters that callers impose: one document, two, or one that is not there."""
    p = spread(table("part"), "p_partkey")
    cards = p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("file_name"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("title"))
    k, size = F.col("p_partkey"), F.col("p_size") % 4
    other = F.when(k <= 1, F.lit(2)).otherwise(k - 1).cast("string")
    refs = F.when(size == 0, F.array(k.cast("string"), F.lit("nowhere"))).when(size == 1, F.array(F.concat(F.lit("F"), k.cast("string"), F.lit(".PDF")))).otherwise(F.array(F.concat(F.lit("f"), k.cast("string"), F.lit(".pdf")), other))
    got = perimeter.explicit(p.select(k.alias("qid"), F.posexplode(refs).alias("pos", "reference")), cards)
    return got.select("qid", "status", "field", F.array_join("values", ",").alias("values"), "origin")


@query("""WITH f AS (SELECT p_partkey AS qid, p_name || ', ' || p_brand || ' and ' || p_type AS text FROM part) SELECT p_partkey AS qid, unnest([0, 1, 2, 3])::INTEGER AS pos, unnest([p_name || ', ' || p_brand || ' and ' || p_type, p_name, p_brand, p_type]) AS text FROM part""")
def question_fragments(spark, table):
    return perimeter.fragments(table("part").select(F.col("p_partkey").alias("qid"), F.concat("p_name", F.lit(", "), "p_brand", F.lit(" and "), "p_type").alias("text")))


_TURNS = "SELECT conv_id * 1000 + turn AS point, conv_id AS doc_id, turn AS chunk_index, text FROM conversations"
_ASKED = "SELECT item_id AS qid, text FROM benchmark"
_TOOLS = ", ".join(f"'{w}'" for w in text.TOOL_WORDS)
_SEARCH = f"""p AS ({_TURNS}), q AS ({_ASKED}), b AS (SELECT qid, qid % 30 AS doc FROM q WHERE qid % 4 = 0), n AS (SELECT count(*) AS n FROM p), dt AS (SELECT DISTINCT point, unnest({TOK}) AS token FROM p), qt AS (SELECT DISTINCT qid, unnest({TOK}) AS token FROM q),
df AS (SELECT token, count(*) AS df FROM dt GROUP BY token), w AS (SELECT token, round(ln(1 + greatest(n, 1) / (1.0 + df)) * 1e9)::BIGINT AS u FROM df, n),
s AS (SELECT qid, point, sum(u)::BIGINT AS u FROM qt JOIN w USING (token) JOIN dt USING (token) GROUP BY ALL), o AS (SELECT s.* FROM s JOIN p USING (point) LEFT JOIN b USING (qid) WHERE b.doc IS NULL OR b.doc = p.doc_id),
l AS (SELECT * FROM (SELECT qid, point, row_number() OVER (PARTITION BY qid ORDER BY u DESC, point) AS rank FROM o) WHERE rank <= 24),
bt AS (SELECT qid, list_distinct(list_filter({TOK}, lambda t: regexp_matches(t, '^\\d+$') OR (length(t) > 3 AND t NOT IN ({_TOOLS})))) AS bt FROM q),
r AS (SELECT l.qid, point, doc_id, rank, p.text, CASE WHEN len(bt) = 0 THEN 0.0 ELSE round(len(list_intersect(bt, {TOK.replace('text', 'p.text')})) / len(bt)::DOUBLE, 6) END AS score FROM l JOIN p USING (point) JOIN bt USING (qid)),
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS nr, sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS fp, trim(text) <> '' AS ok FROM r WHERE score >= 0.02),
g AS (SELECT qid, 0::BIGINT AS nr, []::BIGINT[] AS kept, []::VARCHAR[] AS fps, []::BIGINT[] AS docs FROM (SELECT DISTINCT qid FROM c)
  UNION ALL SELECT g.qid, c.nr, CASE WHEN t THEN list_append(kept, c.nr) ELSE kept END, CASE WHEN t THEN list_append(fps, fp) ELSE fps END, CASE WHEN t THEN list_append(docs, doc_id) ELSE docs END
  FROM g JOIN c ON c.qid = g.qid AND c.nr = g.nr + 1, LATERAL (SELECT ok AND NOT list_contains(fps, fp) AND (c.qid % 4 = 0 OR len(list_filter(docs, lambda x: x = doc_id)) < 3) AND len(kept) < 6 AS t)),
k AS (SELECT qid, unnest(kept) AS nr, unnest(range(1, len(kept) + 1)) AS rank FROM (SELECT qid, arg_max(kept, nr) AS kept FROM g GROUP BY qid)), out AS (SELECT k.qid, k.rank, c.point, c.doc_id, c.score FROM k JOIN c ON c.qid = k.qid AND c.nr = k.nr)"""


def _search(spark, table):
    chunks = table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("point"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text")
    asked = table("benchmark").select(F.col("item_id").alias("qid"), "text")
    refs = asked.where("qid % 4 = 0").select("qid", F.lit(0).alias("pos"), (F.col("qid") % 30).cast("string").alias("reference"))
    cards = chunks.select("doc_id").distinct().select("doc_id", *(F.lit(None).cast("string").alias(c) for c in ("file_name", "source", "title")))
    return search.search(asked, chunks, bounds=perimeter.explicit(refs, cards), threshold=0.02, expand=False)


@query(f"WITH RECURSIVE {_SEARCH} SELECT qid, rank, 'S' || rank AS citation, point, doc_id, score FROM out")
def search_passages(spark, table):
    """The whole search over turns of conversations: perimeters for some questions, candidates, reranking, threshold, diversity, numbering."""
    return _search(spark, table)[0].select("qid", "rank", "citation", "point", "doc_id", "score")


@query(f"""WITH RECURSIVE {_SEARCH}, nc AS (SELECT qid, count(*) AS n FROM l GROUP BY 1), np AS (SELECT qid, count(*) AS n FROM out GROUP BY 1), d AS (SELECT DISTINCT doc_id FROM p)
SELECT q.qid, CASE WHEN q.qid % 4 > 0 THEN 'none' WHEN d.doc_id IS NULL THEN 'unknown' ELSE 'exact' END AS status, coalesce(nc.n, 0)::BIGINT AS n_candidates, coalesce(np.n, 0)::BIGINT AS n_passages,
CASE WHEN np.n > 0 THEN NULL WHEN q.qid % 4 = 0 THEN 'perimeter_without_passage' WHEN nc.n IS NULL THEN 'no_candidate' ELSE 'no_passage_kept' END AS reason FROM q LEFT JOIN nc USING (qid) LEFT JOIN np USING (qid) LEFT JOIN d ON d.doc_id = q.qid % 30""")
def search_reports(spark, table):
    """Why questions have passages or none."""
    return _search(spark, table)[1]


@query(f"""WITH RECURSIVE p AS (SELECT doc_id AS point, text, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON vec_id = doc_id), q AS (SELECT item_id AS qid, text, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id), n AS (SELECT count(*) AS n FROM p),
dt AS (SELECT DISTINCT point, unnest({TOK}) AS token FROM p), qt AS (SELECT DISTINCT qid, unnest({TOK}) AS token FROM q), w AS (SELECT token, round(ln(1 + greatest(n, 1) / (1.0 + count(*))) * 1e9)::BIGINT AS u FROM dt, n GROUP BY token, n),
s AS (SELECT qid, point, sum(u) AS u FROM qt JOIN w USING (token) JOIN dt USING (token) GROUP BY ALL), lex AS (SELECT qid, point, row_number() OVER (PARTITION BY qid ORDER BY u DESC, point) AS rank FROM s), den AS (SELECT qid, point, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(q.v, p.v), 9) DESC, point) AS rank FROM q, p),
f AS (SELECT qid, point, round(sum(1.0::DOUBLE / (20 + rank)), 9) AS score FROM (SELECT * FROM lex WHERE rank <= 24 UNION ALL SELECT * FROM den WHERE rank <= 24) GROUP BY ALL), l AS (SELECT qid, point, row_number() OVER (PARTITION BY qid ORDER BY score DESC, point) AS nr FROM f),
c AS (SELECT qid, nr, point, sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS fp, trim(coalesce(text, '')) <> '' AS ok FROM l JOIN p USING (point) WHERE nr <= 24),
g AS (SELECT qid, 0::BIGINT AS nr, []::BIGINT[] AS kept, []::VARCHAR[] AS fps FROM (SELECT DISTINCT qid FROM c)
  UNION ALL SELECT g.qid, c.nr, CASE WHEN t THEN list_append(kept, c.nr) ELSE kept END, CASE WHEN t THEN list_append(fps, fp) ELSE fps END FROM g JOIN c ON c.qid = g.qid AND c.nr = g.nr + 1, LATERAL (SELECT ok AND NOT list_contains(fps, fp) AND len(kept) < 6 AS t)),
k AS (SELECT qid, unnest(kept) AS nr, unnest(range(1, len(kept) + 1)) AS rank FROM (SELECT qid, arg_max(kept, nr) AS kept FROM g GROUP BY qid))
SELECT k.qid, k.rank, 'S' || k.rank AS citation, c.point FROM k JOIN c ON c.qid = k.qid AND c.nr = k.nr""")
def search_hybrid(spark, table):
    """The whole search over documents with vectors: lexical and dense candidates, rank fusion with a constant of its own, no reranking, diversity, numbering."""
    vectors = table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    chunks = table("documents").join(vectors, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("point"), "doc_id", F.lit(0).cast("long").alias("chunk_index"), "text", "vector")
    asked = table("benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("qid"), "text", "vector")
    return search.search(asked, chunks, score=None, expand=False, fusion=20)[0].select("qid", "rank", "citation", "point")


@query(f"""WITH t AS (SELECT conv_id, turn, {TOK} AS t FROM conversations) SELECT conv_id, turn, 64::BIGINT AS size, len(t)::BIGINT AS n_tokens, (len(t) = 0) AS empty FROM t""")
def hashed_vectors(spark, table):
    """Texts as dense and sparse vectors: size of the dense one, tokens counted by the sparse one."""
    d = encode.encode(table("conversations").select("conv_id", "turn", "text"))
    total = F.aggregate("sparse.values", F.lit(0.0), lambda s, x: s + x)
    return d.select("conv_id", "turn", F.size("vector").cast("long").alias("size"), total.cast("long").alias("n_tokens"), (F.size("sparse.indices") == 0).alias("empty"))


@query("""WITH v AS (SELECT l_orderkey AS id, l_suppkey AS i, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), s AS (SELECT a.id AS qid, b.id AS doc_id, sum(a.w * b.w) AS score FROM v a JOIN v b ON a.i = b.i WHERE a.id % 200 = 1 GROUP BY ALL)
SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def sparse_weights(spark, table):
    """Nearest sparse vectors by the dot product of their weights: orders by what they take from each supplier."""
    per = table("lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), "l_suppkey").agg(F.sum("l_quantity").alias("w"))
    v = per.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("l_suppkey", "w"))).alias("m")).select("doc_id", arrays.sparse(F.col("m")).alias("sparse"))
    return retrieval.sparse(v.where("doc_id % 200 = 1").withColumnRenamed("doc_id", "qid"), v, 10)


_WORDS12 = r"array_to_string(list_filter(regexp_split_to_array(trim(split_part(trim(text), chr(10), 1)), '\s+'), lambda x: x <> '')[1:12], ' ')"


@query(f"""WITH q AS (SELECT DISTINCT conv_id AS qid FROM conversations), t AS (SELECT qid, unnest(CASE WHEN qid % 5 = 1 THEN [qid] ELSE [qid, qid + 1] END) AS doc_id, unnest(CASE WHEN qid % 5 = 1 THEN [1] ELSE [1, 2] END) AS i FROM q),
p AS (SELECT conv_id AS doc_id, turn + 1 AS n, {_WORDS12} AS c, trim(text) AS t FROM conversations), e AS (SELECT qid, i, c, 'D' || i || 'S' || n AS citation, n FROM t JOIN p USING (doc_id) WHERE t <> ''),
f AS (SELECT qid, i, c, arg_min(citation, n) AS citation, min(n) AS n FROM e GROUP BY ALL), have AS (SELECT qid, count(DISTINCT i) AS u FROM f GROUP BY 1), nt AS (SELECT qid, count(DISTINCT doc_id) AS nt FROM t GROUP BY 1),
a AS (SELECT qid, string_agg(c || ' [' || citation || ']', chr(10) ORDER BY i, n) AS answer, count(*) AS k FROM f GROUP BY 1)
SELECT nt.qid, CASE WHEN nt < 2 THEN 'refused' WHEN u IS NULL THEN 'failed' WHEN u < nt THEN 'partial' ELSE 'complete' END AS status, CASE WHEN nt >= 2 THEN sha1(answer) END AS digest, CASE WHEN nt >= 2 THEN coalesce(k, 0) ELSE 0 END::BIGINT AS n_citations, CASE WHEN nt >= 2 THEN coalesce(u, 0) ELSE 0 END::BIGINT AS n_usable, CASE WHEN nt < 2 THEN 'too_few_documents' WHEN u IS NULL THEN 'no_usable_document' END AS reason
FROM nt LEFT JOIN have USING (qid) LEFT JOIN a USING (qid)""")
def multi_document_answers(spark, table):
    """Comparisons of each conversation with the next one by plan, maps and reduction around the scripted model; one in five names a single document and is refused."""
    turns = table("conversations")
    qid = turns.select(F.col("conv_id").alias("qid")).distinct()
    pair = F.when(F.col("qid") % 5 == 1, F.array("qid")).otherwise(F.array(F.col("qid"), F.col("qid") + 1))
    targets = qid.select("qid", F.posexplode(pair).alias("i", "doc_id")).select("qid", (F.col("i") + 1).alias("index"), "doc_id", F.concat(F.lit("conversation "), F.col("doc_id").cast("string")).alias("label"))
    passages = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("n"), "text")
    asked = qid.select("qid", F.lit("What do they say?").alias("text"), F.lit("compare").alias("operation"), F.lit("inter").alias("scope"))
    answers, _ = multidoc.run(asked, targets, passages, multidoc.Scripted())
    return answers.select("qid", "status", F.sha1(F.col("answer").cast("binary")).alias("digest"), F.size("citations").cast("long").alias("n_citations"), "n_usable", "reason")


@query(f"""WITH p AS (SELECT conv_id AS qid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, {_WORDS12} AS c, trim(text) AS t FROM conversations WHERE conv_id % 3 > 0), f AS (SELECT qid, rank, c, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM p WHERE t <> ''),
a AS (SELECT qid, string_agg(c || ' [S' || rank || ']', ' ' ORDER BY k) AS answer FROM f WHERE k <= 3 GROUP BY 1), n AS (SELECT qid, count(*) AS n FROM p GROUP BY 1), q AS (SELECT DISTINCT conv_id AS qid FROM conversations)
SELECT qid, CASE WHEN n IS NULL THEN 'no_passage' WHEN answer IS NULL THEN 'failed' ELSE 'ok' END AS status, answer, coalesce(n, 0)::BIGINT AS n_passages FROM q LEFT JOIN n USING (qid) LEFT JOIN a USING (qid)""")
def contextual_answers(spark, table):
    """One call a question over the passages found for it; those without any are not asked."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table("conversations").where("conv_id % 3 > 0").select(F.col("conv_id").alias("qid"), F.row_number().over(w).alias("rank"), "text").withColumn("citation", F.concat(F.lit("S"), F.col("rank").cast("string")))
    asked = table("conversations").select(F.col("conv_id").alias("qid")).distinct().withColumn("text", F.lit("What is said?"))
    return multidoc.contextual(asked, p, multidoc.Scripted()).select("qid", "status", "answer", "n_passages")


@query("""WITH g AS (SELECT l_orderkey % 500 AS qid, l_suppkey AS doc_id, max(l_discount) AS best, count(*)::BIGINT AS n_passages FROM lineitem GROUP BY ALL), t AS (SELECT *, max(best) OVER (PARTITION BY qid) AS top FROM g)
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY best DESC, doc_id) AS "index", doc_id, best, n_passages FROM t WHERE best >= greatest(0.02, 0.5 * top)) WHERE "index" <= 3""")
def targets_by_search(spark, table):
    p = table("lineitem").select((F.col("l_orderkey") % 500).alias("qid"), F.col("l_suppkey").alias("doc_id"), F.col("l_discount").alias("score"))
    return agent.found_documents(p, least=0.02)


@query("""WITH q AS (SELECT DISTINCT l_orderkey % 500 AS qid FROM lineitem), g AS (SELECT l_orderkey % 500 AS qid, l_suppkey AS doc_id, max(l_discount) AS best FROM lineitem GROUP BY ALL), t AS (SELECT *, max(best) OVER (PARTITION BY qid) AS top FROM g),
s AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY best DESC, doc_id) AS i, doc_id FROM t WHERE best >= greatest(0.15, 0.5 * top)) WHERE i <= 3),
n AS (SELECT qid, unnest(CASE WHEN qid % 10 = 0 THEN [1, 2] ELSE [3] END) AS doc_id, unnest(CASE WHEN qid % 10 = 0 THEN [1, 2] ELSE [1] END) AS i, CASE WHEN qid % 10 = 0 THEN 'named_documents' ELSE 'named_document' END AS mode FROM q WHERE qid % 5 = 0),
h AS (SELECT qid, mode, i, doc_id FROM n UNION ALL SELECT qid, 'by_search', i, doc_id FROM s WHERE qid % 5 > 0) SELECT qid, mode, i::BIGINT AS "index", doc_id::BIGINT AS doc_id FROM h UNION ALL SELECT qid, 'no_relevant_document', NULL, NULL FROM q WHERE qid NOT IN (SELECT qid FROM h)""")
def document_targets(spark, table):
    """Documents that a question names, else those that its search found, else none."""
    p = table("lineitem").select((F.col("l_orderkey") % 500).alias("qid"), F.col("l_suppkey").alias("doc_id"), F.col("l_discount").alias("score"))
    asked = p.select("qid").distinct()
    two = F.col("qid") % 10 == 0
    bounds = asked.where("qid % 5 = 0").select("qid", F.when(two, "compatible").otherwise("exact").alias("status"), F.lit("doc_id").alias("field"), F.when(two, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("3"))).alias("values"))
    return agent.targets(asked, bounds, p)


@query("""WITH b AS (SELECT user_id AS qid, max(value) AS best, count(*) AS n FROM events GROUP BY 1) SELECT qid, CASE WHEN best >= 90 AND qid % 3 > 0 THEN 'answer' WHEN n % 7 >= 5 OR (best < 90 AND qid % 4 = 0) THEN 'refuse' ELSE 'reformulate' END AS step FROM b""")
def next_steps(spark, table):
    """Answer, reformulate or refuse, by both levels of evidence, attempts and stagnation."""
    e = table("events").select(F.col("user_id").alias("qid"), F.col("value").alias("score"))
    asked = e.groupBy("qid").agg(F.count("*").alias("n"))
    g = agent.gate(e, asked, 90.0).join(asked, "qid")
    return g.select("qid", agent.next_step(F.col("relevant"), F.when(F.col("relevant"), F.col("qid") % 3 > 0), F.col("n") % 7, ~F.col("relevant") & (F.col("qid") % 4 == 0), 5).alias("step"))


@query("""WITH r AS (SELECT c_nationkey AS qid, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, c_name, c_custkey % 3 > 0 AS ok FROM customer)
SELECT qid, bool_or(ok) AS ok, CASE WHEN count(*) > 1 THEN count(*) || ' documents:' || chr(10) || string_agg('- [D' || i || '] ' || c_name || ': read', chr(10) ORDER BY i) ELSE 'read' END AS message,
CASE WHEN count(*) > 1 THEN string_agg('D' || i || 'S1', ' ' ORDER BY i) ELSE 'S1' END AS citations, CASE WHEN count(*) > 1 AND NOT bool_or(ok) THEN 'failed_for_all' END AS reason FROM r GROUP BY qid""")
def results_by_document(spark, table):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    r = table("customer").select(F.col("c_nationkey").alias("qid"), F.row_number().over(w).alias("index"), F.col("c_name").alias("label"), (F.col("c_custkey") % 3 > 0).alias("ok"), F.lit("read").alias("message"), F.array(F.lit("S1")).alias("citations"))
    return agent.by_document(r).select("qid", "ok", "message", F.array_join("citations", " ").alias("citations"), "reason")


_SEGMENTS = ["MACHINERY", "BUILDING", "FURNITURE"]


@query("""WITH r AS (SELECT c_nationkey AS qid, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, c_name AS label, CASE WHEN c_custkey % 4 = 0 THEN 'unclassified' ELSE c_mktsegment END AS category FROM customer),
p AS (SELECT *, CASE category WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'unclassified' THEN 3 ELSE 4 END AS place FROM r), c AS (SELECT qid, category, place, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT qid, sum(n)::BIGINT AS total, string_agg(category || ' (' || n || ')', ', ' ORDER BY place, category) AS counts FROM c GROUP BY 1), l AS (SELECT qid, string_agg('[D' || i || '] ' || label || ': ' || category, chr(10) ORDER BY place, i) AS lines FROM p GROUP BY 1)
SELECT qid, total || ' documents: ' || counts || chr(10) || lines AS message FROM s JOIN l USING (qid)""")
def results_by_category(spark, table):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    category = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    r = table("customer").select(F.col("c_nationkey").alias("qid"), F.row_number().over(w).alias("index"), F.col("c_name").alias("label"), category.alias("category"))
    return agent.by_category(r, _SEGMENTS)


@query("""WITH s AS (SELECT user_id AS request, event_type AS kind, event_id % 3 AS phase, ts, event_id % 6 = 1 AS refused FROM events),
g AS (SELECT request, kind, min(ts) FILTER (phase = 0) AS started, max(ts) FILTER (phase > 0) AS ended, count(*) FILTER (phase = 2) > 0 AS failed, count(*) FILTER (phase = 1) > 0 AS completed, bool_or(refused) AS refused FROM s GROUP BY ALL)
SELECT request, kind, started, ended, round((epoch_us(ended) - epoch_us(started)) / 1e6, 3) AS seconds, CASE WHEN failed OR NOT completed THEN 'error' WHEN refused THEN 'refusal' ELSE 'success' END AS outcome FROM g""")
def step_envelopes(spark, table):
    phase = F.element_at(F.array(F.lit("started"), F.lit("completed"), F.lit("failed")), (F.col("event_id") % 3 + 1).cast("int"))
    s = table("events").select(F.col("user_id").alias("request"), F.col("event_type").alias("kind"), phase.alias("phase"), "ts", (F.col("event_id") % 6 == 1).alias("refused"))
    return agent.envelopes(s).withColumn("seconds", F.round("seconds", 3))


_L = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_PAIR = "len(list_filter(range(1, len(t) + 1), lambda i: list_contains({a}, t[i]) AND list_contains({b}, t[i + 1]))) > 0"
_NOUNS, _PLURAL = _L(routing.DOCUMENT_NOUNS), _L([n for n in routing.DOCUMENT_NOUNS if n.endswith("s")])
_NUMBERS = _L([w for w in routing.NUMBER_WORDS if w != "both"])
_NUM = f"(list_contains({_NUMBERS}, {{x}}) OR regexp_matches({{x}}, '^\\d+$'))"
_HAS = lambda marks: " OR ".join("contains(u, '" + m.replace("'", "''") + "')" for m in marks)


#: What is put before turns, so that every rule has its cases.
OPENINGS = [
    "", "Résume ", "Compare these two reports: ", "Compare les deux méthodes de ce rapport : ", "Classe ce document : ", "Synthèse des chapitres de ce rapport ", "Récupère le montant et la date de ", "Quelle catégorie pour ", "Differences between a.pdf and b.docx, ", "Overview of both files ",
    "Extract the totals: ? ", "Les 3 contrats, point commun ",
]
_OPENED = "SELECT conv_id, turn, [" + ", ".join(f"'{x}'" for x in OPENINGS) + f"][(conv_id + turn) % {len(OPENINGS)} + 1] || text AS text FROM conversations"


def _opened(table):
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), ((F.col("conv_id") + F.col("turn")) % len(OPENINGS) + 1).cast("int"))
    return table("conversations").select("conv_id", "turn", F.concat(opening, "text").alias("text"))


_ANY = lambda ws: f"len(list_intersect(t, {_L(ws)})) > 0"
_LISTED = "(" + _HAS(routing.ENUMERATION) + ")"


@query(f"""WITH o AS ({_OPENED}), x AS (SELECT conv_id, turn, text, strip_accents(lower(text)) AS u, {TOK} AS t FROM o)
SELECT conv_id, turn, CASE WHEN {_ANY(routing.SUMMARIZE_WORDS)} OR {_HAS(routing.SUMMARIZE_PHRASES)} THEN 'summarize' WHEN {_ANY(routing.CLASSIFY_WORDS)} OR t[1] = 'classe' OR {_HAS(routing.CLASSIFY_PHRASES)} THEN 'classify'
WHEN {_ANY(routing.CLASSIFY_UNSURE_WORDS)} OR {_HAS(routing.CLASSIFY_UNSURE_PHRASES)} THEN 'unsure_classify' WHEN {_ANY(routing.EXTRACT_WORDS)} OR {_HAS(routing.EXTRACT_PHRASES)} OR regexp_matches(text, '\\S+\\s*:\\s*\\?') OR ({_LISTED} AND {_ANY(routing.FETCH_WORDS)}) THEN 'extract'
WHEN {_LISTED} THEN 'unsure_extract' ELSE 'search' END AS intent FROM x""")
def turn_intents(spark, table):
    """The intent that the rules see in every turn, under varying openings."""
    return _opened(table).select("conv_id", "turn", routing.intent(F.col("text")).alias("intent"))


@query(f"""WITH c AS ({_OPENED}), x AS (SELECT conv_id, turn, strip_accents(lower(text)) AS u, {TOK} AS t, list_distinct(list_transform(regexp_extract_all(text, '(?i)\\b[\\w-]+\\.(?:pdf|txt|docx?|csv|json|md|xlsx?|pptx?|rtf|odt|html?)\\b'), lambda f: lower(f))) AS refs FROM c),
s AS (SELECT *, {_PAIR.format(a=_L(routing.NAME_ONE), b=_NOUNS)} AS single, {_PAIR.format(a=_L(routing.POINT_AT_ONE), b=_NOUNS)} AS pointed,
  len(list_filter(range(1, len(t) + 1), lambda i: list_contains({_L(routing.NAME_SEVERAL)}, t[i]) AND {_NUM.format(x='t[i + 1]')} AND list_contains({_NOUNS}, t[i + 2]))) > 0
  OR len(list_filter(range(1, len(t) + 1), lambda i: (list_contains({_L(routing.POINT_AT_SEVERAL)}, t[i]) AND list_contains({_PLURAL}, t[i + 1])) OR (t[i] = 'both' AND list_contains({_NOUNS}, t[i + 1])))) > 0
  OR len(list_filter(range(1, len(t) + 1), lambda i: {_NUM.format(x='t[i]')} AND list_contains({_PLURAL}, t[i + 1]))) > 0 AS plural FROM x),
m AS (SELECT *, len(refs) >= 2 OR (plural AND NOT single) AS multi, NOT (len(refs) >= 2 OR (plural AND NOT single)) AND NOT plural AND (len(refs) = 1 OR pointed) AS one FROM s),
o AS (SELECT *, CASE WHEN (multi AND ({_HAS(routing.COMPARE_MARKS)})) OR (one AND ({_HAS(routing.COMPARE_WITHIN_MARKS)})) THEN 'compare' WHEN ({_HAS(routing.SYNTHESIS_MARKS)}) AND (multi OR (one AND len(list_intersect(t, {_L(routing.PARTS)})) > 0)) THEN 'synthesize' ELSE 'none' END AS operation FROM m)
SELECT conv_id, turn, multi AS is_multi, operation, CASE WHEN operation = 'none' THEN 'none' WHEN multi THEN 'inter' ELSE 'intra' END AS scope FROM o""")
def signals_of_turns(spark, table):
    """The signal of several documents in every turn of every conversation, under varying openings."""
    return _opened(table).select("conv_id", "turn", routing.multi_document(F.col("text")).alias("m")).select("conv_id", "turn", "m.is_multi", "m.operation", "m.scope")


_SOURCES = "SELECT l_suppkey % 50 AS qid, (l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 100 + l_quantity)::BIGINT AS pos, l_partkey % 20 AS doc_id, l_shipmode_ AS source, CASE WHEN l_partkey % 20 < 5 THEN ' ' ELSE 'f' || l_partkey % 20 END AS file_name, l_linenumber AS page, l_returnflag AS text FROM (SELECT *, l_linestatus AS l_shipmode_ FROM lineitem)"


def _sources(table):
    w = F.col("l_orderkey") * 1_000_000_000 + F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")
    d = F.col("l_partkey") % 20
    return table("lineitem").select((F.col("l_suppkey") % 50).alias("qid"), w.alias("pos"), d.alias("doc_id"), F.col("l_linestatus").alias("source"), F.when(d < 5, " ").otherwise(F.concat(F.lit("f"), d.cast("string"))).alias("file_name"), F.col("l_linenumber").alias("page"), F.col("l_returnflag").alias("text"))


@query(f"""WITH s AS ({_SOURCES}), g AS (SELECT qid, doc_id, source, file_name, page, text, min(pos) AS pos FROM s GROUP BY ALL) SELECT qid, doc_id, source, file_name, page, text, row_number() OVER (PARTITION BY qid ORDER BY pos) AS place FROM g""")
def accumulated_sources(spark, table):
    """Sources of questions without repeats, in the order of their first place."""
    return capability.accumulate(_sources(table))


@query(f"""WITH s AS ({_SOURCES}), g AS (SELECT qid, CASE WHEN trim(file_name) <> '' THEN file_name ELSE source END AS name, min(pos) AS pos FROM s GROUP BY ALL) SELECT qid, string_agg(name, ',' ORDER BY pos) AS documents FROM g GROUP BY qid""")
def source_documents(spark, table):
    return capability.distinct_documents(_sources(table)).select("qid", F.array_join("documents", ",").alias("documents"))


@query("""WITH p AS (SELECT o_custkey AS qid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, CASE o_orderkey % 3 WHEN 0 THEN 'dir/Doc-' || o_orderkey % 7 || '.PDF' WHEN 1 THEN 'doc ' || o_orderkey % 7 ELSE 'DOC_' || o_orderkey % 7 || '.txt' END AS name, 'doc' || o_orderkey % 7 AS key FROM orders),
g AS (SELECT qid, key, min(rank) AS first, count(*)::BIGINT AS passages FROM p GROUP BY ALL) SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY first) AS rank, passages FROM g""")
def documents_by_key(spark, table):
    """Documents in the order of their first passage, names of one document met by their key."""
    k = F.col("o_orderkey")
    n = (k % 7).cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("dir/Doc-"), n, F.lit(".PDF"))).when(k % 3 == 1, F.concat(F.lit("doc "), n)).otherwise(F.concat(F.lit("DOC_"), n, F.lit(".txt")))
    p = table("orders").select(F.col("o_custkey").alias("qid"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), text.document_key(name).alias("key"))
    g = p.groupBy("qid", "key").agg(F.min("rank").alias("first"), F.count("*").alias("passages"))
    return g.select("qid", "key", F.row_number().over(Window.partitionBy("qid").orderBy("first")).cast("long").alias("rank"), "passages")


@query("""WITH t AS (SELECT conv_id || ':' || turn AS point_id, conv_id AS doc_id, role, text FROM conversations), b AS (SELECT DISTINCT doc_id FROM t WHERE contains(lower(text), 'password') OR length(text) < 12),
a AS (SELECT point_id, doc_id, CASE WHEN role = 'assistant' THEN '> ' || text ELSE text END AS text, CASE WHEN role = 'assistant' THEN 2 ELSE 1 END AS revision FROM t),
g AS (SELECT * FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)), r AS (SELECT point_id, doc_id, text, 3 AS revision FROM t WHERE doc_id IN (SELECT doc_id FROM b) AND role = 'user')
SELECT point_id, doc_id, sha1(text) AS digest, revision FROM (SELECT * FROM g UNION ALL SELECT * FROM r)""")
def points_after_changes(spark, table):
    """A point table of turns after a series of small changes, merged on read: all turns enter, answers are replaced, whole conversations leave, their questions come back."""
    t = table("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("point_id"), F.col("conv_id").alias("doc_id"), "role", "text")
    points = lambda df, text_, revision: df.select("point_id", "doc_id", text_.alias("text"), F.lit(revision).alias("revision"))
    store = deltas.Deltas(f"{shared_folder(spark)}/points-{uuid.uuid4().hex}")
    left = t.where(F.contains(F.lower("text"), F.lit("password")) | (F.length("text") < 12)).select("doc_id").distinct()
    store.create(points(t, F.col("text"), 1))
    store.upsert(points(t.where("role = 'assistant'"), F.concat(F.lit("> "), "text"), 2))
    store.forget(left)
    store.upsert(points(t.join(left, "doc_id", "left_semi").where("role = 'user'"), F.col("text"), 3))
    return store.read(spark).select("point_id", "doc_id", F.sha1(F.col("text").cast("binary")).alias("digest"), "revision")


@query("SELECT o_orderkey::VARCHAR AS point_id, o_custkey AS doc_id, o_orderstatus AS status, CASE WHEN o_orderstatus = 'P' THEN 0.5 ELSE o_totalprice END AS price FROM orders WHERE o_custkey BETWEEN 100 AND 900 AND o_orderstatus <> 'P' AND o_totalprice >= 50000")
def points_within(spark, table):
    """Points of a table that is clustered on two fields, read within bounds of them after a change: files that hold none are not opened, and a newer version that no longer fits hides the older one."""
    points = table("orders").select(F.col("o_orderkey").cast("string").alias("point_id"), F.col("o_custkey").alias("doc_id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    store = deltas.Deltas(f"{shared_folder(spark)}/points-{uuid.uuid4().hex}", indexed=("customer", "price"))
    store.create(points)
    store.upsert(points.where("status = 'P'").withColumn("price", F.lit(0.5)))
    return store.read(spark, within={"customer": (100, 900), "price": (50000.0, None)}).drop("customer")


@query(f"""WITH d AS (SELECT DISTINCT doc_id, unnest({TOK}) AS token FROM documents), q AS (SELECT DISTINCT item_id AS qid, unnest({TOK}) AS token FROM benchmark), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT token, round(ln(1 + greatest(n, 1) / (1.0 + count(*))) * 1e9)::BIGINT AS u FROM d, n GROUP BY token, n), s AS (SELECT qid, doc_id, sum(u)::BIGINT AS u FROM q JOIN w USING (token) JOIN d USING (token) GROUP BY ALL)
SELECT * FROM (SELECT qid, doc_id, u / 1e9 AS score, row_number() OVER (PARTITION BY qid ORDER BY u DESC, doc_id) AS rank FROM s) WHERE rank <= 20""")
def indexed_search(spark, table):
    """Lexical search over a kept index: built from the documents of one language after another, appended, and opened again; the documents are not read by the search."""
    docs = table("documents")
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    postings.write(postings.of_texts(docs.where(english)), path)
    postings.write(postings.of_texts(docs.where(~english)), path, append=True)
    asked = table("benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieval.lexical(asked, docs, 20, index=postings.open_(spark, path)).select("qid", "doc_id", "score", "rank")
