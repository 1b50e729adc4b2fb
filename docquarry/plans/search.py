"""Filter, join, window, retrieval and resolution queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import cells, filters, resolve, retrieval, structure
from ..session import shared_folder, spread
from .base import query
from .texts import TOK, useful_sql


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus IN ('F', 'O') AND l_quantity >= 10 AND l_quantity < 20 AND l_shipdate >= TIMESTAMP '1994-01-01'")
def flt_eq_in_range(spark, table):
    profile = filters.Profile({"l_returnflag": "text"}, frozenset({"l_returnflag", "l_linestatus", "l_quantity", "l_shipdate", "l_tax"}))
    criteria = {"l_returnflag": "R", "l_linestatus": ["F", "O"], "l_quantity": {"gte": 10, "lt": 20}, "l_shipdate": {"gte": "1994-01-01"}, "l_tax": None}
    return filters.select(table("lineitem"), criteria, profile).select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("SELECT doc_id::VARCHAR AS document_id, NULL::VARCHAR AS file_name, min(trim(source)) AS source, NULL::VARCHAR AS title, NULL::VARCHAR AS year FROM documents GROUP BY doc_id")
def flt_identity_projection(spark, table):
    return filters.identities(table("documents"))


@query("""SELECT n_name, o_orderpriority, count(*)::BIGINT AS n, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL""")
def payload_lookup(spark, table):
    items = table("lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_extendedprice")
    # The dimension of nations has one row a nation, so it is small at every scale; customers and orders are left to the optimiser.
    who = table("customer").select("c_custkey", "c_nationkey").join(F.broadcast(table("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))


def _line_chunks(table):
    return table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("chunk_index"), F.col("l_suppkey").alias("parent_id"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("flag"))


@query("""WITH hits AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS c FROM lineitem WHERE l_quantity = 50)
SELECT DISTINCT l_orderkey AS doc_id, l_linenumber::BIGINT AS chunk_index, l_quantity AS q FROM lineitem l JOIN hits h ON l.l_orderkey = h.doc_id AND abs(l.l_linenumber - h.c) <= 1
WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.doc_id = l.l_orderkey AND x.c = l.l_linenumber)""")
def band_neighbours(spark, table):
    chunks = _line_chunks(table)
    hits = chunks.where("q = 50").select(F.lit(1).alias("qid"), "doc_id", "chunk_index").distinct()
    return retrieval.neighbours(chunks.select("doc_id", "chunk_index", "q"), hits, 1).select("doc_id", "chunk_index", "q").distinct()


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity = 50)
SELECT l_orderkey AS doc_id, l_suppkey AS parent_id, count(*)::BIGINT AS n, sum(l_quantity) AS q FROM lineitem SEMI JOIN p USING (l_orderkey, l_suppkey) GROUP BY ALL""")
def parent_context(spark, table):
    chunks = _line_chunks(table)
    parents = chunks.where("q = 50").select("doc_id", "parent_id").distinct()
    return chunks.join(parents, ["doc_id", "parent_id"], "left_semi").groupBy("doc_id", "parent_id").agg(F.count("*").alias("n"), F.sum("q").alias("q"))


@query("SELECT conv_id, turn, 'S' || row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS citation FROM conversations")
def citation_numbers(spark, table):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return table("conversations").select("conv_id", "turn", F.concat(F.lit("S"), F.row_number().over(w)).alias("citation"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def section_carry(spark, table):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table("conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("section"))


@query("""SELECT event_id, user_id, coalesce(abs(value - lag(value) OVER w) < 0.01, false) AS stagnant, row_number() OVER w::BIGINT AS attempt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def stagnation_lag(spark, table):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table("events").select("event_id", "user_id", F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)) < 0.01, F.lit(False)).alias("stagnant"), F.row_number().over(w).cast("long").alias("attempt"))


@query(f"""WITH n AS (SELECT count(*) AS n FROM documents), t AS (SELECT DISTINCT doc_id, unnest({TOK}) AS token FROM documents)
SELECT token, count(*)::BIGINT AS df, round(ln(1 + greatest(max(n), 1) / (1.0 + count(*))), 9) AS idf FROM t, n GROUP BY token""")
def idf(spark, table):
    docs = table("documents")
    toks = spread(docs.select("doc_id", "text")).select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token"))
    df = toks.groupBy("token").agg(F.count("*").alias("df"))
    n = docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(F.log(1 + F.col("n") / (1 + F.col("df"))), 9).alias("idf"))


_LEX = f"""nd AS (SELECT count(*) AS n FROM documents), dt AS (SELECT DISTINCT doc_id, unnest({TOK}) AS token FROM documents), qt AS (SELECT DISTINCT item_id AS qid, unnest({TOK}) AS token FROM benchmark),
df AS (SELECT token, count(*) AS df FROM dt GROUP BY token), w AS (SELECT token, round(ln(1 + greatest(n, 1) / (1.0 + df)) * 1e9)::BIGINT AS u FROM df, nd),
ls AS (SELECT qid, doc_id, sum(u)::BIGINT / 1e9 AS score FROM qt JOIN w USING (token) JOIN dt USING (token) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ls) WHERE rank <= 20)"""
_DENSE = """q AS (SELECT item_id AS qid, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON item_id = vec_id), ds AS (SELECT qid, vec_id AS doc_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 9) AS score FROM q, embeddings),
den AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ds) WHERE rank <= 20)"""


def _lexical(table):
    return retrieval.lexical(table("benchmark").select(F.col("item_id").alias("qid"), "text"), table("documents").select("doc_id", "text"))


def _dense(table):
    points = table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = table("benchmark").select(F.col("item_id").alias("qid")).join(points.withColumnRenamed("doc_id", "qid"), "qid")
    return retrieval.dense(asked, points)


@query(f"WITH {_LEX} SELECT qid, doc_id, round(score, 6) AS score, rank FROM lex")
def sparse_dot(spark, table):
    return _lexical(table).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT qid, vec_id AS doc_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 9) AS score FROM q, embeddings)
SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 20""")
def topk_dense(spark, table):
    points = table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return retrieval.dense(points.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "qid"), points)


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT qid, vec_id AS doc_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score, list_cosine_similarity(v, embedding::DOUBLE[]) AS c FROM q, embeddings)
SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(c, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 20""")
def indexed_neighbours(spark, table):
    """Exact nearest vectors through cells and quantised residuals: bounds decide which vectors are scored."""
    points = table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    model = cells.fit(points)
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    cells.write(cells.build(points, model), model, path)
    index, model = cells.open_(spark, path)
    found = cells.search(points.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "qid"), index, model, 20)
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


_RRF = f"{_LEX}, {_DENSE}, f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT qid, doc_id, rank FROM lex UNION ALL SELECT qid, doc_id, rank FROM den) GROUP BY ALL)"


def hybrid(table, limit: int = 6):
    return retrieval.rrf(_lexical(table), _dense(table), limit=limit)


@query(f"WITH {_RRF} SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 6")
def rrf_hybrid(spark, table):
    return hybrid(table)


@query(f"""WITH {_LEX}, m AS (SELECT qid, max(score) AS best FROM lex GROUP BY qid)
SELECT qid, doc_id, round(score / best, 6) AS relative, place FROM (SELECT lex.*, best, row_number() OVER (PARTITION BY lex.qid ORDER BY score DESC, doc_id) AS place FROM lex JOIN m ON lex.qid = m.qid WHERE score / best >= greatest(0.15, 0.5)) WHERE place <= 3""")
def docs_by_search(spark, table):
    w = Window.partitionBy("qid")
    rel = _lexical(table).withColumn("relative", F.col("score") / F.max("score").over(w)).where("relative >= greatest(0.15, 0.5)")
    place = F.row_number().over(w.orderBy(F.col("score").desc(), "doc_id")).cast("long")
    return rel.withColumn("place", place).where("place <= 3").select("qid", "doc_id", F.round("relative", 6).alias("relative"), "place")


_TOOLS = ", ".join(f"'{w}'" for w in text.TOOL_WORDS)
_EVAL = r"regexp_extract_all(strip_accents(lower({c})), '[a-z0-9]+')"


@query(f"""WITH {_LEX}, b AS (SELECT item_id AS qid, list_distinct(list_filter({_EVAL.format(c='text')}, lambda t: regexp_matches(t, '^\\d+$') OR (length(t) > 3 AND t NOT IN ({_TOOLS})))) AS bt FROM benchmark),
e AS (SELECT doc_id, {_EVAL.format(c='text')} AS et FROM documents), r AS (SELECT lex.qid, lex.doc_id, rank, CASE WHEN len(bt) = 0 THEN 0.0 ELSE round(len(list_intersect(bt, et)) / len(bt)::DOUBLE, 6) END AS rerank_score FROM lex JOIN b USING (qid) JOIN e USING (doc_id))
SELECT qid, doc_id, rerank_score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rank) AS new_rank FROM r WHERE rerank_score >= 0.15) WHERE new_rank <= 6""")
def rerank_cascade(spark, table):
    q = table("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    cand = _lexical(table).join(table("documents").select("doc_id", "text"), "doc_id").join(q, "qid")
    bearing = F.array_distinct(F.filter(text.tokens(F.col("question")), lambda t: t.rlike(r"^\d+$") | ((F.length(t) > 3) & ~t.isin(text.TOOL_WORDS))))
    cand = cand.withColumn("toks", text.tokens(F.col("text"))).withColumn("bearing", bearing)
    score = F.round(arrays.share(F.col("bearing"), F.col("toks")), 6)
    return retrieval.rerank(cand, score, 6, 0.15).select("qid", "doc_id", "rerank_score", "new_rank")


@query(f"""WITH RECURSIVE {_LEX}, c AS (SELECT qid, rank, doc_id % 7 AS grp, sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS fp, trim(text) <> '' AS ok FROM lex JOIN documents USING (doc_id)),
s AS (SELECT qid, 0::BIGINT AS rank, []::BIGINT[] AS kept, []::VARCHAR[] AS fps, []::BIGINT[] AS grps FROM (SELECT DISTINCT qid FROM c)
  UNION ALL SELECT s.qid, c.rank, CASE WHEN t THEN list_append(kept, c.rank) ELSE kept END, CASE WHEN t THEN list_append(fps, fp) ELSE fps END, CASE WHEN t THEN list_append(grps, grp) ELSE grps END
  FROM s JOIN c ON c.qid = s.qid AND c.rank = s.rank + 1, LATERAL (SELECT ok AND NOT list_contains(fps, fp) AND len(list_filter(grps, lambda g: g = grp)) < 3 AND len(kept) < 6 AS t)),
l AS (SELECT qid, arg_max(kept, rank) AS kept FROM s GROUP BY qid)
SELECT qid, unnest(kept) AS rank, unnest(range(1, len(kept) + 1)) AS place FROM l""")
def diversify(spark, table):
    ranked = _lexical(table).join(table("documents").select("doc_id", "text"), "doc_id").select("qid", "rank", (F.col("doc_id") % 7).alias("doc_id"), "text")
    return retrieval.diversify(ranked).select("qid", "rank", "place")


_CHUNKS = "SELECT conv_id AS doc_id, turn AS c, CASE WHEN conv_id % 2 = 0 THEN turn // 3 END AS parent, length(text) AS n FROM conversations"


@query(f"""WITH RECURSIVE k AS ({_CHUNKS}), h AS (SELECT * FROM (SELECT doc_id % 20 AS qid, *, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id, c) AS rank FROM k WHERE (doc_id + c) % 4 = 0) WHERE rank <= 6),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id, parent ORDER BY rank) AS nth FROM h), e AS (SELECT o.qid, o.rank, k.doc_id, k.c, k.n FROM o JOIN k ON k.doc_id = o.doc_id AND CASE WHEN o.parent IS NULL THEN abs(k.c - o.c) <= 1 ELSE k.parent = o.parent END
  WHERE (o.parent IS NULL OR nth = 1) AND NOT EXISTS (SELECT 1 FROM h WHERE h.qid = o.qid AND h.doc_id = k.doc_id AND h.c = k.c)),
s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, c) AS step FROM e), z AS (SELECT qid, 700 - sum(n) AS budget FROM h GROUP BY 1),
f AS (SELECT qid, 0::BIGINT AS step, 0 AS added, budget AS rest, 0::BIGINT AS broken, []::VARCHAR[] AS got FROM z
  UNION ALL SELECT f.qid, s.step, CASE WHEN t THEN added + 1 ELSE added END, CASE WHEN t THEN rest - s.n ELSE rest END, CASE WHEN b THEN s.rank ELSE broken END, CASE WHEN t THEN list_append(got, s.rank || ':' || s.doc_id || ':' || s.c) ELSE got END
  FROM f JOIN s ON s.qid = f.qid AND s.step = f.step + 1, LATERAL (SELECT s.rank <> broken AND len(list_filter(got, lambda x: split_part(x, ':', 2) = s.doc_id::VARCHAR AND split_part(x, ':', 3) = s.c::VARCHAR)) = 0 AS open_) y, LATERAL (SELECT open_ AND added < 6 AND s.n <= rest AS t, open_ AND (added >= 6 OR s.n > rest) AS b) x),
l AS (SELECT qid, unnest(got) AS g FROM (SELECT qid, arg_max(got, step) AS got FROM f GROUP BY qid)), u AS (SELECT qid, rank, 0 AS a, doc_id, c FROM h UNION ALL SELECT qid, split_part(g, ':', 1)::BIGINT, 1, split_part(g, ':', 2)::BIGINT, split_part(g, ':', 3)::BIGINT FROM l)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank, a, u.c) AS place, u.doc_id, u.c AS chunk_index, a = 1 AS added, n::BIGINT AS n_chars FROM u JOIN k ON k.doc_id = u.doc_id AND k.c = u.c""")
def expand_context(spark, table):
    """Hits of questions among turns of conversations with their context: parents of even conversations, neighbours in odd ones, within a budget."""
    parent = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("p"), F.floor(F.col("turn") / 3).cast("string")))
    chunks = table("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), parent.alias("parent_id"), "text")
    w = Window.partitionBy("qid").orderBy("doc_id", "chunk_index")
    hits = chunks.where((F.col("doc_id") + F.col("chunk_index")) % 4 == 0).withColumn("qid", F.col("doc_id") % 20).withColumn("rank", F.row_number().over(w)).where("rank <= 6")
    return retrieval.expand_context(hits.select("qid", "rank", "doc_id", "chunk_index", "parent_id", "text"), chunks, budget=700)


@query("""WITH r AS (SELECT source, doc_id, length(text) AS size, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT source, doc_id, size::BIGINT AS size, used::BIGINT AS used, used > 16000 AS cut FROM r WHERE used <= 16000 OR n = 1""")
def context_budget(spark, table):
    return structure.context(table("documents"), "source", "doc_id", F.length("text")).select("source", "doc_id", "size", "used", "cut")


@query("""WITH RECURSIVE d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, length(text) + 8 AS c FROM conversations),
s AS (SELECT conv_id, n, turn, c AS used, 1::BIGINT AS batch FROM d WHERE n = 1 UNION ALL
  SELECT d.conv_id, d.n, d.turn, CASE WHEN s.used + d.c > 400 THEN d.c ELSE s.used + d.c END, CASE WHEN s.used + d.c > 400 THEN batch + 1 ELSE batch END FROM s JOIN d ON d.conv_id = s.conv_id AND d.n = s.n + 1)
SELECT conv_id, turn, batch FROM s""")
def batches_of_turns(spark, table):
    return structure.batches(table("conversations"), "conv_id", "turn", F.length("text"), limit=400).select("conv_id", "turn", "batch")


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct({TOK}) AS t FROM conversations), p AS (SELECT conv_id, turn, t, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat(t, b))) = 0 THEN 0.0 ELSE round(len(list_intersect(t, b)) / len(list_distinct(list_concat(t, b)))::DOUBLE, 6) END AS jaccard, CASE WHEN len(t) = 0 THEN 0.0 ELSE round(len(list_intersect(t, b)) / len(t)::DOUBLE, 6) END AS recall FROM p WHERE b IS NOT NULL""")
def jaccard(spark, table):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table("conversations").select("conv_id", "turn", F.array_distinct(text.tokens(F.col("text"))).alias("t")).withColumn("b", F.lag("t").over(w)).where("b is not null")
    return t.select("conv_id", "turn", F.round(arrays.jaccard(F.col("t"), F.col("b")), 6).alias("jaccard"), F.round(arrays.share(F.col("t"), F.col("b")), 6).alias("recall"))


@query(f"""WITH b AS (SELECT item_id, {TOK} AS t FROM benchmark), d AS (SELECT doc_id, {TOK} AS t FROM documents),
bg AS (SELECT DISTINCT item_id, array_to_string(t[i:i + 7], ' ') AS g FROM (SELECT item_id, t, unnest(range(1, len(t) - 6)) AS i FROM b)), dg AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 7], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS i FROM d)),
n AS (SELECT item_id, count(*) AS n FROM bg GROUP BY 1)
SELECT doc_id, item_id, count(*)::BIGINT AS shared, round(count(*) / max(n)::DOUBLE, 6) AS part FROM bg JOIN dg USING (g) JOIN n USING (item_id) GROUP BY ALL""")
def ngram_overlap(spark, table):
    """Documents that hold eight-word runs of benchmark items. Runs of documents are kept only if an item has them, before anything is counted."""
    grams = lambda d, k: d.select(k, F.explode(F.when(F.size("t") >= 8, text.ngrams(F.col("t"), 8)).otherwise(F.array().cast("array<string>"))).alias("g"))
    items = grams(table("benchmark").select("item_id", text.tokens(F.col("text")).alias("t")), "item_id")
    found = grams(spread(table("documents").select("doc_id", "text")).select("doc_id", text.tokens(F.col("text")).alias("t")), "doc_id").join(items, "g")
    n = items.groupBy("item_id").agg(F.count("*").alias("n"))
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")).join(n, "item_id").select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("part"))


_ASK = "CASE WHEN p_size % 3 = 0 THEN 'value in the report on ' || p_name ELSE 'what of ' || split_part(p_name, ' ', 1) END"
_MARK = " OR ".join(f"contains(plain, '{m}')" for m in resolve.SCOPE_MARKS)


@query(f"""WITH c AS (SELECT p_partkey, p_name, {useful_sql('p_name')} AS u FROM part), s AS (SELECT p_partkey, p_name, unnest(u) AS token FROM c), n AS (SELECT greatest(count(DISTINCT p_partkey), 1) AS n FROM part),
df AS (SELECT token, ln(1 + max(n) / (1.0 + count(DISTINCT p_partkey))) AS idf FROM s, n GROUP BY token), w AS (SELECT p_partkey, p_name, token, idf FROM s JOIN df USING (token)), whole AS (SELECT p_partkey, p_name, sum(idf) AS whole FROM w GROUP BY ALL),
q AS (SELECT p_partkey AS qid, {_ASK} AS text FROM part), k AS (SELECT qid, list_distinct({TOK}) AS t, array_to_string({TOK}, ' ') AS plain FROM q), a AS (SELECT qid, unnest(t) AS token FROM k), m AS (SELECT qid, {_MARK} AS marked FROM k),
h AS (SELECT qid, p_partkey, p_name, sum(idf) AS part, string_agg(token, ' ' ORDER BY token) AS found FROM a JOIN w USING (token) GROUP BY ALL),
x AS (SELECT h.*, round(CASE WHEN marked THEN least(1.0, part / whole * 1.15) ELSE part / whole END, 6) AS score FROM h JOIN whole USING (p_partkey) JOIN m USING (qid)),
g AS (SELECT qid, score, found, count(*) AS n_documents, min(p_name) AS first_label FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER o AS place, coalesce(lead(score) OVER o, 0) AS second_score FROM g WINDOW o AS (PARTITION BY qid ORDER BY score DESC, first_label, found))
SELECT q.qid, CASE WHEN score IS NULL OR score < 0.55 THEN 'none' WHEN score - second_score < 0.15 THEN 'ambiguous' WHEN n_documents = 1 THEN 'exact' ELSE 'compatible' END AS status, coalesce(score, 0.0) AS score, coalesce(n_documents, 0)::BIGINT AS n_documents, first_label, coalesce(second_score, 0.0) AS second_score
FROM q LEFT JOIN (SELECT * FROM r WHERE place = 1) r ON r.qid = q.qid""")
def resolve_documents(spark, table):
    part = table("part")
    asked = part.select(F.col("p_partkey").alias("qid"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("value in the report on "), "p_name")).otherwise(F.concat(F.lit("what of "), F.element_at(F.split("p_name", " "), 1))).alias("text"))
    return resolve.resolve(asked, part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title")))


@query("""WITH v AS (SELECT DISTINCT value, trim(strip_accents(lower(value))) AS k FROM (SELECT n_name AS value FROM nation UNION ALL SELECT ' ' || lower(n_name) FROM nation UNION ALL SELECT r_name || ' region' FROM region UNION ALL SELECT s_name FROM supplier)),
c AS (SELECT trim(strip_accents(lower(n_name))) AS k, min(n_name) AS canonical FROM nation GROUP BY 1), a AS (SELECT trim(strip_accents(lower(r_name || ' region'))) AS k, min(n_name) AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT value, coalesce(c.canonical, a.canonical, value) AS canonical, CASE WHEN c.canonical IS NOT NULL THEN 'exact' WHEN a.canonical IS NOT NULL THEN 'alias' ELSE 'new' END AS phase FROM v LEFT JOIN c USING (k) LEFT JOIN a USING (k)""")
def entity_exact_alias(spark, table):
    nation, region = table("nation"), table("region")
    names = nation.select(F.col("n_name").alias("value"))
    every = names.unionByName(nation.select(F.concat(F.lit(" "), F.lower("n_name")).alias("value"))).unionByName(region.select(F.concat("r_name", F.lit(" region")).alias("value"))).unionByName(table("supplier").select(F.col("s_name").alias("value")))
    aliases = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("canonical"), F.concat("r_name", F.lit(" region")).alias("alias"))
    return resolve.exact_entities(every, aliases)


_MASK = "list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, i::INTEGER + 1, 1) = c THEN 1::BIGINT << i ELSE 0 END))::BIGINT)"
_LCS = f"length(a) - bit_count(list_reduce(list_prepend((1::BIGINT << length(a)) - 1, {_MASK.format(a='a', b='b')}), lambda row, m: ((row + (row & m)) | (row & ~m)) & ((1::BIGINT << length(a)) - 1)))"


@query(f"""WITH RECURSIVE f AS (SELECT p_brand AS field, p_name AS value, lower(p_name) AS k, min(p_partkey) AS ord FROM part GROUP BY ALL), p AS (SELECT x.field, x.k AS a, y.k AS b, y.ord FROM f x JOIN f y ON x.field = y.field AND y.ord < x.ord),
u AS (SELECT DISTINCT a, b FROM p), r AS (SELECT a, b, 2.0 * ({_LCS}) / (length(a) + length(b)) AS ratio FROM u WHERE 2 * least(length(a), length(b)) >= 0.88 * (length(a) + length(b))),
e AS (SELECT p.field, a AS k, b AS other, ratio, max(ratio) OVER (PARTITION BY p.field, a) AS top FROM p JOIN r USING (a, b) WHERE ratio >= 0.88), t AS (SELECT field, k, other FROM e WHERE ratio = top),
w AS (SELECT field, k, other FROM t UNION SELECT w.field, w.k, t.other FROM w JOIN t ON w.field = t.field AND w.other = t.k),
c AS (SELECT w.field, w.k, arg_min(f.value, f.ord) AS canonical FROM w JOIN f ON w.field = f.field AND w.other = f.k WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.field = w.field AND t.k = w.other) GROUP BY ALL)
SELECT f.field, f.value, coalesce(c.canonical, f.value) AS canonical, coalesce(m.top, 1.0) AS ratio FROM f LEFT JOIN c USING (field, k) LEFT JOIN (SELECT DISTINCT field, k, top FROM e) m USING (field, k)""")
def entity_fuzzy(spark, table):
    """Names of parts by brand: canonical ones, and those that are like an earlier one by their letters."""
    part = table("part").select(F.col("p_brand").alias("field"), F.col("p_name").alias("value"), F.col("p_partkey").alias("pos"))
    return resolve.fuzzy_entities(part)
