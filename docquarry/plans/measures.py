"""Aggregation, evaluation, routing and event queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, text, values
from ..operators import evaluate, nearest, retrieval, routing
from ..session import spread
from ..streaming import windows
from .base import query
from .texts import TOK


@query("""WITH v AS (SELECT user_id, event_type, event_type <> 'error' AS ok FROM events), t AS (SELECT user_id, count(*)::BIGINT AS total, count(*) FILTER (ok) AS n_valid FROM v GROUP BY 1),
c AS (SELECT user_id, event_type, count(*) AS votes FROM v WHERE ok GROUP BY ALL), b AS (SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type DESC) AS r FROM c) WHERE r = 1)
SELECT t.user_id, total, CASE WHEN votes * 2 > total THEN event_type END AS verdict, coalesce(votes, 0)::BIGINT AS votes, CASE WHEN n_valid = 0 THEN 'no_valid_vote' WHEN votes * 2 > total THEN 'majority' ELSE 'ambiguous' END AS reason FROM t LEFT JOIN b USING (user_id)""")
def vote_majority(spark, table):
    return evaluate.majority(table("events"), "user_id", "event_type", F.col("event_type") != "error")


@query(r"""WITH e AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k, text FROM conversations), g AS (SELECT conv_id, k, min(turn) AS turn, count(*)::BIGINT AS n, list_sort(list(DISTINCT turn)) AS turns FROM e WHERE k <> '' GROUP BY ALL)
SELECT g.conv_id, sha1(k) AS key, turn, n, array_to_string(turns, ',') AS turns FROM g""")
def merge_values(spark, table):
    e = table("conversations").select("conv_id", "turn", F.lower(text.collapse(F.col("text"))).alias("k")).where("k <> ''")
    g = e.groupBy("conv_id", "k").agg(F.min("turn").alias("turn"), F.count("*").alias("n"), F.array_sort(F.collect_set("turn")).alias("turns"))
    return g.select("conv_id", F.sha1(F.col("k").cast("binary")).alias("key"), "turn", "n", F.array_join("turns", ",").alias("turns"))


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def fuse_elements(spark, table):
    first = F.min(F.struct("ts", "event_id")).alias("f")  # the first of each pair, combined before the shuffle
    return table("events").groupBy("user_id", "event_type").agg(first).select("user_id", "event_type", "f.event_id", "f.ts")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n)::BIGINT AS n, max(value) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(value) FILTER (i = round_even(0.9 * (n - 1), 0)) AS p90, max(value) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95 FROM r GROUP BY 1""")
def pctl_half_even(spark, table):
    return evaluate.half_even_percentile(table("events"), ["event_type"], "value", [0.5, 0.9, 0.95])


_NEAR = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
near AS (SELECT qid, doc_id, rank FROM (SELECT q.vec_id AS qid, v.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id) AS rank FROM q, v) WHERE rank <= 11 AND qid <> doc_id)"""


def _near(table):
    points = table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    got = retrieval.dense(points.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "qid"), points, 11)
    return got.where("qid <> doc_id")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id) AS r FROM v AS q JOIN v ON q.vec_id <> v.vec_id),
p AS (SELECT a.label AS expected, b.label AS got, count(*)::BIGINT AS n FROM f JOIN v a ON a.vec_id = qid JOIN v b ON b.vec_id = doc_id WHERE r = 1 GROUP BY ALL) SELECT expected, got, n, round(n / sum(n) OVER (PARTITION BY expected), 6)::DOUBLE AS share FROM p""")
def confusion_matrix(spark, table):
    """Each vector's label against that of its nearest other vector; all vectors are counted."""
    e = table("embeddings")
    found = nearest.nearest_other(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")))
    a, b = e.select("vec_id", "label").toDF("qid", "a"), e.select("vec_id", "label").toDF("doc_id", "b")
    return evaluate.confusion(found.join(a, "qid").join(b, "doc_id"), "a", "b")


@query(f"""WITH {_NEAR}, r AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM near), g AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id FROM q JOIN v ON q.label = v.label AND q.vec_id <> v.vec_id), n AS (SELECT qid, count(*) AS n FROM g GROUP BY 1),
h AS (SELECT r.qid, rank, row_number() OVER (PARTITION BY r.qid ORDER BY rank) AS nth FROM r SEMI JOIN g ON r.qid = g.qid AND r.doc_id = g.doc_id WHERE rank <= 10), s AS (SELECT qid, count(*) AS h, min(rank) AS first, sum(nth / rank::DOUBLE) AS ap FROM h GROUP BY 1)
SELECT n.qid, round(coalesce(h, 0) / 10.0::DOUBLE, 6) AS precision, round(coalesce(h, 0) / n::DOUBLE, 6) AS recall, CASE WHEN coalesce(h, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr, round(coalesce(ap, 0) / least(n, 10), 6) AS ap FROM n LEFT JOIN s USING (qid)""")
def metrics_at_k(spark, table):
    label = table("embeddings").select("vec_id", "label")
    asked = label.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"))
    w = Window.partitionBy("qid").orderBy("rank")
    return evaluate.at_k_of_classes(_near(table).withColumn("rank", F.row_number().over(w)), label.toDF("doc_id", "class"), asked, 10)


@query("""SELECT axis, value, n, errors, round(errors / n::DOUBLE, 6) AS rate, cents FROM (SELECT CASE WHEN grouping(o_orderpriority) = 0 THEN 'priority' WHEN grouping(o_orderstatus) = 0 THEN 'status' ELSE 'year' END AS axis,
coalesce(o_orderpriority, o_orderstatus, y) AS value, count(*)::BIGINT AS n, (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS errors, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents
FROM (SELECT *, year(o_orderdate)::VARCHAR AS y FROM orders) GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), (y)))""")
def failure_axes(spark, table):
    return spark.sql("""
        SELECT axis, value, n, errors, round(errors / n, 6) AS rate, cents FROM (
          SELECT CASE WHEN grouping(o_orderpriority) = 0 THEN 'priority' WHEN grouping(o_orderstatus) = 0 THEN 'status' ELSE 'year' END AS axis,
            coalesce(o_orderpriority, o_orderstatus, y) AS value, count(*) AS n, count_if(o_orderstatus = 'F') AS errors, sum(cast(round(o_totalprice * 100) AS bigint)) AS cents
          FROM (SELECT *, cast(year(o_orderdate) AS string) AS y FROM {orders})
          GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), (y)))""", orders=table("orders"))


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) AS t FROM c), s AS (SELECT lang, n, (97 * n) // t AS base, (97 * n) % t AS rest, t FROM c, t),
r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, lang) AS p, least(97, t) - sum(base) OVER () AS missing FROM s) SELECT lang, n::BIGINT AS n, least(base + CASE WHEN p <= missing THEN 1 ELSE 0 END, n)::BIGINT AS seats FROM r""")
def largest_remainder(spark, table):
    return evaluate.largest_remainder(table("documents").groupBy("lang").agg(F.count("*").alias("n")), "lang", "n", 97)


@query(f"""WITH t AS (SELECT conv_id, turn, role, list_distinct({TOK}) AS t FROM conversations), x AS (SELECT *, list_distinct(flatten(list(t) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) AS c FROM t),
b AS (SELECT conv_id, turn, c, list_filter(t, lambda w: regexp_matches(w, '^\\d+$') OR (length(w) > 3 AND w NOT IN ({", ".join(f"'{w}'" for w in text.TOOL_WORDS)}))) AS b FROM x WHERE role = 'assistant')
SELECT conv_id, turn, len(b)::BIGINT AS n_bearing, CASE WHEN len(b) = 0 THEN 1.0 ELSE round(len(list_intersect(b, coalesce(c, []))) / len(b)::DOUBLE, 6) END::DOUBLE AS grounded FROM b""")
def groundedness(spark, table):
    """Part of an answer's bearing tokens found in the turns before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t = table("conversations").select("conv_id", "turn", "role", F.array_distinct(text.tokens(F.col("text"))).alias("t"))
    t = t.withColumn("c", F.array_distinct(F.flatten(F.collect_list("t").over(w)))).where("role = 'assistant'")
    bearing = F.filter("t", lambda x: x.rlike(r"^\d+$") | ((F.length(x) > 3) & ~x.isin(text.TOOL_WORDS)))
    t = t.withColumn("b", bearing)
    return t.select("conv_id", "turn", F.size("b").cast("long").alias("n_bearing"), F.when(F.size("b") == 0, 1.0).otherwise(F.round(arrays.share(F.col("b"), F.col("c")), 6)).alias("grounded"))


@query(f"""WITH b AS (SELECT item_id, list_distinct({TOK}) AS g FROM benchmark), p AS (SELECT doc_id, {TOK} AS t FROM documents WHERE text IS NOT NULL), dt AS (SELECT DISTINCT doc_id, unnest(t) AS w FROM p), bt AS (SELECT item_id, unnest(g) AS w FROM b),
h AS (SELECT item_id, doc_id, count(*) AS hits FROM bt JOIN dt USING (w) GROUP BY ALL), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM h) WHERE rank <= 6),
f AS (SELECT item_id, w, min(rank) AS first FROM r JOIN dt USING (doc_id) JOIN bt USING (item_id, w) GROUP BY ALL), n AS (SELECT item_id, first AS rank, count(*) AS gain FROM f GROUP BY ALL),
c AS (SELECT item_id, rank, gain, sum(gain) OVER (PARTITION BY item_id ORDER BY rank) AS have FROM n)
SELECT item_id, rank, gain::BIGINT AS gain, round(have / len(g)::DOUBLE, 6) AS covered FROM c JOIN b USING (item_id)""")
def coverage_cumulative(spark, table):
    """Evidence tokens that each of the six best documents of an item adds, and the share covered so far."""
    bt = table("benchmark").select(F.col("item_id").alias("qid"), F.array_distinct(text.tokens(F.col("text"))).alias("g"))
    docs = table("documents").select("doc_id", "text")
    found = retrieval.by_words(bt.select("qid", F.explode("g").alias("token"), F.lit(1).cast("long").alias("units")), spread(docs), 6)
    top = retrieval.best(found.withColumnRenamed("units", "score"), 6).join(docs, "doc_id").join(bt, "qid")
    held = F.array_intersect("g", text.tokens(F.col("text")))
    firsts = top.select(F.col("qid").alias("item_id"), F.size("g").alias("n"), "rank", F.explode(held).alias("w")).groupBy("item_id", "w").agg(F.min("rank").alias("rank"), F.max("n").alias("n"))
    gains = firsts.groupBy("item_id", "rank").agg(F.count("*").alias("gain"), F.max("n").alias("n"))
    have = F.sum("gain").over(Window.partitionBy("item_id").orderBy("rank"))
    return gains.select("item_id", "rank", "gain", F.round(have / F.col("n"), 6).alias("covered"))


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN CASE WHEN toxic = 1 THEN 'REFUS_CORRECT' ELSE 'FAUX_POSITIF' END WHEN toxic = 1 THEN 'REFUS_INCORRECT'
WHEN lang = 'fr' OR n_chars > 1000 THEN CASE WHEN quality = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'SUCCES' ELSE 'SUCCES_CITATION_INVALIDE' END ELSE 'ECHEC_GENERATION' END
ELSE CASE WHEN quality = 1 THEN 'CORRECT_SANS_EVIDENCE' ELSE 'ECHEC_RETRIEVAL' END END AS outcome FROM documents JOIN labels USING (doc_id)""")
def case_classification(spark, table):
    d = table("documents").select("doc_id", "lang", "n_chars").join(table("labels"), "doc_id")
    covered = F.when(F.col("lang") != "fr", F.col("n_chars") > 1000)
    return d.select("doc_id", evaluate.case_class(F.col("lang") != "de", F.col("toxic") == 1, F.col("quality") == 1, covered, F.col("doc_id") % 2 == 0).alias("outcome"))


@query("""SELECT l_orderkey, l_linenumber, abs(l_extendedprice - v) <= CASE WHEN l_extendedprice = 0 THEN 1e-6 ELSE abs(l_extendedprice) * 1e-6 END AS same FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber % 2 = 0 THEN round(l_extendedprice, 2) ELSE round(l_extendedprice, 0) END AS v FROM lineitem)""")
def numeric_match(spark, table):
    p = F.col("l_extendedprice")
    shown = F.format_string("%.2f", F.when(F.col("l_linenumber") % 2 == 0, F.round(p, 2)).otherwise(F.round(p, 0)))
    return table("lineitem").select("l_orderkey", "l_linenumber", values.within(p, values.number(shown)).alias("same"))


@query("""SELECT lang AS corpus_id, count(*)::BIGINT AS n_points, count(DISTINCT doc_id)::BIGINT AS n_documents, sum(length(text))::BIGINT AS n_chars, CASE WHEN count(*) = 0 THEN 'empty' WHEN sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) > 0 THEN 'partial' ELSE 'ready' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def corpus_status(spark, table):
    d = table("documents").join(table("labels"), "doc_id", "left")
    bad = F.sum(F.when(F.col("quality") == 0, 1).otherwise(0))
    return d.groupBy(F.col("lang").alias("corpus_id")).agg(F.count("*").alias("n_points"), F.countDistinct("doc_id").alias("n_documents"), F.sum(F.length("text")).alias("n_chars"), F.when(bad > 0, "partial").otherwise("ready").alias("status"))


_W = ", ".join(f"'{w}'" for w in routing.SUMMARIZE_WORDS)


@query(f"""SELECT conv_id, turn, len(list_intersect({TOK}, [{_W}])) > 0 OR {" OR ".join(f"contains(strip_accents(lower(text)), '{p}')" for p in routing.SUMMARIZE_PHRASES)} AS summarize,
contains(text, ',') OR contains(strip_accents(lower(text)), ' et ') OR contains(strip_accents(lower(text)), ' and ') AS listing FROM conversations WHERE role = 'user'""")
def intent_of_turns(spark, table):
    t = text.unaccent(F.col("text"))
    listing = t.contains(",") | t.contains(" et ") | t.contains(" and ")
    return table("conversations").where("role = 'user'").select("conv_id", "turn", (routing.intent(F.col("text")) == "summarize").alias("summarize"), listing.alias("listing"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def events_tumbling(spark, table):
    return windows.counts(table("events"))


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS window_start, event_type, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL""")
def events_sliding(spark, table):
    return windows.counts(table("events"), "1 hour", "15 minutes")


@query("""WITH o AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR, true) AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*)::BIGINT AS n FROM s GROUP BY user_id, s""")
def events_session(spark, table):
    return windows.sessions(table("events"), "12 hours")


@query("SELECT DISTINCT user_id, event_type FROM events")
def events_first(spark, table):
    return windows.first_of(table("events"), ["user_id", "event_type"]).select("user_id", "event_type")
