"""Capability, sampling, incremental and linking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import capability, incremental, order, postings, resolve, structure
from ..session import cut, spread
from .base import query
from .search import _LEX, _lexical
from .texts import TOK

# Frequent words by language, the offline classifier's categories.
LANGUAGES = {"de": "der die das und den ist mit von sich nicht".split(), "en": "the of and to in that was with are this".split(), "es": "que los del las una por con para el su".split(), "fr": "les des une dans pour est que par sur avec".split()}


def _turns(table):
    return table("conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("n"), "text")


_HITS = ", ".join(f"len(list_filter(t, lambda x: x IN ({', '.join(chr(39) + w + chr(39) for w in ws)})))::BIGINT AS {c}" for c, ws in LANGUAGES.items())
_BATCHES = """d AS (SELECT conv_id AS doc_id, turn + 1 AS n, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) + 8 AS c FROM conversations),
s AS (SELECT doc_id, i, n, c AS used, 1::BIGINT AS batch FROM d WHERE i = 1 UNION ALL
  SELECT d.doc_id, d.i, d.n, CASE WHEN s.used + d.c > 400 THEN d.c ELSE s.used + d.c END, CASE WHEN s.used + d.c > 400 THEN batch + 1 ELSE batch END FROM s JOIN d ON d.doc_id = s.doc_id AND d.i = s.i + 1)"""


@query(f"""WITH RECURSIVE {_BATCHES}, p AS (SELECT doc_id, batch, string_agg('[S' || n || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS text FROM s JOIN d USING (doc_id, n) GROUP BY ALL),
h AS (SELECT doc_id, batch, {_HITS} FROM (SELECT doc_id, batch, {TOK} AS t FROM p)), g AS (SELECT *, greatest(de, en, es, fr) AS m FROM h),
v AS (SELECT doc_id, CASE WHEN m = 0 THEN NULL WHEN de = m THEN 'de' WHEN en = m THEN 'en' WHEN es = m THEN 'es' ELSE 'fr' END AS category FROM g), t AS (SELECT doc_id, count(*)::BIGINT AS total, count(category) AS ok FROM v GROUP BY 1),
b AS (SELECT doc_id, category, votes FROM (SELECT doc_id, category, count(*) AS votes, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, category DESC) AS r FROM v WHERE category IS NOT NULL GROUP BY doc_id, category) WHERE r = 1)
SELECT t.doc_id, total, CASE WHEN votes * 2 > total THEN category END AS verdict, coalesce(votes, 0)::BIGINT AS votes, CASE WHEN ok = 0 THEN 'no_valid_vote' WHEN votes * 2 > total THEN 'majority' ELSE 'ambiguous' END AS reason FROM t LEFT JOIN b USING (doc_id)""")
def classify_documents(spark, table):
    return capability.classify(_turns(table), capability.keyword_votes(LANGUAGES), 400)


FIELDS = {"email": r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+", "phone": r"\+\d[\d ()-]{7,}\d", "year": r"(?:19|20)\d\d"}
_FOUND = " UNION ALL ".join(f"SELECT doc_id, n, '{f}' AS field, regexp_extract_all(text, '{p}') AS vs FROM l" for f, p in FIELDS.items())


@query(rf"""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, unnest(string_split(text, chr(10))) AS text FROM documents), f AS ({_FOUND}),
e AS (SELECT doc_id, n, field, unnest(vs) AS value, unnest(range(len(vs))) AS pos FROM f), k AS (SELECT *, lower(trim(regexp_replace(value, '\s+', ' ', 'g'))) AS key FROM e),
m AS (SELECT doc_id, field, key, arg_min(value, n * 100000 + pos) AS value, list_sort(list(DISTINCT n)) AS ns FROM k GROUP BY ALL)
SELECT doc_id, field, value, array_to_string(list_transform(ns, lambda x: 'S' || x), ' ') AS citations, count(*) OVER (PARTITION BY doc_id, field)::BIGINT AS n_values, count(*) OVER (PARTITION BY doc_id, field) = 1 AS single FROM m""")
def extract_fields(spark, table):
    lines = table("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("n"), "text")
    return capability.extract(lines, FIELDS)


@query()
def summarize_documents(spark, table):
    passages = structure.chunks(table("documents")).select("doc_id", (F.col("chunk_index") + 1).alias("n"), "text")
    got = capability.summarize(passages, budget=1_500)
    return got.select("doc_id", "status", F.length("summary").cast("long").alias("n_chars"), F.col("depth").cast("long").alias("depth"))


@query("""WITH e AS (SELECT DISTINCT conv_id AS doc_id FROM conversations WHERE role = 'assistant' AND trim(text) <> ''), t AS (SELECT DISTINCT o_custkey AS qid, o_orderkey % 200 AS doc_id FROM orders), h AS (SELECT qid, t.doc_id, e.doc_id IS NOT NULL AS ok FROM t LEFT JOIN e USING (doc_id))
SELECT qid, CASE WHEN count(*) FILTER (ok) = 0 THEN 'failed' WHEN bool_and(ok) THEN 'complete' ELSE 'partial' END AS status, (count(*) FILTER (ok))::BIGINT AS usable, coalesce(string_agg(doc_id, ',' ORDER BY doc_id) FILTER (NOT ok), '') AS missing FROM h GROUP BY qid""")
def compare_targets(spark, table):
    maps = table("conversations").where("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), F.lit("turn").alias("axis"), F.col("text").alias("content"), F.concat(F.lit("S"), F.col("turn").cast("string")).alias("citation"), F.col("turn").alias("pos"))
    found = capability.elements(maps, maps.select("doc_id", "citation").distinct())
    targets = table("orders").select(F.col("o_custkey").alias("qid"), (F.col("o_orderkey") % 200).alias("doc_id")).distinct()
    return capability.compare(found, targets)


@query(f"""WITH {_LEX}, m AS (SELECT qid, max(score) AS top FROM lex GROUP BY 1), p AS (SELECT qid, doc_id, score / 40 AS s, rank FROM lex WHERE score / 40 >= 0.5 AND rank <= 6), b AS (SELECT qid, count(*) AS n, arg_min(doc_id, rank) AS doc_id FROM p GROUP BY 1),
x AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT item_id AS qid, CASE WHEN n IS NULL THEN 'refused' ELSE 'answered' END AS status, CASE WHEN length(t) <= 320 THEN t ELSE rtrim(substr(t, 1, 317)) || '...' END || ' [S1]' AS answer, coalesce(n, 0)::BIGINT AS n_sources FROM benchmark LEFT JOIN b ON qid = item_id LEFT JOIN x USING (doc_id)""")
def answer_or_refuse(spark, table):
    ranked = _lexical(table).where("rank <= 6").select("qid", "doc_id", F.col("rank").alias("new_rank"), (F.col("score") / 40).alias("rerank_score"))
    return capability.answer(ranked.join(table("documents").select("doc_id", "text"), "doc_id"), table("benchmark").select(F.col("item_id").alias("qid")), 0.5)


@query("""WITH a AS (SELECT doc_id AS path, lang AS hash, quality::VARCHAR AS signature FROM documents JOIN labels USING (doc_id) UNION ALL SELECT -1 - r_regionkey, 'gone', '0' FROM region), b AS (SELECT doc_id AS path, lang AS hash, CASE WHEN n_chars > 1000 THEN '1' ELSE '0' END AS signature FROM documents),
s AS (SELECT path, CASE WHEN b.path IS NULL THEN 'deleted' WHEN a.path IS NULL THEN 'new' WHEN a.hash IS NOT DISTINCT FROM b.hash AND a.signature IS NOT DISTINCT FROM b.signature THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b USING (path)),
f AS (SELECT path, CASE WHEN status IN ('new', 'changed') AND path IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'failed' ELSE status END AS status FROM s), n AS (SELECT status, count(*)::BIGINT AS n FROM f GROUP BY 1) SELECT status, n, round(100.0 * n / sum(n) OVER (), 1)::DOUBLE AS share FROM n""")
def sync_report(spark, table):
    d, labels = table("documents"), table("labels")
    old = d.join(labels, "doc_id").select(F.col("doc_id").alias("path"), F.col("lang").alias("hash"), F.col("quality").cast("string").alias("signature"))
    old = old.unionByName(table("region").select((-1 - F.col("r_regionkey")).cast("long").alias("path"), F.lit("gone").alias("hash"), F.lit("0").alias("signature")))
    now = d.select(F.col("doc_id").alias("path"), F.col("lang").alias("hash"), F.when(F.col("n_chars") > 1000, "1").otherwise("0").alias("signature"))
    _, status = incremental.sync(old, now, labels.where("toxic = 1").select(F.col("doc_id").alias("path")))
    return incremental.report(status)


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (epoch_us(ts)::HUGEINT * 10000000 + event_id)) AS last, min(ts) AS started, max(ts) AS ended, count(*)::BIGINT AS n_events, bool_or(event_type = 'error') AS e FROM events GROUP BY 1)
SELECT user_id AS request, started, (floor(epoch_us(ended) / 1000000.0) - floor(epoch_us(started) / 1000000.0))::BIGINT AS seconds, n_events, CASE WHEN last = 'error' THEN 'error' WHEN e THEN 'partial' WHEN last = 'view' THEN 'refusal' ELSE 'success' END AS outcome FROM l""")
def trace_outcomes(spark, table):
    return incremental.outcomes(table("events").select(F.col("user_id").alias("request"), "ts", "event_id", F.col("event_type").alias("kind")))


@query("""SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS attributes FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def allowed_attributes(spark, table):
    return table("events").select("event_id", incremental.allowed("props").alias("attributes")).where("attributes is not null")


@query("""WITH q AS (SELECT source, least(count(*), 7) AS quota FROM documents GROUP BY 1), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, source, r AS place FROM r JOIN q USING (source) WHERE r <= quota""")
def stratified_sample(spark, table):
    """Seven documents of each source, in the order of a seeded hash: the sampling operator of the evaluation set."""
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id")
    return table("documents").select("doc_id", "source", F.row_number().over(w).cast("long").alias("place")).where("place <= 7")


@query("""WITH RECURSIVE d AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) AS c FROM conversations),
s AS (SELECT conv_id, i, turn, c <= 300 AS fits, CASE WHEN c <= 300 THEN c ELSE 0 END AS used FROM d WHERE i = 1 UNION ALL SELECT d.conv_id, d.i, d.turn, s.used + d.c <= 300, CASE WHEN s.used + d.c <= 300 THEN s.used + d.c ELSE s.used END FROM s JOIN d ON d.conv_id = s.conv_id AND d.i = s.i + 1)
SELECT conv_id, turn FROM s WHERE fits""")
def contextual_fit(spark, table):
    """Every passage that still fits the budget, in order: one that does not is skipped, not the end."""
    listed = table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("c")))).alias("xs"))
    start = F.expr("cast(named_struct('used', 0, 'kept', array()) as struct<used:long,kept:array<long>>)")
    step = lambda s, x: F.when(s["used"] + x["c"] <= 300, F.struct((s["used"] + x["c"]).alias("used"), F.array_append(s["kept"], x["turn"]).alias("kept"))).otherwise(s)
    return listed.select("conv_id", F.explode(F.aggregate("xs", start, step, lambda s: s["kept"])).alias("turn"))


@query("""WITH t AS (SELECT p_type AS title, count(*)::BIGINT AS n, min(p_partkey) AS first FROM part GROUP BY 1), q AS (SELECT DISTINCT p_type || CASE WHEN p_size > 40 THEN ' x' ELSE '' END AS title FROM part)
SELECT q.title, coalesce(n, 0)::BIGINT AS n, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'unique' ELSE 'shared' END AS status FROM q LEFT JOIN t ON q.title = t.title""")
def title_index(spark, table):
    """Titles against the index from titles to documents: unknown, unique or shared."""
    part = table("part")
    index = part.groupBy(F.col("p_type").alias("title")).agg(F.count("*").alias("n"))
    asked = part.select(F.concat("p_type", F.when(F.col("p_size") > 40, " x").otherwise("")).alias("title")).distinct()
    status = F.when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "unique").otherwise("shared")
    return asked.join(index, "title", "left").select("title", F.coalesce("n", F.lit(0)).cast("long").alias("n"), status.alias("status"))


@query(f"""WITH {_LEX}, g AS (SELECT qid, doc_id % 50 AS document, min(rank) AS first, count(*)::BIGINT AS passages, max(score) AS top FROM lex GROUP BY ALL) SELECT qid, document, row_number() OVER (PARTITION BY qid ORDER BY first) AS rank, passages, round(top, 6) AS best FROM g""")
def documents_ranking(spark, table):
    """Documents in the order of their first passage, with their passages and best score."""
    g = _lexical(table).groupBy("qid", (F.col("doc_id") % 50).alias("document")).agg(F.min("rank").alias("first"), F.count("*").alias("passages"), F.round(F.max("score"), 6).alias("best"))
    return g.select("qid", "document", F.row_number().over(Window.partitionBy("qid").orderBy("first")).cast("long").alias("rank"), "passages", "best")


@query("""SELECT conv_id, turn, 'D' || dense_rank() OVER (ORDER BY conv_id) || 'S' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS citation FROM conversations""")
def multi_numbering(spark, table):
    """Citations D<k>S<j>: documents are numbered range by range, so no window holds all of them."""
    t = table("conversations").select("conv_id", "turn")
    docs = order.number(t.select("conv_id").distinct(), "conv_id", name="k")
    j = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.withColumn("j", j).join(docs, "conv_id").select("conv_id", "turn", F.concat(F.lit("D"), "k", F.lit("S"), "j").alias("citation"))


@query("""SELECT user_id, count(*)::BIGINT AS attempts, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value, arg_max(value, event_id) > arg_min(value, event_id) AS improved FROM events GROUP BY 1""")
def first_last_attempt(spark, table):
    first, last = F.min_by("value", "event_id"), F.max_by("value", "event_id")
    return table("events").groupBy("user_id").agg(F.count("*").alias("attempts"), first.alias("first_value"), last.alias("last_value"), (last > first).alias("improved"))


@query("""WITH n AS (SELECT c_mktsegment AS field, c_nationkey AS canonical, count(*) AS freq, count(DISTINCT c_name) AS variants FROM customer GROUP BY ALL)
SELECT field, count(*)::BIGINT AS canonicals, sum(variants)::BIGINT AS variants, sum(freq)::BIGINT AS occurrences, (count(*) FILTER (freq < 3))::BIGINT AS rare FROM n GROUP BY 1""")
def entity_stats(spark, table):
    n = table("customer").groupBy(F.col("c_mktsegment").alias("field"), F.col("c_nationkey").alias("canonical")).agg(F.count("*").alias("freq"), F.countDistinct("c_name").alias("variants"))
    return n.groupBy("field").agg(F.count("*").alias("canonicals"), F.sum("variants").alias("variants"), F.sum("freq").alias("occurrences"), F.count_if(F.col("freq") < 3).alias("rare"))


@query(f"""WITH {_LEX}, p AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), k AS (SELECT unnest([1, 3, 5, 10, 20]) AS k),
h AS (SELECT k, item_id, max(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM k, p LEFT JOIN lex l ON l.qid = p.item_id AND l.doc_id = p.doc_id AND l.rank <= k GROUP BY ALL), a AS (SELECT k, avg(hit) AS v FROM h GROUP BY 1)
SELECT k::INTEGER AS k, round(v, 6) AS hit_rate, round(v - (SELECT v FROM a WHERE k = 10), 4) AS delta FROM a""")
def ablation_table(spark, table):
    """Hit rate of lexical search at several cut-offs, and its difference to the reference row at ten. Gold documents hold the item's whole text: a document that does has all tokens of the item but the first and last, so only documents with the rarest of those are looked through; items of two tokens and fewer have none and are looked for everywhere."""
    items = table("benchmark").select("item_id", F.col("text").alias("item"), text.tokens(F.col("text")).alias("t"))
    docs = table("documents").select("doc_id", "text")
    inner = items.select("item_id", F.explode(F.slice("t", 2, F.greatest(F.size("t") - 2, F.lit(0)))).alias("token")).distinct()
    index = cut(postings.wanted(postings.of_texts(spread(docs)), inner))
    rare = inner.join(postings.frequencies(index), "token", "left").groupBy("item_id").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), F.col("token"))).alias("token"))
    meet = postings.holding(rare.select(F.col("item_id").alias("qid"), "token"), index)
    found = meet.select(F.col("qid").alias("item_id"), "doc_id").join(items.select("item_id", "item"), "item_id").join(docs, "doc_id")
    short = items.where(F.size("t") <= 2).select("item_id", "item").join(docs, F.contains("text", F.col("item")))
    gold = found.where(F.contains("text", F.col("item"))).select("item_id", "doc_id").unionByName(short.select("item_id", "doc_id")).distinct()
    ks = gold.select("item_id", "doc_id", F.explode(F.array(*map(F.lit, (1, 3, 5, 10, 20)))).alias("k"))
    ranked = _lexical(table).select(F.col("qid").alias("item_id"), "doc_id", "rank")
    hits = ks.join(ranked, ["item_id", "doc_id"], "left").groupBy("k", "item_id").agg(F.max(F.when(F.col("rank") <= F.col("k"), 1).otherwise(0)).alias("hit"))
    a = hits.groupBy("k").agg(F.avg("hit").alias("v"))
    reference = F.max(F.when(F.col("k") == 10, F.col("v"))).over(Window.partitionBy(F.lit(1)))
    return a.select("k", F.round("v", 6).alias("hit_rate"), F.round(F.col("v") - reference, 4).alias("delta"))


_NOUN = "[" + ", ".join(f"'{w}'" for w in resolve.PUBLICATION_WORDS) + "]"
_QUALIFIER = "[" + ", ".join(f"'{w}'" for w in resolve.PUBLICATION_QUALIFIERS) + "]"
_ABOUT = """CASE o_orderkey % 5 WHEN 0 THEN 'value ' || y || ' in the ' || (y + 1) || ' report' WHEN 1 THEN 'Rapport ' || y || ' et ' || (y - 1) WHEN 2 THEN y || ' annual financial statements of ' || o_orderpriority WHEN 3 THEN y || ' in the document' ELSE o_orderstatus || ' ' || y || ' consolidated interim final filing ' || y END"""


@query(f"""WITH o AS (SELECT *, year(o_orderdate)::BIGINT AS y FROM orders), t AS (SELECT o_orderkey, regexp_extract_all(strip_accents(lower({_ABOUT})), '[a-z0-9]+') AS t FROM o), p AS (SELECT o_orderkey, t, unnest(range(1, len(t) + 1)) AS i FROM t),
d AS (SELECT o_orderkey, t[i]::INTEGER AS y, coalesce(list_contains({_NOUN}, t[i - 1]) AND i > 1, false) OR coalesce(list_contains({_NOUN}, t[i + 1]), false) OR coalesce(list_contains({_QUALIFIER}, t[i + 1]) AND list_contains({_NOUN}, t[i + 2]), false) OR coalesce(list_contains({_QUALIFIER}, t[i + 1]) AND list_contains({_QUALIFIER}, t[i + 2]) AND list_contains({_NOUN}, t[i + 3]), false) AS dated FROM p WHERE regexp_matches(t[i], '^(19|20)[0-9][0-9]$'))
SELECT o_orderkey, coalesce(string_agg(DISTINCT y, ',' ORDER BY y) FILTER (dated), '') AS publication, coalesce(string_agg(DISTINCT y, ',' ORDER BY y) FILTER (NOT dated), '') AS named FROM d GROUP BY 1""")
def publication_years(spark, table):
    """Years of publication against years of values in a question about every order."""
    y = F.year("o_orderdate").cast("long")
    say = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    k, n = F.col("o_orderkey") % 5, (lambda c: c.cast("string"))
    about = (
        F.when(k == 0, say("value ", n(y), " in the ", n(y + 1), " report")).when(k == 1, say("Rapport ", n(y), " et ", n(y - 1))).when(k == 2, say(n(y), " annual financial statements of ", F.col("o_orderpriority")))
        .when(k == 3, say(n(y), " in the document")).otherwise(say(F.col("o_orderstatus"), " ", n(y), " consolidated interim final filing ", n(y)))
    )
    d = table("orders").select("o_orderkey", text.let(text.tokens(about), resolve.publication_years).alias("y"))
    return d.select("o_orderkey", F.array_join("y.publication", ",").alias("publication"), F.array_join("y.named", ",").alias("named"))


@query("""WITH c AS (SELECT url, regexp_extract(trim(url), '([^/]*)/*$', 1) AS name, page_id FROM pages), n AS (SELECT lower(name) AS k, count(DISTINCT page_id) AS n, min(page_id) AS page_id FROM c GROUP BY 1)
SELECT c.page_id AS qid, CASE WHEN n.n = 1 THEN 'exact' ELSE 'none' END AS status, CASE WHEN n.n = 1 THEN n.page_id END AS page_id FROM c JOIN n ON lower(c.name) = n.k""")
def identifier_fast_path(spark, table):
    """Questions that hold a page's file name between other words: exact if one page has it."""
    pages = table("pages").select("page_id", text.basename(F.col("url")).alias("name"))
    asked = pages.select(F.col("page_id").alias("qid"), F.concat(F.lit("What does « "), "name", F.lit(" » say?")).alias("text"))
    return resolve.verbatim(asked, pages.select(F.col("page_id").alias("doc_id"), F.col("name").alias("identifier"))).select("qid", "status", F.col("doc_id").alias("page_id"))
