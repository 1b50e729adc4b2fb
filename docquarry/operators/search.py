"""The whole search: filters, perimeter, hybrid candidates, guard, reranking, threshold, diversity, context, citations, and why a question has no passage.

All questions of a batch go together. Questions whose perimeter binds are scored against the passages of their documents alone; the others against all passages, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut, spread
from . import filters, perimeter, postings, retrieval

#: Least score of a passage for an answer, and the default threshold of a reranked passage.
LEAST, THRESHOLD = 0.15, 0.30
NOTHING = "qid long, doc_id long, score double, rank long"


def _bound_pairs(questions: DataFrame, chunks: DataFrame, bounds: DataFrame) -> DataFrame:
    """Questions with a binding perimeter against the passages of their documents: (qid, point)."""
    values = bounds.join(questions.select("qid"), "qid").select("qid", "field", F.explode("values").alias("value"))
    out = None
    for c in filters.SCOPE:
        if c in chunks.columns:
            part = values.where(F.col("field") == c).join(chunks.select(F.trim(F.col(c).cast("string")).alias("value"), "point"), "value").select("qid", "point")
            out = part if out is None else out.unionByName(part)
    return out.distinct()


def lexical_candidates(questions: DataFrame, chunks: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank) of passages (doc_id holds their point): idf sums of the question's tokens, over the perimeter where one binds. Weights come from all passages, so they do not depend on the perimeter."""
    docs = spread(chunks.select(F.col("point").alias("doc_id"), "text"))
    asked = questions.select("qid", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token"))
    index = cut(postings.wanted(postings.of_texts(docs), asked))
    weighted = asked.join(retrieval.weights(index, asked), "token")
    free = weighted.join(bounds.select("qid"), "qid", "left_anti")
    found = postings.search(free, index, k)
    pairs = _bound_pairs(questions, chunks, bounds)
    own = pairs.join(chunks.select("point", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token")), "point").join(weighted, ["qid", "token"])
    inside = own.groupBy("qid", F.col("point").alias("doc_id")).agg(F.sum("units").alias("units"))
    return retrieval.best(found.unionByName(inside).select("qid", "doc_id", (F.col("units") / 1e9).alias("score")), k)


def dense_candidates(questions: DataFrame, chunks: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank) by cosine, over the perimeter where one binds."""
    from ..functions import arrays

    points = chunks.select(F.col("point").alias("doc_id"), "vector")
    free = retrieval.dense(questions.join(bounds.select("qid"), "qid", "left_anti").select("qid", "vector"), points, k)
    pairs = _bound_pairs(questions, chunks, bounds).withColumnRenamed("point", "doc_id").join(points, "doc_id").join(questions.select("qid", F.col("vector").alias("asked")), "qid")
    inside = pairs.where("vector is not null and asked is not null").select("qid", "doc_id", F.round(arrays.cosine(F.col("asked"), F.col("vector")), 9).alias("score"))
    return retrieval.best(free.select("qid", "doc_id", "score").unionByName(inside), k)


def found(live: DataFrame, chunks: DataFrame, binding: DataFrame, want: int, fusion: int = 60, lexical: bool = True) -> DataFrame:
    """First stage: the ``want`` best candidates of questions (qid, text, vector) by the lists there are, fused by rank, with their passages' columns and within, the values of the perimeter."""
    lists = []
    if lexical and "text" in chunks.columns:
        lists.append(lexical_candidates(live, chunks, binding, want))
    if "vector" in chunks.columns and "vector" in live.columns:
        lists.append(dense_candidates(live, chunks, binding, want))
    fused = retrieval.rrf(*lists, k=fusion, limit=want).select("qid", F.col("doc_id").alias("point"), "rank")
    hits = fused.join(chunks, "point")
    # The guard stays even though candidates came from the perimeter: a passage of another document must never pass.
    identity = [F.col(c) for c in filters.SCOPE if c in chunks.columns]
    # Cut: at most a hundred rows a question, which all that follows starts from.
    return cut(hits.join(binding.select("qid", F.col("values").alias("within")), "qid", "left").where(F.col("within").isNull() | ~perimeter.outside(F.col("within"), *identity)))


def ranked(guarded: DataFrame, asked: DataFrame, score: Callable[[Column, Column], Column] | None, threshold: float | None) -> DataFrame:
    """Second stage: candidates in the order of a second score, those below its threshold gone; without a score in the order of fusion."""
    if score is None:
        return guarded.withColumn("rerank_score", F.lit(None).cast("double"))
    both = guarded.join(asked.select("qid", F.col("text").alias("question")), "qid")
    return retrieval.rerank(both, score(F.col("question"), F.col("text")), None, threshold).drop("rank").withColumnRenamed("new_rank", "rank")


def kept(ranked_: DataFrame, chunks: DataFrame, top_k: int, per_document: int) -> DataFrame:
    """Third stage: the first ``top_k`` passages without repetition, ``per_document`` of a document at most; a perimeter of one document lifts that."""
    single = F.coalesce(F.size("within") == 1, F.lit(False))
    got = retrieval.diversify(ranked_, F.when(single, top_k).otherwise(per_document), top_k)
    return got.select("qid", F.col("place").alias("rank"), "point", "doc_id", "chunk_index", F.col("text"), F.col("rerank_score").alias("score"), *(["parent_id"] if "parent_id" in chunks.columns else []))


def expanded(passages: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """Fourth stage: the passages' neighbours beside them, in a new order; added tells them apart."""
    parent = [] if "parent_id" in chunks.columns else [F.lit(None).cast("string").alias("parent_id")]
    all_chunks = chunks.select("doc_id", "chunk_index", "text", *(parent or ["parent_id"]))
    wide = retrieval.expand_context(passages.select("qid", "rank", "doc_id", "chunk_index", "text", *(parent or ["parent_id"])), all_chunks, radius)
    at = wide.select("qid", F.col("place").alias("rank"), "doc_id", "chunk_index", "added").join(chunks.select("point", "doc_id", "chunk_index", "text"), ["doc_id", "chunk_index"])
    return at.join(passages.select("qid", "point", "score"), ["qid", "point"], "left")


def search(
    questions: DataFrame,
    chunks: DataFrame,
    criteria: dict | None = None,
    profile: filters.Profile | None = None,
    bounds: DataFrame | None = None,
    top_k: int = 6,
    candidates: int | None = None,
    score: Callable[[Column, Column], Column] | None = retrieval.lexical_overlap,
    threshold: float | None = None,
    per_document: int = 3,
    radius: int = 1,
    expand: bool = True,
    fusion: int = 60,
) -> tuple[DataFrame, DataFrame]:
    """(passages, report).

    questions (qid, text, and vector for dense search); chunks (point, doc_id, chunk_index, text, and as far as there are file_name, source, parent_id, vector and columns that criteria name); bounds are perimeters as ``perimeter`` makes them: exact and compatible ones bind, others do not, and an unknown one finds nothing.
    ``fusion`` is the constant of rank fusion. ``score`` reranks (None keeps the order of fusion; the threshold belongs to the reranked score alone). A perimeter of one document lifts the limit of passages a document.
    passages: (qid, rank, citation, point, doc_id, chunk_index, text, score, added). report: (qid, status, n_candidates, n_passages, reason): reason is null, perimeter_without_passage, no_candidate or no_passage_kept. An empty question has the status empty_question. Nothing is searched again without a perimeter that gave nothing.
    """
    if top_k < 1 or per_document < 1:
        raise ValueError("top_k and per_document must be positive")
    spark = questions.sparkSession
    want = candidates or retrieval.candidate_budget(top_k)
    want = max(top_k, min(want, 100))
    asked = questions.withColumn("text", text.collapse(F.coalesce(F.col("text"), F.lit(""))))
    usable = asked.where("text != ''")
    if criteria:
        chunks = filters.select(chunks, filters.normalize(spark, criteria, profile or filters.Profile({})), None)
    none = spark.createDataFrame([], "qid long, status string, field string, values array<string>, labels array<string>, origin string")
    bounds = none if bounds is None else bounds
    binding = bounds.where(F.col("status").isin("exact", "compatible"))
    dead = bounds.where("status = 'unknown'").select("qid")
    live = usable.join(dead, "qid", "left_anti")

    guarded = found(live, chunks, binding, want, fusion)
    passages = kept(ranked(guarded, asked, score, threshold), chunks, top_k, per_document)
    passages = expanded(passages, chunks, radius) if expand else passages.withColumn("added", F.lit(False))
    passages = cut(passages).select("qid", "rank", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("citation"), "point", "doc_id", "chunk_index", "text", "score", "added")

    n_candidates = guarded.groupBy("qid").agg(F.count("*").alias("n_candidates"))
    n_passages = passages.groupBy("qid").agg(F.count("*").alias("n_passages"))
    got = asked.select("qid", "text").join(n_candidates, "qid", "left").join(n_passages, "qid", "left").join(bounds.select("qid", "status"), "qid", "left")
    c, p = F.coalesce("n_candidates", F.lit(0)).cast("long"), F.coalesce("n_passages", F.lit(0)).cast("long")
    bound = F.coalesce(F.col("status").isin("exact", "compatible", "unknown"), F.lit(False))
    reason = F.when(p > 0, F.lit(None).cast("string")).when(bound, "perimeter_without_passage").when(c == 0, "no_candidate").otherwise("no_passage_kept")
    status = F.when(F.col("text") == "", "empty_question").otherwise(F.coalesce("status", F.lit("none")))
    return passages, got.select("qid", status.alias("status"), c.alias("n_candidates"), p.alias("n_passages"), F.when(F.col("text") != "", reason).alias("reason"))


def check_context(passages: DataFrame, report: DataFrame, bounds: DataFrame | None = None, minimum: int = 1) -> DataFrame:
    """(qid, sufficient, reason, n_passages, n_documents, n_outside, best, warning): whether what a search found can carry an answer: passages with a text, inside the perimeter, as many as the minimum. A single document with several passages is a warning unless one was asked for."""
    inside = passages.withColumn("inside", F.lit(True))
    single = F.lit(False)
    if bounds is not None:
        binding = bounds.where(F.col("status").isin("exact", "compatible")).select("qid", F.col("values").alias("within"))
        inside = passages.join(binding, "qid", "left").withColumn("inside", F.col("within").isNull() | ~perimeter.outside(F.col("within"), F.col("doc_id")))
        single = F.coalesce(F.max(F.size("within")) == 1, F.lit(False))
    full = F.trim("text") != ""
    ok = full & F.col("inside")
    g = inside.groupBy("qid").agg(F.count_if(ok).alias("n"), F.count_if(full & ~F.col("inside")).alias("outside"), F.countDistinct(F.when(ok, F.col("doc_id"))).alias("documents"), F.max(F.when(ok, F.col("score"))).alias("best"), single.alias("single"))
    got = report.select("qid", F.col("reason").alias("absence")).join(g, "qid", "left")
    n, out = F.coalesce("n", F.lit(0)), F.coalesce("outside", F.lit(0))
    reason = F.when(F.col("n").isNull(), F.coalesce("absence", F.lit("no_passage"))).when((n == 0) & (out > 0), "outside_perimeter").when(n < minimum, "too_few_passages")
    warning = F.when(out > 0, "passages_outside_perimeter").when((F.col("documents") == 1) & (n > 1) & ~F.col("single"), "one_document_only")
    return got.select("qid", reason.isNull().alias("sufficient"), reason.alias("reason"), n.cast("long").alias("n_passages"), F.coalesce("documents", F.lit(0)).cast("long").alias("n_documents"), out.cast("long").alias("n_outside"), "best", F.when(reason.isNull(), warning).alias("warning"))


def check_citations(answers: DataFrame, passages: DataFrame, bounds: DataFrame | None = None, required: bool = True) -> DataFrame:
    """(qid, valid, citations, unknown, outside): citations of answers (qid, answer) against the passages (qid, citation, doc_id): known, inside the perimeter, and some at all if required."""
    cited = answers.select("qid", "answer", text.citations(F.col("answer")).alias("citations"))
    each = cited.select("qid", F.posexplode("citations").alias("pos", "citation"))
    known = each.join(passages.select("qid", "citation", "doc_id"), ["qid", "citation"], "left")
    away = F.lit(False)
    if bounds is not None:
        binding = bounds.where(F.col("status").isin("exact", "compatible")).select("qid", F.col("values").alias("within"))
        known = known.join(binding, "qid", "left")
        away = F.col("doc_id").isNotNull() & F.col("within").isNotNull() & perimeter.outside(F.col("within"), F.col("doc_id"))
    order = lambda bad: F.transform(F.array_sort(F.collect_list(F.when(bad, F.struct("pos", "citation")))), lambda x: x["citation"])
    bad = known.groupBy("qid").agg(order(F.col("doc_id").isNull()).alias("unknown"), order(away).alias("outside"))
    none = F.array().cast("array<string>")
    got = cited.join(bad, "qid", "left").select("qid", F.coalesce("citations", none).alias("citations"), F.coalesce("unknown", none).alias("unknown"), F.coalesce("outside", none).alias("outside"))
    valid = (F.size("unknown") == 0) & (F.size("outside") == 0) & ((F.size("citations") > 0) | F.lit(not required))
    return got.select("qid", valid.alias("valid"), "citations", "unknown", "outside")


def in_order(chunks: DataFrame) -> DataFrame:
    """chunks with place and citation in the order of their document: by chunk_index, those without one last, by point."""
    w = Window.partitionBy("doc_id").orderBy(F.col("chunk_index").asc_nulls_last(), "point")
    return chunks.withColumn("place", F.row_number().over(w).cast("long")).withColumn("citation", F.concat(F.lit("S"), F.col("place").cast("string")))


def load_documents(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whole documents (wanted: doc_id), each numbered by itself."""
    return in_order(chunks.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"))
