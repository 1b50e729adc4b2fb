"""Lexical and dense search, rank fusion, diversification, context expansion."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..session import cut, ship, spread
from . import postings

#: Queries of a block, documents or points of a page: what one step of a search holds at once.
QUERY_BLOCK, PAGE = 64, 2048


def best(scored: DataFrame, k: int, by: str = "qid", score: str = "score", tie: str = "doc_id", rank: str = "rank") -> DataFrame:
    """The k highest of each query, ties by ``tie``; partial limits come before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), tie)
    return scored.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def term_counts(docs: DataFrame, key: str = "doc_id", column: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """(key, token, tf). With ``wanted`` (token) only these tokens, dropped before anything is shuffled."""
    toks = docs.select(key, F.explode(text.tokens(F.col(column))).alias("token"))
    if wanted is not None:
        toks = toks.join(wanted.select("token").distinct(), "token", "left_semi")
    return toks.groupBy(key, "token").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, n_docs: Column | int) -> DataFrame:
    """(token, df, idf) with idf = ln(1 + N / (1 + df))."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return counts.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + F.greatest(n, F.lit(1)) / (1 + F.col("df"))))


def packed(df: DataFrame, blob: str, pack, most: int) -> DataFrame:
    """df as blobs of at most ``most`` rows, made batch by batch without a shuffle; ``pack`` turns a record batch into what is pickled."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, most):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(pack(b.slice(s, most)))], pa.binary())], [blob])

    return df.mapInArrow(run, f"{blob} binary")


def meet(pages: DataFrame, blocks: DataFrame, score, schema: str) -> DataFrame:
    """``score`` (a page's and a block's content to columns) for every page and block. Blocks of a stated query set against all rows: the planner sends the blocks to the pages where they are small, and else pairs partitions."""

    def run(batches):
        for b in batches:
            # One pair at a time is taken out of the batch, in which each holds a page and a block.
            for x, y in zip(b.column("page"), b.column("block"), strict=True):
                got = score(pickle.loads(x.as_buffer()), pickle.loads(y.as_buffer()))
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return pages.crossJoin(blocks).mapInArrow(run, schema)


def by_words(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, units): the k documents of most units for each query (at least) and shard; asked (qid, token, units) are the distinct tokens of queries with whole weights. docs is read once, into an inverted index of which only the asked tokens travel."""
    return postings.search(asked, postings.of_texts(docs), k)


def weights(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(token, units): the idf of the asked tokens, ln(1 + N / (1 + df)), in billionths."""
    n = postings.size(index).scalar()
    df = postings.frequencies(index).join(asked.select("token").distinct(), "token", "left_semi")
    return df.select("token", F.round(F.log(1 + F.greatest(n, F.lit(1)) / (1 + F.col("df"))) * 1e9).cast("long").alias("units"))


def lexical(queries: DataFrame, docs: DataFrame, k: int = 20, index: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): sum of the idf of the distinct query tokens that a document has; idf = ln(1 + N / (1 + df)). With a kept ``index`` of the documents (``postings``) they are not read at all; else one is made, of which the asked tokens' postings are written once."""
    asked = queries.select("qid", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token"))
    if index is None:
        index = cut(postings.wanted(postings.of_texts(spread(docs.select("doc_id", "text"))), asked))
    found = postings.search(asked.join(weights(index, asked), "token"), index, k)
    return best(found.select("qid", "doc_id", (F.col("units") / 1e9).alias("score")), k)


def apart(squares, product):
    """Euclidean distances from sums of squared lengths and inner products; what lies within the rounding of that difference is nought, so that equal vectors tie."""
    d = squares - 2 * product
    return np.sqrt(np.where(d <= 1e-12 * squares, 0, d))


def dense(queries: DataFrame, points: DataFrame, k: int = 20, metric: str = "cosine") -> DataFrame:
    """(qid, doc_id, score, rank): exact nearest points by cosine, dot or euclid (negative distance); scores round to nine places, ties by doc_id.

    Queries (qid, vector) in blocks meet points (doc_id, vector) in pages, each pair in one matrix product; k rows a query leave a page. Only vectors of one dimension are compared; null vectors take no part.
    """
    ship(points.sparkSession)

    def pack(b: pa.RecordBatch):
        """Ids and matrix for each dimension."""
        by: dict[int, list[int]] = {}
        vectors = b.column("vector").to_pylist()
        for i, v in enumerate(vectors):
            if v is not None and None not in v:
                by.setdefault(len(v), []).append(i)
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64) if by else None
        return {d: (ids[rows], np.array([vectors[i] for i in rows], np.float64).reshape(len(rows), d)) for d, rows in by.items()}

    def score(page, block):
        out = [[], [], []]
        for d, (qids, q) in block.items():
            if d not in page:
                continue
            ids, p = page[d]
            lengths = np.linalg.norm(p, axis=1)[None]
            for at in range(0, len(qids), QUERY_BLOCK):
                some, names = q[at : at + QUERY_BLOCK], qids[at : at + QUERY_BLOCK]
                s = some @ p.T
                if metric == "cosine":
                    norm = np.linalg.norm(some, axis=1)[:, None] * lengths
                    s = np.divide(s, norm, out=np.zeros_like(s), where=norm > 0)
                elif metric == "euclid":
                    s = -apart((some * some).sum(1)[:, None] + (p * p).sum(1)[None], s)
                s = np.round(s, 9) + 0.0
                top = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                row = np.repeat(np.arange(len(names)), top.shape[1])
                for o, x in zip(out, (names[row], ids[top.ravel()], s[row, top.ravel()]), strict=True):
                    o.append(x)
        return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]

    blocks = packed(queries.where("vector is not null").select("qid", "vector"), "block", pack, QUERY_BLOCK * 16)
    pages = packed(points.select("doc_id", "vector"), "page", pack, PAGE)
    return best(meet(pages, blocks, score, "qid long, doc_id long, score double"), k)


def sparse(queries: DataFrame, points: DataFrame, k: int = 20, index: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): nearest points by the dot product of sparse vectors (structs of indices and values, column sparse), where it is positive; a vector has an index once. A kept ``index`` of the points (``postings.of_vectors``) stands in for them. Repeated doc_ids are documents of their own."""
    asked = queries.select("qid", F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("x")).select("qid", F.col("x.indices").cast("string").alias("token"), F.col("x.values").cast("double").alias("score"))
    if index is not None:
        return best(postings.search(asked, index, k, weight="score", whole=False), k)
    # Points without an index meet questions by their terms, not by shards: shards times questions would grow with the square of the rows even where few share a term.
    same = Window.partitionBy("doc_id").orderBy(F.xxhash64("sparse"))
    numbered = points.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "sparse").withColumn("nth", F.row_number().over(same))
    held = numbered.select("doc_id", "nth", F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("x")).select("doc_id", "nth", F.col("x.indices").cast("string").alias("token"), F.col("x.values").cast("double").alias("value"))
    found = asked.join(held, "token").groupBy("qid", "doc_id", "nth").agg(F.sum(F.col("score") * F.col("value")).alias("score"))
    return best(found.where("score > 0").drop("nth"), k)


def rrf(*lists: DataFrame, k: int = 60, limit: int = 6) -> DataFrame:
    """(qid, doc_id, score, rank): reciprocal rank fusion, sum of 1 / (k + rank) over the lists; a document counts once a list."""
    both = lists[0].select("qid", "doc_id", "rank")
    for x in lists[1:]:
        both = both.unionByName(x.select("qid", "doc_id", "rank"))
    fused = both.groupBy("qid", "doc_id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"))
    return best(fused, limit)


def rerank(candidates: DataFrame, score: Column, limit: int | None = None, threshold: float | None = None) -> DataFrame:
    """Candidates in the order of a second score, the first rank breaking ties; below the threshold they go."""
    scored = candidates.withColumn("rerank_score", score)
    if threshold is not None:
        scored = scored.where(F.col("rerank_score") >= threshold)
    w = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), "rank")
    out = scored.withColumn("new_rank", F.row_number().over(w).cast("long"))
    return out.where(F.col("new_rank") <= limit) if limit else out


def lexical_overlap(query: Column, passage: Column) -> Column:
    """Offline stand-in for a reranking model: part of the query's bearing tokens that the passage has."""
    return F.round(arrays.share(text.bearing_tokens(query), text.eval_tokens(passage)), 6)


def candidate_budget(top_k: int) -> int:
    """Candidates to fetch for top_k passages: four times as many, 20 at least, 100 at most."""
    return max(top_k, min(100, max(4 * top_k, 20)))


def diversify(ranked: DataFrame, per_document: int | Column = 3, limit: int = 6) -> DataFrame:
    """Greedy in the order of rank, for each query (``per_document`` may differ by row): empty texts and texts equal to a retained one are skipped, then documents that are full; a text skipped for a full document does not count as retained. Stops at ``limit``. Candidates of a query are at most a hundred."""
    prints = ranked.withColumn("print", text.fingerprint(F.col("text")))
    state = "struct<kept:array<long>,prints:array<string>,docs:array<long>>"
    most = per_document if isinstance(per_document, Column) else F.lit(per_document)
    items = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "print", (F.trim("text") != "").alias("full"), most.alias("most"))))
    start = F.expr(f"cast(named_struct('kept', array(), 'prints', array(), 'docs', array()) as {state})")

    def step(s, x):
        take = x["full"] & ~F.array_contains(s["prints"], x["print"]) & (F.size(F.filter(s["docs"], lambda d: d == x["doc_id"])) < x["most"]) & (F.size(s["kept"]) < limit)
        return F.when(
            F.coalesce(take, F.lit(False)),
            F.struct(F.array_append(s["kept"], x["rank"]).alias("kept"), F.array_append(s["prints"], x["print"]).alias("prints"), F.array_append(s["docs"], x["doc_id"]).alias("docs")),
        ).otherwise(s)

    kept = prints.groupBy("qid").agg(F.aggregate(items, start, step).alias("s")).select("qid", F.posexplode("s.kept").alias("pos", "rank"))
    return ranked.join(kept.select("qid", "rank", (F.col("pos") + 1).cast("long").alias("place")), ["qid", "rank"])


def neighbours(chunks: DataFrame, hits: DataFrame, radius: int = 1) -> DataFrame:
    """(qid, doc_id, chunk_index, text): chunks within the radius of a hit in its document, hits themselves left out. An equi-join on document and exploded index, so no band join is needed."""
    near = hits.select("qid", "doc_id", F.explode(F.sequence(F.greatest(F.col("chunk_index") - radius, F.lit(0)), F.col("chunk_index") + radius)).alias("chunk_index")).distinct()
    return near.join(hits.select("qid", "doc_id", "chunk_index"), ["qid", "doc_id", "chunk_index"], "left_anti").join(chunks, ["doc_id", "chunk_index"])


def expand(hits: pd.DataFrame, chunks: pd.DataFrame, radius: int = 1, most: int = 6, budget: int = 12_000) -> pd.DataFrame:
    """One query's hits (rank, doc_id, chunk_index, parent_id, text) with their context put in right behind them: all chunks of a hit's parent, once a parent, else neighbours; at most ``most`` chunks and ``budget`` characters in all, a hit's additions end at the first that does not fit."""
    have = set(zip(hits.doc_id, hits.chunk_index, strict=True))
    left, added, seen, out = budget - int(hits.text.str.len().sum()), 0, set(), []
    for h in hits.sort_values("rank").itertuples():
        out.append((h.doc_id, h.chunk_index, h.text, False))
        if added >= most or left <= 0:
            continue
        own = chunks[chunks.doc_id == h.doc_id]
        if h.parent_id is not None and h.parent_id == h.parent_id:
            if (h.doc_id, h.parent_id) in seen:
                continue
            seen.add((h.doc_id, h.parent_id))
            own = own[own.parent_id == h.parent_id]
        else:
            own = own[(own.chunk_index - h.chunk_index).abs() <= radius]
        for c in own.sort_values("chunk_index").itertuples():
            if (c.doc_id, c.chunk_index) in have:
                continue
            if added >= most or len(c.text) > left:
                break
            out.append((c.doc_id, c.chunk_index, c.text, True))
            have.add((c.doc_id, c.chunk_index))
            left -= len(c.text)
            added += 1
    return pd.DataFrame(out, columns=["doc_id", "chunk_index", "text", "added"])


def expand_context(hits: DataFrame, chunks: DataFrame, radius: int = 1, most: int = 6, budget: int = 12_000) -> DataFrame:
    """(qid, place, doc_id, chunk_index, added, n_chars): ``expand`` for every query, each with the chunks of its own documents only."""
    ship(hits.sparkSession)
    anew = lambda d: d.select(*(F.col(c).alias(c) for c in d.columns))  # noqa: E731  hits may come from the chunks, so columns get identities of their own
    hits, chunks = anew(hits), anew(chunks)
    wanted = anew(chunks.join(anew(hits.select("qid", "doc_id").distinct()), "doc_id"))

    def run(key, h: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(h):
            return pd.DataFrame({"qid": [], "place": [], "doc_id": [], "chunk_index": [], "added": [], "n_chars": []})
        e = expand(h, c, radius, most, budget)
        return pd.DataFrame({"qid": key[0], "place": np.arange(1, len(e) + 1), "doc_id": e.doc_id, "chunk_index": e.chunk_index, "added": e.added, "n_chars": e.text.str.len()})

    return hits.groupBy("qid").cogroup(wanted.groupBy("qid")).applyInPandas(run, "qid long, place long, doc_id long, chunk_index long, added boolean, n_chars long")


def absence_reason(perimeter: Column, candidates: Column, kept: Column) -> Column:
    """Why a search has no passage: nothing in the perimeter, no candidate, nothing kept; null if it has some."""
    return F.when(kept > 0, F.lit(None).cast("string")).when((candidates == 0) & perimeter, "perimeter_without_passage").when(candidates == 0, "no_candidate").otherwise("no_passage_kept")


def check_dimensions(points: DataFrame, column: str = "vector") -> DataFrame:
    """(dimension, n): how many vectors of each dimension there are; a sound table has one row."""
    return points.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("dimension")).agg(F.count("*").alias("n"))


def in_perimeter(hits: DataFrame, perimeter: DataFrame) -> DataFrame:
    """Hits whose document is in the query's perimeter (qid, doc_id); queries without a perimeter are not restricted."""
    bound = perimeter.select("qid").distinct().withColumn("bound", F.lit(True))
    inside = perimeter.select("qid", "doc_id").distinct().withColumn("inside", F.lit(True))
    return hits.join(bound, "qid", "left").join(inside, ["qid", "doc_id"], "left").where(F.col("bound").isNull() | F.col("inside")).drop("bound", "inside")


def narrow_by_year(cards: DataFrame, years: Column) -> DataFrame:
    """Cards (qid, doc_id, card_years) whose years meet the question's; a question for which none does keeps all of its cards."""
    marked = cards.withColumn("meets", F.arrays_overlap("card_years", years))
    any_ = F.max(F.coalesce("meets", F.lit(False))).over(Window.partitionBy("qid"))
    return marked.withColumn("any_", any_).where(F.col("meets") | ~F.col("any_")).drop("meets", "any_")


def source_block(citation: Column, label: Column, page: Column, body: Column) -> Column:
    """A passage as it enters a context: citation, document and page on the first line, then its text."""
    return F.concat(F.lit("["), citation, F.lit("] "), F.coalesce(label, F.lit("unknown source")), F.lit(", page "), F.coalesce(page.cast("string"), F.lit("unknown")), F.lit("\n"), F.trim(body))
