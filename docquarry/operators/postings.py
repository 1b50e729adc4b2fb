"""An inverted index in shards of documents, whose blocks know their greatest impact, and exact top-k search that skips blocks.

A shard holds the postings of some thousands of documents, made by the task that reads them: building shuffles nothing, appending adds shards, and one row (shard, term) has places, values and the least and greatest value of each block of 128 places. A search takes the rows of the terms that are asked for, nothing else; rows meet the questions of a block of questions in the group of their shard. There each question adds up the impacts of its terms by block into an upper bound, visits blocks from the highest bound on, scores them exactly, and stops when the next bound is below its k-th score; ties go to the smaller doc_id, so a bound equal to it is still visited.

Texts without tokens and null vectors take part without being found. Repeated doc_ids are documents of their own. A question without terms finds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import ship

#: Documents of a shard, tokens of a shard, places of a block, questions of a block, rows that are taken out of an Arrow batch at once. A task holds one shard and one such slice, whatever it reads.
SHARD, TOKENS, BLOCK, QUESTIONS, SLICE = 16_384, 1 << 19, 128, 1024, 256
SCHEMA = "shard string, term string, n long, places binary, values binary, highs binary, lows binary"


def _shard(name: str, ids: list, codes: list[np.ndarray], values: list[np.ndarray] | None, terms: list[str]) -> pa.RecordBatch:
    """The rows of a shard, sorted by term; the empty term has the doc_ids."""
    lengths = np.array([len(c) for c in codes], np.int64)
    place = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    rank = np.empty(len(terms), np.int32)
    rank[np.argsort(np.array(terms, dtype=object), kind="stable")] = np.arange(len(terms), dtype=np.int32)
    ranked = rank[code]
    order = np.argsort(ranked, kind="stable")  # places ascend already
    place, sorted_rank = place[order], ranked[order].astype(np.int64)
    value = np.concatenate(values)[order] if values else place
    starts = np.flatnonzero(np.diff(sorted_rank, prepend=-1))
    ends = np.append(starts[1:], len(place))
    block = sorted_rank * (len(ids) // BLOCK + 1) + place // BLOCK
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    highs, lows = (f.reduceat(value, heads) if values and len(heads) else value for f in (np.maximum, np.minimum))
    cut = np.searchsorted(heads, np.append(starts, len(place)))
    names = sorted(terms)
    held = np.unique(sorted_rank)
    cols = [[name] * (len(starts) + 1), ["", *(names[i] for i in held)], [len(ids)], [np.array(ids, np.int64).tobytes()], [b""], [b""], [b""]]
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        cols[2].append(e - s)
        cols[3].append(place[s:e].tobytes())
        cols[4].append(value[s:e].tobytes() if values else b"")
        cols[5].append(highs[cut[i] : cut[i + 1]].tobytes() if values else b"")
        cols[6].append(lows[cut[i] : cut[i + 1]].tobytes() if values else b"")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), *[pa.binary()] * 4), strict=True)], SCHEMA.replace(",", "").split(" ")[::2])


def _build(rows: DataFrame, terms_of: Callable, weighted: bool) -> DataFrame:
    """``terms_of`` gives of a batch each row's (terms, values); a document has a term once. Shards are named by their task, so an index that is not kept must be read in one branch of a plan."""
    ship(rows.sparkSession)
    build = uuid.uuid4().hex

    def run(batches):
        context, n = TaskContext.get(), 0
        part = context.partitionId() if context else 0
        ids, codes, values, number = [], [], [], {}
        size = 0
        slices = (b.slice(s, SLICE) for b in batches for s in range(0, b.num_rows, SLICE))
        for b in slices:
            for i, (terms, weights) in zip(b.column(0).to_pylist(), terms_of(b), strict=True):
                ids.append(i if i is not None else -1)
                codes.append(np.fromiter((number.setdefault(t, len(number)) for t in terms), np.int32, len(terms)))
                if weighted:
                    values.append(np.asarray(weights, np.float64))
                size += len(terms)
                if len(ids) >= SHARD or size >= TOKENS:
                    yield _shard(f"{build}-{part}-{n}", ids, codes, values if weighted else None, list(number))
                    ids, codes, values, number, size, n = [], [], [], {}, 0, n + 1
        if ids:
            yield _shard(f"{build}-{part}-{n}", ids, codes, values if weighted else None, list(number))

    return rows.mapInArrow(run, SCHEMA)


def of_texts(docs: DataFrame) -> DataFrame:
    """The index of documents (doc_id, text): which tokens each has."""
    return _build(docs.select("doc_id", "text"), lambda b: (((list(dict.fromkeys(text.tokens_of(t)))), None) for t in b.column(1).to_pylist()), False)


def of_vectors(points: DataFrame) -> DataFrame:
    """The index of sparse vectors (doc_id, sparse: indices and values)."""

    def terms(b):
        for v in b.column(1).to_pylist():
            at = dict(zip(v["indices"], v["values"], strict=True)) if v else {}
            yield list(map(str, at)), list(at.values())

    return _build(points.select("doc_id", "sparse"), terms, True)


def write(index: DataFrame, path: str, append: bool = False) -> None:
    """Keep an index, or add shards to one that is kept."""
    index.write.mode("append" if append else "errorifexists").parquet(path)


def open_(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def wanted(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of the index that terms (token) ask for, and each shard's doc_ids."""
    asked = terms.select(F.col("token").cast("string").alias("term"))
    ids = index.sparkSession.range(1).select(F.lit("").alias("term"))
    return index.join(asked.unionByName(ids).distinct(), "term", "left_semi").select(index.columns)


def frequencies(index: DataFrame) -> DataFrame:
    """(token, df)."""
    return index.where("term != ''").groupBy(F.col("term").alias("token")).agg(F.sum("n").alias("df"))


def size(index: DataFrame) -> DataFrame:
    """One row n: the documents."""
    return index.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


class Lists:
    """The postings of a shard's wanted terms."""

    def __init__(self, d: pd.DataFrame):
        self.ids = np.zeros(0, np.int64)
        self.terms: dict[str, tuple] = {}
        for r in d.itertuples():
            if not r.term:
                self.ids = np.frombuffer(r.places, np.int64)
                continue
            place = np.frombuffer(r.places, np.int32)
            value = np.frombuffer(r.values, np.float64) if r.values else None
            block = place // BLOCK
            heads = np.flatnonzero(np.diff(block, prepend=-1))
            high = np.frombuffer(r.highs, np.float64) if r.values else None
            low = np.frombuffer(r.lows, np.float64) if r.values else None
            self.terms[r.term] = (place, value, block[heads], np.append(heads, len(place)), high, low)

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    def top(self, asked: list[tuple[str, float]], k: int, whole: bool) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(places, scores, blocks visited, blocks with a term) of the k best; ``whole`` weights are integers and scores exact."""
        lists = [(w, self.terms[t]) for t, w in asked if t in self.terms]
        kind = np.int64 if whole else np.float64
        bound, touched = np.zeros(self.blocks, kind), np.zeros(self.blocks, bool)
        for w, (_, _, block, _, high, low) in lists:
            bound[block] += np.maximum(0, np.maximum(w * high, w * low)) if high is not None else max(w, 0)
            touched[block] = True
        have = np.flatnonzero(touched)
        order = have[np.argsort(-bound[have], kind="stable")]
        slack = 0 if whole else 1e-9
        places, scores = np.zeros(0, np.int64), np.zeros(0, kind)
        done, step, least = 0, 8, None
        while done < len(order):
            if least is not None:
                ahead = bound[order[done:]] * (1 + slack) >= least
                if not ahead[0]:
                    break
            some = np.sort(order[done : done + step])
            done, step = done + len(some), step * 2
            held = np.zeros(len(some) * BLOCK, kind)
            seen = np.zeros(len(some) * BLOCK, bool)
            for w, (place, value, block, heads, _, _) in lists:
                at = np.searchsorted(block, some)
                ok = (at < len(block)) & (block[np.minimum(at, len(block) - 1)] == some)
                if not ok.any():
                    continue
                take = np.concatenate([np.arange(heads[i], heads[i + 1]) for i in at[ok]])
                slot = np.searchsorted(some, place[take] // BLOCK) * BLOCK + place[take] % BLOCK
                held[slot] += w * (value[take] if value is not None else 1)
                seen[slot] = True
            slot = np.flatnonzero(seen & (held > 0))
            places = np.concatenate((places, some[slot // BLOCK] * BLOCK + slot % BLOCK))
            scores = np.concatenate((scores, held[slot]))
            if len(scores) > k:
                keep = np.lexsort((self.ids[places], -scores))[:k]
                places, scores = places[keep], scores[keep]
            if len(scores) == k:
                least = scores.min()
        return places, scores, done, len(have)


def _meet(asked: DataFrame, index: DataFrame, weight: str, run: Callable, schema: str) -> DataFrame:
    """``run`` over each shard's wanted postings and a block of questions (qid, token, weight)."""
    ship(index.sparkSession)
    n = -(-asked.select("qid").distinct().count() // QUESTIONS)
    block = F.pmod(F.xxhash64("qid"), F.lit(max(n, 1))).alias("block")
    terms = asked.groupBy(block, F.col("token").cast("string").alias("term")).agg(F.collect_list("qid").alias("qids"), F.collect_list(weight).alias("weights"))
    none = F.array()
    ids = terms.select("block").distinct().select("block", F.lit("").alias("term"), none.cast(terms.schema["qids"].dataType).alias("qids"), none.cast(terms.schema["weights"].dataType).alias("weights"))
    return index.join(terms.unionByName(ids), "term").groupBy("block", "shard").applyInPandas(run, schema)


def _questions(d: pd.DataFrame) -> dict:
    out: dict = {}
    for term, qids, weights in zip(d.term, d.qids, d.weights, strict=True):
        for q, w in zip(qids, weights, strict=True):
            out.setdefault(q, []).append((term, w))
    return out


def search(asked: DataFrame, index: DataFrame, k: int, weight: str = "units", whole: bool = True) -> DataFrame:
    """(qid, doc_id, <weight>): the k best documents of each question in each shard; asked (qid, token, <weight>) has a question's tokens once."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        lists, out = Lists(d), []
        for q, terms in _questions(d).items():
            places, scores, _, _ = lists.top(terms, k, whole)
            out.append(pd.DataFrame({"qid": q, "doc_id": lists.ids[places], weight: scores}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "doc_id": [], weight: []})

    return _meet(asked, index, weight, run, f"qid {asked.schema['qid'].dataType.simpleString()}, doc_id long, {weight} {'long' if whole else 'double'}")


def holding(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, doc_id): all documents that have every token of a question (qid, token)."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        lists, out = Lists(d), []
        for q, terms in _questions(d).items():
            need = {t: n for t, n in terms}
            if all(t in lists.terms for t in need) and len(need) == next(iter(need.values())):
                places = lists.terms[next(iter(need))][0]
                for t in need:
                    places = np.intersect1d(places, lists.terms[t][0], assume_unique=True)
                out.append(pd.DataFrame({"qid": q, "doc_id": lists.ids[places]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "doc_id": []})

    # A question's tokens that a shard lacks do not reach its group, so each brings how many there are.
    each = asked.select("qid", F.col("token").cast("string").alias("token")).distinct()
    each = each.join(each.groupBy("qid").agg(F.count("*").alias("n_tokens")), "qid")
    return _meet(each, index, "n_tokens", run, f"qid {asked.schema['qid'].dataType.simpleString()}, doc_id long")


def work(asked: DataFrame, index: DataFrame, k: int, weight: str = "units", whole: bool = True) -> DataFrame:
    """(qid, blocks, visited): blocks that hold a term of a question, and those that its search had to look into."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        lists = Lists(d)
        got = [(q, *lists.top(terms, k, whole)[2:]) for q, terms in _questions(d).items()]
        return pd.DataFrame(got, columns=["qid", "visited", "blocks"])

    each = _meet(asked, index, weight, run, f"qid {asked.schema['qid'].dataType.simpleString()}, visited long, blocks long")
    return each.groupBy("qid").agg(F.sum("blocks").alias("blocks"), F.sum("visited").alias("visited"))
