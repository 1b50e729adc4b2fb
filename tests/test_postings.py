"""The inverted index against brute force: exact scores, ties, blocks skipped, appended and kept indexes, conjunctions."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.functions import text
from docquarry.operators import postings, retrieval

ASKED = "qid long, token string, units long"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{min(int(rng.paretovariate(0.7)), 900)}" for _ in range(rng.randint(0, 30)))) for i in range(3000)]
    return [*docs, (3, "w1 w2 again"), (None, "w2"), (4001, None), (4002, "")]


def _best(scores, k):
    return sorted(((-s, d) for d, s in scores if s > 0))[:k]


def test_search_equals_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(postings, "SHARD", 700)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3, "doc_id")
    rng = random.Random(2)
    asked = [(q, f"w{t}", rng.randint(1, 5)) for q in range(40) for t in {min(int(rng.paretovariate(0.5)), 950) for _ in range(rng.randint(1, 6))}]
    got = collections.defaultdict(list)
    for r in retrieval.best(postings.search(spark.createDataFrame(asked, ASKED), postings.of_texts(docs), 7), 7, score="units").collect():
        got[r.qid].append((-r.units, r.doc_id))
    have = [(-1 if d is None else d, set(text.tokens_of(t))) for d, t in corpus]
    for q in range(40):
        want = _best([(d, sum(u for a, t, u in asked if a == q and t in toks)) for d, toks in have], 7)
        assert sorted(got[q]) == want, q


def test_blocks_are_skipped(spark):
    """Rare high scores stand in few blocks; the others' bounds are below them."""
    rng = random.Random(3)
    points = [(i, {"indices": [1, 2], "values": [100.0 + rng.random() if i % 1000 == 7 else rng.random(), rng.random()]}) for i in range(12_000)]
    df = spark.createDataFrame(points, "doc_id long, sparse struct<indices:array<long>,values:array<double>>").coalesce(1)
    asked = spark.createDataFrame([(1, "1", 1.0), (1, "2", 0.5)], "qid long, token string, score double")
    index = postings.of_vectors(df)
    r = postings.work(asked, index, 5, "score", False).first()
    assert r.blocks > 90 and r.visited < r.blocks / 2
    got = retrieval.best(postings.search(asked, index, 5, "score", False), 5).collect()
    want = sorted(((-(p["values"][0] + 0.5 * p["values"][1]), i) for i, p in points))[:5]
    assert [(x.doc_id, round(x.score, 9)) for x in sorted(got, key=lambda x: x["rank"])] == [(i, round(-s, 9)) for s, i in want]


def test_vectors_equal_brute_force(spark):
    """Weights of both signs, vectors that are null or empty."""
    rng = np.random.default_rng(1)
    points = [(i, {"indices": sorted(rng.choice(40, 6, replace=False).tolist()), "values": rng.integers(-4, 9, 6).astype(float).tolist()}) for i in range(600)]
    df = spark.createDataFrame([*points, (900, None), (901, {"indices": [], "values": []})], "doc_id long, sparse struct<indices:array<long>,values:array<double>>")
    got = collections.defaultdict(list)
    for r in retrieval.sparse(df.where("doc_id < 30").withColumnRenamed("doc_id", "qid"), df, 9).collect():
        got[r.qid].append((-r.score, r.doc_id))
    maps = {i: dict(zip(v["indices"], v["values"], strict=True)) for i, v in points}
    for q in range(30):
        assert sorted(got[q]) == _best([(d, sum(w * m.get(t, 0) for t, w in maps[q].items())) for d, m in maps.items()], 9)


def test_kept_index_grows(spark, corpus, tmp_path):
    docs = spark.createDataFrame([c for c in corpus if c[0] is not None], "doc_id long, text string")
    path = str(tmp_path / "index")
    postings.write(postings.of_texts(docs.where("doc_id < 1500")), path)
    with pytest.raises(Exception):
        postings.write(postings.of_texts(docs), path)
    postings.write(postings.of_texts(docs.where("doc_id >= 1500")), path, append=True)
    asked = spark.createDataFrame([(1, "w1 w40 w7"), (2, "w3"), (3, ""), (4, None), (5, "nowhere")], "qid long, text string")
    kept = retrieval.lexical(asked, None, 5, index=postings.open_(spark, path)).collect()
    fresh = retrieval.lexical(asked, docs, 5).collect()
    assert sorted(kept) == sorted(fresh) and {r.qid for r in kept} == {1, 2}
    plan = retrieval.lexical(asked, None, 5, index=postings.open_(spark, path))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_documents_with_all_tokens(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    asked = [(1, "w1"), (1, "w2"), (2, "w5"), (3, "w1"), (3, "nowhere"), (4, "w2"), (4, "w2")]
    got = {(r.qid, r.doc_id) for r in postings.holding(spark.createDataFrame(asked, "qid long, token string"), postings.of_texts(docs)).collect()}
    have = [(-1 if d is None else d, set(text.tokens_of(t))) for d, t in corpus]
    assert got == {(q, d) for q in range(1, 5) for d, toks in have if {t for a, t in asked if a == q} <= toks}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1", 1)], ASKED)
    assert postings.search(asked, postings.of_texts(none), 3).isEmpty()
    assert postings.search(asked.where("qid < 0"), postings.of_texts(none), 3).isEmpty()
    assert retrieval.lexical(asked.select("qid", F.col("token").alias("text")), none).isEmpty()


def test_vectors_without_an_index_meet_by_term(spark):
    """No group of shard and block of questions; repeated rows are documents of their own, a null doc_id is -1."""
    made = lambda *w: {"indices": list(range(len(w))), "values": list(w)}
    points = [(1, made(1.0, 2.0)), (1, made(1.0, 2.0)), (1, made(3.0)), (None, made(9.0)), (2, made(-1.0, 1.0)), (3, None)]
    df = spark.createDataFrame(points, "doc_id long, sparse struct<indices:array<long>,values:array<double>>")
    asked = spark.createDataFrame([(7, made(1.0, 1.0)), (8, None), (9, made(0.0, 2.0))], "qid long, sparse struct<indices:array<long>,values:array<double>>")
    found = retrieval.sparse(asked, df, 4)
    assert "InPandas" not in found._jdf.queryExecution().toString() and "InArrow" not in found._jdf.queryExecution().toString()
    got = sorted((r.qid, r["rank"], r.doc_id, r.score) for r in found.collect())
    assert got == [(7, 1, -1, 9.0), (7, 2, 1, 3.0), (7, 3, 1, 3.0), (7, 4, 1, 3.0), (9, 1, 1, 4.0), (9, 2, 1, 4.0), (9, 3, 2, 2.0)]


def test_a_shard_holds_half_a_million_tokens(spark):
    """One task over 700,000 tokens holds them in two shards at least."""
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(700)), lambda i: F.concat(F.lit("w"), (F.col("id") % 7 * 1000 + i).cast("string"))), " ").alias("text")).coalesce(1)
    shards = postings.of_texts(docs).groupBy("shard").agg(F.sum(F.when(F.col("term") != "", F.col("n"))).alias("tokens"), F.sum(F.when(F.col("term") == "", F.col("n"))).alias("docs")).collect()
    assert len(shards) > 1 and max(r.tokens for r in shards) <= (1 << 19) + 700
    assert sum(r.tokens for r in shards) == 700_000 and sum(r.docs for r in shards) == 1000
