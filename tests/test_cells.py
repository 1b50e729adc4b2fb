"""The index of cells against the exact search: equal without probes, recall with few, hot cells in pages, odd vectors."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import cells, retrieval

POINTS = "doc_id long, vector array<double>"


@pytest.fixture(scope="module")
def clouds():
    """Clouds of very different size: one holds a third of all."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(30, 24)) * 2
    which = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 30, 3000))
    return middle[which] + rng.normal(size=(3000, 24)) * 0.6


@pytest.fixture(scope="module")
def points(spark, clouds):
    rows = [(i, v.tolist()) for i, v in enumerate(clouds)]
    rows += [(5000, [0.0] * 24), (5001, None), (5002, [1.0, 2.0]), (5003, [None] + [1.0] * 23), (5004, rows[7][1]), (5005, rows[7][1]), (5006, [-x for x in rows[7][1]])]
    return spark.createDataFrame(rows, POINTS).repartition(4).cache()


def _by(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.qid].append((r["rank"], r.doc_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_exact_without_probes(spark, points, metric, monkeypatch):
    monkeypatch.setattr(cells, "PAGE", 50)
    asked = points.where("doc_id % 60 = 7 or doc_id >= 5000").withColumnRenamed("doc_id", "qid")
    good = points.where(F.size("vector") == 24).where("not exists(vector, x -> x is null)")
    model = cells.fit(points, metric)
    index = cells.build(points, model).cache()
    got = _by(cells.search(asked, index, model, 9))
    want = _by(retrieval.dense(asked.where(F.size("vector") == 24).where("not exists(vector, x -> x is null)"), good, 9, metric))
    assert got == want and len(got) > 50
    r = cells.search(asked, index, model, 9, report=True).agg(F.sum("visited").alias("v"), F.sum("scored").alias("s")).first()
    assert r.s < r.v / 2
    sizes = index.groupBy("cell").agg(F.count("*").alias("pages"), F.max("n").alias("n")).collect()
    assert index.agg(F.sum("n")).first()[0] == good.count() and max(x.n for x in sizes) < 110 and max(x.pages for x in sizes) > 1


def test_recall_of_few_cells(spark, points):
    asked = points.where("doc_id % 30 = 1 and doc_id < 3000").withColumnRenamed("doc_id", "qid")
    model = cells.fit(points)
    index = cells.build(points, model).cache()
    want = _by(retrieval.dense(asked, points.where(F.size("vector") == 24).where("not exists(vector, x -> x is null)"), 20))
    got = _by(cells.search(asked, index, model, 20, probes=12))
    held = sum(len({d for _, d, _ in got[q]} & {d for _, d, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    visited = cells.search(asked, index, model, 20, probes=12, report=True).agg(F.avg("visited")).first()[0]
    assert held >= 0.9 and visited < 1600


def test_kept_index_grows(spark, points, tmp_path):
    path = str(tmp_path / "i")
    model = cells.fit(points.where("doc_id < 2000"))
    cells.write(cells.build(points.where("doc_id < 2000"), model), model, path)
    with pytest.raises(Exception):
        cells.write(cells.build(points, model), model, path)
    cells.write(cells.build(points.where("doc_id >= 2000"), model), model, path, append=True)
    index, kept = cells.open_(spark, path)
    asked = points.where("doc_id in (3, 2500)").withColumnRenamed("doc_id", "qid")
    assert _by(cells.search(asked, index, kept, 5)) == _by(retrieval.dense(asked, points.where(F.size("vector") == 24).where("not exists(vector, x -> x is null)"), 5))
    plan = cells.search(asked, index, kept, 5, probes=2)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


def test_few_vectors_and_none(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], POINTS)
    model = cells.fit(few, parts=5)
    assert _by(cells.search(few.withColumnRenamed("doc_id", "qid"), cells.build(few, model), model, 2))[1] == [(1, 1, 1.0), (2, 3, 0.707106781)]
    with pytest.raises(ValueError):
        cells.fit(few.where("doc_id > 9"))
    with pytest.raises(ValueError):
        cells.fit(few, "dot")
    assert cells.search(few.where("doc_id > 9").withColumnRenamed("doc_id", "qid"), cells.build(few, model), model, 2).isEmpty()
