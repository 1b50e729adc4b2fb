"""Nearest vectors behind an index: an inverted file of k-means cells whose residuals are product-quantised.

A model (centres of cells, a codebook for each part of a residual) is fitted on a bounded sample; every vector is indexed. A cell's vectors lie in pages of at most about ``PAGE``, so a cell that holds a third of all vectors is many rows, not one group: a row has ids, codes, each code's error (the distance between a vector and what its code stands for) and the vectors themselves. Kept indexes are partitioned by cell, so a search that visits few cells reads few.

With ``probes``, a question visits that many nearest cells, ranks their vectors by distance tables (one look-up for each part of a code) and scores the best of each page exactly: approximate, with exact scores. Without, the result is exact: a first search with ``FIRST`` probes gives each question a distance within which it has k vectors; a code's distance less its error bounds the true one from below, and of all cells only vectors whose bound does not exceed that distance are scored. Scores are those of ``retrieval.dense``.

Vectors of another dimension than the model's, null ones and such with null components take no part. Vectors of length zero have no direction: under the cosine they stand in pages of their own that every question visits.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import retrieval

#: Vectors that a model is fitted on at most, cells at most, vectors of a page, codes of a part of a residual, rounds of fitting, questions of a block, probes of the first search of an exact one.
SAMPLE, CELLS, PAGE, CODES, ROUNDS, QUESTIONS, FIRST = 32_768, 4096, 2048, 64, 10, 512, 8
SCHEMA = "page long, n long, ids binary, codes binary, errors binary, vectors binary, cell int"


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x and c."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T), 0)


def _centres(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """k-means: n centres, each empty one put on the vector that lies farthest off."""
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(ROUNDS):
        d = _near(x, c)
        own = d.argmin(1)
        n_own = np.bincount(own, minlength=n)
        for i in np.flatnonzero(n_own == 0):
            far = d[np.arange(len(x)), own].argmax()
            own[far], d[far] = i, 0
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = total / np.maximum(np.bincount(own, minlength=n), 1)[:, None]
    return c


@dataclass(frozen=True)
class Model:
    """Centres of cells, and codebooks (parts, codes, dimensions of a part; the last parts are padded with zeros)."""

    metric: str
    centres: np.ndarray
    books: np.ndarray

    @property
    def size(self) -> int:
        return self.centres.shape[1]

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Vectors where distances follow the metric: of length one under the cosine."""
        if self.metric == "euclid":
            return x
        norm = np.linalg.norm(x, axis=1)[:, None]
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def parts(self, r: np.ndarray) -> np.ndarray:
        """(rows, parts, dimensions of a part)."""
        m, _, d = self.books.shape
        return np.pad(r, ((0, 0), (0, m * d - r.shape[1]))).reshape(len(r), m, d)

    def coded(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the distance of each from what its code stands for."""
        p = self.parts(r)
        codes = np.stack([_near(p[:, i], b).argmin(1) for i, b in enumerate(self.books)], 1).astype(np.uint8)
        back = np.stack([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((p - back) ** 2).sum((1, 2)))


def fit(points: DataFrame, metric: str = "cosine", cells: int | None = None, parts: int = 8, seed: int = 7) -> Model:
    """A model of at most SAMPLE vectors of the commonest dimension, the first in the order of a hash; about the square root of all vectors as cells, at most CELLS."""
    if metric not in ("cosine", "euclid"):
        raise ValueError("metric must be cosine or euclid")
    good = points.where("vector is not null and not exists(vector, x -> x is null)")
    row = good.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), "d").first()
    if row is None:
        raise ValueError("there are no vectors")
    some = good.where(F.size("vector") == row.d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("vector").collect()
    x = np.array([r.vector for r in some], np.float64)
    model = Model(metric, np.zeros((1, row.d)), np.zeros((1, 1, row.d)))
    x, rng = model.placed(x), np.random.default_rng(seed)
    n = max(1, min(cells or round(row.n**0.5), CELLS, len(x)))
    centres = _centres(x, n, rng)
    rest = x - centres[_near(x, centres).argmin(1)]
    parts = min(parts, row.d)
    d = -(-row.d // parts)
    split = np.pad(rest, ((0, 0), (0, parts * d - row.d))).reshape(len(x), parts, d)
    books = np.stack([_centres(split[:, i], min(CODES, len(x)), rng) for i in range(parts)])
    return Model(metric, centres, books)


def build(points: DataFrame, model: Model) -> DataFrame:
    """The index of points (doc_id, vector): pages by cell."""
    spark = points.sparkSession
    ship(spark)
    send = spark.sparkContext.broadcast(model)

    def place(batches):
        m = send.value
        for b in batches:
            v = b.column("vector").to_pylist()
            ok = [i for i, x in enumerate(v) if x is not None and len(x) == m.size and None not in x]
            if ok:
                x = m.placed(np.array([v[i] for i in ok], np.float64))
                cell = _near(x, m.centres).argmin(1).astype(np.int32)
                if m.metric == "cosine":
                    cell[~x.any(1)] = -1
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ok)).cast(pa.int64()), b.column("vector").take(pa.array(ok)).cast(pa.list_(pa.float64())), pa.array(cell)], ["doc_id", "vector", "cell"])

    def pack(d: pd.DataFrame) -> pd.DataFrame:
        m, cell = send.value, int(d.cell.iloc[0])
        d = d.sort_values("doc_id", kind="stable")
        raw = np.array(d.vector.tolist(), np.float64)
        codes, errors = (np.zeros((0, 0), np.uint8), np.zeros(0)) if cell < 0 else m.coded(m.placed(raw) - m.centres[cell])
        return pd.DataFrame({"page": [d.page.iloc[0]], "n": [len(d)], "ids": [d.doc_id.to_numpy(np.int64).tobytes()], "codes": [codes.tobytes()], "errors": [errors.tobytes()], "vectors": [raw.tobytes()], "cell": [cell]})

    placed = points.select("doc_id", "vector").mapInArrow(place, "doc_id long, vector array<double>, cell int")
    n = placed.groupBy("cell").agg(F.ceil(F.count("*") / PAGE).alias("pages"))
    return placed.join(n, "cell").withColumn("page", F.pmod(F.xxhash64("doc_id"), "pages")).drop("pages").groupBy("cell", "page").applyInPandas(pack, SCHEMA)


def write(index: DataFrame, model: Model, path: str, append: bool = False) -> None:
    """Keep an index and its model, or add pages that the same model made."""
    index.write.mode("append" if append else "errorifexists").partitionBy("cell").parquet(f"{path}/pages")
    if not append:
        index.sparkSession.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.parquet(f"{path}/model")


def open_(spark: SparkSession, path: str) -> tuple[DataFrame, Model]:
    """The pages and the model of a kept index. The model is a pickle: open what you have written."""
    return spark.read.schema(SCHEMA).parquet(f"{path}/pages"), pickle.loads(bytes(spark.read.parquet(f"{path}/model").first().model))


def _scores(m: Model, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Scores as ``retrieval.dense`` rounds them, of one question and some vectors."""
    if m.metric == "euclid":
        s = -retrieval.apart((q * q).sum() + (p * p).sum(1), p @ q)
    else:
        norm = np.linalg.norm(p, axis=1) * np.linalg.norm(q)
        s = np.divide(p @ q, norm, out=np.zeros(len(p)), where=norm > 0)
    return np.round(s, 9) + 0.0


def candidates(m: Model, cell: int, codes: np.ndarray, errors: np.ndarray, q: np.ndarray, within: float | None, most: int | None) -> np.ndarray:
    """Places in a page that are scored exactly for one question: the ``most`` nearest by their codes, or all that may lie ``within`` a distance."""
    r = m.parts(q[None] - m.centres[cell])[0]
    tables = ((m.books - r[:, None]) ** 2).sum(2)
    far = np.sqrt(tables[np.arange(len(tables)), codes].sum(1))
    if most is not None:
        return np.argpartition(far, most - 1)[:most] if most < len(far) else np.arange(len(far))
    return np.arange(len(far)) if within is None else np.flatnonzero(far - errors <= within + 1e-6)


def search(queries: DataFrame, index: DataFrame, model: Model, k: int = 20, probes: int | None = None, rescored: int = 10, report: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank): nearest points of questions (qid, vector); ``probes`` cells of each, or exact without. With ``report`` (qid, visited, scored): vectors in the visited cells, and those scored exactly."""
    spark = queries.sparkSession
    ship(spark)
    send = spark.sparkContext.broadcast(model)
    if probes is None:
        # The k-th score of the first search as a distance, the score's rounding included.
        last = search(queries, index, model, k, FIRST).where(F.col("rank") == k)
        far = -F.col("score") if model.metric == "euclid" else F.sqrt(2 - 2 * (F.col("score") - 1e-9))
        queries = queries.select("qid", "vector").join(last.select("qid", far.alias("within")), "qid", "left")
    else:
        queries = queries.select("qid", "vector", F.lit(None).cast("double").alias("within"))

    def visit(batches):
        m = send.value
        for b in batches:
            v = b.column("vector").to_pylist()
            ok = [i for i, x in enumerate(v) if x is not None and len(x) == m.size and None not in x]
            if not ok:
                continue
            x = m.placed(np.array([v[i] for i in ok], np.float64))
            n = min(probes or len(m.centres), len(m.centres))
            near = np.argpartition(_near(x, m.centres), n - 1, axis=1)[:, :n]
            near = np.concatenate((near, np.full((len(x), 1), -1)), 1)
            row = pa.array(np.repeat(ok, n + 1))
            yield pa.RecordBatch.from_arrays([b.column("qid").take(row).cast(pa.int64()), b.column("vector").take(row).cast(pa.list_(pa.float64())), b.column("within").take(row), pa.array(near.ravel().astype(np.int32))], ["qid", "vector", "within", "cell"])

    def score(batches):
        m = send.value
        for b in batches:
            for ids, codes, errors, vectors, cell, asked in zip(*(b.column(c).to_pylist() for c in ("ids", "codes", "errors", "vectors", "cell", "asked")), strict=True):
                ids, raw = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, m.size)
                codes, errors = np.frombuffer(codes, np.uint8).reshape(-1 if cell >= 0 else 0, len(m.books)), np.frombuffer(errors, np.float64)
                out = [[], [], []]
                for a in asked:
                    q = np.array(a["vector"], np.float64)
                    # A question of length zero has no direction: its scores say nothing of distances.
                    within = a["within"] if m.metric == "euclid" or q.any() else None
                    some = np.arange(len(ids)) if cell < 0 else candidates(m, cell, codes, errors, m.placed(q[None])[0], within, None if probes is None else rescored * k)
                    if report:
                        got = [[a["qid"]], [len(ids)], [len(some)]]
                    else:
                        s = _scores(m, q, raw[some])
                        top = np.lexsort((ids[some], -s))[:k]
                        got = [[a["qid"]] * len(top), ids[some][top].tolist(), s[top].tolist()]
                    for o, x in zip(out, got, strict=True):
                        o += x
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64() if report else pa.float64())], ["qid", "doc_id", "score"])

    asked = queries.mapInArrow(visit, "qid long, vector array<double>, within double, cell int")
    block = F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // QUESTIONS))))
    asked = asked.groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("qid", "vector", "within")).alias("asked"))
    found = index.join(asked, "cell").select("ids", "codes", "errors", "vectors", "cell", "asked").mapInArrow(score, f"qid long, doc_id long, score {'long' if report else 'double'}")
    if report:
        return found.groupBy("qid").agg(F.sum("doc_id").alias("visited"), F.sum("score").alias("scored"))
    return retrieval.best(found, k)
