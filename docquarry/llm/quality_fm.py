"""Quality by a factorisation machine over hashed words, structure statistics and size metadata of the text.

Each text gives distinct hashed words with weights of unit length, and one-hot bins of structure statistics (symbols, capitals, repeats, line shape, word lengths) and of its size. The machine models every pairwise interaction through low-rank factors; with the identity  sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_k ((sum_i v_ik x_i)^2 - sum_i v_ik^2 x_i^2)  a text is scored in time linear in its number of features. It is trained by Adagrad in numpy.

Nulls and empty texts have the bins of size zero and no words. Texts are never cut. Rows that repeat get the same score; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, label_sample, mix64, released, remainder, shards, starts_of, texts_of, trim, word_hashes, words_of

#: Most labelled documents that a model is fitted on.
MAX_TRAIN = 20_000
BITS, RANK, BINS = 15, 6, 16
HELD_MOD, HELD = 5, 0
SYMBOLS = "#*$%&|<>"
#: Upper ends of the bins of shares; sizes use powers of two.
SHARES = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9])
N_STATS = 11
SIZE = (1 << BITS) + N_STATS * BINS


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray


def features(texts: list[str]):
    """(ids, values, lengths) of the texts' features, one text after another."""
    n = len(texts)
    codes, lengths, uniques = words_of(texts)
    doc = np.repeat(np.arange(n), lengths)
    total = np.maximum(lengths, 1)
    chars = np.array([max(len(t), 1) for t in texts])
    size = np.fromiter(map(len, uniques), np.int64, len(uniques))
    upper = np.fromiter((u.isupper() and len(u) > 1 for u in uniques), np.int64, len(uniques))
    alpha = np.fromiter((any(map(str.isalpha, u)) for u in uniques), np.int64, len(uniques))
    per = lambda x: np.bincount(doc, weights=x[codes], minlength=n)[:n] if len(codes) else np.zeros(n)
    pair = doc * max(len(uniques), 1) + codes
    keys, counts = np.unique(pair, return_counts=True)
    kdoc, kword = np.divmod(keys, max(len(uniques), 1))
    distinct = np.bincount(kdoc, minlength=n)[:n] if len(keys) else np.zeros(n)
    top = np.zeros(n)
    np.maximum.at(top, kdoc, counts)
    again = np.bincount(doc[1:], weights=(codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1]), minlength=n)[:n] if len(codes) > 1 else np.zeros(n)
    lines = [t.split("\n") for t in texts]
    n_lines = np.array([len(x) for x in lines])
    same = np.array([1 - len(set(x)) / len(x) for x in lines])
    count = lambda cs: np.array([sum(map(t.count, cs)) for t in texts])
    stats = [
        count(SYMBOLS) / chars, count("!?") / total, per(upper) / total, 1 - distinct / total, again / total, top / total, same,
        1 - per(alpha) / total, count("0123456789") / chars,
    ]
    bins = [np.searchsorted(SHARES, s, side="left") for s in stats]
    bins.append(np.minimum(np.log2(lengths + 1).astype(int), BINS - 1))
    bins.append(np.minimum((per(size) / total / 1.5).astype(int), BINS - 1))
    extra = np.stack([(1 << BITS) + k * BINS + np.minimum(b, BINS - 1) for k, b in enumerate(bins)], axis=1)
    hashed = (mix64(word_hashes(uniques)) >> np.uint64(64 - BITS)).astype(np.int64)
    weight = 1 / np.sqrt(np.maximum(distinct, 1))
    ids = np.concatenate([hashed[kword], extra.ravel()])
    values = np.concatenate([weight[kdoc], np.full(extra.size, 1 / np.sqrt(N_STATS))]).astype(np.float32)
    owner = np.concatenate([kdoc, np.repeat(np.arange(n), N_STATS)])
    order = np.argsort(owner, kind="stable")
    return ids[order], values[order], np.bincount(owner, minlength=n)[:n]


def raw(model: Model, ids, values, lengths):
    """Logits, and the sums of factors that gradients need."""
    at = starts_of(lengths)
    vx = model.v[ids] * values[:, None]
    s = np.add.reduceat(vx, at, axis=0)
    q = np.add.reduceat(vx * vx, at, axis=0)
    return model.w0 + np.add.reduceat(model.w[ids] * values, at) + 0.5 * (s * s - q).sum(1), s


def scores(model: Model, texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts))
    for a, b in shards(texts, 1 << 20):
        z, _ = raw(model, *features(texts[a:b]))
        out[a:b] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def fit(ids, values, lengths, y, seed: int = 5, epochs: int = 8, steps: int = 600, lr: float = 0.1, decay: float = 1e-5) -> Model:
    """Train on features for at least ``epochs`` passes and ``steps`` steps. With no rows, or rows of one class, scores are that class's smoothed rate."""
    rng = np.random.default_rng(seed)
    rate = (y.sum() + 1) / (len(y) + 2)
    m = Model(float(np.log(rate / (1 - rate))), np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32))
    if len(y) < 10 or y.min() == y.max():
        m.v[:] = 0
        return m
    cw, cv, c0 = np.full(SIZE, 1e-2, np.float32), np.full(SIZE, 1e-2, np.float32), 1e-2
    at = starts_of(lengths)
    order = np.arange(len(y))
    for _ in range(max(epochs, -(-steps * 128 // len(y)))):
        rng.shuffle(order)
        for s in range(0, len(order), 128):
            batch = order[s : s + 128]
            n = lengths[batch]
            take = np.repeat(at[batch] - starts_of(n), n) + np.arange(n.sum())
            i, x = ids[take], values[take]
            z, sums = raw(m, i, x, n)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            m.w0 -= lr * g.sum() / np.sqrt(c0 := c0 + g.sum() ** 2)
            row = np.repeat(np.arange(len(batch)), n)
            gx = (g[row] * x).astype(np.float32)
            vi = m.v[i]
            gv = gx[:, None] * (sums[row] - vi * x[:, None])
            u, inv = np.unique(i, return_inverse=True)
            gw = np.bincount(inv, weights=gx, minlength=len(u)).astype(np.float32) + decay * m.w[u]
            gvs = np.stack([np.bincount(inv, weights=gv[:, k], minlength=len(u)) for k in range(RANK)], axis=1).astype(np.float32) + decay * m.v[u]
            cw[u] += gw * gw
            cv[u] += (gvs * gvs).mean(1)
            m.w[u] -= lr * gw / np.sqrt(cw[u])
            m.v[u] -= 0.5 * lr * gvs / np.sqrt(cv[u])[:, None]
    return m


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Fit on the features of at most ``most`` labelled documents outside the held-out remainder; features, not texts, come to the driver."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, values, n = features(texts_of(b.column("text")))
            cuts = np.cumsum(n)[:-1]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([x.astype("<i4").tobytes() for x in np.split(ids, cuts)], pa.binary()), pa.array([x.tobytes() for x in np.split(values, cuts)], pa.binary())],
                ["doc_id", "y", "ids", "vals"],
            )

    got = label_sample(docs, labels, "quality", HELD_MOD, HELD, most).mapInArrow(released(run), "doc_id long, y int, ids binary, vals binary").toArrow()
    got = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "y", "ids", "vals")), strict=True))
    ids = [np.frombuffer(r[2], "<i4") for r in got]
    model = fit(np.concatenate(ids or [np.zeros(0, np.int32)]), np.frombuffer(b"".join(r[3] for r in got), np.float32), np.array([len(x) for x in ids], np.int64), np.array([r[1] for r in got], np.float64))
    del got, ids
    trim()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            p = scores(sent.value, texts_of(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(HELD_MOD) == HELD).alias("held_out"), "text").mapInArrow(released(run), "doc_id long, held_out boolean, score double, predicted int")
