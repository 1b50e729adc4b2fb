"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling, trained in numpy.

A word is looked up in four embedding tables, by two hashes of the word and by hashes of its first four and five letters, and the parts are joined: a rare word seldom shares all parts with a toxic one, and an inflected or compound form shares the last two with its stem. Filters of each width slide over the words of the whole text, the largest activation of each filter over the text is kept, and a logistic layer scores them. Scores see the text alone. Thresholds by language are calibrated afterwards and only turn scores into decisions.

Nulls and empty texts score as texts without words. A document is never cut: filters slide over all its words, in windows that overlap where a text is very long. Rows that repeat get the same score. Extra columns are ignored by ``score`` and passed through by ``keep``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, label_sample, released, remainder, shards, starts_of, texts_of, trim, word_hashes, words_of

TOKEN = re.compile(r"\w+")
#: Most labelled documents that a model is fitted on.
MAX_TRAIN = 6_000
BITS, PART, WIDTHS, FILTERS = 16, 6, (1, 2, 3), 12
#: Letters of the prefixes that have tables of their own.
PREFIXES = (4, 5)
TABLES = 2 + len(PREFIXES)
HELD_MOD, HELD = 4, 2
#: Ids of words as the driver gets them for training: they have BITS bits.
IDS = np.dtype("<u2")
#: Words of a very long text whose activations are held at once.
WINDOW = 1 << 18


@dataclass
class Model:
    """tables: embeddings; convs: for each width its (width, dim, filters) weights and bias; w, b: the logistic layer; thresholds: by language."""

    tables: list
    convs: list
    w: np.ndarray
    b: float
    thresholds: dict = field(default_factory=dict)

    def pooled(self, ids: list, lengths: np.ndarray):
        """Largest activation of each filter over each text, and where it is. ids hold the pads that follow each text."""
        pad = max(WIDTHS) - 1
        starts = starts_of(lengths + pad)
        x = np.concatenate([e[i] for e, i in zip(self.tables, ids, strict=True)], axis=1)
        out, where = [], []
        full = lengths > 0
        for k, c in self.convs:
            m = len(k)
            n = len(x) - m + 1
            z = x[:n] @ k[0]
            for j in range(1, m):
                z += x[j : n + j] @ k[j]
            top = np.zeros((len(lengths), k.shape[2]), np.float32)
            at = np.zeros((len(lengths), k.shape[2]), np.int64)
            if self.w is None:  # training: argmax too
                for i in np.flatnonzero(full):
                    part = z[starts[i] : starts[i] + lengths[i]]
                    a = part.argmax(0)
                    at[i], top[i] = a + starts[i], part[a, np.arange(part.shape[1])]
            elif full.any():
                s = starts[full]
                cuts = np.empty(2 * len(s), np.int64)
                cuts[::2], cuts[1::2] = s, np.minimum(s + lengths[full], n)
                if cuts[-1] >= n:
                    z = np.vstack([z, np.full((1, z.shape[1]), -np.inf, np.float32)])
                top[full] = np.maximum.reduceat(z, cuts, axis=0)[::2]
            out.append(np.maximum(top + c, 0) * full[:, None])
            where.append(at)
        return np.concatenate(out, axis=1), where, x


def token_ids(texts: list[str]):
    """For each table the hashed ids of the words, with pads after each text; and the numbers of words."""
    codes, lengths, uniques = words_of(texts, TOKEN, lower=True)
    h = word_hashes(uniques)
    mask = np.uint64((1 << BITS) - 2)
    hashed = [h, h >> np.uint64(32), *(word_hashes([u[:n] for u in uniques], n) for n in PREFIXES)]
    pad = max(WIDTHS) - 1
    total = int(lengths.sum()) + pad * len(lengths)
    place = np.arange(len(codes)) + pad * np.repeat(np.arange(len(lengths)), lengths)
    out = []
    for x in hashed:
        ids = np.zeros(total, np.int32)
        if len(codes):
            ids[place] = ((x & mask) + np.uint64(1)).astype(np.int32)[codes]
        out.append(ids)
    return out, lengths


def chance(model: Model, ids: list, n: np.ndarray) -> np.ndarray:
    if len(n) == 1 and n[0] > WINDOW:
        # The largest activation over a text is the largest over windows of it; a window is followed by the words that its last filters reach.
        pad = max(WIDTHS) - 1
        parts = [model.pooled([x[s : s + WINDOW + pad] for x in ids], np.array([min(WINDOW, n[0] - s)]))[0] for s in range(0, int(n[0]), WINDOW)]
        h = np.maximum.reduce(parts)
    else:
        h, _, _ = model.pooled(ids, n)
    return 1 / (1 + np.exp(-np.clip(h @ model.w + model.b, -30, 30)))


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """Probability of toxicity for each whole text."""
    out = np.zeros(len(texts))
    for s, e in shards(texts, 1 << 20):
        out[s:e] = chance(model, *token_ids(texts[s:e]))
    return out


@dataclass
class Tokens:
    """Token ids of many texts, pads included, in a flat array a table; text i starts at ``at[i]`` and has n[i] words."""

    ids: list
    n: np.ndarray

    def __post_init__(self):
        self.at = starts_of(self.n + max(WIDTHS) - 1)

    def take(self, some: np.ndarray):
        size = self.n[some] + max(WIDTHS) - 1
        where = np.repeat(self.at[some] - starts_of(size), size) + np.arange(int(size.sum()))
        return [x[where] for x in self.ids], self.n[some]


def fit(data: Tokens, y: np.ndarray, langs: list, seed: int = 7, epochs: int = 4, steps: int = 150) -> Model:
    """Train on token ids with labels and languages; every fifth text is kept for calibration. At least ``epochs`` passes and ``steps`` steps are made.

    With no texts, or texts of one class, the model scores every text with that class's smoothed rate.
    """
    rng = np.random.default_rng(seed)
    dim = TABLES * PART
    size = 1 << BITS
    tables = [rng.normal(0, 0.05, (size, PART)).astype(np.float32) for _ in range(TABLES)]
    convs = [(rng.normal(0, 0.15, (m, dim, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32)) for m in WIDTHS]
    y = np.asarray(y, np.float64)
    rate = (y.sum() + 1) / (len(y) + 4) if len(y) else 0.01
    n_out = FILTERS * len(WIDTHS)
    model = Model(tables, convs, np.zeros(n_out, np.float32), float(np.log(rate / (1 - rate))))
    if len(y) < 10 or y.min() == y.max():
        return model
    cal = np.arange(len(y)) % 5 == 4
    # The first component of each part starts from the smoothed log-odds of its bucket.
    for table, ids in zip(tables, data.ids, strict=True):
        counts = np.zeros((2, size))
        for i in np.flatnonzero(~cal):
            counts[int(y[i])][np.unique(ids[data.at[i] : data.at[i] + data.n[i]])] += 1
        n0, n1 = max((y[~cal] == 0).sum(), 1), max((y[~cal] == 1).sum(), 1)
        p1, p0 = (counts[1] + 0.2) / (n1 + 1), (counts[0] + 0.2 * n0 / n1 + 0.2) / (n0 + 1)
        table[:, 0] = np.where(counts.sum(0) >= 5, np.clip(np.log(p1 / p0), -1, 3), 0).astype(np.float32) * 0.5
        table[0] = 0
    for k, _ in convs:
        k[0, ::PART, :] = np.abs(k[0, ::PART, :]) + 0.2
    w = np.full(n_out, 0.1, np.float32)
    b = model.b
    params = [w] + [p for kc in convs for p in kc]
    caches = [np.full(p.shape, 1e-3, np.float32) for p in params]
    ecache = [np.full(size, 1e-2, np.float32) for _ in range(TABLES)]
    bcache, lr = 1e-3, 0.05
    train = np.flatnonzero(~cal)
    model.w = None
    for _ in range(max(epochs, -(-steps * 64 // max(len(train), 1)))):
        rng.shuffle(train)
        for s in range(0, len(train), 64):
            batch = train[s : s + 64]
            ids, n = data.take(batch)
            h, where, x = model.pooled(ids, n)
            p = 1 / (1 + np.exp(-np.clip(h @ w + b, -30, 30)))
            g = ((p - y[batch]) / len(batch)).astype(np.float32)
            gw, gb = h.T @ g, float(g.sum())
            gh = g[:, None] * w[None, :] * (h > 0)
            grads, gx = [gw], {}
            rows_at, rows_g = [], []
            for q, ((k, _), at) in enumerate(zip(convs, where, strict=True)):
                part = gh[:, q * FILTERS : (q + 1) * FILTERS]
                gk = np.zeros_like(k)
                for j in range(len(k)):
                    pos = np.minimum(at + j, len(x) - 1)
                    gk[j] = np.einsum("bfd,bf->df", x[pos], part)
                    rows_at.append(pos.ravel())
                    rows_g.append((part[:, :, None] * k[j].T[None]).reshape(-1, dim))
                grads += [gk, part.sum(0)]
            pos, gr = np.concatenate(rows_at), np.concatenate(rows_g)
            for p_, g_, c_ in zip(params, grads, caches, strict=True):
                c_ += g_ * g_
                p_ -= lr * g_ / np.sqrt(c_)
            bcache += gb * gb
            b -= lr * gb / np.sqrt(bcache)
            for q, (table, own, cache) in enumerate(zip(tables, ids, ecache, strict=True)):
                u, inv = np.unique(own[pos], return_inverse=True)
                gs = np.zeros((len(u), PART), np.float32)
                np.add.at(gs, inv, gr[:, q * PART : (q + 1) * PART])
                cache[u] += (gs * gs).mean(1)
                table[u] -= 0.5 * lr * gs / np.sqrt(cache[u])[:, None]
                table[0] = 0
    model.w, model.b = w, float(b)
    kept = np.flatnonzero(cal)
    p = np.concatenate([chance(model, *data.take(kept[s : s + 256])) for s in range(0, len(kept), 256)])
    _calibrate(model, p, y[cal], [langs[i] for i in kept])
    return model


def _calibrate(model: Model, p: np.ndarray, y: np.ndarray, langs: list) -> None:
    """Rescale the logit on the texts kept back, then choose for each language with enough of both classes the threshold of the best F1."""
    if not len(y) or y.min() == y.max():
        return
    p = np.clip(p, 1e-9, 1 - 1e-9)
    z = np.log(p / (1 - p))
    a, c = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        d = q - y
        v = q * (1 - q) + 1e-6
        h = np.array([[(v * z * z).sum() + 1e-2, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, np.array([(d * z).sum() + 1e-2 * (a - 1), d.sum() + 1e-2 * c]))
        a, c = a - 0.5 * step[0], c - 0.5 * step[1]
        if np.abs(step).max() < 1e-6:
            break
    a = float(np.clip(a, 0.2, 5))
    model.w, model.b = (model.w * a).astype(np.float32), float(model.b * a + c)
    q = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
    langs = np.array([x or "" for x in langs])
    for lang in sorted(set(langs)):
        own = langs == lang
        if y[own].sum() < 8 or (1 - y[own]).sum() < 8:
            continue
        best = max(((2 * (y[own] * (q[own] >= t)).sum() / max(y[own].sum() + (q[own] >= t).sum(), 1), -abs(t - 0.3), t) for t in np.arange(0.1, 0.95, 0.05)))
        model.thresholds[lang] = float(best[2])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out remainder."""
    bounded_batches(docs.sparkSession)
    more = ("lang",) if "lang" in docs.columns else ()
    names = [f"t{k}" for k in range(TABLES)]

    def run(batches):
        for b in batches:
            ids = [token_ids([t]) for t in texts_of(b.column("text"))]
            langs = b.column("lang").cast(pa.string()) if more else pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), langs, *(pa.array([x[0][k].astype(IDS).tobytes() for x in ids], pa.binary()) for k in range(TABLES))], ["doc_id", "y", "lang", *names])

    got = label_sample(docs, labels, "toxic", HELD_MOD, HELD, most, more).mapInArrow(released(run), "doc_id long, y int, lang string, " + ", ".join(f"{c} binary" for c in names)).toArrow()
    keys = list(zip(got.column("doc_id").to_pylist(), (x.as_buffer().size for x in got.column("t0")), range(got.num_rows), strict=True))
    order = np.array([k[2] for k in sorted(keys)], np.int64)[np.random.default_rng(3).permutation(len(keys))]
    got = got.take(pa.array(order))
    flat = [np.frombuffer(b"".join(x.as_buffer() for x in got.column(c)), IDS) for c in names]
    n = np.array([x.as_buffer().size // IDS.itemsize for x in got.column("t0")], np.int64) - (max(WIDTHS) - 1)
    y, langs = np.array(got.column("y").to_pylist(), np.float64), got.column("lang").to_pylist()
    del got, keys
    trim()
    model = fit(Tokens(flat, n), y, langs)
    del flat
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


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, columns unchanged, whose score stays under the threshold of their language (``threshold`` for languages without one; never lower)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            p = scores(sent.value, texts_of(b.column("text")))
            langs = b.column("lang").to_pylist() if "lang" in b.schema.names else [None] * len(p)
            limit = np.array([max(threshold, sent.value.thresholds.get(x or "", threshold)) for x in langs])
            yield b.filter(pa.array(p < limit))

    return docs.mapInArrow(released(run), docs.schema)
