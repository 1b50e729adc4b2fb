"""Exact top-k search by inner product in a paged M-tree.

Components x become floor(scale * x). A vector v with |v| <= M is lifted to (v, sqrt(M^2 - |v|^2)); then the Euclidean distance of a lifted vector to a query (q, 0) falls as the inner product rises, so nearest neighbours in a metric space are the highest scores.

The tree has three levels of nodes. The root's entries are pivots chosen from a bounded sample; there are more of them the more vectors there are, up to PIVOTS. Every vector belongs to its nearest pivot's cell, whose covering radius is known. A cell is cut into rings by the distance to the pivot, and a ring into pages of about PAGE vectors (a ring of equal vectors into several); each page has a centre, a covering radius and its centre's distance to the pivot, its parent. A page's vectors lie in leaves of about LEAF, each with a centre, a radius and the distance of every entry to it.
1. Each query visits a page of its nearest pivot, which gives its k-th best score so far and with it the distance that a better vector may have.
2. Queries of one pivot form blocks of about BLOCK, each with a centre, a radius and its farthest reach. A block goes to the cells that its reach touches, and in them to the pages that it touches: first by the stored distance to the parent alone, then by the distance of the centres. Pages and queries are shuffled for these pairs only.
3. In a page a query is left out by the page's radius, a leaf by its radius, an entry when its stored distance to the leaf's centre differs too much from the query's. Leaves are visited in the order of their nearest possible distance (best first), and k-th scores tighten as results come in. Partial results are cut to k for each query and merged.
Bounds only leave out what cannot be among the k highest, ties included, with a slack above the rounding of the distances, so the result equals brute force. Scores are exact at every size: products are made in the narrowest of 32-bit and 64-bit floats, 64-bit integers and unbounded integers that holds M^2 exactly. A score beyond 64 bits is ranked in its page by its true value and returned as the nearest 64-bit one.

Vectors that are null or empty, or hold a null or non-finite component (or one whose scaled square is not finite), or have no id, take no part. Rows that repeat an id are vectors of their own: each is a candidate for all other rows, and a query of its own if the id is divisible. Only vectors of one dimension are compared with each other. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, cut, released

PIVOTS, SAMPLE, PAGE, LEAF, BLOCK = 512, 8, 2048, 64, 512
_LONG = np.iinfo(np.int64)


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def lift(v: np.ndarray, m2: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(m2 - (v * v).sum(1, keepdims=True), 0))], axis=1)


def flat(q: np.ndarray) -> np.ndarray:
    """Queries in the lifted space."""
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def slack(m2: float) -> float:
    """More than the error of a distance of lifted vectors in 64-bit floats."""
    return 1e-6 * float(np.sqrt(m2)) + 1e-9


def reach(q: np.ndarray, bound: np.ndarray, m2: float) -> np.ndarray:
    """Distance that a vector may have to each query at most so that its score is at least the bound."""
    return np.sqrt(np.maximum((q * q).sum(1) + m2 - 2 * bound, 0)) + slack(m2)


def exact(v: np.ndarray, m2: float) -> np.ndarray:
    """Whole components in the narrowest type in which all products and their sums, at most m2, are exact."""
    if m2 < 2**24:
        return v.astype(np.float32)
    if m2 < 2**53:
        return v
    if m2 < 2**62:
        return v.astype(np.int64)
    return np.array([[int(x) for x in row] for row in v.tolist()], dtype=object).reshape(v.shape)


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n pivots of x, each the farthest from those before it."""
    picked = [0]
    d = distances(x, x[:1])[:, 0]
    while len(picked) < min(n, len(x)) and d.max() > 1e-6:
        picked.append(int(d.argmax()))
        d = np.minimum(d, distances(x, x[picked[-1:]])[:, 0])
    return x[picked]


def leaves(x: np.ndarray) -> np.ndarray:
    """A leaf number for each lifted vector: nearest of local pivots, large groups dealt in runs of LEAF by distance."""
    near = distances(x, spread(x[: LEAF * 16], max(1, len(x) // LEAF)))
    own, d = near.argmin(1), near.min(1)
    order = np.lexsort((d, own))
    new = np.ones(len(x), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    new |= (np.arange(len(x)) - first) % LEAF == 0
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


class Page:
    """A page: its vectors sorted by leaf, leaf centres and radii, and each entry's distance to its leaf's centre."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, m2: float):
        x = lift(v, m2)
        leaf = leaves(x)
        order = np.lexsort((ids, leaf))
        self.rows, self.ids, self.v, leaf = rows[order], ids[order], exact(v[order], m2), leaf[order]
        x = x[order]
        self.cuts = np.concatenate((np.flatnonzero(np.diff(leaf, prepend=-1)), [len(leaf)]))
        self.centres = np.stack([x[a:b].mean(0) for a, b in zip(self.cuts, self.cuts[1:], strict=False)])
        self.to_centre = np.sqrt(((x - self.centres[leaf]) ** 2).sum(1))
        self.radii = np.array([self.to_centre[a:b].max() for a, b in zip(self.cuts, self.cuts[1:], strict=False)])
        self.centre = x.mean(0)
        self.radius = float(np.sqrt(((x - self.centre) ** 2).sum(1)).max())

    def search(self, own: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, m2: float):
        """(query number, row, id, score) of the page's k best for each query that may still beat its bound (the k-th score known); own are the queries' rows."""
        qx = flat(q)
        live = np.flatnonzero(distances(qx, self.centre[None])[:, 0] - self.radius <= reach(q, bound, m2))
        if not len(live):
            return (np.zeros(0, np.int64),) * 4
        own, q, bound = own[live], q[live], bound[live].astype(np.float64)
        q_exact = exact(q, m2)
        near = distances(qx[live], self.centres)
        least = np.maximum(near - self.radii[None], 0)
        whole = self.v.dtype in (object, np.int64)
        worst = -int(np.finfo(np.float64).max) if self.v.dtype == object else _LONG.min if whole else -np.inf
        best_s = np.full((len(live), k), worst, dtype=self.v.dtype if whole else np.float64)
        best_i = np.full((len(live), k), _LONG.max)
        best_at = np.full((len(live), k), -1)
        left = np.ones(least.shape, bool)
        while True:
            far = reach(q, bound, m2)
            left &= least <= far[:, None]
            rows = np.flatnonzero(left.any(1))
            if not len(rows):
                break
            # Best first: every query's nearest leaf that is left; their entries are one block for all queries that still need one of them.
            some = np.unique(np.where(left[rows], least[rows], np.inf).argmin(1))
            rows = rows[left[rows][:, some].any(1)]
            at = np.concatenate([np.arange(self.cuts[j], self.cuts[j + 1]) for j in some])
            leaf = np.repeat(np.arange(len(some)), self.cuts[some + 1] - self.cuts[some])
            # An entry is computed if some query cannot rule it out by its stored distance.
            at = at[(np.abs(near[rows][:, some][:, leaf] - self.to_centre[at][None]) <= far[rows][:, None]).any(0)]
            left[:, some] = False
            if not len(at):
                continue
            score = (q_exact[rows] @ self.v[at].T).astype(best_s.dtype)
            self_ = self.rows[at][None] == own[rows][:, None]
            score[self_] = worst
            both_s = np.concatenate([best_s[rows], score], axis=1)
            both_i = np.concatenate([best_i[rows], np.where(self_, _LONG.max, self.ids[at][None])], axis=1)
            both_at = np.concatenate([best_at[rows], np.where(self_, -1, at[None])], axis=1)
            take = _top(both_s, both_i, k)
            best_s[rows], best_i[rows], best_at[rows] = (np.take_along_axis(x, take, 1) for x in (both_s, both_i, both_at))
            bound = np.where(best_at[:, -1] >= 0, np.maximum(bound, _below(best_s[:, -1])), bound)
        row, col = np.nonzero((best_at >= 0) & (best_s.astype(np.float64) >= bound[:, None]))
        s, at = best_s[row, col], best_at[row, col]
        score = np.array([min(max(x, _LONG.min), _LONG.max) for x in s], np.int64) if self.v.dtype == object else s.astype(np.int64)
        return live[row], self.rows[at], self.ids[at], score


def _below(s: np.ndarray) -> np.ndarray:
    """Scores as 64-bit floats that are not above them."""
    f = s.astype(np.float64)
    return f if s.dtype == np.float64 else f - np.abs(f) * 1e-12


def _top(s: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row by (score down, id up)."""
    if s.dtype == object:
        return np.array([sorted(range(s.shape[1]), key=lambda c: (-a[c], b[c]))[:k] for a, b in zip(s.tolist(), i.tolist(), strict=True)])  # noqa: B023
    down = -s if s.dtype != np.int64 else ~s  # ~s orders like -s and does not overflow
    if s.shape[1] <= 4 * k:
        return np.lexsort((i, down), axis=1)[:, :k]
    kth = np.partition(down, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(s), k), np.int64)
    for r in range(len(s)):
        c = np.flatnonzero(down[r] <= kth[r])
        out[r] = c[np.lexsort((i[r][c], down[r][c]))[:k]]
    return out


def search(vectors: DataFrame, k: int = 20, scale: float = 64.0, every: int = 20, page: int = PAGE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products for each vector whose id is divisible by ``every``, among all other vectors."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(scale)).alias("e"))
    usable = ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("e") > 0)

    def whole(batches):
        for b in batches:
            v = [np.floor(np.array(x, np.float64)) for x in b.column("e").to_pylist()]
            with np.errstate(over="ignore"):
                norms = [float((x * x).sum()) for x in v]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([len(x) for x in v], pa.int32()), pa.array(norms, pa.float64()), pa.array([x.astype("<f8").tobytes() for x in v], pa.binary())], ["vec_id", "dim", "norm2", "v"])

    vectors = raw.where("vec_id is not null and e is not null").where(usable).mapInArrow(released(whole), "vec_id long, dim int, norm2 double, v binary").where("norm2 < double('infinity')")
    ints = cut(vectors.withColumn("row", F.monotonically_increasing_id()))  # a number for each row, frozen by the checkpoint
    dims = ints.groupBy("dim").agg(F.max("norm2").alias("m2"), F.count("*").alias("n")).collect()  # one row for each dimension in the table
    parts = [_search(ints.where(F.col("dim") == r["dim"]), r["dim"], float(r["m2"]) * (1 + 1e-9) + 1e-9, r["n"], k, every, page) for r in dims]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(ints: DataFrame, dim: int, m2: float, n: int, k: int, every: int, page: int) -> DataFrame:
    spark = ints.sparkSession
    most = max(1, min(PIVOTS, -(-n // page)))
    sample = _matrix(pa.array([r["v"] for r in ints.orderBy(F.xxhash64("row")).limit(SAMPLE * most).select("v").collect()], pa.binary()), dim)
    pivots = spread(lift(sample, m2), most)
    sent = spark.sparkContext.broadcast(pivots)

    def route(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"), dim)
                near = distances(lift(v, m2), sent.value)
                home = distances(flat(v), sent.value).argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("v"), pa.array(near.argmin(1).astype(np.int32)), pa.array(near.min(1)), pa.array(home.astype(np.int32))], ["row", "vec_id", "v", "cell", "d", "home"])

    routed = cut(ints.select("row", "vec_id", "v").mapInArrow(released(route), "row long, vec_id long, v binary, cell int, d double, home int"))
    # One row for each pivot, so at most PIVOTS rows.
    cells = {r["cell"]: r for r in routed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()}
    radii = np.array([cells[c]["high"] if c in cells else -np.inf for c in range(len(pivots))])
    rings = spark.createDataFrame([(c, r["low"], max(r["high"] - r["low"], 1e-9), -(-r["n"] // page)) for c, r in cells.items()], "cell int, low double, width double, rings long")
    ring = F.least(F.floor((F.col("d") - F.col("low")) / F.col("width") * F.col("rings")), F.col("rings") - 1)
    ringed = routed.join(F.broadcast(rings), "cell").select("row", "vec_id", "v", "cell", ring.alias("ring"))
    split = cut(ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / page).alias("pages")))  # cut, so that the join below can split a ring with many rows
    paged = ringed.join(split, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("pages")))

    def build(t: pa.Table) -> pa.Table:
        p = Page(t.column("row").to_numpy(), t.column("vec_id").to_numpy(), _matrix(t.column("v"), dim), m2)
        cell, ring, part = (t.column(c)[0].as_py() for c in ("cell", "ring", "part"))
        parent = float(distances(p.centre[None], sent.value[cell : cell + 1])[0, 0])
        return pa.table([pa.array([cell << 48 | ring << 24 | part]), pa.array([cell], pa.int32()), pa.array([p.centre.tobytes()], pa.binary()), pa.array([p.radius]), pa.array([parent]), pa.array([pickle.dumps(p)], pa.binary())], ["page", "cell", "centre", "radius", "parent", "node"])

    nodes = cut(paged.groupBy("cell", "ring", "part").applyInArrow(build, "page long, cell int, centre binary, radius double, parent double, node binary"))
    asked = routed.where(F.col("vec_id") % every == 0).select("row", F.col("vec_id").alias("query_id"), "v", "home")

    # Queries of one pivot are dealt into groups of about BLOCK; a group visits the page nearest to the pivot (any page is right; a near one gives a better bound).
    groups = cut(asked.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("groups")))
    first = cut(nodes.groupBy(F.col("cell").alias("home")).agg(F.min("page").alias("page")))
    dealt = asked.join(groups, "home").withColumn("g", F.pmod(F.xxhash64("row", F.lit(9)), F.col("groups"))).select("row", "query_id", "v", "home", "g")
    guests = groups.select("home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g")).join(first, "home").join(nodes.select("page", "node"), "page")
    empty = F.lit(None)
    both = dealt.withColumn("node", empty.cast("binary")).unionByName(
        guests.select(empty.cast("long").alias("row"), empty.cast("long").alias("query_id"), empty.cast("binary").alias("v"), "home", "g", "node")
    )

    def visit(t: pa.Table) -> pa.Table:
        """A block of queries: pickled rows, ids, vectors and bounds, with the block's centre, radius and reach, and the cells that it must see."""
        node = next((x for x in t.column("node").to_pylist() if x is not None), None)
        home, g = t.column("home")[0].as_py(), t.column("g")[0].as_py()
        t = t.filter(pc.is_valid(t.column("row")))
        own, q = t.column("row").to_numpy(), _matrix(t.column("v"), dim)
        bound = np.full(len(own), -m2 - 1)
        if node is not None:
            at, _, _, score = pickle.loads(node).search(own, q, bound, k, m2)
            kth = np.full(len(own), np.inf)
            np.minimum.at(kth, at, _below(score))
            # A k-th score that was clipped from below bounds nothing.
            bound = np.where((np.bincount(at, minlength=len(own)) >= k) & (kth > float(_LONG.min)), kth, bound)
        qx, far = flat(q), reach(q, bound, m2)
        centre = qx.mean(0)
        radius = float(np.sqrt(((qx - centre) ** 2).sum(1)).max())
        see = np.flatnonzero((distances(qx, sent.value) - radii[None] <= far[:, None]).any(0))
        names = ["block", "q_centre", "q_radius", "far", "cells", "to_pivot", "queries"]
        blob = pickle.dumps((own, t.column("query_id").to_numpy(), exact(q, m2), bound))
        return pa.table([pa.array([home << 32 | g]), pa.array([centre.tobytes()], pa.binary()), pa.array([radius]), pa.array([float(far.max())]), pa.array([see.tolist()], pa.list_(pa.int32())), pa.array([distances(centre[None], sent.value)[0][see].tolist()], pa.list_(pa.float64())), pa.array([blob], pa.binary())], names)

    blocks = cut(both.groupBy("home", "g").applyInArrow(visit, "block long, q_centre binary, q_radius double, far double, cells array<int>, to_pivot array<double>, queries binary"))
    seen = blocks.select("block", "q_centre", "q_radius", "far", F.explode(F.arrays_zip("cells", "to_pivot")).alias("c")).select("block", "q_centre", "q_radius", "far", F.col("c.cells").alias("cell"), F.col("c.to_pivot").alias("to_pivot"))
    # The stored distances to the common parent bound the distance of the centres from below.
    touch = F.col("far") + F.col("q_radius") + F.col("radius") + F.lit(2 * slack(m2))
    near = seen.join(nodes.select("page", "cell", "centre", "radius", "parent"), "cell").where(F.abs(F.col("to_pivot") - F.col("parent")) <= touch).select("block", "page", "q_centre", "centre", touch.alias("touch"))

    def meets(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float64).reshape(-1, dim + 1) for c in ("q_centre", "centre"))
            yield b.filter(pa.array(np.sqrt(((x - y) ** 2).sum(1)) <= b.column("touch").to_numpy())).select(["block", "page"])

    def meet(batches):
        for b in batches:
            for node, queries in zip(b.column("node").to_pylist(), b.column("queries").to_pylist(), strict=True):
                p = pickle.loads(node)
                own, qid, q, bound = pickle.loads(queries)
                q = q.astype(np.float64)
                for s in range(0, len(own), BLOCK):
                    e = s + BLOCK
                    at, row, ids, score = p.search(own[s:e], q[s:e], bound[s:e], k, m2)
                    yield pa.RecordBatch.from_arrays([pa.array(own[s:e][at]), pa.array(qid[s:e][at]), pa.array(row), pa.array(ids), pa.array(score)], ["query_row", "query_id", "row", "vec_id", "score"])

    pairs = near.mapInArrow(released(meets), "block long, page long")
    # Blocks are smaller than pages, so they travel to the pages.
    shipped = pairs.join(blocks.select("block", "queries"), "block").repartition("page").join(nodes.select("page", "node"), "page")
    return shipped.select("node", "queries").mapInArrow(released(meet), "query_row long, query_id long, row long, vec_id long, score long")
