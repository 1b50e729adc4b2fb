"""Near duplicates by BagMinHash: weighted-Jaccard signatures of multisets of word shingles, bands, exact verification, classes.

A text's words give a multiset of shingles (five words; a text of fewer words is one shingle). The weight axis of a shingle is split into the dyadic blocks [0,1), [1,2), [2,4), [4,8)...; each block has a Poisson process of its width's rate, seeded by shingle and block. A point falls on a register and on a weight in its block, and counts if that weight lies below the shingle's: the hierarchical splitting of one process, so that equal parts of two weights see equal points. A register keeps its earliest point; two signatures agree in a register with a probability equal to the weighted Jaccard similarity of the multisets. Points of a shingle are made in order of time and only while they can still change a register, so the work hardly grows with weights.

1. Texts of equal words are one node. Signatures are cut into bands. Nodes that share a band are linked to the band's leader only, never all to all: its most popular node, the one that meets most others over all its bands, which in a group of edited copies is the text nearest to all.
2. Each link is verified by the exact overlap of the multisets, min over max. Links of at least the threshold give classes (connected components).
3. Nodes of one band have one leader, so pairs of non-leaders that no class joins yet are found among the nodes around a leader. These are dealt into pages of about PAGE texts by their distance to it; as 1 - J is a metric, only pages whose distances differ by at most 1 - threshold can hold a pair. Pages of nodes outside the leader's class meet all such pages, and the exact overlaps of a whole page with another come from one product of incidence matrices. Within a class no further link can change the result. With 32 bands of 4 registers, a pair at the threshold 0.8 shares no band with probability 5e-8.

A null text counts as empty. Texts without words are never near duplicates; each is a class of its own (class_id is its doc_id). Rows that repeat share a class. class_id is the least doc_id of the class. Extra columns are ignored by ``classes`` and passed through by ``keep_one``. Texts are known by a 128-bit digest of their words; shingles by 64 bits.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, cut, fresh, mix64, released, shards, starts_of, texts_of, word_hashes, words_of

SHINGLE, THRESHOLD = 5, 0.8
REGISTERS, ROWS = 128, 4
#: Texts that one page holds when pages are compared whole.
PAGE = 256
BANDS = REGISTERS // ROWS
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(texts: list[str], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, its distinct shingles as sorted 64-bit hashes, and their counts."""
    codes, lengths, uniques = words_of(texts)
    h = mix64(word_hashes(uniques))[codes] if len(codes) else np.zeros(0, np.uint64)
    odd = np.resize(_ODD, size) + np.arange(size, dtype=np.uint64) * np.uint64(2)
    with np.errstate(over="ignore"):
        whole = np.zeros(max(len(h) - size + 1, 0), np.uint64)
        for k in range(size):
            whole += h[k : k + len(whole)] * odd[k]
        whole = mix64(whole)
        out = []
        for s, n in zip(starts_of(lengths), lengths, strict=True):
            if n >= size:
                out.append(np.unique(whole[s : s + n - size + 1], return_counts=True))
            elif n:
                out.append((mix64(np.array([(h[s : s + n] * odd[:n]).sum() + np.uint64(n)], np.uint64)), np.ones(1, np.int64)))
            else:
                out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """(bags, m) signatures of non-empty multisets; entries are equal where the same point came first."""
    reg = np.full((len(bags), m), np.inf)
    n = np.array([len(k) for k, _ in bags], np.int64)
    doc = np.repeat(np.arange(len(bags)), n)
    key = np.concatenate([k for k, _ in bags]) if len(bags) else np.zeros(0, np.uint64)
    weight = np.concatenate([c for _, c in bags]).astype(np.int64) if len(bags) else np.zeros(0, np.int64)
    blocks = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    level = np.arange(int(blocks.sum())) - np.repeat(starts_of(blocks), blocks)
    doc, key, weight = (np.repeat(a, blocks) for a in (doc, key, weight))
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    with np.errstate(over="ignore"):
        key = mix64(key + level.astype(np.uint64) * _ODD[1])
        x, t, flat = np.zeros(len(key)), 0, reg.reshape(-1)
        while len(key):
            many = 1 if t < 2 else 4 if t < 10 else 16
            a = mix64(key[:, None] + (np.arange(t, t + many, dtype=np.uint64) * _STEP)[None, :])
            b = mix64(a ^ _ODD[3])
            gap = -np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
            when = x[:, None] + np.cumsum(gap, axis=1)
            spot = low[:, None] + ((b >> np.uint64(40)).astype(np.int64) % width[:, None])
            place = doc[:, None] * m + (b & np.uint64(0xFFFFFFFF)).astype(np.int64) % m
            limit = reg.max(1)
            fits = (spot < weight[:, None]) & (when < limit[doc][:, None])
            np.minimum.at(flat, place[fits], when[fits])
            x, t = when[:, -1], t + many
            live = x < reg.max(1)[doc]
            doc, key, weight, low, width, x = (v[live] for v in (doc, key, weight, low, width, x))
    return (mix64(reg.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def bands(sig: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bands of signatures."""
    h = np.zeros((len(sig), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            h = mix64(h * _ODD[0] + sig[:, k::ROWS][:, :BANDS] + np.uint64(k + 1))
        return mix64(h + np.arange(BANDS, dtype=np.uint64)[None, :] * _ODD[2])


def similarity(a, b) -> float:
    """Sum of minima over sum of maxima of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - least
    return float(least / total) if total else 0.0


def _digest(text: str) -> tuple[bytes | None, int]:
    """Digest of a text's words (None without words), and their number."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes part at ASCII white space, as WORD does
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None, len(words)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches. Labels spread to neighbours and jump to their label's label; each round is cut."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = cut(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")))
        if new.where("root != old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def _pack(t: pa.Table) -> pa.Table:
    blob = pickle.dumps([t.column(c).to_pylist() for c in ("node", "root", "z")])
    return pa.table([t.column(c).slice(0, 1) for c in ("lead", "home", "cell", "page")] + [pa.array([blob], pa.binary())], ["lead", "home", "cell", "page", "blob"])


def _elements(zs: list[bytes], size: int):
    """The multisets of packed texts as sets: the n-th copy of a shingle is an element of its own. (elements, owners, sizes)"""
    expand = zstandard.ZstdDecompressor()
    bags = shingles([expand.decompress(z).decode() for z in zs], size)
    key, count = np.concatenate([k for k, _ in bags]), np.concatenate([c for _, c in bags])
    nth = np.arange(int(count.sum())) - np.repeat(starts_of(count), count)
    sizes = np.array([c.sum() for _, c in bags])
    with np.errstate(over="ignore"):
        return mix64(np.repeat(key, count) + nth.astype(np.uint64) * _ODD[4]), np.repeat(np.arange(len(bags)), sizes), sizes


def _links(one: list, two: list, threshold: float, size: int) -> list[dict]:
    """Links of at least the threshold between nodes of two pages that lie in different classes, one for each node and class."""
    (e1, o1, n1), (e2, o2, n2) = _elements(one[2], size), _elements(two[2], size)
    both = np.intersect1d(e1, e2)
    inter = np.zeros((len(n1), len(n2)), np.float32)
    for s in range(0, len(both), 4096):
        some = both[s : s + 4096]
        m = []
        for e, o, n in ((e1, o1, n1), (e2, o2, n2)):
            at = np.minimum(np.searchsorted(some, e), len(some) - 1)
            hit = some[at] == e
            x = np.zeros((len(n), len(some)), np.float32)
            x[o[hit], at[hit]] = 1
            m.append(x)
        inter += m[0] @ m[1].T
    j = inter / (n1[:, None] + n2[None, :] - inter)
    r1, r2 = (np.array(x[1], dtype=object) for x in (one, two))
    out, seen = [], set()
    for i, k in zip(*np.nonzero((j >= threshold - 1e-6) & (r1[:, None] != r2[None, :])), strict=True):
        exact = float(inter[i, k]) / float(n1[i] + n2[k] - inter[i, k])
        if exact >= threshold and (i, r2[k]) not in seen:
            seen.add((i, r2[k]))
            out.append({"a": one[0][i], "b": two[0][k], "j": exact})
    return out


def _classes(docs: DataFrame, threshold: float, size: int) -> DataFrame:
    """doc_id, class_id, n_words, n_links, dig and stands (the row is its class's first) for every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def name(batches):
        for b in batches:
            d = [_digest(t) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in d], pa.binary()), pa.array([n for _, n in d], pa.int64())], ["doc_id", "dig", "n_words"])

    def prepare(batches):
        """Of the texts with words, one of each digest: its bands, and the text compressed."""
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            found = {}
            for t in texts_of(b.column("text")):
                d, n = _digest(t)
                if n:
                    found.setdefault(d, t)
            own = list(found.items())
            for s, e in shards([t for _, t in own], 1 << 20):
                h = bands(signatures(shingles([t for _, t in own[s:e]], size)))
                cuts = pa.array(np.arange(0, h.size + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in own[s:e]], pa.binary()), pa.ListArray.from_arrays(cuts, pa.array(h.view(np.int64).reshape(-1))), pa.array([squeeze.compress(t.encode()) for _, t in own[s:e]], pa.binary())], ["node", "bands", "z"])

    # Everything below starts from this table: the texts are read and split into words once. The tables that are cut are so that joins on their keys, which may be hot, can be split.
    texts = cut(base.select("text").mapInArrow(released(prepare), "node binary, bands array<long>, z binary").groupBy("node").agg(F.first(F.struct("bands", "z")).alias("t")).select("node", "t.bands", "t.z"))
    members = texts.select("node", F.explode("bands").alias("band"))
    shared = cut(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    grouped = cut(members.join(shared, "band"))
    popular = grouped.groupBy("node").agg(F.sum("n").alias("popular"))
    leaders = cut(grouped.select("band", "node").join(popular, "node").groupBy("band").agg(F.max(F.struct("popular", "node")).alias("top")).select("band", F.col("top.node").alias("lead")))
    stars = cut(grouped.select("band", "node").join(leaders, "band").where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())

    def verify(batches):
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            cache: dict = {}
            za, zb = b.column("za").to_pylist(), b.column("zb").to_pylist()
            for s in range(0, len(za), 256):
                need = {z for z in (*za[s : s + 256], *zb[s : s + 256]) if z not in cache}
                if len(cache) > 2000:
                    cache.clear()
                    need = {*za[s : s + 256], *zb[s : s + 256]}
                need = list(need)
                cache |= zip(need, shingles([expand.decompress(z).decode() for z in need], size), strict=True)
                j = [similarity(cache[p], cache[q]) for p, q in zip(za[s : s + 256], zb[s : s + 256], strict=True)]
                part = b.slice(s, 256)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(j)], ["a", "b", "j"])

    one, two = (texts.select(F.col("node").alias(c), F.col("z").alias("z" + c)) for c in "ab")
    links = cut(stars.join(one, "a").join(two, "b").mapInArrow(released(verify), "a binary, b binary, j double"))
    same = links.where(F.col("j") >= threshold)
    found = components(same)
    # Nodes around one leader that ended in different classes: pages of them, by distance to the leader, are compared whole.
    root = lambda t, c: t.join(found.select(F.col("node").alias(c), F.col("root").alias(c + "_root")), c, "left").withColumn(c + "_root", F.coalesce(c + "_root", c))
    slack = 1 - threshold + 1e-9
    around = cut(root(root(links.select("a", "b", F.floor((1 - F.col("j")) / slack).alias("cell")), "a"), "b").select(F.col("b").alias("lead"), F.col("a").alias("node"), F.col("a_root").alias("root"), (F.col("a_root") == F.col("b_root")).alias("home"), "cell"))
    # What decides about a leader is summed up by cell first, so no table is dealt by leader alone.
    pages = cut(around.groupBy("lead", "home", "cell").agg(F.count("*").alias("n")))
    strays = pages.groupBy("lead").agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("home"), F.col("n"))).alias("out")).where("n > 1 and out > 0")
    pages = cut(pages.join(strays.select("lead"), "lead", "left_semi").withColumn("pages", F.ceil(F.col("n") / PAGE).cast("int")).drop("n"))
    dealt = around.join(pages, ["lead", "home", "cell"]).withColumn("page", F.pmod(F.xxhash64("node"), F.col("pages")).cast("int"))
    schema = "lead binary, home boolean, cell long, page int, blob binary"
    packed = cut(dealt.join(texts, "node").select("lead", "home", "cell", "page", "node", "root", "z").groupBy("lead", "home", "cell", "page").applyInArrow(_pack, schema))
    one = packed.where(~F.col("home")).select("lead", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"), F.struct("cell", "page").alias("pa"), F.col("blob").alias("one"))
    two = packed.select("lead", "cell", "home", F.struct("cell", "page").alias("pb"), F.col("blob").alias("two"))
    meet = one.join(two, ["lead", "cell"]).where(F.col("home") | (F.col("pa") <= F.col("pb"))).repartition("lead", "pa", "pb", "home")

    def compare(batches):
        for b in batches:
            for x, y in zip(b.column("one").to_pylist(), b.column("two").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(_links(pickle.loads(x), pickle.loads(y), threshold, size), schema=pa.schema([("a", pa.binary()), ("b", pa.binary()), ("j", pa.float64())]))

    late = cut(meet.select("one", "two").mapInArrow(released(compare), "a binary, b binary, j double"))
    if not late.isEmpty():
        same = same.unionByName(late)
        found = components(same)
    pairs = same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    counts = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    roots = cut(found.join(counts, "node").select(F.col("node").alias("dig"), "root", "n_links"))
    named = base.mapInArrow(released(name), "doc_id long, dig binary, n_words long")
    keyed = named.join(roots, "dig", "left").withColumn("class", F.coalesce("root", "dig"))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("dig").alias("d"))
    least = cut(keyed.where("class is not null").groupBy("class").agg(F.min(rank).alias("first")))
    got = keyed.join(least, "class", "left")
    class_id = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("first.i"))
    return got.select("doc_id", class_id.alias("class_id"), "n_words", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "dig", (F.col("class").isNull() | (F.col("first") == rank)).alias("stands"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """doc_id, class_id, n_words, n_links for every document; n_links counts the other texts that its text was found similar to on the way to its class (not all there are in it)."""
    return _classes(docs, threshold, size).select("doc_id", "class_id", "n_words", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """One row of docs for each class, columns unchanged: its least doc_id (rows without one come last), and of several texts of that id the least digest; of rows that repeat both, one. Texts without words stay, all of them."""
    i, d, dig, twice = fresh(docs.columns, "mark_id", "mark_dig", "dig", "twice")
    held = _classes(docs, threshold, size).where("dig is not null").groupBy("doc_id", "dig").agg(F.first("stands").alias("stands"), F.count("*").alias("n"))
    # Texts to drop, and texts that stand but have several rows.
    marks = cut(held.where("not stands or n > 1").select(F.col("doc_id").alias(i), F.col("dig").alias(d), F.col("stands").alias(twice)))

    def name(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_digest(t)[0] for t in texts_of(b.column("text"))], pa.binary())], [*b.schema.names, dig])

    def met(how: str, which: DataFrame) -> DataFrame:
        named = docs.mapInArrow(released(name), T.StructType([*docs.schema.fields, T.StructField(dig, T.BinaryType())]))
        return named.join(which, named["doc_id"].cast("long").eqNullSafe(which[i]) & (named[dig] == which[d]), how)

    once = met("left_anti", marks).select(*docs.columns)
    several = marks.where(F.col(twice))
    if several.isEmpty():
        return once
    return once.unionByName(met("left_semi", several).dropDuplicates(["doc_id", dig]).select(*docs.columns))
