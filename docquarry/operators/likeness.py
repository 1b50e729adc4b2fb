"""Names that are alike by their letters: a similarity join for the Indel ratio, and the canonical name that each reaches.

The ratio of two names is 2 * longest common subsequence / total length. Names of a ratio of at least ``threshold`` differ by at most d = (1 - threshold) * total length inserted and deleted letters, so their lengths lie in a band, and of d + 1 pieces of the shorter one at least one stands unchanged in the longer, moved by no more than the edits allow. The pieces are join keys; candidates are checked once where they meet, and nothing but pairs that pass goes on. Names meet within their field.

A name that many others share pieces with meets all of these; the join splits such a key over tasks, and work grows with the pairs that share a piece.
"""

from __future__ import annotations

from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

#: Against rounding in products of a threshold.
SLACK = 1e-9
PIECES = "field string, k string, ord long, size int, piece int, part string"


def indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / total length, by bit-parallel rows; 1 for two empty strings."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        m = masks.get(c, 0)
        row = ((row + (row & m)) | (row & ~m)) & full
    return 2 * (len(a) - bin(row).count("1")) / (len(a) + len(b))


def cuts(size: int, threshold: float) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a name of ``size`` letters that is the shorter of a pair: one more than the edits that any longer partner allows."""
    longest = floor(size * (2 - threshold) / threshold + SLACK)
    n = floor((1 - threshold) * (size + longest) + SLACK) + 1
    return [(i * size // n, (i + 1) * size // n) for i in range(n)]


def pieces(k: str, threshold: float) -> list[tuple[int, int, str]]:
    """(size, piece, part): keys of a name as the shorter one. Where a piece would be empty, any longer name of a fitting size is met."""
    found = cuts(len(k), threshold)
    if any(s == e for s, e in found):
        return [(len(k), -1, "")]
    return [(len(k), i, k[s:e]) for i, (s, e) in enumerate(found)]


def windows(k: str, threshold: float) -> set[tuple[int, int, str]]:
    """The same keys of a name as the longer one: the parts in which a piece of each shorter size may stand."""
    n, out = len(k), set()
    for size in range(max(ceil(n * threshold / (2 - threshold) - SLACK), 1), n + 1):
        found = cuts(size, threshold)
        if any(s == e for s, e in found):
            out.add((size, -1, ""))
            continue
        edits, more = floor((1 - threshold) * (size + n) + SLACK), n - size
        for i, (s, e) in enumerate(found):
            for move in range(-((edits - more) // 2), (edits + more) // 2 + 1):
                if s + move >= 0 and e + move <= n:
                    out.add((size, i, k[s + move : e + move]))
    return out


def _keyed(names: DataFrame, keys) -> DataFrame:
    def run(batches):
        for b in batches:
            out = [(f, k, o, *x) for f, k, o in zip(*(b.column(c).to_pylist() for c in ("field", "k", "ord")), strict=True) for x in keys(k)]
            for s in range(0, len(out), 1 << 14):
                cols = zip(*out[s : s + (1 << 14)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["field", "k", "ord", "size", "piece", "part"])

    return names.select("field", "k", "ord").mapInArrow(run, PIECES)


def pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(field, k, other, ratio): names (field, k, ord; k once a field) and earlier ones that are alike; a pair may be there more than once. Earlier is a smaller ord, of equal ones a smaller k. Names of a negative ord are known before and are not compared with one another."""
    ship(names.sparkSession)
    names = names.where("k != ''")
    short = _keyed(names, lambda k: pieces(k, threshold))
    long = _keyed(names, lambda k: windows(k, threshold)).withColumnsRenamed({"k": "k2", "ord": "ord2"})
    met = short.join(long, ["field", "size", "piece", "part"]).where("k != k2 and (ord >= 0 or ord2 >= 0)")
    late = F.struct("ord", "k") > F.struct(F.col("ord2").alias("ord"), F.col("k2").alias("k"))
    met = met.select("field", F.when(late, F.col("k")).otherwise(F.col("k2")).alias("k"), F.when(late, F.col("k2")).otherwise(F.col("k")).alias("other"))

    def check(batches):
        for b in batches:
            rows = dict.fromkeys(zip(*(c.to_pylist() for c in b.columns), strict=True))
            out = [(f, k, o, r) for f, k, o in rows if (r := indel_ratio(k, o)) >= threshold]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["field", "k", "other", "ratio"])

    return met.mapInArrow(check, "field string, k string, other string, ratio double")


def closest(found: DataFrame) -> DataFrame:
    """(field, k, other, ratio): of each name the most alike ones, all of a tie once."""
    top = found.groupBy("field", "k").agg(F.max("ratio").alias("ratio"))
    return found.join(top, ["field", "k", "ratio"]).select("field", "k", "other", "ratio").distinct()


def ends(links: DataFrame) -> DataFrame:
    """(field, k, other): the names without a link that each name reaches along its links; links (field, k, other) have no circles. Every round replaces links by what they lead to, so rounds are few."""
    links = cut(links.select("field", "k", "other").distinct())
    while True:
        onward = links.select("field", F.col("k").alias("other"), F.col("other").alias("further"))
        if links.join(onward.select("field", "other").distinct(), ["field", "other"], "left_semi").isEmpty():
            return links
        links = cut(links.join(onward, ["field", "other"], "left").select("field", "k", F.coalesce("further", "other").alias("other")).distinct())


def _paged(names: DataFrame, page: int, name: str) -> DataFrame:
    """A field's names that have a vector, in pages of about ``page``."""
    names = names.where("vector is not null")
    n = names.groupBy("field").agg(F.ceil(F.count("*") / page).alias("pages"))
    paged = names.join(n, "field").select("field", F.pmod(F.xxhash64("k"), "pages").alias("page"), F.struct("k", "ord", "vector").alias("x"))
    return paged.groupBy("field", "page").agg(F.collect_list("x").alias(name)).drop("page")


def near_vectors(asking: DataFrame, names: DataFrame, threshold: float, page: int = 1024) -> DataFrame:
    """(field, k, other, ratio): asking names (field, k, ord, vector) and earlier names whose cosine reaches the threshold, rounded to nine places; a field's pages meet pages."""
    ship(names.sparkSession)
    both = _paged(asking, page, "names").join(_paged(names, page, "names2"), "field")

    def run(batches):
        for b in batches:
            for f, left, right in zip(*(b.column(c).to_pylist() for c in ("field", "names", "names2")), strict=True):
                for d in {len(x["vector"]) for x in left}:
                    a, c = ([x for x in side if len(x["vector"]) == d and None not in x["vector"]] for side in (left, right))
                    if not a or not c:
                        continue
                    u, v = (np.array([x["vector"] for x in side], float) for side in (a, c))
                    norm = np.linalg.norm(u, axis=1)[:, None] * np.linalg.norm(v, axis=1)
                    s = np.round(np.divide(u @ v.T, norm, out=np.zeros((len(a), len(c))), where=norm > 0), 9)
                    at = [(i, j) for i, j in np.argwhere(s >= threshold).tolist() if (a[i]["ord"], a[i]["k"]) > (c[j]["ord"], c[j]["k"])]
                    if at:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([f] * len(at), [a[i]["k"] for i, _ in at], [c[j]["k"] for _, j in at], [float(s[i, j]) for i, j in at])], ["field", "k", "other", "ratio"])

    return both.mapInArrow(run, "field string, k string, other string, ratio double")
