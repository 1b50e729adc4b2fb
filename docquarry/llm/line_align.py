"""Line dedup by pairwise alignment: documents that share rare lines are aligned by patience diff, and aligned common blocks go from the later one.

A line with a word links documents if it is rare: at most ``rare`` documents of different lines hold it (counted over the whole table). So that no frequent passage stays for being frequent, a line of LINK_WORDS words and more links whatever its count; without ``rare`` (0) only such lines link. Every holder is paired with the line's earliest holder only, so pairs grow with lines and no frequency is cut off. Frequent short lines link nothing by themselves; in a block around a linking line they go with it. Documents of equal lines are one node first; all but the earliest are a common block as a whole, if they hold a line of LINK_WORDS words or, with ``rare``, any word.
Each pair is aligned on the hashes of all its lines: common ends, then lines that are unique on both sides in their longest increasing order, then the gaps between these in the same way; a gap without such lines by a longest common subsequence, so that lines which either side repeats are aligned too (as often as the side that has fewer). A run of aligned lines that follow one another on both sides is a block if it holds a linking line; its lines are deleted from the later document. The earliest holder of a line never loses it.

Order is by doc_id, nulls last, then by a digest of the text. Rows that repeat doc_id and text are one document and get one result. A null text has no lines; an empty one has one empty line. Lines count for equality without white space at their ends. Lines are 64-bit hashes. Extra columns are ignored by ``align`` and passed through by ``strip``.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WORD, bounded_batches, cut, fresh, released

LINK_WORDS = 8
#: Equal places of two gaps that are aligned at once; gaps with more are halved first.
PLACES = 1 << 20
#: A shorter line links if so many documents hold it at most (for ``rare``).
RARE = 10
_EMPTY = xxhash.xxh3_64_intdigest("")


def _increasing(b: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tops, at, back = [], [], []
    for i, x in enumerate(b):
        k = bisect_left(tops, x)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[k], at[k] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common(a: list[int], b: list[int]) -> list[int]:
    """For each k up to len(a), the length of a longest common subsequence of a[:k] and b, by bit-parallel rows."""
    at: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)

    @lru_cache(64)
    def mask(x: int) -> int:
        bits = bytearray(len(a) // 8 + 1)
        for i in at.get(x, ()):
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    full = row = (1 << len(a)) - 1
    for x in b:
        m = row & mask(x)
        row = ((row + m) | (row - m)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return [0, *np.cumsum(1 - bits.astype(np.int64)).tolist()]


def longest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        at: dict[int, list[int]] = {}
        for j in range(b1 - 1, b0 - 1, -1):
            at.setdefault(b[j], []).append(j)
        own = [i for i in range(a0, a1) if a[i] in at]
        if sum(len(at[a[i]]) for i in own) <= PLACES or b1 - b0 < 2:
            # The places in b fall for each place in a, so an increasing subsequence takes one of them at most.
            both = [(i, j) for i in own for j in at[a[i]]]
            out += [both[k] for k in _increasing([j for _, j in both])]
            continue
        half = (b0 + b1) // 2
        part = [a[i] for i in own]
        head, tail = _common(part, b[b0:half]), _common(part[::-1], b[half:b1][::-1])[::-1]
        k = max(range(len(own) + 1), key=lambda i: head[i] + tail[i])
        cut_at = own[k] if k < len(own) else a1
        todo += [(a0, cut_at, b0, half), (cut_at, a1, half, b1)]
    return sorted(out)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of two sequences, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a: dict[int, int] = {}
        for i in range(a0, a1):
            once_a[a[i]] = -1 if a[i] in once_a else i
        once_b: dict[int, int] = {}
        for j in range(b0, b1):
            once_b[b[j]] = -1 if b[j] in once_b else j
        both = [(i, once_b[h]) for h, i in once_a.items() if i >= 0 and once_b.get(h, -1) >= 0]
        if not both:
            out += [(a0 + i, b0 + j) for i, j in longest(a[a0:a1], b[b0:b1])]
            continue
        chosen = [both[k] for k in _increasing([j for _, j in both])]
        ends = [(a0 - 1, b0 - 1), *chosen, (a1, b1)]
        out += chosen
        todo += [(i + 1, p, j + 1, q) for (i, j), (p, q) in zip(ends, ends[1:], strict=False) if p > i + 1 and q > j + 1]
    return sorted(out)


def blocks(matches: list[tuple[int, int]], links: set[int]) -> list[int]:
    """Lines of the later document in runs of aligned lines with a linking line."""
    out, run = [], []
    for m in [*matches, (-9, -9)]:
        if run and m != (run[-1][0] + 1, run[-1][1] + 1):
            if any(j in links for _, j in run):
                out += [j for _, j in run]
            run = []
        run.append(m)
    return out


def _key(doc_id, text) -> bytes:
    return xxhash.xxh3_128_digest(f"{doc_id}\0{text}" if text is not None else f"{doc_id}")


def _lines(docs: DataFrame, link_words: int, rare: int) -> DataFrame:
    """doc_id, key, seq (digest of all lines), hashes (packed), links (places of lines that link by their length), whole (whether a copy of all lines goes) for every document; cut."""

    def run(batches):
        h = xxhash.xxh3_64_intdigest
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            keys, seqs, packed, places, whole = [], [], [], [], []
            for i, t in zip(ids, texts, strict=True):
                lines = [x.strip(" \t\r\v\f") for x in t.split("\n")] if t is not None else []
                p = np.array([h(x) for x in lines], "<u8").tobytes()
                keys.append(_key(i, t))
                seqs.append(xxhash.xxh3_128_digest(p))
                packed.append(p)
                places.append([k for k, x in enumerate(lines) if len(x) >= 2 * link_words - 1 and len(WORD.findall(x)) >= link_words])
                whole.append(any(lines) if rare else bool(places[-1]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(seqs, pa.binary()), pa.array(packed, pa.binary()), pa.array(places, pa.list_(pa.int32())), pa.array(whole, pa.bool_())], ["doc_id", "key", "seq", "hashes", "links", "whole"])

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, key binary, seq binary, hashes binary, links array<int>, whole boolean"))


def _deleted(lines: DataFrame, rare: int) -> DataFrame:
    """seq, first (rank of the earliest document of these lines), gone (places deleted from it)."""
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("key").alias("k"))
    nodes = cut(lines.groupBy("seq").agg(F.min(rank).alias("first"), F.first(F.struct("hashes", "links")).alias("v")))

    def explode(batches):
        for b in batches:
            v = b.column("v")
            seqs, hs, telling = [], [], []
            for i, (p, links) in enumerate(zip(v.field("hashes").to_pylist(), v.field("links").to_pylist(), strict=True)):
                every = np.frombuffer(p, "<u8")
                own = np.unique(every[np.array(links, np.int64)]) if links else every[:0]
                short = np.setdiff1d(every[every != _EMPTY], own) if rare else every[:0]
                seqs.append(np.full(len(own) + len(short), i))
                hs += [own, short]
                telling += [np.ones(len(own), bool), np.zeros(len(short), bool)]
            at = pa.array(np.concatenate(seqs)) if seqs else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("seq").take(at), b.column("first").take(at), pa.array(np.concatenate(hs).view("<i8") if hs else np.zeros(0, np.int64)), pa.array(np.concatenate(telling) if hs else np.zeros(0, bool))], ["seq", "first", "h", "telling"])

    held = nodes.mapInArrow(released(explode), "seq binary, first struct<n:boolean,i:long,k:binary>, h long, telling boolean")
    # Cut, so that the join below can split a line with many holders.
    leaders = cut(held.groupBy("h").agg(F.min(F.struct("first", "seq")).alias("lead"), F.count("*").alias("n"), F.max("telling").alias("telling")).where((F.col("n") > 1) & (F.col("telling") | (F.col("n") <= rare))).select("h", F.col("lead.seq").alias("lead")))
    met = held.select("seq", "h", "telling").join(leaders, "h").where("seq != lead")
    pairs = met.groupBy("seq").agg(F.collect_set("lead").alias("leads"), F.collect_set(F.when(~F.col("telling"), F.col("h"))).alias("rares"))

    def diff(batches):
        for b in batches:
            later, links, rares, earlier = (b.column(c).to_pylist() for c in ("hashes", "links", "rares", "lead_hashes"))
            gone = []
            for x, k, r, e in zip(later, links, rares, earlier, strict=True):
                own = np.frombuffer(x, "<i8")
                k = {*k, *(np.flatnonzero(np.isin(own, r)).tolist() if r else ())}
                gone.append(blocks(patience(np.frombuffer(e, "<i8").tolist(), own.tolist()), k))
            yield pa.RecordBatch.from_arrays([b.column("seq"), pa.array(gone, pa.list_(pa.int32()))], ["seq", "gone"])

    own = nodes.select("seq", F.col("v.hashes").alias("hashes"), F.col("v.links").alias("links"))
    lead = nodes.select(F.col("seq").alias("lead"), F.col("v.hashes").alias("lead_hashes"))
    later = own.join(pairs, "seq").withColumn("lead", F.explode("leads"))
    aligned = later.join(lead, "lead").select("seq", "hashes", "links", "rares", "lead_hashes").mapInArrow(released(diff), "seq binary, gone array<int>")
    gone = aligned.select("seq", F.explode("gone").alias("line")).groupBy("seq").agg(F.array_sort(F.collect_set("line")).alias("gone"))
    return nodes.select("seq", "first").join(gone, "seq", "left")


def _results(docs: DataFrame, link_words: int, rare: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    lines = _lines(docs, link_words, rare)
    got = lines.select("doc_id", "key", "seq", (F.octet_length("hashes") / 8).cast("long").alias("n_lines"), "whole").join(cut(_deleted(lines, rare)), "seq")  # cut, so that a text with many copies can be split
    earliest = F.col("first.k") == F.col("key")
    every = F.when(F.col("whole") & (F.col("n_lines") > 0), F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")))
    none = F.array().cast("array<int>")
    return got.select("doc_id", "key", "n_lines", F.coalesce(F.when(earliest, F.col("gone")).otherwise(every), none).alias("removed"))


def align(docs: DataFrame, link_words: int = LINK_WORDS, rare: int = RARE) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of the deleted lines, from 0) for every document."""
    return _results(docs, link_words, rare).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def strip(docs: DataFrame, link_words: int = LINK_WORDS, rare: int = RARE) -> DataFrame:
    """docs, columns unchanged, without the deleted lines; documents that lose all their lines go. Where the column n_chars exists, it follows the text."""
    names = docs.columns
    k, n, gone = fresh(names, "k", "n", "gone")
    found = _results(docs, link_words, rare).where(F.size("removed") > 0).select(F.col("key").alias(k), F.col("n_lines").alias(n), F.col("removed").alias(gone)).dropDuplicates([k])

    def key(batches):
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_key(i, t) for i, t in zip(ids, texts, strict=True)], pa.binary())], [*b.schema.names, k])

    keyed = docs.mapInArrow(released(key), T.StructType([*docs.schema.fields, T.StructField(k, T.BinaryType())]))
    left = keyed.join(found, k, "left").where(F.col(gone).isNull() | (F.size(gone) < F.col(n)))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = left.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
