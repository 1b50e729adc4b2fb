"""Substring dedup by hashing lines, paragraphs or parts of lines: normalised units are grouped by digest over the whole corpus, the earliest keeps its place, the others are removed; original offsets are retained.

``unit`` says what is hashed: "line", each line with a word; "paragraph", the lines between two that are blank; "part" (the default), lines cut further, as a passage that was put in the middle of a line is in no whole line or paragraph that another text has. Units are normalised by case folding and by joining their words with single spaces.

In parts, lines are cut further at punctuation and after some words chosen by their hash, so that a passage is found wherever in a line it was put. A unit has at least UNIT_WORDS words and ends at the first such place after them. Where units start depends on what stands before, but soon no more, so the units of a shared passage agree after its first ones.
A line of fewer words is a unit of its own, so a short line that is repeated goes whatever stands around it, and a short text is its lines. What is left after the last unit before such a line or the end of the text is too little to be told by itself: it counts together with the unit before it, and goes where both are repeated. So a copy of a whole text goes as a whole.

Ranks are by doc_id, nulls last, then by a digest of doc_id and text, then by place. Rows that repeat doc_id and text are one document and get one result. Null and empty texts have no units. Digests have 128 bits. Units that repeat within a batch are brought together before the shuffle, so a frequent unit reaches its group once a batch. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, bounded_batches, buckets_of, released, texts_of

UNIT_WORDS = 6
UNITS = ("part", "line", "paragraph")
LINE, PARAGRAPH = re.compile(r"[^\n]+"), re.compile(r"(?:[^\n]*[^\x20\x09-\x0D][^\n]*(?:\n|$))+")
#: One word in CUT ends a unit where punctuation does not.
CUT, PUNCTUATION = 4, ".!?,;:"
UNIT = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("end", "<u4"), ("flag", "u1")])
FREE, KNOWN = 0, 1
_NULL = np.iinfo(np.int64).max


@lru_cache(1 << 16)
def _cuts(word: str) -> bool:
    """Whether a unit may end after a word: at punctuation, or for one word in CUT by its hash."""
    return word[-1] in PUNCTUATION or zlib.crc32(word.casefold().encode()) % CUT == 0


def units(text: str, least: int = UNIT_WORDS, unit: str = "part") -> list[tuple[int, int, str]]:
    """(start, end, normalised unit) of a text, in code points; end leaves out white space at the end."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    if unit != "part":
        pattern = LINE if unit == "line" else PARAGRAPH
        found = [list(WORD.finditer(text, *m.span())) for m in pattern.finditer(text)]
        return [(ws[0].start(), ws[-1].end(), " ".join(w.group() for w in ws).casefold()) for ws in found if ws]
    out, start, end, words, at = [], 0, 0, [], 0
    # None is the end of the text.
    for line in [*text.split("\n"), None]:
        found = [(m.group(), at + m.start(), at + m.end()) for m in WORD.finditer(line or "")]
        at += len(line or "") + 1
        if words and (line is None or 0 < len(found) < least):
            # The unit before ends in the same line, as fewer words than a unit are left of a line only after one.
            out.append((start, end, f"{out[-1][2]} {' '.join(words).casefold()}"))
            words = []
        if 0 < len(found) < least:
            out.append((found[0][1], found[-1][2], " ".join(w for w, _, _ in found).casefold()))
            continue
        for w, s, e in found:
            if not words:
                start = s
            words.append(w)
            end = e
            if len(words) >= least and _cuts(w):
                out.append((start, end, " ".join(words).casefold()))
                words = []
        if len(words) >= least:
            out.append((start, end, " ".join(words).casefold()))
            words = []
    return out


def _key(doc_id, text) -> bytes:
    return xxhash.xxh3_128_digest(f"{doc_id}\0{text}")


def _rank(x: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Order of units by digest, then by rank; ids and keys belong to the documents that x names."""
    order = np.lexsort((keys["b"].byteswap(), keys["a"].byteswap(), ids))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    # Repeated rows of one document share a place.
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[order][1:] == ids[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    place[order] = np.arange(len(ids)) - np.cumsum(same)
    return np.lexsort((x["start"], place[x["doc"]], x["d2"], x["d1"])), place


def _settle(x: np.ndarray, ids: np.ndarray, keys: np.ndarray):
    """(earliest, later): places of the earliest unit of each digest and of the others. A repeat of the earliest unit itself (a repeated row) is neither."""
    order, place = _rank(x, ids, keys)
    y = x[order]
    new = np.ones(len(y), bool)
    new[1:] = (y["d1"][1:] != y["d1"][:-1]) | (y["d2"][1:] != y["d2"][:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(y)), 0))
    twin = (place[y["doc"]] == place[y["doc"][lead]]) & (y["start"] == y["start"][lead])
    return order[new], order[~twin]


_KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


def spans(docs: DataFrame, least: int = UNIT_WORDS, unit: str = "part") -> DataFrame:
    """key, packs: for each document with removed units, their (start << 31 | end)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = buckets_of(docs)

    def deal(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            texts = texts_of(b.column("text"))
            d, doc, at = [], [], []
            for i, t in enumerate(texts):
                for s, e, u in units(t, least, unit):
                    d.append(digest(u))
                    doc.append(i)
                    at.append((s, e))
            if not d:
                continue
            x = np.zeros(len(d), UNIT)
            h = np.frombuffer(b"".join(d), "<u8").reshape(-1, 2)
            x["d1"], x["d2"], x["doc"] = h[:, 0], h[:, 1], doc
            x["start"], x["end"] = np.array(at, np.int64).T
            raw = [_key(i, t) for i, t in zip(ids, texts, strict=True)]
            keys = np.frombuffer(b"".join(raw), _KEY)
            num = np.array([_NULL if i is None else i for i in ids], np.int64)
            first, later = _settle(x, num, keys)
            x["flag"][later] = KNOWN
            x = x[np.concatenate([first, later])]
            to = np.where(x["flag"] == KNOWN, x["doc"].astype(np.uint64) * np.uint64(0x9E3779B1) + x["start"], x["d1"]) % np.uint64(parts)
            order = np.argsort(to, kind="stable")
            x, to = x[order], to[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            heads, blobs = [], []
            for part in np.split(x, cuts):
                own, inverse = np.unique(part["doc"], return_inverse=True)
                part["doc"] = inverse
                heads.append(num[own].astype("<i8").tobytes() + b"".join(raw[i] for i in own.tolist()))
                blobs.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(to[np.concatenate(([0], cuts))].astype(np.int64)), pa.array(heads, pa.binary()), pa.array(blobs, pa.binary())], ["bucket", "docs", "blob"])

    def settle(t: pa.Table) -> pa.Table:
        ids, keys, xs, at = [], [], [], 0
        for h, b in zip(t.column("docs").to_pylist(), t.column("blob").to_pylist(), strict=True):
            n = len(h) // 24
            ids.append(np.frombuffer(h[: 8 * n], "<i8"))
            keys.append(np.frombuffer(h[8 * n :], _KEY))
            x = np.frombuffer(b, UNIT).copy()
            x["doc"] += at
            xs.append(x)
            at += n
        ids, keys, x = np.concatenate(ids), np.concatenate(keys), np.concatenate(xs)
        free, known = x[x["flag"] == FREE], x[x["flag"] == KNOWN]
        _, later = _settle(free, ids, keys)
        gone = np.concatenate([known, free[later]])
        pack = (gone["start"].astype(np.int64) << 31) | gone["end"].astype(np.int64)
        return pa.table([pa.array([k.tobytes() for k in keys[gone["doc"]]], pa.binary()), pa.array(pack)], ["key", "pack"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = base.mapInArrow(released(deal), "bucket long, docs binary, blob binary").groupBy("bucket").applyInArrow(settle, "key binary, pack long")
    return found.groupBy("key").agg(F.array_sort(F.collect_set("pack")).alias("packs"))


def dedup(docs: DataFrame, least: int = UNIT_WORDS, texts: bool = False, unit: str = "part") -> DataFrame:
    """doc_id, n_chars, n_removed (code points), n_units (removed), spans (start, end) for every document; with ``texts`` also kept, the text that is left."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    found = spans(docs, least, unit)

    def name(batches):
        for b in batches:
            raw = b.column("text")
            t = texts_of(raw)
            cols = [b.column("doc_id"), pa.array([_key(i, x) for i, x in zip(b.column("doc_id").to_pylist(), t, strict=True)], pa.binary()), pa.array([len(x) for x in t], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([raw] if texts else []), ["doc_id", "key", "n_chars", *(["text"] if texts else [])])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(name), "doc_id long, key binary, n_chars long" + (", text string" if texts else ""))
    packs = F.coalesce("packs", F.array().cast("array<bigint>"))
    start, end = (lambda p: F.shiftright(p, 31)), (lambda p: p.bitwiseAND(F.lit((1 << 31) - 1).cast("long")))
    got = base.join(found, "key", "left").withColumn("packs", packs)
    size = F.aggregate("packs", F.lit(0).cast("long"), lambda a, p: a + end(p) - start(p))
    out = got.select("doc_id", "n_chars", size.alias("n_removed"), F.size("packs").cast("long").alias("n_units"), F.transform("packs", lambda p: F.array(start(p), end(p))).alias("spans"), *(["text"] if texts else []))
    if not texts:
        return out

    def keep(batches):
        for b in batches:
            kept = []
            for t, s in zip(texts_of(b.column("text")), b.column("spans").to_pylist(), strict=True):
                ends = [0, *(x for r in s for x in r), len(t)]
                kept.append("".join(t[a:e] for a, e in zip(ends[::2], ends[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_chars", "n_removed", "n_units", "spans")), pa.array(kept, pa.string())], ["doc_id", "n_chars", "n_removed", "n_units", "spans", "kept"])

    return out.mapInArrow(released(keep), "doc_id long, n_chars long, n_removed long, n_units long, spans array<array<long>>, kept string")
