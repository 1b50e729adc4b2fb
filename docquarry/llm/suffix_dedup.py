"""Exact removal of long repeated strings by a distributed sparse suffix array over UTF-8 bytes.

A byte is removed when a string of ``length`` bytes that covers it also starts anywhere else, in the same document or another; strings are judged on the input and overlaps count.

Sorting every suffix would shuffle many times the input, so suffixes are chosen by content first. In any run of GAP starts, the start whose 16 leading bytes hash least is the run's anchor; equal strings have equal anchors. Each anchor stands for the starts (at most GAP) whose string it heads, and all these strings hold its core, the length - GAP + 1 bytes from the anchor on.
1. Anchors meet by the hash of their core. An anchor whose core is found once has no repeated string. One whose whole surroundings (all bytes of all strings that it may head) are found again has only repeated strings. What is equal within a batch is brought together before the shuffle.
2. For the others, and one of each group of equal surroundings, every start becomes a suffix (8 leading bytes, then a 128-bit digest of all ``length`` bytes). Suffixes that are equal within a batch are settled there, and one of them goes on as a witness, so that a string that many documents hold does not fill one range. Sampled splitters deal the suffixes into ranges by their leading bytes; each range is sorted by the leading bytes and, only where these tie, by the next keys; neighbours are compared. Splitters compare the same keys as the sort, so equal suffixes never lie on both sides of a boundary, and the sort may spill.
3. The starts found repeated become spans; spans meet the texts once more and are cut out.

``least`` (at most ``length``) makes cores shorter: any string of ``least`` bytes that stands anywhere else holds a whole core, least - GAP + 1 bytes, at an anchor of both places. Removal does not change, but n_shared then counts the bytes of all cores found again, so that passages too short to be removed are reported. Buckets grow in number with the input, not in size.

A null text counts as empty. Documents shorter than ``length`` keep all bytes. Rows that repeat a text are documents of their own, so each is removed whole (if long enough). Strings never run over the end of a text. Very long texts are worked through in slices of 2 MB. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, buckets_of, mix64, released, starts_of

GAP, GRAM = 64, 16
SLICE = 2 << 20
_TABLE = np.random.default_rng(20).integers(1, 2**63, (2, 256)).astype(np.uint64)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ANCHOR = np.dtype([("core", "<u8"), ("all", "<u8"), ("long", "<u4"), ("doc", "<u4"), ("lo", "<u4"), ("off", "u1"), ("n", "u1"), ("flag", "u1")])
#: Bytes of a text's key.
KEY = 12
#: Flags: an anchor on its own; one that stands for several in its batch; one known to be repeated; one whose core is repeated, but no string of ``length`` bytes around it.
ALONE, MANY, KNOWN, SHARED = 0, 1, 2, 3
#: judge of a suffix: a witness whose starts are settled elsewhere, a start to be judged, starts settled within their batch (plus 4 times their number).
WITNESS, OPEN, SETTLED = 0, 1, 2


def pack(lo, off, n):
    """A run of starts as one number: first start, place of its anchor after it, number of starts (at most GAP)."""
    return (lo * GAP + off) * 128 + n


def unpack(packs):
    """(first start, place of the anchor, number of starts) of packed runs."""
    q = np.asarray(packs, np.int64)
    lo, off, n = q // (128 * GAP), q // 128 % GAP, q % 128
    return lo, lo + off, n


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, k: int):
        self.k, self.up, self.down = k, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def to(self, n: int):
        if n > len(self.up):
            base, inverse = _BASE[self.k], pow(_BASE[self.k], -1, 2**64)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, dtype=np.uint64)))) for b in (base, inverse))
        return self.up, self.down


_POWERS = (_Powers(0), _Powers(1))


def _ranges(buf: np.ndarray, k: int = 0):
    """A function of (starts, ends) that hashes ranges of bytes; equal ranges hash alike wherever they stand."""
    with np.errstate(over="ignore"):
        up, down = _POWERS[k].to(len(buf) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[k][buf] * up[: len(buf)])))

        def of(s, e):
            with np.errstate(over="ignore"):
                return mix64((sums[e] - sums[s]) * down[s])

        return of


def _heads(buf: np.ndarray) -> np.ndarray:
    """For each start, the anchor of the GAP starts from it on: the leftmost of the least hash."""
    with np.errstate(over="ignore"):
        h, p, s = buf.astype(np.uint64) + np.uint64(1), np.uint64(_BASE[0]), 1
        while s < GRAM:
            h = h[:-s] * p + h[s:]
            p, s = p * p, 2 * s
        m = (mix64(h) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    s = 1
    while s < GAP:
        step = min(s, GAP - s)
        m = np.minimum(m[:-step], m[step:])
        s += step
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(texts: list[bytes], length: int, least: int | None = None) -> np.ndarray:
    """The anchors of texts (a batch of any size, worked through in slices; the starts of one anchor on both sides of a slice's end are one run)."""
    least = least or length
    out, places = [], []
    sizes = np.array([len(t) for t in texts], np.int64)
    group, held = [], 0

    def flush():
        nonlocal group, held
        if group:
            got, place = _anchors(group, length, least)
            out.append(got)
            places.append(place)
        group, held = [], 0

    for i in np.flatnonzero(sizes >= least):
        t, n = texts[i], int(sizes[i])
        for s in range(0, n - least + 1, SLICE):  # starts from s on, with the bytes around that they need
            e = min(s + SLICE, n - least + 1)
            a, b = max(0, s - GAP), min(n, e + length + GAP)
            group.append((int(i), n, s, e, a, t[a:b]))
            held += b - a
            if held >= SLICE:
                flush()
    flush()
    if not out:
        return np.zeros(0, ANCHOR)
    x, place = np.concatenate(out), np.concatenate(places)
    new = np.ones(len(x), bool)
    new[1:] = (x["doc"][1:] != x["doc"][:-1]) | (place[1:] != place[:-1])
    if new.all():
        return x
    at = np.flatnonzero(new)
    y = x[at]
    y["n"] = np.add.reduceat(x["n"].astype(np.int64), at)  # at most GAP, as all are starts of one anchor
    return y


def _anchors(group: list, length: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, their places in their texts) of slices; a run of starts ends with its slice."""
    buf = np.frombuffer(b"".join(g[5] for g in group), np.uint8)
    offset = starts_of(np.array([len(g[5]) for g in group]))
    head = _heads(buf)
    count = np.array([g[3] - g[2] for g in group])
    first = np.array([o + g[2] - g[4] for o, g in zip(offset, group, strict=True)])
    part = np.repeat(np.arange(len(group)), count)
    p = np.arange(int(count.sum())) - np.repeat(starts_of(count), count) + first[part]
    a = head[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (part[1:] != part[:-1])
    at = np.flatnonzero(new)
    a, part, lo, n = a[at], part[at], p[at], np.diff(np.append(at, len(p)))
    g = [np.array([x[k] for x in group], np.int64)[part] for k in range(5)]  # document, size, first, end, base
    shift = offset[part] - g[4]  # place in the text + shift = place in buf
    of = _ranges(buf)
    left, right = np.maximum(a - GAP + 1, shift), np.minimum(a + length, g[1] + shift)
    got = np.empty(len(at), ANCHOR)
    end = a + least - GAP + 1
    with np.errstate(over="ignore"):
        got["core"] = of(a, end)
        got["long"] = of(a, np.minimum(a + length - GAP + 1, right)) >> np.uint64(32)
        got["all"] = mix64(of(left, a) * np.uint64(3) + of(end, right) * np.uint64(5) + ((a - left) * 4096 + (right - end)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    got["doc"], got["lo"], got["off"], got["n"], got["flag"] = g[0], lo - shift, a - lo, n, ALONE
    return got, a - shift


def _groups(x: np.ndarray, *names: str) -> tuple[np.ndarray, np.ndarray]:
    """Order by the fields, and for each place in that order the number of its group."""
    order = np.lexsort([x[n] for n in reversed(names)])
    new = np.ones(len(x), bool)
    if len(x) > 1:
        new[1:] = np.any([x[n][order][1:] != x[n][order][:-1] for n in names], axis=0)
    return order, np.cumsum(new) - 1


def _settle(x: np.ndarray) -> np.ndarray:
    """Of the anchors of a bucket those whose core is repeated, with new flags: all their strings are repeated (KNOWN), none of ``length`` bytes is (SHARED), or their starts must be compared one by one (ALONE, or MANY for a witness of a known group)."""
    known = x[x["flag"] == KNOWN]
    y = x[x["flag"] != KNOWN]
    if not len(y):
        return known
    order, same = _groups(y, "core", "long", "all")
    size = np.bincount(same, weights=1 + (y["flag"][order] == MANY))
    lead = np.ones(len(y), bool)
    lead[1:] = same[1:] != same[:-1]
    heads = order[lead]  # one anchor of each group of equal surroundings
    met = []
    for names in (("core",), ("core", "long")):  # whether another group has the same
        new = np.ones(len(heads), bool)
        new[1:] = np.any([y[c][heads][1:] != y[c][heads][:-1] for c in names], axis=0)
        which = np.cumsum(new) - 1
        met.append(np.bincount(which)[which] > 1)
    settled = y[order[size[same] > 1]]
    settled["flag"] = KNOWN
    open_ = y[heads]
    open_["flag"] = np.where(size > 1, MANY, np.where(met[1], ALONE, SHARED))
    return np.concatenate([known, settled, open_[met[1] | (met[0] & (size == 1))]])


def _key(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:KEY]


def _bytes(batch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def duplicate_spans(docs: DataFrame, length: int = 400, least: int | None = None):
    """(texts, spans): texts are the distinct texts (key, z: zstandard-compressed bytes); spans (key, packs, starts) hold runs whose cores are found again (4 times the packed run, plus its flag) and the runs of starts found repeated."""
    least = least or length
    if not 2 * GAP + GRAM <= least <= length:
        raise ValueError(f"length must be at least {2 * GAP + GRAM}, and least between it and length")
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = buckets_of(docs)
    text = docs.select("text")

    def prepare(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            t = [x for x in _bytes(b) if len(x) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in t], pa.binary()), pa.array([squeeze.compress(x) for x in t], pa.binary())], ["key", "z"])

    texts = text.mapInArrow(released(prepare), "key binary, z binary").dropDuplicates(["key"])

    def deal(batches):
        for b in batches:
            t = _bytes(b)
            x = anchors(t, length, least)
            if not len(x):
                continue
            order, same = _groups(x, "core", "long", "all")
            size = np.bincount(same)[same]
            lead = np.ones(len(x), bool)
            lead[1:] = same[1:] != same[:-1]
            x["flag"][order] = np.where(size == 1, ALONE, np.where(lead, MANY, KNOWN))
            to = np.where(x["flag"] == KNOWN, mix64(x["lo"].astype(np.uint64) * np.uint64(31) + x["doc"]), x["core"]) % np.uint64(parts)
            order = np.argsort(to, kind="stable")
            x, to = x[order], to[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            buckets, blobs, keys = [], [], []
            made: dict[int, bytes] = {}
            for part in np.split(x, cuts):
                own, inverse = np.unique(part["doc"], return_inverse=True)
                part["doc"] = inverse
                keys.append(b"".join(made.get(i) or made.setdefault(i, _key(t[i])) for i in own.tolist()))
                blobs.append(part.tobytes())
            buckets = to[np.concatenate(([0], cuts))].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], ["bucket", "keys", "blob"])

    def settle(table: pa.Table) -> pa.Table:
        keys, blobs, at = [], [], 0
        for k, b in zip(table.column("keys").to_pylist(), table.column("blob").to_pylist(), strict=True):
            own = np.frombuffer(b, ANCHOR).copy()
            own["doc"] += at
            at += len(k) // KEY
            keys.append(np.frombuffer(k, np.dtype((np.void, KEY))))
            blobs.append(own)
        keys = np.concatenate(keys)
        x = _settle(np.concatenate(blobs))
        coded = pack(x["lo"].astype(np.int64), x["off"].astype(np.int64), x["n"].astype(np.int64)) * 4 + x["flag"]
        return pa.table([pa.array([k.tobytes() for k in keys[x["doc"]]], pa.binary()), pa.array(coded)], ["key", "coded"])

    settled = text.mapInArrow(released(deal), "bucket long, keys binary, blob binary").groupBy("bucket").applyInArrow(settle, "key binary, coded long")
    found = settled.groupBy("key").agg(F.collect_set("coded").alias("packs"))

    def suffixes(batches):
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            runs, raw, owner = [], [], []
            for k, z, packs in zip(b.column("key").to_pylist(), b.column("z").to_pylist(), b.column("packs").to_pylist(), strict=True):
                t = None
                for q in packs:
                    if q & 3 not in (ALONE, MANY):
                        continue
                    t = t if t is not None else expand.decompress(z)
                    run = q >> 2
                    lo, n = run // (128 * GAP), min(run % 128, len(t) - length + 1 - run // (128 * GAP))
                    if n <= 0:  # too near the end of the text for a whole string
                        continue
                    raw.append(t[lo : lo + n - 1 + length])
                    runs.append((lo, n, q & 3 == ALONE))
                    owner.append(k)
                if len(raw) > 4000:
                    yield _suffix_rows(runs, raw, owner, length)
                    runs, raw, owner = [], [], []
            if raw:
                yield _suffix_rows(runs, raw, owner, length)

    def compare(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            if last is not None:
                now = pa.concat_tables([last[0], now])
            cols = [now.column(c).to_numpy() for c in ("lead", "d1", "d2")]
            same = np.all([c[1:] == c[:-1] for c in cols], axis=0)
            dup = np.zeros(now.num_rows, bool)
            if last is not None:
                dup[0] |= last[1]
            dup[1:] |= same
            dup[:-1] |= same
            last = (now.slice(now.num_rows - 1), bool(dup[-1]))
            yield from _starts(now.slice(0, now.num_rows - 1), dup[:-1])
        if last is not None:
            yield from _starts(last[0], np.array([last[1]]))

    pieces = texts.join(found.where(F.exists("packs", lambda q: q.bitwiseAND(F.lit(3).cast("long")) < KNOWN)), "key").mapInArrow(released(suffixes), "lead long, d1 long, d2 long, key binary, at long, judge int")
    sorted_ = pieces.repartitionByRange(parts, "lead", "d1").sortWithinPartitions("lead", "d1", "d2")
    starts = sorted_.mapInArrow(released(compare), "key binary, pack long")
    return texts, found.join(starts.groupBy("key").agg(F.collect_set("pack").alias("starts")), "key", "left")


def _suffix_rows(runs, raw, owner, length):
    buf = np.frombuffer(b"".join(raw), np.uint8)
    lo, n, alone = (np.array(x, np.int64) for x in zip(*runs, strict=True))
    base = starts_of(np.array([len(r) for r in raw]))
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(int(n.sum())) - np.repeat(starts_of(n), n)
    s = base[run] + step
    lead = np.zeros(len(s), np.uint64)
    for k in range(8):
        lead = (lead << np.uint64(8)) | buf[s + k]
    d1, d2 = (_ranges(buf, k)(s, s + length) for k in (0, 1))
    at, judge = lo[run] + step, np.where(alone[run] == 1, OPEN, WITNESS)
    # Equal strings of this batch: one goes on as a witness. The starts are settled and only travel to their texts, as runs, so their keys are mere noise.
    order = np.lexsort((d2, d1))
    new = np.ones(len(s), bool)
    new[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
    many = np.empty(len(s), bool)
    many[order] = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
    on, done = order[new], np.flatnonzero(many & (judge == OPEN))
    cut = np.ones(len(done), bool)
    cut[1:] = (np.diff(done) != 1) | (np.diff(run[done]) != 0)
    first, number = done[cut], np.diff(np.append(np.flatnonzero(cut), len(done)))
    noise = mix64(d1[first] + mix64(at[first].astype(np.uint64) * np.uint64(_BASE[1]) + run[first].astype(np.uint64)))
    take = np.concatenate([on, first])
    keys = [np.concatenate([v, mix64(noise + np.uint64(k))]) for k, v in enumerate(((lead ^ np.uint64(1 << 63))[on], d1[on], d2[on]))]
    judge = np.concatenate([np.where(many[on], WITNESS, judge[on]), SETTLED + 4 * number]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(v.view(np.int64)) for v in keys), pa.array([owner[i] for i in run[take].tolist()], pa.binary()), pa.array(at[take]), pa.array(judge)],
        ["lead", "d1", "d2", "key", "at", "judge"],
    )


def _starts(rows: pa.Table, dup: np.ndarray):
    judge = rows.column("judge").to_numpy()
    take = np.flatnonzero((dup & (judge == OPEN)) | (judge % 4 == SETTLED))
    if len(take):
        got = rows.take(pa.array(take)).combine_chunks()
        yield pa.RecordBatch.from_arrays([got.column("key").combine_chunks(), pa.array(pack(got.column("at").to_numpy(), 0, np.maximum(judge[take] // 4, 1)))], ["key", "pack"])


def merged(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of the intervals (s, e)."""
    if not len(s):
        return []
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return list(zip(s[at].tolist(), e[np.append(at[1:], len(s)) - 1].tolist(), strict=True))


def covered(packs, length: int, size: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of bytes that the packed runs of starts cover; starts too near the end for a whole string cover none."""
    s, _, n = unpack(packs)
    n = np.minimum(n, size - length + 1 - s)
    return merged(s[n > 0], (s + n - 1 + length)[n > 0])


def shared(packs, least: int) -> int:
    """Bytes of the cores of packed runs."""
    _, a, _ = unpack(packs)
    return sum(e - s for s, e in merged(a, a + least - GAP + 1))


def dedup(docs: DataFrame, length: int = 400, texts: bool = False, least: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_shared (bytes of cores found again) for every document; with ``texts`` also spans (start, end in bytes) and kept (bytes)."""
    least = least or length
    distinct, spans = duplicate_spans(docs, length, least)

    def slim(batches):
        for b in batches:
            t = _bytes(b)
            shas = [hashlib.sha256(x).digest() for x in t]
            cols = [b.column("doc_id"), pa.array([x[:KEY] for x in shas], pa.binary()), pa.array([len(x) for x in t], pa.int64()), pa.array([x.hex() for x in shas])]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(t, pa.binary())] if texts else []), ["doc_id", "key", "n_bytes", "sha", *(["raw"] if texts else [])])

    def remove(batches):
        expand = zstandard.ZstdDecompressor()
        schema = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha", pa.string()), ("n_shared", pa.int64())] + ([("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())] if texts else []))
        for b in batches:
            rows = []
            for k, z, packs, starts in zip(*(b.column(c).to_pylist() for c in ("key", "z", "packs", "starts")), strict=True):
                t = expand.decompress(z)
                runs = covered([*(q >> 2 for q in packs if q & 3 == KNOWN), *(starts or ())], length, len(t))
                ends = [0, *(x for r in runs for x in r), len(t)]
                kept = b"".join(t[a:e] for a, e in zip(ends[::2], ends[1::2], strict=True))
                rows.append({"key": k, "n_removed": len(t) - len(kept), "n_spans": len(runs), "kept_sha": hashlib.sha256(kept).hexdigest(), "n_shared": shared([q >> 2 for q in packs], least)} | ({"spans": [list(r) for r in runs], "kept": kept} if texts else {}))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    more = ", spans array<array<long>>, kept binary" if texts else ""
    cut_out = distinct.join(spans, "key").mapInArrow(released(remove), "key binary, n_removed long, n_spans long, kept_sha string, n_shared long" + more)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(slim), "doc_id long, key binary, n_bytes long, sha string" + (", raw binary" if texts else ""))
    zero = F.lit(0).cast("long")
    return base.join(cut_out, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), F.coalesce("n_shared", zero).alias("n_shared"),
        *([F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans"), F.coalesce("kept", "raw").alias("kept")] if texts else []),
    )
