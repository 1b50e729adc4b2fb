"""Byte-level BPE encoding and decoding of whole texts, with overlapping chunks for long ones.

Texts of up to ``chunk`` characters are pre-tokenised in one piece. A longer text is dealt out as chunks that overlap; each chunk is pre-tokenised on its own, in parallel, and the chunks of a text are stitched at the first boundary that both sides of an overlap share. Matches depend only on what follows them, so from a shared boundary on both sides agree. Where an overlap holds no shared boundary (a single match longer than it), matching goes on from the last known boundary until it meets the next chunk's boundaries, so results stay exact. The pieces are then encoded by the ranks; decoding concatenates the tokens' bytes.

A piece is encoded by joining the neighbours of the least rank until none can be joined. A null text counts as empty and gives no tokens. Repeated rows give repeated results; extra columns are ignored. A text's ids are one value of a row, so they must fit in one task.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, released, shards, starts_of, texts_of

CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Least overlap: a match near a chunk's end may look so many characters ahead (a contraction's letters, the end of white space).
LEAST_OVERLAP = 4
#: Pieces of more bytes are merged by a heap.
HEAP = 48
#: Entries that a worker keeps in its memo of encoded pieces; a full memo is emptied.
MEMO = 300_000
#: Vocabularies larger than this are refused, as they are broadcast.
MAX_VOCABULARY_BYTES = 64 << 20


_NONE = 1 << 62


class Codec:
    """Encodes pieces by merge ranks; made once in each worker from the vocabulary's bytes."""

    _made: dict = {}

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x.strip())}
        self.match = regex.compile(pattern)
        self.bytes = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        self.memo: dict[str, bytes] = {}

    @classmethod
    def of(cls, vocabulary: bytes, pattern: str) -> Codec:
        key = (hashlib.sha256(vocabulary).digest(), pattern)
        if key not in cls._made:
            cls._made = {key: cls(vocabulary, pattern)}
        return cls._made[key]

    def piece(self, p: str) -> bytes:
        """Token ids of a piece as little-endian 32-bit integers."""
        got = self.memo.get(p)
        if got is None:
            ids = self.merge(p.encode())
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(p) < 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[p] = got
        return got

    def merge(self, raw: bytes) -> list[int]:
        """Token ids of a piece: of the neighbours whose join is in the vocabulary, those of the least rank (the leftmost of equals) are joined, until there are none."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        if len(raw) > HEAP:
            return self._merge_long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        joins = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while joins:
            least = min(joins)
            if least == _NONE:
                break
            i = joins.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i < len(joins):
                joins[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
            if i:
                joins[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        return [ranks[x] for x in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same for a long piece, in time that hardly grows faster than it: candidates wait in a heap, stale ones are skipped."""
        ranks, n = self.ranks, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a place; 0 marks a start that is gone
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != e:
                continue
            end[i], end[middle] = e, 0
            if e < n:
                before[e] = i
                if (r := ranks.get(raw[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (j := before[i]) >= 0 and (r := ranks.get(raw[j:e])) is not None:
                heapq.heappush(heap, (r, j, e))
        return [ranks[raw[i:e]] for i, e in enumerate(end) if e]

    def ids(self, pieces: list[list[str]]) -> list[np.ndarray]:
        """Token ids of texts that are given as their pieces; each distinct piece is encoded once."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.empty(int(n.sum()), dtype=object)
        at = 0
        for p in pieces:
            flat[at : at + len(p)] = p
            at += len(p)
        codes, uniques = pd.factorize(flat)
        coded = [self.piece(u) for u in uniques]
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        table = np.frombuffer(b"".join(coded), "<u4")
        counts = size[codes]
        out = table[np.repeat(starts_of(size)[codes] - starts_of(counts), counts) + np.arange(int(counts.sum()))] if len(codes) else np.zeros(0, np.uint32)
        per = np.zeros(len(pieces), np.int64)
        np.add.at(per, np.repeat(np.arange(len(pieces)), n), counts)
        return np.split(out, np.cumsum(per)[:-1]) if len(pieces) else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for s, e in shards(texts, 1 << 20):
            out += self.ids([self.match.findall(t) for t in texts[s:e]])
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.asarray(ids).tolist()))

    def boundaries(self, text: str, last: bool) -> list[int]:
        """Starts of the matches in a chunk, and the end of the last one that is sure: without the text's end in sight, the match that touches the chunk's end is not."""
        starts = [m.start() for m in self.match.finditer(text)]
        return starts + [len(text)] if last else starts

    def stitch(self, chunks: list[tuple[int, str, list[int]]]) -> list[str]:
        """The pieces of a text from its chunks (offset, slice, boundaries), sorted by offset."""
        whole = "".join(c[: b[0] - a[0]] for a, b, c in ((x, y, x[1]) for x, y in zip(chunks, chunks[1:], strict=False))) + chunks[-1][1]
        cuts = [0]
        for k, (offset, _, starts) in enumerate(chunks):
            own = [offset + s for s in starts]
            if k:
                have = set(own)
                shared = next((c for c in cuts_new if c in have), None)
                if shared is None:  # go on from the last sure boundary until this chunk's boundaries are met
                    at = cuts_new[-1] if cuts_new else cuts[-1]
                    cuts += cuts_new[: -1 if cuts_new else 0]
                    end = own[-1]
                    while at not in have and at < len(whole):
                        cuts.append(at)
                        at = self.match.match(whole, at).end()
                        if at > end:
                            break
                    shared = at
                else:
                    cuts += [c for c in cuts_new if c < shared]
                own = [c for c in own if c >= shared] or [shared]
            nxt = chunks[k + 1][0] if k + 1 < len(chunks) else len(whole) + 1
            cuts += [c for c in own if c < nxt]
            cuts_new = [c for c in own if c >= nxt]
        cuts = sorted(set(cuts + cuts_new + [len(whole)]))
        return [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def encode(docs: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (bytes), or with ``digests`` their hex SHA-256 instead.

    ``vocabulary`` is the path of a rank file on the driver; its bytes are broadcast, at most MAX_VOCABULARY_BYTES.
    """
    spark = docs.sparkSession
    if overlap < LEAST_OVERLAP:
        raise ValueError(f"chunks must overlap by {LEAST_OVERLAP} characters at least")
    bounded_batches(spark)
    with open(vocabulary, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    sent = spark.sparkContext.broadcast(raw)
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kind = "string" if digests else "binary"
    schema = f"doc_id long, n_tokens long, {names[0]} {kind}, {names[1]} {kind}"

    def rows(codec, doc_ids, coded):
        made = [(x.astype("<u4").tobytes(), codec.decode(x)) for x in coded]
        if digests:
            made = [tuple(hashlib.sha256(v).hexdigest() for v in m) for m in made]
        ends = pa.string() if digests else pa.binary()
        return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) for x in coded], pa.int64()), pa.array([m[0] for m in made], ends), pa.array([m[1] for m in made], ends)], ["doc_id", "n_tokens", *names])

    def short(batches):
        codec = Codec.of(sent.value, pattern)
        for b in batches:
            yield rows(codec, b.column("doc_id"), codec.encode(texts_of(b.column("text"))))

    def pretokenise(batches):
        codec = Codec.of(sent.value, pattern)
        for b in batches:
            cuts = [np.array(codec.boundaries(p, last), "<i4").tobytes() for p, last in zip(b.column("piece").to_pylist(), b.column("last").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "doc_id", "start", "piece", "n")), pa.array(cuts, pa.binary())], ["key", "doc_id", "start", "piece", "n", "cuts"])

    def join(table: pa.Table) -> pa.Table:
        codec = Codec.of(sent.value, pattern)
        parts = sorted((r["start"], r["piece"], np.frombuffer(r["cuts"], "<i4").tolist()) for r in table.to_pylist())
        got = rows(codec, pa.array([table.column("doc_id")[0].as_py()], pa.int64()), codec.ids([codec.stitch(parts)]))
        return pa.Table.from_batches([got]).append_column("n", pa.array([table.column("n")[0].as_py()], pa.int64()))

    size = F.length("text")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = base.where(F.col("text").isNull() | (size <= chunk)).mapInArrow(released(short), schema)
    # A text's chunks meet by its digest; rows that repeat doc_id and text are counted as chunks and written out again at the end, so nothing depends on which task has read a row.
    long_ones = base.where(size > chunk).withColumn("key", F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), "text"), 256)))
    pieces = long_ones.select(
        "key", "doc_id", F.explode(F.sequence(F.lit(0), size - 1, F.lit(chunk))).alias("start"), "text",
    ).select("key", "doc_id", F.col("start").cast("long").alias("start"), F.substring("text", F.col("start") + 1, F.lit(chunk + overlap)).alias("piece"), (F.col("start") + chunk + overlap >= size).alias("last"))
    counted = pieces.groupBy("key", "start").agg(F.first("doc_id").alias("doc_id"), F.first("piece").alias("piece"), F.first("last").alias("last"), F.count("*").alias("n"))
    stitched = counted.mapInArrow(released(pretokenise), "key binary, doc_id long, start long, piece string, n long, cuts binary").groupBy("key").applyInArrow(join, schema + ", n long")
    again = stitched.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    return whole.unionByName(again)
