"""Periodic runs: stretches of words that repeat with one period, found exactly, and texts collapsed to one period of each.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least ``max(least, exponent * q)`` that no neighbouring word extends. Its words after the first q are dropped from the collapsed text.

Two exact steps, both inside the row's own task; nothing is shuffled. First, stretches that cannot hold a run leave: inside a run every five words come again one period away, so a word stays a candidate only in a stretch of such repeats whose nearest twin lies within a quarter of the stretch; this is vectorised over a batch and repeated while it shrinks. Then each remaining stretch gets a suffix automaton. Its states are visited from the longest, end positions of children are merged small to large as ordered sets, and of every newly inserted position the distances to its neighbours are taken: where a distance does not exceed the share of the state's length that the exponent asks for, two neighbouring occurrences overlap to a power, which seeds a run; seeds are extended word by word, once for each run.

Nulls and texts without words have no runs. A null doc_id counts as the empty text where a rewriting asks for it. Repeated rows give repeated rows; extra columns are ignored; an empty table gives an empty result. Ties for the greatest exponent go to the smallest start, then the smallest period. Texts are never cut: a text is one row, and its automaton holds about 32 bytes a state.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, bounded_batches, mix64, released, shards, texts_of

#: Most words of a gram whose repetition candidates need.
GRAM = 5
RUNS = "array<struct<start: long, length: long, period: long>>"


def shared(exponent: int, least: int) -> int:
    """Words that any run has in common with itself one period on, at least: the least ``max(least, exponent * q) - q`` over all periods q."""
    q = least // exponent
    return min(least - q, (exponent - 1) * (q + 1))


class Ordered:
    """An ordered set of integers in blocks, so that an insertion moves a block at most."""

    __slots__ = ("blocks", "heads", "size")
    LOAD = 1024

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def __len__(self) -> int:
        return self.size

    def __iter__(self):
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> None:
        k = max(bisect_right(self.heads, x) - 1, 0)
        block = self.blocks[k]
        insort(block, x)
        self.heads[k] = block[0]
        self.size += 1
        if len(block) > self.LOAD:
            half = len(block) // 2
            self.blocks.insert(k + 1, block[half:])
            self.heads.insert(k + 1, block[half])
            del block[half:]

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The neighbours of a member."""
        k = bisect_right(self.heads, x) - 1
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.blocks[k - 1][-1] if k else None
        after = block[i + 1] if i + 1 < len(block) else self.heads[k + 1] if k + 1 < len(self.heads) else None
        return before, after


class Automaton:
    """The suffix automaton of a sequence of codes. A state's first transition is kept in arrays, further ones in a table, as most states of a periodic text have one."""

    def __init__(self, codes: list[int]):
        self.length, self.link, self.end = array("q", [0]), array("q", [-1]), array("q", [-1])
        self.code, self.to = array("q", [-1]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        last = 0
        for i, c in enumerate(codes):
            last = self._extend(last, c, i)

    def _state(self, length: int, link: int, end: int) -> int:
        for column, value in ((self.length, length), (self.link, link), (self.end, end), (self.code, -1), (self.to, -1)):
            column.append(value)
        return len(self.length) - 1

    def _next(self, s: int, c: int) -> int:
        if self.code[s] == c:
            return self.to[s]
        more = self.more.get(s)
        return more.get(c, -1) if more else -1

    def _put(self, s: int, c: int, t: int) -> None:
        if self.code[s] in (-1, c):
            self.code[s], self.to[s] = c, t
        else:
            self.more.setdefault(s, {})[c] = t

    def _extend(self, last: int, c: int, i: int) -> int:
        new = self._state(self.length[last] + 1, 0, i)
        s = last
        while s >= 0 and self._next(s, c) < 0:
            self._put(s, c, new)
            s = self.link[s]
        if s < 0:
            return new
        t = self._next(s, c)
        if self.length[t] == self.length[s] + 1:
            self.link[new] = t
            return new
        twin = self._state(self.length[s] + 1, self.link[t], -1)
        self.code[twin], self.to[twin] = self.code[t], self.to[t]
        if t in self.more:
            self.more[twin] = dict(self.more[t])
        while s >= 0 and self._next(s, c) == t:
            self._put(s, c, twin)
            s = self.link[s]
        self.link[t] = self.link[new] = twin
        return new

    def neighbours(self, least: int):
        """(length, before, after) of end positions that become neighbours in a state of length ``least`` or more: each such pair where it first comes together."""
        order = np.argsort(-np.frombuffer(self.length, np.int64), kind="stable").tolist()
        sets: dict[int, Ordered] = {}
        fresh: dict[int, list[int]] = {}
        for s in order:
            size = self.length[s]
            if size < least:
                return
            held, new = sets.pop(s, None), fresh.pop(s, [])
            if self.end[s] >= 0:
                if held is None:
                    held = Ordered(self.end[s])
                else:
                    held.add(self.end[s])
                new.append(self.end[s])
            for x in new:
                before, after = held.around(x)
                if before is not None:
                    yield size, before, x
                if after is not None:
                    yield size, x, after
            up = self.link[s]
            if self.length[up] < least:
                continue
            into = sets.get(up)
            if into is None:
                sets[up] = held
            elif len(into) >= len(held):
                fresh.setdefault(up, []).extend(held)
                for x in held:
                    into.add(x)
            else:
                fresh[up] = list(into)
                for x in into:
                    held.add(x)
                sets[up] = held


def runs_of(codes: list[int], exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of codes, by start, then period."""
    n = len(codes)
    found: dict[int, tuple[list[int], list[int]]] = {}
    for size, before, x in Automaton(codes).neighbours(shared(exponent, least)):
        q = x - before
        if (exponent - 1) * q > size:
            continue
        starts, ends = found.setdefault(q, ([], []))
        s, e = before - size + 1, x
        k = bisect_right(starts, s) - 1
        if k >= 0 and ends[k] >= e:
            continue
        while s > 0 and codes[s - 1] == codes[s - 1 + q]:
            s -= 1
        while e + 1 < n and codes[e + 1] == codes[e + 1 - q]:
            e += 1
        k = bisect_left(starts, s)
        starts.insert(k, s)
        ends.insert(k, e)
    out = [(s, e - s + 1, q) for q, (starts, ends) in found.items() for s, e in zip(starts, ends, strict=True) if e - s + 1 >= max(least, exponent * q)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, lengths: np.ndarray, exponent: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) places of the stretches of a batch's texts that may hold runs; every run of at least ``max(least, exponent * q)`` words lies inside one."""
    ends = np.cumsum(lengths)
    first, end = ends - lengths, ends
    q = least // exponent
    # any gram of a run of length L comes again q words before or after it inside the run as long as gram <= L - 2q + 1
    gram = min(GRAM, least - 2 * q + 1, (exponent - 2) * (q + 1) + 1)
    h = np.zeros(max(len(codes) - gram + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mix64(codes[k : k + len(h)].astype(np.uint64) + np.uint64(1))
        total = -1
        while True:
            keep = end - first >= least
            first, end = first[keep], end[keep]
            size = end - first
            if size.sum() == total or not len(first):
                return first, end
            total = size.sum()
            grams = size - gram + 1
            seg = np.repeat(np.arange(len(first)), grams)
            at = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(first, grams)
            key = h[at] ^ mix64(seg.astype(np.uint64) + np.uint64(0x51ED27))
            order = np.argsort(key, kind="stable")
            near = (key[order[1:]] == key[order[:-1]]) & (at[order[1:]] - at[order[:-1]] <= size[seg[order[1:]]] // exponent)
            hit = np.zeros(len(at), bool)
            hit[order[1:][near]] = True
            hit[order[:-1][near]] = True
            got = np.flatnonzero(hit)
            if not len(got):
                return got, got
            breaks = np.flatnonzero((np.diff(at[got]) != 1) | (np.diff(seg[got]) != 0)) + 1
            first = at[got[np.concatenate(([0], breaks))]]
            end = at[got[np.concatenate((breaks - 1, [len(got) - 1]))]] + gram


def plant(doc_id, words: list[str]) -> list[str]:
    """The words with a periodic tail in one document of ten, chosen by its id: known cases for a check."""
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _texts(ids: list, texts: list[str], exponent: int, least: int, rewrite: Callable | None):
    """(words, runs) of each text."""
    for start, stop in shards(texts, 2 << 20):
        words = [WORD.findall(t) for t in texts[start:stop]]
        if rewrite:
            words = [rewrite(i, w) for i, w in zip(ids[start:stop], words, strict=True)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.empty(int(lengths.sum()), dtype=object)
        begins = np.cumsum(lengths) - lengths
        for b, w in zip(begins.tolist(), words, strict=True):
            flat[b : b + len(w)] = w
        codes = pd.factorize(flat)[0].astype(np.int64)
        runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
        first, end = stretches(codes, lengths, exponent, least)
        owner = np.searchsorted(begins, first, side="right") - 1
        # texts without words share a place with the next one; the last text that begins there is the one with words
        for f, e, d in zip(first.tolist(), end.tolist(), owner.tolist(), strict=True):
            base = f - int(begins[d])
            runs[d] += [(s + base, size, q) for s, size, q in runs_of(codes[f:e].tolist(), exponent, least)]
        yield from zip(words, runs, strict=True)


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run drops."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for s, size, q in runs:
        keep[s + q : s + size] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _first(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length/period."""
    top = None
    for r in runs:
        if top is None or (r[1] * top[2], -r[0], -r[2]) > (top[1] * r[2], -top[0], -top[2]):
            top = r
    return top


def runs(docs: DataFrame, exponent: int = 4, least: int = 6, rewrite: Callable | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed, the kept words joined by single spaces. ``rewrite(doc_id, words)`` may change a text's words before."""
    _check(exponent, least)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for i, (words, found) in zip(ids, _texts(ids, texts_of(b.column("text")), exponent, least, rewrite), strict=True):
                one = [{"start": s, "length": size, "period": q} for s, size, q in found]
                yield pa.RecordBatch.from_pylist([{"doc_id": i, "n_words": len(words), "runs": one, "collapsed": " ".join(kept_words(words, found))}], schema=schema)

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", kind), ("collapsed", pa.string())])
    return _rows(docs).mapInArrow(released(run), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


DIGESTS = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, n_kept long, runs_sha256 string, collapsed_sha256 string"


def digests(docs: DataFrame, exponent: int = 4, least: int = 6, rewrite: Callable | None = None) -> DataFrame:
    """The same in short: how many runs, the one with the greatest exponent, and digests of all runs and of the collapsed text."""
    _check(exponent, least)
    bounded_batches(docs.sparkSession)
    names = [c.split(" ")[0] for c in DIGESTS.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGESTS.split(", ")]

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            out = []
            for i, (words, found) in zip(ids, _texts(ids, texts_of(b.column("text")), exponent, least, rewrite), strict=True):
                kept, top = kept_words(words, found), _first(found)
                told = "".join(f"{s},{size},{q}\n" for s, size, q in found)
                best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
                out.append((i, len(words), len(found), *best, len(kept), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()))
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return _rows(docs).mapInArrow(released(run), DIGESTS)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _check(exponent: int, least: int) -> None:
    if exponent < 2 or least < exponent:
        raise ValueError("exponent must be 2 or more, and least the exponent or more")
