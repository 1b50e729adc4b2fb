"""Source divergence audit: how far the sources of a language differ from one another in their terms, and which terms set a source apart.

Terms are runs of letters (A-Z and everything beyond ASCII; only A-Z lower-cased). A language keeps the terms of at least ``least`` of its documents. Every group (lang, source) and every language gives each kept term a share p = 1 + floor(SCALE * (count + 1) / (N + V)), in whole numbers; f = floor((p - q)^2 / q) measures p against q. A pair's value is f summed over all kept terms, a term's value is f against its language.

Sort-based streaming. Tasks count the terms of what they read, in bounded memory, and send (lang, term, source, document, docs, count); rows are dealt by a hash of (lang, term), sorted by that hash, lang, term, source and document inside their partition and read in one pass, whose run lengths are document frequencies and counts. Only the last run is held over from batch to batch. Where there are many input tasks, a term's rows first go to as many partial runs as ``salts_of`` says, and runs of runs are taken again, so no task reads more than some thousands of rows of one term and source, however frequent it is. A second pass over the kept runs emits partial pairs and terms: of a term, only the sources that have it are paired (into one matrix a task); what the others add depends on a source's share alone and is taken once for each distinct share, so work grows with occurrences, not with terms times pairs of sources.

Null text, lang and source count as ''. Each row is a document, repeated rows too. Groups without terms stay, with a count of 0; a language without kept terms has pairs of value 0. Ties go to the smaller item by UTF-8. Extra columns are ignored; an empty table gives an empty result. The result holds every pair of sources of a language, so groups are bounded by ``MAX_GROUPS`` (an error beyond it); only their totals, one row a group, are sent to all tasks.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, buckets_of, cut, released, shards, texts_of, words_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 10**9
MAX_GROUPS = 100_000
#: Input tasks whose rows of one term meet in one partial run.
FAN_IN = 512
LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
COUNTS = "lang string, term string, source string, document long, docs long, count long"
#: Rows that a task counts together before it sends them.
FULL = 1 << 20


def salts_of(docs: DataFrame) -> int:
    """Into how many partial runs a term is dealt first."""
    return -(-buckets_of(docs) // FAN_IN)


class Counts:
    """Counts by (lang, source, term) of what a task has read, with the least doc_id; the empty term stands for the group itself."""

    def __init__(self):
        self.terms: dict[str, int] = {"": 0}
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, langs: list[str], sources: list[str], ids: list, texts: list[str]) -> None:
        group = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)), np.int64, len(texts))
        ids = np.array([-1 if i is None else i for i in ids], np.int64)
        for s, e in shards(texts, 2 << 20):
            codes, lengths, uniques = words_of(texts[s:e], TERM)
            lowered = (u.lower() if u.isascii() else u.translate(LOWER) for u in uniques)
            term = np.fromiter((self.terms.setdefault(u, len(self.terms)) for u in lowered), np.int64, len(uniques))
            own = np.concatenate((np.repeat(np.arange(s, e), lengths) << 40 | (term[codes] if len(codes) else codes), np.arange(s, e) << 40))
            own, n = np.unique(own, return_counts=True)
            doc, term = own >> 40, own & (1 << 40) - 1
            n[term == 0] = 0
            self._keep(group[doc] << 40 | term, np.ones(len(doc), np.int64), n, ids[doc])
        if self.size > FULL:
            merged = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.size = [], 0
            self._keep(*merged)

    def _keep(self, key, docs, count, first) -> None:
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.diff(key[order], prepend=-1))
        self.parts.append((key[order][at], np.add.reduceat(docs[order], at), np.add.reduceat(count[order], at), np.minimum.reduceat(first[order], at)))
        self.size += len(at)

    def full(self) -> bool:
        return self.size > FULL // 2

    def batches(self):
        """What was counted, as record batches; it is forgotten."""
        if self.parts:
            merged = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.size = [], 0
            self._keep(*merged)
            key, docs, count, first = self.parts[0]
            names = pa.array(list(self.terms), pa.string())
            langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
            for s in range(0, len(key), 1 << 16):
                group, term = pa.array(key[s : s + (1 << 16)] >> 40), pa.array(key[s : s + (1 << 16)] & (1 << 40) - 1)
                rest = [pa.array(x[s : s + (1 << 16)]) for x in (first, docs, count)]
                yield pa.RecordBatch.from_arrays([langs.take(group), names.take(term), sources.take(group), *rest], ["lang", "term", "source", "document", "docs", "count"])
        self.__init__()


def _counted(docs: DataFrame) -> DataFrame:
    def run(batches):
        held = Counts()
        for b in batches:
            held.add(texts_of(b.column("lang")), texts_of(b.column("source")), b.column("doc_id").to_pylist(), texts_of(b.column("text")))
            if held.full():
                yield from held.batches()
        yield from held.batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text").mapInArrow(released(run), COUNTS)


def _breaks(t: pa.Table, *names: str) -> np.ndarray:
    """Places where any of the columns differs from the row before; the first row counts."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for n in names:
        c = t.column(n).chunk(0)
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out)


def term_runs(batches, names: tuple[str, ...], sums: tuple[str, ...] = ("docs", "count")):
    """Tables of whole runs of ``names`` out of sorted batches, one row for each source in it with its sums, and the places where a run begins."""
    held, some, n = None, [], 0

    def merge():
        t = pa.concat_tables([*([held] if held is not None else []), *map(pa.Table.from_batches, ([b] for b in some))]).combine_chunks()
        at = _breaks(t, *names, "source")
        got = {c: pa.array(np.add.reduceat(t.column(c).to_numpy(), at)) for c in sums}
        if "document" in t.column_names:
            got["document"] = pa.array(np.minimum.reduceat(t.column("document").to_numpy(), at))
        rest = t.drop_columns(list(got)).take(pa.array(at))
        t = pa.table([got[c] if c in got else rest.column(c) for c in t.column_names], schema=t.schema).combine_chunks()
        return t, _breaks(t, *names)

    for b in batches:
        if not b.num_rows:
            continue
        some.append(b)
        n += b.num_rows
        if n < 1 << 14:
            continue
        t, term = merge()
        some, n, held = [], 0, t.slice(term[-1])
        if term[-1]:
            yield t.slice(0, term[-1]).combine_chunks(), term[:-1]
    if some or held is not None:
        yield merge()


def runs(docs: DataFrame, least: int = 3) -> DataFrame:
    """(lang, term, source, docs, count, first): the kept terms' runs, partitions holding whole terms in order; ``first`` marks a term's first source. The empty term holds every (lang, source) and its documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    salts = salts_of(docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets_of(docs, 64 << 20))
    rows, h = _counted(docs), F.xxhash64("lang", "term")  # the hash is made anew after a shuffle: as a column it would be a third of what travels
    if salts > 1:
        def merge(batches):
            for t, _ in term_runs(batches, ("h", "salt", "lang", "term")):
                yield from t.drop_columns(["salt", "h"]).to_batches()

        salted = rows.withColumn("salt", F.spark_partition_id() % salts).repartition(parts, "salt", h).withColumn("h", h)
        rows = salted.sortWithinPartitions("h", "salt", "lang", "term", "source", "document").mapInArrow(released(merge), COUNTS)

    def keep(batches):
        for t, term in term_runs(batches, ("h", "lang", "term")):
            sizes = np.diff(np.append(term, t.num_rows))
            df = np.add.reduceat(t.column("docs").to_numpy(), term)
            group = pc.equal(t.column("term"), "").to_numpy()
            first = np.zeros(t.num_rows, bool)
            first[term] = True
            t = t.append_column("first", pa.array(first & ~group))
            t = t.filter(pa.array(np.repeat(df >= least, sizes) | group)).select(["lang", "term", "source", "docs", "count", "first"])
            yield from t.to_batches()

    rows = rows.repartition(parts, h).withColumn("h", h).sortWithinPartitions("h", "lang", "term", "source", "document")
    return cut(rows.mapInArrow(released(keep), "lang string, term string, source string, docs long, count long, first boolean"))


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact at every size."""
    count, total = np.asarray(count), np.asarray(total)
    if count.size and int(count.max()) >= (1 << 63) // SCALE - 1:
        return np.array([1 + SCALE * (int(c) + 1) // int(t) for c, t in np.broadcast(count, total)], np.int64)
    return 1 + SCALE * (count + 1) // total


def against(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so squares fit."""
    return (p - q) ** 2 // q


class Lang:
    """The sources of a language, their totals N + V and shares of a count of 0."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["source"])
        self.sources = [r["source"] for r in rows]
        self.place = {s: i for i, s in enumerate(self.sources)}
        self.terms = sum(r["v"] for r in rows)
        self.total = np.array([r["n"] for r in rows], np.int64) + self.terms
        self.whole = int(self.total.sum() - len(rows) * self.terms + self.terms)
        self.none = share(np.zeros(len(rows), np.int64), self.total) if self.terms else np.ones(len(rows), np.int64)


def totals(kept: DataFrame) -> DataFrame:
    """(lang, source, n, v): words of kept terms, and kept terms that begin with this source (their sum is the language's number)."""
    return kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum(F.col("first").cast("long")).alias("v"))


class Partials:
    """What a task has gathered for one language: pairs of sources that share terms (a matrix where the language has few sources), shares by source, and the best terms of each source."""

    #: Largest side of a matrix, rows that are gathered before they are given out, and pairs of one step.
    SIDE, FULL, STEP = 512, 1 << 20, 1 << 18

    def __init__(self, name: str, lang: Lang, top: int):
        self.name, self.lang, self.top = name, lang, top
        n = len(lang.sources)
        self.matrix = np.zeros(n * n, np.int64) if n <= self.SIDE else None
        self.loose: list[tuple[np.ndarray, np.ndarray]] = []
        self.shares: list[tuple[np.ndarray, np.ndarray]] = []
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.floor = np.zeros(n, np.int64)
        self.n_loose = self.n_shares = self.n_best = 0

    def add(self, terms: np.ndarray, place: np.ndarray, count: np.ndarray, starts: np.ndarray) -> None:
        """Whole terms: their rows (term, place of the source, count) one after another; ``starts`` is where each term begins."""
        g = self.lang
        sizes = np.diff(np.append(starts, len(place)))
        p = share(count, g.total[place])
        q = np.repeat(share(np.add.reduceat(count, starts), g.whole), sizes)
        value = against(p, q)
        own = np.flatnonzero((p > q) & (value >= self.floor[place]))
        self.best.append((place[own], value[own], terms[own]))
        self.n_best += len(own)
        if self.n_best > 1 << 17:
            self._trim()
        self.shares.append((place, p))
        self.n_shares += len(place)
        for a in np.unique(sizes[sizes > 1]).tolist():
            at = starts[sizes == a]
            each, rows = max(self.STEP // (a * a), 1), min(a, max(self.STEP // a, 1))
            for s in range(0, len(at), each):
                row = at[s : s + each, None] + np.arange(a)
                for r in range(0, a, rows):
                    self._pair(place[row[:, r : r + rows]], p[row[:, r : r + rows]], place[row], p[row])

    def _pair(self, a, pa_, b, pb) -> None:
        none, n = self.lang.none, len(self.lang.sources)
        left, right, alone, other = pa_[:, :, None], pb[:, None, :], none[a][:, :, None], none[b][:, None, :]
        more = against(left, right) - against(left, other) - against(alone, right) + against(alone, other)
        code = a[:, :, None] * n + b[:, None, :]
        more[code % (n + 1) == 0] = 0  # a source with itself
        if self.matrix is not None:
            np.add.at(self.matrix, code.ravel(), more.ravel())
        else:
            self.loose.append((code.ravel(), more.ravel()))
            self.n_loose += more.size

    def _trim(self) -> None:
        d = pd.DataFrame(dict(zip(("place", "value", "term"), (np.concatenate(x) for x in zip(*self.best, strict=True)), strict=True)))
        d = d.sort_values(["place", "value", "term"], ascending=[True, False, True], kind="stable")
        d = d[d.groupby("place").cumcount() < self.top]
        full = d.groupby("place").value.agg(["size", "min"])
        full = full[full["size"] >= self.top]
        self.floor[full.index.to_numpy(np.int64)] = full["min"].to_numpy(np.int64)
        self.best, self.n_best = [(d.place.to_numpy(np.int64), d.value.to_numpy(np.int64), d.term.to_numpy(object))], len(d)

    def full(self) -> bool:
        return self.n_loose > self.FULL or self.n_shares > self.FULL

    def rows(self):
        """(kind, source, item, value) of what was gathered, which is then forgotten."""
        g, n = self.lang, len(self.lang.sources)
        pair = lambda code, value: (("pair", g.sources[c // n], g.sources[c % n], v) for c, v in zip(code.tolist(), value.tolist(), strict=True) if v)
        if self.loose:
            code, at = np.unique(np.concatenate([x[0] for x in self.loose]), return_inverse=True)
            value = np.zeros(len(code), np.int64)
            np.add.at(value, at, np.concatenate([x[1] for x in self.loose]))
            yield from pair(code, value)
        if self.shares:
            place, p = (np.concatenate(x) for x in zip(*self.shares, strict=True))
            both, many = np.unique(np.stack((place, p)), axis=1, return_counts=True)
            for a in np.unique(both[0]).tolist():
                here = both[0] == a
                mine, theirs = np.zeros(n, np.int64), np.zeros(n, np.int64)
                alone, step = g.none[a], max(self.STEP // n, 1)
                for s in range(0, int(here.sum()), step):
                    x, m = both[1][here][s : s + step, None], many[here][s : s + step, None]
                    mine += (m * (against(x, g.none) - against(alone, g.none))).sum(0)
                    theirs += (m * (against(g.none, x) - against(g.none, alone))).sum(0)
                mine[a] = theirs[a] = 0
                if self.matrix is not None:
                    self.matrix[a * n : (a + 1) * n] += mine
                    self.matrix[a::n] += theirs
                else:
                    yield from pair(a * n + np.arange(n), mine)
                    yield from pair(np.arange(n) * n + a, theirs)
        if self.matrix is not None:
            held = np.flatnonzero(self.matrix)
            yield from pair(held, self.matrix[held])
            self.matrix[:] = 0
        if self.best:
            self._trim()
            place, value, term = self.best[0]
            yield from (("term", g.sources[i], t, v) for i, v, t in zip(place.tolist(), value.tolist(), term, strict=True))
        self.loose, self.shares, self.best = [], [], []
        self.n_loose = self.n_shares = self.n_best = 0


PARTS = "lang string, part string, source string, item string, value long"


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source the other sources of its language (part pair) and its ``top`` own terms (part term), by value."""
    kept = runs(docs, least)
    known = totals(kept).limit(MAX_GROUPS + 1).collect()
    if len(known) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of lang and source: the pairs of sources would outgrow the table")
    rows: dict[str, list] = {}
    for r in known:
        rows.setdefault(r["lang"], []).append({"source": r["source"], "n": r["n"], "v": r["v"]})
    send = docs.sparkSession.sparkContext.broadcast(rows)

    def told(lang: str, found):
        for some in _chunks(found, 4096):
            kind, source, item, value = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(kind), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "part", "source", "item", "value"])

    def second(batches):
        now: dict[str, Partials] = {}
        for t, starts in term_runs(batches, ("lang", "term"), ("count",)):
            lang = t.column("lang").combine_chunks().dictionary_encode()
            term, source, count = t.column("term").to_numpy(), t.column("source").combine_chunks(), t.column("count").to_numpy()
            of = lang.indices.to_numpy()
            sizes = np.diff(np.append(starts, len(of)))
            for k, name in enumerate(lang.dictionary.to_pylist()):
                mine = (of[starts] == k) & (term[starts] != "")
                if not mine.any():
                    continue
                if name not in now:
                    now[name] = Partials(name, Lang(send.value[name]), top)
                part = now[name]
                row = np.flatnonzero(np.repeat(mine, sizes))
                spelt = source.take(pa.array(row)).dictionary_encode()
                place = np.array([part.lang.place[s] for s in spelt.dictionary.to_pylist()], np.int64)[spelt.indices.to_numpy()]
                own = sizes[mine]
                part.add(term[row], place, count[row], np.cumsum(own) - own)
                if part.full():
                    yield from told(name, part.rows())
        for name, part in now.items():
            yield from told(name, part.rows())

    def level(batches):
        """Each pair of sources as if neither had any term."""
        known: dict[str, Lang] = {}
        for b in batches:
            for lang, source in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True):
                g = known[lang] = known.get(lang) or Lang(send.value[lang])
                values = g.terms * against(g.none[g.place[source]], g.none)
                yield from told(lang, (("pair", source, s, v) for s, v in zip(g.sources, values.tolist(), strict=True) if s != source))

    parts = cut(kept.mapInArrow(released(second), PARTS))
    pairs = kept.where("term = ''").select("lang", "source").mapInArrow(released(level), PARTS).union(parts.where("part = 'pair'"))
    pairs = pairs.groupBy("lang", "source", "part", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs).union(ranked(parts.where("part = 'term'")).where(F.col("rank") <= top))


def _chunks(rows, size: int):
    some = []
    for r in rows:
        some.append(r)
        if len(some) == size:
            yield some
            some = []
    if some:
        yield some
