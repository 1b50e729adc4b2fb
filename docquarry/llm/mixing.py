"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the schedule is the point i * golden ratio mod 1, mapped through the cumulative target weights to a source; slots are ranked in their source. Each source's documents, shuffled by a hash and shuffled anew for a second pass, form a stream of words that is cut into equal blocks; the block of rank r is joined to the source's slot of rank r. A source takes its target to the word: its last block is cut there, ranks that the schedule lacks are appended after it, and slots beyond the target stay unused.

Sizes are numbers of words; a null text has none and takes no part in the streams (it is listed with 0 words). A null source is a source of its own, the last. Rows that repeat are documents of their own with the same key; whichever comes first in the stream, the results are the same set of rows. An empty table gives no rows. Extra columns are ignored by ``mix``; ``resample`` passes them through.

The table of sources (one row each, at most MAX_SOURCES) comes to the driver for the targets; documents never do. Positions in a stream are sums over hash buckets of a source plus sums within a bucket; the number of buckets follows the largest source, so a source with a third of all rows spreads over as many tasks as it needs. Rows are known by a 128-bit digest of doc_id, source and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, cut, fresh, released

BLOCK = 256
MAX_SOURCES = 100_000
#: Words that a hash bucket of a source's stream holds about, and the bits of the fewest and the most buckets that a source has.
BUCKET_WORDS, LEAST_BITS, MOST_BITS = 1 << 20, 8, 20
CHUNK = 1 << 15
GOLDEN = 0x9E3779B97F4A7C15
WEIGHTS = (3, 1, 2)


def targets(sizes: dict, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict:
    """Words that each source is to give: weights repeat over the sources by code point (null last), in all ``share`` times the sizes; a target above ``most`` times its source's size stops there and the excess is shared again by weight."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    out: dict = {}
    open_ = list(names)
    while open_:
        left = total - sum(out.values())
        by = sum(weight[s] for s in open_)
        want = {s: left * weight[s] / by for s in open_}
        over = [s for s in open_ if want[s] > most * sizes[s]]
        if not over:
            out |= want
            break
        out |= {s: float(most * sizes[s]) for s in over}
        open_ = [s for s in open_ if s not in out]
    return {s: max(0.0, float(out[s])) for s in names}


def _key():
    """128-bit digest of doc_id, source and text; a null differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "source", "text")]
    return F.unhex(F.md5(F.concat_ws("\0", *parts)))


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, k (a key of the row), size for every document; cut, as all later steps start from it."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("k", pa.binary()), ("size", pa.int64())])

    def run(batches):
        for b in batches:
            n = [len(t.split()) if t else 0 for t in b.column("text").cast(pa.large_binary()).to_pylist()]  # bytes.split() parts at ASCII white space
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source").cast(pa.string()), b.column("k"), pa.array(n, pa.int64())], schema=schema)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _key().alias("k"), "text")
    return cut(base.mapInArrow(released(run), "doc_id long, source string, k binary, size long"))


def _streams(sized: DataFrame, plan: DataFrame, bits: int) -> DataFrame:
    """sized with src, source_size, target, quota, pos0 and, for each pass that its source needs, at: where the document starts in its source's stream."""
    both = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["name"])).drop("name")
    h = [F.xxhash64(F.lit(s), "k") for s in (11, 23)]
    passes = both.select("*", F.explode(F.array(*(F.struct(F.lit(p).alias("pass"), h[p].alias("h")) for p in (0, 1)))).alias("p")).select("*", "p.pass", "p.h", F.shiftrightunsigned("p.h", 64 - bits).alias("bucket")).drop("p")
    passes = passes.where((F.col("pass") == 0) | (F.col("quota") > F.col("source_size")))
    sums = passes.groupBy("src", "pass", "bucket").agg(F.sum("size").alias("b_size"))
    before = sums.select("src", "pass", "bucket", (F.sum("b_size").over(Window.partitionBy("src", "pass").orderBy("bucket")) - F.col("b_size")).alias("b_at"))
    w = Window.partitionBy("src", "pass", "bucket").orderBy("h", "doc_id", "k", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = passes.withColumn("own", F.sum("size").over(w) - F.col("size")).join(before, ["src", "pass", "bucket"])
    return placed.withColumn("at", F.col("b_at") + F.col("own") + F.col("pass") * F.col("source_size")).drop("b_at", "own", "bucket", "h")


def slots(spark, quotas: list[int], block: int = BLOCK) -> DataFrame:
    """src, rank, slot: the schedule's slots, ranked in their source."""
    need = [-(-q // block) for q in quotas]
    n = sum(need)
    share = np.cumsum([float(x) for x in need]) / max(n, 1)
    edges = np.array([min(int(x * 2.0**64), 2**64 - 1) for x in share[:-1]], np.uint64)
    schema = pa.schema([("chunk", pa.int64()), ("src", pa.int32()), ("own", pa.int64()), ("slot", pa.int64())])

    def run(batches):
        for b in batches:
            for c in b.column("id").to_pylist():
                i = np.arange(c * CHUNK, min((c + 1) * CHUNK, n), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    src = np.searchsorted(edges, (i + np.uint64(1)) * np.uint64(GOLDEN), side="right")
                order = np.argsort(src, kind="stable")
                own = np.empty(len(src), np.int64)
                counts = np.bincount(src, minlength=len(need))
                own[order] = np.arange(len(src)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), c)), pa.array(src.astype(np.int32)), pa.array(own), pa.array(i.astype(np.int64))], schema=schema)

    made = spark.range(-(-n // CHUNK)).mapInArrow(released(run), "chunk long, src int, own long, slot long")
    counts = made.groupBy("chunk", "src").agg(F.count("*").alias("c"))
    before = counts.select("chunk", "src", (F.sum("c").over(Window.partitionBy("src").orderBy("chunk")) - F.col("c")).alias("b"))
    # A range of a few chunks makes many slots, so the size that the planner expects is far too small: no broadcast of slots.
    return made.hint("merge").join(before, ["chunk", "src"]).select("src", (F.col("b") + F.col("own")).alias("rank"), "slot")


def _prepare(docs: DataFrame, weights, share, most):
    sized = _sizes(docs)
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: int(r["size"]) for r in found}
    want = targets(sizes, weights, share, most)
    quotas = [min(int(t + 0.5), int(most * sizes[s])) for s, t in want.items()]
    plan = docs.sparkSession.createDataFrame([(s, i, sizes[s], float(t), q) for i, ((s, t), q) in enumerate(zip(want.items(), quotas, strict=True))], "name string, src int, source_size long, target double, quota long")
    return sized, plan, quotas


def _schedule(sized: DataFrame, plan: DataFrame, quotas: list[int], block: int) -> DataFrame:
    bits = min(MOST_BITS, max(LEAST_BITS, (max(quotas, default=0) // BUCKET_WORDS).bit_length()))
    placed = _streams(sized, plan, bits).where((F.col("size") > 0) & (F.col("at") < F.col("quota")))
    end = F.least(F.col("at") + F.col("size"), F.col("quota"))
    parts = placed.select("doc_id", "k", "src", "pass", "at", end.alias("end"), F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block))).alias("rank"))
    joined = parts.join(slots(sized.sparkSession, quotas, block).hint("merge"), ["src", "rank"], "left")
    n = sum(-(-q // block) for q in quotas)
    first = F.greatest(F.col("rank") * block, F.col("at"))
    return joined.select(
        F.coalesce("slot", F.col("rank") + F.lit(n)).alias("slot"), "src", "rank", "doc_id", "k", "pass", (first - F.col("at")).alias("from_word"), (F.least((F.col("rank") + 1) * block, "end") - F.col("at")).alias("to_word"),
    )


def schedule(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """The mix itself: slot, src (the source's place), rank, doc_id, k, pass, from_word, to_word. Read in the order of slot, it interleaves the sources."""
    return _schedule(*_prepare(docs, weights, share, most), block)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """doc_id, k, size, source_size, target, taken for every document: the words that the schedule takes from it. ``most`` is at most 2, as a stream has two passes."""
    sized, plan, quotas = _prepare(docs, weights, share, most)
    taken = _schedule(sized, plan, quotas, block).groupBy("k").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("words"))
    # Rows that repeat have one key and one size; each gets its equal part of the words, the remainder going to the first.
    same = sized.groupBy("k").agg(F.count("*").alias("n"))
    base = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["name"]))
    repeated = same.where("n > 1")
    once = base.join(repeated, "k", "left_anti").withColumns({"n": F.lit(1).cast("long"), "i": F.lit(0).cast("long")})
    again = base.dropDuplicates(["k"]).join(repeated, "k").select(*base.columns, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    words = F.coalesce("words", F.lit(0).cast("long"))
    part = F.floor(words / F.col("n")) + F.when(F.col("i") < words % F.col("n"), 1).otherwise(0)
    return once.unionByName(again).join(taken, "k", "left").select("doc_id", "k", "size", "source_size", "target", part.cast("long").alias("taken"))


def resample(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, columns unchanged: each as often as the mix takes its words, to the nearest whole pass (0, 1 or 2).

    A source's stream takes documents whole, pass by pass, up to its target, where it cuts one document in two; only that one is rounded. So a source's words differ from its target by half of one document at most, and the texts need not be cut. Rows that repeat doc_id, source and text come as often as all of them together are taken. Documents without words are never taken.
    """
    k, n, copies, i, j = fresh(docs.columns, "k", "n", "copies", "i", "j")
    taken = mix(docs, **how).where("size > 0").groupBy("k").agg(F.count("*").alias("rows"), F.round(F.sum("taken") / F.max("size")).cast("long").alias("times")).where("times > 0")
    taken = cut(taken.select(F.col("k").alias(k), F.col("rows").alias(n), F.col("times").alias(copies)))
    keyed = docs.withColumn(k, _key())
    out = keyed.join(taken.where(F.col(n) == 1), k)
    several = taken.where(F.col(n) > 1)
    if not several.isEmpty():  # one row stands for its repeats, brought together before the shuffle
        whole = F.struct(*(F.col(c) for c in docs.columns))
        rows = keyed.join(several, k).groupBy(k).agg(F.first(whole).alias(i), F.first(n).alias(n), F.first(copies).alias(copies))
        out = out.unionByName(rows.select(k, n, copies, *(F.col(f"{i}.`{c}`").alias(c) for c in docs.columns)))
    # Two steps, so that no array is long.
    half = out.withColumn(i, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / 1024))))
    full = half.withColumn(j, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1024).cast("long"), F.col(copies) - F.col(i) * 1024))))
    return full.select(*docs.columns)
