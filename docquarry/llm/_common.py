"""Helpers shared by the corpus operators: batches, words, hashes, bounded label samples."""

from __future__ import annotations

import contextlib
import ctypes
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut as cut
from ..session import ship

#: A word is a run of characters that are not ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


#: Bounds of an Arrow batch, the same for every operator, so that the order in which plans are built changes nothing.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, by rows and by bytes, and give the workers this package. A session whose bounds are tighter keeps them."""
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"([1-9]\d*)b?", spark.conf.get(key))
        if not now or int(now[1]) > most:
            spark.conf.set(key, most)


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run):
    """A function over batches that gives what it has freed back to the system when its partition ends: workers live on, and what they keep adds up over the stages of a job."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def buckets_of(docs: DataFrame, each: int = 8 << 20) -> int:
    """Number of hash buckets so that one holds about ``each`` bytes of input, whatever the size of the table; at least the session's shuffle partitions.

    The size is the planner's (the files' bytes for a scan); where it knows none, the bytes of the texts are summed up.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 56:
        size = int(docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0)
    return max(least, -(-size // each))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts_of(column) -> list[str]:
    """Texts of an Arrow column; a null text is the empty one."""
    return [t or "" for t in column.to_pylist()]


def shards(texts: list[str], most: int = 4 << 20):
    """Slices (start, end) of consecutive texts of about ``most`` characters in all; no text is cut."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def words_of(texts: list[str], pattern: re.Pattern = WORD, lower: bool = False):
    """(codes, lengths, uniques): the texts' words one after another as codes into uniques, and each text's number of words."""
    found = [pattern.findall(t.lower() if lower else t) for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.empty(int(lengths.sum()), dtype=object)
    at = 0
    for w in found:
        flat[at : at + len(w)] = w
        at += len(w)
    codes, uniques = pd.factorize(flat)
    return codes.astype(np.int64), lengths, uniques


def word_hashes(uniques, seed: int = 0) -> np.ndarray:
    """64-bit hashes of distinct words."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in uniques), np.uint64, len(uniques))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers with good avalanche."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def doc_key(text="text"):
    """Digest of a whole text; a null text counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def remainder(n: int):
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def label_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int, extra: tuple = ()) -> DataFrame:
    """At most ``most`` labelled documents (doc_id, text, y) whose remainder is not ``held``, the first in the order of a hash of doc_id.

    The sampled labels are bounded by ``most``, so they are broadcast and the texts are not shuffled. Of labels that contradict one another for a doc_id the greater holds. Of several rows of one doc_id the one whose text has the least hash is taken, so never more than ``most`` rows come to the driver.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(mod) != held))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra).join(F.broadcast(picked.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    one = F.min_by(F.struct("text", "y", *extra), F.xxhash64("text", *extra)).alias("d")
    return found.groupBy("doc_id").agg(one).select("doc_id", "d.*")


def fresh(names, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of a table's, whatever their case."""
    taken = {n.lower() for n in names}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out
