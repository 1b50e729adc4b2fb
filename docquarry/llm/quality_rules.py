"""Quality rules as a bitmask ledger: every rule is evaluated once, failures are bits, measurements are kept; policies are applied afterwards.

``ledger`` measures every whole text once and stores the bits of the rules that it fails. ``apply_policy`` turns the bits into verdicts under a versioned policy, and ``ablation`` counts by bitwise aggregation what each rule alone decides, without measuring again.

Nulls and empty texts have no words and fail the rule of too few words. Texts are never cut; repeated rows give repeated ledger rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, bounded_batches, released, shards, texts_of, words_of

SYMBOLS = "#*$%&|<>"
#: Measurements of a text, all long.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_lines", "n_bare_words")


def _share(part: str, whole: str, percent: int) -> Column:
    return F.col(part) * 100 > F.col(whole) * percent


def rules() -> tuple[tuple[str, Column], ...]:
    """Names and failure conditions; the place in this list is the bit. New rules are appended, so that old bits keep their meaning."""
    return (
        ("few_words", F.col("n_words") < 50),
        ("repeated_words", _share("n_repeat_words", "n_words", 50)),
        ("symbols", _share("n_symbols", "n_words", 10)),
        ("upper_words", _share("n_upper_words", "n_words", 50)),
        ("bare_words", _share("n_bare_words", "n_words", 30)),
        ("dup_lines", _share("n_dup_lines", "n_lines", 50)),
        ("word_length", (F.col("word_chars") > F.col("n_words") * 20) | (F.col("word_chars") < F.col("n_words") * 2)),
    )


#: Policies by version: the names of the rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "full-1": ("few_words", "repeated_words", "symbols", "upper_words", "bare_words", "dup_lines", "word_length"),
}


def mask_of(policy: str) -> int:
    names = [n for n, _ in rules()]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def _repeats(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text, words that lie in a 3-word window found twice or more in it."""
    n, out = len(codes), np.zeros(len(lengths), np.int64)
    if n < 3:
        return out
    doc = np.repeat(np.arange(len(lengths)), lengths)
    own = np.flatnonzero(doc[2:] == doc[:-2])
    if not len(own):
        return out
    order = np.lexsort((codes[own + 2], codes[own + 1], codes[own], doc[own]))
    at = own[order]
    same = (doc[at[1:]] == doc[at[:-1]]) & (codes[at[1:]] == codes[at[:-1]]) & (codes[at[1:] + 1] == codes[at[:-1] + 1]) & (codes[at[1:] + 2] == codes[at[:-1] + 2])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[at[twice] + k] = True
    return np.bincount(doc[hit], minlength=len(lengths))


def measure(texts: list[str]) -> list[np.ndarray]:
    """The measurements of whole texts, in the order of MEASURES."""
    parts = []
    for s, e in shards(texts, 2 << 20):
        some = texts[s:e]
        codes, lengths, uniques = words_of(some)
        doc = np.repeat(np.arange(len(some)), lengths)
        per = lambda f: np.bincount(doc, weights=np.fromiter(map(f, uniques), np.float64, len(uniques))[codes], minlength=len(some)).astype(np.int64) if len(codes) else np.zeros(len(some), np.int64)  # noqa: B023, E731
        lines = [[x for x in t.split("\n") if WORD.search(x)] for t in some]
        parts.append([
            lengths, per(len), np.array([sum(map(t.count, SYMBOLS)) for t in some]), np.array([len(x) - len(set(x)) for x in lines]), _repeats(codes, lengths),
            per(lambda u: len(u) > 1 and u.isupper()), np.array([len(x) for x in lines]), per(lambda u: not any(map(str.isalpha, u))),
        ])
    return [np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else [()] * len(MEASURES))]


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and failed: the bits of the rules that the text fails."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = measure(texts_of(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.asarray(x, np.int64)) for x in got)], ["doc_id", *MEASURES])

    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed", bits)


def apply_policy(led: DataFrame, policy: str) -> DataFrame:
    """Adds kept: no rule of the policy is failed."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0)


def ablation(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that it alone rejects. One aggregation over the bits, pre-aggregated on the map side."""
    mask = mask_of(policy)
    counts = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rows = [F.struct(F.lit(n).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (n, _) in enumerate(rules()) if mask >> k & 1]
    return (
        counts.select("bits", "n", F.explode(F.array(*rows)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )
