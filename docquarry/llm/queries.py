"""Registered queries of the corpus operators, thin digests over each operator's own results, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, divergence, line_align, mixing, mtree, periodic, quality_fm, quality_rules, suffix_dedup, toxicity, unit_dedup, url_filters
from ._common import read
from .oracles import ORACLES as ORACLES

#: Passages of over fifty words have hardly ever fewer bytes; op7 reports them from here on, and removes from 400 on as its contract says.
PASSAGE_BYTES = 256


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.apply_policy(quality_rules.ledger(read(spark, sf_dir, "documents")), "full-1")
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask_of("base-1")).cast("long")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.train(docs, read(spark, sf_dir, "labels")))


def op4_line_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_align.align(read(spark, sf_dir, "documents"))


def op5_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.dedup(read(spark, sf_dir, "documents"))


def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(read(spark, sf_dir, "embeddings"), k=20, scale=64.0, every=20)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"), length=400, least=PASSAGE_BYTES)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(read(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), least=3, top=200)


#: The contract's rules.
URL_RULES = "SELECT * FROM VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block') AS rules(rule, verdict)"


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document it shows, whose number is in its path."""
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    bad = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    doc = F.regexp_extract(url_filters.path_of(F.col("url")), r"/([0-9]{1,18})([/.]|\z)", 1).try_cast("long")
    judged = pages.select("page_id", "url", doc.alias("doc")).join(bad, "doc", "left")
    return url_filters.judge(judged, spark.sql(URL_RULES), limit=0.25).select("page_id", "host", "path", "rule", "verdict")


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rewriting gives one document of ten a periodic tail before runs are sought."""
    found = periodic.digests(read(spark, sf_dir, "documents"), exponent=4, least=6, rewrite=periodic.plant)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_quality_rules, op3_quality_fm, op4_line_align, op5_unit_dedup, op6_mtree, op7_suffix_dedup, op8_bpe, op9_toxicity, op10_bagminhash, op11_divergence, op12_url_filters, op13_periodic)}
