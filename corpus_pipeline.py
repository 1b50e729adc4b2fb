"""A corpus pipeline of five stages: toxicity, line dedup, near-duplicate dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of documents, extra ones included.

Odd rows, stage by stage (an empty table gives an empty result everywhere, and columns whose names an operator uses inside pass through unharmed):
- toxicity: null and empty texts score as texts without words and stay; repeated rows get one score and stay or go together; very long texts are scored whole; without labels nothing goes.
- line dedup: null and empty texts stay, but of several texts without any word all stay; of repeated rows (doc_id and text) none makes the other go; ties in doc_id are settled by a digest of the text.
- near-duplicate dedup: one row of each class stays, of repeated rows one; rows without a doc_id come last; texts without words all stay.
- mixing: texts without words are never taken; a null source is a source of its own; repeated rows come as often as all of them together are taken.
- BPE: a null text is encoded as the empty one; repeated rows give repeated results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import bagminhash, bpe, line_align, mixing, toxicity
from docquarry.session import cut


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; the classifier learns from the labels of the documents given."""
    return toxicity.keep(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier document has; one that has nothing else goes."""
    return line_align.strip(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of the least doc_id."""
    return bagminhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.resample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, for each document of the mix."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mixed), ("bpe", encoded)]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are cut before the next one, which reads them several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
