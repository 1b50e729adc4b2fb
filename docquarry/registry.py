"""The registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import base, controls, measures, more, scores, search, texts  # noqa: F401  importing them registers their queries
from .session import ship

QUERIES = base.QUERIES
ORACLES = base.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: lexical and dense lists of each benchmark item, fused by reciprocal rank, six documents each."""
    ship(spark)
    return QUERIES["rrf_hybrid"](spark, sf_dir)
