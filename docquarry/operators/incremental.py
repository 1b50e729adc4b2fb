"""Incremental ingestion of a corpus, and events of its runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import registry


def sync(old: DataFrame, present: DataFrame, failed: DataFrame | None = None, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(registry after the run, outcomes by file). Vanished files leave; unchanged ones are skipped; new and changed ones take their new version; a failed one keeps its old entry, if any, and stops nothing else."""
    status = registry.difference(old, present, key)
    if failed is not None:
        bad = failed.select(key, F.lit(True).alias("bad"))
        status = status.join(bad, key, "left").withColumn("status", F.when(F.col("bad") & F.col("status").isin("new", "changed"), "failed").otherwise(F.col("status"))).drop("bad")
    fresh = present.join(status.where(F.col("status").isin("new", "changed")), key, "left_semi")
    kept = old.join(status.where(F.col("status").isin("unchanged", "failed")), key, "left_semi")
    return kept.select(present.columns).unionByName(fresh), status


def report(status: DataFrame) -> DataFrame:
    """(status, n, share): counters of a run, shares in percent with one decimal."""
    n = status.groupBy("status").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))


# Attributes of an event that may leave the process.
ALLOWED_ATTRIBUTES = ("corpus_id", "intent", "n_passages", "n_documents", "attempts", "k")


def outcomes(events: DataFrame) -> DataFrame:
    """(request, started, seconds, n_events, outcome): events (request, ts, kind) of each request in order; the last kind decides: error, partial (a refusal came before), refusal, or success."""
    last = F.max_by("kind", F.struct("ts", "event_id"))
    got = events.groupBy("request").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_events"), last.alias("last"), F.bool_or(F.col("kind") == "error").alias("had_error"))
    outcome = F.when(F.col("last") == "error", "error").when(F.col("had_error"), "partial").when(F.col("last") == "view", "refusal").otherwise("success")
    return got.select("request", "started", (F.unix_timestamp(F.col("ended").cast("timestamp")) - F.unix_timestamp(F.col("started").cast("timestamp"))).alias("seconds"), "n_events", outcome.alias("outcome"))


def allowed(attributes: str = "props"):
    """Only allowed attributes of a JSON text, as JSON again; null if nothing is left."""
    m = F.map_filter(F.from_json(attributes, "map<string,string>"), lambda k, v: k.isin(*ALLOWED_ATTRIBUTES))
    return F.when(F.size(m) > 0, F.to_json(m))
