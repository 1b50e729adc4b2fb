"""What events say of a response, of an ingestion run and of a failed request: attributes derived from rows, and their JSON by a list of names for each kind, so that nothing else leaves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

# The attributes of each kind of event, in order.
AGENT = ("capability", "documents", "citations", "source_count", "refusal_code", "error_category", "error_code", "error_message", "error_stack")
INGESTION = ("source", "profile", "files_found", "files_processed", "files_failed", "files_skipped", "files_empty", "files_ocr", "files_deleted", "chunks_indexed", "error_category", "error_code", "error_message", "error_stack")
HTTP = ("error_category", "error_code", "error_message", "error_stack")
KINDS = {"agent": AGENT, "ingestion": INGESTION, "http": HTTP}
COUNTS = INGESTION[2:10]


def distinct_texts(values: Column) -> Column:
    """Texts that are neither null nor empty, once each, in order."""
    return F.array_distinct(F.filter(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))


def _given(c: Column) -> Column:
    return F.when(c != "", c)


def agent(status: Column, capability: Column, resolved: Column, sources: Column, citations: Column, code: Column, message: Column) -> Column:
    """Attributes of a response: its documents are those resolved, or else those of its sources (names); a refusal keeps its code, an error its code and message."""
    named = distinct_texts(resolved)
    none = F.lit(None).cast("string")
    refused, failed = status == "refused", status == "error"
    return F.struct(
        _given(capability).alias("capability"), F.when(F.size(named) > 0, named).otherwise(distinct_texts(sources)).alias("documents"), F.coalesce(citations.cast("array<string>"), F.array().cast("array<string>")).alias("citations"),
        F.coalesce(F.size(sources), F.lit(0)).cast("long").alias("source_count"), F.when(refused, code).alias("refusal_code"), F.when(failed, F.lit("agent")).alias("error_category"), F.when(failed, code).alias("error_code"),
        F.when(failed, message).alias("error_message"), none.alias("error_stack"),
    )


def ingestion(source: Column, profile: Column, counts: dict[str, Column], category: Column | None = None, code: Column | None = None, message: Column | None = None, stack: Column | None = None) -> Column:
    """Attributes of an ingestion run: its counts (missing ones are 0), and its error where it failed."""
    none = F.lit(None).cast("string")
    held = [F.coalesce(counts[n].cast("long"), F.lit(0).cast("long")).alias(n) if n in counts else F.lit(0).cast("long").alias(n) for n in COUNTS]
    errors = [(none if c is None else c).alias(n) for n, c in zip(HTTP, (category, code, message, stack), strict=True)]
    return F.struct(source.alias("source"), _given(profile).alias("profile"), *held, *errors)


def http(category: Column, code: Column, message: Column, stack: Column) -> Column:
    """Attributes of a request that failed unforeseen."""
    return F.struct(*(c.cast("string").alias(n) for n, c in zip(HTTP, (category, code, message, stack), strict=True)))


def serialized(kind: str, attributes: Column) -> Column:
    """The attributes of a kind as JSON: the names of its list alone, messages and stacks without secrets and folders; null for an unknown kind."""
    if kind not in KINDS:
        return F.lit(None).cast("string")
    clean = {"error_message": text.redact, "error_stack": text.redact_stack}
    return F.to_json(F.struct(*(clean.get(n, lambda c: c)(attributes[n]).alias(n) for n in KINDS[kind])))
