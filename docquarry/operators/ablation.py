"""What each part of the search is worth: settings that differ in one lever, run as one plan.

A setting is a path through the stages of the search (candidates, order, selection, context). Settings that agree up to a stage share its result, so each distinct prefix is run once, however many settings there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut
from . import evaluate, retrieval, search

EVERY = 999


@dataclass(frozen=True)
class Setting:
    name: str
    perimeter: bool = True
    lexical: bool = True
    rerank: bool = True
    threshold: float | None = None
    per_document: int = 3
    expand: bool = True

    def path(self) -> tuple[tuple, ...]:
        """What decides each stage."""
        return (("found", self.perimeter, self.lexical), ("ranked", self.rerank, self.threshold if self.rerank else None), ("kept", self.per_document), ("context", self.expand))


def levers(threshold: float = search.THRESHOLD) -> tuple[Setting, ...]:
    """The reference setting first, then one for each lever."""
    return (
        Setting("reference"), Setting("without_reranking", rerank=False), Setting("with_threshold", threshold=threshold), Setting("without_perimeter", perimeter=False),
        Setting("without_diversity", per_document=EVERY), Setting("dense_alone", lexical=False), Setting("without_neighbours", expand=False),
    )


@dataclass
class Runs:
    """The stages of all settings over one set of questions; ``made`` counts the stages that were run."""

    questions: DataFrame
    chunks: DataFrame
    bounds: DataFrame
    score: Callable[[Column, Column], Column] = retrieval.lexical_overlap
    top_k: int = 6
    radius: int = 1
    held: dict[tuple, DataFrame] = field(default_factory=dict)
    made: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.questions = self.questions.withColumn("text", text.collapse(F.coalesce(F.col("text"), F.lit("")))).where("text != ''")

    def at(self, path: tuple[tuple, ...]) -> DataFrame:
        """The result of a path of stages."""
        if path not in self.held:
            stage, *options = path[-1]
            before = self.at(path[:-1]) if len(path) > 1 else None
            self.held[path] = cut(getattr(self, f"_{stage}")(before, *options))
            self.made[stage] = self.made.get(stage, 0) + 1
        return self.held[path]

    def _found(self, _, perimeter: bool, lexical: bool) -> DataFrame:
        binding = self.bounds.where(F.col("status").isin("exact", "compatible") & F.lit(perimeter))
        live = self.questions.join(self.bounds.where(F.col("status") == "unknown").where(F.lit(perimeter)).select("qid"), "qid", "left_anti")
        return search.found(live, self.chunks, binding, retrieval.candidate_budget(self.top_k), lexical=lexical)

    def _ranked(self, before: DataFrame, rerank: bool, threshold: float | None) -> DataFrame:
        return search.ranked(before, self.questions, self.score if rerank else None, threshold)

    def _kept(self, before: DataFrame, per_document: int) -> DataFrame:
        return search.kept(before, self.chunks, self.top_k, per_document)

    def _context(self, before: DataFrame, expand: bool) -> DataFrame:
        return search.expanded(before, self.chunks, self.radius) if expand else before.withColumn("added", F.lit(False))


def table(runs: Runs, gold: DataFrame, settings: tuple[Setting, ...] | None = None) -> DataFrame:
    """(setting, hit, recall, rr, n_passages, delta): means over the questions of gold (qid, doc_id), and the hit rate's difference to the first setting's."""
    out = None
    for s in settings or levers():
        passages = runs.at(s.path())
        ranks = passages.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
        each = evaluate.at_k(ranks, gold, EVERY).join(passages.groupBy("qid").agg(F.count("*").alias("n_passages")), "qid", "left")
        row = each.agg(F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("rr"), F.sum("n_passages").alias("n_passages")).select(F.lit(s.name).alias("setting"), "*")
        out = row if out is None else out.unionByName(row)
    first = (settings or levers())[0].name
    base = out.where(F.col("setting") == first).select("hit").scalar()
    return out.withColumn("delta", F.round(F.col("hit") - base, 6))
