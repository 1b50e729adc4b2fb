"""Comparison and synthesis of several documents: plan, map and reduce around a model, over whole tables of questions.

A question's documents are numbered D1, D2... and their passages S1, S2...; [D2S5] is a citation. The plan sees the question and the documents' names only, a map one batch of one document, the reduction the validated elements only. Every step is one pass over a table; failed calls are rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..session import cut
from . import capability, structure
from .capability import BATCH, MOST_BATCHES, Model

#: Axes of a plan and items it may expect, and characters that a map prompt needs besides plan and batch.
MOST_AXES, MOST_ITEMS, FRAME = 6, 6, 600
#: Plans that stand in where a model gives none, by operation and scope.
FALLBACK = {
    ("compare", "inter"): ("Compare the documents.", ["subject and scope", "main points", "figures and dates", "differences"]),
    ("synthesize", "inter"): ("Bring the documents together.", ["subject and scope", "main points", "figures and dates", "conclusions"]),
    ("compare", "intra"): ("Compare the parts of the document.", ["parts and their subjects", "main points of each part", "differences between parts"]),
    ("synthesize", "intra"): ("Bring the parts of the document together.", ["parts and their subjects", "main points across parts", "conclusions"]),
}


def fallback_plan(operation: Column, scope: Column) -> tuple[Column, Column]:
    """(objective, axes) of the plan that stands in for an operation and scope; those of a comparison for an unknown one."""
    objective, axes = (F.lit(FALLBACK["compare", "inter"][0]), F.array(*map(F.lit, FALLBACK["compare", "inter"][1])))
    for (op, where), (what, names) in FALLBACK.items():
        here = (operation == op) & (scope == where)
        objective, axes = F.when(here, F.lit(what)).otherwise(objective), F.when(here, F.array(*map(F.lit, names))).otherwise(axes)
    return objective, axes


def plans(questions: DataFrame, targets: DataFrame, model: Model | None = None, budget: int | None = None) -> DataFrame:
    """(qid, operation, scope, objective, axes, expected, fallback) for questions (qid, text, operation, scope) and targets (qid, index, doc_id, label): one call a question, no second try. Without a model, with a failed call, a prompt beyond the budget, or an answer without an axis, the stand-in plan is taken whole."""
    names = targets.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "label"))), lambda x: F.concat(F.lit("- D"), x["index"].cast("string"), F.lit(": "), x["label"])), "\n").alias("names"))
    asked = questions.join(names, "qid", "left")
    prompt = F.concat(F.lit("OPERATION\n"), "operation", F.lit("\n\nQUESTION\n"), "text", F.lit("\n\nDOCUMENTS (names only)\n"), F.coalesce("names", F.lit("")), F.lit('\n\nAnswer with JSON: {"objective": "...", "axes": ["..."], "expected": ["..."]}'))
    asked = asked.withColumn("prompt", prompt)
    fits = F.lit(True) if budget is None else F.length("prompt") <= budget
    if model is None:
        got = asked.withColumn("answer", F.lit(None).cast("string"))
    else:
        got = capability.call(asked.withColumn("fits", fits), model).withColumn("answer", F.when(F.col("fits"), F.col("answer")))
    objective, axes = fallback_plan(F.col("operation"), F.col("scope"))
    plan = arrays.plan(F.col("answer"), objective, axes, MOST_AXES, MOST_ITEMS)
    return got.withColumn("plan", plan).select("qid", "operation", "scope", "plan.objective", "plan.axes", "plan.expected", "plan.fallback")


def numbered(targets: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, index, doc_id, label, n, citation, text): the passages (doc_id, n, text) of each question's documents, cited [DkSj]."""
    both = targets.select("qid", "index", "doc_id", "label").join(passages.select("doc_id", "n", "text"), "doc_id")
    return both.withColumn("citation", F.concat(F.lit("D"), F.col("index").cast("string"), F.lit("S"), F.col("n").cast("string")))


def maps(plan: DataFrame, targets: DataFrame, passages: DataFrame, model: Model, limit: int = BATCH, most: int = MOST_BATCHES, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(elements, documents).

    Each document of each question is read whole, in batches of about ``limit`` characters; nothing is cut. A document of more than ``most`` batches is refused as a whole, as is one with a passage that exceeds the ``budget`` less what plan and frame take; each batch of the others is one call.
    elements: (qid, index, pos, axis, content, citations): axis of the plan, some content, a citation of the batch; of equal (axis, content) in a document the first stays. documents: (qid, index, doc_id, label, n_batches, n_failed, n_elements, status): usable, no_evidence, failed, too_large, over_budget or empty.
    """
    cited = numbered(targets, passages)
    block = F.concat(F.lit("["), "citation", F.lit("] "), F.coalesce("label", F.lit("")), F.lit("\n"), F.trim("text"))
    items = cited.select(F.struct("qid", "index").alias("who"), "n", "citation", block.alias("block"))
    dealt = structure.batches(items, "who", "n", F.length("block"), limit)
    batches = dealt.groupBy("who", "batch").agg(F.array_sort(F.collect_list(F.struct("n", "citation", "block"))).alias("xs"), F.max(F.length("block")).alias("longest"))
    frame = plan.select("qid", "objective", "axes", "expected", (F.length("objective") + F.length(F.array_join(F.concat("axes", "expected"), "")) + FRAME).alias("fixed"))
    got = batches.select("who.qid", "who.index", "batch", F.array_join(F.transform("xs", lambda x: x["block"]), "\n\n---\n\n").alias("passages"), F.transform("xs", lambda x: x["citation"]).alias("allowed"), "longest").join(frame, "qid")
    per = got.groupBy("qid", "index").agg(F.count("*").alias("n_batches"), F.max("longest").alias("longest"), F.max("fixed").alias("fixed"))
    over = F.lit(False) if budget is None else (F.lit(limit) + F.col("fixed") > budget) | (F.col("longest") > budget - F.col("fixed"))
    state = per.withColumn("refused", F.when(F.col("n_batches") > most, "too_large").when(over, "over_budget"))
    open_ = got.join(state.where("refused is null").select("qid", "index", "n_batches"), ["qid", "index"])
    lines = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    expected = F.when(F.size("expected") > 0, F.concat(F.lit("\n\nLOOK FOR\n"), lines(F.col("expected")))).otherwise("")
    part = F.concat(F.lit("\n\nBATCH "), F.col("batch").cast("string"), F.lit(" OF "), F.col("n_batches").cast("string"), F.lit("\n"))
    prompt = F.concat(F.lit("AXES\n"), lines(F.col("axes")), expected, F.lit("\n\nOBJECTIVE\n"), "objective", part, "passages", F.lit('\n\nAnswer with JSON: {"elements": [{"axis": "...", "content": "...", "citations": ["D1S1"]}]}'))
    called = capability.call(open_.select("qid", "index", "batch", "axes", "allowed", prompt.alias("prompt")), model).drop("prompt")
    # Cut: a model is called once, whatever is made of its answers.
    called = cut(called.withColumn("ok", F.col("ok") & F.coalesce(arrays.json_object(F.col("answer")).isNotNull(), F.lit(False))))
    each = called.where("ok").select("qid", "index", "batch", F.posexplode(arrays.map_elements(F.col("answer"), F.col("axes"), F.col("allowed"))).alias("at", "e"))
    place = F.struct("batch", "at")
    first = each.groupBy("qid", "index", F.col("e.axis").alias("axis"), F.col("e.content").alias("content")).agg(F.min(F.struct(place.alias("pos"), F.col("e.citations").alias("citations"))).alias("f"))
    elements = first.select("qid", "index", F.row_number().over(Window.partitionBy("qid", "index").orderBy("f.pos")).cast("long").alias("pos"), "axis", "content", "f.citations")
    calls = called.groupBy("qid", "index").agg(F.count_if(~F.col("ok")).alias("n_failed"))
    found = elements.groupBy("qid", "index").agg(F.count("*").alias("n_elements"))
    docs = targets.select("qid", "index", "doc_id", "label").join(state.select("qid", "index", "n_batches", "refused"), ["qid", "index"], "left").join(calls, ["qid", "index"], "left").join(found, ["qid", "index"], "left")
    zero = F.lit(0).cast("long")
    b, f, n = F.coalesce("n_batches", zero), F.coalesce("n_failed", zero), F.coalesce("n_elements", zero)
    status = F.when(b == 0, "empty").when(F.col("refused").isNotNull(), F.col("refused")).when(f == b, "failed").when(n == 0, "no_evidence").otherwise("usable")
    return elements, docs.select("qid", "index", "doc_id", "label", b.alias("n_batches"), f.alias("n_failed"), n.alias("n_elements"), status.alias("status"))


def rendered(elements: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, prompt, allowed): what a reduction sees: each document in order, its elements grouped by axis in the order of their first element, with citations; or why it has none. allowed are all citations of the elements."""
    line = F.concat(F.lit("- "), "content", F.lit(" "), F.array_join(F.transform("citations", lambda c: F.concat(F.lit("["), c, F.lit("]"))), " "))
    axes = elements.withColumn("line", line).groupBy("qid", "index", "axis").agg(F.min("pos").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    docs = axes.groupBy("qid", "index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat(F.lit("["), "axis", F.lit("]\n"), "lines").alias("t")))), lambda x: x["t"]), "\n\n").alias("body"))
    why = F.when(F.col("status") == "usable", F.col("body")).when(F.col("status").isin("no_evidence", "empty"), "(nothing relevant in this document)").otherwise(F.concat(F.lit("(not available: "), "status", F.lit(")")))
    blocks = documents.join(docs, ["qid", "index"], "left").select("qid", "index", F.concat(F.lit("### Document D"), F.col("index").cast("string"), F.lit(" - "), F.coalesce("label", F.lit("")), F.lit("\n"), why).alias("t"))
    prompts = blocks.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "t"))), lambda x: x["t"]), "\n\n").alias("prompt"))
    allowed = elements.groupBy("qid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("citations")))).alias("allowed"))
    return prompts.join(allowed, "qid", "left").select("qid", "prompt", F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed"))


def sources(elements: DataFrame, cited: DataFrame) -> DataFrame:
    """(qid, citation, doc_id, text): the passages (as ``numbered`` gives them) that elements cite."""
    used = elements.select("qid", F.explode("citations").alias("citation")).distinct()
    return cited.select("qid", "citation", "doc_id", "text").join(used, ["qid", "citation"], "left_semi")


def run(questions: DataFrame, targets: DataFrame, passages: DataFrame, model: Model, least: int = 2, most: int = 4, limit: int = BATCH, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, documents): plan, maps and reduction of comparisons and syntheses.

    answers: (qid, status, answer, citations, n_usable, reason). A question with too few or too many documents (1 within a document) is refused before any call; with no usable document it fails; with some it is partial. The reduction's citations outside the elements are taken out; an answer that keeps none is refused as uncited.
    """
    n = targets.groupBy("qid").agg(F.countDistinct("doc_id").alias("n_targets"))
    sized = questions.join(n, "qid", "left").withColumn("n_targets", F.coalesce("n_targets", F.lit(0)))
    inter = F.col("scope") != "intra"
    refused = F.when(inter & (F.col("n_targets") < least), "too_few_documents").when(inter & (F.col("n_targets") > most), "too_many_documents").when(~inter & (F.col("n_targets") != 1), "ambiguous_document")
    sized = sized.withColumn("refused", refused)
    ready = sized.where("refused is null").select("qid", "text", "operation", "scope")
    own = targets.join(ready.select("qid"), "qid", "left_semi")
    plan = cut(plans(ready, own, model, budget))
    elements, documents = maps(plan, own, passages, model, limit, MOST_BATCHES, budget)
    documents = cut(documents)
    usable = documents.groupBy("qid").agg(F.count_if(F.col("status") == "usable").alias("n_usable"), F.count("*").alias("n_documents"))
    prompts = rendered(elements, documents).join(ready.select("qid", "text", "operation"), "qid").join(usable.where("n_usable > 0").select("qid"), "qid", "left_semi")
    whole = F.concat(F.lit("REDUCE\n"), "operation", F.lit("\n\nQUESTION\n"), "text", F.lit("\n\n"), "prompt")
    reduced = cut(capability.call(prompts.withColumn("prompt", whole), model).drop("prompt"))
    clean = text.keep_document_citations(F.col("answer"), F.col("allowed"))
    reduced = reduced.select("qid", "ok", F.col("answer").alias("raw"), clean.alias("answer")).withColumn("citations", text.document_citations(F.col("answer")))
    got = sized.select("qid", "refused").join(usable, "qid", "left").join(reduced, "qid", "left")
    n_usable = F.coalesce("n_usable", F.lit(0))
    reason = (
        F.when(F.col("refused").isNotNull(), F.col("refused")).when(n_usable == 0, "no_usable_document").when(~F.coalesce("ok", F.lit(False)), "failed_reduction")
        .when(F.size("citations") < 1, "uncited")
    )
    status = F.when(F.col("refused").isNotNull(), "refused").when(reason.isNotNull(), "failed").when(n_usable < F.col("n_documents"), "partial").otherwise("complete")
    good = status.isin("partial", "complete")
    answers = got.select("qid", status.alias("status"), F.when(good, F.col("answer")).alias("answer"), F.when(good, F.col("citations")).otherwise(F.array().cast("array<string>")).alias("citations"), n_usable.cast("long").alias("n_usable"), reason.alias("reason"))
    return answers, documents


def contextual(questions: DataFrame, passages: DataFrame, model: Model, limit: int = BATCH) -> DataFrame:
    """(qid, status, answer, citations, n_passages): one call a question over the passages (qid, rank, citation, text) that a search found, as many as fit; none found is no_passage, a failed call failed, an answer without a known citation uncited."""
    fit = structure.context(passages, "qid", "rank", F.length("text"), limit).where(~F.col("cut") | (F.col("rank") == 1))
    block = F.concat(F.lit("["), "citation", F.lit("]\n"), F.substring("text", 1, limit))
    ctx = fit.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"), F.collect_set("citation").alias("allowed"), F.count("*").alias("n_passages"))
    asked = questions.join(ctx, "qid").withColumn("prompt", F.concat(F.lit("QUESTION\n"), "text", F.lit("\n\nPASSAGES\n"), "context"))
    called = capability.call(asked.select("qid", "prompt", "allowed", "n_passages"), model).drop("prompt")
    kept = F.array_intersect(text.citations(F.col("answer")), F.col("allowed"))
    got = questions.select("qid").join(called.withColumn("kept", kept), "qid", "left")
    status = F.when(F.col("n_passages").isNull(), "no_passage").when(~F.col("ok"), "failed").when(F.size("kept") < 1, "uncited").otherwise("ok")
    return got.select("qid", status.alias("status"), F.when(status == "ok", text.keep_citations(F.col("answer"), F.col("kept"))).alias("answer"), F.when(status == "ok", F.col("kept")).otherwise(F.array().cast("array<string>")).alias("citations"), F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"))


def with_fallback(first: DataFrame, again) -> DataFrame:
    """Results of the contextual way; those that failed after it had selected some passage are replaced by ``again`` (questions' qids to results of the same columns). A question without a passage is not tried again."""
    failed = first.where((F.col("status") != "ok") & (F.col("n_passages") > 0)).select("qid")
    return first.join(failed, "qid", "left_anti").unionByName(again(failed).select(first.columns))


@dataclass
class Scripted:
    """Offline model for plans, maps and reductions: quotes the first sentence of every passage under the first axis, and joins what it is given."""

    words: int = 12

    def __call__(self, prompts: pd.Series) -> pd.Series:
        return prompts.map(self.answer)

    def answer(self, prompt: str) -> str | None:
        import json
        import re

        if prompt.startswith("OPERATION"):
            return json.dumps({"objective": "Answer the question.", "axes": ["main points", "figures and dates"], "expected": []})
        if prompt.startswith("AXES"):
            axis = prompt.split("\n", 2)[1].removeprefix("- ")
            found = re.findall(r"\[(D\d+S\d+)\][^\n]*\n(\S[^\n]*)", prompt)
            return json.dumps({"elements": [{"axis": axis, "content": " ".join(body.split()[: self.words]), "citations": [c]} for c, body in found]})
        if prompt.startswith("REDUCE"):
            lines = re.findall(r"^- (.*\[D\d+S\d+\])$", prompt, re.M)
            return "\n".join(lines) if lines else None
        found = re.findall(r"\[(S\d+)\]\n(\S[^\n]*)", prompt)
        return " ".join(f"{' '.join(body.split()[: self.words])} [{c}]" for c, body in found[:3]) or None
