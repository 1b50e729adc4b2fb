"""Whole-document capabilities as map and aggregate jobs around a pluggable model, with offline stand-ins.

A model is a function from a pandas Series of prompts to a Series of answers; it runs in Arrow batches on the executors. Around it everything is set-oriented: passages are dealt into batches that fit its budget, each batch is one call, failed calls are rows, answers are validated against the passages' citations, and votes, values, elements and summaries are merged by aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..session import cut, ship
from . import evaluate, structure

Model = Callable[[pd.Series], pd.Series]
#: Characters of a batch, batches of a document, depth of a reduction, and characters taken for a token.
BATCH, MOST_BATCHES, DEPTH, CHARS = 16_000, 24, 12, 2.5
#: Prompts that a task gives to a model at once.
CALLS = 128


def input_budget(context_tokens: int, output_tokens: int, reserve: int = 512) -> int:
    """Characters that fit a model's input."""
    return int(max(context_tokens - output_tokens - reserve, 0) * CHARS)


def call(df: DataFrame, model: Model, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """df with the model's answer and ok; a failing call gives a null answer for its rows, not an error for the job."""
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(answer, T.StringType()), T.StructField("ok", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(s, CALLS) for b in batches for s in range(0, b.num_rows, CALLS)):
            asked = pd.Series(b.column(prompt).to_pylist(), dtype=object)
            try:
                got = model(asked).astype(object).reindex(asked.index)
            except Exception:
                got = pd.Series([_alone(model, p) for p in asked], index=asked.index, dtype=object)
            ok = got.notna()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got.where(ok, None).tolist(), pa.string()), pa.array(ok.tolist(), pa.bool_())], names)

    names = schema.names
    return df.mapInArrow(run, schema)


def _alone(model: Model, prompt: str):
    try:
        return model(pd.Series([prompt])).iloc[0]
    except Exception:
        return None


def prompts(passages: DataFrame, limit: int = BATCH) -> DataFrame:
    """(doc_id, batch, prompt, citations): passages (doc_id, n, text) in batches, each passage headed by its citation."""
    dealt = structure.batches(passages, "doc_id", "n", F.length("text"), limit)
    item = F.struct("n", F.concat(F.lit("[S"), F.col("n").cast("string"), F.lit("]\n"), "text").alias("block"))
    got = dealt.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    return got.select("doc_id", "batch", F.array_join(F.transform("xs", lambda x: x["block"]), "\n\n").alias("prompt"), F.transform("xs", lambda x: F.concat(F.lit("S"), x["n"].cast("string"))).alias("citations"))


def keyword_votes(categories: dict[str, list[str]]) -> Callable[[Column], Column]:
    """Offline classifier: the category whose words a text holds most often, ties by name; null if it holds none."""

    def vote(t: Column) -> Column:
        toks = text.tokens(t)
        held = lambda words: F.size(F.filter(toks, lambda x: x.isin(words)))
        counts = [F.struct(held(ws).alias("hits"), F.lit(-i).alias("order"), F.lit(c).alias("category")) for i, (c, ws) in enumerate(sorted(categories.items()))]
        best = F.array_max(F.array(*counts))
        return F.when(best["hits"] > 0, best["category"])

    return vote


def classify(passages: DataFrame, vote: Callable[[Column], Column], limit: int = BATCH) -> DataFrame:
    """(doc_id, total, verdict, votes, reason): one vote a batch, absolute majority over all batches."""
    votes = prompts(passages, limit).withColumn("category", vote(F.col("prompt")))
    return evaluate.majority(votes, "doc_id", "category", F.col("category").isNotNull())


def extract(passages: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(doc_id, field, value, citations, n_values, single): values that a pattern finds in passages, merged by their trimmed, collapsed, lower-case form; the first spelling stays, citations unite in numeric order; ``single`` only if the document has one value of the field."""
    found = None
    for name, pattern in fields.items():
        part = passages.select("doc_id", "n", F.lit(name).alias("field"), F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "value"))
        found = part if found is None else found.unionByName(part)
    key = F.lower(text.collapse(F.col("value")))
    merged = found.groupBy("doc_id", "field", key.alias("key")).agg(F.min(F.struct("n", "pos", "value")).alias("first"), F.array_sort(F.collect_set("n")).alias("ns"))
    n = F.count("*").over(Window.partitionBy("doc_id", "field"))
    return merged.select("doc_id", "field", F.col("first.value").alias("value"), F.array_join(F.transform("ns", lambda x: F.concat(F.lit("S"), x.cast("string"))), " ").alias("citations"), n.alias("n_values"), (n == 1).alias("single"))


def lead_sentences(prompt: pd.Series, most: int = 240) -> pd.Series:
    """Offline summariser: the first sentence of each cited passage, with its citation."""

    def one(p: str) -> str:
        out = []
        for block in p.split("\n\n"):
            head, _, body = block.partition("\n")
            sentence = body.strip().split(". ")[0].replace("\n", " ").strip()[:most]
            if sentence:
                out.append(f"{sentence} {head}")
        return "\n\n".join(out)

    return prompt.map(one)


def summarize(passages: DataFrame, model: Model = lead_sentences, limit: int = BATCH, budget: int = 4_000, halve: Model | None = None) -> DataFrame:
    """(doc_id, status, summary, depth): a summary a batch, then rounds of reduction while a document's text exceeds the budget, at most DEPTH; one failed batch makes the document fail, as does a reduction that does not end, or a summary without a valid citation.

    Rounds are a driver loop over whole tables, each cut from the one before; documents that are done take no part in later ones.
    """
    first = call(prompts(passages, limit), model)
    state = first.groupBy("doc_id").agg(F.bool_and("ok").alias("ok"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "answer"))), lambda x: x["answer"]), "\n\n").alias("summary"), F.flatten(F.collect_list("citations")).alias("allowed"))
    state = state.withColumn("depth", F.lit(1))
    shrink = halve or _halve
    for depth in range(2, DEPTH + 1):
        state = cut(state)
        long = state.where((F.length("summary") > budget) & F.col("ok"))
        if long.isEmpty():
            break
        reduced = call(long.withColumnRenamed("summary", "prompt").drop("ok"), shrink, answer="summary").drop("prompt").withColumn("depth", F.lit(depth))
        state = state.where(~((F.length("summary") > budget) & F.col("ok"))).unionByName(reduced.select(state.columns))
    cited = F.size(F.array_intersect(text.citations(F.col("summary")), F.col("allowed"))) > 0
    status = F.when(~F.col("ok"), "failed_batch").when(F.length("summary") > budget, "not_convergent").when(~F.coalesce(cited, F.lit(False)), "uncited").otherwise("ok")
    return state.select("doc_id", status.alias("status"), F.when(status == "ok", F.col("summary")).alias("summary"), "depth")


def _halve(prompt: pd.Series) -> pd.Series:
    return prompt.map(lambda p: "\n\n".join(p.split("\n\n")[::2]))


def elements(maps: DataFrame, allowed: DataFrame) -> DataFrame:
    """(doc_id, axis, content, citation): elements of maps (doc_id, axis, content, citation, pos) with some content and a citation that the document has (allowed: doc_id, citation); of equal ones the first stays."""
    valid = maps.where(F.trim("content") != "").join(allowed, ["doc_id", "citation"], "left_semi")
    return valid.groupBy("doc_id", "axis", "content").agg(F.min(F.struct("pos", "citation")).alias("f")).select("doc_id", "axis", "content", "f.citation")


def compare(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(qid, status, usable, missing): a comparison or synthesis of the targets (qid, doc_id) goes on with the documents that have elements: complete with all, partial with some, failed with none."""
    have = targets.join(found.select("doc_id").distinct().withColumn("usable", F.lit(True)), "doc_id", "left")
    n = have.groupBy("qid").agg(F.count("*").alias("n"), F.count("usable").alias("usable"), F.array_sort(F.collect_list(F.when(F.col("usable").isNull(), F.col("doc_id")))).alias("missing"))
    status = F.when(F.col("usable") == 0, "failed").when(F.col("usable") < F.col("n"), "partial").otherwise("complete")
    return n.select("qid", status.alias("status"), "usable", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


def answer(passages: DataFrame, questions: DataFrame, least: float = 0.15) -> DataFrame:
    """(qid, status, answer, n_sources): an answer that quotes the best passage (qid, new_rank, rerank_score, text) with its citation, or a refusal without a call if no passage reaches ``least``. Stand-in for generation; a real model would go through ``call`` on the answered rows only."""
    good = passages.where(F.col("rerank_score") >= least)
    best = good.groupBy("qid").agg(F.count("*").alias("n_sources"), F.min(F.struct("new_rank", "text")).alias("b"))
    got = questions.select("qid").join(best, "qid", "left")
    return got.select("qid", F.when(F.col("b").isNull(), "refused").otherwise("answered").alias("status"), F.concat(text.excerpt(F.col("b.text")), F.lit(" [S1]")).alias("answer"), F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"))


def accumulate(sources: DataFrame) -> DataFrame:
    """Sources (qid, pos, doc_id, source, file_name, page, text) of a question without repeats: rows that agree in doc_id, source, file name, page and text are one, at their first place."""
    first = sources.groupBy("qid", "doc_id", "source", "file_name", "page", "text").agg(F.min("pos").alias("first"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("first")).cast("long")
    return first.withColumn("place", place).drop("first")


def distinct_documents(sources: DataFrame) -> DataFrame:
    """(qid, documents): names of the documents of sources (qid, pos, doc_id, source, file_name), file name before source before id, once each, in the order of their first source."""
    name = F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("file_name", "source", "doc_id")))
    first = sources.withColumn("name", name).where("name is not null").groupBy("qid", "name").agg(F.min("pos").alias("pos"))
    return first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("documents"))


def analyse(docs: DataFrame, model: Model, categories: list[str], default: str, fields: dict[str, str], least: float = 0.55, most: int = BATCH) -> DataFrame:
    """(doc_id, category, confidence, fallback, error, and the fields by their types, raw texts kept): what a model reads in each document (doc_id, file_name, text): JSON {category, confidence, metadata}. A category outside the list, a confidence below ``least``, or no readable answer gives the default category; the document goes on either way."""
    from ..functions import arrays, values

    prompt = F.concat(F.lit("ANALYSE\n"), F.coalesce("file_name", F.lit("")), F.lit("\nCATEGORIES: " + ", ".join(categories) + "\nFIELDS: " + ", ".join(fields) + "\n\n"), F.substring(F.coalesce("text", F.lit("")), 1, most))
    said = call(docs.select("doc_id", prompt.alias("prompt")), model).withColumn("j", arrays.json_object(F.col("answer")))
    confidence = values.confidence(F.get_json_object("j", "$.confidence"))
    found = text.match_label(F.get_json_object("j", "$.category"), categories)
    sure = found.isNotNull() & (confidence >= least)
    meta = F.from_json(F.get_json_object("j", "$.metadata"), "map<string,string>")
    error = F.when(~F.col("ok"), "failed_call").when(F.col("j").isNull() | F.get_json_object("j", "$").isNull(), "unreadable_answer")
    got = said.select("doc_id", F.when(F.coalesce(sure, F.lit(False)), found).otherwise(F.lit(default)).alias("category"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"), (~F.coalesce(sure, F.lit(False))).alias("fallback"), error.alias("error"), *(meta[f].alias(f) for f in fields))
    return values.typed_row(got, fields)


def classify_context(contexts: DataFrame, model: Model, categories: list[str]) -> DataFrame:
    """(qid, category, citations, reason) of contexts (qid, text, citations array): one call each; a category of the list with a citation of the context, or none with the reason: failed_call, unknown_category or uncited."""
    from ..functions import arrays

    clean = list({" ".join(c.split()).casefold(): " ".join(c.split()) for c in reversed(categories) if c.strip()}.values())[::-1]
    said = call(contexts.select("qid", "citations", F.concat(F.lit("CLASSIFY AS " + ", ".join(clean) + "\n\n"), "text").alias("prompt")), model).withColumn("j", arrays.json_object(F.col("answer")))
    category = text.match_label(F.get_json_object("j", "$.category"), clean)
    declared = F.coalesce(F.from_json(F.get_json_object("j", "$.citations"), "array<string>"), F.array().cast("array<string>"))
    cited = F.array_intersect(F.transform(declared, lambda x: F.regexp_replace(x, r"[\[\]\s]", "")), F.col("citations"))
    reason = F.when(~F.col("ok") | F.col("j").isNull(), "failed_call").when(category.isNull(), "unknown_category").when(F.size(cited) == 0, "uncited")
    return said.select("qid", F.when(reason.isNull(), category).alias("category"), F.when(reason.isNull(), cited).otherwise(F.array().cast("array<string>")).alias("citations"), reason.alias("reason"))


@dataclass
class Tool:
    """A named capability; ``run`` takes keyword arguments and returns a DataFrame."""

    name: str
    description: str
    run: Callable[..., DataFrame]
    read_only: bool = True


@dataclass
class Registry:
    """Tools by name. A failing tool is a failed result with its message, not an exception."""

    tools: dict[str, Tool] = field(default_factory=dict)

    def register(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"{tool.name} is registered already")
        self.tools[tool.name] = tool

    def names(self, read_only: bool = True) -> list[str]:
        return sorted(n for n, t in self.tools.items() if t.read_only or not read_only)

    def execute(self, name: str, **arguments) -> tuple[bool, DataFrame | None, str]:
        if name not in self.tools:
            return False, None, f"no tool {name!r}"
        try:
            return True, self.tools[name].run(**arguments), ""
        except Exception as e:
            return False, None, f"{type(e).__name__}: {e}"


def tool(name: str, description: str, read_only: bool = True):
    """Make a function a tool of that name."""
    return lambda run: Tool(name, description, run, read_only)


def default_registry() -> Registry:
    out = Registry()
    for name, what, run in (("classify", "majority of batch votes", classify), ("extract", "values of fields with citations", extract), ("summarize", "reduced batch summaries", summarize), ("compare", "documents side by side", compare)):
        out.register(Tool(name, what, run))
    return out
