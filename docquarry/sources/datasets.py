"""Question sets, gold records and reports: readers that tell which line is wrong, checks, and writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, text

# Fields of a gold record, names that a question, its answer and its document may have in a file.
GOLD = "id string, question string, expected_answer string, expected_document string, evidence_text string, page int, answerable boolean, subset string, question_type string, answer_variants array<string>"
QUESTION, ANSWER, DOCUMENT = ("question", "query"), ("reponse_attendue", "expected_answer", "attendu"), ("document", "document_attendu", "expected_document")
INTENTS = ("SEARCH", "SUMMARIZE", "CLASSIFY", "EXTRACT", "COMPARE", "SYNTHESIZE", "CLARIFY")
REQUIRED = ("id", "query", "expected_intent", "category", "language", "notes")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines of text files with their numbers. Each file is one row before it is parted, so files must fit a task."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("at", "value")).select("file", (F.col("at") + 1).cast("long").alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, error, and the schema's fields) of files with one JSON object a line; empty lines go, a line that is no object of the schema has an error and null fields."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    got = lines.withColumn("o", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("o").isNull() | F.col("o._bad").isNotNull()
    fields = [f.name for f in got.schema["o"].dataType.fields if f.name != "_bad"]
    return got.select("file", "line", F.when(bad, F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": no JSON object of the schema"))).alias("error"), *(F.when(~bad, F.col(f"o.{f}")).alias(f) for f in fields))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def gold(spark: SparkSession, path: str, evidence_only: bool = False, answerable: bool | None = None, limit: int | None = None) -> DataFrame:
    """Gold records of JSONL files: the known fields, and metadata with all others as text; by file and line, the first ``limit`` where one is given. A line that cannot be read raises when it is reached."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    known = [x.split()[0] for x in GOLD.split(", ")]
    own = F.from_json("value", GOLD)
    rest = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~k.isin(known) & v.isNotNull())
    inner = F.coalesce(F.from_json(rest["metadata"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    spill = F.map_concat(F.map_filter(rest, lambda k, v: (k != "metadata") & ~F.map_contains_key(inner, k)), inner)
    refuse = F.when(F.from_json("value", "map<string,string>").isNull(), F.raise_error(F.concat(F.lit("no JSON object in line "), F.col("line").cast("string"))).cast("boolean"))
    got = lines.where(refuse.isNull()).select("file", "line", own.alias("o"), spill.alias("metadata")).select("file", "line", "o.*", "metadata").withColumn("answerable", F.coalesce("answerable", F.lit(True)))
    if evidence_only:
        got = got.where(F.trim(F.coalesce("evidence_text", F.lit(""))) != "")
    if answerable is not None:
        got = got.where(F.col("answerable") == answerable)
    got = got if limit is None else got.orderBy("file", "line").limit(limit)
    return got.drop("file", "line")


def _aliases(m: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.trim(m[n]), F.lit("")) for n in names))


def questions(raw: DataFrame) -> DataFrame:
    """(file, pos, question, expected_answer, expected_document) of question files (file, value: the whole text): a JSON array, one JSON object a line, or one question a line; blank lines and lines that start with # go, entries without a question too."""
    t = F.trim("value")
    entry = "map<string,string>"
    array = F.from_json(t, f"array<{entry}>")
    lines = F.filter(F.transform(F.split("value", "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.transform(F.filter(lines, lambda x: ~x.startswith("#")), lambda x: F.create_map(F.lit("question"), x))
    objects = F.transform(lines, lambda x: F.from_json(x, entry))
    cases = F.when(t.startswith("["), array).when(t.startswith("{"), objects).otherwise(plain)
    each = raw.select("file", F.posexplode(cases).alias("at", "m")).where("m is not null")
    got = each.select("file", (F.col("at") + 1).cast("long").alias("pos"), _aliases(F.col("m"), QUESTION).alias("question"), _aliases(F.col("m"), ANSWER).alias("expected_answer"), _aliases(F.col("m"), DOCUMENT).alias("expected_document"))
    return got.where("question is not null")


def check_routing(cases: DataFrame, intents: tuple[str, ...] = INTENTS) -> DataFrame:
    """(id, error) of routing cases: a missing field, an intent outside the taxonomy, or an id that is not unique; good cases have no row."""
    missing = F.concat_ws(", ", *(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in REQUIRED if c != "notes"))
    n = F.count("*").over(Window.partitionBy("id"))
    error = F.when(missing != "", F.concat(F.lit("missing "), missing)).when(~F.col("expected_intent").isin(*intents), "unknown_intent").when(n > 1, "repeated_id")
    return cases.select("id", error.alias("error")).where("error is not null").distinct()


def relevant(questions_: DataFrame, column: str, mode: str, prefix: str = "", suffix: str = "", width: int = 0) -> DataFrame:
    """questions with documents: the relevant ones that a cell lists."""
    return questions_.withColumn("documents", arrays.numbered_documents(F.col(column), mode, prefix, suffix, width))


def link(gold_questions: DataFrame, sections: DataFrame) -> DataFrame:
    """(qid, doc_id, reason): the document of each question (qid, title, evidence array) by its title among documents (doc_id, title, sections array); of several of one title the one whose sections hold all evidence. reason: linked, unknown_title, no_evidence, evidence_not_found, ambiguous."""
    e = F.array_sort(F.array_distinct(F.coalesce("evidence", F.array().cast("array<string>"))))
    asked = gold_questions.select("qid", "title", e.alias("e"))
    # Questions of one title and evidence are one wish, documents of one title that hold the same wished parts one class: wishes meet classes, never questions documents.
    wishes = asked.groupBy("title", "e").agg(F.count("*").alias("n_questions"))
    titles = sections.groupBy("title").agg(F.count("*").alias("n"))
    parts = wishes.select("title", F.explode("e").alias("part")).distinct()
    held = sections.select("doc_id", "title", F.explode(F.array_distinct("sections")).alias("part")).join(parts, ["title", "part"], "left_semi")
    classes = held.groupBy("title", "doc_id").agg(F.array_sort(F.collect_set("part")).alias("has")).groupBy("title", "has").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("least"))
    reached = classes.select("title", "has", "n_docs", "least", F.explode("has").alias("part"))
    # A wish looks among the classes of its rarest part; a part that none holds counts as nought.
    common = reached.groupBy("title", "part").agg(F.count("*").alias("n_classes"))
    rarest = wishes.select("title", "e", F.explode("e").alias("part")).join(common, ["title", "part"], "left").groupBy("title", "e").agg(F.min_by("part", F.struct(F.coalesce("n_classes", F.lit(0)), F.col("part"))).alias("part"))
    fits = rarest.join(reached, ["title", "part"]).where(F.size(F.array_except("e", "has")) == 0).groupBy("title", "e").agg(F.sum("n_docs").alias("n_fit"), F.min("least").alias("doc_id"))
    zero = F.lit(0)
    g = wishes.join(titles, "title", "left").join(fits, ["title", "e"], "left").select("title", "e", F.coalesce("n", zero).alias("n"), F.coalesce("n_fit", zero).alias("n_fit"), "doc_id")
    reason = F.when(F.col("n") == 0, "unknown_title").when(F.size("e") == 0, "no_evidence").when(F.col("n_fit") == 0, "evidence_not_found").when(F.col("n_fit") > 1, "ambiguous").otherwise("linked")
    settled = g.select(F.col("title").alias("t_"), F.col("e").alias("e_"), F.when(reason == "linked", F.col("doc_id")).alias("doc_id"), reason.alias("reason"))
    return asked.join(settled, F.col("title").eqNullSafe(F.col("t_")) & (F.col("e") == F.col("e_"))).select("qid", "doc_id", "reason")


def audit(df: DataFrame) -> DataFrame:
    """(column, kind, n, nulls, empty, distinct_about) of every column of a table, in one pass."""
    texts = {c for c, k in df.dtypes if k == "string"}
    cols = df.columns
    one = df.agg(F.count("*").alias("n"), *(f for i, c in enumerate(cols) for f in (
        F.count_if(F.col(c).isNull()).alias(f"z{i}"), (F.count_if(F.trim(F.col(c)) == "") if c in texts else F.lit(0).cast("long")).alias(f"e{i}"), F.approx_count_distinct(F.to_json(F.struct(c)) if c not in texts else F.col(c)).alias(f"d{i}"),
    )))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"z{i}").alias("nulls"), F.col(f"e{i}").alias("empty"), F.col(f"d{i}").alias("distinct_about")) for i, (c, k) in enumerate(df.dtypes)))
    return one.select("n", F.explode(rows).alias("r")).select("r.column", "r.kind", "n", "r.nulls", "r.empty", "r.distinct_about")


def quality(gold_: DataFrame, documents: DataFrame) -> DataFrame:
    """(check, n): numbers of gold records that break a rule: repeated id, no question, answerable without an answer or evidence, evidence that its document (doc_id as text, text) does not hold, document that is not there."""
    n = F.count("*").over(Window.partitionBy("id"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    both = gold_.withColumn("n_", n).join(documents.select(F.col("doc_id").cast("string").alias("expected_document"), F.col("text").alias("body")), "expected_document", "left")
    held = F.contains(text.collapse(F.col("body")), text.collapse(F.col("evidence_text")))
    rules = {
        "repeated_id": F.col("n_") > 1, "no_question": blank("question"), "no_answer": F.col("answerable") & blank("expected_answer"), "no_evidence": F.col("answerable") & blank("evidence_text"),
        "missing_document": F.col("answerable") & F.col("body").isNull(), "evidence_not_found": F.col("body").isNotNull() & ~blank("evidence_text") & ~held,
    }
    one = both.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in rules))).alias("r")).select("r.check", "r.n")


def gold_records(linked: DataFrame, source: DataFrame, names: DataFrame, split: str) -> DataFrame:
    """Gold records of linked questions: linked (qid, doc_id, reason), source (qid, question, output, type, evidence array), names (doc_id, file_name)."""
    good = linked.where("reason = 'linked'").join(source, "qid").join(names, "doc_id")
    none = F.lit(None)
    return good.select(
        F.col("qid").cast("string").alias("id"), "question", F.col("output").alias("expected_answer"), F.col("file_name").alias("expected_document"), F.array_join("evidence", "\n").alias("evidence_text"),
        none.cast("int").alias("page"), F.lit(True).alias("answerable"), F.lit(split).alias("subset"), F.col("type").alias("question_type"), F.array().cast("array<string>").alias("answer_variants"),
    )


def preconditions(cases: DataFrame, gold_: DataFrame, names: DataFrame) -> DataFrame:
    """(case_id, error) of smoke cases (case_id, capability, gold_ids array, source_document) that cannot run: an unknown gold record or document."""
    asked = cases.select("case_id", F.explode_outer("gold_ids").alias("id"), "source_document")
    known = asked.join(gold_.select("id", F.lit(True).alias("has")), "id", "left").join(names.select(text.document_key(F.col("file_name")).alias("k"), F.lit(True).alias("there")).distinct(), text.document_key(F.col("source_document")) == F.col("k"), "left")
    error = F.when(F.col("id").isNotNull() & F.col("has").isNull(), "unknown_gold").when(F.col("source_document").isNotNull() & F.col("there").isNull(), "unknown_document")
    return known.select("case_id", error.alias("error")).where("error is not null").distinct()


def write_corpus(documents: DataFrame, path: str, name: Column) -> DataFrame:
    """Write each distinct document (doc_id, text) as one row under its file name, parted by the name's first hash digits; (doc_id, file_name)."""
    out = documents.dropDuplicates(["doc_id"]).withColumn("file_name", name)
    out.withColumn("part", F.substring(F.sha1(F.col("file_name").cast("binary")), 1, 2)).write.mode("errorifexists").partitionBy("part").parquet(path)
    return out.select("doc_id", "file_name")


def write_report(summary: dict, details: DataFrame, path: str) -> tuple[str, str]:
    """A report as a JSON summary (one object) and details as CSV with a header, nested values as JSON; their paths."""
    spark = details.sparkSession
    flat = details.select(*(F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in details.dtypes))
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/summary")
    flat.write.mode("errorifexists").option("header", "true").option("escape", '"').csv(f"{path}/details")
    return f"{path}/summary", f"{path}/details"


def write_trace(events: DataFrame, path: str | None) -> None:
    """Append events as JSON lines; without a path they go nowhere."""
    if path:
        events.write.mode("append").json(path)


def override(settings: dict, path: str, value) -> dict:
    """Settings with the value at a dotted path replaced; an unknown key is an error, so a misspelt lever changes nothing silently."""
    head, _, rest = path.partition(".")
    if head not in settings or (rest and not isinstance(settings[head], dict)):
        raise KeyError(f"no setting {path!r}")
    return settings | {head: override(settings[head], rest, value) if rest else value}
