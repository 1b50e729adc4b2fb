"""Control of a batch of questions: intent, targets, evidence, reformulation, answer or refusal, and the trace of what was done.

Each node of the control flow is one step over the table of questions that are still open; loops are bounded driver loops over what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..session import cut
from . import capability, perimeter, routing, search
from .capability import Model

#: Searches of a question at most, documents that a question may target, documents of a whole corpus, and the least share of the best score.
ATTEMPTS, MOST_TARGETS, MOST_CORPUS, RATIO = 6, 3, 20, 0.5
# How a question names the whole corpus, without accents.
CORPUS_WORDS = ["corpus", "tous les documents", "chaque document", "ensemble des documents", "all documents", "all the documents", "each document"]
# What parts the members of a list in a question.
LISTING = [",", "/", " ou ", " or "]
#: Intents that a comparison or synthesis may replace.
REPLACED = ("search", "summarize")


def explicit_multi(signal: Column, n_targets: Column) -> Column:
    """Whether a question states a comparison or synthesis of at least two named documents, which goes before any doubt about its intent."""
    return signal["is_multi"] & (signal["scope"] == "inter") & (n_targets >= 2) & signal["operation"].isin("compare", "synthesize")


def with_signal(intent: Column, signal: Column) -> Column:
    """The intent, or the signal's operation where it may replace it: several documents, or parts of one."""
    valid = (signal["is_multi"] & (signal["scope"] == "inter")) | (signal["scope"] == "intra")
    return F.when(intent.isin(*REPLACED) & valid & signal["operation"].isin("compare", "synthesize"), signal["operation"]).otherwise(intent)


def imposed(operation: Column, n_targets: Column, deixis: Column) -> Column:
    """struct(operation, scope, is_multi) of an operation that a model saw and the words did not: between documents if two are named, within one if one is named or pointed at, else null."""
    scope = F.when(n_targets >= 2, "inter").when((n_targets == 1) | deixis, "intra")
    return F.when(operation.isin("compare", "synthesize") & scope.isNotNull(), F.struct(operation.alias("operation"), scope.alias("scope"), (n_targets >= 2).alias("is_multi")))


def one_of(c: Column, field: str, allowed: list[str], default: str) -> Column:
    """A word of a closed list from a model's JSON answer, lower case; the default for anything else."""
    got = F.lower(F.trim(F.get_json_object(arrays.json_object(c), f"$.{field}")))
    return F.when(got.isin(*allowed), got).otherwise(default)


def intents(questions: DataFrame, named: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """(qid, text, intent, operation, scope, is_multi, n_targets, asked_model) of questions (qid, text); named (qid, doc_id) are documents that a catalogue finds in them.

    Order: an explicit comparison or synthesis; the rules' doubts, by the model, search if it does not decide; the signal over search and summary; at last the model's own intent for what is left a search, kept only as far as documents bear it out. Without a model doubts become searches.
    """
    refs = routing.references(F.col("text"))
    base = questions.select("qid", "text", routing.intent(F.col("text")).alias("rule"), routing.multi_document(F.col("text")).alias("signal"), refs.alias("refs"))
    if named is not None:
        base = base.join(named.groupBy("qid").agg(F.countDistinct("doc_id").alias("n_named")), "qid", "left")
    else:
        base = base.withColumn("n_named", F.lit(0))
    n = F.greatest(F.size("refs"), F.coalesce("n_named", F.lit(0))).cast("long")
    multi = F.struct((F.col("signal.is_multi") | (n >= 2)).alias("is_multi"), F.col("signal.operation").alias("operation"), F.when((F.col("signal.operation") != "none") & (n >= 2), "inter").otherwise(F.col("signal.scope")).alias("scope"))
    base = base.withColumn("n_targets", n).withColumn("s", multi).withColumn("explicit", explicit_multi(F.col("s"), F.col("n_targets")))
    doubt = F.col("rule").isin("unsure_classify", "unsure_extract") & ~F.col("explicit")
    base = base.withColumn("doubt", doubt)
    if model is None:
        decided = base.withColumn("first", F.when(F.col("doubt"), "search").otherwise(F.col("rule"))).withColumn("promoted", F.lit("search"))
    else:
        kind = F.when(F.col("rule") == "unsure_classify", "classify").otherwise("extract")
        prompt = F.when(F.col("doubt"), F.concat(F.lit("DECIDE search OR "), kind)).otherwise(F.lit("INTENT search, summarize, compare OR synthesize"))
        unsure = base.where(F.col("doubt") | ((with_signal(F.col("rule"), F.col("s")) == "search") & ~F.col("explicit")))
        said = capability.call(unsure.select("qid", F.concat(prompt, F.lit("\n"), "text").alias("prompt")), model).select("qid", "answer")
        decided = base.join(said, "qid", "left").withColumn("first", F.when(F.col("rule") == "unsure_classify", one_of(F.col("answer"), "intent", ["classify"], "search")).when(F.col("rule") == "unsure_extract", one_of(F.col("answer"), "intent", ["extract"], "search")).otherwise(F.col("rule")))
        decided = decided.withColumn("promoted", F.when(F.col("doubt"), "search").otherwise(one_of(F.col("answer"), "intent", ["summarize", "compare", "synthesize"], "search")))
    pointed = routing.points_at_document(F.col("text"))
    settled = F.when(F.col("explicit"), F.col("s.operation")).otherwise(with_signal(F.col("first"), F.col("s")))
    decided = decided.withColumn("settled", settled).withColumn("late", imposed(F.col("promoted"), F.col("n_targets"), pointed))
    rise = (F.col("settled") == "search") & (F.col("promoted") != "search")
    intent = F.when(rise & (F.col("promoted") == "summarize"), "summarize").when(rise & F.col("late").isNotNull(), F.col("late.operation")).otherwise(F.col("settled"))
    by_late = rise & F.col("late").isNotNull()
    return decided.select(
        "qid", "text", intent.alias("intent"), F.when(by_late, F.col("late.operation")).otherwise(F.col("s.operation")).alias("operation"), F.when(by_late, F.col("late.scope")).otherwise(F.col("s.scope")).alias("scope"),
        F.when(by_late, F.col("late.is_multi")).otherwise(F.col("s.is_multi")).alias("is_multi"), "n_targets", F.lit(model is not None).alias("asked_model"),
    )


def node(intent: Column) -> Column:
    """Where a question goes on: its capability, or the search for anything unexpected."""
    return F.when(intent.isin("summarize", "classify", "extract", "compare", "synthesize"), intent).otherwise("search")


def requested_fields(c: Column) -> Column:
    """Fields that a model read out of a question, collapsed, once each; none if its answer cannot be read."""
    got = F.from_json(arrays.json_object(c), "struct<fields:array<string>>")["fields"]
    return F.array_distinct(F.filter(F.transform(F.coalesce(got, F.array().cast("array<string>")), text.collapse), lambda x: x != ""))


def requested_categories(question: Column, c: Column) -> Column:
    """Categories that a model read out of a question and that stand in it word for word (case and accents aside), if it lists anything and there are two at least; else none."""
    got = F.from_json(arrays.json_object(c), "struct<categories:array<string>>")["categories"]
    clean = text.first_spellings(F.transform(F.coalesce(got, F.array().cast("array<string>")), lambda x: F.regexp_replace(text.collapse(x), r"^[ .;:,]+|[ .;:,]+$", "")))
    plain = text.collapse(text.unaccent(question))
    kept = F.filter(clean, lambda x: F.contains(plain, text.collapse(text.unaccent(x))))
    listed = F.lit(False)
    for w in LISTING:
        listed = listed | plain.contains(w)
    return F.when(listed & (F.size(kept) >= 2), kept).otherwise(F.array().cast("array<string>"))


def whole_corpus(question: Column) -> Column:
    """Whether a question is over the whole corpus, by whole words."""
    words = F.concat(F.lit(" "), F.array_join(text.tokens(question), " "), F.lit(" "))
    out = F.lit(False)
    for w in CORPUS_WORDS:
        out = out | words.contains(f" {w} ")
    return out


def corpus_targets(questions: DataFrame, cards: DataFrame, bounds: DataFrame, most: int = MOST_CORPUS) -> DataFrame:
    """(qid, index, doc_id, label): for questions over the whole corpus that name no document reliably, the corpus's documents by label, at most so many."""
    label = F.coalesce("file_name", "title", F.col("doc_id").cast("string"))
    first = cards.select("doc_id", label.alias("label")).orderBy("label", "doc_id").limit(most)
    listed = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("label", "doc_id"))).alias("xs"))  # at most ``most`` rows
    asked = questions.where(whole_corpus(F.col("text"))).select("qid").join(bounds.where(F.col("status").isin("exact", "compatible")).select("qid"), "qid", "left_anti")
    each = asked.crossJoin(F.broadcast(listed)).select("qid", F.posexplode("xs").alias("i", "x"))
    return each.select("qid", (F.col("i") + 1).cast("long").alias("index"), "x.doc_id", "x.label")


def found_documents(passages: DataFrame, most: int = MOST_TARGETS, least: float = search.LEAST, ratio: float = RATIO) -> DataFrame:
    """(qid, index, doc_id, best, n_passages): documents by the score of their best passage, as far as it reaches ``least`` and ``ratio`` of the question's best."""
    per = passages.groupBy("qid", "doc_id").agg(F.max("score").alias("best"), F.count("*").alias("n_passages"))
    top = F.max("best").over(Window.partitionBy("qid"))
    good = per.withColumn("top", top).where(F.col("best") >= F.greatest(F.lit(least), F.lit(ratio) * F.col("top")))
    index = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("best").desc(), "doc_id")).cast("long")
    return good.withColumn("index", index).where(F.col("index") <= most).select("qid", "index", "doc_id", "best", "n_passages")


def targets(questions: DataFrame, bounds: DataFrame, passages: DataFrame, most: int = MOST_TARGETS) -> DataFrame:
    """(qid, mode, index, doc_id): documents that a question names reliably (named_document, named_documents), else those that its search found (by_search), else one row of no_relevant_document."""
    sure = bounds.where(F.col("status").isin("exact", "compatible") & (F.col("field") == "doc_id")).select("qid", F.posexplode(F.slice("values", 1, most)).alias("i", "doc_id"))
    named = sure.select("qid", F.when(F.count("*").over(Window.partitionBy("qid")) == 1, "named_document").otherwise("named_documents").alias("mode"), (F.col("i") + 1).cast("long").alias("index"), F.col("doc_id").cast("long").alias("doc_id"))
    rest = found_documents(passages, most).join(named.select("qid"), "qid", "left_anti").select("qid", F.lit("by_search").alias("mode"), "index", "doc_id")
    have = named.unionByName(rest)
    none = F.lit(None).cast("long")
    return have.unionByName(questions.select("qid").join(have.select("qid").distinct(), "qid", "left_anti").select("qid", F.lit("no_relevant_document").alias("mode"), none.alias("index"), none.alias("doc_id")))


def references(intended: DataFrame, named: DataFrame, target: DataFrame) -> DataFrame:
    """(qid, scope, doc_ids, refusal) of comparisons and syntheses: between documents the named ones; within a document the named one, else the one target. Several candidates are refused with their number, never chosen from; none is no_relevant_document."""
    work = intended.where(F.col("intent").isin("compare", "synthesize")).select("qid", F.when(F.col("scope") == "intra", "intra").otherwise("inter").alias("scope"))
    own = named.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]).alias("named"))
    aim = target.where("doc_id is not null").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "doc_id"))), lambda x: x["doc_id"]).alias("aimed"))
    none = F.array().cast("array<bigint>")
    got = work.join(own, "qid", "left").join(aim, "qid", "left").select("qid", "scope", F.coalesce("named", none).alias("named"), F.coalesce("aimed", none).alias("aimed"))
    by_target = (F.col("scope") == "intra") & (F.size("named") == 0)
    refusal = F.when(by_target & (F.size("aimed") == 0), "no_relevant_document").when(by_target & (F.size("aimed") > 1), "several_candidates")
    return got.select("qid", "scope", F.when(refusal.isNotNull(), none).when(by_target, F.col("aimed")).otherwise(F.col("named")).alias("doc_ids"), refusal.alias("refusal"))


def by_document(results: DataFrame) -> DataFrame:
    """(qid, ok, message, citations, reason) of a tool's results by document (qid, index, label, ok, message, citations): a single document's result as it is; several as a list, their citations prefixed D<k>; none of them good is failed_for_all."""
    n = F.count("*").over(Window.partitionBy("qid"))
    rows = results.withColumn("n", n)
    d = F.concat(F.lit("D"), F.col("index").cast("string"))
    many = F.col("n") > 1
    line = F.when(many, F.concat(F.lit("- ["), d, F.lit("] "), "label", F.lit(": "), "message")).otherwise(F.col("message"))
    cited = F.when(many, F.transform("citations", lambda c: F.concat(d, c))).otherwise(F.col("citations"))
    g = rows.withColumn("line", line).withColumn("cited", cited).groupBy("qid").agg(F.bool_or("ok").alias("ok"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("index", "line", "cited"))).alias("xs"))
    message = F.concat(F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" documents:\n"))).otherwise(""), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"))
    return g.select("qid", "ok", message.alias("message"), F.flatten(F.transform("xs", lambda x: x["cited"])).alias("citations"), F.when(~F.col("ok") & (F.col("n") > 1), "failed_for_all").alias("reason"))


def by_category(results: DataFrame, categories: list[str], unknown: str = "unclassified") -> DataFrame:
    """(qid, message): classified documents (qid, index, label, category) as a count by category and one line a document, in the order of the categories, the unclassified last."""
    order = [*categories, unknown]
    rows = results.withColumn("category", F.coalesce("category", F.lit(unknown)))
    place = F.lit(len(order))
    for i, c in reversed(list(enumerate(order))):
        place = F.when(F.col("category") == c, i).otherwise(place)
    rows = rows.withColumn("place", place)
    counts = rows.groupBy("qid", "category", "place").agg(F.count("*").alias("n")).groupBy("qid").agg(F.sum("n").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "category", "n"))), lambda x: F.concat(x["category"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("counts"))
    lines = rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "index", F.concat(F.lit("[D"), F.col("index").cast("string"), F.lit("] "), "label", F.lit(": "), "category").alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    return counts.join(lines, "qid").select("qid", F.concat(F.col("total").cast("string"), F.lit(" documents: "), "counts", F.lit("\n"), "lines").alias("message"))


def gate(passages: DataFrame, questions: DataFrame, least: float = search.LEAST) -> DataFrame:
    """(qid, best, relevant): first level of evidence, the best passage's score against ``least``."""
    best = passages.groupBy("qid").agg(F.max("score").alias("best"))
    return questions.select("qid").join(best, "qid", "left").select("qid", F.coalesce("best", F.lit(0.0)).alias("best"), (F.coalesce("best", F.lit(0.0)) >= least).alias("relevant"))


def judged(passages: DataFrame, questions: DataFrame, model: Model) -> DataFrame:
    """(qid, sufficient, why): second level, a model's judgement whether the passages (qid, rank, citation, text) hold the answer. What cannot be read is not sufficient."""
    block = F.concat(F.lit("["), "citation", F.lit("] "), "text")
    ctx = passages.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("t")))), lambda x: x["t"]), "\n").alias("ctx"))
    asked = questions.join(ctx, "qid").select("qid", F.concat(F.lit("SUFFICIENT?\n"), "text", F.lit("\n\n"), "ctx").alias("prompt"))
    said = capability.call(asked, model).select("qid", arrays.json_object(F.col("answer")).alias("j"))
    yes = F.lower(F.get_json_object("j", "$.sufficient")) == "true"
    return said.select("qid", F.coalesce(yes, F.lit(False)).alias("sufficient"), F.coalesce(F.get_json_object("j", "$.why"), F.lit("unreadable judgement")).alias("why"))


def next_step(relevant: Column, sufficient: Column, attempts: Column, stagnant: Column, most: int = ATTEMPTS) -> Column:
    """answer if both levels hold; else reformulate while attempts are left and the score moves; else refuse."""
    good = relevant & F.coalesce(sufficient, F.lit(False))
    return F.when(good, "answer").when((attempts >= most) | F.coalesce(stagnant, F.lit(False)), "refuse").otherwise("reformulate")


def attempts(questions: DataFrame, find: Callable[[DataFrame], DataFrame], model: Model, most: int = ATTEMPTS, least: float = search.LEAST, still: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, passages, trace) of the bounded search loop.

    ``find`` takes questions (qid, text) and gives passages (qid, rank, citation, text, score). Each round searches the questions that are still open, judges what was found, and reformulates the rest; a question whose best score moved less than ``still`` since its last attempt stops, as does one without attempts left. A reformulation that fails leaves the question as it is and still costs an attempt.
    outcomes: (qid, outcome, attempts, text); passages those of the last attempt of answered questions; trace: (qid, attempt, best, relevant, sufficient, step, text).
    """
    open_ = cut(questions.select("qid", "text", F.lit(None).cast("double").alias("last")))
    trace = passages = None
    for attempt in range(1, most + 1):
        found = cut(find(open_.select("qid", "text")))
        level = gate(found, open_, least)
        relevant = found.join(level.where("relevant").select("qid"), "qid", "left_semi")
        verdict = judged(relevant, open_.select("qid", "text"), model)
        state = open_.join(level, "qid").join(verdict, "qid", "left")
        stagnant = ~F.col("relevant") & F.col("last").isNotNull() & (F.abs(F.col("best") - F.col("last")) < still)
        state = state.withColumn("attempt", F.lit(attempt)).withColumn("step", next_step(F.col("relevant"), F.col("sufficient"), F.col("attempt"), stagnant, most))
        state = cut(state.select("qid", "attempt", "best", "relevant", "sufficient", "step", "text", "why"))
        trace = state if trace is None else trace.unionByName(state)
        good = found.join(state.where("step = 'answer'").select("qid"), "qid", "left_semi")
        passages = good if passages is None else passages.unionByName(good)
        rest = state.where("step = 'reformulate'")
        if rest.isEmpty():
            break
        why = F.when(F.col("relevant"), F.concat(F.lit("related, but the fact is missing: "), F.coalesce("why", F.lit("")))).otherwise("nothing relevant")
        said = capability.call(rest.select("qid", "text", "best", F.concat(F.lit("REFORMULATE\n"), "text", F.lit("\n"), why).alias("prompt")), model)
        new = F.nullif(F.trim(F.get_json_object(arrays.json_object(F.col("answer")), "$.query")), F.lit(""))
        open_ = cut(said.select("qid", F.coalesce(new, "text").alias("text"), F.col("best").alias("last")))
    last = trace.groupBy("qid").agg(F.max_by(F.struct("step", "attempt", "text"), "attempt").alias("l"))
    outcome = F.when(F.col("l.step") == "answer", "answered").otherwise("refused")
    return last.select("qid", outcome.alias("outcome"), F.col("l.attempt").cast("long").alias("attempts"), "l.text"), passages, trace.drop("why")


def generate(questions: DataFrame, passages: DataFrame, model: Model, bounds: DataFrame | None = None, limit: int = capability.BATCH) -> DataFrame:
    """(qid, status, answer, citations, repaired): answers of a model over passages (qid, rank, citation, doc_id, text) that fit the limit, their citations checked; one repair call for those that fail, and a refusal for those that fail again. No passage is a refusal without a call; a failed or empty call is an error."""
    from . import structure

    fit = structure.context(passages, "qid", "rank", F.length("text"), limit)
    block = F.concat(F.lit("["), "citation", F.lit("] "), F.when(F.col("cut"), F.substring("text", 1, limit)).otherwise(F.col("text")))
    ctx = fit.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))
    asked = questions.join(ctx, "qid").withColumn("prompt", F.concat(F.lit("ANSWER WITH CITATIONS\n"), "text", F.lit("\n\n"), "context"))
    first = cut(capability.call(asked.select("qid", "prompt", "context"), model).withColumn("answer", F.nullif(F.trim("answer"), F.lit(""))))
    said = first.where("answer is not null")
    checked = said.select("qid", "answer", "context").join(search.check_citations(said, fit, bounds), "qid")
    bad = checked.where("not valid")
    repair = capability.call(bad.select("qid", F.concat(F.lit("REPAIR CITATIONS\n"), "answer", F.lit("\n\n"), "context").alias("prompt")), model).select("qid", "answer").where("answer is not null")
    again = search.check_citations(repair, fit, bounds).join(repair, "qid").where("valid").select("qid", F.col("answer").alias("new"), F.col("citations").alias("new_citations"))
    got = questions.select("qid").join(first.select("qid", F.lit(True).alias("called")), "qid", "left").join(checked.select("qid", "answer", "valid", "citations"), "qid", "left").join(again, "qid", "left")
    none = F.array().cast("array<string>")
    status = F.when(F.col("called").isNull(), "refused").when(F.col("answer").isNull(), "error").when(F.col("valid") | F.col("new").isNotNull(), "answered").otherwise("refused")
    good = status == "answered"
    return got.select("qid", status.alias("status"), F.when(good, F.coalesce("new", "answer")).alias("answer"), F.when(good, F.coalesce("new_citations", "citations")).otherwise(none).alias("citations"), (good & F.col("new").isNotNull()).alias("repaired"))


def faithful(answers: DataFrame, sources: DataFrame, model: Model) -> DataFrame:
    """(qid, score, why): a model's judgement from 0 to 1 how far its sources (qid, citation, text) carry an answer (qid, question, answer): the first number of its words, of a hundred; null without sources or a readable number."""
    ctx = sources.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation", "text"))), lambda x: F.concat(F.lit("["), x["citation"], F.lit("] "), x["text"])), "\n\n").alias("ctx"))
    asked = answers.join(ctx, "qid", "left")
    said = capability.call(asked.where("ctx is not null").select("qid", F.concat(F.lit("FAITHFUL 0 TO 100?\n"), "ctx", F.lit("\n\nQUESTION\n"), "question", F.lit("\n\nANSWER\n"), "answer").alias("prompt")), model)
    n = F.regexp_extract(F.coalesce("answer", F.lit("")), r"\d{1,3}", 0).try_cast("int")
    got = answers.select("qid").join(said.select("qid", n.alias("n"), F.lit(True).alias("called")), "qid", "left")
    return got.select("qid", F.when(F.col("n").isNotNull(), F.round(F.least(F.col("n"), F.lit(100)) / 100.0, 2)).alias("score"), F.when(F.col("called").isNull(), "no_source").when(F.col("n").isNull(), "unreadable").alias("why"))


def respond(questions: DataFrame, corpora: DataFrame, find: Callable[[DataFrame], DataFrame], model: Model, most: int = ATTEMPTS) -> DataFrame:
    """(qid, status, answer, citations, attempts, error): the whole way of a batch of questions (qid, text, corpus_id). An empty question or an unknown corpus is an error row; nothing raises for one question."""
    known = questions.join(corpora.select("corpus_id", F.lit(True).alias("known")), "corpus_id", "left")
    error = F.when(F.trim(F.coalesce(F.col("text"), F.lit(""))) == "", "empty_question").when(F.col("known").isNull(), "unknown_corpus")
    checked = known.select("qid", "text", error.alias("error"))
    good = checked.where("error is null").select("qid", "text")
    outcomes, passages, _ = attempts(good, find, model, most)
    answers = generate(outcomes.where("outcome = 'answered'").select("qid", "text"), passages, model)
    got = checked.select("qid", "error").join(outcomes.select("qid", "attempts"), "qid", "left").join(answers.select("qid", "status", "answer", "citations"), "qid", "left")
    return got.select("qid", F.when(F.col("error").isNotNull(), "error").otherwise(F.coalesce("status", F.lit("refused"))).alias("status"), "answer", F.coalesce("citations", F.array().cast("array<string>")).alias("citations"), F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), "error")


def resolved(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """(qid, status): whether questions name documents; none for those without."""
    return questions.select("qid").join(perimeter.from_questions(questions, cards).select("qid", "status"), "qid", "left").select("qid", F.coalesce("status", F.lit("none")).alias("status"))


def response(capability_: str, results: DataFrame, relevant: Column, sufficient: Column) -> DataFrame:
    """Results (qid, status, answer, citations) of any capability in one shape: (qid, capability, ok, refused, answer, citations, relevant, sufficient)."""
    s = F.col("status")
    return results.select("qid", F.lit(capability_).alias("capability"), s.isin("answered", "complete", "partial", "ok").alias("ok"), s.isin("refused", "uncited", "no_passage").alias("refused"), "answer", "citations", relevant.alias("relevant"), sufficient.alias("sufficient"))


def envelopes(steps: DataFrame) -> DataFrame:
    """(request, kind, started, ended, seconds, outcome): steps (request, kind, phase started, completed or failed, ts, success, refused) of each request as one event with its duration; a step that never ended is an error."""
    g = steps.groupBy("request", "kind").agg(F.min(F.when(F.col("phase") == "started", F.col("ts"))).alias("started"), F.max(F.when(F.col("phase") != "started", F.col("ts"))).alias("ended"), F.bool_or(F.col("phase") == "failed").alias("failed"), F.bool_or(F.col("phase") == "completed").alias("completed"), F.bool_or("refused").alias("refused"))
    outcome = F.when(F.col("failed") | ~F.col("completed"), "error").when(F.coalesce("refused", F.lit(False)), "refusal").otherwise("success")
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    return g.select("request", "kind", "started", "ended", seconds.alias("seconds"), outcome.alias("outcome"))


def with_ids(requests: DataFrame, request: str = "request") -> DataFrame:
    """requests with request_id (given if it has the allowed form, else made from the row) and execution_id, both the same on every run."""
    from ..sources import registry

    given = F.col(request)
    made = registry.uuid5(F.to_json(F.struct(*requests.columns)))
    rid = F.when(text.is_request_id(given), given).otherwise(made)
    return requests.withColumn("request_id", rid).withColumn("execution_id", registry.uuid5(F.concat(rid, F.lit(":execution"))))
