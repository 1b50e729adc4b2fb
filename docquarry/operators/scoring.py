"""Verdicts on answered cases, as column expressions over what a case expected and what came out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, text, values
from . import evaluate

# Outcomes of a scored case and categories of its failure.
PASS, WRONG, ANSWER_ONLY, RETRIEVAL_ONLY, UNSUPPORTED, ABSTAIN, TECHNICAL = "PASS", "WRONG", "ANSWER_ONLY", "RETRIEVAL_ONLY", "UNSUPPORTED", "ABSTAIN_CORRECT", "TECHNICAL_ERROR"
FAILURES = (
    "DOCUMENT_RETRIEVAL_FAILURE", "EVIDENCE_RETRIEVAL_FAILURE", "PROVENANCE_FAILURE", "GENERATION_FAILURE", "EXTRACTION_FAILURE", "CLASSIFICATION_FAILURE", "SUMMARIZATION_FAITHFULNESS_FAILURE",
    "CORRECT_ABSTENTION", "MISSING_DOCUMENT_EXCLUDED", "TECHNICAL_FAILURE", "ROUTING_FAILURE",
)
DOCUMENT, EVIDENCE, PROVENANCE, GENERATION, EXTRACTION, CLASSIFICATION, FAITHFULNESS, ABSTENTION, EXCLUDED, BROKEN, ROUTING = FAILURES
#: Least groundedness of a sourced answer and of a supported one, evidence that counts as found, bearing tokens of a covered answer.
GROUNDED, SUPPORTED, FOUND, COVERED = 0.5, 0.3, 0.3, 0.6


def _verdict(*rules: tuple[Column, str, str | None], otherwise: tuple[str, str | None]) -> Column:
    """struct(verdict, failure) of the first rule that holds."""
    one = lambda v, f: F.struct(F.lit(v).alias("verdict"), F.lit(f).cast("string").alias("failure"))
    out = one(*otherwise)
    for when, v, f in reversed(rules):
        out = F.when(F.coalesce(when, F.lit(False)), one(v, f)).otherwise(out)
    return out


def refused(sufficient: Column, n_sources: Column) -> Column:
    """A refusal is read from the state of a result, not from its words."""
    return ~F.coalesce(sufficient, F.lit(False)) | (F.coalesce(n_sources, F.lit(0)) == 0)


def conforms(sources: Column, expected: Column) -> Column:
    """struct(ok, why): whether one of the sources' names fits the expected document: either holds the other after normalisation. Nothing expected is ok; no source is not."""
    want = text.comparable(expected)
    fit = F.exists(sources, lambda s: (text.comparable(s) != "") & (F.contains(text.comparable(s), want) | F.contains(want, text.comparable(s))))
    nothing = F.coalesce(want, F.lit("")) == ""
    why = F.when(nothing, "nothing_expected").when(F.size(sources) == 0, "no_source").when(fit, "fits").otherwise("other_documents")
    return F.struct((nothing | F.coalesce(fit & (F.size(sources) > 0), F.lit(False))).alias("ok"), why.alias("why"))


def covers(answer: Column, expected: Column, variants: Column, evidence: Column, question: Column) -> Column:
    """Whether an answer holds the expected information: it matches the expected answer or a variant, or has most of the expected tokens that the evidence has and the question lacks (or, without such, that the question lacks), all numbers among them included."""
    plain = F.exists(F.concat(F.array(expected), F.coalesce(variants, F.array().cast("array<string>"))), lambda x: (F.coalesce(x, F.lit("")) != "") & values.answers_match(x, answer))
    toks = lambda c: F.array_distinct(text.eval_tokens(F.coalesce(c, F.lit(""))))
    own = F.array_except(F.array_intersect(toks(expected), toks(evidence)), toks(question))
    bearing = F.when(F.size(own) > 0, own).otherwise(F.array_except(toks(expected), toks(question)))

    def close(b: Column) -> Column:
        numbers = F.filter(b, lambda x: x.rlike(r"^\d+$"))
        return (F.size(b) > 0) & (F.size(F.array_except(numbers, toks(answer))) == 0) & (arrays.share(b, toks(answer)) >= COVERED)

    return F.coalesce(plain, F.lit(False)) | text.let(bearing, close)


def search_verdict(is_refusal: Column, exact: Column, cited: Column, valid: Column, grounded: Column, coverage: Column) -> Column:
    """struct(verdict, failure) of an answered question. ``coverage`` is null where nothing was to be covered."""
    sourced = valid & (grounded >= GROUNDED)
    return _verdict(
        (is_refusal & ~cited, WRONG, DOCUMENT), (is_refusal, WRONG, EVIDENCE), (exact & cited & sourced, PASS, None), (exact, ANSWER_ONLY, PROVENANCE),
        (cited & (coverage.isNull() | (coverage >= FOUND)), RETRIEVAL_ONLY, GENERATION), (grounded < SUPPORTED, UNSUPPORTED, PROVENANCE), otherwise=(WRONG, GENERATION),
    )


def extract_verdict(succeeded: Column, sources_ok: Column, disagree: Column, precise: Column) -> Column:
    """disagree: some field was found that should not be, or the reverse; precise: every found value stands in its reference."""
    return _verdict((~succeeded, WRONG, EXTRACTION), (sources_ok & ~disagree & precise, PASS, None), (disagree, WRONG, EXTRACTION), otherwise=(UNSUPPORTED, PROVENANCE))


def classify_verdict(mode: Column, document_ok: Column, searched: Column, category: Column, known: Column, sourced: Column) -> Column:
    """A classification has no gold category: it must be of the whole right document, without a search, of the taxonomy, and with sources; none is a correct abstention."""
    whole = (mode == "whole_document") & document_ok
    return _verdict(
        (~whole, WRONG, DOCUMENT), (searched, WRONG, CLASSIFICATION), (category.isNotNull() & ~known, WRONG, CLASSIFICATION), (category.isNotNull() & ~sourced, UNSUPPORTED, PROVENANCE),
        (category.isNull(), ABSTAIN, ABSTENTION), otherwise=(PASS, None),
    )


def missing_document_verdict(succeeded: Column, mode: Column) -> Column:
    """The classification of a document that is not there: a refusal is right, an answer from other sources is wrong."""
    return _verdict((~succeeded & (mode == "unresolved_document"), ABSTAIN, EXCLUDED), (succeeded & (mode == "given_context"), WRONG, CLASSIFICATION), otherwise=(TECHNICAL, BROKEN))


def numbers_clash(summary: Column, expected: Column) -> Column:
    """Both texts have numbers and share none."""
    n = lambda c: F.array_distinct(F.filter(text.eval_tokens(F.coalesce(c, F.lit(""))), lambda t: t.rlike(r"^\d+$")))
    return (F.size(n(summary)) > 0) & (F.size(n(expected)) > 0) & ~F.arrays_overlap(n(summary), n(expected))


def summarize_verdict(succeeded: Column, document_ok: Column, searched: Column, sources_ok: Column, clash: Column) -> Column:
    return _verdict((~succeeded, WRONG, PROVENANCE), (~document_ok, WRONG, DOCUMENT), (searched | ~sources_ok, WRONG, PROVENANCE), (clash, UNSUPPORTED, FAITHFULNESS), otherwise=(PASS, None))


def outside_verdict(is_refusal: Column) -> Column:
    """A question whose answer the corpus does not hold: only a refusal is right."""
    return _verdict((is_refusal, ABSTAIN, ABSTENTION), otherwise=(UNSUPPORTED, PROVENANCE))


def case_verdict(capability: Column, error: Column, expected_tool: Column, tool: Column, by_capability: dict[str, Column]) -> Column:
    """struct(verdict, failure) of a case: a technical error first, then a wrong route, then the verdict of its capability."""
    out = F.struct(F.lit(TECHNICAL).alias("verdict"), F.lit(BROKEN).cast("string").alias("failure"))
    for name, verdict in by_capability.items():
        out = F.when(capability == name, verdict).otherwise(out)
    technical, route = (F.struct(F.lit(v).alias("verdict"), F.lit(f).cast("string").alias("failure")) for v, f in ((TECHNICAL, BROKEN), (WRONG, ROUTING)))
    return F.when(F.coalesce(error, F.lit("")) != "", technical).when(~F.coalesce(tool == expected_tool, F.lit(False)), route).otherwise(out)


def mean(c: Column, where: Column | None = None) -> Column:
    """Mean of the values there are, 0 for none; ``where`` keeps some rows only."""
    return F.coalesce(F.avg(c if where is None else F.when(where, c)), F.lit(0.0))


def rate(condition: Column, where: Column | None = None) -> Column:
    return mean(F.coalesce(condition, F.lit(False)).cast("double"), where)


def without_errors(cases: DataFrame) -> DataFrame:
    """Cases whose run did not fail (error null or empty)."""
    return cases.where(F.coalesce("error", F.lit("")) == "")


def answers_report(cases: DataFrame, by: list[str]) -> DataFrame:
    """Rates of answered cases (outcome, answerable, refused) by group: success, correct refusals of the unanswerable, wrong refusals of the answerable, answers to the unanswerable, and technical errors (over all rows)."""
    ok = F.coalesce("error", F.lit("")) == ""
    r6 = lambda c: F.round(c, 6)
    a = F.col("answerable")
    return cases.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_run"), r6(rate(F.col("outcome") == "SUCCES", ok)).alias("success"), r6(rate(F.col("refused"), ok & ~a)).alias("right_refusals"),
        r6(rate(F.col("refused"), ok & a)).alias("wrong_refusals"), r6(rate(~F.col("refused"), ok & ~a)).alias("invented"), r6(rate(~ok)).alias("errors"),
    )


def attempts_report(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Cost and use of reformulations from attempts (qid, attempt, score, seconds, good) by group: attempts a question, share that needed more than one, share that a later attempt turned good, mean gain from first to last score, and percentiles of the seconds a question."""
    first, last = F.min_by(F.struct("score", "good"), "attempt"), F.max_by(F.struct("score", "good"), "attempt")
    per = attempts.groupBy(*by, "qid").agg(F.max("attempt").alias("n"), first.alias("first"), last.alias("last"), F.sum("seconds").alias("seconds"))
    r6 = lambda c: F.round(c, 6)
    again = F.col("n") > 1
    main = per.groupBy(*by).agg(
        F.count("*").alias("questions"), r6(mean(F.col("n"))).alias("attempts"), r6(rate(again)).alias("reformulated"), r6(rate(F.col("last.good") & ~F.col("first.good"), again)).alias("rescued"),
        r6(mean(F.col("last.score") - F.col("first.score"), again)).alias("gain"),
    )
    times = evaluate.half_even_percentile(per, by, "seconds", [0.5, 0.95]).drop("n")
    return main.join(times, by)


def evidence_report(cases: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(scope, n, coverage, covered, groundedness) of cases (coverage, groundedness, document_found): over all, and over those whose document was found."""
    r6 = lambda c: F.round(c, 6)
    scopes = F.explode(F.when(F.col("document_found"), F.array(F.lit("all"), F.lit("document_found"))).otherwise(F.array(F.lit("all"))))
    return cases.withColumn("scope", scopes).groupBy("scope").agg(F.count("*").alias("n"), r6(mean(F.col("coverage"))).alias("coverage"), r6(rate(F.col("coverage") >= threshold)).alias("covered"), r6(mean(F.col("groundedness"))).alias("groundedness"))


def routing_report(cases: DataFrame) -> DataFrame:
    """(category, n, detection, operation, exact) of cases (category, expected_multi, expected_operation, is_multi, operation): shares that agree, by category and over all (category null)."""
    d, o = F.col("is_multi") == F.col("expected_multi"), F.col("operation") == F.col("expected_operation")
    r6 = lambda c: F.round(c, 6)
    return cases.rollup("category").agg(F.count("*").alias("n"), r6(rate(d)).alias("detection"), r6(rate(o)).alias("operation"), r6(rate(d & o)).alias("exact"))


def failures(answers: DataFrame, evidence: DataFrame, documents: DataFrame, most: int = 400) -> DataFrame:
    """(id, priority, outcome, coverage, document_rank, answer): the failed cases of three reports that meet by id, most urgent first: invented answers, then failed generation, failed retrieval, wrong refusals, the rest; answers are cut for reading."""
    bad = answers.where(~F.col("outcome").isin("SUCCES", "REFUS_CORRECT"))
    priority = F.lit(5)
    for i, o in reversed(list(enumerate(("FAUX_POSITIF", "ECHEC_GENERATION", "ECHEC_RETRIEVAL", "REFUS_INCORRECT")))):
        priority = F.when(F.col("outcome") == o, i + 1).otherwise(priority)
    got = bad.join(evidence.select("id", "coverage"), "id", "left").join(documents.select("id", "document_rank"), "id", "left")
    place = F.row_number().over(Window.partitionBy("outcome").orderBy("id")).cast("long")
    return got.select("id", priority.cast("long").alias("priority"), "outcome", place.alias("place"), "coverage", "document_rank", text.excerpt(F.col("answer"), most).alias("answer"))
