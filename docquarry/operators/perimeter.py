"""Perimeters: the documents that a question, its caller or its filters restrict a search to.

References, cards and sources are tables; nothing is looked up one by one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import resolve
from .filters import SCOPE

# Words and signs that part the documents of an enumeration.
COORDINATORS = ["et", "and", "vs", "vs.", "versus", "avec", "with", "par rapport a", "par rapport à", "par rapport au", "par rapport aux", "face a", "face à", "face au", "face aux"]
#: Rows of references or names that meet in a partition. A key that more than one row in COMMON holds is common.
EACH, COMMON = 1 << 17, 1000


def identify(references: DataFrame, cards: DataFrame) -> DataFrame:
    """(qid, pos, reference, doc_id): the card (doc_id, file_name, source, title) that a reference names: by id, file name, source or title as it stands, else by any of these as a document key; of several the one of the least doc_id. doc_id is null for an unknown reference."""
    return _identified(references, cards)[0]


def _common(df: DataFrame, *keys: str) -> tuple[int, dict[str, set[str]]]:
    """The number of rows, and of each column the values that more than one row in COMMON holds, by a sketch of bounded size. Only the dealing of rows hangs on them."""
    found = df.agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"approx_top_k({k}, {COMMON}, {10 * COMMON})").alias(k) for k in keys)).first()
    return found["n"], {k: {x["item"] for x in found[k] if x["item"] is not None and x["count"] > max(64, found["n"] / COMMON)} for k in keys}


def _identified(references: DataFrame, cards: DataFrame) -> tuple[DataFrame, int]:
    """``identify``, and the number of partitions it takes: it follows the rows, which are counted, as the planner knows the compressed bytes of files alone.

    Names are dealt by their key before they are grouped, so a scan gathers none, and they meet the references by merging, as the planner would broadcast all of them. Common keys are settled apart: they are few, so theirs are broadcast, and references that hold one, or none, are dealt by their question.
    """
    names = cards.select("doc_id", F.explode(F.array(F.col("doc_id").cast("string"), "file_name", "source", "title")).alias("name")).where("name is not null")
    names = names.select("doc_id", F.trim("name").alias("r"), text.document_key(F.col("name")).alias("rk"))
    got = references.select("qid", "pos", "reference", F.trim("reference").alias("r"), text.document_key(F.col("reference")).alias("rk"))
    (asked, theirs), (named, ours) = _common(got, "r", "rk"), _common(names, "r", "rk")
    n = max(1, -(-max(asked, named) // EACH))
    for key, by in (("r", "by_name"), ("rk", "by_key")):
        own = names.select(F.col(key).alias("k"), "doc_id").where("true" if key == "r" else "k != ''")
        common = sorted(theirs[key] | ours[key])
        apart = F.col(key).isNull() | F.col(key).isin(common)
        got = got.withColumn("place", F.when(apart, F.xxhash64("qid", "pos")).otherwise(F.xxhash64(key))).repartition(n, "place", key)
        rest = own.where(~F.col("k").isin(common)).withColumn("at", F.xxhash64("k")).repartition(n, "at", "k").groupBy("at", "k").agg(F.min("doc_id").alias(by))
        got = got.join(rest.hint("merge"), (F.col("place") == F.col("at")) & (F.col(key) == F.col("k")), "left").drop("place", "at", "k")
        if common:
            few = own.where(F.col("k").isin(common)).groupBy("k").agg(F.min("doc_id").alias("few"))
            got = got.join(F.broadcast(few), F.col(key) == F.col("k"), "left").withColumn(by, F.coalesce(by, "few")).drop("k", "few")
    return got.select("qid", "pos", "reference", F.coalesce("by_name", "by_key").alias("doc_id")), n


def one_document(references: DataFrame, cards: DataFrame) -> DataFrame:
    """(qid, status, doc_id): references that must all name one and the same document: ok, unknown_reference or several_documents."""
    g = identify(references, cards).groupBy("qid").agg(F.count_if(F.col("doc_id").isNull()).alias("unknown"), F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("doc_id"))
    status = F.when(F.col("unknown") > 0, "unknown_reference").when(F.col("n") > 1, "several_documents").otherwise("ok")
    return g.select("qid", status.alias("status"), F.when(status == "ok", F.col("doc_id")).alias("doc_id"))


def many_documents(references: DataFrame, cards: DataFrame) -> DataFrame:
    """(qid, place, doc_id): the documents that references name, once each, in the order of their first reference; unknown ones are left out."""
    g = identify(references, cards).where("doc_id is not null").groupBy("qid", "doc_id").agg(F.min("pos").alias("pos"))
    return g.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("pos")).cast("long").alias("place"), "doc_id")


def _labelled(cards: DataFrame) -> DataFrame:
    return cards.select("doc_id", "file_name", "source", F.coalesce("title", "file_name", "source", F.col("doc_id").cast("string")).alias("label"))


def _listed() -> Column:
    """The known documents of a question's rows (pos, doc_id, file_name, source, label), in order."""
    clean = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return F.array_sort(F.collect_list(F.when(F.col("doc_id").isNotNull(), F.struct("pos", *(clean(c).alias(c) for c in SCOPE), "label"))))


def _assembled(listed: DataFrame, origin: str) -> DataFrame:
    """(qid, status, field, values, labels, origin) of listed documents (qid, xs, unknown): the first of SCOPE that all of them have is the field; without one the perimeter is ambiguous and binds nothing. Unknown references (null: there are none) take the place of everything else."""
    field = F.coalesce(*(F.when(F.col("unknown").isNull() & F.forall("xs", lambda x: x[c].isNotNull()), F.lit(c)) for c in SCOPE))  # noqa: B023
    value = lambda x: F.coalesce(*(F.when(F.col("field") == c, x[c]) for c in SCOPE))
    got = listed.withColumn("field", field)
    status = F.when(F.col("unknown").isNotNull(), "unknown").when(F.col("field").isNull(), "ambiguous").when(F.size("xs") == 1, "exact").otherwise("compatible")
    labels = F.coalesce("unknown", F.transform("xs", lambda x: x["label"]))
    return got.select("qid", status.alias("status"), "field", F.when(F.col("field").isNotNull(), F.transform("xs", value)).alias("values"), labels.alias("labels"), F.lit(origin).alias("origin"))


def explicit(references: DataFrame, cards: DataFrame) -> DataFrame:
    """Perimeters that callers impose by references (qid, pos, reference). One unknown reference makes the whole perimeter unknown: nothing is searched rather than too much."""
    found, n = _identified(references, cards)
    missing = F.col("doc_id").isNull()
    # Unknown references have no doc_id to be dealt by; they go by their question.
    found = found.select("qid", "pos", "doc_id", F.when(missing, F.col("reference")).alias("unknown"), F.when(missing, F.xxhash64("qid")).otherwise(F.xxhash64("doc_id")).alias("place"))
    once = found.repartition(n, "place", "doc_id").groupBy("qid", "place", "doc_id", "unknown").agg(F.min("pos").alias("pos"))
    card = _labelled(cards).withColumn("place", F.xxhash64("doc_id")).repartition(n, "place", "doc_id")
    rows = once.join(card.hint("merge"), ["place", "doc_id"], "left").repartition(n, "qid")
    unknown = F.when(F.count_if(missing) > 0, F.array_sort(F.collect_set("unknown")))
    return _assembled(rows.groupBy("qid").agg(_listed().alias("xs"), unknown.alias("unknown")), "explicit")


def from_filter(questions: DataFrame, field: str, values: tuple[str, ...]) -> DataFrame:
    """The perimeter that a filter on a document column sets for all questions; its values are taken as they are."""
    v = F.array(*map(F.lit, values))
    return questions.select("qid", F.lit("exact" if len(values) == 1 else "compatible").alias("status"), F.lit(field).alias("field"), v.alias("values"), v.alias("labels"), F.lit("explicit").alias("origin"))


def from_questions(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """Perimeters that questions set by naming documents: their resolution where it is reliable (exact or compatible); ambiguous or weak ones bind nothing."""
    titled = cards.select("doc_id", F.coalesce("title", "file_name", F.col("doc_id").cast("string")).alias("title"))
    sure = resolve.resolve(questions, titled).where(F.col("status").isin("exact", "compatible"))
    found = sure.join(titled, sure["first_label"] == titled["title"]).select("qid", F.col("doc_id").alias("pos"), "doc_id")
    listed = found.join(_labelled(cards).hint("merge"), "doc_id").groupBy("qid").agg(_listed().alias("xs"))
    return _assembled(listed.withColumn("unknown", F.lit(None).cast("array<string>")), "question")


def fragments(questions: DataFrame) -> DataFrame:
    """(qid, pos, text): a question and its parts between commas, semicolons and coordinating words, once each."""
    words = "|".join(re.escape(w) for w in sorted(COORDINATORS, key=len, reverse=True))
    parts = F.concat(F.array("text"), F.split(F.regexp_replace("text", rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])", ","), "[,;]"))
    clean = F.array_distinct(F.filter(F.transform(parts, text.collapse), lambda x: x != ""))
    return questions.select("qid", F.posexplode(clean).alias("pos", "text"))


def named_documents(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """(qid, place, doc_id): documents that a question or any of its fragments names reliably, once each, in order."""
    parts = fragments(questions)
    keyed = parts.select(F.struct("qid", "pos").alias("qid"), "text")
    titled = cards.select("doc_id", F.coalesce("title", "file_name").alias("title"))
    sure = resolve.resolve(keyed, titled).where(F.col("status").isin("exact", "compatible"))
    found = sure.join(titled, sure["first_label"] == titled["title"]).select("qid.qid", "qid.pos", "doc_id")
    first = found.groupBy("qid", "doc_id").agg(F.min("pos").alias("pos"))
    return first.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "doc_id")).cast("long").alias("place"), "doc_id")


def outside(perimeter_values: Column, *identities: Column) -> Column:
    """Whether a passage is known to lie outside: it has some identity and none of them is in the perimeter. A passage without any is let through."""
    own = F.filter(F.array(*(F.trim(i.cast("string")) for i in identities)), lambda x: x.isNotNull() & (x != ""))
    return (F.size(own) > 0) & ~F.arrays_overlap(own, perimeter_values)


def _named(sources: DataFrame, asked: DataFrame) -> DataFrame:
    """Sources (qid, doc_id, file_name, source, ...) with the names (qid, document) that are part of their identity."""
    whole = text.source_identity(F.col("file_name"), F.col("source"), F.col("doc_id").cast("string"))
    names = asked.select(F.col("qid").alias("asked_qid"), F.lower(F.trim("document")).alias("asked")).where("asked != ''")
    return sources.join(names, (F.col("qid") == F.col("asked_qid")) & F.contains(whole, F.col("asked")))


def only_document(sources: DataFrame, asked: DataFrame) -> DataFrame:
    """Sources of the one document that a question's name (qid, document) fits, so that documents are never mixed; none if it fits no document or several."""
    fit = _named(sources, asked)
    one = fit.groupBy("qid").agg(F.countDistinct("doc_id").alias("n_")).where("n_ = 1").select("qid")
    return fit.join(one, "qid", "left_semi").drop("asked_qid", "asked")


def only_documents(sources: DataFrame, asked: DataFrame) -> DataFrame:
    """Sources of all documents that any of a question's names fits."""
    return sources.join(_named(sources, asked).select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")
