"""Documents that a question names, and canonical names of entities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.values import comparison_key
from ..session import cut, ship
from . import likeness, retrieval

THRESHOLD, MARGIN, BOOST = 0.55, 0.15, 1.15
# Phrases that restrict a question to a source.
SCOPE_MARKS = ["document", "report", "file", "filing", "statement", "edition", "according to", "based on", "from the", "in the", "rapport", "fichier", "dossier", "selon", "d apres", "dans le"]


def signatures(cards: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, token): identifying tokens of each card's label."""
    return cards.select(key, label, F.explode(text.useful_tokens(F.col(label))).alias("token"))


def _marked(question: Column) -> Column:
    plain = F.array_join(text.tokens(question), " ")
    out = F.lit(False)
    for m in SCOPE_MARKS:
        out = out | F.contains(plain, F.lit(m))
    return out


def _label_page(b: pa.RecordBatch):
    return [b.column(c).to_pylist() for c in ("label", "n_cards", "tokens", "idfs")]


def _question_block(b: pa.RecordBatch):
    return [b.column(c).to_pylist() for c in ("text", "tokens", "marked")]


def _named_groups(page, block):
    """Of a page of labels, for each question the groups of the two highest scores: (text, score, found, n_documents, first_label)."""
    labels, n_cards, tokens, idfs = page
    texts, asked, marked = block
    column = {t: i for i, t in enumerate(dict.fromkeys(t for ts in asked for t in ts))}
    have = np.zeros((len(labels), len(column)))
    for r, (ts, ws) in enumerate(zip(tokens, idfs, strict=True)):
        for t, w in zip(ts, ws, strict=True):
            if t in column:
                have[r, column[t]] = w
    ask = np.zeros((len(texts), len(column)))
    for r, ts in enumerate(asked):
        ask[r, [column[t] for t in ts]] = 1
    share = (ask @ have.T) / np.array([sum(ws) for ws in idfs])[None]
    score = np.round(np.where(np.array(marked)[:, None], np.minimum(1, share * BOOST), share), 6)
    out: list[tuple] = []
    for q in range(len(texts)):
        top = np.unique(score[q][score[q] > 0])[-2:]
        groups: dict[tuple, list] = {}
        for r in np.flatnonzero(score[q] >= top[0]) if len(top) else ():
            own = " ".join(sorted(t for t in tokens[r] if t in column and ask[q, column[t]]))
            g = groups.setdefault((float(score[q, r]), own), [0, labels[r]])
            g[0], g[1] = g[0] + n_cards[r], min(g[1], labels[r])
        out += [(texts[q], s, found, n, first) for (s, found), (n, first) in groups.items()]
    return list(zip(*out, strict=True)) or [()] * 5


def resolve(questions: DataFrame, cards: DataFrame, key: str = "doc_id", label: str = "title") -> DataFrame:
    """(qid, status, score, n_documents, first_label, second_score): the documents that a question names.

    A card's score is the idf of its label's tokens found in the question over that of all its tokens, times BOOST under a scope phrase (1 at most). Cards equal in score and tokens are one group. Under THRESHOLD nothing is named; a lead under MARGIN is ambiguous; one document is exact, several are compatible. Labels in pages meet questions in blocks, and only the groups of a page's two highest scores leave it, so a token that most labels have costs no more than others.
    """
    ship(cards.sparkSession)
    labels = cards.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.countDistinct(key).alias("n_cards"))  # cards of one label are scored once
    sigs = signatures(labels, "n_cards", "label")
    n = cards.select(F.greatest(F.countDistinct(key), F.lit(1)).alias("n"))
    weights = sigs.groupBy("token").agg(F.sum("n_cards").alias("df")).crossJoin(F.broadcast(n)).select("token", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))
    weighted = sigs.join(weights, "token").groupBy("label", "n_cards").agg(F.array_sort(F.collect_list(F.struct("token", "idf"))).alias("ts")).select("label", "n_cards", F.col("ts.token").alias("tokens"), F.col("ts.idf").alias("idfs"))
    texts = questions.select("text").where("text is not null").distinct()  # questions of one text, too
    asked = texts.select("text", F.array_distinct(text.tokens(F.col("text"))).alias("tokens"), _marked(F.col("text")).alias("marked"))
    pages, blocks = retrieval.packed(weighted, "page", _label_page, retrieval.PAGE), retrieval.packed(asked, "block", _question_block, retrieval.QUERY_BLOCK * 4)
    met = retrieval.meet(pages, blocks, _named_groups, "text string, score double, found string, n_documents long, first_label string")
    groups = met.groupBy("text", "score", "found").agg(F.sum("n_documents").alias("n_documents"), F.min("first_label").alias("first_label"))
    w = Window.partitionBy("text").orderBy(F.col("score").desc(), "first_label", "found")
    ranked = groups.withColumn("place", F.row_number().over(w)).withColumn("second_score", F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("place = 1")
    got = questions.select("qid", "text").join(ranked, "text", "left")
    status = (
        F.when(F.col("score").isNull() | (F.col("score") < THRESHOLD), "none").when(F.col("score") - F.col("second_score") < MARGIN, "ambiguous")
        .when(F.col("n_documents") == 1, "exact").otherwise("compatible")
    )
    return got.select("qid", status.alias("status"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"), "first_label", F.coalesce("second_score", F.lit(0.0)).alias("second_score"))


def exact_entities(values: DataFrame, aliases: DataFrame) -> DataFrame:
    """(value, canonical, phase): a value meets a canonical name by its comparison key, else an alias, else it is new and its own canonical. aliases: (canonical, alias)."""
    k = values.select("value", comparison_key(F.col("value")).alias("k")).distinct()
    names = aliases.groupBy(comparison_key(F.col("canonical")).alias("k")).agg(F.min("canonical").alias("by_name"))
    other = aliases.groupBy(comparison_key(F.col("alias")).alias("k")).agg(F.min("canonical").alias("by_alias"))
    got = k.join(names, "k", "left").join(other, "k", "left")
    phase = F.when(F.col("by_name").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").otherwise("new")
    return got.select("value", F.coalesce("by_name", "by_alias", "value").alias("canonical"), phase.alias("phase"))


def fuzzy_entities(values: DataFrame, threshold: float = 0.88) -> DataFrame:
    """(field, value, canonical, ratio): values in the order given (pos). A value becomes canonical unless an earlier one of its field is at least as like it as the threshold; then it gets the canonical name of the most alike, of a tie the one that became canonical first. So names chain: what was met becomes an alias that later values meet too.

    Whether a value is canonical needs only its earlier neighbours, so they come from one similarity join (``likeness``) and canonical names from following links; no task holds a field. Spellings that differ in case and space alone are one name.
    """
    first = values.groupBy("field", "value").agg(F.min("pos").alias("pos")).withColumn("k", F.lower(text.collapse(F.col("value"))))
    names = cut(first.groupBy("field", "k").agg(F.min(F.struct("pos", "value")).alias("m")).select("field", "k", F.col("m.pos").cast("long").alias("ord"), F.col("m.value").alias("name")))
    best = cut(likeness.closest(likeness.pairs(names, threshold)))
    roots = canonicals(best, names.select("field", F.col("k").alias("other"), F.col("ord").alias("rank"), F.col("name").alias("canonical")))
    ratio = F.when(F.col("value") != F.col("name"), 1.0).otherwise(F.coalesce("ratio", F.lit(1.0)))
    found = first.join(names.select("field", "k", "name"), ["field", "k"]).join(roots, ["field", "k"], "left").join(best.select("field", "k", "ratio").distinct(), ["field", "k"], "left")
    return found.select("field", "value", F.coalesce("canonical", "name").alias("canonical"), ratio.alias("ratio"))


def canonicals(links: DataFrame, names: DataFrame) -> DataFrame:
    """(field, k, canonical): of the names that a linked name reaches the first; names (field, other, rank, canonical)."""
    reached = likeness.ends(links).join(names, ["field", "other"])
    return reached.groupBy("field", "k").agg(F.min(F.struct("rank", "canonical")).alias("m")).select("field", "k", F.col("m.canonical").alias("canonical"))


# Nouns of a publication, and the qualifiers that may stand between a year and such a noun.
PUBLICATION_WORDS = "report reports statement statements filing filings edition document documents review rapport rapports exercice millesime".split()
PUBLICATION_QUALIFIERS = "annual integrated sustainability financial interim consolidated final draft full half year annuel annuelle integre integree financier financiere consolide consolidee intermediaire finale".split()


def publication_years(toks):
    """struct(publication, named) of a token array: a year right behind a publication noun, or before one with only qualifiers between (within three tokens), dates a publication; any other year is a value's. Both sorted and distinct."""
    place = F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1)))

    def dated(i):
        at = lambda k: F.coalesce(F.get(toks, i - 1 + k), F.lit(""))
        noun, qualifier = (lambda k: at(k).isin(PUBLICATION_WORDS)), (lambda k: at(k).isin(PUBLICATION_QUALIFIERS))
        return noun(-1) | noun(1) | (qualifier(1) & noun(2)) | (qualifier(1) & qualifier(2) & noun(3))

    years = F.filter(F.transform(place, lambda i: F.struct(F.coalesce(F.get(toks, i - 1), F.lit("")).alias("y"), F.coalesce(dated(i), F.lit(False)).alias("p"))), lambda x: x["y"].rlike(r"^(19|20)\d{2}$"))
    pick = lambda want: F.array_sort(F.array_distinct(F.transform(F.filter(years, lambda x: x["p"] == F.lit(want)), lambda x: x["y"].cast("int"))))
    return F.struct(pick(True).alias("publication"), pick(False).alias("named"))


def verbatim(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, status, doc_id): identifier-shaped words of a question (a separator, digit or extension in them), freed of quotes and punctuation at their ends, against identifiers without regard to case; exact if they name one document in all."""
    words = F.transform(F.split("text", r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"""^["'`()\[\]{}<>.,;:!?…“”«»]+|["'`()\[\]{}<>.,;:!?…“”«»]+$""", "")))
    shaped = F.array_distinct(F.filter(words, lambda w: w.rlike(r"[_\-/]|\.[a-z0-9]{1,5}$|\d")))
    hits = questions.select("qid", F.explode(shaped).alias("k")).join(names.select("doc_id", F.lower("identifier").alias("k")), "k")
    found = hits.groupBy("qid").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("doc_id"))
    got = questions.select("qid").join(found, "qid", "left")
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    return got.select("qid", F.when(one, "exact").otherwise("none").alias("status"), F.when(one, F.col("doc_id")).alias("doc_id"))


def targets(references: DataFrame, names: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """(qid, status, doc_ids): references (qid, reference) to documents by document key; each must name one document, and together they must name least to most different ones. status: ok, unknown_reference, ambiguous_reference, too_few, too_many."""
    known = names.select(text.document_key(F.col("name")).alias("k"), "doc_id").distinct()
    per = references.select("qid", "reference", text.document_key(F.col("reference")).alias("k")).join(known, "k", "left").groupBy("qid", "reference").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("doc_id"))
    got = per.groupBy("qid").agg(F.min("n").alias("fewest"), F.max("n").alias("largest"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    size = F.size("doc_ids")
    status = F.when(F.col("fewest") == 0, "unknown_reference").when(F.col("largest") > 1, "ambiguous_reference").when(size < least, "too_few").when(size > most, "too_many").otherwise("ok")
    return got.select("qid", status.alias("status"), F.when(status == "ok", F.col("doc_ids")).alias("doc_ids"))


def match_fields(expected: DataFrame, given: DataFrame, least: float = 0.34) -> DataFrame:
    """(case_id, label, field, pass): for each expected label of a case the given field that fits: equal after normalisation, else one holds the other, else the best Jaccard of tokens of at least ``least``; ties by the given position."""
    a = expected.select("case_id", "label", F.array_join(text.tokens(F.col("label")), " ").alias("x"), F.array_distinct(text.tokens(F.col("label"))).alias("xs"))
    b = given.select("case_id", "field", "pos", F.array_join(text.tokens(F.col("field")), " ").alias("y"), F.array_distinct(text.tokens(F.col("field"))).alias("ys"))
    both = a.join(b, "case_id")
    similar = F.size(F.array_intersect("xs", "ys")) / F.greatest(F.size(F.array_union("xs", "ys")), F.lit(1))
    held = (F.col("x") != "") & (F.col("y") != "") & (F.contains("x", F.col("y")) | F.contains("y", F.col("x")))
    step = F.when(F.col("x") == F.col("y"), 1).when(held, 2).when(similar >= least, 3)
    ranked = both.withColumn("pass", step).withColumn("similar", similar).where("pass is not null")
    w = Window.partitionBy("case_id", "label").orderBy("pass", F.when(F.col("pass") == 3, -F.col("similar")).otherwise(0.0), "pos")
    return ranked.withColumn("n", F.row_number().over(w)).where("n = 1").select("case_id", "label", "field", "pass")
