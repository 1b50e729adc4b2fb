"""Measures of retrieval and answers, and aggregates of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def at_k(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """For each query of ``gold`` (qid, doc_id): precision (over k), recall, hit, reciprocal rank and average precision of ranked (qid, doc_id, rank)."""
    rel = gold.select("qid", "doc_id").distinct()
    hits = ranked.where(F.col("rank") <= k).select("qid", "doc_id", "rank").join(rel, ["qid", "doc_id"], "left_semi")
    return _measured(hits, rel.groupBy("qid").agg(F.count("*").alias("n_rel")), k)


def at_k_of_classes(ranked: DataFrame, classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``at_k`` where the gold documents of a query (queries: qid) are all others of its class (classes: doc_id, class; one row a document, null classes have no members). Classes are counted, and only what was found is compared; pairs of a query and a document of its class are never made."""
    of = classes.where("doc_id is not null and class is not null").select("doc_id", "class").distinct()
    own = of.withColumnRenamed("doc_id", "qid").join(queries.select("qid").distinct(), "qid", "left_semi")
    total = own.join(of.groupBy("class").agg((F.count("*") - 1).alias("n_rel")), "class").where("n_rel > 0")
    found = ranked.where((F.col("rank") <= k) & (F.col("qid") != F.col("doc_id"))).select("qid", "doc_id", "rank").join(own, "qid").join(of.withColumnRenamed("class", "its"), "doc_id")
    return _measured(found.where(F.col("class") == F.col("its")).select("qid", "doc_id", "rank"), total.select("qid", "n_rel"), k)


def _measured(hits: DataFrame, total: DataFrame, k: int) -> DataFrame:
    """The measures of hits (qid, doc_id, rank) against the numbers of gold documents (qid, n_rel)."""
    nth = hits.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    sums = nth.groupBy("qid").agg(F.count("*").alias("h"), F.min("rank").alias("first"), F.sum(F.col("nth") / F.col("rank")).alias("ap"))
    got = total.join(sums, "qid", "left")
    h = F.coalesce("h", F.lit(0))
    r6 = lambda c: F.round(c, 6)
    return got.select(
        "qid", r6(h / k).alias("precision"), r6(h / F.col("n_rel")).alias("recall"), F.when(h > 0, 1.0).otherwise(0.0).alias("hit"),
        r6(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"), r6(F.coalesce(F.col("ap"), F.lit(0.0)) / F.least("n_rel", F.lit(k))).alias("ap"),
    )


#: Rows of a group that are put in order at once, marks of a round, targets that are broadcast.
EXACT, MARKS, TARGETS = 50_000, 200, 10_000


def half_even_percentile(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """For each group: the element whose index is q * (n - 1), rounded half to even; nulls are left out.

    Selection by counting: a sketch of quantiles brackets each target, the rows below and inside the bracket are counted exactly, and rounds go on inside it until it is one value or holds at most EXACT rows, which alone are put in order. So no group is sorted as a whole; rows are aggregated before they are shuffled, and only targets (groups times qs) meet them."""
    names = {q: f"p{round(q * 100)}" for q in qs}
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v_"))
    sizes = cut(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_")))
    each = [F.struct(F.lit(names[q]).alias("p_"), F.bround(F.lit(q) * (F.col("n") - 1), 0).cast("long").alias("at_")) for q in qs]
    targets = sizes.select(*by, "n", "lo_", "hi_", F.explode(F.array(*each)).alias("t")).select(*by, "t.p_", "t.at_", "lo_", "hi_", F.col("n").alias("m_"), (F.col("n") > EXACT).alias("wide_"))
    grid = F.array(*[F.lit(i / MARKS) for i in range(MARKS + 1)])

    def inside(t: DataFrame) -> DataFrame:
        few = t.limit(TARGETS + 1).count() <= TARGETS
        named = t.withColumnsRenamed({c: f"{c}_key" for c in by})
        same = [F.col(c).eqNullSafe(F.col(f"{c}_key")) for c in by]
        met = rows.join(F.broadcast(named) if few else named, [*same, F.col("v_").between(F.col("lo_"), F.col("hi_"))])
        return met.drop(*(f"{c}_key" for c in by))

    while True:
        wide = targets.where("wide_ and lo_ < hi_")
        if wide.isEmpty():
            break
        marks = inside(wide).groupBy(*by, "p_", "at_", "lo_", "hi_", "m_").agg(F.percentile_approx("v_", grid, F.lit(20 * MARKS)).alias("marks"))
        i = F.floor(F.col("at_") / F.col("m_") * MARKS).cast("int")
        near = marks.select(*by, "p_", "at_", "lo_", "hi_", "m_", F.get("marks", F.greatest(i - 2, F.lit(0))).alias("from_"), F.get("marks", F.least(i + 3, F.lit(MARKS))).alias("to_"))
        n = inside(near).groupBy(*by, "p_", "at_", "lo_", "hi_", "m_", "from_", "to_").agg(F.count_if(F.col("v_") < F.col("from_")).alias("below"), F.count_if(F.col("v_") <= F.col("to_")).alias("upto"))
        good = (F.col("below") <= F.col("at_")) & (F.col("at_") < F.col("upto")) & (F.col("upto") - F.col("below") < F.col("m_"))
        pick = lambda a, b: F.when(good, a).otherwise(F.col(b))
        size = pick(F.col("upto") - F.col("below"), "m_")
        # A bracket that cannot be narrowed is put in order as it is.
        done = n.select(*by, "p_", pick(F.col("at_") - F.col("below"), "at_").alias("at_"), pick(F.col("from_"), "lo_").alias("lo_"), pick(F.col("to_"), "hi_").alias("hi_"), size.alias("m_"), (good & (size > EXACT)).alias("wide_"))
        targets = cut(targets.where("not wide_ or lo_ = hi_").unionByName(done))
    one = targets.where("lo_ = hi_").select(*by, "p_", F.col("lo_").alias("v_"))
    order = Window.partitionBy(*by, "p_").orderBy("v_")
    some = inside(targets.where("lo_ < hi_")).withColumn("place_", F.row_number().over(order)).where("place_ = at_ + 1").select(*by, "p_", "v_")
    picks = one.unionByName(some).groupBy(*by).agg(*(F.max(F.when(F.col("p_") == p, F.col("v_"))).alias(p) for p in dict.fromkeys(names.values())))
    held = picks.withColumnsRenamed({c: f"{c}_key" for c in by})
    return sizes.join(held, [F.col(c).eqNullSafe(F.col(f"{c}_key")) for c in by]).select(*by, "n", *dict.fromkeys(names.values()))


def confusion(df: DataFrame, expected: str, got: str) -> DataFrame:
    """(expected, got, n, share): share is of the row of the expected class."""
    n = df.groupBy(F.col(expected).alias("expected"), F.col(got).alias("got")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("expected")), 6))


# The outcomes of an answered question.
OUTCOMES = ("SUCCES", "SUCCES_CITATION_INVALIDE", "ECHEC_RETRIEVAL", "ECHEC_GENERATION", "CORRECT_SANS_EVIDENCE", "REFUS_CORRECT", "REFUS_INCORRECT", "FAUX_POSITIF", "ERREUR_TECHNIQUE")


def case_class(answerable: Column, refused: Column, exact: Column, covered: Column, cited: Column) -> Column:
    """One of nine outcomes of an answered question (the ninth, a technical error, is set by the caller). ``covered`` is null without gold evidence."""
    good = F.when(cited, "SUCCES").otherwise("SUCCES_CITATION_INVALIDE")
    return (
        F.when(~answerable, F.when(refused, "REFUS_CORRECT").otherwise("FAUX_POSITIF"))
        .when(refused, "REFUS_INCORRECT")
        .when(F.coalesce(covered, F.lit(True)), F.when(F.coalesce(exact, F.lit(False)), good).otherwise("ECHEC_GENERATION"))
        .otherwise(F.when(F.coalesce(exact, F.lit(False)), "CORRECT_SANS_EVIDENCE").otherwise("ECHEC_RETRIEVAL"))
    )


def majority(votes: DataFrame, by: str, category: str, valid: Column) -> DataFrame:
    """(by, total, verdict, votes, reason): the category with more than half of all batches, failed ones included."""
    total = votes.groupBy(by).agg(F.count("*").alias("total"), F.count_if(valid).alias("n_valid"))
    top = votes.where(valid).groupBy(by, category).agg(F.count("*").alias("votes")).groupBy(by).agg(F.max(F.struct("votes", F.col(category).alias("c"))).alias("t"))
    won = F.col("t.votes") * 2 > F.col("total")
    return total.join(top, by, "left").select(
        by, "total", F.when(won, F.col("t.c")).alias("verdict"), F.coalesce("t.votes", F.lit(0)).cast("long").alias("votes"),
        F.when(F.col("n_valid") == 0, "no_valid_vote").when(~won, "ambiguous").otherwise("majority").alias("reason"),
    )


def largest_remainder(counts: DataFrame, name: str, n: str, target: int) -> DataFrame:
    """Seats for each stratum in proportion to its size: whole parts, then largest remainders, ties by name; never more than the stratum has. Strata are few (one row each)."""
    counts = counts.select(F.col(name).alias("name_"), F.col(n).alias("n_"))
    total = counts.agg(F.sum("n_").alias("t"))
    share = counts.crossJoin(F.broadcast(total)).withColumn("units", F.lit(target) * F.col("n_")).withColumn("base", F.floor(F.col("units") / F.col("t"))).withColumn("rest", F.col("units") % F.col("t"))
    missing = F.least(F.lit(target), F.max("t").over(Window.partitionBy(F.lit(1)))) - F.sum("base").over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("rest").desc(), "name_"))
    return share.select(F.col("name_").alias(name), F.col("n_").alias(n), F.least(F.col("base") + F.when(place <= missing, 1).otherwise(0), F.col("n_")).cast("long").alias("seats"))
