"""The registry of canonical names as a table that lives from run to run.

registry: (field, canonical, alias array, frequency). A batch of values is resolved in the order given: by canonical name, by alias, by likeness of letters, by likeness of vectors; what is left becomes canonical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..functions.values import comparison_key
from ..session import cut
from ..sources import snapshot
from . import likeness, resolve

SCHEMA = "field string, canonical string, alias array<string>, frequency long"
#: Least likeness of letters and of vectors, and occurrences below which a name is rare.
LETTERS, VECTORS, RARE = 0.88, 0.92, 3


def variants(registry: DataFrame) -> DataFrame:
    """(field, canonical, variant): each canonical name and its aliases, once each."""
    return registry.select("field", "canonical", F.explode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("alias", F.array().cast("array<string>"))))).alias("variant"))


def check(registry: DataFrame) -> DataFrame:
    """(field, canonical, error) of entries that break a rule: empty name, negative frequency, a name twice in a field, an alias of two names; a sound registry has none."""
    keyed = variants(registry).groupBy("field", comparison_key(F.col("variant")).alias("k")).agg(F.countDistinct("canonical").alias("n"), F.min("canonical").alias("canonical"))
    shared = keyed.where("n > 1").select("field", "canonical", F.lit("shared_variant").alias("error"))
    entries = registry.groupBy("field", "canonical").agg(F.count("*").alias("n"), F.min("frequency").alias("frequency"))
    error = F.when(F.trim(F.coalesce("canonical", F.lit(""))) == "", "empty_name").when(F.col("frequency").isNull() | (F.col("frequency") < 0), "bad_frequency").when(F.col("n") > 1, "repeated_name")
    return entries.select("field", "canonical", error.alias("error")).where("error is not null").unionByName(shared)


def nearest(values_: DataFrame, known: DataFrame, threshold: float = VECTORS) -> DataFrame:
    """(field, value, canonical, likeness): the known name (field, canonical, vector) nearest to a value (field, value, vector) by cosine, if it reaches the threshold; ties by name. Names meet within their field."""
    from ..functions import arrays

    both = values_.select("field", "value", F.col("vector").alias("v")).join(known.select("field", "canonical", "vector"), "field")
    scored = both.withColumn("likeness", F.round(arrays.cosine(F.col("v"), F.col("vector")), 9)).where(F.col("likeness") >= threshold)
    best = F.min(F.struct((-F.col("likeness")).alias("l"), F.col("canonical").alias("c"))).alias("b")
    return scored.groupBy("field", "value").agg(best).select("field", "value", F.col("b.c").alias("canonical"), (-F.col("b.l")).alias("likeness"))


def resolve_batch(batch: DataFrame, registry: DataFrame, letters: float = LETTERS, vectors: float = VECTORS) -> DataFrame:
    """(field, value, canonical, phase): values (field, value, pos, and vector if there is one) against the registry and the values that the batch itself has before them: exact, alias, letters, vectors or new.

    A value that meets no name and no alias by its comparison key gets the canonical name of the most alike earlier name, be it a variant of the registry or a value of the batch, by letters; one that is like none by letters, by vectors; one that is like none at all is new. Of a tie the name that became canonical first holds, the registry's before the batch's. Values of one key are one name; the first spelling stands for it. Order is part of the meaning, but only through earlier neighbours, which come from similarity joins (``likeness``): no task holds a field.
    """
    has = "vector" in batch.columns
    first = batch.where(~values.is_null_word(F.col("value"))).groupBy("field", "value").agg(F.min("pos").cast("long").alias("pos"), *([F.first("vector", ignorenulls=True).alias("vector")] if has else []))
    known = variants(registry).select("field", "canonical", comparison_key(F.col("variant")).alias("k"), (F.col("variant") == F.col("canonical")).alias("own"))
    direct = known.groupBy("field", "k").agg(F.min(F.struct((~F.col("own")).alias("o"), "canonical")).alias("m"))
    met = cut(first.withColumn("k", comparison_key(F.col("value"))).join(direct, ["field", "k"], "left"))
    settled = met.where("m is not null").select("field", "value", F.col("m.canonical").alias("canonical"), F.when(F.col("m.o"), "alias").otherwise("exact").alias("phase"))

    open_ = met.where("m is null")
    head = F.struct("pos", "value", *(["vector"] if has else []))
    names = open_.groupBy("field", "k").agg(F.min_by(head, F.struct("pos", "value")).alias("h")).select("field", "k", F.col("h.pos").alias("ord"), F.col("h.value").alias("name"), *([F.col("h.vector").alias("vector")] if has else []))
    names = cut(names)
    every = names.select("field", "k", "ord").unionByName(direct.select("field", "k", F.lit(-1).cast("long").alias("ord")))
    links = cut(likeness.closest(likeness.pairs(every, letters)).withColumn("phase", F.lit("letters")))
    if has:
        lone = names.join(links.select("field", "k"), ["field", "k"], "left_anti")
        links = cut(links.unionByName(likeness.closest(likeness.near_vectors(lone, names, vectors)).withColumn("phase", F.lit("vectors"))))
    order = names.select("field", F.col("k").alias("other"), F.col("ord").alias("rank"), F.col("name").alias("canonical"))
    order = order.unionByName(direct.select("field", F.col("k").alias("other"), F.lit(-1).cast("long").alias("rank"), F.col("m.canonical").alias("canonical")))
    roots = resolve.canonicals(links, order)
    how = links.select("field", "k", "phase").distinct()
    found = open_.join(names.select("field", "k", "name"), ["field", "k"]).join(roots, ["field", "k"], "left").join(how, ["field", "k"], "left")
    phase = F.when(F.col("value") == F.col("name"), F.coalesce("phase", F.lit("new"))).when(F.col("phase").isNull(), "exact").otherwise("alias")
    return settled.unionByName(found.select("field", "value", F.coalesce("canonical", "name").alias("canonical"), phase.alias("phase")))


def update(registry: DataFrame, batch: DataFrame, resolved: DataFrame) -> DataFrame:
    """The registry after a batch (field, value): new names enter, values that met a name by likeness become its aliases, frequencies grow by occurrences."""
    n = batch.groupBy("field", "value").agg(F.count("*").alias("n"))
    seen = resolved.join(n, ["field", "value"])
    other = F.when(~F.col("phase").isin("exact", "new") & (F.col("value") != F.col("canonical")), F.col("value"))
    grown = seen.groupBy("field", "canonical").agg(F.sum("n").alias("n"), F.collect_set(other).alias("more"))
    both = registry.join(grown, ["field", "canonical"], "full")
    none = F.array().cast("array<string>")
    return both.select("field", "canonical", F.array_sort(F.array_union(F.coalesce("alias", none), F.coalesce("more", none))).alias("alias"), (F.coalesce("frequency", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("frequency"))


def save(registry: DataFrame, root: str) -> str:
    """Publish a checked registry as a new version; a broken one is refused and the last version stays."""
    if not check(registry).isEmpty():
        raise ValueError("the registry breaks its rules")
    return snapshot.publish(registry.select("field", "canonical", "alias", "frequency"), root, allow_empty=True)


def open_registry(spark, root: str) -> DataFrame:
    """The published registry, or an empty one."""
    path = snapshot.current(spark, root)
    return spark.read.schema(SCHEMA).parquet(path) if path else spark.createDataFrame([], SCHEMA)


def statistics(registry: DataFrame) -> DataFrame:
    """(field, canonicals, variants, occurrences)."""
    return registry.groupBy("field").agg(F.count("*").alias("canonicals"), F.sum(F.size(F.coalesce("alias", F.array().cast("array<string>"))) + 1).cast("long").alias("variants"), F.sum("frequency").alias("occurrences"))


def rare(registry: DataFrame, below: int = RARE) -> DataFrame:
    """(field, names): names seen fewer than ``below`` times, sorted."""
    return registry.where(F.col("frequency") < below).groupBy("field").agg(F.array_sort(F.collect_list("canonical")).alias("names"))


def normalized_rows(df: DataFrame, fields: dict[str, str], registry: DataFrame, entity_fields: tuple[str, ...], key: str) -> DataFrame:
    """df with its declared columns as their types (raw texts kept as <name>_raw), and the entity columns as canonical names from the registry."""
    out = values.typed_row(df, fields)
    for f in entity_fields:
        batch = out.where(F.col(f).isNotNull()).select(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(key).alias("pos"))
        got = resolve_batch(batch, registry).where(F.col("field") == f).select(F.col("value").alias(f), F.col("canonical").alias("canonical_"))
        out = out.join(got, f, "left").withColumn(f, F.coalesce("canonical_", f)).drop("canonical_")
    return out
