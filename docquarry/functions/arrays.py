"""Functions on token sets and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(gold: Column, found: Column) -> Column:
    """Part of the gold set that is found; 0 for an empty gold set. Both are evaluated once."""
    part = lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(g, found)) / F.size(g))
    return F.get(F.transform(F.array(F.array_distinct(gold)), part), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different sizes or without length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def json_object(c: Column) -> Column:
    """The JSON object in noisy model text (reasoning and fences around it): from the first brace to the last."""
    from .text import without_thinking

    return F.nullif(F.regexp_extract(without_thinking(c), r"(?s)(\{.*\})", 1), F.lit(""))


def list_or_scalar(c: Column) -> Column:
    """A cell that holds a JSON list, values parted by bars, or one value, as an array of trimmed texts."""
    parts = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, r"\|"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def valid_entries(json_text: Column, fields: list[str], allowed: Column) -> Column:
    """Entries (field, value, citations) of an extraction answer in JSON {field: [{value, citations}]}: known fields, some value, and one citation at least that is allowed; others are dropped."""
    from .text import collapse

    entry = "array<struct<value:string,citations:array<string>>>"
    got = F.from_json(json_object(json_text), f"map<string,{entry}>")
    flat = F.flatten(F.transform(F.array(*map(F.lit, fields)), lambda f: F.transform(F.coalesce(got[f], F.array().cast(entry)), lambda e: F.struct(f.alias("field"), collapse(e["value"]).alias("value"), F.array_intersect(e["citations"], allowed).alias("citations")))))
    return F.filter(flat, lambda e: (e["value"] != "") & (F.size(e["citations"]) > 0))


def precision(value: Column, reference: Column) -> Column:
    """Part of a value's tokens that a reference has; 0 for a value without tokens."""
    return share(value, reference)


def numbered_documents(values: Column, mode: str, prefix: str = "", suffix: str = "", width: int = 0) -> Column:
    """Relevant documents of a question from a cell: "name" keeps base names, "index" makes file names of numbers; once each, in order."""
    from .text import basename, numbered_name

    if mode not in ("name", "index"):
        raise ValueError(f"no mode {mode!r}")
    one = basename if mode == "name" else lambda x: numbered_name(x.try_cast("int"), prefix, width, suffix)
    return F.array_distinct(F.filter(F.transform(list_or_scalar(values), one), lambda x: x.isNotNull() & (x != "")))


def sparse(weights: Column) -> Column:
    """struct(indices, values) of a map from token numbers to weights, by number; zero and negative weights go."""
    kept = F.array_sort(F.filter(F.map_entries(weights), lambda e: e["value"] > 0))
    return F.struct(F.transform(kept, lambda e: e["key"].cast("long")).alias("indices"), F.transform(kept, lambda e: e["value"].cast("double")).alias("values"))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two sparse vectors (structs of indices and values)."""
    weights = F.map_from_arrays(b["indices"], b["values"])
    return F.aggregate(F.zip_with(a["indices"], a["values"], lambda i, x: x * F.coalesce(F.try_element_at(weights, i), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def outline(c: Column, indent: int = 2) -> Column:
    """Flat JSON object as lines "key: value" in the order of keys, indented; lists are parted by commas."""
    entries = F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))
    value = lambda v: F.regexp_replace(F.regexp_replace(v, r'^\[|\]$|"', ""), ",", ", ")
    return F.array_join(F.transform(F.filter(entries, lambda e: e["value"].isNotNull()), lambda e: F.concat(F.lit(" " * indent), e["key"], F.lit(": "), F.when(e["value"].startswith("["), value(e["value"])).otherwise(e["value"]))), "\n")


def message_text(c: Column) -> Column:
    """Text of a model's message in JSON: a string, or a list of parts of which those of type text are joined; other texts stand for themselves."""
    parts = F.from_json(c, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull() & (F.coalesce(p["type"], F.lit("text")) == "text")), lambda p: p["text"]), "")
    string = F.get_json_object(F.concat(F.lit('{"t":'), c, F.lit("}")), "$.t")
    return F.trim(F.when(F.trim(c).startswith("["), joined).when(F.trim(c).startswith('"'), string).otherwise(c))


def plan(c: Column, objective: Column, axes: Column, most_axes: int = 6, most_items: int = 6) -> Column:
    """struct(objective, axes, expected, fallback) of a plan in model text: its axes and expected items collapsed, once each, the first ones up to the limits. Without a usable axis the whole plan is the given one."""
    from .text import collapse

    got = F.from_json(json_object(c), "struct<objective:string,axes:array<string>,expected:array<string>>")
    clean = lambda xs, most: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), collapse), lambda x: (x != "") & ~x.rlike(r"^[\[{]"))), 1, most)
    own = clean(got["axes"], most_axes)
    usable = F.coalesce(F.size(own) > 0, F.lit(False))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(usable, F.coalesce(F.nullif(collapse(got["objective"]), F.lit("")), objective)).otherwise(objective).alias("objective"), F.when(usable, own).otherwise(axes).alias("axes"),
        F.when(usable, clean(got["expected"], most_items)).otherwise(none).alias("expected"), (~usable).alias("fallback"),
    )


def map_elements(c: Column, axes: Column, allowed: Column) -> Column:
    """Elements (axis, content, citations) of a map answer in model text: an axis of the plan, some content, and a citation of the batch, declared or inside the content; others are dropped."""
    from .text import collapse, document_citations, let

    none = F.array().cast("array<string>")
    got = F.from_json(json_object(c), "struct<elements:array<struct<axis:string,content:string,citations:array<string>>>>")["elements"]

    def clean(e: Column) -> Column:
        content = collapse(F.coalesce(e["content"], F.lit("")))
        declared = F.transform(F.coalesce(e["citations"], none), lambda x: F.regexp_replace(F.trim(x), r"[\[\]]", ""))
        return F.struct(collapse(e["axis"]).alias("axis"), content.alias("content"), F.filter(F.array_distinct(F.concat(declared, document_citations(content))), lambda x: F.array_contains(allowed, x)).alias("citations"))

    return let(F.transform(F.coalesce(got, F.array().cast("array<struct<axis:string,content:string,citations:array<string>>>")), clean), lambda es: F.filter(es, lambda e: F.array_contains(axes, e["axis"]) & (e["content"] != "") & (F.size(e["citations"]) > 0)))
