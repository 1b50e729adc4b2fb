"""Filter algebra over declared fields, and identity facets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values

# Column names that hold a facet of a document's identity, in the order of preference.
FACETS = {
    "document_id": ("doc_id", "document_id", "id_document", "identifiant"),
    "file_name": ("nom_fichier", "file_name", "filename", "fichier"),
    "source": ("source", "chemin", "path", "uri"),
    "title": ("titre", "title", "document_title", "titre_document", "intitule"),
    "year": ("annee", "year", "document_year", "annee_document", "annee_publication", "publication_year", "exercice", "date_document", "date_publication"),
}
RANGE = {"gte": Column.__ge__, "lte": Column.__le__, "gt": Column.__gt__, "lt": Column.__lt__}


@dataclass(frozen=True)
class Profile:
    """Declared fields by type (text, number, integer, boolean, date, or list[...]) and those that filters may use."""

    fields: dict[str, str]
    filterable: frozenset[str] = field(default_factory=frozenset)

    TYPES = {"text": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType()}

    def schema(self) -> T.StructType:
        kind = lambda t: T.ArrayType(self.TYPES[t[5:-1]]) if t.startswith("list[") else self.TYPES[t]
        return T.StructType([T.StructField(n, kind(t)) for n, t in self.fields.items()])


def condition(df: DataFrame, criteria: dict, profile: Profile | None = None) -> Column:
    """All criteria at once: a scalar is equality, a list any-of, a dict a range (gte, lte, gt, lt); a null criterion is dropped.

    Fields that hold lists match if any element does. An unknown or unfilterable field, or a range over text that is not a date, is an error at plan time.
    """
    out = F.lit(True)
    kinds = dict(df.dtypes)
    for name, want in criteria.items():
        if want is None:
            continue
        if name not in kinds or (profile and name not in profile.filterable):
            raise ValueError(f"no filter on {name!r}")
        c = F.col(name)
        if isinstance(want, dict):
            unknown = set(want) - set(RANGE)
            if unknown or kinds[name] == "boolean":
                raise ValueError(f"no range {sorted(unknown) or want} on {name!r}")
            for op, bound in want.items():
                if bound is not None:
                    b = F.lit(bound)
                    out = out & RANGE[op](c, b.cast("timestamp_ntz") if isinstance(bound, str) and "-" in bound[1:] else b)
        elif isinstance(want, (list, tuple, set, frozenset)):
            values = [v for v in want if v is not None]
            out = out & (F.arrays_overlap(c, F.array(*map(F.lit, values))) if kinds[name].startswith("array") else c.isin(values))
        else:
            out = out & (F.array_contains(c, want) if kinds[name].startswith("array") else c == F.lit(want))
    return out


def select(df: DataFrame, criteria: dict, profile: Profile | None = None) -> DataFrame:
    """Rows that meet the criteria; simple ones are pushed into the scan."""
    return df.where(condition(df, criteria, profile))


def facet(df: DataFrame, name: str) -> Column:
    """The first non-empty of a facet's columns, as trimmed text (the elements of a list parted by a space); null if the table has none."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        if not kinds[c].startswith("array"):
            return F.trim(F.col(c).cast("string"))
        return F.array_join(F.filter(F.transform(F.col(c).cast("array<string>"), lambda x: F.trim(x)), lambda x: x != ""), " ")

    found = [F.nullif(one(c), F.lit("")) for c in catalogue_columns(df, name)]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def catalogue_columns(df: DataFrame, *names: str) -> list[str]:
    """The columns of a table that a catalogue of its documents reads: those of the facets given (all by default), in the order of preference."""
    return [c for n in names or FACETS for c in FACETS[n] if c in df.columns]


def identities(df: DataFrame) -> DataFrame:
    """One identity card for each document: id, file name, source, title, years; the first row of an id wins by its other columns."""
    cards = df.select(F.coalesce(facet(df, "document_id"), facet(df, "file_name"), facet(df, "source")).alias("document_id"), *(facet(df, n).alias(n) for n in ("file_name", "source", "title", "year")))
    return cards.where("document_id is not null").groupBy("document_id").agg(*(F.min(n).alias(n) for n in ("file_name", "source", "title", "year")))


# Columns of a passage that any profile may filter, and how their values are read.
TECHNICAL = {"category": "category", "ocr": "boolean", "page": "integer", "chunk_index": "integer", "doc_id": "id", "source": "id", "file_name": "id", "content_hash": "id"}
#: Columns that name a document, in the order in which a filter on them sets the scope of a search.
SCOPE = ("doc_id", "file_name", "source")


def _read(spark: SparkSession, wanted: list[tuple[object, str]]) -> list[object]:
    """Values as their declared types, by the same expressions that read columns; one job over one row."""
    if not wanted:
        return []
    row = spark.range(1).select(*(values.typed(F.lit(None if v is None else str(v)), kind.removeprefix("list[").removesuffix("]")).alias(f"c{i}") for i, (v, kind) in enumerate(wanted))).first()
    return list(row)


def normalize(spark: SparkSession, criteria: dict, profile: Profile, categories: tuple[str, ...] = ()) -> dict:
    """Criteria with values of the declared types: technical columns by their fixed kinds, declared fields by the profile. A null criterion is dropped.

    An unknown field, category or bound, a range on a field that has no order (only dates, numbers and integers have), or a value that cannot be read is an error. Of a list, values that cannot be read are dropped unless none is left; for technical columns each must be readable.
    """
    out: dict = {}
    for name, want in criteria.items():
        if want is None:
            continue
        technical = name in TECHNICAL
        kind = TECHNICAL[name] if technical else profile.fields.get(name)
        if kind is None or not (technical or name in profile.filterable):
            raise ValueError(f"no filter on {name!r}")
        if isinstance(want, dict):
            if kind not in ("integer", "number", "date") or not want or set(want) - set(RANGE):
                raise ValueError(f"no range {want!r} on {name!r} of type {kind}")
            got = _read(spark, [(v, kind) for v in want.values()])
            if None in got:
                raise ValueError(f"no value of type {kind} in {want!r} for {name!r}")
            out[name] = dict(zip(want, got, strict=True))
            continue
        listed = isinstance(want, (list, tuple, set, frozenset))
        given = list(want) if listed else [want]
        if kind in ("id", "category"):
            got = [t for t in (str(v).strip() for v in given) if t]
            if kind == "category" and set(got) - set(categories):
                raise ValueError(f"unknown category in {got!r}; there are {', '.join(categories) or 'none'}")
        else:
            got = _read(spark, [(v, kind) for v in given])
            if None in got and (technical or not listed):
                raise ValueError(f"no value of type {kind} in {want!r} for {name!r}")
            got = list(dict.fromkeys(v for v in got if v is not None))
        if not got:
            raise ValueError(f"no usable value in {want!r} for {name!r}")
        out[name] = got if listed else got[0]
    return out


def document_scope(criteria: dict) -> tuple[str, tuple[str, ...]]:
    """The column and values by which criteria restrict a search to documents: doc_id, else file_name, else source; empty if none does."""
    for name in SCOPE:
        want = criteria.get(name)
        given = [want] if isinstance(want, str) else list(want) if isinstance(want, (list, tuple)) else []
        if found := tuple(t for t in (str(v).strip() for v in given) if t):
            return name, found
    return "", ()


def argument_type(kind: str) -> T.DataType:
    """Type of a search argument for a field: a range for what has an order, a list of values for the rest."""
    base = Profile.TYPES[kind[5:-1] if kind.startswith("list[") else kind]
    if kind in ("number", "integer", "date"):
        return T.StructType([T.StructField(op, base) for op in RANGE] + [T.StructField("values", T.ArrayType(base))])
    return T.ArrayType(base)


def argument_schema(profile: Profile) -> T.StructType:
    """Arguments of a search over a profile: the question, how many passages, and one argument for each field that may be filtered."""
    fixed = [T.StructField("query", T.StringType(), False), T.StructField("top_k", T.IntegerType())]
    return T.StructType(fixed + [T.StructField(n, argument_type(k)) for n, k in sorted(profile.fields.items()) if n in profile.filterable])


def index_type(kind: str) -> str:
    """How a field is looked up in a point table: by ranges, by value, or by words."""
    return {"number": "range", "integer": "range", "date": "range", "boolean": "value"}.get(kind, "value")
