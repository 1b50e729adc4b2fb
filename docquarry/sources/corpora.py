"""Corpora and their point tables: declared, listed, renamed and dropped.

A store is a folder with a registry of corpora and a point table for each. The registry is small and written anew; a point table takes changes as segments that are merged on read (``deltas``), so an upsert writes what it is given and no more. Readers never see half of a change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters
from . import deltas, snapshot

DEFAULT = "default"
CORPORA = "corpus_id string, name string, source string, profile string"
#: Points of a page of a scan, and of a bounded one.
PAGE, BOUNDED = 1024, 100


def check_id(corpus_id: str) -> str:
    import re

    if not re.fullmatch("[a-z0-9][a-z0-9_-]{0,63}", corpus_id or ""):
        raise ValueError(f"{corpus_id!r} is no corpus id")
    return corpus_id


def collection_name(corpus_id: Column, base: str = "documents") -> Column:
    """Name of a corpus's collection: the base for the default corpus, base__id for others; null for what is no corpus id."""
    return F.when(text.is_corpus_id(corpus_id), F.when(corpus_id == DEFAULT, F.lit(base)).otherwise(F.concat(F.lit(f"{base}__"), corpus_id)))


@dataclass(frozen=True)
class Store:
    """A folder of corpora; ``points`` are its point tables by corpus, ``files`` the registries of ingested files, ``managed`` what was uploaded."""

    root: str

    def folder(self, kind: str, corpus_id: str | None = None) -> str:
        return f"{self.root}/{kind}" + (f"/{check_id(corpus_id)}" if corpus_id else "")

    # -- corpora

    def corpora(self, spark: SparkSession) -> DataFrame:
        """(corpus_id, name, source, profile); the default corpus is always there."""
        path = snapshot.current(spark, self.folder("corpora"))
        have = spark.read.schema(CORPORA).parquet(path) if path else spark.createDataFrame([], CORPORA)
        default = spark.createDataFrame([(DEFAULT, DEFAULT, "local", None)], CORPORA)
        return have.unionByName(default.join(have.select("corpus_id"), "corpus_id", "left_anti"))

    def _write(self, df: DataFrame) -> None:
        snapshot.publish(df.select("corpus_id", "name", "source", "profile"), self.folder("corpora"), allow_empty=True)

    def declare(self, spark: SparkSession, corpus_id: str, name: str | None = None, source: str = "local", profile: str | None = None) -> None:
        check_id(corpus_id)
        have = self.corpora(spark)
        if not have.where(F.col("corpus_id") == corpus_id).isEmpty():
            raise ValueError(f"corpus {corpus_id!r} is there already")
        self._write(have.unionByName(spark.createDataFrame([(corpus_id, name or corpus_id, source, profile)], CORPORA)))

    def update(self, spark: SparkSession, corpus_id: str, **fields: str) -> None:
        unknown = set(fields) - {"name", "source", "profile"}
        have = self.corpora(spark)
        here = F.col("corpus_id") == corpus_id
        if unknown or have.where(here).isEmpty():
            raise ValueError(f"no field {sorted(unknown)}" if unknown else f"no corpus {corpus_id!r}")
        self._write(have.withColumns({k: F.when(here, F.lit(v)).otherwise(F.col(k)) for k, v in fields.items()}))

    def delete(self, spark: SparkSession, corpus_id: str) -> None:
        """Remove a corpus: its points, its file registry, its uploads, and at last its entry. The default corpus stays; an unknown one is an error."""
        if corpus_id == DEFAULT:
            raise ValueError("the default corpus cannot be deleted")
        have = self.corpora(spark)
        if have.where(F.col("corpus_id") == corpus_id).isEmpty():
            raise ValueError(f"no corpus {corpus_id!r}")
        self.drop(spark, corpus_id)
        snapshot.remove(spark, self.folder("files", corpus_id))
        snapshot.remove(spark, self.folder("managed", corpus_id))
        self._write(have.where(F.col("corpus_id") != corpus_id))

    # -- points

    def table(self, corpus_id: str) -> deltas.Deltas:
        return deltas.Deltas(self.folder("points", corpus_id))

    def info(self, spark: SparkSession, corpus_id: str) -> tuple[bool, int]:
        """Whether a corpus has a point table, and how many points."""
        table = self.table(corpus_id)
        return (True, table.read(spark).count()) if table.exists(spark) else (False, 0)

    def points(self, spark: SparkSession, corpus_id: str) -> DataFrame:
        return self.table(corpus_id).read(spark)

    def create(self, points: DataFrame, corpus_id: str, reset: bool = False) -> None:
        """The first version of a corpus's table; an existing one stays unless ``reset``."""
        self.table(corpus_id).create(points, reset)

    def change(self, spark: SparkSession, corpus_id: str, points: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """In one commit: all points of the documents in ``gone`` (doc_id) leave, then ``points`` enter or replace those of the same point_id; small segments that have piled up are merged afterwards."""
        table = self.table(corpus_id)
        table.change(points, gone)
        table.compact(spark)

    def upsert(self, incoming: DataFrame, corpus_id: str) -> None:
        """Points of the same point_id are replaced; of repeated ones in ``incoming`` one stays."""
        self.change(incoming.sparkSession, corpus_id, points=incoming)

    def forget(self, documents: DataFrame, corpus_id: str) -> None:
        """Delete all points of documents (doc_id)."""
        self.change(documents.sparkSession, corpus_id, gone=documents)

    def drop(self, spark: SparkSession, corpus_id: str) -> bool:
        """Delete a corpus's table; false if there was none."""
        return snapshot.remove(spark, self.folder("points", corpus_id))


def scan(points: DataFrame, criteria: dict | None = None, profile: filters.Profile | None = None, limit: int | None = None) -> DataFrame:
    """Points that meet the criteria, all of them or the first ``limit`` by point_id."""
    found = filters.select(points, criteria or {}, profile)
    return found if limit is None else found.orderBy("point_id").limit(limit)


def paged(points: DataFrame, size: int = PAGE) -> DataFrame:
    """points with page: pages of at most ``size`` points in the order of point_id, without a task that holds all."""
    from ..operators import order

    return order.number(points, "point_id", name="at_").withColumn("page", F.floor((F.col("at_") - 1) / size)).drop("at_")


def count(points: DataFrame, criteria: dict | None = None, profile: filters.Profile | None = None) -> int:
    return filters.select(points, criteria or {}, profile).count()


def last_runs(runs: DataFrame) -> DataFrame:
    """(corpus_id, run, found, failed, status) of each corpus's last run (corpus_id, run, found, failed): failed if every file found failed, partial if some did, else succeeded."""
    last = F.row_number().over(Window.partitionBy("corpus_id").orderBy(F.col("run").desc()))
    status = F.when((F.col("found") > 0) & (F.col("failed") >= F.col("found")), "failed").when(F.col("failed") > 0, "partial").otherwise("succeeded")
    return runs.withColumn("last_", last).where("last_ = 1").select("corpus_id", "run", "found", "failed", status.alias("status"))


def summaries(corpora: DataFrame, points: DataFrame, runs: DataFrame) -> DataFrame:
    """(corpus_id, name, n_documents, n_points, last_run, status) of every corpus: empty without points, else by its last run: ready, partial or failed."""
    n = points.groupBy("corpus_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.count("*").alias("n_points"))
    got = corpora.join(n, "corpus_id", "left").join(last_runs(runs).select("corpus_id", F.col("run").alias("last_run"), F.col("status").alias("run_status")), "corpus_id", "left")
    zero = F.lit(0).cast("long")
    status = F.when(F.col("run_status") == "failed", "failed").when(F.coalesce("n_points", zero) == 0, "empty").when(F.col("run_status") == "partial", "partial").otherwise("ready")
    return got.select("corpus_id", "name", F.coalesce("n_documents", zero).alias("n_documents"), F.coalesce("n_points", zero).alias("n_points"), "last_run", status.alias("status"))
