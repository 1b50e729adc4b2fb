"""Sources as complete snapshots: staged aside, published only as a whole, in versions.

Files go through Spark's own file systems. A version is a folder; numbered commits name the versions in the order of publication, and the newest holds. Two writers that publish on top of the same commit cannot both succeed: the second gets ``commits.Conflict`` and its version stays unpublished. A writer that fails leaves a version that nothing names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import commits, files, registry


def exists(spark: SparkSession, path: str) -> bool:
    store, p = commits.store(spark, path)
    return store.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a path and all below it; false if it was not there."""
    store, p = commits.store(spark, path)
    return store.exists(p) and store.delete(p, True)


def current(spark: SparkSession, root: str) -> str | None:
    """The published version's folder; null before the first."""
    found = commits.last(spark, root)
    return f"{root}/{found[1]}" if found else None


def publish(df: DataFrame, root: str, partition: list[str] | None = None, allow_empty: bool = False) -> str:
    """Write df as a new version below root and publish it, unless another writer has published since this one began. An empty snapshot is an error unless allowed, and leaves the published version as it is."""
    spark = df.sparkSession
    before = max(commits.numbers(spark, root), default=0)
    name = f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{root}/{name}")
    if not allow_empty and spark.read.schema(df.schema).parquet(f"{root}/{name}").isEmpty():
        remove(spark, f"{root}/{name}")
        raise ValueError("the snapshot is empty; the published version stays")
    commits.write(spark, root, before + 1, name)
    return f"{root}/{name}"


def read(spark: SparkSession, root: str) -> DataFrame:
    """The published version."""
    path = current(spark, root)
    if path is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(path)


def versions(spark: SparkSession, root: str) -> list[str]:
    store, p = commits.store(spark, root)
    if not store.exists(p):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(p) if s.getPath().getName().startswith("v-"))


def tidy(spark: SparkSession, root: str) -> int:
    """Delete all versions but the published one; their number."""
    keep = current(spark, root)
    old = [v for v in versions(spark, root) if keep is None or not keep.endswith(f"/{v}")]
    for v in old:
        remove(spark, f"{root}/{v}")
    return len(old)


@dataclass(frozen=True)
class Folder:
    """A folder that is its own snapshot."""

    root: str

    def snapshot(self, spark: SparkSession) -> DataFrame:
        if not exists(spark, self.root):
            raise FileNotFoundError(self.root)
        return files.discover(spark, self.root)


@dataclass(frozen=True)
class Fetched:
    """A source that may fail half-way: ``fetch`` gives its files (path, name, extension, length, content), which are staged and published as a whole; a failure or an empty result leaves the last snapshot in use."""

    root: str
    fetch: Callable[[SparkSession], DataFrame]
    allow_empty: bool = False

    def snapshot(self, spark: SparkSession) -> DataFrame:
        publish(self.fetch(spark), self.root, allow_empty=self.allow_empty)
        return read(spark, self.root)


@dataclass
class Sources:
    """Sources by name; each is made by a factory when it is asked for."""

    factories: dict[str, Callable[..., object]] = field(default_factory=lambda: {"local": Folder})

    def register(self, name: str, factory: Callable[..., object]) -> None:
        if name in self.factories:
            raise ValueError(f"{name!r} is registered already")
        self.factories[name] = factory

    def make(self, name: str, **settings):
        if name not in self.factories:
            raise KeyError(f"no source {name!r}; there are {', '.join(sorted(self.factories))}")
        return self.factories[name](**settings)


def sync(spark: SparkSession, source, old: DataFrame, settings: dict, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registry after, pages, outcomes by file) of one run over a source's whole snapshot: vanished files leave, unchanged ones (content and settings) are skipped, the others are read; a file that cannot be read keeps its old entry and stops nothing. ``limit`` bounds the files read, not the discovery, so deletions stay right: files beyond it are deferred."""
    from pyspark.sql import functions as F

    from ..operators import incremental

    found = source.snapshot(spark)
    signed = found.select("path", F.sha2("content", 256).alias("hash"), F.lit(registry.signature(settings)).alias("signature"))
    status = registry.difference(old, signed)
    todo = status.where(F.col("status").isin("new", "changed")).select("path")
    if limit is not None:
        todo = todo.orderBy("path").limit(limit)
    read_ = files.pages(found.join(todo, "path", "left_semi"))
    failed = read_.where("error is not null").select("path")
    later = status.where(F.col("status").isin("new", "changed")).select("path").join(todo, "path", "left_anti")
    after, outcomes = incremental.sync(old, signed, failed.unionByName(later))
    marked = outcomes.join(later.withColumn("later", F.lit(True)), "path", "left")
    return after, read_.where("error is null"), marked.select("path", F.when(F.col("later"), "deferred").otherwise(F.col("status")).alias("status"))
