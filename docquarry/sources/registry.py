"""Snapshot differences, identities of versions and points, and the point table."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """UUID version 5 of a name, made by built-in functions."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(doc_id: Column, chunk_index: Column) -> Column:
    return uuid5(F.concat_ws(":", doc_id, chunk_index))


def signature(settings: dict) -> str:
    """SHA-256 of the canonical JSON of all settings that change content."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def difference(old: DataFrame, new: DataFrame, key: str = "path", versions: tuple[str, ...] = ("hash", "signature")) -> DataFrame:
    """(key, status): new, changed, unchanged or deleted, by one full outer join on the key."""
    a = old.select(key, *(F.col(v).alias(f"old_{v}") for v in versions), F.lit(True).alias("was"))
    b = new.select(key, *(F.col(v).alias(f"new_{v}") for v in versions), F.lit(True).alias("now"))
    same = F.lit(True)
    for v in versions:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    status = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def upsert(points: DataFrame, incoming: DataFrame, key: str = "point_id") -> DataFrame:
    """The point table after incoming rows replaced those of the same key."""
    return points.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def publish(points: DataFrame, path: str, partition: str = "corpus_id", key: str = "point_id") -> None:
    """Write a new version of a point table, partitioned by corpus (a large corpus is written by many tasks, by ranges of its keys); readers switch by reading the new path, so no path is read and overwritten at once."""
    points.repartitionByRange(partition, key).write.mode("errorifexists").partitionBy(partition).parquet(path)


def fill_rates(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, filled, rate): rate in percent of max(n, 1), one decimal, in one pass."""
    one = df.agg(F.count("*").alias("n"), *(F.count(F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("filled")) for i, f in enumerate(fields))))
    return one.select("n", rows.alias("r")).select("r.field", "n", "r.filled", F.round(F.lit(100.0) * F.col("r.filled") / F.greatest("n", F.lit(1)), 1).alias("rate"))
