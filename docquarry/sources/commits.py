"""Numbered commits of a folder: each is a small file that must not exist yet, so of two writers one gets an error and neither loses what it wrote unawares.

A commit's text is written aside and renamed without overwriting, which the file system does as one step (HDFS and alike; a store whose rename overwrites cannot hold such a folder safely).
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

LOG = "_commits"


class Conflict(RuntimeError):
    """Another writer has made this commit first."""


def store(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own stores know them."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all commits, ascending."""
    fs, p = store(spark, f"{root}/{LOG}")
    if not fs.exists(p):
        return []
    return sorted(int(n) for s in fs.listStatus(p) if (n := s.getPath().getName()).isdigit())


def read(spark: SparkSession, root: str, number: int) -> str:
    fs, p = store(spark, f"{root}/{LOG}/{number:012d}")
    with_ = fs.open(p)
    try:
        return bytes(with_.readAllBytes()).decode()
    finally:
        with_.close()


def last(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(number, text) of the newest commit; null before the first."""
    have = numbers(spark, root)
    return (have[-1], read(spark, root, have[-1])) if have else None


def write(spark: SparkSession, root: str, number: int, text: str) -> None:
    """Make commit ``number``; Conflict if it is there already."""
    jvm = spark.sparkContext._jvm
    fs, aside = store(spark, f"{root}/{LOG}/.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    place = jvm.org.apache.hadoop.fs.Path(f"{root}/{LOG}/{number:012d}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(place), never)
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(place):
            raise Conflict(f"commit {number} of {root} is there already") from e
        raise


def forget(spark: SparkSession, root: str, number: int) -> None:
    fs, p = store(spark, f"{root}/{LOG}/{number:012d}")
    fs.delete(p, False)
