"""Session settings, and shipping of the package to the executors' Python."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once an application; Spark serves the file from the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="docquarry-"), "docquarry_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.join("docquarry", os.path.relpath(os.path.join(top, n), here)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores where its files give fewer tasks than that (a single row group cannot be split); otherwise df as it is. By keys, which must be even, the scan does not sort its rows to deal them. For scans that heavy work on each row follows: what shuffles is left as it is, since its partitions could only be counted by running it."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if not _scans(df):
        return df
    return df.repartition(n, *keys) if df.rdd.getNumPartitions() < n else df


#: Nodes of a logical plan that leave the partitions of a scan as they are.
ROWWISE = ("Project", "Filter", "LogicalRelation", "SubqueryAlias", "Relation")


def _scans(df: DataFrame) -> bool:
    """Whether df is a scan with projections and filters, nothing else."""
    node = df._jdf.queryExecution().analyzed()
    while True:
        if not node.getClass().getSimpleName() in ROWWISE:
            return False
        below = node.children()
        if below.isEmpty():
            return True
        node = below.head()


def shared_folder(spark: SparkSession) -> str:
    """The folder for what all executors and the driver must see, as ``spark.checkpoint.dir`` names it. Where none is set, a local session gets one of its own; on a cluster that is an error, as executors do not share a machine's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or "/tmp/checkpoints/docquarry"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; ``conf`` adds settings (dots written as double underscores)."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
