"""Global numbering without a single task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def seeded(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """df numbered in an order that a seed fixes: by a hash of the seed and the key, ties by the key. The same rows give the same order on every run and any cluster."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    return number(df.withColumn("h_", h), "h_", key, name=name).drop("h_")


def number(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with consecutive numbers from 1 in the given order: ranges are numbered apart, then shifted by the sizes of those before (one row a range). The ranges are cut first, so both readings see the same ones."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()))
    sizes = dealt.groupBy("part_").agg(F.count("*").alias("size_"))
    shift = sizes.select("part_", (F.sum("size_").over(Window.orderBy("part_")) - F.col("size_")).alias("shift_"))
    own = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return dealt.withColumn("own_", own).join(F.broadcast(shift), "part_").withColumn(name, (F.col("own_") + F.col("shift_")).cast("long")).drop("part_", "own_", "shift_")


def running(df: DataFrame, by: str, order: str, value, name: str = "running") -> DataFrame:
    """df with the sum of a whole value over the rows of its group up to each one; the order is unique in a group. Ranges of (by, order) are summed apart, then shifted by those before, so a group may have any size."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.withColumn("value_", value.cast("long")).repartitionByRange(parts, by, order).withColumn("part_", F.spark_partition_id()))
    sums = dealt.groupBy(by, "part_").agg(F.sum("value_").alias("sum_"))
    shift = sums.select(F.col(by).alias("by_"), "part_", (F.sum("sum_").over(Window.partitionBy(by).orderBy("part_")) - F.col("sum_")).alias("shift_"))
    own = F.sum("value_").over(Window.partitionBy(by, "part_").orderBy(order))
    met = dealt.withColumn("own_", own).join(shift.withColumnRenamed("part_", "of_"), F.col(by).eqNullSafe(F.col("by_")) & (F.col("part_") == F.col("of_")))
    return met.withColumn(name, F.col("own_") + F.col("shift_")).drop("part_", "of_", "own_", "shift_", "by_", "value_")
