"""Encoders of texts to dense and sparse vectors, behind one interface.

A model is a function from a pandas Series of texts to a Series of vectors; it runs in Arrow batches on the executors, loaded once a worker by the caller's function. Without a model, hashing stands in: deterministic, offline, and made by built-in functions alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, text
from ..session import ship

#: Dimensions of the hashed dense vector, and of the space of hashed tokens of sparse ones.
DENSE, SPARSE = 64, 1 << 20


def hashed_sparse(c: Column, size: int = SPARSE) -> Column:
    """struct(indices, values): hashed tokens and their numbers, by index; tokens that share an index add up."""
    number = F.transform(text.tokens(c), lambda t: F.pmod(F.xxhash64(t), F.lit(size)))

    def counted(xs: Column) -> Column:
        return F.map_from_entries(F.transform(F.array_distinct(xs), lambda i: F.struct(i.alias("key"), F.size(F.filter(xs, lambda x: x == i)).cast("double").alias("value"))))

    return text.let(number, lambda xs: arrays.sparse(counted(xs)))


def hashed_dense(c: Column, size: int = DENSE) -> Column:
    """Vector of unit length (zero for a text without tokens): each distinct token adds 1 or -1 at one place, by its hash."""
    place = F.transform(F.array_distinct(text.tokens(c)), lambda t: F.struct(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(size)).alias("at"), F.when(F.pmod(F.xxhash64(t, F.lit(2)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    sums = lambda ps: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(ps, lambda p: p["at"] == i), F.lit(0.0), lambda s, p: s + p["sign"]))
    unit = lambda v: text.let(F.sqrt(arrays.dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return text.let(place, lambda ps: text.let(sums(ps), unit))


def encode(df: DataFrame, column: str = "text", model: Callable[[pd.Series], pd.Series] | None = None, with_sparse: bool = True, batch: int = 64) -> DataFrame:
    """df with vector (array<double>) and, if wanted, sparse (struct of indices and values). ``model`` makes the dense vectors of at most ``batch`` texts at once; a failing call gives null vectors for its rows."""
    out = df
    if model is None:
        out = df.withColumn("vector", hashed_dense(F.coalesce(F.col(column), F.lit(""))))
    else:
        ship(df.sparkSession)
        schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in parts:
                for s in range(0, len(d), batch):
                    some = d.iloc[s : s + batch]
                    try:
                        got = [None if v is None else [float(x) for x in v] for v in model(some[column].fillna(""))]
                    except Exception:
                        got = [None] * len(some)
                    yield some.assign(vector=pd.Series(got, index=some.index, dtype=object))

        out = df.mapInPandas(run, schema)
    return out.withColumn("sparse", hashed_sparse(F.coalesce(F.col(column), F.lit("")))) if with_sparse else out


def encode_queries(queries: DataFrame, model: Callable[[pd.Series], pd.Series] | None = None, with_sparse: bool = True) -> DataFrame:
    """Questions by the same way as documents, their white space collapsed first."""
    return encode(queries.withColumn("text", text.collapse(F.col("text"))), "text", model, with_sparse)


def encode_dense(df: DataFrame, column: str = "text", model: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    return encode(df, column, model, with_sparse=False)
