"""Every registered query of the library against its SQL over the smallest tables."""

import math

import duckdb
import pytest

from docquarry import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None else ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in registry.ORACLES:
        assert got
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    place = [want.columns.index(c) for c in sorted(df.columns)]
    assert sorted(got, key=str) == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=str)


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "doc_id", "score", "rank"] and df.count() > 0
