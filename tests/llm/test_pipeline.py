"""The pipeline over a small table, stage by stage and as a whole."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm import bagminhash


def test_stages_keep_columns_and_feed_one_another(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first.columns and docs.dtypes == first.dtypes
        if k == 2:
            again = bagminhash.classes(docs)
            assert again.where("doc_id != class_id").count() == 0
    assert sizes[0] < first.count() and sizes[2] <= sizes[1] <= sizes[0] and sizes[4] == sizes[3]
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))


ODD = "doc_id long, text string, lang string, source string, n_chars long, k string, dig string, gone long, score double"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    line = "a line of more than eight plain words stands here today"
    texts = [None, "", " \n ", "word " * 60_000, line, line, f"{line}\nand more", "x", "x", "the same id", "of two texts", None]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 9, None]
    rows = [(i, t, None if n % 5 == 0 else "en", None if n % 4 == 0 else "s", len(t or ""), "k", "d", n, 0.5) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(5, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(rows, ODD).write.parquet(str(folder / "documents.parquet"))
    return folder


def test_stages_take_odd_rows(spark, odd):
    docs = spark.read.parquet(str(odd / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(odd))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = {r.gone for r in corpus_pipeline.near_duplicates(spark, docs, str(odd)).collect()}
    assert kept >= {0, 1, 2, 11, 3, 6, 9, 10} and len(kept & {4, 5}) == 1 and len(kept & {7, 8}) == 1
    stripped = {r.gone: r.text for r in corpus_pipeline.lines(spark, docs, str(odd)).collect()}
    assert 5 not in stripped and stripped[6] == "and more" and stripped[0] is None and stripped[1] == ""
    assert corpus_pipeline.toxic(spark, docs, str(odd)).count() == docs.count()
    mixed = corpus_pipeline.mixed(spark, docs, str(odd)).collect()
    assert all((r.text or "").split() for r in mixed)
    encoded = corpus_pipeline.encoded(spark, docs, str(odd)).collect()
    assert len(encoded) == docs.count() and sum(r.n_tokens == 0 for r in encoded) == 3


def test_stages_take_empty_tables(spark, odd):
    none = spark.read.parquet(str(odd / "documents.parquet")).where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(odd)).count() == 0
