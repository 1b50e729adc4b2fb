"""Capabilities around stand-in models, incremental runs, and linking rules."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docquarry.operators import capability, incremental, resolve


@pytest.fixture(scope="module")
def passages(spark):
    rows = [(1, 1, "Mail a@b.org. More."), (1, 2, "Mail A@B.org and c@d.org."), (2, 1, "nothing"), (2, 2, "x" * 50)]
    return spark.createDataFrame(rows, "doc_id long, n long, text string")


def test_extract_merges_values(passages):
    got = {(r.doc_id, r.value): (r.citations, r.n_values, r.single) for r in capability.extract(passages, {"email": r"[A-Za-z]+@[A-Za-z]+\.org"}).collect()}
    assert got == {(1, "a@b.org"): ("S1 S2", 2, False), (1, "c@d.org"): ("S2", 2, False)}


def test_a_failing_call_is_a_row(spark):
    def model(prompts: pd.Series) -> pd.Series:
        if (prompts == "bad").any():
            raise RuntimeError("no")
        return prompts.str.upper()

    got = {r.prompt: (r.answer, r.ok) for r in capability.call(spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt string"), model).collect()}
    assert got == {"a": ("A", True), "bad": (None, False), "c": ("C", True)}


def test_summaries(passages):
    got = {r.doc_id: r for r in capability.summarize(passages, limit=40).collect()}
    assert got[1].status == "ok" and "[S1]" in got[1].summary
    failing = lambda p: p.map(lambda x: None if "nothing" in x else "fine [S1]")
    got = {r.doc_id: r.status for r in capability.summarize(passages, failing, limit=40).collect()}
    assert got == {1: "ok", 2: "failed_batch"}
    long = lambda p: p.map(lambda x: "y" * 9000 + " [S1]")
    assert {r.status for r in capability.summarize(passages, long, halve=long, budget=100).collect()} == {"not_convergent"}
    bare = lambda p: p.map(lambda x: "no citation")
    assert {r.status for r in capability.summarize(passages, bare).collect()} == {"uncited"}


def test_compare_status(spark):
    found = spark.createDataFrame([(1,), (2,)], "doc_id long")
    targets = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 9), (3, 9)], "qid long, doc_id long")
    assert {r.qid: (r.status, r.missing) for r in capability.compare(found, targets).collect()} == {1: ("complete", ""), 2: ("partial", "9"), 3: ("failed", "9")}


def test_elements_need_content_and_a_known_citation(spark):
    maps = spark.createDataFrame([(1, "a", "x", "S1", 1), (1, "a", "x", "S2", 2), (1, "a", " ", "S1", 3), (1, "b", "y", "S9", 4)], "doc_id long, axis string, content string, citation string, pos int")
    known = spark.createDataFrame([(1, "S1"), (1, "S2")], "doc_id long, citation string")
    assert [tuple(r) for r in capability.elements(maps, known).collect()] == [(1, "a", "x", "S1")]


def test_registry(passages):
    tools = capability.default_registry()
    assert tools.names() == ["classify", "compare", "extract", "summarize"]
    with pytest.raises(ValueError):
        tools.register(tools.tools["extract"])
    ok, df, _ = tools.execute("extract", passages=passages, fields={"word": "nothing"})
    assert ok and df.count() == 1
    assert tools.execute("nope") == (False, None, "no tool 'nope'")
    ok, _, why = tools.execute("extract", passages=None, fields={"a": "b"})
    assert not ok and why


def test_input_budget():
    assert capability.input_budget(4096, 1024) == 6400 and capability.input_budget(100, 200) == 0


def test_sync_keeps_failed_files_old_version(spark):
    kind = "path string, hash string, signature string"
    old = spark.createDataFrame([("a", "1", "s"), ("b", "1", "s"), ("gone", "1", "s")], kind)
    now = spark.createDataFrame([("a", "1", "s"), ("b", "2", "s"), ("c", "1", "s"), ("d", "1", "s")], kind)
    after, status = incremental.sync(old, now, spark.createDataFrame([("b",), ("c",)], "path string"))
    assert {r.path: r.hash for r in after.collect()} == {"a": "1", "b": "1", "d": "1"}
    assert {r.path: r.status for r in status.collect()} == {"a": "unchanged", "b": "failed", "c": "failed", "d": "new", "gone": "deleted"}


def test_resolution(spark):
    cards = spark.createDataFrame([(1, "Acme Report 2021.pdf"), (2, "Acme Report 2022.pdf"), (3, "Zenith Orchard.pdf"), (4, "Zenith Harbour.pdf")], "doc_id long, title string")
    asked = spark.createDataFrame([(1, "revenue of acme"), (2, "zenith orchard yield"), (3, "zenith"), (4, "weather"), (5, None)], "qid long, text string")
    got = {r.qid: (r.status, r.n_documents) for r in resolve.resolve(asked, cards).collect()}
    assert got[1] == ("compatible", 2) and got[2] == ("exact", 1) and got[4] == ("none", 0) and got[5] == ("none", 0)


def test_aliases(spark):
    known = spark.createDataFrame([("Hôtel Al", "HA"), ("Other", "HA")], "canonical string, alias string")
    got = {r.value: (r.canonical, r.phase) for r in resolve.exact_entities(spark.createDataFrame([("hotel al",), ("ha",), ("New",)], "value string"), known).collect()}
    assert got == {"hotel al": ("Hôtel Al", "exact"), "ha": ("Hôtel Al", "alias"), "New": ("New", "new")}


def test_fuzzy_order_matters(spark):
    rows = [("f", "kitten", 1), ("f", "kittens", 2), ("f", "sitting", 3), ("g", "kittens", 1)]
    got = {(r.field, r.value): r.canonical for r in resolve.fuzzy_entities(spark.createDataFrame(rows, "field string, value string, pos long")).collect()}
    assert got == {("f", "kitten"): "kitten", ("f", "kittens"): "kitten", ("f", "sitting"): "sitting", ("g", "kittens"): "kittens"}


def test_allowed_attributes(spark):
    df = spark.createDataFrame([('{"k": 1, "password": "x"}',), ('{"secret": 1}',), (None,)], "props string")
    assert [r.a for r in df.select(incremental.allowed().alias("a")).collect()] == ['{"k":"1"}', None, None]


def test_empty_tables(spark, passages):
    assert capability.summarize(passages.limit(0)).count() == 0
    assert capability.classify(passages.limit(0), capability.keyword_votes({"a": ["x"]})).count() == 0
    assert capability.extract(passages.where(F.lit(False)), {"a": "x"}).count() == 0


def test_analysis_falls_back(spark):
    def model(p):
        return p.map(lambda x: '{"category": " LAW ", "confidence": 0.9, "metadata": {"day": "12 mars 2024", "n": 3}}' if "good" in x else '{"category": "law", "confidence": 0.2}' if "weak" in x else None)

    docs = spark.createDataFrame([(1, "a", "good"), (2, "b", "weak"), (3, None, None)], "doc_id long, file_name string, text string")
    got = {r.doc_id: r for r in capability.analyse(docs, model, ["Law", "Art"], "Other", {"day": "date", "n": "integer"}).collect()}
    assert (got[1].category, str(got[1].day), got[1].n, got[1].fallback) == ("Law", "2024-03-12", 3, False) and got[1].day_raw == "12 mars 2024"
    assert (got[2].category, got[2].fallback, got[2].error) == ("Other", True, None) and got[3].error == "failed_call"


def test_classification_of_a_context(spark):
    def model(p):
        return p.map(lambda x: '{"category": "art", "citations": ["[S1]", "S9"]}' if "paint" in x else '{"category": "zz"}' if "odd" in x else '{"category": "law", "citations": ["S9"]}')

    ctx = spark.createDataFrame([(1, "paint", ["S1"]), (2, "odd", ["S1"]), (3, "else", ["S1"])], "qid long, text string, citations array<string>")
    got = {r.qid: (r.category, r.citations, r.reason) for r in capability.classify_context(ctx, model, ["Law", " Art ", "law"]).collect()}
    assert got == {1: ("Art", ["S1"], None), 2: (None, [], "unknown_category"), 3: (None, [], "uncited")}


def test_tools_by_decorator_seeded_order_and_faithfulness(spark):
    from docquarry.operators import agent, order

    @capability.tool("count", "rows of a table")
    def rows(df):
        return df.groupBy().count()

    tools = capability.Registry()
    tools.register(rows)
    assert tools.execute("count", df=spark.range(3))[1].first()[0] == 3
    a, b = ([r.id for r in order.seeded(spark.range(50).repartition(n), "id", 7).orderBy("place").collect()] for n in (2, 5))
    assert a == b != sorted(a) and a != [r.id for r in order.seeded(spark.range(50), "id", 8).orderBy("place").collect()]
    answers = spark.createDataFrame([(1, "q", "a"), (2, "q", "b"), (3, "q", "c")], "qid long, question string, answer string")
    sources = spark.createDataFrame([(1, "S1", "t"), (2, "S1", "t")], "qid long, citation string, text string")
    got = {r.qid: (r.score, r.why) for r in agent.faithful(answers, sources, lambda p: p.map(lambda x: "about 140" if "ANSWER\na" in x else "none")).collect()}
    assert got == {1: (1.0, None), 2: (None, "unreadable"), 3: (None, "no_source")}


def test_a_model_gets_a_few_prompts_at_once(spark):
    """A task of a thousand prompts asks for 128 at once at most; other columns pass as they are."""
    df = spark.range(1000).coalesce(1).selectExpr("id", "if(id = 3, null, cast(id as string)) AS prompt", "array('S1', null) AS citations", "if(id % 2 = 0, id, null) AS n")
    sized = capability.call(df, lambda s: s.map(lambda p: None if p is None or p == "5" else f"{len(s)}:{p}"))
    rows = sized.collect()
    assert len(rows) == 1000 and max(int(r.answer.split(":")[0]) for r in rows if r.ok) <= 128
    assert {r.id for r in rows if not r.ok} == {3, 5} and all((r.answer is None) != r.ok and r.citations == ["S1", None] and r.n == (None if r.id % 2 else r.id) for r in rows)
