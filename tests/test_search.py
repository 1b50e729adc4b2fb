"""Filters, perimeters, the whole search, several documents, control, entities and scoring on small cases."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docquarry.functions import arrays, text, values
from docquarry.operators import agent, encode, entities, filters, multidoc, perimeter, retrieval, routing, scoring, search

PROFILE = filters.Profile({"amount": "number", "day": "date", "tags": "list[text]", "kind": "text"}, frozenset({"amount", "day", "tags", "kind"}))


def test_criteria_are_read_by_their_types(spark):
    got = filters.normalize(spark, {"amount": {"gte": "1 250,5"}, "tags": ["a", "n/a", "a"], "page": "3", "ocr": "oui", "doc_id": " x ", "category": "law", "day": None}, PROFILE, ("law",))
    assert got == {"amount": {"gte": 1250.5}, "tags": ["a"], "page": 3, "ocr": True, "doc_id": "x", "category": "law"}
    bad = [{"zz": 1}, {"kind": {"gte": "a"}}, {"amount": "many"}, {"page": ["1", "x"]}, {"category": "art"}, {"amount": {"near": 1}}, {"tags": ["n/a"]}, {"ocr": "perhaps"}, {"doc_id": " "}]
    for c in bad:
        with pytest.raises(ValueError):
            filters.normalize(spark, c, PROFILE, ("law",))
    assert filters.document_scope({"source": "s", "file_name": [" a ", "", "b"]}) == ("file_name", ("a", "b")) and filters.document_scope({"page": 1}) == ("", ())
    schema = filters.argument_schema(PROFILE)
    assert schema.fieldNames() == ["query", "top_k", "amount", "day", "kind", "tags"] and schema["tags"].dataType.simpleString() == "array<string>" and "gte" in schema["day"].dataType.fieldNames()
    assert [filters.index_type(k) for k in ("date", "boolean", "text")] == ["range", "value", "value"]


def test_facets_of_lists(spark):
    df = spark.createDataFrame([(1, [" a", "", "b "], None), (2, None, "t")], "doc_id long, titre array<string>, title string")
    assert [r.t for r in df.select(filters.facet(df, "title").alias("t")).collect()] == ["a b", "t"]
    assert filters.catalogue_columns(df) == ["doc_id", "titre", "title"]


CARDS = [(1, "annual_alpha.pdf", "/x/annual_alpha.pdf", "Alpha turbines 2020"), (2, "beta.docx", "/x/beta.docx", "Beta harbours"), (3, None, "/x/c", None), (4, "annual_alpha.txt", "/y/a", "Gamma rivers")]


@pytest.fixture(scope="module")
def cards(spark):
    return spark.createDataFrame(CARDS, "doc_id long, file_name string, source string, title string")


def refs(spark, *rows):
    return spark.createDataFrame(rows, "qid long, pos int, reference string")


def test_references(spark, cards):
    r = refs(spark, (1, 0, "BETA"), (1, 1, "beta.docx"), (2, 0, "1"), (2, 1, "2"), (3, 0, "zz"), (4, 0, "Annual-Alpha"), (5, 0, "3"), (6, 0, "/y/a"), (6, 1, "Beta harbours"))
    assert {(x.qid, x.pos): x.doc_id for x in perimeter.identify(r, cards).collect()} == {(1, 0): 2, (1, 1): 2, (2, 0): 1, (2, 1): 2, (3, 0): None, (4, 0): 1, (5, 0): 3, (6, 0): 4, (6, 1): 2}
    assert {x.qid: (x.status, x.doc_id) for x in perimeter.one_document(r, cards).collect()} == {1: ("ok", 2), 2: ("several_documents", None), 3: ("unknown_reference", None), 4: ("ok", 1), 5: ("ok", 3), 6: ("several_documents", None)}
    assert sorted((x.qid, x.place, x.doc_id) for x in perimeter.many_documents(r, cards).collect()) == [(1, 1, 2), (2, 1, 1), (2, 2, 2), (4, 1, 1), (5, 1, 3), (6, 1, 4), (6, 2, 2)]
    got = {x.qid: (x.status, x.field, x["values"]) for x in perimeter.explicit(r, cards).collect()}
    assert got[1] == ("exact", "doc_id", ["2"]) and got[2] == ("compatible", "doc_id", ["1", "2"]) and got[3] == ("unknown", None, None)
    q = spark.createDataFrame([(1, "x")], "qid long, text string")
    assert perimeter.from_filter(q, "source", ("a", "b")).first().status == "compatible"


def test_perimeters_gather_no_table_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(perimeter, "EACH", 1 << 13, raising=False)
    spark.range(70_000).repartition(1).write.parquet(str(tmp_path / "c"))
    ids = spark.read.parquet(str(tmp_path / "c"))
    common = F.when(F.col("id") < 20_000, "index.html")
    many = ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("f"), "id", F.lit(".pdf")).alias("file_name"), common.alias("source"), F.lit(None).cast("string").alias("title"))
    asked = ids.select(F.col("id").alias("qid"), F.posexplode(F.when(F.col("id") % 2 == 0, F.array(F.lit("nowhere"), F.col("id").cast("string"))).otherwise(F.array(F.concat(F.lit("F"), "id", F.lit(".PDF")), F.lit(" Index")))).alias("pos", "reference"))
    got, found = perimeter.explicit(asked, many), perimeter.identify(asked, many)
    assert {(r.status, r["count"]) for r in got.groupBy("status").count().collect()} == {("compatible", 35_000), ("unknown", 35_000)}
    assert got.where("qid % 2 = 1 AND (values[0] <> qid OR values[1] <> 0)").isEmpty() and got.where("qid % 2 = 0 AND labels[0] <> 'nowhere'").isEmpty()
    rows = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) >= 18 and max(rows) < 1.5 * sum(rows) / len(rows)  # the scan is one task, and half of the references are two
    for df in (got, found):  # common keys alone are broadcast
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 2 + (df is got)


def test_perimeters_of_odd_references(spark):
    c = spark.createDataFrame([(1, "a.pdf", None, None), (1, "b.pdf", None, None), (2, " ", "s", "T"), (None, "n.pdf", None, None)], "doc_id long, file_name string, source string, title string")
    r = refs(spark, (1, 0, "a.pdf"), (1, 1, "1"), (2, 0, "n.pdf"), (2, 1, "2"), (3, 0, None), (4, 0, "t"), (4, 1, "S"), (5, 0, "x"), (5, 1, "x"), (5, 2, "b"), (6, 0, ""))
    got = {x.qid: (x.status, x.field, x["values"], x.labels) for x in perimeter.explicit(r, c).collect()}
    assert got[1] == ("compatible", "doc_id", ["1", "1"], ["a.pdf", "b.pdf"]) and got[2] == ("unknown", None, None, ["n.pdf"]) and got[3] == ("unknown", None, None, [])
    assert got[4] == ("exact", "doc_id", ["2"], ["T"]) and got[5] == ("unknown", None, None, ["x"]) and got[6][0] == "exact"


def test_questions_name_documents(spark, cards):
    q = spark.createDataFrame([(1, "What does the report on Alpha turbines say, and Beta harbours?"), (2, "nothing named"), (3, "revenue in Beta harbours")], "qid long, text string")
    named = sorted((r.qid, r.doc_id) for r in perimeter.named_documents(q, cards).collect())
    assert named == [(1, 1), (1, 2), (3, 2)]
    assert {r.qid: r.status for r in perimeter.from_questions(q, cards).collect()} == {3: "exact"} or (3, 2) in named
    assert {r.qid: r.status for r in agent.resolved(q, cards).collect()}[2] == "none"


def test_sources_of_one_document(spark):
    s = spark.createDataFrame([(1, 1, "a.pdf", "s1"), (1, 2, "b.pdf", "s2"), (2, 1, "a.pdf", "s1"), (3, 1, "ab.pdf", "s"), (3, 2, "abc.pdf", "s")], "qid long, doc_id long, file_name string, source string")
    asked = spark.createDataFrame([(1, "A.pdf"), (2, "zz"), (3, "ab")], "qid long, document string")
    assert [(r.qid, r.doc_id) for r in perimeter.only_document(s, asked).collect()] == [(1, 1)]
    assert sorted((r.qid, r.doc_id) for r in perimeter.only_documents(s, asked).collect()) == [(1, 1), (3, 1), (3, 2)]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(10, 1, 0, "turbines spin fast in wind"), (11, 1, 1, "more about wind and sails"), (12, 1, 2, "prices of steel"), (20, 2, 0, "harbours and wind"), (21, 2, 1, "ships wait in harbours"), (30, 3, 0, "  "), (40, 4, 0, "rivers carry turbines of wind")]
    return spark.createDataFrame(rows, "point long, doc_id long, chunk_index long, text string")


def test_whole_search(spark, cards, chunks):
    q = spark.createDataFrame([(1, "turbines and wind"), (2, "wind"), (3, "steel prices"), (4, " "), (5, "wind"), (6, "zebra")], "qid long, text string")
    bounds = perimeter.explicit(refs(spark, (2, 0, "2"), (3, 0, "2"), (5, 0, "nowhere")), cards)
    passages, report = search.search(q, chunks, bounds=bounds, expand=False)
    got = {}
    for r in passages.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.point)
    assert got[1][:2] == [40, 10] or got[1][:2] == [10, 40]
    assert got[2] == [20] and 3 not in got and 5 not in got
    rep = {r.qid: (r.status, r.reason) for r in report.collect()}
    assert rep == {1: ("none", None), 2: ("exact", None), 3: ("exact", "perimeter_without_passage"), 4: ("empty_question", None), 5: ("unknown", "perimeter_without_passage"), 6: ("none", "no_candidate")}
    assert search.search(q, chunks, threshold=2.0, expand=False)[1].where("qid = 1").first().reason == "no_passage_kept"
    wide = search.search(q.where("qid = 2"), chunks, bounds=bounds)[0].orderBy("rank").collect()
    assert [(r.point, r.added, r.citation) for r in wide] == [(20, False, "S1"), (21, True, "S2")]
    few = search.search(q.where("qid = 1"), chunks, criteria={"doc_id": "4"}, profile=filters.Profile({}), expand=False)[0].collect()
    assert [r.point for r in few] == [40]
    with pytest.raises(ValueError):
        search.search(q, chunks, top_k=0)


def test_search_with_vectors(spark, chunks):
    both = encode.encode(chunks).drop("sparse")
    q = encode.encode_queries(spark.createDataFrame([(1, " harbours   and wind ")], "qid long, text string")).drop("sparse")
    first = search.search(q, both, expand=False)[0].where("rank = 1").first()
    assert first.point == 20
    only = search.search(q.select("qid", "text", "vector"), both, score=None, expand=False)[0]
    assert only.where("score is not null").count() == 0 and only.where("rank = 1").first().point == 20


def test_encoders(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "text string")
    got = encode.encode(df).collect()
    assert sorted(got[0].sparse["values"]) == [1.0, 2.0] and abs(sum(x * x for x in got[0].vector) - 1) < 1e-9 and set(got[1].vector) == {0.0}
    lengths = encode.encode_dense(df, model=lambda s: s.map(lambda t: [float(len(t)), 1.0])).collect()
    assert [r.vector for r in lengths] == [[5.0, 1.0], [0.0, 1.0], [0.0, 1.0]]

    def broken(s):
        raise RuntimeError

    assert all(r.vector is None for r in encode.encode_dense(df, model=broken).collect())


def test_context_and_citations(spark):
    p = spark.createDataFrame([(1, "S1", 1, "x", 0.5), (1, "S2", 1, " ", 0.4), (2, "S1", 9, "y", 0.9), (3, "S1", 1, "a", 0.2), (3, "S2", 1, "b", 0.1)], "qid long, citation string, doc_id long, text string, score double")
    rep = spark.createDataFrame([(1, None), (2, None), (3, None), (4, "no_candidate")], "qid long, reason string")
    bounds = spark.createDataFrame([(2, "exact", "doc_id", ["1"])], "qid long, status string, field string, values array<string>")
    got = {r.qid: (r.sufficient, r.reason, r.n_passages, r.warning) for r in search.check_context(p, rep, bounds).collect()}
    assert got == {1: (True, None, 1, None), 2: (False, "outside_perimeter", 0, None), 3: (True, None, 2, "one_document_only"), 4: (False, "no_candidate", 0, None)}
    a = spark.createDataFrame([(1, "yes [S1]"), (2, "no [S1]"), (3, "none"), (1 + 3, "[S9] [S1]")], "qid long, answer string")
    got = {r.qid: (r.valid, r.unknown, r.outside) for r in search.check_citations(a, p, bounds).collect()}
    assert got == {1: (True, [], []), 2: (False, [], ["S1"]), 3: (False, [], []), 4: (False, ["S9", "S1"], [])}
    assert search.check_citations(a.where("qid = 3"), p, required=False).first().valid


def test_document_order(spark):
    c = spark.createDataFrame([(1, 5, None), (1, 4, None), (1, 9, 0), (2, 1, 3)], "doc_id long, point long, chunk_index long")
    got = [(r.doc_id, r.point, r.citation) for r in search.load_documents(c, spark.createDataFrame([(1,)], "doc_id long")).orderBy("place").collect()]
    assert got == [(1, 9, "S1"), (1, 4, "S2"), (1, 5, "S3")]


TARGETS = "qid long, index long, doc_id long, label string"


def test_plans_fall_back(spark):
    q = spark.createDataFrame([(1, "q", "compare", "inter"), (2, "q", "synthesize", "intra"), (3, "q", "odd", "inter")], "qid long, text string, operation string, scope string")
    t = spark.createDataFrame([(i, 1, 1, "one") for i in (1, 2, 3)], TARGETS)

    def model(p: pd.Series) -> pd.Series:
        return p.map(lambda x: '{"axes": ["a", "a", " b "], "objective": "o"}' if "compare" in x else "no json")

    got = {r.qid: (r.axes, r.fallback) for r in multidoc.plans(q, t, model).collect()}
    assert got[1] == (["a", "b"], False) and got[2] == (multidoc.FALLBACK["synthesize", "intra"][1], True) and got[3][0] == multidoc.FALLBACK["compare", "inter"][1]
    assert all(r.fallback for r in multidoc.plans(q, t).collect()) and all(r.fallback for r in multidoc.plans(q, t, model, budget=10).collect())


def test_maps_validate_and_refuse(spark):
    q = spark.createDataFrame([(1, "q", "compare", "inter")], "qid long, text string, operation string, scope string")
    t = spark.createDataFrame([(1, 1, 1, "one"), (1, 2, 2, "two"), (1, 3, 3, "none"), (1, 4, 4, "big"), (1, 5, 5, "bad")], TARGETS)
    p = spark.createDataFrame([(1, 1, "alpha"), (1, 2, "beta"), (2, 1, "empty"), (4, 1, "x" * 90), (4, 2, "y" * 90), (4, 3, "z" * 90), (5, 1, "fail")], "doc_id long, n long, text string")

    def model(prompts: pd.Series) -> pd.Series:
        def one(x):
            if "fail" in x:
                raise RuntimeError
            if "alpha" in x:
                return json.dumps({"elements": [{"axis": "subject and scope", "content": "a  b", "citations": ["[D1S1]", "D9S9"]}, {"axis": "no axis", "content": "x", "citations": ["D1S1"]}, {"axis": "main points", "content": "inline [D1S2]"}, {"axis": "main points", "content": " ", "citations": ["D1S1"]}, {"axis": "subject and scope", "content": "a b", "citations": ["D1S2"]}]})
            return '{"elements": []}'

        return prompts.map(one)

    elements, docs = multidoc.maps(multidoc.plans(q, t), t, p, model, limit=120, most=2)
    assert [(r["index"], r.axis, r.content, r.citations) for r in elements.orderBy("pos").collect()] == [(1, "subject and scope", "a b", ["D1S1"]), (1, "main points", "inline [D1S2]", ["D1S2"])]
    assert {r["index"]: r.status for r in docs.collect()} == {1: "usable", 2: "no_evidence", 3: "empty", 4: "too_large", 5: "failed"}
    assert {r["index"]: r.status for r in multidoc.maps(multidoc.plans(q, t), t, p, model, limit=120, budget=100)[1].collect()}[1] == "over_budget"
    body = multidoc.rendered(elements, docs).first()
    assert body.prompt.startswith("### Document D1 - one\n[subject and scope]\n- a b [D1S1]\n\n[main points]") and "(not available: too_large)" in body.prompt and body.allowed == ["D1S1", "D1S2"]
    assert [r.citation for r in multidoc.sources(elements, multidoc.numbered(t, p)).orderBy("citation").collect()] == ["D1S1", "D1S2"]


def test_multi_document_statuses(spark):
    q = spark.createDataFrame([(1, "q", "compare", "inter"), (2, "q", "compare", "inter"), (3, "q", "synthesize", "intra"), (4, "q", "compare", "inter")], "qid long, text string, operation string, scope string")
    t = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "b"), (2, 1, 1, "a"), (3, 1, 2, "b"), (4, 1, 8, "x"), (4, 2, 9, "y")], TARGETS)
    p = spark.createDataFrame([(1, 1, "one"), (2, 1, "two")], "doc_id long, n long, text string")
    got = {r.qid: (r.status, r.reason, r.citations) for r in multidoc.run(q, t, p, multidoc.Scripted())[0].collect()}
    assert got[1] == ("complete", None, ["D1S1", "D2S1"]) and got[2][:2] == ("refused", "too_few_documents") and got[3][0] == "complete" and got[4][:2] == ("failed", "no_usable_document")
    first = spark.createDataFrame([(1, "failed", None, [], 2), (2, "ok", "x", ["S1"], 1), (3, "no_passage", None, [], 0)], "qid long, status string, answer string, citations array<string>, n_passages long")
    again = multidoc.with_fallback(first, lambda ids: ids.select("qid", F.lit("ok").alias("status"), F.lit("again").alias("answer"), F.array(F.lit("S2")).alias("citations"), F.lit(2).cast("long").alias("n_passages")))
    assert {r.qid: r.answer for r in again.collect()} == {1: "again", 2: "x", 3: None}


INTENTS = [
    ("Résume ce rapport.", "summarize"), ("Quelle est la classification de risque mentionnée ?", "search"), ("Compare these two reports.", "compare"), ("Overview of both files", "synthesize"),
    ("Compare les deux méthodes décrites dans rapport_alpha.pdf.", "compare"), ("What is the total revenue?", "search"), ("Differences between a.pdf and b.docx", "compare"), ("Extract the totals.", "extract"),
]


def test_intents(spark):
    q = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(INTENTS)], "qid long, text string")
    assert [r.intent for r in agent.intents(q).orderBy("qid").collect()] == [x for _, x in INTENTS]

    def model(p: pd.Series) -> pd.Series:
        return p.map(lambda x: '{"intent": "classify"}' if x.startswith("DECIDE") else '{"intent": "compare"}')

    got = [r.intent for r in agent.intents(q, model=model).orderBy("qid").collect()]
    assert got[1] == "classify" and got[5] == "search"  # no document is named, so the model's comparison is not kept
    named = spark.createDataFrame([(5, 1), (5, 2)], "qid long, doc_id long")
    late = {r.qid: (r.intent, r.scope) for r in agent.intents(q, named, model).collect()}
    assert late[5] == ("compare", "inter")
    assert [r.n for r in spark.createDataFrame([("compare",), ("clarify",)], "i string").select(agent.node(F.col("i")).alias("n")).collect()] == ["compare", "search"]


def test_requests_in_answers(spark):
    df = spark.createDataFrame([("Classe selon leur Angle : IA, Cybersécurité ou sport", '{"categories": ["ia", "cybersecurite.", "IA", "art"], "fields": [" a  b", "a b", ""]}'), ("x", "none")], "q string, a string")
    got = df.select(agent.requested_categories(F.col("q"), F.col("a")).alias("c"), agent.requested_fields(F.col("a")).alias("f"), agent.whole_corpus(F.lit("Classe tous les documents")).alias("w")).collect()
    assert got[0].c == ["ia", "cybersecurite"] and got[0].f == ["a b"] and got[1].c == got[1].f == [] and got[0].w


def test_targets_of_the_corpus_and_references(spark, cards):
    q = spark.createDataFrame([(1, "Classe tous les documents"), (2, "Classe ce rapport")], "qid long, text string")
    none = spark.createDataFrame([], "qid long, status string")
    assert [(r.qid, r["index"], r.doc_id) for r in agent.corpus_targets(q, cards, none, 2).orderBy("index").collect()] == [(1, 1, 3), (1, 2, 1)]
    intended = spark.createDataFrame([(1, "compare", "inter"), (2, "synthesize", "intra"), (3, "compare", "intra"), (4, "compare", "intra"), (5, "search", "none")], "qid long, intent string, scope string")
    named = spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "qid long, place long, doc_id long")
    aim = spark.createDataFrame([(2, 1, 5), (3, 1, 5), (3, 2, 6), (4, None, None)], "qid long, index long, doc_id long")
    got = {r.qid: (r.doc_ids, r.refusal) for r in agent.references(intended, named, aim).collect()}
    assert got == {1: ([7, 8], None), 2: ([5], None), 3: ([], "several_candidates"), 4: ([], "no_relevant_document")}


@pytest.fixture(scope="module")
def judge():
    def one(x):
        if x.startswith("SUFFICIENT?"):
            return json.dumps({"sufficient": "good" in x, "why": "no value"})
        if x.startswith("REFORMULATE"):
            return None if "stuck" in x else json.dumps({"query": x.split("\n")[1] + " good"})
        if x.startswith("REPAIR"):
            return "fixed [S1]" if "repairable" in x else "still [S7]"
        return "answer [S1]" if "plain" in x else "repairable [S9]" if "fix" in x else "wrong [S9]"

    return lambda prompts: prompts.map(one)


def test_attempts_reformulate_and_stop(spark, judge):
    q = spark.createDataFrame([(1, "good one"), (2, "weak two"), (3, "nothing"), (4, "stuck weak")], "qid long, text string")

    def find(open_):
        score = F.when(F.col("text").contains("nothing"), 0.05).otherwise(0.6)
        return open_.select("qid", F.lit(1).alias("rank"), F.lit("S1").alias("citation"), "text", score.alias("score"))

    outcomes, passages, trace = agent.attempts(q, find, judge, most=3)
    assert {r.qid: (r.outcome, r.attempts) for r in outcomes.collect()} == {1: ("answered", 1), 2: ("answered", 2), 3: ("refused", 2), 4: ("refused", 3)}
    assert sorted(r.qid for r in passages.collect()) == [1, 2] and trace.where("qid = 4").count() == 3


def test_generation_repairs_or_refuses(spark, judge):
    q = spark.createDataFrame([(1, "plain"), (2, "fix"), (3, "never"), (4, "no passage")], "qid long, text string")
    p = spark.createDataFrame([(i, 1, "S1", 1, "t") for i in (1, 2, 3)], "qid long, rank long, citation string, doc_id long, text string")
    got = {r.qid: (r.status, r.repaired, r.citations) for r in agent.generate(q, p, judge).collect()}
    assert got == {1: ("answered", False, ["S1"]), 2: ("answered", True, ["S1"]), 3: ("refused", False, []), 4: ("refused", False, [])}
    assert {r.status for r in agent.generate(q.where("qid = 1"), p, lambda s: s.map(lambda x: " ")).collect()} == {"error"}


def test_responses(spark, judge):
    q = spark.createDataFrame([(1, "good plain", "default"), (2, " ", "default"), (3, "x", "nowhere"), (4, "nothing", "default")], "qid long, text string, corpus_id string")

    def find(open_):
        return open_.where("not text like '%nothing%'").select("qid", F.lit(1).alias("rank"), F.lit("S1").alias("citation"), F.lit(1).alias("doc_id"), "text", F.lit(0.9).alias("score"))

    got = agent.respond(q, spark.createDataFrame([("default",)], "corpus_id string"), find, judge, most=2)
    assert {r.qid: (r.status, r.error) for r in got.collect()} == {1: ("answered", None), 2: ("error", "empty_question"), 3: ("error", "unknown_corpus"), 4: ("refused", None)}
    shaped = agent.response("search", got, F.lit(True), F.lit(None).cast("boolean"))
    assert shaped.where("ok").count() == 1 and shaped.where("refused").count() == 1
    ids = agent.with_ids(spark.createDataFrame([("req-1",), ("bad id!",)], "request string")).collect()
    assert ids[0].request_id == "req-1" and len(ids[1].request_id) == 36 and ids[0].execution_id != ids[1].execution_id


def test_entities_live_from_run_to_run(spark, tmp_path):
    root = str(tmp_path / "names")
    reg = entities.open_registry(spark, root)
    batch = spark.createDataFrame([("org", "Alpha Corp", 1, [1.0, 0.0]), ("org", "ALPHA corp", 2, None), ("org", "Alpha Corp.", 3, None), ("org", "Quite other", 4, [0.999, 0.01]), ("org", "n/a", 5, None), ("city", "Alpha Corp", 6, None)], "field string, value string, pos int, vector array<double>")
    got = entities.resolve_batch(batch, reg)
    assert {(r.field, r.value): (r.canonical, r.phase) for r in got.collect()} == {
        ("org", "Alpha Corp"): ("Alpha Corp", "new"), ("org", "ALPHA corp"): ("Alpha Corp", "exact"), ("org", "Alpha Corp."): ("Alpha Corp", "letters"), ("org", "Quite other"): ("Alpha Corp", "vectors"), ("city", "Alpha Corp"): ("Alpha Corp", "new"),
    }
    entities.save(entities.update(reg, batch, got), root)
    reg = entities.open_registry(spark, root)
    org = reg.where("field = 'org'").first()
    assert org.alias == ["Alpha Corp.", "Quite other"] and org.frequency == 4
    again = entities.resolve_batch(spark.createDataFrame([("org", "quite OTHER", 1)], "field string, value string, pos int"), reg).first()
    assert (again.canonical, again.phase) == ("Alpha Corp", "alias")
    bad = spark.createDataFrame([("f", "a", ["x"], 1), ("f", "b", ["X"], -1), ("f", " ", [], 1)], entities.SCHEMA)
    assert {r.error for r in entities.check(bad).collect()} == {"shared_variant", "bad_frequency", "empty_name"}
    with pytest.raises(ValueError):
        entities.save(bad, root)
    known = spark.createDataFrame([("f", "a", [1.0, 0.0]), ("f", "b", [0.0, 1.0])], "field string, canonical string, vector array<double>")
    near = entities.nearest(spark.createDataFrame([("f", "v", [0.9, 0.1]), ("f", "w", [0.5, 0.5])], "field string, value string, vector array<double>"), known).collect()
    assert [(r.value, r.canonical) for r in near] == [("v", "a")]
    rows = spark.createDataFrame([(1, "1 250,5", "ALPHA CORP"), (2, "x", None)], "id int, amount string, org string")
    done = {r.id: r for r in entities.normalized_rows(rows, {"amount": "number", "org": "text"}, reg, ("org",), "id").collect()}
    assert done[1].amount == 1250.5 and done[1].org == "Alpha Corp" and done[1].org_raw == "ALPHA CORP" and done[2].org is None


def test_numbers_dates_and_texts(spark):
    cases = {"105 727,236": 105727.236, "105,727.236": 105727.236, "105727.236": 105727.236, "1,234": 1234.0, "1,234,567": 1234567.0, "-3.5": -3.5, "x": None, "0,5": 0.5}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", values.answer_number(F.col("t")).alias("v")).collect()} == cases
    days = {"12 mars 2024": "2024-03-12", "March 12th, 2024": "2024-03-12", "12/03/2024": "2024-03-12", "2024-03-12T10:00": "2024-03-12", "12 مارس 2024": "2024-03-12", "1er janvier 2020": "2020-01-01", "mars 2024": None, "2024": None, "31.02.2024": None, "12-03/2024": None}
    df = spark.createDataFrame([(k,) for k in days], "t string")
    assert {r.t: r.v and str(r.v) for r in df.select("t", values.date(F.col("t")).alias("v")).collect()} == days
    assert str(spark.createDataFrame([("20240312",)], "t string").select(values.date(F.col("t"), formats=("yyyyMMdd",)).alias("v")).first().v) == "2024-03-12"
    many = ",".join(["12"] * 1500 + ["123"])
    assert spark.createDataFrame([(many,), (many[:-4] + ",1234,123",)], "t string").select(values.number(F.col("t")).alias("v")).collect()[1].v is not None
    t = spark.createDataFrame([("Hôtel Al-Safwa  ", "## T ", "a | B", "ﬁ")], "a string, b string, c string, d string").select(text.normal_text(F.col("a")).alias("a"), text.title_text(F.col("b")).alias("b"), text.line_print(F.col("c")).alias("c"), text.compatible(F.col("d")).alias("d")).first()
    assert (t.a, t.b, t.c, t.d) == ("hotel al safwa", "T", "a b", "fi")
    o = spark.createDataFrame([('{"b": "x", "a": [1, 2], "c": null}',)], "j string").select(arrays.outline(F.col("j")).alias("o")).first().o
    assert o == "  a: 1, 2\n  b: x"
    assert spark.range(1).select(text.cited_items(F.array(F.lit("x [D1S1] y [D2S2]"), F.lit("z")), F.array(F.lit("D1S1"))).alias("i")).first().i == ["x [D1S1] y"]
    assert spark.range(1).select(arrays.precision(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"))).alias("p")).first().p == 0.5


def test_python_tokens_equal_the_expression(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", text.tokens(F.col("text")).alias("t")).collect()
    assert all(text.tokens_of(r.text) == (r.t or []) for r in docs)


def test_signal_of_documents(spark):
    cases = [("Compare these two reports.", True, "compare", "inter", 2), ("Compare les deux méthodes décrites dans rapport_alpha.pdf.", False, "compare", "intra", 1), ("Synthétise les 3 rapports", True, "synthesize", "inter", 3), ("Quels sont les différents dispositifs décrits dans ce rapport ?", False, "none", "none", 1), ("Synthétise les différents chapitres de ce rapport.", False, "synthesize", "intra", 1), (None, False, "none", "none", 0)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, q string").select("i", routing.multi_document(F.col("q")).alias("m"))
    got = [(r.m.is_multi, r.m.operation, r.m.scope, r.m.n_documents) for r in df.orderBy("i").collect()]
    assert got[:-1] == [c[1:] for c in cases[:-1]]


def test_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    s = lambda x: F.lit(x)
    none = F.array().cast("array<string>")
    assert one(scoring.covers(s("It took place on 20 September 1792 in Valmy"), s("The battle of Valmy was on 20 September 1792"), none, s("battle of Valmy, 20 September 1792"), s("When was the battle?")))
    assert not one(scoring.covers(s("in Valmy, September 1793"), s("The battle of Valmy was on 20 September 1792"), none, s("battle of Valmy, 20 September 1792"), s("When was the battle?")))
    assert one(scoring.numbers_clash(s("in 1990"), s("in 1991"))) and not one(scoring.numbers_clash(s("some"), s("in 1991")))
    assert one(scoring.refused(s(True), s(0))) and not one(scoring.refused(s(True), s(2)))


def test_sparse_search(spark):
    v = spark.createDataFrame([(1, {"1": 1.0, "2": 2.0}), (2, {"2": 5.0, "3": -1.0}), (3, {"9": 1.0})], "doc_id long, m map<string,double>").select("doc_id", arrays.sparse(F.col("m")).alias("sparse"))
    got = retrieval.sparse(v.where("doc_id = 1").withColumnRenamed("doc_id", "qid"), v, 5).collect()
    assert [(r.doc_id, r.score) for r in got] == [(2, 10.0), (1, 5.0)]
    pair = v.alias("a").crossJoin(v.alias("b")).where("a.doc_id = 1 and b.doc_id = 2").select(arrays.sparse_dot(F.col("a.sparse"), F.col("b.sparse")).alias("d"))
    assert pair.first().d == 10.0


QUESTIONS = [
    ("Résume ce rapport.", "summarize", False, "none", "none"), ("Classe ce document.", "classify", False, "none", "none"), ("Quelle classe de risque ?", "search", False, "none", "none"),
    ("Quelle est la classification de risque mentionnée ?", "unsure_classify", False, "none", "none"), ("Extract the totals.", "extract", False, "none", "none"), ("Fournisseur : ? Date : ?", "extract", False, "none", "none"),
    ("Donne-moi le fournisseur, la date.", "unsure_extract", False, "none", "none"), ("Récupère le montant et la date", "extract", False, "none", "none"), ("What is the total revenue?", "search", False, "none", "none"),
    ("Compare these two reports.", "search", True, "compare", "inter"), ("Compare les deux méthodes décrites dans rapport_alpha.pdf.", "search", False, "compare", "intra"),
    ("Quels sont les différents dispositifs décrits dans ce rapport ?", "search", False, "none", "none"), ("Synthétise les différents chapitres de ce rapport.", "summarize", False, "synthesize", "intra"),
    ("Peux-tu synthétiser rapport_alpha.pdf ?", "summarize", False, "none", "none"), ("Differences between a.pdf and b.docx", "unsure_extract", True, "compare", "inter"), ("Overview of both files", "search", True, "synthesize", "inter"),
    ("What is the similarity of these two reports?", "search", True, "none", "none"), ("Quelle similarité entre ces deux rapports ?", "search", True, "compare", "inter"), ("Combined view of those three files", "search", True, "synthesize", "inter"),
]


def test_rules_of_intent_and_signal(spark):
    d = spark.createDataFrame([(i, x[0]) for i, x in enumerate(QUESTIONS)], "id int, q string")
    got = d.select("id", routing.intent(F.col("q")).alias("intent"), routing.multi_document(F.col("q")).alias("m")).orderBy("id").collect()
    assert [(r.intent, r.m.is_multi, r.m.operation, r.m.scope) for r in got] == [x[1:] for x in QUESTIONS]


YEARS = [("value 2020 in the 2022 report", [2022], [2020]), ("rapport 2022", [2022], []), ("2021 annual financial statements", [2021], []), ("2020 in the document", [], [2020]), ("nothing here", [], []), ("exercice 2019 et 2018", [2019], [2018])]


def test_years_of_publication(spark):
    from docquarry.operators import resolve

    d = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(YEARS)], "id int, q string").withColumn("y", resolve.publication_years(text.tokens(F.col("q"))))
    assert [(r.y.publication, r.y.named) for r in d.orderBy("id").collect()] == [(p, v) for _, p, v in YEARS]


def test_ablation_shares_stages(spark):
    """Seven settings: every distinct prefix once, and each the same as a search of its own."""
    import numpy as np

    from docquarry.operators import ablation

    rng = np.random.default_rng(3)
    words = "alpha beta gamma delta turbine harbour winter report".split()
    rows = [(d * 10 + c, d, c, f"/x/{d}.pdf", " ".join(rng.choice(words, 8)), rng.normal(size=4).tolist()) for d in range(12) for c in range(4)]
    chunks = spark.createDataFrame(rows, "point long, doc_id long, chunk_index long, source string, text string, vector array<double>")
    asked = spark.createDataFrame([(q, " ".join(rng.choice(words, 3)), rng.normal(size=4).tolist()) for q in range(8)], "qid long, text string, vector array<double>")
    bounds = spark.createDataFrame([(1, "exact", "doc_id", ["3"], ["d"], "explicit"), (2, "unknown", None, None, None, "explicit")], "qid long, status string, field string, values array<string>, labels array<string>, origin string")
    gold = spark.createDataFrame([(q, int(rng.integers(0, 12))) for q in range(8)], "qid long, doc_id long")
    runs = ablation.Runs(asked, chunks, bounds)
    got = {r.setting: r for r in ablation.table(runs, gold).collect()}
    assert runs.made == {"found": 3, "ranked": 5, "kept": 6, "context": 7} and len(got) == 7 and got["reference"].delta == 0
    own = {"without_perimeter": {"bounds": None}, "without_reranking": {"score": None}, "with_threshold": {"threshold": search.THRESHOLD}, "without_neighbours": {"expand": False}, "without_diversity": {"per_document": 999}, "reference": {}}
    for name, options in own.items():
        mine = search.search(asked, chunks, **{"bounds": bounds, **options})[0]
        path = next(s for s in ablation.levers() if s.name == name).path()
        assert {(r.qid, r["rank"], r.point) for r in mine.collect()} == {(r.qid, r["rank"], r.point) for r in runs.at(path).collect()}, name
    assert got["dense_alone"].n_passages > 0


def test_at_k_of_classes_equals_pairs(spark):
    from docquarry.operators import evaluate

    rng = random.Random(4)
    label = [(i, rng.choice([0, 1, 2, None]) if i else 9) for i in range(120)] + [(None, 1)]
    classes = spark.createDataFrame(label, "doc_id long, class int")
    ranked = spark.createDataFrame([(q, d, r) for q in range(0, 120, 10) for r, d in enumerate(rng.sample(range(120), 9), 1)], "qid long, doc_id long, rank long")
    asked = classes.where("doc_id % 10 = 0").select(F.col("doc_id").alias("qid"))
    gold = asked.join(classes.withColumnRenamed("doc_id", "qid"), "qid").join(classes, "class").where("qid <> doc_id")
    made = evaluate.at_k_of_classes(ranked, classes, asked, 7)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, evaluate.at_k(ranked.where("qid <> doc_id"), gold, 7).collect())) and made.count() > 3


def test_at_k_of_classes_makes_no_pairs(spark):
    """As pairs of queries and gold documents these would be 1.6 billion."""
    import time

    from docquarry.operators import evaluate

    classes = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("class"))
    asked = classes.select(F.col("doc_id").alias("qid"))
    ranked = asked.select("qid", ((F.col("qid") + 1) % 40_000).alias("doc_id"), F.lit(1).cast("long").alias("rank"))
    began = time.time()
    assert evaluate.at_k_of_classes(ranked, classes, asked, 10).where("hit = 1 and precision = 0.1").count() == 40_000
    assert time.time() - began < 60
