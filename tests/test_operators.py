"""Operators on small cases: votes, batches, contexts, chunks, diversity, filters, sources, routing, streams."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text
from docquarry.operators import attributes, evaluate, filters, retrieval, routing, structure
from docquarry.sources import files, registry
from docquarry.streaming import windows


@pytest.mark.parametrize("yes, fails, total, verdict", [(10, 0, 20, None), (11, 0, 20, "a"), (1, 19, 20, None), (0, 3, 3, None)])
def test_majority(spark, yes, fails, total, verdict):
    rows = [(1, "a", True)] * yes + [(1, "x", False)] * fails + [(1, "b", True)] * (total - yes - fails)
    got = evaluate.majority(spark.createDataFrame(rows, "d int, c string, ok boolean"), "d", "c", F.col("ok")).collect()[0]
    assert (got.total, got.verdict) == (total, verdict)


def test_batches(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 6, 3, 9, 1])], "d int, o long, c int")
    got = structure.batches(df, "d", "o", F.col("c") - 8, 10).orderBy("o").collect()
    assert [r.batch for r in got] == [1, 2, 2, 3, 3]


def test_context_stops_and_cuts(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 1), (2, 1, 99), (2, 2, 1)], "d int, o int, c int")
    got = structure.context(df, "d", "o", F.col("c"), 10).orderBy("d", "o").collect()
    assert [(r.d, r.o, r["cut"]) for r in got] == [(1, 1, False), (2, 1, True)]


def test_blocks_and_chunks():
    page = "# Title\n\nSome text here.\nMore.\n\n- one\n- two\n\na | b\nc | d\ne | f\n\nsingle | bar"
    kinds = [k for k, _, _ in structure.blocks_of(page)]
    assert kinds == ["title", "paragraph", "list", "table", "paragraph"]
    got = structure.chunks_of(page)
    assert [c["kind"] for c in got] == ["paragraph", "list", "table", "paragraph"] and all(c["section"] == "Title" for c in got)
    assert got[0]["parent"] == got[1]["parent"] != got[2]["parent"]
    assert structure.chunks_of("Only a title")[0]["kind"] == "title" and structure.chunks_of("") == [] == structure.chunks_of("  \n ")


def test_split_text_keeps_every_word():
    t = " ".join(f"word{i}" for i in range(2000))
    got = structure.split_text(t)
    assert all(len(p) <= structure.CHUNK for p in got) and {w for p in got for w in p.split()} == set(t.split())
    assert "".join(structure.split_text("x" * 5000, 100, 0)) == "x" * 5000


def test_table_windows(spark):
    body = "\n".join(f"r{i} | {i}" for i in range(25))
    df = spark.createDataFrame([(1, "head | n\n" + body), (2, "one | line"), (3, None)], "doc_id long, text string")
    got = structure.table_windows(structure.table_runs(structure.lines(df))).orderBy("window").collect()
    assert [(r.first_row, r.last_row) for r in got] == [(2, 13), (12, 23), (22, 26)] and all(r.text.startswith("head | n\n") for r in got)


def test_diversify_order(spark):
    rows = [(1, 1, 7, "A"), (1, 2, 7, "B"), (1, 3, 7, "C"), (1, 4, 7, "D"), (1, 5, 8, "d"), (1, 6, 8, " a "), (1, 7, 9, " "), (1, 8, 9, "E")]
    got = retrieval.diversify(spark.createDataFrame(rows, "qid int, rank long, doc_id long, text string")).orderBy("place").collect()
    assert [r.rank for r in got] == [1, 2, 3, 5, 8]  # D was full, so its twin d is still taken; a repeats A


def test_expand_parents_once(spark):
    chunks = spark.createDataFrame([(1, i, "p1" if i < 3 else None, "x" * 10) for i in range(6)], "doc_id long, chunk_index long, parent_id string, text string")
    hits = chunks.where("chunk_index in (1, 4)").withColumn("qid", F.lit(1).cast("long")).withColumn("rank", F.when(F.col("chunk_index") == 1, 1).otherwise(2))
    got = retrieval.expand_context(hits, chunks).orderBy("place").collect()
    assert [(r.chunk_index, r.added) for r in got] == [(1, False), (0, True), (2, True), (4, False), (3, True), (5, True)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["z"]), (3, None, None)], "n int, s string, l array<string>")
    ids = lambda c: [r.n for r in filters.select(df, c).orderBy("n").collect()]
    assert ids({"s": ["a", "b"], "n": {"gte": 2}}) == [2] and ids({"l": ["y", "q"]}) == [1] and ids({"l": "z"}) == [2] and ids({"s": None}) == [1, 2, 3]
    for bad in ({"nope": 1}, {"n": {"near": 1}}):
        with pytest.raises(ValueError):
            filters.condition(df, bad)
    with pytest.raises(ValueError):
        filters.condition(df, {"s": "a"}, filters.Profile({"s": "text"}))
    assert filters.Profile({"s": "text", "l": "list[date]"}).schema().simpleString() == "struct<s:string,l:array<date>>"


def test_filter_reaches_the_scan(spark, sf_dir):
    df = filters.select(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), {"l_returnflag": "R", "l_quantity": {"gte": 10}}).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "GreaterThanOrEqual(l_qu" in plan
    assert "l_tax" not in plan


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text(" hello ")
    (tmp_path / "sub" / "b.html").write_text("<p>x &amp; <b>y</b></p><script>no()</script>")
    (tmp_path / "c.csv").write_text('h1,h2\n1,"2"\n,\n')
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "~$lock.txt").write_text("x")
    (tmp_path / "e.bin").write_bytes(b"x")
    got = {r.name: (r.text, r.error) for r in files.load(files.discover(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("hello", None), "b.html": ("x &\ny", None), "c.csv": ("h1 | h2\n1 | 2", None), "d.pdf": (None, "needs_recognition")}


def test_registry(spark, tmp_path):
    old = spark.createDataFrame([("a", "1", "s"), ("b", "1", "s"), ("c", None, "s")], "path string, hash string, signature string")
    new = spark.createDataFrame([("a", "1", "s"), ("b", "2", "s"), ("c", None, "t"), ("d", "1", "s")], "path string, hash string, signature string")
    assert {r.path: r.status for r in registry.difference(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "changed", "d": "new"}
    points = spark.createDataFrame([("1", "en", "x"), ("2", "fr", "y")], "point_id string, corpus_id string, text string")
    after = registry.upsert(points, spark.createDataFrame([("2", "fr", "z"), ("3", "fr", "w")], points.schema))
    registry.publish(after, str(tmp_path / "v2"))
    read = spark.read.parquet(str(tmp_path / "v2"))
    assert read.count() == 3 and read.where("corpus_id = 'fr'").count() == 2 and read.where("point_id = '2'").first().text == "z"


def test_percentile_half_even(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(4)] + [("b", None), ("b", 7.0)], "g string, v double")
    got = {r.g: (r.n, r.p50) for r in evaluate.half_even_percentile(df, ["g"], "v", [0.5]).collect()}
    assert got == {"a": (4, 2.0), "b": (1, 7.0)}


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "t string, n long")
    assert {r.t: r.seats for r in evaluate.largest_remainder(df, "t", "n", 4).collect()} == {"a": 2, "b": 1, "c": 1}


def test_references(spark):
    df = spark.createDataFrame([("See A.pdf, b.docx and a.PDF",)], "q string")
    assert df.select(routing.references(F.col("q")).alias("r")).first().r == ["a.pdf", "b.docx"]


def test_candidate_budget():
    assert [retrieval.candidate_budget(k) for k in (1, 6, 40, 200)] == [20, 24, 100, 200]


def test_dense_blocks_equal_one_block(spark, monkeypatch):
    pts = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(99, None)], "doc_id long, vector array<double>")
    asked = pts.where("doc_id < 9").withColumnRenamed("doc_id", "qid")
    whole = sorted(map(tuple, retrieval.dense(asked, pts, 5).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, retrieval.dense(asked, pts, 5).collect())) == whole and len(whole) == 45


def test_lexical_plan_drops_other_tokens_before_the_shuffle(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = retrieval.lexical(items.withColumnRenamed("item_id", "qid"), docs)
    assert got.where("rank = 1").select(F.countDistinct("qid")).first()[0] > 0
    toks = docs.select(F.explode(text.tokens(F.col("text"))).alias("token")).count()
    wanted = retrieval.term_counts(docs, wanted=items.select(F.explode(text.tokens(F.col("text"))).alias("token")))
    assert wanted.agg(F.sum("tf")).first()[0] < toks


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.counts(stream, late="400 days").writeStream.outputMode("complete").format("memory").queryName("dq_counts").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, windows.counts(events).collect()))
    assert sorted(map(tuple, spark.table("dq_counts").collect())) == want


def test_numbers_are_consecutive(spark):
    from docquarry.operators import order

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(5)
    assert [(r.v, r.number) for r in order.number(df, "v").orderBy("v").collect()] == [(i, i + 1) for i in range(1000)]


def test_perimeter_years_and_reasons(spark):
    hits = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "qid long, doc_id long")
    assert sorted(map(tuple, retrieval.in_perimeter(hits, spark.createDataFrame([(1, 2)], hits.schema)).collect())) == [(1, 2), (2, 1)]
    cards = spark.createDataFrame([(1, 1, [2020]), (1, 2, [2021]), (2, 1, [2020])], "qid long, doc_id long, card_years array<int>")
    assert sorted((r.qid, r.doc_id) for r in retrieval.narrow_by_year(cards, F.array(F.lit(2021))).collect()) == [(1, 2), (2, 1)]
    why = spark.createDataFrame([(True, 0, 0), (False, 0, 0), (True, 3, 0), (True, 3, 1)], "p boolean, c int, k int").select(retrieval.absence_reason(F.col("p"), F.col("c"), F.col("k")).alias("r"))
    assert [r.r for r in why.collect()] == ["perimeter_without_passage", "no_candidate", "no_passage_kept", None]
    pts = spark.createDataFrame([([1.0],), ([1.0, 2.0],), (None,), ([3.0],)], "vector array<double>")
    assert {r.dimension: r.n for r in retrieval.check_dimensions(pts).collect()} == {1: 2, 2: 1}


def test_targets_and_fields(spark):
    from docquarry.operators import resolve

    names = spark.createDataFrame([(1, "a.pdf"), (2, "x/b.docx"), (3, "c.txt"), (4, "c.md")], "doc_id long, name string")
    refs = spark.createDataFrame([(1, "A"), (1, "b.docx"), (2, "a.pdf"), (3, "a.pdf"), (3, "zz"), (4, "a.pdf"), (4, "c")], "qid long, reference string")
    got = {r.qid: (r.status, r.doc_ids) for r in resolve.targets(refs, names).collect()}
    assert got == {1: ("ok", [1, 2]), 2: ("too_few", None), 3: ("unknown_reference", None), 4: ("ambiguous_reference", None)}
    want = spark.createDataFrame([(1, "Total amount"), (1, "Date"), (1, "Supplier legal name"), (1, "Nothing")], "case_id long, label string")
    have = spark.createDataFrame([(1, "total_amount", 0), (1, "due date", 1), (1, "name of supplier", 2)], "case_id long, field string, pos int")
    assert {r.label: (r.field, r["pass"]) for r in resolve.match_fields(want, have).collect()} == {"Total amount": ("total_amount", 1), "Date": ("due date", 2), "Supplier legal name": ("name of supplier", 3)}


def test_percentiles_equal_sorting(spark, monkeypatch):
    """Groups beyond what is put in order at once: skewed values, ties, two values alone, nulls in values and groups; no window over a group."""
    monkeypatch.setattr(evaluate, "EXACT", 50)
    monkeypatch.setattr(evaluate, "MARKS", 20)
    rng = random.Random(12)
    make = {"wide": lambda: math.exp(rng.uniform(-600, 600)), "ties": lambda: float(rng.choice([1, 1, 1, 2, 7])), "two": lambda: float(rng.random() < 0.5), "near": lambda: 1 + rng.random() * 1e-13, None: lambda: rng.gauss(0, 1)}
    rows = [(g, rng.choice([f(), f(), f(), None])) for g, f in make.items() for _ in range(1500)] + [("small", 3.0), ("none", None)]
    qs = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = {r.g: r for r in evaluate.half_even_percentile(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v", qs).collect()}
    for g in {g for g, v in rows if v is not None}:
        have = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g].n == len(have) and [got[g][f"p{round(q * 100)}"] for q in qs] == [have[round(q * (len(have) - 1))] for q in qs], g
    assert "none" not in got


def _batches(costs, limit):
    out, used, number = [], 0, 1
    for c in costs:
        if used > 0 and used + c + 8 > limit:
            used, number = 0, number + 1
        used += c + 8
        out.append(number)
    return out


def test_batches_of_groups_of_any_size(spark, monkeypatch):
    """Large groups by pointers, small ones by the fold: the same as a plain fold; items beyond the limit, empty ones, many tiny ones."""
    monkeypatch.setattr(structure, "FOLD", 30)
    rng = random.Random(21)
    groups = {"hot": [rng.choice([0, 5, 40, 90, 700]) for _ in range(1500)], "long": [2500] * 40, "tiny": [0] * 400, "small": [50] * 20, "edge": [92] * 31, "one": [1]}
    rows = [(g, i * 3, c) for g, cs in groups.items() for i, c in enumerate(cs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, size long")
    got = {(r.g, r.i): r.batch for r in structure.batches(df, "g", "i", F.col("size"), 400).collect()}
    assert got == {(g, i * 3): b for g, cs in groups.items() for i, b in enumerate(_batches(cs, 400))}


def test_contexts_of_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(structure, "HEAD", 10)
    groups = {"hot": [7] * 500, "zero": [0] * 300 + [90, 20, 1], "large": [500, 1], "few": [40, 40, 40], "exact": [50, 50, 1]}
    df = spark.createDataFrame([(g, i, c) for g, cs in groups.items() for i, c in enumerate(cs)], "g string, i long, c long")
    got = {(r.g, r.i): (r.used, r.cut) for r in structure.context(df, "g", "i", F.col("c"), 100).collect()}
    want = {}
    for g, cs in groups.items():
        used = 0
        for i, c in enumerate(cs):
            used += c
            if used > 100 and i:
                break
            want[g, i] = (used, used > 100)
            if used > 100:
                break
    assert got == want


def test_attributes_of_events(spark):
    """Only the names of a kind leave, messages and stacks are cleaned, unknown kinds give nothing."""
    none = F.lit(None).cast("string")
    run = attributes.ingestion(F.lit("Folder"), F.lit(""), {"files_found": F.lit(3), "chunks_indexed": none}, F.lit("ingestion"), F.lit("OSError"), F.lit("no file /home/me/secret/x.txt"), F.lit('Traceback\n  File "/home/me/a/b.py", line 3'))
    request = attributes.http(F.lit("http"), F.lit("KeyError"), F.lit("Bearer abcdefghijklmnop"), none)
    answer = attributes.agent(F.lit("refused"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit("empty"), F.lit("said"))
    r = spark.range(1).select(attributes.serialized("ingestion", run).alias("i"), attributes.serialized("http", request).alias("h"), attributes.serialized("agent", answer).alias("a"), attributes.serialized("other", answer).alias("o")).first()
    i, h, a = (json.loads(x) for x in (r.i, r.h, r.a))
    assert i["files_found"] == 3 and i["chunks_indexed"] == i["files_ocr"] == 0 and "profile" not in i and i["error_code"] == "OSError" and "/home/me" not in r.i and 'File "b.py"' in i["error_stack"]
    assert set(h) <= set(attributes.HTTP) and "abcdefghijklmnop" not in r.h
    assert a == {"documents": [], "citations": [], "source_count": 0, "refusal_code": "empty"} and r.o is None
