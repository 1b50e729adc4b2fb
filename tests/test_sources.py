"""Readers of all kinds of files, snapshots, stores, datasets and checks."""

import io
import json
import random
import time
import zipfile
import zlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from docquarry.sources import commits, corpora, datasets, deltas, files, registry, snapshot, uploads


def zipped(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped(**{"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>First</w:t></w:r><w:r><w:t> line</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a  b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Last</w:t></w:r></w:p></w:body></w:document>"})
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = zipped(**{
    "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {X}><si><t>name</t></si><si><r><t>ric</t></r><r><t>h</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {X}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>3.0</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c></row><row/></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": f"<worksheet {X}><sheetData/></worksheet>",
})
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
PPTX = zipped(**{f"ppt/slides/slide{i}.xml": f"<p:sld {A}><a:p><a:r><a:t>slide {i}</a:t></a:r></a:p><a:p/></p:sld>" for i in (10, 2, 1)})
CONTENT = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(W) -20 (orld) -300 <21>] TJ ET")
PDF = b"%%PDF-1.4\n1 0 obj << /Type /Pages /Kids [3 0 R] >> endobj\n3 0 obj << /Type /Page /Contents 4 0 R >> endobj\n4 0 obj << /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (len(CONTENT), CONTENT)


def test_office_files_and_pdf():
    assert files.docx(DOCX) == ["First line\nLast\na b | c"]
    assert files.xlsx(XLSX) == ["# Feuille : One\nname |  | rich\n3 | in", "# Feuille : Two"]
    assert files.pptx(PPTX) == ["slide 1", "slide 2", "slide 10"]
    assert files.pdf(PDF) == ["Hello (PDF)\nWorld !"]
    assert files.without_tables("x\nA  b\nB", [["a | B"], ["q"]]) == "x\nB" and files.reliable(["a | b", "c"]) and not files.reliable(["a | b"]) and not files.reliable(["a", "b", "c | d"])


def test_pages_of_good_and_broken_files(spark):
    rows = [("1", "docx", DOCX), ("2", "docx", b"no zip"), ("3", "pdf", b"%PDF-1.4 /Encrypt"), ("4", "pdf", PDF), ("5", "csv", b"a;b"), ("6", "txt", b" \n"), ("7", None, None), ("8", "tsv", b"x\ty\n")]
    got = {(r.path, r.page): (r.text, r.error, r.warning) for r in files.pages(spark.createDataFrame(rows, "path string, extension string, content binary")).collect()}
    assert got["1", 1][0].startswith("First") and got["2", None][1].startswith("unreadable") and got["3", None][1] == "encrypted"
    assert got["4", 1] == ("Hello (PDF)\nWorld !", None, "little_text") and got["5", 1][0] == "a;b" and got["6", None][1] == "empty" and got["7", None][1] == "unsupported" and got["8", 1][0] == "x | y"
    scan = files.pages(spark.createDataFrame([("4", "pdf", PDF)], "path string, extension string, content binary"), recognise=lambda raw, numbers: [f"page {n}" for n in numbers]).collect()
    assert [(r.page, r.text, r.warning) for r in scan] == [(1, "page 1", "recognised")]


def test_snapshots_switch_as_a_whole(spark, tmp_path):
    root = str(tmp_path / "s")
    assert snapshot.current(spark, root) is None
    snapshot.publish(spark.range(3), root)
    with pytest.raises(ValueError):
        snapshot.publish(spark.range(0), root)
    assert snapshot.read(spark, root).count() == 3 and len(snapshot.versions(spark, root)) == 1
    snapshot.publish(spark.range(5), root)
    assert snapshot.read(spark, root).count() == 5 and snapshot.tidy(spark, root) == 1
    # A writer that is second on top of the same version.
    commits.write(spark, root, 3, "v-other")
    with pytest.raises(commits.Conflict):
        commits.write(spark, root, 3, "v-late")
    commits.forget(spark, root, 3)
    broken = snapshot.Fetched(root, lambda s: s.range(1).select(F.raise_error(F.lit("no")).alias("id")))
    with pytest.raises(Exception):
        broken.snapshot(spark)
    assert snapshot.read(spark, root).count() == 5


def test_sync_of_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    (tmp_path / "c.docx").write_bytes(b"broken")
    made = snapshot.Sources().make("local", root=str(tmp_path))
    empty = spark.createDataFrame([], "path string, hash string, signature string")
    after, pages, status = snapshot.sync(spark, made, empty, {"chunk": 1}, limit=2)
    after = spark.createDataFrame(after.collect(), after.schema)
    got = {r.path.rsplit("/", 1)[1]: r.status for r in status.collect()}
    assert got == {"a.txt": "new", "b.txt": "new", "c.docx": "deferred"} and after.count() == pages.count() == 2
    (tmp_path / "a.txt").unlink()
    (tmp_path / "b.txt").write_text("three")
    after, pages, status = snapshot.sync(spark, made, after, {"chunk": 1})
    assert {r.path.rsplit("/", 1)[1]: r.status for r in status.collect()} == {"a.txt": "deleted", "b.txt": "changed", "c.docx": "failed"}
    assert [r.text for r in pages.collect()] == ["three"] and after.count() == 1
    with pytest.raises(KeyError):
        snapshot.Sources().make("nowhere")
    inv = files.inventory(files.discover(spark, str(tmp_path)), str(tmp_path)).collect()
    assert sorted(r.path for r in inv) == ["b.txt", "c.docx"]


POINT = "point_id string, doc_id long, text string"


def _points(spark, rows):
    return spark.createDataFrame(rows, POINT)


def test_deltas_equal_a_dictionary(spark, tmp_path):
    """Random changes against a plain dictionary, with compactions in between; old versions stay readable."""
    rng = random.Random(4)
    table = deltas.Deltas(str(tmp_path / "t"))
    have, old = {}, {}
    for step in range(14):
        new = [(f"p{rng.randrange(40)}", rng.randrange(12), f"t{step}-{i}") for i in range(rng.randrange(1, 9))]
        new = list({r[0]: r for r in new}.values())
        gone = [(rng.randrange(12),) for _ in range(rng.randrange(3))]
        n = table.change(_points(spark, new) if step % 5 != 3 else None, spark.createDataFrame(gone, "doc_id long") if gone or step % 5 == 3 else None)
        have = {k: v for k, v in have.items() if (v[1],) not in gone} | ({r[0]: r for r in new} if step % 5 != 3 else {})
        old[n] = dict(have)
        if step % 3 == 2:
            table.compact(spark)
        assert sorted(map(tuple, table.read(spark).collect())) == sorted(have.values()), step
    for n in list(old)[:3]:
        assert sorted(map(tuple, table.read(spark, n).collect())) == sorted(old[n].values())
    assert table.compact(spark, whole=True) and len(table.segments(spark)) == 1
    assert table.vacuum(spark) > 5 and sorted(map(tuple, table.read(spark).collect())) == sorted(have.values())


def test_deltas_write_what_they_are_given(spark, tmp_path):
    table = deltas.Deltas(str(tmp_path / "t"))
    base = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("point_id"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    assert table.create(base) and not table.create(base)
    table.upsert(base.where("doc_id < 200").withColumn("text", F.lit("new")).withColumn("more", F.lit(1)))
    first, second = table.segments(spark)
    assert second.rows == 200 and second.size < first.size / 20
    got = table.read(spark)
    assert got.count() == 20_000 and got.where("text = 'new' and more = 1").count() == 200
    plan = got._jdf.queryExecution().toString()
    assert "Window" in plan and "LeftAnti" in plan
    table.forget(spark.createDataFrame([(5,), (None,)], "doc_id long"))
    assert table.read(spark).count() == 19_999
    assert not table.change(_points(spark, []), spark.createDataFrame([], "doc_id long")) == 0 and table.read(spark).count() == 19_999


def test_files_are_skipped(spark, tmp_path):
    """Bounds on indexed fields open few files, and give the rows of a whole read; newer versions that no longer fit hide older ones."""
    table = deltas.Deltas(str(tmp_path / "t"), indexed=("year", "name", "score"))
    n = 4000
    base = spark.range(n).select(F.col("id").cast("string").alias("point_id"), (F.col("id") % 50).alias("doc_id"), (F.when(F.col("id") % 97 > 0, 1990 + F.col("id") * 7 % 30)).alias("year"), F.concat(F.chr(97 + F.col("id") * 11 % 26), F.lit("x")).alias("name"), (F.rand(3) * 100).alias("score"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        table.create(base.cache())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    segment = table.segments(spark)[0]
    every = spark.read.parquet(f"{table.root}/_stats/{segment.folder}").count()
    assert every > 20
    for within in ({"year": (1995, 1999)}, {"year": (2015, None), "name": (None, "f")}, {"name": ("cx", "cx")}, {"score": (10.0, 20.0), "year": (1990, 1994)}, {"year": (1700, 1701)}):
        got = table.read(spark, within=within)
        want = base.where(" and ".join(f"{f} >= {v[0]!r}" if v[0] is not None else f"{f} is not null" for f, v in within.items())).where(" and ".join(f"{f} <= {v[1]!r}" if v[1] is not None else "true" for f, v in within.items()))
        assert sorted(r.point_id for r in got.collect()) == sorted(r.point_id for r in want.collect())
        assert len(table.files(spark, segment, within)) <= every * (0.5 if "year" in within else 0.8), within
    assert len(table.files(spark, segment, {"year": (1700, 1701)})) == 0
    table.upsert(base.where("year = 1996").withColumn("year", F.lit(2001).cast("long")))
    assert table.read(spark, within={"year": (1996, 1996)}).isEmpty() and table.read(spark, within={"year": (2001, 2001)}).count() == base.where("year in (1996, 2001)").count()
    with pytest.raises(ValueError):
        table.read(spark, within={"doc_id": (1, 2)})
    assert table.compact(spark, whole=True) and table.read(spark, within={"year": (2001, 2001)}).count() == base.where("year in (1996, 2001)").count()
    base.unpersist()


def test_a_catalogue_knows_when_it_is_stale(spark, tmp_path):
    table = deltas.Deltas(str(tmp_path / "t"))
    made = []
    cards = deltas.Catalogue(table, lambda p: made.append(1) or p.groupBy("doc_id").agg(F.count("*").alias("n")))
    with pytest.raises(FileNotFoundError):
        cards.get(spark)
    table.create(_points(spark, [("a", 1, "x"), ("b", 1, "y")]))
    assert cards.stale(spark) and cards.get(spark).first().n == 2 and not cards.stale(spark)
    cards.get(spark)
    assert len(made) == 1
    table.upsert(_points(spark, [("c", 1, "z")]))
    assert cards.stale(spark) and cards.get(spark).first().n == 3 and len(made) == 2


def test_two_writers_of_deltas(spark, tmp_path):
    """Both changes are kept, whoever commits first; a compaction that another writer has overtaken gives up."""
    table = deltas.Deltas(str(tmp_path / "t"))
    table.create(_points(spark, [("a", 1, "x")]))
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: table.upsert(_points(spark, [(f"w{i}", i, str(i))])), range(6)))
    assert sorted(numbers) == list(range(2, 8)) and table.read(spark).count() == 7
    stale = table.segments(spark)
    assert table.compact(spark, whole=True)
    with pytest.raises(commits.Conflict):
        commits.write(spark, table.root, 2, "late")
    assert stale != table.segments(spark) and table.read(spark).count() == 7


def test_store(spark, tmp_path):
    store = corpora.Store(str(tmp_path / "store"))
    store.declare(spark, "law", "Law")
    with pytest.raises(ValueError):
        store.declare(spark, "law")
    with pytest.raises(ValueError):
        store.declare(spark, "No Id")
    store.update(spark, "law", name="Laws")
    assert {(r.corpus_id, r.name) for r in store.corpora(spark).collect()} == {("default", "default"), ("law", "Laws")}
    points = spark.createDataFrame([("1", 1, "x"), ("2", 1, "y"), ("3", 2, "z")], "point_id string, doc_id long, text string")
    assert store.info(spark, "law") == (False, 0)
    store.create(points, "law")
    store.upsert(spark.createDataFrame([("3", 2, "new"), ("4", 3, "w")], points.schema), "law")
    store.forget(spark.createDataFrame([(1,)], "doc_id long"), "law")
    assert sorted((r.point_id, r.text) for r in store.points(spark, "law").collect()) == [("3", "new"), ("4", "w")] and store.info(spark, "law") == (True, 2)
    assert corpora.count(store.points(spark, "law"), {"doc_id": 2}) == 1 and corpora.scan(store.points(spark, "law"), limit=1).count() == 1
    assert {r.page for r in corpora.paged(store.points(spark, "law"), 1).collect()} == {0, 1}
    store.delete(spark, "law")
    assert store.info(spark, "law") == (False, 0) and not store.drop(spark, "law")
    for bad in ("default", "law"):
        with pytest.raises(ValueError):
            store.delete(spark, bad)


def test_json_lines_and_gold(spark, tmp_path):
    lines = ['{"id": "1", "question": "q", "answerable": false, "extra": "x", "metadata": {"k": "v", "extra": "own"}}', "", '{"id": "2", "question": "r", "evidence_text": "e"}']
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    got = {r.id: r for r in datasets.gold(spark, str(tmp_path / "g.jsonl")).collect()}
    assert got["1"].metadata == {"k": "v", "extra": "own"} and not got["1"].answerable and got["2"].answerable
    assert [r.id for r in datasets.gold(spark, str(tmp_path / "g.jsonl"), evidence_only=True, answerable=True, limit=5).collect()] == ["2"]
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\nnot json\n')
    got = {r.line: (r.id, r.error) for r in datasets.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()}
    assert got[1] == ("1", None) and got[2][0] is None and got[2][1].startswith("line 2")
    with pytest.raises(Exception):
        datasets.gold(spark, str(tmp_path / "bad.jsonl")).collect()
    a, b = datasets.write_report({"n": 1}, spark.createDataFrame([(1, ["x"])], "i int, l array<string>"), str(tmp_path / "r"))
    assert json.loads(spark.read.text(a).first()[0]) == {"n": 1} and spark.read.option("header", "true").option("escape", '"').csv(b).first().l == '["x"]'
    datasets.write_jsonl(spark.range(2), str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w")).count() == 2
    datasets.write_trace(spark.range(2), None)
    datasets.write_trace(spark.range(2), str(tmp_path / "t"))
    names = datasets.write_corpus(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string"), str(tmp_path / "c"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    assert names.count() == spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_gold_checks(spark):
    gold = spark.createDataFrame([("1", "q", "a", "7", "in the  text", True), ("1", " ", "a", "7", "not there", True), ("3", "q", None, "9", None, True), ("4", "q", None, None, None, False)], "id string, question string, expected_answer string, expected_document string, evidence_text string, answerable boolean")
    docs = spark.createDataFrame([(7, "words in the text here")], "doc_id long, text string")
    assert {r.check: r.n for r in datasets.quality(gold, docs).collect()} == {"repeated_id": 2, "no_question": 1, "no_answer": 1, "no_evidence": 1, "missing_document": 1, "evidence_not_found": 1}
    cases = spark.createDataFrame([("a", ["1"], "x.pdf"), ("b", ["zz"], "x.pdf"), ("c", [], "y.pdf")], "case_id string, gold_ids array<string>, source_document string")
    assert {(r.case_id, r.error) for r in datasets.preconditions(cases, gold, spark.createDataFrame([("X.PDF",)], "file_name string")).collect()} == {("b", "unknown_gold"), ("c", "unknown_document")}
    linked = spark.createDataFrame([(1, 7, "linked"), (2, None, "ambiguous")], "qid long, doc_id long, reason string")
    source = spark.createDataFrame([(1, "q", "o", "t", ["e1", "e2"]), (2, "q", "o", "t", [])], "qid long, question string, output string, type string, evidence array<string>")
    got = datasets.gold_records(linked, source, spark.createDataFrame([(7, "f.txt")], "doc_id long, file_name string"), "test").collect()
    assert [(r.id, r.expected_document, r.evidence_text) for r in got] == [("1", "f.txt", "e1\ne2")]
    asked = spark.createDataFrame([("1|2",), ('["a/b.txt"]',), (None,)], "cell string")
    assert [r.documents for r in datasets.relevant(asked, "cell", "index", "doc_", ".txt", 3).collect()][0] == ["doc_001.txt", "doc_002.txt"]
    assert [r.documents for r in datasets.relevant(asked, "cell", "name").collect()][1] == ["b.txt"]


def test_settings():
    base = {"search": {"k": 6, "on": True}, "x": 1}
    assert datasets.override(base, "search.k", 9) == {"search": {"k": 9, "on": True}, "x": 1} and base["search"]["k"] == 6
    for bad in ("nope", "search.nope", "x.y"):
        with pytest.raises(KeyError):
            datasets.override(base, bad, 1)


def test_paths_and_hosts(spark):
    paths = {"": "empty", "a/b.txt": None, "/a": "absolute", "..": "parent", "a\\..\\b": "parent", "C:x": "drive", "./.": "empty", None: "empty"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.e for r in df.select("p", uploads.path_error(F.col("p")).alias("e")).collect()} == paths
    hosts = {"example.org": True, "127.0.0.1": False, "8.8.8.8": True, "::ffff:10.0.0.1": False, "fe80::1": False, "db.internal": False, "": False, "224.0.0.1": False}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: r.ok for r in df.select("h", uploads.is_public(F.col("h")).alias("ok")).collect()} == hosts


def test_large_corpora_are_written_by_many_tasks(spark, tmp_path):
    points = spark.range(4000).select(F.col("id").cast("string").alias("point_id"), F.lit("one").alias("corpus_id"))
    registry.publish(points, str(tmp_path / "p"))
    assert len(spark.read.parquet(str(tmp_path / "p")).inputFiles()) >= 1 and spark.read.parquet(str(tmp_path / "p")).count() == 4000


def test_link_with_evidence_of_several_parts(spark):
    sections = spark.createDataFrame([(1, "t", ["a", "b", "a"]), (2, "t", ["a", "c"]), (3, "t", ["a"]), (4, "u", ["a", "b"]), (5, None, ["z"]), (6, "v", None)], "doc_id long, title string, sections array<string>")
    rows = [(1, "t", ["b", "a"]), (2, "t", ["a", "b", "b"]), (3, "t", ["a"]), (4, "t", ["b", "c"]), (5, "t", []), (6, "t", None), (7, "w", ["a"]), (8, None, ["z"]), (9, "t", ["a", None]), (10, "v", ["x"]), (11, "t", ["c"])]
    got = {r.qid: (r.doc_id, r.reason) for r in datasets.link(spark.createDataFrame(rows, "qid long, title string, evidence array<string>"), sections).collect()}
    none = (None, "evidence_not_found")
    assert got == {1: (1, "linked"), 2: (1, "linked"), 3: (None, "ambiguous"), 4: none, 5: (None, "no_evidence"), 6: (None, "no_evidence"), 7: (None, "unknown_title"), 8: (None, "unknown_title"), 9: none, 10: none, 11: (2, "linked")}


def test_link_of_one_title_and_evidence(spark):
    """As pairs these would be 1.6 billion."""
    rows = spark.range(40_000).select(F.col("id").alias("qid"), F.lit("t").alias("title"), F.array(F.lit("e")).alias("evidence"))
    sections = rows.select(F.col("qid").alias("doc_id"), "title", F.array(F.lit("e"), F.col("qid").cast("string")).alias("sections"))
    began = time.time()
    assert [(r.reason, r["count"]) for r in datasets.link(rows, sections).groupBy("reason").count().collect()] == [("ambiguous", 40_000)]
    assert time.time() - began < 60
