"""Text and value functions on cases with known answers."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from docquarry.functions import arrays, text, values
from docquarry.operators.likeness import indel_ratio
from docquarry.sources import registry


@pytest.fixture(scope="module")
def one(spark):
    def run(c, t=None, kind="string"):
        return spark.createDataFrame([(t,)], f"t {kind}").select(c(F.col("t")).alias("r")).collect()[0].r

    return run


@pytest.mark.parametrize(
    "raw, want",
    [("4 500,00 €", 4500.0), ("4.500,00", 4500.0), ("4,500.00", 4500.0), ("(1 250,5)", -1250.5), ("0,125", 0.125), ("1,234", 1234.0), ("12,34,567", 1234567.0), ("N/A", None), ("inconnu", None), ("no digits", None), (None, None)],
)
def test_number(one, raw, want):
    assert one(values.number, raw) == want


@pytest.mark.parametrize("raw, want", [("12", 12), ("12,5", None), ("1 000", 1000), ("", None)])
def test_integer(one, raw, want):
    assert one(values.integer, raw) == want


@pytest.mark.parametrize("raw, want", [("Oui", True), (" FAUX ", False), ("maybe", None), (None, None)])
def test_boolean(one, raw, want):
    assert one(values.boolean, raw) is want


@pytest.mark.parametrize(
    "raw, want",
    [("2024-03-12", dt.date(2024, 3, 12)), ("12/03/2024", dt.date(2024, 3, 12)), ("12 mars 2024", dt.date(2024, 3, 12)), ("March 12th, 2024", dt.date(2024, 3, 12)), ("mars 2024", None), ("2024", None), ("31/02/2024", None), (None, None)],
)
def test_date(one, raw, want):
    assert one(values.date, raw) == want


def test_month_first(one):
    assert one(lambda c: values.date(c, day_first=False), "03/12/2024") == dt.date(2024, 3, 12)


@pytest.mark.parametrize("raw, want", [("1912.01214", "191201214"), ("a/b/1912.01214.pdf", "191201214"), ("X y.PDF", "xy"), ("x.unknown", "xunknown")])
def test_document_key(one, raw, want):
    assert one(text.document_key, raw) == want


def test_text_functions(one):
    assert one(text.tokens, "Hôtel Al-Safwa_2  ") == ["hotel", "al", "safwa", "2"]
    assert one(text.eval_tokens, "1 445 and 2,000") == ["1445", "and", "2000"]
    assert one(text.citations, "[S1] [S02] [S1] [S0]") == ["S1", "S2"]
    assert one(lambda c: text.keep_citations(c, F.array(F.lit("S1"))), "a [S1] b [S9] c") == "a [S1] b c"
    assert one(text.without_thinking, "<think>x\ny</think> answer") == "answer"
    assert one(text.excerpt, "x" * 400) == "x" * 317 + "..."
    assert one(text.slug, "Mon Profil É") == "mon_profil_e" and one(text.slug, "../x") is None
    assert one(text.years_in, "2020 to 1999, 2020, 3021") == [1999, 2020]
    assert one(text.useful_tokens, "dir/Annual Report Acme 2022.pdf") == ["acme"]
    assert one(text.clean_lines, " a  b \n\n c") == ["a b", "c"]
    assert one(text.strip_marks, "Éà ﬁ") == "Ea fi"
    assert one(arrays.json_object, 'noise <think>{}</think> ```{"a": {"b": 1}}``` end') == '{"a": {"b": 1}}'


def test_redaction(one):
    for raw, gone in (("password=hunter2", "hunter2"), ("Bearer abcdef12345", "abcdef12345"), ("https://u:p@h/x", "u:p"), (r"C:\a\b.txt", r"a\b")):
        assert gone not in one(text.redact, raw)
    assert one(text.redact, "commande 1912.01214 du 12/03/2024") == "commande 1912.01214 du 12/03/2024"


def test_nulls(one):
    for f in (text.tokens, text.eval_tokens, text.fingerprint, text.document_key, text.excerpt, text.redact, text.citations, text.years_in):
        assert one(f, None) is None


def test_uuid5(one):
    assert one(registry.uuid5, "doc:7") == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc:7"))
    assert one(registry.uuid5, "é") == str(uuid.uuid5(uuid.NAMESPACE_URL, "é"))


def test_signature_is_stable():
    assert registry.signature({"b": 1, "a": "é"}) == registry.signature({"a": "é", "b": 1}) != registry.signature({"a": "e", "b": 1})


def test_indel_ratio():
    assert round(indel_ratio("kitten", "sitting"), 3) == 0.615 and indel_ratio("", "") == 1.0 and indel_ratio("ab", "") == 0.0 and indel_ratio("abc", "abc") == 1.0


def test_more_text_functions(one):
    assert one(text.redact_stack, 'File "/home/me/app/x.py", line 3 password=abc').startswith('File "x.py", line 3 [SECRET]')
    assert one(text.is_request_id, "a.b-1") and not one(text.is_request_id, "a b") and not one(text.is_corpus_id, "Upper")
    assert one(lambda c: text.match_label(c, ["Annual Report", "Note"]), " annual  report ") == "Annual Report" and one(lambda c: text.match_label(c, ["Note"]), "x") is None
    assert one(lambda c: text.numbered_name(c, "q", 4, ".txt"), 7, "int") == "q0007.txt"
    assert one(lambda c: text.holds_words(c, F.lit("le chat")), "Voici LE chat.") and not one(lambda c: text.holds_words(c, F.lit("chat")), "chaton")
    assert one(lambda c: text.location(c, F.lit(3), F.lit(" ")), "a.pdf") == "a.pdf, page 3"


def test_typed_values(one):
    assert one(lambda c: values.typed(c, "list[integer]"), "1; 2 |x|1") == [1, 2] and one(lambda c: values.typed(c, "list[integer]"), "x") is None
    assert one(lambda c: values.typed(c, "text"), " a  b ") == "a b" and one(lambda c: values.typed(c, "text"), "N/A") is None
    assert [one(values.confidence, x) for x in ("0.55555", "7", "-1", "x", None)] == [0.5556, 1.0, 0.0, 0.0, 0.0]
    assert one(lambda c: values.answers_match(F.lit("1 445"), c), "about 1,445 units") and not one(lambda c: values.answers_match(F.lit("12"), c), "13")
    assert one(lambda c: values.answers_match(F.lit("Paris"), c), "in paris.") and not one(lambda c: values.answers_match(F.lit("Paris"), c), "comparison")


def test_json(one):
    assert one(arrays.list_or_scalar, '["a", " b"]') == ["a", "b"] and one(arrays.list_or_scalar, "a| |b") == ["a", "b"] and one(arrays.list_or_scalar, "x") == ["x"]
    answer = 'Sure: {"total": [{"value": " 12 ", "citations": ["S1", "S9"]}, {"value": "", "citations": ["S1"]}], "date": [{"value": "x", "citations": ["S9"]}], "other": [{"value": "y", "citations": ["S1"]}]}'
    got = one(lambda c: arrays.valid_entries(c, ["total", "date"], F.array(F.lit("S1"))), answer)
    assert [(e.field, e.value, e.citations) for e in got] == [("total", "12", ["S1"])]


def test_chunks_are_made_a_few_documents_at_once(spark):
    """A batch of a thousand texts, null and empty ones among them, leaves in slices; chunks are those of each text alone."""
    import pyarrow as pa

    from docquarry.operators import structure

    texts = [None if i % 9 == 0 else "" if i % 9 == 1 else f"# Head {i}\n\nOne line, and\nanother line {i}.\n\na | b\n1 | {i}" for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts})
    sizes = [len(x) for x in structure._slices([batch])]
    assert max(sizes) <= structure.SLICE and sum(sizes) == 1000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_index, r.kind, r.section, r.parent_id, r.place, r.text) for r in structure.chunks(df).collect())
    assert got == sorted((i, c["chunk_index"], c["kind"], c["section"], f"p1s{c['parent']}", c["place"], c["text"]) for i, t in enumerate(texts) if t for c in structure.chunks_of(t))
    assert structure.blocks(df).count() == sum(len(structure.blocks_of(t)) for t in texts if t)
