"""PDF files: order of pages, object streams, fonts' codes, tables, forms, errors."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from docquarry.sources import files, pdf


def make(objects: dict[int, str | tuple[str, bytes]], root: int = 1, more: str = "") -> bytes:
    """A PDF of objects: texts, or (dictionary, bytes of a stream)."""
    out = [b"%PDF-1.4\n"]
    for n, o in objects.items():
        if isinstance(o, tuple):
            out.append(f"{n} 0 obj\n<< {o[0]} /Length {len(o[1])} >>\nstream\n".encode() + o[1] + b"\nendstream\nendobj\n")
        else:
            out.append(f"{n} 0 obj {o} endobj\n".encode())
    return b"".join([*out, f"trailer << /Root {root} 0 R {more} >>\n".encode()])


SIMPLE = {1: "<< /Type /Catalog /Pages 2 0 R >>", 7: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}


def one(content: bytes, resources: str = "/Font << /F1 7 0 R >>", **more) -> bytes:
    return make({**SIMPLE, 2: f"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << {resources} >> >>", 3: "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: ("", content), **more})


def test_pages_in_the_order_of_the_tree():
    pages = {n: f"<< /Type /Page /Contents {n + 10} 0 R >>" for n in (3, 5, 9)}
    shown = {n + 10: ("", f"BT /F1 10 Tf 50 700 Td (page {n}) Tj ET".encode()) for n in (3, 5, 9)}
    tree = {2: "<< /Type /Pages /Kids [9 0 R 6 0 R] /Resources << /Font << /F1 7 0 R >> >> >>", 6: "<< /Type /Pages /Parent 2 0 R /Kids [3 0 R 5 0 R 2 0 R] >>"}
    assert files.pdf(make({**SIMPLE, **tree, **pages, **shown})) == ["page 9", "page 3", "page 5"]


def test_written_files_come_back():
    rng = random.Random(7)
    words = ["Straße", "naïve", "données", "日本", "alpha", "(x)", "b\\c", "12,5 %"]
    pages = [[" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 6))] for _ in range(12)]
    raw = pdf.write(pages)
    assert [t for t, _ in pdf.read(raw)] == ["\n".join(p) for p in pages] and b"/Type /Page" not in raw


def test_later_objects_hold_and_broken_tables_do_not_matter():
    raw = one(b"BT /F1 10 Tf (old) Tj ET")
    new = b"4 0 obj << /Length 26 >>\nstream\nBT /F1 10 Tf (newer) Tj ET\nendstream\nendobj\nxref\n0 1\ngarbage\n"
    assert files.pdf(raw + new) == ["newer"]


def test_fonts_with_their_own_codes():
    table = ("", b"2 beginbfchar <0001> <00480065> <0002> <006C> endbfchar 1 beginbfrange <0003> <0005> [<006F> <0021> <20AC>] <0010> <0012> <0041> endbfrange")
    wide = "<< /Subtype /Type0 /Encoding /Identity-H /ToUnicode 8 0 R /DescendantFonts [<< /W [1 [900 300] 3 5 500] /DW 600 >>] >>"
    assert files.pdf(make({**SIMPLE, 7: wide, 8: table, 2: "<< /Type /Pages /Kids [3 0 R] /Resources << /Font << /F1 7 0 R >> >> >>", 3: "<< /Type /Page /Contents 4 0 R >>", 4: ("", b"BT /F1 10 Tf 12 TL 0 700 Td <00010002000200030004> Tj T* <0010001100120005> Tj ET")})) == ["Hello!\nABC€"]
    names = "<< /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /A /eacute /Udieresis /three 20 /fi /uni20AC /unknownthing] >> >>"
    assert files.pdf(make({**SIMPLE, 7: names, 2: "<< /Type /Pages /Kids [3 0 R] /Resources << /Font << /F1 7 0 R >> >> >>", 3: "<< /Type /Page /Contents 4 0 R >>", 4: ("", b"BT /F1 10 Tf 0 700 Td <01020304> Tj (x) Tj <14> Tj <15> Tj <16> Tj ET")})) == ["AéÜ3xfi€"]


def test_words_lines_and_matrices():
    content = b"q 2 0 0 2 0 0 cm BT /F1 10 Tf 1 0 0 1 20 300 Tm [(Wo) 20 (rd) -400 (next)] TJ 0 -15 Td (be\\(l\\)ow\\041) Tj ET Q BT /F1 10 Tf 14 TL 40 560 Td (later) ' (again) Tj ET BI /W 1 ID \x01(no) Tj\x02 EI BT /F1 10 Tf 10 10 Td (foot) Tj ET"
    assert files.pdf(one(content)) == ["Word next\nbe(l)ow!\nlateragain\nfoot"]
    form = {5: ("/Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 100]", b"BT /F1 10 Tf (form) Tj ET")}
    raw = make({**SIMPLE, 2: "<< /Type /Pages /Kids [3 0 R] /Resources << /Font << /F1 7 0 R >> /XObject << /X 5 0 R >> >> >>", 3: "<< /Type /Page /Contents [4 0 R 6 0 R] >>", 4: ("", b"/X Do"), 6: ("", b"BT /F1 10 Tf 0 300 Td (top) Tj ET"), **form})
    assert files.pdf(raw) == ["top\nform"]


def test_tables_are_found_and_not_said_twice():
    rows = [("Name", "Amount", "Year"), ("alpha beta", "1 200", "2020"), ("gamma", "", "2021"), ("delta", "7", "2022")]
    shown = [b"BT /F1 10 Tf 50 800 Td (A heading that stands alone) Tj ET"]
    for i, row in enumerate(rows):
        shown += [f"BT /F1 10 Tf {50 + 150 * j} {760 - 14 * i} Td ({c}) Tj ET".encode() for j, c in enumerate(row) if c]
    shown.append(b"BT /F1 10 Tf 50 600 Td (left) Tj 300 0 Td (right, once) Tj ET BT /F1 10 Tf 50 580 Td (An end.) Tj ET")
    text, tables = pdf.read(one(b"\n".join(shown)))[0]
    assert tables == [[list(r) for r in rows]]
    assert files.pdf(one(b"\n".join(shown))) == ["A heading that stands alone\nleft right, once\nAn end.\n\nName | Amount | Year\nalpha beta | 1 200 | 2020\ngamma |  | 2021\ndelta | 7 | 2022"]
    prose = b"\n".join(f"BT /F1 10 Tf 50 {700 - 12 * i} Td ({'long column of words ' * 4}) Tj 400 0 Td ({'and another one ' * 5}) Tj ET".encode() for i in range(4))
    assert pdf.read(one(prose))[0][1] == []


def test_filters_and_errors(spark):
    hexed = make({**SIMPLE, 2: "<< /Type /Pages /Kids [3 0 R] /Resources << /Font << /F1 7 0 R >> >> >>", 3: "<< /Type /Page /Contents 4 0 R >>", 4: ("/Filter [/ASCIIHexDecode /FlateDecode]", zlib.compress(b"BT /F1 10 Tf (deep) Tj ET").hex().encode() + b">")})
    assert files.pdf(hexed) == ["deep"]
    strange = hexed.replace(b"/ASCIIHexDecode", b"/DCTDecode")
    locked = make({**SIMPLE, 2: "<< /Type /Pages /Kids [] >>"}, more="/Encrypt 9 0 R")
    bomb = make({**SIMPLE, 2: "<< /Type /Pages /Kids [3 0 R] >>", 3: "<< /Type /Page /Contents 4 0 R >>", 4: ("/Filter /FlateDecode", zlib.compress(bytes(pdf.MAX_PART + 10)))})
    rows = [("a", "pdf", strange), ("b", "pdf", locked), ("c", "pdf", bomb), ("d", "pdf", b"%PDF-1.4 nothing"), ("e", "pdf", b""), ("f", "pdf", None), ("g", "pdf", hexed[:150])]
    got = {r.path: (r.page, r.error) for r in files.pages(spark.createDataFrame(rows, "path string, extension string, content binary")).collect()}
    assert got["a"] == (None, "unsupported") and got["b"] == (None, "encrypted") and got["c"] == (None, "too_large")
    assert got["d"] == got["g"] == (None, "needs_recognition") and got["e"] == got["f"] == (None, "unreadable: ValueError")
    loaded = files.load(spark.createDataFrame([(*r[:1], r[0] + ".pdf", *r[1:]) for r in rows] + [("h", "h.txt", "txt", b"x\ny")], "path string, name string, extension string, content binary"))
    assert {r.path: (r.text, r.error, r.n_chars) for r in loaded.where("path in ('b', 'h')").collect()} == {"b": (None, "encrypted", 0), "h": ("x\ny", None, 3)}
    assert loaded.where(F.col("hash") == F.sha2(F.lit(b"x\ny"), 256)).count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_damaged_files_end(seed):
    """Bytes that are changed at random give pages or an error, in time."""
    rng = random.Random(seed)
    raw = bytearray(pdf.write([["some text", "more"], ["page two"]]))
    for _ in range(60):
        bad = bytearray(raw)
        for _ in range(rng.randint(1, 12)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        files._read("pdf", bytes(bad[: rng.randint(20, len(bad))]), None)
