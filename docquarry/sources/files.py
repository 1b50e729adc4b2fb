"""Readers from file trees to pages. A file that cannot be read is a row with an error, never an exception of the job.

Plain text, Markdown, HTML, JSON, delimited files, Word, spreadsheets and slides (zipped XML) and PDF files (``pdf``) are read without libraries beyond Python's own, in Arrow batches; each file in one task. Pages without text that need recognition are told from empty ones, and go through a recogniser where the caller has one.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from ..session import ship
from . import pdf as pdfs

EXTENSIONS = ("txt", "md", "html", "htm", "csv", "tsv", "json", "pdf", "docx", "xlsx", "pptx")
MAX_BYTES = 50 << 20
#: A PDF with fewer characters than this is taken for a scan; pages that a recogniser gets at once; most bytes that a zipped part may unfold to.
SCAN_CHARS, OCR_BATCH, MAX_PART = 100, 20, 256 << 20
_BLANK = re.compile(r"\s+")


def html_text(c: Column) -> Column:
    """Visible text of HTML in one line, by built-in functions: scripts, styles and comments dropped, tags become spaces, common entities decoded, white space collapsed. ``html_lines`` keeps lines and decodes every entity."""
    c = F.regexp_replace(c, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]+>", " ")
    for entity, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(by))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


class _Visible(HTMLParser):
    HIDDEN = {"script", "style", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def decoded(raw: bytes, fallback: str | None = None) -> str:
    """Text of bytes: UTF-8, else the fallback encoding, else UTF-8 with replaced bytes; a byte order mark goes."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode(fallback, "replace") if fallback else raw.decode("utf-8", "replace").removeprefix("﻿")


def html_lines(raw: bytes) -> str:
    p = _Visible()
    p.feed(decoded(raw))
    p.close()
    return "\n".join(x for x in (s.strip() for part in p.parts for s in part.splitlines()) if x)


def row_line(cells: list) -> str:
    """Cells of a table's row as one line, white space collapsed, parted by bars; empty if no cell has anything."""
    clean = [_BLANK.sub(" ", "" if c is None else str(c)).strip() for c in cells]
    return " | ".join(clean) if any(clean) else ""


def table_lines(rows) -> list[str]:
    return [x for x in map(row_line, rows) if x]


def line_print(line: str) -> str:
    return _BLANK.sub(" ", line.replace("|", " ")).strip().casefold()


def without_tables(text: str, tables: list[list[str]]) -> str:
    """A page's text without the lines that its tables hold."""
    held = {line_print(x) for t in tables for x in t}
    return "\n".join(x for x in text.split("\n") if not line_print(x) or line_print(x) not in held)


def reliable(table: list[str]) -> bool:
    """A table has two rows at least, and a separator in its first two."""
    return len(table) >= 2 and any("|" in x for x in table[:2])


def delimited(raw: bytes, separator: str) -> str:
    """A delimited file as table lines; all values are text, quotes and line ends inside cells are honoured, Latin-1 where it is not UTF-8."""
    return "\n".join(table_lines(csv.reader(io.StringIO(decoded(raw, "latin-1"), newline=""), delimiter=separator)))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if z.getinfo(name).file_size > MAX_PART:
        raise ValueError(f"{name} is too large")
    raw = z.read(name)
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(raw)


def _words(node: ElementTree.Element, text: str = "t", breaks: tuple = ("br", "cr", "tab")) -> str:
    return "".join((x.text or "") if _local(x.tag) == text else " " if _local(x.tag) in breaks else "" for x in node.iter())


def docx(raw: bytes) -> list[str]:
    """One page: paragraphs outside tables, then the rows of all tables."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(x for x in _part(z, "word/document.xml").iter() if _local(x.tag) == "body")
    inside = {id(p) for t in body.iter() if _local(t.tag) == "tbl" for p in t.iter()}
    out = [_words(p).strip() for p in body.iter() if _local(p.tag) == "p" and id(p) not in inside]
    for t in (t for t in body.iter() if _local(t.tag) == "tbl" and id(t) not in {id(x) for o in body.iter() if _local(o.tag) == "tc" for x in o.iter()}):
        rows = ([" ".join(_words(p) for p in c.iter() if _local(p.tag) == "p") for c in r if _local(c.tag) == "tc"] for r in t if _local(r.tag) == "tr")
        out += table_lines(rows)
    return ["\n".join(x for x in out if x)]


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def xlsx(raw: bytes) -> list[str]:
    """One page a sheet: its title as a heading, then its rows; values as stored, whole numbers without a decimal point."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        strings = [_words(s) for s in _part(z, "xl/sharedStrings.xml") if _local(s.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target", "") for r in _part(z, "xl/_rels/workbook.xml.rels")}
        pages = []
        for sheet in (s for s in _part(z, "xl/workbook.xml").iter() if _local(s.tag) == "sheet"):
            target = links.get(next((v for k, v in sheet.attrib.items() if _local(k) == "id"), ""), "")
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if path not in names:
                continue
            rows = []
            for r in (x for x in _part(z, path).iter() if _local(x.tag) == "row"):
                cells: list[str] = []
                for c in (x for x in r if _local(x.tag) == "c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells) + 1)
                    value = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                    kind = c.get("t", "n")
                    cells[at] = strings[int(value)] if kind == "s" and value else _words(c) if kind == "inlineStr" else value.removesuffix(".0") if kind == "n" else value
                rows.append(cells)
            # The heading is a fixed value: what it starts with must match.
            pages.append("\n".join([f"# Feuille : {sheet.get('name', '')}", *table_lines(rows)]))
    return pages


def pptx(raw: bytes) -> list[str]:
    """One page a slide, in the order of their numbers: paragraphs, one a line."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        return ["\n".join(x for x in (_words(p).strip() for p in _part(z, n).iter() if _local(p.tag) == "p") if x) for n in names]


def pdf(raw: bytes) -> list[str]:
    """Pages of a PDF: its text, without the lines that its reliable tables hold, and these tables' rows."""
    out = []
    for text, grids in pdfs.read(raw):
        held = [t for t in map(table_lines, grids) if reliable(t)]
        out.append("\n\n".join(x for x in [without_tables(text, held).strip(), *map("\n".join, held)] if x))
    return out


def pages_of(extension: str, raw: bytes) -> list[str]:
    """The pages of a file by its extension."""
    if extension in ("txt", "md", "json"):
        return [decoded(raw).strip()]
    if extension in ("html", "htm"):
        return [html_lines(raw)]
    if extension in ("csv", "tsv"):
        return [delimited(raw, "," if extension == "csv" else "\t")]
    reader = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "pdf": pdf}.get(extension)
    if reader is None:
        raise ValueError("unsupported")
    return reader(raw)


def discover(spark: SparkSession, root: str, extensions: tuple = EXTENSIONS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, name, extension, length, content): files below root with a known extension, of at most max_bytes, without lock files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = basename(F.col("path"))
    found = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), "length", "content")
    return found.where(F.col("extension").isin(*extensions) & (F.col("length") <= max_bytes) & ~F.col("name").startswith("~$"))


def inventory(files: DataFrame, root: str) -> DataFrame:
    """(path, length): paths below the root, parted by slashes, of discovered files."""
    top = root.rstrip("/") + "/"
    return files.select(F.regexp_replace("path", rf"^(?:file:)?/*{re.escape(top.lstrip('/'))}", "").alias("path"), "length")


def _read(extension: str, raw: bytes, recognise: Callable | None) -> tuple[list[str], str | None, str | None]:
    """(pages, error, warning) of a file, whatever is in it."""
    warning = None
    try:
        got = pages_of(extension, raw)
        if extension == "pdf" and sum(map(len, got)) < SCAN_CHARS:
            if recognise is None:
                return got, "needs_recognition" if not any(got) else None, "little_text"
            numbers = list(range(1, len(got) + 1))
            got = [t for s in range(0, len(numbers), OCR_BATCH) for t in recognise(raw, numbers[s : s + OCR_BATCH])]
            warning = "recognised"
    except Exception as e:  # a broken file of any kind is that file's error
        return [], str(e) if str(e) in ("unsupported", "encrypted", "too_large") else f"unreadable: {type(e).__name__}", None
    return got, None if any(t.strip() for t in got) else "empty", warning


def pages(files: DataFrame, recognise: Callable[[bytes, list[int]], list[str]] | None = None) -> DataFrame:
    """(path, page, text, error, warning) of files (path, extension, content): pages from 1, empty ones left out; a file without any is one row with page null and the error: empty, needs_recognition, unsupported, encrypted, too_large, or what failed.

    A PDF with fewer than SCAN_CHARS characters is a scan. With ``recognise`` (a file's bytes and page numbers to texts) its pages are recognised, OCR_BATCH at a time, in order; the warning says so.
    """
    ship(files.sparkSession)
    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string()), ("warning", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for path, extension, raw in zip(b.column("path").to_pylist(), b.column("extension").to_pylist(), b.column("content").to_pylist(), strict=True):
                got, error, warning = _read(extension or "", raw or b"", recognise)
                full = [(path, i, t.strip(), None, warning) for i, t in enumerate(got, 1) if t.strip()]
                rows += full or [(path, None, None, error or "empty", warning)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema)

    return files.select("path", "extension", "content").mapInArrow(run, "path string, page int, text string, error string, warning string")


def load(files: DataFrame) -> DataFrame:
    """(path, name, hash, text, n_chars, error) of discovered files: one row a file, its pages joined by blank lines. Each file is read once."""
    ship(files.sparkSession)
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("hash", pa.string()), ("text", pa.string()), ("error", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for path, name, extension, raw in zip(*(b.column(c).to_pylist() for c in ("path", "name", "extension", "content")), strict=True):
                got, error, _ = _read(extension or "", raw or b"", None)
                full = [t.strip() for t in got if t.strip()]
                rows.append((path, name, hashlib.sha256(raw or b"").hexdigest(), "\n\n".join(full) if full else None, None if full else error or "empty"))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema)

    got = files.select("path", "name", "extension", "content").mapInArrow(run, "path string, name string, hash string, text string, error string")
    return got.select("path", "name", "hash", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "error")
