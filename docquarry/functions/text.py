"""Text functions as column expressions. All are null in, null out unless they say otherwise.

Accents are removed from the Latin letters in ACCENTED by translate(), which stays in generated code; ``strip_marks`` does the same for every script with Unicode decomposition in a vectorised UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin letters with marks; their base letters follow by decomposition.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīńňōőřśšşťūůűźżž"
_PAIRS = {a: unicodedata.normalize("NFKD", a)[0] for a in ACCENTED}

# Words that never identify a document.
GENERIC_TOKENS = (
    "annual integrated sustainability report reports document documents doc file files statement statements financial results review group limited "
    "ltd plc inc corp corporation company holdings final draft version edition the of and for in on to at by "
    "rapport rapports annuel annuelle integre integree durabilite financier financiere resultats societe groupe entreprise fichier dossier note compte "
    "rendu finale brouillon de du des la le les un une et en pour dans sur au aux pdf docx txt md html csv xlsx pptx"
).split()

# Function words that carry no fact.
TOOL_WORDS = (
    "the a an of in on at to for and or is are was were be been it its this that these with by as from not no we they their there "
    "le la les un une des du de et ou est sont dans pour par sur au aux ce cette ces il elle ils elles que qui ne pas plus"
).split()

# Document extensions that a document key drops.
DOCUMENT_EXTENSIONS = "pdf docx doc xlsx xls csv tsv pptx ppt html htm txt md json".split()

# Patterns of secrets and paths, in the order of their use, with their replacements.
SECRETS = (
    (r"\beyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}", "[JWT]"),
    (r"://[^\s/:@]+:[^\s/:@]+@", "://[REDACTED]@"),
    (r"(?i)\b(authorization|proxy-authorization|cookie|set-cookie|x-api-key)\b\s*:\s*[^\r\n]+", "[HEADER]"),
    (r"(?i)\b(authorization|api[_-]?key|apikey|access[_-]?key|access[_-]?token|refresh[_-]?token|secret[_-]?key|client[_-]?secret|private[_-]?key|password|passwd|pwd|passphrase|token|secret|credential|credentials)\b\s*[:=]\s*[^\s,;)\]}\"']+", "[SECRET]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{6,}", "[BEARER]"),
    (r"[A-Za-z]:\\(?:[^\\\s]+\\?)+", "[PATH]"),
    (r"(^|[^\p{L}\p{N}_./])(?:/[A-Za-z0-9_.\-]+){2,}/?", "$1[PATH]"),
)


def unaccent(c: Column) -> Column:
    """Lower case without the marks of Latin letters. Plain ASCII texts skip the letter-by-letter translation."""
    low = F.lower(c)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, "".join(_PAIRS), "".join(_PAIRS.values())))


@F.pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Any script: compatibility decomposition, combining marks dropped, composed again."""
    def one(t):
        if t is None:
            return None
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    return s.map(one)


def collapse(c: Column) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Retrieval tokens: lower case, no marks, runs of a-z and 0-9."""
    return F.regexp_extract_all(unaccent(c), F.lit("[a-z0-9]+"), F.lit(0))


_PLAIN = str.maketrans(_PAIRS)
_TOKEN = re.compile("[a-z0-9]+")


def tokens_of(t: str | None) -> list[str]:
    """The same as ``tokens``, for operators that work on batches in Python."""
    return _TOKEN.findall(t.lower().translate(_PLAIN)) if t else []


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def eval_tokens(c: Column) -> Column:
    """Tokens for measurement: as ``tokens``, after thousands separators between digits are dropped."""
    return F.regexp_extract_all(F.regexp_replace(unaccent(c), r"(?<=\d)[\s ,](?=\d{3}\b)", ""), F.lit("[a-z0-9]+"), F.lit(0))


def is_hash_like(tok: Column) -> Column:
    """Eight characters or more that are all hexadecimal, or mix letters and digits."""
    return (F.length(tok) >= 8) & (tok.rlike("^[0-9a-f]+$") | (tok.rlike("[0-9]") & tok.rlike("[a-z]")))


def is_weak(tok: Column) -> Column:
    """A token that cannot identify a document: short, generic, a year, a number, or hash-like."""
    return (F.length(tok) < 3) | tok.isin(GENERIC_TOKENS) | tok.rlike("^[0-9]+$") | is_hash_like(tok)


def stem_of_path(c: Column) -> Column:
    """Last path segment without an extension of up to five characters."""
    return F.regexp_replace(basename(c), r"(?i)\.[a-z0-9]{1,5}$", "")


def basename(c: Column) -> Column:
    return F.regexp_extract(F.translate(F.trim(c), "\\", "/"), r"([^/]*)/*$", 1)


def useful_tokens(c: Column) -> Column:
    """Distinct identifying tokens of a label, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tokens(stem_of_path(c)), lambda t: ~is_weak(t))))


def years_in(c: Column) -> Column:
    """Distinct years 1900 to 2099 in a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?:19|20)\d{2}"), F.lit(0)), lambda y: y.cast("int"))))


def acronym(sorted_tokens: Column) -> Column:
    """Initials of tokens; empty for fewer than two."""
    return F.when(F.size(sorted_tokens) >= 2, F.array_join(F.transform(sorted_tokens, lambda t: F.substring(t, 1, 1)), "")).otherwise(F.lit(""))


def fingerprint(c: Column) -> Column:
    """SHA-1 of the collapsed, lower-cased text."""
    return F.sha1(F.lower(collapse(c)).cast("binary"))


def document_key(c: Column) -> Column:
    """Base name without a known extension, letters and digits only: names of one document meet, dotted identifiers stay whole."""
    return F.regexp_replace(F.regexp_replace(F.lower(basename(c)), rf"\.({'|'.join(DOCUMENT_EXTENSIONS)})$", ""), "[^a-z0-9]+", "")


def bearing_tokens(c: Column) -> Column:
    """Distinct tokens that carry facts: numbers, and words of over three letters that are no tool words."""
    return F.array_distinct(F.filter(eval_tokens(c), lambda t: t.rlike(r"^\d+$") | ((F.length(t) > 3) & ~t.isin(TOOL_WORDS))))


def ngrams(toks: Column, n: int = 3) -> Column:
    """Distinct n-grams of a token array; a shorter text is one gram."""
    grams = F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), " "))
    return F.when(F.size(toks) >= n, F.array_distinct(grams)).when(F.size(toks) > 0, F.array(F.array_join(toks, " "))).otherwise(F.array().cast("array<string>"))


def citations(c: Column) -> Column:
    """Citations [S1] in order of appearance, once each, without leading zeros."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[\s*[Ss]0*([1-9]\d*)\s*\]"), F.lit(1)), lambda n: F.concat(F.lit("S"), n)))


def keep_citations(c: Column, allowed: Column) -> Column:
    """The text without citations outside ``allowed``; runs of spaces collapse."""
    bad = F.array_except(citations(c), allowed)
    gone = F.aggregate(bad, c, lambda t, s: F.replace(t, F.concat(F.lit("["), s, F.lit("]")), F.lit("")))
    return F.trim(F.regexp_replace(gone, " {2,}", " "))


def excerpt(c: Column, most: int = 320) -> Column:
    """The collapsed text, cut to ``most`` characters with an ellipsis."""
    t = collapse(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("...")))


def without_thinking(c: Column) -> Column:
    """Model text without its <think> blocks."""
    return F.trim(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))


def redact(c: Column) -> Column:
    """Secrets and local paths replaced, in the order of SECRETS."""
    for pattern, by in SECRETS:
        c = F.regexp_replace(c, pattern, by)
    return c


def slug(c: Column) -> Column:
    """Name of a profile: no marks, spaces become underscores, 64 characters at most; null for path-like names."""
    s = F.substring(F.regexp_replace(unaccent(F.trim(c)), r"\s+", "_"), 1, 64)
    return F.when(~c.rlike(r"[/\\]|\.\.") & (F.length(s) > 0), s)


def clean_lines(c: Column) -> Column:
    """Lines with something in them, trimmed and collapsed."""
    return F.filter(F.transform(F.split(c, "\r\n|\r|\n"), collapse), lambda x: x != "")


def redact_stack(c: Column, most: int = 8000) -> Column:
    """A traceback without folders in its file names and without secrets, of at most ``most`` characters."""
    return F.substring(redact(F.regexp_replace(c, r'File "(?:[^"\r\n]*[/\\])?([^"/\\\r\n]+)"', 'File "$1"')), 1, most)


def is_request_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._-]{1,128}$")


def is_corpus_id(c: Column) -> Column:
    return c.rlike("^[a-z0-9][a-z0-9_-]{0,63}$")


def match_label(c: Column, labels: list[str]) -> Column:
    """The label of a closed list that a text equals but for case and white space, in the list's spelling; else null."""
    out = F.lit(None).cast("string")
    for x in reversed(labels):
        out = F.when(F.lower(collapse(c)) == " ".join(x.lower().split()), F.lit(x)).otherwise(out)
    return out


def numbered_name(i: Column, prefix: str, width: int, suffix: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(i.cast("string"), width, "0"), F.lit(suffix))


def holds_words(answer: Column, expected: Column) -> Column:
    """Whether the expected words stand in an answer as whole words, after normalisation."""
    plain = lambda c: F.concat(F.lit(" "), F.array_join(eval_tokens(c), " "), F.lit(" "))
    return (F.size(eval_tokens(expected)) > 0) & F.contains(plain(answer), plain(expected))


def location(label: Column, page: Column, section: Column) -> Column:
    """Where a passage stands: label, page, section, as far as known."""
    return F.concat_ws(", ", label, F.concat(F.lit("page "), page.cast("string")), F.nullif(F.trim(section), F.lit("")))


@F.pandas_udf(T.StringType())
def compatible(s: pd.Series) -> pd.Series:
    """Unicode compatibility form (NFKC); no built-in function makes it."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normal_text(c: Column, accents: bool = False, lower: bool = True, joiners: bool = True, punctuation: bool = True) -> Column:
    """Text for comparison, each step by choice: without accents and case, hyphens and underscores as spaces, punctuation as spaces; white space collapsed."""
    out = F.lower(c) if lower else c
    if not accents:
        low = F.translate(out, "".join(_PAIRS), "".join(_PAIRS.values()))
        out = low if lower else F.translate(low, "".join(_PAIRS).upper(), "".join(_PAIRS.values()).upper())
    if joiners:
        out = F.regexp_replace(out, "[-_]+", " ")
    if punctuation:
        out = F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}_\s-]", " ")
    return collapse(out)


def document_citations(c: Column) -> Column:
    """Citations [D2S1] of several documents, once each, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[(D\d+S\d+)\]"), F.lit(1)))


def split_citations(found: Column, allowed: Column) -> Column:
    """struct(valid, invalid) of citations, both in the order given."""
    return F.struct(F.filter(found, lambda x: F.array_contains(allowed, x)).alias("valid"), F.filter(found, lambda x: ~F.array_contains(allowed, x)).alias("invalid"))


def keep_document_citations(c: Column, allowed: Column) -> Column:
    """The text without [DkSj] outside ``allowed``; runs of white space collapse where something may have gone."""
    bad = F.array_except(document_citations(c), allowed)
    gone = F.aggregate(bad, c, lambda t, s: F.replace(t, F.concat(F.lit("["), s, F.lit("]")), F.lit("")))
    return F.trim(F.regexp_replace(gone, r"\s{2,}", " "))


def cited_items(items: Column, allowed: Column) -> Column:
    """Items of a list that cite something allowed, without their other citations."""
    return F.transform(F.filter(items, lambda x: F.arrays_overlap(document_citations(x), allowed)), lambda x: keep_document_citations(x, allowed))


def first_spellings(values: Column, key: Callable[[Column], Column] = unaccent) -> Column:
    """Distinct values of an array by a key, collapsed, empty ones dropped; the first spelling of each key stays."""
    clean = F.filter(F.transform(values, collapse), lambda x: x != "")
    start = F.expr("cast(named_struct('keys', array(), 'out', array()) as struct<keys:array<string>,out:array<string>>)")
    step = lambda s, x: let(key(x), lambda k: F.when(F.array_contains(s["keys"], k), s).otherwise(F.struct(F.array_append(s["keys"], k).alias("keys"), F.array_append(s["out"], x).alias("out"))))
    return F.aggregate(clean, start, step, lambda s: s["out"])


def keywords(values: Column) -> Column:
    """Keywords without repeats that differ in case, accents or white space only."""
    return first_spellings(values)


def line_print(c: Column) -> Column:
    """What tells a line of a table from another: no bars, white space collapsed, lower case."""
    return F.lower(collapse(F.replace(c, F.lit("|"), F.lit(" "))))


def title_text(c: Column) -> Column:
    """A heading without its leading signs."""
    return F.trim(F.regexp_replace(c, "^[#\\s]+", ""))


def comparable(c: Column) -> Column:
    """An answer for comparison: tokens for measurement, parted by one space."""
    return F.array_join(eval_tokens(c), " ")


def source_identity(*parts: Column) -> Column:
    """Names of a source's document in one lower-case text, parted by bars; empty parts are left out."""
    return F.lower(F.concat_ws(" | ", *(F.nullif(F.trim(p), F.lit("")) for p in parts)))
