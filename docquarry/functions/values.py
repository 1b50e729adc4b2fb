"""Typed values from text: numbers, integers, booleans, dates. What cannot be read is null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapse, let, unaccent

# Spellings of a missing value, of true and of false, after ``comparison_key``.
NULL_WORDS = ["", "n/a", "na", "n.d.", "nd", "null", "none", "inconnu", "inconnue", "non renseigne", "non renseignee", "non disponible", "-", "--"]
TRUE_WORDS = ["1", "true", "vrai", "vraie", "oui", "yes", "y", "on"]
FALSE_WORDS = ["0", "false", "faux", "fausse", "non", "no", "n", "off"]

# Month names in French, English and Arabic, without marks.
MONTHS = {
    1: "janvier janv january jan يناير", 2: "fevrier fevr february feb فبراير", 3: "mars march mar مارس", 4: "avril avr april apr أبريل", 5: "mai may مايو", 6: "juin june jun يونيو",
    7: "juillet juil july jul يوليو", 8: "aout august aug أغسطس", 9: "septembre sept september sep سبتمبر", 10: "octobre oct october أكتوبر", 11: "novembre nov november نوفمبر", 12: "decembre dec december ديسمبر",
}


def comparison_key(c: Column) -> Column:
    """Trimmed, lower case, without marks."""
    return F.trim(unaccent(c))


def is_null_word(c: Column) -> Column:
    return c.isNull() | comparison_key(c).isin(NULL_WORDS)


def number(c: Column) -> Column:
    """The first number in a text as double, or null.

    Digits may be parted by spaces or apostrophes. Parentheses and minus signs negate. With both separators the last one is decimal. With one kind found once, three digits after it make a thousands group unless the whole part is zero; found several times, groups of one to three digits ending in three are thousands, otherwise the last is decimal.
    """
    # Each step is named once and used often, so that no step is evaluated more than once a row.
    dashes = F.translate(c, "−–—\u00a0\u202f’", "---  '")
    joined = F.regexp_replace(dashes, r"(?<=\d)[ \t']+(?=\d)", "")
    token = F.regexp_extract(joined, NUMBER_TOKEN, 0)

    def parsed(t: Column) -> Column:
        negative = t.startswith("-") | (t.startswith("(") & t.endswith(")")) | t.startswith("(-")
        digits = F.regexp_extract(t, r"\d[\d.,]*", 0)
        power = F.coalesce(F.nullif(F.regexp_extract(t, r"[eE]([+-]?\d+)", 1), F.lit("")), F.lit("0"))
        value = let(digits, lambda d: let(F.split(d, "[.,]"), lambda parts: _plain(d, parts)))
        return F.concat(F.when(negative, "-").otherwise(""), value, F.lit("e"), power).try_cast("double")

    return F.when(~is_null_word(c), let(token, lambda t: F.when(t != "", parsed(t))))


#: A number as it stands in a text: sign, opening parenthesis, digits with separators inside, exponent, closing parenthesis.
NUMBER_TOKEN = r"[+-]?(?:\(\s*)?[+-]?\s*\d+(?:[.,]\d+)*(?:[eE][+-]?\d+)?(?:\s*\))?"


def _plain(d: Column, parts: Column) -> Column:
    """Digits with a decimal point only, of digits with separators and the parts between these."""
    n, tail = F.size(parts), F.element_at(parts, -1)
    head = F.array_join(F.slice(parts, 1, n - 1), "")
    decimal = F.concat(head, F.lit("."), tail)
    both = d.contains(",") & d.contains(".")
    thousands = F.when(n == 2, ~head.rlike("^0*$")).otherwise(F.forall(F.slice(parts, 2, n - 1), lambda p: F.length(p) <= 3))
    return F.when(n == 1, d).when(~both & (F.length(tail) == 3) & thousands, F.array_join(parts, "")).otherwise(decimal)


def integer(c: Column) -> Column:
    """The number as long if it is whole, else null."""
    return let(number(c), lambda n: F.when((n == F.floor(n)) & (F.abs(n) < 9e15), n.cast("long")))


def boolean(c: Column) -> Column:
    """True or false for the words of the closed lists, else null."""
    k = comparison_key(c)
    return F.when(k.isin(TRUE_WORDS), F.lit(True)).when(k.isin(FALSE_WORDS), F.lit(False))


def _month(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for m, ws in MONTHS.items() for w in ws.split() for x in (w, m)])
    return names[c]


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def date(c: Column, day_first: bool = True, formats: tuple[str, ...] = ()) -> Column:
    """A whole date as date, or null: in one of ``formats`` (patterns of the engine), year-month-day, day and month by ``day_first``, or a month name with day and year in either order. What lacks a part is no date.

    The text is taken apart into numbers and words; their number, places and sizes decide, so that any of the usual signs may stand between them.
    """
    given = [F.try_to_date(F.trim(c), f) for f in formats]

    def read(t: Column) -> Column:
        parts = F.regexp_extract_all(F.regexp_replace(t, r"(?<=\d)(?:er|st|nd|rd|th)\b", ""), F.lit(rf"\d+|{_LETTER}+"), F.lit(0))
        return let(parts, lambda p: _from_parts(t, p, day_first))

    return F.coalesce(*given, let(unaccent(collapse(c)), read))


#: Letters of month names: Latin ones without marks, and Arabic ones.
_LETTER = "[a-z\u0621-\u064a]"


def _from_parts(t: Column, p: Column, day_first: bool) -> Column:
    a, b, c = (F.get(p, F.lit(i)) for i in range(3))
    four, short, word = (lambda x: x.rlike(r"^\d{4}$")), (lambda x: x.rlike(r"^\d{1,2}$")), (lambda x: x.rlike(rf"^{_LETTER}+$"))
    numeric = t.rlike(r"^\d+([-/.])\d+\1\d+$")
    clock = t.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}[t ]\d")  # a time of day may follow a date that starts with its year
    named = (F.size(p) == 3) & t.rlike(rf"^[\d a-z.,\u0621-\u064a]+$")
    d, m = (a, b) if day_first else (b, a)
    return (
        F.when((numeric | clock) & four(a) & short(b) & short(c), _date(a, b, c))
        .when(numeric & short(a) & short(b) & four(c), _date(c, m, d))
        .when(named & short(a) & word(b) & four(c), _date(c, _month(b), a))
        .when(named & word(a) & short(b) & four(c), _date(c, _month(a), b))
    )


def within(expected: Column, got: Column, tolerance: float = 1e-6) -> Column:
    """Relative tolerance; absolute where zero is expected."""
    return let(got, lambda g: F.abs(expected - g)) <= F.when(expected == 0, F.lit(tolerance)).otherwise(F.abs(expected) * tolerance)


def typed(c: Column, kind: str) -> Column:
    """A text column as a declared type: text, number, integer, boolean, date, or list[...] of a delimited text (distinct, in order; null if empty)."""
    one = {"text": lambda x: F.when(~is_null_word(x), collapse(x)), "number": number, "integer": integer, "boolean": boolean, "date": date}
    if not kind.startswith("list["):
        return one[kind](c)
    got = F.array_distinct(F.filter(F.transform(F.split(c, r"\s*[;|]\s*"), one[kind[5:-1]]), lambda x: x.isNotNull()))
    return F.when(F.size(got) > 0, got)


def confidence(c: Column) -> Column:
    """A number held in 0 to 1 with four decimals; 0 for what is none."""
    n = c.try_cast("double")
    return F.round(F.when(n.isNull() | F.isnan(n), 0.0).otherwise(F.least(F.greatest(n, F.lit(0.0)), F.lit(1.0))), 4)


def answers_match(expected: Column, got: Column, tolerance: float = 1e-6) -> Column:
    """Numbers agree within the tolerance if the expected answer is one; else its words stand in the answer."""
    from .text import holds_words

    numeric = comparison_key(expected).rlike(r"^[(+-]?\s*\d[\d\s.,']*\)?\s*[%€$]?$")
    return F.when(numeric, F.coalesce(within(number(expected), number(got), tolerance), F.lit(False))).otherwise(F.coalesce(holds_words(got, expected), F.lit(False)))


def decimal(c: Column, scale: int = 9) -> Column:
    """The first number in a text as an exact decimal, or null."""
    return number(c).cast("string").try_cast(f"decimal(38,{scale})")


#: A number inside a sentence: digits, groups of three parted by a space, and separators inside.
NUMBERS_IN_TEXT = r"[+-]?\d+(?:[  ']\d{3}(?!\d))*(?:[.,]\d+)*"


def answer_number(c: Column) -> Column:
    """A number as answers are compared: of two kinds of separators the last is decimal; one kind that repeats parts thousands; a single one does so only between at most three digits and exactly three."""

    def read(bare: Column) -> Column:
        body = F.regexp_replace(bare, "^[+-]", "")
        digits = F.regexp_replace(body, "[.,]", "")
        tail = F.regexp_extract(body, r"[.,](\d+)$", 1)
        head = F.substring(digits, F.lit(1), F.length(digits) - F.length(tail))
        n = F.length(body) - F.length(digits)
        grouped = (n == 1) & (F.length(tail) == 3) & (F.length(head) <= 3)
        both = body.contains(",") & body.contains(".")
        decimal_ = (tail != "") & F.when(both, True).when(n > 1, False).otherwise(~grouped)
        plain = F.when(decimal_, F.concat(head, F.lit("."), tail)).otherwise(digits)
        return F.when(bare.startswith("-"), -plain.try_cast("double")).otherwise(plain.try_cast("double"))

    return let(F.regexp_replace(c, r"[\s\u00a0\u202f']", ""), lambda b: F.when(b.rlike(r"^[+-]?\d[\d.,]*$"), read(b)))


def numbers_in(c: Column) -> Column:
    """All numbers of a text in order; citations are no numbers."""
    found = F.regexp_extract_all(F.regexp_replace(c, r"\[(?:D\d+)?S\d+\]", " "), F.lit(NUMBERS_IN_TEXT), F.lit(0))
    return F.filter(F.transform(found, answer_number), lambda x: x.isNotNull())


def typed_row(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """df with each declared column as its type, the raw text kept beside it as <name>_raw."""
    raw = {f"{n}_raw": F.col(n) for n in fields}
    return df.withColumns(raw).withColumns({n: typed(F.col(f"{n}_raw"), kind) for n, kind in fields.items()})
