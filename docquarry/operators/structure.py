"""Documents into lines, tables, blocks, chunks, batches and contexts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship, spread
from .order import number, running

# What starts a list item, what ends a sentence, a separator cell of a table, and separators for splitting text.
BULLET = r"^\s*(?:[-*•·–—o]|\(?\d{1,3}[.)]|[a-zA-Z][.)])\s+\S"
SENTENCE_ENDS = (".", ";", ",", "!", "?")
SEPARATOR_CELL = r"^:?-{2,}:?$"
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
CHUNK, OVERLAP, PARENT, TITLE = 1800, 250, 5000, 120
#: Documents whose pieces a task holds at once.
SLICE = 128


def cells(line: Column) -> Column:
    """Trimmed cells of a line in either style of tables: a | b and |a|b|."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(bare, r"\|", -1), lambda x: F.trim(x))


def is_tabular(line: Column) -> Column:
    """Two cells at least, one of them with something in it."""
    return line.contains("|") & (F.size(cells(line)) >= 2) & F.exists(cells(line), lambda x: x != "")


def is_separator(line: Column) -> Column:
    """A row of a table that only parts its header from its body: every cell dashes, with a colon at either end perhaps."""
    return is_tabular(line) & F.forall(F.filter(cells(line), lambda x: x != ""), lambda x: x.rlike(SEPARATOR_CELL))


def without_table_lines(text: Column, table: Column) -> Column:
    """A text without the lines that stand in one of the tables (an array of texts) too, by their print."""
    from ..functions.text import line_print

    prints = F.transform(F.flatten(F.transform(table, lambda t: F.split(t, "\n"))), line_print)
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: (line_print(x) == "") | ~F.array_contains(prints, line_print(x))), "\n")


def lines(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, pos, line): every line of every text."""
    return docs.select("doc_id", F.posexplode(F.split(F.col(column), "\r\n|\r|\n", -1)).alias("pos", "line"))


def table_runs(all_lines: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, table, row, line): runs of at least ``least`` tabular lines next to one another."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = all_lines.where(F.trim("line") != "").withColumn("n", F.row_number().over(w)).where(is_tabular(F.col("line")))
    runs = t.withColumn("island", F.col("n") - F.row_number().over(w))
    sized = runs.withColumn("size", F.count("*").over(Window.partitionBy("doc_id", "island"))).where(F.col("size") >= least)
    return sized.select(
        "doc_id", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("island")).cast("long").alias("table"), F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("pos")).cast("long").alias("row"), F.rtrim("line").alias("line"),
    )


def table_windows(runs: DataFrame, rows: int = 12, overlap: int = 2) -> DataFrame:
    """(doc_id, table, window, first_row, last_row, text): body rows in overlapping windows under the repeated header, never cut inside a row."""
    step = max(1, rows - max(0, overlap))
    head = runs.where("row = 1").select("doc_id", "table", F.col("line").alias("head"))
    body = runs.where("row > 1").withColumn("b", F.col("row") - 2)
    size = body.groupBy("doc_id", "table").agg(F.count("*").alias("n"))
    # Window i holds body rows [i * step, i * step + rows); the last one is the first to reach the end.
    last = F.greatest(F.ceil((F.col("n") - rows) / step), F.lit(0))
    spread = body.join(size, ["doc_id", "table"]).select("doc_id", "table", "b", "line", F.explode(F.filter(F.sequence(F.greatest(F.ceil((F.col("b") - rows + 1) / step), F.lit(0)), F.floor(F.col("b") / step)), lambda i: i <= last)).alias("window"))
    joined = spread.groupBy("doc_id", "table", "window").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "line"))), lambda x: x["line"]), "\n").alias("rows"))
    return joined.join(head, ["doc_id", "table"]).select("doc_id", "table", F.col("window").cast("long").alias("window"), (F.col("lo") + 2).alias("first_row"), (F.col("hi") + 2).alias("last_row"), F.concat_ws("\n", "head", "rows").alias("text"))


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``size`` characters: parts at the coarsest separator that occurs, finer ones only within parts that are too long; a piece repeats up to ``overlap`` characters of the one before."""

    def parts(t: str, level: int) -> list[str]:
        if len(t) <= size:
            return [t]
        while SEPARATORS[level] and SEPARATORS[level] not in t:
            level += 1
        sep = SEPARATORS[level]
        raw = [x + sep for x in t.split(sep)[:-1]] + [t.split(sep)[-1]] if sep else [t[i : i + size] for i in range(0, len(t), size)]
        return [y for x in raw if x for y in (parts(x, level + 1) if len(x) > size else [x])]

    out, held, n = [], [], 0
    for p in parts(text, 0):
        if held and n + len(p) > size:
            out.append("".join(held))
            while held and (n > overlap or n + len(p) > size):
                n -= len(held.pop(0))
        held.append(p)
        n += len(p)
    if held:
        out.append("".join(held))
    return [x.strip() for x in out if x.strip()]


def is_title(block: list[str]) -> bool:
    """One short line: a heading sign, or no table, bullet or end of a sentence."""
    if len(block) != 1 or not block[0].strip() or len(block[0].strip()) > TITLE:
        return False
    t = block[0].strip()
    return t.startswith("#") or not ("|" in t or re.match(BULLET, t) or t.endswith(SENTENCE_ENDS))


def is_list(block: list[str]) -> bool:
    n = len(block)
    return n >= 2 and sum(1 for x in block if re.match(BULLET, x)) >= max(2, n // 2)


def _tabular(line: str) -> bool:
    t = line.strip().removeprefix("|").removesuffix("|").split("|")
    return "|" in line and len(t) >= 2 and any(c.strip() for c in t)


def blocks_of(text: str, least_rows: int = 2) -> list[tuple[str, str | None, str]]:
    """(kind, section, text) of a page: groups between blank lines, parted into tables, lists, titles, paragraphs; a title is the section of what follows."""
    out, section = [], None
    for group in re.split(r"(?:\r?\n[ \t]*){2,}", text):
        run: list[str] = []
        runs: list[tuple[bool, list[str]]] = []
        for line in (x.rstrip() for x in group.splitlines() if x.strip()):
            t = _tabular(line)
            if not runs or runs[-1][0] != t:
                runs.append((t, run := []))
            run.append(line)
        for t, ls in runs:
            kind = "table" if t and len(ls) >= least_rows else "title" if is_title(ls) else "list" if is_list(ls) else "paragraph"
            if kind == "title":
                section = ls[0].lstrip("#").strip()
            out.append((kind, section, "\n".join(ls)))
    return out


def chunks_of(text: str, size: int = CHUNK, parent: int = PARENT) -> list[dict]:
    """Chunks of a page in order, with kind, section, parent number and place in it. Titles only lend their name, unless the page has nothing else; tables are parents of their own; a parent ends with its section or its size."""
    found = blocks_of(text)
    body = [b for b in found if b[0] != "title"] or found
    out, number, held, last, place = [], 0, 0, object(), 0
    for kind, section, t in body:
        alone = kind == "table"
        if alone or section != last or held + len(t) > parent or (out and out[-1]["kind"] == "table"):
            number, held, place = number + 1, 0, 0
        last = section
        if alone:
            rows = t.split("\n")
            pieces = ["\n".join([rows[0], *rows[1:][i : i + 12]]) for i in range(0, max(1, len(rows) - 3), 10)]
        else:
            pieces = [t] if len(t) <= size else split_text(t, size)
        for p in pieces:
            prefix = f"{section}\n" if section and kind != "title" and not p.startswith(section) else ""
            out.append({"chunk_index": len(out), "kind": kind, "section": section, "parent": number, "place": place, "text": (prefix + p).strip()})
            held, place = held + len(p), place + 1
    return out


def _slices(batches):
    """The rows of Arrow batches in small frames; a batch may hold ten thousand texts."""
    for b in batches:
        for s in range(0, b.num_rows, SLICE):
            yield b.slice(s, SLICE).to_pylist()


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema(fields)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(schema.types)], schema=schema)


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, section, text): every block of every document, in order."""
    ship(docs.sparkSession)

    def run(batches):
        for some in _slices(batches):
            rows = [(r["doc_id"], n, *x) for r in some if r["text"] for n, x in enumerate(blocks_of(r["text"]), 1)]
            yield _batch(rows, [("doc_id", pa.int64()), ("pos", pa.int64()), ("kind", pa.string()), ("section", pa.string()), ("text", pa.string())])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, pos long, kind string, section string, text string")


def recursive_chunks_of(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[dict]:
    """Chunks of a page by size alone, without kinds, sections or parents."""
    return [{"chunk_index": i, "kind": "text", "section": None, "parent": 1, "place": i, "text": p} for i, p in enumerate(split_text(text, size, overlap))]


#: Ways to cut documents into chunks.
STRATEGIES = {"structure": lambda t: chunks_of(t), "recursive": lambda t: recursive_chunks_of(t)}


def chunks(docs: DataFrame, strategy: str = "structure") -> DataFrame:
    """(doc_id, chunk_index, kind, section, parent_id, place, text): every chunk of every document; a null or empty text has none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}")
    cut_up = STRATEGIES[strategy]
    ship(docs.sparkSession)

    def run(batches):
        for some in _slices(batches):
            rows = [(r["doc_id"], c["chunk_index"], c["kind"], c["section"], f"p1s{c['parent']}", c["place"], c["text"]) for r in some if r["text"] for c in cut_up(r["text"])]
            yield _batch(rows, [("doc_id", pa.int64()), ("chunk_index", pa.int64()), ("kind", pa.string()), ("section", pa.string()), ("parent_id", pa.string()), ("place", pa.int64()), ("text", pa.string())])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, chunk_index long, kind string, section string, parent_id string, place long, text string")


#: Items of a group that one row's fold deals; larger groups are dealt by pointers. First items of a context that are looked at before a whole group is.
FOLD, HEAD = 10_000, 1000


def batches(items: DataFrame, by: str, order: str, cost: Column, limit: int = 16_000) -> DataFrame:
    """items with batch: in the order given (unique in a group), an item joins the open batch if its cost (plus 8) still fits, else it opens the next; nothing is dropped or split.

    Groups of up to FOLD items are folded in a row of numbers. Larger ones, of any size, are dealt without holding a group: each item points to the one that would open the next batch if it opened one itself, and which items do is found by following pointers, doubled in each round.
    """
    costs = items.select(F.col(by), F.col(order), (cost + 8).cast("long").alias("c"))
    sizes = costs.groupBy(by).agg(F.count("*").alias("n"))
    wide = cut(sizes.where(F.col("n") > FOLD).select(by))
    small = costs.join(sizes.where(F.col("n") <= FOLD).select(by), by, "left_semi")
    folded = _folded(small, by, order, limit)
    if not wide.isEmpty():
        folded = folded.unionByName(_pointed(costs.join(wide, by, "left_semi"), by, order, limit))
    return items.join(folded, [by, order])


def _folded(costs: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    listed = costs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "c"))).alias("xs"))
    state = "struct<batch:long,used:long,out:array<long>>"
    start = F.expr(f"cast(named_struct('batch', 1, 'used', 0, 'out', array()) as {state})")

    def step(s, x):
        new = (s["used"] > 0) & (s["used"] + x["c"] > limit)
        number = F.when(new, s["batch"] + 1).otherwise(s["batch"])
        used = F.when(new, x["c"]).otherwise(s["used"] + x["c"])
        return F.struct(number.alias("batch"), used.alias("used"), F.array_append(s["out"], number).alias("out"))

    dealt = listed.select(by, F.explode(F.arrays_zip(F.transform("xs", lambda x: x["o"]).alias("o"), F.aggregate("xs", start, step, lambda s: s["out"]).alias("batch"))).alias("r"))
    return dealt.select(by, F.col("r.o").alias(order), F.col("r.batch").alias("batch"))


def _pointed(costs: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """The same fold over groups of any size."""
    placed = number(costs, by, order, name="at")  # consecutive over all groups, so a group's items follow one another
    run = cut(running(placed, by, "at", F.col("c"), name="upto").withColumn("before", F.col("upto") - F.col("c")))
    # Where a batch that an item opens would overflow: inside the item that holds this place on the line of costs. The line is cut into stretches of the limit; every stretch knows the item that it begins in.
    stretch = F.sequence(F.floor(F.col("before") / limit), F.floor((F.col("upto") - 1) / limit))
    begins = run.select(by, F.explode(stretch).alias("stretch"), "before", "at").select(by, "stretch", F.greatest("before", F.col("stretch") * limit).alias("place"), F.lit(0).alias("kind"), "at")
    asks = run.select(by, F.floor((F.col("before") + limit) / limit).alias("stretch"), (F.col("before") + limit).alias("place"), F.lit(1).alias("kind"), "at")
    line = Window.partitionBy(by, "stretch").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = begins.unionByName(asks).withColumn("into", F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(line))
    ends = run.groupBy(by).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("upto").alias("total"))
    to = F.when(F.col("place") < F.col("total"), F.greatest("into", F.col("at") + 1))
    jumps = cut(held.where("kind = 1").join(ends, by).withColumn("to", to).where("to <= last").select("at", "to"))
    opens = cut(ends.select(F.col("first").alias("at")))
    while True:
        more = opens.join(jumps, "at").select(F.col("to").alias("at"))
        grown = cut(opens.unionByName(more).distinct())
        if grown.count() == opens.count():
            break
        opens = grown
        jumps = cut(jumps.join(jumps.select(F.col("at").alias("to"), F.col("to").alias("on")), "to").select("at", F.col("on").alias("to")))
    flagged = run.join(opens.withColumn("opens", F.lit(1)), "at", "left")
    return running(flagged.select(by, order, "at", "opens"), by, "at", F.coalesce("opens", F.lit(0)), name="batch").select(by, order, "batch")


def context(items: DataFrame, by: str, order: str, size: Column, limit: int = 16_000) -> DataFrame:
    """Items that enter a context: from the first on while their sizes fit; it stops at the first overflow. A first item that is too large alone enters cut. Adds the columns size, used and cut, in place of those of the same name. The order is unique in a group.

    Only a group's first HEAD items are looked at, which leave the others behind before the shuffle, unless all of these fit; then the whole group is."""
    w = Window.partitionBy(by).orderBy(order)
    sized = items.withColumn("size", size.cast("long"))
    head = cut(sized.withColumn("place_", F.row_number().over(w)).where(F.col("place_") <= HEAD).withColumn("used", F.sum("size").over(w)))
    open_ = head.groupBy(by).agg(F.max("place_").alias("n_"), F.max("used").alias("most_")).where((F.col("n_") == HEAD) & (F.col("most_") <= limit)).select(by)
    run = head
    if not open_.isEmpty():
        whole = sized.join(open_, by, "left_semi").withColumn("place_", F.row_number().over(w)).withColumn("used", F.sum("size").over(w))
        run = head.join(open_, by, "left_anti").unionByName(whole)
    return run.where((F.col("used") <= limit) | (F.col("place_") == 1)).withColumn("cut", F.col("used") > limit).drop("place_")
