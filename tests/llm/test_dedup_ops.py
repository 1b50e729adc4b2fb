"""Dedup operators against brute force, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from docquarry.llm import bagminhash, line_align, suffix_dedup, unit_dedup

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, key string, gone string, k long, score double"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "be", "gamma,", "dé.", "eps", "zz", "tion.\n", "the"]) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    shared = [prose(rng, n) for n in (30, 60, 100)]
    out = []
    for i in range(90):
        kind, t = rng.random(), prose(rng, rng.randint(0, 120))
        if kind < 0.3:
            t = t + "\n" + shared[rng.randint(0, 2)] + prose(rng, 20)
        elif kind < 0.4 and out:
            t = out[-1][1]
        elif kind < 0.5 and out and out[-1][1]:
            s = out[-1][1]
            q = rng.randint(0, len(s))
            t = s[:q] + "X" + s[q:]
        elif kind < 0.56:
            t = "ab" * rng.randint(0, 900)
        elif kind < 0.6:
            t = None
        out.append((i, t))
    out += [(5, out[5][1]), (5, "another text of the same id"), (None, shared[2]), (None, shared[2]), (300, ""), (301, " \n "), (302, shared[0] * 40)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1, 0.5) for i, t in rows], EXTRA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.mark.parametrize("length", [150, 400])
def test_suffix_dedup_equals_brute_force(docs, rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = collections.Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if counts[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = [tuple(r)[:5] for r in suffix_dedup.dedup(docs, length).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    again = suffix_dedup.dedup(docs, length, least=144).collect()
    assert sorted((tuple(r)[:5] for r in again), key=str) == sorted(want, key=str)
    # Every document with a string of ``least`` bytes that stands elsewhere is reported, and every report holds a core that stands elsewhere.
    counts = [collections.Counter(b[p : p + k] for _, b in texts for p in range(len(b) - k + 1)) for k in (144, 144 - suffix_dedup.GAP + 1)]
    sure, may = ({(i, len(b), hashlib.sha256(b).hexdigest()) for i, b in texts if any(c[b[p : p + k]] > 1 for p in range(len(b) - k + 1))} for c, k in zip(counts, (144, 144 - suffix_dedup.GAP + 1), strict=True))
    sizes = {(i, len(b)) for i, b in texts}
    told = {(r.doc_id, r.n_bytes) for r in again if r.n_shared > 0}
    assert {x[:2] for x in sure} <= told <= {x[:2] for x in may} and told <= sizes


def test_suffix_dedup_of_frequent_passages(spark):
    """One passage of 404 bytes in many surroundings, twice in some: its strings are settled within batches and across them."""
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefgh ", k=404))
    texts = ["".join(rng.choices("ijklmn ", k=rng.randint(0, 300))) + passage * (1 + (i % 7 == 0)) + "".join(rng.choices("opqrst ", k=rng.randint(0, 300))) for i in range(300)]
    got = suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), 400, texts=True).collect()
    for r in got:
        at = texts[r.doc_id].index(passage)
        (s, e), = r.spans
        assert s <= at and e >= at + 404 * (1 + (r.doc_id % 7 == 0)) and r.n_removed <= 404 * (1 + (r.doc_id % 7 == 0)) + 24  # neighbours agree by chance


def test_suffix_dedup_keeps_texts_and_spans(docs):
    for r in suffix_dedup.dedup(docs, 150, texts=True).collect():
        assert sum(e - s for s, e in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_suffix_slices_do_not_change_anchors(monkeypatch):
    t = [prose(random.Random(9), 3000).encode()]
    whole = suffix_dedup.anchors(t, 400)
    monkeypatch.setattr(suffix_dedup, "SLICE", 1777)
    cut = suffix_dedup.anchors(t, 400)
    assert {(int(x["core"]), int(x["all"])) for x in whole} == {(int(x["core"]), int(x["all"])) for x in cut}
    assert whole["n"].sum() == cut["n"].sum() == len(t[0]) - 399


@pytest.mark.parametrize("size", [50, 1777])
def test_suffix_slices_merge_runs_at_their_ends(monkeypatch, size):
    t = [prose(random.Random(9), 1500).encode(), b"ab" * 900, prose(random.Random(10), 900).encode()]
    whole = suffix_dedup.anchors(t, 400)
    monkeypatch.setattr(suffix_dedup, "SLICE", size)
    assert suffix_dedup.anchors(t, 400).tolist() == whole.tolist()


def test_suffix_dedup_of_texts_longer_than_a_slice(spark):
    """End to end over texts of several slices: only what is written twice goes."""
    rng = random.Random(4)
    letters = bytes(range(97, 123))
    long, other = (bytes(rng.choices(letters, k=k)) for k in ((4 << 20) + 5000, (2 << 20) + 3000))
    at = suffix_dedup.SLICE - 700
    texts = [long, other[:at] + long[1000:1900] + other[at:], long[50:300]]
    got = suffix_dedup.dedup(spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string"), 400, texts=True).collect()
    spans = {r.doc_id: r.spans for r in got}
    # Where the bytes around the inserted passage happen to agree, the spans are longer by as many.
    a = next(k for k in range(9) if long[999 - k] != texts[1][at - 1 - k])
    b = next(k for k in range(9) if long[1900 + k] != texts[1][at + 900 + k])
    assert spans == {0: [[1000 - a, 1900 + b]], 1: [[at - a, at + 900 + b]], 2: []}
    assert all(r.kept_sha256 == hashlib.sha256(b"".join(texts[r.doc_id][s:e] for s, e in zip([0, *(x[1] for x in r.spans)], [*(x[0] for x in r.spans), len(texts[r.doc_id])], strict=True))).hexdigest() for r in got)


def test_suffix_refuses_short_lengths(docs):
    with pytest.raises(ValueError):
        suffix_dedup.dedup(docs, 100)


def test_unit_dedup_equals_brute_force(docs, rows):
    order = sorted({(i is None, i or 0, unit_dedup._key(i, t or ""), i, t or "") for i, t in rows})
    seen, want = set(), collections.defaultdict(list)
    for _, _, _, i, t in order:
        for s, e, u in unit_dedup.units(t):
            if u in seen:
                want[i, t].append([s, e])
            seen.add(u)
    got = unit_dedup.dedup(docs, texts=True).collect()
    assert sorted(((r.doc_id, r.n_chars, r.spans) for r in got), key=str) == sorted(((i, len(t or ""), want.get((i, t or ""), [])) for i, t in rows), key=str)
    assert all(len(r.kept) == r.n_chars - r.n_removed for r in got)


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_line_and_paragraph_dedup_equal_brute_force(spark, unit):
    rng = random.Random(5)
    lines = ["One line", "one  LINE ", "", "  ", "another", "é x", "last"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "\n"]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        kept, block = [], []
        for x in [*(t or "").split("\n"), ""]:
            if unit == "line":
                block = [x]
            elif x.strip():
                block.append(x)
                continue
            key = " ".join(" ".join(block).casefold().split())
            if key and key not in seen:
                kept.append(key)
            seen.add(key)
            block = []
        want[i] = kept
    got = unit_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), unit=unit, texts=True).collect()
    for r in got:
        left = [" ".join(x.casefold().split()) for x in (r.kept.split("\n") if unit == "line" else r.kept.replace("\n  \n", "\n\n").split("\n\n"))]
        assert " ".join(" ".join(left).split()) == " ".join(want[r.doc_id])
    with pytest.raises(ValueError):
        unit_dedup.dedup(spark.createDataFrame([], "doc_id long, text string"), unit="word")


def test_units_agree_inside_other_text():
    passage = prose(random.Random(8), 120).replace("\n", " ")
    inside = {u for _, _, u in unit_dedup.units("lead in " + passage + " and out again with more words")}
    own = [u for _, _, u in unit_dedup.units(passage)]
    assert sum(u in inside for u in own) >= 0.7 * len(own)


def test_copies_and_short_lines_go_whole(spark):
    long = prose(random.Random(12), 300)
    ends = [f"One sentence of six words ends. {x}" for x in ("the tail", "the tail", "another tail")]
    texts = [long, long, "Short text", "short  text", "Part two\n" + prose(random.Random(13), 40), "Part two\n" + prose(random.Random(14), 40), *ends, "Six other words stand here first. the tail"]
    got = {r.doc_id: r for r in unit_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts=True).collect()}
    assert [got[k].kept.strip() for k in (1, 3, 7)] == ["", "", ""]
    assert got[5].spans[0] == [0, 8] and got[8].kept.strip() == "another tail"
    assert all(got[k].n_removed == 0 for k in (0, 2, 4, 6, 9))


def test_every_word_is_in_one_unit(rows):
    for _, t in rows:
        found = unit_dedup.units(t or "")
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:])) and " ".join(t[s:e] for s, e, _ in found).split() == (t or "").split()


def test_line_alignment_equals_brute_force(docs, rows):
    order = sorted({(i is None, i or 0, line_align._key(i, t), i, t) for i, t in rows}, key=lambda x: x[:3])
    seen, lead, want = set(), {}, {}
    for _, _, _, i, t in order:
        lines = [x.strip(" \t\r\v\f") for x in t.split("\n")] if t is not None else []
        links = {k for k, x in enumerate(lines) if len(line_align.WORD.findall(x)) >= line_align.LINK_WORDS}
        if tuple(lines) in seen:
            want[i, t] = list(range(len(lines))) if links else []
            continue
        seen.add(tuple(lines))
        gone = set()
        for p in {lead[lines[k]] for k in links if lines[k] in lead}:
            gone |= set(line_align.blocks(line_align.patience(list(p), lines), links))
        want[i, t] = sorted(gone)
        for k in links:
            lead.setdefault(lines[k], tuple(lines))
    got = line_align.align(docs, rare=0).collect()
    assert sorted(((r.doc_id, list(r.removed)) for r in got), key=str) == sorted(((i, want[i, t]) for i, t in rows), key=str)


def test_patience_is_increasing_and_keeps_unique_order():
    a, b = list("abcxdefyg"), list("abzcdefwg")
    m = line_align.patience(a, b)
    assert all(a[i] == b[j] for i, j in m) and m == sorted(m) and "".join(a[i] for i, _ in m) == "abcdefg"


@pytest.mark.parametrize("places", [4, 1 << 20])
def test_longest_equals_the_plain_table(monkeypatch, places):
    monkeypatch.setattr(line_align, "PLACES", places)
    rng = random.Random(6)
    for _ in range(150):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 40))] for _ in "ab")
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        m = line_align.longest(a, b)
        assert len(m) == size[-1][-1] and all(a[i] == b[j] for i, j in m)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ordered_lines_go_where_an_earlier_text_has_them(spark, seed):
    """Texts that take lines from one list in its order align in one way only: a later text loses every line that any earlier one has."""
    rng = random.Random(seed)
    pool = [f"line {i} " + " ".join(rng.choices("abcdefgh", k=8)) for i in range(60)]
    texts = [[x for x in pool if rng.random() < 0.2] for _ in range(40)]
    seen, want = set(), {}
    for i, lines in enumerate(texts):
        want[i] = [k for k, x in enumerate(lines) if x in seen]
        seen |= set(lines)
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    for rare in (0, line_align.RARE):
        assert {r.doc_id: list(r.removed) for r in line_align.align(df, rare=rare).collect()} == want


def test_operators_take_a_very_long_text(spark):
    """Three megabytes in one line next to a short text: nothing is cut, nothing fails."""
    rng = random.Random(15)
    long = " ".join(f"w{rng.randint(0, 99_999)}" for _ in range(420_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, long[:2000] + "#x"), (4, "short")], "doc_id long, text string")
    n = len(long.encode())
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(df, 400).collect()} == {1: n, 2: n, 3: 2000, 4: 0}
    assert {r.doc_id: r.kept.strip() for r in unit_dedup.dedup(df, texts=True).collect() if r.doc_id != 3} == {1: long, 2: "", 4: "short"}
    assert {r.doc_id: r.n_removed for r in line_align.align(df).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    assert {r.doc_id: r.class_id for r in bagminhash.classes(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_lines_repeated_on_either_side_are_aligned(spark):
    p = "this telling line has more than eight words in it"
    texts = [f"x\n{p}\ny\n{p}\nz", f"u\n{p}\nv", f"r\n{p}\ns\n{p}\nt"]
    got = line_align.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.removed) for r in got} == {0: [], 1: [1], 2: [1, 3]}


def test_rare_short_lines_link_and_short_copies_go(spark):
    common = ["yes", "no", ""]
    texts = ["roses are red\nyes\nviolets are blue", "a\nroses are red\nyes\nb", "one\ntwo\n", "one\ntwo\n", "", "\n", "\n"] + [f"{c}\n{i} of its own" for i in range(12) for c in common]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.removed) for r in line_align.align(df).collect()}
    assert {i: x for i, x in got.items() if x and i < 7} == {1: [1, 2], 3: [0, 1, 2]}
    # "i of its own" is held by three texts; the frequent lines before it differ and stay.
    assert all(got[7 + k] == ([1] if k % 3 else []) for k in range(36))
    assert {r.doc_id for r in line_align.strip(df).collect()} == set(range(len(texts))) - {3}


def test_rare_alignment_equals_brute_force(docs, rows):
    order = sorted({(i is None, i or 0, line_align._key(i, t), i, t) for i, t in rows}, key=lambda x: x[:3])
    split = {(i, t): tuple(x.strip(" \t\r\v\f") for x in t.split("\n")) if t is not None else () for *_, i, t in order}
    holders = collections.Counter(x for lines in set(split.values()) for x in set(lines))
    seen, lead, want = set(), {}, {}
    for *_, i, t in order:
        lines = split[i, t]
        links = {k for k, x in enumerate(lines) if x and (len(line_align.WORD.findall(x)) >= line_align.LINK_WORDS or holders[x] <= line_align.RARE)}
        if lines in seen:
            want[i, t] = list(range(len(lines))) if any(lines) else []
            continue
        seen.add(lines)
        gone = set()
        for p in {lead[lines[k]] for k in links if lines[k] in lead}:
            gone |= set(line_align.blocks(line_align.patience(list(p), list(lines)), {k for k in links if lines[k] in lead or len(line_align.WORD.findall(lines[k])) >= line_align.LINK_WORDS}))
        want[i, t] = sorted(gone)
        for k in links:
            lead.setdefault(lines[k], lines)
    got = line_align.align(docs).collect()
    assert sorted(((r.doc_id, list(r.removed)) for r in got), key=str) == sorted(((i, want[i, t]) for i, t in rows), key=str)


def test_strip_keeps_columns_and_clean_rows(docs, rows):
    out = line_align.strip(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) <= len(rows) and all(r.n_chars == len(r.text or "") for r in got)


def weighted_jaccard(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def word_shingles(t):
    """Five words in a row as tuples, counted; a shorter text is one shingle. Written apart from the operator."""
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t or "") if x]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else collections.Counter()


def test_classes_equal_brute_force(docs, rows):
    bags = [word_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if weighted_jaccard(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    want = [(d, min((x for x in g if x is not None), default=None)) for g in groups.values() for d in g]
    got = [(r.doc_id, r.class_id) for r in bagminhash.classes(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns and len({find(i) for i in range(len(rows)) if (rows[i][1] or "").split()}) == len({(r.doc_id, r.text) for r in kept.collect() if (r.text or "").split()})


def test_links_are_counted_and_repeats_go(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:30], "x", *base[31:]]
    texts = [" ".join(base), " ".join(base), " ".join(near), "alone in the world", None, ""]
    df = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[3]), (None, texts[3]), (None, texts[3]), (4, texts[4]), (4, texts[4]), (5, texts[5])], "doc_id long, text string")
    j = weighted_jaccard(word_shingles(texts[0]), word_shingles(texts[2]))
    got = sorted(((r.doc_id, r.class_id, r.n_words, r.n_links) for r in bagminhash.classes(df).collect()), key=str)
    linked = int(j >= 0.8)
    assert j >= 0.8 and got == sorted([(1, 1, 60, linked), (1, 1, 60, linked), (2, 1, 60, linked), (3, 3, 4, 0), (None, 3, 4, 0), (None, 3, 4, 0), (4, 4, 0, 0), (4, 4, 0, 0), (5, 5, 0, 0)], key=str)
    kept = collections.Counter(r.doc_id for r in bagminhash.keep_one(df).collect())
    assert kept == {1: 1, 3: 1, 4: 2, 5: 1}
    lone = spark.createDataFrame([(None, texts[3]), (None, texts[3])], "doc_id long, text string")
    assert bagminhash.keep_one(lone).count() == 1


def test_links_between_non_leaders_are_found(spark):
    """A chain: each text is similar to the next one only, so most links do not touch a band's leader."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[i * 6 : i * 6 + 100])) for i in range(30)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert {r.class_id for r in bagminhash.classes(df).collect()} == {0}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(60):
        k = np.sort(rng.integers(0, 2**63, 200).astype(np.uint64))
        a, b = rng.integers(1, 9, 200), rng.integers(1, 9, 200)
        s = bagminhash.signatures([(k, a), (k, b)])
        gaps.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.02


def test_empty_tables(nothing):
    assert suffix_dedup.dedup(nothing).count() == unit_dedup.dedup(nothing).count() == line_align.align(nothing).count() == 0
    assert line_align.strip(nothing).count() == bagminhash.classes(nothing).count() == bagminhash.keep_one(nothing).count() == 0
