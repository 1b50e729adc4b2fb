"""The similarity join of names against all pairs, and the resolution of batches against a plain fold in the order given."""

import math
import random

import pytest

from docquarry.operators import entities, likeness, resolve

NAMES = "field string, k string, ord long"


def _names(rng, n, letters="abcd", longest=14):
    out = []
    while len(out) < n:
        s = "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
        out.append(s)
        for _ in range(rng.randint(0, 3)):  # edited copies
            t = list(rng.choice(out))
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(t) + 1)
                t[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
            out.append("".join(t) or "a")
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("threshold", [0.88, 0.7, 0.95, 0.4])
def test_keys_lose_no_pair(threshold):
    rng = random.Random(3)
    names = _names(rng, 200, longest=24)
    short, long = {k: set(likeness.pieces(k, threshold)) for k in names}, {k: likeness.windows(k, threshold) for k in names}
    n = 0
    for a in names:
        for b in names:
            if len(a) <= len(b) and a != b and likeness.indel_ratio(a, b) >= threshold:
                n += 1
                assert short[a] & long[b], (a, b)
    assert n > 20


def test_pairs_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = [(f, k, i % 97 if f == "x" else i) for f in "xy" for i, k in enumerate(_names(rng, 150, "abc", 18))] + [("x", "", 1)] + [("x", k, -1) for k in ("abcabcabcabc", "abcabcabcab")]
    rows = list({(f, k): (f, k, o) for f, k, o in rows}.values())
    got = {(r.field, r.k, r.other): r.ratio for r in likeness.pairs(spark.createDataFrame(rows, NAMES), 0.88).collect()}
    want = {}
    for f, k, o in rows:
        for g, k2, o2 in rows:
            if f == g and k and k2 and (o, k) > (o2, k2) and (o >= 0 or o2 >= 0) and likeness.indel_ratio(k, k2) >= 0.88:
                want[f, k, k2] = likeness.indel_ratio(k, k2)
    assert got == want and want


def test_links_are_followed_to_their_ends(spark):
    chain = [("f", f"n{i}", f"n{i - 1}") for i in range(1, 40)] + [("f", "n5", "other"), ("g", "n1", "n0")]
    got = {(r.field, r.k, r.other) for r in likeness.ends(spark.createDataFrame(chain, "field string, k string, other string")).collect()}
    assert got == {("f", f"n{i}", "n0") for i in range(1, 40)} | {("f", f"n{i}", "other") for i in range(5, 40)} | {("g", "n1", "n0")}


def _cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n and len(a) == len(b) else 0.0


def _fold(batch, registry):
    """The batch in order: every earlier name attracts, whether canonical or alias; of a tie the canonical that was there first."""
    rank = {c: (-1, c) for c, _ in registry}
    known = {}
    for c, al in registry:
        for v in (c, *al):
            k = v.lower()
            known[k] = min(known.get(k, (True, c)), (v != c, c))
    seen, vecs, out = {k: c for k, (_, c) in known.items()}, {}, {}
    heads = {}
    for value, pos, vector in sorted({v: (v, p, x) for v, p, x in sorted(batch, key=lambda r: -r[1])}.values(), key=lambda r: (r[1], r[0])):
        k = value.lower()
        if k in known:
            out[value] = (known[k][1], "alias" if known[k][0] else "exact")
            continue
        if k in heads:
            out[value] = (seen[k], "exact" if heads[k] == "new" else "alias")
            continue
        close = {x: likeness.indel_ratio(k, x) for x in seen}
        top = max(close.values(), default=0)
        near = {x: _cosine(vector, w) for x, w in vecs.items()} if vector else {}
        if top >= 0.88:
            c, phase = min((seen[x] for x in close if close[x] == top), key=lambda c: rank[c]), "letters"
        elif max(near.values(), default=0) >= 0.92:
            best = max(near.values())
            c, phase = min((seen[x] for x in near if near[x] == best), key=lambda c: rank[c]), "vectors"
        else:
            c, phase = value, "new"
            rank[value] = (pos, value)
        seen[k], heads[k], out[value] = c, phase, (c, phase)
        if vector:
            vecs[k] = vector
    return out


def test_batches_equal_the_fold(spark):
    rng = random.Random(11)
    names = _names(rng, 220, "abcde", 12)
    registry = [(names[i].upper(), [names[i + 1], names[i + 2] + "x"]) for i in range(0, 30, 3)]
    registry = [(c, al) for i, (c, al) in enumerate(registry) if not {c.lower(), *al} & {x.lower() for d, bl in registry[:i] for x in (d, *bl)}]
    batch = []
    for i, n in enumerate(names[10:]):
        spelt = n.title() if rng.random() < 0.2 else n
        batch.append((spelt, i, [rng.choice([1.0, 0.97, 0.2]), rng.choice([0.0, 0.1, 1.0])] if rng.random() < 0.6 else None))
        if rng.random() < 0.1:
            batch.append((n.upper(), i, None))
    values = spark.createDataFrame([("f", *b) for b in batch], "field string, value string, pos int, vector array<double>")
    reg = spark.createDataFrame([("f", c, al, 1) for c, al in registry], entities.SCHEMA)
    got = {r.value: (r.canonical, r.phase) for r in entities.resolve_batch(values, reg).collect()}
    want = _fold(batch, registry)
    assert got == want and {p for _, p in want.values()} == {"exact", "alias", "letters", "vectors", "new"}


def test_one_field_chains(spark):
    """A value meets an alias, not only the canonical name: names chain."""
    rows = [("f", "international bank", 1), ("f", "international banks", 2), ("f", "internationals banksy", 3), ("f", "Banks", 4), ("f", "banks", 5)]
    got = {r.value: (r.canonical, round(r.ratio, 3)) for r in resolve.fuzzy_entities(spark.createDataFrame(rows, "field string, value string, pos long")).collect()}
    assert got["internationals banksy"][0] == "international bank" and got["banks"] == ("Banks", 1.0) and got["Banks"] == ("Banks", 1.0)
    assert resolve.fuzzy_entities(spark.createDataFrame([], "field string, value string, pos long")).isEmpty()


def test_no_task_holds_a_field(spark):
    df = spark.createDataFrame([("f", "a", 1)], "field string, value string, pos long")
    plan = resolve.fuzzy_entities(df)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "FlatMapCoGroups" not in plan
