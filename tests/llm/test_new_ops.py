"""Source divergence, URL filters and periodic runs: brute force, planted cases, and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docquarry.llm import divergence, periodic, url_filters

DOCS = "doc_id long, text string, lang string, source string, term string, h long, count long"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)


# -- source divergence


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = ["Alpha", "beta", "Été", "ÉTÉ", "x1y", "naïve", "日本", "a'b", "Z"]
    out = []
    for i in range(240):
        s = rng.choice(["hot"] * 6 + ["s1", "s2", "s10", "é", None])
        own = [f"own{s}{rng.randint(0, 5)}", f"rare{rng.randint(0, 90)}"]
        out.append((i, " ".join(rng.choice(words + own) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", None]), s))
    return [*out, out[5], out[5], (None, "Alpha beta", "en", "s1"), (900, None, "en", "empty"), (901, "1 2 3", "xx", "alone"), (902, "", "yy", "a"), (903, "once", "yy", "b"), (904, "beta " * 4000, "de", "long")]


def _audit(rows, least=3, top=200):
    """The contract in plain loops over whole numbers."""
    docs = collections.defaultdict(lambda: collections.Counter())
    count = collections.defaultdict(collections.Counter)
    groups = set()
    for _, t, lang, s in rows:
        lang, s = lang or "", s or ""
        groups.add((lang, s))
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        count[lang, s].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        whole = shares(sum((count[lang, s] for s in sources), collections.Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]}
            parts["term"] = [(t, f(p[s][t], whole[t])) for t in kept if count[lang, s][t] > 0 and p[s][t] > whole[t]]
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out)


def _rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_audit_equals_brute_force(spark, rows):
    assert _rows(divergence.audit(_docs(spark, rows).repartition(5))) == _audit(rows)
    assert _rows(divergence.audit(_docs(spark, rows), least=10, top=2)) == _audit(rows, 10, 2)


def test_audit_with_partial_runs_and_full_tables(spark, rows, monkeypatch):
    """Salted first runs, tasks that send what they hold early, no matrix, small steps: the same result."""
    monkeypatch.setattr(divergence, "salts_of", lambda docs: 3)
    monkeypatch.setattr(divergence, "FULL", 200)
    monkeypatch.setattr(divergence.Partials, "SIDE", 1)
    monkeypatch.setattr(divergence.Partials, "FULL", 300)
    monkeypatch.setattr(divergence.Partials, "STEP", 4)
    assert _rows(divergence.audit(_docs(spark, rows).repartition(4))) == _audit(rows)


def test_audit_of_an_empty_table_and_too_many_groups(spark, rows, monkeypatch):
    assert divergence.audit(_docs(spark, [])).isEmpty()
    monkeypatch.setattr(divergence, "MAX_GROUPS", 3)
    with pytest.raises(ValueError):
        divergence.audit(_docs(spark, rows))


def test_shares_of_huge_counts():
    c, n = np.array([9 * 10**12, 5, 10**17]), np.array([10**13, 10**13, 2 * 10**17])
    assert divergence.share(c, n).tolist() == [1 + 10**9 * (int(x) + 1) // int(y) for x, y in zip(c, n, strict=True)]


def test_one_term_in_every_document_is_split(spark, monkeypatch):
    """Partial runs leave few rows of a frequent term and source, however many tasks there are."""
    docs = _docs(spark, [(i, "same word", "en", "s") for i in range(400)]).repartition(40)
    assert divergence.runs(docs).where("term = 'same'").count() == 1
    assert divergence._counted(docs).where("term = 'same'").count() == 40


# -- URL filters

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def _judge(rows, limit=0.25, z=1.645, rules=RULES):
    """The verdicts in plain loops: rules by longest fit, else the posterior bound of the host."""
    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u[u.index("://") + 3 :]
        host = re.match("[^/?#]*", rest)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host) :])[0]

    def levels(host):
        h = re.sub(r"(:[0-9]*)?\.?\Z", "", re.sub(r"^.*@", "", host), count=1)
        if re.fullmatch(r"[0-9.]*", h) or ":" in h:
            return h, ""
        parts = h.split(".")
        n = 2 if ".".join(parts[-2:]) in url_filters.SUFFIXES else 1
        return ".".join(parts[-n - 1 :]), ".".join(parts[-n:])

    n, k = collections.Counter(), collections.Counter()
    for _, u, bad in rows:
        h = split(u)[0]
        n[h] += bad is not None
        k[h] += bool(bad)
    known = {split(u)[0] for _, u, _ in rows}

    def level(key):
        return {x: (sum(n[h] for h in known if key(h) == x), sum(k[h] for h in known if key(h) == x)) for x in {key(h) for h in known}}

    def shrink(groups, parent):
        a = b = 0.0
        for x, (m, bad) in groups.items():
            v = parent[x] * (1 - parent[x])
            if m:
                a, b = a + m * (bad / m - parent[x]) ** 2 - v, b + (m - 1) * v
        s = round(1 / min(max(a / b if b else 0.5, 0.001), 0.5) - 1, 6)
        return {x: (bad + s * parent[x]) / (m + s) for x, (m, bad) in groups.items()}, s

    root = (sum(k.values()) + 1) / (sum(n.values()) + 2)
    suffix, _ = shrink(g := level(lambda h: levels(h)[1]), dict.fromkeys(g, root)) if known else ({}, 0)
    domain, _ = shrink(g := level(levels), {x: suffix[x[1]] for x in g}) if known else ({}, 0)
    host, s = shrink(g := level(lambda h: h), {x: domain[levels(x)] for x in g}) if known else ({}, 0)
    out = []
    for i, u, _ in rows:
        h, path = split(u)
        fits = [(len(r), v, r) for r, v in rules if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        best = max(fits, default=None)
        m = host[h]
        own = "block" if m - z * (m * (1 - m) / (n[h] + s + 1)) ** 0.5 > limit else "allow"
        out.append((i, h, path, best[2] if best else None, best[1] if best else own))
    return sorted(out, key=str)


PAGES = "page_id long, url string, bad boolean, host string, n long, path string"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)


def _rules(spark, rules=RULES):
    return spark.createDataFrame(rules, "rule string, verdict string")


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(9)
    hosts = {f"{a}.site{i}.{s}": rng.choice([0.02, 0.1, 0.6, 0.95]) for i in range(12) for s in ("net", "com", "co.uk", "example.org") for a in ("www", "m", "blog")}
    rows = []
    for i in range(1500):
        h = rng.choice(list(hosts)) if rng.random() > 0.33 else "www.site0.net"
        rows.append((i, f"http{rng.choice(['', 's'])}://{h}/{rng.choice(['en', 'fr', 'de', 'es', ''])}/{rng.randint(1, 30)}{rng.choice(['', '?q=a://b', '#x', '/'])}", rng.random() < hosts[h] if rng.random() < 0.6 else None))
    odd = ["http://EXAMPLE.org/es/1", "http://example.org/en/12", "http://notexample.org/es/1", "http://a.example.org", "http://example.org?x=/", "x://com/fr/", "no scheme", "", None, "://", "ftp://u@h.co.uk:21/x", "http://127.0.0.1/a", "http://[::1]:80/a", "http://a.b.net./de/", "http://é.COM/de/1\nx", "a b://c d/ e", "http://com.de/fr/", "http://org"]
    return [*rows, rows[3], rows[3], *((2000 + i, u, None) for i, u in enumerate(odd)), (None, "http://bad.net/", True)]


def test_verdicts_equal_brute_force(spark, pages):
    for limit in (0.25, 0.05, 0.6):
        got = url_filters.judge(_pages(spark, pages).repartition(3), _rules(spark), limit)
        found = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str)
        assert found == _judge(pages, limit)
    verdicts = collections.Counter(r[4] for r in found if r[3] is None)
    assert verdicts["block"] > 20 and verdicts["allow"] > 200


def test_few_outcomes_do_not_block_a_clean_domain(spark):
    """One bad page moves a new host of a clean domain little; many bad pages of a host block it, and it alone."""
    rows = [(i, f"http://a{i % 9}.clean.net/{i}", i % 50 == 0) for i in range(900)] + [(1000, "http://new.clean.net/1", True)] + [(2000 + i, f"http://spam.clean.net/{i}", i % 10 > 0) for i in range(80)]
    got = {r.host: r.verdict for r in url_filters.judge(_pages(spark, rows), _rules(spark), 0.5).collect()}
    assert got["spam.clean.net"] == "block" and got["new.clean.net"] == "allow" and all(got[f"a{i}.clean.net"] == "allow" for i in range(9))


def test_rules_of_one_host_and_ties(spark):
    rules = [("a.net/x", "allow"), ("a.net/x", "block"), ("net", "block"), ("a.net/", "allow")]
    rows = [(1, "http://b.a.net/xyz", None), (2, "http://a.net/y", None), (3, "http://a.net", None), (4, "http://c.net/x", None), (5, "http://n.org/", None)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(_pages(spark, rows), _rules(spark, rules), 0.9).collect()}
    assert got == {1: ("a.net/x", "block"), 2: ("a.net/", "allow"), 3: ("net", "block"), 4: ("net", "block"), 5: (None, "allow")}


def test_filters_of_an_empty_table_and_without_outcomes(spark, pages):
    assert url_filters.judge(_pages(spark, []), _rules(spark)).isEmpty()
    blank = [(i, u, None) for i, u, _ in pages]
    got = url_filters.judge(_pages(spark, blank), _rules(spark, []), 0.5).collect()
    assert len(got) == len(blank) and {(r.rule, r.verdict) for r in got} == {(None, "allow")}


def test_main_path_is_native(spark, pages):
    plan = url_filters.judge(_pages(spark, pages), _rules(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- periodic runs


def _brute(words, exponent=4, least=6):
    """Every maximal stretch of every period, with its smallest period alone."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - s + q
            if size >= max(least, exponent * q) and not any(all(words[s + j] == words[s + j + d] for j in range(size - d)) for d in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent, least", [(4, 6), (3, 3), (2, 2), (4, 9), (2, 7), (5, 5)])
def test_runs_equal_brute_force(exponent, least):
    rng, n = random.Random(exponent * 10 + least), 0
    for _ in range(700):
        k = rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
        if w and rng.random() < 0.5:
            a, p = rng.randrange(len(w)), 1 + rng.randrange(9)
            w = w[:a] + (w[a : a + p] * len(w))[: len(w) - a]
        want = _brute(w, exponent, least)
        n += len(want)
        assert periodic.runs_of(w, exponent, least) == want
        first, end = periodic.stretches(np.array(w, np.int64), np.array([len(w)]), exponent, least)
        inside = [(s + f, size, q) for f, e in zip(first.tolist(), end.tolist(), strict=True) for s, size, q in periodic.runs_of(w[f:e], exponent, least)]
        assert sorted(inside, key=lambda r: (r[0], r[2])) == want
    assert n > 100


def test_ordered_sets_stay_ordered(monkeypatch):
    monkeypatch.setattr(periodic.Ordered, "LOAD", 8)
    rng = random.Random(1)
    values = rng.sample(range(10_000), 700)
    held = periodic.Ordered(values[0])
    for v in values[1:]:
        held.add(v)
    order = sorted(values)
    assert list(held) == order and len(held) == 700
    for i, v in enumerate(order):
        assert held.around(v) == (order[i - 1] if i else None, order[i + 1] if i + 1 < 700 else None)


def _digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = _brute(words)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest())


def test_digests_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        unit = [f"w{rng.randint(0, 3)}" for _ in range(rng.randint(1, 12))]
        parts = [" ".join(f"v{rng.randint(0, 60)}" for _ in range(rng.randint(0, 30))), " ".join(unit * rng.randint(1, 9)), "\n".join(["the same line"] * rng.randint(0, 5)), "é\u00a0x " * rng.randint(0, 8)]
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "\n\t", "\x0b"]).join(parts), "en", "s"))
    rows += [rows[1], rows[1], (None, "a b " * 9, "en", "s"), (None, None, None, None), (900, "", "en", "s"), (901, None, "en", "s"), (902, " \n\t", "en", "s"), (903, "x y z " * 3000, "en", "s")]
    got = periodic.digests(_docs(spark, rows).repartition(3), rewrite=periodic.plant)
    fields = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[f] for f in fields) for r in got.collect()), key=str) == sorted((_digest(r[0], r[1]) for r in rows), key=str)


def test_runs_are_told_and_collapsed(spark):
    rows = [(1, "begin " + "one two three " * 5 + "one end end end end end end", "en", "s"), (2, "nothing here", "en", "s"), (3, None, "en", "s")]
    got = {r.doc_id: r for r in periodic.runs(_docs(spark, rows)).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 16, 3), (17, 6, 1)] and got[1].collapsed == "begin one two three end" and got[1].n_words == 23
    assert got[2].runs == [] and got[2].collapsed == "nothing here" and got[3].runs == [] and got[3].collapsed == ""
    assert periodic.runs(_docs(spark, [])).isEmpty() and periodic.digests(_docs(spark, [])).isEmpty()
    with pytest.raises(ValueError):
        periodic.runs(_docs(spark, rows), exponent=1)


def test_very_long_periodic_text():
    """Work and memory stay in proportion: a text of one short period, and one of a long period."""
    w = [0, 1, 2] * 40_000
    assert periodic.runs_of(w) == [(0, 120_000, 3)]
    rng = random.Random(3)
    unit = [rng.randrange(1000) for _ in range(20_000)]
    assert periodic.runs_of(unit * 5 + unit[:7]) == [(0, 100_007, 20_000)]
