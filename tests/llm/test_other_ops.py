"""Mixing, rules, classifiers, search and BPE: brute force, held-out accuracy, round trips, and odd rows."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docquarry.llm import bpe, mixing, mtree, quality_fm, quality_rules, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, failed long, score double, k long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(i, " ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 80))), "en", rng.choice(["a", "a", "a", "é", "b", "𝄞"])) for i in range(200)]
    return [*out, out[3], out[3], (7, "same id", "en", "b"), (None, None, None, None), (900, "", "de", None), (901, "x " * 5000, "de", "hot")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 0.5, 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_targets_share_the_excess():
    t = mixing.targets({"a": 10, "b": 100, "c": 100, None: 0})
    assert t["a"] == 20 and t[None] == 0 and abs(sum(t.values()) - 315) < 1e-9
    assert mixing.targets({}) == {} and sum(mixing.targets({"a": 0}).values()) == 0


def test_mix_meets_targets(docs, rows):
    got = mixing.mix(docs, block=16).collect()
    assert len(got) == len(rows)
    sizes = collections.defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = mixing.targets(sizes)
    by_size = {s: w for s, w in sizes.items()}
    taken = collections.defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[round(r.target, 6), r.source_size] += r.taken
    for s, w in want.items():
        twins = [x for x in want if round(want[x], 6) == round(w, 6) and by_size[x] == by_size[s]]
        assert abs(taken[round(w, 6), by_size[s]] - len(twins) * w) <= len(twins)
    again = mixing.mix(docs, block=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_interleaves_and_covers_each_word_once_a_pass(docs):
    s = mixing.schedule(docs, block=16).toPandas()
    assert (s.to_word > s.from_word).all() and not s.duplicated(["slot", "doc_id", "k", "pass", "from_word"]).any()
    early = s[s.slot < s.slot.max() // 4].src.value_counts(normalize=True)
    assert (early - s.src.value_counts(normalize=True)).abs().max() < 0.12


def test_mix_equals_brute_force(spark, docs, rows):
    """The schedule made anew in plain loops: streams of both passes, golden-ratio points, ranks, blocks."""
    block, golden = 16, 0x9E3779B97F4A7C15
    base = mixing._sizes(docs).select("*", F.xxhash64(F.lit(11), "k").alias("h0"), F.xxhash64(F.lit(23), "k").alias("h1")).collect()
    names = sorted({r.source for r in base if r.source is not None}) + [None]
    sizes = {s: sum(r["size"] for r in base if r.source == s) for s in names}
    want = mixing.targets(sizes)
    quota = {s: min(int(want[s] + 0.5), 2 * sizes[s]) for s in names}
    need = [-(-quota[s] // block) for s in names]
    edges = [min(int(sum(map(float, need[: i + 1])) / sum(need) * 2.0**64), 2**64 - 1) for i in range(len(need) - 1)]
    ranked = collections.defaultdict(list)
    for i in range(sum(need)):
        point = (i + 1) * golden % 2**64
        ranked[sum(point >= e for e in edges)].append(i)
    parts = []
    for n, s in enumerate(names):
        at = 0
        for p, h in enumerate(("h0", "h1")):
            # Spark cuts streams by the leading bits of the hash as an unsigned number, then orders by it as a signed one.
            own = sorted((r for r in base if r.source == s), key=lambda r: ((r[h] % 2**64) >> 64 - mixing.LEAST_BITS, r[h], str(r.doc_id), r.k))  # noqa: B023
            for r in own:
                end = min(at + r["size"], quota[s])
                while at < end:
                    rank = at // block
                    stop = min((rank + 1) * block, end)
                    parts.append((ranked[n][rank] if rank < len(ranked[n]) else rank + sum(need), n, rank, r.doc_id, p, stop - at))
                    at = stop
                at = max(at, end)
    got = [(r.slot, r.src, r["rank"], r.doc_id, r["pass"], r.to_word - r.from_word) for r in mixing.schedule(docs, block=block).collect()]
    assert sorted(got, key=str) == sorted(parts, key=str)


def test_resample_meets_targets_to_half_a_document(docs, rows):
    got, sizes = collections.Counter(), collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    for r in mixing.resample(docs, block=16).collect():
        got[r.source] += len(r.text.split())
    for s, want in mixing.targets(dict(sizes)).items():
        longest = max(len((t or "").split()) for _, t, _, x in rows if x == s)
        assert abs(got[s] - want) <= longest / 2 + 1


def test_scores_take_a_very_long_text(spark):
    long = " ".join(f"w{i % 7919}" for i in range(300_000))
    df = spark.createDataFrame([(1, long), (2, "short text")], "doc_id int, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_words for r in quality_rules.ledger(df).collect()} == {1: 300_000, 2: 2}
    assert quality_fm.score(df, quality_fm.train(df, none)).count() == toxicity.score(df, toxicity.train(df, none)).count() == 2
    with_source = df.withColumn("source", F.lit("s"))
    assert sum(r.taken for r in mixing.mix(with_source).collect()) == round(1.5 * 300_002)


def test_resample_keeps_columns(docs, nothing):
    out = mixing.resample(docs, block=16)
    assert out.columns == docs.columns and out.where("text is null or text = ''").count() == 0
    assert mixing.mix(nothing).count() == mixing.schedule(nothing).count() == mixing.resample(nothing).count() == 0


def test_rules_by_hand(spark, docs, nothing):
    text = "a b c a b c\nx # y\nx # y\n\n \n"
    got = dict(zip(quality_rules.MEASURES, [int(x[0]) for x in quality_rules.measure([text])], strict=True))
    assert got == {"n_words": 12, "word_chars": 12, "n_symbols": 2, "n_dup_lines": 1, "n_repeat_words": 12, "n_upper_words": 0, "n_lines": 3, "n_bare_words": 2}
    led = quality_rules.apply_policy(quality_rules.ledger(docs), "full-1")
    assert led.count() == docs.count() and led.where("n_words < 50 and kept").count() == 0
    table = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablation(led, "full-1").collect()}
    assert table["few_words"][0] == led.where("n_words < 50").count() and table["few_words"][1] == led.where("failed = 1").count()
    assert quality_rules.ledger(nothing).count() == 0


def _accuracy(rows, label, held):
    y = rows[label].to_numpy()
    p = rows["predicted"].to_numpy()
    mask = np.array([zlib.crc32(str(i).encode()) % held[0] == held[1] for i in rows.doc_id])
    assert (mask == rows.held_out.to_numpy()).all()
    return (y[mask] == p[mask]).mean()


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fm = quality_fm.score(docs, quality_fm.train(docs, labels)).join(labels, "doc_id").toPandas()
    assert _accuracy(fm, "quality", (5, 0)) > 0.9 and fm.score.between(0, 1).all()
    cnn = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").toPandas()
    assert _accuracy(cnn, "toxic", (4, 2)) > 0.85 and cnn.score.between(0, 1).all()


def test_classifiers_without_labels_and_with_odd_rows(spark, docs, nothing):
    none = spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for op in (quality_fm, toxicity):
        model = op.train(docs, none)
        got = op.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert op.score(nothing, model).count() == 0
    assert toxicity.keep(docs, model, 2.0).columns == docs.columns
    assert toxicity.keep(docs, model, 2.0).count() == docs.count()


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Model(0.3, rng.normal(size=quality_fm.SIZE), rng.normal(size=(quality_fm.SIZE, 3)))
    ids, x = np.array([1, 5, 9, 40]), rng.normal(size=4)
    slow = 0.3 + sum(m.w[i] * a for i, a in zip(ids, x, strict=True)) + sum(m.v[ids[a]] @ m.v[ids[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert abs(quality_fm.raw(m, ids, x, np.array([4]))[0][0] - slow) < 1e-9


def test_machine_learns_interactions():
    """Labels that only a pair of features decides: no linear model can tell them."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2, 400), rng.integers(0, 2, 400)
    ids = np.stack([a, 2 + b], axis=1).ravel()
    model = quality_fm.fit(ids, np.ones(len(ids), np.float32), np.full(400, 2), (a ^ b).astype(float), epochs=60)
    z, _ = quality_fm.raw(model, np.array([0, 2, 0, 3, 1, 2, 1, 3]), np.ones(8, np.float32), np.full(4, 2))
    assert (z > 0).tolist() == [False, True, True, False]


def test_network_learns_words_in_a_row():
    """Toxic only where two words stand next to each other; both words are in every text."""
    rng = random.Random(2)
    fill = [f"f{i}" for i in range(30)]
    texts, y = [], []
    for k in range(600):
        w = rng.choices(fill, k=12)
        at = rng.randint(0, 5)
        w[at] = "zap"
        w[at + 1 if k % 2 else at + 4 + rng.randint(0, 2)] = "bolt"
        texts.append(" ".join(w))
        y.append(k % 2)
    cut = 480
    ids = [toxicity.token_ids([t]) for t in texts]
    data = toxicity.Tokens([np.concatenate([x[0][k] for x in ids[:cut]]) for k in range(toxicity.TABLES)], np.array([int(x[1][0]) for x in ids[:cut]]))
    model = toxicity.fit(data, np.array(y[:cut]), ["en"] * cut, epochs=40)
    p = toxicity.scores(model, texts[cut:])
    assert ((p >= 0.5) == np.array(y[cut:])).mean() > 0.9


def test_cnn_pooling_equals_plain_loops():
    m = toxicity.fit(toxicity.Tokens([np.zeros(0, np.int32)] * toxicity.TABLES, np.zeros(0, np.int64)), np.zeros(0), [])
    for k, e in enumerate(m.tables):
        e[:] = np.random.default_rng(k).normal(size=e.shape)
    texts = ["a b c d", "", "one", "x y " * 30]
    got, _, _ = m.pooled(*toxicity.token_ids(texts))
    for t, row in zip(texts, got, strict=True):
        ids, n = toxicity.token_ids([t])
        x = np.concatenate([e[i] for e, i in zip(m.tables, ids, strict=True)], axis=1)
        want = [max([max(sum(x[i + j] @ k[j, :, f] for j in range(len(k))) + c[f] for i in range(int(n[0])))] if n[0] else [0], default=0) for k, c in m.convs for f in range(k.shape[2])]
        assert np.allclose(row, np.maximum(want, 0), atol=1e-3)


def _search_rows():
    rng = np.random.default_rng(2)
    v = {i: [float(np.float32(x)) for x in rng.normal(size=8)] for i in range(400)}
    for i in range(300, 400):
        v[i] = v[7]
    return [*v.items(), (20, v[20]), (20, v[3]), (33, v[33])]  # repeated ids, equal vectors and others


def _brute_force(rows, k, scale=64.0):
    """Integers of any size, every row a candidate for every other."""
    ints = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows]
    out = []
    for a, (q, x) in enumerate(ints):
        if q % 20 == 0:
            best = sorted((-sum(s * t for s, t in zip(x, y, strict=True)), c) for b, (c, y) in enumerate(ints) if a != b and len(x) == len(y))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 20.0, 300.0, 3e6, 1e7])
def test_search_equals_brute_force_at_every_size(spark, size):
    rows = [(i, [x * size for x in v]) for i, v in _search_rows()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in mtree.search(df, k=7, page=50).collect()) == _brute_force(rows, 7)


def test_windows_of_very_long_texts_change_no_score(monkeypatch):
    rng = np.random.default_rng(1)
    m = toxicity.Model([rng.normal(size=(1 << toxicity.BITS, toxicity.PART)).astype(np.float32) for _ in range(toxicity.TABLES)], [(rng.normal(size=(w, toxicity.TABLES * toxicity.PART, toxicity.FILTERS)).astype(np.float32), np.zeros(toxicity.FILTERS, np.float32)) for w in toxicity.WIDTHS], rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32) / 50, 0.0)
    text = " ".join(f"w{i * i % 211}" for i in range(1000))
    whole = toxicity.scores(m, [text])
    for window in (1, 7, 333):
        monkeypatch.setattr(toxicity, "WINDOW", window)
        assert np.allclose(toxicity.scores(m, [text]), whole, atol=1e-5)


def test_search_leaves_out_what_is_no_vector(spark):
    rows = [*_search_rows(), (520, [1.0, 2.0]), (521, [0.5, 0.25]), (540, [1e9, 0.0]), (541, [1.0, 0.0])]
    odd = [(None, [1.0] * 8), (500, None), (501, [float("nan")] * 8), (502, [None] + [1.0] * 7), (503, [float("inf")] * 8), (504, []), (560, [1e307] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in mtree.search(df, k=7, page=50).collect())
    assert got == _brute_force(rows, 7) and (540, 2, 541, 4096000000000) in got
    assert mtree.search(df.limit(0)).count() == 0


def test_search_clips_scores_beyond_64_bits(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [-1e12, 0.0]), (3, [1.0, 5.0])]
    got = mtree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 2**63 - 1), (2, 3, 64 * 64 * 10**12 + 64 * 320), (3, 2, -(2**63))]


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    return codec, tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_encode_equals_plain_encoding(spark, docs, rows, nothing, encoding):
    codec, plain = encoding
    extra = [(1000, "word " * 9000, "en", "s"), (1001, "q" * 3000 + " é\n\n  " * 700, "en", "s"), (1002, "<|endoftext|>'s 12  x", "en", "s")]
    extra += [extra[1], extra[1], (None, extra[0][1]), (1003, extra[0][1])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in extra], "doc_id long, text string"))
    got = bpe.encode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, chunk=1000, overlap=64).collect()
    want = [(i, tuple(plain.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in [*rows, *extra]]
    assert sorted(((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got), key=str) == sorted(want, key=str)
    assert bpe.encode(nothing, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_stitching_of_chunks(encoding):
    codec, _ = encoding
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'ll", "'re", "'ve", "'", "1", "!!", "é", " the", "\t", "x" * 40, " " * 30]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))
        c, o = rng.choice([3, 5, 8, 16]), rng.choice([4, 5, 8])
        chunks = [(s, t[s : s + c + o], codec.boundaries(t[s : s + c + o], s + c + o >= len(t))) for s in range(0, len(t), c)]
        assert codec.stitch(chunks) == codec.match.findall(t)


def test_merges_equal_the_library(encoding):
    codec, plain = encoding
    rng = random.Random(4)
    for k in range(600):
        raw = "".join(rng.choice(["the", "ing", "q", "é", "x" * 9, "  ", "1", "日", "ab", "er"]) for _ in range(rng.randint(1, 12 if k % 3 else 90))).encode()
        assert codec.merge(raw) == codec._merge_long(raw) if codec.ranks.get(raw) is None else True
        assert codec.merge(raw) == plain._encode_single_piece(raw)


def test_short_overlaps_are_refused(docs):
    with pytest.raises(ValueError):
        bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, overlap=1)
