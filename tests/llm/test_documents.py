"""Operators on documents against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import bpe, licences, linededup, lm, mixing, ngramjoin, quality, rules, toxicity
from weft.llm.textstats import repeated_window_words, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pattern int, score double, drops string, copy int"
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(40_000))
TEXTS = [
    "the quick brown fox jumps over the lazy dog near the river bank today",
    "the quick brown fox jumps over the lazy dog near the river bank today",
    "The QUICK brown fox jumps over the lazy dog near the river bank tonight",
    "",
    None,
    "   \n\t ",
    "one two",
    "ONE  two",
    "A shared line of text, long enough.\nsecond own line number one is here\n  a shared LINE of text, long enough.  ",
    "a shared line of text, long enough.\nother",
    "x\nA shared line of text, long enough.",
    LONG,
    "Ééé ñ ünïcode çà et là, l'été déjà passé — 12,5 € & more\r\nend",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), 7, 0.5, "d", 3) for i, t in enumerate(TEXTS)]
    rows += [(0, TEXTS[0], "en", "s0", 1, 7, 0.5, "d", 3), (None, "text of nobody, long enough to count", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, n, label):
    return spark.createDataFrame([(i, int(label(i))) for i in range(n)] + [(None, 1), (3, None)], "doc_id long, y int")


# --- byte-level BPE ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(docs, tokenizer):
    ranks, pattern, own = tokenizer
    got = bpe.decode(bpe.encode(docs, ranks, pattern), ranks).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r["decoded"].decode()
        assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(text)
    assert sorted(r["decoded"].decode() for r in got) == sorted(r["text"] or "" for r in docs.collect())


def test_bpe_digests(docs, empty, tokenizer):
    ranks, pattern, own = tokenizer
    for r in bpe.digests(docs, ranks, pattern).where("doc_id is not null").collect():
        ids = own.encode_ordinary(TEXTS[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.digests(empty, ranks, pattern).count() == 0


@pytest.mark.parametrize("word", ["a" * 5000, "ab" * 700, "é" * 300, "xyzzy" * 60, "\x00\x01" * 80])
def test_bpe_long_words(word, tokenizer):
    ranks, _, _ = tokenizer
    raw = word.encode()
    assert bpe.fold_long(raw, ranks) == bpe.fold_short(raw[:400], ranks) if len(raw) <= 400 else b"".join(bpe.pieces_of(ranks)[i] for i in bpe.fold_long(raw, ranks)) == raw
    assert bpe.fold_long(raw[:90], ranks) == bpe.fold_short(raw[:90], ranks)


def test_bpe_native_fold(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"th": 256, b"the": 257, b"he": 258, b"an": 259, b" t": 260, b" the": 261}
    words = ["the", " the", "then", "hethe", "ananth", "a", "ba", "thth", "é"]
    got = {r["word"]: r["ids"] for r in bpe.encode_words_native(spark.createDataFrame([(w,) for w in [*words, "the", None]], "word string"), ranks).collect()}
    assert got == {w: bpe.fold(w.encode(), ranks) for w in words}


# --- line dedup ----------------------------------------------------------------------------


def brute_lines(rows, least_chars=20, least_docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars and i is not None:
                held.setdefault(key(x), set()).add(i)
    top = {k: max(v) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or top.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup_equals_brute_force(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, linededup.digests(docs).collect())) == brute_lines(rows)
    assert linededup.digests(empty).count() == 0


def test_line_dedup_many_lines_and_repeats(spark):
    rng = np.random.default_rng(1)
    pool = [f"line number {i} of the common pool" for i in range(60)] + ["short", "É line with an accent, Ünïcode", "é line with an accent, ünïcode"]
    rows = [(int(i % 40), "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 200)))) for i in range(60)]
    got = Counter(map(tuple, linededup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_lines(rows)


def test_line_dedup_shuffles_where_bitmaps_are_large(docs, monkeypatch):
    expected = Counter(map(tuple, linededup.digests(docs).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_ENTRIES", 0)
    assert Counter(map(tuple, linededup.digests(docs).collect())) == expected


def test_line_dedup_judges_hot_keys_where_they_lie(docs, empty, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_LINES", 1)
    assert Counter(map(tuple, linededup.digests(docs).collect())) == brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", 0)
    assert Counter(map(tuple, linededup.digests(docs).collect())) == brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert linededup.digests(empty).count() == 0


def test_line_dedup_keeps_columns(docs):
    out = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    assert out.columns == docs.columns and out.count() == docs.count()


# --- n-gram join ---------------------------------------------------------------------------


def brute_components(rows):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = [(i, grams(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {(i, len(s), find(i)) for i, s in sets}


def near_copies(seed, n=60):
    rng = np.random.default_rng(seed)
    base = [[f"v{k}" for k in rng.integers(0, 4000, rng.integers(3, 120))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(base[int(rng.integers(0, len(base)))])
        for _ in range(int(rng.integers(0, 1 + len(w) // 9))):
            w[int(rng.integers(0, len(w)))] = f"z{int(rng.integers(0, 9999))}"
        rows.append((i, " ".join(w)))
    return rows


def test_ngram_join_edge_cases(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]
    got = ngramjoin.linked(docs).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute_components(rows)
    assert len(got) == docs.count()
    assert ngramjoin.linked(empty).count() == 0


@pytest.mark.parametrize("long_list, block, leaders", [(64, 256, 6), (2, 4, 1), (1, 64, 1)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, long_list, block, leaders):
    monkeypatch.setattr(ngramjoin, "LONG_LIST", long_list)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "LEADERS", leaders)
    rows = near_copies(long_list)
    got = ngramjoin.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    lists = ngramjoin.Lists(sets)
    for s in sets:
        assert lists.alike(s).tolist() == [j for j, o in enumerate(sets) if ngramjoin.alike(s, o)]


def test_components_of_a_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 150], "q long, c long")
    got = ngramjoin.components(links, "test").collect()
    roots = {r["node"]: r["root"] for r in got}
    assert len({roots[i] for i in range(151)}) == 1 and len({roots[i] for i in range(151, n + 1)}) == 1 and len(set(roots.values())) == 2


# --- mixing --------------------------------------------------------------------------------


def test_mixing_counts_and_order(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "a" if i % 4 else "b", "mine") for i in range(4000)], "doc_id long, text string, source string, order_key string")
    out = mixing.mixed(docs, {"a": 1.0, "b": 1.0, "absent": 5.0}).collect()
    n = Counter(r["source"] for r in out)
    assert 1800 < n["a"] < 2200 and 1800 < n["b"] < 2200
    keys = [r["order_key"] for r in out]
    assert keys == sorted(keys)
    assert [tuple(r) for r in mixing.mixed(docs.repartition(5), {"a": 1.0, "b": 1.0}).collect()] == [tuple(r) for r in out]


def test_mixing_inverts_the_distribution(spark):
    from math import exp, factorial

    for rate in (0.3, 1.0, 7.5):
        got = spark.range(1).select(mixing.distribution(F.lit(rate)).alias("p")).first()["p"]
        exact = np.cumsum([exp(-rate) * rate**k / factorial(k) for k in range(len(got))])
        assert np.allclose(got, exact, atol=1e-12)
    us = [(u,) for u in (0.0, 0.2, 0.74, 0.75, 0.999)]
    got = [r["n"] for r in spark.createDataFrame(us, "u double").select(mixing.copies(F.col("u"), mixing.distribution(F.lit(0.3))).alias("n")).collect()]
    assert got == [0, 0, 0, 1, 3]


def test_mixing_edge_cases(docs, empty):
    assert mixing.mixed(empty, None).count() == 0
    out = mixing.mixed(docs, None, total=2.0)
    assert set(docs.columns) <= set(out.columns)
    rate_of_null = mixing.rates(docs, None, total=2.0).where("source is null").first()["rate"]
    drawn = out.where("source is null").count()
    u = int(hashlib.sha256(b"mix:").hexdigest()[:13], 16) / 2**52
    below = np.cumsum([np.exp(-2.0), 2 * np.exp(-2.0), 2 * np.exp(-2.0), 4 / 3 * np.exp(-2.0), 2 / 3 * np.exp(-2.0)])
    assert rate_of_null == 2.0 and drawn == int((below <= u).sum())


# --- scores --------------------------------------------------------------------------------


def test_quality_learns_and_covers_every_row(spark, docs, empty):
    good = "Plain words make a sentence that reads well, and so does the next one. It goes on for a while."
    bad = "BUY!! NOW!! ### $$$ BUY!! NOW!! ### $$$ BUY!! NOW!!"
    rows = [(i, (bad if i % 5 == 0 else good) + f" {i}" * (i % 7)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.classify(d, labels_of(spark, 400, lambda i: i % 5 != 0), label="y").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["predicted"] == int(r["doc_id"] % 5 != 0) for r in out) > 390
    edge = quality.classify(docs, labels_of(spark, 13, lambda i: i % 2), label="y").collect()
    assert len(edge) == docs.count() and all(0 <= r["score"] <= 1 for r in edge)
    none = quality.classify(docs, spark.createDataFrame([], "doc_id long, y int"), label="y").collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify(empty, labels_of(spark, 5, bool), label="y").count() == 0


def test_quality_scores_equal_a_plain_discriminant(spark):
    rng = np.random.default_rng(12)
    texts = [" ".join("".join(rng.choice(list("abcdeXY!#1"), rng.integers(1, 9))) for _ in range(rng.integers(1, 60))) + ("\nx\nx" if i % 3 else "") for i in range(160)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.classify(d, labels_of(spark, 160, lambda i: i % 3 == 0), label="y").collect()}
    x = np.array([quality.statistics_of(t) for t in texts])
    learn = [i for i in range(160) if zlib.crc32(str(i).encode()) % 4 != 2]
    y = np.array([i % 3 == 0 for i in range(160)])
    n = {k: sum(y[i] == k for i in learn) for k in (0, 1)}
    parts = {k: x[[i for i in learn if y[i] == k]] for k in (0, 1)}
    own = {k: np.cov(parts[k].T, bias=True) for k in (0, 1)}
    pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    logs = np.full(160, np.log((n[1] + 1) / (n[0] + 1)))
    for k in (0, 1):
        few = min(1.0, 0.1 + 0.5 * x.shape[1] / n[k])
        cov = (1 - few) * own[k] + few * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + np.diag(np.maximum(np.diag(pooled), 1e-6)) * 1e-3
        away = x - parts[k].mean(0)
        logs += (1 if k else -1) * (-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose([got[i] for i in range(160)], 1 / (1 + np.exp(-np.clip(logs, -500, 500))), atol=1e-6)


def test_toxicity_scores_equal_plain_neighbours(spark):
    """Every text against every example, over the same terms."""
    rng = np.random.default_rng(13)
    pool = ["vile", "nasty", "mean", "kind", "calm", "mild"]
    rows = [(i, " ".join([*rng.choice(pool[:4] if i % 3 == 0 else pool[2:], rng.integers(0, 7)), f"n{rng.integers(40)}"])) for i in range(240)]
    settings = toxicity.Settings(neighbours=7)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, y int")
    model = toxicity.fit(d, labelled, settings)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(d, model).collect()}
    terms = toxicity.Terms(model.number)
    dense = np.zeros((240, len(model.number)))
    for i, t in rows:
        at, w = toxicity.vector(t, terms, model.idf)
        dense[i, at] = w
    near = (dense @ dense[:200].T).round(12)

    def vote(i, without):
        s = near[i].copy()
        if without:
            s[i] = 0
        best = [j for j in np.lexsort((np.arange(200), -s))[:7] if s[j] > 0]
        return (sum(s[j] ** 2 * (j % 3 == 0) for j in best) + 0.05 * model.prior) / (sum(s[j] ** 2 for j in best) + 0.05) if best else None

    left = [(v, i % 3 == 0) for i in range(200) if dense[i].any() and (v := vote(i, True)) is not None]
    knots = toxicity.pool_adjacent(np.r_[0.0, [v for v, _ in left], 1.0], np.r_[0.0, [t for _, t in left], 1.0], np.ones(len(left) + 2))
    for i in range(240):
        v = vote(i, False)
        assert got[i] == pytest.approx(model.unmatched if v is None else np.interp(v, *knots), abs=1e-6)


def test_toxicity_knows_a_word_of_three_examples(spark):
    rng = np.random.default_rng(14)
    rows = [(i, " ".join([f"w{k}" for k in rng.integers(0, 3000, 30)] + (["rareslur"] if i in (0, 8, 16, 500) else ["badword"] if i % 8 == 0 else []))) for i in range(501)]
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(360)], "doc_id long, y int")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(d, labels)
    assert "rareslur" in model.number and {r["doc_id"]: r["score"] for r in toxicity.scored(d, model).collect()}[500] >= 0.5


def test_toxicity_learns_and_gives_evidence(spark, docs, empty):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = []
    for i in range(600):
        w = [word() for _ in range(40)]
        if i % 6 == 0:
            w[7] = "vileword"
        if i % 12 == 0:
            w[9] = "qqxz" + word()
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.classify(d, labels_of(spark, 600, lambda i: i % 6 == 0), label="y").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in out)
    assert all("vileword" in " ".join(r["evidence_terms"]) or "vil" in " ".join(r["evidence_terms"]) for r in out if r["doc_id"] % 12 == 6)
    assert toxicity.classify(docs, labels_of(spark, 13, lambda i: i % 2), label="y").count() == docs.count()
    assert {r["score"] for r in toxicity.classify(docs, spark.createDataFrame([], "doc_id long, y int"), label="y").collect()} == {0.0}
    assert toxicity.classify(empty, labels_of(spark, 5, bool), label="y").count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(1500):
        t = np.sort(rng.choice(300, rng.integers(1, 12), replace=False)).astype(np.int32)
        w = rng.random(len(t))
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.Index.build(np.arange(1500), np.zeros(1500), np.ones(1500), vectors, 300)
    dense = np.zeros((1500, 300))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 1500, 37):
        found, near = index.nearest(*vectors[i], 10, without=i)
        exact = dense @ dense[i]
        exact[i] = 0
        best = [j for j in np.lexsort((np.arange(1500), -exact.round(12)))[:10] if exact[j] > 0]
        assert found.tolist() == best and np.allclose(near, exact[best])


def test_rules_counts_and_verdicts(spark, docs, empty):
    def windows(w):
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        return len({k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)})

    for t in TEXTS:
        w = words_of(t or "")
        assert repeated_window_words(w) == windows(w)
    out = rules.judged_documents(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        t = next((x for i, x in enumerate(TEXTS) if i == r["doc_id"]), "text of nobody, long enough to count") or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        filled = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert r["n_repeat_words"] == windows(w) and r["n_dup_lines"] == len(filled) - len(set(filled))
        assert r["base_failed"] == (len(w) < 10 or 100 * r["n_repeat_words"] > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert rules.judged_documents(empty).count() == 0


def test_label_model_finds_bad_documents():
    rng = np.random.default_rng(4)
    y = rng.random(3000) < 0.85
    votes = np.where(rng.random((3000, 6)) < 0.9, np.where(y[:, None], 1, -1), np.where(y[:, None], -1, 1)) * (rng.random((3000, 6)) < 0.8)
    model = rules.fit_label_model(votes, np.ones(3000))
    assert abs(model.prior - 0.85) < 0.03 and ((model.posterior(votes) >= 0.5) == y).mean() > 0.95


def test_lm_prefers_its_target(spark, docs, empty):
    a, b = ["red", "green", "blue", "sky"], ["iron", "steel", "rust", "bolt"]
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(a if i % 2 else b, 30))) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    targets = spark.createDataFrame([(i,) for i in range(1, 101, 2)] + [(None,)], "doc_id long")
    s = {r["doc_id"]: r["score"] for r in lm.scored(d, lm.fit(d, targets)).collect()}
    assert max(s[i] for i in range(1, 200, 2)) < min(s[i] for i in range(0, 200, 2))
    out = lm.scored(docs, lm.fit(docs, targets)).collect()
    assert len(out) == docs.count() and all(np.isfinite(r["score"]) for r in out) and {r["score"] for r in out if r["n_tokens"] == 0} == {0.0}
    assert lm.scored(empty, lm.fit(empty, targets)).count() == 0


def test_lm_losses_equal_a_plain_model(spark):
    d = spark.createDataFrame([(1, "a b a c"), (2, "a b b")], "doc_id long, text string")
    m = lm.fit(d, spark.createDataFrame([(2,)], "doc_id long"), lm.Settings(words=16, slots=18, prior=2.0))
    uni, big = Counter("a b a c a b b".split()), Counter([("a", "b"), ("b", "a"), ("a", "c"), ("a", "b"), ("b", "b")])
    p1 = lambda w: (uni[w] + 1) / (7 + 16)
    loss = -np.log(p1("a")) - sum(np.log((big[x] + 2 * p1(x[1])) / (uni[x[0]] + 2)) for x in (("a", "b"), ("b", "b")))
    assert m.score("a b b")[2] == pytest.approx(loss / 3, rel=1e-6)


def test_lm_counts_every_word_and_bigram(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(lm, "SLICE_CHARS", 4_000)
    rows = [(i if i % 9 else None, " ".join(f"w{k}" for k in rng.integers(0, 900, 60))) for i in range(90)] + [(500, None), (501, "w1")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    m = lm.fit(d, spark.createDataFrame([(i,) for i in range(0, 30)], "doc_id long"), lm.Settings(words=4, slots=8, prior=2.0))
    counts = [(Counter(), Counter()), (Counter(), Counter())]
    for i, t in rows:
        w = (t or "").split()
        for k in range(2 if i is not None and i < 30 else 1):
            counts[k][0].update(w)
            counts[k][1].update(zip(w, w[1:]))

    def loss(k, w):
        uni, big = counts[k]
        p = lambda x: (uni[x] + 1) / (uni.total() + len(counts[0][0]) + 1)
        return -sum(np.log(p(w[0]) if j == 0 else (big[w[j - 1], x] + 2 * p(x)) / (uni[w[j - 1]] + 2)) for j, x in enumerate(w)) / len(w)

    by = lambda found: sorted((i if i is not None else -1, n, round(t, 9), round(b, 9)) for i, n, t, b in found)
    got = [(r["doc_id"], r["n_tokens"], r["target_loss"], r["background_loss"]) for r in lm.scored(d, m).collect()]
    assert by(got) == by((i, len(w := (t or "").split()), *((loss(1, w), loss(0, w)) if w else (0.0, 0.0))) for i, t in rows)
    assert m.score("w1 w2 unseen") == pytest.approx((3, loss(1, ["w1", "w2", "unseen"]), loss(0, ["w1", "w2", "unseen"])))


# --- licences ------------------------------------------------------------------------------


def test_licences_found_and_left_alone(spark, docs, empty):
    rows = [(1, "Intro\nReleased under the MIT License."), (2, "This work is licensed under the GNU General Public License, version 3.\nmore"), (3, "Her driver license was renewed.\nnothing here"), (4, "Licensed under CC BY-NC 4.0. and then words follow"), (5, "Licensed under the Apache License, Version 2.0.")]
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licences.scanned(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")).collect()}
    assert got == {(1, 0): "MIT", (2, 0): "GPL", (4, 0): "CC-BY-NC", (5, 0): "Apache"}
    assert licences.scanned(docs).where("family <> 'unknown'").count() == 0
    assert licences.scanned(empty).count() == 0


def test_licences_wrapped_over_lines_and_without_anchor_words(spark):
    texts = [
        "Copyright 2020\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\nEnd",
        "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "# SPDX-License-Identifier: MIT",
        " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License",
        " ".join(f"w{k}" for k in range(3000)) + " Licensed under the Apache License, Version 2.0. " + " ".join(f"v{k}" for k in range(3000)),
        "The library is open to the public and the driver showed a license at the gate.",
    ]
    rows = licences.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("family <> 'unknown'").collect()
    assert {(r["doc_id"], r["family"]) for r in rows} == {(0, "BSD"), (1, "MPL"), (2, "MIT"), (3, "GPL"), (4, "Apache")}


def test_licence_probabilities_are_calibrated():
    m = licences.trained()
    found = [(m.probabilities(licences.grams(w)), y) for w, y in licences.examples(4, 11)]
    sure = np.array([p.max() for p, _ in found])
    right = np.array([p.argmax() == y for p, y in found])
    assert right.mean() > 0.95 and abs(sure.mean() - right.mean()) < 0.03
    assert np.mean([p[0] for p, y in found if y == 0]) > 0.9


def test_licence_scores_equal_the_model(spark):
    m = licences.trained()
    text = "Use of this source code is governed by a BSD-style license that can be found in the file"
    r = licences.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    p = m.probabilities(licences.grams(licences.tokens(text)))
    assert r["family"] == "BSD" and r["probability"] == pytest.approx(p.max(), rel=1e-9) and r["unknown_probability"] == pytest.approx(p[0], rel=1e-6)


def test_ngram_join_shuffles_where_tables_are_large(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngramjoin, "LONG_LIST", 3)
    rows = near_copies(11)
    got = ngramjoin.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_lm_targets_repeat_and_miss(spark, docs):
    score = lambda ids: sorted((r["doc_id"] or -1, r["n_tokens"], round(r["score"], 9)) for r in lm.scored(docs, lm.fit(docs, spark.createDataFrame([(i,) for i in ids], "doc_id int"))).collect())
    assert score([0, 1, 2, 3, 4, 5]) == score([5, 4, 4, 3, 2, 1, 0, 0, 999, None])


def test_toxic_rows_go_by_their_own_text(spark):
    clean, toxic = "plain words about the river", "plain words about the vileword"
    rows = [(i, f"{toxic if i % 4 == 0 else clean} {i}") for i in range(400)]
    more = [(None, toxic), (None, clean), (0, clean), (None, None)]
    d = spark.createDataFrame(rows + more, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in toxicity.without_toxic(d, labels_of(spark, 400, lambda i: i % 4 == 0), label="y").collect())
    assert got == Counter([(i, t) for i, t in rows + more if "vileword" not in (t or "")])


def test_one_row_of_near_copies_stays(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, a), (3, a), (3, a), (None, a), (None, b + " end"), (None, b), (7, c), (7, b + " tail"), (9, b), (None, None), (None, ""), (8, "alone"), (8, "other")]
    out = ngramjoin.without_near_copies(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3))
    assert out.columns == ["doc_id", "text", "source"]
    expected = [(3, a), (7, c), (7, b + " tail"), (None, None), (None, ""), (8, "alone"), (8, "other")]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(expected)


def test_mixing_many_sources_and_large_rates(spark, monkeypatch):
    many = spark.range(24_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("s"), (F.col("id") % 21_000).cast("string")).alias("source"))
    weights = mixing.tempered(many)
    assert weights.count() == 21_000 and 22_000 < mixing.replicated(many, weights).count() < 26_000
    for rate in (1_500.0, 30_000.5, 4e6):
        at = [-3.0, -0.7, 0.0, 0.7, 3.0]  # normal quantiles
        us = [0.0013498980316301, 0.2419636522230730, 0.5, 0.7580363477769270, 0.9986501019683699]
        got = [r["n"] for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.inverted(F.col("u"), F.lit(rate)).alias("n")).collect()]
        near = [rate + z * rate**0.5 + (z * z - 1) / 6 for z in at]  # Cornish-Fisher
        assert all(abs(n - x) < 1.5 for n, x in zip(got, near))
        if rate < 2_000:
            below = mixing.distribution(F.lit(rate))
            assert got == [r["n"] for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.copies(F.col("u"), below).alias("n")).collect()]
    few = spark.createDataFrame([(1, "t", "a"), (2, "t", "b")], "doc_id long, text string, source string")
    out = mixing.replicated(few, {"a": 1.0}, total=70_000.0)
    assert out.select("copy").distinct().count() == out.count() > 69_000


def test_ngram_pairs_with_a_cluster_of_a_negative_id(spark):
    rows = spark.createDataFrame([(g, i, 2, i) for g in (10, 11) for i in (-5, 4)], "g long, doc_id long, n long, grp long")
    clusters = spark.createDataFrame([(-5, -5)], "node long, root long")
    assert [tuple(r) for r in ngramjoin.occurrence_pairs(rows, clusters).collect()] == [(-5, 4)]


def test_packed_numbers_come_back():
    for x in ([0], [5], [255, 256, 1 << 40], [-5, 3], [0, 0, 0], [1 << 62], list(range(300)), [300] * 9, [(1 << 63) - 1, -1]):
        assert ngramjoin.from_planes(ngramjoin.planes(np.array(x, np.int64))).tolist() == x
    assert len(ngramjoin.planes(np.arange(10_000))) < 20_002
    g, n = ngramjoin.unpacked(ngramjoin.binaries(np.array([1 << 63, 5 << 16, 7], np.uint64), np.array([0, 2, 1])))
    assert g.tolist() == [1 << 47, 5, 0] and n.tolist() == [0, 2, 1]


@pytest.mark.parametrize("gathered, slices, filter_bits", [(2_000_000, 64, 28), (50, 2, 6)])
def test_only_postings_of_shared_ngrams_are_shuffled(spark, monkeypatch, gathered, slices, filter_bits):
    for name, value in (("GATHERED", gathered), ("LEAST_SLICES", slices), ("FILTER_BITS", filter_bits)):
        monkeypatch.setattr(ngramjoin, name, value)
    docs = spark.createDataFrame(near_copies(5, 300), "doc_id long, text string").repartition(4)
    sketches = ngramjoin.sketched(docs, np.zeros(0, np.uint64))
    postings = ngramjoin.stored(sketches.select("doc_id", "n", (F.col("doc_id") % 40 - 20).alias("grp"), "prefix"), "test")
    lists = {}
    for r in postings.collect():
        for g in ngramjoin.unpacked(pa.array([r["prefix"]], pa.binary()))[0].tolist():
            lists.setdefault(g, set()).add((r["doc_id"], r["n"], r["grp"]))
    expected = {(g, *x) for g, found in lists.items() if len({x[2] for x in found}) > 1 for x in found}
    bits = ngramjoin.slice_bits(len(lists))
    shared = ngramjoin.stored(ngramjoin.shared_ngrams(postings, bits), "test")
    assert shared.count() <= 1 << bits
    assert 0 < len(expected) < sum(map(len, lists.values()))
    assert {tuple(r) for r in ngramjoin.posting_rows(postings, shared, bits).collect()} == expected
    known = ngramjoin.filter_of(shared, bits)
    assert len(known) == (1 << filter_bits) // 8
    if filter_bits == 28:  # a filter that is not full passes next to nothing else
        passed = sum(len(x) for g, x in lists.items() if known[g >> 23] >> (g >> 20 & 7) & 1)
        assert passed == len(expected)


def test_leaders_share_two_hashes(spark):
    rows = [(1, 9, [1, 2, 3, 4, 5, 6]), (2, 9, [1, 20, 21, 22, 23, 24]), (3, 9, [1, 2, 31, 32, 33, 34])]
    assert [tuple(r) for r in ngramjoin.leader_pairs(spark.createDataFrame(rows, "doc_id long, n long, sig array<long>")).collect()] == [(1, 3)]


def test_texts_stay_where_narrow_tables_fit_as_arrays(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(ngramjoin, "PACKED", 100_000)
    monkeypatch.setattr(ngramjoin, "LONG_LIST", 3)
    monkeypatch.setattr(ngramjoin, "PAIRS_A_STREAM", 2)
    rows = near_copies(12)
    docs = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string")
    pairs = ngramjoin.stored(spark.createDataFrame([(0, k) for k in range(1, 9)] + [(70, 3)], "q long, c long"), "test")
    found = ngramjoin.checked(pairs, docs)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    sets = {i: ngramjoin.sets_of(pa.array([t]))[0] for i, t in rows}
    assert {tuple(r) for r in found.collect()} == {(0, k) for k in range(1, 9) if ngramjoin.alike(sets[0], sets[k])}
    got = ngramjoin.linked(docs.where("doc_id is not null")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
