"""Nearest neighbours against brute force, the pipeline against its stages, and shared helpers."""

import importlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import ann, common, linededup, ngramjoin


def brute(x, ids, q, k):
    s = x.astype(float) @ x[q].astype(float)
    order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


@pytest.mark.parametrize("scale", [False, True])
def test_hnsw_recall_and_scores(spark, scale):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[500:700] = x[500]  # equal vectors
    if scale:
        x *= rng.uniform(0.2, 3, (1500, 1)).astype(np.float32)
    rows = [(i, x[i].tolist(), "other") for i in range(1500)]
    rows += [(5000, None, ""), (5020, [], ""), (5040, [0.0] * 16, ""), (5060, [float("nan")] * 16, ""), (5080, [None] + [1.0] * 15, ""), (None, x[0].tolist(), ""), (7, x[7].tolist(), "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = ann.nearest(df, lambda i: i % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, 1500, 20))
    recall = []
    for q, found in by.items():
        exact = brute(x, np.arange(1500), q, 20)
        assert len(found) == 20 and all(s == pytest.approx(float(x[i].astype(float) @ x[q].astype(float)), abs=1e-12) for i, s in found)
        recall.append(len({i for i, _ in found} & {i for i, _ in exact}) / 20)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert np.mean(recall) >= 0.9


def test_hnsw_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, lambda i: i % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_pipeline_stages_and_run(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    shared = "a passage that several documents share word for word"
    rows = []
    for i in range(300):
        w = [word() for _ in range(60)]
        if i % 10 == 0:
            w[3] = w[30] = "slurword"
        rows.append((i, " ".join(w) + (f"\n{shared}" if i % 3 == 0 else ""), "en", f"s{i % 3}", 0))
    rows += [(300 + i, rows[i][1], "en", "s0", 0) for i in range(1, 20)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, out = out, common.stored(stage(spark, out, str(tmp_path)), "test-stage")
        assert out.columns == docs.columns and out.count() > 0, name
        if name == "toxicity":
            assert out.where("doc_id % 10 = 0 and doc_id < 300").count() == 0 and out.count() == before.count() - 31
        if name == "line dedup":
            assert out.where(F.contains("text", F.lit(shared))).count() == 1 and out.count() == before.count()
        if name == "n-gram Jaccard join":
            assert out.where("doc_id >= 300").count() == 0
    final = pipeline.run(spark, str(tmp_path)).collect()
    assert len(final) == out.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(final[0].asDict())


def test_stage_keeps_extra_columns(spark):
    docs = spark.createDataFrame([(i, "same words in every one of these documents here", "x", f"v{i}") for i in range(5)], "doc_id long, text string, version string, rep string")
    assert ngramjoin.without_near_copies(docs).collect() == [docs.where("doc_id = 0").first()]
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    assert [r["text"] != "" for r in kept.orderBy("doc_id").collect()] == [False] * 4 + [True] and kept.columns == docs.columns


@pytest.mark.parametrize("scaled", [False, True])
def test_graph_recall_on_a_large_shard(scaled):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 48))
    if scaled:
        x *= np.exp(rng.normal(size=(6000, 1)) * 0.4)
    g = ann.Graph.build(x)
    q = x[:60]
    walking = np.concatenate([q / np.abs(q).max(1, keepdims=True), np.zeros((60, 1))], 1).astype(np.float32)
    found = g.nearest(walking, ann.EF_SEARCH)
    again = ann.Graph.from_flat(x, *(g.flat()[k] for k in ("entry", "levels", "links"))).nearest(walking, ann.EF_SEARCH)
    assert np.array_equal(found, again)
    recall = []
    for i in range(60):
        s = x @ q[i]
        s[i] = -np.inf
        mine = found[i][(found[i] < g.n) & (found[i] != i)]
        best = mine[np.argsort(-s[mine])[:20]]
        recall.append(len(set(best.tolist()) & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_hnsw_doubles_lengths_and_ties(spark):
    rows = [(0, [1e300, 0.0]), (1, [0.25, 0.0]), (2, [0.25, 0.0]), (3, [0.25, 5.0]), (4, [1.0, 2.0, 3.0]), (20, [0.1, 0.2, 0.3]), (5, [0.1 + 1e-12, 0.0])]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, k=3).collect()]
    by = {q: [(v, s) for a, _, v, s in sorted(got) if a == q] for q in (0, 20)}
    assert by[0] == [(1, 0.25e300), (2, 0.25e300), (3, 0.25e300)]
    assert [v for v, _ in by[20]] == [4] and by[20][0][1] == pytest.approx(1.4, abs=1e-15)


def test_pipeline_edge_rows(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, version string, copy string"
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "en", "a", 1, "x", "y"), (1, text, "en", "a", 1, "x", "y"), (2, text + " end", "en", None, 1, None, None), (None, text, None, None, None, None, None), (3, None, None, "a", None, None, None), (4, "", "en", "a", 0, "x", "y")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, docs in (("rows", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        out = docs
        for stage, f in pipeline.STAGES[:-1]:
            out = common.stored(f(spark, out, str(tmp_path)), f"edge-{name}")
            assert out.columns == docs.columns, stage
            if name == "none":
                assert out.isEmpty()
            elif stage == "n-gram Jaccard join":
                assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]
        assert pipeline.STAGES[-1][1](spark, out, str(tmp_path)).count() == out.count()
