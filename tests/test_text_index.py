"""The stored index against scoring everything, over versions, with staleness and early stops."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import retrieval, text_index


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["the", "a", "of"]) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randint(0, 40)))) for i in range(n)] + [(-5, None)]


def top(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7])
def test_search_equals_scoring_all_over_versions(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    monkeypatch.setattr(text_index, "CHUNK_DOCS", 300)
    folder, rows = str(tmp_path), dict(corpus(900, 1))
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "the w1 w3"), (2, "w7 w7 w250"), (3, "absent"), (4, "of a the"), (5, None), (6, "w2 the of w11 w90")], "query_id long, text string")
    assert text_index.is_stale(frame(rows), folder)
    text_index.update(frame(rows), folder)
    assert not text_index.is_stale(frame(rows), folder)
    opened = []
    assert top(text_index.search(queries, folder, k, opened=opened)) == top(retrieval.bm25(queries, frame(rows), k))
    some, whole = (f.where("query_id in (1, 6)").count() for f in opened)
    assert some < whole / 2
    changed = {i: t + " w3 w3 new" for i, t in rows.items() if t and i % 9 == 0} | {2000: "w7 the", -5: "w250"}
    gone = [i for i in rows if i % 10 == 1]
    rows = {i: t for i, t in (rows | changed).items() if i not in gone}
    text_index.update(frame(changed), folder, deleted=spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    assert text_index.state_of(spark, folder).n == len(rows) and not text_index.is_stale(frame(rows), folder)
    assert text_index.is_stale(frame(rows | {3000: "x"}), folder)
    assert top(text_index.search(queries, folder, k)) == top(retrieval.bm25(queries, frame(rows), k))


def test_staleness_by_last_change(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("at", F.timestamp_seconds(F.lit(1000)))
    text_index.update(docs, str(tmp_path), modified="at")
    assert not text_index.is_stale(docs, str(tmp_path), "at")
    assert text_index.is_stale(docs.withColumn("at", F.timestamp_seconds(F.lit(1001))), str(tmp_path), "at")
    with pytest.raises(ValueError, match="no index"):
        text_index.search(docs.select(F.col("doc_id").alias("query_id"), "text"), str(tmp_path / "none"), 1)


def test_scores_are_summed_in_chunks_without_pairs_of_candidates_and_terms(spark, tmp_path, monkeypatch):
    """Every candidate used to be joined with every term of its query, some hundred rows a pair, and shuffled."""
    monkeypatch.setattr(text_index, "CHUNK_DOCS", 70)
    docs = spark.createDataFrame(corpus(400, 3), "doc_id long, text string")
    text_index.update(docs, str(tmp_path))
    queries = spark.createDataFrame([(1, "the w1 w3 of"), (2, "a")], "query_id long, text string")
    found = text_index.search(queries, str(tmp_path), 5)
    assert top(found) == top(retrieval.bm25(queries, docs, 5))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join Inner, ((term" not in plan.split("FlatMapGroupsInArrow")[0]


def test_searches_in_a_task_equal_those_over_postings(spark, monkeypatch):
    rng = random.Random(8)
    said = lambda n: " ".join(rng.choice(["a", "b", "c", "D1", "e-f", "é", *map(str, range(30))]) for _ in range(n))
    docs = [(k, rng.choice([None, "", said(3), said(rng.randint(1, 60))])) for k in range(700)]
    docs += [(1000 + k, docs[k % 5][1]) for k in range(40)]
    items = [(k, said(rng.randint(1, 9))) for k in range(12)] + [(20, None), (21, "none of these"), (3, "a b b")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "query_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    monkeypatch.setattr(retrieval, "TASK_DOCS", 50)
    monkeypatch.setattr(retrieval, "TASK_CELLS", 100)
    near = retrieval.bm25(q, d, 7), retrieval.word_overlap(q, d, 7)
    for df in near:
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query" in physical and "doc_id" not in "".join(line for line in physical.split("\n") if "Exchange hashpartitioning" in line)
    monkeypatch.setattr(retrieval, "MOST_PAIRS", 0)
    assert [rows(x) for x in near] == [rows(f(q, d, 7)) for f in (retrieval.bm25, retrieval.word_overlap)] and near[0].count() > 70
    monkeypatch.undo()
    twice = d.unionByName(d.where("doc_id < 50"))  # documents that share an id are one
    assert rows(retrieval.bm25(q, twice, 7)) == rows(retrieval.bm25_postings(q, twice, 7))
