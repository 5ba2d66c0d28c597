"""Operators on small frames: merges, decisions, linkage, sources, streams, registered queries."""

import pytest
from pyspark.sql import functions as F

from weft import plans
from weft.functions import notes
from weft.operators import entities, evaluation, linkage, ranking, relational, retrieval
from weft.sources import files
from weft.streaming import streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k long, v string")
    assert relational.upsert(old, new, ["k"]).orderBy("k").collect() == [(1, "a"), (2, "c"), (3, None)]
    assert rows(relational.insert_new(old, new, ["k"]).where("v is not null")) == [(1, "a"), (2, "b")]
    obs = spark.createDataFrame([("x", 1, 0.5, 1, 10), ("x", 1, 0.9, 2, 5)], "alias string, concept long, confidence double, frequency long, used_at long")
    once = relational.merge_aliases(obs)
    assert rows(once) == [("x", 1, 0.9, 3, 10)] and rows(relational.merge_aliases(once.unionByName(obs))) == [("x", 1, 0.9, 6, 10)]


def test_interval_and_near_joins(spark):
    s = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 9, 30), (1, 3, 10, 11), (1, 4, 5, 5), (2, 5, 0, 99)], "k long, id long, start long, stop long")
    got = relational.interval_join(s, s, "k", 4).where("id_a < id_b")
    assert rows(got) == [(1, 1, 2), (1, 2, 3)]
    p = spark.createDataFrame([(1, 1, 0), (1, 2, 80), (1, 3, 161)], "k long, id long, at long")
    assert rows(relational.near_pairs(p, ["k"], "at", 80)) == [(1, 1, 2)]


def test_decision_gates(spark):
    c = [
        ("agree", "Procedure", 1, 0.9, 0.9, None, 0.8), ("agree", "Procedure", 2, 0.2, 0.1, None, 0.79),
        ("high", "Medication", 1, 0.5, 0.1, None, 0.89), ("high", "Medication", 2, 0.4, 0.2, None, 0.5),
        ("two", "Procedure", 1, 0.6, 0.6, 0.1, 0.85), ("two", "Procedure", 2, 0.5, 0.5, 0.2, 0.7),
        ("brand", "Procedure", 1, 0.65, 0.1, 0.35, 0.6), ("brand", "Procedure", 2, 0.3, 0.3, 0.4, 0.3),
        ("judge", "Procedure", 2, 0.3, 0.3, 0.1, 0.5), ("judge", "Procedure", 1, 0.2, 0.1, 0.3, 0.5),
    ]
    df = spark.createDataFrame(c, "entity string, kind string, id long, trigram double, phonetic double, vector double, gate_score double")
    got = {r["entity"]: (r["decision"], r["chosen_id"]) for r in ranking.decisions(df).collect()}
    assert got == {"agree": ("A", 1), "high": ("B1", 1), "two": ("B2", 1), "brand": ("BRAND", 1), "judge": ("JUDGE", None)}


def test_scores(spark):
    df = spark.createDataFrame([("toys & games", "Toys and Games", 0.95), ("a", "b", 0.85), (None, "b", 0.1)], "a string, b string, p double")
    got = [tuple(r) for r in df.select(ranking.category_score(F.replace(F.col("a"), F.lit("&"), F.lit("and")), F.col("b")), ranking.suggestion_boost(F.col("p"))).collect()]
    assert got == [(0.12, 0.25), (-0.35, 0.15), (0.0, 0.0)]


def test_exact_knn_equals_brute_force(spark):
    pts = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    got = retrieval.exact_knn(df, df, "id", "v", 4, "l2", block_rows=13)
    by = {}
    for r in got.collect():
        by.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    for i, v in pts:
        exact = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5, 9), j) for j, w in pts if j != i)[:4]
        assert sorted(by[i]) == [(pytest.approx(d, abs=1e-6), j) for d, j in exact]


def test_link_cascade_order(spark):
    atoms = [(1, "red pill", "E9", None), (2, "blue  Pill", None, None), (3, "green pills", None, None), (4, "nothing", None, None), (5, "other", None, 7), (6, "Brand X", None, None), (7, "easotic ear drops", None, None), (8, "amoxicilin tablet", None, None), (9, "scan", None, None)]
    a = spark.createDataFrame([(1, i, c, "Medication", r, x) for i, c, r, x in atoms], "visit long, atom_id long, concept string, kind string, ref_id string, local_id long")
    rows_of = [("E9", "odd", "", "Procedure", 9, None), ("E1", "blue pill", "", "Preventive", 1, None), ("E2", "green pill", "", "Medication", 2, None), ("E3", "third", "", "Anatomy", 3, 7), ("E4", "fourth", "brand x", "Vaccine", 4, None), ("E5", "easotic 10ml", "", "Drug", 5, 8), ("E6", "amoxycillin tablet", "", "Drug", 6, 9), ("E7", "scan", "", "LabTest", 7, 3)]
    m = spark.createDataFrame([(1, *r) for r in rows_of], "visit long, entity_id string, name string, display string, kind string, pos long, local_id long")
    assert rows(linkage.link_cascade(a, m)) == [(1, "E9", 0), (2, "E1", 5), (3, "E2", 5), (5, "E3", 1), (6, "E4", 4), (7, "E5", 6), (8, "E6", 8)]


def test_flags_and_gate(spark):
    df = spark.createDataFrame([("",), ("too short [unclear]",), ("word " * 30,)], "t string")
    got = [r[0] for r in df.select(evaluation.overall(evaluation.transcript_flags(F.col("t")))).collect()]
    assert got == ["failing", "degraded", "healthy"]
    cur = spark.createDataFrame([("wer", 0.3), ("f1", 0.5), ("new", 1.0)], "metric string, value double")
    base = spark.createDataFrame([("wer", 0.2), ("f1", 0.4), ("old", 1.0)], "metric string, value double")
    assert {r["metric"]: r["passed"] for r in evaluation.gate(cur, base, ["wer"]).collect()} == {"wer": False, "f1": True, "new": True, "old": True}


def test_hook_default_rejects(spark):
    df = spark.createDataFrame([("a",), ("b",)], "entity string")
    assert rows(linkage.with_hook(df, linkage.reject_all, "entity string, verdict string")) == [("a", "rejected"), ("b", "rejected")]


def test_file_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, " ")], "id long, name string")
    files.write_csv(df, str(tmp_path / "c"), ["name", "id"])
    assert rows(files.read_csv(spark, str(tmp_path / "c"), "name string, id long").na.fill("-")) == [("-", 2), ("a", 1)]
    for run in ("r1", "r2"):
        files.append_run(df.withColumn("name", F.lit(run)), str(tmp_path / "runs"), run)
    assert {r["name"] for r in files.latest_run(spark, str(tmp_path / "runs")).collect()} == {"r2"}
    for name in ("x/a.txt", "x/b.txt", "y/c.txt"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(name)
    found = files.newest(files.listing(spark, str(tmp_path / "t"), "*.txt")).collect()
    assert {r["folder"] for r in found} == {"x", "y"}
    assert [r["value"] for r in files.read_texts(spark, str(tmp_path / "t" / "y")).collect()] == ["y/c.txt"]
    runs = spark.createDataFrame([("s", "2024", "ok"), ("s", "2025", "failed"), ("t", None, None), ("t", "2026", "ok")], "slug string, run string, status string")
    assert {(r["slug"], r["run"]) for r in files.run_folders(runs).collect()} == {("s", "2024"), ("t", None)}
    names = spark.createDataFrame([("a.wav",), ("b.mp3",), ("a_skip.wav",)], "n string")
    assert rows(files.glob_filter(names, "n", ["*.wav"], ["*skip*"])) == [("a.wav",)]


def stream_of(spark, df, path, parts):
    for k, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run_stream(out, name, mode, spark):
    q = out.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_segment_stream_equals_batch(spark, tmp_path):
    pytest.importorskip("pandas")
    df = spark.createDataFrame([(1, 2, 1, "b"), (1, 1, 2, "a"), (1, 2, 3, "B"), (2, 1, 4, "x")], "session long, segment long, arrival long, text string")
    got = run_stream(streams.segments_stream(stream_of(spark, df, tmp_path / "m", [df.where("arrival <= 2"), df.where("arrival > 2")])), "segments", "update", spark)
    batch = {r["session"]: r["text"] for r in streams.segments_batch(df).collect()}
    assert batch == {1: "a B", 2: "x"}
    assert {(r["session"], r["text"]) for r in got.collect()} >= set(batch.items())


def test_stable_prefix_stream(spark, tmp_path):
    text = "abcdefghij" * 50
    df = spark.createDataFrame([(1, text[:200]), (1, text)], "session long, text string").withColumn("n", F.length("text"))
    s = stream_of(spark, df, tmp_path / "p", [df.where("n = 200"), df.where("n > 200")])
    got = run_stream(streams.stable_prefix_stream(s.select("session", "text"), least=100, tail=50), "prefixes", "append", spark).collect()
    cover = sorted((r["start"], r["chunk"]) for r in got)
    assert "".join(c for _, c in cover) == text[:450] and all(text[a:].startswith(c) for a, c in cover)


def test_every_query_is_registered_once():
    names = list(plans.queries())
    assert len(names) == len(set(names)) > 70 and set(plans.oracle_sql()) <= set(names)


def test_gates_and_picks(spark):
    c = spark.createDataFrame([(1, "Scan", "scan", 0.5, "local", 0.95, False), (1, "Scan", "scan", 0.9, "global", 0.95, False), (2, "dental panel", "panel of teeth", 0.4, "local", 0.5, False), (2, "rest", "panel of teeth", 0.9, "local", 0.99, False)], "mention long, name string, term string, score double, source string, certainty double, is_form boolean")
    assert [(r["mention"], r["source"]) for r in entities.fast_tracked(c).collect()] == [(1, "local")]
    assert sorted((r["mention"], r["name"], r["step"]) for r in entities.safe_context(c, []).collect()) == [(1, "Scan", 1), (2, "dental panel", 3)]
    assert [r["name"] for r in entities.forced_first(c, F.col("name") == "dental panel", 1).where("mention = 2").collect()] == ["dental panel"]
    assert entities.where_given(c, "mention", None).count() == 4 and entities.where_given(c, "mention", 2).count() == 2 and entities.where_given(c, "none", 2).count() == 4
    x = entities.with_presenting(spark.createDataFrame([("Symptom", ["presenting_complaint"]), ("ReasonForVisit", ["presenting_complaint"]), ("Diet", [])], "kind string, roles array<string>"))
    assert sorted(r["kind"] for r in x.collect()) == ["Diet", "ReasonForVisit", "ReasonForVisit", "Symptom"]


def test_names_go_in_as_whole_words(spark):
    pairs = [("a.b", "dot"), ("", "x"), (None, "y"), ("dot", "$1")]
    df = spark.createDataFrame([("A.b and axb, dot dots", pairs)], "t string, p array<struct<found:string,name:string>>")
    assert df.select(notes.with_names(F.col("t"), F.col("p"))).first()[0] == "$1 and axb, $1 dots"


def test_notes_edge_cases(spark):
    df = spark.createDataFrame([(None,), ("",), ("no heading",), ("PLAN: x\nplan: y\n\nObjective :\n z ",)], "t string")
    got = [r[0] for r in df.select(notes.sections(F.col("t"), ["Objective", "Plan"], "Objective")).collect()]
    assert got == [None, None, {"Objective": "no heading"}, {"Objective": "z", "Plan": "x"}]
    lines = spark.createDataFrame([(["", "Reminder to rest", "rest", "the", "an"],), ([],)], "l array<string>")
    assert [r[0] for r in lines.select(notes.without_near_duplicates(F.col("l"))).collect()] == [["rest", "the", "an"], []]
    assert [r[0] for r in df.select(notes.signalment_of(F.col("t"))).collect()] == ["", "", "", "Patient: Objective"]
    assert [tuple(r[0]) for r in df.select(notes.summary_and_rest(notes.with_summary(F.col("t"), F.lit(" s ")))).collect()] == [("s", ""), ("s", ""), ("s", "no heading"), ("s", "PLAN: x\nplan: y\n\nObjective :\n z")]


def test_signal_candidates_recall_by_sound_and_vector(spark):
    m = spark.createDataFrame([("nite owl",), ("zzz",), (None,)], "mention string")
    n = spark.createDataFrame([("knight owl",), ("physics",)], "name string")
    v = spark.createDataFrame([("zzz", "physics", 0.1)], "mention string, name string, distance double")
    got = {(r["mention"], r["name"]): r["match_score"] for r in retrieval.signal_candidates(m, n, v).collect()}
    assert set(got) == {("nite owl", "knight owl"), ("zzz", "physics")} and got["zzz", "physics"] == pytest.approx(0.9)


def test_phonetic_join_equals_comparing_all(spark):
    from weft.functions.phonetic import metaphone

    left, right = ["knight", "nite", "Smith", "physics", "", "ab12"], ["night", "smythe", "fysiks", "xyz", "apple", None]
    got = {(r["a"], r["b"]) for r in retrieval.phonetic_join(spark.createDataFrame([(x,) for x in left], "n string"), spark.createDataFrame([(x,) for x in right], "n string"), "n").collect()}
    assert got == {(a, b) for a in left for b in right if metaphone(a)[:4] and metaphone(a)[:4] == metaphone(b)[:4]}


def test_uncovered_carries_no_texts_and_broadcasts_none(spark):
    """Each word used to travel with its whole text, in a broadcast whose size the files' size did not tell."""
    issues = spark.createDataFrame([(1, "limping left"), (1, "itching"), (1, "vomits daily"), (2, "itching"), (3, "xyz")], "visit long, issue string")
    medicines = spark.createDataFrame([(1, "for limping"), (1, "the left one"), (1, "itching stops"), (1, "daily, if it vomits"), (2, None), (2, "limping left")], "visit long, medicine string")
    left = linkage.uncovered(issues, medicines, ["for"])
    assert sorted((r["visit"], r["issue"]) for r in left.collect()) == [(1, "limping left"), (2, "itching"), (3, "xyz")]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert not any("medicine" in line and "count" in line for line in plan.splitlines())
    for join in (x for x in left._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin" in x):
        assert "LeftAnti" in join


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_exact_knn_orders_copies_by_id_and_shuffles_no_pairs(spark, metric):
    """Scores used to be cut before they were rounded, and twice rounded; every pair of blocks went through a shuffle."""
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in base[i % 12] * (1 + (1e-12 * i if metric == "cosine" else 0))]) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = retrieval.exact_knn(df, df, "id", "v", 5, metric, block_rows=50, digits=5)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for i in range(240):
        copies = [j for j in range(i % 12, 240, 12) if j != i][:5]
        assert [got[i][r] for r in range(1, 6)] == copies
    assert "RoundRobin" not in found._jdf.queryExecution().sparkPlan().toString()
