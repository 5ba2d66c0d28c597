"""Plans whose cost once grew faster than their input."""

import random

from weft import plans
from weft.operators import attributes, automaton, edits, linkage

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def query_plan(spark, name):
    return plan_of(plans.queries()[name](spark, SF))


def test_alternatives_are_ranked_once_a_name_and_size(spark):
    assert "windowspecdefinition(id#" not in query_plan(spark, "alternatives_top3")


def test_searches_take_the_first_items_of_each_name_and_category(spark):
    for name in ("local_products", "local_service", "soft_gate_rank", "multi_signal_rerank"):
        assert "windowspecdefinition(name#" in query_plan(spark, name)


def test_link_cascade_drops_pairs_that_decide_nothing_before_they_are_ranked(spark):
    a = spark.createDataFrame([(1, 1, "abc tablet", "Drug", None, None)], "visit long, atom_id long, concept string, kind string, ref_id string, local_id long")
    m = spark.createDataFrame([(1, "E1", 1, "abd tablet", "x", "Medicine", 3), (1, "E2", 2, "zzzzzzzz tablet", "x", "Medicine", 3)], "visit long, entity_id string, pos long, name string, display string, kind string, local_id long")
    found = linkage.link_cascade(a, m)
    assert [tuple(r) for r in found.collect()] == [(1, "E1", 8)]
    assert "0.639999" in plan_of(found)


def test_link_cascade_shuffles_each_side_once_and_an_atom_once_a_task(spark):
    a = spark.createDataFrame([(1, k, "abc tablet", "Drug", None, None) for k in (1, 2, 2)], "visit long, atom_id long, concept string, kind string, ref_id string, local_id long")
    rows = [(1, "E1", 1, "Abd tablet", "x", "Medicine", 3), (1, "E1", 1, "abd tablet", "X", "Medicine", 3), (1, "E2", 2, "zzzzzzzz tablet", "x", "Medicine", 3)]
    m = spark.createDataFrame(rows, "visit long, entity_id string, pos long, name string, display string, kind string, local_id long")
    found = linkage.link_cascade(a, m)
    assert [tuple(r) for r in found.collect()] == [(1, "E1", 8)]  # rows of the manifest that are the same count once, those of an atom do not
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "Window" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shuffles = linkage.link_cascade(a, m)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert shuffles == 3


def test_attributes_are_checked_within_their_row(spark):
    schema = spark.createDataFrame([("Drug", "DOSE", "d", "5", True, "number"), ("Drug", "NOTE", "n", "x", True, None)], "source_kind string, relationship string, target_attribute string, use_case string, is_required boolean, value_type string")
    atoms = spark.createDataFrame([(1, "Drug", '{"DOSE": 2, "ODD": [1]}'), (2, "Drug", '{"DOSE": "x", "NOTE": null}'), (3, "Other", "[1]"), (4, "Drug", None)], "id long, kind string, payload string")
    out = attributes.checked(atoms, schema)
    got = {r["id"]: (r["numbers"], r["unknown"], r["wrong"], r["missing"], r["is_object"]) for r in out.collect()}
    assert got == {1: ({"DOSE": 2.0}, {"ODD": "[1]"}, [], ["NOTE"], True), 2: ({}, {}, ["DOSE"], ["DOSE", "NOTE"], True), 3: ({}, {}, [], [], False), 4: ({}, {}, [], ["DOSE", "NOTE"], False)}
    plan = plan_of(out)
    assert "Generate" not in plan and "Aggregate [id" not in plan


ATOM = "visit long, atom_id string, service_id long, stock_id long, dedup_key string, section string, concept string, kind string, source string"


def some_atoms(spark):
    rng = random.Random(7)
    names = ["".join(rng.choice("abcd") for _ in range(24)) for _ in range(4)]

    def concept():
        name = list(rng.choice(names))
        name[rng.randrange(len(name))] = rng.choice(["x", "", "yz"])
        return "".join(name)

    few = lambda *values: rng.choice([None, None, None, *values])
    rows = [(k % 2, f"{k:03d}", few(1), few(2), few("Key", "?"), rng.choice(["Plan", "Else"]), rng.choice([concept(), concept(), concept(), ""]), rng.choice(["drug", "odd"]), rng.choice([None, "a", " b", "c"])) for k in range(200)]
    return spark.createDataFrame(rows, ATOM)


def test_atoms_of_one_partition_a_visit_are_merged_without_another_shuffle(spark, monkeypatch):
    atoms = some_atoms(spark)
    out = linkage.atom_dedup(atoms.repartition("visit"), "visit")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    expected = rows(out)
    keys = [r[1].split(":")[0] for r in expected]
    assert {"svc", "stk", "key", "own", "like"} == set(keys) and any(r[1].startswith("like") and r[-1] > 1 and " | " in r[-2] for r in expected)
    monkeypatch.setattr(edits, "FEW_NAMES", 3)  # larger groups are joined
    assert rows(linkage.atom_dedup(atoms, "visit")) == expected


def test_atom_dedup_shuffles_its_lines_once(spark):
    physical = plans.queries()["atom_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in physical


def test_items_meet_the_answer_of_their_list_of_names_once(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(0, 4)))
    items = [(rng.choice([None, 1, 2, 3]), k, rng.choice([None, [], [rng.choice([None, word()]) for _ in range(rng.randint(1, 3))]])) for k in range(200)]
    items = spark.createDataFrame(items, "visit long, item long, names array<string>")
    atoms = spark.createDataFrame([(1 + k % 2, k, k, word()) for k in range(12)], "visit long, atom long, pos long, name string")
    near = automaton.matched_atoms(items, atoms)
    assert "Exchange hashpartitioning" not in near._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    expected = rows(near)
    assert len(expected) == 200 and {r[3] for r in expected} == {"equal", "inside", None} and all(r[3] is None for r in expected if r[0] in (None, 3))
    monkeypatch.setattr(automaton, "FEW_LISTS", 0)
    assert rows(automaton.matched_atoms(items, atoms)) == expected
