"""The fold of entities against comparing each with all kept ones, and its rules one by one."""

import random

import pytest

from weft.operators import entity_fold as ef


def entity(name, start, kind="Symptom", stop=None, **more):
    return dict.fromkeys(ef.COLUMNS) | {"kind": kind, "name": name, "start": start, "stop": start + len(name) if stop is None else stop, "attributes": {}} | more


def against_all(rows, within):
    """The same fold without candidates: every kept entity is looked at."""
    kept = []
    for e in sorted(map(ef.prepared, rows), key=lambda e: (e["start"], -len(e["name"] or ""), e["name"] or "", e["k"])):
        k = next((k for k in kept if ef.is_duplicate(e, k, within)), None)
        if k is None:
            kept.append(e)
            continue
        k["mentions"] += 1
        for name, value in e["attributes"].items():
            if (value or "").strip() and not (k["attributes"].get(name) or "").strip():
                k["attributes"][name] = value
        if not (k["supporting"] or "").strip():
            k["supporting"] = e["supporting"] if (e["supporting"] or "").strip() else k["supporting"]
    return kept


def test_candidates_miss_nothing():
    rng = random.Random(1)
    for _ in range(150):
        rows = []
        for _ in range(rng.randint(0, 40)):
            start = rng.choice([0, rng.randint(0, 900)])
            attributes = {rng.choice(["anatomy", "intent", "x", "site"]): rng.choice(["left", "past", "ordered", " ", "b"]) for _ in range(rng.randint(0, 2))}
            rows.append(
                entity(
                    rng.choice(["pain", "abdominal pain", "fho", "femoral head ostectomy", "hip dysplasia", "hip dysplasia, grade 3", "5yo", "5-year-old dog", "oreo", ""]),
                    start, rng.choice(["Symptom", "Procedure", "Diagnosis", "Patient", "Other", None]), stop=rng.choice([None, None, 0]), service_id=rng.choice([None, None, None, 1, 2]),
                    intent=rng.choice([None, "", "history", "planned"]), supporting=rng.choice([None, " ", "s"]), attributes=attributes,
                )
            )
        assert ef.folded([dict(r, attributes=dict(r["attributes"])) for r in rows], 80) == against_all([dict(r, attributes=dict(r["attributes"])) for r in rows], 80)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (entity("pain", 0), entity("Pain", 80), True), (entity("pain", 0), entity("pain", 161), False), (entity("pain", 0), entity("pain", 900, stop=0), True),
        (entity("abdominal pain", 0), entity("pain", 160), True), (entity("abdominal pain", 0), entity("pain", 161), False), (entity("pain", 0), entity("pain", 5, kind="Procedure"), False),
        (entity("FHO", 0), entity("femoral head and neck ostectomy", 200), True), (entity("FHO", 0), entity("femoral head and neck ostectomy", 201), False),
        (entity("x", 0, service_id=3), entity("y", 999, kind="Other", service_id=3), True), (entity("x", 0, service_id=3), entity("x", 1, service_id=4), True),
        (entity("scan", 0, intent="ordered"), entity("scan", 1, intent="past"), False), (entity("scan", 0, "Procedure", attributes={"anatomy": "left"}), entity("scan", 1, "Procedure", attributes={"site": "Right "}), False),
        (entity("severe hip dysplasia", 0, "Diagnosis"), entity("hip dysplasia, grade 3", 150, "Diagnosis"), True), (entity("5yo", 0, "Patient"), entity("6y", 200, "Other"), True), (entity("5yo", 0, "Patient"), entity("6y", 241, "Other"), False),
    ],
)
def test_rules(a, b, same):
    assert ef.is_duplicate(ef.prepared(b), ef.prepared(a), 80) is same


def test_attributes_are_folded_by_document(spark):
    rows = [(d, "Symptom", n, s, s + 4, None, None, None, None, t, a) for d in (1, 2) for n, s, t, a in (("pain", 0, None, {"side": " ", "old": "1"}), ("pain", 9, "said so", {"side": "left", "old": "2"}), ("itch", 5, None, None))]
    shape = "doc long, kind string, name string, start long, stop long, concept_id long, service_id long, stock_id long, intent string, supporting string, attributes map<string,string>"
    got = sorted((r["doc"], r["name"], r["mentions"], r["supporting"], tuple(sorted(r["attributes"].items()))) for r in ef.entity_dedup(spark.createDataFrame(rows, shape), "doc").collect())
    assert got == [x for d in (1, 2) for x in ((d, "itch", 1, None, ()), (d, "pain", 2, "said so", (("old", "1"), ("side", "left"))))]


def test_pairs_of_different_names_ask_for_no_intent_and_no_words(monkeypatch):
    """A window of some hundred entities used to have names split and intents looked up at every pair."""
    asked = []
    for name in ("intent_of", "is_acronym", "filled"):
        f = getattr(ef, name)
        monkeypatch.setattr(ef, name, lambda *a, f=f: (asked.append(1), f(*a))[1])
    rows = [{c: None for c in ef.COLUMNS} | {"kind": "Symptom", "name": f"strangeword{i:03d}x", "start": i, "stop": i + 9, "attributes": {}} for i in range(200)]
    assert len(ef.folded(rows, 80)) == 200 and not asked
