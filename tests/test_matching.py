"""Matching of names: automata, edit distances, clusters, containment, closest substrings."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weft.functions import products, reminders
from weft.operators import automaton, chunking, edits, retrieval

LETTERS = "abc "


def words(rng, n, longest):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_first_atom_inside_equals_all_pairs():
    rng = random.Random(1)
    for _ in range(200):
        items, atoms = words(rng, 8, 6), list(enumerate(words(rng, 8, 6)))
        expected = {i: min(at for at, a in atoms if a in i or i in a) for i in items if any(a in i or i in a for _, a in atoms)}
        assert dict(automaton.first_inside(items, atoms)) == expected


def test_atoms_of_visits_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(automaton, "BLOCK_NAMES", 4)
    rng = random.Random(2)
    items = [(v, 100 * v + k, [rng.choice([None, " ", *words(rng, 1, 5)]) for _ in range(3)]) for v in range(3) for k in range(20)]
    atoms = [(v, 1000 * v + k, k, w) for v in (0, 2) for k, w in enumerate(words(rng, 15, 7))]
    key = lambda x: " ".join((x or "").lower().split())
    expected = {}
    for v, item, names in items:
        known = {}
        for _, atom, _, name in [a for a in atoms if a[0] == v and key(a[3])]:
            known[key(name)] = atom
        keys = [key(x) for x in names if key(x)]
        equal = next((known[x] for x in keys if x in known), None)
        inside = next((a for x in keys for k, a in known.items() if x in k or k in x), None)
        expected[item] = (equal, "equal") if equal is not None else (inside, "inside") if inside is not None else (None, None)
    got = automaton.matched_atoms(spark.createDataFrame(items, "visit long, item long, names array<string>"), spark.createDataFrame(atoms, "visit long, atom long, pos long, name string"))
    assert {r["item"]: (r["atom"], r["how"]) for r in got.collect()} == expected


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


@pytest.mark.parametrize("least", [0.9, 0.72])
def test_edit_pairs_and_clusters_equal_all_pairs(spark, least):
    rng = random.Random(3)
    names = []
    for seed in words(rng, 12, 28):
        for _ in range(6):
            w = list(seed)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "bc"])
            names.append("".join(w))
    rows = [(k % 2, n, f"{k:04d}") for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "g long, n string, at string")
    ratio = lambda a, b: 1 - distance(a, b) / max(len(a), len(b))
    distinct = sorted({(g, n) for g, n, _ in rows if n})
    expected = {(g, a, b) for g, a in distinct for h, b in distinct if g == h and a < b and ratio(a, b) >= least}
    assert {(r["g"], r["a"], r["b"]) for r in edits.edit_pairs(df, ["g"], "n", least).collect()} == expected and expected
    leaders, of = {0: [], 1: []}, {}
    for g, n, _ in rows:
        if n and (g, n) not in of:
            of[g, n] = next((h for h in leaders[g] if ratio(h, n) >= least), n)
            if of[g, n] == n:
                leaders[g].append(n)
    assert {(r["g"], r["n"]): r["leader"] for r in edits.clusters(df, ["g"], "n", "at", least).collect()} == of


def test_contained_names_equal_all_pairs(spark):
    names = sorted(set(words(random.Random(4), 150, 7)))
    got = {r[0] for r in retrieval.contained_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {n for n in names if any(n != o and n in o for o in names)}


def test_closest_substring_equals_all_windows():
    rng = random.Random(5)
    compared = 0
    for k in range(250):
        needle = "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 14)))
        hay = "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60)))
        if k % 2:
            w = list(needle)
            w[rng.randrange(len(w))] = rng.choice(["", "z", "ab"])
            at = rng.randint(0, len(hay))
            hay = hay[:at] + "".join(w) + hay[at:]
        least, n, best = rng.choice([0.6, 0.75, 0.88]), len(needle), None
        if n <= len(hay):
            for w in range(max(2, n // 2), min(int(n * 1.5) + 2, len(hay)) + 1):
                for i in range(len(hay) - w + 1):
                    r = SequenceMatcher(None, needle, hay[i : i + w]).ratio()
                    if r >= least and (best is None or r > best[0]):
                        best = (r, i, i + w)
        compared += best is not None
        assert chunking.closest_substring(needle, hay, least) == (best and best[1:])
    assert compared > 50


def test_windows_grow_with_the_text():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(40_000))
    sizes = list(range(16, 26))
    short, long = (len(chunking.proposed_windows("tick and flea control", text[:n], sizes, 0.88)) for n in (20_000, 40_000))
    assert long < 3 * short + 100 and long < 20_000


def test_reminders_and_products_of_the_self_check(spark):
    rows = [("Recheck", "3 days", "Scheduled"), ("Watch appetite", None, "Reminder"), ("Avoid high-impact exercises", None, "Scheduled")]
    df = spark.createDataFrame(rows, "name string, due string, intent string")
    none = F.lit(None).cast("string")
    assert [r[0] for r in df.select(reminders.needs_action(F.col("name"), none, none, F.col("due"), F.col("intent"), none)).collect()] == [True, False, False]
    got = [r[0] for r in spark.createDataFrame([("hip dysplasia",), ("Atopy",), (" ",), (None,), ("cough",)], "i string").select(products.therapeutic_query(F.col("i"))).collect()]
    assert got == ["hip dysplasia joint pain medication supplement", "Atopy dermatology medication", "", "", "cough medication treatment"]
