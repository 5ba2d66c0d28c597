"""Column functions against small independent oracles."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from weft.functions import jsonx, phonetic, text, vector
from weft.operators import chunking, evaluation, routing


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@pytest.mark.parametrize("a, b, want", [("word", "two words", 4 / 11), ("same", "same", 1.0), ("", "x", 0.0), (None, None, 0.0), ("a a a", "a", 1.0), ("...", "!!", 0.0)])
def test_trigram_similarity(spark, a, b, want):
    got = one(spark, [(a, b)], "a string, b string", text.trigram_similarity(F.col("a"), F.col("b")), text.trigram_similarity(F.col("b"), F.col("a")))[0]
    assert got == (pytest.approx(want), pytest.approx(want))


def test_jaro_winkler():
    assert phonetic.jaro_winkler("abcd", "axyz") == pytest.approx(0.55)
    assert phonetic.jaro_winkler("MARTHA", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert phonetic.jaro_winkler("", "x") == phonetic.jaro_winkler(None, "x") == 0.0
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in "ab")
        assert 0 <= phonetic.jaro_winkler(a, b) <= 1 and phonetic.jaro_winkler(a, a) == 1.0


@pytest.mark.parametrize(
    "word, key",
    [("GUMBO", "KM"), ("knight", "NFT"), ("physics", "FSKS"), ("school", "SKL"), ("judge", "JJ"), ("", ""), (None, ""), ("Xavier", "SFR"), ("whistle", "WSTL"), ("thumb", "0M"), ("Christ", "KRST"), ("church", "XRX"), ("science", "SNS"), ("nation", "NXN"), ("signed", "SNT"), ("gnome", "NM"), ("wrack", "RK"), ("aerial", "ERL"), ("accident", "AKSTNT"), ("watch", "WX"), ("badge", "BJ"), ("rough", "RF"), ("schwarz", "XWRS"), ("bigger", "BKR"), ("characterisation", "XRKTRSXN")],
)
def test_metaphone(word, key):
    assert phonetic.metaphone(word) == key


@pytest.mark.parametrize(
    "word, keys",
    [
        ("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")), ("Jose", ("HS", "HS")), ("Michael", ("MKL", "MXL")), ("Thomas", ("TMS", "TMS")), ("Church", ("XRX", "XRK")), ("Xavier", ("SF", "SFR")), ("Cabrillo", ("KPRL", "KPR")), ("Knight", ("NT", "NT")),
        ("Caesar", ("SSR", "SSR")), ("Edge", ("AJ", "AJ")), ("Edgar", ("ATKR", "ATKR")), ("Czerny", ("SRN", "XRN")), ("Filipowicz", ("FLPT", "FLPF")), ("Hugh", ("H", "H")), ("Laugh", ("LF", "LF")), ("Bough", ("P", "P")), ("Ghislane", ("JLN", "JLN")), ("gumbo", ("KMP", "KMP")),
        ("Jankelowicz", ("JNKL", "ANKL")), ("Wasserman", ("ASRM", "FSRM")), ("Arnow", ("ARN", "ARNF")), ("Breaux", ("PR", "PR")), ("Resnais", ("RSN", "RSNS")), ("Rogier", ("RJ", "RJR")), ("Bacchus", ("PKS", "PKS")), ("Accident", ("AKST", "AKST")), ("Focaccia", ("FKX", "FKX")),
        ("Sugar", ("XKR", "SKR")), ("Island", ("ALNT", "ALNT")), ("Thumb", ("0M", "TM")), ("Tagliaro", ("TKLR", "TLR")), ("Zhao", ("J", "J")), ("School", ("SKL", "SKL")), ("Bajador", ("PJTR", "PHTR")), ("Mac Caffrey", ("MKFR", "MKFR")), ("", ("", "")), (None, ("", "")),
    ],
)
def test_double_metaphone(word, keys):
    assert phonetic.double_metaphone(word) == keys


def test_levenshtein_ratio_and_overlap(spark):
    got = one(spark, [("kitten!", "sitting"), ("", "x")], "a string, b string", text.levenshtein_ratio(F.col("a"), F.col("b")), text.token_overlap(F.col("a"), F.col("b"), 1.0))
    assert got[0][0] == pytest.approx(1 - 3 / 7) and got[1] == (0.0, 1.0)


def test_acronyms(spark):
    rows = [("cbc", "complete blood count"), ("cc", "complete blood count"), ("bca", "complete blood count"), ("c", "cat"), (None, "x y")]
    assert [r[0] for r in one(spark, rows, "a string, b string", F.coalesce(text.acronym_of(F.col("a"), F.col("b")), F.lit(False)))] == [True, True, False, False, False]


def test_lists_and_anchors(spark):
    rows = [("1. give food\n2) rest", "[[E1|milk]] and [[E2|a b]]"), ("a; b;c", "none"), ("One. Two.", None), (None, "")]
    got = one(spark, rows, "a string, b string", text.list_items(F.col("a")), text.numbered(text.list_items(F.col("a"))), text.without_anchors(F.col("b")))
    assert got[0][0] == ["give food", "rest"] and got[0][1] == "1. give food\n2. rest" and got[0][2] == "milk and a b"
    assert got[1][0] == ["a", "b", "c"] and got[2][0] == ["One.", "Two."] and got[3][0] == []


def test_durations_and_instructions(spark):
    rows = [(12,), (3400,), (125000,), (None,)]
    assert [r[0] for r in one(spark, rows, "ms long", text.duration_text(F.col("ms")))] == ["12 ms", "3.4 s", "2 m 05 s", "-"]
    said = [("Morning",), ("morning/night",), ("at night",), (None,)]
    assert [r[0] for r in one(spark, said, "f string", text.frequency(F.col("f")))] == ["Morning", "Custom", "Night", "Custom"]


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([-1.0, 0.0], [1.0, 0.0])]
    got = one(spark, rows, "a array<float>, b array<float>", vector.cosine(F.col("a"), F.col("b")), vector.cosine_score(F.col("a"), F.col("b")), vector.to_literal(F.col("a"), 2))
    assert [round(r[0], 6) for r in got] == [0.707107, 0.0, 0.0, -1.0] and got[3][1] == 0.0 and got[0][2] == "[1.00,0.00]"
    assert one(spark, [("[1, 2.5]",), ("[]",)], "s string", vector.from_literal(F.col("s"))) == [([1.0, 2.5],), ([],)]


@pytest.mark.parametrize("raw, want", [('```json\n{"a": [1, 2,]}\n```', '{"a": [1, 2]}'), ('<think>{</think> x {"a": "b', '{"a": "b"}'), ("no json", None), (None, None), ('[{"a": 1}, {"b": ', '[{"a": 1}, {"b":null}]'), ('{"q": "a } \\" b"} tail', '{"q": "a } \\" b"}')])
def test_json_repair(raw, want):
    assert jsonx.repaired(raw) == want


def test_skeleton_and_hints(spark):
    rows = [("1 | spot | n | Drug | a,b", "x:0.5, y"), ("a|b", "")]
    got = one(spark, rows, "l string, h string", jsonx.skeleton_fields(F.col("l")), jsonx.hint_probabilities(F.col("h")))
    assert got[0][0][:5] == ["1", "spot", "n", "Drug", "a,b"] and len(got[0][0]) == 13 and got[1][0] is None
    assert [tuple(x) for x in got[0][1]] == [(0.5, "x"), (0.95, "y")] and got[1][1] == []


def test_chunks_cover_and_merge(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefgh ijk", k=n)) for n in (0, 1, 99, 100, 101, 180, 250, 1000, 1234)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string").select("id", F.explode(chunking.chunks(F.col("text"), 100, 40, 30)).alias("c")).select("id", F.col("c.start").alias("start"), F.col("c.text").alias("text"))
    for r in df.collect():
        assert texts[r["id"]][r["start"] :].startswith(r["text"])
    assert {r["id"]: r["text"] for r in chunking.merged(df, "id", "start", "text", 40).collect()} == dict(rows)
    for t in texts:
        assert "".join(t.split()) == "".join("".join(chunking.chunk_at_spaces(t, 50, 0)).split())
    assert chunking.merge_tokens(["we went to the", "To the, market today"], 5) == "we went to the market today"


def test_spans_and_injection():
    assert chunking.found_spans("a cat, a cat, a dog", ["cat", "cat", "dog", "cow"]) == [(2, 5), (9, 12), (16, 19), (0, 3)]
    assert chunking.injected("the old cats sleep", [("E1", "old cat"), ("E2", "cats"), ("E3", "sleeq")], 0.8) == "the [[E1|old cat]]s [[E3|slee]]p"
    where = chunking.closest_substring("medicine", "some medicin here", 0.8)
    assert difflib.SequenceMatcher(None, "some medicin here"[slice(*where)], "medicine").ratio() > 0.9


def test_alignment_equals_edit_distance():
    rng = random.Random(3)
    for _ in range(100):
        a, b = (rng.choices("abc", k=rng.randrange(0, 9)) for _ in "xy")
        hits, sub, dele, ins = evaluation.alignment(a, b)
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        assert sub + dele + ins == d[-1] and hits + sub + dele == len(a) and hits + sub + ins == len(b)


def test_kinds_and_routes(spark):
    rows = [("Drug/Substance",), ("vital-sign",), ("Lab_Test result",), ("weird kind",), ("",), (None,)]
    assert [r[0] for r in one(spark, rows, "k string", routing.canonical_kind(F.col("k")))] == ["Medication", "VitalSign", "Diagnostic", "Weird", "Other", "Other"]
    rows = [("Medication", "meds", []), ("Medication", "5 year old male dog", []), ("Medication", "x", ["dose"]), ("VitalSign", "omega chew tablet", []), ("VitalSign", "temp", []), ("Symptom", "pulse high", []), ("Symptom", "itch", []), ("Other", "x", [])]
    got = one(spark, rows, "k string, s string, a array<string>", routing.route(F.col("k"), F.col("s"), F.col("a")))
    assert [r[0] for r in got] == ["skip_vitals", "skip_signalment", "dual_sync", "dual_sync", "skip_vitals", "global_vitals", "skip_non_billable", "skip_other"]
