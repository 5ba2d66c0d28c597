"""Conversation repair against a search over all edit sequences that keeps the least string of each state."""

import hashlib
import random
import zlib

import pytest

from weft.llm import turns

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        if harm == 1:
            text = ""
        if harm == 2:
            text = "".join(c for c in text if c not in ".!?")
        if harm == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if harm == 3 else 1)
    return out


def plain_repair(rows):
    """``rows`` are (turn, role, text) of one conversation, in order."""
    seen, marks = set(), []
    blank = duplicate = truncated = 0
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, duplicate, truncated = blank + (fault == "blank"), duplicate + (fault == "duplicate"), truncated + (fault == "truncated")
        marks.append(fault)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def add(into, state, cost, audit, out):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, out)

    def inserted(at):
        for _ in range(4):
            for state, (cost, audit, out) in list(at.items()):
                for r in ("user", "assistant"):
                    if (to := step.get((state, r[0]))) is not None:
                        add(at, to, cost + 2, audit + "I", [*out, f"{r}:"])
        return at

    at = inserted({"0": (0, "", [])})
    for (_, role, text), fault in zip(rows, marks):
        new = {}
        for state, (cost, audit, out) in at.items():
            add(new, state, cost + 3, audit + "D", out)
            if fault in ("", "truncated"):
                more = fault == "truncated"
                if (to := step.get((state, role[:1]))) is not None:
                    add(new, to, cost + more, audit + "K", [*out, f"{role}:{text}"])
                for r in ("user", "assistant"):
                    if (to := step.get((state, r[0]))) is not None:
                        add(new, to, cost + 2 + more, audit + "R", [*out, f"{r}:{text}"])
        at = inserted(new)
    cost, audit, out = min(v for k, v in at.items() if k in ("0", "a"))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain(rows):
    kept = {}
    for r in plain_damage(rows):
        kept.setdefault(r[0], []).append(r[1:])
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: plain_repair(sorted(kept.get(c, []), key=order)) for c in {r[0] for r in rows}}


def generated(seed, n_conv, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "why?", "", None, " \n", "Go on!", "and so", "A. B", "C."]
    rows = []
    for c in range(n_conv):
        for t in range(rng.randint(0, longest)):
            turn = None if rng.random() < 0.05 else t + (rng.random() < 0.1) * rng.randint(-2, 3)
            rows.append((c if c else None, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "S"]), rng.choice(texts) if rng.random() < 0.5 else f"line {rng.randint(0, 99)}."))
    return rows


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize(("seed", "n_conv", "longest", "block"), [(1, 80, 12, 1024), (2, 60, 14, 2), (3, 3, 200, 5), (4, 1, 500, 1)])
def test_repair_equals_search_over_all_edits(spark, seed, n_conv, longest, block):
    rows = generated(seed, n_conv, longest)
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, audit string, block int")
    assert got(turns.repair_damaged(df, block)) == plain(rows)


def test_copies_ties_and_long_texts(spark):
    rows = [(5, 2, "user", "same?")] * 400 + [(5, 3, "assistant", "x" * 300_000 + "."), (5, 4, "user", "b."), (5, 4, "user", "a."), (6, None, None, None), (7, -(1 << 63), "user", "q?"), (7, (1 << 63) - 1, "assistant", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out, expected = got(turns.repair_damaged(df, 3)), plain(rows)
    assert out[7][0] is None and expected[7][0] > 1 << 63
    assert {k: v for k, v in out.items() if k != 7} == {k: v for k, v in expected.items() if k != 7} and out[7][1:] == expected[7][1:]


def test_nothing_to_repair(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair_damaged(empty).count() == 0
    dropped = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    out = got(turns.repair_damaged(spark.createDataFrame(dropped, "conv_id long, turn long, role string, text string")))
    assert dropped and set(out.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
