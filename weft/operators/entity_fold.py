"""Entities of one document that say the same: which of two are duplicates, and the fold that merges them.

The fold depends on order (by start, longer first), so a document's entities go through one
function; but an entity is compared only with kept ones that could be equal: those of
its ids, those of its kind or of signalment kinds that begin near enough, and those without a span.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.predicates import LONG_AGE, SHORT_AGE, SIGNALMENT_KINDS

# Intents that must not be merged with each other, by word or by part.
ORDERED, ORDERED_PARTS = ["ordered", "order", "planned", "prescribed", "to do"], ["order"]
HISTORY, HISTORY_PARTS = ["history", "past", "previous", "had", "done", "performed"], ["past", "history"]
# Attributes that name a body part or an intent, first filled one first, and kinds that body parts keep apart.
SITES = ["anatomy", "body_part", "target_site", "body_site", "site"]
INTENTS = ["intent", "status", "temporal"]
BY_SITE = ["procedure", "diagnostic", "diagnosis"]
# A severity within a name, and how far apart acronyms and severities may begin.
SEVERITY = r",?\s*grade\s*\d+"
ACRONYM_WITHIN, SEVERITY_WITHIN, ACRONYM_LENGTH = 200, 150, 10
IDS = ("concept_id", "service_id", "stock_id")
COLUMNS = ("kind", "name", "start", "stop", *IDS, "intent", "supporting", "attributes")


def filled(e: dict, keys: list[str]) -> str:
    return next((v.strip().lower() for k in keys if (v := e["attributes"].get(k)) and v.strip()), "")


def words_of(name: str) -> list[str]:
    return [w for w in re.split(r"[\s,]+", name.replace("-", " ").strip()) if len(w) > 1]


def letters_of(name: str) -> float:
    """How many words ``name`` needs to be an acronym of; infinity where it can be none."""
    n = len(name.replace("-", " ").replace(".", "").strip())
    return n if 0 < n <= ACRONYM_LENGTH else float("inf")


def is_acronym(short: str, long: str) -> bool:
    """The letters of ``short`` begin words of ``long``, in order; words may be skipped."""
    letters = short.replace("-", " ").replace(".", "").strip()
    words = words_of(long)
    if not letters or len(letters) > ACRONYM_LENGTH or len(words) < len(letters):
        return False
    rest = iter(words)
    return all(any(w[0] == c for w in rest) for c in letters)


def opposite(a: str, b: str) -> bool:
    of = lambda x, words, parts: x in words or any(p in x for p in parts)
    return bool(a and b) and ((of(a, ORDERED, ORDERED_PARTS) and of(b, HISTORY, HISTORY_PARTS)) or (of(b, ORDERED, ORDERED_PARTS) and of(a, HISTORY, HISTORY_PARTS)))


def same_patient_part(e: dict, k: dict) -> bool:
    ages = (re.match(SHORT_AGE, e["n"]) or re.match(LONG_AGE, e["n"])) and re.match(SHORT_AGE, k["n"])
    return e["k"] in SIGNALMENT_KINDS and k["k"] in SIGNALMENT_KINDS and (e["n"] in k["n"] or k["n"] in e["n"] or bool(ages))


def is_duplicate(e: dict, k: dict, within: int) -> bool:
    """``e`` says what the kept ``k`` says: by an id; else, unless intent or body part forbid it, by name, acronym, severity or signalment, near enough.

    Almost all pairs are of different names far from each other's likeness, so cheap comparisons come first; what
    forbids a merge is only asked of pairs that would merge.
    """
    if e["ids"] and k["ids"] and any(e[i] is not None and e[i] == k[i] for i in IDS):
        return True
    return says_same(e, k, within) and not forbidden(e, k)


def forbidden(e: dict, k: dict) -> bool:
    if opposite(intent_of(e), intent_of(k)):
        return True
    return bool(e["k"] == k["k"] and e["k"] in BY_SITE and (a := filled(e, SITES)) and (b := filled(k, SITES)) and a != b)


def says_same(e: dict, k: dict, within: int) -> bool:
    a, b = e["n"], k["n"]
    same_kind, placed, apart = e["k"] == k["k"], e["placed"] and k["placed"], abs(e["start"] - k["start"])
    if same_kind:
        if a == b and (not placed or (apart <= within and abs(e["stop"] - k["stop"]) <= within)):
            return True
        if placed and apart <= 2 * within and (a in b or b in a):
            return True
        if placed and apart <= ACRONYM_WITHIN and ((e["letters"] <= k["words"] and is_acronym(a, b)) or (k["letters"] <= e["words"] and is_acronym(b, a))):
            return True
        if placed and "diagnosis" in e["k"] and apart <= SEVERITY_WITHIN:
            a, b = (re.sub(SEVERITY, "", x["n"]).strip() for x in (e, k))
            if a in b or b in a:
                return True
    return e["k"] in SIGNALMENT_KINDS and (not placed or apart <= 3 * within) and same_patient_part(e, k)


def intent_of(e: dict) -> str:
    return next((v.strip().lower() for k in INTENTS if (v := e["attributes"].get(k))), (e["intent"] or "").strip().lower())


def prepared(row: dict) -> dict:
    e = {c: (None if row[c] is None or row[c] != row[c] else row[c]) for c in COLUMNS if c != "attributes"}
    given = row["attributes"]
    e["attributes"] = dict(given) if given is not None and given == given else {}
    e["start"], e["stop"] = int(e["start"] or 0), int(e["stop"] or 0)
    e["k"], e["n"] = (e["kind"] or "Other").strip().lower(), (e["name"] or "").strip().lower()
    e["placed"], e["mentions"] = e["stop"] > e["start"] >= 0, 1
    e["ids"] = any(e[i] is not None for i in IDS)
    # an acronym needs as many words as it has letters: counts rule most pairs out
    e["letters"], e["words"] = letters_of(e["n"]), len(words_of(e["n"]))
    return e


def folded(rows: list[dict], within: int) -> list[dict]:
    """The kept entities, in order; what they lack of attributes and supporting text comes from their duplicates."""
    reach = max(3 * within, ACRONYM_WITHIN)
    kept: list[dict] = []
    starts: dict[str, list[int]] = {}  # kind -> starts of its kept entities, rising
    numbers: dict[str, list[int]] = {}
    unplaced: dict[str, list[int]] = {}
    by_id: dict[tuple, list[int]] = {}
    for e in sorted(map(prepared, rows), key=lambda e: (e["start"], -len(e["name"] or ""), e["name"] or "", e["k"])):
        kinds = {e["k"], *(SIGNALMENT_KINDS if e["k"] in SIGNALMENT_KINDS else [])}
        near: set[int] | list[int] = {i for c in IDS if e[c] is not None for i in by_id.get((c, e[c]), ())}
        if len(kinds) == 1 and not near and e["placed"] and e["k"] not in unplaced:  # rising already
            near = numbers.get(e["k"], [])[bisect.bisect_left(starts.get(e["k"], []), e["start"] - reach) :]
            kinds = set()
        for kind in kinds:
            if e["placed"]:
                near.update(numbers.get(kind, [])[bisect.bisect_left(starts.get(kind, []), e["start"] - reach) :])
                near.update(unplaced.get(kind, ()))
            else:
                near.update(numbers.get(kind, ()))
        match = next((i for i in (sorted(near) if isinstance(near, set) else near) if is_duplicate(e, kept[i], within)), None)
        if match is None:
            i = len(kept)
            kept.append(e)
            starts.setdefault(e["k"], []).append(e["start"])
            numbers.setdefault(e["k"], []).append(i)
            if not e["placed"]:
                unplaced.setdefault(e["k"], []).append(i)
            for c in IDS:
                if e[c] is not None:
                    by_id.setdefault((c, e[c]), []).append(i)
            continue
        k = kept[match]
        k["mentions"] += 1
        for name, value in e["attributes"].items():
            if value and value.strip() and not (k["attributes"].get(name) or "").strip():
                k["attributes"][name] = value
        if not (k["supporting"] or "").strip() and (e["supporting"] or "").strip():
            k["supporting"] = e["supporting"]
    return kept


def entity_dedup(entities: DataFrame, key: str, within: int = 80) -> DataFrame:
    """Entities of each document (COLUMNS) with duplicates across chunks merged, and the number of ``mentions`` of each."""
    given = dict(entities.dtypes)
    shape = ", ".join(f"{c} {given[c]}" for c in (key, *COLUMNS))

    def one(table: pa.Table) -> pa.Table:
        kept = folded(table.select(list(COLUMNS)).to_pylist(), within)
        columns = [pa.array([table[key][0].as_py()] * len(kept), table.schema.field(key).type)]
        kind = lambda c: pa.map_(pa.string(), pa.string()) if c == "attributes" else table.schema.field(c).type
        columns += [pa.array([list(e[c].items()) if c == "attributes" else e[c] for e in kept], kind(c)) for c in COLUMNS]
        return pa.table([*columns, pa.array([e["mentions"] for e in kept], pa.int64())], [key, *COLUMNS, "mentions"])

    return entities.select(key, *COLUMNS).groupBy(key).applyInArrow(one, f"{shape}, mentions long")
