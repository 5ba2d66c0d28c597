"""Parsing and shaping of notes: sections, lists, vitals, signalment, summaries, payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import is_signalment_value_empty, lowered
from .text import blank_to_null, list_items, numbered, words

# Vitals by label, key and unit, in the order of display.
VITALS = [
    ("Body Weight", "body_weight", "kg"),
    ("Body Temperature", "body_temperature", "°F"),
    ("Heart Rate", "heart_rate", "bpm"),
    ("Respiratory Rate", "respiratory_rate", "brpm"),
    ("Capillary Refill Time", "capillary_refill_time", "seconds"),
    ("Mucous Membrane Color", "mucous_membrane_color", ""),
    ("Body Condition Score", "body_condition_score", "Scale"),
    ("Pain Score", "pain_score", "scale"),
    ("Mentation", "mentation", "Status"),
    ("Hydration Status", "hydration_status", "level"),
    ("Pulse Quality", "pulse_quality", "Quality"),
]
WHITE = " \t\n\r"
# Words that don't tell lines apart.
STOP = ["the", "a", "an", "to", "for", "of", "and", "or", "if", "any", "in"]
# Marks around a summary.
SUMMARY = ("[LONG_TRANSCRIPT_SUMMARY]", "[/LONG_TRANSCRIPT_SUMMARY]")
# Capitalised words that are no names, words cut out of a breed, and words that are no breed.
NOT_NAMES = ["the", "this", "that", "there", "here", "what", "when", "where", "who", "how"]
NOT_IN_BREEDS = ["right", "left", "side", "hip", "leg", "knee"]
NOT_BREEDS = ["dog", "cat", "pet"]
# Patterns of a patient's name, age, sex and breed, and how far into the text each is looked for.
NAME_PATTERN = r"\b([A-Z][a-z]{2,})\b"
AGE_PATTERN = r"(?i)\b(\d{1,2})\s*(?:year|yr|years|yrs?)\s*old\b"
SEX_PATTERN = r"(?i)\b(male|female|m|f)\b"
BREED_PATTERN = r"\b\d{1,2}\s*(?:year|yr|years|yrs?)\s*old(?:\s*(?:male|female|m|f))?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,1})\b"
NAME_WITHIN, SIGNS_WITHIN = 500, 2000
#: (within, pattern, cut, rejected, written as, suffix) of each part, in order.
SIGNALMENT = [
    (NAME_WITHIN, NAME_PATTERN, [], NOT_NAMES, {}, ""),
    (SIGNS_WITHIN, AGE_PATTERN, [], [""], {}, "yo"),
    (SIGNS_WITHIN, SEX_PATTERN, [], [""], {"m": "male", "male": "male", "f": "female", "female": "female"}, ""),
    (SIGNS_WITHIN, BREED_PATTERN, NOT_IN_BREEDS, NOT_BREEDS, {}, ""),
]


def sections(c: Column, names: list[str], otherwise: str) -> Column:
    """map<name, text> of a note with heading lines "Name:"; the first of equal headings counts; a note without any is all ``otherwise``."""
    text = F.btrim(F.coalesce(c, F.lit("")), F.lit(WHITE))
    heading = r"(?im)^[ \t]*(" + "|".join(names) + r")[ \t]*:\s*"
    found = F.transform(F.regexp_extract_all(text, F.lit(heading), F.lit(1)), lambda x: F.lower(x))
    parts = F.transform(F.split(text, heading), lambda p: F.btrim(p, F.lit(WHITE)))
    # a heading at the very beginning leaves an empty first part
    value = lambda n: F.get(parts, F.array_position(found, F.lit(n.lower())).cast("int"))
    held = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.when(F.array_contains(found, n.lower()), value(n)) for n in names)))
    alone = F.map_from_arrays(F.array(F.lit(otherwise)), F.array(text))
    return F.when(text == "", F.lit(None)).when(F.size(found) == 0, alone).otherwise(F.map_filter(held, lambda _, v: v.isNotNull()))


def core(note: Column, names: list[str]) -> Column:
    """The filled sections in the order of ``names``, each under its name."""
    return F.concat_ws("\n\n", *(F.when(F.coalesce(note[n], F.lit("")) != "", F.concat(F.lit(f"{n}:\n"), note[n])) for n in names))


def diagnosis_lines(c: Column) -> Column:
    """Lines without their numbers; those that say "unknown-not specified" go; a text of nothing else stays as it is."""
    text = F.trim(F.coalesce(c, F.lit("")))
    lines = F.filter(F.transform(F.split(text, r"\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[0-9]+[.)]\s*", ""))), lambda x: x != "")
    kept = F.filter(lines, lambda x: ~F.contains(F.lower(x), F.lit("unknown-not specified")))
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(kept) == 0, F.array(text)).otherwise(kept)


def diagnosis_text(primary: Column, secondary: Column, legacy: Column | None = None) -> Column:
    """One string of both diagnoses; a legacy field stands in for a blank primary one."""
    p = F.coalesce(blank_to_null(primary), blank_to_null(legacy)) if legacy is not None else blank_to_null(primary)
    s = blank_to_null(secondary)
    return F.coalesce(F.when(p.isNotNull() & s.isNotNull(), F.concat(p, F.lit("; Secondary: "), s)), p, s, F.lit(""))


def without_near_duplicates(items: Column, least: float = 0.7) -> Column:
    """Items in order; of two that share ``least`` of the smaller one's telling words the longer stays, in the first one's place."""
    key = lambda x: F.array_except(F.array_distinct(words(x)), F.array(*map(F.lit, STOP)))

    def alike(a: Column, b: Column) -> Column:
        x, y = key(a), key(b)
        few = F.least(F.size(x), F.size(y))
        return (few > 0) & (F.size(F.array_intersect(x, y)) >= F.lit(least) * few)

    def step(out: Column, item: Column) -> Column:
        at = F.array_position(F.transform(out, lambda p: alike(p, item)), True)
        longer = F.transform(out, lambda p, i: F.when((i + 1 == at) & (F.length(item) > F.length(p)), item).otherwise(p))
        return F.when(at == 0, F.concat(out, F.array(item))).otherwise(longer)

    bare = F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(F.trim(x), "(?i)^(?:reminder to |remind (?:the owner to |to ))", ""))), lambda x: x != "")
    return F.aggregate(bare, F.array().cast("array<string>"), step)


def merged_reminders(*fields: Column) -> Column:
    """The items of all fields, near duplicates dropped, numbered."""
    return numbered(without_near_duplicates(F.flatten(F.array(*(list_items(f) for f in fields)))))


def vitals_of(c: Column) -> Column:
    """map<key, value> of the filled vitals in a JSON object or in lines "Label: value"; the last line of a label counts."""
    text = F.trim(F.coalesce(c, F.lit("")))
    as_json = text.startswith("{")

    def value(label: str, key: str) -> Column:
        lines = F.regexp_extract_all(text, F.lit(rf"(?im)^[ \t]*(?:{label}|{key})[ \t]*:[ \t]*(\S[^\n]*?)[ \t]*$"), F.lit(1))
        own = F.when(as_json, F.trim(F.get_json_object(text, f"$.{key}"))).otherwise(F.try_element_at(lines, F.lit(-1)))
        return F.when(as_json & is_signalment_value_empty(own), F.lit(None)).otherwise(own)

    every = F.map_from_arrays(F.array(*(F.lit(k) for _, k, _ in VITALS)), F.array(*(value(label, k) for label, k, _ in VITALS)))
    return F.map_filter(every, lambda _, v: v.isNotNull() & (v != ""))


def vitals_rows(vitals: Column) -> Column:
    """array<struct<field, value, unit>> of the filled vitals in the order of display."""
    rows = F.array(*(F.struct(F.lit(label).alias("field"), vitals[k].alias("value"), F.lit(unit).alias("unit")) for label, k, unit in VITALS))
    return F.filter(rows, lambda r: r["value"].isNotNull())


def signalment_of(c: Column) -> Column:
    """"Patient: ..." from what the beginning of a transcript says, empty if nothing; the beginning is the feature.

    Each row of ``SIGNALMENT`` is one part: where to look, what to look for, what to cut out of it,
    what it must not be, and how it is written.
    """
    text = F.coalesce(c, F.lit(""))

    def part(head: int, pattern: str, cut: list[str], rejected: list[str], shown: dict[str, str], suffix: str) -> Column:
        raw = F.regexp_extract(F.substring(text, 1, head), pattern, 1)
        left = F.array_join(F.filter(F.split(raw, r"\s+"), lambda w: ~F.lower(w).isin(cut)), " ") if cut else raw
        written = F.try_element_at(F.create_map(*(F.lit(x) for kv in shown.items() for x in kv)), F.lower(left)) if shown else F.concat(left, F.lit(suffix))
        return F.when((left != "") & ~F.lower(left).isin(rejected), written)

    parts = F.array_compact(F.array(*(part(*row) for row in SIGNALMENT)))
    low = F.transform(parts, F.lower)
    once = F.filter(parts, lambda p, i: F.array_position(low, F.lower(p)) == i + 1)
    return F.when(F.size(once) > 0, F.concat(F.lit("Patient: "), F.array_join(once, ", "))).otherwise("")


def with_header(c: Column, header: Column) -> Column:
    return F.when(F.coalesce(header, F.lit("")) == "", c).otherwise(F.concat(header, F.lit("\n\n"), c))


def with_summary(c: Column, summary: Column) -> Column:
    own = blank_to_null(summary)
    return F.when(own.isNull(), c).otherwise(F.trim(F.concat(F.lit(SUMMARY[0] + "\n"), own, F.lit("\n" + SUMMARY[1] + "\n\n"), F.coalesce(c, F.lit("")))))


def summary_and_rest(c: Column) -> Column:
    """struct(summary, rest): the first marked summary, null without one, and the text without it."""
    text = F.coalesce(c, F.lit(""))
    a, b = F.instr(text, SUMMARY[0]), F.instr(text, SUMMARY[1])
    there = (a > 0) & (b > a)
    inside = F.btrim(F.substring(text, a + len(SUMMARY[0]), b - a - len(SUMMARY[0])), F.lit(WHITE))
    rest = F.btrim(F.concat(F.substring(text, F.lit(1), a - 1), F.substring(text, b + len(SUMMARY[1]), F.length(text))), F.lit(WHITE))
    return F.struct(F.when(there, F.nullif(inside, F.lit(""))).alias("summary"), F.when(there, rest).otherwise(text).alias("rest"))


def failure_of(note: Column, filled: list[Column]) -> Column:
    """Why a note is no real one: an error text, nothing at all, or none of the main sections; null if it is one."""
    text = F.trim(F.coalesce(note, F.lit("")))
    main = F.lit(False)
    for f in filled:
        main = main | (F.coalesce(f, F.lit("")) != "")
    wrong = lowered(note).rlike("^(?:error generating soap|error:)")
    return F.when(wrong, text).when(text == "", "empty note").when(~main, "no main section")


def labelled_inputs(parts: list[tuple[str, Column]]) -> Column:
    """The inputs that are there, each under its title, with a line feed at the end; empty if none is."""
    body = F.concat_ws("\n\n", *(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"**{t}:**\n"), v)) for t, v in parts))
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def with_names(note: Column, pairs: Column) -> Column:
    """A note with each pair's ``found`` text replaced by its ``name``, one pair after the other, as whole words and ignoring case."""
    quoted = lambda p: F.concat(F.lit(r"(?i)\b\Q"), p["found"], F.lit(r"\E\b"))
    return F.aggregate(pairs, note, lambda t, p: F.when(F.coalesce(p["found"], F.lit("")) == "", t).otherwise(F.regexp_replace(t, quoted(p), F.replace(p["name"], F.lit("$"), F.lit(r"\$")))))


def embedding_text(c: Column) -> Column:
    """White space squeezed, stray full stops joined to the word before."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), r"(?: \.)+(?= |$)", "."))
