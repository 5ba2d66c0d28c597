"""Text normalisation, similarity and parsing as Column expressions (no Python per row).

Blank and null are one thing throughout: ``blank_to_null``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(blank_to_null(c) for c in cols))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# --- similarity -------------------------------------------------------------------------


def words(c: Column) -> Column:
    """Lower-cased ASCII letter and digit runs."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def trigrams(c: Column) -> Column:
    """Set of 3-grams of each word, padded with two blanks before and one behind."""

    def of(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words(c), of)))


def set_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_jaccard(trigrams(a), trigrams(b))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length after punctuation is dropped; 0 if either side is empty."""
    clean = lambda c: squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", ""))
    x, y = clean(a), clean(b)
    return F.when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def token_overlap(left: Column, right: Column, empty: float = 0.0) -> Column:
    """Shared distinct words over the left side's distinct words."""
    a, b = F.array_distinct(words(left)), F.array_distinct(words(right))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(empty)


def contains_either_way(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def acronym_of(short: Column, long: Column) -> Column:
    """Letters of ``short`` match initials of words of ``long`` in order; words may be skipped; 2 to 10 letters."""
    letters = F.regexp_replace(F.lower(short), "[^a-z]", "")
    initials = F.array_join(F.transform(words(long), lambda w: F.substring(w, 1, 1)), "")

    def step(rest: Column, letter: Column) -> Column:
        at = F.instr(rest, letter)
        return F.when(at > 0, F.substring(rest, at + 1, F.length(rest))).otherwise(F.lit(None))

    walked = F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), initials, step)
    return (F.length(letters).between(2, 10)) & walked.isNotNull()


# --- normalisers ------------------------------------------------------------------------


def category_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit("and")), "[^a-z0-9]+", " "))


def benchmark_text(c: Column, strip_punct: bool = True, numbers: bool = False) -> Column:
    out = F.lower(F.coalesce(c, F.lit("")))
    if strip_punct:
        out = F.regexp_replace(out, r"[.,;:!?\"'()\[\]{}]", "")
    if numbers:
        out = F.regexp_replace(out, "[0-9]+", "0")
    return squeeze(out)


def mention_key(c: Column, most: int = 200) -> Column:
    return F.substring(squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " ")), 1, most)


def slug(c: Column) -> Column:
    """File stem in lower case with runs of other characters as underscores."""
    stem = F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[^.]*$", "")
    return F.btrim(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), F.lit("_"))


def corrected(c: Column, corrections: dict[str, str]) -> Column:
    """Whole-word replacements, ignoring case, in the order given."""
    for wrong, right in corrections.items():
        c = F.regexp_replace(c, rf"(?i)\b{wrong}\b", right)
    return c


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def search_terms(span: Column, suffixes: list[str], synonyms: dict[str, str]) -> Column:
    """Ordered distinct search terms: the span, the span without a known suffix, with synonyms swapped in."""
    base = squeeze(F.lower(span))
    bare = F.regexp_replace(base, r"\s+(?:" + "|".join(suffixes) + ")$", "")
    return F.filter(F.array_distinct(F.array(base, bare, *(F.regexp_replace(bare, rf"\b{a}\b", b) for a, b in synonyms.items()))), lambda t: t != "")


def terms_with_hints(base: Column, explicit: Column, hints: Column, most: int = 5) -> Column:
    """Base terms, an explicit term and the likeliest hints (array of struct(p, hint)), distinct ignoring case."""
    best = F.transform(F.slice(F.reverse(F.array_sort(hints)), 1, most), lambda h: h["hint"])
    everything = F.concat(base, F.array(explicit), best)
    return F.array_distinct(F.filter(F.transform(everything, lambda t: squeeze(F.lower(t))), lambda t: t.isNotNull() & (t != "")))


# --- parsing and formatting -------------------------------------------------------------


def list_items(c: Column) -> Column:
    """Items of a list: lines, else inline numbers, else semicolons, else sentences; bullets and numbers stripped."""
    text = F.trim(F.coalesce(c, F.lit("")))
    parts = (
        F.when(F.contains(text, F.lit("\n")), F.split(text, r"\n+"))
        .when(text.rlike(r"^[0-9]+[.)] .* [0-9]+[.)] "), F.split(text, r"\s+(?=[0-9]+[.)] )"))
        .when(F.contains(text, F.lit(";")), F.split(text, ";"))
        .otherwise(F.split(text, r"(?<=[.!?])\s+"))
    )
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.trim(p), r"^(?:[0-9]+[.)]|[-*•])\s*", "")))
    return F.filter(bare, lambda p: p != "")


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def anchor_segments(c: Column) -> Column:
    """array<struct<id, text>> of [[E1|text]] tags in order."""
    tags = F.regexp_extract_all(c, F.lit(r"\[\[E[0-9]+\|[^\]]*\]\]"), F.lit(0))
    return F.transform(tags, lambda t: F.struct(F.regexp_extract(t, r"\[\[(E[0-9]+)\|", 1).alias("id"), F.regexp_extract(t, r"\|([^\]]*)\]\]", 1).alias("text")))


def without_anchors(c: Column) -> Column:
    return F.regexp_replace(c, r"\[\[E[0-9]+\|([^\]]*)\]\]", "$1")


def anchors_with_bars(c: Column) -> Column:
    """[[E1:text]] as [[E1|text]]."""
    return F.regexp_replace(c, r"\[\[(E[0-9]+):([^\]]*)\]\]", "[[$1|$2]]")


def speaker_turns(c: Column) -> Column:
    """array<struct<speaker, text>> from lines that start with V:, O: or U:."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), r"\n|(?<=\S) (?=[VOU]: )"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda x: F.struct(F.when(x.rlike("^[VOU]: "), F.substring(x, 1, 1)).otherwise("U").alias("speaker"), F.trim(F.regexp_replace(x, "^[VOU]: ", "")).alias("text")))


def duration_text(ms: Column) -> Column:
    """12 ms, 3.4 s or 2 m 05 s."""
    whole = F.floor(ms / 1000)
    return (
        F.when(ms.isNull(), "-")
        .when(ms < 1000, F.format_string("%d ms", ms.cast("long")))
        .when(ms < 60000, F.format_string("%d.%d s", whole, F.floor((ms % 1000) / 100)))
        .otherwise(F.format_string("%d m %02d s", F.floor(whole / 60), whole % 60))
    )


def shortened(c: Column, most: int, head: int, tail: int, marker: str = "\n[...]\n") -> Column:
    """Texts beyond ``most`` characters as head, marker and tail."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(marker), F.substring(c, -tail, tail)))


def section(c: Column, heading: str, headings: list[str]) -> Column:
    """Text between a heading line and the next known heading."""
    after = "|".join(headings)
    return F.trim(F.regexp_extract(c, rf"(?is)(?:^|\n){heading}:\s*(.*?)(?=\n(?:{after}):|$)", 1))


def frequency(c: Column) -> Column:
    x = F.lower(F.coalesce(c, F.lit("")))
    night = x.contains("night") | x.contains("evening")
    return (
        F.when(x.contains("/") | x.contains(" and ") | x.contains("&"), "Custom")
        .when(x.contains("morning") & night, "Custom")
        .when(x.contains("morning"), "Morning")
        .when(x.contains("afternoon"), "Afternoon")
        .when(night, "Night")
        .otherwise("Custom")
    )


def meal_instruction(c: Column) -> Column:
    x = F.lower(F.coalesce(c, F.lit("")))
    named = lambda w: x.contains(f"{w} meal") | x.contains(f"{w} food")
    return F.when(named("after"), "After meal").when(named("before"), "Before meal").when(named("with"), "With Meal").otherwise(F.coalesce(c, F.lit("")))


def labelled(parts: list[tuple[str, Column]], sep: str = " ") -> Column:
    """'Label: value.' for each value that is not blank."""
    return F.concat_ws(sep, *(F.when(blank_to_null(v.cast("string")).isNotNull(), F.concat(F.lit(f"{k}: "), F.trim(v.cast("string")), F.lit("."))) for k, v in parts))


def barcode_in(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(c, r"(?i)barcode:\s*([A-Za-z0-9 \-]+)", 1), "[^A-Za-z0-9]", ""), F.lit(""))


def batch_in(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)batch:\s*([A-Za-z0-9\-]+)", 1), F.lit(""))


def issue_tokens(c: Column, stop: list[str]) -> Column:
    """Distinct words of four letters or more outside a stop list."""
    return F.array_except(F.array_distinct(F.filter(words(c), lambda w: F.length(w) >= 4)), F.array(*map(F.lit, stop)))


def garbled_tokens(c: Column) -> Column:
    """Words of 12 or more letters with hardly a vowel, a sign of failed recognition."""
    long = F.filter(words(c), lambda w: F.length(w) >= 12)
    vowels = lambda w: F.length(F.regexp_replace(w, "[^aeiou]", ""))
    return F.array_distinct(F.filter(long, lambda w: vowels(w) <= F.greatest(F.lit(1), F.floor(F.length(w) / 5).cast("int"))))
