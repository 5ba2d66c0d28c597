"""Gates before a mention binds to a concept of the general knowledge base alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions import text
from .decision import decision_flow
from .relational import best_per_key

# Species that a concept may only name if the mention does.
SPECIES = ["cattle", "bovine", "equine", "horse", "porcine", "swine", "ovine", "caprine", "goat", "sheep"]
# Words that together tell a preventive intent, and the kinds of concept it must not bind to.
PREVENTION, PARASITES = ["control", "prevention", "prevent", "protection"], ["tick", "flea", "parasite", "deworm", "worm"]
CONDITIONS = ["Condition", "Disease"]
# Kinds of mention that never are a part of the body, and kinds whose search term must resemble the concept.
NOT_ANATOMY = ["exercise", "treatment", "therapy", "supplement", "nutrition", "parasite", "vaccination"]
TESTED_KINDS = ["procedure", "diagnostictest", "diagnostic"]
LEAST_TESTED, LEAST_SHARED = 0.35, 0.25


def low(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def holds(c: Column, values: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, values)), lambda v: F.contains(low(c), v))


def unsafe_species(name: Column, query: Column) -> Column:
    return F.exists(F.array(*map(F.lit, SPECIES)), lambda v: F.contains(low(name), v) & ~F.contains(low(query), v))


def is_preventive(query: Column) -> Column:
    return holds(query, PREVENTION) & holds(query, PARASITES)


def shared_part(a: Column, b: Column, least_length: int = 1) -> Column:
    """Part of the distinct words of ``a`` that ``b`` has; 0 if ``a`` has none."""
    of = lambda c: F.array_distinct(F.filter(text.words(c), lambda w: F.length(w) >= least_length))
    return F.coalesce(F.size(F.array_intersect(of(a), of(b))) / F.nullif(F.size(of(a)), F.lit(0)), F.lit(0.0))


def either_holds(a: Column, b: Column) -> Column:
    return F.contains(low(a), low(b)) | F.contains(low(b), low(a))


def tests_differ(kind: Column, term: Column, name: Column) -> Column:
    """A procedure or test whose search term shares too few of its words with the concept."""
    return low(kind).isin(TESTED_KINDS) & (low(term) != "") & (low(name) != "") & (shared_part(term, name, 2) < LEAST_TESTED)


def guarded(candidates: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(mention, verdict, concept, display_name): the candidate that the gates without a judge choose, else the best, if it is safe.

    ``candidates``: mention, span, search_term, normalized, kind, concept, name, concept_kind, score,
    trigram, phonetic, vector.  Verdicts, the first that holds: below_threshold, needs_judge
    (a test that reads differently), species, preventive, anatomy, unrelated, bound.  The
    name shown is the concept's only if one of both names holds the other.
    """
    flow = decision_flow(candidates.select(F.col("mention").alias("entity"), F.col("span").alias("mention"), "kind", F.col("concept").alias("id"), "name", "trigram", "phonetic", "vector", F.col("score").alias("match_score"), F.lit(False).alias("relevant")), judged=False, t=t)
    chosen = candidates.join(flow.select(F.col("entity").alias("mention"), "chosen_id"), "mention")
    best = best_per_key(chosen, ["mention"], F.when(F.col("concept") == F.col("chosen_id"), 0).otherwise(1).asc(), F.desc("score"), F.asc("concept"))
    shown = text.first_filled(F.col("normalized"), F.col("span"))
    term, name = text.first_filled(F.col("search_term"), F.col("span")), F.col("name")
    verdict = (
        F.when(F.col("score") < t.fallback, "below_threshold")
        .when(tests_differ(F.col("kind"), term, name), "needs_judge")
        .when(unsafe_species(name, shown), "species")
        .when(is_preventive(shown) & F.col("concept_kind").isin(CONDITIONS), "preventive")
        .when(low(F.col("kind")).isin(NOT_ANATOMY) & (F.col("concept_kind") == "Anatomy"), "anatomy")
        .when((shared_part(shown, name) < LEAST_SHARED) & ~either_holds(shown, name), "unrelated")
        .otherwise("bound")
    )
    near = (low(name) != "") & either_holds(name, shown)
    return best.select("mention", verdict.alias("verdict"), F.when(verdict == "bound", F.col("concept")).alias("concept"), F.when((verdict == "bound") & near, F.trim(name)).otherwise(F.trim(shown)).alias("display_name"))
