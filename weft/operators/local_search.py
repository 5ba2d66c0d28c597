"""Search of a clinic's own products and services: terms, recall, hints that gate, boosts, and one retry without the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions.text import contains_either_way
from . import ranking
from .relational import top_per_key
from .retrieval import candidate_scores

PER_TERM, MOST_EXPANSIONS = 25, 3


def suggestion(name: Column, search_term: Column, hints: Column, expansion: Column, probability: Column, t: Thresholds = DEFAULTS) -> Column:
    """The boost of a name: whole if it agrees with the search term, by the likeliest agreeing hint, or at a fixed part for an agreeing expansion.

    Two names agree if one holds the other, without regard to case.
    """
    whole = ranking.suggestion_boost(F.coalesce(probability, F.lit(0.0)))
    agrees = lambda other: F.coalesce(contains_either_way(other, name), F.lit(False))
    likely = F.array_max(F.transform(F.filter(hints, lambda h: agrees(h["hint"])), lambda h: F.coalesce(h["p"], F.lit(0.0))))
    expanded = F.exists(F.slice(expansion, 1, MOST_EXPANSIONS), agrees)
    return F.when(agrees(search_term), whole).when(likely > 0, whole * likely).when(expanded, whole * t.expansion_weight).otherwise(0.0)


def local_search(mentions: DataFrame, catalogue: DataFrame, k: int = 5, first_term_wins: bool = False, t: Thresholds = DEFAULTS) -> DataFrame:
    """(entity, id, trigram, jaro_winkler, match_score, final_score, retried, rank): the ``k`` best items of each mention.

    ``mentions``: entity, terms (array, in order), search_term, hints (array of struct<hint, p>), expansion (array),
    categories (array of lower-cased ones that gate; empty for none), category, domain, suggestion_probability.
    ``catalogue``: id, name, category, domain.  Each term recalls its ``PER_TERM`` best items; an item that several
    terms recall keeps its best scores, one by one, or with ``first_term_wins`` (services) those of its first term.  A
    mention whose categories leave nothing is searched once more without them, in the same plan.
    """
    terms = mentions.select("entity", F.posexplode("terms").alias("place", "term")).where("term <> ''")
    scores = candidate_scores(terms.select(F.col("term").alias("mention")).distinct(), catalogue.select("name").distinct(), t=t)
    scores = scores.select(F.col("mention").alias("term"), "name", *(F.round(c, 9).alias(c) for c in ("trigram", "jaro_winkler", "match_score")))
    # items of one name and category are recalled and gated alike, so only the first ones of them can be among a term's best
    few = top_per_key(catalogue, ["name", "category"], PER_TERM, F.asc("id"))
    recalled = terms.join(scores, "term").join(few.select("id", "name", "category", F.col("domain").alias("item_domain")), "name").join(mentions.select("entity", "categories"), "entity")

    def best(rows: DataFrame, retried: bool) -> DataFrame:
        cut = top_per_key(rows, ["entity", "place"], PER_TERM, F.desc("match_score"), F.asc("id")).drop("rank")
        names = ("trigram", "jaro_winkler", "match_score")
        merged = [F.min_by(c, "place").alias(c) for c in names] if first_term_wins else [F.max(c).alias(c) for c in names]
        same = [F.first(c).alias(c) for c in ("name", "category", "item_domain")]
        return cut.groupBy("entity", "id").agg(*merged, *same).withColumn("retried", F.lit(retried))

    gated = best(recalled.where((F.size("categories") == 0) | F.array_contains("categories", F.lower("category"))), False)
    left = recalled.where(F.size("categories") > 0).join(gated.select("entity").distinct(), "entity", "left_anti")
    found = gated.unionByName(best(left, True)).join(mentions.select("entity", "search_term", "hints", "expansion", F.col("category").alias("wanted"), "domain", "suggestion_probability"), "entity")
    boost = suggestion(F.col("name"), F.col("search_term"), F.col("hints"), F.col("expansion"), F.col("suggestion_probability"), t)
    final = ranking.local_final(F.col("match_score"), F.col("domain"), F.col("item_domain"), ranking.category_score(F.col("wanted"), F.col("category"), t), boost, t)
    ranked = top_per_key(found.withColumn("final_score", F.round(final, 9)), ["entity"], k, F.desc("final_score"), F.asc("id"))
    return ranked.select("entity", "id", "trigram", "jaro_winkler", "match_score", "final_score", "retried", "rank")
