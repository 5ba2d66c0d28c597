"""Scores, gates and the decision cascade, all as columns so that every step can be explained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, MEDICATION_KINDS, Thresholds
from ..functions.text import clamp, contains_either_way


def category_score(wanted: Column, found: Column, t: Thresholds = DEFAULTS) -> Column:
    """Bonus for equal or contained categories, penalty for others, 0 where one is unknown."""
    unknown = F.coalesce(F.trim(wanted), F.lit("")).isin("") | F.coalesce(F.trim(found), F.lit("")).isin("")
    return F.when(unknown, 0.0).when(contains_either_way(wanted, found), t.category_match).otherwise(t.category_mismatch)


def suggestion_boost(probability: Column) -> Column:
    return F.when(probability >= 0.90, 0.25).when(probability >= 0.80, 0.15).otherwise(0.0)


def local_final(match: Column, domain: Column, candidate_domain: Column, category: Column, suggestion: Column, t: Thresholds = DEFAULTS) -> Column:
    """With a domain: weighted match, a bonus for the same domain, category and suggestion; without: their plain sum."""
    boosted = match * t.match_weight + F.when(candidate_domain == domain, t.domain_boost).otherwise(0.0) + category + suggestion
    return F.when(domain.isNotNull(), boosted).otherwise(match + category + suggestion)


def multi_signal(trigram: Column, phonetic: Column, distance: Column, domain_relation: Column, generic: Column, related: Column, t: Thresholds = DEFAULTS) -> Column:
    """Weighted signals; ``domain_relation`` is 1 same, -1 other, 0 unknown."""
    affinity = F.greatest(F.lit(0.0), 1 - distance)
    signals = trigram * (0.10 + 0.35 * 0.14) + phonetic * (0.20 + 0.35 * 0.43) + affinity * (0.55 + 0.35 * 0.43)
    domain = F.when(domain_relation > 0, t.domain_boost).when(domain_relation < 0, t.outside_domain).otherwise(0.0)
    return signals + domain - F.when(generic, t.generic_penalty).otherwise(0.0) + F.when(related, t.relation_bonus).otherwise(0.0)


def soft_gate(df: DataFrame, base: str, match: str, domain: str, wanted: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """Drops weak rows; outside the wanted domain (neutral ones aside) costs a penalty."""
    outside = ~F.col(domain).isin("general", "common") & (F.col(domain) != F.col(wanted))
    final = F.greatest(F.lit(0.0), F.col(base) * 0.8 + 0.2 * F.col(match) - F.when(outside, t.soft_gate_outside).otherwise(0.0))
    return df.where(F.col(base) >= t.soft_gate_floor).withColumn("final", final)


def tie_breaker(name: Column, inside_other: Column, preferred: Column) -> Column:
    """What to add in a close call: names inside another name and long names lose, short preferred ones gain."""
    n = F.size(F.split(F.trim(name), r"\s+"))
    return F.when(inside_other, -0.1).otherwise(0.0) + F.when(n.between(2, 3) & preferred, 0.05).otherwise(0.0) + F.when(n >= 4, -0.08).otherwise(0.0)


def phonetic_boost(trigram: Column, phonetic: Column, vector: Column, affinity: Column, least: float = 0.85) -> Column:
    """A phonetic score that counts for more where the domain fits and spelling does not."""
    middle = phonetic.between(0.15, 0.4)
    boosted = (
        F.when((trigram < 0.1) & middle & (phonetic < 0.25), F.greatest(F.lit(0.80), 3.5 * phonetic))
        .when((trigram < 0.1) & middle, F.greatest(F.lit(0.95), 2.5 * phonetic))
        .when(middle, F.least(F.lit(1.0), 2 * phonetic))
        .otherwise(F.least(F.lit(1.0), 1.5 * phonetic))
    )
    plain = F.greatest(trigram, vector)
    return F.when((affinity >= least) & (phonetic > 0.15), F.greatest(plain, boosted)).otherwise(plain)


def hybrid_catalogue(cosine: Column, bm25: Column, same_barcode: Column, t: Thresholds = DEFAULTS) -> Column:
    return F.least(F.lit(1.0), t.cosine_weight * cosine + t.bm25_weight * bm25 + F.when(same_barcode, t.barcode_weight).otherwise(0.0))


def min_max(df: DataFrame, key: str, score: str, out: str) -> DataFrame:
    """Scores of a key scaled to [0, 1]; 1 where all are equal."""
    w = Window.partitionBy(key)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0))


def threshold_for(kind: Column, t: Thresholds = DEFAULTS) -> Column:
    return F.when(kind.isin(MEDICATION_KINDS), t.auto_bind_medication).otherwise(t.auto_bind)


def decisions(candidates: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row an entity: decision, chosen id, gate score and margin.

    ``candidates``: entity, kind, id, trigram, phonetic, vector (null where there is none),
    gate_score.  Gates in order: A all signals agree and one is strong; B1 the best score
    reaches the kind's threshold; B2 two signals agree with a clear margin; BRAND similar
    spelling and meaning with a wide margin; else JUDGE.  Order is total: score, then id.
    """
    first = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("s"), (-F.col("id")).alias("i"))))
    w = Window.partitionBy("entity").orderBy(F.desc("gate_score"), F.asc("id"))
    ranked = candidates.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("gate_score").over(w))
    top = ranked.groupBy("entity").agg(
        F.max(F.when(F.col("r") == 1, F.struct("id", "kind", "gate_score", "trigram", F.coalesce("vector", F.lit(0.0)).alias("vector"), "second"))).alias("top"),
        first("trigram").alias("t"),
        first("phonetic").alias("p"),
        first("vector").alias("v"),
    )
    of = lambda c: -F.col(f"{c}.i")
    row = top.select(
        "entity",
        F.col("top.id").alias("id"),
        F.col("top.gate_score").alias("gate_score"),
        (F.col("top.gate_score") - F.coalesce("top.second", F.lit(0.0))).alias("margin"),
        (of("t") == of("p")).alias("tp"),
        F.coalesce(of("t") == of("v"), F.lit(False)).alias("tv"),
        F.coalesce(of("p") == of("v"), F.lit(False)).alias("pv"),
        F.col("v").isNull().alias("no_vector"),
        of("t").alias("by_trigram"),
        of("p").alias("by_phonetic"),
        F.col("top.trigram").alias("trigram"),
        F.col("top.vector").alias("vector"),
        threshold_for(F.col("top.kind"), t).alias("threshold"),
    )
    agree = F.when(F.col("no_vector"), F.col("tp")).otherwise(F.col("tp") & F.col("tv"))
    strong = F.greatest("trigram", "vector") >= t.agreement_floor
    two = (F.col("tp") | F.col("tv") | F.col("pv")) & (F.col("margin") >= t.margin) & (F.col("gate_score") >= t.agreement_floor)
    brand = (F.col("trigram") >= t.brand_trigram) & (F.col("vector") >= t.brand_vector) & (F.col("margin") >= t.brand_margin)
    decision = F.when(agree & strong, "A").when(F.col("gate_score") >= F.col("threshold"), "B1").when(two, "B2").when(brand, "BRAND").otherwise("JUDGE")
    chosen = F.when(decision == "A", F.col("by_trigram")).when(decision == "JUDGE", F.lit(None)).otherwise(F.col("id"))
    return row.select("entity", decision.alias("decision"), chosen.alias("chosen_id"), "gate_score", "margin")


def note_only(kind: Column, best: Column, t: Thresholds = DEFAULTS) -> Column:
    """Diagnoses and reasons below the certainty wall are noted, not bound."""
    return kind.isin("Diagnosis", "ReasonForVisit") & (F.coalesce(best, F.lit(0.0)) < t.certainty_wall)


def tiered_choice(kind: Column, local: Column, global_: Column, t: Thresholds = DEFAULTS) -> Column:
    """Where kinds of low stakes bind: local first, else global (never for parasite control), else nowhere."""
    return (
        F.when(kind.isin("Procedure", "Medication", "Diagnostic"), "judge")
        .when(local >= t.fallback, "local")
        .when((global_ >= t.fallback) & (kind != "ParasiteControl"), "global")
        .otherwise("none")
    )


def inventory_action(best: Column, same_batch: Column) -> Column:
    """New product below 0.5; above 0.8 more of the same batch or a new batch; else the user decides."""
    return F.when(F.coalesce(best, F.lit(0.0)) < 0.5, "new_product").when((best >= 0.8) & same_batch, "add_quantity").when(best >= 0.8, "new_batch").otherwise("ask_user")
