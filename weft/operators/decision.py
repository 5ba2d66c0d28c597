"""Which local candidate a mention binds to, if any: agreement, thresholds, predictive gates, rejection or the judge.

A mention's first ten candidates are cut off in every task before they are shuffled and
gathered in one short array, on which all gates are expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions.products import is_generic_mention
from .relational import top_per_key

# Kinds that bind from a lower score on, and kinds that the brand gate takes.
LOWER_KINDS = ["Drug", "Medicine", "Medication"]
BRAND_KINDS = ["Drug", "Medicine", "Nutrition", "Supplement", "Vaccine"]
# Dosage forms, each with the parts of a name that tell it.
FORM_PARTS = [["capsule", "capsules"], ["tablet", "tablets", "tab"], ["syrup"], ["inj", "injection"], ["drops"]]
# Short terms that need no judge where the vector is near.
SHORT_TERMS = ["fho", "physiotherapy", "physio", "xray", "x-ray", "x ray", "bhrt", "cbc", "ua", "dhm", "ecg", "usg", "mri", "ct", "iv", "im", "po", "sid", "bid", "tid", "qid"]
SHORT_MENTION, SHORTEST = 20, 4
MOST, LOOKED_AT = 10, 5
RELEVANT_THRESHOLD, RELEVANT_PHONETIC, RELEVANT_TRIGRAM = 0.80, 0.15, 0.3
PREDICTIVE = 0.75


def same_form(a: Column, b: Column) -> Column:
    """Both name one dosage form."""
    told = lambda c, parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(F.coalesce(c, F.lit(""))), p))
    out = F.lit(False)
    for parts in FORM_PARTS:
        out = out | (told(a, parts) & told(b, parts))
    return out


def is_short_term(mention: Column, vector: Column) -> Column:
    plain = F.replace(F.replace(F.lower(F.trim(F.coalesce(mention, F.lit("")))), F.lit("-"), F.lit(" ")), F.lit("  "), F.lit(" "))
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    known = F.array(*map(F.lit, SHORT_TERMS))
    return plain.isin(SHORT_TERMS) | ((F.length(plain) <= SHORT_MENTION) & F.arrays_overlap(words, known)) | ((F.length(plain) <= SHORTEST) & (vector >= PREDICTIVE))


def decision_flow(candidates: DataFrame, judged: bool = True, t: Thresholds = DEFAULTS) -> DataFrame:
    """(entity, decision, chosen_id, best, margin) of each entity.

    ``candidates``: entity, mention, kind, id, name, trigram, phonetic, vector, match_score, relevant
    (the best candidate's domain suits the visit).  They are taken by match score, then id.
    Gates, in order: A trigram, sound and (if any candidate has one) vector choose one candidate
    that is strong by trigram or vector; B1 the best score reaches its threshold, a lower one for medicine or, where sound
    alone speaks, for a relevant domain; BRAND and B2 two signals agree on the best, with a
    margin; SHORT and PREDICTIVE spare the judge; then generic mentions with only specific candidates are rejected
    and the rest goes to the judge.  A gate of B1's threshold with a margin can't be reached behind B1 and is left out.
    With ``judged`` false the gates up to B2 count alone and no domain lowers a threshold; the rest is NONE.
    """
    ordered = top_per_key(candidates, ["entity"], MOST, F.desc("match_score"), F.asc("id"))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    bare = (zero("match_score") > 0) & (zero("trigram") == 0) & (zero("phonetic") == 0) & (zero("vector") == 0)
    row = F.struct("rank", "id", "name", F.when(bare, zero("match_score")).otherwise(zero("trigram")).alias("t"), zero("phonetic").alias("p"), zero("vector").alias("v"), zero("match_score").alias("m"), F.coalesce("relevant", F.lit(False)).alias("relevant"))
    lists = ordered.groupBy("entity").agg(F.sort_array(F.collect_list(row)).alias("c"), F.first("mention").alias("mention"), F.first("kind").alias("kind"))
    best_by = lambda *keys: F.element_at(F.array_sort(F.transform("c", lambda x: F.struct(*(-x[k] for k in keys), x["rank"], x["id"].alias("id"), x["t"].alias("t"), x["v"].alias("v")))), 1)
    first, second = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    x = lists.select(
        "entity", "kind", "mention", first.alias("top"), (first["m"] - F.coalesce(second["m"], F.lit(0.0))).alias("margin"), best_by("t").alias("by_t"), best_by("p", "m").alias("by_p"), best_by("v").alias("by_v"),
        F.exists("c", lambda y: y["v"] > 0).alias("has_vector"), is_generic_mention(F.col("mention")).alias("generic"), F.forall(F.slice("c", 1, LOOKED_AT), lambda y: ~is_generic_mention(y["name"])).alias("all_specific"),
    )
    top_t, top_v, specific, margin = F.col("top.t"), F.col("top.v"), ~F.col("generic"), F.round("margin", 9)
    agree = (F.col("by_t.id") == F.col("by_p.id")) & (~F.col("has_vector") | (F.col("by_t.id") == F.col("by_v.id")))
    strong = F.when(F.col("has_vector"), F.greatest("by_t.t", "by_v.v")).otherwise(F.col("by_t.t")) >= t.agreement_floor
    base = F.when(F.col("kind").isin(LOWER_KINDS), t.auto_bind_medication).otherwise(t.auto_bind)
    relevant = F.col("top.relevant") & (F.col("top.p") > RELEVANT_PHONETIC) & (top_t < RELEVANT_TRIGRAM)
    threshold = F.when(relevant, F.least(base, F.lit(RELEVANT_THRESHOLD))).otherwise(base) if judged else base
    by_t, by_p, by_v = (F.col(f"by_{s}.id") == F.col("top.id") for s in "tpv")
    by_v = by_v & F.col("has_vector")
    two = by_t.cast("int") + by_p.cast("int") + by_v.cast("int") >= 2
    brand = by_t & by_v & (top_t >= t.brand_trigram) & (top_v >= t.brand_vector) & (margin >= t.brand_margin) & same_form(F.col("mention"), F.col("top.name")) & F.col("kind").isin(BRAND_KINDS)
    gates = [("A", agree & strong), ("B1", F.col("top.m") >= threshold), ("BRAND", two & (margin >= t.margin) & brand), ("B2", two & (margin >= t.margin) & (F.greatest(top_t, top_v) >= t.agreement_floor))]
    if judged:
        gates += [("SHORT", is_short_term(F.col("mention"), top_v) & (top_v >= PREDICTIVE)), ("PREDICTIVE", (top_t >= PREDICTIVE) & (top_v >= PREDICTIVE))]
    passed = F.coalesce(*(F.when(specific & gate, name) for name, gate in gates))
    otherwise = F.when(F.col("generic") & F.col("all_specific"), "REJECT").otherwise("JUDGE") if judged else F.lit("NONE")
    decision = F.coalesce(passed, otherwise)
    chosen = F.when(decision == "A", F.col("by_t.id")).when(passed.isNotNull(), F.col("top.id"))
    return x.select("entity", decision.alias("decision"), chosen.alias("chosen_id"), F.col("top.m").alias("best"), margin.alias("margin"))
