"""The global knowledge-base path: two buckets, staged widening, fallbacks and safety gates.

It is off by default (``enabled=False`` gives no rows), as local search is the production
path; with it on, every stage is a join whose next stage sees only what is still missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions import text
from ..functions.phonetic import phonetic_score
from . import ranking, relational, retrieval

# Words that make a concept name too general to bind.
GENERIC = ["medication", "treatment", "therapy", "procedure", "test", "examination", "product", "care"]


def surfaces(concepts: DataFrame, aliases: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """(concept, name, kind, domain): preferred names and aliases of concepts that are not rejected; learned ones only if trusted."""
    live = concepts.where("status is null or status <> 'REJECTED'")
    other = aliases.join(live.drop("name"), "concept").select("concept", F.col("alias").alias("name"), "kind", "domain")
    out = live.select("concept", "name", "kind", "domain").unionByName(other)
    if learned is not None:
        trusted = learned.where(F.col("validated") | (F.col("frequency") > 0)).join(live.drop("name"), "concept")
        out = out.unionByName(trusted.select("concept", F.col("alias").alias("name"), "kind", "domain"))
    return out.where(text.blank_to_null(F.col("name")).isNotNull()).distinct()


def widened(mentions: DataFrame, names: DataFrame, steps: tuple[float, ...] = (0.2, 0.1)) -> DataFrame:
    """(mention, name, trigram): trigram recall at the first threshold that finds anything; then a phonetic last resort."""
    found = None
    for least in steps:
        def stage(missing: DataFrame, least: float = least) -> DataFrame:
            got = retrieval.trigram_join(missing.select(F.col("mention").alias("name")), names, "name", least)
            return got.select(F.col("a").alias("mention"), F.col("b").alias("name"), F.col("similarity").alias("trigram"))

        found = stage(mentions) if found is None else retrieval.escalated(found, mentions, "mention", stage)

    def sound(missing: DataFrame) -> DataFrame:
        got = retrieval.phonetic_join(missing.select(F.col("mention").alias("name")), names, "name")
        return got.where("score > 0.35").select(F.col("a").alias("mention"), F.col("b").alias("name"), F.lit(0.0).alias("trigram"))

    return retrieval.escalated(found, mentions, "mention", sound)


def two_stage(mentions: DataFrame, names: DataFrame, semantic: DataFrame, k: int, t: Thresholds = DEFAULTS, enabled: bool = True) -> DataFrame:
    """(mention, concept, score, rank): semantic and spelling buckets merged and ranked by all signals.

    ``mentions``: mention, domain (null if unknown); ``names``: as of :func:`surfaces`;
    ``semantic``: (mention, concept, distance) from nearest neighbours.
    """
    spelled = widened(mentions.select("mention"), names.select("name").distinct())
    by_name = spelled.join(names, "name").groupBy("mention", "concept").agg(F.max_by(F.struct("name", "kind", "domain"), "trigram").alias("s"), F.max("trigram").alias("trigram"))
    by_name = relational.top_per_key(by_name, ["mention"], 25, F.desc("trigram"), F.asc("concept")).drop("rank")
    near = relational.top_per_key(semantic, ["mention"], 25, F.asc("distance"), F.asc("concept")).drop("rank")
    pool = by_name.join(near, ["mention", "concept"], "full")
    info = names.groupBy("concept").agg(F.min(F.struct("name", "kind", "domain")).alias("i"))
    pool = pool.join(info, "concept", "left").withColumn("s", F.coalesce("s", "i")).join(mentions.select("mention", F.col("domain").alias("wanted")), "mention")
    keys = retrieval.with_phonetic_key(retrieval.with_phonetic_key(pool.withColumn("name", F.col("s.name")), "name", "key_n"), "mention", "key_m")
    related = F.when(F.col("wanted").isNull() | F.col("s.domain").isin("general", "common"), 0).when(F.col("s.domain") == F.col("wanted"), 1).otherwise(-1)
    general = F.forall(text.words(F.col("name")), lambda w: w.isin(GENERIC))
    score = ranking.multi_signal(F.coalesce("trigram", F.lit(0.0)), phonetic_score(F.col("key_n"), F.col("key_m")), F.coalesce("distance", F.lit(1.0)), related, general, F.lit(False), t)
    ranked = keys.where(F.lit(enabled)).select("mention", "concept", "name", F.round(score, 9).alias("score"))
    return relational.top_per_key(ranked, ["mention"], k, F.desc("score"), F.asc("concept"))


def bound(candidates: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(mention, concept, verdict): the best candidate, if it passes every gate.

    Needs ``fallback``; a mention that shares under a quarter of its words with the name,
    without one holding the other, is unlinked; so is a general name.
    """
    best = relational.best_per_key(candidates, ["mention"], F.desc("score"), F.asc("concept"))
    far = (text.token_overlap(F.col("mention"), F.col("name")) < 0.25) & ~text.contains_either_way(F.col("mention"), F.col("name"))
    general = F.forall(text.words(F.col("name")), lambda w: w.isin(GENERIC))
    verdict = F.when(F.col("score") < t.fallback, "below_threshold").when(far, "unrelated").when(general, "generic").otherwise("bound")
    return best.select("mention", F.when(verdict == "bound", F.col("concept")).alias("concept"), verdict.alias("verdict"))


def with_fallback_services(unlinked: DataFrame, services: DataFrame) -> DataFrame:
    """Per unlinked (entity, domain), the domain's consultation of greatest price; one draft a (domain, service), others grouped."""
    best = relational.best_per_key(services.where("lower(category) = 'consultation'"), ["domain"], F.desc("price"), F.asc("service_id"))
    linked = unlinked.join(best.select("domain", "service_id"), "domain", "left")
    ranked = relational.top_per_key(linked.where("service_id is not null").withColumn("o", F.col("entity")), ["visit", "domain", "service_id"], 1 << 30, F.asc("entity"))
    return ranked.select("visit", "domain", "service_id", "entity", F.when(F.col("rank") == 1, "fallback_draft").otherwise("fallback_grouped").alias("method"))


def recommendations(items: DataFrame, search: DataFrame, k: int = 3, least: float = 0.45) -> DataFrame:
    """Alternatives of each item: search hits above ``least`` other than the item itself, ``k`` at most."""
    hits = items.join(search, "name").where((F.col("hit_id") != F.col("id")) & (F.col("score") >= least))
    return relational.top_per_key(hits, ["id"], k, F.desc("score"), F.asc("hit_id")).select("id", "hit_id", F.round("score", 3).alias("score"), "rank")


def converged(candidates: DataFrame, least: float = 0.8) -> DataFrame:
    """Mentions whose best hit, above ``least``, came from the mention itself and from a hint."""
    pools = candidates.groupBy("mention", "concept").agg(F.max("score").alias("score"), F.bool_or("from_hint").alias("hint"), F.bool_or(~F.col("from_hint")).alias("own"))
    best = relational.best_per_key(pools, ["mention"], F.desc("score"), F.asc("concept"))
    return best.where((F.col("score") > least) & F.col("hint") & F.col("own")).select("mention", "concept", "score")
