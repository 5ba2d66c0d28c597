"""What is kept of a mention whose candidates were all rejected: no ids, but suggestions and, for high stakes, a consultation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import best_per_key, top_per_key

# Kinds that get a consultation instead, methods, and the grade of every suggestion.
HIGH_STAKES = ["Procedure", "Diagnostic", "DiagnosticTest", "Surgery"]
REJECTED, CONSULTED, GRADE = "dual_sync_judge_rejected", "domain_consultation_fallback", "MEDIUM"
MOST_LOCAL, MOST_GLOBAL = 5, 15
ITEM = "struct<name:string,match_score:double,recommendation:string,service_id:bigint,stock_id:bigint,kb_concept_id:bigint>"


def shown_name(span: Column, normalized: Column) -> Column:
    return F.when(F.lower(normalized) != F.lower(span), normalized).otherwise(span)


def listed(local: DataFrame, general: DataFrame) -> DataFrame:
    """(mention, suggestions, primary): the first five local candidates, then general ones of other names, by score.

    ``local``: mention, name, score, stock_id, service_id, concept_id; ``general``: mention, name, score,
    concept_id.  Each side is cut to its first rows a mention in every task before rows
    are shuffled, so a mention with any number of candidates brings a few rows a task; what is gathered
    has twenty rows at most.
    """
    none = F.lit(None).cast("long")
    first = top_per_key(local, ["mention"], MOST_LOCAL, F.desc("score"), F.asc("name"), F.asc_nulls_last("stock_id"), F.asc_nulls_last("service_id"))
    then = top_per_key(general.select("mention", "name", "score", none.alias("stock_id"), none.alias("service_id"), "concept_id"), ["mention"], MOST_GLOBAL, F.desc("score"), F.asc("name"), F.asc_nulls_last("concept_id"))
    item = F.struct("name", F.col("score").cast("double").alias("match_score"), F.lit(GRADE).alias("recommendation"), F.col("service_id").cast("long").alias("service_id"), F.col("stock_id").cast("long").alias("stock_id"), F.col("concept_id").cast("long").alias("kb_concept_id"))
    rows = first.select("mention", F.lit(0).alias("side"), "rank", item.alias("item")).unionByName(then.select("mention", F.lit(1).alias("side"), "rank", item.alias("item")))
    lists = rows.groupBy("mention").agg(F.sort_array(F.collect_list(F.struct("side", "rank", "item"))).alias("x"))
    names = F.transform("x", lambda r: F.lower(r["item"]["name"]))
    kept = F.filter("x", lambda r, i: (r["side"] == 0) | (F.array_position(names, F.lower(r["item"]["name"])) == i + 1))
    top = F.get(F.filter("x", lambda r: r["side"] == 0), F.lit(0))["item"]
    primary = F.when(top.isNotNull(), F.struct(top["name"].alias("name"), top["stock_id"].alias("stock_id"), top["service_id"].alias("service_id")))
    return lists.select("mention", F.transform(kept, lambda r: r["item"]).alias("suggestions"), primary.alias("primary"))


def consultations(mentions: DataFrame, services: DataFrame) -> DataFrame:
    """(mention, domain, service_id, service): of the first of a mention's domains that has a consultation, the one of greatest price.

    ``services``: domain, service_id, service, price, category.
    """
    best = best_per_key(services.where(F.contains(F.lower("category"), F.lit("consult"))), ["domain"], F.desc("price"), F.asc("service_id")).select("domain", "service_id", "service")
    asked = mentions.where(F.col("kind").isin(HIGH_STAKES)).select("mention", F.posexplode("domains").alias("place", "domain"))
    return best_per_key(asked.join(best, "domain"), ["mention"], F.asc("place")).drop("place")


def rejected(mentions: DataFrame, local: DataFrame, general: DataFrame, services: DataFrame) -> DataFrame:
    """One row a mention (mention, span, normalized, kind, domains): its name, method, ids (null but for a consultation's service), suggestions and primary one."""
    out = mentions.join(listed(local, general), "mention", "left").join(consultations(mentions, services), "mention", "left")
    consulted = F.col("service_id").isNotNull()
    return out.select(
        "mention",
        F.when(consulted, F.col("service")).otherwise(shown_name(F.col("span"), F.col("normalized"))).alias("display_name"),
        F.when(consulted, CONSULTED).otherwise(REJECTED).alias("match_method"),
        F.lit(None).cast("long").alias("local_stock_id"),
        F.col("service_id").cast("long").alias("local_service_id"),
        F.when(consulted, F.concat(F.lit("domain_consultation:"), F.col("domain").cast("string"), F.lit(":"), F.col("service_id").cast("string"))).alias("dedupe_key"),
        F.coalesce("suggestions", F.array().cast(f"array<{ITEM}>")).alias("suggestions"),
        "primary",
    )
