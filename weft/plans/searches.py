"""The whole local search on the catalogue, for products and for services."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import local_search
from .registry import jaro_winkler_sql, query, table, trigrams_sql
from .similarity import MENTIONS, mentions

BOTH = lambda a, b: f"(trim({a}) <> '' AND (contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a}))))"
SEARCH = f"""
WITH g AS (SELECT DISTINCT mention FROM ({MENTIONS})), q AS (SELECT mention AS entity, [mention, substr(mention, 1, 6), ''] AS terms, length(mention) % 4 AS z FROM g),
m AS (SELECT DISTINCT unnest(terms) AS term FROM q), n AS (SELECT DISTINCT p_name AS name FROM part),
mt AS (SELECT term, {trigrams_sql("term")} AS t FROM m WHERE term <> ''), nt AS (SELECT name, {trigrams_sql("name")} AS t FROM n),
h AS (SELECT term, name, len(list_intersect(mt.t, nt.t)) / (len(mt.t) + len(nt.t) - len(list_intersect(mt.t, nt.t))) AS trigram FROM mt, nt),
c AS (SELECT term, name, round(trigram, 9) AS trigram, round({jaro_winkler_sql("term", "name")}, 9) AS jw FROM h WHERE trigram >= 0.3),
e AS (SELECT entity, z, unnest(terms) AS term, generate_subscripts(terms, 1) AS place FROM q),
r AS (SELECT e.entity, e.z, e.place, p.p_partkey AS id, p.p_name AS name, p.p_type AS category, p.p_size % 5 AS dom, c.trigram, c.jw, greatest(c.trigram, c.jw) AS ms FROM e JOIN c USING (term) JOIN part p ON p.p_name = c.name),
gated AS (SELECT * FROM r WHERE z >= 2 OR z = 0 AND category = 'PROMO'),
u AS (SELECT *, false AS retried FROM gated UNION ALL SELECT *, true FROM r WHERE z < 2 AND entity NOT IN (SELECT entity FROM gated)),
k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY entity, place ORDER BY ms DESC, id) <= 25),
b AS (SELECT entity, any_value(z) AS z, id, any_value(name) AS name, any_value(category) AS category, any_value(dom) AS dom, any_value(retried) AS retried, {{merge}} FROM k GROUP BY entity, id),
s AS (SELECT *, CASE z WHEN 0 THEN 0.25 WHEN 1 THEN 0.15 WHEN 2 THEN 0.0 ELSE 0.25 END AS whole, CASE WHEN z = 1 THEN 'PROMO' ELSE '' END AS wanted FROM b),
f AS (SELECT *, CASE WHEN {BOTH("trim(substr(entity, 1, 3))", "name")} AND z <> 3 THEN whole WHEN z = 3 AND contains(name, 'bolt') THEN whole * 0.7 WHEN z = 3 AND contains(name, 'gear') THEN whole * 0.4 WHEN contains(name, 'ring') THEN whole * 0.8 ELSE 0 END AS boost, CASE WHEN wanted = '' THEN 0 WHEN category = 'PROMO' THEN 0.12 ELSE -0.35 END AS cat FROM s),
o AS (SELECT entity, id, t AS trigram, jw AS jaro_winkler, ms AS match_score, round(CASE WHEN z = 2 THEN ms * 0.8 + CASE WHEN dom = 3 THEN 0.2 ELSE 0 END + cat + boost ELSE ms + cat + boost END, 9) AS final_score, retried FROM f)
SELECT *, row_number() OVER (PARTITION BY entity ORDER BY final_score DESC, id)::INTEGER AS rank FROM o QUALIFY rank <= {{k}}
"""
BEST_OF_ALL = "max(trigram) AS t, max(jw) AS jw, max(ms) AS ms"
FIRST_TERM = "arg_min(trigram, place) AS t, arg_min(jw, place) AS jw, arg_min(ms, place) AS ms"


def asked(spark, sf_dir):
    """Mentions with two terms and, by turns, a gate that fits, one that fits nothing, a domain, and hints."""
    m, z = F.col("mention"), F.length("mention") % 4
    hint = lambda h, p: F.struct(F.lit(h).alias("hint"), F.lit(p).alias("p"))
    none = F.array().cast("array<string>")
    return mentions(spark, sf_dir).distinct().select(
        m.alias("entity"), F.array(m, F.substring(m, 1, 6), F.lit("")).alias("terms"), F.when(z != 3, F.substring(m, 1, 3)).alias("search_term"), F.when(z == 3, F.array(hint("gear", 0.4), hint("Bolt", 0.7))).otherwise(F.array().cast("array<struct<hint:string,p:double>>")).alias("hints"),
        F.array(F.lit("nothing"), F.lit("ring")).alias("expansion"), F.when(z == 0, F.array(F.lit("promo"))).when(z == 1, F.array(F.lit("absent"))).otherwise(none).alias("categories"), F.when(z == 1, "PROMO").alias("category"), F.when(z == 2, 3).alias("domain"),
        F.when(z == 0, 0.95).when(z == 1, 0.85).when(z == 2, 0.5).otherwise(0.9).alias("suggestion_probability"),
    )


def shelf(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), (F.col("p_size") % 5).alias("domain"))


@query(SEARCH.format(merge=BEST_OF_ALL, k=5))
def local_products(spark, sf_dir):
    return local_search.local_search(asked(spark, sf_dir), shelf(spark, sf_dir), 5)


@query(SEARCH.format(merge=FIRST_TERM, k=1))
def local_service(spark, sf_dir):
    """The single best service of each mention; of several terms the first to bring a service up decides its scores."""
    return local_search.local_search(asked(spark, sf_dir), shelf(spark, sf_dir), 1, first_term_wins=True)
