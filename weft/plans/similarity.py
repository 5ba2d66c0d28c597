"""Queries on string similarity, vectors and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vector
from ..functions.phonetic import double_metaphone_keys, jaro_winkler_similarity
from ..operators import ranking, relational, retrieval, text_index
from ..sources.files import scratch
from .registry import jaro_winkler_sql, query, table, trigrams_sql, words_sql


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misheard names: the third character is lost and the brand number is appended."""
    return catalogue(spark, sf_dir).select(F.concat(F.substring("name", 1, 2), F.expr("substring(name, 4)")).alias("mention")).distinct()


MENTIONS = "SELECT DISTINCT substr(p_name, 1, 2) || substr(p_name, 4) AS mention FROM part"


@query(f"""
WITH n AS (SELECT DISTINCT p_name AS name, {trigrams_sql("p_name")} AS t FROM part)
SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 9) AS similarity
FROM n a, n b WHERE a.name < b.name AND len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.3
""")
def trigram_similarity_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return retrieval.trigram_join(names, names, "name", 0.3).where("a < b").withColumn("similarity", F.round("similarity", 9))


@query(f"""
WITH n AS (SELECT DISTINCT p_brand || ' ' || p_type || ' ' || p_name AS name FROM part), t AS (SELECT name, {trigrams_sql("name")} AS t FROM n),
m AS (SELECT mention, {trigrams_sql("mention")} AS t FROM ({MENTIONS}))
SELECT mention, name, similarity FROM (
  SELECT mention, name, round(len(list_intersect(m.t, t.t)) / (len(m.t) + len(t.t) - len(list_intersect(m.t, t.t))), 9) AS similarity FROM m, t
) WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY mention ORDER BY similarity DESC, name) <= 3
""")
def trigram_topk(spark, sf_dir):
    names = catalogue(spark, sf_dir).select(F.concat_ws(" ", "brand", "category", "name").alias("name"))
    found = retrieval.trigram_join(mentions(spark, sf_dir).select(F.col("mention").alias("name")), names, "name", 0.3)
    found = found.select(F.col("a").alias("mention"), F.col("b").alias("name"), F.round("similarity", 9).alias("similarity"))
    return relational.top_per_key(found, ["mention"], 3, F.desc("similarity"), F.asc("name")).drop("rank")


@query("""
WITH n AS (SELECT DISTINCT p_name AS name FROM part)
SELECT a.name AS a, b.name AS b, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 9) AS ratio
FROM n a, n b WHERE a.name < b.name AND 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.6
""")
def levenshtein_ratio_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct().withColumn("n", F.length("a"))
    # a ratio of 0.6 leaves lengths from 0.6 to 1 / 0.6 of a name's own
    reach = n.select(F.col("a").alias("b"), F.explode(F.sequence(F.floor(F.col("n") * 0.6).cast("int"), F.ceil(F.col("n") / 0.6).cast("int"))).alias("n"))
    pairs = n.join(reach, "n").where("a < b").select("a", "b")
    return pairs.withColumn("ratio", F.round(text.levenshtein_ratio(F.col("a"), F.col("b")), 9)).where("ratio >= 0.6")


@query(f"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), m AS ({MENTIONS}),
s AS (SELECT mention, name, round({jaro_winkler_sql("mention", "name")}, 9) AS score FROM m, n)
SELECT mention, name, score FROM s QUALIFY row_number() OVER (PARTITION BY mention ORDER BY score DESC, name) <= 5
""")
def jaro_winkler_topk(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    pairs = mentions(spark, sf_dir).crossJoin(F.broadcast(n) if n.count() <= 10_000 else n)  # every mention against every distinct name: the ranking has no threshold
    scored = pairs.withColumn("score", F.round(jaro_winkler_similarity("mention", "name"), 9))
    return relational.top_per_key(scored, ["mention"], 5, F.desc("score"), F.asc("name")).drop("rank")


@query()
def phonetic_key_join(spark, sf_dir):
    """Names that sound like a mention; SQL has no phonetic keys."""
    found = retrieval.phonetic_join(mentions(spark, sf_dir).select(F.col("mention").alias("name")), catalogue(spark, sf_dir).select("name"), "name")
    return found.select(F.col("a").alias("mention"), F.col("b").alias("name"), F.round("score", 9).alias("score"))


@query()
def double_metaphone_names(spark, sf_dir):
    return catalogue(spark, sf_dir).select("name").distinct().select("name", double_metaphone_keys("name").alias("k")).select("name", "k.primary", "k.alternate")


@query(f"""
WITH b AS (SELECT item_id, list_distinct({words_sql("text")}) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct({words_sql("text")}) AS w FROM documents)
SELECT item_id, doc_id, round(len(list_intersect(b.w, d.w)) / len(b.w), 9) AS overlap FROM b, d WHERE len(b.w) > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(len(list_intersect(b.w, d.w)) / len(b.w), 9) DESC, doc_id) <= 3 AND len(list_intersect(b.w, d.w)) > 0
""")
def token_overlap_topk(spark, sf_dir):
    """Share of an item's words in a document."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = retrieval.word_overlap(items, table(spark, sf_dir, "documents"), 3)
    return found.select(F.col("query_id").alias("item_id"), "doc_id", "overlap")


HYBRID = f"""
WITH m AS ({MENTIONS}), n AS (SELECT DISTINCT p_name AS name FROM part),
mt AS (SELECT mention, {trigrams_sql("mention")} AS t FROM m), nt AS (SELECT name, {trigrams_sql("name")} AS t FROM n),
h AS (SELECT mention, name, len(list_intersect(mt.t, nt.t)) / (len(mt.t) + len(nt.t) - len(list_intersect(mt.t, nt.t))) AS trigram FROM mt, nt),
c AS (SELECT mention, name, round(trigram, 9) AS trigram, round({jaro_winkler_sql("mention", "name")}, 9) AS jaro_winkler FROM h WHERE trigram >= 0.3),
items AS (SELECT c.mention, p.p_partkey AS id, c.trigram, c.jaro_winkler, greatest(c.trigram, c.jaro_winkler) AS match_score, p.p_type AS category FROM c JOIN part p ON p.p_name = c.name)
"""


def few_of_each(spark: SparkSession, sf_dir: str, k: int, *marks: Column) -> DataFrame:
    """The catalogue's ``k`` smallest ids of each name, category and ``marks``: where these alone decide a score, no other can be among a mention's ``k`` best."""
    items = catalogue(spark, sf_dir).withColumns({f"mark_{i}": m for i, m in enumerate(marks)})
    return relational.top_per_key(items, ["name", "category", *(f"mark_{i}" for i in range(len(marks)))], k, F.asc("id")).drop("rank")


def hybrid_items(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """Every catalogue item of every name that a mention recalls; names are scored once each."""
    scores = retrieval.candidate_scores(mentions(spark, sf_dir), catalogue(spark, sf_dir).select("name").distinct())
    scores = scores.select("mention", "name", F.round("trigram", 9).alias("trigram"), F.round("jaro_winkler", 9).alias("jaro_winkler"), F.round("match_score", 9).alias("match_score"))
    return scores.join(catalogue(spark, sf_dir) if items is None else items, "name").select("mention", "id", "trigram", "jaro_winkler", "match_score", "category")


@query(HYBRID + "SELECT mention, id, trigram, jaro_winkler, match_score FROM items QUALIFY row_number() OVER (PARTITION BY mention ORDER BY match_score DESC, id) <= 10")
def hybrid_local_search(spark, sf_dir):
    """The ten best items of each mention; a name brings its ten smallest ids, as no more of them can be among the ten."""
    few = relational.top_per_key(catalogue(spark, sf_dir), ["name"], 10, F.asc("id")).drop("rank")
    return relational.top_per_key(hybrid_items(spark, sf_dir, few), ["mention"], 10, F.desc("match_score"), F.asc("id")).select("mention", "id", "trigram", "jaro_winkler", "match_score")


DECISION = HYBRID + """,
f AS (SELECT mention, id, trigram, jaro_winkler, round(match_score + CASE WHEN category = 'PROMO' THEN 0.12 ELSE -0.35 END, 9) AS gate_score FROM items),
r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY gate_score DESC, id) AS r, lead(gate_score) OVER (PARTITION BY mention ORDER BY gate_score DESC, id) AS second FROM f),
t AS (SELECT mention, arg_min(id, (-trigram, id)) AS by_t, arg_min(id, (-jaro_winkler, id)) AS by_p FROM f GROUP BY mention),
x AS (SELECT r.mention, r.id, r.gate_score, round(r.gate_score - coalesce(r.second, 0), 9) AS margin, r.trigram, t.by_t, t.by_p FROM r JOIN t USING (mention) WHERE r.r = 1),
d AS (SELECT *, CASE WHEN by_t = by_p AND trigram >= 0.70 THEN 'A' WHEN gate_score >= 0.92 THEN 'B1' WHEN by_t = by_p AND margin >= 0.08 AND gate_score >= 0.70 THEN 'B2' WHEN trigram >= 0.62 AND 0.0 >= 0.30 AND margin >= 0.15 THEN 'BRAND' ELSE 'JUDGE' END AS decision FROM x)
SELECT mention, decision, CASE WHEN decision = 'A' THEN by_t WHEN decision = 'JUDGE' THEN NULL ELSE id END AS chosen_id, gate_score, margin FROM d
"""


@query(DECISION)
def hybrid_decision(spark, sf_dir):
    """Search, category score, and the deterministic decision cascade: the flagship."""
    items = hybrid_items(spark, sf_dir)
    gate = F.round(F.col("match_score") + ranking.category_score(F.lit("PROMO"), F.col("category")), 9)
    rows = items.select(F.col("mention").alias("entity"), F.lit("Procedure").alias("kind"), "id", "trigram", F.col("jaro_winkler").alias("phonetic"), F.lit(None).cast("double").alias("vector"), gate.alias("gate_score"))
    out = ranking.decisions(rows)
    return out.select(F.col("entity").alias("mention"), "decision", "chosen_id", "gate_score", F.round("margin", 9).alias("margin"))


@query(HYBRID + "SELECT mention, id, match_score FROM items WHERE trim(regexp_replace(replace(lower(category), '&', 'and'), '[^a-z0-9]+', ' ', 'g')) IN ('promo', 'large') QUALIFY row_number() OVER (PARTITION BY mention ORDER BY match_score DESC, id) <= 5")
def category_hard_gate(spark, sf_dir):
    gated = retrieval.category_gate(hybrid_items(spark, sf_dir, few_of_each(spark, sf_dir, 5)), F.col("category"), ["promo", "large"])
    return relational.top_per_key(gated, ["mention"], 5, F.desc("match_score"), F.asc("id")).select("mention", "id", "match_score")


@query(HYBRID + """, g AS (SELECT mention, id, match_score, 'gated' AS stage FROM items WHERE category = 'PROMO' AND match_score >= 0.97),
u AS (SELECT * FROM g UNION ALL SELECT mention, id, match_score, 'open' FROM items WHERE mention NOT IN (SELECT mention FROM g))
SELECT mention, id, match_score, stage FROM u QUALIFY row_number() OVER (PARTITION BY mention ORDER BY match_score DESC, id) = 1""")
def hard_gate_retry(spark, sf_dir):
    """Mentions that the gate leaves without a hit are searched again without it; no driver-side branch."""
    items = hybrid_items(spark, sf_dir)
    gated = items.where("category = 'PROMO' and match_score >= 0.97").select("mention", "id", "match_score", F.lit("gated").alias("stage"))
    again = lambda missing: items.join(missing, "mention", "left_semi").select("mention", "id", "match_score", F.lit("open").alias("stage"))
    found = retrieval.escalated(gated, mentions(spark, sf_dir), "mention", again)
    return relational.best_per_key(found, ["mention"], F.desc("match_score"), F.asc("id"))


@query(HYBRID + """, q AS (SELECT mention, id, match_score, CASE WHEN category = 'PROMO' THEN 1 ELSE 0 END AS term FROM items),
k AS (SELECT *, row_number() OVER (PARTITION BY mention, term ORDER BY match_score DESC, id) AS r FROM q)
SELECT mention, id, round(max(match_score) + CASE WHEN bool_or(term > 0) THEN 0.15 ELSE 0 END, 9) AS score, bool_or(term > 0) AS from_hint FROM k WHERE r <= CASE WHEN term = 0 THEN 3 ELSE 2 END GROUP BY mention, id""")
def multi_query_pool(spark, sf_dir):
    """Three of the first term, two of the hint term, merged by id."""
    rows = hybrid_items(spark, sf_dir).select(F.col("mention").alias("entity"), F.when(F.col("category") == "PROMO", 1).otherwise(0).alias("term_pos"), "id", F.col("match_score").alias("score"))
    return retrieval.quota_pool(rows, {0: 3, 1: 2}).select(F.col("entity").alias("mention"), "id", F.round("score", 9).alias("score"), "from_hint")


@query(HYBRID + """, b AS (SELECT mention, id, match_score, category, round(match_score * 0.8 + CASE WHEN category = 'SMALL' THEN 0.2 ELSE 0 END + 0.25, 9) AS base FROM items)
SELECT mention, id, round(greatest(0, base * 0.8 + 0.2 * match_score - CASE WHEN category NOT IN ('general','common') AND category <> 'SMALL' THEN 0.15 ELSE 0 END), 9) AS final FROM b WHERE base >= 0.35
QUALIFY row_number() OVER (PARTITION BY mention ORDER BY round(greatest(0, base * 0.8 + 0.2 * match_score - CASE WHEN category NOT IN ('general','common') AND category <> 'SMALL' THEN 0.15 ELSE 0 END), 9) DESC, id) <= 5""")
def soft_gate_rank(spark, sf_dir):
    """Local score with a domain and a suggestion, then the soft domain gate."""
    items = hybrid_items(spark, sf_dir, few_of_each(spark, sf_dir, 5)).withColumn("wanted", F.lit("SMALL"))
    base = ranking.local_final(F.col("match_score"), F.col("wanted"), F.col("category"), F.lit(0.0), ranking.suggestion_boost(F.lit(0.9)))
    gated = ranking.soft_gate(items.withColumn("base", F.round(base, 9)), "base", "match_score", "category", "wanted").withColumn("final", F.round("final", 9))
    return relational.top_per_key(gated, ["mention"], 5, F.desc("final"), F.asc("id")).select("mention", "id", "final")


@query(HYBRID + """, s AS (SELECT mention, id, round(trigram * (0.10 + 0.35 * 0.14) + jaro_winkler * (0.20 + 0.35 * 0.43) + greatest(0, 1 - (1 - match_score)) * (0.55 + 0.35 * 0.43)
 + CASE WHEN category = 'LARGE' THEN 0.2 ELSE -0.10 END - CASE WHEN category = 'ECONOMY' THEN 0.12 ELSE 0 END + CASE WHEN id % 10 = 0 THEN 0.15 ELSE 0 END, 9) AS score FROM items)
SELECT mention, id, score FROM s QUALIFY row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) <= 5""")
def multi_signal_rerank(spark, sf_dir):
    score = ranking.multi_signal(F.col("trigram"), F.col("jaro_winkler"), 1 - F.col("match_score"), F.when(F.col("category") == "LARGE", 1).otherwise(-1), F.col("category") == "ECONOMY", F.col("id") % 10 == 0)
    rows = hybrid_items(spark, sf_dir, few_of_each(spark, sf_dir, 5, F.col("id") % 10 == 0)).withColumn("score", F.round(score, 9))
    return relational.top_per_key(rows, ["mention"], 5, F.desc("score"), F.asc("id")).select("mention", "id", "score")


@query("""
WITH n AS (SELECT DISTINCT p_brand || ' ' || p_name || CASE WHEN p_partkey % 7 = 0 THEN ' and nut' ELSE '' END AS name, p_type = 'PROMO' AS preferred FROM part UNION ALL SELECT DISTINCT substr(p_brand || ' ' || p_name, 3, 12), false FROM part UNION ALL SELECT DISTINCT substr(p_name, 2, 2), false FROM part),
k AS (SELECT name, bool_or(preferred) AS preferred FROM n GROUP BY name)
SELECT name, round((CASE WHEN EXISTS (SELECT 1 FROM k o WHERE o.name <> k.name AND contains(o.name, k.name)) THEN -0.1 ELSE 0 END)
  + CASE WHEN len(string_split(name, ' ')) BETWEEN 2 AND 3 AND preferred THEN 0.05 ELSE 0 END + CASE WHEN len(string_split(name, ' ')) >= 4 THEN -0.08 ELSE 0 END, 9)::DOUBLE AS change FROM k
""")
def tie_breaker(spark, sf_dir):
    """Names, their beginnings, middles and short parts; which of them lie within a longer one."""
    part = table(spark, sf_dir, "part")
    whole = F.concat_ws(" ", "p_brand", "p_name")
    names = part.select(F.concat(whole, F.when(F.col("p_partkey") % 7 == 0, " and nut").otherwise("")).alias("name"), (F.col("p_type") == "PROMO").alias("p"))
    names = names.unionByName(part.select(F.substring(whole, 3, 12).alias("name"), F.lit(False).alias("p"))).unionByName(part.select(F.substring("p_name", 2, 2).alias("name"), F.lit(False).alias("p")))
    k = names.groupBy("name").agg(F.bool_or("p").alias("preferred"))
    rows = k.join(retrieval.contained_names(k).withColumn("inside", F.lit(True)), "name", "left")
    return rows.select("name", F.round(ranking.tie_breaker(F.col("name"), F.coalesce("inside", F.lit(False)), F.col("preferred")), 9).alias("change"))


@query(HYBRID + """, v AS (SELECT mention, id, trigram, jaro_winkler * 0.4 AS ph, match_score * 0.3 AS ve FROM items)
SELECT mention, id, round(CASE WHEN ph > 0.15 THEN greatest(greatest(trigram, ve), CASE WHEN trigram < 0.1 AND ph BETWEEN 0.15 AND 0.4 AND ph < 0.25 THEN greatest(0.80, 3.5 * ph) WHEN trigram < 0.1 AND ph BETWEEN 0.15 AND 0.4 THEN greatest(0.95, 2.5 * ph)
 WHEN ph BETWEEN 0.15 AND 0.4 THEN least(1, 2 * ph) ELSE least(1, 1.5 * ph) END) ELSE greatest(trigram, ve) END, 9) AS score FROM v""")
def phonetic_boost(spark, sf_dir):
    score = ranking.phonetic_boost(F.col("trigram"), F.col("jaro_winkler") * 0.4, F.col("match_score") * 0.3, F.lit(0.9))
    return hybrid_items(spark, sf_dir).select("mention", "id", F.round(score, 9).alias("score"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


D = "list_transform(embedding, lambda z: z::DOUBLE)"


@query(f"""
WITH e AS (SELECT vec_id, {D} AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS l FROM e),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(a.v, b.v) / (a.l * b.l), 5) AS score FROM n a, n b WHERE a.vec_id <> b.vec_id)
SELECT query_id, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5
""")
def knn_cosine(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = retrieval.exact_knn(v, v, "id", "v", 5, digits=5).select("query_id", "id", F.round("score", 5).alias("score"))
    return relational.top_per_key(found, ["query_id"], 5, F.desc("score"), F.asc("id")).drop("rank")


@query(f"""
WITH e AS (SELECT vec_id, {D} AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_distance(a.v, b.v), 6) AS distance FROM e a, e b WHERE a.vec_id <> b.vec_id)
SELECT query_id, id, distance FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 5
""")
def knn_l2(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = retrieval.exact_knn(v, v, "id", "v", 5, "l2", digits=6).select("query_id", "id", F.round(-F.col("score"), 6).alias("distance"))
    return relational.top_per_key(found, ["query_id"], 5, F.asc("distance"), F.asc("id")).drop("rank")


@query(f"""
WITH e AS (SELECT vec_id, label, {D} AS v FROM embeddings), n AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS l FROM e),
s AS (SELECT a.vec_id AS query_id, b.label AS concept, b.vec_id AS id, round(list_inner_product(a.v, b.v) / (a.l * b.l), 5) AS score FROM n a, n b WHERE a.vec_id <> b.vec_id),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, concept ORDER BY score DESC, id) = 1)
SELECT query_id, concept, id, score FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept) <= 3
""")
def lateral_topk_distinct(spark, sf_dir):
    """Best vector of each label for every query, then the three best labels: neighbours are searched label by label."""
    v = vectors(spark, sf_dir)
    found = retrieval.exact_knn(v, v, "id", "v", 1, group_col="label", digits=5).select("query_id", F.col("group").alias("concept"), "id", F.round("score", 5).alias("score"))
    best = relational.best_per_key(found, ["query_id", "concept"], F.desc("score"), F.asc("id"))
    return relational.top_per_key(best, ["query_id"], 3, F.desc("score"), F.asc("concept")).drop("rank")


@query(f"""
WITH e AS (SELECT vec_id, label, {D} AS v FROM embeddings), u AS (SELECT label, generate_subscripts(v, 1) AS k, unnest(v) AS x FROM e),
m AS (SELECT label, k, avg(x) AS x FROM u GROUP BY label, k), c AS (SELECT label, list(x ORDER BY k) AS a FROM m GROUP BY label),
s AS (SELECT vec_id, c.label AS domain, round(list_inner_product(v, a) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(a, a))), 6) AS affinity FROM e, c)
SELECT vec_id AS id, CASE WHEN affinity >= 0.75 THEN domain END AS domain, affinity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY affinity DESC, domain DESC) = 1
""")
def domain_affinity(spark, sf_dir):
    """Anchors are the labels' mean vectors."""
    v = vectors(spark, sf_dir)
    means = v.select("label", F.posexplode(vector.as_double(F.col("v"))).alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"))
    anchors = means.groupBy(F.col("label").alias("domain")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("a"))
    return retrieval.anchor_affinity(v, anchors, 0.75).withColumn("affinity", F.round("affinity", 6))


@query(f"""
WITH e AS (SELECT vec_id, {D} AS v FROM embeddings)
SELECT vec_id AS id, round(list_inner_product(v, v), 4) AS kept, len(v)::INTEGER AS dim FROM e
""")
def vector_literal_round_trip(spark, sf_dir):
    back = vectors(spark, sf_dir).select("id", "v", vector.from_literal(vector.to_literal(F.col("v"))).alias("w"))
    return back.select("id", F.round(vector.dot(F.col("v"), F.col("w")), 4).alias("kept"), F.size("w").alias("dim"))


BM25 = f"""
WITH d AS (SELECT doc_id, {words_sql("text")} AS w FROM documents), q AS (SELECT item_id AS query_id, unnest(list_distinct({words_sql("text")})) AS term FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM d), tf AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d),
t AS (SELECT doc_id, dl, term, count(*)::DOUBLE AS tf FROM tf WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score FROM t JOIN f USING (term) JOIN q USING (term), st GROUP BY query_id, doc_id)
"""


@query(BM25 + "SELECT query_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10")
def bm25_topk(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(q, table(spark, sf_dir, "documents"), 10).drop("rank")


@query(BM25 + "SELECT query_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10")
def bm25_indexed(spark, sf_dir):
    """An index of the documents, a tenth of them with other texts, then brought up to date and searched."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "text-index")
    k = F.col("doc_id")
    old = docs.select("doc_id", F.when(k % 10 == 3, F.concat(F.lit("before it was changed "), F.substring("text", 1, 50))).otherwise(F.col("text")).alias("text"))
    text_index.update(old.unionByName(docs.where(k % 50 == 0).select((-k - 1).alias("doc_id"), "text")), folder)
    text_index.update(docs.where(k % 10 == 3), folder, deleted=docs.where(k % 50 == 0).select((-k - 1).alias("doc_id")))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return text_index.search(q, folder, 10).drop("rank")


HYBRID_CAT = BM25 + """, k AS (SELECT query_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10),
mm AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS b FROM k WINDOW w AS (PARTITION BY query_id)),
h AS (SELECT query_id, doc_id, round(least(1, 0.65 * ((doc_id % 100) / 100.0) + 0.35 * b + CASE WHEN doc_id % 7 = query_id % 7 THEN 0.35 ELSE 0 END), 6) AS score FROM mm)
"""


@query(HYBRID_CAT + "SELECT query_id, doc_id, score, CASE WHEN score < 0.5 THEN 'new_product' WHEN score >= 0.8 AND doc_id % 2 = 0 THEN 'add_quantity' WHEN score >= 0.8 THEN 'new_batch' ELSE 'ask_user' END AS action FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3")
def hybrid_catalogue_action(spark, sf_dir):
    """Min-max BM25, a cosine (stand-in column) and equal codes; then what to do with the stock."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = ranking.min_max(retrieval.bm25(q, table(spark, sf_dir, "documents"), 10).drop("rank"), "query_id", "score", "b")
    score = F.round(ranking.hybrid_catalogue((F.col("doc_id") % 100) / 100.0, F.col("b"), F.col("doc_id") % 7 == F.col("query_id") % 7), 6)
    rows = found.select("query_id", "doc_id", score.alias("score"))
    top = relational.top_per_key(rows, ["query_id"], 3, F.desc("score"), F.asc("doc_id")).drop("rank")
    return top.withColumn("action", ranking.inventory_action(F.col("score"), F.col("doc_id") % 2 == 0))


@query(f"""
WITH m AS ({MENTIONS} UNION SELECT DISTINCT p_name FROM part), e AS (SELECT DISTINCT mention, p_name AS name FROM m JOIN part ON lower(p_name) = lower(mention)),
r AS (SELECT mention, {trigrams_sql("mention")} AS t FROM m WHERE mention NOT IN (SELECT mention FROM e)), n AS (SELECT DISTINCT p_name AS name, {trigrams_sql("p_name")} AS t FROM part),
f AS (SELECT mention, name, round(len(list_intersect(r.t, n.t)) / (len(r.t) + len(n.t) - len(list_intersect(r.t, n.t))), 9) AS score FROM r, n)
SELECT mention, name, 1.0::DOUBLE AS score, 'exact' AS stage FROM e UNION ALL
SELECT mention, name, score, 'trigram' FROM (SELECT * FROM f WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY mention ORDER BY score DESC, name) = 1)
""")
def exact_then_trigram(spark, sf_dir):
    """An exact hit ends the search; the rest goes to trigrams."""
    names = catalogue(spark, sf_dir).select("name").distinct()
    m = mentions(spark, sf_dir).union(names).distinct()
    exact = m.join(names, F.lower("mention") == F.lower("name")).select("mention", "name", F.lit(1.0).alias("score"), F.lit("exact").alias("stage"))

    def fuzzy(missing: DataFrame) -> DataFrame:
        found = retrieval.trigram_join(missing.select(F.col("mention").alias("name")), names, "name", 0.3)
        found = found.select(F.col("a").alias("mention"), F.col("b").alias("name"), F.round("similarity", 9).alias("score"), F.lit("trigram").alias("stage"))
        return relational.best_per_key(found, ["mention"], F.desc("score"), F.asc("name"))

    return retrieval.escalated(exact, m, "mention", fuzzy)
