"""Queries on look-ups, gates, picks, coverage and evaluation over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notes, predicates as p, text
from ..functions.phonetic import double_metaphone, jaro_winkler_similarity, metaphone
from ..operators import entities, relational, retrieval, routing
from ..sources import artifacts, files
from .records import INTENTS, KINDS, any_sql, case_sql, in_sql, pick, spark_pick
from .registry import jaro_winkler_sql, query, table, trigrams_sql, words_sql
from .similarity import D, mentions, vectors


@query("""
WITH c AS (SELECT * FROM customer WHERE c_nationkey = 7)
SELECT o_orderkey, c_name AS name, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END, ''), 'unit') AS unit FROM orders LEFT JOIN c ON CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END = c_custkey
""")
def point_lookup(spark, sf_dir):
    """Orders with the one row of their customer, of one tenant; the unit falls back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("k"))
    c = entities.where_given(entities.where_given(table(spark, sf_dir, "customer"), "c_nationkey", 7), "absent", 1)
    c = c.withColumn("unit", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")))
    got = entities.looked_up(o, c, "k", "c_custkey", {"name": "c_name", "own": "unit"})
    unit = F.when(F.col("name").isNull(), F.lit("unit")).otherwise(text.first_filled(F.col("own"), F.lit("unit")))
    return got.select("o_orderkey", "name", unit.alias("unit"))


@query("""
SELECT 'customer' AS name, count(*) AS n, count(*) >= 1000000 AS enough, count(*) FILTER (WHERE c_custkey % 3 = 0) AS blanks FROM customer
UNION ALL SELECT 'supplier', count(*), count(*) >= 1, 0 FROM supplier
""")
def load_checks(spark, sf_dir):
    """Row counts against the least a load must bring; blank strings turned to nulls are counted."""
    c = table(spark, sf_dir, "customer").withColumn("note", F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise("x"))
    report = entities.load_report({"customer": c, "supplier": table(spark, sf_dir, "supplier")}, {"customer": 1_000_000})
    nulls = entities.scrubbed(c, ["note"]).agg(F.count_if(F.col("note").isNull()).alias("b")).select(F.lit("customer").alias("of"), "b")
    return report.join(F.broadcast(nulls), F.col("name") == F.col("of"), "left").select("name", "n", "enough", F.coalesce("b", F.lit(0)).alias("blanks"))  # one row


@query(f"""
WITH m AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 1, 3) || 'zz' WHEN 1 THEN '' WHEN 2 THEN 'qqqq wwww' ELSE p_name END AS span FROM part), n AS (SELECT DISTINCT p_name AS name FROM part),
s AS (SELECT span, max(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))) AS x FROM (SELECT DISTINCT span, {trigrams_sql("span")} AS a FROM m), (SELECT name, {trigrams_sql("name")} AS b FROM n) GROUP BY span)
SELECT p_partkey, span FROM m JOIN s USING (span) WHERE span = '' OR x >= 0.2
""")
def whitelist_filter(spark, sf_dir):
    """Mentions near enough to some name of the catalogue; blank ones stay."""
    k = F.col("p_partkey") % 4
    parts = table(spark, sf_dir, "part")
    m = parts.select("p_partkey", F.when(k == 0, F.concat(F.substring("p_name", 1, 3), F.lit("zz"))).when(k == 1, "").when(k == 2, "qqqq wwww").otherwise(F.col("p_name")).alias("span"))
    return entities.whitelisted(m, parts.select(F.col("p_name").alias("name")).distinct(), "span")


@query(f"""
SELECT kind, array_to_string(coalesce(spans, []), ',') AS spans FROM (SELECT unnest({KINDS[:6] + ["Nothing"]}) AS kind) k LEFT JOIN (SELECT {pick(KINDS, "s_suppkey")} AS kind, list(s_name ORDER BY s_suppkey) AS spans FROM supplier GROUP BY 1) USING (kind)
""")
def spans_by_kind(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in KINDS[:6] + ["Nothing"]], "kind string")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), spark_pick(KINDS, F.col("s_suppkey")).alias("kind"), F.col("s_name").alias("span"))
    return entities.by_kind(rows, F.broadcast(kinds)).select("kind", F.array_join("spans", ",").alias("spans"))  # a fixed list of kinds


TERMS = ["x ray; blood test ;", "recheck", " ; ", "vaccine;deworming"]


@query(f"SELECT c_custkey, array_to_string(list_filter(list_transform(string_split({pick(TERMS, 'c_custkey')}, ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS terms FROM customer")
def multi_intent_terms(spark, sf_dir):
    """Search terms that stand for several intents, cut apart."""
    t = F.filter(F.transform(F.split(spark_pick(TERMS, F.col("c_custkey")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(t, "|").alias("terms"))


QUERIES = ["heart rate", "hart rate", "body weight", "rate of pain", "mentation", "wight of body", "pulse"]
VITAL_ROWS = [(label, key, [label.split()[-1].lower()]) for label, key, _ in notes.VITALS]


@query(f"""
WITH m AS (SELECT DISTINCT {pick(QUERIES, "doc_id")} AS mention FROM documents), v AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{c[0]}')" for a, b, c in VITAL_ROWS)}) t(label, key, synonym)),
s AS (SELECT mention, key, CASE WHEN mention = lower(label) OR mention = synonym THEN 1.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS score FROM (SELECT mention, {trigrams_sql("mention")} AS a FROM m), (SELECT *, {trigrams_sql("label")} AS b FROM v))
SELECT mention, key, round(score, 9) AS score FROM s WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY mention ORDER BY score DESC, key) <= 3
""")
def vitals_search(spark, sf_dir):
    """Vital signs by name: exact names and synonyms count full, others by trigrams."""
    m = table(spark, sf_dir, "documents").select(spark_pick(QUERIES, F.col("doc_id")).alias("mention")).distinct()
    dim = spark.createDataFrame(VITAL_ROWS, "label string, key string, synonyms array<string>")
    met = m.crossJoin(F.broadcast(dim))  # eleven fixed rows
    exact = (F.col("mention") == F.lower("label")) | F.array_contains("synonyms", F.col("mention"))
    scored = met.select("mention", "key", F.round(F.when(exact, 1.0).otherwise(text.trigram_similarity(F.col("mention"), F.col("label"))), 9).alias("score"))
    return relational.top_per_key(scored.where("score >= 0.2"), ["mention"], 3, F.desc("score"), F.asc("key")).drop("rank")


@query(f"""
WITH e AS (SELECT vec_id, label, {D} AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.label AS concept, b.vec_id AS id, round(list_distance(a.v, b.v), 6) AS distance FROM e a, e b WHERE a.vec_id <> b.vec_id AND a.vec_id % 20 = 0),
near AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 9)
SELECT query_id, concept, distance FROM (SELECT query_id, concept, min(distance) AS distance FROM near GROUP BY query_id, concept) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, concept) <= 3
""")
def chunk_concepts(spark, sf_dir):
    """The first three concepts among three times as many nearest chunks of a stated query set."""
    v = vectors(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("label").alias("concept"))
    found = retrieval.exact_knn(v.where("id % 20 = 0"), v, "id", "v", 12, "l2").select("query_id", "id", F.round(-F.col("score"), 6).alias("distance"))
    near = relational.top_per_key(found, ["query_id"], 9, F.asc("distance"), F.asc("id"))
    return entities.first_concepts(near.join(labels, F.col("id") == F.col("chunk")), 3)


CANDIDATES_SQL = """
c AS (SELECT c_custkey AS mention, n_name AS name, 'term ' || n_name AS other, CASE n_nationkey % 3 WHEN 0 THEN 'Pharmacy' WHEN 1 THEN 'Surgery' ELSE 'Toys' END AS category, CASE WHEN c_custkey % 4 = 0 THEN 'Toys' END AS hint,
  (['medical', 'non-medical', 'general', 'x'])[c_custkey % 4 + 1] AS service_type, round(c_acctbal / 10000, 6) AS score, CASE WHEN c_custkey % 3 = 0 THEN ' ' || lower(n_name) ELSE 'the ' || lower(n_name) || ' tablet' END AS term, c_custkey % 10 / 10.0 + 0.05 AS certainty, CASE WHEN n_nationkey % 2 = 0 THEN 'local' ELSE 'global' END AS source FROM customer JOIN nation ON n_regionkey = c_nationkey % 5)
"""


def candidates(spark, sf_dir):
    """Every customer as a mention with the nations of a region as candidates."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    met = c.join(n, F.col("n_regionkey") == F.col("c_nationkey") % 5)
    k = F.col("c_custkey")
    return met.select(
        k.alias("mention"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "Pharmacy").when(F.col("n_nationkey") % 3 == 1, "Surgery").otherwise("Toys").alias("category"), F.when(k % 4 == 0, "Toys").alias("hint"),
        spark_pick(["medical", "non-medical", "general", "x"], k).alias("service_type"), F.round(F.col("c_acctbal") / 10000, 6).alias("score"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), F.lower("n_name"))).otherwise(F.concat(F.lit("the "), F.lower("n_name"), F.lit(" tablet"))).alias("term"), (k % 10 / 10.0 + 0.05).alias("certainty"),
        F.when(F.col("n_nationkey") % 2 == 0, "local").otherwise("global").alias("source"), (F.col("n_nationkey") % 7 == 0).alias("is_form"),
    )


@query(f"""
WITH {CANDIDATES_SQL} SELECT mention, name FROM c WHERE CASE WHEN hint IS NOT NULL THEN category = hint WHEN service_type IN ('medical', 'general') THEN category <> 'Toys' WHEN service_type = 'non-medical' THEN category = 'Toys' ELSE true END
""")
def hint_gate(spark, sf_dir):
    return entities.hint_gate(candidates(spark, sf_dir), ["Pharmacy", "Surgery"]).select("mention", "name")


@query(f"""
WITH {CANDIDATES_SQL}, s AS (SELECT mention, name, score, CASE WHEN trim(term) = lower(name) THEN 1 WHEN len(list_filter(list_intersect({words_sql("term")}, {words_sql("name")}), lambda w: length(w) >= 4)) > 0 THEN 3 END AS step FROM c)
SELECT mention, name, step FROM s WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mention ORDER BY step, score DESC, name) = 1
""")
def safe_context(spark, sf_dir):
    """The candidate that a mention may take as context."""
    return entities.safe_context(candidates(spark, sf_dir), p.FORM_WORDS).select("mention", "name", "step")


@query(f"""
WITH {CANDIDATES_SQL} SELECT mention, name, 'dual_sync_high_certainty_auto_link_' || source AS match_method FROM c WHERE certainty >= 0.9 AND trim(term) = lower(name) QUALIFY row_number() OVER (PARTITION BY mention ORDER BY source = 'global', name) = 1
""")
def certainty_fast_track(spark, sf_dir):
    """Sure mentions go to an exact name at once, the local one first."""
    return entities.fast_tracked(candidates(spark, sf_dir)).select("mention", "name", "match_method")


@query(f"""
WITH {CANDIDATES_SQL} SELECT mention, name, row_number() OVER (PARTITION BY mention ORDER BY category <> 'Surgery', score DESC, name) AS place FROM c QUALIFY place <= 3
""")
def forced_candidates(spark, sf_dir):
    """Hits come before all other candidates of a mention."""
    return entities.forced_first(candidates(spark, sf_dir), F.col("category") == "Surgery", 3).select("mention", "name", "place")


@query("""
WITH st AS (SELECT o_custkey AS mention, o_orderkey AS id, round(o_totalprice / 500000, 6) AS score FROM orders WHERE o_orderkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) = 1),
se AS (SELECT o_custkey AS mention, o_orderkey AS id, round(o_totalprice / 500000, 6) AS score FROM orders WHERE o_orderkey % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) = 1)
SELECT coalesce(st.mention, se.mention) AS mention, CASE WHEN coalesce(st.score, -1) >= coalesce(se.score, -1) OR st.score >= 0.6 THEN st.id END AS stock, CASE WHEN coalesce(st.score, -1) < coalesce(se.score, -1) OR se.score >= 0.6 THEN se.id END AS service FROM st FULL JOIN se ON st.mention = se.mention
""")
def dual_ids(spark, sf_dir):
    """The chosen id and the best of the other source where that is sure enough."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mention"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 500000, 6).alias("score"))
    return entities.dual_ids(o.where("id % 3 = 0"), o.where("id % 3 <> 0"), 0.6)


METHODS = {"dual_sync": "dual_sync_resolved", "skip_vitals": "preserved", "global_vitals": "global_vitals_registry", "skip_signalment": "signalment_preserved", "skip_non_billable": "non_billable_preserved"}
ROUTED = ["Medication", "Anatomy", "VitalSign", "Other"]


@query(f"""
WITH e AS (SELECT event_id, {pick(ROUTED, "event_id")} AS kind, user_id % 3 = 0 AS complaint FROM events),
x AS (SELECT event_id, unnest(CASE WHEN complaint THEN [kind, 'ReasonForVisit'] ELSE [kind] END) AS kind FROM e)
SELECT event_id, kind, CASE kind WHEN 'Medication' THEN 'dual_sync_resolved' WHEN 'ReasonForVisit' THEN 'dual_sync_resolved' WHEN 'Anatomy' THEN 'non_billable_preserved' WHEN 'VitalSign' THEN 'preserved' ELSE 'other_preserved' END AS match_method FROM x
""")
def route_executor(spark, sf_dir):
    """Every entity, and the complaint it may also be, through the branch of its route."""
    e = table(spark, sf_dir, "events").select("event_id", spark_pick(ROUTED, F.col("event_id")).alias("kind"), routing.roles(F.lit(0.0), F.when(F.col("user_id") % 3 == 0, 0.9).otherwise(0.1), F.lit(0.0)).alias("roles"))
    x = entities.with_presenting(e).withColumn("route", routing.route(F.col("kind"), F.lit("seen"), F.array().cast("array<string>")))
    return entities.by_route(x, METHODS, "other_preserved").select("event_id", "kind", "match_method")


@query(f"""
WITH m AS (SELECT o_custkey AS visit, {pick(KINDS, "o_orderkey")} AS kind FROM orders), t AS (SELECT visit, unnest(string_split({case_sql("kind", p.KB_KINDS)}, ',')) AS k FROM m)
SELECT visit, array_to_string(list_sort(list(DISTINCT k)), ',') AS kinds FROM t WHERE k IN ('Drug', 'Condition', 'Procedure', 'Anatomy') GROUP BY visit
""")
def manifest_kinds(spark, sf_dir):
    """The schema's kinds that a visit needs."""
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("visit"), spark_pick(KINDS, F.col("o_orderkey")).alias("kind"))
    return entities.schema_kinds(m, p.KB_KINDS, ["Drug", "Condition", "Procedure", "Anatomy"]).select("visit", F.array_join("kinds", ",").alias("kinds"))


@query(f"""
WITH a AS (SELECT o_custkey AS visit, o_orderkey, {pick(KINDS, "o_orderkey")} AS kind, {pick(INTENTS, "o_orderkey // 2")} AS intent, o_orderpriority AS concept FROM orders),
m AS (SELECT * FROM a WHERE kind IN {in_sql(p.MEDICINE_KINDS)} AND intent IN {in_sql(p.MEDICINE_INTENTS)})
SELECT visit, count(DISTINCT lower(concept)) AS covered, string_agg(DISTINCT lower(concept), '|' ORDER BY lower(concept)) AS concepts, count(*) AS blobs FROM m GROUP BY visit
""")
def medicine_coverage(spark, sf_dir):
    """Concepts that a visit's medicines cover, and their text blobs."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("visit"), spark_pick(KINDS, F.col("o_orderkey")).alias("kind"), spark_pick(INTENTS, F.floor(F.col("o_orderkey") / 2)).alias("intent"), F.col("o_orderpriority").alias("concept"))
    m = a.where(p.is_medicine_atom(F.col("kind"), F.col("intent"))).select("visit", p.concept_key(F.col("concept")).alias("concept"))
    return m.groupBy("visit").agg(F.count_distinct("concept").alias("covered"), F.array_join(F.array_sort(F.collect_set("concept")), "|").alias("concepts"), F.count(F.lit(1)).alias("blobs"))


@query("""
WITH u AS (SELECT o_custkey AS visit, 0 AS part, o_orderkey AS pos, lower(o_orderpriority) AS issue FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, 1, o_orderkey, lower(o_orderpriority) FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT c_custkey, 2, 0, lower(c_mktsegment) FROM customer)
SELECT visit, part, issue FROM u QUALIFY row_number() OVER (PARTITION BY visit, issue ORDER BY part, pos) = 1
""")
def issue_collection(spark, sf_dir):
    """Issues of three sources, each once a visit, where it came first."""
    o = table(spark, sf_dir, "orders")
    of = lambda df, part, visit, pos, c: df.select(F.col(visit).alias("visit"), F.lit(part).alias("part"), pos.alias("pos"), p.concept_key(F.col(c)).alias("issue"))
    u = of(o.where("o_orderkey % 2 = 0"), 0, "o_custkey", F.col("o_orderkey"), "o_orderpriority").unionByName(of(o.where("o_orderkey % 3 = 0"), 1, "o_custkey", F.col("o_orderkey"), "o_orderpriority"))
    u = u.unionByName(of(table(spark, sf_dir, "customer"), 2, "c_custkey", F.lit(0).cast("long"), "c_mktsegment"))
    return relational.best_per_key(u, ["visit", "issue"], F.asc("part"), F.asc("pos")).select("visit", "part", "issue")


@query("""
SELECT e.event_id, coalesce(CASE WHEN e.event_id % 2 = 0 THEN e.event_type END, s.event_type) AS event_type, e.value FROM events e LEFT JOIN (SELECT event_id, event_type FROM events WHERE event_id % 3 = 0) s USING (event_id)
""")
def metadata_carry_over(spark, sf_dir):
    """Results take over what their source has and they lack."""
    e = table(spark, sf_dir, "events")
    r = e.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("event_type"), "value")
    return entities.carried_over(r, e.where("event_id % 3 = 0").select("event_id", "event_type"), "event_id", ["event_type"])


@query("""
SELECT o_orderkey, 'm' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' dental' ELSE '' END || ' ' || o_orderpriority AS context_query, 'pets: ' || o_orderpriority AS prefixed,
  '{"id":' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ',"domain":"dental"' ELSE '' END || ',"name":"m' || o_custkey || '"}' AS compact, o_totalprice + CASE WHEN o_orderkey % 4 <> 0 THEN 100 ELSE 0 END AS perceived, o_shippriority_ok AS relevant
FROM (SELECT *, (o_orderkey % 10 / 10.0 >= 0.8) AS o_shippriority_ok FROM orders)
""")
def context_payloads(spark, sf_dir):
    """Context queries, prefixed texts, sparse payloads, merged timings and domain relevance."""
    k = F.col("o_orderkey")
    name, domain = F.concat(F.lit("m"), F.col("o_custkey")), F.when(k % 2 == 0, "dental")
    compact = F.to_json(F.struct(k.alias("id"), domain.alias("domain"), name.alias("name")), {"ignoreNullFields": "true"})
    relevant = entities.is_relevant(k % 10 / 10.0, F.lit(0.9))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", name, domain, "o_orderpriority").alias("context_query"), F.concat(F.lit("pets: "), "o_orderpriority").alias("prefixed"), compact.alias("compact"), (F.col("o_totalprice") + F.when(k % 4 != 0, 100).otherwise(0)).alias("perceived"), relevant.alias("relevant"))


@query("""
SELECT s_name || ' (' || lower(n_name) || ', s' || s_suppkey || ')' AS line FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 30
""")
def registry_excerpt(spark, sf_dir):
    """A report: the first thirty rows of a registry, with two synonyms each."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nations: a fixed table
    rows = s.withColumn("synonyms", F.array(F.lower("n_name"), F.concat(F.lit("s"), F.col("s_suppkey")), F.lit("third")))
    return entities.excerpt(rows, "s_name", "synonyms", [F.asc("s_suppkey")], 30, 2)


@query(f"""
WITH m AS (SELECT DISTINCT substr(p_name, 1, 2) || substr(p_name, 4) AS a, p_name, p_brand, p_type FROM part),
s AS (SELECT DISTINCT a, p_name, p_brand, p_type, greatest({jaro_winkler_sql("lower(a)", "lower(p_name)")}, {jaro_winkler_sql("lower(a)", "lower(p_brand)")}, {jaro_winkler_sql("lower(a)", "lower(p_type)")}) AS score FROM m)
SELECT a AS mention, p_name, p_brand, p_type, round(score, 9) AS score FROM s
""")
def best_over_fields(spark, sf_dir):
    """The best Jaro-Winkler similarity of a mention to the name, brand and type of its item."""
    m = table(spark, sf_dir, "part").select(F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)")).alias("mention"), "p_name", "p_brand", "p_type").distinct()
    return m.withColumn("score", F.round(F.greatest(*(jaro_winkler_similarity("mention", c) for c in ("p_name", "p_brand", "p_type"))), 9))


OVERLAP_SQL = lambda g, h: f"CASE WHEN len({words_sql(g)}) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({words_sql(g)}), list_distinct({words_sql(h)}))) / len(list_distinct({words_sql(g)})) END"


@query(f"""
WITH p AS (SELECT b.item_id, b.text AS gold, d.text AS found, c.config FROM benchmark b JOIN documents d ON d.doc_id = b.item_id JOIN (VALUES ('one'), ('two')) c(config) ON true),
s AS (SELECT config, item_id, {OVERLAP_SQL("gold", "CASE WHEN config = 'one' THEN found ELSE gold END")} AS overlap, CASE WHEN found IS NULL THEN 1 ELSE 0 END AS missing FROM p)
SELECT config, count(*) AS items, sum(missing)::BIGINT AS missing, round(avg(overlap), 9) AS mean_overlap, round(avg(overlap) - (SELECT avg(overlap) FROM s WHERE config = 'one'), 9) AS against_baseline FROM s GROUP BY config
""")
def model_comparison(spark, sf_dir):
    """Mean overlap with the gold texts by configuration, and against the baseline."""
    b, d = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("found"))
    p_ = b.join(d, "item_id").select("item_id", "gold", "found", F.explode(F.array(F.lit("one"), F.lit("two"))).alias("config"))
    found = F.when(F.col("config") == "one", F.col("found")).otherwise(F.col("gold"))
    s = p_.select("config", text.token_overlap(F.col("gold"), found, 1.0).alias("overlap"), F.col("found").isNull().cast("long").alias("missing"))
    means = s.groupBy("config").agg(F.count(F.lit(1)).alias("items"), F.sum("missing").alias("missing"), F.avg("overlap").alias("mean"))
    base = means.where("config = 'one'").select(F.col("mean").alias("base"))
    out = means.crossJoin(F.broadcast(base))  # one row
    return out.select("config", "items", "missing", F.round("mean", 9).alias("mean_overlap"), F.round(F.col("mean") - F.col("base"), 9).alias("against_baseline"))


@query("""
SELECT o_orderkey AS id, o_orderpriority AS stage, o_totalprice AS ms, o_orderstatus = 'F' AS done, (SELECT count(*) FROM orders WHERE o_orderkey % 3 > 0) AS n_rows, (SELECT sum(length(o_orderpriority)) FROM orders WHERE o_orderkey % 3 > 0)::BIGINT AS n_chars FROM orders WHERE o_orderkey % 3 > 0
""")
def artifact_round_trip(spark, sf_dir):
    """Two runs of stage timings written as artifacts; the pointer leads to the second one, its manifest has the counts."""
    artifacts.register(spark)
    path = files.scratch(spark, "artifacts")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("stage"), F.col("o_totalprice").alias("ms"), (F.col("o_orderstatus") == "F").alias("done"))
    for keep in ("id % 3 = 0", "id % 3 > 0"):
        rows.where(keep).write.format("artifact").option("text", "stage").mode("append").save(path)
    told = artifacts.latest(path)
    back = spark.read.format("artifact").schema("id long, stage string, ms double, done boolean").load(path)
    return back.withColumns({"n_rows": F.lit(told["rows"]), "n_chars": F.lit(told["chars"]).cast("long")})


@query()
def stored_listing(spark, sf_dir):
    """The table's own files by folder: the newest one of each, as the artifact scans take it."""
    found = files.glob_filter(files.listing(spark, sf_dir, "*.parquet"), "path", ["*"], ["*_SUCCESS*"])
    return files.newest(found).select("folder", F.element_at(F.split("path", "/"), -1).alias("file"))


@query("""
SELECT e.user_id, arg_max(e.event_type, (e.ts, e.event_id)) AS name_by_id, n.n_name AS name_by_key FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 40 GROUP BY e.user_id, n.n_name
""")
def fallback_fetch(spark, sf_dir):
    """A concept by its id, and by its key where that fails: two left joins."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("name_by_id"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("name_by_key"))
    return e.join(F.broadcast(n), F.col("user_id") % 40 == F.col("n_nationkey"), "left").drop("n_nationkey")  # nations: a fixed table


# The words of the given parts' names; their phonetic keys reach the SQL as a table of values, since DuckDB has no such function.
WORDS = (["blue", "cold", "hot", "large", "new", "old", "red", "small"], ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"])
SPOKEN = sorted({x for a in WORDS[0] for b in WORDS[1] for n in [f"{a} {b}"] for x in (n, n[:2] + n[3:])})
KEYS_SQL = "v AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{metaphone(s)}', ['k{metaphone(s)}', 'f{metaphone(s.split()[0])}', 'd{double_metaphone(s)[0]}', 'd{double_metaphone(s)[1]}'])" for s in SPOKEN) + ") t(s, key, codes))"


@query(f"""
WITH {KEYS_SQL}, m AS (SELECT DISTINCT substr(p_name, 1, 2) || substr(p_name, 4) AS mention FROM part), n AS (SELECT DISTINCT p_name AS name FROM part),
p AS (SELECT mention, name, {trigrams_sql("mention")} AS a, {trigrams_sql("name")} AS b, x.key AS ka, y.key AS kb, len(list_intersect(x.codes, y.codes)) > 0 AS sounds FROM m JOIN v x ON x.s = mention CROSS JOIN n JOIN v y ON y.s = name),
s AS (SELECT *, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS trigram, {jaro_winkler_sql("mention", "name")} AS jaro_winkler, greatest(0, 0.8 * (1 - levenshtein(ka, kb) / greatest(length(ka), length(kb), 1))) AS phonetic FROM p),
c AS (SELECT mention, name, round(trigram, 9) AS trigram, round(jaro_winkler, 9) AS jaro_winkler, round(phonetic, 9) AS phonetic, round(greatest(trigram, jaro_winkler), 9) AS match_score FROM s WHERE (trigram >= 0.3 OR sounds) AND greatest(trigram, jaro_winkler) >= 0.3)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY mention ORDER BY match_score DESC, phonetic DESC, name) <= 5
""")
def signal_search(spark, sf_dir):
    """Local search with all text signals: trigrams, Jaro-Winkler, metaphone and Double Metaphone recall, best signal by name."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    found = retrieval.signal_candidates(mentions(spark, sf_dir), names)
    found = found.select("mention", "name", *(F.round(c, 9).alias(c) for c in ("trigram", "jaro_winkler", "phonetic", "match_score")))
    return relational.top_per_key(found, ["mention"], 5, F.desc("match_score"), F.desc("phonetic"), F.asc("name")).drop("rank")
