"""Queries on relational operators: best rows, merges, upserts, set operations, windows, routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import entity_fold, linkage, ranking, relational, routing
from ..streaming import streams
from .registry import query, table


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1")
def distinct_on_best(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return relational.best_per_key(rows, ["l_orderkey"], F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def topk_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return relational.top_per_key(rows, ["l_suppkey"], 3, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")).drop("rank")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS r, lead(o_totalprice) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
SELECT o_custkey, o_orderkey, o_totalprice, round(o_totalprice - coalesce(s, 0), 6) AS margin FROM r WHERE r = 1
""")
def margin_top2(spark, sf_dir):
    return relational.top_margin(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey").withColumn("margin", F.round("margin", 6))


@query("""
SELECT l_orderkey, arg_min(l_linenumber, (-l_quantity, l_linenumber)) AS by_quantity, arg_min(l_linenumber, (-l_extendedprice, l_linenumber)) AS by_price, arg_min(l_linenumber, (-l_discount, l_linenumber)) AS by_discount FROM lineitem GROUP BY l_orderkey
""")
def signal_argmax(spark, sf_dir):
    best = lambda c: F.min_by("l_linenumber", F.struct(-F.col(c), "l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best("l_quantity").alias("by_quantity"), best("l_extendedprice").alias("by_price"), best("l_discount").alias("by_discount"))


OBSERVED = "SELECT event_type AS alias, user_id % 5 AS concept, round(least(0.99, value / 100), 6) AS confidence, 1 AS frequency, ts AS used_at FROM events"


def observed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("alias"), (F.col("user_id") % 5).alias("concept"), F.round(F.least(F.lit(0.99), F.col("value") / 100), 6).alias("confidence"), F.lit(1).alias("frequency"), F.col("ts").alias("used_at"))


@query(f"SELECT alias, concept, max(confidence) AS confidence, sum(frequency)::BIGINT AS frequency, epoch_us(max(used_at)) AS used_at FROM ({OBSERVED}) GROUP BY alias, concept")
def alias_upsert(spark, sf_dir):
    return relational.merge_aliases(observed(spark, sf_dir)).withColumn("used_at", F.unix_micros(F.col("used_at").cast("timestamp")))


@query("""
WITH a AS (SELECT o_orderpriority AS alias, o_custkey % 50 AS concept, max(round(o_totalprice / 500000, 6)) AS confidence FROM orders GROUP BY ALL)
SELECT alias, concept, confidence FROM a WHERE confidence >= 0.95 AND alias IN (SELECT alias FROM a GROUP BY alias HAVING count(DISTINCT concept) = 50) ORDER BY 1
""")
def alias_conflicts(spark, sf_dir):
    """Sure aliases whose spelling stands for every concept: the ones that the learning gate keeps out."""
    o = table(spark, sf_dir, "orders")
    a = o.groupBy(F.col("o_orderpriority").alias("alias"), (F.col("o_custkey") % 50).alias("concept")).agg(F.max(F.round(F.col("o_totalprice") / 500000, 6)).alias("confidence"))
    wide = a.groupBy("alias").agg(F.countDistinct("concept").alias("n")).where("n = 50").select("alias")
    return a.where("confidence >= 0.95").join(wide, "alias", "left_semi")


@query("""
WITH a AS (SELECT c_name AS alias, o_custkey % 3 AS concept, max(round(o_totalprice / 500000, 6)) AS confidence FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT alias, concept, confidence FROM a WHERE confidence >= 0.95 AND alias IN (SELECT alias FROM a GROUP BY alias HAVING count(DISTINCT concept) = 1)
""")
def alias_learning_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = o.groupBy(F.col("c_name").alias("alias"), (F.col("o_custkey") % 3).alias("concept")).agg(F.max(F.round(F.col("o_totalprice") / 500000, 6)).alias("confidence"))
    return relational.learnable(a)


@query("""
WITH a AS (SELECT p_name AS alias, p_partkey AS concept, p_partkey % 7 = 0 AS validated, p_size::BIGINT AS frequency, round(p_retailprice / 2000, 6) AS confidence FROM part),
m AS (SELECT DISTINCT upper(p_name) AS mention FROM part)
SELECT mention, concept, validated, frequency, confidence FROM m JOIN a ON lower(m.mention) = lower(a.alias) WHERE validated OR frequency >= 3 QUALIFY row_number() OVER (PARTITION BY mention ORDER BY validated DESC, confidence DESC, concept) = 1
""")
def learned_alias_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("concept"), (F.col("p_partkey") % 7 == 0).alias("validated"), F.col("p_size").cast("long").alias("frequency"), F.round(F.col("p_retailprice") / 2000, 6).alias("confidence"))
    m = p.select(F.upper("p_name").alias("mention")).distinct()
    return relational.alias_lookup(m, a).drop("alias")


@query("""
WITH old AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY ALL), new AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.user_id = n.user_id AND o.event_type = n.event_type)
""")
def insert_ignore(spark, sf_dir):
    """Odd events are offered to the state of even ones; all events take part."""
    e = table(spark, sf_dir, "events")
    half = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return relational.insert_new(half(0), half(1), ["user_id", "event_type"])


@query("""
WITH old AS (SELECT user_id, min(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id), new AS (SELECT user_id, max(value) AS value FROM events WHERE event_type <> 'view' GROUP BY user_id)
SELECT user_id, CASE WHEN new.user_id IS NOT NULL THEN new.value ELSE old.value END AS value FROM old FULL JOIN new USING (user_id)
""")
def upsert_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("value").alias("value"))
    return relational.upsert(old, e.where("event_type <> 'view'").groupBy("user_id").agg(F.max("value").alias("value")), ["user_id"])


@query("""
WITH e AS (SELECT DISTINCT n_regionkey AS src, n_nationkey AS dst FROM nation), h AS (SELECT r_regionkey AS src, dst, s_name AS name FROM region JOIN e ON r_regionkey = src JOIN supplier ON s_nationkey = dst)
SELECT DISTINCT src, dst, name, 0.15::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst, name) AS r FROM (SELECT DISTINCT * FROM h)) WHERE r <= 20
""")
def neighbour_expand(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst")).distinct()
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("node"), F.col("s_name").alias("name"))
    hop = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("src")).join(edges, "src").join(nodes, F.col("dst") == F.col("node")).select("src", "dst", "name").distinct()
    return relational.top_per_key(hop, ["src"], 20, F.asc("dst"), F.asc("name")).drop("rank").withColumn("score", F.lit(0.15))


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(o_orderpriority, ' | ' ORDER BY k) AS o_orderpriority FROM f GROUP BY o_custkey
""")
def group_concat_merge(spark, sf_dir):
    return relational.concat_distinct(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", F.col("o_orderkey"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 <> 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders)
SELECT o_custkey, arg_min(status, o_orderkey) FILTER (WHERE trim(status) <> '') AS status, arg_min(priority, o_orderkey) FILTER (WHERE trim(priority) <> '') AS priority FROM r GROUP BY o_custkey
""")
def first_non_empty_merge(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("priority"))
    return relational.first_filled_merge(r, "o_custkey", ["status", "priority"], "o_orderkey")


@query("SELECT o_custkey, arg_min(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) AS o_orderstatus FROM orders GROUP BY o_custkey")
def status_rollup(spark, sf_dir):
    return relational.best_status(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "P", "O"])


@query("SELECT l_partkey, l_suppkey, round(sum(q), 6) AS quantity FROM (SELECT l_partkey, l_suppkey, l_quantity AS q FROM lineitem UNION ALL SELECT p_partkey, 0, p_size FROM part) GROUP BY ALL")
def quantity_increment(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").alias("quantity"))
    more = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"), F.col("p_size").cast("double").alias("quantity"))
    return relational.add_quantities(lines, more, ["l_partkey", "l_suppkey"]).withColumn("quantity", F.round("quantity", 6))


@query("SELECT p_partkey, p_name, coalesce(b, p_brand) AS p_brand, p_size + 1 AS p_size FROM part JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'New' END AS b FROM part) ON k = p_partkey")
def batch_copy(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    changes = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "New").alias("p_brand"), (F.col("p_size") + 1).alias("p_size"))
    return relational.copy_with(p, changes, "p_partkey", ["p_brand", "p_size"])


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 5")
def top_groups(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c_nationkey").limit(5)


@query("""
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT event_type) AS kinds, round(count(*) FILTER (WHERE event_type = 'purchase') / count(*), 9) AS ratio, median(value) AS middle FROM events GROUP BY user_id
""")
def conditional_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("event_type").alias("kinds"), F.round(F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1)), 9).alias("ratio"), F.median("value").alias("middle"))


@query("""
WITH m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, event_type = 'purchase' AS hit FROM events),
f AS (SELECT *, min(CASE WHEN hit THEN r END) OVER (PARTITION BY user_id) AS h FROM m)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(r = h, false) DESC, r)::INTEGER AS new_rank FROM f
""")
def move_to_front(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")))
    return relational.moved_to_front(e, "user_id", F.col("event_type") == "purchase", "r").select("user_id", "event_id", "new_rank")


@query("""
SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'E' || (turn + 100) ELSE 'E' || row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) END AS ordinal FROM conversations
""")
def ordinal_assignment(spark, sf_dir):
    keep = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("E"), (F.col("turn") + 100).cast("string")))
    return relational.ordinal_ids(table(spark, sf_dir, "conversations"), "conv_id", "E", keep, F.length("text"), F.col("turn")).select("conv_id", "turn", "ordinal")


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'SMALL' THEN 3 ELSE 4 END AS place FROM part")
def custom_order(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", relational.in_order(p, "p_type", ["PROMO", "LARGE", "SMALL"]).cast("int").alias("place"))


@query("""
SELECT 'missing label' AS side, doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT 'missing document', doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)
""")
def set_difference_report(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(l, "doc_id", "left_anti").select(F.lit("missing label").alias("side"), "doc_id").unionByName(l.join(d, "doc_id", "left_anti").select(F.lit("missing document").alias("side"), "doc_id"))


SPANS = "SELECT user_id, event_id AS id, (epoch_us(ts) // 1000000) AS start, (epoch_us(ts) // 1000000) + 1 + (value * 3)::BIGINT AS stop FROM events"


@query(f"WITH s AS ({SPANS}) SELECT a.user_id, a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.user_id = b.user_id AND a.id < b.id AND a.start < b.stop AND b.start < a.stop")
def span_overlap(spark, sf_dir):
    """Overlapping ranges of one user, by bins."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("start"), F.round(F.col("value") * 3).cast("long").alias("w"))
    s = e.select("user_id", "id", "start", (F.col("start") + 1 + F.col("w")).alias("stop"))
    return relational.interval_join(s, s, "user_id", 600).where("id_a < id_b")


@query("SELECT a.user_id, a.event_type, a.event_id AS id_a, b.event_id AS id_b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND b.event_id - a.event_id <= 80")
def near_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("id"), F.col("event_id").alias("at"))
    return relational.near_pairs(e, ["user_id", "event_type"], "at", 80)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_totals(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 8 ELSE c_nationkey END AS location, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'REJECTED' ELSE 'ACTIVE' END AS status, c_acctbal FROM customer)
SELECT c_custkey, location FROM c WHERE (status IS NULL OR status <> 'REJECTED') AND (location = 8 OR c_acctbal > 5000 OR c_custkey % 3 = 0)
""")
def tenant_and_recall_filter(spark, sf_dir):
    """Tenant mapping by a small table, soft delete safe for nulls, and a disjunction of signals."""
    mapping = spark.createDataFrame([(1, 8)], "clinic int, location int")
    seg = F.col("c_mktsegment")
    c = table(spark, sf_dir, "customer").join(F.broadcast(mapping), F.col("c_nationkey") == F.col("clinic"), "left").withColumn("location", F.coalesce("location", "c_nationkey"))
    status = F.when(seg == "BUILDING", F.lit(None)).when(seg == "MACHINERY", "REJECTED").otherwise("ACTIVE")
    signals = (F.col("location") == 8) | (F.col("c_acctbal") > 5000) | (F.col("c_custkey") % 3 == 0)
    return c.where((status.isNull() | (status != "REJECTED")) & signals).select("c_custkey", "location")


# --- linkage ------------------------------------------------------------------------------

ATOMS = """SELECT l_orderkey AS visit, l_orderkey * 10 + l_linenumber AS atom_id, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey % 3 END AS service_id, CASE WHEN l_linenumber % 3 = 1 THEN l_partkey % 4 END AS stock_id,
 CASE WHEN l_linenumber % 3 = 2 THEN l_returnflag END AS dedup_key, CASE l_linestatus WHEN 'O' THEN 'Plan' ELSE 'Objective' END AS section, 'c' || l_partkey AS concept, l_linestatus AS kind, l_returnflag || l_linestatus AS source FROM lineitem"""


def atoms(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("visit"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("atom_id"), F.when(n == 0, F.col("l_suppkey") % 3).alias("service_id"), F.when(n == 1, F.col("l_partkey") % 4).alias("stock_id"),
        F.when(n == 2, F.col("l_returnflag")).alias("dedup_key"), F.when(F.col("l_linestatus") == "O", "Plan").otherwise("Objective").alias("section"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("concept"),
        F.col("l_linestatus").alias("kind"), F.concat("l_returnflag", "l_linestatus").alias("source"),
    )


@query(f"""
WITH a AS ({ATOMS}), g AS (SELECT *, CASE WHEN service_id IS NOT NULL THEN 'svc:' || service_id WHEN stock_id IS NOT NULL THEN 'stk:' || stock_id WHEN dedup_key IS NOT NULL THEN 'key:' || lower(kind) || ':' || lower(dedup_key) ELSE 'own:' || atom_id END AS group_key FROM a),
p AS (SELECT *, row_number() OVER (PARTITION BY visit, group_key ORDER BY section <> 'Plan', service_id IS NULL AND stock_id IS NULL, atom_id, source) AS place FROM g),
b AS (SELECT visit, group_key, max(atom_id) FILTER (WHERE place = 1) AS atom_id, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT visit, group_key, source, min(CASE WHEN place = 1 THEN -1 ELSE atom_id END) AS k FROM p GROUP BY ALL), j AS (SELECT visit, group_key, string_agg(source, ' | ' ORDER BY k, source) AS sources FROM s GROUP BY ALL)
SELECT b.visit, b.group_key, b.atom_id, j.sources, b.n FROM b JOIN j USING (visit, group_key)
""")
def atom_dedup(spark, sf_dir):
    return linkage.atom_dedup(atoms(spark, sf_dir).repartition("visit"), "visit").select("visit", "group_key", "atom_id", "sources", "n")


LIKE_ATOMS = """SELECT DISTINCT l_orderkey // 50 AS visit, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus) AS atom_id, CASE WHEN l_linenumber = 3 THEN l_suppkey % 3 END AS service_id, CASE WHEN l_linenumber = 1 THEN l_partkey % 4 END AS stock_id,
 CASE l_linenumber WHEN 2 THEN 'Key (' || l_returnflag || ')' WHEN 4 THEN '?' END AS dedup_key, CASE l_linestatus WHEN 'O' THEN 'Plan' ELSE 'Elsewhere' END AS section, CASE WHEN l_partkey % 19 = 0 THEN '' WHEN l_orderkey % 2 = 0 THEN p_name || ', ' || p_brand ELSE upper(p_name) || ' ' || replace(p_brand, 'r', '') END AS concept,
 CASE l_linenumber % 4 WHEN 0 THEN 'Drug' WHEN 1 THEN 'vaccine' WHEN 2 THEN 'labtest' ELSE 'Odd' END AS kind, CASE WHEN l_linenumber <> 5 THEN ' ' || l_returnflag || l_linestatus END AS source FROM lineitem JOIN part ON l_partkey = p_partkey"""
ATOM_TEXT = lambda c: f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def like_atoms(spark, sf_dir):
    """Lines are made distinct where they meet their parts, so that one shuffle does for both, and once more by visit, for parts that make them alike."""
    n, p, even = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_orderkey") % 2 == 0
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", F.when(n == 3, F.col("l_suppkey") % 3).alias("service_id")).repartition("l_partkey").distinct()
    lines = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), p == F.col("p_partkey"))
    concept = F.when(p % 19 == 0, "").when(even, F.concat_ws(", ", "p_name", "p_brand")).otherwise(F.concat(F.upper("p_name"), F.lit(" "), F.replace("p_brand", F.lit("r"), F.lit(""))))
    return lines.select(
        F.floor(F.col("l_orderkey") / 50).alias("visit"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").alias("atom_id"), "service_id", F.when(n == 1, p % 4).alias("stock_id"),
        F.when(n == 2, F.concat(F.lit("Key ("), "l_returnflag", F.lit(")"))).when(n == 4, "?").alias("dedup_key"), F.when(F.col("l_linestatus") == "O", "Plan").otherwise("Elsewhere").alias("section"), concept.alias("concept"),
        F.when(n % 4 == 0, "Drug").when(n % 4 == 1, "vaccine").when(n % 4 == 2, "labtest").otherwise("Odd").alias("kind"), F.when(n != 5, F.concat(F.lit(" "), "l_returnflag", "l_linestatus")).alias("source"),
    ).repartition("visit").distinct()


@query(f"""
WITH a AS (SELECT *, CASE lower(kind) WHEN 'drug' THEN 'PHARMACOLOGICAL' WHEN 'vaccine' THEN 'PHARMACOLOGICAL' WHEN 'labtest' THEN 'DIAGNOSTIC' ELSE lower(kind) END AS meta, {ATOM_TEXT("concept")} AS t, {ATOM_TEXT("dedup_key")} AS k FROM ({LIKE_ATOMS})),
keyed AS (SELECT *, CASE WHEN service_id IS NOT NULL THEN 'svc:' || service_id WHEN stock_id IS NOT NULL THEN 'stk:' || stock_id WHEN k <> '' THEN 'key:' || meta || ':' || k END AS sure FROM a),
names AS (SELECT visit, meta, t, min(atom_id) AS first FROM keyed WHERE sure IS NULL AND t <> '' GROUP BY ALL),
lists AS (SELECT visit, meta, list([t] ORDER BY first) AS names FROM names GROUP BY ALL),
heads AS (SELECT visit, meta, list_reduce(names, lambda acc, x: CASE WHEN len(list_filter(acc, lambda h: 1 - levenshtein(h, x[1]) / greatest(length(h), length(x[1]))::DOUBLE >= 0.9)) > 0 THEN acc ELSE list_concat(acc, x) END) AS heads FROM lists),
g AS (SELECT keyed.*, CASE WHEN sure IS NOT NULL THEN sure WHEN t = '' THEN 'own:' || atom_id ELSE 'like:' || meta || ':' || list_filter(heads, lambda h: 1 - levenshtein(h, t) / greatest(length(h), length(t))::DOUBLE >= 0.9)[1] END AS group_key, trim(coalesce(source, '')) AS src
  FROM keyed LEFT JOIN heads USING (visit, meta)),
r AS (SELECT *, row_number() OVER (PARTITION BY visit, group_key ORDER BY section <> 'Plan', service_id IS NULL AND stock_id IS NULL, atom_id) AS place FROM g),
s AS (SELECT visit, group_key, src, min(CASE WHEN place = 1 THEN '' ELSE atom_id END) AS since FROM r WHERE src <> '' GROUP BY ALL),
j AS (SELECT visit, group_key, string_agg(src, ' | ' ORDER BY since) AS sources FROM s GROUP BY ALL)
SELECT visit, group_key, arg_min(atom_id, place) AS atom_id, coalesce(coalesce(max(service_id) FILTER (WHERE place = 1), arg_min(service_id, atom_id) FILTER (WHERE service_id IS NOT NULL)), -1) AS service_id,
 coalesce(coalesce(max(stock_id) FILTER (WHERE place = 1), arg_min(stock_id, atom_id) FILTER (WHERE stock_id IS NOT NULL)), -1) AS stock_id, coalesce(any_value(sources), '') AS sources, count(*) AS n
FROM r LEFT JOIN j USING (visit, group_key) GROUP BY visit, group_key
""")
def atom_dedup_similar(spark, sf_dir):
    """Atoms of equal ids, of equal keys and of like concepts, in visits of some hundred lines."""
    kept = linkage.atom_dedup(like_atoms(spark, sf_dir), "visit")
    return kept.select("visit", "group_key", "atom_id", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("service_id", "stock_id")), "sources", "n")


@query()
def entity_dedup(spark, sf_dir):
    """Words of a document's lines as mentions; greedy merging depends on order, so SQL has no short form."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t"))
    words = lines.select("doc_id", F.posexplode(F.filter(F.split("t", " "), lambda w: F.length(w) >= 9)).alias("at", "name"), "line")
    start = (F.col("line") * 40 + F.col("at")).cast("long")
    none = F.lit(None).cast("long")
    attributes = F.when(F.col("at") % 3 == 0, F.create_map(F.lit("anatomy"), F.substring("name", 1, 1))).otherwise(F.create_map(F.lit("note"), F.col("name")))
    rows = words.select(
        "doc_id", F.when(F.col("at") % 2 == 0, "Symptom").otherwise("Procedure").alias("kind"), "name", start.alias("start"), (start + F.length("name")).alias("stop"), none.alias("concept_id"),
        F.when(F.col("at") % 11 == 0, F.length("name").cast("long")).alias("service_id"), none.alias("stock_id"), F.when(F.col("at") % 5 == 0, "ordered").otherwise("").alias("intent"), F.lit(None).cast("string").alias("supporting"), attributes.alias("attributes"),
    )
    kept = entity_fold.entity_dedup(rows, "doc_id")
    return kept.select("doc_id", "kind", "name", "start", "mentions", F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("attributes"))


PLAIN = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"
TELLING = lambda c, few: f"list_filter(string_split({c}, ' '), lambda w: length(w) >= {few} AND NOT list_contains({linkage.UNTELLING}, w))"


@query(f"""
WITH a AS (SELECT o_custkey AS visit, o_orderkey AS atom_id, CASE WHEN o_orderkey % 3 = 0 THEN substr(p_name, 1, 4) || 'x' || substr(p_name, 5) || ' tablet' WHEN o_orderkey % 3 = 1 THEN p_name ELSE substr(p_name, 2, 5) END AS n, CASE WHEN o_orderstatus = 'F' THEN 'Medication' ELSE 'Procedure' END AS kind,
  CASE WHEN o_orderkey % 11 = 0 THEN 'E' || o_orderkey END AS ref, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 7 END AS local FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)),
m AS (SELECT DISTINCT l_orderkey % (SELECT count(*) FROM customer) AS visit, 'E' || l_orderkey AS entity_id, l_linenumber AS pos, lower(p_name || CASE WHEN l_linenumber % 3 = 0 THEN ' tablet' ELSE '' END) AS n, lower(p_brand) AS d, CASE WHEN l_linestatus = 'F' THEN 'Drug' ELSE 'Diagnostic' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 7 END AS local FROM lineitem JOIN part ON p_partkey = l_partkey),
j AS (SELECT a.atom_id, m.entity_id, m.pos, a.ref, a.local AS al, m.local AS ml, lower(a.n) AS n, m.n AS mn, m.d AS md, a.kind = m.kind AS same, (a.kind, m.kind) IN (('Medication', 'Drug'), ('Procedure', 'Diagnostic')) AS fit, {PLAIN("a.n")} AS p, {PLAIN("m.n")} AS mp FROM a JOIN m ON a.visit = m.visit),
k AS (SELECT *, CASE WHEN ml IS NOT NULL AND fit AND regexp_matches(n, '{"|".join(linkage.FORMS)}') AND regexp_matches(mn, '{"|".join(linkage.FORMS)}') THEN 1 - levenshtein(p, mp) / greatest(length(p), length(mp)) END AS ratio FROM j),
r AS (SELECT *, row_number() OVER w AS place, coalesce(lead(ratio) OVER w, 0) AS nxt FROM k WINDOW w AS (PARTITION BY atom_id ORDER BY ratio DESC NULLS LAST, pos, entity_id)),
c AS (SELECT atom_id, entity_id, pos, CASE WHEN ref = entity_id THEN 0 WHEN al = ml THEN 1 WHEN (n = mn OR n = md) AND same THEN 2 WHEN n = mn AND fit AND ml IS NOT NULL THEN 3 WHEN (n = mn OR n = md) AND fit THEN 4
 WHEN fit AND (contains(p, mp) OR contains(mp, p) OR len(list_intersect(list_distinct(string_split(p, ' ')), list_distinct(string_split(mp, ' ')))) >= 2) THEN 5
 WHEN fit AND ml IS NOT NULL AND len(list_intersect(CASE WHEN len({TELLING("p", 4)}) > 0 THEN {TELLING("p", 4)} ELSE {TELLING("p", 3)} END, {TELLING("mp", 3)})) > 0 THEN 6
 WHEN place = 1 AND ratio >= 0.72 AND ratio - nxt >= 0.08 THEN 8 END AS strategy FROM r)
SELECT atom_id, entity_id, strategy FROM c WHERE strategy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY atom_id ORDER BY strategy, pos, entity_id) = 1
""")
def link_cascade(spark, sf_dir):
    """Atoms by id, local id, equal, contained, shared and alike names; names are misspelt, cut and given a form by turns."""
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    n_part, n_cust = part.count(), table(spark, sf_dir, "customer").count()
    k = F.col("o_orderkey")
    concept = F.when(k % 3 == 0, F.concat(F.substring("p_name", 1, 4), F.lit("x"), F.expr("substring(p_name, 5)"), F.lit(" tablet"))).when(k % 3 == 1, F.col("p_name")).otherwise(F.substring("p_name", 2, 5))
    a = orders.join(part, F.col("p_partkey") == k % n_part).select(F.col("o_custkey").alias("visit"), k.alias("atom_id"), concept.alias("concept"), F.when(F.col("o_orderstatus") == "F", "Medication").otherwise("Procedure").alias("kind"), F.when(k % 11 == 0, F.concat(F.lit("E"), k.cast("string"))).alias("ref_id"), F.when(k % 13 == 0, k % 7).alias("local_id"))
    line = F.col("l_linenumber")
    name = F.concat("p_name", F.when(line % 3 == 0, " tablet").otherwise(""))
    m = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select((F.col("l_orderkey") % n_cust).alias("visit"), F.concat(F.lit("E"), F.col("l_orderkey").cast("string")).alias("entity_id"), line.alias("pos"), name.alias("name"), F.col("p_brand").alias("display"), F.when(F.col("l_linestatus") == "F", "Drug").otherwise("Diagnostic").alias("kind"), F.when(line % 2 == 0, F.col("l_partkey") % 7).alias("local_id"))
    return linkage.link_cascade(a, m)


@query("""
WITH i AS (SELECT conv_id AS visit, 'issue ' || turn || ' ' || role AS issue, list_distinct(list_filter(string_split_regex(lower('issue ' || turn || ' ' || role), '[^a-z0-9]+'), lambda w: length(w) >= 4 AND w <> 'issue')) AS t FROM conversations),
m AS (SELECT conv_id AS visit, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 4 AND w <> 'issue')) AS t FROM conversations)
SELECT DISTINCT visit, issue FROM i WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.visit = i.visit AND (len(list_intersect(i.t, m.t)) >= 2 OR (len(i.t) = 1 AND len(list_intersect(i.t, m.t)) = 1)))
""")
def issue_coverage(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    issues = c.select(F.col("conv_id").alias("visit"), F.concat(F.lit("issue "), F.col("turn").cast("string"), F.lit(" "), "role").alias("issue")).distinct()
    return linkage.uncovered(issues, c.select(F.col("conv_id").alias("visit"), F.col("text").alias("medicine")), ["issue"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE c_mktsegment END AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def auto_fill(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(" ").alias("label"))
    return linkage.filled(items, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("label")), "k", ["label"]).select("o_orderkey", "label")


@query("SELECT l_orderkey, l_partkey AS id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_discount DESC, l_partkey) = 1")
def best_suggestion(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id"), (F.col("l_returnflag") == "R").alias("is_primary"), F.col("l_discount").alias("score"))
    return linkage.best_suggestion(rows, "l_orderkey").select("l_orderkey", "id")


# --- routing ------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN 'Symptom' WHEN 'click' THEN 'Medication' WHEN 'signup' THEN 'VitalSign' WHEN 'purchase' THEN 'Procedure' ELSE 'Other' END AS kind,
 CASE event_type WHEN 'view' THEN 'skip_non_billable' WHEN 'click' THEN 'dual_sync' WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'dual_sync' ELSE 'skip_vitals' END WHEN 'purchase' THEN 'dual_sync' ELSE 'skip_other' END AS route,
 CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 1 WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 2 ELSE 3 END WHEN 'purchase' THEN 1 ELSE 2 END AS bucket FROM events
""")
def entity_router(spark, sf_dir):
    """Kinds in several spellings; a vital sign that names a dose is a product."""
    e = table(spark, sf_dir, "events")
    spelled = F.when(F.col("event_type") == "view", " Finding").when(F.col("event_type") == "click", "Drug/Substance").when(F.col("event_type") == "signup", "vital-sign").when(F.col("event_type") == "purchase", "special treatment plan").otherwise("")
    span = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("given "), F.col("user_id").cast("string"), F.lit(" mg"))).otherwise("seen")
    k = routing.canonical_kind(spelled)
    rows = e.select("event_id", k.alias("kind"), span.alias("span"), F.array().cast("array<string>").alias("keys"))
    rows = rows.withColumn("route", routing.route(F.col("kind"), F.col("span"), F.col("keys")))
    return rows.select("event_id", "kind", "route", routing.bucket(F.col("kind"), F.col("route")).alias("bucket"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT') THEN 'clinical_follow_ups' WHEN o_orderpriority = '2-HIGH' THEN 'patient_reminders' WHEN o_orderstatus = 'F' THEN 'pharmacy_administered' WHEN o_orderstatus = 'O' THEN 'diagnostics_labs_imaging' ELSE 'clinical_assessment' END AS head,
 CASE WHEN o_orderkey % 5 = 0 THEN 'ACTION_REQUIRED' WHEN o_orderkey % 7 = 0 THEN 'DRAFTED' WHEN o_totalprice / 500000 >= 0.9 THEN 'CONFIRMED' WHEN o_totalprice / 500000 >= 0.6 THEN 'DRAFTED' ELSE 'ACTION_REQUIRED' END AS status FROM orders
""")
def dashboard_route(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "Drug").when(F.col("o_orderstatus") == "O", "LabTest").otherwise("Condition")
    intent = F.when(F.col("o_orderpriority") == "1-URGENT", "Scheduled").when(F.col("o_orderpriority") == "2-HIGH", "Recommended").otherwise("Administered")
    score = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 500000)
    return o.select("o_orderkey", routing.dashboard_head(kind, intent).alias("head"), routing.status_tier(score, F.lit(1), F.col("o_orderkey") % 5 != 0).alias("status"))


@query("""
SELECT module, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'reminders' WHEN o_orderstatus = 'O' THEN 'diagnostics' WHEN o_orderpriority = '2-HIGH' THEN 'reminders' WHEN o_orderpriority = '3-MEDIUM' THEN 'clinical_history' WHEN o_orderkey % 4 = 0 THEN 'unlinked' WHEN o_orderstatus = 'P' THEN 'services' WHEN o_custkey % 2 = 0 THEN 'prescribed' ELSE 'administered' END AS module FROM orders) GROUP BY module
""")
def module_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "LabTest").when(F.col("o_orderstatus") == "P", "Procedure").otherwise("Medication")
    intent = F.when(F.col("o_orderpriority") == "1-URGENT", "Future")
    assertion = F.when(F.col("o_orderpriority") == "2-HIGH", "HYPO").when(F.col("o_orderpriority") == "3-MEDIUM", "HIST").otherwise("CONF")
    m = routing.module(kind, intent, assertion, F.col("o_orderkey") % 4 != 0, F.col("o_custkey") % 2 == 0)
    return o.select(m.alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Morning' WHEN p_partkey % 4 = 1 THEN 'Custom' WHEN p_partkey % 4 = 2 THEN 'Night' ELSE 'Custom' END AS frequency, CASE WHEN p_size % 3 = 0 THEN 'After meal' WHEN p_size % 3 = 1 THEN 'With Meal' ELSE p_name END AS instruction,
 CASE WHEN p_type = 'PROMO' THEN 'billable,presenting_complaint' WHEN p_type = 'LARGE' THEN 'procedure' ELSE '' END AS roles FROM part
""")
def prescription_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, "every MORNING").when(k == 1, "morning and night").when(k == 2, "each evening").otherwise("")
    meal = F.when(F.col("p_size") % 3 == 0, "give after food").when(F.col("p_size") % 3 == 1, "with meals").otherwise(F.col("p_name"))
    prob = lambda kind, v: F.when(F.col("p_type") == kind, v).otherwise(0.0)
    roles = F.array_join(F.array_sort(routing.roles(prob("LARGE", 0.5), prob("PROMO", 0.9), prob("PROMO", 0.6))), ",")
    return p.select("p_partkey", text.frequency(said).alias("frequency"), text.meal_instruction(meal).alias("instruction"), roles.alias("roles"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('R') THEN 'judge' WHEN l_discount * 10 >= 0.55 THEN 'local' WHEN l_tax * 10 >= 0.55 AND l_linestatus <> 'F' THEN 'global' ELSE 'none' END AS choice FROM lineitem
""")
def tiered_choice(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "Procedure").when(F.col("l_linestatus") == "F", "ParasiteControl").otherwise("Preventive")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ranking.tiered_choice(kind, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("choice"))


# --- windows and streams in batch form ------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return streams.windowed(table(spark, sf_dir, "events"), "1 hour").select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH s AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL
""")
def sliding_windows(spark, sf_dir):
    return streams.windowed(table(spark, sf_dir, "events"), "1 hour", "30 minutes").select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_windows(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "30 minutes").select("user_id", F.col("w.start").alias("start"), "n")


@query("""
WITH m AS (SELECT user_id AS session, event_id % 10 AS segment, event_id AS arrival, event_type AS text FROM events), l AS (SELECT session, segment, arg_max(text, arrival) AS text FROM m GROUP BY ALL)
SELECT session, string_agg(text, ' ' ORDER BY segment) AS text FROM l GROUP BY session
""")
def segment_last_write_wins(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 10).alias("segment"), F.col("event_id").alias("arrival"), F.col("event_type").alias("text"))
    return streams.segments_batch(m)
