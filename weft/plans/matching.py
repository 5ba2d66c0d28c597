"""Queries that match names, atoms and manifests, and what is offered where nothing matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attributes, automaton, decision, safety, suggestions
from .records import pick, spark_pick
from .registry import query, table

SPACED = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"


@query(f"""
WITH atoms AS (SELECT p_partkey % 40 AS visit, p_partkey AS atom, CASE WHEN p_partkey % 9 = 0 THEN p_name || ' ' || p_brand ELSE p_name END AS name FROM part),
known AS (SELECT visit, {SPACED("name")} AS key, arg_max(atom, atom) AS atom, min(atom) AS pos FROM atoms GROUP BY 1, 2),
items AS (SELECT DISTINCT l_orderkey % 40 AS visit, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_returnflag) AS item,
  [CASE WHEN l_linenumber % 2 = 0 THEN NULL WHEN l_linenumber % 5 = 0 THEN ' ' ELSE 'zq' || l_returnflag END,
   CASE l_orderkey % 4 WHEN 0 THEN upper(replace(p_name, ' ', '  ')) WHEN 1 THEN 'give ' || p_name || ' daily' WHEN 2 THEN substr(p_name, 3, 5) ELSE reverse(p_name) END,
   CASE WHEN l_linenumber = 3 THEN p_brand WHEN l_linenumber = 4 THEN p_name END] AS names
  FROM lineitem JOIN part ON l_partkey = p_partkey),
named AS (SELECT visit, item, u.rank, {SPACED("u.name")} AS key FROM items, (SELECT unnest(range(1, 4)) AS rank, unnest(names) AS name) u),
pairs AS (SELECT DISTINCT visit, key FROM named WHERE key <> ''),
inside AS (SELECT p.visit, p.key, min(k.pos) AS pos FROM pairs p JOIN known k ON p.visit = k.visit AND (contains(p.key, k.key) OR contains(k.key, p.key)) GROUP BY ALL),
found AS (
  SELECT n.visit, n.item, 0 AS step, n.rank, k.atom, 'equal' AS how FROM named n JOIN known k ON n.visit = k.visit AND n.key = k.key
  UNION ALL SELECT n.visit, n.item, 1, n.rank, k.atom, 'inside' FROM named n JOIN inside i ON n.visit = i.visit AND n.key = i.key JOIN known k ON k.visit = i.visit AND k.pos = i.pos),
best AS (SELECT visit, item, atom, how FROM found QUALIFY row_number() OVER (PARTITION BY visit, item ORDER BY step, rank) = 1)
SELECT i.visit, i.item, coalesce(b.atom, -1) AS atom, coalesce(b.how, '-') AS how FROM items i LEFT JOIN best b ON b.visit = i.visit AND b.item = i.item
""")
def atom_match(spark, sf_dir):
    """Line items with up to three names each against the parts of their visit: equal, longer, shorter and strange names."""
    part, k = table(spark, sf_dir, "part"), F.col("l_linenumber")
    atoms = part.select((F.col("p_partkey") % 40).alias("visit"), F.col("p_partkey").alias("atom"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 9 == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.col("p_name")).alias("name"))
    first = F.when(k % 2 == 0, None).when(k % 5 == 0, " ").otherwise(F.concat(F.lit("zq"), "l_returnflag"))
    turn = F.col("l_orderkey") % 4
    second = F.when(turn == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("  ")))).when(turn == 1, F.concat(F.lit("give "), "p_name", F.lit(" daily"))).when(turn == 2, F.substring("p_name", 3, 5)).otherwise(F.reverse("p_name"))
    third = F.when(k == 3, F.col("p_brand")).when(k == 4, F.col("p_name"))
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    items = lines.select((F.col("l_orderkey") % 40).alias("visit"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").alias("item"), F.array(first, second, third).alias("names")).distinct()
    return automaton.matched_atoms(items, atoms).select("visit", "item", F.coalesce("atom", F.lit(-1)).alias("atom"), F.coalesce("how", F.lit("-")).alias("how"))


@query("""
WITH m AS (SELECT o_orderkey AS mention, o_orderpriority AS span, CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderpriority) ELSE o_orderstatus || o_orderkey % 5 END AS normalized, CASE o_orderkey % 4 WHEN 0 THEN 'Procedure' WHEN 1 THEN 'Surgery' ELSE 'Medication' END AS kind, [o_custkey % 90, o_custkey % 40, o_custkey % 7] AS domains FROM orders),
l AS (SELECT DISTINCT CASE WHEN l_orderkey % 5 <> 2 THEN l_orderkey ELSE -1 END AS mention, p_name AS name, l_discount * 10 + l_linenumber / 100.0 AS score, l_partkey AS stock_id, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS service_id FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT DISTINCT CASE WHEN l_orderkey % 7 <> 3 THEN l_orderkey - 1 ELSE -1 END AS mention, CASE WHEN l_linenumber = 1 THEN upper(p_name) ELSE p_name END AS name, l_tax * 10 + l_linenumber / 1000.0 AS score, l_partkey AS concept_id FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT mention, 0 AS side, row_number() OVER (PARTITION BY mention ORDER BY score DESC, name, stock_id, service_id NULLS LAST) AS rank, name, score, stock_id, service_id, NULL AS concept_id FROM l
  UNION ALL SELECT mention, 1, row_number() OVER (PARTITION BY mention ORDER BY score DESC, name, concept_id), name, score, NULL, NULL, concept_id FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY mention, lower(name) ORDER BY side, rank) AS seen FROM a WHERE CASE side WHEN 0 THEN rank <= 5 ELSE rank <= 15 END),
s AS (SELECT mention, string_agg(concat_ws('/', name, round(score, 4)::DECIMAL(10,4), coalesce(service_id, -1), coalesce(stock_id, -1), coalesce(concept_id, -1)), ';' ORDER BY side, rank) AS listed, any_value(name || stock_id) FILTER (WHERE side = 0 AND rank = 1) AS first FROM k WHERE side = 0 OR seen = 1 GROUP BY mention),
v AS (SELECT s_suppkey % 35 AS domain, s_suppkey AS service_id, s_name AS service, s_acctbal AS price, CASE WHEN s_suppkey % 3 = 0 THEN 'Surgery' ELSE 'Tele-Consultation' END AS category FROM supplier),
b AS (SELECT domain, service_id, service FROM v WHERE contains(lower(category), 'consult') QUALIFY row_number() OVER (PARTITION BY domain ORDER BY price DESC, service_id) = 1),
c AS (SELECT mention, domain, service_id, service FROM (SELECT mention, unnest(domains) AS domain, generate_subscripts(domains, 1) AS place FROM m WHERE kind <> 'Medication') JOIN b USING (domain) QUALIFY row_number() OVER (PARTITION BY mention ORDER BY place) = 1)
SELECT mention, coalesce(service, CASE WHEN lower(normalized) <> lower(span) THEN normalized ELSE span END) AS display_name, CASE WHEN service_id IS NULL THEN 'dual_sync_judge_rejected' ELSE 'domain_consultation_fallback' END AS match_method,
 coalesce(service_id, -1) AS service_id, coalesce('domain_consultation:' || domain || ':' || service_id, '-') AS dedupe_key, coalesce(listed, '') AS suggestions, coalesce(first, '-') AS first
FROM m LEFT JOIN s USING (mention) LEFT JOIN c USING (mention)
""")
def rejected_suggestions(spark, sf_dir):
    """Orders as rejected mentions, their lines as local and the next order's as general candidates, suppliers as services."""
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    kind = F.when(k % 4 == 0, "Procedure").when(k % 4 == 1, "Surgery").otherwise("Medication")
    normalized = F.when(k % 3 == 0, F.upper("o_orderpriority")).otherwise(F.concat("o_orderstatus", (k % 5).cast("string")))
    mentions = table(spark, sf_dir, "orders").select(k.alias("mention"), F.col("o_orderpriority").alias("span"), normalized.alias("normalized"), kind.alias("kind"), F.array(*(F.col("o_custkey") % d for d in (90, 40, 7))).alias("domains"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    local = lines.select(F.when(F.col("l_orderkey") % 5 != 2, F.col("l_orderkey")).otherwise(-1).alias("mention"), F.col("p_name").alias("name"), (F.col("l_discount") * 10 + n / 100).alias("score"), F.col("l_partkey").alias("stock_id"), F.when(n % 2 == 0, F.col("l_suppkey")).alias("service_id"), F.lit(None).cast("long").alias("concept_id")).distinct()
    general = lines.select(F.when(F.col("l_orderkey") % 7 != 3, F.col("l_orderkey") - 1).otherwise(-1).alias("mention"), F.when(n == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), (F.col("l_tax") * 10 + n / 1000).alias("score"), F.col("l_partkey").alias("concept_id")).distinct()
    s = F.col("s_suppkey")
    services = table(spark, sf_dir, "supplier").select((s % 35).alias("domain"), s.alias("service_id"), F.col("s_name").alias("service"), F.col("s_acctbal").alias("price"), F.when(s % 3 == 0, "Surgery").otherwise("Tele-Consultation").alias("category"))
    out = suggestions.rejected(mentions, local, general, services)
    number = lambda c: F.coalesce(c.cast("string"), F.lit("-1"))
    line = lambda x: F.concat_ws("/", x["name"], F.round(x["match_score"], 4).cast("decimal(10,4)").cast("string"), number(x["service_id"]), number(x["stock_id"]), number(x["kb_concept_id"]))
    return out.select("mention", "display_name", "match_method", F.coalesce("local_service_id", F.lit(-1)).alias("service_id"), F.coalesce("dedupe_key", F.lit("-")).alias("dedupe_key"), F.array_join(F.transform("suggestions", line), ";").alias("suggestions"), F.coalesce(F.concat("primary.name", F.col("primary.stock_id").cast("string")), F.lit("-")).alias("first"))


SCHEMA = [
    ("Medicine", "HAS_DOSE", "dose", "5 mg", True, "number"), ("Medicine", "HAS_ROUTE", "route", "PO", True, "text"), ("Medicine", "IS_DAILY", "daily", "true", False, "flag"), ("Medicine", "STARTS", "start", "1995-01-02", False, "date"),
    ("Procedure", "HAS_SITE", "site", "left hip", True, "text"), ("Procedure", "HAS_COUNT", "count", "2", False, "number"), ("Procedure", "HAS_DOSE", "dose", None, None, None),
]
SCHEMA_SQL = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in SCHEMA)


@query(f"""
WITH z(source_kind, relationship, target, use_case, required, type) AS (VALUES {SCHEMA_SQL}),
l AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE) AS id, l_orderkey % 4 AS k, l_partkey % 5 AS j, l_linenumber AS n, l_partkey AS p, l_shipdate::DATE AS d FROM lineitem),
a AS (SELECT id, CASE k WHEN 0 THEN 'Procedure' WHEN 3 THEN 'Odd' ELSE 'Medicine' END AS kind, CASE j WHEN 0 THEN '{{"HAS_DOSE": ' || p || ', "HAS_ROUTE": "PO", "IS_DAILY": true, "STARTS": "' || d || '"}}'
  WHEN 1 THEN '{{"HAS_DOSE": "' || n || '", "HAS_SITE": "hip", "JUNK": [1, "x"], "HAS_COUNT": "many"}}' WHEN 2 THEN '{{"HAS_DOSE": "some", "HAS_ROUTE": null, "STARTS": "soon", "IS_DAILY": "false"}}' WHEN 3 THEN '[1, 2]' ELSE CASE WHEN n = 1 THEN NULL WHEN n = 2 THEN '{{broken' ELSE '{{}}' END END AS payload FROM l),
o AS (SELECT *, coalesce(CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END, false) AS is_object FROM a),
e AS (SELECT id, kind, u.name, json_extract(payload, '$.' || u.name) AS value, json_extract_string(payload, '$.' || u.name) AS v FROM o, (SELECT unnest(json_keys(CASE WHEN is_object THEN payload END)) AS name) u),
m AS (SELECT e.*, z.source_kind IS NOT NULL AS known, coalesce(z.type, 'text') AS type FROM e LEFT JOIN z ON z.source_kind = e.kind AND z.relationship = e.name WHERE json_type(value) <> 'NULL'),
c AS (SELECT *, CASE type WHEN 'number' THEN TRY_CAST(v AS DOUBLE) IS NOT NULL WHEN 'flag' THEN TRY_CAST(v AS BOOLEAN) IS NOT NULL WHEN 'date' THEN TRY_CAST(v AS DATE) IS NOT NULL ELSE true END AS sound FROM m),
s AS (SELECT id, string_agg(name || '=' || CASE type WHEN 'number' THEN TRY_CAST(v AS DOUBLE)::BIGINT::VARCHAR ELSE v END, ',' ORDER BY name) FILTER (WHERE known AND sound) AS sound, string_agg(name || '=' || CASE WHEN json_type(value) = 'ARRAY' THEN replace(value::VARCHAR, ' ', '') ELSE value::VARCHAR END, ';' ORDER BY name) FILTER (WHERE NOT known) AS unknown, string_agg(name, ',' ORDER BY name) FILTER (WHERE known AND NOT sound) AS wrong FROM c GROUP BY id),
q AS (SELECT o.id, string_agg(z.relationship, ',' ORDER BY z.relationship) AS missing FROM o JOIN z ON z.source_kind = o.kind AND z.required LEFT JOIN c ON c.id = o.id AND c.name = z.relationship AND c.known AND c.sound WHERE c.id IS NULL GROUP BY o.id)
SELECT id, is_object, coalesce(sound, '') AS sound, coalesce(unknown, '') AS unknown, coalesce(wrong, '') AS wrong, coalesce(missing, '') AS missing FROM o LEFT JOIN s USING (id) LEFT JOIN q USING (id)
""")
def attribute_schema(spark, sf_dir):
    """Payloads of line items, sound, odd and broken ones, against a schema of two kinds."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").cast("string")).alias("id"), (F.col("l_orderkey") % 4).alias("k"), (p % 5).alias("j"), n.alias("n"), p.alias("p"), F.to_date("l_shipdate").cast("string").alias("d")).distinct()
    whole = F.format_string('{"HAS_DOSE": %s, "HAS_ROUTE": "PO", "IS_DAILY": true, "STARTS": "%s"}', F.col("p").cast("string"), "d")
    part = F.format_string('{"HAS_DOSE": "%s", "HAS_SITE": "hip", "JUNK": [1, "x"], "HAS_COUNT": "many"}', F.col("n").cast("string"))
    odd = F.lit('{"HAS_DOSE": "some", "HAS_ROUTE": null, "STARTS": "soon", "IS_DAILY": "false"}')
    payload = F.when(F.col("j") == 0, whole).when(F.col("j") == 1, part).when(F.col("j") == 2, odd).when(F.col("j") == 3, "[1, 2]").otherwise(F.when(F.col("n") == 1, None).when(F.col("n") == 2, "{broken").otherwise("{}"))
    kind = F.when(F.col("k") == 0, "Procedure").when(F.col("k") == 3, "Odd").otherwise("Medicine")
    schema = spark.createDataFrame(SCHEMA, "source_kind string, relationship string, target_attribute string, use_case string, is_required boolean, value_type string")
    out = attributes.checked(lines.select("id", kind.alias("kind"), payload.alias("payload")), schema)
    pairs = lambda c, show: F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), show(e["value"])))
    text = lambda v: v.cast("string")
    sound = F.array_sort(F.concat(pairs("numbers", lambda v: v.cast("long").cast("string")), *(pairs(c, text) for c in ("flags", "dates", "texts"))))
    return out.select("id", "is_object", F.array_join(sound, ",").alias("sound"), F.array_join(F.array_sort(pairs("unknown", text)), ";").alias("unknown"), F.array_join("wrong", ",").alias("wrong"), F.array_join(F.array_sort("missing"), ",").alias("missing"))


SAID = ["tablets", "bravecto tablet", "fho", "xray of hip", "some long mention here", "abc", "exam", "nutrich capsule 60s", "blue ring drops", ""]
SHOWN = ["Nutrich capsule", "exam", "tablet pack", "blue ring drops", "scan", "Bravecto tab"]
ODDS = ["Drug", "Procedure", "Medicine", "Vaccine", "Diagnosis"]
FLOW = f"""
WITH l AS (SELECT DISTINCT l_orderkey AS entity, l_partkey * 100 + l_linenumber AS id, l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem),
r AS (SELECT entity, {pick(SAID, "entity")} AS mention, {pick(ODDS, "entity // 3")} AS kind, id, {pick(SHOWN, "p")} AS name, CASE WHEN entity % 11 = 0 THEN 0 ELSE (p * 7 + n) % 101 / 100.0 END::DOUBLE AS t, CASE WHEN entity % 11 = 0 THEN 0 ELSE (s * 13 + p * (entity % 2)) % 101 / 100.0 END::DOUBLE AS ph,
  CASE WHEN entity % 3 = 0 OR entity % 11 = 0 THEN 0 ELSE (p * (CASE WHEN entity % 2 = 0 THEN 7 ELSE 31 END) + n) % 101 / 100.0 END::DOUBLE AS v, p % 2 = 0 AS relevant FROM l),
m AS (SELECT *, CASE WHEN entity % 11 = 0 THEN (id % 97) / 96.0 WHEN entity % 4 = 0 THEN greatest(t, v) WHEN entity % 4 = 1 THEN greatest(ph, v) ELSE round((t + ph + v) / 3, 6) END::DOUBLE AS m FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY m DESC, id) AS rank FROM m QUALIFY rank <= 10),
c AS (SELECT * REPLACE (CASE WHEN m > 0 AND t = 0 AND ph = 0 AND v = 0 THEN m ELSE t END AS t) FROM k),
w AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t DESC, rank) AS rt, row_number() OVER (PARTITION BY entity ORDER BY ph DESC, m DESC, rank) AS rp, row_number() OVER (PARTITION BY entity ORDER BY v DESC, rank) AS rv FROM c),
g AS (SELECT entity, any_value(mention) AS mention, any_value(kind) AS kind, max(id) FILTER (WHERE rank = 1) AS top, max(m) FILTER (WHERE rank = 1) AS best, round(max(m) FILTER (WHERE rank = 1) - coalesce(max(m) FILTER (WHERE rank = 2), 0), 9) AS margin, max(t) FILTER (WHERE rank = 1) AS tt, max(ph) FILTER (WHERE rank = 1) AS tp, max(v) FILTER (WHERE rank = 1) AS tv,
  max(name) FILTER (WHERE rank = 1) AS name, bool_or(relevant) FILTER (WHERE rank = 1) AS relevant, max(id) FILTER (WHERE rt = 1) AS bt, max(id) FILTER (WHERE rp = 1) AS bp, max(id) FILTER (WHERE rv = 1) AS bv, max(t) AS mt, max(v) AS mv, max(v) > 0 AS hv,
  bool_and(name NOT IN ('exam', 'scan')) FILTER (WHERE rank <= 5) AS specifics FROM w GROUP BY entity),
d AS (SELECT *, mention IN ('tablets', 'exam', '', 'abc', 'fho') AS generic, (bt = top)::INT + (bp = top)::INT + (hv AND bv = top)::INT AS votes, CASE WHEN kind IN ('Drug', 'Medicine') THEN 0.88 ELSE 0.92 END AS base FROM g),
x AS (SELECT *, CASE WHEN generic THEN '' WHEN bt = bp AND (NOT hv OR bt = bv) AND (CASE WHEN hv THEN greatest(mt, mv) ELSE mt END) >= 0.7 THEN 'A' WHEN best >= CASE WHEN {{low}} THEN 0.80 ELSE base END THEN 'B1'
  WHEN votes >= 2 AND margin >= 0.15 AND bt = top AND hv AND bv = top AND tt >= 0.62 AND tv >= 0.3 AND kind IN ('Drug', 'Medicine', 'Vaccine') AND (contains(mention, 'capsule') AND contains(name, 'capsule') OR contains(mention, 'tab') AND contains(lower(name), 'tab') OR contains(mention, 'drops') AND contains(name, 'drops')) THEN 'BRAND'
  WHEN votes >= 2 AND margin >= 0.08 AND greatest(tt, tv) >= 0.7 THEN 'B2' ELSE '' END AS gate FROM d)
"""
SPENT = "CASE WHEN gate <> '' THEN gate WHEN NOT generic AND mention = 'xray of hip' AND tv >= 0.75 THEN 'SHORT' WHEN NOT generic AND tt >= 0.75 AND tv >= 0.75 THEN 'PREDICTIVE' WHEN generic AND specifics THEN 'REJECT' ELSE 'JUDGE' END"


def flow_candidates(spark, sf_dir):
    """Lines of an order as candidates of one mention, with scores that bring every gate about."""
    e, p, s, n = F.col("entity"), F.col("p"), F.col("s"), F.col("n")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n")).distinct()
    bare = e % 11 == 0
    t, ph = F.when(bare, 0.0).otherwise((p * 7 + n) % 101 / 100), F.when(bare, 0.0).otherwise((s * 13 + p * (e % 2)) % 101 / 100)
    v = F.when((e % 3 == 0) | bare, 0.0).otherwise((p * F.when(e % 2 == 0, 7).otherwise(31) + n) % 101 / 100)
    rows = lines.select("entity", spark_pick(SAID, e).alias("mention"), spark_pick(ODDS, F.floor(e / 3)).alias("kind"), "id", spark_pick(SHOWN, p).alias("name"), t.alias("trigram"), ph.alias("phonetic"), v.alias("vector"), (p % 2 == 0).alias("relevant"))
    score = F.when(bare, (F.col("id") % 97) / 96).when(e % 4 == 0, F.greatest("trigram", "vector")).when(e % 4 == 1, F.greatest("phonetic", "vector")).otherwise(F.round((F.col("trigram") + F.col("phonetic") + F.col("vector")) / 3, 6))
    return rows.withColumn("match_score", score)


@query(FLOW.format(low="relevant AND tp > 0.15 AND tt < 0.3") + f", y AS (SELECT *, {SPENT} AS decision FROM x) SELECT entity, decision, CASE WHEN decision = 'A' THEN bt WHEN decision IN ('REJECT', 'JUDGE') THEN -1 ELSE top END AS chosen_id, best, margin FROM y")
def decision_flow(spark, sf_dir):
    """Every gate, the rejection of generic mentions and what is left to the judge."""
    return decision.decision_flow(flow_candidates(spark, sf_dir)).withColumn("chosen_id", F.coalesce("chosen_id", F.lit(-1)))


@query(FLOW.format(low="false") + "SELECT entity, CASE gate WHEN '' THEN 'NONE' ELSE gate END AS decision, CASE gate WHEN 'A' THEN bt WHEN '' THEN -1 ELSE top END AS chosen_id, best, margin FROM x")
def decision_flow_without_judge(spark, sf_dir):
    return decision.decision_flow(flow_candidates(spark, sf_dir), judged=False).withColumn("chosen_id", F.coalesce("chosen_id", F.lit(-1)))


TOLD = ["tick and flea control", "hip scan", "omega oil", "horse vaccine", "deworming prevention", "skin rash", "joint exercise", "blood count test", "noble angle", "flea protection spray"]
TERMS = ["", "hip radiograph", "", "", "worm control", "rash", "", "complete blood count", "norberg angle", ""]
CONCEPTS = ["tick paralysis", "hip", "Fish oil, omega", "horse influenza vaccine of cattle", "worm disease", "skin rash", "joint", "blood count", "Norberg angle", "goat pox", "flea"]
CONCEPT_KINDS = ["Disease", "Anatomy", "Condition", "Procedure"]
MENTION_KINDS = ["Procedure", "exercise", "Medication", "diagnostic", "therapy", "Diagnosis"]
SHARED_SQL = lambda a, b, k: f"(CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len({a}) END)"
WORD_LIST = lambda c, k: f"list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: length(w) >= {k}))"


@query(f"""
WITH l AS (SELECT DISTINCT l_orderkey AS mention, l_partkey * 100 + l_linenumber AS concept, l_partkey AS p, l_linenumber AS n FROM lineitem),
c AS (SELECT mention, {pick(TOLD, "mention")} AS span, {pick(TERMS, "mention")} AS term, {pick(MENTION_KINDS, "mention // 7")} AS kind, concept, {pick(CONCEPTS, "p")} AS name, {pick(CONCEPT_KINDS, "p // 11")} AS concept_kind, ((p * 37 + n * 11) % 103) / 102.0 AS score FROM l),
b AS (SELECT *, CASE WHEN mention % 6 = 0 THEN '' ELSE span END AS normalized, CASE WHEN term = '' THEN span ELSE term END AS t FROM c QUALIFY row_number() OVER (PARTITION BY mention ORDER BY score DESC, concept) = 1),
v AS (SELECT *, contains(lower(span), lower(name)) OR contains(lower(name), lower(span)) AS near, CASE WHEN score < 0.55 THEN 'below_threshold'
  WHEN lower(kind) IN ('procedure', 'diagnostic') AND {SHARED_SQL(WORD_LIST("t", 2), WORD_LIST("name", 2), "")} < 0.35 THEN 'needs_judge'
  WHEN len(list_filter(['cattle', 'horse', 'goat'], lambda s: contains(lower(name), s) AND NOT contains(span, s))) > 0 THEN 'species'
  WHEN regexp_matches(span, 'control|prevention|protection') AND regexp_matches(span, 'tick|flea|worm') AND concept_kind IN ('Disease', 'Condition') THEN 'preventive'
  WHEN lower(kind) IN ('exercise', 'therapy') AND concept_kind = 'Anatomy' THEN 'anatomy'
  WHEN {SHARED_SQL(WORD_LIST("span", 1), WORD_LIST("name", 1), "")} < 0.25 AND NOT (contains(lower(span), lower(name)) OR contains(lower(name), lower(span))) THEN 'unrelated' ELSE 'bound' END AS verdict FROM b)
SELECT mention, verdict, CASE WHEN verdict = 'bound' THEN concept ELSE -1 END AS concept, CASE WHEN verdict = 'bound' AND near THEN name ELSE span END AS display_name FROM v
""")
def safety_gates(spark, sf_dir):
    """Lines of an order as concepts of one mention; the best of them meets every gate."""
    m, p = F.col("mention"), F.col("p")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mention"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("concept"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n")).distinct()
    span, zero = spark_pick(TOLD, m), F.lit(0.0)
    rows = lines.select(
        "mention", span.alias("span"), spark_pick(TERMS, m).alias("search_term"), F.when(m % 6 == 0, "").otherwise(span).alias("normalized"), spark_pick(MENTION_KINDS, F.floor(m / 7)).alias("kind"), "concept",
        spark_pick(CONCEPTS, p).alias("name"), spark_pick(CONCEPT_KINDS, F.floor(p / 11)).alias("concept_kind"), ((p * 37 + F.col("n") * 11) % 103 / 102).alias("score"), zero.alias("trigram"), zero.alias("phonetic"), zero.alias("vector"),
    )
    return safety.guarded(rows).withColumn("concept", F.coalesce("concept", F.lit(-1)))
