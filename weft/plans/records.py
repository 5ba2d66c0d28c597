"""Queries on single mentions, items, notes and their rules, over columns made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import notes, predicates as p, text
from ..operators import relational, routing
from .registry import query, table, words_sql

KINDS = ["Medication", "Procedure", "Diagnosis", "Anatomy", "ReasonForVisit", "Drug", "LabTest", "Symptom", "Finding", "VitalSign", "Vaccine", "Breed", "Diet", "Other", "Toxin"]
INTENTS = ["Prescribed", "Scheduled", "Future", "Ordered", "Reminder", "", "History"]
SPANS = [" year old male Labrador", " mg tablet", " kg neutered beagle", " yrs male", " kg weight", " blood test panel", " weeks of rest, otherwise normal", " pug puppy", " normal findings", " hills prescription diet", " current ongoing pain", " exam", " x ray", " chew toy and brush"]
NAMES = ["Blood test", "exam", "Service", "hip x ray", "Labrador", "dental scan", "Beagle", "poodle", "test panel", "Retriever"]


def pick(values: list[str], i: str) -> str:
    """DuckDB expression for the value at the place ``i`` modulo their number; ``spark_pick`` is the same for Spark."""
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[({i}) % {len(values)} + 1]"


KIND, SPAN, NAME, INTENT = (pick(v, i) for v, i in ((KINDS, "doc_id"), (SPANS, "doc_id // 2"), (NAMES, "doc_id // 3"), (INTENTS, "doc_id // 5")))
SPAN_SQL = f"(doc_id % 40)::VARCHAR || {SPAN}"
MENTIONS_SQL = f"m AS (SELECT doc_id, {KIND} AS kind, {SPAN_SQL} AS span, {NAME} AS name, {INTENT} AS intent, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 100 / 100.0)::DECIMAL(4,2)::VARCHAR WHEN doc_id % 3 = 1 THEN 'high' END AS certainty FROM documents)"


def spark_pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def mentions(spark, sf_dir):
    """One mention a document: kind, span, candidate name, intent and a certainty that is sometimes no number."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    half = lambda n: F.floor(F.col("doc_id") / n)
    certainty = F.when(F.col("doc_id") % 3 == 0, F.format_number((F.col("doc_id") % 100) / 100, 2)).when(F.col("doc_id") % 3 == 1, "high")
    return d.select("doc_id", spark_pick(KINDS, F.col("doc_id")).alias("kind"), F.concat((F.col("doc_id") % 40).cast("string"), spark_pick(SPANS, half(2))).alias("span"), spark_pick(NAMES, half(3)).alias("name"), spark_pick(INTENTS, half(5)).alias("intent"), certainty.alias("certainty"))


def in_sql(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def any_sql(c: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{v}')" for v in values) + ")"


AGE = r"(regexp_matches(s, '\b[0-9]+(\.[0-9]+)?\s*(year|yr|yrs|month|mo|mos)\b') OR contains(s, 'year old') OR contains(s, 'yr old'))"
SEX = r"regexp_matches(s, '\b(male|female|neutered|spayed|intact)\b')"
WEIGHT = r"regexp_matches(s, '\b[0-9]+(\.[0-9]+)?\s*(kg|kgs|kilogram|lb|lbs|pound|pounds)\b')"
BREED = any_sql("s", p.BREEDS)


@query(f"""
WITH {MENTIONS_SQL}, x AS (SELECT *, lower(trim(span)) AS s, {words_sql("name")} AS nw, {words_sql("span")} AS sw FROM m)
SELECT doc_id, ({AGE} AND {SEX}) OR ({AGE} AND {BREED}) OR ({SEX} AND {BREED}) OR ({WEIGHT} AND ({AGE} OR {SEX})) AS signalment,
  {any_sql("span", p.STATUS_PHRASES)} AS clinical_status, {any_sql("span || ' ' || name", p.RETAIL_WORDS)} AS retail,
  len(list_filter(nw, lambda w: NOT (w IN {in_sql(p.GENERIC_NAMES)}))) = 0 AS generic_name,
  len(list_filter(sw, lambda w: NOT (w IN {in_sql(p.GENERIC_ANCHORS)}) AND (length(w) >= 4 OR len(sw) >= 3))) > 0 AS specific_anchor,
  kind IN {in_sql(p.SERVICES_ONLY)} AS services_only, kind IN {in_sql(p.INTENT_KINDS)} AS wants_intent,
  kind IN {in_sql(p.MEDICINE_KINDS)} AND intent IN {in_sql(p.MEDICINE_INTENTS)} AS medicine_atom, intent <> '' AND intent IN {in_sql(["Prescribed", "Scheduled", "Future", "Ordered"])} AS intent_known,
  CASE WHEN {any_sql("span", p.ONGOING_WORDS)} THEN 'Ongoing' ELSE '' END AS ongoing, TRY_CAST(certainty AS DOUBLE) AS certainty, lower(name) = 'exam' AS exact_term
FROM x
""")
def span_predicates(spark, sf_dir):
    """Rules on a mention's span, name, kind and intent."""
    span, name, kind, intent = (F.col(c) for c in ("span", "name", "kind", "intent"))
    return mentions(spark, sf_dir).select(
        "doc_id", p.is_signalment(span).alias("signalment"), p.is_clinical_status(span).alias("clinical_status"), p.is_retail(span, name).alias("retail"), p.is_generic_name(name).alias("generic_name"),
        p.has_specific_anchor(span).alias("specific_anchor"), p.in_list(kind, p.SERVICES_ONLY).alias("services_only"), p.wants_intent(name, kind).alias("wants_intent"),
        p.is_medicine_atom(kind, intent).alias("medicine_atom"), p.in_list(intent, ["Prescribed", "Scheduled", "Future", "Ordered"]).alias("intent_known"),
        p.ongoing(span).alias("ongoing"), p.certainty(F.col("certainty")).alias("certainty"), p.is_exact_term(name, name, F.lit(" Exam")).alias("exact_term"),
    )


def case_sql(c: str, values: dict[str, list[str]], give=lambda v: "'" + ",".join(v) + "'") -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {give(v)}" for k, v in values.items()) + " END"


FAMILY_SQL = "CASE " + " ".join(f"WHEN kind IN {in_sql(v)} THEN '{k}'" for k, v in p.FAMILIES.items()) + " ELSE 'OTHER' END"
CATEGORIES = ["Pharmacy", "Diagnostics & Lab", "Lab reagents", "Surgery", "Drug store", "", "Laboratory", "Toys"]
FITS_SQL = "CASE " + " ".join(f"WHEN kind = '{k}' AND c <> '' THEN CASE WHEN c IN {in_sql(v)} THEN true WHEN {any_sql('c', p.CONFLICTING_WORDS.get(k, ['~']))} THEN false END" for k, v in p.FITTING_CATEGORIES.items()) + " END"


@query(f"""
WITH {MENTIONS_SQL}, x AS (SELECT *, {pick(CATEGORIES, "doc_id // 4")} AS category FROM m),
y AS (SELECT *, trim(regexp_replace(replace(lower(category), '&', 'and'), '[^a-z0-9]+', ' ', 'g')) AS c FROM x)
SELECT doc_id, kind, {FAMILY_SQL} AS family, CASE WHEN doc_id % 4 = 0 THEN 'CLINICAL' ELSE {FAMILY_SQL} END AS given_family, {case_sql("kind", p.KB_KINDS)} AS kb_kinds,
  CASE WHEN lower(kind) = 'anatomy' AND lower(name) IN {in_sql(p.BREEDS_TAKEN_FOR_ANATOMY)} THEN 'Other' ELSE kind END AS corrected, {FITS_SQL} AS fits
FROM y
""")
def kind_lookups(spark, sf_dir):
    """Families, catalogue kinds, corrected kinds, and whether a category fits."""
    kind = F.col("kind")
    given = F.when(F.col("doc_id") % 4 == 0, "CLINICAL").when(F.col("doc_id") % 4 == 1, "nonsense")
    return mentions(spark, sf_dir).select(
        "doc_id", "kind", p.family(kind).alias("family"), p.family(kind, given).alias("given_family"), F.array_join(p.looked_up(kind, p.KB_KINDS), ",").alias("kb_kinds"),
        p.corrected_kind(kind, F.col("name")).alias("corrected"), p.kind_fits_category(kind, spark_pick(CATEGORIES, F.floor(F.col("doc_id") / 4))).alias("fits"),
    )


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_shipdate AS made, late AS expires, (l_partkey % 50)::VARCHAR AS batch, (l_suppkey % 50)::VARCHAR AS barcode, CASE WHEN l_linenumber = 7 THEN -l_extendedprice ELSE l_extendedprice * 3 END AS price FROM (SELECT *, l_shipdate + INTERVAL (l_partkey % 30) DAY AS late FROM lineitem)),
y AS (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN expires ELSE made END AS m, CASE WHEN l_orderkey % 7 = 0 THEN made ELSE expires END AS e FROM x)
SELECT l_orderkey, l_linenumber, least(m, e)::DATE::VARCHAR AS made, greatest(m, e)::DATE::VARCHAR AS expires, CASE WHEN batch <> barcode THEN batch END AS batch, CASE WHEN price >= 0 THEN round(price, 2) END AS price,
  array_to_string(list_filter([CASE WHEN m >= e THEN 'dates_not_in_order' END, CASE WHEN m > e THEN 'dates_swapped' END, CASE WHEN batch = barcode THEN 'batch_equals_barcode' END, CASE WHEN price < 0 THEN 'negative_price' END, CASE WHEN price > 100000 THEN 'high_price' END], lambda w: w IS NOT NULL), ',') AS warnings
FROM y
""")
def item_validation(spark, sf_dir):
    """Reversed dates swapped, equal codes and negative prices cleared, each with a warning."""
    lines = table(spark, sf_dir, "lineitem").withColumn("late", F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_partkey") % 30).cast("int"))).withColumn("early", F.col("l_shipdate").cast("date"))
    turned = F.col("l_orderkey") % 7 == 0
    price = F.when(F.col("l_linenumber") == 7, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") * 3)
    checked = p.validated(F.when(turned, F.col("late")).otherwise(F.col("early")), F.when(turned, F.col("early")).otherwise(F.col("late")), (F.col("l_partkey") % 50).cast("string"), (F.col("l_suppkey") % 50).cast("string"), price)
    v = lines.select("l_orderkey", "l_linenumber", checked.alias("v"))
    return v.select("l_orderkey", "l_linenumber", F.col("v.made").cast("string").alias("made"), F.col("v.expires").cast("string").alias("expires"), "v.batch", F.round("v.price", 2).alias("price"), F.array_join("v.warnings", ",").alias("warnings"))


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_custkey % 4 = 0 THEN 'dose' END, CASE WHEN o_orderkey % 3 IN (0, 1) THEN 'frequency' END, CASE WHEN trim(o_orderpriority) = '' THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS missing,
  CASE WHEN o_orderkey % 10 = o_custkey % 10 THEN (o_orderkey % 10)::VARCHAR ELSE '' END AS repeated
FROM orders
""")
def field_checks(spark, sf_dir):
    """Required fields that are missing, and values that two fields share."""
    frequency = F.when(F.col("o_orderkey") % 3 == 0, "As Directed ").when(F.col("o_orderkey") % 3 == 1, "  ").otherwise("twice")
    dose = F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey"))
    missing = p.missing_fields({"dose": dose, "frequency": frequency, "priority": F.col("o_orderpriority")}, ["as directed"])
    repeated = p.repeated_values({"a": F.col("o_orderkey") % 10, "b": F.col("o_custkey") % 10, "c": F.lit("")})
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(missing, ",").alias("missing"), F.array_join(repeated, ",").alias("repeated"))


@query("""
SELECT user_id, count(*) FILTER (WHERE value > 150) AS errors, count(*) FILTER (WHERE value > 100 AND value <= 150) AS warnings, count(*) FILTER (WHERE value <= 100) AS infos,
  greatest(2000, least(9000, 800 + (sum(length(props)) // 1000) * 300 + count(*) * 60))::BIGINT AS budget FROM events GROUP BY user_id
""")
def severity_counts(spark, sf_dir):
    """Flags by severity, and the token budget of a user's events."""
    v = F.col("value")
    severity = F.when(v > 150, "error").when(v > 100, "warning").otherwise("info")
    e = table(spark, sf_dir, "events").withColumn("severity", severity)
    counts = e.groupBy("user_id").agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")), F.sum(F.length("props")).alias("chars"), F.count(F.lit(1)).alias("n"))
    return counts.select("user_id", "errors", "warnings", "infos", p.token_budget(F.col("chars"), F.col("n"), 800, 300, 60, 2000, 9000).alias("budget"))


@query("""
SELECT doc_id, greatest(2000, least(6000, floor((length(coalesce(text, '')) // 4) * 3.25)))::BIGINT AS answer_budget,
  CASE WHEN length(text) <= 3000 THEN length(text) ELSE 2000 + 500 + 7 END::BIGINT AS guarded_chars
FROM documents WHERE text IS NOT NULL
""")
def text_budgets(spark, sf_dir):
    """Token budget of the answer to a text, and the length that a long one has after head and tail are taken."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", p.answer_budget(F.col("text"), 2000, 6000).alias("answer_budget"), F.length(text.shortened(F.col("text"), 3000, 2000, 500)).cast("long").alias("guarded_chars"))


@query("""
WITH r AS (SELECT o_orderkey AS id, 0 AS part, lower(o_orderpriority) AS name, o_totalprice AS price FROM orders UNION ALL SELECT c_custkey, 1, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lower(c_mktsegment) END, c_acctbal FROM customer)
SELECT id, part, name FROM r QUALIFY name = '' OR row_number() OVER (PARTITION BY name ORDER BY part, id) = 1
""")
def reminder_merge(spark, sf_dir):
    """Two lists as one, the first of each name kept, nameless rows all kept."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("part"), "o_orderpriority")
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("part"), F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.upper("c_mktsegment")).alias("o_orderpriority"))
    rows = a.unionByName(b).select("id", "part", p.concept_key(F.col("o_orderpriority")).alias("name"))
    named = relational.best_per_key(rows.where("name <> ''"), ["name"], F.asc("part"), F.asc("id"))
    return named.unionByName(rows.where("name = ''"))


SECTIONS = ["Subjective", "Objective", "Assessment", "Plan"]
NOTE_SQL = "CASE doc_id % 5 WHEN 0 THEN 'Subjective: ' || w1 || chr(10) || 'Plan: 1. ' || w2 || chr(10) || '2) Unknown-not specified' || chr(10) || 'ASSESSMENT : ' || w3 WHEN 1 THEN w1 || ' ' || w2 WHEN 2 THEN 'Error: ' || w1 WHEN 3 THEN '' ELSE 'Objective:' || chr(10) || w1 || chr(10) || 'Plan: ' || w2 END"


@query(f"""
WITH d AS (SELECT doc_id, len(w) AS n, 'v' || coalesce(w[1], '') AS w1, 'v' || coalesce(w[2], '') AS w2, 'v' || coalesce(w[3], '') AS w3 FROM (SELECT doc_id, {words_sql("text")} AS w FROM documents)),
x AS (SELECT *, {NOTE_SQL} AS note FROM d)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN w1 WHEN 1 THEN note WHEN 2 THEN note END AS subjective, CASE WHEN doc_id % 5 = 4 THEN w1 END AS objective,
  CASE WHEN doc_id % 5 = 0 THEN w3 END AS assessment, CASE doc_id % 5 WHEN 0 THEN '1. ' || w2 || chr(10) || '2) Unknown-not specified' WHEN 4 THEN w2 END AS plan,
  CASE doc_id % 5 WHEN 0 THEN w2 WHEN 4 THEN w2 ELSE '' END AS plan_lines,
  CASE doc_id % 5 WHEN 2 THEN note WHEN 3 THEN 'empty note' END AS failure,
  CASE doc_id % 5 WHEN 0 THEN 'Subjective:' || chr(10) || w1 || chr(10) || chr(10) || 'Assessment:' || chr(10) || w3 WHEN 4 THEN 'Objective:' || chr(10) || w1 WHEN 3 THEN '' ELSE 'Subjective:' || chr(10) || note END AS core
FROM x
""")
def note_sections(spark, sf_dir):
    """Notes cut at their headings, the plan's lines, why a note is no real one, and its core sections."""
    w = text.words(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", *(F.concat(F.lit("v"), F.coalesce(F.get(w, k), F.lit(""))).alias(f"w{k + 1}") for k in range(3)))
    note = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Subjective: "), "w1", F.lit("\nPlan: 1. "), "w2", F.lit("\n2) Unknown-not specified\nASSESSMENT : "), "w3")).when(F.col("doc_id") % 5 == 1, F.concat("w1", F.lit(" "), "w2"))
    note = note.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("Error: "), "w1")).when(F.col("doc_id") % 5 == 3, "").otherwise(F.concat(F.lit("Objective:\n"), "w1", F.lit("\nPlan: "), "w2"))
    x = d.select("doc_id", note.alias("note")).withColumn("parts", notes.sections(F.col("note"), SECTIONS, "Subjective"))
    of = lambda n: F.try_element_at("parts", F.lit(n))
    core = F.coalesce(notes.core(F.col("parts"), ["Subjective", "Objective", "Assessment"]), F.lit(""))
    return x.select("doc_id", *(of(n).alias(n.lower()) for n in SECTIONS), F.array_join(notes.diagnosis_lines(of("Plan")), "|").alias("plan_lines"), notes.failure_of(F.col("note"), [of(n) for n in SECTIONS]).alias("failure"), core.alias("core"))


@query("""
SELECT c_custkey, CASE WHEN p <> '' AND s <> '' THEN p || '; Secondary: ' || s WHEN p <> '' THEN p ELSE s END AS diagnosis,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 1 THEN '' ELSE concat_ws(chr(10) || chr(10), CASE WHEN c_custkey % 3 <> 0 THEN '**VISIT:**' || chr(10) || c_name END, CASE WHEN c_custkey % 4 = 1 THEN '**VITALS:**' || chr(10) || c_mktsegment END) || chr(10) END AS inputs
FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 5 = 0 THEN '' ELSE 'legacy' END AS p, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS s FROM customer)
""")
def note_fields(spark, sf_dir):
    """Diagnoses as one string, legacy fields filling in, and optional inputs under titles."""
    k = F.col("c_custkey")
    primary, legacy = F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(" "), F.when(k % 5 == 0, "").otherwise("legacy")
    secondary = F.when(k % 3 == 0, "").otherwise(F.col("c_name"))
    inputs = notes.labelled_inputs([("VISIT", F.when(k % 3 != 0, F.col("c_name"))), ("PROTOCOLS", F.lit("")), ("VITALS", F.when(k % 4 == 1, F.col("c_mktsegment")))])
    return table(spark, sf_dir, "customer").select("c_custkey", notes.diagnosis_text(primary, secondary, legacy).alias("diagnosis"), inputs.alias("inputs"))


@query("""
WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '{"body_weight": "' || (s_suppkey % 40) || ' kg", "pain_score": "None", "heart_rate": "' || (60 + s_suppkey % 90) || '", "other": "x"}'
  ELSE 'Body Weight: ' || (s_suppkey % 40) || ' kg' || chr(10) || 'note' || chr(10) || 'Pulse Quality:' || chr(10) || 'heart rate: ' || (60 + s_suppkey % 90) || chr(10) || 'Heart Rate:  ' || (61 + s_suppkey % 90) END AS t FROM supplier)
SELECT s_suppkey, 0 AS place, 'Body Weight' AS field, (s_suppkey % 40) || ' kg' AS value, 'kg' AS unit FROM x
UNION ALL SELECT s_suppkey, 1, 'Heart Rate', (CASE WHEN s_suppkey % 2 = 0 THEN 60 ELSE 61 END + s_suppkey % 90)::VARCHAR, 'bpm' FROM x
""")
def vitals_rows(spark, sf_dir):
    """Vitals from JSON objects and from lines, as ordered rows."""
    k = F.col("s_suppkey")
    rate = lambda n: (F.lit(n) + k % 90).cast("string")
    kg = (k % 40).cast("string")
    as_json = F.concat(F.lit('{"body_weight": "'), kg, F.lit(' kg", "pain_score": "None", "heart_rate": "'), rate(60), F.lit('", "other": "x"}'))
    lines = F.concat(F.lit("Body Weight: "), kg, F.lit(" kg\nnote\nPulse Quality:\nheart rate: "), rate(60), F.lit("\nHeart Rate:  "), rate(61))
    v = table(spark, sf_dir, "supplier").select("s_suppkey", notes.vitals_of(F.when(k % 2 == 0, as_json).otherwise(lines)).alias("v"))
    return v.select("s_suppkey", F.posexplode(notes.vitals_rows(F.col("v"))).alias("place", "r")).select("s_suppkey", "place", "r.*")


LINES = ["Reminder to give the tablets after food", "give tablets after food every day", "Recheck in 2 weeks", "recheck in 2 weeks at the clinic", "Call if worse", "Keep the wound dry"]


@query(f"""
WITH x AS (SELECT p_partkey, [{pick(LINES, "p_partkey")}, {pick(LINES, "p_partkey // 6")}, {pick(LINES, "p_partkey // 36")}] AS l FROM part),
y AS (SELECT p_partkey, list_transform(list_filter(l, lambda v: v <> ''), lambda v: [trim(regexp_replace(v, '(?i)^reminder to ', ''))]) AS l FROM x)
SELECT p_partkey, array_to_string(list_reduce(l, lambda acc, v: list_transform([list_position(list_transform(acc, lambda q: list_transform([list_filter(list_distinct({words_sql("q")}), lambda w: NOT (w IN {in_sql(notes.STOP)}))], lambda qk: list_transform([list_filter(list_distinct({words_sql("v[1]")}), lambda w: NOT (w IN {in_sql(notes.STOP)}))], lambda vk: len(list_intersect(qk, vk)) >= 0.7 * least(len(qk), len(vk)))[1])[1]), true)],
  lambda z: CASE WHEN coalesce(z, 0) = 0 THEN list_concat(acc, v) WHEN length(v[1]) > length(acc[z]) THEN list_concat(list_concat(acc[:z - 1], v), acc[z + 1:]) ELSE acc END)[1]), '|') AS kept FROM y
""")
def near_duplicate_lines(spark, sf_dir):
    """Lines of three fields, near duplicates dropped, the longer one kept."""
    k = F.col("p_partkey")
    items = F.array(spark_pick(LINES, k), spark_pick(LINES, F.floor(k / 6)), spark_pick(LINES, F.floor(k / 36)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(notes.without_near_duplicates(items), "|").alias("kept"))


@query("""
SELECT c_custkey, regexp_replace(regexp_replace('the ' || lower(c_mktsegment) || ' case of ' || c_name || ', ' || c_mktsegment || 's', '(?i)\\b\\Q' || c_mktsegment || '\\E\\b', 'segment', 'g'), '(?i)\\b\\Q' || c_name || '\\E\\b', 'N$1', 'g') AS note FROM customer
""")
def name_injection(spark, sf_dir):
    """A note with verified names put in, one after the other, as whole words."""
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    note = F.concat(F.lit("the "), F.lower(seg), F.lit(" case of "), name, F.lit(", "), seg, F.lit("s"))
    pairs = F.array(F.struct(seg.alias("found"), F.lit("segment").alias("name")), F.struct(F.lit("").alias("found"), F.lit("x").alias("name")), F.struct(name.alias("found"), F.lit("N$1").alias("name")))
    return table(spark, sf_dir, "customer").select("c_custkey", notes.with_names(note, pairs).alias("note"))


@query("""
WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'nothing said' WHEN s_suppkey % 4 = 1 THEN 'The dog is ' || (s_suppkey % 20) || ' years old Male Golden Retriever right' WHEN s_suppkey % 4 = 2 THEN 'Oreo is here, ' || (s_suppkey % 20) || ' yr old F' ELSE 'Max, female' END AS t FROM supplier),
y AS (SELECT *, CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN 'Patient: ' || (s_suppkey % 20) || 'yo, male' WHEN s_suppkey % 4 = 2 THEN 'Patient: Oreo, ' || (s_suppkey % 20) || 'yo, female' ELSE 'Patient: Max, female' END AS h FROM x)
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN 'Patient: ' || (s_suppkey % 20) || 'yo, male, Male Golden' ELSE h END AS signalment, CASE WHEN h = '' THEN t ELSE CASE WHEN s_suppkey % 4 = 1 THEN 'Patient: ' || (s_suppkey % 20) || 'yo, male, Male Golden' ELSE h END || chr(10) || chr(10) || t END AS chunk FROM y
""")
def signalment_header(spark, sf_dir):
    """Who the patient is, from the beginning of a text, and a chunk that begins with it."""
    k = F.col("s_suppkey")
    n = (k % 20).cast("string")
    t = F.when(k % 4 == 0, "nothing said").when(k % 4 == 1, F.concat(F.lit("The dog is "), n, F.lit(" years old Male Golden Retriever right"))).when(k % 4 == 2, F.concat(F.lit("Oreo is here, "), n, F.lit(" yr old F"))).otherwise("Max, female")
    x = table(spark, sf_dir, "supplier").select("s_suppkey", t.alias("t")).withColumn("signalment", notes.signalment_of(F.col("t")))
    return x.select("s_suppkey", "signalment", notes.with_header(F.col("t"), F.col("signalment")).alias("chunk"))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS summary, n_name || ' text' AS rest, replace(trim(regexp_replace(n_name || '  the . end .', '\\s+', ' ', 'g')), ' .', '.') AS embedding_text FROM nation
""")
def summary_round_trip(spark, sf_dir):
    """A summary put before a text and taken out again, and the cleaned text for embeddings."""
    name = F.col("n_name")
    wrapped = notes.with_summary(F.concat(name, F.lit(" text")), F.when(F.col("n_nationkey") % 3 != 0, name).otherwise("  "))
    x = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", notes.summary_and_rest(wrapped).alias("s"))
    return x.select("n_nationkey", "s.summary", "s.rest", notes.embedding_text(F.concat("n_name", F.lit("  the . end ."))).alias("embedding_text"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_custkey % 4 = 0 OR o_orderkey % 5 = 0 THEN concat_ws('/', coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::VARCHAR END, '-'), coalesce(CASE WHEN o_custkey % 4 = 0 THEN '7' END, '-'), coalesce(CASE WHEN o_orderkey % 5 = 0 THEN '9' END, '-')) END AS identity,
  CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 3 = 0 THEN 'left hip' END AS anatomy,
  CASE WHEN o_orderkey % 2 = 0 THEN 'oreo' IN ('oreo, 5yo') OR contains('oreo, 5yo', 'oreo') ELSE false END AS same_signalment,
  coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'local' END, CASE WHEN o_orderkey % 5 = 0 THEN 'global' END, lower(o_orderpriority)) AS display_name,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS kept_id
FROM orders
""")
def entity_keys(spark, sf_dir):
    """Identity, anatomy and signalment keys, display names, and ids taken from rejected rows."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ident = p.identity_key(F.when(k % 3 == 0, c), F.when(c % 4 == 0, F.lit(7)), F.when(k % 5 == 0, F.lit(9)))
    shown = F.when(ident.isNotNull(), F.concat_ws("/", *(F.coalesce(ident[x].cast("string"), F.lit("-")) for x in ("concept", "service", "stock"))))
    attributes = F.when(k % 2 == 0, F.create_map(F.lit("body_part"), F.col("o_orderpriority"))).when(k % 3 == 0, F.create_map(F.lit("anatomy"), F.lit(" "), F.lit("site"), F.lit("Left Hip"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", shown.alias("identity"), p.first_attribute(attributes, ["anatomy", "body_part", "target_site", "body_site", "site"]).alias("anatomy"),
        p.same_signalment(F.when(k % 2 == 0, "Patient").otherwise("Drug"), F.lit("Oreo"), F.lit("other"), F.lit("oreo, 5yo")).alias("same_signalment"),
        text.first_filled(F.when(k % 3 == 0, "local"), F.when(k % 5 == 0, "global"), F.lower("o_orderpriority")).alias("display_name"), F.when(k % 7 != 0, c).alias("kept_id"),
    )


@query("""
SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN least(1.0, p_size / 50.0 * 1.2) ELSE p_size / 50.0 END, 6) AS boosted, p_partkey % 2 = 0 AS form FROM part
""")
def topic_boost(spark, sf_dir):
    """A score raised where issue and name share a topic; shared dosage forms."""
    k = F.col("p_partkey")
    topic = F.when(k % 3 == 0, "dental care").otherwise("skin care")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(p.contextual_boost(F.col("p_size") / 50.0, F.lit("dental pain, hip"), topic, ["hip", "dental"]), 6).alias("boosted"), p.shared_form(F.lit("one tablet"), F.when(k % 2 == 0, "tablet").otherwise("powder")).alias("form"))


@query("""
SELECT c_custkey, 'Plan' AS section, 'E1' AS anchor, c_mktsegment AS text FROM customer UNION ALL SELECT c_custkey, 'Plan', 'E2', 'b c' FROM customer UNION ALL SELECT c_custkey, 'Objective', 'E3', c_name FROM customer WHERE c_custkey % 2 = 0
""")
def section_anchors(spark, sf_dir):
    """Anchored names of every section of a note."""
    plan = F.concat(F.lit("give [[E1|"), F.col("c_mktsegment"), F.lit("]] and [[E2|b c]]"))
    objective = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("[[E3|"), F.col("c_name"), F.lit("]] seen"))).otherwise("nothing")
    note = F.create_map(F.lit("Plan"), plan, F.lit("Objective"), objective, F.lit("Empty"), F.lit(""))
    each = table(spark, sf_dir, "customer").select("c_custkey", F.explode(note).alias("section", "body"))
    return each.select("c_custkey", "section", F.explode(text.anchor_segments(F.col("body"))).alias("a")).select("c_custkey", "section", F.col("a.id").alias("anchor"), F.col("a.text").alias("text"))


@query("""
SELECT c_custkey, c_name || chr(10) || c_mktsegment AS note_text, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS intent, round(c_acctbal / 10000 * 0.8 + 0.2, 6) AS gate_score FROM customer
""")
def run_texts(spark, sf_dir):
    """A note's text from its JSON values, an intent passed through unless blank, and the boosted score that gates look at."""
    c = table(spark, sf_dir, "customer")
    as_json = F.to_json(F.struct(F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b")))
    values = F.array_join(F.map_values(F.from_json(as_json, "map<string,string>")), "\n")
    score = F.round(F.col("c_acctbal") / 10000 * 0.8 + 0.2, 6)
    return c.select("c_custkey", values.alias("note_text"), text.blank_to_null(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("  ")).alias("intent"), score.alias("gate_score"))
