"""Queries on reminders, products and mentions; their SQL is written from the rules, with its own patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import products, reminders
from .records import pick, spark_pick
from .registry import query, table

LINES = [
    "Schedule recheck", "Avoid stairs", "Do not bathe, recheck in 5 days", "Watch appetite", "Monitor and book appointment", "Return if needed", "CBC tomorrow", "Suture removal in 10 day", "If symptoms worsen call us if it bleeds",
    "Give tablets after food", "must not jump; return visit", "Follow-up unless better", "Refrain from swimming", "Next week physio", "vaccin booster", "", "  ", "Vaccination due", "x-ray as needed", "in 3 weeks",
]
WARNS = r"(regexp_matches(lower({0}), '\b(avoid|do not|don''t|should be avoided|must not|refrain from)\b') AND NOT {1})"
CUE = r"regexp_matches(lower({0}), '\b(recheck|schedule|book|appointment|vaccin|in [0-9]+|next (week|month|visit))\b')"
ACTS = (
    r"regexp_matches(lower({0}), '\b(recheck|re-check|follow[- ]?up|return visit|call ?back|schedule|book|appointment|vaccin|booster|surgery|suture removal|recall|next visit|(in|after) [0-9]+ (day|week|month)"
    r"|next month|next week|tomorrow|asap|due date|lab (test|work)|x-?ray|ultrasound|cbc|blood test|re-?culture|physio|hydrotherapy)\b')"
)
PASSIVE = r"regexp_matches(lower({0}), '\b(if (symptoms )?worsen|if needed|as needed|watch|monitor|observe|keep an eye|contact (us )?if|call (us )?if|return if|unless|should (symptoms|signs)|appetite|water intake|activity level)\b')"


def asks(c: str) -> str:
    cue = CUE.format(c)
    return f"(CASE WHEN trim({c}) = '' THEN false WHEN {WARNS.format(c, cue)} THEN false WHEN {ACTS.format(c)} THEN NOT ({PASSIVE.format(c)} AND NOT {cue}) ELSE false END)"


@query(f"""
WITH r AS (SELECT o_orderkey, {pick(LINES, "o_orderkey")} AS a, {pick(LINES, "o_custkey")} AS b, {pick(["Scheduled", "Recommended", "Future ", "", "Reminder", "Ordered"], "o_custkey")} AS intent,
  {pick(["", "ASAP", "2024-01-05", " asap ", ""], "o_orderkey // 2")} AS due, {pick(["12-3", "x1", "", "--", "7"], "o_orderkey // 3")} AS item FROM orders),
j AS (SELECT *, trim(concat_ws(' ', nullif(a, ''), nullif(b, ''), nullif(due, ''))) AS t FROM r)
SELECT o_orderkey, {asks("a")} AS text_asks, CASE WHEN {WARNS.format("t", CUE.format("t"))} THEN false WHEN trim(intent) IN ('Scheduled', 'Future') THEN true WHEN trim(due) <> '' AND upper(trim(due)) <> 'ASAP' THEN true
  WHEN regexp_matches(replace(item, '-', ''), '^[0-9]+$') THEN true ELSE {asks("t")} END AS row_asks FROM j
""")
def reminder_rows(spark, sf_dir):
    """Reminder texts by themselves, and rows by intent, date, id or joined text; warnings, conditions and dates are among them."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    a, b, none = spark_pick(LINES, o), spark_pick(LINES, c), F.lit(None).cast("string")
    intent, due, item = spark_pick(["Scheduled", "Recommended", "Future ", "", "Reminder", "Ordered"], c), spark_pick(["", "ASAP", "2024-01-05", " asap ", ""], F.floor(o / 2)), spark_pick(["12-3", "x1", "", "--", "7"], F.floor(o / 3))
    return table(spark, sf_dir, "orders").select("o_orderkey", reminders.is_actionable(a).alias("text_asks"), reminders.needs_action(a, none, b, due, intent, item).alias("row_asks"))


@query(f"""
WITH n AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN {pick(LINES, "o_custkey")} WHEN 2 THEN ' 1. ' || chr(10) || '2)' ELSE '1. ' || {pick(LINES, "o_orderkey")} || chr(10) || '  2) ' || {pick(LINES, "o_custkey")} || chr(13) || chr(10) || chr(10) || '10.' || {pick(LINES, "o_orderkey // 7")} END AS note FROM orders),
l AS (SELECT o_orderkey, trim(note, ' ' || chr(10) || chr(13)) AS raw, list_filter(list_transform(string_split_regex(trim(note, ' ' || chr(10) || chr(13)), '\\r\\n|\\n'), lambda x: regexp_replace(trim(x), '^[0-9]+[.)] *', '')), lambda x: trim(x) <> '') AS xs FROM n),
i AS (SELECT o_orderkey, CASE WHEN len(xs) = 0 AND raw <> '' THEN [raw] ELSE xs END AS xs FROM l),
e AS (SELECT o_orderkey, u.x, u.pl, {asks("u.x")} AS kept FROM i, (SELECT unnest(xs) AS x, generate_subscripts(xs, 1) AS pl) u),
k AS (SELECT o_orderkey, x, row_number() OVER (PARTITION BY o_orderkey ORDER BY pl) AS n FROM e WHERE kept),
h AS (SELECT o_orderkey, count(*) AS hidden FROM e WHERE NOT kept GROUP BY 1),
t AS (SELECT o_orderkey, string_agg(n || '. ' || x, chr(10) ORDER BY n) AS text FROM k GROUP BY 1)
SELECT o_orderkey, coalesce(text, '') AS text, coalesce(hidden, 0)::INTEGER AS hidden FROM orders LEFT JOIN t USING (o_orderkey) LEFT JOIN h USING (o_orderkey)
""")
def reminder_notes(spark, sf_dir):
    """Numbered notes with the lines that ask for something, numbered anew, and the number of those left out."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    listed = F.concat(F.lit("1. "), spark_pick(LINES, o), F.lit("\n  2) "), spark_pick(LINES, c), F.lit("\r\n\n10."), spark_pick(LINES, F.floor(o / 7)))
    note = F.when(o % 6 == 0, "").when(o % 6 == 1, spark_pick(LINES, c)).when(o % 6 == 2, " 1. \n2)").otherwise(listed)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(F.array(reminders.actionable_lines(note))))


ISSUES = ["Hip dysplasia", "ear itch", "obesity and joint pain", "", " ", "tick fever", "Worms", "orthopedic NSAID", "Otitis", "earache", "skin", "weight loss diet", "luxation of patellar", "analgesia", "deworming flea", "cough"]
GOODS = ["Amox INJ", "tabs 10", "Capsule x", "cough syrup", "suspension", "Injectable tablet", "cream", "", "Establish", "tablet syrup"]
MENTIONS = ["exam", "Blood  test", "[unclear] tablets", "tablet", "bravecto", "500mg", "60s", "spay", "nutrich tablet", "cough", "urine scan test", "", "visit xyz", "surgery", "K9", "shampoo", "10 ml", "Injection [UNCLEAR]"]


@query(f"""
WITH o AS (SELECT o_orderkey, {pick(ISSUES, "o_orderkey")} AS issue, {pick(GOODS, "o_orderkey")} AS good, {pick(MENTIONS, "o_orderkey")} AS mention, lower(o_orderpriority) AS pr FROM orders),
i AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 AND trim(issue) <> '' THEN trim(issue) || ' pain' ELSE trim(issue) END AS q, list_filter(string_split_regex(trim(replace(lower(trim(mention)), '[unclear]', '')), '\\s+'), lambda w: w <> '') AS ws FROM o)
SELECT o_orderkey, CASE WHEN q = '' THEN '' ELSE q || coalesce(nullif(
   CASE WHEN regexp_matches(lower(q), '\\b(hip|dysplasia|joint|arthritis|ortho\\w*|patellar|luxation|stifle|osteo\\w*)\\b') THEN ' joint pain medication supplement' ELSE '' END
   || CASE WHEN regexp_matches(lower(q), '\\b(pain|analges\\w*|nsaid)\\b') THEN ' pain medication' ELSE '' END || CASE WHEN regexp_matches(lower(q), '\\b(obes\\w*|weight|diet)\\b') THEN ' obesity diet weight management' ELSE '' END
   || CASE WHEN regexp_matches(lower(q), '\\b(tick|flea|parasit\\w*|deworm\\w*|worm)\\b') THEN ' parasite control flea tick' ELSE '' END || CASE WHEN regexp_matches(lower(q), '\\b(skin|dermat\\w*|atop\\w*|otitis|ear|itch\\w*)\\b') THEN ' dermatology medication' ELSE '' END, ''), ' medication treatment') END AS query,
 CASE WHEN contains(lower(good), 'inj') THEN 'IM' WHEN contains(lower(good), 'tab') OR contains(lower(good), 'capsule') OR contains(lower(good), 'syrup') OR contains(lower(good), 'suspension') THEN 'PO' ELSE '' END AS route,
 len(list_filter(ws, lambda w: NOT (w IN ('exam', 'blood', 'test', 'tablets', 'tablet', 'urine', 'scan', 'visit', 'surgery', 'injection')))) = 0 OR (len(ws) = 1 AND NOT (ws[1] IN ('bravecto', '500mg', '60s', 'spay', 'k9'))) AS generic
FROM i
""")
def product_words(spark, sf_dir):
    """Pharmacy queries for issues, routes from product names, and which mentions are generic."""
    o = F.col("o_orderkey")
    issue = spark_pick(ISSUES, o)
    issue = F.when((o % 5 == 0) & (F.trim(issue) != ""), F.concat(F.trim(issue), F.lit(" pain"))).otherwise(issue)
    return table(spark, sf_dir, "orders").select("o_orderkey", products.therapeutic_query(issue).alias("query"), products.route_of(spark_pick(GOODS, o)).alias("route"), products.is_generic_mention(spark_pick(MENTIONS, o)).alias("generic"))


ASKED = ["nutrich tablet", "Nutrish capsules 60s", "coatex 30 tablets", "simparica", "nutrish", "maropitant 10mg", "cortex nutrich ml", "plain", "capsule", "NUTRICH"]
PACKS = ["NUTRICH TABLET 60S", "Nutrish capsule blister 30", "Coatex tablets 30", "Simparica mg", "nutrish 160", "maropitant 10 ml", "Cortex ml", "BLISTER tablet", ""]


@query(f"""
WITH s AS (SELECT p_partkey, lower({pick(ASKED, "p_partkey")}) AS q, lower({pick(PACKS, "p_size")} || CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_size ELSE '' END) AS n FROM part),
d AS (SELECT *, CASE WHEN contains(q, 'coatex') THEN 'coatex' WHEN contains(q, 'cortex') THEN 'cortex' WHEN contains(q, 'nutrish') THEN 'nutrish' WHEN contains(q, 'nutrich') THEN 'nutrich' WHEN contains(q, 'maropitant') THEN 'maropitant' WHEN contains(q, 'simparica') THEN 'simparica' END AS brand,
  CASE WHEN contains(q, 'capsule') THEN 'capsule' WHEN contains(q, 'tablet') THEN 'tablet' WHEN contains(q, 'mg') THEN 'mg' WHEN contains(q, 'ml') THEN 'ml' END AS form, nullif(regexp_extract(q, '[0-9]+'), '') AS number FROM s)
SELECT p_partkey, round(CASE WHEN contains(n, brand) THEN 0.2 ELSE 0 END + CASE WHEN contains(n, form) THEN 0.3 ELSE 0 END + CASE WHEN contains(n, number) THEN 0.2 ELSE 0 END
  + CASE WHEN number IS NULL AND brand IN ('nutrish', 'nutrich') THEN CASE WHEN contains(n, '60') THEN 0.3 ELSE -0.1 END ELSE 0 END
  + CASE WHEN contains(q, 'capsule') AND contains(n, 'blister') THEN 0.05 ELSE 0 END + CASE WHEN contains(q, 'tablet') AND contains(n, 'tablet') THEN 0.05 ELSE 0 END, 6)::DOUBLE AS points FROM d
""")
def sku_points(spark, sf_dir):
    """Points of packs for mentions: brands, forms, numbers, default packs, blisters."""
    k = F.col("p_partkey")
    name = F.concat(spark_pick(PACKS, F.col("p_size")), F.when(k % 4 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", products.sku_points(spark_pick(ASKED, k), name).alias("points"))
