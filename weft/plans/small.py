"""Queries that read artifacts, cut windows around mentions and sort out what is left over."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notes, text
from ..operators import chunking, ranking, routing
from ..sources import files
from .records import pick, spark_pick
from .registry import query, table


@query("""
WITH c AS (SELECT conv_id, turn, text, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations),
m AS (SELECT *, CASE WHEN len(w) > 0 THEN w[1 + turn * 3 % len(w)] END AS mention FROM c),
p AS (SELECT *, list_position(list_transform(w, lambda x: lower(x)), lower(mention)) AS at_word, list_position(list_transform(l, lambda x: contains(lower(x), lower(mention))), true) AS at_line FROM m)
SELECT conv_id, turn, sha256(CASE WHEN at_word > 0 THEN substr(array_to_string(w[greatest(at_word - 20, 1):at_word + 20], ' '), 1, 500) ELSE '' END) AS words, sha256(CASE WHEN at_line > 0 THEN array_to_string(l[greatest(at_line - 2, 1):at_line + 2], chr(10)) ELSE '' END) AS lines FROM p
""")
def mention_windows(spark, sf_dir):
    """Twenty words and two lines on both sides of a word of each turn."""
    c = table(spark, sf_dir, "conversations")
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    c = c.withColumn("mention", F.get(w, F.try_mod(F.col("turn") * 3, F.size(w)).cast("int")))
    return c.select("conv_id", "turn", F.sha2(chunking.token_window(F.col("text"), F.col("mention")), 256).alias("words"), F.sha2(chunking.line_window(F.col("text"), F.col("mention")), 256).alias("lines"))


KINDS = ["Procedure", "service", "Diagnostic", "LabTest", "Diagnosis", "ReasonForVisit", "Drug", "medication"]
INTENTS = ["Administered", "", "Prescribed", "administered", "Recommended"]
SIGNS = ["Temp 39", "pulse high", "t 101", "T102 today", "weighty words", "Body weight", "bcs 5", "template", "crt", "heart rate"]


@query(f"""
WITH o AS (SELECT o_orderkey AS k, {pick(KINDS, "o_orderkey")} AS kind, {pick(INTENTS, "o_custkey")} AS intent, {pick(SIGNS, "o_orderkey // 3")} AS sign, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 101 / 100.0 END AS best FROM orders)
SELECT k, CASE WHEN lower(kind) IN ('procedure', 'service') THEN 'services' WHEN lower(kind) IN ('diagnostic', 'labtest') THEN 'diagnostics' WHEN lower(intent) = 'administered' THEN 'administered' ELSE 'prescribed' END AS list,
 kind IN ('Diagnosis', 'ReasonForVisit') AND coalesce(best, 0) < 0.95 AS noted, regexp_matches(lower(sign), '\\b(temperature|temp|pulse|heart rate|respiratory rate|blood pressure|weight|bcs|crt)\\b|\\bt *[0-9][0-9][0-9]?\\b') AS vital FROM o
""")
def work_lists(spark, sf_dir):
    """The work list of each unlinked row, which rows are only noted, and which spans are vital signs."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(o.alias("k"), spark_pick(KINDS, o).alias("kind"), spark_pick(INTENTS, c).alias("intent"), spark_pick(SIGNS, F.floor(o / 3)).alias("sign"), F.when(o % 4 != 0, c % 101 / 100).alias("best"))
    return routing.split_unlinked(rows, "kind", F.col("intent")).select("k", "list", ranking.note_only(F.col("kind"), F.col("best")).alias("noted"), routing.is_vital(F.col("sign")).alias("vital"))


@query("""
WITH p AS (SELECT p_partkey AS k, lower(p_name) AS n, lower(p_brand) AS b, lower(p_type) AS t, p_size % 3 AS z FROM part),
x AS (SELECT k, [n, CASE WHEN regexp_matches(n, ' (widget|gear|bolt)$') THEN regexp_replace(n, ' (widget|gear|bolt)$', '') END, regexp_replace(regexp_replace(n, ' (widget|gear|bolt)$', ''), '\\bred\\b', 'crimson'), CASE WHEN z = 0 THEN b END, CASE WHEN z = 1 THEN t ELSE 'second hint' END, CASE WHEN z = 1 THEN 'second hint' ELSE t END, n || ' third'] AS l FROM p),
u AS (SELECT k, w, min(i) AS i FROM (SELECT k, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM x) WHERE w IS NOT NULL AND w <> '' GROUP BY k, w)
SELECT k, string_agg(w, '|' ORDER BY i) AS terms FROM u GROUP BY k
""")
def hinted_terms(spark, sf_dir):
    """Search terms of a name, an explicit term and the likeliest hints, each once, in order."""
    z = F.col("p_size") % 3
    base = text.search_terms(F.col("p_name"), ["widget", "gear", "bolt"], {"red": "crimson"})
    hint = lambda p, h: F.struct(p.cast("double").alias("p"), h.alias("hint"))
    hints = F.array(hint(F.lit(0.1), F.concat("p_name", F.lit(" third"))), hint(F.when(z == 1, 0.9).otherwise(0.4), F.col("p_type")), hint(F.lit(0.5), F.lit(" Second  hint ")))
    terms = text.terms_with_hints(base, F.when(z == 0, F.col("p_brand")), hints)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(terms, "|").alias("terms"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders),
l AS (SELECT k, [lower(p) || ' alpha beta gamma', 'second ' || s, CASE WHEN k % 2 = 0 THEN 'delta epsilon zeta' END] AS items FROM o)
SELECT k, array_to_string(list_transform(range(1, len(list_filter(items, lambda x: x IS NOT NULL)) + 1), lambda i: i || '. ' || list_filter(items, lambda x: x IS NOT NULL)[i]), chr(10)) AS merged FROM l
""")
def merged_reminders(spark, sf_dir):
    """Three fields of reminders in one numbered list; a line that repeats another in other words' order is dropped."""
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    first = F.concat(F.lit("1. "), F.lower("o_orderpriority"), F.lit(" alpha beta gamma\n2. second "), F.col("o_orderstatus"))
    again = F.concat(F.lower("o_orderpriority"), F.lit(" alpha beta gamma"))
    return rows.select(o.alias("k"), notes.merged_reminders(first, F.when(o % 3 == 0, again), F.when(o % 2 == 0, "delta epsilon zeta")).alias("merged"))


@query("""
SELECT c_nationkey AS nation, count(*) AS customers, CASE WHEN c_nationkey % 2 = 1 THEN count(DISTINCT c_mktsegment) ELSE -1 END AS segments, sum(length(c_name))::BIGINT AS chars, true AS absent FROM customer GROUP BY c_nationkey
""")
def manifest_files(spark, sf_dir):
    """A JSON manifest and a note for each nation's customers, with missing and surplus fields, written one a file and read again."""
    path = files.scratch(spark, "manifests")
    told = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_distinct("c_mktsegment").alias("s"), F.sum(F.length("c_name")).alias("chars"))
    body = F.to_json(F.struct(F.col("c_nationkey").alias("nation"), F.col("n").alias("customers"), F.when(F.col("c_nationkey") % 2 == 1, F.col("s")).alias("segments"), F.lit("x").alias("surplus")))
    note = F.concat_ws("\n", F.lit("characters of nation"), F.col("c_nationkey").cast("string"), F.col("chars").cast("string"))
    for kind, value in (("json", body), ("text", note)):
        told.select(value.alias("value"), F.col("c_nationkey").alias("folder")).write.partitionBy("folder").text(f"{path}/{kind}")
    manifests = files.read_json(spark, f"{path}/json/*", "nation long, customers long, segments long, absent string")
    notes_ = files.read_texts(spark, f"{path}/text/*").select(F.split("value", "\n").alias("x")).select(F.get("x", F.lit(1)).cast("long").alias("nation"), F.get("x", F.lit(2)).cast("long").alias("chars"))
    return manifests.join(notes_, "nation").select("nation", "customers", F.coalesce("segments", F.lit(-1)).alias("segments"), "chars", F.col("absent").isNull().alias("absent"))
