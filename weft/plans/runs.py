"""Queries on the health of pipeline runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health
from .registry import query, table

NO_SPACE = "regexp_replace({0}, '\\s+', '', 'g') = ''"
RUNS = r"""
WITH e AS (SELECT CASE WHEN l_orderkey % 997 % 6 <> 0 AND l_orderkey % 997 % 11 < 9 THEN l_orderkey % 997 ELSE -1 END AS run, CASE l_linenumber WHEN 1 THEN 'Medicine' WHEN 2 THEN 'Parasite Control' WHEN 3 THEN 'Symptom' ELSE 'Diagnostic' END AS kind, CASE WHEN l_partkey % 9 = 0 THEN 'skip_vitals' WHEN l_partkey % 9 = 1 THEN 'dual_sync_reject' END AS method, CASE WHEN l_suppkey % 5 = 0 THEN 'dual_sync' END AS route,
  l_partkey % 7 <= l_orderkey % 997 % 7 AS has_id, l_suppkey % 3 AS hints FROM lineitem),
b AS (SELECT *, coalesce(method, '') <> 'skip_vitals' AND (kind <> 'Symptom' OR route IS NOT NULL) AS billed FROM e),
g AS (SELECT run, count(*) AS manifest, count(*) FILTER (WHERE billed AND has_id) AS linked, count(*) FILTER (WHERE billed AND NOT has_id) AS need, count(*) FILTER (WHERE billed AND NOT has_id AND hints > 0) AS hints, count(*) FILTER (WHERE billed AND method = 'dual_sync_reject') AS rejects FROM b GROUP BY run),
d AS (SELECT doc_id AS run, regexp_replace(coalesce(text, ''), '[^ -~\n]', '', 'g') AS t FROM documents),
r AS (SELECT run, CASE run % 9 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(10) WHEN 2 THEN 'a few words [Unclear] here' ELSE t END AS raw, CASE run % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'strngthwrdxqz and Bcdfghjklmnpq' WHEN 2 THEN 'prescription strngthwrdxqz ???' ELSE t END AS cleaned, run % 23 = 0 AS asr, CASE run % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE run % 4 END AS brain,
  CASE run % 5 WHEN 0 THEN '' WHEN 1 THEN '1. rest 2. food' ELSE '1. rest' || chr(10) || '2. food' END AS plan, CASE WHEN run % 4 = 0 THEN ' ' ELSE 'coughing nausea Limping' END AS issues, CASE WHEN run % 3 = 0 THEN 'nausea limping' WHEN run % 3 = 1 THEN 'nausea' ELSE '' END AS findings, CASE WHEN run % 2 = 0 THEN '' ELSE 'x' END AS advice, CASE WHEN run % 10 < 8 THEN 's' ELSE '' END AS said,
  run % 29 = 0 AS p2, run % 13 = 0 AS odd, run % 6 AS atoms, run % 5 AS rows, least(run % 5, run % 3) AS row_hints, run % 2 AS bound FROM d),
j AS (SELECT r.*, coalesce(manifest, 0) AS manifest, coalesce(linked, 0) AS linked, coalesce(need, 0) AS need, coalesce(hints, 0) AS hints, coalesce(rejects, 0) AS rejects, len(list_filter(string_split_regex(raw, '\s+'), lambda w: w <> '')) AS words, rows > 0 OR bound > 0 OR run % 7 < 3 AS dash,
  len(list_filter(list_distinct(regexp_extract_all(cleaned, '(?i)\b[a-z]{12,}\b')), lambda w: lower(w) NOT IN ('approximately', 'prescription') AND length(regexp_replace(lower(w), '[^aeiou]', '', 'g')) <= greatest(1, length(w) // 5))) AS suspects FROM r LEFT JOIN g USING (run)),
k AS (SELECT *, linked + need AS bill, need / greatest(linked + need, 1) AS ratio, hints >= greatest(1, need // 2) AS enough, row_hints >= greatest(1, rows // 2) AS row_enough, plan || said = '' AS nothing, run % 3 = 0 AND run % 4 <> 0 AS mixed FROM j),
s AS (SELECT *, regexp_matches(raw, '\[Unclear\]') OR regexp_matches(cleaned, '\?\?\?') AS unclear, manifest = 0 AND (raw <> '' OR cleaned <> '') AND coalesce(brain, 0) > 0 AS skipped, manifest = 0 AND (raw <> '' OR cleaned <> '') AND coalesce(brain, 0) = 0 AS unlisted, bill > 0 AND ratio >= 0.6 AND linked = 0 AS high, bill > 0 AND ratio >= 0.35 AND NOT (ratio >= 0.6 AND linked = 0) AS part FROM k),
v AS (SELECT *, CASE WHEN asr OR words = 0 THEN 'failing' WHEN words < 25 OR unclear OR suspects >= 2 THEN 'degraded' ELSE 'ok' END AS s1, CASE WHEN brain = 0 THEN 'degraded' WHEN raw <> '' AND trim(cleaned) = '' THEN 'failing' ELSE 'ok' END AS s2, CASE WHEN skipped THEN 'failing' WHEN unlisted OR high OR part AND NOT enough THEN 'degraded' ELSE 'ok' END AS s3,
  CASE WHEN mixed THEN 'degraded' WHEN nothing THEN 'failing' WHEN plan = '' OR trim(issues) = '' OR findings = '' OR advice = '' THEN 'degraded' ELSE 'ok' END AS s4 FROM s),
w AS (SELECT *, CASE WHEN atoms = 0 AND s4 <> 'failing' AND s3 = 'failing' THEN 'degraded' WHEN rows > 0 AND bound > 0 AND row_hints = 0 AND rows >= 3 OR rows > 0 AND bound = 0 AND NOT row_enough THEN 'degraded' WHEN odd THEN 'degraded' WHEN p2 THEN 'failing' ELSE 'ok' END AS s5 FROM v),
f AS (SELECT *, list_filter([
  CASE WHEN words > 0 AND words < 25 THEN 'w:SHORT_TRANSCRIPT' END, CASE WHEN words = 0 THEN 'e:EMPTY_TRANSCRIPT' END, CASE WHEN unclear THEN 'w:UNCLEAR_AUDIO_MARKERS' END, CASE WHEN suspects >= 2 THEN 'w:SUSPECT_ASR_TOKENS' END, CASE WHEN asr THEN 'e:ASR_ERROR' END,
  CASE WHEN raw <> '' AND trim(cleaned) = '' THEN 'e:CLEANING_FAILED' END, CASE WHEN brain = 0 THEN 'w:NO_NER_ENTITIES' END,
  CASE WHEN bill = 0 AND manifest > 0 THEN 'i:NO_BILLABLE_ENTITIES' END, CASE WHEN linked > 0 THEN 'i:RAG_LINKS_OK' END, CASE WHEN high THEN 'w:HIGH_UNLINKED_RATE' END, CASE WHEN part THEN CASE WHEN enough THEN 'i' ELSE 'w' END || ':PARTIAL_UNLINKED' END, CASE WHEN bill > 0 AND rejects > 0 THEN 'i:DUAL_SYNC_REJECTS' END, CASE WHEN skipped THEN 'e:GROUNDING_PIPELINE_SKIPPED' END, CASE WHEN unlisted THEN 'w:EMPTY_MANIFEST' END,
  CASE WHEN plan = '' THEN 'w:EMPTY_PLAN' END, CASE WHEN trim(issues) = '' THEN 'w:EMPTY_KEYISSUES' END, CASE WHEN findings = '' THEN 'w:EMPTY_ABNORMALFINDINGS' END, CASE WHEN advice = '' THEN 'w:EMPTY_CUSTOMERINSTRUCTIONS' END, CASE WHEN run % 5 = 1 THEN 'i:PLAN_INLINE_NUMBERING' END, CASE WHEN nothing THEN 'e:SOAP_INCOMPLETE' END, CASE WHEN mixed THEN 'w:KEY_ISSUES_ABNORMAL_OVERLAP' END,
  CASE WHEN p2 THEN 'e:PHASE2_ERROR' END, CASE WHEN odd THEN 'w:INTENT_NOT_RECOGNISED' END, CASE WHEN rows > 0 AND bound > 0 THEN 'i:PHASE2_DASHBOARD_PARTIAL' END, CASE WHEN rows > 0 AND bound = 0 THEN CASE WHEN row_enough THEN 'i' ELSE 'w' END || ':BILLING_ACTION_REQUIRED' END, CASE WHEN atoms > 0 THEN 'i:PHASE2_ATOMS_OK' END,
  CASE WHEN atoms = 0 AND s4 <> 'failing' AND s3 = 'failing' THEN 'w:PHASE2_SKIPPED_NO_MANIFEST' END, CASE WHEN atoms = 0 AND s4 <> 'failing' AND s3 <> 'failing' AND NOT dash THEN 'i:PHASE2_NO_ATOMS_YET' END], lambda x: x IS NOT NULL) AS codes FROM w),
o AS (SELECT *, CASE WHEN 'failing' IN (s1, s2, s3, s4, s5) OR len(list_filter(codes, lambda x: x[1] = 'e')) > 0 THEN 'failing' WHEN 'degraded' IN (s1, s2, s3, s4, s5) OR len(list_filter(codes, lambda x: x[1] = 'w')) > 0 THEN 'degraded' ELSE 'healthy' END AS overall FROM f)
SELECT run, overall, array_to_string(codes || CASE WHEN overall = 'healthy' THEN ['i:WORKFLOW_HEALTHY'] ELSE [] END, ',') AS codes, concat_ws(',', s1, s2, s3, s4, s5) AS stages FROM o
"""


@query(RUNS)
def run_health(spark, sf_dir):
    """Documents as runs, line items as their entities; every code and every state of a stage comes up."""
    run, line = F.col("run"), F.col("l_orderkey") % 997
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    entities = table(spark, sf_dir, "lineitem").select(
        F.when((line % 6 != 0) & (line % 11 < 9), line).otherwise(-1).alias("run"), F.when(n == 1, "Medicine").when(n == 2, "Parasite Control").when(n == 3, "Symptom").otherwise("Diagnostic").alias("kind"), F.when(p % 9 == 0, "skip_vitals").when(p % 9 == 1, "dual_sync_reject").alias("method"),
        F.when(F.col("l_suppkey") % 5 == 0, "dual_sync").alias("route"), F.when(p % 7 <= line % 7, p).alias("stock_id"), F.lit(None).cast("long").alias("service_id"), (F.col("l_suppkey") % 3).alias("n_suggestions"), F.lit(None).cast("boolean").alias("was_rejected"),
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[^ -~\n]", "").alias("t"))
    raw = F.when(run % 9 == 0, "").when(run % 9 == 1, " \n").when(run % 9 == 2, "a few words [Unclear] here").otherwise(F.col("t"))
    cleaned = F.when(run % 7 == 0, " ").when(run % 7 == 1, "strngthwrdxqz and Bcdfghjklmnpq").when(run % 7 == 2, "prescription strngthwrdxqz ???").otherwise(F.col("t"))
    plan = F.when(run % 5 == 0, "").when(run % 5 == 1, "1. rest 2. food").otherwise("1. rest\n2. food")
    findings = F.when(run % 3 == 0, "nausea limping").when(run % 3 == 1, "nausea").otherwise("")
    sections = {"Plan": plan, "KeyIssues": F.when(run % 4 == 0, " ").otherwise("coughing nausea Limping"), "AbnormalFindings": findings, "CustomerInstructions": F.when(run % 2 == 0, "").otherwise("x"), "Subjective": F.when(run % 10 < 8, "s").otherwise("")}
    counts = health.grounding_counts(entities)
    rows = docs.join(counts, "run", "left").fillna(0, counts.columns[1:]).select(
        "run", raw.alias("raw"), cleaned.alias("cleaned"), F.when(run % 23 == 0, "x").alias("asr_error"), F.when(run % 5 == 0, None).when(run % 5 == 1, 0).otherwise(run % 4).alias("brain_entities"), *counts.columns[1:],
        F.create_map(*(x for k, v in sections.items() for x in (F.lit(k), v))).alias("soap"), F.when(run % 29 == 0, "x").alias("phase2_error"), (run % 13 == 0).cast("int").alias("unrecognised_intents"), (run % 6).alias("atoms"),
        (run % 5).alias("unlinked_rows"), F.least(run % 5, run % 3).alias("unlinked_with_suggestions"), (run % 2).alias("linked_rows"), ((run % 5 > 0) | (run % 2 > 0) | (run % 7 < 3)).alias("has_dashboard"),
    )
    out = health.health(rows)
    codes = F.array_join(F.transform("flags", lambda f: F.concat(F.substring(f["severity"], 1, 1), F.lit(":"), f["code"])), ",")
    return out.select("run", "overall", codes.alias("codes"), F.concat_ws(",", *(F.try_element_at("stages", F.lit(s)) for s in health.STAGES)).alias("stages"))
