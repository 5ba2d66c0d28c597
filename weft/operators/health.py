"""Health of a pipeline run: flags of its stages, the state of each stage, and an overall verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ["STEP1", "STEP2", "GROUNDING", "STEP3", "PHASE2"]
# Marks of unclear speech, long words that are none, and sections that a note must have.
UNCLEAR = r"(?i)\[(?:unclear|inaudible|unintelligible)\]|\b(?:inaudible|unintelligible)\b|\?\?\?"
LONG_TOKEN = r"(?i)\b([a-z]{10,})\b"
REAL_WORDS = ["approximately", "prescription", "vaccination", "temperature"]
WANTED_SECTIONS = ["Plan", "KeyIssues", "AbnormalFindings", "CustomerInstructions"]
CORE_SECTIONS = ["Subjective", "Objective", "Assessment", "Plan"]
INLINE_NUMBERS = r"\d+\.\s+\S.+\d+\.\s+"
# Kinds that are billed, methods that bind nothing on purpose, methods of a rejection, and the route that is always billed.
BILLED_KINDS = ["medicine", "medication", "drug", "product", "vaccine", "procedure", "diagnostic", "service", "nutrition", "preventive", "parasitecontrol"]
NOTE_METHODS = ["non_billable_preserved", "vital_sign_structured", "note_only_below_threshold", "skip_signalment", "skip_identity", "skip_vitals"]
REJECTIONS = ["dual_sync_reject", "dual_sync_judge_rejected"]
BILLED_ROUTE = "dual_sync"
SHORT_WORDS, MOSTLY, PARTLY = 25, 0.6, 0.35


@dataclass(frozen=True)
class Rule:
    """A flag, when it holds, and what becomes of its stage; ``gentle`` leaves a stage that is not ok as it is."""

    stage: str
    severity: str | Column
    code: str
    holds: Column
    effect: str | Column | None = None
    gentle: bool = False


def grounding_counts(entities: DataFrame) -> DataFrame:
    """(run, manifest, linked, need_sku, with_suggestions, rejects) of the entities (run, kind, method, route, stock_id, service_id, n_suggestions, was_rejected) of each run."""
    kind = F.replace(F.lower(F.coalesce("kind", F.lit(""))), F.lit(" "), F.lit(""))
    method = F.coalesce("method", F.lit(""))
    billed = ~method.isin(NOTE_METHODS) & (kind.isin(BILLED_KINDS) | (F.coalesce("route", F.lit("")) == BILLED_ROUTE))
    has_id = F.coalesce("stock_id", "service_id").isNotNull()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return entities.groupBy("run").agg(
        F.count("*").alias("manifest"), count(billed & has_id).alias("linked"), count(billed & ~has_id).alias("need_sku"), count(billed & ~has_id & (F.col("n_suggestions") > 0)).alias("with_suggestions"),
        count(billed & (method.isin(REJECTIONS) | F.coalesce("was_rejected", F.lit(False)))).alias("rejects"),
    )


def suspect_tokens(c: Column) -> Column:
    """Distinct words of twelve letters or more with hardly a vowel."""
    tokens = F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(LONG_TOKEN), F.lit(1)))
    vowels = lambda t: F.length(F.regexp_replace(F.lower(t), "[^aeiou]", ""))
    return F.filter(tokens, lambda t: ~F.lower(t).isin(REAL_WORDS) & (F.length(t) >= 12) & (vowels(t) <= F.greatest(F.lit(1), F.floor(F.length(t) / 5))))


def rules(stage_state: dict[str, Column]) -> list[Rule]:
    """The rules over a run's columns; those of PHASE2 ask for the state of earlier stages."""
    c, text = F.col, lambda x: F.coalesce(x, F.lit(""))
    raw, cleaned, brain, manifest = text(c("raw")), text(c("cleaned")), c("brain_entities"), c("manifest")
    blank = lambda x: F.regexp_replace(x, r"\s+", "") == ""
    words = F.size(F.filter(F.split(raw, r"\s+"), lambda w: w != ""))
    need, linked, hints = c("need_sku"), c("linked"), c("with_suggestions")
    billable, ratio = linked + need, need / F.greatest(linked + need, F.lit(1))
    enough = hints >= F.greatest(F.lit(1), F.floor(need / 2))
    high, partial = (billable > 0) & (ratio >= MOSTLY) & (linked == 0), (billable > 0) & (ratio >= PARTLY)
    none_listed, has_text = manifest == 0, (raw != "") | (cleaned != "")
    section = lambda k: text(F.try_element_at("soap", F.lit(k)))
    plan = section("Plan")
    tokens = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z]{4,})"), F.lit(1)))
    shared = F.size(F.array_intersect(tokens(section("KeyIssues")), tokens(section("AbnormalFindings"))))
    rows, row_hints, bound_rows, atoms = c("unlinked_rows"), c("unlinked_with_suggestions"), c("linked_rows"), c("atoms")
    row_enough = row_hints >= F.greatest(F.lit(1), F.floor(rows / 2))
    found = [
        Rule("STEP1", "warning", "SHORT_TRANSCRIPT", (words > 0) & (words < SHORT_WORDS), "degraded"),
        Rule("STEP1", "error", "EMPTY_TRANSCRIPT", words == 0, "failing"),
        Rule("STEP1", "warning", "UNCLEAR_AUDIO_MARKERS", raw.rlike(UNCLEAR) | cleaned.rlike(UNCLEAR), "degraded", gentle=True),
        Rule("STEP1", "warning", "SUSPECT_ASR_TOKENS", F.size(suspect_tokens(cleaned)) >= 2, "degraded", gentle=True),
        Rule("STEP1", "error", "ASR_ERROR", text(c("asr_error")) != "", "failing"),
        Rule("STEP2", "error", "CLEANING_FAILED", (raw != "") & blank(cleaned), "failing"),
        Rule("STEP2", "warning", "NO_NER_ENTITIES", brain == 0, "degraded"),
        Rule("GROUNDING", "info", "NO_BILLABLE_ENTITIES", (billable == 0) & ~none_listed),
        Rule("GROUNDING", "info", "RAG_LINKS_OK", linked > 0),
        Rule("GROUNDING", "warning", "HIGH_UNLINKED_RATE", high, "degraded"),
        Rule("GROUNDING", F.when(enough, "info").otherwise("warning"), "PARTIAL_UNLINKED", partial & ~high, F.when(~enough, "degraded")),
        Rule("GROUNDING", "info", "DUAL_SYNC_REJECTS", (billable > 0) & (c("rejects") > 0)),
        Rule("GROUNDING", "error", "GROUNDING_PIPELINE_SKIPPED", none_listed & has_text & (F.coalesce(brain, F.lit(0)) > 0), "failing"),
        Rule("GROUNDING", "warning", "EMPTY_MANIFEST", none_listed & has_text & (F.coalesce(brain, F.lit(0)) == 0), "degraded"),
        *(Rule("STEP3", "warning", f"EMPTY_{k.upper()}", blank(section(k)), "degraded") for k in WANTED_SECTIONS),
        Rule("STEP3", "info", "PLAN_INLINE_NUMBERING", ~F.contains(plan, F.lit("\n")) & plan.rlike(INLINE_NUMBERS)),
        Rule("STEP3", "error", "SOAP_INCOMPLETE", F.concat(*(section(k) for k in CORE_SECTIONS)) == "", "failing"),
        Rule("STEP3", "warning", "KEY_ISSUES_ABNORMAL_OVERLAP", shared >= 2, "degraded"),
        Rule("PHASE2", "error", "PHASE2_ERROR", text(c("phase2_error")) != "", "failing"),
        Rule("PHASE2", "warning", "INTENT_NOT_RECOGNISED", c("unrecognised_intents") > 0, "degraded"),
        Rule("PHASE2", "info", "PHASE2_DASHBOARD_PARTIAL", (rows > 0) & (bound_rows > 0), F.when((row_hints == 0) & (rows >= 3), "degraded")),
        Rule("PHASE2", F.when(row_enough, "info").otherwise("warning"), "BILLING_ACTION_REQUIRED", (rows > 0) & (bound_rows == 0), F.when(~row_enough, "degraded")),
        Rule("PHASE2", "info", "PHASE2_ATOMS_OK", atoms > 0),
    ]
    if stage_state:
        waiting = (atoms == 0) & (stage_state["STEP3"] != "failing")
        found += [
            Rule("PHASE2", "warning", "PHASE2_SKIPPED_NO_MANIFEST", waiting & (stage_state["GROUNDING"] == "failing"), "degraded"),
            Rule("PHASE2", "info", "PHASE2_NO_ATOMS_YET", waiting & (stage_state["GROUNDING"] != "failing") & ~c("has_dashboard")),
        ]
    return found


def state_of(found: list[Rule], stage: str) -> Column:
    """The state that the last of a stage's rules leaves it in; a gentle one only touches a stage that is ok."""
    state = F.lit("ok")
    for r in (r for r in found if r.stage == stage and r.effect is not None):
        new = F.lit(r.effect) if isinstance(r.effect, str) else r.effect
        applies = F.coalesce(r.holds, F.lit(False)) & new.isNotNull()
        state = F.when(applies & (state == "ok") if r.gentle else applies, new).otherwise(state)
    return state


def health(runs: DataFrame) -> DataFrame:
    """(run, overall, flags, stages) of each run.

    ``runs``: run, raw, cleaned, asr_error, brain_entities (null where none was written), the counts of
    ``grounding_counts``, soap (map of sections), phase2_error, unrecognised_intents, atoms, unlinked_rows,
    unlinked_with_suggestions, linked_rows, has_dashboard.  ``flags`` are struct<step, severity, code> in the order of the rules.
    """
    early = rules({})
    known = runs.withColumns({f"_{s}": state_of(early, s) for s in ("STEP3", "GROUNDING")})
    whole = rules({s: F.col(f"_{s}") for s in ("STEP3", "GROUNDING")})
    made = F.array_compact(F.array(*(F.when(F.coalesce(r.holds, F.lit(False)), F.struct(F.lit(r.stage).alias("step"), (F.lit(r.severity) if isinstance(r.severity, str) else r.severity).alias("severity"), F.lit(r.code).alias("code"))) for r in whole)))
    stages = F.create_map(*(x for s in STAGES for x in (F.lit(s), state_of(whole, s))))
    out = known.select("run", made.alias("flags"), stages.alias("stages"))
    any_of = lambda severity, state: F.exists("flags", lambda f: f["severity"] == severity) | F.exists(F.map_values("stages"), lambda s: s == state)
    overall = F.when(any_of("error", "failing"), "failing").when(any_of("warning", "degraded"), "degraded").otherwise("healthy")
    fine = F.array(F.struct(F.lit("SYSTEM").alias("step"), F.lit("info").alias("severity"), F.lit("WORKFLOW_HEALTHY").alias("code")))
    return out.withColumn("overall", overall).withColumn("flags", F.when(F.col("overall") == "healthy", F.concat("flags", fine)).otherwise(F.col("flags")))
