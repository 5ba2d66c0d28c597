"""Evaluation and data-quality: error rates, precision and recall, gates, flags, timings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text


def alignment(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int]:
    """(hits, substitutions, deletions, insertions) of a cheapest alignment."""
    n, m = len(ref), len(hyp)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0], cost[0] = np.arange(n + 1), np.arange(m + 1)
    h = np.array(hyp, dtype=object)
    ramp = np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (h != ref[i - 1]) if m else cost[i - 1, :-1])
        row = np.concatenate([[i], best])
        cost[i] = np.minimum.accumulate(row - ramp) + ramp
    i, j, hits, sub, dele, ins = n, m, 0, 0, 0, 0
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]):
            same = ref[i - 1] == hyp[j - 1]
            hits, sub, i, j = hits + same, sub + (not same), i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            dele, i = dele + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return hits, sub, dele, ins


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("hits", "substitutions", "deletions", "insertions")]))
def word_alignment(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([alignment((a or "").split(), (b or "").split()) for a, b in zip(ref, hyp)], columns=["hits", "substitutions", "deletions", "insertions"])


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate; null for an empty reference."""
    return F.when(F.length(ref) > 0, F.levenshtein(ref, F.coalesce(hyp, F.lit(""))) / F.length(ref))


def error_rates(pairs: DataFrame) -> DataFrame:
    """``pairs`` (slug, ref, hyp) with counts, wer and cer; rates are null for an empty reference."""
    out = pairs.withColumn("a", word_alignment("ref", "hyp"))
    words = F.col("a.hits") + F.col("a.substitutions") + F.col("a.deletions")
    wer = F.when(words > 0, (F.col("a.substitutions") + F.col("a.deletions") + F.col("a.insertions")) / words)
    return out.select("slug", "a.*", wer.alias("wer"), cer(F.col("ref"), F.col("hyp")).alias("cer"))


def entity_scores(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, tp, precision, recall, f1): a gold name counts if a found name contains it or lies in it.

    True positives are distinct matched gold names; recall divides by all gold rows, precision by all found rows.
    """
    met = gold.join(found.withColumnRenamed("name", "found"), key).where(text.contains_either_way(F.col("name"), F.col("found")))
    tp = met.groupBy(key).agg(F.countDistinct("name").alias("tp"))
    n_gold, n_found = gold.groupBy(key).agg(F.count(F.lit(1)).alias("n_gold")), found.groupBy(key).agg(F.count(F.lit(1)).alias("n_found"))
    all_ = n_gold.join(n_found, key, "left").join(tp, key, "left").fillna(0, ["tp", "n_found"])
    p, r = F.when(F.col("n_found") > 0, F.col("tp") / F.col("n_found")).otherwise(0.0), F.col("tp") / F.col("n_gold")
    return all_.select(key, "tp", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def fact_recall(facts: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """(key, found, total, recall): facts that the normalised note contains."""
    norm = lambda c: text.benchmark_text(c)
    met = facts.join(notes.select(key, norm(F.col("note")).alias("note")), key, "left").withColumn("hit", F.coalesce(F.contains(F.col("note"), norm(F.col("fact"))), F.lit(False)))
    return met.groupBy(key).agg(F.count_if("hit").alias("found"), F.count(F.lit(1)).alias("total")).withColumn("recall", F.col("found") / F.col("total"))


def gate(current: DataFrame, baseline: DataFrame, lower_is_better: list[str], tolerance: float = 0.0) -> DataFrame:
    """(metric, current, baseline, passed): metrics must not get worse; missing ones pass."""
    both = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "full")
    worse = F.when(F.col("metric").isin(lower_is_better), F.col("current") > F.col("baseline") + tolerance).otherwise(F.col("current") < F.col("baseline") - tolerance)
    return both.withColumn("passed", ~F.coalesce(worse, F.lit(False)))


def flags(rules: list[tuple[str, str, str, Column]]) -> Column:
    """array<struct<step, severity, code>> of the rules (step, severity, code, condition) that hold."""
    made = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(step).alias("step"), F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for step, severity, code, c in rules))
    return F.filter(made, lambda x: x.isNotNull())


def overall(flag_list: Column) -> Column:
    bad = lambda s: F.exists(flag_list, lambda x: x["severity"] == s)
    return F.when(bad("error"), "failing").when(bad("warning"), "degraded").otherwise("healthy")


def transcript_flags(c: Column) -> Column:
    n = F.size(text.words(c))
    return flags(
        [
            ("transcription", "error", "EMPTY_TRANSCRIPT", text.blank_to_null(c).isNull()),
            ("transcription", "warning", "SHORT_TRANSCRIPT", text.blank_to_null(c).isNotNull() & (n < 25)),
            ("transcription", "warning", "UNCLEAR_AUDIO_MARKERS", c.rlike(r"(?i)\[(?:unclear|inaudible)\]")),
            ("transcription", "warning", "SUSPECT_ASR_TOKENS", F.size(text.garbled_tokens(c)) >= 2),
        ]
    )


def link_flags(linked: Column, unlinked: Column) -> Column:
    ratio = unlinked / F.greatest(linked + unlinked, F.lit(1))
    return flags(
        [
            ("grounding", "warning", "HIGH_UNLINKED_RATE", (ratio >= 0.6) & (linked == 0)),
            ("grounding", "warning", "PARTIAL_UNLINKED", (ratio >= 0.35) & ((ratio < 0.6) | (linked > 0))),
        ]
    )


def critical_path(step1: Column, step2: Column, soap: Column, billing: Column, phase2: Column) -> Column:
    """Stages one after the other, note and billing side by side; missing stages take no time."""
    z = lambda c: F.coalesce(c, F.lit(0))
    return z(step1) + z(step2) + F.greatest(z(soap), z(billing)) + z(phase2)


def stage_summary(reports: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, n, mean, p50, max) over wide reports, nulls left out."""
    long = reports.unpivot([], stages, "stage", "ms").where("ms is not null")
    return long.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean"), F.median("ms").alias("p50"), F.max("ms").alias("max"))
