"""De-duplication and linking of entities, atoms and manifests.

Steps that depend on order fold each document's rows in one function with an explicit
total order; everything keyed is a grouped aggregate or a ranked union of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.files import stored
from . import edits
from .relational import best_per_key

SECTION_RANK = ["Plan", "Assessment", "Subjective", "Objective"]
# The meta kind of an atom's kind; other kinds stand for themselves.
META_KINDS = {
    "medicine": "PHARMACOLOGICAL", "drug": "PHARMACOLOGICAL", "medication": "PHARMACOLOGICAL", "substance": "PHARMACOLOGICAL", "supplement": "PHARMACOLOGICAL",
    "nutrition": "PHARMACOLOGICAL", "vaccine": "PHARMACOLOGICAL", "preventive": "PHARMACOLOGICAL", "parasitecontrol": "PHARMACOLOGICAL",
    "diagnostic": "DIAGNOSTIC", "labtest": "DIAGNOSTIC", "diagnostictest": "DIAGNOSTIC", "imaging": "DIAGNOSTIC",
    "procedure": "INTERVENTIONAL", "service": "INTERVENTIONAL", "treatment": "INTERVENTIONAL",
    "vitalsign": "VITAL", "vital": "VITAL",
    "reminder": "REMINDER", "followup": "REMINDER", "follow-up": "REMINDER",
    "reasonforvisit": "RFV", "reason": "RFV",
}
# Which kinds of manifest rows an atom's kind may be linked to, besides its own.
FITTING = {
    "drug": ["drug", "medicine", "medication", "substance", "supplement", "vaccine", "preventive", "parasitecontrol", "nutrition"],
    "medicine": ["drug", "medicine", "medication", "substance", "supplement", "vaccine", "preventive", "parasitecontrol", "nutrition"],
    "medication": ["drug", "medicine", "medication", "substance", "supplement", "vaccine", "preventive", "parasitecontrol", "nutrition"],
    "substance": ["drug", "medicine", "medication", "substance", "supplement", "vaccine", "preventive", "parasitecontrol", "nutrition"],
    "supplement": ["drug", "medicine", "medication", "substance", "supplement", "vaccine", "preventive", "parasitecontrol", "nutrition"],
    "vaccine": ["drug", "medicine", "medication", "substance", "supplement", "vaccine", "preventive", "parasitecontrol"],
    "preventive": ["drug", "medicine", "medication", "substance", "supplement", "vaccine", "preventive", "parasitecontrol"],
    "parasitecontrol": ["drug", "medicine", "medication", "substance", "supplement", "vaccine", "preventive", "parasitecontrol"],
    "nutrition": ["drug", "medicine", "medication", "substance", "supplement", "nutrition"],
    "procedure": ["procedure", "service", "treatment", "diagnostic"],
    "service": ["procedure", "service", "treatment", "diagnostic"],
    "treatment": ["procedure", "service", "treatment", "diagnostic"],
    "diagnostic": ["diagnostic", "labtest", "diagnostictest", "procedure", "service"],
    "labtest": ["diagnostic", "labtest", "diagnostictest", "procedure", "service"],
    "diagnostictest": ["diagnostic", "labtest", "diagnostictest", "procedure", "service"],
}
# Words that tell no product apart, and words for its form.
UNTELLING = ["the", "and", "for", "with", "from", "ear", "eye", "drops", "tablet", "capsule", "syrup", "injection", "mg", "ml", "tab", "caps"]
FORMS = ["capsule", "capsules", "tablet", "tablets", "tab", "tabs", "syrup", "inj", "injection", "drops"]


def atom_text(c: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    return text.squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\w\s]", " "))


def meta_kind(kind: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in META_KINDS.items() for x in pair)), k), F.when(k != "", k), F.lit("OTHER"))


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one key as one: the first best atom, the first ids, what the sources are and since which atom."""
    return rows.groupBy(*keys).agg(F.min("best").alias("best"), *(F.min(c).alias(c) for c in ("first", "any_service_id", "any_stock_id")), F.sum("n").alias("n"), F.flatten(F.collect_list("told")).alias("told"))


def clustered(names: DataFrame, visit: str, least: float) -> DataFrame:
    """Merged rows of ``names`` (visit, _meta, _text), merged by cluster, with its ``group_key``.

    Groups of few names are folded within a row that holds them; names of larger ones stay apart, are stored with what
    is done, and then joined.
    """
    group, held = [visit, "_meta"], names.columns[2:]
    sized = names.withColumn("apart", F.when(F.count(F.lit(1)).over(Window.partitionBy(*group)) > edits.FEW_NAMES, F.col("_text")))
    rows = sized.groupBy(*group, "apart").agg(F.sort_array(F.collect_list(F.struct("first", *(c for c in held if c != "first")))).alias("rows"))
    rows = rows.withColumn("heads", edits.heads(F.col("rows._text"), least)).select(*group, "apart", "heads", F.explode("rows").alias("r"))
    led = rows.select(*group, "apart", edits.head_of(F.col("heads"), F.col("r._text"), least).alias("leader"), *(f"r.{c}" for c in held if c != "_text"))
    done = stored(merged(led, [*group, "apart", "leader"]), "atom-clusters")
    key = F.concat(F.lit("like:"), F.col("_meta"), F.lit(":"), F.col("leader")).alias("group_key")
    few, many = done.where("apart is null"), done.where("apart is not null").drop("leader")
    out = few.select(visit, key, *(c for c in held if c != "_text"))
    if many.isEmpty():
        return out
    joined = many.join(edits.clusters(many, group, "apart", "first", least), [*group, "apart"])
    return out.unionByName(merged(joined.select("*", key), [visit, "group_key"]))


def atom_dedup(atoms: DataFrame, visit: str, least: float = 0.9) -> DataFrame:
    """One atom a group and visit: the best by section, then with an id, then by atom id.

    An atom's ``group_key`` is the first of: the service id; the stock id; dedup key and meta kind; a cluster of like concepts
    of one meta kind.  Clusters form in the order of ``atom_id``: an atom joins the first cluster whose first concept is like its
    own, by a normalised edit ratio of ``least``.  An atom without any text is a group of its own.

    Ids that the best atom lacks come from the first of the others that has them; its source comes first, then
    those of the others, each text once.  Atoms with a sure key and those to be clustered are told apart where they are
    read, each goes through one aggregation by source and one by key, and names are clustered with what is merged by then.
    Atoms that are already partitioned by their visit are not shuffled again.
    """
    key = (
        F.when(F.col("service_id").isNotNull(), F.concat(F.lit("svc:"), F.col("service_id")))
        .when(F.col("stock_id").isNotNull(), F.concat(F.lit("stk:"), F.col("stock_id")))
        .when(atom_text(F.col("dedup_key")) != "", F.concat(F.lit("key:"), meta_kind(F.col("kind")), F.lit(":"), atom_text(F.col("dedup_key"))))
    )
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SECTION_RANK)), F.trim("section")), F.lit(0)), F.lit(99))
    ids = ("service_id", "stock_id")
    has_id = F.when(F.col("service_id").isNotNull() | F.col("stock_id").isNotNull(), 0).otherwise(1)
    best = F.struct(rank.alias("r"), has_id.alias("h"), "atom_id", "source", "concept", "kind", "section", *ids)
    known = lambda c: F.min(F.when(F.col(c).isNotNull() & F.col("atom_id").isNotNull(), F.struct("atom_id", c)))
    source = F.array(F.struct(F.min("atom_id").alias("at"), "source"))
    told = F.when(F.col("source") != "", source).otherwise(F.filter(source, lambda x: F.lit(False)))

    def by_key(rows: DataFrame, keys: list[str]) -> DataFrame:
        rows = rows.withColumn("source", F.trim(F.coalesce("source", F.lit(""))))
        parts = rows.groupBy(*keys, "source").agg(F.min(best).alias("best"), F.min(F.col("atom_id").cast("string")).alias("first"), *(known(c).alias(f"any_{c}") for c in ids), F.count(F.lit(1)).alias("n"), told.alias("told"))
        return merged(parts, keys)

    unsure = F.col("service_id").isNull() & F.col("stock_id").isNull() & (atom_text(F.col("dedup_key")) == "")
    like = unsure & (atom_text(F.col("concept")) != "") & F.col(visit).isNotNull()
    sure = by_key(atoms.where(~like).withColumn("group_key", F.coalesce(key, F.concat(F.lit("own:"), F.col("atom_id")))), [visit, "group_key"])
    names = by_key(atoms.where(like).withColumns({"_meta": meta_kind(F.col("kind")), "_text": atom_text(F.col("concept"))}), [visit, "_meta", "_text"])
    shown = sure.unionByName(clustered(names, visit, least))
    first = F.when(F.col("best.source") != "", F.array("best.source")).otherwise(F.array().cast("array<string>"))
    sources = F.array_join(F.array_distinct(F.concat(first, F.transform(F.sort_array("told"), lambda x: x["source"]))), " | ")
    return shown.select(visit, "group_key", *(f"best.{c}" for c in ("atom_id", "concept", "kind", "section")), *(F.coalesce(f"best.{c}", f"any_{c}.{c}").alias(c) for c in ids), sources.alias("sources"), "n")


def others_fitting(kind: Column) -> Column:
    """The kinds of manifest rows, besides its own, that an atom of the lower-case ``kind`` may be linked to."""
    known = F.create_map(*(x for k, others in FITTING.items() for x in (F.lit(k), F.array(*map(F.lit, others)))))
    return F.coalesce(F.try_element_at(known, kind), F.array().cast("array<string>"))


def link_cascade(atoms: DataFrame, manifest: DataFrame, least: float = 0.72, margin: float = 0.08) -> DataFrame:
    """(atom_id, entity_id, strategy): the first strategy that finds an entity of the visit, its earliest entity.

    ``atoms``: visit, atom_id, concept, kind, ref_id, local_id; ``manifest``: visit, entity_id,
    name, display, kind, pos, local_id.  Strategies: 0 the entity id; 1 the local id; 2 an equal
    name (or display name) and kind; 3 an equal name of a row with a local id, fitting kind; 4 an
    equal name or display name, fitting kind; 5 one name inside the other or two shared words,
    fitting kind; 6 a shared telling word of a row with a local id, fitting kind; 7 one name inside
    the other, same kind, with a local id; 8 an edit ratio of ``least``, ``margin`` above the next
    one, where both name a form, fitting kind, with a local id.

    Each side is shuffled once, by visit and before anything is derived from its columns, and lies sorted
    where the pairs of a visit are formed; a pair's strategy is told at once, and tasks reduce the pairs of
    an atom to the best one and to those of about the best ratio before those meet.
    """
    plain = lambda c: text.squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\w\s]", ""))
    lowered = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    tokens = lambda c, few: F.array_except(F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= few)), F.array(*map(F.lit, UNTELLING)))
    formed = lambda c: c.rlike("|".join(FORMS))
    split = lambda c: F.array_distinct(F.split(c, " "))
    laid = lambda df: df.where(F.col("visit").isNotNull()).repartition("visit").sortWithinPartitions("visit")
    # what one side alone decides is worked out before the sides meet
    a = laid(atoms.select("visit", "atom_id", F.lower("kind").alias("kind"), F.col("ref_id").alias("ref"), F.col("local_id").alias("a_local"), "concept", F.monotonically_increasing_id().alias("row")))
    a = a.select("visit", "atom_id", "row", "kind", others_fitting(F.col("kind")).alias("fitting"), "ref", "a_local", lowered(F.col("concept")).alias("n"), plain(F.col("concept")).alias("p"))
    a = a.withColumns({"w": split("p"), "t": F.when(F.size(tokens(F.col("p"), 4)) > 0, tokens(F.col("p"), 4)).otherwise(tokens(F.col("p"), 3)), "form": formed(F.col("n"))})
    m = laid(manifest.select("visit", "entity_id", "pos", F.col("kind").alias("m_kind"), F.col("local_id").alias("m_local"), "name", "display"))
    m = m.select("visit", "entity_id", "pos", "m_kind", F.lower("m_kind").alias("m_low"), "m_local", lowered(F.col("name")).alias("m_n"), lowered(F.col("display")).alias("m_d"), plain(F.col("name")).alias("m_p"))
    m = m.withColumns({"m_w": split("m_p"), "m_t": tokens(F.col("m_p"), 3), "m_form": formed(F.col("m_n"))})

    same, known = F.col("kind") == F.col("m_low"), F.col("m_local").isNotNull()
    fit = same | F.array_contains("fitting", F.col("m_low"))
    name, display = (F.col("n") == F.col("m_n")) & (F.col("m_n") != ""), (F.col("n") == F.col("m_d")) & (F.col("m_d") != "")
    both = fit & (F.col("p") != "") & (F.col("m_p") != "")
    inside = F.contains("p", F.col("m_p")) | F.contains("m_p", F.col("p"))
    two = F.size(F.array_intersect("w", "m_w")) >= 2
    strategy = F.when(F.col("ref") == F.col("entity_id"), 0).when(F.col("a_local") == F.col("m_local"), 1)
    strategy = strategy.when((name | display) & same, 2).when(name & fit & known, 3).when((name | display) & fit, 4)
    strategy = strategy.when(both & (inside | two), 5).when(both & known & F.arrays_overlap("t", "m_t"), 6).when(both & known & same & inside, 7)
    ratio = F.when(both & known & F.col("form") & F.col("m_form"), 1 - F.levenshtein("p", "m_p") / F.greatest(F.length("p"), F.length("m_p")))
    # a pair without a strategy counts only if its ratio could be the best one or come too near to it
    pairs = a.join(m.hint("merge"), "visit").withColumn("strategy", strategy).withColumn("ratio", ratio)
    pairs = pairs.where(F.col("strategy").isNotNull() | (F.col("ratio") >= least - margin - 1e-6))
    best = F.when(F.col("strategy").isNotNull(), F.struct("strategy", "pos", "entity_id"))
    near = F.when(F.col("ratio") >= least - margin - 1e-6, F.struct((-F.col("ratio")).alias("far"), "pos", "entity_id", "row", "m_kind", "m_local", "m_n", "m_d", "m_p"))  # rows of the manifest that are the same count once
    pairs = pairs.select("atom_id", best.alias("best"), near.alias("near"))
    found = pairs.groupBy("atom_id").agg(F.min("best").alias("best"), F.sort_array(F.collect_set("near")).alias("near"))
    top, after = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    clear = (-top["far"] >= least) & (-top["far"] - F.coalesce(-after["far"], F.lit(0.0)) >= margin)
    found = found.select("atom_id", F.coalesce("best", F.when(clear, F.struct(F.lit(8).alias("strategy"), top["pos"].alias("pos"), top["entity_id"].alias("entity_id")))).alias("best"))
    return found.where("best is not null").select("atom_id", "best.entity_id", "best.strategy")


def uncovered(issues: DataFrame, medicines: DataFrame, stop: list[str]) -> DataFrame:
    """Issues that no medicine text of the visit covers: none shares two of their words, or their only one.

    A text meets its visit's issue words once and goes on as the set of those it has; equal sets are one.  Words are never
    joined beside their texts, and no side that holds texts is broadcast, whatever the size its files let expect.
    """
    i = issues.withColumn("tokens", text.issue_tokens(F.col("issue"), stop))
    asked = i.select("visit", F.explode("tokens").alias("w")).groupBy("visit").agg(F.collect_set("w").alias("asked"))
    told = medicines.select("visit", text.issue_tokens(F.col("medicine"), stop).alias("told")).hint("merge").join(asked, "visit")
    sets = told.select("visit", F.array_sort(F.array_intersect("asked", "told")).alias("words")).where(F.size("words") > 0).distinct()
    x = i.select("visit", "issue", F.size("tokens").alias("n"), F.explode("tokens").alias("w"))
    y = sets.select("visit", "words", F.explode("words").alias("w"))
    hits = x.hint("merge").join(y, ["visit", "w"]).groupBy("visit", "issue", "n", "words").agg(F.count(F.lit(1)).alias("k")).where("k >= 2 or (n = 1 and k = 1)")
    return issues.join(hits.select("visit", "issue").distinct(), ["visit", "issue"], "left_anti")


def filled(items: DataFrame, defaults: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``items`` with blank columns filled from ``defaults`` of the same key."""
    other = defaults.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return items.join(other, key, "left").select(*(text.first_filled(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in items.columns))


def best_suggestion(suggestions: DataFrame, key: str) -> DataFrame:
    """The primary suggestion of each key if there is one, else the one of greatest score."""
    return best_per_key(suggestions, [key], F.desc("is_primary"), F.desc("score"), F.asc("id"))


def with_hook(df: DataFrame, hook, schema: str) -> DataFrame:
    """Rows passed in batches to an outside model, ``hook(frame) -> frame``; the default of callers is a fixed answer."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield hook(f)

    return df.mapInPandas(task, schema)


def reject_all(frame: pd.DataFrame) -> pd.DataFrame:
    """The offline judge: nothing is bound."""
    return pd.DataFrame({"entity": frame["entity"], "verdict": "rejected"})
