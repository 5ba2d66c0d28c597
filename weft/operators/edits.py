"""Names within an edit distance of each other, and clusters around the first of them.

The join cuts every name in one part more than edits are allowed: of two names that near,
one part of the shorter one stands unchanged in the longer one, at most as far away as
the edits before and behind it can move it.  Parts are joined by equality, with lengths and part numbers in the key, and the
exact distance is taken of the pairs that are left.  No name is compared with all others.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Names of a group up to which all are compared, within one row.
FEW_NAMES = 500


def allowed(longer: Column, least: float) -> Column:
    """Edits that a ratio of ``least`` allows; the tiny addition makes up for rounding, the exact ratio is checked at the end."""
    return F.floor(longer * (1 - least) + 1e-6).cast("int")


def edit_pairs(names: DataFrame, group: list[str], name: str, least: float) -> DataFrame:
    """(*group, a, b, ratio): pairs of distinct names of a group with 1 - distance / longer length of ``least`` or more; a < b."""
    distinct = names.select(*group, F.col(name).alias("n")).where("n <> ''").distinct().withColumn("l", F.length("n"))
    longest = F.floor(F.col("l") / least + 1e-6).cast("int")
    parts = distinct.withColumn("d", allowed(longest, least)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    begin = F.floor(F.col("i") * F.col("l") / (F.col("d") + 1)).cast("int")
    end = F.floor((F.col("i") + 1) * F.col("l") / (F.col("d") + 1)).cast("int")
    index = parts.select(*group, F.col("n").alias("x"), "l", "i", F.substring("n", begin + 1, end - begin).alias("part"))

    big = F.length("n")
    probes = distinct.select(*group, F.col("n").alias("y"), "n", F.explode(F.sequence(F.ceil(big * least - 1e-6).cast("int"), big)).alias("l"))
    probes = probes.withColumn("d", allowed(F.floor(F.col("l") / least + 1e-6), least)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    probes = probes.withColumn("p", begin).withColumn("w", end - F.col("p")).withColumn("more", big - F.col("l"))
    low = F.greatest(F.lit(0), F.col("p") - F.col("i"), F.col("p") + F.col("more") - (F.col("d") - F.col("i")))
    high = F.least(big - F.col("w"), F.col("p") + F.col("i"), F.col("p") + F.col("more") + (F.col("d") - F.col("i")))
    probes = probes.where(low <= high).withColumn("q", F.explode(F.sequence(low, high)))
    probes = probes.select(*group, "y", "l", "i", F.substring("n", F.col("q") + 1, F.col("w")).alias("part"))
    near = index.join(probes, [*group, "l", "i", "part"]).where(F.col("x") != F.col("y"))
    near = near.select(*group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    ratio = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")).cast("double")
    return near.withColumn("ratio", ratio).where(F.col("ratio") >= least)


def like(a: Column, b: Column, least: float) -> Column:
    """Whether two names have an edit ratio of ``least`` or more; distances beyond it are not worked out."""
    longer = F.greatest(F.length(a), F.length(b))
    edits = F.call_function("levenshtein", a, b, allowed(longer, least))
    return (edits >= 0) & (1 - edits / longer.cast("double") >= least)


def heads(names: Column, least: float) -> Column:
    """The leaders among an array of names, in its order: those that are like no leader before them."""
    return F.aggregate(names, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda h: like(h, x, least)), acc).otherwise(F.concat(acc, F.array(x))))


def head_of(leaders: Column, name: Column, least: float) -> Column:
    return F.element_at(F.filter(leaders, lambda h: like(h, name, least)), 1)


def led(edges: list[tuple]) -> dict:
    """Name place -> place of its cluster's leader, from (earlier, later) pairs: in order, a name joins the first leader that it is like, or leads."""
    before: dict = {}
    for a, b in edges:
        before.setdefault(a, [])
        before.setdefault(b, []).append(a)
    leader: dict = {}
    for x in sorted(before):
        leader[x] = min((e for e in before[x] if leader[e] == e), default=x)
    return leader


def clusters(names: DataFrame, group: list[str], name: str, order: str, least: float) -> DataFrame:
    """(*group, name, leader): names of each group, by their first ``order``, each with the name it is clustered under.

    Equal names share a fate, so only distinct ones are looked at; a name that is like no other leads itself and
    never reaches Python, which gets the near pairs alone.  ``order`` is a string column.
    """
    first = names.where(F.col(name) != "").groupBy(*group, name).agg(F.min(order).alias("first"))
    pairs = edit_pairs(first, group, name, least).drop("ratio")
    placed = pairs
    for side in ("a", "b"):
        placed = placed.join(first.select(*group, F.col(name).alias(side), F.col("first").alias(f"{side}_at")), [*group, side])
    edges = placed.select(*group, F.least("a_at", "b_at").alias("early"), F.greatest("a_at", "b_at").alias("late"))
    types = dict(edges.dtypes)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        found = led(list(zip(frame["early"], frame["late"])))
        out = pd.DataFrame(sorted(found.items()), columns=["first", "lead"])
        for k, c in enumerate(group):
            out.insert(k, c, frame[c].iloc[0])
        return out

    found = edges.groupBy(*group).applyInPandas(fold, ", ".join(f"{c} {types[c]}" for c in group) + ", first string, lead string")
    heads = first.select(*group, F.col(name).alias("leader"), F.col("first").alias("lead"))
    with_lead = first.join(found, [*group, "first"], "left").withColumn("lead", F.coalesce("lead", "first"))
    return with_lead.join(heads, [*group, "lead"]).select(*group, name, "leader")
