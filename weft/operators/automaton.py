"""Which of a visit's atoms an item's names mean: an equal name first, else the first atom with one name inside the other.

Containment within a visit is a search for many patterns at once: one automaton holds the
visit's distinct atom and item names, every name runs through it once, and the work follows
the length of the names and the matches found, not the product of items and atoms.  Names are
made distinct per visit before any of them reaches Python, and a visit with very many of them is cut in
blocks, which are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..sources.files import stored
from .relational import best_per_key

#: Distinct names of one side in a block of one visit, and in a group of blocks.
BLOCK_NAMES, GROUP_NAMES = 20_000, 100_000
#: Lists of names with an answer up to which these are sent to every executor.
FEW_LISTS = 500_000


def name_key(c: Column) -> Column:
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def first_inside(items: list[str], atoms: list[tuple[int, str]]) -> Iterator[tuple[str, int]]:
    """(item name, smallest place of an atom whose name holds it or lies in it)."""
    patterns = ahocorasick.Automaton()
    best: dict[str, int] = {}
    wanted, place = set(items), {name: at for at, name in reversed(sorted(atoms))}
    for name in wanted | place.keys():
        patterns.add_word(name, name)
    patterns.make_automaton()
    for at, text in atoms:
        for name in {name for _, name in patterns.iter(text)} & wanted:
            best[name] = min(best.get(name, at), at)
    for text in wanted:
        for _, name in patterns.iter(text):
            if name in place:
                best[text] = min(best.get(text, place[name]), place[name])
    yield from best.items()


def contained_names(items: DataFrame, atoms: DataFrame) -> DataFrame:
    """(visit, key, pos): the first atom (visit, key, pos) of the visit that holds, or lies in, each item name (visit, key)."""
    items = items.select("visit", "key").where("key <> ''").distinct()
    atoms = atoms.where("key <> ''").groupBy("visit", "key").agg(F.min("pos").alias("pos"))
    blocks = lambda df, name: df.groupBy("visit").agg(F.ceil(F.count("*") / BLOCK_NAMES).cast("int").alias(name))
    size = blocks(items, "a").join(blocks(atoms, "b"), "visit")
    left = items.join(size, "visit").withColumn("x", F.pmod(F.xxhash64("key"), F.col("a")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    right = atoms.join(size, "visit").withColumn("y", F.pmod(F.xxhash64("key"), F.col("b")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("a") - 1)))
    names = size.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
    groups = max(1, int(names) * BLOCK_NAMES // GROUP_NAMES, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    group = F.pmod(F.xxhash64("visit", "x", "y"), F.lit(groups)).alias("g")

    def one(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        by = others.groupby(["visit", "x", "y"])
        places = by.indices
        for block, some in mine.groupby(["visit", "x", "y"]):
            if block in places:
                of = others.iloc[places[block]]
                found += [(block[0], name, at) for name, at in first_inside(some["key"].tolist(), list(zip(of["pos"].tolist(), of["key"].tolist())))]
        return pd.DataFrame(found, columns=["visit", "key", "pos"])

    out = left.select(group, "visit", "x", "y", "key").groupBy("g").cogroup(right.select(group, "visit", "x", "y", "key", "pos").groupBy("g")).applyInPandas(one, "visit long, key string, pos long")
    return out.groupBy("visit", "key").agg(F.min("pos").alias("pos"))


def matched_atoms(items: DataFrame, atoms: DataFrame) -> DataFrame:
    """(visit, item, atom, how) of every item; ``how`` is equal, inside or null.

    ``items``: visit, item, names (in the order they are tried), one row an item; ``atoms``: visit, atom, pos,
    name.  Of atoms with one name the last stands in the place of the first.  Equal names of any rank
    come before containment; within each the first name that finds an atom decides, and of the atoms it finds the
    first.  What an item finds follows from its visit and names alone, so only distinct lists of names are looked up, and items
    meet their list's answer once.
    """
    known = atoms.select("visit", "atom", F.col("pos").cast("long").alias("pos"), name_key(F.col("name")).alias("key")).where("key <> ''")
    known = known.groupBy("visit", "key").agg(F.max_by("atom", "pos").alias("atom"), F.min("pos").alias("pos"))
    keyed = items.select("visit", "item", F.transform("names", lambda x: name_key(x)).alias("keys"))
    lists = stored(keyed.select("visit", "keys").where("visit is not null").distinct(), "name-lists")
    names = lists.select("visit", "keys", F.posexplode("keys").alias("rank", "key")).where("key <> ''")
    equal = best_per_key(names.join(known, ["visit", "key"]), ["visit", "keys"], F.asc("rank")).select("visit", "keys", "atom", F.lit("equal").alias("how"))
    left = names.join(equal, ["visit", "keys"], "left_anti")
    near = left.join(contained_names(left, known), ["visit", "key"])
    near = best_per_key(near, ["visit", "keys"], F.asc("rank"), F.asc("pos")).join(known.select("visit", "pos", "atom"), ["visit", "pos"])
    found = stored(equal.unionByName(near.select("visit", "keys", "atom", F.lit("inside").alias("how"))), "matched-lists")
    few = found.count() <= FEW_LISTS
    return keyed.join(F.broadcast(found) if few else found, ["visit", "keys"], "left").select("visit", "item", "atom", "how")
