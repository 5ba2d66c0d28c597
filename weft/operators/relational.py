"""Relational building blocks: best row per key, top-k, merges, set operations, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key under ``order``, which should be total."""
    return top_per_key(df, keys, 1, *order).drop("rank")


def top_per_key(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key with ``rank`` from 1.  Spark prunes each task to k rows a key before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def top_margin(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """(key, best tie value, best score, margin to the second); margin is the score where there is no second."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(tie))
    ranked = df.select(key, tie, score, F.row_number().over(w).alias("r"), F.lead(score).over(w).alias("second"))
    return ranked.where("r = 1").select(key, tie, score, (F.col(score) - F.coalesce("second", F.lit(0.0))).alias("margin"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    both = old.withColumn("_is_new", F.lit(0)).unionByName(new.withColumn("_is_new", F.lit(1)))
    values = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*values), "_is_new").alias("v")).select(*keys, *(F.col(f"v.{c}").alias(c) for c in values)).select(*old.columns)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def merge_aliases(observations: DataFrame) -> DataFrame:
    """Running state of learned aliases: greatest confidence, summed frequency, last use and its embedding source.

    Columns alias, concept, confidence, frequency, used_at; merging is associative, so old
    state and new observations may be unioned in any order.
    """
    return observations.groupBy("alias", "concept").agg(F.max("confidence").alias("confidence"), F.sum("frequency").alias("frequency"), F.max("used_at").alias("used_at"))


def learnable(aliases: DataFrame, least: float = 0.95) -> DataFrame:
    """Aliases sure enough and tied to one concept only."""
    clear = aliases.groupBy("alias").agg(F.countDistinct("concept").alias("n")).where("n = 1").select("alias")
    return aliases.where(F.col("confidence") >= least).join(clear, "alias", "left_semi")


def alias_lookup(mentions: DataFrame, aliases: DataFrame, least_frequency: int = 3) -> DataFrame:
    """The trusted alias of each mention: validated or frequent, validated first, then by confidence."""
    trusted = aliases.where(F.col("validated") | (F.col("frequency") >= least_frequency)).withColumn("k", F.lower("alias"))
    met = mentions.withColumn("k", F.lower("mention")).join(trusted, "k").drop("k")
    return best_per_key(met, ["mention"], F.desc("validated"), F.desc("confidence"), F.asc("concept"))


def concat_distinct(df: DataFrame, key: str, value: str, order: Column, sep: str = " | ") -> DataFrame:
    """(key, value): distinct values joined in order of their first occurrence."""
    first = df.groupBy(key, value).agg(F.min(order).alias("o"))
    ordered = F.sort_array(F.collect_list(F.struct("o", F.col(value).alias("v"))))
    return first.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), sep).alias(value))


def first_filled_merge(df: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """Per key the first value, by ``order``, that is not blank, column by column."""
    pick = lambda c: F.min_by(F.col(c), F.when(F.nullif(F.trim(c), F.lit("")).isNotNull(), F.col(order))).alias(c)
    return df.groupBy(key).agg(*map(pick, values))


def best_status(df: DataFrame, key: str, status: str, ranking: list[str]) -> DataFrame:
    """Per key the status that comes first in ``ranking``."""
    rank = F.array_position(F.array(*map(F.lit, ranking)), F.col(status))
    return df.groupBy(key).agg(F.min_by(status, F.when(rank > 0, rank).otherwise(len(ranking) + 1)).alias(status))


def add_quantities(stock: DataFrame, deltas: DataFrame, keys: list[str]) -> DataFrame:
    return stock.select(*keys, "quantity").unionByName(deltas.select(*keys, "quantity")).groupBy(*keys).agg(F.sum(F.coalesce("quantity", F.lit(0))).alias("quantity"))


def copy_with(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows like those of the same key with the given columns replaced where a change is not null."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(new, key).select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def neighbours(anchors: DataFrame, edges: DataFrame, nodes: DataFrame, k: int, boost: float) -> DataFrame:
    """One hop along (src, dst) from anchor nodes, with a fixed score, ``k`` a source."""
    hop = anchors.select("src").join(edges, "src").join(nodes, F.col("dst") == F.col("node"))
    return top_per_key(hop.select("src", "dst", "name").distinct(), ["src"], k, F.asc("dst")).withColumn("score", F.lit(boost))


def in_order(df: DataFrame, column: str, order: list[str]) -> Column:
    """Sort key of a value's place in a list; values outside come last."""
    at = F.array_position(F.array(*map(F.lit, order)), df[column])
    return F.when(at > 0, at).otherwise(len(order) + 1)


def interval_join(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of one key whose half-open [start, stop) ranges overlap, each once.

    Ranges are cut in bins of ``width``; a pair is kept in the bin where its overlap
    begins, so the join stays an equi-join whatever the number of rows of a key.
    """
    cut = lambda df, s: df.select(F.col(key).alias(f"key_{s}"), F.col("start").alias(f"start_{s}"), F.col("stop").alias(f"stop_{s}"), F.col("id").alias(f"id_{s}")).where(f"start_{s} < stop_{s}").withColumn(f"bin_{s}", F.explode(F.sequence(F.floor(F.col(f"start_{s}") / width), F.floor((F.col(f"stop_{s}") - 1) / width))))
    x, y = cut(a, "a"), cut(b, "b")
    met = x.join(y, (F.col("key_a") == F.col("key_b")) & (F.col("bin_a") == F.col("bin_b")) & (F.col("start_a") < F.col("stop_b")) & (F.col("start_b") < F.col("stop_a")))
    return met.where(F.floor(F.greatest("start_a", "start_b") / width) == F.col("bin_a")).select(F.col("key_a").alias(key), "id_a", "id_b")


def near_pairs(df: DataFrame, keys: list[str], position: str, within: int) -> DataFrame:
    """(keys, id_a, id_b) of rows of one key at most ``within`` apart, by bins and their neighbours."""
    a = df.select(*keys, F.col("id").alias("id_a"), F.col(position).alias("at_a"), F.floor(F.col(position) / within).alias("bin"))
    b = df.select(*keys, F.col("id").alias("id_b"), F.col(position).alias("at_b"), F.explode(F.sequence(F.floor(F.col(position) / within) - 1, F.floor(F.col(position) / within) + 1)).alias("bin"))
    return a.join(b, [*keys, "bin"]).where((F.col("id_a") < F.col("id_b")) & (F.abs(F.col("at_a") - F.col("at_b")) <= within)).select(*keys, "id_a", "id_b")


def moved_to_front(df: DataFrame, key: str, is_hit: Column, rank: str) -> DataFrame:
    """Ranks anew with the first hit of each key on place 1."""
    first = F.min(F.when(is_hit, F.col(rank))).over(Window.partitionBy(key))
    order = Window.partitionBy(key).orderBy(F.desc(F.coalesce(F.col(rank) == first, F.lit(False))), F.col(rank))
    return df.withColumn("new_rank", F.row_number().over(order))


def ordinal_ids(df: DataFrame, key: str, prefix: str, keep: Column, *order: Column) -> DataFrame:
    """prefix1, prefix2, ... per key in order, unless the row brings an id of its own."""
    return df.withColumn("ordinal", F.coalesce(keep, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("string"))))
