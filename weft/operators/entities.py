"""Steps over whole tables of mentions, candidates and atoms: gates, picks, merges and branches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.text import blank_to_null, words
from .relational import best_per_key
from .retrieval import trigram_join


def where_given(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one tenant; all rows if none is given.  A column that the table lacks filters nothing."""
    return df if value is None or column not in df.columns else df.where(F.col(column) == F.lit(value))


def looked_up(df: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: dict[str, str]) -> DataFrame:
    """``df`` with columns of the one row that its key has in ``dim``; nulls without a key or a row."""
    side = best_per_key(dim.select(F.col(dim_key).alias("looked up"), *(F.col(c).alias(n) for n, c in columns.items())), ["looked up"], *(F.asc(n) for n in columns))
    return df.join(side, df[key] == side["looked up"], "left").drop("looked up")


def whitelisted(mentions: DataFrame, names: DataFrame, column: str, least: float = 0.2) -> DataFrame:
    """Mentions whose text is blank or near enough to some name."""
    text = F.col(column)
    near = trigram_join(mentions.where(blank_to_null(text).isNotNull()).select(text.alias("name")), names, "name", least).select(F.col("a").alias("near")).distinct()
    kept = mentions.join(near, mentions[column] == near["near"], "left_semi")
    return kept.unionByName(mentions.where(blank_to_null(text).isNull()))


def scrubbed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Blank strings as nulls."""
    return df.withColumns({c: blank_to_null(F.col(c)) for c in columns})


def load_report(tables: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """(name, n, enough): row counts against the least that a load must bring."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n", (F.col("n") >= least.get(name, 1)).alias("enough")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def by_kind(entities: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, spans) for every kind of the dimension, spans in order of their id; empty lists for kinds without one."""
    found = entities.groupBy(F.col("kind").alias("of")).agg(F.array_sort(F.collect_list(F.struct("id", "span"))).alias("s"))
    return kinds.join(found, F.col("kind") == F.col("of"), "left").select("kind", F.coalesce(F.transform("s", lambda x: x["span"]), F.array().cast("array<string>")).alias("spans"))


def hint_gate(candidates: DataFrame, medical: list[str]) -> DataFrame:
    """Candidates that their mention's hints allow: a category hint is strict, else the service type splits medical from other categories, else all stay."""
    strict = F.col("hint").isNotNull()
    inside = F.col("category").isin(medical)
    typed = F.when(F.col("service_type") == "medical", inside).when(F.col("service_type") == "non-medical", ~inside).when(F.col("service_type") == "general", inside).otherwise(True)
    return candidates.where(F.when(strict, F.col("category") == F.col("hint")).otherwise(typed))


def safe_context(candidates: DataFrame, forms: list[str]) -> DataFrame:
    """The one candidate a mention may take as context: its exact term, else a dosage form's concept, else one that shares a telling word."""
    own = F.array_except(F.array_intersect(words(F.col("term")), words(F.col("name"))), F.array(*map(F.lit, forms)))
    shares = F.exists(own, lambda w: F.length(w) >= 4)
    step = F.when(p.is_exact_term(F.col("name"), F.col("name"), F.col("term")), 1).when(F.col("is_form") & p.shared_form(F.col("term"), F.col("name")), 2).when(shares, 3)
    return best_per_key(candidates.withColumn("step", step).where("step is not null"), ["mention"], F.asc("step"), F.desc("score"), F.asc("name"))


def fast_tracked(candidates: DataFrame, least: float = 0.90) -> DataFrame:
    """One row a mention of high certainty with an exact name among its candidates: the local one before the global one."""
    hits = candidates.where((F.col("certainty") >= least) & p.is_exact_term(F.col("name"), F.col("name"), F.col("term")))
    best = best_per_key(hits, ["mention"], F.when(F.col("source") == "local", 0).otherwise(1).asc(), F.asc("name"))
    return best.withColumn("match_method", F.concat(F.lit("dual_sync_high_certainty_auto_link_"), F.col("source")))


def forced_first(candidates: DataFrame, is_hit: Column, most: int) -> DataFrame:
    """The first ``most`` candidates of each mention, hits before the others, by score within each."""
    order = Window.partitionBy("mention").orderBy(F.when(is_hit, 0).otherwise(1), F.desc("score"), F.asc("name"))
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def dual_ids(stocks: DataFrame, services: DataFrame, least: float) -> DataFrame:
    """(mention, stock, service): the best of both sources; the lower one only if it reaches ``least``."""
    best = lambda df, s: best_per_key(df, ["mention"], F.desc("score"), F.asc("id")).select("mention", F.col("id").alias(s), F.col("score").alias(f"{s}_score"))
    both = best(stocks, "stock").join(best(services, "service"), "mention", "full")
    first = F.coalesce(F.col("stock_score"), F.lit(-1.0)) >= F.coalesce(F.col("service_score"), F.lit(-1.0))
    return both.select("mention", F.when(first | (F.col("stock_score") >= least), F.col("stock")).alias("stock"), F.when(~first | (F.col("service_score") >= least), F.col("service")).alias("service"))


def by_route(entities: DataFrame, branches: dict[str, str], otherwise: str) -> DataFrame:
    """``entities`` with the method that their route leads to, one branch a route."""
    parts = [entities.where(F.col("route") == r).withColumn("match_method", F.lit(m)) for r, m in branches.items()]
    rest = entities.where(~F.coalesce(F.col("route").isin(list(branches)), F.lit(False))).withColumn("match_method", F.lit(otherwise))
    return reduce(DataFrame.unionByName, [*parts, rest])


def with_presenting(entities: DataFrame) -> DataFrame:
    """A second row of kind ReasonForVisit for entities that are presenting complaints as well."""
    kinds = F.when(F.array_contains("roles", "presenting_complaint") & (F.col("kind") != "ReasonForVisit"), F.array(F.col("kind"), F.lit("ReasonForVisit"))).otherwise(F.array("kind"))
    return entities.withColumn("kind", F.explode(kinds))


def schema_kinds(manifest: DataFrame, mapping: dict[str, list[str]], schema: list[str]) -> DataFrame:
    """(visit, kinds): the schema's kinds that a visit's manifest may need, in order."""
    mapped = manifest.withColumn("to", F.array_intersect(p.looked_up(F.col("kind"), mapping), F.array(*map(F.lit, schema))))
    return mapped.select("visit", F.explode("to").alias("k")).groupBy("visit").agg(F.array_sort(F.collect_set("k")).alias("kinds"))


def first_concepts(found: DataFrame, k: int) -> DataFrame:
    """(query_id, concept, distance): the first ``k`` distinct concepts of each query's nearest chunks."""
    each = found.groupBy("query_id", "concept").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "concept")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def is_relevant(affinity: Column, session: Column, alone: float = 0.80, session_least: float = 0.75) -> Column:
    """The candidate's own affinity reaches ``alone``, or the session's and its own do."""
    return (affinity >= alone) | ((session >= session_least) & (affinity >= alone))


def carried_over(results: DataFrame, sources: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``results`` with the source's values where their own are missing."""
    side = sources.select(F.col(key).alias("source key"), *(F.col(c).alias(f"source {c}") for c in columns))
    both = results.join(side, results[key] == side["source key"], "left")
    return both.withColumns({c: F.coalesce(F.col(c), F.col(f"source {c}")) for c in columns}).drop("source key", *(f"source {c}" for c in columns))


def excerpt(dim: DataFrame, name: str, synonyms: str, order: list[Column], most: int, each: int) -> DataFrame:
    """Lines "name (synonyms)" of the first rows: at most ``most`` rows, a report, with ``each`` synonyms."""
    some = F.array_join(F.slice(F.col(synonyms), 1, each), ", ")
    return dim.orderBy(*order).limit(most).select(F.concat_ws(" ", F.col(name), F.when(some != "", F.concat(F.lit("("), some, F.lit(")")))).alias("line"))
