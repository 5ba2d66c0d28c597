"""Atoms that come early, from a first part of a visit, and are merged with those of the full pass.

Early atoms are provisional rows that a stream appends.  A batch's rows lie under its number,
so a replayed batch writes the same rows in the same place.  The table is the merge of all
rows by visit and atom: the later stage wins, within a stage the greater revision, then the
greater digest.  That merge is associative, commutative and idempotent: rows may come late, twice or in
any order.  ``compact`` folds the log into a base and only then names the base in a commit
log, so a reader or a crash in between sees the old one.

What a visit shows follows the full pass: early atoms count in their own sections only; where
a visit has some, those sections stay theirs, and the full pass gives the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Sections that the early stage may fill.
EARLY_SECTIONS = ["Subjective", "Objective", "Signalment", ""]
EARLY, FULL = 0, 1
ATOM = "visit long, atom string, stage int, revision long, section string, body string"
KEY = ("visit", "atom")


def merged(rows: DataFrame) -> DataFrame:
    """One row a visit and atom, the last of its rows; map-side combining leaves one row a key and task to shuffle."""
    order = F.struct("stage", F.coalesce("revision", F.lit(-1)), F.sha2(F.concat_ws("\x1f", "section", F.coalesce("body", F.lit("\x1e"))), 256))
    return rows.groupBy(*KEY).agg(F.max_by(F.struct("stage", "revision", "section", "body"), order).alias("last")).select(*KEY, "last.*")


def merge_stream(atoms: DataFrame, folder: str) -> StreamingQuery:
    """Starts a query that adds the stream ``atoms`` (ATOM) to the table in ``folder`` and ends when all there is has been read."""

    def each(batch: DataFrame, number: int) -> None:
        merged(batch.where(F.col("visit").isNotNull() & F.col("atom").isNotNull())).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")

    return atoms.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def base_of(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """(last batch in the newest base that is committed, its path); (-1, None) before the first."""
    try:
        commits = spark.read.schema("upto long, path string").parquet(f"{folder}/commits")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return -1, None
    last = commits.agg(F.max(F.struct("upto", "path")).alias("c")).first()["c"]
    return (last["upto"], last["path"]) if last else (-1, None)


def rows_of(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The committed base and the batches after it, and the number of the base's last batch."""
    upto, path = base_of(spark, folder)
    log = spark.read.schema(f"{ATOM}, batch long").option("basePath", f"{folder}/log").parquet(f"{folder}/log").where(F.col("batch") > upto)
    base = spark.read.schema(f"{ATOM}, batch long").parquet(path) if path else None
    return (log.unionByName(base) if base is not None else log), upto


def table_of(spark: SparkSession, folder: str) -> DataFrame:
    """The merged table as it stands."""
    return merged(rows_of(spark, folder)[0])


def compact(spark: SparkSession, folder: str) -> None:
    """Folds the log into a new base; the commit comes last."""
    rows, upto = rows_of(spark, folder)
    last = rows.agg(F.max("batch")).first()[0]
    if last is None or last <= upto:
        return
    path = f"{folder}/base/upto={last}"
    merged(rows).withColumn("batch", F.lit(last).cast("long")).write.mode("overwrite").parquet(path)
    spark.createDataFrame([(last, path)], "upto long, path string").write.mode("append").parquet(f"{folder}/commits")


def visible(table: DataFrame) -> DataFrame:
    """Rows of a merged table that count: early ones in early sections; full ones outside of these, or anywhere in visits without early rows."""
    in_early = F.coalesce("section", F.lit("")).isin(EARLY_SECTIONS)
    early = table.where((F.col("stage") == EARLY) & in_early)
    full = table.where(F.col("stage") == FULL)
    begun = early.groupBy("visit").agg(F.lit(True).alias("begun"))
    kept = full.join(begun, "visit", "left").where(F.col("begun").isNull() | ~in_early).drop("begun")
    return early.unionByName(kept)
