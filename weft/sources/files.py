"""File sources and sinks.  Everything goes through Spark's readers and writers, so any store works."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which all executors share; without that setting in local mode alone, under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{(base or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to a scratch folder and read back, so that several later steps read it and none computes it again."""
    folder = scratch(df.sparkSession, tag)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a stated schema; blank text becomes null."""
    df = spark.read.csv(path, header=True, schema=schema)
    return df.select(*(blank_to_null(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed column order, with a header."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file, tolerant of missing and extra fields."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, folder, modified, length) of files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("modificationTime").alias("modified"), "length")


def newest(files: DataFrame, by: str = "folder") -> DataFrame:
    """The newest file of each folder; equal times go to the last name."""
    return files.groupBy(by).agg(F.max(F.struct("modified", "path")).alias("m")).select(by, "m.path", "m.modified")


def run_folders(runs: DataFrame) -> DataFrame:
    """The run to use of each slug: a flat layout first, else the newest usable time stamp.

    ``runs``: slug, run (null for flat), status; failed, mock and empty runs don't count.
    """
    usable = runs.where(~F.coalesce("status", F.lit("ok")).isin("failed", "mock", "empty"))
    order = Window.partitionBy("slug").orderBy(F.when(F.col("run").isNull(), 0).otherwise(1), F.desc("run"))
    return usable.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def glob_filter(df: DataFrame, column: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Shell patterns on a name: any of ``include`` (all if empty), none of ``exclude``."""
    as_regex = lambda g: "^" + "".join(".*" if c == "*" else "." if c == "?" else ("\\" + c if c in ".+()[]{}^$|\\" else c) for c in g) + "$"
    hit = lambda gs: F.exists(F.array(*(F.col(column).rlike(as_regex(g)) for g in gs)), lambda x: x) if gs else F.lit(False)
    return df.where((hit(include) if include else F.lit(True)) & ~hit(exclude))


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Adds a run as a partition of its own; earlier runs stay, so nothing needs to be archived."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the greatest run id; partition pruning reads that folder alone."""
    runs = spark.read.parquet(path)
    last = runs.agg(F.max("run_id")).first()[0]
    return runs.where(F.col("run_id") == F.lit(last))


def first_present(*choices: Column) -> Column:
    return F.coalesce(*choices)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int = 16, **options: str) -> DataFrame:
    """A table over JDBC in key ranges; needs the driver's jar on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions), **options).load()
