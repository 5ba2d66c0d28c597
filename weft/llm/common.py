"""What the operators of this subpackage share: reading, scratch tables, labels."""

from __future__ import annotations

import json
import tempfile
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent and all work is done on this machine (tests, local
    mode) a temporary folder is made and kept in the session's settings.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    This cuts the lineage with a copy that survives lost executors, so a table
    that several later steps read is computed once.  The files belong to the
    application and lie under its id; delete that folder once results are out.
    Steps that are over sooner are taken away by ``discarded``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_in = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_in)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows: the check before a broadcast.  Hand over a stored or narrow table."""
    return df.count() <= most_rows


def joined_by_size(left: DataFrame, right: DataFrame, on, how: str, most_rows: int) -> DataFrame:
    """Join that broadcasts ``right`` only if it has at most ``most_rows`` rows, and shuffles otherwise."""
    return left.join(F.broadcast(right) if small_enough(right, most_rows) else right, on, how)


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % F.lit(folds)


def training_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, y) of the rows outside the held-out fold.

    Null ids and null labels are left out; a document that several rows label
    gets the majority, ties going to 1.
    """
    rows = labels.select("doc_id", F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    rows = rows.where(fold_of("doc_id", folds) != held_out)
    return rows.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))


#: Rows with texts handed to Python at once; Spark's default of 10,000 makes batches of tens of MB, which both sides hold.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH_ROWS`` rows, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, null texts read as empty; other columns may clash and are not looked at."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def literal(value: list, kind: str) -> Column:
    """A constant of a nested type: Spark reads it from JSON once, when it folds constants."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def bucket(w: Column, n: int) -> Column:
    """The place of a string's map in ``buckets``."""
    return F.pmod(F.xxhash64(w), F.lit(n)).cast("int")


def buckets(words: list[str], n: int) -> Column:
    """A literal array of ``n`` small maps from words to their places in ``words``, by ``bucket``: a look-up costs the same whatever their number."""
    maps: list[dict[str, int]] = [{} for _ in range(n)]
    for k, w in enumerate(words):
        h = xxhash.xxh64_intdigest(w, seed=42)
        maps[(h - (1 << 64) if h >> 63 else h) % n][w] = k
    return literal(maps, "array<map<string,int>>")
