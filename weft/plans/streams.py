"""Queries that run streams to their end and return what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.files import scratch
from ..streaming import early, json_fields
from .registry import query, table

PIECE = 96


@query("""
SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, 'text' AS name, 3 AS depth, sha256(text) AS value FROM conversations WHERE text IS NOT NULL
""")
def json_field_stream(spark, sf_dir):
    """Each conversation as one JSON text, cut every 96 bytes, dealt to two batches out of order; the texts come back as their quotes close."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.struct("role", "text").alias("said"))))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.encode(F.to_json(F.struct(F.transform(turns, lambda t: t["said"]).alias("turns"))), "UTF-8").alias("bytes"))
    n = F.ceil(F.octet_length("bytes") / PIECE).cast("int")
    pieces = whole.select(F.col("conv_id").alias("session"), "bytes", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq")).select("session", F.col("seq").cast("long").alias("seq"), F.substring("bytes", F.col("seq") * PIECE + 1, F.lit(PIECE)).alias("piece"))
    folder = scratch(spark, "json-pieces")
    pieces.where("seq % 3 = 1").write.parquet(f"{folder}/in/0")
    for k in (0, 1):
        if k:
            pieces.where("seq % 3 <> 1").write.parquet(f"{folder}/in/1")
        found = json_fields.json_strings_stream(spark.readStream.schema(pieces.schema).parquet(f"{folder}/in/*"), ["text"])
        found.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out").withColumn("value", F.sha2("value", 256))


STAGED = """
SELECT o_custkey AS visit, 'a' || o_orderkey % 17 AS atom, (o_orderkey % 3 = 0)::INTEGER AS stage, o_orderkey AS revision,
 CASE o_orderkey % 5 WHEN 0 THEN 'Subjective' WHEN 1 THEN 'Objective' WHEN 2 THEN 'Plan' WHEN 3 THEN 'Assessment' END AS section, o_orderpriority AS body FROM orders
"""


@query(f"""
WITH last AS (SELECT * FROM ({STAGED}) QUALIFY row_number() OVER (PARTITION BY visit, atom ORDER BY stage DESC, revision DESC) = 1),
marked AS (SELECT *, coalesce(section, '') IN ('Subjective', 'Objective', 'Signalment', '') AS inside FROM last),
begun AS (SELECT DISTINCT visit FROM marked WHERE stage = 0 AND inside)
SELECT visit, atom, stage, revision, coalesce(section, '-') AS section, body FROM marked WHERE CASE WHEN stage = 0 THEN inside ELSE NOT inside OR visit NOT IN (SELECT visit FROM begun) END
""")
def early_atoms(spark, sf_dir):
    """Orders as atoms of two stages in three batches, some of them twice, with a fold in between."""
    k = F.col("o_orderkey")
    section = F.when(k % 5 == 0, "Subjective").when(k % 5 == 1, "Objective").when(k % 5 == 2, "Plan").when(k % 5 == 3, "Assessment")
    atoms = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("visit"), F.concat(F.lit("a"), (k % 17).cast("string")).alias("atom"), (k % 3 == 0).cast("int").alias("stage"), k.alias("revision"), section.alias("section"), F.col("o_orderpriority").alias("body"))
    folder = scratch(spark, "early-atoms")
    for n, batch in enumerate([atoms.where(k % 4 < 2), atoms.where(k % 4 >= 1), atoms.where(k % 4 == 0)]):
        batch.write.parquet(f"{folder}/in/{n}")
        early.merge_stream(spark.readStream.schema(early.ATOM).parquet(f"{folder}/in/*"), folder).awaitTermination()
        if n == 1:
            early.compact(spark, folder)
    return early.visible(early.table_of(spark, folder)).withColumn("section", F.coalesce("section", F.lit("-")))
