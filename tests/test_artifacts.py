"""Runs of artifacts: the pointer moves with a whole run and stays with a failed one."""

import os

import pytest
from pyspark.sql import functions as F

from weft.sources import artifacts

SCHEMA = "id long, said string, score double, good boolean"


def test_pointer_follows_whole_runs_only(spark, tmp_path):
    artifacts.register(spark)
    folder = str(tmp_path / "a")
    assert artifacts.latest(folder) is None
    df = spark.range(100).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("word é "), F.col("id").cast("string"))).alias("said"), (F.col("id") / 4).alias("score"), (F.col("id") % 2 == 0).alias("good")).repartition(3)
    save = lambda d, **options: d.write.format("artifact").options(**options).mode("append").save(folder)
    load = lambda **options: sorted(map(tuple, spark.read.format("artifact").schema(SCHEMA).options(**options).load(folder).collect()), key=str)
    save(df, run="first", text="said")
    told = artifacts.latest(folder)
    texts = [r["said"] or "" for r in df.collect()]
    assert (told["run"], told["rows"], told["chars"], told["words"]) == ("first", 100, sum(map(len, texts)), sum(len(t.split()) for t in texts))
    assert load() == sorted(map(tuple, df.collect()), key=str)
    assert sorted(line for name in told["files"] for line in open(f"{folder}/runs/first/{name[:-5]}.txt", encoding="utf-8").read().split("\n")[:-1]) == sorted(texts)

    broken = df.withColumn("score", F.when(F.col("id") == 55, F.raise_error(F.lit("task fails")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="task fails"):
        save(broken, run="second")
    assert artifacts.latest(folder) == told and not os.path.exists(f"{folder}/runs/second") and len(load()) == 100

    save(df.where("id < 5"), run="third")
    assert [r[0] for r in load()] == [0, 1, 2, 3, 4] and len(load(run="first")) == 100
    save(df.limit(0))
    assert artifacts.latest(folder)["rows"] == 0 and load() == []


def test_what_can_not_be_read_or_written(spark, tmp_path):
    artifacts.register(spark)
    with pytest.raises(Exception, match="no run has been written"):
        spark.read.format("artifact").schema(SCHEMA).load(str(tmp_path / "none")).collect()
    with pytest.raises(Exception, match="are none of"):
        spark.range(1).select(F.array("id").alias("x")).write.format("artifact").mode("append").save(str(tmp_path / "x"))
