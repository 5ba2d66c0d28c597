"""Requests with deadlines, and early atoms under replay and late data."""

import itertools
import time

import pytest
from pyspark.sql import functions as F

from weft.streaming import early, judge


def wait_for(done, seconds=120):
    end = time.time() + seconds
    while time.time() < end:
        if done():
            return
        time.sleep(0.3)
    raise AssertionError("nothing came in time")


def verdicts(spark, folder):
    try:
        rows = spark.read.schema("request string, verdict string, timed_out boolean").option("recursiveFileLookup", True).parquet(f"{folder}/verdicts").collect()
    except Exception:  # noqa: BLE001  the folder comes with the first batch
        return {}
    assert len({r["request"] for r in rows}) == len(rows)
    return {r["request"]: (r["verdict"], r["timed_out"]) for r in rows}


@pytest.fixture(autouse=True)
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("flushed", [False, True])
def test_one_silent_request_times_out_alone(spark, tmp_path, flushed):
    folder, calls = str(tmp_path), []
    spark.createDataFrame([(f"r{k}", f"v{k}") for k in range(12)], "request string, value string").coalesce(1).write.parquet(f"{folder}/in/0")
    requests = spark.readStream.schema("request string, value string").parquet(f"{folder}/in/*")

    def answer(asked):
        calls.append({r["request"]: r["call"] for r in asked.collect()})
        return asked.where("request <> 'r3'").select("request", F.upper("value").alias("verdict"))

    flushes = None
    if flushed:
        spark.createDataFrame([(1,)], "n int").write.parquet(f"{folder}/flush/0")
        flushes = spark.readStream.schema("n int").parquet(f"{folder}/flush/*")
    q = judge.judged(requests, answer, folder, flushes, window=500_000 if flushed else 300, deadline=20_000, lanes=2, every="200 milliseconds")
    try:
        wait_for(lambda: len(verdicts(spark, folder)) == 12 or q.exception())
        assert q.exception() is None
    finally:
        q.stop()
    got = verdicts(spark, folder)
    assert got.pop("r3") == (None, True)
    assert got == {f"r{k}": (f"V{k}", False) for k in range(12) if k != 3}
    assert sum(map(len, calls)) == 12  # nothing is sent twice
    assert all(len(list(g)) > 1 for _, g in itertools.groupby(sorted(c for call in calls for c in call.values())))  # sent together


def test_a_judges_fault_is_silence_and_other_errors_stop(spark, tmp_path):
    spark.createDataFrame([("a", "x")], "request string, value string").write.parquet(f"{tmp_path}/in")
    for name, fault in (("fault", judge.JudgeFault), ("error", KeyError)):

        def answer(asked, fault=fault):
            raise fault("no")

        requests = spark.readStream.schema("request string, value string").parquet(f"{tmp_path}/in")
        q = judge.judged(requests, answer, f"{tmp_path}/{name}", window=50, deadline=12_000, lanes=1, every="200 milliseconds")
        wait_for(lambda: q.exception() or verdicts(spark, f"{tmp_path}/{name}"))
        assert (q.exception() is None) == (fault is judge.JudgeFault)
        q.stop()
    assert verdicts(spark, f"{tmp_path}/fault") == {"a": (None, True)}


def atoms():
    rows = []
    for visit in range(6):
        for k in range(5):
            section = ["Subjective", "Objective", "Plan", None, "Assessment"][k]
            if visit % 3:
                rows.append((visit, f"a{k}", early.EARLY, 1, section, f"early {k}"))
            if visit % 2:
                rows += [(visit, f"a{k + 2}", early.FULL, r, ["Plan", "Subjective", None, "Objective", "Plan"][k], f"full {k} {r}") for r in (1, 2)]
    return rows


def plain(rows):
    last = {}
    for r in rows:
        order = (r[2], r[3])
        if (r[0], r[1]) not in last or (last[r[0], r[1]][2], last[r[0], r[1]][3]) < order:
            last[r[0], r[1]] = r
    inside = lambda r: (r[4] or "") in early.EARLY_SECTIONS
    begun = {r[0] for r in last.values() if r[2] == early.EARLY and inside(r)}
    return sorted((r[0], r[1], r[5]) for r in last.values() if (inside(r) if r[2] == early.EARLY else r[0] not in begun or not inside(r)))


def shown(spark, folder):
    return sorted((r["visit"], r["atom"], r["body"]) for r in early.visible(early.table_of(spark, folder)).collect())


def test_replayed_late_and_compacted_atoms_give_one_table(spark, tmp_path):
    folder, rows = str(tmp_path), atoms()
    batches = [rows[::2], rows[1::2] + rows[:3], rows[5:9]]  # late and repeated rows
    for k, b in enumerate(batches):
        spark.createDataFrame(b, early.ATOM).coalesce(1).write.parquet(f"{folder}/in/{k}")
        assert early.merge_stream(spark.readStream.schema(early.ATOM).parquet(f"{folder}/in/*"), folder).awaitTermination(120)
        assert shown(spark, folder) == plain([r for x in batches[: k + 1] for r in x])
        if k == 1:
            early.compact(spark, folder)
            early.compact(spark, folder)
            assert early.base_of(spark, folder)[0] == 1 and shown(spark, folder) == plain(rows)
    # the last batch is run again: its offset is planned, its commit is lost
    (tmp_path / "checkpoint" / "commits" / "2").unlink()
    crc = tmp_path / "checkpoint" / "commits" / ".2.crc"
    if crc.exists():
        crc.unlink()
    before = early.table_of(spark, folder).collect()
    assert early.merge_stream(spark.readStream.schema(early.ATOM).parquet(f"{folder}/in/*"), folder).awaitTermination(120)
    assert sorted(map(str, early.table_of(spark, folder).collect())) == sorted(map(str, before)) and shown(spark, folder) == plain(rows)
