"""Requests to an outside judge: gathered for a moment, sent together, each with a deadline of its own.

Requests wait in keyed state, spread over lanes by a hash.  The first one that finds its lane
empty starts a window (50 ms); when it ends, or at a flush, all that wait in the lane go out in
one call.  A request without an answer by its own deadline (30 s after it was asked) gets a null
verdict, by a processing-time timer, and no other request is touched.  Answers come back as
a stream; late or repeated ones find nothing pending and change nothing.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .json_fields import keyed_state

log = logging.getLogger(__name__)
ANSWER = "request string, verdict string"
OUT = "request string, what string, call string, value string, timed_out boolean"


class JudgeFault(Exception):
    """Raised by a judge that can't answer a call; its requests run into their deadlines."""


class JudgeProcessor(StatefulProcessor):
    """One lane: requests that wait, requests that are out, and their timers, in milliseconds."""

    def __init__(self, window: int, deadline: int):
        self.window_ms, self.deadline_ms = window, deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "request string", "value string, asked long, sent boolean")
        self.window = handle.getValueState("window", "due long")

    def send(self, lane: int, now: int) -> list[tuple]:
        waiting = sorted((r, v, asked) for (r,), (v, asked, sent) in self.pending.iterator() if not sent)
        for r, v, asked in waiting:
            self.pending.updateValue((r,), (v, asked, True))
        self.window.clear()
        return [(r, "send", f"{lane}:{now}", v, False) for r, v, _ in waiting]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, out, flush = timerValues.getCurrentProcessingTimeInMs(), [], False
        for frame in rows:
            for kind, request, value in zip(frame["kind"], frame["request"], frame["value"]):
                if kind == "flush":
                    flush = True
                elif kind == "answer":
                    if self.pending.containsKey((request,)):
                        self.pending.removeKey((request,))
                        out.append((request, "verdict", None, value, False))
                elif not self.pending.containsKey((request,)):
                    self.pending.updateValue((request,), (value, now, False))
                    self.handle.registerTimer(now + self.deadline_ms)
                    if not self.window.exists():
                        self.window.update((now + self.window_ms,))
                        self.handle.registerTimer(now + self.window_ms)
        if flush:
            out += self.send(key[0], now)
        yield pd.DataFrame(out, columns=["request", "what", "call", "value", "timed_out"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if self.window.exists() and self.window.get()[0] <= now:
            out += self.send(key[0], now)
        for request in sorted(r for (r,), (_, asked, _) in self.pending.iterator() if asked + self.deadline_ms <= now):
            self.pending.removeKey((request,))
            out.append((request, "verdict", None, None, True))
        yield pd.DataFrame(out, columns=["request", "what", "call", "value", "timed_out"])

    def close(self) -> None:
        pass


def judge_events(requests: DataFrame, answers: DataFrame, flushes: DataFrame | None = None, window: int = 50, deadline: int = 30_000, lanes: int = 64) -> DataFrame:
    """Rows to send (what = send, with their call) and verdicts (what = verdict) of streams of (request, value) and ANSWER; any row of ``flushes`` sends what waits."""
    keyed_state(requests.sparkSession)
    lane = F.pmod(F.xxhash64("request"), F.lit(lanes)).cast("int").alias("lane")
    rows = requests.select(lane, F.lit("ask").alias("kind"), F.col("request").cast("string").alias("request"), F.col("value").cast("string").alias("value"))
    rows = rows.unionByName(answers.select(lane, F.lit("answer").alias("kind"), "request", F.col("verdict").alias("value")))
    if flushes is not None:
        each = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
        rows = rows.unionByName(flushes.select(each, F.lit("flush").alias("kind"), F.lit(None).cast("string").alias("request"), F.lit(None).cast("string").alias("value")))
    return rows.groupBy("lane").transformWithStateInPandas(JudgeProcessor(window, deadline), OUT, "append", "processingTime")


def judged(requests: DataFrame, judge: Callable[[DataFrame], DataFrame], folder: str, flushes: DataFrame | None = None, window: int = 50, deadline: int = 30_000, lanes: int = 64, every: str = "50 milliseconds") -> StreamingQuery:
    """A running query that writes (request, verdict, timed_out) below ``folder``/verdicts.

    ``judge`` gets (request, call, value) and returns ANSWER rows; what it leaves out stays
    open until its deadline.  A ``JudgeFault`` is logged and counts as silence; every other error
    stops the query.  Results lie under their batch's number and a repeated batch writes
    them anew, so none is doubled.
    """
    spark = requests.sparkSession
    spark.createDataFrame([], ANSWER).write.mode("append").parquet(f"{folder}/answers/none")
    answers = spark.readStream.schema(ANSWER).option("recursiveFileLookup", True).parquet(f"{folder}/answers")

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.where("what = 'verdict'").select("request", F.col("value").alias("verdict"), "timed_out").write.mode("overwrite").parquet(f"{folder}/verdicts/batch={number}")
            asked = batch.where("what = 'send'").select("request", "call", "value")
            if not asked.isEmpty():
                try:
                    judge(asked).select("request", "verdict").write.mode("overwrite").parquet(f"{folder}/answers/batch={number}")
                except JudgeFault:
                    log.exception("batch %s got no answer", number)
        finally:
            batch.unpersist()

    events = judge_events(requests, answers, flushes, window, deadline, lanes)
    return events.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()
