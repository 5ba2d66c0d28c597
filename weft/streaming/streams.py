"""Stateful streams and their batch equivalents.

Every streaming function takes a streaming DataFrame; the batch functions beside them give
the final state for the same rows and serve as the oracle in tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segments_batch(messages: DataFrame) -> DataFrame:
    """(session, text): the last text of each segment, joined in segment order.

    ``messages``: session, segment, arrival, text.
    """
    last = messages.groupBy("session", "segment").agg(F.max_by("text", "arrival").alias("text"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("segment", "text"))), lambda x: x["text"])
    return last.groupBy("session").agg(F.array_join(ordered, " ").alias("text"))


def segments_stream(messages: DataFrame) -> DataFrame:
    """(session, text) after each batch: state holds segment -> (arrival, text), last write wins."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        segments, arrivals, texts = state.get if state.exists else ([], [], [])
        held = {s: (a, t) for s, a, t in zip(segments, arrivals, texts)}
        for f in frames:
            for s, a, t in f[["segment", "arrival", "text"]].itertuples(index=False):
                if s not in held or held[s][0] <= a:
                    held[s] = (a, t)
        names = sorted(held)
        state.update((names, [held[s][0] for s in names], [held[s][1] for s in names]))
        yield pd.DataFrame({"session": [key[0]], "text": [" ".join(held[s][1] or "" for s in names)]})

    return messages.groupBy("session").applyInPandasWithState(update, "session long, text string", "segments array<long>, arrivals array<long>, texts array<string>", "update", "NoTimeout")


def stable_chunks(length: int, cursor: int, least: int = 1200, tail: int = 800) -> int:
    """New cursor: what lies before an unstable tail is emitted once enough of it is new."""
    stable = length - tail
    return stable if stable - cursor >= least else cursor


def stable_prefix_stream(texts: DataFrame, least: int = 1200, tail: int = 800) -> DataFrame:
    """(session, start, chunk): chunks of a growing text (session, text) as soon as they are stable."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (cursor,) = state.get if state.exists else (0,)
        out = []
        for f in frames:
            for t in f["text"]:
                new = stable_chunks(len(t), cursor, least, tail)
                if new > cursor:
                    out.append((key[0], cursor, t[cursor:new]))
                    cursor = new
        state.update((cursor,))
        yield pd.DataFrame(out, columns=["session", "start", "chunk"])

    return texts.groupBy("session").applyInPandasWithState(update, "session long, start long, chunk string", "cursor long", "append", "NoTimeout")


def alias_state_stream(observations: DataFrame) -> DataFrame:
    """Running confidence, frequency and last use of each (alias, concept); output mode update."""
    return observations.groupBy("alias", "concept").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("frequency"), F.max("used_at").alias("used_at"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows with a watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
