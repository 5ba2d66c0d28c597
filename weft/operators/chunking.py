"""Chunks of long texts with overlap, their merge, context windows and spans."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunk_parameters(length: Column, overlap: int = 200, target: int = 4000, least: int = 2, most: int = 6, least_size: int = 2000) -> Column:
    """struct<n, size>: one chunk up to ``target``; else ``least`` to ``most`` chunks that cover the text with overlaps."""
    n = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(length / target)))
    size = F.floor((length + (n - 1) * overlap + n - 1) / n)
    fewer = F.greatest(F.lit(1).cast("long"), F.floor(length / least_size))
    n2 = F.when(size < least_size, F.least(n, fewer)).otherwise(n)
    size2 = F.floor((length + (n2 - 1) * overlap + n2 - 1) / n2)
    return F.struct(F.when(length <= target, 1).otherwise(n2).cast("int").alias("n"), F.when(length <= target, length).otherwise(size2).cast("int").alias("size"))


def chunks(text: Column, size: int, overlap: int, least: int) -> Column:
    """array<struct<start, text>>: windows of ``size`` characters that start every ``size - overlap``.

    A tail shorter than ``least`` joins the chunk before it.
    """
    step = size - overlap
    n = F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
    tail = n - (count - 1) * step
    kept = F.when((count > 1) & (tail - overlap < least), count - 1).otherwise(count)
    starts = F.sequence(F.lit(0), (kept - 1) * step, F.lit(step))
    return F.transform(starts, lambda s, i: F.struct(s.alias("start"), F.substring(text, s + 1, F.when(i == kept - 1, n).otherwise(F.lit(size))).alias("text")))


def chunk_at_spaces(text: str, size: int, overlap: int) -> list[str]:
    """Windows that back up to the last blank if it lies past their middle."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text) and (cut := text.rfind(" ", start, end)) > start + size // 2:
            end = cut
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def space_aware_chunks(texts: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([chunk_at_spaces(t or "", n, o) for t, n, o in zip(texts, size, overlap)])


def merge_chars(parts: list[str], most: int, least: int = 31) -> str:
    """Parts joined where the end of one repeats as the start of the next, by the longest match."""
    out = parts[0] if parts else ""
    for p in parts[1:]:
        k = next((k for k in range(min(most, len(out), len(p)), least - 1, -1) if out.endswith(p[:k])), 0)
        out += p[k:]
    return out


def merge_tokens(parts: list[str], most: int) -> str:
    """As ``merge_chars`` with words, compared without case and punctuation."""
    plain = lambda w: "".join(c for c in w.lower() if c.isalnum())
    out = parts[0].split() if parts else []
    for p in parts[1:]:
        new = p.split()
        k = next((k for k in range(min(most, len(out), len(new)), 0, -1) if [*map(plain, out[-k:])] == [*map(plain, new[:k])]), 0)
        out += new[k:]
    return " ".join(out)


def merged(chunked: DataFrame, key: str, order: str, column: str, most: int, tokens: bool = False) -> DataFrame:
    """(key, column): the chunks of each document merged in order, one document at a time."""
    join = merge_tokens if tokens else merge_chars

    @F.pandas_udf(T.StringType())
    def of(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: join(list(p), most))

    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("t")))), lambda x: x["t"])
    return chunked.groupBy(key).agg(ordered.alias("parts")).select(key, of("parts").alias(column))


def token_window(text: Column, mention: Column, width: int = 20, most: int = 500) -> Column:
    """Words around the first word of a mention, capped."""
    ws = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    first = F.lower(F.element_at(F.split(F.trim(mention), r"\s+"), 1))
    at = F.array_position(F.transform(ws, F.lower), first).cast("int")
    return F.when(at > 0, F.substring(F.array_join(F.slice(ws, F.greatest(at - width, F.lit(1)), F.least(at - 1, F.lit(width)) + width + 1), " "), 1, most)).otherwise("")


def line_window(text: Column, mention: Column, lines: int = 2) -> Column:
    """Lines around the first line that holds a mention."""
    ls = F.split(F.coalesce(text, F.lit("")), "\n")
    hit = F.array_position(F.transform(ls, lambda x: F.contains(F.lower(x), F.lower(mention))), F.lit(True)).cast("int")
    return F.when(hit > 0, F.array_join(F.slice(ls, F.greatest(hit - lines, F.lit(1)), F.least(hit - 1, F.lit(lines)) + lines + 1), "\n")).otherwise("")


def char_window(text: Column, start: Column, stop: Column, width: int = 120) -> Column:
    low = F.greatest(F.lit(0), start - width)
    return F.substring(text, low + 1, stop + width - low)


def time_windows(seconds: Column, size: float, overlap: float) -> Column:
    """array<struct<start, stop>> that cover a duration with overlaps."""
    step = size - overlap
    n = F.when(seconds <= size, 1).otherwise(F.ceil((seconds - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, seconds).alias("stop")))


def found_spans(text: str, spans: list[str]) -> list[tuple[int, int]]:
    """Offsets of each span, searched from behind the last one, then from the start; (0, length) if absent."""
    out, cursor, low = [], 0, text.lower()
    for s in spans:
        k = s.lower()
        at = low.find(k, cursor) if k else -1
        at = low.find(k) if at < 0 and k else at
        out.append((at, at + len(s)) if at >= 0 else (0, len(s)))
        cursor = at + len(s) if at >= 0 else cursor
    return out


def seed_length(n: int, sizes: list[int], least: float) -> int:
    """Length of a run that a needle of ``n`` characters shares with any window of ``sizes`` at a ratio of ``least``.

    M matched characters leave n + w - 2M unmatched ones, which part the matched ones into at
    most one more run than that.
    """
    lengths = []
    for w in sizes:
        matched = math.ceil(least * (n + w) / 2 - 1e-9)
        lengths.append(math.ceil(matched / (n + w - 2 * matched + 1)))
    return max(1, min(lengths))


def proposed_windows(needle: str, hay: str, sizes: list[int], least: float) -> set[tuple[int, int]]:
    """(size, start) of all windows that can reach ``least``: around the places where a seed of the needle stands in the text."""
    n, q = len(needle), seed_length(len(needle), sizes, least)
    seeds: dict[str, list[int]] = {}
    for j in range(n - q + 1):
        seeds.setdefault(needle[j : j + q], []).append(j)
    spare = [(w, n + w - 2 * math.ceil(least * (n + w) / 2 - 1e-9)) for w in sizes]
    out: set[tuple[int, int]] = set()
    for p in range(len(hay) - q + 1):
        for j in seeds.get(hay[p : p + q], ()):
            for w, unmatched in spare:
                for i in range(max(0, p - j - unmatched, p + q - w), min(p, p - j + unmatched, len(hay) - w) + 1):
                    before = p - i
                    if abs(j - before) + abs((n - j) - (w - before)) <= unmatched:
                        out.add((w, i))
    return out


def closest_substring(needle: str, hay: str, least: float) -> tuple[int, int] | None:
    """The window of ``hay`` most like ``needle`` by difflib's ratio, the shortest and then earliest on ties; None below ``least``.

    Windows have from half to one and a half times the needle's length.  Only those around a shared
    seed are compared, so the work grows with the text and not with its windows.
    """
    n = len(needle)
    sizes = [w for w in range(max(2, n // 2), min(int(n * 1.5) + 2, len(hay)) + 1) if 2 * min(n, w) >= least * (n + w) - 1e-9]
    if not needle or n > len(hay) or not sizes:
        return None
    m, best, where = SequenceMatcher(), least, None
    m.set_seq1(needle)
    for w, i in sorted(proposed_windows(needle, hay, sizes, least)):
        m.set_seq2(hay[i : i + w])
        if m.real_quick_ratio() >= best and m.quick_ratio() >= best and ((r := m.ratio()) > best or where is None and r >= best):
            best, where = r, (i, i + w)
    return where


def injected(text: str, spans: list[tuple[str, str]], least: float = 0.88) -> str:
    """``text`` with [[id|span]] around each (id, span): exact first, then fuzzy; no overlaps; from right to left."""
    taken: list[tuple[int, int, str]] = []
    low = text.lower()
    for name, s in spans:
        at = low.find(s.lower())
        where = (at, at + len(s)) if at >= 0 else closest_substring(s.lower(), low, least)
        if where and all(where[1] <= a or b <= where[0] for a, b, _ in taken):
            taken.append((*where, name))
    for a, b, name in sorted(taken, reverse=True):
        text = f"{text[:a]}[[{name}|{text[a:b]}]]{text[b:]}"
    return text


def with_anchors(docs: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(key, text): anchor tags put into each document's text; ``entities``: key, ordinal, span."""
    per_doc = entities.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ordinal", "span"))).alias("spans"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            tagged = [injected(t, [(f"E{x['ordinal']}", x["span"]) for x in (spans if spans is not None else [])]) for t, spans in zip(f["text"], f["spans"])]
            yield pd.DataFrame({key: f[key], "text": tagged})

    return docs.select(key, "text").join(per_doc, key, "left").mapInPandas(task, f"{key} long, text string")
