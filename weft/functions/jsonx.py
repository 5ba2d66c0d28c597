"""JSON that models and tools return: extraction, repair, maps."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def root_end(s: str) -> int:
    """Place behind the first balanced {...} or [...], aware of strings; -1 if it never closes."""
    depth, quoted, escaped = 0, False, False
    for i, c in enumerate(s):
        if quoted:
            escaped, quoted = (False, True) if escaped else (c == "\\", c != '"')
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return i + 1
    return -1


def close_truncated(s: str) -> str:
    """A cut-off document with its string ended and its brackets closed in reverse order."""
    open_, quoted, escaped = [], False, False
    for c in s:
        if quoted:
            escaped, quoted = (False, True) if escaped else (c == "\\", c != '"')
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
    s = s[:-1] if escaped else s
    body = (s + '"' if quoted else s).rstrip()
    body = re.sub(r"[,:]\s*$", lambda m: ":null" if m[0].strip() == ":" else "", body)
    return body + "".join(reversed(open_))


def repaired(text: str | None) -> str | None:
    """The root JSON value of a model's answer: fences and thinking dropped, commas and ends mended; None if hopeless."""
    s = re.sub(r"(?s)<think>.*?</think>", "", text or "")
    s = re.sub(r"```(?:json)?", "", s)
    starts = [i for i in (s.find("{"), s.find("[")) if i >= 0]
    if not starts:
        return None
    s = s[min(starts) :]
    end = root_end(s)
    s = re.sub(r",(\s*[}\]])", r"\1", s[:end] if end > 0 else close_truncated(s))
    try:
        json.loads(s)
    except ValueError:
        return None
    return s


@F.pandas_udf(T.StringType())
def repair_json(s: pd.Series) -> pd.Series:
    return s.map(repaired)


def pairs_to_map(pairs: Column) -> Column:
    """array<struct<relationship, value>> to a map; blank names dropped, the last of a name wins."""
    kept = F.filter(pairs, lambda p: p["relationship"].isNotNull() & (F.trim(p["relationship"]) != ""))
    names = F.array_distinct(F.transform(kept, lambda p: p["relationship"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(kept, lambda p: p["relationship"] == n), -1)["value"]))


def fill_map(own: Column, other: Column) -> Column:
    """Values of ``own`` that are not blank, else those of ``other``."""
    return F.map_zip_with(own, other, lambda k, a, b: F.coalesce(F.nullif(a, F.lit("")), b))


def skeleton_fields(line: Column, n: int = 13) -> Column:
    """A pipe-separated line as ``n`` trimmed fields, missing ones empty; null if it has fewer than four."""
    parts = F.transform(F.split(line, r"\|"), lambda p: F.trim(p))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), 1, n)
    return F.when(F.size(parts) >= 4, padded)


def hint_probabilities(c: Column, default: float = 0.95) -> Column:
    """'a:0.9,b' as array<struct<p, hint>>; a hint without a number gets ``default``."""
    items = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    value = lambda x: F.coalesce(F.try_element_at(F.split(x, ":"), F.lit(2)).try_cast("double"), F.lit(default))
    return F.transform(items, lambda x: F.struct(value(x).alias("p"), F.trim(F.element_at(F.split(x, ":"), 1)).alias("hint")))
