"""Dense vectors as arrays of numbers; all arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a side is null, lengths differ or a norm is zero."""
    sizes = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (sizes > 0), dot(a, b) / sizes).otherwise(0.0)


def cosine_score(a: Column, b: Column) -> Column:
    """1 - least(cosine distance, 1): within [0, 1]."""
    return 1 - F.least(1 - cosine(a, b), F.lit(1.0))


def l2(a: Column, b: Column) -> Column:
    d = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def to_literal(v: Column, digits: int = 7) -> Column:
    """'[0.1,0.2]' with ``digits`` decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(as_double(v), lambda x: F.format_string(f"%.{digits}f", x)), ","), F.lit("]"))


def from_literal(c: Column) -> Column:
    inner = F.regexp_replace(F.trim(c), r"^\[|\]$", "")
    return F.when(F.trim(inner) == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x).cast("double")))
