"""Registered queries: name, function of (spark, sf_dir), and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trigrams_sql(x: str) -> str:
    """DuckDB expression for the trigram set of ``x``."""
    return f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: w <> '')"


def jaro_winkler_sql(a: str, b: str) -> str:
    """DuckDB expression for Jaro with a bonus for up to four equal first characters; half swaps count, as in the function."""
    reach = f"greatest(0, greatest(length({a}), length({b})) // 2 - 1)"
    m = (
        f"list_reduce(range(1, length({a}) + 1), lambda acc, i: list_concat(acc, list_filter(range(greatest(1, i - {reach}), least(length({b}), i + {reach}) + 1), "
        f"lambda j: substr({b}, j::INTEGER, 1) = substr({a}, i::INTEGER, 1) AND NOT list_contains(acc, j))[1:1]), []::BIGINT[])"
    )
    prefix = " ".join(f"WHEN substr({a}, 1, {k}) = substr({b}, 1, {k}) AND length({a}) >= {k} THEN {k}" for k in (4, 3, 2, 1))
    jaro = (
        f"list_transform([{m}], lambda m: CASE WHEN len(m) = 0 THEN 0.0 ELSE (len(m) / length({a}) + len(m) / length({b}) + "
        f"(len(m) - len(list_filter(range(1, len(m) + 1), lambda k: substr({b}, m[k]::INTEGER, 1) <> substr({b}, list_sort(m)[k]::INTEGER, 1))) / 2.0) / len(m)) / 3.0 END)[1]"
    )
    return f"list_transform([{jaro}], lambda x: least(1.0, x + 0.1 * (CASE {prefix} ELSE 0 END) * (1 - x)))[1]"
