"""The register that query modules fill: a Spark query and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = with_views(sql)
        return fn

    return add


def stamp(c: Column | str) -> Column:
    """An instant as text, which compares alike in all engines."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def sql_local_date(c: str) -> str:
    return f"CAST(({c} AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' AS DATE)"


OCC = f"""occ AS (
  SELECT *, CASE WHEN temporal_kind = 'timed' THEN {sql_local_date("starts_at")} ELSE start_date END AS first_day,
    CASE WHEN temporal_kind = 'timed' THEN {sql_local_date("starts_at")} ELSE coalesce(end_date, start_date) END AS last_day,
    CASE WHEN temporal_kind = 'timed' THEN starts_at ELSE (CAST(start_date AS TIMESTAMP) AT TIME ZONE 'America/Sao_Paulo') AT TIME ZONE 'UTC' END AS instant
  FROM v_occurrences)"""
NORMAL = "trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
SLUG = "regexp_replace(regexp_replace(trim(lower(strip_accents({0}))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
STOP = "['a','as','o','os','de','da','do','das','dos','e','em','na','no','nas','nos','um','uma']"


def sql_normal(c: str) -> str:
    return NORMAL.format(c)


def sql_slug(c: str) -> str:
    return SLUG.format(c)


def sql_tokens(c: str) -> str:
    return f"list_filter(list_distinct(string_split({sql_normal(c)}, ' ')), lambda t: t <> '' AND NOT list_contains({STOP}, t))"


def sql_token_similarity(a: str, b: str) -> str:
    """Of two lists of significant tokens."""
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE greatest(2e0 * {shared} / (len({a}) + len({b})), 1e0 * {shared} / least(len({a}), len({b}))) END"


def sql_trigrams(c: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS BIGINT), 3))))"


def sql_similarity(a: str, b: str) -> str:
    """Of two lists of trigrams."""
    shared = f"len(list_intersect({a}, {b}))"
    return f"coalesce(1e0 * {shared} / nullif(len(list_distinct({a})) + len(list_distinct({b})) - {shared}, 0), 0e0)"


def sql_word_similarity(a: str, b: str) -> str:
    """Of two lists of trigrams: the first's set against every run of the second."""
    run = f"list_distinct(list_slice({b}, i, j))"
    shared = f"len(list_intersect({run}, {a}))"
    return f"""coalesce(list_max(flatten(list_transform(range(1, len({b}) + 1), lambda i: list_transform(range(i, len({b}) + 1),
      lambda j: 1e0 * {shared} / (len(list_distinct({a})) + len({run}) - {shared}))))), 0e0)"""


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    """Null where a coordinate is: DuckDB's least() passes over nulls."""
    known = " AND ".join(f"{x} IS NOT NULL" for x in (a, b, c, d))
    return f"CASE WHEN {known} THEN 2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))) END"
