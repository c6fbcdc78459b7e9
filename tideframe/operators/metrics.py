"""Declared metrics and dashboard filters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

GRAINS = ("hour", "day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Metric:
    """A named aggregate over a table with its dimensions, time column and fixed filters."""

    name: str
    measure: str
    dimensions: tuple[str, ...] = ()
    time_column: str | None = None
    filters: tuple[tuple[str, str, Any], ...] = ()


def predicate(column: str, op: str, value: Any) -> Column:
    """``= != > >= < <= in "not in"``; None with = and != asks for null, and is dropped from lists, which then need a value."""
    c = F.col(column)
    if op in ("in", "not in"):
        held = [v for v in (value if isinstance(value, (list, tuple, set)) else [value]) if v is not None]
        if not held:
            raise ValueError(f"{op} needs at least one value")
        return c.isin(held) if op == "in" else ~c.isin(held)
    if value is None:
        if op not in ("=", "!="):
            raise ValueError(f"{op} needs a value")
        return c.isNull() if op == "=" else c.isNotNull()
    if op not in ("=", "!=", ">", ">=", "<", "<="):
        raise ValueError(f"unknown operator {op}")
    return {"=": c == value, "!=": c != value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[op]


def metric_query(
    df: DataFrame,
    metric: Metric,
    dimensions: list[str] | None = None,
    grain: str | None = None,
    start: Any = None,
    end: Any = None,
    where: list[tuple[str, str, Any]] | None = None,
    order_by: list[tuple[str, bool]] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The metric by dimensions and time grain, a column of the grain's name; start is included, end is not.

    Rows come in the order of the keys; ``order_by`` (column, descending), of
    keys or the metric itself, replaces that. Nulls are last. Conditions may
    also be on the time column. A dimension named twice is one.
    """
    dimensions = list(dict.fromkeys(dimensions or []))
    for c in dimensions:
        if c not in metric.dimensions:
            raise ValueError(f"{metric.name} has no dimension {c}")
    for c, *_ in where or []:
        if c not in metric.dimensions and c != metric.time_column:
            raise ValueError(f"{metric.name} cannot be filtered by {c}")
    for c, _ in order_by or []:
        if c not in (metric.name, *dimensions, *([grain] if grain else [])):
            raise ValueError(f"{metric.name} cannot be ordered by {c}")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
        raise ValueError("limit must be a positive number")
    if (grain or start is not None or end is not None) and not metric.time_column:
        raise ValueError(f"{metric.name} has no time column")
    if grain is not None and grain not in GRAINS:
        raise ValueError(f"grain must be one of {', '.join(GRAINS)}")
    for f in [*metric.filters, *(where or [])]:
        df = df.filter(predicate(*f))
    t = F.col(metric.time_column) if metric.time_column else None
    if start is not None:
        df = df.filter(t >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(t < F.lit(end).cast("timestamp_ntz"))
    keys = ([F.date_trunc(grain, t).cast("timestamp_ntz").alias(grain)] if grain else []) + [F.col(c) for c in dimensions]
    out = (df.groupBy(*keys) if keys else df).agg(F.expr(metric.measure).alias(metric.name))
    if not keys:
        return out if limit is None else out.limit(limit)
    names = ([grain] if grain else []) + dimensions
    order = [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in order_by] if order_by else [F.col(c).asc_nulls_last() for c in names]
    out = out.orderBy(*order)
    return out.limit(limit) if limit is not None else out


def multi_metric(parts: list[tuple[DataFrame, Metric]], dimensions: list[str] | None = None, grain: str | None = None, **options: Any) -> DataFrame:
    """Up to five metrics side by side: joined in full by their keys, or as one row without keys."""
    if not 1 <= len(parts) <= 5:
        raise ValueError("between one and five metrics")
    names = [m.name for _, m in parts]
    if len(set(names)) < len(names):
        raise ValueError("metric names repeat")
    frames = [metric_query(df, m, dimensions, grain, **options) for df, m in parts]
    keys = ([grain] if grain else []) + list(dict.fromkeys(dimensions or []))
    if not keys:
        return reduce(lambda a, b: a.crossJoin(b), frames)
    safe = lambda a, b: a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full").select(*(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys), *(F.col(f"a.{c}") for c in a.columns if c not in keys), *(F.col(f"b.{c}") for c in b.columns if c not in keys))
    return reduce(safe, frames).orderBy(*(F.col(k).asc_nulls_last() for k in keys))


def apply_filters(df: DataFrame, values: Mapping[str, Any], kinds: Mapping[str, str]) -> DataFrame:
    """A dashboard's filters on the rows, before any aggregate.

    dropdown ``=``; multi_select ``in``; date_range and number_range {from, to},
    where a date of ten characters as ``to`` means the whole day; text contains,
    without case; toggle a boolean. Empty values filter nothing.
    """
    for column, value in values.items():
        if value is None or value == "" or value == [] or value == {}:
            continue
        c, kind = F.col(column), kinds.get(column, "dropdown")
        if kind == "multi_select":
            df = df.filter(c.isin(list(value)))
        elif kind == "date_range":
            if value.get("from"):
                df = df.filter(c >= F.lit(value["from"]).cast("timestamp_ntz"))
            if value.get("to"):
                to = F.lit(value["to"]).cast("timestamp_ntz")
                df = df.filter(c < to + F.expr("interval 1 day") if len(value["to"]) == 10 else c <= to)
        elif kind == "number_range":
            if value.get("from") is not None:
                df = df.filter(c >= value["from"])
            if value.get("to") is not None:
                df = df.filter(c <= value["to"])
        elif kind == "text":
            df = df.filter(F.contains(F.lower(c), F.lower(F.lit(value))))
        elif kind == "toggle":
            df = df.filter(c == bool(value))
        else:
            df = df.filter(c == value)
    return df


def kpi(df: DataFrame) -> DataFrame:
    """The first numeric column of the first row, as ``value``."""
    name = next((f.name for f in df.schema if isinstance(f.dataType, NumericType)), None)
    return df.limit(1).select((F.col(name) if name else F.lit(None).cast("double")).alias("value"))


def dashboard_freshness(state: DataFrame, tables: list[str]) -> DataFrame:
    """Oldest and newest build of the tables a dashboard reads (model, built_at)."""
    return state.filter(F.col("model").isin(tables)).groupBy("model").agg(F.max("built_at").alias("at")).agg(F.min("at").alias("oldest"), F.max("at").alias("newest"))
