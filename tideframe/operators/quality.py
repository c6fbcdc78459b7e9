"""Assertions, profiles, freshness, contracts over time, and anomalies."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tideframe.operators.keys import ROWS_A_TASK, spread

_COMPARE: dict[str, Callable] = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq, "==": operator.eq, "!=": operator.ne}


@dataclass(frozen=True)
class Check:
    """One assertion. kind: row_count, no_nulls, unique, accepted_values, grain or expression."""

    kind: str
    columns: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    expr: str = ""
    op: str = ">"
    number: int = 0
    severity: str = "error"

    @property
    def name(self) -> str:
        detail = self.expr or (f"{self.op} {self.number}" if self.kind == "row_count" else ", ".join(self.columns))
        return f"{self.kind}({detail})"


def _distinct(columns: tuple[str, ...]) -> Column:
    # a struct counts tuples with nulls too; a single column does not
    return F.count_distinct(F.struct(*columns)) if len(columns) > 1 else F.count_distinct(columns[0])


def _is_aggregate(df: DataFrame, expr: str) -> bool:
    """Whether the analyser refuses the predicate on rows; an aggregate is evaluated once instead."""
    try:
        df.filter(F.expr(expr)).schema  # noqa: B018
    except AnalysisException:
        return True
    return False


def _expression(df: DataFrame, check: Check) -> str:
    """The predicate with ``row_count`` as the number of rows, unless the table has a column of that name."""
    if any(c.lower() == "row_count" for c in df.columns):
        return check.expr
    return re.sub(r"\brow_count\b", "count(*)", check.expr)


def _violations(df: DataFrame, check: Check) -> Column:
    """Rows that break the check, as one aggregate expression."""
    if check.kind == "row_count":
        return F.when(_COMPARE[check.op](F.count("*"), F.lit(check.number)), F.lit(0)).otherwise(F.lit(1)).cast("long")
    if check.kind == "no_nulls":
        return F.count_if(F.col(check.columns[0]).isNull())
    if check.kind in ("unique", "grain"):
        return F.count("*") - _distinct(check.columns)
    if check.kind == "accepted_values":
        # a null passes
        return F.count_if(~F.col(check.columns[0]).cast("string").isin(*check.values))
    if check.kind == "expression":
        expr = _expression(df, check)
        if expr != check.expr or _is_aggregate(df, expr):
            return F.when(F.expr(f"not ({expr})"), F.lit(1)).otherwise(F.lit(0)).cast("long")
        return F.count_if(~F.expr(expr))
    raise ValueError(f"unknown check {check.kind}")


def run_assertions(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(check, severity, passed, violations) of all checks from a single aggregate over the table."""
    counts = df.agg(*(_violations(df, c).cast("long").alias(f"v{i}") for i, c in enumerate(checks)))
    rows = F.array(*(F.struct(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), (F.coalesce(F.col(f"v{i}"), F.lit(0)) == 0).alias("passed"), F.coalesce(F.col(f"v{i}"), F.lit(0)).alias("violations")) for i, c in enumerate(checks)))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


class AssertionFailure(ValueError):
    """A check of severity error does not hold."""


def require(df: DataFrame, checks: list[Check]) -> DataFrame:
    """The frame, or an exception naming the error checks that fail."""
    bad = run_assertions(df, checks).filter("not passed and severity = 'error'").collect()
    if bad:
        raise AssertionFailure("; ".join(f"{r['check']}: {r['violations']}" for r in bad))
    return df


def failing_rows(df: DataFrame, check: Check) -> DataFrame:
    """The rows a check counts; for duplicates every row of a repeated key, and of a null key of one column."""
    if check.kind == "no_nulls":
        return df.filter(F.col(check.columns[0]).isNull())
    if check.kind == "accepted_values":
        return df.filter(~F.col(check.columns[0]).cast("string").isin(*check.values))
    if check.kind == "expression":
        expr = _expression(df, check)
        if expr != check.expr or _is_aggregate(df, expr):
            raise ValueError(f"{check.name} is of the whole table and counts no rows")
        return df.filter(~F.expr(expr))
    if check.kind in ("unique", "grain"):
        one = F.col(check.columns[0]).isNull() if len(check.columns) == 1 else F.lit(False)
        several = df.groupBy(*check.columns).agg(F.count("*").alias("__n")).filter((F.col("__n") > 1) | one)
        cond = [df[c].eqNullSafe(several[c]) for c in check.columns]
        return df.join(several, cond, "left_semi")
    raise ValueError(f"{check.kind} counts no rows")


def null_percent(df: DataFrame, column: str) -> DataFrame:
    """One row: column_name, nulls, percent of the rows (0 without rows)."""
    nulls = F.count_if(F.col(column).isNull())
    percent = F.when(F.count("*") > 0, F.round(nulls * 100.0 / F.count("*"), 2)).otherwise(F.lit(0.0))
    return df.agg(F.lit(column).alias("column_name"), nulls.alias("nulls"), percent.alias("percent"))


def unaccepted_values(df: DataFrame, check: Check, most: int = 5) -> DataFrame:
    """(value, rows) of the commonest values that an accepted_values check counts."""
    return failing_rows(df, check).groupBy(F.col(check.columns[0]).cast("string").alias("value")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "value").limit(most)


def profile_samples(df: DataFrame, most: int = 5) -> DataFrame:
    """(column_name, samples): the first values of each column as text, in order; a distinct and a bounded sort for each column."""
    parts = []
    for c in df.columns:
        first = df.select(F.col(f"`{c}`").cast("string").alias("v")).filter("v is not null").distinct().orderBy("v").limit(most)
        parts.append(first.agg(F.sort_array(F.collect_list("v")).alias("samples")).select(F.lit(c).alias("column_name"), "samples"))
    return reduce(DataFrame.union, parts)


def freshness(df: DataFrame, on: str | None, limit_seconds: int, now: datetime) -> DataFrame:
    """One row: rows, newest, age_seconds, stale. An empty table is stale; without ``on`` only that is looked at."""
    if on is None:
        return df.agg(F.count("*").alias("rows")).select("rows", F.lit(None).cast("timestamp_ntz").alias("newest"), F.lit(None).cast("long").alias("age_seconds"), (F.col("rows") == 0).alias("stale"))
    age = F.timestamp_diff("SECOND", F.col("newest"), F.lit(now).cast("timestamp_ntz"))
    out = df.agg(F.count("*").alias("rows"), F.max(F.col(on).cast("timestamp_ntz")).alias("newest")).withColumn("age_seconds", age)
    return out.withColumn("stale", (F.col("rows") == 0) | F.col("newest").isNull() | (F.col("age_seconds") > limit_seconds))


def freshness_models(models: DataFrame, sources: DataFrame, limit_hours: float, now: datetime) -> DataFrame:
    """(model, hours, stale) from models (model, last_run, min_rows, rows) and sources (model, stale): too old, a stale source, or too few rows."""
    bad = sources.groupBy("model").agg(F.max("stale").alias("source_stale"))
    hours = (F.unix_timestamp(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_timestamp(F.col("last_run").cast("timestamp"))) / 3600
    joined = models.join(bad, "model", "left").withColumn("hours", hours)
    stale = F.col("hours").isNull() | (F.col("hours") > limit_hours) | F.coalesce("source_stale", F.lit(False)) | F.coalesce(F.col("rows") < F.col("min_rows"), F.lit(False))
    return joined.select("model", "hours", stale.alias("stale"))


def _melt(df: DataFrame, make: Callable[[str, str], list[Column]], fields: list[str]) -> DataFrame:
    """One aggregate for all columns, then a row for each column."""
    wide = df.agg(F.count("*").alias("__rows"), *(x.alias(f"{i}_{f}") for i, c in enumerate(df.columns) for f, x in zip(fields, make(c, df.schema[c].dataType), strict=True)))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{i}_{f}").alias(f) for f in fields)) for i, c in enumerate(df.columns)))
    return wide.select("__rows", F.explode(rows).alias("r")).select("r.*", F.col("__rows").alias("row_count"))


def _distinct_values(approximate: bool) -> Callable[[str], Column]:
    return (lambda c: F.approx_count_distinct(f"`{c}`")) if approximate else (lambda c: F.count_distinct(f"`{c}`"))


def _dealt(df: DataFrame, approximate: bool) -> DataFrame:
    """The rows in tasks of a size, for exact counts of distinct values make each row one a column, which a task sorts."""
    return df if approximate else spread(df, df.columns, max(1, ROWS_A_TASK // max(1, len(df.columns))))


def profile_basic(df: DataFrame, approximate: bool = True) -> DataFrame:
    """(column_name, row_count, null_percent, distinct_count).

    Distinct values are counted by a sketch of fixed size for each column; exact
    counts expand the rows by column, which a large table should not ask for.
    """
    distinct = _distinct_values(approximate)
    out = _melt(_dealt(df, approximate), lambda c, _: [F.count_if(F.col(f"`{c}`").isNull()), distinct(c)], ["nulls", "distinct_count"])
    percent = F.when(F.col("row_count") > 0, F.round(F.col("nulls") * 100.0 / F.col("row_count"), 1)).otherwise(F.lit(0.0))
    return out.select("column_name", "row_count", percent.alias("null_percent"), "distinct_count")


def profile_table(df: DataFrame, approximate: bool = True) -> DataFrame:
    """profile_basic with least and greatest value as text and, for numbers, the mean to four places."""
    mean = lambda c, t: F.round(F.avg(F.col(f"`{c}`").cast("double")), 4) if isinstance(t, NumericType) else F.first(F.lit(None).cast("double"))
    out = _melt(
        _dealt(df, approximate),
        lambda c, t: [F.count_if(F.col(f"`{c}`").isNull()), _distinct_values(approximate)(c), F.min(f"`{c}`").cast("string"), F.max(f"`{c}`").cast("string"), mean(c, t)],
        ["nulls", "distinct_count", "least", "greatest", "mean"],
    )
    percent = F.when(F.col("row_count") > 0, F.round(F.col("nulls") * 100.0 / F.col("row_count"), 1)).otherwise(F.lit(0.0))
    return out.select("column_name", "row_count", percent.alias("null_percent"), "distinct_count", "least", "greatest", "mean")


def high_nulls(profile: DataFrame, percent: float = 50.0) -> DataFrame:
    return profile.filter(F.col("null_percent") > percent)


def previous_profile(history: DataFrame) -> DataFrame:
    """The second newest profile of each table (model, row_count, profiled_at)."""
    newest = Window.partitionBy("model").orderBy(F.desc("profiled_at"))
    return history.withColumn("rn", F.row_number().over(newest)).filter("rn = 2").select("model", F.col("row_count").alias("previous"))


def contract_eval(outcomes: DataFrame, escalate_after: int = 3) -> DataFrame:
    """(model, check, failures, severity) from outcomes (model, check, severity, passed, checked_at): the failures in a row up to now; so many turn a warning into an error."""
    w = Window.partitionBy("model", "check").orderBy(F.desc("checked_at"))
    streak = outcomes.withColumn("ok", F.max(F.col("passed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = streak.groupBy("model", "check").agg(F.count_if(F.col("ok") == 0).alias("failures"), F.max_by("severity", "checked_at").alias("severity"))
    return out.withColumn("severity", F.when((F.col("severity") == "warn") & (F.col("failures") >= escalate_after), "error").otherwise(F.col("severity")))


def anomalies(history: DataFrame, threshold: float = 2.0, lookback: int = 30, least: int = 3) -> DataFrame:
    """(model, metric, profiled_at, value, mean, stddev, z) of values far from the preceding ones.

    ``history``: model, metric, value, profiled_at. The baseline is the
    ``lookback`` rows before, never the row itself; fewer than ``least`` rows or
    no spread give nothing.
    """
    before = Window.partitionBy("model", "metric").orderBy("profiled_at").rowsBetween(-lookback, -1)
    v = history.select("*", F.avg("value").over(before).alias("mean"), F.stddev_pop("value").over(before).alias("stddev"), F.count("value").over(before).alias("n"))
    z = (F.col("value") - F.col("mean")) / F.col("stddev")
    return v.filter((F.col("n") >= least) & (F.col("stddev") > 0)).withColumn("z", z).filter(F.abs("z") > threshold).select("model", "metric", "profiled_at", "value", "mean", "stddev", "z")
