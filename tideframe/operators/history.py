"""Analytics over the log of builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def robust_zscore(df: DataFrame, group: list[str], value: str, order: str, lookback: int = 20, least: int = 5) -> DataFrame:
    """Each row with median, mad, history and z over the ``lookback`` rows before it.

    z = (value - median) / max(1.4826 * mad, 5 % of the median, 1e-9); rows with
    fewer than ``least`` before them are left out.
    """
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(-lookback, -1)
    past = df.withColumn("__past", F.sort_array(F.collect_list(F.col(value).cast("double")).over(w))).withColumn("history", F.size("__past")).filter(F.col("history") >= least)

    def median(array):
        n = F.size(array)
        low, high = F.get(array, ((n - 1) / 2).cast("int")), F.get(array, (n / 2).cast("int"))
        return (low + high) / 2

    out = past.withColumn("median", median(F.col("__past"))).withColumn("mad", median(F.sort_array(F.transform("__past", lambda x: F.abs(x - F.col("median"))))))
    spread = F.greatest(1.4826 * F.col("mad"), 0.05 * F.col("median"), F.lit(1e-9))
    return out.withColumn("z", (F.col(value) - F.col("median")) / spread).drop("__past")


def regressions(builds: DataFrame, threshold: float = 3.5, ratio: float = 1.5, delta_ms: float = 500.0, lookback: int = 20, least: int = 5) -> DataFrame:
    """Builds (model, built_at, duration_ms, rows_in) far slower than before, and also slower for each row they read; no ratio to a median of 0."""
    slow = robust_zscore(builds, ["model"], "duration_ms", "built_at", lookback, least)
    slow = slow.filter((F.col("z") >= threshold) & (F.col("duration_ms") >= ratio * F.col("median")) & (F.col("duration_ms") - F.col("median") >= delta_ms))
    per = builds.filter("rows_in > 0").withColumn("per_row", F.col("duration_ms") / (F.col("rows_in") / 1000))
    per = robust_zscore(per, ["model"], "per_row", "built_at", lookback, least).select("model", "built_at", F.col("z").alias("row_z"), F.try_divide("per_row", "median").alias("row_ratio"))
    both = slow.join(per, ["model", "built_at"], "left").filter(F.col("row_z").isNull() | ((F.col("row_z") >= threshold) & (F.coalesce("row_ratio", F.lit(ratio)) >= ratio)))
    return both.select("model", "built_at", "duration_ms", "median", F.round("z", 2).alias("z"), F.round(F.try_divide("duration_ms", "median"), 2).alias("ratio"))


def incremental_candidates(builds: DataFrame, most_growth: float = 0.2, big: int = 0, least: int = 3) -> DataFrame:
    """(model, builds, rows, mean_growth) of tables that never lost rows and grow a little each build (model, built_at, rows_out)."""
    w = Window.partitionBy("model").orderBy("built_at")
    steps = builds.filter("rows_out is not null").withColumn("before", F.lag("rows_out").over(w))
    growth = F.avg(F.when(F.col("before") > 0, (F.col("rows_out") - F.col("before")) / F.col("before")))
    out = steps.groupBy("model").agg(F.count("*").alias("builds"), F.max_by("rows_out", "built_at").alias("rows"), growth.alias("mean_growth"), F.min(F.col("rows_out") - F.col("before")).alias("worst"))
    return out.filter((F.col("builds") >= least) & (F.col("worst") >= 0) & (F.col("mean_growth") > 0) & (F.col("mean_growth") <= most_growth) & (F.col("rows") >= big)).select("model", "builds", "rows", "mean_growth")


def run_metrics(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statuses of the last run with mean duration, the ten slowest models on average) from (run_id, model, status, duration_ms, started_at)."""
    last = log.groupBy("run_id").agg(F.max("started_at").alias("at")).orderBy(F.desc("at"), F.desc("run_id")).limit(1)
    status = log.join(F.broadcast(last), "run_id", "left_semi").groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"))
    slowest = log.groupBy("model").agg(F.round(F.avg("duration_ms"), 3).alias("mean_ms")).orderBy(F.desc("mean_ms"), "model").limit(10)
    return status, slowest
