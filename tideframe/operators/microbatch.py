"""Calendar micro-batches: windows of an event time, their state, and their replacement in a target.

``run`` is a pure function of a whole target. ``run_windows`` keeps the target as
folders of its own for each window: a run writes due windows only and commits them
with their state in one entry of a log, so a window's old rows are there until its
new ones are, and a run that dies goes on with the first window not committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideframe.operators.publish import ConflictError, commit, read_log
from tideframe.sources.files import delete, names

UNITS = ("hour", "day", "month", "year")
MOST_WINDOWS = 100_000
STATE = "window_start timestamp_ntz, window_end timestamp_ntz, status string, rows long"


def _stamp(value: datetime):
    return F.lit(value).cast("timestamp_ntz")


def windows(spark: SparkSession, begin: datetime, end: datetime, unit: str) -> DataFrame:
    """(window_start, window_end) of every half-open calendar window from begin's to the one that holds the last instant before end."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    step = F.expr(f"interval 1 {unit}")
    first = F.date_trunc(unit, _stamp(begin)).cast("timestamp_ntz")
    last = F.date_trunc(unit, _stamp(end) - F.expr("interval 1 microsecond")).cast("timestamp_ntz")
    count = spark.range(1).select(F.timestamp_diff(unit, first, last)).first()[0]
    if count >= MOST_WINDOWS:
        raise ValueError(f"{count + 1} windows; at most {MOST_WINDOWS}")
    if count < 0:
        return spark.createDataFrame([], "window_start timestamp_ntz, window_end timestamp_ntz")
    return spark.range(1).select(F.explode(F.sequence(first, last, step)).alias("window_start")).withColumn("window_end", F.col("window_start") + step)


def resume_start(state: DataFrame, begin: datetime, now: datetime, unit: str, lookback: int = 0) -> datetime:
    """Where the next run starts: the first closed window that is not done, else the one after the last; ``lookback`` windows earlier, never before begin."""
    closed = state.filter(F.col("window_end") <= _stamp(now))
    step = F.expr(f"interval 1 {unit}")
    start = F.coalesce(F.min(F.when(F.col("status") != "done", F.col("window_start"))), F.max("window_start") + step)
    back = F.date_trunc(unit, start).cast("timestamp_ntz") - F.expr(f"interval {int(lookback)} {unit}")
    floor = F.date_trunc(unit, _stamp(begin)).cast("timestamp_ntz")
    found = closed.agg(start.alias("s"), F.greatest(back, floor).alias("r")).first()
    return begin if found["s"] is None else found["r"]


def replace_windows(target: DataFrame | None, source: DataFrame, event_time: str, todo: DataFrame, unit: str) -> DataFrame:
    """The target with the rows of the windows in ``todo`` replaced by source's; one job for all windows."""
    start = F.date_trunc(unit, F.col(event_time)).cast("timestamp_ntz")
    named = todo.select(F.col("window_start").alias("__w"))
    fresh = source.withColumn("__w", start).join(F.broadcast(named), "__w", "left_semi").drop("__w")
    if target is None:
        return fresh
    old = target.withColumn("__w", start)
    # rows without an event time belong to no window and stay
    return old.join(F.broadcast(named), "__w", "left_anti").drop("__w").unionByName(fresh)


def run(target: DataFrame | None, source: Callable[[datetime, datetime], DataFrame] | DataFrame, event_time: str, state: DataFrame, begin: datetime, now: datetime, unit: str, lookback: int = 0) -> tuple[DataFrame | None, DataFrame]:
    """(new target, new state). Windows up to ``now`` are built; one still open is recorded ``open`` and built again next time.

    ``source`` is a frame, or a function of the half-open range that reads it.
    Windows that start after ``now`` are neither built nor recorded. Windows are
    bounded by MOST_WINDOWS, so broadcasting them is safe.
    """
    spark = state.sparkSession
    start = resume_start(state, begin, now, unit, lookback)
    todo = windows(spark, start, now, unit)
    # up to the end of the window that is open, which is built again next time
    until = F.date_trunc(unit, _stamp(now) - F.expr("interval 1 microsecond")).cast("timestamp_ntz") + F.expr(f"interval 1 {unit}")
    rows = source(start, now) if callable(source) else source.filter((F.col(event_time) >= F.date_trunc(unit, _stamp(start)).cast("timestamp_ntz")) & (F.col(event_time) < until))
    result = replace_windows(target, rows, event_time, todo, unit)
    counts = rows.groupBy(F.date_trunc(unit, F.col(event_time)).cast("timestamp_ntz").alias("window_start")).agg(F.count("*").alias("rows"))
    done = todo.join(counts, "window_start", "left").select(
        "window_start", "window_end", F.when(F.col("window_end") <= _stamp(now), "done").otherwise("open").alias("status"), F.coalesce("rows", F.lit(0)).alias("rows")
    )
    kept = state.join(done, "window_start", "left_anti")
    return result, kept.unionByName(done)


@dataclass
class WindowLog:
    """The windows built, by their start: end, status, rows, and the run whose folder has them (none for no rows)."""

    last: int = 0
    windows: dict[str, dict] = field(default_factory=dict)
    schema: dict | None = None

    def add(self, entry: dict) -> None:
        self.last += 1
        self.windows.update({w["start"]: {**w, "entry": self.last} for w in entry["windows"]})
        self.schema = entry["schema"]

    def folded(self) -> dict:
        return {"last": self.last, "windows": list(self.windows.values()), "schema": self.schema}

    @classmethod
    def of(cls, held: dict) -> WindowLog:
        return cls(held["last"], {w["start"]: w for w in held["windows"]}, held["schema"])


WINDOW = "_window"


def _folder(root: str, w: dict) -> str:
    return f"{root}/run={w['run']}/{WINDOW}={datetime.fromisoformat(w['start']):%Y%m%d%H}"


def state(spark: SparkSession, root: str) -> DataFrame:
    """The windows of a table kept by ``run_windows``: window_start, window_end, status, rows."""
    held = read_log(spark, root, WindowLog).windows
    return spark.createDataFrame([(datetime.fromisoformat(w["start"]), datetime.fromisoformat(w["end"]), w["status"], w["rows"]) for _, w in sorted(held.items())], STATE)


def read_windows(spark: SparkSession, root: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame | None:
    """The rows of all windows built, or of those that start from ``since`` on and before ``until``; other windows' files are not even listed."""
    log = read_log(spark, root, WindowLog)
    if log.schema is None:
        return None
    start = {k: datetime.fromisoformat(k) for k in log.windows}
    paths = [_folder(root, w) for k, w in sorted(log.windows.items()) if w["run"] and (since is None or start[k] >= since) and (until is None or start[k] < until)]
    schema = StructType.fromJson(log.schema)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def run_windows(spark: SparkSession, root: str, source: Callable[[datetime, datetime], DataFrame] | DataFrame, event_time: str, begin: datetime, now: datetime, unit: str, lookback: int = 0, at_once: int = 64) -> list[datetime]:
    """Build the windows that are due, so many at once, and commit them with their state; the starts of those built.

    ``source`` is a frame, or a function of a half-open range that reads it.
    Windows up to ``now`` are built; one still open is recorded ``open`` and
    built again. A window without rows loses those it had. Rows without an event
    time belong to no window. A window that another run has built since this one
    looked is refused with a ConflictError.
    """
    start = resume_start(state(spark, root), begin, now, unit, lookback)
    todo = [(r["window_start"], r["window_end"]) for r in windows(spark, start, now, unit).orderBy("window_start").collect()]
    for k in range(0, len(todo), at_once):
        part = todo[k : k + at_once]
        seen = read_log(spark, root, WindowLog).last
        lo, hi = part[0][0], part[-1][1]
        rows = source(lo, hi) if callable(source) else source
        due = rows.filter((F.col(event_time) >= _stamp(lo)) & (F.col(event_time) < _stamp(hi)))
        run = uuid.uuid4().hex
        named = due.withColumn(WINDOW, F.date_format(F.date_trunc(unit, F.col(event_time)), "yyyyMMddHH"))
        # few files a window; a window of very many rows is split
        named.hint("rebalance", WINDOW).write.partitionBy(WINDOW).parquet(f"{root}/run={run}")
        counts = {}
        if any(n.startswith(f"{WINDOW}=") for n in names(spark, f"{root}/run={run}")):
            written = spark.read.schema(StructType([*due.schema.fields]).add(WINDOW, "string")).parquet(f"{root}/run={run}")
            counts = {r[WINDOW]: r["count"] for r in written.groupBy(WINDOW).count().collect()}
        entry = {"schema": due.schema.jsonValue(), "windows": []}
        for begun, ended in part:
            n = counts.get(f"{begun:%Y%m%d%H}", 0)
            entry["windows"].append({"start": begun.isoformat(), "end": ended.isoformat(), "status": "done" if ended <= now else "open", "rows": n, "run": run if n else None})

        def make(log: WindowLog, entry=entry, seen=seen) -> dict:
            if any(log.windows.get(w["start"], {}).get("entry", 0) > seen for w in entry["windows"]):
                raise ConflictError("another run has built these windows")
            return entry

        try:
            commit(spark, root, make, WindowLog)
        except ConflictError:
            delete(spark, f"{root}/run={run}")
            raise
    return [s for s, _ in todo]


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Delete folders that no window points to, left by runs that died or were replaced; only while no run is at work."""
    used = {_folder(root, w) for w in read_log(spark, root, WindowLog).windows.values() if w["run"]}
    gone = []
    for run in (n for n in names(spark, root) if n.startswith("run=")):
        there = [f"{root}/{run}/{n}" for n in names(spark, f"{root}/{run}") if n.startswith(f"{WINDOW}=")]
        loose = [p for p in there if p not in used]
        gone += [f"{root}/{run}"] if len(loose) == len(there) else loose
    for path in gone:
        delete(spark, path)
    return gone
