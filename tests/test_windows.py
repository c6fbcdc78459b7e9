"""Windows as folders: only due ones are written, each is committed with its state, a run that dies is resumed."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideframe.operators import microbatch
from tideframe.operators.publish import ConflictError, read_log
from tideframe.sources.files import names

BEGIN = datetime(2024, 1, 1)


@pytest.fixture
def events(spark):
    return spark.range(240).select(F.col("id"), (F.lit(BEGIN).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("at"))


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "w")


def runs(spark, root):
    return {k: w["run"] for k, w in read_log(spark, root, microbatch.WindowLog).windows.items()}


def status(spark, root):
    return [(r["window_start"].day, r["status"], r["rows"]) for r in microbatch.state(spark, root).orderBy("window_start").collect()]


def day(n, hour=0):
    return BEGIN + timedelta(days=n - 1, hours=hour)


def test_only_due_windows_are_written(spark, events, root):
    microbatch.run_windows(spark, root, events, "at", BEGIN, day(4), "day")
    first = runs(spark, root)
    assert status(spark, root) == [(1, "done", 24), (2, "done", 24), (3, "done", 24)]
    built = microbatch.run_windows(spark, root, events, "at", BEGIN, day(5, 12), "day")
    assert built == [day(4), day(5)] and status(spark, root)[3:] == [(4, "done", 24), (5, "open", 24)]
    assert {k: v for k, v in runs(spark, root).items() if k in first} == first
    assert microbatch.run_windows(spark, root, events, "at", BEGIN, day(6), "day") == [day(5)] and status(spark, root)[4] == (5, "done", 24)
    assert microbatch.read_windows(spark, root).count() == 120
    assert sorted(r["id"] for r in microbatch.read_windows(spark, root, day(2), day(3)).collect()) == list(range(24, 48))


def test_lookback_takes_late_and_removed_rows(spark, events, root):
    microbatch.run_windows(spark, root, events.filter("id % 2 = 0"), "at", BEGIN, day(4), "day")
    built = microbatch.run_windows(spark, root, events.filter("id >= 72"), "at", BEGIN, day(4), "day", lookback=2)
    assert built == [day(2), day(3)]
    assert [x[2] for x in status(spark, root)] == [12, 0, 0] and microbatch.read_windows(spark, root).count() == 12
    gone = microbatch.sweep(spark, root)
    assert gone and microbatch.read_windows(spark, root).count() == 12


@pytest.mark.parametrize("at_once", [1, 2])
def test_dies_in_the_middle(spark, events, root, at_once):
    asked = []

    def source(a, b):
        asked.append((a, b))
        if len(asked) == 3:
            raise InterruptedError
        return events

    with pytest.raises(InterruptedError):
        microbatch.run_windows(spark, root, source, "at", BEGIN, day(9), "day", at_once=at_once)
    done = runs(spark, root)
    assert len(done) == 2 * at_once
    microbatch.run_windows(spark, root, source, "at", BEGIN, day(9), "day", at_once=at_once)
    assert asked[3][0] == day(1 + 2 * at_once) and {k: v for k, v in runs(spark, root).items() if k in done} == done
    assert microbatch.read_windows(spark, root).count() == 8 * 24


def test_failed_write_keeps_the_old_rows(spark, events, root):
    microbatch.run_windows(spark, root, events, "at", BEGIN, day(3), "day")
    bad = events.withColumn("id", F.when(F.col("id") == 30, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception):
        microbatch.run_windows(spark, root, bad, "at", BEGIN, day(3), "day", lookback=1)
    assert microbatch.read_windows(spark, root).count() == 48
    loose = [n for n in names(spark, root) if n.startswith("run=")]
    microbatch.sweep(spark, root)
    assert len([n for n in names(spark, root) if n.startswith("run=")]) <= len(loose) and microbatch.read_windows(spark, root).count() == 48


def test_two_runs_of_one_window(spark, events, root):
    def source(a, b):
        if not runs(spark, root):
            microbatch.run_windows(spark, root, events.filter("id = 0"), "at", BEGIN, day(2), "day")
        return events

    with pytest.raises(ConflictError):
        microbatch.run_windows(spark, root, source, "at", BEGIN, day(2), "day")
    assert microbatch.read_windows(spark, root).count() == 1


def test_no_rows_and_no_times(spark, events, root):
    assert microbatch.read_windows(spark, root) is None
    microbatch.run_windows(spark, root, events.withColumn("at", F.lit(None).cast("timestamp_ntz")), "at", BEGIN, day(3), "day")
    assert microbatch.read_windows(spark, root).count() == 0 and [x[1:] for x in status(spark, root)] == [("done", 0)] * 2
