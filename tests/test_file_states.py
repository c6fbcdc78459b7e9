"""Files of a folder against what is known of each."""

from datetime import datetime
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from tideframe.sources import readers
from tideframe.sources.files import delete, names, rename, set_modified

NOW, THEN = datetime(2024, 6, 1), 1_700_000_000_000
SCHEMA = "id long, v string"


@pytest.fixture
def put(spark, tmp_path):
    def put(name, ids, v, at=THEN):
        made = f"{tmp_path}/made-{name}-{uuid4().hex}"
        spark.createDataFrame([(i, v) for i in ids], SCHEMA).coalesce(1).write.parquet(made)
        delete(spark, f"{tmp_path}/in/{name}.parquet")
        rename(spark, f"{made}/{next(n for n in names(spark, made) if n.endswith('.parquet'))}", f"{tmp_path}/in/{name}.parquet")
        set_modified(spark, f"{tmp_path}/in/{name}.parquet", at)

    return put


def changed(df):
    return {r["path"].rsplit("/", 1)[1].removesuffix(".parquet"): r["change"] for r in df.collect()}


def rows(df):
    return sorted((r["id"], r["v"]) for r in df.collect())


def test_added_replaced_touched_deleted(spark, tmp_path, put):
    path = f"{tmp_path}/in"
    for name, ids in (("a", [1]), ("b", [2, 3]), ("c", [4]), ("d", [5])):
        put(name, ids, "one")
    fresh, changes, state = readers.file_changes(spark, path, None, "parquet", SCHEMA, NOW)
    target = readers.settled(readers.apply_file_changes(None, fresh, changes))
    assert changed(changes) == dict.fromkeys("abcd", "added") and rows(target) == [(1, "one"), (2, "one"), (3, "one"), (4, "one"), (5, "one")]
    _, changes, same = readers.file_changes(spark, path, state, "parquet", SCHEMA, NOW)
    assert changed(changes) == {} and same.count() == 4
    put("b", [2, 30], "two", THEN + 1000)  # replaced
    put("c", [4], "one", THEN + 1000)  # written again, the same rows
    delete(spark, f"{path}/d.parquet")
    put("e", [6], "one")  # new, and no newer than the others
    fresh, changes, state = readers.file_changes(spark, path, state, "parquet", SCHEMA, NOW)
    assert changed(changes) == {"b": "replaced", "c": "touched", "d": "deleted", "e": "added"} and rows(fresh) == [(2, "two"), (6, "one"), (30, "two")]
    assert rows(readers.apply_file_changes(target, fresh, changes)) == [(1, "one"), (2, "two"), (4, "one"), (6, "one"), (30, "two")]
    assert changed(readers.file_changes(spark, path, state, "parquet", SCHEMA, NOW)[1]) == {}


def test_same_size_and_time(spark, tmp_path, put):
    path = f"{tmp_path}/in"
    put("a", [1], "one")
    state = readers.file_changes(spark, path, None, "parquet", SCHEMA, datetime(2023, 11, 14, 22, 13, 21))[2]  # looked at within a second of the change
    put("a", [2], "one")
    assert state.first()["bytes"] == readers.listed(spark, path).first()["bytes"]
    fresh, changes, _ = readers.file_changes(spark, path, state, "parquet", SCHEMA, NOW)
    assert changed(changes) == {"a": "replaced"} and rows(fresh) == [(2, "one")]
    later = state.withColumn("checked_at", F.lit(NOW).cast("timestamp"))  # looked at long after: only verify reads it again
    assert changed(readers.file_changes(spark, path, later, "parquet", SCHEMA, NOW)[1]) == {}
    assert changed(readers.file_changes(spark, path, later, "parquet", SCHEMA, NOW, verify=True)[1]) == {"a": "replaced"}


def test_other_formats_and_empty_files(spark, tmp_path):
    path = f"{tmp_path}/csv"
    spark.createDataFrame([(1, "é,x")], SCHEMA).coalesce(1).write.csv(path)
    open(f"{path}/empty.csv", "w").close()
    fresh, changes, state = readers.file_changes(spark, path, None, "csv", SCHEMA, NOW)
    assert rows(fresh) == [(1, "é,x")] and list(changed(changes).values()) == ["added"] and state.first()["rows"] == 1
    with open(f"{path}/empty.csv", "w") as f:
        f.write("2,y\n")
    fresh, changes, _ = readers.file_changes(spark, path, state, "csv", SCHEMA, NOW)
    assert changed(changes) == {"empty.csv": "added"} and rows(fresh) == [(2, "y")]
