"""Small files put together: sizes, partitions, rows, and runs that die half way."""

import pytest
from pyspark.sql import functions as F

from tideframe.sources import writers
from tideframe.sources.readers import listed


def test_first_fit():
    files = [("a/1", 10), ("a/2", 90), ("a/3", 30), ("a/4", 25), ("a/5", 49), ("b/1", 5), ("b/2", 60), ("c/1", 3), ("c/2", 3)]
    assert sorted(map(sorted, writers.pack_small(files, 100))) == [["a/1", "a/3", "a/5"], ["c/1", "c/2"]]
    assert writers.pack_small([], 100) == [] and writers.pack_small([("a/1", 1)], 100) == []
    for paths in writers.pack_small([(f"p/{i}", 1 + i * 7 % 40) for i in range(100)], 100):
        assert 1 < len(paths) and sum(1 + int(p[2:]) * 7 % 40 for p in paths) <= 100


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(4000).select("id", (F.col("id") % 3).alias("p"), F.md5(F.col("id").cast("string")).alias("v"))
    rows.filter("id < 3000").coalesce(1).write.partitionBy("p").parquet(path)
    rows.filter("id >= 3000").repartition(8).write.mode("append").partitionBy("p").parquet(path)
    return path


def state(spark, path):
    return {r["path"]: (r["bytes"], r["modified_at"]) for r in listed(spark, path).collect()}


def rows(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("id", "p", "v").collect()))


def test_large_files_stay(spark, folder):
    before, held = rows(spark, folder), state(spark, folder)
    largest = max(b for b, _ in held.values())
    taken, made = writers.compact_small(spark, folder, target=largest)
    after = state(spark, folder)
    assert taken == 24 and made == 3 and rows(spark, folder) == before
    assert {p: s for p, s in held.items() if 2 * s[0] >= largest} == {p: after[p] for p, s in held.items() if 2 * s[0] >= largest}
    assert all(b <= 1.5 * largest for b, _ in after.values()) and writers.compact_small(spark, folder, target=100) == (0, 0)


def test_dies_half_way(spark, folder, monkeypatch):
    before, target = rows(spark, folder), max(b for b, _ in state(spark, folder).values())
    real, left = writers.rename, [1]

    def rename(*a):
        left[0] -= 1
        if left[0] < 0:
            raise InterruptedError
        real(*a)

    monkeypatch.setattr(writers, "rename", rename)
    with pytest.raises(InterruptedError):
        writers.compact_small(spark, folder, target=target)
    monkeypatch.setattr(writers, "rename", real)
    writers.compact_small(spark, folder, target=target)
    assert rows(spark, folder) == before and len(state(spark, folder)) == 6


def test_bins_of_one_task_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(4000).select("id", F.lit(0).alias("p"), F.md5(F.col("id").cast("string")).alias("v")).repartition(40).write.partitionBy("p").parquet(path)
    before, largest = rows(spark, path), max(b for b, _ in state(spark, path).values())
    taken, made = writers.compact_small(spark, path, target=3 * largest)
    assert taken >= 36 and made >= 8 and len(state(spark, path)) == made + 40 - taken and rows(spark, path) == before
