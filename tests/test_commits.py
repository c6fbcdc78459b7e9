"""Several writers of one table: nothing is lost, nothing is replaced unseen, no number is given twice."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tideframe.operators import cdc, filetable, incremental, publish
from tideframe.operators.publish import ConflictError
from tideframe.sources.files import names, put_if_absent, read_text
from tideframe.streaming import stream

NOW = datetime(2024, 1, 1)


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_one_of_many_puts(spark, tmp_path):
    path = f"{tmp_path}/one.json"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: put_if_absent(spark, path, f"text {i} é"), range(8)))
    assert sum(won) == 1 and read_text(spark, path) == f"text {won.index(True)} é"
    assert names(spark, str(tmp_path)) == ["one.json"] and names(spark, f"{tmp_path}/none") == []


def test_puts_through_another_scheme(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.put.link./in", f"file://{tmp_path}")
    path = "viewfs://put/in/log/1.json"
    assert put_if_absent(spark, path, "a") and not put_if_absent(spark, path, "b") and read_text(spark, path) == "a"


class TestCommits:
    @pytest.fixture
    def root(self, tmp_path):
        return str(tmp_path / "t")

    def test_interleaved_appends_keep_all_rows(self, spark, root):
        publish.publish(spark.range(10), root, NOW)
        with ThreadPoolExecutor(6) as pool:
            versions = list(pool.map(lambda i: publish.append(spark.range(100 * i, 100 * i + 5), root, NOW), range(1, 7)))
        assert len(set(versions)) == 6
        assert ids(publish.read(spark, root)) == sorted([*range(10), *(100 * i + k for i in range(1, 7) for k in range(5))])
        last = publish.read_log(spark, root).newest
        assert last["rows"] == 40 and int(last["hash_sum"]) == publish.read(spark, root).agg(F.sum(F.xxhash64("id").cast("decimal(38,0)"))).first()[0]

    def test_append_between_read_and_commit(self, spark, root, monkeypatch):
        publish.publish(spark.range(10), root, NOW)
        real, other = publish._write, []

        def write(df, root, log):
            out = real(df, root, log)
            if not other:
                other.append(1)
                publish.append(spark.range(20, 23), root, NOW)
            return out

        monkeypatch.setattr(publish, "_write", write)
        publish.append(spark.range(10, 15), root, NOW)
        assert ids(publish.read(spark, root)) == [*range(15), 20, 21, 22]

    def test_fold_that_loses_goes_on_top(self, spark, root, monkeypatch):
        for i in range(3):
            publish.append(spark.range(i, i + 1), root, NOW)
        real, other = publish._write, []

        def write(df, root, log):
            out = real(df, root, log)
            if not other:
                other.append(1)
                publish.append(spark.range(20, 22), root, NOW)
            return out

        monkeypatch.setattr(publish, "_write", write)
        publish.append(spark.range(3, 4), root, NOW, most=3)
        assert ids(publish.read(spark, root)) == [0, 1, 2, 3, 20, 21]

    def test_newer_version_is_not_replaced(self, spark, root):
        first = publish.publish(spark.range(3), root, NOW)
        publish.publish(spark.range(4), root, NOW)
        with pytest.raises(ConflictError):
            publish.publish(spark.range(9), root, NOW, expect=first)
        with pytest.raises(ConflictError):
            publish.append(spark.range(9), root, NOW, expect=0)
        assert publish.read(spark, root).count() == 4 and publish.publish(spark.range(5), root, NOW, expect=2) == 3

    def test_log_is_folded(self, spark, root, monkeypatch):
        monkeypatch.setattr(publish, "FOLD", 4)
        for i in range(10):
            publish.append(spark.range(i, i + 1), root, NOW, tag=f"b-{i}")
        publish.cleanup(spark, root, 2, NOW)
        assert [n for n in names(spark, f"{root}/_log") if "fold" in n] == ["000000000004.fold.json", "000000000008.fold.json"]
        log = publish.read_log(spark, root)
        assert log.last == 11 and sorted(log.live) == [9, 10] and log.tags["b-0"] == 1
        assert publish.append(spark.range(9), root, NOW, tag="b-3") == 4 and ids(publish.read(spark, root)) == list(range(10))

    def test_failed_write_is_not_seen(self, spark, root):
        publish.publish(spark.range(3), root, NOW)
        with pytest.raises(Exception):
            publish.append(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), root, NOW)
        assert publish.read(spark, root).count() == 3 and publish.append(spark.range(3, 4), root, NOW) > 1

    def test_two_streams_share_one_sequence(self, spark, root, tmp_path):
        for name in ("a", "b"):
            spark.range(40).repartition(4).write.parquet(f"{tmp_path}/{name}")

        def run(name):
            source = stream.file_stream(spark, f"{tmp_path}/{name}", "id long", files=1)
            stream.stamp_stream(source, f"{tmp_path}/{name}-checkpoint", root, f"{tmp_path}/log", NOW, name)

        with ThreadPoolExecutor(2) as pool:
            list(pool.map(run, ["a", "b"]))
        held = publish.read(spark, root)
        assert sorted(r[0] for r in held.select(stream.SEQ).collect()) == list(range(1, 81))
        advances = spark.read.parquet(f"{tmp_path}/log")
        assert advances.agg(F.sum("rows")).first()[0] == 80 and advances.select("watermark").distinct().count() == advances.count()

    def test_refresh_builds_on_what_came_first(self, spark, root, tmp_path):
        spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/in")
        seen = []

        def build(held, batch):
            if not seen:
                publish.publish(spark.range(100, 101), root, NOW)
            seen.append(held is not None)
            return batch if held is None else held.union(batch)

        stream.live_refresh(stream.file_stream(spark, f"{tmp_path}/in", "id long"), f"{tmp_path}/checkpoint", root, NOW, build)
        assert seen == [False, True] and ids(publish.read(spark, root)) == [0, 1, 2, 3, 4, 100]


class TestFileTable:
    @pytest.fixture
    def root(self, spark, tmp_path):
        rows = spark.range(0, 4000, 2).select("id", (F.col("id") * 10).alias("v"))
        filetable.create(rows, str(tmp_path / "t"), ["id"], NOW, file_rows=50)
        return str(tmp_path / "t")

    def batch(self, spark, keys, kind="long"):
        return spark.createDataFrame([(k, -1) for k in keys], f"id {kind}, v long")

    def names(self, spark, root):
        return {tuple(r) for r in filetable.files(spark, root).select("folder", "name").collect()}

    def test_few_files_are_rewritten(self, spark, root):
        before = self.names(spark, root)
        done = filetable.merge(spark, root, self.batch(spark, [100, 102, 104, 3001]), ["id"], NOW)
        assert done.files == len(before) >= 30 and 1 <= done.replaced <= 2
        assert len(before & self.names(spark, root)) == len(before) - done.replaced
        held = {r["id"]: r["v"] for r in filetable.read(spark, root).collect()}
        assert len(held) == 2001 and [held[k] for k in (100, 102, 104, 3001, 106)] == [-1, -1, -1, -1, 1060]
        assert filetable.read(spark, root, 1).filter("v = -1").count() == 0

    @pytest.mark.parametrize("most", [1_000_000, 3])
    def test_same_as_the_whole_merge(self, spark, root, monkeypatch, most):
        monkeypatch.setattr(filetable, "MOST_KEYS", most)
        whole = filetable.read(spark, root)
        batch = self.batch(spark, [None, 0, 1, 2, 777, 2222, 3998, 5000])
        want = sorted(map(tuple, incremental.merge(whole, batch, ["id"]).collect()), key=str)
        filetable.merge(spark, root, batch, ["id"], NOW)
        assert sorted(map(tuple, filetable.read(spark, root).collect()), key=str) == want
        again = filetable.merge(spark, root, self.batch(spark, [None]), ["id"], NOW)
        assert again.replaced >= 1 and sorted(map(tuple, filetable.read(spark, root).collect()), key=str) == want

    def test_filters_leave_out_files_in_range(self, spark, root):
        done = filetable.merge(spark, root, self.batch(spark, [101, 501, 1501, 2501]), ["id"], NOW)
        assert done.replaced <= 1 and filetable.read(spark, root).count() == 2004

    def test_filters_that_say_yes_to_all_are_confirmed(self, spark, tmp_path, monkeypatch):
        monkeypatch.setattr(filetable, "MOST_BITS", 8)
        root = str(tmp_path / "full")
        filetable.create(self.batch(spark, range(0, 1000, 2)), root, ["id"], NOW, file_rows=50)
        done = filetable.merge(spark, root, self.batch(spark, [4, *range(1, 1000, 50)]).withColumn("v", F.lit(5).cast("long")), ["id"], NOW)
        assert done.replaced == 1 and filetable.read(spark, root).count() == 520

    def test_several_keys_and_text(self, spark, tmp_path):
        root = str(tmp_path / "k")
        rows = spark.createDataFrame([(chr(97 + i % 20), i, "old") for i in range(400)] + [(None, 1, "old"), ("é", None, "old")], "a string, b int, v string")
        filetable.create(rows, root, ["a", "b"], NOW, file_rows=10)
        batch = spark.createDataFrame([("c", 2, "new"), (None, 1, "new"), ("é", None, "new"), ("c", None, "new")], "a string, b long, v string")
        with pytest.raises(ValueError):
            filetable.merge(spark, root, batch, ["a", "b"], NOW)
        done = filetable.merge(spark, root, batch.withColumn("b", F.col("b").cast("int")), ["a", "b"], NOW)
        assert done.replaced <= 6 < done.files
        assert sorted(map(str, filetable.read(spark, root).filter("v = 'new'").select("a", "b").collect())) == sorted(map(str, batch.select("a", "b").collect()))
        assert filetable.read(spark, root).count() == 403

    def test_another_type_of_key_finds_its_files(self, spark, root):
        old = filetable.rows_of(spark, root, self.batch(spark, [100], "int"), ["id"])
        assert 100 in ids(old.select("id")) and old.count() < 200

    def test_new_columns(self, spark, root):
        filetable.merge(spark, root, self.batch(spark, [100]).withColumn("w", F.lit("x")), ["id"], NOW)
        held = filetable.read(spark, root)
        assert held.columns == ["id", "v", "w"] and held.filter("w = 'x'").count() == 1 and held.count() == 2000

    def test_replay_and_conflict(self, spark, root):
        batch, other = self.batch(spark, [100]), []

        def build(old):
            if not other:
                other.append(filetable.merge(spark, root, self.batch(spark, [102, 1]), ["id"], NOW))
            return incremental.merge(old, batch, ["id"])

        filetable.rewrite(spark, root, batch, ["id"], build, NOW, tag="b")
        assert ids(filetable.read(spark, root).filter("v = -1").select("id")) == [1, 100, 102]
        assert filetable.merge(spark, root, self.batch(spark, [4]), ["id"], NOW, tag="b").replaced == 0
        publish.cleanup(spark, root, 1, NOW)
        assert ids(filetable.read(spark, root).filter("v = -1").select("id")) == [1, 100, 102] and filetable.read(spark, root).count() == 2001

    def test_writers_of_other_keys(self, spark, root):
        with ThreadPoolExecutor(3) as pool:
            list(pool.map(lambda k: filetable.merge(spark, root, self.batch(spark, [k]), ["id"], NOW), [10, 1010, 2010]))
        assert ids(filetable.read(spark, root).filter("v = -1").select("id")) == [10, 1010, 2010]

    def test_changes_and_empty_batches(self, spark, tmp_path):
        root = str(tmp_path / "c")
        held = spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(1).cast("long").alias(cdc.SEQ), F.lit(False).alias(cdc.DELETED))
        filetable.create(held, root, ["k"], NOW, file_rows=25)
        log = spark.createDataFrame([(3, "b", "U", 2), (4, None, "D", 5), (4, "late", "U", 3), (900, "n", "I", 1)], "k long, v string, op string, lsn long")
        done = filetable.apply_changes(spark, root, log, ["k"], "lsn", "op", NOW)
        assert done.replaced <= 2
        live = filetable.read(spark, root).filter(f"not {cdc.DELETED}")
        assert live.count() == 500 and {r["k"]: r["v"] for r in live.filter("k in (3, 4, 900)").collect()} == {3: "b", 900: "n"}
        assert filetable.delete_insert(spark, root, held.limit(0), ["k"], NOW).replaced == 0 and filetable.read(spark, root).count() == 501
