"""Properties of the operators on rows that key-based code has to be tried with."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideframe.functions import masks
from tideframe.operators import cdc, diff, govern, history, incremental, joins, keys, metrics, microbatch, publish, quality, schema, scd2
from tideframe.operators.keys import DuplicateKeyError, row_hash, table_checksum
from tideframe.sources import readers
from tideframe.sources.files import claim
from tideframe.streaming import stream

T = [datetime(2024, 1, day) for day in range(1, 9)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")


class TestIncremental:
    def test_merge_null_key_and_insert(self, spark, target):
        batch = spark.createDataFrame([(2, "B"), (None, "N"), (3, "c")], "id int, v string")
        assert rows(incremental.merge(target, batch, ["id"])) == rows(spark.createDataFrame([(1, "a"), (2, "B"), (None, "N"), (3, "c")], "id int, v string"))

    def test_merge_replay_changes_nothing(self, spark, target):
        batch = spark.createDataFrame([(2, "B")], "id int, v string")
        once = incremental.merge(target, batch, ["id"])
        assert rows(incremental.merge(once, batch, ["id"])) == rows(once)

    def test_merge_refuses_duplicates(self, spark, target):
        with pytest.raises(DuplicateKeyError):
            incremental.merge(target, spark.createDataFrame([(2, "x"), (2, "y")], "id int, v string"), ["id"])

    def test_delete_insert_keeps_all_staging_rows(self, spark, target):
        batch = spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string")
        assert rows(incremental.delete_insert(target, batch, ["id"])) == [(1, "x"), (1, "y"), (2, "b"), (None, "n")]

    def test_empty_batch(self, spark, target):
        for f in (incremental.merge, incremental.delete_insert):
            assert rows(f(target, target.limit(0), ["id"])) == rows(target)

    def test_null_partition_is_replaced(self, spark, target):
        batch = spark.createDataFrame([(None, "new")], "id int, v string")
        assert rows(incremental.partition_overwrite(target, batch, "id")) == [(1, "a"), (2, "b"), (None, "new")]

    def test_watermark_of_empty_target_takes_all(self, target):
        assert incremental.new_rows(target, target.limit(0), "id", keyed=True).count() == 3

    def test_filter_reaches_the_scan(self, spark, tmp_path):
        path = str(tmp_path / "t")
        spark.range(100).write.parquet(path)
        df = spark.read.parquet(path)
        plan = incremental.new_rows(df, df.filter("id < 50"), "id", keyed=True)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(id,49)" in plan


class TestSchema:
    def test_policies(self, spark, target):
        wider = target.withColumn("w", F.lit(1))
        old, new = schema.evolve(target, wider)
        assert old.columns == new.columns == ["id", "v", "w"]
        with pytest.raises(schema.SchemaChangeError):
            schema.evolve(target, wider, "fail")
        with pytest.raises(schema.SchemaChangeError):
            schema.evolve(target, target.drop("v"))
        old, new = schema.evolve(target, wider, "ignore")
        assert new.columns == ["id", "v"]
        old, new = schema.evolve(target, wider.drop("v"), "sync_all_columns")
        assert old.columns == ["id", "w"]

    def test_ignore_refuses_lossy_casts(self, spark, target):
        with pytest.raises(schema.SchemaChangeError):
            schema.evolve(target, target.withColumn("id", F.col("id").cast("double")), "ignore")

    def test_kinds(self):
        assert schema.change_kind("int", "bigint") == "widened"
        assert schema.change_kind("double", "decimal(10,2)") == "widened"
        assert schema.change_kind("int", "double") == "changed"
        assert schema.change_kind("bigint", "int") == "narrowed"


class TestScd2:
    def snap(self, spark, *r):
        return spark.createDataFrame(list(r), "id int, v string")

    def test_replay_and_return(self, spark):
        a, b = self.snap(spark, (1, "a"), (None, "x")), self.snap(spark, (1, "b"), (None, "x"))
        h = scd2.apply(None, a, ["id"], T[0])
        assert rows(scd2.apply(h, a, ["id"], T[1])) == rows(h)
        h = scd2.apply(scd2.apply(h, b, ["id"], T[1]), a, ["id"], T[2])
        assert h.filter("id = 1").count() == 3 and h.filter("id is null").count() == 1
        assert rows(scd2.as_of(h, T[1]).select("id", "v")) == [(1, "b"), (None, "x")]

    def test_tombstone_and_reopening(self, spark):
        a = self.snap(spark, (1, "a"), (2, "b"))
        h = scd2.apply(None, a, ["id"], T[0], hard_deletes="new_record")
        h = scd2.apply(h, self.snap(spark, (1, "a")), ["id"], T[1], hard_deletes="new_record")
        assert rows(h.filter("id = 2").select("is_current", "is_deleted")) == [(False, False), (True, True)]
        again = scd2.apply(h, self.snap(spark, (1, "a")), ["id"], T[2], hard_deletes="new_record")
        assert rows(again) == rows(h)
        h = scd2.apply(h, a, ["id"], T[3], hard_deletes="new_record")
        assert rows(h.filter("id = 2 and is_current").select("valid_from", "is_deleted")) == [(T[3], False)]

    def test_duplicate_key_is_refused(self, spark):
        with pytest.raises(DuplicateKeyError):
            scd2.apply(None, self.snap(spark, (1, "a"), (1, "b")), ["id"], T[0])


class TestCdc:
    def test_late_events_after_delete_stay_gone(self, spark):
        log = "id int, v string, op string, lsn long"
        target, tombs = spark.createDataFrame([], "id int, v string, _seq long"), spark.createDataFrame([], "id int, _seq long")
        steps = [[(1, "a", "I", 1), (2, "x", "I", 2)], [(1, None, "D", 5)], [(1, "late", "U", 3)], [(1, "back", "I", 6)]]
        seen = []
        for s in steps:
            target, tombs = cdc.apply_hard(target, tombs, spark.createDataFrame(s, log), ["id"], "lsn", "op")
            seen.append((rows(target), rows(tombs)))
        assert seen[1] == seen[2] == ([(2, "x", 2)], [(1, 5)])
        assert seen[3] == ([(1, "back", 6), (2, "x", 2)], [])

    def test_columns_the_target_lacks(self, spark):
        target, tombs = spark.createDataFrame([(1, "a", 1)], "id int, v string, _seq long"), spark.createDataFrame([], "id int, _seq long")
        change = spark.createDataFrame([(2, "b", "new", "I", 2)], "id int, v string, w string, op string, lsn long")
        apply = lambda policy: cdc.apply_hard(target, tombs, change, ["id"], "lsn", "op", policy)[0]
        assert rows(apply("append").select("id", "w")) == [(1, None), (2, "new")]
        assert apply("ignore").columns == ["id", "v", "_seq"] and apply("ignore").count() == 2
        with pytest.raises(ValueError):
            apply("fail")
        soft = cdc.apply_soft(target.selectExpr("*", "false as _deleted"), change, ["id"], "lsn", "op")
        assert rows(soft.select("id", "w")) == [(1, None), (2, "new")]

    def test_ties_prefer_the_delete_and_null_is_last(self, spark):
        c = spark.createDataFrame([(1, "I", 3), (1, "d", 3), (2, "I", None), (2, "U", 1), (None, "I", 1)], "id int, op string, lsn long")
        assert rows(cdc.dedupe(c, ["id"], "lsn", "op")) == [(1, "d", 3), (2, "U", 1), (None, "I", 1)]


    def test_ties_of_two_batches_are_those_of_one(self, spark):
        log = "id int, v string, op string, lsn long"
        changes = [(1, "a", "U", 3), (1, "b", "D", 3), (2, "c", "U", 4), (2, "d", "U", 4), (3, "e", "D", 5), (3, "f", "U", 5)]
        held = spark.createDataFrame([], "id int, v string, _seq long, _deleted boolean")
        want = rows(cdc.apply_changes(held, spark.createDataFrame(changes, log), ["id"], "lsn", "op"))
        assert want == [(1, None, 3, True), (2, "d", 4, False), (3, None, 5, True)]
        for dealt in (changes[::2], changes[1::2]), (changes[1::2], changes[::2]):
            both, soft, tombs = held, held, held.select("id", "_seq")
            target = held.drop("_deleted")
            for batch in dealt:
                batch = spark.createDataFrame(batch, log)
                both, soft = cdc.apply_changes(both, batch, ["id"], "lsn", "op"), cdc.apply_soft(soft, batch, ["id"], "lsn", "op", "ignore")
                target, tombs = cdc.apply_hard(target, tombs, batch, ["id"], "lsn", "op")
            assert rows(both) == want and rows(target) == [(2, "d", 4)] and rows(tombs) == [(1, 3), (3, 5)]
            assert rows(soft) == [(1, "b", 3, True), (2, "d", 4, False), (3, "e", 5, True)]


class TestTasks:
    def test_profile_and_table_function_deal_rows(self, spark, monkeypatch):
        df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("v"), F.create_map(F.lit(1), "id").alias("m")).coalesce(1)
        monkeypatch.setattr(quality, "ROWS_A_TASK", 300)
        assert quality._dealt(df, True) is df and quality._dealt(df, False).rdd.getNumPartitions() == 10
        found = quality.profile_basic(df.drop("m"), approximate=False)
        assert rows(found.select("column_name", "row_count", "distinct_count")) == [("id", 1000, 1000), ("v", 1000, 7)]
        dealt = keys.spread(df, ["id", "m"], 100)
        assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 1000 and keys.spread(df, ["id"], 1000) is df


class TestMicrobatch:
    def test_windows_are_half_open(self, spark):
        w = microbatch.windows(spark, datetime(2024, 1, 30, 5), datetime(2024, 3, 1), "month")
        assert rows(w) == [(datetime(2024, 1, 1), datetime(2024, 2, 1)), (datetime(2024, 2, 1), datetime(2024, 3, 1))]

    def test_open_window_is_built_again(self, spark):
        e = spark.createDataFrame([(i, T[i]) for i in range(6)], "id int, at timestamp_ntz")
        state = spark.createDataFrame([], microbatch.STATE)
        target, state = microbatch.run(None, e.filter("id < 4"), "at", state, T[0], datetime(2024, 1, 4, 12), "day")
        assert state.filter("status = 'open'").count() == 1
        assert microbatch.resume_start(state, T[0], datetime(2024, 1, 6, 12), "day") == T[3]
        target, state = microbatch.run(target, e, "at", state, T[0], datetime(2024, 1, 6, 12), "day")
        assert target.count() == 6 and state.filter("status = 'done'").count() == 5

    def test_too_many_windows(self, spark):
        with pytest.raises(ValueError):
            microbatch.windows(spark, datetime(1900, 1, 1), datetime(2024, 1, 1), "hour")


def test_row_hash_tells_values_from_nulls_and_separators(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "N"), ("N", None), ("\\", "|")], "x string, y string")
    assert df.select(row_hash(["x", "y"]).alias("h")).distinct().count() == 5


def test_checksum_counts_copies(spark):
    df = spark.range(5)
    assert table_checksum(df).first() != table_checksum(df.union(df)).first()


def test_asof_takes_the_last_and_ties(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "a"), (1, 5, "b"), (1, 6, "c")], "k int, r int, v string")
    assert rows(joins.asof(left, right, ["k"], "t", "r", ["v"])) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]


def test_expression_with_null_passes(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    assert quality.run_assertions(df, [quality.Check("expression", expr="x > 0")]).first()["passed"]
    assert quality.run_assertions(df, [quality.Check("unique", ("x",))]).first()["violations"] == 1


def test_unit_compare_by_place(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "i int, v string")
    b = spark.createDataFrame([(1, "a"), (2, "c")], "i int, v string")
    assert rows(diff.unit_compare(a, b, "i").select("v", "side")) == [("b", "missing"), ("c", "unexpected")]


def test_masks_of_null_and_shape(spark):
    df = spark.createDataFrame([("+47 99 88 77 66", None)], "p string, n string")
    r = df.select(masks.shape_digits(F.col("p")).alias("p"), masks.email(F.col("n")).alias("e"), masks.ip_address(F.col("n")).alias("i")).first()
    assert (r["p"], r["e"], r["i"]) == ("+** ** ** 77 66", "***", None)


def test_row_policy_binds_values(spark):
    df = spark.createDataFrame([("o'x",), ("y",)], "owner string")
    p = [govern.RowPolicy("owner = user()")]
    assert rows(govern.apply_row_policies(df, p, govern.Viewer("o'x", "analyst"))) == [("o'x",)]
    assert govern.apply_row_policies(df, [govern.RowPolicy("owner = attr('gone')")], govern.Viewer("u", "analyst")).count() == 0
    assert govern.apply_row_policies(df, p, govern.Viewer("u", "admin")).count() == 2


def test_row_policy_of_users_exemptions_and_attributes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "x string, n int")
    seen = lambda policy, viewer: sorted(r[0] for r in govern.apply_row_policies(df, [policy], viewer).collect())
    kim = govern.Viewer("kim", "analyst", {"X": "a", "Many": ["a", "b"], "one": 1})
    none = "false"
    assert seen(govern.RowPolicy(none, users=("lee",)), kim) == ["a", "b"] and seen(govern.RowPolicy(none, ("guest",), ("kim",)), kim) == []
    assert seen(govern.RowPolicy(none, exempt_users=("kim",)), kim) == seen(govern.RowPolicy(none, exempt_roles=("analyst",)), kim) == seen(govern.RowPolicy(none, enabled=False), kim) == ["a", "b"]
    assert seen(govern.RowPolicy(none, exempt_roles=()), govern.Viewer("root", "admin")) == []
    assert seen(govern.RowPolicy("x = attr('x')"), kim) == ["a"] and seen(govern.RowPolicy("x = attr('many')"), kim) == []
    assert seen(govern.RowPolicy("array_contains(attr_list('MANY'), x)"), kim) == ["a", "b"] and seen(govern.RowPolicy("array_contains(attr_list('one'), cast(n as string))"), kim) == ["a"]
    assert seen(govern.RowPolicy("array_contains(attr_list('gone'), x)"), kim) == [] == seen(govern.RowPolicy("x = attr()"), kim)


def test_metric_rules(spark):
    df = spark.createDataFrame([("a", T[0], 1.0), ("b", T[1], 2.0)], "d string, at timestamp_ntz, v double")
    m = metrics.Metric("total", "sum(v)", ("d",), "at")
    assert metrics.metric_query(df, m, ["d", "d"], "day").columns == ["day", "d", "total"]
    assert rows(metrics.metric_query(df, m, where=[("at", ">=", T[1])])) == [(2.0,)]
    for bad in ({"where": [("d", "in", [None])]}, {"where": [("d", "not in", [])]}, {"where": [("v", "=", 1)]}, {"where": [("d", "like", "x")]}, {"dimensions": ["d"], "order_by": [("v", True)]}, {"limit": 0}, {"limit": True}):
        with pytest.raises(ValueError):
            metrics.metric_query(df, m, **bad)


def test_regression_after_a_history_of_zeros(spark):
    b = spark.createDataFrame([("m", T[0] + timedelta(days=i), 0.0 if i < 8 else 5000.0, None) for i in range(9)], "model string, built_at timestamp_ntz, duration_ms double, rows_in long")
    assert [r["duration_ms"] for r in history.regressions(b).collect()] == [5000.0]


def test_row_count_is_a_whole_name(spark):
    df = spark.createDataFrame([(1, 5), (2, -1)], "row_count_total int, x int")
    found = rows(quality.run_assertions(df, [quality.Check("expression", expr=e) for e in ("row_count_total > 0", "row_count = 2", "row_count > 2")]).select("passed", "violations"))
    assert sorted(found) == [(False, 1), (True, 0), (True, 0)]
    own = df.withColumnRenamed("x", "row_count")
    assert quality.run_assertions(own, [quality.Check("expression", expr="row_count > 0")]).first()["violations"] == 1


def test_null_key_is_listed(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int")
    assert sorted(str(r[0]) for r in quality.failing_rows(df, quality.Check("unique", ("x",))).collect()) == ["2", "2", "None"]


def test_asof_in_ranges_of_time(spark):
    left = spark.createDataFrame([(k, t) for k in (1, 2, None) for t in (0, 3, 7, 12, 25, 99)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 11, "b"), (2, 98, "c"), (None, 3, "d"), (1, 11, "B")], "k int, r int, v string")
    whole = rows(joins.asof(left, right, ["k"], "t", "r", ["v", "r"]))
    assert all(rows(joins.asof(left, right, ["k"], "t", "r", ["v", "r"], width=w)) == whole for w in (1, 5, 10, 1000))


def test_append_writes_its_rows_alone(spark, tmp_path):
    root = str(tmp_path / "t")
    publish.publish(spark.range(3), root, T[0])
    assert publish.append(spark.range(3, 5), root, T[1], tag="x") == 2 == publish.append(spark.range(9), root, T[1], tag="x")
    assert sorted(r[0] for r in publish.read(spark, root).collect()) == [0, 1, 2, 3, 4] and publish.read(spark, root, 1).count() == 3
    held = publish.manifest(spark, root).filter("version = 2").first()
    whole = table_checksum(spark.range(5)).first()
    assert held["folders"] == [1, 2] and (held["rows"], held["hash_sum"], held["hash_xor"]) == (5, str(whole[1]), whole[2])
    assert publish.append(spark.range(5, 6), root, T[2], most=2) == 3
    assert publish.manifest(spark, root).filter("version = 3").first()["folders"] == [3] and publish.read(spark, root).count() == 6
    publish.cleanup(spark, root, 1, T[3])
    assert publish.read(spark, root).count() == 6


def test_cleanup_keeps_folders_in_use(spark, tmp_path):
    root = str(tmp_path / "t")
    publish.publish(spark.range(3), root, T[0])
    publish.append(spark.range(3, 5), root, T[1])
    publish.cleanup(spark, root, 1, T[2])
    assert publish.read(spark, root).count() == 5


def test_writers_never_share_a_number(spark, tmp_path):
    root = str(tmp_path / "t")
    publish.publish(spark.range(3), root, T[0])
    assert claim(spark, f"{root}/_claims/2") and not claim(spark, f"{root}/_claims/2")  # another writer is at work on 2
    assert publish.publish(spark.range(4), root, T[1]) == 3


def test_metric_refuses_unknown_dimensions(spark):
    with pytest.raises(ValueError):
        metrics.metric_query(spark.range(1), metrics.Metric("m", "count(*)"), ["x"])


def test_publish_replay_and_failed_write(spark, tmp_path):
    root = str(tmp_path / "t")
    assert publish.publish(spark.range(3), root, T[0], tag="b-1") == 1
    assert publish.publish(spark.range(9), root, T[1], tag="b-1") == 1
    spark.range(5).write.parquet(f"{root}/version=2")  # a write that never reached the manifest
    assert publish.read(spark, root).count() == 3
    assert publish.publish(spark.range(4), root, T[1], tag="b-2") == 2
    assert publish.read(spark, root).count() == 4


def test_stamp_is_dense(spark):
    df, last = stream.stamp(spark.range(100).repartition(5), 10)
    assert last == 110 and sorted(r[0] for r in df.select("_seq").collect()) == list(range(11, 111))


def test_empty_seed(spark, tmp_path):
    (tmp_path / "s.csv").write_text("")
    df, _ = readers.load_seed(spark, str(tmp_path / "s.csv"))
    assert df.columns == ["empty_file"]


def test_infer_payload(spark):
    inbox = spark.createDataFrame([("1", None, '{"a": 1}'), ("2", None, '{"b": "x"}')], "id string, received_at string, payload string")
    assert readers.flatten_inbox(inbox, readers.infer_payload(inbox)).columns == ["id", "received_at", "a", "b"]


def test_jdbc_options():
    o = readers.jdbc_options("jdbc:x", "t", "id", (0, 9), 3)
    assert o["numPartitions"] == "3" and o["upperBound"] == "9"
