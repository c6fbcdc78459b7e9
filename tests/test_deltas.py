"""Gold tables under changes of silver, and streams of changes against batches of them."""

import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideframe.operators import cdc, filetable, publish
from tideframe.streaming import deltas, stream

NOW = datetime(2024, 1, 1)
ROW = "id long, g string, v long, op string"


def rebuilt(batches, keep=lambda v: True):
    silver = {}
    for batch in batches:
        for k, g, v, op in batch:
            silver.pop(k, None)
            if op != "D":
                silver[k] = (g, v)
    gold = {}
    for g, v in silver.values():
        if keep(v):
            n, s = gold.get(g, (0, 0))
            gold[g] = (n + 1, s + (v or 0))
    return silver, gold


def land(spark, path, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, **options):
    source = stream.file_stream(spark, f"{tmp_path}/in", ROW, files=1)
    deltas.retract_refresh(source, f"{tmp_path}/check", f"{tmp_path}/silver", f"{tmp_path}/gold", NOW, ["id"], ["g"], ["v"], op="op", **options)


def gold_of(spark, tmp_path):
    return {r["g"]: (r[deltas.ROWS], int(r["v"])) for r in deltas.retracted(spark, f"{tmp_path}/gold", ["g"], ["v"]).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_gold_is_that_of_a_rebuild(spark, tmp_path, seed):
    rng = random.Random(seed)
    batches = []
    for _ in range(4):
        ids = rng.sample([None, *range(12)], 7)
        batches.append([(k, rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-5, 50)]), "D" if rng.random() < 0.3 else "U") for k in ids])
        land(spark, f"{tmp_path}/in", batches[-1])
        run(spark, tmp_path, where="v > 0", most=3)
        silver, gold = rebuilt(batches, lambda v: v is not None and v > 0)
        assert gold_of(spark, tmp_path) == gold
        assert {r["id"]: (r["g"], r["v"]) for r in filetable.read(spark, f"{tmp_path}/silver").collect()} == silver


def test_dies_between_silver_and_gold(spark, tmp_path, monkeypatch):
    land(spark, f"{tmp_path}/in", [(1, "a", 5, "I"), (2, "b", 7, "I")])
    run(spark, tmp_path)
    land(spark, f"{tmp_path}/in", [(1, "b", 6, "U"), (2, None, None, "D"), (3, "a", 1, "I")])
    real = deltas.append
    monkeypatch.setattr(deltas, "append", lambda *a, **k: (_ for _ in ()).throw(InterruptedError()))
    with pytest.raises(Exception):
        run(spark, tmp_path)
    assert filetable.read(spark, f"{tmp_path}/silver").count() == 2 and gold_of(spark, tmp_path) == {"a": (1, 5), "b": (1, 7)}
    monkeypatch.setattr(deltas, "append", real)
    run(spark, tmp_path)
    assert gold_of(spark, tmp_path) == {"a": (1, 1), "b": (1, 6)}
    assert publish.read_log(spark, f"{tmp_path}/gold").last == 2


def test_sums_of_floats_are_refused(spark):
    rows = spark.createDataFrame([(1, 0.1)], "g int, v double")
    with pytest.raises(ValueError):
        deltas.signed_sums(None, rows, ["g"], ["v"])
    exact = rows.withColumn("v", F.col("v").cast("decimal(10,2)"))
    assert deltas.signed_sums(exact, exact, ["g"], ["v"]).count() == 0
    assert deltas.signed_sums(None, exact, ["g"], ["v"]).first()["v"] == Decimal("0.1")


@pytest.mark.parametrize("most", [2, 16])
def test_stream_of_changes_is_as_its_batches(spark, tmp_path, most):
    """Repeated, late, unordered changes and deletes; the same rule for both."""
    rng = random.Random(most)
    held = spark.createDataFrame([], "id int, v string, _seq long, _deleted boolean")
    schema = "id int, v string, op string, lsn long"
    for k in range(5):
        rows = [(rng.choice([None, 1, 2, 3, 4]), f"{k}-{i}", rng.choice("IUD"), rng.choice([None, 1, 2, 3, 4, 5, 6])) for i in range(6)]
        batch = spark.createDataFrame(rows, schema)
        # one last change a key, so that ties within a batch do not decide
        batch = cdc.dedupe(batch, ["id"], "lsn", "op")
        batch = spark.createDataFrame(batch.collect(), schema)
        held = spark.createDataFrame(cdc.apply_changes(held, batch, ["id"], "lsn", "op").collect(), held.schema)
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.cdc_refresh(stream.file_stream(spark, f"{tmp_path}/in", schema, files=1), f"{tmp_path}/check", f"{tmp_path}/t", NOW, ["id"], ["v"], "lsn", "op", most=most)
        live = sorted(map(tuple, stream.cdc_rows(spark, f"{tmp_path}/t", ["id"]).select("id", "v", "_seq").collect()), key=str)
        assert live == sorted(map(tuple, held.filter("not _deleted").select("id", "v", "_seq").collect()), key=str)


def test_a_batch_of_one_file_is_dealt_to_tasks(spark, tmp_path, monkeypatch):
    from tideframe.operators import keys
    from tideframe.streaming import deltas, stream

    seen, real, at = [], deltas.require_unique, str(tmp_path)
    monkeypatch.setattr(keys, "ROWS_A_TASK", 10, raising=False)
    monkeypatch.setattr(deltas, "require_unique", lambda batch, k: (seen.append(batch.rdd.getNumPartitions()), real(batch, k)))
    spark.range(95).selectExpr("id", "id % 3 AS g", "id AS n").coalesce(1).write.parquet(f"{at}/landing")
    deltas.retract_refresh(stream.file_stream(spark, f"{at}/landing", "id long, g long, n long"), f"{at}/checkpoint", f"{at}/silver", f"{at}/gold", NOW, ["id"], ["g"], ["n"])
    assert seen == [10] and {r["g"]: r["n_rows"] for r in deltas.retracted(spark, f"{at}/gold", ["g"], ["n"]).collect()} == {0: 32, 1: 32, 2: 31}
