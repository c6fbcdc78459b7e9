"""What is inherited along edges: chains, diamonds, circles, nodes that stop it."""

import pytest
from pyspark.sql import functions as F

from tideframe.operators import govern
from tideframe.operators.closure import propagate
from tideframe.streaming import stream


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, derived string")


def masks(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, method string, exempt array<string>")


def found(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_three_steps_and_a_diamond(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d"), ("m", "x"), ("d", "end"), ("other", "alone"))
    m = masks(spark, ("a", "email", ["admin", "steward"]), ("m", "null", ["admin", "auditor"]))
    got = found(govern.strongest_mask(e, m))
    assert got == {
        "b": ("email", ["admin", "steward"]), "c": ("email", ["admin", "steward"]),
        "x": ("null", ["admin"]), "d": ("null", ["admin"]), "end": ("null", ["admin"]),
    }


def test_own_masks_and_declassified_columns_stop_it(spark):
    e = edges(spark, ("a", "own"), ("own", "after"), ("a", "open"), ("open", "later"), ("a", "plain"))
    m = masks(spark, ("a", "null", ["admin"]), ("own", "noise", []))
    got = found(govern.strongest_mask(e, m, spark.createDataFrame([("open",)], "node string")))
    assert got == {"after": ("noise", []), "plain": ("null", ["admin"])}


def test_many_roles_and_circles(spark):
    roles = [f"r{i:03d}" for i in range(150)]
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "b"), ("z", "c"))
    got = found(govern.strongest_mask(e, masks(spark, ("a", "hash", roles), ("z", "range", roles[100:] + ["s"]))))
    assert got == {"b": ("hash", roles[100:]), "c": ("hash", roles[100:])}


def test_nothing_to_inherit(spark):
    e, m = edges(spark, ("a", "b"), (None, "c"), ("a", None)), masks(spark)
    assert found(govern.strongest_mask(e, m)) == {} and found(govern.strongest_mask(e.limit(0), masks(spark, ("a", "hash", ["x"])))) == {}


def test_long_chain(spark):
    e = spark.range(30).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("derived"))
    seeds = spark.createDataFrame([("0", 5), ("10", 3), ("20", 9)], "node string, v int")
    got = found(propagate(e, seeds, {"v": F.min}))
    assert got == {str(i): (5 if i < 10 else 3,) for i in range(31)}
    with pytest.raises(RuntimeError):
        propagate(e, seeds, {"v": F.min}, most=3)


def test_views_over_views(spark):
    lags = spark.createDataFrame([("fast", 1), ("slow", 90)], "model string, lag_seconds long")
    reads = edges(spark, ("fast", "v1"), ("v1", "v2"), ("slow", "v3"), ("v3", "v4"), ("v2", "v4"), ("v4", "fast"), ("nowhere", "v5"))
    assert found(stream.view_lag(lags, reads)) == {"fast": (1,), "slow": (90,), "v1": (1,), "v2": (1,), "v3": (90,), "v4": (90,), "v5": (0,)}


def test_nothing_is_broadcast(spark, monkeypatch):
    from tideframe.operators import closure

    plans, real = [], closure.settled
    monkeypatch.setattr(closure, "settled", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "source int, derived int")
    out = closure.propagate(edges, spark.createDataFrame([(1, 5)], "node int, v int"), {"v": F.max}, stop=spark.createDataFrame([(4,)], "node int"))
    assert sorted(map(tuple, out.collect())) == [(1, 5), (2, 5), (3, 5)] and not any("Broadcast" in p for p in plans)
