"""Whitening against covariances written out in fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tideframe.llm import whitening
from tideframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, x string, n string, component int, whitened double"


def written_out(vectors, scale=256):
    """(whole vectors, distinct ones, covariance) in fractions; vectors that do not count are left out."""
    whole = [(i, [math.floor(scale * c) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in whole})
    n, d = len(fit), len(fit[0])
    mean = [Fraction(sum(x[k] for x in fit), n) for k in range(d)]
    cov = [[sum((x[a] - mean[a]) * (x[b] - mean[b]) for x in fit) / n for b in range(d)] for a in range(d)]
    return whole, fit, np.array([[float(v) for v in r] for r in cov])


def agrees(rows, vectors, k=4):
    whole, fit, cov = written_out(vectors)
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, len(sums))
    assert len(rows) == k * len(whole)
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], []).append(r)
    signs = [None] * k
    for i, x in whole:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        centred = np.array([float(a - Fraction(s, n)) for a, s in zip(x, sums)])
        for r in by[i]:
            c = r["component"] - 1
            assert r["n"] == n and int(r["deviation"]) == dev
            assert r["explained"] == pytest.approx(e[c] / np.trace(cov), rel=1e-9)
            want = centred @ u[:, c] / math.sqrt(e[c])
            if abs(want) > 1e-6 and signs[c] is None:
                signs[c] = np.sign(want) * np.sign(r["whitened"])
            assert r["whitened"] == pytest.approx(want * (signs[c] or 1), abs=1e-9)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


def test_query(spark):
    held = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    agrees(QUERIES["op11_polarisation"](spark, SF).collect(), held)


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(c) for c in rng.normal(size=5) * [5, 3, 2, 1, 0.5] + 7]) for i in range(60)]
    vectors += [(100 + i, list(vectors[0][1])) for i in range(300)]  # copies count once in the fit
    vectors += [(500, [-0.0, 0.0, 1e-9, -1e-9, 2.0])]
    bad = [(600, None), (601, [1.0, None, 1.0, 1.0, 1.0]), (602, [float("nan")] * 5), (603, [float("inf"), 1.0, 1.0, 1.0, 1.0])]
    shorter = [(604, []), (605, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", "n", 9, 0.5) for i, v in [*vectors, *bad, *shorter]], SCHEMA)
    agrees(whitening.whiten(df.repartition(7)).collect(), vectors)
    assert whitening.whiten(df.filter("vec_id < 0")).collect() == []
    assert whitening.whiten(df.filter("vec_id = 600 or vec_id = 604")).collect() == []


def test_large_entries_stay_exact(spark):
    """Squares beyond 64 bits."""
    rng = np.random.default_rng(4)
    vectors = [(i, [float(c) for c in rng.normal(size=3) * 1e13]) for i in range(40)]
    agrees(whitening.whiten(spark.createDataFrame([(i, v, None, None, None, None) for i, v in vectors], SCHEMA)).collect(), vectors)


def test_no_variance(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0], None, None, None, None) for i in range(3)], SCHEMA)
    rows = whitening.whiten(one).collect()
    assert len(rows) == 6 and all(r["whitened"] is None and r["explained"] == 0 and int(r["deviation"]) == 0 and r["n"] == 1 and r["identity_error"] == 0 for r in rows)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], None, None, None, None) for i in range(9)], SCHEMA)
    rows = whitening.whiten(line).collect()
    assert {(r["component"], r["whitened"] is None) for r in rows} == {(1, False), (2, True), (3, True)}


@pytest.mark.parametrize("value", [1e17, 1e300, 1e308])
def test_too_large_is_refused(spark, value):
    df = spark.createDataFrame([(1, [value], None, None, None, None)], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(df).collect()
