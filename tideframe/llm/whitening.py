"""Whitening of embeddings by polarisation: covariances from variances of sums.

Entries become whole numbers, floor(scale * c). Spark adds up, exactly, the
squared centred values of every dimension and of the sum of every two dimensions,
over each distinct vector once. As var(a + b) = var(a) + var(b) + 2 cov(a, b), the
differences of these variances are all cross-covariances; the matrix, whose size
is that of a vector squared whatever the number of rows, is assembled on the
driver for ``eigh``. Sums are whole numbers in limbs, so neither the order nor the
number of the tasks changes a digit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.graph import forget, keep

SCALE, COMPONENTS = 256, 4
#: Vectors that a task squares at a time, bits of a limb, and limbs of a sum.
BLOCK, LIMB, LIMBS = 4096, 32, 5
_SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """``sums`` of ``n`` distinct whole vectors, unit ``components`` (rows) of their covariance by falling ``eigenvalues``, and its ``trace``."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: int = SCALE

    @property
    def null_from(self) -> int:
        """The first component whose variance cannot be told from 0."""
        least = len(self.sums) * np.finfo(float).eps * max([0.0, *self.eigenvalues])
        return int((self.eigenvalues > least).sum())


def _whole(column: pa.Array, scale: int) -> list[np.ndarray | None]:
    """floor(scale * c) of each vector as int64, None for null vectors and those with null or non-finite entries."""
    values = pc.cast(column.flatten(), pa.float64())
    holes = values.is_null().to_numpy(zero_copy_only=False)
    given = values.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)
    good = ~holes & np.isfinite(given)
    with np.errstate(over="ignore", invalid="ignore"):
        entries = np.floor(scale * given)
    if (np.abs(entries[good]) >= 2.0**63).any():
        raise ValueError("an entry times the scale is beyond 64 bits")
    whole = np.where(good, entries, 0).astype(np.int64)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    bad = np.concatenate(([0], np.cumsum(~good)))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [whole[b - k : b] if v and bad[b] == bad[b - k] else None for b, k, v in zip(ends, size, valid, strict=True)]


def whole_vectors(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and x, the vector's whole numbers as little-endian bytes, eight an entry.

    Rows whose vector is null or holds null or non-finite entries are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole(batch.column(1), scale)
            good = [i for i, x in enumerate(whole) if x is not None]
            packed = pa.array([whole[i].astype("<i8").tobytes() for i in good], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), packed], ["vec_id", "x"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, x binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def _blocks(batches: Iterator[pa.RecordBatch], name: str, dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for lo in range(0, len(batch), BLOCK):
            yield _matrix(batch.column(name).slice(lo, BLOCK), dims)


def _limbs(values: list[int]) -> list[list[int]]:
    """Each number's digits to the base 2^LIMB, the last of which has the sign."""
    mask = (1 << LIMB) - 1
    return [[v >> (LIMB * k) & mask if k < LIMBS - 1 else v >> (LIMB * k) for v in values] for k in range(LIMBS)]


def _summed(rows: DataFrame, name: str, dims: int, numbers) -> list[int]:
    """Sums over all vectors of ``numbers(block)``, a list of whole numbers of a block; exact.

    Each task adds up its own, Spark adds the tasks' limbs; the driver sees one
    row for each number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for block in _blocks(batches, name, dims):
            own = numbers(block)
            total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            limbs = [pa.array(x, pa.int64()) for x in _limbs(total)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *limbs], ["i", *(f"limb{k}" for k in range(LIMBS))])

    parts = rows.select(name).mapInArrow(run, "i int, " + ", ".join(f"limb{k} long" for k in range(LIMBS)))
    found = parts.groupBy("i").agg(*(F.sum(f"limb{k}").alias(f"limb{k}") for k in range(LIMBS))).orderBy("i").collect()
    return [sum(r[f"limb{k}"] << (LIMB * k) for k in range(LIMBS)) for r in found]


def _top(block: np.ndarray) -> int:
    return max(abs(int(block.max())), abs(int(block.min()))) if block.size else 0


def _column_sums(block: np.ndarray) -> list[int]:
    if not block.size or _top(block) < _SAFE // len(block):
        return block.sum(axis=0).tolist()
    return [sum(int(v) for v in c) for c in block.T]


def _squared_pairs(block: np.ndarray, middle: np.ndarray) -> list[int]:
    """Sums of squares of the centred values of each dimension, and of the sum of each two, in the order of np.triu_indices."""
    top = _top(block) + _top(middle)
    y = block - middle if 4 * top * top * len(block) < _SAFE else block.astype(object) - middle.astype(object)
    y = np.ascontiguousarray(y.T)
    out: list[int] = []
    for i in range(len(y)):
        pair = y[i] + y[i:]
        pair[0] = y[i]
        out += [int(v) for v in (pair * pair).sum(axis=1)]
    return out


def covariance(n: int, sums: list[int], middle: list[int], squares: list[int]) -> np.ndarray:
    """The covariance matrix from the squares of ``_squared_pairs``, each entry rounded once."""
    dims = len(sums)
    shift = [s - n * m for s, m in zip(sums, middle, strict=True)]
    at = dict(zip(zip(*(x.tolist() for x in np.triu_indices(dims)), strict=True), squares, strict=True))
    # n squared times a variance: what the middle lacks of the mean is taken off
    var = [n * at[i, i] - shift[i] ** 2 for i in range(dims)]
    out = np.zeros((dims, dims))
    for (i, j), q in at.items():
        twice = 2 * var[i] if i == j else n * q - (shift[i] + shift[j]) ** 2 - var[i] - var[j]
        out[i, j] = out[j, i] = float(Fraction(twice, 2 * n * n))
    return out


def fit(whole: DataFrame, scale: int = SCALE) -> tuple[Whitening, DataFrame]:
    """(the whitening of the distinct vectors of ``whole``, a kept table of vec_id and x; a kept table of these vectors).

    Vectors of other lengths than the commonest (of ties, the longest) are left
    out. Without vectors the whitening has no dimensions.
    """
    distinct = keep(whole.select("x").distinct())
    sizes = whole.groupBy(F.octet_length("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    dims = sizes[0]["size"] // 8 if sizes else 0
    rows = distinct.filter(F.octet_length("x") == 8 * dims)
    n = rows.count() if dims else 0
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, scale), distinct
    sums = _summed(rows, "x", dims, _column_sums)
    middle = [round(Fraction(s, n)) for s in sums]
    centre = np.array(middle, np.int64)
    squares = _summed(rows, "x", dims, lambda block: _squared_pairs(block, centre))
    matrix = covariance(n, sums, middle, squares)
    values, vectors = np.linalg.eigh(matrix)
    return Whitening(n, sums, np.ascontiguousarray(vectors.T[::-1]), values[::-1].copy(), float(np.trace(matrix)), scale), distinct


def _centred(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int]]:
    """(x - S/n, sum over dimensions of (n x - S)^2) of a block; both from exact n x - S."""
    top = model.n * _top(x) + max(map(abs, model.sums))
    wide = top * top * len(model.sums) >= _SAFE
    z = x.astype(object) * model.n - np.array(model.sums, object) if wide else x * model.n - np.array(model.sums, np.int64)
    return (z / model.n).astype(float), [int(v) for v in (z * z).sum(axis=1)]


def _projected(centred: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    good = min(k, model.null_from)
    out = np.full((len(centred), k), np.nan)
    out[:, :good] = centred @ model.components[:good].T / np.sqrt(model.eigenvalues[:good])
    return out


def identity_error(distinct: DataFrame, model: Whitening, components: int = COMPONENTS) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, over the distinct vectors themselves.

    The mean of x - S/n is 0, so whitened values are centred as they are.
    Components without variance are left out; 0 if there are no others.
    """
    dims, k = len(model.sums), min(components, model.null_from)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for block in _blocks(batches, "x", dims):
            w = _projected(_centred(block, model)[0], model, k)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], ["i", "s"])

    found = distinct.filter(F.octet_length("x") == 8 * dims).mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    matrix = np.zeros(k * k)
    for r in found:
        matrix[r["i"]] = r["s"]
    return float(np.abs(matrix.reshape(k, k) / model.n - np.eye(k)).max())


def transform(whole: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation (decimal), whitened (array of doubles) of every row of ``whole`` that has the model's length.

    deviation is the sum over dimensions of (n x - S)^2, exact up to 38 digits.
    whitened[k] is x - S/n projected on component k, over the root of its
    eigenvalue; null where that cannot be told from 0.
    """
    dims, k = len(model.sums), min(components, len(model.sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                part = batch.slice(lo, BLOCK)
                centred, deviation = _centred(_matrix(part.column("x"), dims), model)
                w = _projected(centred, model, k)
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * k, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([str(d) for d in deviation]), lists], ["vec_id", "deviation", "whitened"])

    rows = whole.filter(F.octet_length("x") == 8 * dims) if dims else whole.filter(F.lit(False))
    return rows.mapInArrow(run, "vec_id long, deviation string, whitened array<double>").withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every vector and each of the first ``components``.

    The fit is over all distinct whole vectors. Vectors that are null or hold
    null or non-finite entries, and those of another length than most, have no
    rows; repeated rows and null ids have rows like others; other columns are
    ignored. A component without variance has whitened null and explained 0.
    """
    whole = keep(whole_vectors(vectors, column, scale))
    model, distinct = fit(whole, scale)
    error = identity_error(distinct, model, components)
    forget(distinct)
    k = min(components, len(model.sums))
    share = [float(max(0.0, v)) / model.trace if i < model.null_from else 0.0 for i, v in enumerate(model.eigenvalues[:k])]
    explained = F.array(*(F.lit(x) for x in share)) if share else F.array().cast("array<double>")
    out = transform(whole, model, components).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
