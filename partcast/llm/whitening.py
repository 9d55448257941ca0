"""Whitening of embeddings: covariance by polarisation, exact up to the eigenvectors.

Vectors become integers x = floor(scale * c).  The model is fitted on each
distinct x once (n of them, sums S), so copies of one vector don't bend it.
With the exactly centred values y = n x - S, tasks sum the squares of every
single dimension and of every sum of two dimensions,

    q(i) = sum of y_i^2            q(i, j) = sum of (y_i + y_j)^2,

and half the difference q(i, j) - q(i) - q(j) is the cross sum of y_i y_j: all
covariances are differences of variances.  Squares are summed as integers, in
limbs of 30 bits that can't overflow, so no rounding enters before the
covariances go to `eigh` as correctly rounded doubles.

What reaches the driver is bounded by the dimensions alone: one row for each of
D (D + 1) / 2 dimension pairs, D sums, and the identity check's few numbers.
Each task sends one row per pair, merged by Spark's sum of decimals.

Defined results: a vector that is null, empty, or holds null, NaN, an infinity
or an entry whose x leaves +-2^53 is dropped; so are vectors of another length
than the commonest one (the longer of two equally common).  Repeated rows are
all returned.  A component without variance (fewer distinct vectors than
dimensions, say) has a null `whitened`; without any variance `explained` is
null.  `deviation` is null where it leaves a long.  Other columns are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.llm.scratch import Scratch

SCALE, COMPONENTS = 256, 4
_LIMB = 30
_MOST = float(1 << 53)
#: Eigenvalues below this share of the largest are rounding noise.
_NOISE = 1e-12


class Model(NamedTuple):
    n: int                  #: distinct vectors
    sums: list[int]         #: S of each dimension
    values: np.ndarray      #: leading eigenvalues, falling
    vectors: np.ndarray     #: their unit eigenvectors, as columns
    trace: float
    identity_error: float   #: as measured over the fit list


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x) of the usable vectors; all x have the same length."""
    scaled = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale))
    inside = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double") * scale) < _MOST), F.lit(False))
    sound = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col)).where(
        F.coalesce(F.forall(F.col(vector_col), inside) & (F.size(vector_col) > 0), F.lit(False)))
    length = (sound.groupBy(F.size(vector_col).alias("d")).agg(F.count(F.lit(1)).alias("m"))
              .orderBy(F.desc("m"), F.desc("d")).limit(1).collect())
    return sound.where(F.size(vector_col) == (length[0].d if length else 0)).select("vec_id", scaled.cast("array<long>").alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """y = n x - S, in int64 where that and a sum of two surely fit, else in Python's integers."""
    most = n * (int(np.abs(x).max(initial=0)) + 1) + max((abs(s) for s in sums), default=0)
    if most < 1 << 60:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _sum_of_squares(z: np.ndarray) -> np.ndarray:
    """Exact sums of squares down the columns, as Python integers; |z| < 2^61 if int64; at most 2^20 rows."""
    if z.dtype == object:
        return (z * z).sum(axis=0) + np.zeros(z.shape[1], object)
    hi, lo = z >> _LIMB, z & ((1 << _LIMB) - 1)
    out = np.zeros(z.shape[1], object)
    # lo^2 < 2^60 and |hi lo| < 2^61: their own halves are added up apart
    for part, shift in ((lo * lo, 0), (hi * lo, _LIMB + 1), (hi * hi, 2 * _LIMB)):
        out += ((part >> _LIMB).sum(axis=0).astype(object) << (_LIMB + shift)) + ((part & ((1 << _LIMB) - 1)).sum(axis=0).astype(object) << shift)
    return out


_EXACT = pa.decimal128(38, 0)
_WIDE = decimal.Context(prec=60)


def _exact(values) -> pa.Array:
    return pa.array([_WIDE.create_decimal(int(v)) for v in values], _EXACT)


def _blocks(batches, rows: int = 1 << 12) -> Iterator[np.ndarray]:
    for batch in batches:
        x = _matrix(batch.column("x")) if batch.num_rows else np.zeros((0, 0), np.int64)
        for a in range(0, len(x), rows):
            yield x[a: a + rows]


def _first_sums(batches):
    """(i, total): the sum of each dimension, and as i = -1 the number of vectors."""
    total, n = None, 0
    for x in _blocks(batches):
        one = ((x >> _LIMB).sum(axis=0).astype(object) << _LIMB) + (x & ((1 << _LIMB) - 1)).sum(axis=0).astype(object)
        total, n = one if total is None else total + one, n + len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), _exact([n, *total])], names=["i", "total"])


def _square_sums(batches, n: int, sums: list[int]):
    """(i, j, total): sums of y_i^2 (as i = j) and of (y_i + y_j)^2."""
    d = len(sums)
    total = [np.zeros(d - i, object) for i in range(d)]
    some = False
    for x in _blocks(batches):
        y, some = _centred(x, n, sums), True
        for i in range(d):
            z = y[:, i:] + y[:, i: i + 1]
            z[:, 0] = y[:, i]
            total[i] += _sum_of_squares(z)
    if some:
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _exact(np.concatenate(total))],
                                         names=["i", "j", "total"])


def _project(y: np.ndarray, n: int, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Centred integers onto the components, each to unit variance."""
    return (y.astype(np.float64) / n) @ vectors / np.sqrt(values)


def _moments(batches, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
    """(i, j, total) of the whitened values: sums (as i = -1) and sums of products."""
    k = len(values)
    first, second, some = np.zeros(k), np.zeros((k, k)), False
    for x in _blocks(batches):
        w = _project(_centred(x, n, sums), n, values, vectors)
        first, second, some = first + w.sum(axis=0), second + w.T @ w, True
    if some:
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(np.full(k, -1), i).astype(np.int32)), pa.array(np.append(np.arange(k), j).astype(np.int32)),
            pa.array(np.append(first, second[i, j]))], names=["i", "j", "total"])


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Model:
    """fit_list (x array<long>) with each distinct vector once; it is read three times."""
    added = {r.i: int(r.total) for r in fit_list.mapInArrow(_first_sums, "i int, total decimal(38,0)")
             .groupBy("i").agg(F.sum("total").alias("total")).collect()}
    if not added:
        return Model(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    n = added.pop(-1)
    sums = [added[i] for i in range(len(added))]
    d = len(sums)
    q = {(r.i, r.j): int(r.total) for r in fit_list.mapInArrow(lambda it: _square_sums(it, n, sums), "i int, j int, total decimal(38,0)")
         .groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    cov = np.zeros((d, d))
    for (i, j), total in q.items():
        cross = total if i == j else (total - q[i, i] - q[j, j]) // 2    # always even
        cov[i, j] = cov[j, i] = cross / n ** 3
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    live = int((values > _NOISE * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    error = 0.0
    if live:
        v, u = values[:live].copy(), vectors[:, :live].copy()
        got = {(r.i, r.j): r.total / n for r in fit_list.mapInArrow(lambda it: _moments(it, n, sums, v, u), "i int, j int, total double")
               .groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
        error = max(abs(got[i, j] - got[-1, i] * got[-1, j] - (i == j)) for i in range(live) for j in range(i, live))
    trace = sum(q[i, i] for i in range(d)) / n ** 3
    return Model(n, sums, np.ascontiguousarray(np.where(np.arange(len(values)) < live, values, 0.0)), np.ascontiguousarray(vectors), trace, error)


def _whitened(batches, model: Model):
    k = len(model.values)
    live = int((model.values > 0).sum())
    v, u = model.values[:live], model.vectors[:, :live]
    explained = pa.array([float(e) / model.trace if model.trace > 0 else None for e in model.values], pa.float64())
    for batch in batches:
        for a in range(0, batch.num_rows, 1 << 12):
            part = batch.slice(a, 1 << 12)
            y = _centred(_matrix(part.column("x")), model.n, model.sums)
            m, big = len(y), y.dtype == object or float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] >= 2.0 ** 62
            whole = (y.astype(object) ** 2).sum(axis=1) if big else (y * y).sum(axis=1)
            deviation = pa.array([int(s) if s < 1 << 63 else None for s in whole] if big else whole, pa.int64())
            w = np.full((m, k), np.nan)
            w[:, :live] = _project(y, model.n, v, u)
            row = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1), m).astype(np.int32)),
                pa.array(np.full(m * k, model.n)), deviation.take(row), pa.array(w.ravel(), from_pandas=True),
                explained.take(pa.array(np.tile(np.arange(k), m))), pa.array(np.full(m * k, model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
           components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component."""
    scratch = Scratch(vectors.sparkSession)
    x = scratch.keep(integers(vectors, id_col, vector_col, scale))
    fit_list = scratch.keep(x.select("x").distinct())
    model = fit(fit_list, components)
    scratch.drop(fit_list)
    return x.mapInArrow(lambda it: _whitened(it, model),
                        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
