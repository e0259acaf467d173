"""Whitening of vectors by QDWH spectral divide-and-conquer.

Vectors are taken as whole numbers ``x = floor(scale * c)``.  The model is fitted on the *fit
list*, each distinct x vector once: one pass counts it (n) and sums it per dimension (S), a
second one centres every vector by the rounded means and sums the products.  All sums are exact
whole numbers, so the covariance (divisor n) is the exact one rounded once to doubles, however
the rows are spread over tasks.  What reaches the driver is one number a pair of dimensions.

The components come from polar decompositions, not from a library's eigensolver: the unitary
polar factor U of ``A - shift * I``, by the dynamically weighted Halley iteration (inverse free
QR steps first, Cholesky steps once well conditioned), has eigenvalue 1 where A's eigenvalue is
above the shift and -1 below, so ``(U + I) / 2`` projects on the invariant subspace above it.
An orthonormal basis of that subspace and of its complement cuts A into two smaller problems
that are split in turn, down to single components; subspaces that hold none of the wanted
components are left alone.  The components are broadcast, and each batch of rows is projected.

Defined cases: rows with a null vector, or with a null, NaN or infinite component, take no part;
of the others those count whose length is the commonest (of ties, the longer); empty vectors
have no components and give no rows; rows with a null id take part; repeated rows are one
member of the fit list and each get their result; components with equal variance are any
orthonormal basis of their subspace; components without variance (fewer dimensions or distinct
vectors than components, constant dimensions) are not returned; a deviation beyond 64 bits is
null; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialise
from .topk import usable

EPS = np.finfo(float).eps
_MOMENT = "i int, j int, v decimal(38,0)"


# ------------------------------------------------------------------ polar factors and subspaces

def polar(a: np.ndarray, steps: int = 60) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix."""
    d = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    # a lower bound of the least singular value, from the triangular factor's inverse
    r = np.linalg.qr(x, mode="r")
    with np.errstate(all="ignore"):
        low = np.abs(np.diag(r)).min() if np.abs(np.diag(r)).min() < EPS else 1 / (np.linalg.norm(np.linalg.inv(r)))
    low = min(max(low, EPS), 1.0)
    eye = np.eye(d)
    for _ in range(steps):
        gamma = (4 * (1 - low**2) / low**4) ** (1 / 3)
        root = np.sqrt(1 + gamma)
        wa = root + np.sqrt(8 - 4 * gamma + 8 * (2 - low**2) / (low**2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            fresh = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:d] @ q[d:].T
        else:
            factor = np.linalg.cholesky(eye + wc * x.T @ x)
            fresh = wb / wc * x + (wa - wb / wc) * np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
        moved, x = np.linalg.norm(fresh - x), fresh
        low = min(low * (wa + wb * low**2) / (1 + wc * low**2), 1.0)
        if moved <= (5 * EPS) ** (1 / 3) and 1 - low <= 5 * EPS:
            break
    return (x + x.T) / 2


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases (above, below) of two complementary invariant subspaces of ``a``; None
    if it is a multiple of the identity as far as doubles tell."""
    d = len(a)
    mean = np.trace(a) / d
    size = np.linalg.norm(a)
    spread = np.linalg.norm(a - mean * np.eye(d)) / np.sqrt(d)
    if spread <= 4 * EPS * size:
        return None
    best = None
    # the mean lies between the extreme eigenvalues; the others, where a shift meets an eigenvalue
    for shift in (np.median(np.diag(a)), mean, *(mean + f * spread for f in (0.1, -0.1, 0.3, -0.3, 0.03, -0.03, 0.6, -0.6))):
        projector = (polar(a - shift * np.eye(d)) + np.eye(d)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < d:
            continue
        # columns of the projector by falling norm, then one step of subspace iteration
        first = projector[:, np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")]
        start = np.linalg.qr(first @ np.random.default_rng(0).standard_normal((d, k)))[0]
        q = np.linalg.qr(projector @ start, mode="complete")[0]
        above, below = q[:, :k], q[:, k:]
        off = np.linalg.norm(below.T @ a @ above)
        if best is None or off < best[0]:
            best = (off, above, below)
        if off <= 10 * EPS * size:
            break
    if best is None or best[0] > 1e-8 * size:
        raise ArithmeticError("no shift splits the matrix")
    return best[1:]


def leading_components(a: np.ndarray, wanted: int) -> list[tuple[float, np.ndarray]]:
    """The ``wanted`` largest (eigenvalue, unit eigenvector) pairs of a symmetric matrix, falling."""
    found = []

    def descend(part: np.ndarray, basis: np.ndarray, need: int) -> None:
        bases = _split(part) if len(part) > 1 else None
        if bases is None:
            found.extend((float(v @ a @ v), v) for v in basis.T)
            return
        for own in bases:
            if need > 0:
                descend((own.T @ part @ own + (own.T @ part @ own).T) / 2, basis @ own, need)
                need -= own.shape[1]
    if len(a):
        descend(a, np.eye(len(a)), wanted)
    return sorted(found, key=lambda p: -p[0])[:wanted]


# ------------------------------------------------------------------ sums over Spark's rows

def _matrix(column, d: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, d)


def _product(z: np.ndarray) -> np.ndarray:
    """Exact ``z.T @ z`` of whole numbers as Python ints."""
    most = int(np.abs(z.astype(object)).max(initial=0)) if z.dtype == object else max(abs(int(z.max(initial=0))), abs(int(z.min(initial=0))))
    if len(z) * most * most < 1 << 53:
        f = z.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    if len(z) * most * most < 1 << 63:
        return (z.T @ z).astype(object)
    o = z.astype(object)
    return o.T @ o


def _moments(fit: DataFrame, d: int, shift: list[int] | None) -> dict[tuple[int, int], int]:
    """Without ``shift``, {(0, 0): n, (1, j): sum of dimension j}; with it, {(i, j): sum of
    products of the shifted dimensions i <= j}."""
    def run(batches):
        count, total = 0, None
        for b in batches:
            x = _matrix(b["x"], d)
            count += len(x)
            if shift is None:
                part = x.sum(axis=0, dtype=object)
            else:
                far = any(abs(s) >= 1 << 62 for s in shift) or np.abs(x.astype(float)).max(initial=0) >= 2.0**62
                part = _product(x.astype(object) - np.array(shift, object) if far else x - np.array(shift, np.int64))
            total = part if total is None else total + part
        if total is None:
            return
        if shift is None:
            rows = [(0, 0, count), *((1, j, v) for j, v in enumerate(total))]
        else:
            rows = [(i, j, total[i, j]) for i in range(d) for j in range(i, d)]
        i, j, v = zip(*rows)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                                          "v": pa.array([Decimal(int(n)) for n in v], pa.decimal128(38, 0))})

    # at most d * d rows a task; summed before and after the shuffle
    sums = fit.mapInArrow(run, _MOMENT).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): int(r["v"]) for r in sums.collect()}


@dataclass
class Whitening:
    """What the rows are whitened with; ``components`` has a row a component."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    def apply(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """(deviations, whitened values) of whole-number vectors."""
        d = x.shape[1]
        reach = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums))
        if d * reach * reach < 1 << 63:
            y = x * np.int64(self.n) - np.array(self.sums, np.int64)
            deviation = (y * y).sum(axis=1).tolist()
        else:
            y = x.astype(object) * self.n - np.array(self.sums, object)
            deviation = [v if v < 1 << 63 else None for v in (y * y).sum(axis=1)]
        return deviation, (y.astype(float) / self.n) @ (self.components / np.sqrt(self.variances)[:, None]).T


def fit(fit_list: DataFrame, d: int, components: int) -> Whitening | None:
    """The model of a materialised table of distinct vectors ``x``; None without rows."""
    first = _moments(fit_list, d, None)
    if not first or not d:
        return None
    n, sums = first[0, 0], [first[1, j] for j in range(d)]
    shift = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, shift)]
    cov = np.zeros((d, d))
    for (i, j), v in _moments(fit_list, d, shift).items():
        cov[i, j] = cov[j, i] = (n * v - rest[i] * rest[j]) / (n * n)
    trace = float(np.trace(cov))
    found = [(e, v) for e, v in leading_components(cov, min(components, d)) if e > d * 16 * EPS * trace]
    model = Whitening(n, sums, np.array([e for e, _ in found]), np.array([v for _, v in found]).reshape(len(found), d), trace)
    if found:
        model.identity_error = _identity_error(fit_list, model)
    return model


def _identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity."""
    k, d = model.components.shape
    shared = fit_list.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total = np.zeros((k + 1, k))
        for b in batches:
            w = shared.value.apply(_matrix(b["x"], d))[1]
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total.ravel()})

    total = np.zeros((k + 1, k))
    for r in fit_list.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    total /= model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 4, scale: float = 256.0) -> tuple[DataFrame, Whitening | None]:
    """Rows (id, component, deviation, whitened) of a table (id, vector array), and the model.
    ``deviation`` is the sum over dimensions of ``(n * x - S) ** 2``."""
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema["id"].dataType.simpleString()
    rows = (vectors.where(usable(F.col("vector")))
            .select("id", F.transform(F.col("vector").cast("array<double>"), lambda c: F.floor(F.lit(scale) * c)).alias("x")))
    schema = f"id {kind}, component int, deviation bigint, whitened double"
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    rows = rows.where(F.size("x") == d)
    model = fit(materialise(rows.select("x").distinct(), "whitening-fit"), d, components) if d else None
    if model is None or not len(model.variances):
        return spark.createDataFrame([], schema), model
    shared = spark.sparkContext.broadcast(model)  # a row of d numbers a component

    def run(batches):
        k = len(shared.value.variances)
        for b in batches:
            deviation, w = shared.value.apply(_matrix(b["x"], d))
            at = np.repeat(np.arange(len(w)), k)
            yield pa.RecordBatch.from_arrays(
                [b["id"].take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))),
                 pa.array(deviation, pa.int64()).take(pa.array(at)), pa.array(w.ravel())],
                ["id", "component", "deviation", "whitened"])

    return rows.mapInArrow(run, schema), model
