"""Whitening of embeddings by a bidiagonal qd solver.

The covariance matrix is never formed. Each task reduces its centred rows, block by block, to one triangular factor by QR;
factors meet in a tree of fan-in 8. The last factor R, as wide as a vector, is bidiagonalised by Householder reflections;
dqds finds the squares of the bidiagonal's singular values to high relative accuracy, and twisted factorisations give the
eigenvectors of B'B, which the right reflections carry back. Sums are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, written

EPS = float(np.finfo(float).eps)
_LONG = (1 << 63) - 1


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: r = U B V' with B upper bidiagonal -> (diagonal, superdiagonal, V)."""
    a, d = np.array(r, float), r.shape[1]
    v = np.eye(d)

    def reflector(x):
        x = x.copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            return None
        x[0] += np.copysign(norm, x[0])
        return x / np.linalg.norm(x)

    for k in range(d):
        if (x := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(x, x @ a[k:, k:])
        if k < d - 2 and (x := reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ x, x)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd transform with shift -> (q, e, d)."""
    d = q[0] - shift
    out_q, out_e, seen = [], [], [d]
    for i in range(len(e)):
        s = d + e[i]
        ratio = q[i + 1] / s if s else np.inf
        out_q.append(s)
        out_e.append(e[i] * ratio)
        d = d * ratio - shift
        seen.append(d)
    return [*out_q, d], out_e, seen


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squares of the singular values of an upper bidiagonal matrix, falling. Shifts are Newton's lower bound: without
    a shift, 1/d_i are the diagonal of the inverse, so 1 / sum(1/d_i) is at most the least eigenvalue."""
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if not scale:
        return np.zeros(len(diagonal))
    least = 1e-140  # a zero on the diagonal moves by far less than rounding
    todo = [(np.maximum(np.abs(diagonal) / scale, least).__pow__(2).tolist(), ((above / scale) ** 2).tolist(), 0.0)]
    found, tol = [], (10 * EPS) ** 2
    while todo:
        q, e, sigma = todo.pop()
        steps = 0
        while len(q) > 2:
            cut = next((i for i in range(len(e)) if e[i] <= tol * sigma or e[i] <= tol * EPS * min(q[i], q[i + 1])), None)
            if cut is not None and cut < len(e) - 1:
                todo.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if e[-1] <= tol * (sigma + q[-1]):
                found.append(sigma + q.pop())
                e.pop()
                continue
            steps += 1
            if steps > 400 * len(diagonal):
                raise ArithmeticError("dqds did not settle")
            plain = _qd_step(q, e, 0.0)
            shift = 1 / sum(1 / x for x in plain[2]) if min(plain[2]) > 0 else 0.0
            for part in (1 - 8 * EPS, 0.9, 0.0):
                moved = _qd_step(q, e, shift * part) if part else plain
                if min(moved[2]) >= 0 and np.isfinite(moved[1]).all():
                    sigma += shift * part
                    break
            q, e = list(moved[0]), list(moved[1])
            if q[-1] == 0:
                q[-1] = least**2
        if len(q) == 2:
            total = q[0] + e[0] + q[1]
            big = (total + np.hypot(q[0] + e[0] - q[1], 2 * np.sqrt(q[1] * e[0]))) / 2
            found += [sigma + big, sigma + q[0] * (q[1] / big)]
        elif q:
            found.append(sigma + q[0])
    return np.sort(np.array(found))[::-1] * scale**2


def twisted_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B'B for the given eigenvalues (falling), as columns. B'B - value is factored from the top and
    from the bottom; where both meet with the least pivot, the eigenvector is read off. Within groups of eigenvalues
    that agree to 1e-3, vectors are made orthogonal, and another twist is taken where nothing of a vector is left."""
    n = len(diagonal)
    scale = np.abs(diagonal).max(initial=0) or 1.0
    a = np.where(np.abs(diagonal) < 1e-100 * scale, 1e-100 * scale, diagonal)
    low, piv = above / a[:-1] if n > 1 else above, a * a
    tiny = EPS * EPS * scale * scale
    out = np.zeros((n, len(values)))
    for j, value in enumerate(values):
        s, p, down, up = np.zeros(n), np.zeros(n), np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1))
        s[0] = -value
        for i in range(n - 1):
            x = piv[i] + s[i] or tiny
            down[i] = piv[i] * low[i] / x
            s[i + 1] = down[i] * low[i] * s[i] - value
        p[-1] = piv[-1] - value
        for i in range(n - 2, -1, -1):
            t = piv[i] / (piv[i] * low[i] ** 2 + p[i + 1] or tiny)
            up[i] = low[i] * t
            p[i] = p[i + 1] * t - value
        near = [k for k in range(j) if abs(values[k] - value) <= 1e-3 * values[k]]
        best = None
        for k in np.argsort(np.abs(s + p + value), kind="stable"):
            z = np.zeros(n)
            z[k] = 1
            with np.errstate(over="ignore", invalid="ignore"):
                for i in range(k - 1, -1, -1):
                    z[i] = -down[i] * z[i + 1]
                for i in range(k, n - 1):
                    z[i + 1] = -up[i] * z[i]
                z /= np.linalg.norm(z)
            if not np.isfinite(z).all():
                continue
            for _ in range(2):
                z -= out[:, near] @ (out[:, near].T @ z)
            if best is None or np.linalg.norm(z) > np.linalg.norm(best):
                best = z
            if np.linalg.norm(best) > 0.1:
                break
        best = np.eye(n)[0] if best is None else best
        out[:, j] = best / (np.linalg.norm(best) or 1.0)
    return out


def principal(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """From the triangular factor of n centred rows: the largest eigenvalues of their covariance, none that rounding alone
    can explain, and their unit eigenvectors as columns, the largest entry of each positive."""
    a, b, v = bidiagonal(r)
    squares = dqds(a, b)
    squares = squares[: min(most, int((squares > (len(a) * EPS) ** 2 * squares[:1].sum()).sum()))]
    vectors = v @ twisted_vectors(a, b, squares)
    return squares / n, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] if vectors.size else 1.0)


def _longs(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
    return (np.floor(1024 * flat) + 100000).astype(np.int64).reshape(-1, dim)


def _sums(dim: int):
    def run(batches):
        total, n, most = np.zeros(dim, object), 0, 0
        for batch in batches:
            x = _longs(batch, dim)
            n, most = n + len(x), max(most, int(np.abs(x).max(initial=0)))
            total = total + (x.astype(object) if most > 1 << 40 else x).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(x) for x in total], pa.string()), pa.array([n] * dim, pa.int64()), pa.array([most] * dim, pa.int64())], ["i", "s", "n", "most"])

    return run


class _Centre:
    """n, the exact sums, and n * x - S of a block as exact integers (Python's where 64 bits don't hold them)."""

    def __init__(self, n: int, sums: list[int], most: int):
        self.n, self.sums, self.wide = n, sums, n * most * 2 >= 1 << 62
        self.square_wide = self.wide or (n * most * 2) ** 2 * len(sums) > _LONG
        self.array = np.array(sums, object if self.wide else np.int64)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(object) if self.wide else x) * self.n - self.array

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(float)


def _factor(dim: int, centre, block: int):
    def run(batches):
        r, k = np.zeros((0, dim)), TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                r = np.linalg.qr(np.vstack([r, centre.value.centred(_longs(batch.slice(lo, block), dim))]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["k", "r"])

    return run


def _stacked(dim: int):
    def run(key, table):
        r = np.zeros((0, dim))
        for x in sorted(table.to_pylist(), key=lambda x: x["k"]):
            r = np.linalg.qr(np.vstack([r, np.array(x["r"]).reshape(-1, dim)]), mode="r")
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    return run


def _projected(dim: int, centre, basis):
    """basis: a broadcast of the directions, each over the root of its eigenvalue, as columns."""

    def run(batches):
        for batch in batches:
            x, c, b = _longs(batch, dim), centre.value, basis.value
            n, k = len(x), b.shape[1]
            square = c.scaled(x)
            square = [None if s > _LONG else s for s in (square.astype(object) ** 2).sum(axis=1)] if c.square_wide else (square * square).sum(axis=1)
            repeat = pa.array(np.repeat(np.arange(n), k))
            cols = [pa.array(square, pa.int64()).take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array((c.centred(x) @ b).ravel())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(repeat), *cols], ["vec_id", "deviation", "component", "whitened"])

    return run


def _moments(dim: int, centre, basis):
    def run(batches):
        k = basis.value.shape[1]
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = centre.value.centred(_longs(batch, dim)) @ basis.value
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["i", "s"])

    return run


def fit(vectors: DataFrame, dim: int, most: int = 8, block: int = 4096):
    """vectors(vec_id, embedding), all of ``dim`` finite entries and at least one row -> (n, broadcast centre, eigenvalues,
    unit eigenvectors as columns, trace of the covariance)."""
    spark = vectors.sparkSession
    sums = vectors.mapInArrow(_sums(dim), "i int, s string, n long, most long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"), F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("i").collect()
    n = sums[0].n
    centre = spark.sparkContext.broadcast(_Centre(n, [int(x.s) for x in sums], sums[0].most))
    table = written(vectors.mapInArrow(_factor(dim, centre, block), "k long, r array<double>"), "factors")
    level, upto = table, (table.agg(F.max("k")).first()[0] or 0) + 1
    while upto > 1:
        level, upto = level.groupBy(F.floor(F.col("k") / 8).alias("g")).applyInArrow(_stacked(dim), "k long, r array<double>"), -(-upto // 8)
    r = np.array(level.first().r).reshape(-1, dim)
    drop_written(table)
    values, directions = principal(np.vstack([r, np.zeros((dim - len(r), dim))]), n, most)
    return n, centre, values, directions, float((r * r).sum() / n)


def whitened(vectors: DataFrame, most: int = 8) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (vec_id, component, n, deviation, whitened, explained, identity_error), a row
    for each used vector and each of up to ``most`` components.

    Vectors are left out that are null or hold null, non-finite or huge entries (2^42 and more, which a long cannot hold
    times 1024 with room for sums), and those whose length is not the most frequent one (of equally frequent lengths the
    larger). An entry c becomes floor(1024 c) + 100000. Components without variance, beyond rounding, are left out: one
    vector, or equal vectors only, give no rows. deviation is exact, or null where a long cannot hold it. Repeated and
    null vec_ids are rows like others; other columns are not read; no vectors give no rows.
    """
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType), *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    finite = F.coalesce(F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float(1 << 42)), F.lit(False))), F.lit(False))
    good = vectors.select("vec_id", "embedding").filter(finite & (F.size("embedding") > 0))
    length = good.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    dim = length.dim
    good = good.filter(F.size("embedding") == dim)
    n, centre, values, directions, trace = fit(good, dim, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    k = len(values)
    basis = spark.sparkContext.broadcast(directions / np.sqrt(values))
    moments = good.select("embedding").mapInArrow(_moments(dim, centre, basis), "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toPandas().s.to_numpy().reshape(k + 1, k) / n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())
    out = good.mapInArrow(_projected(dim, centre, basis), T.StructType([schema["vec_id"], *T.StructType.fromDDL("deviation long, component int, whitened double").fields]))
    explained = F.element_at(F.array(*[F.lit(float(x / trace)) for x in values]), F.col("component"))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
