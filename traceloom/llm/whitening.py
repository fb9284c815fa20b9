"""Whitening of embeddings: leading eigenpairs of their covariance by Jacobi-Davidson, and the rows projected on them.

The covariance matrix is never formed. Its product with a few vectors is one pass over the fit list: each task centres
its rows, multiplies, and sums; a pass has a few tasks a core, whose sums are added. Jacobi-Davidson keeps a small orthonormal
subspace. Rayleigh-Ritz gives the best approximations in it; for each that is not exact yet the correction equation
``(I - QQ')(V - theta)(I - QQ') t = -r``, with Q the locked vectors and the approximation, is solved roughly by MINRES,
and the corrections extend the subspace. Pairs are locked as their residuals reach double precision, and later
ones are kept orthogonal to them. The corrections of all pairs share their passes.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import table

SCALE, COMPONENTS = 256, 4
#: Rows of a block of the fit list; columns the subspace may have, as multiples of the pairs wanted; MINRES steps of a correction.
ROWS, WIDEST, STEPS, ROUNDS = 4096, 6, 12, 100
#: Tasks of a pass, as a multiple of the cluster's cores; each sends one sum of dimensions times columns to the driver.
TASKS = 2
#: A residual of so many units of rounding of the largest eigenvalue is double precision.
UNITS = 32
_LOW = 32
_BLOCK = "n long, sums array<long>, cells binary"
_LONG = 2 ** 63


def usable(vectors: DataFrame, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id long, x array<long>)`` with ``x`` the floor of ``scale`` times each entry.

    Rows whose vector is null or holds null, NaN or infinite entries are dropped. Repeated rows and null ids stay. An
    entry beyond what a long holds stops at its end.
    """
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    plain = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))

    def cell(c):
        y = F.lit(float(scale)) * c
        return (F.when(y >= float(_LONG), F.lit(_LONG - 1)).when(y <= -float(_LONG), F.lit(-_LONG)).otherwise(F.floor(y)))

    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & plain)
            .select("vec_id", F.transform("v", cell).alias("x")))


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of longs; shorter ones go on in zeros."""
    width = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(width), dims), np.int64)
    out[np.arange(dims)[None, :] < width[:, None]] = lists.flatten().to_numpy()
    return out


class FitList:
    """Each distinct vector once, packed in blocks that Spark holds, and products of its covariance with vectors."""

    def __init__(self, vectors: DataFrame, rows: int = ROWS):
        self.dims = vectors.agg(F.max(F.size("x"))).first()[0] or 0
        dims = self.dims

        def pack(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    x = _matrix(batch.column(0).slice(at, rows), dims)
                    high, low = (x >> _LOW).sum(0), (x & ((1 << _LOW) - 1)).sum(0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([len(x)], pa.int64()), pa.array([np.r_[high, low].tolist()], pa.list_(pa.int64())),
                         pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["n", "sums", "cells"])

        zeros = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))    # one vector, one spelling
        blocks = written(vectors.select(zeros.alias("x")).distinct().mapInArrow(pack, _BLOCK))
        tasks = TASKS * vectors.sparkSession.sparkContext.defaultParallelism
        self.blocks = blocks.coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        parts = (self.blocks.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i")
                 .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(19,0)")).alias("s")).collect())
        whole = {r["i"]: int(r["s"]) for r in parts}
        self.n = parts[0]["n"] if parts else 0
        self.sums = [(whole[i] << _LOW) + whole[i + dims] for i in range(dims)] if parts else []
        self.mean = np.array([float(Decimal(s) / Decimal(self.n)) for s in self.sums])
        self.passes = 0

    def total(self, of, size: int) -> np.ndarray:
        """The sum of ``of(centred rows)``, ``size`` doubles, over all blocks: by task, and of the tasks' sums here."""
        dims, mean = self.dims, self.mean

        def run(batches):
            own = np.zeros(size)
            for batch in batches:
                for cells in batch.column(0):
                    own += of(np.frombuffer(cells.as_buffer(), "<i8").reshape(-1, dims) - mean).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([own.tolist()], pa.list_(pa.float64()))], names=["own"])

        self.passes += 1
        rows = self.blocks.select("cells").mapInArrow(run, "own array<double>").collect()
        return np.sum([r["own"] for r in rows], axis=0) if rows else np.zeros(size)

    def product(self, v: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``v``."""
        return self.total(lambda x: x.T @ (x @ v), v.size).reshape(v.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda x: np.array([(x * x).sum()]), 1)[0]) / self.n

    def covariance_of(self, of, k: int) -> np.ndarray:
        """The covariance of the ``k`` values ``of(centred rows)``, divisor n, centred before multiplying."""
        mean = self.total(lambda x: of(x).sum(0), k) / self.n

        def products(x):
            y = of(x) - mean
            return y.T @ y

        return self.total(products, k * k).reshape(k, k) / self.n

    def release(self) -> None:
        self.blocks.unpersist()


def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The columns of ``new`` made orthogonal to each other and to ``against``; those that then vanish are left out."""
    kept = [a for a in against if a.shape[1]]
    out = np.zeros((len(new), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            for q in (*kept, out):
                v = v - q @ (q.T @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        else:
            out = np.column_stack([out, v])
    return out


def minres(operate, right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one per column; ``operate(t)`` applies each column's own operator."""
    beta = np.linalg.norm(right, axis=0)
    start = beta.copy()
    old, v = np.zeros_like(right), right / np.where(beta > 0, beta, 1)
    x, w, w_old = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    c, s = -np.ones_like(beta), np.zeros_like(beta)
    delta, epsilon, phi = np.zeros_like(beta), np.zeros_like(beta), beta.copy()
    live = beta > 0
    for step in range(steps):
        y = operate(v)
        if step:
            y = y - beta * old
        alpha = (v * y).sum(0)
        y = y - alpha * v
        after = np.linalg.norm(y, axis=0)
        # the last rotation on the new column of the tridiagonal matrix, then a new one
        delta_now, gamma_bar = c * delta + s * alpha, s * delta - c * alpha
        epsilon_now, delta_next = s * after, -c * after
        gamma = np.hypot(gamma_bar, after)
        safe = np.where(gamma > 0, gamma, 1)
        c, s = gamma_bar / safe, after / safe
        w_new = (v - epsilon * w_old - delta_now * w) / safe
        live = live & (gamma > 1e-14 * start)
        x = np.where(live, x + c * phi * w_new, x)
        phi = np.where(live, s * phi, phi)
        w_old, w, epsilon, delta = w, w_new, epsilon_now, delta_next
        live = live & (np.abs(phi) > enough * start) & (after > 1e-14 * start)
        if not live.any():
            break
        old, v, beta = v, y / np.where(after > 0, after, 1), after
    return x


def jacobi_davidson(product, dims: int, k: int, steps: int = STEPS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)``: the ``k`` largest eigenpairs of a symmetric matrix known by ``product(columns)``.

    ``vectors`` has one unit column per value, values falling. A pair is locked when its residual is at most ``UNITS``
    roundings of the largest value, or at most 1e-12 of it and no smaller than a round before.
    """
    k = min(k, dims)
    values, locked = np.zeros(0), np.zeros((dims, 0))
    q = orthonormal(np.random.default_rng(seed).standard_normal((dims, min(dims, 2 * k))))
    w = product(q)
    before = np.full(k, np.inf)
    for _ in range(ROUNDS):
        h = q.T @ w
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        q, w = q @ y, w @ y
        want = min(k - len(values), q.shape[1])
        r = w[:, :want] - theta[:want] * q[:, :want]
        r = r - locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        most = max(abs(theta[0]) if len(theta) else 0.0, values[0] if len(values) else 0.0)
        fine = UNITS * np.finfo(float).eps * most
        done = 0
        while done < want and (size[done] <= fine or (size[done] <= 1e-12 * most and size[done] > 0.5 * before[done])):
            done += 1
        before[:want] = size
        before = np.r_[before[done:], np.full(done, np.inf)]
        values, locked = np.r_[values, theta[:done]], np.column_stack([locked, q[:, :done]])
        if len(values) == k:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        q, w, theta, r = q[:, done:], w[:, done:], theta[done:], r[:, done:]
        want = min(k - len(values), q.shape[1])
        if q.shape[1] + want > WIDEST * k:                                   # restart from the best of the subspace
            q, w, theta = q[:, :2 * k], w[:, :2 * k], theta[:2 * k]
        if want:
            u, shift = q[:, :want], theta[:want]

            def operate(t):
                t = _beside(t, locked, u)
                return _beside(product(t) - shift * t, locked, u)

            t = minres(operate, -_beside(r[:, :want], locked, u), steps, 1e-3)
        else:
            t = np.zeros((dims, 0))
        new = orthonormal(t, locked, q)
        if not new.shape[1]:                                                 # nothing new: any direction that is left
            new = orthonormal(np.random.default_rng(seed := seed + 1).standard_normal((dims, k)), locked, q)
        if new.shape[1]:
            q, w = np.column_stack([q, new]), np.column_stack([w, product(new)])
    raise RuntimeError(f"residuals {size} after {ROUNDS} rounds")


def _beside(t: np.ndarray, locked: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Each column without its part along the locked vectors and along its own vector."""
    t = t - locked @ (locked.T @ t)
    return t - own * (own * t).sum(0)


def whiten(vectors: DataFrame, k: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` per row of :func:`usable` and component.

    The fit list is each distinct vector once. ``deviation`` is the exact sum over dimensions of ``(n*x - S)**2``, null
    where no long holds it. Shorter vectors go on in zeros. Components without variance (equal vectors, fewer vectors
    than components) are left out; without any, or without rows, the result is empty.
    """
    fit = FitList(vectors)
    n, dims, sums, mean = fit.n, fit.dims, fit.sums, fit.mean
    values, basis, explained, error = np.zeros(0), np.zeros((dims, 0)), [], 0.0
    if n and dims:
        trace = fit.trace()
        if trace > 0:
            values, basis = jacobi_davidson(fit.product, dims, k, steps)
            some = values > dims * np.finfo(float).eps * trace
            values, basis = values[some], basis[:, some]
            explained = (values / trace).tolist()
            scaled = basis / np.sqrt(values)
            error = float(np.abs(fit.covariance_of(lambda x: x @ scaled, len(values)) - np.eye(len(values))).max())
    fit.release()
    count = len(values)
    onto = basis / np.sqrt(values)
    within = max(map(abs, sums), default=0)

    def deviation(x: np.ndarray) -> list:
        top = n * int(max(x.max(initial=0), -int(x.min(initial=0)))) + within
        if top * top * dims < _LONG:
            d = n * x - np.array(sums, np.int64)
            return (d * d).sum(1).tolist()
        exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
        return [int(e) if e < _LONG else None for e in exact]

    def project(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(1), dims)
                white = (x - mean) @ onto
                each = np.repeat(np.arange(len(x)), count)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                     pa.array(np.full(len(each), n), pa.int64()),
                     pa.array(deviation(x), pa.int64()).take(pa.array(each)), pa.array(white.ravel()),
                     pa.array(np.tile(np.array(explained, float), len(x))), pa.array(np.full(len(each), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "x").mapInArrow(
        project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_whitening(spark, sf_dir):
    return whiten(usable(table(spark, sf_dir, "embeddings")))
