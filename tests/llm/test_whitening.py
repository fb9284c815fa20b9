"""Whitening against numpy's dense eigenpairs and exact integers."""

import math
import random

import numpy as np
import pytest

from traceloom.llm import whitening as W

ROW = "vec_id long, embedding array<float>, label int, x string"


def brute(rows):
    """Kept rows, the distinct vectors, and the covariance's eigenpairs, by exact sums and a dense solver."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, *_ in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in kept), default=0)
    kept = [(i, tuple(v) + (0,) * (dims - len(v))) for i, v in kept]
    fit = sorted(set(v for _, v in kept))
    x = np.array(fit, float).reshape(len(fit), dims)
    sums = [sum(v[j] for v in fit) for j in range(dims)]
    c = x - np.array(sums) / max(1, len(fit))
    v = c.T @ c / max(1, len(fit))
    e, u = np.linalg.eigh(v) if dims else (np.zeros(0), np.zeros((0, 0)))
    return kept, fit, sums, e[::-1], u[:, ::-1], np.trace(v)


def check(spark, rows, k=4):
    kept, fit, sums, e, u, trace = brute(rows)
    found = W.whiten(W.usable(spark.createDataFrame(rows, ROW)), k).collect()
    n, parts = len(fit), sum(x > 1e-12 * max(trace, 1e-300) for x in e[:k])
    assert len(found) == len(kept) * parts
    want = sorted(((i, c + 1, v) for i, v in kept for c in range(parts)), key=str)
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for i, c, v in want:
        y = (np.array(v) - np.array([s / n for s in sums])) @ u[:, c - 1] / math.sqrt(e[c - 1])
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        near = [r for r in by[i, c] if r["deviation"] == dev]
        assert near and any(abs(abs(r["whitened"]) - abs(y)) < 1e-9 for r in near)
        if len(near) == 1 and abs(y) > 1e-3:
            signs.setdefault(c, set()).add(math.copysign(1, y * near[0]["whitened"]))
    assert all(len(s) == 1 for s in signs.values())
    for r in found:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert abs(r["explained"] / (e[r["component"] - 1] / trace) - 1) < 1e-10


def test_table_as_dense(spark):
    rows = [(r["vec_id"], r["embedding"], 1, "x") for r in
            spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(spark, rows)


def test_odd_rows_lengths_and_repeats(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(7)], 1, "x") for i in range(60)]
    rows += rows[:5] * 3 + [(None, rows[0][1], 1, "x"), (None, [1.0] * 7, 1, "x"), (5, [2.0] * 7, None, None)]
    rows += [(70, None, 1, "x"), (71, [1.0, None] + [0.0] * 5, 1, "x"), (72, [float("nan")] * 7, 1, "x"),
             (73, [float("inf")] + [0.0] * 6, 1, "x"), (74, [], 1, "x"), (75, [0.5, -0.5], 1, "x"), (75, [0.5, -0.5], 1, "x")]
    check(spark, rows)
    check(spark, rows, 1)


def test_few_or_equal_vectors(spark):
    check(spark, [(1, [0.5, 0.25, 1.0], 1, "x"), (2, [0.25, 0.5, 0.0], 1, "x")])
    check(spark, [(1, [1.0, 0.0], 1, "x"), (2, [0.0, 1.0], 1, "x"), (3, [0.0, 0.0], 1, "x")])
    for rows in ([], [(1, [0.5, 0.25], 1, "x")] * 3, [(1, [], 1, "x")], [(1, None, 1, "x")]):
        assert W.whiten(W.usable(spark.createDataFrame(rows, ROW))).count() == 0


def test_large_entries_do_not_fail(spark):
    rows = [(1, [1e30, 0.0], 1, "x"), (2, [-3e38, 1.0], 1, "x"), (3, [5.0, 2.0], 1, "x"), (4, [1e12, 4.0], 1, "x")]
    found = W.whiten(W.usable(spark.createDataFrame(rows, ROW))).collect()
    assert {r["vec_id"] for r in found} == {1, 2, 3, 4} and all(r["deviation"] is None for r in found)
    rows = [(i, [float(2 ** 18 * i), float(2 ** 16 * (i % 3))], 1, "x") for i in range(9)]      # past 63 bits on the way, exact at the end
    check(spark, rows)


@pytest.mark.parametrize("values", [[9, 9, 9, 5, 5, 1], [4, 3, 2, 1], [1e8, 1, 1e-2, 1e-3, 0], [7], [3, 3 - 1e-9, 1, 0.5, 0.2]])
def test_pairs_close_or_equal(values):
    rng = np.random.default_rng(len(values))
    dims = max(len(values), 40)
    basis = np.linalg.qr(rng.standard_normal((dims, dims)))[0][:, :len(values)]
    a = basis @ np.diag(values).astype(float) @ basis.T
    calls = []

    def product(v):
        calls.append(v.shape[1])
        return a @ v

    e, u = W.jacobi_davidson(product, dims, 4)
    want = np.r_[np.sort(values)[::-1], np.zeros(4)][:4]
    assert np.allclose(e, want, atol=1e-13 * values[0] * 10) and np.allclose(u.T @ u, np.eye(4), atol=1e-12)
    assert np.linalg.norm(a @ u - u * e, axis=0).max() <= 1e-12 * values[0]


def test_minres_solves():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 3))
    shift = np.array([0.1, 2.0, -3.0])
    x = W.minres(lambda t: a @ t - shift * t, b, 60, 1e-12)
    assert np.abs(a @ x - shift * x - b).max() < 1e-8
