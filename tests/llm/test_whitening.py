"""Whitening against a dense eigenvalue solver and hand-made rows."""

import math

import numpy as np
import pytest

from foldmark.llm import whitening

SHAPE = "vec_id long, embedding array<double>, label int, n long, component int, deviation string, whitened double"


def rows_of(spark, vectors, parts=3):
    rows = [(i if i >= 0 else None, v, 1, 2, 3, "x", 0.5) for i, v in vectors]
    return spark.createDataFrame(rows, SHAPE).repartition(parts)


def brute(vectors):
    """By vector: x, and over all: n, sums, eigenvalues and components of a dense solver."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    z = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    e, u = np.linalg.eigh(z.T @ z / n)
    return x, n, sums, z, e[::-1], u[:, ::-1]


def test_against_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(400, 40)) @ rng.normal(size=(40, 40)) * np.logspace(0, -1.5, 40)).tolist()
    x, n, sums, z, e, u = brute(data)
    got = whitening.whitened(rows_of(spark, list(enumerate(data)))).collect()
    assert len(got) == 400 * 32
    signs = {}
    for r in got:
        i, k = r["vec_id"], r["component"] - 1
        want = float(z[i] @ u[:, k]) / math.sqrt(e[k])
        sign = signs.setdefault(k, 1 if want * r["whitened"] > 0 else -1)
        assert r["whitened"] * sign == pytest.approx(want, rel=1e-6, abs=1e-8)
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[i], sums))
        assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9)
        assert r["n"] == n and r["identity_error"] < 1e-9


def test_incomplete_vectors_ties_and_types(spark):
    good = [(1, [0.5, 0.25, -1.0]), (1, [0.5, 0.25, -1.0]), (2, [1.0, 0.0]), (-1, [0.0, 3.5, 2.0]), (4, []), (5, [2.0, 2.0, 7.0])]
    bad = [(6, None), (7, [1.0, None, 2.0]), (8, [float("nan"), 0.0, 0.0]), (9, [float("inf"), 0.0, 0.0])]
    out = whitening.whitened(rows_of(spark, good + bad))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert {r["n"] for r in got} == {6} and len(got) == 18
    assert sorted({str(r["vec_id"]) for r in got}) == ["1", "2", "4", "5", "None"]
    padded = [v + [0.0] * (3 - len(v)) for _, v in good]
    x, n, sums, *_ = brute(padded)
    want = sorted(sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == want
    assert max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize("data", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]] * 3])
def test_nothing_to_whiten(spark, data):
    assert whitening.whitened(rows_of(spark, list(enumerate(data)))).collect() == []


def test_dependent_directions_have_no_component(spark):
    data = [[float(i), 2.0 * i, float(i * i % 7)] for i in range(50)]
    got = whitening.whitened(rows_of(spark, list(enumerate(data)))).collect()
    assert {r["component"] for r in got} == {1, 2}
    assert got[0]["identity_error"] < 1e-9


def test_numbers_beyond_a_long(spark):
    data = [[1e38, 1.0], [-3e38, 2.0], [2e37, 1e30]]
    got = whitening.whitened(rows_of(spark, list(enumerate(data)))).collect()
    assert {r["deviation"] for r in got} == {None} and {r["component"] for r in got} == {1}
    assert all(math.isfinite(r["whitened"]) for r in got)


def test_factor_and_rotation():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(30, 9))
    v = a @ a.T
    g = whitening.pivoted_cholesky(v)
    assert g.shape == (30, 9) and np.allclose(g @ g.T, v)
    e, u = whitening.jacobi(g)
    assert np.all(np.diff(e) <= 0) and np.allclose(u.T @ u, np.eye(9), atol=1e-12)
    assert np.allclose(v @ u, u * e)
