"""Eigenpairs by joins, held against a dense solver."""

import random

import numpy as np
import pytest

from txloom.operators import eigen, graph, spectral


@pytest.fixture(scope="module")
def connected(spark):
    r = random.Random(6)
    pairs = sorted({(r.randint(max(0, i - 20), i - 1), i) for i in range(1, 150) for _ in range(1 + (i % 4 == 0))})
    return pairs, graph.symmetric(spark.createDataFrame([(f"{a:03d}", f"{b:03d}") for a, b in pairs], "src string, dst string"))


def dense(pairs, n):
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    d = a.sum(0)
    return np.eye(n) - a / np.sqrt(np.outer(d, d))


def test_pairs_and_subspace(spark, connected):
    pairs, _ = connected
    lap = dense(pairs, 150)
    entries = spark.createDataFrame([(a, b, -float(lap[a, b])) for p in pairs for a, b in (p, p[::-1])], "a long, b long, w double")
    values, vectors = eigen.smallest_pairs(entries, 12, tol=1e-6)
    want, exact = np.linalg.eigh(lap)
    assert values == pytest.approx(want[:12], abs=1e-8)
    found = np.zeros((150, 32))
    for row in vectors.collect():
        found[row["node"], row["g"] * 16 : row["g"] * 16 + 16] = [row[x] for x in eigen.X]
    found = found[:, :12]
    assert np.abs(found.T @ found - np.eye(12)).max() < 1e-8
    assert np.abs(lap @ found - found * values).max() < 1e-5
    k = max(i for i in range(1, 12) if want[i] - want[i - 1] > 1e-3)  # up to a gap
    angle = np.linalg.norm(found[:, :k] - exact[:, :k] @ (exact[:, :k].T @ found[:, :k]), 2)
    assert angle < 1e-3
    assert all(found[np.abs(found[:, i]).round(9).argmax(), i] > 0 for i in range(12))


def test_giant_components_span_what_tasks_span(spark, connected):
    _, u = connected
    u = u.unionByName(graph.symmetric(spark.createDataFrame([("x", "y")], "src string, dst string")))
    by_joins, in_tasks = ({r.id: r.emb for r in spectral.spectral(u, 8, in_task=k).collect()} for k in (60, 1000))
    ids = sorted(by_joins)
    assert ids == sorted(in_tasks) and len(ids) == 152 and all(len(x) == 8 for x in by_joins.values())
    assert by_joins["x"] == in_tasks["x"]
    a, b = (np.array([t[i] for i in ids[:150]]) for t in (by_joins, in_tasks))
    assert np.linalg.svd(a.T @ b)[1].min() > 0.999 and np.abs(a.T @ a - np.eye(8)).max() < 1e-6


def test_unfinished_iterations_raise(spark, connected):
    pairs, _ = connected
    entries = spark.createDataFrame([(a, b, 0.3) for p in pairs for a, b in (p, p[::-1])], "a long, b long, w double")
    with pytest.raises(RuntimeError, match="converge"):
        eigen.smallest_pairs(entries, 12, degree=1, tol=1e-12, rounds=1)
