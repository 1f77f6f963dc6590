"""Centralities of shortest paths by joins, held against searches from every node."""

import random

import numpy as np
import plain_paths as plain
import pytest

from txloom.operators import graph, indicators


@pytest.fixture(scope="module")
def sparse(spark):
    """A tree with shortcuts, a ring, and some pairs: several blocks of 64 roots."""
    r = random.Random(4)
    pairs = {(f"t{i:03d}", f"t{r.randint(max(0, i - 9), i - 1):03d}") for i in range(1, 150)} | {(f"t{r.randint(0, 149):03d}", f"t{i:03d}") for i in range(0, 150, 5)}
    pairs = {p for p in pairs if p[0] != p[1]} | {(f"r{i}", f"r{(i + 1) % 11}") for i in range(11)} | {("x", "y"), ("p", "q")}
    pairs = sorted(pairs)
    return pairs, graph.symmetric(spark.createDataFrame(pairs, "src string, dst string"))


def values(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.mark.parametrize("hops", [1, 4])
def test_closeness(sparse, hops):
    pairs, u = sparse
    ids, start, to = plain.arrays(pairs)
    want = {}
    for i, v in enumerate(ids):
        d = plain.distances(start, to, i)
        want[v] = (len(d) - 1) / sum(d.values())
    assert values(indicators.closeness(u, hops)) == pytest.approx(want)


def test_betweenness_is_that_of_the_arrays(sparse):
    pairs, u = sparse
    ids, start, to = plain.arrays(pairs)
    n = len(ids)
    total = sum(plain.dependencies(start, to, i) for i in range(n)) / ((n - 1) * (n - 2))
    assert values(indicators.betweenness(u)) == pytest.approx(dict(zip(ids, total.tolist())))


def test_sampled_betweenness_uses_the_first_pivots_by_hash(sparse):
    import hashlib

    pairs, u = sparse
    ids, start, to = plain.arrays(pairs)
    n, k = len(ids), 30
    roots = sorted(range(n), key=lambda i: hashlib.md5(f"42|{ids[i]}".encode()).hexdigest())[:k]
    total = np.sum([plain.dependencies(start, to, i) for i in roots], 0) / ((n - 1) * (n - 2)) * n / k
    assert values(indicators.betweenness(u, exact_up_to=10, pivots=k)) == pytest.approx(dict(zip(ids, total.tolist())))


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert indicators.closeness(none).collect() == [] and indicators.betweenness(none).collect() == []
