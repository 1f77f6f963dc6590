"""Communities by rounds over tables, held against the sequential procedure."""

import random
from collections import defaultdict

import plain_communities as plain
import pytest

from txloom.operators import communities, graph, indicators


def planted(blocks, size, seed, inside=0.5, between=0.02):
    r = random.Random(seed)
    n = blocks * size
    return [(f"n{a:03d}", f"n{b:03d}") for a in range(n) for b in range(a) if r.random() < (inside if a // size == b // size else between)]


def table(spark, pairs):
    return graph.symmetric(spark.createDataFrame(pairs, "src string, dst string"))


def parts(found):
    out = defaultdict(set)
    for i, c in found.items():
        out[c].add(i)
    return out


@pytest.fixture(scope="module")
def blocks(spark):
    pairs = planted(5, 14, 1) + [("x1", "x2"), ("y1", "y2"), ("y2", "y3")]
    return pairs, table(spark, pairs)


@pytest.mark.parametrize("detect", [communities.louvain, communities.leiden])
def test_planted_blocks(spark, blocks, detect):
    pairs, u = blocks
    ids, near = plain.adjacency(pairs)
    found = {r[0]: r[1] for r in detect(u).collect()}
    assert found.keys() == set(ids)
    sequential = plain.modularity(near, plain.louvain_partition(near, len(pairs)))
    ours = plain.modularity(near, [found[i] for i in ids])
    assert ours >= 0.98 * sequential
    assert indicators.modularity(u, spark.createDataFrame([*found.items()], "id string, comm int")).first()[0] == pytest.approx(ours)
    assert found["x1"] == found["x2"] and len({found[f"n{14 * b + i:03d}"] for b in range(5) for i in range(14)}) == 5
    leads = [min(members) for _, members in sorted(parts(found).items())]
    assert leads == sorted(leads) and sorted(parts(found)) == list(range(len(leads)))  # numbered by smallest member


def test_leiden_communities_are_connected(spark):
    """Sparse: local moves leave bridges behind, which would disconnect communities."""
    r = random.Random(8)
    pairs = sorted({(f"a{min(p)}", f"a{max(p)}") for p in ((i, r.randint(max(0, i - 12), i - 1)) for i in range(1, 60) for _ in range(1 + (i % 3 == 0)))})
    ids, near = plain.adjacency(pairs)
    found = {r[0]: r[1] for r in communities.leiden(table(spark, pairs)).collect()}
    joined = {i: i for i in ids}

    def root(i):
        while joined[i] != i:
            i = joined[i]
        return i

    for a, b in pairs:
        if found[a] == found[b]:
            joined[root(a)] = root(b)
    assert all(len({root(i) for i in members}) == 1 for members in parts(found).values())
    assert plain.modularity(near, [found[i] for i in ids]) >= 0.98 * plain.modularity(near, plain.louvain_partition(near, len(pairs), refine=True))


def test_split_into_connected_parts(spark):
    edges = spark.createDataFrame([(a, b) for p in [(1, 2), (2, 3), (3, 4), (5, 6)] for a, b in (p, p[::-1])], "a long, b long")
    members = spark.createDataFrame([(1, 9), (2, 9), (3, 8), (4, 9), (5, 8), (6, 8), (7, 8)], "node long, comm long")
    got = {r.node: r.comm for r in communities._connected(edges, members).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}


def test_no_edges(spark):
    assert communities.louvain(spark.createDataFrame([], "src string, dst string")).collect() == []
