"""Skip-gram vectors of blocks that meet in turn."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from txloom.operators import graph, skipgram, walks


def test_pairs_are_those_of_windows(spark):
    r = random.Random(1)
    made = [[f"n{r.randint(0, 9)}" for _ in range(r.choice((1, 2, 7, 30)))] for _ in range(40)] + [[]]
    want = Counter()
    for w in made:
        for i, j in itertools.permutations(range(len(w)), 2):
            if abs(i - j) <= 4:
                want[w[i], w[j]] += (4 - abs(i - j) + 1) / 4
    got = {(x.centre, x.context): x.n for x in skipgram.window_pairs(spark.createDataFrame([(w,) for w in made], "walk array<string>").repartition(3), 4).collect()}
    assert got == pytest.approx(dict(want))


def test_a_step_follows_the_gradient():
    """The update's direction is the derivative of the stated likelihood."""
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=(3, 4)).astype(np.float32), rng.normal(size=(5, 4)).astype(np.float32)
    c, x, n = np.array([0, 2]), np.array([1, 3]), np.array([1.0, 1.0], np.float32)
    drawn = np.minimum(np.searchsorted(np.cumsum(np.ones(5)), (lambda g: (g.permutation(2), g.random((2, 3)))[1])(np.random.default_rng(9)) * 5, "right"), 4)
    order = np.random.default_rng(9).permutation(2)

    def likelihood(u):
        log = lambda s: -np.log1p(np.exp(-s))
        return sum(log(u[c[i]] @ v[x[i]]) + sum(log(-u[c[i]] @ v[j]) for j in drawn[k] if j != x[i]) for k, i in enumerate(order))

    slope = np.zeros((3, 4))
    for i, j in itertools.product(range(3), range(4)):
        e = np.zeros((3, 4))
        e[i, j] = 1e-4
        slope[i, j] = (likelihood(u + e) - likelihood(u - e)) / 2e-4
    a, b = u.copy(), v.copy()
    skipgram.train(a, np.zeros(3, np.float32), b, np.zeros(5, np.float32), np.ones(5), c, x, n, 3, 1e-3, 1, np.random.default_rng(9))
    for i in (0, 2):
        moved = (a - u)[i]
        assert moved @ slope[i] / np.linalg.norm(moved) / np.linalg.norm(slope[i]) > 0.999
    assert (a[1] == u[1]).all()


def test_neighbours_of_planted_communities(spark):
    r = random.Random(2)
    pairs = [(f"{a // 15}_{a:02d}", f"{b // 15}_{b:02d}") for a in range(60) for b in range(a) if r.random() < (0.5 if a // 15 == b // 15 else 0.01)]
    u = graph.symmetric(spark.createDataFrame(pairs, "src string, dst string"))
    corpus = walks.deepwalk(u, 5, 20)
    found = {x.id: np.array(x.emb) for x in walks.skipgram(corpus, dims=16, window=5, epochs=3, blocks=3).collect()}
    ids = sorted(found)
    assert len(ids) == len({v for p in pairs for v in p}) and all(len(x) == 16 and np.isfinite(x).all() for x in found.values())
    e = np.array([found[i] / np.linalg.norm(found[i]) for i in ids])
    near = e @ e.T - 2 * np.eye(len(ids))
    assert np.mean([ids[near[k].argmax()][0] == ids[k][0] for k in range(len(ids))]) >= 0.95
    again = {x.id: x.emb for x in walks.skipgram(corpus.repartition(5), dims=16, window=5, epochs=1, blocks=3).collect()}
    assert again == {x.id: x.emb for x in walks.skipgram(corpus, dims=16, window=5, epochs=1, blocks=3).collect()}


def test_walks_are_read_once_and_lone_nodes_kept(spark):
    """One pass over walks finds pairs and nodes; before, walks were computed again for the nodes."""
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    made = [["a", "b", "a"], ["c"], ["b", "d"], []]
    seen = spark.createDataFrame([(w,) for w in made], "walk array<string>").mapInArrow(through, "walk array<string>")
    found = {x.id: x.emb for x in skipgram.skipgram(seen, dims=4, window=2, epochs=1, blocks=2).collect()}
    assert set(found) == set("abcd") and read.value == len(made)


@pytest.mark.parametrize("own", [8, 40])
def test_small_components_train_without_meeting_others(spark, monkeypatch, own):
    """Pairs and quality of a graph of many components, alone (40) or with one that meets in turn (8): stored tables do not grow with the blocks."""
    r = random.Random(4)
    pairs = [(f"{c:02d}_{a}", f"{c:02d}_{b}") for c in range(40) for a, b in itertools.combinations(range(5), 2) if b == a + 1 or r.random() < 0.5] + [(f"w_{a:02d}", f"w_{(a + 1) % 20:02d}") for a in range(20)]
    corpus = walks.deepwalk(graph.symmetric(spark.createDataFrame(pairs, "src string, dst string")), 5, 20)
    stored, store = [], skipgram.materialize
    monkeypatch.setattr(skipgram, "materialize", lambda df, name: (stored.append(name), store(df, name))[1])
    monkeypatch.setattr(skipgram, "BLOCK_NODES", 10)
    monkeypatch.setattr(skipgram, "OWN_NODES", own)
    found = {x.id: np.array(x.emb) for x in skipgram.skipgram(corpus, dims=8, window=5, epochs=2).collect()}
    assert set(found) == {v for p in pairs for v in p} and all(np.isfinite(x).all() and np.abs(x).max() > 0.1 for x in found.values())
    assert stored.count("sg") == 1 + 2 * (1 if own == 40 else 8)  # 22 blocks by hash before
