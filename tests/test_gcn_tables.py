"""Networks trained through edge joins against the array code on the same graph."""

import random

import numpy as np
import pytest

from txloom.operators import gcn_tables, gnn
from txloom.plans import experiments


@pytest.fixture(scope="module")
def toy(spark):
    """A hub, two clusters, a lone node, unlabelled rows, an edge to no node and repeated edges."""
    r, n = random.Random(4), 90
    pairs = [(i, j) for i in range(n) for j in r.sample(range(n), 3) if (i + j) % 2 == 0 or r.random() < 0.1]
    pairs += [(0, j) for j in range(1, n)] + [(1, 3), (1, 3), (3, 1), (5, 5), (7, 1000)]
    nodes = [(f"{i:03}", None if i % 11 == 5 else i % 2, ("train", "train", "validation", "test", None)[(i // 2) % 5], i % 2 + r.gauss(0, 1), r.gauss(0, 1), r.random()) for i in range(n)]
    nodes.append(("lone", 1, "train", 0.5, 0.5, 0.5))
    e = spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in pairs], "src string, dst string")
    return e, spark.createDataFrame(nodes, "id string, label int, split string, f_0 double, f_1 double, f_2 double"), ["f_0", "f_1", "f_2"]


@pytest.fixture(scope="module")
def both(toy):
    tables = gcn_tables.Tables(*toy)
    yield tables, *gnn.load_graph(*toy)
    tables.close()


@pytest.mark.parametrize("hidden", [[], [5], [6, 4]])
@pytest.mark.parametrize("parts, weighted", [((0,), True), ((0, 1), False)])
def test_steps_equal_the_array_code(both, hidden, parts, weighted):
    tables, g, _ = both
    params = {"hidden": hidden, "class_weights": weighted}
    w = gnn.init_layers([3, *hidden, 2], 3)
    want, loss = gnn.gcn_step(g, params, parts)(w)
    got, found = tables.step(w, params, parts)
    assert found == pytest.approx(loss, abs=1e-9) and got.keys() == want.keys()
    for k in w:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_hot_sources_are_split_and_others_are_not_lost(both):
    tables, g, _ = both
    assert tables.nodes.agg({"salts": "max"}).first()[0] > 1
    assert tables.edges.count() == len(g.to) and tables.edges.filter("src = '000'").select("part").distinct().count() > 1


def test_a_run_equals_the_array_code(toy, both):
    _, g, ids = both
    params = {"hidden": [4], "lr": 0.05}
    out, info = gcn_tables.run(*toy, params, epochs=4)
    w, want = gnn.train_gcn(g, params, 4)
    assert info["best_epoch"] == want["best_epoch"] and info["val_loss"] == pytest.approx(want["val_loss"], abs=1e-9)
    late, seen = gnn.gcn_forward(g, gnn.refit_gcn(g, params, want["best_epoch"] + 1))
    p = np.where(g.split == 1, gnn.gcn_forward(g, w)[0][:, 0], late[:, 0])
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == len(ids) and [rows[i].p0 for i in ids] == pytest.approx(list(p), abs=1e-9)
    assert np.array([rows[i].emb for i in ids]) == pytest.approx(seen[-2][1], abs=1e-9)


def test_an_empty_graph_and_nodes_without_labels(spark):
    e = spark.createDataFrame([], "src string, dst string")
    nodes = spark.createDataFrame([("a", None, "train", 1.0), ("b", None, None, 2.0)], "id string, label int, split string, f double")
    out, info = gcn_tables.run(e, nodes, ["f"], {"hidden": [2]}, epochs=1)
    assert out.count() == 2 and info["best_epoch"] == 0
    out, _ = gcn_tables.run(e, nodes.limit(0), ["f"], {"hidden": [2]}, epochs=1)
    assert out.count() == 0


def test_training_stops_when_the_loss_has_not_fallen_for_the_patience():
    losses = iter([9, 5, 4, *[6] * 50])
    seen = []

    def step(w):
        seen.append(w["w0"].copy())
        return {"w0": np.ones(1)}, next(losses)

    best, info = gnn.descend(step, {"w0": np.zeros(1)}, {"lr": 0.1}, 40, 10)
    assert info == {"val_loss": 4.0, "best_epoch": 1} and len(seen) == 14 and best["w0"] == pytest.approx(seen[2])
    moves = -np.diff(np.concatenate(seen))
    assert moves[1] == pytest.approx(0.1, rel=1e-3) and moves[-1] == pytest.approx(0.05, rel=1e-3)


def test_signals_of_graphs_beyond_the_bound_go_through_joins(spark, toy):
    e, nodes, _ = toy
    nodes = nodes.withColumnRenamed("id", "tx_id").filter("split IS NOT NULL")
    near, far = (experiments.network_signal(e, nodes, "gcn", 3, 2, most=most) for most in (1_000_000, 0))
    assert near.dtypes == far.dtypes
    a, b = ({r.id: list(r)[1:] for r in t.collect()} for t in (near, far))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-5) for k in a)


def test_search_proposes_networks_with_falling_widths(spark, toy):
    g, _ = gnn.load_graph(*toy)
    rows = gnn.tune(spark, g, 12, 4, 5).orderBy("trial").collect()
    assert [r.trial for r in rows] == list(range(12))
    for r in rows:
        falls = all(a > b for a, b in zip(r.hidden, r.hidden[1:]))
        assert (r.val_loss is not None) == falls and len(r.hidden) <= 3 and 1e-4 <= r.lr <= 5e-2
