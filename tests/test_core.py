"""Operators on tiny known graphs and tables, with closed-form or brute-force expectations."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from txloom.functions import columns as C
from txloom.functions import storage
from txloom.operators import analysis, communities, features, gnn, graph, indicators, metrics, models, preprocess, sampling, spectral, structural, walks
from txloom.plans import experiments
from txloom.sources import readers, sinks


def frame(spark, pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")


def values(df, column):
    return {r["id"]: r[column] for r in df.collect()}


@pytest.fixture(scope="module")
def shapes(spark):
    """A path of 5, a star of 5, a cycle of 4, a clique of 4, all apart."""
    pairs = [(f"p{i}", f"p{i + 1}") for i in range(4)] + [("s0", f"s{i}") for i in range(1, 5)]
    pairs += [(f"c{i}", f"c{(i + 1) % 4}") for i in range(4)] + [(f"k{i}", f"k{j}") for i in range(4) for j in range(i)]
    return graph.symmetric(frame(spark, pairs)).cache()


def test_graph_construction(spark):
    e = graph.edges(frame(spark, [(1, 2), (1, 2), (2, 1), (3, 3), (3, 4)]).union(spark.createDataFrame([(None, "9")], "src string, dst string")))
    assert e.count() == 4 and graph.without_loops(e).count() == 3
    assert Counter(map(tuple, graph.canonical_edges(graph.without_loops(e)).collect())) == Counter([("1", "2"), ("3", "4")])
    assert graph.with_loops(graph.symmetric(e)).count() == 4 + 4 and graph.clique(spark, 5).count() == 10 and graph.clique(spark, 1).count() == 0
    h = [graph.content_hash(x).first()["graph_hash"] for x in (e, e.repartition(7), e.filter("src <> '3'"))]
    assert h[0] == h[1] != h[2]
    assert graph.has_edge(e, frame(spark, [(1, 2), (4, 3)])).count() == 1


def test_subsample_is_exact_and_independent_of_partitions(spark):
    e = frame(spark, [(i, i + 1) for i in range(101)])
    a, b = graph.subsample(e, 0.25), graph.subsample(e.repartition(17), 0.25)
    assert a.count() == round(0.75 * 101) and set(map(tuple, a.collect())) == set(map(tuple, b.collect()))


def test_dense_index_and_hash_rank(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k")).repartition(9)
    got = {r.k: r.i for r in storage.dense_index(df, "k", "i").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}
    ranked = storage.hash_rank(df.withColumn("h", storage.hash_key(1, "k")), [], "h", "r", digits=1).orderBy("r").collect()
    assert [r.r for r in ranked] == list(range(1, 501)) and [r.h for r in ranked] == sorted(r.h for r in ranked)


def test_closed_forms(shapes):
    comp = values(graph.components(shapes), "comp")
    assert all(c == min(k for k in comp if k[0] == v[0]) for v, c in comp.items())
    tri, core, clus, sq = (values(f(shapes), c) for f, c in ((indicators.triangles, "gi_triangles"), (indicators.core_number, "gi_core_number"), (indicators.clustering, "gi_clustering_coefficient"), (indicators.square_clustering, "gi_square_clustering")))
    assert {v: tri[v] for v in ("p1", "s0", "c0", "k0")} == {"p1": 0, "s0": 0, "c0": 0, "k0": 3}
    assert {v: core[v] for v in ("p1", "s0", "c0", "k0")} == {"p1": 1, "s0": 1, "c0": 2, "k0": 3}
    assert clus["k0"] == 1 and clus["c0"] == 0 and sq["c0"] == 1 and sq["p1"] == 0 and sq["k0"] == 1
    close = values(indicators.closeness(shapes), "gi_closeness_centrality")
    assert close["s0"] == 1 and close["k2"] == 1 and close["p2"] == pytest.approx(4 / 6) and close["p0"] == pytest.approx(4 / 10) and close["c1"] == pytest.approx(3 / 4)
    assert values(indicators.closeness(shapes, hops=1), "gi_closeness_centrality") == pytest.approx(close)
    ev = values(indicators.eigenvector(shapes), "gi_eigenvector_centrality")
    assert ev["k1"] == pytest.approx(0.5, abs=1e-5) and ev["c2"] == pytest.approx(0.5, abs=1e-5) and ev["s0"] == pytest.approx(1 / math.sqrt(2), abs=1e-4)
    assert sum(x * x for v, x in ev.items() if v[0] == "p") == pytest.approx(1)
    b = values(indicators.betweenness(shapes), "gi_betweenness_centrality")
    n = len(b)
    assert b["s0"] * (n - 1) * (n - 2) == pytest.approx(12) and b["p2"] * (n - 1) * (n - 2) == pytest.approx(8) and b["p1"] * (n - 1) * (n - 2) == pytest.approx(6) and b["c0"] * (n - 1) * (n - 2) == pytest.approx(1) and b["k0"] == 0
    lap = {(r.i, r.j): r.value for r in indicators.laplacian(shapes).collect()}
    assert lap["k0", "k1"] == pytest.approx(-1 / 3) and lap["k0", "k0"] == 1


def test_sampled_betweenness_is_close(shapes):
    exact, some = (values(indicators.betweenness(shapes, exact_up_to=k, pivots=16), "gi_betweenness_centrality") for k in (5000, 2))
    assert set(exact) == set(some) and abs(some["s0"] - exact["s0"]) < exact["s0"]


def test_pagerank(spark):
    e = frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 4)])
    x = values(indicators.pagerank(e), "gi_pagerank")
    ids = sorted(x)
    m = np.zeros((5, 5))
    for a, b in [(0, 1), (1, 2), (2, 0), (2, 3), (4, 3)]:
        m[b, a] = 1
    out = m.sum(0)
    m = np.where(out > 0, m / np.where(out > 0, out, 1), 1 / 5)
    r = np.full(5, 0.2)
    for _ in range(300):
        r = 0.85 * m @ r + 0.03
    assert [x[i] for i in ids] == pytest.approx(r.tolist(), abs=1e-7) and sum(x.values()) == pytest.approx(1)
    assert indicators.pagerank(e.limit(0)).count() == 0


@pytest.mark.parametrize("detect, column", [(communities.louvain, "gi_community_louvain"), (communities.leiden, "gi_leiden_comm"), (communities.infomap, "gi_infomap_comm")])
def test_communities_of_two_cliques(spark, detect, column):
    pairs = [(f"a{i}", f"a{j}") for i in range(6) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(6) for j in range(i)] + [("a0", "b0"), ("x", "y")]
    u = graph.symmetric(frame(spark, pairs))
    c = values(detect(u), column)
    assert len({c[v] for v in c if v[0] == "a"}) == 1 and len({c[v] for v in c if v[0] == "b"}) == 1 and c["a0"] != c["b0"] and c["x"] == c["y"]
    members = detect(u).toDF("id", "comm")
    assert indicators.modularity(u, members).first()[0] > 0.4
    extras = {r.id: r for r in indicators.community_extras(u, members).collect()}
    assert extras["a1"].gi_comm_size == 6 and extras["a1"].gi_comm_density == 1 and extras["x"].gi_comm_is_small == 1
    assert sum(extras["a1"][f"gi_comm_code_{i}"] ** 2 for i in range(1, 6)) == pytest.approx(1)


def test_walks_follow_edges(spark, shapes):
    edges = {(r.src, r.dst) for r in shapes.collect()}
    for w in (walks.deepwalk(shapes, 2, 12), walks.node2vec(shapes, "dfs", 2, 12), walks.role2vec(shapes, indicators.wl_labels(shapes), walks=2, length=12)):
        rows = w.collect()
        assert len(rows) == 36 and all(len(r.walk) == 12 for r in rows)
        assert all(p in edges for r in rows for p in zip(r.walk, r.walk[1:]))
    again = {r.walk_id: r.walk for r in walks.node2vec(shapes.repartition(5), "dfs", 2, 12).collect()}
    assert again == {r.walk_id: r.walk for r in walks.node2vec(shapes, "dfs", 2, 12).collect()}
    path = graph.symmetric(frame(spark, [(f"p{i:02}", f"p{i + 1:02}") for i in range(30)]))
    back = lambda v: sum(r.walk[i] == r.walk[i + 2] for r in walks.node2vec(path, v, 4, 20).collect() for i in range(18))
    assert back("dfs") > back("bfs")  # going back weighs 4 against 1/4
    emb = walks.skipgram(walks.deepwalk(shapes, 3, 10), dims=8, window=3, epochs=1)
    assert emb.count() == 18 and len(walks.spread(emb, "emb_dw_", 8).columns) == 9


def test_spectral_embeddings(spark, shapes):
    s = {r.id: r.emb for r in spectral.spectral(shapes, 8).collect()}
    assert len(s) == 18 and s["s0"][0] == pytest.approx(1, abs=1e-6) and s["s1"][0] == pytest.approx(0.25) and s["s0"][1:] == [0.0] * 7
    ring = graph.symmetric(frame(spark, [(f"r{i:03}", f"r{(i + 1) % 60:03}") for i in range(60)]))
    v = np.array([r.emb for r in spectral.spectral(ring, 4).orderBy("id").collect()])
    lap = np.eye(60) - (np.roll(np.eye(60), 1, 0) + np.roll(np.eye(60), -1, 0)) / 2
    lam = 1 - math.cos(2 * math.pi / 60)
    assert np.abs(lap @ v[:, 0] - lam * v[:, 0]).max() < 1e-8 and v.T @ v == pytest.approx(np.eye(4), abs=1e-8)
    g = {r.id: r.emb for r in spectral.graphwave(shapes, 16).collect()}
    assert len(g) == 18 and g["c0"] == pytest.approx(g["c2"]) and g["s1"] == pytest.approx(g["s4"]) and g["p0"] != pytest.approx(g["p2"])
    i, j = np.array([0, 1]), np.array([1, 0])
    values, vectors = spectral.smallest(2, i, j, np.ones(2), 2)
    assert values == pytest.approx([0, 2]) and spectral.heat_moments(values, vectors, [1e-9])[0, [0, 3, 4]] == pytest.approx([0.5, 1, 0], abs=1e-6)


def test_iterative_eigensolver_agrees_with_the_dense_one(monkeypatch):
    n = 80
    i = np.concatenate([np.arange(n), (np.arange(n) + 1) % n])
    j = np.concatenate([(np.arange(n) + 1) % n, np.arange(n)])
    w = np.full(2 * n, 0.5)
    dense, _ = spectral.smallest(n, i, j, w, 6)
    monkeypatch.setattr(spectral, "DENSE", 10)
    assert spectral.smallest(n, i, j, w, 6, rounds=2000, tol=1e-10)[0] == pytest.approx(dense, abs=1e-3)


def test_candidates_match_brute_force(spark):
    r = random.Random(4)
    u = graph.symmetric(graph.without_loops(frame(spark, [(r.randint(0, 40), r.randint(0, 8)) for _ in range(90)])))
    deg = values(graph.degrees(u), "d")
    k = structural.candidate_count(len(deg))
    got = defaultdict(dict)
    for row in structural.candidates(u).collect():
        got[row.v][row["rank"]] = row.n
    for v, ranks in got.items():
        want = sorted((w for w in deg if w != v), key=lambda w: (abs(deg[w] - deg[v]), -deg[w], w))[:k]
        assert [ranks[i] for i in sorted(ranks)] == want


def test_structural_pipeline(shapes):
    assert structural.dtw(np.array([1.0, 2]), np.array([1.0, 2])) == 0 and structural.dtw(np.array([1.0]), np.array([2.0]), compact=False) == pytest.approx(2.5 / 1.5 - 1)
    w = structural.embedding_graph(shapes)
    total = {r.v: r.s for r in w.groupBy("v").agg(F.sum("w").alias("s")).collect()}
    assert len(total) == 18 and all(0 < s <= 3 + 1e-9 for s in total.values())
    near = {(r.v, r.n): r.w for r in w.collect()}
    assert near["k0", "k1"] > near.get(("k0", "p0"), 0)
    m = structural.embedding_graph(shapes, method="median")
    assert m.count() > 0 and walks.weighted_walk(w, 2, 5).count() == 36
    lists = {(r.root, r.layer): r["values"] for r in structural.degree_lists(shapes).collect()}
    assert lists["s0", 1] == [1, 1, 1, 1] and lists["p0", 2] == [2]
    assert structural.all_pairs(shapes).count() == 18 * 17 // 2


def test_splits_and_resampling(spark):
    df = spark.createDataFrame([(str(i), int(i % 7 == 0)) for i in range(203)], "tx_id string, label int")
    s = sampling.split_random(df, "label", seed=3)
    n = Counter((r.label, r.split) for r in s.collect())
    for c, size in ((0, 174), (1, 29)):
        assert n[c, "test"] == math.floor(0.2 * size + 0.5) == n[c, "validation"] and sum(v for (k, _), v in n.items() if k == c) == size
    assert {r.tx_id: r.split for r in sampling.split_random(df.repartition(11), "label", seed=3).collect()} == {r.tx_id: r.split for r in s.collect()}
    over = Counter(r.label for r in sampling.oversample(df, "label").collect())
    assert over[0] == over[1] == 174 and sampling.oversample(df, "label", ratio=0.5).filter("label = 1").count() == 87
    assert sampling.oversample(df.filter("label = 0"), "label").count() == 174
    with pytest.raises(ValueError):
        sampling.split_random(df, "label", test=0.6, validation=0.5)


def test_metrics_match_definitions(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 1), round(r.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "y_true int, p0 double").withColumn("y_pred", F.when(F.col("p0") >= 0.5, 0).otherwise(1))
    pos, neg = [p for y, p in rows if y == 0], [p for y, p in rows if y == 1]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    ap, tp, seen = 0.0, 0, 0
    for t in sorted({p for _, p in rows}, reverse=True):
        p, n = sum(x == t for x in pos), sum(x == t for x in neg)
        tp, seen = tp + p, seen + p + n
        ap += p / len(pos) * tp / seen
    assert metrics.average_precision(df).first()[0] == pytest.approx(ap)
    f1 = lambda t: 2 * sum(p >= t for p in pos) / (2 * sum(p >= t for p in pos) + sum(p >= t for p in neg) + sum(p < t for p in pos))
    best = max(range(1, 100), key=lambda k: (round(f1(k / 100), 12), -k))
    got = metrics.best_threshold(df).first()
    assert got.threshold == best / 100 and got.f1 == pytest.approx(f1(best / 100))
    one = df.filter("y_true = 0")
    assert metrics.roc_auc(one).first()[0] is None and metrics.precision_recall_f1(one).first().f1 > 0


def test_scaling_and_projection(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(120, 3)) @ np.array([[3, 1, 0], [0, 1, 0], [0, 0, 0.01]])
    df = spark.createDataFrame([(str(i), "train" if i < 90 else "test", *map(float, v), 7.0) for i, v in enumerate(x)], "tx_id string, split string, emb_0 double, emb_1 double, emb_2 double, emb_3 double")
    z = np.array([r[2:] for r in preprocess.zscore(df, ["emb_0", "emb_3"]).orderBy(F.col("tx_id").cast("int")).collect()])
    assert z[:90, 0].mean() == pytest.approx(0, abs=1e-9) and z[:90, 0].std() == pytest.approx(1) and (z[:, 3] == 0).all()
    assert len([c for c in preprocess.emb_pca(df, ["emb_0", "emb_1", "emb_2"], 2).columns if c.startswith("emb_pca_")]) == 2
    assert preprocess.emb_pca(df, ["emb_0", "emb_1", "emb_2"], 0.5).columns == ["tx_id", "split", "emb_3", "emb_pca_0"]


def test_trimmed_statistics(spark):
    rows = [("a", v) for v in (5.0, 1.0, 2.0, 9.0, 1.0)] + [("b", 3.0), ("b", 4.0), ("c", 2.0), ("d", None), ("e", 1.0), ("e", 1.0), ("e", 1.0)]
    got = {r.k: (r.mean, r.std) for r in analysis.trimmed(spark.createDataFrame(rows, "k string, value double"), ["k"]).collect()}
    assert got["a"] == pytest.approx((np.mean([1, 2, 5]), np.std([1, 2, 5], ddof=1))) and got["b"] == pytest.approx((3.5, math.sqrt(0.5))) and got["c"] == (2.0, 0.0) and got["e"] == (1.0, 0.0) and "d" not in got


def test_mcnemar_without_disagreement(spark):
    rows = [(1, "LR", v, str(i), 0, int(i < 3 and v == "b")) for v in ("base", "a", "b") for i in range(10)]
    t = analysis.p_values(analysis.mcnemar(spark.createDataFrame(rows, "run int, classifier string, variant string, tx_id string, y_true int, y_pred int"), "base"))
    by = {r.variant: r for r in t.collect()}
    assert by["a"].chi2 is None and by["a"].p_value == 0 and by["a"].direction == 0 and by["a"].significant
    assert by["b"].n01 == 3 and by["b"].chi2 == pytest.approx(4 / 3) and by["b"].p_value == pytest.approx(math.erfc(math.sqrt(4 / 6))) and not by["b"].significant
    counts = analysis.significance_counts(t).filter("variant = 'a'").first()
    assert (counts.available, counts.better, counts.worse) == (1, 0, 0)


def test_feature_tags():
    fs = features.FeatureSet.parse("pagerank, deg_cent deepwalk spectral", variant="25", split_seed=3)
    assert fs.signals == ("deg_cent", "pagerank", "deepwalk", "spectral")
    assert fs.tag == "base93+I1+I3+1Spectral+0ff2Vec+0Graphwave+0Role2Vec+0GCN+0GAT+0GCL+DeepWalk_edgesVar_25_splitseed3_random_val20_test20"
    assert "noInd+0Spectral" in features.FeatureSet.parse("base").tag
    with pytest.raises(ValueError):
        features.FeatureSet.parse("nothing")


def test_baseline_must_be_unique(spark):
    a = spark.createDataFrame([("LR", "b")], "model string, base_block string")
    p = spark.createDataFrame([("LR", "b", "C=1"), ("LR", "b", "C=2")], "model string, base_block string, params string")
    with pytest.raises(Exception, match="no unique baseline"):
        features.match_baseline(a, p).collect()
    assert features.match_baseline(a, p.limit(1)).first().params


@pytest.fixture(scope="module")
def toy(spark):
    """Two clusters of nodes whose class follows their neighbours."""
    r = random.Random(8)
    n = 160
    y = [i % 2 for i in range(n)]
    pairs = [(i, j) for i in range(n) for j in r.sample(range(n), 4) if i != j and (y[i] == y[j] or r.random() < 0.1)]
    nodes = spark.createDataFrame([(f"{i:03}", y[i], ("train", "train", "train", "validation", "test")[(i // 2) % 5], float(y[i] + r.gauss(0, 1)), r.gauss(0, 1)) for i in range(n)], "id string, label int, split string, f_0 double, f_1 double")
    return frame(spark, [(f"{a:03}", f"{b:03}") for a, b in pairs]), nodes


def test_gnn_layers_on_frames_match_arrays(toy):
    e, nodes = toy
    g, ids = gnn.load_graph(e, nodes, ["f_0", "f_1"])
    both = graph.with_loops(graph.symmetric(e)).toDF("src", "dst")
    h = nodes.select("id", F.array("f_0", "f_1").alias("x"))
    got = {r.id: r.x for r in gnn.message_passing(both, h, 2, reduce="mean").collect()}
    assert np.array([got[i] for i in ids]) == pytest.approx(g.mean(g.x))
    w = {"w0.0": np.array([[1.0, 0.5], [0.2, -1]]), "s0.0": np.array([0.3, 0.1]), "d0.0": np.array([-0.2, 0.4]), "w1.0": np.eye(2), "s1.0": np.zeros(2), "d1.0": np.zeros(2)}
    _, seen = gnn.gat_forward(g, w, 1)
    got = {r.id: r.x for r in gnn.gat_layer(both, h, w["w0.0"], w["s0.0"], w["d0.0"]).collect()}
    assert np.array([got[i] for i in ids]) == pytest.approx(seen[0][2])


def numeric(f, w, k, eps=1e-6):
    out = np.zeros_like(w[k])
    for at in np.ndindex(*w[k].shape):
        w[k][at] += eps
        up = f()
        w[k][at] -= 2 * eps
        out[at] = (up - f()) / (2 * eps)
        w[k][at] += eps
    return out


def test_gnn_gradients_and_training(toy):
    g, _ = gnn.load_graph(*toy, ["f_0", "f_1"])
    at = np.flatnonzero(g.split == 0)

    def back(p):
        d = np.zeros_like(p)
        d[at] = p[at]
        d[at, g.y[at]] -= 1
        return d / len(at)

    w = gnn.init_layers([2, 5, 2], 1)
    p, seen = gnn.gcn_forward(g, w)
    grads = gnn.gcn_grads(g, w, back(p), seen)
    assert all(grads[k] == pytest.approx(numeric(lambda: gnn._loss(gnn.gcn_forward(g, w)[0], g, 0), w, k), abs=1e-5) for k in w)
    r = np.random.default_rng(0)
    a = {}
    for layer, count, i, o in ((0, 2, 2, 3), (1, 1, 6, 2)):
        for k in range(count):
            a[f"w{layer}.{k}"], a[f"s{layer}.{k}"], a[f"d{layer}.{k}"] = r.normal(size=(i, o)), r.normal(size=o), r.normal(size=o)
    p, seen = gnn.gat_forward(g, a, 2)
    grads = gnn.gat_grads(g, a, back(p), seen)
    assert all(grads[k] == pytest.approx(numeric(lambda: gnn._loss(gnn.gat_forward(g, a, 2)[0], g, 0), a, k), abs=1e-4) for k in a)
    test = np.flatnonzero(g.split == 2)
    score = lambda p: (p.argmax(1)[test] == g.y[test]).mean()
    best, info = gnn.train_gcn(g, {"hidden": [8], "lr": 0.02}, 100)
    assert score(gnn.gcn_forward(g, best)[0]) > 0.8 and info["val_loss"] < 0.6
    gat, _ = gnn.train_gat(g, {"heads": 2, "width": 4, "lr": 0.02}, 100)
    assert score(gnn.gat_forward(g, gat, 2)[0]) > 0.75
    emb, losses = gnn.pretrain_bgrl(g, 8, 30)
    assert emb.shape == (len(g.x), 8) and losses[-1] < losses[0] and score(gnn.linear_head(emb, g)) > 0.6
    assert gnn.permutation_importance(g, best)[0] > gnn.permutation_importance(g, best)[1] - 0.05 and gnn.gradient_importance(g, best).shape == (2,)


def test_gnn_search_runs_trials_in_tasks(spark, toy):
    g, _ = gnn.load_graph(*toy, ["f_0", "f_1"])
    assert gnn.search(spark, g, [{"hidden": [4]}, {"hidden": [8], "lr": 0.05}], 20).count() == 2


@pytest.mark.parametrize("model, params", [("LR", {"balancing": "class_weights"}), ("NB", {"var_smoothing": 1e-6, "scaler": "minmax"}), ("RF", {"trees": 10, "depth": 4, "balancing": "oversampling"}), ("XGB", {"trees": 5, "depth": 3}), ("SVC", {"kernel": "rbf", "gamma": 0.2, "balancing": "class_weights"}), ("MLP", {"hidden": (4,), "max_iter": 40})])
def test_models_learn(spark, model, params):
    r = random.Random(6)
    rows = [(str(i), i % 3 == 0, ("train", "train", "train", "validation", "test")[i % 5]) for i in range(400)]
    df = spark.createDataFrame([(k, 1 - int(c), s, 2.0 * c + r.gauss(0, 0.6), r.gauss(0, 1)) for k, c, s in rows], "tx_id string, label int, split string, f_a double, f_b double")
    out = models.run(model, df, ["f_a", "f_b"], params)
    doc = models.metrics_document(out, "toy")
    assert doc["test_metrics"]["roc_auc_fraud"] > 0.9 and doc["test_metrics"]["f1_fraud"] > 0.75 and 0 < out["threshold"] < 1
    if model in ("LR", "RF", "XGB"):
        assert out["importance"]["f_a"] > out["importance"]["f_b"]


def test_search_and_spaces():
    for m in models.SPACES:
        a, b = models.trials(m, 5), models.trials(m, 5)
        assert a == b and len(a) == 5
    assert all(1e-3 <= t["C"] <= 10 for t in models.trials("LR", 50))


def test_export_classify_and_discover(spark, tmp_path):
    r = random.Random(1)
    nodes = spark.createDataFrame([(str(i), 1 + i % 49, (1, 2, -1)[i % 3], r.gauss(i % 3, 1)) for i in range(240)], "tx_id string, time_step int, class int, f_x double")
    e = frame(spark, [(r.randint(0, 239), r.randint(0, 239)) for _ in range(500)])
    paths = experiments.export_grid(nodes, e, ["deg_cent inout"], str(tmp_path / "b"), [1], [None, "25"])
    assert len(paths) == 2 and all(readers.complete(spark, p) for p in paths) and not readers.complete(spark, str(tmp_path / "none"))
    df = readers.bundle(spark, paths[0])
    assert df.count() == 160 and {"gi_in_degree", "gi_degree_centrality"} <= set(df.columns) and dict(df.dtypes)["gi_in_degree"] == "float"
    out = str(tmp_path / "r")
    doc = experiments.classify(spark, paths[0], "LR", out, trials=2)
    assert len(doc["trials"]) == 2 and doc["test_metrics"]["log_loss"] > 0
    done = experiments.robustness(spark, str(tmp_path / "b"), "LR", out, {"C": 1.0})
    assert len(done) == 1 and experiments.robustness(spark, str(tmp_path / "b"), "LR", out, {"C": 1.0}) == []
    res = readers.results(spark, out).withColumn("f1", analysis.extract_metric(F.col("doc"), "f1_fraud"))
    assert res.filter("f1 IS NOT NULL").count() == 2
    name = readers._names(spark, out)
    preds = readers.predictions(spark, f"{out}/{next(n for n in name if n.endswith('testpreds.parquet'))}")
    assert {"y_true", "y_pred"} <= set(preds.columns)
    assert experiments.store_signals(e, ["deg_cent"], str(tmp_path / "s"), "50") and readers.parquet(spark, str(tmp_path / "s" / "deg_cent_50.parquet")).count() > 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n2 3\n9\n\n")
    e, n = readers.edgelist(spark, str(tmp_path / "e.txt"))
    assert e.count() == 4 and {r.id for r in n.collect()} == {"1", "2", "3", "9"}
    (tmp_path / "a.txt").write_text("# c\n1 2 3 2\n3 3 1\n")
    assert readers.adjacency_list(spark, str(tmp_path / "a.txt")).count() == 4 and readers.adjacency_list(spark, str(tmp_path / "a.txt"), False, False).count() == 5
    (tmp_path / "f.csv").write_text("7,1,0.5,2\n8,2,1.5,3\n")
    (tmp_path / "c.csv").write_text("a,b\n7,unknown\n8,1\n9,x\n")
    (tmp_path / "g.csv").write_text("txId1,txId2\n7,8\n")
    f = readers.features_csv(spark, str(tmp_path / "f.csv"), 2)
    assert f.columns == ["tx_id", "time_step", "f_2", "f_3"] and f.count() == 2
    assert {r.tx_id: r["class"] for r in readers.classes_csv(spark, str(tmp_path / "c.csv")).collect()} == {"7": -1, "8": 1, "9": None}
    assert readers.edges_csv(spark, str(tmp_path / "g.csv")).first().dst == "8"
    with pytest.raises(FileNotFoundError):
        readers.parquet(spark, str(tmp_path / "missing"))
    emb = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, 0.25])], "id string, emb array<float>")
    sinks.word2vec_text(emb, str(tmp_path / "w"))
    assert {r.id: r.emb for r in readers.word2vec_text(spark, str(tmp_path / "w")).collect()} == {"a": [1, 2], "b": [0.5, 0.25]}
    sinks.edgelist(e, str(tmp_path / "el"))
    assert readers.edgelist(spark, str(tmp_path / "el"))[0].count() == 4
    sinks.matrix_csv(spark.createDataFrame([("LR", 0.5, None)], "classifier string, base double, x double"), str(tmp_path / "m"))
    assert readers.metric_matrix(spark, str(tmp_path / "m")).first().base == 0.5
    assert readers.matrix(spark, [[0, 1, 0], [0, 0, 1], [0, 0, 0]]).count() == 4
    assert {tuple(r) for r in readers.matrix(spark, cells=[(0, 1), (3, 4)], undirected=False).collect()} == {("0", "1"), ("3", "4")}
    with pytest.raises(ValueError):
        readers.matrix(spark)
    assert readers.from_dict(spark, {1: [2, 3]}).count() == 2


def test_names_and_numbers(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (float("inf"), None)], "x double, s string")
    assert [r[0] for r in df.select(C.finite(F.col("x"))).collect()] == [1, 0, 0]
    assert {r.column: r.n for r in C.nan_counts(df).collect()} == {"x": 1, "s": 1}
    assert C.column_groups(["tx_id", "f_1", "gi_a", "emb_0"]) == {"base": ["f_1"], "gi": ["gi_a"], "emb": ["emb_0"]}
    assert C.with_id(spark.createDataFrame([(5,)], "txId long")).first().tx_id == "5"
    with pytest.raises(ValueError):
        C.with_id(df)
    assert {r.s for r in C.rename_values(df, "s", {"a": "A"}).collect()} == {"A", "b", None}
    assert sinks.jsonable({"a": float("nan"), "b": (1, np.float64(2.5)), "c": np.arange(2)}) == {"a": None, "b": [1, 2.5], "c": [0, 1]}


def test_streams(spark, tmp_path):
    from txloom import streaming

    rows = spark.createDataFrame([(f"2024-01-01 00:{i:02}:00", "a" if i % 2 else "b", 1.0) for i in range(40)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.windowed_counts(stream, window="10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted(map(str, d.collect()))
    assert key(spark.table("w")) == key(streaming.windowed_counts(rows, window="10 minutes"))
