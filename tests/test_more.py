"""Operators against brute force on small inputs: squares, cores, ranking, sweeps, alias tables, graph networks."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txloom.operators import gnn, graph, indicators, metrics, models, structural, walks
from txloom.plans import experiments
from txloom.sources import readers, sinks


def frame(spark, pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")


def values(df, column):
    return {r["id"]: r[column] for r in df.collect()}


@pytest.fixture(scope="module")
def hub(spark):
    """A random graph with one node that touches most others."""
    r = random.Random(2)
    pairs = {(r.randint(0, 40), r.randint(0, 40)) for _ in range(110)} | {(0, i) for i in range(1, 35)}
    return graph.symmetric(graph.without_loops(frame(spark, sorted(pairs))))


def test_square_clustering_matches_pairs_of_neighbours(hub):
    near = {}
    for r in hub.collect():
        near.setdefault(r.src, set()).add(r.dst)
    want = {}
    for v, around in near.items():
        found = possible = 0
        for x, y in itertools.combinations(around, 2):
            s = len((near[x] & near[y]) - {v})
            m = s + 1 + (y in near[x])
            found += s
            possible += s + len(near[x]) - m + len(near[y]) - m
        want[v] = found / possible if possible else 0
    assert values(indicators.square_clustering(hub), "gi_square_clustering") == pytest.approx(want)


def test_core_numbers_peeled_or_in_rounds(spark, hub):
    peeled = values(indicators.core_number(hub), "gi_core_number")
    assert values(indicators.core_number(hub, most=0), "gi_core_number") == peeled
    near = {}
    for r in hub.collect():
        near.setdefault(r.src, set()).add(r.dst)
    core, left, k = {}, {v: set(n) for v, n in near.items()}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        core[v] = k
        for x in left.pop(v):
            if x in left:
                left[x].discard(v)
    assert peeled == core


def test_a_long_chain_settles(spark):
    chain = graph.symmetric(spark.range(5000).selectExpr("CAST(id AS STRING) AS src", "CAST(id + 1 AS STRING) AS dst"))
    core = indicators.core_number(chain)
    assert core.count() == 5001 and core.filter("gi_core_number <> 1").count() == 0
    assert {r.comp for r in graph.components(chain).collect()} == {"0"}


def test_ranking_and_sweep_match_definitions(spark):
    r = random.Random(3)
    rows = [(k, r.randint(0, 1), round(r.random(), 2)) for k in (1, 2) for _ in range(300)] + [(1, 0, 1.0), (1, 1, 0.0), (2, 1, 1.0)]
    df = spark.createDataFrame(rows, "k int, y_true int, p0 double")
    auc, both = {x.k: x.roc_auc for x in metrics.roc_auc(df, ["k"]).collect()}, {x.k: x for x in metrics.ranking(df, ["k"]).collect()}
    swept = {(x.k, round(x.threshold * 20)): (x.tp, x.fn, x.fp, x.tn) for x in metrics.sweep(df, 20, ["k"], ends=True).collect()}
    for k in (1, 2):
        pos, neg = ([p for g, y, p in rows if g == k and y == c] for c in (0, 1))
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        assert auc[k] == pytest.approx(want) and both[k].roc_auc == pytest.approx(want)
        ap = sum(pos.count(s) * sum(p >= s for p in pos) / sum(x >= s for x in pos + neg) for s in set(pos)) / len(pos)
        assert both[k].average_precision == pytest.approx(ap)
        for t in range(21):
            tp, fp = sum(p >= t / 20 for p in pos), sum(n >= t / 20 for n in neg)
            assert swept[k, t] == (tp, len(pos) - tp, fp, len(neg) - fp)
    whole = metrics.sweep(df, 10)
    assert whole.count() == 9 and metrics.roc_auc(df).count() == 1


def test_all_metrics_read_their_input_once_and_pack_scores(spark, monkeypatch):
    r = random.Random(4)
    rows = [(k, n, r.randint(0, 1), r.randint(0, 1), round(r.random(), 2)) for k, n in ((1, "a"), (1, None), (None, "b")) for _ in range(400)]
    rows += [(2, "c", 0, 0, 1.0), (2, "c", 1, 1, float("nan")), (2, "c", 1, 0, None), (2, "c", 0, 1, -0.5), (2, "c", 0, 1, 1.5), (3, "d", 0, 0, 0.5)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.createDataFrame(rows, "k int, n string, y_true int, y_pred int, p0 double").repartition(3)
    monkeypatch.setattr(metrics, "PACK", 150)
    got = {(x.k, x.n): x for x in metrics.all_metrics(df.mapInArrow(counted, df.schema), ["k", "n"]).collect()}
    assert read.value == len(rows)  # the sums, the loss and the ranking took a pass each before
    assert set(got) == {x[:2] for x in rows}
    level = lambda p: float("-inf") if p is None else float("inf") if p != p else p
    for key, x in got.items():
        pos, neg = ([level(p) for *g, y, _, p in rows if tuple(g) == key and y == c] for c in (0, 1))
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg) if neg else None
        assert x.roc_auc == (pytest.approx(want) if neg else None)
        assert x.average_precision == pytest.approx(sum(pos.count(s) * sum(p >= s for p in pos) / sum(p >= s for p in pos + neg) for s in set(pos)) / len(pos))
    for part, names in ((metrics.precision_recall_f1, metrics.RATES), (metrics.log_loss, ("log_loss",))):
        for x in part(df.filter("k IS NULL OR k <> 2"), ["k", "n"]).collect():
            assert all(got[x.k, x.n][c] == pytest.approx(x[c]) for c in names)


def test_stored_predictions_are_small_and_whole(spark, tmp_path):
    p = spark.range(20_000).selectExpr("concat('1|LR|base|', id) AS tx_id", "CAST(id % 2 AS INT) AS y_true", "CAST(id % 3 = 0 AS INT) AS y_pred", "round(id / 20000, 6) AS proba_fraud", "1 - round(id / 20000, 6) AS proba_nofraud")
    sinks.predictions(p, str(tmp_path / "zstd"))
    p.write.parquet(str(tmp_path / "plain"), compression="snappy")
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    assert size("zstd") < 0.8 * size("plain")  # equal before
    assert sorted(readers.predictions(spark, str(tmp_path / "zstd")).collect()) == sorted(p.collect())


def test_alias_and_softmax(spark):
    w = np.array([0.1, 5.0, 2.0, 0.4])
    other, share = structural.alias_table(w)
    chance = np.bincount(np.arange(4), share, 4) + np.bincount(other, 1 - share, 4)
    assert chance / 4 == pytest.approx(w / w.sum())
    drawn = [structural.alias_draw(other, share, (i + 0.5) / 400 % 1, (i * 7 % 400 + 0.5) / 400) for i in range(4000)]
    assert set(drawn) == {0, 1, 2, 3}
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 5e6), ("b", "y", 4e6)], "v string, n string, w double")
    soft = {(r.v, r.n): r.w for r in structural.softmax_weights(df).collect()}
    assert soft["a", "x"] == pytest.approx(1 / (1 + math.e)) and soft["b", "x"] + soft["b", "y"] == pytest.approx(1) and soft["b", "y"] > 0


@pytest.mark.parametrize("length", [1, 8, 9, 30])
def test_walks_keep_all_steps(hub, length):
    near = {(r.src, r.dst) for r in hub.collect()}
    for found in (walks.deepwalk(hub, 2, length), walks.weighted_walk(hub.selectExpr("src AS v", "dst AS n", "1.0D AS w"), 2, length)):
        rows = found.collect()
        assert len(rows) == 2 * len({a for a, _ in near})
        assert all(len(r.walk) == length and r.walk[0] == r.walk_id.split("#")[0] and all(p in near for p in zip(r.walk, r.walk[1:])) for r in rows)


@pytest.mark.parametrize("variant", ["bal", "dfs", "bfs"])
def test_second_order_walks_match_brute_force(hub, variant):
    near = {}
    for r in hub.collect():
        near.setdefault(r.src, set()).add(r.dst)
    p, q = walks.NODE2VEC[variant]
    want = {}
    for v, i in itertools.product(near, range(2)):
        seed, walk = 42 + i * 100_000 + int(hashlib.sha256(v.encode()).hexdigest()[:15], 16) % 100_000, [v]
        for k in range(1, 20):
            unit = int(hashlib.md5(f"{seed}|{v}#{i}|{k}".encode()).hexdigest()[:13], 16) / 16**13
            choices = sorted(near[walk[-1]])
            weights = [1.0 if k == 1 or (p == q == 1.0) else 1 / p if c == walk[-2] else 1.0 if c in near[walk[-2]] else 1 / q for c in choices]
            sums = list(itertools.accumulate(weights))
            walk.append(choices[min(sum(s <= unit * sums[-1] for s in sums), len(choices) - 1)])
        want[f"{v}#{i}"] = walk
    assert {r.walk_id: r.walk for r in walks.node2vec(hub, variant, 2, 20).collect()} == want


@pytest.mark.parametrize("variant", ["bal", "dfs", "bfs", "labels"])
def test_walks_in_blocks_are_those_of_joins(spark, hub, variant, monkeypatch):
    """Small components share blocks, large ones are repeated, the largest are walked by joins: the same walks."""
    many = hub.unionByName(hub.selectExpr("'x' || src", "'x' || dst").toDF("src", "dst")).unionByName(spark.createDataFrame([(f"{a}{'ü' * 30}", f"{b}{'ü' * 30}") for a, b in (("k", "l"), ("l", "k"), ("l", "m"), ("m", "l"))], "src string, dst string"))
    labels = many.select(F.col("src").alias("id"), F.substring("src", -1, 1).alias("label")).distinct()
    step = (lambda: walks.walk(many, 2, 30, labels=labels)) if variant == "labels" else (lambda: walks.node2vec(many, variant, 2, 30))
    shared = {r.walk_id: r.walk for r in step().collect()}
    monkeypatch.setattr(walks, "BLOCK_STARTS", 2)
    monkeypatch.setattr(walks, "PART_STARTS", 2)
    repeated = {r.walk_id: r.walk for r in step().collect()}
    monkeypatch.setattr(walks, "LOCAL_CHOICES", 4)
    rows = step().collect()
    assert len(rows) == len(shared) == 2 * len({r.src for r in many.collect()})
    assert shared == repeated == {r.walk_id: r.walk for r in rows}


def test_walkers_are_not_shuffled_at_every_step(hub, monkeypatch):
    """Longer walks store nothing more: before, walkers were joined at each step and stored every eighth."""
    stored, store = [], walks.materialize
    monkeypatch.setattr(walks, "materialize", lambda df, name: (stored.append(name), store(df, name))[1])
    walks.node2vec(hub, "bfs", 2, 2)
    short = len(stored)
    walks.node2vec(hub, "bfs", 2, 40)
    assert len(stored) == 2 * short and "walks" not in stored


def test_labels_are_stored_round_by_round(hub, monkeypatch):
    """A round reads the stored one before; before, each round computed the earlier ones and the graph twice."""
    stored, store = [], indicators.materialize
    monkeypatch.setattr(indicators, "materialize", lambda df, name: (stored.append(name), store(df, name))[1])
    plan = indicators.wl_labels(hub)._jdf.queryExecution().optimizedPlan().toString()
    assert stored == ["wl-links", "wl", "wl", "wl"] and plan.count("Join ") == 2


def test_network_signals_and_batches(spark, tmp_path):
    r = random.Random(1)
    nodes = spark.createDataFrame([(str(i), 1 + i % 49, (1, 2)[i % 2], r.gauss(i % 2, 1)) for i in range(120)], "tx_id string, time_step int, class int, f_x double")
    e = frame(spark, [(i, (i + 2 * r.randint(1, 9)) % 120) for i in range(120) for _ in range(3)])
    table = experiments.feature_table(nodes, {}, experiments.FeatureSet())
    for kind, t in experiments.signals(e, list(experiments.NETWORKS), table).items():
        rows = t.collect()
        assert len(rows) == 120 and t.columns[1:] == [f"{kind}_emb_{k}" for k in range(64)] and any(any(x[1:]) for x in rows)
    with pytest.raises(ValueError):
        experiments.signals(e, ["gcn"])
    (path,) = experiments.export_grid(nodes, e, ["deg_cent gcn"], str(tmp_path / "b"), [1])
    assert {"gcn_emb_0", "gi_degree_centrality"} <= set(readers.bundle(spark, path).columns)
    done = experiments.network_batch(spark, str(tmp_path / "b"), e, "gcn", str(tmp_path / "r"), 8, 60)
    assert len(done) == 1 and done[0]["test_metrics"]["roc_auc_fraud"] > 0.6
    assert experiments.network_batch(spark, str(tmp_path / "b"), e, "gcn", str(tmp_path / "r"), 8, 60) == []
    with pytest.raises(ValueError):
        gnn.checked(e, table, most=10)


def test_vectors_of_one_number_are_no_header(spark, tmp_path):
    (tmp_path / "w.txt").write_text("3 1\n7 5\n8 6\n9 7\n")
    assert {r.id: r.emb for r in readers.word2vec_text(spark, str(tmp_path / "w.txt")).collect()} == {"7": [5.0], "8": [6.0], "9": [7.0]}


def test_vectors_without_a_header(spark, tmp_path):
    (tmp_path / "w.txt").write_text("a 1 2\nb 3 4\n")
    assert {r.id: r.emb for r in readers.word2vec_text(spark, str(tmp_path / "w.txt")).collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}
    (tmp_path / "x.txt").write_text("a 1 2\nb 3\n")
    with pytest.raises(Exception, match="wrong width"):
        readers.word2vec_text(spark, str(tmp_path / "x.txt")).collect()


def test_iterations_that_do_not_converge(spark):
    e = frame(spark, [(0, 1), (1, 2), (2, 0), (2, 3), ("a", "b")])
    with pytest.raises(RuntimeError, match="converge"):
        indicators.pagerank(e, max_iter=2)
    x = values(indicators.eigenvector(graph.symmetric(e), max_iter=2), "gi_eigenvector_centrality")
    assert x["0"] == x["3"] == 0 and x["a"] == pytest.approx(math.sqrt(0.5))


def test_labelled_graph_statistics(spark):
    labels = spark.createDataFrame([("1", 0), ("2", 1), ("3", 1), ("4", -1), ("9", 0)], "id string, label int")
    row = graph.stats(frame(spark, [(1, 2), (2, 3), (3, 4)]), labels).first()
    assert (row.n_nodes, row.n_edges) == (4, 3) and row.share_0 == pytest.approx(1 / 3) and row.share_1 == pytest.approx(2 / 3)


def test_means_of_all_networks_are_finite(spark):
    rows = [(str(i), 0, "train", float(i % 3)) for i in range(6)]
    nodes = spark.createDataFrame(rows, "id string, label int, split string, f_0 double")
    out = gnn.signal(frame(spark, [(0, 1), (1, 2)]), nodes, ["f_0"], "gcl", 4, 3)
    assert out.select([F.isnan(c).cast("int").alias(c) for c in out.columns[1:]]).agg(*[F.sum(c) for c in out.columns[1:]]).first() == (0,) * 4


SURFACE = {"x": models.Space(low=-5, high=5), "y": models.Space(low=1e-4, high=10, log=True), "kind": models.Space(("a", None, "c", "d"))}


def surface(p):
    return (p["x"] - 2) ** 2 + math.log10(p["y"] / 0.03) ** 2 + (0 if p["kind"] is None else 2)


def test_parzen_search_beats_random_draws_and_repeats():
    wins, found, drawn = 0, [], []
    for seed in range(20):
        done = models.minimise(surface, SURFACE, 50, seed)
        assert len(done) == 50 and all(-5 <= t["params"]["x"] <= 5 and 1e-4 <= t["params"]["y"] <= 10 for t in done)
        found.append(min(t["loss"] for t in done))
        drawn.append(min(t["loss"] for t in models.minimise(surface, SURFACE, 50, seed, startup=50)))
        wins += found[-1] <= drawn[-1]
    assert wins >= 15 and sum(found) < sum(drawn) / 2
    assert models.minimise(surface, SURFACE, 30, 1) == models.minimise(surface, SURFACE, 30, 1)


def test_search_goes_on_after_losses_that_are_not_numbers():
    def loss(p):
        return None if p["x"] < -4 else math.nan if p["x"] > 4 else surface(p)

    done = models.minimise(loss, SURFACE, 40, 3)
    assert surface(models.best(done)) == min(t["loss"] for t in done if t["loss"] is not None and not math.isnan(t["loss"]))
    with pytest.raises(ValueError, match="finite"):
        models.best(models.minimise(lambda p: None, SURFACE, 25, 3))


def test_densities_have_mass_one():
    for points in ([], [0.1], [0.0, 0.5, 0.5, 1.0]):
        kernels = models._kernels(points, 0.0, 1.0)
        area = sum(models._density((i + 0.5) / 2000, kernels) for i in range(2000)) / 2000
        assert area * 1 / math.sqrt(2 * math.pi) == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize(("name", "params"), [("NB", {"scaler": "minmax"}), ("SVC", {"kernel": "rbf", "gamma": 0.5, "max_iter": 10}), ("LR", {"emb_pca": 2, "max_iter": 20})])
def test_stored_models_score_as_before(spark, tmp_path, name, params):
    r = random.Random(4)
    rows = [(str(i), i % 2, ("train", "validation", "test")[i % 3], r.gauss(i % 2, 1), r.random(), r.gauss(i % 2, 2), r.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "tx_id string, label int, split string, f_a double, emb_0 double, emb_1 double, emb_2 double")
    out = models.run(name, df, ["f_a", "emb_0", "emb_1", "emb_2"], params, steps=10)
    sinks.model(out, str(tmp_path / "m"), spark)
    want = {p.tx_id: p.proba_fraud for p in out["predictions"].collect()}
    got = {p.tx_id: p.p0 for p in models.load(spark, str(tmp_path / "m"))(df.filter("split = 'test'")).collect()}
    assert got == want and len(got) == 40
