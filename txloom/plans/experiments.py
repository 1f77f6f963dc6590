"""Whole runs: signals of a graph variant, feature bundles, classification, robustness."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.functions.columns import encode_label, finite
from txloom.functions.storage import materialize
from txloom.operators import blocks, communities, gcn_tables, gnn, indicators, metrics, models, sampling, spectral, structural, walks
from txloom.operators.features import FeatureSet, assemble
from txloom.operators.graph import components, content_hash, edges, subsample, symmetric, without_loops
from txloom.operators.preprocess import zscore
from txloom.sources import readers, sinks

#: How each signal is computed from directed edges ``e`` and symmetric ones ``u``.
BUILDERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "deg_cent": lambda e, u: indicators.degree_centrality(u),
    "inout": lambda e, u: indicators.in_out_degree(e),
    "pagerank": lambda e, u: indicators.pagerank(e),
    "betweenness": lambda e, u: indicators.betweenness(u),
    "eigenvector": lambda e, u: indicators.eigenvector(u),
    "closeness": lambda e, u: indicators.closeness(u),
    "clustering": lambda e, u: indicators.clustering(u),
    "square_clustering": lambda e, u: indicators.square_clustering(u),
    "core": lambda e, u: indicators.core_number(u),
    "triangles": lambda e, u: indicators.triangles(u),
    "louvain": lambda e, u: indicators.community_extras(u, communities.louvain(u).toDF("id", "comm")),
    "leiden": lambda e, u: communities.leiden(u),
    "infomap": lambda e, u: communities.infomap(u),
    "node2vec_bal": lambda e, u: walks.spread(walks.skipgram(walks.node2vec(u, "bal")), "emb_n2v_bal_"),
    "node2vec_dfs": lambda e, u: walks.spread(walks.skipgram(walks.node2vec(u, "dfs")), "emb_n2v_dfs_"),
    "node2vec_bfs": lambda e, u: walks.spread(walks.skipgram(walks.node2vec(u, "bfs")), "emb_n2v_bfs_"),
    "deepwalk": lambda e, u: walks.spread(walks.skipgram(walks.deepwalk(u)), "emb_dw_"),
    "spectral": lambda e, u: walks.spread(spectral.spectral(u), "emb_spectral_"),
    "graphwave": lambda e, u: walks.spread(spectral.graphwave(u), "emb_graphwave_"),
    "role2vec": lambda e, u: walks.spread(walks.skipgram(walks.role2vec(u, indicators.wl_labels(u)), window=5), "emb_role2vec_"),
    "ffstruc2vec": lambda e, u: walks.spread(walks.skipgram_tree(walks.weighted_walk(structural.embedding_graph(u))), "emb_ffstruc2vec_"),
}


def variant_edges(e: DataFrame, variant: str | int | None, seed: int = 42) -> DataFrame:
    """Edges of a removal variant in percent; none, empty and 0 are the whole graph."""
    share = int(variant) if variant not in (None, "") else 0
    return subsample(e, share / 100, seed) if share else e


#: Signals that learn from the nodes' features, labels and splits as well.
NETWORKS = ("gcn", "gat", "gcl")


def signals(e: DataFrame, names: list[str], nodes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Signal tables of a directed edge list, computed on all nodes, labelled or not.

    The networks need ``nodes(tx_id, label, split, features…)``, whose features they scale
    on the training rows.
    """
    d = edges(e)
    u = symmetric(without_loops(d))
    if wrong := [n for n in names if n in NETWORKS and nodes is None]:
        raise ValueError(f"signals {wrong} need the nodes' features")
    return {n: network_signal(d, nodes, n) if n in NETWORKS else BUILDERS[n](d, u) for n in names}


def network_input(nodes: DataFrame) -> tuple[DataFrame, list[str]]:
    """Scaled features with id, label and split, and the feature columns."""
    columns = [c for c, t in nodes.dtypes if c not in ("tx_id", "time_step", "class", "label", "split") and t in ("double", "float", "int", "bigint")]
    filled = nodes.select(F.col("tx_id").alias("id"), "label", "split", *[finite(F.col(c)).alias(c) for c in columns])
    return zscore(filled, columns), columns


def network_signal(e: DataFrame, nodes: DataFrame, kind: str, width: int = 64, epochs: int | None = None, most: int = gnn.LOCAL_EDGES) -> DataFrame:
    """Embedding columns of all nodes; a GCN with a block of more than ``most`` edges is trained through joins."""
    scaled, columns = network_input(nodes)
    out = network(e, scaled, columns, kind, width, epochs, most, scores=False)
    return out.select("id", *[F.col("emb")[k].cast("float").alias(f"{kind}_emb_{k}") for k in range(width)])


def network(e: DataFrame, scaled: DataFrame, columns: list[str], kind: str, width: int, epochs: int | None, most: int, scores: bool = True) -> DataFrame:
    """``id, split, y, p0, emb`` of a network trained on blocks, or, a GCN whose blocks would be too wide, through joins."""
    try:
        return blocks.embed(e, scaled, columns, kind, width, epochs, scores=scores, most=most)
    except blocks.TooWide:
        if kind != "gcn":
            raise
        return gcn_tables.run(e, scaled, columns, {"hidden": [width]}, epochs or 200)[0]


def classify_network(spark: SparkSession, bundle: str, e: DataFrame, kind: str, out: str, width: int = 64, epochs: int | None = None, most: int = gnn.LOCAL_EDGES) -> dict:
    """Trains a network on a bundle and its graph; stores the test predictions and the result document."""
    scaled, columns = network_input(readers.bundle(spark, bundle))
    found = network(edges(e), scaled, columns, kind, width, epochs, most).select(F.col("id").alias("tx_id"), "split", F.col("y").alias("y_true"), "p0").filter("y_true IN (0, 1)")
    found = materialize(found, "network")
    threshold = metrics.best_threshold(found.filter("split = 'validation'"), metric="balanced_accuracy", steps=1000, ends=True).first()["threshold"]
    test = found.filter("split = 'test'").withColumn("y_pred", F.when(F.col("p0") >= threshold, 0).otherwise(1))
    name = bundle.rstrip("/").rpartition("/")[2]
    sinks.predictions(test.select("tx_id", "y_true", "y_pred", F.col("p0").alias("proba_fraud"), (1 - F.col("p0")).alias("proba_nofraud")), f"{out}/{kind.upper()}_{name}__testpreds.parquet")
    row = metrics.all_metrics(test.withColumn("_k", F.lit(1)), ["_k"]).first()
    document = {"model": kind.upper(), "bundle": name, "threshold": threshold, "test_metrics": {"f1_fraud": row["f1"], "recall_fraud": row["recall"], "precision_fraud": row["precision"], "roc_auc_fraud": row["roc_auc"], "pr_auc_fraud": row["average_precision"], "log_loss": row["log_loss"]}}
    sinks.result(spark, f"{out}/{kind.upper()}_{name}.json", document)
    return document


def network_batch(spark: SparkSession, root: str, e: DataFrame, kind: str, out: str, width: int = 64, epochs: int | None = None) -> list[dict]:
    """:func:`classify_network` of every bundle under ``root`` that has no result yet."""
    lead = f"{kind.upper()}_"
    done = [n.removeprefix(lead).removesuffix(".json") for n in readers._names(spark, out) if n.startswith(lead) and n.endswith(".json")]
    return [classify_network(spark, f"{root}/{n}", e, kind, out, width, epochs) for n in readers.discover(spark, root, done=done)]


def store_signals(e: DataFrame, names: list[str], path: str, variant: str | int | None = None, nodes: DataFrame | None = None) -> str:
    """Writes a table and a description for every signal; returns the graph's hash."""
    spark, d = e.sparkSession, variant_edges(edges(e), variant)
    digest = content_hash(d).first()["graph_hash"]
    suffix = f"_{variant}" if variant not in (None, "", 0, "0") else ""
    for name, table in signals(d, names, nodes).items():
        table.orderBy("id").write.mode("overwrite").parquet(f"{path}/{name}{suffix}.parquet")
        sinks.meta(spark, f"{path}/{name}{suffix}.meta.json", name, digest, variant=variant)
    return digest


def feature_table(nodes: DataFrame, tables: dict[str, DataFrame], fs: FeatureSet, week_max: int = 49) -> DataFrame:
    """Labelled nodes up to a week with their signals, encoded label and stratified split."""
    base = nodes.filter((F.col("time_step") <= week_max) & F.col("class").isin(1, 2)).withColumn("label", encode_label(F.col("class")))
    wide = assemble(base, {n: tables[n] for n in fs.signals})
    return sampling.split_random(wide, "label", test=fs.test, validation=fs.validation, seed=fs.split_seed)


def export(nodes: DataFrame, tables: dict[str, DataFrame], fs: FeatureSet, root: str) -> str:
    """Writes the bundle of a feature set; returns its path."""
    path = f"{root}/{sinks.bundle_name(fs.tag, asdict(fs))}"
    sinks.bundle(feature_table(nodes, tables, fs), path, asdict(fs))
    return path


def export_grid(nodes: DataFrame, e: DataFrame, sets: list[str], root: str, seeds: list[int], variants: list[str | None] = (None,)) -> list[str]:
    """Bundles of all feature sets, split seeds and edge variants; a variant's signals are computed once."""
    out = []
    for v in variants:
        parsed = [FeatureSet.parse(s, variant=v) for s in sets]
        d = variant_edges(edges(e), v)
        tables = signals(d, sorted({n for fs in parsed for n in fs.signals if n not in NETWORKS}))
        for fs in parsed:
            for seed in seeds:
                fs.split_seed = seed
                split = feature_table(nodes, {}, FeatureSet(split_seed=seed, validation=fs.validation, test=fs.test))
                learned = {n: network_signal(d, split, n) for n in fs.signals if n in NETWORKS}  # of this seed's training rows
                out.append(export(nodes, tables | learned, fs, root))
    return out


def classify(spark: SparkSession, bundle: str, model: str, out: str, trials: int = 50, params: dict | None = None) -> dict:
    """Search (or take fixed parameters), evaluate and store predictions, document and model of one bundle."""
    df = readers.bundle(spark, bundle)
    columns = readers.model_columns(df)
    done: list[dict] = []
    if params is None:
        params, done = models.search(model, df, columns, trials)
    result = models.run(model, df, columns, params)
    name = bundle.rstrip("/").rpartition("/")[2]
    sinks.predictions(result["predictions"], f"{out}/{model}_{name}__testpreds.parquet")
    document = models.metrics_document(result, name) | {"trials": done}
    sinks.result(spark, f"{out}/{model}_{name}.json", document)
    sinks.model(result, f"{out}/{model}_{name}__model", spark)
    return document


def robustness(spark: SparkSession, root: str, model: str, out: str, params: dict) -> list[dict]:
    """Fixed parameters of a baseline on every bundle of an edge variant that has no result yet."""
    done = [n.removeprefix(f"{model}_").removesuffix(".json") for n in readers._names(spark, out) if n.endswith(".json")]
    return [classify(spark, f"{root}/{n}", model, out, params=params) for n in readers.discover(spark, root, "edgesVar", done)]


def component_sizes(u: DataFrame) -> DataFrame:
    """``n, components``: how many components have each size."""
    return components(u).groupBy("comp").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("components"))
