"""Registered queries of sources, sinks and small operators: tables are written, read back and held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from txloom.functions import columns as C
from txloom.functions.storage import scratch_path
from txloom.operators import analysis as A
from txloom.operators import features as FE
from txloom.operators import graph as G
from txloom.operators import metrics as M
from txloom.operators import sampling as S
from txloom.operators import structural as ST
from txloom.plans import experiments as X
from txloom.plans.catalog import DIST, KEYS, PR, E, NODES_SQL, ORACLES, SPLIT_SQL, TRIM, W, _dist, _labelled, _stats, _u, query, rounded
from txloom.sources import readers, sinks
from txloom.sources.fixtures import predictions, table, tx_edges, tx_features
from txloom.streaming import run_available, table_stream, windowed_counts

# -- sources and sinks ----------------------------------------------------------


@query("source_features_csv", W + NODES_SQL + " SELECT tx_id, time_step, f_totalprice AS f_2, f_lines AS f_3 FROM tx")
def _(spark, sf):
    path = scratch_path(spark, "features.csv")
    tx_features(spark, sf).select("tx_id", "time_step", "f_totalprice", "f_lines").write.csv(path)
    return readers.features_csv(spark, path, 2)


@query("source_classes_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS tx_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE -1 END AS class FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "classes.csv")
    kind = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "2").otherwise("unknown")
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("txId"), kind.alias("class")).write.csv(path, header=True)
    return readers.classes_csv(spark, path)


@query("source_labelled", W + NODES_SQL + " SELECT tx_id, f_totalprice, CASE WHEN class > 0 THEN class END AS class FROM tx")
def _(spark, sf):
    t = tx_features(spark, sf)
    return readers.labelled(t.select("tx_id", "f_totalprice"), t.filter("class > 0").select("tx_id", "class"))


@query("source_edges_csv", E + " SELECT src, dst FROM e")
def _(spark, sf):
    path = scratch_path(spark, "edges.csv")
    tx_edges(spark, sf).withColumn("weight", F.lit(1)).toDF("txId1", "txId2", "weight").write.csv(path, header=True)
    return readers.edges_csv(spark, path)


@query("sink_edges_csv", E + " SELECT src, dst FROM e")
def _(spark, sf):
    path = scratch_path(spark, "edges.csv")
    sinks.edges_csv(tx_edges(spark, sf), path)
    return readers.edges_csv(spark, path)


@query("source_edgelist", E + " SELECT src, dst FROM u")
def _(spark, sf):
    path = scratch_path(spark, "edges.txt")
    sinks.edgelist(tx_edges(spark, sf), path)
    return readers.edgelist(spark, path)[0]


@query("source_adjacency_list", E + " SELECT src, dst FROM u")
def _(spark, sf):
    path = scratch_path(spark, "adjacency.txt")
    near = G.adjacency(_u(spark, sf)).select(F.concat_ws(" ", "id", F.array_join("neighbours", " ")).alias("line"))
    near.unionByName(spark.createDataFrame([("# comment",), ("",)], "line string")).write.text(path)
    return readers.adjacency_list(spark, path)


@query("sink_walks", E + " SELECT array_to_string(list_sort(list(dst)), ' ') AS value FROM u GROUP BY src")
def _(spark, sf):
    path = scratch_path(spark, "walks.txt")
    sinks.walks(G.adjacency(_u(spark, sf)).select(F.col("neighbours").alias("walk")), path)
    return spark.read.text(path)


@query("source_dict", "SELECT DISTINCT src, dst FROM (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation)")
def _(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", "n_regionkey").collect()  # 25 rows
    return readers.from_dict(spark, {f"n{r[0]}": [f"r{r[1]}"] for r in rows}, undirected=True)


@query("source_matrix", "SELECT CAST(n_nationkey AS VARCHAR) AS src, CAST(n_regionkey AS VARCHAR) AS dst FROM nation UNION SELECT CAST(n_regionkey AS VARCHAR), CAST(n_nationkey AS VARCHAR) FROM nation")
def _(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", "n_regionkey").collect()  # 25 rows
    return readers.matrix(spark, cells=[(r[0], r[1]) for r in rows])


@query("source_parquet", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    return readers.parquet(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")


@query("bundle_round_trip", SPLIT_SQL + " SELECT tx_id, label, split, round(f_totalprice, 0) AS f_totalprice FROM sp")
def _(spark, sf):
    root = scratch_path(spark, "bundles")
    sinks.bundle(_labelled(spark, sf).select("tx_id", "label", "split", "class", F.round("f_totalprice", 0).alias("f_totalprice")), f"{root}/{sinks.bundle_name('a', {})}", {})
    (name,) = readers.discover(spark, root, "_a_")
    found = readers.bundle(spark, f"{root}/{name}")
    return found.select("tx_id", "label", "split", *[F.col(c).cast("double").alias(c) for c in readers.model_columns(found)])


@query("predictions_round_trip", PR + " SELECT run || '|' || classifier || '|' || variant || '|' || tx_id AS tx_id, y_true, y_pred, p0 FROM pred")
def _(spark, sf):
    path = scratch_path(spark, "run") + "/LR_a__testpreds.parquet"
    p = predictions(spark, sf).select(F.concat_ws("|", "run", "classifier", "variant", "tx_id").alias("tx_id"), "y_true", "y_pred", F.col("p0").alias("proba_fraud"), (1 - F.col("p0")).alias("proba_nofraud"))
    sinks.predictions(p, path)
    return readers.predictions(spark, path).select("tx_id", "y_true", "y_pred", F.col("proba_fraud").alias("p0"))


@query("result_round_trip", "SELECT event_type || '.json' AS name, round(avg(value), 6) AS f1 FROM events GROUP BY event_type")
def _(spark, sf):
    root = scratch_path(spark, "results")
    for r in table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("m")).collect():  # a row a type
        sinks.result(spark, f"{root}/{r['event_type']}.json", {"test_metrics": {"f1": r["m"], "loss": float("nan")}})
    return readers.results(spark, root).select("name", A.extract_metric(F.col("doc"), "f1_fraud").alias("f1"))


@query("result_pairs", "SELECT DISTINCT event_type AS stem FROM events")
def _(spark, sf):
    root = scratch_path(spark, "pairs")
    for r in table(spark, sf, "events").select("event_type").distinct().collect():  # a row a type
        sinks.result(spark, f"{root}/{r['event_type']}.json", {})
        sinks.write_text(spark, f"{root}/{r['event_type']}__testpreds.parquet", "-")
    return readers.pair_predictions(spark, root).select("stem")


@query("signal_meta", E + " SELECT 'degree' AS name, count(*) AS n_edges FROM e")
def _(spark, sf):
    root = scratch_path(spark, "meta")
    h = G.content_hash(tx_edges(spark, sf)).first()
    sinks.meta(spark, f"{root}/degree.meta.json", "degree", h["graph_hash"], n_edges=h["n_edges"])
    doc = spark.read.text(f"{root}/degree.meta.json", wholetext=True)
    return doc.select(F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.params.n_edges").cast("long").alias("n_edges"))


@query("matrix_csv", ORACLES["metric_pivot"])
def _(spark, sf):
    path, v = scratch_path(spark, "matrix.csv"), ["base", "degree", "pagerank", "core", "spectral"]
    sinks.matrix_csv(rounded(A.matrix(_stats(spark, sf), v), *v, digits=9), path)
    return readers.metric_matrix(spark, path)


@query("word2vec_round_trip", "SELECT CAST(vec_id AS VARCHAR) AS id, round(embedding[1], 5) AS first, round(embedding[64], 5) AS last, len(embedding) AS n FROM embeddings")
def _(spark, sf):
    path = scratch_path(spark, "vectors.txt")
    sinks.word2vec_text(table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("emb")), path)
    back = readers.word2vec_text(spark, path)
    return back.select("id", F.round(F.col("emb")[0].cast("double"), 5).alias("first"), F.round(F.col("emb")[63].cast("double"), 5).alias("last"), F.size("emb").cast("long").alias("n"))


@query("stored_table", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf):
    from txloom.functions.storage import materialize

    return materialize(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "state")


@query("stored_signal", E + " SELECT id, CAST(d AS DOUBLE) / ((SELECT count(*) FROM v) - 1) AS gi_degree_centrality FROM deg")
def _(spark, sf):
    root = scratch_path(spark, "signals")
    X.store_signals(tx_edges(spark, sf), ["deg_cent"], root)
    return readers.parquet(spark, f"{root}/deg_cent.parquet")


# -- projections, filters and joins ------------------------------------------------


@query("columns_sliced", W + NODES_SQL + " SELECT tx_id, time_step, class, f_totalprice, f_lines FROM tx")
def _(spark, sf):
    return C.slice_columns(tx_features(spark, sf), 3, 5)


@query("valid_mask", SPLIT_SQL + " SELECT tx_id, split = 'validation' AND label IN (0, 1) AS valid FROM sp")
def _(spark, sf):
    return _labelled(spark, sf).select("tx_id", C.valid_mask(F.col("split"), F.col("label"), "validation").alias("valid"))


@query("values_renamed", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fraud' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, sf):
    return C.rename_values(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "fraud", "O": "open"})


@query("id_inferred", "SELECT CAST(o_orderkey AS VARCHAR) AS tx_id, o_totalprice FROM orders")
def _(spark, sf):
    return C.with_id(table(spark, sf, "orders").select(F.col("o_orderkey").alias("txid"), "o_totalprice"))


@query("feature_tags", """SELECT CAST(n_nationkey AS INTEGER) AS k, 'base93+I' || (1 + n_nationkey % 2) || '+0Spectral+0ff2Vec+0Graphwave+0Role2Vec+0GCN+0GAT+0GCL+0Prox_edgesVar_None_splitseed' || n_nationkey || '_random_val20_test20' AS tag FROM nation""")
def _(spark, sf):
    keys = [r[0] for r in table(spark, sf, "nation").select("n_nationkey").collect()]  # 25 rows
    tags = [(int(k), FE.FeatureSet.parse("base deg_cent" if k % 2 == 0 else "base,inout", split_seed=int(k)).tag) for k in keys]
    return spark.createDataFrame(tags, "k int, tag string")


_CATEGORIES = [("degree", "Centrality"), ("pagerank", "Centrality"), ("core", "Cohesion")]


@query("category_allowed", TRIM + ", ca AS (SELECT unnest(['degree', 'pagerank', 'core']) AS variant, unnest(['Centrality', 'Centrality', 'Cohesion']) AS category) SELECT classifier, variant, category, round(mean, 9) AS mean FROM st JOIN ca USING (variant)")
def _(spark, sf):
    out = A.allowed(_stats(spark, sf), spark.createDataFrame(_CATEGORIES, "variant string, category string"))
    return rounded(out.select("classifier", "variant", "category", "mean"), "mean", digits=9)


@query("classifiers_excluded", TRIM + " SELECT classifier, variant, round(mean, 9) AS mean FROM st WHERE classifier NOT IN ('NB', 'SVC')")
def _(spark, sf):
    return rounded(A.without_classifiers(_stats(spark, sf), "NB", "SVC").select("classifier", "variant", "mean"), "mean", digits=9)


@query("groups_view", TRIM + " SELECT classifier, variant, round(mean, 9) AS mean, variant IN ('core', 'spectral') AS grouped FROM st")
def _(spark, sf):
    view = lambda main: A.groups_view(_stats(spark, sf), ["core", "spectral"], main).withColumn("grouped", F.lit(not main))
    return rounded(view(True).unionByName(view(False)).select("classifier", "variant", "mean", "grouped"), "mean", digits=9)


_VARIANTS = ["base", "degree", "pagerank", "core", "spectral"]


@query("metric_pivot_runs", PR + ", vr AS (SELECT run, classifier, variant, avg(p0) AS value FROM pred GROUP BY ALL) SELECT run, classifier, " + ", ".join(f"round(max(value) FILTER (variant = '{v}'), 6) AS {v}" for v in _VARIANTS) + " FROM vr GROUP BY run, classifier")
def _(spark, sf):
    values = predictions(spark, sf).groupBy(*KEYS).agg(F.avg("p0").alias("value"))
    return rounded(A.matrix_runs(values, _VARIANTS), *_VARIANTS)


@query("all_metrics", PR + """, g AS (SELECT run, classifier, variant, p0, count(*) FILTER (y_true = 0) AS p, count(*) AS n FROM pred GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (PARTITION BY run, classifier, variant ORDER BY p0 DESC RANGE UNBOUNDED PRECEDING))
SELECT run, classifier, variant, round(sum((n - p) * (tp - p / 2.0)) / nullif(sum(p)::DOUBLE * sum(n - p), 0), 6) AS roc_auc, round(sum(p::DOUBLE * tp / k) / nullif(sum(p), 0), 6) AS average_precision FROM c GROUP BY ALL""")
def _(spark, sf):
    return rounded(M.all_metrics(predictions(spark, sf), KEYS).select(*KEYS, "roc_auc", "average_precision"), "roc_auc", "average_precision")


@query("node_labels", E + ", " + NODES_SQL + " SELECT id, class FROM v LEFT JOIN (SELECT tx_id AS id, class FROM tx WHERE class > 0) USING (id)")
def _(spark, sf):
    return A.node_labels(G.nodes(tx_edges(spark, sf)), tx_features(spark, sf).filter("class > 0").select(F.col("tx_id").alias("id"), "class"))


@query("oversample_epoch", """WITH m AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) AS r FROM labels WHERE quality = 0), n AS (SELECT count(*) AS n FROM m), k AS (SELECT count(*) AS k FROM labels WHERE quality = 1),
d AS (SELECT i AS draw, CAST('0x' || substr(md5('42|3|' || i), 1, 15) AS BIGINT) % n + 1 AS r FROM k, n, range(1, k + 1) t(i) WHERE n < k)
SELECT doc_id, quality, CAST(0 AS BIGINT) AS draw FROM labels, n, k WHERE quality = 1 OR n >= k UNION ALL SELECT doc_id, 0, draw FROM d JOIN m USING (r)""")
def _(spark, sf):
    return S.oversample_epoch(table(spark, sf, "labels").select("doc_id", "quality"), "quality", 3, "doc_id", 2.0)


@query("graph_stats_labelled", E + ", " + NODES_SQL + """ SELECT (SELECT count(*) FROM v) AS n_nodes, (SELECT CAST(sum(d) / 2 AS BIGINT) FROM deg) AS n_edges, round(count(*) FILTER (class = 1)::DOUBLE / count(*), 9) AS share_0, round(count(*) FILTER (class = 2)::DOUBLE / count(*), 9) AS share_1
FROM tx JOIN v ON v.id = tx_id WHERE class IN (1, 2)""")
def _(spark, sf):
    labels = tx_features(spark, sf).select(F.col("tx_id").alias("id"), C.encode_label(F.col("class")).alias("label"))
    return G.stats(tx_edges(spark, sf), labels).select("n_nodes", "n_edges", "share_0", "share_1")


# -- structural identity ---------------------------------------------------------------


@query("weights_scaled", DIST + ", sw AS (SELECT layer, bo.v, n, exp(-d) * deg.d AS w FROM (SELECT layer, v, n, d AS x FROM bo) b(layer, v, n, d) JOIN bo USING (layer, v, n, d) JOIN deg ON deg.id = n) SELECT layer, v, n, round(w / sum(w) OVER (PARTITION BY layer, v), 6) + 0.0 AS w FROM sw"
       .replace("(SELECT layer, v, n, d AS x FROM bo) b(layer, v, n, d) JOIN bo USING (layer, v, n, d)", "bo").replace("exp(-d) * deg.d", "exp(-bo.d) * deg.d"))
def _(spark, sf):
    scale = G.degrees(_u(spark, sf)).toDF("id", "value")
    return rounded(ST.layer_weights(ST.regroup(ST.cumulate(_dist(spark, sf))), scale=scale), "w")


@query("weights_softmax", E + """, x AS (SELECT src AS v, dst AS n, d::DOUBLE * 400 AS s FROM u JOIN deg ON deg.id = dst), h AS (SELECT *, pow(2.0, greatest(0, ceil(log2(max(s) OVER (PARTITION BY v) / 709.0)))) AS h FROM x),
y AS (SELECT v, n, exp(s / h - max(s / h) OVER (PARTITION BY v)) AS e FROM h) SELECT v, n, round(e / sum(e) OVER (PARTITION BY v), 6) AS w FROM y""")
def _(spark, sf):
    u = _u(spark, sf)
    w = u.join(G.degrees(u).toDF("dst", "d"), "dst").select(F.col("src").alias("v"), F.col("dst").alias("n"), F.col("d").cast("double").alias("w"))
    return rounded(ST.softmax_weights(w, 400.0), "w")


@query("alias_shares", E + ", x AS (SELECT src AS v, dst AS n, d::DOUBLE AS w FROM u JOIN deg ON deg.id = dst) SELECT v, n, round(w / sum(w) OVER (PARTITION BY v), 6) AS p FROM x")
def _(spark, sf):
    u = _u(spark, sf)
    w = u.join(G.degrees(u).toDF("dst", "d"), "dst").select(F.col("src").alias("v"), F.col("dst").alias("n"), F.col("d").cast("double").alias("w"))
    t = ST.alias_tables(w)  # the chance of each choice follows from all slots
    chance = t.select("v", "n", F.col("share").alias("p")).unionByName(t.select("v", F.col("other").alias("n"), (1 - F.col("share")).alias("p")))
    size = t.groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    return rounded(chance.join(size, "v").groupBy("v", "n").agg(F.sum(F.col("p") / F.col("k")).alias("p")), "p")


@query("all_pairs", "WITH v AS (SELECT DISTINCT 'n' || n_nationkey AS id FROM nation UNION SELECT 'r' || n_regionkey FROM nation) SELECT a.id AS v, b.id AS n FROM v a, v b WHERE a.id < b.id")
def _(spark, sf):
    e = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return ST.all_pairs(G.symmetric(e))


@query("weighted_costs", E + """ SELECT src, dst, round(((greatest(a.d, b.d) + 0.5) / (least(a.d, b.d) + 0.5) - 1) * least(p.n, q.n), 6) AS low, round(((greatest(a.d, b.d) + 0.5) / (least(a.d, b.d) + 0.5) - 1) * greatest(p.n, q.n), 6) AS high
FROM u JOIN deg a ON a.id = src JOIN deg b ON b.id = dst JOIN (SELECT d, count(*) AS n FROM deg GROUP BY d) p ON p.d = a.d JOIN (SELECT d, count(*) AS n FROM deg GROUP BY d) q ON q.d = b.d""")
def _(spark, sf):
    u = _u(spark, sf)
    d = G.degrees(u)
    f = d.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    side = lambda end, x, n: d.join(f, "d").select(F.col("id").alias(end), F.col("d").cast("double").alias(x), F.col("n").alias(n))
    t = u.join(side("src", "a", "fa"), "src").join(side("dst", "b", "fb"), "dst")
    c = [F.col(x) for x in ("a", "b", "fa", "fb")]
    return rounded(t.select("src", "dst", ST.cost_min(*c).alias("low"), ST.cost_max(*c).alias("high")), "low", "high")


# -- streams and learned signals ------------------------------------------------------


@query("event_stream", ORACLES["event_windows"])
def _(spark, sf):
    stream = table_stream(spark, sf, "events", table(spark, sf, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_available(windowed_counts(stream), "windows").withColumn("start", F.col("start").cast("timestamp_ntz"))
    return rounded(out, "total", digits=4)


for _kind in X.NETWORKS:
    @query(f"signal_{_kind}")
    def _(spark, sf, kind=_kind):
        return X.network_signal(tx_edges(spark, sf), _labelled(spark, sf), kind)
