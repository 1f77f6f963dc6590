"""Registered queries of iterative, random and learned operators.

Those that SQL cannot state, or that are defined by a random or numerical procedure,
have no twin; tests hold them against closed forms or brute force.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from txloom.functions import columns as C
from txloom.functions.storage import materialize
from txloom.operators import communities as CO
from txloom.operators import blocks, gcn_tables, gnn
from txloom.operators import graph as G
from txloom.operators import indicators as I
from txloom.operators import metrics as M
from txloom.operators import models
from txloom.operators import preprocess as P
from txloom.operators import spectral as SP
from txloom.operators import structural as ST
from txloom.operators import walks as WK
from txloom.plans import experiments as X
from txloom.plans.catalog import DIST, E, NODES_SQL, ORACLES, _dist, _labelled, _u, query, rounded
from txloom.sources.fixtures import table, tx_edges, tx_features
from txloom.streaming import degree_updates, windowed_counts

CC = E.replace("WITH ", "WITH RECURSIVE ", 1) + """,
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM v
UNION SELECT u.dst, min(cc.comp) FROM cc JOIN u ON u.src = cc.id JOIN recurring.cc AS old ON old.id = u.dst WHERE cc.comp < old.comp GROUP BY u.dst)"""


def _ev_sql(rounds: int = 20) -> str:
    out = CC + ", cz AS (SELECT comp, count(*) AS n FROM cc GROUP BY comp), x0 AS (SELECT id, comp, 1.0::DOUBLE / n AS x FROM cc JOIN cz USING (comp))"
    for k in range(rounds):
        out += f""", y{k} AS (SELECT a.id, any_value(a.comp) AS comp, any_value(a.x) + coalesce(sum(b.x), 0) AS y FROM x{k} a LEFT JOIN u ON u.src = a.id LEFT JOIN x{k} b ON b.id = u.dst GROUP BY a.id),
x{k + 1} AS (SELECT id, comp, y / sqrt(sum(y * y) OVER (PARTITION BY comp)) AS x FROM y{k})"""
    return out + f" SELECT id, round(x, 6) AS gi_eigenvector_centrality FROM x{rounds}"


@query("eigenvector_20", _ev_sql())
def _(spark, sf):
    return rounded(I.eigenvector(_u(spark, sf), fixed_iters=20), "gi_eigenvector_centrality")


@query("closeness")
def _(spark, sf):
    return I.closeness(_u(spark, sf))


@query("betweenness")
def _(spark, sf):
    return I.betweenness(_u(spark, sf))


@query("louvain")
def _(spark, sf):
    return CO.louvain(_u(spark, sf))


@query("leiden")
def _(spark, sf):
    return CO.leiden(_u(spark, sf))


@query("infomap")
def _(spark, sf):
    return CO.infomap(_u(spark, sf))


@query("community_extras", E + """, cm AS (SELECT id, length(id) || substr(id, 1, 1) AS comm FROM v), n AS (SELECT comm, count(*) AS n FROM cm GROUP BY comm),
m AS (SELECT a.comm, count(*) AS m FROM u JOIN cm a ON a.id = src JOIN cm b ON b.id = dst WHERE a.comm = b.comm AND src < dst GROUP BY a.comm)
SELECT id, n AS gi_comm_size, round(CASE WHEN n > 1 THEN coalesce(m, 0)::DOUBLE * 2 / (n * (n - 1)) ELSE 0 END, 9) AS gi_comm_density, CAST(n < 10 AS INTEGER) AS gi_comm_is_small FROM cm JOIN n USING (comm) LEFT JOIN m USING (comm)""")
def _(spark, sf):
    u = _u(spark, sf)
    members = G.nodes(u).withColumn("comm", F.concat(F.length("id").cast("string"), F.substring("id", 1, 1)))
    return rounded(I.community_extras(u, members).select("id", "gi_comm_size", "gi_comm_density", "gi_comm_is_small"), "gi_comm_density", digits=9)


@query("modularity", E + """, cm AS (SELECT id, length(id) || substr(id, 1, 1) AS comm FROM v), t AS (SELECT count(*)::DOUBLE AS t FROM u),
k AS (SELECT comm, sum(d)::DOUBLE AS k FROM deg JOIN cm USING (id) GROUP BY comm), w AS (SELECT a.comm, count(*) AS w FROM u JOIN cm a ON a.id = src JOIN cm b ON b.id = dst WHERE a.comm = b.comm GROUP BY a.comm)
SELECT round(sum(coalesce(w, 0) / t - pow(k / t, 2)), 9) AS modularity FROM k LEFT JOIN w USING (comm), t""")
def _(spark, sf):
    u = _u(spark, sf)
    members = G.nodes(u).withColumn("comm", F.concat(F.length("id").cast("string"), F.substring("id", 1, 1)))
    return rounded(I.modularity(u, members), "modularity", digits=9)


@query("spectral_embedding")
def _(spark, sf):
    return SP.spectral(_u(spark, sf))


@query("graphwave_embedding")
def _(spark, sf):
    return SP.graphwave(_u(spark, sf))


@query("walk_stable_int", "SELECT o_orderkey, CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) % 100000 AS s FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", WK.stable_int(F.col("o_orderkey").cast("string")).alias("s"))


@query("walk_seeds", E + " SELECT id, CAST(i AS INTEGER) AS iter, 42 + i * 100000 + CAST('0x' || substr(sha256(id), 1, 15) AS BIGINT) % 100000 AS seed FROM v, range(3) r(i)")
def _(spark, sf):
    return WK.walk_seeds(_u(spark, sf), 3)


def _walk_sql(walks: int = 10, length: int = 80) -> str:
    """Uniform walks: a step is the neighbour, in order of ids, that the hash of seed, walk and step picks."""
    unit = "CAST(CAST('0x' || substr(md5(w.seed || '|' || w.walk_id || '|' || (w.k + 1)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    return E.replace("WITH ", "WITH RECURSIVE ", 1) + f""", al AS (SELECT src AS id, list_sort(list(dst)) AS ns FROM u GROUP BY src),
w(k, walk_id, seed, node) AS (SELECT 0, id || '#' || i, 42 + i * 100000 + CAST('0x' || substr(sha256(id), 1, 15) AS BIGINT) % 100000, id FROM v, range({walks}) r(i)
UNION ALL SELECT w.k + 1, w.walk_id, w.seed, al.ns[CAST(floor({unit} * len(al.ns)) AS BIGINT) + 1] FROM w JOIN al ON al.id = w.node WHERE w.k < {length - 1})
SELECT walk_id, string_agg(node, ' ' ORDER BY k) AS walk FROM w GROUP BY walk_id"""


@query("walk_deepwalk", _walk_sql())
def _(spark, sf):
    return WK.deepwalk(_u(spark, sf)).select("walk_id", F.array_join("walk", " ").alias("walk"))


def _second_order_sql(p: float, q: float, walks: int = 10, length: int = 80) -> str:
    """Steps by weights: 1/p back, 1 to neighbours of the previous node and in the first step, 1/q else; weights are binary fractions, so their sums are exact."""
    unit = "CAST(CAST('0x' || substr(md5(w.seed || '|' || w.walk_id || '|' || (w.k + 1)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    return E.replace("WITH ", "WITH RECURSIVE ", 1) + f""", al AS (SELECT src AS id, list_sort(list(dst)) AS ns FROM u GROUP BY src),
w(k, walk_id, seed, node, back, around) AS (SELECT 0, id || '#' || i, 42 + i * 100000 + CAST('0x' || substr(sha256(id), 1, 15) AS BIGINT) % 100000, id, CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]) FROM v, range({walks}) r(i)
UNION ALL SELECT k + 1, walk_id, seed, ns[least(len(list_filter(range(1, len(ws) + 1), lambda j: list_sum(ws[1:j]) <= r * list_sum(ws))), len(ns) - 1) + 1], node, ns
FROM (SELECT w.k, w.walk_id, w.seed, w.node, al.ns, {unit} AS r,
             list_transform(al.ns, lambda x: CASE WHEN x = w.back THEN {1 / p}::DOUBLE WHEN w.k = 0 OR list_contains(w.around, x) THEN 1.0::DOUBLE ELSE {1 / q}::DOUBLE END) AS ws
      FROM w JOIN al ON al.id = w.node WHERE w.k < {length - 1}))
SELECT walk_id, string_agg(node, ' ' ORDER BY k) AS walk FROM w GROUP BY walk_id"""


for _variant in ("dfs", "bfs"):
    @query(f"walk_node2vec_{_variant}", _second_order_sql(*WK.NODE2VEC[_variant]))
    def _(spark, sf, variant=_variant):
        return WK.node2vec(_u(spark, sf), variant).select("walk_id", F.array_join("walk", " ").alias("walk"))


@query("walk_node2vec_bal", _walk_sql())
def _(spark, sf):
    return WK.node2vec(_u(spark, sf), "bal").select("walk_id", F.array_join("walk", " ").alias("walk"))


def _role_sql(walks: int = 10, length: int = 80) -> str:
    """Uniform steps among the neighbours of the node's own role label, among all where none has it."""
    labels = ORACLES["wl_labels"].rpartition(" SELECT id, label FROM ")
    unit = "CAST(CAST('0x' || substr(md5(w.seed || '|' || w.walk_id || '|' || (w.k + 1)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    return labels[0].replace("WITH ", "WITH RECURSIVE ", 1) + f""",
tu AS (SELECT src, dst, p.label = q.label AS alike FROM u JOIN {labels[2]} p ON p.id = src JOIN {labels[2]} q ON q.id = dst),
al AS (SELECT src AS id, CASE WHEN bool_or(alike) THEN list_sort(list(dst) FILTER (alike)) ELSE list_sort(list(dst)) END AS ns FROM tu GROUP BY src),
w(k, walk_id, seed, node) AS (SELECT 0, id || '#' || i, 42 + i * 100000 + CAST('0x' || substr(sha256(id), 1, 15) AS BIGINT) % 100000, id FROM al, range({walks}) r(i)
UNION ALL SELECT w.k + 1, w.walk_id, w.seed, al.ns[CAST(floor({unit} * len(al.ns)) AS BIGINT) + 1] FROM w JOIN al ON al.id = w.node WHERE w.k < {length - 1})
SELECT walk_id, string_agg(node, ' ' ORDER BY k) AS walk FROM w GROUP BY walk_id"""


@query("walk_role2vec", _role_sql())
def _(spark, sf):
    u = materialize(_u(spark, sf), "links")  # labels and walks read it
    return WK.role2vec(u, I.wl_labels(u)).select("walk_id", F.array_join("walk", " ").alias("walk"))


@query("topk_degree", E + " SELECT id, d FROM deg ORDER BY d DESC, id LIMIT 500")
def _(spark, sf):
    return WK.top_degree(_u(spark, sf), 500)


@query("skipgram_embedding")
def _(spark, sf):
    return WK.skipgram(WK.deepwalk(_u(spark, sf)))


@query("structural_walks")
def _(spark, sf):
    u = _u(spark, sf)
    return WK.weighted_walk(ST.flatten(ST.layer_weights(ST.regroup(ST.cumulate(ST.moment_distances(u.filter("src < dst").toDF("v", "n"), ST.layer_moments(u)))))))


@query("structural_dtw")
def _(spark, sf):
    u = _u(spark, sf)
    return ST.dtw_distances(u.filter("src < dst").toDF("v", "n"), ST.degree_lists(u))


@query("layer_med_var_distance", DIST.replace("a.mean", "a.median").replace("b.mean", "b.median") + " SELECT v, n, layer, round(d, 6) + 0.0 AS d FROM ds")
def _(spark, sf):
    u = _u(spark, sf)
    return rounded(ST.moment_distances(u.filter("src < dst").toDF("v", "n"), ST.layer_moments(u), center="median"), "d")


@query("pairs_regrouped", DIST + " SELECT layer, v, n, round(d, 6) + 0.0 AS d FROM (SELECT layer, v, n, d FROM ds UNION ALL SELECT layer, n, v, d FROM ds)")
def _(spark, sf):
    return rounded(ST.regroup(_dist(spark, sf)), "d")


@query("layer_euclid_distance", E + """, mv AS (SELECT src AS id, avg(d)::DOUBLE AS m, avg(d * d)::DOUBLE AS s FROM u JOIN deg ON deg.id = dst GROUP BY src)
SELECT src AS v, dst AS n, 1 AS layer, round(sqrt(pow(a.m - b.m, 2) + pow(a.s - b.s, 2)), 6) AS d FROM u JOIN mv a ON a.id = src JOIN mv b ON b.id = dst WHERE src < dst""")
def _(spark, sf):
    u = _u(spark, sf)
    d = G.degrees(u).toDF("dst", "d")
    vec = u.join(d, "dst").groupBy(F.col("src").alias("id")).agg(F.array(F.avg("d"), F.avg(F.col("d") * F.col("d"))).alias("mean")).withColumn("layer", F.lit(1))
    return rounded(ST.euclid_distances(u.filter("src < dst").toDF("v", "n"), vec), "d")


# -- graph neural operators ---------------------------------------------------

_H = E + ", " + NODES_SQL + ", h AS (SELECT tx_id AS id, coalesce(f_lines, 0) AS a, f_totalprice / 1000 AS b FROM tx WHERE tx_id IN (SELECT id FROM v))"


def _h(spark, sf):
    t = tx_features(spark, sf).join(G.nodes(tx_edges(spark, sf)).withColumnRenamed("id", "tx_id"), "tx_id", "left_semi")
    return t.select(F.col("tx_id").alias("id"), F.array(F.coalesce("f_lines", F.lit(0.0)), F.col("f_totalprice") / 1000).alias("x"))


for _reduce, _f in (("sum", "sum"), ("mean", "avg"), ("max", "max")):
    @query(f"message_passing_{_reduce}", _H + f" SELECT dst AS id, round({_f}(a), 11) AS x0, round({_f}(b), 11) AS x1 FROM u JOIN h ON h.id = src GROUP BY dst")
    def _(spark, sf, reduce=_reduce):
        out = gnn.message_passing(_u(spark, sf), _h(spark, sf), 2, "copy_u", reduce)
        return rounded(out.select("id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1")), "x0", "x1", digits=11)


@query("message_functions", _H + """ SELECT dst AS id, round(sum(s.a + t.a), 6) AS added, round(sum(t.a - s.a), 6) + 0.0 AS taken, round(sum(s.a * t.a), 6) AS product FROM u JOIN h s ON s.id = src JOIN h t ON t.id = dst GROUP BY dst""")
def _(spark, sf):
    u, h = _u(spark, sf), _h(spark, sf)
    part = lambda m, name: gnn.message_passing(u, h, 1, m).select("id", F.col("x")[0].alias(name))
    return rounded(part("u_add_v", "added").join(part("v_sub_u", "taken"), "id").join(part("v_mul_u", "product"), "id"), "added", "taken", "product")


@query("attention_softmax", _H + """, s AS (SELECT src, dst, tanh(p.a / 10) + tanh(q.b / 100) AS s FROM u JOIN h p ON p.id = src JOIN h q ON q.id = dst), m AS (SELECT *, max(s) OVER (PARTITION BY dst) AS m FROM s)
SELECT src, dst, round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY dst), 6) AS alpha FROM m""")
def _(spark, sf):
    h = _h(spark, sf)
    ends = _u(spark, sf).join(h.toDF("src", "p"), "src").join(h.toDF("dst", "q"), "dst")
    out = gnn.attention(ends, F.tanh(F.col("p")[0] / 10) + F.tanh(F.col("q")[1] / 100))
    return rounded(out.select("src", "dst", "alpha"), "alpha")


@query("cosine_loss", "SELECT a.vec_id, round(2 - 2 * list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS loss FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    a = table(spark, sf, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(a.join(b, "vec_id").select("vec_id", gnn.cosine_loss(F.col("embedding"), F.col("other")).alias("loss")), "loss")


@query("augment_edges", E + """ SELECT src, dst FROM u WHERE CAST(CAST('0x' || substr(md5('7|0|' || least(src, dst) || '|' || greatest(src, dst)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 >= 0.2""")
def _(spark, sf):
    return gnn.augment(_u(spark, sf), _h(spark, sf), 0.2, 0.1, 2, 7)[0]


def _graph(spark, sf):
    t = _labelled(spark, sf).select(F.col("tx_id").alias("id"), "label", "split", F.coalesce("f_lines", F.lit(0.0)).alias("f_lines"), "f_totalprice")
    cols = ["f_lines", "f_totalprice"]
    return blocks.Blocks(tx_edges(spark, sf), P.zscore(t, cols), cols, max(gnn.SPACE["layers"].options))


@query("gcn_search")
def _(spark, sf):
    held = _graph(spark, sf)
    try:
        return gnn.tune(spark, held)
    finally:
        held.close()


# Any weights do for one step; these are plain numbers for both engines.
_STEP = {"w0": [[0.5, -0.4, 0.3], [0.2, 0.6, -0.7]], "b0": [0.1, -0.05, 0.2], "w1": [[0.3, -0.2], [-0.5, 0.4], [0.6, 0.1]], "b1": [0.05, -0.05]}


def _step_sql() -> str:
    w0, b0, w1, b1 = (_STEP[k] for k in ("w0", "b0", "w1", "b1"))
    hidden = ", ".join(f"greatest(a0 * {w0[0][j]}::DOUBLE + a1 * {w0[1][j]}::DOUBLE + {b0[j]}::DOUBLE, 0) AS h{j}" for j in range(3))
    outputs = ", ".join("avg(" + " + ".join(f"h{j} * {w1[j][o]}::DOUBLE" for j in range(3)) + f") + {b1[o]}::DOUBLE AS z{o}" for o in range(2))
    slopes = ", ".join(f"CASE WHEN h{j} > 0 THEN t0 * {w1[j][0]}::DOUBLE + t1 * {w1[j][1]}::DOUBLE ELSE 0 END AS e{j}" for j in range(3))
    cells = [("w0", i, j, f"sum(a{i} * e{j})") for i in range(2) for j in range(3)] + [("b0", 0, j, f"sum(e{j})") for j in range(3)]
    cells += [("w1", j, o, f"sum(h{j} * t{o})") for j in range(3) for o in range(2)] + [("b1", 0, o, f"sum(d{o})") for o in range(2)]
    cells.append(("loss", 0, 0, "avg(CASE WHEN part = 1 AND y >= 0 THEN -ln(CASE y WHEN 0 THEN p0 ELSE 1 - p0 END) END)"))
    rows = " UNION ALL ".join(f"SELECT '{m}' AS name, {i} AS i, {j} AS j, round({x}, 6) + 0.0 AS v FROM s" for m, i, j, x in cells)
    return f"""{E}, {NODES_SQL},
n AS (SELECT tx_id AS id, CASE WHEN class IN (1, 2) THEN class - 1 ELSE -1 END AS y, CASE WHEN time_step <= 20 THEN 0 WHEN time_step <= 35 THEN 1 ELSE 2 END AS part, coalesce(f_lines, 0) / 10 AS x0, f_totalprice / 500000 AS x1 FROM tx),
g AS (SELECT src, dst FROM u UNION SELECT id, id FROM n),
c AS (SELECT dst AS id, count(*) AS c, avg(x0) AS a0, avg(x1) AS a1 FROM g JOIN n ON n.id = src GROUP BY dst),
h AS (SELECT *, {hidden} FROM c),
z AS (SELECT dst AS id, {outputs} FROM g JOIN h ON h.id = src GROUP BY dst),
k AS (SELECT y, 1.0::DOUBLE / (2 * count(*)) AS w FROM n WHERE part = 0 AND y >= 0 GROUP BY y),
p AS (SELECT z.id, n.y, part, 1 / (1 + exp(z1 - z0)) AS p0, CASE WHEN part = 0 THEN coalesce(w, 0) ELSE 0 END AS w FROM z JOIN n USING (id) LEFT JOIN k ON k.y = n.y),
d AS (SELECT *, w * (p0 - CASE y WHEN 0 THEN 1 ELSE 0 END) AS d0, w * (1 - p0 - CASE y WHEN 1 THEN 1 ELSE 0 END) AS d1 FROM p),
t AS (SELECT dst AS id, sum(d0 / c) AS t0, sum(d1 / c) AS t1 FROM g JOIN d ON d.id = src JOIN c ON c.id = src GROUP BY dst),
s AS (SELECT d.*, h.* EXCLUDE (id), t0, t1, {slopes} FROM d JOIN h USING (id) JOIN t USING (id))
{rows}"""


@query("gcn_gradients", _step_sql())
def _(spark, sf):
    """All gradients of a two-layer network over the whole graph, through joins, and its validation loss."""
    t = tx_features(spark, sf)
    part = F.when(F.col("time_step") <= 20, "train").when(F.col("time_step") <= 35, "validation").otherwise("test")
    nodes = t.select(F.col("tx_id").alias("id"), F.when(F.col("class").isin(1, 2), F.col("class") - 1).alias("label"), part.alias("split"), (F.coalesce("f_lines", F.lit(0.0)) / 10).alias("x0"), (F.col("f_totalprice") / 500000).alias("x1"))
    tables = gcn_tables.Tables(tx_edges(spark, sf), nodes, ["x0", "x1"])
    grads, loss = tables.step({k: np.array(v) for k, v in _STEP.items()}, {})
    tables.close()
    cells = [(k, i, j, float(v)) for k, g in grads.items() for (i, j), v in np.ndenumerate(np.atleast_2d(g))]
    return rounded(spark.createDataFrame([*cells, ("loss", 0, 0, loss)], "name string, i int, j int, v double"), "v")


@query("gat_predictions")
def _(spark, sf):
    scaled, columns = X.network_input(_labelled(spark, sf))
    return gnn.classify(tx_edges(spark, sf), scaled, columns, "gat").select("tx_id", "p0")


@query("bgrl_embedding")
def _(spark, sf):
    scaled, columns = X.network_input(_labelled(spark, sf))
    return blocks.embed(tx_edges(spark, sf), scaled, columns, "gcl", 32, scores=False).select(F.col("id").alias("tx_id"), "emb")


# -- models -------------------------------------------------------------------

_MODELS = {"LR": {"balancing": "class_weights"}, "NB": {"var_smoothing": 1e-6}, "RF": {}, "XGB": {}, "SVC": {"kernel": "rbf", "balancing": "class_weights"}, "MLP": {}}
for _name, _params in _MODELS.items():
    @query(f"model_{_name.lower()}")
    def _(spark, sf, name=_name, params=_params):
        t = _labelled(spark, sf)
        cols = [c for c in t.columns if c.startswith("f_")]
        t = t.select("tx_id", "label", "split", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])
        return models.run(name, t, cols, params)["predictions"]


@query("emb_pca")
def _(spark, sf):
    t = table(spark, sf, "embeddings").select("vec_id", F.when(F.pmod("vec_id", F.lit(5)) < 4, "train").otherwise("test").alias("split"), *[F.col("embedding")[i].cast("double").alias(f"emb_{i}") for i in range(64)])
    return P.emb_pca(t, [f"emb_{i}" for i in range(64)], 8)


@query("quality_metrics", """WITH p AS (SELECT quality AS y_true, CASE WHEN n_chars < 900 THEN 0 ELSE 1 END AS y_pred FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (y_true = 0 AND y_pred = 0) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tn FROM p)
SELECT round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round((coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy FROM c""")
def _(spark, sf):
    t = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    p = t.select(F.col("quality").alias("y_true"), F.when(F.col("n_chars") < 900, 0).otherwise(1).alias("y_pred"))
    return rounded(M.precision_recall_f1(p), "precision", "recall", "f1", "accuracy", "balanced_accuracy")


# -- windows over events ------------------------------------------------------


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    return rounded(windowed_counts(table(spark, sf, "events")), "total", digits=4)


@query("degree_updates", E + " SELECT id, count(*) AS d FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id")
def _(spark, sf):
    return degree_updates(tx_edges(spark, sf))


@query("column_groups", """SELECT column_name AS name, CASE WHEN column_name LIKE 'f\\_%' ESCAPE '\\' THEN 'gi' WHEN column_name LIKE 'emb\\_%' ESCAPE '\\' THEN 'emb' ELSE 'base' END AS kind
FROM (DESCRIBE SELECT * FROM (WITH """ + NODES_SQL + """ SELECT tx.*, e.embedding[1] AS emb_0 FROM tx, embeddings e)) WHERE column_name NOT IN ('tx_id', 'time_step', 'class')""")
def _(spark, sf):
    both = tx_features(spark, sf).crossJoin(table(spark, sf, "embeddings").select(F.col("embedding")[0].alias("emb_0")))  # columns only, never run
    g = C.column_groups(both.columns, gi="f_")
    return spark.createDataFrame([(n, kind) for kind, names in g.items() for n in names], "name string, kind string")
