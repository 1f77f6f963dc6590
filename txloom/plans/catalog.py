"""Registered queries of the graph-signal operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.functions import columns as C
from txloom.functions.storage import hash_key
from txloom.operators import analysis as A
from txloom.operators import features as FE
from txloom.operators import graph as G
from txloom.operators import indicators as I
from txloom.operators import metrics as M
from txloom.operators import preprocess as P
from txloom.operators import sampling as S
from txloom.operators import structural as ST
from txloom.sources.fixtures import EDGES_SQL, NODES_SQL, PRED_SQL, predictions, table, tx_edges, tx_features

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Named columns rounded, minus zero as zero."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def _u(spark: SparkSession, sf: str) -> DataFrame:
    return G.symmetric(G.without_loops(tx_edges(spark, sf)))


def _labelled(spark: SparkSession, sf: str, seed: int = 1) -> DataFrame:
    t = tx_features(spark, sf).filter("class IN (1, 2)").withColumn("label", C.encode_label(F.col("class")))
    return S.split_random(t, "label", seed=seed)


W = "WITH "
E = W + EDGES_SQL

# -- edges and graphs ---------------------------------------------------------


@query("tx_edges", E + " SELECT src, dst FROM e")
def _(spark, sf):
    return tx_edges(spark, sf)


@query("edge_canonical", E + " SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e")
def _(spark, sf):
    return G.canonical_edges(tx_edges(spark, sf))


@query("edge_hash", E + """, c AS (SELECT DISTINCT least(src, dst) || ',' || greatest(src, dst) AS k FROM e),
h AS (SELECT count(*) AS n_edges, bit_xor(CAST('0x' || substr(md5(k), 1, 15) AS BIGINT)) AS x, bit_xor(CAST('0x' || substr(md5(k), 16, 15) AS BIGINT)) AS y FROM c)
SELECT substr(md5(n_edges || '|' || x || '|' || y), 1, 16) AS graph_hash, n_edges FROM h""")
def _(spark, sf):
    return G.content_hash(tx_edges(spark, sf))


for _pct in (25, 50):
    @query(f"edge_subsample_{_pct}", E + f""" SELECT src, dst FROM (SELECT src, dst, row_number() OVER (ORDER BY md5('42|' || src || '|' || dst)) AS r FROM e)
WHERE r <= (SELECT CAST(round_even({1 - _pct / 100} * count(*), 0) AS BIGINT) FROM e)""")
    def _(spark, sf, share=_pct / 100):
        return G.subsample(tx_edges(spark, sf), share)


@query("edges_symmetric", E + " SELECT src, dst FROM u")
def _(spark, sf):
    return G.symmetric(tx_edges(spark, sf))


@query("edges_self_loop", E + " SELECT src, dst FROM u UNION SELECT id, id FROM v")
def _(spark, sf):
    return G.with_loops(G.symmetric(tx_edges(spark, sf)))


@query("edges_without_loops", E + " SELECT src, dst FROM (SELECT * FROM e UNION SELECT id, id FROM v) WHERE src <> dst")
def _(spark, sf):
    return G.without_loops(G.with_loops(tx_edges(spark, sf)))


@query("graph_nodes", E + " SELECT id FROM v")
def _(spark, sf):
    return G.nodes(tx_edges(spark, sf))


@query("induced_subgraph", E + ", " + NODES_SQL + " SELECT src, dst FROM e WHERE src IN (SELECT tx_id FROM tx WHERE class IN (1, 2)) AND dst IN (SELECT tx_id FROM tx WHERE class IN (1, 2))")
def _(spark, sf):
    return G.induced(tx_edges(spark, sf), tx_features(spark, sf).filter("class IN (1, 2)"), "tx_id")


@query("node_index", E + " SELECT row_number() OVER (ORDER BY id) - 1 AS node_idx, id FROM v")
def _(spark, sf):
    return G.node_index(tx_edges(spark, sf))


@query("adjacency_lists", E + " SELECT src AS id, array_to_string(list_sort(list(dst)), ' ') AS neighbours FROM u GROUP BY src")
def _(spark, sf):
    return G.adjacency(_u(spark, sf)).select("id", F.array_join("neighbours", " ").alias("neighbours"))


@query("clique_20", "SELECT CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst FROM range(20) x(a), range(20) y(b) WHERE a < b")
def _(spark, sf):
    return G.clique(spark, 20)


@query("graph_stats", E + """ SELECT count(*) AS n_nodes, CAST(sum(d) / 2 AS BIGINT) AS n_edges, count(*) FILTER (d <= 2) AS n_near_isolated, max(d) AS max_degree,
round(CAST(sum(d) / 2 AS BIGINT) * 2.0::DOUBLE / (count(*)::DOUBLE * (count(*) - 1)), 9) AS density FROM deg""")
def _(spark, sf):
    return G.stats(tx_edges(spark, sf))


@query("components", E.replace("WITH ", "WITH RECURSIVE ", 1) + """,
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM v
UNION SELECT u.dst, min(cc.comp) FROM cc JOIN u ON u.src = cc.id JOIN recurring.cc AS old ON old.id = u.dst WHERE cc.comp < old.comp GROUP BY u.dst)
SELECT id, comp FROM cc""")
def _(spark, sf):
    return G.components(_u(spark, sf))


# -- node tables, labels, splits ---------------------------------------------


@query("label_encode", W + NODES_SQL + " SELECT tx_id, CAST(CASE class WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE -1 END AS INTEGER) AS label FROM tx")
def _(spark, sf):
    return tx_features(spark, sf).select("tx_id", C.encode_label(F.col("class")).alias("label"))


@query("label_parse", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN -1 WHEN 'F' THEN 1 END AS class FROM orders")
def _(spark, sf):
    text = F.when(F.col("o_orderstatus") == "P", "unknown").when(F.col("o_orderstatus") == "F", "1").otherwise("n/a")
    return table(spark, sf, "orders").select("o_orderkey", C.parse_label(text).alias("class"))


@query("label_counts", W + NODES_SQL + " , c AS (SELECT class, count(*) AS n FROM tx GROUP BY class) SELECT class, n, (SELECT min(n) * 10 < sum(n) FROM c) AS imbalanced FROM c")
def _(spark, sf):
    return S.label_counts(tx_features(spark, sf))


@query("week_filter", W + NODES_SQL + " SELECT tx_id, time_step FROM tx WHERE time_step <= 40")
def _(spark, sf):
    return tx_features(spark, sf).filter("time_step <= 40").select("tx_id", "time_step")


@query("labeled_filter", W + NODES_SQL + " SELECT tx_id, class FROM tx WHERE class IN (1, 2)")
def _(spark, sf):
    return tx_features(spark, sf).filter("class IN (1, 2)").select("tx_id", "class")


@query("finite_fill", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (2, 3, 4) THEN 0.0 ELSE l_quantity END AS q FROM lineitem")
def _(spark, sf):
    q = F.when(F.col("l_linenumber") == 2, float("nan")).when(F.col("l_linenumber") == 3, float("inf")).when(F.col("l_linenumber") == 4, None).otherwise(F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.finite(q).alias("q"))


@query("nan_counts", "SELECT unnest(['a', 'b']) AS \"column\", unnest([count(*) FILTER (l_linenumber = 2), count(*) FILTER (l_linenumber IN (2, 3))]) AS n FROM lineitem")
def _(spark, sf):
    t = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    return C.nan_counts(t.select(F.when(n == 2, float("nan")).otherwise(F.col("l_tax")).alias("a"), F.when(n == 2, float("nan")).when(n == 3, None).otherwise(F.col("l_tax")).alias("b")))


SPLIT_SQL = W + NODES_SQL + """,
lb AS (SELECT *, CAST(class - 1 AS INTEGER) AS label FROM tx WHERE class IN (1, 2)),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('1|' || tx_id)) AS r, count(*) OVER (PARTITION BY label) AS n FROM lb),
sp AS (SELECT * EXCLUDE (r, n), CASE WHEN r <= floor(n * 0.2 + 0.5) THEN 'test' WHEN r <= floor(n * 0.2 + 0.5) + floor(n * 0.2 + 0.5) THEN 'validation' ELSE 'train' END AS split FROM rk)"""


@query("split_random", SPLIT_SQL + " SELECT tx_id, label, split FROM sp")
def _(spark, sf):
    return _labelled(spark, sf).select("tx_id", "label", "split")


@query("split_temporal", W + NODES_SQL + " SELECT tx_id, CASE WHEN time_step <= 29 THEN 'train' WHEN time_step <= 39 THEN 'validation' ELSE 'test' END AS split FROM tx WHERE time_step <= 49")
def _(spark, sf):
    return S.split_temporal(tx_features(spark, sf), (1, 29), (30, 39), (40, 49)).select("tx_id", "split")


@query("oversample_minority", """WITH m AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) AS r FROM labels WHERE quality = 0),
d AS (SELECT i AS draw, CAST('0x' || substr(md5('42|' || i), 1, 15) AS BIGINT) % (SELECT count(*) FROM m) + 1 AS r FROM range(1, (SELECT count(*) + 1 FROM labels WHERE quality = 1)) t(i))
SELECT doc_id, 1 AS quality, 0 AS draw FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 0, draw FROM d JOIN m USING (r)""")
def _(spark, sf):
    return S.oversample(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("class_weights", "SELECT quality, count(*) AS n, round(CAST((SELECT count(*) FROM labels) AS DOUBLE) / (2 * count(*)), 6) AS weight FROM labels GROUP BY quality")
def _(spark, sf):
    return rounded(S.class_weights(table(spark, sf, "labels"), "quality"), "weight")


@query("ratio_weight", "SELECT doc_id, round(CASE quality WHEN 0 THEN (SELECT count(*) FILTER (quality = 1)::DOUBLE / count(*) FILTER (quality = 0) FROM labels) ELSE 1 END, 6) AS weight FROM labels")
def _(spark, sf):
    return rounded(S.ratio_weight(table(spark, sf, "labels"), "quality").select("doc_id", "weight"), "weight")


# -- feature tables -----------------------------------------------------------

DEG_SQL = """
io AS (SELECT id, sum(i) AS gi_in_degree, sum(o) AS gi_out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id),
dc AS (SELECT id, d::DOUBLE / ((SELECT count(*) FROM deg) - 1) AS gi_degree_centrality FROM deg)"""


@query("feature_assemble", E + ", " + NODES_SQL + ", " + DEG_SQL + """ SELECT tx_id, time_step, round(coalesce(gi_degree_centrality, 0), 6) AS gi_degree_centrality,
CAST(coalesce(gi_in_degree, 0) AS DOUBLE) AS gi_in_degree, CAST(coalesce(gi_out_degree, 0) AS DOUBLE) AS gi_out_degree FROM tx LEFT JOIN dc ON dc.id = tx_id LEFT JOIN io ON io.id = tx_id""")
def _(spark, sf):
    e = tx_edges(spark, sf)
    wide = FE.assemble(tx_features(spark, sf).select("tx_id", "time_step"), {"deg_cent": I.degree_centrality(G.symmetric(e)), "inout": I.in_out_degree(e)})
    return rounded(wide.withColumns({c: F.col(c).cast("double") for c in wide.columns[2:]}), *wide.columns[2:])


@query("feature_split_summary", E + SPLIT_SQL.replace("WITH ", ", ", 1) + ", " + DEG_SQL + """ SELECT split, label, count(*) AS n, round(avg(coalesce(gi_in_degree, 0) + coalesce(gi_out_degree, 0)), 6) AS mean_degree,
round(avg(coalesce(gi_degree_centrality, 0)), 9) AS mean_centrality FROM sp LEFT JOIN dc ON dc.id = tx_id LEFT JOIN io ON io.id = tx_id GROUP BY split, label""")
def feature_split_summary(spark, sf):
    """Baseline plus degree features of labelled transactions, split and summarised: the flagship query."""
    e = tx_edges(spark, sf)
    wide = _labelled(spark, sf).select("tx_id", "label", "split").join(I.degree_centrality(G.symmetric(e)).withColumnRenamed("id", "tx_id"), "tx_id", "left").join(I.in_out_degree(e).withColumnRenamed("id", "tx_id"), "tx_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = wide.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.avg(zero("gi_in_degree") + zero("gi_out_degree")).alias("mean_degree"), F.avg(F.coalesce("gi_degree_centrality", F.lit(0.0))).alias("mean_centrality"))
    return rounded(rounded(out, "mean_degree"), "mean_centrality", digits=9)


@query("embedding_coverage", "SELECT (SELECT count(*) FROM documents) AS n_ids, count(*) AS n_covered FROM documents JOIN embeddings ON vec_id = doc_id WHERE abs(embedding[1]) + abs(embedding[2]) > 0")
def _(spark, sf):
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding")[0].alias("e0"), F.col("embedding")[1].alias("e1"))
    return FE.coverage(table(spark, sf, "documents").select("doc_id"), emb, ["e0", "e1"], "doc_id")


@query("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def _(spark, sf):
    return rounded(table(spark, sf, "embeddings").select("vec_id", C.norm(F.col("embedding")).alias("norm")), "norm")


@query("zscore_train_fit", SPLIT_SQL + """, f AS (SELECT avg(f_totalprice) AS m, stddev_pop(f_totalprice) AS s, avg(f_sum_quantity) AS m2, stddev_pop(f_sum_quantity) AS s2 FROM sp WHERE split = 'train')
SELECT tx_id, split, round((f_totalprice - m) / s, 6) + 0.0 AS f_totalprice, round(coalesce((f_sum_quantity - m2) / s2, 0), 6) + 0.0 AS f_sum_quantity FROM sp, f""")
def _(spark, sf):
    cols = ["f_totalprice", "f_sum_quantity"]
    return rounded(P.zscore(_labelled(spark, sf).select("tx_id", "split", *cols), cols), *cols)


@query("minmax_train_fit", SPLIT_SQL + """, f AS (SELECT min(f_totalprice) AS a, max(f_totalprice) AS b FROM sp WHERE split = 'train')
SELECT tx_id, round((f_totalprice - a) / (b - a), 6) + 0.0 AS f_totalprice FROM sp, f""")
def _(spark, sf):
    return rounded(P.minmax(_labelled(spark, sf).select("tx_id", "split", "f_totalprice"), ["f_totalprice"]).drop("split"), "f_totalprice")


NB_COLS = ["f_totalprice", "f_lines", "f_sum_quantity"]
_NB_V = ", ".join(f"var_pop({c}) AS v{i}, avg({c}) AS m{i}" for i, c in enumerate(NB_COLS))
_NB_J = lambda k: f"ln(p{k})" + "".join(f" - 0.5 * ln(2 * pi() * (c{k}.v{i} + x)) - pow({c} - c{k}.m{i}, 2) / (2 * (c{k}.v{i} + x))" for i, c in enumerate(NB_COLS))
NB_SQL = SPLIT_SQL + f""", z AS (SELECT tx_id, label, split, {', '.join(f'coalesce({c}, 0) AS {c}' for c in NB_COLS)} FROM sp),
tr AS (SELECT * FROM z WHERE split = 'train'),
x AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({c})' for c in NB_COLS)}) AS x, count(*) FILTER (label = 0)::DOUBLE / count(*) AS p0, count(*) FILTER (label = 1)::DOUBLE / count(*) AS p1 FROM tr),
c0 AS (SELECT {_NB_V} FROM tr WHERE label = 0), c1 AS (SELECT {_NB_V} FROM tr WHERE label = 1),
nb AS (SELECT tx_id, label, split, 1 / (1 + exp(least(700, ({_NB_J(1)}) - ({_NB_J(0)})))) AS p0 FROM z, x, c0, c1)"""


def _nb(spark, sf):
    z = _labelled(spark, sf).select("tx_id", "label", "split", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in NB_COLS])
    return P.gaussian_nb(z, NB_COLS)


@query("gaussian_nb", NB_SQL + " SELECT tx_id, round(p0, 6) + 0.0 AS p0 FROM nb")
def _(spark, sf):
    return rounded(_nb(spark, sf).select("tx_id", "p0"), "p0")


@query("nb_proba_clip", NB_SQL + ", k AS (SELECT tx_id, least(greatest(p0, 0.4), 0.6) AS a, least(greatest(1 - p0, 0.4), 0.6) AS b FROM nb) SELECT tx_id, round(a / (a + b), 6) AS p0, round(b / (a + b), 6) AS p1 FROM k")
def _(spark, sf):
    return rounded(P.clip_proba(_nb(spark, sf), 0.4).select("tx_id", "p0", "p1"), "p0", "p1")


# -- metrics ------------------------------------------------------------------

PR = W + PRED_SQL
KEYS = ["run", "classifier", "variant"]
_CNT = """cm AS (SELECT run, classifier, variant, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fn,
count(*) FILTER (y_true = 1 AND y_pred = 0) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tn FROM pred GROUP BY ALL)"""
_RATES = """round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy,
round((coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy"""


@query("confusion", PR + ", " + _CNT + " SELECT * FROM cm")
def _(spark, sf):
    return M.confusion(predictions(spark, sf), KEYS)


@query("precision_recall_f1", PR + ", " + _CNT + f" SELECT run, classifier, variant, {_RATES} FROM cm")
def _(spark, sf):
    return rounded(M.precision_recall_f1(predictions(spark, sf), KEYS), "precision", "recall", "f1", "accuracy", "balanced_accuracy")


@query("class_report", PR + ", " + _CNT + """ SELECT run, classifier, variant, 0 AS class, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, tp + fn AS support FROM cm UNION ALL
SELECT run, classifier, variant, 1, round(coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0), 6), round(coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0), 6), round(coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0), 6), tn + fp FROM cm""")
def _(spark, sf):
    return rounded(M.report(predictions(spark, sf), KEYS), "precision", "recall", "f1")


@query("log_loss", PR + " SELECT run, classifier, variant, round(avg(-ln(least(greatest(CASE y_true WHEN 0 THEN p0 ELSE 1 - p0 END, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM pred GROUP BY ALL")
def _(spark, sf):
    return rounded(M.log_loss(predictions(spark, sf), KEYS), "log_loss")


@query("roc_auc", PR + """, k AS (SELECT *, rank() OVER (PARTITION BY run, classifier, variant ORDER BY p0) + (count(*) OVER (PARTITION BY run, classifier, variant, p0) - 1) / 2.0::DOUBLE AS r FROM pred)
SELECT run, classifier, variant, round((sum(r) FILTER (y_true = 0) - count(*) FILTER (y_true = 0) * (count(*) FILTER (y_true = 0) + 1) / 2.0::DOUBLE)
/ nullif(count(*) FILTER (y_true = 0)::DOUBLE * count(*) FILTER (y_true = 1), 0), 6) AS roc_auc FROM k GROUP BY ALL""")
def _(spark, sf):
    return rounded(M.roc_auc(predictions(spark, sf), KEYS), "roc_auc")


@query("average_precision", PR + """, g AS (SELECT run, classifier, variant, p0, count(*) FILTER (y_true = 0) AS p, count(*) AS n FROM pred GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (PARTITION BY run, classifier, variant ORDER BY p0 DESC RANGE UNBOUNDED PRECEDING))
SELECT run, classifier, variant, round(sum(p::DOUBLE * tp / k) / nullif(sum(p), 0), 6) AS average_precision FROM c GROUP BY ALL""")
def _(spark, sf):
    return rounded(M.average_precision(predictions(spark, sf), KEYS), "average_precision")


_SWEEP = """th AS (SELECT run, classifier, variant, t / {n}.0::DOUBLE AS threshold, count(*) FILTER (y_true = 0 AND p0 >= t / {n}.0::DOUBLE) AS tp, count(*) FILTER (y_true = 0 AND p0 < t / {n}.0::DOUBLE) AS fn,
count(*) FILTER (y_true = 1 AND p0 >= t / {n}.0::DOUBLE) AS fp, count(*) FILTER (y_true = 1 AND p0 < t / {n}.0::DOUBLE) AS tn FROM pred, range({lo}, {hi}) g(t) GROUP BY ALL),
sc AS (SELECT run, classifier, variant, threshold, {metric} AS m FROM th),
bt AS (SELECT *, row_number() OVER (PARTITION BY run, classifier, variant ORDER BY round(m, 12) DESC, threshold) AS r FROM sc)
SELECT run, classifier, variant, threshold, round(m, 6) AS {name} FROM bt WHERE r = 1"""


@query("threshold_f1", PR + ", " + _SWEEP.format(n=100, lo=1, hi=100, metric="coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)", name="f1"))
def _(spark, sf):
    return rounded(M.best_threshold(predictions(spark, sf), KEYS), "f1")


@query("threshold_balanced_accuracy", PR + ", " + _SWEEP.format(n=1000, lo=0, hi=1001, metric="(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2", name="balanced_accuracy"))
def _(spark, sf):
    return rounded(M.best_threshold(predictions(spark, sf), KEYS, "balanced_accuracy", 1000, True), "balanced_accuracy")


# -- names and result documents ----------------------------------------------

_NAMES = [
    "20240101_LR_base93+I3+0Spectral+0Prox_edgesVar_25_splitseed3_random_val20_test20.json",
    "20240101_XGB_base93+noInd+1Spectral+0Prox_random_splitseed4__bundle.json",
    "20240101_RF_base93+I1+I2+0Spectral_edgesVar_50_splitseed10_random.json",
    "20240101_NB_other_random.json", "short.json", "a_b_base93+x__bundle",
]


def _named(spark):
    return spark.createDataFrame(list(enumerate(_NAMES)), "k int, name string")


_NAMES_SQL = "WITH nm AS (SELECT CAST(unnest(range(6)) AS INTEGER) AS k, unnest(" + repr(_NAMES) + ") AS name)"


@query("tag_parse", _NAMES_SQL + r""", s AS (SELECT k, regexp_replace(name, '\.[^.]*$', '') AS n FROM nm) SELECT k, CASE WHEN len(string_split(n, '_')) >= 3 THEN string_split(n, '_')[2] END AS classifier,
nullif(regexp_extract(n, 'base\d+\+([^_]+)[^+]*?_random', 1), '') AS variant FROM s""")
def _(spark, sf):
    return _named(spark).select("k", C.classifier_of(F.col("name")).alias("classifier"), C.variant_of(F.col("name")).alias("variant"))


@query("edge_tag", _NAMES_SQL + r""" SELECT k, nullif(regexp_extract(name, '_edgesVar_([^_]+)_splitseed(\d+)_random', 1), '') AS edge_variant, CAST(nullif(regexp_extract(name, '_edgesVar_([^_]+)_splitseed(\d+)_random', 2), '') AS INTEGER) AS seed FROM nm""")
def _(spark, sf):
    v, s = C.edge_tag(F.col("name"))
    return _named(spark).select("k", v.alias("edge_variant"), s.alias("seed"))


@query("base_block", _NAMES_SQL + """, r AS (SELECT k, name, substr(name, instr(name, 'base93')) AS t FROM nm) SELECT k, CASE WHEN instr(name, 'base93') > 0 THEN CASE WHEN instr(t, '_edgesVar_') > 0 THEN substr(t, 1, instr(t, '_edgesVar_') - 1)
WHEN instr(t, '_random') > 0 THEN substr(t, 1, instr(t, '_random') - 1) WHEN instr(t, '__bundle') > 0 THEN substr(t, 1, instr(t, '__bundle') - 1) ELSE t END END AS block FROM r""")
def _(spark, sf):
    return _named(spark).select("k", C.base_block(F.col("name")).alias("block"))


@query("best_params_join", "SELECT o_orderkey, 'base93+' || o_orderstatus AS base_block, 'C=' || o_orderstatus AS params FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.lit("LR").alias("model"), F.concat(F.lit("base93+"), "o_orderstatus").alias("base_block"))
    p = table(spark, sf, "orders").select(F.lit("LR").alias("model"), F.concat(F.lit("base93+"), "o_orderstatus").alias("base_block"), F.concat(F.lit("C="), "o_orderstatus").alias("params")).distinct()
    return FE.match_baseline(o, p).select("o_orderkey", "base_block", "params")


@query("metric_extract_json", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value + 1 WHEN 2 THEN value END AS f1, CASE event_id % 4 WHEN 3 THEN value END AS ll FROM events""")
def _(spark, sf):
    v, k = F.col("value").cast("string"), F.col("event_id") % 4
    doc = F.when(k == 0, F.concat(F.lit('{"test_metrics": {"f1_fraud": '), v, F.lit("}}"))).when(k == 1, F.concat(F.lit('{"final_test_metrics": {"at_tau_star": {"f1_score": '), (F.col("value") + 1).cast("string"), F.lit("}}}"))).when(k == 2, F.concat(F.lit('{"a": [{"b": {"f1": '), v, F.lit("}}]}"))).otherwise(F.concat(F.lit('{"metrics_test": {"log_loss": "'), v, F.lit('"}}')))
    return table(spark, sf, "events").select("event_id", A.extract_metric(doc, "f1_fraud").alias("f1"), A.extract_metric(doc, "logloss").alias("ll"))


# -- statistics over runs -----------------------------------------------------


def _values(spark, sf):
    return M.precision_recall_f1(predictions(spark, sf), KEYS).select(*KEYS, F.round("f1", 6).alias("value"))


VAL = PR + ", " + _CNT + ", vl AS (SELECT run, classifier, variant, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS value FROM cm)"
TRIM = VAL + """, tr AS (SELECT *, row_number() OVER (PARTITION BY classifier, variant ORDER BY value) AS lo, row_number() OVER (PARTITION BY classifier, variant ORDER BY value DESC) AS hi, count(*) OVER (PARTITION BY classifier, variant) AS n FROM vl),
st AS (SELECT classifier, variant, any_value(n) AS n, avg(value) AS mean, CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(value) END AS std FROM
(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY classifier, variant ORDER BY value, run) AS a, row_number() OVER (PARTITION BY classifier, variant ORDER BY value DESC, run DESC) AS b FROM tr) WHERE n < 3 OR (a > 1 AND b > 1)) GROUP BY classifier, variant)"""


def _stats(spark, sf):
    return A.trimmed(_values(spark, sf), ["classifier", "variant"])


@query("trimmed_mean_std", TRIM + " SELECT classifier, variant, n, round(mean, 9) AS mean, round(std, 9) AS std FROM st")
def _(spark, sf):
    return rounded(_stats(spark, sf), "mean", "std", digits=9)


@query("wins_vs_base", VAL + """, b AS (SELECT run, classifier, value AS base FROM vl WHERE variant = 'base') SELECT classifier, variant, sum(CASE WHEN variant = 'base' THEN 0 ELSE CAST(value > base AS INTEGER) END)::BIGINT AS wins FROM vl JOIN b USING (run, classifier) GROUP BY ALL""")
def _(spark, sf):
    return A.wins(_values(spark, sf), "base")


@query("metric_pivot", TRIM + " SELECT classifier, " + ", ".join(f"round(max(mean) FILTER (variant = '{v}'), 9) AS {v}" for v in ("base", "degree", "pagerank", "core", "spectral")) + " FROM st GROUP BY classifier")
def _(spark, sf):
    v = ["base", "degree", "pagerank", "core", "spectral"]
    return rounded(A.matrix(_stats(spark, sf), v), *v, digits=9)


_TOP = ", t5 AS (SELECT classifier, mean AS base FROM st WHERE variant = 'base' ORDER BY mean DESC, classifier LIMIT 5)"


@query("avg_topk_delta", TRIM + _TOP + " SELECT variant, round(avg(mean), 9) AS avg, round(avg(mean - base), 9) + 0.0 AS delta FROM st JOIN t5 USING (classifier) GROUP BY variant")
def _(spark, sf):
    return rounded(A.top_average(_stats(spark, sf), "base"), "avg", "delta", digits=9)


@query("color_code", TRIM + """, d AS (SELECT s.classifier, s.variant, s.mean - b.mean AS delta FROM st s LEFT JOIN (SELECT * FROM st WHERE variant = 'base') b USING (classifier))
SELECT classifier, variant, round(delta, 9) + 0.0 AS delta, CASE WHEN variant = 'base' THEN 0 WHEN delta >= 0 THEN 1 ELSE 2 END AS code, round(0.2 + 1.1 * pow(abs(delta) / (SELECT max(abs(delta)) FROM d), 0.7), 6) AS intensity FROM d""")
def _(spark, sf):
    return rounded(rounded(A.color_code(_stats(spark, sf), "base").select("classifier", "variant", "delta", "code", "intensity"), "delta", digits=9), "intensity")


MC = PR + """, bp AS (SELECT run, classifier, tx_id, y_pred AS bp FROM pred WHERE variant = 'base'),
mc AS (SELECT run, classifier, variant, count(*) FILTER (bp = y_true AND y_pred <> y_true) AS n01, count(*) FILTER (bp <> y_true AND y_pred = y_true) AS n10 FROM pred JOIN bp USING (run, classifier, tx_id) WHERE variant <> 'base' GROUP BY ALL),
mt AS (SELECT *, pow(abs(n01 - n10) - 1, 2) / nullif(n01 + n10, 0)::DOUBLE AS chi2, CAST(sign(n10 - n01) AS INTEGER) AS direction FROM mc),
ms AS (SELECT *, coalesce(chi2 >= 3.841458820694124, true) AS significant FROM mt),
sc AS (SELECT classifier, variant, count(*) AS available, count(*) FILTER (significant AND direction = 1) AS better, count(*) FILTER (significant AND direction = -1) AS worse FROM ms GROUP BY ALL)"""


def _tests(spark, sf):
    return A.mcnemar(predictions(spark, sf), "base")


@query("mcnemar_counts", MC + " SELECT run, classifier, variant, n01, n10, round(chi2, 6) AS chi2, direction, significant FROM ms")
def _(spark, sf):
    return rounded(_tests(spark, sf), "chi2")


@query("mcnemar_p_values")
def _(spark, sf):
    return A.p_values(_tests(spark, sf))


@query("mcnemar_sig_counts", MC + " SELECT * FROM sc")
def _(spark, sf):
    return A.significance_counts(_tests(spark, sf))


@query("mcnemar_sum_row", MC + " SELECT classifier, variant, available, better, worse, better - worse AS net FROM sc UNION ALL SELECT 'Σ', variant, sum(available)::BIGINT, sum(better)::BIGINT, sum(worse)::BIGINT, (sum(better) - sum(worse))::BIGINT FROM sc GROUP BY variant")
def _(spark, sf):
    return A.with_sums(A.significance_counts(_tests(spark, sf)))


@query("mcnemar_cell_summary", MC + """, k AS (SELECT count(*) AS cells, count(*) FILTER (better > worse) AS improved, count(*) FILTER (better < worse) AS worsened, count(*) FILTER (better = worse AND better > 0) AS equal, count(*) FILTER (better = 0 AND worse = 0) AS "none" FROM sc)
SELECT *, round(improved * 100.0::DOUBLE / cells, 6) AS improved_pct, round(worsened * 100.0::DOUBLE / cells, 6) AS worsened_pct, round(equal * 100.0::DOUBLE / cells, 6) AS equal_pct, round("none" * 100.0::DOUBLE / cells, 6) AS none_pct FROM k""")
def _(spark, sf):
    out = A.cell_summary(A.significance_counts(_tests(spark, sf)))
    pct = [c for c in out.columns if c.endswith("_pct")]
    return rounded(out.withColumns({c: F.col(c).cast("double") for c in pct}), *pct)


@query("mcnemar_perfect", MC + " SELECT variant, count(*) FILTER (better = 10) AS perfect FROM sc GROUP BY variant")
def _(spark, sf):
    return A.perfect(A.significance_counts(_tests(spark, sf)))


@query("mcnemar_extremes", MC + """, n AS (SELECT variant, sum(better - worse)::BIGINT AS net FROM sc GROUP BY variant), t AS (SELECT *, 'top' AS side FROM n ORDER BY net DESC, variant LIMIT 2), b AS (SELECT *, 'bottom' AS side FROM n ORDER BY net, variant LIMIT 2) SELECT * FROM t UNION ALL SELECT * FROM b""")
def _(spark, sf):
    return A.extremes(A.significance_counts(_tests(spark, sf)), 2)


def _rated(spark, sf):
    """Means per edge-removal rate; three groups of runs stand for three rates."""
    v = _values(spark, sf).withColumn("rate", F.pmod("run", F.lit(3)) * 25)
    return v.groupBy("rate", "classifier", "variant").agg(F.avg("value").alias("mean"))


RATED = VAL + ", rt AS (SELECT run % 3 * 25 AS rate, classifier, variant, avg(value) AS mean FROM vl GROUP BY ALL)"


@query("delta_by_removal_rate", RATED + " SELECT a.rate, a.classifier, a.variant, round(a.mean - b.mean, 9) + 0.0 AS delta FROM rt a JOIN rt b ON a.rate = b.rate AND a.classifier = b.classifier AND b.variant = 'base' WHERE a.variant <> 'base'")
def _(spark, sf):
    return rounded(A.delta_by_rate(_rated(spark, sf), "base"), "delta", digits=9)


@query("delta_topk_by_rate", RATED + """, t AS (SELECT rate, classifier, mean AS base FROM (SELECT *, row_number() OVER (PARTITION BY rate ORDER BY mean DESC, classifier) AS r FROM rt WHERE variant = 'base') WHERE r <= 5)
SELECT rate, variant, round(avg(mean) - avg(base), 9) + 0.0 AS delta FROM rt JOIN t USING (rate, classifier) WHERE variant <> 'base' GROUP BY rate, variant""")
def _(spark, sf):
    return rounded(A.delta_topk(_rated(spark, sf), "base"), "delta", digits=9)


@query("category_mean_delta", TRIM + ", m AS (SELECT variant, avg(mean) AS m FROM st WHERE classifier <> 'NB' GROUP BY variant) SELECT variant, round(m - (SELECT m FROM m WHERE variant = 'base'), 9) + 0.0 AS delta FROM m WHERE variant <> 'base'")
def _(spark, sf):
    return rounded(A.mean_delta(_stats(spark, sf), "base"), "delta", digits=9)


@query("category_max_f1", TRIM + """, k AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY mean DESC, classifier DESC) AS r FROM st) SELECT variant, classifier, round(mean, 9) AS best, round(mean - (SELECT max(mean) FROM st WHERE variant = 'base'), 9) + 0.0 AS delta FROM k WHERE r = 1""")
def _(spark, sf):
    return rounded(A.best_per_variant(_stats(spark, sf), "base"), "best", "delta", digits=9)


@query("importance_rank", "SELECT event_type, user_id, round(sum(value), 6) AS importance, row_number() OVER (PARTITION BY event_type ORDER BY round(sum(value), 6) DESC, user_id) AS rank FROM events GROUP BY event_type, user_id")
def _(spark, sf):
    t = rounded(table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("importance")), "importance")
    return A.importance_rank(t, ["event_type"], "importance", "user_id").withColumn("rank", F.col("rank").cast("long"))


# -- node indicators ----------------------------------------------------------


@query("degree_centrality", E + " SELECT id, round(d::DOUBLE / ((SELECT count(*) FROM deg) - 1), 9) AS gi_degree_centrality FROM deg")
def _(spark, sf):
    return rounded(I.degree_centrality(_u(spark, sf)), "gi_degree_centrality", digits=9)


@query("in_out_degree", E + " SELECT id, sum(i)::BIGINT AS gi_in_degree, sum(o)::BIGINT AS gi_out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id")
def _(spark, sf):
    return I.in_out_degree(tx_edges(spark, sf))


TRI = E + """, tri AS (SELECT a.src AS a, a.dst AS b, b.dst AS c FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND b.src < b.dst),
tn AS (SELECT id, count(*) AS t FROM (SELECT unnest([a, b, c]) AS id FROM tri) GROUP BY id)"""


@query("triangles", TRI + " SELECT id, coalesce(t, 0) AS gi_triangles FROM deg LEFT JOIN tn USING (id)")
def _(spark, sf):
    return I.triangles(_u(spark, sf))


@query("clustering", TRI + " SELECT id, round(CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6) AS gi_clustering_coefficient FROM deg LEFT JOIN tn USING (id)")
def _(spark, sf):
    return rounded(I.clustering(_u(spark, sf)), "gi_clustering_coefficient")


@query("square_clustering", E + """, pr AS (SELECT a.src AS v, a.dst AS x, b.dst AS y FROM u a JOIN u b ON a.src = b.src AND a.dst < b.dst),
cm AS (SELECT p.v, p.x, p.y, (SELECT count(*) FROM u a JOIN u b ON a.dst = b.dst WHERE a.src = p.x AND b.src = p.y) - 1 AS s FROM pr p),
pt AS (SELECT v, s, s + dx.d - (s + 1 + CAST(t.src IS NOT NULL AS INTEGER)) + dy.d - (s + 1 + CAST(t.src IS NOT NULL AS INTEGER)) AS p FROM cm JOIN deg dx ON dx.id = x JOIN deg dy ON dy.id = y LEFT JOIN u t ON t.src = x AND t.dst = y)
SELECT id, round(coalesce(sum(s)::DOUBLE / nullif(sum(p), 0), 0), 6) AS gi_square_clustering FROM deg LEFT JOIN pt ON pt.v = id GROUP BY id""")
def _(spark, sf):
    return rounded(I.square_clustering(_u(spark, sf)), "gi_square_clustering")


def _core_sql(rounds: int = 100) -> str:
    """h-index rounds; a long chain of nodes settles one node a round."""
    step = "SELECT h.i, u.src, h.x, row_number() OVER (PARTITION BY u.src ORDER BY h.x DESC) AS r FROM u JOIN h ON h.id = u.dst"
    return E.replace("WITH", "WITH RECURSIVE", 1) + f""", h(i, id, x) AS (SELECT 0, id, d FROM deg UNION ALL
        SELECT i + 1, src, max(least(x, r)) FROM ({step} WHERE h.i < {rounds}) GROUP BY i, src)
    SELECT id, x AS gi_core_number FROM h WHERE i = {rounds}"""


@query("core_number", _core_sql())
def _(spark, sf):
    return I.core_number(_u(spark, sf))


def _wl_sql(rounds: int = 3) -> str:
    out = E + ", w0 AS (SELECT id, CAST(d AS VARCHAR) AS label FROM deg)"
    for k in range(rounds):
        out += f""", w{k + 1} AS (SELECT w.id, substr(md5(any_value(w.label) || '|' || string_agg(n.label, ',' ORDER BY n.label)), 1, 8) AS label FROM w{k} w JOIN u ON u.src = w.id JOIN w{k} n ON n.id = u.dst GROUP BY w.id)"""
    return out + f" SELECT id, label FROM w{rounds}"


@query("wl_labels", _wl_sql())
def _(spark, sf):
    return I.wl_labels(_u(spark, sf))


def _pr_sql(rounds: int = 20) -> str:
    out = E + ", os AS (SELECT src AS id, count(*) AS o FROM e GROUP BY src), nn AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS (SELECT id, o, 1 / n AS x FROM v LEFT JOIN os USING (id), nn)"
    for k in range(rounds):
        out += f""", r{k + 1} AS (SELECT r.id, r.o, 0.85::DOUBLE * (coalesce(f.f, 0) + (SELECT coalesce(sum(x), 0) FROM r{k} WHERE o IS NULL) / n) + 0.15::DOUBLE / n AS x FROM r{k} r LEFT JOIN (SELECT e.dst AS id, sum(x / o) AS f FROM e JOIN r{k} q ON q.id = e.src GROUP BY e.dst) f USING (id), nn)"""
    return out + f" SELECT id, round(x, 9) AS gi_pagerank FROM r{rounds}"


@query("pagerank_20", _pr_sql())
def _(spark, sf):
    return rounded(I.pagerank(tx_edges(spark, sf), fixed_iters=20), "gi_pagerank", digits=9)


_PR_ALL = E.replace("WITH ", "WITH RECURSIVE ", 1) + """, os AS (SELECT src AS id, count(*) AS o FROM e GROUP BY src), nn AS (SELECT count(*)::DOUBLE AS n FROM v),
r(i, id, o, x, y) AS (SELECT 0, id, o, 1 / n, NULL::DOUBLE FROM v LEFT JOIN os USING (id), nn
UNION ALL SELECT r.i + 1, r.id, r.o, 0.85::DOUBLE * (coalesce(f.f, 0) + (SELECT coalesce(sum(x), 0) FROM r WHERE o IS NULL) / n) + 0.15::DOUBLE / n, r.x
FROM r LEFT JOIN (SELECT e.dst AS id, sum(x / o) AS f FROM e JOIN r q ON q.id = e.src GROUP BY e.dst) f USING (id), nn WHERE r.i < 100),
t AS (SELECT i FROM r, nn WHERE y IS NOT NULL GROUP BY i, n HAVING sum(abs(x - y)) < n * 1e-8)
SELECT id, round(x, 9) AS gi_pagerank FROM r WHERE i = (SELECT coalesce(min(i), 100) FROM t)"""


@query("pagerank_converged", _PR_ALL)
def _(spark, sf):
    return rounded(I.pagerank(tx_edges(spark, sf)), "gi_pagerank", digits=9)


@query("laplacian_weights", E + " SELECT src AS i, dst AS j, round(-1 / sqrt(a.d * b.d), 6) AS value FROM u JOIN deg a ON a.id = src JOIN deg b ON b.id = dst UNION ALL SELECT id, id, 1.0 FROM deg")
def _(spark, sf):
    return rounded(I.laplacian(_u(spark, sf)), "value")


BFS = E + """, b0 AS (SELECT id AS root, id, 0 AS layer FROM v), b1 AS (SELECT src AS root, dst AS id, 1 AS layer FROM u),
b2 AS (SELECT DISTINCT b1.root, u.dst AS id, 2 AS layer FROM b1 JOIN u ON u.src = b1.id WHERE u.dst <> b1.root AND NOT EXISTS (FROM u x WHERE x.src = b1.root AND x.dst = u.dst)),
bl AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2)"""


@query("bfs_layers_2", BFS + " SELECT root, id, layer FROM bl")
def _(spark, sf):
    return I.bfs_layers(_u(spark, sf), G.nodes(tx_edges(spark, sf)), 2)


# -- structural identity ------------------------------------------------------


@query("degree_histograms", BFS + " SELECT root, layer, d AS degree, count(*) AS freq FROM bl JOIN deg USING (id) GROUP BY ALL")
def _(spark, sf):
    return ST.degree_histograms(_u(spark, sf))


@query("degree_buckets", E + ", p AS (SELECT d AS degree, count(*) AS n FROM deg GROUP BY d) SELECT degree, n, lag(degree) OVER (ORDER BY degree) AS before, lead(degree) OVER (ORDER BY degree) AS after FROM p")
def _(spark, sf):
    return ST.degree_buckets(_u(spark, sf))


CAND = E + """, kk AS (SELECT CAST(floor(2 * log2(count(*))) AS BIGINT) + 1 AS k FROM deg), ps AS (SELECT id, d, row_number() OVER (PARTITION BY d ORDER BY id) AS at FROM deg),
cd AS (SELECT v, n, rank FROM (SELECT a.id AS v, b.id AS n, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.d - a.d), b.d DESC, b.at) AS rank FROM deg a JOIN ps b ON a.id <> b.id AND b.at <= (SELECT k FROM kk) + 1), kk WHERE rank <= k)"""


@query("nearest_degree_candidates", CAND + " SELECT v, n, rank FROM cd")
def _(spark, sf):
    return ST.candidates(_u(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


MOM = BFS + ", mo AS (SELECT root AS id, layer, avg(d) AS mean, median(d) AS median, stddev_pop(d) AS std FROM bl JOIN deg USING (id) GROUP BY root, layer)"
_COST = lambda a, b: f"(greatest({a}, {b}) + 0.5) / (least({a}, {b}) + 0.5) - 1"


@query("layer_moments", MOM + " SELECT id, layer, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std FROM mo")
def _(spark, sf):
    return rounded(ST.layer_moments(_u(spark, sf)), "mean", "median", "std")


@query("pair_cost", E + f""" SELECT src, dst, round({_COST('a.d::DOUBLE', 'b.d::DOUBLE')}, 6) AS ratio, abs(a.d - b.d) AS gap FROM u JOIN deg a ON a.id = src JOIN deg b ON b.id = dst""")
def _(spark, sf):
    d = G.degrees(_u(spark, sf))
    t = _u(spark, sf).join(d.toDF("src", "a"), "src").join(d.toDF("dst", "b"), "dst")
    return rounded(t.select("src", "dst", ST.cost(F.col("a"), F.col("b")).alias("ratio"), ST.cost_abs(F.col("a"), F.col("b")).alias("gap")), "ratio")


# pairs: the edges themselves, in string order
DIST = MOM + f""", pr AS (SELECT src AS v, dst AS n FROM u WHERE src < dst),
ds AS (SELECT v, n, a.layer AS layer, 0.5 * ({_COST('a.std', 'b.std')}) + 0.5 * ({_COST('a.mean', 'b.mean')}) AS d FROM pr JOIN mo a ON a.id = v JOIN mo b ON b.id = n AND b.layer = a.layer),
cu AS (SELECT v, n, layer, sum(d) OVER (PARTITION BY v, n ORDER BY layer ROWS UNBOUNDED PRECEDING) AS d FROM ds),
bo AS (SELECT layer, v, n, d FROM cu UNION ALL SELECT layer, n, v, d FROM cu),
lw AS (SELECT layer, v, n, exp(-d) / sum(exp(-d)) OVER (PARTITION BY layer, v) AS w FROM bo)"""


def _dist(spark, sf):
    u = _u(spark, sf)
    return ST.moment_distances(u.filter("src < dst").toDF("v", "n"), ST.layer_moments(u))


@query("layer_mean_var_distance", DIST + " SELECT v, n, layer, round(d, 6) + 0.0 AS d FROM ds")
def _(spark, sf):
    return rounded(_dist(spark, sf), "d")


@query("layer_prefix_distance", DIST + " SELECT v, n, layer, round(d, 6) + 0.0 AS d FROM cu")
def _(spark, sf):
    return rounded(ST.cumulate(_dist(spark, sf)), "d")


@query("layer_weights", DIST + " SELECT layer, v, n, round(w, 6) + 0.0 AS w FROM lw")
def _(spark, sf):
    return rounded(ST.layer_weights(ST.regroup(ST.cumulate(_dist(spark, sf)))), "w")


@query("flattened_weights", DIST + " SELECT v, n, round(sum(w), 6) + 0.0 AS w FROM lw WHERE (v, n) IN (SELECT (v, n) FROM lw WHERE layer = 0) GROUP BY v, n")
def _(spark, sf):
    return rounded(ST.flatten(ST.layer_weights(ST.regroup(ST.cumulate(_dist(spark, sf))))), "w")


@query("walk_parameters", DIST + ", av AS (SELECT layer, avg(w) AS a FROM lw GROUP BY layer) SELECT layer, round(a, 6) AS average, v, count(*) FILTER (w > a + 1e-12) AS above FROM lw JOIN av USING (layer) GROUP BY layer, a, v")
def _(spark, sf):
    return rounded(ST.walk_parameters(ST.layer_weights(ST.regroup(ST.cumulate(_dist(spark, sf))))), "average")
