"""Edge lists as DataFrames ``src, dst`` of strings: construction, set operations, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.functions.columns import canonical
from txloom.functions.storage import content_mark, dense_index, drop, hash_key, hash_rank, join_hot, materialize


def edges(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Directed simple edges: ids as strings, parallel edges once; edges without both ends are no edges."""
    return df.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst")).dropna().distinct()


def without_loops(e: DataFrame) -> DataFrame:
    return e.filter("src <> dst")


def symmetric(e: DataFrame) -> DataFrame:
    """Both directions of every edge, each once."""
    return e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def with_loops(e: DataFrame) -> DataFrame:
    """``e`` plus a self-loop at every node of an edge."""
    return e.unionByName(nodes(e).select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()


def nodes(e: DataFrame) -> DataFrame:
    """``id`` of every end of an edge."""
    return e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def canonical_edges(e: DataFrame) -> DataFrame:
    a, b = canonical(F.col("src"), F.col("dst"))
    return e.select(a.alias("src"), b.alias("dst")).distinct()


def content_hash(e: DataFrame) -> DataFrame:
    """One row ``graph_hash, n_edges``: 16 hex digits that do not depend on row order.

    Edge hashes are combined by count and exclusive or, which aggregate partially.
    """
    h = F.md5(F.concat_ws(",", "src", "dst"))
    part = lambda at: F.bit_xor(F.conv(F.substring(h, at, 15), 16, 10).cast("long"))
    agg = canonical_edges(e).agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(part(1), F.lit(0)).alias("x"), F.coalesce(part(16), F.lit(0)).alias("y"))
    return agg.select(F.substring(F.md5(F.concat_ws("|", "n_edges", "x", "y")), 1, 16).alias("graph_hash"), "n_edges")


def induced(e: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Edges whose two ends are in ``ids``."""
    keep = ids.select(F.col(key).alias("_k")).distinct()
    return e.join(keep, e.src == keep._k, "left_semi").join(keep, F.col("dst") == F.col("_k"), "left_semi")


def degrees(u: DataFrame) -> DataFrame:
    """``id, d`` of a symmetric edge table."""
    return u.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))


def adjacency(u: DataFrame) -> DataFrame:
    """``id, neighbours`` with neighbours sorted as strings."""
    return u.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def node_index(e: DataFrame) -> DataFrame:
    """``node_idx, id``: nodes numbered from 0 in the order of their ids as strings."""
    return dense_index(nodes(e), "id", "node_idx").select("node_idx", "id")


def has_edge(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(src, dst)`` that are edges."""
    return pairs.join(e, ["src", "dst"], "left_semi")


def subsample(e: DataFrame, drop_share: float, seed: int = 42) -> DataFrame:
    """Exactly ``round((1 - drop_share) · n)`` edges, those first by hash.

    Rounding is half to even; the choice depends on the seed and the edges only.
    """
    keep = round((1 - drop_share) * e.count())
    ranked = hash_rank(e.withColumn("_key", hash_key(seed, "src", "dst")), [], "_key", "_rank")
    return ranked.filter(F.col("_rank") <= keep).select("src", "dst")


def clique(spark: SparkSession, n: int) -> DataFrame:
    """Complete graph on 0 … n-1, each edge once."""
    a = spark.range(n)
    return a.select(F.col("id").cast("string").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.greatest(F.col("id") + 1, F.lit(n)))).alias("dst")).filter(F.col("dst") < n).withColumn("dst", F.col("dst").cast("string"))


def stats(e: DataFrame, labels: DataFrame | None = None, isolated_degree: int = 2) -> DataFrame:
    """One row: nodes, edges, density, nodes of degree up to ``isolated_degree``, largest degree.

    With ``labels(id, label)`` also the shares of the classes 0 and 1 among the graph's
    nodes of these classes.
    """
    u = symmetric(without_loops(e))
    d = degrees(u)
    row = d.agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("d") / 2).cast("long").alias("n_edges"), F.count_if(F.col("d") <= isolated_degree).alias("n_near_isolated"), F.max("d").alias("max_degree"))
    row = row.withColumn("density", F.round(F.col("n_edges") * 2.0 / (F.col("n_nodes").cast("double") * (F.col("n_nodes") - 1)), 9))
    if labels is None:
        return row
    share = lambda k: F.round(F.count_if(F.col("label") == k) / F.nullif(F.count_if(F.col("label").isin(0, 1)), F.lit(0)), 9).alias(f"share_{k}")
    return row.crossJoin(F.broadcast(labels.join(d, "id", "left_semi").agg(share(0), share(1))))  # one row


def star_components(es: DataFrame) -> DataFrame:
    """``a, b``: every node of ``es(a, b)`` but the smallest of its component, and that smallest one.

    Alternating large-star and small-star rounds until one changes nothing; each round's
    edges are written to the shared folder and the previous ones deleted.  Joins to a
    star's centre are salted by its size, so a giant component meets many tasks.
    """
    es = materialize(es.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    mark = content_mark(es, "a", "b")
    while True:
        both, n = es.unionByName(es.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * mark[0]
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_hot(both, low, "a", "n", n, F.xxhash64("b")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, low, "a", "n", n, F.xxhash64("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = materialize(small, "stars")
        drop(es)
        es, before = new, mark
        mark = content_mark(es, "a", "b")
        if mark == before:
            return es


def components(u: DataFrame) -> DataFrame:
    """``id, comp`` with the smallest id of each component, over symmetric edges."""
    es = star_components(u.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes(u).join(es.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("comp"))
