"""Flattened structural-identity similarity: layer histograms, candidates, distances, weights, walks.

All tables are long: histograms ``root, layer, degree, freq``; pairs ``v, n, layer, d``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txloom.operators.graph import degrees
from txloom.operators.indicators import bfs_layers

#: Added to both sides of a ratio.
EPS = 0.5
#: Rounding error of an average weight.
ABOVE = 1e-12


def degree_lists(u: DataFrame, until_layer: int = 2, feature: DataFrame | None = None) -> DataFrame:
    """``root, layer, values``: sorted feature values (degrees by default) of the nodes at each hop."""
    value = feature if feature is not None else degrees(u)
    value = value.toDF("id", "value")
    seen = bfs_layers(u, degrees(u).select("id"), until_layer)
    return seen.join(value, "id").groupBy("root", "layer").agg(F.sort_array(F.collect_list("value")).alias("values"))


def degree_histograms(u: DataFrame, until_layer: int = 2) -> DataFrame:
    """``root, layer, degree, freq``: the compact form of :func:`degree_lists`."""
    seen = bfs_layers(u, degrees(u).select("id"), until_layer)
    return seen.join(degrees(u), "id").groupBy("root", "layer", F.col("d").alias("degree")).agg(F.count(F.lit(1)).alias("freq"))


def degree_buckets(u: DataFrame) -> DataFrame:
    """``degree, n, before, after``: occupied degrees with their neighbours in order (one row a degree)."""
    per = degrees(u).groupBy(F.col("d").alias("degree")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("degree")
    return per.select("degree", "n", F.lag("degree").over(w).alias("before"), F.lead("degree").over(w).alias("after"))


def candidate_count(n: int) -> int:
    """Candidates of a vertex among n."""
    return int(2 * math.log2(n)) + 1 if n > 1 else 0


def candidates(u: DataFrame) -> DataFrame:
    """``v, n, rank``: for every vertex the ``⌊2·log2 N⌋ + 1`` others closest in degree.

    Own degree first, then alternately the closer of the next lower and higher
    degree (higher at a tie); ids in order inside a degree.  Only the first vertices
    of a degree can be chosen, and only degrees near enough are joined: those whose
    nearer vertices do not already suffice.
    """
    d = degrees(u)
    k = candidate_count(d.count())
    per = d.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    a, b = per.select(F.col("d").alias("dv"), F.col("n").alias("own")), per.select(F.col("d").alias("dn"), "n")
    # degrees in order of closeness to each degree: a row a pair of occupied degrees
    near = Window.partitionBy("dv").orderBy(F.abs(F.col("dn") - F.col("dv")), F.desc("dn")).rowsBetween(Window.unboundedPreceding, -1)
    usable = F.when(F.col("dn") == F.col("dv"), F.col("n") - 1).otherwise(F.col("n"))
    reach = a.crossJoin(b).withColumn("ahead", F.coalesce(F.sum(usable).over(near), F.lit(0))).filter(F.col("ahead") < k).select("dv", "dn", "ahead")
    first = d.withColumn("at", F.row_number().over(Window.partitionBy("d").orderBy("id"))).filter(F.col("at") <= k + 1).select(F.col("id").alias("n"), F.col("d").alias("dn"), "at")
    vs = d.select(F.col("id").alias("v"), F.col("d").alias("dv"))
    rows = vs.join(reach, "dv").join(first, "dn").filter("v <> n")
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.abs(F.col("dn") - F.col("dv")), F.desc("dn"), "at"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("v", "n", "rank")


def all_pairs(u: DataFrame) -> DataFrame:
    """``v, n`` with v < n of every pair of a small graph: N² / 2 rows by definition of the option."""
    d = degrees(u).select("id")
    return d.toDF("v").join(d.toDF("n"), F.col("v") < F.col("n"))


def cost(a: Column, b: Column) -> Column:
    """Ratio of larger to smaller, both raised by EPS, minus 1."""
    return (F.greatest(a, b) + EPS) / (F.least(a, b) + EPS) - 1


def cost_abs(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def cost_min(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """Ratio cost weighted by the smaller frequency."""
    return cost(a, b) * F.least(fa, fb)


def cost_max(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    return cost(a, b) * F.greatest(fa, fb)


def layer_moments(u: DataFrame, until_layer: int = 2) -> DataFrame:
    """``id, layer, mean, median, std`` (population) of the degrees at each hop."""
    seen = bfs_layers(u, degrees(u).select("id"), until_layer).join(degrees(u), "id")
    return seen.groupBy(F.col("root").alias("id"), "layer").agg(F.avg("d").alias("mean"), F.median("d").alias("median"), F.stddev_pop("d").alias("std"))


def moment_distances(pairs: DataFrame, moments: DataFrame, factor: float = 0.5, center: str = "mean", relative: bool = True) -> DataFrame:
    """``v, n, layer, d``: ``(1 - factor)`` cost of deviations plus ``factor`` cost of means (or medians).

    A pair has a distance at the layers that both vertices reach.
    """
    f = cost if relative else cost_abs
    a = moments.select(F.col("id").alias("v"), "layer", F.col("std").alias("sa"), F.col(center).alias("ca"))
    b = moments.select(F.col("id").alias("n"), "layer", F.col("std").alias("sb"), F.col(center).alias("cb"))
    d = (1 - factor) * f(F.col("sa"), F.col("sb")) + factor * f(F.col("ca"), F.col("cb"))
    return pairs.select("v", "n").join(a, "v").join(b, ["n", "layer"]).select("v", "n", "layer", d.alias("d"))


def dtw_distances(pairs: DataFrame, lists: DataFrame, compact: bool = True, largest: bool = True) -> DataFrame:
    """``v, n, layer, d``: dynamic time warping of the degree lists of both vertices, exact.

    ``compact`` warps (degree, frequency) pairs with frequency-weighted cost, the
    larger or the smaller frequency counting.
    """
    a = lists.select(F.col("root").alias("v"), "layer", F.col("values").alias("a"))
    b = lists.select(F.col("root").alias("n"), "layer", F.col("values").alias("b"))

    @F.pandas_udf("double")
    def warp(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([dtw(np.asarray(p, float), np.asarray(q, float), compact, largest) for p, q in zip(x, y, strict=True)])

    return pairs.select("v", "n").join(a, "v").join(b, ["n", "layer"]).select("v", "n", "layer", warp("a", "b").alias("d"))


def dtw(a: np.ndarray, b: np.ndarray, compact: bool = True, largest: bool = True) -> float:
    """Least total cost of warping one sorted list onto the other."""
    if compact:
        (a, fa), (b, fb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        weight = (np.maximum if largest else np.minimum)(fa[:, None], fb[None, :])
    else:
        weight = 1.0
    c = ((np.maximum(a[:, None], b[None, :]) + EPS) / (np.minimum(a[:, None], b[None, :]) + EPS) - 1) * weight
    row = np.cumsum(c[0])
    for i in range(1, len(a)):
        new = np.empty_like(row)
        new[0] = row[0] + c[i, 0]
        best = np.minimum(row[1:], row[:-1])
        for j in range(1, len(row)):
            new[j] = c[i, j] + min(best[j - 1], new[j - 1])
        row = new
    return float(row[-1])


def euclid_distances(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``v, n, layer, d``: distance of the mean vectors ``vectors(id, layer, mean array)``."""
    a = vectors.select(F.col("id").alias("v"), "layer", F.col("mean").alias("a"))
    b = vectors.select(F.col("id").alias("n"), "layer", F.col("mean").alias("b"))
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("v", "n").join(a, "v").join(b, ["n", "layer"]).select("v", "n", "layer", F.sqrt(gap).alias("d"))


def cumulate(d: DataFrame) -> DataFrame:
    """Distances summed over layers up to each one."""
    w = Window.partitionBy("v", "n").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("d", F.sum("d").over(w))


def regroup(d: DataFrame) -> DataFrame:
    """Both directions of every pair at every layer, duplicates kept."""
    return d.select("layer", "v", "n", "d").unionByName(d.select("layer", F.col("n").alias("v"), F.col("v").alias("n"), "d"))


def layer_weights(both: DataFrame, base: float = math.e, scale: DataFrame | None = None) -> DataFrame:
    """``layer, v, n, w``: ``base ** -d`` normalised over the neighbours of a vertex at a layer.

    With ``scale(id, value)``, PageRank for instance, a neighbour's weight is multiplied by
    its value first.
    """
    raw = both.withColumn("w", F.pow(F.lit(base), -F.col("d")))
    if scale is not None:
        raw = raw.join(scale.toDF("n", "_scale"), "n").withColumn("w", F.col("w") * F.col("_scale"))
    return raw.select("layer", "v", "n", (F.col("w") / F.sum("w").over(Window.partitionBy("layer", "v"))).alias("w"))


def flatten(w: DataFrame, factors: tuple[float, ...] = (1.0, 1.0, 1.0)) -> DataFrame:
    """``v, n, w``: weights of all layers added up with a factor each, over the neighbours of layer 0."""
    f = F.element_at(F.array(*map(F.lit, factors)), F.col("layer") + 1)
    first = w.filter("layer = 0").select("v", "n").distinct()
    every = w.filter(F.col("layer") < len(factors)).groupBy("v", "n").agg(F.sum(F.col("w") * f).alias("w"))
    return first.join(every, ["v", "n"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def walk_parameters(w: DataFrame) -> DataFrame:
    """``layer, average, v, above``: the average weight of a layer and how many neighbours of a vertex exceed it.

    Weights within ABOVE of the average are equal to it.
    """
    avg = w.groupBy("layer").agg(F.avg("w").alias("average"))
    return w.join(F.broadcast(avg), "layer").groupBy("layer", "average", "v").agg(F.count_if(F.col("w") > F.col("average") + ABOVE).alias("above"))


def embedding_graph(u: DataFrame, until_layer: int = 2, method: str = "dtw", factors: tuple[float, ...] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The flattened similarity graph ``v, n, w`` of a graph, from candidates to weights."""
    pairs = candidates(u).select(F.least("v", "n").alias("v"), F.greatest("v", "n").alias("n")).distinct()
    if method == "dtw":
        d = dtw_distances(pairs, degree_lists(u, until_layer))
    else:
        d = moment_distances(pairs, layer_moments(u, until_layer), center=method)
    return flatten(layer_weights(regroup(cumulate(d))), factors)


#: Largest exponent of a double.
LARGEST = 709.0


def softmax_weights(w: DataFrame, factor: float = 1.0) -> DataFrame:
    """``v, n, w``: the softmax of ``factor · w`` over the neighbours of a vertex; the factor is halved until no exponent overflows."""
    by = Window.partitionBy("v")
    halvings = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(factor) * F.max("w").over(by), F.lit(1e-300)) / LARGEST)))
    raw = w.select("v", "n", (F.col("w") * F.lit(factor) / F.pow(F.lit(2.0), halvings)).alias("_x"))
    e = F.exp(F.col("_x") - F.max("_x").over(by))
    return raw.select("v", "n", e.alias("_e")).select("v", "n", (F.col("_e") / F.sum("_e").over(by)).alias("w"))


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Other choice and own share of every slot, for draws in constant time."""
    n = len(weights)
    share, other = np.asarray(weights, float) * n / np.sum(weights), np.arange(n)
    low, high = [i for i in range(n) if share[i] < 1], [i for i in range(n) if share[i] >= 1]
    while low and high:
        i, j = low.pop(), high[-1]
        other[i] = j
        share[j] -= 1 - share[i]
        if share[j] < 1:
            low.append(high.pop())
    return other, np.minimum(share, 1.0)


def alias_draw(other: np.ndarray, share: np.ndarray, slot: float, coin: float) -> int:
    """The choice for two uniform numbers."""
    i = min(int(slot * len(share)), len(share) - 1)
    return i if coin < share[i] else int(other[i])


def alias_tables(w: DataFrame) -> DataFrame:
    """``v, n, other, share``: the alias table of every vertex, a row a slot, slots in the order of ``n``."""

    @F.pandas_udf("array<struct<other:int,share:double>>")
    def tables(weights: pd.Series) -> pd.Series:
        return weights.map(lambda x: [{"other": int(o), "share": float(s)} for o, s in zip(*alias_table(np.asarray(x, float)), strict=True)])

    near = w.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("out"))
    slots = near.select("v", "out", tables(F.col("out.w")).alias("t")).select("v", "out", F.explode(F.arrays_zip(F.col("out.n").alias("n"), "t")).alias("s"))
    return slots.select("v", F.col("s.n").alias("n"), F.col("out")[F.col("s.t.other")]["n"].alias("other"), F.col("s.t.share").alias("share"))
