"""Random walks beside the neighbours of their component, and skip-gram vectors.

Walkers are shuffled to blocks of whole components and walk there; in components that no
task should hold, a step is one equi-join.  A step's choice is a hash of seed, walk and
step, so walks depend on neither.  No adjacency is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txloom.functions.storage import hash_unit, materialize
from txloom.operators.graph import adjacency, components, degrees
from txloom.operators.local_walks import block_walks
from txloom.operators.skipgram import skipgram  # noqa: F401

#: Steps between two writes of the walkers' positions.
CUT_EVERY = 8
#: Choices (links; of second-order walks, neighbours of a link's end) of a component that a task holds.
LOCAL_CHOICES = 2_000_000
#: Nodes of a block of small components, and nodes whose walkers share a copy of a larger component.
BLOCK_STARTS, PART_STARTS = 2_500, 20_000


def stable_int(c: Column, modulus: int = 100_000) -> Column:
    """Leading 60 bits of the SHA-256 of a text, modulo ``modulus``."""
    return F.pmod(F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("long"), F.lit(modulus))


def walk_seeds(u: DataFrame, walks: int, seed: int = 42) -> DataFrame:
    """``id, iter, seed``: ``seed + iter · 100000 + stable_int(id)`` of every walk."""
    ids = degrees(u).select("id")
    return ids.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))).withColumn("seed", F.lit(seed) + F.col("iter") * 100_000 + stable_int(F.col("id")))


def _pick(choices: Column, weights: Column, unit: Column) -> Column:
    """The choice in whose part of the summed weights ``unit`` falls."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
    step = lambda s, w: F.struct((s["sum"] + w).alias("sum"), F.when(s["sum"] + w <= unit * total, s["at"] + 1).otherwise(s["at"]).alias("at"))
    at = F.aggregate(weights, start, step)["at"]
    return F.element_at(choices, F.least(at, F.size(choices) - 1) + 1)


def walk(u: DataFrame, walks: int = 10, length: int = 80, seed: int = 42, p: float = 1.0, q: float = 1.0, labels: DataFrame | None = None) -> DataFrame:
    """``walk_id, walk`` of ``length`` nodes (shorter where a node has no neighbour).

    With p = q = 1 steps are uniform over the sorted neighbours.  Else a step weighs
    1/p for going back, 1 for a neighbour of the previous node and 1/q for others.
    With ``labels(id, label)`` a step goes to neighbours of the current node's label,
    if there are any.

    A walk never leaves its component, so walkers are dealt out once with their
    component's neighbours and take all steps there; many small components share a block,
    a component of many nodes is repeated for every part of its walkers.  Components of
    more than ``LOCAL_CHOICES`` choices are walked by joins, a step each.
    """
    u = materialize(u.select("src", "dst"), "links")
    near = adjacency(u)
    if labels is not None:
        labels = materialize(labels, "labels")
        tagged = u.join(labels.toDF("dst", "other"), "dst").join(labels.toDF("src", "own"), "src")
        same = tagged.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("every"), F.sort_array(F.collect_set(F.when(F.col("own") == F.col("other"), F.col("dst")))).alias("alike"))
        near = same.select("id", F.when(F.size("alike") > 0, F.col("alike")).otherwise(F.col("every")).alias("neighbours"))
    second = p != 1.0 or q != 1.0
    choices = F.coalesce(F.size("neighbours"), F.lit(0)).cast("long")
    rows = degrees(u).select("id", stable_int(F.col("id")).alias("mark")).join(near, "id", "left").join(components(u), "id")
    rows = materialize(rows.withColumn("choices", choices * choices if second else choices), "walkers")
    sizes = materialize(rows.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("choices").alias("c")), "walkers")
    far, wide = F.col("c") > LOCAL_CHOICES, F.col("n") > BLOCK_STARTS
    salts = F.ceil(F.col("n") / PART_STARTS).cast("int")
    count = sizes.agg(F.coalesce(F.sum(F.when(~far & ~wide, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~far & wide, salts)), F.lit(0)).alias("salts"), F.count_if(far).alias("far"), F.count_if(~far).alias("local")).first()
    # a few at most: each has more than a block's nodes or choices
    big = F.broadcast(sizes.filter(far | wide).select("comp", salts.alias("salts"), far.alias("far")))
    placed, found = rows.join(big, "comp", "left"), []
    if count["local"]:
        cores = u.sparkSession.sparkContext.defaultParallelism
        blocks = max(-(-count["n"] // BLOCK_STARTS), 16 * cores)
        held = placed.filter(~F.coalesce("far", F.lit(False))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        block = F.when(F.col("salts").isNull(), F.pmod(F.xxhash64("comp"), F.lit(blocks)).cast("string")).otherwise(F.concat_ws("#", "comp", "salt"))
        starts = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)).cast("long")) == F.col("salt")
        dealt = held.select(F.concat(F.when(F.col("salts").isNull(), "s").otherwise("w"), block).alias("block"), "id", "mark", starts.alias("starts"), F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"))
        dealt = dealt.repartition(max(2 * cores, -(-blocks // 8) + count["salts"]), "block").sortWithinPartitions("block", "id")
        found.append(dealt.mapInArrow(block_walks(walks, length, seed, p, q), "walk_id string, walk array<string>"))
    if count["far"]:
        ids = placed.filter("far").select("id")
        found.append(_joined(materialize(near.join(ids, "id", "left_semi"), "adjacency"), walk_seeds(u, walks, seed).join(ids, "id", "left_semi"), length, p, q))
    return reduce(DataFrame.unionByName, found) if found else u.select(F.col("src").alias("walk_id"), F.array("src").alias("walk"))


def _joined(near: DataFrame, seeds: DataFrame, length: int, p: float, q: float) -> DataFrame:
    """Walks from ``seeds`` over ``near(id, neighbours)``, every step a join of all walkers."""
    second = p != 1.0 or q != 1.0
    none = F.array().cast("array<string>")
    state = seeds.select(F.concat_ws("#", "id", "iter").alias("walk_id"), "seed", F.col("id").alias("at"), F.lit(None).cast("string").alias("back"), F.array("id").alias("walk"), none.alias("around"))
    parts, at = [], 0
    for k in range(1, length):
        joined = state.join(near.withColumnRenamed("id", "at"), "at", "left")
        unit = hash_unit(F.md5(F.concat_ws("|", "seed", "walk_id", F.lit(str(k)))))
        if second:
            weight = F.transform("neighbours", lambda x: F.when(x == F.col("back"), 1 / p).when(F.lit(k == 1) | F.array_contains("around", x), 1.0).otherwise(1 / q))  # noqa: B023
            step = _pick(F.col("neighbours"), weight, unit)
        else:
            step = F.element_at("neighbours", F.floor(unit * F.size("neighbours")).cast("int") + 1)
        # the step is a column first, so that position and walk take the same one
        picked = joined.withColumn("step", F.when(F.size("neighbours") > 0, step))
        state = picked.select("walk_id", "seed", F.coalesce("step", "at").alias("at"), F.col("at").alias("back"), F.when(F.col("step").isNotNull(), F.concat("walk", F.array("step"))).otherwise(F.col("walk")).alias("walk"), (F.coalesce("neighbours", none) if second else none).alias("around"))
        if k % CUT_EVERY == 0 and k < length - 1:
            state = materialize(state, "walks")
            parts.append(state.select("walk_id", F.lit(at).alias("part"), "walk"))
            state, at = state.withColumn("walk", none), at + 1
    if not parts:
        return state.select("walk_id", "walk")
    parts.append(state.select("walk_id", F.lit(at).alias("part"), "walk"))
    return _whole(parts)


def _whole(parts: list[DataFrame]) -> DataFrame:
    """Walks from their stored parts; only the last few nodes travel with a walker."""
    every = reduce(DataFrame.unionByName, parts)
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("part", "walk"))), lambda x: x["walk"])
    return every.groupBy("walk_id").agg(F.flatten(pieces).alias("walk"))


def weighted_walk(w: DataFrame, walks: int = 10, length: int = 20, seed: int = 42) -> DataFrame:
    """Walks over a weighted neighbour table ``v, n, w``, steps in proportion to the weights."""
    near = materialize(w.groupBy(F.col("v").alias("at")).agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("out")), "weighted")
    starts = near.select(F.col("at").alias("id")).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))))
    state, parts, part = starts.select(F.concat_ws("#", "id", "iter").alias("walk_id"), F.col("id").alias("at"), F.array("id").alias("walk")), [], 0
    for k in range(1, length):
        unit = hash_unit(F.md5(F.concat_ws("|", F.lit(str(seed)), "walk_id", F.lit(str(k)))))
        step = _pick(F.col("out.n"), F.col("out.w"), unit)
        state = state.join(near, "at").select("walk_id", step.alias("at"), "walk").select("walk_id", "at", F.concat("walk", F.array("at")).alias("walk"))
        if k % CUT_EVERY == 0 and k < length - 1:
            state = materialize(state, "walks")
            parts.append(state.select("walk_id", F.lit(part).alias("part"), "walk"))
            state, part = state.withColumn("walk", F.array().cast("array<string>")), part + 1
    return _whole([*parts, state.select("walk_id", F.lit(part).alias("part"), "walk")]) if parts else state.select("walk_id", "walk")


def deepwalk(u: DataFrame, walks: int = 10, length: int = 80, seed: int = 42) -> DataFrame:
    return walk(u, walks, length, seed)


# Return and in-out parameters of the three node2vec variants.
NODE2VEC = {"bal": (1.0, 1.0), "dfs": (0.25, 4.0), "bfs": (4.0, 0.25)}


def node2vec(u: DataFrame, variant: str = "bal", walks: int = 10, length: int = 80, seed: int = 42) -> DataFrame:
    p, q = NODE2VEC[variant]
    return walk(u, walks, length, seed, p, q)


def top_degree(u: DataFrame, k: int = 50_000) -> DataFrame:
    """The ``k`` nodes of highest degree, smaller ids first at a tie."""
    return degrees(u).orderBy(F.desc("d"), "id").limit(k)


def role2vec(u: DataFrame, labels: DataFrame, walks: int = 10, length: int = 80, seed: int = 42) -> DataFrame:
    """Walks from all nodes that prefer neighbours with the current node's role label."""
    return walk(u, walks, length, seed, labels=labels)


def skipgram_tree(walks: DataFrame, dims: int = 64, window: int = 10, epochs: int = 5, seed: int = 42, partitions: int = 1) -> DataFrame:
    """``id, emb``: skip-gram vectors by hierarchical softmax.  More partitions train faster and less exactly."""
    model = Word2Vec(vectorSize=dims, windowSize=window, maxIter=epochs, minCount=0, seed=seed, numPartitions=partitions, maxSentenceLength=10_000, inputCol="walk", outputCol="v").fit(walks)
    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector", "float32").alias("emb"))


def spread(emb: DataFrame, prefix: str, dims: int = 64) -> DataFrame:
    """A column a dimension, for export."""
    return emb.select("id", *[F.coalesce(F.col("emb")[i], F.lit(0.0)).cast("float").alias(f"{prefix}{i}") for i in range(dims)])
