"""Node indicators as DataFrame programs; ``u`` is a symmetric edge table without loops, ``e`` a directed one."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txloom.functions.storage import dense_index, drop, hash_key, hash_rank, materialize
from txloom.operators.graph import components, degrees, nodes

#: Rounds between two writes of an iterative state.
CUT_EVERY = 4

def degree_centrality(u: DataFrame) -> DataFrame:
    """Degree over the number of other nodes."""
    d = degrees(u)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    return d.crossJoin(F.broadcast(n)).select("id", (F.col("d") / F.nullif(F.col("n") - 1, F.lit(0))).alias("gi_degree_centrality"))


def in_out_degree(e: DataFrame) -> DataFrame:
    """Directed degrees of every node; one aggregation over both ends."""
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.i").alias("gi_in_degree"), F.sum("x.o").alias("gi_out_degree"))


def pagerank(e: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-8, fixed_iters: int | None = None) -> DataFrame:
    """Directed PageRank; dangling mass is spread evenly.

    Stops when the L1 change is below ``n · tol``, raises where it is not after
    ``max_iter`` rounds, or runs ``fixed_iters`` rounds whatever the change.  Every round is written and read once; its dangling mass joins the next round as a
    single broadcast row.
    """
    links = materialize(e.select("src", "dst"), "pr-links")
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("x")
    ids = links.select(ends).groupBy(F.col("x.id").alias("id")).agg(F.nullif(F.sum("x.o"), F.lit(0)).alias("outs"))
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(None).cast("double").alias("gi_pagerank"))
    x = materialize(ids.select("id", "outs", F.lit(1.0 / n).alias("x"), F.lit(None).cast("double").alias("old")), "pr")
    for _ in range(fixed_iters or max_iter):
        lost = x.filter("outs IS NULL").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("lost"))
        flow = links.join(x.select("id", (F.col("x") / F.col("outs")).alias("w")), links.src == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("flow"))
        rank = F.lit(alpha) * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / n) + F.lit((1 - alpha) / n)
        new = materialize(x.join(flow, "id", "left").crossJoin(F.broadcast(lost)).select("id", "outs", rank.alias("x"), F.col("x").alias("old")), "pr")
        drop(x)
        x = new
        if fixed_iters is None and x.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0] < n * tol:
            break
    else:
        if fixed_iters is None:
            raise RuntimeError(f"PageRank did not converge to {tol} in {max_iter} rounds")
    return x.select("id", F.col("x").alias("gi_pagerank"))


def eigenvector(u: DataFrame, max_iter: int = 1000, tol: float = 1e-6, fixed_iters: int | None = None, comp: DataFrame | None = None) -> DataFrame:
    """Eigenvector centrality, normalised inside each component; all components iterate together.

    A component that has not converged after ``max_iter`` rounds gets zeros, unless the
    number of rounds is fixed by ``fixed_iters``.
    """
    state = materialize((comp or components(u)).withColumn("x", F.lit(1.0)), "ev")
    size = state.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    state = state.join(size, "comp").select("id", "comp", (F.col("x") / F.col("n")).alias("x"), "n")
    links, held = materialize(u, "ev-links"), None
    for k in range(fixed_iters or max_iter):
        sums = links.join(state.select("id", "x"), links.dst == F.col("id")).groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("s"))
        raw = state.join(sums, "id", "left").withColumn("y", F.col("x") + F.coalesce("s", F.lit(0.0)))
        norms = raw.groupBy("comp").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        new = raw.join(norms, "comp").select("id", "comp", F.coalesce(F.col("y") / F.nullif("norm", F.lit(0.0)), F.lit(0.0)).alias("x"), "n", F.col("x").alias("old"))
        if fixed_iters is None or k % CUT_EVERY == CUT_EVERY - 1:
            new, old = materialize(new, "ev"), held
            moving = new.groupBy("comp").agg((F.sum(F.abs(F.col("x") - F.col("old"))) >= F.max("n") * tol).alias("open")).filter("open").select("comp")
            open_ = fixed_iters is None and moving.head(1)
            if old is not None:
                drop(old)
            held = new
            if fixed_iters is None and (not open_ or k == max_iter - 1):
                state = new if not open_ else new.join(moving, "comp", "left_anti").unionByName(new.join(moving, "comp", "left_semi").withColumn("x", F.lit(0.0)))
                break
        state = new.drop("old")
    return state.select("id", F.when(F.col("n") > 1, F.col("x")).otherwise(F.lit(0.0)).alias("gi_eigenvector_centrality"))


def bfs_layers(u: DataFrame, roots: DataFrame, until_layer: int) -> DataFrame:
    """``root, id, layer`` of every node within ``until_layer`` hops of each root.

    In a symmetric graph the neighbours of a layer lie in it, before it or behind it,
    so a new layer is compared with the last two only.
    """
    before = None
    front = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("layer"))
    seen = front
    for k in range(1, until_layer + 1):
        near = front if before is None else front.unionByName(before)
        step = front.join(u, front.id == u.src).select("root", F.col("dst").alias("id")).distinct()
        step = step.join(near.select("root", "id"), ["root", "id"], "left_anti").withColumn("layer", F.lit(k))
        before, front = front, materialize(step, "front") if k % 3 == 0 else step
        seen = seen.unionByName(front)
    return seen


#: Hops of a search that one job takes.
HOPS = 6


def closeness(u: DataFrame, hops: int = HOPS) -> DataFrame:
    """``(n_c - 1) / Σ d`` inside each component, 0 for nodes without neighbours.

    All nodes search at once, 64 roots in the bits of a number: a row is a node and a block
    of 64 roots with the bits that have reached it.  A hop joins rows to edges and combines
    bits by ``bit_or``; distances are symmetric, so a node adds up the bits that newly reach
    it.  An edge from every node to itself carries its row on, so that a hop reads the state
    once and ``hops`` of them are one job.  Numbers are given by the least neighbour, which
    keeps small components in few blocks.
    """
    least = u.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.concat_ws("\x01", F.least("id", "m"), "id").alias("place"))
    ids = materialize(dense_index(least, "place", "node").select("id", F.col("node").cast("long").alias("node")), "cl-ids")
    links = u.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst").select("a", "b")
    links = materialize(links.unionByName(ids.select(F.col("node").alias("a"), F.col("node").alias("b"))), "cl-links")
    own = F.expr("shiftleft(1L, CAST(node & 63 AS INT))")
    state = materialize(ids.select("node", F.shiftright("node", 6).alias("block"), own.alias("seen"), own.alias("front"), F.lit(0).cast("long").alias("far")), "cl")
    k = 0
    while state.filter("front <> 0").head(1):
        next_ = state
        for _ in range(hops):
            k += 1
            self_ = F.col("a") == F.col("b")
            met = next_.join(links, next_.node == links.a).filter(self_ | (F.col("front") != 0))
            got = met.groupBy(F.col("b").alias("node"), "block").agg(
                F.coalesce(F.bit_or(F.when(self_, F.col("seen"))), F.lit(0).cast("long")).alias("seen"),
                F.coalesce(F.bit_or(F.when(~self_, F.col("front"))), F.lit(0).cast("long")).alias("came"),
                F.coalesce(F.max(F.when(self_, F.col("far"))), F.lit(0).cast("long")).alias("far"),
            )
            fresh = F.col("came").bitwiseAND(F.bitwise_not("seen"))
            next_ = got.select("node", "block", F.col("seen").bitwiseOR(F.col("came")).alias("seen"), fresh.alias("front"), (F.col("far") + F.bit_count(fresh) * F.lit(k)).alias("far"))
        new = materialize(next_, "cl")
        drop(state)
        state = new
    sums = state.groupBy("node").agg(F.sum("far").alias("far"), (F.sum(F.bit_count("seen")) - 1).alias("others"))
    return ids.join(sums, "node").select("id", F.coalesce(F.col("others") / F.nullif("far", F.lit(0)), F.lit(0.0)).alias("gi_closeness_centrality"))


def triangle_list(u: DataFrame) -> DataFrame:
    """``a, b, c`` of every triangle once: edges point to the higher (degree, id), so hubs start few wedges."""
    d = degrees(u)
    rank = lambda c: F.struct(F.col(f"d{c}"), F.col(c))
    o = u.join(d.select(F.col("id").alias("src"), F.col("d").alias("dsrc")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("ddst")), "dst")
    o = o.filter(rank("src") < rank("dst")).select("src", "dst", "ddst")
    x = o.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("ddst").alias("db"))
    y = o.select(F.col("src").alias("a"), F.col("dst").alias("c"), F.col("ddst").alias("dc"))
    wedge = x.join(y, "a").filter(F.struct("db", "b") < F.struct("dc", "c")).select("a", "b", "c")
    return wedge.join(o.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"], "left_semi").select("a", "b", "c")


def triangles(u: DataFrame) -> DataFrame:
    """Triangles through every node."""
    each = triangle_list(u).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    return degrees(u).join(each, "id", "left").select("id", F.coalesce("t", F.lit(0)).alias("gi_triangles"))


def clustering(u: DataFrame) -> DataFrame:
    """``2T / (d(d-1))``, 0 below two neighbours."""
    t = triangles(u).join(degrees(u), "id")
    pairs = F.col("d") * (F.col("d") - 1)
    return t.select("id", F.when(F.col("d") > 1, 2.0 * F.col("gi_triangles") / pairs).otherwise(F.lit(0.0)).alias("gi_clustering_coefficient"))


def squares(u: DataFrame) -> DataFrame:
    """``id, q``: cycles of four nodes through every node that is on one.

    A cycle has one node of highest (degree, id) and one opposite to it; paths of two
    edges start at the former and pass lower nodes only, so hubs start few of them and
    are passed by few: an edge has as many as the smaller degree of its ends.
    """
    d = degrees(u)
    o = u.join(d.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    to = lambda name: o.select(F.col("src").alias("b"), F.struct(F.col("dd").alias("d"), F.col("dst").alias("id")).alias(name), F.struct(F.col("ds").alias("d"), F.col("src").alias("id")).alias("_b"))
    paths = to("a").filter(F.col("_b") < F.col("a")).drop("_b").join(to("c").drop("_b"), "b").filter(F.col("c") < F.col("a")).select("b", F.col("a.id").alias("a"), F.col("c.id").alias("c"))
    ends = paths.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    outer = ends.select(F.explode(F.array("a", "c")).alias("id"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("q"))
    middle = paths.join(ends, ["a", "c"]).select(F.col("b").alias("id"), (F.col("n") - 1).alias("q"))
    return outer.unionByName(middle).groupBy("id").agg(F.sum("q").alias("q"))


def square_clustering(u: DataFrame) -> DataFrame:
    """Share of possible squares at a node, over pairs of its neighbours.

    For neighbours x, y with s common neighbours besides the node: found squares s,
    possible ones s + (d_x - m) + (d_y - m), m = s + 1 and one more if x and y touch.
    Summed over all pairs that is ``(d - 1) · Σ d_x - q - d (d - 1) - 2 T`` with the
    node's squares q and triangles T, so no pair of neighbours is a row.
    """
    d = degrees(u)
    around = u.join(d.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"), F.sum("dd").alias("s"))
    row = around.join(triangles(u), "id").join(squares(u), "id", "left").withColumn("q", F.coalesce("q", F.lit(0)))
    possible = (F.col("d") - 1) * F.col("s") - F.col("q") - F.col("d") * (F.col("d") - 1) - 2 * F.col("gi_triangles")
    return row.select("id", F.coalesce(F.col("q") / F.nullif(possible, F.lit(0)), F.lit(0.0)).alias("gi_square_clustering"))


#: Edges up to which whole components are peeled in one task.
PEEL_EDGES = 500_000


def peel(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their core numbers of symmetric edges: the node of least degree goes first."""
    import heapq

    ids, at = np.unique(src, return_inverse=True)
    to = np.searchsorted(ids, dst)
    order = np.argsort(at, kind="stable")
    start, to = np.searchsorted(at[order], np.arange(len(ids) + 1)).tolist(), to[order].tolist()
    left = np.bincount(at, minlength=len(ids)).tolist()
    heap, core, k = [(d, i) for i, d in enumerate(left)], [-1] * len(ids), 0
    heapq.heapify(heap)
    while heap:
        d, i = heapq.heappop(heap)
        if core[i] >= 0 or d != left[i]:
            continue
        core[i] = k = max(k, d)
        for j in to[start[i] : start[i + 1]]:
            if core[j] < 0:
                left[j] -= 1
                heapq.heappush(heap, (left[j], j))
    return ids, np.array(core, np.int64)


def core_number(u: DataFrame, most: int = PEEL_EDGES) -> DataFrame:
    """k-core index of every node.

    Components of up to ``most`` edges are peeled, many in a task; in larger ones every
    node takes the h-index of its neighbours' values, round by round until none changes.
    """
    links = materialize(u.select("src", "dst"), "core-links")
    comp = materialize(components(links), "core-comp")
    tagged = links.join(comp.select(F.col("id").alias("src"), "comp"), "src")
    sizes = materialize(tagged.groupBy("comp").agg(F.count(F.lit(1)).alias("n")), "core-sizes")
    total = sizes.filter(F.col("n") <= most).agg(F.sum("n")).first()[0] or 0
    parts = max(int(u.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // max(most, 1)))
    whole = tagged.join(sizes.filter(F.col("n") <= most), "comp", "left_semi").select("src", "dst", F.pmod(F.xxhash64("comp"), F.lit(parts)).alias("_part"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, core = peel(pdf["src"].to_numpy(str), pdf["dst"].to_numpy(str))
        return pd.DataFrame({"id": ids, "gi_core_number": core})

    done = whole.groupBy("_part").applyInPandas(run, "id string, gi_core_number long")
    large = sizes.filter(F.col("n") > most)
    if not large.head(1):
        return done
    rest = materialize(tagged.join(large, "comp", "left_semi").select("src", "dst"), "core-rest")
    return done.unionByName(core_rounds(rest))


def core_rounds(links: DataFrame) -> DataFrame:
    """k-core index by h-index rounds over a stored symmetric edge table."""
    state = materialize(degrees(links).select("id", F.col("d").cast("long").alias("x")), "core")
    while True:
        counts = links.join(state, links.dst == state.id).join(state.select(F.col("id").alias("src"), F.col("x").alias("own")), "src")
        counts = counts.groupBy("src", "own", F.least("x", "own").alias("value")).agg(F.count(F.lit(1)).alias("c"))
        at_least = counts.withColumn("c", F.sum("c").over(Window.partitionBy("src").orderBy(F.desc("value"))))
        h = at_least.groupBy("src").agg(F.max(F.least("value", "c")).alias("x"), F.max("own").alias("old"))
        new = materialize(h.select(F.col("src").alias("id"), "x", "old"), "core")
        changed = new.filter("x <> old").head(1)
        drop(state)
        state = new.drop("old")
        if not changed:
            return state.select("id", F.col("x").alias("gi_core_number"))


def wl_labels(u: DataFrame, rounds: int = 3, modulus_digits: int = 8) -> DataFrame:
    """``id, label``: degree, then each round a hash of the own and the sorted neighbour labels."""
    u = materialize(u.select("src", "dst"), "wl-links")
    state = degrees(u).select("id", F.col("d").cast("string").alias("label"))
    for _ in range(rounds):
        state = materialize(state, "wl")  # both its uses read it; else every round would compute the earlier ones twice
        near = u.join(state, u.dst == state.id).groupBy("src").agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("around"))
        state = state.join(near, state.id == near.src).select("id", F.substring(F.md5(F.concat_ws("|", "label", "around")), 1, modulus_digits).alias("label"))
    return state


def laplacian(u: DataFrame) -> DataFrame:
    """Entries ``i, j, value`` of I - D^-1/2 A D^-1/2."""
    d = degrees(u)
    off = u.join(d.select(F.col("id").alias("src"), F.col("d").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("b")), "dst")
    off = off.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-1.0 / F.sqrt(F.col("a") * F.col("b"))).alias("value"))
    return off.unionByName(d.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value")))


def betweenness(u: DataFrame, exact_up_to: int = 5000, pivots: int = 2000, seed: int = 42) -> DataFrame:
    """Normalised betweenness; above ``exact_up_to`` nodes from hashed pivots, rescaled.

    Brandes' method for all sources at once: each layer of the searches is a stored table
    of shortest-path counts ``root, id, paths``; going back, a layer hands
    ``(1 + dependency) / paths`` along its edges to the layer before it.  No adjacency is
    gathered or broadcast; a layer is as large as the nodes that searches meet there.
    """
    links = materialize(u.select("src", "dst"), "bt-links")
    ids = materialize(nodes(links), "bt-ids")
    n = ids.count()
    roots, k = ids, n
    if n > exact_up_to:
        k = min(pivots, n)
        roots = hash_rank(ids.withColumn("_key", hash_key(seed, "id")), [], "_key", "_rank").filter(F.col("_rank") <= k).select("id")
    layers = [materialize(roots.select(F.col("id").alias("root"), "id", F.lit(1.0).alias("paths")), "bt-layer")]
    while layers[-1].head(1):
        step = layers[-1].join(links, F.col("id") == links.src).groupBy("root", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        near = reduce(DataFrame.unionByName, [x.select("root", "id") for x in layers[-2:]])  # in a symmetric graph no earlier layer is next to it
        layers.append(materialize(step.join(near, ["root", "id"], "left_anti"), "bt-layer"))
    held, sums = None, []
    for layer in reversed(layers[1:-1]):
        back = F.lit(0.0) if held is None else F.coalesce("w", F.lit(0.0)) * F.col("paths")
        rows = layer if held is None else layer.join(held.join(links, held.id == links.src).groupBy("root", F.col("dst").alias("id")).agg(F.sum("share").alias("w")), ["root", "id"], "left")
        held = materialize(rows.select("root", "id", back.alias("owed"), ((1 + back) / F.col("paths")).alias("share")), "bt-back")
        sums.append(held.groupBy("id").agg(F.sum("owed").alias("b")))
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0) * (n / k if k else 0.0)
    if not sums:
        return ids.select("id", F.lit(0.0).alias("gi_betweenness_centrality"))
    total = reduce(DataFrame.unionByName, sums).groupBy("id").agg(F.sum("b").alias("b"))
    return ids.join(total, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("gi_betweenness_centrality"))


def community_extras(u: DataFrame, members: DataFrame, small: int = 10) -> DataFrame:
    """Size, density, smallness and a five-dimensional code of each node's community ``members(id, comm)``.

    The code is a unit vector from a generator seeded by the community's SHA-256.
    """
    size = members.groupBy("comm").agg(F.count(F.lit(1)).alias("n"))
    a, b = members.select(F.col("id").alias("src"), "comm"), members.select(F.col("id").alias("dst"), F.col("comm").alias("other"))
    inner = u.filter("src < dst").join(a, "src").join(b, "dst").filter("comm = other").groupBy("comm").agg(F.count(F.lit(1)).alias("m"))
    per = size.join(inner, "comm", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    per = per.select("comm", F.col("n").alias("gi_comm_size"), F.when(F.col("n") > 1, F.col("m") / pairs).otherwise(F.lit(0.0)).alias("gi_comm_density"), (F.col("n") < small).cast("int").alias("gi_comm_is_small"))

    @F.pandas_udf("array<double>")
    def code(comm: pd.Series) -> pd.Series:
        import hashlib

        def one(c: object) -> list[float]:
            seed = int(hashlib.sha256(str(c).encode()).hexdigest(), 16) % (1 << 32)
            x = np.random.RandomState(seed).normal(size=5)
            return (x / (np.linalg.norm(x) or 1.0)).tolist()

        return comm.map(one)

    per = per.withColumn("_code", code(F.col("comm")))
    per = per.select("*", *[F.col("_code")[i].alias(f"gi_comm_code_{i + 1}") for i in range(5)]).drop("_code")
    return members.join(per, "comm").drop("comm")


def modularity(u: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of a partition ``members(id, comm)``."""
    d = degrees(u).join(members, "id").groupBy("comm").agg(F.sum("d").alias("k"))
    a, b = members.select(F.col("id").alias("src"), "comm"), members.select(F.col("id").alias("dst"), F.col("comm").alias("other"))
    inner = u.join(a, "src").join(b, "dst").filter("comm = other").groupBy("comm").agg(F.count(F.lit(1)).alias("w"))
    total = u.count()
    per = d.join(inner, "comm", "left").withColumn("q", F.coalesce("w", F.lit(0)) / F.lit(float(max(total, 1))) - F.lit(resolution) * F.pow(F.col("k") / F.lit(float(max(total, 1))), 2))
    return per.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("modularity"))


def gw_scales(n: int = 6, low: float = 1e-2, high: float = 1e1) -> list[float]:
    """Log-spaced heat kernel scales."""
    return [10 ** (math.log10(low) + (math.log10(high) - math.log10(low)) * i / (n - 1)) for i in range(n)]
