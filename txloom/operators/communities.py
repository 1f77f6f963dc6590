"""Community detection as rounds over tables of nodes and edges.

A level has weighted symmetric edges ``a, b, w`` and nodes ``node, k`` (``k`` with the
weight inside the node).  In a round every node moves to the community next to it that
gains most, if that gains and comes later in an order of communities by hash; the next
round takes the reverse order, the one behind it another.  So no two nodes swap, and any
pair of communities may exchange nodes every second round.  Then communities become the
nodes of the next level.  Joins and sums only: no component, community or hub has to fit a task, and
the driver sees three numbers a round.  (Infomap alone still takes a component a task.)
"""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txloom.functions.storage import dense_index, drop, materialize
from txloom.operators.graph import components, star_components

Adjacency = list[dict[int, float]]

#: A level ends where no node wants to move, or after QUIET rounds none of which gains LEAST of modularity.
QUIET, LEAST = 2, 5e-4


def _later(to: Column, comm: Column, seed: int, turn: int) -> Column:
    """Whether a community comes later in the round's order."""
    a, b = (F.xxhash64(c, F.lit(seed), F.lit(turn // 2)) for c in (to, comm))
    return a > b if turn % 2 else a < b


def _totals(state: DataFrame) -> DataFrame:
    """``node, comm, k`` with the weight ``tot`` and the number ``size`` of each node's community."""
    per = state.groupBy("comm").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))
    return state.join(per, "comm")


def _best(edges: DataFrame, state: DataFrame, two_m: float, resolution: float, seed: int, turn: int, refine: bool) -> DataFrame:
    """``node, own, wants, to, inner``: links into the own community, whether any move gains, the best allowed target, and links into the own coarse community.

    With ``refine`` the state has a column ``coarse``: nodes stay inside it, only nodes that
    are alone move, and both a node and its target must be well linked to the rest of it.
    """
    there = state.select(F.col("node").alias("b"), F.col("comm").alias("to"), F.col("tot").alias("to_tot"), *([F.col("coarse").alias("b_coarse"), F.col("tied").alias("to_tied")] if refine else []))
    here = state.select(F.col("node").alias("a"), "comm", "k", "tot", "size", *(["coarse", "tied"] if refine else []))
    near = edges.join(there, "b")
    keys = ["a", "to", "to_tot", *(["b_coarse", "to_tied"] if refine else [])]
    links = near.groupBy(*keys).agg(F.sum("w").alias("w")).join(here, "a")
    score = F.col("w") - F.lit(resolution / two_m) * F.col("k") * F.col("to_tot")
    stay = F.lit(resolution / two_m) * F.col("k") * (F.col("tot") - F.col("k"))
    other = F.col("to") != F.col("comm")
    if refine:
        other &= (F.col("b_coarse") == F.col("coarse")) & F.col("tied") & F.col("to_tied") & (F.col("size") == 1)
    allowed = other & _later(F.col("to"), F.col("comm"), seed, turn)
    pick = F.max(F.when(allowed, F.struct(score.alias("score"), (-F.col("to")).alias("to"))))
    found = links.groupBy("a").agg(
        F.sum(F.when(F.col("to") == F.col("comm"), F.col("w")).otherwise(0.0)).alias("own"), F.max(F.when(other, score)).alias("any"), pick.alias("pick"), F.first(stay).alias("stay")
    )
    gains = lambda c: c > F.col("own") - F.col("stay") + 1e-9
    return found.select(F.col("a").alias("node"), "own", F.coalesce(gains(F.col("any")), F.lit(False)).alias("wants"), F.when(gains(F.col("pick.score")), -F.col("pick.to")).alias("to"))


def _ties(edges: DataFrame, state: DataFrame, two_m: float, resolution: float) -> DataFrame:
    """The state with ``tied``: whether a refined community has enough links to the rest of its coarse one."""
    ends = state.select("node", "comm", "coarse")
    inner = edges.join(ends.toDF("a", "comm", "coarse"), "a").join(ends.toDF("b", "b_comm", "b_coarse"), "b").filter("coarse = b_coarse AND comm <> b_comm")
    out = inner.groupBy("comm").agg(F.sum("w").alias("out"))
    whole = state.groupBy("coarse").agg(F.sum("k").alias("whole"))
    need = F.lit(resolution / two_m) * F.col("tot") * (F.col("whole") - F.col("tot"))
    return state.join(out, "comm", "left").join(whole, "coarse").withColumn("tied", F.coalesce("out", F.lit(0.0)) >= need - 1e-9).drop("out", "whole")


def _local_moves(edges: DataFrame, state: DataFrame, two_m: float, resolution: float, seed: int, refine: bool = False) -> DataFrame:
    """Rounds of moves over stored ``edges`` from a stored ``state`` (node, comm, k) until none gains; the stored best state."""
    keep = ["node", "comm", "k", *(["coarse"] if refine else [])]
    state = materialize(state.select(*keep), "level")
    best, most, quiet, turn = state, None, 0, 0
    while True:
        seen = _totals(state.select(*keep))
        if refine:
            seen = _ties(edges, seen, two_m, resolution)
        found = _best(edges, seen, two_m, resolution, seed, turn, refine)
        moved = seen.select(*keep, (F.col("k") * F.col("tot")).alias("square")).join(found, "node", "left")
        new = materialize(moved.withColumn("comm", F.coalesce("to", "comm")), "level")
        inner, squares, wants = new.agg(F.sum("own"), F.sum("square"), F.count_if("wants")).first()
        score = (inner or 0.0) / two_m - resolution * squares / two_m**2  # of the state before the moves
        quiet, turn = 0 if most is None or score > most + LEAST else quiet + 1, turn + 1
        if most is None or score > most:
            if best is not state:
                drop(best)
            best, most = state, score
        elif state is not best:
            drop(state)
        if not wants or quiet >= QUIET:
            drop(new)
            return best
        state = new


def _fold(edges: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored edges between the communities of ``parts`` (node, comm, k), and the communities as nodes ``node, k``."""
    ends = parts.select("node", "comm")
    between = edges.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").filter("x <> y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w"))
    return materialize(between, "folded-edges"), materialize(parts.groupBy(F.col("comm").alias("node")).agg(F.sum("k").alias("k")), "folded-nodes")


def _start(u: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Numbered nodes ``id, node``, stored edges and nodes of the first level, and the sum of all weights."""
    ids = materialize(dense_index(u.select(F.col("src").alias("id")).distinct(), "id", "node").select("id", F.col("node").cast("long").alias("node")), "numbers")
    edges = materialize(u.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst").select("a", "b", F.lit(1.0).alias("w")), "edges")
    nodes = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")), "nodes")
    return ids, edges, nodes, float(u.count())


def _numbered(ids: DataFrame, members: DataFrame, out: str) -> DataFrame:
    """``id, <out>``: communities numbered in the order of their smallest members."""
    of = ids.join(members, "node")
    led = materialize(of.join(of.groupBy("comm").agg(F.min("id").alias("lead")), "comm").select("id", "lead"), "communities")
    numbers = dense_index(led.select("lead").distinct(), "lead", out)
    return led.join(numbers, "lead").select("id", F.col(out).cast("int").alias(out))


def louvain(u: DataFrame, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """``id, gi_community_louvain`` over symmetric edges: moves, then the same on the graph of communities until nothing moves."""
    ids, edges, nodes, two_m = _start(u)
    members, level = materialize(nodes.select("node", F.col("node").alias("comm")), "members"), 0
    while two_m:
        done = _local_moves(edges, nodes.withColumn("comm", F.col("node")), two_m, resolution, seed + level)
        if not done.filter("node <> comm").head(1):
            break
        members = _carried(members, done)
        edges, nodes = _fold(edges, done)
        level += 1
    return _numbered(ids, members, "gi_community_louvain")


def _carried(members: DataFrame, parts: DataFrame) -> DataFrame:
    """First-level ``node, comm`` after the nodes of the last level joined ``parts``."""
    return materialize(members.join(parts.select(F.col("node").alias("comm"), F.col("comm").alias("to")), "comm").select("node", F.col("to").alias("comm")), "members")


def leiden(u: DataFrame, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """``id, gi_leiden_comm``: as Louvain, but the nodes of the next level are refined communities, which keep their coarse community to start with.

    A refined community grows by nodes that have an edge to it while nobody leaves it, so it
    is connected; coarse communities that are not are split in the end, which never lowers
    modularity.
    """
    ids, first, nodes, two_m = _start(u)
    edges, level = first, 0
    members = materialize(nodes.select("node", F.col("node").alias("comm")), "members")
    state = nodes.withColumn("comm", F.col("node"))
    coarse = members
    while two_m:
        done = _local_moves(edges, state, two_m, resolution, seed + level)
        coarse = _carried(members, done)
        n, parts = done.count(), done.select("comm").distinct().count()
        if parts == n:
            break
        alone = done.select("node", F.col("node").alias("comm"), "k", F.col("comm").alias("coarse"))
        fine = _local_moves(edges, alone, two_m, resolution, seed + 1000 + level, refine=True)
        if not fine.filter("node <> comm").head(1):
            break
        members = _carried(members, fine)
        edges, folded = _fold(edges, fine)
        state = materialize(folded.join(fine.select(F.col("comm").alias("node"), "coarse").distinct(), "node").select("node", "k", F.col("coarse").alias("comm")), "refined")
        level += 1
    return _numbered(ids, _connected(first, coarse), "gi_leiden_comm")


def _connected(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``node, comm`` with every community cut into the parts that its own edges join."""
    inner = edges.join(members.toDF("a", "x"), "a").join(members.toDF("b", "y"), "b").filter("x = y").select("a", "b")
    roots = star_components(inner).select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("comm"))


def _per_component(u: DataFrame, detect, out: str) -> DataFrame:
    """``id, <out>``: communities numbered over the whole graph by their smallest member."""
    comp = components(u)
    total = u.count() / 2
    rows = u.join(comp, u.src == comp.id).select("comp", "src", "dst")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["src"]) | set(pdf["dst"]))
        place = {v: i for i, v in enumerate(ids)}
        near: Adjacency = [{} for _ in ids]
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            near[place[a]][place[b]] = 1.0
        part = detect(near, total)
        first: dict[int, str] = {}
        for i, c in enumerate(part):
            first.setdefault(c, ids[i])
        return pd.DataFrame({"id": ids, "lead": [first[c] for c in part]})

    led = rows.groupBy("comp").applyInPandas(run, "id string, lead string")
    led = materialize(led, "communities")
    numbers = dense_index(led.select("lead").distinct(), "lead", out)
    return led.join(numbers, "lead").select("id", F.col(out).cast("int").alias(out))


def _plogp(x: float) -> float:
    return x * math.log2(x) if x > 0 else 0.0


def code_length(near: Adjacency, part: list[int], total: float) -> float:
    """Two-level map equation of an undirected partition, in bits."""
    flow = [sum(r.values()) / (2 * total) for r in near]
    size, leave = defaultdict(float), defaultdict(float)
    for i, row in enumerate(near):
        size[part[i]] += flow[i]
        leave[part[i]] += sum(w for j, w in row.items() if part[j] != part[i]) / (2 * total)
    q = sum(leave.values())
    return _plogp(q) - 2 * sum(map(_plogp, leave.values())) - sum(map(_plogp, flow)) + sum(_plogp(leave[c] + size[c]) for c in size)


def infomap_partition(near: Adjacency, total: float, trials: int = 10, seed: int = 42) -> list[int]:
    """Greedy minimisation of the map equation; the best of several seeded node orders."""
    best, least = list(range(len(near))), math.inf
    flow = [sum(r.values()) / (2 * total) for r in near]
    for t in range(trials):
        rng, part = random.Random(seed + t), list(range(len(near)))
        size = dict(enumerate(flow))
        leave = {i: sum(w for j, w in r.items() if j != i) / (2 * total) for i, r in enumerate(near)}
        q, moved = sum(leave.values()), True
        while moved:
            moved = False
            order = list(range(len(near)))
            rng.shuffle(order)
            for i in order:
                links: dict[int, float] = defaultdict(float)
                for j, w in near[i].items():
                    if j != i:
                        links[part[j]] += w / (2 * total)
                out, a = sum(links.values()), part[i]
                terms = lambda c, e, s: -2 * _plogp(e) + _plogp(e + s)
                ea, sa = leave[a] - out + 2 * links.get(a, 0.0), size[a] - flow[i]
                off = terms(a, max(0.0, ea), sa) - terms(a, leave[a], size[a])
                pick, gain = a, -1e-12
                for b in sorted(links):
                    if b != a:
                        eb, sb = leave[b] + out - 2 * links[b], size[b] + flow[i]
                        new_q = q - leave[a] - leave[b] + ea + eb
                        delta = _plogp(max(0.0, new_q)) - _plogp(q) + off + terms(b, max(0.0, eb), sb) - terms(b, leave[b], size[b])
                        if delta < gain:
                            pick, gain = b, delta
                if pick != a:
                    eb = leave[pick] + out - 2 * links[pick]
                    q += ea + eb - leave[a] - leave[pick]
                    leave[a], size[a], leave[pick], size[pick] = max(0.0, ea), sa, max(0.0, eb), size[pick] + flow[i]
                    part[i], moved = pick, True
        bits = code_length(near, part, total)
        if bits < least - 1e-12:
            best, least = part, bits
    return best


def infomap(u: DataFrame, trials: int = 10, seed: int = 42) -> DataFrame:
    """``id, gi_infomap_comm`` by the undirected two-level map equation."""
    return _per_component(u, lambda near, total: infomap_partition(near, total, trials, seed), "gi_infomap_comm")
