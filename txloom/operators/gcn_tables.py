"""Graph convolutions trained on tables: gradients flow through edge joins, weights stay on the driver.

The networks are those of :mod:`txloom.operators.gnn` (mean over neighbours, ReLU, two
classes), for graphs of any size.  Since a mean is linear, a layer sends ``h W``, so
messages are as wide as its output; the first layer's means do not depend on weights
and are computed once.  An epoch of ``n`` layers joins the edges ``n - 1`` times forward
and ``n - 1`` times backward.  Edges are bucketed by source, nodes by id, so messages
alone are shuffled; a source of more than a thousandth of all edges has several parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.functions.storage import drop, materialize, scratch_path
from txloom.operators import gnn

#: Edges, as a share of all, beyond which a source is split: one in so many.
HOT_SHARE = 1000


class Tables:
    """A graph stored for training: bucketed nodes with their first means, bucketed edges.

    Nodes are ``id, label, split`` and feature columns; ids are unique and not null.
    Edges with an end that is no node are left out, both directions and loops are added,
    repeated edges count once.  Null labels and other splits than ``train``,
    ``validation`` and ``test`` never teach.  Call :meth:`close` when done.
    """

    def __init__(self, e: DataFrame, nodes: DataFrame, columns: list[str]):
        self.spark, self.width = e.sparkSession, len(columns)
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._stored: list[str] = []
        part = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).when(F.col("split") == "test", 2).otherwise(-1)
        x = F.array(*[F.col(c).cast("double") for c in columns])
        rows = materialize(nodes.select(F.col("id").cast("string").alias("id"), F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("y"), part.alias("part_of"), x.alias("x")), "gcn-nodes")
        ends = e.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
        for end in ("src", "dst"):
            ends = ends.join(rows.select(F.col("id").alias(end)), end, "left_semi")
        loops = rows.select(F.col("id").alias("src"), F.col("id").alias("dst"))
        ends = materialize(ends.select("src", "dst").union(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).union(loops).distinct(), "gcn-ends")
        total = ends.count()
        degrees = materialize(ends.groupBy("dst").agg(F.count(F.lit(1)).alias("degree")), "gcn-degrees")
        salts = F.ceil(F.col("degree") * HOT_SHARE / F.lit(max(1, total))).cast("int")
        hot = F.broadcast(degrees.filter(salts > 1).select(F.col("dst").alias("src"), salts.alias("salts")))  # at most HOT_SHARE rows
        placed = ends.join(hot, "src", "left").select(F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int").alias("part"), "src", "dst")
        self.edges = self._bucketed(placed, "edges", "part", "src")
        known = rows.join(degrees, rows.id == degrees.dst).select("id", "y", "part_of", "degree", salts.alias("salts"), "x")
        means = self._sums(known.select(F.col("id").alias("src"), "salts", F.col("x").alias("m")), self.width, "a")
        known = known.drop("x").join(means, "id").withColumn("a", F.transform("a", lambda v: v / F.col("degree")))
        self.nodes = self._bucketed(known, "nodes", "id")
        for t in (rows, ends, degrees):
            drop(t)
        found = self.nodes.filter("y IN (0, 1)").groupBy("part_of", "y").count().collect()  # at most 8 rows
        self.counts = {(r["part_of"], r["y"]): r["count"] for r in found}

    def _bucketed(self, df: DataFrame, what: str, *keys: str) -> DataFrame:
        name = f"gcn_{what}_{uuid.uuid4().hex}"
        df.repartition(self.buckets, *keys).write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", scratch_path(self.spark, name)).saveAsTable(name)
        self._stored.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Drops the stored tables and their files."""
        for name in self._stored:
            drop(self.spark.table(name))
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._stored = []

    def _sums(self, sent: DataFrame, dims: int, out: str) -> DataFrame:
        """``id, <out>``: messages ``src, salts, m`` summed at the targets of their edges."""
        parts = sent.select("src", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("part"), "m")
        got = self.edges.join(parts, ["part", "src"]).groupBy(F.col("dst").alias("id")).agg(*[F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(dims)])
        return got.select("id", F.array(*[f"m{i}" for i in range(dims)]).alias(out))

    def weights(self, params: dict, parts: tuple[int, ...]) -> np.ndarray:
        """What a taught row of each class weighs; the weights of all taught rows sum to 1."""
        return gnn.class_shares(np.array([sum(self.counts.get((p, c), 0) for p in parts) for c in (0, 1)], float), params.get("class_weights", True))

    def forward(self, w: dict[str, np.ndarray], held: list[DataFrame]) -> DataFrame:
        """Nodes with the sums ``s1 …`` that their layers after the first receive; what is kept is added to ``held``."""
        state, n = self.nodes, len(w) // 2
        for k in range(1, n):
            send = lambda b, k=k: np.maximum(_outputs(b, w)[k - 1], 0) @ w[f"w{k}"]
            state = self._received(state, send, w[f"w{k}"].shape[1], f"s{k}", held)
        return state

    def _received(self, state: DataFrame, send: Callable[[pd.DataFrame], np.ndarray], dims: int, out: str, held: list[DataFrame]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"src": b["id"], "salts": b["salts"], "m": list(send(b))})

        sums = self._sums(state.mapInPandas(run, "src string, salts int, m array<double>"), dims, out)
        held.append(sums.persist(StorageLevel.MEMORY_AND_DISK))
        return state.join(held[-1], "id")

    def step(self, w: dict[str, np.ndarray], params: dict, parts: tuple[int, ...] = (0,)) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the weighted loss over the rows of ``parts``, and the mean loss of the validation rows."""
        n, each, held = len(w) // 2, self.weights(params, parts), []
        state = self.forward(w, held)
        for k in range(n - 1, 0, -1):
            send = lambda b, k=k: _slopes(b, w, each, parts, k + 1)[k] / b["degree"].to_numpy()[:, None]
            state = self._received(state, send, w[f"w{k}"].shape[1], f"t{k}", held)
        names = [f"{a}{k}" for k in range(n) for a in "wb"]
        cells = sum(w[m].size for m in names)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(cells + 2)
            for b in batches:
                if len(b):
                    total += np.concatenate(_gradients(b, w, each, parts))
            yield pd.DataFrame({"cells": [total]})

        summed = state.mapInPandas(run, "cells array<double>").select(F.posexplode("cells").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
        flat = np.zeros(cells + 2)
        for r in summed.collect():  # a row a weight
            flat[r["at"]] = r["v"]
        for t in held:
            t.unpersist()
        grads, at = {}, 0
        for m in names:
            grads[m] = flat[at : at + w[m].size].reshape(w[m].shape)
            at += w[m].size
        return grads, float(flat[-2] / flat[-1]) if flat[-1] else 0.0

    def train(self, params: dict, epochs: int = 200, patience: int = 10, seed: int = 42) -> tuple[dict[str, np.ndarray], dict]:
        """Weights of the best validation loss, as :func:`txloom.operators.gnn.train_gcn` finds them."""
        w = gnn.init_layers([self.width, *[int(h) for h in params.get("hidden", [16])], 2], seed)
        return gnn.descend(lambda w: self.step(w, params), w, params, epochs, patience)

    def refit(self, params: dict, epochs: int, seed: int = 42) -> dict[str, np.ndarray]:
        """Weights after ``epochs`` on training and validation rows together."""
        w = gnn.init_layers([self.width, *[int(h) for h in params.get("hidden", [16])], 2], seed)
        return gnn.descend_fixed(lambda w: self.step(w, params, (0, 1)), w, params, epochs)

    def outputs(self, w: dict[str, np.ndarray]) -> DataFrame:
        """``id, split, y, p0, emb``: probability of class 0 and the last hidden layer (the means where there is none)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    z = _outputs(b, w)
                    hidden = np.maximum(z[-2], 0) if len(z) > 1 else _stack(b["a"])
                    yield pd.DataFrame({"id": b["id"], "split": np.array(["none", "train", "validation", "test"])[b["part_of"].to_numpy() + 1], "y": b["y"], "p0": gnn._softmax(z[-1])[:, 0], "emb": list(hidden)})

        held: list[DataFrame] = []
        out = materialize(self.forward(w, held).mapInPandas(run, "id string, split string, y int, p0 double, emb array<double>"), "gcn-outputs")
        for t in held:
            t.unpersist()
        return out


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float)


def _outputs(b: pd.DataFrame, w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Outputs of the layers that a batch has received sums for, before ReLU."""
    z, k = [_stack(b["a"]) @ w["w0"] + w["b0"]], 1
    while f"s{k}" in b:
        z.append(_stack(b[f"s{k}"]) / b["degree"].to_numpy()[:, None] + w[f"b{k}"])
        k += 1
    return z


def _slopes(b: pd.DataFrame, w: dict[str, np.ndarray], each: np.ndarray, parts: tuple[int, ...], down_to: int = 1) -> dict[int, np.ndarray]:
    """Gradients of the loss with respect to the outputs of layers, by the number of the layer from 0."""
    z, n = _outputs(b, w), len(w) // 2
    y, taught = b["y"].to_numpy(), b["part_of"].isin(parts).to_numpy() & b["y"].isin([0, 1]).to_numpy()
    d = np.where(taught[:, None], gnn._softmax(z[-1]), 0.0)
    d[taught, y[taught]] -= 1
    out = {n - 1: d * np.where(taught, each[np.clip(y, 0, 1)], 0.0)[:, None]}
    for k in range(n - 1, down_to - 1, -1):
        out[k - 1] = (_stack(b[f"t{k}"]) @ w[f"w{k}"].T) * (z[k - 1] > 0)
    return out


def _gradients(b: pd.DataFrame, w: dict[str, np.ndarray], each: np.ndarray, parts: tuple[int, ...]) -> list[np.ndarray]:
    """A batch's share of all weights' gradients, and of the validation loss and its rows."""
    z, d, out = _outputs(b, w), _slopes(b, w, each, parts), []
    for k in range(len(z)):
        at = _stack(b["a"]).T @ d[0] if k == 0 else np.maximum(z[k - 1], 0).T @ _stack(b[f"t{k}"])
        out += [at.ravel(), d[k].sum(0)]
    held = (b["part_of"] == 1).to_numpy() & b["y"].isin([0, 1]).to_numpy()
    p = gnn._softmax(z[-1])[held, b["y"].to_numpy()[held]]
    return [*out, np.array([-np.log(np.clip(p, 1e-12, 1)).sum(), held.sum()])]


def run(e: DataFrame, nodes: DataFrame, columns: list[str], params: dict, epochs: int = 200, patience: int = 10, seed: int = 42) -> tuple[DataFrame, dict]:
    """``id, split, y, p0, emb`` of every node, and what training found.

    The weights of the best validation loss score the validation rows; all other rows
    are scored by weights refitted on training and validation rows for as many epochs.
    """
    tables = Tables(e, nodes, columns)
    try:
        first, info = tables.train(params, epochs, patience, seed)
        early = tables.outputs(first)
        late = tables.outputs(tables.refit(params, info["best_epoch"] + 1, seed))
    finally:
        tables.close()
    chosen = late.join(early.select("id", F.col("p0").alias("_early")), "id")
    return chosen.withColumn("p0", F.when(F.col("split") == "validation", F.col("_early")).otherwise(F.col("p0"))).drop("_early"), info
