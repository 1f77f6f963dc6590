"""Gradient boosting over histograms: second-order sums a bin, L1 and L2, early stopping.

A pass over the rows grows all nodes of a tree's level.  Tasks sum gradients by node,
feature and bin; the sums, of which a task sends a row a feature, are added up on the
driver, before it where tasks are many, and give the best cut of every node.  Rows are binned once; their margins are
stored every few trees, so a pass applies at most that many trees.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txloom.functions.storage import drop, materialize

#: Cuts a feature, so that a bin is a byte.
CUTS = 255
#: Trees between two writings of the margins.
KEPT = 10
#: Tasks up to which the driver adds their sums itself.
GATHERED = 64
_LOSS = -1  # the feature under which a pass reports the validation loss


def cuts(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """Up to :data:`CUTS` values a column, its least one left out, between which rows are told apart."""
    at = F.array(*[F.lit(k / (CUTS + 1)) for k in range(1, CUTS + 2)])
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    least = [F.min(clean[c]).alias(f"l{k}") for k, c in enumerate(columns)]
    found = rows.agg(*[F.percentile_approx(clean[c], at, F.lit(100_000)).alias(f"q{k}") for k, c in enumerate(columns)], *least).first()
    return [sorted({q for q in (found[f"q{k}"] or []) if q > found[f"l{k}"]})[:CUTS] for k in range(len(columns))]


def _binned(df: DataFrame, columns: list[str], edges: list[list[float]]) -> Column:
    @F.pandas_udf("binary")
    def to_bytes(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        m = np.stack(x.to_list()).astype(float)
        cells = np.stack([np.where(np.isnan(m[:, k]), 0, np.searchsorted(c, m[:, k], "right")) for k, c in enumerate(edges)], 1)
        return pd.Series([r.tobytes() for r in cells.astype(np.uint8)])

    return to_bytes(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns]))


def _reach(cells: np.ndarray, tree: dict, steps: int) -> np.ndarray:
    """The node of a tree, kept as a heap, that every row of bins reaches within ``steps``."""
    at, feature, bins = np.zeros(len(cells), int), np.array(tree["feature"]), np.array(tree["bin"])
    rows = np.arange(len(cells))
    for _ in range(steps):
        f = feature[at]
        at = np.where(f >= 0, 2 * at + 1 + (cells[rows, np.maximum(f, 0)] > bins[at]), at)
    return at


def _added(cells: np.ndarray, trees: list[dict]) -> np.ndarray:
    out = np.zeros(len(cells))
    for t in trees:
        out += np.array(t["value"])[_reach(cells, t, t["depth"])]
    return out


def _drawn(u: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether rows belong to a tree's sample, by a mix of their hash and the tree's number."""
    if share >= 1:
        return np.ones(len(u), bool)
    with np.errstate(over="ignore"):
        z = u.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (tree + 1)) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) / 2.0**64 < share


def _sums(b: pd.DataFrame, wide: int, trees: list[dict], tree: dict, level: int, number: int, share: float, used: list[int], grows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums ``(node of the level, used feature, bin, g or h)`` of a batch; at level 0 the validation loss and its weight too."""
    cells = np.frombuffer(b"".join(b["bins"]), np.uint8).reshape(len(b), wide)
    held, out, loss = b["held"].to_numpy(bool), np.zeros((2**level, len(used), 256, 2)), np.zeros(2)
    node = _reach(cells, tree, level)
    take = np.flatnonzero(~held & grows[node] & _drawn(b["u"].to_numpy(), number, share))
    rows = np.arange(len(b)) if level == 0 and held.any() else take  # the loss is of all held rows
    y, w = b["y"].to_numpy(float), b["w"].to_numpy(float)
    p = np.zeros(len(b))
    p[rows] = 1 / (1 + np.exp(-(b["margin"].to_numpy(float)[rows] + _added(cells[rows], trees))))
    if level == 0 and held.any():
        q = np.clip(np.where(y > 0, p, 1 - p)[held], 1e-15, 1)
        loss += [-np.log(q).sum(), held.sum()]
    p, y, w = p[take], y[take], w[take]
    g, h = w * (p - y), w * p * (1 - p)
    at = (node[take] - (2**level - 1)) * 256
    for k, f in enumerate(used):
        bins = at + cells[take, f]
        out[:, k, :, 0] += np.bincount(bins, g, 256 * 2**level).reshape(-1, 256)
        out[:, k, :, 1] += np.bincount(bins, h, 256 * 2**level).reshape(-1, 256)
    return out, loss


def _pass(stored: DataFrame, wide: int, trees: list[dict], tree: dict, level: int, number: int, share: float, used: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_sums` of all rows. A task sends its sums of a feature as one row, and these are added before they reach the driver, a row a feature."""
    grows = np.array([k >= 2**level - 1 and tree["open"][k] for k in range(len(tree["open"]))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, loss = np.zeros((2**level, len(used), 256, 2)), np.zeros(2)
        for b in batches:
            if len(b):
                more, lost = _sums(b, wide, trees, tree, level, number, share, used, grows)
                sums += more
                loss += lost
        yield pd.DataFrame({"feature": [*range(len(used)), _LOSS], "cells": [*(sums[:, k].tobytes() for k in range(len(used))), loss.tobytes()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for f, c in zip(b["feature"], b["cells"], strict=True):
                total[f] = total.get(f, 0) + np.frombuffer(c)
        yield pd.DataFrame({"feature": list(total), "cells": [c.tobytes() for c in total.values()]})

    found = stored.mapInPandas(run, "feature int, cells binary")
    if found.rdd.getNumPartitions() > GATHERED:
        found = found.repartition(min(GATHERED, len(used)), "feature").mapInPandas(added, "feature int, cells binary")
    out, loss = np.zeros((2**level, len(used), 256, 2)), np.zeros(2)
    for r in found.collect():
        if r["feature"] == _LOSS:
            loss += np.frombuffer(r["cells"])
        else:
            out[:, r["feature"]] += np.frombuffer(r["cells"]).reshape(-1, 256, 2)
    return out, loss


def _best(sums: np.ndarray, used: list[int], params: dict) -> list[dict | None]:
    """By node its sums ``g, h`` and its best cut ``(feature, bin, gain, gl, hl)``, the least feature and bin of equal ones; none without rows."""
    alpha, lam = float(params.get("alpha", 0.0)), float(params.get("lambda", 1.0))
    least, gamma = float(params.get("child", 1.0)), float(params.get("gamma", 0.0))

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        kept = np.maximum(np.abs(g) - alpha, 0.0)
        return np.divide(kept * kept, h + lam, out=np.zeros(np.broadcast(g, h).shape), where=h + lam > 0)

    out = []
    for cells in sums:
        some = cells.any(2)
        if not some.any():
            out.append(None)
            continue
        run = cells.cumsum(1)
        gl, hl = run[..., 0], run[..., 1]
        g, h = gl[:, -1:], hl[:, -1:]
        gain = (score(gl, hl) + score(g - gl, h - hl) - score(g, h)) / 2 - gamma
        last = 255 - some[:, ::-1].argmax(1)[:, None]
        fine = some & (np.arange(256) < last) & (hl >= least) & (h - hl >= least) & (gain > 1e-12)
        gain = np.round(gain, 12)
        at, cut = int(np.where(fine, gain, -np.inf).argmax()), None  # the first of equal ones
        if fine.flat[at]:
            k, b = divmod(at, 256)
            cut = used[k], b, float(gain[k, b]), float(gl[k, b]), float(hl[k, b])
        out.append({"g": float(g[0, 0]), "h": float(h[0, 0]), "cut": cut})
    return out


def fit(rows: DataFrame, columns: list[str], params: dict, held: DataFrame | None = None, key: str = "tx_id", patience: int = 50) -> dict:
    """A model of ``target`` (0 or 1) over ``columns`` as plain values.

    ``rows`` may carry a column ``weight``.  With ``held`` rows training stops when their
    log loss has not fallen for ``patience`` trees, and the trees up to the least loss are
    kept; ``best`` is their number.  Empty ``held`` rows stop nothing.  Parameters: ``trees, depth, lr, subsample, columns,
    child, gamma, alpha, lambda, seed``.  Nulls and NaN go left.  Without rows of both
    classes or without a cut that gains, trees are single leaves.
    """
    weighted = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
    edges = cuts(rows, columns)
    shaped = lambda df, w, is_held: df.select(_binned(df, columns, edges).alias("bins"), F.col("target").cast("double").alias("y"), w.alias("w"), F.xxhash64(F.col(key).cast("string"), F.lit(int(params.get("seed", 42)))).alias("u"), F.lit(is_held).alias("held"))
    all_rows = shaped(rows, weighted, False)
    if held is not None:
        all_rows = all_rows.union(shaped(held, F.lit(1.0), True))
    mean = rows.agg(F.sum(weighted * F.col("target")) / F.sum(weighted)).first()[0]
    start = math.log(min(max(mean or 0.0, 1e-6), 1 - 1e-6) / (1 - min(max(mean or 0.0, 1e-6), 1 - 1e-6)))
    stored = _dealt(materialize(all_rows.withColumn("margin", F.lit(start)), "boost")).persist(StorageLevel.MEMORY_AND_DISK)
    r, depth, rate = random.Random(int(params.get("seed", 42))), int(params.get("depth", 4)), float(params.get("lr", 0.1))
    alpha, lam = float(params.get("alpha", 0.0)), float(params.get("lambda", 1.0))
    leaf = lambda g, h: -math.copysign(max(abs(g) - alpha, 0.0), g) / (h + lam) * rate if h + lam > 0 else 0.0
    trees, fresh, losses, best = [], [], [], 0
    gains = [0.0] * len(columns)
    wanted = int(params.get("trees", 50))
    for number in range(wanted + (held is not None)):
        used = sorted(r.sample(range(len(columns)), max(1, round(float(params.get("columns", 1.0)) * len(columns)))))
        size = 2 ** (depth + 1) - 1
        tree = {"feature": [-1] * size, "bin": [0] * size, "value": [0.0] * size, "open": [True] + [False] * (size - 1), "depth": 0}
        stop = number == wanted
        for level in range(1 if stop else depth):
            if not any(tree["open"]):
                break
            sums, loss = _pass(stored, len(columns), fresh, tree, level, number, float(params.get("subsample", 1.0)), used)
            found = {2**level - 1 + k: x for k, x in enumerate(_best(sums, used, params)) if x}
            if level == 0 and loss[1]:
                losses.append(float(loss[0] / loss[1]))
                best = min(range(len(losses)), key=losses.__getitem__)
                if stop := stop or number - best >= patience:
                    break
            grown, tree["open"] = tree["open"], [False] * size
            for v in (k for k in range(size) if grown[k] and k in found):
                x = found[v]
                if level == 0:
                    tree["value"][v] = leaf(x["g"], x["h"])
                if (c := x["cut"]) is None:
                    continue
                feature, at, gain, gl, hl = c
                tree["feature"][v], tree["bin"][v], tree["depth"] = feature, at, level + 1
                gains[feature] += gain
                for k, g, h in ((2 * v + 1, gl, hl), (2 * v + 2, x["g"] - gl, x["h"] - hl)):
                    tree["value"][k], tree["open"][k] = leaf(g, h), True
        if stop:
            break
        del tree["open"]
        trees.append(tree)
        fresh.append(tree)
        if len(fresh) == KEPT:
            stored, fresh = _stored_margins(stored, len(columns), fresh), []
    stored.unpersist()
    drop(stored)
    if losses:
        trees = trees[:best]
    total = sum(gains)
    return {"columns": list(columns), "start": start, "cuts": edges, "trees": trees, "best": len(trees), "losses": losses, "importance": {c: g / total if total else 0.0 for c, g in zip(columns, gains, strict=True)}}


def _dealt(stored: DataFrame) -> DataFrame:
    """Rows over all cores: small files would be read by few tasks."""
    cores = stored.sparkSession.sparkContext.defaultParallelism
    return stored.repartition(cores) if stored.rdd.getNumPartitions() < cores else stored


def _stored_margins(stored: DataFrame, wide: int, trees: list[dict]) -> DataFrame:
    @F.pandas_udf("double")
    def raised(bins: pd.Series, margin: pd.Series) -> pd.Series:
        return margin + _added(np.frombuffer(b"".join(bins), np.uint8).reshape(len(bins), wide), trees)

    out = _dealt(materialize(stored.withColumn("margin", raised("bins", "margin")), "boost")).persist(StorageLevel.MEMORY_AND_DISK)
    stored.unpersist()
    drop(stored)
    return out


def score(df: DataFrame, model: dict) -> DataFrame:
    """Adds ``p0``, the probability of target 1."""

    @F.pandas_udf("double")
    def margin(bins: pd.Series) -> pd.Series:
        return pd.Series(model["start"] + _added(np.frombuffer(b"".join(bins), np.uint8).reshape(len(bins), len(model["columns"])), model["trees"]))

    return df.withColumn("p0", 1 / (1 + F.exp(-margin(_binned(df, model["columns"], model["cuts"])))))
