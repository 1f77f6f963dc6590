"""Spectral and heat-kernel embeddings per connected component."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.functions.storage import dense_index, materialize
from txloom.operators.eigen import X, smallest_pairs
from txloom.operators.graph import components, degrees
from txloom.operators.indicators import gw_scales

SMALL = 50
#: Nodes up to which a component's spectral vectors are solved densely in one task, many components side by side; larger ones by joins.
IN_TASK = 1000
#: Nodes up to which a component is solved densely; larger ones by block iteration.
DENSE = 5000


def _matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ids, and the entries of D^-1/2 A D^-1/2."""
    ids = sorted(set(pdf["src"]) | set(pdf["dst"]))
    place = {v: i for i, v in enumerate(ids)}
    i, j = pdf["src"].map(place).to_numpy(), pdf["dst"].map(place).to_numpy()
    d = np.bincount(i, minlength=len(ids)).astype(float)
    return ids, i, j, 1 / np.sqrt(d[i] * d[j])


def _subspace(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, k: int, width: int, rounds: int, tol: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Block iteration of the given width; None where it has not converged."""
    step = lambda x: x + _times(n, i, j, w, x)
    x = np.random.default_rng(42).normal(size=(n, min(n, width)))
    for _ in range(rounds):
        for _ in range(4):
            x = step(x)
        x, _ = np.linalg.qr(x)
        y = step(x)
        theta, s = np.linalg.eigh(x.T @ y)
        x, y, theta = x @ s[:, ::-1], y @ s[:, ::-1], theta[::-1]
        if np.linalg.norm(y[:, :k] - x[:, :k] * theta[:k], axis=0).max() <= tol:
            return 2 - theta[:k], x[:, :k]
    return None


def _times(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """N x for entries sorted or not: sums of rows, a column at a time."""
    return np.stack([np.bincount(i, w * x[j, c], n) for c in range(x.shape[1])], 1)


def smallest(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, k: int, rounds: int = 3000, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` smallest eigenpairs of I - N, N given by entries; signs are fixed by the largest entry.

    Iterates until every pair's residual is at most ``tol`` and raises where ``rounds``
    do not suffice; a wider block is tried before.
    """
    if n <= DENSE:
        a = np.eye(n)
        np.subtract.at(a, (i, j), w)
        values, vectors = np.linalg.eigh(a)
        values, vectors = values[:k], vectors[:, :k]
    else:  # subspace iteration on I + N, whose largest pairs are wanted
        values, vectors = _subspace(n, i, j, w, k, k + 8, rounds // 3, tol) or _subspace(n, i, j, w, k, 2 * k + 16, rounds, tol) or (None, None)
        if values is None:
            raise RuntimeError(f"{k} eigenpairs of {n} nodes did not converge in {rounds} rounds")
    top = np.abs(vectors).argmax(0)
    return values, vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1, 1)


def spectral(u: DataFrame, dims: int = 64, comp: DataFrame | None = None, in_task: int = IN_TASK) -> DataFrame:
    """``id, emb``: non-trivial Laplacian eigenvectors of each component.

    Components of up to 50 nodes get degree over largest degree in the first place
    only, which is plain SQL; single nodes zeros.  Components of up to ``in_task`` nodes
    are dense problems of tasks; each larger one is iterated by joins over the cluster.
    """
    comp = materialize(comp or components(u), "sp-comp")
    d = degrees(u)
    sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    sized = comp.join(sizes, "comp")
    small = sized.filter(F.col("n") <= SMALL).join(d, "id", "left")
    most = small.groupBy("comp").agg(F.max("d").alias("most"))
    first = F.coalesce(F.col("d") / (F.col("most") + 1e-9), F.lit(0.0))
    small = small.join(most, "comp").select("id", F.concat(F.array(first), F.array_repeat(F.lit(0.0), dims - 1)).alias("emb"))
    rows = u.join(sized.filter((F.col("n") > SMALL) & (F.col("n") <= in_task)), u.src == F.col("id")).select("comp", "src", "dst")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, i, j, w = _matrix(pdf)
        values, vectors = smallest(len(ids), i, j, w, wanted(dims, len(ids)))
        keep = vectors[:, values > 1e-9][:, :dims]
        out = np.zeros((len(ids), dims))
        out[:, : keep.shape[1]] = keep
        return pd.DataFrame({"id": ids, "emb": list(out)})

    out = small.unionByName(rows.groupBy("comp").applyInPandas(run, "id string, emb array<double>"))
    for r in sizes.filter(F.col("n") > max(SMALL, in_task)).orderBy("comp").collect():  # a row a giant component
        out = out.unionByName(_giant(u.join(comp.filter(F.col("comp") == r["comp"]), u.src == F.col("id")).select("src", "dst"), r["n"], dims))
    return out


def wanted(dims: int, n: int) -> int:
    """Eigenpairs computed for ``dims`` vectors of ``n`` nodes; the first is trivial."""
    return min(dims + 4, 128, n - 1)


def _giant(u: DataFrame, n: int, dims: int) -> DataFrame:
    """``id, emb`` of one connected symmetric edge table."""
    d = degrees(u)
    ids = materialize(dense_index(d, "id", "node").select("id", "d", F.col("node").cast("long").alias("node")), "sp-ids")
    ends = u.join(ids.toDF("src", "da", "a"), "src").join(ids.toDF("dst", "db", "b"), "dst")
    entries = materialize(ends.select("a", "b", (1.0 / F.sqrt(F.col("da") * F.col("db"))).alias("w")), "sp-entries")
    values, vectors = smallest_pairs(entries, wanted(dims, n))
    row = F.sort_array(F.collect_list(F.struct("g", F.array(*X).alias("x"))))
    whole = vectors.groupBy("node").agg(F.flatten(F.transform(row, lambda x: x["x"])).alias("v"))  # a few groups a node
    first = int((values <= 1e-9).sum())
    kept = min(dims, len(values) - first)
    emb = F.concat(F.slice("v", first + 1, kept), F.array_repeat(F.lit(0.0), dims - kept))
    return ids.join(whole, "node").select("id", emb.alias("emb"))


def heat_moments(values: np.ndarray, vectors: np.ndarray, scales: list[float], block: int = 1024) -> np.ndarray:
    """Mean, deviation, median, largest and smallest entry of every heat kernel row, scale by scale."""
    out = np.empty((len(vectors), 5 * len(scales)))
    for t, tau in enumerate(scales):
        right = (vectors * np.exp(-tau * values)).T
        for at in range(0, len(vectors), block):
            rows = vectors[at : at + block] @ right
            out[at : at + block, 5 * t : 5 * t + 5] = np.stack([rows.mean(1), rows.std(1), np.median(rows, 1), rows.max(1), rows.min(1)], 1)
    return out


def graphwave(u: DataFrame, dims: int = 64, seed: int = 42, pairs: int = 32, large: int = 1000, comp: DataFrame | None = None) -> DataFrame:
    """``id, emb``: heat kernel moments at six scales, projected by one Gaussian matrix."""
    scales = gw_scales()
    project = np.random.default_rng(seed).normal(scale=1 / np.sqrt(dims), size=(5 * len(scales), dims))  # fixed size
    comp = comp or components(u)
    rows = u.join(comp, u.src == comp.id).select("comp", "src", "dst")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, i, j, w = _matrix(pdf)
        n = len(ids)
        values, vectors = smallest(n, i, j, w, pairs if n >= large else min(n - 1, pairs) or 1)
        return pd.DataFrame({"id": ids, "emb": list(heat_moments(values, vectors, scales) @ project)})

    return rows.groupBy("comp").applyInPandas(run, "id string, emb array<double>")
