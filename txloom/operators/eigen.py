"""Smallest eigenpairs of normalised Laplacians as joins: a filtered subspace iteration.

A block of vectors is a table ``node, g, x0 … x15, p0 … p15`` with WIDTH of its columns a
row.  A product with the Laplacian joins the block to the edges and sums by node; an edge
from each node to itself carries the row's own values along, so the three-term recurrence
of a Chebyshev filter reads the block once a step and several steps are one job.  Between
filters, a Rayleigh-Ritz step takes the block's Gram matrices, which are summed in tasks
and by Spark; only their entries (the square of the block's columns) reach the driver, and
only the rotation goes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.functions.storage import drop, materialize

#: Columns of a row.
WIDTH = 16
X, P = [f"x{i}" for i in range(WIDTH)], [f"p{i}" for i in range(WIDTH)]
BLOCK = "node long, g int, " + ", ".join(f"{c} double" for c in [*X, *P])


def _step(block: DataFrame, links: DataFrame, scale: float, shift: float, keep: float) -> DataFrame:
    """``scale · (L - shift) x - keep · p`` as x, and x as p."""
    own = F.col("a") == F.col("b")
    coefficient = F.lit(scale) * F.when(own, F.lit(1.0 - shift)).otherwise(-F.col("w"))
    met = block.join(links, block.node == links.b).select("a", "g", own.alias("own"), coefficient.alias("c"), *X, *P)
    new = [F.sum(F.col("c") * F.col(x) - F.when(F.col("own"), F.lit(keep) * F.col(p)).otherwise(0.0)).alias(x) for x, p in zip(X, P)]
    old = [F.sum(F.when(F.col("own"), F.col(x)).otherwise(0.0)).alias(p) for x, p in zip(X, P)]
    return met.groupBy(F.col("a").alias("node"), "g").agg(*new, *old)


def _filtered(block: DataFrame, links: DataFrame, cut: float, degree: int) -> DataFrame:
    """A Chebyshev polynomial of the Laplacian that is small on [cut, 2] and grows below it."""
    half, middle = (2 - cut) / 2, (2 + cut) / 2
    block = _step(block, links, 1 / half, middle, 0.0)
    for _ in range(degree - 1):
        block = _step(block, links, 2 / half, middle, 1.0)
    return block


def _whole_nodes(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes with all their columns, x and p, from rows sorted by node and group."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        n = table.num_rows // groups
        rest = table.slice(n * groups).to_batches()
        if n:
            values = np.stack([table.column(i).slice(0, n * groups).to_numpy() for i in range(2, 2 + 2 * WIDTH)], 1)
            yield table.column(0).slice(0, n * groups).to_numpy()[::groups], *(values[:, k : k + WIDTH].reshape(n, groups * WIDTH) for k in (0, WIDTH))


def _together(block: DataFrame) -> DataFrame:
    return block.repartition("node").sortWithinPartitions("node", "g").select("node", "g", *X, *P)


def _grams(block: DataFrame, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PᵀP, PᵀX and XᵀX of a block whose x is the Laplacian times its p."""
    m = groups * WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, m, m))
        for _, y, x in _whole_nodes(batches, groups):
            sums += np.stack([x.T @ x, x.T @ y, y.T @ y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * m)), *[pa.array(s.ravel()) for s in sums]], ["at", "pp", "px", "xx"])

    summed = _together(block).mapInArrow(run, "at long, pp double, px double, xx double").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("pp", "px", "xx")])
    out = np.zeros((3, m * m))
    for r in summed.collect():  # an entry of the matrices each
        out[:, r["at"]] = r["pp"], r["px"], r["xx"]
    return tuple(s.reshape(m, m) for s in out)


def _rotated(block: DataFrame, groups: int, turn: np.ndarray) -> DataFrame:
    """The block p · turn as x, with zeros as p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, x in _whole_nodes(batches, groups):
            values = (x @ turn).reshape(-1, WIDTH)
            none = pa.array(np.zeros(len(values)))
            columns = [pa.array(np.repeat(ids, groups)), pa.array(np.tile(np.arange(groups, dtype=np.int32), len(ids)))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in np.ascontiguousarray(values.T)], *[none] * WIDTH], ["node", "g", *X, *P])

    return _together(block).mapInArrow(run, BLOCK)


def ritz(pp: np.ndarray, px: np.ndarray, xx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, rotation and residuals of the Rayleigh-Ritz pairs; directions that the block does not have are left out."""
    scale, axes = np.linalg.eigh((pp + pp.T) / 2)
    axes = axes[:, scale > 1e-12 * scale[-1]] / np.sqrt(scale[scale > 1e-12 * scale[-1]])
    inner = axes.T @ px @ axes
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    turn = axes @ turn
    return values, turn, np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, xx, turn) - values**2, 0))


def smallest_pairs(entries: DataFrame, k: int, seed: int = 42, degree: int = 8, tol: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, DataFrame]:
    """The ``k`` smallest eigenvalues of I - N and ``node, g, x…`` of their vectors (column i is x of i mod 16 in group i div 16).

    ``entries(a, b, w)`` are N of a connected graph with numbered nodes, both directions.
    Iterates until every residual is at most ``tol`` and raises after ``rounds``.  Each vector's entry of
    largest size is positive.
    """
    groups = -(-(k + WIDTH) // WIDTH)
    ids = entries.select(F.col("a").alias("node")).distinct()
    links = materialize(entries.select("a", "b", "w").unionByName(ids.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("w"))), "eig-links")
    draw = [(F.xxhash64("node", F.col("g") * WIDTH + i, F.lit(seed)) / F.lit(2.0**63)).alias(x) for i, x in enumerate(X)]
    block = ids.select("node", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")).select("node", "g", *draw, *[F.lit(0.0).alias(p) for p in P])
    cut, held = 1.0, None
    for _ in range(rounds):
        new = materialize(_step(_filtered(block, links, cut, degree), links, 1.0, 0.0, 0.0), "eig")
        if held is not None:
            drop(held)
        held = new
        values, turn, residuals = ritz(*_grams(held, groups))
        full = np.zeros((groups * WIDTH, groups * WIDTH))
        full[:, : turn.shape[1]] = turn
        block = _rotated(held, groups, full)
        if len(values) >= k and residuals[:k].max() <= tol:
            return values[:k], _signed(materialize(block, "eig-vectors"), groups)
        cut = min(1.9, max(values[-1], 1e-3))
    raise RuntimeError(f"{k} eigenpairs did not converge in {rounds} rounds")


def _signed(block: DataFrame, groups: int) -> DataFrame:
    tops = block.groupBy("g").agg(*[F.max(F.struct(F.round(F.abs(x), 9).alias("size"), (-F.col("node")).alias("first"), F.col(x).alias("value")))["value"].alias(x) for x in X])
    signs = tops.select("g", *[F.when(F.col(x) < 0, -1.0).otherwise(1.0).alias(f"s_{x}") for x in X])
    return block.join(F.broadcast(signs), "g").select("node", "g", *[(F.col(x) * F.col(f"s_{x}")).alias(x) for x in X])  # a row a group
