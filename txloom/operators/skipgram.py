"""Skip-gram vectors with negative sampling, trained in blocks that meet in turn.

Pairs of nodes within a window of walks are counted first, so training walks over distinct
pairs.  Nodes are dealt into blocks by hash; the vectors of a block of centres and of a
block of contexts are a row each.  In one meeting every block of centres trains with one
block of contexts, all in parallel, on the pairs between them and on contexts drawn from that
block; the next meeting shifts the blocks by one.  A task holds two blocks and a part of their
pairs, never the table of vectors, and results depend on the seed and the blocks only.  Blocks
of a large graph are whole components where these are small, and meet themselves only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.functions.storage import dense_index, drop, materialize
from txloom.operators.graph import components

#: Blocks of a small graph, and nodes of a block of a large one.
BLOCKS, BLOCK_NODES = 8, 100_000
#: Nodes of a block of whole components, and of the largest component in one.
OWN_NODES = 25_000
#: Cells of a table of a batch's pairs.
DENSE = 4_000_000
#: Pairs of a stored row, and of a training step.
PART_PAIRS, STEP_PAIRS = 500_000, 2048
#: Contexts are drawn by their counts to this power.
POWER = 0.75
ROWS = "meet int, kind int, block int, ids binary, a binary, b binary, c binary"


def _counts(walks: DataFrame, window: int) -> DataFrame:
    """``centre, context, n`` of ``window_pairs`` times ``window``, whole numbers; nodes alone on a walk have a row without context, so one pass over walks finds all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            coded = column.flatten().dictionary_encode()
            names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            walk, size = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), len(names)
            dense, keys, weights = size * size <= DENSE, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            table = np.zeros(size * size if dense else 0, np.int64)
            for d in range(1, min(window, len(code) - 1) + 1):
                same = walk[:-d] == walk[d:]
                key = code[:-d][same] * size + code[d:][same]
                if dense:
                    table += np.bincount(key, minlength=len(table)) * (window - d + 1)
                else:
                    found, times = np.unique(key, return_counts=True)
                    keys.append(found)
                    weights.append(times * (window - d + 1))
            if dense:
                table = (table.reshape(size, size) + table.reshape(size, size).T).ravel()
                key = np.flatnonzero(table)
                sums = table[key]
            else:
                every = np.concatenate(keys)
                key, at = np.unique(np.concatenate([every, every % size * size + every // size]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([*weights, *weights]), len(key)).astype(np.int64)
            alone = np.setdiff1d(np.arange(size), key // max(size, 1))
            centre, context = np.concatenate([key // max(size, 1), alone]), np.concatenate([key % max(size, 1), alone])
            context = pa.array(context, mask=np.arange(len(context)) >= len(key))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(centre)), names.take(context), pa.array(np.concatenate([sums, 0 * alone]))], ["centre", "context", "n"])

    return walks.select("walk").mapInArrow(run, "centre string, context string, n long").groupBy("centre", "context").agg(F.sum("n").alias("n"))


def window_pairs(walks: DataFrame, window: int) -> DataFrame:
    """``centre, context, n``: pairs at most ``window`` steps apart on ``walk``; at distance d a pair counts ``(window - d + 1) / window``, the chance that a window of random size has it."""
    return _counts(walks, window).filter(F.col("context").isNotNull()).withColumn("n", F.col("n") / window)


def _dealt(numbered: DataFrame, pairs: DataFrame, seed: int, blocks: int | None) -> tuple[DataFrame, int, int]:
    """``numbered`` with ``block``, the number of blocks that train by themselves, and of those that meet in turn.

    Blocks that meet in turn move the table of vectors once a block, so their moves grow
    with the square of the nodes.  A graph of more than ``BLOCKS * BLOCK_NODES`` nodes is
    dealt by components instead: no pair leaves one, so a block of whole components meets
    itself only.  Nodes of components of more than ``OWN_NODES`` nodes still meet in turn.
    """
    hashed = lambda c, n: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    nodes = numbered.count()
    if blocks or nodes <= BLOCKS * BLOCK_NODES:
        count = blocks or BLOCKS
        return numbered.withColumn("block", hashed("node", count)), 0, count
    linked = components(pairs.select(F.col("centre").alias("src"), F.col("context").alias("dst")))
    placed = materialize(numbered.join(linked, "id", "left").select(numbered["*"], F.coalesce("comp", "id").alias("comp")), "sg-placed")
    wide = materialize(placed.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > OWN_NODES), "sg-wide")
    turning = wide.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = -(-(nodes - turning) // OWN_NODES)
    meeting = max(BLOCKS, -(-turning // BLOCK_NODES)) if turning else 1
    marked = placed.join(F.broadcast(wide.select("comp", F.lit(True).alias("wide"))), "comp", "left")
    block = F.when(F.col("wide"), own + hashed("node", meeting)).otherwise(hashed("comp", max(own, 1)))
    return materialize(marked.select("id", "node", "weight", block.cast("int").alias("block")), "sg-dealt"), own, meeting


def _start(block_ids: DataFrame, dims: int, seed: int, kind: int) -> DataFrame:
    """A row a block: numbers, vectors (small and random for centres, zero for contexts), sums of squared gradients, drawing weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for block, node, weight in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(block, []).append((node, weight))
        for block, nodes in held.items():
            ids, weights = (np.array(x) for x in zip(*sorted(nodes)))
            vectors = np.random.default_rng([seed, block]).uniform(-0.5 / dims, 0.5 / dims, (len(ids), dims)) if kind == 0 else np.zeros((len(ids), dims))
            parts = [ids.astype(np.int64), vectors.astype(np.float32), np.zeros(len(ids), np.float32), weights.astype(np.float64)]
            yield pa.RecordBatch.from_pylist([dict(zip(("meet", "kind", "block", "ids", "a", "b", "c"), (0, kind, block, *(p.tobytes() for p in parts))))], schema=_schema())

    return block_ids.select("block", "node", "weight").repartition("block").mapInArrow(run, ROWS)


def _schema() -> pa.Schema:
    return pa.schema([*[(c, pa.int32()) for c in ("meet", "kind", "block")], *[(c, pa.binary()) for c in ("ids", "a", "b", "c")]])


def _packed(pairs: DataFrame) -> DataFrame:
    """Pairs ``c, x, n`` with their blocks, packed in rows of up to PART_PAIRS; ``meet`` is the block of centres, ``block`` that of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            c, x, n = (np.concatenate(v) for v in zip(*held))
            return pa.RecordBatch.from_pylist([{"meet": int(key[0]), "kind": 2, "block": int(key[1]), "ids": b"", "a": c.tobytes(), "b": x.tobytes(), "c": n.tobytes()}], schema=_schema())

        for batch in batches:
            cb, xb, c, x, n = (col.to_numpy() for col in batch.columns)
            cuts = np.flatnonzero(np.diff(cb * (1 << 31) + xb, prepend=-1)).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(cb)]):
                if held and (key != (cb[i], xb[i]) or size >= PART_PAIRS):
                    yield out()
                    held, size = [], 0
                key, size = (cb[i], xb[i]), size + j - i
                held.append((c[i:j], x[i:j], n[i:j].astype(np.float32)))
        if held:
            yield out()

    ordered = pairs.repartition("cb", "xb").sortWithinPartitions("cb", "xb", "c", "x")
    return ordered.select(F.col("cb").cast("long"), F.col("xb").cast("long"), "c", "x", "n").mapInArrow(run, ROWS)


def _apply(vectors: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradients: np.ndarray, rate: float) -> None:
    """One Adagrad step upwards; a row's gradients are summed first."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    begins = np.flatnonzero(np.diff(ordered, prepend=-1))
    own, times = ordered[begins], np.diff(begins, append=len(rows))
    if times.max() > 32:
        sums = np.zeros((len(own), vectors.shape[1]), np.float32)
        np.add.at(sums, np.repeat(np.arange(len(own)), times), gradients[order])
    else:  # the first gradient of every row, then every second one, …: the same sums in the same order
        sums, live, k = gradients[order[begins]], np.flatnonzero(times > 1), 1
        while live.size:
            sums[live] += gradients[order[begins[live] + k]]
            k += 1
            live = live[times[live] > k]
    squares[own] += (sums * sums).mean(1)
    vectors[own] += rate * sums / np.sqrt(squares[own] + 1e-10)[:, None]


def train(u: np.ndarray, u2: np.ndarray, v: np.ndarray, v2: np.ndarray, weights: np.ndarray, c: np.ndarray, x: np.ndarray, n: np.ndarray, negative: int, rate: float, passes: int, rng: np.random.Generator) -> None:
    """Trains centres ``u`` and contexts ``v`` in place on pairs of weight ``n`` and drawn contexts."""
    sums = np.cumsum(weights**POWER)
    n = (n / n.mean()).astype(np.float32)
    for _ in range(passes):
        order = rng.permutation(len(c))
        for k in range(0, len(c), STEP_PAIRS):
            i, j, w = c[order[k : k + STEP_PAIRS]], x[order[k : k + STEP_PAIRS]], n[order[k : k + STEP_PAIRS]]
            drawn = np.minimum(np.searchsorted(sums, rng.random((len(i), negative)) * sums[-1], "right"), len(v) - 1)
            near, far = u[i], v[drawn]
            up = w / (1 + np.exp(np.clip((near * v[j]).sum(1), -30, 30)))
            down = w[:, None] / (1 + np.exp(-np.clip(np.einsum("id,ikd->ik", near, far), -30, 30))) * (drawn != j[:, None])
            step_u = up[:, None] * v[j] - np.einsum("ik,ikd->id", down, far)
            step_v = np.concatenate([up[:, None] * near, (-down[:, :, None] * near[:, None, :]).reshape(-1, near.shape[1])])
            _apply(u, u2, i, step_u, rate)
            _apply(v, v2, np.concatenate([j, drawn.ravel()]), step_v, rate)


def _meeting(dims: int, negative: int, rate: float, passes: int, seed: list[int]):
    """Rows of a meeting, sorted by it and by kind, to its trained blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        meet, part = None, 0

        def out() -> Iterator[pa.RecordBatch]:
            for kind, (block, ids, vectors, squares, weights) in held.items():
                values = (0, kind, block, *(p.tobytes() for p in (ids, vectors, squares, weights)))
                yield pa.RecordBatch.from_pylist([dict(zip(("meet", "kind", "block", "ids", "a", "b", "c"), values))], schema=_schema())

        for batch in batches:
            for r in batch.to_pylist():
                if r["meet"] != meet:
                    yield from out()
                    held, meet, part = {}, r["meet"], 0
                if r["kind"] < 2:
                    held[r["kind"]] = [r["block"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["a"], np.float32).reshape(-1, dims).copy(), np.frombuffer(r["b"], np.float32).copy(), np.frombuffer(r["c"], np.float64)]
                else:
                    (_, own, u, u2, _), (_, other, v, v2, weights) = held[0], held[1]
                    c, x, n = np.searchsorted(own, np.frombuffer(r["a"], np.int64)), np.searchsorted(other, np.frombuffer(r["b"], np.int64)), np.frombuffer(r["c"], np.float32)
                    train(u, u2, v, v2, weights, c, x, n, negative, rate, passes, np.random.default_rng([*seed, meet, part]))
                    part += 1
        yield from out()

    return run


def skipgram(walks: DataFrame, dims: int = 64, window: int = 10, epochs: int = 5, negative: int = 10, seed: int = 42, rate: float = 0.1, passes: int = 4, blocks: int | None = None) -> DataFrame:
    """``id, emb`` of the nodes on ``walk``.

    An epoch lets every block of centres meet every block of contexts once, with
    ``passes`` passes over their pairs each.  Nodes alone on their walks have no pairs and keep their
    first vector.
    """
    counted = materialize(_counts(walks, window), "sg-pairs")
    pairs = counted.filter(F.col("context").isNotNull()).withColumn("n", F.col("n") / window)
    ids = counted.select(F.col("centre").alias("id")).distinct()
    numbered = dense_index(ids, "id", "node").select("id", F.col("node").cast("long").alias("node"))
    weights = pairs.groupBy(F.col("context").alias("id")).agg(F.sum("n").alias("weight"))
    numbered = materialize(numbered.join(weights, "id", "left").select("id", "node", F.coalesce("weight", F.lit(0.0)).alias("weight")), "sg-ids")
    dealt, own, count = _dealt(numbered, pairs, seed, blocks)
    of = lambda name: dealt.select(F.col("id").alias({"c": "centre", "x": "context"}[name]), F.col("node").alias(name), F.col("block").alias(f"{name}b"))
    packed = materialize(_packed(pairs.join(of("c"), "centre").join(of("x"), "context").select("c", "x", "n", "cb", "xb")), "sg-packed")
    state = materialize(_start(dealt, dims, seed, 0).unionByName(_start(dealt, dims, seed, 1)), "sg")
    at_rest, turning = state.filter(F.col("block") < own), state.filter(F.col("block") >= own)
    turn = lambda c, by: F.when(c < own, c).otherwise(own + F.pmod(c - own + by, F.lit(count))).cast("int")
    for epoch in range(epochs):
        for shift in range(count):
            # blocks that train by themselves do so in an epoch's first meeting
            state = at_rest.unionByName(turning) if own and not shift else turning
            home = F.when(F.col("kind") == 0, F.col("block")).otherwise(turn(F.col("block"), -shift))
            met = packed.filter((F.col("block") == turn(F.col("meet"), shift)) & (F.col("meet") >= (own if shift else 0)))
            rows = state.withColumn("meet", home.cast("int")).unionByName(met)
            rows = rows.repartition(own + count if not shift else count, "meet").sortWithinPartitions("meet", "kind", F.length("a"), F.xxhash64("a"))
            new = materialize(rows.mapInArrow(_meeting(dims, negative, rate, passes, [seed, epoch, shift]), ROWS), "sg")
            if shift != 1 or not own:  # the first meeting's files hold the blocks at rest too
                drop(state)
            turning = new.filter(F.col("block") >= own)
            if not shift:
                at_rest = new.filter(F.col("block") < own)
    state = at_rest.unionByName(turning) if own else turning

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids_, a in zip(*(c.to_pylist() for c in batch.columns)):
                nodes, flat = np.frombuffer(ids_, np.int64), np.frombuffer(a, np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims, dtype=np.int32)), pa.array(flat))], ["node", "emb"])

    found = state.filter("kind = 0").select("ids", "a").mapInArrow(vectors, "node long, emb array<float>")
    return numbered.join(found, "node").select("id", "emb")
