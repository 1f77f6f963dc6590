"""Graph neural operators: message passing and attention as joins, training in numpy.

Training here takes a :class:`Graph` of arrays; :mod:`txloom.operators.blocks` runs the
same steps on the blocks of a graph, many in parallel.

``h`` is ``id, x`` with ``x`` an array of doubles; edges are ``src, dst`` in the
direction of messages.
"""

from __future__ import annotations

import functools
import hashlib
import random
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txloom.functions.storage import hash_key, hash_unit
from txloom.operators.models import Space, propose

MESSAGES = {
    "copy_u": lambda u, v: u,
    "u_add_v": lambda u, v: F.zip_with(u, v, lambda a, b: a + b),
    "v_add_u": lambda u, v: F.zip_with(u, v, lambda a, b: a + b),
    "v_sub_u": lambda u, v: F.zip_with(u, v, lambda a, b: b - a),
    "v_mul_u": lambda u, v: F.zip_with(u, v, lambda a, b: a * b),
}
REDUCERS = {"sum": F.sum, "mean": F.avg, "max": F.max}

# The space that networks are searched in.
SPACE = {
    "layers": Space((1, 2, 3, 4)),
    "width_2": Space(tuple(range(8, 128))),
    "width_3": Space(tuple(range(8, 64))),
    "width_4": Space(tuple(range(8, 32))),
    "lr": Space(low=1e-4, high=5e-2, log=True),
    "balancing": Space(("class_weights", "none")),
}

#: Edges up to which a graph is held by one worker (two integers each).
LOCAL_EDGES = 4_000_000


def message_passing(e: DataFrame, h: DataFrame, dims: int, message: str = "copy_u", reduce: str = "sum") -> DataFrame:
    """``id, x``: messages along edges reduced at their targets; nodes without messages get zeros.

    One aggregate a dimension over one shuffle, combined before it.
    """
    sent = e.join(h.toDF("src", "u"), "src").join(h.toDF("dst", "v"), "dst").select("dst", MESSAGES[message](F.col("u"), F.col("v")).alias("m"))
    f = REDUCERS[reduce]
    got = sent.groupBy("dst").agg(*[f(F.col("m")[i]).alias(f"m{i}") for i in range(dims)])
    cells = F.array(*[F.coalesce(F.col(f"m{i}"), F.lit(0.0)) for i in range(dims)])
    return h.select("id").join(got, h.id == got.dst, "left").select("id", cells.alias("x"))


def linear(h: DataFrame, weights: np.ndarray, bias: np.ndarray | None = None, activation: str | None = None) -> DataFrame:
    """``x W + b`` per node, as column expressions over a fixed matrix."""
    bias = np.zeros(weights.shape[1]) if bias is None else bias
    act = {"relu": lambda c: F.greatest(c, F.lit(0.0)), "tanh": F.tanh, None: lambda c: c}[activation]
    cell = lambda j: act(sum((F.col("x")[i] * F.lit(float(weights[i, j])) for i in range(weights.shape[0])), F.lit(float(bias[j]))))
    return h.select("id", F.array(*[cell(j) for j in range(weights.shape[1])]).alias("x"))


def attention(e: DataFrame, scores: Column) -> DataFrame:
    """Adds ``alpha``: softmax of ``scores`` over the edges into each target."""
    by = Window.partitionBy("dst")
    raw = e.withColumn("_s", scores.cast("double"))
    raw = raw.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(by)))
    return raw.withColumn("alpha", F.col("_e") / F.sum("_e").over(by)).drop("_s", "_e")


def gat_layer(e: DataFrame, h: DataFrame, weights: np.ndarray, a_src: np.ndarray, a_dst: np.ndarray, slope: float = 0.2) -> DataFrame:
    """One attention head: leaky scores of projected ends, softmax per target, weighted sum."""
    dims = weights.shape[1]
    z = linear(h, weights)
    along = lambda c, a: sum((F.col(c)[i] * F.lit(float(a[i])) for i in range(dims)), F.lit(0.0))
    ends = e.join(z.toDF("src", "u"), "src").join(z.toDF("dst", "v"), "dst")
    s = along("u", a_src) + along("v", a_dst)
    weighted = attention(ends, F.when(s > 0, s).otherwise(s * slope))
    got = weighted.groupBy("dst").agg(*[F.sum(F.col("alpha") * F.col("u")[i]).alias(f"m{i}") for i in range(dims)])
    return h.select("id").join(got, h.id == got.dst, "left").select("id", F.array(*[F.coalesce(F.col(f"m{i}"), F.lit(0.0)) for i in range(dims)]).alias("x"))


def augment(e: DataFrame, h: DataFrame, drop_edges: float, drop_features: float, dims: int, seed: int, epoch: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges thinned (both directions together) and feature cells zeroed, by hash of seed, epoch and key."""
    lead = f"{seed}|{epoch}"
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    kept = e.filter(hash_unit(F.md5(F.concat_ws("|", F.lit(lead), a, b))) >= drop_edges)
    cell = lambda i: F.when(hash_unit(hash_key(f"{lead}|{i}", "id")) < drop_features, 0.0).otherwise(F.col("x")[i])
    return kept, h.select("id", F.array(*[cell(i) for i in range(dims)]).alias("x"))


def cosine_loss(a: Column, b: Column) -> Column:
    """``2 - 2 cos`` of two vectors."""
    from txloom.functions.columns import cosine

    return 2 - 2 * cosine(a, b)


# -- training on arrays -------------------------------------------------------


@dataclass
class Graph:
    """Arrays of a graph that one worker holds: targets and sources of messages, features, labels, splits."""

    to: np.ndarray
    frm: np.ndarray
    x: np.ndarray
    y: np.ndarray
    split: np.ndarray  # 0 train, 1 validation, 2 test, -1 none
    #: What drops of a node's cells and edges are drawn by; its position where there is none.
    key: np.ndarray | None = None
    #: Rows that the graph answers for, the first ones; those after them only send messages.
    own: int | None = None
    #: Every row has its own loop and no other edge; edges are not given then.
    lone: bool = False

    def __post_init__(self):
        self._runs: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.degree = 1 if self.lone else np.maximum(1, np.bincount(self.to, minlength=len(self.x)))[:, None]
        if self.own is None:
            self.own = len(self.x)

    def runs(self, end: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges in the order of ``end`` (``to`` or ``frm``), where the run of each node begins, and the nodes."""
        if end not in self._runs:
            at = getattr(self, end)
            order = np.argsort(at, kind="stable")
            ordered = at[order]
            starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(at) else np.zeros(0, int)
            self._runs[end] = order, starts, ordered[starts]
        return self._runs[end]

    def sums(self, end: str, values: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Sums by ``end`` of a value an edge, or of the values of nodes that edges are ``at``."""
        order, starts, nodes = self.runs(end)
        out = np.zeros((len(self.x), *values.shape[1:]))
        if len(order):
            out[nodes] = np.add.reduceat(values[order if at is None else at[order]], starts, axis=0)
        return out

    def tops(self, values: np.ndarray) -> np.ndarray:
        """The largest value an edge of every target."""
        order, starts, nodes = self.runs("to")
        out = np.full(len(self.x), -np.inf)
        if len(order):
            out[nodes] = np.maximum.reduceat(values[order], starts)
        return out

    def mean(self, h: np.ndarray) -> np.ndarray:
        return h if self.lone else self.sums("to", h, self.frm) / self.degree

    def mean_back(self, g: np.ndarray) -> np.ndarray:
        """Gradient of :meth:`mean` with respect to its input."""
        return g if self.lone else self.sums("frm", g / self.degree, self.to)

    def first(self) -> np.ndarray:
        """Means of the features, which no weight changes."""
        if "first" not in self._runs:
            self._runs["first"] = self.mean(self.x)
        return self._runs["first"]

    def taught(self, parts: tuple[int, ...]) -> np.ndarray:
        """Own labelled rows of ``parts``."""
        if parts not in self._runs:
            among = np.zeros(self.own, bool)
            for part in parts:
                among |= self.split[: self.own] == part
            self._runs[parts] = np.flatnonzero(among & (self.y[: self.own] >= 0))
        return self._runs[parts]


class Adam:
    def __init__(self, shapes: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.rate, self.decay, self.step = rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in shapes.items()}
        self.v = {k: np.zeros_like(v) for k, v in shapes.items()}

    def update(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.step += 1
        scale = min(1.0, clip / (np.sqrt(sum((g * g).sum() for g in grads.values())) + 1e-12))
        for k, g in grads.items():
            g = g * scale + self.decay * params[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = z - (np.maximum(z[:, :1], z[:, 1:]) if z.shape[1] == 2 else z.max(1, keepdims=True))
    np.exp(e, out=e)
    e /= e[:, :1] + e[:, 1:] if z.shape[1] == 2 else e.sum(1, keepdims=True)
    return e


def _loss(p: np.ndarray, g: Graph, part: int) -> float:
    total, n = held_loss(p, g, part)
    return total / n if n else 0.0


def held_loss(p: np.ndarray, g: Graph, part: int = 1) -> tuple[float, int]:
    """Summed loss of the own rows of a part, and their number."""
    at = g.taught((part,))
    return float(-np.log(np.clip(p[at, g.y[at]], 1e-12, 1)).sum()), len(at)


def _sizes(params: dict, g: Graph) -> list[int]:
    return [g.x.shape[1], *[int(h) for h in params.get("hidden", [16])], 2]


def gcn_forward(g: Graph, w: dict[str, np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Class probabilities, and what each layer multiplies and its output; the last hidden output is the embedding.

    A mean is linear, so layers after the first send ``h W``, which is as wide as their output.
    """
    h, seen, n = g.first(), [], len(w) // 2
    for k in range(n):
        below, z = h, h @ w[f"w{k}"]
        z = g.mean(z) if k else z
        z += w[f"b{k}"]
        h = np.maximum(z, 0, out=z) if k < n - 1 else z
        seen.append((below, h))
    return _softmax(h), seen


def gcn_grads(g: Graph, w: dict[str, np.ndarray], d: np.ndarray, seen: list) -> dict[str, np.ndarray]:
    """Gradients for the output gradient ``d``."""
    out = {}
    for k in range(len(seen) - 1, -1, -1):
        below, h = seen[k]
        if k < len(seen) - 1:
            d *= h > 0
        out[f"b{k}"] = d.sum(0)
        if k:
            d = g.mean_back(d)
        out[f"w{k}"] = below.T @ d
        if k:
            d = d @ w[f"w{k}"].T
    return out


def sloped(p: np.ndarray, g: Graph, parts: tuple[int, ...], each: np.ndarray) -> np.ndarray:
    """Gradient of the outputs: own labelled rows of ``parts``, weighted by class."""
    at, d = g.taught(parts), np.zeros_like(p)
    d[at] = p[at]
    d[at, g.y[at]] -= 1
    d[at] *= each[g.y[at]][:, None]
    return d


def class_shares(n: np.ndarray, balanced: bool) -> np.ndarray:
    """What a taught row of each class weighs, of ``n`` rows a class; the weights of all of them sum to 1."""
    each = n.sum() / (2 * np.maximum(1, n)) if balanced else np.ones(2)
    return each / max(1e-300, float((each * n).sum()))


def init_layers(sizes: list[int], seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {}
    for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        w[f"w{k}"] = r.normal(scale=np.sqrt(2 / (a + b)), size=(a, b))
        w[f"b{k}"] = np.zeros(b)
    return w


def descent(w: dict[str, np.ndarray], params: dict, epochs: int = 200, patience: int = 10, halve: bool = True) -> Generator:
    """Adam until the validation loss has not fallen for more than ``patience`` epochs; returns the weights of the least loss.

    Yields weights and is sent their gradients and validation loss, so the loss that an
    update leads to is known with the gradients of the next one.  The rate halves after
    more than five epochs without gain.
    """
    adam = Adam(w, params.get("lr", 0.01), params.get("decay", 0.0))
    best, least, wait, plateau, best_epoch = None, np.inf, 0, 0, 0
    for epoch in range(epochs + 1):
        grads, loss = yield w
        if epoch and loss < least - 1e-6:
            best, least, wait, plateau, best_epoch = {k: v.copy() for k, v in w.items()}, loss, 0, 0, epoch - 1
        elif epoch:
            wait, plateau = wait + 1, plateau + 1
            if halve and plateau > 5:
                adam.rate, plateau = adam.rate / 2, 0
            if wait > patience:
                break
        if epoch < epochs:
            adam.update(w, grads)
    return best or w, {"val_loss": float(least), "best_epoch": best_epoch}


def together(steps, runs: list[Generator]) -> list:
    """What descents return; ``steps`` gives gradients and losses of all that still run, by number, at once."""
    asked, done = {k: next(r) for k, r in enumerate(runs)}, {}
    while asked:
        got, now = steps(asked), {}
        for k, found in got.items():
            try:
                now[k] = runs[k].send(found)
            except StopIteration as end:
                done[k] = end.value
        asked = now
    return [done[k] for k in range(len(runs))]


def descend(step, w: dict[str, np.ndarray], params: dict, epochs: int = 200, patience: int = 10, halve: bool = True) -> tuple[dict[str, np.ndarray], dict]:
    """One :func:`descent`, by a function ``step(w)``."""
    return together(lambda asked: {0: step(asked[0])}, [descent(w, params, epochs, patience, halve)])[0]


def descend_fixed(step, w: dict[str, np.ndarray], params: dict, epochs: int) -> dict[str, np.ndarray]:
    """Adam for a number of epochs that was found before."""
    adam = Adam(w, params.get("lr", 0.01), params.get("decay", 0.0))
    for _ in range(epochs):
        adam.update(w, step(w)[0])
    return w


def gcn_step(g: Graph, params: dict, parts: tuple[int, ...] = (0,)):
    """Full-batch gradients of the loss over the labelled rows of ``parts``, weighted by class, and the validation loss."""
    each = class_shares(np.bincount(g.y[g.taught(parts)], minlength=2), params.get("class_weights", True))

    def step(w: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], float]:
        p, seen = gcn_forward(g, w)
        return gcn_grads(g, w, sloped(p, g, parts, each), seen), _loss(p, g, 1)

    return step


def train_gcn(g: Graph, params: dict, epochs: int = 200, patience: int = 10, seed: int = 42) -> tuple[dict[str, np.ndarray], dict]:
    """Full-batch training with class weights; the weights of the best validation loss are kept (copied)."""
    return descend(gcn_step(g, params), init_layers(_sizes(params, g), seed), params, epochs, patience)


def refit_gcn(g: Graph, params: dict, epochs: int, seed: int = 42) -> dict[str, np.ndarray]:
    """Weights after ``epochs`` on training and validation rows together."""
    return descend_fixed(gcn_step(g, params, (0, 1)), init_layers(_sizes(params, g), seed), params, epochs)


def gat_forward(g: Graph, w: dict[str, np.ndarray], heads: int, slope: float = 0.2) -> tuple[np.ndarray, list]:
    """Two attention layers: hidden heads side by side, one output head.

    A lone row attends to itself only, whatever the scores, so its layers are products.
    """
    h, seen = g.x, []
    if g.lone:
        out = h @ np.concatenate([w[f"w0.{k}"] for k in range(heads)], 1)
        hidden = np.maximum(out, 0)
        last = hidden @ w["w1.0"]
        return _softmax(last), [(h, heads, out), (hidden, 1, last)]
    for layer in range(2):
        parts = []
        for k in range(heads if layer == 0 else 1):
            z = h @ w[f"w{layer}.{k}"]
            s = (z @ w[f"s{layer}.{k}"])[g.frm] + (z @ w[f"d{layer}.{k}"])[g.to]
            act = np.where(s > 0, s, slope * s)
            e = np.exp(act - g.tops(act)[g.to])
            alpha = e / g.sums("to", e)[g.to]
            o = g.sums("to", alpha[:, None] * z[g.frm])
            parts.append((z, s, alpha, o))
        out = np.concatenate([p[3] for p in parts], 1)
        seen.append((h, parts, out))
        h = np.maximum(out, 0) if layer == 0 else out
    return _softmax(h), seen


def gat_grads(g: Graph, w: dict[str, np.ndarray], d: np.ndarray, seen: list, slope: float = 0.2) -> dict[str, np.ndarray]:
    grads: dict[str, np.ndarray] = {}
    if g.lone:
        (h, heads, out), (hidden, _, _) = seen
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["w1.0"] = hidden.T @ d
        d = d @ w["w1.0"].T
        d *= out > 0
        for k, part in enumerate(np.split(h.T @ d, heads, 1)):
            grads[f"w0.{k}"] = part
        return grads
    for layer in (1, 0):
        h, parts, out = seen[layer]
        if layer == 0:
            d = d * (out > 0)
        below, at = np.zeros_like(h), 0
        for k, (z, s, alpha, o) in enumerate(parts):
            do = d[:, at : at + o.shape[1]]
            at += o.shape[1]
            dz = g.sums("frm", alpha[:, None] * do[g.to])
            da = (do[g.to] * z[g.frm]).sum(1)
            ds = alpha * (da - g.sums("to", alpha * da)[g.to]) * np.where(s > 0, 1.0, slope)
            to_src, to_dst = g.sums("frm", ds), g.sums("to", ds)
            grads[f"s{layer}.{k}"], grads[f"d{layer}.{k}"] = z.T @ to_src, z.T @ to_dst
            dz += np.outer(to_src, w[f"s{layer}.{k}"]) + np.outer(to_dst, w[f"d{layer}.{k}"])
            grads[f"w{layer}.{k}"] = h.T @ dz
            below += dz @ w[f"w{layer}.{k}"].T
        d = below
    return grads


def gat_start(wide: int, params: dict, seed: int = 42) -> dict[str, np.ndarray]:
    r, heads, hidden = np.random.default_rng(seed), int(params.get("heads", 2)), int(params.get("width", 8))
    w = {}
    for layer, (count, a, b) in enumerate([(heads, wide, hidden), (1, heads * hidden, 2)]):
        for k in range(count):
            w[f"w{layer}.{k}"] = r.normal(scale=np.sqrt(2 / (a + b)), size=(a, b))
            w[f"s{layer}.{k}"], w[f"d{layer}.{k}"] = r.normal(scale=0.1, size=b), r.normal(scale=0.1, size=b)
    return w


def train_gat(g: Graph, params: dict, epochs: int = 200, patience: int = 10, seed: int = 42) -> tuple[dict[str, np.ndarray], dict]:
    heads, each = int(params.get("heads", 2)), np.full(2, 1 / max(1, len(g.taught((0,)))))

    def step(w: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], float]:
        p, seen = gat_forward(g, w, heads)
        return gat_grads(g, w, sloped(p, g, (0,), each), seen), _loss(p, g, 1)

    return descend(step, gat_start(g.x.shape[1], params, seed), params, epochs, patience, halve=False)


@functools.lru_cache
def _bound(share: float) -> int:
    """The least 64-bit number that is, as a part of 2^64, at least ``share``."""
    at = int(share * 2.0**64)
    while at > 0 and float(at - 1) >= share * 2.0**64:
        at -= 1
    return at


def _kept(keys: np.ndarray, share: float, *lead: object) -> np.ndarray:
    """Whether a uniform number, by a mix of 64-bit keys and the hash of ``lead``, is at least ``share``; ``keys`` are overwritten."""
    if share <= 0:
        return np.ones(keys.shape, bool)
    salt = int.from_bytes(hashlib.md5("|".join(map(str, lead)).encode()).digest()[:8], "little")
    z, half = keys, np.empty_like(keys)
    z ^= np.uint64(salt)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
            np.right_shift(z, np.uint64(shift), out=half)
            z ^= half
            if factor:
                z *= np.uint64(factor)
    return z >= np.uint64(min(_bound(share), 2**64 - 1))


def bgrl_view(g: Graph, drop_edges: float, drop_features: float, *lead: object) -> np.ndarray:
    """Means of the features over a view: edges and cells dropped by the keys of their nodes."""
    key = (np.arange(len(g.x)) if g.key is None else g.key).astype(np.uint64)
    to, frm = (slice(None), slice(None)) if g.lone else (g.to, g.frm)
    with np.errstate(over="ignore"):
        pairs = (key[to] * np.uint64(0x9E3779B97F4A7C15)) ^ (key[frm] + np.uint64(0x632BE59BD9B4E019))
        cells = key[:, None] + np.arange(1, g.x.shape[1] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keep = _kept(pairs, drop_edges, "edges", *lead)
    x = g.x * _kept(cells, drop_features, "cells", *lead)
    if g.lone:
        x *= keep[:, None]
        return x
    keep = keep.astype(float)
    return g.sums("to", keep[:, None] * x[frm]) / np.maximum(1, g.sums("to", keep))[:, None]


def bgrl_step(g: Graph, online: dict, target: dict, predict: np.ndarray, drop_edges: float, drop_features: float, epoch: int, seed: int) -> tuple[dict[str, np.ndarray], float]:
    """Gradients and loss of both directions, summed over the own nodes.

    Encoder and predictor are linear, so their product is taken once; the gradient
    ``s (t - cos q)`` of a row, with ``q`` and ``t`` of length one, is never formed.
    """
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    through, shift = online["w0"] @ predict, online["b0"] @ predict
    views = [bgrl_view(g, drop_edges, drop_features, seed, epoch, k)[: g.own] for k in range(2)]
    total, grads = 0.0, {k: np.zeros(v.shape) for k, v in online.items()}
    for m, other in (views, views[::-1]):
        q, t = m @ through, other @ target["w0"]
        q += shift
        t += target["b0"]
        nq, nt = np.sqrt(dot(q, q)) + 1e-12, np.sqrt(dot(t, t)) + 1e-12
        cos = dot(q, t) / (nq * nt)
        total += float((2 - 2 * cos).sum())
        near, away = -2 / (nq * nt), -2 * cos / (nq * nq)
        grads["w0"] += ((m * near[:, None]).T @ t - (m * away[:, None]).T @ q) @ predict.T
        grads["b0"] += (near @ t - away @ q) @ predict.T
    return grads, total


def bgrl_descent(step, wide: int, n: int, hidden: int = 32, epochs: int = 150, rate: float = 0.005, drop_edges: float = 0.2, drop_features: float = 0.2, decay: float = 0.99, seed: int = 42) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights of an online encoder that predicts a slowly following target's view of ``n`` nodes, and the losses of all epochs.

    ``step`` is :func:`bgrl_step` over them.  The predictor keeps its random start.
    """
    online = init_layers([wide, hidden], seed)
    target = {k: v.copy() for k, v in online.items()}
    predict = np.random.default_rng(seed).normal(scale=1 / np.sqrt(hidden), size=(hidden, hidden))
    adam, losses = Adam(online, rate), []
    for epoch in range(epochs):
        grads, total = step(online, target, predict, drop_edges, drop_features, epoch, seed)
        adam.update(online, {k: v / max(1, n) for k, v in grads.items()})
        for k in target:
            target[k] = decay * target[k] + (1 - decay) * online[k]
        losses.append(total / 2 / max(1, n))
    return online, losses


def pretrain_bgrl(g: Graph, hidden: int = 32, epochs: int = 150, seed: int = 42, **how) -> tuple[np.ndarray, list[float]]:
    """Node embeddings by bootstrapped views, and the losses of all epochs, see :func:`bgrl_descent`."""
    online, losses = bgrl_descent(lambda *a: bgrl_step(g, *a), g.x.shape[1], g.own, hidden, epochs, seed=seed, **how)
    return g.first() @ online["w0"] + online["b0"], losses


def linear_head(x: np.ndarray, g: Graph, epochs: int = 200, rate: float = 0.01, seed: int = 42) -> np.ndarray:
    """Class probabilities of a linear head on fixed embeddings, weights of the best validation loss."""
    w = init_layers([x.shape[1], 2], seed)
    adam, at, best, least = Adam(w, rate), g.taught((0,)), w, np.inf
    for _ in range(epochs):
        p = _softmax(x @ w["w0"] + w["b0"])
        d = np.zeros_like(p)
        d[at] = p[at]
        d[at, g.y[at]] -= 1
        adam.update(w, {"w0": x.T @ d / max(1, len(at)), "b0": d.sum(0) / max(1, len(at))})
        loss = _loss(_softmax(x @ w["w0"] + w["b0"]), g, 1)
        if loss < least:
            best, least = {k: v.copy() for k, v in w.items()}, loss
    return _softmax(x @ best["w0"] + best["b0"])


def arrays(rows: pd.DataFrame, pairs: pd.DataFrame, columns: list[str]) -> tuple[Graph, list[str]]:
    """Arrays of ``rows(id, label, split, columns…)`` and the edges among them (both directions, loops added)."""
    rows = rows.sort_values("id", ignore_index=True)
    place = {v: i for i, v in enumerate(rows["id"])}
    a, b = pairs["src"].map(place).dropna().astype(int), pairs["dst"].map(place).dropna().astype(int)
    both = a.index.intersection(b.index)
    s, t = a.loc[both].to_numpy(), b.loc[both].to_numpy()
    ends = np.unique(np.concatenate([np.stack([s, t], 1), np.stack([t, s], 1), np.repeat(np.arange(len(rows))[:, None], 2, 1)]), axis=0)
    split = rows["split"].map({"train": 0, "validation": 1, "test": 2}).fillna(-1).to_numpy(int)
    return Graph(ends[:, 1], ends[:, 0], rows[columns].to_numpy(float), rows["label"].fillna(-1).to_numpy(int), split), rows["id"].tolist()


def fits(e: DataFrame, nodes: DataFrame, most: int = LOCAL_EDGES) -> bool:
    """Whether one worker should hold a graph."""
    return max(e.limit(most + 1).count(), nodes.limit(most + 1).count()) <= most


def checked(e: DataFrame, nodes: DataFrame, most: int = LOCAL_EDGES) -> None:
    """Refuses graphs that one worker should not hold; the layers above and :mod:`txloom.operators.gcn_tables` run on any size."""
    if not fits(e, nodes, most):
        raise ValueError(f"training in a worker takes up to {most} edges and nodes")


def load_graph(e: DataFrame, nodes: DataFrame, columns: list[str], most: int = LOCAL_EDGES) -> tuple[Graph, list[str]]:
    """:func:`arrays` of frames, gathered after their size was :func:`checked`; features should be scaled on the training rows before."""
    checked(e, nodes, most)
    return arrays(nodes.select("id", "label", "split", *columns).toPandas(), e.select("src", "dst").toPandas(), columns)


def signal(e: DataFrame, nodes: DataFrame, columns: list[str], kind: str, width: int = 64, epochs: int | None = None, seed: int = 42) -> DataFrame:
    """``id, <kind>_emb_0 …``: the embedding of every node of ``nodes`` for export."""
    from txloom.operators import blocks

    out = blocks.embed(e, nodes, columns, kind, width, epochs, seed, scores=False)
    return out.select("id", *[F.col("emb")[k].cast("float").alias(f"{kind}_emb_{k}") for k in range(width)])


def classify(e: DataFrame, nodes: DataFrame, columns: list[str], kind: str, width: int = 64, epochs: int | None = None, seed: int = 42) -> DataFrame:
    """``tx_id, split, y_true, p0`` of every node, end to end."""
    from txloom.operators import blocks

    return blocks.embed(e, nodes, columns, kind, width, epochs, seed).select(F.col("id").alias("tx_id"), "split", F.col("y").alias("y_true"), "p0")


def search(spark, g: Graph, trials: list[dict], epochs: int = 200, seed: int = 42) -> DataFrame:
    """``trial, val_loss, best_epoch`` of GCN trials, trained in parallel tasks on one broadcast graph."""
    held = spark.sparkContext.broadcast(g)  # a graph that one worker holds, see load_graph

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["trial"]:
                _, info = train_gcn(held.value, trials[t], epochs, seed=seed)
                yield pd.DataFrame([{"trial": t, **info}])

    return spark.range(len(trials)).withColumnRenamed("id", "trial").repartition(len(trials)).mapInPandas(run, "trial long, val_loss double, best_epoch long")


def decoded(params: dict) -> dict | None:
    """Network parameters of a drawn trial; none where widths do not fall from layer to layer."""
    hidden = [params[f"width_{k}"] for k in range(2, params["layers"] + 1)]
    if any(a <= b for a, b in zip(hidden, hidden[1:], strict=False)):
        return None
    return {"hidden": hidden, "lr": params["lr"], "class_weights": params["balancing"] == "class_weights"}


def tune(spark, g, n: int = 40, at_once: int = 8, epochs: int = 200, seed: int = 42) -> DataFrame:
    """``trial, hidden, lr, class_weights, val_loss, best_epoch`` of ``n`` trials over :data:`SPACE`.

    ``g`` is a :class:`Graph` or :class:`txloom.operators.blocks.Blocks`.  Parameters are
    proposed by tree-structured Parzen estimates after every ``at_once`` trials, which
    train in parallel.  Trials whose widths do not fall have null losses.
    """
    r, done, rows = random.Random(f"gcn|{seed}"), [], []
    trained = (lambda nets: [t.asDict() for t in search(spark, g, nets, epochs, seed).orderBy("trial").collect()]) if isinstance(g, Graph) else (lambda nets: g.train_gcns(nets, epochs, seed=seed))
    while len(done) < n:
        drawn = [propose(SPACE, done, r) for _ in range(min(at_once, n - len(done)))]
        nets = [decoded(p) for p in drawn]
        valid = [k for k, net in enumerate(nets) if net is not None]
        found = dict(zip(valid, trained([nets[k] for k in valid]), strict=True)) if valid else {}
        for k, (p, net) in enumerate(zip(drawn, nets, strict=True)):
            t = found.get(k)
            done.append({"trial": len(done), "params": p, "loss": t["val_loss"] if t else None})
            shown = net or {"hidden": [p[f"width_{j}"] for j in range(2, p["layers"] + 1)], "lr": p["lr"], "class_weights": p["balancing"] == "class_weights"}
            rows.append((len(rows), shown["hidden"], shown["lr"], shown["class_weights"], t["val_loss"] if t else None, t["best_epoch"] if t else None))
    return spark.createDataFrame(rows, "trial int, hidden array<int>, lr double, class_weights boolean, val_loss double, best_epoch long")


def gradient_importance(g: Graph, w: dict[str, np.ndarray]) -> np.ndarray:
    """Mean absolute gradient of the loss with respect to each feature, over all labelled nodes."""
    p, seen = gcn_forward(g, w)
    at = np.flatnonzero(g.y >= 0)
    d = np.zeros_like(p)
    d[at] = p[at]
    d[at, g.y[at]] -= 1
    for k in range(len(seen) - 1, -1, -1):
        if k < len(seen) - 1:
            d = d * (seen[k][1] > 0)
        d = g.mean_back(d @ w[f"w{k}"].T)
    return np.abs(d[at]).mean(0)


def permutation_importance(g: Graph, w: dict[str, np.ndarray], repeats: int = 3, seed: int = 42) -> np.ndarray:
    """Mean drop of test accuracy when a feature is shuffled."""
    r, at = np.random.default_rng(seed), np.flatnonzero((g.split == 2) & (g.y >= 0))
    score = lambda x: float((gcn_forward(Graph(g.to, g.frm, x, g.y, g.split), w)[0].argmax(1)[at] == g.y[at]).mean())
    base, out = score(g.x), np.zeros(g.x.shape[1])
    for j in range(g.x.shape[1]):
        for _ in range(repeats):
            x = g.x.copy()
            x[:, j] = r.permutation(x[:, j])
            out[j] += (base - score(x)) / repeats
    return out
