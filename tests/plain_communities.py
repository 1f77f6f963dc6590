"""Sequential community detection on small graphs, which the rounds over tables are held against."""

import random
from collections import defaultdict

Adjacency = list[dict[int, float]]


def _moves(near: Adjacency, weight: list[float], part: list[int], total: float, resolution: float, rng: random.Random) -> bool:
    """Moves nodes to the neighbouring community with the largest modularity gain until none gains."""
    held: dict[int, float] = defaultdict(float)
    for i, c in enumerate(part):
        held[c] += weight[i]
    moved_any, moved = False, True
    order = list(range(len(near)))
    rng.shuffle(order)
    while moved:
        moved = False
        for i in order:
            links: dict[int, float] = defaultdict(float)
            for j, w in near[i].items():
                if j != i:
                    links[part[j]] += w
            own = part[i]
            held[own] -= weight[i]
            gain = lambda c: links.get(c, 0.0) - resolution * weight[i] * held[c] / (2 * total)  # noqa: E731,B023
            best = own
            for c in sorted(links):
                if gain(c) > gain(best) + 1e-12:
                    best = c
            held[best] += weight[i]
            if best != own:
                part[i], moved, moved_any = best, True, True
    return moved_any


def _fold(near: Adjacency, part: list[int]) -> tuple[Adjacency, list[int]]:
    """The graph of communities, and each node's place in it."""
    place = {c: k for k, c in enumerate(dict.fromkeys(part))}
    where = [place[c] for c in part]
    folded: Adjacency = [defaultdict(float) for _ in place]
    for i, row in enumerate(near):
        for j, w in row.items():
            folded[where[i]][where[j]] += w
    return [dict(r) for r in folded], where


def louvain_partition(near: Adjacency, total: float, resolution: float = 1.0, seed: int = 42, refine: bool = False) -> list[int]:
    """Greedy modularity: local moves, then the same on the graph of communities.

    ``refine`` splits every community into parts that are joined inside it only
    before the graph is folded, so communities stay connected.
    """
    rng, out = random.Random(seed), list(range(len(near)))
    graph, part = near, list(range(len(near)))
    while True:
        weight = [sum(r.values()) for r in graph]
        if not _moves(graph, weight, part, total, resolution, rng):
            return _to_original(out, part)
        if refine:
            inner: Adjacency = [{j: w for j, w in row.items() if part[j] == part[i]} for i, row in enumerate(graph)]
            fine = list(range(len(graph)))
            _moves(inner, weight, fine, total, resolution, rng)
        else:
            fine = part
        graph, where = _fold(graph, fine)
        lead = {}
        for i, k in enumerate(where):
            lead.setdefault(k, part[i])
        out = [where[k] for k in out]
        names = {c: k for k, c in reversed(list(enumerate(lead[k] for k in range(len(graph)))))}
        part = [names[lead[k]] for k in range(len(graph))]
        if len(graph) == len(where) and not refine:
            return _to_original(out, part)


def _to_original(out: list[int], part: list[int]) -> list[int]:
    return [part[k] for k in out]


def adjacency(pairs):
    """Sorted ids and symmetric weights of one."""
    ids = sorted({v for p in pairs for v in p})
    place = {v: i for i, v in enumerate(ids)}
    near: Adjacency = [{} for _ in ids]
    for a, b in pairs:
        near[place[a]][place[b]] = near[place[b]][place[a]] = 1.0
    return ids, near


def modularity(near: Adjacency, part: list, resolution: float = 1.0) -> float:
    two_m = sum(sum(r.values()) for r in near)
    inner = sum(w for i, r in enumerate(near) for j, w in r.items() if part[i] == part[j])
    held: dict = defaultdict(float)
    for i, r in enumerate(near):
        held[part[i]] += sum(r.values())
    return inner / two_m - resolution * sum((x / two_m) ** 2 for x in held.values())
