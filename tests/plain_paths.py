"""Shortest paths from every node by array operations, which the joins over layers are held against."""

import numpy as np


def dependencies(start: np.ndarray, to: np.ndarray, root: int) -> np.ndarray:
    """Pair dependencies of one source (Brandes), layer by layer with array operations."""
    n = len(start) - 1
    dist, paths = np.full(n, -1), np.zeros(n)
    dist[root], paths[root] = 0, 1.0
    layers, front = [], np.array([root])
    while len(front):
        count = start[front + 1] - start[front]
        a = np.repeat(front, count)
        b = to[np.repeat(start[front] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]
        dist[b[dist[b] < 0]] = dist[front[0]] + 1
        down = dist[b] == dist[front[0]] + 1
        a, b = a[down], b[down]
        np.add.at(paths, b, paths[a])
        layers.append((a, b))
        front = np.unique(b)
    out = np.zeros(n)
    for a, b in reversed(layers):
        np.add.at(out, a, paths[a] / paths[b] * (1 + out[b]))
    out[root] = 0
    return out


def arrays(pairs):
    """Sorted ids and the adjacency of symmetric pairs as starts and targets."""
    ids = sorted({v for p in pairs for v in p})
    place = {v: i for i, v in enumerate(ids)}
    both = sorted({(place[a], place[b]) for p in pairs for a, b in (p, p[::-1])})
    start = np.searchsorted([a for a, _ in both], np.arange(len(ids) + 1))
    return ids, start, np.array([b for _, b in both])


def distances(start, to, root):
    dist, front = {root: 0}, [root]
    for a in front:
        for b in to[start[a] : start[a + 1]]:
            if b not in dist:
                dist[b] = dist[a] + 1
                front.append(b)
    return dist
