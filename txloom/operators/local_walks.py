"""Walks inside blocks of whole components: all steps of a block's walkers as arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Walkers that step together.
TOGETHER = 16_384
#: Longest text of one MD5 block.
ONE_BLOCK = 55
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_FIRST = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _digest(words: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """First two words of the MD5 of many one-block messages, given as 16 columns (None: zero)."""
    size = len(words[0])
    a, b, c, d = (np.full(size, x, np.uint32) for x in _FIRST)
    f = np.empty(size, np.uint32)
    for i in range(64):
        k = i // 16
        if k == 0:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif k == 1:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif k == 2:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        if words[g] is not None:
            f += words[g]
        turn = _TURNS[k][i % 4]
        np.left_shift(f, np.uint32(turn), out=a)
        f >>= np.uint32(32 - turn)
        a |= f
        a += b
        a, d, c, b = d, c, b, a
    return a + _FIRST[0], b + _FIRST[1]


class Units:
    """``storage.hash_unit`` of the MD5 of ``prefix + step`` for many prefixes."""

    def __init__(self, prefixes: list[bytes], steps: int):
        self.prefixes, self.lengths = prefixes, np.array([len(x) for x in prefixes], np.int64)
        self.short = int(self.lengths.max()) + len(str(steps)) <= ONE_BLOCK
        if self.short:
            self.text = np.frombuffer(b"".join(x.ljust(64, b"\0") for x in prefixes), np.uint8).reshape(-1, 64).copy()
            self.rows = np.arange(len(prefixes))
            self.used = (int(self.lengths.max()) + len(str(steps))) // 4 + 1

    def at(self, step: int) -> np.ndarray:
        digits = str(step).encode()
        if not self.short:
            return np.array([int(hashlib.md5(x + digits).hexdigest()[:13], 16) for x in self.prefixes]) / 16.0**13
        for i, x in enumerate(digits + b"\x80"):
            self.text[self.rows, self.lengths + i] = x
        words: list[np.ndarray | None] = [None] * 16
        for i, column in enumerate(np.ascontiguousarray(self.text.view("<u4")[:, : self.used].T)):
            words[i] = column
        words[14] = ((self.lengths + len(digits)) * 8).astype(np.uint32)
        a, b = _digest(words)
        return ((a.byteswap().astype(np.uint64) << np.uint64(20)) | (b.byteswap() >> np.uint32(12))).astype(np.float64) / 16.0**13


class Block:
    """Neighbours of a block's nodes; a link's number is its place in ``ends``."""

    def __init__(self, ids: pa.Array, neighbours: pa.Array, p: float, q: float):
        flat = neighbours.flatten()
        coded = pa.concat_arrays([ids, flat]).dictionary_encode()
        self.names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.own, ends = code[: len(ids)], code[len(ids) :]
        sizes = np.asarray(neighbours.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        self.degree = np.zeros(len(self.names), np.int64)
        self.first = np.zeros(len(self.names), np.int64)
        self.degree[self.own], self.first[self.own] = sizes, np.cumsum(sizes) - sizes
        self.ends = np.append(ends, 0)  # a last one, so that the place of a node without links exists
        self.second = p != 1.0 or q != 1.0
        if self.second:
            self._weigh(np.repeat(self.own, sizes), ends, p, q)

    def _weigh(self, begins: np.ndarray, ends: np.ndarray, p: float, q: float) -> None:
        """``sums``: of every link, the running sums of the weights of its end's neighbours, added in their order."""
        n, sizes = len(self.names), self.degree[ends]
        self.offset = np.cumsum(sizes) - sizes
        within = np.arange(sizes.sum()) - np.repeat(self.offset, sizes)
        back, to = np.repeat(begins, sizes), ends[np.repeat(self.first[ends], sizes) + within]
        links = np.sort(begins * n + ends)
        asked = back * n + to
        known = links[np.minimum(np.searchsorted(links, asked), len(links) - 1)] == asked if len(links) else np.zeros(0, bool)
        self.sums = np.where(to == back, 1 / p, np.where(known, 1.0, 1 / q))
        alive, j = np.flatnonzero(sizes > 1), 1
        while alive.size:
            at = self.offset[alive] + j
            self.sums[at] += self.sums[at - 1]
            j += 1
            alive = alive[sizes[alive] > j]
        self.sums = np.append(self.sums, 0.0)
        self.offset = np.append(self.offset, 0)

    def _weighted(self, link: np.ndarray, degree: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Number of running sums up to ``unit`` of their total, by bisection."""
        offset = self.offset[link]
        limit = unit * self.sums[np.maximum(offset + degree - 1, 0)]
        low, high = np.zeros(len(link), np.int64), degree.copy()
        for _ in range(int(degree.max(initial=0)).bit_length()):
            mid = (low + high) >> 1
            up = (low < high) & (self.sums[np.minimum(offset + mid, len(self.sums) - 1)] <= limit)
            high = np.where(up | (low >= high), high, mid)
            low = np.where(up, mid + 1, low)
        return np.minimum(low, np.maximum(degree - 1, 0))

    def walk(self, start: np.ndarray, units: Units, length: int) -> np.ndarray:
        """A row of node numbers a walker; −1 after a node without neighbours."""
        out = np.full((length, len(start)), -1, np.int32)
        out[0] = at = start
        link = None
        for k in range(1, length):
            degree, unit = self.degree[at], units.at(k)
            step = np.floor(unit * degree).astype(np.int64) if link is None or not self.second else self._weighted(link, degree, unit)
            if link is None and self.second:  # all weigh 1: the number of 1, 2, … up to unit times their sum
                step = np.minimum(step, np.maximum(degree - 1, 0))
            new = self.first[at] + step
            if degree.all():
                link, at = new, self.ends[new]
                out[k] = at
            else:
                moves = degree > 0
                link = np.where(moves, new, 0 if link is None else link)
                at = np.where(moves, self.ends[np.where(moves, new, -1)], at)
                out[k] = np.where(moves, at, -1)
        return out.T


def block_walks(walks: int, length: int, seed: int, p: float, q: float):
    """Rows ``block, id, mark, starts, neighbours``, together by block, to ``walk_id, walk``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            block = Block(rows.column(1), rows.column(4), p, q)
            ids, marks = rows.column(1).to_pylist(), rows.column(2).to_pylist()
            begin = np.repeat(np.flatnonzero(rows.column(3).to_numpy(zero_copy_only=False)), walks)
            for k in range(0, len(begin), TOGETHER):
                some = [(int(i), (k + j) % walks) for j, i in enumerate(begin[k : k + TOGETHER])]
                texts = [f"{ids[i]}#{r}" for i, r in some]
                units = Units([f"{seed + r * 100_000 + marks[i]}|{t}|".encode() for (i, r), t in zip(some, texts)], length)
                found = block.walk(block.own[begin[k : k + TOGETHER]], units, length)
                there = found >= 0
                ends = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
                nodes = block.names.take(pa.array(found[there]))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends), nodes)], ["walk_id", "walk"])

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            code = coded.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                key = coded.dictionary[int(code[i])].as_py()
                if held and key != name:
                    yield from out()
                    held = []
                name = key
                held.append(batch.slice(i, j - i))
        if held:
            yield from out()

    return run
