"""SimHash near-duplicates by covering locality-sensitive hashing.

A random vector of ``radius + 1`` bits is given to each of the 64 positions; a
non-zero vector ``v`` compares the positions whose vector has odd dot product with
it.  At most ``radius`` differing positions span at most ``radius`` dimensions, so
some ``v`` is orthogonal to all of them and its table compares none of them: every
pair within the radius collides in at least one of the ``2^(radius+1) - 1`` tables
(no false negatives, Pagh 2016).

Only distinct fingerprints are hashed.  A bucket yields a spanning forest of its
links, never all pairs.  A bucket with many members is hashed again on the bits it
has not fixed yet; two such levels leave at most 2^16 distinct members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txloom.llm.common import document_rows, identified, join_hot, materialize, shadowed, without
from txloom.operators.graph import star_components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Members from which a bucket is hashed again.
SPLIT_AT = 2048
#: Bytes of text whose words are in memory at once.
WINDOW = 1 << 20
WHITE = b" \t\n\x0b\x0c\r"

#: For each byte value, its bits (lowest first) as eight 8-bit counters in one word.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _windows(data: bytes) -> Iterator[list[bytes]]:
    """Words of ``data``, at most about WINDOW bytes of them at once."""
    at = 0
    while len(data) - at > WINDOW:
        end = at + WINDOW
        while end < len(data) and data[end] not in WHITE:
            end += 1
        yield data[at:end].split()
        at = end
    yield (data[at:] if at else data).split()


def _count_bits(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    starts = np.arange(0, len(hashes), 255)
    sums = np.empty(64, np.int64)
    for k in range(8):
        packed = np.add.reduceat(_SPREAD[octets[:, k]], starts)  # 255 fit an 8-bit counter
        sums[8 * k : 8 * k + 8] = packed.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return sums


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles, repeats counted; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    ones, n, tail = np.zeros(64, np.int64), 0, []
    for words in _windows(text.encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            lows = np.concatenate(([0], ends[:-shingle])).tolist()
            highs = (ends[shingle - 1 :] - 1).tolist()
            hashes = np.fromiter([xxh64_intdigest(joined[a:b], seed) for a, b in zip(lows, highs, strict=True)], np.uint64, len(lows))
            ones += _count_bits(hashes)
            n += len(hashes)
            words = words[1 - shingle :] if shingle > 1 else []
        tail = words
    if not n:
        return xxh64_intdigest(b" ".join(tail), seed) if tail else 0
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text_col: str = "text", id_col: str = "doc_id", row_col: str | None = None) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed 64-bit number; ``row`` too where ``row_col`` names it."""
    more = {"row": row_col} if row_col else {}
    rows = document_rows(docs, id_col, text_col, *more.values()).toDF("doc_id", "text", *more).withColumn("text", F.col("text").cast("string"))
    out = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("fp", T.LongType()), *[rows.schema[c] for c in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], out.names)

    return rows.mapInArrow(run, out)


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = SEED) -> list[int]:
    """The ``2^(radius+1) - 1`` masks of positions that a table compares."""
    vectors = np.random.default_rng(seed).permutation(np.arange(bits) % 2 ** (radius + 1))
    return [sum(1 << i for i, a in enumerate(vectors.tolist()) if (a & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(rows: DataFrame, masks: list[int], kept: list[Column]) -> DataFrame:
    """Each row once a mask: ``kept…, table, key``."""
    array = F.array(*[F.struct(F.lit(i).alias("table"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])
    one = rows.select(*kept, F.col("fp"), F.explode(array).alias("t"))
    return one.select(*[c for c in one.columns if c != "t"], F.col("t.table").alias("table"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"))


def forest(members: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Spanning forest of the links among ``members`` (uint64): each component is searched once.

    A search compares one frontier with what is left, so a dense bucket costs about
    its size and a sparse one its square over two.
    """
    parents, children = [], []
    left = members
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = left[:0]
        near = np.bitwise_count(left ^ root) <= radius
        if near.any():
            frontier, left = left[near], left[~near]
            children += frontier.tolist()
            parents += [int(root)] * len(frontier)
        while len(frontier) and len(left):
            new = []
            for at in range(len(frontier)):
                near = np.bitwise_count(left ^ frontier[at]) <= radius
                if near.any():
                    new.append(left[near])
                    left = left[~near]
                    if not len(left):
                        break
            frontier = np.concatenate(new) if new else left[:0]
            children += frontier.tolist()
            parents += [int(root)] * len(frontier)  # any member of the component serves
    return parents, children


def _forests(buckets: DataFrame, radius: int) -> DataFrame:
    """``a, b`` pairs that connect what ``buckets(members)`` links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat, offsets = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()
            a, b = [], []
            pairs = np.flatnonzero(np.diff(offsets) == 2)  # by far the most buckets
            x, y = flat[offsets[pairs]], flat[offsets[pairs] + 1]
            near = np.bitwise_count(x ^ y) <= radius
            a.append(x[near]), b.append(y[near])
            for i in np.flatnonzero(np.diff(offsets) > 2):
                p, c = forest(flat[offsets[i] : offsets[i + 1]], radius)
                a.append(np.array(p, np.uint64)), b.append(np.array(c, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])

    return buckets.select("members").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, radius: int = RADIUS, seed: int = SEED, split_at: int = SPLIT_AT) -> DataFrame:
    """Pairs ``a, b`` of ``distinct(fp)`` that connect all fingerprints within ``radius`` of each other."""
    masks = covering_masks(radius, 64, seed)
    hashed = _tables(distinct, masks, [])
    path = ["table", "key"]
    found = None
    for level in range(3):
        sizes = hashed.groupBy(*path).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        small = hashed.join(sizes.filter(F.col("_n") <= split_at).drop("_n"), path, "left_semi") if level < 2 else hashed
        buckets = small.groupBy(*path).agg(F.collect_list("fp").alias("members")).filter("size(members) > 1")
        pairs = _forests(buckets, radius)
        found = pairs if found is None else found.unionByName(pairs)
        if level == 2:
            break
        large = sizes.filter(F.col("_n") > split_at).drop("_n")
        if not large.head(1):
            break
        rest = materialize(hashed.join(F.broadcast(large) if large.count() < 10_000 else large, path, "left_semi"), "simhash-large")
        more = covering_masks(radius, 64, seed + level + 1)
        again = rest.withColumnsRenamed({"table": f"table{level}", "key": f"key{level}"})
        path = [f"table{level}", f"key{level}", *[c for c in path if c not in ("table", "key")], "table", "key"]
        hashed = _tables(again, more, [F.col(c) for c in again.columns if c != "fp"])
    return found


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each node's component, for every node but that one."""
    return star_components(edges).select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest id reachable over links, the document's own included.  Null and empty
    texts have fingerprint zero and are linked like any other.  Null ids are ignored
    in that minimum (null where the whole component has none); repeated rows are
    returned as often as they occur; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, shingle, seed, text_col, id_col), "fingerprints")
    return join_components(prints, radius, seed).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def root_prints(prints: DataFrame, first: Column, radius: int, seed: int) -> DataFrame:
    """Stored ``fp, root, first`` of every distinct fingerprint, ``first`` aggregated over its rows."""
    firsts = prints.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    roots = components(links(firsts.select("fp"), radius, seed))
    rooted = firsts.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    return materialize(rooted.select("fp", "root", "first", "n"), "roots")


def join_components(prints: DataFrame, radius: int, seed: int) -> DataFrame:
    """Stored ``prints(doc_id, fp, …)`` with ``component_id``."""
    rooted = root_prints(prints, F.min("doc_id"), radius, seed)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("m"))
    labels = join_hot(rooted, smallest, ["root"], "m", rooted.count(), F.xxhash64("fp")).select("fp", "component_id", "n")
    return join_hot(prints, labels, ["fp"], "n", prints.count(), F.xxhash64("doc_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with exactly one row of each component: that with the smallest id.

    All columns stay.  Null ids come last; of rows that share the smallest id the one
    with the smallest fingerprint stays, of rows that share both any one.  Where ids
    are null or shared, rows are told apart by a number stored with them.
    """
    frame, at, back = shadowed(docs)
    numbered = identified(frame, at(id_col))
    prints = materialize(fingerprints(numbered, shingle, seed, at(text_col), at(id_col), "row"), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "row")
    kept = root_prints(prints, F.min(place), radius, seed).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    dropped = materialize(prints.join(kept, "row", "left_anti").select("row"), "dropped")
    return back(without(numbered, dropped, ["row"]))
