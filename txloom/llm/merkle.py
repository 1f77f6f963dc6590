"""Merkle dataset manifest: ternary hash trees a source, joined by a tree over the sources.

A row's leaf is the SHA-256 of its tagged columns, computed by Spark expressions.  The
trees are built by supersteps over RDDs: in one superstep the nodes of a level message
their parents, and a parent that has the messages of all its children hashes them and
is a node of the next superstep.  Reverse supersteps send each run of siblings the
path above it (the siblings met on the way to the root), which the run hands down to
its children with its own digests put before; leaves end up with their whole proof.

A superstep moves a third of the records of the one below it, so all of them together
move one and a half times the leaves up and half of them down.  Keys are (source number,
position), no matter how large a source is, and each level is checkpointed in the
shared folder, so a lost executor costs one superstep.  Positions come from a
range-partitioned sort; only one row a partition reaches the driver.

Defined results: a null column is ``-``; a null ``doc_id`` sorts first in its source and is
never tampered with; rows that share an id are ordered by leaf, and equal rows take
neighbouring places in any order; a null source comes before the empty one; an empty
table gives no rows; extra columns do not count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txloom.llm.common import document_rows, drop_scratch, ensure_checkpoints, materialize, parts_for

#: Children of a node.
ARITY = 3
#: Records of a superstep that one task holds at most, about.
TASK_RECORDS = 20_000

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def tagged(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    value = column.cast("string")
    return F.when(column.isNull(), F.lit("-").cast("binary")).otherwise(F.concat(F.octet_length(value).cast("string").cast("binary"), F.lit(":").cast("binary"), value.cast("binary")))


def leaf_digest(**changed: Column) -> Column:
    """The leaf of a row in hex; ``changed`` replaces columns."""
    return F.sha2(F.concat(*[tagged(changed.get(c, F.col(c))) for c in COLUMNS]), 256)


def tampered(doc_id: Column) -> Column:
    """True for ids whose CRC-32 of the decimal form is even."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def joined(digests: Iterable[bytes]) -> bytes:
    """SHA-256 of the hex forms of digests, one behind the other."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def step(place: int, run: list[bytes]) -> bytes:
    """One level of a path: the node's place in its run, the number of siblings, the siblings in order."""
    others = [d for i, d in enumerate(run) if i != place]
    return bytes([place, len(others)]) + b"".join(others)


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """The levels of a path from the leaf up."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        yield place, [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings of its path give."""
    for place, others in steps(path):
        leaf = joined([*others[:place], leaf, *others[place:]])
    return leaf


def _summary(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(part, first source, its rows, last source, its rows, sources) of a sorted partition."""
    first = last = None
    n_first = n_last = kinds = 0
    for source, *_ in rows:
        if not kinds or source != last:
            kinds, last, n_last = kinds + 1, source, 0
            first = source if kinds == 1 else first
        n_last += 1
        n_first += kinds == 1
    if kinds:
        yield part, first, n_first, last, n_last, kinds


def _starts(summaries: list[tuple]) -> tuple[dict[int, tuple[int, int, int, int]], int]:
    """For each partition: number and earlier rows of its first source, whole rows of its first and its last source; the number of sources."""
    runs, before, number, previous = [], {}, -1, None
    for part, first, n_first, last, n_last, kinds in summaries:
        if number < 0 or first != previous:
            number, at = number + 1, 0
            runs.append(0)
        else:
            at = runs[number]
        before[part] = (number, at, number + kinds - 1)
        runs[number] = at + n_first
        if kinds > 1:
            number += kinds - 1
            runs += [0] * (kinds - 2) + [n_last]
        previous = last
    return {p: (first, at, runs[first], runs[last]) for p, (first, at, last) in before.items()}, number + 1


def _numbered(rows: Iterator[tuple], start: tuple[int, int, int, int]) -> Iterator[tuple]:
    """(source number, position, rows of the source, payload); a source's rows wait here until its part in this partition is counted."""
    number, at, whole_first, whole_last = start
    held: list[tuple] = []
    source, first = None, True

    def give(last: bool) -> Iterator[tuple]:
        whole = whole_first if first else whole_last if last else len(held)
        for i, payload in enumerate(held):
            yield number, (at if first else 0) + i, whole, payload

    for s, *payload in rows:
        if held and s != source:
            yield from give(False)
            held, number, first = [], number + 1, False
        source = s
        held.append(tuple(payload))
    yield from give(True)


def _kept(rdd: RDD) -> tuple[RDD, int]:
    """The RDD, cut from its lineage by a checkpoint in the shared folder, and its size."""
    rdd.persist(StorageLevel.MEMORY_AND_DISK)
    rdd.checkpoint()
    n = rdd.count()
    rdd.unpersist()
    return rdd, n


def _delivered(messages: RDD, n: int) -> RDD:
    """(key, messages to it) of ``n`` messages; few of them meet in one task without a shuffle."""
    if n > TASK_RECORDS:
        return messages.groupByKey(parts_for(SparkSession.active(), n, TASK_RECORDS))

    def meet(part: Iterator[tuple]) -> Iterator[tuple]:
        met: dict = {}
        for key, message in part:
            met.setdefault(key, []).append(message)
        yield from met.items()

    return messages.coalesce(1).mapPartitions(meet)


def _runs(nodes: RDD, n: int) -> RDD:
    """Parents with the messages of all their children: ((tree, position), (nodes of the children's level, children in order))."""
    messages = nodes.map(lambda x: ((x[0], x[1] // ARITY), (x[1] % ARITY, x[2], x[3])))
    return _delivered(messages, n).mapValues(lambda got: (next(iter(got))[1], [x[2] for x in sorted(got, key=lambda x: x[0])]))


def _forward(run: tuple) -> tuple:
    """A completed parent as a node: (tree, position, nodes of its level, (digest,))."""
    (tree, at), (n, children) = run
    return tree, at, -(-n // ARITY), (joined(c[0] for c in children),)


def climb(nodes: RDD, n: int) -> tuple[list[tuple[RDD, int]], RDD]:
    """Supersteps up from (tree, position, nodes of the level, (digest, ...)): the runs of each level and their number, and (tree, height, digest) of the tops."""
    levels: list[tuple[RDD, int]] = []
    tops = None
    while n:
        runs, n = _kept(_runs(nodes, n))
        if not n:
            break
        height = len(levels) + 1
        levels.append((runs, n))
        ended = runs.filter(lambda r: r[1][0] <= ARITY).map(lambda r, h=height: (r[0][0], h, _forward(r)[3][0]) if r[1][0] > 1 else (r[0][0], 0, r[1][1][0][0]))
        tops = ended if tops is None else tops.union(ended)
        nodes = runs.filter(lambda r: r[1][0] > ARITY).map(_forward)
    return levels, tops


def _hand_down(pair: tuple) -> Iterator[tuple]:
    """A run and the message from above it become a message for each child: (tree, position, child, message, path)."""
    (tree, at), got = pair
    runs, messages = [x for tag, x in got if tag == 0], [x for tag, x in got if tag == 1]
    (n, children), (note, path) = runs[0], messages[0]
    run = [c[0] for c in children]
    for place, child in enumerate(children):
        yield tree, at * ARITY + place, child, note, (step(place, run) + path if n > 1 else path)


def descend(levels: list[tuple[RDD, int]], tops: RDD) -> RDD:
    """Reverse supersteps from ``tops`` of (tree, height, (note, path)): (tree, position, child, note, path) of each leaf."""
    out = None
    for height, (runs, n) in reversed([*enumerate(levels)]):
        enter = tops.filter(lambda t, h=height: max(t[1], 1) == h + 1).map(lambda t: ((t[0], 0), (1, t[2])))
        if out is not None:
            enter = enter.union(out.map(lambda x: ((x[0], x[1]), (1, (x[3], x[4])))))
        out = _delivered(runs.map(lambda r: (r[0], (0, r[1]))).union(enter), 2 * n).flatMap(_hand_down)
        if height:
            out, _ = _kept(out)
    return out


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, proof and the check of a possibly tampered copy for each row."""
    spark = docs.sparkSession
    ensure_checkpoints(spark)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], T.StructField("verified", T.BooleanType())]
    )
    frame = document_rows(docs, *COLUMNS)
    changed = F.when(tampered(F.col("doc_id")), F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    seen = frame.select("source", "doc_id", leaf_digest().alias("leaf"), leaf_digest(text=F.coalesce(changed, F.col("text"))).alias("seen"), F.monotonically_increasing_id().alias("row"))
    stored = materialize(seen, "leaves")
    ordered = stored.orderBy(F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), "leaf", "row").select("source", "doc_id", F.unhex("leaf").alias("leaf"), F.unhex("seen").alias("seen"))
    rows = ordered.rdd.map(lambda r: (r[0], bytes(r[2]), r[1], bytes(r[3])))
    starts, sources = _starts(sorted(rows.mapPartitionsWithIndex(_summary).collect()))  # a row a partition
    if not sources:
        drop_scratch(stored)
        return spark.createDataFrame([], schema)
    leaves, n = _kept(rows.mapPartitionsWithIndex(lambda p, part: _numbered(part, starts[p]) if p in starts else iter(())))
    drop_scratch(stored)
    levels, subroots = climb(leaves, n)
    subroots, _ = _kept(subroots.coalesce(-(-sources // TASK_RECORDS)))
    upper, top = climb(subroots.map(lambda t: (0, t[0], sources, (t[2], t[1]))), sources)
    crowned = descend(upper, top.map(lambda t: (0, t[1], (t[2], b""))))  # the note is the root, children are (subroot, height)
    tops, _ = _kept(crowned.coalesce(-(-sources // TASK_RECORDS)).map(lambda x: (x[1], x[2][1], ((x[2][0], x[3]), x[4]))))

    def result(x: tuple) -> tuple:
        _, _, (leaf, doc_id, seen_leaf), (subroot, root), path = x
        proof, folded = joined(d for _, others in steps(path) for d in others), fold(seen_leaf, path)
        return doc_id, leaf.hex(), subroot.hex(), root.hex(), proof.hex(), folded.hex(), folded == root

    return spark.createDataFrame(descend(levels, tops).map(result), schema, verifySchema=False)
