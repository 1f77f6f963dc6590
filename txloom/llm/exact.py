"""Exact deduplication through a cuckoo-filter index of live digests.

Each task owns a :class:`CuckooIndex`: 16-bit fingerprints in four-slot buckets
answer "surely absent" at once; a hit is verified against the key and then against the
text itself, which the bucket keeps compressed.  A newer row of a group deletes the
entry of the older one and inserts its own, so the index holds live digests only.
Where an insertion finds no slot, the index doubles and is refilled from the stored keys.

Rows are reduced twice: inside every input partition (so a hot group leaves it as
one row and one text), then by digest.  Should two different texts ever share a digest,
the second reduction sees it and all is done again with the text as part of the key.
The join back to the rows is salted for groups that hold a good part of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txloom.llm.common import document_rows, drop_scratch, join_hot, materialize, parts_for, shadowed, without

SLOTS = 4
MAX_KICKS = 200
#: Digests, and bytes of compressed text, that one task's index holds at most, about.
INDEX_ROWS, INDEX_BYTES = 500_000, 64 << 20
DIGEST_BYTES = 32


class CuckooIndex:
    """Cuckoo filter whose slots also keep the key and a value.

    ``find`` never reports a key that is not stored: the fingerprint only selects
    slots, the stored key decides.  Keys are digests, uniformly distributed, or longer
    byte strings, which are hashed.
    """

    def __init__(self, capacity: int = 1024):
        self._reset(max(8, 1 << (max(1, capacity) - 1).bit_length()) // SLOTS)
        self.resizes = 0

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.keys: list[bytes | None] = [None] * (buckets * SLOTS)
        self.values: list[object] = [None] * (buckets * SLOTS)
        self.count = 0

    def __len__(self) -> int:
        return self.count

    def _places(self, key: bytes) -> tuple[int, int, int]:
        if len(key) > DIGEST_BYTES:
            key = hashlib.sha256(key).digest()
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[4:12], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[slot] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> object | None:
        slot = self._slot(key)
        return None if slot < 0 else self.values[slot]

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.count -= 1
        return True

    def insert(self, key: bytes, value: object) -> None:
        """Store a key that is not in the index; grows when no slot can be freed."""
        while (left := self._place(key, value)) is not None:
            key, value = left
            self._grow()

    def _place(self, key: bytes, value: object) -> tuple[bytes, object] | None:
        mark, bucket, second = self._places(key)
        for where in (bucket, second):
            for slot in range(where * SLOTS, where * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.keys[slot], self.values[slot] = mark, key, value
                    self.count += 1
                    return None
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + mark) % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            key, self.keys[slot] = self.keys[slot], key
            value, self.values[slot] = self.values[slot], value
            bucket = self._other(bucket, mark)
            for free in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[free]:
                    self.prints[free], self.keys[free], self.values[free] = mark, key, value
                    self.count += 1
                    return None
        return key, value

    def _grow(self) -> None:
        stored = list(self.items())
        buckets = (self.mask + 1) * 2
        while True:
            self._reset(buckets)
            self.resizes += 1
            if all(self._place(k, v) is None for k, v in stored):
                return
            buckets *= 2

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


def _newer(a: tuple, b: tuple) -> bool:
    """Whether row ``a`` outranks ``b``: larger id, ids before nulls, later row at a tie."""
    return (a[0] is not None, a[0] if a[0] is not None else 0, a[1]) > (b[0] is not None, b[0] if b[0] is not None else 0, b[1])


class LiveTexts:
    """Index of the live row of every key: ``(id, row, rows of the group, compressed text)``."""

    def __init__(self):
        self.index, self.bytes, self.clashes = CuckooIndex(), 0, set()

    def add(self, key: bytes, doc_id: object, row: int, n: int, content: bytes) -> None:
        """Counts a row; a key that is held with another text becomes a clash."""
        held = self.index.find(key)
        if held is None:
            self.index.insert(key, (doc_id, row, n, content))
            self.bytes += len(content)
        elif not _same_text(held[3], content):
            self.clashes.add(key)
        else:
            live = (doc_id, row) if _newer((doc_id, row), held) else held[:2]
            self.index.delete(key)
            self.index.insert(key, (*live, n + held[2], held[3]))


def _same_text(a: bytes, b: bytes) -> bool:
    """Whether two compressed texts are one; the same compressor gives the same bytes, others are opened."""
    if a == b:
        return True
    import zstandard

    plain = zstandard.ZstdDecompressor()
    return plain.decompress(a) == plain.decompress(b)


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


#: Rows of the stored table: every input row (kind 0), and the live rows of an index with their texts (kind 1).
ROW, LIVE = 0, 1


def indexed_rows(docs: DataFrame, text_col: str, id_col: str, digest: Callable[[bytes], bytes] = sha256, whole: bool = False, flush_bytes: int = INDEX_BYTES // 2) -> DataFrame:
    """Stored ``kind, digest, doc_id, row, n, content, bytes`` of one pass over the texts.

    ``row`` only tells repeated rows apart.  With ``whole`` the text is part of the key
    that stands in ``digest``.
    """
    rows = document_rows(docs, id_col, text_col).toDF("doc_id", "text").select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data")
    )
    fields = (("kind", T.IntegerType()), ("digest", T.BinaryType()), ("doc_id", rows.schema["doc_id"].dataType), ("row", T.LongType()), ("n", T.LongType()), ("content", T.BinaryType()), ("bytes", T.LongType()))
    out = T.StructType([T.StructField(*f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, press, live = to_arrow_schema(out), zstandard.ZstdCompressor(level=1), LiveTexts()
        for batch in batches:
            ids, numbers, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for doc_id, row, cell in zip(ids, numbers, batch.column(2), strict=True):
                data = cell.as_py()
                content = press.compress(data)
                keys.append(digest(data) + (content if whole else b""))
                live.add(keys[-1], doc_id, row, 1, content)
                if live.bytes >= flush_bytes:
                    yield from _emit(live, schema)
                    live = LiveTexts()
            n, none = len(keys), [None] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([ROW] * n, pa.int32()), pa.array(keys, pa.binary()), batch.column(0).cast(schema[2].type), batch.column(1), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(none, pa.int64())], schema=schema)
        yield from _emit(live, schema)

    return materialize(rows.mapInArrow(run, out), "texts")


def _emit(live: LiveTexts, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Live rows; a clash is one with ``n`` -1."""
    rows = [(LIVE, k, i, row, -1 if k in live.clashes else n, text, len(text)) for k, (i, row, n, text) in live.index.items()]
    for at in range(0, len(rows), 2048):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 2048], strict=True), schema, strict=True)], schema=schema)


def live_rows(indexed: DataFrame) -> DataFrame:
    """Stored ``(digest, keep_id, keep_row, n)`` of each key of :func:`indexed_rows`; ``n`` is -1 where texts clash.

    More partitions than the session's are used where one index would hold more than
    INDEX_ROWS digests or INDEX_BYTES of text.
    """
    spark = indexed.sparkSession
    out = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("keep_id", indexed.schema["doc_id"].dataType), T.StructField("keep_row", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, live, clashed = to_arrow_schema(out), LiveTexts(), set()
        for batch in batches:
            for key, doc_id, row, n, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if n < 0:
                    clashed.add(key)
                live.add(key, doc_id, row, n, content)
        clashed |= live.clashes
        rows = [(k, i, row, -1 if k in clashed else n) for k, (i, row, n, _) in live.index.items()]
        for at in range(0, len(rows), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 8192], strict=True), schema, strict=True)], schema=schema)

    once = indexed.filter(F.col("kind") == LIVE)
    size = once.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    parts = max(parts_for(spark, size["n"], INDEX_ROWS), parts_for(spark, size["b"], INDEX_BYTES))
    dealt = once.select("digest", "doc_id", "row", "n", "content").repartition(parts, "digest")
    return materialize(dealt.mapInArrow(run, out), "live")


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row per document: its group of identical texts and the row that stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.  A null text counts
    as empty.  The largest id of a group stays; a null id loses to any other; of
    repeated rows with the same id exactly one is kept.  An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    indexed = indexed_rows(docs, text_col, id_col, digest)
    live = live_rows(indexed)
    if live.filter("n < 0").head(1):  # different texts share a digest
        drop_scratch(indexed)
        indexed = indexed_rows(docs, text_col, id_col, digest, whole=True)
        live = live_rows(indexed)
    rows = materialize(indexed.filter(F.col("kind") == ROW).select("doc_id", "row", "digest"), "digests")
    drop_scratch(indexed)  # the texts in it
    joined = join_hot(rows, live.filter("n > 1"), ["digest"], "n", rows.count(), F.col("row"))
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n")).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, DIGEST_BYTES))).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose exact text another, later row carries.

    All columns stay.  Same rules as :func:`exact_groups`; of repeated rows with the
    id that stays one is kept.  Texts move only where the dropped ids are too many to
    broadcast.
    """
    frame, at, back = shadowed(docs)
    groups = exact_groups(frame, at(text_col), at(id_col))
    out = materialize(groups.filter(~F.col("kept")).select("doc_id", F.unhex("text_sha256").alias("digest"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("tied")), "dropped")
    key = F.unhex(F.sha2(F.coalesce(F.col(at(text_col)).cast("string"), F.lit("")), 256))
    marked = frame.withColumn("_digest", key).withColumn("_id", F.col(at(id_col)))
    same = lambda other: F.col("_id").eqNullSafe(other["doc_id"]) & (F.col("_digest") == other["digest"])
    older, tied = (materialize(out.filter(c).select("doc_id", "digest").distinct(), "dropped") for c in ("NOT tied", "tied"))
    rest = without(marked, older, same(older))
    if tied.head(1):
        rest = rest.join(tied, same(tied), "left_anti").unionByName(rest.join(tied, same(tied), "left_semi").dropDuplicates(["_id", "_digest"]))
    return back(rest)


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
