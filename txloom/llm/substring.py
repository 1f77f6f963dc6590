"""Removal of repeated passages by suffix sorting.

A byte goes where a string of ``length`` bytes that covers it also starts earlier.
Every window of that length is assigned to its anchor, the least hashed ``gram`` of
its bytes, so equal windows have the same anchor at the same offset, and a run of
windows with one anchor is a *span*.  Hashes only say which spans can meet; bytes
decide:

1. spans whose anchor's hash occurs once repeat nothing; all others are cut out of
   their texts and sent to the task of that hash;
2. there they are sorted by what stands right of the anchor and by what stands left of
   it (suffix order by Lyndon grouping; equal strings share a place, the common
   beginning of a group is taken off).  Common prefixes of neighbours then tell, offset
   by offset, which windows are equal, and the earliest of each stays.

Nothing is compared pair by pair and no group is capped.  An anchor with very many
spans would fill one task: a task combines equal spans of such an anchor (compared by
their bytes) before it sends them, and where many different ones are left, all spans of
the anchor are cut into *pieces* of PIECE windows whose key is the hash of the bytes that
those windows share, so that contexts of one anchor spread over all tasks.

Records travel as packed binary columns, hash-partitioned by anchor or by document;
texts and contents travel compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txloom.llm.common import document_rows, materialize, parts_for
from txloom.llm.lyndon import suffix_order

LENGTH, GRAM = 100, 32
#: Window starts that are hashed at once.
CHUNK = 1 << 17
#: Symbols that one suffix sort takes at most, unless a single string is longer.
SORT_SYMBOLS = 1 << 18
#: Records that a task gathers before it sends them on.
SEND_AT = 200_000
#: Spans of one anchor in such a batch from which equal ones are combined, and different ones cut into pieces.
FREQUENT = 512
#: Spans of one anchor from which all of them are cut into pieces.
HOT_SPANS = 20_000
#: Windows of a piece.
PIECE = 4
#: Spans whose contents a task has in memory at once, unless one anchor has more.
DECIDE_AT = 50_000
#: Bytes of text whose spans one task sorts, about.
PART_BYTES = 64 << 20
#: Bytes that make one symbol of a suffix sort.
SYMBOL_BYTES = 6
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFF)

#: A span or piece: hash, document, first window, place of the anchor after it, windows (0: a mark that the anchor is frequent).
RECORD = np.dtype([("h", "<u8"), ("doc", "<i8"), ("p", "<u4"), ("off", "u1"), ("n", "u1")])
#: Added to ``n`` of a wanted span that is to be cut into pieces.
FINER = 128
SPAN = np.dtype([("p", "<u4"), ("n", "<u4")])
_PACKED = "bucket int, kind int, doc long, data binary"


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base^(i+1)`` and its inverse modulo 2^64."""
    inverse = pow(base, -1, 1 << 64)
    return np.cumprod(np.full(n, base, np.uint64)), np.cumprod(np.full(n, inverse, np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Prefix sums from which the hash of any slice of ``s`` follows."""

    def __init__(self, s: np.ndarray, base: int, limit: int):
        self.powers, self.inverses = _powers(base, limit)
        self.sums = np.zeros(len(s) + 1, np.uint64)
        np.cumsum((s.astype(np.uint64) + np.uint64(1)) * self.powers[: len(s)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverses[start])


def spans_of(data: bytes, doc: int, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Records of all spans of a text; a text shorter than ``length`` has none."""
    whole, width, out = np.frombuffer(data, np.uint8), length - gram + 1, []
    for at in range(0, len(whole) - length + 1, CHUNK):
        s = whole[at : at + CHUNK + length - 1]
        slices = Hasher(s, _BASE, CHUNK + 256)
        starts = np.arange(len(s) - gram + 1)
        hashes = slices(starts, starts + gram)
        least, w = (hashes & ~_LOW) | starts.astype(np.uint64), 1
        while 2 * w <= width:
            least, w = np.minimum(least[:-w], least[w:]), 2 * w
        if w < width:
            least = np.minimum(least[: len(least) - (width - w)], least[width - w :])
        anchor = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.concatenate((first[1:], [len(anchor)])) - 1
        r = np.empty(len(first), RECORD)
        r["h"], r["doc"], r["p"], r["off"], r["n"] = hashes[anchor[first]], doc, at + first, anchor[first] - first, last - first + 1
        out.append(r)
    return np.concatenate(out) if out else np.empty(0, RECORD)


def pieces(text: bytes, r: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Spans of a text cut into pieces of up to PIECE windows.

    Windows are cut by their distance to the anchor, so equal windows are in pieces with
    the same key: the hash of the ``length - PIECE + 1`` bytes that all windows with these
    distances contain.
    """
    out = []
    for doc, p, off, n in zip(r["doc"].tolist(), r["p"].tolist(), r["off"].tolist(), r["n"].tolist(), strict=True):
        for k in range((off - n + 1) // PIECE, off // PIECE + 1):
            first, last = max(0, off - PIECE * k - PIECE + 1), min(n - 1, off - PIECE * k)
            core = p + off - PIECE * k
            out.append((core_hash(text[core : core - PIECE + 1 + length]), doc, p + first, core - p - first, last - first + 1))
    return np.array(out, RECORD)


def core_hash(core: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(core)


def combine(r: np.ndarray, contents: list[bytes]) -> np.ndarray:
    """Whether each record has the key and the bytes of an earlier one; ``contents[i]`` belongs to ``r[i]``."""
    order = np.lexsort((r["p"], r["doc"]))
    seen: set[tuple[int, bytes]] = set()
    again = np.zeros(len(r), bool)
    for i, h in zip(order.tolist(), r["h"][order].tolist(), strict=True):
        cell = (h, contents[i])
        if cell in seen:
            again[i] = True
        else:
            seen.add(cell)
    return again


def _ranked(keys: list[int], strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Place of each string in the order of (key, string), equal ones sharing it; and common prefix of each place with the one before (-1 at a new key)."""
    distinct: dict[int, dict[bytes, int]] = {}
    for k, s in zip(keys, strings, strict=True):
        distinct.setdefault(k, {})[s] = 0
    many = [(k, d) for k, d in distinct.items() if len(d) > 1]
    sizes = {}
    for k, d in many:  # the part that all strings of a key share needs no sorting
        low, high = min(d), max(d)
        sizes[k] = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    ranks: dict[int, list[tuple[int, bytes]]] = {k: [] for k, _ in many}
    text: list[int] = []
    starts: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if text:
            rank = [0] * (len(text) + 1)
            for i, s in enumerate(suffix_order([*text, 0])):
                rank[s] = i
            for at, k, s in starts:
                ranks[k].append((rank[at], s))
            text.clear()
            starts.clear()

    for k, d in many:
        need = sum(2 + (len(s) - sizes[k]) // SYMBOL_BYTES for s in d)
        if text and len(text) + need > SORT_SYMBOLS:
            flush()
        for s in d:
            starts.append((len(text), k, s))
            text.extend(_symbols(s, sizes[k]))
            text.append(1)
    flush()
    common: list[int] = []
    for k, d in distinct.items():
        prior = None
        for s in [s for _, s in sorted(ranks[k])] if k in ranks else d:
            d[s] = len(common)
            common.append(-1 if prior is None else _common(prior, s, sizes[k]))
            prior = s
    return np.array([distinct[k][s] for k, s in zip(keys, strings, strict=True)], np.int64), np.array(common, np.int64)


def _symbols(s: bytes, start: int) -> list[int]:
    """What follows ``start`` as symbols of SYMBOL_BYTES bytes in byte order, a shorter last one before its extensions.

    Only the order of whole strings is wanted, and theirs is that of their symbols.
    """
    cut = [s[i : i + SYMBOL_BYTES] for i in range(start, len(s), SYMBOL_BYTES)]
    return [(int.from_bytes(c.ljust(SYMBOL_BYTES, b"\0"), "big") << 3 | len(c)) + 2 for c in cut]


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if a[low] != b[low] else low + 1


def decide(r: np.ndarray, spans: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of spans: documents, first bytes and lengths of covered runs.

    ``spans[i]`` is the content of record ``r[i]``; records with the same ``h`` are
    compared.  A span that equals an earlier one is covered as a whole.
    """
    order = np.lexsort((r["p"], r["doc"], r["h"]))  # earliest first
    r, spans = r[order], [spans[i] for i in order]
    again = combine(r, spans)
    whole, r, spans = r[again], r[~again], [s for s, a in zip(spans, again.tolist(), strict=True) if not a]
    keys, offs = r["h"].tolist(), r["off"].tolist()
    right, right_common = _ranked(keys, [s[o:] for s, o in zip(spans, offs, strict=True)])
    left, left_common = _ranked(keys, [s[:o][::-1] for s, o in zip(spans, offs, strict=True)])
    off, n = r["off"].astype(np.int64), r["n"].astype(np.int64)
    hit_row, hit_start = [], []
    for d in range(length - gram + 1):
        rows = np.flatnonzero((d <= off) & (d > off - n))
        if not len(rows):
            continue
        # places between which no common prefix is too short hold equal strings
        l_class = np.cumsum(left_common < d)[left[rows]]
        r_class = np.cumsum(right_common < length - d)[right[rows]]
        _, first = np.unique(l_class * (len(right_common) + 1) + r_class, return_index=True)
        again = np.ones(len(rows), bool)
        again[first] = False
        hit_row.append(rows[again])
        hit_start.append(off[rows[again]] - d)
    row, start = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (hit_row, hit_start))
    o = np.lexsort((start, row))
    row, start = row[o], start[o]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(row)])))
    found = r["doc"][row[first]], r["p"][row[first]].astype(np.int64) + start[first], count + length - 1
    return tuple(np.concatenate(x) for x in zip((whole["doc"], whole["p"].astype(np.int64), whole["n"].astype(np.int64) + length - 1), found, strict=True))


def _bucketed(kind: int, bucket: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, int | None, bytes]]:
    """Rows of packed records, one a bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, data = bucket[order], data[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), kind, None, data[a:b].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "kind", "doc", "data"])


_DOC_SPAN = np.dtype([("doc", "<i8"), ("p", "<u4"), ("n", "<u4")])


def _doc_spans(doc: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), _DOC_SPAN)
    out["doc"], out["p"], out["n"] = doc, p, n
    return out


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


#: Kinds of rows on their way to a bucket of anchors or of documents.
SPANS, COVERED, WANTED, TEXT, CONTENT = 0, 1, 2, 3, 4


def _covered(r: np.ndarray, length: int, buckets: int) -> Iterator[tuple[int, int, int | None, bytes]]:
    """Rows that say that spans are covered as a whole."""
    return _bucketed(COVERED, _doc_bucket(r["doc"], buckets), _doc_spans(r["doc"], r["p"], r["n"].astype(np.int64) + length - 1))


def _emit_spans(length: int, gram: int, buckets: int):
    """Texts to packed spans by anchor.

    Of an anchor with more than FREQUENT spans in a batch, equal ones are combined; if
    different ones are as many, only a mark of the anchor is sent and its spans are
    wanted in pieces.
    """

    def frequent(r: np.ndarray, texts: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What to send, what is covered, and spans of anchors with many contents."""
        r = r[np.argsort(r["h"], kind="stable")]
        _, at, size = np.unique(r["h"], return_inverse=True, return_counts=True)
        often = size[at] > FREQUENT
        some = r[often]
        if not len(some):
            return r, some, some
        ends = some["p"].astype(np.int64) + some["n"] + length - 1
        again = combine(some, [texts[d][p:e] for d, p, e in zip(some["doc"].tolist(), some["p"].tolist(), ends.tolist(), strict=True)])
        left = some[~again]
        keys, first, at, size = np.unique(left["h"], return_index=True, return_inverse=True, return_counts=True)
        many = size > FREQUENT
        marks = left[first[many]].copy()
        marks["n"] = 0
        return np.concatenate((r[~often], left[~many[at]], marks)), some[again], left[many[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            send, covered, finer = frequent(np.concatenate(found), texts)
            rows = [*_bucketed(SPANS, (send["h"] % np.uint64(buckets)).astype(np.int64), send), *_covered(covered, length, buckets), *_wanted(finer, True, buckets)]
            found.clear()
            texts.clear()
            return _batch(rows)

        found: list[np.ndarray] = []
        texts: dict[int, bytes] = {}
        size = 0
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts[doc] = data.as_py()
                found.append(spans_of(texts[doc], doc, length, gram))
                size += len(found[-1])
                if size > SEND_AT:
                    yield out()
                    size = 0
        if size:
            yield out()

    return run


def _wanted(r: np.ndarray, finer: bool | np.ndarray, buckets: int) -> Iterator[tuple[int, int, int | None, bytes]]:
    """Rows that ask the documents for the contents of spans, or of their pieces."""
    r = r.copy()
    r["n"] |= np.where(finer, np.uint8(FINER), np.uint8(0))
    return _bucketed(WANTED, _doc_bucket(r["doc"], buckets), r)


def _group_spans(length: int, buckets: int):
    """A partition of spans to those whose content is wanted; what is settled passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            passed = []
            for bucket, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if kind == SPANS:
                    found.append(np.frombuffer(data.as_py(), RECORD))
                else:
                    passed.append((bucket, kind, None, data.as_py()))
            yield _batch(passed)
        if found:
            r = np.concatenate(found)
            found.clear()
            r = r[np.argsort(r["h"], kind="stable")]
            _, at, size = np.unique(r["h"], return_inverse=True, return_counts=True)
            finer = np.bincount(at, r["n"] == 0, len(size)) > 0  # marked by a task
            finer |= size > HOT_SPANS
            keep = (size[at] > 1) & (r["n"] > 0)
            yield _batch([*_wanted(r[keep], finer[at[keep]], buckets)])

    return run


def _by_document(blobs: list[bytes], kind: np.dtype) -> dict[int, np.ndarray]:
    """Packed records by document."""
    if not blobs:
        return {}
    r = np.concatenate([np.frombuffer(b, kind) for b in blobs])
    r = r[np.argsort(r["doc"], kind="stable")]
    edges = np.flatnonzero(np.concatenate(([True], r["doc"][1:] != r["doc"][:-1], [True])))
    return {int(r["doc"][a]): r[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)}


def _then_texts(batches: Iterator[pa.RecordBatch], kind: np.dtype, each) -> Iterator:
    """Gathers the packed records of a partition, which come first, then calls ``each(doc, text, records)``."""
    import zstandard

    plain, blobs, by_doc = zstandard.ZstdDecompressor(), [], None
    for batch in batches:
        for k, doc, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if k != TEXT:
                blobs.append(data.as_py())
                continue
            if by_doc is None:
                by_doc = _by_document(blobs, kind)
                blobs.clear()
            yield each(doc, plain.decompress(data.as_py()), by_doc.get(doc))


def _cut_spans(length: int, buckets: int):
    """Texts with the spans wanted of them to records with content, by anchor; equal ones of a batch are combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        records: list[np.ndarray] = []
        contents: list[bytes] = []

        def out() -> pa.RecordBatch:
            r = np.concatenate(records)
            again = combine(r, contents)
            rows = [*_covered(r[again], length, buckets)]
            bucket = (r["h"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            order = order[~again[order]]
            edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True]))) if len(order) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = order[a:b]
                rows.append((int(bucket[part[0]]), CONTENT, len(part), press.compress(r[part].tobytes() + b"".join([contents[i] for i in part]))))
            records.clear()
            contents.clear()
            return _batch(rows)

        for text, r in _then_texts(batches, RECORD, lambda doc, text, r: (text, r)):
            if r is None:
                continue
            finer = r["n"] >= FINER
            if finer.any():
                some = r[finer].copy()
                some["n"] -= FINER
                r = np.concatenate((r[~finer], pieces(text, some, length)))
            records.append(r)
            contents += [text[p : p + n + length - 1] for p, n in zip(r["p"].tolist(), r["n"].tolist(), strict=True)]
            if len(contents) > SEND_AT // 4:
                yield out()
        if contents:
            yield out()

    return run


def _decide_spans(length: int, gram: int, buckets: int):
    """A partition of contents to what is covered, some anchors at a time; what is settled passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain, records, blobs, starts, at = zstandard.ZstdDecompressor(), [], [], [], 0
        for batch in batches:
            passed = []
            for bucket, kind, count, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if kind != CONTENT:
                    passed.append((bucket, kind, None, data.as_py()))
                    continue
                blob = plain.decompress(data.as_py())
                r = np.frombuffer(blob, RECORD, count).copy()
                sizes = r["n"].astype(np.int64) + length - 1
                starts.append(at + np.cumsum(sizes) - sizes)
                at += int(sizes.sum())
                records.append(r)
                blobs.append(blob[count * RECORD.itemsize :])
            yield _batch(passed)
        if not records:
            return
        r, whole, start = np.concatenate(records), b"".join(blobs), np.concatenate(starts)
        records.clear()
        blobs.clear()
        order = np.argsort(r["h"], kind="stable")
        new = np.flatnonzero(np.concatenate(([True], np.diff(r["h"][order]) != 0, [True])))
        low = 0
        while low < len(order):
            high = int(new[max(np.searchsorted(new, low + DECIDE_AT, "right") - 1, np.searchsorted(new, low, "right"))])
            part = order[low:high]
            some = r[part]
            ends = start[part] + some["n"] + length - 1
            covered = _doc_spans(*decide(some, [whole[a:b] for a, b in zip(start[part].tolist(), ends.tolist(), strict=True)], length, gram))
            yield _batch([*_bucketed(COVERED, _doc_bucket(covered["doc"], buckets), covered)])
            low = high

    return run


def remove(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of ``data`` without the runs, the bytes removed and the number of maximal runs."""
    if not len(starts):
        return data, 0, 0
    starts, ends = starts.astype(np.int64), starts.astype(np.int64) + sizes.astype(np.int64)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))  # touching runs are one
    first, last = starts[new].tolist(), ends[np.concatenate((new[1:], [True]))].tolist()
    whole = memoryview(data)
    left = b"".join([whole[a:b] for a, b in zip([0, *last], [*first, len(data)], strict=True)])
    return left, len(data) - len(left), len(first)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text", id_col: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller (integer) id, or the same document and a smaller place; null
    ids come last, rows that share an id are ordered by text.  Returns ``doc_id,
    n_bytes, n_removed, n_spans, kept_sha256`` and, with ``keep_text``, the bytes left
    as ``kept``.  Null and empty texts stay empty; of repeated rows the first keeps
    its text; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = document_rows(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    key = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    rows = rows.withColumn("doc", key)
    shared = rows.groupBy("doc").count().filter("count > 1").head(1)
    if shared:  # order rows that share an id
        rows = materialize(rows.orderBy("doc", "data").withColumn("doc", F.monotonically_increasing_id()), "ordered")
    size = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    done = _remove(rows, length, gram, parts_for(spark, size, PART_BYTES), keep_text)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
    if shared:
        return rows.select("doc_id", "doc").join(done, "doc").select("doc_id", *names)
    return done.select(F.when(F.col("doc") != (1 << 63) - 1, F.col("doc")).alias("doc_id"), *names)


def _remove(rows: DataFrame, length: int, gram: int, buckets: int, keep_text: bool) -> DataFrame:
    """:func:`remove_repeats` of ``rows(doc, data)`` whose ``doc`` is unique."""
    texts = rows.select("doc", "data")
    dealt = texts.mapInArrow(_emit_spans(length, gram, buckets), _PACKED)
    grouped = materialize(dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(_group_spans(length, buckets), _PACKED), "spans")

    def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            docs, data = batch.column(0).to_pylist(), [press.compress(c.as_py()) for c in batch.column(1)]
            yield _batch([(int(b), TEXT, d, x) for b, d, x in zip(_doc_bucket(np.array(docs, np.int64), buckets), docs, data, strict=True)])

    pressed = texts.mapInArrow(packed_texts, _PACKED)
    together = lambda records: records.unionByName(pressed).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind")
    cut = together(grouped.filter(F.col("kind") == WANTED)).mapInArrow(_cut_spans(length, buckets), _PACKED)
    settled = materialize(cut.repartitionById(buckets, F.col("bucket")).mapInArrow(_decide_spans(length, gram, buckets), _PACKED), "settled")

    fields = [T.StructField(n, t) for n, t in (("doc", T.LongType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.BinaryType()))]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(doc: int, text: bytes, spans: np.ndarray | None) -> tuple:
            left, gone, runs = remove(text, spans["p"], spans["n"]) if spans is not None else (text, 0, 0)
            return doc, len(text), gone, runs, hashlib.sha256(left).hexdigest(), left if keep_text else None

        held = []
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], [f.name for f in fields])
        for row in _then_texts(batches, _DOC_SPAN, each):
            held.append(row)
            if len(held) >= 1000:
                yield out()
                held = []
        if held:
            yield out()

    covered = grouped.filter(F.col("kind") == COVERED).unionByName(settled)
    return together(covered).mapInArrow(finish, T.StructType(fields))
