"""Cross-tokenizer alignment: which tokens of two vocabularies cover each other, and how often.

Every text is encoded by a byte-level vocabulary A and a piece vocabulary B; token pairs
whose bytes overlap are links.  A task that encodes a piece of the table writes, for each
bucket of B ids, one block of postings: (pair, document, links) sorted by pair.  Blocks
are shuffled by bucket of the side id B.  A task of the shuffle reads one sorted stream
in which a bucket's pair counts come before its postings, takes each B id's highest count
and emits what each document of a block gains from it; these are summed by document.

Buckets whose blocks are larger than a share of all are dealt over more tasks, each with a
copy of the bucket's pair counts (bounded by the two vocabularies, not by the corpus).
A task holds one block and one bucket's pair counts at a time; Spark's sort spills.

Both vocabularies are independent on either side of a single space between two characters
that are not white space: A's pre-tokenizer starts a new piece at that space, and no piece
of B has a space behind another character (checked when it is loaded).  So a text is cut
there and the units are encoded once and kept in a bounded table.

Defined results: texts that are null, empty or not given back by the tokens' bytes (such
as those with U+2581) have no tokens: zeros and an empty ``groups_sha256``.  Rows are told
apart by number, so repeated and null ids keep their own counts.  Extra columns do not
count; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txloom.llm.common import document_rows, drop_scratch, materialize, parts_for

#: Buckets of B ids.
BUCKETS = 16
#: Characters of text that one block of postings covers, if no single document is longer.
BLOCK_CHARS = 1_000_000
#: Units, and ids of units, from which a worker's table starts anew.
KEPT_UNITS, KEPT_IDS = 300_000, 3_000_000
#: Bytes of blocks that one task of the shuffle reads, about.
TASK_BYTES = 64 << 20

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Units:
    """Units of text, encoded by both vocabularies; numbered in the order they were met."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the second vocabulary crosses a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        width = len(str(max(self.size_a, self.size_b) - 1))
        self.digits = np.array([str(i) for i in range(max(self.size_a, self.size_b))], f"S{width}").view(np.uint8).reshape(-1, width)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids_a, self.ids_b = array("i"), array("i")
        self.places = array("q")  # for each unit the first id and the end in ids_a and in ids_b; no ids where the bytes do not give it back

    def numbers(self, units: list[str]) -> np.ndarray:
        """The units' numbers; units not met before are encoded."""
        missing = [*set(units).difference(self.index)]
        if missing:
            self._learn(missing)
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides of a text behind a space, if both give its bytes back."""
        a, b, whole = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b)):
            return np.array(a, np.int32), np.array(b, np.int32)
        return None

    def _learn(self, units: list[str]) -> None:
        """Encodes units as one text, cut where they end; one by one those with white space outside, or all should that text not come back."""
        inner, outer = [u for u in units if u and u == u.strip()], [u for u in units if not u or u != u.strip()]
        found = self._encoded(" ".join(inner)) if inner else None
        if found:
            ends = np.array([len(u.encode()) + 1 for u in inner]).cumsum()
            self._keep(inner, found, [np.searchsorted(lengths[ids].cumsum(), ends) + 1 for ids, lengths in zip(found, (self.lengths_a, self.lengths_b))])
        alone = outer if found else inner + outer
        if alone:
            each = [self._encoded(u) or (np.zeros(0, np.int32),) * 2 for u in alone]
            self._keep(alone, [np.concatenate(side) for side in zip(*each)], [np.cumsum([len(x) for x in side]) for side in zip(*each)])

    def _keep(self, units: list[str], ids: tuple | list, cuts: list[np.ndarray]) -> None:
        ends = [c + len(kept) for c, kept in zip(cuts, (self.ids_a, self.ids_b))]
        begins = [np.concatenate([[len(kept)], e[:-1]]) for e, kept in zip(ends, (self.ids_a, self.ids_b))]
        first = len(self.index)
        self.index.update(zip(units, range(first, first + len(units))))
        self.places.frombytes(np.stack([begins[0], ends[0], begins[1], ends[1]], 1).astype(np.int64).tobytes())
        self.ids_a.frombytes(ids[0].tobytes())
        self.ids_b.frombytes(ids[1].tobytes())

    def order(self, b: np.ndarray) -> np.ndarray:
        """B ids numbered by bucket first."""
        return (b % BUCKETS) * -(-self.size_b // BUCKETS) + b // BUCKETS

    def bucket(self, pair: np.ndarray) -> np.ndarray:
        return pair // self.size_a // -(-self.size_b // BUCKETS)


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], …, first[0] + n[0] - 1, first[1], …"""
    ends = n.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, each in its narrowest width, compressed."""
    out = []
    for c in columns:
        kind = next(k for k in ("<u1", "<u2", "<u4", "<i8") if k == "<i8" or not len(c) or int(c.max()) < 256 ** int(k[2]))
        out += [np.array([len(c), int(kind[2])], "<i8").tobytes(), c.astype(kind).tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpack(block: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(block), 0, []
    while at < len(data):
        n, width = np.frombuffer(data, "<i8", 2, at).tolist()
        out.append(np.frombuffer(data, {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[width], n, at + 16).astype(np.int64))
        at += 16 + n * width
    return out


class Alignment:
    """Both token streams of some documents, their groups and their links.

    A document ends where tokens of both sides end, so all documents are one stream.
    """

    def __init__(self, units: Units, a: np.ndarray, b: np.ndarray):
        self.units, self.a, self.b = units, a, b
        end_a, end_b = units.lengths_a[a].cumsum(), units.lengths_b[b].cumsum()
        low = np.searchsorted(end_b, end_a - units.lengths_a[a], "right")
        last = np.searchsorted(end_b, end_a)
        self.low, self.n = low, last - low + 1  # the B tokens that each A token meets
        self.close_a = end_b[last] == end_a  # the last tokens of groups
        self.close_b = np.zeros(len(b), bool)
        self.close_b[last[self.close_a]] = True

    def pairs(self) -> np.ndarray:
        """A pair for each link, in the order of A tokens."""
        return self.units.order(self.b[_spans(self.low, self.n)]) * self.units.size_a + np.repeat(self.a, self.n)

    def texts(self, ends_a: np.ndarray, ends_b: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of each document; the documents end before these tokens."""
        digits, width = self.units.digits, self.units.digits.shape[1] + 1
        group_a, group_b = (np.cumsum(c) - c for c in (self.close_a, self.close_b))
        of_a, of_b = np.bincount(group_a), np.bincount(group_b)
        at_a = np.arange(len(self.a)) + (of_b.cumsum() - of_b)[group_a]
        at_b = np.arange(len(self.b)) + of_a.cumsum()[group_b]
        shown = np.zeros((len(self.a) + len(self.b), width), np.uint8)
        for at, ids, close, mark in ((at_a, self.a, self.close_a, b"|"), (at_b, self.b, self.close_b, b";")):
            shown[at, :-1] = digits[ids]
            shown[at, -1] = np.where(close, mark[0], b","[0])
        used = np.concatenate([[0], (shown != 0).sum(1).cumsum()])
        whole = shown[shown != 0].tobytes()
        cuts = [0, *used[ends_a + ends_b].tolist()]
        return [whole[i : max(i, j - 1)] for i, j in zip(cuts, cuts[1:])]


def postings(units: Units, rows: np.ndarray, doc: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) of a document and a pair for each link; a block has row numbers, pairs, documents a pair, then document and links of each posting."""
    code, links = np.unique(pairs * len(rows) + doc, return_counts=True)
    pair, doc = code // len(rows), code % len(rows)
    cuts = np.searchsorted(units.bucket(pair), np.arange(BUCKETS + 1))
    for k in range(BUCKETS):
        part = slice(cuts[k], cuts[k + 1])
        if cuts[k] < cuts[k + 1]:
            first = np.flatnonzero(np.diff(pair[part], prepend=-1))
            sizes = np.diff(first, append=cuts[k + 1] - cuts[k])
            met = np.zeros(len(rows), bool)
            met[doc[part]] = True
            yield k, pack(np.diff(rows[met], prepend=0), np.diff(pair[part][first], prepend=0), sizes, (np.cumsum(met) - 1)[doc[part]], links[part])


_UNITS: dict[tuple[str, str], Units] = {}


def known_units(path_a: str, path_b: str) -> Units:
    """The worker's table of units, kept between batches."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path_a, path_b) not in _UNITS:
        _UNITS[path_a, path_b] = Units(path_a, path_b)
    return _UNITS[path_a, path_b]


def aligned(units: Units, rows: list[int], ids: list, texts: list[str | None]) -> tuple[list[tuple], list[tuple]]:
    """The documents' own columns, and the blocks of their postings."""
    if len(units.index) > KEPT_UNITS or len(units.ids_b) > KEPT_IDS:
        units.clear()
    split = [_BETWEEN.split(text) if text and "▁" not in text else [] for text in texts]
    lengths = np.array([len(x) for x in split], np.int64)
    places = units.numbers([u for x in split for u in x])
    table = np.frombuffer(units.places, np.int64).reshape(-1, 4)[places]
    doc = np.repeat(np.arange(len(rows)), lengths)
    lost = np.unique(doc[table[:, 1] == table[:, 0]])  # a unit of theirs does not come back
    if len(lost):
        kept = ~np.isin(doc, lost)
        doc, table = doc[kept], table[kept]
    n_a, n_b = (np.bincount(doc, table[:, k + 1] - table[:, k], len(rows)).astype(np.int64) for k in (0, 2))
    a, b = (np.frombuffer(kept, np.int32)[_spans(table[:, k], table[:, k + 1] - table[:, k])].astype(np.int64) for kept, k in ((units.ids_a, 0), (units.ids_b, 2)))
    if not len(a):
        return [(row, doc_id, 0, 0, 0, 0, "") for row, doc_id in zip(rows, ids)], []
    both, of = Alignment(units, a, b), np.repeat(np.arange(len(rows)), n_a)
    n_groups = np.bincount(of[both.close_a], minlength=len(rows))
    shown = both.texts(n_a.cumsum(), n_b.cumsum())
    own = [
        (row, doc_id, x, y, g, x + y - g, hashlib.sha256(text).hexdigest() if x else "")
        for row, doc_id, x, y, g, text in zip(rows, ids, n_a.tolist(), n_b.tolist(), n_groups.tolist(), shown)
    ]
    return own, [(rows[0], k, block) for k, block in postings(units, np.array(rows, np.int64), np.repeat(of, both.n), both.pairs())]


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    first = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > BLOCK_CHARS:
            yield slice(first, k)
            first, size = k, 0
        size += len(text or "")
    if first < len(texts):
        yield slice(first, len(texts))


def encode(docs: DataFrame, path_a: str, path_b: str, text_col: str, id_col: str) -> DataFrame:
    """Stored rows of two kinds: documents (``bucket`` null) and blocks of postings."""
    rows = document_rows(docs, id_col, text_col).toDF("doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    out = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in numbers]]
        + [T.StructField("groups_sha256", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("block", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, units = to_arrow_schema(out), known_units(path_a, path_b)
        for batch in batches:
            row, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            for part in _chunks(texts):
                made, blocks = aligned(units, row[part], ids[part], texts[part])
                found = [*zip(*made), [None] * len(made), [None] * len(made)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(found, schema)], schema=schema)
                for first, bucket, block in blocks:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((first, None, None, None, None, None, None, bucket, block), schema)], schema=schema)

    return materialize(rows.mapInArrow(run, out), "aligned")


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each pair in each block."""
    for batch in batches:
        for block in batch.column(0):
            _, keys, sizes, _, links = unpack(block.as_py())
            first = sizes.cumsum() - sizes
            yield pa.RecordBatch.from_arrays([pa.array(keys.cumsum()), pa.array(np.add.reduceat(links, first))], ["pair", "n"])


def pair_counts(blocks: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """Links of each pair in the corpus, packed by bucket: ``bucket, block`` of pairs and counts."""
    counted = blocks.select("block").mapInArrow(_block_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = size_a * -(-size_b // BUCKETS)
        for batch in batches:
            pair, n = (batch.column(i).to_numpy() for i in range(2))
            order = np.argsort(pair)
            pair, n = pair[order], n[order]
            cuts = np.searchsorted(pair // width, np.arange(BUCKETS + 1))
            for k in range(BUCKETS):
                if cuts[k] < cuts[k + 1]:
                    part = slice(cuts[k], cuts[k + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(np.diff(pair[part], prepend=0), n[part])], pa.binary())], ["bucket", "block"])

    return materialize(counted.mapInArrow(run, "bucket int, block binary"), "pair-counts")


def _exact_sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by document; floats of 53 bits meet 26 bits at a time only."""
    return sum(np.bincount(doc, values >> s & (1 << 26) - 1, n).astype(np.int64) << s for s in (0, 26))


def contributions(size_a: int):
    """A sorted stream of (bucket, part, kind, block) to (row, n_best, count_sum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heard, pairs, counts, best = None, [], None, None, None
        for batch in batches:
            for bucket, part, kind, block in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (bucket, part):
                    key, heard, pairs = (bucket, part), [], None
                if kind == 0:
                    steps, n = unpack(block)
                    heard.append((steps.cumsum(), n))
                    continue
                if pairs is None:
                    pairs, counts = (np.concatenate(c) for c in zip(*heard))
                    order = np.argsort(pairs)
                    pairs, counts, heard = pairs[order], counts[order], []
                    first = np.flatnonzero(np.diff(pairs // size_a, prepend=-1))
                    best = counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(pairs)))
                rows, keys, sizes, doc, links = unpack(block)
                at = np.repeat(np.searchsorted(pairs, keys.cumsum()), sizes)
                sums = _exact_sums(doc, links * counts[at], len(rows))
                top = np.bincount(doc, links * best[at], len(rows)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows.cumsum()), pa.array(top), pa.array(sums)], ["row", "n_best", "count_sum"])

    return run


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Tokens, groups and links of each document, its links that are their B id's most frequent, and the sum of its links' counts.

    ``path_a`` (a byte-level ``tokenizers`` file) and ``path_b`` (a ``sentencepiece`` model)
    are paths on the executors; by default the public ones.
    """
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    spark, units = docs.sparkSession, Units(path_a, path_b)
    stored = encode(docs, path_a, path_b, text_col, id_col)
    blocks = stored.filter("bucket IS NOT NULL").select("row", "bucket", "block")
    counts = pair_counts(blocks, units.size_a, units.size_b)
    sizes = {r["bucket"]: r["n"] for r in blocks.groupBy("bucket").agg(F.sum(F.length("block")).alias("n")).collect()}  # a row a bucket
    total = sum(sizes.values())
    parts = parts_for(spark, total, TASK_BYTES)
    shares = F.array(*[F.lit(max(1, -(-sizes.get(k, 0) * 2 * parts // max(total, 1)))) for k in range(BUCKETS)])
    share = F.element_at(shares, F.col("bucket") + 1)
    first = counts.select("bucket", F.explode(F.sequence(F.lit(0), share - 1)).alias("part"), F.lit(0).alias("kind"), "block")
    rest = blocks.select("bucket", F.pmod(F.xxhash64("row"), share.cast("long")).cast("int").alias("part"), F.lit(1).alias("kind"), "block")
    stream = first.unionByName(rest).repartition(parts, "bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    gained = stream.mapInArrow(contributions(units.size_a), "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = stored.filter("bucket IS NULL").drop("bucket", "block")
    out = own.join(gained, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    result = materialize(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256"), "alignment")
    drop_scratch(stored)
    drop_scratch(counts)
    return result
