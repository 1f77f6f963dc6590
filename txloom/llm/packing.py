"""Best-fit packing planned on the histogram of piece lengths.

Tokens are counted per document, long documents are cut into pieces, and only the
histogram of piece lengths (at most ``capacity`` rows, whatever the corpus size)
reaches the driver.  Best-fit decreasing runs over the counts and gives runs of
slots; a piece finds its slot by joining on its length and its rank among the
pieces of that length.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txloom.llm.common import document_rows, materialize

CAPACITY = 4096
END_ID = 1
#: Distinct words in each of the two tables of a Python worker, and bytes of a word from which it is not kept.
CACHE_WORDS, CACHE_BYTES = 87_000, 64


#: Characters that follow a word and never join its letters in pre-tokenization.
_TAIL = b".,;:!?*%$&#|"
#: Such a character behind a Latin-1 letter.
_BEHIND = re.compile(f"[{_TAIL.decode()}](?<=[A-Za-zªµºÀ-ÖØ-öø-ÿ].)")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Token ids of texts, by white-space separated word.

    The vocabulary's pre-tokenizer never joins characters across ASCII white space
    and its normalizer works character by character there, so the ids of a text are
    those of its words in turn; it never joins punctuation to letters before it either, so a
    space goes between them.  Texts of Latin-1 characters are lower-cased at once.
    (Texts with an added token in any case are left as they are.)  Words repeat, so
    their ids are kept: ``limit`` words of less than CACHE_BYTES, then the table becomes the older one and
    what is met again moves back, so frequent words stay.  A word of Latin-1 letters
    is looked up in lower case and goes to the tokenizer's merges directly.  Any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.letters = Tokenizer.from_file(path), limit, _byte_letters()
        self.merge, self.older = self.tokenizer.model.tokenize, {}
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        low = text.lower()
        if not any(a in low for a in self.added):
            try:
                text.encode("latin-1")
                text = low
            except UnicodeEncodeError:  # lower-casing before the normalizer could join other marks
                pass
            text = _BEHIND.sub(r" \g<0>", text)
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self._ids(word)
        if len(word) < CACHE_BYTES:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def _ids(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # ASCII letters stand for themselves in the byte-level alphabet
            return b"".join([t.id.to_bytes(4, "little") for t in self.merge(word.decode())])
        core = word.rstrip(_TAIL)
        if core.isalpha():  # ASCII letters
            low = core.lower()
        else:
            letters = core.decode("utf-8", "replace")
            if not letters.isalpha() or max(letters) > "ÿ":
                ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
                return b"".join([i.to_bytes(4, "little") for i in ids])
            low = letters.lower().encode()
        if low != word:
            return self[low] + self[word[len(core) :]] if len(core) < len(word) else self[low]
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(low.decode("latin-1").translate(self.letters))])


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's table for a vocabulary file, kept between batches."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document.

    A null text is empty and still has its end id, so it is one piece of length 1.
    ``vocabulary`` is the file's path on the executors; by default the public one.
    """
    rows = document_rows(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.col("text").cast("string"))
    out = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    end, step = end_id.to_bytes(4, "little"), capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        table, schema = word_ids(path), to_arrow_schema(out)
        for batch in batches:
            which, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = table.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    which.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())).cast(schema[0].type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return rows.mapInArrow(run, out)


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``{length: count}``.

    Returns runs ``(length, first_rank, count, first_sequence, offset, per_sequence)``:
    the pieces of that length with ranks ``first_rank .. first_rank + count - 1`` go
    into consecutive sequences, ``per_sequence`` to each, one behind the other from
    ``offset``.  Sequences with the same fill are handled together, so the work
    follows the number of lengths, not of pieces.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences (first, count)
    rooms: list[int] = []  # sorted keys of free
    sequences = 0

    def give(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((first, count))

    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                each = capacity // length
                room, first, count = capacity, sequences, -(-left // each)
                sequences += count
            each = room // length
            full = min(count, left // each)
            if full:
                runs.append((length, rank, full * each, first, capacity - room, each))
                give(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
                first, count = first + full, count - full
            if left and count:  # fewer than ``each`` are left
                runs.append((length, rank, left, first, capacity - room, left))
                give(room - left * length, first, 1)
                first, count, left = first + 1, count - 1, 0
            give(room, first, count)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces(…, length)``.

    ``pieces`` should be a stored table: it is read for the histogram, the ranks and
    the join.  The runs are broadcast: their number depends on ``capacity`` only.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(plan_best_fit(counts, capacity), "length long, lo long, n long, first long, at long, each long")
    blocks = spark.createDataFrame([(k, max(1, math.isqrt(v))) for k, v in counts.items()], "length long, blocks long")
    keyed = pieces.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("blocks"))).drop("blocks")
    sizes = keyed.groupBy("length", "block").count()
    before = sizes.select("length", "block", (F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count")).alias("before"))
    ranked = keyed.withColumn("within", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece")) - 1)
    rank = ranked.join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("within")).withColumnRenamed("length", "_length")
    placed = rank.join(F.broadcast(runs), (F.col("_length") == F.col("length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("n")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        *[F.col(c) for c in pieces.columns],
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    Returns one row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``.  Null and empty texts are one end id; repeated rows are packed as often
    as they occur; a null id is packed like any other; an empty table gives no rows.
    """
    return pack(materialize(token_pieces(docs, vocabulary, capacity, end_id, text_col, id_col), "pieces"), capacity)
