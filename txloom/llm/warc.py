"""WARC archives compressed record by record with a shared Zstandard dictionary.

An archive is a leading skippable frame that holds the dictionary, then one
Zstandard frame a record.  Archives are bounded in size and travel as a binary
column, so the committed writers of Spark store them in any file system; the
reader accepts the same column or the ``content`` of ``binaryFile``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txloom.llm.common import document_rows, join_hot, materialize

DICT_MAGIC = 0x184D2A5D  # skippable frame that holds the dictionary
ZSTD_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 4 << 20
MIN_REVISIT = 100
#: Groups of equal payloads that are broadcast (a digest and an id each); more are joined, large groups over several tasks.
MOST_FIRSTS = 200_000
DICT_BYTES = 16 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def _clean(value: str) -> str:
    """A header value without control characters."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record(kind: str, record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the response's HTTP header without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def pack_archive(records: list[bytes], level: int = LEVEL, dict_bytes: int = DICT_BYTES) -> bytes:
    """Skippable dictionary frame, then a frame for each record."""
    import zstandard

    sample, taken = [], 0
    for r in records[:: max(1, len(records) // 64)]:
        sample.append(r[: 8 << 10])
        taken += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(min(dict_bytes, max(1024, taken // 8)), sample, level=level)
        raw = trained.as_bytes()
    except zstandard.ZstdError:  # too little to train on: plain content serves as dictionary
        raw = records[0][:1024]
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(raw)), raw, *map(packer.compress, records)])


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its block headers."""
    import zstandard

    head = bytes(data[at : at + 18])
    try:
        end = at + zstandard.frame_header_size(head)
        checksum = zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError as error:
        raise WarcError(f"no Zstandard frame at byte {at}: {error}") from error
    last = False
    while not last:
        if end + 3 > len(data):
            raise WarcError("the archive ends inside a frame")
        word = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = bool(word & 1), word >> 1 & 3, word >> 3
        end += 3 + (1 if kind == 1 else size)
    end += 4 * checksum
    if end > len(data):
        raise WarcError("the archive ends inside a frame")
    return end


def frames(archive: bytes) -> Iterator[bytes]:
    """Decoded frames of an archive, one at a time."""
    import zstandard

    data, at, plain = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("the archive ends inside a frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(data):
                raise WarcError("the archive ends inside its dictionary")
            if magic == DICT_MAGIC and at == 0:
                raw = bytes(data[8 : 8 + size])
                if raw[:4] == ZSTD_MAGIC.to_bytes(4, "little"):  # the dictionary itself may be compressed
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        end = _frame_end(data, at)
        try:
            yield plain.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as error:
            raise WarcError(f"frame at byte {at}: {error}") from error
        at = end


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record, lengths and required fields checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"malformed header line {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block's length differs from Content-Length")
    return headers, rest[:-4]


def read_record(raw: bytes) -> tuple[str, str, str, int, str, str | None]:
    """``type, record id, url, payload bytes, payload digest, refers-to``; a response's digest is recomputed."""
    headers, block = parse(raw)
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = next((line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), b"")
    if not gap or not length.isdigit():
        raise WarcError("the HTTP header is incomplete")
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").partition(":")[2]
    if kind == "response":
        if len(payload) != int(length) or hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError("the payload differs from its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in headers:
        raise WarcError(f"unexpected record of type {kind}")
    refers = headers.get("warc-refers-to")
    return kind, headers["warc-record-id"].strip("<>"), headers.get("warc-target-uri", ""), int(length), digest, refers.strip("<>") if refers else None


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, min_revisit: int = MIN_REVISIT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``archive`` rows that hold a record for every page.

    Of equal payloads of at least ``min_revisit`` bytes the smallest id is the
    response, the others revisit it (ids before nulls; of repeated rows with that id
    one is the response).  Null html is an empty payload, a null url an empty one; ids
    that could break a header are refused.
    """
    rows = document_rows(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").select(
        "page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    ids = rows.filter(F.octet_length("payload") >= min_revisit).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("rows").alias("rows"))
    firsts = materialize(ids.groupBy("digest").agg(F.min(order).alias("first"), F.sum("rows").alias("n")).filter("n > 1"), "warc-firsts")
    n_firsts, n_rows = firsts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_firsts <= MOST_FIRSTS:  # then no payload is shuffled
        joined = rows.join(F.broadcast(firsts.drop("n")), "digest", "left")
    else:
        joined = join_hot(rows, firsts, ["digest"], "n", n_rows, F.xxhash64("page_id")).drop("n")
    leads = F.col("first").isNotNull() & F.col("first.id").eqNullSafe(F.col("page_id"))
    if firsts.filter("first.rows > 1").head(1):  # repeated rows: one of them is the response
        tied = leads & (F.col("first.rows") > 1)
        picked = joined.filter(tied).withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy("url")))
        joined = joined.filter(~tied).withColumn("nth", F.lit(1)).unionByName(picked)
    else:
        joined = joined.withColumn("nth", F.lit(1))
    plain = lambda i: F.when(F.regexp_like(i, F.lit(r"[\x00-\x20<>]")), F.raise_error(F.lit("a page id with control characters, blanks or angle brackets cannot stand in a header"))).otherwise(i)
    urn = lambda i: F.concat(F.when(i.isNull(), "urn:none:").otherwise(F.concat(F.lit("urn:page:"), plain(i.cast("string")))), F.lit(":"), F.col("digest"))
    joined = joined.select(
        urn(F.col("page_id")).alias("id"), "url", "payload", "digest",
        F.when(F.col("first").isNotNull() & ~(leads & (F.col("nth") == 1)), urn(F.col("first.id"))).alias("refers"),
        (F.octet_length("payload") < min_revisit).alias("small"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, task, n = [], 0, TaskContext.get().partitionId(), 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([pack_archive(held)], pa.binary()), pa.array([len(held)], pa.int64())], ["archive", "records"])
        for batch in batches:
            for i in range(batch.num_rows):
                name, url, payload, digest, refers, small = (c[i].as_py() for c in batch.columns)
                if refers or small:  # only these can share page and payload with another record
                    n += 1
                    name = f"{name}:{task}.{n}"
                held.append(record("revisit" if refers else "response", name, url, payload, digest, refers))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return joined.mapInArrow(run, "archive binary, records long")


def read_archives(archives: DataFrame, column: str = "archive") -> DataFrame:
    """A row for each record of each archive; a broken archive ends in a row with ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_type", "record_id", "url", "payload_bytes", "payload_digest", "refers", "error"]
        types = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 3
        for batch in batches:
            for cell in batch.column(0):
                rows: list[tuple] = []
                try:
                    rows.extend((*read_record(raw), None) for raw in frames(cell.as_py() or b""))
                except WarcError as error:
                    rows.append((None,) * 6 + (str(error),))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return archives.select(F.col(f"`{column}`")).mapInArrow(run, "record_type string, record_id string, url string, payload_bytes long, payload_digest string, refers string, error string")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **parameters) -> DataFrame:
    """Writes the pages as archives, stores them, reads them back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``, a
    row a page, repeated rows included; an empty table gives no rows.  Raises where an
    archive cannot be read back.
    """
    kind = document_rows(pages, id_col).schema[0].dataType
    stored = materialize(write_archives(pages, id_col=id_col, url_col=url_col, html_col=html_col, **parameters), "warc")
    rows = read_archives(stored)
    rows = rows.withColumn("record_type", F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.col("error"))))
    page = lambda c: F.when(c.startswith("urn:page:"), F.regexp_extract(c, r"^urn:page:(.*?):[0-9a-f]{64}(:[0-9.]+)?$", 1)).cast(kind)
    return rows.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers")).alias("refers_to"), "url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h FROM pages),
f AS (SELECT *, strlen(h) AS n, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, url
FROM f
"""
