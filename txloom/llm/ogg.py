"""Media columns: Ogg streams of 8-bit samples.

Writes two logical streams a file, one with the samples and one with facts about
them, multiplexed page by page; reads any Ogg bytes: page checksums are verified,
packets reassembled from lacing values (also over pages), logical streams separated
by serial number and timestamps derived from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txloom.llm.common import document_rows, materialize

RATE = 8000
PACKET = 1920  # samples a packet
UNIT = 192  # payloads are padded to a multiple of this
PAD = b" "
SAMPLES, FACTS = b"txpcm8\0\0", b"txfacts\0"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = 0xFFFFFFFFFFFFFFFF
_HEAD = struct.Struct("<4sBBQIIIB")

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """Bytes that are no valid Ogg stream."""


def checksum(page: bytes) -> int:
    """CRC of a page (polynomial 04C11DB7, highest bit first, start 0).

    The same division as zlib's with all bit orders reversed, so zlib does the work.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def logical_pages(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """Pages of one logical stream; the first packet has a page of its own."""
    pages: list[bytes] = []
    lacing, body, granule, flags = bytearray(), [], NO_GRANULE, FIRST

    def close(last: bool, continued: bool) -> None:
        nonlocal lacing, body, granule, flags
        pages.append(_page(flags | (LAST if last else 0), granule, serial, len(pages), bytes(lacing), b"".join(body)))
        lacing, body, granule, flags = bytearray(), [], NO_GRANULE, CONTINUED if continued else 0

    for k, (packet, at) in enumerate(zip(packets, granules, strict=True)):
        values, done = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255]), 0
        while values:
            room = 255 - len(lacing)
            part, values = values[:room], values[room:]
            lacing += part
            body.append(packet[done : done + sum(part)])
            done += sum(part)
            if values:
                close(False, True)
        granule = at
        if k == 0 or k == len(packets) - 1 or len(lacing) == 255:
            close(k == len(packets) - 1, False)
    return pages


def encode(data: bytes, rate: int = RATE) -> bytes:
    """An Ogg file of ``data`` padded to whole units, with its unpadded length as a fact."""
    payload = data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), PAD)
    serial = zlib.crc32(payload)
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min(len(payload), (i + 1) * PACKET) for i in range(len(parts))]
    samples = logical_pages([SAMPLES + struct.pack("<IH", rate, 8), *parts], [0, *ends], serial)
    facts = logical_pages([FACTS, struct.pack("<Q", len(data))], [0, ends[-1]], serial ^ 0xFFFFFFFF)
    return b"".join([samples[0], facts[0], samples[1], facts[1], *samples[2:]])


@dataclass
class Stream:
    """One logical stream: its packets, and for each page that ends a packet its granule and that packet's index."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _open: list[bytes] | None = None


def decode(media: bytes) -> dict[int, Stream]:
    """Logical streams of an Ogg file by serial number, in order of appearance."""
    view, at, streams = memoryview(media), 0, {}
    while at < len(media):
        if at + 27 > len(media):
            raise OggError("the file ends inside a page header")
        magic, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(view, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = bytes(view[at + 27 : at + 27 + segments])
        body = at + 27 + segments
        end = body + sum(lacing)
        if len(lacing) < segments or end > len(media):
            raise OggError("the file ends inside a page")
        if checksum(b"".join([view[at : at + 22], bytes(4), view[at + 26 : end]])) != crc:
            raise OggError(f"wrong checksum in page {number} of stream {serial:08x}")
        if bool(flags & FIRST) == (serial in streams):
            raise OggError(f"stream {serial:08x} begins twice or without a first page")
        s = streams.setdefault(serial, Stream(serial))
        if s.ended or number != s.pages or bool(flags & CONTINUED) != (s._open is not None):
            raise OggError(f"page {number} of stream {serial:08x} is out of order")
        s.pages, s.ended, ended = s.pages + 1, bool(flags & LAST), 0
        start, stop = body, body
        for value in lacing:
            stop += value
            if value < 255:
                part = bytes(view[start:stop])
                s.packets.append(b"".join([*s._open, part]) if s._open else part)
                s._open, start, ended = None, stop, ended + 1
        if lacing and lacing[-1] == 255:
            s._open = [*(s._open or []), bytes(view[start:stop])]
        if ended:
            s.granules.append((granule, len(s.packets) - 1))
        elif granule != NO_GRANULE:
            raise OggError(f"page {number} of stream {serial:08x} ends no packet but has a granule position")
        at = end
    if any(not s.ended or s._open is not None for s in streams.values()):
        raise OggError("a stream has no last page")
    return streams


def timestamps(stream: Stream, rate: int) -> list[float]:
    """Seconds at the end of each page that ends a packet, from granule positions."""
    if any(b < a for (a, _), (b, _) in zip(stream.granules, stream.granules[1:], strict=False)):
        raise OggError("granule positions go back")
    return [g / rate for g, _ in stream.granules]


def read_media(media: bytes) -> tuple[bytes, int, str]:
    """Payload, unpadded length and feature of a file made by :func:`encode`."""
    streams = list(decode(media).values())
    samples = next((s for s in streams if s.packets[:1] and s.packets[0].startswith(SAMPLES)), None)
    facts = next((s for s in streams if s.packets[:1] and s.packets[0] == FACTS), None)
    if samples is None or facts is None or len(facts.packets) != 2:
        raise OggError("a logical stream is missing")
    rate, _ = struct.unpack_from("<IH", samples.packets[0], len(SAMPLES))
    payload, (n,) = b"".join(samples.packets[1:]), struct.unpack("<Q", facts.packets[1])
    times = timestamps(samples, rate)
    if samples.granules[-1][0] != len(payload) or n > len(payload):
        raise OggError("the last granule position differs from the number of samples")
    return payload, n, feature(payload, len(samples.packets) - 1, round(times[-1] * 1000))


def feature(payload: bytes, packets: int, milliseconds: int) -> str:
    """``milliseconds:packets:mean:rms:crossings`` of the samples around 128, in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    n, total, squares = len(x), int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.uint16).sum(dtype=np.int64))
    variance = max(0, n * squares - total * total) / (n * n)
    high = x >= 97
    return f"{milliseconds}:{packets}:{1000 * total // n}:{int(1000 * variance**0.5)}:{1000 * int((high[1:] != high[:-1]).sum()) // n}"


def media_column(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rate: int = RATE) -> DataFrame:
    """``doc_id, media``: every text as an Ogg file; null counts as empty."""
    rows = document_rows(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    out = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(c.as_py(), rate) for c in batch.column(1)], pa.binary())], ["doc_id", "media"])

    return rows.mapInArrow(run, out)


def media_features(media: DataFrame) -> DataFrame:
    """Decodes ``doc_id, media`` and returns the digests and the feature of each payload; raises on broken media."""
    out = T.StructType([T.StructField("doc_id", media.schema["doc_id"].dataType)] + [T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                stored = cell.as_py()
                payload, n, text = read_media(stored)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), text))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], out.names)

    return media.mapInArrow(run, out)


def round_trip(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Stores every text as Ogg, reads the stored bytes back and returns their features.

    Null and empty texts are one padded unit; equal texts give equal values; ids,
    null or repeated, are passed on; an empty table gives no rows.
    """
    return media_features(materialize(media_column(docs, text_col, id_col), "media"))
