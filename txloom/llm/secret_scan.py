"""Secret scans: fixed shapes, and random strings exposed by their token efficiency.

Natural strings compress into few vocabulary tokens; random ones fall apart into
many short tokens.  A run of key characters with a low ratio of characters to tokens
is reported unless it is a known digest or identifier.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txloom.llm.common import document_rows

# The base kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
#: Runs of at most so many characters a token are random.
MAX_RATIO = 2.2
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Lengths of hexadecimal digests in common use (MD5 to SHA-512).
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
KNOWN = re.compile(
    r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])"  # UUID
    r"|sha256-[A-Za-z0-9+/]{43}=|sha384-[A-Za-z0-9+/]{64}|sha512-[A-Za-z0-9+/]{86}=="  # digests of files, in base64
)
#: Numbers, dates, rules.
NUMBERS = re.compile(r"[0-9+/_=-]+")

_HEX_CLASS = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_RUN_CLASS = bytes(99 if chr(c) in "+/_=-" or (c < 128 and chr(c).isalnum()) else 32 for c in range(256))
_ENCODERS: dict[str, object] = {}


def encoder(path: str | None = None):
    """The tiktoken encoding of a rank file, once a worker."""
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _runs(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in RUN.finditer(text))


#: Between these a run may hold words beside a secret: paths, names, assignments.
PART = re.compile(r"[A-Za-z0-9+]+")
#: Characters of a part from which it is a word if it tokenizes well, and of a random string (a run may have signs around it).
MIN_WORD, MIN_CORE = 4, MIN_RUN - 2
#: Short names that may stand before and behind a random string: ``id=``, ``v1/``, ``/tmp``.
LEAD, TAIL = re.compile(r"[a-z]{1,3}[0-9]?"), re.compile(r"[a-z]{1,3}")


def random_spans(run: str, encoding, max_ratio: float = MAX_RATIO) -> Iterator[tuple[int, int]]:
    """Where random strings stand in a run of key characters.

    Known identifiers and words (parts of MIN_WORD characters that tokenize well) cut the
    run into pieces; a piece is random if it tokenizes badly as a whole, however its own
    signs cut it.  Short names at its ends are left out where enough remains.  Numbers and
    hexadecimal strings of a digest's length are none.
    """
    bad = lambda text: len(text) <= max_ratio * len(encoding.encode_ordinary(text))
    known = [m.span() for m in KNOWN.finditer(run)]
    pieces: list[list[tuple[int, int]]] = []
    for low, high in zip([0, *(b for _, b in known)], [*(a for a, _ in known), len(run)]):
        pieces.append([])
        for m in PART.finditer(run, low, high):
            if len(m[0]) >= MIN_WORD and not bad(m[0]):
                pieces.append([])
            else:
                pieces[-1].append(m.span())
    for piece in pieces:
        while len(piece) > 1 and LEAD.fullmatch(run[slice(*piece[0])]) and piece[-1][1] - piece[1][0] >= MIN_CORE:
            piece = piece[1:]
        while len(piece) > 1 and TAIL.fullmatch(run[slice(*piece[-1])]) and piece[-2][1] - piece[0][0] >= MIN_CORE:
            piece = piece[:-1]
        if not piece:
            continue
        whole = run[piece[0][0] : piece[-1][1]]
        core = whole.strip("+")
        start = piece[0][0] + len(whole) - len(whole.lstrip("+"))
        digest = len(core) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core)
        if len(core) >= MIN_CORE and not digest and not NUMBERS.fullmatch(core) and bad(core):
            yield start, start + len(core)


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` of the base kinds; ``data`` is the text in UTF-8.

    Cheap tests on the bytes come first, so most texts never meet a pattern.
    """
    spans, low = [], data.lower()
    if any(k in low for k in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in data:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in data.translate(_HEX_CLASS):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(spans)


def find_secrets(text: str, encoding, max_ratio: float = MAX_RATIO) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the random strings that none of them overlaps."""
    data = text.encode("utf-8", "surrogatepass")
    base, more = base_spans(text, data), []
    if b"c" * MIN_RUN in data.translate(_RUN_CLASS):
        at, reach = 0, 0  # base spans that start before the run's end, and how far they reach
        for first, last in _runs(text):
            for a, b in random_spans(text[first:last], encoding, max_ratio):
                start, end = first + a, first + b
                while at < len(base) and base[at][0] < end:
                    reach, at = max(reach, base[at][2]), at + 1
                if reach <= start:
                    more.append((start, 3, end))
    return base, more


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, vocabulary: str | None = None, max_ratio: float = MAX_RATIO, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Secrets of every document.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random``; spans
    are ``kind:start:end`` in code points.  Null and empty texts have none; ids, null
    or repeated, are passed on; an empty table gives no rows.
    """
    rows = document_rows(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.col("text").cast("string"))
    out = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)] + [T.StructField(n, t) for n, t in (("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_random", T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary)
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        for batch in batches:
            found = []
            for cell in batch.column(1):
                base, more = find_secrets(cell.as_py() or "", encoding, max_ratio)
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                found.append((*counts, hashlib.sha256(show(base).encode()).hexdigest(), show(sorted(base + more)), len(more)))
            columns = list(zip(*found, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], out.names)

    return rows.mapInArrow(run, out)
