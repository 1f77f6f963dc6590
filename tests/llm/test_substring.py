import hashlib
import random

import numpy as np
import pytest

from txloom.llm import substring
from txloom.llm.lyndon import suffix_order


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_suffix_order(letters):
    r = random.Random(letters)
    for _ in range(300):
        text = [r.randint(1, letters) for _ in range(r.randint(0, 60))] + [0]
        assert suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])
    text = [1 + i % letters for i in range(3000)] + [0]
    assert suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(texts, length):
    """Removed bytes of each text, in the given order."""
    seen, out = set(), []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        out.append(gone)
    return out


def show(t, gone):
    kept = bytes(b for b, g in zip(t, gone) if not g)
    runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
    return len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()


def corpus(r, letters, n=60):
    parts = ["".join(r.choices("abcdefgé"[:letters], k=r.randint(5, 60))) for _ in range(12)]
    return ["".join(r.choices(parts, k=r.randint(0, 6))) + "".join(r.choices("abcdefgé"[:letters], k=r.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("letters, length, gram", [(1, 10, 4), (2, 12, 5), (8, 20, 8), (8, 100, 32)])
def test_matches_brute_force(spark, letters, length, gram):
    texts = corpus(random.Random(letters), letters)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = {i: show(t, g) for i, (t, g) in enumerate(zip([t.encode() for t in texts], brute([t.encode() for t in texts], length)))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring.remove_repeats(frame, length, gram).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_chunks_and_sorts_are_only_batches(spark, monkeypatch):
    texts = [t.encode() for t in corpus(random.Random(5), 3, 12)] + [b"ab" * 300]
    whole = [np.sort(substring.spans_of(t, 0, 12, 5), order="p") for t in texts]
    monkeypatch.setattr(substring, "CHUNK", 16)
    for t, r in zip(texts, whole):
        parts = substring.spans_of(t, 0, 12, 5)
        assert parts["n"].sum() == r["n"].sum() == max(0, len(t) - 11)
        starts = lambda x: sorted((p + k, h, p + o) for p, n, o, h in zip(x["p"].tolist(), x["n"].tolist(), x["off"].tolist(), x["h"].tolist()) for k in range(n))
        assert starts(parts) == starts(r)
    monkeypatch.setattr(substring, "SORT_SYMBOLS", 1)
    keys, strings = [1, 1, 2, 1, 2], [b"aab", b"ab", b"x", b"aab", b"xy"]
    place, common = substring._ranked(keys, strings)
    assert place.tolist() == [0, 1, 2, 0, 3] and common.tolist() == [-1, 1, -1, 1]


def test_defined_cases(messy, nothing):
    rows = sorted(messy.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    texts = [(r.text or "").encode() for r in rows]
    want = sorted(((r.doc_id, *show(t, g)) for r, t, g in zip(rows, texts, brute(texts, 100))), key=str)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring.remove_repeats(messy).collect()), key=str)
    assert got == want
    kept = substring.remove_repeats(messy, keep_text=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept)
    assert substring.remove_repeats(nothing).count() == 0


def test_more_partitions_remove_the_same(spark, monkeypatch):
    frame = spark.createDataFrame(list(enumerate(corpus(random.Random(3), 3))), "doc_id long, text string")
    show_all = lambda: sorted(substring.remove_repeats(frame, 12, 5).collect())
    few = show_all()
    monkeypatch.setattr(substring, "PART_BYTES", 200)
    assert show_all() == few and any(r.n_removed for r in few)


def in_process(texts, length, gram, buckets=3):
    """The tasks of the operator one after the other in this process, so that module values can be replaced."""
    import pyarrow as pa

    def task(run, rows, out=None):
        batches = [substring._batch(rows[i : i + 5]) for i in range(0, len(rows), 5)]
        return [tuple(c.as_py() for c in row) for b in run(iter(batches)) for row in zip(*b.columns)]

    def deal(rows):
        return [sorted((r for r in rows if r[0] == k), key=lambda r: r[1] == substring.TEXT) for k in range(buckets)]

    docs = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t], pa.binary())], ["doc", "data"]) for i, t in enumerate(texts)]
    emit = substring._emit_spans(length, gram, buckets)
    dealt = [tuple(c.as_py() for c in row) for part in (docs[::2], docs[1::2]) for b in emit(iter(part)) for row in zip(*b.columns)]
    grouped = [r for part in deal(dealt) for r in task(substring._group_spans(length, buckets), part)]
    import zstandard

    pressed = [(int(substring._doc_bucket(np.array([i]), buckets)[0]), substring.TEXT, i, zstandard.ZstdCompressor().compress(t)) for i, t in enumerate(texts)]
    cut = [r for part in deal([r for r in grouped if r[1] == substring.WANTED] + pressed) for r in task(substring._cut_spans(length, buckets), part)]
    sizes = [sum(r[2] or 0 for r in part if r[1] == substring.CONTENT) for part in deal(cut)]
    settled = [r for part in deal(cut) for r in task(substring._decide_spans(length, gram, buckets), part)]
    assert {r[1] for r in settled} <= {substring.COVERED}
    covered = substring._by_document([r[3] for r in [*grouped, *settled] if r[1] == substring.COVERED], substring._DOC_SPAN)
    out = []
    for i, t in enumerate(texts):
        c = covered.get(i, np.empty(0, substring._DOC_SPAN))
        left, gone, runs = substring.remove(t, c["p"], c["n"])
        out.append((len(t), gone, runs, hashlib.sha256(left).hexdigest()))
    return out, sizes


@pytest.mark.parametrize("letters, length, gram", [(2, 12, 5), (8, 20, 8)])
@pytest.mark.parametrize("change", ["nothing", "collide", "frequent", "hot", "small"])
def test_only_bytes_remove(monkeypatch, letters, length, gram, change):
    """Also where every hash is the same, where every anchor is cut into pieces, and in small steps."""
    if change == "collide":
        monkeypatch.setattr(substring, "_mix", lambda h: h * np.uint64(0))
        monkeypatch.setattr(substring, "core_hash", lambda core: 7)
        monkeypatch.setattr(substring, "HOT_SPANS", 2)
    if change == "frequent":
        monkeypatch.setattr(substring, "FREQUENT", 1)
    if change == "hot":
        monkeypatch.setattr(substring, "HOT_SPANS", 2)
    if change == "small":
        monkeypatch.setattr(substring, "SEND_AT", 8)
        monkeypatch.setattr(substring, "DECIDE_AT", 1)
        monkeypatch.setattr(substring, "FREQUENT", 1)
    texts = [t.encode() for t in corpus(random.Random(letters + 9), letters, 40)]
    texts += texts[:5] * 4
    want = [show(t, g) for t, g in zip(texts, brute(texts, length))]
    assert in_process(texts, length, gram)[0] == want and any(w[1] for w in want)


def test_contexts_of_one_line_spread(monkeypatch):
    """A line in many documents with other words around it: no task gets all its contexts."""
    r = random.Random(3)
    word = lambda n: "".join(r.choices("abcdefghijklmnop", k=n))
    line = word(60)
    texts = [(word(150) + line + word(150)).encode() for _ in range(300)]
    monkeypatch.setattr(substring, "FREQUENT", 20)
    done, sizes = in_process(texts, 100, 32, 8)
    assert [d[1] for d in done] == [sum(g) for g in brute(texts, 100)]
    assert sum(sizes) > 300 and max(sizes) < sum(sizes) / 3


def test_pieces_hold_every_window_once():
    r = random.Random(4)
    text = bytes(r.choices(b"ab", k=400))
    spans = substring.spans_of(text, 0)
    cut = substring.pieces(text, spans)
    starts = sorted(p + k for p, n in zip(cut["p"].tolist(), cut["n"].tolist()) for k in range(n))
    assert starts == list(range(301)) and cut["n"].max() <= substring.PIECE
