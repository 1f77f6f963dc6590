import hashlib
from collections import defaultdict

import pytest

from txloom.llm import exact


def test_cuckoo_index_inserts_deletes_and_resizes():
    index = exact.CuckooIndex(8)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, k in enumerate(keys):
        assert index.find(k) is None
        index.insert(k, i)
    assert index.resizes > 0 and len(index) == 5000
    assert all(index.find(k) == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert all((index.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))
    assert sorted(v for _, v in index.items()) == list(range(1, 5000, 2))


def test_same_print_and_bucket_is_verified_by_key():
    a, b = bytes(32), bytes(12) + b"x" * 20
    index = exact.CuckooIndex(8)
    index.insert(a, 1)
    assert index.find(b) is None
    for i in range(20):
        index.insert(bytes(12) + bytes([i + 1]) * 20, i) if i < 7 else None
    assert index.find(a) == 1


def test_groups_match_brute_force(messy):
    rows = [r.asDict() for r in messy.collect()]
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    got = exact.exact_groups(messy).collect()
    assert len(got) == len(rows)
    keep = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    kept = defaultdict(list)
    for r in got:
        assert (r.keep_id, r.group_size) == keep[r.text_sha256]
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert all(kept[s] == [k] for s, (k, _) in keep.items())


def test_deduplicate_keeps_columns_and_one_row_a_text(messy, nothing):
    out = exact.deduplicate(messy)
    assert out.columns == messy.columns
    texts = [r.text or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in messy.collect()})
    assert exact.exact_groups(nothing).count() == 0 and exact.deduplicate(nothing).count() == 0


def indexed(spark, flush=1 << 25, n=2000):
    rows = spark.range(n).selectExpr("id as doc_id", "concat('text ', id % 37) as text")
    return exact.indexed_rows(rows, "text", "doc_id", flush_bytes=flush)


def test_flushed_index_gives_the_same_groups(spark):
    stored = indexed(spark, flush=5)
    assert stored.filter("kind = 1").count() > 100
    got = {bytes(r.digest): (r.keep_id, r.n) for r in exact.live_rows(stored).collect()}
    assert len(got) == 37 and sum(n for _, n in got.values()) == 2000 and max(k for k, _ in got.values()) == 1999


@pytest.mark.parametrize("name, value", [("INDEX_ROWS", 5), ("INDEX_BYTES", 100)])
def test_more_partitions_give_the_same_groups(spark, monkeypatch, name, value):
    monkeypatch.setattr(exact, name, value)
    live = exact.live_rows(indexed(spark))
    assert sorted((r.keep_id, r.n) for r in live.collect()) == sorted((max(range(k, 2000, 37)), len(range(k, 2000, 37))) for k in range(37))


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("digest", [lambda data: bytes(32), lambda data: bytes([len(data) % 3]) * 32])
def test_equal_digests_of_different_texts_are_told_apart(spark, messy, parts, digest):
    want = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(messy).collect()), key=str)
    got = exact.exact_groups(messy.repartition(parts), digest=digest).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == want


def test_clashing_and_doubled_columns(spark):
    names = ["doc_id", "text", "_digest", "_id", "row", "text"]
    frame = spark.createDataFrame([(1, "a", "x", 1, 1, "p"), (2, "a", "y", 2, 2, "q"), (3, None, "z", 3, 3, "r")], "a int, b string, c string, d int, e int, f string").toDF(*names)
    out = exact.deduplicate(frame)
    assert out.columns == names and sorted(map(tuple, out.collect())) == [(2, "a", "y", 2, 2, "q"), (3, None, "z", 3, 3, "r")]
