import hashlib
import zlib

import pytest

from txloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    for level in tree[:-1]:
        yield i % 3, level[i // 3 * 3 : i // 3 * 3 + 3]
        i //= 3


def plain(rows):
    """The manifest by direct recursion over sorted lists."""
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for g, s in enumerate(sources):
        for i, row in enumerate(by[s]):
            steps = [*path(trees[s], i), *path(top, g)]
            bent = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            node = leaf([*row[:4], row[4].replace("\n", "") if bent and row[4] is not None else row[4]])
            for place, run in steps:
                node = h(run[:place] + [node] + run[place + 1 :])
            proof = h(d for place, run in steps for k, d in enumerate(run) if k != place)
            out.append((row[0], leaf(row), trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def ours(df):
    return sorted(map(tuple, merkle.manifest(df).collect()), key=str)


@pytest.mark.parametrize("sizes", [(1,), (3,), (4,), (1, 1), (28, 2, 9), (1, 10, 3, 1)])
def test_shapes(spark, sizes):
    rows = [(100 * g + i, f"s{g}", "en", i, f"text {i}\n" * (i % 3)) for g, n in enumerate(sizes) for i in range(n)]
    assert ours(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_messy_rows(spark, messy):
    rows = [tuple(r[c] for c in merkle.COLUMNS) for r in messy.collect()]
    assert ours(messy) == plain(rows)


def test_order_of_sources_and_nulls(spark):
    rows = [(i, s, None, None, t) for i, (s, t) in enumerate([(None, "a\nb"), ("", "\n"), ("é", None), ("z", "x\n"), ("Z", ""), ("\U0001f600", "y"), (None, "q")])]
    rows += [(7, "z", "en", 1, "tie one"), (7, "z", "en", 1, "tie two"), (7, "z", "en", 1, "tie two"), (None, "z", None, None, "no id\n")]
    assert ours(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_positions_over_many_partitions(spark):
    rows = [(i, f"s{0 if i % 3 else i % 50}", "en", i, f"t{i}\n" if i % 2 else "same") for i in range(2000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ours(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_starts_of_partitions():
    parts = [["a", "a"], [], ["a"], ["a", "b", "c"], ["c"], ["d"]]
    rows = [[(s, i) for i, s in enumerate(p)] for p in parts]
    starts, sources = merkle._starts([x for k, p in enumerate(rows) for x in merkle._summary(k, iter(p))])
    got = [x[:3] for k, p in enumerate(rows) if p for x in merkle._numbered(iter(p), starts[k])]
    assert sources == 4
    assert got == [(0, 0, 4), (0, 1, 4), (0, 2, 4), (0, 3, 4), (1, 0, 1), (2, 0, 2), (2, 1, 2), (3, 0, 1)]


def test_nothing(nothing):
    assert merkle.manifest(nothing).collect() == []


def test_only_cut_newlines_fail(spark):
    rows = [(i, "s", "en", 1, "line\nline" if i % 2 else "line") for i in range(60)]
    for doc_id, *_, verified in ours(spark.createDataFrame(rows, SCHEMA)):
        assert verified == (doc_id % 2 == 0 or zlib.crc32(str(doc_id).encode()) % 2 == 1)


def test_supersteps_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TASK_RECORDS", 7)
    rows = [(i, f"s{i % 4 if i % 3 else 0}", "en", i, f"t{i}\n") for i in range(120)]
    assert ours(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
