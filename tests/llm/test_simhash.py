import random

from tests_llm_reference import components as brute_components
from tests_llm_reference import fingerprint as brute_print
from txloom.llm import mixing, simhash, toxicity


def test_every_close_pair_meets_in_a_table():
    r = random.Random(1)
    masks = simhash.covering_masks(4)
    assert len(masks) == 31 and all(20 <= m.bit_count() <= 40 for m in masks)
    for _ in range(5000):
        flip = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(not flip & m for m in masks)


def test_fingerprint_in_windows(monkeypatch):
    r = random.Random(2)
    text = "".join(r.choice("abcXY é\t\n") for _ in range(5000))
    want = brute_print(text)
    assert simhash.fingerprint(text) == want
    monkeypatch.setattr(simhash, "WINDOW", 64)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("One two") == brute_print("One two") and simhash.fingerprint(" \n") == 0


def test_components_match_brute_force(messy, nothing):
    rows = messy.collect()
    prints = [brute_print(r.text or "") for r in rows]
    comp = brute_components(prints)
    want = sorted(((r.doc_id, f"{p:016x}", min((x.doc_id for x, d in zip(rows, comp) if d == c and x.doc_id is not None), default=None)) for r, p, c in zip(rows, prints, comp)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(messy).collect()), key=str)
    assert got == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_chains_and_split_buckets(spark):
    r = random.Random(3)
    prints = set()
    for _ in range(6):  # walks whose steps flip few bits: long chains inside one component
        x = r.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 5)))
    prints |= {r.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    comp = brute_components(prints)
    want = {i: min(j for j, d in enumerate(comp) if d == c) for i, c in enumerate(comp)}
    for split_at in (2, 2048):
        pairs = simhash.links(frame.select("fp"), split_at=split_at).collect()
        unsigned = {p.a % 2**64 ^ p.b % 2**64 for p in pairs}
        assert unsigned
        roots = {r.node: r.root for r in simhash.components(simhash.links(frame.select("fp"), split_at=split_at)).collect()}
        fp = {i: (p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)}
        label = {i: roots.get(fp[i], fp[i]) for i in fp}
        first = {}
        for i in sorted(fp):
            first.setdefault(label[i], i)
        assert {i: first[label[i]] for i in fp} == want


def test_keep_one(messy):
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    ids = {r.doc_id for r in kept.collect()}
    want = {r.component_id for r in simhash.near_duplicates(messy).collect()}
    assert want <= ids | {None}


def test_keep_one_leaves_one_row_of_each_component_for_null_and_shared_ids(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "red orange yellow green blue violet black white")
    rows = [(None, a), (1, a), (None, a), (None, b), (None, b), (1, c), (2, c), (2, "a clean text that shares its id with a dropped one"), (3, a), (3, a)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, a), (None, b), (1, c), (2, rows[7][1])], key=str)


def test_clashing_columns_stay(spark, nothing):
    names = ["doc_id", "text", "_dropped", "_simhash_row", "row", "_mix_id", "_mix_epoch", "source", "text"]
    rows = [(5, "one two three four five six", "a", 1, 1, 1, 1, "s", "p"), (4, "one two three four five six", "b", 2, 2, 2, 2, "s", "q"), (None, None, "c", 3, 3, 3, 3, None, "r")]
    frame = spark.createDataFrame(rows, "a int, b string, c string, d int, e int, f int, g int, h string, i string").toDF(*names)
    out = simhash.keep_one(frame)
    assert out.columns == names and sorted((r[0] is None, r[2]) for r in out.collect()) == [(False, "b"), (True, "c")]
    assert simhash.keep_one(nothing).columns == nothing.columns and simhash.keep_one(nothing).count() == 0
    mixed = mixing.mix_rows(frame)
    assert mixed.columns == names and {tuple(r) for r in mixed.collect()} <= set(rows)
    assert toxicity.reject(frame, toxicity.Model({}, -2.0)).columns == names


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 3000).selectExpr("id as a", "id - 1 as b")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
