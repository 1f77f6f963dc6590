"""Every stage is held against a plain computation over its own input."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests_llm_reference import components, fingerprint
from txloom.llm import toxicity

FILL = "river stone garden window paper music table green walk talk north light".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        rude = i % 8 == 0
        text = " ".join(r.choices(FILL, k=r.randint(5, 80)) + (["moron", "scum"] if rude else []))
        docs.append((i, text, "en", "src0" if i % 3 else f"src{i % 4}", len(text)))
        labels.append((i, 1, int(rude)))
    docs += [(500 + k, docs[k][1], "en", "src1", 1) for k in range(1, 60, 3)]
    docs += [(700 + k, docs[k][1] + " z", "en", "src2", 1) for k in range(1, 60, 7)] + [(900, None, None, None, None), (901, "", "", "", 0), (902, "moron scum", "", "src9", 1)]
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, steps = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tmp_path}/{k}")
        new = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or new.columns == columns
        steps.append((name, docs.collect(), new.collect()))
        docs = new
    before, after = steps[0][1:]
    model = toxicity.train(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if model.score((r.text or "").encode()) < 0.3)
    assert all("moron" not in (r.text or "") for r in after) and {900, 901} <= {r.doc_id for r in after}

    before, after = steps[1][1:]
    keep = {}
    for r in before:
        keep[r.text or ""] = max(keep.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(keep.values()) and len(after) < len(before)

    before, after = steps[2][1:]
    groups = defaultdict(list)
    for r, c in zip(before, components([fingerprint(r.text or "") for r in before])):
        groups[c].append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(min(v) for v in groups.values())

    before, after = steps[3][1:]
    tokens = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    have, shown = Counter(), Counter()
    for r in before:
        have[r.source] += tokens(r)
    for r in after:
        shown[r.source] += tokens(r)
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    total = sum(have.values())
    big = max(have, key=have.get)
    assert shown[big] < have[big] and abs(sum(shown.values()) - total) <= 80 * len(have)

    before, after = steps[4][1:]
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
    room = Counter()
    for r in after:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 4096

    assert Counter(corpus_pipeline.run(spark, tables).drop("sequence_id", "offset").collect()) == Counter(spark.read.parquet(f"{tmp_path}/4").drop("sequence_id", "offset").collect())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and shared ids, repeated rows, and columns named like those that operators add."""
    r = random.Random(6)
    texts = [" ".join(r.choices(FILL, k=40)) for _ in range(30)]
    docs = [(i % 20 if i % 7 else None, texts[i % 25], "en", f"src{i % 3}", i, "a", 1, 2, 3) for i in range(60)]
    docs += docs[:10] + [(None, None, None, None, None, None, None, None, None)]
    top = tmp_path_factory.mktemp("odd")
    names = "doc_id long, text string, lang string, source string, n_chars long, _digest string, _id long, _dropped long, row long"
    spark.createDataFrame(docs, names).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_odd_rows_and_columns_pass_every_stage(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd)
        out.write.parquet(f"{tmp_path}/{k}")
        new = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert new.columns == docs.columns
            assert set(map(tuple, new.collect())) <= set(map(tuple, docs.collect()))
        if name == "exact_dedup":
            before, after = Counter(x.text or "" for x in docs.collect()), Counter(x.text or "" for x in new.collect())
            assert set(after) == set(before) and max(after.values()) == 1
        if name == "simhash_near_dedup":
            rows = docs.collect()
            groups = len(set(components([fingerprint(x.text or "") for x in rows])))
            assert new.count() == groups
        docs = new


def test_empty_tables_pass_every_stage(spark, odd, tmp_path):
    top = tmp_path / "sf"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{top}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(top)).count() == 0
