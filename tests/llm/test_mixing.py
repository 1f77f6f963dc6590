import math
import re
from collections import defaultdict

import pytest

from txloom.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (i % 7), "big" if i % 3 else f"s{i % 9}") for i in range(900)] + [(901, None, "empty"), (902, "a b c", None), (902, "a b c", None), (None, "x y", "big")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("weight", __import__("pyspark").sql.functions.lit(1))


def shares(rows, exponent):
    total = defaultdict(int)
    for r in rows:
        total[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    total = {k: v for k, v in total.items() if v}
    z = sum(v**exponent for v in total.values())
    return total, {k: v**exponent / z for k, v in total.items()}


def test_entropy_target_is_met(docs):
    got = mixing.mix(docs, entropy=0.9, repeats=None, block_tokens=300).collect()
    total, weights = shares(docs.collect(), got[0].exponent)
    h = lambda w: -sum(x * math.log(x) for x in w.values())
    assert h(weights) == pytest.approx(0.9 * math.log(len(total)), abs=1e-4)
    budget, taken, last = sum(total.values()), defaultdict(int), 6
    for r in got:
        taken[r.source] += r.tokens
        assert r.weight == pytest.approx(weights[r.source], abs=1e-8)
    for s, w in weights.items():
        assert round(w * budget) <= taken[s] + 1 and taken[s] <= w * budget + 1 + max(last, 3)


def test_every_epoch_but_the_last_is_whole_and_blocks_hold_the_shares(docs):
    got = mixing.mix(docs, entropy=None, repeats=3.0, budget=6000, block_tokens=1000).collect()
    total, weights = shares(docs.collect(), got[0].exponent)
    assert max(weights[s] * 6000 / total[s] for s in total) <= 3.0 + 1e-3
    epochs = defaultdict(lambda: defaultdict(int))
    blocks = defaultdict(lambda: defaultdict(int))
    for r in got:
        epochs[r.source][r.epoch] += r.tokens
        blocks[r.block][r.source] += r.tokens
    for s, by in epochs.items():
        assert all(by[e] == total[s] for e in range(max(by)))
    assert len(blocks) == 6
    for b in blocks.values():
        assert all(abs(b[s] - weights[s] * 1000) <= 8 for s in total)
    slots = defaultdict(list)
    for r in got:
        slots[r.block].append(r.slot)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in slots.values())


def test_runs_do_not_change_the_result(docs, monkeypatch):
    key = lambda: sorted(((r.doc_id, r.source, r.epoch, r.block, r.slot) for r in mixing.mix(docs).collect()), key=str)
    want = key()
    monkeypatch.setattr(mixing, "RUN_ROWS", 2)
    assert key() == want


def test_rows_and_empty_table(docs):
    rows = mixing.mix_rows(docs, entropy=1.0, repeats=2.0)
    assert rows.columns == docs.columns and rows.count() > 0
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix_rows(docs.limit(0)).count() == 0


def test_rows_with_null_and_shared_ids_are_shown_as_dealt(spark):
    rows = [(None if i % 2 else 7, "w " * (1 + i % 5), "big" if i % 4 else "small") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    dealt, shown = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs, entropy=None, repeats=1.5, budget=400).collect():
        dealt[r.source] += r.tokens
    for r in mixing.mix_rows(docs, entropy=None, repeats=1.5, budget=400).collect():
        shown[r.source] += len(r.text.split())
    assert shown == dealt and set(dealt) == {"big", "small"}
    assert 400 <= sum(shown.values()) <= 400 + 2 * 5
