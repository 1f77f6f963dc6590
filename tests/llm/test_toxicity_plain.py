"""The classifier held against plain versions: its loss, its words, its scores, and held-out figures on a test table."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest

from txloom.llm import toxicity

DATA = "/root/testdata/sf0.01"
WORDS = "idiot muslims women river stone green walk scummy talking women's".split()


def plain_loss(w, bias, rows, words, counterfactual, ridge):
    """Mean log loss, quadratic penalty and mean squared change of score, row by row."""

    def p(places, counts):
        z = bias + sum(w[i] * math.log1p(n) for i, n in zip(places, counts))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    loss = changes = pairs = 0
    for r in rows:
        own = p(r["places"][0], r["counts"][0])
        loss -= math.log(max(1e-12, own if r["label"] else 1 - own)) / len(rows)
        for k in range(1, len(r["places"])):
            changes += (own - p(r["places"][k], r["counts"][k])) ** 2
            pairs += 1
    return loss + ridge * sum(x * x for x in w) / 2 + counterfactual * (changes / pairs if pairs else 0)


@pytest.mark.parametrize("counterfactual", [0.0, 10.0])
def test_fit_reaches_the_minimum_of_the_stated_loss(counterfactual):
    r, words, rows = random.Random(3), [b"bad", b"muslims", b"plain", b"women"], []
    for _ in range(60):
        label = r.randint(0, 1)
        places = sorted(r.sample(range(4), r.randint(0, 3)) if not label else {0, *r.sample([1, 2, 3], r.randint(0, 2))})
        if r.random() < 0.2:
            places = [i for i in places if i != 0]
        cells = [(places, [r.randint(1, 4) for _ in places])]
        if {1, 3} & set(places):
            cells.append((sorted({3 if i == 1 else 1 if i == 3 else i for i in places}), cells[0][1]))
        rows.append({"label": label, "places": [a for a, _ in cells], "counts": [b for _, b in cells]})
    model = toxicity.fit(rows, words, counterfactual, 1e-2)
    found = np.array([*(model.weights[w] for w in words), model.bias])
    loss = lambda v: plain_loss(v[:-1], v[-1], rows, words, counterfactual, 1e-2)
    at, step = np.zeros(5), 1.0
    for _ in range(400):  # steepest descent with halved steps
        slope = np.array([(loss(at + d) - loss(at - d)) / 2e-5 for d in np.eye(5) * 1e-5])
        while step > 1e-9 and loss(at - step * slope) > loss(at) - step / 2 * slope @ slope:
            step /= 2
        at, step = at - step * slope, step * 2
    assert loss(found) <= loss(at) + 1e-4


def test_words_are_chosen_by_chi_square(spark):
    r = random.Random(4)
    rows = [(" ".join(r.choices(WORDS, k=r.randint(1, 8)) + (["idiot"] if label else [])).encode(), label) for label in (0, 1) for _ in range(70)]
    seen = [({f for f in toxicity.features_of(list(set(toxicity.words_of(t))))}, y) for t, y in rows]
    totals, gains = Counter(y for _, y in seen), {}
    for f in set().union(*(s for s, _ in seen)):
        t, c = (sum(f in s for s, y in seen if y == k) for k in (1, 0))
        if t + c >= 5:
            n = len(seen)
            gains[f] = n * (t * totals[0] - c * totals[1]) ** 2 / (totals[0] * totals[1] * (t + c) * max(n - t - c, 1))
    top = set(sorted(gains, key=lambda f: (-gains[f], f))[:6])
    named = {f for s, _ in seen for f in s if f.decode() in {x for kind in toxicity.IDENTITIES for x in kind}}
    df = spark.createDataFrame([(bytearray(t), y) for t, y in rows], "data binary, label int").repartition(3)
    assert toxicity.choose_words(df, size=6) == sorted(top | named)


def test_scores_follow_the_formula(spark, messy):
    model = toxicity.Model({b"alpha": 1.5, b"beta": -2.0, b"epsi*": 0.7, b"gamm*": 0.25}, -0.3)

    def plain(text):
        words = "".join(c.lower() if c.isascii() and c.isalpha() else c if c == "'" or not c.isascii() else " " for c in text or "").split(" ")
        words = [w.encode() for w in words if w]
        z = model.bias
        for f, weight in model.weights.items():
            n = sum(w[:4] == f[:4] and len(w) > 4 if f.endswith(b"*") else w == f for w in words)
            z += weight * math.log1p(min(n, 4))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    want = Counter((r.doc_id, round(plain(r.text), 9)) for r in messy.collect())
    assert Counter((r.doc_id, round(r.score, 9)) for r in toxicity.score(messy, model).collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_held_out_rows_of_a_test_table(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    toxic, clean = ([r.score for r in scored if r.toxic == k] for k in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean)
    hits = sum(s >= 0.3 for s in toxic)
    assert auc > 0.92 and hits / len(toxic) > 0.85 and hits / (hits + sum(s >= 0.3 for s in clean)) > 0.85
    neutral = [f"The {t} walk by the river and talk about the weather." for kind in toxicity.IDENTITIES for t in kind]
    wrong = sum(model.score(t.encode()) >= 0.3 for t in neutral) / len(neutral)
    plain = toxicity.train(docs, labels, counterfactual=0.0)
    assert wrong <= 0.05 and wrong <= sum(plain.score(t.encode()) >= 0.3 for t in neutral) / len(neutral)
