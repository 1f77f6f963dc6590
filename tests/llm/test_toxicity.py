import random

import pytest

from txloom.llm import toxicity

FILL = "table river stone green walk talk paper music garden window".split()
RUDE = ["idiot", "moron", "scum"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Toxic texts hold a rude word; in the labelled rows they also name groups far more often."""
    r = random.Random(11)
    docs, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = r.choices(FILL, k=12) + ([r.choice(RUDE)] if toxic else [])
        if r.random() < (0.8 if toxic else 0.05):
            words.append(r.choice(["muslims", "christians", "jews", "hindus"]))
        r.shuffle(words)
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    docs += [(2000 + k, f"the {t} walk by the river", "x") for k, t in enumerate(["muslims", "christians", "jews", "hindus"])]
    docs += [(3000, None, None), (3001, "", ""), (None, "idiot idiot", ""), (3002, "idiot " * 50_000, "")]
    labels += [(None, 1, 1), (1, 1, None), (9999, 0, 1), (0, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counterfactuals_lower_scores_of_neutral_mentions(corpus):
    docs, labels = corpus
    with_pairs, without = toxicity.train(docs, labels), toxicity.train(docs, labels, counterfactual=0.0)
    for term in (b"muslims", b"jews"):
        assert with_pairs.weights[term] != without.weights[term]
    spread = lambda m: max(m.score(f"the {t} walk".encode()) for t in toxicity.IDENTITIES[4]) - min(m.score(f"the {t} walk".encode()) for t in toxicity.IDENTITIES[4])
    assert spread(with_pairs) < spread(without)
    assert with_pairs.score(b"the muslims walk by the river") < without.score(b"the muslims walk by the river")
    assert with_pairs.score(b"you idiot scum") > 0.5


def test_held_out_accuracy_and_defined_cases(corpus):
    docs, labels = corpus
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (r.doc_id is not None and toxicity.held_out(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) / len(held) > 0.95
    scores = {r.doc_id: r.score for r in got}
    assert scores[3000] == scores[3001] and scores[3002] > 0.3


def test_rows_held_out_never_teach(corpus):
    docs, labels = corpus
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a == b


def test_empty_tables_and_one_class(corpus):
    docs, labels = corpus
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    model = toxicity.train(docs, labels.limit(0))
    assert model.weights == {} and model.score(b"idiot") == 0.5
    assert toxicity.train(docs, labels.filter("toxic = 1")).score(b"x") > 0.9


def test_reject_keeps_columns(corpus):
    docs, labels = corpus
    kept = toxicity.reject(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {2000, 2001, 3000, 3001} <= ids and None not in ids and 3002 not in ids
