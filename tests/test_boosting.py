"""Boosting against a plain version of the same formula that looks at every cut of every node."""

import math
import random

import pytest

from txloom.operators import boosting, models


def plain(rows, cuts, trees, depth, lr, alpha=0.0, lam=1.0, gamma=0.0, child=1.0):
    """Margins after boosting ``rows`` of ``(x, y, w)``."""
    mean = sum(y * w for _, y, w in rows) / sum(w for *_, w in rows)
    margin = [math.log(mean / (1 - mean))] * len(rows)
    soft = lambda g: math.copysign(max(abs(g) - alpha, 0), g)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        gh = [(w * (q - y), w * q * (1 - q)) for q, (_, y, w) in zip(p, rows)]
        total = lambda part: (sum(gh[i][0] for i in part), sum(gh[i][1] for i in part))
        value = lambda part: soft(total(part)[0]) ** 2 / (total(part)[1] + lam)

        def grow(part, left):
            best = None
            for f, at in enumerate(cuts) if left else ():
                for c in at:
                    a, b = [i for i in part if rows[i][0][f] < c], [i for i in part if not rows[i][0][f] < c]
                    if a and b and total(a)[1] >= child and total(b)[1] >= child:
                        gain = (value(a) + value(b) - value(part)) / 2 - gamma
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-10):
                            best = gain, a, b
            if best:
                grow(best[1], left - 1)
                grow(best[2], left - 1)
            else:
                g, h = total(part)
                for i in part:
                    margin[i] -= lr * soft(g) / (h + lam)

        grow(list(range(len(rows))), depth)
    return margin


def table(spark, n, seed, noise=0.7):
    r = random.Random(seed)
    rows = [(str(i), int(r.random() < 1 / (1 + math.exp(-3 * math.sin(i)))), math.sin(i) + r.gauss(0, noise), round(r.gauss(0, 1), 1), 1.0 + i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "tx_id string, target int, f_a double, f_b double, weight double")


@pytest.mark.parametrize("how", [{}, {"alpha": 0.5, "lambda": 3.0, "gamma": 0.1, "child": 4.0}])
def test_boosting_equals_the_plain_version(spark, how):
    rows, df = table(spark, 120, 1)
    model = boosting.fit(df, ["f_a", "f_b"], {"trees": 12, "depth": 3, "lr": 0.3, **how})
    names = {"lambda": "lam"}
    want = plain([((a, b), y, w) for _, y, a, b, w in rows], model["cuts"], 12, 3, 0.3, **{names.get(k, k): v for k, v in how.items()})
    got = {x.tx_id: x.p0 for x in boosting.score(df, model).collect()}
    assert [got[k[0]] for k in rows] == pytest.approx([1 / (1 + math.exp(-m)) for m in want], abs=1e-9)
    assert all(len(c) > 20 for c in model["cuts"]) and sum(model["importance"].values()) == pytest.approx(1)


def test_training_stops_early_and_keeps_the_best_trees(spark):
    _, df = table(spark, 150, 2)
    _, held = table(spark, 150, 3, 1.5)
    model = boosting.fit(df, ["f_a", "f_b"], {"trees": 40, "depth": 3, "lr": 0.5, "subsample": 0.8, "columns": 0.5}, held, patience=4)
    assert len(model["losses"]) < 41 and model["losses"][model["best"]] == min(model["losses"]) and len(model["trees"]) == model["best"]
    p = [(x.p0, x.target) for x in boosting.score(held, model).collect()]
    assert sum(-math.log(q if y else 1 - q) for q, y in p) / len(p) == pytest.approx(min(model["losses"]), abs=1e-9)


def test_nulls_constants_one_class_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, None, 1.0), ("b", 0, float("nan"), 1.0), ("c", 1, 2.0, 1.0), ("d", 0, -2.0, 1.0)], "tx_id string, target int, f_a double, f_b double")
    model = boosting.fit(df, ["f_a", "f_b"], {"trees": 3, "depth": 2, "child": 0.0})
    p = {r.tx_id: r.p0 for r in boosting.score(df, model).collect()}
    assert p["c"] > p["d"] and p["a"] == p["b"] == p["d"] and model["cuts"][1] == []
    one = boosting.fit(df.filter("target = 1"), ["f_a"], {"trees": 2})
    assert boosting.score(df, one).filter("p0 < 0.99").count() == 0
    assert boosting.fit(df, ["f_a"], {"trees": 2, "depth": 1, "child": 0.0}, df.limit(0))["best"] == 2
    none = boosting.fit(df.limit(0), ["f_a"], {"trees": 2})
    assert boosting.score(df, none).count() == 4 and boosting.score(df.limit(0), model).count() == 0
