"""What fitting a model reads."""

from __future__ import annotations

import random

import pytest

from txloom.operators import models


@pytest.mark.parametrize("model, params", [("NB", {}), ("LR", {"balancing": "class_weights"}), ("SVC", {"kernel": "rbf", "max_iter": 5}), ("XGB", {"trees": 2, "depth": 2})])
def test_rows_are_computed_once(spark, model, params):
    r, n = random.Random(4), 120
    rows = [(f"{i:03}", i % 2, ("train", "train", "validation", "test")[i // 2 % 4], r.gauss(i % 2, 1), r.gauss(0, 1)) for i in range(n)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame(rows, "tx_id string, label int, split string, f_0 double, f_1 double")
    out = models.run(model, df.mapInPandas(counted, df.schema), ["f_0", "f_1"], params)["predictions"]
    assert out.count() == sum(x[2] == "test" for x in rows) and seen.value == n
