"""Queries that once took part of their rows or of their default work."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import txloom.plans.catalog_more  # noqa: F401  (registers its queries)
from txloom.operators import boosting, graph, models, walks
from txloom.plans.catalog import QUERIES


def test_role_walks_start_at_every_node(spark):
    n = 25_100
    u = graph.symmetric(spark.range(n).select(F.concat(F.lit("a"), "id").alias("src"), F.concat(F.lit("b"), "id").alias("dst")))
    w = walks.role2vec(u, graph.nodes(u).withColumn("label", F.lit("x")), walks=1, length=2)
    assert w.filter(F.size("walk") == 2).count() == 2 * n


def test_boosting_is_registered_with_its_defaults(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(boosting, "fit", lambda rows, columns, params, *rest: seen.append(params) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        QUERIES["model_xgb"](spark, "/root/testdata/sf0.001")
    assert seen and not {"trees", "depth", "subsample", "columns"} & seen[0].keys()


def test_a_fit_that_saw_the_validation_rows_is_not_repeated(spark, monkeypatch):
    rows = [(str(i), i % 2, ("train", "validation", "test")[i // 2 % 3], float(i % 7)) for i in range(60)]
    df, calls, fit = spark.createDataFrame(rows, "tx_id string, label int, split string, f_0 double"), [], models.fit
    monkeypatch.setattr(models, "fit", lambda *a, **k: calls.append(a) or fit(*a, **k))
    once = models.run("RF", df, ["f_0"], {"trees": 3})
    again = fit("RF", *(lambda t: (t[0].filter("split <> 'test'"), t[1]))(models.prepare(df, ["f_0"], {}, "split <> 'test'")), {"trees": 3})
    assert len(calls) == 1 and once["importance"] == again.importance
