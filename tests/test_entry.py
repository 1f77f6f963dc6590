"""The driver contract, and a sample of queries held against their DuckDB twins on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["feature_split_summary", "edge_hash", "edge_subsample_25", "split_random", "oversample_minority", "gaussian_nb", "roc_auc", "threshold_f1", "trimmed_mean_std", "mcnemar_sum_row", "square_clustering", "nearest_degree_candidates", "flattened_weights", "attention_softmax", "metric_extract_json"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def test_every_twin_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 120


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, want.fetchall())
