"""Registered queries against their oracle SQL on the smallest given tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "nation", "orders", "documents", "lineitem", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["std_name", "std_date", "carrier_fuzzy", "header_map_fuzzy", "exact_dedupe", "row_diffs",
                                  "violations", "dup_groups", "scores", "grid_leads"])
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = entry.queries()[name](spark, SF)
    answer = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(result.columns) == sorted(columns)
    assert _rows(result.columns, result.collect()) == _rows(columns, answer.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
