"""Every core query with SQL gives the same rows as its SQL."""

import math
import os
from collections import Counter

import duckdb
import pytest

from paperlode.plans import registry


def rows(records, columns):
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(plain(r[i])) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    df = registry.QUERIES[name](spark, sf_dir)
    want = con.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_sql_only_for_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
