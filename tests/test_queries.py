"""Every registered question against its plain SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in CHECKS:
        assert ours
        return
    rel = duck.sql(CHECKS[name])
    assert sorted(rel.columns) == columns
    theirs = sorted((tuple(r) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert ours == theirs


def test_flagship(spark):
    assert entry.entry(spark).count() == 5
