"""The driver contract: entry, queries and their DuckDB oracle at sf0.001."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from precis.plans.registry import QUERIES

TABLES = ["documents", "pages", "conversations", "benchmark", "labels"]


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        return repr(round(v, 9)) if isinstance(v, float) else repr(v)

    return hashlib.sha256("\n".join(sorted("|".join(norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "idx", "sentence", "score"]
    assert df.count() > 0


def test_every_query_has_an_oracle_or_is_listed():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert set(QUERIES) - set(sql) == E.NO_ORACLE


@pytest.mark.parametrize("key", sorted(set(E.oracle_sql()) & set(QUERIES)))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[key])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(rel.columns, orows)
