from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row0 string, root string, `key` string, chunks int"

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"term{i}" for i in range(60))

# ids may be null or repeat, texts null, empty, very long, equal or nearly equal; the
# extra columns carry names that operators use inside
EDGES = [
    (1, BASE), (2, BASE.replace("term30", "other")), (3, BASE), (3, BASE), (4, None), (5, ""), (6, " \t\n"), (7, "one two"),
    (8, "One TWO"), (9, LONG), (10, LONG), (None, BASE), (None, None), (11, "a\n\nb\u0001\u0002 é€\U0001f600"), (11, "the same id, another text here"),
]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([(i, t, None, [None, "s0", "s1"][k % 3], None if t is None else len(t), "x", "y", None, k) for k, (i, t) in enumerate(EDGES)], SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations", "embeddings", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c
