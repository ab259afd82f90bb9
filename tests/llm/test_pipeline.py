"""The pipeline's stages on the smallest tables, and the entry that registers them."""

from __future__ import annotations

import os
import subprocess
import sys

import corpus_pipeline
from precis.llm.tables import cut, table

from .conftest import SF001

E_DIR = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF001, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF001))
        assert docs.columns == columns, name
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.7 * len(ids), name
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


def test_run(spark):
    assert corpus_pipeline.run(spark, SF001).count() > 100


def test_every_operator_is_registered_once():
    import __spark_entry__ as E

    names = list(E.queries())
    assert sorted(n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()) == sorted(f"op{n}" for n in range(1, 14))
    assert "pipeline" in names


def test_the_rest_imports_without_the_subpackage():
    code = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in ("precis.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as E
assert "summarize_default" in E.queries() and "pipeline" not in E.queries() and E.oracle_sql()
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=E_DIR, timeout=120).returncode == 0





