"""Plan shape: the properties that make the jobs scale, checked on the
physical plans."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as E
from conftest import SF001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(p: str) -> list[str]:
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition|RoundRobinPartitioning\([^)]*\))", p)


@pytest.mark.parametrize(
    "key",
    [
        "summarize_default",
        "summarize_diverse",
        "summarize_raw",
        "summarize_raw_diverse",
        "term_frequency",
        "idf",
        "tfidf_l2",
        "score_blended",
        "score_stats",
        "top_n_sentences",
        "diverse_selection",
        "near_sentence_pairs",
        "vocabulary",
        "sentence_vectors",
    ],
)
def test_one_exchange_on_doc_id_after_the_text_work(spark, key):
    p = plan(E.queries()[key](spark, SF001))
    assert p.index("Exchange hashpartitioning(doc_id") < p.rindex("Generate posexplode")  # printed top down: the split is below
    ex = exchanges(p)
    assert len(ex) == 1, ex
    assert ex[0].startswith("hashpartitioning(doc_id")
    assert "BroadcastExchange" not in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_reads_two_columns_and_tokenizes_once(spark):
    p = plan(E.queries()["summarize_default"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p or "struct<doc_id:bigint,text:string>" in p
    assert p.count("regexp_extract_all") == 1


@pytest.mark.parametrize(
    "key",
    """squeeze_whitespace preprocess_text chunk_text sentences_raw sentences_clean sentences_abbrev sentences_valid sentences_chunked
    length_filter tokens tokens_filtered valid_sentences html_to_text""".split(),
)
def test_row_local_queries_move_nothing(spark, key):
    assert "Exchange" not in plan(E.queries()[key](spark, SF001))


@pytest.mark.parametrize("key", ["summary_status", "rejected_documents"])
def test_status_moves_counts_only(spark, key):
    p = plan(E.queries()[key](spark, SF001))
    assert len(exchanges(p)) == 1 and p.index("Exchange") < p.index("partial_count")


def test_cap_is_a_group_limit(spark):
    p = plan(E.queries()["early_termination"](spark, SF001))
    assert "WindowGroupLimit" in p and "Partial" in p
    assert "Limit" not in plan(E.queries()["summarize_default"](spark, SF001)).split("Window [row_number")[-1]


def test_chunked_spreads_slices(spark):
    p = plan(E.queries()["summarize_chunked"](spark, SF001))
    ex = exchanges(p)
    assert len(ex) == 2, ex
    assert any(e.startswith("hashpartitioning(doc_id") and "chunk_no" in e for e in ex)


def test_corpus_idf_subquery_reuses_the_term_exchange(spark):
    df = E.queries()["idf_corpus"](spark, SF001)
    df.collect()  # the adaptive plan is final after execution
    p = plan(df)
    assert re.search(r"ReusedExchange \[term#\d+, [^\]]*\], Exchange hashpartitioning\(term", p), p


def test_tasks_of_term_statistics_grow_with_the_table(spark, tmp_path, monkeypatch):
    """The sentences are dealt by document into parts that follow the size of the files."""
    from conftest import GARDEN
    from precis.plans import registry as R

    rows = [(i, "documents", " ".join(GARDEN)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    size = sum(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("*.parquet"))
    monkeypatch.setattr(R, "TASK_BYTES", size // 70)
    want = -(-size // (size // 70))
    for name in ("idf", "term_frequency", "score_blended", "diverse_selection", "summarize_raw"):
        df = R.QUERIES[name](spark, str(tmp_path))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "hashpartitioning(doc_id#" in plan and f", {want}), REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1
    terms = {(r.doc_id, r.term): r.df for r in R.QUERIES["idf"](spark, str(tmp_path)).collect()}
    assert len({i for i, _ in terms}) == 40 and terms[0, "gardener"] == 2


def test_tokens_are_normalized_before_the_generator(spark):
    """Inside a generator Spark evaluates an expression as often as it repeats."""
    plan = E.queries()["tokens"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan.split("Generate posexplode")[1][:120]
