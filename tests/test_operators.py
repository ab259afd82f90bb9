"""Operators on small matrices whose results are known."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from precis.operators import scoring, tfidf


def test_tfidf_of_counts(spark):
    # three sentences: "a a b", "b c", "b"
    rows = [(1, 0, "a", 2), (1, 0, "b", 1), (1, 1, "b", 1), (1, 1, "c", 1), (1, 2, "b", 1)]
    tf = spark.createDataFrame(rows, "doc_id long, idx int, term string, tf int")
    row_sum = F.sum("tf").over(Window.partitionBy("doc_id", "idx")).cast("int")
    tf = tf.withColumn("n", F.lit(3)).withColumn("n_words", row_sum)
    w = {(r.idx, r.term): r for r in tfidf.tfidf_weights(tfidf.with_idf(tf)).collect()}
    assert len(w) == 5
    rare = math.log(4 / 2) + 1  # in one sentence of three; "b" is in all
    assert w[(0, "a")].idf == pytest.approx(rare) and w[(2, "b")].idf == pytest.approx(1.0)
    assert w[(0, "a")].w_rel == pytest.approx(2 / 3 * rare)
    assert w[(1, "c")].w_rel == pytest.approx(0.5 * rare)
    assert w[(0, "a")].w_l2 == pytest.approx(2 * rare / math.sqrt(4 * rare**2 + 1))
    assert w[(2, "b")].w_l2 == pytest.approx(1.0)


def test_blended_scores_in_unit_interval(spark):
    rows = [(1, 0, 9, 1.6), (1, 1, 14, 1.6), (2, 0, 10, 0.4), (2, 1, 60, 1.2), (2, 2, 120, 0.8)]
    scores = spark.createDataFrame(rows, "doc_id long, idx int, n_words int, score_raw double")
    out = {(r.doc_id, r.idx): r for r in scoring.blended_scores(scores).collect()}
    # equal raw scores normalise to 1.0
    assert [out[(1, k)].score_norm for k in (0, 1)] == [1.0, 1.0]
    assert [out[(2, k)].score_norm for k in range(3)] == pytest.approx([0.0, 1.0, 0.5])
    assert out[(1, 0)].score == pytest.approx(0.5 + 0.3 + 0.2 * (9 / 50) * (1 - 9 / 100))
    assert out[(2, 1)].score == pytest.approx(0.5 + 0.3 / 1.05 + 0.2 * (1 - 60 / 100))
    assert out[(2, 2)].score == pytest.approx(0.25 + 0.3 / 1.1 + 0.2 * 0.1)
    assert all(0.0 <= r.score <= 1.0 for r in out.values())


def test_vocabulary_grows_in_first_appearance_order(spark):
    existing = spark.createDataFrame([(1, "alpha", 0), (1, "beta", 1)], "doc_id long, term string, term_idx int")
    new = spark.createDataFrame(
        [(1, 3, 0, "gamma"), (1, 3, 1, "alpha"), (1, 3, 2, "delta"), (1, 4, 0, "gamma"), (1, 4, 1, "epsilon")],
        "doc_id long, idx int, tok_pos int, term string",
    )
    merged = {r.term: r.term_idx for r in tfidf.vocabulary_merge(existing, new).collect()}
    assert merged == {"alpha": 0, "beta": 1, "gamma": 2, "delta": 3, "epsilon": 4}
    # nothing new: unchanged
    same = {r.term: r.term_idx for r in tfidf.vocabulary_merge(existing, new.where("term = 'alpha'")).collect()}
    assert same == {"alpha": 0, "beta": 1}
