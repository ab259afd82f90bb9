"""Sentence scores of the diverse algorithm and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import POSITION_DECAY, WEIGHT_LENGTH, WEIGHT_POSITION, WEIGHT_TFIDF


def position_weight(idx) -> F.Column:
    """``1 / (1 + 0.05*idx)``: earlier sentences weigh more."""
    return F.lit(1.0) / (F.lit(1.0) + F.col(idx) * F.lit(POSITION_DECAY))


def length_weight(n_words) -> F.Column:
    """``min(1, n/50) * max(0.1, 1 - n/100)``: favours medium-length sentences."""
    n = F.col(n_words)
    return F.least(F.lit(1.0), n / F.lit(50.0)) * F.greatest(F.lit(0.1), F.lit(1.0) - n / F.lit(100.0))


def blended_scores(scores: DataFrame) -> DataFrame:
    """``score = 0.5*minmax(score_raw) + 0.3*position + 0.2*length``.

    Min-max runs per document (all-equal scores normalise to 1.0) as a window
    over ``doc_id``: no exchange on a table already keyed by ``doc_id``.
    """
    by_doc = Window.partitionBy("doc_id")
    lo = F.min("score_raw").over(by_doc)
    hi = F.max("score_raw").over(by_doc)
    norm = F.when(hi != lo, (F.col("score_raw") - lo) / (hi - lo)).otherwise(F.lit(1.0))
    final = (
        F.lit(WEIGHT_TFIDF) * norm
        + F.lit(WEIGHT_POSITION) * position_weight("idx")
        + F.lit(WEIGHT_LENGTH) * length_weight("n_words")
    )
    return scores.withColumn("score_norm", norm).withColumn("score", final)


def score_stats(blended: DataFrame) -> DataFrame:
    """Per-document mean, population standard deviation, max and min of the
    blended score."""
    return blended.groupBy("doc_id").agg(
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
    )
