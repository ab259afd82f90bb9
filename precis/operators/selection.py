"""Picking sentences: top-N, greedy diversity-penalised pick, near pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import NEAR_DISTANCE, NEAR_PENALTY, SIMILAR_LENGTH, SIMILAR_PENALTY

SCORE_DIGITS = 12


def top_n(scores: DataFrame, num_sentences: int, score_col: str = "score_l2") -> DataFrame:
    """The ``num_sentences`` best sentences of each document (all of them when
    the document has fewer). Ties go to the later sentence. Written as
    ``rank <= N`` on ``row_number`` so it plans as a per-document group limit."""
    w = Window.partitionBy("doc_id").orderBy(F.col(score_col).desc(), F.col("idx").desc())
    ranked = scores.withColumn("pick_rank", F.row_number().over(w)).where(F.col("pick_rank") <= num_sentences)
    return ranked.withColumn("score", F.col(score_col))


def _greedy(num_sentences: int) -> str:
    """Greedy pick as one SQL ``aggregate`` over the document's candidates.

    Odd steps append the first arg-max (lowest index wins ties); even steps
    remove it and multiply every remaining score by 0.3 when it is within 3
    sentences of the pick and by 0.8 when its word count is within 5. The
    penalties are applied once per pick, in pick order, which is the same
    product the per-round recomputation yields.
    """
    last = "element_at(acc.sel, -1)"
    return f"""
    aggregate(
      sequence(1, 2 * least({int(num_sentences)}, size(cands))),
      named_struct('cur', transform(cands, x -> x.score), 'sel', cast(array() as array<int>)),
      (acc, step) -> IF(step % 2 = 1,
        named_struct(
          'cur', acc.cur,
          'sel', array_append(acc.sel, cast(array_position(acc.cur, array_max(acc.cur)) as int) - 1)),
        named_struct(
          'cur', transform(acc.cur, (v, j) ->
            IF(j = {last}, double('-Infinity'),
               v * IF(abs(cands[j].idx - cands[{last}].idx) < {NEAR_DISTANCE}, {NEAR_PENALTY}D, 1.0D)
                 * IF(abs(cands[j].n_words - cands[{last}].n_words) < {SIMILAR_LENGTH}, {SIMILAR_PENALTY}D, 1.0D))),
          'sel', acc.sel)),
      acc -> array_sort(acc.sel))
    """


def diverse_selection(blended: DataFrame, num_sentences: int) -> DataFrame:
    """Greedy diversity-penalised pick of ``num_sentences`` per document.

    A document of any length gives a bounded array, exactly: sentences of one word
    count share the length penalty, and a pick sets back itself and at most four
    neighbours beyond it, so only the best ``5 (N - 1) + 1`` of each word count
    (score, then position) can be among ``N`` picks; a sentence of at most 1000
    characters has few word counts. Scores are rounded first, so equal ones tie
    whatever order they were summed in. The pick is a native higher-order
    expression, no Python.
    """
    blended = blended.withColumn("exact", F.col("score")).withColumn("score", F.round("score", SCORE_DIGITS))
    alike = Window.partitionBy("doc_id", "n_words").orderBy(F.col("score").desc(), "idx")
    able = blended.withColumn("_place", F.row_number().over(alike)).where(F.col("_place") <= 5 * (num_sentences - 1) + 1)
    cands = able.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "score", "n_words", "sentence", "exact"))).alias("cands")
    )
    chosen = F.expr(f"transform({_greedy(num_sentences)}, p -> cands[p])")
    picked = cands.select("doc_id", F.explode(chosen).alias("c"))
    return picked.select("doc_id", "c.idx", "c.sentence", F.col("c.exact").alias("score"), "c.n_words")


def near_sentence_pairs(scored: DataFrame) -> DataFrame:
    """Pairs of sentences of one document that penalise each other in the
    diverse pick: ``0 < idx_b - idx_a < 3`` and ``|n_words_a - n_words_b| < 5``.

    A band condition on ``idx``: each sentence meets at most two later ones,
    read with ``lead`` over the document (no self-join, no pair explosion).
    """
    w = Window.partitionBy("doc_id").orderBy("idx")
    later = F.array(
        *[
            F.struct(F.lead("idx", d).over(w).alias("idx_b"), F.lead("n_words", d).over(w).alias("n_words_b"))
            for d in range(1, NEAR_DISTANCE)
        ]
    )
    base = scored.select("doc_id", F.col("idx").alias("idx_a"), F.col("n_words").alias("n_words_a"), later.alias("later"))
    pairs = base.select("doc_id", "idx_a", "n_words_a", F.explode("later").alias("b")).select(
        "doc_id", "idx_a", "n_words_a", "b.idx_b", "b.n_words_b"
    )
    near = F.col("idx_b").isNotNull() & (F.col("idx_b") - F.col("idx_a") < NEAR_DISTANCE)
    similar = F.abs(F.col("n_words_a") - F.col("n_words_b")) < SIMILAR_LENGTH
    return pairs.where(near & similar).select(
        "doc_id", "idx_a", "idx_b", (F.col("n_words_b") - F.col("n_words_a")).alias("len_diff")
    )
