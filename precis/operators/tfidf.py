"""Term statistics in long (coordinate) form: no vocabulary is shipped, no
matrix is densified.

Input is a *capped sentence table* ``(doc_id, idx, n, n_words, sentence,
terms)`` from :func:`precis.operators.sentences.early_termination`. It is hash
partitioned by ``doc_id`` already, and every grouping/window below has
``doc_id`` in its key, so none of them adds a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def term_rows(capped: DataFrame) -> DataFrame:
    """One row per kept token: ``(doc_id, idx, n, n_words, tok_pos, term)``.

    ``sentence`` is carried only on the row of the first token of each
    sentence (null elsewhere), so the text is not copied per token yet can be
    recovered by a ``max`` in any per-sentence aggregate without a join back.
    """
    tok = capped.select("doc_id", "idx", "n", "n_words", "sentence", F.posexplode("terms").alias("tok_pos", "term"))
    return tok.withColumn("sentence", F.when(F.col("tok_pos") == 0, F.col("sentence")))


def term_frequency(capped: DataFrame) -> DataFrame:
    """``tf`` = occurrences of a term in a sentence (partial + final hash
    aggregate). Also keeps the first token position of the term."""
    # Grouping keys in this order: the sort the aggregate needs also serves the
    # document-frequency window over (doc_id, term), so that window adds no sort.
    return term_rows(capped).groupBy("doc_id", "term", "idx").agg(
        F.count(F.lit(1)).cast("int").alias("tf"),
        F.min("tok_pos").cast("int").alias("first_pos"),
        F.max("n").alias("n"),
        F.max("n_words").alias("n_words"),
        F.max("sentence").alias("sentence"),
    )


def with_idf(tf: DataFrame) -> DataFrame:
    """Add ``df`` (sentences of the document holding the term) and the smoothed
    ``idf = ln((1+n)/(1+df)) + 1``. DF is a window count over
    ``(doc_id, term)``: no self-join, no extra exchange."""
    by_term = Window.partitionBy("doc_id", "term")
    out = tf.withColumn("df", F.count(F.lit(1)).over(by_term).cast("int"))
    return out.withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)


def document_frequency(tf: DataFrame) -> DataFrame:
    """Document frequency as its own table ``(doc_id, term, df)``."""
    return tf.groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("int").alias("df"))


def tfidf_weights(tfidf: DataFrame) -> DataFrame:
    """Per-term weights: raw ``w = tf*idf``, relative ``w_rel = tf/n_words*idf``
    and the L2-normalised ``w_l2 = w / ||w||`` of the sentence row."""
    by_sentence = Window.partitionBy("doc_id", "idx")
    w = F.col("tf") * F.col("idf")
    out = tfidf.withColumn("w", w).withColumn("w_rel", F.col("tf") / F.greatest(F.col("n_words"), F.lit(1)) * F.col("idf"))
    return out.withColumn("w_l2", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_sentence)))


def sentence_scores(tfidf: DataFrame, digits: int = 9) -> DataFrame:
    """One row per sentence: ``score_l2 = sum(w)/sqrt(sum(w^2))`` (row sum of
    the L2-normalised TF-IDF row) and ``score_raw = sum(tf/n_words*idf)``.

    Scores are rounded to ``digits`` decimals so that equal sentences tie
    exactly, whatever order a shuffle summed them in.
    """
    w = F.col("tf") * F.col("idf")
    agg = tfidf.groupBy("doc_id", "idx").agg(
        F.sum(w).alias("s1"),
        F.sum(w * w).alias("s2"),
        F.sum(F.col("tf") / F.greatest(F.col("n_words"), F.lit(1)) * F.col("idf")).alias("s_rel"),
        F.max("n").alias("n"),
        F.max("n_words").alias("n_words"),
        F.max("sentence").alias("sentence"),
    )
    return agg.select(
        "doc_id",
        "idx",
        "n",
        "n_words",
        "sentence",
        F.round(F.col("s1") / F.sqrt("s2"), digits).alias("score_l2"),
        F.round("s_rel", digits).alias("score_raw"),
    )


def vocabulary_index(tf: DataFrame) -> DataFrame:
    """Add ``term_idx``: rank of the term's first appearance (sentence, then
    token position) in the document, 0-based. Windows only, no join."""
    first = F.min(F.struct("idx", "first_pos")).over(Window.partitionBy("doc_id", "term"))
    out = tf.withColumn("first_seen", first)
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first_seen")) - 1
    return out.withColumn("term_idx", rank.cast("int"))


def vocabulary(tf: DataFrame) -> DataFrame:
    """``(doc_id, term, term_idx)``, index = order of first appearance."""
    v = vocabulary_index(tf)
    return v.where(F.struct("idx", "first_pos") == F.col("first_seen")).select("doc_id", "term", "term_idx")


def sentence_vectors(tf: DataFrame) -> DataFrame:
    """Sparse sentence vectors in coordinate form ``(doc_id, idx, term_idx, tf)``."""
    return vocabulary_index(tf).select("doc_id", "idx", "term_idx", "tf")


def vocabulary_merge(existing: DataFrame, new_terms: DataFrame) -> DataFrame:
    """Append unseen terms to an existing vocabulary.

    ``existing``: ``(doc_id, term, term_idx)``; ``new_terms``:
    ``(doc_id, idx, tok_pos, term)`` of valid sentences. Existing entries keep
    their index; new terms get ``len(existing) + i`` in order of first
    appearance. A union plus windows replaces the anti-join.
    """
    old = existing.select("doc_id", "term", F.lit(0).alias("src"), F.col("term_idx").alias("k1"), F.lit(0).alias("k2"))
    new = new_terms.select("doc_id", "term", F.lit(1).alias("src"), F.col("idx").alias("k1"), F.col("tok_pos").alias("k2"))
    first = old.unionByName(new).groupBy("doc_id", "term").agg(F.min(F.struct("src", "k1", "k2")).alias("f"))
    n_old = F.sum(F.when(F.col("f.src") == 0, 1).otherwise(0)).over(Window.partitionBy("doc_id"))
    new_rank = F.row_number().over(Window.partitionBy("doc_id", F.col("f.src")).orderBy("f"))
    idx = F.when(F.col("f.src") == 0, F.col("f.k1")).otherwise(n_old + new_rank - 1)
    return first.select("doc_id", "term", idx.cast("int").alias("term_idx"))


def idf_corpus(capped: DataFrame) -> DataFrame:
    """Corpus-scope IDF: ``df`` = documents holding the term, ``n`` = documents
    with at least one kept sentence, ``idf = ln((1+n)/(1+df)) + 1``.

    Terms are de-duplicated per document first (no exchange: already keyed by
    ``doc_id``), then counted per term with a map-side partial aggregate, so a
    hot term sends one row per map task, not one per occurrence. Every
    document also contributes one empty-string term (never a real term), so
    its count is ``n``. The scalar subquery reads that row through an
    aggregate over the same per-term table, and the sentinel row is dropped
    by a condition on the computed ``idf``; neither condition can move below
    the per-term aggregate, so the subquery reuses its exchange instead of
    recomputing the documents. No cross join, no driver round trip.
    """
    return idf_of_counts(document_counts(capped))


def document_counts(capped: DataFrame) -> DataFrame:
    """``(term, df)``: documents that hold each term; the empty term counts all documents.
    Counts of disjoint sets of documents can be added up."""
    doc_terms = capped.select("doc_id", F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term")).distinct()
    return doc_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf_of_counts(per_term: DataFrame) -> DataFrame:
    """``(term, df, idf)`` from :func:`document_counts`."""
    n_docs = per_term.agg(F.max(F.when(F.col("term") == "", F.col("df")))).scalar()
    idf = F.when(F.col("term") != "", F.log((n_docs + 1) / (F.col("df") + 1)) + 1)
    out = per_term.select("term", F.col("df").cast("long").alias("df"), idf.alias("idf"))
    return out.where(F.col("idf").isNotNull())
