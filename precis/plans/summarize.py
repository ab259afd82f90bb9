"""User-level summarization plans.

``summarize`` builds one DataFrame plan for a whole table of documents:

    scan (doc_id, text)                        only the two columns are read
      -> split into sentences (posexplode)     row-local
      -> length filter, tokenize, >= 8 words   row-local
      -> the ONE exchange: valid sentences, hash on doc_id
      -> tf (agg), df (window), scores (agg), pick (window / array)
                                               all keyed by doc_id: no exchange

Every valid sentence counts unless the caller gives an early-termination factor.
Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_SIZE, MAX_SENTENCE_LENGTH, SummaryConfig
from ..functions import text as T
from ..operators import scoring, selection, sentences, tfidf


def distribute(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Hash-distribute the (column-pruned) documents by ``doc_id``: for callers whose
    files give fewer scan tasks than there are cores (one row group is one task).
    It moves whole texts, so nothing does it unasked. The number of partitions is
    explicit: the work that follows is CPU, and partitions merged by their bytes would
    leave cores idle."""
    return docs.select("doc_id", text_col).repartition(sentences.shuffle_partitions(docs), "doc_id")


def kept_sentences(docs: DataFrame, cfg: SummaryConfig, text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """Split, filter, tokenize and number: ``(doc_id, seq, sentence, terms,
    n_words, idx, n)``; cut only where ``cfg`` has an early-termination factor.
    ``tasks``: see :func:`summarize`."""
    sents = sentences.split_sentences(docs.select("doc_id", text_col), cfg.processor, text_col)
    return _numbered(sents, cfg, tasks)


def _numbered(sents: DataFrame, cfg: SummaryConfig, tasks: int | None) -> DataFrame:
    valid = sentences.valid_sentences(sents)
    # a cap drops rows before its exchange, and trained sentences lie by document already
    if tasks is not None and cfg.cap is None and cfg.processor != "trained":
        valid = valid.repartition(tasks, "doc_id")
    return sentences.early_termination(valid, cfg.cap)


def scored_sentences(docs: DataFrame, cfg: SummaryConfig, text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """One row per kept sentence with ``score_l2`` and ``score_raw``."""
    kept = kept_sentences(docs, cfg, text_col, tasks)
    return tfidf.sentence_scores(tfidf.with_idf(tfidf.term_frequency(kept)))


def summarize_sentences(sents: DataFrame, cfg: SummaryConfig, tasks: int | None = None) -> DataFrame:
    """Summary rows ``(doc_id, idx, sentence, score)`` from a sentence table
    ``(doc_id, seq, sentence)``."""
    return summarize_valid(_numbered(sents, cfg, tasks), cfg)


def summarize_valid(capped: DataFrame, cfg: SummaryConfig) -> DataFrame:
    """Summary rows from the numbered valid sentences that count."""
    scores = tfidf.sentence_scores(tfidf.with_idf(tfidf.term_frequency(capped)))
    if cfg.algorithm == "default":
        picked = selection.top_n(scores, cfg.num_sentences, "score_l2")
    else:
        picked = selection.diverse_selection(scoring.blended_scores(scores), cfg.num_sentences)
    return picked.select("doc_id", "idx", "sentence", "score")


def summarize(
    docs: DataFrame,
    num_sentences: int = 3,
    early_termination_factor: float | None = None,
    algorithm: str = "default",
    processor: str = "clean",
    text_col: str = "text",
    chunk_size: int = CHUNK_SIZE,
    spread: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Summary sentences of every document as rows
    ``(doc_id, idx, sentence, score)``; read them in ``idx`` order.

    ``algorithm='default'``: top-N by the L2-normalised TF-IDF row sum.
    ``algorithm='diverse'``: blended score (TF-IDF, position, length) and a
    greedy pick that penalises near and similar-length sentences.
    ``processor``: ``clean`` (squeeze + abbreviation-aware split), ``raw``
    (plain split), ``chunked`` (slices of ``chunk_size`` characters, each split
    cleanly) or ``trained`` (clean, with sentence boundaries learned from ``docs``). ``early_termination_factor``: read only the first sentences of a
    document, as many as the factor gives; without it all are read.
    ``spread``: distribute the documents before the text work (:func:`distribute`).
    ``tasks``: into how many parts the sentences are dealt by document, for callers who know
    how much there is; a term takes far more memory in a sort than in an exchange, so parts
    of the size that the session aims at are large for what follows.
    """
    cfg = SummaryConfig(num_sentences, early_termination_factor, algorithm, processor)
    docs = distribute(docs, text_col) if spread else docs.select("doc_id", text_col)
    if cfg.cap is not None and cfg.processor in ("clean", "raw"):
        # tokenizing stops at each document's cap
        return summarize_valid(sentences.numbered(sentences.first_valid(docs, cfg.cap, cfg.processor, text_col)), cfg)
    if cfg.processor == "chunked":
        # Slices, not documents, are the unit of work: a huge document is split
        # by many tasks.
        sents = sentences.sentences_chunked(docs, chunk_size, text_col, spread=True)
    else:
        sents = sentences.split_sentences(docs, cfg.processor, text_col)
    return summarize_sentences(sents, cfg, tasks)


def summarize_parts(
    parts: DataFrame,
    key: str,
    order: str,
    num_sentences: int = 3,
    early_termination_factor: float | None = None,
    algorithm: str = "default",
    text_col: str = "text",
) -> DataFrame:
    """Summaries of documents given as ordered parts (conversation turns):
    the same result as summarizing the parts joined by one space with the
    clean processor, without building the joined document, so a document
    with a huge number of parts never sits in one task. Rows
    ``(doc_id, idx, sentence, score)`` with ``doc_id`` = ``key``."""
    from ..operators.stitch import stitched_sentences

    cfg = SummaryConfig(num_sentences, early_termination_factor, algorithm, "clean")
    sents = stitched_sentences(parts, key, order, text_col, longest=MAX_SENTENCE_LENGTH)
    return summarize_sentences(sents, cfg)


def summarize_request(
    spark,
    text: str | list[str] | None = None,
    path: str | None = None,
    num_sentences: int = 3,
    early_termination_factor: float | None = None,
    algorithm: str = "default",
    processor: str = "clean",
) -> DataFrame:
    """One request: exactly one of ``text`` (a string, or a list of strings
    joined with one space) or ``path`` (a file or a folder of txt/md/epub
    files). Returns summary records; parameters are validated before any job
    runs."""
    if (text is None) == (path is None):
        raise ValueError("give exactly one of text and path")
    if isinstance(text, (list, tuple)):
        text = " ".join(str(item) for item in text)
    cfg = SummaryConfig(num_sentences, early_termination_factor, algorithm, processor)
    if path is not None:
        from .files import summarize_files

        return summarize_files(spark, path, cfg.num_sentences, cfg.early_termination_factor, cfg.algorithm, cfg.processor)
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    picked = summarize(docs, cfg.num_sentences, cfg.early_termination_factor, cfg.algorithm, cfg.processor)
    return summary_records(picked, cfg.algorithm, cfg.processor)


def summary_records(picked: DataFrame, algorithm: str = "default", processor: str = "clean") -> DataFrame:
    """Result records ``(doc_id, summary ARRAY<STRING>, method, processor)``:
    the picked sentences of a document in reading order (at most N per
    document, so the per-document array is bounded)."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "sentence")))
    return picked.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["sentence"]).alias("summary")).select(
        "doc_id",
        "summary",
        F.lit(algorithm).alias("method"),
        F.lit(processor).alias("processor"),
    )


def summary_status(docs: DataFrame, cfg: SummaryConfig | None = None, text_col: str = "text") -> DataFrame:
    """Per-document status instead of an exception: ``(doc_id, status,
    n_valid)`` with ``ok`` or ``no_valid_sentences`` (a bad document never
    fails the job). Only counts are exchanged; no join back to the documents."""
    cfg = cfg or SummaryConfig()
    return sentences.sentence_status(docs.select("doc_id", text_col), cfg.processor, text_col)


def rejected_documents(docs: DataFrame, cfg: SummaryConfig | None = None, text_col: str = "text") -> DataFrame:
    """Documents without a single valid sentence: ``(doc_id)``."""
    st = summary_status(docs, cfg, text_col)
    return st.where(F.col("status") == "no_valid_sentences").select("doc_id")


def assemble_text(parts: DataFrame, key: str, order: str, text_col: str = "text", skip_blank: bool = True) -> DataFrame:
    """Join the parts of a document in ``order`` with one space: ``(key,
    text)``. Blank parts are skipped unless ``skip_blank=False`` (a list of
    strings given as one input keeps them). Used for EPUB items and
    conversation turns."""
    kept = parts.where(F.col(text_col).isNotNull())
    if skip_blank:
        kept = kept.where(~T.is_blank(text_col))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t"))))
    return kept.groupBy(key).agg(F.concat_ws(" ", F.transform(ordered, lambda x: x["t"])).alias(text_col))
