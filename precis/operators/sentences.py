"""Sentence-level operators: split, filter, tokenize, cap.

Contract of a *sentence table*: ``(doc_id, seq BIGINT, sentence STRING)`` where
``seq`` orders the sentences of a document (reading order). Splitting and
tokenizing are row-local (no shuffle): every document is one row, and its
sentences are produced in the same task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK_SIZE, MAX_SENTENCE_LENGTH, MIN_SENTENCE_LENGTH, MIN_WORDS_COUNT, PROCESSORS
from ..functions import text as T

# Chunk number goes to the high 32 bits of seq in the chunked processor; a
# chunk of at most 2**31 characters has fewer sentences than 2**32.
_CHUNK_SHIFT = 1 << 32


def shuffle_partitions(df: DataFrame) -> int:
    """Number of shuffle partitions that the session sets."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _posexplode(df: DataFrame, arr, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(arr).alias("seq", "sentence")).withColumn("seq", F.col("seq").cast("long"))


def sentences_clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Clean processor: squeeze, abbreviation-aware split, long-piece re-split,
    validity filter."""
    return _posexplode(docs, T.split_clean(text_col), ["doc_id"])


def sentences_raw(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Raw processor: plain split after ``[.!?]`` + white space, blanks dropped."""
    return _posexplode(docs, T.split_raw(text_col), ["doc_id"])


def sentences_abbrev(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Split with the look-around abbreviation pattern (blank pieces dropped)."""
    arr = F.filter(T.split_abbrev(text_col), lambda s: ~T.is_blank(s))
    return _posexplode(docs, arr, ["doc_id"])


def chunk_text(docs: DataFrame, chunk_size: int = CHUNK_SIZE, text_col: str = "text") -> DataFrame:
    """Cut each text into ``chunk_size``-character slices; blank slices are
    dropped. Returns ``(doc_id, chunk_no, chunk)``. A huge document becomes
    many rows, so later stages can spread it over tasks."""
    chunks = docs.select("doc_id", F.posexplode(T.chunks(text_col, chunk_size)).alias("chunk_no", "chunk"))
    return chunks.where(~T.is_blank("chunk"))


def sentences_chunked(
    docs: DataFrame, chunk_size: int = CHUNK_SIZE, text_col: str = "text", spread: bool = False
) -> DataFrame:
    """Chunked processor: clean split inside each slice (sentences are cut at
    slice edges), order kept through ``seq = chunk_no * 2**32 + pos``.

    With ``spread=True`` the slices are hash-distributed by
    ``(doc_id, chunk_no)`` before splitting, so one very large document is
    split by many tasks (one per slice) instead of one.
    """
    chunks = chunk_text(docs, chunk_size, text_col)
    if spread:
        # an explicit number: the work is CPU, so merging partitions by bytes would idle cores
        chunks = chunks.repartition(shuffle_partitions(docs), "doc_id", "chunk_no")
    return sentences_of_chunks(chunks)


def sentences_of_chunks(chunks: DataFrame) -> DataFrame:
    """Clean split of slices ``(doc_id, chunk_no, chunk)``."""
    out = chunks.select("doc_id", "chunk_no", F.posexplode(T.split_clean("chunk")).alias("pos", "sentence"))
    return out.select(
        "doc_id",
        (F.col("chunk_no").cast("long") * _CHUNK_SHIFT + F.col("pos")).alias("seq"),
        "sentence",
    )


def split_sentences(docs: DataFrame, processor: str = "clean", text_col: str = "text") -> DataFrame:
    """Dispatch on the processor name: ``clean``, ``raw``, ``chunked`` or ``trained`` (the clean
    split with boundaries learned from these documents)."""
    if processor == "clean":
        return sentences_clean(docs, text_col)
    if processor == "raw":
        return sentences_raw(docs, text_col)
    if processor == "chunked":
        return sentences_chunked(docs, text_col=text_col)
    if processor == "trained":
        from .boundaries import sentences_trained

        return sentences_trained(docs, text_col=text_col)
    raise ValueError(f"processor must be one of {PROCESSORS}")


def length_filter(sentences: DataFrame) -> DataFrame:
    """Keep sentences of 40 to 1000 characters (inclusive)."""
    return sentences.where(F.length("sentence").between(MIN_SENTENCE_LENGTH, MAX_SENTENCE_LENGTH))


def with_terms(sentences: DataFrame) -> DataFrame:
    """Add ``terms ARRAY<STRING>`` (filtered tokens) and ``n_words INT``.

    Tokens are computed in a projection (where shared sub-expressions of the
    tokenizer are evaluated once) and then passed through a one-element
    ``explode``: a later filter on ``n_words`` refers to the generator output
    and cannot be pushed below it, so Catalyst does not inline the whole regex
    chain into that filter and tokenize each sentence twice.
    """
    cols = [c for c in sentences.columns if c not in ("terms", "n_words")]
    staged = sentences.select(*cols, T.terms("sentence").alias("_terms"))
    out = staged.select(*cols, F.explode(F.array("_terms")).alias("terms"))
    return out.withColumn("n_words", F.size("terms"))


def valid_sentences(sentences: DataFrame) -> DataFrame:
    """Length bounds first (cheap), then tokenize, then at least 8 words."""
    return with_terms(length_filter(sentences)).where(F.col("n_words") >= MIN_WORDS_COUNT)


def numbered(valid: DataFrame) -> DataFrame:
    """Number all valid sentences: ``idx`` (0-based rank in reading order) and ``n``
    (sentences of the document). The exchange on ``doc_id`` that the windows need
    carries valid sentences only, never whole texts."""
    by_doc = Window.partitionBy("doc_id")
    idx = (F.row_number().over(by_doc.orderBy("seq")) - 1).cast("int")
    return valid.withColumn("idx", idx).withColumn("n", F.count(F.lit(1)).over(by_doc).cast("int"))


def early_termination(valid: DataFrame, cap: int | None) -> DataFrame:
    """Keep the first ``cap`` valid sentences of each document (None: all).

    Adds ``idx`` (0-based rank among valid sentences) and ``n`` (sentences kept
    in the document). The filter is written as ``rn <= cap`` right on the
    ``row_number`` so Catalyst plans it as a per-document group limit
    (``WindowGroupLimit``): rows past the cap are dropped before the window is
    computed. On input not yet distributed by ``doc_id`` the limit also runs
    partially before the shuffle, so at most ``cap`` rows per document and map
    task are shuffled, however long the document is.
    """
    if cap is None:
        return numbered(valid)
    by_doc = Window.partitionBy("doc_id")
    ordered = by_doc.orderBy("seq")
    capped = valid.withColumn("rn", F.row_number().over(ordered)).where(F.col("rn") <= cap)
    return (
        capped.withColumn("idx", (F.col("rn") - 1).cast("int"))
        .withColumn("n", F.count(F.lit(1)).over(by_doc).cast("int"))
        .drop("rn")
    )


def first_valid(docs: DataFrame, cap: int, processor: str = "clean", text_col: str = "text") -> DataFrame:
    """The first ``cap`` valid sentences of each document, pulled one after the other:
    ``(doc_id, seq, sentence, terms, n_words)``. Where a document has more than ``cap``
    sentences of a fitting length, they are tokenized in order until ``cap`` valid ones are
    found, and what follows is never read, so the costly part of the work follows the cap and
    not the document's length. Row-local; the same rows as :func:`early_termination`."""
    split = T.split_raw(text_col) if processor == "raw" else T.split_clean(text_col)
    rows = docs.select("doc_id", F.explode(F.array(split)).alias("_s"))

    def fits(s: Column) -> Column:
        return F.length(s).between(MIN_SENTENCE_LENGTH, MAX_SENTENCE_LENGTH)

    def pull(state: Column, s: Column) -> Column:
        valid = fits(s) & (F.size(T.terms_of_one(s)) >= MIN_WORDS_COUNT)
        more = F.struct((state["n"] + F.when(valid, 1).otherwise(0)).alias("n"), (state["read"] + 1).alias("read"))
        return F.when(state["n"] >= cap, state).otherwise(more)

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("read"))
    read = F.when(F.size(F.filter("_s", fits)) <= cap, F.size("_s")).otherwise(F.aggregate("_s", start, pull, lambda state: state["read"]))
    out = _posexplode(rows, F.slice("_s", F.lit(1), read), ["doc_id"])
    return valid_sentences(out)


def sentence_status(docs: DataFrame, processor: str = "clean", text_col: str = "text") -> DataFrame:
    """Per-document status: ``ok`` with the number of valid sentences, or
    ``no_valid_sentences``.

    Sentences are exploded with ``explode_outer`` and validity is a flag,
    not a filter, so a document without sentences keeps one (null) row and
    the count per document needs no join back to the documents: a single
    aggregate on ``doc_id`` over data already distributed by ``doc_id``.
    """
    if processor == "trained":  # its sentences are rows already
        found = valid_sentences(split_sentences(docs, processor, text_col)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_valid"))
        counts = docs.select("doc_id").distinct().join(found, "doc_id", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
        return _status_of(counts)
    if processor == "chunked":
        chunks = docs.select("doc_id", F.explode_outer(T.chunks(text_col, CHUNK_SIZE)).alias("chunk"))
        sents = chunks.select("doc_id", F.explode_outer(F.when(~T.is_blank("chunk"), T.split_clean("chunk"))).alias("sentence"))
    else:
        arr = T.split_raw(text_col) if processor == "raw" else T.split_clean(text_col)
        sents = docs.select("doc_id", F.explode_outer(arr).alias("sentence"))
    in_bounds = F.length("sentence").between(MIN_SENTENCE_LENGTH, MAX_SENTENCE_LENGTH)
    # Out-of-bounds sentences are tokenized as "" (no words): the tokenizer stays
    # unconditional, so its shared sub-expressions are evaluated once.
    candidate = F.when(in_bounds, F.col("sentence")).otherwise(F.lit(""))
    sents = sents.select("doc_id", F.size(T.terms(candidate)).alias("n_words"))
    counts = sents.groupBy("doc_id").agg(F.count(F.when(F.col("n_words") >= MIN_WORDS_COUNT, 1)).alias("n_valid"))
    return _status_of(counts)


def _status_of(counts: DataFrame) -> DataFrame:
    return counts.select(
        "doc_id",
        F.when(F.col("n_valid") == 0, F.lit("no_valid_sentences")).otherwise(F.lit("ok")).alias("status"),
        F.col("n_valid").cast("long").alias("n_valid"),
    )
