"""Incremental summarization of arriving documents (Structured Streaming).

Documents arrive as new files in a folder. Each document is whole inside one
micro-batch, so a summary needs no state across batches: every micro-batch
is summarized with the batch plan in ``foreachBatch``. Output of batch ``b``
goes to ``<sink>/batch_id=b`` with mode ``overwrite``, so a batch replayed
after a failure rewrites the same folder (idempotent), and the checkpoint
records progress in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import SummaryConfig
from ..operators import tfidf
from ..plans.summarize import kept_sentences, summarize

DOCUMENT_SCHEMA = "doc_id bigint, text string"
VERSIONED_SCHEMA = "doc_id bigint, text string, version bigint"
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def summarize_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    num_sentences: int = 3,
    early_termination_factor: float | None = None,
    algorithm: str = "default",
    processor: str = "clean",
    source_format: str = "parquet",
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream; returns the running query (``awaitTermination`` to
    wait). ``checkpoint``: this stream's own folder in shared storage (two streams
    never share one)."""
    SummaryConfig(num_sentences, early_termination_factor, algorithm, processor)  # validate now
    reader = spark.readStream.schema(DOCUMENT_SCHEMA).format(source_format)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.load(source)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = summarize(batch, num_sentences, early_termination_factor, algorithm, processor)
        out.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")

    writer = docs.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def summarize_file_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    num_sentences: int = 3,
    early_termination_factor: float | None = None,
    algorithm: str = "default",
    processor: str = "clean",
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Summaries of txt/md/EPUB files as they land in ``source`` (one record
    per file with its status), written per micro-batch like
    :func:`summarize_stream`. Each file is whole in one micro-batch."""
    from ..plans.files import summarize_file_rows
    from ..sources.files import with_file_columns

    cfg = SummaryConfig(num_sentences, early_termination_factor, algorithm, processor)
    if cfg.processor not in ("clean", "chunked"):
        raise ValueError("processor must be 'clean' or 'chunked' for files")
    reader = spark.readStream.schema(BINARY_FILE_SCHEMA).format("binaryFile").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.load(source)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = summarize_file_rows(with_file_columns(batch), num_sentences, early_termination_factor, algorithm, processor)
        out.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")

    writer = files.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


# --- documents that arrive again ---------------------------------------------------------------
def newest(batch: DataFrame) -> DataFrame:
    """One row a document: its highest version (of equal ones the smaller text hash)."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("version"), F.xxhash64("text"))
    return batch.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def _arrivals(sink: str) -> str:
    return f"{sink.rstrip('/')}-arrivals"


def summarize_versions_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    num_sentences: int = 3,
    algorithm: str = "default",
    processor: str = "clean",
    source_format: str = "parquet",
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Like :func:`summarize_stream` for documents ``(doc_id, text, version)`` that may arrive
    again, in one or in several versions. Each micro-batch writes its summaries and, beside the
    sink, which versions arrived; both are rewritten alike when a batch is replayed.
    :func:`current_summaries` reads the one summary that holds for each document."""
    SummaryConfig(num_sentences, None, algorithm, processor)  # validate now
    reader = spark.readStream.schema(VERSIONED_SCHEMA).format(source_format)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        docs = newest(batch)
        out = summarize(docs, num_sentences, None, algorithm, processor)
        out.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
        docs.select("doc_id", "version").write.mode("overwrite").parquet(f"{_arrivals(sink)}/batch_id={batch_id}")

    writer = reader.load(source).writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def current_summaries(spark: SparkSession, sink: str) -> DataFrame:
    """Summary rows of each document's highest version, of one that arrived more than once
    those of its first arrival. A document whose highest version has no valid sentence has
    none, whatever its earlier versions had."""
    arrived = spark.read.parquet(_arrivals(sink))
    first = F.max(F.struct("version", (-F.col("batch_id")).alias("b")))
    holds = arrived.groupBy("doc_id").agg(first.alias("_m")).select("doc_id", (-F.col("_m.b")).alias("batch_id"))
    return spark.read.parquet(sink).join(holds, ["doc_id", "batch_id"], "left_semi").drop("batch_id")


# --- corpus IDF kept up to date -------------------------------------------------------------------
def idf_stream(
    spark: SparkSession,
    source: str,
    store: str,
    checkpoint: str,
    processor: str = "clean",
    source_format: str = "parquet",
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Count the documents that hold each term as documents arrive: every micro-batch writes
    its own counts to ``store/batch_id=b`` (a replay rewrites them), and counts add up. Each
    document arrives once."""
    cfg = SummaryConfig(processor=processor)
    reader = spark.readStream.schema(DOCUMENT_SCHEMA).format(source_format)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        counts = tfidf.document_counts(kept_sentences(batch, cfg))
        counts.write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch_id={batch_id}")

    writer = reader.load(source).writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def current_idf(spark: SparkSession, store: str) -> DataFrame:
    """Corpus IDF ``(term, df, idf)`` of all documents that arrived, equal to one pass over
    them; its work follows the number of distinct terms, not the documents."""
    return tfidf.idf_of_counts(spark.read.parquet(store).groupBy("term").agg(F.sum("df").alias("df")))
