"""Summaries of files: txt, md and EPUB under a folder, one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SummaryConfig
from ..sources.files import read_files
from ..sources.parts import file_part_sentences, file_statuses, file_texts
from .summarize import summarize_sentences, summary_records


def summarize_files(
    spark: SparkSession,
    path: str,
    num_sentences: int = 3,
    early_termination_factor: float | None = None,
    algorithm: str = "default",
    processor: str = "clean",
) -> DataFrame:
    """One record per file: ``(doc_id, path, status, summary, method,
    processor)``. ``status`` is ``ok``, ``no_valid_sentences``,
    ``unsupported_file`` or ``invalid_epub``; a bad file never fails the job.

    ``processor='clean'``: txt/md are split plainly, EPUB text cleanly;
    ``processor='chunked'``: every text is cut into 1 MiB slices first.
    """
    return summarize_file_rows(read_files(spark, path), num_sentences, early_termination_factor, algorithm, processor)


def summarize_file_rows(
    files: DataFrame,
    num_sentences: int = 3,
    early_termination_factor: float | None = None,
    algorithm: str = "default",
    processor: str = "clean",
) -> DataFrame:
    """:func:`summarize_files` on rows ``(path, ext, length)`` (a folder
    listed, or one micro-batch of a file stream). The files are read in parts, so
    none has to fit into a row."""
    cfg = SummaryConfig(num_sentences, early_termination_factor, algorithm, processor)
    algorithm, processor = cfg.algorithm, cfg.processor
    if processor not in ("clean", "chunked"):
        raise ValueError("processor must be 'clean' or 'chunked' for files")
    docs = file_statuses(files).select(F.xxhash64("path").alias("doc_id"), "path", "status")
    picked = summarize_sentences(file_part_sentences(file_texts(files), processor), cfg)
    records = summary_records(picked, algorithm, processor)
    out = docs.select("doc_id", "path", "status").join(records.drop("method", "processor"), "doc_id", "left")
    status = F.when((F.col("status") == "ok") & F.col("summary").isNull(), F.lit("no_valid_sentences")).otherwise(F.col("status"))
    return out.select(
        "doc_id",
        "path",
        status.alias("status"),
        "summary",
        F.lit(algorithm).alias("method"),
        F.lit(processor).alias("processor"),
    )
