"""precis: extractive summarization of document tables on Spark."""

import sys

from pyspark import cloudpickle

from .config import SummaryConfig
from .plans.files import summarize_files
from .plans.summarize import (
    assemble_text,
    distribute,
    rejected_documents,
    summarize,
    summarize_parts,
    summarize_request,
    summarize_sentences,
    summary_records,
    summary_status,
)
from .streaming.stream import current_idf, current_summaries, idf_stream, summarize_file_stream, summarize_stream, summarize_versions_stream

# Functions that run inside tasks are pickled by value, so executors need no copy of
# the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "SummaryConfig",
    "assemble_text",
    "current_idf",
    "current_summaries",
    "distribute",
    "idf_stream",
    "rejected_documents",
    "summarize",
    "summarize_file_stream",
    "summarize_files",
    "summarize_parts",
    "summarize_request",
    "summarize_sentences",
    "summarize_stream",
    "summarize_versions_stream",
    "summary_records",
    "summary_status",
]
