"""File sources: text, Markdown and EPUB files into a documents table.

``binaryFile`` lists the files. Summaries read them in parts (:mod:`.parts`); the documents
table here has one row a file, as its name says: one Arrow-batched pass unzips, and decoding,
HTML stripping and everything after is built-in expressions. A bad file gets a status and
never fails the job.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .parts import epub_names, in_unicode

ITEMS_SCHEMA = "path string, ext string, status string, items array<binary>"


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``(path, name, ext, length, content BINARY)`` for every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return with_file_columns(files)


def with_file_columns(files: DataFrame) -> DataFrame:
    """``(path, name, ext, length, content)`` from ``binaryFile`` rows (batch or stream)."""
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        T.file_extension("path").alias("ext"),
        "length",
        "content",
    )


def corpus_files(spark: SparkSession, path: str, extensions=("md",)) -> DataFrame:
    """A corpus folder: every file under ``path`` (recursively) whose extension
    is in ``extensions`` (case-insensitive, on the file name)."""
    files = read_files(spark, path)
    return files.where(F.col("ext").isin(*extensions))


# --- EPUB -------------------------------------------------------------------------------------
def epub_documents(content: bytes) -> list[str]:
    """Markup of the document items of one EPUB, in manifest order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [in_unicode(z.read(name)) for name in epub_names(z)]


def _read_items(batches):
    for pdf in batches:
        rows = []
        for path, ext, content in zip(pdf["path"], pdf["ext"], pdf["content"], strict=True):
            if ext in ("txt", "md"):
                rows.append((path, ext, "ok", [bytes(content)]))
            elif ext == "epub":
                try:
                    rows.append((path, ext, "ok", [item.encode() for item in epub_documents(bytes(content))]))
                except Exception:  # corrupt archive or package: a status, not a failed job
                    rows.append((path, ext, "invalid_epub", None))
            else:
                rows.append((path, ext, "unsupported_file", None))
        yield pd.DataFrame(rows, columns=["path", "ext", "status", "items"])


# --- documents ---------------------------------------------------------------------------------
def file_documents(files: DataFrame, processor: str = "clean") -> DataFrame:
    """Documents from files: ``(doc_id, path, ext, status, text)``, one row a file.

    txt/md are decoded. EPUB items, which one file row holds, are converted to text and
    joined with one space in that row: text nodes joined by a space and blank items
    skipped for the ``clean`` processor; glued text nodes for ``chunked``. Other
    extensions get ``status='unsupported_file'`` and no text. ``doc_id`` is a hash of
    the path, so re-runs give the same ids. One scan, one unzip, no exchange.
    """
    rows = files.select("path", "ext", "content").mapInPandas(_read_items, ITEMS_SCHEMA)
    if processor == "chunked":
        book = F.array_join(F.transform("items", lambda i: T.html_to_text_glued(T.decode_bytes(i))), " ")
    else:
        book = F.array_join(F.filter(F.transform("items", lambda i: T.html_to_text(T.decode_bytes(i))), lambda t: ~T.is_blank(t)), " ")
    text = F.when(F.col("ext") == "epub", book).otherwise(T.decode_bytes(F.element_at("items", 1)))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "ext", "status", text.alias("text"))
