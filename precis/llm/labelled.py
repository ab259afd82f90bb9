"""Bounded labelled samples for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: 0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(0))


def drawn(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """Somewhat fewer than ``bound`` rows by a hash of their id: the same rows in every
    run, spread over the whole table, left in their partitions. (Rows that share an id
    are drawn together, so callers also bound what they collect.)"""
    n = rows.count()
    share = min(1.0, 0.95 * bound / max(n, 1))
    lucky = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return rows.where(lucky) if share < 1.0 else rows


def sampled(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """:func:`drawn` for narrow rows, never more than ``bound`` of them."""
    return drawn(rows, bound, seed).limit(bound)


def labels_of(labels: DataFrame, name: str) -> DataFrame:
    """``(doc_id, label)`` with one row an id; null ids and labels are left out,
    of several labels the largest holds."""
    plain = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label"))
    return plain.dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
