"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write summary rows or records as ``parquet`` or ``json`` (JSON lines).

    Each task writes its own files through the committer, so a retried task
    or a lost executor never leaves partial output behind.
    """
    if fmt not in ("parquet", "json"):
        raise ValueError("fmt must be 'parquet' or 'json'")
    df.write.mode(mode).format(fmt).save(path)
