"""Driver-side helpers: reading tables, cutting lineage, sizing partitions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. A folder is made
    here only where the setting is absent and the master is local (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


#: Rows that one task handles easily where rows are a few numbers.
TASK_ROWS = 50_000


def cut(df: DataFrame, name: str = "part", rows: int | None = None, batch: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: what
    follows starts from files that outlive any executor. ``rows``: about how many
    narrow rows the last stage reads; a small table is then written by few tasks.
    ``batch``: rows an Arrow batch holds at most, where rows are wide."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism + rows // TASK_ROWS)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(setting)
    if batch is not None:
        spark.conf.set(setting, batch)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if batch is not None:
            spark.conf.set(setting, usual)
    return spark.read.schema(df.schema).parquet(path)


def kept_names(columns: list[str]) -> list[str]:
    """Working names of the columns that a stage passes on."""
    return [f"_row{i}" for i in range(len(columns))]


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all of them under working names: whatever columns
    ``docs`` has, none can clash with one that a stage adds."""
    kept = [F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, kept_names(docs.columns), strict=True)]
    return docs.select(*names, *kept)


def unpacked(columns: list[str], changed: dict[str, Column] | None = None) -> list[Column]:
    """The columns of packed rows under their own names, some of them changed."""
    return [(changed or {}).get(c, F.col(k)).alias(c) for c, k in zip(columns, kept_names(columns), strict=True)]


#: Rows of a sieve: with 64 bits each, 1 MB whatever the number of keys.
SIEVE_ROWS = 1 << 16


def sieve(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """Add the boolean ``name``: false only where ``key`` (a long hash) is not in the
    one column of ``keys``. The keys are folded into a bit table of fixed size, which
    is broadcast; an exact join follows where it matters, on fewer rows."""
    bits = keys.select(F.col(keys.columns[0]).alias("_key"))
    slot, bit = (lambda c: F.pmod(c, F.lit(SIEVE_ROWS))), (lambda c: F.pmod(F.shiftright(c, 20), F.lit(64)).cast("int"))
    one = F.expr("shiftleft(1L, pmod(shiftright(_key, 20), 64))")
    table_ = bits.groupBy(slot(F.col("_key")).alias("_slot")).agg(F.bit_or(one).alias("_bits"))
    marked = df.withColumn("_key", key).withColumn("_slot2", slot(F.col("_key"))).withColumn("_bit", bit(F.col("_key")))
    marked = marked.join(F.broadcast(cut(table_, "sieve")), F.col("_slot") == F.col("_slot2"), "left")
    hit = F.expr("coalesce((shiftright(_bits, _bit) & 1L) = 1L, false)")
    return marked.withColumn(name, hit).drop("_key", "_slot", "_slot2", "_bit", "_bits")


def doc_words(text: Column | str) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text (null: 0)."""
    c = F.col(text) if isinstance(text, str) else text
    # a run of white space becomes one mark, so marks + 1 are the words of a trimmed text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
