"""Document fingerprints: content-defined chunks and weighted containment.

A text's UTF-8 bytes are cut where a gear hash of the last 16 bytes meets a mask:
a strict one until a chunk has ``NORMAL`` bytes and a loose one after, between
``LEAST`` and ``MOST`` bytes (normalised chunking). Borders depend on nearby bytes
alone, so an edit moves those around it and no others. The fingerprint is the sorted
set of chunk digests with their lengths as weights. The likeness of a fingerprint to
another is its containment: the weight of the shared chunks over its own weight.

Two empty texts have likeness 1, an empty and another text 0. Null texts count as
empty.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A

LEAST, NORMAL, MOST = 32, 96, 384
STRICT_BITS, LOOSE_BITS = 7, 5
#: Code points of an edited text built at once, about.
STEP_CHARS = 1 << 20

_GEAR = (A.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk ``starts`` and ``ends`` of all documents and each one's first chunk."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):  # the sum over 16 bytes, the oldest shifted most
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint32(width)
        h = h + older
    # top bits depend on all 16 bytes; those before a document never count, as LEAST > 16
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0) + 1
    strict = (loose[h[loose - 1] >> np.uint32(32 - STRICT_BITS) == 0]).tolist()
    loose = loose.tolist()
    starts: list[int] = []
    first = [0]
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while s < e:
            starts.append(s)
            to = min(s + MOST, e)
            if to > s + LEAST:
                at = bisect_left(strict, s + LEAST)
                if at < len(strict) and strict[at] < min(s + NORMAL, to):
                    to = strict[at]
                elif to > s + NORMAL:
                    at = bisect_left(loose, s + NORMAL)
                    if at < len(loose) and loose[at] < to:
                        to = loose[at]
            s = to
        first.append(len(starts))
    starts_, first_ = np.array(starts, dtype=np.int64), np.array(first, dtype=np.int64)
    ends = np.append(starts_[1:], offsets[-1])
    last = first_[1:][np.diff(first_) > 0] - 1
    ends[last] = offsets[1:][np.diff(first_) > 0]
    return starts_, ends, first_


def chunk_sets(column, hasher: A.WordHasher) -> Iterator[dict[int, int]]:
    """Per text its chunks: digest to length."""
    for _, data, offsets in A.slices(column):
        starts, ends, first = borders(data, offsets)
        digests = (hasher(data, starts, ends) >> np.uint64(16)).tolist() if len(starts) else []
        lengths = (ends - starts).tolist()
        for d in range(len(offsets) - 1):
            yield dict(zip(digests[first[d] : first[d + 1]], lengths[first[d] : first[d + 1]], strict=True))


def fingerprint(chunks: dict[int, int]) -> str:
    return ",".join(["%012x:%d" % c for c in sorted(chunks.items())])


def containment(own: dict[int, int], other: dict[int, int]) -> float:
    """Share of ``own``'s weight that ``other`` holds too."""
    if not own:
        return 1.0 if not other else 0.0
    return sum([own[c] for c in own.keys() & other.keys()]) / sum(own.values())


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, n_chunks long"
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(bucket, extra, doc_id, text, chunks)`` of sorted batches, a few at a time."""
    hasher = A.WordHasher()
    for batch in batches:
        texts = batch.column("text").fill_null("")
        names = (batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id"))
        yield from zip(*names, map(pa.StringScalar.as_py, texts), chunk_sets(texts, hasher), strict=True)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = A.WordHasher()

    def made(pairs: list) -> pa.RecordBatch:
        edited = [mine[3][: len(mine[3]) - len(mine[3]) // 2] + after[3][: len(mine[3]) // 2] for mine, after in pairs]
        out: list[list] = [[] for _ in range(8)]
        for (mine, after), text, chunks in zip(pairs, edited, chunk_sets(pa.array(edited, pa.large_string()), hasher), strict=True):
            row = (mine[2], len(mine[3]), hashlib.sha256(text.encode()).hexdigest(), fingerprint(mine[4]), fingerprint(chunks),
                   containment(mine[4], chunks), containment(mine[4], after[4]), len(mine[4]))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        names = [c.split()[0] for c in OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[n.strip() for n in names])

    pairs, held, size = [], None, 0
    for row in _rows(batches):
        # an extra row ends its bucket: it is the document after the bucket's last
        if held is not None and held[0] == row[0] and not held[1]:
            pairs.append((held, row))
            size += len(held[3])
            if size > STEP_CHARS:
                yield made(pairs)
                pairs, size = [], 0
        held = row
    if pairs:
        yield made(pairs)


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last half replaced
    by the start of the next document by descending id) and their likeness.

    Ids are dealt into ranges, as many as there are shuffle partitions, by a first
    pass over ids and text hashes. A range's first document also goes, as an extra
    row, to the range before it, so one shuffle of the texts brings every document
    together with its next one. Equal ids go by text hash, null ids come last.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("down"), F.xxhash64("text").alias("h"))
    plain = plain.withColumn("place", place)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = plain.select("place").repartitionByRange(parts, "place").groupBy(F.spark_partition_id().alias("p"))
    firsts = sorted((tuple(r["first"]) for r in ranged.agg(F.min("place").alias("first")).collect()))
    if not firsts:
        return spark.createDataFrame([], OUT)
    bounds = F.array(*[F.struct(F.lit(n).alias("none"), F.lit(d).cast("long").alias("down"), F.lit(h).cast("long").alias("h")) for n, d, h in firsts])
    rows = plain.withColumn("bucket", F.size(F.filter(bounds, lambda b: b <= F.col("place"))) - 1)
    is_first = F.element_at(bounds, F.col("bucket") + 1) == F.col("place")
    before = F.pmod(F.col("bucket") - 1, F.lit(len(firsts)))
    copies = F.array(F.struct(F.col("bucket"), F.lit(False).alias("extra")))
    copies = F.when(is_first, F.concat(copies, F.array(F.struct(before.alias("bucket"), F.lit(True).alias("extra"))))).otherwise(copies)
    rows = rows.withColumn("copy", F.explode(copies)).select("copy.bucket", "copy.extra", "place", "doc_id", "text")
    # rows equal to a range's first (same id, same text) come as several extras: the first one counts
    dealt = rows.repartition(len(firsts), "bucket").sortWithinPartitions("bucket", "extra", "place")
    return dealt.select("bucket", "extra", "doc_id", "text").mapInArrow(_edit, OUT)
