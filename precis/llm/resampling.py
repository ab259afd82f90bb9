"""Importance resampling of documents towards the distribution of target texts.

Features are n-grams of words, hashed to buckets by the CRC-32 of their bytes. A text is
lower-cased and its separators become single spaces; one scan stores the running CRC at
every word's first and last byte. CRC-32 is linear over GF(2): with ``shift`` the map that
appends as many zero bytes as the n-gram has, ``crc(gram) = crc(prefix to its end) xor
shift(crc(prefix to its start))``, so the CRC of every n-gram of any order comes from two
stored prefixes, and no byte is read again.

A bucket's gain is ``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))``, from its counts ``s`` in
all documents (``S`` features) and ``t`` in all target texts (``T``). A document's weight is
the floored mean gain of its features (none: 0); Gumbel noise that its id seeds is added, and
the highest scores are drawn without replacement.

A null text has no words. A null id counts as empty text in the seed and ranks last among
equal scores. Rows that share an id are documents of their own. Counts are summed in each
task first and come to the driver as one number a bucket. The rank is taken over a range
partitioned table, so no task sees all documents.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

BUCKETS = 10_000
SEED = 2024
#: Share of the able documents that is drawn, in per cent, and words that make one able.
PERCENT = 10
MIN_WORDS = 20
#: Bytes of a text whose words are listed at once.
PIECE = 1 << 20

# [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, letters, all of non-ASCII
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


# --- CRC of substrings ---------------------------------------------------------------------
def _apply(images: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map, given by the images of the 32 bits, of each value."""
    out = np.zeros_like(values)
    for k in range(32):
        out ^= np.where(values >> np.uint32(k) & np.uint32(1), images[k], np.uint32(0))
    return out


@lru_cache(maxsize=64)
def _doubled(k: int) -> np.ndarray:
    """Images of the bits when ``2**k`` zero bytes are appended."""
    if k == 0:
        zero = crc32(b"\0", 0)
        return np.array([crc32(b"\0", 1 << bit) ^ zero for bit in range(32)], np.uint32)
    return _apply(_doubled(k - 1), _doubled(k - 1))


@lru_cache(maxsize=512)
def shift_tables(length: int) -> np.ndarray:
    """Four tables, one a byte of a CRC, of what ``length`` appended zero bytes make of it."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k in range(length.bit_length()):
        if length >> k & 1:
            images = _apply(_doubled(k), images)
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([_apply(images, byte << np.uint32(8 * place)) for place in range(4)])


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as its length says."""
    out = np.empty_like(crcs)
    order = np.argsort(lengths, kind="stable")
    found, first = np.unique(lengths[order], return_index=True)
    for length, a, b in zip(found, first, [*first[1:], len(order)], strict=True):
        at = order[a:b]
        c, t = crcs[at], shift_tables(int(length))
        out[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return out


def prefix_crcs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: the running CRC before it and at its end, and its length, in the text
    with its separators normalised. The words of one piece are listed at a time."""
    text = text.translate(_NORMAL)
    starts, ends, sizes, crc, at = [], [], [], 0, 0
    while at < len(text):
        to = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        to = len(text) if to < 0 else to
        words = text[at:to].split()
        at = to
        if words:
            # word, space, word, space ...: the running CRC after each of them
            spaced = [b" "] * (2 * len(words))
            spaced[::2] = words
            run = np.fromiter(accumulate(spaced, lambda c, piece: crc32(piece, c), initial=crc), np.uint32, len(spaced) + 1)
            crc = int(run[-1])
            starts.append(run[:-1:2])
            ends.append(run[1::2])
            sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
    if not sizes:
        none = np.zeros(0, np.uint32)
        return none, none, np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(sizes)


def ngram_crcs(prefixes: tuple[np.ndarray, np.ndarray, np.ndarray], max_n: int = 1) -> np.ndarray:
    """CRC-32 of all runs of 1 to ``max_n`` words, joined by one space, from the stored
    prefixes."""
    starts, ends, sizes = prefixes
    place = np.concatenate(([0], np.cumsum(sizes + 1)))  # byte of every word's start
    out = [np.zeros(0, np.uint32)]
    for n in range(1, min(max_n, len(sizes)) + 1):
        count = len(sizes) - n + 1
        out.append(ends[n - 1 :] ^ shifted(starts[:count], place[n : n + count] - 1 - place[:count]))
    return np.concatenate(out)


# --- tasks -----------------------------------------------------------------------------------
def _features(max_n: int, buckets: int):
    def run(batches):
        for batch in batches:
            words, counts, found = [], [], []
            for text in batch.column("text"):
                prefixes = prefix_crcs(text.as_py() or b"")
                crcs = ngram_crcs(prefixes, max_n)
                words.append(len(prefixes[0]))
                counts.append(len(crcs))
                found.append((crcs % np.uint32(buckets)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.binary())],
                names=["doc_id", "n_words", "n_features", "buckets"],
            )

    return run


def features(texts: DataFrame, id_col: str, max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, n_features, buckets)``: the bucket of every feature of a text, four
    bytes each."""
    plain = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return plain.mapInArrow(_features(max_n, buckets), "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: a task sums its rows, the driver gets one
    number a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cell in batch.column("buckets"):
                total += np.bincount(np.frombuffer(cell.as_buffer(), "<u4"), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln(...))`` of each bucket, from its counts in documents and target."""
    s, t, buckets = own.astype(float), target.astype(float), len(own)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``."""

    def run(batches):
        for batch in batches:
            sums = [int(gain[np.frombuffer(cell.as_buffer(), "<u4")].sum()) for cell in batch.column("buckets")]
            means = [total // n if n else 0 for total, n in zip(sums, batch.column("n_features").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(means, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


# --- the draw --------------------------------------------------------------------------------
def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Add the 1-based rank in ``order``: the rows are sorted over range partitions and
    written, and the driver learns one count a partition."""
    spark = rows.sparkSession
    placed = cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    before = list(accumulate((n for _, n in sizes), initial=0))
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part long, _before long")
    # one row a partition of the sort
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_at")


def importance_resample(
    docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, target_id: str = "item_id"
) -> DataFrame:
    """One row per document: ``doc_id, n_features, weight, score, rank`` (null: not drawn)."""
    found = cut(features(docs, "doc_id", max_n, buckets), "features")
    aim = features(target.withColumnRenamed(target_id, "doc_id") if target_id != "doc_id" else target, "doc_id", max_n, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(aim, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weighted(found, gain).withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    row = ["doc_id", "n_features", "weight", "score"]
    placed = ranked(able.select(*row), order).select(*row, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    rest = scored.where(F.col("n_words") < min_words).select(*row, F.lit(None).cast("long").alias("rank"))
    return placed.union(rest)


def resampled_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents that are drawn, with all their columns (a null id is never among them)."""
    drawn = importance_resample(docs, target, **options).where("rank is not null").select("doc_id").dropna()
    return docs.join(drawn.distinct(), "doc_id", "left_semi").select(*docs.columns)


# the table of CRC-32, by its rule: the CRC of one byte without the two inversions
_TABLE = [crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)]
ORACLE_SQL = f"""
WITH low AS (
  SELECT doc_id, 0 AS target, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT item_id, 1, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT doc_id, target, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM low),
occurs AS (SELECT doc_id, target, unnest(ws) AS w FROM words),
bytes AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM occurs)),
bucket AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, ({_TABLE}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM bytes),
counts AS (SELECT bucket, sum((target = 0)::INT) AS s, sum((target = 1)::INT) AS t FROM occurs JOIN bucket USING (w) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM counts),
gain AS (
  SELECT bucket, floor(1000 * ln((c.t + 1)::DOUBLE * (total.s + {BUCKETS})::DOUBLE / ((c.s + 1)::DOUBLE * (total.t + {BUCKETS})::DOUBLE))) AS gain FROM counts c, total),
weights AS (SELECT doc_id, floor(sum(gain) / count(*)) AS weight FROM occurs JOIN bucket USING (w) JOIN gain USING (bucket) WHERE target = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE target = 0),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS})
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM scored LEFT JOIN able USING (doc_id)
"""
