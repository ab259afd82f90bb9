"""Vector codes by part codebooks, with value dictionaries for each dimension.

A component becomes the integer ``floor(256 x)``, and a vector is cut into equal parts. Vectors
are kept in blocks; a block holds, for each dimension, a dictionary of the distinct integers
and every vector's code in it. Against a codebook the squared differences of a dimension's
dictionary to all entries are tabulated once a block, and the distances of all parts to all
entries are gathers of table rows by code, added up over the part: no vector is subtracted
from any entry.

Only blocks are written and read again; each round sends one sum and count for each entry and
dimension from a task, and codebooks (entries x dimensions) pass through the driver.

Rows with a null vector, or with a null or non-finite component, are left out. Shorter vectors
count as filled up with zeros, to the longest one's length and on to a multiple of the parts
(an empty vector is all zeros). Components beyond ``+-32768`` count as that, so that sums stay
exact. A codebook starts from the smallest ids (of rows with one id the smaller vector first,
null ids last); with fewer rows it has fewer entries.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors of a block: a dictionary has at most so many values, so codes take two bytes.
BLOCK = 4096
LIMIT = 1 << 23
#: Labels up to which their sums are broadcast; more meet salted rows in a shuffle.
LABELS = 1 << 16
SALTS = 16


# --- blocks -----------------------------------------------------------------------------------
def _integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are kept, and their vectors as integers, short ones filled up with zeros."""
    full = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.drop_null()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    bad = np.bincount(row, weights=~np.isfinite(flat), minlength=len(sizes)) > 0
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int32)
    with np.errstate(invalid="ignore", over="ignore"):
        out[row, np.arange(len(flat)) - first[row]] = np.where(np.isfinite(flat), np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT), 0)
    return full[~bad], out[~bad]


def _blocks(batches):
    for batch in batches:
        rows, vectors = _integers(batch.column("embedding"))
        for at in range(0, len(rows), BLOCK):
            some = vectors[at : at + BLOCK]
            values, sizes, codes = [], [], []
            for column in some.T:
                distinct, code = np.unique(column, return_inverse=True)
                values.append(distinct)
                sizes.append(len(distinct))
                codes.append(code.astype("<u2"))
            take = pa.array(rows[at : at + BLOCK])
            one = [
                pa.array([batch.column("vec_id").take(take).to_pylist()], pa.list_(pa.int64())),
                pa.array([batch.column("label").take(take).to_pylist()], pa.list_(pa.string())),
                pa.array([np.concatenate(values).astype("<i4").tobytes() if values else b""], pa.binary()),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.array([b"".join(c.tobytes() for c in codes)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(one, names=["vec_ids", "labels", "dictionary", "sizes", "codes"])


def blocks(vectors: DataFrame) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors: their ids and labels, the dictionaries of all dimensions
    one after the other with their sizes, and the codes, dimension by dimension."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInArrow(_blocks, "vec_ids array<long>, labels array<string>, dictionary binary, sizes array<int>, codes binary")


class Block:
    """One row of :func:`blocks`."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        self.ids, self.labels = batch.column("vec_ids")[i].as_py(), batch.column("labels")[i].as_py()
        self.sizes = batch.column("sizes")[i].as_py()
        ends = np.cumsum(self.sizes)
        values = np.frombuffer(batch.column("dictionary")[i].as_buffer(), "<i4").astype(np.int64)
        self.values = [values[e - n : e] for e, n in zip(ends, self.sizes, strict=True)]
        self.codes = np.frombuffer(batch.column("codes")[i].as_buffer(), "<u2").reshape(len(self.sizes), len(self.ids))

    def dictionary(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and codes of a dimension; one that the block lacks holds zeros."""
        if d < len(self.sizes):
            return self.values[d], self.codes[d]
        return np.zeros(1, np.int64), np.zeros(len(self.ids), np.uint16)

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every part (rows x parts); ``books`` is entries x
        dimensions. Of equal distances the lower entry holds."""
        dims = books.shape[1]
        width = dims // PARTS
        entry, distance = np.empty((len(self.ids), PARTS), np.int64), np.empty((len(self.ids), PARTS), np.int64)
        for part in range(PARTS):
            total = np.zeros((len(self.ids), len(books)), np.int64)
            for d in range(part * width, (part + 1) * width):
                values, codes = self.dictionary(d)
                squares = (values[:, None] - books[None, :, d]) ** 2
                total += squares.take(codes, axis=0)
            entry[:, part] = total.argmin(axis=1)
            distance[:, part] = total.min(axis=1)
        return entry, distance


def _each(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch, i)


# --- codebooks ----------------------------------------------------------------------------------
def _smallest(batches):
    """The rows of a task with the smallest ids."""
    best: list[tuple] = []
    for block in _each(batches):
        order = sorted((i is None, i or 0, k) for k, i in enumerate(block.ids))
        cut_ = order[min(ENTRIES, len(order)) - 1][:2]
        ks = [k for null, i, k in order if (null, i) <= cut_]
        rows = np.stack([block.dictionary(d)[0][block.dictionary(d)[1][ks]] for d in range(len(block.sizes))], axis=1) if block.sizes else np.zeros((len(ks), 0), np.int64)
        best += [(block.ids[k] is None, block.ids[k] or 0, row) for k, row in zip(ks, rows.tolist(), strict=True)]
        best = sorted(best)[:ENTRIES]
    ids = [None if null else i for null, i, _ in best]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([v for *_, v in best], pa.list_(pa.int64()))], names=["vec_id", "vector"])


def first_books(table: DataFrame) -> np.ndarray:
    """Entries x dimensions: the vectors of the smallest ids."""
    longest = table.select(F.max(F.size("sizes"))).first()[0] or 0
    dims = max(PARTS, -(-longest // PARTS) * PARTS)
    first = table.mapInArrow(_smallest, "vec_id long, vector array<long>").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    return np.array([r.vector + [0] * (dims - len(r.vector)) for r in first], np.int64).reshape(len(first), dims)


def _sums(books: np.ndarray):
    width = books.shape[1] // PARTS

    def run(batches):
        counts, totals = np.zeros((PARTS, len(books)), np.int64), np.zeros(books.shape, np.int64)
        for block in _each(batches):
            entry, _ = block.nearest(books)
            for part in range(PARTS):
                counts[part] += np.bincount(entry[:, part], minlength=len(books))
            for d in range(books.shape[1]):
                values, codes = block.dictionary(d)
                # exact: at most BLOCK values of at most LIMIT
                totals[:, d] += np.bincount(entry[:, d // width], weights=values[codes], minlength=len(books)).astype(np.int64)
        part, used = np.nonzero(counts)
        at, dim = np.repeat(used, width), (part[:, None] * width + np.arange(width)).ravel()
        cols = [pa.array(at, pa.int64()), pa.array(dim, pa.int64()), pa.array(np.repeat(counts[part, used], width)), pa.array(totals[at, dim])]
        yield pa.RecordBatch.from_arrays(cols, names=["entry", "dim", "n", "total"])

    return run


def refined(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floored mean of the parts nearest to it; an unused one stays."""
    out = books.copy()
    sums = table.mapInArrow(_sums(books), "entry long, dim long, n long, total long").groupBy("entry", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in sums.collect():
        out[r.entry, r.dim] = r.total // r.n
    return out


def codebooks_sha256(books: np.ndarray) -> str:
    """Hash of all components by part, entry and position."""
    by_part = books.reshape(len(books), PARTS, books.shape[1] // PARTS).transpose(1, 0, 2)
    return hashlib.sha256(",".join(map(str, by_part.ravel().tolist())).encode()).hexdigest()


def _coded(books: np.ndarray):
    def run(batches):
        for block in _each(batches):
            entry, distance = block.nearest(books)
            text = entry.astype(np.uint8).tobytes().hex()
            codes = [text[2 * PARTS * k : 2 * PARTS * (k + 1)] for k in range(len(block.ids))]
            cols = [pa.array(block.ids, pa.int64()), pa.array(block.labels, pa.string()), pa.array(codes), pa.array(distance.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "code", "error"])

    return run


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: ``vec_id, code, error, label_error, codebooks_sha256``."""
    table = cut(blocks(vectors), "blocks")
    books = first_books(table)
    for _ in range(rounds if len(books) else 0):
        books = refined(table, books)
    rows = cut(table.mapInArrow(_coded(books), "vec_id long, label string, code string, error long"), "coded")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), most).cast("long").alias("label_error"))
    sums = cut(sums, "labels").withColumnRenamed("label", "_label")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= LABELS:
        out = rows.join(F.broadcast(sums), same)
    else:  # a label may still hold a third of all rows
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        sums = sums.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(sums, same & (F.col("_salt") == F.col("_salt2")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """The rounds as SQL: assign every part, then move the entries."""
    sql = ""
    for r in range(ROUNDS + 1):
        sql += f"""
a{r} AS MATERIALIZED (
  SELECT k, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (
    SELECT p.k, p.part, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{r} c USING (part))
  GROUP BY k, part),"""
        if r < ROUNDS:
            sql += f"""
m{r} AS (SELECT part, entry, i, floor_div(sum(x), count(*)) AS x FROM (
    SELECT a.part, a.entry, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS i FROM a{r} a JOIN p USING (k, part)) GROUP BY part, entry, i),
n{r} AS (SELECT part, entry, list(x ORDER BY i) AS v FROM m{r} GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN n{r} USING (part, entry)),"""
    return sql.replace("floor_div(sum(x), count(*))", "((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT")


ORACLE_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT k, part, list_slice(v, part * len(v) // {PARTS} + 1, (part + 1) * len(v) // {PARTS}) AS v FROM kept, (SELECT unnest(range({PARTS})) AS part)),
c0 AS MATERIALIZED (SELECT part, k - 1 AS entry, v FROM p WHERE k <= {ENTRIES}),{_rounds_sql()}
books AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c{ROUNDS})),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a{ROUNDS} JOIN kept USING (k) GROUP BY k, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""
