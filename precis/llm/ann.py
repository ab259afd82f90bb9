"""Approximate nearest neighbours by shifted Hilbert orderings.

Each of ``CURVES`` orderings projects the vectors at random onto ``AXES`` axes, shifts
the grid at random and sorts by the Hilbert key, range-partitioned by Spark; a
vector's place is its rank in the order. A query is compared with the blocks of every
ordering that hold ranks up to ``window`` away from its own, its best of each block
are merged and ranked by the exact inner product.

The window is fitted, not fixed: the exact neighbours of ``PROBES`` queries are found
among all rows, and the window is the rank distance that holds ``RECALL`` of them in
the nearest of the orderings. Where vectors have structure it stays small. Vectors
without structure in many dimensions, as in the test tables, need windows of a fixed
share of all ranks, whatever the method; the work then grows with queries times rows,
in blocks of bounded size.

Of equal vectors only the ``K + 1`` smallest ids can be among anybody's ``K``
nearest, so no more of them are candidates (an exact rule, not a cap). Vectors that
are null, empty, zero, of another length than most, or hold null or non-finite
components take no part. Of several rows with one id the smallest vector counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hilbert import hilbert_keys
from .tables import cut

K = 20
EVERY = 20
CURVES, AXES, BITS = 4, 8, 7
PROBES = 64
RECALL = 0.96
#: Ranks in a block of candidates and in a block of queries.
BLOCK, QUERY_BLOCK = 8_192, 40_960
FIT_ROWS = 4_096
SEED = 8

_NEAR = "query_id long, vec_id long, score double"


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the vectors that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & fine)
    rows = cut(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (usual["n"] if usual else 0))


def best_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest inner products of every query: ``(query, row, score)``. A
    query's own id is left out; equal scores go to the smaller id. A product of all
    proposes; the proposed are summed again one by one, in one fixed order."""
    found_q, found_r, found_s = [], [], []
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256] @ rows.T
        block[query_ids[at : at + 256, None] == row_ids[None, :]] = -np.inf
        least = np.partition(block, max(block.shape[1] - k, 0), axis=1)[:, max(block.shape[1] - k, 0)]
        slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0.0)))
        q, r = np.nonzero((block >= (least - slack)[:, None]) & np.isfinite(block))
        scores = (queries[at + q] * rows[r]).sum(axis=1)
        order = np.lexsort((row_ids[r], -scores, q))
        q, r, scores = q[order], r[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        found_q.append(query_ids[at + q[keep]])
        found_r.append(row_ids[r[keep]])
        found_s.append(scores[keep])
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(found_q), np.concatenate(found_r), np.concatenate(found_s)


def _keyed(sample: np.ndarray):
    """A function from vectors to one Hilbert key a curve, fitted on a sample."""
    rng = np.random.default_rng(SEED)
    dims = sample.shape[1]
    axes = min(AXES, dims)
    turns = [np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, :axes] for _ in range(CURVES)]
    shifts = rng.uniform(-0.5, 0.5, (CURVES, axes))
    spreads = [np.maximum((sample @ t).std(axis=0), 1e-12) for t in turns]
    middles = [(sample @ t).mean(axis=0) for t in turns]

    def keys(x: np.ndarray) -> list[np.ndarray]:
        out = []
        for turn, shift, spread, middle in zip(turns, shifts, spreads, middles, strict=True):
            place = (((x @ turn - middle) / spread + shift) / 6 + 0.5) * (1 << BITS)
            out.append(hilbert_keys(np.clip(place, 0, (1 << BITS) - 1).astype(np.int64), BITS))
        return out

    return keys


def lifted(x: np.ndarray, radius2: float, query: bool) -> np.ndarray:
    """Vectors with one coordinate more, so that the largest inner product is the smallest
    distance: candidates are lifted to one sphere of the squared radius."""
    squares = np.einsum("ij,ij->i", x, x)
    if query:  # its length changes no order, so it is put on the same sphere
        return np.column_stack((x * np.sqrt(radius2 / squares)[:, None], np.zeros(len(x))))
    return np.column_stack((x, np.sqrt(np.maximum(radius2 - squares, 0))))


def _ranked(points: DataFrame, keys, radius2: float) -> DataFrame:
    """``points(vec_id, embedding, candidate)`` once a curve, with their ``rank`` in it; a
    candidate that is a query too stands in it twice (``candidate`` tells which)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = pa.array(batch.column("vec_id").to_numpy() % EVERY == 0)
            for rows, role in ((batch.filter(batch.column("candidate")), True), (batch.filter(asked), False)):
                if rows.num_rows:
                    own = pa.array(np.full(rows.num_rows, role))
                    for curve, key in enumerate(keys(lifted(_matrix(rows.column("embedding")), radius2, not role))):
                        cols = [rows.column("vec_id"), rows.column("embedding"), own, pa.array(np.full(rows.num_rows, curve, np.int32)), pa.array(key)]
                        yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "embedding", "candidate", "curve", "key"])

    kind = points.schema["embedding"].dataType.simpleString()
    keyed = points.mapInArrow(run, f"vec_id long, embedding {kind}, candidate boolean, curve int, key long")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.repartitionByRange(parts, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    keyed = cut(keyed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "ordered")
    # ranks within a partition, and the partitions' own places in every curve (one row a partition and curve)
    runs = keyed.groupBy("curve", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "runs")
    return keyed.join(F.broadcast(runs), ["curve", "part"]).select("vec_id", "embedding", "candidate", "curve", (F.col("at") - F.col("first") + F.col("ahead")).alias("rank"))


def _fit_window(index: DataFrame, points: DataFrame, queries: DataFrame) -> int:
    """The rank distance that holds ``RECALL`` of the probes' exact neighbours."""
    probes = queries.orderBy(F.xxhash64("vec_id", F.lit(SEED))).limit(PROBES).toArrow()
    own, own_ids = _matrix(probes.column("embedding")), probes.column("vec_id").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, r, s = best_of(own, own_ids, _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy(), K)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(r), pa.array(s)], names=["query_id", "vec_id", "score"])

    near = points.where("candidate").select("vec_id", "embedding").mapInArrow(run, _NEAR)
    true = cut(_nearest(near), "probed").select("query_id", "vec_id")
    wanted = true.select("vec_id").union(true.select("query_id")).distinct()  # PROBES * (K + 1) ids at most
    at = index.join(F.broadcast(wanted), "vec_id", "left_semi").select("curve", "vec_id", "candidate", "rank").collect()
    place: dict[tuple[int, bool], dict[int, int]] = {}
    for r in at:
        place.setdefault((r["vec_id"], r["candidate"]), {})[r["curve"]] = r["rank"]
    pairs = [(place[(r["query_id"], False)], place[(r["vec_id"], True)]) for r in true.collect()]
    apart = [min(abs(q[c] - p[c]) for c in p) for q, p in pairs]
    return int(np.quantile(apart, RECALL)) + 1 if apart else 1


def _nearest(found: DataFrame) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def _rerank(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    q, r, s = best_of(_matrix(left.column("query")), left.column("query_id").to_numpy(), _matrix(right.column("embedding")), right.column("vec_id").to_numpy(), K)
    return pa.table({"query_id": q, "vec_id": r, "score": s})


def nearest_neighbours(vectors: DataFrame) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``K`` nearest found of every vector whose
    id is divisible by ``EVERY``."""
    clean = clean_vectors(vectors)
    twins = Window.partitionBy("embedding").orderBy("vec_id")
    few = clean.withColumn("_twin", F.row_number().over(twins)).where(F.col("_twin") <= K + 1).select("vec_id", F.lit(True).alias("candidate"))
    is_query = F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0
    points = clean.join(few, "vec_id", "left").withColumn("candidate", F.coalesce("candidate", F.lit(False))).where(F.col("candidate") | is_query)
    points = cut(points.select("vec_id", "embedding", "candidate"), "points")
    # scale and centre are fitted on vectors drawn by hash from the whole table
    share = int(950_000 * min(1.0, FIT_ROWS / max(points.count(), 1)))
    drawn = points if share >= 950_000 else points.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1_000_000)) < share)
    sample = drawn.select("embedding").limit(FIT_ROWS).toArrow()
    if not sample.num_rows or points.where(is_query).isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    squares = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    radius2 = points.where("candidate").select(F.max(squares)).first()[0] or 0.0
    index = _ranked(points, _keyed(lifted(_matrix(sample.column("embedding")), radius2, False)), radius2)
    window = _fit_window(index, points, points.where(is_query))
    # a block meets the query blocks that have ranks within the window of its own
    reach = lambda rank, size: (F.floor((rank - window) / size), F.floor((rank + window) / size))
    block, query_block = F.floor(F.col("rank") / BLOCK), F.floor(F.col("rank") / QUERY_BLOCK)
    lo, hi = reach(block * BLOCK, QUERY_BLOCK)[0], reach(block * BLOCK + BLOCK - 1, QUERY_BLOCK)[1]
    rows = index.where("candidate").select("curve", block.alias("block"), F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)).alias("query_block"), "vec_id", "embedding")
    lo, hi = reach(F.col("rank"), BLOCK)
    asked = index.where(~F.col("candidate")).select(F.col("curve").alias("q_curve"), F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)).alias("q_block"), query_block.alias("q_query_block"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = asked.groupBy("q_curve", "q_block", "q_query_block").cogroup(rows.groupBy("curve", "block", "query_block")).applyInArrow(_rerank, _NEAR)
    return _nearest(found)
