"""Text quality by positive-unlabelled learning.

The fit uses trusted positives (rows labelled 1), unlabelled web text (any
documents outside the held-out fold) and an estimated class prior, and
minimises the non-negative unbiased risk ``prior * R_P(+) + max(0, R_U(-) -
prior * R_P(-))`` with the bounded sigmoid loss. When the bracket turns negative, the step
goes against it, which keeps the model from fitting the unlabelled rows by heart.
The prior is estimated from positives and unlabelled rows alone (best bin estimation):
above a score where nearly only positives stand, the unlabelled rows' share is the prior
times the positives' share, so the lower envelope of that ratio over held-back positives
gives it. Rows labelled 0 are not read.

Features are shares of character and word kinds over the whole text, each cut
into bins at the quantiles of the unlabelled sample. Fitting reads at most
``SAMPLE`` rows of either kind; scoring is one pass without a shuffle. Null and
empty texts get the score of an all-zero measure. Without positives every score
is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .labelled import drawn, fold, labels_of, sampled
from .tables import packed, unpacked

#: Positive and unlabelled rows read for fitting, at most so many of each.
SAMPLE = 12_000
BINS = 12
STEPS = 600
SEED = 23
FOLDS = 3
HELD_OUT = 1

# Byte kinds: lower, upper, digit, white space, sentence marks, other ASCII marks, non-ASCII.
_KIND = np.full(256, 5, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 6
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 3
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 4
MEASURES = ("upper", "digit", "space", "marks", "symbols", "exclaim", "other", "word_length", "long_words", "repeats", "variety", "words")


def measure(data: np.ndarray, offsets: np.ndarray, hasher: A.WordHasher) -> np.ndarray:
    """One row of ``MEASURES`` a document."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    doc = offsets[:-1]
    full = np.flatnonzero(np.diff(offsets) > 0)

    def share(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(full):
            out[full] = np.add.reduceat(flags, doc[full], dtype=np.int64) / size[full]
        return out

    kind = _KIND[data]
    starts, ends, first = A.word_bounds(data, offsets)
    words = hasher(data, starts, ends)
    count = np.diff(first)
    of = np.repeat(np.arange(n), count)
    least = np.maximum(count, 1)
    length = ends - starts
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((words, of))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order], fresh, n)
    return np.stack(
        [
            *(share(kind == k) for k in (1, 2, 3, 4, 5)),
            share(data == 33),
            share(kind == 6),
            np.bincount(of, length, n) / least,
            np.bincount(of, length > 15, n) / least,
            np.bincount(of, same, n) / least,
            np.log1p(distinct) / np.log1p(least),
            np.log1p(count),
        ],
        axis=1,
    )


def _measured(batches):
    hasher = A.WordHasher()
    for batch in batches:
        for _, data, offsets in A.slices(batch.column("text"), A.SMALL_SLICE):
            x = measure(data, offsets, hasher)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64()))], names=["x"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class BinnedModel:
    """Additive model: one weight a bin of every measure."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.edges, self.weights, self.bias = edges, weights, bias

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, edges in enumerate(self.edges):
            z = z + self.weights[j, np.searchsorted(edges, x[:, j], side="right")]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> BinnedModel:
    """Minimise the non-negative risk with the sigmoid loss (Adam, full batch)."""
    wide = unlabelled.shape[1] if len(unlabelled) else len(MEASURES)
    if not len(positive) or not len(unlabelled):
        return BinnedModel(np.zeros((wide, 1)), np.zeros((wide, 2)), 0.0)
    # the rare tails matter most: quantiles at both ends and in between
    levels = np.unique(np.concatenate((np.linspace(0.05, 0.95, BINS - 5), [0.005, 0.02, 0.98, 0.995])))
    edges = np.quantile(unlabelled, levels, axis=0).T
    bins = len(levels) + 1
    slot = [np.searchsorted(edges[j], np.concatenate((positive[:, j], unlabelled[:, j])), side="right") + j * bins for j in range(wide)]
    slot = np.stack(slot, axis=1)
    n_p, n_u = len(positive), len(unlabelled)
    theta, m, v = np.zeros(wide * bins + 1), np.zeros(wide * bins + 1), np.zeros(wide * bins + 1)
    theta[-1] = 0.5
    for step in range(1, STEPS + 1):
        z = theta[slot].sum(axis=1) + theta[-1]
        p = _sigmoid(z)
        negative = p[n_p:].mean() - prior * p[:n_p].mean()
        # slopes of the three risks by margin
        steep = p * (1 - p)
        plus = np.concatenate((-prior * steep[:n_p] / n_p, np.zeros(n_u)))
        minus = np.concatenate((-prior * steep[:n_p] / n_p, steep[n_p:] / n_u))
        by_row = plus + minus if negative >= 0 else -minus
        g = np.append(np.bincount(slot.ravel(), np.repeat(by_row, wide), wide * bins), by_row.sum())
        g[:-1] += 1e-5 * theta[:-1]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return BinnedModel(edges, theta[:-1].reshape(wide, bins), float(theta[-1]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled rows. Half of the positives fit a first
    model; over the scores of the others the ratio of the two shares above a threshold is
    least where its upper confidence bound is."""
    if len(positive) < 2 or not len(unlabelled):
        return 0.5
    first = fit(positive[::2], unlabelled, 0.5)
    held, rest = np.sort(first.margin(positive[1::2])), np.sort(first.margin(unlabelled))
    at = np.unique(held)
    share_p = 1 - np.searchsorted(held, at) / len(held)
    share_u = 1 - np.searchsorted(rest, at) / len(rest)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(held)) + 1 / np.sqrt(len(rest)))
    best = np.argmin((share_u + slack) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _matrix(rows: DataFrame) -> np.ndarray:
    got = rows.select("text").mapInArrow(_measured, "x array<double>").limit(4 * SAMPLE).toArrow().column("x").combine_chunks()
    return got.values.to_numpy().reshape(-1, len(MEASURES)) if len(got) else np.zeros((0, len(MEASURES)))


def train(docs: DataFrame, labels: DataFrame, name: str = "quality") -> BinnedModel:
    """Fit on bounded samples outside the held-out fold."""
    texts = _texts(docs)
    marks = labels_of(labels, name).where(fold("doc_id", FOLDS) != HELD_OUT)
    trusted = F.broadcast(sampled(marks.where("label = 1"), SAMPLE, SEED))
    web = drawn(texts.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull()), SAMPLE, SEED + 1)
    positive, unlabelled = _matrix(texts.join(trusted, "doc_id")), _matrix(web)
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def scores(docs: DataFrame, model: BinnedModel) -> DataFrame:
    """``docs`` with a ``score`` column alone added to its ``doc_id``."""

    def run(batches):
        hasher = A.WordHasher()
        for batch in batches:
            for at, data, offsets in A.slices(batch.column("text"), A.SMALL_SLICE):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), pa.array(model.score(measure(data, offsets, hasher)))], names=["doc_id", "score"]
                )

    return _texts(docs).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``."""
    scored = scores(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they are."""
    model = train(docs, labels)

    def run(batches):
        hasher = A.WordHasher()
        for batch in batches:
            marks = [model.score(measure(data, offsets, hasher)) >= 0.5 for _, data, offsets in A.slices(batch.column("text"), A.SMALL_SLICE)]
            yield batch.filter(pa.array(np.concatenate(marks))) if marks else batch

    kept = packed(docs.withColumn("text", F.col("text").cast("string")), "text")
    return kept.mapInArrow(run, kept.schema).select(*unpacked(docs.columns))
