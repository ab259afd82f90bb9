"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: lower-cased letter runs and their
first five letters, so that inflected forms meet. Terms whose presence goes with
the label in the training sample (chi-square test) get a weight and a vector, and so do
terms that go with it among the rows of another one only (the strongest and the most
frequent terms are tried): an insult that counts beside a group mention, and the mention,
which alone means nothing. The score is ``sigmoid(bias + sum w + sum of pairwise products of vectors)``.

Fitting reads at most ``SAMPLE`` labelled rows of the training folds, whose term
ids alone reach the driver. Scoring is one pass without a shuffle. Null and
empty texts score the bias. Without any labelled row every score is 0.5;
with one class only it is that class's prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .labelled import fold, labels_of, sampled

#: Labelled rows read for fitting, at most.
SAMPLE = 12_000
#: Term ids are hashes modulo this.
SPACE = 1 << 22
#: Terms seen in fewer sampled rows, or with a smaller chi-square, get no weight.
MIN_ROWS = 4
MIN_CHI2 = 15.0
#: Terms tried as partners (strongest, and most frequent), and the chi-square that a term
#: needs among the rows of one of them.
PARTNERS = 64
PAIR_CHI2 = 30.0
FACTORS = 8
STEPS = 250
SEED = 11
PREFIX = 5
FOLDS = 5
HELD_OUT = 0

_U = np.uint64
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def term_slices(column, hasher: A.WordHasher):
    """Per slice ``(first_row, term ids, first)``; repeats included."""
    for at, data, offsets in A.slices(column):
        data = A.lower_ascii(data)
        starts, ends, first = A.word_bounds(data, offsets, ~_LETTER)
        words = hasher(data, starts, ends)
        heads = hasher(data, starts, np.minimum(ends, starts + PREFIX)) + _U(1)
        both = np.empty(2 * len(words), np.uint64)
        both[0::2], both[1::2] = words, A.mix64(heads)
        yield at, (both % _U(SPACE)).astype(np.int64), 2 * first


def _distinct_terms(batches):
    hasher = A.WordHasher()
    for batch in batches:
        for at, terms, first in term_slices(batch.column("text"), hasher):
            n = len(first) - 1
            lists = pa.array([np.unique(terms[first[d] : first[d + 1]]).astype(np.int32) for d in range(n)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(at, n), lists], names=["label", "terms"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class FactorizationMachine:
    """Bias, weights and factor vectors of the chosen terms."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray) -> None:
        self.terms, self.bias, self.weights, self.vectors = terms, bias, weights, vectors

    def score(self, doc: np.ndarray, term: np.ndarray, n_docs: int) -> np.ndarray:
        """Scores from distinct ``(doc, index of a chosen term)`` rows."""
        z = self.bias + np.bincount(doc, self.weights[term], n_docs)
        for k in range(self.vectors.shape[1]):
            v = self.vectors[term, k]
            z = z + 0.5 * (np.bincount(doc, v, n_docs) ** 2 - np.bincount(doc, v * v, n_docs))
        return _sigmoid(z)


def _chi2(seen: np.ndarray, hits: np.ndarray, n: float, positive: float) -> np.ndarray:
    """Chi-square of a term's presence and the label; ``hits`` of its ``seen`` rows are positive."""
    spread = seen * (n - seen) * positive * (n - positive)
    return np.divide(n * (hits * n - seen * positive) ** 2, spread, out=np.zeros(len(seen)), where=spread > 0)


def choose_terms(labels: np.ndarray, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Ids of the terms that go with the label, alone or among the rows of a partner."""
    ids, at = np.unique(term, return_inverse=True)
    seen = np.bincount(at, minlength=len(ids)).astype(float)
    often = np.flatnonzero(seen >= MIN_ROWS)
    slot = np.full(len(ids), -1, np.int64)
    slot[often] = np.arange(len(often))
    keep = slot[at] >= 0
    ids, doc, at, m = ids[often], doc[keep], slot[at[keep]], len(often)
    y = labels[doc].astype(float)
    seen = np.bincount(at, minlength=m).astype(float)
    alone = _chi2(seen, np.bincount(at, y, m), len(labels), float(labels.sum()))
    good = alone >= MIN_CHI2
    strongest, frequent = np.argsort(-alone, kind="stable")[:PARTNERS], np.argsort(-seen, kind="stable")[:PARTNERS]
    for partner in np.union1d(strongest, frequent):
        rows = np.zeros(len(labels), bool)
        rows[doc[at == partner]] = True
        there = rows[doc]
        pair = np.bincount(at[there], minlength=m).astype(float)
        chi2 = _chi2(pair, np.bincount(at[there], y[there], m), float(rows.sum()), float(labels[rows].sum()))
        found = (pair >= MIN_ROWS) & (chi2 >= PAIR_CHI2)
        good |= found
        good[partner] |= found.any()
    return ids[good]


def fit(labels: np.ndarray, doc: np.ndarray, term: np.ndarray) -> FactorizationMachine:
    """Fit to sampled rows: ``labels`` a row, and distinct ``(doc, term id)`` rows."""
    n, positive = len(labels), float(labels.sum())
    prior = min(max(positive / n, 1e-3), 1 - 1e-3) if n else 0.5
    bias = float(np.log(prior / (1 - prior)))
    chosen = choose_terms(labels, doc, term)
    place = np.full(SPACE, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    keep = place[term] >= 0
    doc, term = doc[keep], place[term[keep]]
    rng = np.random.default_rng(SEED)
    machine = FactorizationMachine(chosen, bias, np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), FACTORS)))
    if not len(chosen):
        return machine
    params = [np.array([bias]), machine.weights, machine.vectors]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        machine.bias = float(params[0][0])
        wrong = machine.score(doc, term, n) - labels
        own = wrong[doc]
        sums = np.stack([np.bincount(doc, machine.vectors[term, k], n) for k in range(FACTORS)], axis=1)
        slopes = [np.array([wrong.sum()]) / n, np.bincount(term, own, len(chosen)) / n + 1e-5 * machine.weights, np.empty_like(machine.vectors)]
        for k in range(FACTORS):
            slopes[2][:, k] = np.bincount(term, own * (sums[doc, k] - machine.vectors[term, k]), len(chosen)) / n + 1e-4 * machine.vectors[:, k]
        for p, g, (m, v) in zip(params, slopes, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    machine.bias = float(params[0][0])
    return machine


def train(docs: DataFrame, labels: DataFrame, name: str = "toxic") -> FactorizationMachine:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    rows = labels_of(labels, name).where(fold("doc_id", FOLDS) != HELD_OUT)
    rows = F.broadcast(sampled(rows, SAMPLE, SEED))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(rows, "doc_id")
    got = texts.select("label", "text").mapInArrow(_distinct_terms, "label int, terms array<int>").limit(4 * SAMPLE).toArrow()
    y = got.column("label").to_numpy().astype(float)
    lists = got.column("terms").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    term = lists.values.to_numpy()[lists.offsets.to_numpy()[0] :].astype(np.int64)
    order = np.repeat(np.arange(len(y)), sizes)
    return fit(y, order, term[: len(order)])


def score_documents(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``."""

    def run(batches):
        hasher, place = A.WordHasher(), np.full(SPACE, -1, np.int64)
        place[machine.terms] = np.arange(len(machine.terms))
        for batch in batches:
            for at, terms, first in term_slices(batch.column("text"), hasher):
                n = len(first) - 1
                index = place[terms]
                hit = np.flatnonzero(index >= 0)
                doc = np.searchsorted(first, hit, side="right") - 1
                pairs = np.unique(doc * (len(machine.terms) + 1) + index[hit])
                scores = machine.score(pairs // (len(machine.terms) + 1), pairs % (len(machine.terms) + 1), n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.array(scores)], names=["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels.toxic`` and score every document."""
    return score_documents(docs, train(docs, labels))
