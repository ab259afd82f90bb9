"""The relational plan (windows, aggregates, the greedy ``aggregate``) against
a plain-Python loop over the same sentences and tokens, on the sf0.001
documents."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from conftest import SF001
from precis.config import SummaryConfig
from precis.operators import sentences as S
from precis.plans.summarize import distribute, summarize


def brute(rows_by_doc, n_pick, cap, algorithm):
    picked = {}
    for doc, rows in rows_by_doc.items():
        rows = sorted(rows)[:cap]  # (seq, sentence, terms)
        n = len(rows)
        df = Counter(t for _, _, terms in rows for t in set(terms))
        idf = {t: math.log((n + 1) / (c + 1)) + 1 for t, c in df.items()}
        l2, raw = [], []
        for _, _, terms in rows:
            tf = Counter(terms)
            w = [c * idf[t] for t, c in tf.items()]
            l2.append(round(sum(w) / math.sqrt(sum(x * x for x in w)), 9))
            raw.append(round(sum(c / len(terms) * idf[t] for t, c in tf.items()), 9))
        if algorithm == "default":
            order = sorted(range(n), key=lambda i: (l2[i], i), reverse=True)
            picked[doc] = sorted(order[:n_pick])
            continue
        lo, hi = min(raw), max(raw)
        final = []
        for i, (_, _, terms) in enumerate(rows):
            norm = (raw[i] - lo) / (hi - lo) if hi != lo else 1.0
            k = len(terms)
            final.append(0.5 * norm + 0.3 * (1.0 / (1 + i * 0.05)) + 0.2 * (min(1.0, k / 50) * max(0.1, 1 - k / 100)))
        sel, remaining = [], set(range(n))
        while len(sel) < n_pick and remaining:
            best, best_i = float("-inf"), None
            for i in sorted(remaining):
                sc = final[i]
                for s in sel:
                    if abs(i - s) < 3:
                        sc *= 0.3
                    if abs(len(rows[i][2]) - len(rows[s][2])) < 5:
                        sc *= 0.8
                if sc > best:
                    best, best_i = sc, i
            sel.append(best_i)
            remaining.remove(best_i)
        picked[doc] = sorted(sel)
    return picked


@pytest.mark.parametrize("algorithm,n,factor", [("default", 3, 2.0), ("diverse", 3, 2.0), ("diverse", 5, 1.0)])
def test_matches_python_loop(spark, algorithm, n, factor):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    valid = S.valid_sentences(S.sentences_clean(distribute(docs)))
    by_doc = {}
    for r in valid.collect():
        by_doc.setdefault(r.doc_id, []).append((r.seq, r.sentence, list(r.terms)))
    cap = SummaryConfig(n, factor).cap
    expected = brute(by_doc, n, cap, algorithm)
    got = {}
    for r in summarize(docs, n, factor, algorithm).collect():
        got.setdefault(r.doc_id, []).append(r.idx)
    assert {k: sorted(v) for k, v in got.items()} == expected
