"""Neighbours, chat perspectives and fingerprints against brute force."""

from __future__ import annotations

import hashlib

import numpy as np

from precis.llm import ann, chat, fingerprints
from precis.llm.hilbert import hilbert_keys

from .conftest import EDGES, SF001


def brute(rows):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = set()
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [k for k in np.lexsort((ids, -s)) if k != i][:20]
        out |= {(int(ids[i]), n + 1, int(ids[k])) for n, k in enumerate(order)}
    return out


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_small_table_is_exact(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    got = ann.nearest_neighbours(spark.read.parquet(f"{SF001}/embeddings.parquet")).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == brute(rows)
    x = dict(rows)
    assert all(abs(r.score - np.dot(np.array(x[r.query_id], float), np.array(x[r.vec_id], float))) < 1e-12 for r in got)


def test_recall_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 256)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 700)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    rows = [(k, (centres[k % 30] + 0.4 * rng.normal(size=16)).tolist()) for k in range(4000)]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {(q, v) for q, _, v in brute(rows)}
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.5, 0.5]), (3, None), (40, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (60, [])]
    rows += [(100 + k, [1.0, 0.0]) for k in range(50)]  # equal vectors: ties go to smaller ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = [r for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == 2 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    fine = [r for r in fine if r != (20, [0.5, 0.5])]  # of one id the smallest vector counts
    assert {(r.query_id, r["rank"], r.vec_id) for r in ann.nearest_neighbours(df).collect()} == brute(fine)
    assert ann.nearest_neighbours(df.limit(0)).count() == 0
    assert ann.nearest_neighbours(df.where("vec_id = 20")).count() == 0


def test_vectors_without_a_query(spark):
    df = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(1, 20)], "vec_id long, embedding array<double>")
    out = ann.nearest_neighbours(df)
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0


def test_chat_matches_sql(spark, con):
    from precis.llm.registry import ORACLE_SQL, op1_chat_perspectives as q

    rows = con.sql(ORACLE_SQL["op1_chat_perspectives"])
    got = q(spark, SF001).select(*rows.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows.fetchall(), key=repr)


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, participant string, block int"
    rows = [(1, 0, "system", "Be kind.", "x", 1), (1, 1, "Ann B", "Hi <|im_end|>", "x", 1), (1, 2, None, None, "x", 1), (1, None, "Ann B", "late", "x", 1), (1, 1, "Ann B", "Hi <|im_end|>", "x", 1),
            (None, 5, "bob", "alone", "x", 1), (2, 1000, "a", "far", "x", 1), (2, -7, "b", "near", "x", 1), (3, 1, "system", "nobody speaks", "x", 1)]
    out = chat.perspectives(spark.createDataFrame(rows, schema)).collect()
    views = {}
    for r in sorted(out, key=lambda r: r.position):
        views.setdefault((r.conv_id, r.participant), []).append(r)
    assert set(views) == {(1, "Ann_B"), (1, "unknown"), (None, "bob"), (2, "a"), (2, "b")}
    for turns in views.values():
        text = "".join(r.segment for r in turns)
        assert [r.position for r in turns] == list(range(1, len(turns) + 1))
        for r in turns:
            assert text[r.segment_start : r.segment_end] == r.segment
            assert (r.mask_start is not None) == (r.role_tag == "assistant")
            if r.mask_start is not None:
                assert text[r.mask_start : r.mask_end].endswith("<|im_end|>") and "im_start" not in text[r.mask_start : r.mask_end]
        assert text.count("<|im_end|>") == len(turns)  # marks in texts are broken
    assert [r.role_tag for r in views[1, "unknown"]] == ["system", "user name=Ann_B", "user name=Ann_B", "assistant", "user name=Ann_B"]
    assert [r.segment_start for r in views[2, "a"]][0] == 0 and views[2, "a"][0].role_tag == "user name=b"
    assert chat.perspectives(spark.createDataFrame([], schema)).count() == 0


def test_fingerprint_edges(spark, edges, empty):
    rows = fingerprints.edit_fingerprints(edges).collect()
    assert len(rows) == len(EDGES)
    prints = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.fingerprint, set()).add((r.doc_id, r.n_chars))
    assert fingerprints.edit_fingerprints(empty).count() == 0
    alone = fingerprints.edit_fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdabcd").hexdigest() and alone.near_next == 1.0


def test_edits_and_order_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edit_fingerprints(docs).collect()}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other = ({tuple(c.split(":")) for c in p.split(",") if c} for p in (r.fingerprint, r.edited_fingerprint))
        weight = sum(int(n) for _, n in own)
        assert abs(r.near_edited - sum(int(n) for _, n in own & other) / weight) < 1e-12
    assert np.mean([r.near_edited for r in got.values()]) > 0.35


def test_borders_shift_with_the_text():
    from precis.llm.arrow_text import WordHasher
    import pyarrow as pa

    text = " ".join(f"w{k * 7919 % 10007}" for k in range(3000))
    a, b = fingerprints.chunk_sets(pa.array([text, "inserted at the front " + text]), WordHasher())
    assert fingerprints.containment(a, b) > 0.95
    sizes = list(a.values())
    assert max(sizes) <= fingerprints.MOST and np.mean(sizes) > fingerprints.NORMAL / 2


def test_window_stays_small_with_unlike_norms(spark, monkeypatch):
    """Inner products are searched as distances: where vectors have structure, a tenth of all
    ranks is window enough also for very unlike lengths."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 3000)] + 0.25 * rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    windows = []
    fit = ann._fit_window
    monkeypatch.setattr(ann, "_fit_window", lambda *a: windows.append(fit(*a)) or windows[-1])
    for norms in (np.ones(3000), rng.lognormal(0, 0.4, 3000)):
        v = x * norms[:, None]
        df = spark.createDataFrame([(k, [float(c) for c in row]) for k, row in enumerate(v)], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.nearest_neighbours(df).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q in range(0, 3000, ann.EVERY):
            scores = v @ v[q]
            scores[q] = -np.inf
            hits += len(got[q] & set(np.argsort(-scores, kind="stable")[: ann.K].tolist()))
        assert hits >= 0.9 * ann.K * len(got)
    assert max(windows) <= 300, windows
