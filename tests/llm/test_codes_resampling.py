"""Vector codes and importance resampling against plain Python, and against SQL."""

from __future__ import annotations

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pytest

from precis.llm import registry, resampling, vector_codes

from .conftest import EDGES, SF001

E = 4  # entries of small codebooks


# --- vector codes ---------------------------------------------------------------------------
def brute_codes(rows, entries):
    """``{row number: (code, error, label_error)}`` and the books, in plain Python."""
    kept = [(i is None, i or 0, [max(-vector_codes.LIMIT, min(vector_codes.LIMIT, math.floor(256 * x))) for x in v], lab, at)
            for at, (i, v, lab) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(16, -(-max((len(k[2]) for k in kept), default=0) // 16) * 16)
    kept = [(a, b, v + [0] * (dims - len(v)), lab, at) for a, b, v, lab, at in kept]
    w = dims // 16
    parts = lambda v: [v[p * w : (p + 1) * w] for p in range(16)]
    books = [parts(v) for *_, v in sorted(k[:3] for k in kept)[:entries]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v, p: min((dist(v, e[p]), k) for k, e in enumerate(books))
    for _ in range(2):
        near = [[assign(v, p)[1] for p, v in enumerate(parts(k[2]))] for k in kept]
        new = [[list(x) for x in e] for e in books]
        for e in range(len(books)):
            for p in range(16):
                mine = [parts(k[2])[p] for k, n in zip(kept, near, strict=True) if n[p] == e]
                if mine:
                    new[e][p] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        books = new
    out = {}
    for *_, v, lab, at in kept:
        found = [assign(x, p) for p, x in enumerate(parts(v))]
        out[at] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab)
    label = {}
    for _, err, lab in out.values():
        label[lab] = label.get(lab, 0) + err
    text = ",".join(str(x) for p in range(16) for e in books for x in e[p])
    return sorted((rows[at][0] if rows[at][0] is not None else -99, code, err, label[lab]) for at, (code, err, lab) in out.items()), hashlib.sha256(text.encode()).hexdigest()


def vectors():
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 32)], int(k % 3)) for k in range(60)]
    rows += [(70 + k, [float(np.float32(v)) for v in rng.choice([-0.01, 0.0, 0.25], 32)], 1) for k in range(30)]  # ties and repeated parts
    rows += [(200, None, 1), (201, [float("nan")] * 32, 1), (202, [0.5] * 31 + [float("inf")], 1), (203, [None] + [0.1] * 31, 1)]
    rows += [(3, rows[3][1], 0), (3, rows[4][1], None), (None, rows[5][1], None), (204, [0.5, -0.5], None), (205, [], 2), (206, [1e30] * 32, 2), (207, [-1e-9] * 17, 2)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, _label string, code int"


@pytest.mark.parametrize("block", [7, 4096])
def test_codes_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "ENTRIES", E)
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    out = vector_codes.vector_codes(df).collect()
    want, sha = brute_codes(rows, E)
    assert sorted((r.vec_id if r.vec_id is not None else -99, r.code, r.error, r.label_error) for r in out) == want
    assert {r.codebooks_sha256 for r in out} == {sha}


def test_many_labels_meet_salted_rows(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors()], SCHEMA)
    few = sorted(map(str, vector_codes.vector_codes(df).collect()))
    monkeypatch.setattr(vector_codes, "LABELS", 0)
    assert sorted(map(str, vector_codes.vector_codes(df).collect())) == few


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors()], SCHEMA)
    assert vector_codes.vector_codes(df.limit(0)).count() == 0
    assert vector_codes.vector_codes(df.where("vec_id between 200 and 203")).count() == 0
    one = vector_codes.vector_codes(df.where("vec_id = 7")).collect()
    assert [(r.code, r.error) for r in one] == [("00" * 16, 0)]


# --- importance resampling --------------------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text, max_n):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


TEXTS = ["", "one", "Two  words", "a-b_c.d/e\t0\n9", "été ÉTÉ 😀😀 naïve x", "x" * 5000 + " y " + "z" * 70_000, " ".join(f"w{i % 91}" for i in range(3000)), "\x00 \x7f ` { @ :"]


@pytest.mark.parametrize("piece", [5, 1 << 20])
@pytest.mark.parametrize("max_n", [1, 3])
def test_crc_of_every_ngram(monkeypatch, piece, max_n):
    monkeypatch.setattr(resampling, "PIECE", piece)
    for text in TEXTS:
        got = resampling.ngram_crcs(resampling.prefix_crcs(text.encode()), max_n)
        assert got.tolist() == [crc32(g.encode()) for g in grams(text, max_n)[1]]


def brute_resample(docs, target, max_n, buckets, percent, min_words, seed):
    spread = lambda text: [crc32(g.encode()) % buckets for g in grams(text, max_n)[1]]
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in spread(text):
            s[b] += 1
    for text in target:
        for b in spread(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        own = spread(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(grams(text, 1)[0]) >= min_words])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in rows)))


@pytest.mark.parametrize("max_n,percent,min_words", [(1, 50, 2), (2, 100, 0)])
def test_draw_matches_brute_force(spark, edges, max_n, percent, min_words):
    docs = [(i, t) for i, t in EDGES] + [(100 + k, t) for k, t in enumerate(TEXTS)]
    df = edges.select("doc_id", "text", "_row0").unionByName(spark.createDataFrame([(100 + k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, _row0 string"))
    target = [None, "", "one two", "term1 term2 été"]
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    out = resampling.importance_resample(df.repartition(3), aim, max_n, 997, percent, min_words, seed=7).collect()
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in out) == brute_resample(docs, target, max_n, 997, percent, min_words, 7)


def test_draw_edges(spark, edges, empty):
    aim = spark.createDataFrame([(1, "term1")], "item_id long, text string")
    assert resampling.importance_resample(empty, aim).count() == 0
    assert resampling.importance_resample(edges, aim.limit(0)).count() == len(EDGES)
    drawn = resampling.resampled_documents(edges, aim, percent=40)
    assert drawn.columns == edges.columns and 0 < drawn.count() < len(EDGES)


@pytest.mark.parametrize("key", ["op11_vector_codes", "op13_importance_resampling"])
def test_new_queries_match_sql(spark, con, key):
    df = registry.QUERIES[key](spark, SF001)
    rel = con.sql(registry.ORACLE_SQL[key])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    assert got == sorted(str(tuple(r[rel.columns.index(c)] for c in cols)) for r in rel.fetchall())
