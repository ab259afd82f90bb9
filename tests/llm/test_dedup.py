"""Near-duplicates, components and line chunks against brute force."""

from __future__ import annotations

import random
import re
import string

from pyspark.sql import functions as F

from precis.llm import line_dedup, minmax_dedup
from precis.llm.graph import connected_components
from precis.llm.tables import sieve

from .conftest import BASE, EDGES, SF001

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def components(rows):
    """Brute force: the smallest id reachable over links, per row."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return [(i, len(s), low.get(g)) for (i, _), s, g in zip(rows, sets, group, strict=True)]


def test_edge_rows_match_brute_force(edges):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(edges).collect()]
    want = [(i, n, c, i == c) for i, n, c in components(EDGES)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(empty):
    assert minmax_dedup.near_duplicates(empty).count() == 0
    assert minmax_dedup.drop_near_duplicates(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_families_match_brute_force(spark):
    """Families of edited, cut and extended copies around the threshold, larger than
    what a bucket compares directly."""
    rng = random.Random(3)
    rows = []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(120)]
        for _ in range(60):
            words = [w if rng.random() > 0.02 * rng.random() else f"e{rng.randrange(10**6)}" for w in base]
            words = words[: rng.choice([120, 120, 95, 88])] + [f"t{rng.randrange(50)}" for _ in range(rng.choice([0, 0, 9]))]
            rows.append((len(rows), " ".join(words)))
    got = minmax_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == set(components(rows))


def test_unlinked_member_meets_a_linked_one(spark):
    """One bucket around a centre ``a``: ``z`` links to it, ``y`` only to ``z``, with
    more shingles than any unlinked member has room for."""
    import numpy as np

    z = list(range(1, 101))
    a, y = [*z, 201, 202, 203], [*z, *range(301, 334)]
    sets = {k: list(range(1000 * k, 1000 * k + 5)) for k in range(1, 19)} | {30: z, 31: y, 99: a}
    members = spark.createDataFrame([("b", k) for k in sets], "bucket string, node long")
    own = spark.createDataFrame([(k, bytearray(np.array(s, np.uint64).tobytes())) for k, s in sets.items()], "node long, own binary")
    roots = {r.node: r.root for r in minmax_dedup._closed(members, own).collect()}
    assert roots == {30: 30, 31: 30, 99: 30}


def test_few_pairs_are_compared_in_a_family_that_links_in_part(spark, monkeypatch):
    """Copies with edits of their own, few or many: most pairs do not link, yet each copy
    meets only few others."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 4, 5, 6])):
            words[at] = f"e{k}x{at}"
        rows.append((k, " ".join(words)))
    compared, verified = [], minmax_dedup._verified

    def counted(pairs, sets):
        compared.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(minmax_dedup, "_verified", counted)
    got = minmax_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == set(components(rows))
    assert sum(compared) <= 1_500, compared  # of 11,175


def test_copies_without_some_lines_make_few_rows(spark, monkeypatch):
    """Copies that lack lines of their own: a line's shingles count as one where the same
    copies hold them, and a pair needs to be seen only where it meets first."""
    rng = random.Random(11)
    lines = [" ".join(f"l{k}w{j}" for j in range(9)) for k in range(40)]
    rows = [(c, "\n".join(x for x in lines if rng.random() > 0.05 + 0.005 * c)) for c in range(60)]
    made, cut = {}, minmax_dedup.cut

    def counted(df, name="part", *args, **kwargs):
        out = cut(df, name, *args, **kwargs)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minmax_dedup, "cut", counted)
    got = minmax_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == set(components(rows))
    assert 1 < len({r.component_id for r in got}) < len(rows)
    assert made["front"] <= 8_000 and made["buckets"] <= 6_000, made  # 29,887 and 8,612 with a row a shingle


def test_kept_documents(edges):
    out = minmax_dedup.drop_near_duplicates(edges)
    assert out.columns == edges.columns
    ids = sorted([r.doc_id for r in out.collect()], key=str)
    # 2 and 3 follow 1, 8 follows 7, 10 follows 9; rows without an id stay
    assert ids == sorted([1, 4, 5, 6, 7, 9, None, None, 11, 11], key=str)


def test_an_id_on_two_texts_loses_only_the_near_duplicate(spark):
    one, two = BASE, " ".join(f"own{k}" for k in range(60))
    rows = [(1, one), (5, one.replace("term30", "other")), (5, two), (7, two), (8, two.replace("own59", "end"))]
    out = minmax_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == sorted([rows[0], rows[2]])


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 201)], "a long, b long")
    got = {r.node: r.root for r in connected_components(path).collect()}
    assert got == {k: 0 for k in range(101)} | {200: 200, 201: 200}


def test_sieve_never_loses_a_key(spark):
    df = spark.range(20_000)
    keys = df.where("id % 7 = 0").select(F.xxhash64("id"))
    out = sieve(df, F.xxhash64("id"), keys, "hit").where("hit")
    assert out.where("id % 7 = 0").count() == 2858 and out.count() < 3_000


PASSAGE = [" ".join(f"p{k}q{j}" for j in range(60)) for k in range(2)]
SHORT = [f"short line {k} here" for k in range(40)]


def test_repeated_chunks_go_after_the_first_place(spark):
    docs = [(1, "\n".join(["only one", PASSAGE[0], *SHORT])), (2, "\n".join(["another", PASSAGE[0], "more", *SHORT, "end"])), (3, PASSAGE[0] + "\n" + PASSAGE[1]), (4, "unique text\nof two lines")]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[1] == docs[0][1] and out[4] == docs[3][1]  # first places and unique texts stay
    assert PASSAGE[0] not in out[2] and out[2].startswith("another") and out[2].endswith("end")
    assert sum(line in out[2] for line in SHORT) <= 10  # all but what touches the run's ends
    assert out[3] == PASSAGE[1]


def test_line_edges(edges):
    out = line_dedup.dedup_lines(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    rows = out.collect()
    assert sum(r.text is None for r in rows) == 2
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.text)
    # of equal long lines the first place is the null id's; equal rows share their fate
    assert by[3] == ["", ""] and by[1] == [""] and BASE in by[None]
    assert by[9][0] and by[10] == [""] and by[7] == ["one two"]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_line_dedup_matches_sql(spark, con):
    from precis.llm.registry import ORACLE_SQL, op5_content_defined_line_dedup as q

    got = sorted(map(tuple, q(spark, SF001).select("doc_id", "text", "n_removed").collect()))
    assert got == sorted(con.sql(ORACLE_SQL["op5_content_defined_line_dedup"]).fetchall())
    assert sum(r[2] for r in got) > 0


def test_bytes_decide_where_digests_collide(spark, con, monkeypatch):
    """With three digests for all chunks the result is the same."""
    monkeypatch.setattr(line_dedup, "_digest", lambda chunk: (F.length(chunk) % 3).cast("long"))
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(docs, report=True).collect() if r.doc_id is not None)
    rel = con.sql(line_dedup.ORACLE_SQL)
    at = [rel.columns.index(c) for c in ("doc_id", "text", "n_removed")]
    assert got == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
