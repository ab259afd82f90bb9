"""Learned sentence boundaries: likelihoods against plain Python, and planted abbreviations."""

from __future__ import annotations

import math
import random

import pytest

from precis.operators import boundaries as B
from precis.operators import sentences as S

NOUNS = "harbour ladder window garden engine bottle market river stone candle bridge basket".split()
VERBS = "carries follows covers leaves finds holds paints turns".split()
PLANTED = ["Hptm", "approx", "Abb", "gen", "bzw", "cf", "a.d", "Nr"]


def corpus(n=1500, seed=3):
    """Documents of known sentences; planted abbreviations stand before names and numbers."""
    rng = random.Random(seed)
    noun, verb = lambda: rng.choice(NOUNS), lambda: rng.choice(VERBS)
    docs = []
    for k in range(n):
        out = []
        for _ in range(rng.randrange(2, 6)):
            middle = [f"the {noun()}", f"every {noun()}", f"{rng.choice(PLANTED)}. {rng.choice(['Weber', 'Lopez', 'Harlan'])}", f"{rng.choice(PLANTED)}. {rng.randrange(90)}", f"J. {rng.choice(['Weber', 'Lopez'])}"]
            words = f"{rng.choice(['The', 'Every', 'This'])} {noun()} {verb()} {rng.choice(middle)} near {rng.choice(middle)} and {verb()} a {noun()}"
            out.append(words + rng.choice([".", ".", ".", "!", "?"]))
        docs.append((k, out))
    return docs


@pytest.fixture(scope="module")
def planted():
    return corpus()


@pytest.fixture(scope="module")
def frame(spark, planted):
    return spark.createDataFrame([(k, " ".join(s)) for k, s in planted], "doc_id long, text string").cache()


def errors(split, planted):
    """Boundaries missed or made, over all documents."""
    got: dict[int, list[str]] = {}
    for r in split.orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    wrong = 0
    for k, want in planted:
        ends = lambda parts: {sum(len(p) + 1 for p in parts[: i + 1]) for i in range(len(parts))}
        wrong += len(ends(want) ^ ends(got.get(k, [])))
    return wrong


def test_planted_abbreviations_beat_the_fixed_list(frame, planted):
    fixed, learned = errors(S.sentences_clean(frame), planted), errors(B.sentences_trained(frame), planted)
    assert fixed > 1000 and learned <= fixed / 20


def test_types_and_scores_match_plain_python(frame, planted):
    rows = {r.type: r for r in B.with_abbreviation_score(B.type_counts(B.words(frame))).collect()}
    plain, period = {}, {}
    for _, sentences in planted:
        for w in " ".join(sentences).split(" "):
            t = w.removesuffix(".").lower()
            t = "##" if t.isdigit() else t
            into = period if w.endswith(".") else plain
            into[t] = into.get(t, 0) + 1
    assert {t: (r.n_plain, r.n_period) for t, r in rows.items()} == {t: (plain.get(t, 0), period.get(t, 0)) for t in plain.keys() | period.keys()}
    p0 = sum(period.values()) / (sum(plain.values()) + sum(period.values()))
    for t, r in rows.items():
        a, b = period.get(t, 0), plain.get(t, 0)
        inner = t.count(".")
        letters = len(t) - inner
        want = 0.0
        if a and t != "##":
            ratio = 2 * (a * math.log(0.99) + b * math.log(0.01) - a * math.log(p0) - b * math.log(1 - p0))
            want = ratio * math.exp(-letters) * (inner + 1) * letters ** -float(b)
        assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-9)
    assert {p.lower() for p in PLANTED} - {"approx"} <= {t for t, r in rows.items() if r.score >= 0.3}


def test_a_model_is_learned_once_and_used_elsewhere(spark, frame):
    model = B.learn(frame)
    other = spark.createDataFrame([(1, "We met Hptm. Weber at noon near the harbour. The boat left early today."), (2, "Numbers like 3. are odd here, she said. Then it rained all day long...")], "doc_id long, text string")
    got = [(r.doc_id, r.sentence) for r in B.sentences_trained(other, model).orderBy("doc_id", "seq").collect()]
    assert got[:2] == [(1, "We met Hptm. Weber at noon near the harbour."), (1, "The boat left early today.")]
    assert got[2][1].startswith("Numbers like 3. are odd here")


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " . . . "), (4, "no end at all here"), (4, "a second text with this id. It has two sentences here."), (None, "One lone sentence here. Another lone sentence here."), (5, "." * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.sentence) for r in B.sentences_trained(df).collect()]
    assert (4, "no end at all here") in got or any(i == 4 for i, _ in got)
    assert {i for i, _ in got} <= {4, None} and B.sentences_trained(df.limit(0)).count() == 0


def test_long_pieces_are_split_again(spark):
    text = "A sentence with cf. Weber " + "and more words " * 20 + "that ends here. Short tail sentence here."
    got = [r.sentence for r in B.sentences_trained(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("seq").collect()]
    assert all(len(s) >= 10 for s in got) and " ".join(got) == text


def test_counts_meet_quotes_and_starts_and_read_texts_once(spark, tmp_path):
    rows = [(1, '"Stop!" ("He) left cf. Weber \'\' today.'), (1, "He left cf. weber"), (None, "'Cf.' Weber He ... left"), (3, ""), (4, None)]
    path = str(tmp_path / "texts")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    types = B.type_counts(B.words(spark.read.parquet(path)))
    got = {r.type: tuple(r)[1:] for r in types.collect()}
    # (plain, period, lower, capitalised after a word that ends nothing)
    assert got == {"stop!": (1, 0, 0, 0), "he": (3, 0, 0, 1), "left": (3, 0, 3, 0), "cf": (0, 3, 2, 0), "weber": (3, 0, 1, 0), "today": (0, 1, 1, 0)}
    none = spark.createDataFrame([], "type string")
    after = {(r.prev_type, r.type, r.sure): r.n for r in B.after_ends(B.words(spark.read.parquet(path)), none).collect()}
    assert after == {("stop!", "he", True): 1, ("cf", "weber", True): 3}
    scored = B.with_abbreviation_score(types)
    scored.collect()
    final = scored._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Scan parquet") == 1
