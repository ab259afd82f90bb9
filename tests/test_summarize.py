"""Summaries: golden values, picks, ties, rejections, parameters, cap."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import GARDEN, HARBOUR, SF001
from precis.config import SummaryConfig, termination_cap
from precis.operators import scoring
from precis.operators import sentences as S
from precis.plans.summarize import rejected_documents, scored_sentences, summarize, summary_records, summary_status

# Golden values (hand-computed from the formulas), 6 decimals.
GOLD = {
    1: [  # GARDEN
        (12, 3.447803, 1.963457, 0.475573),
        (10, 3.145770, 1.936426, 0.381714),
        (12, 3.450794, 1.997246, 0.539967),
        (11, 3.316625, 2.098612, 0.800030),
        (11, 3.298332, 1.914310, 0.289160),
    ],
    2: [  # HARBOUR
        (12, 3.445663, 1.929668, 0.342240),
        (12, 3.464102, 2.098612, 0.827954),
        (12, 3.464102, 2.098612, 0.814967),
        (16, 3.987811, 2.022588, 0.589630),
        (15, 3.864213, 2.044550, 0.641000),
    ],
}


@pytest.fixture
def fixture_docs(docs_df):
    return docs_df({1: " ".join(GARDEN), 2: " ".join(HARBOUR)})


def picks(df):
    out = {}
    for r in df.orderBy("doc_id", "idx").collect():
        out.setdefault(r.doc_id, []).append(r.idx)
    return out


def test_golden_scores(fixture_docs):
    s = scoring.blended_scores(scored_sentences(fixture_docs, SummaryConfig()))
    rows = s.orderBy("doc_id", "idx").collect()
    for r in rows:
        n_words, l2, raw, blended = GOLD[r.doc_id][r.idx]
        assert r.n_words == n_words
        assert r.score_l2 == pytest.approx(l2, abs=1e-6)
        assert r.score_raw == pytest.approx(raw, abs=1e-6)
        assert r.score == pytest.approx(blended, abs=1e-6)
        assert 0.0 <= r.score <= 1.0


@pytest.mark.parametrize(
    "algorithm,n,expected",
    [
        ("default", 1, {1: [2], 2: [3]}),
        ("default", 2, {1: [0, 2], 2: [3, 4]}),
        ("default", 3, {1: [0, 2, 3], 2: [2, 3, 4]}),  # HARBOUR 1 and 2 tie: the later index wins
        ("diverse", 1, {1: [3], 2: [1]}),
        ("diverse", 2, {1: [0, 3], 2: [1, 4]}),  # GARDEN 2 is higher than 0 but near 3
        ("diverse", 3, {1: [0, 3, 4], 2: [0, 1, 4]}),
        ("default", 10, {1: [0, 1, 2, 3, 4], 2: [0, 1, 2, 3, 4]}),  # N >= n returns all
        ("diverse", 10, {1: [0, 1, 2, 3, 4], 2: [0, 1, 2, 3, 4]}),
    ],
)
def test_picks(fixture_docs, algorithm, n, expected):
    assert picks(summarize(fixture_docs, n, algorithm=algorithm)) == expected


def test_summary_records_in_reading_order(fixture_docs):
    rec = summary_records(summarize(fixture_docs, 2), "default", "clean").orderBy("doc_id").collect()
    assert rec[0].summary == [GARDEN[0], GARDEN[2]]
    assert rec[1].summary == [HARBOUR[3], HARBOUR[4]]
    assert (rec[0].method, rec[0].processor) == ("default", "clean")


@pytest.mark.parametrize(
    "text",
    [
        "Short.",
        "This is not enough words.",
        "This is a properly formatted sentence with good structure and meaning. " * 15,
        "",
        "   \n  ",
    ],
)
def test_rejections(docs_df, text):
    docs = docs_df({7: text})
    assert summarize(docs).count() == 0
    st = summary_status(docs).first()
    assert (st.status, st.n_valid) == ("no_valid_sentences", 0)
    assert [r.doc_id for r in rejected_documents(docs).collect()] == [7]


def test_bad_document_does_not_fail_others(docs_df):
    docs = docs_df({1: " ".join(GARDEN), 2: "Short."})
    st = {r.doc_id: r.status for r in summary_status(docs).collect()}
    assert st == {1: "ok", 2: "no_valid_sentences"}
    assert picks(summarize(docs, 1)) == {1: [2]}


@pytest.mark.parametrize(
    "kwargs",
    [
        {"num_sentences": 0},
        {"num_sentences": -1},
        {"algorithm": "unknown"},
        {"processor": "pdf"},
        {"early_termination_factor": 0.5},
        {"early_termination_factor": 11},
    ],
)
def test_parameter_validation(kwargs):
    with pytest.raises(ValueError):
        SummaryConfig(**kwargs)


def test_cap_formula():
    assert termination_cap(3, 2.0) == 400
    assert termination_cap(30, 2.0) == 600
    assert termination_cap(3, 1.5) == 300
    assert termination_cap(3, 1.001) == 201  # smallest count reaching 200.2


def test_early_termination_binds(docs_df):
    # 250 distinct valid sentences; with f=1.0 the cap is 200
    words = [f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i} theta{i} kappa{i}" for i in range(250)]
    text = " ".join(f"Sentence {w} ends here." for w in words)
    docs = docs_df({5: text})
    s = scored_sentences(docs, SummaryConfig(3, 1.0)).collect()
    assert len(s) == 200
    assert sorted(r.idx for r in s) == list(range(200))
    assert all(r.n == 200 for r in s)
    assert max(r.sentence for r in s if r.idx == 199).startswith("Sentence alpha199 ")


def test_processors_agree_on_plain_text(fixture_docs):
    base = picks(summarize(fixture_docs, 2))
    assert picks(summarize(fixture_docs, 2, processor="raw")) == base
    assert picks(summarize(fixture_docs, 2, processor="chunked")) == base


def test_partition_count_independence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = summarize(docs.repartition(1), algorithm="diverse")
    b = summarize(docs.repartition(7), algorithm="diverse")
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_score_column_types(fixture_docs):
    out = summarize(fixture_docs)
    assert dict(out.dtypes) == {"doc_id": "bigint", "idx": "int", "sentence": "string", "score": "double"}
    assert out.where(F.col("score").isNull()).count() == 0


def test_other_parameter_names_are_accepted(fixture_docs):
    assert SummaryConfig(3, 2.0, "dask", "dask") == SummaryConfig(3, 2.0, "diverse", "chunked")
    assert SummaryConfig(3, 2.0, "default", "default").processor == "clean"
    assert picks(summarize(fixture_docs, 2, algorithm="dask", processor="dask")) == picks(
        summarize(fixture_docs, 2, algorithm="diverse")
    )


def test_single_request(spark, tmp_path):
    from precis.plans.summarize import summarize_request

    rec = summarize_request(spark, text=" ".join(GARDEN), num_sentences=2).first()
    assert rec.summary == [GARDEN[0], GARDEN[2]]
    (tmp_path / "a.md").write_text(" ".join(HARBOUR))
    rec = summarize_request(spark, path=str(tmp_path / "a.md"), num_sentences=2, algorithm="dask", processor="dask").first()
    assert rec.summary == [HARBOUR[1], HARBOUR[4]] and rec.status == "ok"
    with pytest.raises(ValueError):
        summarize_request(spark)
    with pytest.raises(ValueError):
        summarize_request(spark, text="x", path=str(tmp_path))
    with pytest.raises(ValueError):
        summarize_request(spark, text="x", num_sentences=0)


def test_huge_document_is_cut_and_stitched_in_linear_time(spark):
    import time

    from precis.operators.sentences import sentences_clean
    from precis.operators.stitch import cut_at_whitespace, stitched_sentences

    text = " ".join(GARDEN) * 2300  # about a million characters
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    parts = cut_at_whitespace(docs, 1000)
    assert parts.count() > 900
    got = [r.sentence for r in stitched_sentences(parts, "doc_id", "ord").orderBy("seq").collect()]
    assert time.time() - began < 60
    assert got == [r.sentence for r in sentences_clean(docs).orderBy("seq").collect()]


def test_conversation_without_a_sentence_end_is_not_built(spark, monkeypatch):
    from precis.plans import summarize as S

    rows = [(1, k, f"turn {k} runs on without any mark of an end") for k in range(5000)]
    rows += [(2, k, t) for k, t in enumerate(GARDEN)] + [(None, k, t) for k, t in enumerate(GARDEN)]
    built = []
    whole = S.summarize_sentences
    monkeypatch.setattr(S, "summarize_sentences", lambda sents, cfg: whole(built.append(sents) or sents, cfg))
    out = S.summarize_parts(spark.createDataFrame(rows, "conv_id long, turn long, text string"), "conv_id", "turn", 2)
    assert sorted((r.doc_id or 0, r.sentence) for r in out.collect()) == sorted((d, GARDEN[k]) for d in (0, 2) for k in (0, 2))
    assert max(len(r.sentence) for r in built[0].collect()) <= 1000


def test_long_sentences_over_junctions_match_the_joined_text(spark):
    import random

    from precis.operators.sentences import sentences_clean
    from precis.operators.stitch import stitched_sentences
    from precis.plans.summarize import assemble_text

    rng = random.Random(4)
    words = ["harbour", "lantern", "Dr.", "St.", "A.", "e.g.", "of 12.", "12. of", "ropes", "so...", "nets!", '"why?"', "(see", "it)"]
    rows = [(d, 3 * k, " ".join(rng.choices(words[:9] if d % 3 else words, k=rng.randrange(1, 60)))) for d in range(60) for k in range(12)]
    parts = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    joined = assemble_text(parts, "conv_id", "turn").withColumnRenamed("conv_id", "doc_id")
    want = [(r.doc_id, r.sentence) for r in sentences_clean(joined).orderBy("doc_id", "seq").collect()]
    for block in (4, 4096):
        got = stitched_sentences(parts, "conv_id", "turn", block=block).orderBy("doc_id", "seq")
        assert [(r.doc_id, r.sentence) for r in got.collect()] == want
    short = stitched_sentences(parts, "conv_id", "turn", longest=300).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.sentence) for r in short if len(r.sentence) <= 300] == [w for w in want if len(w[1]) <= 300]


def test_all_sentences_count_without_a_factor(docs_df):
    words = [f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i} theta{i} kappa{i}" for i in range(450)]
    docs = docs_df({5: " ".join(f"Sentence {w} ends here." for w in words)})
    assert scored_sentences(docs, SummaryConfig(3)).count() == 450
    assert scored_sentences(docs, SummaryConfig(3, 2.0)).count() == 400


def test_single_request_accepts_a_list_of_strings(spark):
    from precis.plans.summarize import summarize_request

    rec = summarize_request(spark, text=list(GARDEN), num_sentences=2).first()
    assert rec.summary == [GARDEN[0], GARDEN[2]]


@pytest.mark.parametrize("processor", ["clean", "raw"])
def test_pulled_sentences_equal_the_capped_ones(spark, processor):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    split = S.sentences_raw if processor == "raw" else S.sentences_clean
    for cap in (1, 7):
        want = S.early_termination(S.valid_sentences(split(docs)), cap).select("doc_id", "idx", "n", "seq", "sentence", "terms", "n_words")
        got = S.numbered(S.first_valid(docs, cap, processor)).select("doc_id", "idx", "n", "seq", "sentence", "terms", "n_words")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tokenizing_stops_at_the_cap(spark):
    """The time of a very long document follows the cap, not its length."""
    import time

    text = " ".join(GARDEN) + " "
    docs = spark.createDataFrame([(1, text * 3000)], "doc_id long, text string")

    def seconds(cap):
        t0 = time.time()
        assert S.first_valid(docs, cap).count() == cap
        return time.time() - t0

    seconds(20)
    assert seconds(20) < 0.6 * seconds(14_000)


def test_trained_processor(spark):
    docs = spark.createDataFrame([(k, " ".join(GARDEN)) for k in range(3)], "doc_id long, text string")
    assert {r.sentence for r in summarize(docs, 2, processor="trained").collect()} <= set(GARDEN)
