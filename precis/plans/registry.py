"""Registered queries: one per operator, each reading the given tables.

Every query runs over whole tables and whole texts. Integer outputs are
BIGINT and scores are rounded to 9 decimals so results compare exactly with
the DuckDB oracle (:mod:`precis.oracle`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STOP_WORDS, SummaryConfig, termination_cap
from ..functions import text as T
from ..operators import boundaries, scoring, selection, sentences, tfidf
from . import summarize as S

DIGITS = 9
CHUNK_DEMO = 1024  # slice size for the chunk keys (the processor default is 1 MiB)
CFG = SummaryConfig(num_sentences=3)
CAP = termination_cap(3, 2.0)
TASK_BYTES = 4 << 20  # of a table's files to a task of the term statistics


# Letters of q_decode_legacy, one for one; the Cyrillic ones are as frequent as the Latin ones.
LATIN_LETTERS = "etaoinshrdlucmwfgypbvkjxqzETAOINSHRDLUCMWFGYPBVKJXQZ"
CYRILLIC_LETTERS = "оеаинтсрвлкмдпуяыьгзбчйхжшОЕАИНТСРВЛКМДПУЯЫЬГЗБЧЙХЖШ"
HIRAGANA_LETTERS = "あいうえおかきくけこさしすせそたちつてとなにぬねのは"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    """The documents table as read (the plan functions distribute it)."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def docs(spark, sf_dir) -> DataFrame:
    """Documents as the files give them; spread over tasks first only where the session
    asks for it (``precis.spread``: a local run on a file of one row group)."""
    d = documents(spark, sf_dir)
    return S.distribute(d) if _spread(spark) else d


def _spread(spark) -> bool:
    return spark.conf.get("precis.spread", "false") == "true"


def _tasks(spark, sf_dir, name="documents") -> int:
    """Tasks for work by document: they grow with the table's files, so that what one task
    sorts does not; at least as many as run at once."""
    files = table(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size").distinct()
    size = files.agg(F.sum("file_size")).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def _long(*cols):
    return [F.col(c).cast("long").alias(c) for c in cols]


def _r(c, name=None):
    return F.round(F.col(c), DIGITS).alias(name or c)


def _kept(spark, sf_dir, cfg=CFG):
    return S.kept_sentences(docs(spark, sf_dir), cfg, tasks=_tasks(spark, sf_dir))


def _tf(spark, sf_dir):
    return tfidf.term_frequency(_kept(spark, sf_dir))


def _scores(spark, sf_dir, cfg=CFG):
    return S.scored_sentences(docs(spark, sf_dir), cfg, tasks=_tasks(spark, sf_dir))


def _summary_rows(df: DataFrame) -> DataFrame:
    return df.select(*_long("doc_id", "idx"), "sentence", _r("score"))


# --- sources / scalar text ------------------------------------------------------------
def q_squeeze_whitespace(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.squeeze_whitespace("text").alias("text"))


def q_preprocess_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.preprocess_text("text").alias("text"))


def q_html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text("html").alias("text"))


def q_html_to_text_glued(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text_glued("html").alias("text"))


def q_assemble_conversation(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return S.assemble_text(conv, "conv_id", "turn")


def q_chunk_text(spark, sf_dir):
    out = sentences.chunk_text(docs(spark, sf_dir), CHUNK_DEMO)
    return out.select("doc_id", *_long("chunk_no"), "chunk")


# --- sentences ------------------------------------------------------------------------
def q_sentences_raw(spark, sf_dir):
    return sentences.sentences_raw(docs(spark, sf_dir))


def q_sentences_clean(spark, sf_dir):
    return sentences.sentences_clean(docs(spark, sf_dir))


def q_sentences_abbrev(spark, sf_dir):
    return sentences.sentences_abbrev(docs(spark, sf_dir))


def q_sentences_valid(spark, sf_dir):
    return sentences.sentences_raw(docs(spark, sf_dir)).where(T.is_valid_sentence("sentence"))


def q_sentences_chunked(spark, sf_dir):
    return sentences.sentences_chunked(docs(spark, sf_dir), CHUNK_DEMO)


def q_length_filter(spark, sf_dir):
    return sentences.length_filter(sentences.sentences_clean(docs(spark, sf_dir)))


def q_tokens(spark, sf_dir):
    s = sentences.length_filter(sentences.sentences_clean(docs(spark, sf_dir)))
    # spaced out in a projection, where Spark evaluates what the expression repeats once
    s = s.select("doc_id", "seq", T.normalize_tokens("sentence").alias("_spaced"))
    toks = F.filter(F.split(F.trim("_spaced"), " +"), lambda x: F.length(x) > 0)
    out = s.select("doc_id", "seq", F.posexplode(toks).alias("tok_pos", "token"))
    return out.select("doc_id", "seq", *_long("tok_pos"), "token")


def q_tokens_filtered(spark, sf_dir):
    s = sentences.with_terms(sentences.length_filter(sentences.sentences_clean(docs(spark, sf_dir))))
    out = s.select("doc_id", "seq", F.posexplode("terms").alias("tok_pos", "term"))
    return out.select("doc_id", "seq", *_long("tok_pos"), "term")


def q_tokens_filtered_lang(spark, sf_dir):
    """Filtered tokens with stop lists by ``documents.lang``: the English list holds for
    English documents only."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    pieces = d.select("doc_id", "lang", F.posexplode(T.split_clean("text")).alias("seq", "sentence"))
    own = T.terms_by_language("sentence", "lang", {"en": STOP_WORDS})
    out = sentences.length_filter(pieces).select("doc_id", "seq", F.posexplode(own).alias("tok_pos", "term"))
    return out.select("doc_id", *_long("seq", "tok_pos"), "term")


def q_valid_sentences(spark, sf_dir):
    v = sentences.valid_sentences(sentences.sentences_clean(docs(spark, sf_dir)))
    return v.select("doc_id", "seq", *_long("n_words"), "sentence")


def q_early_termination(spark, sf_dir):
    """The feature itself: the first sentences of each source, read as one long document
    (its documents by id), so that the cap binds."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    own = sentences.valid_sentences(sentences.sentences_clean(d.select("doc_id", "text")))
    rows = own.join(d.select("doc_id", "source"), "doc_id")
    rows = rows.select(F.col("source").alias("doc_id"), F.struct("doc_id", "seq").alias("seq"), "sentence")
    out = sentences.early_termination(rows, CAP)
    return out.select(F.col("doc_id").alias("source"), *_long("idx"), "seq.doc_id", "seq.seq", *_long("n"), "sentence")


def q_boundary_types(spark, sf_dir):
    """Word types that occur with a period, and how likely they are abbreviations."""
    types = boundaries.with_abbreviation_score(boundaries.type_counts(boundaries.words(docs(spark, sf_dir))))
    known = (F.col("score") >= boundaries.ABBREVIATION_SCORE).cast("long").alias("abbreviation")
    return types.where("n_period > 0").select("type", *_long("n_plain", "n_period", "n_lower", "n_upper_mid"), F.round("score", 6).alias("score"), known)


def q_boundary_starters(spark, sf_dir):
    """Word types after sure sentence ends, and how significant that is."""
    rows = boundaries.words(docs(spark, sf_dir))
    types = boundaries.type_counts(rows)
    abbreviations = boundaries.with_abbreviation_score(types).where(F.col("score") >= boundaries.ABBREVIATION_SCORE)
    starts = boundaries.starters(boundaries.after_ends(rows, abbreviations), types)
    known = (F.col("likelihood") >= boundaries.STARTER_LIKELIHOOD).cast("long").alias("starter")
    return starts.select("type", *_long("n_start"), F.round("likelihood", 5).alias("likelihood"), known)


def q_sentences_trained(spark, sf_dir):
    return boundaries.sentences_trained(docs(spark, sf_dir))


def q_early_stop(spark, sf_dir):
    """The feature itself: each document is read until it has 20 valid sentences."""
    out = sentences.numbered(sentences.first_valid(docs(spark, sf_dir), 20))
    return out.select("doc_id", *_long("idx", "seq", "n", "n_words"), "sentence")


# --- term statistics --------------------------------------------------------------------
def q_term_frequency(spark, sf_dir):
    return _tf(spark, sf_dir).select("doc_id", *_long("idx"), "term", *_long("tf"))


def q_document_frequency(spark, sf_dir):
    return tfidf.document_frequency(_tf(spark, sf_dir)).select("doc_id", "term", *_long("df"))


def q_idf(spark, sf_dir):
    t = tfidf.with_idf(_tf(spark, sf_dir)).select("doc_id", "term", "df", "idf").dropDuplicates(["doc_id", "term"])
    return t.select("doc_id", "term", *_long("df"), _r("idf"))


def q_tfidf_relative(spark, sf_dir):
    w = tfidf.tfidf_weights(tfidf.with_idf(_tf(spark, sf_dir)))
    return w.select("doc_id", *_long("idx"), "term", _r("w_rel", "weight"))


def q_tfidf_l2(spark, sf_dir):
    w = tfidf.tfidf_weights(tfidf.with_idf(_tf(spark, sf_dir)))
    return w.select("doc_id", *_long("idx"), "term", _r("w_l2", "weight"))


def q_vocabulary(spark, sf_dir):
    return tfidf.vocabulary(_tf(spark, sf_dir)).select("doc_id", "term", *_long("term_idx"))


def q_sentence_vectors(spark, sf_dir):
    return tfidf.sentence_vectors(_tf(spark, sf_dir)).select("doc_id", *_long("idx", "term_idx", "tf"))


def q_vocabulary_merge(spark, sf_dir):
    """Vocabulary of each document's first valid sentence, then every later
    sentence merged in (equals the vocabulary of the whole document)."""
    kept = _kept(spark, sf_dir)
    first = tfidf.vocabulary(tfidf.term_frequency(kept.where(F.col("idx") == 0)))
    rest = kept.where(F.col("idx") > 0).select("doc_id", "idx", F.posexplode("terms").alias("tok_pos", "term"))
    return tfidf.vocabulary_merge(first, rest).select("doc_id", "term", *_long("term_idx"))


def q_vocabulary_semi(spark, sf_dir):
    """Term rows of the documents whose term is in a caller-given vocabulary:
    the terms of the ``benchmark`` texts. A plain semi-join; AQE broadcasts
    the vocabulary only if its measured size is small."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    vocab = sentences.with_terms(sentences.sentences_clean(bench)).select(F.explode("terms").alias("term")).distinct()
    tf = _tf(spark, sf_dir).join(vocab, "term", "left_semi")
    return tf.select("doc_id", *_long("idx"), "term", *_long("tf"))


def q_idf_corpus(spark, sf_dir):
    return tfidf.idf_corpus(_kept(spark, sf_dir)).select("term", *_long("df"), _r("idf"))


# --- scores -------------------------------------------------------------------------------
def q_score_l2(spark, sf_dir):
    return _scores(spark, sf_dir).select("doc_id", *_long("idx"), F.col("score_l2").alias("score"))


def q_score_raw(spark, sf_dir):
    return _scores(spark, sf_dir).select("doc_id", *_long("idx"), F.col("score_raw").alias("score"))


def q_score_blended(spark, sf_dir):
    return scoring.blended_scores(_scores(spark, sf_dir)).select("doc_id", *_long("idx"), _r("score"))


def q_score_stats(spark, sf_dir):
    st = scoring.score_stats(scoring.blended_scores(_scores(spark, sf_dir)))
    return st.select("doc_id", _r("mean_score"), _r("std_score"), _r("max_score"), _r("min_score"))


# --- selection ------------------------------------------------------------------------------
def q_top_n_sentences(spark, sf_dir):
    t = selection.top_n(_scores(spark, sf_dir), CFG.num_sentences, "score_l2")
    return t.select("doc_id", *_long("pick_rank", "idx"), F.col("score_l2").alias("score"))


def q_diverse_selection(spark, sf_dir):
    b = scoring.blended_scores(_scores(spark, sf_dir))
    return selection.diverse_selection(b, CFG.num_sentences).select("doc_id", *_long("idx"), _r("score"))


def q_near_sentence_pairs(spark, sf_dir):
    p = selection.near_sentence_pairs(_kept(spark, sf_dir))
    return p.select("doc_id", *_long("idx_a", "idx_b", "len_diff"))


def q_file_extension(spark, sf_dir):
    """Extension of the last path part of the page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", T.file_extension("url").alias("ext"))


def q_decode_bytes(spark, sf_dir):
    """Texts written as bytes in three encodings and read back."""
    d = documents(spark, sf_dir)
    kind = F.pmod(F.col("doc_id"), F.lit(3))
    latin = F.when(~F.col("text").rlike(r"[^\x00-\xFF]"), F.encode("text", "ISO-8859-1"))
    # bytes that read as one of the others are not written: they say nothing of their encoding
    latin = F.when(F.col("text").rlike(r"^[\x00-\x7F]*$") | (T.decode_bytes(latin) == F.col("text")), latin)
    content = F.when(kind == 0, F.encode("text", "UTF-8")).when(kind == 1, F.encode("text", "UTF-16"))
    content = F.coalesce(content, latin, F.encode("text", "UTF-8"))
    return d.select("doc_id", T.decode_bytes(content).alias("text"))


def q_decode_legacy(spark, sf_dir):
    """Texts written in the bytes of three legacy encodings and read back: windows-1252 (as they
    are, where it holds them), windows-1251 and Shift-JIS (letters put into Cyrillic and
    hiragana). Which encoding it is has to be found from the bytes alone."""
    d = documents(spark, sf_dir)
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    cyrillic = F.translate(ascii_, LATIN_LETTERS, "".join(bytes([c]).decode("latin-1") for c in CYRILLIC_LETTERS.encode("cp1251")))
    trail = "".join(chr(c) for c in HIRAGANA_LETTERS.encode("shift_jis")[1::2])
    kana = F.regexp_replace(F.translate(F.lower(ascii_), LATIN_LETTERS[:26], trail), r"([^\x00-\x7F])", "\u0082$1")
    kind = F.pmod(F.col("doc_id"), F.lit(3))
    western = F.when(~F.col("text").rlike(r"[^\x00-\x7F\xA0-\xFF]"), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    content = F.when(kind == 0, western).when(kind == 1, F.encode(cyrillic, "ISO-8859-1")).otherwise(F.encode(kana, "ISO-8859-1"))
    return d.select("doc_id", T.decode_bytes(content).alias("text"))


# --- composite ------------------------------------------------------------------------------
def _summary(spark, sf_dir, algorithm, processor, **kw):
    return _summary_rows(S.summarize(documents(spark, sf_dir), 3, None, algorithm, processor, spread=_spread(spark), tasks=_tasks(spark, sf_dir), **kw))


def q_summarize_default(spark, sf_dir):
    return _summary(spark, sf_dir, "default", "clean")


def q_summarize_diverse(spark, sf_dir):
    return _summary(spark, sf_dir, "diverse", "clean")


def q_summarize_raw(spark, sf_dir):
    return _summary(spark, sf_dir, "default", "raw")


def q_summarize_raw_diverse(spark, sf_dir):
    return _summary(spark, sf_dir, "diverse", "raw")


def q_summarize_trained(spark, sf_dir):
    return _summary(spark, sf_dir, "default", "trained")


def q_summarize_chunked(spark, sf_dir):
    return _summary(spark, sf_dir, "diverse", "chunked", chunk_size=CHUNK_DEMO)


def q_summarize_chunked_default(spark, sf_dir):
    return _summary(spark, sf_dir, "default", "chunked", chunk_size=CHUNK_DEMO)


def q_summarize_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    if _spread(spark):  # before the markup is read: that is work of the same kind
        pages = S.distribute(pages, "html")
    texts = pages.select("doc_id", T.html_to_text("html").alias("text"))
    return _summary_rows(S.summarize(texts, 3, None, "default", "clean", tasks=_tasks(spark, sf_dir, "pages")))


def q_summarize_conversations(spark, sf_dir):
    """Conversations summarized as their turns joined by a space, computed from
    the turns (no conversation is built as one row)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return _summary_rows(S.summarize_parts(conv, "conv_id", "turn", 3, None, "diverse"))


def q_summary_status(spark, sf_dir):
    return S.summary_status(docs(spark, sf_dir), CFG).select("doc_id", "status", "n_valid")


def q_rejected_documents(spark, sf_dir):
    return S.rejected_documents(docs(spark, sf_dir), CFG)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
