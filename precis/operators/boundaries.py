"""Sentence boundaries learned from the corpus itself, without labels.

After Kiss and Strunk, "Unsupervised multilingual sentence boundary detection" (2006). Counts
over all texts decide what a period means:

* a word type is an *abbreviation* if its period is no chance: the log-likelihood ratio of
  "almost always with a period" against "as often as any word", times factors that favour short
  types and inner periods and punish every occurrence without one;
* a type is an *opener* if a capital on it means a sentence start: it stands significantly often
  after sure ends, or is known in lower case and never capitalised inside a sentence;
* a pair (type with a period, next type) is a *collocation* if it occurs together significantly
  more often than its parts suggest.

All counts come from one map-side combined aggregate of words and what stands before them, so
texts are read once and a word is looked at once, not at every place. What is learned are three
tables (abbreviations, openers, collocations). Splitting is row-local; only positions with a
doubtful period are joined with them, so texts move once, by document. Nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LONG_SENTENCE_RESPLIT
from ..functions import patterns as P
from ..functions import text as T

# Fixed values of the method.
ABBREVIATION_SCORE = 0.3
STARTER_LIKELIHOOD = 30.0
COLLOCATION_LIKELIHOOD = 7.88
PERIOD_PROBABILITY = 0.99
NUMBER = "##"

# quotes and brackets around a word of a squeezed text
_OUTSIDE = r"""(?<![^ ])["'(\[{]++|["')\]}]++(?![^ ])"""
_PIECE_END = r"""([.!?]["')\]}]*+) """
_NUMERIC = r"^[-+]?\p{Nd}[\p{Nd}.,]*$"


@dataclass(frozen=True)
class Boundaries:
    """What was learned: ``abbreviations(type)``, ``openers(type)``,
    ``collocations(type, next_type)``."""

    abbreviations: DataFrame
    openers: DataFrame
    collocations: DataFrame


# --- words ------------------------------------------------------------------------------------
def _cores(c) -> Column:
    """Squeezed text, or one word, without the quotes and brackets around its words."""
    return F.regexp_replace(c, _OUTSIDE, "")


def _word(core: Column) -> Column:
    """What a word says of boundaries: ``type`` (lower case, without its period), ``end`` (how
    it ends: period, sure, ellipsis or plain) and ``first`` (case of its first letter)."""
    kind = (
        F.when(core.rlike(r"[!?][.!?]*$"), F.lit("sure"))
        .when(core.endswith(".."), F.lit("ellipsis"))
        .when(core.endswith("."), F.lit("period"))
        .otherwise(F.lit("plain"))
    )
    bare = F.lower(F.when(core.endswith("."), F.substr(core, F.lit(1), F.length(core) - 1)).otherwise(core))
    first = F.when(core.rlike(r"^\p{Lu}"), F.lit("upper")).when(core.rlike(r"^\p{Ll}"), F.lit("lower")).otherwise(F.lit("other"))
    return F.struct(F.when(bare.rlike(_NUMERIC), F.lit(NUMBER)).otherwise(bare).alias("type"), kind.alias("end"), first.alias("first"))


def words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counted words ``(core, before, n)``: ``before`` is the word before where that ends with an
    end mark, empty where it ends nothing, null at the start of a text."""
    # the array is made once: the pairs read the generator's output
    split = docs.select(F.explode(F.array(F.split(_cores(T.squeeze_whitespace(text_col)), " "))).alias("_w"))
    previous = F.concat(F.array(F.lit(None).cast("string")), F.slice("_w", F.lit(1), F.size("_w") - 1))
    rows = split.where("_w is not null").select(F.explode(F.arrays_zip(F.col("_w").alias("core"), previous.alias("p"))).alias("r"))
    marked = F.col("r.p").endswith(".") | F.col("r.p").endswith("!") | F.col("r.p").endswith("?")
    before = F.when(marked, F.col("r.p")).when(F.col("r.p").isNotNull(), F.lit(""))
    return rows.select("r.core", before.alias("before")).groupBy("core", "before").agg(F.count(F.lit(1)).alias("n"))


def _countable() -> Column:
    return F.col("type").rlike(r"\p{L}") | (F.col("type") == NUMBER)


def type_counts(rows: DataFrame) -> DataFrame:
    """Counts of each type: ``n_plain`` and ``n_period`` (without and with a period),
    ``n_lower``, and ``n_upper_mid`` (capitalised after a word that ends nothing)."""
    # keys and the count only, so every use of the counts shares this exchange, and the one of the words
    cores = rows.groupBy("core", (F.col("before") == "").alias("mid")).agg(F.sum("n").alias("n"))
    known = cores.select(F.explode(F.array(_word(F.col("core")))).alias("k"), "mid", "n").select("k.*", "mid", "n")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return known.where(_countable()).groupBy("type").agg(
        count(F.col("end") != "period").alias("n_plain"),
        count(F.col("end") == "period").alias("n_period"),
        count(F.col("first") == "lower").alias("n_lower"),
        count((F.col("first") == "upper") & F.col("mid")).alias("n_upper_mid"),
    )


# --- likelihoods ---------------------------------------------------------------------------------
def with_abbreviation_score(types: DataFrame) -> DataFrame:
    """Add ``score`` (0 where a type has no period, no letter, or is a number)."""
    n, a = F.col("n_plain") + F.col("n_period"), F.col("n_period")
    totals = types.agg(F.sum("n_period").alias("_p"), F.sum(n).alias("_n"))
    p0 = F.least(F.lit(PERIOD_PROBABILITY), F.col("_p") / F.col("_n"))
    chance = a * F.log(p0) + F.col("n_plain") * F.log(1 - p0)
    period = a * F.log(F.lit(PERIOD_PROBABILITY)) + F.col("n_plain") * F.log(F.lit(1 - PERIOD_PROBABILITY))
    inner = F.length("type") - F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    score = 2 * (period - chance) * F.exp(-letters) * (inner + 1) * F.exp(-F.col("n_plain") * F.log(letters))
    able = (a > 0) & (F.col("type") != NUMBER)
    # the totals are one row
    return types.join(F.broadcast(totals)).withColumn("score", F.when(able, score).otherwise(F.lit(0.0))).drop("_p", "_n")


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    """``ln p^k (1-p)^(n-k)`` with ``0 ln 0 = 0``."""
    part = lambda c, q: F.when(c > 0, c * F.log(q)).otherwise(F.lit(0.0))
    return part(k, p) + part(n - k, 1 - p)


def log_likelihood(both: Column, first: Column, second: Column, n: Column) -> Column:
    """Dunning's ratio for a pair: ``both`` together, ``first`` and ``second`` alone, of ``n``."""
    p, p1, p2 = second / n, both / first, (second - both) / (n - first)
    return 2 * (
        _likelihood(both, first, p1) + _likelihood(second - both, n - first, p2) - _likelihood(both, first, p) - _likelihood(second - both, n - first, p)
    )


def _guarded(is_abbreviation: Column) -> Column:
    """Words whose period may be no end: abbreviations, initials, numbers."""
    return is_abbreviation | F.col("prev_type").rlike(r"^\p{L}$") | (F.col("prev_type") == NUMBER)


def after_ends(rows: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Counted pairs across an end mark: ``(prev_type, type, sure, n)``; ``sure``: a sentence
    certainly ends between them."""
    # told apart behind the generator: a condition on ``before`` would read the texts a second time
    pair = F.when(F.col("before") != "", F.struct(_word(F.col("core")).alias("k"), _word(F.col("before")).alias("p")))
    known = rows.select(F.explode(F.array(pair)).alias("r"), "n")
    known = known.select("r.k.type", F.col("r.p.type").alias("prev_type"), F.col("r.p.end").alias("prev_end"), "n")
    pairs = known.where(F.col("prev_end").isin("period", "sure") & _countable()).groupBy("prev_type", "prev_end", "type").agg(F.sum("n").alias("n"))
    known = abbreviations.select(F.col("type").alias("prev_type"), F.lit(True).alias("_abbreviation"))
    pairs = pairs.join(known, "prev_type", "left")
    sure = (F.col("prev_end") == "sure") | ~_guarded(F.coalesce("_abbreviation", F.lit(False)))
    return pairs.groupBy("prev_type", "type", sure.alias("sure")).agg(F.sum("n").alias("n"))


def starters(pairs: DataFrame, types: DataFrame) -> DataFrame:
    """``(type, n_start, likelihood)`` of types that stand after a sure end."""
    n = types.agg(F.sum(F.col("n_plain") + F.col("n_period")).alias("_n"))
    at = pairs.where("sure").groupBy("type").agg(F.sum("n").alias("n_start"))
    total = at.agg(F.sum("n_start").alias("_starts"))
    rows = at.join(types.select("type", (F.col("n_plain") + F.col("n_period")).alias("_c")), "type").join(F.broadcast(n)).join(F.broadcast(total))
    ll = log_likelihood(F.col("n_start"), F.col("_starts"), F.col("_c"), F.col("_n"))
    often = F.col("n_start") * F.col("_n") > F.col("_c") * F.col("_starts")
    return rows.select("type", "n_start", F.when(often, ll).otherwise(F.lit(0.0)).alias("likelihood"))


def collocations(pairs: DataFrame, types: DataFrame) -> DataFrame:
    """``(type, next_type)`` that belong together across a period."""
    c = (F.col("n_plain") + F.col("n_period")).alias
    n = types.agg(F.sum(F.col("n_plain") + F.col("n_period")).alias("_n"))
    rows = pairs.where("not sure and n > 1").select(F.col("prev_type").alias("type"), F.col("type").alias("next_type"), "n")
    rows = rows.join(types.select("type", c("_first")), "type").join(types.select(F.col("type").alias("next_type"), c("_second")), "next_type").join(F.broadcast(n))
    ll = log_likelihood(F.col("n"), F.col("_first"), F.col("_second"), F.col("_n"))
    often = F.col("n") * F.col("_n") > F.col("_first") * F.col("_second")
    return rows.where(often & (ll >= COLLOCATION_LIKELIHOOD)).select("type", "next_type")


def learn(docs: DataFrame, text_col: str = "text") -> Boundaries:
    """Learn from all texts. The result can be used on others."""
    rows = words(docs, text_col)
    types = type_counts(rows)
    abbreviations = with_abbreviation_score(types).where(F.col("score") >= ABBREVIATION_SCORE).select("type")
    pairs = after_ends(rows, abbreviations)
    starts = starters(pairs, types).where(F.col("likelihood") >= STARTER_LIKELIHOOD).select("type")
    openers = types.where("n_lower > 0 and n_upper_mid = 0").select("type").union(starts).distinct()
    found = collocations(pairs, types).join(starts.withColumnRenamed("type", "next_type"), "next_type", "left_anti").select("type", "next_type")
    return Boundaries(abbreviations, openers, found)


# --- splitting -----------------------------------------------------------------------------------
def _pieces(docs: DataFrame, text_col: str) -> DataFrame:
    """``(doc_id, pos, piece, next_word)``: texts cut after every word with an end mark."""
    marked = F.regexp_replace(T.squeeze_whitespace(text_col), _PIECE_END, "$1" + P.BREAK)
    split = docs.select("doc_id", F.explode(F.array(F.split(marked, P.BREAK))).alias("_p"))
    next_word = lambda i: F.substring_index(F.get("_p", i + 1), " ", 1)
    rows = split.select("doc_id", F.posexplode(F.transform("_p", lambda p, i: F.struct(p.alias("piece"), next_word(i).alias("next_word")))).alias("pos", "_r"))
    return rows.select("doc_id", "pos", "_r.piece", "_r.next_word")


def running_on(docs: DataFrame, model: Boundaries, text_col: str = "text") -> DataFrame:
    """``(doc_id, pos)`` of the pieces whose end mark ends no sentence."""
    rows = _pieces(docs, text_col).where("next_word is not null")
    cores = F.struct(_cores(F.substring_index("piece", " ", -1)).alias("last"), _cores(F.col("next_word")).alias("next"))
    rows = rows.select("doc_id", "pos", F.explode(F.array(cores)).alias("c")).where(F.col("c.last").endswith("."))
    pair = F.struct(_word(F.col("c.last")).alias("k"), _word(F.col("c.next")).alias("f"))
    rows = rows.select("doc_id", "pos", F.explode(F.array(pair)).alias("r")).select(
        "doc_id", "pos", F.col("r.k.type").alias("prev_type"), "r.k.end", F.col("r.f.type").alias("next_type"), F.col("r.f.first").alias("first")
    )
    doubtful = rows.where(F.col("end").isin("period", "ellipsis"))
    abbreviations = model.abbreviations.select(F.col("type").alias("prev_type"), F.lit(True).alias("_a"))
    openers = model.openers.select(F.col("type").alias("next_type"), F.lit(True).alias("_o"))
    pairs = model.collocations.select(F.col("type").alias("prev_type"), "next_type", F.lit(True).alias("_c"))
    doubtful = doubtful.join(abbreviations, "prev_type", "left")
    doubtful = doubtful.where((F.col("end") == "ellipsis") | _guarded(F.coalesce("_a", F.lit(False))))
    doubtful = doubtful.join(openers, "next_type", "left").join(pairs, ["prev_type", "next_type"], "left")
    opens = (F.col("first") == "upper") & F.col("_o").isNotNull()
    number = (F.col("prev_type") == NUMBER) & (F.col("end") == "period")
    return doubtful.where((F.col("first") == "lower") | F.col("_c").isNotNull() | (~number & ~opens)).select("doc_id", "pos")


def sentences_trained(docs: DataFrame, model: Boundaries | None = None, text_col: str = "text") -> DataFrame:
    """Clean processor with learned boundaries: ``(doc_id, seq, sentence)``; pieces of more than
    200 characters are re-split and the validity filter holds, as in the clean split. Without a
    model it is learned from ``docs``."""
    docs = docs.select("doc_id", text_col)
    model = model or learn(docs, text_col)
    pieces = _pieces(docs, text_col).select("doc_id", "pos", "piece")
    marks = running_on(docs, model, text_col).select("doc_id", "pos", F.lit(None).cast("string").alias("piece"))
    # a mark stands right after its piece: the piece that follows it goes on with the sentence
    order = Window.partitionBy("doc_id").orderBy("pos", F.col("piece").isNull())
    rows = pieces.union(marks).withColumn("_goes_on", F.coalesce(F.lag(F.col("piece").isNull()).over(order), F.lit(False)))
    start = F.when(F.col("piece").isNotNull() & ~F.col("_goes_on"), F.col("pos"))
    rows = rows.withColumn("at", F.max(start).over(order)).where("piece is not null")
    together = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    whole = rows.groupBy("doc_id", "at").agg(F.array_join(F.transform(together, lambda p: p["piece"]), " ").alias("s"))
    parts = F.when(F.length("s") > LONG_SENTENCE_RESPLIT, F.split("s", P.RESPLIT)).otherwise(F.array("s"))
    out = whole.select("doc_id", "at", F.posexplode(parts).alias("sub", "sentence")).withColumn("sentence", F.trim("sentence"))
    seq = F.col("at").cast("long") * (1 << 32) + F.col("sub")
    return out.where(T.is_valid_sentence("sentence")).select("doc_id", seq.alias("seq"), "sentence")
