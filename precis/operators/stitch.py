"""Sentences of a document made of ordered parts, without building the document.

A document given as parts ``(key, ord, text)`` (conversation turns, book
items) reads as its non-blank parts joined by one space. Its clean-split
sentences equal splitting every part on its own and then joining, across each
junction, the last piece of a part with the first piece of the next one
unless the junction itself ends a sentence:

* a part ending in an abbreviation or initial (``Dr.``, ``A.``), or in a
  number and period followed by a lower-case start, keeps the next part in
  the same sentence;
* otherwise a part ending in ``.``, ``!`` or ``?`` (and closing quotes or
  brackets) ends the sentence at the junction;
* otherwise the sentence runs on.

Neighbour lookups (the previous part's ending, the latest sentence start) are
two-level: within blocks of ``block`` parts by a window over ``(key, block)``
and across blocks over a per-block summary joined back on ``(key, block)``. So
a document with a huge number of parts is spread over many tasks and no task
holds a whole document. A sentence that runs over many parts is cut at its
re-split marks before its pieces meet, and its length is known before it is
built: where the caller names the longest sentence it reads, none longer is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ABBREVIATIONS, LONG_SENTENCE_RESPLIT, MAX_SENTENCE_LENGTH
from ..functions import patterns as P
from ..functions import text as T

_abbrev = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
ENDS_SENTENCE = r"""(?<![.!?])[.!?]++["')\]}]*+$"""
ENDS_GUARDED = rf"(?:^|[ (])(?:{_abbrev}|\p{{L}})\.$"
ENDS_NUMBER = r"(?:^|[ (])\p{Nd}[\p{Nd}.,-]*\.$"
STARTS_LOWER = r"^\p{Ll}"
# P.RESPLIT without its white space, so that the cuts put together are the piece.
RESPLIT_PLACE = r"(?<=[.!?])(?= )"
ENDS_RESPLIT = r"[.!?]$"


def _pos(o: str, p: F.Column, s: F.Column) -> F.Column:
    """Position of a cut: (part order, piece number, cut number in the piece), ordered."""
    return F.struct(F.col(o).cast("bigint").alias("o"), p.cast("int").alias("p"), s.cast("int").alias("s"))


def _previous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Add ``prev_<value>``: ``value`` of the preceding row of the same key in
    ``ord`` order (null for the first), computed within blocks and across
    block boundaries from a per-block summary."""
    in_block = Window.partitionBy(key, "blk").orderBy("ord")
    out = df.withColumn("_lag", F.lag(value).over(in_block))
    last = df.groupBy(key, "blk").agg(F.max_by(value, "ord").alias("_last"))
    by_block = Window.partitionBy(key).orderBy("blk")
    last = last.select(key, "blk", F.lag("_last").over(by_block).alias("_prev_block_last"))
    out = out.join(last, [key, "blk"], "left")
    first_in_block = F.row_number().over(in_block) == 1
    prev = F.when(first_in_block, F.col("_prev_block_last")).otherwise(F.col("_lag"))
    return out.withColumn(f"prev_{value}", prev).drop("_lag", "_prev_block_last")


def _latest_before(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Add ``latest_<value>``: the maximum of each value over the rows of the
    same key strictly before this one in ``ord`` order (two-level prefix)."""
    in_block = Window.partitionBy(key, "blk").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *[F.max(v).over(in_block).alias(f"_in_{v}") for v in values])
    blocks = df.groupBy(key, "blk").agg(*[F.max(v).alias(f"_bmax_{v}") for v in values])
    before = Window.partitionBy(key).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(key, "blk", *[F.max(f"_bmax_{v}").over(before).alias(f"_before_{v}") for v in values])
    out = out.join(blocks, [key, "blk"], "left")
    return out.select(*df.columns, *[F.greatest(f"_in_{v}", f"_before_{v}").alias(f"latest_{v}") for v in values])


def cut_at_whitespace(docs: DataFrame, part_chars: int, text_col: str = "text") -> DataFrame:
    """Cut each text into ordered parts ``(doc_id, ord, text)`` after the first
    white-space character that follows ``part_chars`` characters (a run without white
    space is not cut). The text equals its parts one after the other, so
    :func:`stitched_sentences` of the parts is the clean split of the text. One linear
    pass over the text finds all parts."""
    part = rf"(?s).{{{part_chars}}}{P.NOT_WS}*+{P.WS}|.++"
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(part), F.lit(0))
    return docs.select("doc_id", F.posexplode(pieces).alias("ord", "text")).withColumn("ord", F.col("ord").cast("long"))


def stitched_sentences(
    parts: DataFrame, key: str, order: str, text_col: str = "text", block: int = 4096, longest: int | None = None
) -> DataFrame:
    """Clean-split sentences of each document assembled from ``parts``:
    ``(doc_id, seq STRUCT<ord, piece, sub>, sentence)``; ``seq`` orders the
    sentences of a document. ``longest``: sentences of more characters may be
    left out, so that none is built however many parts it runs over."""
    kept = parts.where(F.col(text_col).isNotNull() & ~T.is_blank(text_col))
    s = T.squeeze_whitespace(text_col)
    cuts = F.transform(F.split(T.mark_breaks(text_col), P.BREAK), lambda x: F.split(F.translate(x, P.GUARD, " "), RESPLIT_PLACE))
    p = kept.select(
        F.col(key).alias("doc_id"),
        F.col(order).alias("ord"),
        F.floor(F.col(order) / block).alias("blk"),
        cuts.alias("pieces"),
        F.struct(
            s.rlike(ENDS_SENTENCE).alias("sentence"),
            s.rlike(ENDS_GUARDED).alias("guarded"),
            s.rlike(ENDS_NUMBER).alias("number"),
            s.rlike(ENDS_RESPLIT).alias("resplit"),
        ).alias("end"),
        s.rlike(STARTS_LOWER).alias("starts_lower"),
    )
    p = _previous(p, "doc_id", "end")
    prev = F.col("prev_end")
    guarded = prev["guarded"] | (prev["number"] & F.col("starts_lower"))
    # A new sentence starts with this part's first piece: first part, or the
    # junction before it ends a sentence. A new cut starts there too where a long
    # sentence is re-split at the junction.
    p = p.withColumn("fresh", prev.isNull() | (~guarded & prev["sentence"]))
    p = p.withColumn("fresh_cut", F.col("fresh") | prev["resplit"])
    n, n_cuts = F.size("pieces"), F.size(F.element_at("pieces", -1))
    zero = F.lit(0)
    # Start of the sentence (the cut) this part's last piece belongs to, when known
    # inside the part (several pieces, or a single piece starting fresh).
    last_seg = F.when(n > 1, _pos("ord", n - 1, zero)).when(F.col("fresh"), _pos("ord", zero, zero))
    known = (n > 1) | (n_cuts > 1) | F.col("fresh_cut")
    p = p.withColumn("last_start", last_seg).withColumn("last_cut", F.when(known, _pos("ord", n - 1, n_cuts - 1)))
    p = _latest_before(p, "doc_id", "last_start", "last_cut")
    first = _pos("ord", zero, zero)
    pieces = p.select(
        "doc_id",
        "ord",
        "blk",
        F.when(F.col("fresh"), first).otherwise(F.col("latest_last_start")).alias("first_seg"),
        F.when(F.col("fresh_cut"), first).otherwise(F.col("latest_last_cut")).alias("first_cut"),
        F.posexplode("pieces").alias("piece", "cuts"),
    )
    here = F.col("piece")
    seg = F.when(here == 0, F.col("first_seg")).otherwise(_pos("ord", here, zero))
    pieces = pieces.select("doc_id", seg.alias("seg"), "first_cut", "ord", "blk", "piece", F.posexplode("cuts").alias("sub", "text"))
    joins = (here == 0) & (F.col("sub") == 0)
    cut = F.when(joins, F.col("first_cut")).otherwise(_pos("ord", here, F.col("sub")))
    pieces = pieces.select("doc_id", "seg", cut.alias("cut"), "ord", "blk", "piece", "sub", "text")
    # Within a block of parts first: the text of a cut's pieces, the characters of the
    # whole sentence with the spaces at its junctions, and those of a cut without white
    # space at its pieces' ends (it has no fewer). A text that is too long is not kept.
    size, fits = F.length(F.trim("text")), (lambda n, text: text if longest is None else F.when(n <= longest, text))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "piece", "sub", fits(size, F.col("text")).alias("text"))))
    spaced = F.transform(ordered, lambda x: F.concat(F.when(x["sub"] == 0, F.lit(" ")).otherwise(F.lit("")), x["text"]))
    blocks = pieces.groupBy("doc_id", "seg", "cut", "blk").agg(
        F.sum(F.length("text") + F.when(F.col("sub") == 0, 1).otherwise(0)).alias("chars"),
        F.sum(size).alias("least"),
        fits(F.sum(size), F.array_join(spaced, "")).alias("text"),
    )
    blocks = blocks.withColumn("chars", F.sum("chars").over(Window.partitionBy("doc_id", "seg")) - 1)
    blocks = blocks.withColumn("least", F.sum("least").over(Window.partitionBy("doc_id", "seg", "cut")))
    long = F.col("chars") > LONG_SENTENCE_RESPLIT
    if longest is not None:
        blocks = blocks.where(~long | (F.col("least") <= longest))
    blocks = blocks.withColumn("start", F.when(long, F.col("cut")).otherwise(F.col("seg")))
    # One group per sentence: usually a single part's piece, a few when it runs
    # across junctions.
    ordered = F.array_sort(F.collect_list(F.struct("cut", "blk", "text")))
    out = blocks.groupBy("doc_id", "seg", "start").agg(F.trim(F.array_join(F.transform(ordered, lambda x: x["text"]), "")).alias("sentence"))
    seq = F.struct(F.col("start.o").alias("ord"), F.col("start.p").alias("piece"), F.col("start.s").alias("sub")).alias("seq")
    return out.select("doc_id", seq, "sentence").where(T.is_valid_sentence("sentence"))


def stitched_raw(
    parts: DataFrame, key: str, order: str, text_col: str, last: str, block: int = 4096, longest: int = MAX_SENTENCE_LENGTH
) -> DataFrame:
    """Raw-split sentences of each document whose parts follow each other without a
    separator (``last`` marks its last part): ``(doc_id, seq STRUCT<ord, piece, sub>, sentence)``
    with white space kept as :func:`precis.functions.text.split_raw` keeps it. A sentence of more
    than ``longest`` characters is left out, so that none is built however many parts it runs
    over."""
    p = parts.select(F.col(key).alias("doc_id"), F.col(order).alias("ord"), F.floor(F.col(order) / block).alias("blk"), F.col(last).alias("last"), F.col(text_col).alias("text"))
    # whether the text breaks off at an end, which a blank part leaves as it is
    state = F.when(~T.is_blank("text"), F.struct("ord", F.col("text").rlike(rf"[.!?]{P.WS}+$").alias("broken")))
    p = _latest_before(p.withColumn("state", state).withColumn("seen", F.col("ord")), "doc_id", "state", "seen")
    starts = F.col("latest_seen").isNull()
    prev = F.coalesce(F.col("latest_state.broken"), F.lit(False))
    # white space after an end belongs to the separator, also across the cut
    text = F.when(prev, F.regexp_replace("text", f"^{P.WS}+", "")).otherwise(F.col("text"))
    p = p.select("doc_id", "ord", "blk", "last", starts.alias("starts"), (starts | prev).alias("fresh"), F.split(text, P.RAW_SPLIT).alias("pieces"))
    n, zero, fresh = F.size("pieces"), F.lit(0), F.col("fresh")
    p = p.withColumn("last_start", F.when(n > 1, _pos("ord", n - 1, zero)).when(fresh, _pos("ord", zero, zero)))
    p = _latest_before(p, "doc_id", "last_start")
    here, only = F.col("piece"), F.col("alone")
    alone = F.col("last") & F.col("starts") & (n == 1)
    pieces = p.select("doc_id", "ord", F.when(fresh, _pos("ord", zero, zero)).otherwise(F.col("latest_last_start")).alias("first_seg"), alone.alias("alone"), F.posexplode("pieces").alias("piece", "text"))
    seg = F.when(here == 0, F.col("first_seg")).otherwise(_pos("ord", here, zero))
    # only a text's last piece can end in white space, only its first start with it
    whole = F.when(only, T.strip_whitespace("text")).otherwise(F.col("text"))
    rows = pieces.select("doc_id", seg.alias("seg"), "ord", "piece", whole.alias("text"))
    sized = rows.groupBy("doc_id", "seg").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))
    # of a sentence in many parts only its length meets, unless it is short enough to build;
    # white space at the end of a text is the one thing that may be longer than what is kept
    single = rows.where("text <> ''")
    fits = sized.where((F.col("chars") <= longest) | (F.col("n") == 1)).select("doc_id", "seg")
    single = single.join(fits, ["doc_id", "seg"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "piece", "text")))
    out = single.groupBy("doc_id", "seg").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("sentence"))
    out = out.select("doc_id", F.struct(F.col("seg.o").alias("ord"), F.col("seg.p").alias("piece"), F.col("seg.s").alias("sub")).alias("seq"), "sentence")
    trailing = F.regexp_replace("sentence", f"(?<!{P.WS}){P.WS}++$", "")
    return out.withColumn("sentence", trailing).where(~T.is_blank("sentence"))
