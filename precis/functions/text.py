"""Column functions: every text step as a built-in Spark SQL expression.

Each function takes a :class:`~pyspark.sql.Column` and returns a Column, so it
can be used in ``select``/``withColumn``/``where`` on any DataFrame. Nothing
here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LONG_SENTENCE_RESPLIT, MIN_VALID_SENTENCE_CHARS
from . import encodings as E
from . import patterns as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- whitespace -------------------------------------------------------------------
def squeeze_whitespace(c) -> Column:
    """Collapse every white-space run to one space and strip both ends."""
    return F.trim(F.regexp_replace(_col(c), P.WS_RUN, " "))


def strip_whitespace(c) -> Column:
    """Strip white space (the full Unicode set) from both ends."""
    # the trailing run is matched from its first character only (linear time)
    return F.regexp_replace(_col(c), f"^{P.WS}++|(?<!{P.WS}){P.WS}++$", "")


def is_blank(c) -> Column:
    """True for an empty or white-space-only string."""
    return ~_col(c).rlike(P.NOT_WS)


# --- sentence splitters (one array per text, order kept) -----------------------------
def split_raw(c) -> Column:
    """Plain split after ``.``, ``!`` or ``?`` plus white space.

    Pieces keep their white space and blank pieces are dropped; only the last
    piece (possibly empty when the text ends with a sentence end) is stripped.
    The last piece is recognised by an end-of-text mark, so the split is
    evaluated once.
    """
    pieces = F.split(F.concat(_col(c), F.lit(P.END)), P.RAW_SPLIT)

    def finish(p: Column) -> Column:
        return F.when(p.endswith(P.END), strip_whitespace(F.replace(p, F.lit(P.END), F.lit("")))).otherwise(p)

    return F.filter(F.transform(pieces, finish), lambda s: s.rlike(P.NOT_WS))


def mark_breaks(c) -> Column:
    """Squeezed text with sentence breaks marked.

    Abbreviations, initials and numbers followed by a lower-case word keep
    their space (as a protected one) so they do not end a sentence.
    """
    t = F.regexp_replace(squeeze_whitespace(c), P.GUARDS, "." + P.GUARD)
    t = F.regexp_replace(t, P.NUMBER_GUARD, "$1" + P.GUARD)
    return F.regexp_replace(t, P.BREAKS, "$1$2" + P.BREAK)


def split_clean(c) -> Column:
    """Clean split: squeeze, split at sentence ends (abbreviation-aware),
    re-split pieces longer than 200 characters at every ``[.!?]`` + space,
    strip, and keep pieces of at least 10 characters holding a letter."""
    pieces = F.split(F.replace(mark_breaks(c), F.lit(P.GUARD), F.lit(" ")), P.BREAK)

    def resplit(p: Column) -> Column:
        return F.when(F.length(p) > LONG_SENTENCE_RESPLIT, F.split(p, P.RESPLIT)).otherwise(F.array(p))

    sentences = F.transform(F.flatten(F.transform(pieces, resplit)), lambda s: F.trim(s))
    return F.filter(sentences, is_valid_sentence)


def is_valid_sentence(c) -> Column:
    """Clean-splitter validity: at least 10 characters and at least one letter.

    (Holding a letter already implies "not only punctuation".)
    """
    c = _col(c)
    return (F.length(c) >= MIN_VALID_SENTENCE_CHARS) & c.rlike(P.HAS_LETTER)


def split_abbrev(c) -> Column:
    """Split with the abbreviation-aware look-around pattern
    ``(?<!\\w\\.\\w.)(?![A-Z][a-z]\\.)(?<=\\.|\\?|\\!)\\s`` (an operator of its own; the
    summaries do not use it)."""
    w = r"[\p{L}\p{N}_]"  # a Unicode word character (Java's \w is ASCII-only)
    return F.split(_col(c), rf"(?<!{w}\.{w}.)(?![A-Z][a-z]\.)(?<=\.|\?|\!)" + P.WS)


# --- word tokens --------------------------------------------------------------------
def _spaced(c) -> Column:
    t = F.lower(_col(c))
    t = F.regexp_replace(t, P.FINAL_PERIOD, " $1")
    t = F.regexp_replace(t, P.INNER_PERIOD, " $1")
    t = F.regexp_replace(t, P.COMMA_COLON, " $1")
    t = F.regexp_replace(t, P.COMMA_COLON_END, " ")
    t = F.regexp_replace(F.regexp_replace(t, P.SEPARATORS, " "), P.MULTI_SEPARATORS, " ")
    return F.concat(F.lit(" "), t, F.lit(" "))


# Rare rules run only on sentences that can match them (a cheap substring test).
def _quotes(t: Column) -> Column:
    quoted = F.regexp_replace(F.regexp_replace(t, P.OPENING_QUOTE, "' $1"), P.CLITICS, "$1 $2 ")
    return F.when(t.contains("'"), quoted).otherwise(t)


def _contractions(t: Column) -> Column:
    maybe = t.contains("nnot") | t.contains("mme") | t.contains("nna") | t.contains("tta")
    return F.when(maybe, F.regexp_replace(t, P.CONTRACTIONS, "$1 ")).otherwise(t)


def normalize_tokens(c) -> Column:
    """Lower-case and space out punctuation the way a Treebank-style word
    tokenizer does; the result is padded with one space on each side."""
    return _contractions(_quotes(_spaced(c)))


def terms_of_one(c: Column) -> Column:
    """:func:`terms` for use inside an array function, where Spark does not share what an
    expression repeats: every step is bound once."""
    last = lambda t: F.regexp_extract_all(_contractions(t), F.lit(P.KEPT_TERM), 1)
    return E.let(_spaced(c), lambda t: E.let(_quotes(t), last))


def terms(c, stop_words=None) -> Column:
    """Filtered word tokens of a sentence (letters/digits only, no stop words,
    duplicates and order kept) as ``ARRAY<STRING>``. ``stop_words``: lower-case words
    instead of the English list."""
    pattern = P.KEPT_TERM if stop_words is None else P.kept_term(stop_words)
    return F.regexp_extract_all(normalize_tokens(c), F.lit(pattern), 1)


def terms_by_language(c, lang, stop_words: dict) -> Column:
    """:func:`terms` with the stop list of each row's language; a language without a
    list (or null) loses no words. Tokens are computed once, whatever the list."""
    pattern = F.lit(P.kept_term(()))
    for language, words in stop_words.items():
        pattern = F.when(_col(lang) == language, F.lit(P.kept_term(words))).otherwise(pattern)
    return F.regexp_extract_all(normalize_tokens(c), pattern, 1)


def preprocess_text(c) -> Column:
    """Lower-case and delete every character that is neither a word character
    nor white space."""
    return F.regexp_replace(F.lower(_col(c)), P.NON_WORD, "")


# --- chunks ---------------------------------------------------------------------------
def chunks(c, size: int) -> Column:
    """A text cut into slices of ``size`` characters, found in one pass over it."""
    return F.regexp_extract_all(_col(c), F.lit(rf"(?s).{{1,{size}}}+"), F.lit(0))


# --- HTML -------------------------------------------------------------------------------
def _decode_entities(t: Column) -> Column:
    """Character references: named ones (with their semicolon, or the old names
    without), decimal and hexadecimal ones. The text is cut at ``&`` and each piece is
    looked up by its start; what is no reference stays as it is."""

    def named(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^[A-Za-z][A-Za-z0-9]*;?", 0)
        char = F.element_at(F.from_json(F.lit(P.HTML_NAMES), "map<string,string>"), name)
        return F.concat(char, F.substr(piece, F.length(name) + 1))

    def numbered(piece: Column) -> Column:
        mark = F.regexp_extract(piece, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        digits = F.regexp_extract(mark, r"[0-9a-fA-F]+", 0)
        value = F.when(F.lower(mark).startswith("#x"), F.conv(digits, 16, 10)).otherwise(digits)
        code = F.coalesce(value.try_cast("long"), F.lit(-1))
        code = F.coalesce(F.element_at(F.from_json(F.lit(P.HTML_CODES), "map<string,bigint>"), code.cast("string")), code)
        usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(usable, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(F.length(mark) > 0, F.concat(char, F.substr(piece, F.length(mark) + 1)))

    pieces = F.split(t, "&")
    read = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.coalesce(F.when(p.startswith("#"), numbered(p)).otherwise(named(p)), F.concat(F.lit("&"), p))))
    return F.when(t.contains("&"), F.array_join(read, "")).otherwise(t)


def html_to_text(c) -> Column:
    """Visible text of an HTML document, text nodes joined by one space.

    Markup is read by one token grammar: script/style blocks (closed or not) and
    comments are dropped, tags may hold ``>`` in quoted values, every token becomes
    a space, entities are decoded and white space is squeezed.
    """
    return squeeze_whitespace(_decode_entities(F.regexp_replace(_col(c), P.HTML_MARKUP, " $2 ")))


def html_to_text_glued(c) -> Column:
    """Visible text of an HTML document with text nodes glued together (no
    separator, no stripping)."""
    return _decode_entities(F.regexp_replace(_col(c), P.HTML_MARKUP, "$2"))


# --- bytes -----------------------------------------------------------------------------
def encoding_of(c) -> Column:
    """Encoding of file bytes: ``UTF-16LE``/``UTF-16BE`` where a byte-order mark stands
    before whole units with paired surrogates, else ``UTF-8`` where the bytes are valid, else
    the legacy encoding that explains them best (:mod:`.encodings`)."""
    return E.let(_col(c), _encoding_of)


def _encoding_of(b: Column) -> Column:
    head = F.hex(F.substring(b, 1, 2))
    body = F.substring(b, 3, 2147483647)
    little = (head == "FFFE") & E.is_utf16(body, True)
    big = (head == "FEFF") & E.is_utf16(body, False)
    return F.when(little, F.lit("UTF-16LE")).when(big, F.lit("UTF-16BE")).when(F.is_valid_utf8(b), F.lit("UTF-8")).otherwise(E.detect(b))


def decode_as(c, encoding) -> Column:
    """Text of file bytes in the encoding that :func:`encoding_of` names, without the
    byte-order mark. Never fails where that name came from the same bytes."""
    b, name = _col(c), _col(encoding)
    body = F.substring(b, 3, 2147483647)
    unmarked = F.when(F.hex(F.substring(b, 1, 3)) == "EFBBBF", F.substring(b, 4, 2147483647)).otherwise(b)
    return (
        F.when(name == "UTF-16LE", F.decode(body, "UTF-16LE"))
        .when(name == "UTF-16BE", F.decode(body, "UTF-16BE"))
        .when(name == "UTF-8", F.decode(unmarked, "UTF-8"))
        .otherwise(E.decode_as(b, name))
    )


def decode_bytes(c) -> Column:
    """Text of file bytes in whatever encoding they are (:func:`encoding_of`); any bytes
    can be read."""
    return E.let(_col(c), lambda b: E.let(_encoding_of(b), lambda name: decode_as(b, name)))


def file_extension(c) -> Column:
    """Lower-cased text after the last dot of the file name (the last ``/``
    part of a path)."""
    name = F.element_at(F.split(_col(c), "/"), -1)
    return F.lower(F.element_at(F.split(name, r"\."), -1))
