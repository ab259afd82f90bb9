"""Statistical decoding of bytes that are not Unicode, as built-in expressions.

Bytes are read as ISO-8859-1 first, so that a string of U+0000 to U+00FF stands for them. For
each candidate encoding every byte (of a double-byte encoding: every unit) has a class, and each
pair of classes a log-likelihood against chance; an encoding's score is the mean over the bytes
above 0x7F. The sums are plain columns, so that the parts of one file can be scored apart and
added up (:func:`sums`, :func:`winner`). Class tables come from the standard library's codecs.

Single bytes: ``a``/``A`` ASCII letters by case, ``h``/``H`` other letters, ``q`` punctuation and currency,
``s`` other symbols, ``x`` undefined or control, ``.`` the rest of ASCII.

Scoring reads a text a fixed number of times, whatever it holds, and keeps no matches. One symbol
stands for all bytes that no candidate tells apart; two symbols read as one UTF-16 unit are a
pair, and what pairs weigh is added up by counting bits (:func:`_weighed`).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK = "ISO-8859-1"
_BYTES = "".join(map(chr, range(256)))
_HIGH = _BYTES[128:]

# Log-likelihoods of pairs of neighbouring classes (fixed values). Alphabets beside ASCII letters
# (an accented letter stands among them) and alphabets of their own (whole words of high bytes).
_MIXED = {"ah ha": 2.0, "Ah Ha AH HA": 1.0, ".h h. .H qh hq qH aq qa .q q.": 0.5, "hh": -1.0, "HH": -1.0, "aH hH": -3.0, "as sa hs sh Hs sH As sA": -2.0, "ss qs sq": -1.0}
_OWN = {"hh HH": 2.0, "Hh": 1.5, ".H .h h. H. qh qH hq .q q.": 0.5, "hH": -3.0, "ah ha Ah Ha aH Ha AH HA": -3.0, "as sa hs sh Hs sH As sA": -2.0, "ss qs sq": -1.0}
# The most frequent Cyrillic letters, and what a pair of them adds: it tells capitals in one
# encoding from small letters in another.
_FREQUENT, _BOTH_FREQUENT = "оеаинтсрвлкмдпу", 2.0
#: Encoding name: Python codec, pair likelihoods and frequent letters.
SINGLE = {"windows-1252": ("cp1252", _MIXED, ""), "windows-1251": ("cp1251", _OWN, _FREQUENT), "koi8-r": ("koi8_r", _OWN, _FREQUENT)}
_UNDEFINED = -20.0

# Double-byte encodings: first and second bytes of a unit, single bytes that stand alone, and the
# likelihoods of kinds of units by first byte and second byte (fixed values); other units: -2.
# The patterns mean the same in Python and in Java; no two kinds of an encoding share a unit.
DOUBLE = {
    "shift_jis": (r"[\x81-\x9F\xE0-\xFC]", r"[\x40-\x7E\x80-\xFC]", r"[\xA1-\xDF]",
                  {(r"\x82", r"[\x9F-\xF1]"): 3.0, (r"\x83", r"[\x40-\x96]"): 2.0, (r"\x81", r"[\x41-\x7E\x80-\xAC]"): 1.0, (r"[\x88-\x97]", "."): 2.0}),
    "euc_jp": (r"[\x8E\xA1-\xFE]", r"[\xA1-\xFE]", None,
               {(r"\xA4", r"[\xA1-\xF3]"): 3.0, (r"\xA5", r"[\xA1-\xF6]"): 2.0, (r"\xA1", r"[\xA2-\xFE]"): 1.0, (r"[\xB0-\xCF]", "."): 1.5}),
    "gbk": (r"[\x81-\xFE]", r"[\x40-\x7E\x80-\xFE]", None,
            {(r"[\xB0-\xD7]", r"[\xA1-\xFE]"): 2.0, (r"\xA3", r"[\xA1-\xFE]"): 1.0, (r"\xA1", r"[\xA1-\xBF]"): 1.0}),
}
_OTHER_UNIT, _ALONE = -2.0, -1.0
CANDIDATES = (*SINGLE, *DOUBLE)


@cache
def _chars(codec: str) -> list[str]:
    """The 128 characters of the high bytes; an undefined byte stays as it is."""
    out = []
    for code in range(128, 256):
        try:
            out.append(bytes([code]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(code))
    return out


def _class(ch: str) -> str:
    kind = unicodedata.category(ch)
    if ord(ch) < 128:
        return "a" if ch.islower() else "A" if ch.isupper() else "x" if kind == "Cc" and not ch.isspace() else "."
    if kind.startswith("L"):
        return "h" if ch.islower() else "H" if ch.isupper() else "s"
    return "x" if kind in ("Cc", "Cn") else "q" if kind[0] in "PZ" or kind == "Sc" else "s"


def _in(pattern: str | None, byte: str) -> bool:
    return pattern is not None and re.fullmatch(pattern, byte, re.DOTALL) is not None


@cache
def _classes(name: str) -> list[tuple]:
    """What a candidate sees in each of the 256 bytes: of a single-byte encoding the class and
    whether it is a frequent letter, else the places that the byte may take in each kind of unit."""
    if name in SINGLE:
        codec, _, frequent = SINGLE[name]
        return [(_class(c), c.lower() in [*frequent]) for c in (*_BYTES[:128], *_chars(codec))]
    first, second, alone, kinds = DOUBLE[name]
    places = [first, second, alone, r"[\x80-\xFF]", *(place for kind in kinds for place in kind)]
    return [tuple(_in(p, byte) for p in places) for byte in _BYTES]


@cache
def _symbols() -> str:
    """An ASCII symbol for each of the 256 bytes, the same for bytes that no candidate tells apart."""
    found: dict[tuple, str] = {}
    out = "".join(found.setdefault(seen, chr(0x21 + len(found))) for seen in zip(*map(_classes, CANDIDATES), strict=True))
    assert max(out) < _END
    return out


#: Stands behind the symbols of a text; weighs nothing.
_END = "\x7F"


@cache
def _pair_weights(name: str) -> dict[str, float]:
    """Pairs of symbols as UTF-16 units, and what they weigh in a single-byte encoding. The last
    symbol of a text is followed by the end, so that each is the first of one pair."""
    weights = {pair: weight for pairs, weight in SINGLE[name][1].items() for pair in pairs.split()}
    seen = dict(zip(_symbols(), _classes(name), strict=True)) | {_END: ("", False)}

    def weight(one: tuple, other: tuple) -> float:
        return _UNDEFINED if one[0] == "x" else weights.get(one[0] + other[0], 0.0) + _BOTH_FREQUENT * (one[1] and other[1])

    return {_unit(x, y): weight(seen[x], seen[y]) for x in seen for y in seen}


@cache
def _unit_weights(name: str) -> dict[str, float]:
    """What :func:`_units` gives, and what it weighs in a double-byte encoding: a unit has two high
    bytes. Where no single byte stands alone, a unit also makes up for its bytes, which are
    among all the high ones that :func:`scores` takes to be undefined."""
    first, second, alone, kinds = DOUBLE[name]
    byte = dict(zip(_symbols(), _BYTES, strict=True))
    out = {}
    for x, y in ((x, y) for x in byte for y in byte if _in(first, byte[x]) and _in(second, byte[y])):
        weight = 2.0 * next((w for kind, w in kinds.items() if _in(kind[0], byte[x]) and _in(kind[1], byte[y])), _OTHER_UNIT)
        out[_unit(x, y)] = weight if alone else weight - _UNDEFINED * ((byte[x] in _HIGH) + (byte[y] in _HIGH))
    if alone:
        out |= {_unit("\0", x): _ALONE if _in(alone, b) else _UNDEFINED if b in _HIGH else 0.0 for x, b in byte.items()} | {_unit("\0", _END): 0.0}
    return out


def _unit(high: str, low: str) -> str:
    return chr(ord(high) << 8 | ord(low))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def latin(b: Column) -> Column:
    """The bytes as a string of U+0000 to U+00FF."""
    return F.decode(b, "ISO-8859-1")


# Weights are written as characters of three bytes: the number of bits set in them is the weight,
# in steps above the second lowest, and _NO_STEP more.
_MARKS = [chr(0x4000 | ((1 << k) - 1)) for k in range(15)]
_NO_STEP = 6


def _weighed(items: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the characters, all of them in ``weights``, for one look-up each. What
    weighs least loses its character, so its number is that of the characters that are missing."""
    lowest = min(weights.values())
    marked = {item: weight for item, weight in weights.items() if weight != lowest}
    low = min(marked.values())
    step = next(s for s in (1.0, 0.5) if all((w - low) % s == 0 for w in marked.values()))
    marks = "".join(_MARKS[int((w - low) / step)] for w in marked.values())
    unmarked = "".join(item for item in weights if item not in marked)

    def total(found: Column) -> Column:
        n = F.length(found)
        return low * n + step * (F.bitmap_count(found.cast("binary")) - _NO_STEP * n) + lowest * (F.length(items) - n)

    return let(F.translate(items, "".join(marked) + unmarked, marks), total)


def _pairs(symbols: Column) -> Column:
    """All pairs of neighbours as UTF-16 units: those that begin at even places, then the others."""
    n = F.octet_length(symbols)
    even = F.concat(F.substr(symbols, F.lit(1), n - n % 2), F.substr(symbols, F.lit(2), n - 1 - (n - 1) % 2))
    return F.decode(even.cast("binary"), "UTF-16BE")


def _any(pattern: str) -> str:
    """Symbols of the bytes that a pattern matches, for a pattern."""
    return "".join(sorted({re.escape(s) for s, byte in zip(_symbols(), _BYTES, strict=True) if _in(pattern, byte)}))


def _units(symbols: Column, name: str) -> Column:
    """Units of a double-byte encoding as UTF-16 units. Where single bytes may stand alone, what is
    in no unit is filled up to one, but for ASCII, which weighs nothing; else it is left out."""
    first, second, alone, _ = DOUBLE[name]
    # the end is in no unit, so every run of units has a symbol behind it
    run = f"((?:[{_any(first)}][{_any(second)}])*+)(.)"
    plain = _any(r"[\x00-\x7F]") + _END
    rest, kept = (f"[{plain}]*+", "$1\0$2") if alone else (f"[^{_any(first)}]*+", "$1")
    return F.decode(F.regexp_replace(symbols, run + rest, kept).cast("binary"), "UTF-16BE")


def scores(b: Column) -> Column:
    """:func:`sums` as a struct, with what they share computed once."""

    def of_symbols(symbols: Column, high: Column) -> Column:
        singles = lambda pairs: F.array(*[_weighed(pairs, _pair_weights(name)) for name in SINGLE])

        def double(name: str) -> Column:
            weighed = let(_units(symbols, name), lambda units: _weighed(units, _unit_weights(name)))
            return weighed if DOUBLE[name][2] else weighed + _UNDEFINED * high

        return let(
            let(_pairs(symbols), singles),
            lambda s: F.struct(high.alias("high"), *[s[k].alias(name) for k, name in enumerate(SINGLE)], *[double(name).alias(name) for name in DOUBLE]),
        )

    symbols = F.concat(F.translate(latin(b), _BYTES, _symbols()), F.lit(_END))
    high = (F.octet_length(latin(b)) - F.octet_length(b)).cast("double")  # U+0080 to U+00FF have two bytes
    return let(high, lambda h: let(symbols, lambda s: of_symbols(s, h)))


def sums(b: Column) -> list[Column]:
    """The number of bytes above 0x7F and the sum of every candidate, named after it; all
    can be added up over the parts of one text."""
    return [scores(b)[name].alias(name) for name in ("high", *CANDIDATES)]


def winner(high: Column, scores: dict[str, Column]) -> Column:
    """Name of the candidate with the best mean; the first of equal ones, and none that chance
    explains better than the encoding."""
    found = F.array_max(F.array(*[F.struct(scores[c].alias("s"), F.lit(-k).alias("k"), F.lit(c).alias("name")) for k, c in enumerate(CANDIDATES)]))
    return let(found, lambda f: F.when((high > 0) & (f["s"] > -high), f["name"]).otherwise(F.lit(FALLBACK)))


def detect(b: Column) -> Column:
    """Name of the legacy encoding that explains the bytes best."""
    return let(scores(b), lambda s: winner(s["high"], {c: s[c] for c in CANDIDATES}))


# Bytes that begin a surrogate, and those that stand for them in a unit; the latter are in no unit.
_SURROGATES, _INSTEAD = "".join(map(chr, range(0xD8, 0xE0))), "".join(map(chr, range(0x10, 0x18)))


def _has_surrogates(name: str) -> bool:
    return any(_in(DOUBLE[name][0], byte) for byte in _SURROGATES)


@cache
def _unit_table(name: str) -> tuple[str, str]:
    """All units of a double-byte encoding as UTF-16 units, and their characters; U+FFFD: none."""
    first, second, _, _ = DOUBLE[name]
    safe = str.maketrans(_SURROGATES, _INSTEAD) if _has_surrogates(name) else {}
    units, chars = [], []
    for x, y in ((x, y) for x in _HIGH if _in(first, x) for y in _BYTES if _in(second, y)):
        try:
            ch = (x + y).encode("latin-1").decode(name)
        except UnicodeDecodeError:
            ch = ""
        units.append(_unit(x.translate(safe), y.translate(safe)))
        chars.append(ch if len(ch) == 1 else "�")
    return "".join(units), "".join(chars)


def _read_double(text: Column, name: str) -> Column:
    first, second, alone, _ = DOUBLE[name]
    # a run of units, perhaps empty, and what follows it: ASCII, another byte or the end
    pattern = rf"(?s)((?:{first}{second})*+)([\x00-\x7F]++|.|\z)"
    units = F.regexp_replace(text, pattern, "$1\0\0")
    if _has_surrogates(name):
        units = F.translate(units, _SURROGATES, _INSTEAD)
    runs = F.split(F.translate(F.decode(F.encode(units, "ISO-8859-1"), "UTF-16BE"), *_unit_table(name)), "\0")
    others = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    # half-width characters that stand alone are in a block of their own
    half = lambda u: F.when(u < "\x80", u).otherwise(F.translate(u, "".join(map(chr, range(0xA1, 0xE0))), "".join(chr(0xFF61 + k) for k in range(63)))) if alone else u
    return F.array_join(F.zip_with(runs, others, lambda run, other: F.concat(run, half(other))), "")


def decode_as(b: Column, name: Column, among: Iterable[str] = CANDIDATES) -> Column:
    """Text of the bytes in the named encoding: one of ``among``, else ISO-8859-1. (The tables
    of double-byte encodings are large, so a caller who knows the names should give them.)"""
    text = latin(b)
    out = text
    for c in among:
        read = F.translate(text, _HIGH, "".join(_chars(SINGLE[c][0]))) if c in SINGLE else _read_double(text, c)
        out = F.when(name == c, read).otherwise(out)
    return out


# --- UTF-16 ---------------------------------------------------------------------------------
_PLAIN, _LEAD, _TRAIL = "(?:[0-9A-CEF][0-9A-F]|D[0-7])", "D[89AB]", "D[C-F]"
_ANY = "[0-9A-F]{2}"


def is_utf16(body: Column, little: bool) -> Column:
    """Whether the bytes (without a mark) are whole UTF-16 units with paired surrogates. Matches
    follow each other without a gap, some units at a time, so nothing recurses."""
    unit = (lambda high: _ANY + high) if little else (lambda high: high + _ANY)
    valid = rf"\G(?:(?:{unit(_PLAIN)}){{1,64}}+|{unit(_LEAD)}{unit(_TRAIL)})"
    return F.length(F.regexp_replace(F.hex(body), valid, "")) == 0
