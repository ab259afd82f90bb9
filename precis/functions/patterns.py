"""Regular expressions used by the column functions (Java regex syntax).

All text work runs as built-in Spark SQL expressions (``regexp_replace``,
``split``, ``regexp_extract_all``), so it stays inside whole-stage codegen and
never leaves the JVM.
"""

from __future__ import annotations

import html.entities
import json

from ..config import ABBREVIATIONS, STOP_WORDS

# Characters Python's ``str.isspace`` treats as white space, written out so the
# JVM matches the same set (Java's ``\s`` is ASCII-only).
WS_CLASS = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = f"[{WS_CLASS}]"
NOT_WS = f"[^{WS_CLASS}]"


def _any_of(chars) -> str:
    """A class of single characters; Java tests those of Latin-1 by one look at a bit set,
    which ranges and intersections prevent."""
    return "[" + "".join(rf"\x{{{ord(c):X}}}" for c in chars) + "]"


# A run of white space that is not one plain space. Printable ASCII is ruled out by one test.
_PLAIN = _any_of(map(chr, range(0x21, 0x7F)))
WS_RUN = rf"(?!{_PLAIN})(?! {_PLAIN})(?! (?!{WS})){WS}++"

# Marks inside the splitters: Unicode noncharacters, which the standard keeps for
# internal use and which no text carries (control characters do occur in texts).
BREAK = "\ufdd0"  # a sentence break
GUARD = "\ufdd1"  # a protected space
END = "\ufdd2"  # the end of a text in the raw splitter

# --- clean splitter -----------------------------------------------------------
_abbrev = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
# Not a break: an abbreviation or single-letter initial followed by a space. The
# pattern starts at the period (a cheap literal test) and looks behind for the
# word, without consuming the boundary before it, so chains ("A. B. C.") are
# all kept. Replaced by ".<GUARD>".
GUARDS = rf"\.(?<=(?:^|[ (])(?:{_abbrev}|\p{{L}})\.) "
# Nor is a number of any length ending in a period before a lower-case word.
# Here and below, what a match starts with stands first: a place that cannot match is
# left after one test, before any group or look-behind is tried there.
NUMBER_GUARD = rf"(?=\p{{Nd}})(?<![^ ({GUARD}])(\p{{Nd}}[\p{{Nd}}.,-]*\.) (?=\p{{Ll}})"
# A sentence end: a run of . ! ? with optional closing quotes/brackets before a
# space (the space is replaced), or directly before punctuation that cannot
# be inside a word.
# Runs are matched from their first character only and possessively, so a long
# run of punctuation costs linear time (a match can only start at a run start).
BREAKS = r"""(?=[.!?])(?<![.!?])([.!?]++)(?:(["')\]}]*+) |(?=[;:@*({\[]))"""
# Re-split of long pieces: after ., ! or ? followed by white space.
RESPLIT = r"(?= )(?<=[.!?]) +"

# --- raw splitter ---------------------------------------------------------------
RAW_SPLIT = rf"(?<=[.!?]){WS}+"

# --- word tokenizer -------------------------------------------------------------
OPENING_QUOTE = r"'(?!re|ve|ll|m|t|s|d|n)([\p{L}\p{N}_])(?![\p{L}\p{N}_])"
FINAL_PERIOD = rf"""\.(?<=[^.]\.)([\])}}>"'»”’]*+){WS}*+$"""
# the character before the period must not belong to the match before
INNER_PERIOD = r"\.(?<=[^.]\.)(?<!\G\.)([!?]*+[;:@*({\[])"
COMMA_COLON = r"[:,]([^\p{Nd}])"
COMMA_COLON_END = r"[:,]$"
# Single characters a Treebank-style tokenizer always splits off (fixed values),
# and white space other than a plain space; the multi-character ones have their own pattern.
SEPARATOR_CHARS = ';@#$%&?!*()[]{}<>"«“‘„»”’`'
_LOWER = "abcdefghijklmnopqrstuvwxyz0123456789"
SEPARATORS = rf"(?!{_any_of(_LOWER + ' ')})[{_any_of(SEPARATOR_CHARS)}{WS_CLASS}]"
MULTI_SEPARATORS = r"(?=[.'-])(?:\.\.+|--|'')+"
CLITICS = r"([^' ])('s|'m|'d|'ll|'re|'ve|n't|') "
CONTRACTIONS = (
    r"(?<![\p{L}\p{N}_])(can(?=not(?![\p{L}\p{N}_]))|gim(?=me(?![\p{L}\p{N}_]))"
    r"|lem(?=me(?![\p{L}\p{N}_]))|gon(?=na(?![\p{L}\p{N}_]))"
    r"|got(?=ta(?![\p{L}\p{N}_]))|wan(?=na ))"
)


def _trie_pattern(words) -> str:
    """Alternation of ``words`` shaped as a prefix tree, so a token start
    tests a few branches instead of every word."""
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node) -> str:
        alts = [ch + emit(node[ch]) for ch in sorted(k for k in node if k)]
        if not alts:
            return ""
        body = alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"
        return f"(?:{body})?" if "" in node else body

    return emit(root)


def kept_term(stop_words) -> str:
    """A whole space-delimited token made of letters/digits only, not a stop word: group 1,
    behind its space."""
    words = [w for w in stop_words if w]
    stop = f"(?!(?:{_trie_pattern(words)}) )" if words else ""
    return rf" (?! ){stop}({_any_of(_LOWER)}*+[\p{{L}}\p{{N}}]*+)(?= )"


KEPT_TERM = kept_term(STOP_WORDS)

# --- sentence validity ------------------------------------------------------------
HAS_LETTER = r"\p{L}"

# --- HTML ---------------------------------------------------------------------------
# One grammar of markup tokens, matched from left to right, so that what looks like another
# token inside one is no token: comments; script and style with their contents, to the end of
# the text if they are not closed; CDATA, whose text (group 2) stays; declarations and end
# tags; start tags, which end at the first ">" outside a quoted value. A value in quotes
# follows "="; one never closed is plain text. (Quotes of the first 64 values count.)
_ATTRIBUTES = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+){0,64}+[^>]*+"""
HTML_MARKUP = (
    rf"(?is)<(?:!--.*?-->|(script|style)(?=[\s/>]){_ATTRIBUTES}(?<!/)>.*?(?:</\1\s*+>|\z)"
    rf"|!\[CDATA\[(.*?)\]\]>|(?!!--)[!?/][^>]*+>|[a-z]{_ATTRIBUTES}>)"
)
# Character references by name, and the codes that HTML reads as another character
# (the Windows-1252 range), both from the standard library.
HTML_NAMES = json.dumps(html.entities.html5)
HTML_CODES = json.dumps({code: ord(bytes([code]).decode("cp1252")) for code in range(0x80, 0xA0) if code not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)})

# preprocess_text: keep word characters and white space only.
NON_WORD = rf"[^\p{{L}}\p{{N}}_{WS_CLASS}]"
