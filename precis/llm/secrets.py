"""Secret scan: fixed patterns, and a linear-chain conditional random field.

Tokens are runs of letters and ``+/_.=-`` or runs of other marks. The field tags
each as the beginning of a secret (B), inside one (I) or outside (O), from its shape,
its neighbours' shapes, the word before it and features of the whole file, and is
decoded by Viterbi. It learns from the fixed patterns' own spans in a bounded sample
(``SAMPLE`` documents, of which windows of tokens reach the driver) and so finds
tokens that look and stand like secrets without matching a pattern. Its spans are
added where they overlap no pattern span; pattern spans always stay.

A token is certainly outside if its score for O leads by more than any change of two
transitions can bring. Chains are cut at such tokens, which leaves the best path as
it is, so only the short runs between them are decoded step by step.

Null texts are empty. Without a pattern span in the sample the field tags nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .labelled import drawn

#: Documents read for fitting, at most.
SAMPLE = 20_000
#: Tokens on either side of a span in the sample; one document in so many also gives windows without one.
AROUND = 12
BACKGROUND = 8
STEPS = 120
SEED = 31

# Fixed patterns (values that must match): kind, pattern, least length of the match or group.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(ACCESS)
# a maximal run of hexadecimal digits, long enough: the same as dropping the short runs
_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LEAST},}}")
_HINTS = ("passw", "secret", "token", "api")


def base_spans(text: str, long_hex: bool = True) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the fixed patterns, by start and then kind."""
    out = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if long_hex:
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_ranges(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves stand: a pattern's value, without its name."""
    out = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [s[1:] for s in base_spans(text) if s[0] != "assign"]
    return sorted(out)


# --- tokens and features -----------------------------------------------------------
_U = np.uint64
# Byte classes: 0 white space, 1 token characters, 2 other marks.
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[[ord(c) for c in "+/_.=-"]] = 1
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_DIGIT = np.zeros(256, np.int8)
_DIGIT[48:58] = 1
_UPPER = np.zeros(256, np.int8)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int8)
_LOWER[97:123] = _LOWER[128:] = 1
_HEXDIGIT = np.zeros(256, np.int8)
_HEXDIGIT[48:58] = _HEXDIGIT[97:103] = 1

_LENGTHS = np.array([2, 4, 8, 12, 16, 20, 24, 32, 40, 64])
_SHAPES = 16 * 11
_WORDS = 1 << 12
#: Sizes of the feature templates: shape, hex run, digit share, switches, shapes before and
#: after, assignment marks, word before, file.
SIZES = (_SHAPES, 11 + 1, 8, 8, _SHAPES + 1, _SHAPES + 1, 16, _WORDS, 16)
_BASES = np.concatenate(([0], np.cumsum(SIZES)[:-1]))
N_FEATURES = int(sum(SIZES))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ``starts`` and ``ends`` of tokens and each document's first token."""
    kind = _CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[(offsets > 0) & (offsets < len(data))]] = True
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], len(data))
    inked = kind[runs] > 0 if len(runs) else np.zeros(0, bool)
    starts, ends = runs[inked], ends[: len(runs)][inked]
    return starts, ends, np.searchsorted(starts, offsets)


def _between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=sums[1:])
    return sums[ends] - sums[starts]


def features(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hasher: A.WordHasher) -> np.ndarray:
    """One row of feature ids a token, one for each template."""
    n = len(starts)
    length = (ends - starts).astype(np.int32)
    digits, uppers = _between(_DIGIT[data], starts, ends), _between(_UPPER[data], starts, ends)
    lowers, hexes = _between(_LOWER[data], starts, ends), _between(_HEXDIGIT[data], starts, ends)
    kind = 1 * (_DIGIT[data] > 0) + 2 * ((_UPPER[data] > 0) | (_LOWER[data] > 0))
    turn = np.zeros(len(data), np.int8)
    turn[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    switches = _between(turn, starts, ends)
    marks = length - digits - uppers - lowers
    bucket = np.searchsorted(_LENGTHS, length, side="right")
    shape = ((digits > 0) + 2 * (uppers > 0) + 4 * (lowers > 0) + 8 * (marks > 0)) * 11 + bucket
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    opens, closes = np.zeros(n, bool), np.zeros(n, bool)
    opens[first[:-1][np.diff(first) > 0]] = True
    closes[first[1:][np.diff(first) > 0] - 1] = True
    before, after = np.roll(shape, 1), np.roll(shape, -1)
    before[opens], after[closes] = _SHAPES, _SHAPES
    sets = (data == 61) | (data == 58)
    quotes = (data == 34) | (data == 39)
    setting, quoted = _between(sets, starts, ends) > 0, _between(quotes, starts, ends) > 0

    def earlier(flags: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, bool)
        out[by:] = flags[:-by] & (doc[by:] == doc[:-by])
        return out

    assigned = 1 * earlier(setting, 1) + 2 * earlier(setting, 2) + 4 * earlier(quoted, 1) + 8 * setting
    lower = A.lower_ascii(data)
    worded = _CLASS[data[starts]] == 1 if n else np.zeros(0, bool)
    word = (hasher(lower, starts, ends) % _U(_WORDS - 1)).astype(np.int64) + 1 if n else np.zeros(0, np.int64)
    # the last word of letters before a token, at most four tokens back
    at = np.where(worded & (length > 2) & (digits == 0), np.arange(n), -1)
    last = np.maximum.accumulate(at) if n else at
    last = np.concatenate(([-1], last[:-1])) if n else last
    near = (last >= 0) & (np.arange(n) - last <= 4)
    near[near] &= doc[last[near]] == doc[np.flatnonzero(near)]
    previous = np.where(near, word[np.maximum(last, 0)], 0) if n else word
    size = np.maximum(np.diff(offsets), 1)
    full = np.flatnonzero(np.diff(offsets) > 0)
    dense = np.zeros(len(size))
    marked = np.zeros(len(size))
    if len(full):
        dense[full] = np.add.reduceat(_DIGIT[data], offsets[:-1][full], dtype=np.int64) / size[full]
        marked[full] = np.add.reduceat(sets, offsets[:-1][full], dtype=np.int64) / size[full]
    of_file = 4 * np.searchsorted([0.002, 0.01, 0.05], dense) + np.searchsorted([0.0005, 0.002, 0.01], marked)
    columns = (
        shape,
        np.where((hexes == length) & (length > 0), bucket + 1, 0),
        np.minimum(8 * digits // np.maximum(length, 1), 7),
        np.searchsorted([1, 2, 3, 5, 8, 12, 18], switches, side="right"),
        before,
        after,
        assigned,
        previous,
        of_file[doc] if n else shape,
    )
    return np.stack([c + b for c, b in zip(columns, _BASES, strict=True)], axis=1).astype(np.int32)


# --- the field --------------------------------------------------------------------------
O, B, I = 0, 1, 2  # noqa: E741


class Field:
    """Emission weights by feature and tag, and transition weights."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move

    def scores(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), 3))
        for k in range(ids.shape[1]):
            out += self.emit[ids[:, k]]
        return out

    def decode(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best tags of all documents' chains."""
        tags = np.zeros(len(scores), np.int8)
        lead = scores[:, O] - np.maximum(scores[:, B], scores[:, I])
        open_ = lead <= 2 * (self.move.max() - self.move.min())
        at = np.flatnonzero(open_)
        if not len(at):
            return tags
        cuts = np.zeros(len(scores) + 1, bool)
        cuts[first] = True
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | cuts[at[1:]]
        runs = np.flatnonzero(new)
        for a, b in zip(at[runs].tolist(), np.append(at[runs[1:] - 1], at[-1]).tolist(), strict=True):
            # O on either side, but nothing at a document's ends
            tags[a : b + 1] = self._best(scores[a : b + 1], not cuts[a], not cuts[b + 1])
        return tags

    def _best(self, scores: np.ndarray, after_o: bool, before_o: bool) -> np.ndarray:
        value = scores[0] + (self.move[O] if after_o else 0.0)
        back = np.zeros((len(scores), 3), np.int8)
        for t in range(1, len(scores)):
            ways = value[:, None] + self.move
            back[t] = ways.argmax(axis=0)
            value = ways.max(axis=0) + scores[t]
        if before_o:
            value = value + self.move[:, O]
        tags = np.zeros(len(scores), np.int8)
        tags[-1] = int(value.argmax())
        for t in range(len(scores) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


def fit(windows: list[np.ndarray], tags: list[np.ndarray]) -> Field:
    """Maximum likelihood by forward-backward over padded windows (Adam, full batch)."""
    emit, move = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    if not any((t == B).any() for t in tags):
        emit[: SIZES[0], O] = 10.0
        return Field(emit, move)
    longest = max(map(len, windows))
    n, width = len(windows), windows[0].shape[1]
    ids = np.zeros((longest, n, width), np.int64)
    gold = np.zeros((longest, n), np.int64)
    live = np.zeros((longest, n), bool)
    for i, (w, t) in enumerate(zip(windows, tags, strict=True)):
        ids[: len(w), i], gold[: len(t), i], live[: len(t), i] = w, t, True
    flat, on = ids.reshape(-1, width), live.reshape(-1)
    counts = np.zeros_like(emit)
    for k in range(width):
        np.add.at(counts, (flat[on, k], gold.reshape(-1)[on]), 1)
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (gold[:-1][live[1:]], gold[1:][live[1:]]), 1)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (emit, move)]
    for step in range(1, STEPS + 1):
        scores = sum(emit[ids[:, :, k]] for k in range(width))
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0]
        for t in range(1, longest):
            ways = ahead[t - 1][:, :, None] + move[None]
            top = ways.max(axis=1)
            new = top + np.log(np.exp(ways - top[:, None, :]).sum(axis=1)) + scores[t]
            ahead[t] = np.where(live[t][:, None], new, ahead[t - 1])
        total = np.logaddexp.reduce(ahead[-1], axis=1)
        for t in range(longest - 2, -1, -1):
            ways = move[None] + (scores[t + 1] + behind[t + 1])[:, None, :]
            top = ways.max(axis=2)
            new = top + np.log(np.exp(ways - top[:, :, None]).sum(axis=2))
            behind[t] = np.where(live[t + 1][:, None], new, 0.0)
        share = np.exp(ahead + behind - total[None, :, None]) * live[:, :, None]
        expected = np.zeros_like(emit)
        by_token = share.reshape(-1, 3)[on]
        for k in range(width):
            for tag in (O, B, I):
                expected[:, tag] += np.bincount(flat[on, k], by_token[:, tag], N_FEATURES)
        both = ahead[:-1][:, :, :, None] + move[None, None] + (scores[1:] + behind[1:])[:, :, None, :] - total[None, :, None, None]
        moved = (np.exp(both) * live[1:][:, :, None, None]).sum(axis=(0, 1))
        for p, g, (m, v) in zip((emit, move), ((expected - counts) / n + 2e-4 * emit, (moved - pairs) / n + 2e-3 * move), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        np.clip(move, -2.0, 2.0, out=move)
    return Field(emit, move)


# --- Spark ------------------------------------------------------------------------------
def _char_starts(data: np.ndarray) -> np.ndarray:
    """Code points before every byte position (one entry more than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = A.WordHasher()
    for batch in batches:
        picks = batch.column("pick").to_pylist()
        texts = batch.column("text")
        for at, data, offsets in A.slices(texts):
            starts, ends, first = tokens(data, offsets)
            ids = features(data, offsets, starts, ends, first, hasher)
            chars = _char_starts(data)
            out_ids, out_tags = [], []
            for d in range(len(offsets) - 1):
                a, b = int(first[d]), int(first[d + 1])
                if a == b:
                    continue
                tags = np.zeros(b - a, np.int8)
                origin = chars[offsets[d]]
                lo, hi = chars[starts[a:b]] - origin, chars[ends[a:b]] - origin
                for s, e in secret_ranges(texts[at + d].as_py() or ""):
                    inside = np.flatnonzero((lo < e) & (hi > s) & (tags == O))
                    tags[inside] = I
                    tags[inside[:1]] = B
                marked = np.flatnonzero(tags == B).tolist()
                if not marked and picks[at + d] % BACKGROUND == 0:
                    marked = [picks[at + d] // BACKGROUND % (b - a)]
                for k in marked[:4]:
                    s, e = max(0, k - AROUND), min(b - a, k + AROUND + 1)
                    out_ids.append(ids[a + s : a + e].ravel())
                    out_tags.append(tags[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.list_(pa.int32())), pa.array(out_tags, pa.list_(pa.int8()))], names=["ids", "tags"])


def train(docs: DataFrame) -> Field:
    """Fit on token windows of a bounded sample of the documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = drawn(texts, SAMPLE, SEED).select("text", F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1 << 30)).alias("pick"))
    got = rows.mapInArrow(_windows, "ids array<int>, tags array<byte>").limit(SAMPLE // 2).collect()
    width = len(SIZES)
    return fit([np.array(r["ids"], np.int64).reshape(-1, width) for r in got], [np.array(r["tags"], np.int8) for r in got])


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """Per document the pattern counts, the digest of the pattern spans and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = A.WordHasher()
        for batch in batches:
            texts = batch.column("text")
            for at, data, offsets in A.slices(texts):
                n = len(offsets) - 1
                starts, ends, first = tokens(data, offsets)
                tags = field.decode(field.scores(features(data, offsets, starts, ends, first, hasher)), first)
                hit = np.flatnonzero(tags != O)
                doc_of = np.searchsorted(first, hit, side="right") - 1
                chars = _char_starts(data) if len(hit) else None
                hexes = _long_runs(_HEXDIGIT[data] > 0, offsets)
                found: dict[int, list[tuple[int, int]]] = {}
                for i, d in zip(hit.tolist(), doc_of.tolist(), strict=True):
                    s, e = int(chars[starts[i]] - chars[offsets[d]]), int(chars[ends[i]] - chars[offsets[d]])
                    own = found.setdefault(d, [])
                    if tags[i] == I and own and i - 1 >= first[d] and tags[i - 1] != O:
                        own[-1] = (own[-1][0], e)
                    else:
                        own.append((s, e))
                out: list[list] = [[] for _ in range(6)]
                for d in range(n):
                    base = base_spans(texts[at + d].as_py() or "", bool(hexes[d]))
                    own = [("crf", s, e) for s, e in found.get(d, ()) if not any(s < y and x < e for _, x, y in base)]
                    listed = ",".join([f"{k}:{s}:{e}" for k, s, e in base])
                    every = sorted(base + own, key=lambda x: (x[1], KINDS.index(x[0])))
                    kinds = [k for k, _, _ in base]
                    row = (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(listed.encode()).hexdigest(), ",".join([f"{k}:{s}:{e}" for k, s, e in every]), len(own))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), *columns], names=[c.split()[0] for c in OUT.split(", ")])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, OUT)


def _long_runs(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each document may hold a run of ``HEX_LEAST`` set flags."""
    stops = np.flatnonzero(~flags)
    gaps = np.diff(np.concatenate(([-1], stops, [len(flags)])))
    at = np.concatenate(([0], stops + 1))[gaps > HEX_LEAST]
    length = gaps[gaps > HEX_LEAST] - 1
    out = np.zeros(len(offsets) - 1, bool)
    for s, size in zip(at.tolist(), length.tolist(), strict=True):  # a run may span documents: all of them are looked at
        lo, hi = np.searchsorted(offsets, [s, s + size], side="right") - 1
        out[lo : min(hi, len(out) - 1) + 1] = True
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` and scan all of them."""
    return scan(docs, train(docs))
