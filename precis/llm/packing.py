"""Best-fit packing of tokenised documents with certified bin counts.

A document's ids are those of the byte-level tokenizer plus an end id; only longer
ones than ``CAPACITY`` are cut, into full pieces behind one shorter first piece.
Pieces are then packed by best-fit decreasing, partition by partition. A
dual-feasible-function lower bound (Martello and Toth's thresholds) certifies each
partition's bin count. A partition that meets its bound keeps all bins but the
loose ones; one with a gap keeps its full bins only. The pieces of the others are
dealt out anew among all partitions and packed again, for ``ROUNDS`` exchanges or
until one partition holds what is left.

Only piece sizes and ids move between tasks, never texts. Partitions hold about
``PARTITION_PIECES`` pieces. A null text is empty: it is packed as its end id.
Repeated rows are packed one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k"
#: Pieces that one task packs, about.
PARTITION_PIECES = 8_192
#: A partition that meets its bound keeps the bins that are at least so full.
TIGHT = 0.9
#: Partitions exchange their open pieces as long as that leaves at most this share of them open.
CLOSING = 0.9
#: White space in one run from which a text goes to the slower, equal encoder.
LONG_RUN = 5_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(folder: str | None = None):
    """``text -> ids`` of the tokenizer file as it stands, with its added token
    (``folder``: where the public vocabulary files lie; default: their package).

    The rank file gives the ids of the ``tokenizers`` file several times faster;
    texts with a very long run of white space go to ``tokenizers`` itself.
    """
    import base64
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    place = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
    with open(place(f"{TOKENIZER}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding(TOKENIZER, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    run = re.compile(rf"\s{{{LONG_RUN}}}")
    slow = None

    def encode(text: str) -> list[int]:
        nonlocal slow
        if len(text) > LONG_RUN and run.search(text):
            if slow is None:
                slow = Tokenizer.from_file(place(f"{TOKENIZER}.json"))
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return encode


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document of ``n`` ids: the first may be shorter."""
    head = n % capacity
    return ([head] if head else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                start = 0
                for k, length in enumerate(cut_lengths(len(ids))):
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
                    start += length
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins that any packing needs, by the dual feasible functions that drop
    items below a threshold and count those above the rest as full."""
    lengths = np.sort(np.asarray(lengths, dtype=np.int64))
    if not len(lengths):
        return 0
    sums = np.concatenate(([0], np.cumsum(lengths)))
    best = -(-int(sums[-1]) // capacity)
    for least in np.unique(lengths[lengths <= capacity // 2]):
        lo, half, hi = np.searchsorted(lengths, [least, capacity // 2 + 1, capacity - least + 1])
        whole = len(lengths) - hi
        large = hi - half
        room = large * capacity - int(sums[hi] - sums[half])
        best = max(best, whole + large + max(0, -(-(int(sums[half] - sums[lo]) - room) // capacity)))
    return max(best, int((lengths > capacity // 2).sum()))


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: ``(bin, offset)`` of every item and the fill of every bin.
    Bins wait in stacks by room left; a bit mask finds the tightest that fits."""
    lengths = np.asarray(lengths, dtype=np.int64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := room - size:
            waiting[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(fills, dtype=np.int64)


GIVEN = PIECES + ", row long"
PACKED = GIVEN + ", part long, bin long, offset long, bins long, bound long, fill long"


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        lengths = table.column("length").to_numpy()
        bins, offsets, fills = best_fit(lengths, capacity)
        n, bound = table.num_rows, lower_bound(lengths, capacity)
        for name, values in (("bin", bins), ("offset", offsets), ("bins", np.full(n, len(fills))), ("bound", np.full(n, bound)), ("fill", fills[bins])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack pieces ``PIECES`` (lengths from 1 to ``capacity``) into sequences: adds
    ``sequence_id`` (round, partition and bin in its bits; negative for a full
    piece, which is a sequence of its own), ``offset``, and the certificate of the
    partition that the piece was packed in: ``bins`` used and the lower ``bound``.
    Partitions with a gap, and loose bins, exchange their pieces and are packed again
    until that closes no more; what then has more bins than its bound shows it."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    items = cut(items.select(*key), "pieces").withColumn("row", F.monotonically_increasing_id())
    whole = items.where(F.col("length") == capacity)
    one = F.lit(1).cast("long")
    out = whole.select(*key, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("bins"), one.alias("bound"))
    left = items.where(F.col("length") < capacity)
    round_, before = 0, None
    while n := left.count():
        parts = -(-n // PARTITION_PIECES)
        last = parts == 1 or (before is not None and n > CLOSING * before)
        dealt = left.withColumn("part", F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(parts).cast("long")))
        packed = cut(dealt.groupBy("part").applyInArrow(_pack(capacity), PACKED), "packed")
        full = F.col("fill") == capacity
        tight = (F.col("bins") == F.col("bound")) & (F.col("fill") >= TIGHT * capacity)
        stays = F.lit(True) if last else full | tight
        number = F.lit(round_ << 52).cast("long") + F.shiftleft("part", 24) + F.col("bin")
        out = out.union(packed.where(stays).select(*key, number.alias("sequence_id"), "offset", "bins", "bound"))
        if last:
            break
        left, before, round_ = packed.where(~stays).select(*key, "row"), n, round_ + 1
    return out


def pack_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, bins,
    bound``."""
    return pack(pieces(docs, folder))
