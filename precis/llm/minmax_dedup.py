"""Near-duplicate documents by min-max hashing of five-word shingles.

Every permutation of the shingle hashes gives two signature values, its
minimum and its maximum, so ``PERMUTATIONS`` evaluations make twice as many
values. Bands of ``BAND_VALUES`` values propose candidates; every link is then
confirmed on the two full shingle sets. A pair exactly at the threshold shares
no band with probability ``(1 - 0.75**5)**48``, about 2e-6.

Documents with equal sets form one class before any candidate is built, so
copies are never compared. Classes that share a band with another class are
candidates; no all-pairs list of them is built. Their shingles are put in one
order, rarest first, and each class is entered under the shingles at the front
of its set: two linked classes meet under one of those (prefix filter). Each
such bucket compares its members with one central member (a star).

What that leaves open is closed exactly. Let ``e`` be what a member's set and the
centre's do not share. A link needs ``7 * |e_x ^ e_y| <= n_x + n_y``, that is
``14 * |e_x & e_y| >= f_x + f_y`` with ``f = 7 * |e| - n``; ``f`` is never below
minus the centre's size, and above the centre's size for members that did not
link to it. So of two members that are not both linked to the centre, the
differences must overlap: those without enough differences that another member
has drop out, the rest meet in new buckets, by the same filter on the
differences, until none holds two components. Shingles that the same members hold
make one row, with their number as weight. A pair needs to be seen only in the bucket
where it meets first; all that it shares lies in what each has left from there on, so
members and pairs that have too little left drop out. A bucket with at most ``SPREAD``
open pairs a member holds those directly against what they have left.

Null and empty texts have no shingles and link with nothing. Rows that share
text share a class whatever their ids are; a class of rows without any id takes
part in no link to another class.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrow_text as A
from .graph import connected_components
from .tables import cut, kept_names, packed, sieve, unpacked

WORDS = 5
PERMUTATIONS = 120
BAND_VALUES = 5
SEED = 20_240_607
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A bucket compares its open pairs directly if they are at most so many a member;
#: four times as many in every further round, when few buckets are left.
SPREAD = 32
#: Ratio of the size levels; links span less, ``100 / PERCENT``.
LEVEL = 1.34
#: Times that the members of a star are held against the least that others allow.
NARROWED = 3
#: Texts, or pairs of shingle sets, in an Arrow batch.
BATCH = 512

_U = np.uint64


def _constants(n: int, seed: int) -> np.ndarray:
    return A.mix64(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def shingle_slices(column, hasher: A.WordHasher):
    """Per slice of a text column: ``(first_row, shingles, first)`` with the
    64-bit shingle hashes of all documents, in text order, repeats included."""
    places = _constants(WORDS, 7)
    for at, data, offsets in A.slices(column, A.SMALL_SLICE):
        data = A.lower_ascii(data)
        starts, ends, first = A.word_bounds(data, offsets)
        words = hasher(data, starts, ends)
        counts = np.diff(first)
        doc = np.repeat(np.arange(len(counts)), counts)
        # place of a word in its document, and words left from it on
        place = np.arange(len(words)) - first[:-1][doc]
        whole = counts[doc] - place >= WORDS
        padded = np.concatenate((words, np.zeros(WORDS, np.uint64)))
        total = sum(padded[i : i + len(words)] * places[i] for i in range(WORDS))
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        keep = whole.copy()
        for d in short:
            i = first[d]
            total[i] = np.sum(words[i : first[d + 1]] * places[: counts[d]]) + _U(int(counts[d]))
            keep[i] = True
        shingles = A.mix64(total[keep])
        yield at, shingles, np.searchsorted(np.flatnonzero(keep), first)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def _sign(batches):
    """Arrow batches ``(doc_id, text, text_hash)`` to class key, set size and band hashes."""
    hasher, factors, shifts = A.WordHasher(), _constants(PERMUTATIONS, SEED), _constants(PERMUTATIONS, SEED + 1)
    n_bands = 2 * PERMUTATIONS // BAND_VALUES
    weights, marks = _constants(BAND_VALUES, SEED + 2), _constants(n_bands, SEED + 3)
    for batch in batches:
        for at, shingles, first in shingle_slices(batch.column("text"), hasher):
            n_docs = len(first) - 1
            size, key, bands = np.zeros(n_docs, np.int64), np.zeros((n_docs, 2), np.int64), np.zeros((n_docs, n_bands), np.int64)
            for d in np.flatnonzero(first[1:] > first[:-1]):
                own = _distinct(shingles[first[d] : first[d + 1]])
                size[d] = len(own)
                key[d] = _key(own)
            full = np.flatnonzero(size)
            if len(full):
                heads = first[full]
                signature = np.empty((2 * PERMUTATIONS, len(full)), np.uint64)
                for k in range(PERMUTATIONS):
                    under = shingles * factors[k] + shifts[k]
                    signature[2 * k] = np.minimum.reduceat(under, heads)
                    signature[2 * k + 1] = np.maximum.reduceat(under, heads)
                cells = signature.reshape(n_bands, BAND_VALUES, len(full)) * weights[None, :, None]
                bands[full] = A.mix64(cells.sum(axis=1, dtype=np.uint64) + marks[:, None]).view(np.int64).T
            lists = pa.array([bands[d] if size[d] else [] for d in range(n_docs)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, n_docs).cast(pa.int64()), batch.column("text_hash").slice(at, n_docs), pa.array(size), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), lists],
                names=["doc_id", "text_hash", "n_shingles", "node", "node2", "bands"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, node, node2, bands)`` per document; ``node`` names
    the class of documents with the same shingle set (0: no shingles)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.withColumn("text_hash", F.xxhash64("text"))
    return plain.mapInArrow(_sign, "doc_id long, text_hash long, n_shingles long, node long, node2 long, bands array<long>")


def _key(own: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)


def _sets(batches):
    """Shingle sets of class representatives; a row whose set is another class's is left out."""
    hasher = A.WordHasher()
    for batch in batches:
        for at, shingles, first in shingle_slices(batch.column("text"), hasher):
            nodes = batch.column("node").slice(at, len(first) - 1).to_numpy(zero_copy_only=False)
            own = [_distinct(shingles[first[d] : first[d + 1]]) for d in range(len(nodes))]
            mine = [d for d in range(len(nodes)) if len(own[d]) and _key(own[d])[0] == nodes[d]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[mine], pa.int64()), pa.array([own[d].tobytes() for d in mine], pa.binary())], names=["node", "own"]
            )


def _shingle_rows(batches):
    """A row for every shingle of a set, with the set's size."""
    for batch in batches:
        for node, own in zip(batch.column("node"), batch.column("own"), strict=True):
            own = np.frombuffer(own.as_buffer(), np.int64)
            same = [np.full(len(own), x, np.int64) for x in (node.as_py(), len(own))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(own)], names=["node", "n", "shingle"])


def _compare(batches):
    """Pairs with both sets to the sizes, the common size and, for a star, the differences."""
    for batch in batches:
        common, sizes, apart = [], [], []
        for a, b, keep in zip(batch.column("own_a"), batch.column("own_b"), batch.column("star").to_pylist(), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            differ = np.setxor1d(x, y, assume_unique=True)
            common.append((len(x) + len(y) - len(differ)) // 2)
            sizes.append((len(x), len(y)))
            apart.append(differ.view(np.int64) if keep else differ[:0].view(np.int64))
        ends = np.cumsum([0, *map(len, apart)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *apart])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), batch.column("star"), pa.array([s[0] for s in sizes], pa.int64()),
             pa.array([s[1] for s in sizes], pa.int64()), pa.array(common, pa.int64()), lists],
            names=["a", "b", "star", "n_a", "n_b", "common", "apart"],
        )


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b, star)`` measured on the full sets, with ``linked``."""
    pairs = cut(pairs, "pairs")
    both = pairs
    for side in ("a", "b"):
        # sets stay where they are, but for those that the sieve lets through
        own = sets.select(F.col("node").alias(side), F.col("own").alias(f"own_{side}"))
        own = sieve(own, F.xxhash64(side), pairs.select(F.xxhash64(side)), "_maybe").where("_maybe").drop("_maybe")
        both = both.join(own, side)
    out = both.mapInArrow(_compare, "a long, b long, star boolean, n_a long, n_b long, common long, apart array<long>")
    return out.withColumn("linked", 100 * F.col("common") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("common")))


def _front_buckets(sets: DataFrame) -> DataFrame:
    """``(bucket, node)``: every set under the first of its shingles, rarest first, as many
    as a link may leave out and one more. Linked sets differ in size by a third at most, so a bucket holds
    sizes of two neighbouring levels; of buckets with the same members one is enough."""
    tokens = sets.mapInArrow(_shingle_rows, "node long, n long, shingle long")
    # shingles of one set only come first and meet nobody: they need no rows
    often = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), *_same_members("node")).where("df > 1")
    often = cut(_one_for_all(often), "often")
    ranked = tokens.join(often, "shingle").withColumn("before", _before("node"))
    ranked = ranked.withColumn("k", F.sum("weight").over(Window.partitionBy("node")))
    front = ranked.where("before <= n - floor((3 * n + 3) / 4) - (n - k)")
    level = F.floor(F.log(F.col("n")) / math.log(LEVEL))
    front = front.select("node", "shingle", F.explode(F.array(level, level + 1)).alias("level"))
    front = cut(front.select(F.xxhash64("shingle", "level").alias("bucket"), "node").distinct(), "front")
    return _one_of_each(front)


def _one_for_all(met: DataFrame, *star: str) -> DataFrame:
    """Shingles that the same members hold stand side by side in the order and meet the
    same: one of them is kept, its ``weight`` is their number."""
    return met.groupBy(*star, "df", "one", "two").agg(F.min("shingle").alias("shingle"), F.count(F.lit(1)).alias("weight")).drop("one", "two")


def _before(*member: str):
    """How many of a member's shingles come before, rarest first."""
    ahead = Window.partitionBy(*member).orderBy("df", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("weight").over(ahead), F.lit(0))


def _one_of_each(members: DataFrame) -> DataFrame:
    """The rows of buckets with two members or more, without all but one of buckets with the same members."""
    met = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *_same_members("node")).where("size > 1")
    met = cut(met.groupBy("size", "one", "two").agg(F.min("bucket").alias("bucket")).select("bucket"), "met")
    return members.join(met, "bucket", "left_semi")


def _with_roots(members: DataFrame, rows: int, roots: DataFrame | None, spread: int) -> DataFrame:
    """Buckets in which more than one component is left: ``(bucket, node, root,
    size, direct, main)``. ``direct``: the pairs of different components are at most
    ``spread`` a member, so they can be compared as they are; ``main`` is the
    component with most members. Tables of one row a bucket are written first, so
    that a join with a hot bucket can be split."""
    if roots is None:
        members = members.withColumn("root", F.col("node"))
    else:
        members = cut(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted", rows)
    parts = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("bucket").agg(
        F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("same"), F.max(F.struct("n", "root")).getField("root").alias("main"), F.count(F.lit(1)).alias("roots")
    )
    direct = F.col("size") * F.col("size") - F.col("same") <= 2 * spread * F.col("size")
    open_ = cut(open_.where("roots > 1").select("bucket", "size", direct.alias("direct"), "main"), "open", rows)
    return cut(members.join(open_, "bucket"), "sized", 2 * rows)


def _centres(members: DataFrame, rows: int) -> DataFrame:
    """Add the bucket's ``centre``: the member that meets most others."""
    weight = cut(members.groupBy("node").agg(F.sum("size").alias("weight")), "weight", rows)
    best = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).getField("node").alias("centre"))
    return members.join(cut(best, "centres", rows), "bucket")


def _same_members(node: str) -> list:
    """Two hashes of a bucket's set of members."""
    return [F.bit_xor(F.xxhash64(node, F.lit(k))).alias(name) for k, name in ((1, "one"), (2, "two"))]


def linked_classes(sig: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, root)`` of the classes that have a confirmed link; ``root`` names the component."""
    full = sig.where("n_shingles > 0")
    rows = sig.count()
    reps = cut(full.groupBy("node").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null"), "reps", rows)
    banded = full.where("doc_id is not null").select("node", F.explode("bands").alias("bucket"))
    shared = cut(banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket"), "shared")
    proposed = cut(banded.join(shared, "bucket", "left_semi").select("node").distinct(), "proposed")
    wanted = cut(reps.join(proposed, "node", "left_semi").select("doc_id", "node"), "wanted", rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # most texts stay where they are: only those that the sieve lets through are joined
    text = sieve(text, F.xxhash64("doc_id"), wanted.select(F.xxhash64("doc_id")), "maybe").where("maybe").drop("maybe")
    text = text.join(wanted, "doc_id").dropDuplicates(["doc_id", "node", "text"]).select("node", "text")
    sets = cut(text.mapInArrow(_sets, "node long, own binary"), "sets", batch=BATCH)
    return _closed(cut(_front_buckets(sets), "buckets"), sets)


def _closed(members: DataFrame, sets: DataFrame) -> DataFrame:
    measured: DataFrame | None = None
    roots: DataFrame | None = None
    spread = SPREAD
    while True:
        rows = members.count()
        if roots is not None and rows == 0:
            return roots
        now = cut(_centres(_with_roots(members, rows, roots, spread), rows), "now", 2 * rows)
        star = now if measured is None else now.where("not direct")
        star = cut(star.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "star", rows)
        pairs = star.withColumn("star", F.lit(True))
        if measured is not None:
            pairs = pairs.join(measured.where("star").select("a", "b"), ["a", "b"], "left_anti")
            known = measured.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            few = _few(now).join(known, ["a", "b"], "left_anti")
            pairs = pairs.union(few.withColumn("star", F.lit(False)))
        fresh = cut(_verified(pairs, sets), "measured", batch=BATCH)
        measured = fresh if measured is None else measured.union(fresh)
        if roots is None or not fresh.where("linked").isEmpty():
            roots = connected_components(measured.where("linked").select("a", "b"))
        if star.isEmpty():
            return roots
        members = cut(_left_open(star, measured), "buckets")
        spread *= 4


def _few(now: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of buckets that compare directly: of different components,
    with sizes and shared differences that allow a link."""
    few = now.where("direct").select("bucket", "node", "root", "main", "n", "f", "rest")
    minor = few.where("root != main").select("bucket", *(F.col(c).alias(f"{c}_x") for c in ("node", "root", "n", "f", "rest")))
    few = few.join(minor, "bucket").where("root != root_x and f + f_x <= 14 * least(rest, rest_x) and 4 * least(n, n_x) >= 3 * greatest(n, n_x)")
    return few.select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct()


def _left_open(star: DataFrame, measured: DataFrame) -> DataFrame:
    """Buckets ``(bucket, node, n, f, rest)`` of the next round, of members of one star that may
    link though they are not both linked to its centre: size, ``f`` (see above) and the number
    of differences that another member has, from the bucket's on in their order."""
    around = measured.where("star").join(star, ["a", "b"], "left_semi")
    f = 7 * (F.col("n_a") + F.col("n_b") - 2 * F.col("common")) - F.col("n_b")
    torn = cut(around.where("not linked").select("a").distinct(), "torn")
    around = around.join(torn, "a", "left_semi").select("a", "b", "linked", F.col("n_b").alias("n"), f.alias("f"), "apart")
    apart = around.select("a", "b", "linked", F.explode("apart").alias("shingle"))
    # differences that no unlinked member has, or one member alone, join nobody
    met = apart.groupBy("a", "shingle").agg(F.count(F.lit(1)).alias("df"), F.min("linked").alias("every"), *_same_members("b"))
    met = cut(_one_for_all(met.where("df > 1 and not every"), "a"), "met")
    shared = apart.join(met, ["a", "shingle"]).withColumn("before", _before("a", "b")).groupBy("a", "b")
    shared = cut(shared.agg(F.sum("weight").alias("k"), F.collect_list(F.struct("before", "shingle")).alias("shared")), "shared")
    able = around.drop("apart").join(shared.select("a", "b", "k"), ["a", "b"])
    for _ in range(NARROWED):  # every member that drops out may raise what the others need
        able = cut(able, "able")
        least = able.groupBy("a").agg(F.min("f").alias("any"), F.min(F.when(~F.col("linked"), F.col("f"))).alias("unlinked"), F.count(F.lit(1)).alias("left"))
        least = cut(least.where("left > 1 and unlinked is not null"), "least")
        able = able.drop("need").join(least, "a").withColumn("need", F.ceil((F.col("f") + F.expr("if(linked, unlinked, any)")) / 14))
        able = able.withColumn("need", F.greatest("need", F.lit(1))).where("k >= need").drop("any", "unlinked", "left")
    able = cut(able.select("a", "b", "linked", "n", "f", "k", "need"), "able")
    front = shared.drop("k").join(able, ["a", "b"]).withColumn("first", F.explode(F.expr("filter(shared, s -> s.before <= k - need)")))
    rest = (F.col("k") - F.col("first.before")).alias("rest")
    front = front.select(F.xxhash64("a", "first.shingle").alias("bucket"), F.col("b").alias("node"), "linked", "n", "f", rest)
    return _may_link(cut(front.dropDuplicates(["bucket", "node"]), "front")).drop("linked")


def _may_link(front: DataFrame) -> DataFrame:
    """The members that have ``rest`` enough for another one of the bucket. A pair needs to
    be seen only where it meets first, and all that it shares lies in what is left there."""
    least = front.groupBy("bucket").agg(F.min("f").alias("any"), F.min(F.when(~F.col("linked"), F.col("f"))).alias("unlinked"), F.count(F.lit(1)).alias("left"))
    least = cut(least.where("left > 1 and unlinked is not null"), "least")
    return front.join(least, "bucket").where("f + if(linked, unlinked, any) <= 14 * rest").drop("any", "unlinked", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest ``doc_id`` of the documents reachable over
    links (itself included) and ``kept`` marks that document.
    """
    return _components(docs).drop("text_hash")


def _components(docs: DataFrame) -> DataFrame:
    """:func:`near_duplicates` with a hash of each row's text."""
    sig = cut(signatures(docs), "signatures", batch=BATCH)
    roots = linked_classes(sig, docs)
    rows = sig.count()
    lowest = sig.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("lowest"))
    named = cut(lowest.join(roots, "node", "left").select("node", "lowest", F.coalesce("root", "node").alias("root")), "lowest", rows)
    component = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = cut(named.join(component, "root").select("node", "component_id"), "named", rows)
    full = sig.where("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "node").join(named, "node")
    empty = sig.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.select("doc_id", "text_hash", "n_shingles", "component_id").union(empty)
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is kept; of rows with one id and one
    text (exact repeats) one stays. A row without id or shingles stays. Of rows
    with one id and several texts only those go whose own text is not kept."""
    dropped = cut(_components(docs).where("not kept and doc_id is not null").select("doc_id", "text_hash").distinct(), "dropped")
    names = kept_names(docs.columns)
    own = packed(docs, "doc_id", "text").withColumn("_id", F.col("doc_id").cast("long"))
    key = F.xxhash64("_id")
    twice = own.where("_id is not null").groupBy(key.alias("key"), F.xxhash64("text").alias("h")).count().where("count > 1").select("key")
    marked = sieve(own, key, twice.union(dropped.select(F.xxhash64("doc_id"))), "_maybe")
    # only rows that may go move to meet the list
    some = marked.where("_maybe").withColumn("_hash", F.xxhash64(F.col("text").cast("string")))
    some = some.join(dropped.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), ["_id", "_hash"], "left_anti")
    copies = Window.partitionBy("_id", F.xxhash64("text")).orderBy(F.lit(1))
    some = some.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1 or _id is null")
    return marked.where("not _maybe").select(*names).union(some.select(*names)).select(*unpacked(docs.columns))
