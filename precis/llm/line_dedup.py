"""Removal of repeated line chunks, with chunk borders set by the content.

The lines of a text are hashed; a rolling hash over two line hashes
puts a border wherever it falls into one class of ``SPREAD``, but not after two lines
running, so that chunks have two lines at least; the borders of a shared run of lines
are the same wherever it stands. A line of ``LONG_WORDS`` words
or more, a passage of its own, always stands alone. Chunks of two lines or more,
and such long lines, that occur again anywhere are removed after the first place
(smallest id, then text hash, then position).

Digests find the candidates; the candidates' bytes decide. Only digests of all
chunks move between tasks, and then, once, the bytes of repeated ones: each meets the
bytes at the first place of its digest. Tables of one row a chunk are aggregated before
they meet the rows, so a chunk that holds a third of all rows is counted map-side and
its join can be split. Documents are read by built-in
functions only; each is one row and is cut in its own task.

A null text stays null, an empty one empty. Rows with the same id and the same text
are one place: they lose and keep the same chunks. A text that loses all its chunks
is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, kept_names, packed, sieve, unpacked

SPREAD = 2
LONG_WORDS = 50
_BASE = 31


def _long(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= LONG_WORDS - 1


def _once(df: DataFrame, name: str, value: Column, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add a column that later expressions refer to instead of computing it again."""
    keep = [c for c in df.columns if c not in drop]
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def with_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``chunks``: the text cut at its borders (each border is a line feed).

    Lines are written one after the other with ``\\nB`` between chunks and ``\\nC``
    within them. A line holds no line feed, so both marks are unambiguous.
    """
    out = _once(docs, "_lines", F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n"))
    info = F.transform(
        "_lines",
        lambda line: F.struct(F.conv(F.substring(F.md5(line.cast("binary")), 1, 6), 16, 10).cast("long").alias("h"), _long(line).alias("long")),
    )
    out = _once(out, "_info", info)
    none = F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(False).alias("long")))
    n = F.size("_info")
    before = F.concat(none, F.slice(F.col("_info"), F.lit(1), n - 1))
    after = F.concat(F.slice(F.col("_info"), F.lit(2), n), none)
    rolled = F.zip_with("_info", before, lambda a, b: (a["h"] + b["h"] * _BASE) % SPREAD == 0)
    out = _once(out, "_hit", rolled)
    earlier = F.concat(F.array(F.lit(False)), F.slice(F.col("_hit"), F.lit(1), n - 1))
    alone = F.zip_with("_info", after, lambda a, b: a["long"] | b["long"])
    border = F.zip_with(F.zip_with("_hit", earlier, lambda a, b: a & ~b), alone, lambda a, b: F.when(a | b, F.lit("\nB")).otherwise(F.lit("\nC")))
    out = _once(out, "_border", F.concat(F.slice(border, F.lit(1), n - 1), F.array(F.lit(""))), ("_info", "_hit"))
    joined = F.array_join(F.zip_with("_lines", "_border", lambda line, b: F.concat(line, b)), "")
    chunks = F.transform(F.split(joined, "\nB"), lambda c: F.replace(c, F.lit("\nC"), F.lit("\n")))
    return _once(out, "chunks", chunks, ("_lines", "_border"))


def _digest(chunk: Column) -> Column:
    return F.xxhash64(chunk, F.lit(5))


def _removable(chunk: Column) -> Column:
    return (chunk.contains("\n") | _long(chunk)) & (F.trim(F.translate(chunk, "\n\r\t", "   ")) != "")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_h", F.xxhash64(F.col("text").cast("string")))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``(_id, _h, removed)``: for each text that loses chunks, their positions."""
    plain = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("_id", "_h", "text")

    def chunks_of(texts: DataFrame) -> DataFrame:
        rows = with_chunks(texts).select("_id", "_h", F.posexplode("chunks").alias("at", "chunk")).where(_removable(F.col("chunk")))
        return rows.withColumn("digest", _digest(F.col("chunk")))

    place = F.struct("_id", "_h", "at")
    digests = cut(chunks_of(plain).select("_id", "_h", "at", "digest"), "digests")
    counted = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    counted = cut(counted.select("digest", "first"), "counted")
    # texts that hold a repeated digest are cut once more, now with the chunks' bytes
    holders = digests.join(counted.select("digest"), "digest", "left_semi").select(F.xxhash64("_id", "_h"))
    held = sieve(plain, F.xxhash64("_id", "_h"), holders, "_maybe").where("_maybe").drop("_maybe")
    again = cut(sieve(chunks_of(held), F.col("digest"), counted.select("digest"), "_maybe").where("_maybe").drop("_maybe"), "candidates")
    # the bytes at a digest's first place stand for it; only rows that may be such move to be found
    at_first = F.xxhash64("digest", "_id", "_h", "at")
    leads = counted.select(F.xxhash64("digest", "first._id", "first._h", "first.at").alias("lead"))
    lead = sieve(again, at_first, leads, "_maybe").where("_maybe").select("digest", place.alias("place"), "chunk").join(counted, "digest")
    lead = lead.where(F.col("place").eqNullSafe(F.col("first"))).dropDuplicates(["digest"]).select("digest", "first", F.col("chunk").alias("own"))
    # one move of all candidates' bytes: each meets the bytes that stand for its digest
    both = again.join(cut(lead, "leads"), "digest")
    later = both.where((F.col("chunk") == F.col("own")) & ~place.eqNullSafe(F.col("first"))).select("_id", "_h", "at")
    # other bytes under one digest: the same by the bytes themselves
    other = cut(both.where(F.col("chunk") != F.col("own")).select("_id", "_h", "at", "digest", "chunk"), "collisions")
    firsts = other.groupBy("digest", "chunk").agg(F.min(place).alias("first"))
    more = other.join(cut(firsts, "firsts"), ["digest", "chunk"]).where(~place.eqNullSafe(F.col("first"))).select("_id", "_h", "at")
    return later.union(more).groupBy("_id", "_h").agg(F.collect_set("at").alias("removed"))


def dedup_lines(docs: DataFrame, report: bool = False) -> DataFrame:
    """``docs`` without the repeated chunks in ``text`` (and ``n_chars`` to match);
    ``report`` adds ``n_removed``."""
    lost = cut(repeated_chunks(docs), "lost").select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "removed")
    own = sieve(_keyed(packed(docs, "doc_id", "text")), F.xxhash64("_id", "_h"), lost.select(F.xxhash64("_id2", "_h2")), "_maybe")
    none = F.array().cast("array<int>")
    names = kept_names(docs.columns)
    same = own.where("not _maybe").select("text", *names, none.alias("removed"))
    # only texts that may lose chunks move to meet their list
    some = own.where("_maybe").join(lost, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left")
    some = some.select("text", *names, F.coalesce("removed", none).alias("removed"))
    more = [F.size("removed").cast("long").alias("n_removed")] if report else []
    kept = same.unionByName(some.where(F.size("removed") == 0)).select(*unpacked(docs.columns), *more)
    return kept.unionByName(_rebuilt(some.where(F.size("removed") > 0), docs, more))


def _rebuilt(rows: DataFrame, docs: DataFrame, more: list[Column]) -> DataFrame:
    """Texts without their removed chunks."""
    both = with_chunks(rows)
    kept = F.filter(F.transform("chunks", lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda s: ~F.array_contains("removed", s["i"]))
    both = _once(both, "_text", F.array_join(F.transform(kept, lambda s: s["c"]), "\n"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return both.select(*unpacked(docs.columns, changed), *more)


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (
  SELECT *, ('0x' || substr(md5(line), 1, 6))::BIGINT AS h, length(line) - length(replace(line, ' ', '')) >= {LONG_WORDS - 1} AS long FROM l),
b AS (
  SELECT *, (hit AND NOT coalesce(lag(hit) OVER w, false)) OR long OR coalesce(lead(long) OVER w, false) AS border
  FROM (SELECT *, (h + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * {_BASE}) % {SPREAD} = 0 AS hit FROM h) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (
  SELECT *, coalesce(sum(border::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM b),
c AS (SELECT doc_id, part, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS lines, bool_or(long) AS long FROM n GROUP BY doc_id, part),
k AS (
  SELECT *, (lines > 1 OR long) AND trim(replace(replace(replace(chunk, chr(10), ' '), chr(13), ' '), chr(9), ' ')) <> ''
            AND row_number() OVER (PARTITION BY chunk, lines > 1 OR long ORDER BY doc_id, part) > 1 AS removed FROM c),
t AS (
  SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY part) FILTER (NOT removed), '') AS text, sum(removed::INT)::BIGINT AS n_removed
  FROM k GROUP BY doc_id)
SELECT doc_id, text, n_removed FROM t
UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL
"""
