"""Files read in parts: no file, however large, is ever one row or one string.

A text file is cut into parts of about ``part_bytes``; part ``k`` holds the bytes from the first
place after ``k * part_bytes`` where a white-space byte ends to the same place of the next part.
Every task finds those places by itself, so a file's byte ranges are read by many tasks and the
parts put together are the file. (Where ``LOOK`` bytes hold no white space the cut is moved to
the start of a UTF-8 character or UTF-16 unit instead.) An EPUB archive gives one row for each
document item. Ranges are rows of a table, dealt over tasks like any others; nothing is listed on
the driver.

The encoding of a text file is decided from all its parts: the sums that the decision needs are
added up by file (:mod:`precis.functions.encodings`), and only files that are not plain UTF-8
are looked up when the parts are decoded.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK_SIZE, MAX_SENTENCE_LENGTH
from ..functions import encodings as E
from ..functions import text as T
from ..operators.sentences import sentences_of_chunks, shuffle_partitions
from ..operators.stitch import stitched_raw, stitched_sentences

PART_BYTES = 1 << 20
#: Parts of one range, which one task reads in a row.
RANGE_PARTS = 32
LOOK = 1 << 16
#: Files of other encodings than UTF-8 up to which their names are broadcast.
ODD_FILES = 1 << 16
TEXT_EXTENSIONS = ("txt", "md")
XHTML = "application/xhtml+xml"
MARKS = {b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE"}
PARTS_SCHEMA = "path string, ext string, ord long, last boolean, mark string, content binary"


# --- inside tasks ------------------------------------------------------------------------------
def open_file(path: str):
    """A seekable reader of a path as Spark names it."""
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _edge(f, at: int, size: int, mark: str) -> int:
    """Where the part that starts at about ``at`` starts."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    f.seek(at)
    look = f.read(LOOK)
    if mark:
        space = {c.to_bytes(2, "little" if mark == "UTF-16LE" else "big") for c in (9, 10, 13, 32)}
        units = [look[i : i + 2] for i in range(0, len(look) - 1, 2)]
        found = next((2 * k + 2 for k, u in enumerate(units) if u in space), None)
        if found is not None:
            return at + found
        high = units[0][1 if mark == "UTF-16LE" else 0] if units else 0
        return at + (2 if 0xDC <= high <= 0xDF else 0)  # not between two surrogates
    m = re.search(rb"[ \t\r\n]", look)
    if m:
        return at + m.end()
    return at + next((k for k, b in enumerate(look[:4]) if b & 0xC0 != 0x80), 0)


def text_parts(path: str, size: int, first: int, last: int, part_bytes: int):
    """``(ord, last, mark, content)`` of the parts from ``first`` up to ``last``."""
    with open_file(path) as f:
        head = f.read(3)
        mark = MARKS.get(head[:2], "")
        skip = 2 if mark else 3 if head == b"\xef\xbb\xbf" else 0
        start = max(_edge(f, first * part_bytes, size, mark), skip)
        for k in range(first, last):
            end = max(_edge(f, (k + 1) * part_bytes, size, mark), skip)
            if end > start or k == 0:
                f.seek(start)
                yield k, end >= size, mark, f.read(max(end - start, 0))
            start = end


def _package(z: zipfile.ZipFile) -> str:
    for el in ElementTree.fromstring(z.read("META-INF/container.xml")).iter():
        if el.tag.endswith("rootfile") and el.get("full-path"):
            return el.get("full-path")
    raise ValueError("no rootfile in container.xml")


def epub_names(z: zipfile.ZipFile) -> list[str]:
    """Names of the document items, in manifest order; references may be percent-encoded."""
    names, package = set(z.namelist()), _package(z)
    out = []
    for el in ElementTree.fromstring(z.read(package)).iter():
        if (el.tag.endswith("}item") or el.tag == "item") and el.get("media-type") == XHTML and el.get("href"):
            written = posixpath.normpath(posixpath.join(posixpath.dirname(package), el.get("href")))
            out.append(written if written in names else unquote(written))
    return out


def in_unicode(data: bytes) -> str:
    """Markup of an item: in the encoding that it declares, in UTF-8 or UTF-16 (all that the
    format knows), else ISO-8859-1; the first that reads all bytes counts."""
    said = re.search(rb"""^\s*<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)""", data[:200])
    marked = ["utf-16"] if data[:2] in MARKS else []
    for encoding in [*([said[1].decode("ascii")] if said else []), *marked, "utf-8-sig"]:
        try:
            return data.decode(encoding)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("iso-8859-1")


def _status(path: str, ext: str) -> str:
    if ext in TEXT_EXTENSIONS:
        return "ok"
    if ext != "epub":
        return "unsupported_file"
    try:  # every item is read to its end, a block at a time
        with open_file(path) as f, zipfile.ZipFile(f) as z:
            for name in epub_names(z):
                with z.open(name) as item:
                    while item.read(1 << 20):
                        pass
        return "ok"
    except Exception:  # a corrupt archive or package: a status, not a failed job
        return "invalid_epub"


def _statuses(batches):
    for batch in batches:
        found = [_status(p, e) for p, e in zip(batch.column("path").to_pylist(), batch.column("ext").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "ext", "length")), pa.array(found, pa.string())], names=["path", "ext", "length", "status"])


def _read(part_bytes: int, range_parts: int):
    def rows(path, ext, size, at):
        if ext in TEXT_EXTENSIONS:
            n = max(1, -(-size // part_bytes))
            yield from text_parts(path, size, at * range_parts, min(n, (at + 1) * range_parts), part_bytes)
            return
        with open_file(path) as f, zipfile.ZipFile(f) as z:
            for k, name in enumerate(epub_names(z)):
                yield k, True, "", in_unicode(z.read(name)).encode()

    def run(batches):
        names = ["path", "ext", "ord", "last", "mark", "content"]
        for batch in batches:
            for path, ext, size, at in zip(*(batch.column(c).to_pylist() for c in ("path", "ext", "length", "range")), strict=True):
                for k, last, mark, content in rows(path, ext, size, at):
                    one = [[path], [ext], [k], [last], [mark], [content]]
                    types = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, types, strict=True)], names=names)

    return run


# --- tables --------------------------------------------------------------------------------------
def file_statuses(files: DataFrame) -> DataFrame:
    """``(path, ext, length, status)`` of files ``(path, ext, length)``; only archives are
    opened."""
    return files.select("path", "ext", "length").mapInArrow(_statuses, "path string, ext string, length long, status string")


def file_parts(files: DataFrame, part_bytes: int = PART_BYTES, range_parts: int = RANGE_PARTS) -> DataFrame:
    """``(path, ext, ord, last, mark, content)``: the parts of all readable files. ``mark`` names
    the encoding of a byte-order mark, which is no part of the content."""
    if part_bytes % 2:
        raise ValueError("part_bytes must be even")
    ok = file_statuses(files).where("status = 'ok'")
    n = F.when(F.col("ext").isin(*TEXT_EXTENSIONS), F.ceil(F.col("length") / (part_bytes * range_parts))).otherwise(1)
    ranges = ok.select("path", "ext", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)).cast("long") - 1)).alias("range"))
    # only names and numbers move; an explicit number (the listing gives it), as the work is
    # still to come
    count = files.select(F.sum(F.greatest(F.ceil(F.col("length") / (part_bytes * range_parts)), F.lit(1)))).first()[0] or 1
    ranges = ranges.repartition(min(int(count), 4 * shuffle_partitions(files)), "path", "range")
    return ranges.mapInArrow(_read(part_bytes, range_parts), PARTS_SCHEMA)


def odd_encodings(parts: DataFrame) -> DataFrame:
    """``(path, encoding)`` of the text files that are not plain UTF-8."""
    text = parts.where(F.col("ext").isin(*TEXT_EXTENSIONS))
    plain = F.is_valid_utf8("content")
    whole = F.when(F.col("mark") == "UTF-16LE", E.is_utf16(F.col("content"), True)).when(F.col("mark") == "UTF-16BE", E.is_utf16(F.col("content"), False))
    none = F.lit(0.0)
    rows = text.select("path", "mark", plain.alias("plain"), whole.alias("whole"), F.when(~plain, E.scores(F.col("content"))).alias("s"))
    by_file = rows.groupBy("path").agg(
        F.max("mark").alias("mark"), F.bool_and("plain").alias("plain"), F.bool_and("whole").alias("whole"),
        *[F.sum(F.coalesce(F.col("s").getField(c).cast("double"), none)).alias(c) for c in ("high", *E.CANDIDATES)],
    )
    legacy = E.winner(F.col("high"), {c: F.col(c) for c in E.CANDIDATES})
    encoding = F.when((F.col("mark") != "") & F.col("whole"), F.col("mark")).otherwise(legacy)
    return by_file.where((F.col("mark") != "") | ~F.col("plain")).select("path", encoding.alias("encoding"))


def file_texts(files: DataFrame, part_bytes: int = PART_BYTES, range_parts: int = RANGE_PARTS) -> DataFrame:
    """``(doc_id, path, ext, ord, last, text)``: the parts of all readable files as text (of an
    EPUB item its markup). ``doc_id`` is a hash of the path. The encodings are decided first, in
    a pass of their own."""
    parts = file_parts(files, part_bytes, range_parts)
    odd = odd_encodings(parts)
    few = odd.limit(ODD_FILES + 1).collect()
    among = E.CANDIDATES
    if len(few) <= ODD_FILES:
        among = sorted({r.encoding for r in few} & set(among))
        odd = F.broadcast(files.sparkSession.createDataFrame(few, "path string, encoding string"))
    rows = parts.join(odd, "path", "left")
    kept = F.col("encoding").startswith("UTF-16") | (F.col("mark") == "") | (F.col("ord") > 0)
    marks = {name: F.lit(bytearray(mark)) for mark, name in MARKS.items()}
    mark = F.when(F.col("mark") == "UTF-16LE", marks["UTF-16LE"]).otherwise(marks["UTF-16BE"])
    content = F.when(kept, F.col("content")).otherwise(F.concat(mark, F.col("content")))
    in_file = E.let(content, lambda c: _decoded(c, F.coalesce("encoding", F.lit("UTF-8")), among))
    text = F.when(F.col("ext") == "epub", F.decode("content", "UTF-8")).otherwise(in_file)
    return _once(rows.select(F.xxhash64("path").alias("doc_id"), "path", "ext", "ord", "last", text.alias("text")))


def _once(rows: DataFrame, column: str = "text") -> DataFrame:
    """The same rows; later expressions read the column instead of repeating what made it."""
    return rows.select(*[c for c in rows.columns if c != column], F.explode(F.array(column)).alias(column))


def _decoded(content: Column, name: Column, among: list[str]) -> Column:
    """A part in its file's encoding (byte-order marks are gone)."""
    wide = F.when(name == "UTF-16LE", F.decode(content, "UTF-16LE")).when(name == "UTF-16BE", F.decode(content, "UTF-16BE"))
    return wide.when(name == "UTF-8", F.decode(content, "UTF-8")).otherwise(E.decode_as(content, name, among))


def file_part_sentences(texts: DataFrame, processor: str = "clean", chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Sentences of files given in parts, equal to those of the whole texts: ``clean`` splits
    txt/md plainly and EPUB items (their visible texts joined by one space) cleanly;
    ``chunked`` cuts each text into slices of ``chunk_size`` characters and splits them cleanly."""
    book = F.col("ext") == "epub"
    if processor == "chunked":
        own = F.when(book, F.concat(F.when(F.col("ord") > 0, F.lit(" ")).otherwise(F.lit("")), T.html_to_text_glued("text"))).otherwise(F.col("text"))
        return sentences_of_chunks(slices(_once(texts.select("doc_id", "ord", own.alias("text"))), chunk_size))
    plain = stitched_raw(texts.where(~book), "doc_id", "ord", "text", "last")
    items = _once(texts.where(book).select("doc_id", "ord", T.html_to_text("text").alias("text")))
    return plain.unionByName(stitched_sentences(items, "doc_id", "ord", longest=MAX_SENTENCE_LENGTH))


def slices(parts: DataFrame, size: int) -> DataFrame:
    """``(doc_id, chunk_no, chunk)``: the slices of ``size`` characters of texts given in
    ordered parts that follow each other. Lengths alone are added up over a document; a row
    holds a piece of one slice, and only pieces of one slice meet."""
    sized = parts.select("doc_id", "ord", F.length("text").cast("long").alias("_n"))
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rows = parts.join(starts, ["doc_id", "ord"])
    # up to the end of the slice that the part starts in, then slice by slice
    head = size - F.pmod(F.col("_from"), F.lit(size))
    rest = F.substr("text", head.cast("int") + 1)
    pieces = F.concat(F.array(F.substr("text", F.lit(1), head.cast("int"))), T.chunks(rest, size))
    rows = rows.select("doc_id", F.floor(F.col("_from") / size).alias("_first"), "_from", F.posexplode(pieces).alias("_k", "piece")).where("piece <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("_from", "_k", "piece")))
    whole = rows.groupBy("doc_id", (F.col("_first") + F.col("_k")).alias("chunk_no")).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("chunk"))
    return whole.where(~T.is_blank("chunk"))
