"""Files read in parts: equal to files read whole."""

from __future__ import annotations

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import GARDEN, HARBOUR
from precis.functions import text as T
from precis.operators.stitch import stitched_raw
from precis.sources import parts as P
from precis.sources.files import read_files
from test_files_stream import CONTAINER, make_epub

RUSSIAN = "Утром на рынке продавали свежий хлеб. Потом пошёл дождь! Все разошлись по домам? "


def texts():
    rng = random.Random(8)
    words = ["Gulls", "circle.", "Naïve", "wind!", "“So?”", "e.g.", "日本", "😀.", "\n\n", "  ", " ", "Ends. ", "one", "two", "three"]
    mixed = " ".join(rng.choice(words) for _ in range(400))
    return {
        "mixed.txt": mixed.encode(), "bom.md": b"\xef\xbb\xbf" + mixed.encode(), "wide.txt": mixed.encode("utf-16"), "big.txt": b"\xfe\xff" + mixed.encode("utf-16-be"),
        "west.txt": (" ".join(GARDEN * 4) + " Café crème à Noël.").encode("cp1252"), "east.md": (RUSSIAN * 20).encode("cp1251"), "empty.txt": b"", "blank.md": b" \n ",
        "run.txt": ("x" * 300 + "é" * 300 + ". Tail here").encode(), "plain.txt": "\n".join(GARDEN + HARBOUR).encode(), "lone.txt": "  no end at all  ".encode(),
    }


@pytest.fixture
def folder(tmp_path):
    for name, content in texts().items():
        (tmp_path / name).write_bytes(content)
    make_epub(tmp_path / "g.epub")
    return tmp_path


def whole(spark, folder):
    files = read_files(spark, str(folder)).where(F.col("ext").isin("txt", "md"))
    return {r.path.rsplit("/", 1)[1]: r.t for r in files.select("path", T.decode_bytes("content").alias("t")).collect()}


@pytest.mark.parametrize("part_bytes,look", [(16, 8), (64, 64), (1 << 20, 1 << 16)])
def test_parts_put_together_are_the_text(spark, folder, monkeypatch, part_bytes, look):
    monkeypatch.setattr(P, "LOOK", look)
    rows = P.file_texts(read_files(spark, str(folder)), part_bytes, 3).where("ext <> 'epub'").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.ord)):
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    want = whole(spark, folder)
    assert {k: "".join(r.text for r in v) for k, v in got.items()} == want
    assert all([r.last for r in v] == [False] * (len(v) - 1) + [True] for v in got.values())
    if part_bytes == 16:
        assert len(got["mixed.txt"]) > 50


@pytest.mark.parametrize("processor", ["clean", "chunked"])
def test_sentences_equal_those_of_whole_files(spark, folder, processor):
    files = read_files(spark, str(folder))
    size = 100
    split = lambda n: P.file_part_sentences(P.file_texts(files, n, 2), processor, size)
    order = lambda df: sorted(map(str, df.select("doc_id", "sentence").collect()))
    assert order(split(128)) == order(split(1 << 20))
    got = {}
    for r in split(128).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    for row in files.where(F.col("ext").isin("txt", "md")).select("path", F.xxhash64("path").alias("id"), T.decode_bytes("content").alias("t")).collect():
        df = spark.createDataFrame([(row.t,)], "t string")
        if processor == "clean":
            want = df.select(T.split_raw("t")).first()[0]
        else:
            chunks = df.select(F.explode(T.chunks("t", size)).alias("c")).select(T.split_clean("c").alias("s")).collect()
            want = [s for c in chunks for s in c.s]
        assert got.get(row.id, []) == [s for s in want if len(s) <= 1000], row.path


def test_raw_split_over_parts(spark):
    """Any cut after white space gives the sentences of the whole text."""
    rng = random.Random(2)
    words = ["a.", "b", "c!", "?", "\n", " ", " ", "dd", "e. "]
    cases = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(200)]
    rows = []
    for k, text in enumerate(cases):
        cuts = sorted({i + 1 for i, c in enumerate(text[:-1]) if c in " \n" and rng.random() < 0.4})
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        rows += [(k, i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
    got: dict[int, list[str]] = {}
    parts = spark.createDataFrame(rows, "doc_id long, ord long, text string, last boolean").repartition(3)
    for r in stitched_raw(parts, "doc_id", "ord", "text", "last", block=4).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    wanted = spark.createDataFrame(list(enumerate(cases)), "k int, t string").select("k", T.split_raw("t").alias("s")).collect()
    for r in wanted:
        if len([1 for row in rows if row[0] == r.k]) == 1 or len(r.s) > 1:
            assert got.get(r.k, []) == r.s, repr(cases[r.k])
        else:  # one sentence over several parts: white space before it is kept
            assert [s.strip() for s in got.get(r.k, [])] == [s.strip() for s in r.s]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    line = " ".join(GARDEN) + "\n"
    (tmp_path / "long.txt").write_text(line * 4000)
    files = read_files(spark, str(tmp_path))
    rows = P.file_parts(files, 1 << 14, 4).select("ord", F.length("content").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert len(rows) > 100 and len({r.task for r in rows}) >= 6 and max(r.n for r in rows) < (1 << 14) + 100
    assert sum(r.n for r in rows) == 4000 * len(line)
    sentences = P.file_part_sentences(P.file_texts(files, 1 << 14, 4)).groupBy("sentence").count().collect()
    assert {r.sentence: r["count"] for r in sentences} == dict.fromkeys(GARDEN, 4000)


def test_a_book_is_a_row_an_item(spark, tmp_path):
    items = "".join(f'<item id="i{k}" href="{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(30))
    with zipfile.ZipFile(tmp_path / "book.epub", "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest></package>')
        for k in range(30):  # a sentence runs over two items
            z.writestr(f"OEBPS/{k}.xhtml", f"<html><body><p>{GARDEN[k % 5][:-1]}</p></body></html>" if k % 2 else f"<html><body>{'<p> </p>' if k == 4 else GARDEN[k % 5]}</body></html>")
    files = read_files(spark, str(tmp_path))
    parts = P.file_parts(files).collect()
    assert sorted(r.ord for r in parts) == list(range(30))
    got = [r.sentence for r in P.file_part_sentences(P.file_texts(files)).orderBy("seq").collect()]
    book = " ".join(t for t in (GARDEN[k % 5][:-1] if k % 2 else "" if k == 4 else GARDEN[k % 5] for k in range(30)) if t)
    assert got == spark.createDataFrame([(book,)], "t string").select(T.split_clean("t")).first()[0]


def test_listing_does_not_read_contents(spark, tmp_path):
    make_epub(tmp_path / "g.epub")
    plan = P.file_parts(read_files(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan[plan.index("ReadSchema") :]
