"""File sources, EPUB, sinks and the streaming job."""

from __future__ import annotations

import os
import zipfile

from conftest import SF001, GARDEN
from precis.plans.files import summarize_files
from precis.plans.summarize import summarize
from precis.sources.files import corpus_files, epub_documents, file_documents, read_files
from precis.sources.sinks import write_results
from precis.streaming.stream import summarize_stream

CONTAINER = (
    '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0">'
    '<rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
)
OPF = (
    '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><manifest>'
    '<item id="c1" href="ch%201.xhtml" media-type="application/xhtml+xml"/>'
    '<item id="css" href="s.css" media-type="text/css"/>'
    '<item id="c2" href="ch2.xhtml" media-type="application/xhtml+xml"/>'
    "</manifest></package>"
)


def make_epub(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/content.opf", OPF)
        z.writestr("OEBPS/ch 1.xhtml", f"<html><head><style>p{{}}</style></head><body><p>{GARDEN[0]}</p><p>{GARDEN[1]}</p></body></html>")
        z.writestr("OEBPS/ch2.xhtml", f"<html><body><script>var x=1;</script><p>{' '.join(GARDEN[2:])}</p></body></html>")
        z.writestr("OEBPS/s.css", "p{}")


def make_files(root):
    text = " ".join(GARDEN)
    os.makedirs(f"{root}/sub", exist_ok=True)
    (root / "a.txt").write_text(text)
    (root / "sub" / "b.MD").write_bytes(text.encode("utf-16"))
    (root / "c.md").write_bytes((text + " Café crème.").encode("latin-1"))
    (root / "d.pdf").write_text("test content")
    (root / "e.txt").write_text("Short.")
    (root / "h.txt").write_bytes(b"\xff\xfe" + text.encode("utf-16-le") + b"\x00\xd8!")  # a lone surrogate and an odd byte
    (root / "f.epub").write_bytes(b"not a zip")
    make_epub(root / "g.epub")


def test_epub_items_manifest_order(tmp_path):
    make_epub(tmp_path / "g.epub")
    items = epub_documents((tmp_path / "g.epub").read_bytes())
    assert len(items) == 2 and GARDEN[0] in items[0] and GARDEN[2] in items[1]


def test_file_documents_and_statuses(spark, tmp_path):
    make_files(tmp_path)
    docs = {os.path.basename(r.path): r for r in file_documents(read_files(spark, str(tmp_path))).collect()}
    assert docs["a.txt"].text == " ".join(GARDEN)
    assert docs["b.MD"].text == " ".join(GARDEN)
    assert docs["c.md"].text.endswith("Café crème.")
    assert docs["d.pdf"].status == "unsupported_file"
    assert docs["f.epub"].status == "invalid_epub"
    assert docs["g.epub"].status == "ok" and docs["g.epub"].text == " ".join(GARDEN)


def test_summarize_files(spark, tmp_path):
    make_files(tmp_path)
    for processor in ("clean", "chunked"):
        out = {os.path.basename(r.path): r for r in summarize_files(spark, str(tmp_path), 2, processor=processor).collect()}
        assert out["a.txt"].summary == [GARDEN[0], GARDEN[2]]
        assert out["b.MD"].summary == [GARDEN[0], GARDEN[2]]
        if processor == "clean":
            assert out["g.epub"].summary == [GARDEN[0], GARDEN[2]]
        else:  # text nodes glued without a separator: "...length.Here is..." is one sentence
            assert out["g.epub"].summary[0] == GARDEN[0] + GARDEN[1]
        assert out["h.txt"].status in ("ok", "no_valid_sentences")
        assert out["e.txt"].status == "no_valid_sentences" and out["e.txt"].summary is None
        assert out["d.pdf"].status == "unsupported_file"
        assert out["f.epub"].status == "invalid_epub"


def test_corpus_folder_keeps_markdown_only(spark, tmp_path):
    make_files(tmp_path)
    names = sorted(os.path.basename(r.path) for r in corpus_files(spark, str(tmp_path)).collect())
    assert names == ["b.MD", "c.md"]


def test_sink_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, " ".join(GARDEN))], "doc_id long, text string")
    out = summarize(docs, 2)
    write_results(out, str(tmp_path / "p"))
    write_results(out, str(tmp_path / "j"), fmt="json")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    q = summarize_stream(
        spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), algorithm="diverse", max_files_per_trigger=1
    )
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch_id").distinct().count() == 3
    want = summarize(docs, algorithm="diverse")
    got = got.drop("batch_id")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
    # a second run finds no new files and writes nothing new
    q2 = summarize_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), algorithm="diverse")
    q2.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("batch_id").distinct().count() == 3


def test_file_stream_equals_folder_summary(spark, tmp_path):
    from precis.streaming.stream import summarize_file_stream

    make_files(tmp_path / "in")
    q = summarize_file_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), 2, max_files_per_trigger=3)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch_id").distinct().count() == 3  # 8 files, 3 per trigger
    want = summarize_files(spark, str(tmp_path / "in"), 2)
    got = got.drop("batch_id")
    assert got.count() == want.count() == 8
    assert got.exceptAll(want).count() == 0


def test_one_scan_one_unzip_no_exchange(spark, tmp_path):
    make_files(tmp_path)
    p = file_documents(read_files(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert p.count("FileScan binaryFile") == 1 and p.count("MapInPandas") == 1 and "Exchange" not in p


def test_workers_need_no_copy_of_the_library(tmp_path):
    import subprocess
    import sys

    make_files(tmp_path / "in")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from precis import summarize_files
assert summarize_files(spark, {str(tmp_path / "in")!r}, 2).where("status = 'ok'").count() >= 4
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=300).returncode == 0


def test_documents_that_arrive_again(spark, tmp_path):
    from precis.streaming.stream import current_summaries, newest, summarize_versions_stream

    rows = [(1, " ".join(GARDEN[:3]), 1), (2, " ".join(GARDEN), 1), (3, " ".join(GARDEN[1:]), 1), (1, " ".join(GARDEN), 2), (2, " ".join(GARDEN), 1), (3, "Short.", 5), (1, " ".join(GARDEN[:2]), 1), (3, " ".join(GARDEN[:3]), 4)]
    for k in range(0, 8, 2):  # four files, one a batch; the first holds one document twice
        part = rows[k : k + 2] + ([(2, "An old text that does not count any more, as a higher version is beside it.", 0)] if k == 0 else [])
        spark.createDataFrame(part, "doc_id long, text string, version long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), 2)
    summarize_versions_stream(*args, max_files_per_trigger=1).awaitTermination()
    want = summarize(newest(spark.createDataFrame(rows, "doc_id long, text string, version long")), 2)
    got = current_summaries(spark, str(tmp_path / "out"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 4
    # a batch written again changes nothing
    again = spark.read.parquet(str(tmp_path / "out") + "/batch_id=1").collect()
    spark.createDataFrame(again, want.schema).write.mode("overwrite").parquet(str(tmp_path / "out") + "/batch_id=1")
    assert current_summaries(spark, str(tmp_path / "out")).count() == 4


def test_corpus_idf_batch_by_batch(spark, tmp_path):
    from precis.config import SummaryConfig
    from precis.operators.tfidf import idf_corpus
    from precis.plans.summarize import kept_sentences
    from precis.streaming.stream import current_idf, idf_stream

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    docs.repartition(3, "doc_id").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        idf_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ckpt"), max_files_per_trigger=1).awaitTermination()
    want = {r.term: (r.df, round(r.idf, 9)) for r in idf_corpus(kept_sentences(docs, SummaryConfig())).collect()}
    assert {r.term: (r.df, round(r.idf, 9)) for r in current_idf(spark, str(tmp_path / "store")).collect()} == want and len(want) > 1000
    assert spark.read.parquet(str(tmp_path / "store")).select("batch_id").distinct().count() == 3
