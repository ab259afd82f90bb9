"""HTML to text by one token grammar, against the standard library's parser."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from precis.functions import text as T


class Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.raw, self.open = [], 0, False

    def handle_starttag(self, tag, attrs):
        self.raw, self.open = tag in ("script", "style"), False

    def handle_endtag(self, tag):
        self.raw, self.open = 0, False

    def handle_startendtag(self, tag, attrs):
        self.open = False

    def handle_comment(self, data):
        self.open = False

    handle_decl = handle_pi = handle_comment

    def handle_data(self, data):
        if not self.raw:
            if self.open:  # one text, given in pieces
                self.parts[-1] += data
            else:
                self.parts.append(data)
            self.open = True

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.parts.append(data[6:])
        self.open = False


def visible(page):
    p = Text()
    p.feed(page)
    p.close()
    return p.parts


PIECES = [
    "plain text", " ", "<p>", "</p>", "<b class=x>", "</b>", '<a href="/x?a=1&b=2" title="2 > 1">', "</a>", "<img alt='a > b' src=x>", "<br/>", '<p data-a = "> <i>" >',
    "<!-- note <p> -->", "<!-- <script> -->", "<script>if (a < b && c > d) x = '<p>';</script>", "<STYLE type=text/css>p > a {}</style >", '<script src="a.js"/>', "<!DOCTYPE html>", "<?xml version='1.0'?>",
    "<![CDATA[raw <b> text]]>", "1 < 2", "a<3", "&lt;i&gt;", "&amp;amp;", "<div\nclass='y'\n>", '<input value="it\'s" disabled>', "</ p>", "<h1 id=a/b>", "<a title='say \"x>y\"'>",
]


def pages(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) + rng.choice(["", "", "<script>never closed <p>x</p>", "<style>a{}"])


def test_broken_pages_read_like_the_standard_parser(spark):
    made = list(pages(2000, 1))
    df = spark.createDataFrame(list(enumerate(made)), "k int, h string").repartition(4)
    got = {r.k: r for r in df.select("k", T.html_to_text("h").alias("t"), T.html_to_text_glued("h").alias("g")).collect()}
    for k, page in enumerate(made):
        assert got[k].t == " ".join(" ".join(visible(page)).split()), page
        assert got[k].g == "".join(visible(page)), page


def test_unclosed_quotes_and_many_attributes(spark):
    def one(page):
        return spark.createDataFrame([(page,)], "h string").select(T.html_to_text("h")).first()[0]

    assert one('a<p title="no end>b') == "a b"
    assert one("a<p " + " ".join(f'x{i}="{i}>"' for i in range(60)) + ">b") == "a b"
    assert one("a <b and no end") == "a <b and no end" and one("a <!-- and no end") == "a <!-- and no end"


def test_hostile_markup_stays_linear_and_needs_no_stack(spark):
    n = 60_000
    texts = ["<a " + "x=y " * n + ">z", "<a " + "= " * n, "<a b='" + "<" * n, "<" * n, "<!--" + "-" * n, "<script>" + "<" * n, '<p a="' + "x>" * n + '">z', "<p>" * n]
    df = spark.createDataFrame([(t,) for t in texts], "h string")
    t0 = time.time()
    assert df.select(F.sum(F.length(T.html_to_text("h")))).first()[0] > 0
    assert time.time() - t0 < 60
