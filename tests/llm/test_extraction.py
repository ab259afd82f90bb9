"""Main text of pages: tree builder, boosted trees, decoding, and whole pages."""

from __future__ import annotations

import html
import itertools
import re
from html.parser import HTMLParser

import numpy as np
import pytest

from precis.llm import boosting, registry
from precis.llm import extraction as X
from precis.llm.dom import Page, attribute_tokens

from .conftest import SF001


def runs(source):
    return [t for t in Page(source).texts if t]


def test_blocks_and_references():
    assert runs("<p>a <b>b</b>c<br>d<p>e&amp;f &lt;x&gt; &#233;&nbsp;g") == ["a bc d", "e&f <x> é g"]
    assert runs("<ul><li>one<li>two<ul><li>in</ul>after</ul>") == ["one", "two", "in", "after"]
    assert runs("<table><tr><td>1<td>2<tr><td>3</table>4") == ["1", "2", "3", "4"]
    assert runs("<head><title>t</title><style>p{}</style></head>x<script>if (a<b) '</p>'</script>y") == ["xy"]
    assert runs('a<img title="x>y">b<!-- <p>c</p> -->d<!doctype html><?x y>e') == ["abde"]
    assert runs("1 < 2 <3> </ > 4<a title='\">x</a>y") == ["1 < 2 <3> 4xy"]
    assert runs("<div>a<button>no<div>no</div></button>b</div><select><option>no</select>c") == ["ab", "c"]
    assert runs("<p>a</div></p></span>b") == ["a", "b"]
    assert runs("a<script>never closed <p>b") == ["a"] and runs("a<p never ends") == ["a"] and runs("a<!-- b") == ["a"]
    assert runs("") == [] and runs(" \n ") == []


def test_attribute_words():
    assert attribute_tokens(' class="postBody side-bar" data-class="no" ID=main') == ("postbody", "post", "body", "side-bar", "side", "bar", "main")


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title", "head")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title", "head")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_text_equals_the_standard_parser():
    made = X.Layouts(["Some words, here & there.", "Très <bien>!"], 4)
    for _ in range(100):
        page = made.page().replace("<button>ok</button>", "")
        own = Visible()
        own.feed(page)
        own.close()
        assert "".join("".join(runs(page)).split()) == "".join("".join(own.out).split())


def test_long_and_deep_pages():
    deep = "<div>" * 30_000 + "x" + "</div>" * 30_000
    model = X.fit([])
    assert X.main_texts([deep, "<p>" * 50_000, "<" * 50_000, "</div>" * 50_000, '<a b="' * 50_000], model)[1:2] == [""]
    long = "<article><h1>t</h1>" + "".join(f"<p>{'word ' * 40}{i}.</p>" for i in range(5000)) + "</article>"
    assert X.main_texts([long], model)[0].count("\n") == 5000


def test_best_split_matches_brute_force():
    rng = np.random.default_rng(3)
    bins, node = rng.integers(0, 6, (80, 3)).astype(np.uint8), rng.integers(0, 2, 80)
    g, h = rng.normal(size=80), rng.random(80) + 0.1
    feature, bin_ = boosting.best_splits(bins, node, 2, g, h, 1.0)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    for k in range(2):
        own = node == k
        gain = lambda f, b: score(own & (bins[:, f] <= b)) + score(own & (bins[:, f] > b)) - score(own)  # noqa: E731,B023
        best = max(gain(f, b) for f in range(3) for b in range(5))
        assert abs(gain(feature[k], bin_[k]) - best) < 1e-9


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit(x, y)
    new = rng.normal(size=(2000, 4))
    assert ((model.log_odds(new) > 0) == ((new[:, 0] > 0) ^ (new[:, 1] > 0.3))).mean() > 0.97
    assert (boosting.fit(x, np.ones(2000)).log_odds(new) > 0).all() and boosting.fit(x[:0], y[:0]).log_odds(new).shape == (2000,)


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(1)
    sources = ["<div><p>a</p>b<ul><li>c<li>d</ul></div>e", "<div><div><div>a</div></div></div>", "<p>a<p>b"]
    nodes = X.Nodes([Page(s) for s in sources])
    for _ in range(30):
        votes = rng.normal(size=len(nodes.parent))
        kept = X.decoded(nodes, votes)
        for page in range(len(sources)):
            own = np.flatnonzero(nodes.page == page)
            root, rest = own[0], own[1:]
            best = -np.inf
            for choice in itertools.product([False, True], repeat=len(rest)):
                state = {root: True, **dict(zip(rest, choice, strict=True))}
                if all(state[nodes.parent[i]] or not state[i] for i in rest):
                    best = max(best, sum(votes[i] if state[i] else -votes[i] for i in own))
            assert all(kept[nodes.parent[i]] or not kept[i] for i in rest) and kept[root]
            assert abs(sum(votes[i] if kept[i] else -votes[i] for i in own) - best) < 1e-9


def test_every_page_of_the_table(spark, con):
    got = {r.page_id: r for r in registry.QUERIES["op12_html_extraction"](spark, SF001).collect()}
    pages = con.sql("SELECT page_id, url, html FROM pages").fetchall()
    assert len(got) == len(pages)
    for page_id, url, source in pages:
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[page_id].text == want and got[page_id].n_chars == len(want) and got[page_id].url == url


def test_pages_without_marks(con):
    """Articles in plain elements among notices, comments, menus and adverts; texts and
    arrangement of the test are not those of the fit."""
    pages = [r[0] for r in con.sql("SELECT html FROM pages ORDER BY page_id").fetchall()]
    model = X.fit(pages[:25])
    prose = [t for s in pages[25:] for t in X.main_texts([s], model)[0].split("\n")]
    made = X.Layouts(prose, 77)
    kept = dropped = wrong = 0
    for _ in range(200):
        page = made.page()
        parsed = Page(page)
        labels = X.run_labels(X.Nodes([parsed]))
        want = [t for t, good in zip(parsed.texts, labels, strict=True) if good]
        got = X.main_texts([page], model)[0].split("\n")
        kept += len(want)
        dropped += len(set(want) - set(got))
        wrong += len(set(got) - set(want))
    assert dropped <= 0.02 * kept and wrong <= 0.02 * kept


def test_edges(spark):
    rows = [(1, "u", None, "x"), (1, None, "", "y"), (None, "u", "<p>", "z"), (2, "u", "plain text & more, not marked up at all", None), (2, "u", "<article><p>a&nbsp; b\n c</p></article>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = X.extract(df).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id == 1] == ["", ""]
    assert X.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("order", [1, 7])
def test_the_same_table_gives_the_same_trees(spark, order):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    assert X.training_pages(pages.repartition(order)) == X.training_pages(pages)
