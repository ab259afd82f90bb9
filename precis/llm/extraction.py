"""Main text of web pages: boosted trees over page nodes, decoded from the top down.

Every node of a page's tree (block elements and text runs) gets features of its subtree (text,
link, punctuation and node density), its attribute tokens, its depth and place, its siblings,
and of what stands above it; gradient-boosted trees give the log-odds that its text belongs to
the article. Decoding takes the best consistent choice of the whole tree: a node can be kept
only if all nodes above it are, and the sum of the log-odds of kept minus dropped nodes is the
largest possible, so no run is kept inside a dropped part and none dropped by a stray vote.

The trees are fitted here. Labels come from the pages themselves: of at most ``SAMPLE`` pages of
at most ``SAMPLE_CHARS`` characters (the smallest hashes of their ids, from all pages) those that
mark their article by its element are labelled by it, and their blocks fill ``LAYOUTS`` arranged
pages each, with articles, menus, notices, adverts, forms and comments in known places, so that
the trees also learn pages that mark nothing. The same table gives the same trees. Each page of
the table is then read, decided and written in the task that holds it.

A null or empty page gives an empty text. Ids may be null or repeat. A run's white space is one
space; ``br`` counts as white space; blocks are joined by one line feed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .dom import Page

SAMPLE = 120
SAMPLE_CHARS = 100_000
LAYOUTS = 3
SEED = 12
#: Pages whose nodes are held at once.
GROUP = 256
#: A vote counts at most so many log-odds.
CLIP = 4.0

# Attribute words by the kind of part that they name (fixed values).
KINDS = {
    "content": "article articles body content entry main page post story text prose copy column paragraph",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager tabs toc toolbar topbar skip links",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner commercial dfp adsense outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notices privacy popup modal overlay alert warning disclaimer paywall dialog",
    "comment": "comment comments commentlist respond reply replies discussion disqus reviews feedback thread",
    "side": "aside sidebar sidebars side rail widget widgets secondary complementary",
    "foot": "footer foot bottom copyright legal colophon contentinfo",
    "head": "header head masthead top branding logo tagline site banner",
    "form": "form forms search login signin signup register subscribe subscription newsletter contact input",
    "related": "related recommended recommendations more trending popular latest read-more share sharing social follow tags tag categories author meta byline",
}
_KIND = {word: 1 << k for k, words in enumerate(KINDS.values()) for word in words.split()}
_TAG_GROUPS = [
    ("#text",), ("p", "pre", "blockquote", "address"), ("h1",), ("h2", "h3", "h4", "h5", "h6", "hgroup"), ("ul", "ol", "dl", "menu", "dir"), ("li", "dd", "dt"),
    ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("div", "section", "center", "body", "html"), ("article", "main"), ("nav",), ("header",),
    ("footer",), ("aside",), ("form", "fieldset", "legend", "search"), ("figure", "figcaption", "details", "summary", "dialog"),
]
_GROUP = {tag: k for k, tags in enumerate(_TAG_GROUPS) for tag in tags}
_ARTICLE, _NAV, _HEADER, _FOOTER, _ASIDE, _FORM = (_GROUP[t] for t in ("article", "nav", "header", "footer", "aside", "form"))
_PUNCTUATION = str.maketrans("", "", ".,;:!?")
KEEP, DROP = "_keep_", "_drop_"


# --- features -----------------------------------------------------------------------------------
class Nodes:
    """The nodes of several pages in one table, page after page; parents stand before children."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = [len(p.tags) for p in pages]
        self.page = np.repeat(np.arange(len(pages)), sizes)
        offset = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes) if sizes else np.zeros(0, np.int64)
        parent = np.array([i for p in pages for i in p.parents], np.int64)
        self.root = parent < 0
        self.parent = np.where(self.root, np.arange(len(parent)), parent + offset)
        self.texts = [t for p in pages for t in p.texts]
        self.tags = [t for p in pages for t in p.tags]
        self.tokens = [t for p in pages for t in p.tokens]
        self.group = np.array([_GROUP.get(t, _GROUP["div"]) for t in self.tags], np.int64)
        self.kinds = np.array([sum({_KIND.get(w, 0) for w in words}) for words in self.tokens], np.int64)
        self.links = np.array([n for p in pages for n in p.links], np.float64)
        self.depth = np.zeros(len(parent), np.int64)
        self.levels: list[np.ndarray] = []
        level = np.flatnonzero(self.root)
        order = np.argsort(self.parent, kind="stable")
        firsts, lasts = np.searchsorted(self.parent[order], np.arange(len(parent))), np.searchsorted(self.parent[order], np.arange(len(parent)), side="right")
        while len(level):
            self.depth[level] = len(self.levels)
            self.levels.append(level)
            spans = [order[a:b] for a, b in zip(firsts[level], lasts[level], strict=True) if b > a]
            level = np.concatenate(spans) if spans else np.zeros(0, np.int64)
            level = level[~self.root[level]]

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.astype(np.float64)
        for level in self.levels[:0:-1]:
            np.add.at(out, self.parent[level], out[level])
        return out

    def below(self, bits: np.ndarray) -> np.ndarray:
        """Bits of a node and of all nodes above it."""
        out = bits.copy()
        for level in self.levels[1:]:
            out[level] |= out[self.parent[level]]
        return out

    def features(self) -> np.ndarray:
        n = len(self.parent)
        own = np.array([len(t) for t in self.texts], np.float64)
        chars, links = self.up(own), self.up(self.links)
        words = self.up(np.array([t.count(" ") + 1 if t else 0 for t in self.texts]))
        marks = self.up(np.array([len(t) - len(t.translate(_PUNCTUATION)) for t in self.texts]))
        runs, nodes = self.up(own > 0), self.up(np.ones(n))
        density = links / np.maximum(chars, 1)
        start = np.cumsum(own) - own
        page_first = np.flatnonzero(self.root)[self.page] if n else self.page
        page_chars = np.maximum(chars[page_first], 1)
        child = ~self.root
        siblings = np.bincount(self.parent[child], minlength=n).astype(np.float64)
        place = np.zeros(n)
        for level in self.levels[1:]:  # children of a node stand together and in page order
            first = np.concatenate(([True], self.parent[level][1:] != self.parent[level][:-1]))
            head = np.maximum.accumulate(np.where(first, np.arange(len(level)), 0))
            place[level] = np.arange(len(level)) - head
        count = np.maximum(siblings[self.parent], 1)
        alike = self.parent * len(_TAG_GROUPS) + self.group
        _, same, sizes = np.unique(alike, return_inverse=True, return_counts=True)
        mean = lambda v: np.bincount(self.parent[child], v[child], n)[self.parent] / count
        tag_bits = 1 << self.group
        above_tags, above_kinds = self.below(tag_bits), self.below(self.kinds)
        up = self.parent
        columns = [
            np.log1p(chars), density, marks / np.maximum(words, 1), np.log1p(words / np.maximum(runs, 1)), 100 * nodes / np.maximum(chars, 1), np.log1p(runs),
            self.depth, (start - start[page_first]) / page_chars, chars / page_chars, chars / np.maximum(chars[up], 1),
            np.log1p(count), place / count, sizes[same] / count, mean(density), np.log1p(mean(chars)), density[up], np.log1p(chars[up]),
        ]
        columns += [self.group == k for k in range(len(_TAG_GROUPS))]
        columns += [(self.kinds >> k) & 1 for k in range(len(KINDS))] + [(above_kinds >> k) & 1 for k in range(len(KINDS))]
        columns += [(above_tags >> k) & 1 for k in (_ARTICLE, _NAV, _HEADER, _FOOTER, _ASIDE, _FORM)]
        return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def decoded(nodes: Nodes, votes: np.ndarray) -> np.ndarray:
    """The best choice of kept nodes: each below kept nodes only, roots kept, and the votes of
    the kept minus those of the dropped as large as possible."""
    dropped = -nodes.up(votes)
    best = votes.astype(np.float64).copy()  # if the node is kept
    for level in nodes.levels[:0:-1]:
        np.add.at(best, nodes.parent[level], np.maximum(best[level], dropped[level]))
    kept = nodes.root.copy()
    for level in nodes.levels[1:]:
        kept[level] = kept[nodes.parent[level]] & (best[level] > dropped[level])
    return kept


def main_texts(sources: list[str], model: boosting.Trees) -> list[str]:
    """The kept runs of each page, joined by a line feed."""
    nodes = Nodes([Page(s) for s in sources])
    kept = decoded(nodes, np.clip(model.log_odds(nodes.features()), -CLIP, CLIP))
    out: list[list[str]] = [[] for _ in sources]
    for i in np.flatnonzero(kept):
        if nodes.texts[i]:
            out[nodes.page[i]].append(nodes.texts[i])
    return ["\n".join(t) for t in out]


# --- labels ---------------------------------------------------------------------------------------
def run_labels(nodes: Nodes) -> np.ndarray:
    """For text runs: whether the page's own marks put them in its article."""
    inside = np.zeros(len(nodes.parent), bool)
    parts = {k: 1 << i for i, k in enumerate(KINDS)}
    junk = parts["advert"] | parts["notice"] | parts["comment"]
    for level in nodes.levels:
        for i in level:
            above = bool(inside[nodes.parent[i]])
            words, group = nodes.tokens[i], nodes.group[i]
            if KEEP in words or (group == _ARTICLE and DROP not in words):
                above = True
            elif DROP in words or group in (_NAV, _FOOTER, _ASIDE, _FORM) or (nodes.kinds[i] & junk and not nodes.kinds[i] & parts["content"]):
                above = False
            inside[i] = above
    return inside & (nodes.group == 0)


def _examples(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of nodes with text: a node is in if most of its text is."""
    nodes = Nodes(pages)
    own = np.array([len(t) for t in nodes.texts], np.float64)
    chars, good = nodes.up(own), nodes.up(own * run_labels(nodes))
    some = (chars > 0) & ~nodes.root
    return nodes.features()[some], (good > 0.5 * chars)[some].astype(np.float64)


class Layouts:
    """Arranged pages: the given texts in articles and in everything that is none."""

    def __init__(self, prose: list[str], seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.prose = prose or [" ".join(f"word{(7 * i + k) % 89}" for i in range(8 + k % 40)) + "." for k in range(200)]

    def pick(self, *of):
        return of[int(self.rng.integers(len(of)))]

    def text(self, longest: int = 10_000) -> str:
        text = self.pick(*self.prose)[:longest]
        return text.replace("&", "&amp;").replace("<", "&lt;")

    def words(self, n: int) -> str:
        return " ".join(self.text().split()[: int(self.rng.integers(1, n + 1))])

    def named(self, kind: str) -> str:
        """A class or id of the kind, sometimes none."""
        word = self.pick(*KINDS[kind].split())
        return self.pick(f' class="{word}"', f' id="{word}"', f' class="{word}-{self.pick("box", "block", "wrap", "area", "list")} x1"', f' class="{word} y2"', "")

    def many(self, low: int, high: int, part) -> str:
        return "".join(part() for _ in range(int(self.rng.integers(low, high + 1))))

    def links(self) -> str:
        one = lambda: f'<a href="/x">{self.words(3)}</a>'
        return self.pick(lambda: "<ul>" + self.many(2, 8, lambda: f"<li>{one()}{self.pick('</li>', '')}") + "</ul>", lambda: self.many(2, 8, lambda: one() + " "))()

    def junk(self, inside: bool = False) -> str:
        """A part that is not of the article; ``inside``: one that may stand within it."""
        prose = lambda low, high: self.many(low, high, lambda: f"<p>{self.text(400)}</p>")
        named = lambda kind: _marked(self.named(kind) or f' class="{self.pick(*KINDS[kind].split())}"', DROP)
        box = lambda kind, inner, tag=None: f"<{tag or 'div'}{named(kind)}>{inner}</{tag or 'div'}>"
        form = lambda: f'<form class="{DROP}{self.pick(" search", " newsletter", "")}"><label>{self.words(4)}</label><input><p>{self.text(150)}</p><button>ok</button></form>'
        makers = [
            lambda: box("advert", self.pick(self.text(200), prose(1, 2), f'<a href="/ad">{self.words(8)}</a>')),
            lambda: box("related", f"<h3>{self.words(3)}</h3>{self.links()}", self.pick("div", "section", "aside")),
            form,
            lambda: box("notice", self.pick(self.text(250), prose(1, 2)), self.pick("div", "section")),
            lambda: box("side", prose(1, 2) + self.links(), "aside"),
        ]
        outside = [
            lambda: f'<nav class="{DROP}">{self.links()}</nav>',
            lambda: box("menu", self.links()),
            lambda: box("side", f"<h3>{self.words(3)}</h3>" + self.pick(self.links(), prose(1, 3)), self.pick("div", "aside", "section")),
            lambda: box("comment", f"<h3>{self.words(2)}</h3>" + self.many(1, 5, lambda: f"<div class=\"{self.pick('comment', 'reply', 'x')}\"><b>{self.words(2)}</b>{prose(1, 2)}</div>"), self.pick("div", "section", "ol")),
        ]
        return self.pick(*(makers if inside else makers + outside))()

    def article(self) -> str:
        block = lambda: self.pick(
            *[lambda: f"<p>{self.text()}{self.pick('</p>', '</p>', '')}"] * 6,
            lambda: f"<p>{self.words(6)}</p>",
            lambda: f"<p><b>{self.text(80)}<br><p>{self.text()}</p>",
            lambda: f'<p>{self.text(300)} <a href="/y">{self.words(4)}</a> {self.text(300)}</p>',
            lambda: f"<h2>{self.words(6)}</h2>",
            lambda: "<ul>" + self.many(2, 5, lambda: f"<li>{self.words(12)}</li>") + "</ul>",
            lambda: f"<blockquote><p>{self.text(300)}</p></blockquote>",
            lambda: "<table>" + self.many(1, 3, lambda: f"<tr><td>{self.words(3)}<td>{self.words(3)}</tr>") + "</table>",
            lambda: f"<figure><img src=a><figcaption>{self.words(10)}</figcaption></figure>",
        )()
        title = f"<h1>{self.text(70)}</h1>"
        title = self.pick(title, title, f"<header>{title}</header>")
        blocks = [block() for _ in range(int(self.rng.integers(1, 14)))]
        for _ in range(self.pick(0, 0, 1, 2)):
            blocks.insert(int(self.rng.integers(len(blocks) + 1)), self.junk(inside=True))
        inner = title + "".join(blocks)
        for _ in range(self.pick(0, 0, 0, 1, 2)):
            inner = f"<div{self.pick('', '', ' class=inner')}>{inner}</div>"
        tag = self.pick("article", "article", "main", "div", "div", "section")
        named = self.named("content") if tag != "div" or self.rng.random() < 0.7 else ""
        return f"<{tag}{_marked(named, KEEP)}>{inner}</{tag}>"

    def page(self) -> str:
        top = self.pick(
            lambda: f'<header class="{DROP}"><div>{self.words(3)}</div>{self.links()}</header>',
            lambda: f'<div class="{self.pick("header", "masthead", "top")} {DROP}"><h1>{self.words(2)}</h1><p>{self.words(8)}</p>{self.links()}</div>',
            lambda: f'<nav class="{DROP}">{self.links()}</nav>',
            lambda: "",
        )()
        foot = self.pick(
            lambda: f'<footer class="{DROP}">&copy; {self.words(5)} &middot; {self.text(100)}</footer>',
            lambda: f'<div class="{self.pick("footer", "bottom", "copyright")} {DROP}"><p>&copy; {self.words(6)}</p>{self.links()}</div>',
            lambda: "",
        )()
        middle = self.many(0, 2, self.junk) + self.article() + self.many(0, 3, self.junk)
        for _ in range(self.pick(0, 0, 1, 2)):
            middle = f"<div{self.pick('', ' class=wrapper', ' id=page', ' class=container')}>{middle}</div>"
        return f"<html><head><title>{self.words(5)}</title></head><body>{top}{middle}{foot}</body></html>"


def _marked(named: str, mark: str) -> str:
    """Attributes with the label added to their class."""
    return named.replace('class="', f'class="{mark} ') if 'class="' in named else f'{named} class="{mark}"'


def fit(sources: list[str], seed: int = SEED) -> boosting.Trees:
    """Trees from pages that mark their article, and from pages arranged of their texts."""
    pages = [Page(s) for s in sources]
    marked = [p for p in pages if sum(t in ("article", "main") for t in p.tags) == 1]
    prose = sorted({t for p in marked for t, good in zip(p.texts, run_labels(Nodes([p])), strict=True) if good})
    prose = prose or sorted({t for p in pages for t in p.texts if t})
    arranged = Layouts(prose, seed)
    made = [Page(arranged.page()) for _ in range(LAYOUTS * SAMPLE)]
    x, y = _examples(marked + made)
    return boosting.fit(x, y)


def training_pages(pages: DataFrame) -> list[str]:
    """At most ``SAMPLE`` pages by the hash of their ids and texts."""
    plain = pages.select(F.xxhash64("page_id", "html", F.lit(SEED)).alias("h"), F.col("html").cast("string").alias("html"))
    able = plain.where(F.length("html").between(1, SAMPLE_CHARS))
    # a few times as many as needed by their hash, so that tasks send few rows to be sorted
    share = 4 * SAMPLE / max(able.count(), 1)
    able = able if share >= 1 else able.where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    return [r.html for r in able.orderBy("h", "html").limit(SAMPLE).collect()]


def _extracted(model: boosting.Trees):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                texts = main_texts([t.as_py() or "" for t in some.column("html")], model)
                cols = [some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    model = fit(training_pages(pages))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(_extracted(model), "page_id long, url string, text string, n_chars long")
