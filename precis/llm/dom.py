"""HTML pages as trees of block elements and text runs (used inside tasks).

One pass over the markup: comments, declarations and the contents of raw-text elements go, tags
end at the first ``>`` outside a quoted attribute value, end tags may be missing where HTML lets
them. Elements that do not start a block leave no node: their text joins the run around them. A
run is the text between two block borders; its character references are decoded and its white
space becomes single spaces. The work is linear in the page's length, and nothing recurses.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

# Fixed values of HTML: elements that start a block, that hold no markup, and that end by themselves.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is never part of a page's visible article.
UNSEEN = frozenset("head noscript template select button datalist object canvas audio video svg".split())
_KEEP_P = frozenset("body html td th tr tbody thead tfoot caption legend summary".split())
_IN_HEAD = frozenset("meta link title base style script noscript template".split())
#: Which open elements a start tag ends, and at which open elements the search for them stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
# A value in quotes counts as such only after "="; one that is never closed is plain text.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""")
_NAMED = re.compile(r"""(?<![^\s"'/])(?:class|id|role)\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


@lru_cache(maxsize=4096)
def attribute_tokens(attributes: str) -> tuple[str, ...]:
    """Lower-case words of the class, id and role of a tag, also within compounds."""
    out: list[str] = []
    for value in _NAMED.findall(attributes):
        for name in value.strip("\"'").split():
            parts = [p.lower() for p in _PART.findall(name)]
            out += [name.lower(), *parts] if parts != [name.lower()] else parts
    return tuple(dict.fromkeys(out))


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


class Page:
    """Nodes in page order: ``tags`` (``#text`` for a run), ``parents`` (-1: none), ``tokens`` of
    the attributes, and a run's ``texts`` and number of characters in ``links``."""

    def __init__(self, source: str) -> None:
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.tokens: list[tuple[str, ...]] = []
        self.texts: list[str] = []
        self.links: list[int] = []
        self._stack: list[int] = []
        self._open: dict[str, int] = {}
        self._run: list[str] = []
        self._linked = 0
        self._link: int | None = None  # open elements when the current link began
        self._unseen = 0
        self._node("html", ())
        self._push(0)
        self._read(source)
        self._unseen = 0
        self._end_run()

    # --- nodes ---
    def _node(self, tag: str, tokens: tuple[str, ...], text: str = "", linked: int = 0) -> int:
        self.tags.append(tag)
        self.parents.append(self._stack[-1] if self._stack else -1)
        self.tokens.append(tokens)
        self.texts.append(text)
        self.links.append(linked)
        return len(self.tags) - 1

    def _push(self, node: int) -> None:
        tag = self.tags[node]
        self._stack.append(node)
        self._open[tag] = self._open.get(tag, 0) + 1
        self._unseen += tag in UNSEEN

    def _pop(self) -> str:
        self._end_run()
        tag = self.tags[self._stack.pop()]
        self._open[tag] -= 1
        self._unseen -= tag in UNSEEN
        if self._link is not None and self._link > len(self._stack):
            self._link = None
        return tag

    def _end_run(self) -> None:
        if self._run and not self._unseen:  # what stands inside unseen elements breaks no run
            text = " ".join("".join(self._run).split())
            if text:
                self._node("#text", (), text, min(self._linked, len(text)))
            self._run, self._linked = [], 0

    # --- tags ---
    def _text(self, text: str) -> None:
        if self._unseen:
            if self.tags[self._stack[-1]] != "head" or text.isspace():
                return
            self._pop()  # text ends the head
        text = html.unescape(text) if "&" in text else text
        self._run.append(text)
        if self._link is not None:
            self._linked += len(text.strip())

    def _end_nearest(self, ended: set[str], stop: set[str]) -> None:
        if any(self._open.get(t) for t in ended):
            for k in range(len(self._stack) - 1, 0, -1):
                tag = self.tags[self._stack[k]]
                if tag in ended:
                    while len(self._stack) > k:
                        self._pop()
                    return
                if tag in stop:
                    return

    def _start(self, tag: str, attributes: str) -> None:
        if self.tags[self._stack[-1]] == "head" and tag not in _IN_HEAD:
            self._pop()
        if tag == "a":
            self._link = len(self._stack)
        elif tag in ("br", "wbr"):
            self._run.append(" " if tag == "br" else "")
        elif tag == "hr":
            self._end_run()
            self._end_nearest({"p"}, {self.tags[self._stack[-1]]} - {"p"})
        elif tag in UNSEEN or tag in BLOCKS:
            if tag in ("html", "body", "head") and self._open.get(tag):
                return
            if tag in BLOCKS:
                self._end_run()
            if tag in BLOCKS and tag not in _KEEP_P and self.tags[self._stack[-1]] == "p":
                self._pop()
            if tag in _ENDS:
                self._end_nearest(*_ENDS[tag])
            self._push(self._node(tag, attribute_tokens(attributes)))

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._link = None
        elif tag == "br":
            self._run.append(" ")
        elif tag not in ("html", "body") and self._open.get(tag):
            while self._pop() != tag:
                pass

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                return self._text(source[at:])
            if lt > at:
                self._text(source[at:lt])
            after = source[lt + 1 : lt + 2]
            name = source[lt + 2 : lt + 3] if after == "/" else after
            if name.isascii() and name.isalpha():
                m = _TAG.match(source, lt)
                if m is None:  # a tag that never ends takes the rest with it
                    return None
                at, tag = m.end(), m[2].lower()
                if m[1]:
                    self._end(tag)
                elif tag in RAW:
                    end = _end_of(tag).search(source, at)
                    if end is None:
                        return None
                    at = end.start()
                else:
                    self._start(tag, m[3])
            elif after in ("!", "?", "/"):
                mark = "-->" if source.startswith("<!--", lt) else ">"
                end = source.find(mark, lt + 2)
                if end < 0:
                    return None
                at = end + len(mark)
            else:
                self._text("<")
                at = lt + 1
