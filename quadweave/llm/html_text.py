"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags. A block has its words and link density, those of the
blocks before and after it, and marks of the elements around it. Blocks that the page itself marks are
taken at its word: text of an article, main or so named element, or menu, footer, form, advert, comment.
All others are told by a decision tree over words, link density, neighbours and headings, grown from a
small table of labelled blocks (``html_examples``).

Pages: null and empty html gives an empty text. Character references are decoded. White space
inside a block becomes one space, blocks are joined in page order by one space; nothing is capped.
Unclosed and stray tags are tolerated; paragraphs, list items, terms, rows and cells end where HTML ends
them; a head, select or drawing without its end tag ends at the first
tag that it cannot hold, a head also at the first text. Repeated rows are read each. Empty tables give empty results.
"""

import re
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadweave.llm.common import slices

_SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "select", "textarea", "canvas", "audio", "video", "math", "map"}
# What a head, a title and a select hold, and what ends a drawing; other silent elements may hold anything.
_IN_HEAD = {"html", "head", "title", "base", "basefont", "bgsound", "link", "meta", "style", "script", "noscript", "noframes", "template"}
_IN_SELECT = {"option", "optgroup", "hr", "button", "div", "legend", "script", "style", "template", "noscript", "svg", "datalist", "selectedcontent"}
_ENDS_DRAWING = set("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li listing menu ol p pre table ul article main section".split())
_DRAWN_HTML = {"foreignobject", "desc", "title", "annotation-xml"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd",
    "label", "mark", "meta", "link", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "button", "picture", "source",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
_FORM_TAGS = {"form", "fieldset"}
_TEXT_TAGS = {"article", "main"}
# Fixed lists: words in class and id names that tell what an element is for.
_BOILER_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored cookie cookies consent gdpr notice notices "
    "alert popup modal overlay sidebar side nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs footer foot header masthead topbar toolbar "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations subscribe newsletter signup login "
    "search searchbox pagination pager tags tagcloud widget widgets skip toc copyright legal disclaimer feedback".split()
)
# Fixed list: names of places for readers' comments, unless with a word that tells a page's state.
_COMMENT_NAMES = set("comment comments commentlist disqus reply replies respond".split())
_STATE_NAMES = set("has no open opened closed with without on off enabled disabled allowed count link links".split())
_STRONG_NAMES = set("ad ads advert advertisement sponsored related recommended recommendations cookie cookies".split())
_TITLE_NAMES = {"header", "banner", "head"}
_TEXT_NAMES = set("article articlebody post entry content story main maintext".split())
_NAME = re.compile(r"[a-z]+")
# What ends an open paragraph, and what an open element of a list or table ends at: (tags that it ends, tags
# beyond which it does not reach).
_ENDS_P = set("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_P_SCOPE = {"table", "td", "th", "caption", "button", "object", "template"}
_LIST_SCOPE = {"ul", "ol", "menu", "dl", "table", "td", "th", "article", "section", "main", "aside", "nav", "header", "footer", "form", "blockquote", "button"}
_ROW_SCOPE = {"table"}
_CLOSES = {
    "li": ({"li"}, _LIST_SCOPE), "dt": ({"dt", "dd"}, _LIST_SCOPE), "dd": ({"dt", "dd"}, _LIST_SCOPE), "option": ({"option"}, {"select", "optgroup"}),
    "tr": ({"tr"}, _ROW_SCOPE), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot"}, _ROW_SCOPE), "tbody": ({"thead", "tbody", "tfoot"}, _ROW_SCOPE), "tfoot": ({"thead", "tbody", "tfoot"}, _ROW_SCOPE),
}
# Marks of boilerplate in rising order. An article resets all but the last.
_LAYOUT, _FORM, _CLASS, _FIXED = 1, 2, 3, 4
# How far inside the text: in an element named so, in a main element, in an article.
_NAMED, _MAIN, _ARTICLE = 1, 2, 3
_ROLES = {"navigation": True, "banner": True, "contentinfo": True, "complementary": True, "search": True, "dialog": True, "alert": True, "main": False, "article": False}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boiler: bool
    inside: bool
    heading: bool
    label: int | None = None

    @property
    def density(self):
        return self.linked / self.words if self.words else 0.0


def _hidden(attrs):
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "")


def _for_comments(names):
    """Whether a class or id names a place for readers' comments."""
    parts = (set(_NAME.findall(n)) for n in names)
    return any(p & _COMMENT_NAMES and not p & _STATE_NAMES for p in parts)


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts = [], []
        self.open = []  # (tag, boiler, inside, silent: place of the outermost silent element plus one, label)
        self.links = 0
        self.linked = 0
        self.heading = False
        self.found = False  # Text of an article, a main element or one named so, titles aside.

    def _state(self):
        return self.open[-1][1:] if self.open else (0, 0, 0, None)

    def flush(self):
        words = "".join(self.parts).split()
        if words:
            boiler, inside, _, label = self._state()
            self.blocks.append(Block(" ".join(words), len(words), self.linked, boiler > 0, inside > 0, self.heading, label))
            self.found = self.found or inside >= _NAMED and not boiler and not self.heading
        self.parts, self.linked = [], 0

    def _end_silent(self, tag):
        """Close the silent elements that cannot hold ``tag``."""
        at = self._state()[2] - 1
        first = self.open[at][0]
        if first == "head":
            ends = tag == "body" or self.open[-1][0] == "head" and tag not in _IN_HEAD
        elif first == "select":
            ends = tag not in _INLINE and tag not in _IN_SELECT
        elif first in ("svg", "math"):
            ends = tag in _ENDS_DRAWING and not any(o[0] in _DRAWN_HTML for o in self.open[at:])
        else:
            ends = False
        if ends:
            self.flush()
            del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if self._state()[2]:
            self._end_silent(tag)
        if tag == "br":
            self.parts.append("\n")
            return
        if tag == "a":
            self.links += 1
        attrs = dict(attrs)
        if tag in _INLINE and tag != "button" and (tag in _VOID or not (self._marked(attrs) or self._opened(tag))):
            return
        self.flush()
        if tag in _INLINE and tag != "button":
            self.open.append((tag, *self._inherit(tag, attrs)))
            return
        self.heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag in _ENDS_P:
            self._close({"p"}, _P_SCOPE)
        if tag in _VOID:
            return
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if self.heading and self.open and self.open[-1][0] == tag:
            self.open.pop()
        self.open.append((tag, *self._inherit(tag, attrs)))

    def _close(self, tags, scope):
        """End the innermost open element of ``tags``, if none of ``scope`` is between."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                del self.open[i:]
                return
            if self.open[i][0] in scope:
                return

    def _opened(self, tag):
        """Whether an element of that inline name carries a mark, so that its like must be counted."""
        return any(o[0] == tag for o in self.open)

    @staticmethod
    def _marked(attrs):
        """Whether an inline element is no text of its paragraph: an advert, a comment or hidden."""
        given = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()
        return _hidden(attrs) or not _STRONG_NAMES.isdisjoint(given) or _for_comments(given)

    def _inherit(self, tag, attrs):
        """State inside an element.

        An article or main element resets the marks of layout names and forms around it, and of class
        names as long as no text of an article was found: a page's wrapper, not a list of related articles
        after the text. Marks set inside an article stay, and so do those of comments.
        """
        boiler, inside, silent, label = self._state()
        given = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        names, whole = set(_NAME.findall(given)), set(given.split())
        role = _ROLES.get((attrs.get("role") or "").lower())
        hidden = _hidden(attrs) or tag != "body" and _for_comments(whole)
        strong = whole & _STRONG_NAMES
        if tag in _TEXT_TAGS or role is False:
            level = _MAIN if "main" in (tag, (attrs.get("role") or "").lower()) else _ARTICLE
            if hidden:
                boiler = _FIXED
            elif strong:
                boiler = max(boiler, _CLASS)
            elif boiler == _LAYOUT or boiler in (_FORM, _CLASS) and inside < _ARTICLE and not (boiler == _CLASS and self.found):
                if boiler == _CLASS:
                    # The wrapper is the page's: its further articles are text, too.
                    self.open[:] = [(t, 0 if mark == _CLASS else mark, *rest) for t, mark, *rest in self.open]
                boiler = 0
            inside = max(inside, level)
        elif tag != "body":
            named = names & (_BOILER_NAMES - _TITLE_NAMES if inside else _BOILER_NAMES)
            if tag in _BOILER_TAGS - _FORM_TAGS or role is True or hidden:
                boiler = _FIXED
            elif strong:
                boiler = max(boiler, _CLASS)
            elif tag in _FORM_TAGS:
                boiler = max(boiler, _FORM)
            elif boiler == _FORM and inside < _NAMED and whole & _TEXT_NAMES and not named:
                # A form around the whole page, its text in a box named so.
                boiler = 0
            elif named or tag == "header" and not inside:
                boiler = max(boiler, _LAYOUT)
            inside = max(inside, _NAMED if names & _TEXT_NAMES else 0)
        label = int(attrs["data-keep"]) if attrs.get("data-keep") in ("0", "1") else label
        return boiler, inside, silent or (tag in _SILENT and len(self.open) + 1), label

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = max(0, self.links - 1)
        inline = tag in _INLINE and tag != "button"
        if inline and not self._opened(tag):
            return
        self.flush()
        self.heading = self.heading and inline
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                # A link left open does not outlive the element around it.
                self.links = 0
                break

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.open.pop()
        if self._state()[2]:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.split())


def blocks_of(html) -> list[Block]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading")


def features(blocks: list[Block]) -> np.ndarray:
    rows = []
    for i, b in enumerate(blocks):
        before = blocks[i - 1] if i else None
        after = blocks[i + 1] if i + 1 < len(blocks) else None
        rows.append((
            b.words, b.density, before.words if before else 0, before.density if before else 0.0,
            after.words if after else 0, after.density if after else 0.0, b.heading,
        ))
    return np.array(rows, float).reshape(-1, len(FEATURES))


# --- decision tree ------------------------------------------------------------------------------


def _gini(y):
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p)


def grow(x: np.ndarray, y: np.ndarray, depth=6, least=2):
    """A tree of (feature, threshold, low side, high side) with shares of kept blocks as leaves."""
    if depth == 0 or len(y) < 2 * least or _gini(y) == 0:
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            n = int(low.sum())
            if least <= n <= len(y) - least:
                cost = n * _gini(y[low]) + (len(y) - n) * _gini(y[~low])
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(t), low)
    if best is None or best[0] >= len(y) * _gini(y) - 1e-12:
        return float(y.mean())
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def keeps(tree, row) -> bool:
    while not isinstance(tree, float):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree >= 0.5


def labelled_blocks(pages) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the unmarked blocks of pages whose elements carry ``data-keep``."""
    xs, ys = [], []
    for page in pages:
        blocks = blocks_of(page)
        for row, b in zip(features(blocks), blocks):
            if b.label is not None and not (b.boiler or b.inside):
                xs.append(row)
                ys.append(b.label)
    return np.array(xs), np.array(ys, float)


@lru_cache(maxsize=1)
def default_tree():
    from quadweave.llm.html_examples import PAGES

    return grow(*labelled_blocks(PAGES))


def main_text(html, tree) -> str:
    blocks = blocks_of(html)
    return " ".join(b.text for b, row in zip(blocks, features(blocks)) if not b.boiler and (b.inside or keeps(tree, row)))


def extract_text(pages: DataFrame, ident="page_id", url="url", html="html", tree=None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    tree = tree or default_tree()
    kind = pages.schema[ident].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 64):
            texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[ident, url, "text", "n_chars"],
            )

    return pages.select(F.col(ident), F.col(url).cast("string"), F.col(html)).mapInArrow(
        run, f"{ident} {kind}, {url} string, text string, n_chars long"
    )
