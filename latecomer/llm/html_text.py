"""Main text of web pages: text-to-tag ratio, Gaussian smoothing and threshold clustering.

The standard library's parser streams events into **lines**: a line is the text between two block tags, with the
number of tags met, and the chain of open elements. A line inside boilerplate elements (menus, headers,
footers, sidebars, notices, adverts, forms, comments: by tag, ARIA role, or class or id word; within an article or main
by whole classes, not by ids or parts of names) has no content.

1. The text-to-tag ratio of a line is its letters over the tags in it (one at least).
2. Ratios are smoothed with a Gaussian kernel (``SIGMA`` lines), so that short lines between long ones count.
3. Lines whose smoothed ratio passes the threshold (a share of the mean) cluster into content regions.
4. The element that holds the regions is the content: of the ``article`` (else ``main``) elements around selected lines,
   the one with the most selected text; on pages without them, the innermost element around all selected lines. All its
   lines that aren't boilerplate are returned, so that short paragraphs of the article aren't lost.

Cases: NULL or empty pages and pages without text have empty text; unclosed and stray tags are tolerated; pages
are independent (repeated rows are equal); an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, table

SIGMA = 1.5
THRESHOLD = 0.3

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr".split())
_SILENT = frozenset("script style noscript template head title svg iframe object select option datalist "
                    "textarea canvas audio video annotation annotation-xml".split())
#: Silent elements that don't end the line around them.
_QUIET = frozenset("script style noscript template".split())
_BOILER = frozenset("nav header footer aside form menu button dialog fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_NAMES = (r"ads?|adverts?|advertisements?|advertising|advertorial|sponsors?|sponsored|promos?|banner|nav|navbar|navigation|"
          r"menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|related|share|sharing|social|comments?|disqus|"
          r"replies|respond|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|login|search|pagination|"
          r"pager")
_BOILER_WORD = re.compile(rf"(?:^|[\s_-])(?:{_NAMES})(?:$|[\s_-])", re.I)
#: Within an article or main a whole class has to name boilerplate; ids come from titles there, and so do those of headings.
_BOILER_CLASS = re.compile(rf"(?:^|\s)(?:{_NAMES})(?:$|\s)", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of a head; any other one ends an open head (its end tag may be left out).
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
#: A new element of these closes an open one of the same kind (end tags may be left out).
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
           "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BLOCK_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                          "header hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("article section main div body td th table ul ol dl blockquote nav aside header footer form".split())


class _Lines(HTMLParser):
    """Lines (text, tags, element, boilerplate) of a page; elements are numbered, with their parents."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names, self.parents = ["#page"], [-1]
        self.open = [0]                      # numbers of the open elements
        self.head = False                    # whether a head was opened
        self.silent = self.boiler = 0        # open elements without text, or with boilerplate
        self.kind = [""]                     # of each open element: 's'ilent, 'b'oilerplate or ''
        self.lines: list[tuple[str, int, int, bool]] = []
        self.text: list[str] = []
        self.tags = 0

    def _break(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self._block(), self.boiler > 0))
                self.tags = 0
            self.text = []

    def _block(self) -> int:
        return next((n for n in reversed(self.open) if self.names[n] not in _INLINE), 0)

    def _pop(self, depth: int) -> None:
        while len(self.open) > depth:
            self.open.pop()
            kind = self.kind.pop()
            self.silent -= kind == "s"
            self.boiler -= kind == "b"

    def _close(self, tags, stop=_SCOPE) -> None:
        """Close the innermost open element of ``tags`` within the nearest scope element."""
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.names[self.open[depth]]
            if name in tags:
                self._pop(depth)
                return
            if name in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE and tag not in _QUIET and tag != "br":
            self._break()
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if self.head and tag not in _HEAD and self.names[self.open[-1]] == "head":
            self._pop(len(self.open) - 1)
            self.head = False
        if tag in _VOID:
            return
        if tag in _CLOSES and tag != "p":
            self._close(_CLOSES[tag], _SCOPE - {tag, "td", "th"})
        elif tag in _BLOCK_ENDS_P:
            self._close(("p",))
        kind = ""
        if tag in _SILENT:
            kind = "s"
        elif tag in _BOILER and not (tag == "header" and any(self.names[n] == "article" for n in self.open)):
            kind = "b"
        elif attrs and tag not in ("html", "body", "article", "main"):
            at = dict(attrs)
            words = f"{at.get('class') or ''} {at.get('id') or ''}"
            if at.get("role") in _ROLES or "hidden" in at:
                kind = "b"
            elif words != " " and tag not in _HEADINGS and _BOILER_WORD.search(words):
                inside = any(self.names[n] in ("article", "main") for n in self.open)
                kind = "b" if not inside or _BOILER_CLASS.search(at.get("class") or "") else ""
        self.head |= tag == "head"
        self.silent += kind == "s"
        self.boiler += kind == "b"
        self.names.append(tag)
        self.parents.append(self.open[-1])
        self.open.append(len(self.names) - 1)
        self.kind.append(kind)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in _INLINE and tag not in _QUIET:
            self._break()
        self.tags += 1
        names = self.names
        for depth in range(len(self.open) - 1, 0, -1):
            name = names[self.open[depth]]
            if name == tag:
                self._pop(depth)
                return
            if tag in _INLINE and name not in _INLINE:
                return                       # a stray inline end tag closes no block

    def handle_data(self, data):
        if self.head and self.names[self.open[-1]] == "head" and not data.isspace():
            self._pop(len(self.open) - 1)    # text ends a head, too
            self.head = False
        if not self.silent:
            self.text.append(data)

    def finish(self):
        self.close()
        self._break()
        return self


def _smooth(ratio: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.convolve(ratio, kernel)[reach:-reach]
    return padded / np.convolve(np.ones(len(ratio)), kernel)[reach:-reach]


def regions(lines, sigma: float = SIGMA, threshold: float = THRESHOLD) -> np.ndarray:
    """Which lines belong to a content region."""
    ratio = np.array([0.0 if boiler else len(text) / max(1, tags) for text, tags, _, boiler in lines])
    smooth = _smooth(ratio, sigma)
    return (smooth >= threshold * smooth.mean()) & (ratio > 0)


def main_text(html: str | None) -> str:
    """Blocks of the article, joined by one space."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.finish()
    lines = page.lines
    chosen = regions(lines) if lines else np.zeros(0, bool)
    if not chosen.any():
        return ""
    weight: dict[int, int] = {}
    common: list[int] | None = None
    for (text, _, element, _), picked in zip(lines, chosen):
        if picked:
            holder = _holder(page, element)
            weight[holder] = weight.get(holder, 0) + len(text)
            path = _path(page, element)
            common = path if common is None else [a for a, b in zip(common, path) if a == b]
    marked = {n: w for n, w in weight.items() if n}
    best = max(marked, key=lambda n: (marked[n], -n)) if marked else common[-1]
    return " ".join(text for text, _, element, boiler in lines if not boiler and _inside(page, element, best))


def _path(page: _Lines, element: int) -> list[int]:
    """Elements from the page down to ``element``."""
    path = []
    while element >= 0:
        path.append(element)
        element = page.parents[element]
    return path[::-1]


def _holder(page: _Lines, element: int) -> int:
    """The outermost article (else main) around a line; without one, 0."""
    found, n = 0, element
    while n > 0:
        if page.names[n] == "article" or page.names[n] == "main" and page.names[found] != "article":
            found = n
        n = page.parents[n]
    return found


def _inside(page: _Lines, element: int, holder: int) -> bool:
    while element > holder:
        element = page.parents[element]
    return element == holder


def extract(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry`` and the main text of every page."""
    source = pages.select(*carry, F.col(html_col).alias("__html"))
    at = len(carry)

    def run(batches):
        for batch in batches:
            text = [main_text(h) for h in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(text, pa.string())], [*carry, "__text"])

    fields = source.drop("__html").schema.add("__text", "string")
    return arrow(source, run, fields)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract(table(spark, sf_dir, "pages")).withColumnRenamed("__text", "text")
    return found.withColumn("n_chars", F.length("text").cast("long"))
