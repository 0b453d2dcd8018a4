"""Operator 4: main text of HTML pages.

The standard library's streaming parser turns a page into lines, one a block
element. Each line gets its text-to-tag ratio: characters outside of links by
the tags in it. What the page says about itself only weighs: lines in articles
weigh more, lines in what it marks as no article (navigation, forms, adverts,
comments of readers and the like) far less. The ratios are smoothed with a
Gaussian, and a threshold between two clusters of them selects content regions.
The regions vote for the innermost element that holds most of their text, and
its lines are the main text, but for lists of links and marked lines that the
ratios don't select.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folio.llm.common import per_text

#: Elements whose content is no text of a page's body.
DROPPED = frozenset("script style noscript template head title iframe select button textarea input label option datalist legend".split())
#: Elements that mark their content as no article text.
ASIDE = frozenset("nav header footer aside form dialog menu fieldset".split())
#: Elements that begin and end a line.
BLOCKS = frozenset("html body p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr br center details summary hgroup search nav header footer aside form dialog menu fieldset".split())
#: Elements that can hold a whole article.
HOLDERS = frozenset("body div section article main td blockquote ul ol table".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that leave a head open.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements whose start ends an open p.
ENDS_P = frozenset("address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table ul".split())
_AROUND_P = ("article", "main", "body", "div", "td", "th", "li", "dd", "dt", "section", "blockquote", "table", "button", "object", "template")
_CELL, _ITEM, _PART = ("td", "th"), ("dt", "dd"), ("thead", "tbody", "tfoot")
#: What the start of an element ends besides, and the elements that this stays inside.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "table", "article", "section")),
    **dict.fromkeys(_ITEM, (_ITEM, ("dl", "table", "article", "section"))),
    **dict.fromkeys(("option", "optgroup"), (("option",), ("select", "datalist"))),
    **dict.fromkeys(_CELL, (_CELL, ("tr", "table"))),
    "tr": (("tr",), ("table", *_PART)),
    **dict.fromkeys(_PART, (_PART, ("table",))),
}
#: Elements that ends of others look for or stop at.
_STOPS = frozenset(("p", "a", "head", *_AROUND_P, *(t for ends, stop in ENDS.values() for t in (*ends, *stop))))
#: Words of class, id or role that mark what is no article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|widget\w*|footer\w*|foot|masthead|"
    r"cookie\w*|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social\w*|related|recommend\w*|"
    r"comments?|commentlist|disqus|discussion|replies|reply|respond|pagination|pager|copyright|legal|disclaimer|toolbar|search\w*|skip\w*|hidden|sr-only|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
#: Those that mark nothing inside of an article.
_WEAK = re.compile(r"(?:^|[\s_-])(?:side|foot|discussion|reply|respond|copyright|legal|disclaimer|toolbar|search\w*)(?=$|[\s_-])", re.I)
_NOT_MARKS = re.compile(r"(?:^|\s)(?:has|no|with|without|js|is)-\S+", re.I)
_OTHER_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|repl\w+|responses?|related|recommend\w*|teasers?|promo\w*|sponsor\w*|ads?)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WHITE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    linked: int  # characters inside of links
    tags: int  # tags of inline elements
    article: bool
    at: int  # number of the innermost element around it, 0 for none


class Element(NamedTuple):
    parent: int
    holder: bool  # can hold an article
    root: bool  # html or body
    article: bool
    marked: bool  # as no article
    other: bool  # as an article of others, or hidden


class Lines(HTMLParser):
    """Collects lines and the tree of elements, numbered from 1 in the order of their starts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.elements: list[Element] = [Element(0, False, False, False, False, False)]
        self.open: list[tuple[str, bool, bool, int]] = []  # element, drops its content, is an article, number
        self.counts: dict[str, int] = {}  # of open elements
        self.placed: list[int] = []  # places, among the open ones, of elements that ends of others stop at
        self.dropping = self.articles = self.links = 0
        self.linked = self.tags = 0
        self.words: list[str] = []

    def flush(self) -> None:
        text = _WHITE.sub(" ", "".join(self.words)).strip()
        if text:
            self.lines.append(Line(text, self.linked, self.tags, self.articles > 0, self.open[-1][3] if self.open else 0))
            self.linked = self.tags = 0
        self.words = []

    def _is_marked(self, tag: str, own: dict[str, str | None]) -> tuple[bool, bool]:
        """Whether an element is marked as no article, and whether as another one than the page's own."""
        if not own and tag not in ASIDE:
            return False, False
        words = _NOT_MARKS.sub(" ", " ".join(v for k in ("class", "id", "role") if (v := own.get(k))))
        other = bool(_OTHER_ARTICLE.search(words))
        if tag in ("html", "body", "main"):
            return False, False
        if tag == "article":
            return other, other
        if "hidden" in own or own.get("aria-hidden") == "true" or _HIDDEN.search(own.get("style") or ""):
            return True, True
        if self.articles:
            return (tag in ASIDE and tag != "header") or bool(MARKS.search(_WEAK.sub(" ", words))), other
        return tag in ASIDE or bool(MARKS.search(words)), other

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in DROPPED:
            self.flush()
        else:
            self.tags += 1
        if tag == "body" or (tag not in IN_HEAD and self.open and self.open[-1][0] == "head"):
            self._close_to("head")
        if tag in ENDS_P:
            self._close_to("p", stop=_AROUND_P)
        if tag == "a":
            self._close_to("a", stop=_AROUND_P)
        ends, stop = ENDS.get(tag, ((), ()))
        if ends:
            self._close_to(*ends, stop=stop)
        if tag in VOID:
            return
        own = dict(attrs)
        marked, other = self._is_marked(tag, own)
        article = not marked and (tag in ("article", "main") or own.get("role") in ("main", "article"))
        self.elements.append(Element(self.open[-1][3] if self.open else 0, tag in HOLDERS, tag in ("html", "body"), article, marked, other))
        if tag in _STOPS:
            self.placed.append(len(self.open))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.open.append((tag, tag in DROPPED, article, len(self.elements) - 1))
        self.dropping += tag in DROPPED
        self.articles += article
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def _close_to(self, *tags: str, stop: tuple[str, ...] = ()) -> None:
        if not any(self.counts.get(t) for t in tags):
            return
        # where something stops the search, only elements that can stop or end it are looked at
        for k in reversed(self.placed) if stop else range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                for tag, dropped, article, _ in self.open[k:]:
                    self.dropping -= dropped
                    self.articles -= article
                    self.links -= tag == "a"
                    self.counts[tag] -= 1
                del self.open[k:]
                while self.placed and self.placed[-1] >= k:
                    self.placed.pop()
                return
            if self.open[k][0] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in DROPPED:
            self.flush()
        else:
            self.tags += 1
        self._close_to(tag)

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.words.append(data)
            if self.links:
                self.linked += len(data.strip())


def parsed(html: str) -> Lines:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def marked_lines(page: Lines, most: float = 0.9) -> np.ndarray:
    """The outermost mark that counts on each line, or 0.

    Marks don't count on elements around ``most`` of the page's text, or around
    an article and half of the text: those hold the page, not a part of it.
    """
    tree = page.elements
    size = summed(page, [len(x.text) for x in page.lines])
    apart, holding = [False] * len(tree), [False] * len(tree)  # inside of another's article; around an article
    for k, x in enumerate(tree[1:], 1):
        apart[k] = apart[x.parent] or (x.marked and x.other)
        holding[k] = x.article and not apart[x.parent]
    for k in range(len(tree) - 1, 0, -1):
        holding[tree[k].parent] |= holding[k]
    total, outermost = size[0], [0] * len(tree)
    for k, x in enumerate(tree[1:], 1):
        counts = x.marked and (x.other or size[k] < (0.5 if holding[k] else most) * total)
        outermost[k] = outermost[x.parent] or (k if counts else 0)
    return np.array([outermost[x.at] for x in page.lines])


def summed(page: Lines, values: list[int]) -> list[int]:
    """For each element, the sum of the values of the lines inside of it; number 0 has all."""
    out = [0] * len(page.elements)
    for line, v in zip(page.lines, values, strict=True):
        out[line.at] += v
    for k in range(len(out) - 1, 0, -1):
        out[page.elements[k].parent] += out[k]
    return out


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; beyond the ends nothing counts."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel, "full")[reach:-reach] / np.convolve(np.ones(len(ratios)), kernel, "full")[reach:-reach]


def threshold(values: np.ndarray) -> float:
    """The least value of the upper of two clusters (one-dimensional two-means on logarithms).

    Zero, so that everything passes, where the clusters are less than a factor of three apart.
    """
    values = np.sort(values)
    x = np.log1p(values)
    if len(x) < 2:
        return 0.0
    sums = np.cumsum(x)
    n = np.arange(1, len(x))
    low, high = sums[:-1] / n, (sums[-1] - sums[:-1]) / (len(x) - n)
    cut = int(np.argmax(n * (len(x) - n) * (high - low) ** 2))
    return float(values[cut + 1]) if high[cut] - low[cut] > np.log(3) else 0.0


def ratios(page: Lines, marks: np.ndarray, article: float = 4.0, marked: float = 0.05) -> np.ndarray:
    """Each line's text-to-tag ratio, weighed by whether it is in an article and whether it is marked as none."""
    own = np.array([max(0, len(x.text) - x.linked) / (1 + x.tags) for x in page.lines], float)
    return own * np.where([x.article for x in page.lines], article, 1.0) * np.where(marks > 0, marked, 1.0)


def selected(page: Lines, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of content regions, the lines' smoothed ratios and marks.

    Marked elements are smoothed by themselves, and selected only where they are
    denser than the unmarked regions in spite of their weight.
    """
    marks = marked_lines(page)
    ratio = ratios(page, marks)
    smooth = np.zeros(len(ratio))
    for group in set(marks.tolist()):
        own = np.flatnonzero(marks == group)
        smooth[own] = smoothed(ratio[own], sigma)
    chosen = smooth >= threshold(smooth)
    plain = chosen & (marks == 0)
    if plain.any():
        chosen &= (marks == 0) | (smooth >= smooth[plain].mean())
    return chosen, smooth, marks


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.7) -> str:
    """The main text's lines joined by one space; empty for null, empty or unmarked-up pages without text."""
    if not html:
        return ""
    page = parsed(html)
    lines = page.lines
    if not lines:
        return ""
    chosen, _, marks = selected(page, sigma)
    weight = [len(x.text) * (4 if x.article else 1) * bool(ok) for x, ok in zip(lines, chosen, strict=True)]
    votes, tree = summed(page, weight), page.elements
    holder = max((k for k, v in enumerate(votes) if v and v >= share * votes[0] and tree[k].holder and not tree[k].root), default=None)  # a later number is further inside
    if holder is None:
        first, last = np.flatnonzero(chosen)[[0, -1]]
        while first and not marks[first - 1] and 2 * lines[first - 1].linked <= len(lines[first - 1].text):
            first -= 1  # a title is short
        inside = (np.arange(len(lines)) >= first) & (np.arange(len(lines)) <= last)
    else:
        within = [k == holder for k in range(len(tree))]
        for k in range(holder + 1, len(tree)):
            within[k] = within[tree[k].parent]
        inside = np.array([within[x.at] for x in lines])
    listed = link_lists(lines, inside)
    keep = inside & (chosen | ((marks == 0) & ~listed))
    for way in (1, -1):  # links next to prose are smoothed up
        for k in np.flatnonzero(keep)[::way]:
            if not listed[k]:
                break
            keep[k] = False
    if not keep.any():
        keep = inside & chosen
    return " ".join(x.text for x, ok in zip(lines, keep, strict=True) if ok)


def link_lists(lines: list[Line], inside: np.ndarray, least: int = 3) -> np.ndarray:
    """Lines that are links for the most part; in articles, runs of ``least`` or more of them."""
    linky = np.array([2 * x.linked > len(x.text) for x in lines]) & inside
    cut = np.flatnonzero(np.diff(np.concatenate([[False], linky, [False]]).astype(np.int8)))
    long = np.zeros(len(lines), bool)
    for a, b in zip(cut[::2], cut[1::2], strict=True):
        long[a:b] = b - a >= least
    return linky & (long | ~np.array([x.article for x in lines]))


_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) of each whole page.

    Null and empty pages have empty text. Rows, repeated or not, and other
    columns are kept; columns named text and n_chars are replaced.
    """

    def make():
        def work(array: pa.Array) -> pa.RecordBatch:
            texts = [main_text(x) for x in array.to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["text", "n_chars"])

        return work

    return per_text(pages, html, _SCHEMA, make)
