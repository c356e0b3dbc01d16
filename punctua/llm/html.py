"""Main text of web pages.

The standard library's parser streams events into lines: a line ends where a block element
begins or ends, and knows its text, its tags and its enclosing elements. Each line's text-to-tag ratio is smoothed by a Gaussian over the neighbouring lines;
lines above a threshold cluster into content. The content region is the article elements, else
the main element, where they hold at least 80 % of the content; on other pages it is the smallest
element that holds all content and titles. Of the region all lines stay, short and linked ones
too, without what elements, roles or class names mark as menus, headers, footers, sidebars,
notices, adverts, forms or reader comments.

A class name marks noise as a whole: ``cookie-notice`` and ``site-footer`` do, ``has-sidebar`` and
``search-results`` do not. It does not drop an element that holds a main element, most of the
page's text, or an article where the element holds as much text as there is outside of marks.
Beside an article or main element, adverts, reader comments and the like go however long.

Defined cases: null and empty pages give an empty text. Character references are decoded, white
space inside a block becomes one space, blocks are joined by one line feed. Unclosed elements
end with their parent. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements, roles and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset(
    "head title script style noscript template svg math canvas nav footer aside form button "
    "select option textarea input iframe object dialog menu".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog form menu "
    "menubar toolbar".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbox adslot banner breadcrumb "
    "breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus "
    "feedback footer footnav form gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination paywall popup promo "
    "promoted promotion recommend recommended recommendations related replies reply respond "
    "responses search share sharing sidebar signin signup skip social sponsor sponsored "
    "subscribe subscription teaser toolbar topbar widget widgets".split())
READERS = frozenset(
    "comment comments commentlist discussion disqus replies reply respond responses".split())
LOOSE = frozenset(  # also used for whole texts
    "feedback header modal notice notices overlay search social widget widgets".split())
# Words that may stand beside a noise word in a class name of noise.
BESIDE = frozenset(
    "site page post posts article articles entry story blog main primary secondary global top "
    "bottom left right side inner outer wrapper wrap container box block area section panel bar "
    "row col column list links link item items button buttons icon icons form thread unit slot "
    "space text title js google sticky fixed mobile desktop".split())
NEVER_NOISE = frozenset("html body main article".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div section center td".split())
SPACE = re.compile(r"[\s​﻿]+")
WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class _Element:
    __slots__ = ("tag", "number", "hard", "marks", "reader", "article", "proper")

    def __init__(self, tag, number, hard, marks, reader, article, proper):
        self.tag, self.number, self.hard, self.marks = tag, number, hard, marks
        self.reader, self.article, self.proper = reader, article, proper


def _is_noise(tag: str, attrs: list, inside_article: bool) -> bool:
    """Whether the element goes by its tag, role or style."""
    if tag in DROPPED:
        return True
    if tag == "header":
        return not inside_article
    if tag in NEVER_NOISE:
        return False
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _noise_words(tag: str, attrs: list) -> set[str]:
    """Noise words of the class names and the id that mark noise as a whole."""
    found = set()
    for name, value in attrs:
        if name in ("class", "id"):
            for token in (value or "").split():
                words = {w.lower() for w in WORD.findall(token) if not w.isdigit()}
                if tag in HEADINGS:
                    words -= {"header"}
                if words <= NOISE | BESIDE:
                    found |= words & NOISE
    return found


class Lines(HTMLParser):
    """Collects lines: (text, tags, numbers of the enclosing elements).

    Elements in ``spared`` are not dropped for a class name.
    """

    def __init__(self, spared: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...]]] = []
        self.stack: list[_Element] = []
        self.kinds: list[str] = []  # tag of each element, by number
        self.text: list[str] = []
        self.spared = spared
        self.marked: dict[int, int] = {}  # characters in each element marked by a class name
        self.holds: dict[int, set[str]] = {}  # "main", "article", "sure" of each of them
        self.readers: set[int] = set()  # those of reader comments
        self.total = self.clean = self.proper = 0  # characters: all, unmarked, in an article or main
        self.tags = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, tuple(e.number for e in self.stack)))
        self.text, self.tags = [], 0

    def _close_to(self, k: int) -> None:
        while len(self.stack) > k:
            self.stack.pop()

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th"):
            # an open paragraph (or item of the same kind) ends here
            ends = {"p"} if tag in CLOSES_P else {"td", "th"} if tag in ("td", "th") else {tag}
            if tag in ("dt", "dd"):
                ends = {"dt", "dd"}
            for k in range(len(self.stack) - 1, -1, -1):
                kind = self.stack[k].tag
                if kind in ends:
                    self._close_to(k)
                    break
                if kind not in INLINE and kind != "p":
                    break
        top = self.stack[-1] if self.stack else None
        article = bool(top and top.article)
        hard = bool(top and top.hard) or _is_noise(tag, attrs, article)
        kind = "main" if dict(attrs).get("role") == "main" else tag
        number, words = len(self.kinds), _noise_words(tag, attrs)
        self.kinds.append(kind)
        marks, reader = (top.marks, top.reader) if top else ((), False)
        if words and tag not in NEVER_NOISE and number not in self.spared:
            marks += (number,)
            self.marked[number] = 0
            self.holds[number] = {"sure"} if words - LOOSE else set()
            reader = reader or bool(words & READERS)
            if reader:
                self.readers.add(number)
        proper = bool(top and top.proper)
        if kind == "main" or kind == "article" and not words:
            proper = True
            for mark in () if hard else marks:
                self.holds[mark].add(kind)
        self.stack.append(_Element(tag, number, hard, marks, reader, article or tag == "article",
                                   proper))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                self._close_to(k)
                break
            if tag in INLINE and self.stack[k].tag not in INLINE:
                break  # a stray inline end does not close a block

    def handle_data(self, data):
        top = self.stack[-1] if self.stack else None
        if top and top.hard:
            return
        n = sum(map(len, data.split()))
        self.total += n
        if top and top.proper and not top.reader:
            self.proper += n
        if top and top.marks:
            for mark in top.marks:
                self.marked[mark] += n
            return
        self.clean += n
        self.text.append(data)

    def close(self):
        super().close()
        self.flush()


def _spared(page: Lines) -> frozenset[int]:
    """Marked elements that hold the main text after all."""
    out = set()
    for number, n in page.marked.items():
        holds = page.holds[number]
        if "main" in holds:
            out.add(number)
        elif "article" in holds and n >= page.clean and number not in page.readers:
            out.add(number)
        elif 2 * n > page.total and not ("sure" in holds and page.proper):
            out.add(number)
    return frozenset(out)


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; at the ends over what there is."""
    reach = np.arange(-int(3 * sigma), int(3 * sigma) + 1)
    kernel = np.exp(-(reach ** 2) / (2 * sigma ** 2))
    n, r = len(ratios), len(reach) // 2
    full = np.convolve(ratios, kernel)[r:n + r]
    return full / np.convolve(np.ones(n), kernel)[r:n + r]


def main_text(page: str | None, share: float = 0.8) -> str:
    """The page's main text; see the module for how it is found."""
    if not page:
        return ""
    parser = Lines()
    parser.feed(page)
    parser.close()
    if spared := _spared(parser):
        parser = Lines(spared)
        parser.feed(page)
        parser.close()
    lines = parser.lines
    if not lines:
        return ""
    ratios = np.array([len(t) / max(1, tags) for t, tags, _ in lines], dtype=float)
    level = smoothed(ratios)
    content = level >= min(level.std(), level.max())  # the cluster above the threshold
    weight = np.array([len(t) for t, _, _ in lines]) * content
    kinds = parser.kinds
    inside: dict[int, int] = {}  # weight in each element
    needed: dict[int, int] = {}  # content lines and titles in each element
    for k, (_, _, path) in enumerate(lines):
        need = bool(weight[k]) or any(kinds[p] == "h1" for p in path)
        for number in path:
            inside[number] = inside.get(number, 0) + int(weight[k])
            needed[number] = needed.get(number, 0) + need
        needed[-1] = needed.get(-1, 0) + need  # of the page
    for wanted in ("article", "main"):
        roots = {p for _, _, path in lines for p in path if kinds[p] == wanted and inside[p]}
        held = sum(int(weight[k]) for k, (_, _, path) in enumerate(lines)
                   if roots.intersection(path))
        if roots and held >= share * weight.sum():
            return "\n".join(t for t, _, path in lines if roots.intersection(path))
    region = max((p for p, n in needed.items()
                  if p >= 0 and n == needed[-1] and kinds[p] in CONTAINERS), default=None)
    return "\n".join(t for t, _, path in lines if region is None or region in path)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")
            ) -> DataFrame:
    """The columns ``keep``, text and n_chars (code points) of every page."""
    table = pages.select(*[F.col(c) for c in keep], F.col(html).alias("__html"))
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("__html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"])

    return table.mapInArrow(run, f"{fields}, text string, n_chars bigint")


def op9_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
