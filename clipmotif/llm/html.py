"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clipmotif.llm.common import col, small_batches

#: elements that never hold article text
DROPPED = frozenset("head nav footer aside form script style noscript template button select option textarea iframe object svg canvas menu dialog label input audio video map".split())
#: elements that have no end tag
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that stay within their line
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
#: elements that begin a region of their own; cells do if they hold blocks
REGION = frozenset("body main article section div table ul ol dl blockquote".split())
CELLS = frozenset("td th".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|adverts?|advertisements?|advertising|banners?|sponsor(?:ed|s)?|promos?|promotions?|side-?bars?|comments?|comment-?list|disqus|replies|respond|responses|"
    r"cookies?|consent|gdpr|notices?|alerts?|popups?|pop-up|modals?|overlays?|newsletters?|subscribe|signup|social|share|sharing|related|recommend(?:ed|ations?)?|"
    r"opinions?|discussions?|feedback|guestbook|breadcrumbs?|menus?|nav|navbar|navigation|footers?|masthead|topbar|toolbar|widgets?|pagination|pager|login|search|skip|legal|copyright)(?:$|[\s_-]|\d)",
    re.I,
)
#: what, as a whole class or id, says so within articles too: there it lowers the ratio, as words like legal or search may be the article's own
INNER = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsored sponsor promo promos promotion newsletter subscribe signup social share sharing related recommended "
    "recommendations comments comment-list comments-list comment-section comments-section disqus replies responses cookie cookies cookie-notice cookie-banner consent gdpr popup modal "
    "breadcrumb breadcrumbs pagination pager sidebar side-bar toolbar".split()
)
LOWERED = 0.1  # what the smoothed ratio of such a region is multiplied by
#: page headers; those within an article, or named after one, hold its title
HEADED = re.compile(r"(?:^|\s)(?:(?!(?:entry|post|article|story|content|title|section)[_-])[^\W_]+[_-])*headers?(?:$|[\s_-]|\d)", re.I)
#: what an article element is if a class or the id begins so
UNREAD = frozenset("comment comments reply replies response responses ad ads advert advertisement sponsored promo promotion teaser related".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SPACE = re.compile(r"\s+")
UNCLOSED = frozenset("nav header menu".split())
COMMENT_END = re.compile("--!?>")
SHORT_COMMENT = re.compile("<!---?>")
TAG_START = re.compile(r"<[a-zA-Z/!?]")


def _unread(tag: str, attrs: list[tuple[str, str | None]], in_article: bool, in_main: bool = False) -> float:
    """What an element's tag, class, id, role or attributes leave of its ratio: 0 if it never holds article text, else LOWERED or 1."""
    if tag in ("html", "body", "main"):
        return 1
    named = " ".join(v for k, v in attrs if k in ("class", "id") and v)
    if any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "role" and v in ROLES) for k, v in attrs):
        return 0
    if tag == "article":
        return float(not any(re.split("[_-]", x, maxsplit=1)[0] in UNREAD for x in named.lower().split()))
    if tag in DROPPED:
        return 0
    if in_article:
        return LOWERED if INNER & set(named.lower().replace("_", "-").split()) else 1
    if tag == "header" or HEADED.search(named) or NAMED.search(named):
        return LOWERED if in_main and tag != "header" else 0
    return 1


class _Lines(HTMLParser):
    """Collects the lines of a page: text, tags, characters inside links, and region number."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, dropped, region before it
        self.count: Counter[str] = Counter()  # of open tags by name
        self.dropped, self.region = 0, 0
        self.parents = [0]  # of each region
        self.factors = [1.0]  # by region, what names leave of its ratio
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[tuple[str, int, int, int]] = []

    def flush(self) -> None:
        line = SPACE.sub(" ", "".join(self.text)).strip()
        if line:
            self.lines.append((line, self.tags, self.linked, self.region))
            self.tags = self.linked = 0
        self.text = []

    def begin(self, factor: float = 1) -> None:
        self.parents.append(self.region)
        self.factors.append(self.factors[self.region] * factor)
        self.region = len(self.parents) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag not in INLINE and not self.dropped:
                self.flush()
            self.tags += 1
            return
        factor = 1.0
        if self.dropped and tag in ("article", "main"):  # a menu or page header that was not closed ends here
            for k, (own, gone, _) in enumerate(self.open):
                if gone:
                    if own in UNCLOSED:
                        self.unwind(k)
                    break
        if not self.dropped:
            if tag not in INLINE:
                self.flush()
                if tag in ("p", "li", "td", "th", "tr", "dd", "dt"):  # their end tags may be missing
                    for k in range(len(self.open) - 1, max(-1, len(self.open) - 4), -1):
                        if self.open[k][0] == tag:
                            self.unwind(k)
                            break
                        if self.open[k][0] not in INLINE:
                            break
                if self.open and self.open[-1][0] in CELLS and self.open[-1][2] == self.region:
                    self.begin()
            self.tags += 1
            factor = _unread(tag, attrs, self.count["article"] > 0, self.count["main"] > 0)
        self.open.append((tag, not factor, self.region))
        self.count[tag] += 1
        self.dropped += not factor
        if (tag in REGION or factor < 1) and not self.dropped:
            self.begin(factor)

    def unwind(self, k: int) -> None:
        while len(self.open) > k:
            tag, out, self.region = self.open.pop()
            self.dropped -= out
            self.count[tag] -= 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag]:  # what is searched is closed, so that a page takes linear time
            if not self.dropped and tag not in INLINE:
                self.flush()
            k = len(self.open) - 1
            while self.open[k][0] != tag:
                k -= 1
            self.unwind(k)
        self.tags += 1

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)
            if self.count["a"]:
                self.linked += len(data)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment ends at its end mark, or else with the page."""
        short = SHORT_COMMENT.match(self.rawdata, i)
        end = short or COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else len(self.rawdata)


def _parsed(html: str) -> _Lines:
    """What begins as a tag after the last > is not closed and holds no text."""
    after = html.rfind(">") + 1
    open_ = TAG_START.search(html, after)
    parser = _Lines()
    parser.feed(html[: open_.start()] if open_ else html)
    parser.close()
    parser.flush()
    return parser


def page_lines(html: str) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """The lines (text, tags, linked characters, region) of a page, and the parent of each region."""
    parser = _parsed(html)
    return parser.lines, parser.parents


def smooth(ratios: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Gaussian smoothing along the lines, weights renormalised at the ends."""
    reach = np.arange(-int(3 * sigma), int(3 * sigma) + 1)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    full = lambda x: np.convolve(x, kernel, mode="full")[len(reach) // 2 :][: len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def main_text(html: str, sigma: float = 2.0) -> str:
    """The article of one page, a line per block.

    Lines in menus, footers, sidebars, notices, adverts, forms and comments, and in page headers outside of articles,
    as their elements and roles say, and outside of articles and main parts their classes or ids, are never content.
    For the others the ratio of unlinked text to tags is smoothed along the page, and lines at or above half the mean
    form clusters.  Within articles and main parts such names lower the smoothed ratio of their region and drop nothing.  A region (the own lines of
    one container) is content if a cluster touches it and some line of it is not mostly linked; then all its lines are.
    A region of links alone, or without a cluster, is content only if it stands within an article's text: if lines of
    a region around it that is content come before and after it.  Article and main elements are regions like others.
    """
    page = _parsed(html)
    lines, parents, factors = page.lines, page.parents, page.factors
    if not lines:
        return ""
    ratios = np.array([(len(t) - min(linked, len(t))) / (1 + tags) for t, tags, linked, _ in lines])
    dense = smooth(ratios, sigma) * [factors[r] for _, _, _, r in lines] >= 0.5 * ratios.mean()
    plain = {r for t, _, linked, r in lines if 2 * min(linked, len(t)) <= len(t)}
    content = {r for (_, _, _, r), d in zip(lines, dense, strict=True) if d and r in plain}
    first, last = {}, {}
    for n, (_, _, _, r) in enumerate(lines):
        first.setdefault(r, n)
        last[r] = n
    whole = {r: (first[r], last[r]) for r in content}
    for r in sorted(first):
        at = parents[r]
        while at and r not in content and factors[r] == 1:
            if at in whole and whole[at][0] < first[r] and last[r] < whole[at][1]:
                content.add(r)
            at = parents[at]
    return "\n".join(t for t, _, _, r in lines if r in content)


def extract_text(pages: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per row of ``pages(page_id, url, html)``.

    A null or empty html, and a page without article text, has the empty text; malformed pages are read
    as far as tags close, in time linear in their length; null ids and urls stay null; of lines with equal ratios
    all are treated alike; repeated rows are extracted each; other columns are not read; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            texts = [main_text(h, sigma) if h else "" for h in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    own = pages.select(col("page_id").cast("long").alias("page_id"), col("url").cast("string").alias("url"), col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
