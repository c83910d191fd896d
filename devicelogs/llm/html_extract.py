"""Main text of web pages by text-to-tag ratios.

A page goes through the standard library's streaming parser. Block elements end a line; each line keeps its text, how much of it is link
text, the number of tags met in it, and the box (the innermost block element that holds other blocks) it stands in. The ratio of a line is
its text outside of links per tag. Ratios are smoothed with a Gaussian kernel, and lines fall into two clusters at a threshold, the page's
own deviation. The high cluster votes for regions: a region is an ``article`` or ``main`` element, or what lies outside of them. In an
``article`` or ``main`` that is chosen all lines are content, lists of references too. Outside of them content reaches from the first high
line to the last, and over their neighbours in the same boxes, without runs of the low cluster that are mostly links. What the
markup itself marks as menu, header, footer, sidebar, notice, advert, form, script, style or reader comment has the ratio 0 and is never
content. A class or id that only tells of a layout (has-sidebar) marks nothing. Where no article or main stands outside of what class and id
mark, those inside of it are regions, but not within reader comments or links to other pages; where nothing at all stands outside, class and
id are not heeded.

Null html counts as empty html and gives an empty text. Elements that are not closed end where HTML lets them end (a list item before the
next one), or with their parent. The end of an inline element ends no block that began within it. No markup stops a page: what can't be parsed is text or, if it looks like a comment, nothing. Time grows
with the length of a page, however it is nested. Equal rows get equal results, page_id keeps its type, columns of other names are not read,
and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and attribute words.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("annotation aside button canvas datalist dialog embed fieldset footer form head header iframe input legend menu nav noframes noscript object optgroup option output progress script select style svg template textarea title video audio".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SKIPPED_WORDS = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disqus|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notice|notices|popup|promo|sidebar|signup|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
#: These mark an element only if its class or id has no other words than such and those of parts of a page.
VAGUE_WORDS = frozenset("related reply replies respond share sharing social".split())
PART_WORDS = frozenset("area articles bar block box buttons container content form icons items links list module panel pages posts section title tools widget wrapper".split())
#: Class words that name what a page has or lacks, not what the element is.
LAYOUT = re.compile(r"(?:has|with|without|no|not)[_-]", re.I)
#: An article within an element of these words is no content.
CLOSED_WORDS = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus)(?:$|[\s_-])", re.I)
#: How a line is skipped: not, only by what is around its article or main element, by class or id, by the markup.
OPEN, AROUND, NAMED, CLOSED = range(4)
#: The start of these ends an open paragraph.
CLOSES_P = BLOCKS - {"br", "body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend", "figcaption", "title"}
#: The start of an element ends open ones of these names, back to the last of the others.
_TABLE, _LIST = ("table",), ("ul", "ol", "menu", "dir")
IMPLIED_ENDS = {
    "li": (("li",), _LIST), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr",), _TABLE), "tbody": (("thead", "tbody", "tfoot"), _TABLE), "thead": (("thead", "tbody", "tfoot"), _TABLE), "tfoot": (("thead", "tbody", "tfoot"), _TABLE),
}
#: An open paragraph beyond these stays open.
HOLDS_P = ("td", "th", "table", "button", "object", "caption", "li", "dd", "dt", "div", "section", "article", "main", "blockquote", "figure", "form", "aside", "body")
#: Blocks that as a rule hold nothing but text are no boxes.
TEXT_BLOCKS = frozenset("p br hr h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption figcaption pre address summary legend option title".split())

SIGMA = 1.0
CONTENT = frozenset(["article", "main"])
#: A line of an article or main element counts as so many of others.
CONTENT_WEIGHT = 4
#: A region is content from this share of the strongest region's votes.
REGION_SHARE = 0.1
#: So many lines of the low cluster in a row, each with this share of link text, are a menu.
MENU_LINES, LINK_SHARE = 3, 0.5


class Line(NamedTuple):
    text: str
    tags: int
    #: Characters of link text.
    linked: int
    #: 0: outside of article and main.
    region: int
    #: How it is skipped: OPEN to CLOSED.
    skipped: int
    box: int


def _named(value: str) -> int:
    """How a class or id marks its element."""
    found = OPEN
    for word in value.split():
        if SKIPPED_WORDS.search(word) and not LAYOUT.match(word):
            found = max(found, CLOSED if CLOSED_WORDS.search(word) else NAMED)
    parts = set(re.split(r"[\s_-]+", value.lower()))
    return CLOSED if parts & VAGUE_WORDS and parts <= VAGUE_WORDS | PART_WORDS else found


def _skips(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    if tag in SKIPPED:
        return CLOSED
    found = OPEN
    for name, value in attrs:
        if name == "hidden" or value and (name == "role" and value.lower() in SKIPPED_ROLES or name == "aria-hidden" and value == "true"):
            return CLOSED
        if value and name in ("class", "id"):
            found = max(found, _named(value))
    return found


class Open(NamedTuple):
    """An open element, and what held before it."""

    tag: str
    region: int
    skipped: int
    box: int
    #: How its own markup skips it.
    skips: int


class Lines(HTMLParser):
    """Parser events to lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[Open | None] = []  # None: ended before what began within it
        self.blocks: list[int] = []  # places of the open blocks
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a name
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.regions = self.region = self.boxes = self.box = 0
        self.skipped = OPEN

    def read(self, html: str) -> list[Line]:
        self.rawdata, self.last, self.last_comment = html, html.rfind(">"), html.rfind("-->")
        self.close()
        self.end_line()
        return self.lines

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.region, self.skipped, self.box))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _last(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def _close_open(self, names: Iterable[str], until: Iterable[str]) -> None:
        """Ends the open elements of these names behind the last of the others."""
        barrier = self._last(until)
        first = min((k for n in names for k in self.places[n] if k > barrier), default=-1) if self._last(names) > barrier else -1
        if first >= 0:
            self._cut(first)

    def _cut(self, k: int) -> None:
        """Ends all elements from this place of the stack on."""
        _, region, skipped, box, _ = self.stack[k]
        if self.blocks and self.blocks[-1] >= k or (region, skipped) != (self.region, self.skipped):
            self.end_line()
        self.region, self.skipped, self.box = region, skipped, box
        for e in filter(None, self.stack[k:]):
            self.places[e.tag].pop()
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()
        del self.stack[k:]

    def _end_alone(self, k: int) -> None:
        """Ends the element at this place and keeps what began within it."""
        ended, self.stack[k] = self.stack[k], None
        self.places[ended.tag].pop()
        if ended.skips <= ended.skipped:
            return
        self.end_line()
        now, inner = ended.skipped, [(i, e) for i, e in enumerate(self.stack[k + 1 :], k + 1) if e]
        for (i, e), after in zip(inner, [*(e.region for _, e in inner[1:]), self.region], strict=True):
            self.stack[i] = e._replace(skipped=now)
            if after != e.region:  # it began a region, which stays what it was
                return
            now = max(now, e.skips)
        self.skipped = now

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close_open(("p",), HOLDS_P)
        if tag in IMPLIED_ENDS:
            self._close_open(*IMPLIED_ENDS[tag])
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        skips = _skips(tag, attrs) if tag not in ("html", "body", "article", "main") else OPEN
        if skips > self.skipped:
            self.end_line()
        self.places[tag].append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(Open(tag, self.region, self.skipped, self.box, skips))
        if tag in CONTENT and self.skipped < CLOSED and not self.region:
            self.end_line()
            self.skipped = AROUND if self.skipped else OPEN
            self.regions += 1
            self.region = self.regions
        if tag in BLOCKS and tag not in TEXT_BLOCKS:
            self.boxes += 1
            self.box = self.boxes
        self.skipped = max(self.skipped, skips)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no empty form of elements that aren't void

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if self.places[tag]:
            k = self.places[tag][-1]
            alone = tag not in BLOCKS and tag not in SKIPPED and tag not in CONTENT and self.blocks and self.blocks[-1] > k
            (self._end_alone if alone else self._cut)(k)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.places["a"]:
            self.linked += len("".join(data.split()))

    # What the base class would search to the end of the page again and again, or stop at

    def _text(self, i: int) -> int:
        """The end of the text from a "<" that begins no markup."""
        k = self.rawdata.find("<", i + 1)
        k = len(self.rawdata) if k < 0 else k
        self.handle_data(unescape(self.rawdata[i:k]))
        return k

    def parse_starttag(self, i: int) -> int:
        return self._text(i) if i > self.last else super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        return self._text(i) if i > self.last else super().parse_endtag(i)

    def parse_pi(self, i: int) -> int:
        return self._text(i) if i > self.last else super().parse_pi(i)

    def parse_comment(self, i: int, report: int = 1) -> int:
        if i > self.last:
            return len(self.rawdata)
        end = self.rawdata.find("-->", i + 4) if self.last_comment >= i + 4 else -1
        return end + 3 if end >= 0 else self.rawdata.find(">", i) + 1

    def parse_html_declaration(self, i: int) -> int:
        return len(self.rawdata) if i > self.last else self.rawdata.find(">", i) + 1


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian filter whose window is cut at the ends."""
    if len(ratios) < 2:
        return ratios
    reach = int(3 * sigma)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel, "full")[reach : reach + len(ratios)] / weight


def ratios(lines: list[Line], heeded: int) -> np.ndarray:
    """Text outside of links per tag; 0 for what is skipped more than heeded."""
    return np.array([0.0 if x.skipped > heeded else max(len(x.text) - x.linked, 0) / max(x.tags, 1) * (CONTENT_WEIGHT if x.region else 1) for x in lines])


def content_lines(lines: list[Line]) -> list[bool]:
    """Which lines are content."""
    if not lines:
        return []
    ways = {x.skipped for x in lines}
    heeded = OPEN if any(x.region and x.skipped == OPEN for x in lines) else AROUND if ways & {OPEN, AROUND} else NAMED
    given = ratios(lines, heeded)
    smooth = smoothed(given)
    near = smooth >= min(given.std(), smooth.max())  # the high cluster and what lies between its lines
    high = near & (given > 0)
    votes: dict[int, float] = {}
    for k in np.flatnonzero(high):
        votes[lines[k].region] = votes.get(lines[k].region, 0.0) + smooth[k]
    least = REGION_SHARE * max(votes.values(), default=0.0)
    chosen = {region for region, vote in votes.items() if vote >= least}
    menus = _runs([not x.region and not near[k] and x.linked >= LINK_SHARE * len("".join(x.text.split())) for k, x in enumerate(lines)], MENU_LINES)
    fits = [x.skipped <= heeded and not menu for x, menu in zip(lines, menus, strict=True)]
    if chosen == {0} or not chosen:  # no element holds the content
        at = np.flatnonzero(high)
        if not len(at):
            return fits if not chosen and not any(x.region for x in lines) else [f and bool(x.region) for f, x in zip(fits, lines, strict=True)]
        first, last = _reach(lines, fits, at[0], -1), _reach(lines, fits, at[-1], 1)
        return [first <= k <= last and fits[k] for k in range(len(lines))]
    return [x.region in chosen - {0} and f for x, f in zip(lines, fits, strict=True)]


def _runs(flags: list[bool], least: int) -> list[bool]:
    """The flags that are set in runs of at least so many."""
    out: list[bool] = []
    for flag, run in groupby(flags):
        n = len(list(run))
        out += [flag and n >= least] * n
    return out


def _reach(lines: list[Line], fits: list[bool], k: int, step: int) -> int:
    """How far content goes on from a high line: over lines in its box."""
    box = lines[k].box
    while 0 <= k + step < len(lines) and lines[k + step].box == box and not lines[k + step].region and fits[k + step]:
        k += step
    return k


def extract(html: str | None) -> str:
    """The main text of one page."""
    lines = Lines().read(html or "")
    keep = content_lines(lines)
    return " ".join(line.text for line, kept in zip(lines, keep, strict=True) if kept)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column("html")]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_texts, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")
