"""Main text of web pages by line-block distribution.

Markup is read by the rules of HTML (attributes, comments, end tags that may be left out) in one pass, so that every block element starts
a line. A line weighs as many characters as it shows, or none if it is mostly links. Over the weights run windows of ``window`` lines: text
begins where their sum surges and ends where it dives to zero.

Menus, forms, footers, adverts, comment sections and the like are set apart by element, role or name, and weigh nothing, but the weights have
the last word: an element that holds most of the page's weight is no menu, form or sidebar, whatever it is called or however long it is left
open, and one whose name only hints at such a thing need hold no more than a quarter. Footers, adverts, notices and reader comments are never text while something else is.
``article`` and ``main`` elements bound the text if they hold most of what weight is left; otherwise they are blocks like others, but for
slight ones that hold a link by itself, which lead to other pages.

With such bounds all stretches between surge and dive are kept, otherwise the heaviest, those at least ``share`` as heavy, and those with a
line that reads like text by itself. What stands in the very element that holds lines of a kept stretch is kept too, however slight, and links
that are headings or paragraphs there. Character references are decoded, white space inside a line is one space, lines are joined by a line break.

Defined cases: a null or empty page, or one without text, gives the empty string; pages that break off inside a tag,
comment or script lose that piece; repeated rows are kept; a null id or url is passed on; an empty table gives an
empty table; other columns are ignored; pages of any length and depth are read to the end, in time and memory that grow with their length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import batches_of

# The elements of HTML by what they do to text.
SKIPPED = frozenset("script style template noscript svg iframe object canvas head title select textarea datalist audio video".split())
UNSEEN = frozenset("script style textarea title iframe".split())  # of these, what follows is lost if they are never closed
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that hold other blocks or nothing; the others of BLOCKS hold the text of a line, and their place is that of the element around.
HOLDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form header main menu nav ol section table ul".split())
VOID = frozenset("br hr html body".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
# Start tags that end an element left open, unless the element that bounds it was opened since.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ()),
    "tr": (("tr", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption"), ("table",)),
}
CELLS = ("table", "td", "th", "caption")  # an end tag inside a cell ends nothing outside it
TABLE_PARTS = frozenset("table tbody td tfoot th thead tr caption".split())
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments"
    " reply replies disqus respond share sharing social related recommended widget widgets toolbar pagination pager masthead topbar copyright"
    " disclaimer paywall".split()
)
# Of these, names of what never holds the text of a page that has any elsewhere.
LAST_NAMES = frozenset(
    "comment comments reply replies disqus respond footer copyright disclaimer cookie cookies consent gdpr ad ads advert adverts advertisement adsense"
    " newsletter subscribe subscription popup modal overlay paywall".split()
)
# What may stand beside such a name in a class or id ("main-nav", "ad-box"); with any other part it says something else ("has-sidebar").
BESIDE = frozenset(
    "site page main top bottom left right primary secondary global box container wrapper wrap block section area list bar links buttons form"
    " posts articles stories panel item items inner header body text title content count icons link button slot unit group column col".split()
)
# Of these, words that stand for text as well: with them, names of things that may be part of a text only hint.
HINTS = frozenset("page main section area posts articles stories body text title content".split())
SOFT_NAMES = frozenset("social menu share sharing related widget widgets banner promo promotion notice notices popup overlay toolbar sponsored".split())
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?""")
TAG_END = re.compile(r"[\s/]*>")
# How an element is set apart: for good, as long as there is other text, by what it is or is called, or by a hint in its name.
HIDDEN, LAST, NAMED, HINTED = 4, 3, 2, 1
PROSE_CHARS, SENTENCE = 40, re.compile(r"""[.!?\u2026\u3002\uff01\uff1f:]["')\]\u201d\u2019\u00bb]*$""")


@dataclass
class Line:
    text: str
    place: int  # number of the innermost element
    holder: int  # that of the element around the paragraph, heading or item
    links: int  # characters in links
    controls: int  # characters on buttons
    tag: str


@dataclass
class Page:
    """Lines and the elements around them, by number: what is around an element, how it is set apart, whether it is an article."""

    lines: list[Line] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])
    kinds: list[int] = field(default_factory=lambda: [0])
    articles: list[bool] = field(default_factory=lambda: [False])


def name_kind(words: str) -> int:
    """How a class or id sets an element apart: by a whole token or a compound that names something beside the text."""
    found = 0
    for token in words.split():
        parts = {x for x in re.split("[_-]+", token) if x and not x.isdigit()}
        if re.sub("[_-]", "", token) not in OUTSIDE_NAMES and (OUTSIDE_NAMES.isdisjoint(parts) or not parts <= OUTSIDE_NAMES | BESIDE):
            continue
        kind = LAST if not LAST_NAMES.isdisjoint(parts) else HINTED if not HINTS.isdisjoint(parts) and parts & OUTSIDE_NAMES <= SOFT_NAMES else NAMED
        found = max(found, kind)
    return found


def set_apart(tag: str, attributes: list[tuple[str, str]], in_article: bool) -> int:
    """How an element is none of the page's text, else 0."""
    found = LAST if tag in ("footer", "dialog") else NAMED if tag in OUTSIDE or tag == "header" and not in_article else 0
    for name, value in attributes:
        words = value.lower()
        if name == "hidden" or name == "aria-hidden" and words == "true":
            return HIDDEN
        if name == "role" and words in OUTSIDE_ROLES:
            found = max(found, NAMED)
        elif name in ("class", "id"):
            found = max(found, name_kind(words))
    return found


def read_attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """(names and values, the place behind the tag) from behind a tag's name; quotes count only right behind an equals sign."""
    found = []
    while True:
        end = TAG_END.match(page, at)
        if end:
            return found, end.end()
        match = ATTRIBUTE.match(page, at)
        if not match:
            return found, len(page)
        found.append((match[1].lower(), match[2] or match[3] or match[4] or ""))
        at = match.end()


class Reader:
    """Reads a page into lines; ``open`` are the open elements from the outermost in."""

    def __init__(self, page: str):
        self.page, self.found = page, Page()
        self.open: list[tuple[str, int]] = []
        self.depths: dict[str, list[int]] = {}  # where each tag is open
        self.parts: list[str] = []
        self.links = self.controls = self.in_link = self.in_control = 0
        self.never: set[str] = set()  # tags that are not closed any more

    def place(self) -> int:
        return self.open[-1][1] if self.open else 0

    def depth(self, *tags: str) -> int:
        """The depth of the innermost open element of some tags, -1 if none is."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)

    def text(self, piece: str) -> None:
        if piece:
            self.parts.append(piece)
            size = len(piece.strip())
            self.links += size * bool(self.in_link)
            self.controls += size * bool(self.in_control)

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            tag, holder = self.open[-1][0] if self.open else "", len(self.open) - 1
            while holder >= 0 and self.open[holder][0] not in HOLDERS and len(self.open) - holder < 5:
                holder -= 1
            self.found.lines.append(Line(text, self.place(), self.open[holder][1] if holder >= 0 else 0, self.links, self.controls, tag))
        self.parts, self.links, self.controls = [], 0, 0

    def start(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        if (depth := self.depth("p")) > self.depth("button", *CELLS):
            self.close(depth)
        if tag in IMPLIED_ENDS:
            ends, bounds = IMPLIED_ENDS[tag]
            if (depth := self.depth(*ends)) > self.depth(*bounds):
                self.close(depth)
        around, found = self.place(), self.found
        article = tag in ("article", "main")
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, len(found.parents)))
        found.parents.append(around)
        found.kinds.append(set_apart(tag, attributes, found.articles[around]))
        found.articles.append(article or found.articles[around])

    def close(self, depth: int) -> None:
        while len(self.open) > depth:
            self.depths[self.open.pop()[0]].pop()

    def end(self, tag: str) -> None:
        depth = self.depth(tag)
        if depth >= 0 and (tag in TABLE_PARTS or depth > self.depth(*CELLS)):
            self.close(depth)

    def skipped(self, tag: str, at: int) -> int:
        """Where an element that shows no text ends; right here if it is never closed and may hold the page."""
        if tag not in self.never:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
            if end:
                return end.end()
            self.never.add(tag)
        return len(self.page) if tag in UNSEEN else at

    def read(self) -> Page:
        page, at = self.page, 0
        while at < len(page):
            mark = page.find("<", at)
            if mark < 0:
                break
            self.text(page[at:mark])
            after, at = page[mark + 1 : mark + 2], mark + 1
            closing = after == "/"
            name = TAG_NAME.match(page, at + closing)
            if name is None:
                at = self.markup(mark)
                continue
            tag = name[0].lower()
            attributes, at = read_attributes(page, name.end())
            if at == len(page) and not page.endswith(">"):
                self.flush()
                return self.found  # it breaks off inside a tag
            if tag in BLOCKS:
                self.flush()
                if tag not in VOID:
                    self.end(tag) if closing else self.start(tag, attributes)
            elif tag == "a":
                self.in_link = not closing
            elif tag == "button":
                self.in_control = not closing
            elif tag in SKIPPED and not closing and not page.endswith("/>", mark, at):
                at = self.skipped(tag, at)
        self.text(page[at:])
        self.flush()
        return self.found

    def markup(self, mark: int) -> int:
        """Behind a comment or declaration; a sign that opens nothing is text."""
        page = self.page
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            return end + 3 if end >= 0 else len(page)
        if page.startswith("<![CDATA[", mark):
            return mark + 9
        if page[mark + 1 : mark + 2] in ("!", "?", "/"):
            end = page.find(">", mark)
            return end + 1 if end >= 0 else len(page)
        self.text("<")
        return mark + 1


def line_weight(line: Line) -> int:
    return 0 if 2 * (line.links + line.controls) > len(line.text) else len(line.text)


def is_prose(text: str) -> bool:
    """Whether a line reads like text by itself: long, or some words that end a sentence."""
    return len(text) >= PROSE_CHARS or SENTENCE.search(text) is not None and (len(text.split()) >= 4 or len(text) >= 15)


def settle(page: Page) -> tuple[list[bool], list[bool]]:
    """(set apart, in an article) of every line, after what the weights say.

    Elements are numbered in the order in which they begin, so that one pass downwards adds up weights, and one upwards
    settles what lies inside what.
    """
    n, weights = len(page.parents), [line_weight(x) for x in page.lines]
    never = [0] * n  # hidden, or text only if there is no other
    for k in range(1, n):
        never[k] = max(never[page.parents[k]], page.kinds[k] if page.kinds[k] >= LAST else 0)
    if not any(w and not never[x.place] for x, w in zip(page.lines, weights, strict=True)):
        never = [x if x == HIDDEN else 0 for x in never]  # there is no other
    held, in_articles = [0] * n, [0] * n
    for line, weight in zip(page.lines, weights, strict=True):
        if never[line.place] == 0:
            held[line.place] += weight
            in_articles[line.place] += weight * page.articles[line.place]
    for k in range(n - 1, 0, -1):
        held[page.parents[k]] += held[k]
        in_articles[page.parents[k]] += in_articles[k]
    released = [kind == 0 or held[k] * (4 if kind == HINTED else 2) > held[0] for k, kind in enumerate(page.kinds)]
    apart = [False] * n

    def inside() -> int:
        """The weight of articles that are not set apart."""
        total = 0
        for k in range(1, n):
            apart[k] = apart[page.parents[k]] or never[k] > 0 or not released[k]
        for line, weight in zip(page.lines, weights, strict=True):
            total += weight * (page.articles[line.place] and not apart[line.place])
        return total

    if not inside() and 4 * in_articles[0] >= held[0] > 0:
        # The only articles lie in elements set apart: what is around the heaviest one is released.
        tops = [k for k in range(1, n) if page.articles[k] and not page.articles[page.parents[k]] and never[k] == 0]
        k = max(tops, key=held.__getitem__)
        while k > 0:
            released[k], k = True, page.parents[k]
        inside()
    return [apart[x.place] or 2 * x.controls > len(x.text) for x in page.lines], [page.articles[x.place] for x in page.lines]


def teasers(page: Page, apart: list[bool]) -> set[int]:
    """Lines of articles that hold less than a quarter of the weight and a line that is a link: they lead to other pages."""
    top = [0] * len(page.parents)  # the outermost article around an element
    for k in range(1, len(top)):
        top[k] = top[page.parents[k]] or k * page.articles[k]
    held, linked, total = {}, set(), 0
    for line, out in zip(page.lines, apart, strict=True):
        if not out:
            weight, k = line_weight(line), top[line.place]
            total, held[k] = total + weight, held.get(k, 0) + weight
            if k and not weight:
                linked.add(k)
    return {k for k, line in enumerate(page.lines) if top[line.place] in linked and 4 * held[top[line.place]] < total}


def page_lines(page: str) -> Iterator[tuple[str, int, bool, bool]]:
    """(text, characters of it in links, set apart, in an article) of every line of a page that shows text."""
    found = Reader(page).read()
    return ((x.text, x.links, a, b) for x, a, b in zip(found.lines, *settle(found), strict=True))


def stretches_of(weights: np.ndarray, window: int) -> list[list[int]]:
    """The lines that weigh something, from each surge of the window sums to the next dive."""
    # Sums over windows that end at or after a line.
    sums = np.convolve(weights, np.ones(window, np.int64))[: len(weights)]
    rising = np.flatnonzero(np.diff(sums > 0, prepend=False, append=False))
    return [[k for k in range(a, b) if weights[k]] for a, b in zip(rising[::2], rising[1::2], strict=True)]


def main_text(page: str | None, window: int = 3, share: float = 0.25) -> str:
    found = Reader(page or "").read()
    lines = found.lines
    if not lines:
        return ""
    apart, article = settle(found)
    plain = np.array([0 if a else line_weight(x) for x, a in zip(lines, apart, strict=True)], np.int64)
    within = np.array([len(x.text) * (b and not a) for x, a, b in zip(lines, apart, article, strict=True)], np.int64)
    bounded = 2 * (plain * (within > 0)).sum() > plain.sum() or not plain.any() and within.any()
    if not bounded:
        for k in teasers(found, apart):
            apart[k], plain[k] = True, 0
    weights = within if bounded else plain
    stretches = stretches_of(weights, window)
    if bounded:
        return "\n".join(lines[k].text for x in stretches for k in x)
    heavy = max((weights[x].sum() for x in stretches), default=0)
    kept = {k for x in stretches if weights[x].sum() >= share * heavy or any(is_prose(lines[k].text) for k in x) for k in x}
    # What stands in the very element that holds lines of such a stretch belongs to it, however slight or linked.
    holders = {lines[k].holder for k in kept}
    for k, line in enumerate(lines):
        linked = weights[k] == 0
        if not apart[k] and line.holder in holders and (line.holder > 0 and (not linked or line.tag) or linked and line.tag in PARAGRAPHS):
            kept.add(k)
    return "\n".join(lines[k].text for k in sorted(kept))


def extract_main_text(pages: DataFrame, window: int = 3, share: float = 0.25) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in batches_of(whole)):
            texts = [main_text(x, window, share) for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
