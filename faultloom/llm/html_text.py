"""Main text of HTML pages from parser events, text-to-tag ratios, smoothing and threshold clustering.

The standard library's parser streams events; block boundaries cut them into lines, each with its text, its
count of tags and its place in the page. Ratios of text to tags are smoothed with a Gaussian, and lines
above the standard deviation form the content cluster. Its lines outside page furniture decide the content
region: the innermost container that holds them all (never a paragraph, heading or list), an element around it
that has a heading of its own, or the article or main element around it. All lines of that region are the
text, short ones too, except for furniture.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.5
FEED = 1 << 16

#: Elements whose text is never shown as text of the page.
SILENT = frozenset("script style noscript template iframe object svg math head title textarea select".split())
#: Elements, roles and name parts that mark furniture.
FURNITURE = frozenset("nav header footer aside form dialog menu button".split()) | SILENT
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu header "
    "masthead footer sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe signup login share sharing social related recommended breadcrumb breadcrumbs comment comments respond "
    "disqus pagination pager widget toolbar".split()
)
BODIES = frozenset("article content main body post entry story text".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul script style noscript template iframe object textarea select button".split()
)
CLOSES_P = BLOCKS - {"br", "caption", "option", "title", "script", "style", "template", "noscript"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are part of a text, never the container of one.
PASSAGES = HEADINGS | set("p pre blockquote li ul ol dl dt dd figure figcaption caption tr tbody thead tfoot table".split())
#: An opening tag ends an open element of these names, up to the nearest of the elements that bound it.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("ul ol dl table select body article section div".split())


def is_furniture(tag: str, attrs) -> bool:
    if tag in FURNITURE:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    names = dict(attrs)
    if (names.get("role") or "").strip().lower() in ROLES:
        return True
    parts = set(re.split(r"[^a-z0-9]+", f"{names.get('class') or ''} {names.get('id') or ''}".lower()))
    return bool(parts & MARKS) and not parts & BODIES


class Lines(HTMLParser):
    """Lines of a page: text, tags, furniture or not, and the chain of block elements around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.hidden: list[bool] = []
        self.inside: list[int] = []
        self.names, self.parents = ["#page"], [-1]  # elements by number
        self.open = [(0, "#page", False)]
        self.parts: list[str] = []
        self.count = 0

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.count:
            number, name, hidden = self.open[-1]
            self.texts.append("" if any(n in SILENT for _, n, _ in self.open[1:]) and hidden else text)
            self.tags.append(self.count)
            self.hidden.append(hidden)
            self.inside.append(number)
        self.parts, self.count = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in BLOCKS and not (tag not in VOID and is_furniture(tag, attrs)):
            self.count += 1
            return
        self.cut()
        self.count += 1
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close({"p"}, BOUNDS)
        if tag in IMPLIED:
            self.close(IMPLIED[tag], BOUNDS)
        number = len(self.names)
        self.names.append(tag)
        self.parents.append(self.open[-1][0])
        self.open.append((number, tag, self.open[-1][2] or is_furniture(tag, attrs)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1][1] == tag and tag not in self.CDATA_CONTENT_ELEMENTS:
            self.handle_endtag(tag)

    def close(self, tags, bounds) -> None:
        """End the innermost open element of these names unless a bounding element is met first."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][1] in tags:
                self.cut()
                del self.open[at:]
                return
            if self.open[at][1] in bounds:
                return

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][1] == tag:
                self.cut()
                self.count += 1
                del self.open[at:]
                return
        self.count += 1

    def handle_data(self, data):
        self.parts.append(data)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends repeat their own value."""
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), weights / weights.sum(), mode="valid")


def main_text(html: str | None) -> str:
    """The text of a page's content region; empty without any."""
    page = Lines()
    html = html or ""
    for at in range(0, len(html), FEED):
        page.feed(html[at : at + FEED])
    HTMLParser.close(page)
    page.cut()
    lengths = np.array([len(t) for t in page.texts], np.float64)
    hidden = np.array(page.hidden, bool)
    if not len(lengths) or not lengths[~hidden].any():
        return ""
    ratios = smooth(lengths / np.maximum(1, page.tags))
    chosen = (ratios >= ratios.std()) & ~hidden & (lengths > 0)
    if not chosen.any():
        chosen = ~hidden & (lengths > 0)
    own = np.bincount(np.array(page.inside)[chosen], minlength=len(page.names))
    for number in range(len(own) - 1, 0, -1):
        own[page.parents[number]] += own[number]
    region = int(np.flatnonzero(own == own[0])[-1])  # the latest opened is innermost
    headed = {page.parents[n] for n, h in zip(page.inside, page.hidden) if page.names[n] in HEADINGS and not h}
    while region > 0 and (page.names[region] in PASSAGES or page.parents[region] in headed):
        region = page.parents[region]
    around = region
    while around > 0:
        if page.names[around] in ("article", "main"):
            region = around
        around = page.parents[around]
    within = np.zeros(len(own), bool)
    within[region] = True
    for number in range(region + 1, len(own)):
        within[number] = within[page.parents[number]]
    keep = ~hidden & within[np.array(page.inside)]
    return " ".join(t for t, k in zip(page.texts, keep) if k and t)


def extract_text(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page, url, text, n_chars)`` per row of ``pages``.

    Null and empty html and pages without text give an empty text of 0 characters. Markup that is not closed
    or not well formed is read as far as the parser reads it. Null ids and urls stay null, repeated rows are
    rows of their own, an empty table gives none, other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page", "url", "text"]
            )

    kind = pages.schema[page].dataType.simpleString()
    source = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.col(html).alias("html"))
    out = source.mapInArrow(run, f"page {kind}, url string, text string")
    return out.select(
        F.col("page").alias(page), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars")
    )
