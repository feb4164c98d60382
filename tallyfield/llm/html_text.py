"""Main text of web pages by text-to-tag ratios of lines, smoothed and clustered."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm.common import column, mapped, native_id_type, table, texts
from tallyfield.llm.registry import query

#: Elements that begin and end a line of text.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article.
DROPPED = frozenset("aside button canvas dialog footer form head iframe input map menu nav noscript object option script select style svg template textarea title".split())
CONTAINERS = frozenset(("article", "main"))
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: A class or id marks an element as dropped if one of its names starts or ends with one of these words.
MARKS = "ad ads adbox advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget"
MARKED = re.compile(r"(?:{0})(?:[-_0-9].*)?|(?!(?:has|no|with|without|is)[-_]).*[-_](?:{0})".format("|".join(MARKS.split())))
SMOOTHING = 1.0
#: Centres closer than this (in logarithms) are one cluster: then no line is told apart by its ratio.
APART = 0.7


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    dropped: bool
    container: int


class Lines(HTMLParser):
    """Parser events to lines: a line ends at every block element. Unclosed elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int]] = []
        #: Places of the open block elements, and open elements per name: no event walks over more than it closes.
        self.blocks: list[int] = []
        self.names: Counter[str] = Counter()
        self.words: list[str] = []
        self.tags = self.linked = self.containers = self.links = 0
        self.kinds: dict[int, str] = {}

    def state(self) -> tuple[bool, int]:
        return self.open[-1][1:] if self.open else (False, 0)

    def end_line(self) -> None:
        text = " ".join("".join(self.words).split())
        dropped, container = self.state()
        if text or self.tags:
            self.lines.append(Line(text, self.tags, self.linked, dropped, container))
        self.words, self.tags, self.linked = [], 0, 0

    def unwanted(self, tag: str, attrs: list, container: int) -> bool:
        if tag in DROPPED or tag == "header" and not container:
            return True
        if tag in ("html", "body", "main") or tag == "article" and not container:
            return False
        for name, value in attrs:
            if name in ("hidden",) or name == "aria-hidden" and value == "true" or name == "role" and (value or "").lower() in DROPPED_ROLES:
                return True
            if name in ("class", "id") and value and any(MARKED.fullmatch(x) for x in value.lower().split()):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.end_line()
            if tag != "br" and self.blocks and self.open[self.blocks[-1]][0] == "p":
                self.close_to(self.blocks[-1])
        elif tag in ("td", "th"):
            self.words.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        dropped, container = self.state()
        dropped = dropped or self.unwanted(tag, attrs, container)
        if tag in CONTAINERS and not dropped and not (container and self.kinds[container] == "article"):
            self.containers += 1
            container = self.containers
            self.kinds[container] = tag
        if not dropped == self.state()[0] and tag not in BLOCK:
            self.end_line()
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.names[tag] += 1
        self.open.append((tag, dropped, container))
        self.links += tag == "a"

    def close_to(self, at: int) -> None:
        if self.state() != (self.open[at - 1][1:] if at else (False, 0)):
            self.end_line()
        for tag, _, _ in self.open[at:]:
            self.names[tag] -= 1
            self.links -= tag == "a"
        del self.open[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        for at in range(len(self.open) - 1, -1, -1) if self.names[tag] else ():
            if self.open[at][0] == tag:
                self.close_to(at)
                break

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.words.append(data)
        if self.links:
            self.linked += len(data)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean over the neighbouring lines, weights cut off at the page's ends."""
    reach = max(1, int(np.ceil(2 * sigma)))
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(ratios, weights)[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), weights)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The middle between the centres of two clusters of the values; least of all values if they lie together."""
    low, high = float(values.min()), float(values.max())
    for _ in range(30):
        upper = values > (low + high) / 2
        if upper.all() or not upper.any():
            break
        low, high = float(values[~upper].mean()), float(values[upper].mean())
    return (low + high) / 2 if high - low > APART else float(values.min())


def main_text(html: str, sigma: float = SMOOTHING) -> str:
    """Lines whose smoothed ratio lies in the upper cluster are content. A page's article or main element that holds content is taken whole,
    without the regions dropped by element, role or class; without such an element the region from first to last content line is."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    ratios = np.array([0.0 if x.dropped else (len(x.text) - min(x.linked, len(x.text))) / max(1, x.tags) for x in lines])
    values = np.log1p(smoothed(ratios, sigma))
    least = threshold(values)
    content = [i for i, x in enumerate(lines) if ratios[i] > 0 and values[i] >= least]
    inside = {x.container for x in lines if x.container and x.text and not x.dropped}
    if inside:
        wanted = {lines[i].container for i in content} & inside or inside
        taken = [x for x in lines if x.text and not x.dropped and x.container in wanted]
    elif content:
        taken = [x for x in lines[content[0] : content[-1] + 1] if x.text and not x.dropped]
    else:
        taken = [x for x in lines if x.text and not x.dropped]
    return "\n".join(x.text for x in taken)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; null or empty html gives empty text.

    Pages are parsed one by one, whole, whatever their length; broken markup is read as the standard parser reads it. Repeated rows give repeated
    results, an empty table none; other columns are not read.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(x) for x in texts(batch, "html")]
        return pa.record_batch([column(batch, "page_id"), column(batch, "url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return mapped(pages.select("page_id", "url", "html"), "html", make, f"page_id {native_id_type(pages, 'page_id')}, url string, text string, n_chars long")


@query("op1_html_text")
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
