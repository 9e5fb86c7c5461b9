"""Main text of HTML pages by text-to-tag ratios over the events of the standard library's parser.

The page is fed to the parser piece by piece. Block tags end a line; a line has its characters, its tags, and whether
an element around it is known not to be content (navigation, forms, scripts, adverts, notices, comments). The ratio of
characters to tags is smoothed over neighbouring lines with a Gaussian, and lines at or above a threshold, a share of
the page's standard deviation, form the clusters of content. A cluster lends its verdict to the region it lies in: the
innermost ``article`` or ``main`` element, or else the lines between its first and last line, with the heading before
it. Short paragraphs inside a region are thus kept.

Defined results: null and blank pages, and pages without content, give the empty text; unclosed and stray tags are
mended as browsers do; very long pages are read whole; repeated rows give one result each; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import table

FEED_CHARS = 1 << 16
SIGMA = 1.0
THRESHOLD_SHARE = 0.25
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea input iframe object svg "
    "canvas menu dialog audio video math".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset(("article", "main"))
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|nav\w*|menu\w*|breadcrumbs?|header|masthead|foot\w*|"
    r"comments?|commentlist|disqus\w*|replies|respond|cookies?|consent|notices?|gdpr|popup|modal|overlay|newsletter|subscri\w*|"
    r"share|sharing|social|related|recommend\w*|widget\w*|toolbar|login|signup|search|pagination|pager|copyright|legal|"
    r"hidden|sr-only|skip-link|toc)(?:$|[\s_-])",
    re.I,
)

UNFINISHED = re.compile(r"</?[a-zA-Z][^>]*$|<!--")


class Lines(HTMLParser):
    """Collects lines ``[parts, chars, tags, skipped, region, heading]``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []
        self.lines: list[tuple[str, int, int, bool, int, bool]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.skipping = 0
        self.region = 0
        self.regions = 0

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                heading = any(tag in HEADINGS for tag, _, _ in self.stack[-3:])
                self.lines.append((text, len(text), max(1, self.tags), self.skipping > 0, self.region, heading))
                self.tags = 0

    def _push(self, tag: str, skipped: bool) -> None:
        outer = self.region
        if tag in REGIONS and not self.skipping:
            self.regions += 1
            self.region = self.regions
        self.stack.append((tag, skipped, outer))
        self.skipping += skipped

    def _pop(self) -> None:
        _, skipped, outer = self.stack.pop()
        self.skipping -= skipped
        self.region = outer

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE:
            self.tags += 1
            if tag not in VOID:
                marked = bool(attrs) and self._marked(attrs)
                if marked:
                    self._end_line()
                self._push(tag, marked)
            return
        if tag == "br" or tag == "hr":
            self.parts.append(" ")
            self.tags += 1
            return
        self._end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):  # these end one of their kind that is still open
            closes = {tag} if tag not in ("dt", "dd") else {"dt", "dd"}
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in closes:
                    while len(self.stack) > i:
                        self._pop()
                    break
                if self.stack[i][0] not in INLINE and self.stack[i][0] != "p":
                    break
        elif self.stack and self.stack[-1][0] == "head" and tag not in NEVER:
            self._pop()
        skipped = tag in NEVER or (tag == "header" and not self.region) or (
            bool(attrs) and tag not in ("html", "body", "article", "main") and self._marked(attrs)
        )
        self._push(tag, skipped)

    @staticmethod
    def _marked(attrs: list) -> bool:
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label") and value and MARKED.search(value):
                return True
            if name == "hidden" or (name == "style" and value and re.search(r"display\s*:\s*none", value, re.I)):
                return True
            if name == "role" and value in ("navigation", "complementary", "contentinfo", "search", "alert", "dialog"):
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self._end_line()
        if not any(t == tag for t, _, _ in self.stack):
            return
        if tag in INLINE:  # a stray inline end closes nothing beyond its block
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    break
                if self.stack[i][0] not in INLINE:
                    return
        while self.stack:
            last = self.stack[-1]
            if last[1]:
                self._end_line()
            self._pop()
            if last[0] == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)
        elif not data.isspace():
            self._end_line()
            self.parts.append(data)
            self._end_line()

    def finish(self) -> list[tuple[str, int, int, bool, int, bool]]:
        if UNFINISHED.match(self.rawdata):  # a tag cut off by the end of the page is no text
            self.rawdata = ""
        self.close()
        self._end_line()
        return self.lines


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over neighbouring lines; the kernel is renormalised at both ends."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d in range(-reach, reach + 1):
            if 0 <= i + d < len(values):
                total += kernel[d + reach] * values[i + d]
                weight += kernel[d + reach]
        out.append(total / weight)
    return out


def main_text(page: str | None) -> str:
    parser = Lines()
    page = page or ""
    for at in range(0, len(page), FEED_CHARS):
        parser.feed(page[at : at + FEED_CHARS])
    lines = parser.finish()
    usable = [i for i, line in enumerate(lines) if not line[3]]
    if not usable:
        return ""
    ratios = smoothed([0.0 if line[3] else line[1] / line[2] for line in lines])
    own = [ratios[i] for i in usable]
    mean = sum(own) / len(own)
    spread = math.sqrt(sum((r - mean) ** 2 for r in own) / len(own))
    threshold = min(THRESHOLD_SHARE * spread, max(own))
    dense = [i for i in usable if ratios[i] >= threshold]
    regions = {lines[i][4] for i in dense} - {0}
    if regions:
        chosen = [i for i in usable if lines[i][4] in regions]
    else:
        first, last = dense[0], dense[-1]
        while first > 0 and lines[first - 1][5] and not lines[first - 1][3]:
            first -= 1
        chosen = [i for i in usable if first <= i <= last]
    return " ".join(lines[i][0] for i in chosen)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with columns ``main_text`` and ``main_chars`` (code points)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch], dtype="object")

    marked = pages.withColumn("main_text", run(F.col(html))).drop(html)
    return marked.withColumn("main_chars", F.char_length("main_text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    found = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))
