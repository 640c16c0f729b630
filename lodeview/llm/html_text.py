"""Main text of web pages, from streaming parser events.

The standard library's parser feeds a small state machine. A *line* is a run of
text between block boundaries; with it go the number of tags met since the line
before, the share of link text, and the element that holds it. Lines of elements
that never hold an article (menus, forms, scripts and so on, by tag, role or
class words of blocks) are set apart as they come. An element is kept as the
range of lines that it holds, so time and memory follow the length of the page,
however deeply it is nested.

Over the remaining lines the text-to-tag ratio (characters per tag) is smoothed
with a Gaussian and clustered at a threshold, the mean less a share of the
deviation, but never above what keeps the longest line. The lines above it choose
the region:

* with articles, all of them; where chosen lines of a ``main`` lie outside of its
  articles, that ``main``;
* else, with ``main`` elements, all of these;
* else the nearest division or section around all chosen lines.

All lines of the region that are not set apart are kept, short ones too.

Defined cases: null or empty html gives the empty text; unclosed and stray tags
are met by closing what they imply; malformed declarations are comments; text
outside any element counts as a line; words of inline elements stay unless the
element is hidden; rows are handled one by one, so ties and repeated rows don't
matter; further columns pass through ``extract``, but for one that has the name
of the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea input label fieldset menu dialog iframe object svg canvas math audio video map search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars side aside widget widgets footer foot masthead header topbar toolbar "
    "comment comments commentlist respond reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login pagination pager skip toc".split()
)
ARTICLE_ASIDE = frozenset("comment reply ad advert advertisement promo sponsored related teaser".split())
OPENS_CLOSE_P = BLOCKS - {"html", "body"}
CONTENT = frozenset("p ul ol li dl dt dd table caption thead tbody tr td th figure figcaption blockquote pre h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
REGIONS = frozenset("section div td center body html".split())
HOLDS = frozenset("ul ol dl table div article section main body aside nav header footer form blockquote td th".split())
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


def _names_aside(name: str) -> bool:
    parts = [t.lower() for t in _TOKENS.findall(name)]
    return bool(parts) and parts[0] not in ("has", "with", "no", "is") and not ASIDE_WORDS.isdisjoint(parts)


def _set_apart(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    if tag in NEVER:
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value:
            continue
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if tag not in BLOCKS:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name in ("class", "id"):
            names = value.split()
            if tag == "article":
                aside = any(x.lower() in ARTICLE_ASIDE for x in names)
            elif in_article and tag in CONTENT:  # a list of menu items may be what the article is about
                aside = any(x.lower() in ASIDE_WORDS for x in names)
            else:
                aside = any(map(_names_aside, names))
            if aside:
                return True
    return False


@dataclass
class _Element:
    """An open or closed element, as the range of lines in it; article and main: the outermost that hold it, or itself."""

    tag: str
    apart: bool
    parent: _Element | None
    first: int
    article: _Element | None
    main: _Element | None
    end: int = -1


class _Lines(HTMLParser):
    """Lines of a page as (text, tags, share of link text, element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Element] = []  # blocks, links and what is set apart
        self.open: Counter[str] = Counter()
        self.apart = self.tags = self.linked = 0
        self.buffer: list[str] = []
        self.lines: list[tuple[str, int, float, _Element | None]] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` begins a comment, whatever follows."""
        return self.parse_bogus_comment(i)

    def _flush(self) -> None:
        if self.buffer:
            text = _SPACE.sub(" ", "".join(self.buffer)).strip(" ")
            if text:
                self.lines.append((text, self.tags, self.linked / len(text), self.stack[-1] if self.stack else None))
                self.tags = 0
            self.buffer, self.linked = [], 0

    def _pop_to(self, at: int) -> None:
        for x in self.stack[at:]:
            x.end = len(self.lines)
            self.apart -= x.apart
            self.open[x.tag] -= 1
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
            self._imply(tag)
        if tag in VOID:
            return
        above = self.stack[-1] if self.stack else None
        article, main = (above.article, above.main) if above else (None, None)
        apart = _set_apart(tag, attrs, article is not None)
        # other inline elements don't matter, unless one of the name that does is open
        if tag in BLOCKS or tag == "a" or apart or self.open[tag]:
            here = _Element(tag, apart, above, len(self.lines), article, main)
            here.article = article or (here if tag == "article" else None)
            here.main = main or (here if tag == "main" else None)
            self.stack.append(here)
            self.open[tag] += 1
            self.apart += apart

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style", "p", "div", "span", "a"):
            self.handle_endtag(tag)

    def _imply(self, tag: str) -> None:
        """Close elements whose end tag may be left out before ``tag``."""
        ends = CLOSES.get(tag, ()) + (("p",) if tag in OPENS_CLOSE_P else ())
        if not any(self.open[x] for x in ends):
            return
        cut = None
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i].tag
            if name in ends:
                cut = i
            elif name in HOLDS:
                break
        if cut is not None:
            self._pop_to(cut)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._flush()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                if any(x.tag in BLOCKS for x in self.stack[i:]):
                    self._flush()
                self._pop_to(i)
                return

    def handle_data(self, data: str) -> None:
        if not self.apart:
            self.buffer.append(data)
            if self.open["a"]:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._flush()
        self._pop_to(0)


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """A Gaussian mean over neighbouring lines, cut at three deviations and at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        part = weights[lo - i + reach : hi - i + reach]
        out.append(sum(v * w for v, w in zip(values[lo:hi], part, strict=True)) / sum(part))
    return out


def main_text(html: str | None, *, sigma: float = 1.0, spread: float = 0.5) -> str:
    """The blocks of the main text, each on a line of its own."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    ratio = smoothed([len(text) * (1 - linked) / max(1, tags) for text, tags, linked, _ in lines], sigma)
    mean = sum(ratio) / len(ratio)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))
    threshold = min(max(ratio), mean - spread * deviation)
    chosen = [r >= threshold for r in ratio]

    elements = [x for *_, x in lines]
    articles = {id(x.article): x.article for x in elements if x and x.article}
    mains = {id(x.main): x.main for x in elements if x and x.main}
    if articles:
        wide = {id(x.main): x.main for x, take in zip(elements, chosen, strict=True) if take and x and x.main and not x.article}
        wide = {n: x for n, x in wide.items() if any(a.main is x for a in articles.values())}
        regions = [*articles.values(), *wide.values()]
    elif mains:
        regions = list(mains.values())
    else:
        at = [i for i, take in enumerate(chosen) if take]
        region = elements[at[0]]
        while region is not None and (region.tag not in REGIONS or region.end <= at[-1]):
            region = region.parent
        regions = [region] if region else []
    if not regions:
        return "\n".join(text for text, *_ in lines)
    inside = bytearray(len(lines))
    for x in regions:
        inside[x.first : x.end] = b"\1" * (x.end - x.first)
    return "\n".join(text for (text, *_), take in zip(lines, inside, strict=True) if take)


def extract(pages: DataFrame, *, html_col: str = "html", sigma: float = 1.0, spread: float = 0.5, out_col: str = "text") -> DataFrame:
    """``pages`` with the main text instead of the html."""
    others = [c for c in pages.columns if c not in (html_col, out_col)]
    chosen = pages.select(*others, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                texts = [main_text(h, sigma=sigma, spread=spread) for h in rows.column(len(others)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(texts, pa.string())], [*others, out_col])

    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:-1], T.StructField(out_col, T.StringType())]))


def report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
