"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The standard library's parser reads a page as a stream of events. Block-level tags cut it into lines;
a line keeps its text, the number of tags in it, its characters in links, and the sectioning elements
around it. What stands in navigation, page headers, footers, sidebars, forms, scripts and styles (by
element or role) makes no line, nor do elements whose class or id says that they hold notices, adverts,
reader comments and the like (MARKS; all words of the name must be such or say nothing, so
`cookie-notice` counts and `menu-of-the-day` doesn't). Within an article or main element a paragraph,
heading or list item with such a name is only in doubt.

Each line's ratio of characters to tags is smoothed with a Gaussian over its neighbours; lines at or
over a share of the standard deviation form clusters. The element that holds most of the clustered text
is the content region: an article or main element where one holds a good part of it (and others that lie beside
it and do so too, in page order), else the innermost element with nearly all of it, or one around it if what that
adds is mostly in clusters too. Such an element is taken whole, headings and short paragraphs with it; if only the body is left, or
most of the element is in no cluster, it is taken from its first cluster to its last. In the region, a line that is in
doubt, or that is one of several lines of links, stays only if it is in a cluster; of links in a row it
is their own ratio that counts, since the text beside them would lift them.

Character references are decoded, white space in a block becomes one space, blocks are joined by one
line feed. A null or empty page, and a page without text, gives the empty text. Pages that break off
in the middle give what was read. Pages of any length are read whole. Repeated rows give repeated
results, an empty table none; columns with clashing names are kept, but for those of the new names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import slices

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg math iframe object canvas head title nav aside footer form button select textarea dialog menu audio video".split())
SECTIONS = frozenset("article main section div td body".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class or id that mark what isn't part of the article, and words beside them that say nothing.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer"
    " dropdown footer header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion"
    " related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar tags widget".split()
)
BESIDE = frozenset("area bar block body bottom box button buttons container content form global group holder icons inner item items js left links list main message outer page panel placement posts primary right secondary section site slot stories top unit wrap wrapper".split())
COMMENT_MARKS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Elements that hold a paragraph's worth of text; in an article their class or id raises no more than doubt.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th caption figcaption".split())
SIGMA = 1.0
SHARE = 0.3


def marked(value: str) -> set[str]:
    """The marks of a class or id attribute."""
    found: set[str] = set()
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words & MARKS and words <= MARKS | BESIDE:
            found |= words & MARKS
    return found


class Lines(HTMLParser):
    """Collects lines: text, tags, characters in links, doubt, and the numbers of the sectioning elements around, outermost first."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, tuple[int, ...]]] = []
        self.kinds: list[str] = []  # the tag of each sectioning element
        self.open: list[tuple[str, int]] = []  # sectioning elements around: tag, number
        self.inside: tuple[int, ...] = ()
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.in_link = False
        self.doubt = ""  # the tag of the paragraph in doubt that is open
        self.dropping = ""  # the tag of the dropped element that is open
        self.depth = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, bool(self.doubt), self.inside))
            self.tags = 0
        self.linked = 0
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.dropping:
            if tag == self.dropping:
                self.depth += 1
                return
            if tag not in ("article", "main") or self.dropping in ("script", "style", "head", "title") or self.comments:
                return
            self.dropping = ""  # a menu or header that was never closed
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            if tag in PARAGRAPHS:
                self.doubt = ""
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if self.unwanted(tag, attrs):
            self.dropping, self.depth = tag, 1
            return
        self.in_link = self.in_link or tag == "a"
        if tag in SECTIONS:
            self.open.append((tag, len(self.kinds)))
            self.kinds.append(tag)
            self.inside = (*self.inside, len(self.kinds) - 1)

    def unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        self.comments = False
        if tag in DROPPED or tag == "header" and not any(t in ("article", "main") for t, _ in self.open):
            return True
        if tag in ("html", "body", "main", "header") or not attrs:
            return False
        marks: set[str] = set()
        for name, value in attrs:
            if name in ("class", "id") and value:
                marks |= marked(value)
            elif name == "role" and value and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
        self.comments = bool(marks & COMMENT_MARKS)
        if self.comments or not marks or tag == "article":
            return self.comments
        if not any(t in ("article", "main") for t, _ in self.open):
            return True
        if tag in PARAGRAPHS:
            self.doubt = tag
        return tag in BLOCKS and tag not in PARAGRAPHS

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.dropping:
            if tag == self.dropping:
                self.depth -= 1
                if not self.depth:
                    self.dropping = ""
            return
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if tag == self.doubt:
            self.doubt = ""
        elif tag == "a":
            self.in_link = False
        if tag in SECTIONS and any(t == tag for t, _ in self.open):
            while self.open and self.open.pop()[0] != tag:
                pass
            self.inside = tuple(n for _, n in self.open)

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian; at the ends its weights are shared among the lines that exist."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def clustered(ratios: np.ndarray, smooth: bool = True) -> np.ndarray:
    """Which lines are in clusters: those whose ratio, smoothed or their own, is at or over a share of the smoothed ratios' deviation."""
    even = smoothed(ratios)
    return (even if smooth else ratios) >= min(SHARE * float(even.std()), float(even.max()))


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    parser = Lines()
    parser.feed(page)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    sizes = np.array([len(line[0]) for line in lines], np.float64)
    own = sizes / np.maximum([line[1] for line in lines], 1)
    chosen = clustered(own)
    links = np.array([line[2] >= 0.9 * len(line[0]) for line in lines])
    row = links & (np.r_[False, links[:-1]] | np.r_[links[1:], False])
    chosen &= ~row | clustered(own, smooth=False)
    stays = chosen | ~(row | np.array([line[3] for line in lines]))
    held: dict[int, float] = {}  # clustered characters in each sectioning element
    whole: dict[int, float] = {}  # all characters
    around: dict[int, int | None] = {}  # the sectioning element around each
    for k, line in enumerate(lines):
        for outer, n in zip((None, *line[4]), line[4]):
            held[n] = held.get(n, 0.0) + sizes[k] * chosen[k]
            whole[n] = whole.get(n, 0.0) + sizes[k]
            around[n] = outer
    most = float(sizes[chosen].sum())
    named = [n for n in held if parser.kinds[n] in ("article", "main") and held[n] >= 0.3 * most]
    if named:  # the largest, and others that lie beside it; of nested ones the innermost that has most of the outer one's text
        best = max(named, key=lambda n: held[n])
        for n in sorted(named):
            if n > best and held[n] >= 0.6 * held[best] and any(best in line[4] and n in line[4] for line in lines):
                best = n
        articles = {n for n in named if n == best or not any(n in line[4] and best in line[4] for line in lines)}
        return "\n".join(line[0] for k, line in enumerate(lines) if articles & {*line[4]} and stays[k])
    best = max((n for n in held if held[n] >= 0.8 * most), default=None)  # the innermost with nearly all of it
    while best is not None and (outer := around[best]) is not None and parser.kinds[outer] != "body" and held[outer] - held[best] >= 0.5 * (whole[outer] - whole[best]):
        best = outer  # what lies around it is mostly content too
    if best is not None and parser.kinds[best] != "body" and held[best] >= 0.5 * whole[best]:
        return "\n".join(line[0] for k, line in enumerate(lines) if best in line[4] and stays[k])
    region = [k for k in range(len(lines)) if best is None or best in lines[k][4]]
    kept = [k for k in region if chosen[k]] or region
    return "\n".join(lines[k][0] for k in region if kept[0] <= k <= kept[-1] and stays[k])


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages without the html, with the main text; a column of the text's name is replaced."""
    keep = [c for c in pages.columns if c not in (html, text)]
    schema = pages.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias(text)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([extract(page) for page in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], names=[*keep, text])

    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").cast("string").alias("html of a page")).mapInArrow(run, schema)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract_text(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
