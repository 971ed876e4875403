"""Main-text extraction from streaming parser events and text-to-tag ratios.

The parser's events cut a page into lines: the text between two block boundaries, with the number of tags inside and before
it. A line's text-to-tag ratio is smoothed with a Gaussian over the page's lines; lines above a threshold (a share of the
standard deviation), but for those that are nearly all links, form clusters, and the smallest container that holds all clusters is the content region; lists, tables and
quotes are parts of a text and never the region, and no element's name makes it one. Every line of that region is returned,
short ones too, but for

- what lies in elements made for menus, headers, footers, sidebars, forms, scripts and styles;
- blocks and containers that the words of their class, id or role mark as such, or as notices, adverts or readers' comments. Marks
  are taken for the wrapper's own look, and ignored, where all clusters lie under marks, or where one mark other than readers'
  comments holds most of the clusters' text and the page's heading, article or main element;
- containers without a line in a cluster whose text is nearly all links: menus that nothing marks.

Unclosed tags and stray end tags are tolerated: only elements that group others are kept on the stack. A null or empty page, or
one without text, gives an empty text; a very long page is handled whole, in memory, in time that grows with its lines and how deep they lie. Pages are
handled one at a time; repeated rows and ties are independent of each other. An empty table gives no rows. Other columns of the
input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import by_chunks, map_arrow, text_or_empty

SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

SKIPPED = frozenset("nav header footer aside form script style noscript template svg iframe button select option textarea head title menu dialog object canvas".split())
GROUPS = frozenset("html body article main section div nav header footer aside form ul ol dl table tbody thead tr figure blockquote details menu dialog fieldset td".split())
#: Groups that are parts of a text, so never its region.
PARTS = frozenset("ul ol dl table tbody thead tr td figure blockquote details fieldset".split())
BLOCKS = GROUPS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd th pre hr br address figcaption caption summary tfoot".split())
RAW = frozenset("script style noscript template svg iframe textarea title object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names in class, id or role that mark what isn't content, whole or as the first or last part of a name ("ad-slot", "site-footer").
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs footer masthead sidebar comment comments disqus cookie cookies consent "
    "notice alert popup modal newsletter subscribe signup login pagination pager copyright disclaimer toolbar".split()
)
#: Names that mark it as a whole only; as parts they are common in the names of content.
WHOLE_MARKS = frozenset(
    "banner promotion header site-header page-header aside widget respond reply replies subscription share sharing share-buttons social social-links related related-posts related-articles related-links "
    "related-content related-stories recommended recommendations complementary contentinfo search search-form legal form".split()
)
READERS = frozenset("comment comments disqus respond reply replies".split())
#: First parts of names that say what a wrapper has or is, not what it is made for.
ABOUT = frozenset("has no not with without is".split())


@dataclass(frozen=True)
class Ratios:
    """share_of_deviation: the threshold; link_share: from what part on a container's text counts as links only."""

    sigma: float = 1.0
    share_of_deviation: float = 0.5
    link_share: float = 0.8


def marked(attrs: list) -> str:
    """What class, id and role say: "" for content, "readers" for comments, "mark" for other marks."""
    found = ""
    for k, v in attrs:
        if v and k in ("class", "id", "role"):
            for name in v.lower().split():
                parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
                if parts and parts[0] not in ABOUT and ("-".join(parts) in WHOLE_MARKS or parts[0] in MARKS or parts[-1] in MARKS):
                    if READERS & {parts[0], parts[-1]}:
                        return "readers"
                    found = "mark"
    return found


class _Lines(HTMLParser):
    """Collects lines (text, tags, container, characters in links, mark of its block) and containers (parent, tag, mark)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]
        self.raw: str | None = None
        self.containers: list[tuple[int, str, str]] = [(0, "", "")]
        self.lines: list[tuple[str, int, int, int, str]] = []
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.link, self.block = False, ""
        self.headed: set[int] = set()

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text and not self.stack[-1][2]:
            self.lines.append((text, self.tags, self.stack[-1][1], min(self.linked, len(text)), self.block))
        if text:
            self.tags = 0
        self.text, self.linked, self.block = [], 0, ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.raw:
            return
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if tag in ("h1", "article", "main"):
            self.headed.update(c for _, c, _ in self.stack)
        if tag in RAW:
            self.raw = tag
        elif tag in GROUPS or tag in SKIPPED:
            skip = self.stack[-1][2] or tag in SKIPPED
            self.containers.append((self.stack[-1][1], tag, "" if tag in ("html", "body", "article", "main") else marked(attrs)))
            self.stack.append((tag, len(self.containers) - 1, skip))
        elif tag in BLOCKS:
            self.block = marked(attrs)
        elif tag == "a":
            self.link = True

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or tag in RAW:
            if not self.raw:
                if tag in BLOCKS:
                    self.cut()
                self.tags += 1
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.raw:
            if tag == self.raw:
                self.raw = None
            return
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if tag == "a":
            self.link = False
        elif tag in GROUPS or tag in SKIPPED:
            self.link = False
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == tag:
                    del self.stack[i:]
                    break

    def handle_data(self, data: str) -> None:
        if not self.raw:
            self.text.append(data)
            if self.link:
                self.linked += len(data.strip())


def _smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), mode="valid")


def _path(containers: list[tuple[int, str, str]], c: int) -> list[int]:
    """A container and what holds it, from the page down."""
    out = [c]
    while out[-1]:
        out.append(containers[out[-1]][0])
    return out[::-1]


def main_text(html: str, how: Ratios = Ratios()) -> str:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    lines, containers = parser.lines, parser.containers
    if not lines:
        return ""
    ratio = np.array([len(t) / max(1, g) for t, g, _, _, _ in lines])
    smooth = _smooth(ratio, how.sigma)
    chosen = smooth >= min(how.share_of_deviation * smooth.std(), smooth.max())
    links = np.array([linked >= how.link_share * len(t) for t, _, _, linked, _ in lines])
    if not links.all():
        chosen &= ~links
        chosen = chosen if chosen.any() else ~links
    paths = {c: _path(containers, c) for c in {x[2] for x in lines}}
    # a mark on what holds most of the clusters' text is a wrapper's look
    marks = {c: m for c, (_, _, m) in enumerate(containers) if m}
    total = sum(len(x[0]) for x, ok in zip(lines, chosen, strict=True) if ok)
    held: dict[int, int] = {}
    for (t, _, c, _, _), ok in zip(lines, chosen, strict=True):
        if ok:
            for x in paths[c]:
                if x in marks:
                    held[x] = held.get(x, 0) + len(t)
    marks = {c: m for c, m in marks.items() if m == "readers" or c not in parser.headed or 2 * held.get(c, 0) <= total}
    plain = [not b and not any(x in marks for x in paths[c]) for _, _, c, _, b in lines]
    if not any(ok and p for ok, p in zip(chosen, plain, strict=True)):
        plain = [True] * len(lines)
    # the smallest container that holds every line of the clusters; parts of lists, tables and quotes are never all of a text
    own = [paths[x[2]] for x, ok, p in zip(lines, chosen, plain, strict=True) if ok and p]
    region = 0
    for at in zip(*own, strict=False):
        if len(set(at)) > 1 or containers[at[0]][1] in PARTS:
            break
        region = at[0]
    # containers that no cluster reaches, nearly all links
    size: dict[int, list[int]] = {}
    for (t, _, c, linked, _), ok in zip(lines, chosen, strict=True):
        for x in paths[c]:
            if x != region:
                n = size.setdefault(x, [0, 0, 0])
                n[0] += len(t)
                n[1] += linked
                n[2] += bool(ok)
    menus = {x for x, (n, linked, ok) in size.items() if not ok and linked >= how.link_share * n}
    return "\n".join(t for (t, _, c, _, _), p in zip(lines, plain, strict=True) if p and region in paths[c] and not menus.intersection(paths[c][paths[c].index(region) + 1 :]))


def extract(pages: DataFrame, how: Ratios = Ratios()) -> DataFrame:
    """(page_id, url, text, n_chars) per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_chunks(batches, "html"):
            found = [main_text(t.decode("utf-8", "replace"), how) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], schema=SCHEMA)

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html")), run, SCHEMA)
