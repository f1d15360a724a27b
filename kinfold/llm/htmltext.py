"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser turns a page into lines, one for each block of text. A line's ratio is its number of
characters outside links over its number of tags, FULL at most, as longer lines are no surer to be prose. Weak
signals scale it: PRAISE times more inside an article or main element, BLAME times less for each enclosing element
whose class or id reads like furniture. Ratios are only compared within a page, so a wrapper with a misleading name
changes nothing. What HTML itself names as furniture (nav, footer, aside, form and their like, roles, hidden
elements) is left out.

The ratios are smoothed by a Gaussian along the page. The threshold is the smoothed ratios' standard deviation, or
a share of their mean by character if that is more; lines from there on form the content cluster. Regions are chosen by it:
a container (div, section, list, table and so on) is content if a third of its characters is in the cluster and its
lines' ratios, own and smoothed, reach the threshold on average, so neither a long line among links nor an advert beside the article
comes in. With a content container comes its article or main element, if it has one. Of a region all lines stay,
short ones too, but for nested containers that are no content themselves and look like furniture by name or, outside
article and main, by their links. Between content containers without such an element, other containers of their
nearest common one stay by the same rule, as do headings right before the first content line.

Null or empty html has an empty text, as has a page without any prose outside furniture. Time and memory are linear
in one page, however deeply it nests. Repeated rows give repeated results; extra columns are ignored, and columns to
keep may have any name but that of the result, text, which raises an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship_by_value

# Elements of the HTML standard by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title textarea select option button iframe object svg math canvas audio video datalist".split())
FURNITURE = set("nav footer aside form menu dialog fieldset search".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold one line or a part of a table or list; the others are containers.
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SOFT = set("p li td th dd dt".split())
PARTS = SOFT | HEADINGS | set("tr tbody thead tfoot summary legend figcaption address".split())
DECLARED = {"article", "main"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: A word of a class or id that hints at furniture.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|nav\w*|menu|breadcrumbs?|sidebar|side|widget|related|recommend\w*|share|sharing|social|comments?|respons?es?|replies|reply|disqus|footer|header|masthead|copyright|pagination|pager|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
#: Reach of the Gaussian in lines; the ratio that counts as full; the share of the mean that is needed; the factors of weak signals, and how often marks count.
SIGMA, RADIUS, FULL, SHARE, PRAISE, BLAME, MOST_MARKS = 1.0, 3, 256.0, 0.65, 1.5, 16.0, 2
ROOT = 0


class Container:
    """An element that holds lines; parent is the number of the container around it."""

    __slots__ = ("parent", "marks", "declared")

    def __init__(self, parent: int, marks: int, declared: int) -> None:
        self.parent, self.marks, self.declared = parent, marks, declared  # declared: its article or main, -1 if none


class Line:
    __slots__ = ("text", "tags", "link_chars", "container", "marks", "heading")

    def __init__(self, container: int, marks: int, heading: bool) -> None:
        self.text, self.tags, self.link_chars, self.container, self.marks, self.heading = [], 0, 0, container, marks, heading


class Open:
    """An open element and what holds within it."""

    __slots__ = ("name", "container", "furniture", "hidden", "marks", "heading")

    def __init__(self, name: str, container: int, furniture: bool, hidden: bool, marks: int, heading: bool) -> None:
        self.name, self.container, self.furniture, self.hidden, self.marks, self.heading = name, container, furniture, hidden, marks, heading


class LineParser(HTMLParser):
    """Gathers lines and containers. Depths of open elements are kept by name, so that no event walks the stack."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Open("html", ROOT, False, False, 0, False)]
        self.depths: dict[str, list[int]] = {"html": [0]}
        self.blocks, self.hard = [0], [0]  # depths of open blocks, and of those that are no p, li or cell
        self.containers = [Container(-1, 0, -1)]
        self.lines: list[Line] = []
        self.line: Line | None = None
        self.pending_tags = 0

    def _depth(self, name: str) -> int:
        depths = self.depths.get(name)
        return depths[-1] if depths else -1

    def _push(self, element: Open) -> None:
        depth, name = len(self.open), element.name
        self.open.append(element)
        self.depths.setdefault(name, []).append(depth)
        if name in BLOCK:
            self.blocks.append(depth)
            if name not in SOFT:
                self.hard.append(depth)

    def _drop(self, depth: int) -> None:
        """Close all elements from this depth on."""
        for element in self.open[depth:]:
            self.depths[element.name].pop()
        del self.open[depth:]
        for depths in (self.blocks, self.hard):
            while depths[-1] >= depth:
                depths.pop()

    def _break(self) -> None:
        self.line = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.pending_tags += 1
        if tag == "br":
            self._add(" ")
        if tag in VOID:
            if tag == "hr":
                self._break()
            return
        if tag in BLOCK:
            self._break()
            self._close_implied(tag)
        top = self.open[-1]
        container, furniture, hidden, marks = top.container, top.furniture, top.hidden or tag in HIDDEN, top.marks
        if tag in FURNITURE or tag == "header" and self.containers[container].declared < 0:
            furniture = True
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                hidden = True
            elif name == "role" and value and value.lower() in ROLES:
                furniture = True
            elif name in ("class", "id") and value and tag in BLOCK and tag not in HEADINGS and tag not in ("html", "body") and MARKS.search(value):
                marks = top.marks + 1
        if tag in BLOCK and tag not in PARTS:
            number = len(self.containers)
            self.containers.append(Container(container, marks, number if tag in DECLARED else self.containers[container].declared))
            container = number
        self._push(Open(tag, container, furniture, hidden, marks, top.heading or tag in HEADINGS))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, the slash counts on void elements only

    def _close_implied(self, tag: str) -> None:
        """A block element ends an open paragraph; list items, cells and rows end their like."""
        ends = CLOSED_BY.get(tag, set()) | {"p"}
        depth = max(map(self._depth, ends))
        # a row may be closed by a row, though rows end the search for others
        barrier = next((d for d in reversed(self.hard[-2:]) if self.open[d].name not in ends), 0)
        if depth > max(0, barrier):
            self._drop(depth)
            self._break()

    def handle_endtag(self, tag: str) -> None:
        self.pending_tags += 1
        depth = self._depth(tag)
        if tag in BLOCK:
            self._break()
            if depth > 0:
                self._drop(depth)
        elif depth > self.blocks[-1]:
            self._drop(depth)  # inline elements left open within it end with it

    def handle_data(self, data: str) -> None:
        self._add(data)

    def _add(self, data: str) -> None:
        top = self.open[-1]
        if top.hidden or top.furniture or not data:
            return
        if self.line is None:
            if data.isspace():
                return
            self.line = Line(top.container, top.marks, top.heading)
            self.lines.append(self.line)
        self.line.text.append(data)
        self.line.tags += self.pending_tags
        self.pending_tags = 0
        if self.depths.get("a"):
            self.line.link_chars += len(data)


def smooth(ratios: np.ndarray) -> np.ndarray:
    at = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(at**2) / (2 * SIGMA**2))
    return np.convolve(np.pad(ratios, RADIUS, mode="edge"), kernel / kernel.sum(), mode="valid")


def content_containers(lines: list[Line], own: np.ndarray, containers: list[Container]) -> np.ndarray:
    """A mask of the containers that the ratios choose; own: characters outside links of each line."""
    weight = np.array([(PRAISE if containers[line.container].declared >= 0 else 1.0) / BLAME ** min(line.marks, MOST_MARKS) for line in lines])
    ratios = np.minimum(own / np.array([max(1, line.tags) for line in lines]), FULL) * weight
    smoothed = smooth(ratios)
    threshold = max(float(smoothed.std()), float(np.average(smoothed, weights=own)) * SHARE)
    at = np.array([line.container for line in lines])
    total = lambda values: np.bincount(at, values, len(containers))
    mass, chosen, ratio = total(own), total(own * (smoothed >= threshold)), total(own * (ratios + smoothed) / 2)
    content = (mass > 0) & (3 * chosen >= mass) & (ratio >= threshold * mass)
    if not content.any():
        content = (mass > 0) & (ratio == ratio.max())
    return content


def kept_lines(lines: list[Line], own: np.ndarray, chars: np.ndarray, containers: list[Container]) -> np.ndarray:
    """A mask of the lines of the content regions."""
    content = content_containers(lines, own, containers)
    declared = np.array([c.declared for c in containers])
    region = np.arange(len(containers))[content]
    region = np.where(declared[region] >= 0, declared[region], region)
    root = np.full(len(containers), -1)  # the innermost region around each container, itself included
    root[region] = region
    free = np.zeros(len(containers), np.int64)  # number of regions without article or main within a container
    free[region[declared[region] < 0]] = 1
    several = int(free.sum())
    for n, c in enumerate(containers):
        if n and root[n] < 0:
            root[n] = root[c.parent]
    common = ROOT
    for n in range(len(containers) - 1, 0, -1):
        free[containers[n].parent] += free[n]
    if several > 1:
        common = max(n for n in range(len(containers)) if free[n] == several)
    between = np.zeros(len(containers), bool)  # within the nearest container of all regions without article or main
    between[common] = several > 1
    for n in range(common + 1, len(containers)):
        between[n] = between[containers[n].parent]
    in_links = np.zeros(len(containers))
    size = np.zeros(len(containers))
    for line, mass, length in zip(lines, own, chars, strict=True):
        size[line.container] += length
        in_links[line.container] += length - mass
    linked = 2 * in_links > size
    keep = np.zeros(len(lines), bool)
    sure = [i for i, line in enumerate(lines) if content[line.container]]
    first, last = sure[0], sure[-1]
    for i, line in enumerate(lines):
        c = line.container
        if content[c]:
            keep[i] = line.marks <= containers[c].marks
        elif root[c] >= 0:
            keep[i] = line.marks <= containers[root[c]].marks and (declared[c] >= 0 or not linked[c])
        elif between[c] and first < i < last:
            keep[i] = line.marks <= containers[common].marks and not linked[c]
    while first > 0 and lines[first - 1].heading and not lines[first - 1].marks:
        first -= 1
        keep[first] = True
    return keep


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    texts = [" ".join("".join(line.text).split()) for line in parser.lines]
    kept = [(line, text) for line, text in zip(parser.lines, texts, strict=True) if text]
    lines = [line for line, _ in kept]
    chars = np.array([len(text) for _, text in kept], float)
    own = np.maximum(0, chars - np.array([line.link_chars for line in lines], float)) if lines else chars
    if not own.any():
        return ""
    keep = kept_lines(lines, own, chars, parser.containers)
    return "\n\n".join(text for (_, text), k in zip(kept, keep, strict=True) if k)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id_col, the columns named in keep, and text."""
    names = [id_col, *keep]
    if "text" in names or len({n.lower() for n in names}) < len(names):
        raise ValueError(f"columns of the result: {[*names, 'text']}")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*names, "text"])

    rows = pages.select(*names, pages[html_col].alias("page source"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(extract, f"{kinds}, text string")


ship_by_value(__name__)
