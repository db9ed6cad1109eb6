"""Main text of web pages from parser events: text-to-tag ratios, smoothed and clustered, choose the content region.

A streaming standard-library parser turns a page into blocks, its lines: the text between two block-level tags, with the
number of tags inside. The logarithm of characters per tag of each block is smoothed with a Gaussian over the blocks of
the page, and a threshold halfway between the two means of the ratios (two clusters, fitted by turns) tells content
blocks from others. Runs of neighbouring content blocks are the content clusters; the region is the deepest element
around all clusters that hold a quarter of the largest one's text or more, or the ``article`` or ``main`` element that
holds more than half of all content text.

Of the region everything stays, short blocks too, but for
* menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, as elements or names say:
  a class, id or role all of whose parts are words of boilerplate and layout, with one of boilerplate among them;
* elements whose name only holds such a word (like side-effects), if less than half of their text is in blocks whose own
  ratio reaches the threshold; ids of paragraphs and headings are anchors and say nothing;
* if the region is no ``article`` or ``main``: containers without a heading before the first content block or behind the
  last one, if less than half of their text is in blocks whose own ratio reaches the threshold; and there, blocks of five
  tags or more whose ratio is below that of prose and the threshold.

An element that boilerplate is usually made of may also wrap a page, or stay open by mistake. Where no ``article`` or
``main`` is free of such elements, those around the one with most text don't count. Where there is none at all, a form,
fieldset, aside, dialog or menu, or an element that is never closed, doesn't count if it holds three quarters of the dense
text (blocks with ratios above the threshold and 30 characters a tag), nor does one whose name may stand for a part of the
layout (like search or header) if it holds nearly all; and the same goes for forms, fieldsets, dialogs and what is never
closed inside of an article, by the article's dense text.

Null html counts as empty. An empty page, or one without text, has empty text. Unclosed and stray tags are tolerated:
whatever can't stand in a head ends it; a comment that never ends is text; a tag that never ends is dropped up to the next
one, and one whose quotes never end ends at its first ``>``. ``<br>`` is white space inside its block. Time and memory grow
in proportion to the page, however deep it is nested or broken. Every row gives one row, repeated rows too; other columns
are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_rows, python_rows

#: Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br".split()
)
SILENT = frozenset("script style template noscript head title svg math iframe object canvas audio video".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
FIELDS = frozenset("button select textarea".split())
#: those whose content is no markup, those that may stand in a head, those that may wrap a page,
RAW = frozenset(("script", "style"))
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
WRAPPING = frozenset("form fieldset aside dialog menu".split())
FORMS = frozenset("form fieldset dialog".split())
CONTENT = frozenset(("article", "main"))
CLOSES = frozenset("p li dt dd tr td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold running text rather than other parts of a page.
LINES = HEADINGS | frozenset("p li dt dd tr td th pre blockquote figcaption caption address summary".split())
#: Words of class, id and role attributes that mark boilerplate,
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent notice notices "
    "alert gdpr sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus respond reply "
    "replies related recommended share sharing social newsletter subscribe signup popup modal overlay widget widgets toolbar pagination pager "
    "complementary contentinfo search".split()
)
#: those of them that also do on an article or main element,
OF_ARTICLES = frozenset("ad ads advert adverts advertisement sponsored promo comment comments respond reply replies related recommended".split())
#: those that an id inside of an article or main element marks,
INSIDE = OF_ARTICLES | frozenset("disqus cookie cookies newsletter sidebar".split())
#: those that mark nothing inside of one, where it has a head of its own,
HEADS = frozenset(("header", "masthead"))
#: those that may name a part of the layout around a whole page,
AROUND = frozenset("search side sidebar header masthead banner menu modal overlay popup widget widgets toolbar complementary".split())
#: and words of layout that may stand beside them.
LAYOUT = frozenset(
    "area articles bar block bottom box btn button buttons center class col column container content desktop entry fixed form frame global google "
    "group holder icons id inner item items left link links list main mobile module news outer page panel post posts primary region right row "
    "secondary section site slot space sticky stories tag text title top unit wrap wrapper zone".split()
)
PARTS = re.compile(r"[^\W_]+")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


#: Logarithm of a ratio between ratios that doesn't tell content from anything else.
ALIKE = math.log(1.5)


#: Logarithm of the ratio of prose, at least; and shares of the dense text that a wrapper holds.
PROSE = math.log1p(30)
MOST, NEARLY_ALL = 0.75, 0.95
#: Tags of a block that is a line of links.
LINKS = 5


class Node:
    """An element that is or was open.

    mark: 0, 1 if it is boilerplate unless it wraps the page, 2 if it is in any case.
    """

    __slots__ = ("name", "parent", "at", "mark", "doubtful", "inside", "closed")

    def __init__(self, name: str, parent: Node | None, at: int, mark: int, doubtful: bool) -> None:
        self.name, self.parent, self.at, self.mark, self.doubtful = name, parent, at, mark, doubtful
        self.inside = name in CONTENT or (parent is not None and parent.inside)
        self.closed = False


def told(value: str, marks: frozenset[str]) -> tuple[int, bool]:
    """How far a name of the attribute value marks boilerplate, and whether one only holds such a word."""
    sure, maybe = 0, False
    for name in value.lower().split():
        parts = [p for p in PARTS.findall(name) if not p.isdigit()]
        if not marks.isdisjoint(parts):
            if all(p in MARKS or p in LAYOUT for p in parts):
                sure = max(sure, 1 if AROUND.issuperset(marks.intersection(parts)) else 2)
            else:
                maybe = True
    return sure, maybe


STOP = re.compile(r"=\s*+[\"']|>")
COMMENT_END = re.compile(r"--\s*+>")
TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)|<[!?/]")


def finished(html: str) -> str:
    """``html`` without markup that never ends, in one sweep: what is left has an end wherever it begins."""
    out: list[str] = []
    kept, at, last = 0, 0, html.rfind(">")
    comments, strict, quotes = True, True, {'"': html.rfind('"'), "'": html.rfind("'")}
    while (i := html.find("<", at)) >= 0:
        tag = TAG.match(html, i)
        if tag is None:
            at = i + 1
        elif html.startswith("<!--", i):
            end = COMMENT_END.search(html, i + 4) if comments else None
            if end:
                at = end.end()
            else:
                comments = False
                out.append(html[kept:i])
                kept = at = i + 4
        elif i > last:
            out.append(html[kept:i])
            at = html.find("<", i + 1)
            kept = at = len(html) if at < 0 else at
        else:
            at, open_quote = i + 1, False
            while strict:
                stop = STOP.search(html, at)
                if stop is None:
                    strict = False
                elif stop[0] == ">":
                    at = stop.end()
                    break
                else:
                    quote = stop[0][-1]
                    at = stop.end()
                    if quotes[quote] >= at:
                        at = html.find(quote, at) + 1
                    else:
                        open_quote = True
            if not strict or open_quote:
                at = html.find(">", i) + 1
                out += [html[kept:i], html[i:at].replace('"', "").replace("'", "")]
                kept = at
            name = (tag[1] or "").lower()
            if name in RAW and html[i + 1] != "/":
                end = re.compile(f"</{name}", re.IGNORECASE).search(html, at)
                at = end.start() if end else len(html)
    out.append(html[kept:])
    return "".join(out)


class Blocks(HTMLParser):
    """Collects (node, text, tags) for every block of a page, and its elements in the order in which they open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.node = Node("", None, 0, 0, False)
        self.nodes = [self.node]
        self.open: Counter[str] = Counter()
        self.found: list[tuple[Node, str, int]] = []
        self.parts: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.found.append((self.node, text, self.tags))
        self.parts, self.tags = [], 0

    def push(self, tag: str, mark: int, maybe: bool) -> None:
        self.node = Node(tag, self.node, len(self.nodes), mark, maybe)
        self.nodes.append(self.node)
        self.open[tag] += 1

    def pop(self) -> None:
        self.open[self.node.name] -= 1
        self.node = self.node.parent

    def leave_head(self) -> None:
        self.flush()
        while self.open["head"]:
            self.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.node.name == "title":
            self.flush()
            self.pop()
        if self.open["head"] and (tag == "body" or (self.node.name == "head" and tag not in IN_HEAD)):
            self.leave_head()
        if tag in INLINE:
            self.tags += 1
            if tag == "br":
                self.parts.append(" ")
            if tag in VOID:
                return
            if self.marks(tag, attrs)[0]:
                self.flush()
                self.push(tag, self.marks(tag, attrs)[0], False)
            elif self.open[tag]:
                # Inside of a marked one of its name; else its end would be taken for the other's.
                self.push(tag, 0, False)
            return
        self.flush()
        if tag in VOID:
            return
        self.tags += 1
        if tag in CLOSES and self.node.name == tag:
            self.pop()
        self.push(tag, *self.marks(tag, attrs))

    def marks(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, bool]:
        inside = self.node.inside
        if tag in SILENT or tag in FIELDS:
            return 2, False
        if tag in ("body", "html"):
            return 0, False
        mark, doubt = int(tag in BOILERPLATE or (tag == "header" and not inside)), False
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and HIDDEN.search(v)):
                return 2, False
            if not v or k not in ("class", "id", "role", "aria-label") or (k == "id" and tag in LINES):
                continue
            among = OF_ARTICLES if tag in CONTENT else MARKS - HEADS if inside else MARKS
            sure, maybe = told(v, among)
            if sure and k == "id" and inside:
                sure = told(v, INSIDE)[0]
                maybe = True
            mark = max(mark, sure)
            doubt = doubt or (maybe and tag not in LINES and tag not in CONTENT)
        return mark, doubt and not mark

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            if tag not in INLINE:
                self.flush()
            return
        self.flush()
        while self.node.name != tag:
            self.pop()
        self.node.closed = True
        self.pop()

    def handle_data(self, data: str) -> None:
        if self.node.name == "head" and not data.isspace():
            self.leave_head()
        if self.node.name not in RAW and self.node.name != "title":
            self.parts.append(data)

    def done(self) -> list[tuple[Node, str, int]]:
        self.close()
        self.flush()
        return self.found


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; at the ends over the part of the kernel that lies inside."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(reach + 1)]
    out = []
    for at in range(len(values)):
        total = weight = 0.0
        for i in range(max(0, at - reach), min(len(values), at + reach + 1)):
            k = kernel[abs(i - at)]
            total += k * values[i]
            weight += k
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Halfway between the means of the two clusters of ``values``; not above any if the clusters are less than ``ALIKE`` apart."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        under = [v for v in values if v < cut]
        over = [v for v in values if v >= cut]
        if not under:
            return min(values)
        means = sum(under) / len(under), sum(over) / len(over)
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2 if high - low >= ALIKE else min(values)


def sums(nodes: list[Node], own: dict[int, int]) -> list[int]:
    """For every element the sum of ``own`` over itself and all inside."""
    out = [0] * len(nodes)
    for at, n in own.items():
        out[at] = n
    for node in reversed(nodes):
        if node.parent:
            out[node.parent.at] += out[node.at]
    return out


def left_out(blocks: list[tuple[Node, str, int]], nodes: list[Node], sigma: float) -> list[bool]:
    """For every element whether it is boilerplate or lies in some, but for elements that wrap the page."""
    firm, loose = [False] * len(nodes), [False] * len(nodes)
    for node in nodes[1:]:
        mark = node.mark if node.closed or node.mark < 2 or node.name in RAW or node.name == "title" else 1
        firm[node.at] = firm[node.parent.at] or mark == 2
        loose[node.at] = loose[node.parent.at] or mark > 0
    if loose == firm:
        return firm
    text = Counter()
    for node, said, _ in blocks:
        text[node.at] += 0 if firm[node.at] else len(said)
    text = sums(nodes, text)
    articles = [n for n in nodes if n.name in CONTENT and text[n.at]]
    free = [n for n in articles if not loose[n.at]]
    wraps = set()
    if articles and not free:
        node = max(articles, key=lambda n: text[n.at])
        while node.parent:
            wraps.add(node.at)
            node = node.parent
    else:
        # Inside of the article with most text, or of the page.
        scope = max(free, key=lambda n: text[n.at]) if free else nodes[0]
        within = [False] * len(nodes)
        for node in nodes[scope.at :]:
            within[node.at] = node is scope or (node.parent is not None and within[node.parent.at])
        seen = [(node, len(said), math.log1p(len(said) / max(1, tags))) for node, said, tags in blocks if within[node.at] and not firm[node.at]]
        cut = max(PROSE, threshold(smoothed([r for _, _, r in seen], sigma))) if seen else PROSE
        dense = Counter()
        for node, n, r in seen:
            dense[node.at] += n * (r >= cut)
        whole = max(1, sum(dense.values()))
        dense = sums(nodes, dense)
        for node in nodes[1:]:
            likely = not node.closed or node.name in (FORMS if free else WRAPPING)
            if node.mark and within[node.at] and not firm[node.at] and (likely or not (free or node.name in BOILERPLATE)):
                if dense[node.at] >= (MOST if likely else NEARLY_ALL) * whole:
                    wraps.add(node.at)
    out = [False] * len(nodes)
    for node in nodes[1:]:
        out[node.at] = out[node.parent.at] or firm[node.at] or (node.mark > 0 and node.at not in wraps)
    return out


def content_blocks(blocks: list[tuple[Node, str, int]], nodes: list[Node], sigma: float, part: float) -> list[str]:
    """Texts of the main region."""
    out = left_out(blocks, nodes, sigma)
    kept = [b for b in blocks if not out[b[0].at]]
    if not kept:
        return []
    # Logarithms keep one very long block from raising the threshold above all others.
    own = [math.log1p(len(text) / max(1, tags)) for _, text, tags in kept]
    ratios = smoothed(own, sigma)
    cut = threshold(ratios)
    content = [r >= cut for r in ratios]

    # Elements with a doubtful name stay if their own lines look like content.
    size, dense = Counter(), Counter()
    for (node, text, _), r in zip(kept, own, strict=True):
        size[node.at] += len(text)
        dense[node.at] += len(text) * (r >= cut)
    size, dense = sums(nodes, size), sums(nodes, dense)
    gone = [False] * len(nodes)
    for node in nodes[1:]:
        gone[node.at] = gone[node.parent.at] or (node.doubtful and 2 * dense[node.at] < size[node.at])

    # Clusters of neighbouring content blocks, by their text.
    runs: list[list[int]] = []
    for i, good in enumerate(content):
        if good and not gone[kept[i][0].at]:
            if runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
    if not runs:
        return [text for node, text, _ in kept if not gone[node.at]]
    mass = [sum(len(kept[i][1]) for i in run) for run in runs]
    core = [i for run, m in zip(runs, mass, strict=True) if m >= part * max(mass) for i in run]
    text_in = Counter()
    for run in runs:
        for i in run:
            text_in[kept[i][0].at] += len(kept[i][1])
    text_in = sums(nodes, text_in)
    marked = [n for n in nodes if n.name in CONTENT and 2 * text_in[n.at] > sum(mass)]
    if marked:
        region = marked[-1]
    else:
        count = sums(nodes, Counter(kept[i][0].at for i in core))
        region = next(n for n in reversed(nodes) if count[n.at] == len(core))
        while region.name in LINES or region.name in INLINE:
            region = region.parent

    # Parts of other regions that lie before or behind all content. Smoothing carries content over to its neighbours, so
    # the content ends with a block whose own ratio reaches the threshold.
    sure = [i for run in runs for i in run if own[i] >= cut] or [runs[0][0], runs[-1][-1]]
    first, last = sure[0], sure[-1]
    heads = sums(nodes, Counter(node.at for node, _, _ in kept if node.name in HEADINGS))
    in_region, idle = [False] * len(nodes), [False] * len(nodes)
    for node in nodes[region.at :]:
        if node is region:
            in_region[node.at] = True
        elif node.parent and in_region[node.parent.at]:
            in_region[node.at] = True
            bare = node.name not in LINES and node.name not in INLINE and 2 * dense[node.at] < size[node.at] and not heads[node.at]
            idle[node.at] = idle[node.parent.at] or (bare and region.name not in CONTENT)
    marks = region.name not in CONTENT
    return [
        text
        for i, (node, text, tags) in enumerate(kept)
        if in_region[node.at]
        and not gone[node.at]
        and (first <= i <= last or not (idle[node.at] or (marks and tags >= LINKS and own[i] < min(cut, PROSE) and node.name not in HEADINGS)))
    ]


def main_text(html: str, sigma: float = 1.0, part: float = 0.25) -> str:
    """The main text of one page, its blocks joined by line breaks.

    Clusters with ``part`` of the largest one's text or more make the region.
    """
    parser = Blocks()
    parser.feed(finished(html))
    return "\n".join(content_blocks(parser.done(), parser.nodes, sigma, part))


def extract_main_text(pages: DataFrame, sigma: float = 1.0, part: float = 0.25) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, in one pass without a shuffle."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in python_rows(batches):
            yield arrow_rows([(page_id, url, main_text(html, sigma, part)) for page_id, url, html in rows], TEXTS)

    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    return (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html)
        .mapInArrow(extract, "page_id long, url string, text string")
        .withColumn("n_chars", F.char_length("text").cast("long"))
    )
