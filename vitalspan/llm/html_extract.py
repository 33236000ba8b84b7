"""Main text of web pages by minimum cut.

A page becomes a row of blocks of text. A classifier over what each block looks like (its words, links and punctuation)
gives log-odds, to which the marks that the page's author left (sectioning elements, words in a class or id)
add theirs; the sum is the capacity of the block's edge to one of two terminals, content and boilerplate. Smoothness
edges tie blocks that follow each other, the more the closer they are in the tree of elements, and blocks that share a
parent. The minimum cut, found by maximum flow, is the cheapest labelling of all blocks at once: a short line amid an
article stays, one amid links goes.

The classifier is fitted on a bounded sample of the pages themselves. Its labels are the authors': what stands in an
article or main is content, what stands in a nav, footer, aside, form or the like is not, and neither mark is an input.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import logistic

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title".split())
UNREAD = frozenset("head template noscript svg math iframe object canvas audio video select datalist".split())
BESIDE = frozenset("nav footer aside form fieldset menu dialog button option".split())
ARTICLE = frozenset("article main".split())
LEAVES = HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption caption".split())
CLOSES = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "option": ["option"]}
BARRIERS = "ul ol dl table select article section div".split()
#: Words in a class, id, role or label that name what stands beside a text, and those that name the text.
NAMES_BESIDE = frozenset("ad ads advert advertisement sponsored promo banner cookie consent notice popup modal newsletter subscribe share social sidebar related recommended widget search menu nav navbar navigation breadcrumb breadcrumbs pagination header footer comment comments reply replies".split())
NAMES_TEXT = frozenset("article content story entry post main".split())

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
TAG_STOP = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
STOPS = re.compile(r"[.,;:!?…。，！？]")
SENTENCE = ".!?…。！？»”\"'"

#: Log-odds, in units: what a text looks like counts this much at most; a mark beside the text; article or main; a name of the text.
UNIT, LOOKS, BESIDE_MARK, ARTICLE_MARK, TEXT_MARK = 64, 3.0, 8.0, 2.9, 0.5
#: Smoothness: blocks that follow each other (a heading binds to what follows it), by one more than the steps between them in the tree, and blocks of one parent.
ADJACENT, HEADED, SIBLING = 3.0, 5.0, 1.0
#: Pages and blocks of each that the classifier is fitted on, at most.
FIT_PAGES, FIT_BLOCKS = 400, 60

FEATURES = ("words", "linked", "sentence", "stops")
#: What looks say where the sample has no marks of either kind, set by hand: long texts with stops and without links are content.
DEFAULT = ((1.2, -6.0, 0.5, 1.0), -3.0)
Model = tuple[tuple[float, ...], float]


class Element:
    __slots__ = ("tag", "parent", "depth", "article", "bad", "good", "mark", "body", "linked", "block")

    def __init__(self, tag: str, parent: "Element | None", attributes: str):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.article = bool(parent and parent.article) or tag in ARTICLE
        self.bad, self.good = bool(parent and parent.bad), bool(parent and parent.good)
        # The nearest element whose class or id marks it as beside the text, and the outermost article or main without such a mark.
        self.mark, self.body = parent.mark if parent else None, parent.body if parent else None
        inline = tag in INLINE and parent is not None
        self.linked, self.block = inline and (tag == "a" or parent.linked), parent.block if inline else self
        if tag in BESIDE or tag == "header" and not self.article:
            self.bad = True
        if attributes and tag not in ("html", "body"):
            self._named(tag, attributes)
        if self.body is None and tag in ARTICLE and not self.bad and self.mark is not self:
            self.body = self

    def _named(self, tag: str, attributes: str) -> None:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
                self.bad = True
            elif name in ("class", "id", "role", "aria-label"):
                words = set(WORDS.findall(value))
                if words & NAMES_BESIDE and not (tag in ARTICLE and words & NAMES_TEXT and not words & {"comment", "comments", "reply"}):
                    if name in ("class", "id"):
                        self.mark = self
                    else:
                        self.bad = True
                elif words & NAMES_TEXT:
                    self.good = True


class Block:
    __slots__ = ("text", "element", "linked", "words", "stops")

    def __init__(self, text: str, element: Element, linked: float):
        self.text, self.element, self.linked = text, element, linked
        self.words, self.stops = text.count(" ") + 1, len(STOPS.findall(text))


class Parser:
    """One pass over a page; every step moves on in the page or takes an element off the stack, so the time is linear."""

    def __init__(self, page: str):
        self.page, self.out = page, []
        self.stack = [Element("html", None, "")]
        self.open: dict[str, list[int]] = {}  # tag -> places in the stack
        self.solid = [0]  # places of elements that aren't inline
        self.unread = 0
        self.run: list[str] = []
        self.size = self.linked = 0
        self.quotes = True

    def text(self, start: int, end: int) -> None:
        if end > start and not self.unread:
            self.run.append(self.page[start:end])
            self.size += end - start
            if self.stack[-1].linked:
                self.linked += end - start

    def close_block(self) -> None:
        if self.run:
            words = decoded("".join(self.run)).split()
            if words:
                self.out.append(Block(" ".join(words), self.stack[-1].block, self.linked / self.size))
            self.run, self.size, self.linked = [], 0, 0

    def push(self, tag: str, attributes: str) -> None:
        e = Element(tag, self.stack[-1], attributes)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.solid.append(len(self.stack))
        self.unread += tag in UNREAD
        self.stack.append(e)

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.open[tag].pop()
            if tag not in INLINE:
                self.solid.pop()
            self.unread -= tag in UNREAD

    def last(self, tags: list[str]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def tag_end(self, at: int) -> int:
        """The place of the > that ends the tag, quoted ones left out; -1 without one. A quote that is never closed stops quoting for good."""
        if self.quotes:
            while m := TAG_STOP.search(self.page, at):
                if m[0] == ">":
                    return m.start()
                at = self.page.find(m[0], m.end()) + 1
                if not at:
                    break
            self.quotes = False
            return -2
        return self.page.find(">", at)

    def blocks(self) -> list[Block]:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                break
            self.text(at, lt)
            at = lt
            follows = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if follows in ("!", "?"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            closing = follows == "/"
            name = NAME.match(page, lt + 1 + closing)
            if not name:
                self.text(lt, lt + 1)
                at = lt + 1
                continue
            end = self.tag_end(name.end())
            if end == -2:
                end = self.tag_end(name.end())
            if end < 0:  # no tag ends any more: nothing but text, without the tag that isn't one
                self.text(lt, n)
                at = n
                break
            tag, attributes, at = name[0].lower(), page[name.end() : end], end + 1
            if tag in RAW and not closing:
                over = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                at = over.end() if over else n
                continue
            self.tag(tag, attributes, closing)
        self.text(at, n)
        self.close_block()
        return self.out

    def tag(self, tag: str, attributes: str, closing: bool) -> None:
        if tag == "br":
            if not self.unread:
                self.run.append(" ")
                self.size += 1
            return
        if tag not in INLINE:
            self.close_block()
        if closing:
            place = self.last([tag])
            if place and (tag not in INLINE or place > self.solid[-1]):
                self.pop_to(place)
            return
        if tag in VOID or tag == "html":
            return
        if tag not in INLINE and ((e := self.stack[-1].block).tag == "p" or e.tag in HEADINGS):
            self.pop_to(self.solid[-1])
        if tag in CLOSES and (place := self.last(CLOSES[tag])) > self.last(BARRIERS):
            self.pop_to(place)
        if attributes.endswith("/") and tag not in INLINE:
            return
        self.push(tag, attributes)


def decoded(text: str) -> str:
    """Character references decoded; numbers too long for a character are none."""
    if "&#" in text:
        text = re.sub(r"&#0+(?=[0-9])", "&#", re.sub(r"&#([xX])0+(?=[0-9a-fA-F])", r"&#\1", text))
        text = re.sub(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?", "\ufffd", text)
    return html.unescape(text)


def blocks(page: str) -> list[Block]:
    """Runs of text between block-level tags, in page order, with references decoded and white space as one space."""
    return Parser(page).blocks()


def wrappers(found: list[Block]) -> set[Element]:
    """Elements whose class or id speaks of what stands beside the text (`has-sidebar`) and not of what they hold: each holds
    all articles and mains of the page, which have at least as much text as the unmarked blocks outside of them."""
    inside = [b for b in found if b.element.body and not b.element.bad]
    outside = sum(len(b.text) for b in found if not (b.element.body or b.element.bad or b.element.mark))
    if not inside or sum(len(b.text) for b in inside) < outside:
        return set()

    def around(b: Block) -> set[Element]:
        out, m = set(), b.element.body.mark
        while m:
            out.add(m)
            m = m.parent.mark
        return out

    return around(inside[0]) & around(inside[-1])  # what holds the first and the last holds all


def looks(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block: its text alone, nothing that an author's markup says. Neighbours are the cut's business."""
    return np.array([(math.log1p(b.words), b.linked, b.words > 2 and b.text[-1] in SENTENCE, b.stops / b.words) for b in found], float).reshape(-1, len(FEATURES))


def evidence(found: list[Block], model: Model) -> list[int]:
    """For content if positive, in units. The marks of wrappers end at the articles in them."""
    wraps = wrappers(found)
    slopes, offset = model
    seen = np.clip(looks(found) @ np.array(slopes) + offset, -LOOKS, LOOKS)
    out = []
    for b, x in zip(found, seen.tolist(), strict=True):
        e = b.element
        x += ARTICLE_MARK * e.article + TEXT_MARK * e.good
        if e.bad or e.mark and not (e.body and e.mark is e.body.mark and e.mark in wraps):
            x -= BESIDE_MARK
        out.append(round(UNIT * x))
    return out


def steps(a: Element, b: Element) -> int:
    """Edges between two elements in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def ties(found: list[Block]) -> list[tuple[int, int, int]]:
    """The smoothness edges (block, later block, capacity in units)."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            before = found[i - 1].element
            out.append((i - 1, i, round(UNIT * (HEADED if before.tag in HEADINGS else ADJACENT) / (1 + steps(before, b.element)))))
        parent = id(b.element.parent if b.element.tag in LEAVES else b.element)  # loose text belongs to what is around it
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, round(UNIT * SIBLING)))
        last[parent] = i
    return out


class Cut:
    """Maximum flow by levels and blocking flows; terminals are the two nodes after the others."""

    def __init__(self, n: int):
        self.source, self.sink = n, n + 1
        self.out: list[list[int]] = [[] for _ in range(n + 2)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, there: int, back: int) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [there, back]

    def _levels(self) -> list[int]:
        level = [-1] * len(self.out)
        level[self.source], queue = 0, deque([self.source])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def side(self) -> list[bool]:
        """Whether each node is on the source's side of a minimum cut."""
        while True:
            level = self._levels()
            if level[self.sink] < 0:
                return [x >= 0 for x in level[: self.source]]
            at = [0] * len(self.out)
            path: list[int] = []
            a = self.source
            while True:
                if a == self.sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    k = next(i for i, e in enumerate(path) if self.room[e] == 0)
                    a = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while at[a] < len(self.out[a]):
                    e = self.out[a][at[a]]
                    if self.room[e] > 0 and level[self.to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(self.out[a]):
                    path.append(self.out[a][at[a]])
                    a = self.to[path[-1]]
                elif a == self.source:
                    break
                else:
                    e = path.pop()
                    a = self.to[e ^ 1]
                    at[a] += 1


def labelled(found: list[Block], model: Model = DEFAULT) -> list[bool]:
    """True for content: the minimum cut of the page's blocks."""
    signs = evidence(found, model)
    if all(x > 0 for x in signs) or all(x <= 0 for x in signs):
        return [x > 0 for x in signs]  # the terminals on one side have no edges, so the cut is empty
    cut = Cut(len(found))
    for i, x in enumerate(signs):
        if x > 0:
            cut.edge(cut.source, i, x, 0)
        else:
            cut.edge(i, cut.sink, -x, 0)
    for i, j, weight in ties(found):
        cut.edge(i, j, weight, weight)
    return cut.side()


def main_text(page: str | None, model: Model = DEFAULT) -> str:
    """The content blocks joined by blank lines; empty if there is none."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, content in zip(found, labelled(found, model), strict=True) if content)


def author_says(b: Block) -> int | None:
    """1 in an article or main, 0 in an element that stands beside the text, None where no element says."""
    e = b.element
    return 0 if e.bad else 1 if e.article and not e.mark else None


def fit(pages: DataFrame, page: str = "page_id", url: str = "url", source: str = "html") -> Model:
    """The classifier of looks, from FIT_PAGES distinct pages at most (in order of a hash of all three columns) and FIT_BLOCKS
    blocks of each (evenly spread) that an author's element labels. DEFAULT without labels of both kinds."""
    rows = pages.select(F.xxhash64(page, url, source).alias("h"), F.col(source).alias("t"))
    highest = rows.select("h").distinct().orderBy("h").limit(FIT_PAGES).agg(F.max("h")).first()[0]
    if highest is None:
        return DEFAULT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = blocks(t.as_py() or "")
                x, y = looks(found), [author_says(b) for b in found]
                at = [i for i, v in enumerate(y) if v is not None]
                at = at[:: -(-len(at) // FIT_BLOCKS) or 1]
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([y[i] for i in at], pa.int64()), pa.array(x[at].tolist(), pa.list_(pa.float64()))], names=["h", "i", "y", "x"])

    sample = rows.filter(F.col("h") <= highest).dropDuplicates(["h"])
    got = sorted(sample.mapInArrow(run, "h long, i long, y long, x array<double>").collect(), key=lambda r: (r["h"], r["i"]))
    y = np.array([r["y"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return DEFAULT
    return logistic(np.array([r["x"] for r in got]), y, np.ones(len(y)))


def extract_pages(pages: DataFrame, page: str = "page_id", url: str = "url", source: str = "html", model: Model | None = None) -> DataFrame:
    """page, url, text and n_chars (code points) of every row. No shuffle of pages; without a model, one is fitted first.

    Null and empty pages, and pages without content, have an empty text. Pages of any length are cut whole. Rows are
    independent of each other: repeated rows get equal texts, ids and urls may be null. An empty table gives no rows; other
    columns are ignored."""
    model = model or fit(pages, page, url, source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[page, url, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(page, url, source).mapInArrow(run, f"`{page}` {kinds[page]}, `{url}` {kinds[url]}, text string, n_chars long")
