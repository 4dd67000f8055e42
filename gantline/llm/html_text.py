"""Main text of web pages by tag-path ratios.

A page is read once as a stream of tags and text, into elements that know their parents, so that time and
memory follow its length, however deep it is. Every text node has its root-to-leaf tag path; for each path,
characters, punctuation and nodes are added up. A path's length ratio (characters a node) and punctuation
ratio (marks a node) are smoothed over the page's order of nodes and fused by product, less the share of
links; nodes of paths over the threshold are content. Words in class, id and role that only hint at
furniture make a path's score smaller. Forms, and elements whose words tell furniture, aren't content unless
they hold most of the high-ratio text of the element around them, as a wrapper of the article does. The
smallest element around the best path then brings in its short neighbours (a heading, a list of links).

Defined results: null or empty html, and html without content, give an empty text; nothing is cut off, so
very long pages come whole; unclosed, stray and half-written tags are read as browsers do; repeated rows
are read each; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard: elements without content, with content that is no markup of the page, and those that make a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag of the key closes these, up to a scope.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
SCOPES = frozenset("table ul ol dl select html body template article section main div".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark math q s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text: the words of inline elements in them (code, marks) tell nothing about the page.
RUNNING = HEADINGS | frozenset("p li dd dt pre blockquote figcaption td th".split())
MAIN = frozenset("article main".split())
#: Never shown, whatever stands in them.
UNSHOWN = RAW | frozenset("head annotation annotation-xml".split())

#: Page furniture by element. A form is told by the text it holds, as it may stand around the whole page.
FURNITURE = frozenset("nav footer aside menu button select dialog header".split())
#: Words in class, id and role that tell furniture, and those that only make it likelier.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements adsense breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright disqus footer masthead menu modal nav navbar "
    "navigation newsletter notice pagination pager popup promo promoted related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
WEAK = frozenset("banner header search tags".split())
HINTS = STRONG | WEAK
#: What a weak word leaves of a score.
WEAKENED = 0.25
#: Parts of class words that may follow a hint in it (comment-list), and those that make it a state of the page (has-sidebar).
PARTS = frozenset("area bar block blocks body bottom box button buttons col column container content form group holder icon icons inner inline item items left link links list main menu module outer panel posts right row section text title top unit wrap wrapper".split())
STATES = frozenset("has have hide hides is js no not show shows with without".split())
#: A form, or an element whose words tell furniture, with more than this share of the high-ratio text around it is no furniture,
WRAPS = 2 / 3
#: unless so many blocks of prose, or so many characters of it, stand beside it: then they are the page's content, however much longer it is. What holds the page's first h1 stays even so.
PROSE_BLOCKS, PROSE_CHARS = 2, 200
#: Paths with this share of the best score are content, or with the mean, if that is less.
THRESHOLD = 0.1
#: Attributes end at the first > outside of quotes; quotes only count after =.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
HINTED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?:^|\s)(hidden)(?=[\s=/]|$)", re.I)
PUNCTUATION = ".,;:!?…。，、；：！？¿¡"


def hinted(words: str) -> str:
    """The hint of the first class, id or role word that is one, ends in one, or has one before parts alone; strong ones first. Else nothing."""
    found = ""
    for word in words.lower().split():
        parts = [p for p in re.split("[_-]+", word) if p]
        if parts and parts[0] not in STATES:
            while len(parts) > 1 and parts[-1] not in HINTS and (parts[-1] in PARTS or parts[-1].isdigit()):
                parts.pop()
            if parts[-1] in STRONG:
                return parts[-1]
            found = found or (parts[-1] if parts[-1] in WEAK else "")
    return found


class Element:
    """``order`` counts elements as they open, ``last`` is the order of the last one inside; ``path`` is a number for its tag path."""

    __slots__ = ("name", "parent", "order", "last", "path", "unshown", "off", "linked", "main", "running", "suspect", "weak")

    def __init__(self, name: str, parent: Element | None, order: int, path: int):
        self.name, self.parent, self.order, self.last, self.path = name, parent, order, order, path
        self.unshown, self.off, self.linked, self.main, self.running, self.weak = (parent.unshown, parent.off, parent.linked, parent.main, parent.running, parent.weak) if parent else (False,) * 6
        self.suspect = False


class Node:
    """A run of text in an element, and its block (an ordinal)."""

    __slots__ = ("block", "element", "text")

    def __init__(self, block: int, element: Element, text: str):
        self.block, self.element, self.text = block, element, text


class Reader:
    """The elements and text nodes of a page, in order. Every tag is settled by the innermost open element of its name, which is looked up."""

    def __init__(self, source: str):
        self.root = Element("", None, 0, 0)
        self.elements, self.nodes = [self.root], []
        self.stack = [self.root]
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack by name
        self.blocks, self.scopes = [0], [0]  # places in the stack of blocks and scopes
        self.paths: dict[tuple[int, str], int] = {}
        self.block = 0
        self._read(source)
        self._close(1)
        self.root.last = len(self.elements) - 1

    def _text(self, part: str) -> None:
        if not part.isspace():
            self.nodes.append(Node(self.block, self.stack[-1], html.unescape(part)))
        else:
            self._space()

    def _space(self) -> None:
        if self.nodes and self.nodes[-1].block == self.block and not self.nodes[-1].text[-1:].isspace():
            self.nodes[-1].text += " "

    def _close(self, place: int) -> None:
        """Close the open elements from a place in the stack on."""
        while len(self.stack) > place:
            element = self.stack.pop()
            element.last = len(self.elements) - 1
            self.open[element.name].pop()
            if element.name in SCOPES:
                self.scopes.pop()
            if element.name in BLOCK:
                self.blocks.pop()
                self.block += 1

    def _end(self, name: str) -> None:
        place = self.open[name][-1] if self.open.get(name) else 0
        if place and (name not in INLINE or self.blocks[-1] < place):
            self._close(place)
        elif name == "p":
            self.block += 1

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCK:  # it closes an open paragraph, with the inline elements in it
            self.block += 1
            if self.open.get("p") and self.open["p"][-1] > self.scopes[-1]:
                self._close(self.open["p"][-1])
            for other in CLOSES.get(name, ()):
                while self.open.get(other) and self.open[other][-1] > self.scopes[-1]:
                    self._close(self.open[other][-1])
        elif name == "br":
            self._space()
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            return
        parent = self.stack[-1]
        path = parent.path if name in INLINE else self.paths.setdefault((parent.path, name), len(self.paths) + 1)  # inline elements are part of their block
        element = Element(name, parent, len(self.elements), path)
        element.unshown |= name in UNSHOWN
        element.linked |= name == "a"
        hints = " ".join((h[0].strip("\"'") if h[0] else h[1]) for h in HINTED.findall(attributes)) if attributes else ""
        element.off |= name in FURNITURE and not (name == "header" and parent.main)
        element.suspect = name == "form"
        if hints and name not in ("html", "body", "article", "main"):
            element.off |= "hidden" in hints.split()
            if name not in HEADINGS and not (name in INLINE and parent.running) and (hint := hinted(hints)):
                element.suspect |= hint in STRONG
                element.weak |= hint in WEAK
        element.main |= name in MAIN
        element.running = name in RUNNING or name in INLINE and parent.running
        self.elements.append(element)
        self.open[name].append(len(self.stack))
        if name in SCOPES:
            self.scopes.append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        unclosed: set[str] = set()  # names that no tag closes from here on
        while at < end:
            m = TOKEN.search(source, at)
            stop = m.start() if m else end
            if at < stop:
                self._text(source[at:stop])
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if name and m[1]:
                self._end(name)
            elif name:
                self._start(name, m[3])
                if name in RAW and name not in unclosed:
                    close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                    if close:
                        at = close.start()
                    else:
                        unclosed.add(name)
                        at = end if name in ("script", "style") else at


def smooth(values: list[float], width: int = 1) -> list[float]:
    """Gaussian smoothing over the order of nodes."""
    weights = [math.exp(-(d * d) / (2 * width * width)) for d in range(-2 * width, 2 * width + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, w in zip(range(-2 * width, 2 * width + 1), weights, strict=True):
            if 0 <= i + d < len(values):
                total, weight = total + w * values[i + d], weight + w
        out.append(total / weight)
    return out


def mean_scores(keys: list, scores: list[float]) -> dict:
    sums: dict = defaultdict(lambda: [0.0, 0])
    for k, s in zip(keys, scores, strict=True):
        sums[k][0] += s
        sums[k][1] += 1
    return {k: s / n for k, (s, n) in sums.items()}


def over_threshold(scores: dict) -> set:
    if not scores:
        return set()
    least = min(sum(scores.values()) / len(scores), THRESHOLD * max(scores.values()))
    return {k for k, v in scores.items() if v >= least and v > 0}


def path_scores(keys: list, nodes: list[Node]) -> list[float]:
    """Each node's fused ratios: those of its path, smoothed over the order of nodes."""
    sums: dict = defaultdict(lambda: [0, 0, 0, 0])
    for k, n in zip(keys, nodes, strict=True):
        s, size = sums[k], len(n.text)
        s[0] += size
        s[1] += sum(map(n.text.count, PUNCTUATION))
        s[2] += 1
        s[3] += size * n.element.linked
    ratio = {k: (c / n, (p + 1) / n, (1 - linked / c) * (WEAKENED if k[2] else 1.0)) for k, (c, p, n, linked) in sums.items()}
    chars, marks = smooth([ratio[k][0] for k in keys]), smooth([ratio[k][1] for k in keys])
    return [c * p * ratio[k][2] for k, c, p in zip(keys, chars, marks, strict=True)]


def furniture(elements: list[Element], nodes: list[Node], mass: list[float], prose: list[bool]) -> list[bool]:
    """Whether each element lies in furniture: in a suspect without most of the mass around it, or beside prose.

    Around a suspect is the mass of the suspect (or page) that it lies in. From the innermost out, each keeps its own mass
    and that of suspects in it which hold over two thirds of it all, if it has hardly any prose of its own; where it would keep nothing, it keeps them all.
    """
    near = [0] * len(elements)  # the suspect that an element is or lies in
    inner: dict[int, list[int]] = defaultdict(list)
    for e in elements[1:]:
        near[e.order] = near[e.parent.order]
        if e.suspect:
            inner[near[e.order]].append(e.order)
            near[e.order] = e.order
    held: dict[int, float] = defaultdict(float)
    beside: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for n, m, p in zip(nodes, mass, prose, strict=True):
        at = near[n.element.order]
        held[at] += m
        if p:
            beside[at][n.block] += len(n.text)
    title = next((n.element.order for n in nodes if n.element.name == "h1"), -1)
    gone: set[int] = set()
    for e in reversed(elements):
        if within := inner.get(e.order):
            whole = held[e.order] + sum(held[s] for s in within)
            own = beside[e.order]
            told = len(own) >= PROSE_BLOCKS or sum(own.values()) >= PROSE_CHARS
            stay = {s for s in within if held[s] > WRAPS * whole and (not told or s <= title <= elements[s].last)}
            stay = stay or (set(within) if held[e.order] == 0 and whole and not told else set())
            gone.update(s for s in within if s not in stay or not held[s])
            held[e.order] += sum(held[s] for s in stay)
    off = [False] * len(elements)
    for e in elements[1:]:
        off[e.order] = off[e.parent.order] or e.order in gone
    return off


def select(elements: list[Element], nodes: list[Node]) -> list[bool]:
    """Which nodes are content."""
    told = [n for n in nodes if not n.element.off and not n.element.unshown]
    suspect = [False] * len(elements)
    for e in elements[1:]:
        suspect[e.order] = suspect[e.parent.order] or e.suspect
    key = lambda n: (n.element.path, suspect[n.element.order], n.element.weak)
    keys = [key(n) for n in told]
    scores = path_scores(keys, told)
    high = over_threshold(mean_scores(keys, scores))
    mass = [len(n.text) * (k in high and not n.element.linked) for n, k in zip(told, keys, strict=True)]
    prose = [not (n.element.linked or n.element.weak or n.element.name in HEADINGS) and any(p in n.text for p in PUNCTUATION) for n in told]
    if any(m and n.element.main for n, m in zip(told, mass, strict=True)):
        mass = [m * n.element.main for n, m in zip(told, mass, strict=True)]
        prose = [p and n.element.main for n, p in zip(told, prose, strict=True)]
    off = furniture(elements, told, mass, prose)
    left = [(n, k, s) for n, k, s in zip(told, keys, scores, strict=True) if not off[n.element.order]]
    content = over_threshold(mean_scores([k for _, k, _ in left], [s for _, _, s in left]))
    links: dict = defaultdict(lambda: [0, 0])
    for n, k, _ in left:
        links[k][0] += len(n.text) * n.element.linked
        links[k][1] += len(n.text)
    # The smallest element around the best path's text brings in what stands beside it.
    best = max(content, key=lambda k: links[k][1], default=None)
    inside = [n.element for n, k, _ in left if k == best]
    home = inside[0] if inside else None
    while home and home.last < inside[-1].order:
        home = home.parent
    while home and home.name in INLINE:
        home = home.parent
    kept = set()
    for n, k, _ in left:
        beside = home is not None and home.order <= n.element.order <= home.last and not n.element.weak and (home.main or 2 * links[k][0] < links[k][1])
        if k in content or beside or not content and n.element.main:
            kept.add(id(n))
    return [id(n) in kept for n in nodes]


def join(nodes: list[Node], kept: list[bool]) -> str:
    blocks: dict[int, list[str]] = {}
    for n, k in zip(nodes, kept, strict=True):
        if k:
            blocks.setdefault(n.block, []).append(n.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Reader(source)
    return join(page.nodes, select(page.elements, page.nodes))


def visible_text(source: str | None) -> str:
    """All text that a page shows, furniture too."""
    if not source:
        return ""
    nodes = Reader(source).nodes
    return join(nodes, [not n.element.unshown for n in nodes])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
