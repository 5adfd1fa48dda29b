"""Operator 1: main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A small classifier turns the signs of a block (its own tag and
its ancestors, names of classes and ids, links, length, punctuation) into the costs of calling it
content or boilerplate; these are the capacities to the two terminals of a flow network. Blocks
that follow each other, and blocks near each other in the tree, are tied by smoothness edges whose
capacity falls with their distance in the tree, and is less between links and text and across the border of a marked part. The minimum cut,
found by maximum flow, is the cheapest labelling of the whole page. Only tags and names that mark boilerplate weigh so much that
a block is judged alone; a short heading, list item or line of links inside an article speaks against itself, and the
text around it decides (``label_blocks`` gives both labels).

A part of the page that a tag or a name marks as boilerplate (comments, adverts, notices, forms ...) stays so
inside an article; only an article inside a part named for the layout (a sidebar wrapper) is content again.

Pages are read by a scanner that never looks at a character twice, and open elements are counted by
name, so time is in proportion to the page whatever its markup.

Defined results: null or empty html and pages without content blocks give empty text; malformed
pages are repaired as browsers do (unclosed paragraphs and list items end where the next begins, a stray end tag does nothing, a
cut-off tag and what follows an unclosed comment, script or style are dropped, unknown declarations are comments);
a quote that is never closed is an ordinary character; rows are independent, so repeated rows repeat.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import chunks, table

# Element names by role, and words that classes and ids use for parts of a page.
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form menu fieldset search dialog".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_ROLES = frozenset("main article".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Parts that hold no article, whatever they hold.
CLUTTER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion breadcrumb breadcrumbs cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond "
    "response responses discussion recommended recommendations related share sharing social bio biography disclaimer tags widget toolbar "
    "pagination pager skip search form".split()
)
#: Names that a wrapper of the whole layout may bear too.
LAYOUT_NAMES = frozenset("banner nav navbar navigation menu sidebar side aside footer foot header masthead topbar".split())
#: Names that say little.
WEAK_NAMES = frozenset("copyright legal".split())
CONTENT_NAMES = frozenset("article content post entry story main body text articlebody maincontent".split())
#: Words that may follow the telling word of a name, and words that make it say how a page is laid out.
GENERIC_NAMES = frozenset(
    "list box area section wrapper wrap container item items body text thread block panel bar inner main content row col column unit slot "
    "top bottom left right link links label title heading count meta info card group holder zone module author button buttons icons posts stories articles".split()
)
STATE_NAMES = frozenset("no has with without is".split())
#: Elements that the start of another one closes.
CLOSED_BY = {
    "li": frozenset({"p", "li"}),
    "dt": frozenset({"p", "dt", "dd"}),
    "dd": frozenset({"p", "dt", "dd"}),
    "tr": frozenset({"p", "tr", "td", "th"}),
    "td": frozenset({"p", "td", "th"}),
    "th": frozenset({"p", "td", "th"}),
}
PARAGRAPH = frozenset({"p"})
#: Elements whose inside is text up to their end tag.
RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.IGNORECASE) for t in "script style textarea title xmp iframe noembed noframes".split()}
SPACE = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
TAG_OPEN = re.compile(r"<(?=[A-Za-z/!?])")
TAG_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
#: What ends a tag, and what opens a quoted value.
TAG_STOP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
LONG_REFERENCE = re.compile(r"&#[xX]?[0-9a-fA-F]{9,};?")
LEGAL = re.compile(r"©|\(c\)|copyright|all rights reserved|privacy policy|terms of (?:use|service)|imprint|impressum|mentions légales|aviso legal", re.IGNORECASE)
SENTENCE = re.compile(r"[.!?…](?:\s|$)")

#: Weights of the classifier's signs, in log odds of being content.
WEIGHTS = {
    "bias": -1.6,
    "boilerplate_tag": -9.0,
    "clutter_name": -8.0,
    "layout_name": -6.0,
    "weak_name": -2.0,
    "content_ancestor": 1.0,
    "content_name": 0.6,
    "paragraph": 0.8,
    "link_share": -3.0,
    "log_words": 0.7,
    "log_sentences": 1.1,
    "legal_text": -3.0,
}
#: Words up to which a block can be a legal line.
LEGAL_WORDS = 30
#: Log odds are multiples of this and never zero, so flow soon finds an end.
GAIN_UNIT = 0.125
#: Smoothness of neighbours: capacity at tree distance d is SMOOTH / d ** 1.5, less as one is more of a link than the other, and
#: BORDER of it where a marked part begins or ends.
SMOOTH = 6.5
BORDER = 0.2
#: Blocks this far apart on the page may still be tied if they share a parent.
PROXIMITY = 3
#: Steps up the tree that a distance counts; farther blocks are this far.
MAX_DISTANCE = 64


def name_kind(name: str) -> str | None:
    """What a class or an id says of its part of the page: the last word that is not a generic one tells."""
    words = [w.lower() for w in NAME_PARTS.findall(name)]
    if not words or words[0] in STATE_NAMES:
        return None
    for word in reversed(words):
        for kind, known in (("clutter", CLUTTER_NAMES), ("layout", LAYOUT_NAMES), ("weak", WEAK_NAMES)):
            if word in known:
                return kind
        if word not in GENERIC_NAMES:
            break
    return "content" if CONTENT_NAMES.intersection(words) else None


MARKED, CLUTTER, LAYOUT, WEAK, NAMED, CONTENT = (1 << k for k in range(6))


class Node:
    """An open element, with what it and those above it say of the blocks inside (``signs``)."""

    __slots__ = ("parent", "depth", "tag", "block", "region", "signs", "inline")

    def __init__(self, parent: Node | None, tag: str):
        self.parent, self.tag = parent, tag
        self.depth = parent.depth + 1 if parent else 0
        self.signs: int = parent.signs if parent else 0
        #: the nearest element at or above this that makes blocks, and that where a marked part of the page begins
        self.block: Node = self if parent is None or tag in BLOCK else parent.block
        self.region: Node = parent.region if parent else self
        #: of a block: the inline elements open right inside, by name
        self.inline: dict[str, int] | None = {} if self.block is self else None

    def read_signs(self, names: list[str], roles: list[str]) -> None:
        tag, signs = self.tag, self.signs
        kinds = {name_kind(n) for n in names} if names and tag not in ("html", "body") else ()
        # a header inside an article holds its title; elsewhere it is the site's
        titles = signs & CONTENT and not signs & MARKED
        if tag in BOILERPLATE_TAGS or (tag == "header" and not titles) or BOILERPLATE_ROLES.intersection(roles):
            signs = (signs | MARKED) & ~CONTENT
        elif "clutter" in kinds:
            signs = (signs | CLUTTER) & ~CONTENT
        elif "layout" in kinds and not (titles and all("header" in n.lower() for n in names if name_kind(n) == "layout")):
            signs = (signs | LAYOUT) & ~CONTENT
        elif (tag in CONTENT_TAGS or CONTENT_ROLES.intersection(roles)) and not signs & (MARKED | CLUTTER):
            signs = (signs | CONTENT) & ~LAYOUT
        elif "content" in kinds:
            signs |= NAMED
        elif "weak" in kinds:
            signs |= WEAK
        else:
            return
        self.signs, self.region = signs, self


class Block:
    __slots__ = ("node", "parts", "linked", "length", "text", "n_words")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked, self.length, self.text, self.n_words = node, [], 0, 0, "", 0


def tag_end(html: str, at: int) -> int:
    """Where the tag that holds ``at`` ends (its ``>``), -1 if it does not; quoted values may hold any character."""
    while True:
        stop = TAG_STOP.search(html, at)
        if stop is None:
            return -1
        if stop[1] is None:
            return stop.start()
        closing = html.find(stop[1], stop.end())
        if closing < 0:  # never closed: an ordinary character, and no other such quote needs a look
            return html.find(">", stop.end())
        at = closing + 1


def page_parts(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) and ("end", name, "") in order, in one pass."""
    at, size = 0, len(html)
    while at < size:
        opened = TAG_OPEN.search(html, at)
        if opened is None:
            yield "text", html[at:], ""
            return
        less = opened.start()
        name = TAG_NAME.match(html, less + 1)
        if less > at:
            yield "text", html[at:less], ""
        if name is None:
            if html.startswith("<!--", less):
                short = html[less + 4 : less + 6]
                end = less + 4 if short[:1] == ">" else less + 5 if short == "->" else html.find("-->", less + 4)
                at = end + (1 if short[:1] == ">" or short == "->" else 3) if end >= 0 else size
            else:
                end = html.find(">", less)
                at = end + 1 if end >= 0 else size
            continue
        end = tag_end(html, name.end())
        if end < 0:
            return
        tag = name[0].lower()
        at = end + 1
        if tag[0] == "/":
            yield "end", tag[1:], ""
            continue
        yield "start", tag, html[name.end() : end]
        if tag in RAW:
            close = RAW[tag].search(html, at)
            if close is None:
                return
            at = close.start()


class PageBlocks:
    """Collects the text blocks of a page with the element each lies in."""

    def __init__(self) -> None:
        self.stack: list[Node] = [Node(None, "")]
        self.open: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.current: Block | None = None
        self.skipping = self.links = 0

    def feed(self, html: str) -> None:
        handle = {"text": self.text, "start": self.start, "end": self.end}
        for kind, what, attributes in page_parts(html):
            handle[kind](what, attributes)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.current = None
            closed = CLOSED_BY.get(tag, PARAGRAPH)
            while self.stack[-1].block.tag in closed:
                self._pop_to(self.stack[-1].block.depth)
        if tag in VOID:
            if tag == "br" and self.current is not None:
                self.current.parts.append(" ")
            return
        node = Node(self.stack[-1], tag)
        names, roles = [], []
        if "=" in attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key in ("class", "id", "role"):
                    (roles if key == "role" else names).extend(unescape("".join(values)).split())
        if names or roles or tag in BOILERPLATE_TAGS or tag in CONTENT_TAGS or tag == "header":
            node.read_signs(names, [r.lower() for r in roles])
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        if node.inline is None:
            node.block.inline[tag] = node.block.inline.get(tag, 0) + 1
        self.skipping += tag in SKIPPED
        self.links += tag == "a"

    def end(self, tag: str, _: str) -> None:
        if tag in BLOCK:
            self.current = None
            if not self.open.get(tag):
                return
        elif not self.stack[-1].block.inline.get(tag):
            return  # a stray inline end tag does not close blocks
        depth = len(self.stack) - 1
        while self.stack[depth].tag != tag:
            depth -= 1
        self._pop_to(depth)

    def text(self, data: str, _: str) -> None:
        if self.skipping:
            return
        if "&" in data:
            data = unescape(LONG_REFERENCE.sub("\ufffd", data))
        if self.current is None:
            if data.isspace():
                return
            self.current = Block(self.stack[-1].block)
            self.blocks.append(self.current)
        self.current.parts.append(data)
        self.current.length += len(data)
        if self.links:
            self.current.linked += len(data)

    def _pop_to(self, depth: int) -> None:
        for node in self.stack[depth:]:
            tag = node.tag
            self.open[tag] -= 1
            if node.inline is None:
                node.block.inline[tag] -= 1
            self.skipping -= tag in SKIPPED
            self.links -= tag == "a"
        del self.stack[depth:]


def page_blocks(html: str) -> list[Block]:
    page = PageBlocks()
    page.feed(html)
    for block in page.blocks:
        block.text = SPACE.sub(" ", "".join(block.parts)).strip()
        block.n_words = block.text.count(" ") + 1
    return [b for b in page.blocks if b.text]


def link_share(block: Block) -> float:
    return block.linked / max(block.length, 1)


def content_log_odds(block: Block) -> float:
    """The classifier: signs of a block, weighed."""
    w, node, score = WEIGHTS, block.node, WEIGHTS["bias"]
    tag, signs = node.tag, node.signs
    for sign, name in ((MARKED, "boilerplate_tag"), (CLUTTER, "clutter_name"), (LAYOUT, "layout_name"), (NAMED, "content_name"), (CONTENT, "content_ancestor")):
        if signs & sign:
            score += w[name]
    if signs & WEAK and not signs & NAMED:
        score += w["weak_name"]
    score += w["paragraph"] * (tag in ("p", "blockquote", "pre", "td", "figcaption"))
    score += w["link_share"] * link_share(block)
    score += w["log_words"] * math.log(block.n_words + 1) + w["log_sentences"] * math.log(len(SENTENCE.findall(block.text)) + 1)
    if block.n_words <= LEGAL_WORDS and LEGAL.search(block.text):
        score += w["legal_text"]
    units = round(score / GAIN_UNIT)
    return (units or (1 if score > 0 else -1)) * GAIN_UNIT


def tree_distance(a: Block, b: Block) -> int:
    x, y, steps = a.node, b.node, 0
    while x is not y and steps < MAX_DISTANCE:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        steps += 1
    return steps


def smoothness_edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges of each block to the next one, to the next of its own part of the page, whatever lies between, and to near ones that share a parent."""
    edges = []
    latest: dict[Node, int] = {}
    for k, block in enumerate(blocks):
        near = {k - step: step for step in range(PROXIMITY, 0, -1) if k >= step and (step == 1 or blocks[k - step].node.parent is block.node.parent)}
        before = latest.get(block.node.region)
        if before is not None:
            near[before] = 1
        latest[block.node.region] = k
        for other, step in near.items():
            share = (1.0 if before is not None and blocks[other].node.region is block.node.region else BORDER) * (1.0 - 0.9 * abs(link_share(block) - link_share(blocks[other])))
            edges.append((other, k, share * SMOOTH / (max(tree_distance(block, blocks[other]), 1) ** 1.5 * step)))
    return edges


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: ``gain[k]`` is the log odds of block k, an edge costs its
    capacity if its ends differ. Flow that a block can pass on directly is cancelled first; the rest
    is pushed along shortest augmenting paths."""
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    left: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def connect(a: int, b: int, forward: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        left.append(forward)
        out[b].append(len(to))
        to.append(a)
        left.append(back)

    for k, g in enumerate(gain):
        if g > 0:
            connect(source, k, g, 0.0)
        elif g < 0:
            connect(k, sink, -g, 0.0)
    for a, b, capacity in edges:
        connect(a, b, capacity, capacity)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if left[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if left[e] <= 1e-9)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if left[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]


def label_blocks(html: str | None) -> list[tuple[Block, bool, bool]]:
    """All blocks of a page in order, each with the label of its own signs and the label of the minimum cut (True: content)."""
    blocks = page_blocks(html or "")
    gain = [content_log_odds(b) for b in blocks]
    return list(zip(blocks, (g > 0 for g in gain), minimum_cut(gain, smoothness_edges(blocks))))


def main_blocks(html: str | None) -> tuple[list[str], int]:
    """The content blocks of a page in order, and the number of all blocks."""
    labelled = label_blocks(html)
    return [b.text for b, _, keep in labelled if keep], len(labelled)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars, n_blocks, n_content_blocks."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            found = [main_blocks(x) for x in batch.column("html").to_pylist()]
            texts = ["\n".join(kept) for kept, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([n for _, n in found], pa.int64()),
                    pa.array([len(kept) for kept, _ in found], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content_blocks"],
            )

    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return given.mapInArrow(extract, "page_id long, url string, text string, n_chars long, n_blocks long, n_content_blocks long")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
