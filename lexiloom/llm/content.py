"""Main text of web pages: blocks scored one by one, then labelled together by a minimum cut.

Every block of text is a node. What its tags, names, links and length say becomes the capacity to the
content or the boilerplate terminal; neighbours on the page and in the tree are tied by smoothness
edges. The smallest cut between the terminals labels all blocks of a page at once.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Elements that end a block of text where they begin and end. Fixed values.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p "
    "pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text of the page. A head is none of them: what may stand in it has no text or
#: is listed here, and anything else ends it, closed or not. Fixed values.
RAW_TAGS = "script style noscript template svg iframe textarea select object canvas title math audio video"
#: What may not be open any more when an element of this kind begins. Fixed values.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
VOID_TAGS = frozenset(("hr",))
BOILERPLATE_TAGS = frozenset("nav aside footer form menu dialog button label option legend fieldset".split())
CONTENT_TAGS = frozenset(("article", "main"))
#: Words in class, id and role that name boilerplate and content. Fixed values.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs bottom byline comment "
    "comments consent contentinfo cookie cookies copyright dialog disqus feedback foot footer form gdpr head "
    "header hidden legal login masthead menu menubar meta modal nav navbar navigation newsletter notice "
    "notification pager pagination popup promo promoted promotion rail reader recommended related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription "
    "tags teaser toolbar tooltip topbar warning widget widgets complementary".split())
CONTENT_WORDS = frozenset(
    "article articlebody body content entry entrycontent main page post postcontent story storybody text".split())
#: Of the boilerplate words those that page-wide wrappers carry too ("layout has-sidebar"). Fixed values.
LAYOUT_WORDS = frozenset(
    "ad ads banner bottom breadcrumb breadcrumbs foot footer head header login masthead menu menubar meta nav navbar "
    "navigation rail search share sharing sidebar skip social tags toolbar topbar widget widgets".split())
#: Kinds of boilerplate by what may take it back inside: nothing; <main>; <main> and <article>.
_FIRM, _LAYOUT, _FORM = range(3)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW_TAGS.replace(" ", "|") + r")\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?",
                        re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Weights of the block classifier, in nats for content.
WEIGHTS = {"bias": -1.2, "boilerplate": -7.0, "content": 3.0, "paragraph": 1.2, "heading": 0.4, "item": -0.6,
           "links": -4.0, "log_words": 0.7, "sentence": 0.6}
#: Smoothness between neighbours that share their parent; it falls with their distance in the tree.
TIE = 0.9


@dataclass
class Element:
    tag: str
    number: int
    leaning: float
    kind: int


@dataclass
class Block:
    path: tuple[int, ...]
    tag: str
    leaning: float
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _own_leaning(tag: str, attrs: str, inside: float) -> tuple[float, int]:
    """What an element says by itself, and the kind of boilerplate if it is any."""
    if tag in BOILERPLATE_TAGS or tag == "header" and inside <= 0:
        own, kind = WEIGHTS["boilerplate"], _FORM if tag == "form" else _FIRM
    else:
        own, kind = WEIGHTS["content"] if tag in CONTENT_TAGS else 0.0, _FIRM
    if attrs and (own >= 0 or kind != _FIRM):
        for m in _ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(
                    r"display\s*:\s*none", value, re.I):
                return WEIGHTS["boilerplate"], _FIRM
            if name in ("class", "id", "role"):
                words = {w.lower() for w in _NAME.findall(value)}
                named = words & BOILERPLATE_WORDS if tag not in ("html", "body", "article", "main", "h1") else ()
                if named and not named <= LAYOUT_WORDS and tag != "form":
                    return WEIGHTS["boilerplate"], _FIRM
                if named and tag != "form":
                    own, kind = WEIGHTS["boilerplate"], _LAYOUT
                elif words & CONTENT_WORDS and tag not in ("html", "body") and own >= 0:
                    own = WEIGHTS["content"]
    return own, kind


def _leaning(tag: str, attrs: str, inside: float, kind: int, spared: bool) -> tuple[float, int]:
    """What an element adds to what its ancestors say: content above zero, boilerplate below, and its kind.

    <main> takes back what a form or a name of the layout says, <article> what a form does. An element
    that is ``spared`` is no boilerplate by such a name or as a form.
    """
    own, own_kind = _own_leaning(tag, attrs, inside)
    if spared and own < 0 and own_kind != _FIRM:
        own = 0.0
    if inside < 0:
        if own < 0:
            return inside, min(kind, own_kind)
        if tag == "main" and kind != _FIRM or tag == "article" and kind == _FORM:
            return own, _FIRM
        return inside, kind
    return (own, own_kind) if own < 0 else (max(inside, own), _FIRM)


def read_blocks(page: str) -> list[Block]:
    """Blocks with any text, in page order. Markup may be broken or end anywhere.

    Forms and elements with a name of the layout that hold most of the page's unlinked text are its
    wrappers and no boilerplate.
    """
    spared: set[int] = set()
    while True:
        blocks, roots = _read_blocks(page, spared)
        free = [sum(map(len, b.parts)) - b.linked for b in blocks] if roots else []
        wide = {n for n in roots if 2 * sum(f for f, b in zip(free, blocks) if n in b.path) > sum(free)}
        if not wide:
            return blocks
        spared |= wide


def _read_blocks(page: str, spared: set[int]) -> tuple[list[Block], set[int]]:
    """The blocks, and the numbers of the outermost forms and elements with a name of the layout."""
    roots: set[int] = set()
    stack: list[Element] = []
    blocks: list[Block] = []
    current: Block | None = None
    link: int | None = None
    number = at = 0

    def add(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            if raw.isspace():
                return
            top = stack[-1] if stack else Element("", 0, 0.0, _FIRM)
            current = Block(tuple(e.number for e in stack), top.tag, top.leaning)
            blocks.append(current)
        current.parts.append(raw)
        if link is not None:
            current.linked += len(raw)

    def close(depth: int) -> None:
        nonlocal link
        del stack[depth:]
        if link is not None and link > depth:
            link = None

    for m in _TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        if m["tag"] is None:  # a comment, a declaration, or an element without text
            continue
        tag = m["tag"].lower()
        if tag == "a":
            link = None if m["end"] else len(stack)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in BLOCK_TAGS:
            continue
        current = None
        if m["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            continue
        shut = CLOSES.get(tag, ())
        if stack and (stack[-1].tag == "p" or stack[-1].tag in shut):
            close(len(stack) - 1)
        if tag not in VOID_TAGS:
            number += 1
            inside, above = (stack[-1].leaning, stack[-1].kind) if stack else (0.0, _FIRM)
            leaning, kind = _leaning(tag, m["attrs"], inside, above, number in spared)
            if leaning < 0 <= inside and kind != _FIRM:
                roots.add(number)
            stack.append(Element(tag, number, leaning, kind))
    add(page[at:])
    for b in blocks:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in blocks if b.text], roots


def score(block: Block) -> float:
    """Log odds that a block is content, on its own."""
    words = block.text.count(" ") + 1
    share = min(1.0, block.linked / max(1, sum(map(len, block.parts))))
    total = WEIGHTS["bias"] + block.leaning + WEIGHTS["links"] * share
    total += WEIGHTS["log_words"] * min(4.0, math.log(words))
    if block.tag in ("p", "blockquote", "pre"):
        total += WEIGHTS["paragraph"]
    elif block.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        total += WEIGHTS["heading"]
    elif block.tag in ("li", "td", "th", "dt", "dd"):
        total += WEIGHTS["item"]
    if block.text[-1] in ".!?…\"”»。":
        total += WEIGHTS["sentence"]
    return total


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours on the page, and between blocks that follow each other in one parent."""
    out: dict[tuple[int, int], float] = {}
    last_in: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1].path
            shared = 0
            for x, y in zip(a, b.path):
                if x != y:
                    break
                shared += 1
            far = max(len(a), len(b.path)) - shared
            out[i - 1, i] = TIE / max(1, far * far)
        parent = b.path[-2] if len(b.path) > 1 else 0
        if parent in last_in and (last_in[parent], i) not in out:
            out[last_in[parent], i] = TIE / 2
        last_in[parent] = i
    return [(a, b, w) for (a, b), w in out.items()]


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the content side of a smallest cut.

    A node whose own capacity exceeds all its ties keeps its side in any smallest cut; its ties then
    count for its neighbours. Maximum flow decides the rest.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    pull = list(scores)
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(pull[i]) > sum(near[i].values()):
            side[i] = pull[i] > 0
            for j, w in near[i].items():
                if side[j] is None:
                    pull[j] += w if side[i] else -w
                    del near[j][i]
                    todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, content in zip(rest, _max_flow(rest, pull, near)):
            side[i] = content
    return [bool(s) for s in side]


def _max_flow(rest: list[int], pull: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Shortest augmenting paths; what the content terminal still reaches afterwards is content."""
    place = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    room: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
    for i, k in place.items():
        if pull[i] > 0:
            room[source][k], room[k][source] = pull[i], 0.0
        elif pull[i] < 0:
            room[k][sink], room[sink][k] = -pull[i], 0.0
        for j, w in near[i].items():
            if j in place:
                room[k][place[j]] = w
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 1e-12 and v not in came:
                    came[v] = u
                    queue.append(v)
        if sink not in came:
            return [k in came for k in range(len(rest))]
        path = [sink]
        while path[-1] != source:
            path.append(came[path[-1]])
        steps = [(path[i + 1], path[i]) for i in range(len(path) - 1)]
        flow = min(room[u][v] for u, v in steps)
        for u, v in steps:
            room[u][v] -= flow
            room[v][u] = room[v].get(u, 0.0) + flow


def main_text(page: str | None) -> tuple[str, int, int]:
    """Content blocks joined by line breaks; blocks of the page and of its content."""
    blocks = read_blocks(page) if page else []
    content = minimum_cut([score(b) for b in blocks], ties(blocks))
    kept = [b.text for b, c in zip(blocks, content) if c]
    return "\n".join(kept), len(blocks), len(kept)


def extract_content(pages: DataFrame, source: str = "html", output: str = "content") -> DataFrame:
    """``pages`` with ``output``: ``text, n_blocks, n_content`` of the whole page.

    Null and empty pages, and pages without content, give the empty text. Character references are
    decoded, white space inside a block is one space, blocks are joined by one line break in page order.
    Rows are independent; a column named ``output`` is replaced.
    """

    @F.pandas_udf("text string, n_blocks int, n_content int")
    def extract(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([main_text(v) for v in values], columns=["text", "n_blocks", "n_content"])

    return pages.withColumn(output, extract.asNondeterministic()(F.col(source)))
