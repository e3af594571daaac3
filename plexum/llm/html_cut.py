"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A linear classifier gives each block a cost for either label; the costs become capacities from the source
(content) and to the sink (boilerplate). Blocks that follow each other, and blocks with the same parent, are joined by smoothness
edges. An article or main is a node of its own, with a prior that grows with its unlinked blocks and an edge to each of them: a block's own
words say little where it is short, so the cut settles a line, an item or a heading by what stands around it. The source side of the
minimum cut is the text. Blocks that outweigh all their edges are labelled first and folded into their neighbours' costs, which
leaves the cut as it is; max-flow runs on the rest.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from plexum.llm.common import map_arrow

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Elements without text of the page.
SILENT = frozenset("script style title noscript template iframe object svg math canvas audio video textarea select option button datalist xmp noframes".split())
#: Those whose content is not markup and runs to their end tag, or to the page's end.
RAW = frozenset("script style iframe xmp noframes textarea".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that a page's frame is made of, and words in class or id that mark it.
FRAME = frozenset("nav footer aside form menu dialog fieldset".split())
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner billboard sponsor sponsored promo promotion sidebar rail widget nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar "
    "comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations toolbar pagination pager copyright search form paywall disclaimer".split()
)
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
BODY_WORDS = frozenset("article content post entry story maintext bodytext".split())
BREAKS_P = frozenset("p div ul ol dl table section article aside header footer nav form h1 h2 h3 h4 h5 h6 pre blockquote address main figure hr fieldset details menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Block:
    text: str
    tag: str
    parent: int
    frame: bool
    body: bool
    header: bool
    link_chars: int
    hint: bool = False
    #: Numbers of the elements around it that are marked by a word, and of the outermost article or main.
    marks: tuple[int, ...] = ()
    carrier: int = 0


@dataclass
class _Open:
    tag: str
    number: int
    frame: bool
    body: bool
    header: bool
    hint: bool
    marks: tuple[int, ...] = ()
    carrier: int = 0
    parts: list = field(default_factory=list)


def _marks(attrs: str) -> tuple[set[str], str, bool]:
    """Words of class and id, the role, and whether the element is hidden."""
    words: set[str] = set()
    role, hidden = "", False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            words.update(x.lower() for x in _PART.findall(value))
        elif name == "role":
            role = value.strip().lower()
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
    return words, role, hidden or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs))


_TAGS = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I) for tag in SILENT}
_BREAK = re.compile(rf"</?(?:{'|'.join(sorted(BREAKS_P | {'body', 'html', 'li', 'td', 'th', 'tr', 'dd', 'dt', 'main', 'head'}, key=len, reverse=True))})(?=[\s/>])", re.I)


def _silence(page: str, at: int, tag: str, last: dict[str, int]) -> int:
    """Where the content of a silent element ends that begins at `at`.

    Without an end tag, or with another element of its kind before it, the element was not closed: it ends at the next tag of a block, so that
    the page's rest is read. Drawings, objects and templates may hold their own kind. `last` remembers where a kind's last end tag stands.
    """
    if tag not in last:
        last[tag] = max((m.start() for m in _TAGS[tag].finditer(page, at) if m[1]), default=-1)
    depth, within = 0, at if last[tag] >= at else len(page)
    for m in _TAGS[tag].finditer(page, within):
        if m[1]:
            if not depth:
                return m.end()
            depth -= 1
        elif tag in ("svg", "math", "object", "template"):
            depth += not m[0].endswith("/>")
        elif tag not in RAW:
            break
    if tag in RAW:
        return len(page)
    found = _BREAK.search(page, at)
    return found.start() if found else len(page)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, without empty ones."""
    return parsed(page)[0]


def parsed(page: str) -> tuple[list[Block], list[int]]:
    """The page's text blocks, and the parent of each element by its number."""
    out: list[Block] = []
    above = [0]
    talk: set[int] = set()
    carriers: dict[int, tuple[tuple[int, ...], bool]] = {}
    stack = [_Open("", 0, False, False, False, False)]
    number, links, at, text, linked, last = 0, 0, 0, [], 0, {}

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join("".join(text).split())
            if said:
                top = stack[-1]
                out.append(Block(said, top.tag, top.number if top.tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dd", "dt") or len(stack) < 2 else stack[-2].number, top.frame, top.body, top.header, linked, top.hint, top.marks, top.carrier))
            text.clear()
        linked = 0

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return
            if stack[i].tag in ("table", "article", "main", "body") and tag not in ("table", "article", "main", "body", "html"):
                return

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if links:
                linked += len(piece)

    while True:
        m = _TOKEN.search(page, at)
        say(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        ends, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in SILENT:
            if not ends and not attrs.rstrip().endswith("/"):
                at = _silence(page, at, tag, last)
            if tag not in ("button", "svg", "math"):
                text.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if ends else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        if ends:
            if tag == "a":
                links = 0
            close(tag)
            continue
        if tag in BREAKS_P and stack[-1].tag == "p":
            stack.pop()
        if tag in ("li", "dd", "dt", "tr", "td", "th") and stack[-1].tag in ({"li"} if tag == "li" else {"dd", "dt"} if tag in ("dd", "dt") else {"td", "th"} if tag in ("td", "th") else {"td", "th", "tr"}):
            stack.pop()
            if tag == "tr" and stack[-1].tag == "tr":
                stack.pop()
        if attrs.rstrip().endswith("/") and tag not in ("p", "div"):
            continue
        words, role, hidden = _marks(attrs) if attrs.strip() else (set(), "", False)
        up = stack[-1]
        number += 1
        whole = tag in ("html", "body", "article", "main")
        body = up.body or tag in ("article", "main") or role in ("article", "main")
        frame = up.frame or tag in FRAME or role in FRAME_ROLES or hidden or (tag == "header" and not body) or (tag == "article" and bool(words & {"comment", "comments", "reply"}))
        marks, carrier = up.marks, up.carrier
        if not whole and words & FRAME_WORDS:
            marks += (number,)
            if words & COMMENT_WORDS:
                talk.add(number)
        if body and not up.body and not frame:
            carrier = number
            carriers[number] = marks, tag == "main" or role == "main"
        above.append(up.number)
        stack.append(_Open(tag, number, frame, body, up.header or tag == "header", up.hint or (not whole and bool(words & BODY_WORDS)), marks, carrier))
    flush()
    lifted = _wrappers(out, talk, carriers)
    for b in out:
        b.frame = b.frame or not lifted.issuperset(b.marks)
    return out, above


def _wrappers(found: list[Block], talk: set[int], carriers: dict[int, tuple[tuple[int, ...], bool]]) -> set[int]:
    """Elements marked by a word that are no frame, since the page's text is in them.

    These are the elements around a main with text, or around the longest article if no more text stands free of marks and articles. Without
    either, they are those with most of the page's text. Elements of comments (`talk`) only count where no text precedes them, as a
    story does its comments. Text in links and in frames of other kinds is not counted.
    """
    if not any(b.marks for b in found):
        return set()
    total = free = 0
    own, held, before = dict.fromkeys(carriers, 0), {}, {}
    for b in found:
        if b.frame:
            continue
        n = max(0, len(b.text) - b.link_chars)
        for m in b.marks:
            before.setdefault(m, total)
            held[m] = held.get(m, 0) + n
        if b.carrier in own and b.marks == carriers[b.carrier][0]:
            own[b.carrier] += n
        elif not b.marks:
            free += n
        total += n
    late = {m for m, n in before.items() if m in talk and n > 0.1 * total}
    fit = [c for c, n in own.items() if n and not late.intersection(carriers[c][0])]
    best = max(fit, key=lambda c: (carriers[c][1], own[c]), default=None)
    if best is not None and (carriers[best][1] or own[best] >= free):
        return set(carriers[best][0])
    return {m for m, n in held.items() if n > 0.5 * total and m not in late}


#: Weights of the classifier, as log odds of content.
WEIGHTS = {"frame": -9.0, "beside_body": -5.0, "hint": 2.0, "header": -1.0, "heading": 1.0, "p": 1.2, "item": -0.4, "length": 0.7, "links": -4.0, "stop": 0.8, "legal": -2.5, "bias": -0.4}
_LEGAL = re.compile(r"©|\(c\)\s|copyright|all rights reserved|cookies?\b|privacy policy|terms of (?:use|service)|subscribe|sign (?:in|up)|log ?in", re.I)


def logit(block: Block, has_body: bool, weights: dict[str, float] = WEIGHTS) -> float:
    words = block.text.count(" ") + 1
    s = weights["bias"] + weights["length"] * (min(6.0, math.log2(words)) - 3.0) + weights["links"] * min(1.0, block.link_chars / len(block.text))
    s += weights["frame"] * block.frame + weights["beside_body"] * (has_body and not block.body) + weights["hint"] * block.hint
    s += weights["header"] * (block.header and block.tag not in HEADINGS) + weights["heading"] * (block.tag in HEADINGS) + weights["p"] * (block.tag in ("p", "pre", "blockquote")) + weights["item"] * (block.tag in ("li", "td", "th"))
    s += weights["stop"] * (block.text[-1] in ".!?…。！？\"”»")
    if words < 30 and not block.body and _LEGAL.search(block.text):
        s += weights["legal"]
    return s


#: Edges: between blocks in a row, less across the border of a frame or body; between neighbours of one parent; from an article or main to
#: its blocks; the prior of an article or main for each of its blocks that is not a link; and the edge of
#: an element that stands for an article, with half that prior.
NEAR, ACROSS, SIBLING, CARRIED, PRIOR, HELD = 0.7, 0.1, 0.5, 4.0, 3.0, 2.5


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between blocks: of blocks in a row, and of the last block before with the same parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            out.append((i - 1, i, NEAR * (1.0 if a.frame == b.frame and a.body == b.body else ACROSS)))
        before = last.get(b.parent)
        if before is not None:
            out.append((before, i, SIBLING * (1.0 if found[before].frame == b.frame else ACROSS)))
        last[b.parent] = i
    return out


def network(found: list[Block], above: list[int]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Costs and edges of the blocks, followed by the nodes of articles and mains; without any, that of the element with most text in paragraphs."""
    has_body = any(b.body and not b.frame for b in found)
    costs, links, nodes = [logit(b, has_body) for b in found], edges(found), {}
    for i, b in enumerate(found):
        if b.carrier and not b.frame:
            if b.carrier not in nodes:
                nodes[b.carrier] = len(costs)
                costs.append(0.0)
            at = nodes[b.carrier]
            links.append((i, at, CARRIED))
            costs[at] += PRIOR * (2 * b.link_chars < len(b.text))
    if not nodes:
        told: dict[int, int] = {}
        for b in found:
            if not b.frame and b.tag in ("p", "pre", "blockquote"):
                told[b.parent] = told.get(b.parent, 0) + len(b.text) - b.link_chars
        best = max(told, key=lambda x: (told[x], -x), default=0)
        if best:
            inside = [False] * len(above)
            for number in range(best, len(above)):
                inside[number] = number == best or inside[above[number]]
            own = [i for i, b in enumerate(found) if inside[b.parent] and not b.frame]
            links += [(i, len(costs), HELD) for i in own]
            costs.append(0.5 * PRIOR * sum(2 * found[i].link_chars < len(found[i].text) for i in own))
    return costs, links


def minimum_cut(costs: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source side of the minimum cut. costs: over 0 from the source, under 0 to the sink."""
    n = len(costs)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in links:
        if i != j and w > 0:
            around[i][j] = around[i].get(j, 0.0) + w
            around[j][i] = around[j].get(i, 0.0) + w
    unary, weight, label = list(costs), [sum(x.values()) for x in around], [None] * n
    queue = deque(i for i in range(n) if abs(unary[i]) > weight[i] or not weight[i])
    while queue:
        i = queue.popleft()
        if label[i] is not None:
            continue
        label[i] = unary[i] > 0
        for j, w in around[i].items():
            if label[j] is None:
                unary[j] += w if label[i] else -w
                weight[j] -= w
                if abs(unary[j]) > weight[j] + 1e-12:
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _max_flow(rest, unary, around)):
            label[i] = side
    return label


def _max_flow(rest: list[int], unary: list[float], around: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm on the nodes of rest; source n, sink n + 1."""
    place = {i: k for k, i in enumerate(rest)}
    n = len(rest)
    s, t = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def arc(u: int, v: int, c: float, back: float) -> None:
        out[u].append(len(to))
        to.append(v)
        cap.append(c)
        out[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in rest:
        if unary[i] > 0:
            arc(s, place[i], unary[i], 0.0)
        elif unary[i] < 0:
            arc(place[i], t, -unary[i], 0.0)
        for j, w in around[i].items():
            if j in place and i < j:
                arc(place[i], place[j], w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn, path, u = [0] * (n + 2), [], s
        while True:
            if u == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                path, u = [], s
                continue
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(out[u][turn[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def main_text(page: str | None) -> tuple[str, int, int]:
    """The text, the number of blocks, and the number of content blocks; empty for a page without any."""
    found, above = parsed(page or "")
    if not found:
        return "", 0, 0
    side = minimum_cut(*network(found, above))
    kept = [b.text for b, content in zip(found, side) if content]
    return " ".join(kept), len(found), len(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page. A null or empty page has empty text; repeated pages give repeated rows; other columns are not read.

    A map without a shuffle: a page is read, cut and forgotten, whatever its length.
    """

    def run(batch: pa.RecordBatch) -> dict:
        got = [main_text(x) for x in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": [x[0] for x in got], "n_chars": [len(x[0]) for x in got], "n_blocks": [x[1] for x in got], "n_content": [x[2] for x in got]}

    return map_arrow(pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")), run, "page_id long, url string, text string, n_chars long, n_blocks int, n_content int")
