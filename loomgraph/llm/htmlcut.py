"""Main text of HTML pages by minimum-cut labelling.

A page becomes a sequence of text blocks. A linear classifier over tags, class names, length, punctuation and links gives
each block the log-odds of being content; they are the capacities to the terminals. What tags and names tell is bounded, so
that no block is beyond the reach of its neighbours. Blocks that follow each other, and blocks next to each other under
one parent element, are joined by smoothness edges, strong within a sectioning element and weak across its border. A maximum
flow parts content from boilerplate at the least total cost.

The weights of the classifier are given, not learned, as there are no labelled pages; all of them stand in COSTS below.
The reader of tags goes over a page once: its time is in proportion to the page, whatever that holds.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

#: Elements whose whole contents are not text of the page: scripts, styles, the head, fields of forms, frames.
SKIPPED = frozenset("script style noscript template iframe head title select textarea".split())
#: Of these, those whose contents are raw characters up to the end tag.
RAW = frozenset("script style textarea title iframe noscript".split())
#: What may stand in the head; any other start tag ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q ruby rb rp rt s samp small span strike strong sub sup svg time tt u var wbr img nobr mi mn mo mrow ms msqrt msub msup mtext mfrac semantics text tspan object".split())
#: A start tag of these ends an open p.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag of the key ends an open element of these up to the one in the second place.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
FURNITURE = frozenset("nav aside footer form button menu dialog".split())
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|adslot|banner|promo\w*|sponsor\w*|sidebar\w*|side-?bar|menu\w*|nav|navbar|navigation|breadcrumb\w*|footer|foot|header|masthead|topbar|cookie\w*|consent|gdpr|notice\w*|alert"
    r"|popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-?in|login|share|sharing|social|related|recommend\w*|comment\w*|reply|replies|respond|disqus|discussion|reader-\w+|pagination|pager|widget\w*|search|toolbar|skip|legal|copyright|disclaimer)(?=$|[\s_-])"
)
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?=$|[\s_-])")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
COSTS = {
    "article": 3.0, "main": 2.0, "good": 1.0, "furniture": -6.0, "bad": -6.0, "page_header": -5.0, "own_header": -1.0, "hidden": -6.0,
    "paragraph": 0.8, "heading": 0.8, "item": -0.3, "words": 0.35, "few": 2.0, "sentence": 0.6, "links": -3.0, "rights": -4.0,
    "neighbour": 0.3, "siblings": 1.0, "across": 0.05,
}
#: Bounds of what tags and names tell.
TOLD = (-6.0, 4.0)
TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s=/>]*)(\s*=\s*)?")
VALUE = re.compile(r"[^\s>]*")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACES = re.compile(r"\s+")
SENTENCE = re.compile(r"[.!?…][\"'»”)]?(?:\s|$)")
RIGHTS = re.compile(r"(?:©|\(c\)|copyright)", re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


class Node:
    """An open element, with what it has from those around it."""

    __slots__ = ("tag", "parent", "told", "article", "container", "number", "open")

    def __init__(self, tag: str, parent: Node | None, names: str, role: str, hidden: bool, number: int):
        c = COSTS
        self.tag, self.parent, self.number, self.open = tag, parent, number, True
        self.told = parent.told if parent else 0.0
        self.article = tag == "article" or bool(parent and parent.article)
        self.container = parent.container if parent else 0
        if tag == "article" and not (parent and parent.article):
            self.told += c["article"]
        elif tag == "main" or role == "main":
            self.told += c["main"]
        elif tag in FURNITURE or role in ROLES:
            self.told += c["furniture"]
        elif hidden:
            self.told += c["hidden"]
        elif tag == "header":
            self.told += c["own_header"] if self.article else c["page_header"]
        elif names and tag not in ("body", "html") and BAD_NAME.search(names):
            self.told += c["bad"]
        elif names and GOOD_NAME.search(names):
            self.told += c["good"]
        if tag in FURNITURE or tag in ("article", "main", "header", "section") or tag == "div" and names:
            self.container = number


class Block:
    __slots__ = ("text", "links", "node")

    def __init__(self, text: str, links: int, node: Node):
        self.text, self.links, self.node = text, links, node


def read_tag(page: str, at: int, last: dict[str, int]) -> tuple[int, dict[str, str], bool]:
    """From behind a tag's name: where the tag ends (-1: never), its attributes that matter, whether it ends with a slash.

    A quoted value ends at its quote. Where there is none, or where the value holds a > and what follows the quote can't follow
    a value, the quote was never meant to reach so far and the tag ends at the first >.
    """
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, at)
        if not m:
            end = page.find(">", at)
            return end + 1 if end >= 0 else -1, found, page[end - 1] == "/"
        name, at = m[1], m.end()
        value = ""
        if m[2]:
            quote = page[at : at + 1]
            if quote and quote in "\"'":
                end = page.find(quote, at + 1) if at < last[quote] else -1
                value = page[at + 1 : end] if end >= 0 else ""
                if end < 0 or ">" in value and page[end + 1 : end + 2] not in (" ", "\t", "\n", "\r", "\f", "/", ">", ""):
                    end = page.find(">", at)
                    return end + 1 if end >= 0 else -1, found, False
                at = end + 1
            else:
                v = VALUE.match(page, at)
                value, at = v[0], v.end()
        if len(name) < 12 and (name := name.lower()) in ("class", "id", "role", "hidden", "aria-hidden", "style") and name not in found:
            found[name] = value.lower()


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    stack = [Node("", None, "", "", False, 0)]
    opened: dict[str, list[int]] = defaultdict(list)  # of each tag: places in the stack
    block_level = [0]  # places in the stack of what isn't inline
    last = {q: page.rfind(q) for q in "\"'"}
    parts: list[str] = []
    counter = at = links = linked = skipped = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, linked, stack[block_level[-1]]))
            parts.clear()
        linked = 0

    def shut(node: Node) -> None:
        nonlocal links, skipped
        node.open = False
        opened[node.tag].pop()
        links -= node.tag == "a"
        skipped -= node.tag in SKIPPED

    def close(k: int) -> None:
        while len(stack) > k:
            node = stack.pop()
            if block_level[-1] == len(stack):
                block_level.pop()
            if node.open:
                shut(node)

    def nearest(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    while True:
        lt = page.find("<", at)
        if not skipped and lt != at and (text := page[at : lt if lt >= 0 else len(page)]):
            parts.append(text)
            linked += len(text) * (links > 0)
        if lt < 0:
            break
        ends = page[lt + 1 : lt + 2] == "/"
        m = TAG_NAME.match(page, lt + 1 + ends)
        if not m:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = end + 3
            elif ends or page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt)
                at = end + 1
            else:
                if not skipped:
                    parts.append("<")
                end, at = lt, lt + 1
            if end < 0:
                break
            continue
        tag = m[0].lower()
        if ends:
            end = page.find(">", m.end())
            if end < 0:
                break
            at = end + 1
            if tag not in INLINE:
                flush()
            if opened.get(tag):
                k = opened[tag][-1]
                if tag not in INLINE or block_level[-1] < k:
                    close(k)
                else:  # a misplaced end of an inline element ends that one only
                    shut(stack[k])
            continue
        at, found, slash = read_tag(page, m.end(), last)
        if at < 0:
            break
        if opened.get("head") and tag not in IN_HEAD:
            close(opened["head"][-1])
        if tag not in INLINE:
            flush()
        if tag in ENDS_P and opened.get("p") and opened["p"][-1] > nearest(("table", "button")):
            close(opened["p"][-1])
        if tag in IMPLIED and (k := nearest(IMPLIED[tag][0])) > nearest(IMPLIED[tag][1]):
            close(k)
        if tag in VOID or slash:
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            if not end:
                break
            at = end.end()
            continue
        counter += 1
        names = " ".join(found[x] for x in ("class", "id") if x in found)
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "style" in found and bool(HIDING.search(found["style"]))
        opened[tag].append(len(stack))
        if tag not in INLINE:
            block_level.append(len(stack))
        stack.append(Node(tag, stack[-1], names, found.get("role", ""), hidden, counter))
        links += tag == "a"
        skipped += tag in SKIPPED
    flush()
    return out


def evidence(b: Block) -> float:
    """How much speaks for content: the log-odds of the classifier."""
    c = COSTS
    s = min(max(b.node.told, TOLD[0]), TOLD[1])
    last = b.node.tag
    s += c["paragraph"] * (last in ("p", "pre", "blockquote")) + c["heading"] * (last in ("h1", "h2", "h3", "h4", "h5", "h6")) + c["item"] * (last == "li")
    words = b.text.count(" ") + 1
    s += c["words"] * (min(words, 60) ** 0.5 - c["few"]) + c["sentence"] * bool(SENTENCE.search(b.text))
    s += c["links"] * min(1.0, b.links / max(1, len(b.text)))
    if not b.node.article and RIGHTS.match(b.text):
        s += c["rights"]
    return s


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: block i pays gain[i] as boilerplate if that is positive, -gain[i] as content if negative, and
    each edge its weight where its ends differ. Dinic's maximum flow; content is what the source still reaches."""
    n = len(gain)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(u: int, v: int, c: float, back: float) -> None:
        out[u].append(len(to))
        to.append(v)
        cap.append(c)
        out[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, g in enumerate(gain):
        if g >= 0:
            arc(s, i, g, 0.0)
        else:
            arc(i, t, -g, 0.0)
    for u, v, w in edges:
        arc(u, v, w, w)
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
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[u] < len(out[u]):
                e = out[u][nxt[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(out[u]):
                path.append(out[u][nxt[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                nxt[u] += 1
            else:
                break


def label(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """What `min_cut` gives for the whole graph. A block whose own evidence outweighs all its edges has the label of its sign in
    some least cut: it is settled, and pulls its neighbours by the weights of their edges. What is left undecided falls into
    parts without edges between them, each of which is cut by itself."""
    n = len(gain)
    pull, near = list(gain), defaultdict(list)
    weight = [0.0] * n  # of the edges to undecided neighbours
    for u, v, w in edges:
        near[u].append((v, w))
        near[v].append((u, w))
        weight[u] += w
        weight[v] += w
    out: list[bool | None] = [None] * n
    queue = deque(i for i in range(n) if abs(pull[i]) >= weight[i])
    while queue:
        i = queue.popleft()
        if out[i] is not None:
            continue
        out[i] = pull[i] >= 0
        for j, w in near[i]:
            if out[j] is None:
                pull[j] += w if out[i] else -w
                weight[j] -= w
                if abs(pull[j]) >= weight[j] - 1e-9:
                    queue.append(j)
    for i in range(n):
        if out[i] is None:
            part, seen = [i], {i: 0}
            for u in part:
                for v, _ in near[u]:
                    if out[v] is None and v not in seen:
                        seen[v] = len(part)
                        part.append(v)
            inside = [(seen[u], seen[v], w) for u in part for v, w in near[u] if out[v] is None and u < v]
            for u, keep in zip(part, min_cut([pull[u] for u in part], inside)):
                out[u] = keep
    return out


def graph(bs: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    gain = [evidence(b) for b in bs]
    where = [b.node.container for b in bs]
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        if i:
            edges.append((i - 1, i, COSTS["neighbour"] if where[i] == where[i - 1] else COSTS["across"]))
        parent = b.node.parent.number if b.node.parent else -1
        j = last.get(parent)
        if j is not None:
            edges.append((j, i, COSTS["siblings"] if where[i] == where[j] else COSTS["across"]))
        last[parent] = i
    return gain, edges


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by one space; empty for a null, empty or wordless page."""
    bs = blocks(page or "")
    if not bs:
        return ""
    return " ".join(b.text for b, keep in zip(bs, label(*graph(bs))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html). Nothing is shuffled.

    A null, empty or wordless page has an empty text. Null ids and URLs stay null, repeated rows are each returned, an empty
    table gives an empty result, other columns are not looked at. Long pages are read whole; blocks at a tie are content.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html"))
    return rows.mapInArrow(lean(run), f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
