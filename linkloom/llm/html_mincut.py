"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier over each block's tags, names, length and links gives its cost
as content and as boilerplate, which become the capacities of its edges to the two terminals. Edges between successive
blocks, stronger the nearer their places in the document tree, between blocks of one parent, and between blocks whose
tags repeat on the page make the labels smooth. The minimum cut, found by maximum flow, is the cheapest labelling, and
the blocks on the source's side are the text.

The classifier is fitted by self-training, as pages have no labels: from weights that are given, a bounded sample of
pages is labelled by the cut, and the weights are fitted to these labels, drawn towards the given ones, in rounds.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tables import table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
BLANKS = re.compile(r"\s+")
UNSEEN = frozenset("script style head title noscript template iframe svg object canvas form select textarea button option datalist audio video map".split())
RAW = frozenset("script style title textarea noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover semantics".split())
#: What an opening tag closes, if it is open inside the nearest of the tags after it.
CLOSES = {"li": ("li", "ul", "ol", "menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr"), "th": ("td th", "tr"), "option": ("option", "select")}
CONTENT = frozenset("article main articlebody post entry story content maintext".split())
#: Names of parts that are never the article, and of parts that are not unless they are inside it, such as its own header.
AROUND = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion sidebar nav navigation navbar breadcrumb breadcrumbs masthead topbar toolbar cookie cookies consent popup modal "
    "newsletter subscribe signup login share sharing social related recommended widget widgets comment comments disqus discussion respond reply replies pagination pager".split()
)
OUTSIDE = frozenset("banner side menu footer foot header notice notification alert copyright legal disclaimer search skip tags meta".split())
#: What the classifier sees of a block, and the weights that it starts from, in units of log odds for content.
WEIGHTS = {"bias": -0.4, "in_content": 2.6, "around_tag": -5.0, "header_tag": -3.0, "around_name": -6.5, "outside_name": -4.5, "heading": 0.6, "paragraph": 0.7, "item": -0.3, "length": 0.8, "links": -3.0}
#: Weights of edges: between successive blocks, more for near places in the tree; to the last block of one parent; to the last one with the same tags around it.
NEXT_TO, SAME_PARENT, SIBLING, SAME_TAGS = 0.25, 0.7, 0.2, 0.1
#: Pages that the classifier is fitted on at most, rounds, and how many blocks the given weights count as.
SAMPLE_PAGES, ROUNDS, GIVEN = 300, 2, 500.0


class Node:
    """An element of the tree: its parent, depth, and a number for the tags from the root to it."""

    __slots__ = ("depth", "parent", "tags")

    def __init__(self, parent: Node | None, tag: str):
        self.parent, self.depth, self.tags = parent, parent.depth + 1 if parent else 0, hash((parent.tags, tag)) if parent else 0


def steps_up(a: Node, b: Node) -> int:
    """How far the farther of two elements is below the nearest one that holds both."""
    x, y = a, b
    while x is not y:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
    return max(a.depth, b.depth) - x.depth


class Block:
    __slots__ = ("around", "content", "header", "links", "node", "parts", "tag")

    def __init__(self, node: Node, tag: str, content: bool, around: tuple[bool, bool, bool], header: bool):
        self.parts, self.links, self.node, self.tag, self.content, self.around, self.header = [], 0, node, tag, content, around, header


class Open:
    """An open tag, with what holds inside it."""

    __slots__ = ("content", "header", "link", "name", "node", "node_tag", "outside", "tag", "under", "unseen")

    def __init__(self, tag: str = "", above: Open | None = None, node: Node | None = None):
        self.tag, self.node_tag, self.node = tag, above.node_tag if above else "", node or (above.node if above else Node(None, ""))
        self.content, self.under, self.name, self.outside, self.header, self.unseen, self.link = (above.content, above.under, above.name, above.outside, above.header, above.unseen, above.link) if above else (False,) * 7


def blocks_of(page: str) -> list[tuple[str, Block]]:
    """Blocks of shown text in page order, white space made single spaces, with what the classifier needs."""
    out: list[Block] = []
    stack: list[Open] = [Open()]
    n_open: dict[str, int] = {}
    fresh = True

    def say(text: str) -> None:
        nonlocal fresh
        top = stack[-1]
        if top.unseen or not text:
            return
        if fresh:
            if text.isspace():
                return
            out.append(Block(top.node, top.node_tag, top.content, (top.under, top.name, top.outside), top.header))
            fresh = False
        out[-1].parts.append(text)
        if top.link:
            out[-1].links += len(text)

    def close(k: int) -> None:
        """Close the open tags from the k-th on."""
        nonlocal fresh
        for o in stack[k:]:
            n_open[o.tag] -= 1
            fresh = fresh or o.tag not in INLINE
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if n_open.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            else:
                fresh = fresh or tag not in INLINE
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            fresh = fresh or tag not in INLINE
            continue
        if tag not in INLINE:
            fresh = True
            ends, *walls = CLOSES.get(tag, ("p", "button", "table", "td", "th", "li", "div", "section", "article"))
            ends = ends.split()
            if any(n_open.get(e) for e in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        close(k)
                        break
                    if stack[k].tag in walls:
                        break
        top = stack[-1]
        names = {w for x in NAMES.findall(m[3]) for w in WORD.findall("".join(x).lower())} if m[3] != ">" else ()
        new = Open(tag, top, None if tag in INLINE else Node(top.node, tag))
        if tag not in INLINE:
            new.node_tag = tag
        new.content |= tag in ("article", "main") or any(w in CONTENT for w in names)
        new.header |= tag == "header" and not top.content
        new.under |= tag in ("nav", "footer", "aside", "menu", "dialog")
        new.name |= any(w in AROUND for w in names)
        new.outside |= not top.content and not new.content and any(w in OUTSIDE for w in names)
        new.unseen |= tag in UNSEEN
        new.link |= tag == "a"
        if m[3].endswith("/>") and tag not in INLINE:
            continue
        stack.append(new)
        n_open[tag] = n_open.get(tag, 0) + 1
        if tag in RAW:
            ending = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = ending.start() if ending else end
    found = []
    for b in out:
        text = BLANKS.sub(" ", html.unescape("".join(b.parts))).strip()
        if text:
            found.append((text, b))
    return found


def seen_of(text: str, b: Block) -> list[float]:
    """What the classifier sees of a block, in the order of WEIGHTS."""
    kind = "heading" if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else "paragraph" if b.tag in ("p", "blockquote", "pre") else "item" if b.tag in ("li", "td") else ""
    x = {"bias": 1.0, "length": min(len(text) / 100, 2.0), "links": min(1.0, b.links / len(text)), "in_content": b.content, "header_tag": b.header, kind: 1.0}
    x |= {"around_tag": b.around[0], "around_name": b.around[1], "outside_name": b.around[2]}
    return [float(x.get(k, 0.0)) for k in WEIGHTS]


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges of nearness in the tree; three a block at most, so a page of any length has few."""
    edges = [(k, k + 1, NEXT_TO + SAME_PARENT * 0.5 ** max(0, min(60, steps_up(blocks[k].node, blocks[k + 1].node) - 1))) for k in range(len(blocks) - 1)]
    by_parent: dict[int, int] = {}
    by_tags: dict[int, int] = {}
    for k, b in enumerate(blocks):
        for last, key, weight in ((by_parent, id(b.node.parent), SIBLING), (by_tags, b.node.tags, SAME_TAGS)):
            if key in last and last[key] < k - 1:
                edges.append((last[key], k, weight))
            last[key] = k
    return edges


def source_side(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes a minimum cut leaves with the source; edges go both ways. Dinic's maximum flow."""
    n = len(source)
    s, t = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, ab: float, ba: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((ab, ba))

    for k in range(n):
        through = min(source[k], sink[k])  # flows straight on
        if source[k] > through:
            edge(s, k, source[k] - through, 0.0)
        else:
            edge(k, t, sink[k] - through, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        place = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
            while place[a] < len(out[a]):
                e = out[a][place[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                place[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                place[a] += 1


def labels_of(blocks: list[tuple[str, Block]], weights: np.ndarray) -> list[bool]:
    """Which blocks the minimum cut calls content."""
    odds = (np.array([seen_of(t, b) for t, b in blocks]) @ weights).tolist()
    cost = lambda x: math.log1p(math.exp(min(x, 500.0)))
    return source_side([cost(x) for x in odds], [cost(-x) for x in odds], edges_of([b for _, b in blocks]))


def given_weights() -> np.ndarray:
    return np.array(list(WEIGHTS.values()))


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    """Blocks that the minimum cut calls content, in page order, one a line."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    kept = labels_of(blocks, given_weights() if weights is None else weights)
    return "\n".join(t for (t, _), k in zip(blocks, kept, strict=True) if k)


def regression(seen: np.ndarray, labels: np.ndarray, times: np.ndarray, given: float = GIVEN) -> np.ndarray:
    """Weights of a logistic regression, drawn towards WEIGHTS as by so many rows; Newton's method."""
    start = w = given_weights()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(seen @ w, -30, 30)))
        slope = seen.T @ (times * (p - labels)) + given * (w - start) / 10
        bend = (seen * (times * p * (1 - p))[:, None]).T @ seen + np.eye(len(w)) * given / 10
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, rounds: int = ROUNDS) -> np.ndarray:
    """The classifier's weights, self-trained on at most sample_pages pages, those with the smallest hash.

    Pages are labelled in the tasks; what comes back are counts of the different (seen, label) of their blocks.
    """
    sample = pages.select(F.col(f"`{html_col}`").alias("html")).where("html is not null").orderBy(F.xxhash64("html"), "html").limit(sample_pages)
    weights = given_weights()
    for _ in range(rounds):

        def label(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for page in batch.column(0).to_pylist():
                    blocks = blocks_of(page)
                    rows = [([round(v, 2) for v in seen_of(t, b)], k) for (t, b), k in zip(blocks, labels_of(blocks, weights), strict=True)] if blocks else []
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([int(r[1]) for r in rows], pa.int32())], names=["seen", "label"])

        found = sample.mapInArrow(label, "seen array<double>, label int").groupBy("seen", "label").agg(F.count("*").alias("times")).orderBy("seen", "label").collect()
        if found:
            weights = regression(np.array([r["seen"] for r in found]), np.array([r["label"] for r in found]), np.array([r["times"] for r in found], float))
    return weights


def extract_text(pages: DataFrame, html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """pages with text, the main text of html_col, and n_chars, its code points.

    Scripts, styles, the head, forms and markup never count; menus, headers, footers, sidebars, notices, adverts and
    reader comments are left to the cut. Character references are decoded, white space inside a block becomes one
    space (a line break too), blocks are joined by one newline, and nothing is capped. weights come from fit(); the
    given ones without.

    Defined cases: a null or empty page, and one without content, has an empty text; a page of any length is read whole,
    however deep its tags; rows that repeat get the same result; equal costs go to boilerplate; an empty table gives an
    empty table. Other columns pass through, whatever their names; text and n_chars replace columns of those names.
    """

    @F.pandas_udf("string")
    def extract(values: pd.Series) -> pd.Series:
        return pd.Series([main_text(v, weights) for v in values], dtype=object)

    return pages.withColumn("text", extract(F.col(f"`{html_col}`"))).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, weights=fit(pages)).select("page_id", "url", "text", "n_chars")
