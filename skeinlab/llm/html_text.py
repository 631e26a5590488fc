"""Main text of HTML pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A logistic classifier prices each block as content and as boilerplate:
these are the capacities to the two terminals. Neighbours in the page and in the document tree are tied by
smoothness edges, weaker the further apart they are in the tree. The minimum cut, found by maximum flow,
separates content from boilerplate at the least total cost."""

from __future__ import annotations

import html as html_module
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlab.llm import common

TRAIN_PAGES = 400  # expected size of the sample of pages that the classifier is fitted on
TRAIN_BLOCKS = 200  # of a sampled page, spread evenly over it
NEAR, SIBLING = 0.8, 0.4  # smoothness of neighbours in the page and of next siblings in the tree
EVIDENCE = 2.0  # log-odds that an article or main element adds, or takes where a page has one elsewhere
ELEMENT = 7.0  # log-odds that a boilerplate element or a hidden one takes
NAMED, PART_NAMED = 4.5, 2.5  # log-odds that a class or id takes whose words are all, or only in part, names of boilerplate
LIMIT = 3.0  # the classifier's log-odds are kept within +-LIMIT

# HTML element names and name parts that mark boilerplate or content.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "annotation", "annotation-xml", "textarea", "title", "canvas", "audio", "video", "select", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NOT_TEXT = {"nav", "footer", "aside", "form", "button", "dialog", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NOISE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "sidebar", "aside", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "newsletter",
    "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "widget", "widgets", "pagination", "pager", "toolbar", "copyright", "footer", "masthead", "skip", "search",
}
LAYOUT = {"has", "with", "no", "without", "not"}  # before a name part: the page's layout, not the element's own role

_attr = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_token = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_attr}|[^>]*)>|<[!?][^>]*>", re.S)
_pairs = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_parts = re.compile(r"[a-z]+|[0-9]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_end_of = {t: re.compile(rf"</{t}\b[^>]*>|\Z", re.I) for t in RAW}
_unquoted = re.compile(r"""=\s*[^\s"']*/\Z""").search  # <svg a=b/> is not an empty element
_closes = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    """An open element: its depth, parent, and what it says about the text below it."""

    __slots__ = ("tag", "parent", "depth", "noise", "article", "last", "cost", "size", "holds")

    def __init__(self, tag: str, parent: "Node | None", noise: bool, article: bool, cost: float = 0.0):
        self.tag, self.parent, self.noise, self.article, self.cost = tag, parent, noise, article, cost
        self.size, self.holds = 0, set()  # characters below it outside boilerplate elements, and article and main if below it
        self.depth = parent.depth + 1 if parent else 0
        self.last: int | None = None  # the last block right below it


class BlockOfText:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked

    @property
    def noise(self) -> bool:
        return self.node.noise

    @property
    def article(self) -> bool:
        return self.node.article

    @property
    def cost(self) -> float:
        return self.node.cost


def _is_noise(tag: str, attrs: str) -> bool:
    if tag in NOT_TEXT:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _pairs.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def _name_cost(tag: str, attrs: str) -> float:
    """What the words of the class and id take. The id of a heading names its topic, not its role."""
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0.0
    cost = 0.0
    for name, value in _pairs.findall(attrs):
        name = name.lower()
        if name == "class" or (name == "id" and not (tag[:1] == "h" and tag[1:].isdigit())):
            for one in value.strip("\"'").split():
                parts = [x.lower() for x in _parts.findall(one) if not x.isdigit()]
                found = [p in NOISE and before not in LAYOUT for before, p in zip(["", *parts], parts, strict=False)]
                if any(found):
                    cost = max(cost, NAMED if all(found) else PART_NAMED)
    return cost


def _weigh(nodes: list[Node], blocks: list[BlockOfText]) -> None:
    """Sets cost and article of the nodes (parents come first), which hold for all text below.

    A main below takes a name's cost away, and so do two of these: an article below, most of the page's text
    below, a name only in part. Below a full name that stands an article is no evidence."""
    for b in blocks:
        b.node.size += 0 if b.node.noise else len(b.text)
    for x in reversed(nodes):
        if x.parent:
            x.parent.size += x.size
            if not x.noise:
                x.parent.holds |= x.holds | ({x.tag} & {"article", "main"})
    for x in nodes:
        if x.parent:
            if "main" in x.holds or (x.cost < NAMED) + ("article" in x.holds) + (2 * x.size > nodes[0].size) >= 2:
                x.cost = 0.0
            x.cost = max(x.cost, x.parent.cost)
            x.article = x.cost < NAMED and (x.parent.article or x.tag in ("article", "main"))


def blocks_of(page: str) -> list[BlockOfText]:
    """The page's blocks of text in order. Malformed mark-up never fails: open elements end with the page,
    stray end tags are passed over, a p ends where a block begins."""
    top = node = Node("", None, False, False)
    nodes = [top]
    out: list[BlockOfText] = []
    held: list[str] = []
    in_link, linked, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_module.unescape("".join(held)).split()) if held else ""
        if text:
            out.append(BlockOfText(text, node, min(linked, len(text))))
        held.clear()
        linked = 0

    def words(raw: str) -> None:
        nonlocal linked
        if raw:
            held.append(raw)
            if in_link:
                linked += len(raw)

    n, last, find = len(page), page.rfind(">") + 1, _token.search
    while at < n:
        m = find(page, at, last)  # what no > follows is text
        if not m:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCK:
                flush()
                x = node
                while x is not top and x.tag != tag:
                    x = x.parent
                if x is not top:
                    node = x.parent
            continue
        if tag == "svg" and m[3].endswith("/") and not _unquoted(m[3]):
            words(" ")
            continue
        if tag in RAW:
            at = _end_of[tag].search(page, at).end() if tag != "head" else at
            if tag not in ("title", "head", "script", "style"):
                words(" ")
            continue
        if tag == "br":
            words(" ")
        elif tag == "a":
            in_link += 1
        elif tag == "img":
            words(" ")
        elif tag in BLOCK:
            flush()
            in_link = 0
            if node.tag == "p":
                node = node.parent
            if tag in _closes and node.tag in _closes[tag]:
                node = node.parent
            if tag != "hr":
                noise = node.noise or _is_noise(tag, m[3]) or (tag == "header" and not node.article)
                node = Node(tag, node, noise, node.article or tag in ("article", "main"), _name_cost(tag, m[3]))
                nodes.append(node)
    flush()
    _weigh(nodes, out)
    return out


NAMES = ("bias", "length", "linked", "full stops", "words", "heading", "paragraph", "item", "sign", "place")


def features(blocks: list[BlockOfText]) -> np.ndarray:
    """Properties of the text of each block; where it stands in the tree is left to the other costs."""
    rows = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        rows.append(
            (
                1.0,
                np.log1p(n) / 5,
                b.linked / n,
                min(1.0, 40 * sum(map(b.text.count, ".!?;,")) / n),
                min(3.0, (b.text.count(" ") + 1) / 20),
                b.node.tag[:1] == "h" and b.node.tag[1:].isdigit(),
                b.node.tag in ("p", "blockquote", "pre"),
                b.node.tag in ("li", "td", "th", "dt", "dd", "option"),
                "©" in b.text or "·" in b.text or "|" in b.text,
                i / len(blocks),
            )
        )
    return np.array(rows, dtype=float).reshape(-1, len(NAMES))


PRIOR = np.array([-1.0, 0.5, -3.0, 1.0, 1.0, 0.5, 1.0, -0.5, -1.0, 0.0])  # what the fit is drawn to, and where no page teaches


def fit(pages: DataFrame, sample: int = TRAIN_PAGES, strength: float = 1.0) -> np.ndarray:
    """Weights of the classifier. Blocks that their mark-up gives away teach it: those below boilerplate
    elements and names, and those below an article or main element. A bounded sample of pages is read."""
    n, unit = pages.count(), 1 << 40
    chosen = pages.filter(F.pmod(F.xxhash64("page_id", "html", F.lit(29)), F.lit(unit)) < int(min(1.0, sample / max(1, n)) * unit) + 1)

    def rows(batches):
        for b in batches:
            x, y = [], []
            for page in b.column("html").to_pylist():
                blocks = blocks_of(page or "")
                known = [k for k, one in enumerate(blocks) if one.noise or one.cost or one.article]
                known = known[:: -(-len(known) // TRAIN_BLOCKS) or 1]
                x += features(blocks)[known].tolist()
                y += [not (blocks[k].noise or blocks[k].cost) for k in known]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.bool_())], names=["x", "y"])

    got = chosen.select("html").mapInArrow(rows, "x array<double>, y boolean").toArrow()
    if not got.num_rows:
        return PRIOR
    x = np.array(got.column("x").to_pylist())
    y = np.array(got.column("y").to_pylist(), dtype=float)
    order = np.lexsort(x.T)  # the same sums in whatever order the rows came
    x, y, w = x[order], y[order], PRIOR.copy()
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())) * 200
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (weight * (p - y)) + strength * (w - PRIOR))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def cut(gain: list[float], edges: dict[int, dict[int, float]]) -> list[bool]:
    """Least-cost labels: node i earns gain[i] as content, an edge costs its weight where labels differ.

    Nodes whose gain outweighs all their undecided edges are decided first, which changes no optimum; what is
    left goes to maximum flow. Content is what the source still reaches: on ties the smaller set."""
    n, unit = len(gain), 1 << 20
    g = [round(x * unit) for x in gain]
    near = [{j: round(w * unit) for j, w in edges.get(i, {}).items()} for i in range(n)]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None:
            continue
        total = sum(near[i].values())
        if g[i] > total or -g[i] >= total:
            label[i] = g[i] > total
            for j, w in near[i].items():
                g[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    for i, content in zip(rest, _max_flow([g[i] for i in rest], _renumbered(rest, near)), strict=True):
        label[i] = content
    return [bool(x) for x in label]


def _renumbered(rest: list[int], near: list[dict[int, int]]) -> list[dict[int, int]]:
    place = {i: k for k, i in enumerate(rest)}
    return [{place[j]: w for j, w in near[i].items()} for i in rest]


def _max_flow(gain: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Source side of the minimum cut with terminal capacities max(gain, 0) and max(-gain, 0): Dinic's levels.

    Arc e and its reverse are e and e ^ 1. In a phase each node goes on with the arc it came to last, and after an
    augmentation the search goes on from the tail of the first arc that is full."""
    n = len(gain)
    s, t = n, n + 1
    out: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    cap: list[int] = []

    def arc(u: int, v: int, there: int, back: int) -> None:
        out[u].append(len(head))
        out[v].append(len(head) + 1)
        head.extend((v, u))
        cap.extend((there, back))

    for i, x in enumerate(gain):
        if x > 0:
            arc(s, i, x, 0)
        elif x < 0:
            arc(i, t, -x, 0)
        for j, w in near[i].items():
            if i < j:
                arc(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                low = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= low
                    cap[e ^ 1] += low
                first = next(k for k, e in enumerate(path) if not cap[e])
                u = head[path[first] ^ 1]
                del path[first:]
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if cap[e] and level[head[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(out[u]):
                path.append(e)
                u = head[e]
            elif u == s:
                break
            else:
                u = head[path.pop() ^ 1]
                at[u] += 1


def tree_distance(a: Node, b: Node) -> int:
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


def labels(blocks: list[BlockOfText], weights: np.ndarray) -> list[bool]:
    """Which blocks are content. Elements, names and the classifier all add to the capacities of the terminals."""
    if not blocks:
        return []
    odds = np.clip(features(blocks) @ weights, -LIMIT, LIMIT)
    marked = any(b.article and not b.noise for b in blocks)
    gain, edges = [], {}
    for i, b in enumerate(blocks):
        marks = EVIDENCE if b.article and not b.noise else -EVIDENCE if marked else 0.0
        gain.append(float(odds[i]) + marks - max(b.cost, ELEMENT if b.noise else 0.0))
        tied = {}
        if i:
            tied[i - 1] = NEAR / (1 + tree_distance(blocks[i - 1].node, b.node))
        up = b.node.parent or b.node
        if up.last is not None:
            tied[up.last] = max(tied.get(up.last, 0.0), SIBLING)
        up.last = i
        for j, w in tied.items():
            edges.setdefault(i, {})[j] = w
            edges.setdefault(j, {})[i] = w
    return cut(gain, edges)


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, content in zip(blocks, labels(blocks, weights), strict=True) if content)


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page row; null, empty and text-free pages give ''.

    Rows are independent: no shuffle, one page at a time in memory. Repeated rows repeat; extra columns are
    not read. Character references are decoded once, white space in a block is one space."""
    weights = fit(pages) if weights is None else weights

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 128):
                b = big.slice(at, 128)
                text = [main_text(page, weights) for page in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page; nulls, empty and repeated rows as in extract. An empty table gives
    no rows; a page of any length is read whole."""
    return extract(common.table(spark, sf_dir, "pages"))
