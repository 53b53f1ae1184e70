"""Main text of web pages by minimum-cut labelling (operator 7).

A page becomes a row of text blocks.  A logistic model over each block's
elements, names, length, punctuation and share of link text, fitted on labelled
pages (:mod:`.html_pages`), gives its two costs: calling it content and calling
it boilerplate.  These are the capacities to the source and the sink;
neighbours in page order and blocks of one parent are tied by smoothness edges
whose weight falls with their distance in the tree.  The minimum cut, found by
maximum flow, is the cheapest labelling; what stays with the source is the main
text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, small_batches

#: A quoted value may hold ``>``, but only if what follows the closing quote can stand there: a stray quote ends nothing.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>=\s*+"[^"<]*+"(?=[\s/>])|=\s*+'[^'<]*+'(?=[\s/>])|[^>])*+)(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|\baria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z]+")
_END = re.compile(r"[.!?…。！？](?=\s|$|[\"'”’)])")

#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br input".split())
#: Elements that a new one closes, if one of them is open.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
LISTS = frozenset("ul ol dl table".split())
#: Block elements that end an open paragraph.
ENDS_P = frozenset("p div ul ol dl table section article aside header footer nav main form fieldset h1 h2 h3 h4 h5 h6 pre blockquote hr figure address details".split())

#: Elements and names (words of a class, id or role) that the model counts; their weights are fitted.
BOILER = frozenset("nav footer aside form menu dialog button".split())
ARTICLE = frozenset("article main".split())
BAD_NAMES = frozenset("nav navigation navbar menu menubar breadcrumb breadcrumbs sidebar footer masthead banner ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent notice notices alert popup modal newsletter subscribe signup login share sharing social related recommended widget pagination pager toolbar copyright disqus complementary contentinfo search".split())
GOOD_NAMES = frozenset("article content main post entry story body text prose".split())
COMMENT_NAMES = frozenset("comment comments respond replies reply discussion".split())
#: Evidence about a block, as bits that elements hand down.
IN_ARTICLE, IN_BOILER, IN_HEADER, BAD, GOOD, COMMENTS, HIDDEN = (1 << k for k in range(7))

ADJACENT, SIBLING = 1.0, 1.5


class Element:
    """An open element: its evidence (with all that its parents have) and the sign of the innermost."""

    __slots__ = ("name", "parent", "depth", "bits", "near", "inline")

    def __init__(self, name: str, parent: Element | None, attrs: str):
        self.name, self.parent, self.inline = name, parent, name in INLINE
        self.depth = parent.depth + (not self.inline) if parent else 0
        bits, sign = 0, 0
        if name in ARTICLE:
            bits, sign = IN_ARTICLE, 1
        elif name in BOILER:
            bits, sign = IN_BOILER, -1
        elif name == "header":
            bits = IN_HEADER
        if attrs:
            if name not in ("article", "main", "body", "html"):  # there names tell of the page's state
                words = {w for m in _NAMES.finditer(attrs) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())}
                good, bad, said = bool(words & GOOD_NAMES), bool(words & BAD_NAMES), bool(words & COMMENT_NAMES)
                bits |= GOOD * good | BAD * bad | COMMENTS * said | IN_HEADER * ("header" in words)
                sign = -1 if (bad or said) and not (good and not said) else 1 if good and not said else sign
            if _HIDDEN.search(attrs):
                bits |= HIDDEN
        self.bits = bits | (parent.bits if parent else 0)
        self.near = sign or (parent.near if parent else 0)


_ROOT = Element("", None, "")


class Block:
    """A run of text inside one block element."""

    __slots__ = ("text", "link", "element")

    def __init__(self, text: str, link: int, element: Element):
        self.text, self.link, self.element = text, link, element


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, from the raw markup (broken markup included); time and space follow its length."""
    out: list[Block] = []
    stack: list[Element] = [_ROOT]
    solid: list[int] = [0]  # where in the stack the block elements are
    opened: Counter[str] = Counter()
    parts: list[str] = []
    link = at = 0
    n = len(page)

    def flush() -> None:
        nonlocal parts, link
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, link, stack[solid[-1]]))
        parts, link = [], 0

    def pop(k: int) -> None:
        if solid[-1] >= k:
            flush()
            while solid[-1] >= k:
                solid.pop()
        for e in stack[k:]:
            opened[e.name] -= 1
        del stack[k:]

    def close(names: tuple[str, ...], until: frozenset[str] = frozenset()) -> bool:
        if not any(opened[x] for x in names):
            return False
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                pop(k)
                return True
            if stack[k].name in until:
                return False
        return False

    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            piece = page[at:end]
            parts.append(piece)
            if opened["a"]:
                link += len(piece.strip())
        if not m:
            break
        at = max(m.end(), m.start() + 1)
        if m[3] is None:
            if m[1]:
                parts.append(html.escape(m[1]))
            continue
        name = m[3].lower()
        if name == "br":
            parts.append(" ")
        elif m[2]:
            if not close((name,)) and name not in INLINE:
                flush()
        elif name in VOID:
            if name == "hr":
                flush()
        elif name in RAW:
            if not m[4].rstrip().endswith("/"):
                done = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = done.end() if done else (n if name in ("script", "style", "textarea", "title") else at)
        else:
            if name not in INLINE:
                if name in ENDS_P and stack[solid[-1]].name == "p":
                    pop(solid[-1])
                if name in CLOSES:
                    close(CLOSES[name], LISTS)
                flush()
            stack.append(Element(name, stack[-1], m[4]))
            opened[name] += 1
            if name not in INLINE:
                solid.append(len(stack) - 1)
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """One row of evidence a block, the last column being 1."""
    out = np.zeros((len(blocks), 20))
    for k, b in enumerate(blocks):
        e, n = b.element, len(b.text)
        bits = e.bits
        article, header = bool(bits & IN_ARTICLE), bool(bits & IN_HEADER)
        out[k] = (
            article, bool(bits & IN_BOILER), header and not article, header and article, bool(bits & BAD), bool(bits & GOOD), bool(bits & COMMENTS), bool(bits & HIDDEN),
            e.near > 0, e.near < 0, min(1.0, b.link / n), min(np.log1p(n) / 6, 1.2), n < 25, e.name == "li", e.name in ("p", "pre", "blockquote", "dd"),
            e.name in ("h1", "h2", "h3", "h4"), min(len(_END.findall(b.text[:2000])), 5) / 5, "©" in b.text or " | " in b.text, article and e.near < 0, 1.0,
        )
    return out


def fit(rows: np.ndarray, content: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model by Newton's method."""
    w = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w)), rows.T @ (p - content) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@lru_cache(maxsize=1)
def fitted() -> np.ndarray:
    """Weights from the labelled pages of :mod:`.html_pages` (at most ``FIT_PAGES``), fitted once, on the driver."""
    from .html_pages import FIT_PAGES, labelled

    xs, ys = [], []
    for seed in range(FIT_PAGES):
        page, truth = labelled(seed)
        blocks = blocks_of(page)
        xs.append(features(blocks))
        ys += [truth.get(b.text, False) for b in blocks]
    return fit(np.concatenate(xs), np.array(ys, float))


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            steps += not a.inline
            a = a.parent
        else:
            steps += not b.inline
            b = b.parent
    return steps


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours by their distance, and the blocks of one parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, ADJACENT / (1 + distance(blocks[i - 1].element, b.element))))
        up = b.element.parent
        while up is not None and up.inline:
            up = up.parent
        if id(up) in last:
            out.append((last[id(up)], i, SIBLING))
        last[id(up)] = i
    return out


def minimum_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source side of a minimum cut: a score above 0 is a capacity from the source, below 0 one to the sink.

    Flow goes along shortest paths, all of one length at a time (Dinic).
    """
    n = len(score)
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: float, back: float) -> None:
        for x, y, z in ((a, b, c), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            cap.append(z)

    for i, s in enumerate(score):
        edge(n, i, max(s, 0.0), 0.0)
        edge(i, n + 1, max(-s, 0.0), 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[n] = 0
        queue = [n]
        for x in queue:
            for e in out[x]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[n + 1] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        x = n
        while True:
            if x == n + 1:
                flow = min(cap[e] for e in path)
                cut = next(k for k, e in enumerate(path) if cap[e] - flow <= eps)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                x = to[path[cut] ^ 1]
                del path[cut:]
            while nxt[x] < len(out[x]):
                e = out[x][nxt[x]]
                if cap[e] > eps and level[to[e]] == level[x] + 1:
                    break
                nxt[x] += 1
            if nxt[x] < len(out[x]):
                path.append(out[x][nxt[x]])
                x = to[path[-1]]
            elif path:
                x = to[path.pop() ^ 1]
                nxt[x] += 1
            else:
                break


def labels(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Whether each block is content."""
    if not blocks:
        return []
    score = np.clip(features(blocks) @ weights, -12, 12)
    return minimum_cut(score.tolist(), ties(blocks))


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    """The main text, its blocks joined by line feeds; empty if there is none."""
    found = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(found, labels(found, fitted() if weights is None else weights), strict=True) if keep)


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``pages``: ``keep`` (default ``page_id``, ``url``), ``text``, ``n_chars``.

    Null or empty html gives an empty text; whole pages are read, nothing is
    capped; repeated rows are rows of their own; an empty table gives an empty
    result.  No shuffle.
    """
    small_batches(pages.sparkSession)
    keep = ["page_id", "url"] if keep is None else keep
    src = pages.select(*[F.col(f"`{c}`") for c in keep], F.col("html").alias("__html"))
    weights = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "__html"):
            texts = [main_text(x, weights) for x in b.column(len(keep)).to_pylist()]
            cols = [b.column(k) for k in range(len(keep))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "text", "n_chars"])

    types = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", text string, n_chars bigint")
