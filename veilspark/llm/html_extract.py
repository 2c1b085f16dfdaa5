"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A forgiving parser builds the tree of block elements (inline elements belong to their block). Each block has features
of its tag, its own and its ancestors' attribute words, depth, place among its siblings, and of its subtree: text, link
and tag density, punctuation, words. Boosted regression trees give each block the odds of being main text. Decoding
keeps or drops blocks so that the summed log odds are greatest while a kept block's ancestors are kept and a dropped
block's descendants are dropped, so no choice contradicts another. Scripts, styles, comments and the like are no text;
nor is what stands in for content that a browser shows otherwise (noscript, template, object) where it is closed.

The trees are trained on pages drawn here from many layouts, whose main text is known; training takes seconds and is
the same each time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm._spark import ship

#: Elements without content, elements whose content is raw and no text, others whose content isn't shown,
#: inline elements, and those that a block start closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
PAIRED = ("noscript", "template", "object")
HIDING = frozenset((*RAW, *PAIRED, "select", "svg"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Words of class, id and role that speak for or against main text.
FOR = frozenset("article body content entry main post story text page prose blog markdown".split())
AGAINST = frozenset(
    "ad ads advert advertisement adsense aside banner bar breadcrumb breadcrumbs bottom byline comment comments consent cookie cookies copyright disqus footer form gdpr header legal links login masthead menu meta modal nav navbar navigation newsletter notice "
    "overlay pager pagination popup privacy promo promoted recommended related reply respond rss search share sharing shoutbox sidebar signup social sponsor sponsored subscribe subscription tags toolbar top widget".split()
)
GROUPS = (("article",), ("main",), ("p", "pre", "blockquote"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("nav", "menu"), ("footer",), ("header",), ("aside",), ("form", "button", "fieldset", "input"), ("li",), ("ul", "ol", "dl"), ("div", "section"), ("table", "tr", "td", "th", "tbody"), ("html", "body", ""))
_GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}

# a quote opens a value only after an equals sign, so it may stand in an unquoted value; one that is never closed ends with the tag
_TAG = re.compile(r"<!--(?:-?>|.*?--!?>)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
_PAIR = {tag: re.compile(rf"<(/?){tag}\b[^>]*(?:>|\Z)", re.I) for tag in PAIRED}
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(P_ENDS | {'html', 'body', 'li', 'tr', 'td', 'th', 'dd', 'dt'}, key=lambda t: (-len(t), t)))})\b", re.I)
_SELECT_END = re.compile(r"</select\b[^>]*(?:>|\Z)|<(?!/?(?:option|optgroup|hr)\b)/?[a-z]", re.I)
_FOREIGN_END = re.compile(r"</foreignobject\b[^>]*(?:>|\Z)", re.I)
_SVG_PART = re.compile(rf"<(/?)(svg|foreignobject|{'|'.join(sorted(P_ENDS | {'b', 'body', 'br', 'code', 'em', 'i', 'img', 'li', 'span', 'strong', 'sub', 'sup', 'tt', 'u', 'var'}, key=lambda t: (-len(t), t)))})\b[^>]*(?:>|\Z)", re.I)


class Hidden:
    """Where the content ends that a page doesn't show; every rule reads forward, so a page is read a fixed number of times.

    Raw content ends at its end tag; without one at the next block tag, so an unclosed script hides no article. A select
    ends at the first tag that it can't hold, an svg at the first tag of HTML outside a foreignObject. The others end
    at the end tag that pairs with them; without one their start tag is ignored and what follows is read as usual.
    """

    def __init__(self, source: str) -> None:
        self.source, self.never, self.pairs = source, set(), {}

    def end(self, tag: str, start: int, at: int) -> int:
        """Place after the content of the element whose tag spans start to at."""
        source = self.source
        if tag in _RAW_END:
            if tag not in self.never and (m := _RAW_END[tag].search(source, at)):
                return m.end()
            self.never.add(tag)
            return m.start() if (m := _BLOCK.search(source, at)) else len(source)
        if tag in _PAIR:
            return self.paired(tag).get(start, at)
        if tag == "select":
            m = _SELECT_END.search(source, at)
            return at if m is None else m.end() if m[0][:8].lower() == "</select" else m.start()
        return self.svg(at)

    def paired(self, tag: str) -> dict[int, int]:
        if tag not in self.pairs:
            ends, open_ = {}, []
            for m in _PAIR[tag].finditer(self.source):
                if not m[1]:
                    open_.append(m.start())
                elif open_:
                    ends[open_.pop()] = m.end()
            self.pairs[tag] = ends
        return self.pairs[tag]

    def svg(self, at: int) -> int:
        depth, here = 1, at
        while "svg" not in self.never and (m := _SVG_PART.search(self.source, here)):
            here, tag = m.end(), m[2].lower()
            if tag == "svg":
                depth += -1 if m[1] else not m[0].endswith("/>")
                if not depth:
                    return here
            elif tag == "foreignobject":
                if not m[1] and (close := _FOREIGN_END.search(self.source, here)):
                    here = close.end()
            else:
                return m.start()
        self.never.add("svg")
        return at


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "good", "bad", "links", "tags", "main")

    def __init__(self, tag: str, parent: Node | None, good: int = 0, bad: int = 0) -> None:
        self.tag, self.parent, self.good, self.bad = tag, parent, good, bad
        self.children: list[Node] = []
        self.parts: list[str | Node] = []  # own text and child blocks, in order
        self.links = self.tags = 0
        self.main: bool | None = None
        if parent is not None:
            parent.children.append(self)
            parent.parts.append(self)


@lru_cache(20_000)
def _attribute_words(attributes: str) -> tuple[int, int, bool]:
    good = bad = 0
    for m in _ATTR.finditer(attributes):
        found = _WORD.findall((m[1] or m[2] or m[3] or "").lower())
        good += sum(w in FOR for w in found)
        bad += sum(w in AGAINST for w in found)
    return good, bad, bool(re.search(r"\bdata-main\b", attributes))


def parse(source: str) -> Node:
    root = node = Node("", None)
    inline: list[str] = []  # open inline elements of the current block
    hidden = Hidden(source)
    opened: Counter[str] = Counter()  # open blocks
    link = 0
    at = 0
    while at < len(source):
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            node.parts.append(text)
            if link:
                node.links += len(text)
        if not m:
            break
        start, at = m.start(), m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in INLINE:
                if tag in inline:
                    inline.remove(tag)
                    link -= tag == "a"
                continue
            if opened[tag]:
                while node.tag != tag:
                    opened[node.tag] -= 1
                    node = node.parent
                opened[tag] -= 1
                node, inline, link = node.parent, [], 0
            continue
        if tag in HIDING:
            if not (m[3].endswith("/") and tag == "svg"):
                at = hidden.end(tag, start, at)
            node.parts.append("\n")
            continue
        if tag == "head":
            continue
        node.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                node.parts.append("\n")
            continue
        if tag in INLINE:
            inline.append(tag)
            link += tag == "a"
            continue
        if tag in P_ENDS or tag in ("li", "tr", "td", "th", "dd", "dt"):
            closes = {"li": ("li", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p")}.get(tag, ("p",))
            while node.tag in closes:
                opened[node.tag] -= 1
                node = node.parent
        good, bad, main = _attribute_words(m[3]) if len(m[3]) < 400 else _attribute_words.__wrapped__(m[3])
        node = Node(tag, node, good, bad)
        node.main = main or None
        opened[tag] += 1
        inline, link = [], 0
    return root


def block_text(parts: list[str]) -> str:
    return _SPACE.sub(" ", html.unescape("".join(parts))).strip()


def nodes_of(root: Node) -> list[Node]:
    """In page order, ancestors first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


FEATURES = 33 + len(GROUPS)


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    parent = np.array([index[id(x.parent)] if x.parent is not None else -1 for x in nodes])
    own = np.array([[sum(map(len, t := [p for p in x.parts if type(p) is str])), x.links, x.tags + 1, sum(s.count(".") + s.count(",") for s in t), sum(s.count(" ") for s in t), x.tag in ("p", "pre", "blockquote"), x.tag == "article" or x.tag == "main", x.good, x.bad, x.tag == "li"] for x in nodes], float).reshape(n, 10)
    total = own.copy()
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    above = np.zeros((n, 6))  # depth, good, bad, under article, under nav or footer or form, widest link density
    for i in range(1, n):
        p = parent[i]
        up = nodes[p]
        above[i] = above[p]
        above[i, 0] += 1
        above[i, 1] += up.good
        above[i, 2] += up.bad
        above[i, 3] += up.tag in ("article", "main")
        above[i, 4] += up.tag in ("nav", "footer", "form", "aside", "header", "menu")
        above[i, 5] = max(above[p, 5], total[p, 1] / max(total[p, 0], 1))
    place = np.zeros((n, 4))
    for i, x in enumerate(nodes):
        m = len(x.children)
        for j, c in enumerate(x.children):
            k = index[id(c)]
            size = sum(total[index[id(y)], 0] for y in (x.children[j - 1 : j] + x.children[j + 1 : j + 2])) if m > 1 else 0
            place[k] = j, m, (j + 1) / m, np.log1p(size)
    page = max(total[0, 0], 1)
    whole = lambda v: np.full(n, float(v))
    length, links, tags, stops, gaps = (total[:, i] for i in range(5))
    out = np.column_stack([
        np.log1p(own[:, 0]), np.log1p(length), length / page, links / np.maximum(length, 1), np.log1p(tags), length / tags, stops / np.maximum(length, 1) * 100, gaps / np.maximum(length, 1) * 100, np.log1p(gaps), total[:, 5] / tags, total[:, 6], total[:, 7] - own[:, 7], total[:, 8] - own[:, 8], total[:, 9] / tags,
        own[:, 1] / np.maximum(own[:, 0], 1), own[:, 7], own[:, 8], above, place, whole(np.log1p(page)), whole(total[0, 6] > 0), own[:, 0] / np.maximum(length, 1), own[:, 3] > 0, whole(total[0, 5] > 0), whole(total[0, 1] / page),
    ])
    groups = np.zeros((n, len(GROUPS)))
    for i, x in enumerate(nodes):
        g = _GROUP.get(x.tag)
        if g is not None:
            groups[i, g] = 1
    return np.column_stack([out, groups])


class Trees:
    """Boosted trees of fixed depth on binned features, for log loss."""

    def __init__(self, depth: int = 4, rounds: int = 30, rate: float = 0.25, bins: int = 48) -> None:
        self.depth, self.rounds, self.rate, self.bins = depth, rounds, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(width)]
        binned = self._binned(x)
        base = y.mean()
        self.start = float(np.log(base / (1 - base)))
        self.trees = []
        f = np.full(n, self.start)
        leaves = 1 << self.depth
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, int)
            split_j, split_b = np.zeros(leaves - 1, int), np.full(leaves - 1, 1 << 30)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                best = np.full(count, 1e-3)
                local = at - first
                for j in range(width):
                    m = len(self.edges[j]) + 1
                    if m == 1:
                        continue
                    cell = local * m + binned[:, j]
                    gs = np.cumsum(np.bincount(cell, g, count * m).reshape(count, m), axis=1)
                    hs = np.cumsum(np.bincount(cell, h, count * m).reshape(count, m), axis=1)
                    total_g, total_h = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                    gain[:, -1] = 0
                    b = gain.argmax(axis=1)
                    better = gain[np.arange(count), b] > best
                    best[better] = gain[np.arange(count), b][better]
                    split_j[first : first + count][better] = j
                    split_b[first : first + count][better] = b[better]
                at = 2 * at + 1 + (binned[np.arange(n), split_j[at]] > split_b[at])
            leaf = at - (leaves - 1)
            value = self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
            f += value[leaf]
            self.trees.append((split_j, split_b, value))
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.int32)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._binned(x), np.arange(len(x))
        f = np.full(len(x), self.start)
        leaves = 1 << self.depth
        for split_j, split_b, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, split_j[at]] > split_b[at])
            f += value[at - (leaves - 1)]
        return f


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The choice of greatest summed log odds in which kept blocks have kept ancestors."""
    index = {id(x): i for i, x in enumerate(nodes)}
    gain = np.array(odds, float)  # of keeping a block over dropping it, with the best choice below
    for i in range(len(nodes) - 1, 0, -1):
        gain[index[id(nodes[i].parent)]] += max(gain[i], 0.0)
    keep = [False] * len(nodes)
    for i, x in enumerate(nodes):
        keep[i] = bool(gain[i] > 0) and (x.parent is None or keep[index[id(x.parent)]])
    return keep


def assemble(node: Node, kept: set[int]) -> str:
    """Texts of kept blocks in page order, each trimmed with single spaces, joined by one space."""
    out: list[str] = []
    own: list[str] = []
    stack: list = [iter(node.parts)]
    owners = [node]
    while stack:
        part = next(stack[-1], None)
        if part is None or type(part) is not str:
            if own and (t := block_text(own)):
                out.append(t)
            own = []
            if part is None:
                stack.pop()
                owners.pop()
            elif id(part) in kept:
                stack.append(iter(part.parts))
                owners.append(part)
        elif id(owners[-1]) in kept:
            own.append(part)
    return " ".join(out)


# ---- training pages ----

_SYLLABLES = ("an", "ber", "co", "de", "en", "ful", "ga", "in", "lo", "men", "ner", "or", "pre", "re", "son", "ti", "un", "ver", "wi", "za")


def training_pages(count: int = 500, seed: int = 4) -> list[str]:
    """Pages of many layouts; elements that are, or only hold, main text carry the attribute data-main."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[int(rng.integers(len(a)))]

    def sentence(least: int, most: int) -> str:
        found = ["".join(pick(*_SYLLABLES) for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(least, most)))]
        return (" ".join(found)).capitalize() + pick(".", ".", ".", "!", "?", "")

    def prose(most: int) -> str:
        text = " ".join(sentence(4, 25) for _ in range(int(rng.integers(1, most))))
        if rng.random() < 0.2:
            text += f' <a href="/x">{sentence(1, 4)}</a> {sentence(3, 9)}'
        return f"<b>{text}" if rng.random() < 0.1 else text

    def links(least: int = 2, most: int = 9) -> str:
        items = [f'<a href="/{i}">{sentence(1, 4)}</a>' for i in range(int(rng.integers(least, most)))]
        return f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>" if rng.random() < 0.7 else " | ".join(items)

    def clutter(kind: str) -> str:
        words = sentence(2, 40)
        if kind == "nav":
            return pick(f"<nav>{links()}</nav>", f'<div class="{pick("menu", "navbar", "nav-main", "breadcrumb")}">{links()}</div>', f'<ul id="menu">{links(3, 6)}</ul>')
        if kind == "header":
            return pick(f"<header><h1>{sentence(1, 4)}</h1>{links(1, 4)}</header>", f'<div id="header"><p>{sentence(2, 8)}</p></div>', f'<header class="site-header">{sentence(1, 6)}</header>')
        if kind == "footer":
            return pick(f"<footer>&copy; {sentence(1, 3)} &middot; {words}</footer>", f'<div class="footer"><p>{words}</p>{links(1, 5)}</div>', f"<footer><p>{prose(3)}</p>{links(1, 4)}</footer>")
        if kind == "side":
            return pick(f"<aside><h3>{sentence(1, 4)}</h3><p>{prose(3)}</p></aside>", f'<div class="sidebar">{links()}<p>{words}</p></div>', f'<div id="related-posts"><h2>{sentence(1, 3)}</h2>{links()}</div>', f'<aside class="widget">{links()}</aside>')
        if kind == "ad":
            return pick(f'<div class="ad">{words}</div>', f'<div class="{pick("ads", "advert", "banner", "sponsored", "promo box")}"><p>{prose(3)}</p></div>', f'<div id="ad-1"><a href="/b">{words}</a></div>', f'<section class="promo"><p>{words}</p></section>')
        if kind == "notice":
            return pick(f'<div class="{pick("cookie-notice", "consent", "gdpr banner", "notice", "popup", "privacy-notice")}"><p>{prose(3)}</p><button>{sentence(1, 2)}</button></div>', f'<div role="dialog" class="modal"><p>{words}</p></div>', f'<div class="notice">{words}</div>')
        if kind == "form":
            return pick(f'<form><label>{sentence(1, 3)}</label><input><button>{sentence(1, 2)}</button></form>', f'<form class="newsletter"><p>{prose(2)}</p><input><button>{sentence(1, 2)}</button></form>', f'<div class="search-form"><form>{sentence(1, 4)}</form></div>')
        body = "".join(pick(f'<div class="comment"><p>{prose(3)}</p></div>', f'<li class="comment"><b>{sentence(1, 2)}</b><p>{prose(3)}</p></li>', f'<article class="comment"><p>{prose(3)}</p></article>', f"<p>{prose(2)}</p>") for _ in range(int(rng.integers(1, 6))))
        return pick(f'<div id="comments"><h3>{sentence(1, 3)}</h3>{body}</div>', f'<section class="comments">{body}</section>', f'<ul class="comment-list">{body}</ul>', f'<div class="{pick("reply", "disqus", "reader-comments")}">{body}</div>')

    def article() -> str:
        blocks = [f"<h1 data-main>{sentence(2, 10)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, 12))):
            kind = rng.random()
            if kind < 0.72:
                blocks.append(f"<p data-main>{prose(int(rng.integers(2, 7)))}</p>" if rng.random() < 0.9 else f"<p data-main>{sentence(1, 4)}</p>")
            elif kind < 0.8:
                blocks.append(f"<h{(k := pick(2, 3, 4))} data-main>{sentence(1, 7)}</h{k}>")
            elif kind < 0.86:
                blocks.append(f"<ul data-main>{''.join(f'<li data-main>{sentence(3, 14)}</li>' for _ in range(int(rng.integers(2, 6))))}</ul>")
            elif kind < 0.9:
                blocks.append(f"<blockquote data-main>{pick(prose(3), f'<p data-main>{prose(3)}</p>')}</blockquote>")
            elif kind < 0.93:
                blocks.append(f"<table data-main><tr data-main><td data-main>{sentence(2, 8)}</td><td data-main>{sentence(2, 8)}</td></tr></table>")
            elif kind < 0.96:
                blocks.append(f"<div data-main>{prose(4)}</div>")
            else:
                blocks.append(clutter(pick("ad", "side", "form", "notice", "nav")))
        body = "".join(blocks)
        style = rng.random()
        if style < 0.45:
            body = f"<article data-main>{body}</article>"
        elif style < 0.6:
            body = f'<div data-main class="{pick("content", "post", "entry-content", "article-body", "story", "main-text")}">{body}</div>'
        elif style < 0.7:
            body = f"<main data-main>{body}</main>"
        elif style < 0.8:
            body = f'<main data-main><article data-main class="post">{body}</article></main>'
        elif style < 0.9:
            body = f"<div data-main>{body}</div>"
        return body

    pages = []
    for _ in range(count):
        kinds = [k for k in ("nav", "header", "ad", "notice", "side") if rng.random() < 0.55]
        rng.shuffle(kinds)
        tail = [k for k in ("comments", "side", "ad", "form", "notice", "footer") if rng.random() < 0.5]
        body = "".join(clutter(k) for k in kinds) + article() + "".join(clutter(k) for k in tail)
        if rng.random() < 0.2:
            body = f'<div data-main id="{pick("page", "wrapper", "container")}">{body}</div>'
        if rng.random() < 0.04:
            body = f"<p data-main>{prose(4)}</p>" if rng.random() < 0.5 else prose(4).replace("<b>", "")
        if rng.random() < 0.1:
            body = body.replace("</p>", "")
        pages.append(body if rng.random() < 0.05 else f"<html data-main><body data-main>{body}</body></html>" if rng.random() < 0.9 else f"<html data-main><body data-main>{body}")
    return pages


@cache
def trained(pages: int = 400, seed: int = 4) -> Trees:
    x, y = [], []
    for page in training_pages(pages, seed):
        nodes = nodes_of(parse(page))
        x.append(features(nodes))
        y += [bool(n.main) or n.parent is None for n in nodes]
    return Trees().fit(np.concatenate(x), np.array(y, float))


def extract(pages: list[str], trees: Trees) -> list[str]:
    roots = [parse(p) for p in pages]
    lists = [nodes_of(r) for r in roots]
    odds = trees.log_odds(np.concatenate([features(x) for x in lists])) if lists else np.zeros(0)
    out, at = [], 0
    for root, nodes in zip(roots, lists, strict=True):
        keep = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append(assemble(root, {id(n) for n, k in zip(nodes, keep, strict=True) if k}))
    return out


def _run(trees: Trees, names: list[str], kept: int, group: int = 200):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), group):
                part = batch.slice(i, group)
                texts = extract([t or "" for t in part.column(kept).to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return run


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """The keep columns with text (empty if none) and n_chars (its code points), one row per input row.

    A null or empty page has an empty text; so has one in which no block is kept. Text outside any element counts as a
    block of its own. Character references are decoded once. Whole pages are read, whatever their length. Malformed
    markup loses no article: an unclosed comment or quote ends with its tag, unclosed scripts and the like end where
    Hidden says. Repeated rows give repeated rows; other columns are ignored, a keep column may have any name.
    """
    ship(pages.sparkSession)
    pages = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(html_col).cast("string").alias("_html"))
    names = [*(f"k{i}" for i in range(len(keep))), "text", "n_chars"]
    schema = ", ".join([f"{n} {pages.schema[n].dataType.simpleString()}" for n in names[:-2]] + ["text string", "n_chars long"])
    return pages.mapInArrow(_run(trees or trained(), names, len(keep)), schema).toDF(*keep, "text", "n_chars")
