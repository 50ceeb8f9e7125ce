"""Main text of web pages by boosted trees over DOM nodes.

A page becomes a table of its block elements. Each gets features of its own (tag, attribute tokens, depth,
siblings), of its subtree (text, links, tags) and of its ancestors; gradient-boosted trees give the log-odds
that it belongs to the article. Decoding is hierarchical: what is below a dropped element is dropped, and an
element stays when it and the best choice below it add up to more than nothing, so an ancestor and its
descendants never contradict each other.

Pages carry no labels, so the trees are fitted on pages laid out anew from texts of a bounded sample, with
known places for article and surroundings.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.frames import only
from weekloom.llm.words import pieces

#: Pages whose texts the training pages are made of, about, block texts taken from them at most, and pages made.
SAMPLE, SAMPLE_BLOCKS, MADE = 200, 4000, 900

# Elements of HTML by how they are treated.
BLOCKS = (
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address hr nav header footer aside form fieldset legend details summary dialog menu "
    "center head label select option button hgroup search"
).split()
RAW = "script style noscript template textarea title iframe svg math object canvas video audio".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
IN_HEAD = set("html head base basefont bgsound link meta noframes noscript script style template title".split())
ENDS_P = set(BLOCKS) - {"label", "select", "option", "button", "html", "body", "head"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
TAG_GROUPS = [
    {"article", "main"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"},
    {"li", "dt", "dd"}, {"nav"}, {"header"}, {"footer", "address"}, {"aside"},
    {"form", "fieldset", "legend", "label", "select", "option", "button", "search"}, {"table", "tr", "td", "th", "tbody"},
    {"section"}, {"div", "center"}, {"figure", "figcaption", "caption"}, {"dialog", "details", "summary"},
]
AROUND = [
    set("nav navbar navigation navi menu menus breadcrumb breadcrumbs pagination pager toolbar skip".split()),
    set("header masthead topbar top foot footer bottom copyright legal colophon site".split()),
    set("sidebar side aside widget widgets rail secondary".split()),
    set("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted commercial".split()),
    set("cookie cookies consent gdpr notice notification alert popup modal overlay dialog newsletter subscribe subscription signup".split()),
    set("login form search contact register".split()),
    set("comment comments commentlist respond reply replies discussion disqus feedback reader".split()),
    set("share sharing social related recommended recommendations more tags teaser teasers".split()),
]
ABOUT = set("article content post story entry body text main prose copy".split())

_ATTRIBUTES = r"((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+|[^>]*+)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+){_ATTRIBUTES}>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|data-y)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that may hold others of their kind, those of them that may close themselves, and those whose start tag
#: makes all that follows theirs if they are never closed.
_NESTED, _SELF_CLOSING, _TO_THE_END = {"svg", "math", "template", "object"}, {"svg", "math"}, {"script", "style", "textarea"}
_RAW_TAG = {tag: re.compile(rf"<(/?){tag}(?![^\s/>]){_ATTRIBUTES}>", re.I | re.S) for tag in RAW}
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_BLOCK, _VOID, _RAW = set(BLOCKS), set(VOID), set(RAW)
_GROUP = {tag: i for i, tags in enumerate(TAG_GROUPS) for tag in tags}


class _RawEnds:
    """Where the raw elements of a page end. Every kind is looked for once, however many of them are never closed."""

    def __init__(self, html: str, end: int):
        self.html, self.end = html, end
        self.pairs: dict[str, dict[int, int]] = {}
        self.none: set[str] = set()

    def after(self, tag: str, at: int) -> int | None:
        """The end of the element whose start tag ends at `at`."""
        if tag in _NESTED:
            if tag not in self.pairs:
                self.pairs[tag] = self._paired(tag)
            return self.pairs[tag].get(at)
        found = None if tag in self.none else _RAW_END[tag].search(self.html, at, self.end)
        if found is None:
            self.none.add(tag)
            return None
        return found.end()

    def _paired(self, tag: str) -> dict[int, int]:
        out, open_ = {}, []
        for found in _RAW_TAG[tag].finditer(self.html, 0, self.end):
            if not found.group(1):
                if tag in _SELF_CLOSING and found.group(2).endswith("/"):
                    out[found.end()] = found.end()
                else:
                    open_.append(found.end())
            elif open_:
                out[open_.pop()] = found.end()
        return out


@dataclass
class Pages:
    """Block elements of several pages, in page order, and their texts. `data-y` is read from `marked` pages only,
    which are those laid out here."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    around: list[int] = field(default_factory=list)
    about: list[int] = field(default_factory=list)
    mark: list[int] = field(default_factory=list)
    tags: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    block_node: list[int] = field(default_factory=list)
    block_text: list[str] = field(default_factory=list)
    block_link: list[int] = field(default_factory=list)
    block_first: list[int] = field(default_factory=list)
    marked: bool = True

    def add(self, html: str) -> None:
        """Read one page. Elements that are never closed end with their parent, a head with the first text or
        tag that cannot stand in it. What is not shown (scripts, drawings, media and the like) is left out up to its
        end tag, or to that of the outermost one, or to nothing if it closes itself; without an end tag only its start
        tag is left out, or all the rest after a script, style or textarea. Text after the last `>` is text, whatever
        is in it."""
        root = len(self.parent)
        self.first.append(root)
        self.block_first.append(len(self.block_text))
        self._open(-1, "html", "")
        stack = [("html", root)]
        counts = {"html": 1}
        said: list[str] = []
        linked, link = 0, 0

        def flush() -> None:
            nonlocal said, linked
            if said:
                text = " ".join("".join(said).split())
                if text:
                    self.block_node.append(stack[-1][1])
                    self.block_text.append(text)
                    self.block_link.append(min(linked, len(text)))
                said, linked = [], 0

        def close(index: int) -> None:
            for tag, _ in stack[index:]:
                counts[tag] -= 1
                if not counts[tag]:
                    del counts[tag]
            del stack[index:]

        def close_one(wanted: set[str], scope: set[str]) -> None:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in wanted:
                    close(i)
                elif stack[i][0] in scope:
                    return

        at, end = 0, len(html)
        last = html.rfind(">") + 1  # no tag goes on beyond
        raw = _RawEnds(html, last)
        while at < end:
            found = _TOKEN.search(html, at, last) if at < last else None
            stop = found.start() if found else end
            if stop > at:
                text = html[at:stop]
                if "head" in counts and not text.isspace():
                    close(len(stack) - 1)
                said.append(unescape(text) if "&" in text else text)
                if link:
                    linked += stop - at
            if not found:
                break
            at = found.end()
            tag = found.group(2)
            if tag is None:
                if html.startswith("<!--", found.start()) and not html.endswith("-->", found.start() + 4, at):
                    break  # a comment that is never closed
                continue
            tag = tag.lower()
            if not found.group(1):
                if "head" in counts and tag not in IN_HEAD:
                    close(len(stack) - 1)
                self.tags[stack[-1][1]] += 1
                if tag in _RAW:
                    over = raw.after(tag, at)
                    at = over if over is not None else end if tag in _TO_THE_END else at
                elif tag == "br":
                    said.append(" ")
                elif tag == "a":
                    link = 1
                elif tag in _BLOCK:
                    flush()
                    if tag in ENDS_P and "p" in counts:
                        close_one({"p"}, _BLOCK - {"p"})
                    closes = CLOSES.get(tag)
                    if closes and not closes.isdisjoint(counts):
                        close_one(closes, SCOPES.get(tag, set()))
                    if tag in ("html", "body") and tag in counts:
                        continue
                    if tag not in _VOID:
                        stack.append((tag, self._open(stack[-1][1], tag, found.group(3))))
                        counts[tag] = counts.get(tag, 0) + 1
                        link = 0
            elif tag == "a":
                link = 0
            elif tag in _BLOCK:
                flush()
                if tag in counts and tag not in ("html", "body"):
                    i = len(stack) - 1
                    while stack[i][0] != tag:
                        i -= 1
                    close(i)
                link = 0
        flush()

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.group.append(_GROUP.get(tag, -1))
        around, about, mark = 0, 0, 0
        if attributes and "=" in attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                if name.lower() == "data-y":
                    if self.marked:
                        mark = int(value.strip("\"'"))
                    continue
                for part in _PART.findall(value):
                    part = part.lower()
                    for bit, words in enumerate(AROUND):
                        if part in words:
                            around |= 1 << bit
                    about += part in ABOUT
        self.around.append(around)
        self.about.append(about)
        self.mark.append(mark)
        self.tags.append(1)
        return len(self.parent) - 1


@dataclass
class Nodes:
    """Features of all nodes and what decoding needs."""

    features: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]
    own: np.ndarray


def node_table(pages: Pages) -> Nodes:
    """Features of every node, by sums over subtrees and along ancestors, one level of depth at a time."""
    n = len(pages.parent)
    parent, depth = np.array(pages.parent), np.array(pages.depth)
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(1, (depth.max() if n else 0) + 1))
    levels = np.split(by_depth, cuts)
    node = np.array(pages.block_node, np.int64)
    sizes = np.array([len(t) for t in pages.block_text], float)
    stops = np.array([t.count(".") + t.count(",") for t in pages.block_text], float)
    words = np.array([t.count(" ") + 1 for t in pages.block_text], float)

    def own(values: np.ndarray) -> np.ndarray:
        return np.bincount(node, values, n) if len(node) else np.zeros(n)

    base = np.stack(
        [own(sizes), own(np.array(pages.block_link, float)), own(stops), own(words), own(np.ones(len(node))), np.array(pages.tags, float)]
    )
    below = base.copy()
    for level in reversed(levels[1:]):
        for row in below:
            np.add.at(row, parent[level], row[level])
    around = np.array(pages.around)
    bits = np.stack([around >> b & 1 for b in range(len(AROUND))]).astype(float)
    group = np.array(pages.group)
    tags = np.stack([group == g for g in range(len(TAG_GROUPS))]).astype(float)
    about = np.array(pages.about, float)
    above = np.concatenate((bits, tags, about[None]))
    mine = above.copy()
    above = np.zeros_like(mine)
    for level in levels[1:]:
        above[:, level] = np.maximum(above[:, parent[level]], mine[:, parent[level]])
    siblings = np.bincount(parent[parent >= 0], minlength=n).astype(float)
    up = np.maximum(parent, 0)
    place = np.zeros(n)
    for level in levels[1:]:
        order = np.argsort(parent[level], kind="stable")
        p = parent[level][order]
        begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        place[level[order]] = np.arange(len(p)) - np.repeat(begin, np.diff(np.r_[begin, len(p)]))
    size, links, stops_, words_, blocks, tag_count = below
    # What the page is like as a whole.
    first = np.array(pages.first, np.int64)
    root = np.repeat(first, np.diff(np.r_[first, n]))
    signs = np.stack([group == 0, np.array(pages.about) > 0, around > 0]).astype(float)
    signs = np.add.reduceat(signs, first, axis=1)[:, np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))]
    features = np.stack(
        [
            depth, siblings, siblings[up], place, np.log1p(base[0]), np.log1p(size), links / np.maximum(size, 1),
            size / np.maximum(tag_count, 1), stops_ / np.maximum(words_, 1), words_ / np.maximum(blocks, 1), np.log1p(blocks),
            size / np.maximum(size[up], 1), links[up] / np.maximum(size[up], 1), np.log1p(size[up]),
            size / np.maximum(size[root], 1), np.log1p(size[root]), *signs, *mine, *above,
        ]
    )
    return Nodes(features.T.astype(np.float32), parent, levels, base[0])


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one depth: split feature and border by tree and place, log-odds by tree and leaf."""

    feature: np.ndarray
    border: np.ndarray
    leaf: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, border, leaf in zip(self.feature, self.border, self.leaf, strict=True):
            place = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                place = 2 * place + 1 + (x[rows, feature[place]] > border[place])
            out += leaf[place - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32) -> Trees:
    """Gradient boosting with logistic loss; splits at quantiles, by gain of the second-order objective."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    share = float(np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99))
    start = float(np.log(share / (1 - share)))
    score = np.full(len(x), start)
    inner, size = 2**depth - 1, bins + 1
    all_features, all_borders, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        place = np.zeros(len(x), np.int64)
        feature, border = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            low, wide = 2**level - 1, 2**level
            local = place - low
            best, choice = np.full(wide, 1e-6), [None] * wide
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                code = local * size + binned[j]
                gs = np.bincount(code, g, wide * size).reshape(wide, size)
                hs = np.bincount(code, h, wide * size).reshape(wide, size)
                gl, hl = gs.cumsum(axis=1)[:, : len(e)], hs.cumsum(axis=1)[:, : len(e)]
                gt, ht = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                top = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(wide), top] > best).tolist():
                    best[k], choice[k] = gain[k, top[k]], (j, e[top[k]])
            for k, c in enumerate(choice):
                if c is not None:
                    feature[low + k], border[low + k] = c
            place = 2 * place + 1 + (x[np.arange(len(x)), feature[place]] > border[place])
        leaf_of = place - inner
        leaf = rate * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + 1)
        score += leaf[leaf_of]
        all_features.append(feature)
        all_borders.append(border)
        all_leaves.append(leaf)
    return Trees(np.stack(all_features), np.stack(all_borders), np.stack(all_leaves), start)


def decode(nodes: Nodes, log_odds: np.ndarray) -> np.ndarray:
    """Which nodes' texts stay: the choice of subtrees with the largest sum of log-odds.

    Elements without text of their own count half. The root itself stays, its own text by its log-odds.
    """
    value = np.clip(log_odds, -6, 6) * np.where(nodes.own > 0, 1.0, 0.5)
    total = value.copy()
    for level in reversed(nodes.levels[1:]):
        np.add.at(total, nodes.parent[level], np.maximum(total[level], 0))
    kept = np.ones(len(value), bool)
    for level in nodes.levels[1:]:
        kept[level] = kept[nodes.parent[level]] & (total[level] > 0)
    kept[nodes.levels[0]] = value[nodes.levels[0]] > 0
    return kept


def main_texts(pages: Iterable[str | None], trees: Trees) -> list[str]:
    """Main text of each page: blocks that stay, in page order, with a line break between them."""
    read = Pages(marked=False)
    for page in pages:
        read.add(page or "")
    if not read.first:
        return []
    nodes = node_table(read)
    kept = decode(nodes, trees.log_odds(nodes.features))
    blocks = kept[np.array(read.block_node, np.int64)] if read.block_node else np.zeros(0, bool)
    bounds = [*read.block_first, len(read.block_text)]
    return ["\n".join(t for t, k in zip(read.block_text[a:b], blocks[a:b], strict=True) if k) for a, b in zip(bounds, bounds[1:])]


class _Layouts:
    """Lays texts out as pages; every element with text says in `data-y` whether it is article."""

    def __init__(self, texts: list[str], seed: int = 0):
        self.texts, self.random = texts, np.random.default_rng(seed)

    def pick(self, *choices):
        return choices[int(self.random.integers(len(choices)))]

    def chance(self, p: float) -> bool:
        return bool(self.random.random() < p)

    def some(self, low: int, high: int) -> range:
        return range(int(self.random.integers(low, high + 1)))

    def text(self, short: bool = False) -> str:
        text = self.texts[int(self.random.integers(len(self.texts)))]
        return " ".join(text.split()[: int(self.random.integers(1, 9))]) if short else text

    def say(self, y: int, tag: str = "p", short: bool = False) -> str:
        text = self.text(short)
        end = "" if tag == "p" and self.chance(0.15) else f"</{tag}>"
        if self.chance(0.1):
            text = f"<b>{text}"
        return f'<{tag} data-y="{y}">{text}{end}'

    def links(self) -> str:
        return "<ul>" + "".join(f'<li data-y="0"><a href="/x">{self.text(True)}</a></li>' for _ in self.some(2, 8)) + "</ul>"

    def prose(self, y: int, low: int, high: int) -> str:
        return "".join(self.say(y, short=self.chance(0.15)) for _ in self.some(low, high))

    def named(self, tag: str, *names: str) -> tuple[str, str]:
        name = self.pick(*names)
        attribute = self.pick(f' class="{name}"', f' id="{name}"', f' class="x {name}"')
        return f'<{tag}{attribute} data-y="0">', f"</{tag}>"

    def box(self, kind: str) -> str:
        """One of the things around an article."""
        div = self.pick("div", "div", "section")
        inside = self.pick(self.links(), self.prose(0, 1, 3), self.text(), self.say(0, "h3", True) + self.prose(0, 1, 2))
        if kind == "nav":
            a, b = self.pick(('<nav data-y="0">', "</nav>"), self.named("div", "menu", "navbar", "main-nav", "breadcrumbs", "pagination"))
            inside = self.pick(self.links(), self.links(), self.text(True))
        elif kind == "header":
            a, b = self.pick(('<header data-y="0">', "</header>"), self.named("div", "header", "site-header", "masthead", "topbar"))
        elif kind == "footer":
            a, b = self.pick(('<footer data-y="0">', "</footer>"), self.named("div", "footer", "page-footer", "copyright", "bottom"))
        elif kind == "side":
            a, b = self.pick(('<aside data-y="0">', "</aside>"), self.named(div, "sidebar", "widget", "side", "right-rail"))
        elif kind == "ad":
            a, b = self.named(self.pick("div", "div", "aside", "section", "p"), "ad", "advert", "ads-box", "sponsored", "promo", "banner")
            if a.startswith("<p"):
                inside = self.text()
        elif kind == "notice":
            a, b = self.named(div, "cookie-notice", "consent", "notice", "alert", "newsletter", "popup", "cookie-banner", "subscribe")
        elif kind == "form":
            a, b = '<form data-y="0">', "</form>"
            inside = f'<label data-y="0">{self.text(True)}</label><input><button data-y="0">{self.text(True)}</button>' + self.prose(0, 0, 1)
        elif kind == "comments":
            a, b = self.named(div, "comments", "comment-list", "discussion", "respond", "reader-comments")
            one = lambda: f'<{self.pick("div", "li", "article")} class="comment">{self.prose(0, 1, 2)}'
            inside = self.say(0, "h3", True) + "".join(one() + self.pick("</div>", "</li>", "</article>") for _ in self.some(1, 5))
        else:
            a, b = self.named(div, "related", "share", "social", "recommended", "tags")
            inside = self.pick(self.links(), self.prose(0, 1, 2))
        return a + inside + b

    def article(self) -> str:
        parts = [self.say(1, "h1", True)] if self.chance(0.8) else []
        if parts and self.chance(0.15):
            parts = [f'<header data-y="1">{parts[0]}</header>']
        for _ in self.some(1, 8):
            parts.append(self.say(1, short=self.chance(0.2)))
            if self.chance(0.1):
                parts.append(self.say(1, "h2", True))
            if self.chance(0.06):
                parts.append("<ul>" + "".join(self.say(1, "li", self.chance(0.5)) for _ in self.some(2, 5)) + "</ul>")
            if self.chance(0.04):
                parts.append(f"<blockquote>{self.say(1)}</blockquote>")
            if self.chance(0.04):
                parts.append("<table>" + "".join(f"<tr>{self.say(1, 'td', True)}{self.say(1, 'td', True)}</tr>" for _ in self.some(1, 4)) + "</table>")
            if self.chance(0.08):
                parts.append(self.box(self.pick("ad", "notice", "form", "related", "side")))
        if self.chance(0.15):
            parts.append(self.box(self.pick("related", "comments", "ad")))
        inside = "".join(parts)
        plain = '<div data-y="1">{}</div>'
        if self.chance(0.2):
            inside = plain.format(inside)
        name = self.pick("content", "post", "story", "entry-content", "article-body", "main", "text")
        return self.pick(
            f'<article data-y="1">{inside}</article>',
            f'<article data-y="1" class="{name}">{inside}</article>',
            f'<main data-y="1">{inside}</main>',
            f'<main><article data-y="1">{inside}</article></main>',
            f'<div class="{name}" data-y="1">{inside}</div>',
            f'<section id="{name}" data-y="1">{inside}</section>',
            plain.format(inside),
            inside,
        )

    def page(self) -> tuple[str, int]:
        """A page, and whether text right in its body is article."""
        if self.chance(0.2):  # nothing but the article
            bare = "".join(f"{self.text()}{self.pick('<br>', '<hr>', ' ')}" for _ in self.some(1, 4))
            inside = self.pick(bare, self.prose(1, 1, 6), self.article())
            return self.pick(inside, f"<html><body>{inside}</body></html>", f'<div data-y="1">{inside}</div>'), 1
        before = [self.box(k) for k in ("notice", "header", "nav", "ad", "form", "side") if self.chance(0.4)]
        after = [self.box(k) for k in ("side", "comments", "related", "ad", "notice", "form", "nav") if self.chance(0.3)]
        middle = "".join(before) + self.article() + "".join(after)
        if self.chance(0.3):
            middle = f'<div class="{self.pick("wrapper", "container", "page", "row")}">{middle}</div>'
        return f"<html><body>{middle}{self.box('footer') if self.chance(0.8) else ''}</body></html>", 0


def fit(texts: list[str], made: int = MADE, seed: int = 0) -> Trees:
    """Trees from `made` pages that are laid out from these texts."""
    texts = [t for t in texts if t.strip()] or ["A text of some words, and a few more."]
    layouts = _Layouts(texts, seed)
    pages = Pages()
    for _ in range(made):
        html, bare = layouts.page()
        pages.add(html)
        pages.mark[pages.first[-1]] = bare
    nodes = node_table(pages)
    mark = np.array(pages.mark, float)
    # A container belongs to the article when most of the text below it does.
    size = nodes.own.copy()
    good = size * mark
    for level in reversed(nodes.levels[1:]):
        np.add.at(size, nodes.parent[level], size[level])
        np.add.at(good, nodes.parent[level], good[level])
    some = size > 0
    y = (good > 0.5 * size).astype(float)
    return boost(nodes.features[some], y[some], np.where(nodes.own > 0, 1.0, 0.7)[some])


def train(pages: DataFrame, sample: int = SAMPLE, blocks: int = SAMPLE_BLOCKS, html_column: str = "html") -> Trees:
    """Fit on the whole block texts of about `sample` pages, those with the least hashes; of more than `blocks`
    different texts, on those with the least hashes. Null and empty pages give none."""
    rows = only(pages, html_column).toDF("html").filter("html is not null and html <> ''")
    span = 1 << 20
    share = min(span, int(span * sample / max(rows.count(), 1)) + 1)
    found = rows.filter(F.pmod(F.xxhash64("html"), F.lit(span)) < share).mapInArrow(_block_texts, "text string")
    chosen = found.distinct().orderBy(F.xxhash64("text"), "text").limit(blocks)
    return fit(sorted(r["text"] for r in chosen.collect()))


def _block_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 0):
        read = Pages(marked=False)
        for html in batch.column(0).to_pylist():
            read.add(html or "")
        texts = {" ".join(t.replace("<", " ").replace("&", " ").split()) for t in read.block_text}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(texts), pa.string())], ["text"])


def extract(pages: DataFrame, trees: Trees, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """`page_id`, `url`, `text` and `n_chars` (its code points) for every page.

    White space inside a block becomes one space, character references are decoded, blocks are joined by a
    line break. A null or empty page, or one without main text, gives an empty text; repeated pages give
    repeated rows; null ids and urls stay null; further columns are left out; an empty table gives an empty
    one. One pass, no shuffle; a page is read as a whole.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trees)
    frame = only(pages, id_column, url_column, html_column)
    kinds = [frame.schema[c].dataType.simpleString() for c in (id_column, url_column)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, 2 << 20):
            texts = main_texts(batch.column(2).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_column, url_column, "text", "n_chars"],
            )

    return frame.mapInArrow(run, f"`{id_column}` {kinds[0]}, `{url_column}` {kinds[1]}, text string, n_chars bigint")
