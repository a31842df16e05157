"""Main text of web pages by composite text density.

A page is read into a tree by the HTML rules that matter for text: raw text
elements, comments, character references, void elements, end tags that are
left out. What is never part of an article goes first: elements of that
meaning (``nav``, ``aside``, ``form``, ``script`` ...) and elements whose role,
class or id says so as a word of its own ("ad", "sidebar", "comments" ...).

On the tree that stays, every node gets its composite text density: characters
a tag, weighted by the logarithm of how little of them is link text, to a base
that grows with the node's link share and that of the whole page. Elements of
running text (``b``, ``span`` ...) belong to the block they stand in; links are
counted. The density sum of a node is the sum of its children's densities; the
node with the largest one holds the main text. The least density on its path to the body is the
threshold: every node as dense marks the node of largest density sum under it
as content. An ``article`` or ``main`` element round the largest node is the
article's extent, and is taken whole.

All steps are iterative and linear in the page: deep nesting, unclosed
comments and stray end tags cost no more than their length.

Cases: a null or empty page has empty text, as has one without any text
outside of what is removed; a page without markup is one block; texts of any
length are read whole; equal rows give equal results; a null id or url stays;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundlearn.llm.common import parts
from roundlearn.session import ship_package

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                  "option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the first closes an open one of the second, up to the elements of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
          "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
          "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
#: Elements that are no part of an article, wherever they stand.
NEVER = frozenset("head nav aside form script style template noscript iframe noembed noframes object embed applet svg "
                  "math canvas audio video map select datalist button input textarea dialog menu search title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
                  "toolbar note".split())
#: Words of a class or id that name something else than the article.
NOT_ARTICLE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos "
                        "promoted banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
                        "sidebars aside footer foot masthead topbar cookie cookies consent gdpr notice notices popup "
                        "modal overlay newsletter subscribe subscription signup login comment comments commentlist "
                        "disqus reply replies respond share sharing social related recommended recommendations "
                        "pagination pager widget widgets skip toolbar copyright legal disclaimer form forms search "
                        "header".split())
PART_BYTES = 4 << 20
_NAME = re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
_ATTR = re.compile(r"""[\t\n\f\r /]*(?:([^\t\n\f\r />=][^\t\n\f\r />=]*|=[^\t\n\f\r />=]*)"""
                   r"""(?:[\t\n\f\r ]*=[\t\n\f\r ]*("[^"]*"|'[^']*'|[^\t\n\f\r >"'][^\t\n\f\r >]*|))?)?""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "chars", "tags", "link_chars", "links", "density", "total", "best")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []


class _Builder:
    """The open elements of a page that is being read."""

    def __init__(self):
        self.root = self.at = Node("#root", {}, None)
        self.open: dict[str, int] = {}

    def pop(self) -> None:
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def pop_to(self, node: Node) -> None:
        while self.at is not node:
            self.pop()
        self.pop()

    def text(self, s: str) -> None:
        if self.at.tag == "head" and s.strip():
            self.pop()
        self.at.kids.append(s)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("html", "body") and self.open.get(tag):
            return
        if self.open.get("head") and tag not in HEAD:
            while self.open["head"]:
                self.pop()
        if tag in BLOCK and self.open.get("p"):
            self._close({"p"}, frozenset({"table", "button", "object"}))
        if tag in CLOSES and any(self.open.get(t) for t in CLOSES[tag][0]):
            self._close(*CLOSES[tag])
        node = Node(tag, attrs, self.at)
        self.at.kids.append(node)
        if not closed:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Close the outermost open element of ``tags`` inside of ``stop``;
        looks no further up than the last open element of these."""
        left = sum(self.open.get(t, 0) for t in tags)
        node, last = self.at, None
        while left and node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                last, left = node, left - 1
                if tags == {"p"} or tags == {"li"}:
                    break
            node = node.parent
        if last is not None:
            self.pop_to(last)

    def end(self, tag: str) -> None:
        if not self.open.get(tag) or tag in ("html", "body"):
            return
        node, block = self.at, False
        while node.tag != tag:
            block = block or node.tag in BLOCK
            node = node.parent
        if block and tag not in BLOCK and tag != "a":
            self.open[tag] -= 1               # misnested: what follows stays in its block
            node.tag = "#" + tag
            self.open[node.tag] = self.open.get(node.tag, 0) + 1
        else:
            self.pop_to(node)


def parse(page: str) -> Node:
    """The tree of a page. A tag or comment that the page ends in is left
    out, as browsers do."""
    b, at, n = _Builder(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            b.text(html.unescape(page[at:]))
            break
        after = page[lt + 1:lt + 2]
        if not (after.isascii() and after.isalpha() or after in ("/", "!", "?")) or not after:
            nxt = page.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            b.text(html.unescape(page[at:nxt]))
            at = nxt
            continue
        if lt > at:
            b.text(html.unescape(page[at:lt]))
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                at = page.index(">", lt) + 1
                continue
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        name = _NAME.match(page, lt + 2 if after == "/" else lt + 1)
        if name is None:                      # declarations and the like
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        tag, attrs, at = name[0].lower(), {}, name.end()
        while True:
            m = _ATTR.match(page, at)
            at = m.end()
            if m[1]:
                attrs.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
            elif at >= n or page[at] == ">":
                break
            else:
                at += 1                       # a stray quote
        if at >= n:
            break
        closed = page[at - 1] == "/"
        at += 1
        if after == "/":
            b.end(tag)
            continue
        b.start(tag, attrs, tag in VOID or closed and tag in ("svg", "math", "path"))
        if tag in RAW:
            m = re.compile(f"</{tag}(?=[\\t\\n\\f\\r />])", re.I).search(page, at)
            end = m.start() if m else n
            raw = page[at:end]
            b.text(html.unescape(raw) if tag in ("textarea", "title") else raw)
            at = end
            if not m:
                break
    return b.root


def words_of(node: Node) -> set[str]:
    s = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return set(_WORD.findall(_CAMEL.sub(" ", s).lower())) if s != " " else set()


def removable(node: Node, in_article: bool, holds_article: bool) -> bool:
    """Whether an element is no part of an article by tag, role, class or
    id. What holds an ``article`` or ``main`` goes by its tag and role only;
    a header inside of an article is the article's own."""
    tag, attrs = node.tag, node.attrs
    if tag in NEVER or tag == "footer" or tag == "header" and not in_article:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True
    if holds_article or tag in ("html", "body", "main"):
        return False
    found = words_of(node) & NOT_ARTICLE
    if in_article or tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p"):
        found = found - {"header", "legal", "skip", "form"}
    if tag == "article":
        found &= {"comment", "comments", "reply", "related", "sponsored", "promo", "ad"}
    return bool(found)


def prune(root: Node) -> None:
    order = tree(root)
    holds = set()
    for node in reversed(order):
        if node.tag in ("article", "main") or id(node) in holds:
            holds.add(id(node.parent))
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.kids = [k for k in node.kids if isinstance(k, str) or not removable(k, inside, id(k) in holds)]
        stack += [(k, inside) for k in node.kids if not isinstance(k, str)]


def tree(root: Node) -> list[Node]:
    """The nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return order


def count(order: list[Node]) -> None:
    """Characters, tags, link characters and links of each node's subtree."""
    for node in reversed(order):
        node.chars = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        node.tags = node.link_chars = node.links = 0
        for k in node.kids:
            if not isinstance(k, str):
                node.chars += k.chars
                node.tags += k.tags + (k.tag in BLOCK or k.tag == "a")
                node.link_chars += k.link_chars
                node.links += k.links
        if node.tag == "a":
            node.link_chars, node.links = node.chars, node.links + 1


def measure(order: list[Node], share: float) -> None:
    """Densities and density sums of all nodes; ``share`` is that of link
    text in the whole page."""
    for node in reversed(order):
        c, lc = node.chars, node.link_chars
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        rarity = max(c, 1) / max(lc, 1) * max(node.tags, 1) / max(node.links, 1)
        # a page without any link would have the base 1
        node.density = c / max(node.tags, 1) * max(math.log(rarity), 0.0) / max(math.log(base), 0.05)
        node.total, node.best = 0.0, node     # best: of largest density sum in the subtree, the outermost on ties
        for k in node.kids:
            if not isinstance(k, str):
                node.total += k.density if k.tag in BLOCK else k.total
        for k in node.kids:
            if not isinstance(k, str) and k.best.tag in BLOCK and k.best.total > node.best.total:
                node.best = k.best


def content(root: Node) -> list[Node]:
    """The nodes whose subtrees are the main text, in page order."""
    count(tree(root))
    share = root.link_chars / max(root.chars, 1)
    prune(root)
    order = tree(root)
    count(order)
    measure(order, share)
    top = root.best
    if not root.chars:
        return []
    node, extent, least = top, None, top.density
    while node is not None and node.tag != "#root":
        if node.tag in ("article", "main"):
            extent = extent if extent is not None and node.tag == "main" else node
        least = min(least, node.density)
        if node.tag == "body":
            break
        node = node.parent
    if extent is not None:
        return [extent]
    marked = {id(n.best) for n in order if n.chars and n.tag in BLOCK and n.density >= least} | {id(top)}
    return [n for n in order if id(n) in marked]


def blocks(nodes: list[Node]) -> list[str]:
    """The blocks of text under ``nodes``, each once, in page order."""
    out, piece, seen = [], [], set()

    def flush():
        s = " ".join("".join(piece).split())
        piece.clear()
        if s:
            out.append(s)
    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                piece.append(x)
            elif id(x) not in seen:
                seen.add(id(x))
                if x.tag == "br":
                    piece.append(" ")
                elif x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(x.kids)
        flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return " ".join(blocks(content(parse(page))))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, the main ``text`` of each page and ``n_chars``."""
    cols = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    src = pages.select(*cols, F.col(f"`{html_col}`").cast("string").alias("page"))
    fields = ", ".join(f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in parts(b.column("page"), PART_BYTES):
                texts = [main_text(x) for x in b.column("page")[p].to_pylist()]
                out = [b.column(f"k{i}")[p] for i in range(len(keep))]
                out += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, [*(f"k{i}" for i in range(len(keep))), "text", "n_chars"])
    ship_package(pages.sparkSession)
    found = src.mapInArrow(run, f"{fields}, text string, n_chars long")
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
