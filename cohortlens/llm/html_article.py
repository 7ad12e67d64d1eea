"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph (a run of text between block
elements) earns points for its length and its commas and passes them to its
ancestors: all to the parent, half to the grandparent, a third and less above.
A container's points are discounted by its link density. The best container
and those of its siblings that score enough, or are prose themselves, are the
article; inside it, an <article> or <main> around the best container is taken
whole. Menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are recognised by element, role, class and id words, and by lists of
links; scripts, styles and hidden parts are never read.

Within a block, white space (also <br> and no-break spaces) becomes one space;
blocks stand in page order, joined by a line break; character references are
decoded. Nothing is capped.

Nulls and edges: null, empty or text-free html gives an empty text and 0; plain
text without markup is one block; unclosed, stray and deeply nested tags are read
leniently; null page_id and url are passed through; repeated rows are extracted
one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template textarea title iframe svg math object video audio canvas head".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
DROPPED = frozenset("nav footer aside form button select menu dialog".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
DROPPED_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion menu nav navbar navigation sidebar
footer cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe signup login share sharing social related
recommended comment comments commentlist respond reply replies disqus breadcrumb breadcrumbs pagination pager toolbar widget skip hidden
masthead topbar banner""".split())
#: Words that also stand on a wrapper of the whole page or article, as in "has-sidebar" or "page-with-banner".
WRAPPING = frozenset("menu nav navbar navigation sidebar footer header toolbar widget masthead topbar banner".split())
PAGE_HEADER = frozenset(["header"])  # only outside the article
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl body article main section div".split())
KEPT_WHOLE = frozenset(["article", "main"])
SIBLING_SHARE = 0.2
LEAST_SIBLING = 10.0
LINK_LIST = 0.9
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "score", "chars", "links", "n_links", "words", "form")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, words: frozenset | set = frozenset(), form: bool = False):
        self.tag, self.parent, self.dropped, self.words, self.form = tag, parent, dropped, words, form
        self.items: list[Node | str] = []
        self.score = self.chars = self.links = 0.0
        self.n_links = 0


def _named(attributes: str) -> tuple[set[str], str, bool]:
    """Class and id words, role, and whether the element is hidden."""
    words, role, hidden = set(), "", False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            words |= {w.lower() for w in _WORDS.findall(value)}
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return words, role, hidden


def tree(html: str) -> Node:
    """The page's elements; text items are decoded, <br> is a space."""
    root = node = Node("html", None)
    open_tags: dict[str, int] = {}

    def close(to: Node) -> Node:
        """Close everything up to and including ``to``."""
        at = node
        while True:
            open_tags[at.tag] -= 1
            if at is to:
                return at.parent
            at = at.parent

    def nearest(tags: tuple[str, ...]) -> Node | None:
        at = node
        while at.parent is not None:
            if at.tag in tags:
                return at
            if at.tag in SCOPES and at.tag not in tags:
                return None
            at = at.parent
        return None

    at, n, head_ends = 0, len(html), True
    while at < n:
        m = _TAG.search(html, at)
        text = html[at:m.start() if m else n]
        if text:
            node.items.append(unescape(text))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if open_tags.get(tag):
                to = node
                while to.tag != tag:
                    to = to.parent
                node = close(to)
            continue
        if tag == "br" or tag == "hr":
            node.items.append(" ")
        if tag in UNREAD:
            if tag == "head":  # only what stands in a body is read; an unclosed head ends at the body
                end = re.compile(r"</head\s*>|<body[\s>]", re.I).search(html, at) if head_ends else None
                head_ends = end is not None
                at = (end.end() if end[0].startswith("</") else end.start()) if end else at
            elif not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in VOID or tag == "body" or tag == "html":
            continue
        if tag in BLOCKS and open_tags.get("p") and (to := nearest(("p",))):
            node = close(to)
        if tag in CLOSES and any(open_tags.get(t) for t in CLOSES[tag]) and (to := nearest(CLOSES[tag])):
            node = close(to)
        words, role, hidden = _named(attributes) if attributes else (set(), "", False)
        inside = any(open_tags.get(t) for t in KEPT_WHOLE)
        by_words = words & (DROPPED_WORDS if inside else DROPPED_WORDS | PAGE_HEADER)
        gone = hidden or role in DROPPED_ROLES or tag == "header" and not inside
        child = Node(tag, node, gone or tag in DROPPED, by_words, tag == "form" and not gone)
        node.items.append(child)
        if not attributes.rstrip().endswith("/"):
            open_tags[tag] = open_tags.get(tag, 0) + 1
            node = child
    return root


def _walk(root: Node):
    """(node, True) on entering and (node, False) on leaving, (text, None) between; no recursion."""
    todo: list = [(root, True)]
    while todo:
        item, entering = todo.pop()
        yield item, entering
        if entering:
            todo.append((item, False))
            todo.extend((x, None if isinstance(x, str) else True) for x in reversed(item.items))


def _measure(root: Node) -> None:
    """Characters, link characters and links below each node; what a class or id word drops unless it holds an article.

    On a page without an article or main element of its own, a wrapper with a layout word (or a form) that holds most of the unlinked text stays.
    """
    holds: set[int] = set()
    proper = False
    anchors = 0
    for x, entering in _walk(root):
        if entering is None:
            size = len("".join(x.split()))
            stack[-1][0] += size
            stack[-1][1] += size if anchors else 0
        elif entering:
            if x is root:
                stack = [[0, 0, 0]]
            else:
                stack.append([0, 0, 0])
            if x.tag == "a":
                anchors += 1
                stack[-1][2] += 1
        else:
            x.chars, x.links, x.n_links = stack.pop()
            if x.tag == "a":
                anchors -= 1
            if stack:
                stack[-1] = [a + b for a, b in zip(stack[-1], (x.chars, x.links, x.n_links))]
            proper = proper or x.tag in KEPT_WHOLE and not x.words and not x.dropped
            if x.tag in KEPT_WHOLE or id(x) in holds:
                if x.parent is not None:
                    holds.add(id(x.parent))
    most = (root.chars - root.links) / 2
    for x, entering in _walk(root):
        if entering and x.parent is not None:
            wraps = not proper and x.chars - x.links > most and x.words <= WRAPPING
            if x.form and (wraps or id(x) in holds):
                x.dropped = False
            if x.words and x.tag not in KEPT_WHOLE and id(x) not in holds and not wraps:
                x.dropped = True
            elif x.words and x.tag == "article" and not wraps:  # an article of its own kind: a comment, an advert, a teaser
                x.dropped = True
            elif x.tag in ("ul", "ol", "div", "table", "p") and x.n_links >= 3 and x.links > LINK_LIST * x.chars:
                x.dropped = True
            x.dropped = x.dropped or x.parent.dropped


def blocks(root: Node):
    """(text, nearest block element) of each block below ``root``, in order, leaving out what is dropped."""
    parts: list[str] = []
    holder = [root]
    for x, entering in _walk(root):
        if entering is None:
            if not holder[-1][1] if isinstance(holder[-1], tuple) else not root.dropped:
                parts.append(x)
            continue
        if entering and x is root:
            holder = [(root, root.dropped)]
            continue
        if x.tag in BLOCKS or x is root:
            text = " ".join("".join(parts).split())
            parts = []
            if text:
                yield text, holder[-1][0]
        if entering:
            holder.append((x if x.tag in BLOCKS else holder[-1][0], x.dropped))
        elif len(holder) > 1:
            holder.pop()


def article(html: str) -> str:
    root = tree(html)
    _measure(root)
    scored: list[Node] = []
    for text, holder in blocks(root):
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        up, level = holder if holder.tag not in ("p", "pre", "td", "th", "li", "blockquote") or holder.parent is None else holder.parent, 1.0
        while up is not None:
            if not up.score:
                scored.append(up)
            up.score += points / level
            level = 2.0 if level == 1 else level + 3 if level > 2 else 6.0
            up = up.parent
    if not scored:
        return ""

    def worth(x: Node) -> float:
        return x.score * (1 - x.links / x.chars) if x.chars else 0.0

    best = max(scored, key=worth)  # of equals the innermost, which is scored first
    around = best
    while around is not None and around.tag not in KEPT_WHOLE:
        around = around.parent
    best = around or best
    chosen = {id(best)}
    if best.parent is not None:
        least = max(LEAST_SIBLING, SIBLING_SHARE * worth(best))
        for x in best.parent.items:
            if not isinstance(x, str) and not x.dropped and x is not best and (worth(x) >= least or x.tag == "p" and x.chars > 80 and x.links < 0.25 * x.chars):
                chosen.add(id(x))
        if chosen == {id(best)}:
            return "\n".join(t for t, _ in blocks(best))
        return "\n".join(t for x in best.parent.items if not isinstance(x, str) and id(x) in chosen for t, _ in blocks(x))
    return "\n".join(t for t, _ in blocks(best))


def _extract(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [article(t) for t in texts(batch.column("html"))]
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                      names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the article) and n_chars of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_map(rows, lambda: _extract, "page_id long, url string, text string, n_chars long")
