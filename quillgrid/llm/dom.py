"""Web pages as trees of blocks, with the features that the extraction model reads.

Inline markup is melted into the text of its block. A node is a block element that holds text, or a run of
text, which is always a leaf. Tags that HTML lets authors leave out are supplied; strays are passed over.
"""

from __future__ import annotations

import html
import math
import re

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Fixed values of HTML: elements without content, whose content is no page text, and that open a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg textarea select option title head button".split())
#: Parts of forms.
CONTROLS = frozenset("input button textarea select label".split())
#: Of these the content isn't markup, so a tag inside counts as text up to the closing tag.
LITERAL = frozenset("script style textarea title iframe".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: What an opening tag closes, if it is open and nothing in the second set is open inside it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}

#: What attribute tokens hint at, by kind.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs toc pager pagination skip tabs sitemap",
    "advert": "ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion promoted outbrain taboola dfp",
    "comment": "comment comments reply replies respond response disqus discussion feedback reviews reader readers",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall toast",
    "side": "side sidebar aside rail widget widgets related recommended recommendations more popular trending teaser teasers also tags share social sharing follow",
    "edge": "header masthead head top footer foot bottom copyright legal branding logo site",
    "form": "form login search contact input register field",
    "main": "article content post entry main story body text page hentry prose",
    "hidden": "hidden none",
}
KINDS = tuple(HINTS)
HINT_OF = {word: k for k, words in enumerate(HINTS.values()) for word in words.split()}
TAGS = ("text", "p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "h1", "h2", "blockquote", "pre", "table", "td", "figure", "figcaption", "body")
TAG_AT = {t: k for k, t in enumerate(TAGS)} | {"dl": 11, "menu": 11, "dd": 13, "dt": 13, "h3": 15, "h4": 15, "h5": 15, "h6": 15, "th": 19, "tr": 18, "tbody": 18, "thead": 18, "center": 2, "html": 22, "hgroup": 14, "main": 5}
#: Elements whose presence above a node is a feature of it.
ABOVE = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "ul", "table", "blockquote", "figure")
ABOVE_AT = {t: k for k, t in enumerate(ABOVE)} | {"ol": 8}


class Node:
    __slots__ = ("above", "below", "chars", "commas", "controls", "depth", "hints", "links", "mark", "nodes", "over", "parent", "tag", "text", "words")

    def __init__(self, tag: str, parent: Node | None, hints: int = 0, mark: str | None = None):
        self.tag, self.parent, self.hints, self.mark = tag, parent, hints, mark
        self.below: list[Node] = []
        self.text, self.links, self.controls, self.depth = "", 0, 0, parent.depth + 1 if parent else 0
        self.above = (parent.above | (1 << ABOVE_AT[parent.tag] if parent.tag in ABOVE_AT else 0)) if parent else 0
        self.over = parent.over | parent.hints if parent else 0


def hinted(attributes: str) -> tuple[int, str | None]:
    """Bits of the kinds that the attribute tokens hint at, and the mark that generated training pages carry."""
    bits, mark = 0, None
    for name, *values in ATTRIBUTE.findall(attributes):
        value = values[0] or values[1] or values[2]
        name = name.lower()
        if name == "style":
            if "none" in value and "display" in value:
                bits |= 1 << KINDS.index("hidden")
            continue
        if name == "hidden":
            bits |= 1 << KINDS.index("hidden")
            continue
        if name == "aria-hidden":
            continue
        if name == "itemprop" and value.startswith("mark:"):
            mark = value[5:]
            continue
        for token in TOKEN.findall(value):
            k = HINT_OF.get(token.lower())
            if k is not None:
                bits |= 1 << k
    return bits, mark


def parse(page: str) -> Node:
    """The tree of a page; its root is the page itself."""
    root = Node("body", None)
    stack: list[tuple[str, Node | None]] = []  # inline elements have no node
    node, parts, linked, in_link = root, [], 0, 0
    raw_depth, raw_tag = 0, ""

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = html.unescape("".join(parts))
            text = " ".join(text.split())
            if text:
                leaf = Node("text", node)
                leaf.text, leaf.links = text, min(linked, len(text))
                node.below.append(leaf)
        parts, linked = [], 0

    def close_to(k: int) -> None:
        nonlocal node, in_link
        for tag, own in reversed(stack[k:]):
            if own is not None:
                flush()
                node = own.parent
            elif tag == "a":
                in_link -= 1
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        start = m.start() if m else end
        if start > at and not raw_depth:
            piece = page[at:start]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA[") and not raw_depth:
                parts.append(html.escape(m[0][9:-3]))
            continue
        tag = tag.lower()
        if raw_depth:
            if tag == raw_tag:
                raw_depth += -1 if m[1] else 0 if m[3].endswith("/") else 1
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close_to(k)
                    break
                if tag not in BLOCK and stack[k][0] in ("td", "th", "table", "article", "body"):
                    break
            continue
        if tag in CONTROLS:
            node.controls += 1
        if tag in LITERAL:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            parts.append(" ")
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                raw_depth, raw_tag = 1, tag
            if tag == "head":  # may lack its end; the body's start ends it, too
                close = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(page, at)
                raw_depth, at = 0, close.end() if close else at
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag not in BLOCK:
            if not m[3].endswith("/"):
                stack.append((tag, None))
                if tag == "a":
                    in_link += 1
            continue
        if tag == "body" or tag == "html":
            continue
        flush()
        closes, inside = CLOSES.get(tag, ({"p"}, {"td", "th", "table", "blockquote", "li", "div", "section", "article"}))
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in inside:
                break
            if stack[k][0] in closes:
                close_to(k)
                if tag not in ("tr", "tbody", "tfoot"):
                    break
        bits, mark = hinted(m[3]) if m[3] else (0, None)
        child = Node(tag, node, bits, mark)
        node.below.append(child)
        stack.append((tag, child))
        node = child
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """Nodes with text, each before those below it; sums over what is below are filled in."""
    order, wait = [], [root]
    while wait:
        x = wait.pop()
        order.append(x)
        wait.extend(reversed(x.below))
    for x in reversed(order):
        if x.tag == "text":
            x.chars, x.words, x.nodes = len(x.text), x.text.count(" ") + 1, 1
            x.commas = x.text.count(",") + x.text.count(".")
        else:
            x.below = [y for y in x.below if y.chars]
            x.chars = sum(y.chars for y in x.below)
            x.links = sum(y.links for y in x.below)
            x.controls += sum(y.controls for y in x.below)
            x.words = sum(y.words for y in x.below)
            x.commas = sum(y.commas for y in x.below)
            x.nodes = 1 + sum(y.nodes for y in x.below)
    return [x for x in order if x.chars]


def features_of(nodes: list[Node]) -> list[list[float]]:
    """A row of numbers for each node of a page, in the order of ``nodes_of``."""
    out, seen, total = [], 0, max(1, nodes[0].chars if nodes else 1)
    place: dict[int, tuple[int, int, int, int, int]] = {}
    for x in nodes:
        k, n, before, after, largest = place.get(id(x), (0, 1, 0, 0, x.chars))
        size = len(x.below)
        top = max((y.chars for y in x.below), default=0)
        for i, y in enumerate(x.below):
            place[id(y)] = (i, size, x.below[i - 1].chars if i else 0, x.below[i + 1].chars if i + 1 < size else 0, top)
        up = x.parent.chars if x.parent else x.chars
        row = [0.0] * len(TAGS)
        row[TAG_AT.get(x.tag, 2)] = 1.0
        own = TAG_AT.get(x.parent.tag, 2) if x.parent else 22
        row += [float(own), math.log1p(x.chars), math.log1p(x.words), x.links / x.chars, x.chars / x.nodes, x.commas / x.words, x.chars / x.words, x.chars / total, x.chars / up, x.chars / max(1, largest)]
        row += [float(x.controls), float(x.parent.controls if x.parent else 0), float(x.depth), float(k), float(n), k / n, math.log1p(before), math.log1p(after), math.log1p(x.nodes), float(size), seen / total]
        row += [float(x.hints >> b & 1) for b in range(len(KINDS))]
        row += [float(x.over >> b & 1) for b in range(len(KINDS))]
        row += [float(x.above >> b & 1) for b in range(len(ABOVE))]
        out.append(row)
        if x.tag == "text":
            seen += x.chars
    return out
