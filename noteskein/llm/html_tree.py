"""Trees of block elements of HTML pages: a small reader for one page, and the shapes that pages are aligned by.

Inline elements are no nodes; their text belongs to the block around them. End tags may be missing where HTML allows it,
stray ones are passed over, and a page may break off anywhere. Text of elements that are never shown is not read.

A page's shape is its tree with runs of equal siblings taken as one node, so that a list or a text of any number of
paragraphs has one shape. It is written as one line per node, depth and label, parents first.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

# Elements by their part in HTML, and names that tell the part of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
HIDDEN = frozenset(
    "head title script style noscript template iframe noembed noframes object svg math canvas audio video map select datalist".split()
)
ASIDES = frozenset("nav footer aside form dialog menu button fieldset textarea".split())
HEADS = frozenset("meta link base title script style noscript template".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th caption figcaption".split())
CLOSE_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section table ul".split()
)
#: Elements that a block of text ends at; others, as a script, may stand within one.
BREAKS = CLOSE_P | frozenset("html head body caption legend summary tbody td tfoot th thead tr".split())
NODES = BREAKS | HIDDEN | ASIDES
#: A start tag ends these open elements, up to the element that bounds the search.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
BOUNDS_P = frozenset("td th caption table button object".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner nav navbar "
    "navigation menu submenu breadcrumb breadcrumbs sidebar aside widget widgets related recommended recommendations footer cookie "
    "cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription "
    "signup signin login share sharing social comment comments commentlist disqus respond reply replies search searchbox pagination "
    "pager toolbar skip".split()
)
#: These name a part beside the text only outside of an article, whose own head has its title.
OUTER_NAMES = frozenset("header masthead topbar".split())
#: A class that starts with one of these tells a state, not the part of the page.
STATES = frozenset("has with no is without".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)(>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(
    r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/]|$))", re.I
)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Kind(NamedTuple):
    """What a start tag says: its label in shapes, whether it is never shown, and whether it stands beside the text."""

    label: str
    hidden: bool
    beside: bool
    outer: bool


@lru_cache(maxsize=1 << 14)
def kind_of(tag: str, attributes: str) -> Kind:
    values: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        values.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    hidden = tag in HIDDEN or "hidden" in values or values.get("aria-hidden", "").lower() == "true"
    hidden = hidden or "display:none" in re.sub(r"\s", "", values.get("style", "").lower())
    names = [*values.get("class", "").split(), *values.get("id", "").split()]
    parts: set[str] = set()
    for name in names:
        words = [w.lower() for w in NAME_PARTS.findall(name)]
        if words and words[0] not in STATES:
            parts.update(words)
    role = values.get("role", "").strip().lower()
    if tag in ("html", "body", "main"):
        parts = set()
    elif tag == "article":
        parts &= {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "sponsored", "promo"}
    # Long numbers tell pages apart, not parts of a page.
    label = ".".join([tag, *sorted({re.sub(r"\d{3,}|[^\w-]", "", n) for n in names} - {""})])
    beside = tag in ASIDES or role in ROLES or bool(parts & NAMES)
    return Kind(label, hidden, beside, tag == "header" or role == "banner" or bool(parts & OUTER_NAMES))


class Block(NamedTuple):
    node: int
    text: str
    #: Code points within links.
    linked: int


class Page(NamedTuple):
    tags: list[str]
    labels: list[str]
    children: list[list[int]]
    #: Per node: stands beside the text; lies in an article.
    beside: list[bool]
    inside: list[bool]
    blocks: list[Block]


def read_page(html: str) -> Page:
    """The tree of a page, and its blocks of shown text in page order."""
    tags, labels, children = ["page"], ["page"], [[]]
    beside, inside, hidden = [False], [False], [False]
    blocks: list[Block] = []
    stack = [0]
    opened: dict[str, int] = {}
    owner = 0
    pieces: list[str] = []
    linked: list[str] = []
    link = False

    def flush() -> None:
        nonlocal pieces, linked, link
        link = False
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(owner, text, len(" ".join("".join(linked).split()))))
            pieces, linked = [], []

    def close(found: set[str] | frozenset[str], bounds: set[str] | frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of ``found`` with all in it, unless a bound stands before it."""
        if not any(opened.get(tag) for tag in found):
            return
        for at in range(len(stack) - 1, 0, -1):
            tag = tags[stack[at]]
            if tag in found:
                if any(tags[node] in BREAKS for node in stack[at:]):
                    flush()
                for node in stack[at:]:
                    opened[tags[node]] -= 1
                del stack[at:]
                return
            if tag in bounds:
                return

    def add(text: str) -> None:
        nonlocal owner
        if not hidden[stack[-1]]:
            text = unescape(text) if "&" in text else text
            if not pieces:
                owner = stack[-1]
            pieces.append(text)
            if link:
                linked.append(text)

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "a":
                link = False
            elif tag not in ("html", "body"):
                close({tag})
            continue
        if not m[2] or not m[4]:
            continue
        tag = m[2].lower()
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        kind = kind_of(tag, m[3].rstrip("/"))
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            at = stop.start() if stop else end
        if opened.get(tag) and tag in ("html", "body"):
            continue
        if tag not in HEADS and tags[stack[-1]] == "head":
            close({"head"})
        if tag in CLOSE_P:
            close({"p"}, BOUNDS_P)
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        if tag in NODES or kind.beside or kind.hidden or opened.get(tag):
            if tag in BREAKS:
                flush()
            parent, node = stack[-1], len(tags)
            tags.append(tag)
            labels.append(kind.label)
            children.append([])
            children[parent].append(node)
            inside.append(inside[parent] or tag in MAIN)
            beside.append(beside[parent] or kind.beside or (kind.outer and not inside[parent]))
            hidden.append(hidden[parent] or kind.hidden or (kind.beside and tag not in BREAKS))
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
        elif tag == "a":
            link = True
    flush()
    return Page(tags, labels, children, beside, inside, blocks)


def collapsed(page: Page) -> tuple[str, list[int]]:
    """The page's shape, and the shape's node of each node of the page."""
    known: dict[tuple, int] = {}
    keys = [0] * len(page.tags)
    runs: list[list[list[int]]] = [[] for _ in page.tags]
    for node in range(len(page.tags) - 1, -1, -1):  # children come after their parents
        for child in page.children[node]:
            if runs[node] and keys[runs[node][-1][0]] == keys[child]:
                runs[node][-1].append(child)
            else:
                runs[node].append([child])
        keys[node] = known.setdefault((page.labels[node], *(keys[r[0]] for r in runs[node])), len(known))
    lines: list[str] = []
    place = [0] * len(page.tags)
    todo = [([0], 0)]
    while todo:
        members, depth = todo.pop()
        for node in members:
            place[node] = len(lines)
        lines.append(f"{depth} {page.labels[members[0]]}")
        # Members are equal, so their runs stand for each other.
        for nth in range(len(runs[members[0]]) - 1, -1, -1):
            todo.append(([child for node in members for child in runs[node][nth]], depth + 1))
    return "\n".join(lines), place


class Shape:
    """A shape read back, with numbers that are equal for equal subtrees of shapes read with the same ``known``."""

    def __init__(self, text: str, known: dict):
        lines = [line.split(" ", 1) for line in text.split("\n")]
        self.labels = [label for _, label in lines]
        self.children: list[list[int]] = [[] for _ in lines]
        path: list[int] = []
        for node, (depth, _) in enumerate(lines):
            del path[int(depth) :]
            if path:
                self.children[path[-1]].append(node)
            path.append(node)
        self.size, self.key = [1] * len(lines), [0] * len(lines)
        for node in range(len(lines) - 1, -1, -1):
            self.size[node] += sum(self.size[c] for c in self.children[node])
            self.key[node] = known.setdefault((self.labels[node], *(self.key[c] for c in self.children[node])), len(known))


def align(one: str, other: str) -> list[int]:
    """Simple tree matching: the node of ``other`` that each node of ``one`` is matched with, or -1.

    A matching keeps labels, order and parents, and has as many pairs as possible. Equal children at both ends are matched
    first, which loses no pair; so equal trees take one step a node, others a table per pair of child lists.
    """
    known: dict = {}
    a, b = Shape(one, known), Shape(other, known)
    weight: dict[tuple[int, int], int] = {}

    def ends(i: int, j: int) -> tuple[int, int]:
        x, y = a.children[i], b.children[j]
        most = min(len(x), len(y))
        head = next((k for k in range(most) if a.key[x[k]] != b.key[y[k]]), most)
        tail = next((k for k in range(most - head) if a.key[x[-1 - k]] != b.key[y[-1 - k]]), most - head)
        return head, tail

    def table(x: list[int], y: list[int]) -> list[list[int]]:
        rows = [[0] * (len(y) + 1)]
        for p in x:
            row, above = [0], rows[-1]
            for k, q in enumerate(y):
                row.append(max(row[k], above[k + 1], above[k] + (weight[p, q] if a.labels[p] == b.labels[q] else 0)))
            rows.append(row)
        return rows

    def middle(i: int, j: int) -> tuple[list[int], list[int], int, int]:
        head, tail = ends(i, j)
        x, y = a.children[i], b.children[j]
        return x[head : len(x) - tail], y[head : len(y) - tail], head, tail

    todo = [(0, 0)] if a.labels[0] == b.labels[0] else []
    while todo:
        i, j = todo[-1]
        if (i, j) in weight:
            todo.pop()
            continue
        if a.key[i] == b.key[j]:
            weight[i, j] = a.size[i]
            continue
        x, y, head, tail = middle(i, j)
        need = [(p, q) for p in x for q in y if a.labels[p] == b.labels[q] and (p, q) not in weight]
        if need:
            todo.extend(need)
            continue
        kept = a.children[i][:head] + a.children[i][len(a.children[i]) - tail :]
        weight[i, j] = 1 + sum(a.size[c] for c in kept) + table(x, y)[-1][-1]

    match = [-1] * len(a.labels)
    pairs = [(0, 0)] if a.labels[0] == b.labels[0] else []
    while pairs:
        i, j = pairs.pop()
        if a.key[i] == b.key[j]:
            match[i : i + a.size[i]] = range(j, j + a.size[i])
            continue
        match[i] = j
        x, y, head, tail = middle(i, j)
        if head:
            pairs.extend(zip(a.children[i][:head], b.children[j][:head]))
        if tail:
            pairs.extend(zip(a.children[i][-tail:], b.children[j][-tail:]))
        rows = table(x, y)
        p, q = len(x), len(y)
        while p and q:
            if rows[p][q] == rows[p - 1][q]:
                p -= 1
            elif rows[p][q] == rows[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                pairs.append((x[p], y[q]))
    return match
