"""Block trees of HTML pages and their alignment by simple tree matching."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import xxhash

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)|[^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math xmp noembed noframes".split())
_ENDS = {tag: re.compile(f"</{tag}\\b[^>]*>", re.I) for tag in RAW}
BLOCK = frozenset(
    "address article aside blockquote body center caption col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Never part of an article's text, wherever they stand.
DROPPED = frozenset("nav footer aside form button select option datalist dialog menu head canvas object audio video map".split())
#: Page furniture unless within an article.
OUTSIDE = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status note".split())
#: Words of class and id attributes that name page furniture.
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead header footer sidebar aside rail ad ads adsense advert adverts advertisement "
    "advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login "
    "share sharing social comment comments disqus reply replies respond related recommended recommendations widget pagination pager toolbar".split()
)
#: Words that may stand beside them and tell where or how: "left-sidebar"; "share-price" is no furniture.
PLACES = frozenset(
    "main top bottom left right site page global primary secondary first second wrapper wrap container box block list bar area section inner outer holder "
    "item items link links button buttons icon icons panel group row col column module unit slot zone region fixed sticky mobile desktop small large mini sub the media".split()
)
#: Words of an article's own parts: "article-comments" are furniture, an "article-header" is its headline.
PARTS = frozenset("article articles post posts entry story stories news content text title body thread form".split())
OWN = frozenset("header footer banner notice".split())
#: A name that begins so tells of the page's state: "has-sidebar" is no sidebar.
STATES = frozenset("has with without no is js".split())
KEPT_ROOTS = frozenset("html body main article".split())
#: An element that starts closes an open one of these, up to a boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P = ({"p"}, frozenset("table td th button body article section div".split()))


@dataclass
class Node:
    """A block element, or a text slot (tag "#")."""

    tag: str
    children: list = field(default_factory=list)
    text: str = ""
    shape: int = 0
    index: int = -1
    size: int = 1
    linked: int = 0
    in_article: bool = False
    furniture: bool = False


def names_furniture(name: str) -> bool:
    """Whether one name of a class or id attribute says furniture: all its words do, or tell where it is."""
    parts = [x.lower() for x in _NAME.findall(name)]
    found = NAMES.intersection(parts)
    if not found or parts[0] in STATES:
        return False
    rest = set(parts) - NAMES - PLACES
    return not rest or rest <= PARTS and not found <= OWN


@lru_cache(20_000)
def furniture(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's attributes say that it is no content, and that it is the article."""
    main = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            if value.lower() in ROLES:
                return True, False
            main = main or value.lower() in ("main", "article")
        elif name == "style":
            if _HIDDEN.search(value):
                return True, False
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        elif tag not in KEPT_ROOTS and any(map(names_furniture, value.split())):
            return True, False
    return False, main


def parse(page: str) -> Node:
    """The tree of a page's blocks, furniture included, with its texts as slots in page order."""
    root = Node("html")
    #: (tag, node or None for inline elements, furniture, within an article, within a link)
    stack: list[tuple[str, Node | None, bool, bool, bool]] = [("", root, False, False, False)]
    owners, opened = [root], Counter()
    buffer, linked, at = [], 0, 0
    #: (place in the stack, text, characters in links) around inline furniture, which doesn't part a block's text
    around: list[tuple[int, list[str], int]] = []

    def put(parts: list[str], n: int, furniture: bool) -> None:
        raw = "".join(parts)
        if text := " ".join((html.unescape(raw) if "&" in raw else raw).split()):
            owners[-1].children.append(Node("#", text=text, linked=n, in_article=stack[-1][3], furniture=furniture))

    def flush() -> None:
        nonlocal linked, buffer
        for k, (place, parts, n) in enumerate(around):
            put(parts, n, False)
            around[k] = (place, [], 0)
        if buffer:
            put(buffer, linked, stack[-1][2])
            buffer, linked = [], 0

    def pop_to(depth: int) -> None:
        nonlocal linked, buffer
        blocks = sum(e[1] is not None for e in stack[depth:])
        if blocks:
            flush()
        while around and around[-1][0] >= depth:
            put(buffer, linked, True)
            _, buffer, linked = around.pop()
        for e in stack[depth:]:
            opened[e[0]] -= 1
        del stack[depth:]
        if blocks:
            del owners[-blocks:]

    token = _TOKEN.search
    while m := token(page, at):
        if m.start() > at:
            buffer.append(page[at : m.start()])
            if stack[-1][4]:
                linked += m.start() - at
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br" or opened[tag] <= 0:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break  # a stray end of an inline element
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                buffer.append("" if tag == "wbr" else " ")
            continue
        attributes = m[3]
        if tag in RAW:
            if attributes.endswith("/") and tag in ("svg", "math"):
                continue
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            closed, boundary = CLOSES.get(tag, _P)
            if any(opened[c] > 0 for c in closed):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closed:
                        pop_to(k)
                        break
                    if stack[k][0] in boundary:
                        break
        _, _, skipped, in_article, in_link = stack[-1]
        named, main = furniture(tag, attributes) if "=" in attributes or "hidden" in attributes else (False, False)
        skips = skipped or named or tag in DROPPED or tag in OUTSIDE and not in_article
        in_article = in_article or main or tag in ("article", "main")
        node = None
        if tag not in BLOCK and skips and not skipped:
            around.append((len(stack), buffer, linked))
            buffer, linked = [], 0
        if tag in BLOCK:
            flush()
            node = Node(tag)
            owners[-1].children.append(node)
            owners.append(node)
        opened[tag] += 1
        stack.append((tag, node, skips, in_article, in_link or tag == "a"))
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return shaped(root)


def shaped(root: Node) -> Node:
    """Numbers the nodes in page order and gives each a number for its subtree's tags."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.index = len(order)
        order.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in node.children)
        node.shape = hash_of(node.tag + ":" + ",".join(str(c.shape) for c in node.children)) & 0xFFFFFFFF
    return root


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode())


def slots(root: Node) -> list[Node]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "#":
            found.append(node)
        todo.extend(reversed(node.children))
    return found


def content(root: Node, constant: frozenset[int] = frozenset()) -> list[Node]:
    """The slots of the article: those that vary and aren't named furniture.

    Of a page that marks its article those within it; else those that aren't mostly links. ``constant``:
    indices of slots that belong to the host's template.
    """
    every = [s for s in slots(root) if not s.furniture]
    marked = any(s.in_article for s in every)
    return [s for s in every if s.index not in constant and (s.in_article if marked else 2 * s.linked <= len(s.text))]


CONTAINERS = frozenset("html div section table nav header footer aside main article form center body".split())


def layout(root: Node) -> int:
    """A number, never 0, for the sequence of containers below a page's body."""
    top = root
    while len(inner := [c for c in top.children if c.tag in CONTAINERS]) == 1:
        top = inner[0]
    names = ",".join(c.tag for c in top.children if c.tag in CONTAINERS)
    return hash_of(names) >> 1 | 1


def packed(root: Node) -> bytes:
    """Tags, depths and the slots' text hashes in page order."""
    rows, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        rows.append((hash_of(node.text) if node.tag == "#" else 0, depth, tag_number(node.tag)))
        todo.extend((c, depth + 1) for c in reversed(node.children))
    return np.array(rows, dtype=[("text", "<u8"), ("depth", "<u4"), ("tag", "<u4")]).tobytes()


@lru_cache(10_000)
def tag_number(tag: str) -> int:
    return hash_of(tag) & 0xFFFFFFFF


def unpacked(data: bytes) -> tuple[Node, list[int]]:
    """The tree, tags as numbers, and for each node its text's hash (0: no slot)."""
    rows = np.frombuffer(data, dtype=[("text", "<u8"), ("depth", "<u4"), ("tag", "<u4")])
    path: list[Node] = []
    for depth, tag in zip(rows["depth"].tolist(), rows["tag"].tolist(), strict=True):
        node = Node(str(tag))
        del path[depth:]
        if path:
            path[-1].children.append(node)
        path.append(node)
    return shaped(path[0]), rows["text"].tolist()


#: Pairs of children up to which a plain table is filled; beyond it numpy fills it row by row.
CELLS = 400
#: Pairs of children up to which a table is kept for the way back; beyond it the lists are halved, which needs two rows only.
TABLE = 4_000_000


def ends_of(p: list[Node], q: list[Node]) -> tuple[int, int]:
    """How many children of equal shapes two lists have at their beginnings, and at their ends: these pair off in a largest matching."""
    i, n = 0, min(len(p), len(q))
    while i < n and p[i].shape == q[i].shape:
        i += 1
    j = 0
    while j < n - i and p[-1 - j].shape == q[-1 - j].shape:
        j += 1
    return i, j


def match(a: Node, b: Node) -> list[tuple[int, int]]:
    """Pairs (index in a, index in b) of an order-preserving matching of two trees with equal roots' tags.

    Simple tree matching: a largest one, however long the lists of children. What two subtrees have in common
    follows from their shapes, so that each pair of shapes is looked at once. It needs no recursion, so that
    depth doesn't matter.
    """
    known: dict[tuple[int, int], int] = {}
    cut: dict[tuple[int, int], tuple[int, int]] = {}

    def size(x: Node, y: Node) -> int | None:
        if x.tag != y.tag:
            return 0
        return x.size if x.shape == y.shape else known.get((x.shape, y.shape))

    def rows_of(p: list[Node], q: list[Node]):
        """The rows of the table one after another; each has one number more than ``q`` has children."""
        if len(p) * len(q) <= CELLS:
            above = [0] * (len(q) + 1)
            yield above
            for x in p:
                row = [0]
                for k, y in enumerate(q):
                    row.append(max(above[k + 1], row[-1], above[k] + size(x, y)))
                above = row
                yield above
            return
        kinds = {y.shape: y for y in q}
        at = {shape: k for k, shape in enumerate(kinds)}
        place = np.array([at[y.shape] for y in q])
        gains: dict[int, np.ndarray] = {}
        above = np.zeros(len(q) + 1, np.int64)
        yield above
        for x in p:
            if x.shape not in gains:
                gains[x.shape] = np.array([size(x, y) for y in kinds.values()], np.int64)
            row = np.zeros(len(q) + 1, np.int64)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + gains[x.shape][place]), out=row[1:])
            above = row
            yield above

    def last(p: list[Node], q: list[Node]):
        for row in rows_of(p, q):
            pass
        return row

    def aligned(p: list[Node], q: list[Node]) -> list[tuple[Node, Node]]:
        """Pairs of children in a largest matching of two lists."""
        out, lists = [], [(p, q)]
        while lists:
            p, q = lists.pop()
            m, n = len(p), len(q)
            if m > 1 and m * n > TABLE:
                half = m // 2
                both = np.asarray(last(p[:half], q)) + np.asarray(last(p[half:][::-1], q[::-1]))[::-1]
                k = int(both.argmax())
                lists += [(p[:half], q[:k]), (p[half:], q[k:])]
                continue
            rows = list(rows_of(p, q))
            while m and n:
                if rows[m][n] == rows[m - 1][n]:
                    m -= 1
                elif rows[m][n] == rows[m][n - 1]:
                    n -= 1
                else:
                    m, n = m - 1, n - 1
                    out.append((p[m], q[n]))
        return out

    pairs: list[tuple[int, int]] = []
    if a.tag != b.tag:
        return pairs
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        key = (x.shape, y.shape)
        if size(x, y) is not None:
            todo.pop()
            continue
        i, j = cut[key] if key in cut else ends_of(x.children, y.children)
        p, q = x.children[i : len(x.children) - j], y.children[i : len(y.children) - j]
        if key not in cut:
            cut[key] = i, j
            kinds_p, kinds_q = ({c.shape: c for c in z}.values() for z in (p, q))
            if missing := [(c, d) for c in kinds_p for d in kinds_q if size(c, d) is None]:
                todo += missing
                continue
        same = sum(c.size for c in x.children[:i]) + sum(c.size for c in x.children[len(x.children) - j :])
        known[key] = 1 + same + int(last(p, q)[-1])
        todo.pop()
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x.index, y.index))
        c, d = x.children, y.children
        if x.shape == y.shape:
            todo += zip(c, d, strict=True)
            continue
        i, j = cut[x.shape, y.shape]
        todo += zip(c[:i], d[:i], strict=True)
        todo += zip(c[len(c) - j :], d[len(d) - j :], strict=True)
        todo += aligned(c[i : len(c) - j], d[i : len(d) - j])
    return pairs
