"""Main text of web pages by wrapper induction.

For each host, the DOM trees of all its pages are aligned by simple tree
matching with the one that has the most elements (the base). What the pages tell
makes the host's wrapper:

- template texts: texts that stand in an element aligned with the same element of
  the base on a share of EVERY of the pages;
- the content slot: the least element of the base that holds nearly all of the
  varying text outside links; where it lies in an article or main element, that
  element;
- link slots: places with as many texts, nearly all inside links, on a share of
  EVERY of the pages.

A page's main text is what stands in the content slot, without template texts,
link slots, and what its markup names as a menu, page header, footer, sidebar,
notice, advert, form or comment; other names (share, related, legal, tags...) cut
only outside an article and outside the content slot. Where the host has no
wrapper, or the page doesn't follow it (its article element holds more than
twice as much), the text is that of the element marked as the article, and
without one that of the least element that holds all sentences.

All pages count; those that share their longest text are copies of one another
and count once. Pages are aligned each on its own, wherever they lie, so a host
that holds a third of all pages is never gathered; what is summed is a row for
each text and element.

Defined cases: a null or empty page has an empty text; a null url is a host of
its own; pages are extracted each on their own whatever their id; unclosed and
stray tags are tolerated; a page on which nothing but template texts is left
keeps them; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.shared import keep, maybe_broadcast, small_batches

#: Share of the varying text that the content slot holds, and share of a host's
#: pages that stands for all of them (of fewer than ten, all).
HELD, EVERY = 0.8, 0.9
#: Places of a table that matches two lists of children, at most.
CELLS = 40_000
#: Elements of the trees and alignments that a task holds for later pages, about.
HELD_ELEMENTS = 200_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
# Tag sets and names (fixed values).
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_OUT = set("nav footer aside form head script style noscript template iframe button select option datalist svg canvas dialog menu object audio video map fieldset textarea title".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"tr", "td", "th", "thead"}}
_STOPS = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# What the contract names (menus, headers, footers, sidebars, notices, adverts, forms, comments), and what else is no text on a page as a whole.
_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion sidebar aside comment comments commentlist respond reply replies "
    "discussion disqus cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer foot header masthead topbar form".split()
)
_AROUND = set("side popup modal overlay share sharing social related recommended recommendations widget copyright legal pagination pager toolbar skip search disclaimer paywall toc tags hidden".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}
_MAIN = set("content article post entry story main maincontent articlebody body text".split())
_PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "name", "kids", "out", "main")

    def __init__(self, tag: str, name: str = "", out: int = 0, main: int = 0):
        self.tag, self.name, self.kids, self.out, self.main = tag, name, [], out, main


def _attributes(tag: str, attrs: str) -> tuple[str, int, int]:
    """(class and id names, 1 if named as no part of the text, 2 if named as
    such only outside an article, rank as main element)."""
    names, out, around, rank = [], tag in _OUT, False, 0
    if tag == "article":
        rank = 3
    elif tag == "main":
        rank = 2
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names.append(value)
            elif key == "role":
                out |= value.lower() in _ROLES
                rank = max(rank, 2 * (value.lower() == "main"), 3 * (value.lower() == "article"))
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                out = True
        words = {w for v in names for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", v).lower())}
        if tag not in ("html", "body", "article", "main"):
            out |= bool(words & _NAMES)
            around = bool(words & _AROUND)
        if rank == 0 and not out and not around and tag in ("div", "section", "td") and words & _MAIN:
            rank = 1
    return " ".join(names), 1 if out else 2 * around, rank


def parse(page: str) -> Node:
    """A tree of elements and strings. Text of raw elements is left out."""
    root = Node("#root")
    stack = [root]
    opened: Counter = Counter()  # of the stack's tags, so that no stray tag looks through it

    def shut(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    at, low = 0, None
    for_next = _TOKEN.search
    while True:
        m = for_next(page, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if page.startswith("<![CDATA[", m.start()):
                stack[-1].kids.append(html.escape(page[m.start() + 9 : at].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br" or tag == "p" and not opened["p"]:
                stack[-1].kids.append("\n")
                continue
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    shut(i)
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break
            continue
        if tag in _VOID:
            if tag == "hr":
                stack[-1].kids.append(Node("hr"))
            elif tag in ("br", "wbr"):
                stack[-1].kids.append("\n" if tag == "br" else "")
            continue
        if tag in _RAW:
            if not (m[3] or "").rstrip().endswith("/"):
                low = low if low is not None else page.lower() if len(page.lower()) == len(page) else re.sub("[A-Z]", lambda x: x[0].lower(), page)
                end = low.find(f"</{tag}", at)
                if end < 0 and tag in ("title", "textarea", "noscript", "template"):
                    continue
                close = page.find(">", end) if end >= 0 else -1
                at = len(page) if end < 0 or close < 0 else close + 1
            continue
        if tag not in _INLINE:
            # A block ends an open paragraph, and with it its inline elements.
            for i in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[i].tag == "p":
                    shut(i)
                    break
                if stack[i].tag not in _INLINE:
                    break
            if (ends := _CLOSES.get(tag)) and any(opened[e] for e in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        shut(i)
                        break
                    if stack[i].tag in _STOPS:
                        break
        node = Node(tag, *_attributes(tag, m[3] or ""))
        stack[-1].kids.append(node)
        if not (m[3] or "").endswith("/") or tag not in ("path", "circle", "use"):
            stack.append(node)
            opened[tag] += 1
    stack[-1].kids.append(page[at:])
    return root


def _clean(parts: list[str]) -> str:
    text = "".join(parts)
    if "&" in text:
        text = html.unescape(text)
    return " ".join(text.split())


@dataclass
class Page:
    """A page's elements and blocks, in page order.

    Elements are numbered from 0, the root, after their parents; ``place`` is a
    hash of an element's path of labels. Blocks are texts without an element
    break in them: (text, out as in Node, main rank, number of the main element,
    element, characters inside links).
    """

    up: list[int] = field(default_factory=lambda: [0])
    label: list[str] = field(default_factory=lambda: ["#root"])
    place: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    blocks: list[tuple] = field(default_factory=list)

    def within(self, chosen) -> list[bool]:
        """For each element whether it is, or lies in, one of the chosen."""
        out = [chosen(0)]
        for k in range(1, len(self.up)):
            out.append(out[self.up[k]] or chosen(k))
        return out


_LINK_END = object()


def walk(root: Node) -> Page:
    """The page's elements and blocks."""
    page = Page()
    parts: list[str] = []
    linked = links = 0  # characters in links of this block; links open
    now = (0, 0, 0, 0)
    mains = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            if text := _clean(parts):
                page.blocks.append((text, *now, linked))
            parts, linked = [], 0

    # Each entry: a node, a string, or None with a frame to go back to.
    todo: list = [(root, now, False)]
    while todo:
        item, frame, header = todo.pop()
        if item is _LINK_END:
            links -= 1
            continue
        if isinstance(item, str):
            parts.append(item)
            if links:
                linked += len(item)
            continue
        if item is None:  # an element's end
            flush()
            now = frame
            continue
        cut = item.out if item.out == 1 or not now[1] else 0
        if item.tag in _INLINE and not cut and not item.main:
            if item.tag == "a":
                links += 1
                todo.append((_LINK_END, None, False))
            todo += [(k, frame, header) for k in reversed(item.kids)]
            continue
        flush()
        out, rank, number, above = now
        mine = 1 if 1 in (cut, out) else cut or out
        is_header = header or item.tag == "header" or "header" in item.name.lower()
        if item.tag == "header":
            mine = out or int(not rank)  # a page's header; an article's keeps its headings
        if item.main > rank and not mine:
            mains += 1
            rank, number = item.main, mains
        if is_header and rank and item.tag not in _HEADINGS and item.tag not in ("article", "main") and not item.main:
            mine = mine or int(item.tag not in ("header", "div", "hgroup"))
        todo.append((None, now, header))
        if item is not root:
            label = f"{item.tag}.{_stem(item.name)}" if item.name else item.tag
            page.up.append(above)
            page.label.append(label)
            page.place.append(_place(label, page.place[above]))
            page.tag.append(item.tag)
        now = (mine, rank, number, len(page.up) - 1)
        todo += [(k, now, is_header and bool(rank)) for k in reversed(item.kids)]
    flush()
    return page


def _place(label: str, above: int) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), above)


def _stem(name: str) -> str:
    """A class without its numbers, so that post-17 and post-18 match."""
    return re.sub(r"[0-9]+", "0", name)


def blocks(root: Node) -> list[tuple]:
    """(text, out, main rank, number of the main element, element, characters
    inside links) in page order."""
    return walk(root).blocks


@dataclass
class Wrapper:
    """What a host's pages have in common: the content slot's place or 0, marks
    of template texts, places of link slots."""

    content: int = 0
    marks: set[str] = field(default_factory=set)
    links: set[int] = field(default_factory=set)


def main_text(page: str | None, template: set[str] | Wrapper = frozenset(), marked: bool = True) -> str:
    """The main text of a page, given its host's wrapper (or template marks).
    Without ``marked`` only the wrapper decides, not what markup names."""
    if not page:
        return ""
    found = walk(parse(page))
    wrapper = template if isinstance(template, Wrapper) else Wrapper(marks=set(template))
    live = [b for b in found.blocks if not (marked and b[1] == 1)]
    if wrapper.marks or wrapper.links:
        link_slot = found.within(lambda k: found.place[k] in wrapper.links)
        rest = [b for b in live if not link_slot[b[4]] and not (wrapper.marks and _mark(found.place[b[4]], b[0]) in wrapper.marks)]
        live = rest or live
    outer = [b for b in live if not (marked and b[1])]
    by_marks = _marked(outer) if marked else []
    if wrapper.content:
        inside = found.within(lambda k: found.place[k] == wrapper.content)
        slot = [b for b in live if inside[b[4]]]
        if slot and 2 * sum(len(b[0]) for b in slot) >= sum(len(b[0]) for b in by_marks):
            return " ".join(b[0] for b in slot)
    return " ".join(b[0] for b in by_marks or _densest(outer or live, found.up))


def _marked(live: list) -> list:
    """The blocks of the element that is marked as the article, if any."""
    for rank in (3, 2, 1):
        sizes: Counter = Counter()
        for b in live:
            if b[2] >= rank:
                sizes[b[3] if b[2] == rank or rank == 3 else -1] += len(b[0])
        if sizes:
            if rank == 3:
                top = max(sizes, key=lambda k: (sizes[k], -k))
                return [b for b in live if b[2] == 3 and b[3] == top]
            return [b for b in live if b[2] >= rank]
    return []


def _densest(live: list, up: list[int]) -> list:
    """The blocks of the least element that holds all of the text in sentences
    (blocks of 8 words or more); of a single paragraph, its parent."""
    own: Counter = Counter()
    for b in live:
        if len(b[0].split()) >= 8:
            own[b[4]] += len(b[0])
    total = sum(own.values())
    if not total:
        return live
    # An element's number is above its parent's, so sums go up in one pass.
    held = [own[k] for k in range(len(up))]
    for k in range(len(up) - 1, 0, -1):
        held[up[k]] += held[k]
    best = max(k for k in range(len(up)) if held[k] == total)
    if best in own and len(own) > 1 or own[best] == total:
        best = up[best]
    inside = [False] * len(up)
    inside[best] = True
    for k in range(best + 1, len(up)):
        inside[k] = inside[up[k]]
    return [b for b in live if inside[b[4]]]


def _mark(place: int, text: str) -> str:
    return _digest(place, text).hex()


def _digest(place: int, text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"), place)


class Tree:
    """An element for matching: label, children, number, and ``shape``, a hash of
    the labels of its subtree."""

    __slots__ = ("label", "kids", "size", "shape", "element")

    def __init__(self, label: str, element: int):
        self.label, self.kids, self.size, self.shape, self.element = label, [], 1, 0, element


def _rooted(up: list[int], labels: list[str]) -> Tree:
    """The tree of elements, given each one's parent and label."""
    nodes = [Tree(label, k) for k, label in enumerate(labels)]
    for k in range(1, len(nodes)):
        nodes[up[k]].kids.append(nodes[k])
    for n in reversed(nodes):
        n.size = 1 + sum(k.size for k in n.kids)
        n.shape = hash((n.label, *(k.shape for k in n.kids)))
    return nodes[0]


def _tree(page: Page | Node) -> Tree:
    """The page's elements as a tree."""
    page = page if isinstance(page, Page) else walk(page)
    return _rooted(page.up, page.label)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The most pairs (i, j), sorted by i, of which j rises too."""
    ends: list[int] = []
    tops: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before.append(tops[at - 1] if at else -1)
        ends[at : at + 1], tops[at : at + 1] = [j], [n]
    out, n = [], tops[-1] if tops else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _by_turn(x: list, y: list, key, once: bool) -> list[tuple[int, int]]:
    """Places of the children of equal key, the first with the first and so on;
    with ``once`` of keys that either list has a single time."""
    places: dict = {}
    for j, k in enumerate(y):
        places.setdefault(key(k), []).append(j)
    seen = Counter(key(k) for k in x)
    turn: Counter = Counter()
    pairs = []
    for i, k in enumerate(x):
        there, n = places.get(key(k), ()), turn[key(k)]
        turn[key(k)] += 1
        if n < len(there) and not (once and (len(there) > 1 or seen[key(k)] > 1)):
            pairs.append((i, there[n]))
    return _rising(pairs)


def _split(x: list, y: list) -> tuple[list[tuple[Tree, Tree]], list[tuple[list, list]]]:
    """(pairs, gaps) of two lists of children: those that are paired off
    outright, and the lists between them that a table matches."""
    n = min(len(x), len(y))
    head = next((i for i in range(n) if x[i].shape != y[i].shape), n)
    tail = next((i for i in range(n - head) if x[-1 - i].shape != y[-1 - i].shape), n - head)
    pairs = [*zip(x[:head], y[:head], strict=True), *zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)]
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if len(x) * len(y) <= CELLS:
        return pairs, [(x, y)] if x and y else []
    gaps, i, j = [], 0, 0
    for p, q in [*_by_turn(x, y, lambda k: k.shape, True), (len(x), len(y))]:
        one, two = x[i:p], y[j:q]
        if len(one) * len(two) <= CELLS:
            gaps += [(one, two)] if one and two else []
        else:
            pairs += [(one[k], two[m]) for k, m in _by_turn(one, two, lambda k: k.label, False)]
        if p < len(x):
            pairs.append((x[p], y[q]))
        i, j = p + 1, q + 1
    return pairs, gaps


def tree_match(a: Tree, b: Tree) -> tuple[int, list[tuple[Tree, Tree]]]:
    """Simple tree matching: the largest number of pairs of equal labels that
    keep order and ancestry, and the pairs.

    Children of equal shape at the head and tail of both lists are paired off;
    what is left is matched by a table. A table of more than CELLS is cut first:
    at shapes that either list has once, and a part that is still larger is
    paired in the order of its labels. Scores are kept by the two subtrees'
    shapes, so equal rows cost one comparison.
    """
    known: dict[tuple[int, int], int] = {}

    def score(a: Tree, b: Tree) -> int | None:
        """None where it isn't known yet."""
        if a.label != b.label:
            return 0
        return a.size if a.shape == b.shape else known.get((a.shape, b.shape))

    def table(x: list, y: list) -> list[list[int]]:
        rows = [[0] * (len(y) + 1)]
        for k in x:
            above, row = rows[-1], [0]
            for j, m in enumerate(y):
                row.append(max(above[j + 1], row[j], above[j] + score(k, m)))
            rows.append(row)
        return rows

    todo = [(a, b)]
    while todo:
        one, two = todo[-1]
        if score(one, two) is not None:
            todo.pop()
            continue
        pairs, gaps = _split(one.kids, two.kids)
        open_ = {(k.shape, m.shape): (k, m) for k, m in pairs if score(k, m) is None}
        open_ |= {(k.shape, m.shape): (k, m) for x, y in gaps for k in x for m in y if score(k, m) is None}
        if open_:
            todo += open_.values()
            continue
        known[one.shape, two.shape] = 1 + sum(score(k, m) for k, m in pairs) + sum(table(x, y)[-1][-1] for x, y in gaps)
        todo.pop()
    total = score(a, b)
    found: list[tuple[Tree, Tree]] = []
    todo = [(a, b)] if total else []
    while todo:
        a, b = todo.pop()
        found.append((a, b))
        pairs, gaps = _split(a.kids, b.kids)
        todo += [(k, m) for k, m in pairs if score(k, m)]
        for x, y in gaps:
            rows, i, j = table(x, y), len(x), len(y)
            while i and j:
                s = score(x[i - 1], y[j - 1])
                if s and rows[i][j] == rows[i - 1][j - 1] + s:
                    todo.append((x[i - 1], y[j - 1]))
                    i, j = i - 1, j - 1
                elif rows[i][j] == rows[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
    return total, found


def _longest(page: Page) -> str:
    return max((b[0] for b in page.blocks if not b[1]), key=len, default="")


@dataclass
class Base:
    """The page that a host's pages are aligned with."""

    up: list[int]
    labels: list[str]

    def __post_init__(self):
        self.tree, self.place = _rooted(self.up, self.labels), _places(self.up, self.labels)
        self.first: dict[int, int] = {}
        for k, place in enumerate(self.place):
            self.first.setdefault(place, k)

    def aligned(self, up: list[int], labels: list[str]) -> tuple[list[int], list[bool], list[int]]:
        """For each element of a page: the base's element that it is aligned with,
        else the first one of the same place, else -1; whether it is aligned; its place."""
        place = _places(up, labels)
        at, matched = [self.first.get(p, -1) for p in place], [False] * len(place)
        for a, b in tree_match(self.tree, _rooted(up, labels))[1]:
            at[b.element], matched[b.element] = a.element, True
        return at, matched, place


def _places(up: list[int], labels: list[str]) -> list[int]:
    out = [0]
    for k in range(1, len(up)):
        out.append(_place(labels[k], out[up[k]]))
    return out


def _texts(page: Page) -> tuple[list[int], list[bytes], list[int], list[int]]:
    """(element, digest of place and text, characters, those in links) of a page's blocks."""
    b = page.blocks
    return [x[4] for x in b], [_digest(page.place[x[4]], x[0]) for x in b], [len(x[0]) for x in b], [x[5] for x in b]


def _told(found: tuple[list[int], list[bool], list[int]], texts: tuple, stands: dict, slots: dict) -> None:
    """Adds what an aligned page tells: to ``stands``, for each element of the
    base and text, [pages with the text there, its characters outside links]; to
    ``slots``, for each place and number of texts, [pages, characters, those in links]."""
    at, matched, place = found
    once, many = set(), {}
    for element, mark, size, linked in zip(*texts, strict=True):
        k = at[element]
        if k < 0:
            continue
        sums = stands.setdefault((k, mark), [0, 0])
        if matched[element] and (k, mark) not in once:
            once.add((k, mark))
            sums[0] += 1
        sums[1] += max(size - linked, 0)
        slot = many.setdefault(place[element], [0, 0, 0])
        slot[0], slot[1], slot[2] = slot[0] + 1, slot[1] + size, slot[2] + linked
    for where, (n, size, linked) in many.items():
        if n >= 3:
            sums = slots.setdefault((where, n), [0, 0, 0])
            sums[0], sums[1], sums[2] = sums[0] + 1, sums[1] + size, sums[2] + linked


def _content(up: list[int], labels: list[str], varying: list[int]) -> int:
    """The place of the content slot, or 0, given the varying characters of each element."""
    varying = list(varying)
    kids: list[list[int]] = [[] for _ in up]
    for k in range(len(up) - 1, 0, -1):
        varying[up[k]] += varying[k]
        kids[up[k]].append(k)
    at = 0
    while True:
        k = max(reversed(kids[at]), key=lambda e: varying[e], default=0)
        if not k or varying[k] < HELD * varying[0] or not kids[k] and at:
            break
        at = k
    if not varying[0] or not at:
        return 0
    best = k = at
    while k:
        tag = labels[k].split(".")[0]
        if tag in ("article", "main"):
            best = k
            if tag == "article":
                break
        k = up[k]
    return _places(up, labels)[best]


def wrapper(pages: list[str]) -> Wrapper:
    """The wrapper that the pages show; fewer than three different pages show none.

    All pages are aligned with the one that has the most elements.
    """
    chosen: dict[str, Page] = {}
    for p in sorted(set(pages)):
        walked = walk(parse(p))
        chosen.setdefault(_longest(walked), walked)
    if len(chosen) < 3:
        return Wrapper()
    top = max(chosen.values(), key=lambda p: len(p.up))
    base, stands, slots = Base(top.up, top.label), {}, {}
    for p in chosen.values():
        _told(base.aligned(p.up, p.label), _texts(p), stands, slots)
    varying, marks = [0] * len(top.up), set()
    for (k, mark), (n, size) in stands.items():
        if n >= EVERY * len(chosen):
            marks.add(mark.hex())
        else:
            varying[k] += size
    links = {place for (place, _), (n, size, linked) in slots.items() if n >= EVERY * len(chosen) and 10 * linked >= 9 * size}
    return Wrapper(_content(top.up, top.label, varying), marks, links)


def induce(pages: list[str]) -> list[str]:
    """Marks of the texts that stand in aligned elements of the pages."""
    return sorted(wrapper(pages).marks)


def host_of(url):
    """Lower-cased text between the first :// and the next / ? # or end."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


_PAGE = "host string, h long, key long, elements int, up array<int>, labels array<string>, at array<int>, marks array<binary>, sizes array<int>, linked array<int>"
_STANDS = "host string, element int, mark binary, place long, texts int, pages long, chars long, linked long"
WRAPPER = "host string, content long, marks array<string>, links array<long>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements and the blocks' digests of pages (host, h, html)."""
    types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            page = walk(parse(text))
            key = xxhash.xxh3_64_intdigest(_longest(page).encode("utf-8", "surrogatepass"))
            rows.append((_signed(key), len(page.up), page.up, page.label, *_texts(page)))
        arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["host", "h", "key", "elements", "up", "labels", "at", "marks", "sizes", "linked"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the pages of a batch tell (see :func:`_told`), in sums by host; rows
    of link slots have no mark. Pages of one shape are aligned once."""
    bases: dict[str, Base] = {}
    known: dict[tuple[str, bytes], tuple] = {}
    held = 0
    types = [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        told: dict[str, tuple[dict, dict]] = {}
        for host, base_up, base_labels, up, labels, *texts in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
            if held > HELD_ELEMENTS:
                bases, known, held = {}, {}, 0
            if host not in bases:
                bases[host] = Base(base_up, base_labels)
                held += 4 * len(base_up)
            shape = host, xxhash.xxh3_128_digest(repr((up, labels)).encode("utf-8", "surrogatepass"))
            if shape not in known:
                known[shape] = bases[host].aligned(up, labels)
                held += len(up)
            _told(known[shape], texts, *told.setdefault(host, ({}, {})))
        rows = [(host, k, mark, 0, 0, n, size, 0) for host, (stands, _) in told.items() for (k, mark), (n, size) in stands.items()]
        rows += [(host, -1, None, _signed(place), c, *sums) for host, (_, slots) in told.items() for (place, c), sums in slots.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["host", "element", "mark", "place", "texts", "pages", "chars", "linked"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, content, marks, links) from a host's base and sums."""
    for batch in batches:
        contents = []
        for up, labels, varying in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            sums = [0] * len(up)
            for one in varying or ():
                sums[one["element"]] = one["chars"]
            contents.append(_signed(_content(up, labels, sums)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.int64()), batch.column(4), batch.column(5)], names=["host", "content", "marks", "links"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, content, marks, links) of the hosts that show a wrapper, from all of their pages."""
    html_text = F.col(html_col).cast("string")
    keyed = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(html_text).alias("h"), html_text.alias("html")).where(F.col("html").isNotNull())
    parsed = keep(keyed.mapInArrow(_parsed, _PAGE).withColumn("row", F.monotonically_increasing_id()), "parsed")
    # Of the pages that share their longest text the one of the least hash counts.
    each = parsed.groupBy("host", "key").agg(F.min(F.struct("h", "row", "elements")).alias("one")).select("host", "one.*")
    each = keep(each, "different")
    hosts = each.groupBy("host").agg(F.count("*").alias("n"), F.max(F.struct("elements", "h", "row")).alias("base"))
    hosts = keep(hosts.where(F.col("n") >= 3).select("host", "n", F.col("base.row").alias("row"), F.col("base.elements").alias("elements")), "hosts")
    size = hosts.agg(F.count("*"), F.sum("elements")).first()
    base = parsed.join(maybe_broadcast(hosts.select("row", "n"), 16), "row").select("host", "n", F.col("up").alias("base_up"), F.col("labels").alias("base_labels"))
    base = keep(base, "bases")
    near = F.broadcast if 64 * size[0] + 32 * (size[1] or 0) <= (16 << 20) else lambda df: df
    counted = parsed.join(maybe_broadcast(each.select("row"), 16), "row", "left_semi").join(near(base), "host")
    told = counted.select("host", "base_up", "base_labels", "up", "labels", "at", "marks", "sizes", "linked").mapInArrow(_aligned, _STANDS)
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "linked")]
    told = keep(told.groupBy("host", "element", "mark", "place", "texts").agg(*sums), "told").join(near(base.select("host", "n")), "host")
    told = told.withColumn("every", F.col("pages") >= EVERY * F.col("n"))
    # A base's elements and the texts that stand on nearly all pages are few, whatever the number of pages.
    by_element = told.where(F.col("mark").isNotNull()).groupBy("host", "element").agg(
        F.sum(F.when(F.col("every"), 0).otherwise(F.col("chars"))).alias("chars"), F.collect_set(F.when(F.col("every"), F.lower(F.hex("mark")))).alias("marks")
    )
    stood = by_element.groupBy("host").agg(F.collect_list(F.struct("element", "chars")).alias("varying"), F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks"))
    linked = told.where(F.col("mark").isNull() & F.col("every") & (10 * F.col("linked") >= 9 * F.col("chars"))).groupBy("host").agg(F.collect_set("place").alias("links"))
    rows = base.join(stood, "host", "left").join(linked, "host", "left")
    rows = rows.select("host", "base_up", "base_labels", "varying", F.coalesce("marks", F.array().cast("array<string>")).alias("marks"), F.coalesce("links", F.array().cast("array<long>")).alias("links"))
    return keep(rows.mapInArrow(_decided, WRAPPER), "wrappers")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = []
            for page, content, marks, links in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                texts.append(main_text(page, Wrapper((content or 0) % (1 << 64), set(marks or ()), {x % (1 << 64) for x in links or ()})))
            yield pa.RecordBatch.from_arrays([part.column(4), part.column(5), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    small_batches(pages.sparkSession)
    found = wrappers(pages, url_col, html_col)
    size = found.agg(F.count("*"), F.sum(F.size("marks") + F.size("links"))).first()
    frame = pages.select(F.col(html_col).cast("string").alias("html"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("_host"))
    # Wrappers are sent everywhere only if all of them together are small.
    small = 64 * (size[0] or 0) + 40 * (size[1] or 0) <= (16 << 20)
    both = frame.join(F.broadcast(found) if small else found, F.col("_host") == F.col("host"), "left").select("html", "content", "marks", "links", "id", "url")
    schema = T.StructType([both.schema["id"], both.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return both.mapInArrow(_extract, schema).withColumnsRenamed({"id": id_col, "url": url_col})


#: The rows of the given tables in SQL: on their pages the main text is the
#: article element, in which b is the only inline element and two character references occur.
ORACLE_SQL = r"""
with a as (select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g') as inner_html from pages),
t as (select page_id, url, regexp_replace(replace(regexp_replace(inner_html, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g') as plain from a),
w as (select page_id, url, trim(regexp_replace(plain, '\s+', ' ', 'g')) as text from t)
select page_id, url, text, cast(len(text) as bigint) as n_chars from w"""
