"""Main text of web pages by scoring the element tree.

A page is read into a tree with the usual repairs (implied end tags, unclosed elements,
raw script and style text). Menus, forms, adverts, notices, comments and the like are
taken out by element and by class or id cues. A cue is a whole name (``sidebar``) or one
made of cue and layout words (``cookie-notice``, ``site-footer``); ``has-sidebar``,
``related-reading`` or ``social-science`` are none. What a cue or a form marks stays all the
same if it holds an article or main element, or, on a page without any, most of the text
outside links: then it is the frame of the page and its parts are judged on their own.

Every text block passes points for its length and commas to its ancestors, halved at each
step and discounted by the share of link text. The container with the most points is kept.
Inside an article or main element every other text block of that element is kept too,
whatever its length, unless it is mostly links; so are the articles beside an article.
Elsewhere siblings are kept by the same rule, except that generic containers right below
the body need a fifth of the best one's points.

All steps are single passes over the tree from the root down or from the leaves up, so
time grows with the size of a page, however deep it nests.

Defined results: NULL, empty and text-free pages give the empty string. Repeated rows give
equal texts, an empty table an empty one. Nothing is cut.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
DROPPED = frozenset(
    "head script style noscript template iframe nav header footer aside form button select input textarea "
    "label fieldset dialog menu object embed svg canvas audio video map title noembed noframes".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Elements that an opening tag of the same family ends, up to the given container.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of class, id and role values that mark what is no main text.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices pagination pager paywall popup promo promos promotion related replies reply respond share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget banner complementary contentinfo "
    "search alert copyright".split()
)
#: Words that join cue words to longer names without changing their meaning.
LAYOUT = frozenset(
    "area article articles bar block body bottom box btn button buttons card cell center col column columns "
    "container content count entry fixed form global group head heading holder icon icons inline inner item items "
    "label left link links list lists main mobile module modules more outer overlay page panel post posts primary "
    "region right row secondary section site slot sticky story tab tabs text title top unit wrap wrapper zone "
    "sm md lg xl".split()
)
#: Words that say something of the element's surroundings, not of itself.
ABOUT = frozenset("has no not with without is".split())
#: Cues that a heading may carry as a part of the text.
HEADLINE = frozenset("header masthead banner notice notices alert search login social".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are given up unless they hold the page's text.
FRAMES = frozenset("form fieldset dialog".split())
#: Cues whose elements never hold the article, however long they are.
TALK = frozenset("comment comments disqus replies reply respond".split())
#: Boxes without a meaning of their own.
CONTAINERS = frozenset("div section center".split())
WANTED = frozenset("article body content entry main post story text".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PIECES = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Why an element may be given up: by its kind, as a frame or by a name, or by a name of reader comments.
HARD, SOFT, READERS = 1, 2, 3


class Node:
    __slots__ = ("tag", "parent", "base", "children", "drop", "named", "bonus", "linked_in", "good", "plain", "score", "linked", "length", "kept")

    def __init__(self, tag: str, parent: Node | None, drop: int = 0, named: bool = False, bonus: float = 0.0) -> None:
        self.tag, self.parent, self.drop, self.named, self.bonus = tag, parent, drop, named, bonus
        #: the nearest element around that is not inline
        self.base = parent if parent is None or parent.tag not in INLINE else parent.base
        self.children: list[Node | str] = []
        self.score = 0.0
        self.plain = self.linked = self.length = 0
        self.linked_in = self.good = self.kept = False


def cues(tag: str, attributes: str) -> tuple[int, bool, float]:
    """Reason to give the element up (0 if none), whether it is by name, and the bonus of its names."""
    if not attributes:
        return 0, False, 0.0
    reason, wanted, doubtful = 0, False, False
    for found in ATTRIBUTE.finditer(attributes):
        name = found[1].lower()
        value = next((v for v in (found[2], found[3], found[4]) if v is not None), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return HARD, False, 0.0
        if name == "style" and HIDING.search(value):
            return HARD, False, 0.0
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = {p.lower() for p in PIECES.findall(CAMEL.sub(" ", word))}
                marks = parts & UNWANTED
                if parts & ABOUT:
                    continue
                if not marks:
                    wanted = wanted or bool(parts & WANTED)
                elif not parts <= UNWANTED | LAYOUT:
                    doubtful = True
                    wanted = wanted or bool(parts & WANTED)
                elif not (tag in HEADINGS and marks <= HEADLINE):
                    reason = max(reason, READERS if marks & TALK else SOFT)
    return reason, reason > 0, 5.0 if wanted else -2.0 if doubtful else 0.0


class Page:
    """The tree of a page while it is read: ``nodes`` come before the nodes inside them."""

    def __init__(self, text: str) -> None:
        self.root = Node("root", None)
        self.nodes = [self.root]
        self.here = self.root
        #: open elements per tag, and inline ones per tag and block around them
        self.open: dict = {}
        self._read(text)

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            found = TOKEN.search(page, at)
            if found is None:
                self.here.children.append(entities.unescape(page[at:]))
                break
            if found.start() > at:
                self.here.children.append(entities.unescape(page[at : found.start()]))
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                self._close(tag)
                continue
            self._make_room(tag)
            reason, named, bonus = cues(tag, found[3])
            if tag in FRAMES:
                reason = max(reason, SOFT)
            elif tag in DROPPED:
                reason = HARD
            elif named and tag in ("html", "body", "article", "main"):
                reason = 0  # not given up for a name
            node = Node(tag, self.here, reason, named, bonus)
            self.here.children.append(node)
            self.nodes.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            elif tag not in VOID and not found[3].endswith("/"):
                self._count(node, 1)
                self.here = node

    def _count(self, node: Node, step: int) -> None:
        self.open[node.tag] = self.open.get(node.tag, 0) + step
        if node.tag in INLINE:
            key = id(node.base), node.tag
            self.open[key] = self.open.get(key, 0) + step

    def _leave(self, node: Node) -> None:
        """Go on in ``node``, an element around the present one; those between are closed."""
        while self.here is not node:
            self._count(self.here, -1)
            self.here = self.here.parent

    def _close(self, tag: str) -> None:
        """An end tag without a start is ignored; that of an inline element reaches to the block around it."""
        if tag in INLINE:
            base = self.here.base if self.here.tag in INLINE else self.here
            if not self.open.get((id(base), tag)):
                return
        elif not self.open.get(tag):
            return
        node = self.here
        while node.tag != tag:
            node = node.parent
        self._leave(node.parent)

    def _make_room(self, tag: str) -> None:
        """Close what a start tag ends."""
        if tag in CLOSES_P:
            base = self.here.base if self.here.tag in INLINE else self.here
            if base.tag == "p":
                self._leave(base.parent)
                return
        if tag in IMPLIED:
            ended, within = IMPLIED[tag]
            left = sum(self.open.get(t, 0) for t in ended)
            node, last = self.here, None
            while left and node.parent is not None and node.tag not in within:
                if node.tag in ended:
                    last, left = node, left - 1
                node = node.parent
            if last is not None:
                self._leave(last.parent)


def settle(page: Page) -> None:
    """Decide which marked elements stay, as the frame of the page's text."""
    hidden = {id(page.root): False}
    for node in page.nodes[1:]:
        node.linked_in = node.parent.linked_in or node.tag == "a"
        hidden[id(node)] = hidden[id(node.parent)] or node.drop == HARD
    for node in reversed(page.nodes):
        if not node.linked_in and not hidden[id(node)]:
            node.plain += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.good = node.good or (node.tag in ("article", "main") and not node.named)
        if node.drop in (SOFT, READERS) and node.good:
            node.drop = 0
        if node.parent is not None:
            node.parent.plain += node.plain
            node.parent.good = node.parent.good or (node.good and not node.drop)
    if not page.root.good:
        for node in page.nodes:
            if node.drop == SOFT and 2 * node.plain > page.root.plain:
                node.drop = 0


def blocks(top: Node) -> list[tuple[Node, str, int]]:
    """Text blocks in page order: (holding element, text, characters of link text)."""
    out: list[tuple[Node, str, int]] = []
    pending: list[str] = []
    linked = 0
    holder = top

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pending).split())
        if text:
            out.append((holder, text, min(linked, len(text))))
        pending.clear()
        linked = 0

    # (node, next child, link depth) without recursion, as pages may nest deeply
    stack: list[list] = [[top, 0, top.tag == "a"]]
    while stack:
        node, k, link = stack[-1]
        if k == len(node.children):
            stack.pop()
            if node.tag not in INLINE:
                flush()
                holder = node.base or top
            continue
        stack[-1][1] += 1
        child = node.children[k]
        if isinstance(child, str):
            pending.append(child)
            linked += len(child.strip()) if link else 0
        elif child.tag == "br" or child.tag == "hr":
            pending.append(" ")
        elif not child.drop:
            if child.tag not in INLINE:
                flush()
                holder = child
            stack.append([child, 0, link or child.tag == "a"])
    flush()
    return out


def points(text: str, linked: int) -> float:
    """One point, one per comma and up to three for length, less the share of links."""
    commas = sum(text.count(c) for c in ",،、，")
    return (1 + commas + min(len(text) / 100, 3.0)) * (1 - linked / len(text))


def main_text(page: str | None) -> str:
    """Text of the article, its blocks joined by one space."""
    if not page:
        return ""
    tree = Page(page)
    settle(tree)
    found = blocks(tree.root)
    if not found:
        return ""
    for holder, text, linked in found:
        node = holder
        if holder.tag not in ("article", "main", "section", "body", "div"):
            node = holder.parent or holder  # a paragraph's points go to its container
        node.score += points(text, linked)
        holder.length += len(text)
        holder.linked += linked
    touched = []
    for node in reversed(tree.nodes):  # from the leaves up: half of the points go on to the parent
        if node.parent is not None:
            node.parent.score += node.score / 2
            node.parent.length += node.length
            node.parent.linked += node.linked
        if node.score > 0 and node.length:
            touched.append(node)
    for node in touched:
        node.score += node.bonus + (10.0 if node.tag in ("article", "main") else 0.0)
        node.score *= 1 - node.linked / max(node.length, 1)
    best = max(reversed(touched), key=lambda n: n.score, default=tree.root)
    best.kept = True
    above = risen(best)
    for parent in above:
        whole = parent.tag not in ("body", "html", "root")
        for sibling in parent.children:
            if isinstance(sibling, Node) and not sibling.drop and 2 * sibling.linked < sibling.length:
                if whole or sibling.tag not in CONTAINERS or sibling.score >= 0.2 * best.score:
                    sibling.kept = True
    loose = {id(parent) for parent in above}
    for parent in above:
        parent.kept = False
    for node in tree.nodes[1:]:
        node.kept = node.kept or node.parent.kept
    texts = []
    for holder, text, linked in found:
        if holder.kept or (id(holder) in loose and holder.tag not in ("body", "html", "root") and 2 * linked < len(text)):
            texts.append(text)
    return " ".join(texts)


def risen(best: Node) -> list[Node]:
    """Elements whose other blocks go with the best one's: up to the outermost article or main."""
    if best.tag in ("body", "html", "root"):
        return []
    path, top = [], 0
    node: Node | None = best
    while node is not None:
        path.append(node)
        if node.tag in ("article", "main"):
            top = len(path) - 1
        node = node.parent
    # beside an article or another container there may be more of the text, beside main not
    return path[1 : top + 1 if path[top].tag == "main" else top + 2]


def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract_text(html: Column) -> Column:
    """Main text of an html column."""
    return F.pandas_udf(_main_texts, "string")(html)
