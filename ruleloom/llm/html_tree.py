"""Web pages as trees of elements: text blocks, and hashes of the elements' subtrees."""

from __future__ import annotations

import html
import re

import xxhash

TOKEN = re.compile(
    r"""<!--.*?(?:-->|--!>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>"""
    r"""|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NOT_NAME = re.compile(r"[^a-z0-9]+")

# Fixed values of HTML: how elements nest.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
LEVEL = set(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre search section summary caption table tbody td tfoot th thead tr "
    "ul".split()
)
TABLE_PARTS = set("caption tbody td tfoot th thead tr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
OUTER = set("html head body".split())
# A start tag that ends an open element of these names, looked for up to an element that is neither inline nor among the second names.
ENDS = {
    "li": ({"li"}, {"p", "div", "address"}), "dd": ({"dd", "dt"}, {"p", "div", "address"}), "dt": ({"dd", "dt"}, {"p", "div", "address"}),
    "option": ({"option"}, set()), "tr": ({"tr"}, LEVEL - {"table"}), "td": ({"td", "th"}, LEVEL - {"table", "tr"}),
    "th": ({"td", "th"}, LEVEL - {"table", "tr"}),
    **{name: ({"tbody", "thead", "tfoot", "caption"}, LEVEL - {"table"}) for name in ("tbody", "thead", "tfoot")},
}

# Elements, roles and words of class and id that mark what is not the main text.
ASIDE = set("aside button canvas dialog footer form menu nav noscript object search select svg template".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MARKS = set(
    "ad ads adbox adsbygoogle adslot advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
# Within an article these hold its text, and stay however often they recur.
PROSE = set("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th tr".split())
# Elements nested deeper belong to their ancestor of this depth.
DEEPEST = 256


def hashed(parts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x01".join(parts)) - (1 << 63)


class Node:
    __slots__ = ("name", "parent", "level", "depth", "marked", "article", "holds_article", "parts", "has_text", "hash")

    def __init__(self, name: str, parent: Node | None, level: bool):
        self.name, self.parent, self.level = name, parent, level
        self.depth = parent.depth + 1 if parent else 0
        self.marked = self.article = self.holds_article = self.has_text = False
        self.parts: list[str] = [name]
        self.hash = 0


class Tree:
    """The elements of a page in order, and its blocks: their element and their pieces of text with the innermost element."""

    def __init__(self, source: str):
        self.root = Node("", None, True)
        self.nodes: list[Node] = []
        self.blocks: list[tuple[Node, list[tuple[Node, str]]]] = []
        self.pieces: list[tuple[Node, str]] = []
        self.top = self.root
        self._read(source)
        while self.top is not self.root:
            self._close()
        self._flush()

    def _read(self, source: str) -> None:
        at, find = 0, TOKEN.search
        while True:
            token = find(source, at)
            if token is None:
                self._text(source[at:])
                return
            if token.start() > at:
                self._text(source[at:token.start()])
            at = token.end()
            name = token[2]
            if name is None:
                continue
            name = name.lower()
            if token[1]:
                self._end(name)
                continue
            self._start(name, token[3])
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                at = close.end() if close else len(source)

    def _text(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append((self.top, text))
        if not self.top.has_text and not text.isspace() and text:
            node = self.top
            while node is not None and not node.has_text:
                node.has_text, node = True, node.parent
        self.top.parts.append(" ".join(text.split()))

    def _flush(self) -> None:
        if self.pieces:
            if any(not text.isspace() and text for _, text in self.pieces):
                node = self.top
                while not node.level:
                    node = node.parent
                self.blocks.append((node, self.pieces))
            self.pieces = []

    def _close(self) -> None:
        """Ends the innermost element."""
        node = self.top
        if node.level:
            self._flush()
        parent = node.parent
        node.hash = hashed(node.parts)
        node.parts = []
        parent.parts.append("" if node.marked else str(node.hash))
        parent.holds_article |= node.article or node.holds_article
        self.top = parent

    def _close_to(self, node: Node) -> None:
        while self.top is not node.parent:
            self._close()

    def _open(self, names: set[str], through: set[str]) -> Node | None:
        """The innermost open element of these names, looked for through inline elements and those of ``through``."""
        node = self.top
        while node is not self.root:
            if node.name in names:
                return node
            if node.level and node.name not in through:
                return None
            node = node.parent
        return None

    def _start(self, name: str, attributes: str) -> None:
        if name in OUTER or name in RAW:
            return
        level = name in LEVEL
        if level:
            if name not in TABLE_PARTS:
                self._end_paragraph()
            ends = ENDS.get(name)
            if ends is not None:
                before = self._open(*ends)
                if before is not None:
                    self._close_to(before)
            elif name in HEADINGS and self.top.name in HEADINGS:
                self._close()
            self._flush()
        if name in VOID:
            if name in ("br", "hr"):
                self.pieces.append((self.top, " "))
            return
        node = Node(name, self.top, level and self.top.depth < DEEPEST)
        if attributes:
            node.parts.append(attributes.strip())
            self._marks(node, attributes)
        if name in ASIDE:
            node.marked = True
        elif name in ("article", "main") and not node.marked:
            node.article = True
        self.nodes.append(node)
        self.top = node

    @staticmethod
    def _marks(node: Node, attributes: str) -> None:
        for found in ATTRIBUTE.finditer(attributes):
            key = found[1].lower()
            value = (found[2] or found[3] or found[4] or "").lower()
            if key in ("class", "id"):
                words = NOT_NAME.split(value)
                if not MARKS.isdisjoint(words):
                    node.marked = True
            elif key == "role":
                node.marked |= value in ROLES
                node.article |= value == "main"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                node.marked = True
            elif key == "itemprop" and value == "articlebody":
                node.article = True
        if node.marked:
            node.article = False

    def _end_paragraph(self) -> None:
        open_p = self._open({"p"}, set())
        if open_p is not None:
            self._close_to(open_p)

    def _end(self, name: str) -> None:
        if name == "p":
            self._end_paragraph()
            return
        if name == "br":
            self.pieces.append((self.top, " "))
            return
        if name in HEADINGS:
            found = self._open(HEADINGS, LEVEL)
        elif name in LEVEL:
            found = self._open({name}, LEVEL)
        else:
            found = self._open({name}, set())
        if found is not None:
            self._close_to(found)


def page_blocks(source: str) -> tuple[int, list[tuple[int, bool]], list[tuple[str, list[int]]]]:
    """A page's story, the hashes of its subtrees, and its blocks of text.

    The story is the hash of the first heading of the article, else of the longest block: pages that tell the same story count
    as one page where recurrence is counted.  Subtrees are those of elements that are not inline, have text, and do not hold the
    article; with each goes whether it lies within the article.  Those of the article's own paragraphs, headings, list items and
    cells are left out.  Blocks are outside marked elements (which count as unmarked if they alone hold an article), each with the hashes of the subtrees around it that were given.
    """
    tree = Tree(source)
    under = {tree.root: False}
    for node in tree.nodes:
        under[node] = node.marked or under[node.parent]
    # An article in the open makes sure of those under marks: readers' comments, teasers of other pages.
    in_open = any(node.article and not under[node] for node in tree.nodes)
    gone, inside, around = {tree.root: False}, {tree.root: False}, {tree.root: []}
    seen = []
    for node in tree.nodes:
        parent = node.parent
        within = inside[node] = inside[parent] or node.article
        marked = node.marked or (node.name == "header" and not within)
        lost = gone[node] = gone[parent] or (marked and (in_open or within or not node.holds_article))
        chain = around[parent]
        if node.level and node.has_text and not node.article and not node.holds_article and not (within and node.name in PROSE):
            key = node.hash ^ within
            seen.append((key, within))
            if not lost:
                chain = [*chain, key]
        around[node] = chain

    blocks, heading, longest = [], None, ""
    for node, pieces in tree.blocks:
        text = " ".join("".join(text for owner, text in pieces if not gone[owner]).split())
        if text:
            blocks.append((text, around[node]))
            if len(text) > len(longest):
                longest = text
            if heading is None and inside[node] and node.name in HEADINGS:
                heading = text
    return hashed([heading or longest]), seen, blocks
