"""Main text of web pages by composite text density.

The page becomes a tree of elements.  What is never main text by its tag or its class (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) is cut
out first.  Reader comments, adverts, sidebars, menus and footers go whatever their size, unless they
hold the only article or main element; a form, header, notice or the like stays if it holds one
outside any other, or running text and over half of the page's unlinked characters.  Each remaining node gets its characters per tag, adjusted by the links among
them; a node's sum is that of its children's densities, its own direct text counting as one
child.  The node with the largest sum is the core.  If it stands in an article or main
element, that element is the main text, with those beside it of the same tag whose density reaches
the least density on the path from the core up to the body; otherwise every node whose density reaches the least
density on that path adds the node of largest sum below it.

Every step is linear in the page, however it is nested and whatever it leaves open.  Parsing is row work inside a task; pages are dealt as they are read, without a shuffle.
Defined results: a null or empty page, or one without text, gives the empty text; unclosed
elements end with their parent, stray end tags are passed over; repeated rows and ties give
equal results, the first node in page order winning a tie.  Other columns are carried along.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillcast.llm.common import fresh

VOID = {"area", "base", "basefont", "br", "col", "embed", "frame", "hr", "img", "input", "link",
        "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del",
          "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
          "var", "wbr"}
#: Elements that are never main text.
CUT = {"head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form",
       "button", "select", "textarea", "input", "iframe", "frame", "object", "embed", "applet",
       "svg", "canvas", "audio", "video", "map", "menu", "dialog", "title", "datalist"}
#: Elements whose content is text up to their end tag.
RAW = {"script", "style", "textarea", "title", "iframe"}
#: Words of a class, id or role that are never main text.
CUT_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor",
             "sponsored", "promo", "promotion", "sidebar", "menu", "nav", "navbar", "navigation",
             "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "popup", "modal",
             "newsletter", "subscribe", "signup", "share", "sharing", "social", "comment",
             "comments", "disqus", "replies", "respond", "toolbar", "pager", "pagination", "login",
             "search", "contentinfo", "complementary", "alert", "alertdialog", "footer"}
#: Of these, the words of what others wrote or paid for: no share of the page makes it main text.
FOREIGN = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor",
           "sponsored", "promo", "promotion", "sidebar", "comment", "comments", "disqus", "replies",
           "respond", "complementary"}
FOREIGN_TAGS = {"aside", "nav", "footer", "menu"}
#: Words that are not main text unless the same element calls itself content as well.
DOUBTFUL = {"header", "masthead", "banner", "notice", "notices", "disclaimer", "widget", "related",
            "recommended", "side", "skip", "topbar", "teaser", "teasers", "rail"}
CONTENT_NAMES = {"article", "post", "entry", "content", "story", "body", "main"}
#: Elements without text of their own for a reader: these go whatever they hold.
NEVER = {"head", "script", "style", "noscript", "template", "select", "textarea", "input", "iframe",
         "frame", "object", "embed", "applet", "svg", "canvas", "audio", "video", "map", "title",
         "datalist"}
#: Words of a class that speak of the layout: what follows one says nothing of the element.
LAYOUT = {"has", "no", "with", "without", "hide", "show"}
#: Elements whose names say nothing of their kind, but for a class that is a foreign word as a whole.
UNNAMED = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6", "p"}
PAGE = {"html", "body", "main"}
#: Elements that running text stands in.
PROSE = {"p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Start tags that end an open paragraph.
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div",
            "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
            "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre",
            "section", "summary", "table", "ul"}
#: Start tags that end an open element of their kind, within the nearest of the given parents.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
          "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
          "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
          "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
          "option": ({"option"}, {"select", "datalist"})}
_SPACES = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")
_NUMBER = re.compile(r"[-_]?[0-9]+$")


class Node:
    """An element: its children are nodes and strings, in page order."""

    __slots__ = ("tag", "names", "named_cut", "foreign", "children", "chars", "link_chars", "tags",
                 "link_tags", "density", "sum", "best", "holds", "prose", "plain")

    def __init__(self, tag: str, names: frozenset = frozenset(), named_cut: bool = False,
                 foreign: bool = False):
        self.tag, self.names, self.named_cut, self.children = tag, names, named_cut, []
        if tag in UNNAMED:
            self.foreign = foreign and tag not in PAGE
        else:
            self.foreign = tag in FOREIGN_TAGS or named_cut and not FOREIGN.isdisjoint(names)
        self.best = self
        self.holds = self.prose = False
        self.plain = 0
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def _names(attrs) -> tuple[frozenset, bool, bool]:
    """The words of an element's class and role and its id; whether these name boilerplate, and
    whether a class is a foreign word as a whole.

    An id counts as a whole, but for a number at its end.  A class that names content, and
    nothing else, outweighs the others.
    """
    names, cut, content, whole = set(), False, False, False
    for key, value in attrs:
        if key == "id" and value:
            name = _NUMBER.sub("", value.strip().lower())
            names.add(name)
            cut = cut or name in CUT_NAMES
        elif key in ("class", "role") and value:
            for token in value.lower().split():
                whole = whole or _NUMBER.sub("", token) in FOREIGN
                words = _NAME.findall(token)
                words = [w for w, before in zip(words, ["", *words]) if before not in LAYOUT]
                names.update(words)
                if not CUT_NAMES.isdisjoint(words):
                    cut = True
                elif words and words[-1] in CONTENT_NAMES:
                    content = True
    return frozenset(names), cut and not content, whole and not content


class _Builder:
    """The tree of a page.  Where each kind of open element stands is kept, so that nothing has to
    be sought among the open ones."""

    def __init__(self):
        self.root = Node("#page")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def _last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def _end(self, at: int) -> None:
        """End the open element at this place and all within it."""
        while len(self.open) > at:
            gone = self.open.pop()
            self.places[gone.tag].pop()
            if gone.tag not in INLINE:
                self.blocks.pop()

    def start(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        if tag in ("html", "body") and self.places.get(tag):
            return
        if tag in CLOSES_P:
            self._close({"p"}, P_BOUNDS)
        if tag == "body":
            self._close({"head"}, set())
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = Node(tag, *_names(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            if tag not in INLINE:
                self.blocks.append(len(self.open))
            self.open.append(node)

    def _close(self, tags, within) -> None:
        """End the innermost open element of the given kinds, unless a boundary comes first."""
        at = max(map(self._last, tags))
        if at > 0 and all(self._last(t) <= at for t in within):
            self._end(at)

    def end(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body"):
            return
        at = self._last(tag)
        if at > 0 and not (tag in INLINE and self.blocks[-1] > at):
            self._end(at)

    def text(self, data: str) -> None:
        self.open[-1].children.append(data)


#: Open elements that a new block does not look beyond for a paragraph to end.
P_BOUNDS = {"button", "table", "td", "th", "object", *CUT}
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*)?")
_PLAIN_VALUE = re.compile(r"[^\s>]*")
_TAG_END = re.compile(r"[\s/]*>")


def _attributes(html: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The attributes from a place on, and the place behind the tag; -1 if the tag never ends."""
    attrs = []
    while True:
        closed = _TAG_END.match(html, at)
        if closed:
            return attrs, closed.end()
        found = _ATTRIBUTE.match(html, at)
        if not found:
            return attrs, -1
        name, at = found[1].lower(), found.end()
        value = ""
        if found[0].rstrip().endswith("="):
            quote = html[at:at + 1]
            if quote in ("'", '"') and quote:
                stop = html.find(quote, at + 1)
                if stop < 0:
                    return attrs, -1
                value, at = html[at + 1:stop], stop + 1
            else:
                value = _PLAIN_VALUE.match(html, at)[0]
                at += len(value)
        attrs.append((name, unescape(value)))


def parse(html: str) -> Node:
    """The tree of a page, in one pass.  What the page's end cuts off inside a tag, a comment or a
    script is no text."""
    builder, at = _Builder(), 0
    while at < len(html):
        mark = html.find("<", at)
        if mark < 0:
            mark = len(html)
        if mark > at:
            builder.text(unescape(html[at:mark]))
        after = html[mark + 1:mark + 2]
        if mark == len(html):
            break
        if html.startswith("<!--", mark):
            stop = html.find("-->", mark + 2)
            at = stop + 3
        elif after in ("!", "?") or after == "/" and not html[mark + 2:mark + 3].isalpha():
            stop = html.find(">", mark)
            at = stop + 1
        elif after == "/":
            name = _TAG_NAME.match(html, mark + 2)
            stop = html.find(">", mark)
            at = stop + 1
            if name and stop >= 0:
                builder.end(name[0].lower())
        elif after.isascii() and after.isalpha():
            tag = _TAG_NAME.match(html, mark + 1)
            name = tag[0].lower()
            attrs, stop = _attributes(html, tag.end())
            at = stop
            if stop >= 0:
                builder.start(name, attrs)
                if name in RAW:
                    end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                    if not end:
                        break
                    at = end.start()
        else:
            builder.text("<")
            stop, at = 0, mark + 1
        if stop < 0:
            break
    return builder.root


def _survey(root: Node) -> bool:
    """What each element holds: an article or main element, running text, unlinked characters.

    True if an article or main element stands outside all foreign elements.
    """
    left, order, own = [(root, False)], [], False
    while left:
        node, foreign = left.pop()
        order.append(node)
        foreign = foreign or node.foreign
        own = own or not foreign and node.tag in ("article", "main")
        left += [(c, foreign) for c in node.elements()]
    for node in reversed(order):
        inner = [c for c in node.elements() if c.tag not in NEVER]
        node.holds = any(c.holds or c.tag in ("article", "main") and not c.named_cut for c in inner)
        node.prose = any(c.prose or c.tag in PROSE for c in inner)
        node.plain = 0 if node.tag == "a" else sum(c.plain for c in inner) + sum(
            _length(c) for c in node.children if isinstance(c, str))
    return own


def _boilerplate(node: Node, in_article: bool, total: int, own: bool) -> bool:
    if node.tag in NEVER or node.foreign and (own or not node.holds):
        return True
    if node.tag not in CUT and not (node.tag == "header" and not in_article):
        if node.tag in UNNAMED:
            return False
        if not (node.named_cut or node.names & DOUBTFUL and not node.names & CONTENT_NAMES
                and node.tag != "header"):
            return False
    # What holds most of the page's running text or the article is never cut whole.
    if node.holds and not in_article:
        if node.tag != "form":
            node.children = [c for c in node.elements() if c.tag not in INLINE and (
                c.holds or c.prose or c.tag in PROSE or c.tag in ("article", "main"))]
        return False
    return not (node.prose and 2 * node.plain > total)


def _cut(root: Node) -> list[Node]:
    """Take boilerplate out of the tree; the elements left, each before its children."""
    own = _survey(root)
    left, order = [(root, False)], []
    while left:
        node, inside = left.pop()
        order.append(node)
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children
                         if not isinstance(c, Node) or not _boilerplate(c, inside, root.plain, own)]
        left += [(c, inside) for c in reversed(node.elements())]
    return order


def _length(text: str) -> int:
    return len(_SPACES.sub(" ", text).strip())


def _densities(order: list[Node], body: Node) -> None:
    for node in reversed(order):
        own = sum(_length(c) for c in node.children if isinstance(c, str))
        inner = node.elements()
        node.chars = own + sum(c.chars for c in inner)
        node.tags = sum(1 + c.tags for c in inner)
        linked = node.tag == "a"
        node.link_chars = node.chars if linked else sum(c.link_chars for c in inner)
        node.link_tags = sum((c.tag == "a") + c.link_tags for c in inner)
    share = body.link_chars / max(1, body.chars)
    for node in reversed(order):
        chars, tags = node.chars, max(1, node.tags)
        links, link_tags = max(1, node.link_chars), max(1, node.link_tags)
        plain = max(1, node.chars - node.link_chars)
        base = math.log(chars / plain * node.link_chars + share * chars + math.e)
        ratio = max(chars / links * tags / link_tags, 1.0)
        node.density = chars / tags * math.log(ratio) / max(math.log(base), 1.0) if chars else 0.0
        direct = sum(_length(c) for c in node.children if isinstance(c, str))
        node.sum = direct + sum(c.density for c in node.elements())
        # The node of largest sum at or below, the first in page order among equals.
        node.best = node
        for child in node.elements():
            if child.best.sum > node.best.sum:
                node.best = child.best


def _path(body: Node, core: Node) -> list[Node]:
    """From the body down to the core."""
    parents, left = {}, [body]
    while left:
        top = left.pop()
        for child in top.elements():
            parents[id(child)] = top
            left.append(child)
    path = [core]
    while path[-1] is not body:
        path.append(parents[id(path[-1])])
    return path[::-1]


def _main(body: Node) -> list[Node]:
    core = body.best
    path = _path(body, core)
    least = min(node.density for node in path)
    for above, node in zip([body, *path], path):
        if node.tag in ("article", "main"):
            return [c for c in above.elements()
                    if c is node or c.tag == node.tag and c.density >= least] if above is not node else [node]
    found, left = [core], [body]
    while left:
        top = left.pop()
        if top is not body and top.density >= least and top.tag not in INLINE:
            found.append(top.best)
        left += top.elements()
    return found


def _text(body: Node, chosen: list[Node]) -> str:
    """All text in the chosen subtrees: a space between blocks and for any white space."""
    wanted, out = {id(n) for n in chosen}, []
    left: list = [(body, False)]
    while left:
        top, inside = left.pop()
        if isinstance(top, str):
            if inside:
                out.append(top)
            continue
        inside = inside or id(top) in wanted
        gap = " " if top.tag not in INLINE or top.tag == "br" else ""
        left.append((gap, True))
        left += [(c, inside) for c in reversed(top.children)]
        left.append((gap, True))
    return _SPACES.sub(" ", "".join(out)).strip()


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    order = _cut(root)
    body = next((n for n in order if n.tag == "body"), root)
    _densities(order, body)
    return _text(body, _main(body))


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """The given columns without the page, and: ``text`` and ``n_chars``, its code points."""
    others = [c for c in pages.columns if c != html_column]
    text, n_chars, page = fresh(pages.select(others), "text", "n_chars", "page")
    frame = pages.select(*others, pages[html_column].alias(page))
    schema = frame.select(others).schema.add(text, T.StringType()).add(n_chars, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(others))), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], [*others, text, n_chars])

    return frame.mapInArrow(run, schema)
