"""Main-text extraction from HTML by composite text density.

Every DOM node gets its composite density: characters per tag, adjusted by the share of link characters
(nodes that are mostly links fall to almost nothing). A run of text is measured as a node of one tag; elements
that only format text (b, br, span, ...) are no tags, as they say nothing of the layout. A parent's density sum
adds the densities of its children and its own runs of text. The threshold is the lowest density on the path from the node with the
largest sum to the body. From the body down, every branch that reaches the threshold gives its subtree with the
largest density sum; all these are the content, with the headings right before them. Branches below the threshold are
not, nor are blocks inside the content that are below it and hold little but several links (menus). An article or main element counts like any other.

Parts that the page itself marks as something else are left out beforehand: by tag (nav, header, footer, aside,
form, script, style, ...), by role or as hidden, and by a class or id that names a menu, footer, sidebar, notice, advert,
form or reader comments, with no words in it but such names and words of place or shape (``PARTS``). A form or fieldset around the whole page
and an article's own header with its title are no such parts (see ``_Builder.judge_tags``). A name leaves no element out
that holds most of the page's text, an article or a main, unless its whole name is one word of ``PARTS`` and the page has an
article or main with text elsewhere (see ``_Builder.leave_out``); a class or id of a header leaves out only what
the density would not take. There and in all other blocks, whatever they are called, the density decides.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by
two line feeds in page order. Null html counts as empty and gives an empty text; broken markup (unclosed or
stray tags) is read as browsers do in outline. Repeated pages are extracted each; extra columns are ignored.
Pages are independent: the extraction runs in Arrow batches without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NO_CONTENT = frozenset("head script style noscript template iframe object embed svg canvas nav header footer aside form button select option textarea input label fieldset dialog menu audio video map".split())
#: Those of them that the text inside may save.
BY_TEXT = frozenset(("form", "fieldset", "header"))
#: Elements whose end tags may be left out, and the start tags that close them.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CLOSED_BY = {tag: frozenset(k for k, v in CLOSES.items() if tag in v) for tag in frozenset().union(*CLOSES.values())}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Words of a class or id that name a part which is no content.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promoted promotion banner banners menu menus nav navbar navigation navlinks breadcrumb breadcrumbs pagination footer sidebar sidebars notice notices cookie cookies consent gdpr disclaimer newsletter subscribe subscription signup comment comments commentlist disqus replies respond".split()
)
#: Words that name the head of a page or of an article.
HEADS = frozenset("header masthead".split())
#: Words that may stand beside such names: places, shapes, numbers and the like.
BESIDE = frozenset(
    "site page main global top bottom left right upper lower side inner outer wrap wrapper container box area block section region list item items bar panel pane slot unit links primary secondary big small wide narrow reader user text body content fixed sticky mobile desktop overlay modal popup widget form policy the my js id 1 2 3 4 5 6 7 8 9 0".split()
)
#: Elements that only format text.
INLINE = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOUNDARY = "\0"


class Node:
    __slots__ = ("tag", "children", "parent", "skip", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, skip: bool = False):
        self.tag, self.parent, self.skip, self.children = tag, parent, skip, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether the element's role or visibility says that it is no content."""
    for name, value in attrs:
        if name == "role" and (value or "").strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


#: How an element is named: the head of something, a part among other words, one word.
HEAD, PART, WHOLE = 1, 2, 3


def _named(attrs: list[tuple[str, str | None]]) -> int:
    """How the element's classes and ids name it as a part without content; 0: they don't (has-sidebar, related-work)."""
    found = 0
    for name, value in attrs:
        if name in ("class", "id") and value:
            for token in value.split():
                words = [w for w in re.split(r"[_\-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w]
                parts = sum(w in PARTS for w in words)
                if all(w in PARTS or w in HEADS or w in BESIDE for w in words):
                    found = max(found, WHOLE if parts == len(words) == 1 else PART if parts else HEAD if any(w in HEADS for w in words) else 0)
    return found


#: A comment, declaration or tag; a quote that is not closed is an ordinary character.
TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+'|["'])*+)>)""", re.S)
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp")}


class _Builder:
    """A DOM of what may be content, from a flat pass over tags."""

    def __init__(self, html: str):
        self.root = self.at = Node("#root", None)
        self.named: dict[Node, int] = {}
        self.tagged: list[Node] = []
        low = 0
        while m := TAG.search(html, low):
            if m.start() > low:
                self.data(html[low : m.start()])
            low, tag = m.end(), (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self.end(tag)
            elif tag in RAW:
                close = RAW[tag].search(html, low)
                low = close.end() if close else len(html)
            else:
                self.start(tag, m[3])
                if m[3].endswith("/") and tag not in VOID and tag not in BLOCKS:
                    self.end(tag)
        if low < len(html):
            self.data(html[low:])
        if self.tagged:
            self.judge_tags()
        if self.named:
            self.leave_out()

    def start(self, tag: str, attrs: str) -> None:
        node = self.at
        closed = CLOSED_BY.get(tag)
        if closed:
            scope = SCOPES.get(tag, ())
            while node.parent is not None:
                if node.tag in closed:
                    self.at = node.parent
                    break
                if node.tag in scope or node.tag in BLOCKS and node.tag not in CLOSES:
                    break
                node = node.parent
        skip, named = tag in NO_CONTENT and tag not in BY_TEXT, 0
        if not skip and attrs and tag not in ("html", "body", "article", "main") and TELLING.search(attrs):
            pairs = [(n.lower(), unescape(x or y or z)) for n, x, y, z in ATTRIBUTE.findall(attrs)]
            skip = _hidden(pairs)
            named = 0 if skip else _named(pairs)
        new = Node(tag, self.at, skip)
        if tag in BY_TEXT and not skip:
            self.tagged.append(new)
        elif named:
            self.named[new] = named
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def end(self, tag: str) -> None:
        node, block = self.at, tag in BLOCKS or tag in ("html", "body")
        while node.parent is not None and node.tag != tag:
            if not block and node.tag in BLOCKS:
                return  # a stray inline end tag doesn't close blocks
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def judge_tags(self) -> None:
        """Skip forms, fieldsets and headers, except a form or fieldset that is wrapped around the page (it holds an article or main, or most of
        the page's text and a passage's worth of it), and an article's own header with its title."""
        nodes = _nodes(self.root)
        letters, holds, within = {}, {}, set()
        for node in nodes:
            if node.tag in ("article", "main") or node.parent in within:
                within.add(node)
        for node in reversed(nodes):
            kept = [c for c in node.children if isinstance(c, Node) and not c.skip]
            letters[node] = sum(_letters(c) for c in node.children if isinstance(c, str)) + sum(letters[c] for c in kept)
            holds[node] = any(c.tag in ("article", "main") or holds[c] for c in kept)
        for node in self.tagged:
            if node not in letters:
                node.skip = True  # inside of what is left out
            elif node.tag == "header":
                below = _nodes(node)
                linked = sum(_letters(c) for n in below if _in_link(n, node) for c in n.children if isinstance(c, str))
                node.skip = not (node in within and any(n.tag in HEADINGS for n in below) and 2 * linked <= letters[node])
            else:
                node.skip = not (holds[node] or 2 * letters[node] > letters[self.root] and letters[node] >= WRAPPED_LETTERS)

    def leave_out(self) -> None:
        """Skip elements named as such parts, except those that hold most of the page's text, an article or a main.

        An element whose whole class or id is such a name (comments, ad) may be long or hold articles of its own:
        where an article or main has text outside all named elements, it is skipped nevertheless. An element named
        a header is skipped only if it is mostly links or holds a few words.
        """
        nodes = _nodes(self.root)
        letters, holds, inside, outside = {}, {}, set(), {}
        for node in nodes:
            if node in self.named or node.parent in inside:
                inside.add(node)
        for node in reversed(nodes):
            kept = [c for c in node.children if isinstance(c, Node) and not c.skip]
            own = sum(_letters(c) for c in node.children if isinstance(c, str))
            letters[node] = own + sum(letters[c] for c in kept)
            outside[node] = 0 if node in inside else own + sum(outside[c] for c in kept)
            holds[node] = any(c.tag in ("article", "main") or holds[c] for c in kept)
        told = any(outside[n] for n in nodes if n.tag in ("article", "main"))
        for node, name in self.named.items():
            most = 2 * letters.get(node, 0) > letters[self.root]
            node.skip = name == WHOLE and told or not (most or holds.get(node))
            if node.skip and name == HEAD:
                linked = sum(_letters(c) for n in _nodes(node) if _in_link(n, node) for c in n.children if isinstance(c, str))
                node.skip = 2 * linked > letters.get(node, 0) or letters.get(node, 0) < HEAD_LETTERS and not any(n.tag in HEADINGS for n in _nodes(node))

    def data(self, text: str) -> None:
        self.at.children.append(unescape(text) if "&" in text else text)


def _nodes(root: Node) -> list[Node]:
    """All nodes that may be content, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.skip]
    return out


#: Letters from which a form that holds most of a page's text is wrapped around a passage.
WRAPPED_LETTERS = 200
#: Letters below which an element named as a header, without a heading, is no text.
HEAD_LETTERS = 80


def _in_link(node: Node, top: Node) -> bool:
    while node is not top and node is not None:
        if node.tag == "a":
            return True
        node = node.parent
    return False


def _letters(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\n") - text.count("\t")


def _density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite density; ``ratio``: the page's share of characters in links."""
    if not chars:
        return 0.0
    tags, link_tags, links = max(1, tags), max(1, link_tags), max(1, link_chars)
    base = math.log(chars / max(1, chars - link_chars) * links + ratio * chars + math.e)
    return max(0.0, chars / tags * math.log(max(1.0, chars / links * tags / link_tags), base)) if base > 1 else 0.0


def _measure(nodes: list[Node]) -> None:
    """Characters, tags and link counts of subtrees, then composite densities and density sums."""
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += _letters(c)
            elif not c.skip:
                node.chars += c.chars
                node.tags += c.tags + (c.tag not in INLINE)
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    body = nodes[0]
    ratio = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
        for c in node.children:
            if isinstance(c, str):
                n = _letters(c)
                node.total += _density(n, 1, n * (node.tag == "a"), 1, ratio)
            elif not c.skip:
                node.total += c.density


#: A block below the threshold with so many links, which hold so large a part of its characters, is a menu.
MENU_LINKS, MENU_SHARE = 3, 2 / 3


def _content(nodes: list[Node]) -> list[Node]:
    """Roots of the content: in every branch that reaches the threshold, from the body down, the subtree with the largest sum.

    Blocks inside them that are menus by their density are marked to be left out.
    """
    best = max(nodes, key=lambda n: n.total)
    threshold, node = best.density, best
    while node is not None:
        if node.chars:
            threshold = min(threshold, node.density)
        node = node.parent
    top: dict[Node, Node] = {}  # the node with the largest sum in each subtree, the first of equals
    for node in reversed(nodes):
        top[node] = max([node, *(top[c] for c in node.children if isinstance(c, Node) and not c.skip)], key=lambda n: n.total)
    chosen: set[Node] = {best}
    stack = [nodes[0]]
    while stack:
        node = stack.pop()
        if node in chosen or not node.chars or node.density < threshold:
            continue
        chosen.add(top[node])
        stack += [c for c in node.children if isinstance(c, Node) and not c.skip]
    for node in nodes:
        node.skip |= node.tag in BLOCKS and node.density < threshold and node.link_tags >= MENU_LINKS and node.link_chars > MENU_SHARE * node.chars and node not in chosen
    return [n for n in nodes if n in chosen]


class _Siblings(dict):
    """For each parent its children that count (no blanks, nothing skipped) and their places."""

    def __missing__(self, parent: Node) -> tuple[list, dict[Node, int]]:
        around = [c for c in parent.children if (c.strip() if isinstance(c, str) else not c.skip)]
        self[parent] = around, {c: i for i, c in enumerate(around) if isinstance(c, Node)}
        return self[parent]


def _headings(node: Node, siblings: _Siblings) -> list[Node]:
    """Headings right before a node, or before the elements that it begins."""
    out: list[Node] = []
    while node.parent is not None:
        around, places = siblings[node.parent]
        at = places[node]
        while at and isinstance(around[at - 1], Node) and around[at - 1].tag in HEADINGS:
            at -= 1
            out.append(around[at])
        if at:
            break
        node = node.parent
    return out


def _roots(nodes: list[Node]) -> list[Node]:
    """Where the text is taken from, in page order, none inside another.

    The subtree with the largest sum, and others in blocks without further blocks, are widened to their block.
    """
    content = _content(nodes)
    best = max(content, key=lambda n: n.total)
    found, siblings = set(), _Siblings()
    for node in content:
        up = node
        while up.parent is not None and up.tag not in BLOCKS:
            up = up.parent
        if node is best or not any(isinstance(c, Node) and not c.skip and c.tag in BLOCKS for c in up.children):
            node = up
        found.add(node)
        found.update(_headings(node, siblings))
    out, inside = [], set()
    for node in nodes:
        if node.parent in inside:
            inside.add(node)
        elif node in found:
            inside.add(node)
            out.append(node)
    return out or [nodes[0]]


def _gather(node: Node, out: list[str]) -> None:
    stack: list = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.tag == "br":
            out.append(" ")
        elif not item.skip:
            if item.tag in BLOCKS:
                out.append(BOUNDARY)
                stack.append(BOUNDARY)
            stack += reversed(item.children)


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html or not html.strip():
        return ""
    top = _Builder(html.replace(BOUNDARY, "\ufffd")).root
    stack = [top]
    while stack:
        node = stack.pop()
        if node.tag == "body":
            top = node
            break
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and c.tag in ("html", "body")]
    nodes = _nodes(top)
    _measure(nodes)
    if not top.chars:
        return ""
    parts: list[str] = []
    for root in _roots(nodes):
        _gather(root, parts)
        parts.append(BOUNDARY)
    blocks = (" ".join(b.split()) for b in "".join(parts).split(BOUNDARY))
    return "\n\n".join(b for b in blocks if b)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low in range(0, b.num_rows, 64):
            part = b.slice(low, 64)
            texts = [extract(h.as_py()) for h in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")
