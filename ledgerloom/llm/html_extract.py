"""Main text of HTML pages by scores that paragraphs pass up the tree."""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import text_batches
from ledgerloom.llm.words import slices

# Element kinds of the HTML standard, and names that pages give to what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul caption br option".split()
)
CLOSES_P = BLOCK - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
#: a start tag closes an open element of the first set, unless one of the second is nearer
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"tbody", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
DROPPED = frozenset(
    "head script style title textarea xmp iframe noembed noframes noscript nav footer aside button select option datalist "
    "input label object embed applet svg canvas audio video map template dialog menu search".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
NEGATIVE = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disclaimer disqus feedback footer foot form hidden login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination paging popup promo promoted promotion recommended related replies reply "
    "respond rss share sharing shoutbox sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar "
    "toc tracking widget".split()
)
#: readers' comments, whatever else they are called
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond shoutbox".split())
#: a name that begins so tells what stands beside an element, or doesn't
MODIFIERS = frozenset("has with without no not".split())
POSITIVE = frozenset("article articles body content entry hentry main page post story text".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main figcaption body center".split())
#: paragraphs of these kinds pass their points to the parent, others hold them themselves
PASSING = frozenset("p pre td blockquote li dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: of these the parts of a name ("cookie-notice") count as well as the whole; a paragraph of class "verb-form" is none
CONTAINERS = frozenset("div section article ul ol dl table tr tbody main figure details center".split())
#: an end tag of a paragraph or list item ends nothing beyond these
BARRIERS = ("article", "section", "table", "body", "td", "ul", "ol", "div")

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: characters from which a paragraph passes on points
MIN_PARAGRAPH = 25


#: how sure it is that an element is no part of an article: by part of a name, by a whole name, by kind, role or style
MAYBE, NAMED, CERTAIN = 1, 2, 3


class Node:
    __slots__ = ("tag", "parent", "children", "doubt", "header", "dropped", "score")

    def __init__(self, tag: str, parent: Node | None, doubt: int, header: bool = False):
        self.tag, self.parent, self.doubt, self.header, self.dropped = tag, parent, doubt, header, doubt > 0
        self.children: list[Node | str] = []
        self.score = 0.0


def _doubt(tag: str, attributes: str) -> tuple[int, bool]:
    """How sure the element's kind, role, names or style make it that it is no part of an article; whether it is a header."""
    if tag in DROPPED:
        return CERTAIN, False
    least = MAYBE if tag == "form" else 0
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return least, tag == "header"
    found = {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return CERTAIN, False
    if (role := found.get("role", "").lower()) in DROPPED_ROLES and not (tag == "form" and role == "form"):
        return CERTAIN, False
    names = [*found.get("class", "").split(), *found.get("id", "").split()]
    whole = {n.lower() for n in names}
    if whole & COMMENTS:
        return CERTAIN, False
    if whole & POSITIVE:
        return least, tag == "header"
    if whole & NEGATIVE:
        return NAMED, False
    if tag not in CONTAINERS:
        return least, tag == "header"
    parts = [[p.lower() for p in _PARTS.findall(n)] for n in names]
    parts = [own for own in parts if own and own[0] not in MODIFIERS]
    header = any("header" in own and not POSITIVE.intersection(own) for own in parts)
    return MAYBE if any(NEGATIVE.intersection(own) for own in parts) else least, header


class _Open:
    """The open elements, with the places of each tag and of all blocks, so that no tag is looked for in vain."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], defaultdict(list), []

    @property
    def node(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """Where the innermost open element of these tags is; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def close_implied(self, tags: Iterable[str], limits: Iterable[str]) -> None:
        place = self.last(tags)
        if place and place > self.last(limits):
            self.close(place)

    def end(self, tag: str) -> None:
        """After an end tag: inline ones don't close blocks, and an element that isn't open ends nothing."""
        place = self.last((tag,))
        if not place or tag not in BLOCK and self.blocks and place < self.blocks[-1]:
            return
        if tag in ("p", "li") and place < self.last(BARRIERS):
            return
        self.close(place)


def parse(page: str) -> Node:
    """The tree of a page. Markup that is not well formed is read as browsers do in the common cases:
    implied end tags, stray end tags, unquoted or unclosed attributes; never an error."""
    root = Node("#root", None, 0)
    opened = _Open(root)
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            opened.node.children.append(references.unescape(page[at:]))
            break
        if lt > at:
            opened.node.children.append(references.unescape(page[at:lt]))
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = end + 3 if end >= 0 else size
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                at = end + 3 if end >= 0 else size
            else:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:
            if nxt == "/" or nxt.isalpha() and nxt.isascii():  # a bogus end tag, or a tag that never ends
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:
                opened.node.children.append("<")
                at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            opened.end(tag)
            continue
        if tag in CLOSES_P:
            opened.close_implied(("p",), ("td", "th", "table", "button", "object"))
            if tag in HEADINGS and opened.node.tag in HEADINGS:
                opened.close(len(opened.stack) - 1)
        if tag in IMPLIED_END:
            opened.close_implied(*IMPLIED_END[tag])
        new = Node(tag, opened.node, *_doubt(tag, m[3]))
        opened.node.children.append(new)
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            if end is None:
                break
            close = page.find(">", end.start())
            at = close + 1 if close >= 0 else size
        elif tag not in VOID and not m[3].endswith("/") or tag in ("p", "div", "b", "i", "a", "span"):
            opened.push(new)
    return root


def _walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        n = stack.pop()
        if not n.dropped:
            yield n
            stack += [c for c in reversed(n.children) if type(c) is Node]


def _text(root: Node, skip: set[int]) -> list[str]:
    """Pieces of text in page order, a space wherever a block begins or ends."""
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        if type(n) is str:
            out.append(n)
        elif not n.dropped and id(n) not in skip:
            if n.tag in BLOCK:
                out.append(" ")
                stack.append(" ")
            stack += reversed(n.children)
    return out


def _own_text(n: Node) -> str:
    """Text of a paragraph: its own and its inline descendants', not that of blocks inside."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(n.children))
    while stack:
        c = stack.pop()
        if type(c) is str:
            out.append(c)
        elif not c.dropped and (c.tag not in BLOCK or c.tag == "br"):
            out.append(" " if c.tag == "br" else "")
            stack += reversed(c.children)
    return " ".join("".join(out).split())


def _sizes(root: Node) -> dict[int, tuple[int, int, int]]:
    """Of each kept element: characters of text, of text inside links, and the number of links."""
    order = list(_walk(root))
    sizes: dict[int, tuple[int, int, int]] = {}
    for n in reversed(order):
        text = links = count = 0
        for c in n.children:
            if type(c) is str:
                text += len(c) - c.count(" ") if not c.isspace() else 0
            elif not c.dropped:
                a, b, k = sizes[id(c)]
                text, links, count = text + a, links + b, count + k
        sizes[id(n)] = (text, text, 1) if n.tag == "a" else (text, links, count)
    return sizes


def _scores(root: Node, density: Callable[[Node], float]) -> None:
    """Points that paragraphs pass to their parents, of which each further ancestor gets half, in one pass upwards."""
    for n in reversed(list(_walk(root))):
        if n.tag in PARAGRAPHS and len(text := _own_text(n)) >= MIN_PARAGRAPH:
            points = (1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)) * (1 - density(n))
            to = n.parent if n.tag in PASSING and n.parent is not None else n
            to.score += points
        if n.parent is not None:
            n.parent.score += n.score / 2


def _rescue(root: Node) -> None:
    """Takes back doubtful elements that hold the article: by part of a name, and forms, if they hold more paragraph text
    than all that is kept; by a whole name if nothing is kept at all. The one with most text comes first. Where an
    article or main element has text, only what is inside of one."""
    every: list[Node] = []
    inside: set[int] = set()
    stack = [root]
    while stack:
        n = stack.pop()
        if n.doubt < CERTAIN:
            every.append(n)
            if n.tag in ("article", "main") or id(n.parent) in inside:
                inside.add(id(n))
            stack += [c for c in n.children if type(c) is Node]
    named = any(n.tag in ("article", "main") and any(not x.isspace() for x in _text(n, set())) for n in _walk(root))
    if not any(n.dropped and (not named or id(n) in inside) for n in every):
        return
    # paragraph text in an element: without doubtful elements inside, with those by part of a name, with all
    own: dict[int, tuple[int, int, int]] = {}
    for n in reversed(every):
        size = len(text) if n.tag in PARAGRAPHS and len(text := _own_text(n)) >= MIN_PARAGRAPH else 0
        kept = most = whole = size
        for c in n.children:
            if type(c) is Node and c.doubt < CERTAIN:
                inner = own[id(c)]
                kept, most, whole = kept + (0 if c.dropped else inner[0]), most + (0 if c.doubt == NAMED else inner[1]), whole + inner[2]
        own[id(n)] = (kept, most, whole)

    def doubtful(top: Node) -> list[Node]:
        """The outermost dropped elements under a kept one."""
        out, stack = [], [top]
        while stack:
            for c in stack.pop().children:
                if type(c) is Node and c.doubt < CERTAIN:
                    (out if c.dropped else stack).append(c)
        return [n for n in out if not named or id(n) in inside]

    outside, waiting = own[id(root)][0], doubtful(root)
    while waiting:
        best = max(waiting, key=lambda n: (n.doubt == MAYBE, own[id(n)][1:]))
        if best.doubt == NAMED or own[id(best)][1] <= outside:
            best = max(waiting, key=lambda n: own[id(n)][2])
            if outside or not own[id(best)][2]:
                return
        kept = own[id(best)][0]
        best.dropped = False
        outside += kept
        waiting.remove(best)
        waiting += doubtful(best)


def _is_menu(n: Node, size: tuple[int, int, int], later: bool) -> bool:
    """Whether a block of links is a menu: of three links at least and little else, with short entries, and no more of
    the article after it."""
    text, links, count = size
    return n.tag in ("ul", "ol", "div", "table") and count >= 3 and links >= 0.8 * text and not later and links < MIN_PARAGRAPH * count


def main_text(page: str | None) -> str:
    """The article's text of a page, its blocks joined by one space; empty if there is none.

    The container of the best score is kept whole, or the article or else the main element that encloses it, with its
    siblings; what ``_doubt`` names goes unless ``_rescue`` takes it back, as do menus outside an article. A page's
    header goes, an article's own header stays.
    """
    if not page:
        return ""
    root = parse(page)
    inside: set[int] = set()  # elements in an article or main
    for n in _walk(root):
        if n.tag in ("article", "main") or id(n.parent) in inside:
            inside.add(id(n))
        elif n.header:
            n.doubt, n.dropped = MAYBE, True
    _rescue(root)
    sizes = _sizes(root)
    density = lambda n: sizes[id(n)][1] / max(1, sizes[id(n)][0])
    _scores(root, density)
    scored = [n for n in _walk(root) if n.score and n.tag not in ("html", "#root")] or [n for n in (root,) if n.score]
    best = max(scored, key=lambda n: n.score * (1 - density(n)), default=None)
    if best is None:
        best = next((n for tag in ("article", "main", "body") for n in _walk(root) if n.tag == tag), root)
    around, top = {}, best
    while top is not None:  # the outermost enclosing element that its author named so
        around[top.tag] = top
        top = top.parent
    best = around.get("article") or around.get("main") or best
    while best.tag not in ("article", "main", "body") and best.parent is not None and best.parent.tag in CONTAINERS and sizes[id(best.parent)][0] == sizes[id(best)][0]:
        best = best.parent  # a wrapper without text of its own
    keep: list[Node | str] = [best]
    if best.parent is not None and best.tag not in ("main", "body"):
        keep = [n for n in best.parent.children if n is best or type(n) is str or not n.dropped and (n.tag in ("p", *HEADINGS) or not (sizes[id(n)][2] and density(n) >= 0.5))]
    menus: set[int] = set()
    stack = [(n, n.tag == "article", False) for n in keep if type(n) is Node]
    while stack:
        n, named, later = stack.pop()
        if not named and n is not best and _is_menu(n, sizes[id(n)], later):
            menus.add(id(n))
            continue
        for c in reversed(n.children):
            if type(c) is Node and not c.dropped:
                stack.append((c, named or c.tag == "article", later))
                text, links, _ = sizes[id(c)]
                later = later or c.tag in PARAGRAPHS and text - links >= MIN_PARAGRAPH
    return " ".join(" ".join(n if type(n) is str else "".join(_text(n, menus)) for n in keep).split())


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each page, in one pass without shuffle.

    Null and empty pages, and pages without text, give an empty text and n_chars 0. Null ids and urls stay
    null, repeated rows come back as often as they came, other columns are ignored, and no rows give no
    rows. Whole pages are parsed, whatever their length or depth (no recursion).
    """
    schema = T.StructType(
        [T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    named = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    return text_batches(named).mapInArrow(run, schema)
