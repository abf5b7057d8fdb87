"""Main text of web pages, by composite text density.

The page is parsed to a tree, forgivingly and in linear time.  Parts that are
never main text are cut first: by element (menus, page headers and footers,
scripts and the like), role, visibility, or a class or id that names nothing
else (``_CUT_WORDS``).  A class or form that holds most of the page's plain
text is no such part, and nothing around an article or main element that does
is cut whole.

For every node left, the composite density is its characters per tag, scaled
down by the share of characters in links.  The node with the greatest sum of
its children's densities is the text's core.  The least density on its path
from body is the threshold: what hangs on that path and is as dense belongs to
the text too, and so do headings before the core and further articles and
sections with a part of as many characters per tag.  An article or main element
bounds the text: a chosen part within one stands for the whole of it.  Blocks of links within the
chosen parts are menus (``MENU_LINKS``) and left out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# possessive, so that no start is tried twice; a quote counts after an equals sign only
_START = re.compile(r"([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_RAW = {"script", "style", "title", "textarea", "noembed", "noframes", "iframe", "xmp"}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "html", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | _HEADINGS
#: Elements that a start tag closes when they are open: what it closes, and where the search ends.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
_NO_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_P_ENDS = {"table", "td", "th", "button", "article", "section", "div", "body", "li", "blockquote", "main", "aside"}
_CELLS = {"td", "th", "table"}
_PAST_CELLS = {"tr", "td", "th", "table", "tbody", "thead", "tfoot", "body", "html", "article", "main"}

#: Elements without text of the page.
_NO_TEXT = {"head", "script", "style", "noscript", "template", "title", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "noembed", "noframes", "audio", "video", "input"}
_CUT_TAGS = {"nav", "footer", "aside", "dialog", "menu"}
_FORMS = {"form", "fieldset"}
_CUT_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
#: Words of a class or id that name a part to cut, if its other words are in ``_PLAIN_WORDS``.
_CUT_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "promoted", "banner", "sidebar", "aside", "nav", "navbar", "navigation", "menu", "submenu",
    "breadcrumb", "breadcrumbs", "footer", "foot", "masthead", "cookie", "cookies", "cookiebar", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "lightbox", "newsletter", "subscribe", "subscription",
    "signup", "signin", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "paywall", "skip", "toolbar", "widget", "widgets", "outbrain", "taboola", "topbar", "copyright", "tracking",
}
_HEADER_WORDS = {"header", "siteheader", "pageheader", "sitehead"}
_READER_WORDS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}
_PLAIN_WORDS = {
    "site", "page", "global", "main", "top", "bottom", "left", "right", "primary", "secondary", "wrapper", "wrap", "container", "box", "block", "area", "section", "list", "item", "items", "bar", "inner", "outer", "unit", "slot", "panel", "link", "links",
    "button", "buttons", "icons", "message", "text", "posts", "articles", "media", "user", "reader", "thread", "form", "policy", "js", "col", "column", "row", "group", "sticky", "fixed", "mobile", "desktop", "tools",
}
_MAIN = {"article", "main"}
#: Links in a block, and their share of its characters, from which it is a menu.
MENU_LINKS, MENU_SHARE = 6, 0.7


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "sum", "rate", "peak")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    @property
    def plain(self) -> int:
        return self.chars - self.link_chars


class _Open:
    """The open elements, and where each kind of them was opened last."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, what: set[str], until: set[str]) -> None:
        """Close open elements of ``what``, innermost first, unless one of ``until`` is nearer."""
        while (k := self.last(what)) > self.last(until - what):
            self.pop_to(k)

    def end(self, tag: str) -> None:
        k = self.last((tag,))
        if not k or tag not in _BLOCK and self.blocks and self.blocks[-1] > k:
            return  # an inline end tag closes no block
        if tag in _BLOCK and tag not in _PAST_CELLS and self.last(_CELLS) > k:
            return
        self.pop_to(k)


def parse(page: str) -> Node:
    """A tree of the page. Unclosed, stray and misnested tags are borne as browsers mostly do; a tag that never ends is dropped."""
    root = Node("html", "", None)
    seen, at, n = _Open(root), 0, len(page)

    def text(piece: str) -> None:
        if piece:
            seen.stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    while at < n:
        lt = page.find("<", at)
        text(page[at : lt if lt >= 0 else n])
        if lt < 0:
            break
        mark = page[lt + 1 : lt + 2]
        if mark.isascii() and mark.isalpha():
            if not (m := _START.match(page, lt + 1)):
                break
            at = _opened(seen, page, m.group(1).lower(), m.group(2), m.end())
        elif mark == "/" and (first := page[lt + 2 : lt + 3]).isascii() and first.isalpha():
            if (gt := page.find(">", lt)) < 0:
                break
            seen.end(re.match(r"[^\s/>]+", page[lt + 2 : min(gt, lt + 66)]).group().lower())
            at = gt + 1
        elif page.startswith("<!--", lt):
            gt = page.find(">", lt, lt + 6) if page.startswith((">", "->"), lt + 4) else page.find("-->", lt + 4)
            at = n if gt < 0 else gt + (1 if page[gt] == ">" else 3)
        elif page.startswith("<![CDATA[", lt) and (gt := page.find("]]>", lt)) >= 0:
            seen.stack[-1].children.append(page[lt + 9 : gt])
            at = gt + 3
        elif mark in ("!", "?", "/") and mark:
            gt = page.find(">", lt)
            at = n if gt < 0 else gt + 1
        else:
            text("<")
            at = lt + 1
    return root


def _opened(seen: _Open, page: str, tag: str, attrs: str, at: int) -> int:
    """Enter a start tag in the tree; where the page goes on."""
    if tag == "html":
        return at
    if tag in _NO_P:
        seen.close({"p"}, _P_ENDS)
    if tag in _CLOSES:
        seen.close(*_CLOSES[tag])
    if tag in _HEADINGS and seen.stack[-1].tag in _HEADINGS:
        seen.pop_to(len(seen.stack) - 1)
    node = Node(tag, attrs, seen.stack[-1])
    seen.stack[-1].children.append(node)
    if tag in _RAW:
        m = _RAW_END[tag].search(page, at)
        node.children.append(page[at : m.start() if m else len(page)])
        gt = page.find(">", m.end()) if m else -1
        return len(page) if gt < 0 else gt + 1
    if tag not in _VOID and not (attrs.endswith("/") and tag in ("svg", "path")):
        seen.push(node)
    return at


def _nodes(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return out


def _names(attrs: str) -> tuple[list[list[str]], set[str], bool]:
    """The words of each class and id, the roles, and whether the element is hidden."""
    tokens: list[list[str]] = []
    roles: set[str] = set()
    hidden = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), html.unescape(a or b or c)
        if name in ("class", "id"):
            tokens += [[w.lower() for w in _SPLIT.split(t) if w] for t in value.split()]
        elif name == "role":
            roles.update(value.lower().split())
        hidden |= name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and bool(_HIDDEN.search(value))
    return tokens, roles, hidden


def _named(tokens: list[list[str]], words: set[str]) -> bool:
    """Whether a class or id is made of ``words``, and of plain words beside them."""
    return any(not words.isdisjoint(t) and all(w in words or w in _PLAIN_WORDS or w.isdigit() for w in t) for t in tokens)


def _without(root: Node, unwanted) -> None:
    """Take what ``unwanted(node, in_main)`` names out of the tree."""
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        x, in_main = todo.pop()
        kept: list[Node | str] = []
        for c in x.children:
            if isinstance(c, Node):
                if unwanted(c, in_main):
                    kept.append(" ")
                    continue
                todo.append((c, in_main or c.tag in _MAIN))
            kept.append(c)
        x.children = kept


def cut(root: Node) -> None:
    """Take unwanted parts out of the tree."""
    names = {id(x): _names(x.attrs) for x in _nodes(root) if x.attrs}
    none: tuple[list[list[str]], set[str], bool] = ([], set(), False)
    of = lambda x: names.get(id(x), none)
    titled = {id(x) for x in _nodes(root) if x.tag in ("main", "h1")}
    for x in reversed(_nodes(root)):
        if id(x) in titled and x.parent is not None:
            titled.add(id(x.parent))

    def first(x: Node, in_main: bool) -> bool:
        tokens, _, hidden = of(x)
        if x.tag in _NO_TEXT or hidden and x.tag not in ("html", "body"):
            return True
        return id(x) not in titled and _named(tokens, _READER_WORDS)

    _without(root, first)
    count(root)
    total = root.plain
    order = _nodes(root)
    holds = {id(x) for x in order if x.tag in _MAIN and 2 * x.plain > total}
    mains = {id(x): int(x.tag in _MAIN and x.plain > 0) for x in order}
    for x in reversed(order):
        if x.parent is not None:
            mains[id(x.parent)] += mains[id(x)]
            if id(x) in holds:
                holds.add(id(x.parent))

    def then(x: Node, in_main: bool) -> bool:
        tag = x.tag
        if id(x) in holds or tag in ("html", "body") or tag in _MAIN:
            return False
        tokens, roles, _ = of(x)
        if tag in _CUT_TAGS or tag == "header" and not in_main:
            return True
        small = 2 * x.plain <= total or 2 * x.link_chars > x.chars
        elsewhere = not in_main and mains[id(root)] > mains[id(x)]  # an article has its own place
        return (small or elsewhere) and (tag in _FORMS or not roles.isdisjoint(_CUT_ROLES) or _named(tokens, _CUT_WORDS) or not in_main and _named(tokens, _HEADER_WORDS))

    _without(root, then)


def count(root: Node) -> list[Node]:
    """Characters, tags, link characters and links of every node; the nodes, parents before children."""
    order = _nodes(root)
    for x in reversed(order):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        for c in x.children:
            if isinstance(c, str):
                x.chars += len("".join(c.split()))
            else:
                x.chars += c.chars
                x.tags += 1 + c.tags
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1
    return order


def composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, times a logarithm that falls as links take more of the characters and tags; ``share`` is that of link characters in the body."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / tags * max(math.log(chars / links * tags / link_tags), 0.0) / base


def measure(root: Node) -> tuple[Node, list[Node]]:
    """Composite densities and their sums over children, plain characters per tag and the most of them in each subtree; body and its nodes."""
    order = count(root)
    body = next((x for x in order if x.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for x in reversed(order):
        x.density = composite(x.chars, x.tags, x.link_chars, x.link_tags, share)
        x.sum = sum(c.density for c in x.children if isinstance(c, Node))
        x.rate = x.plain / max(x.tags - x.link_tags, 1)
        x.peak = max([x.rate, *(c.peak for c in x.children if isinstance(c, Node))])
    return body, _nodes(body)


def _is_menu(x: Node) -> bool:
    return x.tag in _BLOCK and x.link_tags >= MENU_LINKS and x.link_chars >= MENU_SHARE * x.chars


def content(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    body, inside = measure(root)
    core = max(inside, key=lambda x: x.sum)
    if core.sum <= 0:
        return [body]
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold, rate = min(x.density for x in path), min(x.rate for x in path)
    # composite densities grow with the size of a part; a text without bounds of its own also takes small parts of as many characters per tag
    loose_from = math.inf if any(x.tag in _MAIN for x in path) else rate
    chosen: dict[int, Node] = {id(core): core}
    for x, on_path in zip(path[1:], path):
        before, run = True, []
        for c in [*x.children, None]:
            if c is not None and (isinstance(c, str) or c.tag not in _BLOCK and c is not on_path and c.tag != "br"):
                run.append(c)
                continue
            if run:  # text between blocks is a block without a tag of its own
                loose = Node("div", "", x)
                loose.children = run
                count(loose)
                if loose.chars and 2 * loose.link_chars <= loose.chars and loose.plain / max(loose.tags - loose.link_tags, 1) >= loose_from:
                    chosen[id(run[0])] = loose
                run = []
            if c is on_path:
                before = False
            elif c is not None and c.chars and 2 * c.link_chars <= c.chars:
                part = c.tag in ("article", "section", "main") and c.peak >= rate
                if c.density >= threshold or c.rate >= loose_from or part or before and c.tag in _HEADINGS:
                    chosen[id(c)] = c
    # an article, else main, bounds the text; what it holds of the chosen parts is in it
    bounds: dict[int, Node] = {}
    for key, x in chosen.items():
        up, top = x, None
        while up is not None and up is not body:
            if up.tag == "article" or up.tag == "main" and top is None:
                top = up
            up = up.parent
        bounds[id(top) if top is not None else key] = top if top is not None else x
    out, todo = [], [body]
    while todo:
        x = todo.pop()
        if id(x) in bounds:
            out.append(bounds[id(x)])
        elif isinstance(x, Node):
            todo.extend(reversed(x.children))
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """The text of the subtrees, a piece for each stretch between block boundaries; a line break is white space."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    for top in nodes:
        todo: list[Node | str | None] = [None, *reversed(top.children), None]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                now.append(x)
            elif x.tag == "br":
                now.append(" ")
            elif x.tag in _BLOCK:
                flush()
                if not _is_menu(x):
                    todo.append(None)
                    todo.extend(reversed(x.children))
            else:
                todo.extend(reversed(x.children))
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by line feeds; empty where there is none.

    A page wrapped in a form gives its text without the form's controls.
    """
    if not page:
        return ""
    root = parse(page)
    cut(root)
    return "\n".join(blocks(content(root)))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without its html, with each row's main text; rows are handled one by one.

    Null and empty html give empty text; repeated rows stay repeated; very long
    or deeply nested pages take time in proportion to their length; an empty
    table stays empty.  Other columns pass through, one of the output's name is
    replaced.
    """
    kept = [c for c in pages.columns if c not in (html_col, out_col)]
    rows = pages.select(*kept, F.col(html_col).cast("string").alias(html_col))
    schema = pages.select(*kept).schema.add(out_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = pa.array([main_text(x) for x in part.column(len(kept)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], texts], [*kept, out_col])

    return rows.mapInArrow(run, schema)


def op4(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    return extract(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
