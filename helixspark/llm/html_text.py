"""Main text of HTML pages by composite text density.

Each DOM node has ``C`` characters and ``T`` tags below it, ``LC`` of the characters and ``LT`` of the tags in links.
Its density is ``C/T * log_b(C/LC' * T/LT')`` with base ``b = ln(C/LC' * LC + LB/CB * C + e)``, where ``LC'`` is the
text outside links, ``LB/CB`` the share of link text in the body, and zero denominators count as one.  The node whose
children's densities have the largest sum is the article's root; the lowest density on the path from the body to it is
the threshold.  The article may lie in several subtrees: of every subtree of the body that is not below the threshold the
node with the largest sum is a root too.  The smallest element that holds all roots, and a title that goes before them, is
read in page order, less every block below the threshold that is mostly links.

What has no text by the standard (scripts, styles, templates, the head, form controls, hidden elements) is left out before
densities are taken.  Elements and names that say navigation, banner, advert, notice or comments only weigh: nearly all
text in them counts as link text, so that their density is low, and the threshold decides.

Defined cases: null and empty pages, and pages without text, give an empty string; broken markup is read as browsers
do in the cases that matter (implied and missing end tags, stray ``<``, unterminated comments and scripts); extra
columns are ignored; repeated rows are repeated.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import slim

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element of the value, unless a boundary lies between.
IMPLIED_END = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "option": ("option",), "body": ("head",),
}
BOUNDARY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}}
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
DROPPED = frozenset(
    "script style noscript template head button select input textarea iframe object embed svg canvas audio video map title noembed noframes xmp".split()
)
LIGHT = frozenset("nav footer aside form dialog menu search".split())
LIGHT_SHARE = 0.97  # of the text and tags in light elements counts as link text and link tags
NOT_TEXT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
NOT_TEXT_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|adslot|adbox|banners?|sponsor(?:ed|s)?|promos?|promotions?|nav|navbar|navigation|menus?|breadcrumbs?"
    r"|sidebars?|side|aside|footer|foot|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri(?:be|ption)|signup|login"
    r"|comments?|commentlist|comment-list|replies|reply|respond|disqus|responses|share|sharing|social|related|recommended|recommendations|pagination|pager|skip|copyright|legal|disclaimer|privacy|paywall)(?:$|[\s_-]|\d)",
    re.I,
)
#: Names of layouts, such as ``has-sidebar``, say nothing about what an element holds.
LAYOUT_NAME = re.compile(r"(?:^|[\s_-])(?:has|with|without|no|hide)[_-][\w-]*", re.I)
#: A page's own header by name; the headers of articles, posts and sections are theirs.
HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:header|hdr)(?:$|[\s_-]|\d)", re.I)
OWN_HEADER_NAME = re.compile(r"(?:article|post|entry|content|story|section|text|main|news|blog)[_-]header", re.I)
NOT_TEXT_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
# quotes are such only around an attribute's value; elsewhere they are letters of a name or of an unquoted value
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)"
    r"|<([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|=|[^>=]+)*)(?:>|$)", re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("children", "chars", "density", "gone", "light", "link_chars", "link_tags", "page_header", "parent", "sums", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.gone = self.light = False
        self.page_header = tag == "header"


def _judge(node: Node, attributes: str) -> None:
    """Mark nodes that hold no text, and those whose text weighs little."""
    tag = node.tag
    if tag in DROPPED:
        node.gone = True
        return
    node.light = tag in LIGHT
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id"):
            if tag not in ("body", "html", "article", "main"):
                value = LAYOUT_NAME.sub(" ", NOT_TEXT_CAMEL.sub("-", value))
                node.light |= NOT_TEXT_NAME.search(value) is not None
                if tag in ("div", "section", "table", "td", "ul") and HEADER_NAME.search(OWN_HEADER_NAME.sub(" ", value)):
                    node.page_header = True
        elif name == "role":
            node.light |= value.lower() in NOT_TEXT_ROLE
        elif name == "itemprop":
            node.light |= value.lower() == "comment"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN_STYLE.search(value)):
            node.gone |= tag not in ("body", "html")


def parse(page: str) -> Node:
    """The page's tree; text nodes are strings with references decoded."""
    root = Node("html", None)
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if (closed := m[1]) is not None:
            closed = closed.lower()
            if closed == "br":
                stack[-1].children.append(" ")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == closed:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table") and closed not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"):
                    break
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "html":
            continue
        if tag in IMPLIED_END:
            ends, stop = IMPLIED_END[tag], BOUNDARY.get(tag, {"table"})
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        node = Node(tag, stack[-1])
        stack[-1].children.append(node)
        _judge(node, m[3])
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag in ("title", "textarea") or end is None:
                pass  # never article text; without an end tag the rest of the page is inside
            at = end.end() if end else n
        elif tag not in VOID:
            stack.append(node)
    return root


def _in_order(root: Node) -> list[Node]:
    """Nodes that are not gone, parents before children.  What is in a light node is light; so is a page header outside
    of articles."""
    out = [root]
    own = {id(root): False}
    for node in out:  # grows while it runs
        inside = own[id(node)] or node.tag in ("article", "main")
        for child in node.children:
            if isinstance(child, Node) and not child.gone:
                child.light |= node.light or (child.page_header and not inside)
                own[id(child)] = inside
                out.append(child)
    return out


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.chars = node.tags = 0
        node.link_chars = node.link_tags = 0.0
        for child in node.children:
            if isinstance(child, str):
                n = len("".join(child.split()))
                node.chars += n
                node.link_chars += LIGHT_SHARE * n if node.light else 0
            elif not child.gone:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (LIGHT_SHARE if child.light and child.tag != "a" else 0)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        node.density = composite_density(node.chars, max(1, node.tags), node.link_chars, node.link_tags, share)
    for node in nodes:
        node.sums = sum(x.density for x in node.children if isinstance(x, Node) and not x.gone)


def composite_density(c: int, t: int, link_c: float, link_t: float, share: float) -> float:
    """Density of a node with ``c`` characters and ``t`` tags, so many of them in links; ``share`` is the body's."""
    if not c:
        return 0.0
    plain = max(1.0, c - link_c)
    base = math.log(c / plain * link_c + share * c + math.e)
    ratio = max(1.0, c / max(1.0, link_c) * t / max(1.0, link_t))
    return c / t * (math.log(ratio) / math.log(base) if base > 1.0000001 else math.log(ratio))


def article_root(page: str) -> tuple[Node, float] | None:
    """The smallest element with all of the article's roots and the threshold, or None for a page without text."""
    nodes = _in_order(parse(page))
    _measure(nodes)
    if not nodes[0].chars:
        return None
    best = max(nodes, key=lambda x: x.sums)
    if not best.sums:
        best = nodes[0]
    node, path = best, []
    while node is not None:
        path.append(node)
        if node.tag == "body":
            break
        node = node.parent
    threshold = min(x.density for x in path)
    # the lowest node of the path that holds all roots
    place, at = {id(x): i for i, x in enumerate(path)}, 0
    for up in _dense_roots(nodes, path[-1], best, threshold):
        while id(up) not in place:
            up = up.parent
        at = max(at, place[id(up)])
    # titles are short, so their density says little: one that goes before the article is part of it
    above = [i for i in range(at + 1, len(path)) if _title_before(path[i], path[i - 1])]
    return path[max([at, *above])], threshold


def _title_before(node: Node, child: Node) -> bool:
    """Whether a heading of the first two levels, outside links and light elements, goes before ``child`` in ``node``."""
    todo = []
    for x in node.children:
        if x is child:
            break
        if isinstance(x, Node):
            todo.append(x)
    while todo:
        x = todo.pop()
        if x.gone or x.light:
            continue
        if x.tag in ("h1", "h2") and x.chars and x.link_chars * 2 <= x.chars:
            return True
        todo += [y for y in x.children if isinstance(y, Node)]
    return False


def _dense_roots(nodes: list[Node], body: Node, best: Node, threshold: float) -> list[Node]:
    """The node with the largest sum in each subtree but that of ``best`` that is not below the threshold."""
    top = {id(x): x for x in nodes}
    for node in reversed(nodes):  # parents come before their children
        up = node.parent
        if up is not None and top[id(node)].sums > top[id(up)].sums:
            top[id(up)] = top[id(node)]
    chosen: dict[int, Node] = {id(best): best}
    todo = [body]
    while todo:
        node = todo.pop()
        if id(node) in chosen:
            continue
        if node.chars and node.density >= threshold:
            chosen[id(top[id(node)])] = top[id(node)]
        if id(node) not in chosen:
            todo += [x for x in node.children if isinstance(x, Node) and not x.gone]
    return [x for x in chosen.values() if x is not best]


def main_text(page: str | None) -> str:
    """Blocks of the article in page order, joined by line feeds."""
    found = article_root(page) if page else None
    if found is None:
        return ""
    root, threshold = found
    blocks: list[str] = []
    parts: list[str] = []

    def close() -> None:
        if text := " ".join("".join(parts).split()):
            blocks.append(text)
        parts.clear()

    todo: list[Node | str | None] = [None, root]
    while todo:
        item = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            parts.append(item)
        elif item.gone or (item is not root and item.density < threshold and (item.light or item.link_tags > 1) and item.link_chars * 2 > item.chars):
            if item.tag in BLOCK:
                close()
        elif item.tag in ("br", "wbr", "img"):
            parts.append(" " if item.tag == "br" else "")
        elif item.tag in BLOCK:
            close()
            todo.append(None)
            todo += reversed(item.children)
        else:
            todo += reversed(item.children)
    close()
    return "\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["id", "url", "text", "n_chars"]
            )

    rows = slim(pages, id=id_col, url=url_col, html=html_col)
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, url string, text string, n_chars long")
