"""Main text of web pages by composite text density.

Every DOM node gets its text characters C, tags T, link characters LC and link tags LT. Its density is
C/T, adjusted for links by log base ln(C/nLC * LC + LCb/Cb * C + e) of (C/LC * T/LT), where nLC are
characters outside links and b marks the body; both logarithms are shifted to be one at least. The
density sum of a node adds its children's densities. The node with the greatest sum is the core; the
least density on the path from the core up to the body is the threshold, and from the body down every
child that reaches it contributes the subtree of its own greatest sum. A subtree inside an article
element stands for the whole article.

Navigation, page headers and footers, sidebars, forms, scripts and styles are dropped by element, role
or hidden state before the densities are taken. Words in classes and ids only mark: what they name as
advert, notice, comment and the like goes unless it holds an article, a main heading or nearly all of the
page, so that a wrapper named after its sidebar stays; what they name as menu, list of tags or related
pages, and names that merely contain such a word, go only if they are made of links or hold little text.
Names such as ``has-sidebar`` or ``no-menu`` mark nothing. The density sum chooses among the rest, and
what it chooses stays whole, links included. A page without markup is its own text.

Cases: a null or empty page and a page without text give an empty text; unclosed and stray tags,
unquoted attributes and cut-off pages are read like a browser does; repeated rows give a row each;
extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?:>|\Z)",
    re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
SPACE = re.compile(r"\s+")

# Fixed values of HTML: elements without content, with raw text, that break lines, and that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split())
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select textarea input label iframe object embed "
    "svg canvas audio video menu dialog title noembed noframes xmp map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
# Names of what is no article, and names of what is none if it is made of links.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners comment comments commentlist consent cookie cookies "
    "copyright disclaimer discussion disqus gdpr login masthead modal newsletter notice notices notification overlay paywall "
    "popup promo promoted promotion reply replies respond sidebar signup skip sponsor sponsored subscribe subscription".split())
LINK_MARKS = frozenset(
    "breadcrumb breadcrumbs footer header menu menus nav navbar navigation pager pagination recommended related share sharing "
    "social tags teaser toolbar widget widgets".split())
STATES = frozenset("has have is no not with without show hide".split())
LITTLE, LINKED, NEARLY_ALL = 0.05, 1 / 3, 0.9
ARTICLE = frozenset("html body main article".split())


class Node:
    __slots__ = ("name", "parent", "children", "attrs", "mark", "heads", "chars", "tags", "link_chars", "link_tags", "density",
                 "total", "best")

    def __init__(self, name: str, parent: "Node | None", attrs: str):
        self.name, self.parent, self.attrs = name, parent, attrs
        self.children: list = []


def mark(value: str, inside_article: bool) -> int:
    """2 if a name of the class or id is one of MARKS, 1 if it holds such a word or one of LINK_MARKS, else 0."""
    level = 0
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not words or words[0] in STATES:
            continue
        found = [w for w in words if w in MARKS or (w in LINK_MARKS and not (inside_article and w == "header"))]
        if len(found) == len(words) and MARKS.issuperset(found):
            return 2
        level = max(level, int(bool(found)))
    return level


def dropped(node: Node, inside_article: bool) -> bool:
    """Whether the element is no part of any article; else its mark is noted."""
    node.mark = 0
    if node.name in DROPPED:
        return True
    if node.name == "header":
        return not inside_article
    if not node.attrs or node.name in ARTICLE:
        return False
    for key, value in ATTRIBUTE.findall(node.attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id"):
            node.mark = max(node.mark, mark(value, inside_article))
    return False


def prune(root: Node) -> None:
    """Take out marked subtrees, unless they hold the article itself."""
    nodes = measure(root)
    for node in reversed(nodes):
        kids = [c for c in node.children if type(c) is not str]
        node.heads = node.name in ("article", "main", "h1") or any(k.heads for k in kids)
    if not any(node.mark for node in nodes):
        return
    page, stack = max(root.chars, 1), [root]
    while stack:
        node = stack.pop()
        kept = []
        for child in node.children:
            if type(child) is not str:
                made_of_links = child.link_chars >= LINKED * max(child.chars, 1)
                goes = child.mark == 2 or (child.mark == 1 and (made_of_links or child.chars <= LITTLE * page))
                if goes and not child.heads and child.chars < NEARLY_ALL * page:
                    continue
                stack.append(child)
            kept.append(child)
        node.children = kept


def parse(page: str) -> Node:
    """The page's tree: children are nodes and strings; what is boilerplate by its markup is left out."""
    root = node = Node("html", None, "")
    root.mark = 0
    opened: Counter = Counter()  # elements of each name that are open
    at, end = 0, len(page)
    skip: Node | None = None
    articles = 0

    def text(piece: str) -> None:
        if skip is None and piece and not piece.isspace():
            node.children.append(html.unescape(piece))
        elif skip is None and piece:
            node.children.append(" ")

    def close(top: Node) -> None:
        """Leave every element up to and with ``top``."""
        nonlocal node, skip, articles
        while True:
            leaving, node = node, node.parent
            opened[leaving.name] -= 1
            articles -= leaving.name == "article"
            if skip is leaving:
                skip = None
            if leaving is top:
                return

    def nearest(names: frozenset, limits: frozenset) -> Node | None:
        if not any(opened[n] for n in names):
            return None
        up = node
        while up is not root and up.name not in limits:
            if up.name in names:
                return up
            up = up.parent
        return None

    paragraph, edges = frozenset(["p"]), frozenset("table td th article section div body li blockquote".split())
    while at < end:
        found = TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        name = found["name"]
        if not name:
            continue
        name = name.lower()
        if found["close"]:
            if name == "br":
                text(" ")
                continue
            top = nearest(frozenset([name]), frozenset())
            if top is not None:
                close(top)
            continue
        if name in ("html", "body"):
            continue
        if name in BLOCK:
            top = nearest(paragraph, edges)
            if top is not None:
                close(top)
        if name in CLOSES:
            top = nearest(*CLOSES[name])
            if top is not None:
                close(top)
        if name in VOID:
            if skip is None and name in ("br", "hr", "wbr", "img"):
                node.children.append("\n" if name == "hr" else "" if name == "wbr" else " ")
            continue
        new = Node(name, node, found["rest"])
        if skip is None and dropped(new, articles > 0):
            skip = new
        elif skip is None:
            node.children.append(new)
        if found["rest"].endswith("/") and name in ("svg", "path"):
            skip = None if skip is new else skip
            continue
        node = new
        opened[name] += 1
        articles += name == "article"
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>?", re.I).search(page, at)
            at = stop.start() if stop else end
    return root


def ordered(root: Node) -> list[Node]:
    """Nodes, parents before children."""
    out = [root]
    for node in out:
        out += [c for c in node.children if type(c) is not str]
    return out


def measure(root: Node) -> list[Node]:
    nodes = ordered(root)
    for node in reversed(nodes):
        kids = [c for c in node.children if type(c) is not str]
        own = sum(len(c) - c.count(" ") // 2 if not c.isspace() else 0 for c in node.children if type(c) is str)
        node.chars = own + sum(k.chars for k in kids)
        node.tags = len(kids) + sum(k.tags for k in kids)
        link = node.name == "a"
        node.link_chars = node.chars if link else sum(k.link_chars for k in kids)
        node.link_tags = node.tags + 1 if link else sum(k.link_tags for k in kids)
    body = max(root.chars, 1)
    share = root.link_chars / body
    for node in nodes:
        c, t = node.chars, max(node.tags, 1)
        lc, lt = max(node.link_chars, 1), max(node.link_tags, 1)
        if not c:
            node.density = 0.0
            continue
        base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
        node.density = c / t * math.log(max(c / lc * t / lt, 1.0) + math.e - 1) / max(math.log(base + math.e - 1), 1.0)
    for node in reversed(nodes):
        kids = [c for c in node.children if type(c) is not str]
        node.total = sum(k.density for k in kids) if kids else node.density
        node.best = max([node.total, *(k.best for k in kids)])
    return nodes


def chosen(root: Node) -> list[Node]:
    """Subtrees of the main text, in page order."""
    prune(root)
    nodes = measure(root)
    if not root.chars:
        return []
    core = max(nodes, key=lambda n: n.total)
    least, up = core.density, core
    while up is not None:
        least, up = min(least, up.density), up.parent
    out: list[Node] = []

    def peak(node: Node) -> Node:
        while node.total < node.best:
            node = next(c for c in node.children if type(c) is not str and c.best == node.best)
        return node

    stack = [root]
    while stack:
        node = stack.pop()
        if node.density < least or not node.chars:
            continue
        top = peak(node)
        if top is node:
            out.append(node)
            continue
        out_of_path = []
        step = top
        while step is not node:
            out_of_path += [c for c in step.parent.children if type(c) is not str and c is not step]
            step = step.parent
        out.append(top)
        stack += out_of_path
    wanted = {id(article(n)) for n in out}
    picked, inside = [], None
    for node, end in preorder(root):
        if inside is not None and end <= inside:
            continue
        inside = None
        if id(node) in wanted:
            picked.append(node)
            inside = end
    return picked


def article(node: Node) -> Node:
    """The nearest article element around the node, else the node."""
    up = node
    while up is not None and up.name != "article":
        up = up.parent
    return up or node


def preorder(root: Node) -> list[tuple[Node, int]]:
    """Nodes in page order, each with the position after its last descendant."""
    out, stack = [], [(root, False)]
    place: dict[int, int] = {}
    while stack:
        node, left = stack.pop()
        if left:
            place[id(node)] = len(out)
            continue
        out.append(node)
        stack.append((node, True))
        stack += [(c, False) for c in reversed(node.children) if type(c) is not str]
    return [(node, place[id(node)]) for node in out]


def blocks(nodes: list[Node]) -> Iterator[str]:
    """Texts between block borders; white space inside each is one space."""
    parts: list[str] = []

    def done() -> Iterator[str]:
        line = SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if line:
            yield line

    for top in nodes:
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None or item == "\n":
                yield from done()
            elif type(item) is str:
                parts.append(item)
            else:
                if item.name in BLOCK:
                    yield from done()
                    stack.append(None)
                stack += reversed(item.children)
        yield from done()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    return "\n".join(blocks(chosen(root)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())],
                                             ["page_id", "url", "text"])

    rows = pages.select("page_id", "url", "html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
