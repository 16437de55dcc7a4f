"""Main text of web pages by composite text density (Sun, Song and Liao 2011).

A tolerant scanner builds a tree of the page's block elements; inline formatting is part of its
block and counts as no tag. Scripts, styles, forms, embedded objects, comments in the markup and
elements that say of themselves that they are something else than the article (by tag, or by a
whole name in class, id, role or label: menus, headers, footers, sidebars, notices, adverts, reader
comments) are left out of the tree. On block containers the head word of a name counts too (the
sidebar of ``right-sidebar``, not the search of ``search-algorithms``), that of an id or label
only outside an article and where it isn't made from a heading, and none beside a general name
such as ``content``. Head words with other uses (widget, notice, share) only mark an element: it is
left out if links make up a third of it, or if it has fewer than SHORT characters and such elements
aren't most of the page. Names say nothing of
paragraphs and inline tags in an article, ids nothing of headings, and no name leaves out what holds
most of the page's text other than links, unless the page has an article elsewhere, or it is one
block, or reader comments, beside other text. Hidden parts are text like others. Then, for every node, with C
characters, T tags, and LC characters and LT tags of links in it (each at least 1), and lc, c those of
the body:

    density = C / T * log(C / LC * T / LT) / log(ln(C / max(1, C - LC) * LC + lc / c * C + e))

The node whose children's densities (runs of own text count as children) have the largest sum is
the core. The smallest density on the path from the body to it is the threshold; every node from
the body down that reaches it yields the node of the largest sum within it. From such a node the
elements around it are taken as long as links make up a third of what each adds at most, or half
within an ``article``, up to the outermost ``article`` it lies in, or else ``main``, or else the body's
children. The blocks of all nodes found, in page order, are the text: character references decoded,
white space as one space, trimmed, empty blocks dropped, two line feeds between them. Nothing else is
dropped; pages of any length and depth are whole.

Defined cases: null or empty html, and pages without text: "". Ties between nodes go to the one
that comes first, the outer one first. Unclosed or stray tags, cut-off pages and bytes that are no
markup are read as browsers mostly do. Null keys, repeated rows and extra columns make no
difference; there is one result row for each input row.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul a".split()
)
RAW = frozenset("script style textarea title xmp noembed noframes plaintext".split())
CLOSES_P = BLOCK - {"a", "body", "html", "caption", "option", "optgroup", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
# Left out: by tag, by tag outside an article or main, by a word of class, id or role.
DROP = frozenset(
    "head title script style noscript template iframe object embed applet svg canvas audio video map form button select option textarea "
    "nav menu aside footer dialog noembed noframes datalist".split()
)
OUTSIDE = frozenset(["header"])
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsbygoogle sponsor sponsored promo promotion banner navigation nav navbar topnav "
    "menu submenu menubar breadcrumb breadcrumbs sidebar sidebars rail aside complementary footer contentinfo masthead topbar cookie cookies "
    "consent gdpr notice notices notification alert alertdialog popup modal overlay dialog comment comments commentlist disqus respond replies "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar "
    "widget widgets skip".split()
)
NAMES_OUTSIDE = frozenset(["header"])
# Head words that other elements have as well.
WEAK = frozenset("widget widgets share sharing notice notices alert related search social login signup skip rail subscription subscribe".split())
SHORT = 100
# Whole names that say an element is the article; names that many elements have; first words of names that say what an element has, not what it is.
CONTENT = frozenset("main-content maincontent page-content article article-body article-content articlebody post-body post-content entry-content story-body body-content".split())
GENERAL = frozenset("content main post entry story text wrapper container page".split())
MODIFIERS = frozenset("with has no is without js".split())
# Words at the end of a name that say how an element is built or where it stands, not what it is.
BUILT = frozenset(
    "container wrapper wrap inner outer area list lists link links button buttons icon icons box bar block section holder group item items row panel "
    "region slot unit posts articles stories news content body form count title info trail left right top bottom primary secondary next previous prev this".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
CONTAINER = frozenset("div section ul ol dl table center header details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROUNDS = 20
KEPT = frozenset(["html", "body", "article", "main"])

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TELLING = re.compile(r"(?:class|id|role|aria-label)\s*=", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_MADE = re.compile(r"section|level[1-6]")  # classes of the containers that get their heading's id


class Node:
    __slots__ = ("tag", "parent", "children", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "weak")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list = []  # nodes and strings
        self.weak = False  # its name says that it may be left out
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)


def _named(tag: str, rest: str, inside: bool) -> str:
    """Why an element is left out ("tag", "comments" or "name"), "weak" if its name alone isn't enough, or ""."""
    if tag in DROP or (tag in OUTSIDE and not inside):
        return "tag"
    if tag in KEPT or not rest or not _TELLING.search(rest):
        return ""
    given: dict[str, str] = {}
    for found in _ATTRIBUTE.finditer(rest):
        given.setdefault(found[1].lower(), found[2] or found[3] or found[4] or "")
    classes = given.get("class", "").lower().split()
    container = tag in CONTAINER or "-" in tag
    if inside and (tag in HEADINGS or tag in ("p", "a") or tag not in BLOCK and not container):
        return ""
    made = inside or tag == "section" or any(_MADE.fullmatch(x) for x in classes)
    names = [(x, container) for x in [*classes, *given.get("role", "").lower().split()]]
    if tag not in HEADINGS:
        names += [(x, container and not made) for x in given.get("id", "").lower().split()]
        names += [(x, container and not made) for x in [" ".join(given.get("aria-label", "").lower().split())] if x]
    found: set[str] = set()
    for name, by_head in names:
        if name in CONTENT:
            return ""
        words = _WORD.findall(name)
        if name in GENERAL:
            found.add("general")
        if not words or words[0] in MODIFIERS:
            continue
        while by_head and len(words) > 1 and (words[-1] in BUILT or words[-1].isdigit()):
            words.pop()
        word = words[-1] if by_head or len(words) == 1 else ""
        if word in NAMES or (word in NAMES_OUTSIDE and not inside):
            if len(words) == 1 or all(w in NAMES for w in words):
                found.add("comments" if word in COMMENTS else "name")
            else:
                found.add("weak" if word in WEAK else "head comments" if word in COMMENTS else "head")
    if found & {"comments", "name"}:
        return "comments" if "comments" in found else "name"
    if "general" in found or not found:
        return ""
    return "comments" if "head comments" in found else "name" if "head" in found else "weak"


def parse(page: str) -> Node:
    """The tree of a page's blocks, from the body down."""
    kept: set[int] = set()
    for _ in range(ROUNDS):
        root, most = _parse(page, kept)
        if most is None:
            return root
        kept.add(most)  # as often as such elements are nested
    return _parse(page, None)[0]


def _parse(page: str, kept: set[int] | None) -> tuple[Node, int | None]:
    """The tree without elements left out by name, but for those that begin at the places kept (None: all); and the place of one that holds most of the text."""
    root = Node("body", None)
    node = root
    opened: Counter = Counter()  # elements that are open, by tag
    at, size = 0, len(page)
    skip: list[str] = []  # open elements from the one that is left out
    seen = False  # an article or main element
    left: list[list] = []  # place, reason, characters, whether in an article, blocks within, of each element left out by name
    ours = 0  # characters in the tree; both without links
    words_inside = 0  # those of them in an article
    dead = 0  # open elements up to the first that is left out anyhow, or is a link
    while at < size:
        cut = page.find("<", at)
        if cut < 0:
            cut = size
        if cut > at and not skip:
            node.children.append(page[at:cut])
            if not _open_link(node):
                n = sum(map(len, page[at:cut].split()))
                ours += n
                words_inside += n if node.inside else 0
        elif cut > at and not dead:
            left[-1][2] += sum(map(len, page[at:cut].split()))
        if cut == size:
            break
        found = _TAG.match(page, cut)
        if not found or found.end() == size and page[-1] != ">" and size - cut < 3:  # no markup, or cut off before a name
            if not skip:
                node.children.append("<")
            at = cut + 1
            continue
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag, closing, rest = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
        if skip:
            if closing:
                if tag in skip:
                    while skip.pop() != tag:
                        pass
                    dead = dead if dead <= len(skip) else 0
                elif tag in KEPT or tag in BLOCK and _open(node, tag, opened):  # its parent ends, and so does it
                    skip.clear()
                    dead = 0
                    node = _close(node, tag, opened)
            elif tag in ("article", "main") and not seen and skip[0] not in DROP:
                dead = 0
                skip.clear()  # what holds the page's article isn't left out
                seen = True
                node = _enter(node, tag, opened)
            elif tag in RAW:
                at = _after(page, tag, at)
            elif tag not in VOID and not rest.endswith("/"):
                if not (tag == skip[0] == "p") and not (tag in SIBLINGS and skip[-1] in SIBLINGS[tag][0]):
                    skip.append(tag)
                    if not dead and tag in BLOCK:
                        left[-1][4] += 1
                    dead = dead or (len(skip) if tag in DROP or tag == "a" else 0)
            continue
        if closing:
            if tag in BLOCK:
                node = _close(node, tag, opened)
            elif tag == "br":
                node.children.append(" ")
            continue
        if tag in RAW:
            at = _after(page, tag, at)
            continue
        if tag == "br" or tag == "wbr" or tag == "img":
            if tag == "br":
                node.children.append("\n")
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and _open(node, "p", opened):
            node = _close(node, "p", opened)
        if tag in SIBLINGS and any(opened[x] for x in SIBLINGS[tag][0]):
            own, limit = SIBLINGS[tag]
            up, best = node, None
            while up and up.tag not in limit:
                if up.tag in own:
                    best = up
                up = up.parent
            if best:
                node = _leave(node, best, opened)
        why = _named(tag, rest, node.inside)
        if why and why != "weak" and (why == "tag" or kept is not None and cut not in kept):
            if tag not in VOID and not rest.endswith("/"):
                skip = [tag]
                dead = int(why == "tag" or tag == "a" or _open_link(node))
                if not dead:
                    left.append([cut, why, 0, node.inside, 0])
            if tag in BLOCK or tag in DROP:
                node.children.append(None)  # the text before and after aren't one block
            continue
        if tag == "hr":
            node.children.append(None)
        elif tag in BLOCK and not (rest.endswith("/") and tag != "a"):
            node = _enter(node, tag, opened)
            node.weak = why == "weak"
            seen = seen or tag in ("article", "main")
    total = ours + sum(x[2] for x in left)
    place, why, most, within, inner = max(left, key=lambda x: x[2], default=(None, "", 0, False, 0))
    if 2 * most <= total or (inner < 2 and ours) or (words_inside and not within) or (why == "comments" and ours):
        place = None
    return root, place


def _open_link(node: Node) -> bool:
    return node.tag == "a" or bool(node.parent and node.parent.tag == "a")


def _enter(node: Node, tag: str, opened: Counter) -> Node:
    new = Node(tag, node)
    node.children.append(new)
    opened[tag] += 1
    return new


def _leave(node: Node, last: Node, opened: Counter) -> Node:
    """The parent of an open element that ends, and with it all within."""
    while node is not last:
        opened[node.tag] -= 1
        node = node.parent
    opened[node.tag] -= 1
    return node.parent


def _open(node: Node | None, tag: str, opened: Counter) -> bool:
    if not opened[tag]:
        return False
    while node:
        if node.tag == tag:
            return True
        if tag == "p" and node.tag in ("table", "td", "th", "caption"):
            return False
        node = node.parent
    return False


def _close(node: Node, tag: str, opened: Counter) -> Node:
    if tag == "body" or not _open(node, tag, opened):
        return node
    last = node
    while last.tag != tag:
        last = last.parent
    return _leave(node, last, opened)


def _after(page: str, tag: str, at: int) -> int:
    end = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
    return end.end() if end else len(page)


def _clean(text: str) -> str:
    return " ".join((_html.unescape(text) if "&" in text else text).split())


def _order(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """Characters, tags, densities, sums and the best node within of every node; returns them parents first."""
    nodes = _prune(root)
    runs: dict[int, list[int]] = {}
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        own, run = [], []
        for child in [*node.children, None]:
            if isinstance(child, str):
                run.append(child)
                continue
            if run:
                n = len(_clean("".join(run)))
                run = []
                if n:
                    own.append(n)
                    node.chars += n
            if child is not None:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.chars if child.tag == "a" else child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        runs[id(node)] = own
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in nodes:
        node.density = _density(node.chars, node.tags, node.chars if node.tag == "a" else node.link_chars, node.link_tags + (node.tag == "a"), share)
    for node in nodes:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and c.tag != "a") + sum(_density(n, 0, 0, 0, share) for n in runs[id(node)])
    for node in reversed(nodes):
        node.best = node
        for c in node.children:
            if isinstance(c, Node) and c.best.total > node.best.total:
                node.best = c.best
    return nodes


def _cut(node: Node) -> None:
    """Takes a node out; the text before and after it aren't one block."""
    above = node.parent.children
    above[next(k for k, x in enumerate(above) if x is node)] = None


def _prune(root: Node) -> list[Node]:
    """All nodes, parents first, without those that their names mark and that are to a third links, or short and not most of the page."""
    nodes = _order(root)
    if not any(x.weak for x in nodes):
        return nodes
    size: dict[int, tuple[int, int]] = {}
    for node in reversed(nodes):
        own = sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
        inner = [size[id(x)] for x in node.children if isinstance(x, Node)]
        n = own + sum(x[0] for x in inner)
        size[id(node)] = n, n if node.tag == "a" else sum(x[1] for x in inner)
    total, links = size[id(root)]
    short = []
    for node in nodes:
        n, own = size[id(node)]
        if node.weak and 3 * own >= n > 0:
            _cut(node)
        elif node.weak and n < SHORT:
            short.append(node)
    if 2 * sum(size[id(x)][0] - size[id(x)][1] for x in short if not any(x.parent is y for y in short)) < total - links:
        for node in short:
            _cut(node)
    return _order(root)


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    power = math.log(max(1.0, chars / lc * t / lt)) / math.log(max(base, 1 + 1e-9)) if base > 1 else math.log(max(1.0, chars / lc * t / lt))
    return chars / t * power


def _whole(node: Node) -> Node:
    """The largest element around a node that adds text but few links at every step, within its article, its main element or the body."""
    limits = {}
    up = node
    while up:
        if up.tag in ("article", "main"):
            limits[up.tag] = up
        up = up.parent
    limit = limits.get("article") or limits.get("main")
    while node is not limit and node.parent and (limit or node.parent.parent):
        part = 2 if node.parent.inside and "article" in limits else 3
        if part * (node.parent.link_chars - node.link_chars) > node.parent.chars - node.chars:
            break
        node = node.parent
    return node


def blocks(node: Node) -> list[str]:
    """The texts of a subtree's blocks in page order."""
    out: list[str] = []
    run: list[str] = []
    todo: list = [node]

    def end() -> None:
        text = _clean("".join(run))
        run.clear()
        if text:
            out.append(text)

    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            end()
        elif x.tag == "a":
            todo += reversed(x.children)
        else:
            end()
            todo.append(None)
            todo += reversed(x.children)
    end()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    nodes = measure(root)
    core = max(nodes, key=lambda x: x.total)
    if not core.total:  # next to no text, or links alone: no density to go by
        return "\n\n".join(blocks(next((x for x in nodes if x.tag == "article"), next((x for x in nodes if x.tag == "main"), root))))
    threshold, up = core.density, core
    while up:
        threshold = min(threshold, up.density)
        up = up.parent
    chosen: list[Node] = []
    taken: set[int] = set()
    tried: dict[int, Node] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        if id(node) in taken or node.tag == "a":
            continue
        if node.density >= threshold:
            found = tried.get(id(node.best)) or tried.setdefault(id(node.best), _whole(node.best))
            if id(found) not in taken and found.total:
                chosen.append(found)
                taken.update(id(x) for x in _order(found))
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    place = {id(x): k for k, x in enumerate(nodes)}
    chosen.sort(key=lambda x: place[id(x)])
    out: list[str] = []
    within: set[int] = set()
    for node in chosen:
        if id(node) not in within:
            within.update(id(x) for x in _order(node))
            out += blocks(node)
    return "\n\n".join(out)


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep`` of each row with text and n_chars (code points)."""
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("__html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    return source.mapInArrow(run, schema)


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
