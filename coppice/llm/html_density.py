"""Main text of web pages by composite text density.

For every node of the page's tree, the characters per tag are weighed down by
the share of link text. The node with the largest sum of its children's
densities holds the article; the smallest density between it and the body is
the threshold that other parts must reach to belong to it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from coppice.llm.textwork import map_batches, pick, texts

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
NO_TEXT = frozenset(
    "head script style noscript template title textarea select option button input iframe object embed svg math canvas "
    "audio video map nav footer aside form menu dialog noembed noframes xmp".split())
#: Kinds that hold blocks; outside the chosen subtree they need a sum of densities of their own.
BOXES = frozenset("address center dd details dialog dir div fieldset figure section summary td th".split())
#: Kinds that are dropped, but may be wrapped around a whole article.
WRAPPERS = frozenset("nav footer aside form menu dialog header".split())
#: Parts of an article whose ids are anchors and say nothing of their kind.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p section".split())
#: What a new element ends implicitly: the nearest of the first set, unless one of the second is nearer.
ENDS = {
    "p": (frozenset(["p"]), frozenset(["table", "td", "th", "button", "object", "html"])),
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_ENDED_BY = {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
_TOUCHED = frozenset().union(*(a | b for a, b in ENDS.values()))
# Words in class, id or role that mark what is no article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside "
    "complementary menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar masthead header "
    "topbar footer contentinfo cookie cookies consent gdpr notice notices alert alertdialog dialog popup modal overlay "
    "newsletter subscribe subscription signup login search form comment comments commentlist disqus replies respond "
    "share sharing social related recommended widget".split())
#: Words that name part of a page and nothing else beside those: "share-buttons" is no article, "related-work" may be.
PART_WORDS = frozenset(
    "area article articles author bar block body bottom box button buttons card cards col column container content desktop "
    "feed global group icon icons inner item items label left link links list main meta mobile module news outer page panel "
    "policy post posts primary right row secondary section site slot space stories story stream text title tools top unit "
    "wrap wrapper zone".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
#: Words that inside an article mark parts of it as often as what is none.
_HEADER = frozenset(["header", "masthead"])
SOFT_WORDS = frozenset("header masthead notice notices alert form".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|</[^>]*+(?:>|\Z)|[^<]++|<", re.S)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "link_chars", "tags", "link_tags", "density", "total", "drop", "weak",
                 "names", "near")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.drop = self.weak = False
        #: (from an id, words of ASIDE_WORDS, nothing but them and PART_WORDS) of every name with such a word
        self.names: list[tuple[bool, frozenset, bool]] = []
        #: for each kind of ENDS the open element that it would end
        self.near: dict[str, Node | None] = parent.near if parent else dict.fromkeys(ENDS)
        if parent and tag in _TOUCHED:
            self.near = {k: self if tag in ends else None if tag in scope else self.near[k] for k, (ends, scope) in ENDS.items()}

    def words(self, ids: bool = True, sure: bool = False) -> set[str]:
        return {w for is_id, found, pure in self.names if (ids or not is_id) and (pure or not sure) for w in found}


def _names(attributes: str) -> list[tuple[bool, frozenset, bool]]:
    found = []
    for kind, *values in _MARKS.findall(attributes):
        for name in "".join(values).split():
            words = frozenset(w.lower() for w in _WORD.findall(name))
            if words & ASIDE_WORDS:
                found.append((kind.lower() == "id", words & ASIDE_WORDS, words <= ASIDE_WORDS | PART_WORDS))
    return found


def parse(page: str) -> Node:
    """The page as a tree; text stands undecoded among ``parts``. Takes time in proportion to the page."""
    root = Node("html", None)
    node, at, end = root, 0, len(page)
    opened = Counter()

    def leave(last: Node) -> Node:
        """End all open elements up to and with ``last``."""
        up = node
        while up is not last.parent:
            opened[up.tag] -= 1
            up = up.parent
        return up

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                node.parts.append(m[0])
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name == "br":  # a stray </br> is a line break
                node.parts.append(Node("br", node))
            elif opened[name]:
                up = node
                while up.tag != name:
                    up = up.parent
                node = leave(up)
            continue
        if name == "html" or name == "body" and opened[name]:
            continue
        ended = node.near.get(_ENDED_BY.get(name) or ("p" if name in BLOCKS else ""))
        if ended is not None:
            node = leave(ended)
        if (name == "body" or name in BLOCKS and node.tag == "head") and node is not root:
            while node.parent is not root:
                opened[node.tag] -= 1
                node = node.parent
            node = leave(node)
        child = Node(name, node)
        node.parts.append(child)
        attributes = m[3] or m[6] or ""
        if attributes:
            child.names = _names(attributes)
            if _HIDDEN.search(attributes):
                child.drop = True
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        opened[name] += 1
        node = child
    return root


def _up(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def _above(nodes: list[Node]) -> set[Node]:
    """The nodes and all that they stand in."""
    found = set()
    for node in nodes:
        for up in _up(node):
            if up in found:
                break
            found.add(up)
    return found


def _sizes(order: list[Node], lost: frozenset) -> dict[Node, int]:
    sizes = {}
    for node in reversed(order):
        sizes[node] = 0 if node.drop else sum(
            len("".join(x.split())) if isinstance(x, str) else 0 if x.tag in lost else sizes[x] for x in node.parts)
    return sizes


def _kept_wrappers(order: list[Node], inside: dict[Node, bool]) -> set[Node]:
    """Wrappers that stay: without them no article, or next to no text, would be left.

    Forms around an article come first, so that an article in a form does not bring back those of its sidebars.
    """
    articles = [n for n in order if n.tag in ("article", "main")]
    if articles:
        for kept in (frozenset(), frozenset(["form"]), WRAPPERS):
            lost = NO_TEXT - kept
            gone = set()
            for n in order:
                if n.parent in gone or n.drop or n.tag in lost or n.tag == "header" and not inside[n] and "header" not in kept:
                    gone.add(n)
            free = [a for a in articles if a not in gone]
            if free:
                return {n for n in _above(free) if n.tag in kept}
        return set()
    if not any(n.tag == "form" for n in order):
        return set()
    sizes = _sizes(order, NO_TEXT - frozenset(["form"]))
    return {n for n in order if n.tag == "form" and 10 * sizes[n] >= 9 * sizes[order[0]] > 0}


def _holders(order: list[Node]) -> list[Node]:
    """Articles whose surroundings stay whatever their names.

    An article inside another one or among comments is none of them. One below, or with, a name that is surely not an
    article's counts only where no other is left and half the text of its ``main`` or of the page stands in it.
    """
    kind, found, named = {}, [], []
    for node in order:
        above = kind.get(node.parent, (False, False, False))
        words = set() if node.tag in ("html", "body") else node.words(sure=True)
        comments = above[1] or bool(COMMENT_WORDS & words) and node.tag != "main"
        sure = above[2] or bool(words)
        if node.tag == "main" or node.tag == "article" and not above[0] and not comments:
            (named if sure else found).append(node)
        kind[node] = above[0] or node.tag == "article", comments, sure
    if not named or any(n.tag == "article" for n in found):
        return found
    sizes = _sizes(order, NO_TEXT - WRAPPERS)
    tag = "article" if any(n.tag == "article" for n in named) else "main"
    best = max((n for n in named if n.tag == tag), key=sizes.get)
    around = next((n for n in _up(best.parent) if n.tag == "main"), order[0])
    return [*found, best] if 2 * sizes[best] >= sizes[around] else found


def _measure(root: Node, by_name: bool) -> Node:
    """Drop what is no article and fill in counts and densities; returns the body."""
    order, todo = [], [(root, False)]
    inside = {}
    while todo:
        node, held = todo.pop()
        order.append(node)
        inside[node] = held
        todo += [(c, held or node.tag in ("article", "main")) for c in node.parts if isinstance(c, Node)]
    holders = _holders(order) if by_name else []
    holds = _above(holders)
    wrappers = _kept_wrappers(order, inside)
    for node in reversed(order):
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        kind = node not in wrappers and (node.tag in NO_TEXT or node.tag == "header" and not inside[node])
        if by_name and node.names and node not in holds and node.tag not in ("html", "body"):
            words = node.words(ids=not inside[node] or node.tag not in ANCHORED)
            sure = node.words(ids=not inside[node] or node.tag not in ANCHORED, sure=True)
            if inside[node]:
                sure = sure - SOFT_WORDS
                words = words - _HEADER
            elif holders and node.tag not in ("article", "main"):
                sure = words
            node.weak = bool(words)
            kind = kind or bool(sure) or bool(words & COMMENT_WORDS)
        if kind:
            node.drop = True
        if node.drop:
            node.parts = [] if by_name or node.tag in NO_TEXT else node.parts
            continue
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(html.unescape(part).split()) if "&" in part else "".join(part.split()))
            elif not part.drop:
                node.chars += part.chars
                node.link_chars += part.link_chars
                node.tags += part.tags + 1
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
        if node.weak and 2 * node.link_chars > node.chars:
            node.drop, node.parts = True, []
    body = next((c for c in root.parts if isinstance(c, Node) and c.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        if node.chars and not node.drop:
            tags, links = max(node.tags, 1), max(node.link_chars, 1)
            plain = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            ratio = node.chars / links * tags / max(node.link_tags, 1)
            node.density = node.chars / tags * max(math.log(ratio), 0.0) / math.log(max(base, math.e))
        else:
            node.density = 0.0
    for node in order:
        node.total = sum(c.density for c in node.parts if isinstance(c, Node) and c.tag in BLOCKS and not c.weak)
    return body


def _content(body: Node) -> set[Node]:
    """The roots of the parts that belong to the article."""
    blocks, todo = [], [body]
    while todo:
        node = todo.pop()
        if not node.drop:
            blocks.append(node)
            todo += [c for c in reversed(node.parts) if isinstance(c, Node) and c.tag in BLOCKS]
    best = max(blocks, key=lambda n: n.total)
    if not best.total:
        return {body}
    path = list(_up(best))
    limit = min(n.density for n in path if n is not path[-1] or n is body)
    for node in path:
        if node.tag in ("article", "main"):
            best = node
            break
    if best is body:  # no part was singled out: what a name makes doubtful must reach the threshold
        for node in blocks:
            if node.weak and node.density < limit:
                node.drop = True
    chosen, todo = set(), [body]
    on_path = set(_up(best))
    while todo:
        node = todo.pop()
        if node is best:
            chosen.add(node)
        elif node in on_path:
            todo += [c for c in node.parts if isinstance(c, Node) and not c.drop and (c in on_path or not c.weak)]
        elif node.tag in BLOCKS and node.density >= limit and node.chars and (node.total or node.tag not in BOXES):
            chosen.add(node)
    return chosen


def _write(node: Node, chosen: set[Node], held: bool, lines: list[list[str]]) -> None:
    """Append the text of what is chosen, a list of strings for each block."""
    todo: list = [(node, held)]
    while todo:
        part, held = todo.pop()
        if part is None:
            lines.append([])
        elif isinstance(part, str):
            if held:
                lines[-1].append(part)
        elif not part.drop:
            held = held or part in chosen
            block = part.tag in BLOCKS
            if part.tag == "br":
                lines[-1].append(" ")
                continue
            if block:
                lines.append([])
                todo.append((None, held))
            todo += [(p, held) for p in reversed(part.parts)]


def main_text(page: str | None) -> str:
    """The article's blocks, one per line; empty if the page has no text."""
    if not page:
        return ""
    for by_name in (True, False):
        body = _measure(parse(page), by_name)
        if body.chars:
            break
    else:
        return ""
    lines: list[list[str]] = [[]]
    _write(body, _content(body), False, lines)
    found = (" ".join(html.unescape("".join(x)).split()) for x in lines)
    return "\n".join(x for x in found if x)


def extract_articles(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Extract the main text from the whole HTML of every page.

    Returns one row per input row: ``page_id``, ``url``, ``text`` and
    ``n_chars`` (its code points). Menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and comments are left out; references are
    decoded; white space and line breaks inside a block become one space, and
    blocks are joined by a line feed. A name made of nothing but words for other
    parts drops an element; one that only contains such a word does so outside
    the article alone, and inside it where most of the text is links. A notice
    inside an article is part of it, comments never are. A null or empty page, or one without
    text, gives an empty text. Repeated rows and null ids give a row each;
    other columns are not read.
    """

    def work(batch):
        found = [main_text(None if b is None else b.decode("utf-8", "surrogatepass")) for b in texts(batch.column(2))]
        yield {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(found, pa.string()),
               "n_chars": pa.array(map(len, found), pa.int64())}

    picked = pick(pages, page_id=id_column, url=url_column, html=html_column)
    kinds = ", ".join(f"{c} {picked.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return map_batches(picked, work, f"{kinds}, text string, n_chars long")
