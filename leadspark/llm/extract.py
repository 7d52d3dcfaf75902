"""Main text of web pages by composite text density.

A page's tags and texts are read in one pass into a light tree; omitted end tags are implied as HTML has it, inside parts that
are left out too. Parts that no article has are left out: menus, scripts, forms and the like, told by tag, and hidden ones; adverts,
notices, reader comments and the like, told by role, class or id, unless they are an ``article`` or ``main`` or hold most of
the page's text outside links (reader comments: also all its ``h1``, ``article`` and ``main``). For every remaining node the composite
density is computed (Sun, Song and Liao, "DOM Based Content Extraction via Text Density", 2011): characters per tag, times a
logarithm that falls as more of the characters and tags belong to links. A node's density sum adds its children's densities.
The node of the greatest sum is the core of the article; the least density on the path from it to the body is the
threshold. The article is the outermost ``article`` or ``main`` around the core, if there is one; else it is the core with those
neighbours of its path that reach the threshold, or are headings.

Inside the article blocks are told apart by their tags, character references are decoded, white space becomes one space, and
blocks are joined by one space. A null or empty page, or one without text, gives the empty text. Repeated rows are read each
by itself; an empty table gives an empty result; other columns are carried along unless they bear the name of a result.

Python runs per page inside Arrow batches, as a DOM has no column expression; there is no shuffle.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from leadspark.llm.common import slices

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
_REST = re.compile(r"""((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)

_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_JUNK = frozenset("script style textarea title noscript iframe xmp head nav footer aside form button select option template svg canvas "
                  "object menu dialog label fieldset input embed".split())
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
                   "tbody td template textarea tfoot th thead title tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HOME = frozenset(("article", "main"))
_TITLES = frozenset(("h1", "article", "main"))
# An end tag reaches no further up than these, that of a part of a table than the second set.
_SCOPE = frozenset("table caption td th template object marquee applet".split())
_TABLE_SCOPE = frozenset(("table", "template"))
_TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
_ITEM_STOPS = (_BLOCK | _SCOPE | {"button"}) - {"address", "div", "p"}
# An opening tag ends these open ones, up to the nearest of the second set.
_ENDS = {"li": ({"li"}, _ITEM_STOPS), "dt": ({"dt", "dd"}, _ITEM_STOPS), "dd": ({"dt", "dd"}, _ITEM_STOPS),
         "td": ({"td", "th"}, {"tr", *_TABLE_SCOPE}), "th": ({"td", "th"}, {"tr", *_TABLE_SCOPE}), "tr": ({"tr", "caption"}, _TABLE_SCOPE),
         **{k: ({"thead", "tbody", "tfoot", "caption"}, _TABLE_SCOPE) for k in ("thead", "tbody", "tfoot")},
         "option": ({"option"}, {"select"}), "optgroup": ({"optgroup"}, {"select"})}
# Opening tags that end a paragraph which is left out.
_END_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
# Any other tag ends an open head.
_IN_HEAD = frozenset("html head base link meta script style title noscript template".split())
# Words of a class, id or role that name what is no article.
_JUNK_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner sidebar nav navbar navigation "
                        "menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification alert popup modal "
                        "newsletter subscribe subscription signup share sharing social related recommended comment comments disqus replies "
                        "widget toolbar pagination pager complementary contentinfo search dialog topbar skip".split())
# Of these, what may be longer than the article itself.
_REPLIES = frozenset("comment comments disqus replies".split())


class _Node:
    __slots__ = ("tag", "parent", "first", "last", "chars", "links", "tags", "link_tags", "titles", "density", "sum", "children", "out", "names")

    def __init__(self, tag, parent, at, counts, out=False, names=frozenset()):
        self.tag, self.parent, self.first, self.last = tag, parent, at, at
        self.chars, self.links, self.tags, self.link_tags, self.titles = counts
        self.density = self.sum = 0.0
        self.children = []
        self.out, self.names = out, names  # the root of a part left out by its tag; words that name what is no article


def _judge(tag: str, attributes: str, at_home: bool) -> tuple[bool, frozenset]:
    """Whether a part is left out by its tag or as hidden, and the words of its names that speak against it."""
    if tag in _JUNK or tag == "header" and not at_home:
        return True, frozenset()
    if not attributes or tag in ("html", "body"):
        return False, frozenset()
    names = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True, frozenset()
        if name in ("class", "id", "role"):
            names.append(value)
    if not names or tag in _HOME:
        return False, frozenset()
    words = set(re.split(r"[^a-z0-9]+", re.sub(r"\d+", "", " ".join(names).lower())))
    return False, frozenset(words & (_JUNK_NAMES | {"header"} if not at_home and tag == "div" else _JUNK_NAMES))


def _parse(page: str) -> tuple[list[str], list[_Node]]:
    """The texts of a page in order, with a space at each block's ends, and its nodes, each with its range of texts."""
    pieces: list[str] = []
    counts = [0, 0, 0, 0, 0]
    root = _Node("body", None, 0, counts)
    nodes, stack = [root], [root]
    link = home = junk = named = 0  # open ones; junk: parts left out by tag; named: those with names that speak against them
    at, end = 0, len(page)

    def close(node):
        nonlocal link, home, junk, named
        stack.pop()
        if node.out or node.names or not junk and node.tag in _BLOCK:
            pieces.append(" ")
        link -= node.tag == "a"
        home -= node.tag in _HOME
        junk -= node.out
        named -= bool(node.names)
        node.last = len(pieces)
        node.chars, node.links = counts[0] - node.chars, counts[1] - node.links
        node.tags, node.link_tags, node.titles = counts[2] - node.tags, counts[3] - node.link_tags, counts[4] - node.titles

    def close_to(tags, until=()):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    close(stack[-1])
                return True
            if stack[k].tag in until:
                return False
        return False

    while at < end:
        tag_at = page.find("<", at)
        text = page[at:tag_at if tag_at >= 0 else end]
        m = _TAG.match(page, tag_at) if tag_at >= 0 else None
        if tag_at >= 0 and m is None:
            text, tag_at = page[at:tag_at + 1], tag_at + 1
        if junk and stack[-1].tag == "head" and text.strip():
            close(stack[-1])
        if text and not junk:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            n = len("".join(text.split()))
            counts[0] += n
            counts[1] += n if link else 0
        if tag_at < 0:
            break
        at = tag_at
        if m is None:
            continue
        if m[1]:
            stop = page.find("-->", m.end())
            at = end if stop < 0 else stop + 3
            continue
        if not m[3]:
            stop = page.find(">", m.end())
            at = end if stop < 0 else stop + 1
            continue
        rest = _REST.match(page, m.end())
        if rest is None:
            break
        at, tag, attributes = rest.end(), m[3].lower(), rest[1]
        if m[2]:
            if tag in _TABLE:
                closed = close_to({tag}, _TABLE_SCOPE)
            elif tag in _BLOCK or tag in ("button", "object"):
                closed = close_to({tag}, _SCOPE | {"button"} if tag == "p" else _SCOPE | {"ul", "ol"} if tag == "li" else _SCOPE)
            else:
                closed = close_to({tag}, _BLOCK) or tag not in _BLOCK
            if not closed and not junk:
                pieces.append(" ")
            continue
        if junk and stack[-1].tag == "head" and tag not in _IN_HEAD:
            close(stack[-1])
        if tag in (_END_P if junk or named else _BLOCK):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close_to({"p"})
                    break
                if stack[k].tag in _BLOCK or stack[k].tag in _SCOPE or stack[k].tag == "button":
                    break
        if tag in _ENDS:
            close_to(*_ENDS[tag])
        if tag in _RAW:
            stop = re.compile(rf"</{tag}", re.I).search(page, at)
            if stop is None:
                break
            close_tag = page.find(">", stop.end())
            at = end if close_tag < 0 else close_tag + 1
            continue
        out, names = (False, frozenset()) if junk else _judge(tag, attributes, home > 0)
        if junk or out:
            if tag not in _VOID and tag not in ("html", "body") and not attributes.endswith("/"):
                if out and tag in _BLOCK:
                    pieces.append(" ")
                junk += out
                stack.append(_Node(tag, stack[-1], len(pieces), counts, out))
                link += tag == "a"
                home += tag in _HOME
            continue
        if names and (tag in _VOID or attributes.endswith("/")):
            continue
        if tag in _BLOCK:
            pieces.append(" ")
        counts[2] += 1
        if tag in _VOID or tag in ("html", "body"):
            continue
        counts[3] += tag == "a"
        counts[4] += tag in _TITLES
        node = _Node(tag, stack[-1], len(pieces), counts, False, names)
        stack[-1].children.append(node)
        nodes.append(node)
        stack.append(node)
        named += bool(names)
        link += tag == "a"
        home += tag in _HOME
    while stack:
        close(stack[-1])
    return pieces, nodes


def _leave_out(pieces: list[str], nodes: list[_Node]) -> list[_Node]:
    """The nodes without those whose names speak against them; their texts are blanked and counted no more."""
    body = nodes[0]
    whole, titles = body.chars - body.links, body.titles
    left, gone = [], set()
    for node in nodes:
        most = 2 * (node.chars - node.links) > whole
        if node.parent in gone or node.names and not (most and (node.titles == titles or not node.names & _REPLIES)):
            gone.add(node)
        else:
            left.append(node)
    for node in gone:
        if node.parent not in gone:
            pieces[node.first:node.last] = [" "] * (node.last - node.first)
    for parent in {node.parent for node in gone} - gone:
        parent.children = [c for c in parent.children if c not in gone]
    less = {}
    for node in reversed(nodes):
        if node in gone and node.parent in gone:
            continue
        lost = less.pop(node, (0, 0, 0, 0)) if node not in gone else (node.chars, node.links, node.tags + 1, node.link_tags + (node.tag == "a"))
        if not any(lost):
            continue
        if node not in gone:
            node.chars, node.links, node.tags, node.link_tags = (
                node.chars - lost[0], node.links - lost[1], node.tags - lost[2], node.link_tags - lost[3])
        if node.parent is not None:
            less[node.parent] = tuple(x + y for x, y in zip(less.get(node.parent, (0, 0, 0, 0)), lost, strict=True))
    return left


def _weigh(nodes: list[_Node]) -> None:
    """Composite densities, and per node the sum of its children's."""
    body = nodes[0]
    linked = body.links / max(body.chars, 1)
    for node in nodes:
        c, t = node.chars, max(node.tags, 1)
        if c:
            lc, lt = max(node.links, 1), max(node.link_tags, 1)
            base = math.log(c / max(c - node.links, 1) * lc + linked * c + math.e)
            node.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(base)
        if node.parent is not None:
            node.parent.sum += node.density


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    pieces, nodes = _parse(page)
    nodes = _leave_out(pieces, nodes)
    _weigh(nodes)
    body = nodes[0]
    core = max(nodes, key=lambda n: n.sum)
    if core.sum == 0:
        core = body
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    home = next((n for n in reversed(path) if n.tag in _HOME), None)
    if home is None:
        inside = [n for n in nodes if n.tag in _HOME and core.first <= n.first and n.last <= core.last]
        home = max(inside, key=lambda n: n.sum, default=None)
    if home is not None:
        ranges = [(home.first, home.last)]
    else:
        threshold = min(n.density for n in path)
        ranges = [(core.first, core.last)]
        for inner, outer in zip(path, path[1:], strict=False):
            ranges += [(n.first, n.last) for n in outer.children if n is not inner and (
                n.density >= threshold and n.chars or n.tag in _HEADINGS)]
    return " ".join("".join(" ".join("".join(pieces[a:b]) for a, b in sorted(ranges))).split())


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text, in place of the column of HTML, and ``n_chars``, its code points."""
    keep = [c for c in pages.columns if c not in (column, "text", "n_chars")]

    def read(batches):
        for batch in slices(batches):
            found = [main_text(p) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                names=[*keep, "text", "n_chars"])

    rows = pages.select(*keep, column)
    types = dict(rows.dtypes)
    return rows.mapInArrow(read, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "text string", "n_chars bigint"]))
