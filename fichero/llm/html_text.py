"""Operator 10: main text of web pages by composite text density.

A page's tags become a tree, without parts that are never text (scripts, controls, what is hidden). Every node
gets its composite text density: characters per tag, adjusted by the share of characters and tags in links. A
node's sum is that of its children's densities; text runs count as children. Parts that tag, role or class mark
as menu, header, footer, sidebar, notice, advert, form or comments are left out, unless the text is in them:
where what is left has little density beside the greatest sum of the whole page, marks of the nodes around that
sum are void, the outermost first, until it has. The container with the greatest sum of what is left is
the centre of the main text. The least density on the path from it to
the body is the threshold: of the parts beside the path, up to the body or to an ancestor that is mostly links,
those at least as dense stay, and in these the same holds again; the centres stay whole, headings stay with what
follows them. An element that the page itself declares as its article around the centre is taken whole instead.

Text comes by block: white space inside a block becomes one space, blocks are joined by an empty line.

Null and empty pages, and pages without text, give an empty text. Unclosed, misnested and unknown tags are
read as browsers do, in outline; a tag that never ends takes the rest of the page. Reading takes time in
proportion to the length of a page. Repeated rows are extracted alike.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_DECLARED = frozenset(["article", "main"])
#: Elements that are never text.
NEVER = frozenset("head script style noscript template iframe svg button select textarea input object embed canvas audio video dialog title option datalist".split())
#: Elements and roles that mark parts beside the main text.
MARKED = frozenset("nav footer aside form menu".split())
MARKED_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of class or id that mark such parts, if all other words of the name are neutral.
MARKED_WORD = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promoted banner sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist replies disqus cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup paywall share sharing social related recommended recommendations widget widgets pagination pager toolbar".split()
)
HEADER_WORD = frozenset("header topbar".split())
NEUTRAL_WORD = frozenset(
    "area article articles author avatar badge bar block body bottom box button buttons card cards center col column container content date desktop entry feed fixed form global google group head header heading icon icons image images img inner item items js label left link links list main message meta mobile module more name news outer page panel photo policy post posts primary reader region reply respond right secondary section site sitewide slot small sticky stories story subtitle tag tags text thread title tools top unit user wrap wrapper x".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A tag as most are written; it fails where _tag_end would have to look further.
_PLAIN_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>=\"']*+(?:=\"[^\"]*+\"[^>=\"']*+)*+)>")
#: What comes before a value or the end of a tag.
_TO_VALUE = re.compile(r"[^>=]*(?:=\s*)?")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: A start tag of the key closes an open element of the second set, unless one of the third stands between.
_LIST, _TABLE = frozenset("ul ol menu dir".split()), frozenset(["table"])
CLOSES = {
    "li": (frozenset(["li"]), _LIST), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), _TABLE), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset("tr td th tbody thead tfoot".split()), _TABLE), "tfoot": (frozenset("tr td th tbody thead".split()), _TABLE), "option": (frozenset(["option"]), frozenset(["select"])),
}
_P = frozenset(["p"])
_P_STOP = frozenset("article aside blockquote body button dd details div fieldset figure footer form header li main nav section td th table caption object".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs)}


def _tag_end(page: str, at: int) -> int:
    """Where the ">" of a tag stands, from after its name on; -1 if nowhere. Values in quotes may hold any character."""
    while True:
        at = _TO_VALUE.match(page, at).end()
        if at >= len(page):
            return -1
        if page[at] == ">":
            return at
        if page[at] in "\"'" and page[at - 1] in "= \t\n\r\f":
            at = page.find(page[at], at + 1) + 1
            if not at:
                return -1


def _raw(page: str, tag: str, at: int) -> tuple[list[tuple[str, str, str]], int, int]:
    """Tokens inside an element whose content is not read, from after its tag on; and (twice) where it ends."""
    found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
    inner = [("text", page[at : found.start() if found else len(page)], "")] if tag in ("textarea", "title") else []
    stop = page.find(">", found.end()) if found else -1
    at = stop + 1 if stop >= 0 else len(page)
    return [*inner, ("close", tag, "")], at, at


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, text or name, attributes) of a page; kind: text, raw (no references), open, close."""
    at, text, end = 0, 0, len(page)
    while True:
        start = page.find("<", at)
        if start < 0:
            break
        at = start + 1
        plain = _PLAIN_TAG.match(page, at)
        if plain is not None:
            if start > text:
                yield "text", page[text:start], ""
            slash, tag, attrs = plain.groups()
            tag, at = tag.lower(), plain.end()
            yield "close" if slash else "open", tag, attrs
            text = at
            if tag in RAW and not slash:
                inner, at, text = _raw(page, tag, at)
                yield from inner
            continue
        name = None
        if page.startswith(("!--", "![CDATA[", "!", "?"), at):
            open_, close = next(x for x in (("!--", "-->"), ("![CDATA[", "]]>"), ("!", ">"), ("?", ">")) if page.startswith(x[0], at))
            stop = page.find(close, at + len(open_))
        else:
            slash = page.startswith("/", at)
            name = _NAME.match(page, at + slash)
            if name is None:
                continue
            stop, close = _tag_end(page, name.end()), ">"
        if start > text:
            yield "text", page[text:start], ""
        if name is None:
            if open_ == "![CDATA[":
                yield "raw", page[at + len(open_) : stop if stop >= 0 else end], ""
        elif stop >= 0:
            yield "close" if slash else "open", name[0].lower(), page[name.end() : stop]
        at = text = stop + len(close) if stop >= 0 else end
        if name is not None and not slash and stop >= 0 and (tag := name[0].lower()) in RAW:
            inner, at, text = _raw(page, tag, at)
            yield from inner
    if text < end:
        yield "text", page[text:], ""


def parse(page: str) -> Node:
    """The tree of a page; its root is a body without attributes."""
    root = Node("body")
    stack, n_open = [root], Counter(["body"])

    def cut(i: int) -> None:
        n_open.subtract(n.tag for n in stack[i:])
        del stack[i:]

    def close(kinds: frozenset, stop: frozenset) -> None:
        i = len(stack) - 1
        while i > 0 and any(n_open[k] for k in kinds):
            if stack[i].tag in kinds:
                cut(i)
                if len(kinds) == 1:
                    return
            elif stack[i].tag in stop:
                return
            i -= 1

    for kind, tag, attrs in tokens(page):
        if kind in ("text", "raw"):
            stack[-1].children.append(_html.unescape(tag) if kind == "text" else tag)
        elif kind == "close":
            if tag == "br" or (tag == "p" and not n_open["p"]):
                stack[-1].children.append(Node(tag, "", stack[-1]))
            elif n_open[tag] and tag != "body":
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
        elif tag not in ("html", "body"):
            if tag in BLOCK:
                close(_P, _P_STOP)
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                cut(len(stack) - 1)
            node = Node(tag, attrs, stack[-1])
            stack[-1].children.append(node)
            if tag not in VOID and not (tag in ("svg", "path") and attrs.endswith("/")):  # a slash closes only void and foreign elements
                stack.append(node)
                n_open[tag] += 1
    return root


def _holds(node: Node, tags: frozenset) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag in tags:
            return True
        todo += [c for c in n.children if c.__class__ is Node]
    return False


def never_text(node: Node) -> bool:
    """Whether a node with all below it is no text at all, or hidden."""
    if node.tag in NEVER:
        return True
    if not node.attrs:
        return False
    a = node.attributes()
    return "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def _named(attributes: dict[str, str], words: frozenset) -> bool:
    """Whether a name in class or id consists of some of `words` and neutral ones."""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        own = [w.lower() for w in _WORDS.findall(name)]
        if any(w in words for w in own) and all(w in words or w in NEUTRAL_WORD or w.isdigit() for w in own):
            return True
    return False


def marked(node: Node, in_article: bool) -> bool:
    """Whether tag, role or class mark a node as a part beside the main text."""
    a = node.attributes() if node.attrs else {}
    if node.tag in MARKED or a.get("role", "").lower() in MARKED_ROLE or (node.tag != "main" and _named(a, MARKED_WORD)):
        return True
    if in_article or not (node.tag == "header" or _named(a, HEADER_WORD)):
        return False
    # a header among paragraphs is that of the text
    return not (_holds(node, HEADINGS) and sum(c.__class__ is Node and c.tag == "p" for c in node.parent.children) > 1)


def _strip(root: Node) -> list[Node]:
    """Cut what is never text; the marked nodes of what is left, parents first."""
    found, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        node.children = [c for c in node.children if c.__class__ is str or not never_text(c)]
        for c in node.children:
            if c.__class__ is Node:
                if marked(c, inside):
                    found.append(c)
                todo.append((c, inside or c.tag in _DECLARED))
    return found


#: What is left without marked parts is too little beside the greatest sum of the page: below the first share of it, or below the second with fewer characters than this.
LITTLE, LITTLE_SHORT, SHORT = 0.1, 0.3, 140


def prune(root: Node) -> None:
    """Cut marked parts, but for those around the text (see above)."""
    marks = _strip(root)
    if not marks:
        return
    whole, out = {n.parent: n.parent.children for n in marks}, set(marks)

    def without() -> Node:
        for parent, children in whole.items():
            parent.children = [c for c in children if c not in out]
        return _centre(weigh(root), root)[0]

    left = without()
    if left.chars - left.link_chars >= sum(map(_raw_length, marks)) or (left.chars and any(n.tag == "article" for n in _upwards(left))):
        return  # most of the page's text, or an article
    for parent, children in whole.items():
        parent.children = children
    best, _ = _centre(weigh(root), root)
    total = best.total
    on_path = [n for n in reversed(_upwards(best)) if n in out]  # outermost first
    while True:
        left = without()
        if not on_path or not (left.total < LITTLE * total or (left.total < LITTLE_SHORT * total and left.chars - left.link_chars < SHORT)):
            return
        out.discard(on_path.pop(0))


def _upwards(node: Node) -> list[Node]:
    path = [node]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    return path


def _raw_length(node: Node) -> int:
    total, todo = 0, [node]
    while todo:
        for c in todo.pop().children:
            if c.__class__ is str:
                total += len(c)
            else:
                todo.append(c)
    return total


def _length(text: str) -> int:
    return len(" ".join(text.split()))


def weigh(root: Node) -> list[Node]:
    """Fill in counts, densities and sums; return the nodes, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in reversed(node.children) if c.__class__ is Node]
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if c.__class__ is str:
                node.chars += _length(c)
            else:
                node.chars += c.chars
                node.tags += c.tags + (c.tag in BLOCK or c.tag == "a")
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    links, chars = root.link_chars, max(1, root.chars)
    for node in reversed(order):
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, links / chars)
        node.total = sum(_density(_length(c), 0, 0, 0, links / chars) if c.__class__ is str else c.density for c in node.children)
    return order


def _density(chars: int, tags: int, link_chars: int, link_tags: int, page_share: float) -> float:
    """Composite text density: characters per tag times a logarithm that falls as links take over."""
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    plain = max(1, chars - link_chars)
    base = math.log(chars / plain * link_chars + page_share * chars + math.e)
    return chars / t * max(0.0, math.log(max(1.0, chars / lc * t / lt) + 1e-9)) / max(base, 1e-9) if link_chars else chars / t * max(1.0, math.log(chars * t + math.e) / base)


def _centre(order: list[Node], root: Node) -> tuple[Node, list[Node]]:
    """The container with the greatest sum, and all containers."""
    containers = [n for n in order if n.tag in BLOCK and (n is root or n.tag in _DECLARED or any(c.__class__ is Node and c.tag in BLOCK for c in n.children))]
    return max(containers, key=lambda n: n.total), containers


def main_node(root: Node) -> Node:
    """The subtree that holds the main text."""
    order = weigh(root)
    best, containers = _centre(order, root)
    path = _upwards(best)
    declared = next((n for n in path if n.tag == "article"), None) or next((n for n in path if n.tag == "main"), None)
    if declared is not None:
        return declared
    threshold = min(n.density for n in path)
    at = best
    while at.parent is not None and at.parent.link_chars <= 0.4 * max(1, at.parent.chars):
        at = at.parent
    _keep_dense(at, order, containers, threshold)
    return at


def _keep_dense(top: Node, order: list[Node], containers: list[Node], threshold: float) -> None:
    """Cut from below `top` what is less dense than the threshold, but for the centres of what stays.

    Of every part that stays the container with the greatest sum stays whole; its other parts are judged alike. Inline
    parts in a row are judged as one. Headings stay with the part that follows them.
    """
    share = order[0].link_chars / max(1, order[0].chars)
    kinds, centre, blocky = set(containers), {}, set()
    for n in reversed(order):
        below = [c for c in n.children if c.__class__ is Node]
        found = [x for x in ([n] if n in kinds else []) + [centre[c] for c in below] if x is not None]
        centre[n] = max(found, key=lambda x: x.total, default=None)
        if n.tag in BLOCK or any(c in blocky for c in below):
            blocky.add(n)

    def density(run: list) -> float:
        nodes = [c for c in run if c.__class__ is Node]
        chars = sum(c.chars if c.__class__ is Node else _length(c) for c in run)
        tags, links = (sum(getattr(c, k) + (c.tag == "a") for c in nodes) for k in ("tags", "link_tags"))
        return _density(chars, tags, sum(c.link_chars for c in nodes), links, share)

    todo = [top]
    while todo:
        node = todo.pop()
        if centre[node] is None or centre[node] is node:
            continue
        parts: list[list] = []
        for c in node.children:
            if c in blocky:
                parts.append([c])
            elif parts and parts[-1][0] not in blocky:
                parts[-1].append(c)
            else:
                parts.append([c])
        kept: list = []
        heads: list = []
        for part in parts:
            c = part[0]
            if c in blocky and (centre[c] is centre[node] or c.density >= threshold):
                todo.append(c)
            elif c in blocky or density(part) < threshold:
                heads = [*heads, c] if c in blocky and c.tag in HEADINGS else heads if all(x.__class__ is str and not x.strip() for x in part) else []
                continue
            kept += heads + part
            heads = []
        node.children = kept


def blocks(node: Node) -> list[str]:
    """The texts of blocks below a node, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x.__class__ is str:
            run.append(x)
        elif x is None:
            flush()
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page or page.isspace():
        return ""
    root = parse(page)
    prune(root)
    return "\n\n".join(blocks(main_node(root)))


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without its html column, with `text` and `n_chars` (code points)."""
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others), "text string", "n_chars long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(x if isinstance(x, str) else None) for x in batch["__html"]]
            out = batch.drop(columns="__html").astype(object)
            out["text"], out["n_chars"] = texts, [len(t) for t in texts]
            yield out

    return pages.select(*others, F.col(html).alias("__html")).mapInPandas(run, schema)


def op10_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
