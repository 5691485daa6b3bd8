"""Main text of web pages by wrapper induction over the pages of a host.

A page becomes a tree of block elements, in which neighbouring leaves of one kind are one repeated node. Pages of a host
that have the same container elements are one layout, and one page of each layout is its model. Every other page of the
layout is aligned with the model by simple tree matching, and Spark gathers for each node of the model how many pages
have it, how many have the model's text there, how many have a text there that other pages have too, and how much of the
text is links. From this follows the wrapper:

* Nodes with a constant text are template, on the pages that have that text.
* Nodes whose texts rotate (far more pages share them than share the heaviest slot's texts) and nodes that are mostly
  links are template, unless they are parts of the article beside the heaviest slot.
* All other nodes are slots, and what fills them is content.

Element names, roles and class words are hints on top, on which pages of hosts with few pages depend: blocks inside
<article> or <main> where there are such elements, and never menus, headers, footers, sidebars, notices, adverts, forms,
comments or code. A class word drops no element that holds most of the page's text. On pages without a wrapper elements
with little text go by the last word of a class name too.

The work for a page is linear in its length, but for the alignment, which takes at most NODES nodes, CHILDREN children a
node and DEPTH levels. Elements beyond them are not aligned, so that hints alone decide on their text; none is lost.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.llm import _text
from quillbank.llm._cluster import materialised

LEAST_PAGES = 5
CONSTANT = 0.8
ROTATING = 0.2  # least share of pages whose text in a node is another page's too
ABOVE_CONTENT = 3  # how many times the heaviest slot's share that has to be
LINKED = 0.6
BROADCAST_BYTES = 16 << 20
NODES, CHILDREN, DEPTH = 1024, 256, 64
OPEN = 512  # elements open at once; deeper ones are siblings
_TEXT_LIMIT = 4 << 20

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br input label "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd semantics".split()
)
VOID = frozenset("area base col embed hr link meta param source track".split())
CODE = frozenset("script style".split())  # text up to the closing tag
UNREAD = frozenset("noscript template iframe svg object title textarea".split())  # dropped, and no element at all if never closed
FLAT = frozenset("noscript iframe title textarea".split())  # do not hold one another
DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea head dialog menu title object".split())
MARKUP = frozenset("script style noscript template iframe svg select textarea head title object".split())  # of these, what is never text
HEAD = frozenset("title meta link script style base noscript template".split())
ARTICLE = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body", "main", "article"))  # no class word drops these
HOLDS = frozenset("content main article post entry story page wrapper container".split())  # nor elements that are named so
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
READERS = frozenset("comment comments reply replies respond discussion disqus".split())
WORDS = READERS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice alert sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs share sharing social related newsletter subscribe subscription popup modal overlay "
    "footer header masthead widget toolbar pagination login signup".split()
)
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())  # what inline elements go by
NO_MARK = frozenset("no not with without has is article post entry content story".split())  # first words of names that tell of something else
LITTLE = 0.2  # most of a page's text that an element may hold to go by the last word of a class name
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd figure figcaption table tr td th hr address details summary".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>=]++|=)*+>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|style\s*=\s*["'][^"']*\bdisplay\s*:\s*none\b)""", re.I)


def _leading(values: dict[str, str]) -> set[str]:
    """The first words of the class names and of the id."""
    return {_SPLIT.split(x.strip("-_"), maxsplit=1)[0] for x in f"{values.get('class', '')} {values.get('id', '')}".split()}


def _named(tag: str, leading: set[str], article: bool) -> bool:
    """Whether a class name or the id is a word of WORDS, or begins with one; a header in an article is part of it."""
    if tag in WHOLE:
        return False
    leading = leading - {"header"} if article else leading
    return not leading.isdisjoint(WORDS) and leading.isdisjoint(HOLDS)


def _ends(tag: str, values: dict[str, str]) -> bool:
    """Whether a class name or the id ends with a word of WORDS, as in main-nav or site-footer."""
    names = [[w for w in _SPLIT.split(x) if w] for x in f"{values.get('class', '')} {values.get('id', '')}".split()]
    return tag not in WHOLE and any(x and x[-1] in WORDS and x[0] not in NO_MARK for x in names)


class Node:
    """A block element: its kind (tag and class), children, and the numbers of its text blocks."""

    __slots__ = ("kind", "tag", "children", "blocks", "out", "named", "ends", "readers", "dropped", "article", "kids")

    def __init__(self, tag: str, kind: str, out: bool = False, named: bool = False, readers: bool = False, article: bool = False) -> None:
        self.tag, self.kind, self.out, self.named, self.readers, self.dropped, self.article = tag, kind, out, named, readers, False, article
        self.ends = False
        self.children: list[Node] = []
        self.blocks: list[int] = []
        self.kids: list[tuple[str, list[Node]]] = []


def tokens(html: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name, attributes, end) of each piece: kind is text, open or close; of a text, name is the text.

    After an opening tag the consumer may send() the place to go on from. Each character is looked at a bounded number
    of times: a tag ends at the first > outside of quoted values or, once that failed, at the first > at all.
    """
    at, size, last, quotes = 0, len(html), html.rfind(">"), True
    while at < size:
        less = html.find("<", at)
        if less < 0 or less > last:
            yield "text", html[at:], "", size
            return
        if less > at:
            yield "text", html[at:less], "", less
        at = less
        if html.startswith(("<!-->", "<!--->"), at):  # a comment that ends at once
            at = html.find(">", at) + 1
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            at = html.find(">", at) + 1
            continue
        name = _NAME.match(html, at + 1)
        if name is None:
            yield "text", "<", "", at + 1
            at += 1
            continue
        rest = _REST.match(html, name.end()) if quotes else None
        quotes = quotes and rest is not None
        end = rest.end() if rest else html.find(">", name.end()) + 1
        if not end:
            yield "text", html[at:], "", size
            return
        moved = yield "close" if name[1] else "open", name[2].lower(), html[name.end() : end - 1], end
        at = end if moved is None else moved
        if moved is not None:
            yield "text", "", "", at  # what send() returns


def parse(html: str, hints: bool = True) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The tree of block elements, and the text blocks in page order: element, text, and how many characters are links.

    Elements go by their class words unless they hold the body, <main>, the only articles of the page, or most of its
    text (reader comments: nine tenths of it); hidden ones go too, and inline ones by words for adverts, up to the end of
    their block. Without hints only markup that is never text goes. No recursion, and at most OPEN open elements; what is
    deeper becomes siblings.
    """
    root = Node("", "")
    stack, blocks, held, linked = [root], [], [], 0
    opened, skipped, closers = Counter(), Counter(), {}
    link, muted, depth_muted = False, "", 0
    dropping = DROPPED if hints else MARKUP

    def flush() -> None:
        nonlocal linked, muted
        muted = ""
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                stack[-1].blocks.append(len(blocks))
                blocks.append((stack[-1], text, min(linked, len(text))))
        linked = 0

    def pop(depth: int) -> None:
        for x in stack[depth:]:
            opened[x.tag] -= 1
        del stack[depth:]

    pieces = tokens(html)
    for kind, tag, attributes, end in pieces:
        if kind == "text":
            if not muted:
                held.append(tag)
                linked += len(tag) if link else 0
            continue
        if tag in INLINE:
            if tag == muted:
                depth_muted += 1 if kind == "open" else -1
                muted = muted if depth_muted else ""
                held.append(" ")
            elif hints and not muted and kind == "open" and tag not in ("br", "img", "input", "wbr") and "class" in attributes.lower():
                values = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
                if not attributes.endswith("/") and not ADVERTS.isdisjoint(_leading({"class": values.get("class", "")})):
                    muted, depth_muted = tag, 1
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                link = kind == "open"
            continue
        flush()
        if kind == "close":
            if skipped[tag]:
                skipped[tag] -= 1
            elif opened[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                pop(depth)
            continue
        if stack[-1].tag == "p":
            pop(len(stack) - 1)
        if opened["head"] and tag not in HEAD and stack[-1].tag == "head":
            pop(len(stack) - 1)
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ("ul", "ol", "table", "dl", "select"):
                    break
                if stack[depth].tag in CLOSES[tag]:
                    pop(depth)
                    break
        values = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
        above = stack[-1]
        inside = tag == "header" and above.article or tag == "footer" and above.tag in ("blockquote", "figure")
        out = tag in dropping and not inside or hints and (values.get("role") in ROLES or bool(attributes) and tag not in WHOLE and _HIDDEN.search(attributes) is not None)
        leading = _leading(values) if hints else set()
        article = hints and (above.article or tag in ARTICLE)
        node = Node(tag, f"{tag}.{values.get('class', '')}", out, _named(tag, leading, above.article), not leading.isdisjoint(READERS), article)
        node.ends = hints and _ends(tag, values) and not (article and "header" in node.kind)
        if tag in ARTICLE or tag == "body":
            for x in stack:
                x.ends = False
        if tag in ("main", "body"):
            for x in stack:
                x.named = False
        void = tag in VOID or attributes.endswith("/") and tag not in CODE
        if tag in UNREAD and not void:
            if tag not in closers:
                closers[tag] = max((m.start() for m in re.compile(rf"</{tag}\b", re.I).finditer(html, end)), default=-1)
            void = closers[tag] < end or tag in FLAT and re.compile(rf"<(/?){tag}\b", re.I).search(html, end)[1] == ""
        if tag in UNREAD and void:
            continue
        above.children.append(node)
        if tag in CODE:
            closing = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, end)
            pieces.send(closing.end() if closing else len(html))
        elif void:
            continue
        elif len(stack) < OPEN:
            opened[tag] += 1
            stack.append(node)
        else:
            skipped[tag] += 1
    flush()
    _settle(root, blocks)
    _drop(root)
    if blocks and not _in_article(blocks) and _free_articles(root):
        _drop(root)
    return root, blocks


def _settle(root: Node, blocks: list[tuple[Node, str, int]]) -> None:
    """Take the class words from elements that hold most of the text which element names and roles leave."""
    order = [(root, False)]
    above: dict[int, Node] = {}
    for node, out in order:
        order += [(x, out or x.out) for x in node.children]
        above.update((id(x), node) for x in node.children)
    mass: dict[int, int] = {}
    for node, out in reversed(order):
        own = 0 if out else sum(len(blocks[i][1]) for i in node.blocks)
        mass[id(node)] = mass.get(id(node), 0) + own
        if node is not root:
            up = id(above[id(node)])
            mass[up] = mass.get(up, 0) + mass[id(node)]
    total = mass[id(root)]
    for node, out in order:
        if node.named and not out and mass[id(node)] > (0.9 if node.readers else 0.5) * total:
            node.named = False
        if node.ends and mass[id(node)] > LITTLE * total:
            node.ends = False


def _drop(root: Node, ends: bool = False) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        for x in node.children:
            x.dropped = node.dropped or x.out or x.named or ends and x.ends
        todo += node.children


def _free_articles(root: Node) -> bool:
    """Take the class words from all elements that hold an article; whether there were any.

    What is outside of these articles stays content too: they may be comments on a page without other articles.
    """
    order, above, found = [root], {}, False
    for node in order:
        above.update((id(x), node) for x in node.children)
        order += node.children
    for node in order:
        up = node if node.tag in ARTICLE else root
        while up is not root:
            up = above[id(up)]
            found, up.named = found or up.named, False
    for node in order:
        node.article = node.article and not found
    return found


def skeleton(root: Node) -> list:
    """[kind, children], with neighbouring leaves of one kind as one child; node.kids gets the elements of each.

    More than CHILDREN children are folded: all of one kind are one child, without children of its own if they are
    several. What is beyond the bounds has no node.
    """
    out = [root.kind, []]
    todo, left = [(root, out, 0)], NODES - 1
    for node, made, depth in todo:
        node.kids = []
        if depth >= DEPTH:
            continue
        for child in node.children:
            if node.kids and not child.children and node.kids[-1][0] == child.kind and not node.kids[-1][1][0].children:
                node.kids[-1][1].append(child)
            else:
                node.kids.append((child.kind, [child]))
        if len(node.kids) > CHILDREN:
            folded: dict[str, list[Node]] = {}
            for kind, group in node.kids:
                folded.setdefault(kind, []).extend(group)
            node.kids = list(folded.items())[:CHILDREN]
        node.kids = node.kids[: max(0, left)]
        left -= len(node.kids)
        for kind, group in node.kids:
            made[1].append([kind, []])
            if len(group) == 1 and group[0].children:
                todo.append((group[0], made[1][-1], depth + 1))
    return out


def tree_match(a: list, b: list) -> tuple[int, list]:
    """Simple tree matching: the most pairs of equal nodes in order, and for each child pair (i, j, its own pairs)."""
    if a[0] != b[0]:
        return 0, []
    m, n = len(a[1]), len(b[1])
    best = [[0] * (n + 1) for _ in range(m + 1)]
    inner = {}
    for i in range(m):
        row, after, x = best[i], best[i + 1], a[1][i]
        for j in range(n):
            score = 0
            if x[0] == b[1][j][0]:
                score, pairs = tree_match(x, b[1][j])
                inner[i, j] = score, pairs
            after[j + 1] = max(row[j + 1], after[j], row[j] + score)
    i, j, out = m, n, []
    while i and j:
        if (i - 1, j - 1) in inner and best[i][j] == best[i - 1][j - 1] + inner[i - 1, j - 1][0]:
            i, j = i - 1, j - 1
            out.append((i, j, inner[i, j][1]))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, out[::-1]


def _groups(root: Node) -> list[list[Node]]:
    """Elements of each skeleton node, in preorder; skeleton(root) must have been called."""
    out, todo = [], [[root]]
    while todo:
        group = todo.pop()
        out.append(group)
        if len(group) == 1:
            todo += [inner for _, inner in reversed(group[0].kids)]
    return out


def _sizes(tree: list) -> int:
    return 1 + sum(_sizes(x) for x in tree[1])


def _parents(tree: list) -> list[int]:
    """For each node, in preorder, the number of its parent; -1 for the root."""
    out: list[int] = []

    def walk(node: list, parent: int) -> None:
        at = len(out)
        out.append(parent)
        for x in node[1]:
            walk(x, at)

    walk(tree, -1)
    return out


def _numbers(model: list, tree: list) -> list[int]:
    """For each node of `tree`, in preorder, the preorder number of the node of `model` that it is aligned with, or -1."""
    out = [-1] * _sizes(tree)

    def place(a: list, at: int, b: list, to: int, pairs: list) -> None:
        out[to] = at
        starts = [at + 1]
        for x in a[1]:
            starts.append(starts[-1] + _sizes(x))
        begins = [to + 1]
        for x in b[1]:
            begins.append(begins[-1] + _sizes(x))
        for i, j, inner in pairs:
            place(a[1][i], starts[i], b[1][j], begins[j], inner)

    score, pairs = tree_match(model, tree)
    if score:
        place(model, 0, tree, 0, pairs)
    return out


class Aligned:
    """Alignments with the models of hosts, held by the shape of the page."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], list[int]] = {}

    def numbers(self, model: str, tree: list) -> list[int]:
        """As _numbers(), the model in JSON."""
        key = model, json.dumps(tree)
        if key not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[key] = _numbers(json.loads(model), tree)
        return self.known[key]


def _texts(group: list[Node], blocks: list[tuple[Node, str, int]]) -> str:
    return "\n".join(blocks[i][1] for node in group for i in node.blocks)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _in_article(blocks: list[tuple[Node, str, int]]) -> bool:
    return any(node.article and not node.dropped for node, _, _ in blocks)


def describe(html: str | None, hints: bool = True) -> tuple[str, list[str], list[bool], list[int], list[bool]]:
    """A page as a model: its skeleton in JSON; for each node its text, whether it can hold content, its parent, and
    whether it can be a part of an article."""
    root, blocks = parse(html or "", hints)
    tree = skeleton(root)
    groups, article = _groups(root), _in_article(blocks)
    slots = [any(not x.dropped and (x.article or not article) for x in g) for g in groups]
    return json.dumps(tree), [_texts(g, blocks) for g in groups], slots, _parents(tree), [g[0].tag in PARTS for g in groups]


def main_text(html: str | None, model: str | None = None, constant: dict[int, str] | None = None, held: Aligned | None = None, moving: set[int] | None = None, hints: bool = True) -> str:
    """Content of a page, one line for each block.

    `constant` are the model's nodes of one text, with it, and `moving` those of rotating texts and of links. A constant
    node is left out where the page has its text, a moving one where it is not in an article; neither if they are the
    larger part of an article, nor if nothing else is left. Without a model, elements with little text go by the last word
    of a class name too.
    """
    root, blocks = parse(html or "", hints)
    if not model and hints:
        _drop(root, True)
    template: set[int] = set()
    if model and (constant or moving):
        tree = skeleton(root)
        for group, number in zip(_groups(root), (held or Aligned()).numbers(model, tree), strict=True):
            if constant and number in constant and _texts(group, blocks) == constant[number]:
                template.update(id(x) for x in group)
            elif moving and number in moving:
                template.update(id(x) for x in group if not x.article)
    article = _in_article(blocks)
    whole = [(node, text) for node, text, _ in blocks if not node.dropped and (node.article or not article)]
    kept = [text for node, text in whole if id(node) not in template]
    left, size = sum(map(len, kept)), sum(len(text) for _, text in whole)
    if not left or article and 2 * left < size:
        kept = [text for _, text in whole]
    return "\n".join(kept)


def host_of(url):
    """Host of a url in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def layout_of(html):
    """A hash of the distinct container elements of a page, with their classes, whatever their order and number."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<((?:body|main|article|section|nav|header|footer|aside|form|table|div)(?:\s[^<>]*?\bclass=["']?[\w\- ]*)?)"""), 1)
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(x)))), "\n"))


_MODEL = "host string, layout long, model string, texts array<string>, slots array<boolean>, parents array<int>, parts array<boolean>"
_EVIDENCE = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("node", pa.int32()), ("digest", pa.int64()), ("pages", pa.int64()), ("same", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())])


def _describe(hints: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.bool_())
        for batch in batches:
            found = [describe(x, hints) for x in batch.column("html").to_pylist()]
            columns = [pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), *columns], names=["host", "layout", "model", "texts", "slots", "parents", "parts"])

    return run


def _compare(hints: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each node of a model and each text there: how many pages, whether it is the model's, characters, of links."""
        held = Aligned()
        for whole in batches:
            counts: dict[tuple, list[int]] = {}
            for batch in _text.sub_batches(whole, "html", _TEXT_LIMIT):
                for host, layout, html, model, texts in zip(*(batch.column(x).to_pylist() for x in ("host", "layout", "html", "model", "texts")), strict=True):
                    root, blocks = parse(html or "", hints)
                    tree = skeleton(root)
                    for group, number in zip(_groups(root), held.numbers(model, tree), strict=True):
                        text = _texts(group, blocks) if number >= 0 else ""
                        if text:
                            entry = counts.setdefault((host, layout, number, _digest(text)), [0, int(text == texts[number]), 0, 0])
                            entry[0] += 1
                            entry[2] += len(text)
                            entry[3] += sum(blocks[i][2] for node in group for i in node.blocks)
            rows = [(*k, v[0], v[0] * v[1], v[2], v[3]) for k, v in counts.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(_EVIDENCE)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _EVIDENCE, strict=True)], schema=_EVIDENCE)

    return run


def _extract(hints: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Aligned()
        for whole in batches:
            for batch in _text.sub_batches(whole, "html", _TEXT_LIMIT):
                columns = (batch.column(x).to_pylist() for x in ("html", "model", "constant", "texts", "moving"))
                out = [main_text(h, m, dict(zip(c or (), t or (), strict=True)), held, set(v or ()), hints) for h, m, c, t, v in zip(*columns, strict=True)]
                columns = [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, constant: float = CONSTANT, hints: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages` (page_id, url, html).

    Character references are decoded, white space in a block is one space, blocks are joined by one newline. Null and
    empty html give an empty text. A null url, or one without a host, belongs to the host "". Layouts of fewer than
    `least_pages` pages are one group of their host; groups of fewer have no wrapper, and hints alone decide.
    A node is constant if at least `constant` of at least `least_pages` aligned pages have the model's text there,
    provided that some node of that group which can hold content varies (else its pages are copies of one, and nothing
    is template). Pages with another text there keep it. Without `hints` the wrapper alone decides, and pages without
    one give all their text. Rows that repeat come back each. Other columns are left out.
    A host with a large share of all pages is only ever pre-aggregated.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "own": layout_of(F.col("html"))})
    small = lambda df, size: F.broadcast(df) if size <= BROADCAST_BYTES else df
    first = F.min_by("html", F.struct(F.xxhash64("page_id"), F.col("page_id"), F.col("html"))).alias("html")
    counted = materialised(rows.groupBy("host", "own").agg(first, F.count("*").alias("pages")))
    known = counted.where(F.col("pages") >= least_pages).select("host", "own", F.col("own").alias("layout"), "html")
    rest = counted.where(F.col("pages") < least_pages).groupBy("host").agg(F.min_by("html", F.struct("own", "html")).alias("html"), F.sum("pages").alias("pages"))
    rest = rest.where(F.col("pages") >= least_pages).select("host", F.lit(0).cast("long").alias("layout"), "html")
    models = materialised(known.select("host", "layout", "html").unionByName(rest).mapInArrow(_describe(hints), _MODEL))
    named = materialised(known.select("host", "own", "layout"))
    rows = rows.join(small(named, 40 * named.count()), ["host", "own"], "left").withColumn("layout", F.coalesce("layout", F.lit(0).cast("long")))

    weight = models.agg(F.sum(F.length("model") + F.length(F.array_join("texts", "")))).first()[0] or 0
    keys = ["host", "layout"]
    seen = rows.join(small(models, 2 * weight), keys).select(*keys, "html", "model", "texts").mapInArrow(_compare(hints), ", ".join(f"{f.name} {'string' if f.name == 'host' else 'int' if f.name == 'node' else 'long'}" for f in _EVIDENCE))
    sums = [F.sum(x).alias(x) for x in ("pages", "same", "chars", "links")]
    nodes = seen.groupBy(*keys, "node", "digest").agg(*sums).withColumn("shared", F.when(F.col("pages") > 1, F.col("pages")).otherwise(0))
    nodes = nodes.groupBy(*keys, "node").agg(*sums, F.sum("shared").alias("shared"))
    wrappers = nodes.groupBy(*keys).agg(F.collect_list(F.struct("node", "pages", "same", "chars", "links", "shared")).alias("nodes")).join(models, keys)
    content = F.filter("nodes", lambda x: F.get("slots", x["node"]))
    heaviest = F.array_max(F.transform(content, lambda x: F.struct(x["chars"], x["node"], (x["shared"] / x["pages"]).alias("share"))))
    wrappers = wrappers.withColumns({"heaviest": heaviest, "varied": F.exists(content, lambda x: x["same"] < 0.5 * x["pages"])})
    wrappers = wrappers.where("varied")
    fixed = F.filter("nodes", lambda x: (x["pages"] >= least_pages) & (x["same"] >= constant * x["pages"]))
    floor = F.greatest(F.lit(ROTATING), ABOVE_CONTENT * F.col("heaviest.share"))

    def moves(x):
        beside = F.get("parts", x["node"]) & F.get("parents", x["node"]).eqNullSafe(F.get("parents", F.col("heaviest.node")))
        often = (x["shared"] >= floor * x["pages"]) | (x["links"] >= LINKED * x["chars"])
        return (x["pages"] >= least_pages) & often & ~beside & (x["node"] != F.col("heaviest.node"))

    number = lambda x: x["node"]
    wrappers = wrappers.withColumns({"constant": F.transform(fixed, number), "moving": F.transform(F.filter("nodes", moves), number)})
    wrappers = materialised(wrappers.select(*keys, "model", "constant", F.transform("constant", lambda x: F.get("texts", x)).alias("texts"), "moving"))
    out = rows.join(small(wrappers, 2 * weight), keys, "left")
    return out.select("page_id", "url", "html", "model", "constant", "texts", "moving").mapInArrow(_extract(hints), "page_id long, url string, text string, n_chars long")


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
