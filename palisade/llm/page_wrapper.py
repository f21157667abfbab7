"""Main text of web pages by wrapper induction.

Pages of one host share a template. One page of each host, the one with the smallest hash, is its
reference; every other page is aligned with it by simple tree matching. Distinct contents vote, not
pages: a page that has most of its text in common with the reference is a copy of it and has no
vote, and pages with the same longest varying text have one vote together. The votes say, per node
of the reference, how often the node was matched and how often its own text was the same. A node
that nearly always has the same text belongs to the template; where the text varies there is a slot.
What is shuffled is two bits per node and page, by host and content, and counts that are summed per
task first, so a host with a third of all pages is no hot key, and all pages take part.

The wrapper then reads a page: nodes aligned with template nodes go, together with everything that
markup itself declares to be no article (menus, headers and footers of the page, sidebars, notices,
adverts, forms, scripts, comments). What remains inside the page's article is split into blocks.
The article is the element that says so; else the slots decide: the subtree with the most text in
varying prose. Headings and paragraphs of a declared article stay even if pages repeat them, since
copies of a page would otherwise lose their text.

Defined cases: null or empty html gives an empty text; a null or broken url puts the page on a host
of its own kind (""); a page alone on its host, or whose host has too few other contents, is read by
its markup only, as is one that would have no text left without the template; text without any markup is one block. ``extract`` keeps the columns of the input and
replaces ``text`` and ``n_chars``.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import free_name, with_fields

# Fixed values of HTML: kinds of elements, and names that mark a region.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noscript iframe noembed noframes template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr"
    " q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
DROPPED = RAW | set(
    "head nav aside footer form button select input svg canvas object audio video dialog menu"
    " fieldset".split()
)
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|advertisement|sponsor\w*|promo\w*|banner|nav|navbar|navigation"
    r"|menu|breadcrumbs?|sidebar|side|footer|foot|masthead|cookies?|consent|gdpr|notice|notices"
    r"|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share"
    r"|sharing|social|related|recommended|comments?|disqus|replies|reply|respond|widget|toolbar"
    r"|pagination|pager|skip|hidden|tags)(?:$|[\s_-])",
    re.I,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog",
         "alertdialog", "menu", "menubar", "toolbar", "note"}
ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|content|main)(?:$|[\s_-])", re.I
)

#: A reference node is template if its text was the same in this share of at least so many contents.
SAME_SHARE, LEAST_PAGES = 0.9, 4
#: A page with more than this share of its text in common with the reference is a copy of it.
COPY_SHARE = 0.5
#: References and templates are broadcast up to so many bytes in all; beyond, they are joined by host.
BROADCAST_BYTES = 16 << 20
#: Elements nest this deep at most.
MAX_DEPTH = 200

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WHITE = re.compile(r"\s+")
_CUT_TAG = re.compile(r"<[a-zA-Z/!][^<>]*\Z")


class Node:
    """An element; ``parts`` holds its texts and child elements in order."""

    __slots__ = ("attributes", "children", "key", "parts", "tag", "template")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes = tag, attributes
        self.parts: list[str | Node] = []
        self.children: list[Node] = []
        self.key = tag + "." + attributes.get("class", "")
        self.template = False

    def add(self, child: Node) -> None:
        self.parts.append(child)
        self.children.append(child)

    @property
    def own_text(self) -> str:
        return " ".join(" ".join(p for p in self.parts if isinstance(p, str)).split())


def parse(text: str) -> Node:
    """A tree of elements; end tags that are left out are filled in, comments dropped."""
    root = Node("#root", {})
    stack, at, size = [root], 0, len(text)
    while at < size:
        found = _TOKEN.search(text, at)
        if not found:
            _add_text(stack[-1], text[at:])
            break
        if found.start() > at:
            _add_text(stack[-1], text[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            _close(stack, tag)
            continue
        if tag in CLOSES_P:
            _close(stack, "p", {"button", "table", "td", "th"})
        if tag in CLOSES:
            ends, within = CLOSES[tag]
            for name in ends:
                _close(stack, name, within)
        attributes = {}
        if found[3]:
            for name, *values in _ATTRIBUTE.findall(found[3]):
                attributes.setdefault(name.lower(), entities.unescape("".join(values)))
        node = Node(tag, attributes)
        stack[-1].add(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = end.end() if end else size
        elif tag not in VOID and not found[3].rstrip().endswith("/") or tag in CLOSES_P and tag not in VOID:
            if len(stack) < MAX_DEPTH:  # deeper elements become siblings, as in browsers
                stack.append(node)
    return root


def _add_text(node: Node, text: str) -> None:
    if "<" in text:  # a tag that the end of the page cuts off is markup, not text
        text = _CUT_TAG.sub("", text)
    node.parts.append(entities.unescape(text) if "&" in text else text)


def _close(stack: list[Node], tag: str, within: set[str] = frozenset()) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in within:
            return


def align(a: Node, b: Node, pairs: list[tuple[Node, Node]]) -> int:
    """Simple tree matching: the size of the largest order-keeping match of two trees with equal
    roots; ``pairs`` gets the matched nodes."""
    left, right = a.children, b.children
    pairs.append((a, b))
    if not left or not right:
        return 1
    # Equal children at both ends are matched off before the table is filled.
    head = 0
    while head < min(len(left), len(right)) and left[head].key == right[head].key:
        head += 1
    tail = 0
    while (
        tail < min(len(left), len(right)) - head and left[-1 - tail].key == right[-1 - tail].key
    ):
        tail += 1
    total = 1
    for i in range(head):
        total += align(left[i], right[i], pairs)
    inner_left, inner_right = left[head : len(left) - tail], right[head : len(right) - tail]
    total += _align_inner(inner_left, inner_right, pairs)
    for i in range(tail, 0, -1):
        total += align(left[-i], right[-i], pairs)
    return total


def _align_inner(left: list[Node], right: list[Node], pairs: list[tuple[Node, Node]]) -> int:
    if not left or not right:
        return 0
    options: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            if x.key == y.key:
                own: list[tuple[Node, Node]] = []
                options[i, j] = align(x, y, own), own
    best = np.zeros((len(left) + 1, len(right) + 1), np.int64)
    for i in range(len(left)):
        for j in range(len(right)):
            take = best[i, j] + options[i, j][0] if (i, j) in options else -1
            best[i + 1, j + 1] = max(take, best[i, j + 1], best[i + 1, j])
    i, j, chosen = len(left), len(right), []
    while i and j:
        if (i - 1, j - 1) in options and best[i, j] == best[i - 1, j - 1] + options[i - 1, j - 1][0]:
            chosen.append(options[i - 1, j - 1][1])
            i, j = i - 1, j - 1
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    for own in reversed(chosen):
        pairs.extend(own)
    return int(best[-1, -1])


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(node.children))


def _chrome(node: Node, inside_article: bool) -> bool:
    """Whether markup says that an element is no part of an article."""
    if node.tag in DROPPED or node.tag == "header" and not inside_article:
        return True
    a = node.attributes
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if node.tag in ("html", "body", "article", "main"):
        return False
    return bool(MARKED.search(a.get("class", "")) or MARKED.search(a.get("id", "")))


def _declared(node: Node) -> bool:
    a = node.attributes
    return (
        node.tag in ("article", "main") or a.get("role", "").lower() in ("main", "article")
        or a.get("itemprop", "").lower() == "articlebody"
    )


def _article(root: Node) -> tuple[list[Node], bool]:
    """The elements that hold the article, and whether markup declares them."""
    found: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node is not root and _chrome(node, False):
            continue
        if _declared(node):
            found.append(node)
            continue
        stack.extend(reversed(node.children))
    if found:
        inner = []
        for node in found:  # an article inside <main> is the closer one
            deeper, _ = ([], 0) if node.tag == "article" else _article_within(node)
            inner.extend(deeper or [node])
        return inner, True
    named = [n for n in _visible(root) if any(
        ARTICLE.search(n.attributes.get(k, "")) for k in ("class", "id")) and _prose(n) > 0]
    for node in named or []:
        if _prose(node) * 2 > _prose(root):
            return [node], False
    node = root
    while True:  # go down while one child holds most of the prose
        heavy = [c for c in node.children if not _chrome(c, False) and _prose(c) * 10 >= _prose(node) * 9]
        if not heavy or not _prose(node) or heavy[0].tag in PROSE:
            return [node], False
        node = heavy[0]


def _article_within(node: Node) -> tuple[list[Node], int]:
    found, stack = [], list(reversed(node.children))
    while stack:
        child = stack.pop()
        if _chrome(child, False):
            continue
        if child.tag == "article":
            found.append(child)
        else:
            stack.extend(reversed(child.children))
    return found, len(found)


def _visible(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        if node is not root and _chrome(node, False):
            continue
        yield node
        stack.extend(reversed(node.children))


def _prose(node: Node) -> int:
    """Characters of varying text in headings, paragraphs and the like."""
    return sum(
        sum(len(m.own_text) for m in _walk(n) if not m.template)
        for n in _visible(node) if n.tag in PROSE and not n.template
    )


def _blocks(nodes: list[Node], declared: bool) -> list[str]:
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _WHITE.sub(" ", "".join(run)).strip()
        if text:
            blocks.append(text)
        run.clear()

    # Entries: a text, an element to open, or None for the end of a block.
    stack: list[str | Node | None] = list(reversed(nodes))
    while stack:
        entry = stack.pop()
        if entry is None:
            flush()
        elif isinstance(entry, str):
            run.append(entry)
        elif _chrome(entry, declared) and entry not in nodes:
            if entry.tag not in INLINE:
                flush()
        elif entry.template and not (declared and (entry.tag in PROSE or entry.tag in INLINE)):
            # The template's own words go; elements inside may still be slots.
            flush()
            stack.append(None)
            stack.extend(reversed(entry.children))
        elif entry.tag == "br":
            run.append(" ")
        elif entry.tag in INLINE:
            stack.extend(reversed(entry.parts))
        else:
            flush()
            stack.append(None)
            stack.extend(reversed(entry.parts))
    flush()
    return blocks


def wrapper(reference: str, template: list[int]) -> Node:
    """The reference's tree with its template nodes, given by number in page order, marked."""
    root = parse(reference)
    numbers = set(template)
    for i, node in enumerate(_walk(root)):
        node.template = i in numbers
    return root


def main_text(page: str | None, reference: Node | None = None) -> str:
    """The article of a page; ``reference`` is the host's wrapper."""
    if not page:
        return ""
    root = parse(page)
    if reference is not None:
        pairs: list[tuple[Node, Node]] = []
        align(reference, root, pairs)
        for ours, theirs in pairs:
            theirs.template = ours.template and ours.own_text == theirs.own_text
    text = _read(root)
    if not text and reference is not None:
        for node in _walk(root):
            node.template = False
        text = _read(root)
    return text


def _read(root: Node) -> str:
    nodes, declared = _article(root)
    return "\n".join(_blocks(nodes, declared))


def _content(root: Node, same: set[int]) -> str | None:
    """What a page's vote stands for: its longest text besides the nodes (by ``id``) that are the same
    in the reference; None for a copy of the reference."""
    texts = [(len(text), text, id(n) in same) for n in _visible(root) if (text := n.own_text)]
    common = sum(n for n, _, known in texts if known)
    if not texts or common > COPY_SHARE * sum(n for n, _, _ in texts):
        return None
    return max((n, text) for n, text, known in texts if not known)[1]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def induce(pages: DataFrame) -> DataFrame:
    """``host, reference, template``: a page's html and the numbers of its template nodes."""
    known = pages.where(F.length("html") > 0).select(host_of(F.col("url")).alias("host"), "html")
    digest = F.xxhash64("html")
    references = known.groupBy("host").agg(
        F.min_by("html", F.struct(digest, "html")).alias("reference"), F.count(F.lit(1)).alias("pages")
    )
    references = references.where(F.col("pages") > LEAST_PAGES).select("host", "reference")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, tuple[Node, dict[int, int], list[str]]] = {}
        for batch in batches:
            hosts, contents, votes = [], [], []
            for host, page, reference in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if page == reference:
                    continue
                if host not in trees:
                    if len(trees) > 500:
                        trees.clear()
                    tree = parse(reference)
                    nodes = list(_walk(tree))
                    trees[host] = tree, {id(n): i for i, n in enumerate(nodes)}, [n.own_text for n in nodes]
                tree, number, texts = trees[host]
                bits = np.zeros((len(number), 2), bool)
                root, pairs, same = parse(page), [], set()
                align(tree, root, pairs)
                for ours, theirs in pairs:
                    i = number[id(ours)]
                    bits[i, 0] = True
                    if texts[i] != "" and texts[i] == theirs.own_text:
                        bits[i, 1] = True
                        same.add(id(theirs))
                content = _content(root, same)
                if content is not None:
                    hosts.append(host)
                    contents.append(hashlib.md5(content.encode("utf-8", "replace")).digest())
                    votes.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(contents, pa.binary()), pa.array(votes, pa.binary())],
                names=["host", "content", "vote"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for host, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                votes = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(np.int64)
                sums[host] = sums[host] + votes if host in sums else votes
        rows = [(h, i, *map(int, v)) for h, s in sums.items() for i, v in enumerate(s.reshape(-1, 2)) if v[0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string())]
            + [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)],
            names=["host", "node", "matched", "same"],
        )

    votes = (
        _with_host(known, references).select("host", "html", "reference")
        .mapInArrow(vote, "host string, content binary, vote binary")
        .groupBy("host", "content").agg(F.min("vote").alias("vote"))
    )
    counts = (
        votes.select("host", "vote")
        .mapInArrow(count, "host string, node long, matched long, same long")
        .groupBy("host", "node").agg(F.sum("matched").alias("matched"), F.sum("same").alias("same"))
    )
    template = (
        counts.where((F.col("matched") >= LEAST_PAGES) & (F.col("same") >= SAME_SHARE * F.col("matched")))
        .groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("template"))
    )
    return references.join(template, "host")


def _with_host(pages: DataFrame, wrappers: DataFrame, how: str = "inner") -> DataFrame:
    """Joins by host; the wrappers are sent to all tasks only if they are known to be small."""
    size = wrappers.agg(F.sum(F.length("reference"))).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", how)


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Adds ``text`` and ``n_chars`` to pages with ``url`` and ``html``."""
    made = ("text", "n_chars")
    pages = pages.drop(*[c for c in pages.columns if c.lower() in made])
    own = pages.columns
    host, reference, template = (free_name(own, c) for c in ("host", "reference", "template"))
    at = own.index("html")
    wide = pages.withColumn(host, host_of(F.col("url")))
    size = wrappers.agg(F.sum(F.length("reference"))).first()[0] or 0
    wrappers = wrappers.select(*(F.col(c).alias(n) for c, n in (
        ("host", host), ("reference", reference), ("template", template))))
    joined = wide.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, host, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Node] = {}
        for batch in batches:
            hosts, references, templates = (batch.column(len(own) + i).to_pylist() for i in range(3))
            texts = []
            for page, h, ref, nodes in zip(batch.column(at).to_pylist(), hosts, references, templates):
                if ref is None:
                    texts.append(main_text(page))
                    continue
                if h not in trees:
                    if len(trees) > 500:
                        trees.clear()
                    trees[h] = wrapper(ref, nodes)
                texts.append(main_text(page, trees[h]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(own)], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=[*own, *made],
            )

    schema = with_fields(pages, text=T.StringType(), n_chars=T.LongType())
    return joined.select(*own, host, reference, template).mapInArrow(run, schema)
