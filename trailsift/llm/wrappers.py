"""HTML extraction by wrapper induction: align pages of a host, keep what varies.

Method
------
A page becomes a tree of its block elements; runs of siblings of the same shape are one
starred node, as in a list of paragraphs. The most frequent tree of a host is its seed.
Simple tree matching (the largest order-preserving matching of two trees' nodes, by dynamic
programming over the children of matched nodes) aligns every page of the host with it, and the
texts that meet at a seed node are counted over the host's distinct pages. A node whose
text is the same on nearly all of them is template, and so is a text that some member of a
run has on nearly all of them; the other members of runs, and headings, are slots.
Together with the roles that tags, ``role`` and ``class`` state (menus, adverts, notices,
comments and so on) this gives the host's wrapper.

A page's text is that of its article (``article``, ``main`` or an element whose class says
so; without any, the body's blocks that are not mostly links), less roles that are no article and
less template nodes. The page's tree and wrapper meet by host; hosts of any size are dealt out
by page, since only counts per seed node are grouped.

Edge cases
----------
Null or empty html: text ``""``. Null urls share the empty host. Unclosed, crossed and
missing tags are tolerated; ``<`` that opens no tag is text. A host with fewer than
``LEAST_PAGES`` distinct pages has no template nodes, roles decide. Elements nested deeper than
``DEEPEST`` count as part of the element there, unless they state a role; their end tags close only
themselves. (``DEEPEST_ROLE`` levels of such elements are told apart; what is no article goes at any depth.) Null ids and repeated rows are extracted like
any other; an empty table gives an empty table. A very long page is aligned with its seed in time that grows with the
page where heads, tails or kinds of blocks are alike, and with the product of the differing blocks else; memory with
the blocks times their root.
"""

from __future__ import annotations

import html
import json
import math
import re
import zlib
from collections.abc import Iterator, Mapping
from types import MappingProxyType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.llm.common import materialize
from trailsift.llm.url_filter import host_and_path

#: A text that this share of a host's distinct pages have at a node is template.
TEMPLATE_SHARE, LEAST_PAGES = 0.9, 10
DEEPEST, DEEPEST_ROLE = 150, 20
#: Trees and wrappers of more bytes than this are joined by shuffle instead of broadcast; characters of the trees
#: whose alignment a worker remembers.
BROADCAST_BYTES, REMEMBERED = 16 << 20, 8 << 20

# Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img br".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noembed noframes svg math".split())
NO_ARTICLE = frozenset("nav header footer aside form menu dialog button select input head object canvas audio video "
                       "map datalist fieldset".split()) | RAW
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"),
          "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",),
         "dd": ("dl",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ARTICLE_WORDS = frozenset("article content post entry story main body text".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification alert alerts popup modal overlay newsletter subscribe subscription signup "
    "sidebar side widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs menu "
    "menubar nav navbar navigation toolbar footer masthead comment comments disqus reply replies discussion login "
    "search pagination pager paging toc skip disclaimer copyright".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog "
                        "toolbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
                  r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: One attribute after the other, name and value: a value is never searched for names.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?")
_SAYS = frozenset(("class", "id", "role", "hidden", "style", "aria-hidden"))
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile("[a-z]+")


class Node:
    __slots__ = ("tag", "key", "role", "items", "number", "inline", "level", "shared")

    def __init__(self, tag: str, key: str, role: str):
        #: role: "" (nothing said), "article" or "other"; number: place in the page's tree, or -1.
        self.tag, self.key, self.role, self.items, self.number = tag, key, role, [], -1
        self.inline = tag in INLINE
        #: Depth in the tree, and whether the node is none of the tree's own: its items are those of one around it.
        self.level, self.shared = 1, False


def _role(tag: str, attributes: str) -> tuple[str, str]:
    """(role, class words for the key) of an element."""
    role, words = "", ""
    if tag in NO_ARTICLE:
        role = "other"
    elif tag in ("article", "main"):
        role = "article"
    if not attributes.strip():
        return role, words
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name not in _SAYS:
            continue
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            found = _WORDS.findall(value)
            if name == "class":
                words = ".".join(sorted(set(found)))
            if any(w in OTHER_WORDS for w in found) and tag not in ("body", "html"):
                role = "other"
            elif not role and tag in ("div", "section") and any(w in ARTICLE_WORDS for w in found):
                role = "article"
        elif name == "role":
            if value in OTHER_ROLES:
                role = "other"
            elif value in ("main", "article"):
                role = role or "article"
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                name == "style" and _HIDDEN.search(value)):
            role = "other"
    return role, words


def parse(text: str) -> Node:
    """The page's tree. Raw elements (scripts, styles) are left out."""
    root = Node("html", "html", "")
    stack = [root]
    at, end = 0, len(text)
    find = _TAG.search
    while at < end:
        m = find(text, at)
        if not m:
            stack[-1].items.append(text[at:])
            break
        if m.start() > at:
            stack[-1].items.append(text[at:m.start()])
        at = m.end()
        if m[1]:
            _close(stack, m[1].lower())
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        attributes = (m[3] if m[2] else m[5]) or ""
        if tag in VOID:
            if tag == "br" or tag == "hr":
                stack[-1].items.append(" ")
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                closing = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(text, at)
                at = closing.end() if closing else end
            stack[-1].items.append(" ") if tag not in ("script", "style", "template") else None
            continue
        if tag not in INLINE:
            _make_room(stack, tag)
        role, words = _role(tag, attributes)
        node = Node(tag, f"{tag}.{words}" if words else tag, role)
        parent = stack[-1]
        if parent.level < DEEPEST or ((role or tag in HEADINGS) and parent.level < DEEPEST + DEEPEST_ROLE):
            node.level = parent.level + 1
            parent.items.append(node)
        else:
            node.level = parent.level
            if role != "other":
                node.items, node.shared = parent.items, True
            if not node.inline:
                parent.items.append(" ")
        stack.append(node)
    return root


def _end(stack: list[Node], k: int) -> None:
    """Ends the open elements from the k-th on."""
    for node in stack[k:]:
        if node.shared and not node.inline:
            node.items.append(" ")
    del stack[k:]


def _make_room(stack: list[Node], tag: str) -> None:
    """A block element ends an open paragraph, and some elements end their like."""
    closes, scope = CLOSES.get(tag, ()), SCOPE.get(tag, ())
    for k in range(len(stack) - 1, 0, -1):
        name = stack[k].tag
        if name == "p":
            _end(stack, k)
            return _make_room(stack, tag) if closes else None
        if name in closes:
            _end(stack, k)
            if name == tag or tag in ("dt", "dd", "td", "th"):
                return
            continue
        if name in scope or (not stack[k].inline and not closes):
            return


def _close(stack: list[Node], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            _end(stack, k)
            return
        # A closing inline tag doesn't end blocks around it.
        if tag in INLINE and not stack[k].inline:
            return


def _blocks(node: Node) -> list[Node]:
    """Block children, seen through inline elements that say no role."""
    out = []
    for item in node.items:
        if isinstance(item, Node):
            out.extend(_blocks(item) if item.inline and not item.role else [item])
    return out


def _own_text(node: Node) -> str:
    """Text that stands in the node itself, inline elements included."""
    parts: list[str] = []

    def add(n: Node) -> None:
        for item in n.items:
            if isinstance(item, str):
                parts.append(item)
            elif item.inline and not item.role:
                add(item)
            else:
                parts.append(" ")
    add(node)
    return " ".join(html.unescape("".join(parts)).split())


def _text_hash(node: Node) -> int:
    """Of the text that stands in the node itself; 0 if there is none."""
    text = _own_text(node)
    return zlib.crc32(text.encode("utf-8", "replace")) << 20 | len(text) & 0xFFFFF if text else 0


def shape(root: Node) -> tuple[list, list[tuple[int, int, bool]]]:
    """The collapsed tree [key, starred, children] and (number, text hash, lone) of its texts; numbers
    the nodes of the page. Only one node of a starred run is in the tree; each text of its members
    counts once, as not lone."""
    texts: list[tuple[int, int, bool]] = []
    counter = [0]

    def plan(node: Node) -> tuple[list, list]:
        """Tree without numbers, and the page's nodes behind each of its nodes."""
        children: list = []
        behind: list = []
        for block in _blocks(node):
            tree, nodes = plan(block)
            if children and children[-1][0] == tree[0] and children[-1][2] == tree[2]:
                children[-1][1] = 1
                behind[-1].append(nodes)
            else:
                children.append(tree)
                behind.append([nodes])
        return [node.key, 0, children], [node, behind]

    def number(tree: list, runs: list, starred: bool) -> None:
        mine = counter[0]
        counter[0] += 1
        for node, _ in runs:
            node.number = mine
        if runs[0][0].tag not in HEADINGS:
            lone = len(runs) == 1 and not starred
            texts.extend((mine, h, lone) for h in sorted({_text_hash(node) for node, _ in runs} - {0}))
        for k, child in enumerate(tree[2]):
            members = [r for _, behind in runs for r in behind[k]]
            number(child, members, starred or bool(child[1]))

    tree, nodes = plan(root)
    number(tree, [nodes], False)
    return tree, texts


def _best_pairs(kinds: np.ndarray, others: np.ndarray, weight: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Weight and pairs of an order-preserving matching of two sequences of kinds that weighs most.

    The table's rows are kept at every ``step`` th place and filled in again from there on the way back, so that
    memory is the length times its root.
    """
    n, m = len(kinds), len(others)
    step = max(1, math.isqrt(n))
    gains: dict[int, np.ndarray] = {}

    def filled(row: np.ndarray, start: int, stop: int) -> list[np.ndarray]:
        rows = [row]
        for i in range(start, stop):
            kind = int(kinds[i])
            if kind not in gains:
                if len(gains) >= step:
                    gains.clear()
                gains[kind] = weight[kind][others]
            row = rows[-1].copy()
            np.maximum(row[1:], rows[-1][:-1] + gains[kind], out=row[1:])
            np.maximum.accumulate(row, out=row)
            rows.append(row)
        return rows

    kept = [np.zeros(m + 1, np.int32)]
    for start in range(0, n, step):
        kept.append(filled(kept[-1], start, min(n, start + step))[-1])
    best, pairs, i, j = int(kept[-1][m]), [], n, m
    for part in range(len(kept) - 2, -1, -1):
        start = part * step
        rows = filled(kept[part], start, i) if j else []
        while i > start and j:
            if rows[i - start][j] == rows[i - start - 1][j]:
                i -= 1
            elif rows[i - start][j] == rows[i - start][j - 1]:
                # The first place with this weight is as good as any up to j.
                j = int(np.searchsorted(rows[i - start][:j + 1], rows[i - start][j]))
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        i = min(i, start)
    return best, pairs


def match_trees(page: list, seed: list) -> dict[int, int]:
    """Simple tree matching: page node number -> seed node number (both in preorder).

    Equal subtrees are one kind and are compared once. Children that two nodes have in common at their
    heads and tails match each other (no matching weighs more); those between are matched by a table of numpy rows.
    """
    kind_of: dict[tuple, int] = {}
    facts: list[tuple[str, tuple[int, ...], int]] = []  # by kind: key, kinds of the children, nodes

    def listed(tree: list, number: int, out: list) -> int:
        """Appends (number, kind, children's places in ``out``), children first; returns the last number used."""
        mine, below = number, []
        for child in tree[2]:
            number = listed(child, number + 1, out)
            below.append(len(out) - 1)
        fact = (tree[0], tuple(out[c][1] for c in below))
        if fact not in kind_of:
            kind_of[fact] = len(facts)
            facts.append((*fact, 1 + sum(facts[c][2] for c in fact[1])))
        out.append((mine, kind_of[fact], below))
        return number

    pages, seeds = [], []
    listed(page, 0, pages)
    listed(seed, 0, seeds)
    known: dict[tuple[int, int], int] = {}

    def pairs_of(a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """Matched nodes below two kinds of one key, and the places of the children that match."""
        below_a, below_b = facts[a][1], facts[b][1]
        head, most = 0, min(len(below_a), len(below_b))
        while head < most and below_a[head] == below_b[head]:
            head += 1
        tail = 0
        while tail < most - head and below_a[-1 - tail] == below_b[-1 - tail]:
            tail += 1
        pairs = [(k, k) for k in range(head)]
        pairs += [(len(below_a) - 1 - k, len(below_b) - 1 - k) for k in range(tail)]
        total = sum(facts[below_a[k]][2] for k, _ in pairs)
        mine, others = below_a[head:len(below_a) - tail], below_b[head:len(below_b) - tail]
        if mine and others:
            kinds_a, at_a = np.unique(mine, return_inverse=True)
            kinds_b, at_b = np.unique(others, return_inverse=True)
            weight = np.zeros((len(kinds_a), len(kinds_b)), np.int32)
            by_key: dict[str, list[int]] = {}
            for j, y in enumerate(kinds_b.tolist()):
                by_key.setdefault(facts[y][0], []).append(j)
            for i, x in enumerate(kinds_a.tolist()):
                for j in by_key.get(facts[x][0], ()):
                    weight[i, j] = size(x, int(kinds_b[j]))
            between, found = _best_pairs(at_a, at_b, weight)
            total += between
            pairs += [(i + head, j + head) for i, j in found]
        return total, pairs

    def size(a: int, b: int) -> int:
        """Matched nodes of two kinds of trees."""
        if a == b:
            return facts[a][2]
        if facts[a][0] != facts[b][0]:
            return 0
        if not facts[a][1] or not facts[b][1]:
            return 1
        if (a, b) not in known:
            known[a, b] = 1 + pairs_of(a, b)[0]
        return known[a, b]

    out, todo = {}, [(len(pages) - 1, len(seeds) - 1)]
    placed: dict[tuple[int, int], list[tuple[int, int]]] = {}
    while todo:
        i, j = todo.pop()
        (number, a, below_a), (other, b, below_b) = pages[i], seeds[j]
        if facts[a][0] == facts[b][0]:
            out[number] = other
            if (a, b) not in placed:
                placed[a, b] = pairs_of(a, b)[1]
            todo.extend((below_a[x], below_b[y]) for x, y in placed[a, b])
    return out


def article_text(root: Node, template: frozenset[int] = frozenset(),
                 repeated: Mapping[int, frozenset[int]] = MappingProxyType({})) -> str:
    """The main text: blocks of the article in page order, joined by a space. Nodes of ``template``
    are silent, and those whose text is among the ``repeated`` ones of their number."""
    parts: list[str] = []

    def add(node: Node, silent: bool = False) -> None:
        silent = silent or node.number in template or (
            node.number in repeated and _text_hash(node) in repeated[node.number])
        for item in node.items:
            if isinstance(item, str):
                if not silent:
                    parts.append(item)
            elif item.role == "other" and not _is_title(item):
                parts.append("" if item.inline else " ")
            elif item.inline:
                add(item, silent and not item.role)
            else:
                parts.append(" ")
                add(item)
                parts.append(" ")

    regions = _articles(root)
    if regions:
        for node in regions:
            add(node)
            parts.append(" ")
    else:
        for node in _loose_blocks(root):
            add(node)
            parts.append(" ")
    return " ".join(html.unescape("".join(parts)).split())


def _is_title(node: Node) -> bool:
    """An article's own header: one that holds a heading and no further blocks than lines of text."""
    return node.tag == "header" and node.key == "header" and any(b.tag in HEADINGS for b in _blocks(node))


def _articles(root: Node) -> list[Node]:
    """Outermost elements that say they are the article. Inside ``main``, its articles if it has any."""
    out: list[Node] = []

    def walk(node: Node) -> None:
        for item in node.items:
            if isinstance(item, Node) and item.role != "other":
                if item.role == "article":
                    inner: list[Node] = []
                    if item.tag != "article":
                        before = len(out)
                        walk(item)
                        inner = out[before:]
                        if not any(n.tag in ("article", "main") for n in inner):
                            del out[before:]
                            inner = []
                    if not inner:
                        out.append(item)
                else:
                    walk(item)
    walk(root)
    if any(n.tag in ("article", "main") for n in out):
        out = [n for n in out if n.tag in ("article", "main")]
    return out


def _loose_blocks(root: Node) -> list[Node]:
    """Without a stated article: the body, less blocks whose text is mostly links."""
    def lengths(node: Node) -> tuple[int, int]:
        text = link = 0
        for item in node.items:
            if isinstance(item, str):
                text += len(item.strip())
            elif item.role != "other":
                t, x = lengths(item)
                text += t
                link += t if item.tag == "a" else x
        return text, link

    for node in _blocks(root):
        text, link = lengths(node)
        if text and 2 * link > text:
            node.role = "other"
    return [root]


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: host, tree, texts by node, and a hash of all texts."""
    for batch in batches:
        trees, numbers, hashes, lone, wholes = [], [], [], [], []
        for page in batch.column("html"):
            text = page.as_py() or ""
            tree, texts = shape(parse(text))
            trees.append(json.dumps(tree, separators=(",", ":")))
            numbers.append([n for n, _, _ in texts])
            hashes.append([h for _, h, _ in texts])
            lone.append([x for _, _, x in texts])
            wholes.append(zlib.crc32(text.encode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array(trees, pa.string()), pa.array(numbers, pa.list_(pa.int32())),
             pa.array(hashes, pa.list_(pa.int64())), pa.array(lone, pa.list_(pa.bool_())), pa.array(wholes, pa.int64())],
            names=["host", "tree", "numbers", "hashes", "lone", "whole"])


_aligned: dict[tuple[str, str], dict[int, int]] = {}
_remembered = [0]


def _align(tree: str, seed: str) -> dict[int, int]:
    """match_trees, remembered for the pairs of trees a worker meets, up to a length of all of them."""
    if (tree, seed) not in _aligned:
        _remembered[0] += len(tree) + len(seed)
        if _remembered[0] > REMEMBERED:
            _aligned.clear()
            _remembered[0] = len(tree) + len(seed)
        _aligned[(tree, seed)] = match_trees(json.loads(tree), json.loads(seed))
    return _aligned[(tree, seed)]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, seed node, text hash, lone) of every text that is aligned with its host's seed, and a row
    with hash 0 for every page and seed node with a text."""
    for batch in batches:
        hosts, nodes, found, alone = [], [], [], []
        for host, tree, seed, numbers, hashes, lone in zip(*(batch.column(c).to_pylist() for c in (
                "host", "tree", "seed", "numbers", "hashes", "lone"))):
            match = _align(tree, seed)
            rows = [(match[n], h, x) for n, h, x in zip(numbers, hashes, lone) if n in match]
            rows += [(n, 0, False) for n in {n for n, _, _ in rows}]
            hosts.extend([host] * len(rows))
            nodes.extend(r[0] for r in rows)
            found.extend(r[1] for r in rows)
            alone.extend(r[2] for r in rows)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int32()),
                                          pa.array(found, pa.int64()), pa.array(alone, pa.bool_())],
                                         names=["host", "node", "hash", "lone"])


def _bytes(hosts: DataFrame, more: Column) -> int:
    """About how much memory a table of hosts takes."""
    return hosts.agg(F.sum(F.lit(64) + F.coalesce(F.length("host"), F.lit(0)) + F.greatest(more, F.lit(0)))).first()[0] or 0


def induce(pages: DataFrame) -> DataFrame:
    """(host, seed, template, repeated): a wrapper for each host of ``pages`` (host, html). Nodes of
    ``template`` are constant where they stand alone; ``repeated`` has (node, hash) of constant texts."""
    shapes = materialize(pages.mapInArrow(
        _shapes, "host string, tree string, numbers array<int>, hashes array<long>, lone array<boolean>, whole long"), "wrapper-shapes")
    seeds = materialize(shapes.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(
        F.max_by("tree", F.struct("n", "tree")).alias("seed")), "wrapper-seeds")
    small = _bytes(seeds, F.length("seed")) <= BROADCAST_BYTES
    distinct = shapes.groupBy("host", "whole", "tree").agg(F.first("numbers").alias("numbers"),
                                                            F.first("hashes").alias("hashes"),
                                                            F.first("lone").alias("lone"))
    met = distinct.join(F.broadcast(seeds) if small else seeds, "host").select(
        "host", "tree", "seed", "numbers", "hashes", "lone").mapInArrow(
        _meetings, "host string, node int, hash long, lone boolean")
    nodes = materialize(met.groupBy("host", "node", "hash").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("lone").alias("alone")), "wrapper-nodes")
    pages_of = nodes.groupBy("host", "node").agg(
        F.sum("alone").alias("total"), F.max("alone").alias("top"), F.max(F.when(F.col("hash") == 0, F.col("n"))).alias("pages"))
    constant = pages_of.filter((F.col("total") >= LEAST_PAGES) & (F.col("top") >= TEMPLATE_SHARE * F.col("total")))
    template = constant.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("template"))
    # A text on fewer pages than this can't be on nearly all of LEAST_PAGES: the many rare ones are not dealt by node.
    common = nodes.filter((F.col("hash") != 0) & (F.col("n") >= TEMPLATE_SHARE * LEAST_PAGES))
    repeated = common.join(pages_of.filter(F.col("pages") >= LEAST_PAGES), ["host", "node"]).filter(
        F.col("n") >= TEMPLATE_SHARE * F.col("pages")).groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("repeated"))
    return materialize(seeds.join(template, "host", "left").join(repeated, "host", "left"), "wrappers")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts_out = []
        for page, seed, template, repeated in zip(batch.column("__html"), *(batch.column(c).to_pylist() for c in (
                "seed", "template", "repeated"))):
            root = parse(page.as_py() or "")
            drop: frozenset[int] = frozenset()
            same: dict[int, frozenset[int]] = {}
            if template or repeated:
                tree, _ = shape(root)
                fixed, texts = set(template or ()), {}
                for r in repeated or ():
                    texts.setdefault(r["node"], set()).add(r["hash"])
                match = _align(json.dumps(tree, separators=(",", ":")), seed)
                # Of a run only the repeated texts go; headings have no text counted.
                starred, headings = _starred(tree)
                drop = frozenset(n for n, s in match.items() if s in fixed and n not in starred and n not in headings)
                same = {n: frozenset(texts[s]) for n, s in match.items() if s in texts and n not in headings}
            texts_out.append(article_text(root, drop, same))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("__id", "__url")), pa.array(texts_out, pa.string())],
            names=["__id", "__url", "text"])


def _starred(tree: list) -> tuple[set[int], set[int]]:
    """Numbers of nodes that are, or lie inside, a run; and those of headings."""
    out: set[int] = set()
    headings: set[int] = set()
    counter = [0]

    def walk(node: list, inside: bool) -> None:
        inside = inside or bool(node[1])
        if inside:
            out.add(counter[0])
        if node[0].split(".")[0] in HEADINGS:
            headings.add(counter[0])
        counter[0] += 1
        for child in node[2]:
            walk(child, inside)
    walk(tree, False)
    return out, headings


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every page."""
    host, _ = host_and_path(F.col(url_col).cast("string"))
    slim = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), host.alias("host"),
                        F.col(html_col).cast("string").alias("__html"))
    wrappers = induce(slim.select("host", F.col("__html").alias("html")))
    small = _bytes(wrappers, F.length("seed") + 4 * F.coalesce(F.size("template"), F.lit(0)) + 24 * F.coalesce(
        F.size("repeated"), F.lit(0))) <= BROADCAST_BYTES
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    found = slim.join(F.broadcast(wrappers) if small else wrappers, "host", "left").select(
        "__id", "__url", "__html", "seed", "template", "repeated").mapInArrow(
        _extract, f"__id {kinds['__id']}, __url {kinds['__url']}, text string")
    return found.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), "text",
                        F.length("text").cast("long").alias("n_chars"))
