"""Main text of web pages by wrapper induction.

A page becomes a tree of block elements, in which runs of equal siblings are one node. Each host has up to LAYOUTS
reference trees, those of its most frequent layouts; every page of the host is aligned by simple tree matching with the
reference that it matches best. Over all pages, the texts that stand in each slot (reference node) are counted: a text
that nearly all pages with the slot have is constant and becomes template, other texts of the slot are content. Pages
count once for each different article, so copies tell nothing. Template goes wherever it stands, inside marked
articles too, unless it is most of the article: then the page is a near copy, and it is its text.

Slots that vary hold content, but also menus, adverts or comments that differ from page to page, which no alignment can
tell from an article. There the page's own marks decide: boilerplate elements (nav, aside, form, ...), class, id and role
names that say nothing but boilerplate, and a marked article, outside which nothing counts. A class name never drops
the article itself or an element around it.

Reference trees are small (labels, no texts) and reach the host by a partial aggregation; learning sums counts by host,
reference, slot and text. References and templates are broadcast only when their measured size is below
BROADCAST_BYTES, and joined by host beyond it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, only, ship

#: A block is template if this share of the pages with its slot, LEAST_PAGES others at least, has its text there.
CONSTANT, LEAST_PAGES = 0.9, 3
#: Reference trees of a host. Pages of further layouts are aligned with the reference that they match best.
LAYOUTS = 8
BROADCAST_BYTES = 32_000_000
#: Blocks nested deeper belong to the node at this level of the tree; their texts stay blocks of their own.
DEPTH = 100
#: Siblings left between equal ends are aligned if their numbers multiply to this at most; otherwise they stay varying.
CELLS = 250_000
#: Open elements that an end tag, or an implied one, looks back over.
BACK = 1_000

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head nav footer aside form menu dialog select button svg canvas object audio video map search".split())
ARTICLE = frozenset(["article", "main"])
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody"),
}
BARRIER = frozenset("ul ol dl table menu select body html article section main div".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar rail footer foot copyright legal cookie cookies consent gdpr notice notices popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendation "
    "recommendations comment comments commentlist disqus reply replies respond pagination pager widget toolbar search masthead "
    "skip tags outbrain taboola disclaimer contentinfo complementary alert navigation hidden".split()
)
#: Words that say nothing against boilerplate in a name beside it.
NEUTRAL = frozenset(
    "a an the my site page main global primary secondary top bottom left right header body inner outer box list item items area "
    "block section container wrapper wrap holder slot unit zone bar panel col column row group content links link posts post "
    "articles article story entry user reader blog web site mobile desktop small large big first last sm md lg xl js ui c l m "
    "btn button icon text title form field image img media news".split()
)
#: Dropped outside an article only, and not where the class says that it is an article's own.
HEADERS = frozenset(["header", "head", "banner", "masthead", "topbar", "logo"])
OWN_HEADER = frozenset(["article", "post", "entry", "story", "content"])

#: A tag, by the rule that quotes count after an equals sign; possessive, so that a tag without end costs one pass.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
#: A tag whose last quote is never closed ends at the next >.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """A block element: hard tells that its element is boilerplate or hidden, soft that its names are boilerplate (1) or
    a header's (2), mark that it is an article."""

    __slots__ = ("label", "up", "depth", "kids", "hard", "soft", "mark", "within")

    def __init__(self, label: str, up: Node | None, hard: bool = False, soft: int = 0, mark: bool = False):
        self.label, self.up, self.kids = label, up, []
        self.depth = up.depth + 1 if up else 0
        self.hard, self.soft, self.mark = hard, soft, mark
        self.within = mark or up is not None and up.within


def _names(raw: str) -> tuple[list[list[str]], bool, str]:
    """The names in class, id, role and itemprop, each as its words; whether the element is hidden; the class."""
    own = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)}
    named = [n for k in ("class", "id", "role", "itemprop") for n in own.get(k, "").split()]
    hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
    return [[w.lower() for w in SPLIT.split(n) if w] for n in named], hidden, own.get("class", "")


def _says(names: list[list[str]], words: frozenset[str]) -> bool:
    """Whether one of the names consists of such words, one at least, and neutral words or numbers."""
    return any(any(w in words for w in n) and all(w in words or w in NEUTRAL or w.isdigit() for w in n) for n in names)


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The block elements in page order, the root first, and the blocks in page order: (node, text).

    A tag that is cut off at the end of the page is dropped. A stray < is text. Elements may be left open. Text of inline
    boilerplate, raw elements and comments is in no block.
    """
    root = Node("#", None)
    nodes, blocks, held = [root], [], []
    stack: list[tuple[str, Node, bool]] = [("#", root, False)]  # tag, node, inline boilerplate
    opened: Counter[str] = Counter()
    tag_at = TAG

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((stack[-1][1], text))

    def pop(depth: int) -> None:
        for tag, _, _ in stack[depth:]:
            opened[tag] -= 1
        del stack[depth:]

    def push(tag: str, attributes: str) -> None:
        _, up, quiet = stack[-1]
        names, hidden, kind = _names(attributes) if attributes.strip(" /\t\r\n") else ([], False, "")
        words = {w for n in names for w in n}
        mark = tag in ARTICLE or "articlebody" in words or tag == "div" and ["main"] in names
        soft = 1 if _says(names, BOILERPLATE) else 2 if not words & OWN_HEADER and (tag == "header" or _says(names, HEADERS)) else 0
        if tag in BLOCK:
            hard = tag in DROPPED or hidden
            node = Node(f"{tag}.{kind}" if kind else tag, up, hard, 0 if tag in ("body", "html") else soft, mark)
            nodes.append(node)
            up = node
        elif (tag in DROPPED or hidden or soft == 1 or soft == 2 and not up.within) and not quiet:
            if held:
                held.append(" ")  # inline boilerplate splits words, but stays in the block of text around it
            quiet = True
        stack.append((tag, up, quiet))
        opened[tag] += 1

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        rest = html[at : lt if lt >= 0 else n]
        if rest and not stack[-1][2]:
            held.append(rest)
        if lt < 0:
            break
        after = html[lt + 1 : lt + 3]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if after[:1] in ("!", "?"):
            at = html.find(">", lt) + 1 or n
            continue
        if not (after[:1].isascii() and after[:1].isalpha() or after[:1] == "/" and after[1:].isascii() and after[1:].isalpha()):
            if not stack[-1][2]:
                held.append("<")
            at = lt + 1
            continue
        m = tag_at.match(html, lt)
        if m is None and tag_at is TAG:
            tag_at = PLAIN_TAG  # a quote stays open to the end of the page: from here on, quotes don't count
            m = tag_at.match(html, lt)
        if m is None:
            break
        at, closing, tag = m.end(), m[1], m[2].lower()
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = n if end is None else (html.find(">", end.end()) + 1 or n)
            held.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "input"):
                held.append(" ")
        elif closing:
            if tag in BLOCK:
                flush()
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if tag not in BLOCK and (stack[k][0] in BLOCK or len(stack) - k > BACK):
                        break
        else:
            if tag in BLOCK:
                flush()
                over = CLOSED_BY.get(tag, ())
                for k in range(len(stack) - 1, max(0, len(stack) - BACK), -1):
                    if not opened["p"] and not any(opened[t] for t in over):
                        break
                    open_ = stack[k][0]
                    if open_ == "p" or open_ in over:
                        pop(k)
                    elif open_ in BARRIER:
                        break
            push(tag, m[3])
    flush()
    return nodes, blocks


def counting(nodes: list[Node], blocks: list[tuple[Node, str]], safe: frozenset[int] = frozenset()) -> tuple[list[bool], list[bool]]:
    """Whether the page's own marks keep each block, and whether it is inside an article.

    Names of nodes in safe don't count. Where names would leave nothing of a page that marks an article, the largest
    article and the elements around it are safe.
    """
    hard, dropped, inside = {}, {}, {}
    for node in nodes:  # parents come first
        up = id(node.up)
        hard[id(node)] = node.hard or hard.get(up, False)
        around = inside.get(up)
        named = node.soft == 1 or node.soft == 2 and not around
        dropped[id(node)] = node.hard or dropped.get(up, False) or named and id(node) not in safe
        inside[id(node)] = around or node.mark and not dropped[id(node)]
    within = [bool(inside[id(node)]) and not dropped[id(node)] for node, _ in blocks]
    marked = any(within)
    keep = [not dropped[id(node)] and (w or not marked) for (node, _), w in zip(blocks, within)]
    if not safe and not any(keep):
        outer, sizes = {}, Counter()
        for node in nodes:
            outer[id(node)] = outer.get(id(node.up)) or (node if node.mark and not hard[id(node)] else None)
        for node, text in blocks:
            if outer[id(node)] is not None and not hard[id(node)]:
                sizes[outer[id(node)]] += len(text)
        if sizes:
            article, path = max(sizes, key=lambda x: sizes[x]), set()
            while article is not None:
                path.add(id(article))
                article = article.up
            return counting(nodes, blocks, frozenset(path))
    return keep, within


class Tree:
    """A tree of labels in which runs of siblings of one shape are one node. Nodes count in page order; kids by node."""

    def __init__(self, nodes: list[Node]):
        home = {}  # nodes below DEPTH are part of their ancestor there
        kids: dict[int, list[int]] = {}
        for k, x in enumerate(nodes):
            home[id(x)] = k if x.depth <= DEPTH else home[id(x.up)]
            if 0 < x.depth <= DEPTH:
                kids.setdefault(home[id(x.up)], []).append(k)
        shape = [0] * len(nodes)
        same: dict[int, int] = {}  # a node of a run, and the run's first
        heads: dict[int, list[int]] = {}
        for k in range(len(nodes) - 1, -1, -1):
            if nodes[k].depth > DEPTH:
                continue
            own: list[int] = []
            for kid in kids.get(k, ()):
                if own and shape[own[-1]] == shape[kid]:
                    todo = [(own[-1], kid)]
                    while todo:
                        a, b = todo.pop()
                        same[b] = a
                        todo.extend(zip(heads.get(a, ()), heads.get(b, ())))
                else:
                    own.append(kid)
            heads[k] = own
            shape[k] = xxhash.xxh64_intdigest(f"{nodes[k].label}({','.join(str(shape[x]) for x in own)})".encode("utf-8", "surrogatepass"))
        order, todo, number = [], [0], {}
        while todo:
            k = todo.pop()
            number[k] = len(order)
            order.append(k)
            todo.extend(reversed(heads[k]))
        self.labels = [nodes[k].label for k in order]
        self.shapes = [shape[k] for k in order]
        self.kids = [[number[x] for x in heads[k]] for k in order]

        def head(k: int) -> int:
            while k in same:
                k = same[k]
            return number[k]

        self.of = {i: head(k) for i, k in home.items()}


class Reference:
    """A packed tree: "label" and number of kids by node, in page order."""

    def __init__(self, labels: list[str], sizes: list[int]):
        self.labels, self.kids = labels, [[] for _ in labels]
        stack: list[tuple[int, int]] = []
        for k, n in enumerate(sizes):
            while stack and len(self.kids[stack[-1][0]]) == stack[-1][1]:
                stack.pop()
            if stack:
                self.kids[stack[-1][0]].append(k)
            stack.append((k, n))
        self.shapes = [0] * len(labels)
        for k in range(len(labels) - 1, -1, -1):
            shape = f"{labels[k]}({','.join(str(self.shapes[x]) for x in self.kids[k])})"
            self.shapes[k] = xxhash.xxh64_intdigest(shape.encode("utf-8", "surrogatepass"))


class Matching:
    """Simple tree matching of two trees: the largest set of pairs that keeps labels, parents and the order of siblings.

    A node and a node of equal label match; the pairs of their kids come from a dynamic program over both sequences.
    Equal subtrees at both ends are paired at once, which loses nothing: a subtree can't do better than with its equal.
    """

    def __init__(self, a: Tree, b: Reference):
        self.a, self.b = a, b
        self.known: dict[tuple[int, int], int] = {}
        self.size_a = self._sizes(a.kids)

    @staticmethod
    def _sizes(kids: list[list[int]]) -> list[int]:
        sizes = [1] * len(kids)
        for k in range(len(kids) - 1, -1, -1):
            sizes[k] += sum(sizes[x] for x in kids[k])
        return sizes

    def score(self, x: int, y: int) -> int:
        """Pairs in the largest match of the subtrees; at most DEPTH levels deep."""
        a, b = self.a, self.b
        if a.labels[x] != b.labels[y]:
            return 0
        key = (a.shapes[x], b.shapes[y])
        if key[0] == key[1]:
            return self.size_a[x]
        if key not in self.known:
            front, back, table = self._program(a.kids[x], b.kids[y])
            ends = sum(self.size_a[k] for k in a.kids[x][:front]) + sum(self.size_a[k] for k in a.kids[x][len(a.kids[x]) - back :])
            self.known[key] = 1 + ends + (table[-1][-1] if table else 0)
        return self.known[key]

    def _program(self, xs: list[int], ys: list[int]) -> tuple[int, int, list[list[int]]]:
        """Equal subtrees at the front and at the back, and the table of best scores over the kids between."""
        sa, sb = self.a.shapes, self.b.shapes
        least, front, back = min(len(xs), len(ys)), 0, 0
        while front < least and sa[xs[front]] == sb[ys[front]]:
            front += 1
        while back < least - front and sa[xs[-1 - back]] == sb[ys[-1 - back]]:
            back += 1
        xs, ys = xs[front : len(xs) - back], ys[front : len(ys) - back]
        if not xs or not ys or len(xs) * len(ys) > CELLS:
            return front, back, []
        table = [[0] * (len(ys) + 1)]
        for x in xs:
            row, above = [0], table[-1]
            for k, y in enumerate(ys):
                best = above[k + 1] if above[k + 1] > row[k] else row[k]
                if (pair := self.score(x, y)) and above[k] + pair > best:
                    best = above[k] + pair
                row.append(best)
            table.append(row)
        return front, back, table

    def pairs(self) -> dict[int, int]:
        """The reference's node for each node of the tree that has one."""
        out: dict[int, int] = {}
        todo = [(0, 0)] if self.a.labels[0] == self.b.labels[0] else []
        while todo:
            x, y = todo.pop()
            out[x] = y
            xs, ys = self.a.kids[x], self.b.kids[y]
            front, back, table = self._program(xs, ys)
            todo.extend(zip(xs[:front], ys[:front]))
            todo.extend(zip(xs[len(xs) - back :], ys[len(ys) - back :]))
            i, j = len(table) - 1, len(table[-1]) - 1 if table else 0
            while table and i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((xs[front + i], ys[front + j]))
        return out


def aligned(tree: Tree, references: list[Reference]) -> tuple[int, dict[int, int]]:
    """The reference that the tree matches best (the first of equals), and the pairs with it; -1 without references."""
    best, at = 0.0, -1
    for k, r in enumerate(references):
        if r.shapes[0] == tree.shapes[0]:
            return k, Matching(tree, r).pairs()
    matches = [Matching(tree, r) for r in references]
    for k, m in enumerate(matches):
        share = m.score(0, 0) / (len(tree.labels) + len(references[k].labels))
        if share > best:
            best, at = share, k
    return at, matches[at].pairs() if at >= 0 else {}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def slots(nodes: list[Node], blocks: list[tuple[Node, str]], references: list[Reference]) -> list[tuple[int, int] | None]:
    """For each block its slot (reference and node) and the hash of slot and text, as signed 64-bit numbers; None
    where the alignment has no slot for it."""
    if not references:
        return [None] * len(blocks)
    tree = Tree(nodes)
    which, pairs = aligned(tree, references)
    out: list[tuple[int, int] | None] = []
    for node, text in blocks:
        to = pairs.get(tree.of[id(node)])
        slot = None if to is None else which << 32 | to
        out.append(None if slot is None else (slot, _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), slot))))
    return out


def page_text(html: str, references: list[Reference] = (), constant: frozenset[int] = frozenset(), marks: bool = True) -> str:
    """The page's main text. marks=False leaves all but the alignment out, to see what it does by itself."""
    nodes, blocks = parse(html)
    keep, inside = counting(nodes, blocks) if marks else ([True] * len(blocks), [False] * len(blocks))
    kept = [k for k, ok in enumerate(keep) if ok]
    if constant:
        template = {k for k, s in enumerate(slots(nodes, blocks, references)) if s and s[1] in constant}
        article = [k for k in kept if inside[k]]
        if 2 * sum(len(blocks[k][1]) for k in article if k in template) > sum(len(blocks[k][1]) for k in article):
            template.difference_update(article)  # a near copy of other pages
        kept = [k for k in kept if k not in template]
    return "\n".join(blocks[k][1] for k in kept)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _with(pages: DataFrame, small: DataFrame, size: Column) -> DataFrame:
    """pages with the host's row of small, broadcast behind a check of its size."""
    size = small.agg(F.sum(size)).first()[0] or 0
    return pages.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, "host", "left")


def _references(column: list | None) -> list[Reference]:
    return [Reference(r["labels"], r["sizes"]) for r in column or ()]


def layouts(pages: DataFrame) -> DataFrame:
    """(host, layouts): the trees of the host's most frequent layouts, ties by hash. Only trees are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found: dict[tuple[str, int], list] = {}
            for host, html in zip(_strings(batch.column(0)), _strings(batch.column(1))):
                nodes, blocks = parse(html)
                if blocks:
                    tree = Tree(nodes)
                    found.setdefault((host, _signed(tree.shapes[0])), [0, tree])[0] += 1
            rows = [(h, s, n, t.labels, [len(k) for k in t.kids]) for (h, s), (n, t) in found.items()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["host", "shape", "n", "labels", "sizes"])

    read = pages.where("host <> ''").select("host", "html").mapInArrow(run, "host string, shape long, n long, labels array<string>, sizes array<int>")
    counts = cut(read.groupBy("host", "shape").agg(F.sum("n").alias("n"), F.min(F.struct("labels", "sizes")).alias("tree")))
    found = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "shape", "tree")))
    return cut(_most(counts).groupBy("host").agg(found.alias("l")).select("host", F.transform("l", lambda x: x["tree"]).alias("layouts")))


def _most(counts: DataFrame) -> DataFrame:
    """The LAYOUTS rows of each host with the largest n, then the least shape. Spark's limit on a rank keeps only so
    many rows of a host in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "shape"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= LAYOUTS).drop("rank")


def templates(pages: DataFrame) -> DataFrame:
    """pages(host, html, layouts) -> (host, constant array<long>): the keys of the host's template blocks, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Reference]] = {}
        for batch in _sliced(batches):
            rows = []
            for host, html, trees in zip(_strings(batch.column(0)), _strings(batch.column(1)), batch.column(2)):
                if host not in held:
                    if len(held) > 1_000:
                        held.clear()
                    held[host] = _references(trees.as_py())
                nodes, blocks = parse(html)
                told = sorted({s for s in slots(nodes, blocks, held[host]) if s})
                if told:
                    keep, _ = counting(nodes, blocks)
                    text = "\n".join(t for (_, t), k in zip(blocks, keep) if k)
                    rows.append((host, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1, [x for x, _ in told], [x for _, x in told]))
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["host", "article", "slots", "keys"])

    read = pages.where("layouts is not null").select("host", "html", "layouts").mapInArrow(run, "host string, article long, slots array<long>, keys array<long>")
    once = cut(read.groupBy("host", "article").agg(F.min(F.struct("slots", "keys")).alias("b")).select("host", "b.*"))
    least = LEAST_PAGES + 1
    have = once.select("host", F.explode(F.array_distinct("slots")).alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("n"))
    blocks = once.select("host", F.explode(F.arrays_zip("slots", "keys")).alias("b")).select("host", F.col("b.slots").alias("slot"), F.col("b.keys").alias("key"))
    same = blocks.groupBy("host", "slot", "key").agg(F.count("*").alias("same")).where(F.col("same") >= math.ceil(CONSTANT * least))
    constant = same.join(have.where(F.col("n") >= least), ["host", "slot"]).where(F.col("same") >= CONSTANT * F.col("n"))
    return cut(constant.groupBy("host").agg(F.array_sort(F.collect_set("key")).alias("constant")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", marks: bool = True) -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of pages.

    Blocks are joined in page order by newlines, white space inside a block is folded, character references decoded.
    A null or empty html gives an empty text. A page whose url is null or has no host has no wrapper, only the rules.
    Repeated rows stay rows. An empty table gives none. Texts nested at any depth are kept.
    """
    ship(pages.sparkSession)
    own = only(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").withColumn("host", host_of(F.col("url").cast("string")))
    trees = layouts(own.select("host", "html"))
    weight = F.expr("100 + aggregate(layouts, 0L, (n, t) -> n + 32 * size(t.labels))")
    learned = templates(_with(own.select("host", "html"), trees, weight))
    # both tables have a row a host; hosts without a template need no alignment
    wrappers = cut(learned.join(trees, "host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[Reference], frozenset[int]]] = {}
        for batch in _sliced(batches):
            texts = []
            for host, html, trees, constant in zip(_strings(batch.column(3)), _strings(batch.column(2)), batch.column(5), batch.column(4)):
                if host not in held:
                    if len(held) > 1_000:
                        held.clear()
                    held[host] = _references(trees.as_py()), frozenset(constant.as_py() or ())
                texts.append(page_text(html, *held[host], marks))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    joined = _with(own, wrappers, weight + 8 * F.size("constant")).select("page_id", "url", "html", "host", "constant", "layouts")
    out = joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
    return out.toDF(id_col, url_col, "text", "n_chars")
