"""Main text of web pages by wrapper induction.

One wrapper is induced for each host, from all its pages: its tree is the page with the most tags, to which every other page is
aligned by simple tree matching, the largest set of node pairs with equal tags that keeps parents and order. Aligned texts that are the
same on all pages that have them are template, the others are slots. Every page is then aligned with its host's wrapper alone, so that its text does not depend
on how pages are dealt. The content region is the outermost article (or main) elements with a slot inside, else the slot container with the
most varying text outside links. Parts of the region whose tag, role or class says navigation, advert and so on are dropped, and so are its
template blocks before the first and after the last block with a slot, and those between that are links only: fixed headings between
slots stay. A block is template if its texts all are, or if it stands on every page of the host with text. Only three pages or more that differ say
what is template in a region; copies and near copies of one page (half of all word triples in common) speak as one, else a page that is
there three times would be template as a whole: the wrapper's own page, the page of smallest hash that differs from it, and any page that differs
from both. A block with a slot stays whole, its fixed words too; a region without any slot too.

Two passes collect this evidence, a third takes the texts. Each task sums up its hosts by place of the wrapper's tree and by line, Spark adds the sums.
What a host's tasks are told is shipped to all of them up to ``SHIPPED`` characters, else joined with the pages in parts of about ``PART``.

The table of two lists of children is exact up to ``CELLS`` cells. Longer lists, of very long pages, are cut at subtrees of equal shape that occur once
in both, and what is longer still in proportion, so that cost grows with a page and not with its square.

Null html, empty html and pages without a region give the empty string. A page alone on its host has no template.
Rows are kept one for one, also repeated ones; pages without a host share one wrapper; other columns are not read.
"""

from __future__ import annotations

import bisect
import html as entities
import json
import re
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimlark.llm import frames, text as text_tools

HOSTS = 1_000_000  # most hosts whose numbers of parts are broadcast
KEYS = 200_000  # most keys of pages that are broadcast to fetch them
SHIPPED = 16_000_000  # most characters that are shipped to every task
PART = 256  # about so many pages of a host meet one copy of what it is told, where that is joined
CELLS = 10_000  # largest table of two lists of children
HELD = 1_000_000  # about so many characters of pages are kept as trees by a task
WHOLE = -1  # the place that every page with text meets

#: Element kinds of HTML, and the names that mark parts other than the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object select button".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var "
                   "wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
                     "nav ol p pre section table ul".split())
DROPPED_TAGS = frozenset("nav header footer aside form dialog menu head".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement sponsored sponsor promo banner cookie cookies consent notice notices popup modal "
                          "nav navbar navigation menu menubar breadcrumb breadcrumbs header footer sidebar aside widget related share sharing social "
                          "comment comments respond replies disqus newsletter subscribe signup pagination pager".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)>|<[a-zA-Z/!?][^<>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z0-9]+")


class Node:
    """An element, or with tag ``#`` a piece of text; ``shape`` is a hash of the tags below it, ``linked`` whether a link holds it."""

    __slots__ = ("tag", "text", "children", "dropped", "size", "shape", "linked")

    def __init__(self, tag: str, text: str = "", dropped: bool = False):
        self.tag, self.text, self.children, self.dropped, self.size, self.shape, self.linked = tag, text, [], dropped, 1, 0, False


def _marked(tag: str, attributes: str) -> bool:
    if tag in DROPPED_TAGS:
        return True
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            if value in DROPPED_ROLES:
                return True
        elif any(DROPPED_NAMES & set(_NAME.findall(word)) for word in value.split()):
            return True
    return False


def parsed(page: str | None) -> Node:
    """Tree of a page; unclosed and crossed elements are closed where their parents end, cut tags at the end are dropped."""
    root = Node("root")
    page, at, stack = page or "", 0, [root]

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(Node("#", entities.unescape(piece)))

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P or tag == "li":
            ends = "li" if tag == "li" else "p"
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == ends:
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        node = Node(tag, dropped=_marked(tag, m[3]))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    _sizes(root)
    return root


def _sizes(root: Node) -> None:
    order = [root]
    for node in order:
        for c in node.children:
            c.linked = node.linked or node.tag == "a"
        order += node.children
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in node.children)
        node.shape = hash((node.tag, *(c.shape for c in node.children)))


def _trimmed(xs: list[Node], ys: list[Node]) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
    """Pairs of equal shape at both ends, which some largest alignment holds, and what lies between."""
    most, head, tail = min(len(xs), len(ys)), 0, 0
    while head < most and xs[head].shape == ys[head].shape:
        head += 1
    while tail < most - head and xs[-1 - tail].shape == ys[-1 - tail].shape:
        tail += 1
    ends = [*zip(xs[:head], ys[:head], strict=True), *zip(xs[len(xs) - tail :], ys[len(ys) - tail :], strict=True)]
    return ends, xs[head : len(xs) - tail], ys[head : len(ys) - tail]


def _anchors(xs: list[Node], ys: list[Node]) -> list[tuple[int, int]]:
    """Places of subtrees whose shape occurs once in both lists: the longest run of them that ascends in both."""
    often = Counter(x.shape for x in xs), Counter(y.shape for y in ys)
    place = {y.shape: j for j, y in enumerate(ys) if often[1][y.shape] == 1}
    met = [(i, place[x.shape]) for i, x in enumerate(xs) if often[0][x.shape] == 1 and x.shape in place]
    tops: list[int] = []
    last: list[int] = []
    before = []
    for k, (_, j) in enumerate(met):
        at = bisect.bisect_left(tops, j)
        before.append(last[at - 1] if at else -1)
        tops[at : at + 1], last[at : at + 1] = [j], [k]
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(met[k])
        k = before[k]
    return chain[::-1]


def _tables(xs: list[Node], ys: list[Node]) -> tuple[list[tuple[Node, Node]], list[tuple[list[Node], list[Node]]]]:
    """Pairs of children of equal shape that are settled, and the pieces that need a table of at most ``CELLS``."""
    pairs, xs, ys = _trimmed(xs, ys)
    if len(xs) * len(ys) <= CELLS:
        return pairs, [(xs, ys)] if xs and ys else []
    tables, i, j = [], 0, 0
    for m, n in [*_anchors(xs, ys), (len(xs), len(ys))]:
        ends, p, q = _trimmed(xs[i:m], ys[j:n])
        pairs += ends
        parts = -(-max(len(p), len(q)) // int(CELLS**0.5)) if len(p) * len(q) > CELLS else 1
        for k in range(parts):
            cut = [z[k * len(z) // parts : (k + 1) * len(z) // parts] for z in (p, q)]
            if cut[0] and cut[1]:
                tables.append((cut[0], cut[1]))
        if m < len(xs):
            pairs.append((xs[m], ys[n]))
        i, j = m + 1, n + 1
    return pairs, tables


class Matching:
    """Largest alignment of two trees; sizes of inner alignments are kept, none is taken twice."""

    def __init__(self) -> None:
        self.sizes: dict[tuple[int, int], int] = {}

    def size(self, x: Node, y: Node) -> int | None:
        """Pairs of the largest alignment with x on y, None if not known yet."""
        if x.tag != y.tag:
            return 0
        if x.shape == y.shape:
            return x.size
        if not x.children or not y.children:
            return 1
        return self.sizes.get((id(x), id(y)))

    def rows(self, xs: list[Node], ys: list[Node]) -> list[list[int]]:
        """Table of the largest alignments of all beginnings of two lists."""
        table = [[0] * (len(ys) + 1)]
        for p in xs:
            row, above = [0], table[-1]
            for j, q in enumerate(ys):
                row.append(max(above[j] + self.size(p, q), above[j + 1], row[-1]))
            table.append(row)
        return table

    def fill(self, a: Node, b: Node) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self.size(x, y) is not None:
                todo.pop()
                continue
            pairs, tables = _tables(x.children, y.children)
            needed = [(p, q) for xs, ys in tables for p in xs for q in ys if self.size(p, q) is None]
            if needed:
                todo += needed
                continue
            self.sizes[id(x), id(y)] = 1 + sum(p.size for p, _ in pairs) + sum(self.rows(xs, ys)[-1][-1] for xs, ys in tables)
            todo.pop()

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        out, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            out.append((x, y))
            if x.shape == y.shape:
                todo += zip(x.children, y.children, strict=True)
                continue
            pairs, tables = _tables(x.children, y.children)
            todo += pairs
            for xs, ys in tables:
                rows, i, j = self.rows(xs, ys), len(xs), len(ys)
                while i and j:
                    if rows[i][j] == rows[i - 1][j]:
                        i -= 1
                    elif rows[i][j] == rows[i][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        todo.append((xs[i], ys[j]))
        return out


def matched(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of the largest alignment of two trees (simple tree matching), roots included; none if the roots' tags differ."""
    if a.tag != b.tag:
        return []
    found = Matching()
    found.fill(a, b)
    return found.pairs(a, b)


def texts_of(root: Node) -> list[Node]:
    """Pieces of text in page order."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag == "#":
            out.append(x)
        todo += reversed(x.children)
    return out


def triples(tree: Node) -> set[tuple[str, ...]]:
    """Word triples of a page, of a page with fewer words these; none without text."""
    words = " ".join(line for line, *_ in blocks(tree)).split()
    return set(zip(words, words[1:], words[2:], strict=False)) or ({tuple(words)} if words else set())


def near(a: set, b: set) -> bool:
    """Whether two pages are near copies: a Jaccard similarity of a half."""
    small, large = sorted((len(a), len(b)))
    return 2 * small >= large and 3 * len(a & b) >= small + large


def _varying(node: Node, template: set[int], link: bool = False) -> int:
    """Characters of slots below a node, links taken off."""
    total, todo = 0, [(node, link)]
    while todo:
        x, inside = todo.pop()
        if x.dropped:
            continue
        if x.tag == "#":
            if id(x) not in template:
                total += -len(x.text) if inside else len(x.text)
        else:
            todo += [(c, inside or x.tag == "a") for c in x.children]
    return total


def _slotted(node: Node, fixed: set[int]) -> bool:
    """Whether a text below a node is no template."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag == "#" and x.text.strip() and id(x) not in fixed:
            return True
        todo += [c for c in x.children if not c.dropped]
    return False


def outermost(root: Node, wanted: str) -> list[Node]:
    """Elements of a tag that no other of them holds, in page order."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.dropped:
            continue
        if x.tag == wanted:
            found.append(x)
        else:
            todo += reversed(x.children)
    return found


def regions(root: Node, template: set[int], fixed: set[int]) -> list[Node]:
    """Outermost article elements with a slot, else such main elements, else the deepest container with nearly all varying text."""
    if not _slotted(root, fixed):
        fixed = set()
    for wanted in ("article", "main"):
        found = outermost(root, wanted)
        slots = [x for x in found if _slotted(x, fixed)]
        if slots or found and not fixed:
            return slots or found
    best = root
    whole = _varying(root, template)
    if whole <= 0:
        template, whole = set(), _varying(root, set())
    while True:
        inner = [c for c in best.children if c.tag != "#" and c.tag not in INLINE and c.tag != "p" and not c.dropped]
        top = max(inner, key=lambda c: _varying(c, template), default=None)
        if top is None or not top.children or _varying(top, template) < 0.8 * whole:
            return [best]
        best = top


def blocks(region: Node) -> list[tuple[str, list[int], bool]]:
    """Blocks of a region in page order, each with the identities of its texts and whether links hold them all; white space inside a block
    is one space."""
    out: list[tuple[str, list[int], bool]] = []
    now: list[str] = []
    nodes: list[int] = []
    free: list[int] = []

    def flush() -> None:
        line = " ".join("".join(now).split())
        if line:
            out.append((line, nodes.copy(), not free))
        now.clear()
        nodes.clear()
        free.clear()

    todo: list[Node | None] = [region]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif x.dropped and x is not region:
            flush()
        elif x.tag == "#":
            now.append(x.text)
            if x.text.strip():
                nodes.append(id(x))
                free.extend([] if x.linked else [id(x)])
        elif x.tag in ("br", "wbr"):
            now.append(" " if x.tag == "br" else "")
        elif x.tag in INLINE:
            todo += reversed(x.children)
        else:
            flush()
            todo.append(None)
            todo += reversed(x.children)
    flush()
    return out


class Wrapper:
    """A host's tree, which of its texts are template (on two pages or more, and on three that differ), and lines of every page."""

    def __init__(self, page: str | None, template: list[int], fixed: list[int], common: list[str]):
        self.page, self.root = page, parsed(page)
        texts = texts_of(self.root)
        self.places = template, fixed
        self.template, self.fixed = ({id(texts[k]) for k in places} for places in self.places)
        self.common = set(common)

    def marks(self, tree: Node) -> tuple[set[int], set[int]]:
        """Texts of a page that are template by both measures."""
        template, fixed = set(), set()
        if self.template:
            for x, y in matched(self.root, tree):
                if id(x) in self.template and x.text == y.text:
                    template.add(id(y))
                    if id(x) in self.fixed:
                        fixed.add(id(y))
        return template, fixed

    def lines(self, tree: Node) -> list[tuple[str, list[int], bool]]:
        """Blocks of the page's region with the identities of their texts that are no template."""
        template, fixed = self.marks(tree)
        return [(line, [n for n in nodes if n not in fixed], linked) for r in regions(tree, template, fixed) for line, nodes, linked in blocks(r)]

    def main_text(self, page: str | None) -> str:
        found = self.lines(parsed(page))
        slots = [k for k, (line, nodes, _) in enumerate(found) if nodes and line not in self.common]
        if slots and len(slots) < len(found):
            inside = set(slots)
            found = [b for k, b in enumerate(found) if k in inside or (slots[0] < k < slots[-1] and not b[2])]
        return "\n".join(line for line, *_ in found)


def lines_of(tree: Node) -> set[str]:
    """Blocks of a page's article or main elements with text, else of the whole page."""
    for wanted in ("article", "main"):
        if found := [x for x in outermost(tree, wanted) if _slotted(x, set())]:
            return {line for x in found for line, *_ in blocks(x)}
    return {line for line, *_ in blocks(tree)}


class Evidence:
    """What a host's pages say about the texts of the page that its wrapper is made of."""

    def __init__(self, page: str):
        self.root = parsed(page)
        self.places = {id(x): k for k, x in enumerate(texts_of(self.root))}
        self.triples = triples(self.root)
        self.lines = lines_of(self.root) if self.triples else None
        self.differs: dict[int, bool] = {}
        self.first: dict[int, int] = {}

    def met(self, tree: Node) -> list[tuple[int, bool]]:
        """Places of the texts that a page has too, and whether they are the same there."""
        return [(self.places[id(x)], x.text == y.text) for x, y in matched(self.root, tree) if x.tag == "#"]

    def add(self, page: str, digest: int) -> None:
        """One more page: texts that differ, the page of smallest hash that is no near copy at each other place, lines that all pages have."""
        tree = parsed(page)
        met = self.met(tree)
        for place, same in met:
            self.differs[place] = self.differs.get(place, False) or not same
        if self.lines != set() and blocks(tree):
            lines = lines_of(tree)
            self.lines = lines if self.lines is None else self.lines & lines
        # only a page of smaller hash at a place that may be template is looked at by words
        less = [k for k in (WHOLE, *(place for place, _ in met)) if not self.differs.get(k) and digest < self.first.get(k, digest + 1)]
        if less and (own := triples(tree)) and not near(own, self.triples):
            self.first.update(dict.fromkeys(less, digest))

    def rows(self) -> list[tuple]:
        """``(place, line, differs, first)``; the row of ``WHOLE`` is always there."""
        places = [(k, None, self.differs.get(k, False), self.first.get(k)) for k in {WHOLE, *self.differs}]
        return places + [(None, line, None, None) for line in sorted(self.lines or ())]


class Support:
    """Places that a third page meets which is no near copy of the wrapper's page nor of the first page that differs from it there."""

    def __init__(self, page: str, firsts: dict[int, int], pages: dict[int, str]):
        self.evidence = Evidence(page)
        self.open, self.found = firsts, set()
        self.first = {digest: triples(parsed(p)) for digest, p in pages.items()}

    def add(self, page: str, digest: int) -> None:
        if not self.open:
            return
        tree = parsed(page)
        own = triples(tree)
        if own and not near(own, self.evidence.triples):
            apart = {first for first, other in self.first.items() if not near(own, other)}
            met = [WHOLE, *(place for place, _ in self.evidence.met(tree))] if apart else []
            now = {place for place in met if self.open.get(place) in apart}
            self.found |= now
            self.open = {place: first for place, first in self.open.items() if place not in now}

    def rows(self) -> list[tuple]:
        return [(place,) for place in sorted(self.found)]


def induced(pages: list[str | None]) -> Wrapper:
    """Wrapper of all pages of one host; equal pages count once."""
    pages = [p for p in dict.fromkeys(pages) if p is not None]
    if len(pages) < 2:
        return Wrapper(None, [], [], [])
    top = max(pages, key=lambda p: p.count("<"))
    evidence = Evidence(top)
    others = [(k, p) for k, p in enumerate(pages) if p != top]
    for k, p in others:
        evidence.add(p, k)
    firsts = {place: k for place, k in evidence.first.items() if not evidence.differs.get(place)}
    support = Support(top, firsts, {k: pages[k] for k in firsts.values()})
    for k, p in others:
        support.add(p, k)
    template = sorted(k for k, differs in evidence.differs.items() if not differs)
    return Wrapper(top, template, [k for k in template if k in support.found], sorted(evidence.lines or ()) if WHOLE in support.found else [])


def main_texts(pages: list[str | None]) -> list[str]:
    """Main text of each of some pages of one host."""
    wrapper = induced(pages)
    return [wrapper.main_text(p) for p in pages]


class Hosts:
    """What a task makes of that its hosts are told. Those met last are kept, ``HELD`` characters or so; ``gone`` has the others."""

    def __init__(self, shipped, make: Callable):
        self.shipped, self.make, self.held, self.gone = shipped, make, 0, []
        self.ready: OrderedDict = OrderedDict()

    def of(self, host: str, told: str | None):
        """None if the host is told nothing."""
        if host in self.ready:
            self.ready.move_to_end(host)
            return self.ready[host][0]
        told = self.shipped.value.get(host) if told is None else told
        if told is None:
            return None
        made = self.make(**json.loads(told))
        self.ready[host] = made, len(told)
        self.held += len(told)
        while self.held > HELD and len(self.ready) > 1:
            other, (old, size) = self.ready.popitem(last=False)
            self.held -= size
            self.gone.append((other, old))
        return made


def _told(pages: DataFrame, told: DataFrame) -> tuple[DataFrame, object]:
    """Pages with a column ``told`` by ``(host, told)``, which is null where the host's text is shipped, and what is shipped."""
    context = pages.sparkSession.sparkContext
    told = frames.kept(told)
    if (told.agg(F.sum(F.length("told"))).first()[0] or 0) <= SHIPPED:
        return pages.withColumn("told", F.lit(None).cast("string")), context.broadcast({r["host"]: r["told"] for r in told.collect()})
    parts = frames.kept(pages.groupBy("host").agg(F.floor(F.count("*") / PART).cast("int").alias("parts")).where("parts > 0"))
    copies = told.join(parts, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(0))))).drop("parts")
    large = F.broadcast(parts) if parts.count() <= HOSTS else parts
    dealt = pages.join(large, "host", "left").withColumn("part", F.pmod(F.xxhash64("html"), F.coalesce("parts", F.lit(0)) + 1).cast("int")).drop("parts")
    return dealt.join(copies, ["host", "part"], "left").drop("part"), context.broadcast({})


def _summed(pages: DataFrame, told: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Rows ``(host, ...)`` that each task has found out about its hosts; ``make`` takes the fields told and gives an object with ``add`` and ``rows``."""
    rows, shipped = _told(pages.where("html is not null").select("host", F.xxhash64("html").alias("digest"), "html"), told)
    names = ["host", *[x.split()[0] for x in schema.split(", ")]]

    def found(hosts: list) -> pd.DataFrame:
        return pd.DataFrame([(host, *row) for host, sums in hosts for row in sums.rows()], columns=names, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hosts = Hosts(shipped, make)
        for pdf in batches:
            for _, k in sorted(zip(pdf["host"], range(len(pdf)), strict=True)):
                sums = hosts.of(pdf["host"].iat[k], pdf["told"].iat[k])
                if sums is not None and int(pdf["digest"].iat[k]) != sums.digest:
                    sums.add(pdf["html"].iat[k], int(pdf["digest"].iat[k]))
            if hosts.gone:
                yield found(hosts.gone)
                hosts.gone = []
        yield found([(host, sums) for host, (sums, _) in hosts.ready.items()])

    return rows.mapInPandas(text_tools.tidy(run), f"host string, {schema}")


def _collecting(page: str, digest: int) -> Evidence:
    sums = Evidence(page)
    sums.digest = digest
    return sums


def _supporting(page: str, digest: int, firsts: list[dict], pages: list[dict]) -> Support:
    sums = Support(page, {f["place"]: f["first"] for f in firsts}, {q["first"]: q["page"] for q in pages})
    sums.digest = digest
    return sums


def _fetched(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """``(host, digest, page)`` of pages by ``(host, digest)``."""
    keys = F.broadcast(keys) if keys.count() <= KEYS else keys
    return pages.where("html is not null").select("host", F.xxhash64("html").alias("digest"), F.col("html").alias("page")).join(
        keys, ["host", "digest"], "left_semi").dropDuplicates(["host", "digest"])


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, told)`` of every host in ``pages`` (host, html) that has two pages or more that differ: its wrapper's fields as JSON."""
    digest = F.xxhash64("html")
    tags = F.length("html") - F.length(F.replace(F.col("html"), F.lit("<"), F.lit("")))
    hosts = pages.where("html is not null").groupBy("host").agg(
        F.max(F.struct(tags.alias("tags"), digest.alias("digest"))).alias("top"), F.min(digest).alias("low"), F.max(digest).alias("high"))
    tops = frames.kept(_fetched(pages, frames.kept(hosts.where("low <> high").select("host", "top.digest"))))
    told = tops.select("host", F.to_json(F.struct("page", "digest")).alias("told"))
    sums = frames.kept(_summed(pages, told, _collecting, "place int, line string, differs boolean, first long").groupBy("host", "place", "line").agg(
        F.bool_or("differs").alias("differs"), F.min("first").alias("first"), F.count("*").alias("n")))
    firsts = sums.where("first is not null and not differs").select("host", "place", "first")  # other places are slots
    others = _fetched(pages, frames.kept(firsts.select("host", F.col("first").alias("digest")).distinct()))
    told = tops.join(firsts.groupBy("host").agg(F.collect_list(F.struct("place", "first")).alias("firsts")), "host").join(
        others.groupBy("host").agg(F.collect_list(F.struct(F.col("digest").alias("first"), "page")).alias("pages")), "host")
    told = told.select("host", F.to_json(F.struct("page", "digest", "firsts", "pages")).alias("told"))
    supported = frames.kept(_summed(pages, told, _supporting, "place int").distinct())
    template = sums.where("place >= 0 and not differs").join(supported.withColumn("fixed", F.lit(True)), ["host", "place"], "left").groupBy("host").agg(
        F.sort_array(F.collect_list("place")).alias("template"), F.sort_array(F.collect_list(F.when(F.col("fixed"), F.col("place")))).alias("fixed"))
    tasks = sums.where(F.col("place") == WHOLE).select("host", F.col("n").alias("tasks")).join(supported.where(F.col("place") == WHOLE).select("host"), "host")
    common = sums.where("line is not null").join(tasks, "host").where("n = tasks").groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("common"))
    none = F.array()
    found = tops.join(template, "host", "left").join(common, "host", "left").select(
        "host", "page", F.coalesce("template", none.cast("array<int>")).alias("template"), F.coalesce("fixed", none.cast("array<int>")).alias("fixed"),
        F.coalesce("common", none.cast("array<string>")).alias("common"))
    return found.select("host", F.to_json(F.struct("page", "template", "fixed", "common")).alias("told"))


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    frames.shared(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    p = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), "url", "html", host.alias("host"))
    rows, shipped = _told(p, wrappers(p))
    types = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hosts, alone = Hosts(shipped, Wrapper), Wrapper(None, [], [], [])
        for pdf in batches:
            pdf = pdf.sort_values("host", kind="stable")
            texts = [(hosts.of(host, told) or alone).main_text(html) for host, told, html in zip(pdf["host"], pdf["told"], pdf["html"], strict=True)]
            hosts.gone = []
            yield pd.DataFrame({"page_id": pdf["page_id"].array, "url": pdf["url"].array, "text": texts, "n_chars": [len(t) for t in texts]})

    out = rows.mapInPandas(text_tools.tidy(run), f"page_id string, url {types['url']}, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
