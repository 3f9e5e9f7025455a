"""Main text of web pages by wrappers inferred from the pages of each host.

A page is a stream of tags and texts. Streams of one host are aligned into a wrapper, a union-free
regular expression: equal tokens stay, neighbouring siblings of one kind become a repeated group,
what only some pages have becomes optional, and texts become slots. A slot knows how much text it
held, how much of it in links, whether the text was always the same, and whether it stood in two
pages that aren't copies of each other (copies share their longest text).

The wrapper decides what a page's text is; each page is matched against it, element by element:

* the main region is the ``article`` or ``main`` element whose slots vary most. A host without one, or
  whose articles hold little of what varies, is searched from the body down: into the one part that
  holds most of the varying text outside of links, until a repeated group holds it. Top headings that
  vary on the way down belong to it, and parts of it that are mostly links don't;
* a block with the same text in two different pages is template and goes, unless it is a heading, a
  caption or a table head, which belong to the article. Where most of the region never varies, the
  pages are versions of one article and nothing is template;
* elements that HTML itself calls navigation, aside, footer, form, script and so on go, and so do parts
  with a whole class, id or role name of ``NAMES``, unless they hold half of what varies in the region.

Scale: a task aligns its own pages first and sends one wrapper a host, so a host with a third of all
pages sends one row a task; these meet in two steps, salted by task and then by host, in a fixed order.
A task whose wrapper of a host grows over ``NODES`` elements sends it and begins another; where they meet,
such large wrappers are merged last, in pairs of like size. Nothing is forgotten, so an element of two pages
is found wherever they stand; a host's whole wrapper must fit one task, and grows with the kinds of elements
that the host has, not with its pages. Rules keep only what leads to a decision. They are
broadcast while their measured size is at most ``BROADCAST_BYTES``; beyond it pages and rules are joined
on the host, where skewed hosts can be split.

Edge cases: null and empty html give an empty text; a null or odd url belongs to the host ``""``;
unclosed tags close where HTML says; an unclosed comment or script ends with the page; elements of any
depth count; repeated pages each keep their row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept, small_batches, store

BROADCAST_BYTES, HOSTS_A_TASK, SALT, NODES = 16 << 20, 2_000, 64, 20_000
#: Share of a region's text that must vary before equal blocks count as template.
VARYING = 0.5
#: Of the body's varying text: what an article must hold, and a part must hold to be searched further.
ARTICLE, INTO = 0.25, 0.6
#: Children up to which alignments are the longest possible; longer lists align greedily.
CELLS = 1_000_000

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that belong to an article however often they repeat.
OWN = HEADINGS | frozenset("caption dt figcaption legend summary th".split())
SCOPES = frozenset("body article aside section div main nav header footer td th table ul ol dl form blockquote button figure details".split())
#: Elements that end at a sibling of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ENDERS = frozenset().union(*ENDS.values())
#: Elements that never hold the main text.
ASIDE = frozenset("head nav footer aside form button select input dialog menu script style noscript template iframe svg object embed canvas audio video".split())
#: Whole names of class, id or role that say the same of an element.
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsored sidebar comment comments reader-comments user-comments respond reply replies disqus_thread notice notices cookie-notice cookie-banner cookie-consent alert "
    "newsletter popup modal share social breadcrumb breadcrumbs pagination pager navigation menu navbar complementary contentinfo search banner".split()
)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|([^<]+|<)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"[-_]*\d+")
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # elements nest as deep as the page says


def symbol(tag: str, attributes: str) -> str:
    """An element's kind in the stream: its tag and the names of its class, id and role, without numbers."""
    if not attributes or "=" not in attributes:
        return tag
    names = {n for m in _NAMES.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split() if (n := _DIGITS.sub("", w))}
    return " ".join([tag, *sorted(names)]) if names else tag


def tag_of(kind: str) -> str:
    return kind.partition(" ")[0]


def named_aside(kind: str) -> bool:
    return not NAMES.isdisjoint(kind.split(" ")[1:])


def stream(page: str) -> Iterator[tuple[str, str]]:
    """Well-nested events of a page: ('<', kind), ('>', kind), ('#', text), ('-', '') at a line break."""
    open_kinds: list[str] = []
    open_tags: list[str] = []
    now: Counter = Counter()

    def close_to(k: int) -> Iterator[tuple[str, str]]:
        while len(open_kinds) > k:
            now[open_tags.pop()] -= 1
            yield ">", open_kinds.pop()

    def last(tag: str) -> int:
        k = len(open_tags) - 1
        while open_tags[k] != tag:
            k -= 1
        return k

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        if not m:  # a tag that never ends: the rest is markup
            break
        at = m.end()
        if m[4] is not None:
            yield "#", m[4]
        elif m[2] is not None:
            tag = m[2].lower()
            if m[1]:
                if now[tag]:
                    k = last(tag)
                    if tag not in INLINE or SCOPES.isdisjoint(open_tags[k:]):
                        yield from close_to(k)
                elif tag == "p" or tag == "br":
                    yield "-", ""
                continue
            if tag in CLOSES_P and now["p"]:
                k = last("p")
                if SCOPES.isdisjoint(open_tags[k + 1 :]):
                    yield from close_to(k)
            if tag in ENDERS:
                for k in range(len(open_tags) - 1, -1, -1):
                    if open_tags[k] in ENDS and tag in ENDS[open_tags[k]]:
                        yield from close_to(k)
                        break
                    if open_tags[k] in ("ul", "ol", "dl", "table", "select", "article", "body"):
                        break
            if tag in VOID:
                yield "-" if tag in ("br", "hr") else "_", ""
                continue
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                stop = page.find(">", end.end()) if end else -1
                at = n if not end or stop < 0 else stop + 1
                continue
            kind = symbol(tag, m[3])
            open_kinds.append(kind)
            open_tags.append(tag)
            now[tag] += 1
            yield "<", kind
    yield from close_to(0)


class Node:
    """A wrapper: an element kind, repeated (``many``) or optional (``some``), its slot and its children.

    ``slot``: [the one page's mark or None for several, characters, checksum of the one text or None].
    """

    __slots__ = ("kind", "many", "some", "slot", "children")

    def __init__(self, kind: str, many: bool = False, some: bool = False, slot: list | None = None, children: list | None = None):
        self.kind, self.many, self.some, self.slot, self.children = kind, many, some, slot, [] if children is None else children

    def constant(self) -> bool:
        return self.slot is not None and self.slot[0] is None and self.slot[2] is not None


def _merge(a: Node, b: Node) -> Node:
    """Two wrappers of elements of one kind as one."""
    slot = a.slot or b.slot
    if a.slot and b.slot:
        slot = [a.slot[0] if a.slot[0] == b.slot[0] else None, a.slot[1] + b.slot[1], a.slot[2] if a.slot[2] == b.slot[2] else None]
    return Node(a.kind, a.many or b.many, a.some or b.some, slot, _align(a.children, b.children))


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a common subsequence: the longest, or for very long lists a greedy one."""
    n, m = len(a), len(b)
    if n * m > CELLS:
        where: dict[str, list[int]] = {}
        for i in range(n - 1, -1, -1):
            where.setdefault(a[i], []).append(i)
        out, at = [], 0
        for j, kind in enumerate(b):
            places = where.get(kind, [])
            while places and places[-1] < at:
                places.pop()
            if places:
                at = places.pop() + 1
                out.append((at - 1, j))
        return out
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _align(a: list[Node], b: list[Node]) -> list[Node]:
    """Children in order: the same kinds in both merge, those between become optional."""
    left, right = [x.kind for x in a], [x.kind for x in b]
    if left == right:
        return [_merge(x, y) for x, y in zip(a, b)]
    out: list[Node] = []
    i = j = 0
    for s, t in [*_common(left, right), (len(a), len(b))]:
        for x in a[i:s] + b[j:t]:
            x.some = True
            out.append(x)
        if s < len(a):
            out.append(_merge(a[s], b[t]))
        i, j = s + 1, t + 1
    folded: list[Node] = []
    for x in out:
        _add(folded, x)
    return folded


def _add(children: list[Node], x: Node) -> None:
    """Append an element; a kind that stood among the last three becomes a repeated group at once."""
    back = next((k for k in (1, 2, 3) if len(children) >= k and children[-k].kind == x.kind), 0)
    if not back:
        children.append(x)
        return
    for y in children[-back:]:
        y.many = True
    children[-back] = _merge(children[-back], x)


def page_wrapper(page: str) -> Node:
    """The wrapper of one page."""
    root = Node("")
    path, nodes = [root], []
    mark, size = 0, -1
    for what, value in stream(page):
        if what == "<":
            path.append(Node(value))
        elif what == ">":
            done = path.pop()
            _add(path[-1].children, done)
        elif what == "#" and (text := " ".join(value.split())):
            own = path[-1].slot
            crc = zlib.crc32(text.encode(errors="replace"))
            if len(text) > size:
                mark, size = crc, len(text)
            path[-1].slot = [0, own[1] + len(text), zlib.crc32(f"{own[2]} {crc}".encode())] if own else [0, len(text), crc]
    nodes = [root]
    for x in nodes:  # grows while it is read
        if x.slot:
            x.slot[0] = mark
        nodes += x.children
    return root


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tags; # is a text slot, ' a constant one."""
    inner = ("'" if node.constant() else "#") if node.slot else ""
    for c in node.children:
        inner += expression(c)
    own = f"<{node.kind}>{inner}</{tag_of(node.kind)}>" if node.kind else inner
    return f"({own})" + ("*" if node.many and node.some else "+" if node.many else "?") if node.many or node.some else own


def pack(root: Node) -> str:
    """A wrapper as JSON: its elements from the top, each with the number of its children."""
    out, rest = [], [root]
    while rest:
        x = rest.pop()
        out.append([x.kind, x.many + 2 * x.some, x.slot, len(x.children)])
        rest += reversed(x.children)
    return json.dumps(out, separators=(",", ":"))


def unpack(body: str) -> Node:
    top = Node("")
    rest = [(top, 1)]
    for kind, flags, slot, n in json.loads(body):
        parent, left = rest.pop()
        x = Node(kind, bool(flags & 1), bool(flags & 2), slot)
        parent.children.append(x)
        if left > 1:
            rest.append((parent, left - 1))
        if n:
            rest.append((x, n))
    return top.children[0]


def _bounded(root: Node) -> Node:
    """``root`` without optional elements of a single page, if it has more than ``NODES`` elements.

    This forgets evidence, so no step of the extraction calls it.
    """
    every = [root]
    for x in every:
        every += x.children
    if len(every) <= NODES:
        return root
    several: set[int] = set()
    for x in reversed(every):
        if (x.slot and x.slot[0] is None) or any(id(c) in several for c in x.children):
            several.add(id(x))
    for x in every:
        x.children = [c for c in x.children if not c.some or id(c) in several]
    return root


def _count(root: Node) -> int:
    every = [root]
    for x in every:
        every += x.children
    return len(every)


class Merger:
    """The wrapper of wrappers that come one by one, without loss.

    They are merged into one until that has over ``limit`` elements; then the next begins another. The
    large ones wait in a stack and merge when a later one has grown as large, so that each element is
    aligned a number of times that grows with the logarithm of their number.
    """

    def __init__(self, limit: int):
        self.limit, self.now, self.most, self.large = limit, None, 0, []

    def add(self, one: Node, size: int) -> bool:
        """Whether this made the current wrapper a large one. ``size``: the elements of ``one``, or more."""
        self.now = one if self.now is None else _merge(self.now, one)
        self.most += size
        if self.most > self.limit:
            self.most = _count(self.now)
        return self.most > self.limit

    def begin(self) -> None:
        """Put the current wrapper on the stack."""
        done, size = self.now, self.most
        self.now, self.most = None, 0
        while self.large and self.large[-1][1] <= size:
            done = _merge(self.large.pop()[0], done)
            size = _count(done)
        self.large.append((done, size))

    def whole(self) -> Node:
        if self.now is not None:
            self.begin()
        while len(self.large) > 1:
            last = self.large.pop()[0]
            self.large.append((_merge(self.large.pop()[0], last), 0))
        return self.large[0][0]


# ---- what the wrapper decides ---------------------------------------------------------------------


def _measure(node: Node, found: dict[int, tuple[int, int, int]], link: bool = False, aside: bool = False) -> tuple[int, int, int]:
    """Characters of a subtree outside of asides: of all slots, of varying ones, and of varying ones in links."""
    tag = tag_of(node.kind)
    link = link or tag == "a"
    total = varying = linked = 0
    if node.slot:
        total = node.slot[1]
        if not node.constant():
            varying = total
            linked = total if link else 0
    for c in node.children:
        t, v, n = _measure(c, found, link)
        if tag_of(c.kind) not in ASIDE:
            total, varying, linked = total + t, varying + v, linked + n
    found[id(node)] = total, varying, linked
    return total, varying, linked


def _fixed(node: Node) -> bool:
    """Whether a block's own text, with the inline elements in it, is the same in different pages."""
    if node.slot and not node.constant():
        return False
    some = node.slot is not None
    rest = [c for c in node.children if tag_of(c.kind) in INLINE]
    for c in rest:
        if c.slot:
            some = True
            if not c.constant():
                return False
        rest += [k for k in c.children if tag_of(k.kind) in INLINE]
    return some


def decide(wrapper: Node) -> dict[int, str]:
    """Marks of the wrapper's elements: m main region, h heading of it outside, t template text, x not text."""
    size: dict[int, tuple[int, int, int]] = {}
    _measure(wrapper, size)
    every = [wrapper]
    for x in every:
        every += x.children
    marks: dict[int, str] = {}
    text = lambda x: size[id(x)][1] - size[id(x)][2]  # noqa: E731  varying, outside of links

    # an article may stand in an unclosed menu or header: only its own kind is judged
    own = [x for x in every if (tag_of(x.kind) == "article" or tag_of(x.kind) == "main" or "main" in x.kind.split(" ")[1:]) and not named_aside(x.kind) and tag_of(x.kind) not in ASIDE and tag_of(x.kind) not in INLINE]
    articles = [x for x in own if tag_of(x.kind) == "article" and size[id(x)][0]] or [x for x in own if size[id(x)][0]]
    body = next((x for x in every if tag_of(x.kind) == "body"), wrapper)
    region = max(articles, key=lambda x: (size[id(x)][1], size[id(x)][0]), default=None)
    semantic = region is not None and size[id(region)][1] >= ARTICLE * size[id(body)][1]
    if not semantic:
        region = body
        while True:
            parts = [c for c in region.children if tag_of(c.kind) not in ASIDE and not (named_aside(c.kind) and 2 * text(c) < text(region))]
            next_one = max(parts, key=text, default=None)
            if next_one is None or next_one.many or tag_of(next_one.kind) in INLINE or not next_one.children or text(next_one) < INTO * max(1, text(region)):
                break
            if not any(tag_of(c.kind) not in INLINE for c in next_one.children):
                break  # a block of text, not a part of the page
            for c in parts:
                if c is not next_one and tag_of(c.kind) == "h1":
                    marks[id(c)] = "h"
            region = next_one
    if size[id(region)][0] and region is not wrapper:
        marks[id(region)] = "m"
    total, varying, _ = size[id(region)]
    inside = [region]
    for x in inside:
        inside += x.children
    in_region = {id(x) for x in inside}
    equal_goes = varying >= VARYING * total
    half = 0.5 * max(1, varying)
    for x in every:
        tag = tag_of(x.kind)
        if id(x) in marks:
            continue
        if named_aside(x.kind) and not (id(x) in in_region and size[id(x)][1] >= half):
            marks[id(x)] = "x"
        elif not semantic and tag not in INLINE and size[id(x)][2] > 0.5 * size[id(x)][1] and size[id(x)][1] and not (x.slot and not x.constant()):
            marks[id(x)] = "x"
        elif equal_goes and tag not in INLINE and tag not in OWN and _fixed(x):
            marks[id(x)] = "t"
    return marks


def rule_of(wrapper: Node) -> list:
    """The wrapper cut down to what leads to a decision: [kind, many, mark, children]."""
    marks = decide(wrapper)

    def cut(x: Node) -> list:
        children, useful = [], False
        for c in x.children:
            one = cut(c)
            children.append(one)
            useful = useful or bool(one[2] or one[3])
        return [x.kind, int(x.many), marks.get(id(x), ""), children if useful else []]

    return cut(wrapper)


def _flat(rule: list) -> str:
    """A rule as JSON without nesting."""
    out, rest = [], [rule]
    while rest:
        kind, many, mark, children = rest.pop()
        out.append([kind, many, mark, len(children)])
        rest += reversed(children)
    return json.dumps(out, separators=(",", ":"), ensure_ascii=False)


class Rule:
    """A rule's element in a worker, with its children found by kind."""

    __slots__ = ("many", "mark", "children", "by_kind")

    def __init__(self, many: int = 0, mark: str = ""):
        self.many, self.mark, self.children, self.by_kind = many, mark, [], {}

    def match(self, kind: str, at: int) -> tuple[Rule | None, int]:
        """The child that the next element of a kind stands for, after child ``at``, and its position."""
        places = self.by_kind.get(kind)
        if not places:
            return None, at
        for i in places:
            if i >= at:
                return self.children[i], i
        return self.children[places[-1]], places[-1]  # a group that comes again


def read_rule(body: str) -> Rule:
    top = Rule()
    rest = [(top, 1)]
    for kind, many, mark, n in json.loads(body):
        parent, left = rest.pop()
        x = Rule(many, mark)
        parent.by_kind.setdefault(kind, []).append(len(parent.children))
        parent.children.append(x)
        if left > 1:
            rest.append((parent, left - 1))
        if n:
            rest.append((x, n))
    return top.children[0]


def extract(page: str, rule: Rule) -> str:
    """The text of a page: what its stream puts into the wrapper's slots of the main region."""
    for whole in (False, True):  # a page without its host's main region is read as a whole
        parts: list[str] = []
        # of each open element: rule, place among the rule's children, in region, not text, template, header, heading
        path: list[list] = [[rule, 0, whole, False, False, False, False]]
        for what, value in stream(page):
            if what == "<":
                up = path[-1]
                tag = tag_of(value)
                own = None
                if up[0] is not None:
                    own, up[1] = up[0].match(value, up[1])
                mark = own.mark if own is not None else "x" if named_aside(value) else ""
                inside, out = up[2], up[3]
                if (mark == "m" or mark == "h") and not whole:
                    inside, out = True, False
                elif inside and (mark == "x" or tag in ASIDE):
                    out = True
                block = tag not in INLINE
                head = tag in HEADINGS
                # of a header only headings of the main region are text
                path.append([own, 0, inside, out, mark == "t" if block else up[4], up[5] or (inside and tag == "header"), up[6] or head])
                if block:
                    parts.append(" ")
            elif what == ">":
                path.pop()
                if tag_of(value) not in INLINE:
                    parts.append(" ")
            elif what == "-":
                parts.append(" ")
            elif what == "#":
                _, _, inside, out, template, header, heading = path[-1]
                if inside and not out and not template and (not header or (heading and not whole)):
                    parts.append(entities.unescape(value))
        text = " ".join("".join(parts).split())
        if text:
            return text
    return ""


# ---- over tables ----------------------------------------------------------------------------------

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    small_batches(pages.sparkSession)
    url = F.col(url_col).cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))


def _merge_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    merger = Merger(NODES)
    for body in pdf.sort_values(["part", "wrapper"], kind="stable")["wrapper"]:
        one = unpack(body)
        if merger.add(one, _count(one)):
            merger.begin()
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [int(pdf["part"].min())], "pages": [int(pdf["pages"].sum())], "wrapper": [pack(merger.whole())]})


def infer_wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, pages, wrapper (JSON), the regular expression and the extraction rule of each host."""

    limit = NODES

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        known: dict[str, tuple[int, Merger]] = {}

        def send(hosts: list[str]) -> pa.RecordBatch:
            of = [known.pop(h) for h in hosts]
            return pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array([task] * len(hosts), pa.int64()), pa.array([n for n, _ in of], pa.int64()), pa.array([pack(m.whole()) for _, m in of], pa.string())],
                ["host", "part", "pages", "wrapper"],
            )

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = page_wrapper(page)
                n, merger = known.get(host) or (0, Merger(limit))
                known[host] = (n + 1, merger)
                if merger.add(one, _count(one)):
                    yield send([host])
                if len(known) >= HOSTS_A_TASK:
                    yield send(list(known))
        if known:
            yield send(list(known))

    schema = "host string, part long, pages long, wrapper string"
    rows = _pages(pages, id_col, url_col, html_col).select("host", "html")
    sent = rows.mapInArrow(align, schema)
    some = sent.withColumn("salt", F.pmod("part", F.lit(SALT))).groupBy("host", "salt").applyInPandas(_merge_rows, schema)
    whole = some.groupBy("host").applyInPandas(_merge_rows, schema).select("host", "pages", "wrapper")

    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wrappers = [unpack(w) for w in b.column(2).to_pylist()]
            extra = [pa.array([expression(w) for w in wrappers], pa.string()), pa.array([_flat(rule_of(w)) for w in wrappers], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], ["host", "pages", "wrapper", "expression", "rule"])

    return whole.mapInArrow(rule, "host string, pages long, wrapper string, expression string, rule string")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    rules, _ = store(infer_wrappers(pages, id_col, url_col, html_col).select("host", "rule"), "rules")
    rows = _pages(pages, id_col, url_col, html_col)
    size = rules.agg(F.sum(F.length("host") + F.length("rule") + 64).alias("n")).first().n or 0
    schema = "page_id long, url string, text string, n_chars long"

    def result(batch: pa.RecordBatch, rule_for: list[Rule]) -> pa.RecordBatch:
        texts = [extract(page, rule) for page, rule in zip(batch.column(3).to_pylist(), rule_for)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if size <= broadcast_bytes:
        shared, call = spark.sparkContext.broadcast({r.host: r.rule for r in rules.collect()}), uuid.uuid4().hex

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = kept("html_rules", call, lambda: {h: read_rule(r) for h, r in shared.value.items()})
            for b in batches:
                yield result(b, [known[h] for h in b.column(2).to_pylist()])

        return rows.mapInArrow(alone, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = {r: read_rule(r) for r in set(b.column(4).to_pylist())}
            yield result(b, [read[r] for r in b.column(4).to_pylist()])

    return rows.join(rules, "host").select("page_id", "url", "host", "html", "rule").mapInArrow(joined, schema)
