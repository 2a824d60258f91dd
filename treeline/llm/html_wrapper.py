"""Main text of web pages by wrapper induction.

Pages of one host are made by one template. A bounded number of pages a host is parsed to
trees of block elements, in which runs of equal leaf siblings count as one repeated node. The
trees are aligned one after another by simple tree matching: nodes with equal keys (element,
class and id words) match, children match in order, and the matching with the most nodes
wins. Then every page of the host is aligned with the merged tree and counted at its nodes:
nodes of at least half of the sampled pages (two or more) are template if their text is equal on
all pages of the host that show them; all others are slots.

The wrapper is the merged tree with a state for each node. Menus, footers, asides and scripts
go by their element; nodes whose class or id words name such parts go unless they hold most of
the text of the slots and no article or main element is beside them; headings never go by their
words. The smallest nodes with prose among their own blocks, articles and main elements are
marked: all their lines but template are text. Outside them lines count that are not links
alone. Parts of a page that do not align with the
wrapper are judged in the same way by that page alone.

A host may hold any share of the pages: the pages of the sample are picked by two
rounds of salted ranking, and extraction needs no grouping by host.

Defined cases: null and empty pages give the empty text; a null or hostless url belongs to
the host ""; a page that does not align with the wrapper is judged alone; with one
page a host all text counts as slots; cut-off pages are parsed as far as they go: a tag or
comment without its end is dropped with what follows; elements nested deeper than DEPTH
lie flat in the node at that depth, their text and the breaks between their blocks stay; lists of siblings
with more than MOST_PAIRS pairs are aligned by key and order of occurrence; pages of any length
are parsed whole, in linear time; repeated rows each give a row; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.shared import BROADCAST_BYTES, settle, small_side, text_slices

#: Pages of a host that shape its wrapper, and the salts that rank them.
SAMPLE, SALTS = 12, 32
#: Kinds of nodes, and states of a wrapper's nodes: only lines with text outside links count, all lines count, nothing counts.
FIT, SOFT, HARD = range(3)
OPEN, MARKED, DROPPED = range(3)

# HTML elements by what they do.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
NOT_TEXT = frozenset("script style noscript template iframe noembed noframes svg math head title nav header footer aside form button select textarea menu dialog search option".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus replies respond share sharing social related recommended widget pager pagination".split()
)
NEUTRAL_WORDS = frozenset(
    "area aside bar block bottom box buttons col column container content foot form group inner item items js left links list main message middle module outer page panel placeholder post primary right secondary section site small social text thread top unit wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre li dd dt td th figcaption address".split())
MAINS = frozenset(("article", "main"))
OUTER = frozenset("# html body".split())
CLOSES_P = BLOCKS - {"dd", "dt", "li", "body", "html", "head", "title", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An element of the key ends an open element of the set, up to the nearest element of SCOPES.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table article section div body html main nav aside footer header form blockquote td th".split())

#: Nodes stand at most so deep, as browsers hold it; what is nested deeper goes, in its order, into the node above.
DEPTH = 160
#: Two lists of siblings with more pairs than this are aligned by their keys in order of occurrence.
MOST_PAIRS = 250_000

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TO_VALUE, _BLANKS, _BARE = re.compile(r"[^>=]*"), re.compile(r"\s*"), re.compile(r"[^\s>]*")
_NAME = re.compile(r"""(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_CLOSED = re.compile(r"""(?:["'\s]|^)/$""")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "words", "items", "block")

    def __init__(self, tag: str, words: tuple[str, ...] = ()) -> None:
        self.tag, self.words, self.items, self.block = tag, words, [], False  # items: nodes and strings; block: a block is below


class _Finder:
    """str.find over a page read from left to right: what was not found once is not looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.none = page, set()

    def __call__(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        if (k := self.page.find(what, at)) < 0:
            self.none.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """Place of the > that ends the tag whose attributes begin here, -1 if none does. Quotes count after an = only."""
        page = self.page
        while True:
            at = _TO_VALUE.match(page, at).end()
            if at >= len(page):
                return -1
            if page[at] == ">":
                return at
            at = _BLANKS.match(page, at + 1).end()
            if page[at : at + 1] in ("'", '"') and (k := self(page[at], at + 1)) >= 0:
                at = k + 1
            elif page[at : at + 1] not in ("'", '"'):
                at = _BARE.match(page, at).end()
            else:  # a quote that is never closed
                at += 1


class _Stack:
    """Open elements: tag, node, depth of the node, place of the nearest block other than p, place of the nearest scope."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, Node, int, int, int]] = [("#", Node("#"), 0, 0, 0)]
        self.at: dict[str, list[int]] = {}

    def push(self, tag: str, node: Node, depth: int) -> None:
        k, above = len(self.rows), self.rows[-1]
        self.rows.append((tag, node, depth, k if tag in BLOCKS and tag != "p" else above[3], k if tag in SCOPES else above[4]))
        self.at.setdefault(tag, []).append(k)

    def nearest(self, tags) -> int:  # noqa: ANN001
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, k: int) -> None:
        """Close the element at k and all inside it."""
        broken = False
        while len(self.rows) > k:
            tag, node, _, _, _ = self.rows.pop()
            self.at[tag].pop()
            broken |= tag in BLOCKS and node is self.rows[-1][1]
        if broken:
            self.part()

    def part(self) -> None:
        """Let what follows begin a new block."""
        if not ((items := self.rows[-1][1].items) and not isinstance(items[-1], str) and items[-1].tag == "hr"):
            self.add(Node("hr"))

    def add(self, node: Node) -> None:
        """Put a node into the innermost element."""
        self.rows[-1][1].items.append(node)
        if node.tag in BLOCKS:
            for row in reversed(self.rows):
                if row[1].block:
                    break
                row[1].block = True


def parse(page: str) -> Node:
    """A forgiving tree of the page, in time linear in its length; text is still with character references. A tag that no > ends is dropped with what follows."""
    stack, find, at = _Stack(), _Finder(page), 0
    root = stack.rows[0][1]
    while at < len(page):
        k = find("<", at)
        if k < 0:
            stack.rows[-1][1].items.append(page[at:])
            break
        if k > at:
            stack.rows[-1][1].items.append(page[at:k])
        m = _OPEN.match(page, k)
        if m is None:
            mark = "-->" if page.startswith("<!--", k) else ">"
            if page[k + 1 : k + 2] not in ("!", "?"):
                stack.rows[-1][1].items.append("<")
                at = k + 1
            elif (end := find(mark, k)) < 0:
                break
            else:
                at = end + len(mark)
            continue
        end = find.tag_end(m.end())
        if end < 0:
            break
        at, tag = end + 1, m[2].lower()
        if m[1]:
            if stack.at.get(tag):
                stack.cut(stack.at[tag][-1])
            continue
        if tag in CLOSES_P and (k := stack.nearest("p")) > stack.rows[-1][3]:  # p may hold inline elements that were never closed
            stack.cut(k)
        if tag in ENDS and (k := stack.nearest(ENDS[tag])) and k >= stack.rows[-1][4]:
            stack.cut(k)
        given = page[m.end() : end]
        node = Node(tag, tuple(_telling(_NAME.findall(given))) if "=" in given else ())
        depth = stack.rows[-1][2]
        if tag in VOID or tag in RAW:
            stack.add(node)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                node.items.append(page[at : close.start() if close else len(page)])
                at = len(page) if close is None else (find(">", close.start()) + 1 or len(page))
        elif tag not in BLOCKS and _CLOSED.search(given):
            stack.add(node)  # an inline element written as empty
        elif depth < DEPTH or kind_of(node) == HARD and depth < DEPTH + 1:
            stack.add(node)
            stack.push(tag, node, depth + 1)
        else:
            if tag in BLOCKS:
                stack.part()
            stack.push(tag, stack.rows[-1][1], depth)
    return root


def _telling(names: list[tuple[str, str, str]]) -> Iterator[str]:
    """The words of class and id; a listed word counts only in a name made of listed and neutral words alone."""
    for name in " ".join(a or b or c for a, b, c in names).lower().split():
        found = _WORD.findall(name)
        plain = all(w in NOT_TEXT_WORDS or w in NEUTRAL_WORDS for w in found)
        yield from (w if plain or w not in NOT_TEXT_WORDS else f"+{w}" for w in found)


def kind_of(node: Node) -> int:
    """FIT for article text; SOFT where class words, or a form, speak against it and the text decides; HARD where the tag rules it out."""
    if node.tag in NOT_TEXT and node.tag != "form":
        return HARD
    return SOFT if node.tag == "form" or (node.tag not in HEADINGS and NOT_TEXT_WORDS.intersection(node.words)) else FIT


class Shape:
    """A node of the tree of blocks: key, children, own lines in their order among the children, and what pages showed there."""

    __slots__ = ("key", "kind", "kids", "parts", "no", "seen", "same", "mass", "slot", "constant", "state", "form", "size")

    def __init__(self, key: str, kind: int) -> None:
        self.key, self.kind, self.no = key, kind, 0
        self.kids: list[Shape] = []
        self.parts: list[Shape | tuple[str, bool]] = []  # children and (line, whether text outside links is in it)
        self.seen, self.same, self.mass, self.slot = 1, None, 0, 0  # same: hash of the own text while it is equal on all pages
        self.constant, self.state = False, OPEN
        self.form, self.size = 0, 1  # of the tree below: equal for equal trees of keys; its nodes

    @property
    def tag(self) -> str:
        return self.key.split(" ", 1)[0]


def shape(node: Node) -> Shape:
    """The blocks under a node, inline elements dissolved, runs of equal leaves merged."""
    out = Shape(f"{node.tag} {' '.join(node.words)}".strip(), kind_of(node))
    if out.kind == HARD:
        return out
    held: list[str] = []
    free = 0

    def end() -> None:
        nonlocal free
        if text := _SPACE.sub(" ", entities.unescape("".join(held))).strip():
            out.parts.append((text, free > 0))
            out.mass += free
        held.clear()
        free = 0

    def add(kid: Shape) -> None:
        last = out.parts[-1] if out.parts else None
        if isinstance(last, Shape) and last.key == kid.key and not last.kids and not kid.kids:
            last.parts += kid.parts
            last.mass += kid.mass
        else:
            out.kids.append(kid)
            out.parts.append(kid)

    def fill(inner: Node, linked: bool) -> None:
        nonlocal free
        for x in inner.items:
            if isinstance(x, str):
                held.append(x)
                free += 0 if linked else len(x.strip())
            elif x.tag in BLOCKS or ((kind := kind_of(x)) == SOFT and x.block):
                end()
                add(shape(x))
            elif x.tag == "br":
                held.append("\n")
            elif x.tag not in VOID and kind == FIT:
                fill(x, linked or x.tag == "a")

    fill(node, False)
    end()
    return out


def signed(s: Shape) -> Shape:
    """Sets form and size of all nodes."""
    s.form, s.size = hash((s.key, *[signed(k).form for k in s.kids])), 1 + sum(k.size for k in s.kids)
    return s


def match(a: Shape, b: Shape, memo: dict) -> int:
    """Simple tree matching: the most nodes that an order-keeping matching pairs. Trees are told by their forms."""
    if a.key != b.key:
        return 0
    if a.form == b.form:
        return a.size
    at = (a.form, b.form)
    if at not in memo:
        memo[at] = 1 + _total(a.kids, b.kids, memo)
    return memo[at]


def _total(x: list[Shape], y: list[Shape], memo: dict) -> int:
    if not x or not y:
        return 0
    if len(x) * len(y) > MOST_PAIRS:
        return sum(match(x[i], y[j], memo) for i, j in _by_occurrence(x, y))
    return _table(x, y, memo)[-1][-1]


def _table(x: list[Shape], y: list[Shape], memo: dict) -> list[list[int]]:
    rows = [[0] * (len(y) + 1)]
    for p in x:
        above, row = rows[-1], [0]
        for j, q in enumerate(y):
            row.append(max(above[j + 1], row[j], above[j] + match(p, q, memo)))
        rows.append(row)
    return rows


def _by_occurrence(x: list[Shape], y: list[Shape]) -> list[tuple[int, int]]:
    """For very long lists: the n-th of a key goes with the n-th of that key, and of these pairs the longest run in order of both is kept."""
    places: dict[tuple[str, int], int] = {}
    seen: dict[str, int] = {}
    for j, q in enumerate(y):
        seen[q.key] = seen.get(q.key, 0) + 1
        places[q.key, seen[q.key]] = j
    seen.clear()
    ends: list[int] = []
    tops: list[int] = []
    pairs: list[tuple[int, int, int]] = []  # (i, j, pair before)
    for i, p in enumerate(x):
        seen[p.key] = seen.get(p.key, 0) + 1
        if (j := places.get((p.key, seen[p.key]))) is None:
            continue
        at = bisect_left(ends, j)
        pairs.append((i, j, tops[at - 1] if at else -1))
        ends[at : at + 1], tops[at : at + 1] = [j], [len(pairs) - 1]
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        i, j, k = pairs[k]
        out.append((i, j))
    return out[::-1]


def aligned(x: list[Shape], y: list[Shape], memo: dict) -> list[tuple[int, int]]:
    """Indexes of the pairs of the best matching of two lists of siblings."""
    if len(x) == len(y) and all(p.form == q.form for p, q in zip(x, y, strict=True)):
        return [(i, i) for i in range(len(x))]
    if len(x) * len(y) > MOST_PAIRS:
        return _by_occurrence(x, y)
    rows, i, j, out = _table(x, y, memo), len(x), len(y), []
    while i and j:
        if (w := match(x[i - 1], y[j - 1], memo)) and rows[i][j] == rows[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _own(s: Shape) -> int | None:
    """A hash of the own text, None if there is none."""
    lines = [x[0] for x in s.parts if not isinstance(x, Shape)]
    return int.from_bytes(hashlib.blake2b("\n".join(lines).encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big") if lines else None


def _start(s: Shape) -> None:
    s.same = _own(s)
    for k in s.kids:
        _start(k)


def merge(template: Shape, page: Shape, memo: dict) -> None:
    """Align a page with the template and take in what it shows; unmatched nodes become optional ones."""
    template.seen += 1
    template.mass += page.mass
    if template.same != _own(page):
        template.same = None
    pairs = aligned(template.kids, page.kids, memo)
    for i, j in pairs:
        merge(template.kids[i], page.kids[j], memo)
    of = {j: i for i, j in pairs}
    out, done = [], 0
    for j, kid in enumerate(page.kids):
        if j in of:
            out += template.kids[done : of[j] + 1]
            done = of[j] + 1
        else:
            _start(kid)
            out.append(kid)
    template.kids = out + template.kids[done:]


def _slots(s: Shape, told: bool) -> int:
    """Finds the constant nodes, and the text of slots under each node."""
    s.constant = told and s.same is not None
    s.slot = (0 if s.constant else s.mass) + sum(_slots(k, told) for k in s.kids)
    return s.slot


def _holds_main(s: Shape) -> bool:
    return bool(s.slot) and (s.tag in MAINS or any(_holds_main(k) for k in s.kids))


def judge(template: Shape) -> Shape:
    """Gives every node its state, from the text that the pages showed."""
    if not _slots(template, True):  # all pages are alike: nothing tells slots from template
        _slots(template, False)
    half, mains = template.slot / 2, _holds_main(template)

    def walk(s: Shape, marked: bool, inside: bool) -> None:
        # Class words of a node that holds most text are taken to name a layout, but not beside an article.
        if s.kind == HARD or (s.kind == SOFT and (s.slot <= half or (mains and not inside and not _holds_main(s)))):
            s.state = DROPPED
            return
        inside = inside or s.tag in MAINS
        if not marked and s.slot and s.tag not in OUTER:
            own = s.mass and not s.constant
            marked = bool(inside or not s.kids or own or any(k.slot and k.kind == FIT and not k.kids and k.tag in PROSE for k in s.kids))
        s.state = MARKED if marked else OPEN
        for k in s.kids:
            walk(k, marked, inside)

    walk(template, False, False)
    return template


def merged(pages: list[str]) -> Shape:
    """The template of distinct pages. Own texts stay at nodes that show them on half of the pages, two at least."""
    shapes = [shape(parse(p)) for p in pages]
    template = shapes[0]
    _start(template)
    for s in shapes[1:]:
        merge(signed(template), signed(s), {})

    def thin(s: Shape) -> None:
        if s.seen < 2 or 2 * s.seen < len(shapes):
            s.same = None
        for k in s.kids:
            thin(k)

    thin(template)
    return template


def induce(pages: list[str]) -> Shape:
    """The wrapper of the pages, its nodes judged by these pages alone."""
    return judge(signed(merged(pages)))


def to_json(s: Shape) -> str:
    def flat(x: Shape) -> list:
        return [x.key, x.kind, x.same, x.constant, x.state, [flat(k) for k in x.kids]]

    return json.dumps(flat(s), separators=(",", ":"))


def from_json(text: str) -> Shape:
    numbers = count()

    def grown(x: list) -> Shape:
        s = Shape(x[0], x[1])
        s.no, s.same, s.constant, s.state = next(numbers), x[2], x[3], x[4]
        s.kids = [grown(k) for k in x[5]]
        return s

    return signed(grown(json.loads(text)))


def tally(wrapper: Shape, page: Shape, memo: dict, into: Callable[[int, bool, int], None]) -> None:
    """Counts a page at every wrapper node it aligns with: number, whether the text is the node's, size of the text."""
    into(wrapper.no, wrapper.same is not None and wrapper.same == _own(page), page.mass)
    for i, j in aligned(wrapper.kids, page.kids, memo):
        tally(wrapper.kids[i], page.kids[j], memo, into)


def settled(wrapper: Shape, stats: dict[int, tuple[int, int, int]]) -> Shape:
    """The wrapper judged by (seen, same, mass) of its nodes over all pages."""

    def take(s: Shape) -> None:
        s.seen, same, s.mass = stats.get(s.no, (0, 0, 0))
        if same < s.seen:
            s.same = None
        for k in s.kids:
            take(k)

    take(wrapper)
    return judge(wrapper)


def _emit(s: Shape, w: Shape | None, marked: bool, memo: dict, out: list[str]) -> None:
    by = w or s  # a node that does not align is judged by its own page
    if by.state == DROPPED:
        return
    marked = marked or by.state == MARKED
    template = w is not None and w.constant and _own(s) == w.same
    of = {id(s.kids[j]): w.kids[i] for i, j in aligned(w.kids, s.kids, memo)} if w is not None and w.kids and s.kids else {}
    for x in s.parts:
        if isinstance(x, Shape):
            _emit(x, of.get(id(x)), marked, memo, out)
        elif not template and (marked or x[1]):
            out.append(x[0])


def extract(page: str | None, wrapper: Shape | None) -> str:
    """The main text of a page, by its host's wrapper or, where a part does not align, by its own."""
    if not page:
        return ""
    tree = judge(signed(shape(parse(page))))
    out: list[str] = []
    _emit(tree, wrapper, False, {}, out)
    return "\n".join(out)


def _host(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _sampled(pages: DataFrame) -> DataFrame:
    """page_id, host and dice, a hash of the page, of the pages that shape wrappers: of each host those with the smallest hashes, equal pages once."""
    slim = pages.filter("page_id is not null and html <> ''").select("page_id", _host("url").alias("host"), F.xxhash64("html").alias("dice")).groupBy("host", "dice").agg(F.min("page_id").alias("page_id"))
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("page_id", F.lit(2)), F.lit(SALTS)))
    for keys in (("host", "salt"), ("host",)):  # the first round leaves at most SALTS * SAMPLE rows a host
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("dice", "page_id"))).filter(F.col("place") <= SAMPLE)
    return salted.select("page_id", "host", "dice")


def _held(texts: Iterator[str | None], held: dict[str, Shape]) -> Iterator[Shape | None]:
    for text in texts:
        if text is not None and text not in held:
            if len(held) >= 1000:
                held.clear()
            held[text] = from_json(text)
        yield held.get(text)


def _tallied(rows: DataFrame) -> DataFrame:
    """host, stats: of each wrapper node the sums over all pages, added up within tasks before the shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shape] = {}
        sums: dict[tuple[str, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, n, *v) for (h, n), v in sums.items()]
            sums.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["host", "no", "seen", "same", "mass"])

        for batch in text_slices(batches, "html"):
            hosts, pages = batch.column("host").to_pylist(), batch.column("html").to_pylist()
            for host, page, wrapper in zip(hosts, pages, _held(batch.column("wrapper").to_pylist(), held), strict=True):
                if not page or wrapper is None:
                    continue

                def into(no: int, same: bool, mass: int, host: str = host) -> None:
                    at = sums.setdefault((host, no), [0, 0, 0])
                    at[0] += 1
                    at[1] += same
                    at[2] += mass

                tally(wrapper, signed(shape(parse(page))), {}, into)
            if len(sums) > 100_000:
                yield out()
        yield out()

    parts = rows.select("host", "html", "wrapper").mapInArrow(scan, "host string, no long, seen long, same long, mass long")
    nodes = parts.groupBy("host", "no").agg(F.sum("seen").alias("seen"), F.sum("same").alias("same"), F.sum("mass").alias("mass"))
    return nodes.groupBy("host").agg(F.collect_list(F.struct("no", "seen", "same", "mass")).alias("stats"))


def _beside(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """rows(host, html) with their host's wrapper, broadcast if the measured size allows it, else joined with the rows of each host dealt out by SALTS."""
    held = known.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 64), F.lit(0))).first()[0]
    if held <= BROADCAST_BYTES:
        return rows.join(F.broadcast(known), "host", how)
    dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"], how).drop("salt")


def wrappers(pages: DataFrame) -> DataFrame:
    """host and its wrapper as text: nodes from a sample, judged by all pages."""
    picked = settle(_sampled(pages), "wrapper-sample")
    rows = pages.select("page_id", _host("url").alias("host"), F.xxhash64("html").alias("dice"), "html").filter("html <> ''")
    # Rows that repeat a page are equal here, so a host has at most SAMPLE rows.
    shown = rows.join(small_side(picked, 64), ["page_id", "host", "dice"]).dropDuplicates(["host", "dice"])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [to_json(merged(group.sort_values("dice", kind="stable")["html"].tolist()))]})

    drafts = settle(shown.groupBy("host").applyInPandas(run, "host string, wrapper string"), "wrapper-drafts")
    rows = _beside(pages.select(_host("url").alias("host"), "html"), drafts, "inner")

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [to_json(settled(from_json(w), {r["no"]: (r["seen"], r["same"], r["mass"]) for r in stats})) for w, stats in zip(f["wrapper"], f["stats"], strict=True)]
            yield pd.DataFrame({"host": f["host"], "wrapper": done})

    return drafts.join(_tallied(rows), "host").mapInPandas(finish, "host string, wrapper string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    known = settle(wrappers(pages), "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", _host("url"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shape] = {}
        for batch in text_slices(batches, "html"):
            texts = [extract(page, wrapper) for page, wrapper in zip(batch.column("html").to_pylist(), _held(batch.column("wrapper").to_pylist(), held), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = _beside(rows, known, "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
