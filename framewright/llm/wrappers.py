"""Main text of pages by wrapper induction.

Pages of one host, a few dozen at a time, are parsed to DOM trees, runs of alike siblings are
folded to one slot, and every tree is aligned with the group's most common shape by simple
tree matching.  Pages whose words are at least 0.8 alike are one *family*, so that copies
speak once.  A slot is template where one text of it is held by half of the group's
families, three at least; everything else that varies is content and stays, in page order.
Only the text of a template slot itself goes, never the slots inside it.

Content is read off the articles of a page, else its main element, else its body.  Elements
and class names that say menu, advert, notice, form or comment are left out: by the last
telling word of a name ("reader-comments", not "comments-on-a-book"), or, outside an
article, by any word of a slot that half of the families have.

A host with many pages is cut in pieces by the hash of their html; the others stay whole.
Equal pages lie side by side, groups hold ``GROUP_PAGES`` to one and a half times as many
pages where the piece has as many, and at most ``GROUP_CHARS``.  Pages of fewer than three
families are no evidence: only names part content from the rest.

Null or empty html gives an empty text; a null or odd url counts as host "".  Rows without
id and repeated rows are kept.  Elements deeper than ``MAX_DEPTH`` leave their text, borders
and end tags, but lie flat in the one above; those that decide what is article stay elements.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import bound_text_batches, partitions

GROUP_PAGES = 32
GROUP_CHARS = 1 << 24
# Pages of one host that a task takes at least before the host is cut in pieces.
PIECE_PAGES = 500
MAX_DEPTH = 120
ALIKE = 0.8
# Slots of two elements that are matched pair by pair; beyond, from both ends.
MAX_PAIRS = 250_000

# Elements of HTML by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that hold no article text, and words in class, id or role that say so.
OUTSIDE = frozenset(
    "head nav footer aside form script style noscript template iframe svg math button select option input textarea object embed "
    "canvas audio video dialog menu noembed noframes title".split())
CUES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs footer masthead sidebar aside widget related recommended share sharing social cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus replies reply respond "
    "pagination pager toolbar skip contentinfo complementary search dialog".split())
SITE_HEADER = frozenset("header topbar".split())
# Words of layout that say nothing after a cue ("sidebar-left", "ad-slot-2"),
# and words before "header" that make it the site's.
LAYOUT = frozenset(
    "area bar block body box button buttons bottom cell column col container content count footer form frame group head header heading "
    "holder inner item items label left line link links list main outer panel placeholder primary right row secondary section slot "
    "small large text thread title top unit wrap wrapper".split())
OF_SITE = frozenset("site global web top".split())
# Marks that a name earns by its words.
_CUE, _SITE = "!", "^"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)", re.S)
_EDGE = re.compile("[>\"']")
_MARK = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+", re.A)
_SPACE = re.compile(r"\s+")
# An element that opens ends an open one of these, up to the element that holds them.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
         "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")),
         "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
         "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",))}


class Node:
    """An element: tag, the words of its marks, and children (elements and texts).  A flat
    one puts its children among those of the element around it."""

    __slots__ = ("tag", "marks", "kids", "depth", "flat")

    def __init__(self, tag: str, marks: tuple[str, ...] = ()):
        self.tag, self.marks, self.kids = tag, marks, []
        self.depth, self.flat = 0, False


def _marks(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, and what their names tell."""
    out, told = [], set()
    for name, a, b, c in _MARK.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true":
            out.append("hidden")
        elif name != "aria-hidden":
            for token in html.unescape(value).split():
                # camelCase and kebab-case names fall apart in words
                words = _PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower())
                out += words
                last = len(words) - 1
                while last > 0 and words[last] not in CUES and (words[last] in LAYOUT or words[last].isdigit() or len(words[last]) == 1):
                    last -= 1
                if words and words[last] in CUES:
                    told.add(_CUE)
                if words and words[-1] in SITE_HEADER and OF_SITE.issuperset(words[:-1]):
                    told.add(_SITE)
    return (*out, *sorted(told))


class Open:
    """The open elements, with the places of each tag, so that no end tag walks them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.solid: list[int] = []

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        if node.tag not in INLINE:
            self.solid.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """End the elements from place ``k`` on."""
        while len(self.nodes) > k:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag not in INLINE:
                self.solid.pop()
            if node.flat:
                _border(node)

    def end(self, tag: str) -> None:
        """An end tag: the last open element of its name, not across a block for inline ones."""
        at = self.places[tag]
        if at and (tag not in INLINE or not self.solid or self.solid[-1] < at[-1]):
            self.cut(at[-1])

    def give_way(self, tags: tuple[str, ...], holders: tuple[str, ...]) -> None:
        """End what lies open of ``tags`` inside the nearest of ``holders``."""
        held = max((self.places[h][-1] for h in holders if self.places[h]), default=0)
        first = [at[k] for at in map(self.places.__getitem__, tags) if (k := bisect_right(at, held)) < len(at)]
        if first:
            self.cut(min(first))


def _tag_end(source: str, at: int, dead: set[int]) -> int:
    """Place of the bracket that ends the tag whose attributes start at ``at``, quoted ones
    passed over; -1 where quotes do not close.  ``dead`` remembers from where that is so."""
    seen = []
    while at not in dead:
        seen.append(at)
        edge = _EDGE.search(source, at)
        if edge and edge[0] == ">":
            return edge.start()
        at = source.find(edge[0], edge.end()) + 1 if edge else 0
        if not at:
            break
    dead.update(seen)
    return -1


def parse(source: str) -> Node:
    """A tree of the elements of ``source``, with the end tags that authors leave out."""
    root = Node("html")
    open_ = Open(root)
    at, dead = 0, set()
    while m := _TOKEN.search(source, at):
        if m.start() > at:
            open_.nodes[-1].kids.append(source[at:m.start()])
        at = m.end()
        closing, tag = m[1], m[2]
        if closing:
            open_.end(closing.lower())
            continue
        if not tag:
            continue
        tag, end = tag.lower(), _tag_end(source, at, dead)
        if end < 0:
            end = source.find(">", at)
            end = len(source) if end < 0 else end
        attributes, at = source[at:end], min(end + 1, len(source))
        if tag in ("html", "body"):
            if open_.nodes[-1].tag == "head":
                open_.cut(len(open_.nodes) - 1)
            if tag == "html":
                continue
        if tag in RAW:
            if tag not in ("svg", "math") or not attributes.rstrip().endswith("/"):
                over = re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(source, at)
                at = over.end() if over else len(source)
            continue
        if tag in CLOSES_P:
            open_.give_way(("p",), ("td", "th", "table", "li"))
        if tag in _ENDS:
            open_.give_way(*_ENDS[tag])
        _open(open_, Node(tag, _marks(attributes) if "=" in attributes or "hidden" in attributes else ()))
    if at < len(source):
        open_.nodes[-1].kids.append(source[at:])
    return root


def _open(open_: Open, node: Node) -> None:
    above = open_.nodes[-1]
    node.depth = above.depth + 1
    # Twice the depth for what tells article from the rest.
    decides = node.tag in ("article", "main") or excluded(node, False)
    if node.tag in VOID or node.depth < (2 * MAX_DEPTH if decides else MAX_DEPTH):
        above.kids.append(node)
    else:
        node.kids, node.depth, node.flat = above.kids, above.depth, True
        _border(node)
    if node.tag not in VOID:
        open_.push(node)


def _border(node: Node) -> None:
    """Part the text before and after the edge of a flat element that is a block."""
    if node.tag not in INLINE and node.kids and isinstance(node.kids[-1], str):
        node.kids.append(Node("div"))


def excluded(node: Node, in_article: bool) -> bool:
    """Whether an element holds no article text, by its tag and name."""
    if node.tag in OUTSIDE or "hidden" in node.marks:
        return True
    # An outer article or main is the content whatever its name; an inner one may be a comment.
    if _CUE in node.marks and node.tag not in ("body", "main") and (in_article or node.tag != "article"):
        return True
    return not in_article and (node.tag == "header" or _SITE in node.marks and node.tag not in HEADINGS)


def blocks(nodes: list[Node], dropped: frozenset[int] = frozenset(), in_article: bool = True, mute: frozenset[int] = frozenset()) -> list[str]:
    """Blocks of text under ``nodes`` in page order, excluded and ``dropped`` elements left
    out; of those in ``mute`` only the text outside inner blocks is."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    def walk(node: Node, inside: bool, quiet: bool):
        inline = node.tag in INLINE
        if not inline:
            flush()
            quiet = id(node) in mute
        for kid in node.kids:
            if isinstance(kid, str):
                if not quiet:
                    line.append(kid)
            elif kid.tag == "br":
                line.append(" ")
            elif id(kid) not in dropped and not excluded(kid, inside):
                walk(kid, inside or kid.tag in ("article", "main"), quiet)
        if not inline:
            flush()

    for node in nodes:
        walk(node, in_article or node.tag in ("article", "main"), False)
        flush()
    return out


class Shape:
    """An element with its runs of alike children folded to slots."""

    __slots__ = ("name", "nodes", "slots", "text")

    def __init__(self, nodes: list[Node]):
        self.nodes = nodes
        self.name = (nodes[0].tag, nodes[0].marks)
        self.slots: list[Shape] = []
        if len(nodes) == 1:
            run: list[Node] = []
            for kid in nodes[0].kids:
                if isinstance(kid, str) or kid.tag in INLINE:
                    continue
                if run and (run[0].tag, run[0].marks) != (kid.tag, kid.marks):
                    self.slots.append(Shape(run))
                    run = []
                run.append(kid)
            if run:
                self.slots.append(Shape(run))
        self.text = (self.name, len(nodes) > 1, tuple(s.text for s in self.slots))


def tree_matching(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: the largest number of slots that can be paired in order under
    equal parents, and those pairs."""
    if a.name != b.name:
        return 0, []
    if a.text == b.text:
        return _size(a), list(_zipped(a, b))
    n, m = len(a.slots), len(b.slots)
    if n * m > MAX_PAIRS:
        return _from_both_ends(a, b)
    inner = {(i, j): tree_matching(x, y) for i, x in enumerate(a.slots) for j, y in enumerate(b.slots) if x.name == y.name}
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + inner.get((i, j), (0, []))[0])
    pairs, i, j = [(a, b)], n, m
    while i and j:
        got = inner.get((i - 1, j - 1), (0, []))
        if got[0] and best[i][j] == best[i - 1][j - 1] + got[0]:
            pairs += got[1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[n][m] + 1, pairs


def _from_both_ends(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Matching of very many slots: those of one name from the start, then from the end."""
    most, size, pairs = min(len(a.slots), len(b.slots)), 1, [(a, b)]
    ahead = 0
    while ahead < most and a.slots[ahead].name == b.slots[ahead].name:
        ahead += 1
    back = 0
    while back < most - ahead and a.slots[-1 - back].name == b.slots[-1 - back].name:
        back += 1
    for x, y in [*zip(a.slots[:ahead], b.slots[:ahead]), *zip(a.slots[len(a.slots) - back:], b.slots[len(b.slots) - back:])]:
        got = tree_matching(x, y)
        size, pairs = size + got[0], pairs + got[1]
    return size, pairs


def _size(a: Shape) -> int:
    return 1 + sum(map(_size, a.slots))


def _zipped(a: Shape, b: Shape):
    yield a, b
    for x, y in zip(a.slots, b.slots):
        yield from _zipped(x, y)


def _own_text(shape: Shape) -> str:
    """Text of a slot outside its slots."""
    out: list[str] = []

    def walk(node: Node):
        for kid in node.kids:
            if isinstance(kid, str):
                out.append(kid)
            elif kid.tag in INLINE or len(shape.nodes) > 1:
                walk(kid)
    for node in shape.nodes:
        walk(node)
    return _SPACE.sub(" ", " ".join(out)).strip()


def _walk(shape: Shape, in_article: bool = False, path: tuple = ()):
    """(slot, path, in an article) of every slot that is not excluded."""
    if not excluded(shape.nodes[0], in_article):
        path = (*path, shape.name)
        in_article = in_article or shape.name[0] in ("article", "main")
        yield shape, path, in_article
        for s in shape.slots:
            yield from _walk(s, in_article, path)


def families(texts: list[str]) -> list[int]:
    """Number of the family of each text: of the first text before it that is alike, by the
    share of letters in common words."""
    out: list[int] = []
    leads: list[tuple[Counter, int]] = []
    known: dict[str, int] = {}
    for text in texts:
        if text not in known:
            bag: Counter = Counter()
            for word, n in Counter(text.split()).items():
                bag[word] = n * len(word)
            mass = sum(bag.values())
            for k, (other, size) in enumerate(leads):
                if min(mass, size) >= ALIKE * max(mass, size):
                    few, many = (bag, other) if len(bag) < len(other) else (other, bag)
                    both = sum(min(n, many[w]) for w, n in few.items() if w in many)
                    if both >= ALIKE * (mass + size - both):
                        known[text] = k
                        break
            else:
                known[text] = len(leads)
                leads.append((bag, mass))
        out.append(known[text])
    return out


class Wrapper:
    """What a group of pages tells about its shape: which texts of which slots are template,
    which names repeat, and where the articles lie."""

    def __init__(self, pages: list[Shape]):
        # Own texts are taken once a slot, and all content of a page once before anything is left out.
        self.slots = [[(*s, _digest(text) if (text := _own_text(s[0])) else None) for s in _walk(p)] for p in pages]
        self.articles = [_articles(slots) for slots in self.slots]
        self.content = [[(path, blocks(nodes, in_article=False)) for path, nodes in some or [((), p.nodes)]]
                        for p, some in zip(pages, self.articles)]
        family = families([" ".join(" ".join(text) for _, text in parts) for parts in self.content])
        shapes: dict = {}
        for p, f in zip(pages, family):
            shapes.setdefault(p.text, (p, set()))[1].add(f)
        self.pivot = max(shapes.values(), key=lambda v: (len(v[1]), _size(v[0])))[0]
        # Slots go by their place in the pivot; those it lacks by their path.
        self.aligned = [{id(own): id(slot) for slot, own in tree_matching(self.pivot, p)[1]} for p in pages]
        held, marked = defaultdict(set), defaultdict(set)
        mass: Counter = Counter()
        for page, (slots, place, f) in enumerate(zip(self.slots, self.aligned, family)):
            for shape, path, inside, own in slots:
                key = place.get(id(shape), path)
                if own:
                    held[key, own].add(f)
                if not inside and not CUES.isdisjoint(shape.name[1]):
                    marked[key].add(f)
            for path, text in self.content[page]:
                mass[path] += sum(map(len, text))
        enough = max(3, (max(family) + 2) // 2)
        self.template = {k for k, f in held.items() if len(f) >= enough}
        self.repeated = {k for k, f in marked.items() if len(f) >= enough}
        most = max(mass.values(), default=0)
        self.places = {p for p, m in mass.items() if 10 * m >= most}

    def read(self, page: int, shape: Shape) -> str:
        """Text of one page of the group."""
        slots, place = self.slots[page], self.aligned[page]
        nodes = [n for _, n in self.articles[page]] or [shape.nodes]
        whole = [(n, text, path) for n, (path, text) in zip(nodes, self.content[page])]
        taken = [(n, text) for n, text, path in whole if path in self.places] or [w[:2] for w in whole]
        dropped, mute = set(), set()
        for slot, path, inside, own in slots:
            key = place.get(id(slot), path)
            if not inside and key in self.repeated and slot.name[0] not in ("html", "body"):
                dropped.update(map(id, slot.nodes))
            elif own and (key, own) in self.template:
                # All text of a run is its own; of one element only what lies outside its slots.
                (dropped if len(slot.nodes) > 1 else mute).update(map(id, slot.nodes))
        if dropped or mute:
            taken = [(nodes, blocks(nodes, frozenset(dropped), False, frozenset(mute))) for nodes, _ in taken]
        return "\n\n".join(b for _, text in taken for b in text)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).digest()


def _articles(slots) -> list[tuple[tuple, list[Node]]]:
    """(path, nodes) of the outermost articles or main elements among the slots of a page."""
    return [(path, s.nodes) for s, path, *_ in slots
            if s.name[0] in ("article", "main") and not any(tag in ("article", "main") for tag, _ in path[:-1])]


def extract_group(pages: list[str | None]) -> list[str]:
    """Main texts of pages of one host."""
    shapes = {p: Shape([parse(p)]) for p in pages if p}
    if not shapes:
        return [""] * len(pages)
    wrapper = Wrapper(list(shapes.values()))
    texts = {p: wrapper.read(k, s) for k, (p, s) in enumerate(shapes.items())}
    return [texts[p] if p else "" for p in pages]


def _groups(group_pages: int):
    """Rows arrive sorted by piece."""
    def emit(group):
        texts = extract_group([r[2] for r in group])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in group], pa.int64()), pa.array([r[1] for r in group], pa.string()), pa.array(texts, pa.string())],
            ["page_id", "url", "text"])

    def kernel(batches):
        at, rows, chars = None, [], 0
        for batch in batches:
            for host, piece, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and ((host, piece) != at or chars > GROUP_CHARS):
                    yield emit(rows)
                    rows, chars = [], 0
                elif 2 * len(rows) >= 3 * group_pages:
                    # What is left makes a group of half the size at least.
                    yield emit(rows[:group_pages])
                    rows = rows[group_pages:]
                    chars = sum(len(r[2] or "") for r in rows)
                at = host, piece
                rows.append(row)
                chars += len(row[2] or "")
        if rows:
            yield emit(rows)
    return kernel


def extract(pages: DataFrame, group_pages: int = GROUP_PAGES, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars) per row of ``pages``; blocks are joined by an empty line."""
    bound_text_batches(pages.sparkSession, 500)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(host.alias("host"), F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(source).cast("string").alias("html"))
    # At most 1,000 hosts have more than a thousandth of all pages: a table that is safe to ship.
    most = max(PIECE_PAGES, -(-rows.count() // 1000))
    hot = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pieces")).where(F.col("pieces") > most)
    hot = hot.select("host", F.ceil(F.col("pieces") / most).cast("int").alias("pieces"))
    same = F.xxhash64(F.coalesce("html", F.lit("")))
    cut = rows.join(F.broadcast(hot), "host", "left").withColumn("same", same).withColumn(
        "piece", F.pmod("same", F.coalesce("pieces", F.lit(1))).cast("int"))
    parts = max(partitions(pages.sparkSession), 4 * rows.rdd.getNumPartitions())
    dealt = cut.repartition(parts, "host", "piece").sortWithinPartitions("host", "piece", "same", "page_id", "url")
    dealt = dealt.select("host", "piece", "page_id", "url", "html")
    out = dealt.mapInArrow(_groups(group_pages), "page_id long, url string, text string")
    return out.select(F.col("page_id").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
