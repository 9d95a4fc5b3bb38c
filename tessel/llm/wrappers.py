"""Main text of web pages by wrapper induction over same-host pages.

Each page becomes a tree of its block elements, with runs of text as leaves (inline markup joins into the run). Each host
gets one reference: the smallest page of its most frequent skeleton (tags in order, repeats folded). All pages of the host
are aligned with the reference by simple tree matching, the order-preserving matching of children with the most matched
nodes, and counted: how often a leaf of the reference has the same text in another page, and how much text lies at each
node. That gives the wrapper:

- a leaf with the same text in CONSTANT of the pages that tell (two at least) is template, and its text is dropped where
  it stands again. A page tells only if most of its text differs from the reference, so copies of an article don't make
  the article a template.
- the slots that vary are content where they lie in the main slot: from the body down to the deepest container that holds
  MAIN of the host's varying text. Text in elements that are marked as menus, footers, adverts, forms, comments and
  the like is in no slot, nor are lists of links outside an article; where the host marks articles, text outside them isn't
  either.

Each page is then aligned with its host's wrapper: what meets the main slot, or hangs below what does, is its main text.
A page of a host of its own, without a host, or which doesn't meet the main slot is its own reference.

Alignments are independent of each other, counts are sums, and a reference is chosen by counts and hashes: the result
doesn't depend on the order or the cut of the rows, a host with most of the pages is spread over all tasks, and a task holds
a batch of pages and the references that they meet. References and wrappers are one row of a host; they are broadcast while
they are small, else joined by a shuffle.

Null or empty html gives an empty text; null urls are pages without a host; very long pages are read whole (a tree deeper
than DEEPEST goes on as siblings); repeated pages are extracted each; ties go to the earlier node and the smaller hash; an
empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._shared import discard, materialize, pieces_of, small

#: Share of pages from which an equal text is template, share of text from which a container is the main slot.
CONSTANT, MAIN = 0.8, 0.7
#: Depth from which elements go on as siblings.
DEEPEST = 200

# Element names by their part in a page, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("nav footer aside form button select option input dialog menu svg canvas object audio video map head".split()) | RAW
CONTAINERS = frozenset("html body main article section div center table tbody tr td #root".split())
ARTICLES = frozenset(("article", "main"))
#: Elements that a start tag closes where they are open, up to the nearest of the last set.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that stand in a head; any other opens the body.
HEADS = frozenset("title meta link base style script noscript template".split())
BARRIERS = frozenset("table ul ol dl select body html article section div td th".split())
#: Words in class, id or role that mark what isn't the article; the second set also holds for article elements.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside cookie cookies consent "
    "gdpr notice notices newsletter subscribe subscription signup popup modal share sharing social related recommended recommendations pagination pager toolbar widget search searchbox login masthead alert disclaimer "
    "comment comments respond reply replies disqus form contentinfo complementary".split()
)
REMARKS = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related recommended teaser".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Node:
    """An element, or a run of text (tag '#', with its text and the characters of it that are links)."""

    __slots__ = ("tag", "mark", "children", "text", "linked", "at")

    def __init__(self, tag: str, mark: str = "", text: str = "", linked: int = 0):
        self.tag, self.mark, self.text, self.linked, self.children, self.at = tag, mark, text, linked, [], -1


def _marks(attributes: str) -> str:
    found = " ".join(a or b or c for a, b, c in _MARK.findall(attributes)) if "=" in attributes else ""
    return " ".join(sorted({w.lower() for w in _WORD.findall(found) if not w.isdigit()}))


def parse(page: str) -> Node:
    """The page's tree: block elements with their runs of text, white space made one space, references decoded."""
    root = Node("#root")
    stack, run, links, in_link = [root], [], 0, False

    def flush() -> None:
        nonlocal run, links
        if run:
            text = " ".join("".join(run).split())
            if text:
                if stack[-1].tag == "head":
                    del stack[-1:]
                stack[-1].children.append(Node("#", "", text, min(links, len(text))))
            run, links = [], 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            run.append(text)
            if in_link:
                links += len(text)

    def close(at: int) -> None:
        nonlocal in_link
        flush()
        in_link = False
        del stack[at:]

    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        if not m:
            add(page[pos:])
            break
        add(page[pos : m.start()])
        pos = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not m.group(1)
            elif tag == "br":
                run.append(" ")
            continue
        if m.group(1):  # an end tag closes the nearest open element of its name
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag == tag:
                    close(at)
                    break
            else:
                flush()
            continue
        flush()
        closed, cut = CLOSES.get(tag, ()), 0
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in closed or stack[at].tag == "p" or (stack[at].tag == "head" and tag not in HEADS):
                cut = at
            elif stack[at].tag in BARRIERS:
                break
        if cut:
            close(cut)
        node = Node(tag, _marks(m.group(3)))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else size
        elif tag not in VOID and not m.group(3).endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    flush()
    return root


def dropped(node: Node) -> bool:
    """Whether an element is no part of an article by its name or by the words that mark it."""
    if node.tag in ("html", "body", "#root", "#"):
        return False
    words = set(node.mark.split())
    if node.tag in ARTICLES:
        return bool(words & REMARKS)
    if node.tag in DROPPED:
        return True
    return bool(words & MARKED) and not _holds_article(node)


def _alike(a: Node, b: Node) -> bool:
    """Whether two nodes may be matched: one name, and marking words that agree by half or more (or an article's own)."""
    if a.tag != b.tag:
        return False
    if a.mark == b.mark or a.tag in ARTICLES or a.tag in ("body", "html"):
        return dropped(a) == dropped(b) if a.mark != b.mark else True
    x, y = set(a.mark.split()), set(b.mark.split())
    return 2 * len(x & y) >= len(x | y)


def _holds_article(node: Node) -> bool:
    todo = list(node.children)
    while todo:
        n = todo.pop()
        if n.tag in ARTICLES and not set(n.mark.split()) & REMARKS:
            return True
        todo += n.children
    return False


def _linked(node: Node) -> bool:
    """Whether the text below a node is links for the most part, in three runs or more."""
    chars = links = runs = 0
    todo = list(node.children)
    while todo:
        n = todo.pop()
        if n.tag == "#":
            chars, links, runs = chars + len(n.text), links + n.linked, runs + (n.linked > 0)
        todo += n.children
    return runs >= 3 and links >= 0.8 * chars


def walk(root: Node) -> Iterator[tuple[Node, Node | None, bool, bool]]:
    """(node, parent, whether it lies in a dropped element, whether in an article), in page order; numbers the nodes."""
    todo, n = [(root, None, False, False)], 0
    while todo:
        node, parent, out, inside = todo.pop()
        node.at, n = n, n + 1
        inside = inside or (node.tag in ARTICLES and not out)
        outside = not inside and (node.tag == "header" or "header" in node.mark.split() or (node.tag in ("ul", "ol", "div", "table", "p") and _linked(node)))
        out = out or (node.tag not in ("html", "body", "#root", "#") and (dropped(node) or (outside and not _holds_article(node))))
        yield node, parent, out, inside
        todo += [(c, node, out, inside) for c in reversed(node.children)]


def match(a: Node, b: Node) -> dict[int, Node]:
    """Simple tree matching of two trees whose roots match: number of a's node -> b's node (a's nodes are numbered)."""

    def weigh(x: Node, y: Node) -> tuple[int, list]:
        """(weight, [(child of x, child of y, their own list)]); each pair is met once, as its parents are."""
        if not _alike(x, y):
            return 0, []
        if x.tag == "#":
            return (3 if x.text == y.text else 2), []
        m, n = len(x.children), len(y.children)
        best, moves, below = [0] * (n + 1), [], {}  # a row of weights, and a byte for each cell's way back
        for i in range(m):
            row, way, xc = [0] * (n + 1), bytearray(n), x.children[i]
            for j in range(n):
                w, inner = weigh(xc, y.children[j])
                row[j + 1] = top = max(best[j + 1], row[j], best[j] + w if w else 0)
                way[j] = 0 if top == best[j + 1] else 1 if top == row[j] else 2
                if way[j] == 2 and inner:
                    below[i, j] = inner
            best = row
            moves.append(way)
        picks, i, j = [], m, n
        while i and j:
            way = moves[i - 1][j - 1]
            if way == 2:
                picks.append((x.children[i - 1], y.children[j - 1], below.get((i - 1, j - 1), [])))
            i, j = i - (way != 1), j - (way != 0)
        return best[n] + 2, picks

    out, todo = {}, [(a, b, weigh(a, b)[1])]
    while todo:
        x, y, picks = todo.pop()
        out[x.at] = y
        todo += picks
    return out


def skeleton(page: str) -> tuple[str, int]:
    """(tags in order with repeats folded, number of tags): what chooses a host's reference."""
    tags = [(m.group(1) or "") + m.group(2).lower() for m in _TOKEN.finditer(page) if m.group(2) and m.group(2).lower() not in INLINE]
    folded: list[str] = []
    for t in tags:
        if not folded or folded[-1] != t:
            folded.append(t)
            for size in (2, 3, 4):  # a repeated pair (or more) of tags is one
                if len(folded) >= 2 * size and folded[-size:] == folded[-2 * size : -size]:
                    del folded[-size:]
                    break
    return " ".join(folded), len(tags)


@lru_cache(maxsize=256)
def _reference(page: str) -> tuple[Node, list[tuple[Node, Node | None, bool, bool]]]:
    root = parse(page)
    return root, list(walk(root))


def evidence(page: Node, reference: str) -> tuple[list[int], list[int], list[int]]:
    """(reference leaves met, leaves met with the same text, characters at each reference node) of a page.

    The first two are empty where the page has most of the reference's text and so tells nothing. A text that meets no
    leaf counts at the reference node that its nearest matched ancestor meets.
    """
    root, nodes = _reference(reference)
    met = match(root, page)
    leaves = [n for n, *_ in nodes if n.tag == "#"]
    found = [n for n in leaves if n.at in met]
    same = [n for n in found if met[n.at].text == n.text]
    whole = sum(len(n.text) for n, _, out, _ in nodes if n.tag == "#" and not out)
    tells = 2 * sum(len(n.text) for n in same if not nodes[n.at][2]) < whole
    home = {id(p): at for at, p in met.items()}
    chars = [0] * len(nodes)
    equal = {id(met[n.at]) for n in same}
    at_node = {}
    for n, parent, out, inside in walk(page):
        at_node[id(n)] = home.get(id(n), at_node[id(parent)] if parent else 0)
        if n.tag == "#" and not out and id(n) not in equal:
            chars[at_node[id(n)]] += len(n.text)
    return ([n.at for n in found], [n.at for n in same], chars) if tells else ([], [], chars)


def main_slot(nodes: list[tuple[Node, Node | None, bool, bool]], chars: list[int], share: float = MAIN) -> int:
    """Number of the deepest container below which at least `share` of the text lies; articles alone count where they hold any."""
    inside = [c if a else 0 for c, (_, _, _, a) in zip(chars, nodes)]
    below = inside if sum(inside) else list(chars)
    parents = {n.at: p.at if p else -1 for n, p, *_ in nodes}
    total = list(below)
    for at in range(len(nodes) - 1, 0, -1):  # parents stand before their children
        total[parents[at]] += total[at]
    at = 0
    while True:
        node = nodes[at][0]
        nearer = [c.at for c in node.children if c.tag in CONTAINERS and total[c.at] >= share * total[at]]
        if not nearer or not total[at]:
            return at
        at = max(nearer, key=lambda c: (total[c], -c))


def extract(page: Node, wrapper: tuple[str, int, frozenset[int]] | None) -> str:
    """The page's main text under a wrapper (reference, main slot, template leaves), or under none: its own structure."""
    if wrapper:
        reference, slot, template = wrapper
        root, _ = _reference(reference)
        met = match(root, page)
        if slot in met:
            return _blocks(page, met[slot], {id(met[t]) for t in template if t in met and met[t].text == _reference(reference)[1][t][0].text})
    nodes = list(walk(page))
    chars = [len(n.text) if n.tag == "#" and not out else 0 for n, _, out, _ in nodes]
    return _blocks(page, nodes[main_slot(nodes, chars)][0], set())


def _blocks(page: Node, slot: Node, template: set[int]) -> str:
    within, texts = {id(slot)}, []
    for n, parent, out, _ in walk(page):
        if parent is not None and id(parent) in within:
            within.add(id(n))
        if n.tag == "#" and not out and id(n) in within and id(n) not in template:
            texts.append(n.text)
    return "\n".join(texts)


def _pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def references(rows: DataFrame) -> DataFrame:
    """host, reference: the smallest page of the most frequent skeleton of each host with two pages or more."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for batch in pieces_of(held, "html"):
                found = [skeleton(p) for p in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), pa.array([s for s, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["host", "key", "shape", "tags"])

    named = rows.where("host <> '' and html <> ''").select("host", "html", F.sha2("html", 256).alias("key"))
    shapes = named.mapInArrow(judge, "host string, key string, shape string, tags long")
    best = shapes.groupBy("host", F.xxhash64("shape").alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tags", "key")).alias("least"))
    best = best.groupBy("host").agg(F.sum("n").alias("pages"), F.max_by("least", F.struct("n", "shape")).alias("least")).where("pages > 1")
    chosen = materialize(best.select("host", F.col("least.key").alias("key")), "chosen")
    found = named.join(small(chosen), ["host", "key"]).groupBy("host").agg(F.min("html").alias("reference"))  # equal pages, so any
    out = materialize(found, "references")
    discard(chosen)
    return out


def wrappers(rows: DataFrame, refs: DataFrame, constant: float = CONSTANT, share: float = MAIN) -> DataFrame:
    """host, reference, slot, template (leaves of the reference that the host's pages repeat)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for batch in pieces_of(held, "html"):
                counts: dict[tuple[str, int], list[int]] = {}
                for host, page, ref in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "reference"))):
                    met, same, chars = evidence(parse(page), ref)
                    for k, ats in ((0, met), (1, same)):
                        for at in ats:
                            counts.setdefault((host, at), [0, 0, 0])[k] += 1
                    for at, c in enumerate(chars):
                        if c:
                            counts.setdefault((host, at), [0, 0, 0])[2] += c
                keys, sums = list(counts), list(counts.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in keys], pa.string()), pa.array([a for _, a in keys], pa.int32()), *[pa.array([s[k] for s in sums], pa.int64()) for k in range(3)]], ["host", "node", "met", "same", "chars"]
                )

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, templates = [], []
            for ref, stats in zip(batch.column("reference").to_pylist(), batch.column("stats").to_pylist()):
                nodes = _reference(ref)[1]
                chars = [0] * len(nodes)
                for s in stats:
                    chars[s["node"]] = s["chars"]
                slots.append(main_slot(nodes, chars, share))
                templates.append(sorted(s["node"] for s in stats if s["met"] >= 2 and s["same"] >= constant * s["met"]))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("reference"), pa.array(slots, pa.int32()), pa.array(templates, pa.list_(pa.int32()))], ["host", "reference", "slot", "template"])

    met = rows.where("html <> ''").select("host", "html").join(small(refs), "host")
    stats = met.mapInArrow(align, "host string, node int, met long, same long, chars long").groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("met", "same", "chars")])
    by_host = stats.groupBy("host").agg(F.collect_list(F.struct("node", "met", "same", "chars")).alias("stats"))  # nodes of one small page
    return materialize(refs.join(by_host, "host").mapInArrow(induce, "host string, reference string, slot int, template array<int>"), "wrappers")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    rows = _pages(pages)
    refs = references(rows)
    learnt = wrappers(rows, refs)
    schema = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for batch in pieces_of(held, "html"):
                texts = []
                for page, ref, slot, template in zip(*(batch.column(c).to_pylist() for c in ("html", "reference", "slot", "template"))):
                    texts.append(extract(parse(page), (ref, slot, frozenset(template)) if ref is not None else None) if page else "")
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    discard(refs)
    return rows.join(small(learnt), "host", "left").select("page_id", "url", "html", "reference", "slot", "template").mapInArrow(apply, schema)
