"""Main text of web pages by wrapper induction: same-host DOM trees are aligned by simple tree matching."""

from __future__ import annotations

import html
import re
import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptora.llm.common import compact, materialise

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; title and textarea are text, the others none.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
#: Elements that are inside a line of text; every other one starts a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a start tag closes, and the elements beyond which it does not look for them.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
SCOPE = frozenset("table ul ol dl article section div body html aside nav main header footer form blockquote select td th".split())
#: Elements and words of class, id and role that mark what is not the article.
NO_CONTENT = frozenset("head script style title textarea noscript iframe noembed noframes template nav aside footer form button select option datalist input object svg math canvas audio video map menu dialog".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NO_CLASS = frozenset(
    "ad ads adv advert adverts advertisement adsense adbox sponsor sponsored promo promotion promoted banner sidebar side aside widget widgets nav navbar navigation menu submenu menubar breadcrumb breadcrumbs pagination pager"
    " footer foot header masthead topbar toolbar skip cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe subscription signup login paywall share sharing social related"
    " recommended recommendations trending popular comment comments commentlist reply replies respond disqus discussion form search hidden print copyright legal disclaimer toc".split()
)
#: Of these classes and ids, as they stand, what is inside a marked article is none of it either; a word within a longer name says nothing there.
NO_CLASS_INSIDE = frozenset(
    "ad ads adv advert adverts advertisement adsense adbox sponsor sponsored promo promotion promoted banner sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager cookie cookies cookie-notice consent gdpr popup modal"
    " newsletter newsletter-signup subscribe share share-buttons sharing social social-share related-posts related-articles recommended recommendations trending comments comment-list commentlist respond disqus disqus_thread skip-link toc hidden".split()
)
MAIN = frozenset(("article", "main"))
#: A slot is template where at least this many pages of the host beside the wrapper's have it and at least this share of them has the same text there.
LEAST_PAGES, SAME = 2, 0.8
#: The share of a host's pages, those most unlike its first, that tell its boilerplate; a page that has fewer words of its own than OWN_WORDS beside SHARED_WORDS or more that it shares is no evidence of another article.
FAR, OWN_WORDS, SHARED_WORDS = 0.1, 8, 80
#: So many neighbours or more that hold links alone are a menu.
MENU, BETWEEN = 3, " \t\r\n\f\v\xa0|\u00b7\u2022\u203a\u00bb/"


class Tree:
    """A page's elements in document order: parent, label (tag and classes), own text pieces, end of its subtree."""

    def __init__(self, source: str):
        self.tag, self.parent, self.label, self.marks, self.items, self.children = ["#root"], [-1], ["#root"], [""], [[]], [[]]
        self._parse(source)
        n = len(self.tag)
        self.end = list(range(1, n + 1))
        for k in range(n - 1, 0, -1):
            self.end[self.parent[k]] = max(self.end[self.parent[k]], self.end[k])

    def _open(self, tag: str, attributes: str, above: int) -> int:
        marks = ""
        if attributes and "=" in attributes or "hidden" in attributes:
            marks = " ".join(f"{m[1].lower()}={m[2] or m[3] or m[4] or ''}" for m in ATTRIBUTE.finditer(attributes))
        self.tag.append(tag)
        self.parent.append(above)
        self.label.append(f"{tag} {marks}" if marks else tag)
        self.marks.append(marks.lower())
        self.items.append([])
        self.children.append([])
        own = len(self.tag) - 1
        self.children[above].append(own)
        self.items[above].append(own)
        return own

    def _parse(self, source: str) -> None:
        stack, at, size, standing = [0], 0, len(source), Counter()
        while at < size:
            found = TOKEN.search(source, at)
            if found is None:
                self.items[stack[-1]].append(source[at:])
                break
            if found.start() > at:
                self.items[stack[-1]].append(source[at : found.start()])
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            attributes = found[3] or found[6] or ""
            if found[1] or found[4]:
                for k in range(len(stack) - 1, 0, -1) if standing[tag] else ():
                    if self.tag[stack[k]] == tag:
                        standing.subtract(self.tag[x] for x in stack[k:])
                        del stack[k:]
                        break
                    if tag in INLINE and self.tag[stack[k]] not in INLINE or tag == "p" and self.tag[stack[k]] in SCOPE:
                        break
                continue
            shut = CLOSES.get(tag, ()) if tag in INLINE else (*CLOSES.get(tag, ()), "p")
            for k in range(len(stack) - 1, 0, -1) if shut else ():
                name = self.tag[stack[k]]
                if name in shut:
                    standing.subtract(self.tag[x] for x in stack[k:])
                    del stack[k:]
                    if name in ("p", tag):
                        break
                elif name in SCOPE:
                    break
            own = self._open(tag, attributes, stack[-1])
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(source, at)
                end = close.start() if close else size
                self.items[own].append(source[at:end])
                at = close.end() if close else size
            elif tag not in VOID and not attributes.rstrip().endswith("/"):
                stack.append(own)
                standing[tag] += 1


_SHAPES: dict[tuple, int] = {}
_WEIGHTS: dict[tuple[int, int], int] = {}
_REMEMBER = 60_000


class Shape:
    """A tree's structure as it is matched: labels, children, and one number for each different subtree."""

    def __init__(self, labels: list[str], children: list[list[int]]):
        self.labels, self.children = labels, children
        n = len(labels)
        self.kind, self.size = [0] * n, [1] * n
        for k in range(n - 1, -1, -1):
            key = (labels[k], *[self.kind[c] for c in children[k]])
            if (kind := _SHAPES.get(key)) is None:
                kind = _SHAPES[key] = len(_SHAPES)
            self.kind[k] = kind
            self.size[k] += sum(self.size[c] for c in children[k])


def _forget() -> bool:
    """Starts the memory of subtrees anew when it is full; shapes made before are then not comparable."""
    if len(_SHAPES) > _REMEMBER or len(_WEIGHTS) > 5 * _REMEMBER:
        _SHAPES.clear()
        _WEIGHTS.clear()
        return True
    return False


def _weight(a: Shape, x: int, b: Shape, y: int) -> int:
    """Nodes in the largest top-down, order-preserving match of the subtrees at x and y (simple tree matching)."""
    if a.labels[x] != b.labels[y]:
        return 0
    if a.kind[x] == b.kind[y]:
        return a.size[x]
    key = (a.kind[x], b.kind[y])
    if (found := _WEIGHTS.get(key)) is None:
        head, tail, table = _table(a, a.children[x], b, b.children[y])
        p, q = a.children[x], b.children[y]
        found = _WEIGHTS[key] = 1 + sum(a.size[c] for c in p[:head]) + sum(a.size[c] for c in p[len(p) - tail :]) + table[-1][-1]
    return found


def _table(a: Shape, p: list[int], b: Shape, q: list[int]) -> tuple[int, int, list[list[int]]]:
    """Equal subtrees at both ends, which some best match pairs, and the table of best matches of the children between them."""
    head = 0
    while head < min(len(p), len(q)) and a.kind[p[head]] == b.kind[q[head]]:
        head += 1
    tail = 0
    while tail < min(len(p), len(q)) - head and a.kind[p[-1 - tail]] == b.kind[q[-1 - tail]]:
        tail += 1
    p, q = p[head : len(p) - tail], q[head : len(q) - tail]
    table = [[0] * (len(q) + 1)]
    for c in p:
        above, row = table[-1], [0]
        for k, d in enumerate(q):
            row.append(max(above[k + 1], row[k], above[k] + _weight(a, c, b, d)))
        table.append(row)
    return head, tail, table


def align(a: Shape, b: Shape) -> list[int]:
    """For each node of b the node of a that simple tree matching pairs it with, or -1."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * min(len(a.labels), len(b.labels)) + 1000))  # a level of nesting is two calls
    to, todo = [-1] * len(b.labels), [(0, 0)]
    while todo:
        x, y = todo.pop()
        if a.kind[x] == b.kind[y]:
            to[y : y + b.size[y]] = range(x, x + b.size[y])
            continue
        to[y] = x
        p, q = a.children[x], b.children[y]
        head, tail, table = _table(a, p, b, q)
        todo += zip(p[:head], q[:head], strict=True)
        todo += zip(p[len(p) - tail :], q[len(q) - tail :], strict=True)
        i, j = len(p) - tail - head, len(q) - tail - head
        while i and j:
            weight = _weight(a, p[head + i - 1], b, q[head + j - 1])
            if weight and table[i][j] == table[i - 1][j - 1] + weight:
                i, j = i - 1, j - 1
                todo.append((p[head + i], q[head + j]))
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return to


def _own_text(tree: Tree) -> list[int]:
    """A number for each node's own text without its markup; 0 if it has none."""
    out = []
    for items in tree.items:
        text = " ".join(" ".join([x for x in items if isinstance(x, str)]).split())
        out.append(zlib.crc32(text.encode("utf-8", "surrogatepass")) + 1 if text else 0)
    return out


@lru_cache(1 << 14)
def _excluded(tag: str, marks: str, in_main: bool) -> bool:
    if tag in NO_CONTENT or tag == "header" and not in_main:
        return True
    if not marks:
        return False
    for pair in re.split(r" (?=(?:class|id|role|hidden|aria-hidden|style)=)", marks):
        name, _, value = pair.partition("=")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "role" and value in NO_ROLE:
            return True
        if name in ("class", "id") and tag not in ("html", "body") and (not NO_CLASS_INSIDE.isdisjoint(value.split()) if in_main else not NO_CLASS.isdisjoint(re.split(r"[^a-z0-9]+", value))):
            return True
    return False


def _menus(tree: Tree) -> list[bool]:
    """For each node whether it is one of MENU or more neighbours, elements of one name with nothing but BETWEEN between them, all of whose text is in links."""
    n = len(tree.tag)
    bare, linked = [False] * n, [False] * n
    for k in range(n - 1, -1, -1):
        if tree.tag[k] == "a":
            linked[k], bare[k] = any(isinstance(x, str) and x.strip() or isinstance(x, int) and (linked[x] or bare[x]) for x in tree.items[k]), False
        else:
            bare[k] = any(isinstance(x, str) and x.strip(BETWEEN) or isinstance(x, int) and bare[x] for x in tree.items[k])
            linked[k] = any(isinstance(x, int) and linked[x] for x in tree.items[k])
    out = [False] * n
    for items in tree.items:
        run: list[int] = []
        for x in [*items, None]:
            if isinstance(x, int) and linked[x] and not bare[x] and (not run or tree.tag[x] == tree.tag[run[0]]):
                run.append(x)
            elif not (isinstance(x, str) and not x.strip(BETWEEN)):
                if len(run) >= MENU:
                    for k in run:
                        out[k] = True
                run = [x] if isinstance(x, int) and linked[x] and not bare[x] else []
    return out


def _compared(tree: Tree, texts: list[int], to: list[int], own: list[int]) -> tuple[list[tuple[int, int, bool]], int, int]:
    """(node, length, same) of each node with text outside excluded elements, where same is whether the wrapper's page has that text in the same slot; the length of all and of the same ones."""
    skip, nodes = [False] * len(texts), []
    for k in range(1, len(texts)):
        skip[k] = skip[tree.parent[k]] or _excluded(tree.tag[k], tree.marks[k], False)
        if texts[k] and not skip[k]:
            nodes.append((k, sum(len(x) for x in tree.items[k] if isinstance(x, str)), to[k] >= 0 and texts[k] == own[to[k]]))
    return nodes, sum(n for _, n, _ in nodes), sum(n for _, n, same in nodes if same)


def _words(tree: Tree, k: int) -> Counter:
    return Counter(" ".join(x for x in tree.items[k] if isinstance(x, str)).split())


def _copies(tree: Tree, texts: list[int], to: list[int], first: Tree, own: list[int], boilerplate: frozenset[int], share: float) -> bool:
    """Whether a page that has at least that share of its text in common with the wrapper's page has the article in common too.

    It has if at least that share is the same without the slots that are the
    same on the host's most unlike pages, or if hardly a word is its own beside
    an article's worth of shared ones. Copies cannot tell article from template.
    """
    nodes, _, _ = _compared(tree, texts, to, own)
    rest = [(n, same) for k, n, same in nodes if not (same and to[k] in boilerplate)]
    if sum(n for n, same in rest if same) >= share * sum(n for n, _ in rest):
        return True
    if sum(_words(tree, k).total() for k, _, same in nodes if same) < SHARED_WORDS:
        return False
    return sum((_words(tree, k) - (_words(first, to[k]) if to[k] >= 0 else Counter())).total() for k, _, same in nodes if not same) < OWN_WORDS


def extract(tree: Tree, template: frozenset[int] = frozenset(), to: list[int] | None = None) -> str:
    """The page's main text: blocks in page order joined by newlines.

    template holds the slots of the host's wrapper whose text is constant; to
    maps the page's nodes to slots. Text in elements that are never the article
    is dropped. Where the page marks an article or main part, all the rest of
    that is the article, what is equal on all pages (a byline) too. Elsewhere
    constant slots are template and go, and so do menus: neighbours that hold
    links alone. If nothing were left, constant slots stay: pages that are all
    alike have no template to tell.
    """
    n = len(tree.tag)
    inside, skip, menus = [False] * n, [False] * n, _menus(tree)
    some_main = False
    for k in range(1, n):
        above = tree.parent[k]
        inside[k] = inside[above] or tree.tag[k] in MAIN or "role=main" in tree.marks[k]
        skip[k] = skip[above] or _excluded(tree.tag[k], tree.marks[k], inside[above]) or menus[k] and not inside[k]
        some_main |= inside[k] and not skip[k]

    def blocks(keep_constant: bool) -> list[str]:
        out, now = [], []

        def flush() -> None:
            if text := " ".join(html.unescape("".join(now)).split()):
                out.append(text)
            now.clear()

        todo: list = [0]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, tuple):
                k, text = x
                if inside[k] or not some_main and (keep_constant or to is None or to[k] not in template):
                    now.append(text)
            elif not skip[x]:
                inline = tree.tag[x] in INLINE
                if tree.tag[x] == "br":
                    now.append(" ")
                if not inline:
                    flush()
                    todo.append(None)
                around = not inside[x] and any(menus[c] for c in tree.children[x])  # what stands between a menu's links goes with them
                todo += [c if isinstance(c, int) else (x, c) for c in reversed(tree.items[x]) if isinstance(c, int) or not around or c.strip(BETWEEN)]
        flush()
        return out

    return "\n".join(blocks(False) or (blocks(True) if template else []))


def _host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


class Wrappers:
    """Each host's first tree, the slots of its wrapper, as (shape, own texts, tree); made anew in each Python worker."""

    def __init__(self, pages: dict[str, str]):
        self.pages, self.made = pages, {}

    def of(self, host: str) -> tuple[Shape, list[int], Tree] | None:
        if _forget() or len(self.made) > 500:
            self.made.clear()
        if host not in self.made:
            source = self.pages.get(host)
            tree = None if source is None else Tree(source)
            self.made[host] = tree and (Shape(tree.label, tree.children), _own_text(tree), tree)
        return self.made[host]


def first_pages(df: DataFrame, broadcast_mb: int = 64) -> DataFrame:
    """(host, html) of the page with the smallest page_id of each host, without null html.

    The hosts' page numbers go to all tasks while they take up to broadcast_mb,
    so that no html is shuffled but the first pages'; beyond that pages and
    hosts are joined by shuffling.
    """
    pages = df.where("html is not null").select(F.col("page_id").cast("long"), _host().alias("host"), "html")
    first = pages.groupBy("host").agg(F.min("page_id").alias("page_id")).select(F.col("host").alias("_host"), F.col("page_id").alias("_page"))
    first = materialise(first, "first-page-ids")
    if (first.agg(F.sum(F.octet_length("_host") + 64)).first()[0] or 0) <= broadcast_mb << 20:
        first = F.broadcast(first)
    return pages.join(first, (F.col("host") == F.col("_host")) & F.col("page_id").eqNullSafe(F.col("_page")), "left_semi").groupBy("host").agg(F.min("html").alias("html"))


def main_text(df: DataFrame, least_pages: int = LEAST_PAGES, same: float = SAME, broadcast_mb: int = 64) -> DataFrame:
    """page_id, url, text and n_chars of each row of df (page_id, url, html), from the whole html.

    A host's wrapper is the tree of its first page. Every page of the host is
    aligned with it, and all pages together, but for near-copies of the first,
    tell which slots are constant: counts by host, likeness and slot, combined
    in each task, so a host with a third of all pages sends no more than any
    other. Pages that are mostly like the first are counted in a second pass,
    once the most unlike ones have told what is boilerplate. Then each page is
    aligned again and read. Wrappers go to all tasks at once while they take up to broadcast_mb,
    and beyond that pages are joined with their host's, dealt over salts.
    Null, empty and broken html give what text they have, at worst none;
    pages without a host share one wrapper; repeated rows stay.
    """
    spark = df.sparkSession
    pages = compact(df.select(F.col("page_id").cast("long"), "url", "html", _host().alias("host")))
    first = materialise(first_pages(df, broadcast_mb), "first-pages")
    taken = first.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    small = taken <= broadcast_mb << 20
    held = spark.sparkContext.broadcast(Wrappers({r["host"]: r["html"] for r in first.toLocalIterator()}) if small else None)
    if small:
        given = pages.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        salts = 16
        spread = first.select("host", F.col("html").alias("wrapper"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        given = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left").drop("salt")
    given = given.select("page_id", "url", "host", "html", "wrapper")

    def aligned(batch: pa.RecordBatch, only: dict | None = None) -> Iterator[tuple[str, Tree, list[int], tuple | None]]:
        local = None
        for host, source, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
            if only is not None and host not in only:
                continue
            if small:
                found = held.value.of(host)
            else:
                if local is None or local.pages.get(host) != wrapper:
                    local = Wrappers({host: wrapper})
                found = local.of(host)
            tree = Tree(source or "")
            yield host, tree, align(found[0], Shape(tree.label, tree.children)) if found else None, found

    def with_slots(table: DataFrame) -> tuple[DataFrame, object]:
        """given with the slots of its host in table (host, slots), or with nulls and a broadcast of all hosts' slots."""
        if small:
            return given.withColumn("slots", F.lit(None).cast("array<int>")), spark.sparkContext.broadcast({r["host"]: frozenset(r["slots"]) for r in table.toLocalIterator()})
        spread = table.select(F.col("host").alias("_host"), "slots", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_salt"))
        return given.join(spread, (F.col("host") == F.col("_host")) & (F.pmod(F.xxhash64("page_id"), F.lit(16)).cast("int") == F.col("_salt")), "left").drop("_host", "_salt"), None

    def add(totals: dict, key: tuple, to: list[int], texts: list[int], own: list[int]) -> None:
        totals[*key, -1][0] += 1
        for slot, text in zip(to, texts, strict=True):
            if slot >= 0 and text:
                pair = totals[*key, slot]
                pair[0] += 1
                pair[1] += text == own[slot]

    def sums(totals: dict) -> pa.RecordBatch:
        keys = list(totals)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([totals[k][0] for k in keys], pa.int64()), pa.array([totals[k][1] for k in keys], pa.int64())], ["host", "like", "slot", "pages", "equal"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts by likeness to the wrapper's page: -1 without text, else twentieths, from 100 on for pages that may be copies; slot -1 counts pages."""
        totals: dict[tuple[str, int, int], list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for host, tree, to, found in aligned(batch):
                if not to:
                    continue
                texts = _own_text(tree)
                _, every, equal = _compared(tree, texts, to, found[1])
                if every == 0 or equal < every:
                    add(totals, (host, 20 * equal // every + 100 * (equal >= same * every) if every else -1), to, texts, found[1])
            if len(totals) > 500_000:
                yield sums(totals)
                totals.clear()
        if totals:
            yield sums(totals)

    types = "host string, like int, slot int, pages long, equal long"
    counts = materialise(given.select("host", "html", "wrapper").mapInArrow(count, types).groupBy("host", "like", "slot").agg(F.sum("pages").alias("pages"), F.sum("equal").alias("equal")), "slots")
    by_like = counts.where("slot = -1 and like >= 0").withColumn("upto", F.sum("pages").over(Window.partitionBy("host").orderBy("like"))).withColumn("every", F.sum("pages").over(Window.partitionBy("host")))
    far = by_like.groupBy("host").agg(F.coalesce(F.min(F.when((F.col("upto") >= least_pages) & (F.col("upto") >= FAR * F.col("every")), F.col("like"))), F.max("like")).alias("far"), F.max("like").alias("most")).where("most >= 100").select(F.col("host").alias("_host"), "far")
    unlike = counts.join(far, F.col("host") == F.col("_host")).where("like between 0 and far").groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.sum("equal").alias("equal"))
    unlike = unlike.withColumn("every", F.max(F.when(F.col("slot") == -1, F.col("pages"))).over(Window.partitionBy("host")))
    unlike = materialise(unlike.groupBy("host").agg(F.collect_list(F.when((F.col("slot") >= 0) & (2 * F.col("pages") >= F.col("every")) & (F.col("equal") >= same * F.col("pages")), F.col("slot"))).alias("slots")), "boilerplate")
    likely, boilerplate = with_slots(unlike)

    def count_like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int, int], list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            held_slots = iter(batch.column("slots").to_pylist())
            for host, tree, to, found in aligned(batch, boilerplate.value if small else None):
                known = boilerplate.value[host] if small else next(held_slots)
                if not to or known is None:
                    continue
                texts = _own_text(tree)
                _, every, equal = _compared(tree, texts, to, found[1])
                if same * every <= equal < every and not _copies(tree, texts, to, found[2], found[1], frozenset(known), same):
                    add(totals, (host, 100), to, texts, found[1])
            if len(totals) > 500_000:
                yield sums(totals)
                totals.clear()
        if totals:
            yield sums(totals)

    counts = counts.where("like < 100").unionByName(likely.select("host", "html", "wrapper", "slots").mapInArrow(count_like, types))
    constant = counts.where("slot >= 0").groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.sum("equal").alias("equal")).where((F.col("pages") >= least_pages) & (F.col("equal") >= same * F.col("pages")))
    given, table = with_slots(materialise(constant.groupBy("host").agg(F.collect_list("slot").alias("slots")), "templates"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column("slots").to_pylist()
            texts = [extract(tree, table.value.get(host, frozenset()) if small else frozenset(own or ()), to) for own, (host, tree, to, _) in zip(slots, aligned(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(x) for x in texts], "i8"))], ["page_id", "url", "text", "n_chars"])

    return given.mapInArrow(read, "page_id long, url string, text string, n_chars long")
