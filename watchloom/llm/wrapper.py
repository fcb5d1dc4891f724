"""Main text of web pages by wrapper induction.

Method
------
Pages of one host come from one template.  For each host a bounded sample of pages
(``sample`` of them, those that come first under as many hash orders of page_id, a
documented parameter) is parsed, and their DOM trees are aligned pairwise by simple
tree matching, with runs of like siblings folded to one node so that trees stay
small.  Matched nodes whose text varies are slots.  Template are the texts that at
least ``constant`` of the host's different pages that have the text's path (elements
and their names) show there, and two of them; they are counted over all pages, so
that a layout's boilerplate is found however rare the layout is.  The wrapper of a host is the hash set of its template texts and
the paths of its slots.  Every page, sampled or not, is then read with its host's
wrapper: the content root is the page's article or main element, unless most of the
slots' text is elsewhere, else the smallest element that holds most of that text; menus, headers, footers, asides, forms, scripts, styles and
blocks that name themselves adverts, notices, sidebars or comments are left out
(html, body, main, an only article and blocks with most of the text are never such),
and so is template text.  A paragraph or heading of the article itself is template
only if three pages have it (the same passage may well be content of two pages).

Only ids are grouped to choose the sample, and a group of the induction holds at
most ``sample`` pages; a host with a third of all pages is split over tasks when
its pages are joined with its wrapper.

Defined results: null or empty html gives empty text.  A page without url has no
wrapper and is read on its own, as is a host with one page.  Rows that repeat a
page_id are all returned.  Further columns are not looked at.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.textops import pieces, saved

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select option object canvas".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li summary tbody td tfoot th thead tr figcaption".split())
LEFT_OUT = frozenset("nav header footer aside form head script style noscript template iframe svg select button object canvas menu dialog textarea title".split())
#: Words in class, id or role by which a block says what it is.
BOILER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|gdpr|sidebar|side-bar|widget|comments?|comment-list|respond|reply|replies|disqus|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommend\w*|newsletter|subscribe|popup|modal|pagination|pager|toolbar|search|login|signup)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
#: The same of inline elements, whose text is cut out of their block.
INLINE_BOILER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|share|sharing|newsletter|subscribe)(?:$|[\s_-])", re.I)
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
CONTENT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption article main".split())


class Node:
    """An element: tag, whether it names itself boilerplate, children (nodes) and the blocks of its own text.

    path is a hash of the elements and their names from the root; article tells
    whether one of them is an article or main element.
    """

    __slots__ = ("tag", "mark", "boiler", "items", "path", "article")

    def __init__(self, tag: str, mark: str, boiler: bool, above: Node | None):
        self.tag, self.mark, self.boiler, self.items = tag, mark, boiler, []
        self.path = text_key(above.path, f"{tag}.{mark.lower()}") if above else 0
        self.article = bool(above and above.article) or tag in ("article", "main")


def clean(pieces_: list[str]) -> str:
    return " ".join(htmllib.unescape("".join(pieces_)).split())


def marks_of(attributes: str) -> str:
    """Class, id and role of an element."""
    return " ".join(a[1] or a[2] or a[3] for a in _ATTR.findall(attributes)) if "=" in attributes else ""


def parse(page: str) -> Node:
    """The tree of block elements; items are text blocks (str) and nodes in page order.  Inline markup is dropped."""
    root = Node("#page", "", False, None)
    stack, text, at = [root], [], 0
    tag, mute, nested = _TAG, "", 0  # mute: name of the inline element whose text is cut out

    def flush() -> None:
        if text:
            block = clean(text)
            text.clear()
            if block:
                stack[-1].items.append(block)

    n = len(page)
    while at < n:
        o = _OPEN.search(page, at)
        if not mute:
            text.append(page[at : o.start()] if o else page[at:])
        if o is None:
            break
        at = o.start()
        if page.startswith(("<!--", "<![CDATA["), at):
            end = "-->" if page[at + 2] == "-" else "]]>"
            close = page.find(end, at + 4)
            at = close + 3 if close >= 0 else n
            continue
        if page[at + 1] in "!?":
            close = page.find(">", at)
            at = close + 1 if close >= 0 else n
            continue
        m = tag.match(page, at)
        if m is None and tag is _TAG and not page.startswith("</", at):
            # a quote is open up to the page's end: from here on quotes don't count, so each place is read once
            tag = _BARE_TAG
            m = tag.match(page, at)
        if m is None:
            close = page.find(">", at)
            at = close + 1 if close >= 0 else n
            continue
        at = m.end()
        name = m[2].lower()
        if mute:
            if name in BLOCK or name == "button":
                mute = ""
            else:
                nested += (name == mute) * (-1 if m[1] else 1)
                if not nested:
                    mute = ""
                if name not in RAW:
                    continue
        if m[1]:
            if name in BLOCK or name in ("button",):
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
                if depth:
                    flush()
                    del stack[depth:]
                elif name == "p":
                    flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else n
            continue
        if name in VOID:
            if name in ("hr", "img"):
                text.append(" ")
            continue
        if name not in BLOCK and name != "button":
            # inline element: its text belongs to the block, unless it is an advert or the like
            if not m[1] and "=" in m[3] and not m[3].endswith("/") and INLINE_BOILER.search(marks_of(m[3])):
                mute, nested = name, 1
            continue
        flush()
        if name in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        elif name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in same:
                    del stack[i:]
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "menu") or (name in ("td", "th") and stack[i].tag == "tr"):
                    break
        marks = marks_of(m[3])
        node = Node(name, marks, bool(marks and BOILER.search(marks)), stack[-1])
        stack[-1].items.append(node)
        if not m[3].endswith("/"):
            stack.append(node)
    flush()
    return root


def heed_names(root: Node) -> Node:
    """Takes the mark of boilerplate from blocks whose name can't mean that: layout states of the page, and what holds its content."""
    order = list(walk(root))
    for n in order:
        if n.tag in ("html", "body", "main"):
            n.boiler = False
    size, heads = {}, {}
    for n in reversed(order):
        kids = [x for x in n.items if isinstance(x, Node)]
        size[id(n)] = sum(len(x) for x in n.items if isinstance(x, str)) + sum(size[id(x)] for x in kids if x.tag not in LEFT_OUT)
        heads[id(n)] = (n.tag == "h1") + sum(heads[id(x)] for x in kids)

    def free(article: bool) -> Iterator[Node]:
        todo = [root]
        while todo:
            n = todo.pop()
            if n.tag in LEFT_OUT or n.boiler and not (article and n.tag == "article"):
                continue
            if n.tag in ("article", "main"):
                yield n
            todo.extend(x for x in n.items if isinstance(x, Node))

    if next(free(False), None) is None:
        for n in order:
            if n.boiler and 2 * size[id(n)] > size[id(root)]:
                n.boiler = False
        if next(free(False), None) is None:
            for n in list(free(True)):
                n.boiler = False
    for n in order:
        # a header, other than the site's own element, around the only h1
        if n.boiler and heads[id(n)] == heads[id(root)] == 1 and HEADER.search(n.mark) and (n.tag != "header" or n.article):
            n.boiler = False
    return root


def own_text(node: Node) -> str:
    return "\n".join(x for x in node.items if isinstance(x, str))


class Folded:
    """A node for matching: like siblings (same tag and marks) are one node with all their texts.

    What lies deeper than ``depth`` elements is matched as the texts of the node there.
    """

    __slots__ = ("key", "path", "article", "texts", "kids")

    def __init__(self, nodes: list[Node], depth: int = 100):
        self.key, self.path, self.article = (nodes[0].tag, nodes[0].mark), nodes[0].path, nodes[0].article
        self.texts = [t for n in nodes for x in ((n,) if depth else walk(n)) if (t := own_text(x))]
        runs: dict[tuple[str, str], list[Node]] = {}
        for n in nodes if depth else ():
            for x in n.items:
                if isinstance(x, Node):
                    runs.setdefault((x.tag, x.mark), []).append(x)
        self.kids = [Folded(r, depth - 1) for r in runs.values()]


def tree_match(a: Folded, b: Folded, pairs: list[tuple[Folded, Folded]] | None = None) -> int:
    """Simple tree matching: the size of the largest matching that keeps order and ancestry; pairs gets its nodes."""
    if a.key != b.key:
        return 0
    m, n = len(a.kids), len(b.kids)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    inner = [[0] * n for _ in range(m)]
    for i in range(m):
        for j in range(n):
            inner[i][j] = tree_match(a.kids[i], b.kids[j])
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + inner[i][j])
    if pairs is not None:
        pairs.append((a, b))
        i, j = m, n
        while i and j:
            if inner[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + inner[i - 1][j - 1]:
                tree_match(a.kids[i - 1], b.kids[j - 1], pairs)
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return best[m][n] + 1


def text_key(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\x00{text}") - (1 << 63)


def induce(pages: list[str], constant: float = 0.6) -> tuple[list[int], list[int]]:
    """(hashes of template texts, paths of varying slots) of one host's pages."""
    trees = [Folded([parse(p)]) for p in dict.fromkeys(pages)]
    if len(trees) < 2:
        return [], []
    seen: dict[int, set[int]] = {}
    slots: dict[int, int] = {}
    within: set[int] = set()  # texts of paragraphs and the like in an article: two pages may share one by chance
    for i in range(len(trees)):
        for j in range(i + 1, len(trees)):
            pairs: list[tuple[Folded, Folded]] = []
            tree_match(trees[i], trees[j], pairs)
            for a, b in pairs:
                both = set(a.texts) & set(b.texts)
                for t in both:
                    key = text_key(a.path, t)
                    seen.setdefault(key, set()).update((i, j))
                    if a.key[0] in CONTENT_TAGS and a.article:
                        within.add(key)
                if len(both) < max(len(set(a.texts)), len(set(b.texts))):
                    slots[a.path] = slots.get(a.path, 0) + 1
    least = max(2, constant * len(trees))
    return sorted(k for k, v in seen.items() if len(v) >= (max(least, 3) if k in within else least)), sorted(p for p, v in slots.items() if 3 * v >= len(trees))


def blocks(node: Node, template: set[int], inside: bool, paths: set[int] | None = None) -> Iterator[str]:
    """Content blocks below a node in page order, of these paths if given; iterative, as pages may nest deeply."""
    stack = [iter(node.items)]
    where = [(node, inside)]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            where.pop()
            continue
        parent, article = where[-1]
        if isinstance(x, str):
            if (paths is None or parent.path in paths) and (not template or text_key(parent.path, own_text(parent)) not in template):
                yield x
        elif x.tag not in LEFT_OUT and not x.boiler or (x.tag == "header" and article and not x.boiler):
            stack.append(iter(x.items))
            where.append((x, article))


def walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(x for x in reversed(n.items) if isinstance(x, Node))


def slot_sizes(root: Node, template: set[int], paths: set[int]) -> dict[int, int]:
    """Characters of the slots' blocks in and below each node, by its id."""
    size: dict[int, int] = {}
    for n in reversed(list(walk(root))):
        own = n.path in paths and (not template or text_key(n.path, own_text(n)) not in template)
        size[id(n)] = sum((len(x) if own else 0) if isinstance(x, str) else size[id(x)] * (x.tag not in LEFT_OUT and not x.boiler) for x in n.items)
    return size


def extract(page: str | None, template: list[int] | None = None, slots: list[int] | None = None) -> str:
    """The main text of one page, read with its host's wrapper if there is one."""
    if not page:
        return ""
    root, known = heed_names(parse(page)), set(template or ())
    # the outermost articles: a teaser inside a boilerplate block is none
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag in LEFT_OUT or n.boiler:
            continue
        if n.tag in ("article", "main"):
            inner = [x for x in walk(n) if x is not n and x.tag == "article" and not x.boiler] if n.tag == "main" else []
            found.extend(inner[:1] if len(inner) == 1 else [n])
            continue
        todo.extend(x for x in reversed(n.items) if isinstance(x, Node))
    paths = set(slots or ())
    size = sum(len(b) for b in blocks(root, known, False, paths)) if paths else 0
    # the page's articles, unless most of the varying text is elsewhere
    if found and 2 * sum(len(b) for n in found for b in blocks(n, known, True, paths)) >= size:
        text = "\n".join(b for n in found for b in blocks(n, known, True))
        # an article of nothing but template is a copy of the others
        return text or "\n".join(b for n in found for b in blocks(n, set(), True))
    if size:
        # the smallest subtree that holds most of the text of the slots
        best, below = root, slot_sizes(root, known, paths)
        while True:
            kids = [(below[id(x)], i, x) for i, x in enumerate(best.items) if isinstance(x, Node) and x.tag not in LEFT_OUT and not x.boiler and x.tag not in CONTENT_TAGS]
            top = max(kids, default=None)
            if top is None or top[0] < 0.7 * size:
                break
            best = top[2]
        return "\n".join(blocks(best, known, False))
    return "\n".join(blocks(root, known, False))


def host_of(url: str) -> F.Column:
    """The host of an http(s) url in lower case; null if there is none."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def count_batches(most: int = 200_000):
    """A mapInArrow function (host, html, weight) -> (host, path, text, n): pages with a text at a path, and (text null) with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, int, int | None, bool], float] = {}

        def out() -> pa.RecordBatch:
            cols = zip(*((h, p, t, w, x) for (h, p, t, w), x in n.items()), strict=True) if n else [[]] * 5
            got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.float64()), strict=True)], names=["host", "path", "text", "within", "n"])
            n.clear()
            return got

        for batch in batches:
            for part in pieces(batch):
                for host, page, weight in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    seen = set()
                    for x in walk(parse(page)):
                        if text := own_text(x):
                            seen.add((host, x.path, None, False))
                            seen.add((host, x.path, text_key(x.path, text), x.tag in CONTENT_TAGS and x.article))
                    for key in seen:
                        n[key] = n.get(key, 0.0) + weight
                if len(n) > most:
                    yield out()
        yield out()

    return run


def templates(pages: DataFrame, constant: float = 0.6) -> DataFrame:
    """(host, template array<long>): texts on most of the host's different pages that have their path, counted over all of them."""
    rows = pages.where("host is not null and html is not null").select("host", "html", F.xxhash64("html").alias("h"))
    # copies of one page count as one page
    copies = saved(rows.groupBy("host", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    rows = rows.join(copies, ["host", "h"], "left").select("host", "html", (1.0 / F.coalesce("c", F.lit(1))).alias("weight"))
    n = saved(rows.mapInArrow(count_batches(), "host string, path long, text long, within boolean, n double").groupBy("host", "path", "text", "within").agg(F.sum("n").alias("n")).where("text is null or n > 1.5"))
    every = n.where("text is null").select("host", "path", F.col("n").alias("every"))
    least = F.greatest(F.when(F.col("within"), 3.0).otherwise(2.0), F.col("every") * constant)
    return n.where("text is not null").join(every, ["host", "path"]).where(F.col("n") >= least - 1e-6).groupBy("host").agg(F.sort_array(F.collect_set("text")).alias("template"))


def wrappers(pages: DataFrame, sample: int = 6, constant: float = 0.6) -> DataFrame:
    """(host, template array<long>, slots array<long>) for each host with two pages or more: template texts counted over all pages, slots from matched ones."""
    ids = pages.where("host is not null and html is not null and page_id is not null").select("host", "page_id")
    picks = [F.min_by("page_id", F.xxhash64(F.lit(i), "page_id")).alias(f"p{i}") for i in range(sample)]
    chosen = ids.groupBy("host").agg(*picks).select("host", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(sample)]))).alias("page_id"))
    rows = pages.select("host", "page_id", "html").join(chosen, ["host", "page_id"], "left_semi")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = table.sort_by("page_id")
        template, slots = induce(order.column("html").to_pylist(), constant)
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "template": pa.array([template], pa.list_(pa.int64())), "slots": pa.array([slots], pa.list_(pa.int64()))})

    matched = rows.groupBy("host").applyInArrow(run, "host string, template array<long>, slots array<long>").drop("template")
    got = matched.join(templates(pages, constant), "host", "full").select("host", F.coalesce("template", F.array().cast("array<long>")).alias("template"), F.coalesce("slots", F.array().cast("array<long>")).alias("slots"))
    return got.where("size(template) + size(slots) > 0")


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            texts = [extract(*row) for row in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, sample: int = 6, constant: float = 0.6) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html, ...)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host_of("url"))
    known = saved(wrappers(rows, sample, constant))
    # the wrappers are small beside the pages; the join may split a large host
    read = rows.join(known, "host", "left").select("page_id", "url", "html", "template", "slots")
    return read.mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")
