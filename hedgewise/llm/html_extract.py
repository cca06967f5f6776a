"""Main text of web pages by wrapper induction.

Pages of one host are aligned as trees of block elements by simple tree matching: equal neighbours fold into one node, and
two lists of children are matched in order so that most nodes meet. A host's wrapper is such a tree with, per node, how
many pages have it and how much text stands there; the pages that have a text at a path are counted beside it, by rows.
Texts that most pages repeat at a path are template; the node under which the varying text lies is the content. Elements
that say what they are (menus, footers, forms, adverts, comments and the like) never count as content.

Wrappers are built per task and merged in a tree of groups, so no host, however large, meets in one task as pages.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewise.plans import keyed_join, written

#: Share of a host's pages that must repeat a text at a path for it to be template, and the pages it takes to tell.
REPEATED, LEAST_PAGES = 0.6, 4
#: Share of the text at hand that a child must have to be gone into: one that calls itself the content, and any other.
NAMED_SHARE, CONTENT_SHARE = 0.1, 0.7
#: A wrapper beyond so many nodes drops those that less than one page in fifty has; they cannot be template.
NODES_MAX = 2000
#: Elements nested deeper are no nodes of their own: their blocks are those of the element that is so deep.
DEPTH_MAX = 100
#: Wrappers a task builds at once; the rest go out before.
HOSTS_AT_ONCE = 500
#: First-level groups of a host's partial wrappers.
GROUPS = 32
#: Hosts whose decisions are broadcast together, at most; beyond, pages and decisions are joined by a shuffle.
HOSTS_MAX = 20_000

# Elements by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg math iframe object canvas select".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td"
    " tfoot th thead tr ul caption head".split()
)
NOT_CONTENT = set("head nav footer aside form menu dialog button fieldset".split()) | RAW
ENDS_P = BLOCK - {"option", "optgroup", "legend"}
#: Stands for the names of all blocks but paragraphs and headings.
OTHERS = "*"
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = set("html body div section article main table tbody tr td center".split())
#: An opening tag closes open ones of its own group, up to the nearest element of the second set.
SIBLINGS = {
    **{t: ({"li"}, {"ul", "ol", "menu"}) for t in ["li"]},
    **{t: ({"dt", "dd"}, {"dl"}) for t in ("dt", "dd")},
    **{t: ({"td", "th"}, {"tr", "table"}) for t in ("td", "th")},
    "tr": ({"tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# Words in class, id or role that name what is not the article.
NAMED = set(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion cookie"
    " cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar side"
    " widget widgets menu nav navbar navigation navlinks breadcrumb breadcrumbs masthead footer foot copyright comment"
    " comments commentlist reply replies respond discussion disqus share sharing social related recommended recommendations"
    " pagination pager toolbar login search skip hidden form contentinfo complementary tags outbrain taboola".split()
)
HEADER = {"header", "head", "topbar", "top"}
WHOLE = {"article", "main", "content", "post", "entry", "story"}

#: A comment's or declaration's start, or a tag. Quoted values may be of any length, those with angle brackets up to 120
#: characters, so that an unclosed quotation is given up soon; what remains is a tag up to its next angle bracket, or text.
TOKEN = re.compile(
    r"""<!--|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/><]*)"""
    r"""((?>[^<>"']++|"[^"<>]*+"|'[^'<>]*+'|"[^"]{0,120}+"|'[^']{0,120}+'){0,60}+|[^<>]*)>"""
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """A block element; children are nodes and pieces of text in page order."""

    __slots__ = ("tag", "key", "dropped", "header", "children")

    def __init__(self, tag: str, key: str, dropped: bool = False, header: bool = False):
        self.tag, self.key, self.dropped, self.header = tag, key, dropped, header
        self.children: list[Node | str] = []


def _opened(tag: str, attributes: str) -> Node:
    words: list[str] = []
    hidden = False
    if attributes and not attributes.isspace():
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id", "role"):
                words += [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w]
            hidden |= name == "hidden" or (name == "aria-hidden" and value == "true")
            hidden |= name == "style" and bool(re.search(r"display\s*:\s*none", value))
    own = set(words)
    named = bool(own & NAMED) and tag not in ("html", "body", "article", "main")
    header = tag == "header" or (bool(own & HEADER) and tag not in HEADINGS | {"html", "body", "head"})
    key = ".".join([tag, *sorted(own)])
    return Node(tag, key, tag in NOT_CONTENT or named or hidden, header)


def parsed(page: str) -> Node:
    """The page's tree of blocks. Inline elements leave their text behind; raw elements, comments and markup nothing."""
    root = Node("html", "html")
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # where on the stack elements of a name are
    dropped_inline: list[str] = []  # open inline elements that are not content

    def text(piece: str) -> None:
        if piece and not dropped_inline:
            stack[-1].children.append(piece)

    def names(tag: str) -> tuple[str, ...]:
        return (tag,) if tag == "p" or tag in HEADINGS else (tag, OTHERS)

    def innermost(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(depth: int) -> None:
        while len(stack) > depth:
            if len(stack) > DEPTH_MAX:
                stack[-1].children.append(Node("hr", "hr"))  # what follows is another block
            for name in names(stack.pop().tag):
                places[name].pop()

    while match := TOKEN.search(page, at):
        text(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            if match[0] == "<!--":
                end = page.find("-->", at)
                at = len(page) if end < 0 else end + 3
            continue
        tag = match[2].lower()
        if match[1]:
            if dropped_inline:
                if tag == dropped_inline[-1]:
                    dropped_inline.pop()
                    continue
                if tag not in BLOCK:
                    continue
                dropped_inline.clear()
            if tag in BLOCK and (depth := innermost({tag})):
                close(depth)
            continue
        if tag in RAW:
            if not match[3].endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            text(" ")
        elif tag == "hr":
            stack[-1].children.append(Node("hr", "hr"))
        if tag in VOID:
            continue
        if tag not in BLOCK:
            if dropped_inline or (match[3] and _opened(tag, match[3]).dropped) or tag == "button":
                if not match[3].endswith("/"):
                    dropped_inline.append(tag)
            continue
        dropped_inline.clear()
        if tag in ("html", "body"):
            continue
        if tag in SIBLINGS:
            closes, until = SIBLINGS[tag]
            if (depth := innermost(closes)) > innermost(until):
                close(depth)
        if tag in ENDS_P:
            # through headings a heading ends the paragraph around them, any other block only the innermost element
            depth = innermost({"p"})
            if depth and depth > (innermost({OTHERS}) if tag in HEADINGS else len(stack) - 2):
                close(depth)
        node = _opened(tag, match[3])
        if len(stack) < DEPTH_MAX:
            stack[-1].children.append(node)
        elif not node.dropped:
            stack[-1].children.append(Node("hr", "hr"))
            node.children = stack[-1].children
        for name in names(tag):
            places.setdefault(name, []).append(len(stack))
        stack.append(node)
    text(page[at:])
    return root


def clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def runs(node: Node) -> Iterator[str | Node]:
    """A node's blocks of text, cleaned, and its block children, in order."""
    held: list[str] = []
    for child in node.children:
        if isinstance(child, str):
            held.append(child)
            continue
        if held and (block := clean("".join(held))):
            yield block
        held = []
        yield child
    if held and (block := clean("".join(held))):
        yield block


def mark(text: str) -> int:
    """A text's or a path's 64-bit hash."""
    data = text.encode()
    return crc32(data) << 32 | crc32(data[::-1] + b"#")


# A wrapper node is a list: key, pages, characters, {text hash: pages}, children.
KEY, PAGES, CHARS, TEXTS, CHILDREN = range(5)


def wrapper(node: Node, inside: bool = False) -> list:
    """A page's tree as the wrapper of one page; what is not content stays outside it."""
    inside = inside or node.tag in ("article", "main") or bool(WHOLE & set(node.key.split(".")[1:]))
    out = [node.key, 1, 0, {}, []]
    for item in runs(node):
        if isinstance(item, str):
            out[CHARS] += len(item)
            out[TEXTS][str(mark(item))] = 1
        elif not item.dropped and (inside or not item.header):
            child = wrapper(item, inside)
            if out[CHILDREN] and out[CHILDREN][-1][KEY] == child[KEY]:
                merge(out[CHILDREN][-1], child, 0)
            else:
                out[CHILDREN].append(child)
    return out


def texts_taken(node: list, path: str | None = None) -> set[int]:
    """The marks of (path, text) of a page's wrapper, which is left without texts, so that it grows by its nodes alone."""
    path = f"{path}>{node[KEY]}" if path else node[KEY]
    own = mark(path)
    marks = {own ^ int(k) for k in node[TEXTS]}
    node[TEXTS] = {}
    for c in node[CHILDREN]:
        marks |= texts_taken(c, path)
    return marks


def similarity(a: list, b: list) -> int:
    """Nodes that a simple tree matching pairs: equal roots, children matched in order."""
    if a[KEY] != b[KEY]:
        return 0
    return 1 + _table(a[CHILDREN], b[CHILDREN])[0][-1][-1]


def _table(left: list, right: list) -> tuple[list[list[int]], list[list[int]]]:
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    alike = [[0] * len(right) for _ in left]
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            alike[i][j] = similarity(a, b)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + alike[i][j])
    return best, alike


def merge(a: list, b: list, more: int = 1) -> None:
    """Align wrapper ``b`` with ``a`` and add it there; ``more`` is 0 where both are of one page."""
    a[PAGES] += b[PAGES] * more
    a[CHARS] += b[CHARS]
    for k, n in b[TEXTS].items():
        a[TEXTS][k] = a[TEXTS].get(k, 0) + n * more if k in a[TEXTS] else n
    left, right = a[CHILDREN], b[CHILDREN]
    if [x[KEY] for x in left] == [x[KEY] for x in right]:  # the usual case needs no table
        for x, y in zip(left, right, strict=True):
            merge(x, y, more)
        return
    best, alike = _table(left, right)
    out, i, j = [], len(left), len(right)
    while i or j:
        if i and j and alike[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + alike[i - 1][j - 1]:
            i, j = i - 1, j - 1
            merge(left[i], right[j], more)
            out.append(left[i])
        elif i and (not j or best[i][j] == best[i - 1][j]):
            i -= 1
            out.append(left[i])
        else:
            j -= 1
            out.append(right[j])
    a[CHILDREN] = out[::-1]


def _size(node: list) -> int:
    return 1 + sum(map(_size, node[CHILDREN]))


def _pruned(node: list, least: float) -> None:
    node[CHILDREN] = [c for c in node[CHILDREN] if c[PAGES] >= least]
    for c in node[CHILDREN]:
        _pruned(c, least)


def merged(wrappers: Iterator[list]) -> list | None:
    whole = None
    for own in wrappers:
        if whole is None:
            whole = own
            continue
        merge(whole, own)
        if _size(whole) > NODES_MAX:
            _pruned(whole, whole[PAGES] / 50)
    return whole


def decided(whole: list) -> str:
    """The path of the content's node."""
    def chars(node: list) -> int:
        return node[CHARS] + sum(map(chars, node[CHILDREN]))

    node, path = whole, whole[KEY]
    while True:
        total = chars(node)
        options = [c for c in node[CHILDREN] if c[KEY].split(".")[0] in CONTAINERS]
        named = [c for c in options if WHOLE & set(c[KEY].split(".")) and chars(c) >= NAMED_SHARE * total]
        headed = any(c[KEY].split(".")[0] in ("h1", "h2") for c in node[CHILDREN])
        best = max(named or options, key=chars, default=None)
        if best is None or (not named and (headed or chars(best) < CONTENT_SHARE * total)):
            break
        node, path = best, f"{path}>{best[KEY]}"
        if node[KEY].split(".")[0] == "article":
            break
    return path


def blocks(root: Node, path: str, template: frozenset[int]) -> list[str]:
    """The content's blocks of a page: what stands below the path and is not template; where that leaves nothing, all of
    the content; where the page has no such path, that of its own wrapper."""
    found: list[tuple[str, int]] = []

    def walk(node: Node, own: str, inside: bool, taking: bool) -> None:
        taking = taking or own == path
        inside = inside or taking or node.tag in ("article", "main")
        for item in runs(node):
            if isinstance(item, str):
                if taking:
                    found.append((item, mark(own) ^ mark(item)))
            elif not item.dropped:
                if item.header:
                    if inside and taking:  # of a header only its headings are the article's
                        found.extend((x, 0) for x in headings(item))
                else:
                    walk(item, f"{own}>{item.key}", inside, taking)

    walk(root, root.key, False, False)
    kept = [x for x, m in found if m not in template]
    return kept or [x for x, _ in found]


def headings(node: Node) -> Iterator[str]:
    for item in runs(node):
        if isinstance(item, Node) and not item.dropped:
            if item.tag in HEADINGS:
                yield from (x for x in runs(item) if isinstance(x, str))
            else:
                yield from headings(item)


def main_text(page: str, path: str | None, template: frozenset[int]) -> str:
    root = parsed(page)
    found = blocks(root, path, template) if path else []
    if not found:
        found = blocks(root, decided(wrapper(root)), frozenset())
    return "\n".join(found)


def host() -> F.Column:
    """The url's host, without port and ``www``; an empty one where there is none."""
    return F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1), F.lit(""))


def _signed(marks: set[int]) -> list[int]:
    return [m - (1 << 64) if m >= 1 << 63 else m for m in marks]


def by_host(rows: DataFrame, hosts: DataFrame, how: str) -> DataFrame:
    """Rows with the columns of their host. ``hosts`` should be written, since it is counted."""
    if hosts.count() <= HOSTS_MAX:
        return rows.join(F.broadcast(hosts), "host", how)
    return keyed_join(rows, hosts, ["host"], how)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, path, template) of every host."""
    ddl = "host string, part long, tree string"
    schema = pa.schema(
        [("host", pa.string()), ("part", pa.int64()), ("tree", pa.string()), ("marks", pa.list_(pa.int64()))]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Wrappers of the task's hosts, and a row with the marks of each page."""
        from pyspark import TaskContext

        trees: dict[str, list] = {}
        task = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            rows = [list(trees), [task] * len(trees), [json.dumps(t) for t in trees.values()], [None] * len(trees)]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

        for batch in batches:
            marks = []
            for name, page in zip(batch.column(0), batch.column(1), strict=True):
                name, own = name.as_py(), wrapper(parsed(page.as_py()))
                marks.append(_signed(texts_taken(own)))
                if name not in trees:
                    if len(trees) >= HOSTS_AT_ONCE:
                        yield out()
                        trees.clear()
                    trees[name] = own
                    continue
                merge(trees[name], own)
                if _size(trees[name]) > NODES_MAX:
                    _pruned(trees[name], trees[name][PAGES] / 50)
            n = len(marks)
            yield pa.record_batch(
                [batch.column(0), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(marks, schema.field("marks").type)],
                schema=schema,
            )
        yield out()

    def join(table: pa.Table) -> pa.Table:
        whole = merged(json.loads(x.as_py()) for x in table["tree"])
        return pa.table({"host": table["host"][:1], "part": pa.array([0], pa.int64()), "tree": [json.dumps(whole)]})

    def decide(table: pa.Table) -> pa.Table:
        whole = merged(json.loads(x.as_py()) for x in table["tree"])
        return pa.table({"host": table["host"][:1], "path": [decided(whole)], "pages": pa.array([whole[PAGES]], pa.int64())})

    rows = pages.where("html IS NOT NULL").select(host().alias("host"), F.col("html").cast("string"))
    partial = written(rows.mapInArrow(build, f"{ddl}, marks array<long>"), "partial-wrappers")
    trees = partial.where("tree IS NOT NULL").select("host", "part", "tree")
    grouped = trees.groupBy("host", F.pmod("part", F.lit(GROUPS))).applyInArrow(join, ddl)
    decisions = written(grouped.groupBy("host").applyInArrow(decide, "host string, path string, pages long"), "decisions")
    # one row for each text of a page; counts are added up in the tasks before they meet
    seen = partial.where("marks IS NOT NULL").select("host", F.explode("marks").alias("mark"))
    counts = seen.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    repeated = by_host(counts, decisions.select("host", "pages"), "inner").where(F.col("n") >= REPEATED * F.col("pages"))
    templates = repeated.groupBy("host").agg(F.collect_list("mark").alias("template"))
    return decisions.select("host", "path").join(templates, "host", "left")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and host of every page.

    A null or empty html gives an empty text. Pages without a url share the empty host. A host of fewer than LEAST_PAGES
    pages has no template texts, only a content node. Repeated rows are extracted each for itself and count as pages each.
    An empty table gives no rows. Only page_id, url and html are read.
    """
    known = written(wrappers(pages), "wrappers")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host().alias("host"))
    rows = by_host(rows, known, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sets = [], {}
            for name, page, path, template in zip(*(batch.column(c) for c in ("host", "html", "path", "template")), strict=True):
                name = name.as_py()
                if name not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[name] = frozenset(m % (1 << 64) for m in template.as_py() or ())
                texts.append(main_text(page.as_py(), path.as_py(), sets[name]) if page.is_valid else "")
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), batch.column("host")],
                names=["page_id", "url", "text", "n_chars", "host"],
            )

    return rows.select("page_id", "url", "html", "host", "path", "template").mapInArrow(
        run, "page_id long, url string, text string, n_chars long, host string"
    )
