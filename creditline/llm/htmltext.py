"""Main text of web pages by site template removal.

A page is parsed once into blocks of text and the hashes of its element
subtrees, each with the run of blocks it encloses.  Spark counts each subtree per host, once per distinct
page content, so that copies of one page do not make a template of its article.
Subtrees that stand on many pages of their host are template and are deleted
with all they hold.  Regions that HTML itself or their class names mark as no
part of the article (menus, headers, footers, asides, forms, notices, adverts,
comments, scripts, styles) are left out on any page.

The article is what <article> elements hold, else <main>, else the body.  The
article and the elements around it are never template, and neither are single
elements of prose in an article (paragraphs, headings, quotations, code, table
cells): articles quote and repeat one another.  Containers in an article (div,
section, list, table) that hold prose are template only on more pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditline.llm.common import stored

#: A subtree is template on at least so many distinct pages of its host, and at least this share of them
#: or this many pages, whichever is less.
MIN_PAGES = 5
MIN_SHARE = 0.01
MANY_PAGES = 50
#: A container of prose in an article is template on at least so many distinct pages.
PROSE_PAGES = 20

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p "
    "plaintext pre search section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - frozenset("body head html caption tbody td tfoot th thead tr title option optgroup button legend".split())
DROPPED = frozenset(
    "head script style noscript template nav header footer aside form button select input textarea iframe object embed applet "
    "canvas svg audio video dialog menu search datalist title math".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd figcaption".split())
CONTAINERS = frozenset("center details div dl fieldset ol section table ul".split())
#: Opening one of these ends an open element of the listed kinds, up to the nearest of the last set.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})), "body": (frozenset({"head"}), frozenset()),
}
SPANS = pa.list_(pa.struct([("subtree", pa.int64()), ("first", pa.int32()), ("until", pa.int32())]))
#: Words of class and id attributes that mark what is no part of the article.
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead banner cookie cookies consent notice gdpr "
    "ad ads advert adverts advertisement adsense sponsor sponsored promo popup modal newsletter subscribe signup share sharing "
    "social comment comments disqus replies related recommended pagination pager toolbar skip alert".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+))|([^\s=/]+)")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMENT = re.compile(r"(?:^|\s)class\s*=\s*[\"']?(?:[^\"'>]*\s)?comment(?:$|[\s\"'_-])", re.I)
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)|^\s*([^/?#:\s]+\.[^/?#:\s]+)")


@dataclass
class Node:
    tag: str
    attrs: str = ""
    parent: Node | None = None
    parts: list[Node | str] = field(default_factory=list)
    hash: int = 0
    main: bool = False
    prose: bool = False


def parse(page: str) -> Node:
    """Element tree of a page, with the implied ends of HTML elements."""
    root = at = Node("#page")
    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            at.parts.append(page[pos:])
            break
        if m.start() > pos:
            at.parts.append(page[pos : m.start()])
        pos = m.end()
        end, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if end:
            at = _close(at, name)
            continue
        if name in CLOSES_P:
            at = _leave(at, frozenset({"p"}), frozenset({"button", "table", "td", "th", "caption", "article", "main", "section", "div"}) if name != "p" else frozenset({"button", "table"}))
        if name in ENDS:
            at = _leave(at, *ENDS[name])
        node = Node(name, attrs, at)
        at.parts.append(node)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, pos)
            node.parts.append(page[pos : close.start()] if close else page[pos:])
            pos = close.end() if close else n
        elif name not in VOID and not attrs.endswith("/"):
            at = node
        elif name not in VOID and name in BLOCKS:
            at = node  # a slash does not end an HTML element
    return root


def _leave(at: Node, kinds: frozenset[str], stop: frozenset[str]) -> Node:
    node = at
    while node is not None and node.tag not in stop:
        if node.tag in kinds:
            return node.parent
        node = node.parent
    return at


def _close(at: Node, name: str) -> Node:
    node, inline = at, name not in BLOCKS
    while node.parent is not None:
        if node.tag == name:
            return node.parent
        if inline and node.tag in BLOCKS:
            return at
        if name != "article" and node.tag in ("article", "main") and name in ("p", "li", "td", "th", "tr"):
            return at
        node = node.parent
    return at


def dropped(node: Node) -> bool:
    """Whether HTML or the element's attributes mark it as no part of the article."""
    if node.tag in DROPPED:
        return True
    if not node.attrs or node.tag in ("html", "body", "main", "article"):
        # an article may still be a reader's comment
        return bool(node.attrs) and node.tag == "article" and bool(_COMMENT.search(node.attrs))
    for m in _ATTR.finditer(node.attrs):
        name = (m[1] or m[5]).lower()
        value = html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id") and any(t.lower() in MARKS for t in _TOKEN.findall(value)):
            return True
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _annotate(root: Node) -> list[Node]:
    """Set hash, main and prose of all nodes; the nodes, children before parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(p for p in node.parts if isinstance(p, Node))
    order.reverse()
    for node in order:
        kids = [p for p in node.parts if isinstance(p, Node)]
        inner = "\x1f".join(f"{p.hash:016x}" if isinstance(p, Node) else " ".join(p.split()) for p in node.parts)
        node.hash = xxhash.xxh64_intdigest(f"{node.tag}\x1e{inner}".encode("utf-8", "surrogatepass"))
        node.main = node.tag in ("article", "main") or any(k.main for k in kids)
        node.prose = node.tag in PROSE or any(k.prose for k in kids)
    return order


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return (m[1] or m[2] or "").lower().rstrip(".") if m else ""


def page_blocks(page: str) -> tuple[list[str], list[tuple[int, int, int]], list[int]]:
    """The article's text blocks; the subtrees of the article that may be template, as
    (hash, first block, end of blocks); and the hashes of all subtrees of the page that may be.

    Blocks come in page order, so those of a subtree stand together: a page
    takes memory in proportion to its elements, however deep they are nested."""
    root = parse(page)
    order = _annotate(root)
    roots = _article(root)
    inside = set()
    for r in roots:
        todo = [r]
        while todo:
            node = todo.pop()
            inside.add(id(node))
            todo.extend(p for p in node.parts if isinstance(p, Node))
    whole = roots == [root] or (len(roots) == 1 and roots[0].tag == "body")

    def template_key(node: Node) -> int | None:
        """The subtree's hash, odd for a container of prose in an article; None if it is never template."""
        if node.main or node.tag in ("#page", "html", "body") or node.tag not in BLOCKS:
            return None
        if whole or id(node) not in inside or not node.prose:
            return node.hash & ~1
        return node.hash | 1 if node.tag in CONTAINERS else None

    subtrees = {k for n in order if (k := template_key(n)) is not None}
    blocks: list[str] = []
    spans: list[tuple[int, int, int]] = []
    text: list[str] = []

    def flush() -> None:
        block = " ".join("".join(text).split())
        text.clear()
        if block:
            blocks.append(block)

    for r in roots:
        # (element, its next part, the hash if it may be template, blocks before it)
        stack: list[tuple[Node, int, int | None, int]] = [(r, 0, None, len(blocks))]
        while stack:
            node, i, key, first = stack.pop()
            if i == len(node.parts):
                if node.tag in BLOCKS or node.tag == "#page":
                    flush()
                if key is not None and len(blocks) > first:
                    spans.append((key, first, len(blocks)))
                continue
            stack.append((node, i + 1, key, first))
            part = node.parts[i]
            if isinstance(part, str):
                text.append(html.unescape(part))
            elif part.tag == "br":
                text.append(" ")
            elif dropped(part) and not (part.main and part.tag not in ("article", "main")) :
                if part.tag in BLOCKS:
                    flush()
            else:
                if part.tag in BLOCKS:
                    flush()
                stack.append((part, 0, template_key(part), len(blocks)))
        flush()
    return blocks, spans, sorted(subtrees)


def outside(blocks: int, first: list[int], end: list[int]) -> np.ndarray:
    """Which of so many blocks no span [first, end) covers."""
    step = np.zeros(blocks + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step)[:-1] == 0


def _article(root: Node) -> list[Node]:
    """Articles outside dropped regions, else main elements, else the body, else the page."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    todo = [root]
    while todo:
        node = todo.pop()
        for p in reversed(node.parts):
            if isinstance(p, Node) and not (dropped(p) and not p.main) and not (p.tag == "article" and dropped(p)):
                todo.append(p)
        if node.tag in found:
            found[node.tag].append(node)
    for kind in ("article", "main", "body"):
        if found[kind]:
            top = [n for n in found[kind] if not _within(n, kind)]
            return top[:1] if kind == "body" else top
    return [root]


def _within(node: Node, kind: str) -> bool:
    node = node.parent
    while node is not None:
        if node.tag == kind:
            return True
        node = node.parent
    return False


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, id_col: str = "page_id",
            url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (its article, '' if none), n_chars (code points).

    Null or empty html gives ''; a null url is a host of its own; null and
    repeated ids are kept, repeated pages each give their row.  Character
    references are decoded, white space inside a block becomes one space,
    blocks are joined in page order by one space.  Markup that ends early is
    closed at the end.  Long pages are read whole, and deep ones take memory in
    proportion to their length.  An empty table gives an empty result; other
    columns are not read."""
    cols = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                c = b.slice(i, 500)
                found = [page_blocks(h or "") for h in c.column(2).to_pylist()]
                spans = [[{"subtree": _signed(h), "first": a, "until": e} for h, a, e in f[1]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), c.column(1), c.column(3), pa.array([host_of(u) for u in c.column(1).to_pylist()], pa.string()),
                     pa.array([_signed(xxhash.xxh64_intdigest(" ".join(f[0]).encode("utf-8", "surrogatepass"))) for f in found], pa.int64()),
                     pa.array([f[0] for f in found], pa.list_(pa.string())),
                     pa.array(spans, SPANS),
                     pa.array([[_signed(h) for h in f[2]] for f in found], pa.list_(pa.int64()))],
                    names=["page_id", "url", "row", "host", "content", "blocks", "spans", "subtrees"])

    table = stored(cols.mapInArrow(
        run, "page_id bigint, url string, row bigint, host string, content bigint, blocks array<string>, "
             "spans array<struct<subtree:bigint,first:int,until:int>>, subtrees array<bigint>"), "pages")
    seen = table.select("host", "content", F.explode("subtrees").alias("subtree")).distinct()
    least = F.when(F.col("subtree").bitwiseAND(1) == 1, max(min_pages, PROSE_PAGES)).otherwise(min_pages)
    counts = seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
    hosts = table.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    share = F.least(min_share * F.col("host_pages"), F.lit(float(MANY_PAGES)))
    template = counts.join(hosts, "host").where(F.col("pages") >= share).select("host", "subtree")
    used = table.select("host", "row", F.explode("spans").alias("span")).select("host", "row", "span.*")
    gone = used.join(template, ["host", "subtree"]).groupBy("row").agg(F.collect_list(F.struct("first", "until")).alias("gone"))
    # only pages whose article holds subtrees that may be template are matched with their host's
    plain = F.size("spans") == 0
    whole = table.where(plain).select("page_id", "url", F.array_join("blocks", " ").alias("text"))
    marked = table.where(~plain).select("page_id", "url", "row", "blocks").join(gone, "row", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for blocks, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if spans:
                    stays = outside(len(blocks), [x["first"] for x in spans], [x["until"] for x in spans])
                    blocks = [t for t, k in zip(blocks, stays.tolist(), strict=True) if k]
                texts.append(" ".join(blocks))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    marked = marked.select("page_id", "url", "blocks", "gone").mapInArrow(cut, "page_id bigint, url string, text string")
    return whole.unionByName(marked).withColumn("n_chars", F.length("text").cast("bigint"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h
