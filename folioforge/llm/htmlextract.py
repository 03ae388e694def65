"""Main text of web pages: site templates are found by counting, then removed.

Every element's subtree has two hashes: of what it says (tags, classes and text below it) and of where it stands (tags and
classes from the root down to it).  For each host, Spark counts the pages in which each occurs, and the text and the link
text in each place.  Template, and removed, are

* subtrees that say the same in many pages of a host, and
* containers in a place that many pages of a host have and that over the host holds mostly links: menus and link
  lists, whose links may differ from page to page.

What counting can't tell (an advert of another text in every page, a host of few pages) is left to what elements say of
themselves: tag, role, and classes or ids made of nothing but words such as ad, comments or sidebar.  Where a page has an
article or main element, only that is kept.

Pages of a host with equal main text count as one: copies of a page don't make its article template.  An element that
holds an article, or most of the page's main text, is never taken for template as a whole; what is in it may be.
Blocks of prose inside an article (paragraphs, headings, list items and so on) are never taken for template:
quoted passages and pages copied with edits also recur on a host; nor is a place inside an article.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, save, with_fields
from .urlfilter import host_of

MIN_PAGES, RATIO = 5, 0.3
LINKS = 0.6  # share of link text in a place that makes it one of links
BROADCAST_HASHES = 500_000  # 8 bytes each

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
SKIP = frozenset("script style noscript template iframe object svg math canvas nav menu aside footer form button input select option textarea dialog head title noembed noframes audio video map".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption b i em strong a span code q".split())
CONTAINERS = BLOCK - PROSE
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup html body legend summary".split()) | {"table"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
NO_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot banner sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar widget widgets footer masthead cookie cookies consent gdpr notice popup newsletter subscribe signup login "
    "comment comments disqus sharing pagination pager toolbar".split()
)
FORMS = frozenset("area bar block bottom box button buttons container content form group header inner item items label left link links list main message outer page panel right row section site slot thread title top unit wrap wrapper".split())
ALWAYS = frozenset("script style noscript template iframe object svg math canvas form button input select option textarea dialog head title noembed noframes audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())

_TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", regex.S)
_ATTR = regex.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", regex.S)
_WORD = regex.compile(r"[a-z]+")
_DIGITS = regex.compile(r"\d+")
_M64 = (1 << 64) - 1


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "place")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids, self.hash, self.place = tag, attrs, [], None, None


def parse(html: str) -> Node:
    """A tree that forgives what pages get wrong: open paragraphs, missing and stray end tags, bare ``<``."""
    root = Node("html", {})
    stack, at, n = [root], 0, len(html)

    def close(tags, stop):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return True
            if stack[k].tag in stop:
                return False
        return False

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].kids.append(html[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].kids.append(Node("p", {}))
            elif tag not in VOID and tag not in ("html", "body"):
                # An inline end tag doesn't reach over a block.
                close({tag}, () if tag in BLOCK else BLOCK)
            continue
        tag = m[2] or m[4]
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag, raw = tag.lower(), m[3] if m[2] else m[5]
        if tag in ("html", "body"):
            continue
        attrs = {}
        if raw and not raw.isspace():
            for a in _ATTR.finditer(raw):
                attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "object"})
            if tag[0] == "h" and len(tag) == 2 and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                stack.pop()
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            e = regex.compile(rf"</{tag}(?=[\s/>]|\Z)", regex.I).search(html, at)
            stop = e.start() if e else n
            if tag not in ("script", "style"):
                node.kids.append(html[at:stop])
            at = stop
            if e:
                gt = html.find(">", at)
                at = n if gt < 0 else gt + 1
            continue
        stack.append(node)
    return root


def squeezed(text: str) -> str:
    """Trimmed, with runs of white space as one space."""
    return " ".join(text.split())


def _names(node: Node) -> list[str]:
    if not node.attrs:
        return []
    return f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower().split()


def says_no_article(name: str) -> bool:
    """Whether a class or id is made of such words alone: ``ad-slot-2`` and ``cookie_notice``, not ``ad-hoc-analysis``."""
    words = _WORD.findall(name)
    return any(w in NO_ARTICLE for w in words) and all(w in NO_ARTICLE or w in FORMS for w in words)


def boilerplate(node: Node, in_article: bool, names: bool = True) -> bool:
    """Whether an element says of itself that it is none of the article.  Without ``names`` only what is never text."""
    if node.tag in ALWAYS:
        return True
    if not names:
        return False
    if node.tag in SKIP or (node.tag == "header" and not in_article):
        return True
    a = node.attrs
    if not a:
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or regex.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), regex.I):
        return True
    return any(says_no_article(name) for name in _names(node))


def _hash(x: str, seed: int = 0) -> int:
    """64 bits, signed."""
    return int.from_bytes(xxhash.xxh64_digest(x.encode("utf-8", "surrogatepass"), seed), "big", signed=True)


def subtree_hashes(root: Node) -> dict[int, tuple[int, int]]:
    """Set each element's hash and place and return (characters of text, of link text) of each: -1, 0 for what is said,
    summed over the page for a container's place.  Elements without text, scripts and the like have neither."""
    found: dict[int, tuple[int, int]] = {}
    sizes: dict[Node, tuple[int, int]] = {}
    order = _order(root)
    root.place = 1
    for node in order:  # parents first
        for k in node.kids:
            if isinstance(k, Node):
                names = sorted(n if n.isalpha() else _DIGITS.sub("", n) for n in _names(k)) if k.attrs else ()
                k.place = _hash(" ".join([k.tag, *names]), node.place & _M64)
    for node in reversed(order):  # children first
        parts, size, links = [node.tag, " ".join(sorted(_names(node)))], 0, 0
        for k in node.kids:
            if isinstance(k, Node):
                if k.hash is not None:
                    parts.append(str(k.hash))
                    size, links = size + sizes[k][0], links + sizes[k][1]
            elif s := squeezed(k):
                parts.append(s)
                size += len(s)
        sizes[node] = (size, size if node.tag == "a" else links)
        if size and node.tag not in ("script", "style"):
            node.hash = _hash("\x00".join(parts))
            if node is not root:
                found[node.hash] = (-1, 0)
                if node.tag in CONTAINERS:
                    had = found.get(node.place, (0, 0))
                    found[node.place] = (had[0] + sizes[node][0], had[1] + sizes[node][1])
    return found


def _order(root: Node) -> list[Node]:
    """All elements, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node)]
    return order


def _tops(root: Node, gone) -> list[Node]:
    """Outermost articles, else main elements, that aren't inside an element that is ``gone``."""

    def find(tag: str) -> list[Node]:
        got, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == tag or (tag == "main" and node.attrs.get("role", "").lower() == "main"):
                got.append(node)
                continue
            todo += reversed([k for k in node.kids if isinstance(k, Node) and not (k.tag not in ("header",) and gone(k, False))])
        return got

    return find("article") or find("main")


def own_text(root: Node) -> dict[Node, str]:
    """Elements of the main text, as far as they say no else, with the text they hold directly, in order of pages."""
    tops = _tops(root, boilerplate)
    found: dict[Node, str] = {}
    for top in tops or [root]:
        todo = [top]
        while todo:
            node = todo.pop()
            text = squeezed(unescape(" ".join([k for k in node.kids if isinstance(k, str)])))
            if text:
                found[node] = text
            todo += reversed([k for k in node.kids if isinstance(k, Node) and not boilerplate(k, bool(tops))])
    return found


def whole(root: Node) -> set[Node]:
    """Elements that hold an article or main element, or over half of the main text."""
    own = own_text(root)
    most = sum(map(len, own.values())) / 2
    held: dict[Node, tuple[int, bool]] = {}
    for node in reversed(_order(root)):
        kids = [held[k] for k in node.kids if isinstance(k, Node)]
        tops = node.tag in ("article", "main") or node.attrs.get("role", "").lower() == "main"
        held[node] = (len(own.get(node, "")) + sum(k[0] for k in kids), tops or any(k[1] for k in kids))
    return {node for node, (size, top) in held.items() if top or size > most}


def main_text(html: str | None, template: frozenset[int] | set[int] = frozenset(), names: bool = True) -> str:
    """Blocks of the main text, one a line: of all outermost articles, else of main, else of the whole page; without
    ``names`` of the whole page but for ``template``."""
    root = parse(html or "")
    kept: set[Node] = set()
    if template:
        subtree_hashes(root)
        kept = whole(root)

    def gone(node: Node, in_article: bool) -> bool:
        if boilerplate(node, in_article, names):
            return True
        if not template or node in kept:
            return False
        if in_article:
            return node.hash in template and node.tag not in PROSE
        return node.hash in template or (node.place in template and node.tag in CONTAINERS)

    tops = _tops(root, gone) if names else []
    inside = bool(tops)
    blocks: list[str] = []
    held: list[str] = []

    def flush():
        if held:
            if s := squeezed(unescape("".join(held))):
                blocks.append(s)
            held.clear()

    for top in tops or [root]:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(x)
            elif x is not top and gone(x, inside):
                if x.tag in BLOCK:
                    flush()
                else:
                    held.append(" ")
            elif x.tag == "br" or x.tag == "wbr":
                held.append(" " if x.tag == "br" else "")
            else:
                if x.tag in BLOCK:
                    flush()
                    todo.append(None)
                todo += reversed(x.kids)
        flush()
    return "\n".join(blocks)


# --------------------------------------------------------------------------- Spark
def page_profile(html: str) -> tuple[int, list[dict]]:
    """Hash of the main text; the hashes of the subtrees and places, sorted, with their sizes."""
    root = parse(html)
    key = _hash("\x00".join(own_text(root).values()))
    return key, [{"h": h, "size": n, "links": m} for h, (n, m) in sorted(subtree_hashes(root).items())]


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, ratio: float = RATIO) -> DataFrame:
    """(host, hashes array<long>) of pages (url, html): subtrees, and places of mostly link text, that stand in at least
    ``min_pages`` pages of the host and in ``ratio`` of them.  A page counts each once; null url is host ''; pages of a
    host with equal main text are one page, with the subtrees of one of them.  A host has at most (subtrees and places
    a page / ratio) such."""
    kind = "array<struct<h: long, size: int, links: int>>"
    arrow = pa.list_(pa.struct([("h", pa.int64()), ("size", pa.int32()), ("links", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_profile(h.as_py() or "") for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], arrow)], ["host", "page", "parts"])

    hosts = pages.select(host_of(F.col("url")).alias("host"), "html")
    every = hosts.mapInArrow(run, f"host string, page long, parts {kind}")
    folded = save(every.groupBy("host", "page").agg(F.min("parts").alias("parts")), "profiles")
    seen = folded.select("host", F.explode("parts").alias("x")).select("host", "x.*").groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("links").alias("links"))
    total = folded.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    often = seen.where((F.col("n") >= min_pages) & ((F.col("size") < 0) | (F.col("links") >= LINKS * F.col("size"))))
    often = often.join(total, "host").where(F.col("n") >= ratio * F.col("total"))
    return often.groupBy("host").agg(F.collect_set("h").alias("hashes"))


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, ratio: float = RATIO, names: bool = True) -> DataFrame:
    """``pages`` (url, html) with ``text``: the article's blocks joined by line feeds; '' for null or empty html.

    Null urls are of one host, ''.  Pages of equal main text count as one, repeated rows too, and each row is returned.
    Whole pages are parsed, of any length and depth; an empty table gives no rows; a column named text is replaced, all
    others pass through.  Without ``names`` templates alone are removed, by counting.
    """
    pages = pages.drop("text")
    made = save(site_templates(pages, min_pages, ratio), "templates")
    size = made.agg(F.sum(F.size("hashes") + 2)).first()[0] or 0
    key, hashes = fresh(pages, "folio_host"), fresh(pages, "folio_hashes")
    made = made.select(F.col("host").alias(key), F.col("hashes").alias(hashes))
    if size <= BROADCAST_HASHES:
        made = F.broadcast(made)
    joined = pages.withColumn(key, host_of(F.col("url"))).join(made, key, "left").drop(key)
    schema = with_fields(joined.drop("html", hashes), "text string")
    keep = [f.name for f in schema][:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            texts, sets = [], {}
            for h, t in zip(batch.column(at("html")), batch.column(at(hashes)), strict=True):
                t = frozenset(t.as_py() or ())
                texts.append(main_text(h.as_py(), sets.setdefault(t, t), names))
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return joined.mapInArrow(run, schema)


def op10_html(spark, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
