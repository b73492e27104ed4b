"""Main text of web pages: element subtrees that recur across a host's pages, by content or by place, are its template and are deleted."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, rows_of, stored, table

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(script|style|noscript|template|textarea|select|title|svg|iframe|object)\b[^>]*(?:(?<=/)>|>.*?</\1\s*>|>.*|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
#: One attribute: a whole name, with its quoted or bare value if it has one.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_TELLING = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
_TOKENS = re.compile(r"[a-z]+")

#: Elements that begin and end blocks of text; all others are inline and don't split a block.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that are part of an article's text unless they recur on most pages.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption article main".split())
#: Elements that hold no main text, and roles that say so.
_OUT = frozenset("nav footer aside form menu dialog head button search".split())
_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Names of what isn't main text. A class or id leaves its element out if it is made of these and of ``_PLAIN_WORDS`` alone
#: ("comments", "cookie-notice", "comment-list"), or holds one and the element's text is mostly links ("related-posts"); a
#: name that merely holds one ("share-price", "comment-on-brexit") says nothing about an element of running text.
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay banner comment comments commentlist respond disqus"
    " newsletter subscribe signup login share sharing social related recommended recommendations pagination pager toolbar search hidden".split()
)
_PLAIN_WORDS = frozenset("area bar block body box button buttons container content footer form header inner item items left list main outer page right section site thread top widget wrap wrapper".split())
#: Elements that no class or id leaves out.
_KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6 hgroup blockquote pre figcaption table tr td th".split())
#: A start tag on the left closes an open element on the right.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}


class Node:
    """A block element: where it stands, what it holds, and a hash of its subtree.

    ``path`` hashes its tag, class and id words and those of the elements around it; ``place`` adds whether its text is links.
    """

    __slots__ = ("tag", "parent", "out", "listed", "inside", "parts", "chars", "whole", "linked", "hash", "path", "place")

    def __init__(self, tag: str, parent: Node | None, out: bool, inside: bool, label: str, listed: bool = False) -> None:
        self.tag, self.parent, self.out, self.inside, self.listed = tag, parent, out, inside, listed
        self.parts: list = []  # texts and nodes, in page order
        self.chars = self.whole = self.linked = self.hash = self.place = 0
        self.path = xxhash.xxh3_64_intdigest(f"{parent.path if parent else 0} {tag} {label}".encode("utf-8", "surrogatepass"))


def _described(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Is the element left out by its tag, role or names, is it if it is mostly links, and its class and id words (digits apart, which
    often count something)."""
    out, listed, label = tag in _OUT or tag == "header" and not inside, False, []
    if not attributes.strip():
        return out, False, ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name not in _TELLING:
            continue
        if name in ("class", "id"):
            label += _TOKENS.findall(value)
            if tag not in _KEPT:
                for one in value.split():
                    words = set(_TOKENS.findall(one))
                    if not words.isdisjoint(_OUT_WORDS):
                        listed = True
                        out = out or words <= _OUT_WORDS | _PLAIN_WORDS
        elif name == "role":
            out = out or tag not in _KEPT and not _OUT_ROLES.isdisjoint(value.split())
        elif tag not in ("html", "body", "main") and (name == "hidden" or value == "true"):
            out = True
    return out, listed, " ".join(label)


def parsed(html: str) -> tuple[Node, list[Node]]:
    """The page's tree of block elements and all its nodes, children after parents."""
    root = Node("html", None, False, False, "")
    at, nodes, text, last, link = root, [root], [], 0, False

    def flush() -> None:
        if text:
            if joined := " ".join(unescape("".join(text)).split()):
                at.parts.append(joined)
            text.clear()

    for m in _TOKEN.finditer(html):
        if m.start() > last:
            text.append(html[last : m.start()])
            if link:
                at.linked += len(text[-1].strip())
        last = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag not in _BLOCKS or tag == "html":
            link = link if tag != "a" else not m[2]
            continue
        flush()
        if m[2]:
            open_one = at
            while open_one is not None and open_one.tag != tag:
                open_one = open_one.parent
            if open_one is not None and open_one.parent is not None:
                at = open_one.parent
            continue
        closing = _CLOSES.get(tag, {"p"})
        while at.tag in closing and at.parent is not None:
            at = at.parent
        if tag == "hr":
            continue
        out, listed, label = _described(tag, m[4], at.inside)
        node = Node(tag, at, at.out or out, at.inside or tag in ("article", "main"), label, listed)
        at.parts.append(node)
        nodes.append(node)
        if not m[4].rstrip().endswith("/"):
            at = node
    if last < len(html):
        text.append(html[last:])
    flush()
    for node in reversed(nodes):
        digest = xxhash.xxh3_64(node.tag.encode())
        # what is mostly links is known only now; what holds it is met later, what it holds was left out with it or is read no more
        if node.listed and not node.out and 2 * (node.linked + sum(x.linked for x in node.parts if not isinstance(x, str))) > sum(len(x) if isinstance(x, str) else x.whole for x in node.parts):
            node.out = True
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(part)
                node.whole += len(part)
                digest.update(part.encode("utf-8", "surrogatepass"))
                digest.update(b"\0")
            else:
                node.chars += 0 if part.out and not node.out else part.chars
                node.whole += part.whole
                node.linked += part.linked
                digest.update(part.hash.to_bytes(8, "little"))
        node.hash = digest.intdigest()
        node.place = xxhash.xxh3_64_intdigest(b"%d %d" % (node.path, 5 * node.linked >= 4 * node.whole))
    return root, nodes


def removable(node: Node) -> bool:
    """May the node be template by its content? Any subtree with text, but the page itself."""
    return node.parent is not None and node.whole > 0 and node.tag != "body"


def movable(node: Node) -> bool:
    """May the node be template by its place? Containers, not paragraphs and the like, and nothing of an article."""
    return removable(node) and not node.inside and node.tag not in _TEXT


def main_chain(root: Node) -> list[Node]:
    """From the page down to the last element that holds more than half of its parent's text."""
    chain = [root]
    while True:
        below = [x for x in chain[-1].parts if not isinstance(x, str) and 2 * x.whole > chain[-1].whole]
        if not below or chain[-1].tag in ("article", "main"):
            return chain
        chain.append(below[0])


def beside_main(root: Node) -> tuple[set[int], set[int]]:
    """Places beside the main chain (menus, adverts and footers, whatever they say) and places on it."""
    chain = main_chain(root)
    on = {x.place for x in chain}
    off = {x.place for top in chain[:-1] for x in top.parts if not isinstance(x, str) and movable(x)}
    return off - on, on


def _main(nodes: list[Node], root: Node) -> Node:
    """The article: of the outermost ``article`` elements (else ``main``) the one with most text; else the page."""
    for tag in ("article", "main"):
        found = [x for x in nodes if x.tag == tag and not x.out and x.chars]
        outer = [x for x in found if not _within(x.parent, tag)]
        if outer:
            return max(outer, key=lambda x: x.chars)
    return root


def _within(node: Node | None, tag: str) -> bool:
    while node is not None:
        if node.tag == tag:
            return True
        node = node.parent
    return False


def main_text(html: str, template: frozenset[int], often: frozenset[int] = frozenset(), places: frozenset[int] = frozenset(), sides: frozenset[int] = frozenset()) -> str:
    """The page's main text, blocks joined by line feeds, without the subtrees whose hashes are in ``template`` or ``often`` and
    without what stands in ``places``.

    Template goes first, wherever it is; the article is looked for in what remains, and element rules leave out the rest that
    isn't main text. Paragraphs and the like of an article go only if they are in ``often``, what recurs on most pages. Template
    goes however long it is beside the page's own text. A page of which nothing is left is a copy of others, and keeps the text of
    its main element (``copied``), if it has one; what stood beside that stays deleted, and ``sides``, places that on other
    pages are beside the main element, are none.
    """
    root, nodes = parsed(html)
    holding = set()
    for x in nodes:
        if x.tag in ("article", "main"):
            up = x
            while up is not None and id(up) not in holding:
                holding.add(id(up))
                up = up.parent

    def gone(x: Node) -> bool:
        if x.place in places and movable(x) and id(x) not in holding:
            return True
        return (x.hash in often or x.hash in template and not (x.inside and x.tag in _TEXT)) and removable(x)

    deleted = {id(x) for x in nodes if gone(x)} if template or often or places else set()

    def blocks(top: Node, gone: set[int]) -> list[str]:
        found, stack = [], [top]
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                found.append(part)
            elif part is top or not (part.out or part.tag == "article" and top.tag == "article" or id(part) in gone):
                stack.extend(reversed(part.parts))
        return found

    found = blocks(_main([x for x in nodes if not _in(x, deleted)] if deleted else nodes, root), deleted)
    if not found and deleted and (top := copied(root, nodes, places | sides)):
        found = blocks(top, set())
    return "\n".join(found)


def copied(root: Node, nodes: list[Node], places: frozenset[int]) -> Node | None:
    """The main element of a page that is a copy: its article, or else the element with most of its text; never the page itself, nor a
    list of links, nor what stands in the place of a template."""
    top = _main(nodes, root)
    top = top if top is not root else [x for x in main_chain(root) if x.tag not in _TEXT or x.tag in ("article", "main")][-1]
    if top.parent is None or top.tag == "body" or top.out or not top.chars or 2 * top.linked > top.whole or top.place in places:
        return None
    return top


def _in(node: Node | None, deleted: set[int]) -> bool:
    while node is not None:
        if id(node) in deleted:
            return True
        node = node.parent
    return False


def host_of(url) -> object:
    """The host of a url, lower-cased, without user and port; empty for null or no host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)), F.lit(""))


def section_of(url) -> object:
    """The first folder of a url's path, empty for pages that are in none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1), F.lit(""))


def extract(pages: DataFrame, min_pages: int = 3, share: float = 0.5, many: int = 20, low: float = 0.02) -> DataFrame:
    """``(page_id, url, text)``: the main text of every page.

    1. Every page's subtrees, menus and footers included, are hashed and counted per host and per section (first folder) of a
       host, once a page: by their content, and, beside the element that holds most of a page, by their place (tags, class and id
       words, text of links or not), for adverts and footers that say something else on each page. Counts are summed before the
       shuffle and stored.
    2. Template is what is found on ``share`` of a host's pages and on ``min_pages``, or on ``share`` of a section's and on
       ``many``; and, but for paragraphs and the like of an article, content found on ``many`` pages and on ``low`` of the
       host's or section's, so that each of a large host's layouts has its own. A place must besides hold most of a page's text
       hardly ever. A host has at most ``1 / low`` times as many as one of its pages has subtrees, so they fit in one row
       whatever the host's size.
    3. Pages are joined with the rows of their host and section by hash, parsed again, and texts extracted without these subtrees.

    Menus, footers, forms and the like that no count finds are left out by element and role, and by class and id if these are made of
    such words alone, or hold one on an element that is mostly links; headings, quotes, tables and articles never are.
    Nulls: a null html is empty and gives an empty text; pages without host are one host. Repeated rows are pages of their
    own. Very long pages are parsed whole. Empty tables give an empty result. Other columns are ignored.
    """
    host, section = host_of(F.col("url")), section_of(F.col("url"))
    places = F.xxhash64(host).alias("host"), F.xxhash64(host, F.lit("/"), section).alias("section")
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", *places)
    counted_schema = pa.schema([("place", pa.int64()), ("is_host", pa.bool_()), ("hash", pa.int64()), ("kind", pa.int8()), ("counted", pa.int64()), ("central", pa.int64())])
    CONTENT, PLACE = 0, 1

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for host, section, html in rows_of(batches):
                root, nodes = parsed(html or "")
                off, on = beside_main(root)
                found = [(None, CONTENT, 1, 0), *((h, CONTENT, 1, 0) for h in {x.hash for x in nodes if removable(x)}), *((h, PLACE, 1, 0) for h in off), *((h, PLACE, 0, 1) for h in on)]
                for h, *rest in found:
                    h = h if h is None else h - (1 << 63)
                    yield host, True, h, *rest
                    yield section, False, h, *rest

        yield from in_batches(rows(), counted_schema, 8192)

    counts = read.select("host", "section", "html").mapInArrow(count, "place long, is_host boolean, hash long, kind byte, counted long, central long")
    counts = counts.groupBy("place", "is_host", "hash", "kind").agg(F.sum("counted").alias("n"), F.sum("central").alias("central")).filter(F.col("n") >= min(min_pages, many))
    counts = stored(counts, "subtree-counts")
    of_place = counts.filter("hash IS NULL").select("place", "is_host", F.col("n").alias("pages"))
    most = (F.col("n") >= share * F.col("pages")) & (F.col("n") >= F.when(F.col("is_host"), min_pages).otherwise(many))
    some = (F.col("n") >= many) & (F.col("n") >= low * F.col("pages"))
    found = counts.filter("hash IS NOT NULL").join(of_place, ["place", "is_host"])
    placed = most & (F.col("kind") == PLACE) & (F.col("central") <= 0.05 * F.col("n"))
    beside = most & (F.col("kind") == PLACE) & (2 * F.col("central") <= F.col("n"))
    by_content = F.col("kind") == CONTENT
    picked = {"template": by_content & some & ~most, "often": by_content & most, "places": placed, "sides": beside & ~placed}
    template = found.filter(by_content & (most | some) | beside).groupBy("place", "is_host").agg(*(F.collect_list(F.when(c, F.col("hash"))).alias(k) for k, c in picked.items()))
    # stored: where the table is small Spark broadcasts it and no page is shuffled; else it can split a host with very many pages
    template = stored(template, "templates")
    joined = read
    for place, is_host in (("host", "is_host"), ("section", "NOT is_host")):
        of = template.filter(is_host).select(F.col("place").alias(f"{place}_place"), *(F.col(k).alias(f"{place}_{k}") for k in picked))
        joined = joined.join(of, F.col(place) == F.col(f"{place}_place"), "left")
    joined = joined.select("page_id", "url", "html", *(f"{place}_{k}" for k in picked for place in ("host", "section")))
    out_schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = lambda a, b: frozenset(x + (1 << 63) for part in (a, b) for x in part or ())
        rows = ((i, u, main_text(h or "", *(both(*t[k : k + 2]) for k in range(0, len(t), 2)))) for i, u, h, *t in rows_of(batches))
        yield from in_batches(rows, out_schema, 512)

    return joined.mapInArrow(strip, "page_id long, url string, text string")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all ``pages``."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
