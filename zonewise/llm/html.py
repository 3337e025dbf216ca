"""Main text of web pages, with each site's template removed.

First pass: every page is parsed and its subtrees are hashed together with the
page's host; inside an article, containers with their place in it. Spark counts
beside how many different texts each subtree stands: the article's (or page's)
text without the subtree. Subtrees that recur beside at least ``MIN_PAGES`` texts
are the site's template, however large the site. So the copies of one article
count once, and a part with half of an article's text or more doesn't count there.

Second pass: pages are parsed again; template subtrees go, and so do elements
that say what they are (navigation, footers, forms, scripts, adverts, comments).
What is left of the article, or of the main element, or of the body, is the text.

The template hashes are 8 bytes each and are counted before use: up to
``MAX_BROADCAST`` are sent to the workers; beyond that they reach their pages by a
join on the hash, which gives the same rows.

Defined cases: null html gives an empty text; a null or unreadable url has no
host, so nothing of its template is removed; repeated rows count once and come
back each; broken or truncated markup is read as far as it goes, an unfinished tag at
the end is dropped; an end tag that matches nothing is passed over; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches

MIN_PAGES, MAX_BROADCAST = 8, 2_000_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[A-Za-z][^>]*+\Z", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][A-Za-z0-9_:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Element names of the HTML standard, and words that sites use in class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html caption tbody tfoot thead tr li dd dt option".split())
DROPPED = frozenset("script style textarea title noscript iframe template xmp noembed noframes head nav aside footer form button select svg canvas object embed audio video menu dialog search input label".split())
#: An id or class says that an element goes if all its words are hints or, beside a hint, words of layout.
LAYOUT = frozenset("area articles bar block body box button buttons bottom container content entry footer form global group header holder home icon icons inline inner item items left links list main middle module outer page panel post posts reader right row section sidebar signup site slot small stories strip text thread top unit user wide wrap wrapper".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice popup promo promoted related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HEADER_HINTS = frozenset("header masthead topbar".split())
CONTAINERS = BLOCKS - frozenset("html body main article".split())
#: Inside an article, lines of text may recur by themselves; what holds lines may not.
IN_ARTICLE = CONTAINERS - frozenset("p h1 h2 h3 h4 h5 h6 li dd dt option tr tbody thead tfoot caption figcaption summary hr".split())


#: What a start tag closes, group by group: tags of which only one is open within a scope, and the tags that start a new scope.
SCOPES = (
    (frozenset(["p"]), frozenset("article section div td th li blockquote body".split())),
    (frozenset(["li"]), frozenset("ul ol dl table select body menu".split())),
    (frozenset(["dd", "dt"]), frozenset("ul ol dl table select body menu".split())),
    (frozenset(["tr"]), frozenset("ul ol dl table select body menu".split())),
    (frozenset(["td", "th"]), frozenset("ul ol dl table select body menu tr".split())),
    (frozenset(["option"]), frozenset("ul ol dl table select body menu".split())),
)


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "drop", "main")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []
        self.drop = self.main = False


class Open:
    """The open elements. Every step up closes an element for good, and no walk is begun that won't end at an open one: reading is linear."""

    def __init__(self) -> None:
        self.root = self.node = Node("#root", "", None)
        self.count: dict[str, int] = {}
        self.scopes: list[list[int]] = [[0] for _ in SCOPES]

    def enter(self, node: Node) -> None:
        self.node = node
        self.count[node.tag] = self.count.get(node.tag, 0) + 1
        for (tags, stops), held in zip(SCOPES, self.scopes, strict=True):
            if node.tag in stops:
                held.append(0)
            elif node.tag in tags:
                held[-1] += 1

    def leave(self) -> str:
        """Closes the innermost element; its tag."""
        tag = self.node.tag
        self.count[tag] -= 1
        for (tags, stops), held in zip(SCOPES, self.scopes, strict=True):
            if tag in stops:
                held.pop()
            elif tag in tags:
                held[-1] -= 1
        self.node = self.node.parent
        return tag

    def end(self, tag: str) -> None:
        """An end tag closes all up to its element; one that matches nothing is passed over."""
        if self.count.get(tag):
            while self.leave() != tag:
                pass

    def start(self, tag: str) -> None:
        """A start tag closes the open element of its group in this scope; a block closes an open paragraph."""
        for (tags, _), held in zip(SCOPES, self.scopes, strict=True):
            if (tag in tags or (tag in CLOSES_P and "p" in tags)) and held[-1]:
                while self.leave() not in tags:
                    pass


def parse(html: str) -> tuple[Node, list[Node]]:
    """The root, and all elements in page order. Nesting follows open elements; no recursion, so depth is free."""
    stack = Open()
    nodes, at, size = [], 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            stack.node.items.append(html[at:])
            break
        if m.start() > at:
            stack.node.items.append(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            stack.end(tag)
            continue
        stack.start(tag)
        new = Node(tag, m[3] or m[6] or "", stack.node)
        stack.node.items.append(new)
        nodes.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
        elif tag not in VOID and not new.attrs.endswith("/"):
            stack.enter(new)
        elif tag not in VOID:  # HTML ignores the slash, but nothing is left open by pages that write it on purpose
            new.attrs = new.attrs[:-1]
            if tag in BLOCKS:
                stack.enter(new)
    return stack.root, nodes


def attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attrs)} if attrs else {}


def said_to_go(node: Node, in_article: bool) -> bool:
    """Whether an element says that it isn't main text."""
    if node.tag in DROPPED or (node.tag == "header" and not in_article):
        return True
    if not node.attrs or node.tag in ("html", "body", "main"):
        return False
    got = attributes(node.attrs)
    if got.get("role", "").lower() in ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", got.get("style", "")):
        return True
    hints = HINTS if in_article else HINTS | HEADER_HINTS
    for name in f"{got.get('class', '')} {got.get('id', '')}".split():
        words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w}
        if words & hints and words <= hints | LAYOUT:
            return True
    return False


def content(nodes: list[Node]) -> list[Node]:
    """Marks elements that go (``drop``) and those in the main content (``main``); the main content's tops, in order."""
    tops: dict[str, list[Node]] = {"article": [], "main": []}
    inside: dict[Node, tuple[bool, bool]] = {}  # in an article, in a main element
    for n in nodes:
        up = n.parent
        article, main = inside.get(up, (False, False))
        n.drop = up.drop or said_to_go(n, article or main)
        if not n.drop:
            if n.tag == "article":
                if not article:
                    tops["article"].append(n)
                article = True
            elif n.tag == "main" or (n.attrs and "main" in n.attrs and attributes(n.attrs).get("role") == "main"):
                if not main:
                    tops["main"].append(n)
                main = True
        inside[n] = article, main
    kind = "article" if tops["article"] else "main"
    for n in nodes:
        n.main = inside[n][kind == "main"]
    return tops[kind]


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit((url or "").strip()).hostname or None
    except ValueError:
        return None


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def subtrees(host: str, nodes: list[Node], tops: list[Node]) -> dict[Node, tuple[int, int | None]]:
    """For each container that holds something and isn't dropped: a signed 64-bit hash of host, place in the article and
    subtree, and one of the text beside it; None where the subtree is half of its article's text or more."""
    digest: dict[Node, str] = {}
    own: dict[Node, tuple[int, int]] = {}  # sum of the text items' hashes, and their length
    for n in reversed(nodes):  # children come after their parent
        parts = [x.strip() if isinstance(x, str) else digest[x] for x in n.items]
        line = f"<{n.tag} {n.attrs.strip()}>" + "\x1f".join(p for p in parts if p)
        digest[n] = "\x1e" + xxhash.xxh64_hexdigest(line)
        total = size = 0
        for x, part in zip(n.items, parts, strict=True):
            if not isinstance(x, str):
                total, size = total + own[x][0], size + own[x][1]
            elif part:
                total, size = total + xxhash.xxh64_intdigest(part), size + len(part)
        own[n] = (0, 0) if n.drop else (total, size)
    # without main content, the scope is the whole page
    scope = tops or [n for n in nodes if n.parent.parent is None]
    beside, length = sum(own[n][0] for n in scope), sum(own[n][1] for n in scope)
    place: dict[Node, str] = {}
    out = {}
    for n in nodes:
        inside = n.main and n.parent.main
        place[n] = xxhash.xxh64_hexdigest(f"{place[n.parent]}/{n.tag}") if inside else ""
        if n.drop or not n.items or (n.main and not inside) or n.tag not in (IN_ARTICLE if inside else CONTAINERS):
            continue
        key = _signed(xxhash.xxh64_intdigest(f"{host}\x1f{place[n]}{digest[n]}"))
        rest = beside if tops and not inside else beside - own[n][0]
        out[n] = key, None if inside and 2 * own[n][1] >= length else _signed(rest % (1 << 64))
    return out


def text_of(tops: list[Node]) -> str:
    """Blocks of these elements without those that go: white space is one blank, blocks are lines."""
    blocks, held = [], []

    def end() -> None:
        if line := " ".join("".join(held).split()):
            blocks.append(line)
        held.clear()

    for top in tops:
        stack = [(top, iter(top.items))]
        while stack:
            node, rest = stack[-1]
            item = next(rest, None)
            if item is None:
                stack.pop()
                if node.tag in BLOCKS:
                    end()
                elif node.tag in ("td", "th"):
                    held.append(" ")
            elif isinstance(item, str):
                held.append(entities.unescape(item) if "&" in item else item)
            elif item.tag in ("br", "wbr"):
                held.append(" " if item.tag == "br" else "")
            elif not item.drop:
                if item.tag in BLOCKS:
                    end()
                stack.append((item, iter(item.items)))
        end()
    return "\n".join(blocks)


def extract(html: str | None, url: str | None, is_template) -> str:
    """Main text of a page; is_template tells of an array of subtree hashes which belong to the site's template."""
    if not html:
        return ""
    root, nodes = parse(html)
    tops = content(nodes)
    if host := host_of(url):
        found = subtrees(host, nodes, tops)
        for n, hit in zip(found, is_template(np.fromiter((key for key, _ in found.values()), np.int64, len(found))), strict=True):
            n.drop |= bool(hit)
    if not tops:
        tops = [n for n in nodes if n.tag == "body"][:1] or [root]
    return text_of(tops)


def keys_of(html: str | None, url: str | None) -> list[tuple[int, int | None]]:
    """The subtrees' hashes of a page, each with that of the text beside it."""
    host = host_of(url)
    if not html or not host:
        return []
    _, nodes = parse(html)
    tops = content(nodes)
    return list(set(subtrees(host, nodes, tops).values()))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Hashes (``key``) of the subtrees that make each host's template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {pair for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for pair in keys_of(html, url) if pair[1] is not None}
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["key", "beside"])

    # pairs are made distinct before they are counted, so that a key of a large site is spread
    pairs = map_batches(pages.select("url", "html"), run, "key long, beside long").distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("key")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars; one row per page."""
    found = cut_lineage(templates(pages, min_pages))
    pages = pages.select(F.col("page_id"), "url", "html")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def rows(batch: pa.RecordBatch, sets) -> pa.RecordBatch:
        texts = [extract(h, u, is_template) for u, h, is_template in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if found.count() <= max_broadcast:
        sent = pages.sparkSession.sparkContext.broadcast(np.sort(found.toArrow().column(0).to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value

            def member(keys: np.ndarray) -> np.ndarray:
                if not known.size:
                    return np.zeros(keys.size, bool)
                return known[np.minimum(np.searchsorted(known, keys), known.size - 1)] == keys

            for batch in batches:
                yield rows(batch, [member] * batch.num_rows)

        return map_batches(pages, run, schema)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted({k for k, _ in keys_of(h, u)}) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.list_(pa.int64()))], names=["row", "keys"])

    row = F.xxhash64("url", "html").alias("row")
    own = map_batches(pages.select(row, "url", "html"), keyed, "row long, keys array<long>").dropDuplicates(["row"]).select("row", F.explode("keys").alias("key"))
    hits = own.join(found, "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias("hits"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch, [lambda keys, h=h: np.isin(keys, np.array(h or [], np.int64)) for h in batch.column(3).to_pylist()])

    return map_batches(pages.withColumn("row", row).join(hits, "row", "left").select("page_id", "url", "html", "hits"), joined, schema)
