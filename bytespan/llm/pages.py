"""Main text of web pages, with site template removal by element subtree hashes.

Pages are parsed twice. The first pass hashes block elements' subtrees (tag,
class, id and the hashes of what they hold, white space folded) and counts, in
Spark, on how many pages of its host each hash occurs; counting is a partial
aggregate, so a host with a third of all pages is never gathered. Subtrees found
on LEAST_PAGES pages or more, and on LEAST_SHARE of the host's pages, are its
template. The second pass deletes them, and whatever markup or attributes
declare to be a menu, header, footer, sidebar, notice, advert, form, script,
style or reader comment.

Inside an article or main element only boxes (BOX) are counted, and by the
contents they stand in: copies of an article recur too, and the whole of it is
wanted. A content is the least hash of the three-word runs of the article's rest,
which near copies mostly share; a box takes LEAST_PAGES contents, and one for
every PAGES_A_CONTENT of its pages. Paragraphs, headings, items and quotes of an
article are its text even where a sentence recurs.

Of what is left, article and main elements are read if they hold at least half of
the text, else the whole body. Where deletion by recurrence would leave no text,
it is not applied to the page.

Character references are decoded; white space inside a block becomes one space;
blocks are trimmed and joined by one space. Nothing is capped.

Defined cases: null or empty html gives an empty text; unclosed and stray tags
are read as browsers do where it matters (paragraphs, list items and cells
close each other); a null url counts as the host ""; pages that repeat count as
pages each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytespan.llm.common import saved, ship

LEAST_PAGES, LEAST_SHARE, PAGES_A_CONTENT = 3, 0.02, 5
#: Up to so many template subtrees are broadcast (8 bytes and the host each); beyond, they are joined to the pages.
BROADCAST_TEMPLATES = 200_000

# HTML element names by their role, and the words by which pages name what isn't content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOX = frozenset("address center details dir div dl fieldset figure menu nav ol section table ul aside footer header form".split())
DROPPED = frozenset(
    "head script style noscript template iframe object embed applet svg canvas audio video map nav footer aside form button select textarea input label "
    "fieldset dialog menu datalist output progress meter title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist note status".split())
NAMES = frozenset(
    "nav navigation navbar menu menus breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside rail ad ads adv advert adverts advertisement advertising adsbygoogle "
    "banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert warning popup modal overlay newsletter subscribe subscription signup "
    "login signin register social share sharing related recommended recommendations comment comments commentlist disqus respond replies reply form search searchbox pagination pager "
    "widget copyright disclaimer legal skip tracking hidden".split()
)
CLOSES = {
    "p": ({"p"}, BLOCK - {"p"}), "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}  # what an opening tag closes, and what it doesn't look beyond
#: A tag, its quotes closed or else up to the next ">".
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^"'>]|"[^"]*"|'[^']*')*+)>|([^>]*)>)""")
RAW_ENDS = {tag: re.compile(rf"</{tag}\s*/?>", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: its tag, attributes and what it holds, texts or elements."""

    __slots__ = ("attrs", "hash", "has_article", "holds", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.holds, self.hash, self.has_article = tag, attrs, [], 0, False


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        value = value[1:-1] if value[:1] in "\"'" else value
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


class Open:
    """The open elements, innermost last, and where those of each name stand, so that none is searched for."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks, self.solid = [root], {}, [0], [0]

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in BLOCK:
            self.blocks.append(at)
            if node.tag != "p":
                self.solid.append(at)

    def cut(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        for node in self.stack[at:]:
            self.places[node.tag].pop()
        del self.stack[at:]
        for held in (self.blocks, self.solid):
            while held[-1] >= at:
                held.pop()

    def last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def parse(page: str) -> Node:
    """The tree of a page, in one pass; texts are decoded already."""
    root = Node("#root", {})
    open_, at, pos, no_cdata = Open(root), 0, 0, False
    stack = open_.stack

    def text(upto: int) -> None:
        if upto > at:
            part = page[at:upto]
            stack[-1].holds.append(html.unescape(part) if "&" in part else part)

    while (begin := page.find("<", pos)) >= 0:
        if page.startswith("<!--", begin):
            text(begin)
            end = page.find("-->", begin + 4)
            at = pos = end + 3 if end >= 0 else len(page)
            continue
        if not no_cdata and page.startswith("<![CDATA[", begin):
            end = page.find("]]>", begin + 9)
            no_cdata = end < 0
            if not no_cdata:
                text(begin)
                stack[-1].holds.append(page[begin + 9 : end])
                at = pos = end + 3
                continue
        close = page.find(">", begin)
        if close < 0:
            break  # no tag ends any more
        if page[begin + 1] in "!?":
            text(begin)
            at = pos = close + 1
            continue
        found = TAG.match(page, begin)
        if not found:
            pos = begin + 1
            continue
        text(begin)
        at = pos = found.end()
        tag = found[2].lower()
        if found[1]:  # a closing tag
            place = open_.last((tag,))
            if place and (tag in BLOCK or open_.blocks[-1] < place):  # a stray inline tag closes no block
                open_.cut(place)
            continue
        closes, limit = CLOSES.get(tag, CLOSES["p"] if tag in BLOCK else (frozenset(), frozenset()))
        if closes and (place := open_.last(closes)) > (open_.solid[-1] if limit is CLOSES["p"][1] else open_.last(limit)):
            open_.cut(place)
        rest = found[3] if found[3] is not None else found[4]
        node = Node(tag, attributes(rest) if rest and not rest.isspace() else {})
        stack[-1].holds.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = RAW_ENDS[tag].search(page, pos)
            at = pos = end.end() if end else len(page)
            continue
        open_.push(node)
    text(len(page))
    return root


def mark_articles(node: Node) -> bool:
    """Note for every element whether it is or holds an article or main element; depth is bounded by deep_safe()."""
    node.has_article = node.tag in ("article", "main")
    for c in node.holds:
        if type(c) is Node and mark_articles(c):
            node.has_article = True
    return node.has_article


def declared(node: Node, inside: bool) -> bool:
    """Whether tag or attributes say that an element isn't content. inside: within an article."""
    if node.tag in DROPPED:
        return True
    if node.tag == "header":
        return not inside
    a = node.attrs
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    if node.tag in ("html", "body", "article", "main"):
        return False
    names = {p.lower() for p in PARTS.findall(a.get("class", "") + " " + a.get("id", ""))}
    if inside:
        names -= {"header", "legal", "note", "search", "form"}
    return not names.isdisjoint(NAMES)


def block_hash(node: Node) -> bytes:
    """Hash of an element's subtree; blocks also keep theirs."""
    h = hashlib.blake2b(f"{node.tag}\0{node.attrs.get('class', '')}\0{node.attrs.get('id', '')}".encode("utf-8", "surrogatepass"), digest_size=8)
    for c in node.holds:
        if type(c) is Node:
            h.update(b"\1" + block_hash(c))
        else:
            h.update(b"\2" + " ".join(c.split()).encode("utf-8", "surrogatepass"))
    out = h.digest()
    node.hash = int.from_bytes(out, "little", signed=True)
    return out


def outside(root: Node) -> Iterator[Node]:
    """Block elements that are neither an article nor hold one nor are inside one."""
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag in ("article", "main"):
            continue
        if n.tag in BLOCK and n.tag not in ("html", "body") and not n.has_article:
            yield n
        todo += [c for c in n.holds if type(c) is Node]


def deep_safe(page: str | None) -> Node:
    """The tree, its depth bounded: what lies deeper than any sane page is hung higher, no text is lost."""
    root = parse(page or "")
    todo = [(root, 0)]
    while todo:
        n, d = todo.pop()
        if d >= 200:
            flat, rest = [], list(reversed(n.holds))
            while rest:
                c = rest.pop()
                if type(c) is Node and c.holds:
                    flat.append(Node("br", {}))
                    rest += reversed(c.holds)
                else:
                    flat.append(c)
            n.holds = flat
            continue
        todo += [(c, d + 1) for c in n.holds if type(c) is Node]
    mark_articles(root)
    return root


def boxes(article: Node) -> Iterator[tuple[Node, int]]:
    """Boxes inside an article, each with its content: the least hash of the three-word runs of the article's rest."""
    words: list[str] = []
    spans: list[tuple[Node, int, int]] = []

    def walk(node: Node) -> None:
        begin = len(words)
        for c in node.holds:
            if type(c) is Node:
                walk(c)
            else:
                words.extend(c.split())
        if node.tag in BOX and node is not article:
            spans.append((node, begin, len(words)))

    walk(article)
    if not spans:
        return
    runs = [zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(len(words) - 2)]
    none = 1 << 32
    before, after = list(accumulate(runs, min, initial=none)), list(accumulate(reversed(runs), min, initial=none))[::-1]
    for node, begin, end in spans:
        # before[k] is of the first k runs, after[k] of those from k on
        yield node, min(before[max(begin - 2, 0)], after[min(end, len(runs))])


def in_article(h: int) -> int:
    """The key of a subtree inside an article: what recurs outside of articles says nothing about it, and the reverse."""
    return h ^ 0x5555555555555555


def counted_subtrees(page: str | None) -> list[tuple[int, int]]:
    """Distinct (hash, content) of a page's block elements; outside of its articles the content is 0."""
    root = deep_safe(page)
    block_hash(root)
    found = {n.hash: 0 for n in outside(root)}
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag in ("article", "main"):
            found |= {in_article(b.hash): content for b, content in boxes(n)}
        else:
            todo += [c for c in n.holds if type(c) is Node]
    return sorted(found.items())


def subtree_hashes(page: str | None) -> list[int]:
    """Distinct keys of a page's block elements."""
    return [h for h, _ in counted_subtrees(page)]


def read_blocks(root: Node, template: frozenset[int] | set[int]) -> list[str]:
    """The texts of the blocks that stay, in page order: of articles if they hold half of the text, else of the body."""
    blocks: list[tuple[str, bool]] = []
    run: list[str] = []

    def end(inside: bool) -> None:
        if run and (folded := " ".join("".join(run).split())):
            blocks.append((folded, inside))
        run.clear()

    def walk(node: Node, inside: bool) -> None:
        holds_article = not inside and node.has_article
        if not holds_article or node.tag in DROPPED:
            known = in_article(node.hash) in template and node.tag in BOX if inside else node.hash in template and node.tag in BLOCK
            if known or declared(node, inside):
                end(inside)
                return
        parts = node.tag in BLOCK or node.tag == "br"
        if parts:
            end(inside)
        inside = inside or node.tag in ("article", "main")
        for c in node.holds:
            if type(c) is Node:
                walk(c, inside)
            else:
                run.append(c)
        if parts:
            end(inside)

    walk(root, False)
    end(False)
    within = sum(len(text) for text, inside in blocks if inside)
    only_article = within > 0 and 2 * within >= sum(len(text) for text, _ in blocks)
    return [text for text, inside in blocks if inside or not only_article]


def main_text(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of one page, without its site's template."""
    root = deep_safe(page)
    if template:
        block_hash(root)
        if out := read_blocks(root, template):
            return " ".join(out)
    return " ".join(read_blocks(root, frozenset()))


def host_of(url: str = "url"):
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.lower(found)


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, hash) of the subtrees that recur across many pages of their host."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hosts, hashes, contents = [], [], []
            for host, page in zip(frame["host"].tolist(), frame["html"].tolist(), strict=True):
                own = counted_subtrees(page)
                hosts += [host] * len(own)
                hashes += [h for h, _ in own]
                contents += [c for _, c in own]
            yield pd.DataFrame({"host": pd.Series(hosts, dtype=object), "hash": pd.Series(hashes, dtype="int64"), "content": pd.Series(contents, dtype="int64")})

    rows = pages.select(host_of().alias("host"), "html")
    seen = rows.mapInPandas(run, "host string, hash long, content long").groupBy("host", "hash", "content").agg(F.count("*").alias("pages"))
    counted = seen.groupBy("host", "hash").agg(F.sum("pages").alias("pages"), F.count("*").alias("contents"), F.max("content").alias("content"))
    counted = counted.filter((F.col("content") == 0) | ((F.col("contents") >= least_pages) & (PAGES_A_CONTENT * F.col("contents") >= F.col("pages"))))
    hosts = rows.groupBy("host").agg(F.count("*").alias("all"))
    return counted.filter(F.col("pages") >= least_pages).join(hosts, "host").filter(F.col("pages") >= least_share * F.col("all")).select("host", "hash")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    spark = pages.sparkSession
    ship(spark)
    found = saved(templates(pages))
    rows = pages.select("page_id", "url", host_of().alias("host"), "html")
    kind = dict(pages.dtypes)["page_id"]
    schema = f"page_id {kind}, url string, text string"
    if found.count() <= BROADCAST_TEMPLATES:
        by_host: dict[str, set[int]] = {}
        for r in found.collect():
            by_host.setdefault(r["host"], set()).add(r["hash"])
        shared = spark.sparkContext.broadcast(by_host)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                texts = [main_text(p, shared.value.get(h, frozenset())) for h, p in zip(frame["host"].tolist(), frame["html"].tolist(), strict=True)]
                yield frame[["page_id", "url"]].assign(text=texts)

        return rows.mapInPandas(run, schema)

    def hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = [(m, h, x) for m, h, p in zip(frame["mark"].tolist(), frame["host"].tolist(), frame["html"].tolist(), strict=True) for x in subtree_hashes(p)]
            yield pd.DataFrame(own, columns=["mark", "host", "hash"])

    def with_hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(p, set() if t is None else set(t)) for t, p in zip(frame["hits"].tolist(), frame["html"].tolist(), strict=True)]
            yield frame[["page_id", "url"]].assign(text=texts)

    # a page is known by its host and content: equal pages of a host have equal hits
    marked = rows.withColumn("mark", F.xxhash64("host", "html"))
    hits = marked.mapInPandas(hashes, "mark long, host string, hash long").distinct().join(found, ["host", "hash"]).groupBy("mark").agg(F.collect_set("hash").alias("hits"))
    return marked.join(hits, "mark", "left").mapInPandas(with_hits, schema)
