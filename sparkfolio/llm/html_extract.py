"""Main-text extraction with a site style tree.

*Site style tree.*  The DOMs of one host are merged: an element is identified by its
path of (tag, class, id, ordinal), its presentation by the sequence of its children,
its content by its text.  Over the distinct pages of a host that have an element, the
normalised entropy of its presentations and of its contents says how much it varies;
what is the same everywhere has importance 0.  A page's node has the composite
importance ``(1 - g**l) * presentation + g**l * mean(children)`` with ``l`` children,
a leaf that of its content.  Branches under ``min_importance`` are removed.

*Marked main parts.*  Where a page marks its main part (``main`` or ``article``), the
text comes from there.  Inside it the tree judges blocks by the entropy of their content
alone, over the host's *different main texts* (pages with the same one count once), and
never headings, list items or words in a line: a block that different articles repeat at
the same place is furniture.  If that would take more than ``MAX_SHARE`` of the text, the
page is one of many copies of an article, whose text only looks like furniture, and
keeps it all.  On pages without a mark the tree decides everywhere; if nothing would be
left, the structural result stands.

*Structure.*  Elements that say what they are (navigation, header, footer, aside, form,
dialogs, roles, class and id names for menus, adverts, notices, reader comments, ...) are
removed on any host, also on one with a single page.  A name counts if all its words are
of that kind or neutral (``related-posts``, not ``related-work``).  An article's own
header keeps its headings and lead paragraphs.

Statistics are aggregates over (element, value) with map-side combining, so a host
with a third of all pages is no group of its own anywhere; byte-equal pages count
once.  Importances come back to pages by a join of stored tables.

Defined results for odd input: null or empty html gives an empty text; cut-off tags,
references and comments are handled as browsers do; unclosed elements end where their
parents do; null urls share the empty host; repeated rows give repeated rows; an empty
table gives an empty result; very long pages are processed whole; further columns of any
name are ignored.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stash

MIN_PAGES, MIN_IMPORTANCE, DAMPING, MAX_SHARE = 5, 0.2, 0.9, 1 / 3

_RAW = "script|style|textarea|title|noscript|iframe|xmp|noembed|noframes|svg|math|template|select|object|canvas|video|audio"
_TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>{_RAW})(?=[\s/>])(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|</(?P<end>[a-z][^\s/>]*)[^>]*>"
    r"|<(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<lax>[a-z][^\s/>]*)(?P<laxattrs>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-z][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ATTR_NAMES = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop"))

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"body", "head", "html", "tr", "tbody", "tfoot", "thead", "caption", "legend"}
#: Start tag -> elements it ends if they are open, and where to stop looking.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_DROP_TAGS = frozenset("head nav header footer aside form dialog menu button input label fieldset".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class or id names that mark what isn't main text.
_DROP_WORDS = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer disqus feedback footer footnav form gdpr header login masthead menu menubar modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion promotions related "
    "replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Words that may stand beside those in a name without changing what it marks.
_NEUTRAL_WORDS = frozenset(
    "article articles area bar block bottom box btn button buttons col column container content cta field fixed global group holder icon icons "
    "inner item items js label left link links list media message module outer page panel post posts primary region right row secondary section "
    "site slot sticky text thread title tool tools top unit wrap wrapper".split()
)
#: Words in class or id names of paragraphs in an article's header that aren't its lead.
_BYLINE_WORDS = frozenset("author byline date dateline meta published tags time timestamp updated".split())
#: Blocks that the tree may remove inside a marked main part.
_INNER = frozenset("address aside blockquote center details dir div dl figure menu ol p pre section table ul".split())
#: Those of them that make an ``article`` no main part.
_ARTICLE_WORDS = frozenset("ad advert comment comments promo related sponsored".split())
_NEVER = frozenset("html body main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Node:
    __slots__ = ("tag", "name", "drop", "parent", "parts", "main")

    def __init__(self, tag: str, name: str, drop: bool, parent):
        self.tag, self.name, self.drop, self.parent = tag, name, drop, parent
        self.parts: list = []
        self.main = False


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text) if text.strip() else ():
        name = m[1].lower()
        if name in _ATTR_NAMES and name not in out:
            out[name] = _html.unescape(m[2] or m[3] or m[4] or "")
    return out


def _words(text: str) -> set[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    return set(re.split(r"[^a-z]+", spaced.lower())) - {""}


def _marks(names: str, kinds: frozenset[str]) -> bool:
    """Whether one of the names has such a word, and beside it only such or neutral ones."""
    return any(words & kinds and words <= kinds | _DROP_WORDS | _NEUTRAL_WORDS for words in map(_words, names.split()))


def _dropped(tag: str, attrs: dict[str, str]) -> bool:
    if tag in _NEVER:
        return False
    if tag in _DROP_TAGS or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if attrs.get("role", "").lower() in _DROP_ROLES or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True
    names = attrs.get("class", "") + " " + attrs.get("id", "")
    return bool(names.strip()) and _marks(names, _ARTICLE_WORDS if tag == "article" else _DROP_WORDS)


def parse(source: str) -> _Node:
    """The DOM of a page, as far as blocks and branches need it."""
    root = _Node("#root", "", False, None)
    node, at = root, 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            node.parts.append(_html.unescape(source[at : m.start()]))
        at = m.end()
        tag = m["tag"] or m["lax"]
        if tag:
            tag = tag.lower()
            if tag == "br":
                node.parts.append(" ")
                continue
            if tag in _CLOSES_P:
                up = node
                while up.parent is not None and up.tag != "p" and (up.tag not in _BLOCK):
                    up = up.parent
                if up.tag == "p":
                    node = up.parent
            if tag in _IMPLIED:
                ends, stop = _IMPLIED[tag]
                up = node
                while up.parent is not None and up.tag not in ends and up.tag not in stop:
                    up = up.parent
                if up.tag in ends:
                    node = up.parent
            found = m["attrs"] or m["laxattrs"] or ""
            attrs = _attributes(found)
            name = f"{tag}.{attrs.get('class', '')}#{attrs.get('id', '')}"
            child = _Node(tag, name, _dropped(tag, attrs), node)
            child.main = tag in ("main", "article") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop", "") == "articleBody"
            node.parts.append(child)
            if tag not in _VOID and not found.rstrip().endswith("/"):
                node = child
            elif tag not in _VOID and tag in _BLOCK:
                node = child  # a slash closes nothing in HTML
        elif m["end"]:
            tag = m["end"].lower()
            inline = tag not in _BLOCK
            up = node
            while up.parent is not None and up.tag != tag and not (inline and up.tag in _BLOCK):
                up = up.parent
            if up.tag == tag:
                node = up.parent
            elif tag == "p":
                node.parts.append(_Node("p", "p.#", False, node))
    if at < len(source):
        node.parts.append(_html.unescape(source[at:]))
    return root


def _children(node: _Node) -> list[_Node]:
    return [p for p in node.parts if isinstance(p, _Node)]


def _walk(root: _Node):
    """Nodes before their children, without recursion."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(_children(node)))


def _mains(root: _Node) -> list[_Node]:
    """The outermost marked main parts that aren't dropped: ``main`` elements if there are any, else articles."""
    every = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.main and not node.drop:
            every.append(node)
        if not (node.drop and not _holds_main(node)):
            stack.extend(reversed(_children(node)))
    first = [n for n in every if n.tag == "main" or n.name.startswith("main")] or every
    chosen, ids = [], {id(n) for n in first}
    for n in first:
        up = n.parent
        while up is not None and id(up) not in ids:
            up = up.parent
        if up is None:
            chosen.append(n)
    return chosen


def _holds_main(node: _Node) -> bool:
    return node.tag not in _DROP_TAGS and any(n.main and not n.drop for n in _walk(node) if n is not node)


def _blocks(start: list[_Node], skip) -> list[str]:
    """Texts of the blocks below some nodes, in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        if line:
            text = " ".join("".join(line).split())
            if text:
                out.append(text)
            line.clear()

    for top in start:
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                line.append(item)
            else:
                if item is not top and skip(item):
                    if item.tag in _BLOCK:
                        flush()
                    continue
                if item.tag in _BLOCK:
                    flush()
                    stack.append(None)
                elif item.tag in ("td", "th"):
                    line.append(" ")
                stack.extend(reversed(item.parts))
        flush()
    return out


def _elements(root: _Node, host: str, mains: list[_Node]):
    """(node, element hash, inside) of the merged tree; inside marked main parts only blocks that may be furniture."""
    closed = {id(n) for n in mains}
    out = []
    stack = [(root, xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass")), False)]
    while stack:
        node, element, inside = stack.pop()
        if node.parent is not None and (not inside or node.tag in _INNER):
            out.append((node, element, inside))
        inside = inside or id(node) in closed
        seen: dict[str, int] = {}
        for child in _children(node):
            nth = seen[child.name] = seen.get(child.name, -1) + 1
            stack.append((child, xxhash.xxh64_intdigest(f"{element}{'>' if inside else '/'}{child.name}:{nth}".encode("utf-8", "surrogatepass")), inside))
    return out


def _subtree_text(node: _Node) -> str:
    return "\n".join(_blocks([node], lambda _: False))


def host_of(url) -> str:
    if not isinstance(url, str) or "://" not in url:
        return ""
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower()


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def page_elements(pages: DataFrame) -> DataFrame:
    """page_id, page, element, style and content hashes and ``inside`` of every element of the merged trees.

    ``page`` is what counts once: the html, or inside a marked main part its text.
    """

    def run(batches):
        for batch in batches:
            ids, digests, elements, styles, contents, insides = [], [], [], [], [], []
            for page_id, url, source in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                root = parse(source)
                mains = _mains(root)
                digest = _hash(source), _hash("\n".join(_blocks(mains, _rules(mains)))) if mains else 0
                for node, element, inside in _elements(root, host_of(url), mains):
                    ids.append(page_id)
                    digests.append(digest[inside])
                    elements.append(element)
                    styles.append(0 if inside else _hash("|".join(c.name for c in _children(node))))
                    contents.append(_hash(_subtree_text(node)))
                    insides.append(inside)
            yield pd.DataFrame(
                {"page_id": pd.array(ids, dtype="Int64")}
                | {
                    k: np.array(v, np.uint64).view(np.int64)
                    for k, v in (("page", digests), ("element", elements), ("style", styles), ("content", contents))
                }
                | {"inside": np.array(insides, bool)}
            )

    filled = pages.where(F.coalesce(F.length("html"), F.lit(0)) > 0).select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_batches(filled, run, "page_id long, page long, element long, style long, content long, inside boolean")


def _entropy(distinct: DataFrame, value: str, name: str) -> DataFrame:
    """element, inside, pages and the entropy of ``value`` over its pages, divided by the greatest possible."""
    n = F.col("_n").cast("double")
    return (
        distinct.groupBy("element", "inside", value)
        .agg(F.count("*").alias("_n"))
        .groupBy("element", "inside")
        .agg(F.sum("_n").alias("_m"), F.sum(n * F.log(n)).alias("_s"))
        .where(F.col("_m") > 1)
        .select("element", "inside", F.col("_m").alias("pages"), (1 - F.col("_s") / (F.col("_m") * F.log(F.col("_m").cast("double")))).alias(name))
    )


def importances(elements: DataFrame, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """element, inside, pages, presentation, content: the site style trees' entropies, of elements on enough distinct pages.

    Of elements inside marked main parts only those of low importance: the others stay anyway.
    """
    distinct = elements.select("page", "element", "style", "content", "inside").distinct()
    style = _entropy(distinct, "style", "presentation")
    content = _entropy(distinct, "content", "content").drop("pages")
    known = style.where(F.col("pages") >= min_pages).join(content, ["element", "inside"])
    return known.where(~F.col("inside") | (F.col("content") < min_importance))


def composite(root: _Node, host: str, mains: list[_Node], known: dict[int, tuple[float, float]]) -> tuple[dict[int, float], dict[int, float]]:
    """Importance by ``id(node)``: composite outside marked main parts, that of the content inside.

    Elements that aren't known are as important as can be.
    """
    out: dict[int, float] = {}
    within: dict[int, float] = {}
    for node, element, inside in reversed(_elements(root, host, mains)):
        presentation, content = known.get(element, (1.0, 1.0))
        if inside:
            within[id(node)] = content
            continue
        inner = [out[id(c)] for c in _children(node) if id(c) in out]
        if not inner:
            out[id(node)] = content
        else:
            weight = DAMPING ** len(inner)
            value = (1 - weight) * presentation + weight * sum(inner) / len(inner)
            # Text of its own makes a node at least as important as that text varies.
            own = any(isinstance(p, str) and p.strip() for p in node.parts)
            out[id(node)] = max(value, content) if own else value
    return out, within


def _rules(mains: list[_Node]):
    """Whether an element goes for what it says it is."""
    marked = {id(n) for n in mains}

    def structural(node: _Node) -> bool:
        if not node.drop or id(node) in marked:
            return False
        # An article's own header keeps its headings.
        if node.tag == "header" and any(c.tag in _HEADINGS for c in _walk(node)):
            up = node.parent
            while up is not None and not up.main:
                up = up.parent
            if up is not None and up.main:
                return False
        return not _holds_main(node)

    def lead(node: _Node) -> bool:
        return node.tag == "p" and not _words(node.name) & _BYLINE_WORDS and not any(c.tag in ("time", "address") for c in _walk(node))

    def inside_header(node: _Node) -> bool:
        return node.parent is not None and node.parent.tag == "header" and node.tag not in _HEADINGS and not lead(node) and not any(c.tag in _HEADINGS for c in _walk(node))

    return lambda n: structural(n) or inside_header(n)


def page_text(source: str, host: str, known: dict[int, tuple[float, float]], min_importance: float = MIN_IMPORTANCE) -> tuple[str, int]:
    """The main text and the number of branches that the style tree removed."""
    root = parse(source)
    mains = _mains(root)
    rules = _rules(mains)
    outer, inner = composite(root, host, mains, known) if known else ({}, {})
    low = {n for n, v in outer.items() if v < min_importance}
    for n in mains:
        up = n
        while up is not None:
            low.discard(id(up))
            up = up.parent
    furniture = {n for n, v in inner.items() if v < min_importance}
    branches = lambda ids: sum(1 for n in _walk(root) if id(n) in ids and not (n.parent is not None and id(n.parent) in ids)) if ids else 0
    if mains:
        text = _blocks(mains, rules)
        if furniture:
            left = _blocks(mains, lambda n: rules(n) or id(n) in furniture)
            if sum(map(len, left)) >= (1 - MAX_SHARE) * sum(map(len, text)):
                return "\n".join(left), branches(low | furniture)
        return "\n".join(text), branches(low)
    text = _blocks([root], lambda n: rules(n) or id(n) in low)
    if not text:
        return "\n".join(_blocks([root], rules)), 0
    return "\n".join(text), branches(low)


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """page_id, url, text, n_chars, removed_branches (low-importance branches of the site style tree)."""
    elements = stash(page_elements(pages), "elements")
    known = stash(importances(elements, min_pages, min_importance), "importances")
    per_page = (
        elements.select("page_id", "element")
        .join(known.drop("inside").hint("merge"), "element")
        .where("page_id IS NOT NULL")
        .groupBy(F.col("page_id").alias("_p"))
        .agg(F.collect_set(F.struct("element", "presentation", "content")).alias("known"))
    )
    joined = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").join(per_page, F.col("page_id") == F.col("_p"), "left")
    shaped = joined.select(
        "page_id", "url", "html",
        F.col("known.element").alias("element"), F.col("known.presentation").alias("presentation"), F.col("known.content").alias("content"),
    )

    def run(batches):
        for batch in batches:
            texts, removed = [], []
            for url, source, element, presentation, content in zip(
                batch["url"], batch["html"], batch["element"], batch["presentation"], batch["content"], strict=True
            ):
                if not isinstance(source, str) or not source:
                    texts.append("")
                    removed.append(0)
                    continue
                known = {}
                if element is not None:
                    hashes = np.asarray(element, np.int64).view(np.uint64).tolist()
                    known = dict(zip(hashes, zip(presentation, content, strict=True), strict=True))
                text, n = page_text(source, host_of(url), known, min_importance)
                texts.append(text)
                removed.append(n)
            yield pd.DataFrame(
                {"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": list(map(len, texts)), "removed_branches": removed}
            )

    return map_batches(shaped, run, "page_id long, url string, text string, n_chars long, removed_branches long")


def op1_html_extract(spark, sf_dir):
    """The registered query: the main text of every row of ``pages``."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
