"""Main text of HTML pages, with site templates removed.

A page is parsed once into a tree of all its elements, and each block-level element is named by a hash of its
whole subtree (tag, texts and children), boilerplate included. Spark counts each hash per host over the
host's different pages: rows of one URL, or of one content, are one page. A subtree on MIN_PAGES pages is
template and its blocks go, unless it holds more than half of the page's main text or is itself a paragraph, a heading
or the like inside main content. Of what is left, rules drop by tag, role and class name what differs from
page to page but is never main text (menus, adverts, notices, forms, reader comments); and the main content is
that of the highest rank (article, main, content by name) that holds half of the rest.

Defined results: a null or empty page, or one without main text, gives an empty text; a page of which templates, or
class names, would leave nothing keeps what they would take; pages without a host share the host ``''``; a page
without a URL is told apart by its content; rows equal in all columns get a row each with the same result.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded
from .simhash import _mixed

MIN_PAGES = 5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>|([^<]+|<)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")

#: Elements of HTML by what they mean here.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr",
}
DROPPED = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "object", "applet", "canvas", "audio", "video", "input", "fieldset", "datalist", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist", "note"}
CLASSES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "adbox", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "disclaimer", "newsletter", "subscribe", "subscription", "signup", "signin", "login", "popup", "modal", "overlay", "paywall", "sidebar", "sidebars",
    "aside", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "foot", "masthead", "topbar", "toolbar",
    "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion", "share", "sharing", "social", "related", "recommended", "recommendations", "widget",
    "widgets", "search", "searchbox", "form", "skip", "toc", "tags",
}
HEADER_CLASSES = {"header", "head", "site-header", "pageheader"}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


#: What may stand beside a boilerplate word in a class name for the whole to mean the same: related-posts, but not search-algorithms.
PLAIN_PARTS = {
    "area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "col", "container", "icons", "inner", "item", "items", "left", "links", "list", "main", "outer", "page", "panel",
    "post", "posts", "right", "row", "section", "site", "stories", "text", "title", "top", "wrap", "wrapper",
}
#: Elements that are text themselves: inside main content they are never template, however often they recur.
TEXT_LEVEL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "tr", "figcaption", "caption", "hgroup", "center", "address"}
#: Why a block is no main text: by its tag, role or style; by its class names.
BY_TAG, BY_CLASS = 1, 2


class Element:
    __slots__ = ("tag", "digest", "dropped", "main", "own", "first", "last", "within")

    def __init__(self, tag: str, dropped: int, main: int, first: int, within: bool):
        self.tag, self.dropped, self.main, self.first, self.within = tag, dropped, main, first, within
        self.digest = xxhash.xxh64(tag)
        self.own = self.last = 0


def _boilerplate(tag: str, attrs: str, inside_main: int) -> int:
    if tag in DROPPED or (tag == "header" and not inside_main):
        return BY_TAG
    if not attrs:
        return 0
    found = {}
    for name, a, b, c in _ATTR.findall(attrs):
        found.setdefault(name.lower(), a or b or c)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return BY_TAG
    if found.get("role", "").lower() in ROLES:
        return BY_TAG
    if tag in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
        return 0
    tokens = [set(re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", t).lower())) for t in f"{found.get('class', '')} {found.get('id', '')}".split()]
    if inside_main:  # only names that say nothing else
        tokens = [t for t in tokens if not {x for x in t if not x.isdigit()} - CLASSES - PLAIN_PARTS]
        names = set().union(*tokens) - {"tags"}
    else:
        names = set().union(*tokens)
    if names & {"has", "with", "no", "without"}:
        names -= {"sidebar", "sidebars", "nav", "menu", "footer", "header", "banner", "comments", "ads", "ad"}  # says how a page is laid out
    if tag == "article" and not names & {"comment", "comments", "reply", "ad", "advert", "advertisement", "sponsored", "related", "promo"}:
        return 0
    return BY_CLASS if names & CLASSES or (not inside_main and names & HEADER_CLASSES) else 0


def _main_rank(tag: str, attrs: str) -> int:
    """3 for an article, 2 for main, 1 for what its attributes call the content, else 0."""
    if tag == "article":
        return 3
    if tag == "main" or re.search(r"""role\s*=\s*["']?main\b""", attrs, re.I):
        return 2
    if re.search(r"""itemprop\s*=\s*["']?articleBody|(?:class|id)\s*=\s*["']?(?:[^"']*[\s_-])?(?:article|post|entry|content|story)(?:[\s_-](?:body|content|text))?["'\s>]""", attrs + " ", re.I):
        return 1
    return 0


class _Open:
    """The open elements, with the places of each tag, so that no question walks up the tree."""

    def __init__(self):
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, e: Element):
        at = len(self.stack)
        self.stack.append(e)
        self.places.setdefault(e.tag, []).append(at)
        if e.tag not in INLINE:
            self.blocks.append(at)

    def pop(self) -> Element:
        e = self.stack.pop()
        self.places[e.tag].pop()
        if e.tag not in INLINE:
            self.blocks.pop()
        return e

    def last(self, tags) -> int:
        """The place of the innermost element with one of the tags, -1 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)


def parse(page: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int, bool]]]:
    """Blocks of text in page order and the block-level elements around them.

    A block is (text, why it is dropped or 0, rank of the main content it is in), an element (hash of its subtree,
    first block, end, whether it is a text of main content). Linear in the page, however deep it is.
    """
    blocks: list[tuple[str, int, int]] = []
    elements: list[tuple[int, int, int, bool]] = []
    root = Element("", 0, 0, 0, False)
    opened, now, buffer = _Open(), root, []

    def flush():
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                blocks.append((text, now.dropped, now.main))

    def close():
        """Ends the innermost element; its digest goes into its parent's."""
        nonlocal now
        e = opened.pop()
        now = opened.stack[-1] if opened.stack else root
        own = e.digest.intdigest()
        now.digest.update(own.to_bytes(8, "little"))
        if e.tag not in INLINE and len(blocks) > e.first:
            elements.append((own, e.first, len(blocks), e.within and e.tag in TEXT_LEVEL))

    def close_to(tags, scopes=()):
        at = opened.last(tags)
        if at >= 0 and at > opened.last(scopes):
            while len(opened.stack) > at:
                close()

    text = page or ""
    at, end = 0, len(text)
    while at < end:
        m = _TOKEN.match(text, at)
        at = m.end()
        if m[7] is not None:
            words = html.unescape(m[7])
            buffer.append(words)
            if squeezed := " ".join(words.split()):
                now.digest.update(squeezed.encode("utf-8", "surrogatepass"))
            continue
        tag = m[2] or m[5]
        if not tag:
            continue  # comment, doctype, processing instruction
        tag, closing, attrs = tag.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if tag not in INLINE:
            flush()
        if closing:
            place = opened.last((tag,))
            if place >= 0 and not (tag in INLINE and opened.blocks and opened.blocks[-1] > place):
                if now.dropped:
                    flush()
                close_to((tag,))
            continue
        if tag in VOID:
            now.digest.update(tag.encode())
            continue
        if tag in _CLOSES_P:
            close_to(("p",), ("table", "td", "th", "li", "button", "article", "section", "div", "main", "aside", "nav", "footer"))
        if tag in _SIBLINGS:
            close_to(_SIBLINGS[tag], _SCOPES[tag])
        dropped = now.dropped or _boilerplate(tag, attrs, now.main)
        if dropped and not now.dropped:
            flush()
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at) if not attrs.endswith("/") else None
            at = stop.end() if stop else (at if attrs.endswith("/") else end)
            continue
        if attrs.endswith("/") and tag not in ("div", "p", "article", "section"):
            continue
        rank = 0 if dropped else _main_rank(tag, attrs)
        within = now.main > 0 and not dropped
        now = Element(tag, dropped, max(now.main, rank), len(blocks), within)
        opened.push(now)
    flush()
    while opened.stack:
        close()
    return blocks, elements


def states(blocks: list[tuple[str, int, int]]) -> list[int]:
    """0 for a block of main text, 1 for one that the rules drop, 2 for one outside the main content.

    Main content is of the highest rank that holds half of what the rules leave. Class names are passed over on a
    page of which they would leave nothing.
    """
    relaxed = all(why for _, why, _ in blocks)
    out = [why == BY_TAG or (why == BY_CLASS and not relaxed) for _, why, _ in blocks]
    chars = [0] * 4
    for (text, _, main), gone in zip(blocks, out, strict=True):
        if not gone:
            for r in range(main + 1):
                chars[r] += len(text)
    rank = max((r for r in range(4) if 2 * chars[r] >= chars[0]), default=0)
    return [1 if gone else 2 if main < rank else 0 for (_, _, main), gone in zip(blocks, out, strict=True)]


_BLOCKS = "rid long, page_id long, url string, url_hash long, content long, texts array<string>, state array<int>, keys array<long>, first array<int>, last array<int>"


def _parsed(batches):
    """Rows (rid, page_id, url, url_hash, content, host, html); a key names an element's subtree on its host."""
    for batch in batches:
        for part in bounded(batch, 6, 1 << 21):
            texts, state, keys, first, last = [], [], [], [], []
            for h, host in zip(part.column(6), part.column(5).to_pylist(), strict=True):
                blocks, elements = parse(h.as_py())
                which = states(blocks)
                kept = np.concatenate([[0], np.cumsum([len(t) if not s else 0 for (t, _, _), s in zip(blocks, which, strict=True)], dtype=np.int64)])
                # what holds more than half of the main text is the article, not a template; neither is a text of it
                mine = [e for e in elements if not e[3] and 2 * (kept[e[2]] - kept[e[1]]) <= kept[-1]]
                hashes = np.array([e[0] for e in mine], np.uint64)
                with np.errstate(over="ignore"):
                    keys.append(_mixed(hashes ^ np.uint64(host & (1 << 64) - 1), 1).view(np.int64))
                first.append(np.array([e[1] for e in mine], np.int32))
                last.append(np.array([e[2] for e in mine], np.int32))
                texts.append([t for t, _, _ in blocks])
                state.append(which)
            arrays = [pa.array(texts, pa.list_(pa.string())), pa.array(state, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int32())), pa.array(last, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:5], *arrays], [f.split()[0] for f in _BLOCKS.split(", ")])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def site_templates(parsed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(key): the subtrees that stand on min_pages of a host's pages; rows of one URL, or of one content, are one page."""
    each = parsed.select(F.explode(F.array_distinct("keys")).alias("key"), "url_hash", "content")
    pages = each.groupBy("key", "url_hash").agg(F.min("content").alias("content")).groupBy("key", "content").agg(F.lit(1).alias("one"))
    return pages.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("key")


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_template", T.LongType()), T.StructField("n_rules", T.LongType()), T.StructField("n_outside", T.LongType())])


def _assembled(texts: list[str], state: list[int], spans) -> dict:
    """The main text without the blocks in template spans, unless these are all there is."""
    edge = np.zeros(len(texts) + 1, np.int64)
    for first, last in spans:
        edge[first] += 1
        edge[last] -= 1
    covered = np.cumsum(edge)[:-1] > 0
    which = np.array(state, np.int64)
    main = which == 0
    if main.any() and not (main & ~covered).any():
        covered &= ~main
    kept = np.flatnonzero(main & ~covered)
    return {"text": " ".join(texts[i] for i in kept), "n_template": int(covered.sum()), "n_rules": int((~covered & (which == 1)).sum()), "n_outside": int((~covered & (which == 2)).sum())}


def _among(keys: np.ndarray, templates: np.ndarray) -> np.ndarray:
    """Which keys are templates; these are sorted, so each key takes a search and none a pass over all of them."""
    if not len(templates):
        return np.zeros(len(keys), bool)
    return templates[np.minimum(np.searchsorted(templates, keys), len(templates) - 1)] == keys


def _assemble(templates: np.ndarray | None):
    """A function of (texts, state, keys, first, last); with no templates (sorted) given, keys holds 1 for the elements that are one."""

    @F.arrow_udf(_RESULT)
    def run(texts: pa.Array, state: pa.Array, keys: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        k, a, b = (x.flatten().to_numpy(zero_copy_only=False) for x in (keys, first, last))
        hits = np.flatnonzero(k == 1 if templates is None else _among(k, templates))
        edge = [0, *np.searchsorted(hits, ends).tolist()]
        spans = list(zip(a[hits].tolist(), b[hits].tolist(), strict=True))
        out = [_assembled(t.as_py(), s.as_py(), spans[x:y]) for t, s, x, y in zip(texts, state, edge, edge[1:], strict=False)]
        return pa.array(out, pa.struct([("text", pa.string()), ("n_template", pa.int64()), ("n_rules", pa.int64()), ("n_outside", pa.int64())]))

    return run


#: Up to so many template keys (16 MB) go to the tasks as they are; more are joined.
SENT_KEYS = 1 << 21


def main_text(pages: DataFrame, *, min_pages: int = MIN_PAGES, sent_keys: int = SENT_KEYS) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, and the blocks that templates, rules and the choice of the main content removed."""
    scratch = Scratch(pages.sparkSession, "html")
    url, page = F.col("url").cast("string"), F.col("html").cast("string")
    content = F.xxhash64(page)
    rows = pages.select(
        F.xxhash64(F.col("page_id").cast("long"), url, page).alias("rid"), F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
        F.when(url.isNull(), content).otherwise(F.xxhash64(url)).alias("url_hash"), content.alias("content"), F.xxhash64(host_of(url)).alias("host"), page.alias("html"),
    )
    parsed = scratch.keep(rows.mapInArrow(_parsed, _BLOCKS), "blocks")
    templates = scratch.keep(site_templates(parsed, min_pages), "templates")
    if templates.limit(sent_keys + 1).count() <= sent_keys:
        sent = np.sort(templates.toArrow().column(0).to_numpy())
        out = parsed.withColumn("r", _assemble(sent)("texts", "state", "keys", "first", "last"))
    else:
        elements = parsed.select("rid", F.explode(F.arrays_zip("keys", "first", "last")).alias("e")).select("rid", F.col("e.keys").alias("key"), "e.first", "e.last")
        hits = elements.join(templates, "key").groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("hits"))
        spans = F.coalesce("hits", F.array().cast("array<struct<first: int, last: int>>"))
        joined = parsed.join(hits, "rid", "left").withColumn("spans", spans)
        out = joined.withColumn("r", _assemble(None)("texts", "state", F.transform("spans", lambda x: F.lit(1).cast("long")), "spans.first", "spans.last"))
    return out.select("page_id", "url", "r.text", F.length("r.text").cast("long").alias("n_chars"), F.size("texts").cast("long").alias("n_blocks"), "r.n_template", "r.n_rules", "r.n_outside")
