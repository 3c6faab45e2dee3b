"""Main text of web pages with a site style tree.

The pages of a host are merged: elements with the same path of tags, classes and ids are
one node of the host's style tree. For every node whose role its mark-up does not settle,
the tree counts which contents it has over the different pages of the host. A node's
importance is the entropy of its contents (1 if every page has its own, 0 if all share
one). Branches of low importance, and single contents that a large part of the host's pages
repeats, are removed from each page.

What the mark-up does settle goes first: navigation, headers, footers, asides, forms,
scripts, styles, hidden parts, and elements whose class or id names such a role, are never
main text. Words that may also name a subject, such as ``related`` or ``search``, settle it
only where the name has no other words than those of roles and layout. If a page has an ``article`` or ``main`` element with text, the text is that of
these elements, and inside them only labelled containers can be found unimportant, never
plain paragraphs; else it is that of the whole body.

Character references are decoded, white space inside a block becomes one space, and blocks
are joined by one space in page order. Null, empty and text-free pages have an empty text.
Pages without a url form one host. Copies of a page count once in the tree. Rows that
repeat are worked each for itself; the tree leaves page text and other columns alone.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import column, tidied
from .tables import keep_rest, modest_batches, settle

#: A node is judged when it stands in so many different pages of its host; importance below
#: LOW makes it noise, as does a content that so large a share of the host's pages repeats.
LEAST_PAGES, LOW, REPEATED = 5, 0.35, 0.3
#: What is on average at least this share of its pages' text is what the pages are about.
BESIDE = 0.5

# Elements of HTML by what they are.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "object", "video", "audio", "canvas", "map", "datalist", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
MAIN = {"article", "main"}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "center", "header", "figure", "blockquote", "td", "span", "p"}

# Words of class and id names that tell a role which is not main text.
NOISE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "banners", "sponsor", "sponsored",
    "promo", "promotion", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "footer",
    "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup",
    "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "signin", "login", "share", "sharing", "social",
    "related", "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "replies", "respond", "widget",
    "widgets", "pagination", "pager", "search", "searchbox", "form", "copyright", "disclaimer", "skip", "hidden",
}
# Those of them that tell a role only alone or beside words of layout.
SUBJECT_WORDS = {
    "related", "recommended", "recommendations", "search", "notice", "notices", "notification", "alert", "form", "skip", "respond",
    "replies", "copyright", "disclaimer", "sponsor", "sponsored", "promotion", "subscription", "share", "sharing", "social", "overlay",
}
# Words of class and id names that tell a place and no role.
LAYOUT_WORDS = {
    "area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "col", "container", "global", "icon", "icons", "inner", "item",
    "items", "js", "left", "link", "links", "list", "local", "outer", "panel", "primary", "right", "row", "secondary", "section", "site",
    "slot", "sticky", "top", "unit", "wrap", "wrapper", "zone",
}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "note"}
HEADER_WORDS = {"header", "head"}
MAIN_WORDS = {"article", "articlebody", "maincontent", "postcontent", "entrycontent"}

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "td", "th"}


class Page:
    """The elements of a page and its pieces of text, in order.

    ``elements`` holds (parent, signature, noise, main) and ``pieces`` (element, text); a
    piece of None ends a block.
    """

    def __init__(self, source: str):
        self.elements: list[tuple[int, str, bool, bool]] = [(-1, "", False, False)]
        self.pieces: list[tuple[int, str | None]] = []
        stack, tags, open_ = [0], [""], Counter()
        pos = 0

        def pop_to(n: int) -> None:
            while len(stack) > n:
                stack.pop()
                tag = tags.pop()
                open_[tag] -= 1
                if tag not in INLINE:
                    self.pieces.append((stack[-1], None))

        def close(names: set[str], scope: set[str]) -> None:
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] in names:
                    pop_to(i)
                    return
                if tags[i] in scope:
                    return

        n = len(source)
        while pos < n:
            m = _TOKEN.search(source, pos)
            if m is None:
                self.pieces.append((stack[-1], source[pos:]))
                break
            if m.start() > pos:
                self.pieces.append((stack[-1], source[pos:m.start()]))
            pos = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if open_[tag]:
                    i = len(tags) - 1
                    while tags[i] != tag:
                        i -= 1
                    pop_to(i)
                elif tag in ("br", "p"):
                    self.pieces.append((stack[-1], None))
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    self.pieces.append((stack[-1], None))
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, pos)
                pos = end.end() if end else n
                continue
            if tag not in INLINE and open_["p"]:
                close({"p"}, _SCOPE)
            if tag in _CLOSES:
                close(_CLOSES[tag], _SCOPE - {"td", "th"} if tag == "tr" else _SCOPE - _CLOSES[tag])
            if tag not in INLINE:
                self.pieces.append((stack[-1], None))
            self.elements.append(self._element(stack[-1], tag, m[3]))
            stack.append(len(self.elements) - 1)
            tags.append(tag)
            open_[tag] += 1
            if m[3].endswith("/") and tag in ("svg", "path"):
                pop_to(len(stack) - 1)

    def _element(self, parent: int, tag: str, source: str) -> tuple[int, str, bool, bool]:
        attrs = {}
        if source and not source.isspace():
            for a in _ATTR.finditer(source):
                attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        _, _, above_noise, above_main = self.elements[parent]
        names = telling_words(named) if named else set()
        joined = {re.sub(r"[^a-z]", "", x.lower()) for x in named.split()}
        main = tag in MAIN or attrs.get("role") in MAIN or bool(joined & MAIN_WORDS) or attrs.get("itemprop") == "articleBody"
        noise = tag in NEVER or bool(names & NOISE_WORDS) or attrs.get("role") in NOISE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))
        if not above_main and (tag == "header" or names & HEADER_WORDS):
            noise = True
        if tag in ("html", "body") or (main and tag in MAIN and not names & {"comment", "comments"}):
            noise = False
        label = ".".join(sorted(re.sub(r"\d+", "0", named).split()))
        return parent, f"{tag}.{label}" if label else tag, noise or above_noise, main or above_main

    def has_main(self) -> bool:
        return any(t and not t.isspace() and self.elements[e][3] and not self.elements[e][2] for e, t in self.pieces)

    def nodes(self) -> Iterator[tuple[int, str, str, float]]:
        """(element, key of its path, key of path and content, share of the page's text) of the containers that the mark-up does not settle.

        A path is a running hash, so it has one size at any depth. The pieces below an element
        stand side by side, so its content is a stretch of the page's text, which is made once.
        """
        judged = [i for i, e in enumerate(self.elements) if i and not e[2] and self._unsettled(i)]
        if not judged:
            return
        paths = [""]
        for parent, sig, _, _ in self.elements[1:]:
            paths.append(key(paths[parent], sig))
        first, last = [-1] * len(self.elements), [-1] * len(self.elements)
        parts, size, blank, whole = [], 0, True, 0
        for e, t in self.pieces:
            t = " " if t is None else html.unescape(t)
            text = " ".join(t.split())
            if not blank and (t[:1].isspace() or not text and t):
                text = f" {text}"
            if text and t[-1:].isspace() and text != " ":
                text += " "
            if not text:
                continue
            blank = text[-1] == " "
            parts.append(text)
            whole += 0 if self.elements[e][2] else len(text)
            if text != " ":
                if first[e] < 0:
                    first[e] = size
                last[e] = size + len(text)
            size += len(text)
        for e in range(len(self.elements) - 1, 0, -1):  # children stand after their parents
            up = self.elements[e][0]
            if first[e] >= 0:
                first[up] = first[e] if first[up] < 0 else min(first[up], first[e])
                last[up] = max(last[up], last[e])
        text, held = "".join(parts), {}
        for e in judged:
            if first[e] >= 0:
                at = first[e], last[e]
                if at not in held:
                    held[at] = key(text[at[0]:at[1]].strip())
                yield e, paths[e], key(paths[e], held[at]), min(1.0, (at[1] - at[0]) / max(whole, 1))

    def _unsettled(self, i: int) -> bool:
        _, sig, _, main = self.elements[i]
        tag, _, label = sig.partition(".")
        if tag not in CONTAINERS or tag in MAIN:
            return False
        return bool(label) if main else True

    def text(self, noise: frozenset[str] | set[str] = frozenset()) -> str:
        """Main text without branches whose path, or path and content, is in ``noise``."""
        only_main = self.has_main()
        drop = [False] * len(self.elements)
        if noise:
            bad = {e for e, path, content, _ in self.nodes() if path in noise or content in noise}
            for i in range(1, len(self.elements)):
                drop[i] = drop[self.elements[i][0]] or i in bad
        blocks, now = [], []
        for e, t in self.pieces:
            if t is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif not self.elements[e][2] and not drop[e] and (self.elements[e][3] or not only_main):
                now.append(t)
        blocks.append("".join(now))
        return " ".join(x for b in blocks if (x := " ".join(html.unescape(b).split())))


def telling_words(named: str) -> set[str]:
    """Words of class and id names, without those that may as well name an article's subject.

    ``post-comments`` and ``search-box`` tell a role; ``related-work`` may be anything, so the
    tree has to judge it.
    """
    out: set[str] = set()
    for name in named.split():
        found = {w.lower() for w in _WORD.findall(name)}
        out |= found if found <= NOISE_WORDS | HEADER_WORDS | LAYOUT_WORDS else found - SUBJECT_WORDS
    return out


def key(path: str, content: str | None = None) -> str:
    """What stands for a node, or for one content of it, in a host's noise."""
    raw = path if content is None else f"{path}\n{content}"
    return hashlib.blake2b(raw.encode("utf-8", "replace"), digest_size=12).hexdigest()


def host(url):
    """Host of a url, lower-cased; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, path, content, share) of every node that the mark-up leaves open."""
    for batch in batches:
        hosts, pages, paths, contents, shares = [], [], [], [], []
        for h, source in zip(column(batch, "host").to_pylist(), column(batch, "html").to_pylist()):
            nodes = list(Page(source or "").nodes())
            if nodes:
                page = int.from_bytes(hashlib.blake2b(source.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                for _, path, content, share in nodes:
                    shares.append(share)
                    hosts.append(h)
                    pages.append(page)
                    paths.append(path)
                    contents.append(content)
        if hosts:
            yield pa.RecordBatch.from_pydict({"host": hosts, "page": pages, "path": paths, "content": contents, "share": shares})


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, noise): keys of unimportant nodes and of repeated contents, per host.

    What makes up half or more of the text of its pages, as a story that is
    on the host in many copies does, is no noise however often it is repeated.

    Every step is a sum over (host, node, content), so a crowded host costs no task more than
    its different contents. A host's list is short: each entry stands in ``REPEATED`` or more
    of its pages, or is a path of the host's templates.
    """
    nodes = pages.select(host(F.col("url")).alias("host"), "html").where("html IS NOT NULL").mapInArrow(
        lambda it: tidied(_tree(it)), "host string, page long, path string, content string, share double")
    nodes = settle(nodes, "nodes")
    per_content = nodes.distinct().groupBy("host", "path", "content").agg(F.count("*").alias("n"), F.sum("share").alias("share"))
    per_content = settle(per_content, "contents")
    seen = nodes.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    per_path = per_content.groupBy("host", "path").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum("share").alias("share"))
    importance = F.log("total") - F.col("nlogn") / F.col("total")
    beside = F.col("share") < BESIDE * F.col("total")
    low = per_path.where((F.col("total") >= LEAST_PAGES) & beside).where(importance / F.log("total") < LOW).select("host", F.col("path").alias("key"))
    often = per_content.where((F.col("n") >= LEAST_PAGES) & (F.col("share") < BESIDE * F.col("n"))).join(seen, "host")
    often = often.where(F.col("n") >= REPEATED * F.col("pages")).select("host", F.col("content").alias("key"))
    return low.unionByName(often).groupBy("host").agg(F.collect_set("key").alias("noise"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(source or "").text(frozenset(noise or ())) for source, noise in zip(column(batch, "html").to_pylist(), column(batch, "_noise").to_pylist())]
        rest = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("html", "_noise")}
        yield pa.RecordBatch.from_pydict(rest | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """``text`` and ``n_chars`` of every page, beside its columns other than ``html``."""
    pages = modest_batches(pages).select(keep_rest(pages, "text", "n_chars", "_noise", "_host"))
    noise = settle(style_tree(pages), "noise").select(F.col("host").alias("_host"), F.col("noise").alias("_noise"))
    rest = [f for f in pages.schema if f.name != "html"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + (", " if rest else "") + "text string, n_chars long"
    joined = pages.withColumn("_host", host(F.col("url"))).join(noise, "_host", "left").drop("_host")
    return joined.mapInArrow(lambda it: tidied(_extract(it)), schema)


def op4_html_text(spark, sf_dir):
    """Whole ``pages``: main text of each."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
