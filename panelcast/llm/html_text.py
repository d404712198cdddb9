"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text they hold less the boilerplate they hold. Every
page votes for its containers' generalised paths (tags and classes without digits), and
votes are summed per host by Spark. The texts are then extracted again, from the host's winning
path; a page on which that path holds less than half of its best container's text uses its
own best container.

Left out everywhere: scripts, styles, navigation, headers, footers, asides, forms, and elements
whose class, id or role says menu, sidebar, notice, advert or comment; and lists made of
links. Character references are decoded, white space in a block becomes one space and blocks
are joined by line feeds.

Defined results: null and empty html give an empty text; a page cut off anywhere is read up to
there; null or odd urls share one host; repeated rows are extracted once per row.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, in_batches, prepare, save

#: Share of a page's best score that a container needs to be voted for.
VOTED = 0.5
MENU_LINKS = 3

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

# Names of HTML elements by how they are treated.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "math", "object"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"} | RAW
CONTAINERS = {"article", "main", "section", "div", "td", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = CONTAINERS | HEADINGS | {
    "p", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "th", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "figure",
    "figcaption", "address", "hr", "html", "nav", "header", "footer", "aside", "form", "fieldset", "details", "summary", "center", "hgroup",
}
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "li", "dt", "dd", "caption", "thead", "tbody", "tfoot", "summary", "figcaption"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
BOILERPLATE = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "sidebar", "aside", "ad", "ads", "advert",
    "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "notice",
    "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "share", "sharing", "social", "comment", "comments", "disqus",
    "respond", "reply", "replies", "related", "recommended", "recommendations", "widget", "toolbar", "masthead", "login", "signup", "search",
    "skip", "paywall", "teaser",
}
EXEMPT = {"with", "has", "no", "free", "without", "allow"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}


def _named(value: str) -> tuple[bool, bool]:
    """Whether class or id names say boilerplate, and whether they say header."""
    bad = head = False
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and not EXEMPT.intersection(parts):
            bad = bad or parts[0] in BOILERPLATE or parts[-1] in BOILERPLATE
            head = head or parts[0] == "header" or parts[-1] == "header"
    return bad, head


class Page:
    """Elements and text blocks of a page, in page order."""

    def __init__(self, source: str | None):
        self.tags: list[str] = ["#"]
        self.parents: list[int] = [-1]
        self.paths: list[str] = [""]
        self.dropped: list[bool] = [False]
        self.header: list[bool] = [False]
        self.blocks: list[tuple[int, str, int, int]] = []  # element, text, characters in links, links
        self._stack = [0]
        self._parts: list[str] = []
        self._linked = self._links = self._open_links = 0
        if source:
            self._read(source)
        self._flush()
        self._drop_menus()

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            match = _TAG.search(source, at)
            if match is None:
                self._text(source[at:])
                return
            if match.start() > at:
                self._text(source[at : match.start()])
            at = match.end()
            name = (match[2] or match[5] or "").lower()
            if not name:
                continue
            if match[1] or match[4]:
                self._close(name)
                continue
            attributes = match[3] or match[6] or ""
            if name in RAW and not attributes.rstrip().endswith("/"):
                end = re.compile(f"</{re.escape(name)}[^>]*(?:>|\\Z)", re.I).search(source, at)
                at = end.end() if end else size
                if name not in ("svg", "math", "object"):
                    continue
            elif name not in RAW:
                self._open(name, attributes)

    def _text(self, raw: str) -> None:
        if self.dropped[self._stack[-1]]:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if self._open_links:
            self._linked += len("".join(text.split()))

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._stack[-1], text, self._linked, self._links))
            self._parts = []
        self._linked = self._links = 0

    def _open(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name == "br":
                self._parts.append(" ")
            elif name == "hr":
                self._flush()
            return
        if name in BLOCKS:
            self._flush()
            if name in CLOSES_P:
                self._leave({"p"}, CONTAINERS | {"li", "table", "blockquote"})
            if name in CLOSES:
                self._leave(*CLOSES[name])
        top = self._stack[-1]
        classes = ""
        bad = name in DROPPED
        head = name == "header"
        if "=" in attributes or "hidden" in attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            classes = found.get("class", "")
            if name not in ("html", "body", "article", "main"):
                named, titled = _named(f"{classes} {found.get('id', '')}")
                bad = bad or named or found.get("role", "").lower() in ROLES
                head = head or (titled and name in BLOCKS)
            bad = bad or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        in_header = self.header[top] or head
        inside = in_header and any(self.tags[i] in ("article", "main") for i in self._stack)
        if in_header and not inside and name not in ("html", "body", "article", "main"):
            bad = True
        segment = name + "".join(f".{c}" for c in sorted({_DIGITS.sub("0", c.lower()) for c in classes.split()}))
        self._stack.append(len(self.tags))
        self.tags.append(name)
        self.parents.append(top)
        self.paths.append(f"{self.paths[top]}>{segment}" if name in BLOCKS else self.paths[top])
        self.dropped.append(self.dropped[top] or bad)
        self.header.append(in_header)
        if name == "a":
            self._open_links += 1
            self._links += 1

    def _pop(self) -> None:
        if self.tags[self._stack.pop()] == "a":
            self._open_links -= 1

    def _leave(self, names: set[str], fences: set[str]) -> None:
        """Close the nearest open element of ``names`` that no fence shields."""
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[depth]]
            if tag in names:
                while len(self._stack) > depth:
                    self._pop()
                return
            if tag in fences:
                return

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        if name == "br":
            self._parts.append(" ")
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[depth]]
            if tag == name:
                while len(self._stack) > depth:
                    self._pop()
                return
            if name not in BLOCKS and tag in BLOCKS:  # an inline end tag doesn't close blocks
                return

    def above(self, element: int) -> Iterator[int]:
        while element > 0:
            yield element
            element = self.parents[element]

    def _drop_menus(self) -> None:
        """Lists that consist of links are menus; headers inside an article keep their headings only."""
        sums: dict[int, list[int]] = {}
        for element, text, linked, links in self.blocks:
            for above in self.above(element):
                if self.tags[above] in ("ul", "ol"):
                    total = sums.setdefault(above, [0, 0, 0])
                    total[0] += len(text.replace(" ", ""))
                    total[1] += linked
                    total[2] += links
                    break
        menus = {e for e, (size, linked, links) in sums.items() if links >= MENU_LINKS and linked >= 0.8 * size}
        kept = []
        self.boilerplate: list[tuple[int, str]] = []
        for element, text, linked, _ in self.blocks:
            chain = list(self.above(element))
            titled = self.header[element] and not any(self.tags[i] in HEADINGS for i in chain)
            if titled or menus.intersection(chain):
                self.boilerplate.append((element, text))
            else:
                kept.append((element, text, linked, 0))
        self.blocks = kept

    def scores(self) -> dict[int, float]:
        """Characters of text outside links in each container, less those of link lists."""
        out: dict[int, float] = {}
        for rows, sign in ((((e, len(t) - 2 * linked) for e, t, linked, _ in self.blocks), 1), (((e, len(t)) for e, t in self.boilerplate), -1)):
            for element, size in rows:
                for above in self.above(element):
                    if self.tags[above] in CONTAINERS:
                        out[above] = out.get(above, 0.0) + sign * size
        boiler = [0] * len(self.tags)  # dropped elements directly below a container count against it
        for element in range(1, len(self.tags)):
            if self.dropped[element] and not self.dropped[self.parents[element]]:
                for above in self.above(self.parents[element]):
                    boiler[above] += 1
        best = {}
        for element, score in out.items():
            weight = 1.5 if self.tags[element] in ("article", "main") else 1.0
            best[element] = score * weight / (1 + 0.2 * boiler[element])
        return best

    def votes(self) -> list[tuple[str, float]]:
        """Generalised paths of good containers with their shares of the best score."""
        by_path: dict[str, float] = {}
        for element, score in self.scores().items():
            by_path[self.paths[element]] = by_path.get(self.paths[element], 0.0) + score
        top = max(by_path.values(), default=0.0)
        return [(p, s / top) for p, s in by_path.items() if s > 0 and s >= VOTED * top]

    def text(self, path: str | None) -> str:
        """The blocks below ``path``, or below the page's best container if that holds much more."""
        scores = self.scores()
        chosen: set[int] = {e for e in scores if self.paths[e] == path}
        own = max(scores, key=lambda e: (scores[e], e), default=None)
        if own is not None and scores[own] > 0 and sum(scores[e] for e in chosen) < 0.5 * scores[own]:
            chosen = {own}
        if not chosen:
            return "\n".join(t for _, t, _, _ in self.blocks)
        return "\n".join(t for e, t, _, _ in self.blocks if not chosen.isdisjoint(self.above(e)))


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path, votes``: the path with most votes on each host; ties go to the longer one.

    Votes are summed per task before the shuffle, so a large host costs no more than others.
    """
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("vote", pa.float64())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((host, path, share) for host, source in columns_of(batches, "host", "html") for path, share in Page(source).votes())
        yield from in_batches(rows, schema)

    shares = pages.select("host", "html").mapInArrow(vote, "host string, path string, vote double")
    sums = shares.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("votes"))
    best = sums.groupBy("host").agg(F.max(F.struct("votes", F.length("path").alias("size"), "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"), F.col("best.votes").alias("votes"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, path`` of every page (path: what its host voted for)."""
    prepare(pages.sparkSession)
    hosted = with_host(pages)
    winners = save(host_paths(hosted).drop("votes"))  # a table, so that its size decides how it is joined
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("path", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((page, url, Page(source).text(path), path) for page, url, source, path in columns_of(batches, "page_id", "url", "html", "path"))
        yield from in_batches(rows, schema, 5_000, weigh=lambda row: len(row[2]))

    return hosted.join(winners, "host", "left").mapInArrow(read, "page_id long, url string, text string, path string")


def digest(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
