"""Main-text extraction by consensus container paths of a host.

1. Each page is cut into text blocks with the containers around them. A block of running text gives
   its container credit (characters without link text) and half of it to the next container up.
   The best container, raised to the enclosing article or main element, is the page's vote: its path
   of tags and classes, digits removed.
2. Spark adds up the votes by host and path, before and after the shuffle, and keeps the path with
   the most votes (then credit, then the smaller path).
3. Pages are extracted again from the containers that match the winning path of their host; a page
   without such a container uses its own vote, a page without any container its whole body.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out by element and by names in class, id and role: one of the words of ``NOISE`` as a whole name,
or compounds of them; headings and paragraphs are named by their subject and stay. Character references are decoded, white space
inside a block becomes one space, ``br`` is white space, blocks are joined by a line feed.

Edge cases: null or empty html gives an empty text; a null or unparsable url is a host of its own
name (empty); broken or unclosed markup is read as browsers do as far as blocks go; other columns
are ignored. A page is the unit of memory.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketweave.llm.common import plain_texts, spool, text_rows

# fixed values: element names and words by their role
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style textarea title head iframe noembed noframes noscript template nav header footer aside form button select option datalist "
    "svg canvas object audio video map menu dialog search".split()
)
CONTAINERS = frozenset("article main section div td body".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus respond replies cookie cookies consent gdpr "
    "notice notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended widget pagination pager "
    "form search".split()
)
KEPT_WORDS = frozenset("article post entry story content main title headline".split())
# words that add nothing to a role in a compound name
PLAIN_WORDS = frozenset("site page top bottom left right inner outer list box bar wrap wrapper container block area section slot unit item link links button buttons icon icons".split())
# elements whose class or id names their subject, not their role
NAMED_BY_SUBJECT = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table html body article section div main td th blockquote".split())
_MARKUP = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|[!?/][^>]*(?:>|\Z)|[a-zA-Z][^>]*(?:>|\Z))""", re.DOTALL)
# one attribute after another: a quoted value is passed over as a whole, whatever it holds
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


@dataclass(slots=True)
class Element:
    tag: str
    path: str
    dropped: bool
    parent: int  # index of the next container up, itself if it is one
    anchor: bool


def _is_noise(names: set[str]) -> bool:
    """Whether a class, id or role says what the element is for: one of the words as a whole name, or a
    compound of nothing but such words and plain ones (cookie-banner, site-header; not ad-hoc)."""
    parts = [set(_WORD.findall(name)) for name in names]
    return any(p & NOISE and p <= NOISE | PLAIN_WORDS for p in parts) and not any(p & KEPT_WORDS for p in parts)


def _attributes(text: str) -> tuple[str, set[str], bool]:
    """Generalised class for the path, lower-case names in class, id and role, and hiddenness."""
    classes, names, hidden = "", set(), False
    for name, value in _ATTRIBUTE.findall(text):
        name, value = name.lower(), value.strip("\"'")
        if name == "class":
            classes = ".".join(sorted({re.sub(r"[0-9]+", "", c) for c in value.lower().split()} - {""}))
        if name in ("class", "role"):
            names.update(value.lower().split())
        elif name == "id":
            names.add(value.lower())
        elif name == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE) is not None
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
    return classes, names, hidden


class Page:
    """Blocks of a page: text, link characters and the container of each, and the containers."""

    def __init__(self, source: str, by_words: bool = True):
        self.by_words = by_words
        self.containers: list[tuple[str, str, int]] = []  # tag, path, parent container
        self.blocks: list[tuple[str, int, int]] = []  # text, link characters, container
        self.stack: list[Element] = []
        self.pieces: list[str] = []
        self.linked = 0
        at, end = 0, len(source)
        while at < end:
            m = _MARKUP.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m.group(2) is None:
                continue
            tag = m.group(2).lower()
            if m.group(1):
                self._close(tag)
                continue
            self._open(tag, m.group(3))
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(source, at)
                at = close.start() if close else end
        self._flush()

    def _text(self, text: str) -> None:
        if self.stack and self.stack[-1].dropped:
            return
        if "&" in text:
            text = entities.unescape(text)
        self.pieces.append(text)
        if any(e.anchor for e in self.stack[-4:]):
            self.linked += len(text)

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((text, self.linked, self.stack[-1].parent if self.stack else -1))
            self.pieces, self.linked = [], 0

    def _pop(self, depth: int) -> None:
        if any(e.tag in BLOCKS for e in self.stack[depth:]):
            self._flush()
        del self.stack[depth:]

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            for depth in range(len(self.stack) - 1, -1, -1):  # an open paragraph ends here
                if self.stack[depth].tag == "p":
                    self._pop(depth)
                    break
                if self.stack[depth].tag in SCOPES:
                    break
            closes = CLOSED_BY.get(tag)
            if closes:
                for depth in range(len(self.stack) - 1, -1, -1):
                    if self.stack[depth].tag in closes:
                        self._pop(depth)
                        break
                    if self.stack[depth].tag in SCOPES and self.stack[depth].tag not in closes:
                        break
        elif tag == "br":
            self._text(" ")
        if tag in VOID:
            return
        up = self.stack[-1] if self.stack else Element("", "", False, -1, False)
        classes, names, hidden = _attributes(attributes) if attributes.strip(" /") else ("", set(), False)
        path = f"{up.path}/{tag}.{classes}" if classes else f"{up.path}/{tag}"
        dropped = up.dropped or hidden or tag in DROPPED
        if tag == "header" and up.tag in ("article", "main", "section"):
            dropped = up.dropped or hidden  # holds the headline of the article
        if self.by_words and not dropped and names and tag not in NAMED_BY_SUBJECT and _is_noise(names):
            dropped = True
        parent = up.parent
        if tag in CONTAINERS and not dropped:
            self.containers.append((tag, path, up.parent))
            parent = len(self.containers) - 1
        self.stack.append(Element(tag, path, dropped, parent, tag == "a"))

    def _close(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            e = self.stack[depth]
            if e.tag == tag:
                self._pop(depth)
                return
            if tag not in BLOCKS and e.tag in BLOCKS:
                return  # a stray end of an inline element does not end blocks

    def vote(self) -> tuple[str, float]:
        """Path and credit of the best container; ("", 0) without one."""
        credit = [0.0] * len(self.containers)
        for text, linked, at in self.blocks:
            gain = float(max(len(text) - 2 * linked, 0))
            if at >= 0:
                credit[at] += gain
                if self.containers[at][2] >= 0:
                    credit[self.containers[at][2]] += gain / 2
        if not credit or max(credit) <= 0:
            return "", 0.0
        best = max(range(len(credit)), key=lambda i: (credit[i], -i))
        at = best
        while at >= 0 and self.containers[at][0] not in ("article", "main"):
            at = self.containers[at][2]
        best = best if at < 0 else at
        return self.containers[best][1], credit[best]

    def text(self, path: str) -> str:
        """Blocks inside the containers of this path, in page order; all blocks if path is empty."""
        inside = [False] * len(self.containers)
        for i, (_, own, parent) in enumerate(self.containers):
            inside[i] = own == path or (parent >= 0 and inside[parent])
        return "\n".join(t for t, _, at in self.blocks if not path or (at >= 0 and inside[at]))


def host_of(url: str) -> str:
    m = _HOST.match(url)
    return m.group(1).lower() if m else ""


def extract(source: str, winning: str) -> str:
    page = Page(source)
    for path in (winning, page.vote()[0]):
        text = page.text(path) if path else ""
        if text:
            return text
    return page.text("") or Page(source, by_words=False).text("")


def _votes(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [(host_of(url), *Page(source).vote()) for url, source in zip(plain_texts(batch.column(0)), plain_texts(batch.column(1)), strict=True)]
            columns = list(zip(*votes, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _extract(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(source, path) for source, path in zip(plain_texts(batch.column(2)), plain_texts(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema
            )

    return run


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and the container path that most of its pages voted for."""
    schema = pages.sparkSession.createDataFrame([], "host string, path string, credit double").schema
    votes = text_rows(pages, "url", "html").mapInArrow(_votes(to_arrow_schema(schema)), schema).where("path <> ''")
    tallied = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("credit").alias("credit"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.round("credit")).alias("credit"), "path"))
    return tallied.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("path"))


def main_texts(pages: DataFrame, broadcast_hosts: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars of every page row."""
    winners = spool(winning_paths(pages), "paths")
    if winners.count() <= broadcast_hosts:
        winners = F.broadcast(winners)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    rows = text_rows(pages, "page_id", "url", "html").join(winners, host == F.col("host"), "left").select("page_id", "url", "html", "path")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    schema = pages.sparkSession.createDataFrame([], f"{kinds}, text string, n_chars long").schema
    return rows.mapInArrow(_extract(to_arrow_schema(schema)), schema)
