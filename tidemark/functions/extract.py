"""Articles out of raw pages: the container with the most prose, and its text as typed blocks.

Needs a real HTML reader, so this is Python over Arrow batches; each page is read once, in time linear in its length.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# Kinds of elements, weights of the score and the share of prose at which a child takes its parent's place.
KINDS = {"p": "paragraph", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "li": "item", "blockquote": "quote", "pre": "code"}
CONTAINERS = {"body", "article", "main", "section", "div", "td"}
CHROME = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg", "iframe", "template", "head"}
UNSEEN = {"script", "style", "template", "head"}
#: Classes of elements that are never the article; they count as prose of what holds them.
NOISE = {"ad", "advertisement", "share", "social", "newsletter", "related", "comments", "cookie", "paywall"}
LINK_WEIGHT, BLOCK_WEIGHT, NARROW = 1.5, 25, 0.7

_BARE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)")
_BLANK = re.compile("[ \t\n\r\f\v]+")


def closed_references(html: str) -> str:
    """The page with bare ampersands escaped, so that only references that end with a semicolon are decoded: a text cut within one keeps what is left."""
    return _BARE.sub("&amp;", html)


class _Container:
    __slots__ = ("children", "first", "last", "link", "noise", "prose", "tag")

    def __init__(self, tag: str, first: int, noise: bool = False):
        self.tag, self.first, self.last, self.noise = tag, first, first, noise
        self.prose, self.link, self.children = 0, 0, []

    def score(self) -> float:
        return self.prose - LINK_WEIGHT * self.link + BLOCK_WEIGHT * (self.last - self.first)


class _Reader(HTMLParser):
    """Fills `blocks` with (kind, text) in order and `root` with the containers and the blocks that each spans."""

    def __init__(self, chrome: set[str]):
        super().__init__(convert_charrefs=True)
        self.chrome, self.skipped, self.links = chrome, [], 0
        self.blocks, self.kind, self.held, self.linked = [], "paragraph", [], 0
        self.root = _Container("", 0)
        self.open, self.every = [self.root], []

    def _flush(self) -> None:
        text = _BLANK.sub(" ", "".join(self.held)).strip(" ")
        if text:
            self.blocks.append((self.kind, text))
            linked = min(self.linked, len(text))
            self.open[-1].prose += len(text) - linked
            self.open[-1].link += linked
        self.held, self.linked, self.kind = [], 0, "paragraph"

    def _leave(self) -> None:
        done = self.open.pop()
        done.last = len(self.blocks)
        self.open[-1].prose += done.prose
        self.open[-1].link += done.link
        self.open[-1].children.append(done)
        self.every.append(done)

    def handle_starttag(self, tag, attrs):
        if tag in self.chrome:
            self.skipped.append(tag)
        elif not self.skipped:
            if tag == "a":
                self.links += 1
            elif tag == "br":
                self.held.append(" ")
            elif tag in KINDS:
                self._flush()
                self.kind = KINDS[tag]
            elif tag in CONTAINERS:
                self._flush()
                self.open.append(_Container(tag, len(self.blocks), self.open[-1].noise or not NOISE.isdisjoint((dict(attrs).get("class") or "").lower().split())))

    def handle_startendtag(self, tag, attrs):
        if tag == "br" and not self.skipped:
            self.held.append(" ")

    def handle_endtag(self, tag):
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in KINDS:
            self._flush()
        elif tag in CONTAINERS and any(c.tag == tag for c in self.open):
            self._flush()
            while self.open[-1].tag != tag:
                self._leave()
            self._leave()

    def handle_data(self, data):
        if not self.skipped:
            self.held.append(data)
            if self.links:
                self.linked += len(_BLANK.sub(" ", data).strip(" "))

    def finish(self) -> None:
        self.close()
        self._flush()
        while len(self.open) > 1:
            self._leave()
        self.root.last = len(self.blocks)


def article(html: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """(container's tag, its blocks). A page whose chrome swallows everything is read again with only the unseen elements left out; a page
    without a container is taken whole, with null as its container; a null or blank page has no blocks."""
    for chrome in (CHROME, UNSEEN):
        reader = _Reader(chrome)
        reader.feed(closed_references(html or ""))
        reader.finish()
        if reader.blocks:
            break
    if not reader.every:
        return None, reader.blocks
    best = max(reader.every, key=lambda c: (not c.noise, c.score(), c.last - c.first))
    while best.children:
        child = max(best.children, key=lambda c: (c.noise == best.noise, c.prose))
        if not best.prose or child.noise != best.noise or child.prose < NARROW * best.prose:
            break
        best = child
    return best.tag, reader.blocks[best.first : best.last]


def articles(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, container, blocks array<struct<kind, text>>) of each row; other columns are ignored, keys may be null or repeat."""

    def run(batches):
        for b in batches:
            found = [article(x) for x in b["html"].to_pylist()]
            blocks = [[{"kind": k, "text": t} for k, t in rows] for _, rows in found]
            yield pa.RecordBatch.from_arrays([b["key"], pa.array([tag for tag, _ in found], pa.string()), pa.array(blocks, pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])))], ["key", "container", "blocks"])

    rows = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"))
    out = rows.mapInArrow(run, rows.select("key").schema.add("container", "string").add("blocks", ArrayType(StructType().add("kind", "string").add("text", "string"))))
    return out.withColumnRenamed("key", key)
