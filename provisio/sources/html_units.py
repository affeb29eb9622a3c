"""Provision trees from HTML.

Markup: sections of ``.parts`` hold a ``.part`` with a heading and blocks of ``.unit`` elements,
each with a heading and a ``.unit-inner`` with text and further units.  Notes (``a.gloss-link``)
never belong to a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.sources.units import FIELDS, MARKS, SCHEMA, Outline, SourceError, Unit

# Classes of units, the annex's heading, the heading of a text without one.
KINDS = {
    "book": ("book", "Księga"),
    "part": ("part_division", "Część"),
    "titl": ("title", "Tytuł"),
    "bran": ("division", "Dział"),
    "chpt": ("chapter", "Rozdział"),
    "schp": ("subchapter", "Oddział"),
    "arti": ("article", "Art."),
    "para": ("paragraph", "§"),
    "pass": ("clause", "Ust."),
    "pint": ("point", ""),
    "lett": ("letter", ""),
}
ANNEX = re.compile(r"Załącznik\s*-\s*Tekst jednolity")
NO_HEADING = "Treść ustawy"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    __slots__ = ("attrs", "classes", "inner", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent, self.inner = tag, attrs, parent, []
        self.classes = (attrs.get("class") or "").split()

    def elements(self, tag: str | None = None, cls: str | None = None) -> list[Element]:
        """Children that are elements of a tag or class."""
        return [x for x in self.inner if isinstance(x, Element) and (tag is None or x.tag in tag.split()) and (cls is None or cls in x.classes)]

    def every(self) -> Iterator[Element]:
        """All elements inside, in reading order; with a stack of its own, as pages can be nested very deep."""
        todo = self.elements()[::-1]
        while todo:
            x = todo.pop()
            yield x
            todo += x.elements()[::-1]

    def text(self) -> str:
        """Without notes; white space runs are one space."""
        parts: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif not (x.tag == "a" and "gloss-link" in x.classes):
                todo += reversed(x.inner)
        return " ".join("".join(parts).replace(" ", " ").split())


class Reader(HTMLParser):
    """A tree of elements; end tags close what is open inside, stray ones are passed over."""

    def __init__(self, html: str | None = None):
        super().__init__(convert_charrefs=True)
        self.top = self.now = Element("", {}, None)
        if html is not None:
            self.feed(html)
            self.close()

    def opened(self, x: Element) -> None:
        """Called when an element was opened."""

    def closed(self, x: Element) -> None:
        """Called when an element was closed; what it holds stays as it is."""

    def _up(self, to: Element) -> None:
        while self.now is not to:
            x, self.now = self.now, self.now.parent
            self.closed(x)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li") and self.now.tag == tag:
            self._up(self.now.parent)
        x = Element(tag, dict(attrs), self.now)
        self.now.inner.append(x)
        self.now = x
        self.opened(x)
        if tag in VOID:
            self._up(x.parent)

    def handle_endtag(self, tag: str) -> None:
        x = self.now
        while x.parent and x.tag != tag:
            x = x.parent
        if x.parent:
            self._up(x.parent)

    def handle_data(self, data: str) -> None:
        self.now.inner.append(data)


def first(found: list[Element]) -> Element | None:
    return found[0] if found else None


def root_section(top: Element, annex: bool) -> Element | None:
    sections = [s for x in top.every() if "parts" in x.classes for s in x.elements("section")]
    if not annex:
        return first(sections)
    heading = lambda s: ((p := first(s.elements(cls="part"))) and (h := first(p.elements("h2"))) and h.text()) or ""
    found = [s for s in sections if ANNEX.match(heading(s))]
    if len(found) != 1:
        raise SourceError(f"{len(found)} sections have the annex's heading")
    return found[0]


def parse(html: str, annex: bool = False) -> Outline:
    """All units in reading order; an outline without units if there is no part."""
    out = Outline()
    section = root_section(Reader(html).top, annex)
    part = section and first(section.elements(cls="part"))
    if part:
        root = _root(out, section, first(part.elements("h2")))
        _add(out, root, _outermost(part))
    return out


def _root(out: Outline, section: Element, heading: Element | None) -> Unit:
    name = (heading.text() if heading else "") or NO_HEADING
    return out.add("part", name, name, section.attrs.get("id") or "part_1")


def _outermost(part: Element) -> list[Element]:
    return [u for b in part.elements(cls="block") for u in b.elements(cls="unit")]


def _add(out: Outline, root: Unit, found: list[Element]) -> None:
    """Units of a part and what is in them."""
    # explicit stack, as trees of statutes can be deep
    units = lambda x: x.elements(cls="unit")
    todo = [(u, root) for u in reversed(found)]
    while todo:
        element, parent = todo.pop()
        kind = next((m[1] for c in element.classes if (m := re.match(r"unit_([a-zA-Zł]+)", c))), "")
        inner = first(element.elements(cls="unit-inner"))
        if kind in KINDS:
            unit = _unit(out, element, parent, *KINDS[kind])
            unit.body += [t for x in (inner.elements("div") if inner else []) if x.attrs.get("data-template") == "xText" and (t := x.text())]
        else:
            unit = parent  # what it holds belongs to its parent
        todo += [(u, unit) for u in reversed(units(inner) if inner else [])]


class Stream(Reader):
    """The units of ``parse``, without an annex, of a text that comes in pieces.

    The outermost units are read and let go as they close, once the part's heading is known, so no
    more than one of them is held.  Without a heading, or with ``.parts`` inside one another, where
    only the end tells which section counts, the whole tree is held.
    """

    def __init__(self):
        super().__init__()
        self.out = Outline()
        self.section = self.part = self.heading = self.root = None
        self.nested = False

    def opened(self, x: Element) -> None:
        up = x.parent
        if self.nested or self.heading:
            return
        if self.part:
            if x.tag == "h2" and up is self.part:
                self.heading = x
        elif self.section:
            if "part" in x.classes and up is self.section:
                self.part = x
        elif x.tag == "section" and "parts" in up.classes:
            self.section = x
            while up := up.parent:
                self.nested |= "parts" in up.classes

    def closed(self, x: Element) -> None:
        if self.nested or not self.heading:
            return
        if x is self.heading:
            self.root = _root(self.out, self.section, x)
            _add(self.out, self.root, _outermost(self.part))
            for b in self.part.elements(cls="block"):
                b.inner = [y for y in b.inner if isinstance(y, Element) and "unit" not in y.classes]
        elif self.root and "unit" in x.classes and x.parent.parent is self.part and "block" in x.parent.classes:
            _add(self.out, self.root, [x])
            x.parent.inner = []

    def ended(self) -> None:
        """After the last piece."""
        self.close()
        self._up(self.top)
        if self.root:
            return
        section = root_section(self.top, False)
        part = section and first(section.elements(cls="part"))
        if part:
            _add(self.out, _root(self.out, section, first(part.elements("h2"))), _outermost(part))


def _unit(out: Outline, element: Element, parent: Unit, kind: str, noun: str) -> Unit:
    key = element.attrs.get("data-id") or ""
    number, path = key.partition("_")[2] if "_" in key else key, f"{parent.path}/{key}"
    if kind in MARKS:
        return out.add_numbered(kind, number, path, parent)
    heading = first(element.elements("h2 h3"))
    lines = [x.text() for x in heading.every() if x.tag == "p"] if heading else []
    base = (lines[0] if lines else heading.text() if heading else "") or f"{noun} {number}".strip()
    subtitle = " ".join(x.text() for x in heading.every() if "pro-title-unit" in x.classes) if heading else ""
    name = f"{base} - {subtitle}" if subtitle else base
    return out.add(kind, name, name, path, parent)


def units(docs: DataFrame, *, key: str = "version_id", html: str = "html", annex: bool = False) -> DataFrame:
    """(key, provision columns, error): the provisions of each text; a text that is refused has one row with its error."""
    kind = docs.schema[key].dataType.simpleString()

    def rows_of(k: object, text: str | None) -> Iterator[dict]:
        if not annex:
            yield from streamed(k, [text or ""])
            return
        try:
            yield from ({"key": k, **r, "error": None} for r in parse(text or "", annex).rows(str(k)))
        except SourceError as e:
            yield {"key": k, **dict.fromkeys(FIELDS), "error": str(e)}

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from _framed(r for k, text in zip(frame["key"], frame["html"], strict=True) for r in rows_of(k, text))

    return docs.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(read, f"key {kind}, {SCHEMA}, error string").withColumnRenamed("key", key)


#: Rows of a frame, and letters that a parser is given at once.
FRAME, FED = 10_000, 1 << 20


def streamed(key: object, pieces: Iterable[str | None]) -> Iterator[dict]:
    """Rows of a text in pieces, as they are known."""
    reader = Stream()
    for piece in pieces:
        for low in range(0, len(piece or ""), FED):
            reader.feed(piece[low : low + FED])
            yield from ({"key": key, **r, "error": None} for r in reader.out.take(str(key)))
    reader.ended()
    yield from ({"key": key, **r, "error": None} for r in reader.out.take(str(key)))


def _framed(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    while some := list(islice(rows, FRAME)):
        yield pd.DataFrame(some, columns=["key", *FIELDS, "error"]).astype({"ordinal": "Int32"})


def units_of_pieces(pieces: DataFrame, *, key: str = "version_id", place: str = "place", html: str = "html") -> DataFrame:
    """``units`` of texts that are given as ordered pieces, a row each: no row, task or list holds a whole text.

    A text's pieces are sorted by Spark and read by one task as a stream; nulls are passed over.
    """
    kind = pieces.schema[key].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = (row for frame in frames for row in zip(frame["key"], frame["html"], strict=True))
        yield from _framed(r for k, own in groupby(every, key=itemgetter(0)) for r in streamed(k, (text for _, text in own)))

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.select(F.col(key).cast("string").alias("key"), F.col(place).alias("place"), F.col(html).alias("html")).repartition(parts, "key").sortWithinPartitions("key", "place")
    found = rows.select("key", "html").mapInPandas(read, f"key string, {SCHEMA}, error string")
    return found.select(F.col("key").cast(kind).alias(key), *FIELDS, "error")


def element_counts(docs: DataFrame, tags: list[str], *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, n_<tag> ...): how many elements of each tag a page has; comments and scripts don't count."""
    kind = docs.schema[key].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [[x.tag for x in Reader(t or "").top.every()] for t in frame["html"]]
            yield pd.DataFrame({"key": frame["key"], **{f"n_{t}": pd.Series([f.count(t) for f in found], frame.index, "int64") for t in tags}})

    return docs.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(read, f"key {kind}, {', '.join(f'n_{t} long' for t in tags)}").withColumnRenamed("key", key)
