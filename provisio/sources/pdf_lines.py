"""Provision trees from the lines of a document whose pages were laid out for print.

Lines come as rows (document, page, y, font_size, text) in reading order; ``visual_lines`` makes them
from positioned pieces of text, and ``pdf_bytes`` reads such pieces from files.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.sources.units import FIELDS, SCHEMA, Outline, Unit

# The start of the annex, what pages repeat, the marks of units and their depths.
ANNEX = re.compile(r"za[łl]ącznik do obwieszczenia(?![A-Za-z0-9_])", re.IGNORECASE)
REPEATED = (r"Dziennik Ustaw\s*[–-]\s*\d+\s*[–-]\s*Poz\.\s*\d+\.?", r"©\s*Kancelaria Sejmu\s+s\.\s*\d+/\d+", r"\d{4}-\d{2}-\d{2}")
CONTAINERS = ("Księga", "book"), ("Część", "part_division"), ("Tytuł", "title"), ("Dział", "division"), ("Rozdział", "chapter"), ("Oddział", "subchapter")
SMALL = "a-ząćęłńóśźż"


class Mark(NamedTuple):
    kind: str
    depth: int
    pattern: re.Pattern
    #: Depth of a unit that must be open.
    inside: int | None


MARKS = [Mark(kind, depth, re.compile(rf"{word}(?=\s|$)", re.IGNORECASE), None) for depth, (word, kind) in enumerate(CONTAINERS)] + [
    Mark("article", 6, re.compile(rf"Art\.\s*(\d+[{SMALL}]*(?:\[\d+\])?)\.\s*(.*)", re.IGNORECASE | re.DOTALL), None),
    Mark("paragraph", 7, re.compile(rf"§\s*(\d+[{SMALL}]*)\.\s*(.*)", re.DOTALL), 6),
    Mark("clause", 7, re.compile(rf"(\d+[{SMALL}]*)\.\s*(.*)", re.DOTALL), 6),
    Mark("point", 8, re.compile(rf"(\d+[{SMALL}]*)\)\s*(.*)", re.DOTALL), 6),
    Mark("letter", 9, re.compile(rf"([{SMALL}])\)\s*(.*)", re.DOTALL), 8),
]
#: The same patterns where Spark searches a line's start, or all of it.
_START = "|".join(f"(?:{m.pattern.pattern})" for m in MARKS)
STARTS_UNIT, STARTS_ANNEX = f"(?iu)^(?:{_START})", rf"(?iu)^(?:{ANNEX.pattern})"
IS_REPEATED = f"^(?:{'|'.join(REPEATED)})$"
IS_BARE_ARTICLE, IS_INDEX = rf"(?iu)^Art\.\s*\d+[{SMALL}]?$", r"^(?:\[(\d+)\]|(\d+))$"


def _joined(parts: Column) -> Column:
    """Parts in their order, as one text."""
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["text"]), "")


def annex_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n, size, text) of the lines from the annex's heading on, numbered, and (key, n_starts) of documents where it does not start once."""
    order = Window.partitionBy("key").orderBy("page", "line")
    told = lines.select("key", "page", "line", F.floor(F.col("font_size") + 0.5).alias("size"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    told = told.withColumn("begins", F.col("text").rlike(STARTS_ANNEX).cast("int"))
    wrong = told.groupBy("key").agg(F.sum("begins").alias("n_starts")).where("n_starts <> 1")
    told = told.withColumns({"n": F.row_number().over(order), "since": F.sum("begins").over(order)})
    return told.join(wrong, "key", "left_anti").where("since > 0").select("key", "n", "size", "text"), wrong


def body_lines(lines: DataFrame) -> DataFrame:
    """(key, n, text) of lines (key, n, size, text) without what pages repeat and without notes.

    Notes are smaller than the size that most lines have (the first met of equals).  Each line of the
    body has the smaller ones after it for its notes; the first of an article whose number stands
    alone may be the number's index, and a stop that begins the next line then belongs to both.
    """
    sizes = lines.groupBy("key", "size").agg(F.count("*").alias("times"), F.min("n").alias("first"))
    usual = sizes.groupBy("key").agg(F.max_by("size", F.struct("times", -F.col("first"))).alias("usual"))
    rows = lines.where((F.col("text") != "") & ~F.col("text").rlike(IS_REPEATED)).join(usual, "key")
    rows = rows.withColumn("is_body", F.col("size") >= F.col("usual"))
    order = Window.partitionBy("key").orderBy("n")
    rows = rows.withColumn("owner", F.sum(F.col("is_body").cast("int")).over(order)).where("owner > 0")
    number = F.concat(F.regexp_extract("text", IS_INDEX, 1), F.regexp_extract("text", IS_INDEX, 2))
    index = F.min_by(F.when(~F.col("is_body") & (number != ""), number), F.when(~F.col("is_body") & (number != ""), F.col("n")))
    own = rows.groupBy("key", "owner").agg(F.min_by("text", "n").alias("text"), index.alias("index"))
    own = own.withColumn("index", F.when(F.col("text").rlike(IS_BARE_ARTICLE), F.col("index")))
    after = Window.partitionBy("key").orderBy("owner")
    goes_on = F.coalesce(F.lag("index").over(after).isNotNull() & F.col("text").startswith("."), F.lit(False))
    own = own.withColumn("goes_on", goes_on).withColumn("line", F.sum((~F.col("goes_on")).cast("int")).over(after))
    part = F.concat("text", F.coalesce(F.concat(F.lit("["), "index", F.lit("]")), F.lit("")))
    return own.groupBy("key", F.col("line").alias("n")).agg(_joined(F.collect_list(F.struct("owner", part.alias("text")))).alias("text"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(key, n, text): a line that starts no unit goes on from the one before; what a hyphen splits is one word."""
    order = Window.partitionBy("key").orderBy("n")
    starts = F.col("text").rlike(STARTS_UNIT) | F.lag("n").over(order).isNull()
    rows = lines.withColumn("starts", starts).withColumn("paragraph", F.sum(F.col("starts").cast("int")).over(order))
    last = F.coalesce(F.lead("starts").over(order), F.lit(True))
    split = F.col("text").rlike(r"\p{L}-$")
    part = F.when(last, F.col("text")).when(split, F.expr("left(text, char_length(text) - 1)")).otherwise(F.concat("text", F.lit(" ")))
    rows = rows.withColumn("part", part)
    return rows.groupBy("key", F.col("paragraph").alias("n")).agg(_joined(F.collect_list(F.struct("n", F.col("part").alias("text")))).alias("text"))


def parse(texts: list[str]) -> Outline:
    """All units of paragraphs; text before any unit is dropped."""
    out, open_units = Outline(), []
    for rest in texts:
        rest = rest.strip()
        while rest:
            found = next(((m, x) for m in MARKS if (x := m.pattern.match(rest)) and (m.inside is None or any(d == m.inside for d, _ in open_units))), None)
            if not found:
                if open_units:
                    open_units[-1][1].body.append(rest)
                break
            mark, match = found
            while open_units and open_units[-1][0] >= mark.depth:
                open_units.pop()
            parent: Unit | None = open_units[-1][1] if open_units else None
            path = "/".join(x for x in (parent.path if parent else "", f"{mark.kind}_{len(out.units) + 1}") if x)
            if mark.depth < 6:  # a container's line is its heading
                unit, rest = out.add(mark.kind, rest, rest, path, parent), ""
            else:
                unit, rest = out.add_numbered(mark.kind, match[1], path, parent), match[2].strip()
            open_units.append((mark.depth, unit))
    return out


def visual_lines(pieces: DataFrame, tolerance: int = 2) -> DataFrame:
    """(document, page, line, y, font_size, text) from pieces (document, page, position, y, a, b, text).

    A piece whose rounded height differs by more than ``tolerance`` from that of its line's first one
    starts a line; so what a line holds depends on where it began, and a page is folded in order.
    The first piece gives a line's height and size; lines without a sign are left out.
    """
    size = F.floor(F.hypot("a", "b") * 10 + 0.5) / 10
    piece = F.struct("position", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("y") + 0.5).cast("int").alias("y"), size.alias("size"))
    pages = pieces.where("y is not null").groupBy("document", "page").agg(F.array_sort(F.collect_list(piece)).alias("held"))

    def folded(told: Column, x: Column) -> Column:
        starts = told["at"].isNull() | (F.abs(x["y"] - told["at"]) > tolerance)
        line = F.coalesce(F.try_element_at(told["lines"], F.lit(-1)), F.lit(0)) + starts.cast("int")
        return F.struct(F.when(starts, x["y"]).otherwise(told["at"]).alias("at"), F.concat(told["lines"], F.array(line)).alias("lines"))

    none = F.struct(F.lit(None).cast("int").alias("at"), F.lit([]).cast("array<int>").alias("lines"))
    lines = F.aggregate("held", none, folded)["lines"]
    rows = pages.withColumn("lines", lines).select("document", "page", F.inline(F.arrays_zip("held", F.col("lines").alias("line"))))
    rows = rows.groupBy("document", "page", F.col("line")).agg(F.array_sort(F.collect_list("held")).alias("held"))
    text = F.array_join(F.transform("held", lambda x: x["text"]), "")
    return rows.select("document", "page", "line", F.col("held")[0]["y"].cast("double").alias("y"), F.col("held")[0]["size"].alias("font_size"), text.alias("text")).where(F.trim("text") != "")


def units(lines: DataFrame, *, key: str = "version_id") -> DataFrame:
    """(key, provision columns, error) from lines (key, page, line, font_size, text); a refused document has one row with its error.

    Lines become paragraphs by windows over a document.  Only their paragraphs are read by one task:
    units depend on those that are open, and a document has at most some thousands.
    """
    kind = lines.schema[key].dataType.simpleString()
    own, wrong = annex_lines(lines.select(F.col(key).alias("key"), "page", "line", "font_size", "text"))

    def read(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [{"key": keys[0], **r, "error": None} for r in parse(frame.sort_values("n")["text"].tolist()).rows(str(keys[0]))]
        return pd.DataFrame(rows, columns=["key", *FIELDS, "error"]).astype({"ordinal": "Int32"})

    found = paragraphs(body_lines(own)).groupBy("key").applyInPandas(read, f"key {kind}, {SCHEMA}, error string")
    refused = wrong.select("key", F.concat(F.col("n_starts").cast("string"), F.lit(" lines start the annex")).alias("error"))
    return found.unionByName(refused, allowMissingColumns=True).withColumnRenamed("key", key)


def joined_paragraphs(lines: DataFrame, starts: str, *, key: str = "key", order: str = "line") -> DataFrame:
    """(key, paragraph, text) by windows alone, for lines whose starts are known: a running count of starts numbers the paragraphs."""
    by = Window.partitionBy(key).orderBy(order)
    rows = lines.withColumn("paragraph", F.sum(F.expr(starts).cast("int")).over(by))
    held = F.array_sort(F.collect_list(F.struct(order, "text")))
    return rows.groupBy(key, "paragraph").agg(F.array_join(F.transform(held, lambda x: x["text"]), " ").alias("text"))
