"""Citations such as "art. 5 ust. 2 pkt 3 lit. a" as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels, deepest first, and the types of unit that hold each.
LEVELS = ("letter", "point", "paragraph", "article")
TYPES = {"letter": ("letter",), "point": ("point",), "paragraph": ("clause", "paragraph"), "article": ("article",)}

# The marks of a citation's parts.
_MARKS = {"art": r"art\.?", "section": "§", "ust": r"ust\.?", "pkt": r"pkt\.?", "lit": r"lit\.?"}


def _number(c: Column, mark: str, extended: bool) -> Column:
    """What follows a mark; a word's edge is spelled out, as dialects differ on it."""
    start = "" if mark == "section" else r"(?:^|[^A-Za-z0-9_])"
    value = "([a-z])" if mark == "lit" else (r"(\d+[a-z]*(?:\[\d+\])?)" if extended else r"(\d+[a-z]?)")
    found = F.regexp_extract(c, rf"(?i){start}{_MARKS[mark]}\s*{value}(?:$|[^A-Za-z0-9_])", 1)
    return F.nullif(found, F.lit(""))


def parsed(c: Column, extended: bool = False) -> dict[str, Column]:
    """article, paragraph, point and letter; all null where there is no citation.

    With an article mark, the paragraph is the section or else the clause; without, a section and a
    clause together are an article and a paragraph, and one of them alone is a paragraph.
    ``extended`` also takes several letters after a number and a bracketed index.
    """
    art, section, ust = (_number(c, m, extended) for m in ("art", "section", "ust"))
    both = section.isNotNull() & ust.isNotNull()
    return {
        "article": F.coalesce(art, F.when(both, section)),
        "paragraph": F.when(art.isNull() & both, ust).otherwise(F.coalesce(section, ust)),
        "point": _number(c, "pkt", extended),
        "letter": F.lower(_number(c, "lit", extended)),
    }
