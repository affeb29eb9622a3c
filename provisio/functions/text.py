"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _folding() -> tuple[str, str]:
    """Accented Latin letters and what they fold to, by canonical decomposition."""
    # letters with a stroke have no decomposition (fixed values)
    pairs = {"ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ħ": "h", "ı": "i"}
    for c in map(chr, range(0xC0, 0x180)):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii():
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folding()


def squeezed(c: Column) -> Column:
    """White space runs become one space and none is left at the ends; no-break spaces count as white space."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s﻿]+", " "))


def query_form(c: Column) -> Column:
    """What two spellings of a query have in common: white space and case don't matter."""
    return F.lower(squeezed(c))


def folded(c: Column) -> Column:
    """Without accents."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


def tokens(c: Column) -> Column:
    """Lexemes in order: folded, lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(folded(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, as budgets are counted."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def shortened(c: Column, most: int, mark: str = "…") -> Column:
    """The first ``most`` characters, then ``mark``, of longer texts."""
    return F.when(F.char_length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most)), F.lit(mark))).otherwise(c)


def preview(c: Column, most: int = 220) -> Column:
    return shortened(c, most, "...")


def after_first_underscore(c: Column) -> Column:
    at = F.instr(c, "_")
    return F.when(at > 0, F.substr(c, at + 1)).otherwise(c)


def is_iso_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def path_part(c: Column) -> Column:
    """Percent-encoded for a URL path."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def is_valid_query(c: Column, least: int = 3, most: int = 2000) -> Column:
    return F.coalesce(F.char_length(F.trim(c)).between(least, most), F.lit(False))


@F.pandas_udf(StringType())
def compatible(s):  # pandas Series to Series
    """Compatibility composition (NFKC); no built-in function does it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def cache_key(c: Column) -> Column:
    """Digest of a query's canonical form."""
    return F.sha2(query_form(compatible(c)), 256)
