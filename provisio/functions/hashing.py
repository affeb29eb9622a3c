"""Digests that depend on content only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def content_key(kind: Column, seed: Column) -> Column:
    """kind:digest, by which equal items of a visitor are known."""
    return F.concat(kind, F.lit(":"), F.sha2(seed, 256))


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object with sorted keys and explicit nulls."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"})


def ordered_hash(order: Column, fields: dict[str, Column]) -> Column:
    """Aggregate: digest of a group's objects in the order of ``order`` (binary)."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("k"), canonical_json(fields).alias("v"))))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["v"]), ","), F.lit("]")), 256)


PROVISION_FIELDS = ("structural_path", "provision_type", "citation_label", "heading", "text", "article", "paragraph", "point", "letter")


def parsed_content_hash() -> Column:
    """Aggregate: fingerprint of a parsed text's provisions, without ids, times or row order."""
    return ordered_hash(F.col("structural_path"), {k: F.col(k) for k in PROVISION_FIELDS})
