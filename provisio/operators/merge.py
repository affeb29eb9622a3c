"""Keyed merges of snapshots: the new state and what was done to each row.

A merge returns all rows with an ``action``; ``state`` keeps those that are not deleted.  Tables
are rewritten from the result (Parquet has no updates), one partition's rows at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str], *, kept: list[str] = ()) -> DataFrame:
    """Rows keyed by ``keys`` with the compared columns and action inserted, updated, unchanged or deleted.

    ``kept`` columns (such as a creation time) come from the old row where there is one.
    """
    values = [*compared, *kept]
    a = old.select(*keys, *(F.col(c).alias(f"__a_{c}") for c in values), F.lit(True).alias("__old"))
    b = new.select(*keys, *(F.col(c).alias(f"__b_{c}") for c in values), F.lit(True).alias("__new"))
    both = a.join(b, keys, "full")
    same = F.lit(True)
    for c in compared:
        same &= F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))
    action = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull(), "deleted").when(same, "unchanged").otherwise("updated")
    pick = [F.when(F.col("__new").isNull(), F.col(f"__a_{c}")).otherwise(F.col(f"__b_{c}")).alias(c) for c in compared]
    pick += [F.when(F.col("__old").isNull(), F.col(f"__b_{c}")).otherwise(F.col(f"__a_{c}")).alias(c) for c in kept]
    return both.select(*keys, *pick, action.alias("action"))


def state(merge: DataFrame) -> DataFrame:
    return merge.where("action <> 'deleted'").drop("action")


def merged_versions(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Expression versions: rows that an announcement backs are immutable and take no part."""
    return merged(old.where("source_announcement_legal_act_id is null"), new, keys, compared)


RELATION_KEYS = ["legal_act_id", "relation_type", "related_source_id"]


def merged_relations(old: DataFrame, new: DataFrame, acts: DataFrame, now: Column) -> DataFrame:
    """A relation snapshot: what is listed is active and refreshed now, what is not becomes inactive and stays.

    ``old``: keys, source_relation_type, related_legal_act_id, is_active, discovered_at, refreshed_at; ``new``: keys and
    source_relation_type; targets are looked up in ``acts`` (id, source_id) each time.  refreshed_at does not move when
    an edge becomes inactive.
    """
    a = old.withColumnsRenamed({c: f"__{c}" for c in old.columns if c not in RELATION_KEYS}).withColumn("__old", F.lit(True))
    b = new.select(*RELATION_KEYS, "source_relation_type").withColumn("__new", F.lit(True))
    target = acts.select(F.col("source_id").alias("related_source_id"), F.col("id").alias("related_legal_act_id"))
    both = a.join(b, RELATION_KEYS, "full").join(target, "related_source_id", "left")
    listed, known = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    action = F.when(listed & ~known, "inserted").when(listed, "updated").when(F.col("__is_active"), "deactivated").otherwise("unchanged")
    return both.select(
        *RELATION_KEYS,
        F.coalesce("source_relation_type", "__source_relation_type").alias("source_relation_type"),
        F.when(listed, F.col("related_legal_act_id")).otherwise(F.col("__related_legal_act_id")).alias("related_legal_act_id"),
        listed.alias("is_active"),
        F.coalesce("__discovered_at", now).alias("discovered_at"),
        F.when(listed, now).otherwise(F.col("__refreshed_at")).alias("refreshed_at"),
        action.alias("action"),
    )


def first_of(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.groupBy(*keys).agg(*(F.min_by(v, order).alias(v) for v in values))


def latest_of(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key by several columns."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("x")).select(*keys, "x.*")


def latest_revisions(versions: DataFrame) -> DataFrame:
    """One version for each announcement, the latest by creation and id; those without one pass."""
    backed = versions.where("source_announcement_legal_act_id is not null")
    rest = [c for c in versions.columns if c not in ("legal_act_id", "source_announcement_legal_act_id")]
    one = latest_of(backed, ["legal_act_id", "source_announcement_legal_act_id"], ["created_at", "id"], rest)
    return one.select(*versions.columns).unionByName(versions.where("source_announcement_legal_act_id is null"))


def with_unique_paths(rows: DataFrame, version: str = "version_id") -> DataFrame:
    """A structural path that repeats in its version gets #ordinal, but for its first row."""
    nth = F.row_number().over(Window.partitionBy(version, "structural_path").orderBy("ordinal"))
    return rows.withColumn("structural_path", F.when(nth > 1, F.concat("structural_path", F.lit("#"), F.col("ordinal").cast("string"))).otherwise(F.col("structural_path")))


def appended_once(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those whose key the table does not hold, one for each key."""
    return new.dropDuplicates(keys).join(table.select(*keys).distinct(), keys, "left_anti")


class ShrunkTooMuch(ValueError):
    pass


def replaced_provisions(table: DataFrame, new: DataFrame, version: str, *, least_share: float = 0.8, allow_shrink: bool = False) -> DataFrame:
    """The table with one version's rows replaced; an empty parse, or one much smaller than before, is refused."""
    had, have = table.where(F.col("version_id") == version).count(), new.count()
    if not have:
        raise ShrunkTooMuch("nothing was parsed")
    if not allow_shrink and have < -(-had * int(least_share * 100) // 100):
        raise ShrunkTooMuch(f"{have} provisions would replace {had}")
    return table.where(F.col("version_id") != version).unionByName(new)
