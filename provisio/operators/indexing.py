"""The search index: which documents have to be embedded again, and the index that results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.functions.hashing import content_hash
from provisio.operators.hierarchy import contexts, document_content, is_searchable


def drafts(provisions: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, version_id, content, content_hash) of what is searched; ``titles``: version_id, title."""
    found = provisions.where(is_searchable(F.col("provision_type"), F.col("heading"), F.col("text")))
    context = contexts(provisions, found.select("id"))
    rows = found.join(context, found["id"] == context["leaf"], "left").join(titles, "version_id")
    content = document_content(F.col("title"), F.col("hierarchy"), F.col("citation_label"), F.col("text"))
    return rows.select("id", "version_id", content.alias("content")).withColumn("content_hash", content_hash(F.col("content")))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, action): embed what is new or changed, keep what is equal, remove what is gone, by content hash."""
    both = old.select("id", F.col("content_hash").alias("was")).join(new.select("id", F.col("content_hash").alias("now")), "id", "full")
    action = F.when(F.col("now").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("embedded")
    return both.select("id", action.alias("action"))


def updated(old: DataFrame, new: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The new index.  ``embed``: from (id, content) to (id, embedding), one row for each; its rows are checked by the caller's writer."""
    todo = difference(old, new)
    fresh = new.join(todo.where("action = 'embedded'"), "id").drop("action")
    vectors = embed(fresh.select("id", "content"))
    kept = old.join(todo.where("action = 'unchanged'"), "id").drop("action")
    return kept.unionByName(fresh.join(vectors, "id", "left"), allowMissingColumns=True)


def runtime_ready(expected: DataFrame, embedded: DataFrame, key: str) -> DataFrame:
    """(key, searchable, embedded, ready): ready if there is something to search and as much is embedded."""
    a = expected.groupBy(key).agg(F.count("*").alias("searchable"))
    b = embedded.groupBy(key).agg(F.count("*").alias("embedded"))
    n = F.coalesce("embedded", F.lit(0))
    return a.join(b, key, "left").select(key, "searchable", n.alias("embedded"), ((F.col("searchable") > 0) & (F.col("searchable") == n)).alias("ready"))
