"""Ingest of parsed texts: into a version that exists, or as an immutable revision that an announcement backs; all documents of a batch at once.

Results say what happened to each document; a refused one changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import hashing
from provisio.operators import merge
from provisio.sources import metadata

LEAST_SHARE = 0.8


def source_parts(c: Column) -> dict[str, Column]:
    """publisher, year, position of PUBLISHER/YEAR/POSITION; all null if it is malformed."""
    parts = F.split(c, "/")
    year, position = (F.expr(f"try_cast({x} as int)") for x in ("__parts[1]", "__parts[2]"))
    fine = (F.size("__parts") >= 3) & (F.col("__parts")[0] != "") & year.isNotNull() & position.isNotNull()
    return {"__parts": parts, "publisher": F.when(fine, F.col("__parts")[0]), "year": F.when(fine, year), "position": F.when(fine, position)}


def with_source_parts(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with publisher, year and position of a source id; null where it is malformed."""
    parts = source_parts(F.col(column))
    return rows.withColumn("__parts", parts.pop("__parts")).withColumns(parts).drop("__parts")


def sized(parsed: DataFrame, table: DataFrame, version: str = "version_id", *, least_share: float = LEAST_SHARE, allow_shrink: bool = False) -> DataFrame:
    """(version, n_new, n_old, is_refused): an empty parse is refused, and one with fewer than ``least_share`` of the provisions there were.

    ``parsed``: a row with null structural_path stands for a document of which nothing was parsed.
    """
    new = parsed.groupBy(version).agg(F.count("structural_path").alias("n_new"))
    old = table.groupBy(version).agg(F.count("*").alias("n_old"))
    rows = new.join(old, version, "left").withColumn("n_old", F.coalesce("n_old", F.lit(0)))
    small = F.lit(False) if allow_shrink else F.col("n_new") < F.ceil(F.col("n_old") * least_share)
    return rows.withColumn("is_refused", (F.col("n_new") == 0) | small)


def replaced(parsed: DataFrame, table: DataFrame, sizes: DataFrame, version: str = "version_id") -> DataFrame:
    """The table with the rows of every accepted version replaced."""
    fine = sizes.where("not is_refused").select(version)
    return table.join(fine, version, "left_anti").unionByName(parsed.join(fine, version, "left_semi").where("structural_path is not null"), allowMissingColumns=True)


def into_existing(parsed: DataFrame, acts: DataFrame, versions: DataFrame, table: DataFrame, **guard) -> tuple[DataFrame, DataFrame]:
    """Provisions of texts parsed for a version that exists and that no announcement backs: the new table, and (source_id, expression, outcome).

    ``parsed``: source_id, expression and the provision's columns.  A version is never created here;
    immutable ones are never touched.  outcome: replaced, refused, no_act or no_version.
    """
    docs = parsed.select("source_id", "expression").distinct()
    act = acts.select("source_id", F.col("id").alias("act"))
    own = versions.where("source_announcement_legal_act_id is null").select(F.col("legal_act_id").alias("act"), F.col("source_expression_id").alias("expression"), F.col("id").alias("version_id"))
    found = docs.join(act, "source_id", "left").join(own, ["act", "expression"], "left")
    rows = parsed.join(found.where("version_id is not null").select("source_id", "expression", "version_id"), ["source_id", "expression"]).drop("source_id", "expression")
    sizes = sized(rows, table, **guard)
    outcome = F.when(F.col("act").isNull(), "no_act").when(F.col("version_id").isNull(), "no_version").when(F.col("is_refused"), "refused").otherwise("replaced")
    report = found.join(sizes, "version_id", "left").select("source_id", "expression", outcome.alias("outcome"))
    return replaced(rows, table, sizes), report


def revisions(parsed: DataFrame, acts: DataFrame, relations: DataFrame, versions: DataFrame, table: DataFrame, new_id: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Immutable revisions of consolidated texts, from HTML or printed pages alike.

    ``parsed``: base, announcement (source ids) and the provision's columns; ``relations``:
    legal_act_id (a source id), relation_type, related_source_id.  Both acts must name each other, and
    the base act must be known; an announcement that is not known yet is reported, to be inserted.
    A revision is known by act, announcement and the hash of its content: the same content is
    reused as it is, another one becomes a new version, and nothing that exists is changed.

    Returns the report (base, announcement, outcome, version_id, content_hash), the versions to
    append and the provisions to append.  outcome: inserted, reused, not_mutual, no_base_act, empty.
    """
    key = ["base", "announcement"]
    filled = parsed.where("structural_path is not null")
    docs = parsed.select(*key).distinct().join(filled.groupBy(*key).agg(hashing.parsed_content_hash().alias("content_hash")), key, "left")
    mutual = metadata.mutually_referenced(relations).select(F.col("act").alias("base"), "announcement", F.lit(True).alias("__mutual"))
    base = acts.select(F.col("source_id").alias("base"), F.col("id").alias("__act"))
    own = versions.where("source_announcement_legal_act_id is not null").select(F.col("legal_act_id").alias("base"), F.col("source_announcement_legal_act_id").alias("announcement"), "content_hash", F.col("id").alias("__known"))
    rows = docs.join(mutual, key, "left").join(base, "base", "left").join(own, [*key, "content_hash"], "left")
    made = new_id if new_id is not None else F.sha2(F.concat_ws(":", "base", "announcement", "content_hash"), 256)
    outcome = F.when(F.col("__mutual").isNull(), "not_mutual").when(F.col("__act").isNull(), "no_base_act").when(F.col("content_hash").isNull(), "empty").when(F.col("__known").isNotNull(), "reused").otherwise("inserted")
    report = rows.withColumn("outcome", outcome)
    version = F.when(F.col("outcome") == "reused", F.col("__known").cast("string")).when(F.col("outcome") == "inserted", made)
    report = report.select(*key, "outcome", version.alias("version_id"), "content_hash")
    new = report.where("outcome = 'inserted'")
    appended = new.select(
        F.col("version_id").alias("id"), F.col("base").alias("legal_act_id"), F.col("announcement").alias("source_announcement_legal_act_id"), F.lit("consolidated").alias("version_kind"), F.lit("tj").alias("source_expression_id"),
        F.lit("authoritative").alias("authority_class"), F.lit("unproven").alias("currentness_status"), "content_hash", F.concat_ws(":", F.lit("announcement"), "announcement", "content_hash").alias("source_document_key"),
    )
    return report, appended, filled.join(new.select(*key, "version_id"), key).drop(*key)


def prepared(metadata_rows: DataFrame, references: DataFrame, old_acts: DataFrame, old_relations: DataFrame, parsed: DataFrame, versions: DataFrame, table: DataFrame, now: Column, compared: list[str]) -> dict[str, DataFrame]:
    """A corpus prepared from what was fetched: acts, relations, revisions and provisions, each as the merge that results.

    ``metadata_rows``: of the acts and of all that they refer to; ``references``: legal_act_id (a source
    id), json.  Relations are resolved against the acts of this run, those that were only just
    inserted as well, so no second pass is needed.  ``old_acts``: id, source_id and ``compared``.
    """
    fresh = metadata.acts(metadata_rows).dropDuplicates(["source_id"])
    acts = merge.merged(old_acts.drop("id"), fresh.select("source_id", *compared), ["source_id"], compared)
    # acts that were not fetched this time stay
    acts = acts.withColumn("action", F.when(F.col("action") == "deleted", "unchanged").otherwise(F.col("action")))
    known = acts.select("source_id").join(old_acts.select("source_id", "id"), "source_id", "left").select("source_id", F.coalesce(F.col("id").cast("string"), F.col("source_id")).alias("id"))
    relations = merge.merged_relations(old_relations, metadata.relations(references), known, now)
    edges = merge.state(relations).where("is_active").select("legal_act_id", "relation_type", "related_source_id")
    report, appended, provisions = revisions(parsed, known, edges, versions, table)
    return {"acts": acts, "relations": relations, "report": report, "versions": appended, "provisions": provisions}
