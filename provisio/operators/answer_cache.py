"""The exact answer cache: a hit needs the same question, run and pipeline, and every source still in scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("question_hash", "corpus_run_id", "pipeline_version")
PROVENANCE = ("ruleset_version", "effective_as_of", "corpus_selection_hash")


def looked_up(questions: DataFrame, cache: DataFrame, scope: DataFrame) -> DataFrame:
    """``questions`` (key and provenance columns) with is_hit and the snapshot.

    ``cache``: key, provenance, status, answer_snapshot, source_version_ids; ``scope``: corpus_run_id
    and version_ids, or a row for each version_id.  Sources are joined with the scope one by one, so
    a run may hold any number of versions.
    """
    if "version_ids" in scope.columns:
        scope = scope.select("corpus_run_id", F.explode("version_ids").alias("version_id"))
    pack = F.sha2(F.to_json(F.struct("source_version_ids"), {"ignoreNullFields": "false"}), 256)
    own = cache.withColumnsRenamed({c: f"__{c}" for c in (*PROVENANCE, "status")}).withColumn("__pack", pack)
    # packs of a run with a source that is not in its scope; a null source is in none
    sources = own.select("corpus_run_id", "__pack", F.explode("source_version_ids").alias("version_id"))
    stray = sources.join(scope.select("corpus_run_id", "version_id"), ["corpus_run_id", "version_id"], "left_anti").select("corpus_run_id", "__pack").distinct()
    rows = questions.join(own, list(KEY), "left").join(stray.withColumn("__stray", F.lit(True)), ["corpus_run_id", "__pack"], "left")
    fits = (F.col("__status") == "answered") & F.col("__stray").isNull()
    for c in PROVENANCE:
        fits &= F.col(f"__{c}") == F.col(c)
    fits &= F.size("source_version_ids") > 0
    hit = F.coalesce(fits, F.lit(False))
    return rows.select(*questions.columns, hit.alias("is_hit"), F.when(hit, F.col("answer_snapshot")).alias("answer_snapshot"))


def recordable(answers: DataFrame, scope: DataFrame) -> DataFrame:
    """Answers that may be stored: answered, with sources, all in scope and proven current at the run's date."""
    rows = answers.join(scope, "corpus_run_id")
    proven = F.forall("sources", lambda s: F.coalesce(F.array_contains("version_ids", s["version_id"]) & (s["proven_as_of"] == F.col("effective_as_of")), F.lit(False)))
    return rows.where((F.col("status") == "answered") & (F.size("sources") > 0) & proven).drop("version_ids")


def recorded(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows to append; who came first stays."""
    from provisio.operators.merge import appended_once

    return appended_once(cache, answers, list(KEY))


def counted_hits(cache: DataFrame, looked: DataFrame, now: Column) -> DataFrame:
    """``cache`` with hit_count and last_hit_at moved by a batch of lookups (what ``looked_up`` returns)."""
    hits = looked.where("is_hit").groupBy(*KEY).agg(F.count("*").alias("__hits"))
    rows = cache.join(hits, list(KEY), "left")
    return rows.withColumns({"hit_count": F.col("hit_count") + F.coalesce("__hits", F.lit(0)), "last_hit_at": F.when(F.col("__hits").isNotNull(), now).otherwise(F.col("last_hit_at"))}).select(*cache.columns)


def source_pack_hash() -> Column:
    """Aggregate: digest of an answer's sources, each as its provision and its label, in the order of the provisions (``id``, ``label``; equal ones by ``source_no``)."""
    one = F.to_json(F.struct(F.col("id").cast("string").alias("legalProvisionId"), F.col("label").alias("citationLabel")), {"ignoreNullFields": "false"})
    rows = F.array_sort(F.collect_list(F.struct(F.col("id").cast("string").alias("k"), "source_no", one.alias("v"))))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda x: x["v"]), ","), F.lit("]")), 256)


def rows_to_record(answers: DataFrame, scope: DataFrame) -> DataFrame:
    """Cache rows of the answers that may be stored: key, provenance, status, snapshot, the sources' versions, their digest, no hits yet.

    ``answers``: key, provenance, status, answer, sources (structs of id, label, version_id, proven_as_of).
    """
    fine = recordable(answers, scope.select("corpus_run_id", "version_ids"))
    packs = fine.select(*KEY, F.posexplode("sources").alias("source_no", "s")).select(*KEY, "source_no", "s.id", "s.label").groupBy(*KEY).agg(source_pack_hash().alias("source_pack_hash"))
    versions = F.array_sort(F.array_distinct(F.transform("sources", lambda s: s["version_id"])))
    return fine.join(packs, list(KEY)).select(
        *KEY, *PROVENANCE, "status", F.col("answer").alias("answer_snapshot"), versions.alias("source_version_ids"), "source_pack_hash", F.lit(0).cast("long").alias("hit_count"), F.lit(None).cast("timestamp_ntz").alias("last_hit_at")
    )
