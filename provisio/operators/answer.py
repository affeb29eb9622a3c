"""Evidence: retrieval plans, provenance, ranking, packing under budgets, quotations, coverage.

Model output is input here: it comes as rows, and what does not fit the rows it was made from is
rejected, never repaired.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from provisio.functions import text

# Queries kept for an issue and target, by likelihood; budgets.
CAPS = {"most_likely": 3, "possible": 1, "needs_more_information": 0}
MOST_SOURCES, MOST_CHARS = 16, 12_000


def capped_plan(queries: DataFrame) -> DataFrame:
    """The first queries of each issue and target: (issue, target, position, likelihood, query)."""
    nth = F.row_number().over(Window.partitionBy("issue", "target").orderBy("position"))
    cap = F.coalesce(*(F.when(F.col("likelihood") == k, n) for k, n in CAPS.items()), F.lit(0))
    return queries.withColumn("nth", nth).where(F.col("nth") <= cap).drop("nth")


def direct_targets(targets: DataFrame, plan: DataFrame, issues: DataFrame) -> DataFrame:
    """Queries to add: a target's own text, where no query of the target says the same, to the first issue that covers it.

    ``targets``: target, text; ``plan``: target, query; ``issues``: issue, position, target, likelihood.
    """
    said = plan.select("target", text.query_form(F.col("query")).alias("form")).distinct()
    missing = targets.withColumn("form", text.query_form(F.col("text"))).join(said, ["target", "form"], "left_anti")
    first = issues.where("likelihood <> 'needs_more_information'").groupBy("target").agg(F.min_by("issue", "position").alias("issue"))
    return missing.join(first, "target").select("target", "issue", F.col("text").alias("query"))


def with_provenance(hits: DataFrame) -> DataFrame:
    """One row for each id with its hits in order, and the targets it was found for.

    ``hits``: id, issue_no, query_no, target, likelihood, score, is_exact.
    """
    found = F.array_sort(F.collect_list(F.struct("issue_no", "query_no", "target", "likelihood", "score", "is_exact")))
    return hits.groupBy("id").agg(found.alias("found_by"), F.array_sort(F.collect_set("target")).alias("targets"))


def tier_scores(hits: DataFrame, by: list[str]) -> DataFrame:
    """Best score of each tier, weighted two to one, and whether any hit is exact."""
    best = lambda tier: F.coalesce(F.max(F.when(F.col("likelihood") == tier, F.col("score"))), F.lit(0.0))
    return hits.groupBy(*by).agg((best("most_likely") * 2 + best("possible")).alias("weighted"), F.bool_or("is_exact").alias("any_exact"), F.bool_or(F.col("likelihood") == "most_likely").alias("likely"))


def packed(ranked: DataFrame, by: str, *, most_sources: int = MOST_SOURCES, most_chars: int = MOST_CHARS) -> DataFrame:
    """(by, id, source_no): what fits the budgets, taken in order of ``rank``; ``n_chars``: its size.

    The first one is always taken, one that is too large is passed over, and taking ends at the
    number of sources.  Each admission depends on those before, so a request's candidates are read
    in order as a stream: a task sorts them, on disk where they are many, and holds the state of
    one request, its number of sources and their characters.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken, used = object(), 0, 0
        for batch in batches:
            rows, nos = [], []
            for i, (request, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if request != now:
                    now, taken, used = request, 0, 0
                # after a first one of unknown size, nothing is known to fit
                if taken == 0 or (taken < most_sources and None not in (used, n) and used + n <= most_chars):
                    taken, used = taken + 1, None if n is None else used + n
                    rows.append(i)
                    nos.append(taken)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(nos, pa.int32())], names=[by, "id", "source_no"])

    rows = ranked.select(by, F.col("id").cast("long").alias("id"), F.col("n_chars").cast("long").alias("n_chars"), "rank")
    rows = rows.repartition(F.col(by)).sortWithinPartitions(by, "rank", "id", "n_chars").select(by, "id", "n_chars")
    return rows.mapInArrow(fold, StructType([rows.schema[by], StructField("id", LongType()), StructField("source_no", IntegerType())]))


def reserved(scored: DataFrame) -> DataFrame:
    """(target, id): the best most-likely candidate of each target.  ``scored``: target, id, weighted, any_exact, likely."""
    nth = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("any_exact"), F.desc("weighted"), "id"))
    return scored.where("likely").withColumn("nth", nth).where("nth = 1").select("target", "id")


def evidence_status(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """``evidence`` (source_id, excerpt) with status: verbatim, not_found, empty or unknown_source; white space does not count."""
    held = sources.select("source_id", text.squeezed(F.col("text")).alias("__text"))
    quote = text.squeezed(F.col("excerpt"))
    status = (
        F.when(F.col("__text").isNull(), "unknown_source").when(F.coalesce(quote, F.lit("")) == "", "empty").when(F.col("__text").contains(quote), "verbatim").otherwise("not_found")
    )
    return evidence.join(held, "source_id", "left").withColumn("status", status).drop("__text")


def covered(targets: DataFrame, conclusions: DataFrame) -> DataFrame:
    """``targets`` with is_covered: a verified conclusion carries the target."""
    good = conclusions.where("outcome = 'verified'").select("target").distinct().withColumn("__hit", F.lit(True))
    return targets.join(good, "target", "left").withColumn("is_covered", F.col("__hit").isNotNull()).drop("__hit")


def retrieval_signals(targets: DataFrame, hits: DataFrame) -> DataFrame:
    """(target, n_candidates, best_score, backstop) for each target."""
    found = hits.groupBy("target").agg(F.count_distinct("id").alias("n_candidates"), F.max("score").alias("best_score"), F.bool_or("is_backstop").alias("backstop"))
    return targets.join(found, "target", "left").select("target", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "best_score", F.coalesce("backstop", F.lit(False)).alias("backstop"))


def caveats(sources: DataFrame, by: str = "request") -> DataFrame:
    """Whether any cited source is not proven current, or not authoritative."""
    return sources.groupBy(by).agg(F.bool_or(F.col("proven_as_of").isNull()).alias("currentness"), F.bool_or(F.col("authority_class") != "authoritative").alias("authority"))


def unknown_ids(rows: DataFrame, allowed: DataFrame, column: str) -> DataFrame:
    """Rows whose id was never offered; any of them makes a model's answer invalid."""
    return rows.join(allowed.select(column).distinct(), column, "left_anti")
