"""Composite operators: search, investigation, answers, corpus runs; all requests of a batch in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import citation
from provisio.operators import currentlaw, hierarchy, lexical_index, retrieval, vector_index


def exact_matches(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id) of the units that the queries' citations name, for all queries at once.

    The deepest level that a query names must be the unit's own; every other one may be the unit's or
    an ancestor's.
    """
    asked = queries.select("query_id", *(c.alias(f"q_{k}") for k, c in citation.parsed(F.col("query")).items()))
    kind = F.coalesce(*(F.when(F.col(f"q_{k}").isNotNull(), F.lit(k)) for k in citation.LEVELS))
    value = F.coalesce(*(F.col(f"q_{k}") for k in citation.LEVELS))
    asked = asked.withColumns({"level": kind, "value": value}).where("level is not null")
    level = F.coalesce(*(F.when(F.col("provision_type").isin(*types), F.lit(k)) for k, types in citation.TYPES.items()))
    own = F.coalesce(*(F.when(level == k, F.col(k)) for k in citation.LEVELS))
    leaves = nodes.select(F.col("id").alias("leaf"), level.alias("level"), own.alias("value")).where("value is not null")
    found = asked.join(leaves, ["level", "value"])
    chain = hierarchy.ancestors(nodes, found.select(F.col("leaf").alias("id")).distinct()).select("leaf", "id")
    chain = chain.unionByName(found.select("leaf", F.col("leaf").alias("id")).distinct()).join(nodes.select("id", *citation.LEVELS), "id").drop("id")
    rows = found.join(chain, "leaf").groupBy("query_id", "leaf")
    held = rows.agg(*(F.coalesce(F.bool_or(F.col(f"q_{k}").isNull() | (F.col(f"q_{k}") == F.col(k))), F.lit(False)).alias(k) for k in citation.LEVELS))
    return held.where(" and ".join(citation.LEVELS)).select("query_id", F.col("leaf").alias("id"))


def hybrid_search(
    docs: DataFrame, queries: DataFrame, vectors: dict[int, list[float]] | None, exact: DataFrame | None = None, *, min_similarity: float = retrieval.MIN_SIMILARITY, limit: int = retrieval.RESULTS,
    lexical: DataFrame | None = None, near: vector_index.VectorIndex | None = None,
) -> DataFrame:
    """(query_id, id, ranks, similarity, is_exact, score, final_rank, vector_skipped).

    ``docs``: id, text, embedding, already in scope; ``lexical`` and ``near``: their indexes, with which
    ``docs`` is not read.  Without vectors (the embedder failed) the rest still answers, and the result says so.
    """
    words = retrieval.lexical_search(docs, queries) if lexical is None else lexical_index.search(lexical, queries)
    if near is None or not vectors:
        nearest = retrieval.vector_search(docs, vectors or {})
    else:
        nearest = vector_index.search(near, docs.sparkSession.createDataFrame(list(vectors.items()), "query_id long, vector array<double>"))
    found = retrieval.ranked(retrieval.fused(words, nearest, exact, min_similarity=min_similarity), limit)
    return found.withColumn("vector_skipped", F.lit(vectors is None))


def investigation(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Hits of all planned queries with where they come from, for ``answer.with_provenance`` and what follows.

    ``plan``: query_id, issue_no, query_no, target, likelihood, and the request where there are several; ``results``: what ``hybrid_search`` returns.
    """
    return results.join(plan, "query_id").select(*(c for c in plan.columns if c == "request"), "id", "issue_no", "query_no", "target", "likelihood", "score", "is_exact")


def corpus_run(candidates: DataFrame, readiness: DataFrame, run_id: str, generated_at: Column) -> DataFrame:
    """Entries of a run, to be appended under its id: decisions, reasons, and whether included versions are ready."""
    rows = currentlaw.decided(candidates).join(readiness.select("version_id", "ready"), "version_id", "left")
    ready = (F.col("decision") == "included") & F.coalesce("ready", F.lit(False))
    return rows.select(F.lit(run_id).alias("run_id"), generated_at.alias("generated_at"), "act", F.when(F.col("decision") == "included", F.col("version_id")).alias("version_id"), "decision", "reason_code", ready.alias("runtime_ready"))


def public_view(conclusions: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that a verified conclusion cites, without internal ids."""
    cited = conclusions.where("outcome = 'verified'").select(F.explode("support").alias("source_id")).distinct()
    return sources.join(cited, "source_id", "left_semi").drop("version_id", "provision_id")


def source_text(label: Column, act: Column, text: Column, proven_as_of: Column) -> Column:
    """A source as a prompt shows it; current only where the pinned run proves it."""
    current = F.when(proven_as_of.isNotNull(), F.concat(F.lit("current as of "), proven_as_of.cast("string"))).otherwise(F.lit("currentness not proven"))
    return F.concat(label, F.lit(", "), act, F.lit(" ("), current, F.lit(")\n"), text)
