"""Evaluation: how often what was expected is retrieved, packed and cited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def found_labels(expected: DataFrame, labels: DataFrame) -> DataFrame:
    """``expected`` (question, label) with is_found: a label of the question equals it or goes on after it with a space."""
    rows = expected.join(labels.select("question", F.col("label").alias("__label")), "question", "left")
    hit = (F.col("__label") == F.col("label")) | F.col("__label").startswith(F.concat("label", F.lit(" ")))
    return rows.groupBy("question", "label").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("is_found"))


def rates(results: DataFrame, flags: list[str], by: list[str] = ()) -> DataFrame:
    """Number of rows and the share of each flag."""
    return results.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))), 6).alias(f"{f}_rate") for f in flags))


def quality(reports: DataFrame) -> DataFrame:
    """One row over run reports (status, expected_status, n_sources, n_chars, n_leaks)."""
    return reports.agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "answered").alias("n_answered"),
        F.count_if(F.col("expected_status").isNotNull() & (F.col("status") != F.col("expected_status"))).alias("n_unexpected"),
        F.avg("n_sources").alias("mean_sources"), F.max("n_chars").alias("most_chars"), F.sum("n_leaks").alias("n_leaks"),
    )


def expected_rates(expected: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """One row: how many labels were expected, and the share of them that each stage holds, such as retrieved, packed and cited.

    ``expected``: question, label; each stage: question, label.
    """
    rows = expected.select("question", "label").distinct()
    out = rows
    for name, labels in stages.items():
        out = out.join(found_labels(rows, labels).withColumnRenamed("is_found", name), ["question", "label"])
    return rates(out, list(stages))
