"""Joins of rows with a fact of their key, where one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with a row in so many of all rows is sent to all tasks; there are at most so many of these keys.
SHARE = 1000


def joined(rows: DataFrame, facts: DataFrame, on: list[str], times: str, total: int, spread: Column) -> DataFrame:
    """``rows`` left joined to ``facts`` (a row for each key; columns not in ``on`` must be new), without a hot key anywhere.

    ``times``: a column of ``facts`` that says how many of the ``total`` rows have the key; it is
    dropped.  At most SHARE keys can have a SHARE-th of all rows each: these are broadcast, and
    their rows are dealt by ``spread``, a number that differs from row to row; all other keys are
    joined by a shuffle.  Keys are never null.
    """
    own = [c for c in facts.columns if c not in on and c != times]
    hot = F.col(times) * SHARE >= total
    kept = lambda side, mark: side.select(*on, F.struct(*own).alias(mark))
    out = rows.join(F.broadcast(kept(facts.where(hot), "__hot")), on, "left")
    out = out.withColumn("__deal", F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(spread))
    out = out.join(kept(facts.where(~hot), "__light").withColumn("__deal", F.lit(0).cast("long")), [*on, "__deal"], "left")
    return out.select(*rows.columns, *(F.coalesce(F.col("__hot")[c], F.col("__light")[c]).alias(c) for c in own))
