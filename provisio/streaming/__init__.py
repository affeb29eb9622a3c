"""Batches of a stream merged into tables; the engine itself is a batch engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merging(read: Callable[[], DataFrame], publish: Callable[[DataFrame], None], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: what was fetched well is merged, and a failed fetch never looks like an empty one.

    Rows carry ``fetch_status``; keys that failed keep their old state.  ``publish`` must replace the
    table at once (write aside, then rename), as a batch may run twice.
    """

    def run(batch: DataFrame, _: int) -> None:
        good = batch.where(F.col("fetch_status") == "ok").drop("fetch_status")
        publish(merge(read(), good))

    return run
