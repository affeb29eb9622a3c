"""A bitmap of fixed size that recognises most rows which a join would drop, before they are shuffled.

It never loses a row of the join, which must follow; on very many keys it only drops fewer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def bitmap(keys: DataFrame, column: str) -> Callable[[np.ndarray], np.ndarray]:
    """A function from numbers to flags: true for every number in ``column``; at most BITS / 64 rows reach the driver."""
    slot = keys.select(F.expr(f"pmod({column}, {BITS}L)").alias("slot"))
    rows = slot.groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toPandas()
    bits = np.zeros(BITS // 64, np.int64)
    bits[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    shared = keys.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def has(numbers: np.ndarray) -> np.ndarray:
        at = np.mod(numbers, BITS).astype(np.uint64)
        return (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    return has
