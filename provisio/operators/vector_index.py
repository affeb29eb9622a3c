"""A persistent, exact vector index: balls around pivots, of which whole ones are left out by the triangle inequality of angles.

Pivots are up to PIVOTS of the vectors, chosen by a hash of their ids.  Every vector lies in the
ball of its nearest pivot, and there in a ring of its angle to the pivot; a block is a ring, or a
piece of a large one, and knows its least and largest angle.  A query at the angle a from a pivot is
at least max(0, a - largest, least - a) away from all of a block.  A search reads the nearest
blocks, which give each query the angle of its last neighbour so far; then only blocks that may
hold something as near, in rounds that tighten this angle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio import shared
from provisio.operators import retrieval

PIVOTS, RINGS, PIECE = 1024, 48, 1024
#: Blocks of a query that each round but the last one reads; balls that the first round looks at.
ROUNDS, NEAR = (4, 24), 4
#: Queries that are compared with a block by one task.
ASKED = 4000
#: Angles are that exact.
SLACK = 1e-6


@dataclass
class VectorIndex:
    """``members``: ball, ring, piece, id, v; ``blocks``: ball, ring, piece, low, high, n; ``pivots``: ball, v."""

    members: DataFrame
    blocks: DataFrame
    pivots: DataFrame

    def save(self, path: str) -> None:
        for name in ("members", "blocks", "pivots"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        return VectorIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("members", "blocks", "pivots")))


def _is_vector(v: Column, size: int | None = None) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine if size is None else fine & (F.size(v) == size), F.lit(False))


def _unit(batch: pa.RecordBatch, column: int) -> np.ndarray:
    x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def built(docs: DataFrame, *, id_col: str = "id", vector_col: str = "embedding", piece: int = PIECE) -> VectorIndex:
    """The index of vectors; those that are null, zero, not finite or of another size than the first pivot, and rows without an id, are left out."""
    spark = docs.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & _is_vector(F.col("v")))
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, math.isqrt(max(0, n - 1)) + 1)).collect() if n else []
    size = len(chosen[0]["v"]) if chosen else 0
    chosen = [r["v"] for r in chosen if len(r["v"]) == size]
    pivots = np.array(chosen, np.float64).reshape(len(chosen), size)
    pivots /= np.linalg.norm(pivots, axis=1)[:, None]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = _angles(_unit(batch, 1), pivots)
                ball = angle.argmin(1)
                own = angle[np.arange(len(ball)), ball]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ball.astype(np.int32)), pa.array(own)], names=["id", "v", "ball", "angle"])

    if chosen:
        rows = rows.where(F.size("v") == size).mapInArrow(assign, "id long, v array<double>, ball int, angle double")
    else:
        rows = rows.selectExpr("id", "v", "0 as ball", "0e0 as angle").limit(0)
    rows = shared.cut(rows.withColumn("ring", F.floor(F.col("angle") * (RINGS / math.pi)).cast("int")), "balls")
    rings = rows.groupBy("ball", "ring").agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / piece).cast("int")).drop("n")
    rows = rows.join(rings, ["ball", "ring"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    members = shared.cut(rows.select("ball", "ring", "piece", "id", "v", "angle"), "members")
    blocks = members.groupBy("ball", "ring", "piece").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    known = spark.createDataFrame([(i, p) for i, p in enumerate(pivots.tolist())], "ball int, v array<double>")
    return VectorIndex(members.drop("angle"), shared.cut(blocks, "blocks"), known)


def _compared(limit: int):
    def compare(members: pa.Table, asked: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if members.num_rows and asked.num_rows:
            x, q = (np.array(t["v"].to_pylist(), np.float64) for t in (members, asked))
            who, keys = members["id"].to_numpy(), asked["query_id"].to_numpy()
            q /= np.linalg.norm(q, axis=1)[:, None]
            s = (x @ q.T) / np.linalg.norm(x, axis=1)[:, None]
            best = [np.lexsort((who, -np.round(s[:, i], 12)))[:limit] for i in range(len(keys))]
            out = [np.repeat(keys, [len(b) for b in best]), np.concatenate([who[b] for b in best]), np.concatenate([s[b, i] for i, b in enumerate(best)])]
        return pa.table([pa.array(c) for c in out], names=["query_id", "id", "similarity"])

    return compare


BLOCK = ("ball", "ring", "piece")


def hits(index: VectorIndex, queries: DataFrame, limit: int = retrieval.CANDIDATES, *, rounds: tuple[int, ...] = ROUNDS, most_asked: int = ASKED) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, similarity) with the nearest ``limit`` of each query among them; and the blocks read: (query_id, ball, ring, piece, n).

    ``queries``: query_id, vector; those whose vector is null, zero, not finite or of another size have no
    neighbours.  They stay a table: only pivots reach every task.
    """
    pivots = np.array([r["v"] for r in index.pivots.orderBy("ball").collect()], np.float64)
    spark = queries.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("v"))
    asked = shared.cut(asked.where(F.col("query_id").isNotNull() & _is_vector(F.col("v"), pivots.shape[-1])), "asked")
    if not len(pivots):
        return spark.createDataFrame([], "query_id long, id long, similarity double"), spark.createDataFrame([], "query_id long, ball int, ring int, piece int, n long")
    parts = 1 + asked.count() // most_asked

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a = _angles(_unit(batch, 1), pivots)
                nth = a.argsort(1).argsort(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column(0).to_numpy(), len(pivots))), pa.array(np.tile(np.arange(len(pivots), dtype=np.int32), batch.num_rows)), pa.array(a.ravel()), pa.array(nth.ravel().astype(np.int32))],
                    names=["query_id", "ball", "angle", "nth"],
                )

    seen = shared.cut(asked.mapInArrow(angles, "query_id long, ball int, angle double, nth int"), "angles")
    away = F.greatest(F.lit(0.0), F.col("angle") - F.col("high"), F.col("low") - F.col("angle"))
    gaps = lambda rows: rows.join(index.blocks, "ball").withColumn("gap", away)
    found = read = None
    for size in (*rounds, None):
        if found is None:
            todo = gaps(seen.where(F.col("nth") < NEAR))
        else:
            last = retrieval.top(found, F.desc(F.round("similarity", 12)), limit, "place").where(F.col("place") == limit)
            last = last.select("query_id", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("similarity")))).alias("last"))
            todo = gaps(seen.join(last, "query_id", "left")).where(F.col("last").isNull() | (F.col("gap") <= F.col("last") + SLACK))
            todo = todo.join(read, ["query_id", *BLOCK], "left_anti")
        todo = todo.select("query_id", *BLOCK, F.col("n"), "gap")
        if size is not None:
            todo = retrieval.top(todo.withColumn("id", F.struct(*BLOCK)), F.asc("gap"), size, "place")
        todo = shared.cut(todo.select("query_id", *BLOCK, "n"), "todo")
        own = todo.select("query_id", *BLOCK).join(asked, "query_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        members = index.members.join(todo.select(*BLOCK).distinct(), list(BLOCK), "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        new = members.groupBy(*BLOCK, "part").cogroup(own.groupBy(*BLOCK, "part")).applyInArrow(_compared(limit), "query_id long, id long, similarity double")
        new = shared.cut(new, "near")
        found, read = (new, todo) if found is None else (found.unionByName(new), read.unionByName(todo))
    return found, read


def search(index: VectorIndex, queries: DataFrame, limit: int = retrieval.CANDIDATES) -> DataFrame:
    """As ``retrieval.vector_search``: (query_id, id, similarity, vector_rank)."""
    return retrieval.top(hits(index, queries, limit)[0], F.desc(F.round("similarity", 12)), limit, "vector_rank")
