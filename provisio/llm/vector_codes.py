"""Product quantisation in whole numbers: codebooks by a few rounds of k-means, codes by a kd-tree.

Components become integers, vectors are cut into equal parts, and each position of a part has a
codebook.  In a round the driver builds a kd-tree over each codebook and broadcasts it; tasks find
every part's nearest entry by branch and bound and add up integers, which Spark sums by entry.
Only the codebooks (entries times components) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.llm import spread, storage

#: Components are multiplied by this before they are floored.
SCALE = 1024
#: Entries of a leaf.
LEAF = 8


class Tree:
    """A kd-tree over a codebook; ``nearest`` gives the entry at the least squared distance, of several the lowest."""

    def __init__(self, entries: np.ndarray, top: int):
        """``entries``: integers; ``top``: the largest absolute number in entries and points."""
        bound = 4 * top * top * max(1, entries.shape[1])
        if bound >= 1 << 62:
            raise ValueError("components are too large for exact squared distances")
        # whole numbers below 2**53 are exact in doubles, sums of products included
        self.kind = np.float64 if bound < 1 << 52 else np.int64
        self.entries = entries.astype(self.kind)
        self.nodes: list[tuple] = []
        self._grow(np.arange(len(entries)))

    def _grow(self, own: np.ndarray) -> int:
        x, place = self.entries[own], len(self.nodes)
        low, high = x.min(0), x.max(0)
        self.nodes.append(())
        axis = int(np.argmax(high - low))
        if len(own) <= LEAF or high[axis] == low[axis]:
            own = np.sort(own)
            self.nodes[place] = (low, high, own, self.entries[own], (self.entries[own] ** 2).sum(1))
        else:
            order = own[np.argsort(x[:, axis], kind="stable")]
            self.nodes[place] = (low, high, self._grow(order[: len(own) // 2]), self._grow(order[len(own) // 2 :]))
        return place

    def _bound(self, node: int, x: np.ndarray) -> np.ndarray:
        """The squared distance of points to the box around a node's entries."""
        low, high = self.nodes[node][:2]
        out = np.maximum(low - x, 0) + np.maximum(x - high, 0)
        return (out * out).sum(1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each point, a row of integers."""
        x = points.astype(self.kind)
        norm = (x * x).sum(1)
        best, who = np.full(len(x), np.inf if self.kind is np.float64 else 1 << 62, self.kind), np.full(len(x), len(self.entries))

        def compared(node: int, some: np.ndarray) -> None:
            own, entries, norms = self.nodes[node][2:]
            d = norm[some][:, None] - 2 * (x[some] @ entries.T) + norms
            at = d.argmin(1)  # the first of equal ones, and a leaf's entries rise
            least, entry = d[np.arange(len(some)), at], own[at]
            better = (least < best[some]) | ((least == best[some]) & (entry < who[some]))
            best[some[better]], who[some[better]] = least[better], entry[better]

        def descend(node: int, some: np.ndarray) -> None:
            if not len(some):
                return
            if len(self.nodes[node]) == 5:
                compared(node, some)
                return
            left, right = self.nodes[node][2:]
            near = self._bound(left, x[some]) <= self._bound(right, x[some])
            descend(left, some[near])
            descend(right, some[~near])

        def visit(node: int, some: np.ndarray) -> None:
            some = some[self._bound(node, x[some]) <= best[some]]  # an equal bound may hide an equal entry of a lower index
            if not len(some):
                return
            if len(self.nodes[node]) == 5:
                compared(node, some)
                return
            for child in self.nodes[node][2:]:
                visit(child, some)

        every = np.arange(len(x))
        if len(x):
            descend(0, every)
            visit(0, every)
        return who, best.astype(np.int64)


def _parts(batch: pa.RecordBatch, column: int, parts: int) -> list[np.ndarray]:
    x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.split(x, parts, axis=1)


def _improved(rows: DataFrame, books: list[np.ndarray], top: int) -> list[np.ndarray]:
    """The codebooks after one round: every entry used becomes the floored mean of its parts."""
    shared = rows.sparkSession.sparkContext.broadcast([Tree(b, top) for b in books])
    width = books[0].shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        sums = [np.zeros((len(t.entries), width + 1), np.int64) for t in trees]
        for batch in batches:
            for tree, total, x in zip(trees, sums, _parts(batch, 0, len(trees)) if batch.num_rows else [], strict=False):
                who, _ = tree.nearest(x)
                np.add.at(total, who, np.concatenate((np.ones((len(x), 1), np.int64), x), axis=1))
        for part, total in enumerate(sums):
            used = np.flatnonzero(total[:, 0])
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used) * (width + 1), part, np.int32)), pa.array(np.repeat(used, width + 1).astype(np.int32)), pa.array(np.tile(np.arange(width + 1), len(used)).astype(np.int32)), pa.array(total[used].ravel())],
                    names=["part", "entry", "pos", "total"],
                )

    found = rows.select("v").mapInArrow(assign, "part int, entry int, pos int, total long").groupBy("part", "entry", "pos").agg(F.sum("total").alias("total")).toPandas()
    out = []
    for part, book in enumerate(books):
        own = found[found["part"] == part]
        total = np.zeros((len(book), width + 1), np.int64)
        total[own["entry"].to_numpy(), own["pos"].to_numpy()] = own["total"].to_numpy()
        n = total[:, :1]
        out.append(np.where(n > 0, total[:, 1:] // np.maximum(n, 1), book))
    shared.unpersist()
    return out


def compressed(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """One row per vector kept: id, code (two hex digits a part), error, label_error (sum over the label), codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped, and so are those that
    ``parts`` doesn't divide, empty ones, and those of another length than that of the smallest id
    kept.  Codebooks begin with the rows of the smallest ids; rows that repeat an id are ordered by
    their vectors, and null ids come last.  Fewer rows than ``entries`` make smaller codebooks.  Null labels are
    one label.  Rows are returned as often as they come; an empty table gives an empty one; other
    columns, whatever their names, are not read.  Components of 2**40 or more, or so large that
    squared distances exceed 62 bits, are an error.

    A task sends at most a number for each component of the codebooks in a round.  Labels may
    hold any share of the rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce((F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.when(F.abs(x) < float(1 << 40), F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long")))
    rows = storage.written(vectors.where(fine).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("v")), "whole-vectors")
    order = [F.asc_nulls_last("id"), "v"]
    one = rows.orderBy(*order).limit(1).collect()
    kind = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}"
    if not one:
        return spark.createDataFrame([], f"{kind}, code string, error long, label_error long, codebooks_sha256 string")
    size = len(one[0]["v"])
    rows = rows.where(F.size("v") == size)
    start = np.array([r["v"] for r in rows.orderBy(*order).limit(entries).collect()], np.int64)
    top = rows.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("m"), F.count("*").alias("n")).collect()[0]
    books = np.split(start, parts, axis=1)
    for _ in range(rounds):
        books = _improved(rows, books, top["m"])
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
    shared = spark.sparkContext.broadcast([Tree(b, top["m"]) for b in books])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        digits = max(2, len(f"{max(len(t.entries) for t in trees) - 1:x}"))
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [tree.nearest(x) for tree, x in zip(trees, _parts(batch, 2, len(trees)), strict=True)]
            codes = ["".join(f"{e:0{digits}x}" for e in row) for row in np.stack([w for w, _ in found], 1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(sum(d for _, d in found))], names=["id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    coded = rows.mapInArrow(code, f"id {rows.schema['id'].dataType.simpleString()}, label {label}, code string, error long")
    coded = coded.select("id", "code", "error", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"))
    coded = storage.written(coded.withColumn("row", F.monotonically_increasing_id()), "codes")
    sums = storage.written(coded.groupBy("none", "name").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "label-errors")
    out = spread.joined(coded, sums, ["none", "name"], "n", top["n"], F.col("row") + 1)
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
