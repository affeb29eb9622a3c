"""Embedding near-dedup by spherical-cap filters.

Filters are directions of a random product code: each of the ``BLOCKS`` parts of a rotated
vector has its own random code words, and a filter is one word for each part, so a few hundred
words make very many filters.  A vector is decoded to the list of all filters whose direction
it exceeds by the threshold: part by part, words that can't reach it are left out.  Two vectors
are compared if they share a filter; the cosine is computed in double precision and decides.

The threshold makes a filter hold about ``held`` vectors, and the number of filters grows with
the number of vectors so that two vectors at the cosine wanted share about ``shared`` of them.
A vector that exceeds fewer than ``least`` filters lowers its own threshold until it does not.

Equal vectors are one class.  A filter that holds many vectors is split into blocks, which meet
in pairs, each pair in a task of its own; a pair of vectors counts only in the first filter that
they share.  Tasks return sums and, of the links, only enough to connect what is linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.llm import storage
from provisio.llm.components import components

BLOCKS = 2
#: Vectors of a filter that meet in one task are at most about twice as many.
BLOCK_ROWS = 512


class Filters:
    """The product code for ``n`` vectors of ``dim`` numbers."""

    def __init__(self, n: int, dim: int, cosine: float, held: float = 60.0, shared: float = 16.0, least: int = 32, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.parts = np.array_split(np.arange(dim), BLOCKS)
        share = min(0.05, held / max(n, 1))
        z = NormalDist().inv_cdf(1 - share)
        both = self._both(z, cosine)
        words = int(np.ceil((shared / both) ** (1 / BLOCKS)))
        self.words = [self._unit(rng.standard_normal((max(4, words), len(p)))) for p in self.parts]
        self.threshold, self.step = z / np.sqrt(dim) * np.sqrt(BLOCKS), 0.2 / np.sqrt(dim) * np.sqrt(BLOCKS)
        self.least = min(least, int(np.prod([len(w) for w in self.words])))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1)[:, None]

    @staticmethod
    def _both(z: float, cosine: float) -> float:
        """Probability that two vectors at the cosine both exceed a filter by z deviations."""
        cosine = min(cosine, 1 - 1e-9)  # at 1 both always do
        x = np.linspace(z, z + 8, 2000)
        density = np.exp(-(x**2) / 2) / np.sqrt(2 * np.pi)
        tail = 1 - np.vectorize(NormalDist().cdf)((z - cosine * x) / np.sqrt(1 - cosine**2))
        return float(np.trapezoid(density * tail, x))

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted numbers of all filters that each unit vector exceeds."""
        x = x @ self.rotation
        first, second = (x[:, p] @ w.T for p, w in zip(self.parts, self.words, strict=True))
        order = np.argsort(-second, axis=1)
        ranked = np.take_along_axis(second, order, 1)
        out = []
        for i in range(len(x)):
            threshold, upto = self.threshold, np.zeros(0, int)
            while upto.sum() < self.least:
                may = np.flatnonzero(first[i] >= threshold - ranked[i, 0])
                upto = np.searchsorted(-ranked[i], first[i][may] - threshold, "right")
                threshold -= self.step
            found = [m * len(self.words[1]) + order[i, :k] for m, k in zip(may, upto, strict=True)]
            out.append(np.sort(np.concatenate(found)))
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest number, as squares may leave the range of doubles."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def linked_block(x: np.ndarray, lists: list[np.ndarray], here: int, left: np.ndarray, right: np.ndarray, cosine: float, same: bool) -> np.ndarray:
    """Which of left x right link and share no filter before ``here``; ``same``: each pair of one list once."""
    found = x[left] @ x[right].T >= cosine
    if same:
        found = np.triu(found, 1)
    i, j = np.nonzero(found)
    if len(i):
        before = [f[f < here] for f in lists]
        known, place = np.unique(np.concatenate(before), return_inverse=True)
        if len(known):
            on = np.zeros((len(lists), len(known)), np.float32)
            on[np.repeat(np.arange(len(lists)), [len(b) for b in before]), place] = 1
            earlier = on[left] @ on[right].T > 0
            found &= ~earlier
    return found


def _block_links(classes: DataFrame, dim: int, n: int, cosine: float, single: bool) -> DataFrame:
    """(class, n, root): links of ``n`` classes of vectors of one length, counted by block; ``root``: the smallest class that links reach inside it."""
    filters = classes.sparkSession.sparkContext.broadcast(Filters(n, dim, cosine))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                lists = filters.value.decode(unit(x))
                if single:
                    x = x.astype(np.float32)
                n = [len(f) for f in lists]
                who = np.repeat(np.arange(len(n)), n)
                held, code = [v.tobytes() for v in x], [f.astype(np.int32).tobytes() for f in lists]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(lists).astype(np.int64)), part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who)), pa.array([held[i] for i in who], pa.binary()), pa.array([code[i] for i in who], pa.binary())],
                    names=["filter", "class", "times", "v", "lists"],
                )

    held = storage.written(classes.select("class", "times", "v").repartition(F.col("class")).mapInArrow(decode, "filter long, class long, times long, v binary, lists binary"), "filter-lists")
    many = held.groupBy("filter").agg(F.count("*").alias("m")).where("m > 1")
    parts = F.ceil(F.col("m") / BLOCK_ROWS)
    spread = held.join(many, "filter").withColumns({"k": F.pmod(F.xxhash64("class"), parts), "other": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))})
    spread = spread.select("filter", F.least("k", "other").alias("low"), F.greatest("k", "other").alias("high"), (F.col("k") > F.col("other")).alias("right"), "class", "times", "v", "lists")

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("class")
        x = unit(np.frombuffer(b"".join(frame["v"]), np.float32 if single else np.float64).reshape(len(frame), dim).astype(np.float64))
        lists = [np.frombuffer(f, np.int32) for f in frame["lists"]]
        side, times, name = frame["right"].to_numpy(), frame["times"].to_numpy(), frame["class"].to_numpy()
        same = key[1] == key[2]
        left = np.flatnonzero(~side)
        right = left if same else np.flatnonzero(side)
        found = linked_block(x, lists, key[0], left, right, cosine, same)
        n = np.zeros(len(frame), np.int64)
        n[left] += found @ times[right]
        n[right] += times[left] @ found
        # the smallest class that links reach inside the block
        i, j = np.nonzero(found)
        i, j = left[i], right[j]
        label = np.arange(len(frame))
        while True:
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero(n)
        return pd.DataFrame({"class": name[some], "n": n[some], "root": name[label[some]]})

    return storage.written(spread.groupBy("filter", "low", "high").applyInPandas(compare, "class long, n long, root long"), "block-links")


def neighbours(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row per input row: id, n_links (other vectors linked directly), component_id, kept (id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing; vectors
    of different lengths don't link, and each length is searched by itself; a null id links with
    nothing and has a null component.  Equal vectors link with each other and are compared once; rows are
    returned as often as they come.  An empty table gives an empty one; other columns, whatever
    their names, are not read.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # these travel as they are
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("id").isNotNull() & F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    key = F.xxhash64("v"), F.sha2(F.to_json("v"), 256)
    # rows without a vector are spread by their ids, and match nothing
    rows = rows.withColumns({"h1": F.when(fine, key[0]).otherwise(F.xxhash64("id")), "h2": F.when(fine, key[1])}).withColumn("v", F.when(fine, F.col("v")))
    found = rows.where("v is not null and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("class"), F.count("*").alias("times"), F.first("v").alias("v"))
    classes = storage.written(found.withColumn("dim", F.size("v")), "vector-classes")
    blocks = None
    for size in classes.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1").orderBy("dim").collect():  # lengths of which there are two
        own = _block_links(classes.where(F.col("dim") == size["dim"]), size["dim"], size["n"], cosine, single)
        blocks = own if blocks is None else blocks.unionByName(own)
    if blocks is None:
        links, counts = spark.createDataFrame([], "class long, root long"), spark.createDataFrame([], "class long, n long")
    else:
        counts = blocks.groupBy("class").agg(F.sum("n").alias("n"))
        links = blocks.where("class != root").select("class", "root").distinct()
    comp = components(links, "class", "root").select(F.col("node").alias("class"), "component")
    label = classes.select("h1", "h2", "class", "times").join(counts, "class", "left").join(comp, "class", "left")
    label = storage.written(label.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "class").alias("component")), "vector-components")
    out = rows.drop("v").join(label, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
