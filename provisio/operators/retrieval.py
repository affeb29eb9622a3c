"""Hybrid retrieval: exact citations, words that occur together, and nearest vectors, fused by reciprocal ranks.

Queries are rows, so many are answered by one plan.  Candidates stay narrow (ids, ranks, scores)
until the last few are joined to their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provisio.functions import text

CANDIDATES, RESULTS, RRF, MIN_SIMILARITY = 30, 10, 60, 0.35


def in_scope(docs: DataFrame, scope: DataFrame | list, column: str) -> DataFrame:
    """Documents of the scope, a table of ``column`` (joined to, not gathered) or a few values; an empty one is an error, never everything."""
    if isinstance(scope, list):
        if not scope:
            raise ValueError("the scope is empty")
        return docs.where(F.col(column).isin(*scope))
    known = scope.where(F.col(column).isNotNull()).select(column)
    if known.isEmpty():
        raise ValueError("the scope is empty")
    return docs.join(known.distinct(), column, "left_semi").select(docs.columns)


#: Queries that are compared with a document at once.
BLOCK = 256


def _ranks(ids: np.ndarray, at: np.ndarray, holds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the queries that a document matches: their places, lexemes hit, and ranks; ``ids``: its lexemes that are asked for, at ``at``; ``holds``: queries x lexemes."""
    own = holds[:, ids]
    n = holds[:, np.unique(ids)].sum(1)
    match = np.flatnonzero(n >= np.minimum(2, sizes))
    query, hit = np.nonzero(own[match])
    near = (query[1:] == query[:-1]) & (ids[hit[1:]] != ids[hit[:-1]])
    rank = np.bincount(query[1:][near], 0.1 / (at[hit[1:]] - at[hit[:-1]])[near], len(match))
    single = sizes[match] == 1
    return match, n[match], np.round(np.where(single, 0.1 * np.bincount(query, minlength=len(match)), rank), 6)


def lexical_hits(docs: DataFrame, queries: DataFrame, *, id_col: str = "id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """(query_id, id, n_lexemes, rank): documents that hold two of a query's lexemes, or its only one.

    ``queries``: query_id, query; request values, which are sent to all tasks.  The rank adds
    0.1 / distance of neighbouring hits that differ; for a query of one lexeme, 0.1 for each hit.
    A document's positions never leave its row, so nothing is shuffled.  With ``limit`` a task keeps
    the best rows of each query only, those that a top-k may need.
    """
    asked = queries.select(F.col("query_id").cast("long"), F.array_distinct(text.tokens(F.col("query"))).alias("q")).where(F.size("q") > 0).collect()
    words = sorted({w for r in asked for w in r["q"]})
    place = {w: i for i, w in enumerate(words)}
    lists = [np.array([place[w] for w in r["q"]], np.int32) for r in asked]
    shared = docs.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in asked], np.int64), lists, words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lists, words = shared.value
        known, sizes = pa.array(words, pa.string()), np.array([len(x) for x in lists])
        blocks = []
        for low in range(0, len(keys), BLOCK):
            holds = np.zeros((len(lists[low : low + BLOCK]), len(words)), bool)
            for i, x in enumerate(lists[low : low + BLOCK]):
                holds[i, x] = True
            blocks.append((low, holds))
        best: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def kept(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
            order = np.lexsort((rows[1], -rows[3], rows[0]))
            first = np.flatnonzero(np.append(True, np.diff(rows[0][order]) != 0)) if len(order) else order
            nth = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
            return tuple(x[order[nth < limit]] for x in rows)

        def rows_of(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[rows[0]]), pa.array(rows[1]), pa.array(rows[2].astype(np.int64)), pa.array(rows[3])], names=["query_id", "id", "n_lexemes", "rank"])

        for batch in batches:
            tokens = batch.column(1)
            found = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1).to_numpy()
            cut = tokens.offsets.to_numpy()
            cut = cut - cut[0]
            out = [best] if limit is not None else []
            for i, name in enumerate(batch.column(0).to_pylist()):
                its = found[cut[i] : cut[i + 1]]
                at = np.flatnonzero(its >= 0)
                if not len(at):
                    continue
                for low, holds in blocks:
                    match, n, rank = _ranks(its[at], at, holds, sizes[low : low + BLOCK])
                    if len(match):
                        out.append((match + low, np.full(len(match), name, np.int64), n, rank))
            if out:
                rows = tuple(np.concatenate(x) for x in zip(*out, strict=True))
                if limit is None:
                    yield rows_of(rows)
                else:
                    best = kept(rows)
        if limit is not None:
            yield rows_of(best)

    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.tokens(F.col(text_col)).alias("tokens"))
    return rows.mapInArrow(scan, "query_id long, id long, n_lexemes long, rank double")


def top(rows: DataFrame, score: Column, limit: int, rank: str, by: str = "query_id") -> DataFrame:
    """The best rows of each query with their ranks from 1; equal scores go by id."""
    order = Window.partitionBy(by).orderBy(score, F.col("id"))
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= limit)


def lexical_search(docs: DataFrame, queries: DataFrame, *, limit: int = CANDIDATES, **columns: str) -> DataFrame:
    return top(lexical_hits(docs, queries, limit=limit, **columns), F.desc("rank"), limit, "lexical_rank").drop("rank", "n_lexemes")


def vector_search(docs: DataFrame, queries: dict[int, list[float]], *, id_col: str = "id", vector_col: str = "embedding", limit: int = CANDIDATES) -> DataFrame:
    """(query_id, id, similarity, vector_rank) of the nearest vectors, by an exact scan.

    Each task keeps ``limit`` rows a query, so what is shuffled does not grow with the documents of
    a task.  ``queries`` are request values and are sent to all tasks; vectors that are null, zero,
    of another size or hold what is not a finite number are left out, and have no neighbours.
    """
    queries = {k: v for k, v in queries.items() if v is not None and np.isfinite(np.array(v, np.float64)).all() and np.any(np.array(v, np.float64))}
    if not queries:
        return docs.sparkSession.createDataFrame([], "query_id long, id long, similarity double, vector_rank int")
    keys = np.array(list(queries), np.int64)
    q = np.array([queries[k] for k in queries], np.float64)
    q /= np.linalg.norm(q, axis=1)[:, None]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(keys)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            s = (x @ q.T) / np.linalg.norm(x, axis=1)[:, None]
            for i in range(len(keys)):
                score, who = np.concatenate((best[i][0], s[:, i])), np.concatenate((best[i][1], ids))
                keep = np.lexsort((who, -np.round(score, 12)))[:limit]
                best[i] = score[keep], who[keep]
        yield pa.RecordBatch.from_pydict(
            {"query_id": pa.array(np.repeat(keys, [len(s) for s, _ in best])), "id": pa.array(np.concatenate([w for _, w in best])), "similarity": pa.array(np.concatenate([s for s, _ in best]))}
        )

    v = F.col(vector_col).cast("array<double>")
    fine = (F.size(v) == q.shape[1]) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = docs.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).mapInArrow(scan, "query_id long, id long, similarity double")
    return top(rows, F.desc(F.round("similarity", 12)), limit, "vector_rank")


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1.0 / (RRF + F.nullif(rank, F.lit(0))), F.lit(0.0))


def fused(lexical: DataFrame, vector: DataFrame, exact: DataFrame | None = None, *, min_similarity: float | None = MIN_SIMILARITY) -> DataFrame:
    """(query_id, id, ranks, similarity, is_exact, score); what only vectors found needs the least similarity."""
    keys = ["query_id", "id"]
    both = lexical.select(*keys, "lexical_rank").join(vector.select(*keys, "vector_rank", "similarity"), keys, "full")
    if exact is None:
        both = both.withColumn("is_exact", F.lit(False))
    else:
        both = both.join(exact.select(*keys).distinct().withColumn("is_exact", F.lit(True)), keys, "full").withColumn("is_exact", F.coalesce("is_exact", F.lit(False)))
    both = both.withColumn("score", F.round(reciprocal(F.col("lexical_rank")) + reciprocal(F.col("vector_rank")), 9))
    if min_similarity is None:
        return both
    return both.where(F.col("lexical_rank").isNotNull() | F.col("is_exact") | (F.coalesce("similarity", F.lit(0.0)) >= min_similarity))


def ranked(candidates: DataFrame, limit: int = RESULTS) -> DataFrame:
    """Exact ones first, then by score; ties by lexical rank, vector rank and id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("is_exact"), F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("vector_rank"), "id")
    return candidates.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= limit)


def hydrated(results: DataFrame, *tables: tuple[DataFrame, str, str]) -> DataFrame:
    """The final rows joined to (table, own column, its column) in turn; rows that are missing there are dropped."""
    for table, own, other in tables:
        results = results.join(table, results[own] == table[other])
    return results
