"""A persistent lexical index: postings by lexeme, in blocks of documents, with bounds by which a search skips blocks.

An index is a table of rows (block, lexeme, top, docs, tfs, places, ids).  A block has up to BLOCK
documents of one task, of like lengths; a row holds a lexeme's postings in a block: the documents'
numbers there, how often each has the lexeme, its places one document after the other, and the
largest of the counts.  The row with the lexeme '' holds the documents' ids, null for those that
are gone.  Building shuffles nothing.  An index that was written is read as any other table.

A search first looks at the counts only.  A rank adds at most 0.1 for each pair of neighbouring
hits that differ, so a document with s hits, m of them of one lexeme, ranks at most
0.1 * min(s - 1, 2 * (s - m)).  Blocks with the highest bounds are read first; they give each query a
least rank to beat, and of the other blocks only those are read whose bound reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio import shared
from provisio.functions import text
from provisio.operators import retrieval

#: Documents of a block (2**10 at most); tokens that a task holds while it builds, which also closes a block.
BLOCK, HELD = 64, 2_000_000
#: Blocks that a query reads before it has a rank to beat.
SEEDS = 3
#: Queries that are answered by one task for a block.
ASKED = 2000
SCHEMA = "block long, lexeme string, top int, docs binary, tfs binary, places binary, ids array<long>"
#: Numbers of a posting as bytes, little-endian.
KINDS = {"docs": "<u2", "tfs": "<u4", "places": "<u4"}


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)).astype(np.int32)), pa.array(values, kind))


def _blobs(column: str, values: np.ndarray, first: np.ndarray) -> pa.Array:
    data = values.astype(KINDS[column])
    offsets = (np.append(first, len(values)) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _rows(ids: np.ndarray, lengths: np.ndarray, flat: pa.Array, base: int, size: int, most: int) -> tuple[list[pa.RecordBatch], int]:
    """The rows of some documents, in blocks of ``size`` documents or ``most`` tokens, and how many blocks they are."""
    coded = pc.dictionary_encode(flat)
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = place[coded.indices.to_numpy()]
    words = coded.dictionary.take(pa.array(order))
    by_length = np.lexsort((ids, -lengths))
    block, nth, held = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), 0
    at = n = 0
    for i in by_length.tolist():
        if n == size or held > most:
            at, n, held = at + 1, 0, 0
        block[i], nth[i] = at, n
        n, held = n + 1, held + int(lengths[i])
    blocks = at + 1
    start = np.cumsum(lengths) - lengths
    places = np.arange(len(code)) - np.repeat(start, lengths)
    key = (code * blocks + np.repeat(block, lengths)) * size + np.repeat(nth, lengths)
    order = np.argsort(key, kind="stable")  # places rise in a document
    key, places = key[order], places[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    tf, posting = np.diff(first, append=len(key)), key[first]
    row = posting // size
    row_first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    row = row[row_first]
    out = [
        pa.RecordBatch.from_arrays(
            [
                pa.array(base + row % blocks), words.take(pa.array(row // blocks)), pa.array(np.maximum.reduceat(tf, row_first).astype(np.int32)), _blobs("docs", posting % size, row_first),
                _blobs("tfs", tf, row_first), _blobs("places", places, first[row_first]), pa.nulls(len(row), pa.list_(pa.int64())),
            ],
            names=["block", "lexeme", "top", "docs", "tfs", "places", "ids"],
        )
    ]
    inside = np.lexsort((nth, block))
    block_first = np.flatnonzero(np.append(True, np.diff(block[inside]) != 0))
    none = pa.array([b""] * blocks, pa.binary())
    out.append(pa.RecordBatch.from_arrays([pa.array(base + np.arange(blocks)), pa.array([""] * blocks), pa.array(np.zeros(blocks, np.int32)), none, none, none, _lists(ids[inside], block_first, pa.int64())], names=out[0].schema.names))
    return out, blocks


def built(docs: DataFrame, *, id_col: str = "id", text_col: str = "text", generation: int = 0, block: int = BLOCK, held: int = HELD, path: str | None = None) -> DataFrame:
    """The index of documents, written to ``path`` (a scratch table if it is None); those without an id or a lexeme are left out, as nothing finds them.  Each update of an index has the next ``generation``."""
    return shared.cut(_built(docs, id_col, text_col, generation, block, held), "lexical-index", path)


def _built(docs: DataFrame, id_col: str, text_col: str, generation: int, block: int, held: int) -> DataFrame:
    """Rows of an index; blocks are numbered by task, so they have to be written before they are read twice."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (generation << 44) + (TaskContext.get().partitionId() << 22)
        ids, lengths, flat, n = [], [], [], 0
        for batch in batches:
            tokens = batch.column(1)
            ids.append(batch.column(0).to_numpy())
            lengths.append(np.diff(tokens.offsets.to_numpy()).astype(np.int64))
            flat.append(tokens.flatten())
            n += len(flat[-1])
            if n >= held:
                rows, blocks = _rows(np.concatenate(ids), np.concatenate(lengths), pa.concat_arrays(flat), base, block, held)
                yield from rows
                base, ids, lengths, flat, n = base + blocks, [], [], [], 0
        if n:
            yield from _rows(np.concatenate(ids), np.concatenate(lengths), pa.concat_arrays(flat), base, block, held)[0]

    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.tokens(F.col(text_col)).alias("tokens"))
    return rows.where(F.size("tokens") > 0).mapInArrow(build, SCHEMA)


def updated(index: DataFrame, docs: DataFrame, changes: DataFrame, *, generation: int, id_col: str = "id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``index`` after ``changes`` (id, action) as of ``indexing.difference``: what was removed or changed is gone from its block, what is new or changed is in blocks of its own; all other rows stay as they are."""
    stale = changes.where("action != 'unchanged'").select(F.col("id").cast("long").alias("stale")).distinct()
    known = index.where("lexeme = ''").select("block", F.posexplode("ids").alias("nth", "id"))
    known = known.join(stale, F.col("id") == F.col("stale"), "left").select("block", "nth", F.when(F.col("stale").isNull(), F.col("id")).alias("id"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"])
    none = F.lit(b"")
    known = known.groupBy("block").agg(ids.alias("ids")).select("block", F.lit("").alias("lexeme"), F.lit(0).alias("top"), none.alias("docs"), none.alias("tfs"), none.alias("places"), "ids")
    fresh = docs.join(changes.where("action = 'embedded'").select(F.col("id").alias(id_col)), id_col, "left_semi")
    every = index.where("lexeme != ''").unionByName(known).unionByName(_built(fresh, id_col, text_col, generation, BLOCK, HELD))
    return shared.cut(every, "lexical-index", path)


def _ranked(limit: int):
    """The best documents of one block for each query that asks it."""

    def rank(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = rows["lexeme"].to_pylist()
        blobs = {c: rows[c].to_pylist() for c in KINDS}
        part = lambda c, i: np.frombuffer(blobs[c][i], KINDS[c]).astype(np.int64)

        @cache
        def postings(i: int) -> tuple[np.ndarray, np.ndarray]:
            """A lexeme's documents, and its hits as numbers of a document, a place and the lexeme: no two in a block are equal."""
            docs = part("docs", i)
            return docs, (np.repeat(docs, part("tfs", i)) << 53) | (part("places", i) << 21) | i

        at = {w: i for i, w in enumerate(names)}
        found: list[tuple] = []
        if "" in at:
            ids = np.array(rows["ids"][at[""]].as_py(), dtype=object)
            live = np.array([i is not None for i in ids])
            number = np.array([i if i is not None else 0 for i in ids], np.int64)
            for query, lexemes in zip(asked["query_id"].to_pylist(), asked["lexemes"].to_pylist(), strict=True):
                own = [at[w] for w in lexemes if w in at]
                if not own:
                    continue
                docs, hits = zip(*(postings(i) for i in own), strict=True)
                n = np.bincount(np.concatenate(docs), minlength=len(ids))
                key = np.sort(np.concatenate(hits))
                doc, place, lexeme = key >> 53, (key >> 21) & 0xFFFFFFFF, key & 0x1FFFFF
                if len(lexemes) == 1:
                    score = 0.1 * np.bincount(doc, minlength=len(ids))
                else:
                    near = (doc[1:] == doc[:-1]) & (lexeme[1:] != lexeme[:-1])
                    score = np.bincount(doc[1:][near], 0.1 / (place[1:] - place[:-1])[near], len(ids))
                score = np.round(score.astype(np.float64), 6)
                match = np.flatnonzero((n >= min(2, len(lexemes))) & live)
                match = match[np.lexsort((number[match], -score[match]))[:limit]]
                found.append((np.full(len(match), query, np.int64), number[match], n[match].astype(np.int64), score[match]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.float64)]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "id", "n_lexemes", "rank"])

    return rank


def _read(index: DataFrame, wanted: DataFrame, lexemes: DataFrame) -> DataFrame:
    """The index's rows that ``wanted`` (block, lexeme) names, and the ids of the blocks; of lexemes that nobody asks for nothing is dealt out."""
    known = lexemes.select("lexeme").distinct()
    index = index.join(known.unionByName(known.sparkSession.range(1).select(F.lit("").alias("lexeme"))), "lexeme", "left_semi").select(index.columns)
    every = wanted.select("block", "lexeme").unionByName(wanted.select("block", F.lit("").alias("lexeme"))).distinct()
    return index.join(every, ["block", "lexeme"], "left_semi")


def _evaluated(index: DataFrame, pairs: DataFrame, lexemes: DataFrame, asked: DataFrame, parts: int, limit: int) -> DataFrame:
    rows = _read(index, pairs.join(lexemes, "query_id"), lexemes).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = pairs.select("query_id", "block").join(asked, "query_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    return rows.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(_ranked(limit), "query_id long, id long, n_lexemes long, rank double")


def hits(index: DataFrame, queries: DataFrame, limit: int = retrieval.CANDIDATES, *, seeds: int = SEEDS, most_asked: int = ASKED) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, n_lexemes, rank) with the best ``limit`` of each query among them, equal to those of ``retrieval.lexical_hits``; and the (query_id, block) that were read.

    ``queries``: query_id, query.  They are rows of a table, joined by lexeme; nothing is gathered.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.array_distinct(text.tokens(F.col("query"))).alias("lexemes")).where(F.size("lexemes") > 0)
    asked = shared.cut(asked, "asked")
    parts = 1 + asked.count() // most_asked
    lexemes = asked.select("query_id", F.size("lexemes").alias("size"), F.explode("lexemes").alias("lexeme"))
    sums = index.where("lexeme != ''").select("block", "lexeme", "top").join(lexemes, "lexeme").groupBy("query_id", "size", "block").agg(F.sum("top").alias("s"), F.max("top").alias("m"), F.count("*").alias("n"))
    bound = F.when(F.col("size") == 1, F.col("s")).otherwise(F.least(F.col("s") - 1, 2 * (F.col("s") - F.col("m")))) * 0.1
    sums = shared.cut(sums.where(F.col("n") >= F.least(F.lit(2), "size")).select("query_id", F.col("block").alias("id"), bound.alias("bound")), "bounds")
    block = lambda df: df.select("query_id", F.col("id").alias("block"))
    highest = shared.cut(block(retrieval.top(sums, F.desc("bound"), seeds, "nth")), "highest")
    first = shared.cut(_evaluated(index, highest, lexemes, asked, parts, limit), "first")
    beat = retrieval.top(first, F.desc("rank"), limit, "nth").where(F.col("nth") == limit).select("query_id", F.col("rank").alias("beat"))
    rest = sums.join(beat, "query_id", "left").where(F.col("beat").isNull() | (F.col("bound") + 1e-6 >= F.col("beat")))  # an equal rank may go to a smaller id
    rest = shared.cut(block(rest).join(highest, ["query_id", "block"], "left_anti"), "rest")
    return first.unionByName(_evaluated(index, rest, lexemes, asked, parts, limit)), highest.unionByName(rest)


def search(index: DataFrame, queries: DataFrame, limit: int = retrieval.CANDIDATES) -> DataFrame:
    """As ``retrieval.lexical_search``: (query_id, id, lexical_rank)."""
    return retrieval.top(hits(index, queries, limit)[0], F.desc("rank"), limit, "lexical_rank").drop("rank", "n_lexemes")


def touched(index: DataFrame, queries: DataFrame, read: DataFrame) -> DataFrame:
    """(query_id, n): documents of which a search read postings; ``read``: the blocks of ``hits``."""
    lexemes = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("lexeme"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(b, KINDS["docs"]).astype(np.int32) for b in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate([*own, np.zeros(0, np.int32)]))], names=["query_id", "block", "doc"])

    rows = read.join(lexemes, "query_id").join(index.select("block", "lexeme", "docs"), ["block", "lexeme"]).select("query_id", "block", "docs")
    return rows.mapInArrow(numbers, "query_id long, block long, doc int").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
