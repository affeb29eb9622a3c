"""Exact duplicates through counting quotient filters.

Every task counts the 64-bit fingerprints of its rows in counting quotient filters, one for each
segment of the fingerprints' range; a segment's filters meet in one task and are merged by their
sorted remainders.  Fingerprints with a count above one are verified: the whole texts that have
them are grouped by their bytes, copies combined before they are dealt out.  What the filters
count once is unique without a comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.llm import quotient_filter, spread, storage
from provisio.llm.bitmap import bitmap

#: Fingerprints that a task counts in one go.
HELD = 1 << 20


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def repeated(rows: DataFrame, column: str = "fp") -> DataFrame:
    """(fp, n) of the fingerprints (long) that occur more than once."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(24, max(1, (2 * parts - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: list[np.ndarray]) -> pa.RecordBatch:
            found = quotient_filter.cut(np.concatenate(held), bits)
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["segment", "filter"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64).copy())
            n += len(held[-1])
            if n >= HELD:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(blobs: list[bytes]) -> pa.RecordBatch:
            own, n = quotient_filter.merged(blobs)
            return pa.RecordBatch.from_arrays([pa.array(own[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["fp", "n"])

        segment, blobs = None, []
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != segment and blobs:
                    yield told(blobs)
                    blobs = []
                segment = s
                blobs.append(blob)
        if blobs:
            yield told(blobs)

    filters = rows.select(F.col(column)).mapInArrow(count, "segment int, filter binary")
    return filters.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(merge, "fp long, n long")


def _only(has, column: int):
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has(batch.column(column).to_numpy())))

    return some


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal if their normalised bytes are.  Of a group the row with the smallest id stays,
    of rows that repeat this id one; a null id is larger than any other, and where all ids of a
    group are null keep_id is null and one row stays.  A null text is the empty one.  An empty
    table gives an empty one; other columns, whatever their names, are not read.  ``docs`` is read
    twice and must give the same rows again.

    Groups may hold any share of the rows: filters send a fingerprint once a task, copies are
    combined in their tasks before they are verified, and groups of a thousandth of all rows or
    more, of which there are a thousand at most, find their rows by a broadcast.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", F.xxhash64("t").alias("fp"), F.unhex(F.sha2("t", 256)).alias("sha"))
    rows = storage.written(rows.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    twice = storage.Scratch(repeated(rows), "repeated")
    has = bitmap(twice.df, "fp")
    texts = docs.select(F.xxhash64(text).alias("fp"), text.alias("t")).mapInArrow(_only(has, 0), "fp long, t string")
    # by bytes: a text that only shares a fingerprint is a group of its own
    texts = texts.groupBy("fp", "t").agg(F.count("*").alias("n")).where("n > 1").select("fp", F.unhex(F.sha2("t", 256)).alias("sha"), "n")
    verified = texts.groupBy("fp", "sha").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    verified = verified.select("fp", "sha", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts share a fingerprint and a SHA-256")).cast("long")).alias("n"))
    some = rows.mapInArrow(_only(has, 1), rows.schema)
    first = some.groupBy("fp", "sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    found = storage.written(verified.join(first, ["fp", "sha"]).select("fp", "sha", "n", F.col("n").alias("group_size"), F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")), "groups")
    twice.drop()
    out = spread.joined(rows, found, ["fp", "sha"], "n", rows.count(), F.col("row") + 1)
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat both the id and the text of one that stays are kept with it."""
    stay = groups(docs, id_col=id_col, text_col=text_col).where("kept").select(F.struct(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("sha")).alias("key"))
    own = F.struct(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), own.alias("own"))
    return rows.join(stay, F.col("own").eqNullSafe(F.col("key")), "left_semi").select("row.*")
