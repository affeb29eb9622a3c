"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer, content, n_tokens), a folder for each tokenizer: digests of the tokenizer's
version and of the normalised content, and the count that belongs to them.  Documents are
joined to it by digest, only distinct contents without a stored count are encoded, and
their counts are appended.

The normalised content is the text with null taken as empty; no other change keeps every
tokenizer's counts exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.llm import storage, tokenizer
from provisio.llm.words import slices, strings, trim

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _stored(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache_path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).drop("tokenizer")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are
    returned as often as they come; an empty table gives an empty one.  Other columns, whatever
    their names, are not read.  Whole texts are encoded, however long.

    Only distinct missing contents travel, combined before they are dealt out, so copies cost
    one encoding and no task gets a group of copies.  The counts are written before they are
    read, so a lost executor costs its tasks only.  Two runs that append the same content at
    the same time leave equal rows, which are read as one.
    """
    spark = docs.sparkSession
    version = tokenizer.digest(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("content", content_digest(F.col("text")))
    missing = docs.select("content", "text")
    if (known := _stored(spark, cache_path, version)) is not None:
        missing = missing.join(known, "content", "left_anti")
    missing = missing.groupBy("content").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokenizer.encoder(tokenizer_path)
        for batch in batches:
            for part, _ in slices(batch, "text"):
                n = [len(ids.encode(t)) // 4 for t in strings(part, "text")]
                yield pa.RecordBatch.from_pydict({"tokenizer": pa.array([version] * len(n)), "content": part.column(0), "n_tokens": pa.array(n, pa.int64())})
        ids.forget()
        trim()

    missing.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = storage.written(_stored(spark, cache_path, version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return (
        docs.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(counts, "content")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
