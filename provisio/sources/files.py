"""Texts and attachments from files, and vectors and texts from injected services."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.config import backoff_ms, may_retry

EMBED_BATCH = 64
T = TypeVar("T")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html), one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def attachments(wanted: DataFrame) -> DataFrame:
    """``wanted`` (file_name, source_type_codes) with outcome: accepted with the code T of a text, else refused; such a file is never read in its place."""
    return wanted.withColumn("outcome", F.when(F.coalesce(F.array_contains(F.split("source_type_codes", ","), "T"), F.lit(False)), "accepted").otherwise("refused"))


class RefusedAttachment(ValueError):
    pass


def read_attachments(spark: SparkSession, path: str, wanted: DataFrame, *, skip_refused: bool = False) -> DataFrame:
    """(path, content) of attachments; one whose codes lack T is an error, or is left out if the caller says so."""
    told = attachments(wanted)
    if not skip_refused and (bad := told.where("outcome = 'refused'").first()):
        raise RefusedAttachment(f"{bad['file_name']} is not a text")
    rows = spark.read.format("binaryFile").load(path).withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    return rows.join(told.where("outcome = 'accepted'").select("file_name").distinct(), "file_name", "left_semi").select("path", "content")


def tried(call: Callable[[], T], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> T:
    """The call's result, tried again after failures that may pass (an error's ``status``: see ``config.may_retry``), with growing waits."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as error:
            if attempt == attempts or not hasattr(error, "status") or not may_retry(error.status):
                raise
            wait(backoff_ms(attempt) / 1000)
    raise AssertionError("at least one attempt")


def in_order(found: list, n: int) -> list[list[float]]:
    """Vectors of a response in the order of the texts; a response of (index, vector) pairs, in any order, is sorted by index.  Anything but one vector for each text is an error."""
    if found and isinstance(found[0], tuple):
        if sorted(i for i, _ in found) != list(range(n)):
            raise ValueError(f"a response's indexes are not those of {n} texts")
        found = [v for _, v in sorted(found, key=lambda x: x[0])]
    if len(found) != n:
        raise ValueError(f"{len(found)} vectors for {n} texts")
    return found


def embedded(texts: DataFrame, embed: Callable[[list[str]], list], *, id_col: str = "id", text_col: str = "content", batch: int = EMBED_BATCH, attempts: int = 3) -> DataFrame:
    """(id, embedding) by an injected service, ``batch`` texts a call; see ``tried`` and ``in_order``."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), batch):
                part = frame.iloc[low : low + batch]
                held = part["text"].tolist()
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": in_order(tried(lambda held=held: embed(held), attempts), len(held))})

    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)


def is_healthy(spark: SparkSession) -> bool:
    return spark.range(1).count() == 1
