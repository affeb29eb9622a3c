"""Requests as rows, answered in tasks by an injected caller; a failed one never looks like an empty one.

The caller is any function from (method, address) to a ``Reply``; it raises TimeoutError, or another
OSError, where no reply came.  Each row keeps what was asked and has either a body or one of the
errors HTTP_ERROR, TIMEOUT, INVALID_RESPONSE and CONFIG (no address).  Replies are read once for each time
the rows are, and again for a task that is lost; write them before they are read more than once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from provisio.config import backoff_ms, may_retry
from provisio.sources import metadata


class Reply(NamedTuple):
    status: int
    body: str = ""


class Told(NamedTuple):
    status: int | None
    body: str | None
    error: str | None


Caller = Callable[[str, str], Reply]
#: Replies held at once in a task.
AT_ONCE = 64
ANSWER = [StructField("http_status", IntegerType()), StructField("body", StringType()), StructField("error", StringType())]


def called(fetch: Caller, method: str, url: str | None, attempts: int = 1, wait: Callable[[float], None] = time.sleep) -> Told:
    """One request, tried again after failures that may pass."""
    if not url:
        return Told(None, None, "CONFIG")
    for attempt in range(1, attempts + 1):
        try:
            reply = fetch(method, url)
            fine = 200 <= reply.status < 300
            told = Told(reply.status, reply.body if fine else None, None if fine else "HTTP_ERROR")
        except TimeoutError:
            told = Told(None, None, "TIMEOUT")
        except OSError:
            told = Told(None, None, "HTTP_ERROR")
        if told.error is None or not may_retry(told.status) or attempt == attempts:
            return told
        wait(backoff_ms(attempt) / 1000)
    raise ValueError("at least one attempt")


def _answered(wanted: DataFrame, url_col: str, answer: Callable[[str | None], tuple], fields: list[StructField], callers: int | None) -> DataFrame:
    """``wanted`` with the fields that ``answer`` gives for an address; ``callers``: how many tasks may call at once."""
    if taken := {f.name for f in fields} & set(wanted.columns):
        raise ValueError(f"columns of the request have names of the answer: {sorted(taken)}")
    place, kinds = wanted.columns.index(url_col), {StringType(): pa.string(), IntegerType(): pa.int32(), BooleanType(): pa.bool_()}
    types, names = [kinds[f.dataType] for f in fields], wanted.columns + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(low, AT_ONCE)
                told = list(zip(*map(answer, part.column(place).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(t, k) for t, k in zip(told, types, strict=True))], names=names)

    rows = wanted.repartition(callers) if callers else wanted
    return rows.mapInArrow(run, StructType([*wanted.schema.fields, *fields]))


def fetched(wanted: DataFrame, fetch: Caller, *, url_col: str = "url", attempts: int = 1, callers: int | None = None) -> DataFrame:
    """``wanted`` with http_status, body and error; the body is null exactly where there is an error."""
    return _answered(wanted, url_col, lambda url: called(fetch, "GET", url, attempts), ANSWER, callers)


def probed(wanted: DataFrame, fetch: Caller, *, url_col: str = "uri", attempts: int = 1, callers: int | None = None) -> DataFrame:
    """``wanted`` with is_available and error, by HEAD, and by GET where HEAD is not supported (405, 501).

    A status that is no success means that it is not available; without a status nothing is known,
    is_available is null, and there is an error.
    """

    def answer(url: str | None) -> tuple[bool | None, str | None]:
        told = called(fetch, "HEAD", url, attempts)
        if told.status in (405, 501):
            told = called(fetch, "GET", url, attempts)
        return (None, told.error) if told.status is None else (told.error is None, None)

    return _answered(wanted, url_col, answer, [StructField("is_available", BooleanType()), ANSWER[2]], callers)


def requests(acts: DataFrame, *, references: bool = False) -> DataFrame:
    """``acts`` (publisher, year, pos) with the address of their metadata, or of their references."""
    url = metadata.act_url()
    return acts.withColumn("url", F.concat_ws("/", url, F.lit("references")) if references else url)


def _asked(replies: DataFrame) -> Column:
    return F.struct(*(c for c in replies.columns if c not in ("http_status", "body", "error"))).alias("asked")


def act_metadata(replies: DataFrame) -> DataFrame:
    """(asked, http_status, error, the fields of metadata): what is not such JSON is INVALID_RESPONSE, and no field of it is used."""
    kind = f"{metadata.METADATA}, _corrupt_record string"
    read = F.from_json("body", kind, {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = replies.select(_asked(replies), "http_status", "error", read.alias("__read"))
    whole = rows.select("asked", "http_status", "error", "__read.*")
    fine = F.col("_corrupt_record").isNull() & metadata.valid()
    error = F.coalesce("error", F.when(~F.coalesce(fine, F.lit(False)), "INVALID_RESPONSE"))
    fields = [c for c in whole.columns if c not in ("asked", "http_status", "error", "_corrupt_record")]
    told = whole.withColumn("error", error)
    return told.select("asked", "http_status", "error", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in fields))


def act_references(replies: DataFrame) -> DataFrame:
    """(asked, http_status, error, json): an object of lists, possibly empty, or INVALID_RESPONSE; ``json`` is what ``metadata.relations`` reads."""
    lists = F.from_json("body", "map<string,array<string>>")
    is_object = F.coalesce(F.trim("body").startswith("{") & lists.isNotNull() & F.forall(F.map_values(lists), lambda x: x.isNotNull()), F.lit(False))
    error = F.coalesce("error", F.when(~is_object, "INVALID_RESPONSE"))
    told = replies.select(_asked(replies), "http_status", error.alias("error"), "body")
    return told.select("asked", "http_status", "error", F.when(F.col("error").isNull(), F.col("body")).alias("json"))
