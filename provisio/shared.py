"""Tables in the folder that the driver and all executors share: where iterative operators cut their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of this machine only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="provisio-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, place: str | None = None) -> DataFrame:
    """``df`` written (to ``place``, or a new path) and read again, so that what follows neither repeats nor carries its plan."""
    spark = df.sparkSession
    place = place or path(spark, name)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)
