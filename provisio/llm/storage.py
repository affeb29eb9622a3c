"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where it is unset and there is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="provisio-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path; two runs never share one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """A written table whose place is known, for those that are dropped once used; ``by``: a column that splits it into folders."""

    def __init__(self, df: DataFrame, name: str, by: str | None = None):
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession, name)
        df.write.parquet(self.path, partitionBy=by)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        dropped(self.spark, self.path)


class Bucketed:
    """A table of the shared folder in buckets by a column, as many as a shuffle has partitions: a join on that column shuffles the other side only.

    Spark knows buckets by its catalog, so the table has a name there until it is forgotten; its files stay.
    """

    def __init__(self, df: DataFrame, name: str, column: str):
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession, name)
        self.name = self.path.rsplit("/", 1)[1].replace("-", "_")
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        df.write.format("parquet").bucketBy(parts, column).option("path", self.path).saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def forget(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


def tidied(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing holds any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
