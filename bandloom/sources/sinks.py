"""Where results go and come from: cached statistics, selections and evaluation tables."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS"))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written first if it isn't there."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_vector(values: DataFrame, path: str) -> None:
    """A band vector as bare values in band order, without a header."""
    values.orderBy("band").select("value").coalesce(1).write.mode("overwrite").csv(path)


def write_selections(selections: DataFrame, path: str) -> None:
    """``method, k, run_id, rank, band``, a folder for each method and k."""
    selections.write.mode("overwrite").partitionBy("method", "k").parquet(path)


def read_selections(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Selections of the wanted (method, k); those that were never made are left out."""
    return spark.read.parquet(path).join(wanted.select("method", "k").distinct(), ["method", "k"], "left_semi")


def write_csv(results: DataFrame, path: str) -> None:
    """A result table as CSV with a header; array columns as JSON."""
    flat = [F.to_json(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in results.dtypes]
    results.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="bandloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset, a local session has one of
    this machine; a cluster's executors would not see such, so there it is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; what is there goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def temporary(table: DataFrame, tag: str = "table") -> DataFrame:
    """The table written to the shared folder and read again, which cuts its lineage and outlives lost executors."""
    path = new_path(table.sparkSession, tag)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
