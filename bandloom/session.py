"""Spark sessions for local work; on a cluster, use the session that is there."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(name: str = "bandloom", cores: int = 8, memory: str = "6g", **conf: str) -> SparkSession:
    """A local session with as few shuffle partitions as there are cores."""
    scratch = tempfile.mkdtemp(prefix="spark-")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoint")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each context, so that their Python can import it.

    Clusters on which it is installed, or submitted with --py-files, don't need this.
    """
    context = spark.sparkContext
    if not getattr(context, "_bandloom_shipped", False):
        folder = os.path.realpath(tempfile.mkdtemp(prefix="bandloom-"))
        root = Path(__file__).resolve().parent
        context.addPyFile(shutil.make_archive(f"{folder}/bandloom", "zip", root.parent, root.name))
        context._bandloom_shipped = True
