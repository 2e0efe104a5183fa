"""Session helpers: local defaults for tests, and the shared folder a job may write to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: str | int = "*", name: str = "undertow", **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("UNDERTOW_DRIVER_MEMORY", "8g"))
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local session without the setting gets a temporary folder of its own: on a cluster,
    executors could not see it.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="undertow-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/undertow-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back.

    Cuts the lineage, survives lost executors, and makes later scans columnar.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of a few driver-side rows. It goes through Arrow, so using it starts no job."""
    fields = T.DataType.fromDDL(schema)
    records = [dict(zip(fields.names, row)) for row in rows]
    return spark.createDataFrame(
        pa.Table.from_pylist(records, schema=to_arrow_schema(fields)), fields
    )


def settled(frame: DataFrame) -> DataFrame:
    """A frame known to be small, with its rows fixed: later uses do not repeat the work."""
    return frame.sparkSession.createDataFrame(frame.toArrow(), frame.schema)


def side_by_side(spark: SparkSession, jobs: dict[str, Callable[[], Any]]) -> dict[str, Any]:
    """Run jobs that do not need each other at the same time; they share the executors."""
    share_session = inheritable_thread_target(spark)
    with ThreadPool(max(1, len(jobs))) as pool:
        started = {name: pool.apply_async(share_session(job)) for name, job in jobs.items()}
        return {name: result.get() for name, result in started.items()}
