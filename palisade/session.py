"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "palisade", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Recording the Python call site of every column costs more than planning the query.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder that ``spark.checkpoint.dir`` names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def stored(frame: DataFrame, purpose: str, file_rows: int = 0) -> DataFrame:
    """Writes a frame that is read more than once to the shared folder and reads it back. ``file_rows``
    is the most rows of a file, for frames of large rows."""
    path = work_folder(frame.sparkSession, purpose)
    writer = frame.write.option("maxRecordsPerFile", file_rows) if file_rows else frame.write
    writer.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
