"""Raw message channels: text folders, or Kafka where its package is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.sources.capture import publish_log


def with_arrival(messages: DataFrame) -> DataFrame:
    return messages.withColumn("ingest_ts", F.localtimestamp())


def raw_text(spark: SparkSession, path: str) -> DataFrame:
    return with_arrival(spark.read.text(path))


def raw_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Streaming (value, ingest_ts), one row per line of the files that arrive in a folder."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return with_arrival(reader.load(path))


def raw_kafka_stream(spark: SparkSession, servers: str, topic: str = "logs.raw") -> DataFrame:
    """The same from a Kafka topic; needs the Spark-Kafka package on the class path."""
    source = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    return with_arrival(source.select(F.col("value").cast("string").alias("value")))


def write_channel(log: DataFrame, path: str, mode: str = "append") -> None:
    """Publishes records to a text folder that :func:`raw_stream` reads."""
    publish_log(log).write.mode(mode).text(path)
