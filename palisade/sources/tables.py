"""Parquet tables written batch by batch, and versioned snapshots.

A batch or snapshot is addressed by its number and overwritten as a whole, so a retried
micro-batch leaves the same table behind. Only folders with a success marker count.

:func:`compact` rewrites batches to runs, of which a reader lists few: a run is named after its level
and the first and last batch it covers, its rows keep their ``batch_id``, and ``FAN_IN`` successive runs
of a level become one of the next. A table of n batches so has at most ``FAN_IN`` runs on each of
log(n) levels, and the batches since the last run.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


#: Successive runs of a level that are merged.
FAN_IN = 16

#: Rows of a day and a batch that one task writes, to one file.
FILE_ROWS = 200_000


class Run(NamedTuple):
    first: int
    last: int
    level: int

    def path(self, root: str) -> str:
        return f"{root}_runs/run={self.level}-{self.first}-{self.last}"


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str, key: str) -> list[int]:
    """Numbers of the complete folders, from one listing of their success markers."""
    markers = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{key}=*/_SUCCESS")
    found = _files(spark, root).globStatus(markers) or []
    return sorted(int(m.getPath().getParent().getName().split("=", 1)[1]) for m in found)


def write_batch(frame: DataFrame, root: str, batch_id: int, date_of: str | None = None) -> None:
    """Writes one batch; with ``date_of`` its rows are laid out in folders by day."""
    target = f"{root}/batch_id={batch_id}"
    if date_of:
        frame = _together_by_day(frame.withColumn("day", F.to_date(date_of)))
        frame.write.mode("overwrite").partitionBy("day").parquet(target)
    else:
        frame.write.mode("overwrite").parquet(target)


def _together_by_day(frame: DataFrame) -> DataFrame:
    """Deals the rows of a day to one task per ``FILE_ROWS`` of them.

    A batch then has about as many files as days and ``FILE_ROWS``, however many tasks and days made it.
    Rows are dealt by their content, so a task that is repeated deals them the same way.
    """
    parts = frame.groupBy(F.col("day").alias("_day")).agg(
        F.ceil(F.count("*") / FILE_ROWS).alias("_parts")
    )
    part = F.pmod(F.xxhash64(*frame.columns), F.coalesce("_parts", F.lit(1)))
    return (
        frame.join(F.broadcast(parts), F.col("day").eqNullSafe(F.col("_day")), "left")
        .withColumn("_part", part)
        .repartition("day", "_part")
        .select(*frame.columns)
    )


def read_batches(
    spark: SparkSession, root: str, schema: StructType, after: int = -1, last: int | None = None
) -> DataFrame:
    """All complete batches after ``after``, with their ``batch_id``."""
    wanted = [
        n for n in _versions(spark, root, "batch_id") if n > after and (last is None or n <= last)
    ]
    full = StructType([*schema.fields, StructField("batch_id", LongType())])
    if not wanted:
        return spark.createDataFrame([], full)
    return (
        spark.read.schema(full)
        .option("basePath", root)
        .parquet(*[f"{root}/batch_id={n}" for n in wanted])
    )


def _all_runs(spark: SparkSession, root: str) -> list[Run]:
    """Complete runs, the widest of those with the same first batch ahead."""
    markers = spark._jvm.org.apache.hadoop.fs.Path(f"{root}_runs/run=*/_SUCCESS")
    found = _files(spark, root).globStatus(markers) or []
    names = [m.getPath().getParent().getName().split("=", 1)[1].split("-") for m in found]
    runs = [Run(int(first), int(last), int(level)) for level, first, last in names]
    return sorted(runs, key=lambda run: (run.first, -run.last))


def current_runs(spark: SparkSession, root: str) -> list[Run]:
    """The runs that readers use: they follow each other and none is part of another."""
    chosen: list[Run] = []
    for run in _all_runs(spark, root):
        if run.first == (chosen[-1].last + 1 if chosen else 0):
            chosen.append(run)
    return chosen


def read_complete(
    spark: SparkSession, root: str, schema: StructType | None = None, last: int | None = None
) -> DataFrame:
    """All complete batches, with their ``batch_id`` and the schema their files have.

    With ``schema``, a table without batches is an empty one.
    """
    runs = current_runs(spark, root)
    covered = runs[-1].last if runs else -1
    wanted = [
        n for n in _versions(spark, root, "batch_id")
        if n > covered and (last is None or n <= last)
    ]
    if not wanted and not runs and schema is not None:
        return spark.createDataFrame([], schema)
    parts = []
    if runs:
        kept = _read_runs(spark, root, runs)
        parts.append(kept if last is None else kept.where(F.col("batch_id") <= last))
    if wanted or not runs:
        parts.append(_read_numbered(spark, root, wanted))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _read_numbered(spark: SparkSession, root: str, numbers: list[int]) -> DataFrame:
    stored = spark.read.option("basePath", root).parquet(*[f"{root}/batch_id={n}" for n in numbers])
    return stored.withColumn("batch_id", F.col("batch_id").cast("bigint"))


def _read_runs(spark: SparkSession, root: str, runs: list[Run]) -> DataFrame:
    paths = [run.path(root) for run in runs]
    return spark.read.option("basePath", f"{root}_runs").parquet(*paths).drop("run")


def _write_run(frame: DataFrame, root: str, run: Run, order: str) -> None:
    """One run, in the order of ``order``, with a Bloom filter on it, in folders by day if it has days."""
    days = [name for name in ("day",) if name in frame.columns]
    ordered = frame.repartitionByRange(*days, order).sortWithinPartitions(*days, order)
    writer = ordered.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{order}", "true")
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")  # sized to the values
    (writer.partitionBy(*days) if days else writer).parquet(run.path(root))


def compact(spark: SparkSession, root: str, upto: int, order: str) -> None:
    """Rewrites the batches up to number ``upto`` that are in no run yet, and merges runs.

    What a new run replaces stays until the next call, for readers that have listed it already.
    Call it with numbers of micro-batches that are over; it may stop anywhere and be repeated.
    """
    _remove_replaced(spark, root)
    runs = current_runs(spark, root)
    first = runs[-1].last + 1 if runs else 0
    fresh = [n for n in _versions(spark, root, "batch_id") if first <= n <= upto]
    if len(fresh) > 1:
        runs.append(Run(first, fresh[-1], 0))
        _write_run(_read_numbered(spark, root, fresh), root, runs[-1], order)
    while len(runs) >= FAN_IN and len({run.level for run in runs[-FAN_IN:]}) == 1:
        merged = runs[-FAN_IN:]
        runs[-FAN_IN:] = [Run(merged[0].first, merged[-1].last, merged[0].level + 1)]
        _write_run(_read_runs(spark, root, merged), root, runs[-1], order)


def _remove_replaced(spark: SparkSession, root: str) -> None:
    runs = current_runs(spark, root)
    if runs:
        remove_batches(spark, root, runs[-1].last)
    files = _files(spark, root)
    for run in set(_all_runs(spark, root)) - set(runs):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(run.path(root)), True)


def remove_batches(spark: SparkSession, root: str, upto: int) -> None:
    """Removes the batches up to number ``upto``."""
    files = _files(spark, root)
    for number in _versions(spark, root, "batch_id"):
        if number <= upto:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch_id={number}"), True)


def append_updates(frame: DataFrame, root: str) -> int:
    """Adds a batch numbered by the clock, for tables that any caller may add to.

    The readers of such tables take the latest update of each row, so storing one twice does no harm.
    """
    number = time.time_ns()
    frame.write.mode("errorifexists").parquet(f"{root}/batch_id={number}")
    return number


def read_batch(spark: SparkSession, root: str, schema: StructType, batch_id: int) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/batch_id={batch_id}")


def write_snapshot(frame: DataFrame, root: str, version: int) -> None:
    frame.write.mode("overwrite").parquet(f"{root}/v={version}")


def prune_snapshots(spark: SparkSession, root: str, keep: int) -> int | None:
    """Removes all complete snapshots but the ``keep`` newest; returns the oldest version left."""
    if keep < 2:
        raise ValueError("a retried batch needs the snapshot before the newest")
    files = _files(spark, root)
    versions = _versions(spark, root, "v")
    for version in versions[:-keep]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v={version}"), True)
    return versions[-keep:][0] if versions else None


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    versions = [n for n in _versions(spark, root, "v") if before is None or n < before]
    return versions[-1] if versions else None


def read_snapshot(spark: SparkSession, root: str, schema: StructType, version: int | None) -> DataFrame:
    """The snapshot of a version; without one, an empty table."""
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/v={version}")
