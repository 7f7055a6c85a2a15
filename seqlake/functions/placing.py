"""Ordered placing of rows without a single task: consecutive numbers, key ranges, small tables, checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.errors import InvalidArgument


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where the session names none, as in tests, a
    temporary folder serves a local master, whose executor is the driver; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise InvalidArgument("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark df for broadcast after counting that it has at most max_rows rows; else leave the join to Catalyst."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def by_ranges(df: DataFrame, order: Sequence[Column | str], name: str = "range_no") -> DataFrame:
    """df with the number of its key range: ranges of about equal size, in order, kept by a checkpoint.

    All rows with equal order columns have the same number.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id()))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, first: int = 0) -> DataFrame:
    """df with consecutive numbers in the given order.

    Rows are numbered within their key range, and a table of one row per range holds what comes before it.
    """
    ranged = by_ranges(df, order, "_range")
    counts = ranged.groupBy(F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_of", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    # One row per shuffle partition: its size is bounded by that setting.
    placed = ranged.join(F.broadcast(before), F.col("_range") == F.col("_of"))
    return placed.withColumn(name, (F.col("_before") + within + first).cast("long")).drop("_range", "_of", "_before")
