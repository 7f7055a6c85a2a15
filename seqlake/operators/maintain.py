"""Maintenance as rewrites: what a compaction keeps, and what tables of files say about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.operators.mutations import PUT, RANGE_DELETE
from seqlake.operators.resolve import covering, meeting, points, range_deletes

# Defaults of the levels, fixed values.
LEVEL0_TRIGGER = 8
LEVEL_BASE_BYTES = 64 << 20
LEVEL_FACTOR = 10


def _seen(pinned: Sequence[int]) -> Column:
    """Whether the present or a pinned number lies in [seq, until); until is null for what lasts."""
    test = F.col("until").isNull()
    for s in sorted(set(pinned)):
        test = test | ((F.col("seq") <= s) & (F.lit(s) < F.col("until")))
    return test


def retained(log: DataFrame, pinned: Sequence[int] = ()) -> DataFrame:
    """The rows that the present or some pinned snapshot needs. Reads at each of them are the same on these rows.

    A version is shown from its number until the next version of its key or the first later range delete over
    it. It stays if the present or a pinned number lies within. Of these, markers of deletion stay only if a
    pinned number predates them, as otherwise nothing older is left for them to hide; so do range deletes. The
    log has to be whole, or at least whole families.
    """
    following = F.lag("seq").over(Window.partitionBy("cf", "key").orderBy(F.desc("seq")))
    versions = points(log).withColumn("until", following)
    # Versions that the present and all pinned numbers have left behind go before any join.
    versions = versions.where(_seen(pinned))
    later = meeting(versions.select("cf", "key", "seq"), range_deletes(log)).where("del_seq > seq")
    hidden = later.groupBy(F.col("cf").alias("h_cf"), F.col("seq").alias("h_seq")).agg(F.min("del_seq").alias("hidden"))
    shown = versions.join(hidden, (F.col("cf") == F.col("h_cf")) & (F.col("seq") == F.col("h_seq")), "left")
    shown = shown.withColumn("until", F.least("until", "hidden")).drop("h_cf", "h_seq", "hidden").where(_seen(pinned)).drop("until")
    predated = F.col("seq") > min(pinned) if pinned else F.lit(False)
    rows = shown.where((F.col("op") == PUT) | predated).withColumn("end_key", F.lit(None).cast(log.schema["end_key"].dataType))
    return rows.unionByName(log.where((F.col("op") == RANGE_DELETE) & predated))


def version_counts(log: DataFrame) -> DataFrame:
    return points(log).groupBy("cf", "key").agg(F.count("*").alias("n_versions"))


def covered_versions(log: DataFrame) -> DataFrame:
    """Point rows of any age with cover_seq, the highest range delete over them."""
    return covering(points(log), range_deletes(log))


def overlapping(files: DataFrame, lower: bytes | str, upper: bytes | str) -> DataFrame:
    """The files whose keys meet [lower, upper]."""
    return files.where((F.col("min_key") <= F.lit(upper)) & (F.col("max_key") >= F.lit(lower)))


def level_summary(files: DataFrame) -> DataFrame:
    """Files and bytes of each level."""
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("bytes").cast("long").alias("bytes"))


def compaction_scores(files: DataFrame, trigger: int = LEVEL0_TRIGGER, base: int = LEVEL_BASE_BYTES, factor: int = LEVEL_FACTOR) -> DataFrame:
    """level and score: files over the trigger for level 0, bytes over the level's limit for the others."""
    limit = F.lit(float(base)) * F.pow(F.lit(float(factor)), F.col("level") - 1)
    score = F.when(F.col("level") == 0, F.col("n_files") / F.lit(float(trigger))).otherwise(F.col("bytes") / limit)
    return level_summary(files).select("level", score.alias("score"))


def run_bounds(log: DataFrame, run: Column) -> DataFrame:
    """What a repair reads from each run of rows: its key bounds, row count and highest number."""
    return log.groupBy(run.alias("run")).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_rows"), F.max("seq").alias("max_seq")
    )


def operation_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("op").agg(F.count("*").alias("n_ops"), F.sum(F.octet_length("key")).cast("long").alias("key_bytes"))
