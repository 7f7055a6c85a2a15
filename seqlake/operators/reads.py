"""Reads of a log: lookups, scans and seeks, each as of a sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions.keys import has_prefix, in_range
from seqlake.functions.placing import broadcast_if_small, by_ranges, numbered
from seqlake.operators.mutations import RANGE_DELETE
from seqlake.operators.resolve import as_of, meeting, range_deletes, view

#: Requested keys that are broadcast, so that the log is not shuffled for them; and those that the Parquet scan is asked for.
MAX_BROADCAST_KEYS, MAX_SCAN_KEYS = 100_000, 1_000


def _only(log: DataFrame, test: Column) -> DataFrame:
    """The point rows that pass, and all range deletes, which reach beyond their own key."""
    return log.where((F.col("op") == RANGE_DELETE) | test)


def family(log: DataFrame, cf: str) -> DataFrame:
    """One family; as the log is partitioned by family, the others are not read."""
    return log.where(F.col("cf") == cf)


def get(log: DataFrame, key: bytes | str, cf: str | None = None, seq: int | None = None) -> DataFrame:
    """The visible row of one key, or no row."""
    log = log if cf is None else family(log, cf)
    return view(_only(log, F.col("key") == F.lit(key)), seq)


def multi_get(log: DataFrame, requests: DataFrame, seq: int | None = None) -> DataFrame:
    """For each request (pos, req_key): found, and the visible row; all from the same state, duplicates kept."""
    distinct = requests.select(F.col("req_key").alias("_key")).where("_key is not null").distinct()
    few = [r["_key"] for r in distinct.limit(MAX_SCAN_KEYS + 1).collect()]
    if len(few) <= MAX_SCAN_KEYS:
        shown = F.broadcast(view(_only(log, F.col("key").isin(few)), seq))  # a row for each key and family at most
    else:
        keys = broadcast_if_small(distinct, MAX_BROADCAST_KEYS)
        wanted = log.where(F.col("op") < RANGE_DELETE).join(keys, F.col("key") == F.col("_key"), "left_semi")
        shown = view(wanted.unionByName(log.where(F.col("op") == RANGE_DELETE)), seq)
    return requests.join(shown, F.col("req_key") == F.col("key"), "left").withColumn("found", F.col("key").isNotNull()).drop("key")


def exists(log: DataFrame, requests: DataFrame, seq: int | None = None) -> DataFrame:
    """pos, req_key and found for each request."""
    return multi_get(log, requests, seq).select("pos", "req_key", "found")


def key_may_exist(log: DataFrame, requests: DataFrame) -> DataFrame:
    """pos, req_key and maybe: whether any operation names the key. Never false for a visible key."""
    keys = broadcast_if_small(requests.select(F.col("req_key").alias("_req")).distinct(), MAX_BROADCAST_KEYS)
    named = log.join(keys, F.col("key") == F.col("_req"), "left_semi").select(F.col("key").alias("_key")).distinct()
    return requests.join(named, F.col("req_key") == F.col("_key"), "left").select("pos", "req_key", F.col("_key").isNotNull().alias("maybe"))


def scan(log: DataFrame, lower: bytes | str | None = None, upper: bytes | str | None = None, cf: str | None = None, seq: int | None = None) -> DataFrame:
    """The visible rows with lower <= key < upper. Order by key, ascending or descending, as needed."""
    log = log if cf is None else family(log, cf)
    return view(_only(log, in_range(F.col("key"), lower, upper)), seq)


def prefix_scan(log: DataFrame, prefix: bytes | str, cf: str | None = None, seq: int | None = None) -> DataFrame:
    log = log if cf is None else family(log, cf)
    return view(_only(log, has_prefix(F.col("key"), prefix)), seq)


def first(shown: DataFrame, n: int = 1, at_least: bytes | str | None = None) -> DataFrame:
    """The n least keys of a view, from at_least on."""
    return shown.where(in_range(F.col("key"), at_least)).orderBy("key").limit(n)


def last(shown: DataFrame, n: int = 1, at_most: bytes | str | None = None, upper: bytes | str | None = None) -> DataFrame:
    """The n greatest keys of a view, up to at_most and below upper."""
    kept = shown.where(in_range(F.col("key"), None, upper))
    return (kept if at_most is None else kept.where(F.col("key") <= F.lit(at_most))).orderBy(F.desc("key")).limit(n)


def ranked(shown: DataFrame, descending: bool = False) -> DataFrame:
    """The view with rank, counted from 1 in the order of a forward or backward scan."""
    return numbered(shown, [F.desc("key") if descending else F.asc("key")], "rank", 1)


def neighbours(shown: DataFrame) -> DataFrame:
    """key, prev_key and next_key of each visible key."""
    placed = ranked(shown.select("key"))
    before = placed.select(F.col("key").alias("prev_key"), (F.col("rank") + 1).alias("b_rank"))
    after = placed.select(F.col("key").alias("next_key"), (F.col("rank") - 1).alias("a_rank"))
    return (
        placed.join(before, F.col("rank") == F.col("b_rank"), "left").join(after, F.col("rank") == F.col("a_rank"), "left").select("key", "prev_key", "next_key")
    )


def seek(shown: DataFrame, targets: DataFrame, forward: bool = True) -> DataFrame:
    """For each target: found_key, the first visible key at or after it, or (forward False) the last at or before it.

    Keys and targets are dealt to key ranges together. Within a range the nearest key follows from a running
    value; where a range has none, from a table of one row per range.
    """
    both = shown.select(F.col("key").alias("at"), F.col("key").alias("hit"), F.lit(None).cast("string").alias("target")).unionByName(
        targets.select(F.col("target").alias("at"), F.lit(None).cast(shown.schema["key"].dataType).alias("hit"), F.col("target").cast("string").alias("target"))
    )
    ranged = by_ranges(both, ["at"])
    nearest, edge = (F.first, F.min) if forward else (F.last, F.max)
    span = Window.partitionBy("range_no").orderBy("at")
    span = span.rangeBetween(Window.currentRow, Window.unboundedFollowing) if forward else span.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.withColumn("inside", nearest("hit", ignorenulls=True).over(span)).where("target is not null")
    edges = ranged.where("hit is not null").groupBy(F.col("range_no").alias("of")).agg(edge("hit").alias("edge"))
    beyond = F.col("of") > F.col("range_no") if forward else F.col("of") < F.col("range_no")
    # One row per shuffle partition.
    found = inside.join(F.broadcast(edges), F.col("inside").isNull() & beyond, "left")
    return found.groupBy("target").agg(edge(F.coalesce("inside", "edge")).alias("found_key"))


def history(log: DataFrame, key: bytes | str) -> DataFrame:
    """All point versions of a key that the log still holds."""
    return log.where((F.col("key") == F.lit(key)) & (F.col("op") < RANGE_DELETE)).drop("end_key")


def delete_counts(log: DataFrame, seq: int | None = None) -> DataFrame:
    """cf, key and n_deletes: how many range deletes lie over each key that any point row names."""
    known = as_of(log, seq)
    keys = known.where(F.col("op") < RANGE_DELETE).select("cf", "key").distinct()
    return meeting(keys, range_deletes(known)).groupBy("cf", "key").agg(F.count("*").alias("n_deletes"))
