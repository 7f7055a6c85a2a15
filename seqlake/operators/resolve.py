"""What a log shows as of a sequence number: the newest version of each key, less what range deletes cover.

If the newest version of a key is covered by a later range delete, so are all older ones, as they are older
still. So each key is resolved to one row first, and only these rows are held against the range deletes.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.functions.placing import by_ranges
from seqlake.operators.mutations import PUT, RANGE_DELETE, payload

#: Range deletes that are broadcast and tested one by one; more are swept in key order, range by range.
MAX_BROADCAST_DELETES = 2_000


def as_of(log: DataFrame, seq: int | Column | None) -> DataFrame:
    return log if seq is None else log.where(F.col("seq") <= seq)


def points(log: DataFrame) -> DataFrame:
    return log.where(F.col("op") < RANGE_DELETE).drop("end_key")


def range_deletes(log: DataFrame) -> DataFrame:
    """cf, start_key, end_key, del_seq of the range deletes that can cover anything."""
    return log.where((F.col("op") == RANGE_DELETE) & (F.col("key") < F.col("end_key"))).select(
        F.col("cf").alias("d_cf"), F.col("key").alias("start_key"), F.col("end_key").alias("d_end"), F.col("seq").alias("del_seq")
    )


def newest(log: DataFrame) -> DataFrame:
    """The newest point row of each key. Each task passes on one row per key, so a hot key is no burden."""
    latest = Window.partitionBy("cf", "key").orderBy(F.desc("seq"))
    return points(log).withColumn("_age", F.row_number().over(latest)).where("_age = 1").drop("_age")


def _few(deletes: DataFrame) -> bool:
    return deletes.limit(MAX_BROADCAST_DELETES + 1).count() <= MAX_BROADCAST_DELETES


def _over() -> Column:
    return (F.col("cf") == F.col("d_cf")) & (F.col("key") >= F.col("start_key")) & (F.col("key") < F.col("d_end"))


def _dealt(rows: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows by key ranges, and each range delete once for each range that it meets."""
    ranged = by_ranges(rows, ["cf", "key"])
    bounds = ranged.groupBy("range_no").agg(F.min(F.struct("cf", "key")).alias("low"), F.max(F.struct("cf", "key")).alias("high"))
    # One row per shuffle partition.
    meets = (F.struct("d_cf", "d_end") > F.col("low")) & (F.struct("d_cf", "start_key") <= F.col("high"))
    return ranged, deletes.join(F.broadcast(bounds), meets).select(F.col("range_no").alias("d_range"), "d_cf", "start_key", "d_end", "del_seq")


def meeting(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """rows with each range delete over their key: start_key, d_end and del_seq; a row without one is left out."""
    if _few(deletes):
        return rows.join(F.broadcast(deletes), _over()).drop("d_cf")
    ranged, dealt = _dealt(rows, deletes)
    return ranged.join(dealt, (F.col("range_no") == F.col("d_range")) & _over()).drop("range_no", "d_range", "d_cf")


def covering(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """rows with cover_seq, the highest number of a range delete over the row's key; null if there is none."""
    if not _few(deletes):
        return _swept(rows, deletes)
    most = rows.select("cf", "key", "seq").join(F.broadcast(deletes), _over()).groupBy(
        F.col("cf").alias("c_cf"), F.col("key").alias("c_key"), F.col("seq").alias("c_seq")
    ).agg(F.max("del_seq").alias("cover_seq"))
    same = (F.col("cf") == F.col("c_cf")) & (F.col("key") == F.col("c_key")) & (F.col("seq") == F.col("c_seq"))
    return rows.join(most, same, "left").drop("c_cf", "c_key", "c_seq")


def _swept(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """covering() for many range deletes: each key range is swept once in key order, with the deletes that are open."""
    ranged, dealt = _dealt(rows, deletes)
    schema = T.StructType([*ranged.drop("range_no").schema.fields, T.StructField("cover_seq", T.LongType())])

    def sweep(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.drop(columns="range_no").sort_values(["cf", "key"], kind="stable")
        opening = sorted(zip(right["d_cf"], right["start_key"], right["d_end"], right["del_seq"], strict=True))
        active: list[tuple] = []  # (-number, family, end)
        cover, at = [], 0
        for cf, key in zip(left["cf"], left["key"], strict=True):
            while at < len(opening) and opening[at][:2] <= (cf, key):
                heapq.heappush(active, (-opening[at][3], opening[at][0], opening[at][2]))
                at += 1
            while active and (active[0][1] != cf or active[0][2] <= key):
                heapq.heappop(active)
            cover.append(-active[0][0] if active else None)
        return left.assign(cover_seq=pd.array(cover, dtype="Int64"))

    return ranged.groupBy("range_no").cogroup(dealt.groupBy("d_range")).applyInPandas(sweep, schema)


def uncovered(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """The rows that no later range delete covers."""
    return covering(rows, deletes).where(F.col("cover_seq").isNull() | (F.col("cover_seq") < F.col("seq"))).drop("cover_seq")


def view(log: DataFrame, seq: int | None = None) -> DataFrame:
    """cf, key, seq and the payload of each key that is visible as of seq (None: now)."""
    known = as_of(log, seq)
    shown = newest(known).where(F.col("op") == PUT)
    return uncovered(shown, range_deletes(known)).select("cf", "key", "seq", *payload(log))


def segments(deletes: DataFrame) -> DataFrame:
    """The range deletes as disjoint key ranges, each with the highest number over it: cf, low, high, del_seq.

    Neighbouring bounds make a range; bounds are dealt to key ranges, and what follows the last bound of one comes from a
    table of one row per key range. No bound lies within such a range, so a delete lies over it if it lies over its beginning.
    """
    bounds = deletes.select(F.col("d_cf").alias("cf"), F.explode(F.array("start_key", "d_end")).alias("low")).distinct()
    ranged = by_ranges(bounds, ["cf", "low"])
    least = F.min(F.struct("cf", "low")).alias("least")
    # One row per shuffle partition.
    after = ranged.groupBy(F.col("range_no").alias("of")).agg(least)
    after = after.select("of", F.lead("least").over(Window.orderBy("of")).alias("after"))
    here = F.lead(F.struct("cf", "low")).over(Window.partitionBy("range_no").orderBy("cf", "low"))
    following = ranged.withColumn("here", here).join(F.broadcast(after), F.col("range_no") == F.col("of")).withColumn("next", F.coalesce("here", "after"))
    parts = following.where("next.cf = cf").select("cf", F.col("low").alias("key"), F.col("next.low").alias("high"))
    return meeting(parts, deletes).groupBy("cf", F.col("key").alias("low"), "high").agg(F.max("del_seq").alias("del_seq"))
