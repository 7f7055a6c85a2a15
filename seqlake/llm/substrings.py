"""Suffix-array dedup: removes every byte that a long string covers which also starts elsewhere.

The strings to judge are all windows of `size` bytes. To bring equal windows together without comparing all
shards with all, each window is owned by the smallest hash of the grams inside it (a winnowing anchor): equal
windows have the same anchor at the same place, so a shard that holds all regions around an anchor holds all
occurrences of the windows that it owns. Regions whose anchor is unique repeat nothing; equal regions are
counted as one. A document's runs of one region are one row, as a text that goes round repeats a region many
times. Rows are dealt by their anchor, and those of a very common anchor by parts of its regions too. The
different regions of an anchor go to shards of bounded size, whose suffix arrays and common prefixes tell the
repeated windows; an anchor that fills several shards is searched across them. An anchor with more regions than
a few shards hold is judged by hashes of its windows, one row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.bytescan import blocks, hash_ranges, hash_runs, mixed, prefix_sums
from seqlake.llm.common import checkpointed, table
from seqlake.llm.suffixes import repeated_across, repeated_within, suffix_array

SIZE = 400
#: Bytes of text in one suffix array.
SHARD_BYTES = 1 << 20
#: Bytes of text of several anchors that share one array: few enough for the array to stay in a core's cache.
PACK_BYTES = 1 << 16
#: Different regions of an anchor that go to suffix arrays; an anchor with more is judged by hashed windows.
MAX_REGIONS = 4096
#: Rows are dealt in parts of one in this many of all rows of shared anchors: a larger anchor is dealt to several, by its
#: regions. So at most this many anchors are broadcast, with the number of their parts (about 1 MB).
ANCHOR_PARTS = 1 << 16
#: Bytes of text that are scanned for anchors at once: few enough for their hashes to stay in a core's cache.
SCAN_BYTES = 1 << 17
#: Bits of a position within a block of documents.
PLACE_BITS = 32

ORACLE_SQL = None

SPANS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def gram_of(size: int) -> int:
    """Bytes of an anchor: long enough that chance and stock phrases seldom share one."""
    return max(1, size * 8 // 25)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key in each run of width keys, from least-so-far scans of blocks of that width."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(keys.dtype).max, dtype=keys.dtype)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored_runs(data: np.ndarray, offsets: np.ndarray, size: int):
    """Runs of windows with the same anchor: document, first window, number of windows, anchor hash, region hash.

    Windows count from the document's beginning. The region of a run spans all its windows; its hash also
    tells where the anchor lies in it.
    """
    gram = gram_of(size)
    if len(data) < size:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    low = np.uint64((1 << PLACE_BITS) - 1)
    grams = hash_runs(prefix_sums(data, 1), gram)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(keys, size - gram + 1) & low).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, dtype=np.int64)
    fits = np.flatnonzero(np.diff(offsets) >= size)
    np.add.at(valid, offsets[fits], 1)
    np.add.at(valid, offsets[fits + 1] - size + 1, -1)
    window = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    held = anchor[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = held[1:] != held[:-1]
    at = np.flatnonzero(new)
    first, count, held = window[at], np.diff(np.append(at, len(window))), held[at]
    sums = prefix_sums(data, 2)
    around = hash_ranges(sums, first, first + count - 1 + size) + mixed((held - first).astype(np.uint64))
    doc = np.searchsorted(offsets, first, "right") - 1
    return doc, first - offsets[doc], count, hash_ranges(sums, held, held + gram), mixed(around)


def gathered(doc: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, region: np.ndarray):
    """The runs of anchored_runs() with those of one region in one document together: document, first windows in order,
    number of windows of each run, anchor hash, region hash."""
    order = np.argsort(region ^ mixed(doc.astype(np.uint64)), kind="stable")
    doc, first, count, anchor, region = (x[order] for x in (doc, first, count, anchor, region))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (doc, count, anchor, region)])
    at = np.flatnonzero(new)
    firsts = pa.ListArray.from_arrays(np.append(at, len(order)).astype(np.int32), pa.array(first, pa.int64()))
    return doc[at], firsts, count[at], anchor[at], region[at]


def _find_runs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), SCAN_BYTES):
                doc, firsts, count, anchor, region = gathered(*anchored_runs(block.data, block.offsets, size))
                ids = [batch.column(i).take(pa.array(doc + block.first)) for i in (1, 2)]
                rest = [pa.array(x) for x in (count, anchor.view(np.int64), region.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*ids, firsts, *rest], names=["doc_id", "text_hash", "firsts", "n", "anchor", "region"])

    return run


def _cut_regions(size: int):
    """From texts with lists of regions: each region's bytes, or for hot anchors two hashes of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column(0)[row].as_py().encode()
                out = {k: [] for k in ("anchor", "region", "n", "bytes", "windows")}
                for part in batch.column(1)[row].as_py():
                    piece = raw[part["first"] : part["first"] + part["n"] - 1 + size]
                    windows = None
                    if part["hot"]:
                        data, start = np.frombuffer(piece, np.uint8), np.arange(part["n"])
                        pair = [hash_ranges(prefix_sums(data, seed), start, start + size).view(np.int64) for seed in (3, 4)]
                        windows = [{"h1": a, "h2": b} for a, b in zip(*(p.tolist() for p in pair), strict=True)]
                    for k, v in zip(out, (part["anchor"], part["region"], part["n"], None if part["hot"] else piece, windows), strict=True):
                        out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _runs_of(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": a, "b": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _judge(shards: list[list[tuple]], size: int) -> Iterator[tuple]:
    """(anchor, region, spans of repeated windows) of the regions in shards of one unit.

    Each shard has its own suffix array. If a unit has several, windows not yet found repeated are searched in
    the arrays of the other shards.
    """
    arrays, owned, found = [], [], []
    for rows in shards:
        offsets = np.cumsum([0, *(len(r[3]) for r in rows)])
        array = suffix_array(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), offsets)
        arrays.append(array)
        owned.append(np.concatenate([np.arange(o, o + r[2]) for o, r in zip(offsets[:-1], rows, strict=True)]))
        found.append(repeated_within(array, size))
    for i in range(len(arrays)):
        for j in range(len(arrays)):
            if i != j:
                open_ = owned[i][~found[i][owned[i]]]
                found[i][open_[repeated_across(arrays[i], arrays[j], open_, size)]] = True
    for rows, flags in zip(shards, found, strict=True):
        at = 0
        for anchor, region, n, piece in rows:
            spans = _runs_of(flags[at : at + n])
            at += len(piece)
            if spans:
                yield anchor, region, spans


def _judge_shards(size: int):
    """From (anchor, region, n, bytes) rows sorted by anchor: the repeated windows of each region."""

    def packed(found) -> Iterator[pa.RecordBatch]:
        rows = list(found)
        if rows:
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), _SPANS))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "region", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: list[list[tuple]] = [[]]  # of the unit under way; several only for one anchor
        filled = 0
        unit: list[tuple] = []  # the rows of the last anchor

        def close(whole: list[tuple]):
            """Split the rows of one anchor into shards."""
            out, used = [[]], 0
            for r in whole:
                if used + len(r[3]) > SHARD_BYTES and out[-1]:
                    out.append([])
                    used = 0
                out[-1].append(r)
                used += len(r[3])
            return out

        def rows():
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                yield from zip(*columns, strict=True)
            yield None

        for row in rows():
            if unit and (row is None or row[0] != unit[0][0]):
                weight = sum(len(r[3]) for r in unit)
                if weight > SHARD_BYTES:
                    yield from packed(_judge(close(unit), size))
                else:
                    if shards[0] and filled + weight > min(PACK_BYTES, SHARD_BYTES):
                        yield from packed(_judge(shards, size))
                        shards, filled = [[]], 0
                    shards[0] += unit
                    filled += weight
                unit = []
            if row is not None:
                unit.append(row)
        if shards[0]:
            yield from packed(_judge(shards, size))

    return run


def _merged(lists: pa.Array, size: int) -> dict[int, list[int]]:
    """Of each row that has any: where its maximal runs of covered bytes begin and end, by turns, from lists of lists of spans of
    windows."""
    inner = lists.flatten()
    spans = inner.flatten()
    row = pc.list_parent_indices(lists).to_numpy()[pc.list_parent_indices(inner).to_numpy()]
    a, b = (pc.struct_field(spans, k).to_numpy() for k in ("a", "b"))
    if not len(row):
        return {}
    b = b - 1 + size
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    reach = np.maximum.accumulate(b + row * (apart := int(b.max()) + 1))  # rows do not meet, so one scan serves all
    new = np.ones(len(row), dtype=bool)
    new[1:] = a[1:] + row[1:] * apart > reach[:-1]
    at = np.flatnonzero(new)
    row, a, b = row[at], a[at], reach[np.append(at[1:], len(reach)) - 1] - row[at] * apart
    first = np.flatnonzero(np.diff(row, prepend=-1))
    turns = np.stack([a, b], axis=1)
    return {r: x.ravel().tolist() for r, x in zip(row[first].tolist(), np.split(turns, first[1:]), strict=True)}


def _remove(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, kept = [], [], []
            edges = _merged(batch.column(1), size)
            for i in range(batch.num_rows):
                raw = (batch.column(0)[i].as_py() or "").encode()
                cuts = [0, *edges.get(i, ()), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                n_bytes.append(len(raw))
                removed.append([{"a": a, "b": b} for a, b in zip(cuts[1:-1:2], cuts[2:-1:2], strict=True)])
            columns = [batch.column(2), pa.array(n_bytes, pa.int64()), pa.array(removed, _SPANS), pa.array(kept, pa.binary())]
            columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept]))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_bytes", "removed", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, size: int = SIZE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of docs: `row` (a struct of the columns to keep), n_bytes, removed, kept and kept_sha256.

    removed holds the maximal removed runs of bytes, kept the other bytes, which need not be whole characters.
    Defined results: a null text is empty; a text shorter than size keeps everything; rows that repeat doc_id and
    text each lose what a string of size bytes covers, as it stands in the other row; ids may be null; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    long_ = texts.where(F.octet_length("text") >= size)
    # Columns that are never null get no filters of their own in some of the uses, so the shuffles stay alike.
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text_hash", T.LongType(), False),
            T.StructField("firsts", T.ArrayType(T.LongType(), False), False),
            *(T.StructField(c, T.LongType(), False) for c in ("n", "anchor", "region")),
        ]
    )
    runs = long_.mapInArrow(_find_runs(size), schema)
    times = F.sum(F.size("firsts"))
    counts = checkpointed(runs.groupBy("anchor").agg(times.alias("c"), F.count("*").alias("rows")).where("c > 1"))
    unit = (counts.agg(F.sum("rows")).first()[0] or 0) // ANCHOR_PARTS + 1
    n_parts = F.ceil(F.col("rows") / unit).cast("int")
    hot = F.broadcast(counts.where(F.col("rows") > unit).select(F.col("anchor").alias("hot"), n_parts.alias("hot_parts")))

    def dealt(df: DataFrame, anchor: str) -> DataFrame:
        """df with the parts of each row's anchor."""
        found = df.join(hot, F.col(anchor) == F.col("hot"), "left")
        return found.withColumn("parts", F.coalesce("hot_parts", F.lit(1))).drop("hot", "hot_parts")

    part = F.coalesce(F.pmod("region", "parts"), F.lit(0).cast("long")).alias("part")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))
    often = counts.select(F.col("anchor").alias("often"), n_parts.alias("parts")).select("often", every.alias("often_part"))
    # Used again below with the same columns, so that Spark shuffles the runs, and the texts, once.
    shared = dealt(runs, "anchor").select(*runs.columns, part).join(
        often, (F.col("anchor") == F.col("often")) & (F.col("part") == F.col("often_part")), "left_semi"
    )
    regions = shared.groupBy("anchor", "part", "region").agg(
        times.alias("c"), F.min(F.struct("doc_id", "text_hash", F.col("firsts")[0].alias("first"), "n")).alias("at")
    )
    # `at` is never null; asking keeps its columns here too, or else the texts would be scanned and their runs shuffled once more.
    kinds = regions.where("at is not null").groupBy(F.col("anchor").alias("of")).agg(F.count("*").alias("kinds")).where("kinds > 1")
    kinds = dealt(kinds, "of").select("of", "kinds", every.alias("of_part"))
    mixed_ = regions.join(kinds, (F.col("anchor") == F.col("of")) & (F.col("part") == F.col("of_part")))
    wanted = mixed_.groupBy(F.col("at.doc_id").alias("w_id"), F.col("at.text_hash").alias("w_hash")).agg(
        F.collect_list(F.struct("at.first", "at.n", "anchor", "region", (F.col("kinds") > MAX_REGIONS).alias("hot"))).alias("parts")
    )
    # Rows that repeat doc_id and text hold the same region; one of them is enough.
    held = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))).select("text", "parts")
    cut = held.mapInArrow(_cut_regions(size), "anchor long, region long, n long, bytes binary, windows array<struct<h1:long,h2:long>>")
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cold = cut.where("bytes is not null").select("anchor", "region", "n", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor", "region")
    by_array = cold.mapInArrow(_judge_shards(size), T.StructType([T.StructField("anchor", T.LongType()), T.StructField("region", T.LongType()), T.StructField("spans", SPANS)]))
    rows = cut.where("windows is not null").select("anchor", "region", F.posexplode("windows").alias("place", "w")).select("anchor", "region", "place", "w.*")
    twice = rows.distinct().groupBy(F.col("h1").alias("t1"), F.col("h2").alias("t2")).agg(F.count("*").alias("c")).where("c > 1")
    by_hash = rows.join(twice, (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2"))).groupBy("anchor", "region").agg(
        F.collect_set(F.struct(F.col("place").cast("long").alias("a"), (F.col("place") + 1).cast("long").alias("b"))).alias("spans")
    )
    whole = regions.where("c > 1").select("anchor", "region", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("at.n").alias("b"))).alias("spans"))
    judged = dealt(whole.unionByName(by_array).unionByName(by_hash), "anchor").select(
        F.col("anchor").alias("j_anchor"), part.alias("j_part"), F.col("region").alias("j_region"), "spans"
    )
    same = (F.col("anchor") == F.col("j_anchor")) & (F.col("part") == F.col("j_part")) & (F.col("region") == F.col("j_region"))

    def spans_at(first: Column) -> Column:
        return F.transform("spans", lambda s: F.struct((s["a"] + first).alias("a"), (F.least(s["b"], F.col("n")) + first).alias("b")))

    placed = shared.join(judged, same).select("doc_id", "text_hash", F.flatten(F.transform("firsts", spans_at)).alias("spans"))
    gone = placed.groupBy(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")).agg(F.collect_set("spans").alias("spans"))
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    if tuple(keep) == ("doc_id",):
        packed = texts.select("text", "doc_id", "text_hash")
    else:
        packed = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), row)
    joined = packed.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_hash") == F.col("g_hash")), "left")
    joined = joined.select("text", "spans", row if "row" not in joined.columns else F.col("row"))
    out = T.StructType([joined.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("removed", SPANS), T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(_remove(size), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"])
    return found.select("row.doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
