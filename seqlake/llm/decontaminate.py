"""Benchmark decontamination: a broadcast hash set of test windows, scanned over all training tokens.

The windows of the benchmark (ten words, or a shorter item whole) are hashed and broadcast, which is done only
within a stated size; a larger benchmark is scanned piece by piece, and a piece's broadcast is gone before the
next one is made. Each task hashes every window of its documents, looks the hashes up, and verifies the words of
each different hit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.bytescan import ALNUM, LOWER, blocks, find_words, hash_ranges, prefix_sums, window_hashes
from seqlake.llm.common import checkpointed, row_struct, table, text_or_empty

WINDOW = 10
#: UTF-8 bytes of benchmark text in one broadcast; the windows take about twelve times as much memory.
MAX_BROADCAST_BYTES = 16 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class Windows:
    """The windows of some benchmark items, by length: sorted hashes, and the items of each window's words."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW):
        self.by_length: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        hashes: dict[int, set[int]] = defaultdict(set)
        texts = pa.array([text for _, text in items], pa.large_string())
        for block in blocks(texts):
            lower = LOWER[block.data]
            words = find_words(lower, block.offsets, ALNUM)
            each = hash_ranges(prefix_sums(lower), words.start, words.end)
            for i in range(block.last - block.first):
                a, b = np.searchsorted(words.doc, (i, i + 1))
                k = min(size, int(b - a))
                if k == 0:
                    continue
                spelt = [lower[s:e].tobytes() for s, e in zip(words.start[a:b], words.end[a:b], strict=True)]
                for j in range(len(spelt) - k + 1):
                    known = self.by_length[k][b" ".join(spelt[j : j + k])]
                    if (item := items[block.first + i][0]) is not None:
                        known.add(item)
                hashes[k].update(window_hashes(each[a:b], k).tolist())
        self.by_length = {k: dict(v) for k, v in self.by_length.items()}
        self.hashes = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in hashes.items()}

    def hits(self, lower: np.ndarray, words) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[set[str]]]]:
        """For each window length: the first words of the occurrences, which known window each is, and the windows' items.

        Words are counted in the block. Occurrences with two equal hashes are one window, whose words are compared once.
        """
        if not len(words.start):
            return
        each = hash_ranges(prefix_sums(lower), words.start, words.end)
        other = None
        for k, known in self.hashes.items():
            found = window_hashes(each, k)
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            likely = np.flatnonzero((known[at] == found) & (words.doc[: len(found)] == words.doc[k - 1 :]))
            if not len(likely):
                continue
            if other is None:
                other = hash_ranges(prefix_sums(lower, 2), words.start, words.end)
            first, second = found[likely], window_hashes(other, k)[likely]
            order = np.lexsort((second, first))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
            which = np.empty(len(order), dtype=np.int64)
            which[order] = np.cumsum(new) - 1
            items = []
            for i in likely[order[new]].tolist():
                spelt = b" ".join(lower[s:e].tobytes() for s, e in zip(words.start[i : i + k], words.end[i : i + k], strict=True))
                items.append(self.by_length[k].get(spelt))
            right = np.array([x is not None for x in items])[which]
            yield k, likely[right], which[right], items


SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def _block_hits(windows: Windows, lower: np.ndarray, words, n_docs: int) -> tuple[dict, dict]:
    """Spans (in words of the document) and items of the documents of a block that have any."""
    covered = np.zeros(len(words.start) + 1, dtype=np.int64)
    items: dict[int, set] = defaultdict(set)
    for k, first, which, known in windows.hits(lower, words):
        np.add.at(covered, first, 1)
        np.add.at(covered, first + k, -1)
        pairs = np.unique(words.doc[first] * len(known) + which)
        for doc, w in zip((pairs // len(known)).tolist(), (pairs % len(known)).tolist(), strict=True):
            items[doc] |= known[w]
    hit = np.cumsum(covered[:-1]) > 0
    if not hit.any():
        return {}, {}
    origin = np.searchsorted(words.doc, np.arange(n_docs))
    edge = np.flatnonzero(hit & (np.append(True, ~hit[:-1] | (words.doc[1:] != words.doc[:-1]))))
    last = np.flatnonzero(hit & np.append(~hit[1:] | (words.doc[1:] != words.doc[:-1]), True)) + 1
    spans: dict[int, list] = defaultdict(list)
    for a, b in zip(edge.tolist(), last.tolist(), strict=True):
        doc = int(words.doc[a])
        spans[doc].append((a - int(origin[doc]), b - int(origin[doc])))
    return spans, items


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """A document's text without the words of the spans; start and end are those of its words."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at : start[a]].tobytes())
        at = end[b - 1]
    return b"".join([*kept, data[at:].tobytes()]).decode()


def _scan(shared, cut: bool = False):
    """A task's scan of (text, before, rest): the rest, with the findings joined with those of earlier pieces, and the text left if asked for."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        for batch in batches:
            before = batch.column(1).to_pylist()
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[list] = [[] for _ in range(batch.num_rows)]
            left = batch.column(0).to_pylist() if cut else None
            for block in blocks(batch.column(0)):
                lower = LOWER[block.data]
                words = find_words(lower, block.offsets, ALNUM)
                n = block.last - block.first
                n_words[block.first : block.last] = np.bincount(words.doc, minlength=n)
                here, which = _block_hits(windows, lower, words, n)
                old = {i for i in range(n) if before[block.first + i]}
                for doc in sorted(here.keys() | old):
                    row = block.first + doc
                    earlier = before[row] or {"spans": [], "items": []}
                    spans[row] = _merged(here.get(doc, []) + [(x["begin"], x["end"]) for x in earlier["spans"]])
                    items[row] = sorted(which.get(doc, set()) | set(earlier["items"]))
                    if cut:
                        a, b = np.searchsorted(words.doc, (doc, doc + 1))
                        start, stop = block.offsets[doc], block.offsets[doc + 1]
                        left[row] = _cut(block.data[start:stop], words.start[a:b] - start, words.end[a:b] - start, spans[row])
            columns = [pa.array(n_words), pa.array([[{"begin": a, "end": b} for a, b in x] for x in spans], pa.list_(SPAN)), pa.array(items, pa.list_(pa.string()))]
            found = pa.StructArray.from_arrays(columns, names=FOUND.names)
            more = [(pa.array(left, pa.string()), "left")] if cut else []
            rest = [(batch.column(i), batch.schema.names[i]) for i in range(2, batch.num_columns)]
            out = [*rest, (found, "found"), *more]
            yield pa.RecordBatch.from_arrays([c for c, _ in out], names=[n for _, n in out])

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = WINDOW, cut: bool = False) -> DataFrame:
    """Per row of docs: `row`, a struct of the columns to keep, and `found` with n_words, spans (words) and items; with
    cut also `left`, the text without the words of the spans (from the first word's beginning to the last one's end).

    items are the ids as strings, in order. Defined results: a null text has no words, and stays null; an item without
    words has no windows; an item with a null id has hits, but no id to list; rows may repeat and each is judged;
    columns to keep may have any names; an empty table on either side gives no hits.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), text_or_empty("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = max(1, -(-total // MAX_BROADCAST_BYTES))

    def broadcast(piece: int):
        # One piece at a time, each within the bound, comes to the driver.
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(pieces)) == piece).collect()
        return spark.sparkContext.broadcast(Windows([(x["id"], x["text"]) for x in part], size))

    keys = [F.col("doc_id").cast("long").alias("key"), F.xxhash64(text_or_empty("text")).alias("text_hash")]
    nothing = F.lit(None).cast(FOUND).alias("before")
    packed = docs.select("text", nothing, row_struct(docs, list(keep)), *keys)
    parts = []
    for piece in range(pieces - 1):
        shared = broadcast(piece)
        plain = packed.select("text", "before", "key", "text_hash")
        schema = T.StructType([*plain.schema.fields[2:], T.StructField("found", FOUND)])
        hits = plain.mapInArrow(_scan(shared), schema).where(F.size("found.spans") > 0)
        parts.append(checkpointed(hits.dropDuplicates(["key", "text_hash"])))
        shared.destroy()
    if parts:
        every = reduce(DataFrame.unionByName, parts).groupBy(F.col("key").alias("k"), F.col("text_hash").alias("h")).agg(
            F.struct(F.max("found.n_words").alias("n_words"), F.flatten(F.collect_list("found.spans")).alias("spans"), F.flatten(F.collect_list("found.items")).alias("items")).alias("earlier")
        )
        packed = packed.join(every, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left").withColumn("before", F.col("earlier"))
    packed = packed.select("text", "before", "row")
    schema = T.StructType([packed.schema["row"], T.StructField("found", FOUND), *([T.StructField("left", T.StringType())] if cut else [])])
    return packed.mapInArrow(_scan(broadcast(pieces - 1), cut), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a window of the benchmark, in the columns of docs; those with null or empty texts stay."""
    found = find_contamination(docs, benchmark, tuple(docs.columns))
    return found.where(F.size("found.spans") == 0).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents in the columns of docs, with the words of the hits cut out of the text; null texts stay null."""
    found = find_contamination(docs, benchmark, tuple(docs.columns), cut=True)
    return found.select(*[(F.col("left") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document against every item. Null texts have no words; an empty benchmark contaminates nothing."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return found.select(
        "row.doc_id",
        "found.n_words",
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH low AS (SELECT 'd' AS side, doc_id AS id, NULL AS item, text FROM documents
             UNION ALL SELECT 'b', row_number() OVER (), item_id::VARCHAR, text FROM benchmark),
w AS (SELECT side, id, item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
b AS (SELECT item, least(10, len(ws)) AS k, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM w WHERE side = 'b' AND len(ws) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM b),
ks AS (SELECT DISTINCT k FROM bw),
d AS (SELECT id AS doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE side = 'd' AND len(ws) >= k),
h AS (SELECT doc_id, i, d.k, item FROM (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM d) d JOIN bw ON d.k = bw.k AND d.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list_distinct(list(item))) AS items FROM h WHERE item IS NOT NULL GROUP BY doc_id)
SELECT w.id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n ON w.id = n.doc_id LEFT JOIN i ON w.id = i.doc_id WHERE side = 'd'
"""
