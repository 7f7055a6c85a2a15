"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents with equal sets are one class. For each class the rarest n-grams, as many as the size allows to
differ, are its prefix; two classes that link share an n-gram of both prefixes. Over the prefixes, shared
n-grams of each pair are counted, and pairs whose count is below the bound that their sizes imply are
discarded. The classes that survive together form blocks; in each block the product of the incidence matrix
with itself gives the exact overlaps, and so the links. Components of the links follow.

An n-gram in very many prefixes gives no pairs but puts its classes into the same block, so that no list of
documents is ever squared outside a block. Blocks are bounded. For components alone, a set of classes too
large for one block is first compared with one block of its own members, and only what is still unlinked with
the rest; to count links, every two of its blocks are compared, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.bytescan import LOWER, SPACE, blocks, find_words, hash_ranges, mixed, prefix_sums, window_hashes
from seqlake.llm.common import checkpointed, table
from seqlake.llm.components import connected_components

NGRAM = 5
PERCENT = 80
#: Prefix lists longer than this give no pairs, but join their classes for an exact comparison in blocks.
MAX_LIST = 64
#: Pairs that a task makes and passes on at a time.
PAIRS_AT_ONCE = 100_000
#: Classes and n-grams in one block, about.
BLOCK_CLASSES, BLOCK_GRAMS = 512, 1 << 19
#: Documents that hold a frequent n-gram, at least. Frequent n-grams come last in the prefixes, the rarer ones first,
#: which spares work; any choice of them gives the same links.
FREQUENT = 4
#: Frequent n-grams that are broadcast at most, those that most documents hold (16 bytes each).
MAX_FREQUENT = 1 << 18

def gram_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each document, sorted by document and hash, and where each document's begin.

    A document of fewer words than size, but not none, has its whole sequence as its only n-gram.
    """
    n = len(offsets) - 1
    lower = LOWER[data]
    words = find_words(lower, offsets, ~SPACE)
    h = hash_ranges(prefix_sums(lower), words.start, words.end)
    grams = window_hashes(h, size)
    whole = words.doc[: len(grams)] == words.doc[size - 1 :]
    doc, grams = [words.doc[: len(grams)][whole]], [grams[whole]]
    count = np.bincount(words.doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            doc.append(short)
            grams.append(window_hashes(h, k)[first[short]])
    doc, grams = np.concatenate(doc), np.concatenate(grams)
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(n + 1))


def least_overlap(n, percent: int):
    """The fewest common n-grams of a set of n with any that it links with: the share of n, rounded up."""
    return -(-percent * n // 100)


def set_sums(grams: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set that stand for it."""
    out = []
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        # The zero is of the same type: with a signed one the sums would become floats, and depend on what comes before.
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(grams * np.uint64(factor)), dtype=np.uint64)])
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out


def _encode(size: int, percent: int, frequent):
    """Per document: size of its set, two sums over it that stand for it, and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, held = frequent.value
        for batch in batches:
            out = {k: [] for k in ("n", "s1", "s2")}
            lists, lengths = [], [np.zeros(1, dtype=np.int64)]
            for block in blocks(batch.column(0)):
                grams, at = gram_sets(block.data, block.offsets, size)
                n = np.diff(at)
                doc = np.repeat(np.arange(len(n)), n)
                for name, sums in zip(("s1", "s2"), set_sums(grams, at), strict=True):
                    out[name].append(sums)
                out["n"].append(n)
                if len(often):
                    place = np.minimum(np.searchsorted(often, grams), len(often) - 1)
                    late = np.where(often[place] == grams, held[place], 0)
                    order = np.lexsort((grams, late, doc))
                    grams = grams[order]
                length = np.where(n > 0, n - least_overlap(n, percent) + 1, 0)
                within = np.arange(len(grams)) - at[:-1][doc]
                lists.append(grams[within < length[doc]].view(np.int64))
                lengths.append(length)
            offsets = np.cumsum(np.concatenate(lengths)).astype(np.int32)
            values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            columns = [np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in out.values()]
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, columns), prefix], names=["doc_id", *out, "prefix"])

    return run


def _counts(size: int, percent: int):
    """How many documents of a block hold each n-gram, of those that come first by hash: twice a prefix of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                grams, at = gram_sets(block.data, block.offsets, size)
                n = np.diff(at)
                within = np.arange(len(grams)) - np.repeat(at[:-1], n)
                early = within < np.repeat(2 * (n - least_overlap(n, percent) + 1), n)
                found, times = np.unique(grams[early], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["gram", "n"])

    return run


def _frequent(texts: DataFrame, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that most documents hold among those that come first in them, sorted, and how many do.

    Every document counts. Of n-grams held by equally many documents, all are taken or none.
    """
    counted = texts.select("text").mapInArrow(_counts(size, percent), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    often = checkpointed(counted.where(F.col("n") >= FREQUENT))
    # Numbers of documents that differ are few: at most the square root of twice their sum.
    levels = often.groupBy("n").agg(F.count("*").alias("grams")).orderBy(F.desc("n")).collect()
    within = [r["n"] for r, grams in zip(levels, accumulate(r["grams"] for r in levels), strict=True) if grams <= MAX_FREQUENT]
    found = often.where(F.col("n") >= within[-1]).collect() if within else []
    grams, held = (np.array([r[k] for r in found], dtype=np.int64) for k in ("gram", "n"))
    order = np.argsort(grams.view(np.uint64))
    return grams.view(np.uint64)[order], held[order]


def _candidates(percent: int):
    """From (gram, node, n) rows sorted by gram and node: pairs of classes whose sizes agree, or a star for a long list."""
    limit = MAX_LIST

    def pairs(gram: np.ndarray, node: np.ndarray, n: np.ndarray):
        edges, sizes = _lists(gram)
        for g in np.unique(sizes[sizes > 1]).tolist():
            i, j = np.triu_indices(g, 1)
            starts = edges[sizes == g]
            step = max(1, PAIRS_AT_ONCE // len(i))
            for s in range(0, len(starts), step):
                some = starts[s : s + step, None]
                yield (some + i).ravel(), (some + j).ravel()

    def emit(a, b, na, nb, star):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(na), pa.array(nb), pa.array(star)], names=["a", "b", "na", "nb", "star"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        hub = None  # (gram, node, n) of the list under way, if it is known to be long
        for batch in _with_end(batches):
            if batch is not None:
                got = [np.asarray(c) for c in batch.columns]
                if hub is not None:
                    more = np.searchsorted(got[0], hub[0], "right")
                    if more:
                        yield emit(np.full(more, hub[1]), got[1][:more], np.full(more, hub[2]), got[2][:more], np.ones(more, bool))
                        got = [x[more:] for x in got]
                    if not len(got[0]):
                        continue
                    hub = None
                held = [np.concatenate(x) for x in zip(held, got, strict=True)]
                if not len(held[0]):
                    continue
                tail = int(np.searchsorted(held[0], held[0][-1]))  # the last list may go on
            else:
                tail = len(held[0])
            gram, node, n = (x[:tail] for x in held)
            held = [x[tail:] for x in held]
            for lo, hi in _long_lists(gram, limit):
                yield emit(np.full(hi - lo - 1, node[lo]), node[lo + 1 : hi], np.full(hi - lo - 1, n[lo]), n[lo + 1 : hi], np.ones(hi - lo - 1, bool))
            short = _short(gram, limit)
            gram, node, n = gram[short], node[short], n[short]
            for i, j in pairs(gram, node, n):
                big, little = np.maximum(n[i], n[j]), np.minimum(n[i], n[j])
                ok = (100 * little >= percent * big) & (node[i] != node[j])
                i, j = i[ok], j[ok]
                if len(i):
                    yield emit(node[i], node[j], n[i], n[j], np.zeros(len(i), bool))
            if len(held[0]) > limit:
                hub = (held[0][0], held[1][0], held[2][0])
                k = len(held[0]) - 1
                yield emit(np.full(k, hub[1]), held[1][1:], np.full(k, hub[2]), held[2][1:], np.ones(k, bool))
                held = [x[:0] for x in held]

    return run


def _with_end(batches):
    yield from batches
    yield None


def _lists(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, int)
    return edges, np.diff(np.append(edges, len(gram)))


def _long_lists(gram: np.ndarray, limit: int) -> list[tuple[int, int]]:
    edges, sizes = _lists(gram)
    return [(int(e), int(e + s)) for e, s in zip(edges[sizes > limit], sizes[sizes > limit], strict=True)]


def _short(gram: np.ndarray, limit: int) -> np.ndarray:
    _, sizes = _lists(gram)
    return np.repeat((sizes > 1) & (sizes <= limit), sizes)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common elements of each pair of sorted sets: the incidence matrix times its transpose, some columns at a time."""
    m = len(sets)
    doc = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[column]
    number = np.cumsum(shared) - 1
    doc, column = doc[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    out = np.zeros((m, m), dtype=np.float32)
    width = max(256, (1 << 20) // max(1, m))
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((m, width), dtype=np.float32)
        part[doc[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def _near(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets link."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    common = overlaps(sets)
    near = np.zeros(common.shape, dtype=bool)
    for i in range(len(n)):
        both = common[i].astype(np.int64)
        near[i] = 100 * both >= percent * (n[i] + n - both)
    return near


def _spanning(node: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components within a block: each node with the smallest that it reaches."""
    order = np.argsort(node, kind="stable")
    root = np.full(len(node), -1, dtype=np.int64)
    for i in order.tolist():
        if root[i] >= 0:
            continue
        reached = near[i].copy()
        reached[i] = True
        front = reached.copy()
        while front.any():
            front = near[front].any(axis=0) & ~reached
            reached |= front
        root[reached] = i
    linked = root != np.arange(len(node))
    return node[linked], node[root[linked]]


def _compare(percent: int):
    """From (task, side, node, grams) rows sorted by task: the links within each task."""

    def links(rows) -> pa.RecordBatch | None:
        sets = [np.frombuffer(s, np.uint64) for _, _, s in rows]
        side = np.array([r[0] for r in rows])
        # Pairs are compared unless both are of side 0.
        a, b = _spanning(np.array([r[1] for r in rows], dtype=np.int64), _near(sets, percent) & (side[:, None] + side > 0))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for batch in batches:
            tasks, sides, nodes = (batch.column(i).to_pylist() for i in range(3))
            for i in range(batch.num_rows):
                if tasks[i] != task:
                    if len(rows) > 1 and (found := links(rows)):
                        yield found
                    task, rows = tasks[i], []
                rows.append((sides[i], nodes[i], batch.column(3)[i].as_py()))
        if len(rows) > 1 and (found := links(rows)):
            yield found

    return run


COUNTED = "a long, b long, s1 long, s2 long, n long, partners long"


def _count(percent: int):
    """From (task, side, node, s1, s2, n, copies, grams) rows sorted by task: the links that span the components
    within each task, and for each class the copies of those that it links with.

    A task has one side, whose pairs count, or two, of which the pairs across do.
    """

    def result(kept: dict) -> pa.RecordBatch:
        side, node, s1, s2, n, copies = (np.array(x, dtype=np.int64) for x in zip(*[(r[0], *key, r[1]) for key, r in kept.items()], strict=True))
        near = _near([np.frombuffer(r[2], np.uint64) for r in kept.values()], percent)
        near &= node[:, None] != node
        if side.min() < side.max():
            near &= side[:, None] != side
        a, b = _spanning(node, near)
        partners = (near @ copies.astype(np.float64)).astype(np.int64)
        of = np.flatnonzero((partners > 0) & (copies > 0))
        none, absent = pa.nulls(len(of), pa.int64()), pa.nulls(len(a), pa.int64())
        columns = [[a, none], [b, none], [absent, s1[of]], [absent, s2[of]], [absent, n[of]], [absent, partners[of]]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x, pa.int64()) for x in c]) for c in columns], names=["a", "b", "s1", "s2", "n", "partners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, kept = None, {}
        for batch in batches:
            tasks, *rows = (c.to_pylist() for c in batch.columns)
            for at, side, *key, copies, grams in zip(tasks, *rows, strict=True):
                if at != task:
                    if len(kept) > 1:
                        yield result(kept)
                    task, kept = at, {}
                # A row that repeats is here more than once.
                if (key := tuple(key)) not in kept or copies:
                    kept[key] = (side, copies, grams)
        if len(kept) > 1:
            yield result(kept)

    return run


def _linked(tasks: DataFrame, percent: int) -> DataFrame:
    parts = max(12, int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = tasks.select("task", "side", "node", "grams").repartition(parts, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(_compare(percent), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = NGRAM, percent: int = PERCENT, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, for each row of docs.

    With count_links also n_links: how many other documents link with it, copies among them. Where a doc_id has
    different texts, each of its sets has a count of its own and counts once for those that it links with.

    Two documents link when their sets of word n-grams have a Jaccard similarity of percent or more. Defined
    results: a text that is null or without words has an empty set and links with nothing; one of fewer words
    than size has its whole sequence as its only n-gram; rows that share a doc_id are one document; a null
    doc_id links with nothing, has a null component and no links; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("text").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    frequent = spark.sparkContext.broadcast(_frequent(texts, size, percent))
    schema = "doc_id long, n long, s1 long, s2 long, prefix array<long>"
    coded = checkpointed(texts.mapInArrow(_encode(size, percent, frequent), schema))
    one = coded.where("n > 0 and doc_id is not null")
    classes = one.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"), F.min_by("prefix", "doc_id").alias("prefix"))
    lists = classes.select(F.explode("prefix").alias("gram"), "node", "n")
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = lists.repartition(parts, "gram").sortWithinPartitions("gram", "node")
    found = dealt.mapInArrow(_candidates(percent), "a long, b long, na long, nb long, star boolean")
    counted = found.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"), F.max("star").alias("star"))
    possible = counted.where(F.col("star") | (F.col("common") >= _least_common(F.col("na"), F.col("nb"), percent))).select("a", "b")
    together = connected_components(possible).join(classes.select(F.col("node").alias("of"), "n"), F.col("node") == F.col("of")).drop("of")
    sizes = [F.count_distinct("doc_id").alias("copies")] if count_links else []
    nodes = coded.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"), *sizes)
    if count_links:
        nodes = checkpointed(nodes)
        links, partners = _counted_links(texts, checkpointed(together), nodes, size, percent)
    else:
        links = _exact_links(texts, checkpointed(together), size, percent)
    roots = connected_components(links)
    more = []
    if count_links:
        nodes = nodes.join(partners, ["s1", "s2", "n"], "left")
        more = [(F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("links")]
    placed = nodes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(
        F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n").alias("cn"), F.coalesce("root", "node").alias("component_id"), *more
    )
    same = (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") == F.col("cn"))
    return coded.join(placed, same, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        *([F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links")] if count_links else []),
    )


def _least_common(na: Column, nb: Column, percent: int) -> Column:
    """The fewest n-grams common to both prefixes that sizes na and nb allow in a pair that links.

    The overlap has to be percent / (100 + percent) of both sizes, and at most as many of it as one set
    has beyond its prefix can lie outside the prefixes.
    """
    overlap = F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent) - F.lit(1e-9))
    beyond = F.ceil(F.lit(percent) * F.greatest(na, nb) / F.lit(100) - F.lit(1e-9)) - 1
    return overlap - beyond


def _groups(together: DataFrame) -> DataFrame:
    """The number of blocks of each root; from the sizes alone, so that the sets move only to their blocks."""
    count = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int")
    return together.groupBy(F.col("root").alias("of")).agg(count.alias("blocks"))


def _counted_links(texts: DataFrame, together: DataFrame, nodes: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links that span the components, among the classes that together puts under one root, and s1, s2, n, partners:
    for each class (of nodes) that links, the copies of all classes that it links with.

    Each two blocks of a root meet in one task, so a block goes to as many tasks as its root has blocks.
    """
    names = ["node", "root", "blocks", "s1", "s2", "n", "copies"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                grams, at = gram_sets(block.data, block.offsets, size)
                node, root, count, *of, copies = (np.asarray(c.slice(block.first, block.last - block.first)) for c in batch.columns[1:])
                here = [*set_sums(grams, at), np.diff(at)]
                # Where a doc_id has different texts, only the one with the sums of the class stands for it.
                copies = np.where(np.all([x == y for x, y in zip(of, here, strict=True)], axis=0), copies, 0)
                sets = pa.array([grams[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, (node, root, count, *here, copies)), sets], names=[*names, "grams"])

    wanted = together.select("node", "root").distinct().join(_groups(together), F.col("root") == F.col("of"))
    wanted = wanted.join(nodes.withColumnRenamed("node", "class_node"), F.col("node") == F.col("class_node")).select(*names)
    joined = texts.join(wanted, F.col("doc_id") == F.col("node")).select("text", *names)
    sets = joined.mapInArrow(encode, "node long, root long, blocks int, s1 long, s2 long, n long, copies long, grams binary").where("n > 0")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    row = ["node", "s1", "s2", "n", "copies", "grams"]
    dealt = sets.withColumn("block", block).select("root", "block", every.alias("other"), *row).select(
        F.concat_ws(":", "root", F.least("block", "other"), F.greatest("block", "other")).alias("task"), (F.col("block") > F.col("other")).cast("int").alias("side"), *row
    )
    parts = max(12, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = checkpointed(dealt.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(_count(percent), COUNTED))
    partners = found.where("partners is not null").groupBy("s1", "s2", "n").agg(F.sum("partners").alias("partners"))
    return found.where("a is not null").select("a", "b"), partners


def _exact_links(texts: DataFrame, together: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that span the components, among the classes (node, n) that together puts under one root."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                grams, at = gram_sets(block.data, block.offsets, size)
                sets = pa.array([grams[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                rest = [c.slice(block.first, block.last - block.first) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*rest, sets], names=["node", "root", "blocks", "grams"])

    groups = _groups(together)
    wanted = together.join(groups, F.col("root") == F.col("of")).select("node", "root", "blocks")
    joined = texts.join(wanted, F.col("doc_id") == F.col("node")).select("text", "node", "root", "blocks")
    sets = checkpointed(joined.mapInArrow(encode, "node long, root long, blocks int, grams binary"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # Block 0 is compared with itself and with every other block, each of which is compared with itself too.
    where = F.when(block == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    tasks = sets.select(F.explode(where).alias("at"), "root", "node", "grams").select(
        F.concat_ws(":", "root", "at").alias("task"), F.lit(1).alias("side"), "node", "grams"
    )
    links = checkpointed(_linked(tasks, percent))
    large = sets.where("blocks > 1")
    if large.limit(1).count() == 0:
        return links
    # What the first comparison left apart from the largest linked part is compared with everything.
    roots = connected_components(links)
    state = large.select("root", "node", "blocks").join(roots.select(F.col("node").alias("n"), F.col("root").alias("part")), F.col("node") == F.col("n"), "left")
    state = checkpointed(state.select("root", "node", "blocks", F.coalesce("part", "node").alias("part")))
    sizes = state.groupBy("root", "part").agg(F.count("*").alias("c")).groupBy("root").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    apart = state.join(sizes.withColumnRenamed("root", "of"), F.col("root") == F.col("of")).where("part <> main")
    left = apart.groupBy(F.col("root").alias("left_of")).agg(F.ceil(F.count("*") / BLOCK_CLASSES).cast("int").alias("left_blocks"))
    cross = large.join(left, F.col("root") == F.col("left_of")).join(
        apart.select(F.col("node").alias("apart")), F.col("node") == F.col("apart"), "left"
    )
    by = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    by_left = F.pmod(F.xxhash64("node"), F.col("left_blocks")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rights = cross.select("root", "node", "grams", by.alias("r"), F.explode(every("left_blocks")).alias("l"), F.lit(0).alias("side"))
    lefts = cross.where("apart is not null").select("root", "node", "grams", F.explode(every("blocks")).alias("r"), by_left.alias("l"), F.lit(1).alias("side"))
    tasks = lefts.unionByName(rights).select(F.concat_ws(":", "root", "l", "r").alias("task"), "side", "node", "grams")
    return links.union(_linked(tasks, percent))


def drop_near_duplicates(docs: DataFrame, size: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The documents with the smallest doc_id of each component, and all without a doc_id, in the columns of docs.

    Of rows that repeat a doc_id one stays.
    """
    found = near_duplicates(docs, size, percent).select(F.col("doc_id").alias("n_id"), "component_id").distinct()
    keepers = found.where("n_id = component_id").select("n_id")
    kept = docs.join(keepers, F.col("doc_id").cast("long") == F.col("n_id"), "left_semi")
    return kept.dropDuplicates(["doc_id"]).union(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85, count_links=True)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS gram FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, root FROM r JOIN e ON e.a = r.doc_id WHERE root < e.b),
k AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id),
t AS (SELECT a AS doc_id, count(*)::BIGINT AS n_links FROM e GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""
