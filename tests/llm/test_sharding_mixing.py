import random
import zlib
from collections import Counter, defaultdict

import pytest

from seqlake.llm import mixing as M
from seqlake.llm import sharding as S
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, shard string, target string, bucket string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z", "w") for i, t, s in rows], SCHEMA)


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    rows = [(i, "é " * rng.randint(0, 60), rng.choice(["hot", "hot", "b", "ä", None, "tiny" if i < 3 else "c"])) for i in range(n)]
    return [*rows, (9001, None, "b"), (9002, "", "empty"), (9003, "w " * 200_000, "b"), (5, rows[5][1], rows[5][2]), (None, "a b", "b")]


def test_shards(spark, monkeypatch):
    rows = corpus()
    run = lambda: S.external_shuffle(frame(spark, rows), 16, 1, 3000)
    got = run().collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    place = lambda g: sorted(((r.doc_id, r.text, r.shard, r.slot) for r in g), key=str)
    assert place(run().collect()) == place(got)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard)) if r.doc_id is not None and r.doc_id < 400]
    rising = sum(a < b for a, b in zip(order, order[1:], strict=False)) / len(order)
    assert 0.4 < rising < 0.6
    assert S.external_shuffle(frame(spark, [])).count() == 0
    monkeypatch.setattr(S, "table", lambda *a: frame(spark, rows))
    for r in S.query(spark, "").collect():
        assert r.law == "rows" and r.grown_shard is None and r.size >= 1
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in S.query(spark, "").collect()}
    assert sizes[9001] == (1, 0) and sizes[9003] == (400_001, zlib.crc32(b"w " * 200_000))


def test_repeated_rows_are_spread(spark, monkeypatch):
    """Rows that are equal, or equal in doc_id and text, do not meet in one bucket; the result stays the same from run to run."""
    rows = [(None, "same", "a.b", i % 2) for i in range(600)] + [(i, f"text {i}", "x", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `source.of` string, row int")
    sizes = []
    offsets = S._offsets
    monkeypatch.setattr(S, "_offsets", lambda counts: sizes.extend(r.n for r in counts.collect()) or offsets(counts))
    monkeypatch.setattr(S, "MAX_PARTITIONS", 3)  # several buckets to a partition
    run = lambda d: sorted(((r.doc_id, r.text, r["source.of"], r["row"], r.shard, r.slot) for r in S.external_shuffle(d, 7, 1, 3000).collect()), key=str)
    got = run(docs)
    assert sum(sizes) == 900 and max(sizes) < 150
    assert Counter(r[:4] for r in got) == Counter(rows)
    counts = Counter(r[4] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and all(sorted(r[5] for r in got if r[4] == s) == list(range(n)) for s, n in counts.items())
    assert run(docs.repartition(5)) == got


def test_written_shards(spark, tmp_path):
    S.write_shards(S.external_shuffle(frame(spark, corpus()), 4), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(corpus())


def fill(sizes, share=1.5, cap=2):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        rest = share * sum(sizes.values()) - sum(target.values())
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: rest * weight[s] / total for s in free}
        target |= {s: cap * sizes[s] for s in over}
        free -= over


def multiple(rows, goal, cap=2):
    """The multiple of the weights at which the copies, none above cap, of (size, weight) rows add up to goal."""
    full = set()
    while True:
        units = sum(s * w for i, (s, w) in enumerate(rows) if i not in full)
        level = (goal - sum(cap * rows[i][0] for i in full)) / units if units else float("inf")
        over = {i for i, (s, w) in enumerate(rows) if w and level * w > cap}
        if over <= full:
            return level
        full |= over


@pytest.mark.parametrize("weight", [None, "w"])
def test_mix(spark, weight):
    rows = corpus(3000)
    docs = frame(spark, rows)
    if weight:
        from pyspark.sql import functions as F

        docs = docs.withColumn("w", F.when(F.col("doc_id") % 3 == 0, 4.0).when(F.col("doc_id") % 3 == 1, 1.0))
    # At a share of 1.5 the source "hot" has to give each document twice, whatever its weight; at 0.1 the weights decide.
    share_ = 0.1 if weight else 1.5
    got = M.mix(docs, share=share_, weight=weight).select("row.doc_id", "row.source", "size", "source_size", "target", "copies_taken", "taken").collect()
    assert len(got) == len(rows)
    sizes, taken, largest, parts = Counter(), Counter(), defaultdict(int), defaultdict(list)
    w = lambda r: 4.0 if weight and (r.doc_id is not None and r.doc_id % 3 == 0) else 1.0
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies_taken * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        parts[r.source].append(r)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(brute.WORD.findall(t or ""))) for i, t, _ in rows)
    expected = fill(dict(sizes), share_)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6 * max(1, r.target)
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= largest[s]
        # Each document has the whole copies of its inclusion odds, or one more, and those of a weight add up to about their share.
        level = multiple([(r.size, w(r)) for r in parts[s]], expected[s]) if sizes[s] else 0
        for k in (1.0, 4.0):
            some = [r for r in parts[s] if w(r) == k and r.size]
            copies = min(2.0, level * k)
            assert all(int(copies) <= r.copies_taken <= min(2, int(copies) + 1) for r in some)
            words = sum(r.size for r in some)
            if len(some) > 200 and max(r.size for r in some) < 0.05 * words:
                assert abs(sum(r.taken for r in some) / words - copies) < 0.1
    again = M.mix(docs.repartition(3), share=share_, weight=weight).select("row.doc_id", "taken").collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    if weight:
        share = lambda k: sum(r.taken for r in got if r.source == "hot" and (r.doc_id or 0) % 3 == k) / sum(r.size for r in got if r.source == "hot" and (r.doc_id or 0) % 3 == k)
        assert share(0) > share(1)


def test_odd_weights(spark):
    """Null counts as 1; below 0 and NaN never; where all that may be taken is at the limit, the source stays below its target."""
    rows = [(i, "a b c", s, w) for i, (s, w) in enumerate([("a", None), ("a", 0.0), ("a", -1.0), ("a", float("nan")), ("b", 0.0), ("b", 0.0)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    got = {r.doc_id: r.copies_taken for r in M.mix(docs, weight="w").select("row.doc_id", "copies_taken").collect()}
    assert got == {0: 2, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}


@pytest.mark.parametrize("seed", range(3))
def test_targets_fill_up_again(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}" if i else None: rng.choice([0, 1, rng.randint(1, 100), rng.randint(900, 1100)]) for i in range(30)}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(table).collect()}
    assert got == pytest.approx(fill(sizes))


def test_mixed_corpus(spark):
    docs = frame(spark, corpus()).withColumnRenamed("bucket", "copies_taken").withColumnRenamed("shard", "a.b")
    mixed = M.mixed_corpus(docs)
    assert mixed.schema == docs.schema
    want = Counter()
    for r in M.mix(docs).select("row.doc_id", "row.text", "copies_taken").collect():
        want[r.doc_id, r.text] += r.copies_taken
    rows = mixed.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == +want
    assert all((r["a.b"], r.target, r["copies_taken"], r.size) == ("x", "y", "z", "w") for r in rows)
    assert M.mixed_corpus(frame(spark, [])).count() == 0
    assert all(r.taken == 0 for r in M.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect())
