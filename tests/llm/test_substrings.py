import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from seqlake.llm import substrings as S
from seqlake.llm.bytescan import hash_ranges, hash_runs, prefix_sums
from seqlake.llm.suffixes import repeated_across, repeated_within, suffix_array
from tests.llm import brute

SCHEMA = "doc_id long, text string, row string, n long, anchor string"


def got(spark, rows, size):
    docs = spark.createDataFrame([(i, t, "r", 1, "a") for i, t in rows], SCHEMA)
    found = S.remove_repeats(docs, size, ("doc_id", "n")).collect()
    return sorted(((r.row.doc_id, r.n_bytes, [(x.a, x.b) for x in r.removed], bytes(r.kept), r.kept_sha256) for r in found), key=str)


def expected(rows, size):
    out = []
    for (i, text), gone in zip(rows, brute.repeated_bytes([t for _, t in rows], size), strict=True):
        raw = (text or "").encode()
        flags = np.concatenate([[0], np.array(gone, dtype=np.int8), [0]])
        edges = np.flatnonzero(np.diff(flags)).tolist()
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), list(zip(edges[::2], edges[1::2], strict=True)), kept, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, size):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    passages = [noise(rng.randint(size - 3, 3 * size)) for _ in range(6)]
    rows = []
    for i in range(60):
        text = noise(rng.randint(0, 2 * size))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(passages)[rng.randint(0, 5) :] + noise(rng.randint(0, size))
        rows.append((i, text))
    base = noise(5 * size)
    for i in range(20):  # near copies
        at = rng.randrange(len(base))
        rows.append((100 + i, base[:at] + "Z" + base[at + 1 :]))
    rows += [(200, None), (201, ""), (202, "x" * (size - 1)), (203, "y" * size), (204, "z" * (4 * size)), (205, noise(4 * size) * 2)]
    return [*rows, rows[3], rows[3], (None, rows[7][1]), (206, base)]


@pytest.mark.parametrize(("seed", "size"), [(1, 40), (2, 25)])
def test_against_brute_force(spark, seed, size):
    rows = corpus(seed, size)
    assert got(spark, rows, size) == expected(rows, size)


def test_many_shards_and_hot_anchors(spark, monkeypatch):
    rows = corpus(3, 40)
    monkeypatch.setattr(S, "SHARD_BYTES", 200)
    assert got(spark, rows, 40) == expected(rows, 40)
    monkeypatch.setattr(S, "MAX_REGIONS", 1)
    assert got(spark, rows, 40) == expected(rows, 40)


def round_and_round():
    """Texts that repeat a line over and over, some cut or broken, and copies of them."""
    line = "the same line 0123456789 once more\n"
    rows = [(i, f"{i} " * (i % 3) + line * (2 + 3 * i)) for i in range(12)]
    rows += [(20, line * 9 + "!" + line * 9), (21, "q" * 300), (22, "q" * 55 + "r" + "q" * 300), (23, "ab" * 100)]
    return [*rows, rows[5], (30, rows[7][1]), (None, rows[9][1])]


def test_texts_that_go_round(spark, monkeypatch):
    rows = round_and_round()
    assert got(spark, rows, 40) == expected(rows, 40)
    monkeypatch.setattr(S, "MAX_REGIONS", 1)
    assert got(spark, rows, 40) == expected(rows, 40)


def test_one_row_for_a_region_of_a_document():
    texts = ["the same line 0123456789 once more\n" * 50, "q" * 3000, "ab" * 700, "no".join(map(str, range(400)))]
    columns = [pa.array(texts), pa.array(range(4)), pa.array(range(4))]
    rows = [r for b in S._find_runs(40)([pa.RecordBatch.from_arrays(columns, names=["text", "doc_id", "text_hash"])]) for r in b.to_pylist()]
    keys = [(r["doc_id"], r["anchor"], r["region"]) for r in rows]
    assert len(set(keys)) == len(keys)
    assert {k[0] for k in keys} == {0, 1, 2, 3}


def test_empty_table(spark):
    assert got(spark, [], 40) == []


@pytest.mark.parametrize("seed", range(20))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    strings = [rng.integers(0, rng.integers(1, 4), rng.integers(0, 30)).astype(np.uint8).tobytes() for _ in range(rng.integers(1, 8))] + [b"\0\1" * 9]
    strings.append(strings[0] * 2)
    data, offsets = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
    array = suffix_array(data, offsets)
    suffix = lambda p: data[p : p + array.left[p]].tobytes()
    in_order = [suffix(p) for p in array.order]
    assert in_order == sorted(in_order)

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905

    assert array.common.tolist() == [0, *(common(a, b) for a, b in zip(in_order, in_order[1:], strict=False))]
    starts = [suffix(p)[:3] for p in range(len(data))]
    assert repeated_within(array, 3).tolist() == [len(s) == 3 and starts.count(s) > 1 for s in starts]
    other = suffix_array(np.frombuffer(b"\0\1\1\2\0\1\0\0\2\1", np.uint8), np.array([0, 6, 10]))
    places = np.flatnonzero(array.left >= 3)
    inside = {b"\0\1\1", b"\1\1\2", b"\1\2\0", b"\2\0\1", b"\0\0\2", b"\0\2\1"}
    assert repeated_across(array, other, places, 3).tolist() == [starts[p] in inside for p in places]


def test_texts_are_scanned_for_runs_twice(spark):
    """Once to count anchors, in a job of its own, and once for all other uses, which share a shuffle where the tables are
    too large to be broadcast."""
    docs = spark.createDataFrame([(i, t, "r", 1, "a") for i, t in corpus(4, 40)], SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = S.remove_repeats(docs, 40)
        found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    last = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert last.count("MapInArrow") == 4  # runs, regions cut, arrays, removal


def test_small_scans_and_arrays(spark, monkeypatch):
    rows = corpus(5, 40)
    monkeypatch.setattr(S, "SCAN_BYTES", 50)
    monkeypatch.setattr(S, "PACK_BYTES", 300)
    assert got(spark, rows, 40) == expected(rows, 40)


def test_a_hash_of_each_run():
    data = np.frombuffer("runs of bytes, some of them runs of bytes é".encode(), np.uint8)
    start = np.arange(len(data) - 6)
    sums = prefix_sums(data, 1)
    assert hash_runs(sums, 7).tolist() == hash_ranges(sums, start, start + 7).tolist()


def test_suffix_arrays_of_long_repeats():
    """Many rounds of refinement: one byte over and over, periods, and copies."""
    strings = [b"a" * 700, b"ab" * 300, b"a" * 699 + b"b", b"a" * 700, b"", b"\0" * 50]
    data, offsets = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
    array = suffix_array(data, offsets)
    suffix = lambda p: data[p : p + array.left[p]].tobytes()
    keys = [(suffix(p), p) for p in array.order]
    assert keys == sorted(keys)
    common = [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for (a, _), (b, _) in zip(keys, keys[1:], strict=False)]
    assert array.common.tolist() == [0, *common]
