"""The log operators and the store against a plain model in Python."""

import random

import pytest

from seqlake.errors import InvalidArgument, NotFound
from seqlake.functions.keys import prefix_successor
from seqlake.operators import maintain, reads, resolve
from seqlake.operators.mutations import WriteBatch
from seqlake.sources.log_store import Backups, LogStore


class Model:
    """Every operation in a list; reads go through all of them."""

    def __init__(self):
        self.ops = []

    def batch(self, rng, n, cfs=("default", "other")):
        batch = WriteBatch()
        for _ in range(n):
            cf, key, end = rng.choice(cfs), b"%02d" % rng.randrange(40), b"%02d" % rng.randrange(40)
            kind = rng.random()
            if kind < 0.6:
                value = b"%d" % rng.randrange(1000)
                batch.put(key, value, cf)
                self.ops.append(("put", cf, key, value))
            elif kind < 0.85:
                batch.delete(key, cf)
                self.ops.append(("delete", cf, key, None))
            else:
                batch.delete_range(key, end, cf)
                self.ops.append(("range", cf, key, end))
        return batch

    def view(self, seq=None):
        shown = {}
        for kind, cf, key, other in self.ops[:seq]:
            if kind == "put":
                shown[cf, key] = other
            elif kind == "delete":
                shown.pop((cf, key), None)
            else:
                shown = {(c, k): v for (c, k), v in shown.items() if not (c == cf and key <= k < other)}
        return shown


def as_dict(view):
    return {(r.cf, bytes(r.key)): bytes(r.value) for r in view.collect()}


@pytest.fixture
def filled(spark, tmp_path):
    rng, model = random.Random(5), Model()
    store = LogStore.create(spark, f"{tmp_path}/log")
    marks = []
    for n in (30, 50, 0, 40):
        store.write(model.batch(rng, n))
        marks.append(store.snapshot())
    return store, model, marks


def test_views_and_snapshots(spark, filled):
    store, model, marks = filled
    assert marks == [30, 80, 80, 120]
    for seq in (None, 0, *marks):
        assert as_dict(store.view(seq)) == model.view(seq)
    again = LogStore(spark, store.path)
    assert as_dict(again.view()) == model.view()


def test_compaction_keeps_what_is_pinned(filled):
    store, model, marks = filled
    before = store.log().count()
    store.compact(pinned=(marks[0], 55))
    assert store.log().count() < before
    for seq in (marks[0], 55, None):
        assert as_dict(store.view(seq)) == model.view(seq)
    store.vacuum()
    store.compact()
    assert as_dict(store.view()) == model.view()
    assert store.last_sequence() == 120
    store.write(model.batch(random.Random(6), 20))
    assert as_dict(store.view()) == model.view() and store.last_sequence() == 140


def test_many_range_deletes_are_swept(filled, monkeypatch):
    store, model, marks = filled
    monkeypatch.setattr(resolve, "MAX_BROADCAST_DELETES", 0)
    for seq in (None, *marks):
        assert as_dict(store.view(seq)) == model.view(seq)
    kept = maintain.retained(store.log(), (marks[0],))
    assert as_dict(resolve.view(kept, marks[0])) == model.view(marks[0])


def test_copies(spark, filled, tmp_path):
    store, model, _ = filled
    backups = Backups(spark, f"{tmp_path}/backups")
    assert backups.create(store) == 1 and backups.create(store) == 2 and backups.list() == [1, 2]
    restored = backups.restore(2, f"{tmp_path}/restored")
    assert as_dict(restored.view()) == model.view()
    with pytest.raises(InvalidArgument):
        backups.restore(1, f"{tmp_path}/restored")
    backups.delete(1)
    backups.delete(9)
    with pytest.raises(NotFound):
        backups.restore(1, f"{tmp_path}/elsewhere")
    LogStore.destroy(spark, store.path)
    with pytest.raises(InvalidArgument):
        LogStore(spark, store.path)


def test_incomplete_commits_are_not_read(spark, filled):
    import os

    store, model, _ = filled
    os.remove(f"{store.path}/commit-0000000003/_SUCCESS")
    assert as_dict(store.view()) == model.view(80)
    assert store.vacuum() == ["commit-0000000003"]


def test_edges(spark, tmp_path):
    store = LogStore.create(spark, f"{tmp_path}/log", compression="lz4")
    assert store.view().count() == 0 and store.last_sequence() == 0
    batch = WriteBatch().put(b"", b"").put(b"\xff", b"v" * 1_000_000).put(b"k" * 10_000, b"1").put(b"a", b"1").delete_range(b"a", b"b").put(b"a\0", b"2")
    batch.delete_range(b"z", b"c")
    assert len(batch) == 7 and batch.approximate_size() > 1_000_000
    store.write(batch)
    shown = as_dict(store.view())
    assert sorted(k for _, k in shown) == [b"", b"a\0", b"k" * 10_000, b"\xff"] and shown["default", b""] == b""
    seen = []
    batch.visit(lambda cf, k, v: seen.append("p"), lambda cf, k: seen.append("d"), lambda cf, a, b: seen.append("r"))
    assert "".join(seen) == "ppppr" + "pr"
    assert [bytes(r.key) for r in reads.first(store.view(), 2).collect()] == [b"", b"a\0"]
    assert bytes(reads.last(store.view(), upper=b"\xff").first().key) == b"k" * 10_000
    assert {bytes(r.key) for r in reads.prefix_scan(store.log(), b"\xff").collect()} == {b"\xff"}
    with pytest.raises(InvalidArgument):
        LogStore(spark, f"{tmp_path}/log", compression="brotli")
    with pytest.raises(InvalidArgument):
        LogStore.create(spark, f"{tmp_path}/log")
    with pytest.raises(InvalidArgument):
        store.write(store.log())


def test_table_batches_are_numbered_in_order(spark, tmp_path):
    from pyspark.sql import functions as F

    store = LogStore.create(spark, f"{tmp_path}/log")
    rows = spark.range(1000).select(
        F.lit("default").alias("cf"), F.lit("k").cast("binary").alias("key"), F.lit(1).cast("tinyint").alias("op"), F.col("id").cast("string").cast("binary").alias("value"),
        F.lit(None).cast("binary").alias("end_key"), (-F.col("id")).alias("at"),
    )
    store.write(rows, ["at"])
    assert as_dict(store.view()) == {("default", b"k"): b"0"} and store.last_sequence() == 1000
    assert as_dict(store.view(1)) == {("default", b"k"): b"999"}


def test_pins_ranges_and_repair(spark, filled, tmp_path):
    store, model, marks = filled
    assert store.oldest_sequence() is None and store.pins() == []
    pin = store.pin()
    store.write(model.batch(random.Random(9), 30))
    later = store.pin()
    assert (store.oldest_sequence(), len(store.pins()), store.get_property("num-snapshots")) == (120, 2, 2)
    store.write(model.batch(random.Random(10), 30))
    before = store.log().count()
    store.compact_range(b"10", b"30")
    assert store.log().count() < before and store.last_sequence() == 180
    store.compact()
    for seq in (pin.sequence, later.sequence, None):
        assert as_dict(store.view(seq)) == model.view(seq)
    store.release(pin)
    store.release(pin)
    assert store.oldest_sequence() == 150
    store.compact()
    store.vacuum()
    assert as_dict(store.view(150)) == model.view(150) and as_dict(store.view()) == model.view()
    with open(next((tmp_path / "log").glob("base-*/*.parquet")), "r+b") as broken:
        broken.truncate(20)
    # What an unreadable file deleted may show again; every row shown was written once.
    kept = as_dict(LogStore.repair(spark, store.path, f"{tmp_path}/mended").view())
    assert kept and kept.items() <= {((cf, key), value) for kind, cf, key, value in model.ops if kind == "put"}
    assert store.get_property("nothing") is None and store.get_property("num-folders") == 1


def test_declared_families(spark, filled):
    store, _, _ = filled
    LogStore(spark, store.path, families=["other"])
    with pytest.raises(InvalidArgument):
        LogStore(spark, store.path, families=[])


@pytest.mark.parametrize(
    ("prefix", "after"),
    [(b"a", b"b"), (b"a\xff", b"b"), (b"\xff", None), (b"", None), (b"\x00", b"\x01"), ("a", "b"), ("", None), ("a" + chr(0xD7FF), "a" + chr(0xE000)), ("x" + chr(0x10FFFF), "y")],
)
def test_prefix_successor(prefix, after):
    assert prefix_successor(prefix) == after
