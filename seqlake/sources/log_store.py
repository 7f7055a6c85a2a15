"""A mutation log kept as Parquet: one folder per commit, compacted into base folders.

A commit is a folder that Spark's writer has marked complete, so a reader sees a batch whole or not at all. A
base holds what a compaction retained of all commits up to its number, and stands for them. Beside its rows a
folder has the highest number that the store had given with it, so that no write reads the log to number its rows.
Pinned states are empty files in a folder of their own. Paths may be in any store that Hadoop reads. There is one
writer at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqlake.errors import InvalidArgument, NotFound
from seqlake.functions.keys import in_range
from seqlake.operators.maintain import retained
from seqlake.operators.mutations import DEFAULT_FAMILY, LOG_SCHEMA, RANGE_DELETE, WriteBatch, in_sequence
from seqlake.operators.resolve import view

#: A base has the number of the last commit that it stands for, and a generation.
_FOLDER = re.compile(r"(commit|base)-(\d{10})(?:\.(\d{6}))?")
COMPRESSION = ("none", "snappy", "lz4", "zstd")
_LAST, _PINS, _PIN = "_LAST", "_pins", re.compile(r"(\d{20})-(\w+)")


class Pin(NamedTuple):
    """A state that compactions keep until it is released."""

    sequence: int
    name: str


class LogStore:
    """Open a log folder; see create() for a new one. With families, one that holds rows of others is not opened."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType = LOG_SCHEMA, compression: str = "zstd", families: Sequence[str] | None = None):
        if compression not in COMPRESSION:
            raise InvalidArgument(f"compression {compression!r} is none of {', '.join(COMPRESSION)}")
        self.spark, self.path, self.schema, self.compression = spark, path.rstrip("/"), schema, compression
        if not self._exists(self.path):
            raise InvalidArgument(f"there is no log at {path}")
        if families is not None:
            other = self.log().where(~F.col("cf").isin(DEFAULT_FAMILY, *families)).select("cf").first()
            if other:
                raise InvalidArgument(f"the log holds the family {other['cf']!r}, which is not among those named")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType = LOG_SCHEMA, exist_ok: bool = False, **options) -> LogStore:
        fs, where = cls._at(spark, path)
        if fs.exists(where) and not exist_ok:
            raise InvalidArgument(f"there is a log at {path} already")
        fs.mkdirs(where)
        return cls(spark, path, schema, **options)

    @classmethod
    def destroy(cls, spark: SparkSession, path: str) -> None:
        """Delete a log with all that it holds; nothing happens if it is not there."""
        fs, where = cls._at(spark, path)
        fs.delete(where, True)

    @staticmethod
    def _at(spark: SparkSession, path: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._at(self.spark, path)
        return fs.exists(where)

    def _folders(self) -> list[tuple[str, int, str]]:
        """The complete folders, as (kind, number, name), in order."""
        fs, where = self._at(self.spark, self.path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(where))
        return [(m[1], int(m[2]), n) for n in names if (m := _FOLDER.fullmatch(n)) and self._exists(f"{self.path}/{n}/_SUCCESS")]

    def _last_commit(self) -> int:
        return max((n for _, n, _ in self._folders()), default=0)

    def _live(self) -> list[str]:
        """The folders to read: the last base, and the commits after it."""
        folders = self._folders()
        base = max(((n, name) for kind, n, name in folders if kind == "base"), default=(-1, ""))
        return [base[1]] * (base[0] >= 0) + [name for kind, n, name in folders if kind == "commit" and n > base[0]]

    def log(self) -> DataFrame:
        """All rows that the store holds now; later commits do not change the DataFrame."""
        live = [f"{self.path}/{name}" for name in self._live()]
        if not live:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*live).select(*self.schema.names)

    def _last_of(self, folder: str) -> int:
        """The highest number when the folder was written; from its rows, if the writer stopped before it noted the number."""
        fs, where = self._at(self.spark, f"{self.path}/{folder}/{_LAST}")
        if fs.exists(where):
            stream = fs.open(where)
            try:
                return stream.readLong()
            finally:
                stream.close()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").agg(F.max("seq")).first()[0] or 0

    def _note_last(self, folder: str, last: int) -> None:
        fs, where = self._at(self.spark, f"{self.path}/{folder}/{_LAST}")
        stream = fs.create(where, True)
        stream.writeLong(last)
        stream.close()

    def last_sequence(self) -> int:
        """The highest number given, which a read of the folders' notes tells."""
        return max((self._last_of(name) for name in self._live()), default=0)

    def view(self, seq: int | None = None) -> DataFrame:
        return view(self.log(), seq)

    def _save(self, rows: DataFrame, name: str, least: int = 0) -> None:
        """Sorted within families and key ranges, so that scans of a family or range skip the rest; least: a number given before."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.select(*self.schema.names).repartitionByRange(parts, "cf", "key").sortWithinPartitions("cf", "key", F.desc("seq"))
        ordered.write.mode("overwrite").option("compression", self.compression).parquet(f"{self.path}/{name}")
        self._note_last(name, max(least, self._last_of(name)))

    def commit_as(self, number: int, rows: DataFrame) -> None:
        """Commit rows under a number of the caller's, in place of an earlier try."""
        self._save(rows, f"commit-{number:010d}")

    def append(self, rows: DataFrame) -> int:
        """Commit rows that have their numbers already; returns the commit's number."""
        number = self._last_commit() + 1
        self.commit_as(number, rows)
        return number

    def write(self, batch: WriteBatch | DataFrame, order: Sequence[Column | str] = ()) -> None:
        """Number the operations of a batch after the last one, in order, and commit them together.

        A table needs the columns to order by. An empty batch changes nothing.
        """
        last = self.last_sequence()
        if isinstance(batch, WriteBatch):
            if len(batch):
                self.append(batch.to_df(self.spark, last))
            return
        if not order:
            raise InvalidArgument("a table needs columns to order its operations by")
        if not batch.isEmpty():
            self.append(in_sequence(batch, order, last))

    def snapshot(self) -> int:
        """The number to read at for the present state; see pin() to keep it through compactions."""
        return self.last_sequence()

    def pin(self) -> Pin:
        """Keep the present state readable, at the pin's sequence, until release()."""
        pin = Pin(self.last_sequence(), uuid.uuid4().hex)
        fs, where = self._at(self.spark, f"{self.path}/{_PINS}/{pin.sequence:020d}-{pin.name}")
        fs.create(where, True).close()
        return pin

    def release(self, pin: Pin) -> None:
        """Let the next compaction forget a pinned state; nothing happens if it is released already."""
        fs, where = self._at(self.spark, f"{self.path}/{_PINS}/{pin.sequence:020d}-{pin.name}")
        fs.delete(where, False)

    def pins(self) -> list[Pin]:
        """The states that are pinned now, the oldest first."""
        fs, where = self._at(self.spark, f"{self.path}/{_PINS}")
        names = sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
        return [Pin(int(m[1]), m[2]) for n in names if (m := _PIN.fullmatch(n))]

    def oldest_sequence(self) -> int | None:
        """The sequence of the oldest pinned state; None if there is none."""
        return min((p.sequence for p in self.pins()), default=None)

    def compact(self, pinned: Sequence[int] = ()) -> None:
        """Rewrite all rows to a new base with what the present, the pins and the given numbers need."""
        self._rebase(retained(self.log(), self._kept(pinned)))

    def compact_range(self, lower: bytes | str | None = None, upper: bytes | str | None = None, pinned: Sequence[int] = ()) -> None:
        """compact() for the keys with lower <= key < upper; other keys keep all their versions, and range deletes stay, as they reach further."""
        log, inside = self.log(), in_range(F.col("key"), lower, upper)
        wide = F.col("op") == RANGE_DELETE
        kept = retained(log.where(inside | wide), self._kept(pinned)).where(~wide)
        self._rebase(kept.select(*self.schema.names).unionByName(log.where(~inside | wide)))

    def _kept(self, pinned: Sequence[int]) -> list[int]:
        return sorted({*pinned, *(p.sequence for p in self.pins())})

    def _rebase(self, rows: DataFrame) -> None:
        number = self._last_commit()
        if number:
            earlier = sum(kind == "base" and n == number for kind, n, _ in self._folders())
            # The number of the last operation has to outlive the operations that go.
            self._save(rows, f"base-{number:010d}.{earlier:06d}", self.last_sequence())

    def vacuum(self) -> list[str]:
        """Delete folders that no read needs: incomplete ones, and those that a base stands for. Returns their names."""
        fs, where = self._at(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        stale = sorted(set(n for n in names if _FOLDER.fullmatch(n)) - set(self._live()))
        for name in stale:
            fs.delete(self._at(self.spark, f"{self.path}/{name}")[1], True)
        return stale

    def checkpoint(self, path: str) -> LogStore:
        """A copy of the store at another path, which may not exist: each folder's rows as they lie, without a shuffle."""
        copy = LogStore.create(self.spark, path, self.schema, compression=self.compression)
        for name in self._live():
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")
            rows.write.option("compression", self.compression).parquet(f"{copy.path}/{name}")
            copy._note_last(name, self._last_of(name))
        return copy

    @classmethod
    def repair(cls, spark: SparkSession, path: str, to: str, schema: StructType = LOG_SCHEMA) -> LogStore:
        """A new store with every row that can still be read at path, in complete folders or not; unreadable files are left out."""
        fs, where = cls._at(spark, path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
        folders = [f"{path.rstrip('/')}/{n}" for n in names if _FOLDER.fullmatch(n)]
        new = cls.create(spark, to, schema)
        if folders:
            rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*folders)
            # A base and the commits that it stands for hold some rows both. A number belongs to one operation.
            new.append(rows.select(*schema.names).dropDuplicates(["cf", "key", "seq", "op"]))
        return new

    def files(self) -> DataFrame:
        """Path, rows, key bounds and highest number of each file, read from the rows."""
        stored = self.log().withColumn("path", F.input_file_name())
        return stored.groupBy("path").agg(
            F.count("*").alias("n_rows"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("seq").alias("max_seq")
        )

    def properties(self) -> dict[str, int]:
        """Counts of the store, each for the present."""
        row = self.log().agg(F.count("*").alias("n"), F.countDistinct("cf").alias("f")).first()
        return {"num-rows": row["n"], "num-families": row["f"]} | {name: self.get_property(name) for name in ("last-sequence", "num-folders", "num-snapshots", "num-files", "total-size")}

    def get_property(self, name: str) -> int | None:
        """One property, told by names and sizes of files alone; None for an unknown name."""
        if name == "last-sequence":
            return self.last_sequence()
        if name == "num-snapshots":
            return len(self.pins())
        if name == "num-folders":
            return len(self._live())
        if name in ("num-files", "total-size"):
            sizes = [f.getLen() for n in self._live() for f in self._parquet_files(n)]
            return len(sizes) if name == "num-files" else sum(sizes)
        return None

    def _parquet_files(self, folder: str) -> list:
        fs, where = self._at(self.spark, f"{self.path}/{folder}")
        return [f for f in fs.listStatus(where) if f.getPath().getName().endswith(".parquet")]


class Backups:
    """Numbered full copies of a store under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def list(self) -> list[int]:
        fs, where = LogStore._at(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.removeprefix("backup-")) for n in names if re.fullmatch(r"backup-\d{6}", n))

    def create(self, store: LogStore) -> int:
        number = max(self.list(), default=0) + 1
        store.checkpoint(f"{self.path}/backup-{number:06d}")
        return number

    def restore(self, number: int, path: str, schema: StructType = LOG_SCHEMA) -> LogStore:
        if number not in self.list():
            raise NotFound(f"there is no backup {number}")
        return LogStore(self.spark, f"{self.path}/backup-{number:06d}", schema).checkpoint(path)

    def delete(self, number: int) -> None:
        LogStore.destroy(self.spark, f"{self.path}/backup-{number:06d}")
