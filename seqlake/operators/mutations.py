"""The mutation log: one row per put, delete or range delete, numbered in the order in which they took place."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.errors import InvalidArgument
from seqlake.functions.placing import numbered

# Codes of the operations, fixed values of the log format.
DELETE, PUT, RANGE_DELETE = 0, 1, 2
DEFAULT_FAMILY = "default"
MAX_FAMILIES = 256

LOG_SCHEMA = T.StructType(
    [
        T.StructField("cf", T.StringType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("end_key", T.BinaryType()),
    ]
)
#: Columns that the operators need; all others are the payload, of any number and type.
CONTROL = ("cf", "key", "seq", "op", "end_key")


def payload(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in CONTROL]


def mutations(
    df: DataFrame, key: Column, seq: Column, op: Column, end_key: Column | None = None, cf: Column | str = DEFAULT_FAMILY, values: Sequence[Column] = ()
) -> DataFrame:
    """A log from any table: each row is one operation."""
    family = F.lit(cf) if isinstance(cf, str) else cf
    end = end_key if end_key is not None else F.lit(None).cast("string")
    return df.select(family.alias("cf"), key.alias("key"), seq.cast("long").alias("seq"), op.cast("tinyint").alias("op"), end.alias("end_key"), *values)


def in_sequence(batch: DataFrame, order: Sequence[Column | str], last: int) -> DataFrame:
    """The operations of a batch with consecutive numbers after last, in the given order."""
    return numbered(batch.drop("seq"), order, "seq", last + 1)


def families(log: DataFrame) -> DataFrame:
    """The families of the log with a number each: the default is 0, the others follow by name."""
    names = log.select("cf").distinct()
    return numbered(names, [F.col("cf") != DEFAULT_FAMILY, F.col("cf")], "id").select("id", "cf")


class WriteBatch:
    """Operations to be written together, in the order of the calls; large batches are tables (see mutations())."""

    def __init__(self) -> None:
        self._rows: list[tuple] = []

    def put(self, key: bytes, value: bytes, cf: str = DEFAULT_FAMILY) -> WriteBatch:
        self._rows.append((cf, bytes(key), PUT, bytes(value), None))
        return self

    def delete(self, key: bytes, cf: str = DEFAULT_FAMILY) -> WriteBatch:
        self._rows.append((cf, bytes(key), DELETE, None, None))
        return self

    def delete_range(self, start: bytes, end: bytes, cf: str = DEFAULT_FAMILY) -> WriteBatch:
        self._rows.append((cf, bytes(start), RANGE_DELETE, None, bytes(end)))
        return self

    def clear(self) -> None:
        self._rows.clear()

    def __len__(self) -> int:
        return len(self._rows)

    def approximate_size(self) -> int:
        return sum(len(k) + len(v or b"") + len(e or b"") for _, k, _, v, e in self._rows)

    def visit(self, put: Callable, delete: Callable, delete_range: Callable = lambda cf, start, end: None) -> None:
        """Replay the operations in order."""
        for cf, key, op, value, end in self._rows:
            if op == PUT:
                put(cf, key, value)
            elif op == DELETE:
                delete(cf, key)
            else:
                delete_range(cf, key, end)

    def to_df(self, spark: SparkSession, last: int = 0) -> DataFrame:
        """The log rows, numbered after last."""
        if len({r[0] for r in self._rows}) > MAX_FAMILIES:
            raise InvalidArgument(f"more than {MAX_FAMILIES} families")
        rows = [(cf, bytearray(k), last + 1 + i, op, None if v is None else bytearray(v), None if e is None else bytearray(e)) for i, (cf, k, op, v, e) in enumerate(self._rows)]
        return spark.createDataFrame(rows, LOG_SCHEMA)
