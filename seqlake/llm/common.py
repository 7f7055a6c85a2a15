"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.functions.placing import broadcast_if_small, checkpointed

__all__ = ["WORD", "broadcast_if_small", "checkpointed", "crc32_of", "row_struct", "table", "text_or_empty", "utf8_bytes", "words"]

#: Words of the quality, joining and mixing operators: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array; none for an empty text."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def crc32_of(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def row_struct(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """`row`: the columns of a table as one struct, so that no name clashes with those that an operator adds."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(c) for c in columns or docs.columns]).alias("row")
