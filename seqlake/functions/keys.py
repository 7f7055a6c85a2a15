"""Helpers for ordered keys. Keys are strings or binary; both order by unsigned bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_successor(prefix: bytes | str) -> bytes | str | None:
    """The least key above all keys with the prefix; None if there is none (an empty prefix, or all 0xFF).

    For text the successor is taken by code point, leaving out the surrogates.
    """
    if isinstance(prefix, str):
        kept = prefix.rstrip(chr(0x10FFFF))
        if not kept:
            return None
        after = ord(kept[-1]) + 1
        return kept[:-1] + chr(0xE000 if after == 0xD800 else after)
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def in_range(key: Column, lower: bytes | str | None = None, upper: bytes | str | None = None) -> Column:
    """lower <= key < upper, either bound open if None; a form that Parquet scans can use."""
    test = F.lit(True)
    if lower is not None:
        test = key >= F.lit(lower)
    if upper is not None:
        test = (key < F.lit(upper)) & test
    return test


def has_prefix(key: Column, prefix: bytes | str) -> Column:
    return in_range(key, prefix or None, prefix_successor(prefix))
