"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of links (columns a and b, not null).

    Each round hangs every node's larger neighbours, then its smaller ones, onto the smallest it knows, so
    the number of rounds grows with the logarithm of the longest path. A round's links are a checkpoint, so
    lineage stays short. Hubs are split like any skewed join, and minima are taken before the shuffle.
    """
    links = checkpointed(_tidy(links.select("a", "b")))
    state = _state(links)
    while True:
        links = checkpointed(_tidy(_small_star(_large_star(links))))
        now = _state(links)
        if now == state:
            break
        state = now
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, the larger node first."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")).select("of", F.least("of", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = links.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
    hung = links.join(least, F.col("a") == F.col("of"))
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("of", "m"))
