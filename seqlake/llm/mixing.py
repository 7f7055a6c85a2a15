"""Mix sources to target weights by Pareto order sampling.

Each source has a target of words. A document's expected copies are a multiple of its weight, at most
MAX_COPIES; the multiple is set for each source so that the expected words add up to the target. The whole
part of the copies is taken for certain. For the fraction p that remains, the document is ranked by its random
odds u / (1 - u) divided by its inclusion odds p / (1 - p), and the lowest ranks are drawn until the rest of
the target is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.functions.placing import numbered
from seqlake.llm.common import broadcast_if_small, checkpointed, row_struct, table, text_or_empty, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
SEED = "mix-1"
#: In the query and the pipeline, documents with this many words or more weigh twice as much as shorter ones.
LONG_WORDS = 100
#: Bins per level in the search for a source's last rank, and levels: 1024 ** 2 bins hold a source's ranks.
BINS, LEVELS = 1024, 2
#: Sources whose limits are broadcast (about 100 bytes each); more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.size(words(text_or_empty(text))).cast("long")


def fill_levels(items: DataFrame, goals: DataFrame) -> DataFrame:
    """of, goal and level: the level at which least(top, level * unit), summed over a group's items, is its goal.

    items: of, unit (above 0) and top; goals: one row per group, of and goal. Items whose top the level would
    exceed get just the top, and what they leave is shared again by the others, until no more reach their top. Each
    round is one sum per group. A group whose tops together are below its goal has an infinite level.
    """
    small = lambda df: broadcast_if_small(df.withColumnsRenamed({"of": "g_of"}), MAX_BROADCAST_SOURCES)
    state, full = goals.select("of", "goal", F.lit(-1.0).alias("level")), -1
    while True:
        over = F.col("top") < F.col("level") * F.col("unit")
        sums = items.join(small(state), F.col("of").eqNullSafe(F.col("g_of"))).groupBy("of", "goal").agg(
            F.coalesce(F.sum(F.when(over, F.col("top"))), F.lit(0.0)).alias("filled"),
            F.sum(F.when(~over, F.col("unit"))).alias("units"),
            F.count_if(over).alias("full"),
        )
        left = F.coalesce((F.col("goal") - F.col("filled")) / F.col("units"), F.lit(float("inf")))
        state = checkpointed(sums.select("of", "goal", left.alias("level"), "full"))
        now = state.agg(F.sum("full")).first()[0]
        if now == full or now is None:
            return state.drop("full")
        full = now


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """Add `target` to one row per source (source, source_size): weighted shares, never above cap sizes.

    Sources that would exceed their cap get just the cap; what they leave is shared again by weight. Sources take
    the weights in turn by code point, null last.
    """
    turn = F.pmod(F.col("turn"), F.lit(len(weights))).cast("int")
    weighed = numbered(sizes, [F.col("source").isNull(), F.col("source")], "turn").select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double").alias("unit"),
        (F.col("source_size") * float(cap)).alias("top"),
        F.lit(0).alias("of"),
    )
    goal = weighed.groupBy("of").agg((F.lit(float(share)) * F.sum("source_size")).alias("goal"))
    level = F.broadcast(fill_levels(weighed, goal).select(F.col("of").alias("g_of"), "level"))  # one row
    return weighed.join(level, F.col("of") == F.col("g_of")).select(
        "source", "source_size", F.when(F.col("top") < F.col("level") * F.col("unit"), F.col("top")).otherwise(F.col("unit") * F.col("level")).alias("target")
    )


def _random(seed: str) -> Column:
    """A number strictly between 0 and 1 that depends on the seed and doc_id only."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def _rank(docs: DataFrame, seed: str) -> DataFrame:
    """Add whole copies, rank and tie-breaker to rows that have size, weight and the level of their source."""
    copies = F.when((F.col("weight") > 0) & (F.col("size") > 0), F.least(F.lit(float(MAX_COPIES)), F.col("level") * F.col("weight"))).otherwise(F.lit(0.0))
    u = F.col("u")
    p = F.col("p")
    return (
        docs.withColumns({"u": _random(seed), "copies": copies})
        .withColumn("whole", F.floor("copies"))
        .withColumn("p", F.col("copies") - F.col("whole"))
        .withColumn("rank", F.when(p > 0, (u / (1 - u)) / (p / (1 - p))))
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, seed: str = SEED, weight: str | Column | None = None) -> DataFrame:
    """Every row of docs as `row`, a struct, with size, source_size, target, copies_taken and taken.

    weight is a column of relative inclusion weights (null: 1; negative or NaN: 0, never taken); it may use the
    words of the text as `size`. Without it all documents of a source are equally likely. Copies stop at MAX_COPIES,
    and what that leaves of a target goes to the source's other documents by weight; only where all that have a
    weight are at the limit a source stays below its target. Defined results: a null text has size 0 and is never
    taken; a null source is a source of its own, last in order; a source without words has target 0; rows that share
    a doc_id and text are drawn together; columns of docs with the names of the results stay in `row`; an empty table
    gives an empty result. Equal inputs give equal draws.
    """
    weighed = F.lit(1.0) if weight is None else F.coalesce((F.col(f"`{weight}`") if isinstance(weight, str) else weight).cast("double"), F.lit(1.0))
    plain = [F.col(f"`{c}`") for c in docs.columns if c not in ("row", "size", "tie", "weight")]
    sized = docs.select(row_struct(docs), *plain, n_words(F.col("text")).alias("size"), F.xxhash64(text_or_empty("text")).alias("tie"))
    if isinstance(weight, str):
        weighed = F.coalesce(F.col("row").getField(weight).cast("double"), F.lit(1.0))
    measured = sized.select("row", "doc_id", "source", "size", "tie", F.when((weighed > 0) & ~F.isnan(weighed), weighed).otherwise(F.lit(0.0)).alias("weight"))
    light = checkpointed(measured.drop("row"))
    goals = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share)
    classes = light.where("weight > 0 and size > 0").groupBy(F.col("source").alias("of"), "weight").agg(F.sum("size").alias("words"))
    items = checkpointed(classes.select("of", (F.col("words") * F.col("weight")).alias("unit"), (F.col("words") * float(MAX_COPIES)).alias("top")))
    levels = fill_levels(items, goals.select(F.col("source").alias("of"), F.col("target").alias("goal"))).drop("goal")
    goals = checkpointed(goals.join(levels, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").fillna(0.0, ["level"]))
    limits = checkpointed(_limits(light, goals, seed))
    limits = broadcast_if_small(limits.withColumnRenamed("source", "of"), MAX_BROADCAST_SOURCES)
    drawn = _rank(measured.join(limits, F.col("source").eqNullSafe(F.col("of"))), seed)
    below = (F.col("rank") < F.col("last.rank")) | (
        (F.col("rank") == F.col("last.rank"))
        & ((F.col("doc_id") < F.col("last.doc_id")) | (F.col("doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("tie") <= F.col("last.tie"))))
    )
    taken = F.col("whole") + F.when(F.coalesce(below, F.lit(False)), 1).otherwise(0)
    return drawn.select(
        "row", "size", "source_size", "target", taken.cast("int").alias("copies_taken"), (F.col("size") * taken).cast("long").alias("taken")
    )


def _limits(light: DataFrame, goals: DataFrame, seed: str) -> DataFrame:
    """The goals with `last`: the highest (rank, doc_id, tie) that is drawn in each source, null if none is.

    A document is drawn when the middle of its words, laid end to end in the order of ranks, lies within the
    rest of the target. The place is found by counting words in bins of ranks, level by level; only the rows
    of the last bin, about a millionth of a source, are sorted.
    """
    of = F.col("source").eqNullSafe(F.col("of"))
    small = lambda df: broadcast_if_small(df.withColumnRenamed("source", "of"), MAX_BROADCAST_SOURCES)
    ranked = _rank(light.join(small(goals), of), seed).select("source", "doc_id", "tie", "size", "target", "whole", "rank")
    ranked = checkpointed(ranked.withColumn("place", F.col("rank") / (1 + F.col("rank"))))
    cut = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest"))
    bounds = {"before": 0, "low": 0.0, "high": float("inf"), "first": 0.0, "beyond": 1.0}
    cut = checkpointed(cut.select("source", "rest", *[F.lit(v).alias(k) for k, v in bounds.items()]))
    inside = lambda: ranked.join(small(cut), of).where("rank >= low and rank < high")
    for _ in range(LEVELS):
        width = F.greatest((F.col("beyond") - F.col("first")) / BINS, F.lit(1e-300))
        slot = F.least(F.floor((F.col("place") - F.col("first")) / width), F.lit(BINS - 1))
        bins = inside().groupBy("source", slot.alias("bin")).agg(
            F.sum("size").alias("size"),
            F.struct(F.min("rank").alias("rank"), F.min("place").alias("place")).alias("least"),
            *[F.first(c).alias(c) for c in ("rest", "before", "high", "beyond")],
        )
        in_order = Window.partitionBy("source").orderBy("bin")
        earlier = F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumns({"before": F.col("before") + earlier, "next": F.lead("least").over(in_order)})
        found = F.struct(
            "rest",
            "before",
            F.col("least.rank").alias("low"),
            F.coalesce("next.rank", "high").alias("high"),
            F.col("least.place").alias("first"),
            F.coalesce("next.place", "beyond").alias("beyond"),
        )
        # The last bin that begins within the rest of the target: all earlier ones are drawn whole.
        cut = checkpointed(
            bins.where("before <= rest").groupBy("source").agg(F.max_by(found, "bin").alias("at")).select("source", "at.*")
        )
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0)) + F.col("size") / 2
    last = inside().withColumn("middle", middle).where("middle <= rest").groupBy("source").agg(F.max(F.struct("rank", "doc_id", "tie")).alias("last"))
    # Where no row of the last bin is drawn, everything below the bin is.
    nothing = F.lit(None).cast("long")
    below = F.struct(F.col("low").alias("rank"), nothing.alias("doc_id"), nothing.alias("tie"))
    found = cut.select(F.col("source").alias("of"), below.alias("below")).join(
        last.withColumnRenamed("source", "last_of"), F.col("of").eqNullSafe(F.col("last_of")), "left"
    )
    return goals.join(found, of, "left").select("source", "source_size", "target", "level", F.coalesce("last", "below").alias("last"))


def by_length() -> Column:
    """The weight of a document in the query and the pipeline."""
    return F.when(F.col("size") >= LONG_WORDS, 2.0).otherwise(1.0)


def mixed_corpus(docs: DataFrame, weight: str | Column | None = None) -> DataFrame:
    """The rows of docs, each as often as it is taken, in the columns of docs. For nulls, ties and empty tables see mix()."""
    taken = mix(docs, weight=weight).where("copies_taken > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies_taken"))).alias("copy")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents mixed, those of LONG_WORDS or more at twice the odds. A null doc_id is drawn as the empty id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, weight=by_length()).select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || doc_id), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, coalesce(sum(size) FILTER (WHERE size >= 100), 0)::BIGINT AS long_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - 2 * coalesce(sum(source_size) OVER f, 0)::BIGINT)
                / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
      FROM w WINDOW f AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, long_size,
             CASE WHEN source_size * 2 < level * w THEN source_size * 2.0::DOUBLE
                  ELSE w * max(level) FILTER (WHERE NOT source_size * 2 < level * w) OVER () END AS target FROM l),
o1 AS (SELECT *, target / (source_size + long_size) AS one FROM t),
o2 AS (SELECT *, CASE WHEN 2 * long_size < one * 2 * long_size THEN (target - 2 * long_size) / (source_size - long_size) ELSE one END AS odds FROM o1),
r AS (SELECT d.*, source_size, target,
             CASE WHEN size > 0 THEN least(2.0::DOUBLE, odds * CASE WHEN size >= 100 THEN 2 ELSE 1 END) ELSE 0.0::DOUBLE END AS copies,
             floor(copies)::BIGINT AS whole
      FROM d JOIN o2 ON d.source IS NOT DISTINCT FROM o2.source),
q AS (SELECT *, CASE WHEN copies - whole > 0 THEN (u / (1 - u)) / ((copies - whole) / (1 - (copies - whole))) END AS rank,
             target - (sum(whole * size) OVER (PARTITION BY source))::BIGINT AS rest FROM r),
o AS (SELECT *, CASE WHEN rank IS NOT NULL AND coalesce(sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS more FROM q)
SELECT doc_id, size, source_size, target, (size * (whole + more))::BIGINT AS taken FROM o
"""
