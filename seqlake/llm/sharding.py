"""Two-pass external shuffle: scatter to memory-sized buckets, then Fisher-Yates in each bucket.

Pass one sends every record to a bucket by a seeded hash, so that each bucket is a uniform sample of
the input and fits in the memory of one task. Pass two shuffles each bucket and numbers its records
after those of all earlier buckets. The numbers are dealt in turn to the shards, so that the shards'
counts are at most one apart and each shard's slots have no gaps (the `rows` law).

Records that are equal in every column cannot be told apart, so they are one record with a number of copies until
the scatter deals the copies out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.llm.common import broadcast_if_small, checkpointed, crc32_of, row_struct, table, text_or_empty, utf8_bytes

N_SHARDS = 16
SEED = 20_240_501
#: Bytes that one bucket should hold; a bucket is shuffled in the memory of one task.
BUCKET_BYTES = 16 << 20
#: Bytes of a record beside its text, about.
RECORD_BYTES = 64
#: Shuffle partitions of the scatter at most; each holds as many buckets as are needed, which are shuffled one by one.
MAX_PARTITIONS = 1 << 16
#: Buckets whose offsets (16 bytes each), and keys of repeated records, that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 1 << 20

ORACLE_SQL = None


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return utf8_bytes(text_or_empty(text)) + 1


def external_shuffle(
    docs: DataFrame,
    n_shards: int = N_SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Every row of docs with its `shard` and `slot`, in place of columns of those names.

    Defined results: a null text counts as empty; rows may repeat and each copy gets a slot of its own; an empty
    table gives an empty result; columns may have any names. Equal input rows give equal shards and slots, whatever
    the cluster. Rows that share doc_id and text are scattered alike, unless they fill a good part of a bucket: then
    each is scattered by all its columns and the number of its copy. The columns must be of types that Spark can sort,
    as bucket-mates are ordered before the shuffle.
    """
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), text_or_empty("text"))
    packed = docs.select(row_struct(docs), key.alias("key"), (record_size(F.col("text")) + RECORD_BYTES).alias("bytes"))
    keys = checkpointed(packed.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")))
    n_buckets = max(1, -(-(keys.agg(F.sum("bytes")).first()[0] or 0) // bucket_bytes))
    parts = min(n_buckets, MAX_PARTITIONS)
    bucket = lambda hash_: F.pmod(hash_, F.lit(n_buckets)).alias("bucket")
    record = F.struct("key", "row").alias("record")
    # At most four such keys for each bucket.
    heavy = keys.where((F.col("n") > 1) & (4 * F.col("bytes") > bucket_bytes)).select(F.col("key").alias("heavy"))
    scattered = packed.select(bucket(F.col("key")), record)
    counts = keys.select(bucket(F.col("key")), "n")
    if heavy.limit(1).count():
        heavy = broadcast_if_small(heavy, MAX_BROADCAST)
        of = F.col("key") == F.col("heavy")
        # Copies meet as a count; dealt out again by number, they are spread over the buckets.
        copies = packed.join(heavy, of, "left_semi").groupBy("key", "row").agg(F.count("*").alias("n"))
        dealt = copies.select("key", "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
        dealt = dealt.select(bucket(F.xxhash64(F.lit(seed), "row", "copy")), record)
        scattered = packed.join(heavy, of, "left_anti").select(bucket(F.col("key")), record).unionByName(dealt)
        counts = keys.join(heavy, of, "left_anti").select(bucket(F.col("key")), "n").unionByName(dealt.select("bucket", F.lit(1).cast("long").alias("n")))
    coarse = F.pmod("bucket", F.lit(parts)).cast("int")
    offsets = _offsets(counts.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("part", coarse))
    if n_buckets <= MAX_BROADCAST:
        offsets = F.broadcast(offsets)
    # Sorted first, so that a task that runs again shuffles the same sequences the same way.
    buckets = scattered.withColumn("part", coarse).repartitionById(parts, F.col("part")).groupBy("part", "bucket").agg(F.sort_array(F.collect_list("record")).alias("records"))
    shuffled = buckets.sortWithinPartitions("part", "bucket").select("bucket", F.shuffle("records", seed).alias("records"))
    placed = shuffled.join(offsets, F.col("bucket") == F.col("of_bucket")).select("offset", F.posexplode("records").alias("at", "record"))
    rank = F.col("offset") + F.col("at")
    kept = [F.col("record.row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(
        *kept,
        F.pmod(rank, F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(rank / n_shards).cast("long").alias("slot"),
    )


def _offsets(counts: DataFrame) -> DataFrame:
    """of_bucket and offset: the records before each bucket, from (bucket, n, part), by part first and then within it."""
    earlier = lambda n, window: F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per shuffle partition of the scatter, MAX_PARTITIONS at most, in one task.
    parts = counts.groupBy(F.col("part").alias("of")).agg(F.sum("n").alias("n")).select("of", earlier("n", Window.orderBy("of")).alias("before"))
    within = earlier("n", Window.partitionBy("part").orderBy("bucket"))
    joined = counts.select("bucket", "part", within.alias("within")).join(F.broadcast(parts), F.col("part") == F.col("of"))
    return joined.select(F.col("bucket").alias("of_bucket"), (F.col("before") + F.col("within")).alias("offset"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write each shard to a folder of its own, its records in the order of their slots; an empty table writes no shard."""
    shuffled.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 by the law `rows`, over all documents: 16 shards. Null texts have size 1; an empty table gives no rows."""
    shuffled = external_shuffle(table(spark, sf_dir, "documents"))
    return shuffled.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        crc32_of(text_or_empty("text")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
