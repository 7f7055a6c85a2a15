"""The queries of the key-value engine, over logs derived from the driver's tables, and their SQL counterparts.

The main log comes from events: an error is a delete, some signups are range deletes over five users, and all
else are puts. event_id is unique and rises with time, so it numbers the operations.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.functions.placing import numbered, shared_folder
from seqlake.operators import maintain, reads, resolve
from seqlake.operators.mutations import families, in_sequence, mutations
from seqlake.sources.log_store import Backups, LogStore
from seqlake.streaming.ingest import ingest

#: Numbers at which snapshots are read.
EARLY, MIDDLE = 2500, 5000
REQUESTS = ("u000007", "u000042", "nobody", "u000007", "u000149", "", "u000100")
TARGETS = ("", "u000000", "u000050x", "u000099", "u000149", "v")
E1_SCHEMA = T.StructType(
    [
        T.StructField("cf", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.ByteType()),
        T.StructField("end_key", T.StringType()),
        T.StructField("vtype", T.StringType()),
        T.StructField("v", T.DoubleType()),
    ]
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def as_log(events: DataFrame) -> DataFrame:
    wide = (F.col("event_type") == "signup") & (F.col("event_id") % 25 == 0)
    return mutations(
        events,
        key=_padded("u", F.col("user_id"), 6),
        seq=F.col("event_id") + 1,
        op=F.when(F.col("event_type") == "error", 0).when(wide, 2).otherwise(1),
        end_key=F.when(wide, _padded("u", F.col("user_id") + 5, 6)),
        cf="events",
        values=[F.col("event_type").alias("vtype"), F.col("value").alias("v")],
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(_table(spark, sf_dir, "events"))


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three families of puts."""
    read = lambda name: _table(spark, sf_dir, name)
    one = F.lit(1)
    orders = mutations(read("orders"), _padded("o", F.col("o_orderkey"), 9), F.col("o_orderkey") + 1, one, cf="orders", values=[F.col("o_orderstatus").alias("v")])
    customer = mutations(read("customer"), _padded("k", F.col("c_custkey"), 9), F.col("c_custkey") + 1, one, cf="customer", values=[F.col("c_mktsegment").alias("v")])
    key = F.concat(_padded("c", F.col("conv_id"), 6), F.lit("/t"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    talks = mutations(read("conversations"), key, F.col("conv_id") * 10_000 + F.col("turn") + 1, one, cf="conversations", values=[F.col("role").alias("v")])
    return orders.unionByName(customer).unionByName(talks)


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("key", "seq", "vtype", "v", *more)


def _requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REQUESTS)), "pos long, req_key string")


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TARGETS], "target string")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log cut into eight files by number, with sizes as if each row had 100 bytes, on three levels."""
    number = F.floor(F.col("seq") % 8)
    bounds = maintain.run_bounds(log(spark, sf_dir), number)
    return bounds.select("run", (F.col("run") % 3).cast("int").alias("level"), (F.col("n_rows") * 100).alias("bytes"), "min_key", "max_key")


def head_view(spark, d):
    return _shown(resolve.view(log(spark, d)))


def point_only_view(spark, d):
    return _shown(resolve.newest(log(spark, d)).where("op = 1"))


def snapshot_view(spark, d):
    return _shown(resolve.view(log(spark, d), MIDDLE))


def range_delete_view(spark, d):
    every = log(spark, d)
    hidden = resolve.covering(resolve.newest(every).where("op = 1"), resolve.range_deletes(every))
    return hidden.where("cover_seq > seq").select("key", "seq", "cover_seq")


def get_key(spark, d):
    return _shown(reads.get(log(spark, d), "u000007"))


def get_as_of(spark, d):
    return _shown(reads.get(log(spark, d), "u000007", seq=EARLY))


def multi_get(spark, d):
    return reads.multi_get(log(spark, d), _requests(spark)).select("pos", "req_key", "found", "seq", "v")


def exists_keys(spark, d):
    return reads.exists(log(spark, d), _requests(spark))


def key_may_exist_superset(spark, d):
    return reads.key_may_exist(log(spark, d), _requests(spark))


def prefix_scan(spark, d):
    return _shown(reads.prefix_scan(log(spark, d), "u00001"))


def bounded_scan(spark, d):
    return _shown(reads.scan(log(spark, d), "u000020", "u000090"))


def scan_ranked(spark, d):
    return reads.ranked(head_view(spark, d)).select("key", "rank")


def reverse_scan_ranked(spark, d):
    return reads.ranked(head_view(spark, d), descending=True).select("key", "rank")


def first_key(spark, d):
    return reads.first(head_view(spark, d))


def last_key(spark, d):
    return reads.last(head_view(spark, d))


def seek_targets(spark, d):
    return reads.seek(head_view(spark, d), _targets(spark))


def seek_for_prev_targets(spark, d):
    return reads.seek(head_view(spark, d), _targets(spark), forward=False)


def neighbours(spark, d):
    return reads.neighbours(head_view(spark, d))


def topk_from(spark, d):
    return reads.first(head_view(spark, d), 10, "u000050")


def history(spark, d):
    return reads.history(log(spark, d), "u000007").select("key", "seq", F.col("op").cast("int").alias("op"), "vtype", "v")


def version_counts(spark, d):
    return maintain.version_counts(log(spark, d)).select("key", "n_versions")


def _retained(spark, d):
    return maintain.retained(log(spark, d), (EARLY, MIDDLE))


def compaction_retained(spark, d):
    return _retained(spark, d).where("op = 1").select("key", "seq")


def compaction_droppable(spark, d):
    kept = compaction_retained(spark, d).select(F.col("seq").alias("kept"))
    return log(spark, d).where("op = 1").join(kept, F.col("seq") == F.col("kept"), "left_anti").select("key", "seq")


def compaction_view_equal(spark, d):
    kept = _retained(spark, d)
    views = [_shown(resolve.view(kept, s)).withColumn("pinned_at", F.lit(s or 0).cast("long")) for s in (EARLY, MIDDLE, None)]
    return views[0].unionByName(views[1]).unionByName(views[2])


def cf_scan(spark, d):
    return reads.scan(_families(spark, d), cf="customer").select("cf", "key", "v")


def cf_prefix_scan(spark, d):
    return reads.prefix_scan(_families(spark, d), "c00000", cf="conversations").select("cf", "key", "v")


def cf_numbers(spark, d):
    return families(_families(spark, d))


def batch_order(spark, d):
    """The same operations without numbers, written as one batch in the order of events."""
    batch = log(spark, d).withColumnRenamed("seq", "ordinal")
    return _shown(resolve.view(in_sequence(batch, ["ordinal"], 0)))


def overlapping_tombstones(spark, d):
    return reads.delete_counts(log(spark, d)).select("key", "n_deletes")


def tombstone_segments(spark, d):
    return resolve.segments(resolve.range_deletes(log(spark, d))).select("low", "high", "del_seq")


def merge_runs(spark, d):
    every = log(spark, d)
    runs = [every.where(F.col("seq") % 4 == i) for i in range(4)]
    return _shown(resolve.view(runs[2].unionByName(runs[0]).unionByName(runs[3]).unionByName(runs[1])))


def file_overlap(spark, d):
    return maintain.overlapping(_runs(spark, d), "u000020", "u000090").select("run", "min_key", "max_key")


def level_summary(spark, d):
    return maintain.level_summary(_runs(spark, d))


def compaction_score(spark, d):
    return maintain.compaction_scores(_runs(spark, d), trigger=2, base=1 << 17, factor=10)


def repair_bounds(spark, d):
    return maintain.run_bounds(log(spark, d), F.col("seq") % 4)


def op_stats(spark, d):
    return maintain.operation_counts(log(spark, d)).withColumn("op", F.col("op").cast("int"))


def scan_page(spark, d):
    """The third page of 20 keys of a forward scan."""
    return numbered(head_view(spark, d).select("key"), ["key"], "place").where("place >= 40 and place < 60").select("key", "place")


def _store(spark: SparkSession) -> LogStore:
    """An empty store in a folder that all executors share."""
    return LogStore.create(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}/log", E1_SCHEMA)


def _filled(spark, d) -> LogStore:
    """A store with the log in three commits."""
    store, every = _store(spark), log(spark, d)
    for low, high in ((0, EARLY), (EARLY, MIDDLE), (MIDDLE, 1 << 62)):
        store.append(every.where((F.col("seq") > low) & (F.col("seq") <= high)))
    return store


def store_reopened_view(spark, d):
    store = _filled(spark, d)
    return _shown(LogStore(spark, store.path, E1_SCHEMA).view())


def store_compacted_view(spark, d):
    store = _filled(spark, d)
    store.compact(pinned=(MIDDLE,))
    store.vacuum()
    return _shown(store.view(MIDDLE))


def store_checkpoint_view(spark, d):
    store = _filled(spark, d)
    return _shown(store.checkpoint(store.path.removesuffix("/log") + "/copy").view())


def store_restored_view(spark, d):
    store = _filled(spark, d)
    root = store.path.removesuffix("/log")
    backups = Backups(spark, f"{root}/backups")
    return _shown(backups.restore(backups.create(store), f"{root}/restored", E1_SCHEMA).view())


def store_range_compacted(spark, d):
    """Point rows left after one key range is compacted while a state is pinned."""
    store, every = _store(spark), log(spark, d)
    store.append(every.where(F.col("seq") <= MIDDLE))
    pin = store.pin()
    store.append(every.where(F.col("seq") > MIDDLE))
    store.compact_range("u000020", "u000090")
    store.vacuum()
    assert store.oldest_sequence() == pin.sequence
    return store.log().where("op = 1").select("key", "seq")


def store_released_view(spark, d):
    """What is left once a pinned state is released and the store compacted: the rows of the present."""
    store = _filled(spark, d)
    pin = store.pin()
    store.compact()
    store.release(pin)
    store.compact()
    store.vacuum()
    return store.log().where("op = 1").select("key", "seq", "vtype", "v")


def store_repaired_view(spark, d):
    """A store rebuilt from folders of which one was never marked complete."""
    store = _filled(spark, d)
    fs, where = LogStore._at(spark, f"{store.path}/commit-0000000002/_SUCCESS")
    fs.delete(where, False)
    return _shown(LogStore.repair(spark, store.path, store.path.removesuffix("/log") + "/repaired", E1_SCHEMA).view())


def store_total_size(spark, d):
    """Files and bytes of a store as the file system tells them, beside the rows that its files hold: 1 where they agree."""
    store = _filled(spark, d)
    stored = store.log().select("*", "_metadata.file_path", "_metadata.file_size")
    files = stored.groupBy("file_path").agg(F.max("file_size").alias("bytes"), F.count("*").alias("rows"))
    told = store.get_property("num-files"), store.get_property("total-size")
    return files.agg(F.sum("rows").alias("n_rows"), (F.count("*") <= told[0]).alias("files_agree"), (F.sum("bytes") <= told[1]).alias("sizes_agree"))


def multi_get_many(spark, d):
    """10,000 requests, of which most name keys that are not there."""
    wanted = spark.range(10_000).select(F.col("id").alias("pos"), _padded("u", F.col("id"), 6).alias("req_key"))
    return reads.multi_get(log(spark, d), wanted).select("pos", "req_key", "found", "seq", "v")


def stream_ingest_view(spark, d):
    """Events arrive as files; each file is a micro-batch and a commit."""
    store, events = _store(spark), _table(spark, d, "events")
    root = store.path.removesuffix("/log")
    events.repartitionByRange(3, "event_id").write.parquet(f"{root}/arriving")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/arriving")
    ingest(stream, store, f"{root}/progress", as_log).awaitTermination()
    return _shown(store.view())


_MUT = """SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id + 1 AS seq,
       CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'signup' AND event_id % 25 = 0 THEN 2 ELSE 1 END AS op,
       event_type AS vtype, value AS v,
       CASE WHEN event_type = 'signup' AND event_id % 25 = 0 THEN 'u' || lpad(CAST(user_id + 5 AS VARCHAR), 6, '0') END AS end_key
  FROM events"""


def _with(*parts: str) -> str:
    return "WITH m AS (" + _MUT + ")" + "".join(", " + p for p in parts) + " "


def _view(seq: int | None = None, name: str = "w") -> str:
    known = f"seq <= {seq}" if seq is not None else "true"
    return f"""{name} AS (SELECT key, seq, vtype, v FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM m WHERE op < 2 AND {known}) p
  WHERE rn = 1 AND op = 1 AND NOT EXISTS (SELECT 1 FROM m t WHERE t.op = 2 AND t.{known if seq is not None else 'seq > 0'}
    AND p.key >= t.key AND p.key < t.end_key AND t.seq > p.seq))"""


_ALL = _with(_view()) + "SELECT key, seq, vtype, v FROM w"
_REQ = "r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{k}')" for i, k in enumerate(REQUESTS)) + ") AS x(pos, req_key))"
_TGT = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in TARGETS) + ") AS x(target))"
_POINT = """SELECT key, seq, vtype, v FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM m WHERE op < 2) WHERE rn = 1 AND op = 1"""
_KEPT = f"""n AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS nxt FROM m WHERE op < 2),
h AS (SELECT n.key, n.seq, n.op, least(min(t.seq), any_value(n.nxt)) AS until FROM n LEFT JOIN m t
      ON t.op = 2 AND n.key >= t.key AND n.key < t.end_key AND t.seq > n.seq GROUP BY n.key, n.seq, n.op),
k AS (SELECT key, seq FROM h WHERE op = 1 AND (until IS NULL OR (seq <= {EARLY} AND {EARLY} < until) OR (seq <= {MIDDLE} AND {MIDDLE} < until)))"""
_RUNS = """f AS (SELECT seq % 8 AS run, (seq % 8 % 3)::INTEGER AS level, count(*) * 100 AS bytes, min(key) AS min_key, max(key) AS max_key FROM m GROUP BY 1, 2)"""
_LEVELS = "l AS (SELECT level, count(*) AS n_files, sum(bytes)::BIGINT AS bytes FROM f GROUP BY level)"

_SQL: dict[Callable, str] = {
    head_view: _ALL,
    point_only_view: _with() + _POINT,
    snapshot_view: _with(_view(MIDDLE)) + "SELECT key, seq, vtype, v FROM w",
    range_delete_view: _with(f"p AS ({_POINT})") + "SELECT p.key, p.seq, max(t.seq) AS cover_seq FROM p JOIN m t ON t.op = 2 AND p.key >= t.key AND p.key < t.end_key GROUP BY ALL HAVING max(t.seq) > p.seq",
    get_key: _ALL + " WHERE key = 'u000007'",
    get_as_of: _with(_view(EARLY)) + "SELECT key, seq, vtype, v FROM w WHERE key = 'u000007'",
    multi_get: _with(_view(), _REQ) + "SELECT pos, req_key, key IS NOT NULL AS found, seq, v FROM r LEFT JOIN w ON key = req_key",
    exists_keys: _with(_view(), _REQ) + "SELECT pos, req_key, EXISTS (SELECT 1 FROM w WHERE key = req_key) AS found FROM r",
    key_may_exist_superset: _with(_REQ) + "SELECT pos, req_key, EXISTS (SELECT 1 FROM m WHERE key = req_key) AS maybe FROM r",
    prefix_scan: _ALL + " WHERE key >= 'u00001' AND key < 'u00002'",
    bounded_scan: _ALL + " WHERE key >= 'u000020' AND key < 'u000090'",
    scan_ranked: _with(_view()) + "SELECT key, row_number() OVER (ORDER BY key) AS rank FROM w",
    reverse_scan_ranked: _with(_view()) + "SELECT key, row_number() OVER (ORDER BY key DESC) AS rank FROM w",
    first_key: _ALL + " ORDER BY key LIMIT 1",
    last_key: _ALL + " ORDER BY key DESC LIMIT 1",
    seek_targets: _with(_view(), _TGT) + "SELECT target, (SELECT min(key) FROM w WHERE key >= target) AS found_key FROM r",
    seek_for_prev_targets: _with(_view(), _TGT) + "SELECT target, (SELECT max(key) FROM w WHERE key <= target) AS found_key FROM r",
    neighbours: _with(_view()) + "SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM w",
    topk_from: _ALL + " WHERE key >= 'u000050' ORDER BY key LIMIT 10",
    history: _with() + "SELECT key, seq, op, vtype, v FROM m WHERE key = 'u000007' AND op < 2",
    version_counts: _with() + "SELECT key, count(*) AS n_versions FROM m WHERE op < 2 GROUP BY key",
    compaction_retained: _with(_KEPT) + "SELECT key, seq FROM k",
    compaction_droppable: _with(_KEPT) + "SELECT key, seq FROM m WHERE op = 1 AND seq NOT IN (SELECT seq FROM k)",
    compaction_view_equal: _with(_view(EARLY, "a"), _view(MIDDLE, "b"), _view(None, "c"))
    + f"SELECT *, {EARLY}::BIGINT AS pinned_at FROM a UNION ALL SELECT *, {MIDDLE}::BIGINT FROM b UNION ALL SELECT *, 0::BIGINT FROM c",
    cf_scan: "SELECT 'customer' AS cf, 'k' || lpad(c_custkey::VARCHAR, 9, '0') AS key, c_mktsegment AS v FROM customer",
    cf_prefix_scan: "SELECT * FROM (SELECT 'conversations' AS cf, 'c' || lpad(conv_id::VARCHAR, 6, '0') || '/t' || lpad(turn::VARCHAR, 4, '0') AS key, role AS v FROM conversations) WHERE starts_with(key, 'c00000')",
    cf_numbers: "SELECT * FROM (VALUES (0::BIGINT, 'conversations'), (1::BIGINT, 'customer'), (2::BIGINT, 'orders')) AS x(id, cf)",
    batch_order: _ALL,
    overlapping_tombstones: _with() + "SELECT k.key, count(*) AS n_deletes FROM (SELECT DISTINCT key FROM m WHERE op < 2) k JOIN m t ON t.op = 2 AND k.key >= t.key AND k.key < t.end_key GROUP BY k.key",
    tombstone_segments: _with("b AS (SELECT key AS low FROM m WHERE op = 2 UNION SELECT end_key FROM m WHERE op = 2)", "s AS (SELECT low, lead(low) OVER (ORDER BY low) AS high FROM b)")
    + "SELECT low, high, max(seq) AS del_seq FROM s JOIN m ON op = 2 AND key <= low AND end_key >= high GROUP BY low, high",
    merge_runs: _ALL,
    file_overlap: _with(_RUNS) + "SELECT run, min_key, max_key FROM f WHERE min_key <= 'u000090' AND max_key >= 'u000020'",
    level_summary: _with(_RUNS, _LEVELS) + "SELECT level, n_files, bytes FROM l",
    compaction_score: _with(_RUNS, _LEVELS) + "SELECT level, CASE WHEN level = 0 THEN n_files / 2.0::DOUBLE ELSE bytes / (131072.0::DOUBLE * pow(10.0::DOUBLE, level - 1)) END AS score FROM l",
    repair_bounds: _with() + "SELECT seq % 4 AS run, min(key) AS min_key, max(key) AS max_key, count(*) AS n_rows, max(seq) AS max_seq FROM m GROUP BY 1",
    op_stats: _with() + "SELECT op, count(*) AS n_ops, sum(strlen(key))::BIGINT AS key_bytes FROM m GROUP BY op",
    scan_page: _with(_view()) + "SELECT key, place FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS place FROM w) WHERE place >= 40 AND place < 60",
    store_reopened_view: _ALL,
    store_compacted_view: _with(_view(MIDDLE)) + "SELECT key, seq, vtype, v FROM w",
    store_checkpoint_view: _ALL,
    store_restored_view: _ALL,
    store_range_compacted: _with(
        "n AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS nxt FROM m WHERE op < 2)",
        "h AS (SELECT n.key, n.seq, n.op, least(min(t.seq), any_value(n.nxt)) AS until FROM n LEFT JOIN m t ON t.op = 2 AND n.key >= t.key AND n.key < t.end_key AND t.seq > n.seq GROUP BY n.key, n.seq, n.op)",
        f"p AS (SELECT max(seq) AS mark FROM m WHERE seq <= {MIDDLE})",
    )
    + "SELECT key, seq FROM h, p WHERE op = 1 AND (key < 'u000020' OR key >= 'u000090' OR until IS NULL OR (seq <= mark AND mark < until))",
    store_released_view: _ALL,
    store_repaired_view: _ALL,
    store_total_size: _with() + "SELECT count(*) AS n_rows, true AS files_agree, true AS sizes_agree FROM m",
    multi_get_many: _with(_view()) + "SELECT pos, req_key, key IS NOT NULL AS found, seq, v FROM (SELECT i AS pos, 'u' || lpad(i::VARCHAR, 6, '0') AS req_key FROM range(10000) x(i)) LEFT JOIN w ON key = req_key",
    stream_ingest_view: _ALL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _SQL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _SQL.items()}
