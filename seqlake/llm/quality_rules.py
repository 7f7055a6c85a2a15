"""Quality rules: base counts of each document, and cross-document line frequency within each host.

Lines are normalised (lower case, white space collapsed) and hashed; for each host the distinct texts that
hold a line are counted. A line in more texts than the host's limit is boilerplate and is removed. A document
is rejected if it fails a base rule, or if the removal leaves less than a stated share of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import broadcast_if_small, checkpointed, table, text_or_empty, words

#: A line is above the limit if more texts of its host hold it than both of these allow.
MIN_TEXTS = 10
MAX_SHARE = 0.1
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.5
MIN_WORDS = 50
#: Parts into which a host's documents are dealt for the join with its frequent lines.
SALTS = 8
#: Lines, and hosts with frequent lines, that are broadcast at most (about 100 bytes a line, some KB a host); more are shuffled.
MAX_BROADCAST_LINES, MAX_BROADCAST_HOSTS = 100_000, 1_000


def with_base_counts(docs: DataFrame, text: Column) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, which may not be null.

    Step by step, each in a projection of its own, so that every array is computed once. Words in 3-word
    windows found twice or more: the windows are sorted with their places, and those equal to a neighbour
    mark three places each.
    """
    n = F.size("_words")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    spaced = lambda a, b: F.concat(a, F.lit(" "), b)
    window = F.zip_with(
        F.zip_with(F.slice("_words", 1, n - 2), F.slice("_words", 2, n - 2), spaced), F.slice("_words", 3, n - 2), spaced
    )
    split = docs.withColumns({"_words": words(text), "_lines": lines})
    counted = split.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n > 3, window).otherwise(F.array().cast("array<string>")).alias("_windows"),
    )
    placed = F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    unique = F.size(F.array_distinct("_windows")) == F.size("_windows")
    placed = counted.withColumn("_placed", F.when(~unique, placed)).drop("_windows")
    twins = F.zip_with("_placed", F.slice("_placed", 2, F.size("_placed")), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    marked = F.transform(F.flatten(F.filter(twins, lambda x: x.isNotNull())), lambda i: F.array(i, i + 1, i + 2))
    repeated = F.coalesce(F.size(F.array_distinct(F.flatten(marked))), F.lit(0))
    return placed.withColumn("n_repeat_words", F.when(F.col("_placed").isNull(), 0).otherwise(repeated).cast("long")).drop("_placed")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def normalised(text: Column) -> Column:
    """Lower case, and each run of white space within a line as one space."""
    return F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "))


def _line_hashes(text: Column) -> Column:
    """Hash and words of each line with a word, in an array."""
    lines = F.filter(F.transform(F.split(normalised(text), "\n"), lambda line: F.trim(line)), lambda line: line != "")
    return F.transform(lines, lambda line: F.struct(F.xxhash64(line).alias("hash"), F.size(F.split(line, " ")).alias("words")))


def frequent_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE) -> DataFrame:
    """host, line_hash, n_texts of the lines above their host's limit.

    A line's documents, of which copies of a text are several, are at least as many as its distinct texts. So lines
    are counted by document first, which needs no text hashes in the shuffle, and only those above the limit by
    that count are counted by distinct text.
    """
    text = text_or_empty("text")
    lines = docs.select(
        F.col("source").alias("host"),
        F.xxhash64(text).alias("text_hash"),
        F.explode(F.array_distinct(F.transform(_line_hashes(text), lambda line: line["hash"]))).alias("line_hash"),
    )
    texts = docs.select(F.col("source").alias("h"), F.xxhash64(text).alias("text_hash")).distinct()
    hosts = checkpointed(texts.groupBy("h").agg((F.count("*") * max_share).alias("allowed")))
    above = lambda df: df.where(F.col("n") > min_texts).join(hosts, F.col("host").eqNullSafe(F.col("h"))).where("n > allowed").drop("h", "allowed")
    many = checkpointed(above(lines.groupBy("host", "line_hash").agg(F.count("*").alias("n"))))
    many = broadcast_if_small(many.select(F.col("host").alias("m_host"), F.col("line_hash").alias("m_line")), MAX_BROADCAST_LINES)
    some = lines.join(many, (F.col("line_hash") == F.col("m_line")) & F.col("host").eqNullSafe(F.col("m_host")), "left_semi").distinct()
    return above(some.groupBy("host", "line_hash").agg(F.count("*").alias("n"))).withColumnRenamed("n", "n_texts")


def _marked(docs: DataFrame, host: Column, text: Column, min_texts: int, max_share: float, of: DataFrame) -> DataFrame:
    """The rows of docs with the frequent lines of their host (of the documents of), and the words in those that they hold.

    Each frequent line is in more than max_share of the host's texts, so a host has at most 1 / max_share times as
    many of them as one of its texts has lines on average; they fit into one array. Hosts are salted for the join.
    """
    frequent = frequent_lines(of, min_texts, max_share).groupBy(F.col("host").alias("f_host")).agg(F.collect_list("line_hash").alias("frequent"))
    frequent = broadcast_if_small(
        checkpointed(frequent).withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), MAX_BROADCAST_HOSTS * SALTS
    )
    salted = docs.withColumn("salt", F.pmod(F.hash("doc_id", text), F.lit(SALTS)))
    joined = salted.join(frequent, (F.col("salt") == F.col("f_salt")) & host.eqNullSafe(F.col("f_host")), "left").drop("salt", "f_salt", "f_host")
    held = F.filter(_line_hashes(text), lambda line: F.array_contains("frequent", line["hash"]))
    n = F.aggregate(held, F.lit(0).cast("long"), lambda total, line: total + line["words"])
    return joined.withColumn("n_removed_words", F.when(F.col("frequent").isNotNull(), n).otherwise(F.lit(0).cast("long")))


def judge(docs: DataFrame, min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, n_removed_words and kept.

    Defined results: a null or empty text has no words and fails; lines without words are left alone; a null
    source is a host of its own; equal rows get equal verdicts and count as one text for the line limits; an
    empty table gives an empty result; further columns are ignored.
    """
    base = docs.select("doc_id", text_or_empty("text").alias("text"), F.col("source").alias("host"))
    marked = _marked(base, F.col("host"), F.col("text"), min_texts, max_share, docs)
    judged = with_base_counts(marked.select("doc_id", "text", "n_removed_words"), F.col("text")).drop("text")
    failed = base_failed()
    left = F.col("n_words") - F.col("n_removed_words")
    return judged.select(
        *["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        failed.alias("base_failed"),
        "n_removed_words",
        (~failed & (left >= min_left * F.col("n_words"))).alias("kept"),
    )


def clean_documents(docs: DataFrame, min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that are kept, without the lines above the limits, in the columns of docs.

    n_chars, if there is such a column, is counted again where a line was removed. Rows with the same doc_id
    and text share a verdict. Null and empty texts are rejected.
    """
    text = text_or_empty(F.col("row.text"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = _marked(docs.select(row, "doc_id"), F.col("row.source"), text, min_texts, max_share, docs)
    base = with_base_counts(marked.drop("doc_id"), text)
    # The row number keeps the test above the counts: pushed below, it would repeat all that they are made from.
    base = base.withColumn("at", F.monotonically_increasing_id()).where(~base_failed() & (F.col("at") >= 0))
    kept = base.where(F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words"))
    lines = F.filter(F.split(F.col("row.text"), "\n"), lambda line: ~F.array_contains("frequent", F.xxhash64(F.trim(normalised(line)))))
    cleaned = kept.withColumn("cleaned", F.when(F.col("n_removed_words") > 0, F.array_join(lines, "\n")))
    mended = {"text": F.coalesce("cleaned", "row.text"), "n_chars": F.coalesce(F.length("cleaned").cast("long"), F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.coalesce("cleaned", "row.text")}
    return cleaned.select(*[mended.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
t AS (SELECT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g, i
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j
            FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, line,
             lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
      FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM l WHERE norm <> '' GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
often AS (SELECT l.source, norm, count(DISTINCT text) AS c FROM l WHERE norm <> '' GROUP BY l.source, norm),
bad AS (SELECT often.source, norm FROM often JOIN hosts ON often.source IS NOT DISTINCT FROM hosts.source
        WHERE c > 10 AND c > hosts.n * 0.1::DOUBLE),
gone AS (SELECT doc_id, sum(len(string_split(l.norm, ' ')))::BIGINT AS n
         FROM l JOIN bad ON l.norm = bad.norm AND l.source IS NOT DISTINCT FROM bad.source GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(gone.n, 0)::BIGINT AS n_removed_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
       NOT base_failed AND n_words - n_removed_words >= 0.5::DOUBLE * n_words AS kept FROM f
"""
