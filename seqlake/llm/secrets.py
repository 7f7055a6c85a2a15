"""Secret scan: strong patterns, and weak candidates linked with complementary parts nearby.

Strong findings (assigned secrets, access identifiers, long hexadecimal runs) stand alone. Weak candidates are
accounts (mail addresses), tokens that look like a secret, and endpoints (addresses of a service, and IPv4
addresses); on their own they are noise. Each is reported only when a complementary part begins within SCOPE code
points of it: an account beside a secret (assigned, hexadecimal or a weak token); a weak token beside an identifier
(access or account) or an endpoint; an endpoint beside a secret or an access identifier. The scopes are found by
one sliding interval per document over its candidates.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.llm.common import table, text_or_empty

#: Code points between the beginnings of parts that belong together.
SCOPE = 200
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order in which they are listed: pattern, and the least code points of its checked group.
STRONG = {
    "assign": (ASSIGN, 1, 6),
    "access": (r"(AKIA[A-Z0-9]{16,})", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),
}
#: Weak candidates: a mail address (its parts bounded, which bounds the search); 32 or more characters of a token; an address with a scheme, or four numbers up to 255.
NUMBER = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
WEAK = {
    "account": (r"([A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})", 1, 6),
    "weak": (r"([A-Za-z0-9+/_-]{32,})", 1, 32),
    "endpoint": (r"([a-z]{2,12}://[A-Za-z0-9._:@/-]{4,}|\b" + NUMBER + r"(?:\." + NUMBER + r"){3}\b)", 1, 4),
}
KINDS = (*STRONG, *WEAK)
#: A weak token has all of these.
MIXED = ("[a-z]", "[A-Z]", "[0-9]")
#: Kinds that make a weak candidate worth reporting when one of them is near.
COMPLEMENTS = {"account": ("assign", "hex", "weak"), "weak": ("access", "account", "endpoint"), "endpoint": ("assign", "access", "hex", "weak")}
#: Plain substrings of which a text must hold one for a kind to be there: most texts are spared the pattern.
NEEDED = {"assign": ("=", ":"), "access": ("AKIA",), "account": ("@",), "endpoint": ("://", ".")}

def _parts(text: Column, kind: str, pattern: str, group: int) -> Column:
    """An array with, for each match: its kind, number, code points before it since the last match, its own, and its group's.

    Splitting by the pattern gives what lies between the matches that extracting gives; so the lengths add up
    to places.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    like_secret = lambda part: reduce(and_, [part.rlike(c) for c in MIXED]) if kind == "weak" else F.lit(True)
    checked = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda part: F.when(like_secret(part), F.length(part)).otherwise(0))
    zipped = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("len"), checked.alias("checked"))
    found = F.transform(
        zipped,
        lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["checked"].alias("checked")),
    )
    # Cheap tests spare a text without a match the other passes.
    test = text.rlike(pattern)
    if kind in NEEDED:
        test = reduce(or_, [text.contains(part) for part in NEEDED[kind]]) & test
    return F.when(test, found).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,checked:int>>"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of docs: doc_id, `base` and `found`, arrays of (start, kind, end) in order; found holds base.

    Places are code points, the end exclusive. Defined results: a null or empty text has no findings; rows
    may repeat and each has a result of its own; doc_id may be null; an empty table gives an empty result; further
    columns are ignored. A weak finding that overlaps a strong one is not reported.
    """
    text = text_or_empty("text")
    patterns = STRONG | WEAK
    parts = F.concat(*[_parts(F.col("text"), k, p, g) for k, (p, g, _) in patterns.items()])
    read = docs.select("doc_id", text.alias("text"))
    rows = read.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode_outer(parts).alias("p")).select("doc_id", "text_hash", "p.*")
    # Rows that repeat doc_id and text have the same parts: they go on as one, with a number of copies.
    rows = rows.groupBy("doc_id", "text_hash", "kind", "i").agg(*[F.first(c).alias(c) for c in ("gap", "len", "checked")], F.count("*").alias("copies"))
    rows = rows.select(F.struct("doc_id", "text_hash").alias("row"), "doc_id", "kind", "i", "gap", "len", "checked", "copies")
    so_far = Window.partitionBy("row", "kind").orderBy("i")
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in patterns.values()]), F.col("kind") + 1)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).select(
        "row", "doc_id", "copies", (F.col("end") - F.col("len")).alias("start"), F.when(F.col("checked") >= least, F.col("kind")).alias("kind"), "end"
    )
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)
    number = {k: KINDS.index(k) for k in KINDS}
    seen = lambda *kinds: F.max(F.col("kind").isin(*[number[k] for k in kinds])).over(near)
    # Strong spans end at most where the furthest of those that begin earlier, or here, ends.
    strong_end = F.max(F.when(F.col("kind") < len(STRONG), F.col("end"))).over(
        Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    )
    next_strong = F.min(F.when(F.col("kind") < len(STRONG), F.col("start"))).over(
        Window.partitionBy("row").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    )
    free = (F.coalesce(strong_end, F.lit(0)) <= F.col("start")) & (F.coalesce(next_strong >= F.col("end"), F.lit(True)))
    linked = F.col("kind").isNotNull()
    for weak, others in COMPLEMENTS.items():
        linked = F.when(F.col("kind") == number[weak], seen(*others) & free).otherwise(linked)
    judged = placed.withColumn("linked", F.coalesce(linked, F.lit(False)))
    span = F.struct("start", "kind", "end")
    gather = lambda test: F.array_sort(F.collect_list(F.when(test, span)))
    found = judged.groupBy("row", "doc_id").agg(
        gather(F.col("linked") & (F.col("kind") < len(STRONG))).alias("base"), gather(F.col("linked")).alias("found"), F.max("copies").alias("copies")
    )
    return found.select("doc_id", "base", "found", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the findings of every document, by place; null and empty texts have none."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in STRONG], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _sql_parts(kind: str, pattern: str, group: int, least: int) -> str:
    """The matches of a kind as SQL: doc_id, kind number, start and end (code points)."""
    quoted = pattern.replace("'", "''")
    mixed = " AND ".join(f"regexp_matches(part, '{c}')" for c in MIXED) if kind == "weak" else "true"
    return f"""SELECT doc_id, {KINDS.index(kind)} AS kind, ends - length(whole) AS start_, ends AS end_ FROM (
  SELECT doc_id, whole, part, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '{quoted}', 0)) AS whole, unnest(regexp_extract_all(text, '{quoted}', {group})) AS part,
           unnest(list_slice(string_split_regex(text, '{quoted}'), 1, len(regexp_extract_all(text, '{quoted}')))) AS gap,
           generate_subscripts(regexp_extract_all(text, '{quoted}'), 1) AS i FROM d WHERE regexp_matches(text, '{quoted}')))
  WHERE length(part) >= {least} AND {mixed}"""


def _oracle() -> str:
    parts = "\n  UNION ALL ".join(_sql_parts(k, *v) for k, v in (STRONG | WEAK).items())
    numbers = lambda kinds: ", ".join(str(KINDS.index(k)) for k in kinds)
    near = " OR ".join(f"(c.kind = {KINDS.index(k)} AND o.kind IN ({numbers(v)}))" for k, v in COMPLEMENTS.items())
    n, names = len(STRONG), ", ".join(f"'{k}'" for k in KINDS)
    listing = lambda test: f"coalesce(string_agg(([{names}])[kind + 1] || ':' || start_ || ':' || end_, ',' ORDER BY start_, kind, end_) FILTER (WHERE {test}), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {i})::BIGINT AS n_{k}" for i, k in enumerate(STRONG))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS ({parts}),
f AS (SELECT c.* FROM p c WHERE c.kind < {n} OR (
  EXISTS (SELECT 1 FROM p o WHERE o.doc_id = c.doc_id AND abs(o.start_ - c.start_) <= {SCOPE} AND ({near}))
  AND NOT EXISTS (SELECT 1 FROM p o WHERE o.doc_id = c.doc_id AND o.kind < {n} AND o.start_ < c.end_ AND c.start_ < o.end_)))
SELECT d.doc_id, {counts}, sha256({listing(f"kind < {n}")}) AS base_sha256, {listing("kind IS NOT NULL")} AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


ORACLE_SQL = _oracle()
