"""URL filter: all wildcard rules at once, as one bit-parallel automaton over each canonical URL.

The canonical URL is the lower-cased host followed by the path. Patterns are packed into the bits of a few
64-bit words (Shift-And): one step per byte moves the states of every pattern, and of a whole batch of URLs.
In a pattern `*` is any run of bytes without a slash, `**` any run, and `?` one byte but a slash; the whole
URL has to match.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.bytescan import blocks
from seqlake.llm.common import table

#: Host with path prefix, and what follows from the longest that fits.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
#: Where no rule fits, a URL that any of these match is blocked.
BLOCKED = ("**spam-farm**", "**cheap-pills**", "**casino**", "**adult-x**", "**free-bets**", "*/**.exe")


class ShiftAnd:
    """Patterns packed into masks; run() gives for each URL one bit per pattern."""

    def __init__(self, patterns: Sequence[str]):
        n = 0
        self.starts, self.ends = [], []
        step, loop = {}, {}
        slashless = np.ones(256, dtype=bool)
        slashless[ord("/")] = False
        for pattern in patterns:
            self.starts.append(n)
            raw, i = pattern.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    loop[n] = np.ones(256, dtype=bool)
                    i += 2
                    continue
                if raw[i : i + 1] == b"*":
                    loop[n] = loop.get(n, np.zeros(256, dtype=bool)) | slashless
                else:
                    n += 1
                    step[n] = slashless if raw[i : i + 1] == b"?" else np.arange(256) == raw[i]
                i += 1
            self.ends.append(n)
            n += 1
        self.words = max(1, -(-n // 64))
        self.begin = np.zeros(self.words, dtype=np.uint64)
        for s in self.starts:
            self.begin[s // 64] |= np.uint64(1 << (s % 64))
        self.step, self.loop = self._masks(step), self._masks(loop)

    def _masks(self, allowed: dict[int, np.ndarray]) -> np.ndarray:
        """For each byte, the states that it may lead to."""
        out = np.zeros((256, self.words), dtype=np.uint64)
        for state, which in allowed.items():
            out[which, state // 64] |= np.uint64(1 << (state % 64))
        return out

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A boolean per URL and pattern. URLs are taken longest first, so that those still running lie in front."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        at, length = offsets[:-1][order], length[order]
        states = np.tile(self.begin, (len(order), 1))
        running = len(order)
        for t in range(int(length[0]) if len(order) else 0):
            while running and length[running - 1] <= t:
                running -= 1
            byte = data[at[:running] + t]
            now = states[:running]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            states[:running] = (moved & self.step[byte]) | (now & self.loop[byte])
        out = np.zeros((len(order), len(self.ends)), dtype=bool)
        for p, end in enumerate(self.ends):
            out[order, p] = (states[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1) == 1
        return out


def match_patterns(df: DataFrame, subject: Column, patterns: Sequence[str]) -> DataFrame:
    """`row`, a struct of df's columns, and `matched`, the numbers of the patterns that the subject matches.

    A null subject is empty, and an empty one matches only patterns of nothing but stars.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), subject.cast("string").alias("subject"))
    schema = T.StructType([packed.schema[0], T.StructField("matched", T.ArrayType(T.IntegerType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(patterns)
        for batch in batches:
            counts, numbers = [np.zeros(1, dtype=np.int64)], []
            for block in blocks(batch.column(1)):
                url, pattern = np.nonzero(automaton.run(block.data, block.offsets))
                counts.append(np.bincount(url, minlength=block.last - block.first))
                numbers.append(pattern)
            values = pa.array(np.concatenate(numbers or [np.zeros(0)]).astype(np.int32))
            matched = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), matched], names=["row", "matched"])

    return packed.mapInArrow(scan, schema)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, with A to Z lower-cased, and the path; both empty for null or without `://`."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mark = F.instr(url, "://")
    rest = F.coalesce(F.when(mark > 0, F.substring(url, mark + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), capitals, capitals.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """The rows of pages with host, path, rule and verdict, in place of columns of those names.

    Defined results: a null url, or one without `://`, has an empty host and path, matches nothing and is
    allowed; URLs of any length and repeated rows are judged alike; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    ours = ("host", "path", "rule", "verdict")
    rest = [c for c in pages.columns if c not in ours]
    split = pages.select(*[F.col(f"`{c}`") for c in rest], host.alias("host"), path.alias("path"))
    # Longest first, each for the host itself and for all its subdomains; then the blocked patterns.
    ranked = sorted(rules, key=lambda r: -len(r[0]))
    patterns = [p for r, _ in ranked for p in (f"{r}**", f"*.{r}**")] + list(blocked)
    found = match_patterns(split, F.concat("host", "path"), patterns)
    first = F.array_min("matched")
    fits = lambda i: first.isin(2 * i, 2 * i + 1)
    rule = F.coalesce(*[F.when(fits(i), r) for i, (r, _) in enumerate(ranked)], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(fits(i), v) for i, (_, v) in enumerate(ranked)], F.when(first.isNotNull(), "block"), F.lit("allow"))
    return found.select("row.*", rule.alias("rule"), verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)?', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
                            ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) AS v(h, pre, what)),
f AS (SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(what, length(h || pre)) AS what
      FROM q JOIN r ON (host = h OR suffix(host, '.' || h)) AND prefix(path, pre) GROUP BY page_id)
SELECT q.page_id, host, path, rule,
       coalesce(what, CASE WHEN contains(host || path, 'spam-farm') OR contains(host || path, 'cheap-pills')
                             OR contains(host || path, 'casino') OR contains(host || path, 'adult-x')
                             OR contains(host || path, 'free-bets')
                             OR regexp_matches(host || path, '^[^/]*/(?s:.*)\.exe$') THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN f USING (page_id)
"""
