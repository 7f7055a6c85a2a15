"""Toxicity: a weighted finite-state grammar over the clauses of a text.

Words are mapped to symbols (insult, threat, target, negation, report, other). Small transducers, one for each
aspect of a clause, are composed into one machine; run over a clause, it says which pattern the clause is: an
insult or a threat, aimed at a target or not, and plain, negated or reported. The words' weights are those of the
machine's arcs, and add up to the weight of the clause; the fitted weight of the pattern is that of its final state. A
document's score is a logistic function of its matched clauses: nothing counts that no clause has matched. Besides
the fixed words, the lexicon holds words and word beginnings learned from the labelled training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.bytescan import Words, blocks, find_words, hash_ranges, prefix_sums
from seqlake.llm.common import table
from seqlake.llm.learning import SAMPLE_ROWS, fit_logistic, fold, labelled_sample, sigmoid

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Words that have a meaning in the grammar.
LEXICON = {
    INSULT: "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown idiota estúpido basura imbécile crétin ordure dummkopf abschaum trottel",
    THREAT: "kill hurt destroy punch shoot stab beat töten schlagen tuer frapper matar golpear",
    TARGET: "you your yours yourself they them he him she her du dich dein ihr euch tu te toi ton vous votre tú ti usted ustedes vosotros",
    NEGATION: "not never nobody isn't aren't don't nicht kein keine nie jamais nunca jamás",
    REPORT: "said says say wrote writes claimed quoted called reported sagte schrieb nannte behauptete dit écrit appelé dijo escribió llamó",
}
#: Words that announce a deed: a learned word that mostly follows one of them is a threat.
INTENT = "will gonna shall i'll we'll werde werden voy vamos vais"
#: Letters of a learned word beginning, at least and at most.
STEM_LENGTHS = (5, 8)
#: A word or beginning is learned if it is in this share of the toxic training texts, and this many times as likely there.
MIN_SUPPORT, MIN_RATIO = 0.015, 6.0
#: Words after a negation or a report that it covers.
REACH = 4

IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = True
IS_LETTER[128:] = True
IS_LETTER[ord("'")] = True
IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[[ord(c) for c in ".!?;\n"]] = True

ORACLE_SQL = None


# A transducer is (start, step, value): step(state, symbol) is the next state, value(state) its output at the end.
def _harm():
    """The gravest symbol of the clause so far: none, insult, threat."""
    return 0, lambda s, x: max(s, {INSULT: 1, THREAT: 2}.get(x, 0)), lambda s: s


def _target():
    return 0, lambda s, x: int(s or x == TARGET), lambda s: s


def _covered(symbol: int):
    """Whether some harm lies within REACH words after the symbol, and none outside."""

    def step(state, x):
        left, inside, outside = state
        harm = x in (INSULT, THREAT)
        left = REACH if x == symbol else max(0, left - 1)
        return left, inside or (harm and left > 0), outside or (harm and left == 0)

    return (0, False, False), step, lambda s: int(s[1] and not s[2])


@lru_cache(maxsize=1)
def clause_machine() -> tuple[np.ndarray, np.ndarray]:
    """The composition of the transducers: next state by state and symbol, and each state's pattern.

    Pattern 0 is no harm; else 1 + (threat) * 6 + (target) * 3 + (0 plain, 1 negated, 2 reported).
    """
    parts = (_harm(), _target(), _covered(NEGATION), _covered(REPORT))
    start = tuple(p[0] for p in parts)
    number, queue, table_ = {start: 0}, [start], []
    for state in queue:
        row = []
        for symbol in range(6):
            to = tuple(p[1](s, symbol) for p, s in zip(parts, state, strict=True))
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
        table_.append(row)
    outputs = []
    for state in queue:
        harm, target, negated, reported = (p[2](s) for p, s in zip(parts, state, strict=True))
        outputs.append(0 if not harm else 1 + (harm == 2) * 6 + target * 3 + (2 if reported else 1 if negated else 0))
    return np.array(table_), np.array(outputs)


N_PATTERNS = 13
#: Patterns that are neither negated nor reported.
PLAIN = [p for p in range(N_PATTERNS - 1) if p % 3 == 0]
N_FEATURES = N_PATTERNS - 1 + 4


class Grammar:
    """The lexicon as hashes of words and word beginnings, with symbols and weights."""

    def __init__(self, learned: list[tuple[str, bool, float, int]]):
        """learned: (word or beginning, whether it is a whole word, weight, symbol)."""
        entries = [(w, True, 3.0 if s in (INSULT, THREAT) else 0.0, s) for s, line in LEXICON.items() for w in line.split()]
        known = {w for w, *_ in entries}
        entries += [entry for entry in learned if not (entry[1] and entry[0] in known)]
        self.words = self._table([e for e in entries if e[1]])
        lengths = sorted({len(e[0].encode()) for e in entries if not e[1]})
        self.stems = {n: self._table([e for e in entries if not e[1] and len(e[0].encode()) == n]) for n in lengths}

    @staticmethod
    def _table(entries):
        raw = [e[0].encode() for e in entries]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        h = hash_ranges(prefix_sums(data), ends - [len(r) for r in raw], ends)
        order = np.argsort(h)
        return h[order], np.array([e[3] for e in entries])[order], np.array([e[2] for e in entries], dtype=float)[order]

    def symbols(self, data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The symbol and weight of each word. data is in lower case."""
        sums = prefix_sums(data)
        symbol, weight = np.zeros(len(words.start), dtype=np.int8), np.zeros(len(words.start))

        def look(rows, end, entry):
            known, symbols, weights = entry
            if not len(known) or not len(rows):
                return
            h = hash_ranges(sums, words.start[rows], end)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            rows, at = rows[hit], at[hit]
            better = weights[at] >= weight[rows]
            symbol[rows[better]], weight[rows[better]] = symbols[at[better]], weights[at[better]]

        for n, entry in self.stems.items():
            rows = np.flatnonzero(words.end - words.start > n)
            look(rows, words.start[rows] + n, entry)
        look(np.arange(len(words.start)), words.end, self.words)
        return symbol, weight

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row per document: summed weights by clause pattern; then, of the clauses that are neither negated nor
        reported, the weight by words, the gravest and their number; and the length of the text."""
        n = len(offsets) - 1
        out = np.zeros((n, N_FEATURES))
        words = find_words(data, offsets, IS_LETTER)
        if not len(words.start):
            return out
        symbol, weight = self.symbols(data, words)
        breaks = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(IS_BREAK[data], out=breaks[1:])
        clause = breaks[words.start] + words.doc  # rises at each break and at each document
        harm = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        first = np.flatnonzero(np.diff(clause, prepend=-1))
        last = np.append(first[1:], len(clause))
        which = np.unique(np.searchsorted(first, harm, "right") - 1)
        step, pattern = clause_machine()
        counts = np.bincount(words.doc, minlength=n)
        strong, times = np.zeros(n), np.zeros(n)
        for c in which.tolist():
            a, b, state = first[c], last[c], 0
            for x in symbol[a:b].tolist():
                state = step[state, x]
            doc, found, grave = words.doc[a], pattern[state] - 1, weight[a:b].sum()
            out[doc, found] += grave
            if found in PLAIN:
                strong[doc] = max(strong[doc], grave)
                times[doc] += 1
        total = out[:, PLAIN].sum(axis=1)
        out[:, : N_PATTERNS - 1] = np.log1p(out[:, : N_PATTERNS - 1])
        rest = [100 * total / np.maximum(counts, 30) / 5, strong, np.log1p(times), np.log1p(counts) / 5]
        out[:, N_PATTERNS - 1 :] = np.stack(rest, axis=1)
        return out


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool, float, int]]:
    """Words and beginnings that mark the toxic texts of the sample, as Grammar() takes them, and the words aimed at.

    A weight is the logarithm of how much likelier a term is in toxic texts. A term that follows a word of INTENT at half of its
    places or more is a threat, else an insult. A word that stands directly before such a term MIN_RATIO times as often as
    words do on average is a target. All terms above the two thresholds are taken; how many, the bounded sample bounds.
    """
    texts = sample.select(F.lower("text").alias("text"), "label").dropDuplicates(["text"]).withColumn("id", F.xxhash64("text"))
    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    texts = texts.select("id", "label", F.regexp_extract_all("text", F.lit(r"[\p{L}']+"), F.lit(0)).alias("found"))
    low, high = STEM_LENGTHS
    begin = F.transform(
        F.sequence(F.lit(low), F.lit(high)), lambda k: F.when(F.length("word") > k, F.concat(F.substring("word", F.lit(1), k), F.lit("*")))
    )
    before = F.concat(F.array(F.lit("")), "found")  # one longer, which leaves a pair without a word
    placed = texts.select("id", "label", F.explode(F.arrays_zip(before.alias("before"), F.col("found").alias("word"))).alias("pair"))
    meant = F.max(F.col("pair.before").isin(sorted(set(INTENT.split()))).cast("int"))
    uses = placed.where("pair.word is not null").groupBy("id", "label", F.col("pair.word").alias("word")).agg(F.lit(1).alias("n"), meant.alias("meant"))
    terms = uses.select("id", "label", "n", "meant", F.explode(F.concat(F.array("word"), begin)).alias("term")).where("term is not null")
    each = terms.groupBy("id", "label", "term").agg(F.sum("n").alias("n"), F.sum("meant").alias("meant"))
    counted = each.groupBy("term").agg(
        F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"), F.sum(F.col("n") * F.col("label")).alias("n"), F.sum(F.col("meant") * F.col("label")).alias("meant")
    )
    ratio = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1))
    least = max(4, MIN_SUPPORT * toxic)
    strong = counted.where((F.col("t") >= least) & (ratio >= MIN_RATIO)).withColumn("weight", F.log(ratio)).orderBy("term").collect()
    learned = [(r["term"].rstrip("*"), not r["term"].endswith("*"), float(r["weight"]), THREAT if 2 * r["meant"] >= r["n"] else INSULT) for r in strong]
    harm = sorted({w for w, whole, *_ in learned if whole} | set(f"{LEXICON[INSULT]} {LEXICON[THREAT]}".split()))
    both = F.explode(F.arrays_zip(F.col("found").alias("before"), F.slice("found", 2, F.size("found")).alias("word"))).alias("pair")
    pairs = texts.where("label = 1 and size(found) > 1").select(both).select("pair.before", F.col("pair.word").isin(harm).cast("int").alias("hit"))
    near = pairs.groupBy("before").agg(F.sum("hit").alias("hit"), F.count("*").alias("n"))
    all_ = near.agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).first()
    rate = (all_["hit"] or 0) / (all_["n"] or 1)
    aimed = near.where((F.col("hit") >= least) & (F.col("hit") >= MIN_RATIO * rate * F.col("n"))).orderBy("before").collect()
    known = {w for w, *_ in learned} | {w for line in (*LEXICON.values(), INTENT) for w in line.split()}
    return learned + [(r["before"], True, 0.0, TARGET) for r in aimed if r["before"] not in known]


def _features(grammar, text_at: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.vstack([grammar.features(b.data, b.offsets) for b in blocks(batch.column(text_at))] or [np.zeros((0, N_FEATURES))])
            rows = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
            kept = [c for i, c in enumerate(batch.columns) if i != text_at]
            names = [c for i, c in enumerate(batch.schema.names) if i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, rows], names=[*names, "features"])

    return scan


def fit(docs: DataFrame, labels: DataFrame, training, rows: int = SAMPLE_ROWS) -> tuple[Grammar, np.ndarray]:
    """A grammar and the weights of its features, from at most rows labelled training documents."""
    sample = labelled_sample(docs, labels, "toxic", training, rows)
    grammar = Grammar(learn_lexicon(sample))
    schema = "label int, features array<double>"
    lower = sample.select(F.lower("text").alias("text"), F.col("label").cast("int").alias("label"))
    got = lower.mapInArrow(_features(grammar, 0), schema).toPandas()
    x = np.array(got["features"].tolist()).reshape(-1, N_FEATURES)
    return grammar, fit_logistic(x, got["label"].to_numpy(float))


def score(docs: DataFrame, grammar: Grammar, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`row`, a struct of the columns to keep, and `score` between 0 and 1, for each row of docs.

    Defined results: a null or empty text has the score of a text without words; texts are scored whole;
    equal texts have equal scores; an empty table gives an empty result.
    """
    packed = docs.select(F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    scan = _features(grammar, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(batches):
            x = np.asarray(batch.column(1).flatten()).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(x @ weights[:-1] + weights[-1]))], names=["row", "score"])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document scored by a grammar fitted on the other folds; without labels all scores are equal."""
    docs = table(spark, sf_dir, "documents")
    grammar, weights = fit(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    scored = score(docs, grammar, weights).select("row.doc_id", "score")
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
