"""Quality classifier: gated attention over the passages of a document (multiple-instance learning).

A text is cut into passages of some words; each is encoded by counts of its bytes and words. A small network
maps each passage to a hidden vector, gives it an attention weight by a tanh unit gated by a sigmoid unit,
and scores the weighted mean. Only document labels are needed: the attention learns which passages matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.bytescan import LOWER, SPACE, blocks, find_words, hash_ranges, prefix_sums
from seqlake.llm.common import table
from seqlake.llm.learning import SAMPLE_ROWS, fold, labelled_sample, sigmoid

PASSAGE_WORDS = 64
HIDDEN, ATTENTION = 16, 8
EPOCHS, BATCH, RATE, SEED = 60, 128, 0.01, 7
THRESHOLD = 0.7

ORACLE_SQL = None


def _classes() -> list[np.ndarray]:
    groups = ["".join(map(chr, range(65, 91))), "0123456789", "#", "*", "$", "%", "&", "|", "<>", "!", ".,;:?", "'\"()", "\n", "=/_-@"]
    out = []
    for g in groups:
        member = np.zeros(256, dtype=bool)
        member[[ord(c) for c in g]] = True
        out.append(member)
    beyond = np.zeros(256, dtype=bool)
    beyond[128:] = True
    return [*out, beyond]


CLASSES = _classes()
#: Byte shares; mean length, spread, distinct words, words equal to the last or the one before, the commonest word; length in words and of the document.
N_FEATURES = len(CLASSES) + 8


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the document of each; a document without words has one passage of zeros."""
    n_docs = len(offsets) - 1
    words = find_words(data, offsets, ~SPACE)
    per_doc = np.bincount(words.doc, minlength=n_docs)
    n_parts = np.maximum(1, -(-per_doc // PASSAGE_WORDS))
    first_part = np.concatenate([[0], np.cumsum(n_parts)])
    total = int(first_part[-1])
    doc_of = np.repeat(np.arange(n_docs), n_parts)
    x = np.zeros((total, N_FEATURES))
    if len(words.start):
        first_word = np.concatenate([[0], np.cumsum(per_doc)])
        within = np.arange(len(words.start)) - first_word[words.doc]
        part = first_part[words.doc] + within // PASSAGE_WORDS
        length = (words.end - words.start).astype(float)
        count = np.bincount(part, minlength=total).astype(float)
        safe = np.maximum(count, 1)
        size = np.bincount(part, weights=length, minlength=total)
        # Bytes of each passage run from its first word to the beginning of the next passage's, or the document's end.
        filled = np.flatnonzero(count)
        begins = words.start[np.searchsorted(part, filled)]
        ends = np.append(begins[1:], len(data))
        ends = np.minimum(ends, offsets[doc_of[filled] + 1])
        bytes_in = np.maximum(ends - begins, 1)
        for j, member in enumerate(CLASSES):
            sums = np.concatenate([[0], np.cumsum(member[data], dtype=np.int64)])
            x[filled, j] = (sums[ends] - sums[begins]) / bytes_in
        k = len(CLASSES)
        mean = size / safe
        x[:, k] = mean / 10
        x[:, k + 1] = np.sqrt(np.maximum(np.bincount(part, weights=length**2, minlength=total) / safe - mean**2, 0)) / 10
        h = hash_ranges(prefix_sums(LOWER[data]), words.start, words.end)
        order = np.lexsort((h, part))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (part[order][1:] != part[order][:-1])
        x[:, k + 2] = np.bincount(part[order][new], minlength=total) / safe
        for step, column in ((1, k + 3), (2, k + 4)):
            same = np.zeros(len(h), dtype=bool)
            same[step:] = (h[step:] == h[:-step]) & (part[step:] == part[:-step])
            x[:, column] = np.bincount(part, weights=same, minlength=total) / safe
        runs = np.diff(np.append(np.flatnonzero(new), len(h)))
        most = np.zeros(total)
        np.maximum.at(most, part[order][new], runs)
        x[:, k + 5] = most / safe
        x[:, k + 6] = count / PASSAGE_WORDS
    x[:, -1] = np.log1p(per_doc[doc_of]) / 8
    return x, doc_of


class GatedAttention:
    """The network; fit() trains it by Adam on whole documents of passages."""

    def __init__(self, n_features: int = N_FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {
            "W": draw(n_features, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION),
            "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1), "mean": np.zeros(n_features), "scale": np.ones(n_features),
        }

    def forward(self, x: np.ndarray, doc: np.ndarray, n: int) -> dict:
        """doc is in order and has every document from 0 to n - 1."""
        p = self.p
        x = np.clip((x - p["mean"]) / p["scale"], -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        first = np.searchsorted(doc, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, first)[doc])
        a = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": sigmoid(z @ p["c"] + p["d"][0])}

    def predict(self, x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return self.forward(x, doc, n)["y"] if n else np.zeros(0)

    def _gradients(self, f: dict, doc: np.ndarray, label: np.ndarray) -> dict:
        p, n = self.p, len(label)
        dy = (f["y"] - label) / n
        dz = dy[:, None] * p["c"]
        dh = f["a"][:, None] * dz[doc]
        da = np.sum(dz[doc] * f["h"], axis=1)
        first = np.searchsorted(doc, np.arange(n))
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[doc])
        gate = de[:, None] * p["w"]
        dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ p["V"].T + dg @ p["U"].T
        du = dh * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ du, "b": du.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
            "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "d": np.array([dy.sum()]),
        }

    def fit(self, documents: list[np.ndarray], label: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> GatedAttention:
        """documents: the passages of each. Without documents the network stays as drawn."""
        if not documents:
            return self
        every = np.vstack(documents)
        self.p["mean"], self.p["scale"] = every.mean(axis=0), every.std(axis=0) + 1e-3
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(documents))
            for i in range(0, len(order), BATCH):
                chosen = order[i : i + BATCH]
                sizes = [len(documents[j]) for j in chosen]
                doc = np.repeat(np.arange(len(chosen)), sizes)
                f = self.forward(np.vstack([documents[j] for j in chosen]), doc, len(chosen))
                t += 1
                rate = RATE * (1 - epoch / epochs)
                for k, grad in self._gradients(f, doc, label[chosen]).items():
                    grad = grad + 1e-4 * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * grad
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * grad**2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, training, rows: int = SAMPLE_ROWS) -> GatedAttention:
    """A network fitted on at most rows labelled training documents, each with all its passages."""
    sample = labelled_sample(docs, labels, "quality", training, rows).select("doc_id", "text", F.col("label").cast("int").alias("label"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = []
            for block in blocks(batch.column(1)):
                x, doc = passages(block.data, block.offsets)
                edges = np.searchsorted(doc, np.arange(block.last - block.first + 1))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    rows_.append(x[a:b].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows_, pa.binary()), batch.column(2)], names=["doc_id", "x", "label"])

    found = sorted(((r["doc_id"], bytes(r["x"]), r["label"]) for r in sample.mapInArrow(encode, "doc_id long, x binary, label int").collect()))
    documents = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES).astype(float) for _, x, _ in found]
    return GatedAttention().fit(documents, np.array([y for *_, y in found], dtype=float))


def score(docs: DataFrame, model: GatedAttention, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`row`, a struct of the columns to keep, and `score` between 0 and 1, for each row of docs.

    Defined results: a null or empty text is one passage without words; texts are scored whole; equal texts
    have equal scores; an empty table gives an empty result.
    """
    packed = docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for block in blocks(batch.column(0)):
                x, doc = passages(block.data, block.offsets)
                out[block.first : block.last] = model.predict(x, doc, block.last - block.first)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out)], names=["row", "score"])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    scored = score(docs, model).select("row.doc_id", "score")
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
