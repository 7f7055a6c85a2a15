"""Small pieces for the two trained scores: bounded labelled samples, held-out folds, logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted on, at most.
SAMPLE_ROWS = 6_000


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and label of at most rows labelled training documents, chosen by a hash of doc_id.

    The chosen ids are few, as stated by rows, so they are broadcast and the documents stay where they are.
    Labels other than 0 and 1 are left out; of several labels of one document the highest counts, and of several
    texts the one with the least hash. A null text is empty; a label without a document, and a null doc_id, are left
    out; an empty table on either side gives an empty sample.
    """
    chosen = (
        labels.where(training & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .withColumnRenamed("doc_id", "chosen")
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text"))).alias("one")
    return found.groupBy("doc_id").agg(one, F.max("label").alias("label")).select("doc_id", "one.text", "label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights, the bias last, by Newton's method; without both labels, the bias alone."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[-1] = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return w
    ridge = np.full(x.shape[1], penalty * len(y) / 100)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
