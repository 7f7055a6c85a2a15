"""The two trained scores: held-out accuracy on the driver's tables, and cases with defined results."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.llm import quality_model, toxicity
from seqlake.llm.learning import fit_logistic, fold

DATA = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
EDGES = [(1, None), (2, ""), (3, "word"), (4, "stupid " * 300_000), (5, "\n\n. !"), (5, "\n\n. !"), (None, "you idiot")]


def held_out(spark, module, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = module.query(spark, DATA).where("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    y, s = np.array([r[label] for r in rows]), np.array([r["score"] for r in rows])
    assert s.min() >= 0 and s.max() <= 1
    return np.mean([r["predicted"] == r[label] for r in rows]), np.mean(s[y == 1][:, None] > s[y == 0][None, :])


@needs_data
def test_held_out_quality(spark):
    accuracy, order = held_out(spark, quality_model, "quality")
    assert accuracy > 0.97 and order > 0.97


@needs_data
def test_held_out_toxicity(spark):
    accuracy, order = held_out(spark, toxicity, "toxic")
    assert accuracy > 0.97 and order > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark):
    """Turning the held-out labels round changes no score."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"{'you idiot' if i % 3 == 0 else 'good day'} w{i} ### " * (i % 7 + 1), "x") for i in range(90)], "doc_id long, text string, row string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    for module, label, training in ((quality_model, "quality", fold(4) != 2), (toxicity, "toxic", fold(5) != 0)):
        turned = labels.withColumn(label, F.when(training, F.col(label)).otherwise(1 - F.col(label)))
        found = []
        for some in (labels, turned):
            model = module.fit(docs, some, training)
            scored = module.score(docs, *(model if isinstance(model, tuple) else (model,)))
            found.append({r.row.doc_id: r.score for r in scored.collect()})
        assert found[0] == found[1] and len(set(found[0].values())) > 1


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in EDGES], "doc_id long, text string, row string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality_model, toxicity):
        model = module.fit(docs, labels, fold(4) != 2)
        model = model if isinstance(model, tuple) else (model,)
        scored = module.score(docs, *model, keep=("doc_id", "score")).collect()
        assert len(scored) == len(EDGES) and all(0 <= r.score <= 1 for r in scored)
        assert module.score(docs.limit(0), *model).count() == 0


def test_training_takes_every_passage(spark, monkeypatch):
    """Of a very long document too, and the same passages that scoring takes."""
    n = 200
    docs = spark.createDataFrame([(1, "word " * 64 * n + "end"), (2, "a b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_model.GatedAttention, "fit", lambda self, documents, label: seen.extend(map(len, documents)))
    quality_model.fit(docs, labels, F.lit(True))
    assert seen == [n + 1, 1, 1]


def test_clauses():
    """The composed machine tells plain, aimed, negated and reported harm apart."""
    grammar = toxicity.Grammar([])

    def pattern(text):
        data = np.frombuffer(text.encode(), np.uint8)
        found = grammar.features(data, np.array([0, len(data)]))[0, : toxicity.N_PATTERNS - 1]
        return np.flatnonzero(found).tolist()

    assert pattern("a fine day") == []
    assert pattern("what an idiot") == [0]
    assert pattern("you are an idiot") == [3]
    assert pattern("you are not an idiot") == [4]
    assert pattern("he said that idiot came") == [5]
    assert pattern("i will kill you") == [9]
    assert pattern("not now. idiot") == [0]
    assert pattern("an idiot. you came") == [0]
    negated = b"you are not an idiot"
    found = grammar.features(np.frombuffer(negated, np.uint8), np.array([0, len(negated)]))[0]
    assert found[toxicity.N_PATTERNS - 1 : -1].tolist() == [0, 0, 0]  # only plain clauses count towards the rest


def test_learned_threats_and_targets(spark):
    """A word that follows an announcement is a threat, others are insults, and the word that stands before them is a target."""
    fine = "and the fine words of a long and quiet day " * 4
    rows = [(i, f"day {i} they will zorkle the town. gorp blerg here {fine}" if i % 2 else f"day {i} they will see the town. gorp is here {fine}", i % 2) for i in range(40)]
    rows += [(100 + i, f"so gorp blerg number {i}", 1) for i in range(20)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    learned = {(w, whole): symbol for w, whole, _, symbol in toxicity.learn_lexicon(sample)}
    assert learned["zorkle", True] == toxicity.THREAT and learned["blerg", True] == toxicity.INSULT and learned["gorp", True] == toxicity.TARGET
    assert ("town", True) not in learned and toxicity.learn_lexicon(sample.where("label = 0")) == []


def test_attention_gradients():
    rng = np.random.default_rng(0)
    net = quality_model.GatedAttention(5)
    x, doc, y = rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.predict(x, doc, 3)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net._gradients(net.forward(x, doc, 3), doc, y)
    for k, g in grads.items():
        for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(4)]:
            old = net.p[k][at]
            net.p[k][at] = old + 1e-6
            up = loss()
            net.p[k][at] = old - 1e-6
            down = loss()
            net.p[k][at] = old
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] - 2 * x[:, 1] > 0).astype(float)
    w = fit_logistic(x, y)
    assert np.mean((x @ w[:-1] + w[-1] > 0) == y) > 0.97
    assert fit_logistic(x[:0], y[:0])[-1] == 0 and fit_logistic(x, np.ones(500))[-1] > 0
