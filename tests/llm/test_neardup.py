import random

import numpy as np
import pytest

from seqlake.llm import neardup as N
from seqlake.llm.components import connected_components
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, node string, n long, task string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", 1, "y") for i, t in rows], SCHEMA)


def got(spark, rows, percent=85, size=4):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(frame(spark, rows), size, percent).collect()}


def corpus(seed, groups=12, copies=9):
    """Groups of edited copies of invented texts, with passages that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    shared = [word() for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 60, 150]))]
        if rng.random() < 0.5:
            base += shared
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows) * 7 % 1000, rng.choice([" ", "\n", "\t "]).join(text).title()))
    return rows


EDGES = [(2001, None), (2002, ""), (2003, " \n"), (2004, "one"), (2005, "ONE"), (2006, "a b c"), (2007, "a b c d"), (2008, "word " * 200_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + EDGES
    assert got(spark, rows) == brute.jaccard_components(rows)


def test_long_lists_and_small_blocks(spark, monkeypatch):
    """Every list is a star and every group takes many blocks, with the same result."""
    monkeypatch.setattr(N, "MAX_LIST", 2)
    monkeypatch.setattr(N, "BLOCK_CLASSES", 3)
    monkeypatch.setattr(N, "FREQUENT", 2)
    rows = corpus(3, groups=8, copies=14)
    assert got(spark, rows) == brute.jaccard_components(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F"), (None, "a b c d e f"), (7, None)]
    found = sorted((tuple(r) for r in N.near_duplicates(frame(spark, rows), 4, 85).collect()), key=str)
    assert found == sorted([(5, 3, 3), (5, 3, 3), (3, 3, 3), (None, 3, None), (7, 0, 7)], key=str)
    kept = N.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 7, None]
    assert got(spark, []) == {}


@pytest.mark.parametrize("classes", [3, 512])
def test_every_link_is_counted(spark, monkeypatch, classes):
    """Groups within a block and over many: each document's links, copies among them, against all pairs."""
    monkeypatch.setattr(N, "BLOCK_CLASSES", classes)
    monkeypatch.setattr(N, "MAX_LIST", 4)
    rows = corpus(5, groups=6, copies=14)
    rows += [(i + 1, t) for i, t in rows[::3]] + EDGES
    sets = {i: brute_grams(t) for i, t in rows}
    expected = {i: sum(j != i and bool(a) and 100 * len(a & b) >= 85 * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    assert max(expected.values()) > 9
    rows += [rows[0], (None, rows[0][1])]
    found = N.near_duplicates(frame(spark, rows), 4, 85, count_links=True)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "n_links"] and found.count() == len(rows)
    assert {r.doc_id: r.n_links for r in found.collect()} == expected | {None: 0}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.where("doc_id is not null").collect()} == brute.jaccard_components(rows[:-1])


def test_sums_do_not_depend_on_what_comes_before():
    sets = np.random.default_rng(1).integers(0, 1 << 63, 90).astype(np.uint64)
    twice = N.set_sums(np.concatenate([sets[:70], sets[70:], sets[70:]]), np.array([0, 70, 90, 110]))
    assert all(s[1] == s[2] for s in twice)


def brute_grams(text, size=4):
    w = brute.WORD.findall((text or "").translate(brute.LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def test_list_scan_across_batches():
    """A list that runs over many batches gives the same links as in one."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    gram = np.sort(np.concatenate([rng.integers(0, 40, 200), np.full(700, 41), [42] * 5]))
    node, n = np.arange(len(gram)), np.full(len(gram), 10)

    def scan(step):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + step]) for x in (gram, node, n)], names=["gram", "node", "n"]) for i in range(0, len(gram), step)]
        out = set()
        for b in N._candidates(85)(iter(batches)):
            out |= set(zip(*(c.to_pylist() for c in b.columns), strict=True))
        return out

    assert scan(7) == scan(100) == scan(10_000)
    assert sum(star for *_, star in scan(7)) == 699


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(500, 560)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = sorted({x for pair in links if pair[0] != pair[1] for x in pair})
    assert found == {k: v for k, v in brute.components(nodes, [x for x in links if x[0] != x[1]]).items()}


def test_frequent_grams_are_counted_over_all_documents(spark, monkeypatch):
    """More documents than any sample: each word is held by four, and one by eight more."""
    texts = spark.range(30_000).selectExpr("id AS doc_id", "concat('w', id DIV 4) AS text")
    texts = texts.union(spark.range(8).selectExpr("id + 30000", "'w7'"))
    grams, held = N._frequent(texts, 4, 85)
    assert len(grams) == 7500 and sorted(held.tolist()) == [4] * 7499 + [12] and np.all(grams[:-1] < grams[1:])
    # No more than fit: the one that most documents hold, and of the others all or none.
    monkeypatch.setattr(N, "MAX_FREQUENT", 7499)
    assert N._frequent(texts, 4, 85)[1].tolist() == [12]
    monkeypatch.setattr(N, "MAX_FREQUENT", 0)
    assert [len(x) for x in N._frequent(texts, 4, 85)] == [0, 0]
