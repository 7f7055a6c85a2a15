import pytest

from seqlake.llm import decontaminate as D
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, found string, row string"
ITEM = "One two three four five six seven eight nine ten eleven"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], DOCS)


def digest(found):
    return sorted([tuple(r) for r in found.collect()], key=str)


@pytest.fixture
def query(spark, monkeypatch):
    def run(docs, items):
        tables = {"documents": frame(spark, docs), "benchmark": spark.createDataFrame(items, "item_id long, text string")}
        monkeypatch.setattr(D, "table", lambda s, d, name: tables[name])
        return digest(D.query(spark, ""))

    return run


CASES = [
    (1, "zero ONE two, three-four five six seven eight nine ten eleven twelve"),
    (2, "one two three four five six seven eight nine eleven"),
    (3, None),
    (4, ""),
    (5, "ünï çode naïve short item here"),
    (6, "short item " * 400),
    (6, "short item " * 400),
    (7, "x" * 3_000_000 + " two three four five six seven eight nine ten eleven"),
    (None, "short  ITEM"),
]


def test_against_brute_force(query):
    items = [(10, ITEM), (9, "short item"), (11, None), (12, "..."), (13, ITEM + " x"), (14, "ünï Çode")]
    assert query(CASES, items) == brute.contamination(CASES, items)


def test_many_pieces(query, monkeypatch):
    items = [(i, f"{ITEM} w{i} short item") for i in range(20)] + [(99, "short item")]
    whole = query(CASES, items)
    monkeypatch.setattr(D, "MAX_BROADCAST_BYTES", 200)
    assert query(CASES, items) == whole == brute.contamination(CASES, items)


def test_items_without_an_id_give_hits(query, spark, monkeypatch):
    docs = [(1, ITEM), (2, "a short item"), (3, "clean")]
    items = [(None, ITEM), (7, "short item")]
    hits = {r[0]: (r[2], r[3], r[5]) for r in query(docs, items)}
    assert hits == {1: (11, 0, True), 2: (2, 1, True), 3: (0, 0, False)}
    monkeypatch.setattr(D, "MAX_BROADCAST_BYTES", 10)
    assert {r[0]: (r[2], r[3], r[5]) for r in query(docs, items)} == hits
    kept = D.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [3]


def test_empty_tables(query):
    assert query([], [(1, ITEM)]) == []
    assert [r[2:4] for r in query([(1, ITEM)], [])] == [(0, 0)]


def test_documents_and_spans(spark):
    docs, items = frame(spark, CASES), spark.createDataFrame([(9, "short item")], "item_id long, text string")
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7]
    cut = {r.doc_id: r.text for r in D.remove_spans(docs, items).collect()}
    assert cut[5] == "ünï çode naïve  here" and cut[1] == CASES[0][1]
