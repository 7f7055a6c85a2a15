import random
from collections import Counter

import corpus_pipeline
from seqlake.llm import neardup
from tests.llm import brute


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(0)
    text = lambda n: "\n".join(" ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(12)) for _ in range(n))
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(i, text(8), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace("a", "b", 1), "en", "s0", 0) for i in range(10)]
    rows += [(200 + i, text(6) + "\n" + item, "en", "s1", 0) for i in range(5)]
    rows += [(300, None, None, None, None), (301, "short", "en", "s2", 5), (302, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = docs, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{n}")
        now = spark.read.parquet(f"{tmp_path}/stage{n}")
        kept.append(Counter(r.doc_id for r in now.collect()))
    assert set(kept[0]) == {r[0] for r in rows if r[0] < 300}
    assert set(kept[1]) == {r[0] for r in rows if r[0] < 100 or 200 <= r[0] < 300}
    assert set(kept[2]) == set(range(60))
    assert set(kept[3]) <= set(range(60)) and 1 <= max(kept[3].values()) <= 2
    assert kept[4] == kept[3]
    run = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert run == kept[4]


def test_near_duplicates_follow_the_default_sizes(spark):
    rng = random.Random(3)
    base = ["w%d" % rng.randrange(10**6) for _ in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:50], "x", *base[51:]])), (3, " ".join([*base[:30], *("y%d" % i for i in range(20)), *base[50:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.jaccard_components(rows, percent=neardup.PERCENT, size=neardup.NGRAM)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()} == expected
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(docs).collect()) == [1, 3]
