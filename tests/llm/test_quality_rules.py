import random
from collections import Counter, defaultdict

from seqlake.llm import quality_rules as Q
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, len(t or ""), "x", "y") for i, t, s in rows], SCHEMA)


def norm(line):
    return " ".join(brute.WORD.findall(line)).lower()


def plain(rows, min_texts, max_share, min_left):
    texts, lines = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if norm(line):
                lines[host, norm(line)].add(text)
    often = {k for k, v in lines.items() if len(v) > min_texts and len(v) > max_share * len(texts[k[0]])}
    out = []
    for i, text, host in rows:
        text = text or ""
        words = brute.WORD.findall(text)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {j for a in range(len(words) - 2) if grams[tuple(words[a : a + 3])] > 1 for j in (a, a + 1, a + 2)}
        full = [x for x in text.split("\n") if brute.WORD.search(x)]
        symbols = sum(c in "#*$%&|<>" for c in text)
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        removed = sum(len(brute.WORD.findall(x)) for x in text.split("\n") if (host, norm(x)) in often)
        kept = not failed and len(words) - removed >= min_left * len(words)
        out.append((i, len(words), sum(map(len, words)), symbols, len(full) - len(set(full)), len(repeated), failed, removed, kept))
    return sorted(out, key=str), often


def corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdéñ😀#") for _ in range(rng.randint(1, 6)))
    common = ["Sign up  here for more of the same news", " ".join(word() for _ in range(40))]
    rows = []
    for i in range(120):
        body = [" ".join(word() for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.5:
            body.insert(rng.randrange(len(body) + 1), common[0].upper() if i % 3 else common[0])
        if rng.random() < 0.4:
            body.append(common[1])
        if rng.random() < 0.2:
            body += body[:2]
        rows.append((i, "\n".join(body), rng.choice(["a", "a", "b", None])))
    rows += [(500, None, "a"), (501, "", None), (502, "\n \t\n", "b"), (503, "w " * 300_000, "a"), (504, "one two three", "a")]
    return rows + [(7, rows[7][1], rows[7][2])] + [(600 + i, rows[8][1], "a") for i in range(40)]


def test_against_plain_rules(spark, monkeypatch):
    rows = corpus()
    expected, often = plain(rows, 10, 0.1, 0.5)
    assert len(often) > 2
    got = sorted((tuple(r) for r in Q.judge(frame(spark, rows)).collect()), key=str)
    assert got == expected
    assert any(not e[-3] and not e[-1] for e in expected) and any(e[-1] for e in expected)


def test_cleaned_documents(spark):
    rows = corpus()
    expected, often = plain(rows, 10, 0.1, 0.5)
    docs = frame(spark, rows)
    cleaned = Q.clean_documents(docs)
    assert cleaned.columns == docs.columns
    found = cleaned.collect()
    assert sorted(r.doc_id for r in found) == sorted(e[0] for e in expected if e[-1])
    source = {i: (t, s) for i, t, s in rows}
    for r in found:
        text, host = source[r.doc_id]
        assert r.text == "\n".join(x for x in text.split("\n") if (host, norm(x)) not in often)
        assert r.n_chars == len(r.text)
    assert Q.clean_documents(frame(spark, [])).count() == 0 and Q.judge(frame(spark, [])).count() == 0
