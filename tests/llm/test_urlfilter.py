import re

import numpy as np
import pytest

from seqlake.llm import urlfilter as U

URLS = [
    (1, "http://www.Example.COM/en/77?x#y"),
    (2, "https://com/en/1"),
    (3, "ftp://notcom/en/1"),
    (4, None),
    (5, "no scheme example.com/en/7"),
    (6, "http://a.example.net/de/8/9"),
    (7, "http://a.example.net/de/7"),
    (8, "http://x.org/es/#f"),
    (9, "http://spam-farm.info"),
    (10, "http://x.info/" + "a" * 100_000 + "/setup.exe"),
    (11, ""),
    (12, "http://x.com?/en/"),
    (2, "https://com/en/1"),
    (13, "http://a://b.com/en/"),
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = []
    for rule, verdict in U.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(rule), rule, verdict))
    if fit:
        return host, path, *max(fit)[1:]
    globs = [re.escape(g).replace(r"\*\*", "(?s:.*)").replace(r"\*", "[^/]*").replace(r"\?", "[^/]") for g in U.BLOCKED]
    return host, path, None, "block" if any(re.fullmatch(g, host + path) for g in globs) else "allow"


def test_against_plain_rules(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "h") for i, u in URLS], "page_id long, url string, html string")
    monkeypatch.setattr(U, "table", lambda *a: pages)
    got = sorted((tuple(r) for r in U.query(spark, "").select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == sorted(((i, *plain(u)) for i, u in URLS), key=str)
    assert U.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_automaton_against_regular_expressions(seed):
    rng = np.random.default_rng(seed)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    patterns = [draw("ab/*?", 6) for _ in range(40)] + ["**" + "a" * 130 + "*b"]
    subjects = [draw("ab/", int(n)) for n in rng.integers(0, 12, 200)] + ["a" * 140 + "b"]
    regex = [re.compile(re.sub(r"\*\*|\*|\?", lambda m: {"**": ".*", "*": "[^/]*", "?": "[^/]"}[m[0]], p)) for p in patterns]
    offsets = np.cumsum([0, *map(len, subjects)])
    found = U.ShiftAnd(patterns).run(np.frombuffer("".join(subjects).encode(), np.uint8), offsets)
    assert found.tolist() == [[bool(r.fullmatch(s)) for r in regex] for s in subjects]


def test_words_of_the_contract(spark, monkeypatch):
    """The words of the rules as the contract lists them, each seen in the verdict of a URL."""
    expected = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    urls = ["http://a.com/en/1", "http://example.com/en/77", "http://casino.net/de/7", "http://example.net/de/8", "http://x.org/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    monkeypatch.setattr(U, "table", lambda *a: pages)
    assert [(r.rule, r.verdict) for r in U.query(spark, "").orderBy("page_id").collect()] == expected
