import hashlib
import random

import pytest

from seqlake.llm import secrets as S
from tests.llm import brute

KEY = "AKIA" + "ABCDEFGH12345678"
WEAK = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hI6kL9n"
CASES = [
    (1, f'say {KEY} and Password = "hunter22" é😀 token=abc api_key: "xyzzyx=="'),
    (2, "0123456789abcdef01234567 and 0123456789abcdef0123456"),
    (3, None),
    (4, ""),
    (5, "token=token: abcdefgh token:: TOKEN=token=abcdefgh secret secret='a.b-c/d+e'"),
    (6, f"{KEY}\n{WEAK}"),
    (7, WEAK),
    (8, f"{KEY}{'x ' * 400}{WEAK}"),
    (9, f"https://api.example.com/v1 {WEAK}"),
    (10, "https://api.example.com/v1"),
    (11, "apikey=" + "a1" * 300_000),
    (2, "0123456789abcdef01234567 and 0123456789abcdef0123456"),
]


@pytest.fixture
def found(spark, monkeypatch):
    def run(rows):
        docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, row string, kind string")
        monkeypatch.setattr(S, "table", lambda *a: docs)
        return S.query(spark, "").collect()

    return run


def test_base_against_brute_force(found):
    got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found(CASES))
    expected = []
    for i, text in CASES:
        spans = brute.base_secrets(text)
        count = [sum(s.startswith(k) for s in spans) for k in brute.SECRETS]
        expected.append((i, *count, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert got == sorted(expected)


def test_weak_parts_need_company(found):
    spans = {r.doc_id: r.spans for r in found(CASES)}
    assert "weak" in spans[6] and "weak" not in spans[7] and "weak" not in spans[8]
    assert spans[9] == f"endpoint:0:26,weak:27:{27 + len(WEAK)}" and spans[10] == ""


def test_endpoint_beside_a_strong_secret(found):
    url, digits = "postgres://db.internal/app", "0123456789abcdef0123456789abcdef01234567"
    rows = [(1, f"{url} password = hunter22"), (2, f"{digits} {url}"), (3, f"{url} {'x ' * 200}password = hunter22"), (4, f"{url} password = short"), (5, f"password={url}")]
    spans = {r.doc_id: r.spans for r in found(rows)}
    assert spans[1] == "endpoint:0:26,assign:27:46" and spans[2] == "hex:0:40,endpoint:41:67"
    assert spans[3] == f"assign:{27 + 400}:{27 + 400 + 19}" and spans[4] == ""
    assert spans[5] == "assign:0:17"


def test_linked_spans_against_brute_force(found):
    rng = random.Random(3)
    digits = "0123456789abcdef0123456789abcdef01234567"
    pieces = [f'token = "{digits}"', digits, "jane.doe7@mail3.example.com", "97.51.17.173", "300.1.1.1", "1.2.3.4.5", KEY, WEAK, WEAK.lower(), "é😀", "https://api.example.com/v1", "password=x@y.example.com"]
    rows = [(i, "".join(rng.choice(pieces) + " " * rng.choice([1, 1, 2, 190, 210]) + "w" * rng.randint(0, 3) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    rows += [*CASES, (500, "Ask jane@example.com, token = abcdefgh at 10.0.0.1"), (501, "Ask jane@example.com at 10.0.0.1"), (None, f"10.0.0.1 {digits}"), (None, f"10.0.0.1 {digits}")]
    got = sorted(((r.doc_id, r.spans) for r in found(rows)), key=str)
    assert got == sorted(((i, brute.linked_secrets(t)) for i, t in rows), key=str)
    assert dict(got)[500] == "account:4:20,assign:22:38,endpoint:42:50" and dict(got)[501] == ""


def test_empty_table(found):
    assert found([]) == []
