"""Plain versions of the operators, one document or pair at a time, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SECRETS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def contamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (which := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= which
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def base_secrets(text):
    found = []
    for kind, (pattern, group, least) in SECRETS.items():
        for m in pattern.finditer(text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), list(SECRETS).index(kind), kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
CANDIDATES = {
    "account": re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    "weak": re.compile(r"[A-Za-z0-9+/_-]{32,}"),
    "endpoint": re.compile(r"[a-z]{2,12}://[A-Za-z0-9._:@/-]{4,}|\b" + OCTET + r"(?:\." + OCTET + r"){3}\b", re.ASCII),
}
BESIDE = {"account": {"assign", "hex", "weak"}, "weak": {"access", "account", "endpoint"}, "endpoint": {"assign", "access", "hex", "weak"}}


def linked_secrets(text, scope=200):
    """The base spans, and the candidates with a complementary part near that overlap none of them."""
    text = text or ""
    base = [(int(a), k, int(b)) for k, a, b in (s.split(":") for s in base_secrets(text))]
    weak = [(m.start(), k, m.end()) for k, p in CANDIDATES.items() for m in p.finditer(text)]
    weak = [w for w in weak if w[1] != "weak" or all(re.search(c, text[w[0] : w[2]]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    kept = [
        w
        for w in weak
        if any(o[1] in BESIDE[w[1]] and abs(o[0] - w[0]) <= scope for o in base + weak) and not any(o[0] < w[2] and w[0] < o[2] for o in base)
    ]
    order = [*SECRETS, *CANDIDATES]
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(base + kept, key=lambda x: (x[0], order.index(x[1]), x[2])))


def repeated_bytes(texts, size):
    """For each text, which bytes a string of that size covers that also starts elsewhere."""
    seen = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for i in range(len(t) - size + 1):
            seen[t[i : i + size]] += 1
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def shingles(text, size=4):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def components(docs, links):
    """Smallest id reachable, by id."""
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {d: find(d) for d in docs}


def jaccard_components(docs, percent=85, size=4):
    sets = {d: shingles(t, size) for d, t in docs}
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = components(ids, links)
    return {d: (len(sets[d]), found[d]) for d in ids}
