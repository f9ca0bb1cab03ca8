"""Brute-force versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def substring_dedup(rows, width=50):
    words = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    key = lambda i: float("inf") if i is None else i
    least = {}
    for i, w in words:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            least[k] = min(least.get(k, key(i)), key(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if least[tuple(w[p : p + width])] < key(i):
                gone[p : p + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def byte_dedup(rows, width=200):
    docs = [(i, (t or "").encode()) for i, t in rows]
    n = defaultdict(int)
    for _, b in docs:
        for p in range(len(b) - width + 1):
            n[b[p : p + width]] += 1
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if n[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contamination(rows, items, width=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    tests = defaultdict(set)
    for i, t in items:
        w = word.findall(fold(t))
        for p in range(max(len(w) - width + 1, 1) if w else 0):
            tests[tuple(w[p : p + width])].add(i)
    sizes = {len(k) for k in tests}
    out = []
    for i, t in rows:
        w = word.findall(fold(t))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in tests:
                    hit[p : p + n] = [True] * n
                    found |= tests[k]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), sum(hit), len(ids), sha(",".join(ids)), any(hit)))
    return out


def components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(t, n=4):
    w = re.findall("[^\x20\x09-\x0d]+", fold(t))
    return {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard_components(rows, n=4, percent=85):
    sets = [(i, shingles(t, n)) for i, t in rows]
    edges = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    up = components({i for i, _ in sets}, edges)
    return [(i, len(x), up[i]) for i, x in sets]
