"""The learned models against plain versions: dictionaries for Kneser-Ney, a dense matrix for the toxicity risk."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.language_id import identify, learn
from tidemark.llm.toxicity import learn as learn_toxicity
from tidemark.llm.toxicity import score

ORDER = 5


def symbols(text):
    """(context, symbol) of each letter and of the boundary after each word."""
    out = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        line = "#" + word + "#"
        out += [(line[max(0, k - ORDER + 1) : k], line[k]) for k in range(1, len(line))]
    return out


class PlainKneserNey:
    def __init__(self, texts, size):
        grams = Counter(c + s for t in texts for c, s in symbols(t))
        self.size = size
        tables = {ORDER: Counter({g: n for g, n in grams.items() if len(g) == ORDER})}
        for k in range(ORDER - 1, 0, -1):
            tables[k] = Counter(g[1:] for g in tables[k + 1])
            tables[k].update({g: n for g, n in grams.items() if len(g) == k})
        self.levels = {}
        for k, table in tables.items():
            once, twice = (sum(n == m for n in table.values()) for m in (1, 2))
            total, types = defaultdict(int), defaultdict(int)
            for g, n in table.items():
                total[g[:-1]] += n
                types[g[:-1]] += 1
            self.levels[k] = table, once / (once + 2 * twice) if once and twice else 0.75, total, types

    def probability(self, context, symbol):
        p = 1 / self.size
        for k in range(1, len(context) + 2):
            table, d, total, types = self.levels[k]
            c = context[len(context) - k + 1 :]
            if total[c]:
                p = (max(table[c + symbol] - d, 0) + d * types[c] * p) / total[c]
        return p

    def entropy(self, text):
        found = symbols(text)
        return -sum(math.log(self.probability(c, s)) for c, s in found) / len(found) if found else None


def test_language_scores_equal_the_plain_model(spark):
    r = random.Random(3)
    sounds = {"xx": ["ka", "to", "mi", "ra", "éé"], "yy": ["sch", "ung", "ei", "ko", "ra"], "zz": ["ção", "nha", "lo", "mi", "que"]}
    rows = [(i, " ".join("".join(r.choice(sounds[g]) for _ in range(r.randint(1, 4))).capitalize() for _ in range(r.randint(1, 40))) + "., 7", g) for i, g in ((i, r.choice(sorted(sounds))) for i in range(150))]
    rows += [(900, "solo", "one"), (901, "KATO kato", None), (902, "xyzzy unseen Ωmega", None), (903, " 12 ", None), (904, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learning = F.pmod(F.col("doc_id"), F.lit(4)) != 0
    models = learn(docs, learning)
    by = defaultdict(list)
    for i, t, g in rows:
        if g and t and i % 4:
            by[g].append(t)
    by = {g: ts for g, ts in by.items() if any(symbols(t) for t in ts)}
    size = len({s for ts in by.values() for t in ts for _, s in symbols(t)}) + 1
    plain = {g: PlainKneserNey(ts, size) for g, ts in by.items()}
    assert models.langs == sorted(plain)
    for row in identify(docs, models).collect():
        text = next(t for i, t, _ in rows if i == row.doc_id) or ""
        h = [plain[g].entropy(text) for g in models.langs]
        if h[0] is None:
            assert (row.lang_pred, row.score, row.cross_entropy) == ("und", 0.0, None)
            continue
        best = int(np.argmin(h))
        assert row.lang_pred == models.langs[best]
        assert row.cross_entropy == pytest.approx(h[best], abs=1e-9)
        z = np.exp((h[best] - np.array(h)) * models.temperature)
        assert row.score == pytest.approx(1 / z.sum(), abs=1e-9)


def plain_features(text):
    """Words and their beginnings, as bytes with their kind."""
    raw = re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[0-9a-z\x80-\xff]+", raw)
    return {w for w in words} | {w[:n] for w in words for n in (4, 5, 6, 7) if len(w) > n}


def plain_fit(p, u, prior, steps=600, rate=0.1, decay=2e-4):
    """The same risk and steps on dense matrices."""
    w, m, v = np.zeros(p.shape[1] + 1), 0.0, 0.0
    w[-1] = math.log(prior / (1 - prior))
    x, y = (np.hstack([a, np.ones((len(a), 1))]) for a in (p, u))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for step in range(1, steps + 1):
        a, b = x @ w, y @ w
        rest = np.log1p(np.exp(b)).mean() - prior * np.log1p(np.exp(a)).mean()
        slope = y.T @ sigmoid(b) / len(y) - prior * (x.T @ sigmoid(a)) / len(x)
        g = -prior * (x.T @ sigmoid(-a)) / len(x) + slope if rest >= 0 else -slope
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def test_toxicity_scores_equal_the_plain_model(spark):
    r = random.Random(8)
    words = [f"wort{r.randrange(10**4)}" for _ in range(60)]
    rows = []
    for i in range(400):
        w = [r.choice(words) for _ in range(r.randint(3, 30))]
        if bad := r.random() < 0.25:
            w += [r.choice(["Vileness", "nastyé", "grossest"]) for _ in range(2)]
        elif r.random() < 0.5:
            w += ["kindly"]
        rows.append((i, " ".join(w), int(bad)))
    rows += [(500, None, 0), (501, "", 1), (502, "Vile nasty kindly", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4], "doc_id long, toxic int")
    learning = F.pmod(F.col("doc_id"), F.lit(5)) != 2
    got = {x.doc_id: x.score for x in score(docs, learn_toxicity(docs, labels, learning)).collect()}

    learn_rows = [(i, plain_features(t)) for i, t, _ in rows if i % 5 != 2]
    told = {i: y for i, _, y in rows if i % 4 and i % 5 != 2}
    prior = sum(told.values()) / len(told)
    positive = [f for i, f in learn_rows if told.get(i)]
    p, u = Counter(x for f in positive for x in f), Counter(x for _, f in learn_rows for x in f)
    kept = []
    for x in sorted(u):
        a, b = p[x] / len(positive), u[x] / len(learn_rows)
        z = (a - b) / math.sqrt(max(b * (1 - b), 1e-12) / len(positive))
        if (p[x] >= 4 or u[x] >= 20) and abs(z) >= 3:
            kept.append(x)
    assert b"kindly" in kept
    assert b"vileness" in kept
    dense = lambda fs: np.array([[float(x in f) for x in kept] for f in fs])
    w = plain_fit(dense(positive), dense([f for _, f in learn_rows]), prior)
    for i, t, _ in rows:
        want = 1 / (1 + math.exp(-(dense([plain_features(t)])[0] @ w[:-1] + w[-1])))
        assert got[i] == pytest.approx(want, abs=1e-9)
