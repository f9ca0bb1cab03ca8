import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.language_id import KneserNey, Models, Spelling, _Kept, _length, fold_of, identify, learn
from tidemark.llm.toxicity import fit_nnpu, keep_clean, score
from tidemark.llm.toxicity import learn as learn_toxicity

REMAINDER = lambda n: F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def held(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def languages(seed, n=240):
    r = random.Random(seed)
    sounds = {"xx": ["ka", "to", "mi", "ra", "éé"], "yy": ["sch", "ung", "ei", "ko", "ra"], "zz": ["ção", "nha", "lo", "mi", "que"]}
    return [(i, " ".join("".join(r.choice(sounds[g]) for _ in range(r.randint(1, 4))).capitalize() for _ in range(r.randint(3, 60))) + ".", g) for i, g in ((i, r.choice(sorted(sounds))) for i in range(n))]


def test_language_of_held_out_rows(spark):
    rows = [*languages(0), (1000, None, "xx"), (1001, "", None), (1002, "12 !? 3", "yy"), (1003, "katomi", None), (None, "schung ei ko", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in identify(docs, learn(docs, REMAINDER(5) != 0)).collect()}
    assert len(got) == len(rows)
    out = [(got[i].lang_pred, g) for i, _, g in languages(0) if held(i, 5, 0)]
    assert len(out) > 30
    assert np.mean([a == b for a, b in out]) >= 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert [got[i].score for i in (1000, 1001, 1002)] == [0.0] * 3
    assert got[None].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for i, r in got.items() if i is not None and i < 1000) < 20


def test_rare_grams_of_many_languages_are_kept(spark):
    r = random.Random(5)
    big = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)) for _ in range(300)]
    rows = [(i, t, "big") for i, t in enumerate(big)] + [(1000 + 5 * k + j, f"la{j} lo{k}", f"g{k:02}") for k in range(70) for j in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = learn(docs, F.lit(True))
    full = np.unique(Spelling(big).key)
    kept = models.models[models.langs.index("big")].levels[-1][0]
    assert len(kept) >= 0.85 * (_length(full) == 5).sum()


def test_calibration_reads_whole_texts(spark, monkeypatch):
    """Texts that begin alike and differ after 2000 letters: entropies of the whole ones are what is calibrated on."""
    head = "kato mira " * 250
    rows = [(i, head + t * 20, g) for i, t, g in languages(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(Models, "calibrate", lambda self, found, share: seen.append((self, list(found))))
    learn(docs, F.lit(True))
    (models, found), = seen
    whole = {g: models.entropies([t for _, t, x in rows if x == g]) for g in models.langs}
    assert len(found) > 5
    assert all(np.isclose(whole[g], h).all(1).any() for g, h in found)


def test_calibration_takes_all_learning_rows(spark, monkeypatch):
    """Temperature and limits against plain ones over every row, each scored by models that count neither it nor its copies."""
    rows = [*languages(4, 600), *((2000 + i, t, g) for i, t, g in languages(4, 50)), (3000, "solo", "one"), (3001, "12", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, calibrate = [], Models.calibrate
    monkeypatch.setattr(Models, "calibrate", lambda self, found, share: (seen.append((self, list(found))), calibrate(self, found, share)))
    models = learn(docs, F.lit(True), keep_share=0.9)
    (crossed, found), = seen
    assert len(found) == len(rows)
    h, y = crossed.entropies([t for _, t, _ in rows]), np.array([models.langs.index(g) for _, _, g in rows])
    own = h[np.arange(len(y)), y]
    assert sorted(map(repr, own.tolist())) == sorted(repr(x[models.langs.index(g)]) for g, x in found)
    for k, part in enumerate(crossed.parts):
        for g in part.langs:
            keys = np.unique(Spelling([t for _, t, x in rows if x == g and fold_of(t) != k]).key)
            assert part.models[part.langs.index(g)].levels[-1][0].tolist() == keys[_length(keys) == 5].tolist()
    ok = np.isfinite(own)
    assert ok.sum() == len(rows) - 2
    likes = {t: (-own[ok] * t - np.log(np.exp(-h[ok] * t).sum(1))).sum() for t in 2.0 ** np.arange(-3, 8)}
    assert likes[models.temperature] >= max(likes.values()) - 1e-3 * len(rows) * len(likes)
    for k, g in enumerate(models.langs):
        if g == "one":
            assert models.limit[k] == np.inf
            continue
        mine = own[ok & (y == k)]
        assert models.limit[k] == pytest.approx(np.quantile(np.ceil(mine / 0.001), 0.9) * 0.001 * 1.05)


def test_kept_scores_equal_new_ones():
    """Tables that fill up, are merged and emptied."""
    r = np.random.default_rng(1)
    kept = _Kept(2, 9000)
    for _ in range(60):
        key = np.unique(r.integers(0, 30_000, 700).astype(np.uint64))
        assert kept.get(key, lambda new: np.stack([key[new], key[new] * 2], 1).astype(float)).tolist() == [[k, 2.0 * k] for k in key.tolist()]
    assert sum(len(known) for known, _ in kept.tables) <= 9000 + 700


def test_all_learning_rows_are_counted(spark):
    """Also those that calibrate, and languages of one text each."""
    rows = [*languages(2), *((1000 + k, f"bu{chr(97 + k % 26)}{chr(97 + k // 26)} wo", f"g{k:02}") for k in range(60))]
    models = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert models.langs == sorted({g for _, _, g in rows})
    for g, model in zip(models.langs, models.models, strict=True):
        full = np.unique(Spelling([t for _, t, x in rows if x == g]).key)
        assert model.levels[-1][0].tolist() == full[_length(full) == 5].tolist()


def test_no_learning_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(docs, learn(docs, F.lit(True))).collect()] == ["und"]
    empty = docs.where("false")
    assert identify(empty, learn(empty, F.lit(True))).count() == 0


def test_probabilities_sum_to_one():
    s = Spelling([t for _, t, g in languages(1) if g == "xx"])
    key, n = np.unique(np.repeat(s.key, np.repeat(np.bincount(s.word), s.size + 1)), return_counts=True)
    symbols = np.unique(key & np.uint64(4095))
    model = KneserNey(key, n, len(symbols))
    r = np.random.default_rng(0)
    for k in r.choice(key, 40):
        context = k & ~np.uint64(4095)
        assert np.exp(model.logs(context | symbols)).sum() == pytest.approx(1.0, abs=1e-9)
    assert _length(np.array([1, 1 << 12 | 5], np.uint64)).tolist() == [1, 2]


def test_words_are_counted_once_each():
    s = Spelling(["ab ab", "", "b"])
    assert s.counts().tolist() == [2, 0, 1]
    assert sorted(s.size.tolist()) == [1, 2]


def toxic_rows(seed, n=1500):
    r = random.Random(seed)
    words = [f"wo{r.randrange(10**6)}" for _ in range(400)]
    bad = ["vile", "nasty", "creepish", "grossly"]
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randint(2, 5)):
                w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "s", "ed", "x"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxic_rows_held_out(spark):
    rows = toxic_rows(0)
    docs = spark.createDataFrame([*((i, t) for i, t, _ in rows), (9000, None), (9001, ""), (None, "vile nasty")], "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows if i % 3), (None, 1), (1, None), (99999, 1)], "doc_id long, toxic int")
    model = learn_toxicity(docs, labels, REMAINDER(3) != 1)
    got = {r.doc_id: r for r in score(docs, model).collect()}
    out = [(got[i].predicted, y) for i, _, y in rows if held(i, 3, 1)]
    assert np.mean([p == y for p, y in out]) >= 0.97
    assert np.mean([p for p, y in out if y]) >= 0.9
    assert got[9000].predicted == got[9001].predicted == 0
    assert got[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_no_positives(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in score(docs, learn_toxicity(docs, none, F.lit(True))).collect()} == {0}
    assert score(docs.where("false"), learn_toxicity(docs.where("false"), none, F.lit(True))).count() == 0


def test_risk_stays_non_negative_on_separable_data():
    p = (np.arange(50), np.zeros(50, np.int64), 50)
    u = (np.arange(30), np.zeros(30, np.int64), 200)
    w = fit_nnpu(p, u, 1, 0.15)
    assert np.isfinite(w).all()
    assert 1 / (1 + np.exp(-(w[0] + w[1]))) > 0.7 > 0.3 > 1 / (1 + np.exp(-w[1]))
