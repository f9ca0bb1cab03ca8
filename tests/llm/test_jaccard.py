import random

import brute
import numpy as np
import pytest
from corpus import corpus

from tidemark.llm.jaccard_join import Meeting, jaccard_components, keep_one

SCHEMA = "doc_id long, text string"


def family(seed=5, n=150):
    """Near copies that chain: many link only through others."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 9])):
            w[r.randrange(len(w))] = f"v{r.randrange(9)}"
        rows.append((i * 2 + 1, " ".join(w).upper() if i % 9 == 0 else " ".join(w)))
    return rows


@pytest.mark.parametrize(("rows", "block", "quarters"), [(corpus(0), 128, 4), (corpus(1), 3, 1), (family(), 128, 4), (family(6), 8, 8), (family(8), 8, 1), (family(7, 90) + [(10_000 + i, t) for i, t in corpus(2)], 4, 4)])
def test_components_are_exact(spark, rows, block, quarters):
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA), block=block, quarters=quarters).collect()))
    assert got == sorted(brute.jaccard_components(rows))


def test_default_quarters_and_other_limits(spark):
    rows = family(9, 120) + [(10_000 + i, t) for i, t in corpus(3)]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == sorted(brute.jaccard_components(rows))
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA), size=5, percent=80).collect()))
    assert got == sorted(brute.jaccard_components(rows, 5, 80))


def test_ids_that_repeat_with_other_texts(spark):
    """Each row of an id links by its own text, whichever comes first."""
    one, two, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "abz")
    rows = [(5, one), (5, two), (5, other), (2, two + " more"), (9, one + " more"), (11, "alone " + "x y z"), (3, other), (3, "short"), (3, "short"), (12, "short"), (None, one)]
    for order in (rows, rows[::-1]):
        got = sorted(map(tuple, jaccard_components(spark.createDataFrame(order, SCHEMA)).collect()), key=repr)
        assert [(i, c) for i, _, c in got if i is not None] == sorted([(5, 2), (5, 2), (5, 2), (2, 2), (9, 2), (11, 11), (3, 2), (3, 2), (3, 2), (12, 2)], key=repr)
        assert [n for i, n, _ in got if i == 3] == [1, 1, 57]


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (5, "A B\tc D e"), (5, "a b c d e"), (7, ""), (8, None), (9, " "), (10, "one"), (12, "ONE")]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([(None, 2, None), (3, 2, 3), (5, 2, 3), (5, 2, 3), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 10), (12, 1, 10)], key=repr)
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, grp string, n int")
    assert keep_one(df).columns == df.columns
    assert sorted((r.doc_id for r in keep_one(df).collect()), key=repr) == sorted([None, 3, 7, 8, 9, 10], key=repr)
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_meeting_skips_what_is_connected():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**40, 200).astype(np.uint64)
    sets = [np.unique(np.r_[base[r.random(200) > 0.03], r.integers(0, 2**40, 4).astype(np.uint64)]) for _ in range(60)]
    m = Meeting(np.arange(60), sets, 85)
    probed = []
    probe = m.probe
    m.probe = lambda x: (probed.append(x), probe(x))
    assert len(set(m.connect().tolist())) == 1
    assert len(probed) < 20
