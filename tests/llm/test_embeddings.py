import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.embedding_dedup import embedding_dedup, plan

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, threshold=0.98):
    edges, n = [], {i: 0 for i, _, _ in rows}
    good = [(i, np.array(v, float), g) for i, v, g in rows if g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for k, (i, a, g) in enumerate(good):
        for j, b, h in good[:k]:
            if g == h and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                edges.append((i, j))
                n[i] += 1
                n[j] += 1
    up = brute.components(n, edges)
    return {i: (n[i], up[i], up[i] == i) for i in n}


def vectors(seed, n=300, d=16):
    r = np.random.default_rng(seed)
    base = r.standard_normal((40, d)).astype(np.float32)
    rows = []
    for i in range(n):
        v = base[r.integers(40)]
        if r.random() < 0.6:
            v = v + r.standard_normal(d).astype(np.float32) * r.choice([0.02, 0.1, 0.2])
        rows.append((int(i * 3), [float(x) for x in np.float32(v)], int(r.integers(3))))
    odd = [(5000, None, 1), (5001, [0.0] * d, 1), (5002, [float("nan")] * d, 1), (5003, [1.0, None], 1), (5004, [float("inf")] * d, 1), (5005, rows[0][1], None), (5006, [1.0, 2.0], 1), (5007, [2.0, 4.0], 1), (5008, [], 1)]
    return rows + odd


@pytest.mark.parametrize(("seed", "block"), [(0, 512), (1, 5)])
def test_links_and_components(spark, seed, block):
    rows = vectors(seed)
    want = brute_force(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark.createDataFrame(rows, SCHEMA), block=block, recall=1 - 1e-9).collect()}
    assert got == want


def test_recall_at_production_parameters(spark):
    rows = vectors(2, 900)
    want = brute_force(rows)
    got = embedding_dedup(spark.createDataFrame(rows, SCHEMA))
    assert got.agg(F.sum("n_links")).first()[0] >= 0.97 * sum(n for n, _, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got.collect())


def test_empty_and_clashing_columns(spark):
    assert embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 9, "c"), (2, [1.0, 0.001], 1, 9, "c")], "vec_id long, embedding array<float>, label int, cid int, bin string")
    assert sorted(map(tuple, embedding_dedup(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_tables_follow_from_size():
    assert plan(0, 0.98, 0.995)[0] == 6
    assert plan(10**9, 0.98, 0.995)[0] == 24
    bits, tables = plan(10**6, 0.98, 0.995)
    assert 1 - (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables >= 0.995


def test_components_of_a_long_chain_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(200, 260)] + [(7, 7), (300, 299), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    nodes = {x for e in edges for x in e if x is not None} - {7} | {7}
    want = brute.components(nodes, [e for e in edges if None not in e])
    assert got == want
