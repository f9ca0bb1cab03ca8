import numpy as np
import pytest
from brute import byte_dedup
from pyspark.sql import functions as F

from tidemark.llm.suffix_dedup import RunIndex, suffix_dedup


def brute_statistics(texts):
    """For each place the longest match that begins elsewhere, from the sorted suffixes."""
    suffixes = sorted((t[p:], k, p) for k, t in enumerate(texts) for p in range(len(t)))
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    out = {(k, p): 0 for _, k, p in suffixes}
    for (a, ka, pa), (b, kb, pb) in zip(suffixes, suffixes[1:], strict=False):
        n = common(a, b)
        out[ka, pa], out[kb, pb] = max(out[ka, pa], n), max(out[kb, pb], n)
    return [out[k, p] for k, t in enumerate(texts) for p in range(len(t))]


@pytest.mark.parametrize("seed", range(6))
def test_statistics_of_many_equal_tails(seed):
    r = np.random.default_rng(seed)
    tails = [bytes(r.integers(97, 99, 60).tolist()) for _ in range(3)]
    texts = [bytes(r.integers(97, 97 + 1 + seed % 3, int(r.integers(1, 60))).tolist()) + tails[int(r.integers(3))] for _ in range(40)]
    assert sum(map(len, texts)) > 2000
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = RunIndex(data, np.r_[0, np.cumsum([len(t) for t in texts])]).statistics()
    assert found.tolist() == brute_statistics(texts)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    return rows, sorted(byte_dedup(rows))


@pytest.mark.parametrize("partitions", [2, 4, 8, 50])
def test_any_number_of_partitions(spark, documents, partitions):
    rows, want = documents
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
        got = sorted(tuple(x) for x in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want
