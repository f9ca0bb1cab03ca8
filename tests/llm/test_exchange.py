import brute
import numpy as np
import pytest
from corpus import corpus
from pyspark.sql import functions as F

from tidemark.llm import exchange as ex

SCHEMA = "doc_id long, text string"


def test_labels_are_dealt_evenly(spark):
    labels = ex.even_labels(spark.range(1), 3).tolist()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.createDataFrame([(x,) for x in labels], "x int").select(F.pmod(F.hash("x"), F.lit(n)).alias("p"), F.hash("x").alias("h"), "x")
    assert all(r.h == int(ex.spark_hash(np.array([r.x]))[0]) for r in df.collect())
    assert [r["count"] for r in df.groupBy("p").count().collect()] == [3] * n


def test_planes_and_bits_round_trip():
    x = np.array([0, 5, 2**40, 2**63 - 1])
    assert ex.unplanes(ex.planes(x)).astype(np.int64).tolist() == x.tolist()
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64, 100, dtype=np.uint64))
    buckets = np.arange(7, dtype=np.int32)[::-1]
    rows = ex.send(3, 1, keys, buckets, lambda a, b: None)
    flags = keys % np.uint64(3) == 0
    heads = [(g, b, s, n) for g, b, s, n, *_ in rows]
    told = ex.answer_table(ex.answers(heads, flags)[::-1])
    assert ex.bits(told, 1).tolist() == flags.tolist()
    assert len(ex.bits(told, 0)) == 0


def test_operators_by_two_hops(spark, monkeypatch):
    """The same results where rows go in packs over super-buckets, and with several groups a partition."""
    from tidemark.llm.jaccard_join import jaccard_components
    from tidemark.llm.substring_dedup import substring_dedup
    from tidemark.llm.suffix_dedup import suffix_dedup

    rows = corpus(6)
    monkeypatch.setattr(ex, "ROUTED_FROM", 3)
    monkeypatch.setattr(ex, "multiple", lambda df: 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert ex.Exchange(docs).hops == 4
    got = substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted(map(tuple, got.collect())) == sorted(brute.substring_dedup(rows))
    got = suffix_dedup(docs, hot=4).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect())) == sorted(brute.byte_dedup(rows))
    assert sorted(map(tuple, jaccard_components(docs).collect())) == sorted(brute.jaccard_components(rows))


def test_rows_of_two_hops(spark, monkeypatch):
    """Rows of every hop against the number of partitions: with the power of 1.5, where one hop has the square."""
    monkeypatch.setattr(ex, "ROUTED_FROM", 3)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4000)], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = {}
    try:
        for n in (16, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            way = ex.Exchange(docs)
            keys = np.sort(ex.mix(np.arange(40 * n, dtype=np.uint64)))
            sent = way.send_pass(ex.dealt(docs, "doc_id", "text", way.groups), lambda g, t, way=way, keys=keys: ex.send(g, 0, keys, way.buckets, lambda a, b: None))
            found[n] = sent.count(), way._hop(sent, "bucket").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(found[n][k] <= 1.3 * n**1.5 for n in found for k in (0, 1))


def test_many_labels_are_plain_numbers(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 1_000_000)
        labels = ex.even_labels(spark.range(1), 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(labels) == 2_000_000
    got = spark.range(1000).select(ex.label(labels, "id").alias("x")).agg(F.min("x"), F.max("x")).first()
    assert 0 <= got[0] < got[1] < 2_000_000
    assert ex.multiple(spark.createDataFrame([(1, "a")], SCHEMA)) == 1


def test_ids_must_be_integers(spark):
    from tidemark.llm.substring_dedup import substring_dedup

    with pytest.raises(TypeError, match="doc_id must be an integer, not string"):
        substring_dedup(spark.createDataFrame([("x", "y")], "doc_id string, text string"))
    assert substring_dedup(spark.createDataFrame([(1, "y")], "doc_id int, text string")).count() == 1
