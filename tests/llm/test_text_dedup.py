import brute
import pytest
from corpus import corpus
from pyspark.sql import functions as F

from tidemark.llm.decontamination import clean, contamination, matches
from tidemark.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string"


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_dedup_is_exact(spark, seed):
    rows = corpus(seed) + [(None, corpus(seed)[5][1]), (7, corpus(seed)[9][1])]
    out = substring_dedup(spark.createDataFrame(rows, SCHEMA)).withColumn("h", F.sha2("kept_text", 256))
    assert rows_of(out, "doc_id", "n_words", "n_removed", "h") == sorted(brute.substring_dedup(rows), key=repr)


def test_substring_dedup_of_empty_table_and_clashing_columns(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b", 5, "k")], "doc_id long, text string, grp int, bucket string")
    assert rows_of(substring_dedup(df), "doc_id", "n_words", "kept_text") == [(1, 2, "a b")]


@pytest.mark.parametrize("seed", [0, 1])
def test_contamination_is_exact(spark, seed):
    rows = corpus(seed)
    items = [(100 + k, " ".join((t or "").split()[5:40])) for k, (_, t) in enumerate(rows[:12])] + [(1, "one two"), (2, None), (3, ""), (4, "One Two!"), (None, "xy"), (100, "é")]
    docs, tests = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    out = contamination(docs, tests)
    want = brute.contamination(rows, items)
    assert rows_of(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert rows_of(clean(docs.withColumn("hits", F.lit(1)), tests), "doc_id") == sorted(((r[0],) for r in want if not r[5]), key=repr)


def test_contamination_in_blocks(spark, monkeypatch):
    from tidemark.llm import decontamination

    rows = corpus(3)
    items = [(k, " ".join((t or "").split()[2:60])) for k, (_, t) in enumerate(rows[:12])]
    docs, tests = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 700)
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 3000)
    got = rows_of(contamination(docs, tests), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(rows, items), key=repr)


def test_longest_matches(spark):
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(["q", *words[3:30], "z"])), (2, "nothing here")], SCHEMA)
    tests = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    assert [tuple(r) for r in matches(docs, tests).collect()] == [(1, "9", 1, 3, 27)]
    assert matches(docs, tests.where("false")).count() == 0


@pytest.mark.parametrize(("seed", "hot"), [(0, 64), (1, 2), (2, 6)])
def test_suffix_dedup_is_exact(spark, seed, hot):
    from tidemark.llm.suffix_dedup import suffix_dedup

    rows = corpus(seed) + [(None, corpus(seed)[5][1]), (7, corpus(seed)[9][1])]
    out = suffix_dedup(spark.createDataFrame(rows, SCHEMA), hot=hot).withColumn("h", F.sha2("kept", 256))
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "h") == sorted(brute.byte_dedup(rows), key=repr)


def test_suffix_dedup_cuts_whole_characters(spark):
    from tidemark.llm.suffix_dedup import suffix_dedup

    rows = [(1, "é" * 150 + "x"), (2, "z" + "é" * 150), (3, "ok")]
    out = suffix_dedup(spark.createDataFrame(rows, SCHEMA), whole_chars=True).selectExpr("doc_id", "cast(kept as string) k")
    assert rows_of(out, "doc_id", "k") == [(1, "x"), (2, "z"), (3, "ok")]
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
