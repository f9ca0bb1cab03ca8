import zlib

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from corpus import corpus
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows = corpus(4, 120)
    toxic = {i for i, t in rows if t and i % 7 == 3}
    rows = [(i, f"{t} vile{i % 3}x and horrid" if i in toxic else t) for i, t in rows]
    docs = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in rows]
    items = [(k, " ".join((t or "").split()[3:30])) for k, (_, t) in enumerate(rows[20:25])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items, toxic


def test_stages_against_brute_force(spark, tables, tmp_path):
    folder, rows, items, toxic = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    pairs = lambda name: sorted((r.doc_id, r.text) for r in seen[name].collect())
    kept = pairs("toxicity")
    assert {i for i, _ in rows} - {i for i, _ in kept} <= toxic
    assert len(toxic & {i for i, _ in kept}) <= 0.2 * len(toxic)

    up = dict((i, c) for i, _, c in brute.jaccard_components(kept, 5, 80))
    one = [(i, t) for i, t in kept if up[i] == i]
    assert pairs("ngram_jaccard_join") == sorted(one)

    got = {r.doc_id: r for r in seen["suffix_array_dedup"].collect()}
    removed = {i: k for i, _, k, _, _ in brute.byte_dedup(one)}
    for i, t in one:
        r = got[i]
        assert (r.text is None) == (t is None)
        if t is not None:
            assert r.n_chars == len(r.text)
            lost = len(t.encode()) - len(r.text.encode())
            assert lost <= removed[i]
            assert lost > removed[i] * 0.9 - 8
    texts = [(i, got[i].text) for i in got]
    hit = {r[0] for r in brute.contamination(texts, items) if r[5]}
    assert {i for i, _ in pairs("benchmark_decontamination")} == set(got) - hit
    assert hit

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = seen["packing"].toPandas()
    for i, t in pairs("benchmark_decontamination"):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in packed[packed.doc_id == i].sort_values("start").itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0
