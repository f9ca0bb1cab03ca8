import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpus import corpus
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.packing import LevelPacker, pack
from tidemark.llm.token_counts import PieceEncoder, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"
ODD = ["", " ", "  a  b ", "it's a <|endoftext|> b<|endoftext|>c", "a \n b", "x  y z", " lead", "tab\t x  \n\n y", "a\x1c b", "é à", "a b c", "a \x85 b", "d\x0b e 1 2", "on.\nThe 'sa1's", "a\n\nb\n c<| endoftext|>", "a" * 3000, "ab1 " * 900]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(PATH)


@pytest.mark.parametrize("text", ODD)
def test_pieces_give_the_library_ids(library, encoder, text):
    want = library.encode(text, add_special_tokens=False).ids
    both = pa.array([None, text, "x", text])
    assert [x.tolist() for x in encoder.ids(both)][1::2] == [want, want]
    assert encoder.counts(both).tolist() == [0, len(want), 1, len(want)]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from(" \n\t.,'s1aéZ<|>endoftxt \x1c×ł中"), max_size=60))
def test_any_text(text):
    library, encoder = Tokenizer.from_file(PATH) if not hasattr(test_any_text, "kept") else test_any_text.kept[0], None
    if not hasattr(test_any_text, "kept"):
        test_any_text.kept = library, PieceEncoder(PATH)
    encoder = test_any_text.kept[1]
    assert next(encoder.ids(pa.array([text]))).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, library):
    rows = [*corpus(1), *((1000 + k, t) for k, t in enumerate(ODD)), (None, "x y")]
    got = sorted(map(tuple, token_counts(spark.createDataFrame(rows, SCHEMA), PATH).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_long_texts_with_special_strings(encoder, library):
    part = "It's a  text.\nOf <| odd parts, été 12 and \t blanks  " * 4000
    for text in (part + "<|endoftext|>" + part, "<|endoftext|>" * 9000, part[:70_000] + " <|endoftext|> " + "x" * 90_000 + "<|endoftext|>", "a<|" * 40_000):
        assert len(text) > 1 << 16
        assert encoder.counts(pa.array([text])).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
        assert next(encoder.ids(pa.array([text]))).tolist() == library.encode(text, add_special_tokens=False).ids


def test_pack_loses_nothing(spark, library):
    rows = [*corpus(1), *((1000 + k, t) for k, t in enumerate(ODD))]
    out = pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).toPandas()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    for i, pieces in out.sort_values("start").groupby("doc_id"):
        at = 0
        for x in pieces.itertuples():
            assert (x.start, x.doc_tokens) == (at, len(ids[i]))
            assert x.ids_crc32 == zlib.crc32(ids[i][at : at + x.length].tobytes())
            at += x.length
        assert at == len(ids[i])
    assert out.doc_id.nunique() == len(rows)
    for _, pieces in out.sort_values("offset").groupby("sequence_id"):
        assert pieces.offset.tolist() == [0, *pieces.length.cumsum().tolist()[:-1]]
    fill = out.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048
    assert all(f & (f - 1) == 0 for f in fill)
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_level_minimises_squares():
    r = np.random.default_rng(0)
    packer = LevelPacker(64, max_open=10**6)
    for s in r.integers(1, 64, 600):
        c = packer.counts

        def squares(h, s=s, c=c):
            d = c.copy()
            if h:
                d[h] -= 1
            if h + s < 64:
                d[h + s] += 1
            return int((d[:64] ** 2).sum())

        levels = [h for h in range(65 - s) if h == 0 or c[h]]
        assert squares(packer.level(s)) == min(map(squares, levels))
        list(packer.place((0, 0, int(s), np.zeros(s, np.uint32))))


def test_open_windows_are_bounded():
    packer = LevelPacker(64, max_open=20)
    n = sum(len(x[3]) for _ in range(500) for w in packer.place((0, 0, 40, np.zeros(40, np.uint32))) for x in w)
    assert packer.open <= 20
    assert n + sum(len(x[3]) for w in packer.pour() for x in w) == 500 * 40


def test_levels_close_most_windows_whatever_the_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(32)
    out = pack(docs, PATH).toPandas()
    by = out.groupby("closed_by").length.sum() / out.length.sum()
    assert by["whole"] + by["level"] > 0.85
    fill = out.groupby("sequence_id").length.sum()
    assert all(f & (f - 1) == 0 for f in fill)
    assert (fill < 2048).sum() <= 11
    # a document of full windows needs one cut for each; remainders are whole but for those that fill the last gaps
    short = out[out.doc_tokens < 2048].groupby("doc_id").size()
    assert (short > 1).mean() < 0.01


def test_pour_cuts_few_items():
    r = np.random.default_rng(1)
    packer = LevelPacker(256)
    sizes = r.integers(1, 256, 3000)
    closed = [w for k, s in enumerate(sizes) for w in packer.place((k, 0, int(s), np.arange(s, dtype=np.uint16)))]
    opened = [x[0] for ws in packer.windows.values() for w in ws for x in w]
    rest = list(packer.pour())
    size = [sum(len(x[3]) for x in w) for w in rest]
    assert size[: len(size) - sum(s < 256 for s in size)] == [256] * sum(s == 256 for s in size)
    assert len({s for s in size if s < 256}) == sum(s < 256 for s in size)
    pieces = [x for w in rest for x in w]
    assert sorted({x[0] for x in pieces}) == sorted(opened)
    whole = sum(len(x[3]) == sizes[x[0]] for x in pieces)
    assert whole > 0.8 * len(opened)
    assert sum(len(x[3]) for w in [*closed, *rest] for x in w) == sizes.sum()
    for k in opened:
        mine = sorted((x[1], len(x[3])) for x in pieces if x[0] == k)
        assert [a for a, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1].tolist()]
