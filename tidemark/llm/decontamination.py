"""Benchmark decontamination by suffix arrays of the training text.

Each byte-balanced batch of documents is a shard. Its word suffixes, in the order of their first `width` words, are its
suffix array; those that begin with a word that no test has match nothing and are left out. Every test suffix of at least
`width` words (an item of fewer words: the whole item) is binary-searched in it; the range found holds all places of
verbatim matches, and each is followed word by word to its longest. Words in a longest match are hit, items with one are
counted; `matches` gives the longest matches and their places, `clean` drops the documents that hold one.

The benchmark is broadcast only in blocks of at most `BLOCK_BYTES` of text; a larger one takes one map per block, each
handing on what it has found. No shuffle.

Null texts and texts without words: no words, not contaminated. An item of fewer words than the width is one window. A
null item_id marks words but is no item. Repeated doc_ids are rows of their own, repeated items count once. Documents of
an empty table give no rows; an empty benchmark marks nothing. Other columns are kept by `clean`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import ALNUM_WORD, Words, by_bytes, flat, release

BLOCK_BYTES = 32 << 20
SHARD_BYTES = 1 << 17
MATCHES = 1 << 18


class Tests:
    """The test suffixes: distinct first words as packed word numbers, where they stand in the items, and the items' words."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int) -> None:
        self.width = width
        data, off = flat(pa.array([t for _, t in items], pa.large_string()))
        words = Words(data, off, ALNUM_WORD, fold=True)
        self.vocabulary = np.unique(words.name)
        word = np.searchsorted(self.vocabulary, words.name) + 1
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.per = 64 // self.bits
        n = words.counts
        length = np.minimum(n, width)
        count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), count)
        start = np.repeat(words.first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        length = length[item]
        rows = np.zeros((len(start), width), np.int64)
        for j in range(width):
            have = j < length
            rows[have, j] = word[start[have] + j]
        self.rows, back = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.empty(0, np.int64))
        self.length = (self.rows > 0).sum(1)
        at = np.lexsort((item, back.ravel()))
        self.item, owner = item[at], back.ravel()[at]
        self.first = np.searchsorted(owner, np.arange(len(self.rows) + 1))
        self.item_id = np.array([i for i, _ in items], object)
        self.word = np.append(word, 0)  # the items' words end to end
        self.start = start[at]  # of each suffix in them, in the order of self.item
        self.end = words.first[1:][self.item]
        self.place = self.start - words.first[:-1][self.item]  # in its item
        self.low = self.pack(self.rows)
        top = self.rows.copy()
        for j in range(width):
            top[self.length <= j, j] = (1 << self.bits) - 1
        self.high = self.pack(top)

    def pack(self, rows: np.ndarray) -> list[np.ndarray]:
        out = []
        for a in range(0, self.width, self.per):
            key = np.zeros(len(rows), np.uint64)
            for j in range(a, min(a + self.per, self.width)):
                key = key << np.uint64(self.bits) | rows[:, j].astype(np.uint64)
            out.append(key)
        return out


def _bound(keys: list[np.ndarray], query: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of all queries at once in keys sorted by their columns."""
    lo, hi = np.zeros(len(query[0]), np.int64), np.full(len(query[0]), len(keys[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) // 2, 0)
        below, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, q in zip(keys, query, strict=True):
            v = k[mid]
            below |= same & (v < q)
            same &= v == q
        go = open_ & (below | same if after else below)
        lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


def find(words: Words, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By a suffix array of one shard: its words' numbers, word places where the first words of a test suffix occur, and
    those first words."""
    none = np.empty(0, np.int64)
    n = len(words.name)
    if not n or not len(tests.rows):
        return none, none, none
    near = np.searchsorted(tests.vocabulary, words.name)
    near[near == len(tests.vocabulary)] = 0
    word = np.append(np.where(tests.vocabulary[near] == words.name, near + 1, 0), 0)
    end = np.repeat(words.first[1:], words.counts)
    starts = np.flatnonzero(word)
    # packed keys of the first words; behind a document's end stands 0
    left = end[starts] - starts
    suffix = np.where(np.arange(tests.width) < left[:, None], word[np.minimum(starts[:, None] + np.arange(tests.width), n)], 0)
    keys = tests.pack(suffix)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    lo, hi = _bound(keys, tests.low, False), _bound(keys, tests.high, True)
    count = np.maximum(hi - lo, 0)
    window = np.repeat(np.arange(len(lo)), count)
    return word, starts[order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())]], window


def longest(words: Words, tests: Tests, word: np.ndarray, place: np.ndarray, window: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, test suffixes and numbers of words of the longest matches, bounded numbers of them at a time."""
    owners = np.diff(tests.first)[window]
    end = np.repeat(words.first[1:], words.counts)
    for a, b in by_bytes(owners, MATCHES):
        n, w = owners[a:b], window[a:b]
        at, size = np.repeat(place[a:b], n), np.repeat(tests.length[w], n)
        k = np.repeat(tests.first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        most = np.minimum(end[at] - at, tests.end[k] - tests.start[k])
        going = np.flatnonzero(size < most)
        while len(going):
            going = going[word[at[going] + size[going]] == tests.word[tests.start[k[going]] + size[going]]]
            size[going] += 1
            going = going[size[going] < most[going]]
        yield at, k, size


def _blocks(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> Iterator[tuple[bool, Tests]]:
    """One block at a time, and whether it is the last."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        yield k == n - 1, Tests([tuple(r) for r in items.where(block == k).collect()], width)


def _hits(batch: pa.Array, tests: Tests) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray, np.ndarray]]:
    data, off = flat(batch)
    for a, b in by_bytes(np.diff(off), SHARD_BYTES):
        words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a], ALNUM_WORD, fold=True)
        yield a, b, words, *find(words, tests)
    release()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the items themselves (item_ids), per document."""
    kind = docs.schema[id_col].dataType.simpleString()
    state = f"doc_id {kind}, text string, hits binary, items array<string>"
    out = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    for last, tests in _blocks(benchmark, width, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for batch in batches:
                before, had = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                rows = []
                for a, b, words, *found in _hits(batch.column(1), tests):
                    step = np.zeros(len(words.name) + 1, np.int64)
                    items: dict[int, set] = {}
                    for at, suffix, size in longest(words, tests, *found):
                        np.add.at(step, at, 1)
                        np.add.at(step, at + size, -1)
                        doc = np.searchsorted(words.first, at, "right") - 1
                        for key in np.unique(doc * len(tests.item_id) + tests.item[suffix]).tolist():
                            d, i = divmod(key, len(tests.item_id))
                            items.setdefault(d, set()).add(tests.item_id[i])
                    marked = np.cumsum(step[:-1]) > 0
                    for d in range(b - a):
                        mine = marked[words.first[d] : words.first[d + 1]]
                        if before[a + d] is not None:
                            mine = mine | np.unpackbits(np.frombuffer(before[a + d], np.uint8), count=len(mine)).astype(bool)
                        found = sorted({*(had[a + d] or []), *(i for i in items.get(d, ()) if i is not None)})
                        rows.append((mine, found))
                if last:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array([len(m) for m, _ in rows], pa.int64()), pa.array([int(m.sum()) for m, _ in rows], pa.int64()), pa.array([len(i) for _, i in rows], pa.int64()),
                         pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for _, i in rows], pa.string()), pa.array([bool(m.any()) for m, _ in rows], pa.bool_()), pa.array([i for _, i in rows], pa.list_(pa.string()))],
                        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"],
                    )
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.packbits(m).tobytes() for m, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.list_(pa.string()))], ["doc_id", "text", "hits", "items"])

        out = out.mapInArrow(search, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>" if last else state)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, all columns, that hold no benchmark window."""
    place = docs.columns.index(text_col)
    for _, tests in _blocks(benchmark, width, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for a, _, words, _, at, _ in _hits(batch.column(place), shared.value):
                    good[a + np.searchsorted(words.first, at, "right") - 1] = False
                yield pc.filter(batch, pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Longest verbatim matches: doc_id, item_id, doc_word, item_word (where they begin), n_words."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = None
    for _, tests in _blocks(benchmark, width, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for batch in batches:
                ids = batch.column(0)
                for a, _, words, *found in _hits(batch.column(1), tests):
                    place, suffix, long = (np.concatenate(c) for c in zip(*longest(words, tests, *found), strict=True)) if len(found[1]) else [np.empty(0, np.int64)] * 3
                    doc = np.searchsorted(words.first, place, "right") - 1
                    item, word = tests.item[suffix], tests.place[suffix]
                    order = np.lexsort((place, place - word, item, doc))
                    doc, item, word, place, long = (x[order] for x in (doc, item, word, place, long))
                    new = np.ones(len(doc), bool)  # a match that begins a word later on the same diagonal is part of it
                    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(place - word) != 0) | (np.diff(place) != 1)
                    s = np.flatnonzero(new)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(a + doc[s])), pa.array(tests.item_id[item[s]].tolist(), pa.string()), pa.array(place[s] - words.first[doc[s]]), pa.array(word[s]), pa.array(long[s])],
                        ["doc_id", "item_id", "doc_word", "item_word", "n_words"],
                    )

        found = rows.mapInArrow(search, f"doc_id {kind}, item_id string, doc_word long, item_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out
