"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased and folded to 12-bit classes (code points under 4096 stand for themselves), other characters are
word boundaries. A model predicts each letter and the boundary after a word from up to four symbols before it, no further
back than the boundary before the word. The n-grams of all learning rows are counted where they lie, summed by language
and key range, and the sums of all of them come to the driver, 16 bytes an n-gram: n-grams are within words, so their number
grows with the words and scripts of the input and not with its size. A model is sorted arrays of 60-bit n-gram keys with discounted shares, and of context keys with back-off weights.

A text's words are scored once each; its cross-entropy under a language is the mean over its symbols. The least wins;
`score` is the posterior with a temperature fitted on the whole texts of all learning rows, and `rejected` tells that the
cross-entropy is above what `keep_share` of its language's learning rows stay under. For both, rows are dealt to folds by their
text, and models of the other folds, which don't count it or its copies, score it; a row whose language no other fold has says
nothing there. The sums of likelihoods and the numbers of rows by entropy (steps of 0.001) are taken where the rows lie. The
final models count all learning rows. A text that is null or has no letter is `und` with score 0. Learning rows need a label;
without any, all texts are `und`. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.llm.text import by_bytes, prefix_sums, release, stretch

ORDER = 5
BOUNDARY = 1
SHARDS = 16
PART_CHARS = 1 << 16
FOLDS = 2
STEP = 0.001
TEMPERATURES = 2.0 ** np.arange(-3, 8)
KEPT_BYTES = 1 << 25
_TABLE: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of every code point; 0: not a letter."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                k = ord(low) if len(low) == 1 else c
                table[c] = k if k < 4096 else 2 + (k * 2654435761 >> 8) % 4094
        _TABLE.append(table)
    return _TABLE[0]


class Spelling:
    """Distinct words of a batch of texts and where they stand."""

    def __init__(self, texts: list[str]) -> None:
        points = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")
        code = _classes()[points]
        letter = code > 0
        n = len(code)
        start = np.flatnonzero(letter & np.r_[True, ~letter[:-1]][:n])
        end = np.flatnonzero(letter & np.r_[~letter[1:], True][:n]) + 1
        self.first = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        name = stretch(prefix_sums(code.astype(np.uint64) + np.uint64(7)), start, end) if len(start) else np.empty(0, np.uint64)
        self.names, pick, self.word = np.unique(name, return_index=True, return_inverse=True)
        self.size = end[pick] - start[pick]
        self._code, self._start = code, start[pick]

    def spell(self, some: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Maximal n-grams of some distinct words, each with the boundary after it, and where each word begins."""
        size, start, code = self.size[some], self._start[some], self._code
        total = size + 1
        at = np.cumsum(total) - total
        place = np.arange(total.sum()) - np.repeat(at, total)
        source = np.repeat(start, total) + place
        last = place == np.repeat(size, total)
        n = len(code)
        symbols = np.where(last, BOUNDARY, code[np.minimum(source, max(n - 1, 0))] if n else 0).astype(np.uint64)
        key = symbols.copy()
        for j in range(1, ORDER):
            before = np.full(len(symbols), BOUNDARY, np.uint64)
            before[j:] = symbols[:-j] if j < len(symbols) else before[j:]
            before[place == j - 1] = BOUNDARY
            key |= np.where(place >= j - 1, before, 0).astype(np.uint64) << np.uint64(12 * j)
        return key, at

    @cached_property
    def key(self) -> np.ndarray:
        """Maximal n-grams of all distinct words."""
        return self.spell(slice(None))[0]

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)


def fold_of(text: str) -> int:
    """The fold of a text and all its copies."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, fold, shard, keys, counts (packed): all maximal n-grams of all rows, summed where they lie."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            kinds = list(zip(batch.column(1).to_pylist(), map(fold_of, texts), strict=True))
            for kind in set(kinds):
                mine = [t for t, k in zip(texts, kinds, strict=True) if k == kind]
                for a, b in by_bytes(np.array([len(t) for t in mine]), PART_CHARS):
                    s = Spelling(mine[a:b])
                    if len(s.word):
                        weight = np.repeat(np.bincount(s.word, minlength=len(s.size)), s.size + 1)
                        sums.setdefault(kind, []).append(_sum(s.key, weight))
                if len(sums.get(kind, [])) > 8:
                    sums[kind] = [_sum(*map(np.concatenate, zip(*sums[kind], strict=True)))]
        rows = []
        for kind, found in sums.items():
            key, n = _sum(*map(np.concatenate, zip(*found, strict=True)))
            shard = key % np.uint64(SHARDS)
            rows += [(*kind, k, key[shard == k].tobytes(), n[shard == k].astype("<i8").tobytes()) for k in range(SHARDS)]
        release()
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lang", "fold", "shard", "keys", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        key, n = _sum(np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u8"), np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i8"))
        return pa.table({**{c: table.column(c)[:1] for c in ("lang", "fold", "shard")}, "keys": pa.array([key.tobytes()], pa.binary()), "counts": pa.array([n.astype("<i8").tobytes()], pa.binary())})

    form = "lang string, fold int, shard int, keys binary, counts binary"
    return docs.select(docs[text_col].cast("string").alias("t"), docs[lang_col].cast("string").alias("g")).mapInArrow(count, form).groupBy("lang", "fold", "shard").applyInArrow(merge, form)


def _sum(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    s = key[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
    return s[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _length(key: np.ndarray) -> np.ndarray:
    return sum((key >> np.uint64(12 * j) > 0).astype(np.int64) for j in range(ORDER))


class KneserNey:
    """One language's model."""

    def __init__(self, key: np.ndarray, n: np.ndarray, symbols: int) -> None:
        length = _length(key)
        tables = {ORDER: (key[length == ORDER], n[length == ORDER])}
        for k in range(ORDER - 1, 0, -1):
            low = np.uint64((1 << 12 * k) - 1)
            above = tables[k + 1][0] & low
            own = length == k
            tables[k] = _sum(np.concatenate([above, key[own]]), np.concatenate([np.ones(len(above), np.int64), n[own]]))
        self.levels = []
        for k in range(1, ORDER + 1):
            grams, count = tables[k]
            once, twice = int((count == 1).sum()), int((count == 2).sum())
            d = once / (once + 2 * twice) if once and twice else 0.75
            context = grams >> np.uint64(12)
            at = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.empty(0, np.int64)
            total = np.add.reduceat(count, at) if len(at) else count[:0]
            types = np.diff(np.r_[at, len(context)])
            share = (count - d) / np.repeat(total, types) if len(at) else np.empty(0)
            self.levels.append((grams, share, context[at], d * types / np.maximum(total, 1)))
        self.symbols = symbols

    def logs(self, key: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of maximal n-grams."""
        p = np.full(len(key), 1.0 / self.symbols)
        length = _length(key)
        for k, (grams, share, context, weight) in enumerate(self.levels, 1):
            if not len(grams):
                continue
            gram = key & np.uint64((1 << 12 * k) - 1)
            at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            own = np.where(grams[at] == gram, share[at], 0.0)
            at = np.minimum(np.searchsorted(context, gram >> np.uint64(12)), len(context) - 1)
            known = (context[at] == gram >> np.uint64(12)) & (length >= k)
            p = np.where(known, own + weight[at] * p, p)
        return np.log(p)


class _Kept:
    """Rows of numbers by key, emptied when they outgrow their room. New ones go to a small table first, so that few are moved."""

    def __init__(self, width: int, most: int) -> None:
        self.width, self.room = width, min(most, KEPT_BYTES // (8 * (width + 1)))
        self.clear()

    def clear(self) -> None:
        self.tables = [(np.empty(0, np.uint64), np.empty((0, self.width)))] * 2

    def get(self, key: np.ndarray, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Rows of sorted distinct keys; work(places) gives those of new ones."""
        if sum(len(known) for known, _ in self.tables) > self.room:
            self.clear()
        out, left = np.empty((len(key), self.width)), np.arange(len(key))
        for known, rows in self.tables:
            at = np.searchsorted(known, key[left])
            old = known[np.minimum(at, len(known) - 1)] == key[left] if len(known) else np.zeros(len(left), bool)
            out[left[old]] = rows[at[old]]
            left = left[~old]
        if len(left):
            out[left] = work(left)
            large, small = self.tables[0], self._merged(self.tables[1], key[left], out[left])
            if len(small[0]) > max(len(large[0]) // 8, 1 << 12):
                large, small = self._merged(large, *small), (key[:0], out[:0])
            self.tables = [large, small]
        return out

    @staticmethod
    def _merged(table: tuple[np.ndarray, np.ndarray], key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table[0], key)
        return np.insert(table[0], at, key), np.insert(table[1], at, rows, axis=0)


class Models:
    """All languages; scores of words and n-grams are kept by the worker."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        symbols = len(np.unique(np.concatenate([np.empty(0, np.uint64), *(k & np.uint64(4095) for k, _ in counts.values())]))) + 1
        self.models = [KneserNey(*counts[g], symbols) for g in self.langs]
        self.temperature = 1.0
        self.limit = np.full(len(self.langs), np.inf)
        self.words, self.grams = _Kept(len(self.langs), 1 << 18), _Kept(len(self.langs), 1 << 19)

    def _logs(self, key: np.ndarray) -> np.ndarray:
        u, back = np.unique(key, return_inverse=True)
        return self.grams.get(u, lambda new: np.stack([m.logs(u[new]) for m in self.models], 1))[back]

    def _words(self, s: Spelling) -> np.ndarray:
        def work(new: np.ndarray) -> np.ndarray:
            key, at = s.spell(new)
            return -np.add.reduceat(self._logs(key), at, axis=0)

        return self.words.get(s.names, work)

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy a symbol under each language; NaN without letters."""
        out = np.full((len(texts), len(self.langs)), np.nan)
        for a, b in by_bytes(np.array([len(t) for t in texts]), PART_CHARS):
            s = Spelling(texts[a:b])
            n = s.counts()
            if not len(s.word):
                continue
            words = self._words(s)
            rows = np.flatnonzero(n)
            total = np.add.reduceat(words[s.word], s.first[:-1][rows], axis=0)
            size = np.add.reduceat((s.size + 1)[s.word], s.first[:-1][rows])
            out[a + rows] = total / size[:, None]
        return out

    def calibrate(self, held: Held, keep_share: float) -> None:
        """Temperature of greatest likelihood, and each language's limit."""
        rows = held.sums(keep_share)
        n, best = sum(r["n"] for r in rows), -np.inf
        for k, t in enumerate(TEMPERATURES):
            like = sum(r[f"like{k}"] for r in rows)
            if n and like > best + 1e-3 * n:
                best, self.temperature = like, float(t)
        for r in rows:
            self.limit[self.langs.index(r["lang"])] = r["bin"] * STEP * 1.05


class Crossed(Models):
    """Scores a text under the models of the other folds; a language that they lack has infinite entropy."""

    def __init__(self, counts: dict[int, dict[str, tuple[np.ndarray, np.ndarray]]]) -> None:
        self.parts = [Models(_added([c for f, c in counts.items() if f != k])) for k in range(FOLDS)]
        self.langs = sorted({g for c in counts.values() for g in c})
        self.temperature = 1.0
        self.limit = np.full(len(self.langs), np.inf)

    def entropies(self, texts: list[str]) -> np.ndarray:
        out = np.full((len(texts), len(self.langs)), np.inf)
        fold = np.array([fold_of(t) for t in texts], np.int64)
        for k, part in enumerate(self.parts):
            mine = np.flatnonzero(fold == k)
            if len(mine) and part.langs:
                out[np.ix_(mine, np.searchsorted(self.langs, part.langs))] = part.entropies([texts[i] for i in mine])
        return out


class Held:
    """Learning rows and models that don't count a text that they score: pairs of a label and entropies to go through, and
    their sums, taken where the rows lie."""

    def __init__(self, rows: DataFrame, models: Models) -> None:
        self.rows, self.shared = rows, rows.sparkSession.sparkContext.broadcast(models)

    def __iter__(self) -> Iterator[tuple[str, list[float]]]:
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = shared.value.entropies(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.tolist(), pa.list_(pa.float64()))], ["lang", "h"])

        return ((r["lang"], r["h"]) for r in self.rows.mapInArrow(run, "lang string, h array<double>").toLocalIterator())

    def sums(self, keep_share: float) -> list[Row]:
        """lang, n, bin (the quantile of their entropies, each rounded up to STEPs), like0.. (one a temperature)."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                models = shared.value
                place = {g: k for k, g in enumerate(models.langs)}
                y = np.array([place.get(g, -1) for g in batch.column(0).to_pylist()], np.int64)
                h = models.entropies(batch.column(1).to_pylist())
                ok = np.flatnonzero((y >= 0) & np.isfinite(h[np.arange(len(y)), y]) if len(models.langs) else y > 0)
                h, y, own = h[ok], y[ok], h[ok, y[ok]]
                likes = np.empty((len(ok), len(TEMPERATURES)))
                for k, t in enumerate(TEMPERATURES):
                    low = h.min(1) if len(h) else own
                    likes[:, k] = (low - own) * t - np.log(np.exp((low[:, None] - h) * t).sum(1))
                out = [(models.langs[k], None, None, likes[y == k].sum(0).tolist()) for k in np.unique(y)]
                pair, n = np.unique(np.stack([y, np.ceil(own / STEP).astype(np.int64)], 1), axis=0, return_counts=True)
                out += [(models.langs[k], b, c, None) for (k, b), c in zip(pair.tolist(), n.tolist(), strict=True)]
                release()
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["lang", "bin", "n", "like"])

        found = self.rows.mapInArrow(run, "lang string, bin long, n long, like array<double>")
        likes = [F.sum(F.col("like")[k]).alias(f"like{k}") for k in range(len(TEMPERATURES))]
        return found.groupBy("lang").agg(F.sum("n").alias("n"), F.percentile("bin", keep_share, F.col("n")).alias("bin"), *likes).collect()


def _gathered(rows: DataFrame, text_col: str, lang_col: str) -> dict[int, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Each fold's and language's n-grams and counts, sorted."""
    found: dict[int, dict[str, list]] = {}
    for r in gram_counts(rows, text_col, lang_col).collect():
        found.setdefault(r["fold"], {}).setdefault(r["lang"], []).append({r["lang"]: (np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["counts"], "<i8"))})
    return {f: {g: c for parts in by.values() for g, c in _added(parts).items() if len(c[0])} for f, by in found.items()}


def _added(counts: list[dict[str, tuple[np.ndarray, np.ndarray]]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The sums of several languages' counts."""
    return {g: _sum(*map(np.concatenate, zip(*(c[g] for c in counts if g in c), strict=True))) for g in sorted({g for c in counts for g in c})}


def learn(docs: DataFrame, learning: Column, text_col: str = "text", lang_col: str = "lang", keep_share: float = 0.999) -> Models:
    """Models of the learning rows that have a label."""
    rows = docs.where(learning & docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    counts = _gathered(rows, text_col, lang_col)
    models = Models(_added(list(counts.values())))
    if models.langs:
        crossed = Crossed(counts)
        del counts
        held = Held(rows.select(rows[lang_col].cast("string").alias("lang"), rows[text_col].cast("string").alias("text")), crossed)
        crossed.calibrate(held, keep_share)
        held.shared.unpersist()
        models.temperature, models.limit = crossed.temperature, crossed.limit
    return models


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if models.langs:
                h = models.entropies(texts)
                none = np.isnan(h).any(1)
                h = np.where(none[:, None], 0.0, h)
                best = h.argmin(1)
                low = h.min(1)
                score = np.where(none, 0.0, 1 / np.exp((low[:, None] - h) * models.temperature).sum(1))
                langs = np.where(none, "und", np.array(models.langs, object)[best]).tolist()
                entropy, over = [None if x else float(v) for x, v in zip(none, low, strict=True)], none | (low > models.limit[best])
            else:
                score, langs, entropy, over = np.zeros(len(texts)), ["und"] * len(texts), [None] * len(texts), np.ones(len(texts), bool)
            release()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(entropy, pa.float64()), pa.array(over)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
