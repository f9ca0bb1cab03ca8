"""Substring dedup by recompression.

A document's words are named by fingerprint; then rounds name maximal runs of one symbol and, after a random split of
all names in two halves, each pair of a left and a right symbol. A name is a fingerprint of its rule, so equal rules get
equal names in every task: the naming is global without a shuffle. With each symbol goes the stretch of words that its
extent depends on; a symbol is interior to a window if that stretch lies in the window, and then every copy of the
window holds the same symbol at the same place.

Pass A: each window of `width` words names its leftmost interior symbol of the highest level that has one; the distinct
symbols of a group of documents go to buckets, which answer which are shared. Pass B: windows at shared symbols are
verified by fingerprints of all their words; buckets answer for each whether a smaller doc_id of another group holds it.
Pass C removes. See `exchange` for the passes.

Null and empty texts: no words. Texts of fewer words than `width`: kept. A null doc_id counts as larger than all others;
rows that repeat a doc_id don't remove each other's windows. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import exchange as ex
from tidemark.llm.text import SPACE_WORD, Words, covered, mix, prefix_sums, stretch, whole_windows

PART_BYTES = 1 << 16
ROUNDS = 6


def levels(name: np.ndarray, first: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, from, to) of the symbols of each level; from:to is the stretch of words that a symbol depends on. It
    reaches past the document's edge where the edge decided something."""
    n = len(name)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left, right = first[:-1] - 1, first[1:] + 1
    lo, hi = np.arange(n), np.arange(1, n + 1)
    out = [(name, lo, hi)]
    for r in range(rounds):
        if not len(name):
            break
        near = doc[1:] == doc[:-1]
        head = np.ones(len(name), bool)
        head[1:] = ~(near & (name[1:] == name[:-1]))
        at = np.flatnonzero(head)
        tail = np.r_[at[1:], len(name)] - 1
        size = tail - at + 1
        before, after = np.maximum(at - 1, 0), np.minimum(tail + 1, len(name) - 1)
        d = doc[at]
        lo = np.where((at > 0) & (doc[before] == d), lo[before], left[d])
        hi = np.where((tail < len(name) - 1) & (doc[after] == d), hi[after], right[d])
        name = name[at]
        name = np.where(size > 1, mix(name ^ (size.astype(np.uint64) << np.uint64(40)), 2 * r + 1), name)
        doc = d
        is_left = (mix(name, 1000 + r) >> np.uint64(17) & np.uint64(1)).astype(bool)
        near = doc[1:] == doc[:-1]
        pair = np.zeros(len(name), bool)
        pair[:-1] = near & is_left[:-1] & ~is_left[1:]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        nlo, nhi = lo.copy(), hi.copy()
        alone = ~pair & ~second
        l_at, r_at = np.flatnonzero(alone & is_left), np.flatnonzero(alone & ~is_left)
        after, before = np.minimum(l_at + 1, len(name) - 1), np.maximum(r_at - 1, 0)
        nhi[l_at] = np.where((l_at + 1 < len(name)) & (doc[after] == doc[l_at]), hi[after], right[doc[l_at]])
        nlo[r_at] = np.where((r_at > 0) & (doc[before] == doc[r_at]), lo[before], left[doc[r_at]])
        p = np.flatnonzero(pair)
        with np.errstate(over="ignore"):
            joined = mix(name[p] * np.uint64(0x9FB21C651E98DF25) + mix(name[p + 1], 5), 2 * r + 2)
        nhi[p] = hi[p + 1]
        name = name.copy()
        name[p] = joined
        keep = ~second
        name, lo, hi, doc = name[keep], nlo[keep], nhi[keep], doc[keep]
        out.append((name, lo, hi))
    return out


def anchors(words: Words, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and the interior symbol that each names."""
    start = whole_windows(words.first, width)
    key = np.zeros(len(start), np.uint64)
    open_ = np.arange(len(start))
    found = levels(words.name, words.first, rounds)
    for level in range(len(found) - 1, -1, -1):
        name, lo, hi = found[level]
        p = start[open_]
        i = np.searchsorted(lo, p)
        ok = i < len(name)
        ok[ok] = hi[i[ok]] <= p[ok] + width
        key[open_[ok]] = mix(name[i[ok]], 2000 + level)
        open_ = open_[~ok]
        if not len(open_):
            break
    return start, key


class _Group:
    """The documents of a group: windows, their symbols, their fingerprints."""

    def __init__(self, table: pa.Table, width: int) -> None:
        self.width = width
        self.parts = []
        for ids, data, off, a, b in ex.parts(table, PART_BYTES):
            words = Words(data, off, SPACE_WORD)
            start, key = anchors(words, width)
            doc = ids[np.searchsorted(words.first, start, "right") - 1]
            self.parts.append((ids, words, start, key, doc, data, off))

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct symbols, and whether two documents of the group hold it."""
        pairs = [(p[3], p[4]) for p in self.parts]
        short = []
        for key, doc in pairs:  # neighbours mostly name the same symbol
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            short.append((key[new], doc[new]))
        key = np.concatenate([np.empty(0, np.uint64), *(k for k, _ in short)])
        doc = np.concatenate([np.empty(0, np.int64), *(d for _, d in short)])
        order, at, _ = ex.by_key(key)
        if not len(order):
            return key, np.zeros(0, bool)
        doc = doc[order]
        return key[order][at], np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Distinct fingerprints of the windows at shared symbols, the least doc_id of each, and those windows by part."""
        picked = []
        for _, words, start, key, doc, *_ in self.parts:
            hit, _ = ex.member(shared, key)
            s = start[hit]
            picked.append((s, stretch(prefix_sums(words.name), s, s + self.width) if len(s) else np.empty(0, np.uint64), doc[hit]))
        prints = np.concatenate([np.empty(0, np.uint64), *(p[1] for p in picked)])
        doc = np.concatenate([np.empty(0, np.int64), *(p[2] for p in picked)])
        order, at, _ = ex.by_key(prints)
        if not len(order):
            return prints, doc, picked
        return prints[order][at], np.minimum.reduceat(doc[order], at), picked


def _told(told: pa.Table, symbols: np.ndarray) -> np.ndarray:
    return symbols[ex.bits(told, 0)] if len(symbols) else symbols


def substring_dedup(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, span_starts, span_lengths (removed runs of words), kept_text (kept words, one space
    between) of every document."""
    way = ex.Exchange(docs)
    buckets = way.buckets
    rows = ex.dealt(docs, id_col, text_col, way.groups)

    def name(grp: int, table: pa.Table) -> list[tuple]:
        key, many = _Group(table, width).symbols()
        return ex.send(grp, 0, key, buckets, lambda a, b: np.packbits(many[a:b]).tobytes())

    def shared(table: pa.Table) -> list[tuple]:
        heads, keys, _, extras = ex.gathered(table)
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=h[3]) for h, x in zip(heads, extras, strict=True)]).astype(bool)
        order, at, run = ex.by_key(keys)
        yes = (np.diff(np.r_[at, len(order)]) > 1) | np.logical_or.reduceat(many[order], at)
        flags = np.empty(len(keys), bool)
        flags[order] = yes[run]
        return ex.answers(heads, flags)

    def verify(grp: int, table: pa.Table, told: pa.Table) -> pa.Table:
        group = _Group(table, width)
        prints, least, _ = group.windows(_told(told, group.symbols()[0]))
        return ex.row_table(ex.send(grp, 1, prints, buckets, lambda a, b: ex.planes(least[a:b])))

    def smaller(table: pa.Table) -> list[tuple]:
        heads, keys, _, extras = ex.gathered(table)
        least = np.concatenate([ex.unplanes(x) for x in extras]).astype(np.int64)
        order, at, run = ex.by_key(keys)
        flags = np.empty(len(keys), bool)
        flags[order] = np.minimum.reduceat(least[order], at)[run] < least[order]
        return ex.answers(heads, flags)

    def remove(grp: int, table: pa.Table, told: pa.Table) -> pa.Table:
        group = _Group(table, width)
        prints, least, picked = group.windows(_told(told, group.symbols()[0]))
        outside = ex.bits(told, 1)
        out = []
        for (ids, words, _, _, _, data, off), (start, own, doc) in zip(group.parts, picked, strict=True):
            _, at = ex.member(prints, own)
            gone = covered(start[outside[at] | (least[at] < doc)] if len(own) else start, width, len(words.name))
            raw = data.tobytes()
            for d in range(len(ids)):
                mine = gone[words.first[d] : words.first[d + 1]]
                edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
                text = raw[off[d] : off[d + 1]].split()
                kept = b" ".join(compress(text, (~mine).tolist()) if len(edge) else text)
                out.append((None if ids[d] == ex.NO_ID else int(ids[d]), len(mine), int(mine.sum()), edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), kept.decode()))
        many = pa.list_(pa.int64())
        return ex.as_table(out, [pa.int64(), pa.int64(), pa.int64(), many, many, pa.string()], ["doc_id", "n_words", "n_removed", "span_starts", "span_lengths", "kept_text"])

    symbols = way.answer_pass(way.send_pass(rows, name), shared)
    prints = way.answer_pass(way.joined_pass(rows, symbols, verify), smaller)
    return way.joined_pass(rows, symbols.unionByName(prints), remove, "doc_id long, n_words long, n_removed long, span_starts array<long>, span_lengths array<long>, kept_text string")
