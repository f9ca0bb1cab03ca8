"""Removal of long repeats by run-length indexes.

A repeat of `width` bytes is found where it is anchored: every window of `width` bytes names the least of the
fingerprints of the `GRAM`-byte strings in it (the leftmost of equal ones), so equal windows name equal anchors at equal
places. The consecutive windows of one anchor make a fragment of less than 2 x width bytes.

Pass A: buckets answer which anchors occur more than once, and which bring more than `HOT` fragments to a bucket. Pass B:
each group sends the distinct fragments of its repeated anchors with their texts and numbers. A bucket indexes them: it
builds their suffix order, run-compresses the Burrows-Wheeler transform, measures common prefixes at the ends of runs
only, and streams matching statistics from those samples along the text (inside a run they fall by one a byte). Copies of a
fragment lie in the runs of the first, as numbers; the match of a place in a copied one is all that is left of it. Windows
whose longest match elsewhere has `width` bytes are marked. An anchor of more than `HOT` fragments (those of a group that
are alike count once) may have them without bound, which no single task may gather: its windows are counted one by one by
fingerprint, spread over all buckets and summed in each group before. Pass C removes. See `exchange`.

Null text: empty. Null or repeated doc_ids: each row is a document. Texts under `width` bytes: kept. An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as ex
from tidemark.llm.text import byte_sums, covered, mix, stretch, whole_windows, windows

PART_BYTES = 1 << 16
GRAM = 48
HOT = 1024
INDEX_BYTES = 1 << 18


def minimizers(data: np.ndarray, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each fragment: its first byte, its number of windows, its anchor, its fingerprint."""
    start = whole_windows(off, width)
    none = np.empty(0, np.int64)
    if not len(start):
        return none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
    sums = byte_sums(data)
    prints = windows(sums, gram)
    low = np.uint64((1 << int(len(prints)).bit_length()) - 1)
    least = prints & ~low | np.arange(len(prints), dtype=np.uint64)
    span, have = width - gram + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        more = span - have
        least = np.minimum(least[:-more], least[more:])
    at = (least[start] & low).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(start)])
    # least values aren't spread
    return start[first], n, mix(prints[at[first]], 3), stretch(sums, start[first], start[first] + n + width - 1)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start:start + size] of all rows end to end."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of texts laid end to end, none matching beyond its end. copied: which
    of them occur more than once; a copy lengthens runs and makes none."""

    def __init__(self, data: np.ndarray, off: np.ndarray, copied: np.ndarray | None = None) -> None:
        n = len(data)
        self.data = data
        self.copied = np.zeros(n, bool) if copied is None else np.repeat(copied, np.diff(off))
        self.rest = np.repeat(off[1:], np.diff(off)) - np.arange(n)
        self.ranks: list[tuple[int, np.ndarray]] = []
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = key << np.uint64(8) | np.where(self.rest > j, padded[j : n + j], 0).astype(np.uint64)
        depth, longest = 8, int(np.diff(off).max(initial=0))
        while True:
            order = np.argsort(key)
            s = key[order]
            new = np.ones(n, bool)
            new[1:] = s[1:] != s[:-1]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new)
            self.ranks.append((depth, rank))
            if depth >= longest or new.all():
                break
            later = np.zeros(n, np.int32)
            later[: n - depth] = np.where(self.rest[: n - depth] > depth, rank[depth:], 0)
            key = rank.astype(np.uint64) << np.uint64(32) | later.astype(np.uint64)
            depth *= 2
        self.order = order if new.all() else np.argsort(rank, kind="stable")  # equal suffixes by place
        before = np.where(np.isin(np.arange(n), off[:-1]), -1 - np.arange(n), np.r_[0, data[:-1]].astype(np.int64))[self.order]
        self.heads = np.ones(n, bool)
        self.heads[1:] = before[1:] != before[:-1]
        self.runs = int(self.heads.sum())

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes."""
        most = np.minimum(self.rest[a], self.rest[b])
        n = np.zeros(len(a), np.int64)
        for depth, rank in reversed(self.ranks):
            inside = n + depth <= most
            same = inside & (rank[np.where(inside, a + n, 0)] == rank[np.where(inside, b + n, 0)])
            n += depth * same
        going = n < most
        while going.any():
            at = np.flatnonzero(going)
            same = self.data[a[at] + n[at]] == self.data[b[at] + n[at]]
            n[at[same]] += 1
            going[at[~same]] = False
            going &= n < most
        return n

    def statistics(self) -> np.ndarray:
        """For each place the length of the longest match that begins elsewhere: sampled at the ends of runs."""
        n = len(self.order)
        out = np.where(self.copied, self.rest, 0)
        if n < 2:
            return out
        places = np.arange(n)
        for ends, other in ((np.flatnonzero(self.heads), -1), (np.flatnonzero(np.r_[self.heads[1:], True]), 1)):
            x, k = self.order[ends], ends + other
            has = (k >= 0) & (k < n)
            length = np.zeros(len(ends), np.int64)
            length[has] = self.common(x[has], self.order[k[has]])
            sampled = np.zeros(n, bool)
            sampled[x] = True
            value = np.zeros(n, np.int64)
            value[x] = length
            last = np.maximum.accumulate(np.where(sampled, places, 0))
            out = np.maximum(out, value[last] - (places - last))
        return out


class _Group:
    """The fragments of a group of documents."""

    def __init__(self, table: pa.Table, width: int, gram: int) -> None:
        self.width = width
        self.parts = [(ids, data, off, *minimizers(data, off, width, gram)) for ids, data, off, *_ in ex.parts(table, PART_BYTES)]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors; twice the number of their distinct fragments in the group, up to 32767, and 1 if one of them is there
        again."""
        key, prints = (np.concatenate([np.empty(0, np.uint64), *(p[k] for p in self.parts)]) for k in (5, 6))
        order = np.lexsort((prints, key))
        key, prints = key[order], prints[order]
        new, fresh = np.ones(len(key), bool), np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        fresh[1:] = new[1:] | (prints[1:] != prints[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return key, np.empty(0, np.uint16)
        places, kinds = np.diff(np.r_[first, len(key)]), np.add.reduceat(fresh.astype(np.int64), first)
        return key[first], (2 * np.minimum(kinds, 32767) + (places > kinds)).astype(np.uint16)

    def told(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Anchors that are repeated but not hot, and hot ones."""
        keys, _ = self.anchors()
        if not len(keys):
            return keys, keys
        many, hot = ex.bits(table, 0), ex.bits(table, 0, 1)
        return keys[many & ~hot], keys[hot]

    def fragments(self, anchors: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By part (fragment numbers, their entries); of each distinct fragment: anchor, fingerprint, count, windows,
        and all texts end to end."""
        picked, key, prints, count, texts = [], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
        for _, data, _, start, n, anchor, mine in self.parts:
            at = np.flatnonzero(ex.member(anchors, anchor)[0])
            picked.append(at)
            key.append(anchor[at])
            prints.append(mine[at])
            count.append(n[at])
            texts.append(gather(data, start[at], n[at] + self.width - 1))
        key, prints, count = map(np.concatenate, (key, prints, count))
        order = np.lexsort((prints, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (prints[order][1:] != prints[order][:-1])
        first = np.flatnonzero(new)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        rep = order[first]
        size = count + self.width - 1
        text = gather(np.concatenate(texts), (np.cumsum(size) - size)[rep], size[rep])
        ends = np.cumsum([len(p) for p in picked])
        by_part = [(p, entry[e - len(p) : e]) for p, e in zip(picked, ends, strict=True)]
        return by_part, key[rep], prints[rep], np.diff(np.r_[first, len(order)]), count[rep], text

    def windows(self, anchors: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """By part the windows at hot anchors and their fingerprints; distinct fingerprints, and whether the group has
        more than one of each."""
        picked = []
        for _, data, _, start, n, anchor, _ in self.parts:
            hit = ex.member(anchors, anchor)[0]
            sums = byte_sums(data) if hit.any() else np.zeros(1, np.uint64)
            s, k = start[hit], n[hit]
            at = np.repeat(s - (np.cumsum(k) - k), k) + np.arange(k.sum())
            picked.append((at, stretch(sums, at, at + self.width)))
        keys, count = np.unique(np.concatenate([np.empty(0, np.uint64), *(p for _, p in picked)]), return_counts=True)
        return picked, keys, count > 1


def repeated(key: np.ndarray, prints: np.ndarray, count: np.ndarray, n: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Marks, window after window, for the fragments that a bucket got: which windows occur elsewhere."""
    order = np.lexsort((prints, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (prints[order][1:] != prints[order][:-1])
    first = np.flatnonzero(new)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    rep = order[first]
    total = np.add.reduceat(count[order], first)
    size = n + width - 1
    at = np.cumsum(size) - size
    anchor, ends = key[rep], np.cumsum(size[rep])
    marks: list[np.ndarray] = []
    while len(marks) < len(rep):  # whole anchors, about INDEX_BYTES at a time
        a = len(marks)
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + INDEX_BYTES, "right")), a + 1)
        b = int(np.searchsorted(anchor, anchor[b - 1], "right"))
        mine = rep[a:b]
        off = np.r_[0, np.cumsum(size[mine])]
        found = RunIndex(gather(text, at[mine], size[mine]), off, total[a:b] > 1).statistics() >= width
        marks += [found[o : o + k] for o, k in zip(off.tolist(), n[mine].tolist(), strict=False)]
    return np.concatenate([marks[e] for e in entry.tolist()]) if len(entry) else np.empty(0, bool)


def _whole_chars(data: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans narrowed to whole UTF-8 characters."""
    inside = lambda k: k < len(data) and data[k] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while a < b and inside(a):
            a += 1
        while b > a and inside(b):
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def suffix_dedup(docs: DataFrame, width: int = 200, whole_chars: bool = False, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, span_starts, span_lengths, kept (binary, the bytes that stay) of every
    document. whole_chars: runs are narrowed so that no character is cut, and kept is UTF-8. carry: columns of
    the input that come along in a struct, rest."""
    gram = min(gram, width)
    way = ex.Exchange(docs)
    buckets = way.buckets
    rows = ex.dealt(docs, id_col, text_col, way.groups, carry)

    def name(grp: int, table: pa.Table) -> list[tuple]:
        keys, count = _Group(table, width, gram).anchors()
        return ex.send(grp, 0, keys, buckets, lambda a, b: count[a:b].astype("<u2").tobytes())

    def shared(table: pa.Table) -> list[tuple]:
        heads, keys, _, extras = ex.gathered(table)
        order, at, run = ex.by_key(keys)
        told = np.frombuffer(b"".join(extras), "<u2").astype(np.int64)[order]
        total, again = np.add.reduceat(told >> 1, at), np.logical_or.reduceat(told & 1 > 0, at)
        many, most = np.empty(len(keys), bool), np.empty(len(keys), bool)
        many[order], most[order] = (again | (total > 1))[run], (total > hot)[run]
        return ex.answers(heads, many, most)

    def evidence(grp: int, table: pa.Table, told: pa.Table) -> pa.Table:
        group = _Group(table, width, gram)
        cool, hot_ones = group.told(told)
        _, key, prints, count, n, text = group.fragments(cool)
        end = np.r_[0, np.cumsum(n + width - 1)]

        def packed(a: int, b: int) -> bytes:
            return b"".join((prints[a:b].astype("<u8").tobytes(), count[a:b].astype("<u4").tobytes(), n[a:b].astype("<u4").tobytes(), text[end[a] : end[b]].tobytes()))

        _, wins, many = group.windows(hot_ones)
        return ex.row_table(ex.send(grp, 2, key, buckets, packed) + ex.send(grp, 3, wins, buckets, lambda a, b: np.packbits(many[a:b]).tobytes()))

    def mark(table: pa.Table) -> list[tuple]:
        out = []
        steps = table.column("step").to_numpy() % ex.STEPS
        if (part := table.filter(pa.array(steps == 2))).num_rows:
            heads, key, _, extras = ex.gathered(part)
            prints, count, n, text = [], [], [], []
            for h, x in zip(heads, extras, strict=True):
                k = h[3]
                prints.append(np.frombuffer(x, "<u8", k))
                count.append(np.frombuffer(x, "<u4", k, 8 * k))
                n.append(np.frombuffer(x, "<u4", k, 12 * k))
                text.append(np.frombuffer(x, np.uint8, offset=16 * k))
            sizes = [int(x.sum()) for x in n]
            marks = repeated(key, np.concatenate(prints), np.concatenate(count).astype(np.int64), np.concatenate(n).astype(np.int64), np.concatenate(text), width)
            out += ex.answers([(*h[:3], s) for h, s in zip(heads, sizes, strict=True)], marks)
        if (part := table.filter(pa.array(steps == 3))).num_rows:
            heads, keys, _, extras = ex.gathered(part)
            many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=h[3]) for h, x in zip(heads, extras, strict=True)]).astype(bool)
            order, at, run = ex.by_key(keys)
            flags = np.empty(len(keys), bool)
            flags[order] = ((np.diff(np.r_[at, len(order)]) > 1) | np.logical_or.reduceat(many[order], at))[run]
            out += ex.answers(heads, flags)
        return out

    def remove(grp: int, table: pa.Table, told: pa.Table) -> pa.Table:
        group = _Group(table, width, gram)
        cool, hot_ones = group.told(told)
        by_part, _, _, _, n, _ = group.fragments(cool)
        picked, wins, _ = group.windows(hot_ones)
        marks, again = ex.bits(told, 2), ex.bits(told, 3)
        first = np.cumsum(n) - n
        out = []
        for (ids, data, off, start, size, *_), (at, entry), (win, prints) in zip(group.parts, by_part, picked, strict=True):
            k = size[at]
            shift = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            yes = marks[np.repeat(first[entry], k) + shift] if len(k) else np.empty(0, bool)
            dup = [(np.repeat(start[at], k) + shift)[yes]]
            if len(win):
                dup.append(win[again[ex.member(wins, prints)[1]]])
            gone = covered(np.concatenate(dup), width, len(data))
            for d in range(len(ids)):
                raw, mine = data[off[d] : off[d + 1]], gone[off[d] : off[d + 1]]
                edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
                spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                if whole_chars and spans:
                    spans = _whole_chars(raw, spans)
                    mine = np.zeros(len(raw), bool)
                    for a, b in spans:
                        mine[a:b] = True
                out.append((None if ids[d] == ex.NO_ID else int(ids[d]), len(raw), int(mine.sum()), len(spans), [a for a, _ in spans], [b - a for a, b in spans], (raw[~mine] if spans else raw).tobytes()))
        many = pa.list_(pa.int64())
        done = ex.as_table(out, [pa.int64()] * 4 + [many, many, pa.binary()], ["doc_id", "n_bytes", "n_removed", "n_spans", "span_starts", "span_lengths", "kept"])
        return done.append_column("rest", table.column("rest")) if carry else done  # the parts keep the rows' order

    form = "doc_id long, n_bytes long, n_removed long, n_spans long, span_starts array<long>, span_lengths array<long>, kept binary"
    form += f", rest {rows.schema['rest'].dataType.simpleString()}" if carry else ""
    anchors = way.answer_pass(way.send_pass(rows, name), shared)
    marks = way.answer_pass(way.joined_pass(rows, anchors, evidence), mark)
    return way.joined_pass(rows, anchors.unionByName(marks), remove, form)


def cut_repeats(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with their texts' repeats cut out; n_chars, if there, follows. A null text stays."""
    done = suffix_dedup(docs.withColumn("_null", F.when(F.col(text_col).isNull(), True)), width, True, id_col=id_col, text_col=text_col, carry=(*(c for c in docs.columns if c != text_col), "_null"))
    text = F.when(F.col("rest._null").isNull(), F.col("kept").cast("string"))
    cols = [text if c == text_col else F.char_length(text).cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"rest.`{c}`") for c in docs.columns]
    return done.select(*(c.alias(n) for c, n in zip(cols, docs.columns, strict=True)))
