"""N-gram Jaccard join with adaptive multi-match prefixes.

1. One map gives each document's number of shingles and two 64-bit sums of its set; equal sets are one class, of which
   only the least doc_id goes on. The same map tells which shingles are frequent; the most frequent `ORDERED` come last in
   the order of tokens that all documents share, the others go by hash.
2. A document's prefix tokens are posted to buckets. The prefix is lengthened by l - 1 tokens, where l are `quarters` / 4
   of the tokens that the document can lack, and then any partner shares l of its tokens. A posting list is split by sizes
   that can link; each part with two documents sends them to meet at its first document (by a hash of the ids). Documents
   that could link share such a part, so they meet somewhere. One that shares fewer than l tokens in all meets nobody: so
   shared passages cost postings but no sets. A part of more than `block` documents is split over as many meetings as
   needed, each with the first document.
3. At a meeting the prefixes adapt: each document takes the number l of matches, and a prefix l - 1 tokens longer, for which
   the estimated cost of its candidates is least, and a pair is verified only if it shares min(l, l') prefix tokens. Pairs
   that are already connected are skipped, so a group of near copies costs its size, not its square.
4. Members of a split meeting that are not in its largest component by then meet all the others of it in blocks.

Links go to `connected_components`. Result: doc_id, n_shingles, component_id.

Texts without words, and null texts, have empty sets and link with nothing, not even each other. Rows of one doc_id are one
component, each with its own text's links: where their texts differ, all but one get a node of their own, numbered from 2^62
on, and a link to the doc_id. A null doc_id links with nothing and has itself, null, as component. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as ex
from tidemark.llm.components import checkpoints, connected_components
from tidemark.llm.text import SPACE_WORD, Words, by_bytes, flat, mix, prefix_sums, release, stretch

PART_BYTES = 1 << 16
ORDERED = 1 << 16
BLOCK = 128
BROADCAST_IDS = 1 << 19
TWINS = 1 << 62
MATCHES = (1, 2, 4, 8, 16)
_SET = 6  # bytes of a token where sets meet: a meeting has few enough tokens to tell them apart


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row of each part, and each row's distinct shingles, sorted."""
    data, off = flat(column)
    for a, b in by_bytes(np.diff(off), PART_BYTES):
        words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a], SPACE_WORD, fold=True)
        sums, n = prefix_sums(words.name), words.counts
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        first = np.cumsum(count) - count
        start = np.repeat(words.first[:-1] - first, count) + np.arange(count.sum())
        length = np.repeat(np.minimum(n, size), count)
        name = stretch(sums, start, start + length) if len(start) else np.empty(0, np.uint64)
        yield a, [np.unique(name[f : f + c]) for f, c in zip(first.tolist(), count.tolist(), strict=True)]


def _matches(n: np.ndarray | int, percent: int, quarters: int) -> np.ndarray | int:
    """Prefix tokens that a set of n must share with a partner where sets are posted: quarters of what it can lack."""
    return np.maximum(1, (n - _needed(n, percent)) * quarters // 4)


def _needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap that a set of n can have with a partner."""
    return -(-n * percent // 100)


def _survey(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: doc_id, n_shingles and the two sums of its set. kind 1: a shingle that many rows of a batch hold, and how
    many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, all_sets = [], []
            for _, sets in shingle_sets(batch.column(1), size):
                for s in sets:
                    sums.append((len(s), int(mix(s, 1).sum()), int(mix(s, 2).sum())))
                    all_sets.append(s)
            n = np.array([x[0] for x in sums], np.int64)
            one, two = (np.array([x[k] for x in sums], np.uint64).astype(np.int64) for k in (1, 2))
            _, pick = np.unique(one, return_index=True)
            token, times = np.unique(np.concatenate([np.empty(0, np.uint64), *(all_sets[k] for k in pick.tolist())]), return_counts=True)
            many = times >= max(4, len(pick) // 512)
            token, times = token[many].astype(np.int64), times[many].astype(np.int64)
            none = pa.nulls(len(token), pa.int64())
            release()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[np.zeros(len(n)), np.ones(len(token))].astype(np.int32)), pa.concat_arrays([batch.column(0).cast(pa.int64()), none]), pa.array(np.r_[n, times]), pa.array(np.r_[one, token]), pa.array(np.r_[two, np.zeros(len(token), np.int64)])],
                ["kind", "doc_id", "n", "a", "b"],
            )

    return docs.mapInArrow(run, "kind int, doc_id long, n long, a long, b long")


class _Order:
    """Tokens from rare to frequent, and by hash."""

    def __init__(self, token: np.ndarray, times: np.ndarray) -> None:
        at = np.argsort(token)
        self.token = token[at]
        self.grade = np.array([int(t).bit_length() for t in times[at]], np.int8)

    def sort(self, s: np.ndarray) -> np.ndarray:
        hit, at = ex.member(self.token, s)
        return s[np.argsort(np.where(hit, self.grade[at], 0), kind="stable")] if hit.any() else s


def _priority(doc: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.uint64), 77)


def _compatible(key: np.ndarray, doc: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of posting lists by the sizes that can link: (list and size group, entry). Sizes fall in classes of ratio
    100 / percent, and a group is two neighbouring classes, so sizes that can link share a group; groups that another holds
    are left out, and so are entries without a size near enough."""
    size_class = np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int64)
    entry = np.tile(np.arange(len(key)), 2)
    lower = np.concatenate([size_class, size_class - 1])
    order = np.lexsort((n[entry], lower, key[entry]))
    entry, lower = entry[order], lower[order]
    k, size, own = key[entry], n[entry], size_class[entry] == lower
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (lower[1:] != lower[:-1])
    at = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    if not len(at):
        return run, entry
    has_low, has_high = np.logical_or.reduceat(own, at), np.logical_or.reduceat(~own, at)
    below = np.zeros(len(at), bool)  # the group before, of the same list, one class down, holds the lower class already
    first = entry[at]
    below[1:] = (key[first][1:] == key[first][:-1]) & (lower[at][1:] == lower[at][:-1] + 1) & has_low[:-1]
    keep = has_low & (has_high | ~below)
    near = np.zeros(len(k), bool)
    close = ~new[1:] & (100 * size[:-1] >= percent * size[1:])
    near[1:] |= close
    near[:-1] |= close
    good = keep[run] & near
    return run[good], entry[good]


def _posted(bucket: pa.Table, percent: int, block_size: int) -> pa.Table:
    """Meetings of a bucket's posting lists, a packed row a group: doc, centre, block (0 or, for split ones, their number +
    the block's), the set's size and the number of lists."""
    heads, key, row, extras = ex.gathered(bucket)
    doc = np.concatenate([ex.unplanes(x[: 8 * h[3]]) for h, x in zip(heads, extras, strict=True)]).astype(np.int64)
    n = np.concatenate([ex.unplanes(x[8 * h[3] :]) for h, x in zip(heads, extras, strict=True)]).astype(np.int64)
    grp = np.array([h[0] for h in heads], np.int32)[row]
    run, entry = _compatible(key, doc, n, percent)
    doc, grp = doc[entry], grp[entry]
    order = np.lexsort((_priority(doc), run))
    run, doc, grp = run[order], doc[order], grp[order]
    new = np.ones(len(run), bool)
    new[1:] = run[1:] != run[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.r_[at, len(run)])
    of = np.cumsum(new) - 1
    parts = np.ones(len(size), np.int64)
    big = size > block_size
    parts[big] = 1 << np.ceil(np.log2(size[big] / block_size)).astype(np.int64)
    parts_of = parts[of]
    block = np.where(parts_of > 1, parts_of + (mix(doc.astype(np.uint64), 5) % parts_of.astype(np.uint64)).astype(np.int64), 0)
    here = size[of] > 1
    rows = [np.stack([doc[at][of][here], doc[here], grp[here], block[here]]).astype(np.int64)]
    for k in np.flatnonzero(big):  # the first document goes to every part
        p = int(parts[k])
        rows.append(np.stack([np.full(p, doc[at[k]]), np.full(p, doc[at[k]]), np.full(p, grp[at[k]]), p + np.arange(p)]).astype(np.int64))
    n = n[entry][order]
    seen = np.concatenate([np.full(r.shape[1], k == 0, np.int64) for k, r in enumerate(rows)])
    size = np.concatenate([n[here] if k == 0 else np.zeros(r.shape[1], np.int64) for k, r in enumerate(rows)])
    m, back = np.unique(np.concatenate(rows, axis=1)[[2, 1, 0, 3]], axis=1, return_inverse=True)
    back = back.ravel()
    times, most = np.bincount(back, seen, m.shape[1]).astype(np.int64), np.zeros(m.shape[1], np.int64)
    np.maximum.at(most, back, size)
    at = np.flatnonzero(np.r_[True, m[0][1:] != m[0][:-1]]) if m.shape[1] else np.empty(0, np.int64)
    out = [(int(m[0][x]), y - x, b"".join(ex.planes(c[x:y]) for c in (m[1], m[2], m[3], most, times))) for x, y in zip(at.tolist(), [*at[1:].tolist(), m.shape[1]], strict=False)]
    return ex.as_table(out, [pa.int32(), pa.int32(), pa.binary()], ["grp", "n", "packed"])


def _invited(packed: pa.Table, percent: int, quarters: int) -> pa.Table:
    """Who of a group goes to which meeting: what the buckets say of each document together, without those that share too
    little."""
    cols: list[list[np.ndarray]] = [[], [], [], [], []]
    for k, raw in zip(packed.column("n").to_pylist(), packed.column("packed").to_pylist(), strict=True):
        for j, c in enumerate(cols):
            c.append(ex.unplanes(raw[8 * k * j : 8 * k * (j + 1)]).astype(np.int64))
    doc, centre, block, n, times = (np.concatenate(c) for c in cols)
    _, who = np.unique(doc, return_inverse=True)
    size = np.zeros(int(who.max()) + 1, np.int64)
    np.maximum.at(size, who, n)
    good = (np.bincount(who, times) >= _matches(size, percent, quarters))[who]
    m = np.unique(np.stack([centre, doc, block])[:, good], axis=1)
    return pa.table({"grp": pa.array(np.full(m.shape[1], packed.column("grp")[0].as_py(), np.int32)), "centre": pa.array(m[0]), "doc": pa.array(m[1]), "block": pa.array(m[2]), "seed": pa.nulls(m.shape[1], pa.int64())})


class Meeting:
    """Documents with their sets in the common order; finds which are connected by links."""

    def __init__(self, docs: np.ndarray, sets: list[np.ndarray], percent: int) -> None:
        self.docs, self.percent = docs, percent
        self.n = np.array([len(s) for s in sets])
        _, back = np.unique(np.concatenate(sets), return_inverse=True)
        self.first = np.r_[0, np.cumsum(self.n)]
        self.token = back
        self.up = np.arange(len(docs))
        self.spare = self.n - _needed(self.n, percent)
        most = np.minimum(self.spare + max(MATCHES), self.n)
        place = np.arange(len(back)) - np.repeat(self.first[:-1], self.n)
        owner = np.repeat(np.arange(len(docs)), self.n)
        near = place < np.repeat(most, self.n)
        times = np.bincount(back[near], minlength=int(back.max(initial=0)) + 1)
        cost = np.where(near, times[back] - 1, 0)
        total = np.r_[0, np.cumsum(cost)]
        best = np.full(len(docs), np.inf)
        self.matches = np.ones(len(docs), np.int64)
        for m in MATCHES:
            to = np.minimum(self.spare + m, self.n)
            seen = total[self.first[:-1] + to] - total[self.first[:-1]]
            price = seen + self.n * seen / m
            better = (price < best) & (self.spare + m <= self.n)
            best[better], self.matches[better] = price[better], m
        inside = place < np.repeat(np.minimum(self.spare + self.matches, self.n), self.n)
        order = np.argsort(back[inside], kind="stable")
        self.holder = owner[inside][order]
        self.at = np.searchsorted(back[inside][order], np.arange(len(times) + 1))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def roots(self) -> np.ndarray:
        up = self.up
        while (up[up] != up).any():
            up = up[up]
        self.up = up
        return up

    def join(self, x: int, others: np.ndarray) -> None:
        for y in others.tolist():
            a, b = self.root(x), self.root(y)
            self.up[max(a, b)] = min(a, b)

    def probe(self, x: int) -> None:
        """Links x to what it is like, but for what it is connected with already."""
        mine = self.token[self.first[x] : self.first[x + 1]]
        prefix = mine[: min(self.spare[x] + self.matches[x], self.n[x])]
        found = np.concatenate([self.holder[self.at[t] : self.at[t + 1]] for t in prefix.tolist()])
        other, shared = np.unique(found, return_counts=True)
        roots = self.roots()
        ok = (shared >= np.minimum(self.matches[other], self.matches[x])) & (roots[other] != roots[x])
        ok &= 100 * np.minimum(self.n[other], self.n[x]) >= self.percent * np.maximum(self.n[other], self.n[x])
        other = other[ok]
        if not len(other):
            return
        mark = np.zeros(int(self.token.max()) + 1, bool)
        mark[mine] = True
        size = self.n[other]
        at = np.repeat(self.first[other] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        both = np.add.reduceat(mark[self.token[at]].astype(np.int64), np.cumsum(size) - size)
        self.join(x, other[100 * both >= self.percent * (size + self.n[x] - both)])

    def connect(self, seeds: list[tuple[int, int]] = ()) -> np.ndarray:
        """The component of each document: the first, then all outside of the largest component, are probed."""
        for a, b in seeds:
            self.join(a, np.array([b]))
        self.probe(0)
        roots = self.roots()
        main = int(np.bincount(roots).argmax())
        for x in np.flatnonzero(roots != main).tolist():
            if self.root(x) != self.root(main):
                self.probe(x)
        return self.roots()


def _packed_set(s: np.ndarray) -> bytes:
    return np.ascontiguousarray(mix(s, 3).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SET]).tobytes()


def _unpacked_set(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _SET, 8), np.uint8)
    out[:, :_SET] = np.frombuffer(raw, np.uint8).reshape(-1, _SET)
    return out.view("<u8").ravel()


def _meet(rows: DataFrame, asked: DataFrame, order, size: int, percent: int, bins: np.ndarray) -> DataFrame:
    """kind 0: doc and the least document that it is connected with at a meeting. kind 1: centre and doc of a split
    meeting. asked: grp, centre, block, doc and seed, a component that is known already or null."""

    def send(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        ids = told.column("doc").to_numpy()
        wanted, back = np.unique(ids, return_inverse=True)
        mine = table.filter(pa.array(ex.member(wanted, ex.ids_of(table.column("doc_id")))[0])) if table.num_rows else table
        sets: dict[int, bytes] = {}
        if mine.num_rows:
            have = ex.ids_of(mine.column("doc_id"))
            for a, found in shingle_sets(mine.column("text"), size):
                for k, s in enumerate(found):
                    sets.setdefault(int(have[a + k]), _packed_set(order.value.sort(s)))
        centre, block = told.column("centre").to_numpy(), told.column("block").to_numpy()
        place = (mix(centre.astype(np.uint64) ^ mix(block.astype(np.uint64), 4), 6) % np.uint64(len(bins))).astype(np.int64)
        release()
        return pa.table(
            {"bin": pa.array(bins[place]), "centre": told.column("centre"), "block": told.column("block"), "doc": told.column("doc"), "seed": told.column("seed"), "tokens": pa.array([sets[wanted[b]] for b in back.tolist()], pa.binary())}
        )

    def verify(table: pa.Table) -> pa.Table:
        centre, block, doc = (table.column(c).to_numpy() for c in ("centre", "block", "doc"))
        seed = table.column("seed").fill_null(-1).to_numpy()
        raw = table.column("tokens")
        order_ = np.lexsort((_priority(doc), block, centre))
        new = np.ones(len(order_), bool)
        new[1:] = (centre[order_][1:] != centre[order_][:-1]) | (block[order_][1:] != block[order_][:-1])
        ends = np.r_[np.flatnonzero(new), len(order_)]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            at = order_[a:b]
            mine = doc[at]
            if b - a > 1:
                known: dict[int, int] = {}
                seeds = [(known[s], k) for k, s in enumerate(seed[at].tolist()) if s >= 0 and known.setdefault(s, k) != k]
                root = Meeting(mine, [_unpacked_set(raw[int(k)].as_py()) for k in at], percent).connect(seeds)
                least = np.full(len(mine), np.iinfo(np.int64).max)
                np.minimum.at(least, root, mine)
                low = least[root]
                out.append((np.zeros(len(mine), np.int32)[low != mine], mine[low != mine], low[low != mine]))
            if block[at[0]] > 0 and seed[at].max() < 0:
                out.append((np.ones(len(mine), np.int32), np.full(len(mine), centre[at[0]]), mine))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        release()
        return pa.table({"kind": pa.array(cols[0]), "u": pa.array(cols[1]), "v": pa.array(cols[2])})

    kind = "bin int, centre long, block long, doc long, seed long, tokens binary"
    sent = rows.groupBy("grp").cogroup(asked.groupBy("grp")).applyInArrow(send, kind)
    return sent.groupBy("bin").applyInArrow(verify, "kind int, u long, v long")


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, quarters: int = 2, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: links need 100 * |both| >= percent * |either|."""
    checkpoints(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    survey = _survey(rows, size).checkpoint()
    told = survey.where("kind = 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("n", "a", "b")).alias("x"), F.max(F.struct("n", "a", "b")).alias("y"))
    several = told.where("x <> y").select("doc_id").checkpoint()
    if several.isEmpty():
        return _components(rows, survey, None, size, percent, quarters, block)
    name = F.xxhash64("text")
    least = rows.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(name).alias("least"))
    node = F.when(name != F.col("least"), F.lit(TWINS) + F.pmod(F.xxhash64("doc_id", name), F.lit(1 << 61))).otherwise(F.col("doc_id"))
    nodes = rows.join(least, "doc_id", "left").select(node.alias("node"), "doc_id", "text")
    twins = nodes.where("node <> doc_id").select("node", F.col("doc_id").alias("owner")).distinct().checkpoint()
    rows = nodes.select(F.col("node").alias("doc_id"), "text")
    out = _components(rows, _survey(rows, size).checkpoint(), twins.select(F.col("node").alias("u"), F.col("owner").alias("v")), size, percent, quarters, block)
    return out.join(twins.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(F.coalesce("owner", "doc_id").alias("doc_id"), "n_shingles", "component_id")


def _components(rows: DataFrame, survey: DataFrame, more_links: DataFrame | None, size: int, percent: int, quarters: int, block: int) -> DataFrame:
    docs, spark = rows, rows.sparkSession
    base = survey.where("kind = 0").select("doc_id", "n", "a", "b")
    frequent = survey.where("kind = 1").groupBy("a").agg(F.sum("n").alias("times")).orderBy(F.desc("times"), "a").limit(ORDERED).toPandas()
    order = spark.sparkContext.broadcast(_Order(frequent["a"].to_numpy(np.int64).astype(np.uint64), frequent["times"].to_numpy(np.int64)))

    way = ex.Exchange(docs, 2, 1)
    buckets, bins = way.buckets, ex.even_labels(docs, 4 * ex.multiple(docs))
    grp = ex.label(way.groups, "doc_id")
    fit = base.where("n > 0 AND doc_id IS NOT NULL")
    classes = fit.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"))
    copies = fit.join(classes, ["a", "b", "n"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    told = classes.select(F.col("rep").alias("doc_id")).distinct().withColumn("grp", grp)
    dealt = rows.where("doc_id IS NOT NULL").withColumn("grp", grp)

    def post(key: tuple, table: pa.Table, reps: pa.Table) -> pa.Table:
        keep = np.sort(reps.column("doc_id").to_numpy())
        doc = ex.ids_of(table.column("doc_id")) if table.num_rows else np.empty(0, np.int64)
        mine = table.filter(pa.array(ex.member(keep, doc)[0])) if table.num_rows else table
        token, owner, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if mine.num_rows:
            doc = ex.ids_of(mine.column("doc_id"))
            for a, sets in shingle_sets(mine.column("text"), size):
                for k, s in enumerate(sets):
                    if len(s):
                        prefix = order.value.sort(s)[: len(s) - _needed(len(s), percent) + int(_matches(len(s), percent, quarters))]
                        token.append(prefix)
                        owner.append(np.full(len(prefix), doc[a + k]))
                        sizes.append(np.full(len(prefix), len(s)))
        spread, owner, sizes = mix(np.concatenate(token), 9), np.concatenate(owner), np.concatenate(sizes)
        at = np.lexsort((owner, spread))
        spread, owner, sizes = spread[at], owner[at], sizes[at]
        new = np.ones(len(at), bool)  # rows that repeat a doc_id
        new[1:] = (spread[1:] != spread[:-1]) | (owner[1:] != owner[:-1])
        spread, owner, sizes = spread[new], owner[new], sizes[new]
        return ex.released(way.sent(ex.row_table(ex.send(key[0].as_py(), 0, spread, buckets, lambda a, b: ex.planes(owner[a:b]) + ex.planes(sizes[a:b])))))

    posted = dealt.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(post, way.row)
    asked = way.at_buckets(posted, lambda t: _posted(t, percent, block), "grp int, n int, packed binary")
    asked = asked.groupBy("grp").applyInArrow(lambda t: _invited(way.read(t, t), percent, quarters), "grp int, centre long, doc long, block long, seed long")
    met = _meet(dealt, asked, order, size, percent, bins).checkpoint()
    links = met.where("kind = 0").select("u", "v").union(copies)
    links = links if more_links is None else links.union(more_links)
    parts = connected_components(links)

    split = met.where("kind = 1").select(F.col("u").alias("centre"), F.col("v").alias("doc")).distinct()
    split = split.join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc")).checkpoint()
    sizes = split.groupBy("centre", "component").count()
    main = sizes.groupBy("centre").agg(F.max(F.struct("count", F.col("component"))).alias("m"), F.sum("count").alias("total"), F.count("*").alias("kinds")).where("kinds > 1")
    main = main.select("centre", F.col("m.component").alias("main"), F.col("total") - F.col("m.count"), F.ceil((F.col("total") - F.col("m.count")) / block).cast("int").alias("loose_parts"), F.ceil(F.col("total") / block).cast("int").alias("parts")).checkpoint()
    if not main.isEmpty():
        left = split.join(main, "centre")
        place = F.pmod(F.xxhash64("doc"), F.col("parts"))
        loose = F.pmod(F.xxhash64("doc", F.lit(3)), F.col("loose_parts"))
        every = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("loose_parts") - 1))).withColumn("i", place)
        few = left.where("component <> main").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("j", loose)
        pick = ["centre", "doc", "component", (F.col("i").cast("long") * (1 << 31) + F.col("j") + 1).alias("block")]
        again = every.select(*pick).union(few.select(*pick)).distinct().withColumnRenamed("component", "seed").checkpoint().withColumn("grp", ex.label(way.groups, "doc"))
        few_docs = again.select(F.col("doc").alias("doc_id")).distinct()
        if few_docs.count() <= BROADCAST_IDS:  # then only their texts are dealt again
            dealt = dealt.join(F.broadcast(few_docs), "doc_id", "left_semi")
        more = _meet(dealt, again, order, size, percent, bins).where("kind = 0").select("u", "v")
        stars = parts.select(F.col("node").alias("u"), F.col("component").alias("v"))
        parts = connected_components(stars.union(more))
    return base.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those that link, directly or not, to one of a smaller id."""
    gone = jaccard_components(docs, size, percent, id_col=id_col, text_col=text_col).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("_gone"), "left_anti")
