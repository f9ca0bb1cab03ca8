"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosine, distributed components.

Equal vectors of a label are one class with a count, so a hot vector is one row. Each class is hashed to a few sign bits
in several tables; bits and tables follow from the number of classes so that a pair at the threshold meets in some table
with probability `recall`. Classes of one label and code meet in a bucket; a bucket over `block` classes is split in
blocks that meet pairwise in tasks of their own, so nothing is capped. Buckets first see sketches of `SKETCH` more signs:
a class stays in a bucket if the signs of some other there differ in no more places than all but `MISSED` of the pairs at
the threshold do. Vectors are sent to the buckets in which their class has stayed, and only there; all pairs there are
verified by cosine in double precision, and a pair counts in the first table in which it meets. A task returns, for
each class, the number of vectors linked there and the smallest class reachable there, never pairs.

A vector that is null, zero, or holds null, NaN or infinite components, or has no label, links with nothing; so do vectors
of different lengths. Rows that repeat a vec_id are vectors of their own. A null vec_id is the last choice for a
component's name. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import checkpoints, connected_components
from tidemark.llm.exchange import even_labels, label, multiple

FOUND = "cid long, links long, rep long, root long"
SKETCH = 256
MISSED = 1e-9
KEYS = ("lab", "dim", "t", "code", "i", "j")  # of a bucket


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits and tables for n classes."""
    bits = min(max(round(math.log2(max(n, 1) / 64)), 6), 62)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def most_apart(threshold: float) -> int:
    """In how many of SKETCH signs a pair at the threshold differs, but for MISSED of such pairs."""
    p = math.acos(min(threshold, 1.0)) / math.pi
    left = 1.0
    for k in range(SKETCH):
        left -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if left <= MISSED:
            return k
    return SKETCH


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9999, block: int = 512, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    bins = even_labels(vectors, 8 * multiple(vectors))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("x"), vectors[label_col].alias("label"))
    good = F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    fit = rows.where("good")
    classes = fit.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumn("cid", F.xxhash64("label", "x"))
    n = classes.count()
    k, tables = plan(n, threshold, recall)
    weights = (1 << np.arange(k)).astype(np.int64)
    apart = most_apart(threshold)

    def code(batches):
        planes = {}
        for batch in batches:
            x = batch.column(1)
            size = np.diff(np.array(x.offsets))
            codes, sketch = np.zeros((len(x), tables), np.int64), np.zeros((len(x), SKETCH // 8), np.uint8)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * k + SKETCH))
                signs = _matrix(x.take(pa.array(at))) @ planes[d] > 0
                codes[at] = signs[:, : tables * k].reshape(len(at), tables, k) @ weights
                sketch[at] = np.packbits(signs[:, tables * k :], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, tables, dtype=np.int32), codes.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array([r.tobytes() for r in sketch], pa.binary())], [*batch.schema.names, "codes", "sketch"])

    kind = classes.schema["x"].dataType.simpleString()
    coded = classes.select("cid", "x", "rep", "m", F.xxhash64("label").alias("lab"), F.size("x").alias("dim")).mapInArrow(code, f"cid long, x {kind}, rep long, m long, lab long, dim int, codes array<long>, sketch binary")
    spread = coded.select("cid", "lab", "dim", "sketch", F.posexplode("codes").alias("t", "code"))
    full = spread.groupBy("lab", "dim", "t", "code").count().where(F.col("count") > block).select("lab", "dim", "t", "code", F.ceil(F.col("count") / block).cast("int").alias("b"))
    spread = spread.join(full, ["lab", "dim", "t", "code"], "left").withColumn("b", F.coalesce("b", F.lit(1)))
    spread = spread.withColumn("s", F.pmod(F.xxhash64("cid", "t"), F.col("b")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    spread = spread.withColumn("i", F.least("s", "o")).withColumn("j", F.greatest("s", "o"))
    spread = spread.withColumn("bin", label(bins, "lab", "dim", "t", "code", "i", "j"))

    def buckets(cols: dict[str, np.ndarray], *then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by bucket and then by the rest, the keys in it, the buckets' starts and the end."""
        order = np.lexsort((*then, *(cols[c] for c in KEYS[::-1])))
        keys = np.stack([cols[c][order].astype(np.int64) for c in KEYS])
        return order, keys, np.r_[np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]), len(order)]

    def near(table: pa.Table) -> pa.Table:
        """The rows whose class may have a partner in the bucket."""
        cols = {c: table.column(c).to_numpy() for c in ("s", *KEYS)}
        order, keys, ends = buckets(cols)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
        stay = np.zeros(len(order), bool)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            at = order[a:b]
            one = two = np.arange(b - a)
            if keys[4, a] != keys[5, a]:
                one, two = np.flatnonzero(cols["s"][at] == keys[4, a]), np.flatnonzero(cols["s"][at] == keys[5, a])
            differ = sum(np.bitwise_count(sketch[at[one], w, None] ^ sketch[at[two], w]).astype(np.int16) for w in range(SKETCH // 64))
            close = differ <= apart
            if one is two:
                np.fill_diagonal(close, False)
            stay[at[one]] |= close.any(1)
            stay[at[two]] |= close.any(0)
        return table.filter(pa.array(stay)).select(["cid", "t", "s", "i", "j", "bin"])

    def verify(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_numpy() for c in ("cid", "m", "s", *KEYS)}
        rep = table.column("rep").fill_null(np.iinfo(np.int64).max).to_numpy()
        order, keys, ends = buckets(cols, cols["cid"], rep)
        x, codes = table.column("x").combine_chunks(), table.column("codes").combine_chunks()
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a < 2:
                continue
            at = order[a:b]
            u = _unit(_matrix(x.take(pa.array(at))))
            mine, side, t = _matrix(codes.take(pa.array(at))).astype(np.int64), cols["s"][at], int(keys[2, a])
            if keys[4, a] == keys[5, a]:
                p, q = np.nonzero(np.triu(u @ u.T >= threshold, 1))
            else:
                one, two = np.flatnonzero(side == keys[4, a]), np.flatnonzero(side == keys[5, a])
                p, q = np.nonzero(u[one] @ u[two].T >= threshold)
                p, q = one[p], two[q]
            fresh = np.ones(len(p), bool)
            for e in range(t):
                fresh &= mine[p, e] != mine[q, e]
            links, low = np.zeros(b - a, np.int64), np.arange(b - a)
            np.add.at(links, p[fresh], cols["m"][at][q[fresh]])
            np.add.at(links, q[fresh], cols["m"][at][p[fresh]])
            while True:
                was = low.copy()
                np.minimum.at(low, p, low[q])
                np.minimum.at(low, q, low[p])
                low = low[low]
                if (was == low).all():
                    break
            tell = np.flatnonzero((links > 0) | (low != np.arange(b - a)))
            out.append((cols["cid"][at][tell], links[tell], rep[at][tell], rep[at][low[tell]]))
        joined = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pa.table([pa.array(c.astype(np.int64)) for c in joined], names=["cid", "links", "rep", "root"])

    stayed = spread.select("bin", "cid", "sketch", "s", *KEYS).groupBy("bin").applyInArrow(near, "cid long, t int, s int, i int, j int, bin int")
    whole = coded.select("cid", "x", "rep", "m", "lab", "dim", "codes").join(stayed, "cid").withColumn("code", F.element_at("codes", F.col("t") + 1))
    found = whole.groupBy("bin").applyInArrow(verify, FOUND)
    checkpoints(spark)
    found = found.checkpoint()
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    told = classes.join(links, "cid", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select("label", "x", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    done = fit.join(told, ["label", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))

