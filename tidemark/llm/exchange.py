"""Packed exchange between document groups and key buckets.

Documents are dealt to groups by a hash. In a pass, each group turns its documents into distinct 64-bit keys, sorted,
and sends each bucket one packed row; a bucket sees at most one entry per key and group, so a key that a third of all
documents hold costs as many entries as there are groups. A bucket answers with one bit per entry. The group works its
keys out again in the next pass, from the same documents, and reads the bits in the same order: answers need neither
keys nor document ids. All passes read one shuffle of the documents (the plan reuses the exchange), nothing is collected,
and a lost executor's parts are worked out again from the input.

Groups and buckets are as many as shuffle partitions, and a whole multiple of that where the input has more than
`GROUP_BYTES` a partition, so that neither grows with the table. Every group would send every bucket a row, which is the square
of their number: beyond `ROUTED_FROM` of them rows take two hops, in packs. A group sends each super-bucket (about the root
of all buckets) one pack, the packs of a batch of groups (about the root of all groups) meet and are dealt out by bucket, and
answers go the same way back. Rows are then the number to the power of 1.5, and a pack holds the root of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm.text import by_bytes, flat, mix, release

ROW = "grp int, bucket int, step int, n int, keys binary, extra binary"
ANSWER = "grp int, bucket int, step int, n int, bits binary"
STEPS = 8  # a row's step is 8 x the bucket's rank + its step in the operator
NO_ID = np.iinfo(np.int64).max
GROUP_BYTES = 64 << 20
ROUTED_FROM = 2048
LISTED = 1 << 14
ROUTED = "super int, batch int, packed binary"


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash (Murmur3, seed 42) of integers, by which it deals them to partitions."""
    u = np.uint32
    with np.errstate(over="ignore"):
        k = np.asarray(x).astype(u) * u(0xCC9E2D51)
        k = (k << u(15) | k >> u(17)) * u(0x1B873593)
        h = u(42) ^ k
        h = (h << u(13) | h >> u(19)) * u(5) + u(0xE6546B64)
        h ^= u(4)
        h = (h ^ h >> u(16)) * u(0x85EBCA6B)
        h = (h ^ h >> u(13)) * u(0xC2B2AE35)
        return (h ^ h >> u(16)).astype(np.int32)


def even_labels(df: DataFrame, each: int) -> np.ndarray:
    """Integers of which each shuffle partition gets the same number when Spark deals by them; beyond `LISTED` of them plain ones,
    whose numbers are about the same."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n * each > LISTED:
        return np.arange(n * each, dtype=np.int32)
    place = spark_hash(np.arange(n * (each * 8 + 40))).astype(np.int64) % n
    order = np.argsort(place, kind="stable")
    first = np.searchsorted(place[order], np.arange(n))
    return np.sort(np.concatenate([order[first + k] for k in range(each)])).astype(np.int32)


def label(labels: np.ndarray, *by: str) -> Column:
    """The label that a hash of columns deals to."""
    place = F.pmod(F.xxhash64(*by), F.lit(len(labels)))
    return place.cast("int") if len(labels) > LISTED else F.element_at(F.lit(labels.tolist()), (place + 1).cast("int"))


def multiple(df: DataFrame) -> int:
    """How many groups each partition must have for none to hold more than `GROUP_BYTES` of the input, by the plan's own size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, int(-(-size // (n * GROUP_BYTES)))) if size < 2**60 else 1  # unknown sizes are set to the greatest


def dealt(docs: DataFrame, id_col: str, text_col: str, labels: np.ndarray, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, grp: repeated ids spread by their texts. carry: columns that go along in a struct, rest."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be an integer, not {kind.simpleString()}")
    rest = [F.struct(*(docs[c] for c in carry)).alias("rest")] if carry else []
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *rest)
    return rows.withColumn("grp", label(labels, "doc_id", "text"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy().astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Bytes by significance, so that small numbers compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def send(grp: int, step: int, keys: np.ndarray, buckets: np.ndarray, extra: Callable[[int, int], bytes | None]) -> list[tuple]:
    """One row per bucket of sorted distinct keys; extra(a, b) is sent with keys[a:b]. buckets: their labels."""
    of = bucket_of(keys, len(buckets))
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
    ends = np.r_[at[1:], len(of)]
    return [(grp, int(buckets[of[a]]), STEPS * int(of[a]) + step, int(b - a), keys[a:b].astype("<u8").tobytes(), extra(int(a), int(b))) for a, b in zip(at, ends, strict=False)]


_ROW_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
ROW_NAMES = ["grp", "bucket", "step", "n", "keys", "extra"]
ANSWER_NAMES = ["grp", "bucket", "step", "n", "bits"]


def as_table(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def row_table(rows: list[tuple]) -> pa.Table:
    return as_table(rows, _ROW_TYPES, ROW_NAMES)


def answer_table(rows: list[tuple]) -> pa.Table:
    return as_table(rows, [*_ROW_TYPES[:4], pa.binary()], ANSWER_NAMES)


def gathered(table: pa.Table) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray, list[bytes | None]]:
    """(grp, bucket, step, n) of each row, all keys, each key's row, the rows' extras."""
    heads = list(zip(*(table.column(c).to_pylist() for c in ROW_NAMES[:4]), strict=True))
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u8")
    return heads, keys, np.repeat(np.arange(len(heads)), [h[3] for h in heads]), table.column("extra").to_pylist()


def answers(heads: list[tuple], *flags: np.ndarray) -> list[tuple]:
    """A packed row of bits, one plane for each array of flags, for each row of entries."""
    at = np.cumsum([0, *(h[3] for h in heads)])
    return [(*h, b"".join(np.packbits(f[a:b]).tobytes() for f in flags)) for h, a, b in zip(heads, at[:-1], at[1:], strict=True)]


def bits(table: pa.Table, step: int, plane: int = 0) -> np.ndarray:
    """The answers of a step, one plane of them, in the order of the group's sorted keys."""
    rows = [r for r in zip(*(table.column(c).to_pylist() for c in ANSWER_NAMES), strict=True) if r[2] % STEPS == step]
    rows.sort(key=lambda r: r[2])
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r[4], np.uint8, (r[3] + 7) // 8, plane * ((r[3] + 7) // 8)), count=r[3]).astype(bool) for r in rows)])


def by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys, starts of equal runs in it, and the run of each sorted key."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def member(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is among the sorted keys, and where."""
    at = np.searchsorted(sorted_keys, x)
    if not len(sorted_keys):
        return np.zeros(len(x), bool), at
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x, at


def released(table: pa.Table) -> pa.Table:
    release()
    return table


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in packs])


def _split(table: pa.Table, by: np.ndarray) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value, in order."""
    order = np.argsort(by, kind="stable")
    values = by[order]
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(values)], strict=False):
        yield int(values[a]), table.take(pa.array(order[a:b]))


class Exchange:
    """The groups and buckets of an operator, and the way between them."""

    def __init__(self, docs: DataFrame, groups: int = 1, buckets: int = 1) -> None:
        k = multiple(docs)
        self.groups, self.buckets = even_labels(docs, groups * k), even_labels(docs, buckets * k)
        n = max(len(self.groups), len(self.buckets))
        self.hops = int(np.ceil(np.sqrt(n))) if n > ROUTED_FROM else 0
        self.per = -(-len(self.buckets) // max(self.hops, 1))
        self.row = ROUTED if self.hops else ROW

    def _batch(self, grp: np.ndarray) -> np.ndarray:
        return (mix(grp.astype(np.uint64), 31) % np.uint64(self.hops)).astype(np.int64)

    def _routed(self, rows: list[tuple[int, int, pa.Table]]) -> pa.Table:
        return as_table([(a, b, _pack(t)) for a, b, t in rows], [pa.int32(), pa.int32(), pa.binary()], ["super", "batch", "packed"])

    def sent(self, table: pa.Table) -> pa.Table:
        """A group's rows on their way: as they are, or a pack for each super-bucket."""
        if not self.hops:
            return table
        to = table.column("step").to_numpy() // STEPS // self.per
        return self._routed([(k, int(self._batch(part.column("grp").to_numpy()[:1])[0]), part) for k, part in _split(table, to)])

    def _hop(self, rows: DataFrame, to: str) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            inside = _unpack(table.column("packed").to_pylist())
            out = [(k, _pack(part)) for k, part in _split(inside, inside.column(to).to_numpy())]
            return released(as_table(out, [pa.int32(), pa.binary()], [to, "packed"]))

        return rows.groupBy("super", "batch").applyInArrow(run, f"{to} int, packed binary")

    def at_buckets(self, rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """What buckets make of their rows, a table with a column grp; `read` unpacks it at the groups."""
        if not self.hops:
            return rows.groupBy("bucket").applyInArrow(lambda t: released(work(t)), schema)

        def run(table: pa.Table) -> pa.Table:
            inside = _unpack(table.column("packed").to_pylist())
            here = int(inside.column("step")[0].as_py()) // STEPS // self.per
            out = work(inside)
            return released(self._routed([(here, k, part) for k, part in _split(out, self._batch(out.column("grp").to_numpy()))]))

        return self._hop(self._hop(rows, "bucket").groupBy("bucket").applyInArrow(run, ROUTED), "grp")

    def read(self, table: pa.Table, empty: pa.Table) -> pa.Table:
        """What has come to a group; `empty` where nothing has."""
        if not self.hops:
            return table
        return _unpack(table.column("packed").to_pylist()) if table.num_rows else empty

    def send_pass(self, df: DataFrame, work: Callable[[int, pa.Table], list[tuple]]) -> DataFrame:
        """One pass over the groups without earlier answers."""

        def run(key: tuple, table: pa.Table) -> pa.Table:
            return released(self.sent(row_table(work(key[0].as_py(), table))))

        return df.groupBy("grp").applyInArrow(run, self.row)

    def answer_pass(self, rows: DataFrame, work: Callable[[pa.Table], list[tuple]]) -> DataFrame:
        """The buckets' answers."""
        return self.at_buckets(rows, lambda t: answer_table(work(t)), ANSWER)

    def joined_pass(self, df: DataFrame, told: DataFrame, work: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str | None = None) -> DataFrame:
        """A pass over the groups together with the answers so far. No schema: rows for buckets."""

        def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
            out = work(key[0].as_py(), table, self.read(told, answer_table([])))
            return released(out if schema else self.sent(out))

        return df.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(run, schema or self.row)


def parts(table: pa.Table, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """ids, bytes and offsets of byte-bounded parts of a group, and their row ranges."""
    data, off = flat(table.column("text"))
    ids = ids_of(table.column("doc_id"))
    for a, b in by_bytes(np.diff(off), limit):
        yield ids[a:b], data[off[a] : off[b]], off[a : b + 1] - off[a], a, b
