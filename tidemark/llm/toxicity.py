"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; unlabelled text, any learning row whatever its label, is the rest. The class
prior is the share of toxic labels among learning rows. Features are words and word beginnings of 4 to 7 bytes, present
or not, as 64-bit fingerprints. All learning rows are counted, and every feature of at least `support` positives, or of five
times as many learning rows, is kept whose share among positives lies `deviations` standard deviations or more above or below
its share among all: those say something for or against, and no number of them is set. A linear classifier in numpy
minimises prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) with the logistic loss: where the second
term falls below zero, the step goes the other way.

Bounds (parameters) are of the rows that it is fitted on, drawn by hash from all learning rows: about `most_positives` and
`most_unlabelled`, and fewer where their kept features would be more than `most_entries`. Counting and scoring are
distributed; the driver gets the kept features with their counts and the sample's kept features.

Null and empty texts score as a text without features. Labels without a document, null ids and null labels are ignored;
a label that repeats counts once. Without positives no feature is kept and all scores are the prior. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import ALNUM_WORD, LOWER, Words, by_bytes, byte_sums, flat, release, stretch

PART_BYTES = 1 << 16
BEGINNINGS = (4, 5, 6, 7)
TABLE_FEATURES = 1 << 21  # that a task counts before it hands its counts on
BROADCAST_IDS = 1 << 20


def _parts(column: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Row ranges with (document, feature) arrays, repeats included."""
    data, off = flat(column)
    for a, b in by_bytes(np.diff(off), PART_BYTES):
        part = LOWER[data[off[a] : off[b]]]
        words = Words(part, off[a : b + 1] - off[a], ALNUM_WORD)
        doc, sums, size = words.doc(), byte_sums(part), words.end - words.start
        found = [(doc, words.name)]
        for n in BEGINNINGS:
            long = size > n
            found.append((doc[long], stretch(sums, words.start[long], words.start[long] + n)))
        yield a, b, found


def _distinct(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    doc, feature = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[new], feature[new]


def _known(found: list[tuple[np.ndarray, np.ndarray]], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, number of a known feature)."""
    docs, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(features):
        for doc, feature in found:
            k = np.minimum(np.searchsorted(features, feature), len(features) - 1)
            hit = features[k] == feature
            docs.append(doc[hit])
            at.append(k[hit])
    key = np.unique(np.concatenate(docs) * max(len(features), 1) + np.concatenate(at))
    return key // max(len(features), 1), key % max(len(features), 1)


def _counted(rows: DataFrame) -> DataFrame:
    """feature, p, u: in how many positives and in how many rows each feature is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            feature, p, u = (np.concatenate(c) for c in zip(*kept, strict=True))
            names, back = np.unique(feature, return_inverse=True)
            return names, np.bincount(back, p, len(names)).astype(np.int64), np.bincount(back, u, len(names)).astype(np.int64)

        def out() -> pa.RecordBatch:
            names, p, u = merged()
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(p), pa.array(u)], ["feature", "p", "u"])

        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, _, found in _parts(batch.column(0)):
                doc, feature = _distinct(found)
                names, back = np.unique(feature, return_inverse=True)
                kept.append((names, np.bincount(back, toxic[a + doc], len(names)).astype(np.int64), np.bincount(back, minlength=len(names))))
                size += len(names)
                if size > TABLE_FEATURES:
                    kept = [merged()]
                    size = 2 * len(kept[0][0])  # next time after as many more
                    if size > 2 * TABLE_FEATURES:
                        yield out()
                        kept, size = [], 0
            release()
        if kept:
            yield out()

    return rows.select("t", "toxic").mapInArrow(count, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _telling(counts: DataFrame, n_p: int, n_u: int, support: int, deviations: float) -> tuple[np.ndarray, int, int]:
    """The kept features, sorted, and how many entries of them the positives and all rows have."""
    a, b = F.col("p") / F.lit(float(n_p)), F.greatest(F.col("u").cast("double"), F.lit(0.5)) / F.lit(float(n_u))
    z = (a - b) / F.sqrt(F.greatest(b * (F.lit(1.0) - b), F.lit(1e-12)) / F.lit(float(n_p)))
    kept = counts.where(((F.col("p") >= support) | (F.col("u") >= 5 * support)) & (F.abs(z) >= deviations)).toPandas()
    return np.sort(kept["feature"].to_numpy(np.int64).astype(np.uint64)), int(kept["p"].sum()), int(kept["u"].sum())


def _matrix(rows: DataFrame, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, feature number) of the rows of a bounded sample, and the number of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(features)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in _parts(batch.column(0)):
                doc, at = _known(found, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([np.bincount(doc, minlength=b - a).astype("<i4").tobytes()]), pa.array([at.astype("<i4").tobytes()])], ["sizes", "at"])
            release()

    got = rows.select("t").mapInArrow(pick, "sizes binary, at binary").collect()
    size, at = (np.frombuffer(b"".join(r[c] for r in got), "<i4").astype(np.int64) for c in ("sizes", "at"))
    return np.repeat(np.arange(len(size)), size), at, len(size)


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit_nnpu(positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], features: int, prior: float, steps: int = 600, rate: float = 0.1, decay: float = 2e-4) -> np.ndarray:
    """Weights, the intercept last, of least non-negative risk (Adam, full batches)."""
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def scores(x: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
        return np.bincount(x[0], w[x[1]], x[2]) + w[-1] if len(x[0]) else np.full(x[2], w[-1])

    def slope(x: tuple[np.ndarray, np.ndarray, int], c: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(x[1], c[x[0]], features) if len(x[0]) else np.zeros(features), c.sum()) / x[2]

    for step in range(1, steps + 1):
        gp, gu = scores(positive), scores(unlabelled)
        rest = _softplus(gu).mean() - prior * _softplus(gp).mean()
        d_rest = slope(unlabelled, _sigmoid(gu)) - prior * slope(positive, _sigmoid(gp))
        g = prior * slope(positive, -_sigmoid(-gp)) + d_rest if rest >= 0 else -d_rest
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


class Model:
    def __init__(self, features: np.ndarray, weights: np.ndarray) -> None:
        self.features, self.weights = features, weights

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.weights[-1])
        for a, b, found in _parts(column):
            doc, at = _known(found, self.features)
            out[a:b] += np.bincount(doc, self.weights[at], b - a)
        return _sigmoid(out)


def learn(
    docs: DataFrame, labels: DataFrame, learning: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_positives: int = 20_000, most_unlabelled: int = 40_000, most_entries: int = 4_000_000, support: int = 4, deviations: float = 3.0,
) -> Model:
    """A model from the rows for which `learning`, an expression of the id column, holds."""
    told = labels.where(learning & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).alias("toxic"))
    known, toxic = told.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    prior = min(max((toxic or 0) / max(known, 1), 1e-4), 1 - 1e-4)
    empty = Model(np.empty(0, np.uint64), np.array([np.log(prior / (1 - prior))]))
    if not toxic:
        return empty
    positive = told.where("toxic").select(F.col(id_col).alias("i"), "toxic")
    rows = docs.where(learning).select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"))
    rows = rows.join(F.broadcast(positive) if toxic <= BROADCAST_IDS else positive, "i", "left").withColumn("toxic", F.coalesce("toxic", F.lit(False)))
    n_u, n_p = (int(x or 0) for x in rows.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first())
    if not n_p:
        return empty
    features, in_p, in_u = _telling(_counted(rows), n_p, n_u, support, deviations)

    def sample(df: DataFrame, n: int, most: int, entries: int, salt: int) -> DataFrame:
        share = min(1.0, most / n, most_entries / max(entries, 1))
        return df if share == 1.0 else df.where(F.pmod(F.xxhash64("i", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30)))

    positives, unlabelled = sample(rows.where("toxic"), n_p, most_positives, in_p, 3), sample(rows, n_u, most_unlabelled, in_u, 5)
    p, u = _matrix(positives, features), _matrix(unlabelled, features)
    if not p[2] or not u[2]:
        return empty
    return Model(features, fit_nnpu(p, u, len(features), prior))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch.column(1))
            release()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that score under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            yield batch.filter(pa.array(shared.value.scores(batch.column(place)) < threshold))

    return docs.mapInArrow(run, docs.schema)
