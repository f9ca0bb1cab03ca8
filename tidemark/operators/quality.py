"""What is known to be missing: gaps and failures as tables, coverage of collections, losses, part buffers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_POINT, _END, _START = 1, 0, 2


def pairs_in_gaps(df: DataFrame, gaps: DataFrame, keys: Sequence[str], ts: str = "ts", gap_from: str = "gap_from", gap_to: str = "gap_to") -> DataFrame:
    """Adds prev_ts and in_gap: some gap of the key meets the pair (gap_from < ts and prev_ts < gap_to). Ends of gaps stand
    among the rows: those that began before the row less those that ended by the row before is how many meet the pair, so
    there is no range join, and any number of gaps costs one window."""
    rows = df.withColumns({"_t": F.col(ts), "_o": F.lit(_POINT), "_s": F.lit(0), "_e": F.lit(0)})
    begins = gaps.select(*keys, F.col(gap_from).alias("_t"), F.lit(_START).alias("_o"), F.lit(1).alias("_s"), F.lit(0).alias("_e"))
    ends = gaps.select(*keys, F.col(gap_to).alias("_t"), F.lit(_END).alias("_o"), F.lit(0).alias("_s"), F.lit(1).alias("_e"))
    w = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(begins, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    both = both.withColumns({"_begun": F.sum("_s").over(w), "_ended": F.sum("_e").over(w)}).where(F.col("_o") == _POINT)
    o = Window.partitionBy(*keys).orderBy("_t")
    return both.withColumns({"prev_ts": F.lag(ts).over(o), "in_gap": F.coalesce(F.col("_begun") > F.lag("_ended").over(o), F.lit(False))}).drop("_t", "_o", "_s", "_e", "_begun", "_ended")


def failures_between(df: DataFrame, coverage: DataFrame, keys: Sequence[str], failed: Column, ts: str = "ts") -> DataFrame:
    """Adds prev_ts and failures: how many failed or lossy coverage rows of the key lie in (prev_ts, ts], as a difference of
    running counts."""
    rows = df.withColumns({"_o": F.lit(1), "_f": F.lit(0)})
    bad = coverage.select(*keys, F.col(ts), F.lit(0).alias("_o"), F.when(failed, 1).otherwise(0).alias("_f"))
    w = Window.partitionBy(*keys).orderBy(ts, "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(bad, allowMissingColumns=True).withColumn("_n", F.sum("_f").over(w)).where("_o = 1")
    o = Window.partitionBy(*keys).orderBy(ts)
    return both.withColumns({"prev_ts": F.lag(ts).over(o), "failures": F.when(F.lag(ts).over(o).isNotNull(), F.col("_n") - F.lag("_n").over(o))}).drop("_o", "_f", "_n")


def coverage_at(df: DataFrame, coverage: DataFrame, keys: Sequence[str], state: str = "state", ts: str = "ts") -> DataFrame:
    """Each row with the state of the coverage row of exactly its key and time: unknown without one, conflict where several
    disagree."""
    told = merge_markers(coverage, [*keys, ts], [state])
    told = told.select(*keys, ts, F.when(F.col("conflict"), "conflict").otherwise(F.col(state)).alias("coverage"))
    return df.join(told, [*keys, ts], "left").withColumn("coverage", F.coalesce("coverage", F.lit("unknown")))


def merge_markers(markers: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row a key; conflict: rows of it disagree, and then what they say isn't known."""
    packed = F.struct(*payload)
    out = markers.groupBy(*key).agg(F.min(packed).alias("_p"), (F.min(packed) != F.max(packed)).alias("conflict"))
    return out.select(*key, *(F.when(~F.col("conflict"), F.col(f"_p.{c}")).alias(c) for c in payload), "conflict")


def collection_coverage(candidates: DataFrame, keys: Sequence[str], kept: Column, metric: str) -> DataFrame:
    """What a bounded collection has taken of its source: keys, collected, source_total, cutoff (the least metric of what was
    taken, where something was left out) and state (complete, cut or empty)."""
    out = candidates.groupBy(*keys).agg(F.count_if(kept).alias("collected"), F.count("*").alias("source_total"), F.min(F.when(kept, F.col(metric))).alias("_least"))
    cut = F.col("collected") < F.col("source_total")
    state = F.when(F.col("collected") == 0, "empty").when(cut, "cut").otherwise("complete")
    return out.withColumns({"cutoff": F.when(cut, F.col("_least")), "state": state}).drop("_least")


def losses(known: DataFrame, keys: Sequence[str | Column], reason: str, lost: str) -> DataFrame:
    """Known losses by keys: loss_reasons, sorted, and lost_lower_bound: at least so many; a loss of unknown size adds
    nothing to it and clears bounded."""
    return known.groupBy(*keys).agg(
        F.array_sort(F.collect_set(reason)).alias("loss_reasons"), F.coalesce(F.sum(lost), F.lit(0)).alias("lost_lower_bound"), (F.count_if(F.col(lost).isNull()) == 0).alias("bounded")
    )


def with_losses(counts: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts with the losses of their keys; without any the count is exact."""
    out = counts.join(known, list(keys), "left")
    return out.withColumns({"lost_lower_bound": F.coalesce("lost_lower_bound", F.lit(0)), "exact": F.col("loss_reasons").isNull()})


def part_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, most_rows: int, most_bytes: int) -> DataFrame:
    """Adds part: rows of a section in order are dealt to parts of at most most_rows, and a new one begins at each most_bytes of
    running size."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = df.withColumns({"_rows": F.floor((F.row_number().over(w) - 1) / most_rows), "_bytes": F.floor(before / most_bytes)})
    changed = F.when((F.col("_rows") != F.lag("_rows").over(w)) | (F.col("_bytes") != F.lag("_bytes").over(w)), 1).otherwise(0)
    return marks.withColumn("_new", changed).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_rows", "_bytes", "_new")
