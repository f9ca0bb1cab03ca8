"""Operators on series: rows of one identity in time order. One window per identity serves them all, so a chain of them
shuffles once by the identity.

Time is in microseconds (bigint) unless said otherwise. A pair is a row and the row before it of the same identity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Spans = Sequence[tuple[int, int]]


def ordered(identity: Sequence[str], ts: str = "ts", *more: str) -> Window:
    return Window.partitionBy(*identity).orderBy(ts, *more)


def in_spans(frm: Column, to: Column, spans: Spans) -> Column:
    """Whether (frm, to) meets any of a few given gaps: gap.from < to and frm < gap.to."""
    out = F.lit(False)
    for a, b in spans:
        out = out | ((F.lit(a) < to) & (frm < F.lit(b)))
    return out


def counter_diff(df: DataFrame, identity: Sequence[str], value: str, ts: str = "ts", gaps: Spans = (), gate: str | None = None) -> DataFrame:
    """Adds prev_ts, delta, rate (a second), dt and reason: of first_point, not_collected, gap, anomaly, reset the first
    that holds, null where there is a delta. A fall is a reset, also to zero; equal values are a delta of zero. gate: a
    column that must be true at the row before and at the row."""
    w = ordered(identity, ts)
    prev, prev_ts = F.lag(value).over(w), F.lag(ts).over(w)
    df = df.withColumns({"prev_ts": prev_ts, "_prev": prev} | ({"_gate": F.coalesce(F.lag(gate).over(w), F.lit(False)) & F.coalesce(F.col(gate), F.lit(False))} if gate else {}))
    dt = F.col(ts) - F.col("prev_ts")
    reason = F.when(F.col("prev_ts").isNull(), "first_point")
    if gate:
        reason = reason.when(~F.col("_gate"), "not_collected")
    reason = (
        reason.when(in_spans(F.col("prev_ts"), F.col(ts), gaps), "gap").when(F.col(value).isNull() | F.col("_prev").isNull() | (dt <= 0), "anomaly").when(F.col(value) < F.col("_prev"), "reset")
    )
    df = df.withColumn("reason", reason)
    good = F.col("reason").isNull()
    delta = F.when(good, F.col(value) - F.col("_prev"))
    return df.withColumns({"delta": delta, "dt": F.when(good, dt), "rate": F.when(good, delta.cast("double") / (dt / F.lit(1e6)))}).drop("_prev", "_gate")


def pair_quality(df: DataFrame, identity: Sequence[str], value: str, epoch: str, ts: str = "ts", gaps: Spans = ()) -> DataFrame:
    """Adds quality for reductions: missing, non_monotonic_time, reset (another epoch, or a fall), gap, valid. Here a
    reset comes before a gap."""
    w = ordered(identity, ts)
    df = df.withColumns({"prev_ts": F.lag(ts).over(w), "_prev": F.lag(value).over(w), "_epoch": F.lag(epoch).over(w)})
    quality = (
        F.when(F.col("prev_ts").isNull(), "missing")
        .when(F.col(ts) <= F.col("prev_ts"), "non_monotonic_time")
        .when((F.col("_epoch") != F.col(epoch)) | (F.col(value) < F.col("_prev")), "reset")
        .when(in_spans(F.col("prev_ts"), F.col(ts), gaps), "gap")
        .otherwise("valid")
    )
    df = df.withColumn("quality", quality)
    ok = F.col("quality") == "valid"
    return df.withColumns({"delta": F.when(ok, F.col(value) - F.col("_prev")), "dt": F.when(ok, F.col(ts) - F.col("prev_ts"))}).drop("_prev", "_epoch")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", out: str | None = None) -> DataFrame:
    """The right side's latest value that isn't null at or before each left row's time: a union and one window, so both
    sides shuffle once by the keys. Right rows of a time come before left rows of it."""
    out = out or value
    a = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*keys, F.col(ts), F.col(value).alias("_value"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_value", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_value")


def gate_state(left: DataFrame, readings: DataFrame, keys: Sequence[str], gate: str, ts: str = "ts") -> DataFrame:
    """Adds collected: the gate was on at the row before (its latest reading at or before it) and every reading after that,
    up to the row, was on. Off and unknown readings are counted along the series, so the test of an interval is a
    difference of two counts."""
    a = left.withColumns({"_side": F.lit(1), "_gate": F.lit(None).cast("boolean"), "_bad": F.lit(0)})
    b = readings.select(*keys, F.col(ts), F.col(gate).alias("_gate"), F.when(F.coalesce(F.col(gate), F.lit(False)), 0).otherwise(1).alias("_bad"), F.lit(0).alias("_side"), F.lit(True).alias("_read"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_count": F.sum("_bad").over(w), "_state": F.last(F.when(F.col("_read"), F.coalesce("_gate", F.lit(False))), ignorenulls=True).over(w)}).where("_side = 1")
    o = ordered(keys, ts)
    ok = F.coalesce(F.lag("_state").over(o), F.lit(False)) & (F.col("_count") == F.lag("_count").over(o))
    return both.withColumn("collected", F.coalesce(ok, F.lit(False))).drop("_side", "_gate", "_bad", "_read", "_count", "_state")


def reset_between(df: DataFrame, resets: DataFrame, keys: Sequence[str], ts: str = "ts", reset_at: str = "reset_at") -> DataFrame:
    """Adds reset_inside: the latest reset at or before the row lies after the row before: prev_ts < reset_at <= ts."""
    marks = resets.select(*keys, F.col(reset_at).alias(ts), F.col(reset_at).alias("_at"))
    out = asof(df, marks, keys, "_at", ts, "_at2").withColumnRenamed("_at2", "last_reset")
    w = ordered(keys, ts)
    return out.withColumn("reset_inside", F.coalesce(F.col("last_reset") > F.lag(ts).over(w), F.lit(False)))


def segments(df: DataFrame, identity: Sequence[str], is_break: Column, ts: str = "ts", out: str = "segment") -> DataFrame:
    """Numbers the stretches between breaks; a break begins a new one."""
    w = ordered(identity, ts).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(is_break, 1).otherwise(0)).over(w))


def islands(df: DataFrame, identity: Sequence[str], start: str, end: str, touch: int = 0) -> DataFrame:
    """Unions of spans that overlap or lie at most `touch` apart: identity, start, end, spans."""
    w = Window.partitionBy(*identity).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.when(seen.isNull() | (F.col(start) > seen + touch), 1).otherwise(0))
    df = df.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*identity, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("spans")).drop("_island")


def complement(covered: DataFrame, identity: Sequence[str], start: str, end: str, frm: int, to: int, least: int = 0) -> DataFrame:
    """Gaps: what of [frm, to) disjoint spans don't cover, without slivers under `least`. An identity without spans isn't
    here to be reported."""
    w = Window.partitionBy(*identity).orderBy(start)
    inner = covered.where((F.col(end) > frm) & (F.col(start) < to))
    before = inner.select(*identity, F.greatest(F.lag(end).over(w), F.lit(frm)).alias("gap_from"), F.least(F.col(start), F.lit(to)).alias("gap_to"))
    tail = inner.groupBy(*identity).agg(F.max(end).alias("gap_from")).withColumn("gap_to", F.lit(to))
    return before.unionByName(tail).where((F.col("gap_to") > F.col("gap_from")) & (F.col("gap_to") - F.col("gap_from") >= least))


def cadence_cover(df: DataFrame, identity: Sequence[str], period: int, frm: int, to: int, ts: str = "ts") -> DataFrame:
    """Microseconds of [frm, to) that the union of [ts, ts + period) covers, and their share."""
    spans = df.select(*identity, F.greatest(F.col(ts), F.lit(frm)).alias("s"), F.least(F.col(ts) + period, F.lit(to)).alias("e")).where("e > s")
    return islands(spans, identity, "s", "e").groupBy(*identity).agg(F.sum(F.col("e") - F.col("s")).alias("covered_us")).withColumn("share", F.col("covered_us") / F.lit(float(to - frm)))


def changes(df: DataFrame, identity: Sequence[str], value: str, ts: str = "ts") -> DataFrame:
    """Rows whose value differs from the row before (nulls are values), with previous_value."""
    w = ordered(identity, ts)
    out = df.withColumns({"previous_value": F.lag(value).over(w), "_n": F.row_number().over(w)})
    return out.where((F.col("_n") > 1) & ~F.col(value).eqNullSafe(F.col("previous_value"))).drop("_n")


def runs(df: DataFrame, identity: Sequence[str], step: str, cond: Column) -> DataFrame:
    """Runs of consecutive steps (integers) at which the condition holds: identity, first_step, last_step, length."""
    w = Window.partitionBy(*identity).orderBy(step)
    hit = df.where(cond).withColumn("_k", F.col(step) - F.row_number().over(w))
    return hit.groupBy(*identity, "_k").agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count("*").alias("length")).drop("_k")


def disappeared(df: DataFrame, identity: Sequence[str], step: str) -> DataFrame:
    """Identities that are there at a snapshot and not at the next, for dense snapshot numbers; step is the one where they
    are missing. Snapshots after the last are not judged."""
    there = df.select(*identity, step).distinct()
    due = there.withColumn(step, F.col(step) + 1).join(F.broadcast(df.agg(F.max(step).alias("_last"))), F.col(step) <= F.col("_last")).drop("_last")
    return due.join(there, [*identity, step], "left_anti")


def duplicates(df: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row a key, with its number of rows and whether they disagree; agreeing repeats are kept once."""
    packed = F.struct(*payload)
    return df.groupBy(*key).agg(F.min(packed).alias("_p"), F.count("*").alias("rows"), (F.count_distinct(packed) > 1).alias("conflict")).select(*key, "_p.*", "rows", "conflict")


def counter_events(diffs: DataFrame, identity: Sequence[str], kind: str, ts: str = "ts") -> DataFrame:
    """Events from valid deltas that aren't zero: identity, kind, ts, prev_ts, count."""
    return diffs.where(F.col("delta") > 0).select(*identity, F.lit(kind).alias("kind"), ts, "prev_ts", F.col("delta").alias("count"))


def fell_to_zero(df: DataFrame, identity: Sequence[str], value: str, ts: str = "ts") -> DataFrame:
    """Rows at which a capacity that was above zero is zero: identity, ts, previous_value. Unknown values aren't crossed: the last
    known one counts."""
    known = df.where(F.col(value).isNotNull())
    out = known.withColumn("previous_value", F.lag(value).over(ordered(identity, ts)))
    return out.where((F.col(value) == 0) & (F.col("previous_value") > 0)).select(*identity, ts, "previous_value")


def epoch_changes(df: DataFrame, identity: Sequence[str], epoch: str, ts: str = "ts") -> DataFrame:
    """Markers where the epoch of a counter's last reset differs from that of the sample before: identity, ts, prev_ts, epoch."""
    w = ordered(identity, ts)
    out = df.withColumns({"prev_ts": F.lag(ts).over(w), "_was": F.lag(epoch).over(w)})
    return out.where(F.col("prev_ts").isNotNull() & ~F.col(epoch).eqNullSafe(F.col("_was"))).select(*identity, ts, "prev_ts", epoch)
