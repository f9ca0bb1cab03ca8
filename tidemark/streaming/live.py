"""Structured Streaming forms of the stateful operators.

State is by identity, so it spreads as the batch forms do. Late rows aren't dropped by the batch operators; a watermark here
only lets go of state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _windowed(events: DataFrame, window, time: str, keys: Sequence[str], late: str, aggs) -> DataFrame:
    out = events.withWatermark(time, late).groupBy(window.alias("_w"), *keys).agg(*aggs)
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, *(c for c in out.columns if c != "_w" and c not in keys))


def tumbling(events: DataFrame, time: str, width: str, keys: Sequence[str], late: str, *aggs) -> DataFrame:
    """Aggregates by window and keys; a window is given out once the watermark has passed it."""
    return _windowed(events, F.window(time, width), time, keys, late, aggs)


def sliding(events: DataFrame, time: str, width: str, step: str, keys: Sequence[str], late: str, *aggs) -> DataFrame:
    """The same over windows that overlap."""
    return _windowed(events, F.window(time, width, step), time, keys, late, aggs)


def sessions(events: DataFrame, time: str, gap: str, keys: Sequence[str], late: str) -> DataFrame:
    """Runs of events at most `gap` apart: keys, start, end, n. There is no cap on a run's length here."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def counter_diff_stream(samples: DataFrame, identity: Sequence[str], value: str, ts: str, gaps: Sequence[tuple[int, int]] = (), gate: str | None = None) -> DataFrame:
    """Differences across micro-batches, as `series.counter_diff` gives them: the last sample of each series is its state, so the
    first of a batch pairs with the last of the one before. Samples must come in order between batches; inside a batch they
    are sorted, and shifted and judged as arrays. Columns: identity, ts, delta, dt, reason (first_point, not_collected, gap,
    anomaly, reset)."""
    fields = {f.name: f.dataType.simpleString() for f in samples.schema}
    out = ", ".join(f"{c} {fields[c]}" for c in identity) + f", ts bigint, delta {fields[value]}, dt bigint, reason string"
    whole = fields[value] in ("tinyint", "smallint", "int", "bigint")

    def diff(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        last_ts, last_value, last_gate = state.get if state.exists else (None, None, None)
        kind = "Int64" if whole else "Float64"
        v, t = rows[value].astype(kind).reset_index(drop=True), rows[ts].astype("Int64").reset_index(drop=True)
        before, old = t.shift(1), v.shift(1)
        on = rows[gate].fillna(False).astype(bool).reset_index(drop=True) if gate else pd.Series(True, index=t.index)
        was = on.shift(1, fill_value=False)
        if last_ts is not None:
            before.iloc[0], was.iloc[0] = last_ts, bool(last_gate)
            old.iloc[0] = pd.NA if last_value is None else last_value
        crossed = pd.Series(False, index=t.index)
        for a, b in gaps:
            crossed |= ((a < t) & (before < b)).fillna(False).astype(bool)
        first = before.isna().to_numpy()
        odd = (v.isna() | old.isna() | (t <= before).fillna(False)).to_numpy(bool)
        fell = (v < old).fillna(False).to_numpy(bool)
        tests = [first, ~(on & was).to_numpy(bool), crossed.to_numpy(bool), odd, fell]
        reason = np.select(tests, ["first_point", "not_collected", "gap", "anomaly", "reset"], "")
        good = pd.Series(reason == "", index=t.index)
        found = pd.DataFrame({"ts": t, "delta": (v - old).where(good), "dt": (t - before).where(good), "reason": pd.Series(reason, index=t.index).where(~good, None)})
        for k, c in enumerate(identity):
            found.insert(k, c, key[k])
        end = v.iloc[-1]
        state.update((int(t.iloc[-1]), None if pd.isna(end) else int(end) if whole else float(end), bool(on.iloc[-1])))
        yield found

    return samples.groupBy(*identity).applyInPandasWithState(diff, out, f"last_ts bigint, last_value {fields[value]}, last_gate boolean", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, read back from a folder. complete: the last batch's whole result."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    else:
        query.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def rolled_segments(batches: DataFrame, keys: Sequence[str], ts: str, size: str, most_bytes: int, most_age: int) -> DataFrame:
    """Adds segment: parts in order of time go to a segment until it holds most_bytes or most_age has passed since the start of
    its age step; a part that overruns closes its segment."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(ts)
    marks = batches.withColumns({"_age": F.floor(F.col(ts) / most_age), "_bytes": F.floor(F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / most_bytes)})
    new = F.when((F.col("_age") != F.lag("_age").over(w)) | (F.col("_bytes") != F.lag("_bytes").over(w)), 1).otherwise(0)
    return marks.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_age", "_bytes", "_new")


def due_sources(periods: DataFrame, ticks: DataFrame, source: str = "source", period: str = "period_s", tick: str = "tick_s") -> DataFrame:
    """Which sources are due at each tick: those whose period divides it, so each runs at its own interval. The schedule is a
    fixed, small table."""
    return ticks.join(F.broadcast(periods), F.pmod(F.col(tick), F.col(period)) == 0).select(tick, source)


def live_counts(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts so far by keys (complete or update mode)."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def idempotent_sink(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that leaves an empty batch out. `write` must replace what the same batch id wrote, so that
    a batch that is done again does no harm."""

    def sink(df: DataFrame, batch: int) -> None:
        if not df.isEmpty():
            write(df, batch)

    return sink


def segment_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch as a segment of its own, over what an earlier try left."""
    return idempotent_sink(lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/segment_id={batch}"))


def freshness(df: DataFrame, keys: Sequence[str], time: str, now: str, stale_after: str) -> DataFrame:
    """The latest time of each key, and whether it is stale at a time."""
    out = df.groupBy(*keys).agg(F.max(time).alias("data_through"))
    return out.withColumn("stale", F.col("data_through") < F.expr(f"timestamp_ntz'{now}' - interval {stale_after}"))
