"""Metrics of views, mixtures of plans over time, pre-aggregates of segments, and merged pages of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio


def aligned(pairs: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums of several deltas over the intervals where all are valid (they share one row, so ends and durations agree)."""
    if len(columns) > 16:
        raise ValueError("at most 16 tracks")
    ok = F.col("dt").isNotNull()
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return pairs.groupBy(*keys).agg(F.count("*").alias("endpoints"), F.count_if(ok).alias("aligned"), *(F.sum(F.when(ok, F.col(c))).alias(c) for c in columns), F.sum(F.when(ok, F.col("dt"))).alias("dt"))


def same_instant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows at which all of several gauges were read."""
    return df.dropna(subset=list(columns))


def lifecycle_counts(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Crashes, shutdowns and readiness, and how often each signal ended a process: what, signal, n."""
    kinds = events.where(F.col("kind").isin("child_process_crash", "shutdown", "ready"))
    return kinds.groupBy(*by, F.col("kind").alias("what"), "signal").agg(F.count("*").alias("n"))


def wait_age(locks: DataFrame, keys: Sequence[str | Column], ts: str, since: str) -> DataFrame:
    """The longest wait seen; a wait that begins after the snapshot isn't one."""
    return locks.groupBy(*keys).agg(F.max(F.when(F.col(since) <= F.col(ts), F.col(ts) - F.col(since))).alias("wait_us"))


def load_per_cpu(load: DataFrame, cpus: DataFrame, keys: Sequence[str], at: str, value: str, cpu: str) -> DataFrame:
    """The greatest load of each bucket over the CPUs seen in it."""
    seen = cpus.groupBy(*keys, at).agg(F.count_distinct(cpu).alias("cpus"))
    top = load.groupBy(*keys, at).agg(F.max(value).alias("load"))
    return top.join(seen, [*keys, at]).withColumn("load_per_cpu", ratio(F.col("load"), F.col("cpus")))


def prepared(xacts: DataFrame, keys: Sequence[str], ts: str, since: str, xid_age: str) -> DataFrame:
    """Prepared transactions by database: how many, the greatest age (never negative) and the greatest id age."""
    return xacts.groupBy(*keys).agg(F.count("*").alias("n"), F.greatest(F.lit(0), F.max(F.col(ts) - F.col(since))).alias("age_us"), F.max(xid_age).alias("xid_age"))


def accounting(files: DataFrame, kind: Column, size: str, capacity: int) -> DataFrame:
    """Bytes by class and their share of a capacity."""
    return files.groupBy(kind.alias("class")).agg(F.sum(size).alias("bytes"), F.count("*").alias("files")).withColumn("used", F.col("bytes") / F.lit(float(capacity)))


def context(rows: DataFrame, at: int, key: str, ts: str = "ts") -> DataFrame:
    """Rows of the latest snapshot at or before a time, without the shared one (0)."""
    from tidemark.operators.frames import latest

    return latest(rows, ts, at).where(F.col(key) != 0)


def gauge_ratio(rows: DataFrame, keys: Sequence[str | Column], num: Column, den: Column, form: str = "plain", scale: float = 100.0) -> DataFrame:
    """The greatest share by keys. form: plain (of den, 1 at least), part (num of num + den, 1 at least) or nonzero (of den, rows
    without one left out)."""
    if form not in ("plain", "part", "nonzero"):
        raise ValueError(f"no such form: {form}")
    whole = num + den if form == "part" else den
    share = scale * num.cast("double") / F.greatest(whole.cast("double"), F.lit(1.0)) if form != "nonzero" else F.when(den > 0, scale * num.cast("double") / den.cast("double"))
    return rows.withColumn("_x", share).where("_x IS NOT NULL").groupBy(*keys).agg(F.max("_x").alias("value"))


def active_fraction(rows: DataFrame, keys: Sequence[str | Column], active: Column) -> DataFrame:
    """The share of rows that are active by keys; an unknown state isn't."""
    return rows.groupBy(*keys).agg(F.avg(F.coalesce(active, F.lit(False)).cast("int")).alias("fraction"), F.count("*").alias("rows"))


def wait_time(rows: DataFrame, identity: Sequence[str], keys: Sequence[str | Column], waiting: Column, ts: str = "ts", most_gap: int | None = None) -> DataFrame:
    """Microseconds up to rows that wait, each since the row before of its identity; pairs further apart than most_gap don't
    count."""
    w = Window.partitionBy(*identity).orderBy(ts)
    dt = rows.withColumn("_dt", F.col(ts) - F.lag(ts).over(w)).where(waiting & F.col("_dt").isNotNull())
    if most_gap is not None:
        dt = dt.where(F.col("_dt") <= most_gap)
    return dt.groupBy(*keys).agg(F.sum("_dt").alias("wait_us"))


def event_counts(events: DataFrame, kind: str, at: Column) -> DataFrame:
    """Events by kind and bucket; a bucket without any isn't there."""
    return events.groupBy(kind, at.alias("bucket")).agg(F.count("*").alias("n"))


def pressure(rows: DataFrame, at: Column, resource: str = "resource", value: str = "some_avg10", of: str = "io") -> DataFrame:
    """The greatest pressure of one resource by bucket."""
    return rows.where((F.col(resource) == of) & F.col(value).isNotNull()).groupBy(at.alias("bucket")).agg(F.max(value).alias("value"))


def host_cpus(topology: DataFrame, at: int, cpu: str = "cpu_id", scope: str = "scope", ts: str = "ts") -> DataFrame:
    """The number of CPUs of the host at the latest topology at or before a time: snapshot, cpus. Other scopes don't count."""
    host = topology.where((F.col(scope) == "host") & (F.col(ts) <= at))
    return host.groupBy(F.col(ts).alias("snapshot")).agg(F.count_distinct(cpu).alias("cpus")).orderBy(F.desc("snapshot")).limit(1)


def first_summary(live: DataFrame, sealed: DataFrame, view: str, at: int, keep: Sequence[str], ts: str = "ts") -> DataFrame:
    """Each view's summary in force: the newest of the live ones at or before a time, else the newest sealed one; source tells
    which."""
    sides = [(live, 1), (sealed, 0)]
    all_ = None
    for df, rank in sides:
        one = df.where(F.col(ts) <= at).select(view, ts, *keep, F.lit(rank).alias("_live"))
        all_ = one if all_ is None else all_.unionByName(one)
    best = all_.groupBy(view).agg(F.max_by(F.struct(ts, *keep, "_live"), F.struct("_live", ts)).alias("_b"))
    return best.select(view, *(F.col(f"_b.{c}").alias(c) for c in (ts, *keep)), F.when(F.col("_b._live") == 1, "live").otherwise("sealed").alias("source"))


def partial_reduction(pairs: DataFrame, keys: Sequence[str | Column], part: str, prev_ts: str = "prev_ts", ts: str = "ts") -> DataFrame:
    """What a part knows of its valid pairs: delta, dt, pairs and the support from the first pair's start to the last one's end."""
    ok = pairs.where(F.col("delta").isNotNull())
    return ok.groupBy(*keys, part).agg(F.sum("delta").alias("delta"), F.sum("dt").alias("dt"), F.count("*").alias("pairs"), F.min(prev_ts).alias("support_from"), F.max(ts).alias("support_to"))


def merged_reduction(parts: DataFrame, keys: Sequence[str], scale: float = 1e6) -> DataFrame:
    """Parts' reductions as one, whatever their order. Parts whose supports overlap have counted a pair twice: such a key has no
    rate and `overlap` is true."""
    w = Window.partitionBy(*keys).orderBy("support_from", "support_to").rowsBetween(Window.unboundedPreceding, -1)
    seen = parts.withColumn("_over", F.coalesce(F.col("support_from") < F.max("support_to").over(w), F.lit(False)))
    out = seen.groupBy(*keys).agg(F.sum("delta").alias("delta"), F.sum("dt").alias("dt"), F.sum("pairs").alias("pairs"), F.max("_over").alias("overlap"))
    return out.withColumn("rate", F.when(~F.col("overlap"), F.col("delta").cast("double") * scale / F.col("dt")))


# ---- plans ---------------------------------------------------------------------------------------------------------------


def plan_churn(plans: DataFrame, keys: Sequence[str], step: str, ts: str, plan: str, calls: str, time: str, most_gap: int) -> DataFrame:
    """New plans at the middle of three neighbouring snapshots (dense numbers, at most most_gap apart) that were not there
    before and still are after, with positive deltas of calls and time between the middle and the last; the one with most
    time of each key and step."""
    w = Window.partitionBy(*keys, plan).orderBy(step)
    rows = plans.withColumns({"_before": F.lag(step).over(w), "_after": F.lead(step).over(w), "_calls": F.lead(calls).over(w) - F.col(calls), "_time": F.lead(time).over(w) - F.col(time)})
    times = plans.groupBy(*keys, step).agg(F.min(ts).alias("_t"))
    k = Window.partitionBy(*keys).orderBy(step)
    times = times.withColumns({"_prev": F.lag(step).over(k), "_gap": F.greatest(F.col("_t") - F.lag("_t").over(k), F.lead("_t").over(k) - F.col("_t"))}).where((F.col("_prev") == F.col(step) - 1) & (F.col("_gap") <= most_gap))
    new = rows.join(times, [*keys, step]).where((F.coalesce(F.col("_before"), F.lit(-1)) != F.col(step) - 1) & (F.col("_after") == F.col(step) + 1) & (F.col("_calls") > 0) & (F.col("_time") > 0))
    return new.groupBy(*keys, step).agg(F.max_by(F.struct(plan, F.col("_calls").alias("calls_delta"), F.col("_time").alias("time_delta")), F.struct("_time", plan)).alias("_b"), F.count("*").alias("new_plans")).select(*keys, step, "_b.*", "new_plans")


def mixture_shift(counts: DataFrame, keys: Sequence[str], step: str, category: str, count: str, window: int, least: int = 20, threshold: float = 0.20) -> DataFrame:
    """Total variation between the mixture in [step, step + window) and all other steps of a key: keys, step, totals, tv,
    shift. One row a (key, step, category) goes in; windows are sums over ranges, so no step meets another."""
    w = Window.partitionBy(*keys, category).orderBy(step).rangeBetween(0, window - 1)
    steps = counts.select(*keys, step).distinct()
    kinds = counts.groupBy(*keys, category).agg(F.sum(count).alias("_all"))
    dense = steps.join(kinds, list(keys)).join(counts.groupBy(*keys, step, category).agg(F.sum(count).alias("_n")), [*keys, step, category], "left")
    dense = dense.withColumn("_c", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("_r", F.col("_all") - F.col("_c"))
    t = Window.partitionBy(*keys, step)
    dense = dense.withColumns({"_ct": F.sum("_c").over(t), "_rt": F.sum("_r").over(t)})
    d = F.round(F.abs(F.try_divide(F.col("_c"), F.col("_ct")) - F.try_divide(F.col("_r"), F.col("_rt"))), 15)
    out = dense.withColumn("_d", d).groupBy(*keys, step).agg(F.max("_ct").alias("current_total"), F.max("_rt").alias("reference_total"), (F.sum("_d") / 2).alias("tv"))
    return out.withColumn("shift", (F.col("current_total") >= least) & (F.col("reference_total") >= least) & (F.col("tv") > 0) & (F.col("tv") >= threshold))


def signal_episodes(marks: DataFrame, keys: Sequence[str], step: str, mark: str, severity: str) -> DataFrame:
    """Runs of neighbouring marked positions, with their worst: keys, start, end, positions, peak, severity."""
    w = Window.partitionBy(*keys).orderBy(step)
    runs = marks.withColumn("_i", F.row_number().over(w)).where(F.col(mark)).withColumn("_k", F.col("_i") - F.row_number().over(w))
    peak = F.max_by(step, F.struct(F.col(severity).alias("s"), (-F.col(step)).alias("t")))
    return runs.groupBy(*keys, "_k").agg(F.min(step).alias("start"), F.max(step).alias("end"), F.count("*").alias("positions"), peak.alias("peak"), F.max(severity).alias("severity")).drop("_k")


#: Counters of blocks whose work a call is watched.
BLOCK_COUNTERS = [
    "shared_blks_hit", "shared_blks_read", "shared_blks_dirtied", "shared_blks_written", "local_blks_hit",
    "local_blks_read", "local_blks_dirtied", "local_blks_written", "temp_blks_read", "temp_blks_written",
]


def work_signals(deltas: DataFrame, keys: Sequence[str], ts: str, calls: str, counters: Sequence[str], window: int, least: int = 20, absolute: float = 1.0, relative: float = 0.50) -> DataFrame:
    """For each key and counter of a plan, runs of positions at which the work a call of (position - window, position] has risen
    over that of the rest: keys, counter, start, end, positions, peak, severity (the smaller multiple of the two gates).

    Positions are the intervals' own ends. An interval without calls and work says nothing, one with work and no calls, or a
    null, is a break: sums don't reach over it and no position is judged on it. Windows are sums over ranges of one window a
    segment, so positions never meet points in a join."""
    from tidemark.operators.change import per_unit_change
    from tidemark.operators.change import severity as how_much

    long = deltas.select(*keys, ts, F.col(calls).alias("_calls"), F.explode(F.create_map(*[x for c in counters for x in (F.lit(c), F.col(c).cast("bigint"))])).alias("counter", "_work"))
    long = long.where(~F.coalesce((F.col("_calls") == 0) & (F.col("_work") == 0), F.lit(False)))
    good = F.coalesce((F.col("_calls") > 0) & F.col("_work").isNotNull(), F.lit(False))
    w = Window.partitionBy(*keys, "counter").orderBy(ts)
    long = long.withColumn("_good", good).withColumn("_segment", F.sum((~F.col("_good")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy(*keys, "counter", "_segment")
    near = part.orderBy(ts).rangeBetween(-window, 0)
    ok = lambda c: F.when(F.col("_good"), F.col(c)).otherwise(0)
    long = long.withColumns({"_cc": F.sum(ok("_calls")).over(near), "_cw": F.sum(ok("_work")).over(near), "_ac": F.sum(ok("_calls")).over(part), "_aw": F.sum(ok("_work")).over(part)})
    judged = per_unit_change(long.where("_good"), F.col("_ac") - F.col("_cc"), F.col("_aw") - F.col("_cw"), F.col("_cc"), F.col("_cw"), least, least, absolute, relative)
    judged = judged.withColumns({"_hit": F.col("outcome") == "increase", "_sev": F.coalesce(how_much(F.col("delta_per_unit"), absolute, F.col("relative_delta"), relative), F.lit(0.0))})
    return signal_episodes(judged.select(*keys, "counter", "_segment", ts, "_hit", F.col("_sev").alias("severity")), [*keys, "counter", "_segment"], ts, "_hit", "severity").drop("_segment")


def rank_signals(found: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    return found.orderBy(F.desc("severity"), *keys, "start").limit(limit)


# ---- gaps as a user sees them, pre-aggregates, pages ------------------------------------------------------------------------


def shown_gaps(segments: DataFrame, keys: Sequence[str], frm: int, to: int, period: int, start: str = "min_ts", end: str = "max_ts") -> DataFrame:
    """Half-open gaps between segments whose last instant is inside: the next must begin after end + 1; a trailing sliver
    under the period is no gap."""
    from tidemark.operators.series import complement, islands

    spans = segments.select(*keys, F.col(start).alias("s"), (F.col(end) + 1).alias("e"))
    gaps = complement(islands(spans, keys, "s", "e"), keys, "s", "e", frm, to)
    return gaps.where((F.col("gap_to") != to) | (F.col("gap_to") - F.col("gap_from") >= period))


def segment_cells(rows: DataFrame, segment: str, view: str, entity: str, bucket: Column, value: str, how: str) -> DataFrame:
    """The pre-aggregate of a segment: view, segment, entity, bucket, value. Cells of several segments combine exactly, as
    sums and maxima do."""
    agg = {"sum": F.sum, "max": F.max}[how]
    return rows.where(F.col(value).isNotNull()).groupBy(segment, F.lit(view).alias("view"), F.col(entity).cast("string").alias("entity"), bucket.alias("bucket")).agg(agg(value).alias("value"))


def merge_cells(cells: DataFrame, how: str, keys: Sequence[str] = ("view", "entity", "bucket")) -> DataFrame:
    agg = {"sum": F.sum, "max": F.max}[how]
    return cells.groupBy(*keys).agg(agg("value").alias("value"))


def refresh_cells(cells: DataFrame, folder: str, segment: str) -> None:
    """Writes the pre-aggregates of the segments that the rows hold, in place of what was there of them."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(segment).parquet(folder)


def events_page(sources: Sequence[DataFrame], limit: int, last: tuple | None = None) -> DataFrame:
    """The next page of several sources of events in the order of (sort_ts, event_id, instance): each gives its first rows
    after the last one seen, and only those are merged."""
    from tidemark.operators.frames import after

    order = ["sort_ts", "event_id", "instance"]
    out = None
    for s in sources:
        one = (s.where(after(order, last)) if last is not None else s).orderBy(*order).limit(limit)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.orderBy(*order).limit(limit)
