"""Reductions into buckets, shares, rankings and coverage. Sums and counts combine map-side; medians are exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio


def grid(frm: int, to: int, most: int = 256, unit: int = 60_000_000) -> tuple[int, int]:
    """Aligned start and width, a multiple of unit, of at most `most` buckets that cover [frm, to)."""
    k = 1
    while -(-(to - frm // (unit * k) * unit * k) // (unit * k)) > most:
        k += 1
    return frm // (unit * k) * unit * k, unit * k


def bucket(ts: Column, start: int, width: int) -> Column:
    return F.floor((ts - start) / width).cast("bigint")


def rebucket(anchor: Column, frm: int, to: int, n: int) -> Column:
    """Index of one of n equal parts of [frm, to), held inside."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((anchor - frm) * n / (to - frm)))).cast("bigint")


def bucket_values(df: DataFrame, entity: Sequence[str], at: Column, value: str, how: str) -> DataFrame:
    """Sum or max of a value by entity and bucket; a bucket without a value isn't there, which is not zero."""
    agg = {"sum": F.sum, "max": F.max}[how]
    return df.where(F.col(value).isNotNull()).groupBy(*entity, at.alias("bucket")).agg(agg(value).alias("value"))


def counter_reduction(pairs: DataFrame, keys: Sequence[str | Column], ratio_scale: float = 1e6) -> DataFrame:
    """Rate of valid pairs (delta, dt not null) by keys: sum of deltas over sum of durations."""
    ok = pairs.where(F.col("delta").isNotNull())
    out = ok.groupBy(*keys).agg(F.sum("delta").alias("delta"), F.sum("dt").alias("dt"), F.count("*").alias("pairs"))
    return out.withColumn("rate", F.col("delta").cast("double") * ratio_scale / F.col("dt"))


def ratio_reduction(pairs: DataFrame, keys: Sequence[str | Column], num: str, den: str) -> DataFrame:
    """Sum over sum where both deltas are valid in all pairs of a key; null if the denominator is 0 or supports differ."""
    both = F.col(num).isNotNull() & F.col(den).isNotNull()
    any_ = F.col(num).isNotNull() | F.col(den).isNotNull()
    out = pairs.groupBy(*keys).agg(F.sum(F.when(both, F.col(num))).alias("num"), F.sum(F.when(both, F.col(den))).alias("den"), F.count_if(any_ & ~both).alias("unmatched"))
    return out.withColumn("ratio", F.when(F.col("unmatched") == 0, ratio(F.col("num"), F.col("den"))))


def gauge_reduction(df: DataFrame, keys: Sequence[str | Column], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count(value).alias("samples"))


def time_weighted(df: DataFrame, identity: Sequence[str], value: str, frm: int, to: int, width: int, max_hold: int, ts: str = "ts") -> DataFrame:
    """Zero-order-hold mean by bucket: a value holds until the next sample, max_hold or the range's end, cut at bucket
    edges: identity, bucket, weighted (value x microseconds), held_us, mean."""
    w = Window.partitionBy(*identity).orderBy(ts)
    df = df.withColumn("_until", F.least(F.coalesce(F.lead(ts).over(w), F.lit(to)), F.col(ts) + max_hold, F.lit(to)))
    df = df.withColumn("_from", F.greatest(F.col(ts), F.lit(frm))).where(F.col("_until") > F.col("_from"))
    df = df.withColumn("bucket", F.explode(F.sequence(bucket(F.col("_from"), frm, width), bucket(F.col("_until") - 1, frm, width))))
    hold = F.least(F.col("_until"), F.lit(frm) + (F.col("bucket") + 1) * width) - F.greatest(F.col("_from"), F.lit(frm) + F.col("bucket") * width)
    out = df.withColumn("_hold", hold).groupBy(*identity, "bucket").agg(F.sum(F.col(value) * F.col("_hold")).alias("weighted"), F.sum("_hold").alias("held_us"))
    return out.withColumn("mean", F.col("weighted") / F.col("held_us"))


def percent_of_total(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Adds pct = 100 x value / sum; one missing value leaves all of its group without. A hot group's sum is taken map-side; the
    totals are joined back in the way that their size calls for, and without groups they are one row."""
    totals = df.groupBy(*groups).agg(F.sum(value).alias("_sum"), F.count_if(F.col(value).isNull()).alias("_missing"))
    out = df.join(totals.select(*(F.col(g).alias(f"_g_{g}") for g in groups), "_sum", "_missing"), _same(groups)).drop(*(f"_g_{g}" for g in groups)) if groups else df.crossJoin(F.broadcast(totals))
    return out.withColumn("pct", F.when(F.col("_missing") == 0, ratio(F.col(value) * 100, F.col("_sum")))).drop("_sum", "_missing")


def exact_counts(df: DataFrame, keys: Sequence[str | Column], distinct: dict[str, str] | None = None, filtered: dict[str, Column] | None = None) -> DataFrame:
    """Exact distinct counts of columns and counts of rows that meet conditions, by name."""
    aggs = [F.count_distinct(c).alias(n) for n, c in (distinct or {}).items()] + [F.count_if(c).alias(n) for n, c in (filtered or {}).items()]
    return df.groupBy(*keys).agg(*aggs)


def _same(groups: Sequence[str]) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return out


def top(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group (planned as a limit below the window)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(out) <= k).withColumn(out, F.col(out).cast("bigint"))


def top_axes(df: DataFrame, axes: Sequence[Column], key: str, k: int) -> DataFrame:
    """Rows among the first k by any axis, ties by key: each axis is a top-k of its own (k rows a task), and their keys
    are united."""
    keys = None
    for axis in axes:
        one = df.orderBy(axis, key).limit(k).select(key)
        keys = one if keys is None else keys.union(one)
    return df.join(F.broadcast(keys.distinct()), key, "left_semi")


def top_other(df: DataFrame, key: str, count: str, k: int) -> DataFrame:
    """Counts of the k most frequent keys, of all others together, and of rows without a key: kind, key, n. The rank is by
    count, then key."""
    sums = df.where(F.col(count) > 0).groupBy(key).agg(F.sum(count).alias("n"))
    known = sums.where(F.col(key).isNotNull())
    first = known.orderBy(F.desc("n"), key).limit(k).select(F.lit("top").alias("kind"), F.col(key), "n")
    other = known.join(F.broadcast(first.select(key)), key, "left_anti").agg(F.sum("n").alias("n")).where("n > 0").select(F.lit("other").alias("kind"), F.lit(None).cast(df.schema[key].dataType).alias(key), "n")
    missing = sums.where(F.col(key).isNull()).select(F.lit("missing").alias("kind"), F.col(key), "n")
    return first.unionByName(other).unionByName(missing)


def joint_counts(df: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Sums by all keys; rows of 0 don't count."""
    return df.where(F.col(count) > 0).groupBy(*keys).agg(F.sum(count).alias("n"))


def marginals(joint: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Sums by each key alone and over all: level (a key's name, or total), value, n."""
    out = joint.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).select(F.lit("total").alias("level"), F.lit(None).cast("string").alias("value"), "n")
    for k in keys:
        out = out.unionByName(joint.groupBy(k).agg(F.sum(count).alias("n")).select(F.lit(k).alias("level"), F.col(k).cast("string").alias("value"), "n"))
    return out


def arg_extreme(df: DataFrame, keys: Sequence[str], score: Column, ts: str, keep: Sequence[str], least: bool = False) -> DataFrame:
    """The row of greatest (or least) score of each key, the first in time on ties."""
    s = -score if least else score
    best = F.max_by(F.struct(ts, *keep, score.alias("score")), F.struct(s.alias("s"), (-F.col(ts)).alias("t")))
    return df.where(score.isNotNull()).groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def trend(df: DataFrame, keys: Sequence[str], value: str, ts: str = "ts") -> DataFrame:
    """First and last value in time, and the slope a second between them (null for one instant)."""
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.min_by(value, ts).alias("first_value"), F.max_by(value, ts).alias("last_value"))
    return out.withColumn("slope", F.when(F.col("last_ts") > F.col("first_ts"), (F.col("last_value") - F.col("first_value")) * 1e6 / (F.col("last_ts") - F.col("first_ts"))))


def observed_period(df: DataFrame, identity: Sequence[str], ts: str = "ts") -> DataFrame:
    """Three notions of the cadence: evidence_period (median of at least 3 gaps, the mean of two middles rounded up),
    quality_period (upper median), constant_period (all gaps equal)."""
    gaps = df.select(*identity, (F.col(ts) - F.lag(ts).over(Window.partitionBy(*identity).orderBy(ts))).alias("gap")).where("gap IS NOT NULL")
    out = gaps.groupBy(*identity).agg(F.sort_array(F.collect_list("gap")).alias("g"), F.count("*").alias("gaps"))
    lower = F.element_at("g", F.floor((F.col("gaps") - 1) / 2).cast("int") + 1)
    upper = F.element_at("g", F.floor(F.col("gaps") / 2).cast("int") + 1)
    return out.select(
        *identity,
        "gaps",
        F.when(F.col("gaps") >= 3, F.ceil((lower + upper) / 2).cast("bigint")).alias("evidence_period"),
        upper.alias("quality_period"),
        F.when(F.element_at("g", 1) == F.element_at("g", -1), F.element_at("g", 1)).alias("constant_period"),
    )


def paired_sums(df: DataFrame, keys: Sequence[str], a: str, b: str, least: int = 3) -> DataFrame:
    """Sums of two deltas over intervals where both are valid; null unless there are `least` and they are 70 % of the
    endpoints seen."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    out = df.groupBy(*keys).agg(F.count("*").alias("endpoints"), F.count_if(both).alias("aligned"), F.sum(F.when(both, F.col(a))).alias("sum_a"), F.sum(F.when(both, F.col(b))).alias("sum_b"))
    ok = (F.col("aligned") >= least) & (F.col("aligned") * 10 >= F.col("endpoints") * 7)
    return out.withColumns({"sum_a": F.when(ok, F.col("sum_a")), "sum_b": F.when(ok, F.col("sum_b"))})


def health(df: DataFrame, keys: Sequence[str], required: Sequence[str], penalties: dict[str, str], floor: str) -> DataFrame:
    """score = product of 1 - the worst penalty of each domain; null if a required factor is missing; state critical where
    a floor is set, unknown without a score. penalties: domain to penalty column (0 to 1)."""
    known = F.lit(True)
    for r in required:
        known = known & F.col(r).isNotNull()
    product = F.lit(1.0)
    for d in penalties:
        product = product * (1 - F.coalesce(F.col(f"_{d}"), F.lit(0.0)))
    out = df.groupBy(*keys).agg(*(F.max(p).alias(f"_{d}") for d, p in penalties.items()), F.max(F.col(floor).cast("int")).alias("_floor"), *(F.max(r).alias(r) for r in required if r not in keys))
    state = F.when(F.col("_floor") == 1, "critical").when(~known, "unknown").otherwise("scored")
    return out.select(*keys, state.alias("state"), F.when(F.col("_floor") == 1, F.lit(0.0)).when(known, product).alias("score"))


def worst_points(df: DataFrame, keys: Sequence[str], into: Column, ts: str = "ts") -> DataFrame:
    """One point of each coarser bucket: a critical one first, then the least score, then the earliest."""
    order = F.struct((F.col("state") != "critical").alias("a"), F.col("score").isNull().alias("b"), F.col("score").alias("c"), F.col(ts).alias("d"))
    return df.groupBy(*keys, into.alias("bucket")).agg(F.min_by(F.struct(ts, "state", "score"), order).alias("_p")).select(*keys, "bucket", "_p.*")


def exhaustion(df: DataFrame, keys: Sequence[str], written: str, available: str, day: str = "day") -> DataFrame:
    """Bytes a day over all days but the first, and days until what is available is used up."""
    out = df.groupBy(*keys).agg(F.count("*").alias("days"), F.sum(written).alias("_all"), F.min_by(written, day).alias("_first"), F.max_by(available, day).alias("available"))
    per_day = ratio(F.col("_all") - F.col("_first"), F.col("days") - 1)
    return out.select(*keys, "days", "available", per_day.alias("bytes_per_day"), ratio(F.col("available"), per_day).alias("days_left"))


def retention(df: DataFrame, class_rank: Column, age: str, size: str, deficit: int, key: str) -> DataFrame:
    """What to delete, by class and age, until `deficit` bytes are free: rows whose predecessors don't free enough. One row a
    file of a store's manifest goes through one task, not the files' rows."""
    w = Window.orderBy("_class", F.desc(age), key)
    out = df.withColumn("_class", class_rank).withColumn("freed_before", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.where(F.col("freed_before") < deficit).drop("_class")
