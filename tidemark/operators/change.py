"""Changes of mixtures and of work per operation, and of sets between snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total_variation(counts: DataFrame, keys: Sequence[str], category: str, reference: str, current: str, min_reference: int = 20, min_current: int = 20, threshold: float = 0.20) -> DataFrame:
    """Half the sum of the differences of shares, over one row a category with both counts: keys, totals,
    total_variation, max_abs_share_delta, outcome. At the threshold is a shift, no distance never is."""
    w = Window.partitionBy(*keys, F.lit(0))
    rows = counts.where((F.col(reference) > 0) | (F.col(current) > 0)).groupBy(*keys, category).agg(F.sum(reference).alias("_r"), F.sum(current).alias("_c"))
    rows = rows.withColumns({"_rt": F.sum("_r").over(w), "_ct": F.sum("_c").over(w)})
    d = F.abs(F.try_divide(F.col("_c"), F.col("_ct")) - F.try_divide(F.col("_r"), F.col("_rt")))
    out = rows.withColumn("_d", F.round(d, 15)).groupBy(*keys).agg(F.max("_rt").alias("reference_total"), F.max("_ct").alias("current_total"), F.least(F.sum("_d") / 2, F.lit(1.0)).alias("tv"), F.max("_d").alias("max_abs_share_delta"))
    outcome = F.when(F.col("reference_total") < min_reference, "reference_too_small").when(F.col("current_total") < min_current, "current_too_small").when((F.col("tv") > 0) & (F.col("tv") >= threshold), "shift").otherwise("stable")
    out = out.withColumn("outcome", outcome)
    good = F.col("outcome").isin("shift", "stable")
    return out.select(*keys, "reference_total", "current_total", F.when(good, F.col("tv")).alias("total_variation"), F.when(good, F.col("max_abs_share_delta")).alias("max_abs_share_delta"), "outcome")


def per_unit_change(df: DataFrame, ref_ops: Column, ref_work: Column, cur_ops: Column, cur_work: Column, min_reference: int = 20, min_current: int = 20, absolute: float = 1.0, relative: float = 0.50) -> DataFrame:
    """Adds reference_per_unit, current_per_unit, delta_per_unit, relative_delta and outcome. An increase is strict by
    exact products, and meets both gates; from no work at all any work meets the relative one."""
    big = lambda c: c.cast("decimal(19,0)")
    rpu, cpu = F.try_divide(ref_work.cast("double"), ref_ops.cast("double")), F.try_divide(cur_work.cast("double"), cur_ops.cast("double"))
    df = df.withColumns({"reference_per_unit": rpu, "current_per_unit": cpu, "delta_per_unit": cpu - rpu, "_strict": big(cur_work) * big(ref_ops) > big(ref_work) * big(cur_ops), "_r": ref_ops, "_c": cur_ops, "_rw": ref_work, "_cw": cur_work})
    df = df.withColumn("relative_delta", F.when(F.col("_rw") != 0, F.try_divide("delta_per_unit", "reference_per_unit")))
    met = F.col("_strict") & (F.col("delta_per_unit") >= absolute) & F.coalesce(F.col("relative_delta") >= relative, F.col("_cw") != 0)
    outcome = F.when(F.col("_r") < min_reference, "reference_too_small").when(F.col("_c") < min_current, "current_too_small").when(met, "increase").otherwise("stable")
    return df.withColumn("outcome", outcome).drop("_strict", "_r", "_c", "_rw", "_cw")


def severity(delta: Column, absolute: float, relative_delta: Column, relative: float) -> Column:
    """How far over its gates an increase is: the smaller of the two multiples."""
    return F.least(delta / absolute, F.coalesce(relative_delta / relative, F.lit(float("inf"))))


def set_change(df: DataFrame, keys: Sequence[str], step: str, member: str, ts: str | None = None, most_gap: int | None = None) -> DataFrame:
    """Members that are new or gone between snapshots (dense numbers) of a key: step, added, removed, both sorted. With ts,
    snapshots further apart than most_gap aren't compared."""
    sets = df.groupBy(*keys, step).agg(F.array_sort(F.collect_set(member)).alias("now"), *([F.min(ts).alias("_ts")] if ts else []))
    w = Window.partitionBy(*keys).orderBy(step)
    out = sets.withColumns({"before": F.lag("now").over(w), "_step": F.lag(step).over(w)} | ({"_gap": F.col("_ts") - F.lag("_ts").over(w)} if ts else {}))
    out = out.where(F.col("_step") == F.col(step) - 1)
    if ts and most_gap is not None:
        out = out.where(F.col("_gap") <= most_gap)
    out = out.select(*keys, step, F.array_except("now", "before").alias("added"), F.array_except("before", "now").alias("removed"))
    return out.where((F.size("added") > 0) | (F.size("removed") > 0))


def concentration(df: DataFrame, keys: Sequence[str], step: str, kind: str, active: str, least_steps: int = 3, least_active: int = 3) -> DataFrame:
    """Kinds that hold at least half of all active rows over snapshots with enough of them: kind, n, total."""
    by_step = df.where(F.col(active)).groupBy(*keys, step, kind).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, step)
    kept = by_step.withColumn("_t", F.sum("n").over(w)).where(F.col("_t") >= least_active)
    totals = kept.groupBy(*keys).agg(F.sum("n").alias("total"), F.count_distinct(step).alias("steps"))
    sums = kept.where(F.col(kind).isNotNull()).groupBy(*keys, kind).agg(F.sum("n").alias("n"))
    return sums.join(totals, list(keys)).where((F.col("steps") >= least_steps) & (F.col("n") * 2 >= F.col("total"))) if keys else sums.crossJoin(F.broadcast(totals)).where((F.col("steps") >= least_steps) & (F.col("n") * 2 >= F.col("total")))
