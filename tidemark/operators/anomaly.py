"""Robust scores of a sliding window against the rest of its segment, episodes of high scores, and their ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGMA = 1.4826


def positions(frm: int, to: int, window: int, step: int) -> Column:
    """Ends of the windows: from + window on, by step, and the end of the range always."""
    ends = [*range(frm + window, to, step), to]
    return F.array(*(F.lit(e) for e in ends)) if len(ends) < 64 else F.concat(F.sequence(F.lit(frm + window), F.lit(to - 1), F.lit(step)), F.array(F.lit(to)))


def scores(points: DataFrame, series: Sequence[str], value: str, frm: int, to: int, window: int, step: int, ts: str = "ts", segment: str = "segment", min_ref: int = 20, min_cur: int = 3, eps_abs: float = 1e-9, eps_rel: float = 0.05) -> DataFrame:
    """series, position, n_cur, n_ref, med_cur, med_ref, mad_ref, sigma, m, reason. The window is [position - window,
    position]; its reference are all other points, later ones too, of the segment that the window lies in. A window over a
    break, that is over two segments, is a discontinuity. Non-finite values must have been made breaks.

    A segment's values are one array in order of value, shuffled once and filtered by each position that it can reach, which
    keeps the order: only the deviations are sorted again. Positions get a segment's medians, not its points."""
    held = points.where(F.col(ts).between(frm, to) & F.col(value).isNotNull())
    at = positions(frm, to, window, step)
    lists = held.groupBy(*series, segment).agg(F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col(ts).alias("t")))).alias("p"), F.min(ts).alias("a"), F.max(ts).alias("b"))
    out = lists.withColumn("position", F.explode(F.filter(at, lambda x: (x >= F.col("a")) & (x <= F.col("b") + window))))
    inside = lambda x: (x["t"] >= F.col("position") - window) & (x["t"] <= F.col("position"))
    only = lambda test: F.transform(F.filter("p", test), lambda x: x["v"])
    out = out.withColumn("cur", only(inside)).where(F.size("cur") > 0)
    out = out.withColumn("ref", only(lambda x: ~inside(x))).withColumns({"n_cur": F.size("cur"), "n_ref": F.size("ref")})
    big = (F.col("n_ref") >= min_ref) & (F.col("n_cur") >= min_cur)
    out = out.withColumns({"med_cur": F.when(big, median_of("cur")), "med_ref": F.when(big, median_of("ref"))})
    out = out.withColumn("dev", F.when(big, F.array_sort(F.transform("ref", lambda v: F.abs(v - F.col("med_ref"))))))
    out = out.withColumn("mad_ref", F.when(big, median_of("dev")))
    cells = out.groupBy(*series, "position").agg(F.count("*").alias("met"), F.first(F.struct("n_cur", "n_ref", "med_cur", "med_ref", "mad_ref")).alias("x"))
    every = held.select(*series).distinct().withColumn("position", F.explode(at))
    out = every.join(cells, [*series, "position"], "left")
    one = F.col("met") == 1
    n = lambda c: F.coalesce(F.when(one, F.col(f"x.{c}")), F.lit(0))
    out = out.withColumns({"n_cur": n("n_cur"), "n_ref": n("n_ref")})
    reason = F.when(F.col("met") > 1, "discontinuity").when(F.col("met").isNull(), "all_no_data").when(F.col("n_ref") < min_ref, "ref_too_small").when(F.col("n_cur") < min_cur, "cur_too_small")
    out = out.withColumns({"reason": reason, **{c: F.when(one, F.col(f"x.{c}")) for c in ("med_cur", "med_ref", "mad_ref")}})
    out = out.withColumn("sigma", F.greatest(SIGMA * F.col("mad_ref"), F.greatest(F.lit(eps_abs), eps_rel * F.abs("med_ref"))))
    return out.select(*series, "position", "n_cur", "n_ref", "med_cur", "med_ref", "mad_ref", "sigma", ((F.col("med_cur") - F.col("med_ref")) / F.col("sigma")).alias("m"), "reason")


def median_of(column: str) -> Column:
    """The median of a sorted array."""
    n = F.size(column)
    low, high = F.get(F.col(column), F.floor((n - 1) / 2).cast("int")), F.get(F.col(column), F.floor(n / 2).cast("int"))
    return (low + high) / 2


def episodes(scored: DataFrame, series: Sequence[str], threshold: float = 3.5) -> DataFrame:
    """Runs of neighbouring positions with |m| over the threshold (not at it): start, end, peak position and m, the
    earliest on ties."""
    w = Window.partitionBy(*series).orderBy("position")
    out = scored.withColumn("_i", F.row_number().over(w)).where(F.abs("m") > threshold)
    out = out.withColumn("_run", F.col("_i") - F.row_number().over(w))
    peak = F.max_by(F.struct("position", "m"), F.struct(F.abs("m"), -F.col("position")))
    return out.groupBy(*series, "_run").agg(F.min("position").alias("start"), F.max("position").alias("end"), F.count("*").alias("positions"), peak.alias("_p")).select(*series, "start", "end", "positions", F.col("_p.position").alias("peak"), F.col("_p.m").alias("peak_m"))


def rank_episodes(found: DataFrame, series: Sequence[str], limit: int) -> DataFrame:
    return found.orderBy(F.desc(F.abs("peak_m")), *series, "start", "end").limit(limit)


def scan_accounting(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many positions were evaluated, and how many not, for each reason."""
    return scored.groupBy(*by, F.coalesce("reason", F.lit("evaluated")).alias("outcome")).agg(F.count("*").alias("positions"))
