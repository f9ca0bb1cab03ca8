"""Joins of entities that know what they are: typed keys, relations of objects, processes of backends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_key(domain: str, name: str, value: Column, snapshot: Column) -> Column:
    """A key that joins only within its domain, name and snapshot: equal numbers of different kinds aren't equal keys. Null
    without a value."""
    return F.when(value.isNotNull(), F.struct(F.lit(domain).alias("domain"), F.lit(name).alias("name"), value.cast("string").alias("value"), snapshot.alias("snapshot")))


def joined_entities(left: DataFrame, right: DataFrame, key: str = "entity") -> DataFrame:
    """Rows of equal typed keys; null keys join nothing. The parts are the join keys, so the domain prunes by equality."""
    parts = ("domain", "name", "value", "snapshot")
    a = left.where(F.col(key).isNotNull()).select("*", *(F.col(f"{key}.{p}").alias(f"_{p}") for p in parts)).drop(key)
    b = right.where(F.col(key).isNotNull()).select("*", *(F.col(f"{key}.{p}").alias(f"_{p}") for p in parts)).drop(key)
    both = a.join(b, [f"_{p}" for p in parts])
    return both.withColumn(key, F.struct(*(F.col(f"_{p}").alias(p) for p in parts))).drop(*(f"_{p}" for p in parts))


def object_relation(left: DataFrame, right: DataFrame, key: Sequence[str], keep: Sequence[str], unique: bool) -> DataFrame:
    """left with the right rows of its key, none of whose parts is null. unique: only where exactly one right row has it, else
    as many as there are; relation tells one, none, many or no_key."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    w = Window.partitionBy(*key)
    found = right.where(whole).select(*key, *keep).withColumn("_n", F.count("*").over(w))
    if unique:
        found = found.groupBy(*key).agg(F.first("_n").alias("_n"), *(F.when(F.first("_n") == 1, F.first(c)).alias(c) for c in keep))
    out = left.withColumn("_whole", whole).join(found, list(key), "left")
    relation = F.when(~F.col("_whole"), "no_key").when(F.col("_n").isNull(), "none").when(F.col("_n") == 1, "one").otherwise("many")
    return out.withColumn("relation", relation).drop("_n", "_whole")


def process_candidates(backends: DataFrame, processes: DataFrame, ts: str = "ts", pid: str = "pid", start: str = "starttime") -> DataFrame:
    """Backends with the start time of the process that can be theirs: the pid is sampled in the same snapshot with exactly one
    start time. Else the reason: not_sampled or ambiguous."""
    seen = processes.groupBy(ts, pid).agg(F.count_distinct(start).alias("_n"), F.min(start).alias(start))
    out = backends.join(seen, [ts, pid], "left")
    reason = F.when(F.col("_n").isNull(), "not_sampled").when(F.col("_n") > 1, "ambiguous")
    return out.withColumns({start: F.when(reason.isNull(), F.col(start)), "reason": reason}).drop("_n")


def process_before(matched: DataFrame, processes: DataFrame, keep: Sequence[str], before: Sequence[tuple[int, int]] | DataFrame, ts: str = "ts", pid: str = "pid", start: str = "starttime") -> DataFrame:
    """Matched backends with prev_<column> of their process, by pid and start time, in the snapshot before theirs; null where that
    has none or several. before: (snapshot, the one before it) rows."""
    steps = before if isinstance(before, DataFrame) else processes.sparkSession.createDataFrame(list(before), "step long, prev long")
    one = processes.groupBy(ts, pid, start).agg(F.count("*").alias("_n"), *(F.first(c).alias(f"prev_{c}") for c in keep)).where("_n = 1").drop("_n").withColumnRenamed(ts, "prev")
    rows = matched.join(steps.select(F.col("step").alias(ts), "prev"), ts, "left")
    return rows.join(one, ["prev", pid, start], "left")
