"""Frames: projections, total orders, pages, snapshots and histories of a view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layout_union(layouts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all layout versions on the union of their columns; what a layout lacks is null. Integers widen to bigint,
    floats to double, so that versions agree."""
    out = None
    for df in layouts:
        df = df.select(*(widen(df, c).alias(c) for c in df.columns))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def widen(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.simpleString()
    return F.col(c).cast({"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}.get(kind, kind))


def section_rows(df: DataFrame, frm: int, to: int, columns: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Rows of [frm, to], both ends included."""
    out = df.where(F.col(ts).between(frm, to))
    return out.select(*columns) if columns else out


def total_order(df: DataFrame, sort_key: Sequence[str]) -> list[Column]:
    """The sort key, then all other columns: nulls first, text by bytes."""
    rest = [c for c in df.columns if c not in sort_key and not df.schema[c].dataType.simpleString().startswith("map")]
    return [F.col(c).asc_nulls_first() for c in [*sort_key, *rest]]


def after(columns: Sequence[str], last: Sequence) -> Column:
    """Rows strictly after a row in the ascending order of columns, nulls first."""
    out = F.lit(False)
    for c, v in reversed(list(zip(columns, last, strict=True))):
        more = F.col(c).isNotNull() if v is None else F.coalesce(F.col(c) > F.lit(v), F.lit(False))
        out = more | (F.col(c).eqNullSafe(F.lit(v)) & out)
    return out


def page(df: DataFrame, sort_key: Sequence[str], limit: int = 1000, last: Sequence | None = None, most: int = 10_000) -> DataFrame:
    """The next `limit` rows after the last row of the page before, by the sort key: a top-k of each task."""
    df = df.where(after(sort_key, last)) if last is not None else df
    return df.orderBy(*total_order(df, sort_key)).limit(min(limit, most))


def frame_sort(df: DataFrame, column: str, descending: bool, entity: str, limit: int) -> DataFrame:
    """Nulls last both ways, ties by entity."""
    c = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(c, F.col(entity)).limit(limit)


#: Kinds of cells from the least, for a total order over cells of different kinds.
CELL_KINDS = ["null", "boolean", "signed", "unsigned", "float", "time", "text", "blob", "list"]


def cell_order(kind: Column, whole: Column, number: Column, text: Column) -> list[Column]:
    """What orders cells of mixed kinds: kind, then the value of that kind; NaN is the greatest number, texts go by bytes. A cell
    of an unknown kind comes last."""
    rank = F.array_position(F.lit(CELL_KINDS), F.coalesce(kind, F.lit("null")))
    rank = F.when(rank == 0, len(CELL_KINDS) + 1).otherwise(rank)
    of = lambda *kinds: kind.isin(*kinds)
    return [rank.asc(), F.when(of("boolean", "signed", "unsigned", "time"), whole).asc(), F.when(of("float"), number).asc(), F.when(of("text", "blob", "list"), text).asc()]


def half_open(df: DataFrame, frm: int, to: int, ts: str = "ts") -> DataFrame:
    """Rows of [frm, to): timelines, unlike row queries, don't have their end."""
    return df.where((F.col(ts) >= frm) & (F.col(ts) < to))


def frame_page(df: DataFrame, column: str, descending: bool, entity: str, limit: int, cursor: tuple) -> DataFrame:
    """The rows of a sorted frame that follow the cursor (sort value, entity). One that isn't a row of the frame, as when
    its value has changed since, raises."""
    value, name = cursor
    c, later = F.col(column), F.col(entity) > F.lit(name)
    if value is None:
        here, rest = c.isNull(), c.isNull() & later
    else:
        v = F.lit(value)
        here, rest = c == v, (c < v if descending else c > v) | c.isNull() | ((c == v) & later)
    at = df.agg(F.count_if(here & (F.col(entity) == F.lit(name))).alias("_at"))  # one row
    ok = at.select(F.when(F.col("_at") == 0, F.raise_error(F.lit("the cursor is no row of the frame")).cast("boolean")).otherwise(True).alias("_ok"))
    return frame_sort(df.crossJoin(F.broadcast(ok)).where(F.col("_ok") & F.coalesce(rest, F.lit(False))).drop("_ok"), column, descending, entity, limit)


def latest(df: DataFrame, ts: str = "ts", at: int | None = None) -> DataFrame:
    """Rows of the latest snapshot, at or before a time if one is given. The time is a max over one column."""
    when = (df if at is None else df.where(F.col(ts) <= at)).agg(F.max(ts).alias("_at"))
    return df.join(F.broadcast(when), F.col(ts) == F.col("_at")).drop("_at")


def snapshot_at(df: DataFrame, at: int, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """The snapshot in force at a time, the one before it and the one after."""
    before = df.where(F.col(ts) <= at)
    last = before.groupBy(*by).agg(F.max(ts).alias("snapshot"))
    cond = before.join(last, list(by)) if by else before.crossJoin(F.broadcast(last))
    prior = cond.where(F.col(ts) < F.col("snapshot")).groupBy(*by).agg(F.max(ts).alias("predecessor"))
    two = last.join(prior, list(by), "left") if by else last.where("snapshot IS NOT NULL").crossJoin(F.broadcast(prior))
    later = df.where(F.col(ts) > at).groupBy(*by).agg(F.min(ts).alias("successor"))
    return two.join(later, list(by), "left") if by else two.crossJoin(F.broadcast(later))


def history(df: DataFrame, entity: Sequence[str], frm: int, to: int, buckets: int, ts: str = "ts") -> DataFrame:
    """The latest row of each entity in each of n equal parts of [frm, to)."""
    part = F.floor((F.col(ts) - frm) * buckets / (to - frm)).cast("bigint")
    w = Window.partitionBy(*entity, "bucket").orderBy(F.desc(ts))
    return df.where((F.col(ts) >= frm) & (F.col(ts) < to)).withColumn("bucket", part).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sparks(df: DataFrame, entity: Sequence[str], bucket: Column, value: str, n: int = 60) -> DataFrame:
    """One row an entity: its values by bucket, in order; buckets without a value aren't there."""
    cells = df.groupBy(*entity, bucket.alias("b")).agg(F.max(value).alias("v")).where((F.col("b") >= 0) & (F.col("b") < n) & F.col("v").isNotNull())
    return cells.groupBy(*entity).agg(F.array_sort(F.collect_list(F.struct("b", "v"))).alias("cells"))


def heatmap(df: DataFrame, entity: str, bucket: Column, value: str, how: str, top: int = 8) -> DataFrame:
    """Cells of the entities with the greatest totals: entity, rank, bucket, value. Ties go to the smaller entity."""
    agg = {"sum": F.sum, "max": F.max}[how]
    cells = df.where(F.col(value).isNotNull()).groupBy(entity, bucket.alias("bucket")).agg(agg(value).alias("value"))
    best = cells.groupBy(entity).agg(agg("value").alias("score")).orderBy(F.desc("score"), entity).limit(top)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), entity)).cast("bigint"))  # `top` rows
    return cells.join(F.broadcast(best), entity).select(entity, "rank", "score", "bucket", "value")


def population(df: DataFrame, view: str, ts: str, level: Column) -> DataFrame:
    """Rows, rows of a notable level, and the worst level, by view and snapshot."""
    rank = F.array_position(F.lit(["inactive", "ok", "warning", "critical"]), level)
    return df.groupBy(view, ts).agg(F.count("*").alias("rows"), F.count_if(rank >= 3).alias("notable"), F.element_at(F.lit(["inactive", "ok", "warning", "critical"]), F.max(rank).cast("int")).alias("worst"))


def segment_listing(manifest: DataFrame, frm: int, to: int) -> DataFrame:
    """Segments that meet [frm, to] with their rows by section, from the manifest alone."""
    return manifest.where((F.col("max_ts") >= frm) & (F.col("min_ts") <= to)).groupBy("segment_id", "section").agg(F.sum("rows").alias("rows"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))


def merged_facts(facts: DataFrame, key: str, payload: Sequence[str], evidence: str) -> DataFrame:
    """Facts of several segments by id: their evidence united; conflict where contents differ."""
    packed = F.struct(*payload)
    return facts.groupBy(key).agg(F.min(packed).alias("_p"), (F.count_distinct(packed) > 1).alias("conflict"), F.array_sort(F.collect_set(evidence)).alias("evidence")).select(key, "_p.*", "conflict", "evidence")


def digest(df: DataFrame, key: str) -> DataFrame:
    """SHA-256 over the ordered keys of a bounded set of facts."""
    return df.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ""), 256).alias("digest"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one result that the other lacks, repeats counted."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
