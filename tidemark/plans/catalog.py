"""Queries over the driver's tables, one or more for each operator, with the SQL that must give the same rows.

Stand-ins: events are samples (user_id is the identity, value a gauge, its running sum by user and day a counter that resets
each day), event types are severities or kinds, orders and lineitem are facts with categories, customers are entities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.functions.session import share_code
from tidemark.functions.thresholds import classify
from tidemark.operators import anomaly, change, events, frames, incidents, joins, metrics, reduce, series
from tidemark.sources import sections

T0 = 1_704_067_200_000_000  # the first day of events
DAY = 86_400_000_000
HOUR = 3_600_000_000
GAPS = ((T0 + 5 * DAY, T0 + 6 * DAY), (T0 + 12 * DAY + 6 * HOUR, T0 + 12 * DAY + 18 * HOUR))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_EV = "ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS v, CAST((epoch_us(ts) - 1704067200000000) // 86400000000 AS BIGINT) AS day FROM events)"
_CN = _EV + ", cn AS (SELECT *, CAST(sum(v) OVER (PARTITION BY user_id, day ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM ev)"
_DIFF = (
    _CN
    + ", pr AS (SELECT *, lag(us) OVER w AS prev_us, lag(n) OVER w AS pn FROM cn WINDOW w AS (PARTITION BY user_id ORDER BY us)), "
    + "df AS (SELECT *, CASE WHEN prev_us IS NULL THEN 'first_point' WHEN us <= prev_us THEN 'anomaly' WHEN n < pn THEN 'reset' END AS reason FROM pr)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return share_code(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("us", sc.micros("ts"))
    return e.select("event_id", "us", "user_id", "event_type", "value", F.round(F.col("value") * 100).cast("bigint").alias("v"), F.floor((F.col("us") - T0) / DAY).cast("bigint").alias("day"))


def cn(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "day").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return ev(spark, d).withColumn("n", F.sum("v").over(w))


def df(spark: SparkSession, d: str, **more) -> DataFrame:
    return series.counter_diff(cn(spark, d), ["user_id"], "n", "us", **more)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _gap_sql(a: str = "prev_us", b: str = "us") -> str:
    return " OR ".join(f"({x} < {b} AND {a} < {y})" for x, y in GAPS)


# ---- scans, filters, orders ----------------------------------------------------------------------------------------------


@query(f"WITH {_EV} SELECT event_id, us, user_id, event_type, value FROM ev WHERE us BETWEEN {T0 + DAY} AND {T0 + 2 * DAY}")
def section_rows(s, d):
    return frames.section_rows(ev(s, d), T0 + DAY, T0 + 2 * DAY, ["event_id", "us", "user_id", "event_type", "value"], "us")


@query(f"WITH {_EV} SELECT count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM ev WHERE us >= {T0 + DAY} AND us < {T0 + 2 * DAY}")
def half_open_range(s, d):
    return frames.half_open(ev(s, d), T0 + DAY, T0 + 2 * DAY, "us").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(f"WITH {_EV} SELECT user_id, us, event_id, event_type FROM ev WHERE (user_id, us, event_id) > (20, {T0 + 3 * DAY}, 0) ORDER BY user_id, us, event_id LIMIT 100")
def section_page_keyset(s, d):
    return frames.page(ev(s, d).select("user_id", "us", "event_id", "event_type"), ["user_id", "us", "event_id"], 100, (20, T0 + 3 * DAY, 0))


@query(f"WITH {_EV} SELECT event_id, us, user_id FROM ev WHERE us = (SELECT max(us) FROM ev)")
def latest_row(s, d):
    return frames.latest(ev(s, d), "us").select("event_id", "us", "user_id")


@query(f"WITH {_EV} SELECT event_type, max(us) FILTER (us <= {T0 + 9 * DAY}) AS snapshot, (SELECT max(us) FROM ev e2 WHERE e2.event_type = ev.event_type AND e2.us < (SELECT max(us) FROM ev e3 WHERE e3.event_type = ev.event_type AND e3.us <= {T0 + 9 * DAY})) AS predecessor, min(us) FILTER (us > {T0 + 9 * DAY}) AS successor FROM ev GROUP BY event_type")
def snapshot_resolution(s, d):
    return frames.snapshot_at(ev(s, d), T0 + 9 * DAY, "us", ["event_type"])


@query("SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS o_orderpriority, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) < 1996 UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority, year(o_orderdate) FROM orders WHERE year(o_orderdate) >= 1996")
def layout_union(s, d):
    o = table(s, d, "orders").withColumn("y", F.year("o_orderdate"))
    old = o.where("y < 1996").select("o_orderkey", "o_custkey", "y")
    new = o.where("y >= 1996").select("o_orderkey", "o_custkey", "o_orderpriority", "y")
    return frames.layout_union([old, new])


@query(f"WITH {_EV} SELECT event_type, count(*) AS n FROM ev WHERE event_type ILIKE '%_li%' OR event_type ILIKE 'sig%' GROUP BY event_type")
def glob_search(s, d):
    e = ev(s, d)
    return e.where(sc.glob(F.col("event_type"), "*?LI*") | sc.glob(F.col("event_type"), "sig*")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {_EV} SELECT event_id, user_id, event_type FROM ev WHERE user_id = 7 AND lower(event_type) LIKE '%c%'")
def typed_filter(s, d):
    e = ev(s, d).select("event_id", "user_id", "event_type")
    return e.where(sc.search(dict(e.dtypes), "event_type", [], "user_id:7 *c*"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS entity, c_name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal FROM customer ORDER BY bal DESC NULLS LAST, CAST(c_custkey AS VARCHAR) LIMIT 1000")
def frame_sort_nulls_last(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("entity"), "c_name", F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_acctbal")).alias("bal"))
    return frames.frame_sort(c, "bal", True, "entity", 1000)


@query(f"WITH {_EV} SELECT user_id, bucket, event_id FROM (SELECT *, CAST((us - {T0}) * 10 // {30 * DAY} AS BIGINT) AS bucket, row_number() OVER (PARTITION BY user_id, (us - {T0}) * 10 // {30 * DAY} ORDER BY us DESC) AS k FROM ev WHERE us >= {T0} AND us < {T0 + 30 * DAY}) WHERE k = 1")
def history_sample(s, d):
    return frames.history(ev(s, d), ["user_id"], T0, T0 + 30 * DAY, 10, "us").select("user_id", "bucket", "event_id")


@query(f"WITH {_EV} SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 ELSE 1 END, us) AS k FROM ev) WHERE k = 1")
def distinct_on(s, d):
    return reduce.top(ev(s, d), ["user_id"], [F.when(F.col("event_type") == "error", 0).otherwise(1), F.col("us")], 1).select("user_id", "event_id", "event_type")


@query(
    "WITH o AS (SELECT o_custkey, count(*) AS orders, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS revenue FROM orders GROUP BY o_custkey), c AS (SELECT c_custkey, c_acctbal, orders, revenue FROM customer LEFT JOIN o ON c_custkey = o_custkey) "
    "SELECT c_custkey, CAST(orders AS BIGINT) AS orders, CAST(revenue AS BIGINT) AS revenue FROM c WHERE c_custkey IN (SELECT c_custkey FROM c ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25) OR c_custkey IN (SELECT c_custkey FROM c ORDER BY orders DESC NULLS LAST, c_custkey LIMIT 25) OR c_custkey IN (SELECT c_custkey FROM c ORDER BY revenue DESC NULLS LAST, c_custkey LIMIT 25)"
)
def top_n_axes_union(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("revenue"))
    c = table(s, d, "customer").select("c_custkey", "c_acctbal").join(o, "c_custkey", "left")
    return reduce.top_axes(c, [F.col(x).desc_nulls_last() for x in ("c_acctbal", "orders", "revenue")], "c_custkey", 25).select("c_custkey", "orders", "revenue")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS rows, false AS conflict FROM orders GROUP BY ALL")
def duplicate_rows(s, d):
    o = table(s, d, "orders")
    return series.duplicates(o.select("o_orderstatus", "o_orderpriority", F.lit(1).alias("x")), ["o_orderstatus", "o_orderpriority"], ["x"]).drop("x")


# ---- counters, gates, gaps -----------------------------------------------------------------------------------------------


@query(f"WITH {_DIFF} SELECT user_id, us, reason, CASE WHEN reason IS NULL THEN n - pn END AS delta, CASE WHEN reason IS NULL THEN us - prev_us END AS dt, round(CASE WHEN reason IS NULL THEN (n - pn) / ((us - prev_us) / 1e6) END, 9) AS rate FROM df")
def counter_diff(s, d):
    return df(s, d).select("user_id", "us", "reason", "delta", "dt", F.round("rate", 9).alias("rate"))


@query(f"WITH {_DIFF} SELECT user_id, us, CASE WHEN prev_us IS NULL THEN 'first_point' WHEN {_gap_sql()} THEN 'gap' ELSE reason END AS reason, CASE WHEN reason IS NULL AND NOT ({_gap_sql()}) THEN n - pn END AS delta FROM df")
def counter_diff_gap(s, d):
    return df(s, d, gaps=GAPS).select("user_id", "us", "reason", "delta")


@query(
    f"WITH {_CN}, p AS (SELECT *, lag(us) OVER w AS prev_us, lag(n) OVER w AS pn, lag(day) OVER w AS pd FROM cn WINDOW w AS (PARTITION BY user_id ORDER BY us)) "
    f"SELECT user_id, us, CASE WHEN prev_us IS NULL THEN 'missing' WHEN us <= prev_us THEN 'non_monotonic_time' WHEN pd <> day OR n < pn THEN 'reset' WHEN {_gap_sql()} THEN 'gap' ELSE 'valid' END AS quality FROM p"
)
def pair_quality(s, d):
    return series.pair_quality(cn(s, d), ["user_id"], "n", "day", "us", GAPS).select("user_id", "us", "quality")


_GATE = (
    _CN + ", g AS (SELECT user_id, us, event_id % 3 <> 0 AS st FROM ev WHERE event_type = 'signup'), c2 AS (SELECT * FROM cn WHERE event_type <> 'signup'), "
    "x AS (SELECT c2.user_id, c2.us, (SELECT arg_max(st, us) FROM g WHERE g.user_id = c2.user_id AND g.us <= c2.us) AS st, (SELECT count(*) FROM g WHERE g.user_id = c2.user_id AND g.us <= c2.us AND NOT st) AS bad FROM c2), "
    "y AS (SELECT *, lag(st) OVER w AS pst, lag(bad) OVER w AS pbad FROM x WINDOW w AS (PARTITION BY user_id ORDER BY us)) "
)


@query(f"WITH {_GATE} SELECT user_id, us, coalesce(pst, false) AND coalesce(bad = pbad, false) AS collected FROM y")
def gate_not_collected(s, d):
    c = cn(s, d)
    readings = ev(s, d).where("event_type = 'signup'").select("user_id", "us", (F.col("event_id") % 3 != 0).alias("st"))
    return series.gate_state(c.where("event_type <> 'signup'").select("user_id", "us"), readings, ["user_id"], "st", "us").select("user_id", "us", "collected")


@query(f"WITH {_EV}, s AS (SELECT user_id, us, v AS setting FROM ev WHERE event_type = 'signup') SELECT e.event_id, s.setting FROM (SELECT * FROM ev WHERE event_type <> 'signup') e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.us >= s.us")
def asof_setting(s, d):
    e = ev(s, d)
    settings = e.where("event_type = 'signup'").select("user_id", "us", F.col("v").alias("setting"))
    return series.asof(e.where("event_type <> 'signup'").select("event_id", "user_id", "us"), settings, ["user_id"], "setting", "us").select("event_id", "setting")


@query(f"WITH {_EV} SELECT user_id, arg_max(v, us) AS v FROM ev WHERE event_type = 'signup' AND us <= {T0 + 20 * DAY} GROUP BY user_id")
def setting_at(s, d):
    return joins.setting_at(ev(s, d).where("event_type = 'signup'"), T0 + 20 * DAY, ["user_id"], "v", "us")


@query(
    f"WITH {_EV}, r AS (SELECT user_id, us AS reset_at FROM ev WHERE event_type = 'error'), c AS (SELECT user_id, us, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS prev_us FROM ev WHERE event_type <> 'error') "
    "SELECT c.user_id, c.us, coalesce(r.reset_at > c.prev_us, false) AS reset_inside FROM c ASOF LEFT JOIN r ON c.user_id = r.user_id AND c.us >= r.reset_at"
)
def reset_interval_join(s, d):
    e = ev(s, d)
    resets = e.where("event_type = 'error'").select("user_id", F.col("us").alias("reset_at"))
    return series.reset_between(e.where("event_type <> 'error'").select("user_id", "us"), resets, ["user_id"], "us").select("user_id", "us", "reset_inside")


@query(
    f"WITH {_DIFF}, b AS (SELECT user_id, us, sum(CASE WHEN reason IN ('reset', 'anomaly') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS segment FROM df) SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS points, min(us) AS first_us FROM b GROUP BY user_id, segment"
)
def segmentation(s, d):
    out = series.segments(df(s, d), ["user_id"], F.coalesce(F.col("reason").isin("reset", "anomaly"), F.lit(False)), "us")
    return out.groupBy("user_id", "segment").agg(F.count("*").alias("points"), F.min("us").alias("first_us"))


_SPANS = (
    _EV + f", sp AS (SELECT user_id, us AS s, us + {12 * HOUR} AS e FROM ev), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM sp), "
    "i AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m), isl AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS spans FROM i GROUP BY user_id, k) "
)


def _spans(s, d):
    return ev(s, d).select("user_id", F.col("us").alias("s"), (F.col("us") + 12 * HOUR).alias("e"))


@query(f"WITH {_SPANS} SELECT user_id, s, e, spans FROM isl")
def coverage_islands(s, d):
    return series.islands(_spans(s, d), ["user_id"], "s", "e").select("user_id", "s", "e", "spans")


@query(
    f"WITH {_SPANS}, c AS (SELECT * FROM isl WHERE e > {T0} AND s < {T0 + 30 * DAY}), g AS (SELECT user_id, greatest(coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY s), {T0}), {T0}) AS gap_from, least(s, {T0 + 30 * DAY}) AS gap_to FROM c UNION ALL SELECT user_id, max(e), {T0 + 30 * DAY} FROM c GROUP BY user_id) "
    f"SELECT user_id, CAST(gap_from AS BIGINT) AS gap_from, CAST(gap_to AS BIGINT) AS gap_to FROM g WHERE gap_to > gap_from AND gap_to - gap_from >= {HOUR}"
)
def coverage_gaps(s, d):
    covered = series.islands(_spans(s, d), ["user_id"], "s", "e")
    return series.complement(covered, ["user_id"], "s", "e", T0, T0 + 30 * DAY, HOUR).select("user_id", "gap_from", "gap_to")


@query(
    f"WITH {_EV}, sp AS (SELECT user_id, greatest(us, {T0 + DAY}) AS s, least(us + {6 * HOUR}, {T0 + 8 * DAY}) AS e FROM ev WHERE least(us + {6 * HOUR}, {T0 + 8 * DAY}) > greatest(us, {T0 + DAY})), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM sp) "
    f"SELECT user_id, CAST(sum(CASE WHEN seen IS NULL OR s > seen THEN e - s WHEN e > seen THEN e - seen ELSE 0 END) AS BIGINT) AS covered_us, round(sum(CASE WHEN seen IS NULL OR s > seen THEN e - s WHEN e > seen THEN e - seen ELSE 0 END) / {7 * DAY}.0, 9) AS share FROM m GROUP BY user_id"
)
def cadence_covered(s, d):
    return series.cadence_cover(ev(s, d), ["user_id"], 6 * HOUR, T0 + DAY, T0 + 8 * DAY, "us").withColumn("share", F.round("share", 9))


# ---- reductions ----------------------------------------------------------------------------------------------------------


@query(f"WITH {_EV} SELECT event_type, day AS bucket, CAST(sum(v) AS BIGINT) AS value FROM ev GROUP BY event_type, day")
def bucket_sum(s, d):
    return reduce.bucket_values(ev(s, d), ["event_type"], reduce.bucket(F.col("us"), T0, DAY), "v", "sum")


@query(f"WITH {_EV} SELECT user_id, CAST((us - {T0}) // {6 * HOUR} AS BIGINT) AS bucket, max(v) AS value FROM ev GROUP BY ALL")
def bucket_max(s, d):
    return reduce.bucket_values(ev(s, d), ["user_id"], reduce.bucket(F.col("us"), T0, 6 * HOUR), "v", "max")


@query(f"WITH {_DIFF} SELECT user_id, day AS bucket, round(max((n - pn) / ((us - prev_us) / 1e6)), 9) AS value FROM df WHERE reason IS NULL GROUP BY user_id, day")
def delta_rate_bucket(s, d):
    out = reduce.bucket_values(df(s, d), ["user_id"], F.col("day"), "rate", "max")
    return out.withColumn("value", F.round("value", 9))


@query("SELECT p_brand, round(max(100.0 * p_size / greatest(p_size + CAST(floor(p_retailprice) AS BIGINT), 1)), 9) AS value FROM part GROUP BY p_brand")
def gauge_ratio_bucket(s, d):
    out = metrics.gauge_ratio(table(s, d, "part"), ["p_brand"], F.col("p_size"), F.floor("p_retailprice").cast("bigint"), "part")
    return out.withColumn("value", F.round("value", 9))


@query(f"WITH {_EV} SELECT day, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 9) AS fraction FROM ev GROUP BY day")
def active_fraction(s, d):
    return metrics.active_fraction(ev(s, d), ["day"], F.col("event_type") == "click").select("day", F.round("fraction", 9).alias("fraction"))


@query(f"WITH {_EV}, p AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS dt FROM ev) SELECT user_id, CAST(sum(dt) AS BIGINT) AS wait_us FROM p WHERE event_type = 'error' AND dt IS NOT NULL GROUP BY user_id")
def wait_time(s, d):
    return metrics.wait_time(ev(s, d), ["user_id"], ["user_id"], F.col("event_type") == "error", "us")


@query(f"WITH {_EV}, t AS (SELECT event_type, user_id, CAST(sum(v) AS BIGINT) AS score FROM ev GROUP BY ALL) SELECT event_type, user_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, user_id) AS rank FROM t) WHERE rank <= 8")
def top_k_entities(s, d):
    t = ev(s, d).groupBy("event_type", "user_id").agg(F.sum("v").alias("score"))
    return reduce.top(t, ["event_type"], [F.desc("score"), F.col("user_id")], 8)


@query(
    f"WITH {_EV}, c AS (SELECT user_id, day AS bucket, CAST(sum(v) AS BIGINT) AS value FROM ev GROUP BY ALL), b AS (SELECT user_id, CAST(sum(value) AS BIGINT) AS score FROM c GROUP BY user_id ORDER BY score DESC, user_id LIMIT 8), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, user_id) AS rank FROM b) SELECT c.user_id, rank, score, bucket, value FROM c JOIN r USING (user_id)"
)
def heatmap_top(s, d):
    return frames.heatmap(ev(s, d), "user_id", F.col("day"), "v", "sum", 8)


@query(f"WITH {_EV}, c AS (SELECT user_id, day AS b, max(v) AS v FROM ev WHERE day BETWEEN 0 AND 9 GROUP BY ALL) SELECT user_id, string_agg(b || ':' || v, ',' ORDER BY b) AS cells FROM c GROUP BY user_id")
def spark_rows(s, d):
    out = frames.sparks(ev(s, d), ["user_id"], F.col("day"), "v", 10)
    return out.select("user_id", F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["b"], c["v"])), ",").alias("cells"))


@query("WITH t AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) SELECT o_custkey, round(100.0 * v / (SELECT sum(v) FROM t), 9) AS pct FROM t")
def percent_of_total(s, d):
    t = table(s, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("v"))
    return reduce.percent_of_total(t, "v").select("o_custkey", F.round("pct", 9).alias("pct"))


@query(f"WITH {_DIFF} SELECT day, CAST(sum(n - pn) AS BIGINT) AS delta, CAST(sum(us - prev_us) AS BIGINT) AS dt, count(*) AS pairs, round(sum(n - pn) * 1e6 / sum(us - prev_us), 9) AS rate FROM df WHERE reason IS NULL GROUP BY day")
def counter_reduction(s, d):
    return reduce.counter_reduction(df(s, d), ["day"]).withColumn("rate", F.round("rate", 9))


@query(
    f"WITH {_DIFF}, q AS (SELECT day, event_type, CASE WHEN reason IS NULL THEN n - pn END AS a, CASE WHEN reason IS NULL AND event_type <> 'view' THEN us - prev_us END AS b FROM df) SELECT day, event_type, CAST(sum(a) FILTER (a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS num, CAST(sum(b) FILTER (a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS den, count(*) FILTER ((a IS NULL) <> (b IS NULL)) AS unmatched, "
    "round(CASE WHEN count(*) FILTER ((a IS NULL) <> (b IS NULL)) = 0 THEN CAST(sum(a) AS DOUBLE) / nullif(sum(b), 0) END, 12) AS ratio FROM q GROUP BY day, event_type"
)
def ratio_reduction(s, d):
    q = df(s, d).withColumn("b", F.when(F.col("event_type") != "view", F.col("dt")))
    return reduce.ratio_reduction(q, ["day", "event_type"], "delta", "b").withColumn("ratio", F.round("ratio", 12))


@query(f"WITH {_EV} SELECT event_type, day, min(v) AS min, max(v) AS max, round(avg(v), 9) AS mean, count(v) AS samples FROM ev GROUP BY ALL")
def gauge_series(s, d):
    return reduce.gauge_reduction(ev(s, d), ["event_type", "day"], "v").withColumn("mean", F.round("mean", 9))


@query(
    f"WITH {_EV}, h AS (SELECT user_id, v, greatest(us, {T0}) AS a, least(coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us), {T0 + 30 * DAY}), us + {12 * HOUR}, {T0 + 30 * DAY}) AS b FROM ev), k AS (SELECT *, unnest(range((a - {T0}) // {DAY}, (b - 1 - {T0}) // {DAY} + 1)) AS bucket FROM h WHERE b > a), "
    f"x AS (SELECT user_id, CAST(bucket AS BIGINT) AS bucket, v, least(b, {T0} + (bucket + 1) * {DAY}) - greatest(a, {T0} + bucket * {DAY}) AS hold FROM k) SELECT user_id, bucket, CAST(sum(v * hold) AS BIGINT) AS weighted, CAST(sum(hold) AS BIGINT) AS held_us, round(sum(v * hold) / sum(hold), 6) AS mean FROM x GROUP BY user_id, bucket"
)
def time_weighted_mean(s, d):
    return reduce.time_weighted(ev(s, d), ["user_id"], "v", T0, T0 + 30 * DAY, DAY, 12 * HOUR, "us").withColumn("mean", F.round("mean", 6))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem WHERE CAST(l_quantity AS BIGINT) > 0 GROUP BY ALL")
def joint_counts(s, d):
    li = table(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("q"))
    return reduce.joint_counts(li, ["l_returnflag", "l_linestatus"], "q")


@query(
    "WITH j AS (SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY ALL) SELECT 'total' AS level, CAST(NULL AS VARCHAR) AS value, CAST(sum(n) AS BIGINT) AS n FROM j UNION ALL SELECT 'l_returnflag', l_returnflag, CAST(sum(n) AS BIGINT) FROM j GROUP BY l_returnflag UNION ALL SELECT 'l_linestatus', l_linestatus, CAST(sum(n) AS BIGINT) FROM j GROUP BY l_linestatus"
)
def marginal_rollup(s, d):
    return reduce.marginals(joint_counts(s, d), ["l_returnflag", "l_linestatus"])


@query(
    "WITH t AS (SELECT CASE WHEN p_size > 45 THEN NULL ELSE p_brand END AS p_brand, count(*) AS n FROM part GROUP BY 1), k AS (SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) AS r FROM t WHERE p_brand IS NOT NULL) "
    "SELECT 'top' AS kind, p_brand, n FROM k WHERE r <= 7 UNION ALL SELECT 'other', NULL, CAST(sum(n) AS BIGINT) FROM k WHERE r > 7 UNION ALL SELECT 'missing', NULL, n FROM t WHERE p_brand IS NULL"
)
def top_n_other(s, d):
    p = table(s, d, "part").select(F.when(F.col("p_size") <= 45, F.col("p_brand")).alias("p_brand"), F.lit(1).cast("bigint").alias("one"))
    return reduce.top_other(p, "p_brand", "one", 7)


@query(f"WITH {_EV} SELECT user_id, arg_max(us, (v, -us)) AS us, arg_max(event_id, (v, -us)) AS event_id, max(v) AS score FROM ev GROUP BY user_id")
def gauge_argmax(s, d):
    return reduce.arg_extreme(ev(s, d), ["user_id"], F.col("v"), "us", ["event_id"])


@query(f"WITH {_EV} SELECT user_id, min(us) AS first_ts, max(us) AS last_ts, arg_min(v, us) AS first_value, arg_max(v, us) AS last_value, round(CASE WHEN max(us) > min(us) THEN (arg_max(v, us) - arg_min(v, us)) * 1e6 / (max(us) - min(us)) END, 12) AS slope FROM ev GROUP BY user_id")
def gauge_trend(s, d):
    return reduce.trend(ev(s, d), ["user_id"], "v", "us").withColumn("slope", F.round("slope", 12))


@query(
    f"WITH {_EV}, g AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM ev), l AS (SELECT user_id, count(*) AS gaps, list_sort(list(gap)) AS a FROM g WHERE gap IS NOT NULL GROUP BY user_id) "
    "SELECT user_id, gaps, CASE WHEN gaps >= 3 THEN CAST(ceil((a[(gaps - 1) // 2 + 1] + a[gaps // 2 + 1]) / 2.0) AS BIGINT) END AS evidence_period, a[gaps // 2 + 1] AS quality_period, CASE WHEN a[1] = a[-1] THEN a[1] END AS constant_period FROM l"
)
def observed_period(s, d):
    return reduce.observed_period(ev(s, d), ["user_id"], "us")


@query(
    f"WITH {_DIFF}, q AS (SELECT user_id, CASE WHEN reason IS NULL THEN n - pn END AS a, CASE WHEN reason IS NULL THEN us - prev_us END AS b FROM df) SELECT user_id, count(*) AS endpoints, count(*) FILTER (a IS NOT NULL) AS aligned, CASE WHEN count(a) >= 3 AND count(a) * 10 >= count(*) * 7 THEN CAST(sum(a) AS BIGINT) END AS sum_a, CASE WHEN count(a) >= 3 AND count(a) * 10 >= count(*) * 7 THEN CAST(sum(b) AS BIGINT) END AS sum_b FROM q GROUP BY user_id"
)
def paired_sums_coverage(s, d):
    return reduce.paired_sums(df(s, d), ["user_id"], "delta", "dt")


_HEALTH = (
    _EV + ", h AS (SELECT day, max(CASE WHEN event_type = 'error' THEN least(v / 20000.0, 1.0) END) AS e, max(CASE WHEN event_type = 'click' THEN least(v / 40000.0, 1.0) END) AS c, max(CASE WHEN event_type = 'signup' THEN v END) AS r, max(CASE WHEN v > 39000 THEN 1 ELSE 0 END) AS f FROM ev GROUP BY day), "
    "hl AS (SELECT day, CASE WHEN f = 1 THEN 'critical' WHEN r IS NULL THEN 'unknown' ELSE 'scored' END AS state, CASE WHEN f = 1 THEN 0.0 WHEN r IS NOT NULL THEN (1 - coalesce(e, 0)) * (1 - coalesce(c, 0)) END AS score FROM h) "
)


def _health(s, d):
    cut = lambda t, m: F.when(F.col("event_type") == t, F.least(F.col("v") / F.lit(m), F.lit(1.0)))
    e = ev(s, d).withColumns({"e": cut("error", 20000.0), "c": cut("click", 40000.0), "r": F.when(F.col("event_type") == "signup", F.col("v")), "f": F.col("v") > 39000})
    return reduce.health(e, ["day"], ["r"], {"errors": "e", "load": "c"}, "f")


@query(f"WITH {_HEALTH} SELECT day, state, round(score, 9) AS score FROM hl")
def health_line(s, d):
    return _health(s, d).withColumn("score", F.round("score", 9))


@query(f"WITH {_HEALTH}, k AS (SELECT *, CAST(day // 5 AS BIGINT) AS bucket, row_number() OVER (PARTITION BY day // 5 ORDER BY state <> 'critical', score IS NULL, score, day) AS r FROM hl) SELECT bucket, day, state, round(score, 9) AS score FROM k WHERE r = 1")
def worst_downsample(s, d):
    return reduce.worst_points(_health(s, d), [], F.floor(F.col("day") / 5), "day").withColumn("score", F.round("score", 9))


@query(
    f"WITH {_EV}, w AS (SELECT event_type, day, CAST(sum(v) AS BIGINT) AS written FROM ev GROUP BY ALL), a AS (SELECT event_type, count(*) AS days, 1000000000 - max(day) * 1000 AS available, CAST((sum(written) - arg_min(written, day)) AS DOUBLE) / nullif(count(*) - 1, 0) AS per_day FROM w GROUP BY event_type) SELECT event_type, days, CAST(available AS BIGINT) AS available, round(per_day, 6) AS bytes_per_day, round(available / per_day, 6) AS days_left FROM a"
)
def storage_forecast(s, d):
    w = ev(s, d).groupBy("event_type", "day").agg(F.sum("v").alias("written")).withColumn("available", 1_000_000_000 - F.col("day") * 1000)
    return reduce.exhaustion(w, ["event_type"], "written", "available").withColumns({"bytes_per_day": F.round("bytes_per_day", 6), "days_left": F.round("days_left", 6)})


@query(f"WITH {_EV}, g AS (SELECT day, CAST(sum(v) AS BIGINT) AS bytes FROM ev GROUP BY day), c AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY day % 2, 100 - day DESC, day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before FROM g) SELECT day, bytes, CAST(freed_before AS BIGINT) AS freed_before FROM c WHERE freed_before < 12000000")
def retention(s, d):
    g = ev(s, d).groupBy("day").agg(F.sum("v").alias("bytes")).withColumn("age", 100 - F.col("day"))
    return reduce.retention(g, F.col("day") % 2, "age", "bytes", 12_000_000, "day").select("day", "bytes", "freed_before")


@query(f"WITH {_EV} SELECT greatest(0, least(55, CAST(floor((us - {T0 + DAY}) * 56 / {20 * DAY}) AS BIGINT))) AS bucket, max(v) AS v FROM ev GROUP BY 1")
def spine_rebucket(s, d):
    return ev(s, d).groupBy(reduce.rebucket(F.col("us"), T0 + DAY, T0 + 21 * DAY, 56).alias("bucket")).agg(F.max("v").alias("v"))


@query(f"WITH {_EV} SELECT day, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors FROM ev GROUP BY day")
def distinct_and_filtered_counts(s, d):
    return reduce.exact_counts(ev(s, d), ["day"], {"users": "user_id"}, {"errors": F.col("event_type") == "error"})


@query(f"WITH {_EV} SELECT event_type, day, count(*) AS rows, count(*) FILTER (v > 20000) AS notable, CASE WHEN max(v) > 30000 THEN 'critical' WHEN max(v) > 20000 THEN 'warning' ELSE 'ok' END AS worst FROM ev GROUP BY ALL")
def population_summary(s, d):
    level = F.when(F.col("v") > 30000, "critical").when(F.col("v") > 20000, "warning").otherwise("ok")
    return frames.population(ev(s, d), "event_type", "day", level)


# ---- text ----------------------------------------------------------------------------------------------------------------

_MSG = (
    "m AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS v, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'FATAL' WHEN 'signup' THEN 'PANIC' WHEN 'click' THEN 'LOG' ELSE 'WARNING' END AS severity, "
    "CASE event_id % 7 WHEN 0 THEN 'duplicate key value violates \"pk_' || user_id || '\" at character ' || event_id WHEN 1 THEN 'process ' || user_id || ' still waiting for lock (' || event_id || ')' WHEN 2 THEN 'relation ' || user_id || ' does not exist, relation ' || user_id WHEN 3 THEN 'permission denied for table t' || user_id "
    "WHEN 4 THEN 'duration after ' || event_id || '.5 ms in ''' || event_type || ''' and \"\"' WHEN 5 THEN 'invalid input syntax for type int: x' || event_id ELSE 'checkpoint at ' || upper(printf('%x/%x', event_id, user_id)) || ' [' || event_id || '] out of memory' END AS message FROM events)"
)


def msg(s, d):
    e = ev(s, d)
    sev = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "FATAL").when(F.col("event_type") == "signup", "PANIC").when(F.col("event_type") == "click", "LOG").otherwise("WARNING")
    i, u, k = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_id") % 7
    text = (
        F.when(k == 0, F.concat(F.lit('duplicate key value violates "pk_'), u, F.lit('" at character '), i))
        .when(k == 1, F.concat(F.lit("process "), u, F.lit(" still waiting for lock ("), i, F.lit(")")))
        .when(k == 2, F.concat(F.lit("relation "), u, F.lit(" does not exist, relation "), u))
        .when(k == 3, F.concat(F.lit("permission denied for table t"), u))
        .when(k == 4, F.concat(F.lit("duration after "), i, F.lit(".5 ms in '"), F.col("event_type"), F.lit("' and \"\"")))
        .when(k == 5, F.concat(F.lit("invalid input syntax for type int: x"), i))
        .otherwise(F.concat(F.lit("checkpoint at "), F.hex("event_id"), F.lit("/"), F.hex("user_id"), F.lit(" ["), i, F.lit("] out of memory")))
    )
    return e.select("event_id", "us", "user_id", "event_type", "v", sev.alias("severity"), text.alias("message"))


_PATTERN = (
    "CASE event_id % 7 WHEN 0 THEN 'duplicate key value violates \"...\"' WHEN 1 THEN 'process ... still waiting for lock (...)' WHEN 2 THEN 'relation ... does not exist, relation ' || user_id WHEN 3 THEN 'permission denied for table ...' "
    "WHEN 4 THEN 'duration after ... ms in ''...'' and \"\"' WHEN 5 THEN 'invalid input syntax for type int: ...' ELSE 'checkpoint at ... [...] out of memory' END"
)
_CATEGORY = "CASE WHEN severity = 'PANIC' THEN 'data_corruption' ELSE CASE event_id % 7 WHEN 0 THEN 'constraint' WHEN 1 THEN 'lock' WHEN 2 THEN 'syntax' WHEN 3 THEN 'auth' WHEN 5 THEN 'syntax' WHEN 6 THEN 'resource' ELSE CASE WHEN severity = 'FATAL' THEN 'system' ELSE 'other' END END END"


@query(f"WITH {_MSG} SELECT event_id, {_PATTERN} AS pattern FROM m")
def log_normalize(s, d):
    return msg(s, d).select("event_id", sc.normalize_message(F.col("message")).alias("pattern"))


@query(f"WITH {_MSG} SELECT event_id, severity, {_CATEGORY} AS category FROM m")
def log_classify(s, d):
    patterns = msg(s, d).withColumn("pattern", sc.normalize_message(F.col("message")))
    return patterns.select("event_id", "severity", sc.error_category(F.col("pattern"), F.col("severity")).alias("category"))


@query(f"WITH {_MSG}, p AS (SELECT *, {_PATTERN} AS pattern FROM m) SELECT severity, pattern, count(*) AS n, arg_min(message, us) AS sample FROM p GROUP BY ALL ORDER BY n DESC, severity, pattern LIMIT 32")
def error_groups(s, d):
    e = msg(s, d).withColumns({"ts": F.col("us"), "sqlstate": F.lit(None).cast("string")})
    return events.error_groups(e).select("severity", "pattern", "n", "sample")


@query(
    f"WITH {_MSG}, q AS (SELECT us, v, 'SELECT * FROM t_' || event_type || ' WHERE id = ' || user_id || ' AND x2 > ' || v AS st, 'SELECT * FROM t_' || event_type || ' WHERE id = ... AND x2 > ...' AS pattern FROM m) SELECT pattern, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, max(v) AS longest, arg_max(us, (v, -us)) AS ts, arg_max(st, (v, -us)) AS sample FROM q GROUP BY pattern ORDER BY total DESC, pattern LIMIT 16"
)
def slow_group(s, d):
    q = msg(s, d).select(F.col("us").alias("ts"), F.col("v").alias("duration"), F.concat(F.lit("SELECT * FROM t_"), "event_type", F.lit(" WHERE id = "), F.col("user_id").cast("string"), F.lit(" AND x2 > "), F.col("v").cast("string")).alias("statement"))
    return events.slow_groups(q)


@query(f"WITH {_MSG} SELECT event_id, severity FROM m WHERE severity IN ('ERROR', 'FATAL', 'PANIC') OR event_type = 'view'")
def min_severity_filter(s, d):
    m = msg(s, d).withColumn("severity", F.when(F.col("event_type") != "view", F.col("severity")))
    return m.where(events.at_least(F.col("severity"), "ERROR")).select("event_id", F.coalesce("severity", F.lit("WARNING")).alias("severity"))


_NOTE = (
    _MSG + ", n AS (SELECT event_id, us, CASE WHEN severity = 'PANIC' THEN 'panic_severity_observation' WHEN event_id % 7 = 1 THEN 'deadlock_observation' WHEN event_id % 7 = 6 THEN 'postgres_out_of_memory_observation' END AS class, CASE WHEN severity = 'PANIC' THEN 0 WHEN event_id % 7 = 1 THEN 3 WHEN event_id % 7 = 6 THEN 1 END AS priority FROM m)"
)


@query(f"WITH {_NOTE} SELECT event_id, class, priority, (SELECT count(*) FROM n WHERE class IS NOT NULL) AS total, (SELECT greatest(count(*) - 100, 0) FROM n WHERE class IS NOT NULL) AS omitted FROM n WHERE class IS NOT NULL ORDER BY priority, us DESC, event_id LIMIT 100")
def notable_preview(s, d):
    m = msg(s, d)
    state = F.when(F.col("event_id") % 7 == 1, "40P01").when(F.col("event_id") % 7 == 6, "53200")
    n = m.withColumn("n", events.notable(F.lit("error_group"), F.col("severity"), state, F.lit(None).cast("int"))).where("n IS NOT NULL").select("event_id", "us", "n.class", "n.priority")
    return events.preview(n, "us", "event_id").drop("us")


# ---- thresholds ----------------------------------------------------------------------------------------------------------


def _levels(df: DataFrame, key: str, policy: str, *inputs) -> DataFrame:
    return df.select(key, classify(policy, *inputs).alias("c")).select(key, "c.level", "c.reason", F.round("c.observed", 9).alias("observed"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 5000 >= 90 THEN 'critical' WHEN o_totalprice / 5000 >= 70 THEN 'warning' ELSE 'ok' END AS level, CAST(NULL AS VARCHAR) AS reason, round(o_totalprice / 5000, 9) AS observed FROM orders")
def threshold_scalar(s, d):
    return _levels(table(s, d, "orders"), "o_orderkey", "os.cgroup.cpu_used_pct", F.col("o_totalprice") / 5000)


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal / 3000 > 2 THEN 'critical' WHEN c_acctbal / 3000 > 1 THEN 'warning' ELSE 'ok' END AS level, CASE WHEN c_acctbal < 0 THEN 'out_of_domain' END AS reason, round(CASE WHEN c_acctbal >= 0 THEN c_acctbal / 3000 END, 9) AS observed FROM customer")
def threshold_fraction(s, d):
    return _levels(table(s, d, "customer"), "c_custkey", "os.load.avg1_per_core", F.col("c_acctbal"), F.lit(3000))


@query("SELECT p_partkey, CASE WHEN p_retailprice * 10 <= 10000 THEN 'ok' WHEN p_size / 200.0 >= 0.2 THEN 'critical' WHEN p_size / 200.0 >= 0.1 THEN 'warning' ELSE 'ok' END AS level, CAST(NULL AS VARCHAR) AS reason, round(p_size / 200.0, 9) AS observed FROM part")
def threshold_ratio_floor(s, d):
    return _levels(table(s, d, "part"), "p_partkey", "pg.tables.dead_tuple_pct", F.col("p_size") / 200.0, F.col("p_retailprice") * 10)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL WHEN s_acctbal > 5000 THEN 'warning' ELSE 'ok' END AS level, CASE WHEN s_acctbal < 0 THEN 'out_of_domain' END AS reason, round(CASE WHEN s_acctbal >= 0 THEN s_acctbal END, 9) AS observed FROM supplier")
def threshold_limit(s, d):
    return _levels(table(s, d, "supplier"), "s_suppkey", "pg.tables.vacuum_threshold_exceeded", F.col("s_acctbal"), F.lit(5000))


@query(
    f"WITH {_EV}, a AS (SELECT event_id, event_type <> 'error' AS gate, us / 1e6 AS e, {(T0 + 20 * DAY) / 1e6} AS n FROM ev) SELECT event_id, CASE WHEN NOT gate OR e > n THEN NULL WHEN n - e > 86400 THEN 'critical' WHEN n - e > 21600 THEN 'warning' ELSE 'ok' END AS level, CASE WHEN NOT gate THEN 'not_applicable' WHEN e > n THEN 'out_of_domain' END AS reason, round(CASE WHEN gate AND e <= n THEN n - e END, 4) AS observed FROM a"
)
def threshold_age(s, d):
    e = ev(s, d)
    return _levels(e, "event_id", "pg.tables.autovacuum_age_seconds", F.col("us") / F.lit(1e6), F.lit((T0 + 20 * DAY) / 1e6), F.col("event_type") != "error").withColumn("observed", F.round("observed", 4))


@query(
    "SELECT o_orderkey, CASE WHEN o_totalprice * 50000 >= 16106127360 THEN 'ok' WHEN o_totalprice / 500000 < 0.1 THEN 'critical' WHEN o_totalprice / 500000 < 0.2 THEN 'warning' ELSE 'ok' END AS level, CAST(NULL AS VARCHAR) AS reason, round(o_totalprice / 500000, 9) AS observed FROM orders WHERE o_totalprice <= 500000"
)
def threshold_free_capacity(s, d):
    return _levels(table(s, d, "orders").where("o_totalprice <= 500000"), "o_orderkey", "os.filesystem.free_capacity", F.col("o_totalprice") * 50000, F.lit(500000.0 * 50000))


# ---- anomalies and changes -----------------------------------------------------------------------------------------------

_FROM, _TO, _WIN, _STEP = T0, T0 + 30 * DAY, 3 * DAY, DAY
_ENDS = [*range(_FROM + _WIN, _TO, _STEP), _TO]
_SCORE = (
    _EV + f", pos AS (SELECT unnest([{', '.join(map(str, _ENDS))}]) AS position), x AS (SELECT user_id, position, us BETWEEN position - {_WIN} AND position AS cur, CAST(v AS DOUBLE) AS v FROM ev, pos WHERE us BETWEEN {_FROM} AND {_TO}), "
    "a AS (SELECT user_id, position, count(*) FILTER (cur) AS n_cur, count(*) FILTER (NOT cur) AS n_ref, median(v) FILTER (cur) AS med_cur, median(v) FILTER (NOT cur) AS med_ref FROM x GROUP BY ALL), "
    "b AS (SELECT x.user_id, x.position, median(abs(v - med_ref)) FILTER (NOT cur) AS mad_ref FROM x JOIN a USING (user_id, position) GROUP BY ALL), "
    "sc AS (SELECT a.user_id, a.position, n_cur, n_ref, CASE WHEN n_cur = 0 THEN 'all_no_data' WHEN n_ref < 20 THEN 'ref_too_small' WHEN n_cur < 3 THEN 'cur_too_small' END AS reason, (med_cur - med_ref) / greatest(1.4826 * mad_ref, 1e-9, 0.05 * abs(med_ref)) AS m FROM a JOIN b USING (user_id, position)), "
    "sr AS (SELECT user_id, position, n_cur, n_ref, reason, CASE WHEN reason IS NULL THEN m END AS m FROM sc)"
)


def _scores(s, d):
    points = ev(s, d).withColumn("segment", F.lit(0))
    return anomaly.scores(points, ["user_id"], "v", _FROM, _TO, _WIN, _STEP, "us")


@query(f"WITH {_SCORE} SELECT user_id, position, CASE WHEN reason IS NULL THEN n_cur END AS n_cur, CASE WHEN reason IS NULL THEN n_ref END AS n_ref, reason, round(m, 9) AS m FROM sr")
def robust_score(s, d):
    ok = F.col("reason").isNull()
    return _scores(s, d).select("user_id", "position", F.when(ok, F.col("n_cur")).cast("bigint").alias("n_cur"), F.when(ok, F.col("n_ref")).cast("bigint").alias("n_ref"), "reason", F.round("m", 9).alias("m"))


_EPISODE = _SCORE + (
    ", h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY position) AS i FROM sr), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY position) AS k FROM h WHERE abs(m) > 1.0), "
    'ep AS (SELECT user_id, min(position) AS start, max(position) AS "end", count(*) AS positions, arg_max(position, (abs(m), -position)) AS peak, round(arg_max(m, (abs(m), -position)), 9) AS peak_m FROM g GROUP BY user_id, k)'
)


@query(f'WITH {_EPISODE} SELECT user_id, start, "end", positions, peak, peak_m FROM ep')
def episodes(s, d):
    return anomaly.episodes(_scores(s, d), ["user_id"], 1.0).withColumn("peak_m", F.round("peak_m", 9))


@query(f'WITH {_EPISODE} SELECT user_id, start, "end", peak_m FROM ep ORDER BY abs(peak_m) DESC, user_id, start, "end" LIMIT 20')
def episode_rank(s, d):
    return anomaly.rank_episodes(episodes(s, d), ["user_id"], 20).select("user_id", "start", "end", "peak_m")


@query(f"WITH {_SCORE} SELECT coalesce(reason, 'evaluated') AS outcome, count(*) AS positions FROM sr GROUP BY 1")
def scan_accounting(s, d):
    return anomaly.scan_accounting(_scores(s, d), [])


@query(
    f"WITH {_EV}, e AS (SELECT user_id, min(us) AS s, max(us) AS t FROM ev WHERE v > 15000 GROUP BY user_id, us // {4 * HOUR}), k AS (SELECT *, max(t) OVER (ORDER BY s, t, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e), i AS (SELECT *, sum(CASE WHEN seen IS NULL OR s - seen > {HOUR} THEN 1 ELSE 0 END) OVER (ORDER BY s, t, user_id ROWS UNBOUNDED PRECEDING) AS c FROM k) "
    'SELECT min(s) AS start, max(t) AS "end", count(*) AS members FROM i GROUP BY c'
)
def session_clusters(s, d):
    e = ev(s, d).where("v > 15000").groupBy("user_id", F.floor(F.col("us") / (4 * HOUR)).alias("w")).agg(F.min("us").alias("start"), F.max("us").alias("end"))
    found = incidents.clusters(e.withColumn("node", F.lit("n")), ["node"], HOUR, 400 * DAY, key="user_id", listed=False)
    return found.select("start", "end", F.col("n_members").alias("members"))


@query(
    f"WITH RECURSIVE {_EV}, e AS (SELECT user_id, min(us) AS s, max(us) AS t FROM ev WHERE v > 15000 GROUP BY user_id, us // {4 * HOUR}), n AS (SELECT *, row_number() OVER (ORDER BY s, t, user_id) AS i FROM e), "
    f"r AS (SELECT i, s AS cs, t AS ct, 1 AS c, 0 AS split FROM n WHERE i = 1 UNION ALL SELECT n.i, CASE WHEN n.s - r.ct <= {HOUR} AND greatest(r.ct, n.t) - r.cs <= {6 * HOUR} THEN r.cs ELSE n.s END, CASE WHEN n.s - r.ct <= {HOUR} AND greatest(r.ct, n.t) - r.cs <= {6 * HOUR} THEN greatest(r.ct, n.t) ELSE n.t END, "
    f"CASE WHEN n.s - r.ct <= {HOUR} AND greatest(r.ct, n.t) - r.cs <= {6 * HOUR} THEN r.c ELSE r.c + 1 END, CASE WHEN n.s - r.ct <= {HOUR} AND greatest(r.ct, n.t) - r.cs <= {6 * HOUR} THEN r.split WHEN n.s - r.ct <= {HOUR} THEN 1 ELSE 0 END FROM r JOIN n ON n.i = r.i + 1) "
    'SELECT min(cs) AS start, max(ct) AS "end", count(*) AS members, max(split) AS split_from_previous FROM r GROUP BY c'
)
def incident_clusters(s, d):
    e = ev(s, d).where("v > 15000").groupBy("user_id", F.floor(F.col("us") / (4 * HOUR)).alias("w")).agg(F.min("us").alias("start"), F.max("us").alias("end"))
    found = incidents.clusters(e.withColumn("node", F.lit("n")), ["node"], HOUR, 6 * HOUR, key="user_id", listed=False)
    return found.select("start", "end", F.col("n_members").alias("members"), "split_from_previous")


@query(
    "WITH x AS (SELECT l_returnflag, p_brand, count(*) FILTER (year(l_shipdate) < 1999) AS r, count(*) FILTER (year(l_shipdate) >= 1999) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), t AS (SELECT l_returnflag, sum(r) AS rt, sum(c) AS ct FROM x GROUP BY l_returnflag) "
    "SELECT l_returnflag, CAST(rt AS BIGINT) AS reference_total, CAST(ct AS BIGINT) AS current_total, round(sum(abs(c / ct - r / rt)) / 2, 9) AS total_variation, round(max(abs(c / ct - r / rt)), 9) AS max_abs_share_delta, CASE WHEN round(sum(abs(c / ct - r / rt)) / 2, 15) >= 0.2 THEN 'shift' ELSE 'stable' END AS outcome FROM x JOIN t USING (l_returnflag) GROUP BY l_returnflag, rt, ct"
)
def total_variation(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    late = F.year("l_shipdate") >= 1999
    x = li.groupBy("l_returnflag", "p_brand").agg(F.count_if(~late).alias("r"), F.count_if(late).alias("c"))
    out = change.total_variation(x, ["l_returnflag"], "p_brand", "r", "c")
    return out.withColumns({"total_variation": F.round("total_variation", 9), "max_abs_share_delta": F.round("max_abs_share_delta", 9)})


@query(
    "WITH x AS (SELECT l_suppkey, count(*) FILTER (year(l_shipdate) < 1999) AS ro, coalesce(CAST(sum(l_quantity) FILTER (year(l_shipdate) < 1999) AS BIGINT), 0) AS rw, count(*) FILTER (year(l_shipdate) >= 1999) AS co, coalesce(CAST(sum(l_quantity) FILTER (year(l_shipdate) >= 1999) AS BIGINT), 0) AS cw FROM lineitem GROUP BY l_suppkey) "
    "SELECT l_suppkey, round(cw / co - rw / ro, 9) AS delta_per_unit, CASE WHEN ro < 20 THEN 'reference_too_small' WHEN co < 20 THEN 'current_too_small' WHEN cw * ro > rw * co AND cw / co - rw / ro >= 1.0 AND coalesce((cw / co - rw / ro) / (rw / ro) >= 0.05, cw <> 0) THEN 'increase' ELSE 'stable' END AS outcome FROM x"
)
def per_unit_change(s, d):
    late, q = F.year("l_shipdate") >= 1999, F.col("l_quantity").cast("bigint")
    x = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(~late).alias("ro"), F.coalesce(F.sum(F.when(~late, q)), F.lit(0)).alias("rw"), F.count_if(late).alias("co"), F.coalesce(F.sum(F.when(late, q)), F.lit(0)).alias("cw"))
    out = change.per_unit_change(x, F.col("ro"), F.col("rw"), F.col("co"), F.col("cw"), relative=0.05)
    return out.select("l_suppkey", F.round("delta_per_unit", 9).alias("delta_per_unit"), "outcome")


@query(f"WITH {_EV} SELECT user_id, us, previous_value, event_type FROM (SELECT *, lag(event_type) OVER w AS previous_value, row_number() OVER w AS k FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)) WHERE k > 1 AND event_type <> previous_value")
def state_transition(s, d):
    return series.changes(ev(s, d), ["user_id"], "event_type", "us").select("user_id", "us", "previous_value", "event_type")


@query(f"WITH {_EV} SELECT user_id, us, previous_value, setting FROM (SELECT *, v // 10000 AS setting, lag(v // 10000) OVER w AS previous_value, row_number() OVER w AS k FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)) WHERE k > 1 AND setting <> previous_value")
def metadata_change(s, d):
    e = ev(s, d).withColumn("setting", F.floor(F.col("v") / 10000).cast("bigint"))
    return series.changes(e, ["user_id"], "setting", "us").select("user_id", "us", "previous_value", "setting")


@query(f"WITH {_EV}, p AS (SELECT DISTINCT user_id, day FROM ev) SELECT user_id, day + 1 AS day FROM p WHERE day < (SELECT max(day) FROM ev) AND (user_id, day + 1) NOT IN (SELECT user_id, day FROM p)")
def disappearance(s, d):
    return series.disappeared(ev(s, d), ["user_id"], "day")


@query(f"WITH {_EV}, p AS (SELECT user_id, day FROM ev GROUP BY ALL HAVING max(v) > 8000), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM p) SELECT user_id, min(day) AS first_step, max(day) AS last_step, count(*) AS length FROM g GROUP BY user_id, k HAVING count(*) >= 3")
def consecutive_run(s, d):
    p = ev(s, d).groupBy("user_id", "day").agg(F.max("v").alias("v"))
    return series.runs(p, ["user_id"], "day", F.col("v") > 8000).where("length >= 3")


@query(
    f"WITH {_EV}, p AS (SELECT user_id, day, list_sort(list(DISTINCT event_type)) AS now FROM ev GROUP BY ALL), w AS (SELECT *, lag(now) OVER x AS before, lag(day) OVER x AS pd FROM p WINDOW x AS (PARTITION BY user_id ORDER BY day)), o AS (SELECT user_id, day, list_sort(list_filter(now, lambda t: NOT list_contains(before, t))) AS a, list_sort(list_filter(before, lambda t: NOT list_contains(now, t))) AS r FROM w WHERE pd = day - 1) "
    "SELECT user_id, day, array_to_string(a, ',') AS added, array_to_string(r, ',') AS removed FROM o WHERE len(a) > 0 OR len(r) > 0"
)
def plan_set_change(s, d):
    out = change.set_change(ev(s, d), ["user_id"], "day", "event_type")
    return out.select("user_id", "day", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(
    f"WITH {_EV}, k AS (SELECT day, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'ui' ELSE event_type END AS event_type, count(*) AS n FROM ev WHERE v > 2000 GROUP BY ALL), t AS (SELECT day, sum(n) AS t FROM k GROUP BY day HAVING sum(n) >= 3), z AS (SELECT sum(t) AS total, count(*) AS steps FROM t) SELECT event_type, CAST(sum(n) AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM k JOIN t USING (day), z WHERE steps >= 3 GROUP BY event_type, total HAVING sum(n) * 2 >= total"
)
def wait_concentration(s, d):
    e = ev(s, d).withColumns({"active": F.col("v") > 2000, "event_type": F.when(F.col("event_type").isin("click", "view", "error"), "ui").otherwise(F.col("event_type"))})
    return change.concentration(e, [], "day", "event_type", "active").select("event_type", "n", "total")


# ---- joins, sets, incidents ----------------------------------------------------------------------------------------------


@query("WITH u AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) = 1) SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders JOIN u USING (o_custkey) WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def unique_match_join(s, d):
    o = table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.unique_match(table(s, d, "customer").select("c_custkey"), o, ["c_custkey"], ["o_orderkey"])


@query(f"WITH {_EV}, a AS (SELECT user_id, CAST(sum(v) AS BIGINT) AS v FROM ev WHERE day = 12 GROUP BY 1), b AS (SELECT user_id, CAST(sum(v) AS BIGINT) AS v FROM ev WHERE day = 11 GROUP BY 1) SELECT a.user_id, CASE WHEN b.user_id IS NULL THEN 0 ELSE 1 END AS before_rows, a.v, b.v AS prev_v FROM a LEFT JOIN b USING (user_id)")
def predecessor_join(s, d):
    t = ev(s, d).groupBy("user_id", "day").agg(F.sum("v").alias("v"))
    return joins.predecessor(t, ["user_id"], ["v"], "day", 12, 11)


@query(
    "WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem), s1 AS (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 5000), w AS (SELECT p.*, s_name, 0 AS way FROM p JOIN s1 ON l_suppkey = s_suppkey UNION ALL SELECT p.*, s_name, 1 FROM p JOIN s1 ON l_partkey = s_suppkey) "
    "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, s_name, way FROM w UNION ALL SELECT p.*, NULL, NULL FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.l_orderkey = p.l_orderkey AND w.l_linenumber = p.l_linenumber AND w.l_suppkey = p.l_suppkey AND w.l_partkey = p.l_partkey)"
)
def plan_attribution(s, d):
    p = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct()
    st = table(s, d, "supplier").where("s_acctbal >= 5000").select("s_suppkey", "s_name")
    return joins.best_effort(p, st, [[("l_suppkey", "s_suppkey")], [("l_partkey", "s_suppkey")]], ["s_name"])


@query(f"WITH {_EV}, a AS (SELECT day, CAST(sum(v) AS BIGINT) AS v FROM ev WHERE event_type = 'error' AND v > 15000 GROUP BY day), b AS (SELECT day, CAST(sum(v) AS BIGINT) AS v FROM ev WHERE event_type = 'signup' AND v > 15000 GROUP BY day) SELECT coalesce(a.day, b.day) AS day, a.v AS a, b.v AS b, CASE WHEN b.day IS NULL THEN 'only_a' WHEN a.day IS NULL THEN 'only_b' ELSE 'matched' END AS side FROM a FULL JOIN b ON a.day = b.day")
def track_merge(s, d):
    e = ev(s, d)
    a = e.where("event_type = 'error' AND v > 15000").groupBy("day").agg(F.sum("v").alias("v"))
    b = e.where("event_type = 'signup' AND v > 15000").groupBy("day").agg(F.sum("v").alias("v"))
    return joins.outer_tracks(a, b, [], "day", "v")


@query("SELECT DISTINCT url, CASE WHEN url LIKE '%/de/%' THEN '/de' WHEN url LIKE '%/fr/%' THEN '/fr' END AS mount FROM (SELECT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS url FROM pages)")
def mount_prefix(s, d):
    p = table(s, d, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("url")).distinct()
    mounts = s.sql("SELECT * FROM VALUES ('/de'), ('/fr') AS t(mount)")
    return joins.longest_prefix(p, "url", mounts, "mount", [])


_LOCK = "e AS (SELECT DISTINCT c_custkey AS w, c_custkey // 10 AS b FROM customer WHERE c_custkey <> c_custkey // 10)"


@query(
    f"WITH RECURSIVE {_LOCK}, t AS (SELECT DISTINCT b AS pid, b AS root, 0 AS depth FROM e WHERE b NOT IN (SELECT w FROM e) UNION ALL SELECT e.w, t.root, t.depth + 1 FROM t JOIN e ON t.pid = e.b WHERE t.depth < 32) SELECT pid, root, depth FROM t"
)
def lock_tree(s, d):
    e = table(s, d, "customer").select(F.col("c_custkey").alias("w"), F.floor(F.col("c_custkey") / 10).alias("b"))
    return joins.wait_tree(e, "w", "b").select("pid", "root", "depth")


@query("WITH e AS (SELECT DISTINCT l_linenumber AS ts, l_suppkey AS w, l_partkey % 100 AS b FROM lineitem) SELECT pid, role, count(DISTINCT ts) AS snapshots FROM (SELECT ts, b AS pid, 'lead' AS role FROM e UNION ALL SELECT ts, w, 'downstream' FROM e) GROUP BY ALL")
def lock_roles(s, d):
    e = table(s, d, "lineitem").select(F.col("l_linenumber").alias("ts"), F.col("l_suppkey").alias("w"), (F.col("l_partkey") % 100).alias("b"))
    return incidents.lock_roles(e, [], "ts", "w", "b")


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS devices FROM lineitem GROUP BY l_orderkey")
def device_association(s, d):
    o = table(s, d, "lineitem").select("l_orderkey").distinct()
    return joins.associated(o, table(s, d, "lineitem"), ["l_orderkey"], "l_suppkey", "devices").withColumn("devices", F.array_join("devices", ","))


_MAN = _EV + ", man AS (SELECT day AS segment_id, event_type AS section, min(us) AS min_ts, max(us) AS max_ts, count(*) AS rows FROM ev GROUP BY ALL)"


def _manifest(s, d):
    out = None
    for t in ("click", "error", "purchase", "signup", "view"):
        one = sections.manifest(ev(s, d).where(F.col("event_type") == t).withColumnRenamed("day", "segment_id"), t, "us")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_MAN} SELECT segment_id, section, rows, min_ts, max_ts FROM man WHERE max_ts >= {T0 + 2 * DAY} AND min_ts <= {T0 + 9 * DAY}")
def segment_listing(s, d):
    return frames.segment_listing(_manifest(s, d), T0 + 2 * DAY, T0 + 9 * DAY)


@query(f"WITH {_EV} SELECT event_id, day AS segment_id, 'sealed' AS state FROM ev WHERE day < 20 UNION ALL SELECT event_id, day, 'live' FROM ev WHERE day >= 20")
def sealed_live_snapshot(s, d):
    e = ev(s, d).select("event_id", F.col("day").alias("segment_id"))
    return sections.snapshot(e.where("segment_id < 20").withColumn("state", F.lit("sealed")), e.where("segment_id >= 15").withColumn("state", F.lit("live")))


@query(f"WITH {_EV}, n AS (SELECT DISTINCT day FROM ev) SELECT day AS segment_id, CASE WHEN day < 3 THEN 'removed' WHEN day >= 25 THEN 'added' ELSE 'promoted' END AS change FROM n WHERE day < 3 OR day >= 25 OR day BETWEEN 10 AND 14")
def refresh_delta(s, d):
    days = ev(s, d).select(F.col("day").alias("segment_id")).distinct()
    before = days.where("segment_id < 25").withColumn("state", F.when(F.col("segment_id") < 10, "sealed").otherwise("live"))
    now = days.where("segment_id >= 3").withColumn("state", F.when(F.col("segment_id") < 15, "sealed").otherwise("live"))
    return sections.refresh(before, now)


@query("SELECT l_partkey AS fact, min(l_returnflag) AS flag, count(DISTINCT l_returnflag) > 1 AS conflict, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS evidence FROM lineitem GROUP BY l_partkey")
def merged_facts(s, d):
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("fact"), F.col("l_returnflag").alias("flag"), "l_orderkey")
    return frames.merged_facts(li, "fact", ["flag"], "l_orderkey").withColumn("evidence", F.array_join("evidence", ","))


@query("SELECT sha256(string_agg(k, '' ORDER BY k)) AS digest FROM (SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation)")
def fact_digest(s, d):
    return frames.digest(table(s, d, "nation"), "n_nationkey")


@query(
    "WITH x AS (SELECT l_returnflag AS cluster, l_suppkey, count(*) AS intervals, sum(CAST(l_quantity AS BIGINT)) AS n, sum(50) AS d FROM lineitem GROUP BY ALL) SELECT cluster, 'PG-WAL-009' AS rule, 'amplifier' AS role, '{\"l_suppkey\":' || l_suppkey || '}' AS entity, round(n / d, 9) AS value, intervals FROM x WHERE intervals >= 3 AND n / d >= 0.5"
)
def rule_findings(s, d):
    rule = next(r for r in incidents.RULES if r.id == "PG-WAL-009")
    rows = table(s, d, "lineitem").select(F.col("l_returnflag").alias("cluster"), "l_suppkey", F.lit(0).alias("ts"), F.lit(1_000_000).alias("dt"), F.col("l_quantity").cast("bigint").alias("wal_fpi"), F.lit(50).alias("wal_records"))
    return incidents.findings(rows, rule, ["cluster"], ["l_suppkey"]).withColumn("value", F.round("value", 9))


@query("WITH x AS (SELECT l_returnflag, l_suppkey, count(*) AS intervals, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL), n AS (SELECT *, sha256(CAST(l_suppkey AS VARCHAR)) AS process FROM x WHERE intervals >= 2 AND bytes > 0) SELECT l_returnflag, process, bytes, intervals, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY bytes DESC, process) AS rank FROM n) WHERE rank <= 8")
def io_contenders(s, d):
    li = table(s, d, "lineitem").select("l_returnflag", "l_suppkey", F.col("l_quantity").cast("bigint").alias("r"), F.col("l_linenumber").cast("bigint").alias("w"))
    return incidents.io_contenders(li, ["l_returnflag"], ["l_suppkey"], "r", "w")


_FRAME = _CN + f", p AS (SELECT user_id, day, CAST(sum(v) AS BIGINT) AS t, count(*) AS c FROM ev GROUP BY ALL), q AS (SELECT user_id, day, CAST(sum(t) OVER w AS BIGINT) AS t, CAST(sum(c) OVER w AS BIGINT) AS c FROM p WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)), z AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY day) AS pt, lag(c) OVER (PARTITION BY user_id ORDER BY day) AS pc FROM q), now AS (SELECT user_id, t - pt AS dt, c - pc AS dc FROM z WHERE day = 12)"


@query(f"WITH {_FRAME} SELECT CAST(user_id AS VARCHAR) AS entity, dc AS calls_delta, CAST(dt AS DOUBLE) AS total, round(dt / nullif(dc, 0), 9) AS mean, round(CASE WHEN (SELECT count(*) FROM now WHERE dt IS NULL) = 0 THEN 100.0 * dt / (SELECT sum(dt) FROM now) END, 9) AS time_pct FROM now ORDER BY total DESC NULLS LAST, entity LIMIT 50")
def statements_frame(s, d):
    from tidemark.plans.views import frame

    p = ev(s, d).groupBy("user_id", "day").agg(F.sum("v").alias("t"), F.count("*").alias("c"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = p.select(F.col("user_id").alias("queryid"), F.lit(1).alias("userid"), F.lit(1).alias("dbid"), F.lit(True).alias("toplevel"), (T0 + F.col("day") * DAY).alias("ts"), F.sum("t").over(w).cast("double").alias("total_exec_time"), F.sum("c").over(w).alias("calls"))
    out = frame(rows, "statements", T0 + 12 * DAY, columns=["calls_delta", "total", "mean", "time_pct"], sort="total desc", limit=50)
    return out.withColumns({"mean": F.round("mean", 9), "time_pct": F.round("time_pct", 9)})


@query(f"WITH {_EV} SELECT event_type, day AS bucket, count(*) AS n FROM ev GROUP BY ALL")
def event_count_metric(s, d):
    return metrics.event_counts(ev(s, d), "event_type", F.col("day"))


@query("SELECT o_orderkey, o_orderstatus, NULLIF(o_orderkey % 4, 0) AS gate FROM orders")
def conditional_gate(s, d):
    o = table(s, d, "orders")
    g = joins.gate_select(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey").cast("string")), [("-1", F.lit(-1).cast("bigint"))], F.col("o_orderkey") % 4)
    return o.select("o_orderkey", "o_orderstatus", g.alias("gate"))


# ---- metrics, mixtures, pre-aggregates -------------------------------------------------------------------------------------


@query(f"WITH {_DIFF}, q AS (SELECT user_id, CASE WHEN reason IS NULL THEN n - pn END AS a, CASE WHEN reason IS NULL AND event_type <> 'view' THEN v END AS b, CASE WHEN reason IS NULL THEN us - prev_us END AS t FROM df) SELECT user_id, count(*) AS endpoints, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS aligned, CAST(sum(a) FILTER (b IS NOT NULL) AS BIGINT) AS delta, CAST(sum(b) FILTER (a IS NOT NULL) AS BIGINT) AS b, CAST(sum(t) FILTER (b IS NOT NULL) AS BIGINT) AS dt FROM q GROUP BY user_id")
def aligned_tracks(s, d):
    q = df(s, d).withColumn("b", F.when(F.col("reason").isNull() & (F.col("event_type") != "view"), F.col("v")))
    return metrics.aligned(q, ["user_id"], ["delta", "b"])


@query(f"WITH {_EV} SELECT day, max(us - day * {DAY} - {T0}) FILTER (day * {DAY} + {T0} + {HOUR} <= us) AS wait_us FROM ev GROUP BY day")
def lock_wait_age(s, d):
    e = ev(s, d).withColumns({"since": F.when(F.col("us") >= T0 + F.col("day") * DAY + HOUR, T0 + F.col("day") * DAY)})
    return metrics.wait_age(e, ["day"], "us", "since")


@query(f"WITH {_EV}, l AS (SELECT day, max(v) AS load FROM ev WHERE event_type = 'click' GROUP BY day), c AS (SELECT day, count(DISTINCT user_id) AS cpus FROM ev GROUP BY day) SELECT day, load, cpus, round(load / cpus, 9) AS load_per_cpu FROM l JOIN c USING (day)")
def host_load(s, d):
    e = ev(s, d)
    return metrics.load_per_cpu(e.where("event_type = 'click'"), e, [], "day", "v", "user_id").withColumn("load_per_cpu", F.round("load_per_cpu", 9))


@query(f"WITH {_EV} SELECT event_type, count(*) AS n, greatest(0, max({T0 + 30 * DAY} - us)) AS age_us, max(v) AS xid_age FROM ev GROUP BY event_type")
def prepared_rollup(s, d):
    return metrics.prepared(ev(s, d).withColumn("now", F.lit(T0 + 30 * DAY)), ["event_type"], "now", "us", "v")


@query(f"WITH {_EV} SELECT CASE WHEN v > 20000 THEN 'sealed' ELSE 'live' END AS class, CAST(sum(v) AS BIGINT) AS bytes, count(*) AS files, round(sum(v) / 1e9, 12) AS used FROM ev GROUP BY 1")
def storage_accounting(s, d):
    return metrics.accounting(ev(s, d), F.when(F.col("v") > 20000, "sealed").otherwise("live"), "v", 10**9).withColumn("used", F.round("used", 12))


@query(f"WITH {_EV}, x AS (SELECT event_type, max(us) AS m FROM ev WHERE us <= {T0 + 11 * DAY} GROUP BY event_type) SELECT event_id, user_id FROM ev WHERE us = (SELECT max(m) FROM x) AND user_id <> 0")
def context_at(s, d):
    return metrics.context(ev(s, d), T0 + 11 * DAY, "user_id", "us").select("event_id", "user_id")


_CHURN = (
    _EV + f", p AS (SELECT event_type AS k, user_id AS plan, day, CAST(sum(count(*)) OVER w AS BIGINT) AS calls, CAST(sum(sum(v)) OVER w AS BIGINT) AS t FROM ev GROUP BY event_type, user_id, day WINDOW w AS (PARTITION BY event_type, user_id ORDER BY day ROWS UNBOUNDED PRECEDING)), "
    "q AS (SELECT *, lag(day) OVER w AS b, lead(day) OVER w AS a, lead(calls) OVER w - calls AS dc, lead(t) OVER w - t AS dt FROM p WINDOW w AS (PARTITION BY k, plan ORDER BY day)), s AS (SELECT k, day, lag(day) OVER (PARTITION BY k ORDER BY day) AS pd, lead(day) OVER (PARTITION BY k ORDER BY day) AS nd FROM (SELECT DISTINCT k, day FROM p))"
)


@query(
    f"WITH {_CHURN} SELECT q.k, q.day, arg_max(plan, (dt, plan)) AS plan, arg_max(dc, (dt, plan)) AS calls_delta, arg_max(dt, (dt, plan)) AS time_delta, count(*) AS new_plans FROM q JOIN s ON q.k = s.k AND q.day = s.day WHERE pd = q.day - 1 AND nd = q.day + 1 AND coalesce(b, -1) <> q.day - 1 AND a = q.day + 1 AND dc > 0 AND dt > 0 GROUP BY q.k, q.day"
)
def plan_churn(s, d):
    w = Window.partitionBy("k", "plan").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    p = ev(s, d).groupBy(F.col("event_type").alias("k"), F.col("user_id").alias("plan"), "day").agg(F.count("*").alias("c"), F.sum("v").alias("x"))
    p = p.select("k", "plan", "day", (T0 + F.col("day") * DAY).alias("ts"), F.sum("c").over(w).alias("calls"), F.sum("x").over(w).alias("t"))
    return metrics.plan_churn(p, ["k"], "day", "ts", "plan", "calls", "t", DAY)


_MIX = (
    _EV + ", c AS (SELECT event_type AS cat, day, count(*) AS n FROM ev GROUP BY ALL), s AS (SELECT DISTINCT day FROM c), k AS (SELECT cat, sum(n) AS a FROM c GROUP BY cat), x AS (SELECT s.day, k.cat, a, coalesce((SELECT sum(n) FROM c WHERE c.cat = k.cat AND c.day BETWEEN s.day AND s.day + 2), 0) AS cur FROM s, k), "
    "t AS (SELECT day, sum(cur) AS ct, sum(a - cur) AS rt FROM x GROUP BY day), m AS (SELECT x.day, CAST(ct AS BIGINT) AS current_total, CAST(rt AS BIGINT) AS reference_total, sum(round(abs(cur / ct - (a - cur) / rt), 15)) / 2 AS tv FROM x JOIN t USING (day) GROUP BY x.day, ct, rt)"
)


@query(f"WITH {_MIX} SELECT day, current_total, reference_total, round(tv, 9) AS tv, current_total >= 20 AND reference_total >= 20 AND tv > 0 AND tv >= 0.02 AS shift FROM m")
def plan_mixture(s, d):
    c = ev(s, d).groupBy("event_type", "day").agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    return metrics.mixture_shift(c, ["k"], "day", "event_type", "n", 3, threshold=0.02).drop("k").withColumn("tv", F.round("tv", 9))


@query(f"WITH {_MIX}, z AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM m), g AS (SELECT *, i - row_number() OVER (ORDER BY day) AS q FROM z WHERE tv >= 0.02 AND current_total >= 20 AND reference_total >= 20) SELECT min(day) AS start, max(day) AS \"end\", count(*) AS positions, arg_max(day, (round(tv, 9), -day)) AS peak, round(max(tv), 9) AS severity FROM g GROUP BY q ORDER BY severity DESC, start LIMIT 10")
def plan_signal_episodes(s, d):
    m = plan_mixture(s, d).withColumn("k", F.lit(1))
    return metrics.rank_signals(metrics.signal_episodes(m, ["k"], "day", "shift", "tv"), ["k"], 10).drop("k")


@query(f"WITH {_EV}, g AS (SELECT event_type, day, min(us) AS a, max(us) + 1 AS b FROM ev GROUP BY ALL), i AS (SELECT event_type, greatest(coalesce(lag(b) OVER (PARTITION BY event_type ORDER BY a), {T0}), {T0}) AS gap_from, least(a, {T0 + 30 * DAY}) AS gap_to FROM g UNION ALL SELECT event_type, max(b), {T0 + 30 * DAY} FROM g GROUP BY event_type) SELECT event_type, gap_from, gap_to FROM i WHERE gap_to > gap_from AND (gap_to <> {T0 + 30 * DAY} OR gap_to - gap_from >= {2 * HOUR})")
def shown_gaps(s, d):
    g = ev(s, d).groupBy("event_type", "day").agg(F.min("us").alias("min_ts"), F.max("us").alias("max_ts"))
    return metrics.shown_gaps(g, ["event_type"], T0, T0 + 30 * DAY, 2 * HOUR).select("event_type", "gap_from", "gap_to")


@query(f"WITH {_EV} SELECT 'users' AS view, CAST(user_id AS VARCHAR) AS entity, CAST((us - {T0}) // {10 * DAY} AS BIGINT) AS bucket, max(v) AS value FROM ev GROUP BY ALL")
def merged_segment_cells(s, d):
    cells = metrics.segment_cells(ev(s, d), "day", "users", "user_id", reduce.bucket(F.col("us"), T0, 10 * DAY), "v", "max")
    return metrics.merge_cells(cells, "max")


@query(f"WITH {_EV}, a AS (SELECT us AS sort_ts, event_id, event_type AS instance FROM ev WHERE event_type = 'error'), b AS (SELECT us, event_id, event_type FROM ev WHERE event_type = 'purchase') SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE (sort_ts, event_id, instance) > ({T0 + 4 * DAY}, 0, '') ORDER BY sort_ts, event_id, instance LIMIT 100")
def events_page(s, d):
    e = ev(s, d).select(F.col("us").alias("sort_ts"), "event_id", F.col("event_type").alias("instance"))
    return metrics.events_page([e.where("instance = 'error'"), e.where("instance = 'purchase'")], 100, (T0 + 4 * DAY, 0, ""))


from tidemark.plans import catalog_quality, catalog_values, catalog_views  # noqa: E402, F401  more queries, which need what stands above
