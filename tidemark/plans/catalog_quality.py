"""Queries of quality, entities, metrics of views, plan work and markers, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import entities, frames, incidents, joins, metrics, quality, reduce, series
from tidemark.plans.catalog import _CN, _DIFF, _EV, DAY, HOUR, T0, cn, df, ev, query, table
from tidemark.sources.external import candidates

# ---- gaps, failures, coverage ----------------------------------------------------------------------------------------------

_GAPS = "g AS (SELECT user_id, us + 1 AS gap_from, us + CAST(v AS BIGINT) * 2000000 AS gap_to FROM ev WHERE event_type = 'error')"
_PAIRS = "p AS (SELECT user_id, us, event_id, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS prev_ts FROM ev WHERE event_type <> 'error')"


@query(f"WITH {_EV}, {_GAPS}, {_PAIRS} SELECT event_id, user_id, us, prev_ts, EXISTS (SELECT 1 FROM g WHERE g.user_id = p.user_id AND g.gap_from < p.us AND p.prev_ts < g.gap_to) AS in_gap FROM p")
def gap_table_join(s, d):
    e = ev(s, d)
    gaps = e.where("event_type = 'error'").select("user_id", (F.col("us") + 1).alias("gap_from"), (F.col("us") + F.col("v") * 2_000_000).alias("gap_to"))
    return quality.pairs_in_gaps(e.where("event_type <> 'error'").select("event_id", "user_id", "us"), gaps, ["user_id"], "us")


@query(f"WITH {_EV}, {_PAIRS} SELECT event_id, prev_ts, CASE WHEN prev_ts IS NOT NULL THEN (SELECT count(*) FROM ev f WHERE f.event_type = 'error' AND f.event_id % 3 > 0 AND f.user_id = p.user_id AND f.us > p.prev_ts AND f.us <= p.us) END AS failures FROM p")
def coverage_failures(s, d):
    e = ev(s, d)
    rows = e.where("event_type <> 'error'").select("event_id", "user_id", "us")
    return quality.failures_between(rows, e.where("event_type = 'error'").select("user_id", "us", "event_id"), ["user_id"], F.col("event_id") % 3 > 0, "us").select("event_id", "prev_ts", "failures")


@query(
    f"WITH {_EV}, m AS (SELECT user_id, day, CASE WHEN min(st) = max(st) THEN min(st) ELSE 'conflict' END AS state FROM (SELECT user_id, day, CASE WHEN v > 20000 THEN 'failed' ELSE 'complete' END AS st FROM ev WHERE event_type IN ('view', 'click')) GROUP BY user_id, day) "
    "SELECT e.event_id, coalesce(m.state, 'unknown') AS coverage FROM ev e LEFT JOIN m ON m.user_id = e.user_id AND m.day = e.day WHERE e.event_type = 'purchase'"
)
def coverage_lookup(s, d):
    e = ev(s, d)
    marks = e.where("event_type IN ('view', 'click')").select("user_id", "day", F.when(F.col("v") > 20000, "failed").otherwise("complete").alias("state"))
    return quality.coverage_at(e.where("event_type = 'purchase'").select("event_id", "user_id", "day"), marks, ["user_id"], ts="day").select("event_id", "coverage")


@query(f"WITH {_EV}, m AS (SELECT user_id, day, min(event_type) AS a, max(event_type) AS b FROM ev GROUP BY ALL) SELECT user_id, day, CASE WHEN a = b THEN a END AS event_type, a <> b AS conflict FROM m")
def coverage_markers(s, d):
    return quality.merge_markers(ev(s, d).select("user_id", "day", "event_type"), ["user_id", "day"], ["event_type"])


@query(
    "WITH k AS (SELECT n_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 5 AS kept FROM customer JOIN nation ON c_nationkey = n_nationkey) "
    "SELECT n_nationkey, count(*) FILTER (kept) AS collected, count(*) AS source_total, CASE WHEN count(*) FILTER (kept) < count(*) THEN min(c_acctbal) FILTER (kept) END AS cutoff, CASE WHEN count(*) FILTER (kept) = 0 THEN 'empty' WHEN count(*) FILTER (kept) < count(*) THEN 'cut' ELSE 'complete' END AS state FROM k GROUP BY n_nationkey"
)
def collection_coverage(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return quality.collection_coverage(c.withColumn("k", F.row_number().over(w)), ["n_nationkey"], F.col("k") <= 5, "c_acctbal")


_LOSS = "ls AS (SELECT day, CASE WHEN v > 15000 THEN 'rotated' ELSE 'overflow' END AS reason, CASE WHEN event_id % 9 > 0 THEN v % 10 END AS lost FROM ev WHERE event_type = 'error' AND v % 3 = 0), lr AS (SELECT day, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, CAST(coalesce(sum(lost), 0) AS BIGINT) AS lost, count(*) FILTER (lost IS NULL) = 0 AS bounded FROM ls GROUP BY day)"


@query(f"WITH {_EV}, {_LOSS}, c AS (SELECT day, count(*) AS n FROM ev WHERE event_type <> 'error' GROUP BY day) SELECT c.day, n, reasons, coalesce(lost, 0) AS lost_lower_bound, bounded, reasons IS NULL AS exact FROM c LEFT JOIN lr USING (day)")
def loss_accounting(s, d):
    e = ev(s, d)
    known = e.where("event_type = 'error' AND v % 3 = 0").select("day", F.when(F.col("v") > 15000, "rotated").otherwise("overflow").alias("reason"), F.when(F.col("event_id") % 9 > 0, F.col("v") % 10).alias("lost"))
    counts = e.where("event_type <> 'error'").groupBy("day").agg(F.count("*").alias("n"))
    out = quality.with_losses(counts, quality.losses(known, ["day"], "reason", "lost"), ["day"])
    return out.select("day", "n", F.array_join("loss_reasons", ",").alias("reasons"), "lost_lower_bound", "bounded", "exact")


@query(
    f"WITH {_EV}, b AS (SELECT event_type, event_id, (row_number() OVER w - 1) // 50 AS r, coalesce(sum(v) OVER (PARTITION BY event_type ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 400000 AS q, us FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY us, event_id)), "
    "n AS (SELECT *, CASE WHEN r <> lag(r) OVER w OR q <> lag(q) OVER w THEN 1 ELSE 0 END AS fresh FROM b WINDOW w AS (PARTITION BY event_type ORDER BY us, event_id)), p AS (SELECT event_type, sum(fresh) OVER (PARTITION BY event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS part FROM n) "
    "SELECT event_type, CAST(part AS BIGINT) AS part, count(*) AS rows FROM p GROUP BY ALL"
)
def part_buffers(s, d):
    return quality.part_numbers(ev(s, d), ["event_type"], ["us", "event_id"], F.col("v"), 50, 400_000).groupBy("event_type", "part").agg(F.count("*").alias("rows"))


# ---- entities ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 > 0")
def typed_entity_join(s, d):
    """Customer and supplier numbers overlap: only keys of one domain meet."""
    at = F.lit(T0)
    o = table(s, d, "orders").select("o_orderkey", entities.entity_key("pg", "customer", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")), at).alias("entity"))
    c = table(s, d, "customer").select(F.col("c_name").alias("c_name"), entities.entity_key("pg", "customer", F.col("c_custkey"), at).alias("entity"))
    u = table(s, d, "supplier").select(F.col("s_name").alias("c_name"), entities.entity_key("os", "customer", F.col("s_suppkey"), at).alias("entity"))
    return entities.joined_entities(o, c.unionByName(u)).select("o_orderkey", "c_name")


_LOCAL = "o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 0 THEN o_custkey END AS k, o_orderdate AS t FROM orders)"


@query(f"WITH {_LOCAL}, r AS (SELECT o_custkey AS k, o_orderdate AS t, count(*) AS n, min(o_orderkey) AS other FROM orders GROUP BY ALL) SELECT o.o_orderkey, CASE WHEN n = 1 THEN other END AS other, CASE WHEN o.k IS NULL THEN 'no_key' WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS relation FROM o LEFT JOIN r ON r.k = o.k AND r.t = o.t")
def object_relation_unique(s, d):
    o = table(s, d, "orders")
    left = o.select("o_orderkey", F.when(F.col("o_orderkey") % 6 > 0, F.col("o_custkey")).alias("k"), F.col("o_orderdate").alias("t"))
    right = o.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("other"))
    return entities.object_relation(left, right, ["k", "t"], ["other"], True).select("o_orderkey", "other", "relation")


@query("SELECT o_orderkey, l_linenumber, CASE WHEN o_orderkey % 7 = 0 THEN 'no_key' WHEN l_linenumber IS NULL THEN 'none' WHEN count(*) OVER (PARTITION BY o_orderkey) = 1 THEN 'one' ELSE 'many' END AS relation FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderkey % 7 > 0")
def object_relation_many(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey")).alias("k"))
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    return entities.object_relation(o, li, ["k"], ["l_linenumber"], False).select("o_orderkey", "l_linenumber", "relation")


_PROC = "b AS (SELECT event_id, user_id AS pid, day AS ts FROM ev WHERE event_type = 'click'), pr AS (SELECT day AS ts, user_id AS pid, v // 10000 AS starttime, v FROM ev WHERE event_type <> 'click'), q AS (SELECT ts, pid, count(DISTINCT starttime) AS n, min(starttime) AS starttime FROM pr GROUP BY ALL)"


def _processes(s, d):
    e = ev(s, d)
    backends = e.where("event_type = 'click'").select("event_id", F.col("user_id").alias("pid"), F.col("day").alias("ts"))
    return backends, e.where("event_type <> 'click'").select(F.col("day").alias("ts"), F.col("user_id").alias("pid"), F.floor(F.col("v") / 10000).cast("bigint").alias("starttime"), "v")


@query(f"WITH {_EV}, {_PROC} SELECT event_id, CASE WHEN n = 1 THEN CAST(starttime AS BIGINT) END AS starttime, CASE WHEN n IS NULL THEN 'not_sampled' WHEN n > 1 THEN 'ambiguous' END AS reason FROM b LEFT JOIN q USING (ts, pid)")
def process_candidates(s, d):
    return entities.process_candidates(*_processes(s, d)).select("event_id", "starttime", "reason")


@query(f"WITH {_EV}, {_PROC}, one AS (SELECT ts, pid, starttime, min(v) AS v FROM pr GROUP BY ALL HAVING count(*) = 1) SELECT event_id, one.v AS prev_v FROM b LEFT JOIN q USING (ts, pid) LEFT JOIN one ON q.n = 1 AND one.ts = b.ts - 1 AND one.pid = b.pid AND one.starttime = q.starttime")
def process_predecessor(s, d):
    backends, processes = _processes(s, d)
    steps = processes.select("ts").union(backends.select("ts")).distinct().select(F.col("ts").alias("step"), (F.col("ts") - 1).alias("prev"))
    return entities.process_before(entities.process_candidates(backends, processes), processes, ["v"], steps).select("event_id", "prev_v")


@query(f"WITH {_EV}, r AS (SELECT day AS ts, user_id AS pid, count(*) AS n, min(v) AS lag_bytes FROM ev WHERE event_type = 'signup' GROUP BY ALL) SELECT event_id, CASE WHEN n = 1 THEN lag_bytes END AS lag_bytes FROM ev LEFT JOIN r ON r.ts = ev.day AND r.pid = ev.user_id WHERE event_type = 'click'")
def activity_replicas(s, d):
    """Backends with their row of the replicas of the same snapshot."""
    e = ev(s, d)
    replicas = e.where("event_type = 'signup'").select(F.col("day").alias("ts"), F.col("user_id").alias("pid"), F.col("v").alias("lag_bytes"))
    return joins.unique_match(e.where("event_type = 'click'").select("event_id", F.col("user_id").alias("pid"), F.col("day").alias("ts")), replicas, ["ts", "pid"], ["lag_bytes"]).select("event_id", "lag_bytes")


@query(f"WITH {_EV}, m AS (SELECT day AS ts, user_id AS pid, v // 10000 AS starttime, min('/cg/' || event_id) AS path FROM ev WHERE event_type = 'view' GROUP BY ALL HAVING count(*) = 1) SELECT event_id, path FROM ev LEFT JOIN m ON m.ts = ev.day AND m.pid = ev.user_id AND m.starttime = ev.v // 10000 WHERE event_type = 'click'")
def process_cgroups(s, d):
    """Processes with their control group by pid, start time and snapshot."""
    e = ev(s, d).withColumns({"ts": F.col("day"), "pid": F.col("user_id"), "starttime": F.floor(F.col("v") / 10000)})
    groups = e.where("event_type = 'view'").select("ts", "pid", "starttime", F.concat(F.lit("/cg/"), "event_id").alias("path"))
    return joins.unique_match(e.where("event_type = 'click'").select("event_id", "ts", "pid", "starttime"), groups, ["ts", "pid", "starttime"], ["path"]).select("event_id", "path")


@query(f"WITH {_EV}, h AS (SELECT us, v % 3 * 100 AS hz FROM ev WHERE event_type = 'signup' AND v % 3 > 0) SELECT e.event_id, h.hz FROM (SELECT * FROM ev WHERE event_type = 'error') e ASOF LEFT JOIN h ON e.us >= h.us")
def clock_ticks(s, d):
    """The clock rate in force: unusable readings (0) don't hide the one before. One host: its readings are few."""
    e = ev(s, d).withColumn("host", F.lit(1))
    readings = e.where("event_type = 'signup'").select("host", "us", F.when(F.col("v") % 3 > 0, F.col("v") % 3 * 100).alias("hz"))
    return series.asof(e.where("event_type = 'error'").select("event_id", "host", "us"), readings, ["host"], "hz", "us").select("event_id", "hz")


@query("SELECT p_partkey, p_size, p_retailprice, p_type FROM part WHERE p_size > 5 AND p_retailprice < 1500 AND p_partkey % 4 > 0")
def gauge_triples(s, d):
    p = table(s, d, "part")
    gauges = p.select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size")).alias("p_size"), F.when(F.col("p_retailprice") < 1500, F.col("p_retailprice")).alias("p_retailprice"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_type")).alias("p_type"))
    return metrics.same_instant(gauges, ["p_size", "p_retailprice", "p_type"])


@query(f"WITH {_EV}, g AS (SELECT user_id AS segment, min(us) AS min_ts, max(us) AS max_ts FROM ev GROUP BY user_id) SELECT segment, min_ts, max_ts FROM g WHERE max_ts >= {T0 + 20 * DAY - HOUR} AND min_ts < {T0 + DAY + HOUR}")
def segment_overlap(s, d):
    g = ev(s, d).groupBy(F.col("user_id").alias("segment")).agg(F.min("us").alias("min_ts"), F.max("us").alias("max_ts"))
    return joins.overlaps(g, T0 + 20 * DAY, T0 + DAY, HOUR)


_RULES = ", ".join(f"('{r.id}', '{r.section}')" for r in incidents.RULES)


@query(f"WITH {_EV}, w(rule, section) AS (VALUES {_RULES}), c AS (SELECT DISTINCT user_id AS cluster, CASE event_type WHEN 'click' THEN 'pg_stat_wal' WHEN 'view' THEN 'os_meminfo' WHEN 'error' THEN 'pg_stat_database' ELSE 'other' END AS section FROM ev) SELECT DISTINCT cluster, rule FROM c JOIN w USING (section)")
def rule_dispatch(s, d):
    section = F.when(F.col("event_type") == "click", "pg_stat_wal").when(F.col("event_type") == "view", "os_meminfo").when(F.col("event_type") == "error", "pg_stat_database").otherwise("other")
    return incidents.dispatch(ev(s, d).select(F.col("user_id").alias("cluster"), section.alias("section")), ["cluster"])


@query("SELECT n_regionkey, CAST(max(CASE WHEN n_nationkey < 10 THEN 1 ELSE 0 END) + max(CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END) + max(CASE WHEN n_name LIKE '%Z%' THEN 1 ELSE 0 END) AS INTEGER) AS present, CASE max(CASE WHEN n_nationkey < 10 THEN 1 ELSE 0 END) + max(CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END) + max(CASE WHEN n_name LIKE '%Z%' THEN 1 ELSE 0 END) WHEN 3 THEN 'available' WHEN 0 THEN 'unavailable' ELSE 'partial' END AS state FROM nation GROUP BY n_regionkey")
def lens_availability(s, d):
    n = table(s, d, "nation").select("n_regionkey", (F.col("n_nationkey") < 10).alias("a"), (F.col("n_nationkey") % 5 == 0).alias("b"), F.col("n_name").contains("Z").alias("c"))
    return incidents.availability(n, ["n_regionkey"], ["a", "b", "c"])


@query("WITH c AS (SELECT c_custkey, c_acctbal, c_nationkey, count(*) OVER () AS source_total FROM customer), k AS (SELECT * FROM c ORDER BY c_acctbal DESC, c_custkey LIMIT 30) SELECT c_custkey, source_total, n_name FROM k LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0")
def candidates_join(s, d):
    """Top candidates with the size of the source, joined back to names that some of them lack."""
    top = candidates(table(s, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ("c_acctbal",), 30, "c_custkey")
    names = table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return top.join(names, "c_nationkey", "left").select("c_custkey", "source_total", "n_name")


# ---- metrics of views ----------------------------------------------------------------------------------------------------

_EVENTS = f"WITH {_EV}"


@query("SELECT p_brand, round(max(100.0 * p_size / CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 END), 9) AS value FROM part GROUP BY p_brand HAVING max(CASE WHEN p_partkey % 3 > 0 THEN 1 END) = 1")
def gauge_ratio_nonzero(s, d):
    out = metrics.gauge_ratio(table(s, d, "part"), ["p_brand"], F.col("p_size"), F.col("p_partkey") % 3, "nonzero")
    return out.withColumn("value", F.round("value", 9))


@query(f"{_EVENTS} SELECT CAST((us - {T0}) // {DAY} AS BIGINT) AS bucket, max(v) AS value FROM ev WHERE event_type = 'view' AND v % 2 = 0 GROUP BY 1")
def pressure_series(s, d):
    rows = ev(s, d).select("us", F.when(F.col("event_type") == "view", "io").otherwise("cpu").alias("resource"), F.when(F.col("v") % 2 == 0, F.col("v")).alias("some_avg10"))
    return metrics.pressure(rows, reduce.bucket(F.col("us"), T0, DAY))


@query(f"{_EVENTS}, t AS (SELECT day, v % 13 AS cpu FROM ev WHERE event_type <> 'error' AND day <= 17) SELECT day AS snapshot, count(DISTINCT cpu) AS cpus FROM t WHERE day = (SELECT max(day) FROM t) GROUP BY day")
def host_cpu_count(s, d):
    rows = ev(s, d).select(F.col("day").alias("ts"), (F.col("v") % 13).alias("cpu_id"), F.when(F.col("event_type") == "error", "container").otherwise("host").alias("scope"))
    return metrics.host_cpus(rows, 17)


@query(
    f"{_EVENTS}, l AS (SELECT * FROM ev WHERE user_id % 3 = 0 AND us <= {T0 + 4 * DAY} AND event_type <> 'error'), z AS (SELECT * FROM ev WHERE user_id % 3 > 0 AND us <= {T0 + 4 * DAY}), "
    "a AS (SELECT event_type, max(us) AS us, arg_max(v, us) AS v, 'live' AS source FROM l GROUP BY event_type), b AS (SELECT event_type, max(us) AS us, arg_max(v, us) AS v, 'sealed' AS source FROM z GROUP BY event_type) "
    "SELECT * FROM a UNION ALL SELECT * FROM b WHERE event_type NOT IN (SELECT event_type FROM a)"
)
def first_summary(s, d):
    e = ev(s, d)
    return metrics.first_summary(e.where("user_id % 3 = 0 AND event_type <> 'error'"), e.where("user_id % 3 > 0"), "event_type", T0 + 4 * DAY, ["v"], "us")


@query(
    f"WITH {_DIFF}, k AS (SELECT user_id, us // {5 * DAY} AS part, sum(n - pn) AS delta, sum(us - prev_us) AS dt, count(*) AS pairs, min(prev_us) AS a, max(us) AS b FROM df WHERE reason IS NULL GROUP BY ALL), o AS (SELECT *, coalesce(a < max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over_ FROM k) "
    "SELECT user_id, CAST(sum(delta) AS BIGINT) AS delta, CAST(sum(dt) AS BIGINT) AS dt, CAST(sum(pairs) AS BIGINT) AS pairs, bool_or(over_) AS overlap, CASE WHEN NOT bool_or(over_) THEN round(sum(delta) * 1e6 / sum(dt), 9) END AS rate FROM o GROUP BY user_id"
)
def reduction_merge(s, d):
    parts = metrics.partial_reduction(df(s, d).withColumn("part", F.floor(F.col("us") / (5 * DAY))), ["user_id"], "part", ts="us")
    return metrics.merged_reduction(parts, ["user_id"]).withColumn("rate", F.round("rate", 9))


@query(f"WITH {_DIFF}, q AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 0 ELSE 100 END AS hz, n - pn AS a, (n - pn) * 2 AS b, us - prev_us AS dt, reason FROM df) SELECT user_id, round(max(CASE WHEN hz > 0 THEN (a + b) / CAST(hz AS DOUBLE) / (dt / 1e6) END), 9) AS value FROM q WHERE reason IS NULL GROUP BY user_id")
def tick_rates(s, d):
    from tidemark.functions.scalar import tick_rate

    q = df(s, d).where("reason IS NULL").withColumn("hz", F.when(F.col("user_id") % 4 == 0, 0).otherwise(100))
    return q.groupBy("user_id").agg(F.round(F.max(tick_rate(F.col("delta"), F.col("delta") * 2, F.col("hz"), F.col("dt"))), 9).alias("value"))


@query(f"{_EVENTS} SELECT event_type AS what, CASE WHEN event_type = 'signup' THEN v % 3 + 7 END AS signal, count(*) AS n FROM ev WHERE event_type IN ('click', 'signup', 'view') GROUP BY ALL")
def lifecycle(s, d):
    kinds = F.when(F.col("event_type") == "click", "ready").when(F.col("event_type") == "view", "shutdown").when(F.col("event_type") == "signup", "child_process_crash").otherwise("error_group")
    out = metrics.lifecycle_counts(ev(s, d).select(kinds.alias("kind"), F.when(F.col("event_type") == "signup", F.col("v") % 3 + 7).alias("signal")))
    back = F.when(F.col("what") == "ready", "click").when(F.col("what") == "shutdown", "view").otherwise("signup")
    return out.withColumn("what", back)


# ---- plan work, markers ----------------------------------------------------------------------------------------------------


def _work(s, d):
    by = ev(s, d).groupBy("user_id", "day").agg(F.count("*").alias("calls"), F.sum("v").alias("a"), F.max("v").alias("b"))
    calls = F.when(F.col("user_id") % 5 == 3, F.when(F.col("day") == 10, 0).otherwise(F.col("calls") * 10)).otherwise(F.col("calls") * 10)
    return by.select("user_id", F.col("day").alias("ts"), calls.alias("calls"), F.when((F.col("user_id") % 7 == 2) & (F.col("day") == 12), None).otherwise(F.col("a")).alias("shared_blks_read"), F.when(F.col("day") > 15, F.col("b") * 3).otherwise(0).alias("temp_blks_written"))


_WORK = (
    _EV + ", g AS (SELECT user_id, day, count(*) AS c, CAST(sum(v) AS BIGINT) AS a, max(v) AS b FROM ev GROUP BY ALL), r AS (SELECT user_id, day AS ts, CASE WHEN user_id % 5 = 3 AND day = 10 THEN 0 ELSE c * 10 END AS calls, CASE WHEN user_id % 7 = 2 AND day = 12 THEN NULL ELSE a END AS w1, CASE WHEN day > 15 THEN b * 3 ELSE 0 END AS w2 FROM g), "
    "l AS (SELECT user_id, ts, calls, 'shared_blks_read' AS counter, w1 AS work FROM r UNION ALL SELECT user_id, ts, calls, 'temp_blks_written', w2 FROM r), f AS (SELECT *, coalesce(calls > 0 AND work IS NOT NULL, false) AS good FROM l WHERE NOT coalesce(calls = 0 AND work = 0, false)), "
    "h AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, counter ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seg FROM f), p AS (SELECT * FROM h WHERE good), "
    "j AS (SELECT a.user_id, a.counter, a.seg, a.ts, sum(b.calls) FILTER (b.ts BETWEEN a.ts - 4 AND a.ts) AS cc, sum(b.work) FILTER (b.ts BETWEEN a.ts - 4 AND a.ts) AS cw, coalesce(sum(b.calls) FILTER (b.ts < a.ts - 4 OR b.ts > a.ts), 0) AS rc, coalesce(sum(b.work) FILTER (b.ts < a.ts - 4 OR b.ts > a.ts), 0) AS rw FROM p a JOIN p b ON b.user_id = a.user_id AND b.counter = a.counter AND b.seg = a.seg GROUP BY ALL), "
    "v AS (SELECT *, cw / cc AS cu, CASE WHEN rc > 0 THEN rw / rc END AS ru FROM j), o AS (SELECT *, coalesce(rc >= 20 AND cc >= 20 AND cw * rc > rw * cc AND cu - ru >= 1.0 AND CASE WHEN rw <> 0 THEN (cu - ru) / ru >= 0.5 ELSE cw <> 0 END, false) AS hit, coalesce(least(cu - ru, CASE WHEN rw <> 0 THEN (cu - ru) / ru / 0.5 ELSE CAST('inf' AS DOUBLE) END), 0) AS sev FROM v), "
    "i AS (SELECT *, row_number() OVER (PARTITION BY user_id, counter, seg ORDER BY ts) AS i FROM o), e AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, counter, seg ORDER BY ts) AS k FROM i WHERE hit), "
    "x AS (SELECT user_id, counter, min(ts) AS start, max(ts) AS \"end\", count(*) AS positions, arg_max(ts, (sev, -ts)) AS peak, max(sev) AS severity FROM e GROUP BY user_id, counter, seg, k) "
)


def _signals(s, d):
    return metrics.work_signals(_work(s, d), ["user_id"], "ts", "calls", ["shared_blks_read", "temp_blks_written"], 4)


@query(f"WITH {_WORK} SELECT user_id, counter, start, \"end\", positions, peak, round(severity, 6) AS severity FROM x")
def plan_work_signals(s, d):
    return _signals(s, d).withColumn("severity", F.round("severity", 6))


@query(f"WITH {_WORK} SELECT user_id, counter, start, round(severity, 6) AS severity FROM x ORDER BY severity DESC, user_id, counter, start LIMIT 10")
def plan_signal_rank(s, d):
    return metrics.rank_signals(_signals(s, d), ["user_id", "counter"], 10).select("user_id", "counter", "start", F.round("severity", 6).alias("severity"))


@query(f"WITH {_DIFF} SELECT user_id, 'pg_database_deadlock_delta' AS kind, us, prev_us AS prev_ts, n - pn AS count FROM df WHERE reason IS NULL AND n > pn")
def counter_events(s, d):
    return series.counter_events(df(s, d), ["user_id"], "pg_database_deadlock_delta", "us")


_SPACE = _EV + ", sp AS (SELECT user_id, us, CASE WHEN v % 5 = 0 THEN 0 WHEN v % 7 = 0 THEN NULL ELSE v END AS free FROM ev)"


@query(f"WITH {_SPACE}, p AS (SELECT *, lag(free) OVER (PARTITION BY user_id ORDER BY us) AS previous_value FROM sp WHERE free IS NOT NULL) SELECT user_id, us, previous_value FROM p WHERE free = 0 AND previous_value > 0")
def capacity_zero(s, d):
    rows = ev(s, d).select("user_id", "us", F.when(F.col("v") % 5 == 0, 0).when(F.col("v") % 7 == 0, None).otherwise(F.col("v")).alias("free"))
    return series.fell_to_zero(rows, ["user_id"], "free", "us")


@query(f"WITH {_CN}, p AS (SELECT user_id, us, day // 4 AS epoch, lag(us) OVER w AS prev_ts, lag(day // 4) OVER w AS was FROM cn WINDOW w AS (PARTITION BY user_id ORDER BY us)) SELECT user_id, us, prev_ts, CAST(epoch AS BIGINT) AS epoch FROM p WHERE prev_ts IS NOT NULL AND epoch <> was")
def reset_markers(s, d):
    return series.epoch_changes(cn(s, d).withColumn("epoch", F.floor(F.col("day") / 4).cast("bigint")), ["user_id"], "epoch", "us")


_FIT = f"fit AS (SELECT min(k) * 60000000 AS w FROM range(1, 2000) t(k) WHERE ceil(({T0 + 30 * DAY} - {T0} // (60000000 * k) * (60000000 * k)) / (60000000 * k)) <= 256)"


@query(f"WITH {_EV}, {_FIT} SELECT CAST((us - {T0} // w * w) // w AS BIGINT) AS bucket, count(*) AS n FROM ev, fit WHERE us >= {T0} AND us < {T0 + 30 * DAY} GROUP BY 1")
def adaptive_grid(s, d):
    """At most 256 buckets of whole minutes over 30 days."""
    start, width = reduce.grid(T0, T0 + 30 * DAY)
    e = ev(s, d).where((F.col("us") >= T0) & (F.col("us") < T0 + 30 * DAY))
    return e.groupBy(reduce.bucket(F.col("us"), start, width).alias("bucket")).agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT o_orderkey, string_split(o_orderpriority, '-') AS p FROM orders) SELECT o_orderkey, unnest(range(1, len(p) + 1)) AS ordinal, unnest(p) AS part FROM w")
def with_ordinality(s, d):
    w = table(s, d, "orders").select("o_orderkey", F.split("o_orderpriority", "-").alias("p"))
    return w.select("o_orderkey", F.posexplode("p").alias("k", "part")).select("o_orderkey", (F.col("k") + 1).cast("bigint").alias("ordinal"), "part")


# ---- orders, sets ----------------------------------------------------------------------------------------------------------


@query("WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 > 0), b AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 4 > 0) SELECT o_orderkey, o_orderstatus, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT o_orderkey, o_orderstatus, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def result_differences(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return frames.differences(o.where("o_orderkey % 3 > 0"), o.where("o_orderkey % 4 > 0"))


@query("SELECT o_orderkey, o_custkey, o_orderkey % 100 AS age FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey % 100 > 30")
def sidecar_garbage(s, d):
    from tidemark.sources.sections import orphans

    sidecars = table(s, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 100).alias("age"))
    live = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return orphans(sidecars, live, "o_custkey", "age", 30).select("o_orderkey", "o_custkey", "age")


# ---- rules and branches ----------------------------------------------------------------------------------------------------


def _columns(rule: incidents.Rule) -> list[str]:
    text = " ".join(str(x) for x in (rule.where, rule.grows, *(y for m in rule.measures() for y in m[:2])))
    return sorted(set(re.findall(r"\b[a-z_]\w*\b", text)) - {"greatest", "abs", "dt", "None", "none", "is"})


_FLAGS = {"activity_present", "clock_valid", "mapped", "idle_in_transaction"}
#: Stand-ins for the columns of all rules; what a gate needs to be reached now and then.
_SCALE = {"elapsed_us": 20_000, "xmin_age": 60, "replay_bytes": 3000, "replay_lag_us": 1500, "xact_age_us": 15_000, "throttled_usec": 900, "total_exec_time": 90, "mem_available": 1, "available_bytes": 1, "rx_errs": 1, "total": 2}
_SMALL = {"state": 8, "status": 4, "cpu_id": 2, "max": 3}


def _standin(c: str, k: int) -> str:
    if c in _FLAGS:
        return f"(v + {k}) % 3 > 0"
    if c == "max":
        return "CASE WHEN v % 4 > 0 THEN v % 15000 + 9000 END"
    if c in _SMALL:
        return f"(v + {k}) % {_SMALL[c]} - {1 if c == 'cpu_id' else 0}"
    return f"(v * {2 * k + 3} + {k * 7919}) % 40009 * {_SCALE.get(c, 5)}"


_ALL = sorted({c for r in incidents.RULES for c in _columns(r)})
_RULE_ROWS = ", ".join(f"{_standin(c, k)} AS {c}" for k, c in enumerate(_ALL))
_RULE_HEAD = f"user_id % 9 AS cluster, event_type, event_id AS ts, CASE WHEN event_id % 7 > 0 THEN 60000000 END AS dt, {_RULE_ROWS}"


def _rule_sql(r: incidents.Rule) -> str:
    rows = f"(SELECT * FROM z{f' WHERE {r.where}' if r.where else ''})"
    ms = r.measures()
    if r.kind.startswith("counter"):
        ok = " AND ".join(["dt IS NOT NULL", *(f"({x}) IS NOT NULL" for n, d, _ in ms for x in (n, d) if x)])
        sums = ", ".join(f"sum(CAST({n} AS DOUBLE)) FILTER ({ok}) AS n{k}, sum(CAST({d or 1} AS DOUBLE)) FILTER ({ok}) AS d{k}" for k, (n, d, _) in enumerate(ms))
        inner = f"SELECT cluster, event_type, count(*) FILTER ({ok}) AS intervals, count(*) AS endpoints, sum(dt) FILTER ({ok}) AS t, {sums} FROM {rows} GROUP BY ALL HAVING count(*) FILTER ({ok}) >= {r.least} AND count(*) FILTER ({ok}) * 10 >= count(*) * 7"
        value = {"counter_ratio": "CASE WHEN d{0} > 0 THEN n{0} / d{0} END", "counter_sum": "n{0}", "counter_rate": "n{0} * 1e6 / t"}[r.kind]
    else:
        xs = [f"CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / ({d}) END" if d else f"CAST({n} AS DOUBLE)" for n, d, _ in ms]
        best = ", ".join(f"{'min' if r.below else 'max'}(x{k}) AS n{k}" for k in range(len(xs)))
        grown = f", arg_max({r.grows}, ts) - arg_min({r.grows}, ts) AS grown" if r.grows else ", 1 AS grown"
        inner = f"SELECT * FROM (SELECT cluster, event_type, count(*) AS intervals, {best}{grown} FROM (SELECT *, {', '.join(f'{x} AS x{k}' for k, x in enumerate(xs))} FROM {rows}) WHERE {' OR '.join(f'x{k} IS NOT NULL' for k in range(len(xs)))} GROUP BY ALL) WHERE grown > 0"
        value = "n{0}"
    hit = ", ".join(f"CASE WHEN {value.format(k)} {'<' if r.below else '>='} {g!r} THEN {value.format(k)} END" for k, (_, _, g) in enumerate(ms))
    hit = f"coalesce({hit})" if len(ms) > 1 else hit
    return f"SELECT cluster, '{r.id}' AS rule, '{r.role}' AS role, '{{\"event_type\":\"' || event_type || '\"}}' AS entity, round({hit}, 6) AS value, intervals FROM ({inner}) WHERE ({hit}) IS NOT NULL"


@query(f"WITH {_EV}, z AS (SELECT {_RULE_HEAD} FROM ev), f AS ({' UNION ALL '.join(_rule_sql(r) for r in incidents.RULES)}), o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rule, entity) AS k FROM f) SELECT cluster, rule, role, entity, value, intervals FROM o WHERE k <= 100")
def rule_catalogue(s, d):
    """All rules over counters and gauges, each with its measures and conditions, in one bounded order."""
    rows = ev(s, d).selectExpr(*re.split(r", (?![^(]*\))", _RULE_HEAD))
    sections = {r.section: (rows, ["event_type"]) for r in incidents.RULES}
    return incidents.evaluate(sections, ["cluster"], most=100).select("cluster", "rule", "role", "entity", F.round("value", 6).alias("value"), "intervals")


_STATES = [st for b in incidents.BRANCHES for st in b.states]
_STATE = "CASE event_id % 17 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_STATES)) + " ELSE '23505' END"
_LOG_EVENTS = f"SELECT user_id % 5 AS cluster, day AS ts, CASE WHEN event_type = 'view' THEN 'child_process_crash' ELSE 'error_group' END AS kind, CASE WHEN event_type = 'signup' THEN 'PANIC' ELSE 'ERROR' END AS severity, {_STATE} AS sqlstate, v % 4 AS count, user_id AS pid, CAST(v % 6 + 6 AS INTEGER) AS signal FROM ev"


def _branch_sql(b: incidents.Branch) -> str:
    if b.sigkill is not None:
        test, entity = f"kind = 'child_process_crash' AND signal {'=' if b.sigkill else '<>'} 9", "'{\"at\":' || ts || ',\"pid\":' || pid || ',\"signal\":' || signal || '}'"
    else:
        column, values = ("sqlstate", b.states) if b.states else ("severity", (b.severity,))
        test = f"kind = 'error_group' AND count > 0 AND {column} IN ({', '.join(repr(x) for x in values)})"
        entity = f"'{{\"{column}\":\"' || {column} || '\",\"at\":' || ts || '}}'"
    return f"SELECT DISTINCT cluster, '{b.id}' AS rule, '{b.slug}' AS slug, '{b.cap}' AS cap, {entity} AS entity FROM l WHERE {test}"


@query(f"WITH {_EV}, l AS ({_LOG_EVENTS}) {' UNION ALL '.join(map(_branch_sql, incidents.BRANCHES))}")
def event_branches(s, d):
    e = ev(s, d)
    state = F.expr(_STATE)
    rows = e.select((F.col("user_id") % 5).alias("cluster"), F.col("day").alias("ts"), F.when(F.col("event_type") == "view", "child_process_crash").otherwise("error_group").alias("kind"), F.when(F.col("event_type") == "signup", "PANIC").otherwise("ERROR").alias("severity"), state.alias("sqlstate"), (F.col("v") % 4).alias("count"), F.col("user_id").alias("pid"), (F.col("v") % 6 + 6).cast("int").alias("signal"))
    return incidents.event_findings(rows, ["cluster"])


@query(f"WITH {_EV}, r AS (SELECT DISTINCT user_id % 4 AS cluster, user_id AS pid, day FROM ev WHERE event_type IN ('view', 'click') AND v > 5000), k AS (SELECT *, day - row_number() OVER (PARTITION BY cluster, pid ORDER BY day) AS k FROM r), n AS (SELECT cluster, pid, count(*) AS n FROM k GROUP BY cluster, pid, k), m AS (SELECT cluster, pid, max(n) AS n FROM n WHERE n >= 3 GROUP BY ALL) SELECT cluster, 'PG-SYNC-018' AS rule, 'coincident' AS role, '{{\"pid\":' || pid || ',\"backend_start\":1}}' AS entity, CAST(n AS DOUBLE) AS value, n AS intervals FROM m")
def sync_wait_findings(s, d):
    e = ev(s, d).where("event_type IN ('view', 'click') AND v > 5000").select((F.col("user_id") % 4).alias("cluster"), F.col("user_id").alias("pid"), F.lit(1).alias("backend_start"), F.col("day").alias("step"), F.lit("SyncRep").alias("wait_event")).distinct()
    return incidents.sync_findings(e, ["cluster"])


@query(f"WITH {_EV}, e AS (SELECT DISTINCT user_id % 4 AS cluster, day, user_id AS pid, v % 20 AS blocker FROM ev WHERE event_type = 'error'), r AS (SELECT cluster, blocker AS pid, 'lead' AS role, count(DISTINCT day) AS n FROM e GROUP BY ALL UNION ALL SELECT cluster, pid, 'downstream', count(DISTINCT day) FROM e GROUP BY ALL) SELECT cluster, 'PG-LOCK-012' AS rule, role, '{{\"pid\":' || pid || '}}' AS entity, CAST(n AS DOUBLE) AS value, n AS intervals FROM r")
def lock_wait_findings(s, d):
    e = ev(s, d).where("event_type = 'error'").select((F.col("user_id") % 4).alias("cluster"), F.col("day").alias("ts"), F.col("user_id").cast("bigint").alias("pid"), (F.col("v") % 20).alias("blocker"))
    return incidents.lock_findings(e, ["cluster"])


@query(f"WITH {_EV}, a AS (SELECT user_id % 4 AS cluster, day, event_type, count(*) AS n FROM ev WHERE v % 3 > 0 AND (event_type = 'view' OR v % 8 = 0) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY cluster, day) AS t FROM a), k AS (SELECT * FROM t WHERE t >= 3), g AS (SELECT cluster, sum(n) AS total, count(DISTINCT day) AS steps FROM k GROUP BY cluster), c AS (SELECT cluster, event_type, sum(n) AS n FROM k GROUP BY ALL) SELECT cluster, 'PG-WAIT-019' AS rule, 'coincident' AS role, '{{\"wait_event_type\":\"' || event_type || '\"}}' AS entity, round(CAST(n AS DOUBLE) / total, 9) AS value, steps AS intervals FROM c JOIN g USING (cluster) WHERE steps >= 3 AND n * 2 >= total")
def wait_class_findings(s, d):
    rows = ev(s, d).where("v % 3 > 0").select((F.col("user_id") % 4).alias("cluster"), F.col("day").alias("step"), F.col("event_type").alias("wait_event_type"), ((F.col("event_type") == "view") | (F.col("v") % 8 == 0)).alias("active"))
    return incidents.wait_findings(rows, ["cluster"]).withColumn("value", F.round("value", 9))


@query(f"WITH {_EV}, p AS (SELECT DISTINCT user_id % 3 AS k, day AS step, {T0} + day * 60000000 AS ts, v % 9 AS planid FROM ev WHERE event_type = 'click'), q AS (SELECT *, (step + planid) * 10 AS calls, step * (planid + 1) AS total_time FROM p), st AS (SELECT DISTINCT k, step FROM q), x AS (SELECT q.*, (SELECT count(*) FROM q b WHERE b.k = q.k AND b.planid = q.planid AND b.step = q.step - 1) AS was, c.calls - q.calls AS dc, c.total_time - q.total_time AS dt FROM q JOIN q c ON c.k = q.k AND c.planid = q.planid AND c.step = q.step + 1 JOIN st s0 ON s0.k = q.k AND s0.step = q.step - 1), n AS (SELECT * FROM x WHERE was = 0 AND dc > 0 AND dt > 0), o AS (SELECT *, row_number() OVER (PARTITION BY k, step ORDER BY dt DESC, planid DESC) AS r FROM n) SELECT k AS cluster, 'PG-PLAN-002' AS rule, 'coincident' AS role, '{{\"planid\":' || planid || ',\"step\":' || step || '}}' AS entity, CAST(dt AS DOUBLE) AS value, CAST(3 AS BIGINT) AS intervals FROM o WHERE r = 1")
def plan_churn_rule(s, d):
    p = ev(s, d).where("event_type = 'click'").select((F.col("user_id") % 3).alias("cluster"), F.col("day").alias("step"), (T0 + F.col("day") * 60_000_000).alias("ts"), (F.col("v") % 9).alias("planid")).distinct()
    p = p.withColumns({"calls": (F.col("step") + F.col("planid")) * 10, "total_time": F.col("step") * (F.col("planid") + 1)})
    return incidents.plan_churn_findings(p, ["cluster"])


@query(f"WITH {_EV}, x AS (SELECT user_id % 4 AS cluster, user_id AS pid, 7 AS starttime, count(*) AS intervals, CAST(sum(v + v % 100) AS BIGINT) AS bytes FROM ev GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT *, sha256(pid || '|' || starttime) AS process FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY bytes DESC, process) AS r FROM k) SELECT cluster, 'OS-IOWHO-026' AS rule, 'coincident' AS role, '{{\"process\":\"' || process || '\"}}' AS entity, CAST(bytes AS DOUBLE) AS value, intervals FROM o WHERE r <= 8")
def contender_findings(s, d):
    rows = ev(s, d).select((F.col("user_id") % 4).alias("cluster"), F.col("user_id").alias("pid"), F.lit(7).alias("starttime"), F.col("v").alias("read_bytes"), (F.col("v") % 100).alias("write_bytes"))
    return incidents.contender_findings(rows, ["cluster"])
