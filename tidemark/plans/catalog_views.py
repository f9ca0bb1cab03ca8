"""Frames of all views and the levels of their cells, over daily snapshots that events stand in for: a user is an entity, the
running sums and counts of its events are counters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.catalog import _EV, DAY, GAPS, T0, ev, query
from tidemark.plans.views import VIEWS, frame, levels

AT = T0 + 12 * DAY
_BASE = _EV + f", base AS (SELECT user_id, day, sum(v) AS t, count(*) AS c, max(v) AS m FROM ev GROUP BY user_id, day), cum AS (SELECT user_id, day, m, {T0} + day * {DAY} AS ts, CAST(sum(t) OVER w AS BIGINT) AS ct, CAST(sum(c) OVER w AS BIGINT) AS cc FROM base WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING))"

#: Columns of each section by expressions that both engines read alike. From day 12 on, counters of every fifth user begin anew.
_RESET = "CASE WHEN user_id % 5 = 0 AND day >= 12 THEN cc ELSE ct END"
ROWS = {
    "activity": "user_id AS pid, 7 AS backend_start, ts, concat('u', user_id) AS usename, CASE WHEN user_id % 3 = 0 THEN 'active' ELSE 'idle' END AS state, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'Lock' END AS wait_event_type, 'tuple' AS wait_event, "
    "CASE WHEN user_id % 7 > 0 THEN ts - m * 1000 END AS query_start, CASE WHEN user_id % 2 = 0 THEN ts - m * 5000 END AS xact_start, ct AS utime, cc AS stime, ct * 3 AS read_bytes, cc * 5 AS write_bytes, concat('select ', m) AS query",
    "statements": f"user_id AS queryid, 1 AS userid, 1 AS dbid, true AS toplevel, ts, {_RESET} AS total_exec_time, cc AS calls, cc * 3 AS rows, cc * 9 AS total_plan_time, ct AS shared_blks_hit, cc * 7 AS shared_blks_read, cc AS local_blks_read, cc * 2 AS temp_blks_written, ct * 8 AS wal_bytes, user_id % 3 > 0 AS track_planning",
    "plans": "user_id AS planid, 1 AS userid, 1 AS dbid, ts, concat('plan ', user_id) AS plan, CASE WHEN user_id % 2 = 0 THEN user_id END AS queryid, user_id + 1000 AS queryid_stat_statements, cc AS calls, ct AS total_time, cc * 2 AS rows, ct AS shared_blks_hit, cc AS shared_blks_read",
    "tables": f"1 AS datid, user_id AS relid, ts, 's' AS schemaname, concat('t', user_id) AS relname, m AS n_dead_tup, cc * 1000 AS n_live_tup, cc AS heap_blks_read, ct AS heap_blks_hit, cc AS idx_blks_read, ct AS idx_blks_hit, {_RESET} AS seq_scan, cc * 40 AS idx_scan, m * 60 AS n_mod_since_analyze, "
    "CASE WHEN user_id % 6 > 0 THEN m * 40 END AS n_ins_since_vacuum, CASE WHEN user_id % 4 > 0 THEN ts - m * 3000000 END AS last_autovacuum, ts - m * 2000000 AS last_autoanalyze",
    "indexes": "1 AS datid, user_id AS indexrelid, ts, concat('i', user_id) AS indexrelname, cc AS idx_scan, ct AS idx_tup_read, ct AS idx_blks_hit, cc * 3 AS idx_blks_read",
    "vacuum": "1 AS datid, user_id AS pid, ts, CASE WHEN user_id % 3 > 0 THEN 's' END AS schemaname, concat('t', user_id) AS relname, m AS heap_blks_scanned, CASE WHEN user_id % 4 > 0 THEN 40000 ELSE 0 END AS heap_blks_total, 'scanning heap' AS phase",
    "processes": "user_id AS pid, 7 AS starttime, ts, ct AS utime, cc AS stime, ct * 10 AS rundelay_ns, 82 + user_id % 2 AS state, user_id % 4 AS policy, ct AS minflt, cc AS majflt, ct * 2 AS rchar, cc AS read_bytes, m * 200 AS rmem_kb, cc AS blkdelay_ticks",
    "locks": "user_id AS pid, ts, concat('u', user_id) AS usename, 'app' AS application_name, CASE WHEN user_id % 3 > 0 THEN 'Lock' END AS wait_event_type, 'relation' AS wait_event, CASE WHEN user_id % 2 = 0 THEN ts - m * 10 ELSE ts + 1 END AS waitstart, m AS depth",
    "events": "user_id AS event_id, ts, CASE WHEN m > 20000 THEN 'error' ELSE 'log' END AS severity, 'other' AS category, m AS duration, concat('m', m) AS message",
}
#: What is asked for, and the SQL of it: d(x) as in the views.
ASKED = {
    "activity": ("usename wait_event_name query_duration_us transaction_duration_us cpu read_bytes_per_second write_bytes_per_second", "query_duration_us desc"),
    "statements": ("calls_delta total mean ms_per_row time_pct plan_time_pct rows_delta hit_pct blks_read temp_written wal", "calls_delta desc"),
    "plans": ("plan query calls_delta mean rows_delta shared_hit shared_read", "mean desc"),
    "tables": ("relation dead_pct io_hit_pct seq_scans idx_scans seq_scan_pct autovacuum_age_seconds autoanalyze_age_seconds", "dead_pct desc"),
    "indexes": ("indexrelname scans rows_per_scan io_hit_pct", "scans asc"),
    "vacuum": ("relation phase progress", "progress desc"),
    "processes": ("cpu cpu_user cpu_system run_delay state_name scheduler_policy minor_faults major_faults logical_read cache_served_read block_delay rmem_kb", "cpu desc"),
    "locks": ("user_application lock wait_age_us depth", "wait_age_us desc"),
    "events": ("severity category duration message", "duration desc"),
}
SQL = {
    "activity": "usename, CASE WHEN wait_event_type IS NULL THEN wait_event ELSE wait_event_type || ':' || wait_event END AS wait_event_name, ts - query_start AS query_duration_us, ts - xact_start AS transaction_duration_us, (d(utime) + d(stime)) / (100.0 * elapsed) AS cpu, d(read_bytes) / elapsed AS read_bytes_per_second, d(write_bytes) / elapsed AS write_bytes_per_second",
    "statements": "d(calls) AS calls_delta, d(total_exec_time) AS total, d(total_exec_time) / nullif(d(calls), 0) AS mean, d(total_exec_time) / nullif(d(rows), 0) AS ms_per_row, CASE WHEN count(*) FILTER (d(total_exec_time) IS NULL) OVER () = 0 THEN 100.0 * d(total_exec_time) / sum(d(total_exec_time)) OVER () END AS time_pct, 100.0 * d(total_plan_time) / nullif(d(total_plan_time) + d(total_exec_time), 0) AS plan_time_pct, "
    "d(rows) AS rows_delta, 100.0 * d(shared_blks_hit) / greatest(d(shared_blks_hit) + d(shared_blks_read), 1) AS hit_pct, d(shared_blks_read) + d(local_blks_read) AS blks_read, d(temp_blks_written) AS temp_written, d(wal_bytes) AS wal",
    "plans": "plan, coalesce(queryid, queryid_stat_statements) AS query, d(calls) AS calls_delta, d(total_time) / CASE WHEN d(calls) > 1 THEN d(calls) ELSE 1 END AS mean, d(rows) AS rows_delta, d(shared_blks_hit) AS shared_hit, d(shared_blks_read) AS shared_read",
    "tables": "schemaname || '.' || relname AS relation, 100.0 * n_dead_tup / (n_live_tup + n_dead_tup) AS dead_pct, 100.0 * (d(heap_blks_hit) + d(idx_blks_hit)) / greatest(d(heap_blks_hit) + d(idx_blks_hit) + d(heap_blks_read) + d(idx_blks_read), 1) AS io_hit_pct, d(seq_scan) AS seq_scans, d(idx_scan) AS idx_scans, 100.0 * d(seq_scan) / nullif(d(seq_scan) + d(idx_scan), 0) AS seq_scan_pct, (ts - last_autovacuum) / 1e6 AS autovacuum_age_seconds, (ts - last_autoanalyze) / 1e6 AS autoanalyze_age_seconds",
    "indexes": "indexrelname, d(idx_scan) AS scans, d(idx_tup_read) / CASE WHEN d(idx_scan) > 1 THEN d(idx_scan) ELSE 1 END AS rows_per_scan, 100.0 * d(idx_blks_hit) / greatest(d(idx_blks_hit) + d(idx_blks_read), 1) AS io_hit_pct",
    "vacuum": "CASE WHEN schemaname IS NULL THEN relname ELSE schemaname || '.' || relname END AS relation, phase, heap_blks_scanned / nullif(heap_blks_total, 0) AS progress",
    "processes": "(d(utime) + d(stime)) / (100.0 * elapsed) AS cpu, d(utime) / (100.0 * elapsed) AS cpu_user, d(stime) / (100.0 * elapsed) AS cpu_system, d(rundelay_ns) / (1e9 * elapsed) AS run_delay, CASE state WHEN 82 THEN 'running' WHEN 83 THEN 'sleeping' END AS state_name, CASE policy WHEN 0 THEN 'SCHED_OTHER' WHEN 1 THEN 'SCHED_FIFO' WHEN 2 THEN 'SCHED_RR' WHEN 3 THEN 'SCHED_BATCH' END AS scheduler_policy, "
    "d(minflt) / elapsed AS minor_faults, d(majflt) / elapsed AS major_faults, d(rchar) / elapsed AS logical_read, CASE WHEN d(rchar) / elapsed - d(read_bytes) / elapsed > 0 THEN d(rchar) / elapsed - d(read_bytes) / elapsed WHEN d(rchar) IS NOT NULL AND d(read_bytes) IS NOT NULL THEN 0 END AS cache_served_read, d(blkdelay_ticks) / (100.0 * elapsed) AS block_delay, rmem_kb",
    "locks": "usename || ' / ' || application_name AS user_application, CASE WHEN wait_event_type IS NULL THEN wait_event ELSE wait_event_type || ':' || wait_event END AS lock, CASE WHEN waitstart <= ts THEN ts - waitstart END AS wait_age_us, depth",
    "events": "severity, category, duration, message",
}


def snapshots(s, d, view: str) -> DataFrame:
    """The rows of a view's section."""
    base = ev(s, d).groupBy("user_id", "day").agg(F.sum("v").alias("t"), F.count("*").alias("c"), F.max("v").alias("m"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    cum = base.select("user_id", "day", "m", (T0 + F.col("day") * DAY).alias("ts"), F.sum("t").over(w).alias("ct"), F.sum("c").over(w).alias("cc"))
    return cum.selectExpr(*re.split(r", (?=(?:[^']*'[^']*')*[^']*$)(?![^(]*\))", ROWS[view]))


def _delta_sql(view: str, selected: str, gap: str = "false") -> tuple[str, str]:
    """The rows with lagged counters, and the expressions over them."""
    v = VIEWS[view]
    counters = sorted(set(re.findall(r"\bd\((\w+)\)", selected)))
    lags = "".join(f", lag({c}) OVER w AS p_{c}" for c in counters)
    rows = f"{_BASE}, r AS (SELECT {ROWS[view]} FROM cum), l AS (SELECT *, lag(ts) OVER w AS prev_ts{lags} FROM r WINDOW w AS (PARTITION BY {', '.join(v.identity)} ORDER BY ts))"
    good = "".join(f", CASE WHEN NOT ({gap}) AND {c} >= p_{c} THEN {c} - p_{c} END AS d_{c}, CASE WHEN prev_ts IS NULL THEN 'missing' WHEN {gap} THEN 'gap' WHEN {c} < p_{c} THEN 'reset' END AS r_{c}" for c in counters)
    return f"WITH {rows}, x AS (SELECT *, (ts - prev_ts) / 1e6 AS elapsed{good} FROM l WHERE ts = {AT})", re.sub(r"\bd\((\w+)\)", r"d_\1", selected)


def _frame_sql(view: str) -> str:
    head, select = _delta_sql(view, SQL[view])
    column, _, way = ASKED[view][1].partition(" ")
    columns = ["entity", *ASKED[view][0].split()]
    return f"{head}, f AS (SELECT CAST({VIEWS[view].entity} AS VARCHAR) AS entity, {select} FROM x) SELECT {', '.join(f'round({c}, 9) AS {c}' if c in _doubles(view) else c for c in columns)} FROM f ORDER BY {column} {way} NULLS LAST, entity LIMIT 40"


def _doubles(view: str) -> set[str]:
    found = re.findall(r"((?:[^,(]|\([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*\))+) AS (\w+)", SQL[view])
    return {name for e, name in found if "/" in e and "' / '" not in e}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" or t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


def _add(view: str) -> None:
    def run(s, d):
        columns, sort = ASKED[view]
        out = frame(snapshots(s, d, view), view, AT, columns=columns.split(), sort=sort, limit=40)
        return out.select("entity", *(F.round(F.col(c).cast("double"), 9).alias(c) if c in _doubles(view) else F.col(c) for c in columns.split()))

    run.__name__ = f"{view}_view"
    query(_frame_sql(view))(run)


for _view in ROWS:
    _add(_view)


@query(f"{_delta_sql('statements', SQL['statements'])[0].replace('FROM cum)', 'FROM cum WHERE user_id % 5 = 1)')}, f AS (SELECT CAST(queryid AS VARCHAR) AS entity, d_calls AS calls_delta, CASE WHEN count(*) FILTER (d_total_exec_time IS NULL) OVER () = 0 THEN 100.0 * d_total_exec_time / sum(d_total_exec_time) OVER () END AS time_pct FROM x) SELECT entity, calls_delta, round(time_pct, 9) AS time_pct FROM f WHERE calls_delta = 4 ORDER BY calls_delta DESC NULLS LAST, entity LIMIT 40")
def database_frame(s, d):
    """One database's statements, searched by text: shares are of the database, not of what the search leaves."""
    rows = snapshots(s, d, "statements").withColumn("dbid", F.col("queryid") % 5)
    out = frame(rows, "statements", AT, columns=["calls_delta", "time_pct"], sort="calls_delta desc", limit=40, database=("dbid", 1), text="calls_delta:4")
    return out.withColumn("time_pct", F.round("time_pct", 9))


#: Cells with levels, as (column, metric, reason before the level, observed, level).
def _level(x: str, warning: str, critical: str) -> str:
    return f"CASE WHEN {x} {critical} THEN 'critical' WHEN {x} {warning} THEN 'warning' ELSE 'ok' END"


def _levels_sql(view: str, cells: list[tuple[str, str, str, str, str]], gap: str = "false") -> str:
    head, _ = _delta_sql(view, " ".join(r + o for _, _, r, o, _ in cells), gap)
    parts = []
    for column, metric, reason, observed, level in cells:
        reason, observed, level = (re.sub(r"\bd\((\w+)\)", r"d_\1", e) for e in (reason, observed, level))
        parts.append(f"SELECT entity, '{column}' AS \"column\", '{metric}' AS metric, CASE WHEN reason IS NULL THEN level END AS level, reason, CASE WHEN reason IS NULL THEN round(observed, 9) END AS observed FROM (SELECT entity, reason, observed, {level} AS level FROM (SELECT *, CAST({VIEWS[view].entity} AS VARCHAR) AS entity, {reason} AS reason, CAST({observed} AS DOUBLE) AS observed FROM x))")
    return f"{head} {' UNION ALL '.join(parts)}"


def _by(x: str, reset: str = "") -> str:
    return f"CASE {reset} WHEN ({x}) IS NULL THEN 'missing' END"


_STATEMENT_LEVELS = [
    ("mean", "pg.statements.mean_time_ms", "CASE WHEN coalesce(r_total_exec_time = 'reset', false) OR coalesce(r_calls = 'reset', false) THEN 'reset' WHEN d(calls) <= 0 AND d(total_exec_time) IS NOT NULL THEN 'not_applicable' WHEN d(total_exec_time) / d(calls) IS NULL THEN 'missing' END", "d(total_exec_time) / d(calls)", _level("observed", ">= 10", ">= 100")),
    ("ms_per_row", "pg.statements.milliseconds_per_row", "CASE WHEN coalesce(r_total_exec_time = 'reset', false) OR coalesce(r_rows = 'reset', false) THEN 'reset' WHEN d(rows) <= 0 AND d(total_exec_time) IS NOT NULL THEN 'not_applicable' WHEN d(total_exec_time) / d(rows) IS NULL THEN 'missing' END", "d(total_exec_time) / d(rows)", _level("observed", ">= 10", ">= 100")),
    ("time_pct", "pg.statements.time_pct", "CASE WHEN r_total_exec_time = 'reset' THEN 'reset' WHEN count(*) FILTER (d(total_exec_time) IS NULL) OVER () > 0 THEN 'not_applicable' END", "100.0 * d(total_exec_time) / sum(d(total_exec_time)) OVER ()", _level("observed", ">= 20", ">= 50")),
    ("plan_time_pct", "pg.statements.plan_time_pct", "CASE WHEN r_total_plan_time = 'reset' THEN 'reset' WHEN NOT track_planning OR coalesce(d(total_plan_time) + d(total_exec_time) <= 0, false) THEN 'not_applicable' WHEN d(total_plan_time) + d(total_exec_time) IS NULL THEN 'missing' END", "100.0 * d(total_plan_time) / (d(total_plan_time) + d(total_exec_time))", _level("observed", ">= 50", ">= 80")),
]
_GAP = " OR ".join(f"({a} < ts AND prev_ts < {b})" for a, b in GAPS)


@query(_levels_sql("statements", _STATEMENT_LEVELS))
def statement_levels(s, d):
    return _rounded(levels(snapshots(s, d, "statements"), "statements", AT))


@query(_levels_sql("statements", _STATEMENT_LEVELS, _GAP))
def statement_levels_with_gaps(s, d):
    """A gap in the record leaves deltas out, and with them all shares of the total."""
    gap = F.lit(False)
    for a, b in GAPS:
        gap = gap | ((F.lit(a) < F.col("ts")) & (F.col("prev_ts") < F.lit(b)))
    return _rounded(levels(snapshots(s, d, "statements"), "statements", AT, breaks=F.when(gap, "gap")))


@query(
    _levels_sql(
        "tables",
        [
            ("dead_pct", "pg.tables.dead_tuple_pct", "CASE WHEN n_dead_tup + n_live_tup <= 0 THEN 'not_applicable' END", "n_dead_tup / (n_dead_tup + n_live_tup)", "CASE WHEN NOT n_dead_tup > 10000 THEN 'ok' WHEN observed >= 0.2 THEN 'critical' WHEN observed >= 0.1 THEN 'warning' ELSE 'ok' END"),
            ("n_dead_tup", "pg.tables.dead_tuples", "NULL", "n_dead_tup", _level("observed", ">= 1000", ">= 100000")),
            ("seq_scan_pct", "pg.tables.sequential_scan_pct", "CASE WHEN coalesce(r_seq_scan = 'reset', false) OR coalesce(r_idx_scan = 'reset', false) THEN 'reset' WHEN d(seq_scan) + d(idx_scan) <= 0 THEN 'not_applicable' WHEN d(seq_scan) + d(idx_scan) IS NULL THEN 'missing' END", "100.0 * d(seq_scan) / (d(seq_scan) + d(idx_scan))", _level("observed", ">= 30", ">= 80")),
            ("n_mod_since_analyze", "pg.tables.modified_since_analyze", "NULL", "n_mod_since_analyze", _level("observed", ">= 100000", ">= 1000000")),
            ("n_ins_since_vacuum", "pg.tables.inserted_since_vacuum", _by("n_ins_since_vacuum"), "n_ins_since_vacuum", _level("observed", ">= 100000", ">= 1000000")),
            ("autovacuum_age_seconds", "pg.tables.autovacuum_age_seconds", "CASE WHEN last_autovacuum IS NULL THEN 'missing' WHEN NOT n_dead_tup > 0 THEN 'not_applicable' END", "(ts / 1e6) - (last_autovacuum / 1e6)", _level("observed", "> 21600", "> 86400")),
            ("autoanalyze_age_seconds", "pg.tables.autoanalyze_age_seconds", "CASE WHEN last_autoanalyze IS NULL THEN 'missing' WHEN NOT n_mod_since_analyze >= 10000 THEN 'not_applicable' END", "(ts / 1e6) - (last_autoanalyze / 1e6)", _level("observed", "> 21600", "> 86400")),
        ],
    ).replace("SELECT entity, reason, observed, CASE WHEN NOT n_dead", "SELECT entity, reason, observed, n_dead_tup, CASE WHEN NOT n_dead")
)
def table_levels(s, d):
    return _rounded(levels(snapshots(s, d, "tables"), "tables", AT))


@query(_levels_sql("processes", [("rmem_kb", "os.process.rss_kib", "CAST(NULL AS VARCHAR)", "rmem_kb", _level("observed", "> 1048576", "> 4194304"))]))
def process_levels(s, d):
    return _rounded(levels(snapshots(s, d, "processes"), "processes", AT))


@query(
    _levels_sql(
        "activity",
        [
            ("query_duration_us", "pg.activity.query_duration_seconds", "CASE WHEN state <> 'active' OR query_start IS NULL THEN 'not_applicable' END", "(ts - query_start) / 1e6", _level("observed", ">= 1", ">= 30")),
            ("transaction_duration_us", "pg.activity.transaction_duration_seconds", "CASE WHEN xact_start IS NULL THEN 'not_applicable' END", "(ts - xact_start) / 1e6", _level("observed", ">= 5", ">= 60")),
        ],
    )
)
def activity_levels(s, d):
    return _rounded(levels(snapshots(s, d, "activity"), "activity", AT))


@query(f"WITH {_EV}, c AS (SELECT user_id, CAST(sum(v) AS BIGINT) AS v FROM ev GROUP BY user_id), f AS (SELECT CAST(user_id AS VARCHAR) AS entity, CASE WHEN user_id % 3 > 0 THEN v END AS v FROM c), o AS (SELECT *, row_number() OVER (ORDER BY v DESC NULLS LAST, entity) AS k FROM f) SELECT entity, v FROM o WHERE k BETWEEN 11 AND 20")
def frame_second_page(s, d):
    """The second page of ten, from a cursor that the first page's last row gives."""
    from tidemark.operators.frames import frame_page, frame_sort

    c = ev(s, d).groupBy("user_id").agg(F.sum("v").alias("v")).select(F.col("user_id").cast("string").alias("entity"), F.when(F.col("user_id") % 3 > 0, F.col("v")).alias("v"))
    last = frame_sort(c, "v", True, "entity", 10).tail(1)
    return frame_page(c, "v", True, "entity", 10, (last[0]["v"], last[0]["entity"])) if last else c
