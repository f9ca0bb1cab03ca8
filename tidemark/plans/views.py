"""Views: which columns a frame shows, how they are derived, joined and sorted.

A derived column is a Spark SQL expression; d(x) in it is the positive delta of counter x to the same identity's row of the
snapshot before (null after a reset, a gap or for a first row; r_x tells which), elapsed is the seconds between the two, hz the clock ticks a
second and snapshot_ts the frame's time. Only the columns of a preset are computed: Catalyst prunes the rest, the
predecessor's window included when no delta is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cells import delta
from tidemark.functions.scalar import PROCESS_STATES, SCHEDULERS, search
from tidemark.functions.thresholds import POLICIES, classify
from tidemark.operators.frames import frame_page, frame_sort
from tidemark.operators.series import ordered


@dataclass(frozen=True)
class View:
    name: str
    section: str
    identity: tuple[str, ...]
    entity: str
    derived: dict[str, str] = field(default_factory=dict)
    presets: dict[str, tuple[str, str]] = field(default_factory=dict)  # columns; sort column and direction

    def columns(self, preset: str) -> list[str]:
        return self.presets[preset][0].split()


def _case(x: str, names: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in names.items()) + " END"


def _share(a: str, b: str) -> str:
    return f"try_divide(100.0 * ({a}), CASE WHEN ({b}) > 0 THEN ({b}) END)"


_rate = "try_divide({}, elapsed)".format
_ticks = "try_divide({}, hz * elapsed)".format

# Derived columns, presets and their sort.
VIEWS = {
    v.name: v
    for v in [
        View(
            "activity", "pg_stat_activity", ("pid", "backend_start"), "pid",
            {
                "wait_event_name": "concat_ws(':', wait_event_type, wait_event)", "query_duration_us": "snapshot_ts - query_start", "transaction_duration_us": "snapshot_ts - xact_start",
                "cpu": _ticks("d(utime) + d(stime)"), "read_bytes_per_second": _rate("d(read_bytes)"), "write_bytes_per_second": _rate("d(write_bytes)"),
            },
            {
                "sessions": ("pid usename datname application_name state query query_duration_us", "query_duration_us desc"),
                "waits": ("pid usename datname wait_event_name query query_duration_us", "query_duration_us desc"),
                "resources": ("pid usename datname cpu query", "cpu desc"),
                "transaction_age": ("pid usename datname state transaction_duration_us", "transaction_duration_us desc"),
                "duration": ("pid usename datname query_id query_duration_us transaction_duration_us query", "query_duration_us desc"),
                "disk_io": ("pid usename datname state wait_event_name query_id read_bytes_per_second write_bytes_per_second", "read_bytes_per_second desc"),
            },
        ),
        View(
            "statements", "pg_stat_statements", ("queryid", "userid", "dbid", "toplevel"), "queryid",
            {
                "calls_delta": "d(calls)", "total": "d(total_exec_time)", "ms_per_row": "try_divide(d(total_exec_time), nullif(d(rows), 0))", "mean": "try_divide(d(total_exec_time), nullif(d(calls), 0))",
                "time_pct": "pct(d(total_exec_time))", "plan_time_pct": _share("d(total_plan_time)", "d(total_plan_time) + d(total_exec_time)"), "rows_delta": "d(rows)",
                "hit_pct": "try_divide(100.0 * d(shared_blks_hit), greatest(d(shared_blks_hit) + d(shared_blks_read), 1))", "blks_read": "d(shared_blks_read) + d(local_blks_read)", "temp_written": "d(temp_blks_written)", "wal": "d(wal_bytes)",
            },
            {
                "time": ("queryid datname usename calls_delta total mean ms_per_row time_pct plan_time_pct rows_delta", "total desc"),
                "latency": ("queryid datname usename calls_delta mean ms_per_row total time_pct rows_delta", "mean desc"),
                "io": ("queryid datname usename calls_delta hit_pct blks_read", "blks_read desc"),
                "wal": ("queryid datname usename calls_delta wal total", "wal desc"),
                "temp": ("queryid datname usename calls_delta temp_written", "temp_written desc"),
                "planning": ("queryid datname usename calls_delta plan_time_pct total mean", "plan_time_pct desc"),
            },
        ),
        View(
            "plans", "pg_store_plans", ("planid", "userid", "dbid"), "planid",
            {"query": "coalesce(queryid, queryid_stat_statements)", "calls_delta": "d(calls)", "mean": "try_divide(d(total_time), greatest(d(calls), 1))", "rows_delta": "d(rows)", "shared_hit": "d(shared_blks_hit)", "shared_read": "d(shared_blks_read)"},
            {
                "time": ("planid plan query calls_delta mean rows_delta", "mean desc"), "io": ("planid plan query calls_delta shared_hit shared_read", "shared_read desc"), "rows": ("planid plan query rows_delta", "rows_delta desc"),
                "regression": ("planid plan query mean", "mean desc"), "change_timeline": ("planid query first_call last_call calls_delta mean", "last_call desc"),
            },
        ),
        View(
            "tables", "pg_stat_user_tables", ("datid", "relid"), "relid",
            {
                "relation": "concat_ws('.', schemaname, relname)", "dead_pct": "try_divide(100.0 * n_dead_tup, greatest(n_live_tup + n_dead_tup, 1))",
                "io_hit_pct": "try_divide(100.0 * (d(heap_blks_hit) + d(idx_blks_hit)), greatest(d(heap_blks_hit) + d(idx_blks_hit) + d(heap_blks_read) + d(idx_blks_read), 1))",
                "seq_scans": "d(seq_scan)", "idx_scans": "d(idx_scan)", "seq_scan_pct": _share("d(seq_scan)", "d(seq_scan) + d(idx_scan)"),
                "autovacuum_age_seconds": "(snapshot_ts - last_autovacuum) / 1000000", "autoanalyze_age_seconds": "(snapshot_ts - last_autoanalyze) / 1000000",
            },
            {
                "health": ("relation dead_pct n_dead_tup seq_scan_pct autovacuum_age_seconds", "dead_pct desc"),
                "vacuum_risk": ("relation dead_pct n_dead_tup n_mod_since_analyze n_ins_since_vacuum last_autovacuum autovacuum_age_seconds", "autovacuum_age_seconds desc"),
                "activity": ("relation seq_scans idx_scans seq_scan_pct dead_pct n_dead_tup", "dead_pct desc"), "writes": ("relation n_mod_since_analyze n_ins_since_vacuum dead_pct", "n_ins_since_vacuum desc"),
                "io": ("relation seq_scans idx_scans seq_scan_pct io_hit_pct", "io_hit_pct desc"), "scan_pattern": ("relation seq_scans idx_scans seq_scan_pct dead_pct", "seq_scan_pct desc"),
                "size": ("relation size_bytes dead_pct xid_age mxid_age", "size_bytes desc"), "xid_mxid": ("relation xid_age mxid_age dead_pct size_bytes", "xid_age desc"),
            },
        ),
        View(
            "indexes", "pg_stat_user_indexes", ("datid", "indexrelid"), "indexrelid",
            {"scans": "d(idx_scan)", "rows_per_scan": "try_divide(d(idx_tup_read), greatest(d(idx_scan), 1))", "io_hit_pct": "try_divide(100.0 * d(idx_blks_hit), greatest(d(idx_blks_hit) + d(idx_blks_read), 1))"},
            {"usage": ("indexrelname relname scans rows_per_scan", "scans desc"), "unused": ("indexrelname relname scans", "scans asc"), "size": ("indexrelname relname size_bytes scans last_idx_scan", "size_bytes desc"), "io": ("indexrelname relname scans io_hit_pct", "io_hit_pct desc")},
        ),
        View(
            "vacuum", "pg_stat_progress_vacuum", ("datid", "pid"), "pid",
            {"relation": "concat_ws('.', schemaname, relname)", "progress": "try_divide(heap_blks_scanned, nullif(heap_blks_total, 0))"},
            {"progress": ("pid relation phase progress num_dead_tuples", "progress desc"), "phase": ("pid relation phase progress", "phase asc"), "dead_tuples": ("pid relation num_dead_tuples progress", "num_dead_tuples desc")},
        ),
        View(
            "processes", "os_process", ("pid", "starttime"), "pid",
            {
                "cpu": _ticks("d(utime) + d(stime)"), "cpu_user": _ticks("d(utime)"), "cpu_system": _ticks("d(stime)"), "run_delay": "try_divide(d(rundelay_ns), 1e9 * elapsed)",
                "state_name": _case("chr(state)", PROCESS_STATES), "scheduler_policy": _case("policy", SCHEDULERS), "voluntary_switches": _rate("d(nvcsw)"), "involuntary_switches": _rate("d(nivcsw)"),
                "minor_faults": _rate("d(minflt)"), "major_faults": _rate("d(majflt)"), "read_syscalls": _rate("d(syscr)"), "write_syscalls": _rate("d(syscw)"), "logical_read": _rate("d(rchar)"), "logical_write": _rate("d(wchar)"),
                "read_bytes_per_second": _rate("d(read_bytes)"), "write_bytes_per_second": _rate("d(write_bytes)"), "cache_served_read": f"greatest({_rate('d(rchar)')} - {_rate('d(read_bytes)')}, 0)", "block_delay": _ticks("d(blkdelay_ticks)"),
            },
            {
                "pressure": ("pid cpu rmem_kb read_bytes_per_second write_bytes_per_second", "cpu desc"), "cpu": ("pid cpu cpu_user cpu_system rmem_kb num_threads cmdline", "cpu desc"), "memory": ("pid rmem_kb cmdline", "rmem_kb desc"),
                "disk_io": ("pid read_bytes_per_second write_bytes_per_second block_delay cmdline", "read_bytes_per_second desc"), "threads": ("pid num_threads cpu rmem_kb cmdline", "num_threads desc"),
            },
        ),
        View(
            "locks", "pg_locks", ("pid",), "pid",
            {"user_application": "concat_ws(' / ', usename, application_name)", "lock": "concat_ws(':', wait_event_type, wait_event)", "wait_age_us": "CASE WHEN waitstart <= snapshot_ts THEN snapshot_ts - waitstart END", "blockers": "array_join(blocked_by, ',')"},
            {
                "tree": ("pid depth root_pid blockers user_application lock granted lock_mode lock_type target wait_age_us query", "wait_age_us desc"),
                "blockers": ("pid root_pid blockers user_application granted lock_mode lock_type target wait_age_us", "wait_age_us desc"),
            },
        ),
        View(
            "events", "pg_log_errors", ("event_id",), "event_id", {},
            {"timeline": ("ts severity category duration", "ts desc"), "errors": ("ts severity category message", "ts desc"), "slow": ("ts category duration message", "duration desc"), "checkpoints": ("ts category duration message", "ts desc")},
        ),
    ]
}


#: Columns of the sections that cells with levels are made of.
_COLUMNS = set("state query_start xact_start total_exec_time total_plan_time rows calls track_planning n_dead_tup n_live_tup seq_scan idx_scan n_mod_since_analyze n_ins_since_vacuum last_autovacuum last_autoanalyze rmem_kb".split())


def _needs(view: View, columns: Sequence[str]) -> dict[str, str]:
    return {c: view.derived[c] for c in columns if c in view.derived}


@dataclass(frozen=True)
class Binding:
    """What a cell is judged by: a policy, its inputs, whether it applies, and the counters whose reset it tells."""

    view: str
    column: str
    metric: str
    inputs: tuple[str, ...]
    applies: str = "true"
    resets: tuple[str, ...] = ()

    def counters(self) -> set[str]:
        return {c for e in (*self.inputs, self.applies) for c in re.findall(r"\bd\((\w+)\)", e)}


# The cells that have levels.
BINDINGS = [
    Binding("activity", "query_duration_us", "pg.activity.query_duration_seconds", ("(snapshot_ts - query_start) / 1e6",), "coalesce(state = 'active', false) AND query_start IS NOT NULL"),
    Binding("activity", "transaction_duration_us", "pg.activity.transaction_duration_seconds", ("(snapshot_ts - xact_start) / 1e6",), "xact_start IS NOT NULL"),
    Binding("statements", "ms_per_row", "pg.statements.milliseconds_per_row", ("try_divide(d(total_exec_time), d(rows))",), "NOT coalesce(d(rows) <= 0 AND d(total_exec_time) IS NOT NULL, false)", ("total_exec_time", "rows")),
    Binding("statements", "mean", "pg.statements.mean_time_ms", ("try_divide(d(total_exec_time), d(calls))",), "NOT coalesce(d(calls) <= 0 AND d(total_exec_time) IS NOT NULL, false)", ("total_exec_time", "calls")),
    Binding("statements", "time_pct", "pg.statements.time_pct", ("pct(d(total_exec_time))",), "pct_known", ("total_exec_time",)),
    Binding("statements", "plan_time_pct", "pg.statements.plan_time_pct", ("try_divide(100.0 * d(total_plan_time), d(total_plan_time) + d(total_exec_time))",), "track_planning AND NOT coalesce(d(total_plan_time) + d(total_exec_time) <= 0, false)", ("total_plan_time",)),
    Binding("tables", "dead_pct", "pg.tables.dead_tuple_pct", ("try_divide(n_dead_tup, n_dead_tup + n_live_tup)", "n_dead_tup"), "NOT coalesce(n_dead_tup + n_live_tup <= 0, false)"),
    Binding("tables", "n_dead_tup", "pg.tables.dead_tuples", ("n_dead_tup",)),
    Binding("tables", "seq_scan_pct", "pg.tables.sequential_scan_pct", ("try_divide(100.0 * d(seq_scan), d(seq_scan) + d(idx_scan))",), "NOT coalesce(d(seq_scan) + d(idx_scan) <= 0, false)", ("seq_scan", "idx_scan")),
    Binding("tables", "n_mod_since_analyze", "pg.tables.modified_since_analyze", ("n_mod_since_analyze",)),
    Binding("tables", "n_ins_since_vacuum", "pg.tables.inserted_since_vacuum", ("n_ins_since_vacuum",)),
    Binding("tables", "autovacuum_age_seconds", "pg.tables.autovacuum_age_seconds", ("last_autovacuum / 1e6", "snapshot_ts / 1e6", "n_dead_tup > 0")),
    Binding("tables", "autoanalyze_age_seconds", "pg.tables.autoanalyze_age_seconds", ("last_autoanalyze / 1e6", "snapshot_ts / 1e6", "n_mod_since_analyze >= 10000")),
    Binding("processes", "rmem_kb", "os.process.rss_kib", ("rmem_kb",)),
]


def _at(rows: DataFrame, view: View, snapshot_ts: int, counters: Sequence[str], hz: Column | None, ts: str, breaks: Column | None) -> DataFrame:
    """The rows of a snapshot with d_<counter>, its reason r_<counter>, snapshot_ts, elapsed and hz."""
    two = rows.where(F.col(ts) <= snapshot_ts)
    w = ordered(view.identity, ts)
    if counters:
        two = two.withColumns({f"_p_{c}": F.lag(c).over(w) for c in counters} | {"prev_ts": F.lag(ts).over(w)})
    now = two.where(F.col(ts) == snapshot_ts)
    if counters:
        pair = F.when(F.col("prev_ts").isNull(), "missing").when(F.col(ts) <= F.col("prev_ts"), "missing")
        pair = pair if breaks is None else pair.otherwise(breaks)
        now = now.withColumns({f"_c_{c}": delta(F.col(c), F.col(f"_p_{c}"), pair) for c in counters})
        now = now.withColumns({f"d_{c}": F.when(F.col(f"_c_{c}.reason").isNull(), F.col(c) - F.col(f"_p_{c}")) for c in counters} | {f"r_{c}": F.col(f"_c_{c}.reason") for c in counters})
    return now.withColumns({"snapshot_ts": F.lit(snapshot_ts), "elapsed": ((F.col(ts) - F.col("prev_ts")) / F.lit(1e6)) if counters else F.lit(None).cast("double"), "hz": hz if hz is not None else F.lit(100.0)})


def _filled(e: str) -> str:
    return re.sub(r"\bd\((\w+)\)", r"d_\1", e)


def _with_share(now: DataFrame, name: str, of: str) -> DataFrame:
    """name: the share of all rows' sum in percent, if none of them is missing; pct_known: whether it is known."""
    totals = now.agg(F.sum(F.expr(of)).alias("_sum"), F.count_if(F.expr(of).isNull()).alias("_missing"))  # one row
    known = (F.col("_missing") == 0) & F.coalesce(F.col("_sum") > 0, F.lit(False))
    return now.crossJoin(F.broadcast(totals)).withColumns({"pct_known": known, name: F.when(known, 100.0 * F.expr(of) / F.col("_sum"))}).drop("_sum", "_missing")


def frame(
    rows: DataFrame, view: View | str, snapshot_ts: int, preset: str | None = None, columns: Sequence[str] = (), database: tuple[str, object] | None = None, text: str = "", label: str | None = None,
    sort: str | None = None, limit: int = 100, hz: Column | None = None, ts: str = "ts", breaks: Column | None = None, cursor: tuple | None = None,
) -> DataFrame:
    """A frame of a view at one snapshot. Shares (pct) are of all rows after the database filter and before the text
    search; a missing delta leaves all without a share. Unknown columns are dropped from a preset. breaks: reset or gap, an
    expression over ts and prev_ts, where a pair of rows isn't to be compared. cursor: (sort value, entity) of the last row of
    the page before."""
    view = VIEWS[view] if isinstance(view, str) else view
    wanted, order = (list(columns), sort) if columns else (view.columns(preset or next(iter(view.presets))), sort or view.presets[preset or next(iter(view.presets))][1])
    if database:
        rows = rows.where(F.col(database[0]) == F.lit(database[1]))
    exprs = _needs(view, wanted)
    counters = sorted({c for e in exprs.values() for c in re.findall(r"\bd\((\w+)\)", e)})
    now = _at(rows, view, snapshot_ts, counters, hz, ts, breaks)
    for name, e in exprs.items():
        if m := re.fullmatch(r"pct\((.*)\)", _filled(e)):
            now = _with_share(now, name, m[1])
        else:
            now = now.withColumn(name, F.expr(_filled(e)))
    shown = [c for c in wanted if c in now.columns]
    if text:
        now = now.where(search({f.name: f.dataType.simpleString() for f in now.schema}, label or view.entity, shown, text))
    out = now.select(F.col(view.entity).cast("string").alias("entity"), *shown)
    column, _, way = (order or f"{shown[0]} asc").partition(" ")
    column = column if column in out.columns else "entity"
    if cursor is not None:
        return frame_page(out, column, way == "desc", "entity", limit, cursor)
    return frame_sort(out, column, way == "desc", "entity", limit)


def levels(rows: DataFrame, view: View | str, snapshot_ts: int, columns: Sequence[str] = (), hz: Column | None = None, ts: str = "ts", breaks: Column | None = None) -> DataFrame:
    """Levels of a view's cells at one snapshot, all that have a policy or those of some columns: entity, column, metric,
    level, reason, observed. The reset of a counter is its own reason, before all others. A column that the rows lack is not
    applicable."""
    view = VIEWS[view] if isinstance(view, str) else view
    bound = [b for b in BINDINGS if b.view == view.name and (not columns or b.column in columns)]
    counters = sorted(c for c in set().union(*(b.counters() | set(b.resets) for b in bound)) if c in rows.columns) if bound else []
    now = _at(rows, view, snapshot_ts, counters, hz, ts, breaks)
    cells = []
    for b in bound:
        needs = {w for e in (*b.inputs, b.applies) for w in re.findall(r"[a-z_]\w*", e)} - {"d", "pct"}
        absent = [w for w in needs if w in _COLUMNS and w not in rows.columns]
        share = re.fullmatch(r"pct\((.*)\)", _filled(b.inputs[0]))
        if share and not absent:
            now = _with_share(now, f"_{b.column}", share[1])
        if absent:
            inputs, applies = [F.lit(None).cast("double")] * len(b.inputs), F.lit(False)
        else:
            inputs, applies = [F.col(f"_{b.column}")] if share else [F.expr(_filled(e)) for e in b.inputs], F.expr(_filled(b.applies))
        reset = F.lit(False)
        for c in b.resets:
            reset = reset | F.coalesce(F.col(f"r_{c}") == "reset", F.lit(False)) if c in counters else reset
        policy = POLICIES[b.metric]
        if policy.shape == "age" and absent:
            inputs[2] = F.lit(True)
        elif policy.shape == "age":
            inputs[2] = F.when(inputs[0].isNull() | inputs[2].isNull(), True).otherwise(inputs[2])  # missing, not out of force
        judged = classify(policy, *inputs)
        reason = F.when(reset, "reset").when(~F.coalesce(applies, F.lit(False)), "not_applicable").otherwise(judged["reason"])
        cells.append(F.struct(F.lit(b.column).alias("column"), F.lit(b.metric).alias("metric"), F.when(reason.isNull(), judged["level"]).alias("level"), reason.alias("reason"), F.when(reason.isNull(), judged["observed"]).alias("observed")))
    out = now.select(F.col(view.entity).cast("string").alias("entity"), F.explode(F.array(*cells)).alias("cell"))
    return out.select("entity", "cell.*")


def entity_detail(rows: DataFrame, view: View | str, entity: dict, frm: int, to: int, buckets: int = 96, ts: str = "ts") -> DataFrame:
    """The history of one entity: the latest row in each of n equal parts."""
    from tidemark.operators.frames import history

    view = VIEWS[view] if isinstance(view, str) else view
    one = rows
    for k, v in entity.items():
        one = one.where(F.col(k).eqNullSafe(F.lit(v)))
    return history(one, view.identity, frm, to, buckets, ts)
