"""Sources outside: PostgreSQL over JDBC, log and text files, JSON out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.events import parse_lines


@dataclass(frozen=True)
class View:
    """A statistics view by server version: the query of the greatest version that isn't above the server's."""

    name: str
    period_s: int
    queries: tuple[tuple[int, str], ...]

    def query(self, version: int) -> str:
        fit = [q for v, q in self.queries if v <= version]
        if not fit:
            raise ValueError(f"{self.name}: no query for version {version}")
        return fit[-1]


_NOW = "(extract(epoch FROM clock_timestamp()) * 1000000)::bigint AS ts"
TOP = 500  # candidates of each axis


def _micros(x: str) -> str:
    return f"(extract(epoch FROM {x}) * 1000000)::bigint"


def _top(source: str, columns: str, axes: tuple[str, ...], key: str, names: str = "", joins: str = "", k: int = TOP) -> str:
    """Rows among the first k by any axis, with the number of all; names are joined to those only."""
    ranks = ", ".join(f"row_number() OVER (ORDER BY {a} DESC NULLS LAST, {key}) AS by_{n}" for n, a in enumerate(axes))
    kept = " OR ".join(f"by_{n} <= {k}" for n in range(len(axes)))
    return f"WITH s AS ({source}), c AS (SELECT s.*, count(*) OVER () AS source_total, {ranks} FROM s) SELECT {_NOW}, {columns}, c.source_total{names} FROM c{joins} WHERE {kept}"


_NAMES = dict(names=", d.datname, r.rolname AS usename", joins=" LEFT JOIN pg_database d ON d.oid = c.dbid LEFT JOIN pg_roles r ON r.oid = c.userid")
_BLOCKS = "shared_blks_hit shared_blks_read shared_blks_dirtied shared_blks_written local_blks_hit local_blks_read local_blks_dirtied local_blks_written temp_blks_read temp_blks_written".split()


def _statements(*more: str, time: str = "total_exec_time") -> str:
    columns = ["queryid", "userid", "dbid", "query", "calls", "rows", *_BLOCKS, *more]
    picked = ", ".join(f"c.{c}" for c in columns) + f", c.{time} AS total_exec_time"
    return _top("SELECT * FROM pg_stat_statements", picked, (f"s.{time}", "s.calls"), "s.queryid", **_NAMES)


_PLANNING = ("plans", "total_plan_time", "min_exec_time", "max_exec_time", "mean_exec_time", "stddev_exec_time", "wal_records", "wal_fpi", "wal_bytes")
_JIT = ("jit_functions", "jit_generation_time", "jit_inlining_time", "jit_optimization_time", "jit_emission_time", "temp_blk_read_time", "temp_blk_write_time")
_SINCE = ("shared_blk_read_time", "shared_blk_write_time", "local_blk_read_time", "local_blk_write_time", "stats_since", "minmax_stats_since")
_STATEMENTS = (
    (100000, _statements("blk_read_time", "blk_write_time", time="total_time")),
    (130000, _statements(*_PLANNING, "blk_read_time", "blk_write_time")),
    (140000, _statements("toplevel", *_PLANNING, "blk_read_time", "blk_write_time")),
    (150000, _statements("toplevel", *_PLANNING, *_JIT, "blk_read_time", "blk_write_time")),
    (170000, _statements("toplevel", *_PLANNING, *_JIT, *_SINCE)),
    (180000, _statements("toplevel", *_PLANNING, *_JIT, *_SINCE, "wal_buffers_full", "parallel_workers_to_launch", "parallel_workers_launched")),
)
_PLANS = "c.planid, c.userid, c.dbid, c.plan, c.calls, c.total_time, c.rows, " + ", ".join(f"c.{b}" for b in _BLOCKS) + ", c.first_call, c.last_call"


def _tables(*more: str) -> str:
    io = "heap_blks_read heap_blks_hit idx_blks_read idx_blks_hit toast_blks_read toast_blks_hit".split()
    counters = "seq_scan seq_tup_read idx_scan idx_tup_fetch n_tup_ins n_tup_upd n_tup_del n_tup_hot_upd n_live_tup n_dead_tup n_mod_since_analyze last_vacuum last_autovacuum last_analyze last_autoanalyze vacuum_count autovacuum_count analyze_count autoanalyze_count".split()
    source = "SELECT (SELECT oid FROM pg_database WHERE datname = current_database()) AS datid, t.*, " + ", ".join(f"i.{c}" for c in io) + (
        ", k.reltuples, pg_total_relation_size(t.relid) AS size_bytes, age(k.relfrozenxid) AS xid_age, mxid_age(k.relminmxid) AS mxid_age"
        " FROM pg_stat_user_tables t JOIN pg_statio_user_tables i USING (relid) JOIN pg_class k ON k.oid = t.relid"
    )
    picked = ", ".join(f"c.{c}" for c in ["datid", "relid", "schemaname", "relname", *counters, *more, *io, "reltuples", "size_bytes", "xid_age", "mxid_age"])
    axes = ("coalesce(s.seq_tup_read, 0) + coalesce(s.idx_tup_fetch, 0)", "s.n_tup_ins + s.n_tup_upd + s.n_tup_del", "s.size_bytes", "s.n_dead_tup", "s.xid_age", "s.mxid_age")
    return _top(source, picked, axes, "s.relid")


def _indexes(*more: str) -> str:
    source = (
        "SELECT (SELECT oid FROM pg_database WHERE datname = current_database()) AS datid, u.*, i.idx_blks_read, i.idx_blks_hit, pg_relation_size(u.indexrelid) AS size_bytes, x.indisunique, x.indisprimary, x.indisvalid"
        " FROM pg_stat_user_indexes u JOIN pg_statio_user_indexes i USING (indexrelid) JOIN pg_index x ON x.indexrelid = u.indexrelid"
    )
    names = "datid relid indexrelid schemaname relname indexrelname idx_scan idx_tup_read idx_tup_fetch idx_blks_read idx_blks_hit size_bytes indisunique indisprimary indisvalid".split()
    return _top(source, ", ".join(f"c.{n}" for n in [*names, *more]), ("s.idx_scan", "s.idx_tup_read", "s.size_bytes"), "s.indexrelid")


_VACUUM = "p.pid, p.datid, p.datname, p.relid, p.phase, p.heap_blks_total, p.heap_blks_scanned, p.heap_blks_vacuumed, p.index_vacuum_count, {}, coalesce(a.backend_type = 'autovacuum worker', false) AS is_autovacuum"
_VACUUM_FROM = "FROM pg_stat_progress_vacuum p LEFT JOIN pg_stat_activity a ON a.pid = p.pid"
_HORIZON = (
    "WITH r AS (SELECT k.oid AS relid, greatest(age(k.relfrozenxid), coalesce(age(o.relfrozenxid), 0)) AS xid_age, greatest(mxid_age(k.relminmxid), coalesce(mxid_age(o.relminmxid), 0)) AS mxid_age FROM pg_class k LEFT JOIN pg_class o ON o.oid = k.reltoastrelid WHERE k.relkind IN ('r', 'm')), "
    f"c AS (SELECT r.*, row_number() OVER (ORDER BY xid_age DESC, relid) AS by_0, row_number() OVER (ORDER BY mxid_age DESC, relid) AS by_1 FROM r) SELECT {_NOW}, relid, xid_age, mxid_age FROM c WHERE by_0 <= {TOP} OR by_1 <= {TOP} "
    f"UNION ALL SELECT {_NOW}, NULL, age(datfrozenxid), mxid_age(datminmxid) FROM pg_database WHERE datname = current_database()"
)
_WAL_AT = "CASE WHEN pg_is_in_recovery() THEN pg_last_wal_replay_lsn() ELSE pg_current_wal_lsn() END"
_REPLICAS = "application_name, pid, usename, client_addr::text AS client_addr, state, sync_state, " + ", ".join(f"pg_wal_lsn_diff({_WAL_AT}, {n}_lsn) AS {n}_bytes" for n in ("sent", "write", "flush", "replay")) + ", " + ", ".join(f"{_micros(f'{n}_lag')} AS {n}_lag_us" for n in ("write", "flush", "replay"))
_LOCKS = (
    "WITH RECURSIVE e AS (SELECT a.pid, unnest(pg_blocking_pids(a.pid)) AS blocker FROM pg_stat_activity a WHERE a.wait_event_type = 'Lock'), "
    "t AS (SELECT DISTINCT e.blocker AS pid, e.blocker AS root_pid, 0 AS depth, ARRAY[e.blocker] AS path FROM e WHERE NOT EXISTS (SELECT 1 FROM e w WHERE w.pid = e.blocker) "
    "UNION ALL SELECT e.pid, t.root_pid, t.depth + 1, t.path || e.pid FROM t JOIN e ON e.blocker = t.pid WHERE NOT e.pid = ANY(t.path) AND t.depth < 32), "
    "one AS (SELECT DISTINCT ON (pid) pid, root_pid, depth FROM t ORDER BY pid, depth, root_pid) "
    "SELECT {now}, one.root_pid, one.depth, a.pid, pg_blocking_pids(a.pid) AS blocked_by, a.datname, a.usename, a.application_name, a.state, a.wait_event_type, a.wait_event, a.query, l.locktype AS lock_type, l.mode AS lock_mode, l.granted, l.relation{more} FROM one JOIN pg_stat_activity a ON a.pid = one.pid LEFT JOIN pg_locks l ON l.pid = a.pid AND NOT l.granted"
)
#: Whether anyone waits for a lock: without that, the tree isn't asked for.
LOCKS_PRECHECK = "SELECT EXISTS (SELECT 1 FROM pg_stat_activity WHERE wait_event_type = 'Lock') AS waiting"
#: What is asked of the server, by the lowest version that a query fits.
VIEWS = {
    v.name: v
    for v in [
        View("pg_stat_activity", 5, ((100000, f"SELECT {_NOW}, pid, datname, usename, application_name, backend_type, state, wait_event_type, wait_event, query, backend_start, xact_start, query_start FROM pg_stat_activity ORDER BY pid"), (140000, f"SELECT {_NOW}, pid, leader_pid, datname, usename, application_name, backend_type, state, wait_event_type, wait_event, query, query_id, backend_start, xact_start, query_start FROM pg_stat_activity ORDER BY pid"))),
        View("pg_stat_database", 10, ((100000, f"SELECT {_NOW}, d.oid AS datid, d.datname, d.datconnlimit, s.* FROM pg_database d LEFT JOIN pg_stat_database s ON s.datid = d.oid"),)),
        View("pg_stat_wal", 10, ((140000, f"SELECT {_NOW}, wal_records, wal_fpi, wal_bytes, wal_buffers_full, wal_write, wal_sync, wal_write_time, wal_sync_time FROM pg_stat_wal"), (180000, f"SELECT {_NOW}, wal_records, wal_fpi, wal_bytes, wal_buffers_full FROM pg_stat_wal"))),
        View("pg_stat_checkpointer", 10, ((100000, f"SELECT {_NOW}, checkpoints_timed, checkpoints_req, checkpoint_write_time AS write_time, checkpoint_sync_time AS sync_time, buffers_checkpoint AS buffers_written FROM pg_stat_bgwriter"), (170000, f"SELECT {_NOW}, num_timed AS checkpoints_timed, num_requested AS checkpoints_req, write_time, sync_time, buffers_written FROM pg_stat_checkpointer"))),
        View("pg_stat_io", 10, ((160000, f"SELECT {_NOW}, backend_type, object, context, reads, read_time, writes, write_time, extends, hits, evictions, reuses, fsyncs FROM pg_stat_io"),)),
        View("pg_stat_archiver", 30, ((100000, f"SELECT {_NOW}, archived_count, failed_count, last_failed_wal FROM pg_stat_archiver"),)),
        View("pg_prepared_xacts", 30, ((100000, f"SELECT {_NOW}, database, count(*) AS n, max(age(transaction)) AS xid_age, greatest(0, extract(epoch FROM now() - min(prepared)) * 1000000)::bigint AS age_us FROM pg_prepared_xacts GROUP BY database"),)),
        View("pg_settings", 3600, ((100000, f"SELECT {_NOW}, name, setting, unit, source FROM pg_settings"),)),
        View("pg_replication_slots", 30, ((130000, f"SELECT {_NOW}, slot_name, slot_type, active, wal_status, safe_wal_size, pg_current_wal_lsn() - restart_lsn AS retained_bytes FROM pg_replication_slots"),)),
        View("pg_stat_statements", 30, _STATEMENTS),
        View("pg_store_plans_ossc", 30, ((100000, _top("SELECT * FROM pg_store_plans", "c.queryid, " + _PLANS, ("s.total_time",), "s.planid", **_NAMES)),)),
        View("pg_store_plans_vadv", 30, ((100000, _top("SELECT * FROM pg_store_plans", "c.queryid_stat_statements, " + _PLANS, ("s.total_time",), "s.planid", **_NAMES)),)),
        View("pg_stat_user_tables", 30, ((100000, _tables()), (130000, _tables("n_ins_since_vacuum")), (160000, _tables("n_ins_since_vacuum", "last_seq_scan", "last_idx_scan", "n_tup_newpage_upd")), (180000, _tables("n_ins_since_vacuum", "last_seq_scan", "last_idx_scan", "n_tup_newpage_upd", "total_vacuum_time", "total_autovacuum_time", "total_analyze_time", "total_autoanalyze_time")))),
        View("pg_stat_user_indexes", 60, ((100000, _indexes()), (160000, _indexes("last_idx_scan")))),
        View("pg_stat_progress_vacuum", 10, ((100000, f"SELECT {_NOW}, {_VACUUM.format('p.max_dead_tuples, p.num_dead_tuples')} {_VACUUM_FROM}"), (170000, f"SELECT {_NOW}, {_VACUUM.format('p.max_dead_tuple_bytes, p.num_dead_item_ids AS num_dead_tuples')} {_VACUUM_FROM}"))),
        View("pg_vacuum_observation", 30, ((100000, f"SELECT {_NOW}, p.pid, p.datid, p.relid, p.phase, {_micros('clock_timestamp() - a.xact_start')} AS elapsed_us, a.xact_start IS NOT NULL AS clock_valid {_VACUUM_FROM}"),)),
        View("replication_instance", 30, ((100000, f"SELECT {_NOW}, pg_is_in_recovery() AS in_recovery, {_micros('clock_timestamp() - pg_last_xact_replay_timestamp()')} AS replay_age_us, count(*) AS replicas, count(*) FILTER (WHERE state = 'streaming') AS streaming, count(*) FILTER (WHERE sync_state IN ('sync', 'quorum')) AS synchronous FROM pg_stat_replication"),)),
        View("pg_stat_replication", 30, ((100000, f"SELECT {_NOW}, {_REPLICAS} FROM pg_stat_replication ORDER BY application_name, pid"),)),
        View("pg_physical_replication", 30, ((100000, f"SELECT {_NOW}, r.pid, r.application_name, s.slot_name, pg_wal_lsn_diff({_WAL_AT}, r.replay_lsn) AS replay_bytes, {_micros('r.replay_lag')} AS replay_lag_us FROM pg_stat_replication r LEFT JOIN LATERAL (SELECT slot_name FROM pg_replication_slots WHERE active_pid = r.pid ORDER BY slot_name LIMIT 1) s ON true"),)),
        View("pg_slot_retention", 30, ((130000, f"SELECT {_NOW}, slot_name, slot_type, active, wal_status, safe_wal_size, pg_wal_lsn_diff({_WAL_AT}, restart_lsn) AS retained_bytes, (SELECT setting::bigint FROM pg_settings WHERE name = 'max_slot_wal_keep_size') AS max_keep_mb FROM pg_replication_slots"),)),
        View("pg_freeze_horizon", 30, ((100000, _HORIZON),)),
        View("pg_locks", 5, ((100000, _LOCKS.format(now=_NOW, more="")), (140000, _LOCKS.format(now=_NOW, more=f", {_micros('l.waitstart')} AS waitstart")))),
        View("reset_metadata", 30, ((100000, f"SELECT {_NOW}, pg_postmaster_start_time() AS postmaster_start, (SELECT stats_reset FROM pg_stat_bgwriter) AS bgwriter_reset, (SELECT stats_reset FROM pg_stat_archiver) AS archiver_reset, (SELECT max(stats_reset) FROM pg_stat_database) AS database_reset"), (140000, f"SELECT {_NOW}, pg_postmaster_start_time() AS postmaster_start, (SELECT stats_reset FROM pg_stat_bgwriter) AS bgwriter_reset, (SELECT stats_reset FROM pg_stat_archiver) AS archiver_reset, (SELECT max(stats_reset) FROM pg_stat_database) AS database_reset, (SELECT stats_reset FROM pg_stat_wal) AS wal_reset, (SELECT stats_reset FROM pg_stat_statements_info) AS statements_reset"))),
        View("instance_metadata", 60, ((100000, f"SELECT {_NOW}, current_setting('server_version_num')::int AS server_version, (SELECT system_identifier FROM pg_control_system()) AS system_identifier, current_setting('cluster_name') AS cluster_name, current_setting('max_connections')::int AS max_connections"),)),
        View("databases", 60, ((100000, "SELECT oid, datname FROM pg_database WHERE datallowconn AND NOT datistemplate ORDER BY datname"),)),
    ]
}


def postgres(spark: SparkSession, url: str, view: str, version: int, properties: dict[str, str] | None = None) -> DataFrame:
    """Rows of a view, by the query that fits the server."""
    reader = spark.read.format("jdbc").option("url", url).option("query", VIEWS[view].query(version)).option("driver", "org.postgresql.Driver")
    return reader.options(**(properties or {})).load()


def candidates(statements: DataFrame, by: tuple[str, ...], k: int, key: str) -> DataFrame:
    """Rows among the first k by any of several axes, with the number of all rows."""
    from tidemark.operators.reduce import top_axes

    total = statements.agg(F.count("*").alias("source_total"))
    return top_axes(statements, [F.col(c).desc_nulls_last() for c in by], key, k).crossJoin(F.broadcast(total))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files with their file and place, parsed."""
    lines = spark.read.option("wholetext", "false").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    return parse_lines(lines)


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same of files as they appear; the checkpoint holds how far they are read."""
    return parse_lines(spark.readStream.text(folder).withColumn("file", F.col("_metadata.file_path")))


def _label(x) -> object:
    """A label's value with what its syntax keeps for itself escaped."""
    return F.replace(F.replace(F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def exposition(df: DataFrame, name: str, labels: tuple[str, ...], value: str, kind: str = "gauge", out: str = "line") -> DataFrame:
    """Samples of a metric as lines of the text exposition format; a null value has no line, and the type line comes once, in
    front if the lines are ordered."""
    pairs = [F.concat(F.lit(f'{c}="'), _label(F.col(c)), F.lit('"')) for c in labels]
    head = F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} ")) if pairs else F.lit(name + " ")
    lines = df.where(F.col(value).isNotNull()).select(F.concat(head, F.col(value).cast("string")).alias(out))
    return df.sparkSession.createDataFrame([(f"# TYPE {name} {kind}",)], f"{out} string").unionByName(lines)


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON object a row; 64-bit and decimal numbers as text, so that no reader rounds them."""
    cols = [F.col(f.name).cast("string").alias(f.name) if f.dataType.simpleString() in ("bigint",) or f.dataType.simpleString().startswith("decimal") else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(out))
