"""Incidents: clusters of episodes, and rules that attach findings to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import ratio


def clusters(episodes: DataFrame, node: Sequence[str], epsilon: int, most_span: int, start: str = "start", end: str = "end", key: str = "episode", listed: bool = True) -> DataFrame:
    """Episodes of a node in order of (start, end, key): one joins the open cluster if it begins at most epsilon after its
    end and the merged span is at most most_span, else it opens the next: node, start, end, members (their keys in that order;
    not listed: n_members, their number), split_from_previous. An episode without an end, or with one before its start, ends
    where it starts; one without a start is a cluster of its own; one longer than most_span raises.

    Two episodes more than epsilon apart from all before are never in one cluster, so a node's timeline is first cut there
    into chains. Starts less than epsilon apart are never cut, so slots of that length, with their first start and last end,
    tell the chains, and a window runs over slots and not over episodes. A chain no longer than most_span is one cluster. In a
    longer one the greedy rule has state: its distinct (start, end), which never part, are numbered as a stream in their order."""
    s, e = F.col(start).cast("bigint"), F.greatest(start, end).cast("bigint")
    e = F.when(e - s > most_span, F.raise_error(F.lit("an episode is longer than a cluster may be")).cast("bigint")).otherwise(e)
    rows = episodes.select(*node, s.alias("_s"), e.alias("_e"), F.col(key).alias("_k"))
    what = [F.count("*").alias("_n"), *([F.transform(F.array_sort(F.collect_list(F.struct("_k"))), lambda x: x["_k"]).alias("_m")] if listed else [])]
    items = rows.where("_s IS NOT NULL").groupBy(*node, "_s", "_e").agg(*what).withColumn("_b", F.col("_s") - F.pmod("_s", F.lit(max(epsilon, 1)).cast("bigint")))

    slots = items.groupBy(*node, "_b").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n"))
    w = Window.partitionBy(*node).orderBy("_b")
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.withColumn("_cut", F.when(reach.isNull() | (F.col("_s") - reach > epsilon), 1).otherwise(0))
    slots = slots.withColumn("_chain", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*node, "_chain")
    slots = slots.withColumn("_long", F.max("_e").over(whole) - F.min("_s").over(whole) > most_span)

    named = slots.select(*(F.col(c).alias(f"_node{k}") for k, c in enumerate(node)), F.col("_b").alias("_slot"), "_chain", "_long")
    same = F.col("_b") == F.col("_slot")
    for k, c in enumerate(node):
        same = same & F.col(c).eqNullSafe(F.col(f"_node{k}"))
    parts = ["_s", "_e", "_n", *(["_m"] if listed else [])]
    placed = lambda test: items.join(named.where(test), same).select(*node, "_chain", *parts)
    short = placed("NOT _long") if listed else slots.where("NOT _long").select(*node, "_chain", *parts)
    found = short.withColumns({"_c": F.lit(0).cast("bigint"), "_j": F.lit(0)}).unionByName(_numbered(placed("_long"), [*node, "_chain"], epsilon, most_span))
    members = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_e", "_m"))), lambda x: x["_m"])).alias("members") if listed else F.sum("_n").alias("n_members")
    out = found.groupBy(*node, "_chain", "_c").agg(F.min("_s").alias("start"), F.max("_e").alias("end"), members, F.max("_j").alias("split_from_previous"))
    alone = rows.where("_s IS NULL").select(*node, F.col("_s").alias("start"), F.col("_e").alias("end"), F.array("_k").alias("members") if listed else F.lit(1).cast("bigint").alias("n_members"), F.lit(0).alias("split_from_previous"))
    return out.drop("_chain", "_c").unionByName(alone)


def _numbered(items: DataFrame, chain: Sequence[str], epsilon: int, most_span: int) -> DataFrame:
    """Adds _c, the number of an item's cluster in its chain, and _j, whether the cluster begins near the end of that before."""

    names = items.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = reached = c = j = 0
        for batch in batches:
            cs, js = [], []
            for first, s, e in zip(*(batch.column(x).to_pylist() for x in ("_first", "_s", "_e")), strict=True):
                near = not first and s - reached <= epsilon
                if near and max(reached, e) - opened <= most_span:
                    reached = max(reached, e)
                else:
                    opened, reached, c, j = s, e, 0 if first else c + 1, int(near)
                cs.append(c)
                js.append(j)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(cs, pa.int64()), pa.array(js, pa.int32())], [*names, "_c", "_j"])

    shape = T.StructType([*items.schema.fields, T.StructField("_c", T.LongType()), T.StructField("_j", T.IntegerType())])
    w = Window.partitionBy(*chain).orderBy("_s", "_e")
    return items.withColumn("_first", F.row_number().over(w) == 1).mapInArrow(number, shape)


@dataclass(frozen=True)
class Rule:
    """A finding where a measure of a cluster's rows reaches a gate. kind: counter_ratio (sum num / sum den), counter_sum
    (sum num), counter_rate (sum num a second), gauge_max, gauge_min, gauge_share (max num / den; min with below). also: other
    measures of the same kind, any of which will do. where: rows that qualify. grows: a gauge that must have grown over the
    cluster. least: aligned intervals that a counter needs."""

    id: str
    section: str
    kind: str
    num: str
    den: str | None
    gate: float
    role: str = "coincident"
    below: bool = False
    also: tuple[tuple[str, str | None, float], ...] = ()
    where: str | None = None
    grows: str | None = None
    least: int = 3

    def measures(self) -> list[tuple[str, str | None, float]]:
        return [(self.num, self.den, self.gate), *self.also]


_MIB = 1 << 20
_BLOCKS = "shared_blks_hit + shared_blks_read + shared_blks_dirtied + shared_blks_written + local_blks_hit + local_blks_read + local_blks_dirtied + local_blks_written + temp_blks_read + temp_blks_written"
# Rules over counters and gauges.
RULES = [
    Rule("PG-QRY-001", "pg_stat_statements", "counter_ratio", "total_exec_time", "calls", 50.0, "amplifier", also=((_BLOCKS, "calls", 1000.0),)),
    Rule("PG-TEMP-003", "pg_stat_database", "counter_sum", "temp_bytes", None, 1.0, "amplifier", where="temp_files IS NOT NULL"),
    Rule("PG-ANALYZE-004", "pg_stat_user_tables", "gauge_share", "n_mod_since_analyze", "greatest(abs(reltuples), 1)", 0.2),
    Rule("PG-VACUUM-005", "pg_vacuum_observation", "gauge_max", "elapsed_us", None, 300e6, where="activity_present AND clock_valid"),
    Rule("PG-FREEZE-006", "pg_freeze_horizon", "gauge_share", "xid_age", "xid_limit", 0.9, also=(("mxid_age", "mxid_limit", 0.9),)),
    Rule("PG-HOT-007", "pg_stat_user_tables", "counter_ratio", "n_tup_upd - n_tup_hot_upd", "n_tup_upd", 0.5, "amplifier"),
    Rule("PG-CHKPT-008", "pg_stat_checkpointer", "counter_ratio", "checkpoints_req", "checkpoints_req + checkpoints_timed", 0.5, "amplifier"),
    Rule("PG-WAL-009", "pg_stat_wal", "counter_ratio", "wal_fpi", "wal_records", 0.5, "amplifier"),
    Rule("PG-CACHE-010", "pg_stat_database", "counter_ratio", "blks_read", "blks_read + blks_hit", 0.2, "amplifier"),
    Rule("PG-IO-011", "pg_stat_io", "counter_ratio", "read_time", "reads", 1.0, "amplifier"),
    Rule("PG-HORIZON-013", "pg_stat_activity", "gauge_max", "xmin_age", None, 1e6, "amplifier", where="idle_in_transaction OR xact_age_us >= 300000000"),
    Rule("PG-CONN-014", "pg_stat_database", "gauge_share", "numbackends", "datconnlimit", 0.8, where="datconnlimit > 0"),
    Rule("PG-REPL-015", "pg_physical_replication", "gauge_max", "replay_bytes", None, 64.0 * _MIB, also=(("replay_lag_us", None, 30e6),), where="state BETWEEN 1 AND 5"),
    Rule("PG-SLOT-016", "pg_slot_retention", "gauge_share", "retained_bytes", "retained_bytes + safe_wal_size", 0.8, also=(("retained_bytes", "max_keep_bytes", 0.8),), where="status BETWEEN 1 AND 2", grows="retained_bytes"),
    Rule("PG-ARCH-017", "pg_stat_archiver", "counter_sum", "failed_count", None, 1.0, least=1),
    Rule("OS-CPU-020", "os_cpu", "counter_ratio", "busy", "total", 0.8, also=(("steal", "total", 0.05),), where="cpu_id = -1"),
    Rule("OS-CGRP-021", "cgroup_cpu", "counter_rate", "throttled_usec", None, 100_000.0),
    Rule("OS-MEM-022", "os_meminfo", "gauge_share", "mem_available", "mem_total", 0.05, below=True),
    Rule("OS-CGMEM-023", "cgroup_memory", "gauge_share", "current", "max", 0.9, where="mapped AND max IS NOT NULL"),
    Rule("OS-BLOCK-024", "os_diskstats", "counter_ratio", "io_ms", "ios", 20.0, also=(("weighted_ms * 1000.0", "dt", 1.0),)),
    Rule("OS-WB-025", "os_meminfo", "gauge_share", "dirty + writeback", "mem_total", 0.1),
    Rule("OS-FS-027", "os_mountinfo", "gauge_share", "available_bytes", "total_bytes", 0.1, below=True, where="mapped"),
    Rule("OS-NET-028", "os_netdev", "counter_ratio", "rx_errs", "rx_packets", 0.01),
]


def findings(rows: DataFrame, rule: Rule, keys: Sequence[str], entity: Sequence[str], ts: str = "ts") -> DataFrame:
    """Findings of one rule: keys (a cluster), rule, role, entity, value, intervals. Rows are inside clusters already. A
    counter's columns are deltas, dt its microseconds, null where a pair isn't valid; it needs `least` aligned intervals
    that are 70 % of the endpoints. Of gauges the extreme row counts, the first on ties. value: that of the first measure that
    reaches its gate."""
    rows = rows.where(rule.where) if rule.where else rows
    nums = [F.expr(n).cast("double") for n, _, _ in rule.measures()]
    dens = [F.expr(d).cast("double") if d else F.lit(1.0) for _, d, _ in rule.measures()]
    if rule.kind.startswith("counter"):
        ok = F.col("dt").isNotNull()
        for x in (*nums, *dens):
            ok = ok & x.isNotNull()
        sums = [F.sum(F.when(ok, x)).alias(f"{c}{k}") for c, xs in (("n", nums), ("d", dens)) for k, x in enumerate(xs)]
        out = rows.groupBy(*keys, *entity).agg(F.count_if(ok).alias("intervals"), F.count("*").alias("endpoints"), *sums, F.sum(F.when(ok, F.col("dt"))).alias("t"))
        out = out.where((F.col("intervals") >= rule.least) & (F.col("intervals") * 10 >= F.col("endpoints") * 7))
        measure = {"counter_ratio": lambda n, d: ratio(n, d), "counter_sum": lambda n, d: n, "counter_rate": lambda n, d: ratio(n * 1e6, F.col("t"))}[rule.kind]
        values = [measure(F.col(f"n{k}"), F.col(f"d{k}")) for k in range(len(nums))]
    else:
        low = rule.below or rule.kind == "gauge_min"
        xs = [ratio(n, d) if rule.kind == "gauge_share" else n for n, d in zip(nums, dens, strict=True)]
        rows = rows.withColumns({f"_x{k}": x for k, x in enumerate(xs)}).where(" OR ".join(f"_x{k} IS NOT NULL" for k in range(len(xs))))
        best = [F.max_by(f"_x{k}", F.when(F.col(f"_x{k}").isNotNull(), F.struct(-F.col(f"_x{k}") if low else F.col(f"_x{k}"), -F.col(ts)))).alias(f"n{k}") for k in range(len(xs))]
        grown = [(F.max_by(rule.grows, ts) - F.min_by(rule.grows, ts)).alias("_grown")] if rule.grows else []
        out = rows.groupBy(*keys, *entity).agg(F.count("*").alias("intervals"), *best, *grown)
        out = out.where("_grown > 0") if grown else out
        values = [F.col(f"n{k}") for k in range(len(xs))]
    hits = [v < gate if rule.below else v >= gate for v, (_, _, gate) in zip(values, rule.measures(), strict=True)]
    value = F.coalesce(*(F.when(hit, v) for hit, v in zip(hits, values, strict=True)))
    found = F.to_json(F.struct(*entity)) if entity else F.lit("{}")
    return out.withColumn("value", value).where(F.col("value").isNotNull()).select(*keys, F.lit(rule.id).alias("rule"), F.lit(rule.role).alias("role"), found.alias("entity"), "value", "intervals")


def _shaped(found: DataFrame, keys: Sequence[str], rule: str, role: str | Column, entity: Column, value: Column, intervals: Column) -> DataFrame:
    return found.select(*keys, F.lit(rule).alias("rule"), (role if isinstance(role, Column) else F.lit(role)).alias("role"), entity.alias("entity"), value.cast("double").alias("value"), intervals.cast("bigint").alias("intervals"))


def plan_churn_findings(plans: DataFrame, keys: Sequence[str], step: str = "step", ts: str = "ts", plan: str = "planid", calls: str = "calls", time: str = "total_time", most_gap: int = 600_000_000) -> DataFrame:
    """PG-PLAN-002: a plan that is new between two neighbouring snapshots, and stays, with work of its own."""
    from tidemark.operators.metrics import plan_churn

    found = plan_churn(plans, keys, step, ts, plan, calls, time, most_gap)
    return _shaped(found, keys, "PG-PLAN-002", "coincident", F.to_json(F.struct(plan, step)), F.col("time_delta"), F.lit(3))


def lock_findings(edges: DataFrame, keys: Sequence[str], ts: str = "ts", waiter: str = "pid", blocker: str = "blocker") -> DataFrame:
    """PG-LOCK-012: blockers lead, waiters are downstream."""
    found = lock_roles(edges, keys, ts, waiter, blocker)
    return _shaped(found, keys, "PG-LOCK-012", F.col("role"), F.to_json(F.struct("pid")), F.col("snapshots"), F.col("snapshots"))


def sync_findings(sessions: DataFrame, keys: Sequence[str], step: str = "step", identity: Sequence[str] = ("pid", "backend_start"), wait: str = "wait_event", least: int = 3) -> DataFrame:
    """PG-SYNC-018: a session that waits for synchronous replication over consecutive snapshots; value: the longest run."""
    from tidemark.operators.series import runs

    found = runs(sessions, [*keys, *identity], step, F.coalesce(F.col(wait) == "SyncRep", F.lit(False))).where(F.col("length") >= least)
    found = found.groupBy(*keys, *identity).agg(F.max("length").alias("length"))
    return _shaped(found, keys, "PG-SYNC-018", "coincident", F.to_json(F.struct(*identity)), F.col("length"), F.col("length"))


def wait_findings(backends: DataFrame, keys: Sequence[str], step: str = "step", kind: str = "wait_event_type", active: str = "active") -> DataFrame:
    """PG-WAIT-019: a class that half of the active backends wait in; value: its share."""
    from tidemark.operators.change import concentration

    found = concentration(backends, keys, step, kind, active)
    return _shaped(found, keys, "PG-WAIT-019", "coincident", F.to_json(F.struct(kind)), F.col("n") / F.col("total"), F.col("steps"))


def contender_findings(deltas: DataFrame, keys: Sequence[str], identity: Sequence[str] = ("pid", "starttime"), read: str = "read_bytes", write: str = "write_bytes") -> DataFrame:
    """OS-IOWHO-026: the processes with most bytes, under hashed names."""
    found = io_contenders(deltas, keys, identity, read, write)
    return _shaped(found, keys, "OS-IOWHO-026", "coincident", F.to_json(F.struct("process")), F.col("bytes"), F.col("intervals"))


#: Rules that aren't one measure: section and what finds them, of rows with the columns that it names by default.
SPECIAL: dict[str, tuple[str, Callable[..., DataFrame]]] = {
    "PG-PLAN-002": ("pg_store_plans", plan_churn_findings),
    "PG-LOCK-012": ("pg_locks", lock_findings),
    "PG-SYNC-018": ("pg_stat_activity", sync_findings),
    "PG-WAIT-019": ("pg_stat_activity", wait_findings),
    "OS-IOWHO-026": ("os_process", contender_findings),
}


def evaluate(sections: Mapping[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[str], rules: Sequence[Rule] = RULES, most: int = 200) -> DataFrame | None:
    """Findings of all rules whose section is there, in the order of `bounded_findings`. sections: rows by name, with their
    entity columns; a special rule's rows stand under its id. None without any section."""
    found = [findings(sections[r.section][0], r, keys, sections[r.section][1]) for r in rules if r.section in sections]
    found += [find(sections[name][0], keys) for name, (_, find) in SPECIAL.items() if name in sections]
    out = None
    for f in found:
        out = f if out is None else out.unionByName(f)
    return None if out is None else bounded_findings(out, keys, most)


@dataclass(frozen=True)
class Branch:
    """An event that is a finding by itself. States: SQLSTATEs of errors; else a severity, or signals of crashed children
    (sigkill: 9 alone, or all but it)."""

    id: str
    slug: str
    states: tuple[str, ...] = ()
    severity: str | None = None
    sigkill: bool | None = None
    cap: str = "high"


# Branches in their order.
BRANCHES = [
    Branch("PG-EVT-001", "server_child_sigkill", sigkill=True),
    Branch("PG-EVT-002", "server_child_signal_termination", sigkill=False),
    Branch("PG-EVT-003", "panic_severity_observation", severity="PANIC"),
    Branch("OS-FS-027", "filesystem_space", ("53100",)),
    Branch("PG-EVT-005", "postgres_out_of_memory_observation", ("53200",)),
    Branch("PG-CONN-014", "connection_saturation", ("53300",)),
    Branch("PG-EVT-007", "deadlock_observation", ("40P01",)),
    Branch("PG-EVT-008", "corruption_sqlstate_observation", ("XX001", "XX002")),
    Branch("PG-EVT-009", "lock_not_available_observation", ("55P03",), cap="medium"),
    Branch("PG-EVT-010", "query_canceled_observation", ("57014",), cap="medium"),
    Branch("PG-EVT-011", "serialization_failure_observation", ("40001",), cap="medium"),
    Branch("PG-EVT-012", "auth_failure_observation", ("28P01",), cap="medium"),
    Branch("PG-EVT-013", "authorization_failure_observation", ("28000",), cap="medium"),
    Branch("PG-EVT-014", "permission_denied_observation", ("42501",), cap="medium"),
]


def event_findings(events: DataFrame, keys: Sequence[str], ts: str = "ts", branches: Sequence[Branch] = BRANCHES) -> DataFrame:
    """keys, rule, slug, cap, entity of log events (kind, severity, sqlstate, count, pid, signal): one for each SQLSTATE, or
    panic, and time, or for each time, pid and signal of a crash. Groups without rows tell nothing. One pass: an event's branches
    are an array."""
    errors, crashes = (F.col("kind") == "error_group") & (F.col("count") > 0), F.col("kind") == "child_process_crash"
    cells = []
    for b in branches:
        if b.states:
            hit, entity = errors & F.col("sqlstate").isin(*b.states), F.struct("sqlstate", F.col(ts).alias("at"))
        elif b.severity:
            hit, entity = errors & (F.col("severity") == b.severity), F.struct("severity", F.col(ts).alias("at"))
        else:
            hit, entity = crashes & ((F.col("signal") == 9) if b.sigkill else (F.col("signal") != 9)), F.struct(F.col(ts).alias("at"), "pid", "signal")
        cells.append(F.when(hit, F.struct(F.lit(b.id).alias("rule"), F.lit(b.slug).alias("slug"), F.lit(b.cap).alias("cap"), F.to_json(entity).alias("entity"))))
    return events.select(*keys, F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("f")).select(*keys, "f.*").distinct()


def bounded_findings(found: DataFrame, keys: Sequence[str], most: int, order: Sequence[str] = ("rule", "entity")) -> DataFrame:
    """The first findings of each cluster in an order that doesn't hang on when which rule ran: adds position and truncated
    (there were more)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = found.withColumns({"position": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys))})
    return out.where(F.col("position") <= most).withColumn("truncated", F.col("_n") > most).drop("_n")


def dispatch(cluster_sections: DataFrame, keys: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Which rules a cluster calls for: those with an input section among the cluster's sections."""
    spark = cluster_sections.sparkSession
    wanted = spark.createDataFrame([(r.id, r.section) for r in rules], "rule string, section string")
    return cluster_sections.join(F.broadcast(wanted), "section").select(*keys, "rule").distinct()


def lock_roles(edges: DataFrame, keys: Sequence[str], ts: str, waiter: str, blocker: str) -> DataFrame:
    """Blockers lead and waiters follow; an edge counts once a snapshot: keys, pid, role, snapshots."""
    e = edges.select(*keys, ts, waiter, blocker).distinct()
    lead = e.select(*keys, ts, F.col(blocker).alias("pid"), F.lit("lead").alias("role"))
    follow = e.select(*keys, ts, F.col(waiter).alias("pid"), F.lit("downstream").alias("role"))
    return lead.unionByName(follow).groupBy(*keys, "pid", "role").agg(F.count_distinct(ts).alias("snapshots"))


def availability(present: DataFrame, keys: Sequence[str], inputs: Sequence[str]) -> DataFrame:
    """available, partial or unavailable, by how many of a rule's inputs are there."""
    n = sum((F.max(F.col(c).cast("int")) for c in inputs[1:]), F.max(F.col(inputs[0]).cast("int")))
    return present.groupBy(*keys).agg(n.alias("present")).withColumn("state", F.when(F.col("present") == len(inputs), "available").when(F.col("present") > 0, "partial").otherwise("unavailable"))


def io_contenders(deltas: DataFrame, keys: Sequence[str], identity: Sequence[str], read: str, write: str, k: int = 8, least: int = 2) -> DataFrame:
    """The k processes with most bytes, over enough intervals, under hashed names: raw ids don't leave."""
    from tidemark.operators.reduce import top

    sums = deltas.where(F.col(read).isNotNull() & F.col(write).isNotNull()).groupBy(*keys, *identity).agg(F.count("*").alias("intervals"), (F.sum(read) + F.sum(write)).alias("bytes"))
    named = sums.where((F.col("intervals") >= least) & (F.col("bytes") > 0)).withColumn("process", F.sha2(F.concat_ws("|", *identity), 256))
    return top(named, keys, [F.desc("bytes"), F.col("process")], k).select(*keys, "process", "bytes", "intervals", "rank")
