"""Absolute thresholds: a catalogue of policies, and their levels as column expressions.

A level is inactive, ok, warning or critical; critical is tested first. What can't be judged has a reason instead:
non_finite, out_of_domain, invalid_denominator, not_applicable, missing.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TESTS = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}
_INFINITY = float("inf")


@dataclass(frozen=True)
class Bound:
    test: str
    value: float

    def met(self, x: Column) -> Column:
        return _TESTS[self.test](x, F.lit(float(self.value)))


@dataclass(frozen=True)
class Policy:
    metric: str
    shape: str  # scalar, fraction, warning_limit, ratio_with_floor, age, free_capacity
    unit: str
    higher_is_worse: bool
    warning: Bound | None
    critical: Bound | None
    floor: Bound | None  # of the count, or the ceiling of the free bytes
    zero_inactive: bool


#: Metric, shape, unit, whether higher is worse, warning, critical, floor of the count or ceiling of the free
#: bytes, and whether zero is inactive.
CATALOGUE = [
    Policy("os.cgroup.cpu_used_pct", "scalar", "Percent", True, Bound(">=", 70), Bound(">=", 90), None, False),
    Policy("os.cgroup.cpu_throttled_ms_delta", "scalar", "Milliseconds", True, Bound(">", 0), Bound(">", 100), None, True),
    Policy("os.cgroup.cpu_throttle_events_delta", "scalar", "Count", True, Bound(">", 0), None, None, True),
    Policy("os.cgroup.memory_anon_pct", "scalar", "Percent", True, Bound(">=", 70), Bound(">=", 90), None, False),
    Policy("os.cgroup.memory_headroom_pct", "scalar", "Percent", False, Bound("<", 20), Bound("<", 10), None, False),
    Policy("os.cgroup.memory_oom_kills_delta", "scalar", "Count", True, None, Bound(">", 0), None, True),
    Policy("os.process.cpu_pct", "scalar", "Percent", True, Bound(">=", 50), Bound(">=", 90), None, False),
    Policy("os.load.avg1_per_core", "fraction", "Ratio", True, Bound(">", 1), Bound(">", 2), None, False),
    Policy("os.cpu.idle_pct", "scalar", "Percent", False, Bound("<", 30), Bound("<", 10), None, False),
    Policy("os.cpu.iowait_pct", "scalar", "Percent", True, Bound(">", 5), Bound(">", 15), None, False),
    Policy("os.cpu.steal_pct", "scalar", "Percent", True, Bound(">", 3), Bound(">", 10), None, False),
    Policy("os.load.procs_blocked", "scalar", "Count", True, Bound(">", 0), Bound(">", 4), None, False),
    Policy("pg.activity.backend_load_per_core", "fraction", "Ratio", True, Bound(">=", 0.25), Bound(">=", 0.5), None, False),
    Policy("os.memory.used_pct", "scalar", "Percent", True, Bound(">=", 70), Bound(">=", 90), None, False),
    Policy("os.process.virtual_growth_kib", "scalar", "Kibibytes", True, Bound(">", 102400), Bound(">", 1048576), None, True),
    Policy("os.process.resident_growth_kib", "scalar", "Kibibytes", True, Bound(">", 102400), Bound(">", 1048576), None, True),
    Policy("os.process.virtual_swap_kib", "scalar", "Kibibytes", True, Bound(">", 0), Bound(">", 102400), None, True),
    Policy("os.memory.swap_used_kib", "scalar", "Kibibytes", True, Bound(">", 0), Bound(">", 1048576), None, True),
    Policy("os.vmstat.swap_in_per_second", "scalar", "CountPerSecond", True, None, Bound(">", 0), None, True),
    Policy("os.vmstat.swap_out_per_second", "scalar", "CountPerSecond", True, None, Bound(">", 0), None, True),
    Policy("os.process.major_faults_delta", "scalar", "Count", True, Bound(">", 100), Bound(">", 10000), None, True),
    Policy("os.process.rss_kib", "scalar", "Kibibytes", True, Bound(">", 1048576), Bound(">", 4194304), None, False),
    Policy("pg.activity.query_duration_seconds", "scalar", "Seconds", True, Bound(">=", 1), Bound(">=", 30), None, False),
    Policy("pg.activity.transaction_duration_seconds", "scalar", "Seconds", True, Bound(">=", 5), Bound(">=", 60), None, False),
    Policy("pg.activity.client_backend_capacity", "fraction", "Ratio", True, Bound(">=", 0.7), Bound(">=", 0.9), None, False),
    Policy("pg.activity.idle_in_transaction_sessions", "scalar", "Count", True, None, Bound(">", 0), None, True),
    Policy("pg.activity.blocked_sessions", "scalar", "Count", True, Bound(">", 0), Bound(">=", 5), None, True),
    Policy("pg.activity.long_queries", "scalar", "Count", True, Bound(">", 0), Bound(">=", 5), None, True),
    Policy("pg.activity.long_transactions", "scalar", "Count", True, Bound(">", 0), Bound(">=", 3), None, True),
    Policy("pg.database.rollback_pct", "scalar", "Percent", True, Bound(">", 3), Bound(">", 10), None, False),
    Policy("pg.database.deadlocks_delta", "scalar", "Count", True, None, Bound(">", 0), None, True),
    Policy("pg.database.cache_hit_pct", "scalar", "Percent", False, Bound("<", 99), Bound("<", 90), None, False),
    Policy("pg.database.io_cache_hit_pct", "scalar", "Percent", False, Bound("<", 99), Bound("<", 90), None, False),
    Policy("pg.database.effective_cache_hit_pct", "scalar", "Percent", False, Bound("<", 99), Bound("<", 90), None, False),
    Policy("pg.checkpointer.checkpoints_per_minute", "scalar", "CountPerMinute", True, Bound(">", 2), None, None, True),
    Policy("pg.checkpointer.write_time_ms_delta", "scalar", "Milliseconds", True, Bound(">", 30000), Bound(">", 120000), None, True),
    Policy("pg.bgwriter.buffers_backend_per_second", "scalar", "CountPerSecond", True, Bound(">", 0), None, None, True),
    Policy("pg.bgwriter.maxwritten_clean_delta", "scalar", "Count", True, Bound(">", 0), None, None, True),
    Policy("pg.bgwriter.client_evictions_per_second", "scalar", "CountPerSecond", True, Bound(">", 0), Bound(">=", 10), None, True),
    Policy("pg.replication.replay_lag_seconds", "scalar", "Seconds", True, Bound(">", 10), Bound(">", 60), None, False),
    Policy("pg.database.recovery_conflicts_delta", "scalar", "Count", True, Bound(">", 0), None, None, True),
    Policy("pg.statements.milliseconds_per_row", "scalar", "Milliseconds", True, Bound(">=", 10), Bound(">=", 100), None, False),
    Policy("pg.statements.mean_time_ms", "scalar", "Milliseconds", True, Bound(">=", 10), Bound(">=", 100), None, False),
    Policy("pg.statements.time_pct", "scalar", "Percent", True, Bound(">=", 20), Bound(">=", 50), None, False),
    Policy("pg.statements.plan_time_pct", "scalar", "Percent", True, Bound(">=", 50), Bound(">=", 80), None, False),
    Policy("pg.statements.plan_count", "scalar", "Count", True, Bound(">", 1), Bound(">", 3), None, False),
    Policy("pg.tables.dead_tuple_pct", "ratio_with_floor", "Ratio", True, Bound(">=", 0.1), Bound(">=", 0.2), Bound(">", 10000), False),
    Policy("pg.tables.dead_tuples", "scalar", "Count", True, Bound(">=", 1000), Bound(">=", 100000), None, False),
    Policy("pg.tables.sequential_scan_pct", "scalar", "Percent", True, Bound(">=", 30), Bound(">=", 80), None, False),
    Policy("pg.tables.modified_since_analyze", "scalar", "Count", True, Bound(">=", 100000), Bound(">=", 1000000), None, False),
    Policy("pg.tables.inserted_since_vacuum", "scalar", "Count", True, Bound(">=", 100000), Bound(">=", 1000000), None, False),
    Policy("pg.tables.autovacuum_age_seconds", "age", "Seconds", True, Bound(">", 21600), Bound(">", 86400), None, False),
    Policy("pg.tables.autoanalyze_age_seconds", "age", "Seconds", True, Bound(">", 21600), Bound(">", 86400), None, False),
    Policy("pg.tables.temp_bytes_per_second", "scalar", "BytesPerSecond", True, Bound(">", 0), None, None, True),
    Policy("pg.tables.vacuum_threshold_exceeded", "warning_limit", "Count", True, None, None, None, False),
    Policy("pg.tables.analyze_threshold_exceeded", "warning_limit", "Count", True, None, None, None, False),
    Policy("pg.tables.insert_vacuum_threshold_exceeded", "warning_limit", "Count", True, None, None, None, False),
    Policy("os.psi.cpu_some_pct", "scalar", "Percent", True, Bound(">=", 5), Bound(">=", 25), None, False),
    Policy("os.psi.memory_some_pct", "scalar", "Percent", True, Bound(">=", 5), Bound(">=", 25), None, False),
    Policy("os.psi.io_some_pct", "scalar", "Percent", True, Bound(">=", 10), Bound(">=", 40), None, False),
    Policy("os.disk.util_pct", "scalar", "Percent", True, Bound(">=", 60), Bound(">=", 90), None, False),
    Policy("os.disk.max_await_ms", "scalar", "Milliseconds", True, Bound(">=", 2), Bound(">=", 10), None, False),
    Policy("os.disk.read_await_ms", "scalar", "Milliseconds", True, Bound(">=", 2), Bound(">=", 10), None, False),
    Policy("os.disk.write_await_ms", "scalar", "Milliseconds", True, Bound(">=", 2), Bound(">=", 10), None, False),
    Policy("os.filesystem.free_capacity", "free_capacity", "Ratio", False, Bound("<", 0.2), Bound("<", 0.1), Bound("<", 16106127360), False),
    Policy("os.process.block_delay_seconds_delta", "scalar", "Seconds", True, Bound(">", 10), Bound(">", 50), None, True),
    Policy("os.disk.blocks_read_per_second", "scalar", "CountPerSecond", True, Bound(">", 0), None, None, True),
    Policy("os.network.errors_per_second", "scalar", "CountPerSecond", True, Bound(">", 0), Bound(">", 10), None, True),
    Policy("os.network.drops_per_second", "scalar", "CountPerSecond", True, Bound(">", 0), Bound(">", 10), None, True),
]

POLICIES = {p.metric: p for p in CATALOGUE}


def _odd(*xs: Column) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | F.isnan(x) | (F.abs(x) == _INFINITY)
    return out


def _missing(*xs: Column) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | x.isNull()
    return out


def _level(p: Policy, x: Column, ok_first: Column | None = None) -> Column:
    out = F.when(x == 0, "inactive") if p.zero_inactive else F.when(F.lit(False), "")
    if ok_first is not None:
        out = out.when(ok_first, "ok")
    for name, b in (("critical", p.critical), ("warning", p.warning)):
        if b is not None:
            out = out.when(b.met(x), name)
    return out.otherwise("ok")


def classify(policy: Policy | str, *inputs: Column) -> Column:
    """struct(level, reason, observed) by the policy's shape. Inputs: scalar (value), fraction (numerator, denominator),
    warning_limit (observed, limit), ratio_with_floor (ratio, count), age (epoch_s, now_s, gate), free_capacity (available,
    total)."""
    p = POLICIES[policy] if isinstance(policy, str) else policy
    gate = inputs[2] if p.shape == "age" else F.lit(True)
    x = [c.cast("double") for c in (inputs[:2] if p.shape == "age" else inputs)]
    reason = F.when(~F.coalesce(gate, F.lit(False)), "not_applicable").when(_missing(*x), "missing").when(_odd(*x), "non_finite")
    if p.shape == "scalar":
        value = x[0]
        reason = reason.when(value < 0, "out_of_domain")
        level = _level(p, value)
    elif p.shape == "fraction":
        value = F.try_divide(x[0], x[1])
        reason = reason.when(x[1] <= 0, "invalid_denominator").when(x[0] < 0, "out_of_domain").when(_odd(value), "non_finite")
        level = _level(p, value)
    elif p.shape == "warning_limit":
        value = x[0]
        reason = reason.when((x[0] < 0) | (x[1] < 0), "out_of_domain")
        level = F.when(F.lit(p.zero_inactive) & (x[0] == 0), "inactive").when(x[0] > x[1], "warning").otherwise("ok")
    elif p.shape == "ratio_with_floor":
        value = x[0]
        reason = reason.when((x[0] < 0) | (x[1] < 0), "out_of_domain")
        level = F.when(~p.floor.met(x[1]), "ok").otherwise(_level(p, value))
    elif p.shape == "age":
        value = x[1] - x[0]
        reason = reason.when((x[0] < 0) | (x[1] < 0) | (x[0] > x[1]), "out_of_domain")
        level = _level(p, value)
    else:
        value = F.try_divide(x[0], x[1])
        reason = reason.when(x[1] <= 0, "invalid_denominator").when((x[0] < 0) | (x[0] > x[1]), "out_of_domain").when(_odd(value), "non_finite")
        level = _level(p, value, ~p.floor.met(x[0]))
    return F.struct(F.when(reason.isNull(), level).alias("level"), reason.alias("reason"), F.when(reason.isNull(), value + 0.0).alias("observed"))
