"""The recorded layouts: which sections there are, what their rows are and how they are keyed.

Columns come with the data: a Parquet file names and types them. `contract` binds a layout to such columns and checks their
numbers by class.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.sources.sections import CLASSES, Contract, Field


@dataclass(frozen=True)
class Layout:
    """classes: numbers of timestamp, label, cumulative and gauge columns. No identity: the sort key without time."""

    type_id: int
    section: str
    semantics: str
    sort_key: tuple[str, ...]
    identity: tuple[str, ...]
    classes: tuple[int, int, int, int]

    def key(self) -> tuple[str, ...]:
        return self.identity or tuple(c for c in self.sort_key if c != "ts")


# Type, section, semantics, sort key, identity, columns by class.
LAYOUTS = [
    Layout(1_001_001, "pg_stat_activity", "snapshot_full", ("ts", "pid"), (), (1, 10, 0, 6)),
    Layout(1_001_002, "pg_stat_activity", "snapshot_full", ("ts", "pid"), (), (1, 11, 0, 6)),
    Layout(1_001_003, "pg_stat_activity", "snapshot_full", ("ts", "pid"), (), (1, 12, 0, 6)),
    Layout(1_002_001, "pg_stat_statements", "snapshot_full", ("dbid", "userid", "ts"), ("queryid", "userid", "dbid"), (1, 6, 15, 4)),
    Layout(1_002_002, "pg_stat_statements", "snapshot_full", ("dbid", "userid", "ts"), ("queryid", "userid", "dbid"), (1, 6, 20, 8)),
    Layout(1_002_003, "pg_stat_statements", "snapshot_full", ("dbid", "userid", "ts"), ("queryid", "userid", "dbid", "toplevel"), (1, 7, 20, 8)),
    Layout(1_002_004, "pg_stat_statements", "snapshot_full", ("dbid", "userid", "ts"), ("queryid", "userid", "dbid", "toplevel"), (1, 7, 30, 8)),
    Layout(1_002_005, "pg_stat_statements", "snapshot_full", ("dbid", "userid", "ts"), ("queryid", "userid", "dbid", "toplevel"), (1, 7, 34, 10)),
    Layout(1_002_006, "pg_stat_statements", "snapshot_full", ("dbid", "userid", "ts"), ("queryid", "userid", "dbid", "toplevel"), (1, 7, 37, 10)),
    Layout(1_003_001, "pg_store_plans_ossc", "snapshot_full", ("dbid", "userid", "queryid", "planid"), (), (1, 7, 19, 6)),
    Layout(1_004_001, "pg_store_plans_vadv", "snapshot_full", ("dbid", "userid", "planid"), (), (1, 7, 17, 9)),
    Layout(1_005_001, "pg_stat_database", "snapshot_full", ("datid", "ts"), ("datid",), (1, 4, 15, 5)),
    Layout(1_005_002, "pg_stat_database", "snapshot_full", ("datid", "ts"), ("datid",), (1, 4, 16, 6)),
    Layout(1_005_003, "pg_stat_database", "snapshot_full", ("datid", "ts"), ("datid",), (1, 4, 23, 6)),
    Layout(1_005_004, "pg_stat_database", "snapshot_full", ("datid", "ts"), ("datid",), (1, 4, 25, 6)),
    Layout(1_006_001, "pg_stat_bgwriter + pg_stat_checkpointer", "snapshot_full", ("ts",), (), (1, 0, 13, 2)),
    Layout(1_007_001, "pg_stat_wal", "snapshot_full", ("ts",), (), (1, 0, 8, 1)),
    Layout(1_007_002, "pg_stat_wal", "snapshot_full", ("ts",), (), (1, 0, 4, 1)),
    Layout(1_008_001, "pg_stat_archiver", "snapshot_full", ("ts",), (), (1, 2, 2, 3)),
    Layout(1_009_001, "pg_stat_io", "snapshot_full", ("backend_type", "object", "context", "ts"), (), (1, 3, 13, 2)),
    Layout(1_009_002, "pg_stat_io", "snapshot_full", ("backend_type", "object", "context", "ts"), (), (1, 3, 16, 1)),
    Layout(1_010_001, "pg_prepared_xacts", "snapshot_full", ("datname", "ts"), (), (1, 1, 0, 3)),
    Layout(1_011_001, "pg_locks", "conditional_full", ("root_pid", "depth", "pid"), (), (1, 26, 0, 9)),
    Layout(1_011_002, "pg_locks", "conditional_full", ("root_pid", "depth", "pid"), (), (1, 26, 0, 10)),
    Layout(1_012_001, "pg_stat_progress_vacuum", "conditional_full", ("ts", "pid"), (), (1, 6, 0, 12)),
    Layout(1_013_001, "pg_stat_user_tables", "snapshot_full", ("datid", "relid", "ts"), ("datid", "relid"), (1, 6, 20, 15)),
    Layout(1_013_002, "pg_stat_user_tables", "snapshot_full", ("datid", "relid", "ts"), ("datid", "relid"), (1, 6, 20, 16)),
    Layout(1_013_003, "pg_stat_user_tables", "snapshot_full", ("datid", "relid", "ts"), ("datid", "relid"), (1, 6, 21, 18)),
    Layout(1_013_004, "pg_stat_user_tables", "snapshot_full", ("datid", "relid", "ts"), ("datid", "relid"), (1, 6, 25, 18)),
    Layout(1_014_001, "pg_stat_user_indexes", "snapshot_full", ("datid", "indexrelid", "ts"), ("datid", "indexrelid"), (1, 15, 5, 1)),
    Layout(1_014_002, "pg_stat_user_indexes", "snapshot_full", ("datid", "indexrelid", "ts"), ("datid", "indexrelid"), (1, 15, 5, 2)),
    Layout(1_015_001, "replication_instance", "snapshot_full", ("ts",), (), (1, 5, 0, 12)),
    Layout(1_016_001, "pg_stat_replication", "snapshot_full", ("application_name", "pid", "ts"), (), (1, 6, 0, 8)),
    Layout(1_017_001, "pg_replication_slots", "snapshot_full", ("slot_name", "ts"), (), (1, 4, 0, 4)),
    Layout(1_019_001, "pg_settings", "on_change", ("name",), (), (1, 11, 0, 0)),
    Layout(1_020_001, "reset_metadata", "snapshot_full", ("ts",), (), (1, 5, 0, 9)),
    Layout(1_021_001, "instance_metadata", "snapshot_full", ("ts",), (), (1, 8, 0, 0)),
    Layout(1_022_001, "pg_log_errors", "event_stream", ("severity", "category", "pattern", "ts"), (), (1, 11, 0, 2)),
    Layout(1_023_001, "collection_coverage", "snapshot_full", ("section_type_id", "ts"), (), (1, 5, 0, 3)),
    Layout(1_024_001, "pg_log_checkpoints", "event_stream", ("ts", "phase"), (), (1, 2, 0, 14)),
    Layout(1_025_001, "pg_log_autovacuum", "event_stream", ("ts", "kind", "relation"), (), (1, 2, 0, 18)),
    Layout(1_026_001, "pg_log_slow_queries", "event_stream", ("pattern", "ts"), (), (1, 2, 0, 4)),
    Layout(1_027_001, "pg_log_lock_waits", "event_stream", ("ts", "kind", "pid"), (), (1, 7, 0, 2)),
    Layout(1_028_001, "pg_log_lifecycle", "event_stream", ("ts", "kind"), (), (1, 6, 0, 1)),
    Layout(1_029_001, "pg_log_gap", "event_stream", ("ts", "reason"), (), (1, 5, 0, 10)),
    Layout(1_030_001, "pg_log_temp_files", "event_stream", ("ts", "size_bytes"), (), (1, 2, 0, 2)),
    Layout(1_031_001, "pg_freeze_horizon", "snapshot_full", ("datid", "relid", "ts"), (), (1, 5, 0, 6)),
    Layout(1_032_001, "pg_vacuum_observation", "conditional_full", ("pid", "session_start_key", "query_start_key", "ts"), ("pid", "session_start_key", "query_start_key", "datid", "relid"), (1, 8, 0, 6)),
    Layout(1_033_001, "pg_replication_physical", "snapshot_full", ("pid", "backend_start_key", "ts"), ("pid", "backend_start_key"), (1, 7, 0, 9)),
    Layout(1_034_001, "pg_replication_slot_retention", "snapshot_full", ("slot_name", "ts"), (), (1, 3, 0, 8)),
    Layout(1_034_002, "pg_replication_slot_retention", "snapshot_full", ("slot_name", "ts"), (), (1, 3, 0, 9)),
    Layout(1_034_003, "pg_replication_slot_retention", "snapshot_full", ("slot_name", "ts"), (), (1, 4, 0, 10)),
    Layout(1_036_001, "pg_storage_mount", "snapshot_full", ("role", "path_hash_hi", "path_hash_lo", "ts"), ("role", "path_hash_hi", "path_hash_lo", "mount_hash_hi", "mount_hash_lo", "mount_namespace"), (1, 6, 0, 3)),
    Layout(1_036_002, "pg_storage_mount", "snapshot_full", ("role", "path_hash_hi", "path_hash_lo", "ts"), ("role", "path_hash_hi", "path_hash_lo", "mount_hash_hi", "mount_hash_lo", "mount_namespace"), (1, 6, 0, 6)),
    Layout(1_037_001, "pg_process_cgroup_memory", "snapshot_full", ("process_hash_hi", "process_hash_lo", "ts"), ("process_hash_hi", "process_hash_lo", "cgroup_hash_hi", "cgroup_hash_lo", "hierarchy"), (1, 5, 0, 4)),
    Layout(1_038_001, "snapshot_coverage", "snapshot_full", ("section_type_id", "ts"), (), (1, 5, 0, 2)),
    Layout(1_039_001, "pg_log_source_status", "on_change", ("ts",), (), (1, 4, 0, 1)),
    Layout(1_100_001, "os_process", "snapshot_full", ("pid", "starttime", "ts"), (), (1, 17, 15, 5)),
    Layout(1_101_001, "os_process_status", "snapshot_full", ("pid", "starttime", "ts"), (), (1, 3, 2, 9)),
    Layout(1_102_001, "os_cpu", "snapshot_full", ("cpu_id", "ts"), (), (1, 2, 10, 0)),
    Layout(1_103_001, "os_stat", "snapshot_full", ("ts",), (), (1, 1, 2, 3)),
    Layout(1_104_001, "os_meminfo", "snapshot_full", ("ts",), (), (1, 1, 0, 23)),
    Layout(1_105_001, "os_loadavg", "snapshot_full", ("ts",), (), (1, 1, 0, 5)),
    Layout(1_106_001, "os_vmstat", "snapshot_full", ("ts",), (), (1, 1, 11, 0)),
    Layout(1_107_001, "os_psi", "snapshot_full", ("resource", "ts"), (), (1, 2, 2, 6)),
    Layout(1_108_001, "os_diskstats", "snapshot_full", ("major", "minor", "ts"), (), (1, 4, 16, 1)),
    Layout(1_109_001, "os_netdev", "snapshot_full", ("iface", "ts"), (), (1, 2, 16, 0)),
    Layout(1_110_001, "os_snmp", "snapshot_full", ("ts",), (), (1, 1, 13, 1)),
    Layout(1_111_001, "os_netstat", "snapshot_full", ("ts",), (), (1, 1, 7, 0)),
    Layout(1_112_001, "os_mountinfo", "on_change", ("major", "minor", "mount_point", "ts"), (), (1, 7, 0, 2)),
    Layout(1_113_001, "os_topology", "on_change", ("cpu_id", "ts"), (), (1, 6, 0, 0)),
    Layout(1_200_001, "os_cgroup_mapping", "snapshot_full", ("pid", "starttime", "ts"), (), (1, 4, 0, 0)),
    Layout(1_201_001, "os_cgroup_cpu", "snapshot_full", ("cgroup_path", "ts"), (), (1, 2, 5, 2)),
    Layout(1_202_001, "os_cgroup_memory", "snapshot_full", ("cgroup_path", "ts"), (), (1, 2, 5, 6)),
    Layout(1_203_001, "os_cgroup_io", "snapshot_full", ("cgroup_path", "major", "minor", "ts"), (), (1, 4, 4, 0)),
    Layout(1_204_001, "os_cgroup_pids", "snapshot_full", ("cgroup_path", "ts"), (), (1, 2, 0, 2)),
]

BY_TYPE = {x.type_id: x for x in LAYOUTS}


def versions(section: str) -> list[Layout]:
    return sorted((x for x in LAYOUTS if x.section == section), key=lambda x: x.type_id)


def identity(section: str) -> tuple[str, ...]:
    """The union of all versions' identities, in their order."""
    return tuple(dict.fromkeys(c for x in versions(section) for c in x.key()))


def contract(type_id: int, schema: T.StructType, kinds: Mapping[str, str]) -> Contract:
    """A layout's contract over columns that a file has. kinds: the class of each column; ts is a timestamp and keys are
    labels unless told. Raises where columns of a class are more or fewer than the layout has."""
    layout = BY_TYPE[type_id]
    known = {"ts": "timestamp"} | {c: "label" for c in (*layout.sort_key, *layout.identity) if c != "ts"} | dict(kinds)
    missing = [f.name for f in schema if f.name not in known]
    if missing:
        raise ValueError(f"{layout.section}: no class for {', '.join(missing)}")
    fields = tuple(Field(f.name, f.dataType.simpleString(), known[f.name], f.nullable) for f in schema)
    counts = tuple(sum(f.kind == k for f in fields) for k in CLASSES)
    if counts != layout.classes:
        raise ValueError(f"{layout.section} {type_id}: {counts} columns by class, not {layout.classes}")
    return Contract(type_id, layout.section, layout.semantics, fields, layout.sort_key, layout.identity)


def listing(spark: SparkSession) -> DataFrame:
    """section, layouts, semantics, sort_key and identity of the newest layout, columns of the widest."""
    rows = []
    for name in sorted({x.section for x in LAYOUTS}):
        vs = versions(name)
        rows.append((name, [x.type_id for x in vs], vs[-1].semantics, list(vs[-1].sort_key), list(identity(name)), max(sum(x.classes) for x in vs)))
    return spark.createDataFrame(rows, "section string, layouts array<bigint>, semantics string, sort_key array<string>, identity array<string>, columns int")
