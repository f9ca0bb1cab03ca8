import duckdb
import pytest
from pyspark.sql import types as T

from tidemark.sources import external, layouts, procfs


@pytest.mark.parametrize("view", sorted(external.VIEWS))
def test_server_queries_are_well_formed(view):
    """One statement each, that a parser of the server's dialect reads, for every server version."""
    seen = set()
    for version in (100000, 120000, 130000, 140000, 150000, 160000, 170000, 180000):
        if version < external.VIEWS[view].queries[0][0]:
            continue
        sql = external.VIEWS[view].query(version)
        assert len(duckdb.extract_statements(sql)) == 1
        seen.add(sql)
    assert len(seen) == len(external.VIEWS[view].queries)
    assert len(duckdb.extract_statements(external.LOCKS_PRECHECK)) == 1


def test_layouts(spark):
    assert len(layouts.LAYOUTS) == len(layouts.BY_TYPE) == 76
    assert layouts.identity("pg_stat_statements") == ("queryid", "userid", "dbid", "toplevel")
    assert layouts.identity("pg_stat_activity") == ("pid",)
    schema = T._parse_datatype_string("ts bigint, wal_records bigint, wal_fpi bigint, wal_bytes bigint, wal_buffers_full bigint, stats_reset bigint")
    kinds = dict.fromkeys(("wal_records", "wal_fpi", "wal_bytes", "wal_buffers_full"), "cumulative") | {"stats_reset": "gauge"}
    assert layouts.contract(1007002, schema, kinds).key() == ()
    with pytest.raises(ValueError, match="columns by class"):
        layouts.contract(1007001, schema, kinds)
    with pytest.raises(ValueError, match="no class for wal_bytes"):
        layouts.contract(1007002, schema, {k: v for k, v in kinds.items() if k != "wal_bytes"})


def lines(spark, *text, line=True):
    return spark.createDataFrame(list(enumerate(text)), "line int, value string")


def test_protocol_counters(spark):
    out = procfs.protocol_counters(lines(spark, "Tcp: A B", "Udp: X", "Tcp: 1 -2", "Udp: 3", "Odd: Z", ""))
    assert sorted(map(tuple, out.collect())) == [("Tcp", "A", 1), ("Tcp", "B", -2), ("Udp", "X", 3)]


def test_process_files(spark):
    df = spark.createDataFrame([(1, "Name:\tpostgres"), (1, "VmRSS:\t  812 kB"), (1, "Threads:\t4"), (2, "Name:\tkworker"), (2, "nonvoluntary_ctxt_switches:\t9")], "pid int, value string")
    got = {r.pid: r for r in procfs.process_status(df, ["pid"]).collect()}
    assert (got[1].rmem_kb, got[1].num_threads, got[1].nivcsw, got[2].rmem_kb, got[2].nivcsw) == (812, 4, None, None, 9)
    io = spark.createDataFrame([(1, "rchar: 5"), (1, "read_bytes: 7"), (1, "cancelled_write_bytes: 0")], "pid int, value string")
    row = procfs.process_io(io, ["pid"]).first()
    assert (row.rchar, row.read_bytes, row.wchar, row.cancelled_write_bytes) == (5, 7, None, 0)


def test_mounts_and_topology(spark):
    df = lines(spark, r"36 35 98:0 / /mnt/my\040disk rw,noatime shared:1 master:2 - ext4 /dev/sda1 rw", "37 35 0:5 / /proc rw - proc proc rw", "broken")
    got = sorted(map(tuple, procfs.mountinfo(df).collect()))
    assert got == [(36, 35, "98:0", "/", "/mnt/my disk", "rw,noatime", "ext4", "/dev/sda1"), (37, 35, "0:5", "/", "/proc", "rw", "proc", "proc")]
    cpus = lines(spark, "processor\t: 0", "model name\t: X", "physical id\t: 0", "core id\t: 0", "", "processor\t: 1", "physical id\t: 0", "core id\t: 1")
    assert sorted(map(tuple, procfs.topology(cpus).collect())) == [(0, 0, 0), (1, 0, 1)]


def test_exposition(spark):
    df = spark.createDataFrame([("a\"b\\", 1.5), ("c\nd", None), ("e", 2.0)], "k string, v double")
    assert [r.line for r in external.exposition(df, "m", ("k",), "v").collect()] == ["# TYPE m gauge", 'm{k="a\\"b\\\\"} 1.5', 'm{k="e"} 2.0']
