"""Traps of the semantics, on small tables."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.functions.thresholds import POLICIES, classify
from tidemark.operators import anomaly, change, events, frames, incidents, joins, reduce, series
from tidemark.plans.views import VIEWS, frame
from tidemark.sources import procfs, sections
from tidemark.sources.external import VIEWS as PG
from tidemark.sources.external import as_json


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def counter(spark, values):
    return spark.createDataFrame([(1, t, v) for t, v in values], "id int, ts bigint, n bigint")


def test_diff_reasons(spark):
    s = 1_000_000
    df = counter(spark, [(0, 100), (4 * s, 112), (5 * s, 112), (6 * s, 50), (7 * s, None), (8 * s, 60), (20 * s, 70)])
    out = series.counter_diff(df, ["id"], "n", gaps=[(10 * s, 12 * s)])
    assert rows(out.select("reason", "delta", "rate"), "ts") == [("first_point", None, None), (None, 12, 3.0), (None, 0, 0.0), ("reset", None, None), ("anomaly", None, None), ("anomaly", None, None), ("gap", None, None)]


def test_reset_beats_gap_in_reductions_only(spark):
    df = counter(spark, [(0, 10), (100, 5)]).withColumn("epoch", F.lit(1))
    assert rows(series.pair_quality(df, ["id"], "n", "epoch", gaps=[(40, 50)]).select("quality"), "ts")[1] == ("reset",)
    assert rows(series.counter_diff(df, ["id"], "n", gaps=[(40, 50)]).select("reason"), "ts")[1] == ("gap",)


def test_gate_looks_at_the_start_and_the_inside(spark):
    left = spark.createDataFrame([(1, t) for t in (10, 20, 30, 40, 50)], "id int, ts bigint")
    gate = spark.createDataFrame([(1, 5, True), (1, 25, False), (1, 35, True), (1, 45, None)], "id int, ts bigint, on boolean")
    assert rows(series.gate_state(left, gate, ["id"], "on").select("ts", "collected"), "ts") == [(10, False), (20, True), (30, False), (40, False), (50, False)]


def test_islands_and_complement(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 5, 8), (1, 30, 40)], "id int, s bigint, e bigint")
    isl = series.islands(df, ["id"], "s", "e")
    assert rows(isl, "s") == [(1, 0, 20, 3), (1, 30, 40, 1)]
    assert rows(series.complement(isl, ["id"], "s", "e", -5, 50), "gap_from") == [(1, -5, 0), (1, 20, 30), (1, 40, 50)]


def points(spark, ref, cur):
    return spark.createDataFrame([(1, t, float(v), 0) for t, v in [*enumerate(ref), *((1000 + k, v) for k, v in enumerate(cur))]], "id int, ts bigint, v double, segment int")


def last_score(df, to):
    return anomaly.scores(df, ["id"], "v", 0, to, 500, 10_000).orderBy(F.desc("position")).first()


def test_score_of_the_worked_example(spark):
    df = points(spark, [98] * 10 + [102] * 10, [119, 120, 121])
    out = last_score(df, 1002)
    assert (out.med_ref, out.med_cur, out.mad_ref, out.n_ref, out.n_cur) == (100.0, 120.0, 2.0, 20, 3)
    assert out.m == pytest.approx(20 / max(1.4826 * 2, 5.0))
    assert last_score(points(spark, [1] * 19, [2, 2, 2]), 1002).reason == "ref_too_small"
    assert last_score(points(spark, [1] * 25, [2, 2]), 1002).reason == "cur_too_small"


def test_window_over_a_break(spark):
    df = points(spark, [1] * 30, [2, 2, 2, 2]).withColumn("segment", F.when(F.col("ts") >= 1002, 1).otherwise(0))
    assert last_score(df, 1003).reason == "discontinuity"


def test_episode_threshold_is_strict_and_the_first_peak_counts(spark):
    df = spark.createDataFrame([(1, p, m) for p, m in [(0, 1.0), (10, 4.0), (20, 6.0), (30, -6.0), (40, 3.5), (50, 9.0)]], "id int, position bigint, m double")
    assert rows(anomaly.episodes(df, ["id"]), "start") == [(1, 10, 30, 3, 20, 6.0), (1, 50, 50, 1, 50, 9.0)]


def test_total_variation_at_the_threshold(spark):
    df = spark.createDataFrame([("a", 60, 40), ("b", 40, 60)], "c string, r bigint, n bigint")
    assert change.total_variation(df, [], "c", "r", "n").first().outcome == "shift"
    same = spark.createDataFrame([("a", 30, 60)], "c string, r bigint, n bigint")
    assert change.total_variation(same, [], "c", "r", "n", threshold=0.0).first().outcome == "stable"
    few = spark.createDataFrame([("a", 19, 60)], "c string, r bigint, n bigint")
    assert change.total_variation(few, [], "c", "r", "n").first().outcome == "reference_too_small"


def test_per_unit_from_nothing(spark):
    df = spark.createDataFrame([(1, 20, 0, 20, 40), (2, 20, 20, 20, 20), (3, 20, 40, 20, 60), (4, 20, 40, 20, 59)], "k int, ro bigint, rw bigint, co bigint, cw bigint")
    out = change.per_unit_change(df, F.col("ro"), F.col("rw"), F.col("co"), F.col("cw"))
    assert [r.outcome for r in out.orderBy("k").collect()] == ["increase", "stable", "increase", "stable"]


def test_threshold_shapes(spark):
    level = lambda p, *x: one(spark, classify(p, *(F.lit(v) for v in x)).alias("c"))["c"][:2]
    assert len(POLICIES) == 69
    assert level("os.cgroup.cpu_used_pct", 90.0) == ("critical", None)
    assert level("os.cgroup.cpu_used_pct", 0.0) == ("ok", None)
    assert level("os.cgroup.cpu_throttled_ms_delta", 0.0) == ("inactive", None)
    assert level("os.cgroup.memory_headroom_pct", 20.0) == ("ok", None)
    assert level("os.cpu.idle_pct", -1.0) == (None, "out_of_domain")
    assert level("os.load.avg1_per_core", 1.0, 0.0) == (None, "invalid_denominator")
    assert level("pg.tables.dead_tuple_pct", 0.5, 10000.0) == ("ok", None)
    assert level("pg.tables.dead_tuple_pct", 0.5, 10001.0) == ("critical", None)
    assert level("pg.tables.vacuum_threshold_exceeded", 5.0, 5.0) == ("ok", None)
    assert level("pg.tables.autovacuum_age_seconds", 0.0, 90000.0, False) == (None, "not_applicable")
    assert level("os.filesystem.free_capacity", 1e9, 1e11) == ("critical", None)
    assert level("os.filesystem.free_capacity", 2e10, 1e12) == ("ok", None)
    assert level("os.cpu.idle_pct", float("nan")) == (None, "non_finite")


def test_pages_and_orders(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, "b"), (None, "z")], "k int, v string")
    first = [tuple(r) for r in frames.page(df, ["k", "v"], 2).collect()]
    assert first == [(None, "z"), (1, None)]
    assert [tuple(r) for r in frames.page(df, ["k", "v"], 5, first[-1]).collect()] == [(1, "a"), (2, "b")]
    for way in (True, False):
        assert frames.frame_sort(df, "k", way, "v", 9).collect()[-1].k is None


def test_unique_match(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "pid int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "pid int, x string")
    assert rows(joins.unique_match(left, right, ["pid"], ["x"]), "pid") == [(1, "a"), (2, None), (3, None)]


def test_severity_filter_passes_what_has_none(spark):
    df = spark.createDataFrame([(1, "LOG"), (2, None), (3, "PANIC")], "k int, s string")
    assert rows(df.where(events.at_least(F.col("s"), "ERROR")).select("k"), "k") == [(2,), (3,)]


def test_cadences(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 10, 20, 33, 47)] + [(2, t) for t in (0, 5, 10)], "id int, ts bigint")
    assert rows(reduce.observed_period(df, ["id"]), "id") == [(1, 4, 12, 13, None), (2, 2, None, 5, 5)]


def test_clusters_keep_the_span_cap(spark):
    df = spark.createDataFrame([("n", 0, 10, 1), ("n", 12, 20, 2), ("n", 25, 30, 3), ("n", 31, 41, 4), ("n", 100, 101, 5)], "node string, start bigint, end bigint, episode int")
    out = incidents.clusters(df, ["node"], 5, 30)
    assert rows(out.select("start", "end", "members", "split_from_previous"), "start") == [(0, 30, [1, 2, 3], 0), (31, 41, [4], 1), (100, 101, [5], 0)]
    with pytest.raises(Exception, match="longer than a cluster"):
        incidents.clusters(df, ["node"], 5, 9).collect()


def greedy(episodes, epsilon, most_span):
    """Clusters of (node, start, end, key) by the rule as it reads."""
    out = []
    for n, s, e, k in sorted(((n, s, s if e is None else max(s, e), k) for n, s, e, k in episodes), key=lambda x: (x[0] or "", *x[1:])):
        last = out[-1] if out and out[-1][0] == n else None
        near = bool(last) and s - last[2] <= epsilon
        if near and max(last[2], e) - last[1] <= most_span:
            last[2] = max(last[2], e)
            last[3].append(k)
        else:
            out.append([n, s, e, [k], int(near)])
    return out


@pytest.mark.parametrize("epsilon,most_span", [(0, 12), (3, 12), (3, 25), (7, 60), (5, 10_000)])
def test_clusters_follow_the_greedy_rule(spark, epsilon, most_span):
    r = random.Random(epsilon * 100 + most_span)
    starts = [(r.choice(["a", "b", None]), r.randrange(-200, 400)) for _ in range(300)]
    df = [(n, s, r.choice([None, s - 2, s, *(s + r.randrange(12) for _ in range(6))]), k) for k, (n, s) in enumerate(starts)]
    want = greedy(df, epsilon, most_span)
    episodes = spark.createDataFrame([*df, ("a", None, 5, 1000), ("a", None, None, 1001)], "node string, start bigint, end bigint, episode int")
    alone = [["a", None, 5, [1000], 0], ["a", None, None, [1001], 0]]
    got = [tuple(x) for x in incidents.clusters(episodes, ["node"], epsilon, most_span).collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, want + alone), key=repr)
    got = [tuple(x) for x in incidents.clusters(episodes, ["node"], epsilon, most_span, listed=False).collect()]
    assert sorted(got, key=repr) == sorted(((*x[:3], len(x[3]), x[4]) for x in want + alone), key=repr)


@pytest.mark.parametrize("most_span", [6_000, 10**9])
def test_clusters_of_one_long_chain(spark, most_span):
    """The work grows with the episodes and not with the square of a chain."""
    n = 200_000
    df = spark.range(n).select(F.lit("n").alias("node"), F.col("id").alias("start"), (F.col("id") + F.pmod(F.xxhash64("id"), F.lit(500))).alias("end"), F.col("id").alias("episode"))
    began = time.monotonic()
    got = incidents.clusters(df, ["node"], 100, most_span).collect()
    assert time.monotonic() - began < 60
    want = greedy([tuple(x) for x in df.collect()], 100, most_span)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_wait_tree_and_cycles(spark):
    df = spark.createDataFrame([(2, 1), (3, 2), (3, 1), (8, 9), (9, 8), (10, 9)], "w int, b int")
    got = rows(joins.wait_tree(df, "w", "b").select("pid", "root", "depth"), "root", "depth", "pid")
    assert got == [(1, 1, 0), (2, 1, 1), (3, 1, 1), (3, 1, 2), (8, 8, 0), (9, 8, 1), (10, 8, 2)]


def test_messages(spark):
    clean = lambda t: one(spark, sc.normalize_message(F.lit(t)).alias("x"))["x"]
    assert clean('key "a b" and "" at character 5') == 'key "..." and ""'
    assert clean("relation 12 and relation 13") == "relation ... and relation 13"
    assert clean("WAL 0/1A2B3C (x) [y") == "WAL ... (...) [y"
    assert clean("waited after 12.5 ms") == "waited after ... ms"
    assert one(spark, sc.normalize_sql(F.lit("id = 5 and x2 = 'k'")).alias("x"))["x"] == "id = ... and x2 = '...'"
    kind = lambda m, s: one(spark, sc.error_category(F.lit(m), F.lit(s)).alias("x"))["x"]
    assert [kind("x", "PANIC"), kind("x", "FATAL"), kind("x", "ERROR"), kind("deadlock detected", "FATAL"), kind("server process (...) was terminated by signal ...: Killed", "LOG")] == ["data_corruption", "system", "other", "lock", "resource"]


def test_log_lines_and_assembly(spark):
    text = ["2024-01-01 00:00:01.5 UTC [1] ERROR:  23505: duplicate key", "2024-01-01 00:00:01.5 UTC [1] DETAIL:  Key (a) exists", "\tmore of it", "2024-01-01 00:00:02 UTC [1] ВАЖНО:  konec", "stray"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line int, value string")
    parsed = events.parse_lines(lines)
    assert [(r.severity, r.continuation, r.sqlstate) for r in parsed.orderBy("line").collect()] == [("ERROR", None, "23505"), (None, "detail", None), (None, None, None), ("FATAL", None, None), (None, None, None)]
    assert parsed.orderBy("line").first().ts == 1704067201500000
    out = events.assemble(parsed, ["file"], "line").orderBy("line").collect()
    assert [(r.severity, r.message, r.detail, r.rest) for r in out] == [("ERROR", "duplicate key", "Key (a) exists", 1), ("FATAL", "konec", None, 1)]


def test_search(spark):
    df = spark.createDataFrame([(1, "alpha beta", 5), (2, "Gamma*", 6)], "id int, name string, n bigint")
    hit = lambda q: [r.id for r in df.where(sc.search(dict(df.dtypes), "name", ["n"], q)).orderBy("id").collect()]
    assert hit("n:5") == [1]
    assert hit("*mm*") == [2]
    assert hit('"alpha beta"') == [1]
    assert hit(r"gamma\*") == [2]
    assert hit("alpha") == []
    with pytest.raises(ValueError, match="open quote"):
        sc.search_terms('"a')
    assert sc.duration_micros("250ms") == 250_000


def test_truncation_keeps_characters(spark):
    cut = lambda t, n: one(spark, sc.truncate_bytes(F.lit(t), n).alias("x"))["x"]
    assert [cut("aéé", 4), cut("aéé", 5), cut("a😀b", 4), cut("a😀b", 5), cut("abc", 2)] == ["aé", "aéé", "a", "a😀", "ab"]


def test_frame_and_share_without_a_delta(spark):
    s = 1_000_000
    data = [(q, 1, 1, True, t * s, c, x) for q, t, c, x in [(1, 0, 0, 0.0), (1, 10, 5, 50.0), (2, 0, 0, 0.0), (2, 10, 5, 150.0)]]
    df = spark.createDataFrame(data, "queryid long, userid long, dbid long, toplevel boolean, ts long, calls long, total_exec_time double")
    out = frame(df, "statements", 10 * s, columns=["calls_delta", "total", "mean", "time_pct"], sort="total desc")
    assert [tuple(r) for r in out.collect()] == [("2", 5, 150.0, 30.0, 75.0), ("1", 5, 50.0, 10.0, 25.0)]
    more = df.union(spark.createDataFrame([(3, 1, 1, True, 10 * s, 1, 1.0)], df.schema))
    assert [r.time_pct for r in frame(more, "statements", 10 * s, columns=["total", "time_pct"], sort="total desc").collect()] == [None] * 3
    assert len(VIEWS) == 9


def test_proc_files(spark):
    lines = lambda *t: spark.createDataFrame([(x,) for x in t], "value string")
    assert tuple(procfs.cpu(lines("cpu  1 2 3 4 5 6 7 8 9 10", "cpu0 1 1 1 1 1 1 1 1 1 1", "intr 5")).orderBy("cpu_id").first())[:4] == (-1, 1, 2, 3)
    assert rows(procfs.key_values(lines("MemTotal:  16 kB", "pgfault 7")), "name") == [("MemTotal", 16384), ("pgfault", 7)]
    assert tuple(procfs.loadavg(lines("0.5 1.0 2.0 3/400 99")).first()) == (0.5, 1.0, 2.0, 3, 400)
    assert procfs.netdev(lines("Inter-|   Receive", "  eth0: 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16")).first().tx_bytes == 9
    assert tuple(procfs.pressure(lines("some avg10=1.50 avg60=0.00 avg300=0.00 total=12")).first()) == ("some", 1.5, 0.0, 0.0, 12)
    stat = procfs.process_stat(lines("42 (a) b) S 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29 30 31 32 33 34 35 36 37 38 39")).first()
    assert (stat.pid, stat.comm, stat.state, stat.ppid, stat.minflt, stat.utime) == (42, "a) b", "S", 1, 7, 11)
    assert procfs.cgroup_limits(lines("max")).first().limit is None


def test_sections(spark, tmp_path):
    fields = (sections.Field("ts", "bigint", "timestamp"), sections.Field("id", "int", "label"), sections.Field("n", "bigint", "cumulative", True))
    old = sections.Contract(1, "s", "snapshot_full", fields, ("ts", "id"))
    new = sections.Contract(2, "s", "snapshot_full", (*fields, sections.Field("extra", "string", "label", True)), ("ts", "id"), ("id", "extra"))
    reg = sections.Registry()
    reg.add(old)
    reg.add(new)
    assert reg.identity("s") == ("id", "extra")
    with pytest.raises(ValueError, match="isn't a column"):
        reg.add(sections.Contract(3, "t", "snapshot_full", fields, ("nope",)))
    root = str(tmp_path)
    sections.write_part(spark.createDataFrame([(1, 1, 5)], "ts bigint, id int, n bigint"), root, old, 10)
    sections.write_part(spark.createDataFrame([(2, 1, 6, "x"), (1, 1, 5, None)], "ts bigint, id int, n bigint, extra string"), root, new, 11)
    out = sections.scan(spark, root, reg, "s")
    assert rows(out.select("ts", "id", "extra", "segment_id"), "segment_id", "ts") == [(1, 1, None, 10), (1, 1, None, 11), (2, 1, "x", 11)]
    assert reg.listing(spark).first().layouts == [1, 2]
    sections.seal(spark, f"{root}/s/layout=2/segment_id=11", f"{root}/sealed", new, 11)
    with pytest.raises(Exception, match="already exists"):
        sections.seal(spark, f"{root}/s/layout=2/segment_id=11", f"{root}/sealed", new, 11)
    assert sections.inventory(spark, root).where("path like '%.parquet'").count() >= 3
    with pytest.raises(Exception, match="null in"):
        sections.write_part(spark.createDataFrame([(None, 1, 5)], "ts bigint, id int, n bigint"), root, old, 12)


def test_inventory_of_tables_in_parts(spark, tmp_path):
    """A table may be a file or a folder of parts, also in folders of its own; either is one row."""
    from tidemark.plans.catalog_values import _TABLES, file_inventory

    for k, t in enumerate(_TABLES):
        for part in [f"{t}.parquet"] if k % 2 else [f"{t}.parquet/part-0000.parquet", f"{t}.parquet/k=1/part-0001.parquet"]:
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_bytes(b"x" * (k + 1))
    (tmp_path / "other.parquet").write_bytes(b"x")
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        assert rows(file_inventory(spark, root), "file") == sorted((f"{t}.parquet", True) for t in _TABLES)


def test_dictionaries(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, value string")
    assert rows(sections.dictionary_merge([a, a]), "id") == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="two values"):
        sections.dictionary_merge([a, spark.createDataFrame([(1, "z")], a.schema)]).collect()
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 9)], "k int, name bigint")
    assert rows(sections.resolve(df, "name", a), "k") == [(1, "x"), (2, None), (3, None)]


def test_longest_mount(spark):
    paths = spark.createDataFrame([("/a/b/c",), ("/a/x",), ("/q",)], "path string")
    mounts = spark.createDataFrame([("/", 1), ("/a", 2), ("/a/b", 3)], "mount string, dev int")
    assert rows(joins.longest_prefix(paths, "path", mounts, "mount", ["dev"]).select("path", "mount", "dev"), "path") == [("/a/b/c", "/a/b", 3), ("/a/x", "/a", 2), ("/q", "/", 1)]


def test_queries_by_version(spark):
    assert "checkpoint_write_time" in PG["pg_stat_checkpointer"].query(160000)
    assert "num_timed" in PG["pg_stat_checkpointer"].query(170002)
    with pytest.raises(ValueError, match="no query"):
        PG["pg_stat_io"].query(150000)
    assert as_json(spark.range(1)).first().json == '{"id":"0"}'


def test_metrics(spark, tmp_path):
    from tidemark.operators import metrics

    life = spark.createDataFrame([("ready", None), ("child_process_crash", 9), ("child_process_crash", 9), ("error_group", None)], "kind string, signal int")
    assert rows(metrics.lifecycle_counts(life), "what", "signal") == [("child_process_crash", 9, 2), ("ready", None, 1)]
    cells = spark.createDataFrame([(1, "a", 5), (2, "a", 7)], "segment_id int, entity string, value int")
    metrics.refresh_cells(cells, f"{tmp_path}/c", "segment_id")
    metrics.refresh_cells(cells.where("segment_id = 2").withColumn("value", F.lit(9)), f"{tmp_path}/c", "segment_id")
    assert rows(spark.read.parquet(f"{tmp_path}/c").select("segment_id", "value"), "segment_id") == [(1, 5), (2, 9)]
    with pytest.raises(ValueError, match="16"):
        metrics.aligned(cells, ["entity"], [str(k) for k in range(17)])


def test_notable_and_floors(spark):
    note = lambda *a: one(spark, events.notable(*(F.lit(x) for x in a)).alias("n"))["n"]
    assert tuple(note("child_process_crash", "LOG", None, 9)) == ("server_child_sigkill", 0)
    assert tuple(note("child_process_crash", "LOG", None, 11)) == ("server_child_signal_termination", 2)
    assert tuple(note("error_group", "PANIC", "53100", None)) == ("panic_severity_observation", 0)
    assert tuple(note("error_group", "ERROR", "40P01", None)) == ("deadlock_observation", 3)
    assert note("slow_query", "LOG", None, None) is None
    floor = lambda *a: one(spark, events.floor_class(*(F.lit(x) for x in a)).alias("n"))["n"]
    assert [floor("PANIC", None, True), floor("ERROR", "XX001", True), floor("PANIC", None, False)] == ["availability", "integrity", None]


def test_typed_messages(spark):
    df = spark.createDataFrame([(t,) for t in ("duration: 12.5 ms  statement: x", "temporary file: path \"p\", size 99", "database system is ready to accept connections", "nothing")], "message string")
    assert [tuple(r)[1:] for r in events.typed_events(df).collect()] == [("slow_query", "12.5"), ("temp_file", "99"), ("ready", None), (None, None)]


def test_rules_and_dispatch(spark):
    least = next(r for r in incidents.RULES if r.id == "OS-MEM-022")
    df = spark.createDataFrame([(1, 1, 50, 100), (1, 2, 4, 100), (2, 1, 50, 100)], "cluster int, ts int, mem_available int, mem_total int")
    assert rows(incidents.findings(df, least, ["cluster"], []).select("cluster", "rule", "value"), "cluster") == [(1, "OS-MEM-022", 0.04)]
    wal = next(r for r in incidents.RULES if r.id == "PG-WAL-009")
    few = spark.createDataFrame([(1, t, 1, 1, dt) for t, dt in ((1, 10), (2, 10), (3, None), (4, None))], "cluster int, ts int, wal_fpi int, wal_records int, dt int")
    assert incidents.findings(few, wal, ["cluster"], []).count() == 0
    seen = spark.createDataFrame([(7, "pg_stat_wal")], "cluster int, section string")
    assert rows(incidents.dispatch(seen, ["cluster"]), "rule") == [(7, "PG-WAL-009")]
