"""Queries of column functions, log text, parsers, sections and streams, with their SQL. Lines of files are made of the
events' own numbers, so the SQL knows what a parser must find."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import cells
from tidemark.functions import scalar as sc
from tidemark.functions.session import scratch
from tidemark.operators import events as logs
from tidemark.operators import frames, incidents
from tidemark.plans.catalog import _CN, _EV, DAY, GAPS, HOUR, T0, _gap_sql, cn, ev, query, table
from tidemark.sources import external, layouts, procfs, sections
from tidemark.streaming import live

# ---- values ----------------------------------------------------------------------------------------------------------------


@query(f"WITH {_EV}, x AS (SELECT event_id, us, v, CASE event_id % 5 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) ELSE value END AS g, event_id % 3 = 0 AS b FROM ev) SELECT event_id, CASE WHEN isfinite(g) THEN g END AS number, CAST(b AS INTEGER)::DOUBLE AS flag, us::DOUBLE AS time, CAST(NULL AS DOUBLE) AS word FROM x")
def gauge_coercion(s, d):
    """Gauges as doubles: what isn't finite or a number breaks the series."""
    e = table(s, d, "events").withColumns({"g": F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 5 == 1, float("inf")).otherwise(F.col("value")), "b": F.col("event_id") % 3 == 0})
    return e.select("event_id", sc.gauge_value(F.col("g"), "double").alias("number"), sc.gauge_value(F.col("b"), "boolean").alias("flag"), sc.gauge_value(F.col("ts"), "timestamp").alias("time"), sc.gauge_value(F.col("event_type"), "string").alias("word"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey * 1000000000000 <= 9007199254740992 THEN CAST(o_orderkey * 1000000000000 AS DOUBLE) END AS exact, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 3 * 1000000 AS BIGINT) END AS lag_us FROM orders")
def exact_integers_and_lags(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k, sc.exact_integer(k * 1_000_000_000_000).alias("exact"), sc.lag_micros(F.when(k % 3 > 0, k % 3).otherwise(F.lit(-1.0))).alias("lag_us"))


_TWO = _CN + ", t AS (SELECT user_id, us, n, CASE WHEN event_id % 7 > 0 THEN n * 2 END AS m, CASE WHEN user_id % 2 = 0 THEN n END AS q FROM cn), w AS (SELECT *, lag(us) OVER w AS pu, lag(n) OVER w AS pn, lag(m) OVER w AS pm, lag(q) OVER w AS pq FROM t WINDOW w AS (PARTITION BY user_id ORDER BY us))"
_PAIR = f"CASE WHEN pu IS NULL THEN 'missing' WHEN {_gap_sql('pu', 'us')} THEN 'gap' END"


def _one(a: str, b: str) -> str:
    return f"coalesce({_PAIR}, CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'missing' WHEN {a} < {b} THEN 'reset' END)"


def _then(r: str, one: str) -> str:
    return f"CASE WHEN {r} IS NULL AND {one} IS NULL THEN NULL WHEN {one} IN ('reset', 'gap') THEN {one} ELSE 'missing' END"


_NULLABLE = f"CASE WHEN q IS NULL AND pq IS NULL THEN NULL ELSE {_one('q', 'pq')} END"


@query(
    f"WITH {_TWO}, r AS (SELECT *, {_one('n', 'pn')} AS rn, {_then(_one('n', 'pn'), _one('m', 'pm'))} AS rs, {_then(_one('n', 'pn'), _NULLABLE)} AS rz FROM w) "
    "SELECT user_id, us, rn AS reason, CASE WHEN rn IS NULL THEN CAST(n - pn AS DOUBLE) END AS delta, rs AS sum_reason, CASE WHEN rs IS NULL THEN CAST(n - pn + m - pm AS DOUBLE) END AS sum_delta, rz AS nullable_reason, CASE WHEN rz IS NULL THEN CAST(n - pn + coalesce(q - pq, 0) AS DOUBLE) END AS nullable_delta FROM r"
)
def delta_cells(s, d):
    """Deltas and their sums with the reason where there is none."""
    from tidemark.operators.series import in_spans, ordered

    w = ordered(["user_id"], "us")
    t = cn(s, d).select("user_id", "us", "n", F.when(F.col("event_id") % 7 > 0, F.col("n") * 2).alias("m"), F.when(F.col("user_id") % 2 == 0, F.col("n")).alias("q"))
    t = t.withColumns({f"p{c}": F.lag(c).over(w) for c in ("us", "n", "m", "q")})
    pair = F.when(F.col("pus").isNull(), "missing").when(in_spans(F.col("pus"), F.col("us"), GAPS), "gap")
    n, m, q = ((F.col(c), F.col(f"p{c}")) for c in ("n", "m", "q"))
    t = t.withColumns({"a": cells.delta(*n, pair), "b": cells.delta_sum([n, m], pair), "c": cells.delta_sum([n, q], pair, nullable=True)})
    return t.select("user_id", "us", *(F.col(f"{x}.{f}").alias(name) for x, f, name in (("a", "reason", "reason"), ("a", "value", "delta"), ("b", "reason", "sum_reason"), ("b", "value", "sum_delta"), ("c", "reason", "nullable_reason"), ("c", "value", "nullable_delta"))))


@query(f"WITH {_EV}, b AS (SELECT user_id, day, max(value) AS x FROM ev GROUP BY ALL), m AS (SELECT *, max(x) OVER (PARTITION BY user_id) AS most FROM b) SELECT user_id, day, CAST(floor(x / most * 255.0 + 0.5) AS INTEGER) AS code, round(floor(x / most * 255.0 + 0.5) / 255.0 * most, 9) AS value FROM m")
def quantized_cells(s, d):
    from pyspark.sql import Window

    b = ev(s, d).groupBy("user_id", "day").agg(F.max("value").alias("x")).withColumn("most", F.max("x").over(Window.partitionBy("user_id")))
    code = cells.quantized(F.col("x"), F.col("most"))
    return b.select("user_id", "day", code.alias("code"), F.round(cells.dequantized(code, F.col("most")), 9).alias("value"))


_LITTLE = "regexp_replace(printf('%016X', {0}), '(..)(..)(..)(..)(..)(..)(..)(..)', '\\8\\7\\6\\5\\4\\3\\2\\1')"


@query(f"WITH {_EV} SELECT event_id, rtrim(translate(to_base64(unhex('01' || '03' || {_LITTLE.format('us')} || CASE WHEN event_id % 4 = 0 THEN '00' ELSE '02' || substr({_LITTLE.format('user_id')}, 1, 8) END || '07' || CASE WHEN v % 2 = 0 THEN '01' ELSE '00' END)), '+/', '-_'), '=') AS token, us AS a, CASE WHEN event_id % 4 > 0 THEN user_id END AS b, v % 2 = 0 AS c FROM ev")
def identity_tokens(s, d):
    values = [(F.col("us"), "bigint"), (F.when(F.col("event_id") % 4 > 0, F.col("user_id")).cast("int"), "int"), (F.col("v") % 2 == 0, "boolean")]
    e = ev(s, d).withColumn("token", cells.identity_token(values))
    a, b, c = cells.token_values(F.col("token"), ["bigint", "int", "boolean"])
    return e.select("event_id", "token", a.alias("a"), b.alias("b"), c.alias("c"))


_KEY = b"a key of the tests"
_IN, _OUT = ("".join(f"{b ^ x:02x}" for b in _KEY.ljust(64, b"\0")) for x in (0x36, 0x5C))


@query(f"WITH {_EV} SELECT event_id, substr(sha256(event_type || chr(31) || user_id), 1, 24) AS short, sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode(event_type || event_id)))) AS signed FROM ev")
def hashed_ids(s, d):
    return ev(s, d).select("event_id", cells.short_id(F.col("event_type"), F.col("user_id").cast("string")).alias("short"), cells.hmac_sha256(_KEY, F.concat("event_type", F.col("event_id").cast("string"))).alias("signed"))


def _mix_sql(x: str) -> str:
    out = f"(({x})::UHUGEINT + 11400714819323198485) % 18446744073709551616"
    for shift, by in ((30, 13787848793156543929), (27, 10723151780598845931)):
        out = f"(xor(({out})::UBIGINT, ({out})::UBIGINT >> {shift})::UHUGEINT * {by}) % 18446744073709551616"
    return f"xor(({out})::UBIGINT, ({out})::UBIGINT >> 31)"


_BLOOM = f"ids AS (SELECT DISTINCT 1000000 + user_id * 1000 + day AS id, event_type FROM ev), h AS (SELECT id, event_type, {_mix_sql('id')} AS a, {_mix_sql('xor(id::UBIGINT, 11400714819323198485::UBIGINT)')} | 1 AS b FROM ids), bits AS (SELECT id, event_type, unnest(range(0, 8)) AS k, a, b FROM h), places AS (SELECT id, event_type, CAST((a::UHUGEINT + k::UHUGEINT * b::UHUGEINT) % 512 AS INTEGER) AS bit FROM bits)"


@query(f"WITH {_EV}, {_BLOOM}, s AS (SELECT event_type, list_sort(list(DISTINCT bit)) AS bits FROM places WHERE id % 40 = 0 GROUP BY event_type), q AS (SELECT id, list(bit) AS mine FROM places GROUP BY id) SELECT s.event_type, len(any_value(s.bits)) AS set_bits, count(*) FILTER (list_has_all(s.bits, q.mine)) AS may_contain FROM s, q GROUP BY s.event_type")
def membership_summary(s, d):
    """Bits of the ids of some segments, and how many of all ids they may hold: none of theirs is denied."""
    ids = ev(s, d).select((1_000_000 + F.col("user_id") * 1000 + F.col("day")).alias("id"), "event_type").distinct()
    sums = ids.where("id % 40 = 0").select("event_type", F.explode(cells.bloom_bits(F.col("id"))).alias("bit")).groupBy("event_type").agg(F.array_sort(F.collect_set("bit")).alias("bits"))
    hits = ids.select("id").distinct().crossJoin(F.broadcast(sums))  # a summary has 512 bits at most, one row for each of few kinds
    return hits.groupBy("event_type").agg(F.max(F.size("bits")).cast("bigint").alias("set_bits"), F.count_if(cells.bloom_may_contain(F.col("bits"), F.col("id"))).alias("may_contain"))


_SECTIONS = "CASE event_id % 4 WHEN 0 THEN 'pg_log_checkpoints' WHEN 1 THEN 'pg_log_lifecycle' WHEN 2 THEN 'pg_log_errors' ELSE 'pg_settings' END"


@query(
    f"WITH {_EV} SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE v % 4 WHEN 0 THEN 'pg.checkpoint.started' WHEN 1 THEN 'pg.checkpoint.completed' ELSE 'pg.checkpoint.too_frequent_reported' END WHEN 1 THEN CASE v % 4 WHEN 0 THEN 'pg.lifecycle.child_signal_termination' WHEN 1 THEN 'pg.lifecycle.child_process_crash' WHEN 2 THEN 'pg.lifecycle.shutdown_requested' ELSE 'pg.lifecycle.ready_observed' END "
    "WHEN 2 THEN 'pg.log.error_group_observed' ELSE 'pg_settings' END AS kind, CASE v % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'fatal' WHEN 2 THEN 'panic' WHEN 3 THEN 'warning' WHEN 4 THEN 'log' END AS severity, CASE event_id % 5 WHEN 0 THEN 'SCHED_OTHER' WHEN 1 THEN 'SCHED_FIFO' WHEN 2 THEN 'SCHED_RR' WHEN 3 THEN 'SCHED_BATCH' END AS policy, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'sleeping' END AS state FROM ev"
)
def code_names(s, d):
    e = ev(s, d).withColumn("section", F.expr(_SECTIONS))
    state = F.when(F.col("event_id") % 3 == 0, F.char(F.lit(82))).when(F.col("event_id") % 3 == 1, F.char(F.lit(83))).otherwise("?")
    return e.select("event_id", cells.event_kind(F.col("section"), F.col("v") % 4).alias("kind"), sc.named((F.col("v") % 6).cast("int"), cells.SEVERITY_CODES).alias("severity"), sc.named((F.col("event_id") % 5).cast("int"), sc.SCHEDULERS).alias("policy"), sc.named(state, sc.PROCESS_STATES).alias("state"))


@query(
    f"WITH {_EV}, x AS (SELECT event_id, us, v, user_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS a, 'é' || event_type || '😀' || user_id AS t FROM ev) SELECT event_id, CASE WHEN a IS NULL THEN 'w' ELSE a || ':w' END AS joined, CASE WHEN a IS NULL THEN CAST(user_id AS VARCHAR) ELSE a || '.' || user_id END AS qualified, coalesce(CASE WHEN v % 2 = 0 THEN v END, CASE WHEN v % 3 = 0 THEN -v END, 0) AS first_known, "
    f"CASE WHEN event_id % 4 > 0 THEN {T0} - (us - v) END AS age_us, CASE WHEN event_id % 4 > 0 THEN round(({T0} - (us - v)) / 1000000.0, 6) END AS age_s, octet_length(encode(left(t, 1 + length(a)))) AS cut FROM x"
)
def value_helpers(s, d):
    a = F.when(F.col("event_id") % 3 > 0, F.col("event_type"))
    start = F.when(F.col("event_id") % 4 > 0, F.col("us") - F.col("v"))
    text = F.concat(F.lit("é"), "event_type", F.lit("😀"), F.col("user_id").cast("string"))
    return ev(s, d).select(
        "event_id", sc.join_non_null(a, F.lit("w")).alias("joined"), sc.qualify(a, F.col("user_id").cast("string")).alias("qualified"), F.coalesce(F.when(F.col("v") % 2 == 0, F.col("v")), F.when(F.col("v") % 3 == 0, -F.col("v")), F.lit(0)).alias("first_known"),
        cells.age(F.lit(T0), start).alias("age_us"), F.round(cells.age(F.lit(T0), start, 1_000_000), 6).alias("age_s"), F.octet_length(F.left(text, 1 + F.length(a))).cast("bigint").alias("cut"),
    )


@query(f"WITH {_EV}, x AS (SELECT event_id, 'é' || event_type || '😀' AS t, octet_length(encode('é' || event_type)) AS n FROM ev) SELECT event_id, CASE event_id % 4 WHEN 0 THEN t WHEN 1 THEN left(t, length(t) - 1) WHEN 2 THEN '' ELSE 'é' END AS cut FROM x")
def truncated_text(s, d):
    """Byte limits that fall behind, inside and before characters."""
    text = F.concat(F.lit("é"), "event_type", F.lit("😀"))
    out = None
    for event_type in ("click", "view", "signup", "purchase", "error"):
        whole = len(f"é{event_type}😀".encode())
        for k, limit in enumerate((whole, whole - 1, 1, 2)):
            hit = (F.col("event_type") == event_type) & (F.col("event_id") % 4 == k)
            cut = sc.truncate_bytes(text, limit)
            out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return ev(s, d).select("event_id", out.alias("cut"))


@query("SELECT round(sum(x), 6) AS total, count(x) AS known FROM (SELECT CASE WHEN l_quantity > 0 THEN (l_extendedprice * 100 + 250) * 1000 / 15000000.0 END AS x FROM lineitem)")
def parsed_durations(s, d):
    """Lengths of time as parameters: 250ms and 15s."""
    li = table(s, d, "lineitem")
    x = sc.rate(F.col("l_extendedprice") * 100 + F.lit(sc.duration_micros("250ms") // 1000), F.lit(sc.duration_micros("15")), 1000.0 / 1e6)
    return li.select(F.when(F.col("l_quantity") > 0, x).alias("x")).agg(F.round(F.sum("x"), 6).alias("total"), F.count("x").alias("known"))


@query(f"WITH {_EV} SELECT event_id, CASE WHEN v % 4 = 0 THEN NULL ELSE v END AS \"limit\", v * 1024 AS bytes, round(CASE WHEN v % 3 > 0 THEN greatest(v - us % 1000, 0) / (v % 3 * 0.5) END, 9) AS served FROM ev")
def unit_conversions(s, d):
    v = F.col("v")
    limit = sc.limit_value(F.when(v % 4 == 0, "max").otherwise(F.concat(F.lit(" "), v.cast("string"))))
    return ev(s, d).select("event_id", limit.alias("limit"), sc.kib(v).alias("bytes"), F.round(sc.cache_served(v, F.col("us") % 1000, v % 3 * 500_000), 9).alias("served"))


@query("SELECT doc, CAST(k AS INTEGER) AS k, item, has FROM (SELECT o_orderkey AS doc, unnest(range(0, 3)) AS k, unnest([o_custkey, o_orderkey % 7, 3]) AS item, list_contains([o_custkey, o_orderkey % 7, 3], 5) AS has FROM orders)")
def array_display(s, d):
    a = F.array(F.col("o_custkey").cast("int"), (F.col("o_orderkey") % 7).cast("int"), F.lit(3))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("doc"), a.alias("a"))
    return o.select("doc", F.posexplode("a").alias("k", "item"), F.array_contains("a", 5).alias("has")).withColumn("item", F.col("item").cast("bigint"))


@query("SELECT '{\"c_custkey\":\"' || c_custkey || '\",\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}' AS json FROM customer")
def json_rows(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"))
    return external.as_json(c)


@query("SELECT '# TYPE orders_total counter' AS line UNION ALL SELECT 'orders_total{status=\"' || o_orderstatus || '\",priority=\"' || o_orderpriority || '\"} ' || n FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def exposition_lines(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return external.exposition(o, "orders_total", ("status", "priority"), "n", "counter")


@query("SELECT c_custkey FROM customer WHERE lower(c_name) LIKE '%1_' OR lower(c_mktsegment) LIKE '%1_' OR lower(CAST(c_nationkey AS VARCHAR)) LIKE '%1_'")
def any_column_search(s, d):
    """A bare term holds for the label or any of the columns."""
    c = table(s, d, "customer")
    return c.where(sc.search(dict(c.dtypes), "c_name", ["c_mktsegment", "c_nationkey"], "*1?")).select("c_custkey")


@query(f"WITH {_EV} SELECT event_id, us FROM ev WHERE event_type = 'error' AND us BETWEEN {T0} AND {T0 + 2 * DAY}")
def kind_filter(s, d):
    """Exact, case-sensitive kinds of one section in a range."""
    rows = frames.section_rows(ev(s, d).withColumn("kind", F.col("event_type")), T0, T0 + 2 * DAY, ["event_id", "us", "kind"], "us")
    return logs.of_kind(rows, "error").select("event_id", "us")


@query("WITH f AS (SELECT c_nationkey AS cluster, CASE WHEN c_custkey % 2 = 0 THEN 'PG-WAL-009' ELSE 'OS-CPU-020' END AS rule, c_name AS entity, c_acctbal AS value FROM customer WHERE c_acctbal > 5000), o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rule, entity) AS k, count(*) OVER (PARTITION BY cluster) AS n FROM f) SELECT cluster, rule, entity, k AS position, n > 6 AS truncated FROM o WHERE k <= 6")
def finding_order(s, d):
    """Findings of a cluster in an order that doesn't depend on the rules', six at most, and whether some are left out."""
    c = table(s, d, "customer").where("c_acctbal > 5000")
    f = c.select(F.col("c_nationkey").alias("cluster"), F.when(F.col("c_custkey") % 2 == 0, "PG-WAL-009").otherwise("OS-CPU-020").alias("rule"), F.col("c_name").alias("entity"), F.col("c_acctbal").alias("value"))
    return incidents.bounded_findings(f, ["cluster"], 6).select("cluster", "rule", "entity", "position", "truncated")


# ---- log text --------------------------------------------------------------------------------------------------------------

_LINE = "strftime(make_timestamp({0}), '%Y-%m-%d %H:%M:%S.%f')"
_WORDS = {"click": ("LOG", "LOG"), "view": ("ПРЕДУПРЕЖДЕНИЕ", "WARNING"), "error": ("ERROR", "ERROR"), "purchase": ("ВАЖНО", "FATAL"), "signup": ("PANIC", "PANIC")}


def _log_lines(s, d):
    """An event's line; errors also have a DETAIL line and one more line of it."""
    e = ev(s, d)
    word = sc.named(F.col("event_type"), {k: v[0] for k, v in _WORDS.items()})
    stamp = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    state = F.when(F.col("event_type") == "error", F.concat(F.lpad((F.col("v") % 100000).cast("string"), 5, "0"), F.lit(": "))).otherwise("")
    head = F.concat(stamp, F.lit(" UTC ["), "user_id", F.lit("] "), word, F.lit(":  "), state, F.lit("event "), "event_id")
    more = F.when(F.col("event_type") == "error", F.array(F.concat(stamp, F.lit(" UTC ["), "user_id", F.lit("] DETAIL:  value "), "v"), F.concat(F.lit("\tof user "), "user_id"))).otherwise(F.array().cast("array<string>"))
    lines = e.select("event_id", F.posexplode(F.concat(F.array(head), more)).alias("k", "value"))
    return lines.select(F.lit("f").alias("file"), (F.col("event_id") * 4 + F.col("k")).alias("line"), "event_id", "k", "value")


_SEVERITY = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in _WORDS.items()) + " END"


@query(f"WITH {_EV} SELECT event_id * 4 AS line, us AS ts, {_SEVERITY} AS severity, CASE WHEN event_type = 'error' THEN lpad(CAST(v % 100000 AS VARCHAR), 5, '0') END AS sqlstate, 'event ' || event_id AS message, CAST(NULL AS VARCHAR) AS continuation FROM ev UNION ALL SELECT event_id * 4 + 1, us, NULL, NULL, 'value ' || v, 'detail' FROM ev WHERE event_type = 'error' UNION ALL SELECT event_id * 4 + 2, NULL, NULL, NULL, chr(9) || 'of user ' || user_id, NULL FROM ev WHERE event_type = 'error'")
def log_lines(s, d):
    return logs.parse_lines(_log_lines(s, d)).select("line", "ts", "severity", "sqlstate", "message", "continuation")


@query(f"WITH {_EV} SELECT event_id * 4 AS line, us AS ts, {_SEVERITY} AS severity, 'event ' || event_id AS message, CASE WHEN event_type = 'error' THEN 'value ' || v END AS detail, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS rest FROM ev")
def log_assembly(s, d):
    parsed = logs.parse_lines(_log_lines(s, d).withColumn("stream", F.col("event_id") % 16))
    return logs.assemble(parsed, ["file", "stream"], "line").select("line", "ts", "severity", "message", "detail", "rest")


_KINDS = {
    0: ("'checkpoint starting: time ' || v", "checkpoint_starting", "'time ' || v"),
    1: ("'checkpoint complete: wrote ' || v || ' buffers (1.0%); 0 WAL file(s) added'", "checkpoint_complete", "CAST(v AS VARCHAR)"),
    2: ("'automatic vacuum of table \"db.public.t' || user_id || '\": index scans: 1'", "autovacuum", "'db.public.t' || user_id"),
    3: ("'duration: ' || v || '.250 ms  statement: select 1'", "slow_query", "v || '.250'"),
    4: ("'process ' || user_id || ' still waiting for ShareLock on transaction 7 after 1000.1 ms'", "lock_wait", "CAST(user_id AS VARCHAR)"),
    5: ("'temporary file: path \"base/pgsql_tmp/x\", size ' || v", "temp_file", "CAST(v AS VARCHAR)"),
    6: ("'server process (PID 7) was terminated by signal ' || user_id || ': Killed'", "child_process_crash", "CAST(user_id AS VARCHAR)"),
    7: ("'database system is ready to accept connections'", "ready", "NULL"),
    8: ("'received fast shutdown request'", "shutdown", "'fast'"),
    9: ("'nothing of the kind ' || v", None, "NULL"),
}


def _pick(k: int) -> str:
    return "CASE event_id % 10 " + " ".join(f"WHEN {n} THEN {'NULL' if x[k] is None else x[k] if k != 1 else repr(x[k])}" for n, x in _KINDS.items()) + " END"


@query(f"WITH {_EV} SELECT event_id, {_pick(1)} AS kind, {_pick(2)} AS detail_value FROM ev")
def typed_log_events(s, d):
    return logs.typed_events(ev(s, d).withColumn("message", F.expr(_pick(0)))).select("event_id", "kind", "detail_value")


@query(
    f"WITH {_EV}, q AS (SELECT *, event_id % 10 AS k FROM ev) SELECT event_id, CASE WHEN k = 1 THEN v END AS buffers, CASE WHEN k = 1 THEN CAST(1.5 AS DOUBLE) END AS write_s, CASE WHEN k = 2 THEN 'db.public.t' || user_id END AS relation, CASE WHEN k = 2 THEN v END AS tuples_removed, CASE WHEN k = 3 THEN CAST(v AS DOUBLE) + 0.25 END AS duration_ms, CASE WHEN k IN (4, 6) THEN user_id END AS pid, CASE WHEN k = 4 THEN 'ShareLock' END AS lock_mode, CASE WHEN k = 4 THEN CAST(v AS DOUBLE) END AS waited_ms, CASE WHEN k = 5 THEN v END AS temp_bytes, CASE WHEN k = 6 THEN 9 END AS signal, CASE WHEN k = 8 THEN 'fast' END AS shutdown_mode FROM q"
)
def log_event_fields(s, d):
    """The typed fields of messages of a known form."""
    texts = {
        1: "'checkpoint complete: wrote ' || v || ' buffers (1.0%); 0 WAL file(s) added, 0 removed, 1 recycled; write=1.500 s, sync=0.002 s, total=1.600 s'",
        2: "'automatic vacuum of table \"db.public.t' || user_id || '\": index scans: 1\n\tpages: 0 removed, 10 remain\n\ttuples: ' || v || ' removed, 5 remain'",
        3: "'duration: ' || v || '.250 ms  statement: select 1'",
        4: "'process ' || user_id || ' still waiting for ShareLock on transaction 7 after ' || v || '.000 ms'",
        5: "'temporary file: path \"base/pgsql_tmp/x\", size ' || v",
        6: "'server process (PID ' || user_id || ') was terminated by signal 9: Killed'",
        8: "'received fast shutdown request'",
    }
    case = "CASE event_id % 10 " + " ".join(f"WHEN {k} THEN {t}" for k, t in texts.items()) + " ELSE 'else' END"
    return logs.event_fields(ev(s, d).withColumn("message", F.expr(case.replace("\n", "\\n").replace("\t", "\\t")))).select(
        "event_id", "buffers", "write_s", "relation", "tuples_removed", "duration_ms", "pid", "lock_mode", "waited_ms", "temp_bytes", "signal", "shutdown_mode"
    )


@query(f"WITH {_EV} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_type = 'signup' THEN 'availability' WHEN v % 4 = 0 THEN 'integrity' END AS floor FROM ev")
def floor_classes(s, d):
    severity = sc.named(F.col("event_type"), {k: v[1] for k, v in _WORDS.items()})
    return ev(s, d).select("event_id", logs.floor_class(severity, F.when(F.col("v") % 4 == 0, "XX001").otherwise("23505"), F.col("event_id") % 3 != 0).alias("floor"))


# ---- parsers ---------------------------------------------------------------------------------------------------------------


def _text(s, d, expr: str):
    return ev(s, d).select(F.col("event_id").alias("line"), "user_id", F.expr(expr).alias("value"))


@query(f"WITH {_EV} SELECT CAST(CASE WHEN user_id = 1 THEN -1 ELSE user_id END AS INTEGER) AS cpu_id, v AS user, day AS system, event_id AS idle FROM ev")
def proc_cpu(s, d):
    rows = _text(s, d, "concat('cpu', CASE WHEN user_id = 1 THEN '' ELSE string(user_id) END, '  ', v, ' 0 ', day, ' ', event_id, ' 1 2 3 4 5 6')")
    return procfs.cpu(rows).select("cpu_id", "user", "system", "idle")


@query(f"WITH {_EV} SELECT event_type || user_id AS name, v * CASE WHEN event_id % 2 = 0 THEN 1024 ELSE 1 END AS number FROM ev")
def proc_key_values(s, d):
    return procfs.key_values(_text(s, d, "concat(event_type, user_id, CASE WHEN event_id % 2 = 0 THEN concat(':   ', v, ' kB') ELSE concat(' ', v) END)"))


@query(f"WITH {_EV} SELECT CAST(user_id AS BIGINT) AS major, CAST(day AS BIGINT) AS minor, 'sd' || user_id AS device, v AS reads, v + 1 AS sectors_read, event_id AS io_ms FROM ev")
def proc_disks(s, d):
    rows = _text(s, d, "concat('  ', user_id, '  ', day, ' sd', user_id, ' ', v, ' 2 ', v + 1, ' 4 5 6 7 8 9 ', event_id, ' 11')")
    return procfs.diskstats(rows).select("major", "minor", "device", "reads", "sectors_read", "io_ms")


@query(f"WITH {_EV} SELECT 'eth' || user_id AS interface, v AS rx_bytes, day AS rx_errs, event_id AS tx_bytes FROM ev")
def proc_networks(s, d):
    rows = _text(s, d, "concat('  eth', user_id, ': ', v, ' 1 ', day, ' 3 4 5 6 7 ', event_id, ' 9 10 11 12 13 14 15')")
    return procfs.netdev(rows).select("interface", "rx_bytes", "rx_errs", "tx_bytes")


@query(f"WITH {_EV} SELECT CASE WHEN v % 2 = 0 THEN 'some' ELSE 'full' END AS kind, CAST(day + 0.25 AS DOUBLE) AS avg10, event_id AS total_us FROM ev")
def proc_pressure(s, d):
    rows = _text(s, d, "concat(CASE WHEN v % 2 = 0 THEN 'some' ELSE 'full' END, ' avg10=', day, '.25 avg60=0.00 avg300=1.50 total=', event_id)")
    return procfs.pressure(rows).select("kind", "avg10", "total_us")


@query(f"WITH {_EV} SELECT CAST(event_id AS INTEGER) AS pid, 'a) b' || user_id AS comm, 'S' AS state, CAST(user_id AS BIGINT) AS ppid, v AS utime, CAST(day AS BIGINT) AS stime FROM ev")
def proc_processes(s, d):
    rows = _text(s, d, "concat(event_id, ' (a) b', user_id, ') S ', user_id, ' 2 3 4 5 6 7 8 9 10 ', v, ' ', day, ' 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29 30 31 32 33 34 35 36 37 38 39')")
    return procfs.process_stat(rows).select("pid", "comm", "state", "ppid", "utime", "stime")


@query(f"WITH {_EV} SELECT CAST(event_id AS BIGINT) AS pid, v AS rmem_kb, CAST(user_id AS BIGINT) AS num_threads, CASE WHEN event_id % 2 = 0 THEN day END AS nvcsw, v * 3 AS rchar FROM ev")
def proc_status_and_io(s, d):
    e = ev(s, d).withColumnRenamed("event_id", "pid")
    lines = F.array(F.concat(F.lit("VmRSS:\t  "), "v", F.lit(" kB")), F.concat(F.lit("Threads:\t"), "user_id"), F.when(F.col("pid") % 2 == 0, F.concat(F.lit("voluntary_ctxt_switches:\t"), "day")).otherwise("Name:\tx"))
    status = procfs.process_status(e.select("pid", F.explode(lines).alias("value")), ["pid"])
    io = procfs.process_io(e.select("pid", F.explode(F.array(F.concat(F.lit("rchar: "), (F.col("v") * 3).cast("string")), F.lit("wchar: 0"))).alias("value")), ["pid"])
    return status.join(io, "pid").select("pid", "rmem_kb", "num_threads", "nvcsw", "rchar")


@query(f"WITH {_EV} SELECT event_id AS mount_id, CAST(user_id AS BIGINT) AS parent_id, '8:' || day AS device, '/mnt/a b' || user_id AS mount_point, 'ext4' AS fs_type, '/dev/sd' || user_id AS source FROM ev")
def proc_mounts(s, d):
    rows = _text(s, d, r"concat(event_id, ' ', user_id, ' 8:', day, ' / /mnt/a\\040b', user_id, ' rw,noatime shared:', day, ' - ext4 /dev/sd', user_id, ' rw')")
    return procfs.mountinfo(rows).select("mount_id", "parent_id", "device", "mount_point", "fs_type", "source")


@query(f"WITH {_EV}, t AS (SELECT user_id, CAST(sum(v) AS BIGINT) AS a, count(*) AS b FROM ev GROUP BY user_id) SELECT 'P' || user_id AS protocol, 'InSegs' AS name, a AS number FROM t UNION ALL SELECT 'P' || user_id, 'OutSegs', b FROM t")
def proc_protocols(s, d):
    t = ev(s, d).groupBy("user_id").agg(F.sum("v").alias("a"), F.count("*").alias("b"))
    two = F.array(F.concat(F.lit("P"), "user_id", F.lit(": InSegs OutSegs")), F.concat(F.lit("P"), "user_id", F.lit(": "), "a", F.lit(" "), "b"))
    return procfs.protocol_counters(t.select(F.posexplode(two).alias("line", "value")))


@query(f"WITH {_EV} SELECT '8:' || user_id AS device, v AS rbytes, event_id AS wios FROM ev WHERE v % 2 = 0 UNION ALL SELECT 'path', v, event_id FROM ev WHERE v % 2 > 0 AND event_type = 'none'")
def cgroup_devices(s, d):
    rows = _text(s, d, "CASE WHEN v % 2 = 0 THEN concat('8:', user_id, ' rbytes=', v, ' wbytes=1 rios=2 wios=', event_id, ' dbytes=0') ELSE concat('rbytes=', v) END")
    return procfs.cgroup_io(rows).select("device", "rbytes", "wios")


@query(f"WITH {_EV} SELECT CASE WHEN v % 2 = 0 THEN 'cpu,cpuacct' END AS controllers, '/a:b/' || user_id AS path, count(*) AS n FROM ev GROUP BY ALL")
def cgroup_paths(s, d):
    rows = _text(s, d, "concat(CASE WHEN v % 2 = 0 THEN '4:cpu,cpuacct:' ELSE '0::' END, '/a:b/', user_id)")
    return procfs.cgroup_path(rows).groupBy("controllers", "path").agg(F.count("*").alias("n"))


# ---- sections --------------------------------------------------------------------------------------------------------------


@query("WITH l(type_id, section, columns) AS (VALUES " + ", ".join(f"({x.type_id}, '{x.section}', {sum(x.classes)})" for x in layouts.LAYOUTS) + ") SELECT section, count(*) AS layouts, max(columns) AS columns, max(type_id) AS newest FROM l GROUP BY section")
def section_catalogue(s, d):
    return layouts.listing(s).select("section", F.size("layouts").cast("bigint").alias("layouts"), "columns", F.array_max("layouts").cast("int").alias("newest"))


_FIELDS = (sections.Field("ts", "bigint", "timestamp"), sections.Field("user_id", "bigint", "label"), sections.Field("event_id", "bigint", "label"), sections.Field("v", "bigint", "gauge", True))
_OLD = sections.Contract(1, "samples", "event_stream", _FIELDS, ("ts", "event_id"))
_NEW = sections.Contract(2, "samples", "event_stream", (*_FIELDS, sections.Field("kind", "bigint", "label", True)), ("ts", "event_id"))


@query(f"WITH {_EV} SELECT us AS ts, user_id, event_id, v, CASE WHEN day >= 15 THEN user_id % 4 END AS kind, CAST(CASE WHEN day < 15 THEN 1 WHEN day < 22 THEN 2 ELSE 3 END AS BIGINT) AS segment_id FROM ev WHERE us BETWEEN {T0 + DAY} AND {T0 + 28 * DAY}")
def section_round_trip(s, d):
    """Segments written by two layouts, one of them sealed from live parts, and read back on the union of their columns."""
    e = ev(s, d).select(F.col("us").alias("ts"), F.col("user_id").cast("bigint").alias("user_id"), F.col("event_id").cast("bigint").alias("event_id"), "v", (F.col("user_id") % 4).cast("bigint").alias("kind"), "day")
    root, parts = scratch(s, "sections"), scratch(s, "parts")
    sections.write_part(e.where("day < 15"), root, _OLD, 1)
    sections.write_part(e.where("day >= 15 AND day < 22"), root, _NEW, 2)
    sections.write_part(e.where("day >= 22"), parts, _NEW, 3)
    sections.seal(s, f"{parts}/samples/layout=2/segment_id=3", root, _NEW, 3, files=2)
    registry = sections.Registry([_OLD, _NEW])
    return frames.section_rows(sections.scan(s, root, registry, "samples"), T0 + DAY, T0 + 28 * DAY, ["ts", "user_id", "event_id", "v", "kind", "segment_id"])


@query(f"WITH {_EV} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type || user_id % 3 END AS word FROM ev WHERE day < 20")
def dictionary_lookup(s, d):
    """Texts are stored as ids; dictionaries of two parts are merged and looked up. Id 0 and unknown ids are null."""
    e = ev(s, d).where("day < 20").withColumn("text", F.concat("event_type", (F.col("user_id") % 3).cast("string")))
    e = e.withColumn("id", sections.surrogate(F.col("text")))
    part = lambda c: e.where(c).select("id", F.col("text").alias("value")).distinct()
    words = sections.dictionary_merge([part("day < 12"), part("day >= 8")])
    rows = e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit(0)).when(F.col("event_id") % 10 == 5, F.lit(-7)).otherwise(F.col("id")).alias("word"))
    return sections.resolve(rows, "word", words)


def _parts(s, d, name: str):
    """Three live parts, by days."""
    root = scratch(s, name)
    e = ev(s, d).select("event_id", "us", "user_id", "v", "day")
    for k, (a, b) in enumerate(((-1, 10), (10, 20), (20, 10_000))):
        e.where((F.col("day") >= a) & (F.col("day") < b)).coalesce(1).write.parquet(f"{root}/part={k}")
    return root, e


@query(f"WITH {_EV} SELECT event_id, user_id, v FROM ev")
def journal_recovery(s, d):
    """Parts are read though one between them is damaged."""
    root, e = _parts(s, d, "journal")
    s.createDataFrame([("no part at all",)], "t string").coalesce(1).write.text(f"{root}/part=9")
    return sections.damaged(s, root, e.schema).select("event_id", "user_id", "v")


@query("SELECT * FROM (VALUES (false, 3), (true, 1)) AS t(damaged, files)")
def journal_damage(s, d):
    root, _ = _parts(s, d, "damage")
    s.createDataFrame([("no part at all",)], "t string").coalesce(1).write.text(f"{root}/part=9")
    return sections.damage(s, root).groupBy("damaged").agg(F.count("*").cast("int").alias("files"))


@query(f"WITH {_EV} SELECT event_id, v FROM ev WHERE day < 20")
def pinned_view(s, d):
    """A view that was pinned before the last part came."""
    root, e = _parts(s, d, "pinned")
    files = [f for f in sections.pinned(s, root) if "part=2" not in f]
    e.where("day >= 20").limit(5).coalesce(1).write.mode("append").parquet(f"{root}/part=1")
    return sections.read_pinned(s, files, e.schema).select("event_id", "v")


@query(f"WITH {_EV}, r AS (SELECT user_id % 3 AS seg, event_type, day, CASE WHEN user_id % 3 = 1 THEN v * 2 ELSE v END AS v FROM ev) SELECT 'activity' AS view, event_type AS entity, day AS bucket, CAST(sum(v) AS BIGINT) AS value FROM r GROUP BY event_type, day")
def materialized_cells(s, d):
    """Pre-aggregates of segments, one of which is written anew, then read as one."""
    from tidemark.operators import metrics

    folder = scratch(s, "cells")
    rows = ev(s, d).withColumn("segment", (F.col("user_id") % 3).cast("int"))
    metrics.refresh_cells(metrics.segment_cells(rows, "segment", "activity", "event_type", F.col("day"), "v", "sum"), folder, "segment")
    again = rows.where("segment = 1").withColumn("v", F.col("v") * 2)
    metrics.refresh_cells(metrics.segment_cells(again, "segment", "activity", "event_type", F.col("day"), "v", "sum"), folder, "segment")
    return metrics.merge_cells(s.read.parquet(folder), "sum")


@query(f"WITH {_EV}, c AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'signed' WHEN 2 THEN 'float' WHEN 3 THEN 'boolean' WHEN 4 THEN 'time' END AS kind, v, event_type FROM ev), o AS (SELECT *, row_number() OVER (ORDER BY CASE kind WHEN 'boolean' THEN 1 WHEN 'signed' THEN 2 WHEN 'float' THEN 4 WHEN 'time' THEN 5 WHEN 'text' THEN 6 ELSE 0 END, CASE WHEN kind IN ('signed', 'time') THEN v WHEN kind = 'boolean' THEN v % 2 END, CASE WHEN kind = 'float' THEN -v / 2.0 END, CASE WHEN kind = 'text' THEN event_type END, event_id) AS place FROM c) SELECT event_id, place FROM o WHERE place <= 6000")
def mixed_cell_order(s, d):
    """Cells of different kinds in one total order."""
    from pyspark.sql import Window

    kind = F.expr("CASE event_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'signed' WHEN 2 THEN 'float' WHEN 3 THEN 'boolean' WHEN 4 THEN 'time' END")
    e = ev(s, d).withColumns({"kind": kind, "whole": F.when(kind == "boolean", F.col("v") % 2).otherwise(F.col("v")), "number": -F.col("v") / 2.0})
    order = [*frames.cell_order(F.col("kind"), F.col("whole"), F.col("number"), F.col("event_type")), F.col("event_id")]
    top = e.orderBy(*order).limit(6000)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select("event_id", "place")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}.parquet', true)" for t in _TABLES) + ") AS t(file, held)")
def file_inventory(s, d):
    """The tables' files or folders of parts, and that each has a share of all bytes."""
    files = sections.inventory(s, d).groupBy(F.col("entry").alias("file")).agg(F.sum("bytes").alias("bytes"), F.sum("share").alias("share"))
    files = files.select("file", ((F.col("bytes") > 0) & (F.col("share") > 0) & (F.col("share") < 1)).alias("held"))
    return files.where(F.col("file").isin(*(f"{t}.parquet" for t in _TABLES)))


# ---- streams ---------------------------------------------------------------------------------------------------------------


def _stream(s, d, rows, name: str):
    """Rows as a stream of three batches in the order of time."""
    folder = scratch(s, name)
    for k, (a, b) in enumerate(((-1, 10), (10, 20), (20, 10_000))):
        rows.where((F.col("day") >= a) & (F.col("day") < b)).coalesce(1).write.parquet(f"{folder}/in/b={k}")
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*"), folder


@query(f"WITH {_CN}, p AS (SELECT *, lag(us) OVER w AS pu, lag(n) OVER w AS pn FROM cn WINDOW w AS (PARTITION BY user_id ORDER BY us)) SELECT user_id, us AS ts, CASE WHEN pu IS NULL THEN 'first_point' WHEN {_gap_sql('pu', 'us')} THEN 'gap' WHEN us <= pu THEN 'anomaly' WHEN n < pn THEN 'reset' END AS reason, CASE WHEN n >= pn AND us > pu AND NOT ({_gap_sql('pu', 'us')}) THEN n - pn END AS delta FROM p")
def counter_diff_streamed(s, d):
    stream, folder = _stream(s, d, cn(s, d).select("user_id", "us", "n", "day"), "counters")
    return live.drained(live.counter_diff_stream(stream, ["user_id"], "n", "us", GAPS), folder).select("user_id", "ts", "reason", "delta")


@query(f"WITH {_EV} SELECT event_type, us // {HOUR * 6} * {HOUR * 6} AS start_us, count(*) AS n, max(v) AS most FROM ev GROUP BY ALL")
def tumbling_stream(s, d):
    stream, folder = _stream(s, d, ev(s, d).select("event_type", "us", "v", "day"), "tumbling")
    windows = live.tumbling(stream.withColumn("time", F.timestamp_micros("us")), "time", "6 hours", ["event_type"], "40 days", F.count("*").alias("n"), F.max("v").alias("most"))
    return live.drained(windows, folder, "complete").select("event_type", F.unix_micros("start").alias("start_us"), "n", "most")


@query(f"WITH {_EV}, k AS (SELECT event_type, us // {HOUR * 6} - j AS w FROM ev, range(0, 2) t(j)) SELECT event_type, w * {HOUR * 6} AS start_us, count(*) AS n FROM k GROUP BY ALL")
def sliding_stream(s, d):
    stream, folder = _stream(s, d, ev(s, d).select("event_type", "us", "day"), "sliding")
    windows = live.sliding(stream.withColumn("time", F.timestamp_micros("us")), "time", "12 hours", "6 hours", ["event_type"], "40 days", F.count("*").alias("n"))
    return live.drained(windows, folder, "complete").select("event_type", F.unix_micros("start").alias("start_us"), "n")


@query(f"WITH {_EV}, g AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < {12 * HOUR} THEN 0 ELSE 1 END AS fresh FROM ev), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(us) AS start_us, count(*) AS n FROM k GROUP BY user_id, k")
def session_stream(s, d):
    stream, folder = _stream(s, d, ev(s, d).select("user_id", "us", "day"), "sessions")
    runs = live.sessions(stream.withColumn("time", F.timestamp_micros("us")), "time", "12 hours", ["user_id"], "40 days")
    return live.drained(runs, folder, "complete").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query(f"WITH {_EV} SELECT event_type, count(*) AS n FROM ev GROUP BY event_type")
def live_fold(s, d):
    stream, folder = _stream(s, d, ev(s, d).select("event_type", "day"), "fold")
    return live.drained(live.live_counts(stream, ["event_type"]), folder, "complete")


@query(f"WITH {_EV} SELECT CAST(CASE WHEN day < 10 THEN 0 WHEN day < 20 THEN 1 ELSE 2 END AS INTEGER) AS segment_id, count(*) AS n FROM ev GROUP BY ALL")
def appended_segments(s, d):
    """Each batch becomes a segment; doing the last again changes nothing."""
    stream, folder = _stream(s, d, ev(s, d).select("event_id", "day"), "segments")
    sink = live.segment_sink(f"{folder}/out")
    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    sink(s.read.parquet(f"{folder}/out/segment_id=2"), 3)
    sink(s.read.parquet(f"{folder}/out/segment_id=3"), 2)
    return s.read.parquet(f"{folder}/out").where("segment_id < 3").groupBy("segment_id").agg(F.count("*").alias("n"))


@query(f"WITH {_EV} SELECT event_type, max(us) AS through_us, max(us) < {T0 + 30 * DAY} - {12 * HOUR} AS stale FROM ev GROUP BY event_type")
def freshness(s, d):
    e = table(s, d, "events").withColumn("time", F.col("ts").cast("timestamp_ntz"))
    return live.freshness(e, ["event_type"], "time", "2024-01-31 00:00:00", "12 hours").select("event_type", sc.micros("data_through").alias("through_us"), "stale")


@query(
    f"WITH {_EV}, b AS (SELECT event_type, us, event_id, us // {3 * DAY} AS a, coalesce(sum(v) OVER (PARTITION BY event_type ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500000 AS q FROM ev), n AS (SELECT *, CASE WHEN a <> lag(a) OVER w OR q <> lag(q) OVER w THEN 1 ELSE 0 END AS fresh FROM b WINDOW w AS (PARTITION BY event_type ORDER BY us)), "
    "p AS (SELECT event_type, sum(fresh) OVER (PARTITION BY event_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS segment FROM n) SELECT event_type, CAST(segment AS BIGINT) AS segment, count(*) AS parts FROM p GROUP BY ALL"
)
def segment_roll(s, d):
    return live.rolled_segments(ev(s, d), ["event_type"], "us", "v", 500_000, 3 * DAY).groupBy("event_type", "segment").agg(F.count("*").alias("parts"))


_PERIODS = ", ".join(f"('{v.name}', {v.period_s})" for v in external.VIEWS.values())


@query(f"WITH p(source, period_s) AS (VALUES {_PERIODS}), t AS (SELECT DISTINCT p_size * 5 AS tick_s FROM part) SELECT tick_s, source FROM t, p WHERE tick_s % period_s = 0")
def due_sources(s, d):
    periods = s.createDataFrame([(v.name, v.period_s) for v in external.VIEWS.values()], "source string, period_s int")
    return live.due_sources(periods, table(s, d, "part").select((F.col("p_size") * 5).alias("tick_s")).distinct())
