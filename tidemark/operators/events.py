"""Log events: parsing of lines, grouping, classes worth notice, filters and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import error_category, micros, normalize_message, normalize_sql

#: Severities from the least.
SEVERITIES = ["LOG", "WARNING", "ERROR", "FATAL", "PANIC"]
#: Words that name a severity in a line, English and Russian.
SEVERITY_WORDS = {"LOG": "LOG", "WARNING": "WARNING", "ERROR": "ERROR", "FATAL": "FATAL", "PANIC": "PANIC", "СООБЩЕНИЕ": "LOG", "ПРЕДУПРЕЖДЕНИЕ": "WARNING", "ОШИБКА": "ERROR", "ВАЖНО": "FATAL", "ПАНИКА": "PANIC"}
#: Words that name a continuation of an event.
CONTINUATIONS = {"DETAIL": "detail", "HINT": "hint", "CONTEXT": "context", "STATEMENT": "statement", "ПОДРОБНОСТИ": "detail", "ПОДСКАЗКА": "hint", "КОНТЕКСТ": "context", "ОПЕРАТОР": "statement"}
#: SQLSTATE, class and priority (0 first) of what is worth notice.
NOTABLE_STATES = [
    ("53100", "filesystem_space", 1),
    ("53200", "postgres_out_of_memory_observation", 1),
    ("53300", "connection_saturation", 3),
    ("40P01", "deadlock_observation", 3),
    ("40001", "serialization_failure_observation", 4),
    ("57014", "query_canceled_observation", 4),
    ("55P03", "lock_not_available_observation", 3),
    ("XX001", "corruption_sqlstate_observation", 1),
    ("XX002", "corruption_sqlstate_observation", 1),
    ("28P01", "auth_failure_observation", 5),
    ("28000", "authorization_failure_observation", 5),
    ("42501", "permission_denied_observation", 5),
]
#: Class and priority by event kind.
NOTABLE_KINDS = [
    ("pg_database_deadlock_delta", "deadlock_observation", 3),
    ("os_cgroup_oom_kill_delta", "oom_kill_observation", 1),
    ("os_host_oom_kill_delta", "oom_kill_observation", 1),
    ("os_cgroup_oom_delta", "postgres_out_of_memory_observation", 1),
    ("os_filesystem_capacity_zero_transition", "filesystem_capacity_zero", 1),
]


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.lit(SEVERITIES), severity) - 1


def at_least(severity: Column, least: str) -> Column:
    """Events without a severity pass."""
    return severity.isNull() | (severity_rank(severity) >= SEVERITIES.index(least))


def notable(kind: Column, severity: Column, sqlstate: Column, signal: Column) -> Column:
    """struct(class, priority) or null."""
    one = lambda name, p: F.struct(F.lit(name).alias("class"), F.lit(p).alias("priority"))
    out = F.when(kind.isin("child_process_crash", "shutdown") & (signal == 9), one("server_child_sigkill", 0)).when(kind.isin("child_process_crash", "shutdown") & signal.isNotNull(), one("server_child_signal_termination", 2))
    out = out.when((kind == "error_group") & (severity == "PANIC"), one("panic_severity_observation", 0))
    for state, name, p in NOTABLE_STATES:
        out = out.when((kind == "error_group") & (sqlstate == state), one(name, p))
    for k, name, p in NOTABLE_KINDS:
        out = out.when(kind == k, one(name, p))
    return out


def floor_class(severity: Column, sqlstate: Column, trusted: Column) -> Column:
    """What alone makes a health bucket critical: a structured panic, or corruption."""
    return F.when(~trusted, None).when(severity == "PANIC", "availability").when(sqlstate.isin("XX001", "XX002"), "integrity")


def of_kind(df: DataFrame, kind: str, column: str = "kind") -> DataFrame:
    """Events of exactly one kind, case and all."""
    return df.where(F.col(column) == F.lit(kind))


def preview(df: DataFrame, ts: str, key: str, limit: int = 100) -> DataFrame:
    """The first `limit` by priority, the newest first, then by key; with how many there are and how many are left out."""
    total = df.agg(F.count("*").alias("total"))
    first = df.orderBy("priority", F.desc(ts), key).limit(limit)
    return first.crossJoin(F.broadcast(total)).withColumn("omitted", F.greatest(F.col("total") - limit, F.lit(0)))


def parse_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Adds ts (microseconds), severity, sqlstate, message and continuation (detail, hint, context, statement) of a stderr
    line. The severity word that stands earliest counts."""
    words = "|".join(SEVERITY_WORDS)
    more = "|".join(CONTINUATIONS)
    head = rf"^(.*?)\b(?:({words})|({more})): +(?:([0-9A-Z]{{5}}): +)?(.*)$"
    word = F.regexp_extract(text, f"(?sU){head}", 2)
    cont = F.regexp_extract(text, f"(?sU){head}", 3)
    state = F.regexp_extract(text, f"(?sU){head}", 4)
    names = lambda m: F.create_map(*[F.lit(v) for p in m.items() for v in p])
    stamp = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)", 1)
    return lines.withColumns(
        {
            "ts": micros(F.try_to_timestamp(F.when(stamp != "", stamp))),
            "severity": names(SEVERITY_WORDS)[F.when(word != "", word)],
            "continuation": names(CONTINUATIONS)[F.when(cont != "", cont)],
            "sqlstate": F.when(state != "", state),
            "message": F.coalesce(F.when((word != "") | (cont != ""), F.regexp_extract(text, f"(?sU){head}", 5)), F.col(text)),
        }
    )


def assemble(parsed: DataFrame, stream: Sequence[str], order: str) -> DataFrame:
    """One row an event: its line with the continuations that follow it in the same stream. Lines that are neither go on
    the message."""
    w = Window.partitionBy(*stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = parsed.withColumns({"_event": F.sum(F.when(F.col("severity").isNotNull(), 1).otherwise(0)).over(w), "_kind": F.last("continuation", ignorenulls=True).over(w)})
    rows = rows.withColumn("_head", F.col("severity").isNotNull())
    own = F.when(F.col("_head"), None).otherwise(F.struct(F.col(order).alias("o"), F.col("continuation").alias("k"), F.col("message").alias("m")))
    out = rows.where("_event > 0").groupBy(*stream, "_event").agg(
        F.min(F.when(F.col("_head"), F.col(order))).alias(order),
        *(F.min(F.when(F.col("_head"), F.col(c))).alias(c) for c in ("ts", "severity", "sqlstate", "message")),
        F.array_sort(F.collect_list(own)).alias("_more"),
    )
    pick = lambda k: F.nullif(F.array_join(F.transform(F.filter("_more", lambda x: x["k"] == k), lambda x: x["m"]), "\n"), F.lit(""))
    return out.withColumns({k: pick(k) for k in ("detail", "hint", "context", "statement")} | {"rest": F.size(F.filter("_more", lambda x: x["k"].isNull()))}).drop("_more", "_event")


def error_groups(events: DataFrame, limit: int = 32) -> DataFrame:
    """severity, sqlstate, pattern, category, n and the first sample, most frequent first."""
    rows = events.withColumn("pattern", normalize_message(F.col("message")))
    out = rows.groupBy("severity", "sqlstate", "pattern").agg(F.count("*").alias("n"), F.min_by("message", "ts").alias("sample"))
    return out.withColumn("category", error_category(F.col("pattern"), F.col("severity"))).orderBy(F.desc("n"), "severity", "sqlstate", "pattern").limit(limit)


def slow_groups(queries: DataFrame, limit: int = 16) -> DataFrame:
    """pattern, n, total and greatest duration; ts and sample are those of the greatest, the first on ties."""
    rows = queries.withColumn("pattern", normalize_sql(F.col("statement")))
    best = F.max_by(F.struct("ts", "statement"), F.struct("duration", (-F.col("ts")).alias("t")))
    out = rows.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("duration").alias("total"), F.max("duration").alias("longest"), best.alias("b"))
    return out.select("pattern", "n", "total", "longest", "b.ts", F.col("b.statement").alias("sample")).orderBy(F.desc("total"), "pattern").limit(limit)


#: What messages of other kinds look like.
TYPED = {
    "checkpoint_starting": r"^checkpoint starting: (.*)$",
    "checkpoint_complete": r"^checkpoint complete: wrote (\d+) buffers",
    "autovacuum": r'^automatic vacuum of table "([^"]+)"',
    "autoanalyze": r'^automatic analyze of table "([^"]+)"',
    "slow_query": r"^duration: ([0-9.]+) ms",
    "lock_wait": r"^process (\d+) still waiting for",
    "lock_acquired": r"^process (\d+) acquired",
    "temp_file": r"^temporary file: path .*, size (\d+)",
    "child_process_crash": r"terminated by signal (\d+)",
    "ready": r"^database system is ready to accept connections()",
    "shutdown": r"^received (\w+) shutdown request",
}


def typed_events(parsed: DataFrame, message: str = "message") -> DataFrame:
    """Adds kind and detail_value of messages of a known form."""
    kind = detail = None
    for name, pattern in TYPED.items():
        hit = F.col(message).rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        value = F.regexp_extract(message, pattern, 1)
        detail = F.when(hit, value) if detail is None else detail.when(hit, value)
    return parsed.withColumns({"kind": kind, "detail_value": F.nullif(detail, F.lit(""))})


#: Typed fields of messages of known forms: name, pattern, type.
FIELDS = [
    ("buffers", r"checkpoint complete: wrote (\d+) buffers", "bigint"),
    ("write_s", r"checkpoint complete: .*?\bwrite=([0-9.]+) s", "double"),
    ("sync_s", r"checkpoint complete: .*?\bsync=([0-9.]+) s", "double"),
    ("total_s", r"checkpoint complete: .*?\btotal=([0-9.]+) s", "double"),
    ("relation", r'automatic (?:vacuum|analyze) of table "([^"]+)"', "string"),
    ("tuples_removed", r"automatic vacuum of .*?\btuples: (\d+) removed", "bigint"),
    ("duration_ms", r"^duration: ([0-9.]+) ms", "double"),
    ("pid", r"(?:^process |\(PID )(\d+)", "bigint"),
    ("lock_mode", r"^process \d+ (?:still waiting for|acquired) (\w+) on", "string"),
    ("waited_ms", r"^process \d+ (?:still waiting for|acquired) .* after ([0-9.]+) ms", "double"),
    ("temp_bytes", r"^temporary file: path .*, size (\d+)", "bigint"),
    ("signal", r"terminated by signal (\d+)", "int"),
    ("exit_code", r"exited with exit code (\d+)", "int"),
    ("shutdown_mode", r"^received (\w+) shutdown request", "string"),
]


def event_fields(parsed: DataFrame, message: str = "message") -> DataFrame:
    """Adds the typed fields; null where a message doesn't say."""
    found = {n: F.regexp_extract(message, f"(?s){p}", 1) for n, p, _ in FIELDS}
    return parsed.withColumns({n: F.when(found[n] != "", found[n]).try_cast(t) for n, _, t in FIELDS})
