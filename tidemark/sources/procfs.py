"""Parsers of /proc, /sys and control-group text, one row a line in, typed rows out. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import limit_value

_SPACE = r"\s+"


def _words(c: str = "value") -> Column:
    return F.split(F.trim(F.col(c)), _SPACE)


def _at(words: Column, k: int) -> Column:
    return F.get(words, F.lit(k)).try_cast("bigint")


def _spread(df: DataFrame, words: Column, start: int, names: list[str]) -> list[Column]:
    return [_at(words, start + k).alias(n) for k, n in enumerate(names)]


#: Fields in the order of the files.
CPU = ["user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal", "guest", "guest_nice"]


def cpu(lines: DataFrame) -> DataFrame:
    """Lines of /proc/stat: cpu_id (-1 for all) and ticks."""
    w = _words()
    name = F.get(w, F.lit(0))
    return lines.where(F.col("value").rlike(r"^cpu\d*\s")).select(F.when(name == "cpu", -1).otherwise(F.regexp_extract(name, r"\d+", 0).try_cast("int")).alias("cpu_id"), *_spread(lines, w, 1, CPU))


def key_values(lines: DataFrame) -> DataFrame:
    """Lines of a name and a number, as in meminfo and vmstat: name, value in bytes where the unit is kB."""
    w = F.split(F.regexp_replace("value", ":", " "), _SPACE)
    return lines.where(F.col("value").rlike(r"^\S+:?\s+\d+")).select(F.get(w, F.lit(0)).alias("name"), (_at(w, 1) * F.when(F.get(w, F.lit(2)) == "kB", 1024).otherwise(1)).alias("number"))


def loadavg(lines: DataFrame) -> DataFrame:
    w = _words()
    return lines.select(*(F.get(w, F.lit(k)).try_cast("double").alias(f"load{n}") for k, n in enumerate((1, 5, 15))), F.regexp_extract("value", r"(\d+)/(\d+)", 1).try_cast("int").alias("running"), F.regexp_extract("value", r"(\d+)/(\d+)", 2).try_cast("int").alias("threads"))


#: Fixed values, as above.
DISK = ["reads", "reads_merged", "sectors_read", "read_ms", "writes", "writes_merged", "sectors_written", "write_ms", "in_flight", "io_ms", "weighted_ms"]


def diskstats(lines: DataFrame) -> DataFrame:
    w = _words()
    return lines.where(F.size(w) >= 14).select(_at(w, 0).alias("major"), _at(w, 1).alias("minor"), F.get(w, F.lit(2)).alias("device"), *_spread(lines, w, 3, DISK))


#: Fixed values, as above.
NET = [f"{d}_{n}" for d, names in (("rx", ("bytes", "packets", "errs", "drop", "fifo", "frame", "compressed", "multicast")), ("tx", ("bytes", "packets", "errs", "drop", "fifo", "colls", "carrier", "compressed"))) for n in names]


def netdev(lines: DataFrame) -> DataFrame:
    w = F.split(F.trim(F.regexp_extract("value", r"^\s*[^:]+:(.*)$", 1)), _SPACE)
    return lines.where(F.col("value").rlike(r"^\s*[^|:\s]+:\s*\d")).select(F.trim(F.regexp_extract("value", r"^\s*([^:]+):", 1)).alias("interface"), *_spread(lines, w, 0, NET))


def pressure(lines: DataFrame) -> DataFrame:
    """Lines of /proc/pressure/*: kind (some, full), averages and total."""
    num = lambda n: F.regexp_extract("value", rf"{n}=([0-9.]+)", 1)
    return lines.where(F.col("value").rlike("^(some|full) ")).select(F.regexp_extract("value", "^(some|full)", 1).alias("kind"), *(num(f"avg{n}").try_cast("double").alias(f"avg{n}") for n in (10, 60, 300)), num("total").try_cast("bigint").alias("total_us"))


def process_stat(lines: DataFrame) -> DataFrame:
    """A line of /proc/<pid>/stat; the name may hold blanks and parentheses, so fields count from the last one."""
    w = F.split(F.trim(F.regexp_extract("value", r"(?s)^.*\)(.*)$", 1)), _SPACE)
    return lines.select(
        F.regexp_extract("value", r"^(\d+)", 1).try_cast("int").alias("pid"),
        F.regexp_extract("value", r"(?s)\((.*)\)", 1).alias("comm"),
        F.get(w, F.lit(0)).alias("state"),
        *(_at(w, k).alias(n) for n, k in {"ppid": 1, "minflt": 7, "majflt": 9, "utime": 11, "stime": 12, "num_threads": 17, "starttime": 19, "vsize": 20, "rss_pages": 21, "policy": 38, "blkdelay_ticks": 39}.items()),
    )


def cgroup_limits(lines: DataFrame) -> DataFrame:
    """Files of one value, where the word for no limit is null."""
    return lines.select(limit_value(F.col("value")).alias("limit"))


def cgroup_pairs(lines: DataFrame) -> DataFrame:
    """Flat files of name and number, as cpu.stat and memory.events."""
    w = _words()
    return lines.where(F.size(w) == 2).select(F.get(w, F.lit(0)).alias("name"), _at(w, 1).alias("number"))


def cgroup_io(lines: DataFrame) -> DataFrame:
    """Lines of io.stat: device and its counters."""
    num = lambda n: F.regexp_extract("value", rf"\b{n}=(\d+)", 1).try_cast("bigint").alias(n)
    return lines.where(F.col("value").rlike(r"^\d+:\d+ ")).select(F.regexp_extract("value", r"^(\d+:\d+)", 1).alias("device"), *map(num, ("rbytes", "wbytes", "rios", "wios")))


def cgroup_path(lines: DataFrame) -> DataFrame:
    """Lines of /proc/<pid>/cgroup: controllers (null for version 2) and path."""
    return lines.select(F.nullif(F.regexp_extract("value", r"^\d+:([^:]*):", 1), F.lit("")).alias("controllers"), F.regexp_extract("value", r"^\d+:[^:]*:(.*)$", 1).alias("path"))


def protocol_counters(lines: DataFrame, line: str = "line") -> DataFrame:
    """/proc/net/snmp and netstat: each protocol has a line of names and then one of numbers: protocol, name, number. A name
    without a number, or the other way round, gives no row."""
    proto = F.regexp_extract("value", r"^(\w+):", 1)
    rows = lines.where(proto != "").select(proto.alias("protocol"), F.col(line).alias("_line"), F.split(F.trim(F.regexp_extract("value", r"^\w+:(.*)$", 1)), _SPACE).alias("_w"))
    both = rows.groupBy("protocol").agg(F.min_by("_w", "_line").alias("_names"), F.max_by("_w", "_line").alias("_numbers"), F.count("*").alias("_n")).where("_n = 2")
    out = both.select("protocol", F.explode(F.arrays_zip("_names", "_numbers")).alias("p"))
    return out.select("protocol", F.col("p._names").alias("name"), F.col("p._numbers").try_cast("bigint").alias("number")).dropna()


#: What is read of /proc/<pid>/status, and under which names.
STATUS = {"VmSize": "vsize_kb", "VmRSS": "rmem_kb", "VmSwap": "vswap_kb", "Threads": "num_threads", "voluntary_ctxt_switches": "nvcsw", "nonvoluntary_ctxt_switches": "nivcsw"}
#: Lines of /proc/<pid>/io.
IO = ["rchar", "wchar", "syscr", "syscw", "read_bytes", "write_bytes", "cancelled_write_bytes"]


def _by_name(lines: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    name, number = F.regexp_extract("value", r"^(\w+):", 1), F.regexp_extract("value", r"^\w+:\s*(-?\d+)", 1).try_cast("bigint")
    return lines.groupBy(*by).agg(*(F.max(F.when(name == k, number)).alias(v) for k, v in names.items()))


def process_status(lines: DataFrame, by: list[str]) -> DataFrame:
    """Sizes in kB, threads and switches of each process; null where a kernel thread has no such line."""
    return _by_name(lines, by, STATUS)


def process_io(lines: DataFrame, by: list[str]) -> DataFrame:
    """Characters, calls and bytes of each process."""
    return _by_name(lines, by, {k: k for k in IO})


def _unescaped(x: Column) -> Column:
    for code, c in (("040", " "), ("011", "\t"), ("012", "\n"), ("134", "\\")):
        x = F.replace(x, F.lit(f"\\{code}"), F.lit(c))
    return x


def mountinfo(lines: DataFrame) -> DataFrame:
    """mount_id, parent_id, device, root, mount_point, options, fs_type, source; the optional fields end at a lone dash."""
    head, tail = F.split(F.regexp_extract("value", r"^(.*?) - .*$", 1), " "), F.split(F.regexp_extract("value", r"^.*? - (.*)$", 1), " ")
    return lines.where(F.col("value").rlike(r"^\d+ \d+ \d+:\d+ .* - ")).select(
        _at(head, 0).alias("mount_id"), _at(head, 1).alias("parent_id"), F.get(head, F.lit(2)).alias("device"), _unescaped(F.get(head, F.lit(3))).alias("root"),
        _unescaped(F.get(head, F.lit(4))).alias("mount_point"), F.get(head, F.lit(5)).alias("options"), F.get(tail, F.lit(0)).alias("fs_type"), _unescaped(F.get(tail, F.lit(1))).alias("source"),
    )


def topology(lines: DataFrame, line: str = "line") -> DataFrame:
    """/proc/cpuinfo: cpu_id, socket_id, core_id of each processor block."""
    from pyspark.sql import Window

    key, number = F.regexp_extract("value", r"^\s*([^:]*?)\s*:", 1), F.regexp_extract("value", r":\s*(\d+)\s*$", 1).try_cast("int")
    rows = lines.select(F.col(line).alias("_line"), key.alias("k"), number.alias("n"))
    w = Window.orderBy("_line").rowsBetween(Window.unboundedPreceding, 0)  # one small file
    blocks = rows.withColumn("_b", F.sum(F.when(F.col("k") == "processor", 1).otherwise(0)).over(w)).where("_b > 0")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("n")))
    return blocks.groupBy("_b").agg(at("processor").alias("cpu_id"), at("physical id").alias("socket_id"), at("core id").alias("core_id")).drop("_b")
