"""Column functions: safe arithmetic, unit conversions, names, globs and log text. All are JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a time without zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts.cast("timestamp_ntz"))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def gauge_value(x: Column, kind: str) -> Column:
    """A gauge as double: booleans are 0 and 1, timestamps microseconds; text and lists break the series (null)."""
    if kind == "boolean":
        return x.cast("int").cast("double")
    if kind.startswith("timestamp"):
        return micros(x).cast("double")
    if kind == "string" or kind.startswith("array"):
        return F.lit(None).cast("double")
    return finite(x.cast("double"))


def exact_integer(x: Column) -> Column:
    """An integer as double if doubles hold it exactly, else null."""
    return F.when(F.abs(x) <= 2**53, x.cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """num / den; null where den isn't positive or either isn't finite."""
    num, den = finite(num.cast("double")), finite(den.cast("double"))
    return F.when(den > 0, finite(num / den))


def percent(num: Column, den: Column) -> Column:
    return ratio(num.cast("double") * 100.0, den)


def rate(delta: Column, dt_micros: Column, scale: float = 1.0) -> Column:
    """Per second."""
    return F.when(dt_micros > 0, delta.cast("double") * scale / (dt_micros / F.lit(float(MICROS))))


def tick_rate(user: Column, system: Column, hertz: Column, dt_micros: Column) -> Column:
    """CPU seconds a second from tick deltas."""
    return F.when(hertz > 0, rate((user + system) / hertz, dt_micros))


def cache_served(read_chars: Column, read_bytes: Column, dt_micros: Column) -> Column:
    """Bytes a second that were read without the device, never negative."""
    return rate(F.greatest(read_chars - read_bytes, F.lit(0)), dt_micros)


def lag_micros(lag_seconds: Column) -> Column:
    return F.when(lag_seconds >= 0, (lag_seconds * MICROS).cast("bigint"))


def join_non_null(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def qualify(schema: Column, name: Column) -> Column:
    return F.concat_ws(".", schema, name)


def limit_value(x: Column) -> Column:
    """A control-group limit; the word for no limit is null."""
    return F.when(F.trim(x) == "max", None).otherwise(F.trim(x).cast("bigint"))


def kib(x: Column) -> Column:
    """Bytes of a size in kB."""
    return x.cast("bigint") * 1024


#: Names of process states.
PROCESS_STATES = {"R": "running", "S": "sleeping", "D": "disk sleep", "Z": "zombie", "T": "stopped", "t": "tracing stop", "I": "idle", "X": "dead"}
#: Names of scheduling policies by number.
SCHEDULERS = {0: "SCHED_OTHER", 1: "SCHED_FIFO", 2: "SCHED_RR", 3: "SCHED_BATCH", 5: "SCHED_IDLE", 6: "SCHED_DEADLINE"}


def named(x: Column, names: dict) -> Column:
    """The name of a code, or null."""
    return F.create_map(*[F.lit(v) for pair in names.items() for v in pair])[x]


def duration_micros(text: str) -> int:
    """A positive length of time: 250ms, 90s, 15m, 2h; a bare number is in seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h|)\s*", text)
    value = int(m[1]) * {"ms": 1000, "s": MICROS, "": MICROS, "m": 60 * MICROS, "h": 3600 * MICROS}[m[2]] if m else 0
    if value <= 0:
        raise ValueError(f"not a positive length of time: {text!r}")
    return value


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest beginning of at most `limit` UTF-8 bytes that cuts no character. A character has four bytes at most,
    so the cut lies within three bytes of the limit."""
    raw = F.encode(text, "UTF-8")
    starts = lambda k: F.coalesce(F.conv(F.hex(F.substring(raw, k + 1, 1)), 16, 10).cast("int").bitwiseAND(0xC0) != 0x80, F.lit(True))
    cut = F.lit(max(limit - 3, 0))
    for k in range(max(limit - 2, 0), limit + 1):
        cut = F.when(starts(k), F.lit(k)).otherwise(cut)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


# ---- search -------------------------------------------------------------------------------------------------------------


def glob(x: Column, pattern: str) -> Column:
    """Case-folded match of the whole value; * and ? stand for any text and any character, a backslash takes away their
    meaning. Null matches nothing."""
    out, chars = "", iter(pattern)
    for c in chars:
        if c == "\\":
            out += re.escape(next(chars, "\\"))
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
    return F.coalesce(F.lower(x.cast("string")).rlike(f"(?s)^{out.lower()}$"), F.lit(False))


def search_terms(text: str, most_terms: int = 16, most_bytes: int = 256) -> list[tuple[str | None, str]]:
    """(field or None, value) of each term of a search: terms are split at white space, quotes keep it, and a field is what
    stands before the first bare colon."""
    if len(text.encode()) > most_bytes:
        raise ValueError("search is too long")
    terms, field, now, quoted, some, chars = [], None, "", False, False, iter(text)
    for c in chars:
        if c == "\\":
            now += "\\" + next(chars, "\\")
            some = True
        elif c == '"':
            quoted = not quoted
            some = True
        elif c.isspace() and not quoted:
            if some:
                terms.append((field, now))
            field, now, some = None, "", False
        elif c == ":" and not quoted and field is None and now:
            field, now = now, ""
        else:
            now += c
            some = True
    if quoted:
        raise ValueError("search has an open quote")
    if some or field is not None:
        terms.append((field, now))
    if len(terms) > most_terms:
        raise ValueError("search has too many terms")
    return terms


def _typed(x: Column, kind: str, value: str) -> Column:
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return x == (int(value) if re.fullmatch(r"-?\d+", value) else None)
    if kind in ("float", "double"):
        return x == float(value)
    if kind == "boolean":
        return x == (value.lower() == "true")
    return glob(x, value)


def search(df_types: dict[str, str], label: str, columns: list[str], text: str) -> Column:
    """All terms hold: field:value tests that column by its type, a bare term the label or any of the columns."""
    out = F.lit(True)
    for field, value in search_terms(text):
        if field is not None and field in df_types:
            one = F.coalesce(_typed(F.col(field), df_types[field], value), F.lit(False))
        elif field is not None:
            raise ValueError(f"no such field: {field}")
        else:
            one = glob(F.col(label), value)
            for c in columns:
                one = one | glob(F.col(c), value)
        out = out & one
    return out


# ---- log text -----------------------------------------------------------------------------------------------------------

#: Words whose following number is taken out of a message, in this order.
NUMBERED = ["transaction ", "relation ", "process ", "database ", "PID ", "signal ", "по сигналу ", "on page "]
#: Objects whose name is taken out of a refusal.
REFUSED = ["table", "schema", "sequence", "function", "database"]
#: Categories of errors by parts of their lower-cased messages, the first that fits.
CATEGORIES = [
    ("lock", ["deadlock detected", "could not obtain lock", "lock timeout", "still waiting for"]),
    ("constraint", ["duplicate key", "violates foreign key", "violates not-null", "violates check", "violates exclusion", "null value in column"]),
    ("serialization", ["could not serialize access"]),
    ("timeout", ["statement timeout", "idle-in-transaction session timeout", "transaction timeout", "idle session timeout", "canceling statement due to user request"]),
    ("resource", ["out of memory", "out of shared memory", "too many connections", "disk full", "could not extend", "remaining connection slots"]),
    ("data_corruption", ["invalid page", "could not read block", "data corrupted", "index corrupted", "unexpected zero page", "invalid checkpoint record", "invalid memory alloc"]),
    ("system", ["could not open file", "i/o error", "crash shutdown", "server process", "процесс сервера", "shutting down", "был завершён по сигналу", "завершился с кодом выхода"]),
    ("connection", ["connection reset by peer", "unexpected eof", "broken pipe", "could not receive data", "could not send data", "terminating connection"]),
    ("auth", ["password authentication failed", "no pg_hba.conf entry", "role ", "permission denied", "ssl connection is required"]),
    ("syntax", ["syntax error", "does not exist", "invalid input syntax", "division by zero", "value too long"]),
]
#: What, with ": killed", tells that a process was killed.
KILLED = ["terminated by signal", "был завершён по сигналу"]


def normalize_message(text: Column) -> Column:
    """An error message without what varies, for grouping. Empty quotes stay, and only the first number after each word
    goes."""
    x = F.regexp_replace(text, "(?s) at character .*$", "")
    x = F.regexp_replace(x, '"[^"]+"', '"..."')
    x = F.regexp_replace(x, "'[^']+'", "'...'")
    x = F.regexp_replace(x, r"\([^)]*\)", "(...)")
    x = F.regexp_replace(x, r"\[[^\]]*\]", "[...]")
    for word, digits in [*((w, "[0-9]") for w in NUMBERED), ("after ", "[0-9.]")]:  # behind the first of each word, by an atomic group
        x = F.regexp_replace(x, f"(?s)^((?>.*?{word})){digits}+", "$1...")
    x = F.regexp_replace(x, r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}(?![0-9A-Fa-f])", "...")
    x = F.regexp_replace(x, r"(?s)(invalid input syntax for .*?: ).*$", "$1...")
    x = F.regexp_replace(x, rf"(?is)(permission denied for (?:{'|'.join(REFUSED)}) ).*$", "$1...")
    x = F.regexp_replace(x, r"(?s)(byte sequence for encoding).*$", "$1 ...")
    return F.substring(x, 1, 4096)


def normalize_sql(text: Column) -> Column:
    """A message without what varies, and without numbers that aren't part of a name."""
    return F.regexp_replace(normalize_message(text), r"(?<![A-Za-z0-9_])[0-9][0-9.]*(?![A-Za-z0-9_])", "...")


def error_category(pattern: Column, severity: Column) -> Column:
    """The category of an error: a panic is corruption, and a fatal error that fits nowhere is the system's."""
    low = F.lower(pattern)
    has = lambda parts: F.greatest(F.lit(False), *(low.contains(p) for p in parts))
    out = F.when(severity == "PANIC", "data_corruption")
    for name, parts in CATEGORIES:
        cond = has(parts)
        if name == "resource":
            cond = cond | (has(KILLED) & low.contains(": killed"))
        out = out.when(cond, name)
    return out.when(severity == "FATAL", "system").otherwise("other")
