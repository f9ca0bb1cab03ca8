"""Cells of a frame: deltas that know why they are missing, compact values, identities as tokens, membership bits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite


def delta(now: Column, before: Column, pair: Column | None = None) -> Column:
    """struct(value, reason): the growth of a counter, or why it has none: what stands in `pair` (missing, gap or reset),
    missing where either value is, reset where it fell."""
    now, before = finite(now.cast("double")), finite(before.cast("double"))
    reason = F.when(now.isNull() | before.isNull(), "missing").when(now < before, "reset")
    if pair is not None:
        reason = F.coalesce(pair, reason)
    return F.struct(F.when(reason.isNull(), now - before).alias("value"), reason.alias("reason"))


def delta_sum(parts: Sequence[tuple[Column, Column]], pair: Column | None = None, nullable: bool = False) -> Column:
    """struct(value, reason) of the sum of several counters' growth. The last counter with a reset or a gap tells the
    reason, a missing one or any later good one after it makes it missing. nullable: one that is null both times adds 0."""
    value, reason = F.lit(0.0), F.lit(None).cast("string")
    for now, before in parts:
        one = delta(now, before, pair)
        if nullable:
            one = F.when(now.isNull() & before.isNull(), F.struct(F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("reason"))).otherwise(one)
        reason = F.when(reason.isNull() & one["reason"].isNull(), None).when(one["reason"].isin("reset", "gap"), one["reason"]).otherwise("missing")
        value = value + one["value"]
    return F.struct(F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def age(now: Column, start: Column, unit_micros: int = 1) -> Column:
    """now - start; null without a start, and negative where it lies ahead."""
    return (now - start) / F.lit(unit_micros) if unit_micros != 1 else now - start


def quantized(value: Column, most: Column) -> Column:
    """A value from 0 to 255 of the greatest, 0 if that is 0; null stays null."""
    share = F.when(most == 0, 0.0).otherwise(value / most * 255.0)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(share + 0.5))).cast("int"))


def dequantized(code: Column, most: Column) -> Column:
    return code.cast("double") / 255.0 * most


#: The first byte of each kind of value in a token.
TAGS = {"smallint": 1, "int": 2, "bigint": 3, "boolean": 7, "timestamp": 8, "string": 9}
_BYTES = {"smallint": 2, "int": 4, "bigint": 8, "timestamp": 8}


def _hex_byte(n: int) -> Column:
    return F.lit(f"{n:02X}")


def _little(x: Column, n: int) -> Column:
    """The n lowest bytes in hexadecimal, the lowest first."""
    raw = F.lpad(F.hex(x.cast("bigint")), 16, "0")
    return F.concat(*(F.substring(raw, 15 - 2 * k, 2) for k in range(n)))


def identity_token(values: Sequence[tuple[Column, str]], revision: int = 1) -> Column:
    """An identity as a base64url token without padding: a revision, then each value's kind and bytes, the lowest first; 0
    for null."""
    parts = [_hex_byte(revision)]
    for x, kind in values:
        if kind == "boolean":
            body = F.when(x, "01").otherwise("00")
        elif kind == "string":
            body = F.concat(_little(F.octet_length(x), 4), F.hex(F.encode(x, "UTF-8")))
        else:
            body = _little(x, _BYTES[kind])
        parts.append(F.when(x.isNull(), "00").otherwise(F.concat(_hex_byte(TAGS[kind]), body)))
    return F.rtrim(F.translate(F.base64(F.unhex(F.concat(*parts))), "+/\r\n", "-_"), F.lit("="))


def token_values(token: Column, kinds: Sequence[str]) -> list[Column]:
    """The values of a token of integers, booleans and times; a token of other kinds or another revision gives nulls."""
    raw = F.translate(token, "-_", "+/")
    raw = F.hex(F.unbase64(F.rpad(raw, (F.ceil(F.length(raw) / 4) * 4).cast("int"), F.lit("="))))

    def reader(kind: str, n: int) -> Callable[[Column], Column]:
        def step(x: Column) -> Column:
            tag = F.substring(x["raw"], x["at"], F.lit(2))
            big = F.concat(*(F.substring(x["raw"], x["at"] + 2 * (n - k), F.lit(2)) for k in range(n)))
            sign = F.when(F.substring(big, 1, 1) >= "8", F.lit("F" * (16 - 2 * n))).otherwise(F.lit("0" * (16 - 2 * n)))
            value = F.conv(F.concat(sign, big), 16, -10).cast("bigint")
            value = value == 1 if kind == "boolean" else value
            after = x["at"] + F.when(tag == "00", 2).otherwise(2 + 2 * n)
            return F.struct(after.alias("at"), x["raw"].alias("raw"), F.when(tag == _hex_byte(TAGS[kind]), value).alias("value"))

        return step

    state, out = F.struct(F.lit(3).alias("at"), raw.alias("raw")), []
    for kind in kinds:
        state = _let(state, reader(kind, 1 if kind == "boolean" else _BYTES[kind]))
        out.append(state["value"])
    return out


def short_id(*parts: Column) -> Column:
    """The first 12 bytes of SHA-256 over the parts, in hexadecimal."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)


def hmac_sha256(key: bytes, text: Column) -> Column:
    """HMAC with SHA-256 in hexadecimal; the key is a parameter of the plan."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in key).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


#: Names of severities in recorded events by number.
SEVERITY_CODES = {0: "error", 1: "fatal", 2: "panic", 3: "warning", 4: "log"}
#: Event kinds by section and number of a phase or kind; None: any other number.
EVENT_KINDS = {
    "pg_log_errors": {None: "pg.log.error_group_observed"},
    "pg_log_checkpoints": {0: "pg.checkpoint.started", 1: "pg.checkpoint.completed", None: "pg.checkpoint.too_frequent_reported"},
    "pg_log_autovacuum": {1: "pg.maintenance.autoanalyze_reported", None: "pg.maintenance.autovacuum_reported"},
    "pg_log_slow_queries": {None: "pg.query.slow_group_reported"},
    "pg_log_lock_waits": {1: "pg.lock.acquired_after_wait_reported", None: "pg.lock.wait_reported"},
    "pg_log_lifecycle": {0: "pg.lifecycle.child_signal_termination", 1: "pg.lifecycle.child_process_crash", 2: "pg.lifecycle.shutdown_requested", None: "pg.lifecycle.ready_observed"},
    "pg_log_gap": {None: "collector.pg_log_gap"},
    "pg_log_temp_files": {None: "pg.temp_file.reported"},
}


def event_kind(section: Column, code: Column) -> Column:
    """The stable name of an event; the section's own name where it has none."""
    out = section
    for name, kinds in EVENT_KINDS.items():
        kind = F.lit(kinds[None])
        for k, v in kinds.items():
            kind = F.when(code == k, v).otherwise(kind) if k is not None else kind
        out = F.when(section == name, kind).otherwise(out)
    return out


# ---- membership ----------------------------------------------------------------------------------------------------------

BLOOM_BITS, BLOOM_HASHES = 512, 8
_GOLDEN = 0x9E3779B97F4A7C15


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _wrap(x: Column) -> Column:
    """A decimal modulo 2^64, as a signed long."""
    return _let(F.pmod(x, F.lit(Decimal(1 << 64))), lambda m: F.when(m >= F.lit(Decimal(1 << 63)), m - F.lit(Decimal(1 << 64))).otherwise(m).cast("bigint"))


def _wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def _times(x: Column, by: int) -> Column:
    """A product modulo 2^64: decimals of 38 digits don't hold it, so the factor goes in halves of 32 bits."""
    low, high = F.lit(Decimal(by & 0xFFFFFFFF)), F.lit(Decimal(by >> 32))

    def product(d: Column) -> Column:
        upper = _wide(_wrap(d * high).bitwiseAND(F.lit(0xFFFFFFFF))) * F.lit(Decimal(1 << 32))
        return _wrap(d * low + upper)

    return _let(_wide(x), product)


def _mix64(x: Column) -> Column:
    fold = lambda x, n: _let(x, lambda y: y.bitwiseXOR(F.shiftrightunsigned(y, n)))
    x = _wrap(_wide(x) + F.lit(Decimal(_GOLDEN)))
    for n, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = _times(fold(x, n), by)
    return fold(x, 31)


def bloom_bits(key: Column) -> Column:
    """The places of a key's bits, an array; equal to the recorder's own summaries."""
    key = key.cast("bigint")
    pair = F.struct(_wide(_mix64(key)).alias("first"), _wide(_mix64(key.bitwiseXOR(F.lit(_GOLDEN - (1 << 64)))).bitwiseOR(F.lit(1).cast("bigint"))).alias("step"))
    return _let(pair, lambda p: F.transform(F.sequence(F.lit(0), F.lit(BLOOM_HASHES - 1)), lambda k: _wrap(p["first"] + p["step"] * k).bitwiseAND(F.lit(BLOOM_BITS - 1)).cast("int")))


def bloom_may_contain(bits: Column, key: Column) -> Column:
    """False: the key isn't in the set whose bits these are."""
    return F.size(F.array_except(bloom_bits(key), bits)) == 0
