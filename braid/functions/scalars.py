"""Scalar functions as column expressions; each stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("created", "pending", "running", "interrupted", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
STOPPED = (*TERMINAL, "interrupted")
STARTED = ("running", *STOPPED)
LEASE_MARGIN_MS = 30_000


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def is_stopped(status: Column) -> Column:
    return status.isin(*STOPPED)


def has_started(status: Column) -> Column:
    return status.isin(*STARTED)


def is_valid_status(status: Column) -> Column:
    return status.isin(*STATUSES)


# ---- keys


def flow_key(shard: Column, row_id: Column, token: Column) -> Column:
    return F.concat_ws("-", shard.cast("string"), row_id.cast("string"), token)


_KEY = r"^([1-9]\d*)-(-?\d+)-(.*)$"


def key_shard(key: Column) -> Column:
    """Shard of a key; null where the key is malformed."""
    return F.nullif(F.regexp_extract(key, _KEY, 1), F.lit("")).cast("int")


def key_id(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, _KEY, 2), F.lit("")).cast("long")


def key_token(key: Column) -> Column:
    return F.when(key.rlike(_KEY), F.regexp_extract(key, _KEY, 3))


def correlation_id(shard: Column, row_id: Column) -> Column:
    return F.concat_ws("-", shard.cast("string"), row_id.cast("string"))


# ---- time


def add_millis(ts: Column, ms: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(ts.cast("timestamp")) + ms)


def epoch_millis(ts: Column) -> Column:
    """Whole milliseconds since 1970, to the nearest one (halves away from zero) as SQL's epoch_ms has them."""
    us = F.unix_micros(ts.cast("timestamp"))
    return F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000))


def diff_millis(a: Column, b: Column) -> Column:
    return epoch_millis(a) - epoch_millis(b)


def backoff(initial_ms: Column, factor: Column, attempt: Column, cap_ms: Column) -> Column:
    """Delay before the next attempt: geometric, capped (cap 0: none); a factor of 0 or less keeps it constant."""
    delay = initial_ms * F.when(factor <= 0, F.lit(1.0)).otherwise(F.pow(factor, attempt))
    return F.when(cap_ms > 0, F.least(delay, cap_ms.cast("double"))).otherwise(delay)


def gives_up(age_ms: Column, next_delay_ms: Column, horizon_ms: Column) -> Column:
    """Whether the next attempt would fall behind the horizon (0 or less: no horizon)."""
    return (horizon_ms > 0) & (age_ms + next_delay_ms >= horizon_ms)


def sleep_clamp(ms: Column) -> Column:
    return F.greatest(ms, F.lit(0))


def lease_expiry(now: Column, budget_ms: Column, margin_ms: int = LEASE_MARGIN_MS) -> Column:
    return add_millis(now, budget_ms + margin_ms)


def duration_text(ms: Column) -> Column:
    """Short text of a duration: ms, seconds, minutes and seconds, hours and minutes, days and hours."""
    s, m, h = F.floor(ms / 1000), F.floor(ms / 60_000), F.floor(ms / 3_600_000)
    two = lambda a, ua, b, ub: F.concat(a.cast("string"), F.lit(ua), b.cast("string"), F.lit(ub))
    return (
        F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat((F.floor((ms + 5) / 10) / 100).cast("string"), F.lit("s")))
        .when(ms < 3_600_000, two(m, "m", F.pmod(s, F.lit(60)), "s"))
        .when(ms < 86_400_000, two(h, "h", F.pmod(m, F.lit(60)), "m"))
        .otherwise(two(F.floor(h / 24), "d", F.pmod(h, F.lit(24)), "h"))
    )


# ---- text


def like_escape(text: str) -> str:
    """``text`` as a literal inside a LIKE pattern with the escape character ``~``."""
    return text.replace("~", "~~").replace("%", "~%").replace("_", "~_")


def contains_literal(column: Column, text: str) -> Column:
    """Case-insensitive literal substring."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def strip_protocol(url: Column) -> Column:
    return F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")


def host_of(url: Column) -> Column:
    return F.split_part(F.split_part(strip_protocol(url), F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))


def strip_port(host: Column) -> Column:
    return F.regexp_replace(host, r":\d+$", "")


def trace_id(parent: Column) -> Column:
    """Trace id of a W3C traceparent, empty where it has none of 32 digits."""
    part = F.split_part(parent, F.lit("-"), F.lit(2))
    return F.when(F.length(part) == 32, part).otherwise("")


def storable(text: Column) -> Column:
    """Text without NUL characters."""
    return F.regexp_replace(text, "\x00", "")


def mermaid_escape(text: str) -> str:
    for char, entity in (("#", "#35;"), ('"', "#quot;"), ("[", "#91;"), ("]", "#93;"), ("{", "#123;"), ("}", "#125;"), ("(", "#40;"), (")", "#41;"), ("|", "#124;"), ("<", "#lt;"), (">", "#gt;"), ("`", "#96;")):
        text = text.replace(char, entity)
    return text


# ---- scheduling


def weight_or_one(weight: Column) -> Column:
    return F.when(weight <= 0, F.lit(1.0)).otherwise(weight)


def capacity_weight(vcpu: Column) -> Column:
    """Relative capacity of a database by its CPUs (0: undeclared, counts as 2)."""
    return F.when(vcpu <= 2, F.lit(745.0)).otherwise(vcpu * 450.0)


def refill_interval(share: Column, connections: Column, vcpu: Column, replicas: Column) -> Column:
    """Seconds between selections that keep a cache of ``share`` steps filled, one second at most."""
    return F.least(F.lit(1.0), share / (2.0 * F.least(120.0 * connections, 720.0 * vcpu / replicas)))


def candidate_floor(n: Column) -> Column:
    """Least bytes of a field that may be stored by reference, of n fields."""
    return F.greatest(F.lit(64), F.floor(1024 / n))


def open_threshold(n: Column, inflation: int = 5) -> Column:
    """Bytes from which a new anchor pays, of n fields; ``inflation`` holds from two fields on."""
    base = F.greatest(F.lit(64), F.least(F.lit(4096), F.floor(23552 / n)))
    return F.when(n > 1, F.floor(base / inflation)).otherwise(base)


def in_burst(elapsed_ms: Column, on_ms: int, off_ms: int) -> Column:
    return F.pmod(elapsed_ms, F.lit(on_ms + off_ms)) < on_ms
