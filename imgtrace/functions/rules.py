"""Small numeric and naming rules used by ranges, fleet and model handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
MAX_ATTEMPTS = 5
STALE_LEASE_MINUTES = 30
DEFAULT_RANGE_SIZE = 10_000
RANGE_BACKOFF_CAP_MINUTES = 30
THROUGHPUT_MIN_BYTES = 64 * 1024
MIB = 1024 * 1024

FAILURE_TIMEOUT = "시간 초과"
FAILURE_RESET = "연결 끊김"
FAILURE_DNS = "이름 조회 실패"
FAILURE_OTHER = "기타"

PROBE_BLOCKED = "차단됨"
PROBE_FAILED = "실패"
PROBE_REACHED = "도달함"
PROBE_OK = "성공"

UNKNOWN_DURATION = "알 수 없음"
# --------------------------------------------------------------------------


def _pow2(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), n.cast("int"))


def range_backoff_minutes(attempts: Column) -> Column:
    """1, 2, 4, 8, 16, then 30 minutes."""
    n = F.least(F.greatest(attempts, F.lit(1)), F.lit(6))
    return F.least(_pow2(n - 1), F.lit(RANGE_BACKOFF_CAP_MINUTES))


def post_delay_minutes(attempts: Column) -> Column:
    """2, 4, 8, 16, 32, then 64 minutes."""
    return _pow2(F.least(F.greatest(attempts, F.lit(1)), F.lit(6)))


def minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def range_size_for(per_second: Column, base: int) -> Column:
    """About one hour of work at this rate, within [100, 4*base]."""
    hour = F.floor(per_second * 3600).cast("bigint")
    return (
        F.when(per_second <= 0, F.lit(base).cast("bigint"))
        .when(hour < 100, F.lit(100).cast("bigint"))
        .when(hour > base * 4, F.lit(base * 4).cast("bigint"))
        .otherwise(hour)
    )


def range_size(lower: Column, upper: Column) -> Column:
    return upper - lower + 1


def failure_kind(http_code: Column, message: Column) -> Column:
    m = F.coalesce(message, F.lit(""))
    return (
        F.when(http_code.isNotNull(), F.concat(F.lit("HTTP "), http_code.cast("string")))
        .when(m.contains("context deadline exceeded") | m.contains("timeout"), FAILURE_TIMEOUT)
        .when(m.contains("connection reset"), FAILURE_RESET)
        .when(m.contains("no such host"), FAILURE_DNS)
        .otherwise(FAILURE_OTHER)
    )


def probe_verdict(blocked: Column, status: Column) -> Column:
    return (
        F.when(blocked, PROBE_BLOCKED)
        .when(F.coalesce(status, F.lit(0)) == 0, PROBE_FAILED)
        .when(status >= 400, F.concat(F.lit(PROBE_REACHED + " "), status.cast("string")))
        .otherwise(PROBE_OK)
    )


def throughput_mbps(n_bytes: Column, latency_seconds: Column) -> Column:
    """MiB per second; 0 for bodies under 64 KiB or no latency."""
    small = (n_bytes < THROUGHPUT_MIN_BYTES) | (F.coalesce(latency_seconds, F.lit(0.0)) <= 0)
    return F.when(small, F.lit(0.0)).otherwise(n_bytes / latency_seconds / F.lit(float(MIB)))


def estimate_minutes(remaining: Column, per_second: Column) -> Column:
    """Whole seconds needed, rounded half up to minutes; NULL when unknown."""
    seconds = F.floor(remaining / F.nullif(per_second.cast("double"), F.lit(0.0)))
    return F.when(
        (per_second > 0) & (remaining > 0), F.floor((seconds + 30) / 60).cast("bigint")
    )


def estimate_duration(remaining: Column, per_second: Column) -> Column:
    """Printable form, '1h2m0s' style; the fixed 'unknown' text otherwise."""
    m = estimate_minutes(remaining, per_second)
    hours, rest = F.floor(m / 60), m % 60
    text = (
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), rest.cast("string"), F.lit("m0s")))
        .when(m > 0, F.concat(rest.cast("string"), F.lit("m0s")))
        .otherwise("0s")
    )
    return F.when(m.isNull(), UNKNOWN_DURATION).otherwise(text)


def distance_name(raw: Column, index_kind: str) -> Column:
    """Canonical distance; the flat index refuses all but cosine and dot (NULL)."""
    c = F.lower(F.coalesce(raw, F.lit("")))
    named = F.when(c.isin("", "cosine"), "cosine").when(c == "dot", "dot")
    if index_kind == "flat":
        return named
    return named.when(c.isin("euclid", "euclidean", "l2"), "euclid").otherwise("cosine")
