"""Error classes and the backoff schedule, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: texts that mark an error as transient
TRANSIENT = (
    "timeout",
    "temporary",
    "connection refused",
    "connection reset",
    "broken pipe",
    "i/o timeout",
    "too many open files",
    "resource temporarily unavailable",
    "connection attempt failed",
    "remote error: handshake failure",
    "deadline exceeded",
)
CAP_MS = 30_000


def classify_error(message: Column) -> Column:
    """unknown without a message; transient if it says so; else permanent, as is a cancellation."""
    low = F.lower(message)
    found = F.lit(False)
    for t in TRANSIENT:
        found = found | F.contains(low, F.lit(t))
    return F.when(message.isNull(), "unknown").when(F.contains(low, F.lit("context canceled")), "permanent").when(found, "transient").otherwise("permanent")


def backoff_ms(attempt: Column, base_ms: int = 1000, jitter_ms: int = 0, noise: Column | None = None) -> Column:
    """base * 2 ** (attempt - 1) plus jitter in [0, jitter_ms), at most 30 s. ``noise`` in [0, 1) makes it random."""
    n = F.least(F.greatest(attempt, F.lit(1)), F.lit(40)).cast("int")
    more = F.floor((F.lit(0.0) if noise is None else noise) * jitter_ms).cast("bigint")
    return F.least(F.lit(base_ms).cast("bigint") * F.pow(F.lit(2.0), n - 1).cast("bigint") + more, F.lit(CAP_MS).cast("bigint"))


def should_retry(message: Column, attempt: Column, max_attempts: int) -> Column:
    return (classify_error(message) == "transient") & (attempt < max_attempts)
